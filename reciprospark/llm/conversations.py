"""Conversation structure repair: the cheapest edits after which roles read ``(s?(ua)+)?``, by Viterbi over chunks of rows.

A row is kept (0), gets another role (2) or is deleted (3; a must for blank and duplicate rows); empty turns are inserted (2); a truncated row that
stays adds 1. What the edits of the rows behind a place cost depends on four states alone: nothing yet, after a system, after a user, after an
assistant turn. Rows lie in chunks of bounded length, so that a conversation of any length is dealt over tasks: each chunk runs backwards from a
speculative cost vector; a fix-up pass hands every chunk the vector that its follower has found, and only chunks whose vector differs from the one
they had by more than a constant run again, until none does (tracing needs differences only, so constants don't matter). Chunks then state where each
entry state leads, the maps are stitched along a conversation, and every chunk traces the least audit from its true entry state.

Order: by turn, nulls first; rows of one turn by role and a digest of their text. Defined cases: a null role or text counts as one space, a null
conversation id is a conversation of its own; roles count by their first letter and case matters; equal rows are duplicates; an empty table gives empty
tables; other columns don't take part. Edits of one chunk are worked out in one task; the only things that a conversation needs in one place are
its vectors and maps (a few numbers a chunk) and, in ``report``, its audit and the hash, a chain by definition, which streams the rows in order.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import Scratch, small_batches, stored

#: Rows of a chunk at most, as a power of two.
CHUNK_BITS = 12

START, SYSTEM, USER, ASSISTANT = range(4)
#: Costs behind the last row: nothing and an assistant turn may end a conversation, others need inserted turns.
AT_END = (0, 4, 2, 0)
#: A user turn follows in every state but one.
FOLLOWS = (USER, USER, ASSISTANT, USER)
KEPT = {(START, 0): SYSTEM, (START, 1): USER, (SYSTEM, 1): USER, (USER, 2): ASSISTANT, (ASSISTANT, 1): USER}
LEGAL = {(0, 1), (1, 2), (2, 1)}
#: Faults, in the order in which the first counts. A row's code is 4 * initial (s, u, a, other) + fault.
SOUND, TRUNCATED, BLANK, DUPLICATE = range(4)

Vector = tuple[int, int, int, int]


def damaged(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, role, text) after damage by crc32 of ``conv:turn`` modulo 20: rows dropped, emptied, without full stops, repeated, or with the role user."""
    or_space = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(or_space(conv_col), F.lit(":"), or_space(turn_col)).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(or_space(text_col), "[.!?]", "")).otherwise(or_space(text_col))
    rows = conversations.select(F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").alias("turn"), F.when(kind == 4, "user").otherwise(or_space(role_col)).alias("role"), text.alias("text"), kind.alias("kind"))
    twice = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    return rows.filter("kind <> 0").select("conv", "turn", "role", "text", twice).drop("copy")


def _faults(text: Column) -> Column:
    last = F.right(F.rtrim(text, F.lit(" \t\n\x0b\f\r")), F.lit(1))
    return F.when(last == "", BLANK).when(~last.isin(".", "!", "?"), TRUNCATED).otherwise(SOUND)


class Costs:
    """Least costs behind a row, by state, and the edits that reach them; results are kept by code and vector, of which few kinds exist."""

    def __init__(self):
        self.steps: dict[tuple[int, Vector], tuple[Vector, int]] = {}
        self.edits: dict[tuple[int, Vector, int], tuple[str, int, int]] = {}

    def options(self, code: int, state: int) -> list[tuple[str, int, int]]:
        """(edit, cost, state behind it) of a row, least letter first."""
        out, fault = [("D", 3, state)], code & 3
        if fault < BLANK:
            if (state, code >> 2) in KEPT:
                out.append(("K", fault, KEPT[state, code >> 2]))
            out.append(("R", 2 + fault, FOLLOWS[state]))
        return out

    def before(self, code: int, after: Vector) -> tuple[Vector, int]:
        """The vector before a row, less its least entry, and that entry. ``after`` has a least entry of 0."""
        if (code, after) not in self.steps:
            base = [min(cost + after[to] for _, cost, to in self.options(code, s)) for s in range(4)]
            base[USER], base[ASSISTANT] = min(base[USER], 2 + base[ASSISTANT]), min(base[ASSISTANT], 2 + base[USER])
            base = [min(base[s], 2 + base[FOLLOWS[s]]) for s in range(4)]
            least = min(base)
            self.steps[code, after] = tuple(b - least for b in base), least
        return self.steps[code, after]

    def edit(self, code: int, after: Vector, state: int) -> tuple[str, int, int]:
        """The least cheapest edits from ``state`` up to and with the row's own, the state behind them, their cost."""
        key = (code, after, state)
        if key not in self.edits:
            vector, shift = self.before(code, after)
            at, spent, done = state, 0, ""
            while True:
                left = vector[at] + shift
                options = self.options(code, at)
                if options[0][1] + after[at] == left:
                    edit, cost, to = options[0]
                elif 2 + vector[FOLLOWS[at]] + shift == left:
                    at, spent, done = FOLLOWS[at], spent + 2, done + "I"
                    continue
                else:
                    edit, cost, to = next(o for o in options[1:] if o[1] + after[o[2]] == left)
                self.edits[key] = done + edit, to, spent + cost
                break
        return self.edits[key]


def normal(vector: Vector) -> Vector:
    return tuple(v - min(vector) for v in vector)


def backwards(codes: bytes, end: Vector, costs: Costs) -> list[Vector]:
    """The vectors, up to constants, behind each row, and before the first as the last of the list: from the last row to the first."""
    now, out = normal(end), []
    for code in reversed(codes):
        out.append(now)
        now = costs.before(code, now)[0]
    return [*out, now]


def fixed_up(codes: bytes, old: Vector, new: Vector, start: Vector, costs: Costs) -> Vector:
    """The vector before a chunk whose end vector turned from ``old``, with which ``start`` was found, into ``new``. Stops where both are equal up to a constant."""
    was, now = normal(old), normal(new)
    for code in reversed(codes):
        if was == now:
            return start
        was, now = costs.before(code, was)[0], costs.before(code, now)[0]
    return now


def trace(codes: bytes, end: Vector, state: int, costs: Costs) -> tuple[list[str], int, int]:
    """The edits of each row from ``state``, the state behind them, and their cost."""
    behind, pieces, total = backwards(codes, end, costs), [], 0
    for k, code in enumerate(codes):
        piece, state, cost = costs.edit(code, behind[len(codes) - 1 - k], state)
        pieces.append(piece)
        total += cost
    return pieces, state, total


@dataclass
class Repair:
    """``rows``: pos, conv, turn, role, text as they came, in order of ``pos``. ``chunks``: conv, block, at (first pos), codes, pieces (edits of each row), tail, cost and turns (least, most, distinct)."""

    rows: DataFrame
    chunks: DataFrame
    bits: int

    def turns(self) -> DataFrame:
        """The repaired conversations: conv, pos (of the row, in order), sub (of several turns at a row), edit, role, text."""
        chunk = self.chunks.select("conv", "block", F.col("at").alias("pos"), F.lit(0).alias("kind"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), "pieces", "tail", "entry")
        row = self.rows.select("conv", _block(self.bits).alias("block"), "pos", F.lit(1).alias("kind"), "role", "text", *[F.lit(None).cast(chunk.schema[c].dataType).alias(c) for c in ("pieces", "tail", "entry")])
        dealt = chunk.unionByName(row).repartition("conv", "block").sortWithinPartitions("block", "conv", "pos", "kind")
        kind = chunk.schema["conv"].dataType.simpleString()
        return dealt.mapInArrow(_applied, f"conv {kind}, pos long, sub int, edit string, role string, text string")

    def audits(self) -> DataFrame:
        """Per conversation with rows: conv, cost, n_edits. (The edits themselves are the chunks' pieces and tails, in order of ``at``.)"""
        n = F.aggregate("pieces", F.lit(0).cast("long"), lambda a, p: a + F.length(p)) + F.length("tail")
        return self.chunks.groupBy("conv").agg(F.sum("cost").alias("cost"), F.sum(n).alias("n_edits"))


def _block(bits: int) -> Column:
    return F.shiftright("pos", bits)


def _applied(batches):
    """Carries out the edits of chunks; each chunk's record comes before its rows."""
    pieces, tail, state, at = [], "", START, 0
    for batch in batches:
        out: list[list] = [[], [], [], [], [], []]
        conv_of = []
        for i, (pos, kind, role, text, p, t, e) in enumerate(zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("pos", "kind", "role", "text", "pieces", "tail", "entry")))):
            if kind == 0:
                pieces, tail, state, at = p, t, e, 0
                continue
            edits = pieces[at] + (tail if at == len(pieces) - 1 else "")
            at += 1
            for sub, edit in enumerate(edits):
                if edit == "D":
                    continue
                if edit == "K":
                    state = KEPT[state, "sua".find(role[:1])]
                    own = role, text
                else:
                    state = FOLLOWS[state]
                    own = ("assistant" if state == ASSISTANT else "user"), (text if edit == "R" else "")
                conv_of.append(i)
                for column, value in zip(out[1:], (pos, sub, edit, *own)):
                    column.append(value)
        conv = batch.column(batch.schema.get_field_index("conv")).take(pa.array(conv_of, pa.int64()))
        kinds = (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([conv, *[pa.array(c, k) for c, k in zip(out[1:], kinds)]], ["conv", "pos", "sub", "edit", "role", "text"])


_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string())}


def _mapped(df: DataFrame, f, schema: str) -> DataFrame:
    """``f(row, costs)`` gives the values of ``schema``, which follow conv and block; one table of costs a task."""
    fields = [tuple(c.split()) for c in schema.split(", ")]

    def run(batches):
        costs = Costs()
        for batch in batches:
            if batch.num_rows:
                own = [batch.column(batch.schema.get_field_index(c)) for c in ("conv", "block")]
                found = zip(*(f(row, costs) for row in batch.drop_columns(["conv"]).to_pylist()))
                yield pa.RecordBatch.from_arrays([*own, *[pa.array(v, _ARROW[t]) for v, (_, t) in zip(found, fields)]], ["conv", "block", *[n for n, _ in fields]])

    return df.mapInArrow(run, f"conv {df.schema['conv'].dataType.simpleString()}, block long, {schema}")


def _with(left: DataFrame, right: DataFrame, *columns: str) -> DataFrame:
    """``left`` with ``columns`` of ``right``, by conversation and block."""
    other = right.select(F.col("conv").alias("c"), F.col("block").alias("b"), *columns)
    return left.join(other, F.col("conv").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b"))).drop("c", "b")


def repair(rows: DataFrame, bits: int = CHUNK_BITS) -> Repair:
    """The repair of ``rows`` (conv, turn, role, text)."""
    small_batches(rows.sparkSession)
    scratch = Scratch()
    or_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = rows.select("conv", "turn", or_space("role"), or_space("text"))
    rows = rows.withColumn("digest", F.unhex(F.sha2(F.to_json(F.struct("conv", "role", "text")), 256)))
    order = ["conv", "turn", "role", "digest"]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("pos", F.monotonically_increasing_id())
    initial = F.when(F.col("role").startswith("s"), 0).when(F.col("role").startswith("u"), 1).when(F.col("role").startswith("a"), 2).otherwise(3)
    placed = stored(placed.withColumn("initial", initial).withColumn("fault", _faults(F.col("text"))), "turns")

    # rows of a conversation with the role and text of an earlier one
    first = placed.filter(F.col("fault") != BLANK).groupBy("digest").agg(F.min("pos").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first")
    coded = placed.select("conv", "turn", "pos", "initial", "fault", "digest").join(first, "digest", "left")
    fault = F.when((F.col("fault") != BLANK) & (F.col("first") < F.col("pos")), DUPLICATE).otherwise(F.col("fault"))
    coded = coded.select("conv", "turn", "pos", (4 * F.col("initial") + fault).cast("int").alias("code"))
    chunks = coded.groupBy("conv", _block(bits).alias("block")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "code"))), lambda x: x["code"]).alias("codes"), F.min("pos").alias("at"),
        F.min("turn").alias("lo"), F.max("turn").alias("hi"), F.size(F.collect_set("turn")).alias("n_turns"),
    )
    beside = lambda f: F.expr(f"{f}(block) OVER (PARTITION BY conv ORDER BY block) IS NULL")
    chunks = scratch.stored(chunks.withColumn("last", beside("lead")).withColumn("alone", F.col("last") & beside("lag")), "chunks")

    speculative = lambda row, costs: (AT_END, backwards(row["codes"], AT_END, costs)[-1])
    again = lambda row, costs: (row["due"], fixed_up(row["codes"], tuple(row["end"]), tuple(row["due"]), tuple(row["start"]), costs))
    shape, pair = lambda c: F.transform(c, lambda x: x - F.array_min(c)), "end array<int>, start array<int>"
    vectors = scratch.stored(_mapped(chunks.select("conv", "block", "codes"), speculative, pair), "vectors")
    while True:
        due = vectors.withColumn("due", F.coalesce(F.expr("lead(start) OVER (PARTITION BY conv ORDER BY block)"), "end"))
        due = scratch.stored(due.withColumn("stale", shape(F.col("due")) != shape(F.col("end"))), "vectors-due")
        if not due.filter("stale").take(1):
            break
        rerun = _mapped(_with(due.filter("stale"), chunks, "codes"), again, pair)
        vectors = scratch.stored(due.filter("NOT stale").select(*vectors.columns).unionByName(rerun), "vectors")
    full = scratch.stored(_with(chunks.select("conv", "block", "codes", "last", "alone"), vectors, "end"), "vectors-true")

    exits = lambda row, costs: ([START] * 4 if row["last"] else [trace(row["codes"], tuple(row["end"]), s, costs)[1] for s in range(4)],)
    entries = _mapped(full.filter("NOT alone"), exits, "exits array<int>").groupBy("conv").applyInArrow(_entered, f"conv {rows.schema['conv'].dataType.simpleString()}, block long, entry int")
    entries = entries.unionByName(full.filter("alone").select("conv", "block", F.lit(START).alias("entry")))

    def traced(row, costs):
        pieces, state, cost = trace(row["codes"], tuple(row["end"]), row["entry"], costs)
        tail = "I" * (AT_END[state] // 2) if row["last"] else ""
        return pieces, tail, cost + 2 * len(tail), row["entry"]

    edits = _mapped(_with(full, entries, "entry"), traced, "pieces array<string>, tail string, cost long, entry int")
    done = stored(_with(chunks.drop("last", "alone"), edits, "pieces", "tail", "cost", "entry"), "edits")
    scratch.clear()
    return Repair(placed.select("pos", "conv", "turn", "role", "text"), done, bits)


def _entered(table: pa.Table) -> pa.Table:
    """The state in which each chunk of a conversation is entered, from where each state leads."""
    table = table.sort_by("block")
    state, entry = START, []
    for exits in table.column("exits").to_pylist():
        entry.append(state)
        state = exits[state]
    return pa.table({"conv": table.column("conv"), "block": table.column("block"), "entry": pa.array(entry, pa.int32())})


def report(fixed: Repair, every: DataFrame) -> DataFrame:
    """Per conversation of ``every`` (conv): gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256. Without rows: zeros, an empty audit and the hash of nothing."""
    none = lambda *names: [F.lit(None).cast(t).alias(n) for n, t in names]
    of_chunk = [(n, fixed.chunks.schema[n].dataType) for n in ("codes", "pieces", "tail", "cost", "lo", "hi", "n_turns")]
    of_turn = [("role", "string"), ("text", "string")]
    base = every.select("conv").distinct().select("conv", F.lit(-1).cast("long").alias("pos"), F.lit(0).alias("kind"), F.lit(0).alias("sub"), *none(*of_chunk, *of_turn))
    chunk = fixed.chunks.select("conv", F.col("at").alias("pos"), F.lit(1).alias("kind"), F.lit(0).alias("sub"), *[n for n, _ in of_chunk], *none(*of_turn))
    turn = fixed.turns().select("conv", "pos", F.lit(2).alias("kind"), "sub", *none(*of_chunk), "role", "text")
    dealt = base.unionByName(chunk).unionByName(turn).repartition("conv").sortWithinPartitions("conv", "pos", "kind", "sub")
    kind = every.schema["conv"].dataType.simpleString()
    return dealt.mapInArrow(_reported, f"conv {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


class _Sums:
    """What is known of one conversation while its chunks and turns pass by."""

    def __init__(self):
        self.faults, self.illegal, self.cost = [0] * 4, 0, 0
        self.initial, self.lo, self.hi, self.n_turns = None, None, None, 0
        self.audit, self.hash, self.empty = [], hashlib.sha256(), True

    def chunk(self, x: dict) -> None:
        for code in x["codes"]:
            self.faults[code & 3] += 1
            if self.initial is not None and (self.initial, code >> 2) not in LEGAL:
                self.illegal += 1
            self.initial = code >> 2
        self.cost += x["cost"]
        self.audit += [*x["pieces"], x["tail"]]
        if x["lo"] is not None:
            self.n_turns += x["n_turns"] - (self.hi == x["lo"])
            self.lo, self.hi = x["lo"] if self.lo is None else self.lo, x["hi"]

    def turn(self, role: str, text: str) -> None:
        self.hash.update(("" if self.empty else "\n").encode() + f"{role}:{text}".encode())
        self.empty = False

    def values(self) -> tuple:
        gaps = 0 if self.lo is None else self.hi - self.lo + 1 - self.n_turns
        return gaps, self.faults[BLANK], self.faults[DUPLICATE], self.faults[TRUNCATED], self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest()


_FIELDS = [("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())]


def _reported(batches):
    def rows_of(conv, sums: list[_Sums]):
        columns = list(zip(*(s.values() for s in sums)))
        return pa.RecordBatch.from_arrays([conv, *[pa.array(c, t) for c, (_, t) in zip(columns, _FIELDS)]], ["conv", *[n for n, _ in _FIELDS]])

    sums = conv = None
    for batch in batches:
        ended, ends = [], []
        own = batch.column(batch.schema.get_field_index("conv"))
        rows = batch.to_pylist()
        for i, x in enumerate(rows):
            if x["kind"] == 0:  # every conversation begins with such a row
                if sums is not None:
                    ended.append(sums)
                    ends.append(conv)
                sums, conv = _Sums(), own.slice(i, 1)
            elif x["kind"] == 1:
                sums.chunk(x)
            else:
                sums.turn(x["role"], x["text"])
        if ended:
            yield rows_of(pa.concat_arrays(ends), ended)
    if sums is not None:
        yield rows_of(conv, [sums])
