"""The text operators against brute force, their libraries and their defined cases."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reciprospark.llm import binary, bytewords, chunks, components, decontaminate, minhash, quality, rollups, rules, spm, tokens, toxicity

SPACE = re.compile(r"[\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return [w for w in SPACE.split(text or "") if w]


def docs(spark, texts, start=0):
    return spark.createDataFrame([(start + i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOCS)


ODD = [None, "", "   \n\t", "one", "a b c a b c a b c", "x\n\nx\nx ", "é ß\u3000ü  ▁▁ <|endoftext|> </s>", "word " * 30_000, "#*$ %&|<>!!! " * 9]


def test_rules_against_brute_force(spark):
    rng = np.random.default_rng(0)
    texts = ODD + [" ".join(rng.choice(["the", "of", "cat", "dog", "a\nb", "#", "!!"], rng.integers(1, 150))) for _ in range(60)]
    got = {r.doc_id: r for r in rules.quality_rules(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        w, r = words(t), got[i]
        tri = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        covered = {k + d for k in range(len(w) - 2) if tri[tuple(w[k : k + 3])] > 1 for d in range(3)}
        lines = [x for x in (t or "").split("\n") if words(x)]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
    kept = rules.keep_good(docs(spark, texts).withColumn("words", F.lit(1)).withColumn("kept", F.lit("x")))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars", "words", "kept"]
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}
    assert rules.quality_rules(docs(spark, ["x"]).filter("false")).count() == 0


def sets_of(text):
    w = words((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def test_near_duplicates_against_all_pairs(spark):
    rng = np.random.default_rng(1)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [None, "", "A b", "a B", "a c"]
    for _ in range(6):
        base = list(rng.choice(vocabulary, 220))
        for k in range(8):  # copies with more and more changes, linked in chains
            own = base.copy()
            for _ in range(k):
                own[rng.integers(len(own))] = "new"
            texts.append(" ".join(own))
            base = own if k % 2 else base
        texts.append(texts[-1])
    found = {r.doc_id: r for r in minhash.near_duplicates(docs(spark, texts), percent=85).collect()}
    sets = [sets_of(t) for t in texts]
    least = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            for j in range(i):
                if a and sets[j] and 100 * len(a & sets[j]) >= 85 * len(a | sets[j]):
                    least[i] = least[j] = min(least[i], least[j])
    assert [found[i].component_id for i in range(len(texts))] == least
    assert [found[i].n_shingles for i in range(len(texts))] == [len(s) for s in sets]
    kept = minhash.drop_copies(docs(spark, texts), percent=85)
    assert {r.doc_id for r in kept.collect()} == {i for i, c in enumerate(least) if c == i} and kept.columns[0] == "doc_id"


def test_near_duplicates_of_empty_tables_and_repeated_rows(spark):
    assert minhash.near_duplicates(docs(spark, ["x"]).filter("false")).count() == 0
    twice = docs(spark, ["a b c d e f"]).unionByName(docs(spark, ["a b c d e f"])).unionByName(docs(spark, ["z"], 7))
    assert {(r.doc_id, r.component_id) for r in minhash.near_duplicates(twice).collect()} == {(0, 0), (7, 7)}
    assert sorted(r.doc_id for r in minhash.drop_copies(twice).collect()) == [0, 7]


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(100, 101), (5, 5)]
    got = {r.u: r.v for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {100 + i: 100 for i in range(1, 30)}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=60), st.text(alphabet=" \n\t'sabAZé,.1#<|endoftext>\u3000\xa0\x85—", max_size=80)), min_size=1, max_size=5))
def test_tokens_match_the_library(texts):
    model = tokens.opened(public_tokenizers.path("byte_bpe_50k.json"))
    assert model.encode(texts) == [e.ids for e in model.library.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("abe tion ▁\n\té世'"), st.characters(codec="utf-8")), max_size=80), min_size=1, max_size=4))
def test_prefix_table_matches_the_library(texts):
    model = spm.opened(public_tokenizers.path("piece_bpe_32k.model"))
    ids, n = model.ids(texts)
    want = [model.library.encode(t) for t in texts]
    assert ids.tolist() == sum(want, []) and n.tolist() == [len(w) for w in want]
    raw, n_bytes = model.decode(ids, n)
    assert [t.encode() for t in model.library.decode(want)] == [raw[e - k : e].tobytes() for e, k in zip(np.cumsum(n_bytes), n_bytes)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 400), max_size=12), min_size=1, max_size=4))
def test_decoding_of_any_ids_matches_the_library(rows):
    model = spm.opened(public_tokenizers.path("piece_bpe_32k.model"))
    raw, n_bytes = model.decode(np.array(sum(rows, []), np.int32), np.array([len(r) for r in rows]))
    assert [model.library.decode(r).encode() for r in rows] == [raw[e - k : e].tobytes() for e, k in zip(np.cumsum(n_bytes), n_bytes)]


def test_a_full_table_starts_anew(monkeypatch):
    monkeypatch.setattr(chunks, "PLACES", 64)
    model = tokens.ChunkEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [" ".join(f"word{i * j}" for i in range(40)) for j in range(30)]
    for t in texts:
        assert model.encode([t, None, ""]) == [model.library.encode(t).ids, [], []]


def test_encode_decode_of_odd_texts(spark):
    model = spm.opened(public_tokenizers.path("piece_bpe_32k.model")).library
    got = {r.doc_id: r for r in spm.digests(spm.encode_decode(docs(spark, ODD), public_tokenizers.path("piece_bpe_32k.model"))).collect()}
    for i, t in enumerate(ODD):
        ids = model.encode(t or "")
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert got[i].decoded_sha256 == hashlib.sha256(model.decode(ids).encode()).hexdigest()


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_planes_round_trip(kind):
    for width, top in ((2, 1 << 16), (4, 1 << 32)):
        ids = np.random.default_rng(3).integers(0, top, 1003, dtype=np.uint64)
        assert np.array_equal(binary.from_planes(binary.to_planes(ids, width, kind), len(ids), width, kind), ids)


def test_token_files_round_trip(spark, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ODD + [f"text {i} " * (i % 50) for i in range(200)]
    for planes in ("byte", "bit"):
        out = str(tmp_path / planes)
        binary.write_ids(docs(spark, texts).orderBy(F.desc("doc_id")), out, path, 2, block=256, planes=planes)
        at = 0
        for i, r in enumerate(binary.read_ids(spark, out).orderBy("doc_id").collect()):
            ids = tokens.opened(path).library.encode(texts[i] or "", add_special_tokens=False).ids + [2]
            assert (r.doc_id, r.start) == (i, at) and zlib.crc32(r.ids) == zlib.crc32(np.array(ids, "<u4").tobytes())
            at += len(ids)
    empty = str(tmp_path / "empty")
    binary.write_ids(docs(spark, ["x"]).filter("false"), empty, path, 2)
    assert binary.read_ids(spark, empty).count() == 0


CHANGES = "op string, doc_id long, tokenizer string, source string, lang string, n_tokens long"


def test_rollups(spark, tmp_path):
    store = rollups.RollupStore(spark, str(tmp_path / "r"))
    rows = lambda *r: spark.createDataFrame(list(r), CHANGES)
    first = rows(("insert", 1, "t", "a", "en", 5), ("insert", 1, "t", "a", "en", 5), ("insert", 2, "t", "a", None, 7), ("insert", 3, "t", "b", "de", 1), (None, 4, "t", "b", "de", 1), ("delete", 9, "t", "b", "de", 1))
    assert store.commit("9", first) and not store.commit("9", first)
    second = rows(("delete", 3, "t", "b", "de", 0), ("revise", 2, "t", "a", "fr", 9), ("revise", 8, "t", "a", "fr", 9), ("insert", 1, "u", "a", "en", 4), ("insert", None, "u", "a", "en", 4))
    assert store.commit("10", second) and not store.commit("10", second)
    got = {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in store.totals().collect()}
    assert got == {("a", "en", "t"): (1, 5), ("a", "fr", "t"): (1, 9), ("a", "en", "u"): (1, 4)}
    assert store.commit("3", second.filter("false")) and store.batches() == ["9", "10", "3"]
    with pytest.raises(ValueError):
        store.commit("a/b", second)


def test_rollups_of_random_changes_against_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(rollups, "COMPACT_AFTER", 2)
    rng = np.random.default_rng(12)
    store, state = rollups.RollupStore(spark, str(tmp_path / "r"), id_type="string"), {}
    order = {"delete": 0, "insert": 1, "revise": 2}
    for batch in range(6):
        rows = []
        for _ in range(30):
            source, lang = [(None, "x", "y")[k] for k in rng.integers(0, 3, 2)]
            rows.append((str(rng.choice(list(order))), f"d{rng.integers(12)}", str(rng.choice(["t", "u"])), source, lang, int(rng.integers(0, 9))))
        last = {}
        key = lambda r: (order[r[0]], r[5], r[3] or "", r[4] or "")
        for r in rows:
            if r[1:3] not in last or key(r) > key(last[r[1:3]]):
                last[r[1:3]] = r
        for name, (op, _, _, source, lang, n) in last.items():
            if op == "delete":
                state.pop(name, None)
            elif op == "insert" or name in state:
                state[name] = (source, lang, n)
        changes = spark.createDataFrame(rows, CHANGES.replace("doc_id long", "doc_id string"))
        if batch == 4:  # one that was cut off before its deltas were whole
            changes.write.parquet(str(tmp_path / "r" / "ledger" / f"{batch + 1:09d}-{batch}"))
        assert store.commit(str(batch), changes) and not store.commit(str(batch), changes)
        want = Counter()
        for (_, version), (source, lang, n) in state.items():
            want[source, lang, version] += n
            want[source, lang, version, "docs"] += 1
        got = Counter()
        for r in store.totals().collect():
            got[r.source, r.lang, r.tokenizer] += r.n_tokens
            got[r.source, r.lang, r.tokenizer, "docs"] += r.n_docs
        assert +got == +want


def test_counts_of_texts_with_and_without_symbols(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = tokens.opened(path).library
    table = docs(spark, ODD).withColumn("tokenizer", F.lit(1)).withColumn("n_tokens", F.lit("x")).withColumn("op", F.lit(0))
    got = {r.doc_id: (r.n_tokens, r.n_plain) for r in rollups.counted(table, {"v": path}, without={"plain": rules.SYMBOLS}).collect()}
    for i, t in enumerate(ODD):
        assert got[i] == tuple(len(library.encode(x, add_special_tokens=False).ids) for x in (t or "", re.sub(rules.SYMBOLS, "", t or "")))
    assert rollups.counted(table.filter("false"), {"v": path}).count() == 0


ITEMS = [(k, " ".join(f"q{k}x{i}" for i in range(30)) + ". " + " ".join(f"a{k}x{i}" for i in range(8)) + ".") for k in range(40)] + [(90, None), (91, ""), (92, "Single sentence of some words that stands alone here")]


def test_decontamination_against_brute_force(spark):
    rng = np.random.default_rng(5)
    filler = lambda n: " ".join(rng.choice([f"f{i}" for i in range(300)], n))
    texts = [None, "", filler(500), filler(100) + " " + ITEMS[3][1] + " " + filler(300), ITEMS[7][1].upper(), filler(900) + " " + ITEMS[11][1] + " " + ITEMS[12][1], " ".join(ITEMS[5][1].split()[:12]) + filler(50), filler(20) + " " + ITEMS[9][1][: len(ITEMS[9][1]) // 2], ITEMS[42][1]]
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs(spark, texts), items).collect()}
    assert got == {(3, 3), (4, 7), (5, 11), (5, 12), (8, 92)}
    assert {r.doc_id for r in decontaminate.drop_leaking(docs(spark, texts), items).collect()} == {0, 1, 2, 6, 7}
    assert decontaminate.find_leaks(docs(spark, texts), items.filter("false")).count() == 0


def test_wand_finds_all_above_the_threshold():
    rng = np.random.default_rng(6)
    index = decontaminate.Index.of([(k, " ".join(rng.choice([f"w{i}" for i in range(80)], 20)), "") for k in range(100)])
    for _ in range(50):
        own = rng.choice(len(index.terms), 30, replace=False)
        scores = np.zeros(100)
        for t in own:
            scores[index.item[index.at[t] : index.at[t + 1]]] += index.impact[index.at[t] : index.at[t + 1]]
        for threshold in (0.3, 0.5, 0.7):
            assert {k for k, _ in index.wand(own, threshold)} == set(np.flatnonzero(scores >= threshold).tolist())


def test_classifiers(spark):
    rng = np.random.default_rng(7)
    plain = lambda n: " ".join(rng.choice(["house", "river", "stone", "cloud", "green", "walk", "light"], n))
    bad, unseen = ["gromple", "grompled", "gromplish"], ["grompler", "gromples"]
    texts, y = [], []
    for i in range(160):
        t = plain(40)
        if i % 3 == 0:
            t = f"{plain(10)} {bad[i % len(bad)]} {plain(20)} {bad[(i + 1) % len(bad)]}"
        texts.append(t)
        y.append(int(i % 3 == 0))
    own, labels = docs(spark, texts), spark.createDataFrame([(i, v, 1 - v) for i, v in enumerate(y)], "doc_id long, toxic int, quality int")
    model = toxicity.fitted(own, labels, trains=lambda i: i >= 0)
    fresh = docs(spark, [f"{plain(15)} {unseen[0]} {plain(8)} {unseen[1]}", plain(30), None, ""])
    s = [r.score for r in toxicity.scores(fresh, model).orderBy("doc_id").collect()]
    assert s[0] > 0.5 > s[1] and s[2] == s[3] < 0.5 and all(0 <= v <= 1 for v in s)
    assert [r.doc_id for r in toxicity.drop_toxic(fresh, model).orderBy("doc_id").collect()] == [1, 2, 3]
    none = toxicity.fitted(own, labels.filter("false"), trains=lambda i: i >= 0)
    assert max(r.score for r in toxicity.scores(fresh, none).collect()) < 0.01
    shout = docs(spark, [plain(40) if i % 2 else plain(40).upper().replace(" ", "!! ") for i in range(120)])
    marks = spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, quality int")
    vectors = quality.word_vectors(shout)
    network = quality.fitted(shout, marks, vectors, trains=lambda i: i % 3 != 1)
    right = [(r.score >= 0.5) == bool(r.doc_id % 2) for r in quality.scores(shout, vectors, network).collect() if r.doc_id % 3 == 1]
    assert np.mean(right) > 0.9
    assert {r.score for r in quality.scores(fresh, vectors, quality.fitted(shout, marks.filter("false"), vectors, trains=lambda i: i >= 0)).collect()} == {0.5}


def test_byte_words_match_python():
    texts = ODD + ["a", " b ", "c"]
    for part in bytewords.text_slices(pa.array(texts, pa.string()), limit=10):
        first, ends, bounds = bytewords.word_spans(part)
        for k in range(len(part.starts)):
            got = [bytes(part.data[a:b]).decode() for a, b in zip(first[bounds[k] : bounds[k + 1]], ends[bounds[k] : bounds[k + 1]])]
            assert got == words(texts[part.first + k])
