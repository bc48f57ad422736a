"""Scan catalog, task records and settings as joins and roll-ups.

Status codes: -1 failed, 0 not started, 1 queued, 2 running, 3 done.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FAILED, NOT_STARTED, QUEUED, RUNNING, DONE = -1, 0, 1, 2, 3
#: Groups in which new records are numbered.
SLOTS = 1024
#: Steps that must be done in every entry before a step may start.
NEEDS = (("refine", "find"), ("transform", "refine"), ("combine", "transform"), ("pdf", "combine"))


def latest_task(tasks: DataFrame) -> DataFrame:
    """The newest record of each file, task, entry and subentry."""
    keys = ["file", "task", "entry", "subentry"]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("id")))
    return tasks.withColumn("rank", rank).filter("rank = 1").drop("rank")


def rolled_up(status: Column) -> Column:
    """One status of many: all done, else any failed, running, queued (running if any is done), done (running), else not started."""
    has = lambda s: F.bool_or(status == s)
    return (
        F.when(F.bool_and(status == DONE), DONE).when(has(FAILED), FAILED).when(has(RUNNING), RUNNING)
        .when(has(QUEUED), F.when(has(DONE), RUNNING).otherwise(QUEUED)).when(has(DONE), RUNNING).otherwise(NOT_STARTED)
    )


def task_status(tasks: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """(file, task, status) over the newest records. ``expected`` (file, task, entry): an entry without a record isn't started, a task without entries neither."""
    now = latest_task(tasks).select("file", "task", "entry", "status")
    if expected is not None:
        now = expected.select("file", "task", "entry").join(now, ["file", "task", "entry"], "left").withColumn("status", F.coalesce("status", F.lit(NOT_STARTED)))
    return now.groupBy("file", "task").agg(F.coalesce(rolled_up(F.col("status")), F.lit(NOT_STARTED)).alias("status"))


def subentry_status(tasks: DataFrame) -> DataFrame:
    return latest_task(tasks).groupBy("file", "task", "subentry").agg(rolled_up(F.col("status")).alias("status"))


def subentries(tasks: DataFrame) -> DataFrame:
    return tasks.filter(F.col("subentry").isNotNull() & (F.col("subentry") != "")).select("file", "subentry").distinct()


def catalog_status(finished: DataFrame) -> DataFrame:
    """(file, task, status) from (file, task, entry, done): no entry done 0, all 3, some 2."""
    n = F.sum(F.col("done").cast("int"))
    return finished.groupBy("file", "task").agg(F.when(n == 0, NOT_STARTED).when(n == F.count("*"), DONE).otherwise(RUNNING).alias("status"))


def record_task(tasks: DataFrame, new: DataFrame) -> DataFrame:
    """The records with ``new`` ones added under ids that go on from the highest; a record that is there already (same keys and times) isn't added again.

    Both may have further columns (machine, parameters, start and end times, process id); what one side lacks is null there.
    """
    keys = ["file", "task", "entry", "subentry", "queue_time"]
    fresh = new.join(tasks.select(*keys), [new[k].eqNullSafe(tasks[k]) for k in keys], "left_anti")
    return _appended(tasks, fresh, keys)


def _appended(tasks: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """``tasks`` and ``fresh`` records, which get ids that go on from the highest, in an order that hangs on their keys."""
    top = tasks.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    # numbered within slots, and the slots (a fixed number) by what lies before them
    slot = F.pmod(F.xxhash64(*keys), F.lit(SLOTS))
    placed = fresh.withColumn("slot", slot).withColumn("k", F.row_number().over(Window.partitionBy("slot").orderBy(*keys)))
    sizes = placed.groupBy("slot").agg(F.count("*").alias("own"))
    before = sizes.select("slot", (F.sum("own").over(Window.partitionBy(F.lit(1)).orderBy("slot")) - F.col("own")).alias("before"))
    numbered = placed.join(F.broadcast(before), "slot").withColumn("id", top + F.col("before") + F.col("k")).drop("slot", "k", "before")
    return tasks.unionByName(numbered, allowMissingColumns=True)


def finished_tasks(found: DataFrame) -> DataFrame:
    """(file, entry, subentry, task, queue_time, start_time, end_time, pid): one row for each task of which a file holds a record, at an entry or a subentry (else '').

    ``found`` (file, entry, subentry, task, workflow, ...): a record in the workflow group counts before one that stands in the entry itself; of several the one that ended last.
    """
    times = ["queue_time", "start_time", "end_time", "pid"]
    row = F.struct(*[F.col(c) if c in found.columns else F.lit(None).cast("int" if c == "pid" else "string").alias(c) for c in times])
    order = F.struct(F.coalesce("workflow", F.lit(False)), row["end_time"], row["start_time"], row["queue_time"], row["pid"])
    rows = found.filter("file IS NOT NULL AND entry IS NOT NULL AND task IS NOT NULL").withColumn("subentry", F.coalesce("subentry", F.lit("")))
    return rows.groupBy("file", "entry", "subentry", "task").agg(F.max_by(row, order).alias("r")).select("file", "entry", "subentry", "task", "r.*")


def sync_tasks(tasks: DataFrame, found: DataFrame) -> DataFrame:
    """``tasks`` with a record, done, of every task that a file says is finished (``finished_tasks``' input) and that has no record that is done. Times that a file lacks are null."""
    done = tasks.filter(F.col("status") == DONE).select("file", "task", "entry", F.coalesce("subentry", F.lit("")).alias("subentry")).distinct()
    missing = finished_tasks(found).join(done, ["file", "task", "entry", "subentry"], "left_anti")
    return _appended(tasks, missing.withColumn("status", F.lit(DONE)), ["file", "task", "entry", "subentry"])


def sync_status(found: DataFrame, entries: DataFrame, by_entry: list[str], by_file: list[str], root: str = "entry") -> DataFrame:
    """(file, task, status) of every file of ``entries`` (file, entry) from what the files say: tasks of ``by_entry`` count entry by entry, those of ``by_file`` once, at the root entry."""
    done = finished_tasks(found).filter("subentry = ''").select("file", "entry", "task", F.lit(True).alias("done"))
    names = lambda tasks: F.explode(F.array(*[F.lit(t) for t in tasks]) if tasks else F.array().cast("array<string>"))
    own = entries.select("file", "entry").distinct()
    single = own.withColumn("task", names(by_entry)).join(done, ["file", "entry", "task"], "left")
    whole = own.withColumn("task", names(by_file)).join(done.filter(F.col("entry") == root).drop("entry"), ["file", "task"], "left")
    rows = single.select("file", "task", "entry", "done").unionByName(whole.select("file", "task", "entry", "done"))
    return catalog_status(rows.withColumn("done", F.coalesce("done", F.lit(False))))


def new_scans(files: DataFrame, listed: DataFrame) -> DataFrame:
    """Scan files that name a parent which doesn't list them yet."""
    return files.filter(F.col("parent").isNotNull()).join(listed.select("parent", "scan"), ["parent", "scan"], "left_anti")


def stale_files(tracked: DataFrame, present: DataFrame) -> DataFrame:
    return tracked.join(present.select("file"), "file", "left_anti")


def pending_tasks(wanted: DataFrame, tasks: DataFrame, overwrite: bool = False, needs=NEEDS) -> DataFrame:
    """Wanted (file, task, entry) that aren't done, or all with ``overwrite``, and whose needs are done in all the file's entries."""
    done = latest_task(tasks).filter(F.col("status") == DONE).select("file", "task", "entry").distinct()
    todo = wanted if overwrite else wanted.join(done, ["file", "task", "entry"], "left_anti")
    entries = wanted.select("file", "entry").distinct()
    required = F.array(*[F.struct(F.lit(t).alias("task"), F.lit(n).alias("need")) for t, n in needs])
    asked = entries.select("file", "entry", F.explode(required).alias("r")).select("file", "entry", "r.*")
    blocked = asked.join(done.withColumnRenamed("task", "need"), ["file", "entry", "need"], "left_anti").select("file", "task").distinct()
    return todo.join(blocked, ["file", "task"], "left_anti")


def resolve_settings(wanted: DataFrame, settings: DataFrame) -> DataFrame:
    """(file, subentry, name, value): explicit, else parent; local values and defaults only where a file has no parent settings.

    Defaults have a null file. A null value doesn't count as set.
    """
    keys = ["file", "subentry", "name"]
    own = settings.filter("value IS NOT NULL AND file IS NOT NULL")
    scope = lambda s: own.filter(F.col("scope") == s).groupBy(*keys).agg(F.max("value").alias(s))
    default = settings.filter("value IS NOT NULL AND scope = 'default'").groupBy("name").agg(F.max("value").alias("fallback"))
    parents = settings.filter("scope = 'parent' AND file IS NOT NULL").select("file").distinct().withColumn("has_parent", F.lit(True))
    rows = wanted.select(*keys)
    for s in ("explicit", "parent", "local"):
        rows = rows.join(scope(s), keys, "left")
    rows = rows.join(F.broadcast(default), "name", "left").join(parents, "file", "left")
    alone = F.when(F.col("has_parent").isNull(), F.coalesce("local", "fallback")).otherwise(F.when(F.col("parent").isNull(), F.col("fallback")))
    return rows.select(*keys, F.coalesce("explicit", "parent", alone).alias("value"))


def inherit_parameters(own: DataFrame, other: DataFrame, names: list[str], key: str = "entry") -> DataFrame:
    """Null parameters of ``own`` taken from ``other``, row by key."""
    theirs = other.select(key, *[F.col(n).alias(f"{n}_other") for n in names])
    joined = own.join(theirs, key, "left")
    return joined.select(*[F.coalesce(c, f"{c}_other").alias(c) if c in names else F.col(c) for c in own.columns])


def find_group(wanted: DataFrame, values: DataFrame) -> DataFrame:
    """(file, entry, subentry, name, value): the subentry's value, else the entry's (subentry '')."""
    keys = ["file", "entry", "name"]
    sub = values.filter("subentry <> ''").select(*keys, "subentry", F.col("value").alias("from_sub"))
    main = values.filter("subentry = ''").select(*keys, F.col("value").alias("from_entry"))
    return wanted.join(sub, [*keys, "subentry"], "left").join(main, keys, "left").select("file", "entry", "subentry", "name", F.coalesce("from_sub", "from_entry").alias("value"))


def select_scans(scans: DataFrame, prefix: str) -> DataFrame:
    return scans.withColumn("selected", F.col("selected") | F.col("scan").startswith(prefix))


def natural_key(name: Column) -> Column:
    """Sort key of a scan name: text and numbers in turn, numbers by value, as an array of (text, number)."""
    numbers = F.transform(F.regexp_extract_all(name, F.lit(r"(\d+)")), lambda s: s.cast("long"))
    return F.transform(F.arrays_zip(F.split(name, r"\d+", -1).alias("text"), numbers.alias("number")), lambda x: F.struct(x["text"].alias("text"), F.coalesce(x["number"], F.lit(-1)).alias("number")))


def task_start(tasks: DataFrame, chosen: Column, now: Column, machine: Column | None = None, pid: Column | None = None) -> DataFrame:
    """Chosen records running from ``now``; a record without a queue time was queued then."""
    put = lambda c, v: F.when(chosen, v).otherwise(F.col(c) if c in tasks.columns else None).alias(c)
    changed = {"status": F.lit(RUNNING), "queue_time": F.coalesce("queue_time", now), "start_time": now, "end_time": F.lit(None).cast("string"), "machine": F.lit(None).cast("string") if machine is None else machine, "pid": F.lit(None).cast("int") if pid is None else pid}
    return tasks.select(*[F.col(c) for c in tasks.columns if c not in changed], *[put(c, v) for c, v in changed.items()])


def task_end(tasks: DataFrame, chosen: Column, now: Column, failed: Column | None = None) -> DataFrame:
    """Chosen records that run are done at ``now``, or failed; others stay as they are."""
    own = chosen & (F.col("status") == RUNNING)
    status = F.lit(DONE) if failed is None else F.when(failed, FAILED).otherwise(DONE)
    return tasks.withColumns({"end_time": F.when(own, now).otherwise(F.col("end_time")), "status": F.when(own, status).otherwise(F.col("status"))})


def update_settings(settings: DataFrame, changes: DataFrame) -> DataFrame:
    """``settings`` with the values of ``changes`` (scope, file, subentry, name, value) written over them or added; null values change nothing. Of several changes the greatest value holds."""
    keys = ["scope", "file", "subentry", "name"]
    new = changes.filter("value IS NOT NULL").groupBy(*keys).agg(F.max("value").alias("value"))
    kept = settings.join(new, [settings[k].eqNullSafe(new[k]) for k in keys], "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def scan_files(paths: DataFrame) -> DataFrame:
    """(path, scan, parent) of listed files that are scans: ``*.nxs`` apart from task, mask and parent files."""
    name = F.regexp_extract("path", r"([^/]+)\.nxs$", 1)
    named = paths.withColumn("scan", name).filter((F.col("scan") != "") & ~F.col("scan").rlike(r"(scans|mask|parent)"))
    return named.select("path", "scan", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("parent"))


def scan_stack(scans: DataFrame, data: DataFrame) -> DataFrame:
    """The rows of ``data`` (scan, ...) of selected scans, with their scan value, in its order."""
    chosen = scans.filter("selected").select("scan", "scan_value")
    return data.join(chosen, "scan").orderBy("scan_value", "scan")
