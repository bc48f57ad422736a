"""What a beamline supplies, put into the metadata that is there: whole groups are replaced, goniometer and sample are merged field by field.

Metadata is a table (file, entry, path, field, value): a value as text for each field of a group at a path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where each group that a beamline can supply is kept, and what happens to what is there.
REPLACED = {"logs": "instrument/logs", "source": "instrument/source", "attenuator": "instrument/attenuator", "monitor": "monitor"}
MERGED = {"filter_transmission": "instrument/filter", "goniometer": "instrument/goniometer", "sample": "sample"}
#: Groups of an older layout that go when a beamline's values are read.
STALE = ("monitor1", "monitor2")
#: The entry whose sample all entries share.
SHARED = "entry"
KEYS = ["file", "entry", "path", "field"]


def read_logs(current: DataFrame, supplied: DataFrame) -> DataFrame:
    """``current`` (file, entry, path, field, value) after a beamline's ``supplied`` (file, entry, group, field, value) for the entries that ``supplied`` names.

    logs, source, attenuator and monitor replace their group; of the filter the transmission alone is replaced; fields of goniometer and sample overwrite those of the same name and leave the others.
    The sample belongs to the entry that all share; an entry of its own without a sample gets a link to it. start_time (group and field of that name) becomes the
    entry's, and the start of its frame time where it has one. Groups that ``supplied`` lacks stay. A null value is nothing supplied; of repeated fields the greatest value holds.
    """
    place = F.create_map(*[F.lit(x) for pair in (REPLACED | MERGED).items() for x in pair])
    given = supplied.filter("value IS NOT NULL").groupBy("file", "entry", "group", "field").agg(F.max("value").alias("value"))
    new = given.filter(F.col("group").isin(*REPLACED, *MERGED)).select("file", F.when(F.col("group") == "sample", SHARED).otherwise(F.col("entry")).alias("entry"), place[F.col("group")].alias("path"), "field", "value", "group")
    new = new.filter((F.col("group") != "filter_transmission") | (F.col("field") == "transmission"))
    new = new.groupBy(*KEYS, "group").agg(F.max("value").alias("value"))  # several entries may supply the shared sample
    start = given.filter("group = 'start_time' AND field = 'start_time'").select("file", "entry", "value")

    read = supplied.select("file", "entry").distinct()
    kept = current.join(read.withColumn("read", F.lit(True)), ["file", "entry"], "left").filter(F.col("read").isNull() | ~F.col("path").isin(*STALE)).drop("read")
    kept = kept.join(new.filter(F.col("group").isin(*REPLACED)).select("file", "entry", "path").distinct(), ["file", "entry", "path"], "left_anti")
    times = start.select("file", "entry", F.lit("").alias("path"), F.lit("start_time").alias("field"), "value")
    has_time = kept.filter("path = 'data/frame_time'").select("file", "entry").distinct()
    times = times.unionByName(start.join(has_time, ["file", "entry"]).select("file", "entry", F.lit("data/frame_time").alias("path"), F.lit("start").alias("field"), "value"))
    linked = given.filter("group = 'sample'").select("file", "entry").distinct().filter(F.col("entry") != SHARED)
    linked = linked.join(kept.filter("path = 'sample'").select("file", "entry").distinct(), ["file", "entry"], "left_anti")
    links = linked.select("file", "entry", F.lit("sample").alias("path"), F.lit("@target").alias("field"), F.lit(f"{SHARED}/sample").alias("value"))
    fresh = new.drop("group").unionByName(times).unionByName(links)
    return kept.join(fresh.select(*KEYS), KEYS, "left_anti").unionByName(fresh.select(*kept.columns))
