"""The registered queries of the library's operators, each with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reciprospark.functions import geometry as geo
from reciprospark.functions import scalars
from reciprospark.operators import bands, bravais, catalog, frames, lattice, masks, orient, pdf, peaks, volume
from reciprospark.plans import views
from reciprospark.plans.views import FRAMES_SQL, HITS3_SQL, HITS_GEOMETRY, HITS_SQL, LOG_SQL, TASKS_SQL
from reciprospark.sources import hooks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

ANNULUS = {"xc": 3.5, "yc": 3.5, "rmin": 1.0, "rmax": 4.0}
FIRST = 10
GRID = volume.Grid(-4.0, -4.0, -4.0, (4, 4, 4), (33, 33, 33))


def query(sql: str | None = None):
    """Registers a function under its name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _annulus(spark: SparkSession) -> DataFrame:
    pixels = spark.range(64).select(F.floor(F.col("id") / 8).cast("int").alias("y"), (F.col("id") % 8).cast("int").alias("x"))
    return pixels.filter(masks.in_annulus(F.col("x"), F.col("y"), **ANNULUS))


def _last(df: DataFrame) -> int:
    return frames.window_bounds(FIRST, None, (df.agg(F.max("frame")).first()[0] or 0) + 1)[1]


_WINDOW = "(SELECT frame FROM frames GROUP BY frame HAVING frame >= 10 AND frame < (SELECT max(frame) + 1 - 10 FROM frames))"
_IN = "((x - 3.5) * (x - 3.5) + (y - 3.5) * (y - 3.5)) BETWEEN 1 AND 16"
#: Three pixels that are stuck at 500, so that there is something to find.
_STUCK_SQL = FRAMES_SQL.replace("frames AS", "plain AS", 1) + ", frames AS (SELECT scan, frame, y, x, CASE WHEN y = x AND y % 3 = 0 THEN 500 ELSE counts END AS counts FROM plain)"
_HOT = """hot AS (SELECT y, x FROM frames WHERE frame BETWEEN 0 AND 9 GROUP BY y, x HAVING max(counts) * count(*) = sum(counts) AND max(counts) >= 100)"""


def _stuck(spark, d):
    return views.frames(spark, d).withColumn("counts", F.when((F.col("y") == F.col("x")) & (F.col("y") % 3 == 0), 500).otherwise(F.col("counts")).cast("long"))


# Frames and series


@query(f"WITH {FRAMES_SQL} SELECT scan, frame, y, x, counts FROM frames WHERE frame >= 10 AND frame < (SELECT max(frame) + 1 - 10 FROM frames)")
def frame_window(spark, d):
    return frames.frame_window(views.frames(spark, d), FIRST).select("scan", "frame", "y", "x", "counts")


@query(f"""WITH {LOG_SQL}, r AS (SELECT unnest(range((SELECT min(frame) FROM log), (SELECT max(frame) + 1 FROM log))) AS frame)
SELECT cast(r.frame AS INT) AS frame, round(r.frame * 0.1, 6) AS time, log.frame IS NOT NULL AS present FROM r LEFT JOIN log ON r.frame = log.frame""")
def link_frames(spark, d):
    return frames.link_frames(views.log(spark, d)).select("frame", F.round("time", 6).alias("time"), "present")


@query(f"WITH {HITS_SQL} SELECT y, x, cast(sum(counts) AS BIGINT) AS counts FROM hits WHERE frame >= 10 AND frame < 350 GROUP BY y, x")
def summed_data(spark, d):
    return frames.summed_data(frames.frame_window(views.hits(spark, d), FIRST, n_frames=360)).select("y", "x", "counts")


@query(f"WITH {_STUCK_SQL}, {_HOT} SELECT frame, cast(sum(counts) AS BIGINT) AS counts FROM frames ANTI JOIN hot USING (y, x) GROUP BY frame")
def summed_frames(spark, d):
    f = _stuck(spark, d)
    return frames.summed_frames(masks.apply_pixel_mask(f, masks.hot_pixels(f))).select("frame", "counts")


_PARTIAL = f"""partial AS (SELECT frame, sum(counts) * any_value(n) / any_value(keep) AS partial FROM
    (SELECT frame, counts, n, greatest(1, cast(floor(n * 9 / 10) AS BIGINT)) AS keep, row_number() OVER (PARTITION BY frame ORDER BY counts, y, x) AS k FROM
        (SELECT *, count(*) OVER (PARTITION BY frame) AS n FROM frames WHERE {_IN})) WHERE k <= keep GROUP BY frame)"""


@query(f"WITH {FRAMES_SQL}, {_PARTIAL} SELECT frame, round(partial, 6) AS partial FROM partial")
def partial_frames(spark, d):
    return frames.partial_frames(views.frames(spark, d), _annulus(spark)).select("frame", F.round("partial", 6).alias("partial"))


@query(f"WITH {FRAMES_SQL} SELECT max(counts) AS maximum FROM frames WHERE {_IN}")
def maximum(spark, d):
    f = views.frames(spark, d)
    return frames.maximum(f.filter(masks.in_annulus(F.col("x"), F.col("y"), **ANNULUS))).select("maximum")


_MEDIAN = """placed AS (SELECT frame, v, row_number() OVER (ORDER BY frame) - 1 AS i, count(*) OVER () AS n FROM series),
asked AS (SELECT frame, n, unnest(range(i - 15, i + 16)) AS j FROM placed),
turned AS (SELECT frame, CASE WHEN ((j % (2 * n)) + 2 * n) % (2 * n) < n THEN ((j % (2 * n)) + 2 * n) % (2 * n) ELSE 2 * n - 1 - ((j % (2 * n)) + 2 * n) % (2 * n) END AS i FROM asked),
filtered AS (SELECT t.frame, list_sort(list(p.v))[16] AS v FROM turned t JOIN placed p ON t.i = p.i GROUP BY t.frame)"""


@query(f"WITH {LOG_SQL}, series AS (SELECT frame, monitor AS v FROM log), {_MEDIAN} SELECT frame, v AS monitor FROM filtered")
def median_filter(spark, d):
    return frames.median_filter(views.log(spark, d), "monitor").select("frame", "monitor")


@query(f"""WITH {FRAMES_SQL}, {LOG_SQL}, {_PARTIAL}, ratio AS (SELECT p.frame, partial / nullif(monitor, 0) AS r FROM partial p JOIN log ON p.frame = log.frame),
lim AS (SELECT 10 AS lo, (SELECT max(frame) + 1 - 10 FROM frames) AS hi), ok AS (SELECT frame, CASE WHEN frame >= lo AND frame < hi THEN r END AS r FROM ratio, lim),
series AS (SELECT frame, v FROM (SELECT frame, coalesce(last_value(r IGNORE NULLS) OVER (ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    first_value(r IGNORE NULLS) OVER (ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS v FROM ok) WHERE v IS NOT NULL), {_MEDIAN}
SELECT frame, round(v / (SELECT median(v) FROM filtered), 6) AS transmission FROM filtered""")
def transmission(spark, d):
    f = views.frames(spark, d)
    partial = frames.partial_frames(f, _annulus(spark))
    return frames.transmission(partial, views.log(spark, d), FIRST, _last(f)).select("frame", F.round("transmission", 6).alias("transmission"))


@query(f"WITH {LOG_SQL} SELECT frame, CASE WHEN frame < 10 OR frame > 600 THEN 0.0 ELSE cast(monitor AS DOUBLE) * (1 - (1 - (n % 7) / 7.0)) END AS weight FROM log")
def frame_weights(spark, d):
    log = views.log(spark, d).withColumn("transmission", scalars.frame_transmission(1 - (F.col("n") % 7) / 7))
    return frames.frame_weights(log, 10, 600).select("frame", "weight")


_MONITOR = f"""{LOG_SQL}, o AS (SELECT frame, cast(monitor AS DOUBLE) AS v, row_number() OVER (ORDER BY frame) - 1 AS i, count(*) OVER () AS n FROM log),
e AS (SELECT frame, i, n, CASE WHEN n >= 3 AND i = 0 THEN lead(v) OVER w WHEN n >= 3 AND i = n - 1 THEN lag(v) OVER w ELSE v END / 1000.0 AS v FROM o WINDOW w AS (ORDER BY i)),
p AS (SELECT *, (width - 1) // 2 AS half FROM (SELECT *, CASE WHEN n > 1000 THEN 501 WHEN n > 200 THEN 101 ELSE n - 1 + n % 2 END AS width FROM e)),
c AS (SELECT frame, i, n, v, width, half, greatest(half, least(n - 1 - half, i)) AS mid FROM p),
s AS (SELECT c.frame, any_value(c.n) AS n, any_value(c.v) AS v, any_value(c.i - c.mid) AS x, cast(any_value(c.width) AS DOUBLE) AS s0, sum(cast(d.i - c.mid AS DOUBLE) ** 2) AS s2, sum(cast(d.i - c.mid AS DOUBLE) ** 4) AS s4,
    sum(d.v) AS b0, sum((d.i - c.mid) * d.v) AS b1, sum((d.i - c.mid) ** 2 * d.v) AS b2 FROM c JOIN p d ON d.i BETWEEN c.mid - c.half AND c.mid + c.half GROUP BY c.frame)"""


@query(f"""WITH {_MONITOR} SELECT frame, round(CASE WHEN n < 3 THEN v ELSE (s4 * b0 - s2 * b2) / (s0 * s4 - s2 * s2) + x * b1 / s2 + x * x * (s0 * b2 - s2 * b0) / (s0 * s4 - s2 * s2) END, 6) AS monitor FROM s""")
def smooth_monitor(spark, d):
    return frames.smooth_monitor(views.log(spark, d), 1000.0).select("frame", F.round("monitor", 6).alias("monitor"))


@query(f"WITH {HITS3_SQL} SELECT frame, y, x, cast(sum(counts) AS BIGINT) AS counts, count(*) AS n_scans FROM hits GROUP BY 1, 2, 3")
def sum_scans(spark, d):
    by_scan = views.hits(spark, d, with_entry=True).withColumnRenamed("entry", "scan").withColumn("entry", F.lit("f1"))
    return frames.sum_scans(by_scan).select("frame", "y", "x", "counts", "n_scans")


@query("""SELECT cast(date_diff('hour', timestamp '2024-01-01', ts) AS INT) % 24 AS frame, cast(sum(cast(round(value * 100) AS BIGINT)) AS BIGINT) AS monitor FROM events GROUP BY 1""")
def sum_monitors(spark, d):
    days = views.log(spark, d).withColumn("frame", F.col("frame") % 24)
    return frames.sum_monitors(days).select("frame", "monitor")


@query(f"""WITH {FRAMES_SQL}, n AS (SELECT *, lead(counts) OVER w AS next, lead(frame) OVER w AS next_frame FROM frames WINDOW w AS (PARTITION BY y, x ORDER BY frame))
SELECT frame, y, x, next - counts AS diff FROM n WHERE next_frame = frame + 1""")
def frame_diff(spark, d):
    return frames.frame_diff(views.frames(spark, d)).select("frame", "y", "x", "diff")


# Masks


@query(f"WITH {_STUCK_SQL}, {_HOT} SELECT y, x FROM hot")
def hot_pixels(spark, d):
    return masks.hot_pixels(_stuck(spark, d)).select("y", "x")


@query(f"WITH {FRAMES_SQL} SELECT frame, count(*) AS n, cast(sum(counts) AS BIGINT) AS counts FROM frames WHERE NOT {_IN} GROUP BY frame")
def annulus_mask(spark, d):
    return masks.annulus_mask(views.frames(spark, d), **ANNULUS).groupBy("frame").agg(F.count("*").alias("n"), F.sum("counts").alias("counts"))


@query(f"""WITH {HITS_SQL} SELECT DISTINCT y, x FROM hits WHERE (x >= 10 AND x < 15 AND y >= 20 AND y < 23) OR (x - 40) * (x - 40) + (y - 40) * (y - 40) < 30.25 OR counts < 3""")
def shape_mask(spark, d):
    shapes = [{"kind": "rectangle", "x": 10.7, "y": 20.2, "dx": 4.9, "dy": 3.0}, {"kind": "circle", "x": 40.9, "y": 40.1, "r": 5.5}]
    return masks.shape_mask(views.hits(spark, d).withColumn("counts", F.col("counts") - 3), shapes)


@query(f"WITH {FRAMES_SQL} SELECT frame, y, x, CASE WHEN {_IN} THEN counts ELSE 0 END AS counts FROM frames")
def apply_pixel_mask(spark, d):
    f = views.frames(spark, d)
    mask = masks.annulus_mask(f.select("y", "x").distinct(), **ANNULUS)
    return masks.apply_pixel_mask(f, mask, zero=True).select("frame", "y", "x", "counts")


def _bragg_sql(t1: float) -> str:
    """Boxes of 3 by 3 pixels whose border pixels are repeated outwards."""
    return f"""WITH {FRAMES_SQL}, lim AS (SELECT min(frame) AS lo, max(frame) AS hi FROM frames),
p AS (SELECT f.frame, y.i AS y, x.i AS x FROM (SELECT unnest(range((SELECT lo FROM lim), (SELECT hi + 1 FROM lim))) AS frame) f, range(8) y(i), range(8) x(i)),
c AS (SELECT p.frame, p.y, p.x, coalesce(f.counts, 0) AS counts FROM p LEFT JOIN frames f ON f.frame = p.frame AND f.y = p.y AND f.x = p.x),
d AS (SELECT a.frame, a.y, a.x, b.counts - a.counts AS d FROM c a JOIN c b ON b.frame = a.frame + 1 AND a.y = b.y AND a.x = b.x),
w AS (SELECT q.frame, q.y, q.x, greatest(0, least(7, q.y + dy)) AS py, greatest(0, least(7, q.x + dx)) AS px FROM d q, range(-1, 2) r(dy), range(-1, 2) s(dx)),
near AS (SELECT w.frame, w.y, w.x, CASE WHEN abs(sum(n.d)) >= 9 * {t1} THEN 1 ELSE 0 END AS v FROM w JOIN d n ON n.frame = w.frame AND n.y = w.py AND n.x = w.px GROUP BY 1, 2, 3),
wide AS (SELECT w.frame, w.y, w.x FROM w JOIN near n ON n.frame = w.frame AND n.y = w.py AND n.x = w.px GROUP BY 1, 2, 3 HAVING sum(n.v) > 9 * 0.5)
SELECT frame, cast(y AS INT) AS y, cast(x AS INT) AS x FROM wide UNION SELECT frame + 1, cast(y AS INT), cast(x AS INT) FROM wide"""


@query(_bragg_sql(40))
def bragg_mask(spark, d):
    return masks.bragg_mask(views.frames(spark, d), 8, 8, t1=40.0, h1=3, t2=0.5, h2=3).select("frame", "y", "x")


# Frames in bands


@query(f"WITH {FRAMES_SQL} SELECT frame, y, x, counts FROM frames")
def banded_frames(spark, d):
    """Long frames as bands of three rows and back."""
    return bands.to_frames(bands.to_bands(views.frames(spark, d), 8, 8, 3)).select("frame", "y", "x", "counts")


@query(ORACLE_SQL["summed_data"])
def banded_summed_data(spark, d):
    own = bands.to_bands(frames.frame_window(views.hits(spark, d), FIRST, n_frames=360), 64, 64, 24)
    return bands.to_frames(bands.summed_data(own)).select("y", "x", "counts")


@query(ORACLE_SQL["summed_frames"])
def banded_summed_frames(spark, d):
    f = _stuck(spark, d)
    return bands.summed_frames(bands.to_bands(f, 8, 8, 4), bands.mask_bits(masks.hot_pixels(f), 8, 8), (8, 8)).select("frame", "counts")


@query(ORACLE_SQL["frame_diff"])
def banded_frame_diff(spark, d):
    return bands.to_frames(bands.frame_diff(bands.to_bands(views.frames(spark, d).drop("scan"), 8, 8, 3))).select("frame", "y", "x", F.col("counts").alias("diff"))


@query(_bragg_sql(40.05))
def banded_bragg_mask(spark, d):
    found = bands.bragg_mask(bands.to_bands(views.frames(spark, d).drop("scan"), 8, 8, 3), 8, 8, t1=40.05, h1=3, t2=0.5, h2=3)
    return bands.mask_rows(found).select("frame", "y", "x")


@query()
def banded_hkl_histogram(spark, d):
    return bands.hkl_histogram(bands.to_bands(views.hits(spark, d), 64, 64, 16), HITS_GEOMETRY, GRID).select("il", "ik", "ih", "v", "n")


# Peaks


@query(f"""WITH {HITS_SQL} SELECT frame, y, x, counts FROM hits a WHERE counts > 60 AND y BETWEEN 2 AND 61 AND x BETWEEN 2 AND 61 AND NOT EXISTS
(SELECT 1 FROM hits b WHERE b.frame = a.frame AND b.counts > 60 AND abs(a.y - b.y) <= 2 AND abs(a.x - b.x) <= 2 AND
 (b.counts > a.counts OR (b.counts = a.counts AND (b.y < a.y OR (b.y = a.y AND b.x < a.x)))))""")
def local_maxima(spark, d):
    return peaks.local_maxima(views.hits(spark, d), 60, 2, 64, 64).select("frame", "y", "x", "counts")


@query()
def link_peaks(spark, d):
    return peaks.link_peaks(peaks.local_maxima(views.hits(spark, d), 60, 2, 64, 64), FIRST, 350)


@query(f"""WITH {HITS_SQL}, p AS (SELECT frame AS pz, y AS py, x AS px FROM hits WHERE counts > 90)
SELECT pz, py, px, cast(sum(counts) AS BIGINT) AS intensity, round(sum(counts * x) / sum(counts), 6) AS x, round(sum(counts * y) / sum(counts), 6) AS y, round(sum(counts * frame) / sum(counts), 6) AS z
FROM p JOIN hits ON frame >= pz - 3 AND frame < pz + 3 AND y >= py - 3 AND y < py + 3 AND x >= px - 3 AND x < px + 3 GROUP BY 1, 2, 3""")
def peak_moments(spark, d):
    h = views.hits(spark, d)
    found = peaks.peak_moments(h.filter("counts > 90").select("entry", F.col("frame").alias("z"), "y", "x"), h, 3)
    return found.select("pz", "py", "px", "intensity", *[F.round(c, 6).alias(c) for c in "xyz"])


@query()
def find_peaks(spark, d):
    return peaks.find_peaks(views.hits(spark, d), 60, 2, FIRST, 350, 64, 64)


_POLAR = "degrees(atan(sqrt((x - 31.5) * (x - 31.5) + (y - 31.5) * (y - 31.5)) * (0.5 / 100.0)))"


def _polar(df: DataFrame) -> DataFrame:
    return df.withColumn("polar", geo.polar(HITS_GEOMETRY, F.col("x"), F.col("y"))).withColumn("azimuth", geo.azimuth(HITS_GEOMETRY, F.col("x"), F.col("y")))


@query(f"WITH {HITS_SQL} SELECT frame, y, x, round({_POLAR}, 6) AS polar, round(degrees(atan2(0.5 * (x - 31.5), 0.5 * (y - 31.5))), 6) + 0 AS azimuth FROM hits")
def polar_azimuth(spark, d):
    rows = views.hits(spark, d)
    x, y = F.col("x"), F.col("y")
    return rows.select("frame", "y", "x", F.round(geo.polar(HITS_GEOMETRY, x, y), 6).alias("polar"), (F.round(geo.azimuth(HITS_GEOMETRY, x, y), 6) + 0).alias("azimuth"))


@query(f"WITH {HITS_SQL}, p AS (SELECT {_POLAR} AS polar FROM hits) SELECT round((SELECT polar FROM p ORDER BY polar LIMIT 1 OFFSET 200) + 0.1, 6) AS polar_max")
def polar_default(spark, d):
    return peaks.polar_default(_polar(views.hits(spark, d))).select(F.round("polar_max", 6).alias("polar_max"))


@query(f"WITH {HITS_SQL} SELECT frame, count(*) AS n FROM hits WHERE {_POLAR} <= 5.0 GROUP BY frame")
def polar_filter(spark, d):
    return peaks.polar_filter(_polar(views.hits(spark, d)), 5.0).groupBy("frame").agg(F.count("*").alias("n"))


# Catalog


_LATEST = "latest AS (SELECT * FROM tasks QUALIFY row_number() OVER (PARTITION BY file, task, entry, subentry ORDER BY id DESC) = 1)"
_ROLL = """CASE WHEN bool_and(status = 3) THEN 3 WHEN bool_or(status = -1) THEN -1 WHEN bool_or(status = 2) THEN 2
    WHEN bool_or(status = 1) THEN CASE WHEN bool_or(status = 3) THEN 2 ELSE 1 END WHEN bool_or(status = 3) THEN 2 ELSE 0 END"""


@query(f"WITH {TASKS_SQL}, {_LATEST} SELECT id, file, task, entry, status FROM latest")
def latest_task(spark, d):
    return catalog.latest_task(views.tasks(spark, d)).select("id", "file", "task", "entry", "status")


@query(f"WITH {TASKS_SQL}, {_LATEST} SELECT file, task, {_ROLL} AS status FROM latest GROUP BY 1, 2")
def task_status(spark, d):
    return catalog.task_status(views.tasks(spark, d))


_SUB = TASKS_SQL.replace("'' AS subentry", "CASE o_orderkey % 2 WHEN 0 THEN '' ELSE 'sub' END AS subentry")


def _sub(spark, d):
    return views.tasks(spark, d).withColumn("subentry", F.when(F.col("id") % 2 == 0, "").otherwise("sub"))


@query(f"WITH {_SUB}, {_LATEST} SELECT file, task, subentry, {_ROLL} AS status FROM latest GROUP BY 1, 2, 3")
def subentry_status(spark, d):
    return catalog.subentry_status(_sub(spark, d))


@query(f"WITH {_SUB} SELECT DISTINCT file, subentry FROM tasks WHERE subentry <> ''")
def subentries(spark, d):
    return catalog.subentries(_sub(spark, d))


@query(f"""WITH {TASKS_SQL}, {_LATEST} SELECT file, task, CASE sum(cast(status = 3 AS INT)) WHEN 0 THEN 0 WHEN count(*) THEN 3 ELSE 2 END AS status FROM latest GROUP BY 1, 2""")
def catalog_status(spark, d):
    return catalog.catalog_status(catalog.latest_task(views.tasks(spark, d)).select("file", "task", "entry", (F.col("status") == 3).alias("done")))


@query("""SELECT c_custkey AS file FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F' AND o_orderkey % 5 = 0)""")
def stale_files(spark, d):
    tracked = views.table(spark, d, "customer").select(F.col("c_custkey").alias("file"))
    return catalog.stale_files(tracked, views.tasks(spark, d).filter("status = 3 AND id % 5 = 0").select("file").distinct())


@query("""SELECT o_custkey AS parent, o_orderkey AS scan FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""")
def new_scans(spark, d):
    files = views.tasks(spark, d).select(F.col("file").alias("parent"), F.col("id").alias("scan"))
    returned = views.table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("scan")).distinct()
    return catalog.new_scans(files, files.join(returned, "scan", "left_semi"))


_STEPS = "CASE task WHEN '1-URGENT' THEN 'find' WHEN '2-HIGH' THEN 'refine' WHEN '3-MEDIUM' THEN 'transform' WHEN '4-NOT SPECIFIED' THEN 'combine' ELSE 'pdf' END"


def _steps(spark, d):
    names = {"1-URGENT": "find", "2-HIGH": "refine", "3-MEDIUM": "transform", "4-NOT SPECIFIED": "combine"}
    task = F.lit("pdf")
    for k, v in names.items():
        task = F.when(F.col("task") == k, v).otherwise(task)
    return views.tasks(spark, d).withColumn("task", task)


@query(f"""WITH {TASKS_SQL}, t AS (SELECT id, file, {_STEPS} AS task, entry, status FROM tasks),
now AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY file, task, entry ORDER BY id DESC) = 1), done AS (SELECT DISTINCT file, task, entry FROM now WHERE status = 3),
wanted AS (SELECT DISTINCT file, task, entry FROM t), entries AS (SELECT DISTINCT file, entry FROM wanted),
needs(task, need) AS (VALUES ('refine', 'find'), ('transform', 'refine'), ('combine', 'transform'), ('pdf', 'combine'))
SELECT w.file, w.task, w.entry FROM wanted w WHERE NOT EXISTS (SELECT 1 FROM done x WHERE x.file = w.file AND x.task = w.task AND x.entry = w.entry)
AND NOT EXISTS (SELECT 1 FROM needs n JOIN entries e ON e.file = w.file AND n.task = w.task LEFT JOIN done x ON x.file = e.file AND x.entry = e.entry AND x.task = n.need WHERE x.file IS NULL)""")
def pending_tasks(spark, d):
    t = _steps(spark, d)
    return catalog.pending_tasks(t.select("file", "task", "entry").distinct(), t).select("file", "task", "entry")


@query("""WITH o AS (SELECT o_custkey AS file, CASE o_orderkey % 4 WHEN 0 THEN 'explicit' WHEN 1 THEN 'parent' ELSE 'local' END AS scope, 'p' || (o_orderkey % 3) AS name, 'v' || (o_orderkey % 11) AS value FROM orders WHERE o_orderkey % 5 <> 0),
s AS (SELECT file, scope, name, max(value) AS value FROM o GROUP BY 1, 2, 3), w AS (SELECT c_custkey AS file, 'p' || i AS name FROM customer, range(3) t(i)), par AS (SELECT DISTINCT file FROM o WHERE scope = 'parent')
SELECT w.file, w.name, coalesce(e.value, p.value, CASE WHEN par.file IS NULL THEN coalesce(l.value, 'none') ELSE CASE WHEN p.value IS NULL THEN 'none' END END) AS value FROM w
LEFT JOIN s e ON e.file = w.file AND e.name = w.name AND e.scope = 'explicit' LEFT JOIN s p ON p.file = w.file AND p.name = w.name AND p.scope = 'parent'
LEFT JOIN s l ON l.file = w.file AND l.name = w.name AND l.scope = 'local' LEFT JOIN par ON par.file = w.file""")
def resolve_settings(spark, d):
    o = views.table(spark, d, "orders").filter("o_orderkey % 5 <> 0")
    scope = F.when(F.col("o_orderkey") % 4 == 0, "explicit").when(F.col("o_orderkey") % 4 == 1, "parent").otherwise("local")
    own = o.select(scope.alias("scope"), F.col("o_custkey").alias("file"), F.lit("").alias("subentry"), F.concat(F.lit("p"), F.col("o_orderkey") % 3).alias("name"), F.concat(F.lit("v"), F.col("o_orderkey") % 11).alias("value"))
    names = F.explode(F.array(*[F.lit(f"p{i}") for i in range(3)])).alias("name")
    wanted = views.table(spark, d, "customer").select(F.col("c_custkey").alias("file"), F.lit("").alias("subentry"), names)
    default = wanted.select("name").distinct().select(F.lit("default").alias("scope"), F.lit(None).cast("bigint").alias("file"), F.lit("").alias("subentry"), "name", F.lit("none").alias("value"))
    return catalog.resolve_settings(wanted, own.unionByName(default)).select("file", "name", "value")


@query("""SELECT s_suppkey AS entry, coalesce(CASE WHEN s_suppkey % 3 <> 0 THEN s_acctbal END, r.bal) AS bal, s_name AS name FROM supplier s LEFT JOIN (SELECT p_partkey, p_retailprice AS bal FROM part) r ON r.p_partkey = s_suppkey""")
def inherit_parameters(spark, d):
    own = views.table(spark, d, "supplier").select(F.col("s_suppkey").alias("entry"), F.when(F.col("s_suppkey") % 3 != 0, F.col("s_acctbal")).alias("bal"), F.col("s_name").alias("name"))
    other = views.table(spark, d, "part").select(F.col("p_partkey").alias("entry"), F.col("p_retailprice").alias("bal"))
    return catalog.inherit_parameters(own, other, ["bal"])


@query(f"""WITH {_SUB}, v AS (SELECT file, entry, subentry, max(id) AS value FROM tasks WHERE id % 4 <> 1 GROUP BY 1, 2, 3), w AS (SELECT DISTINCT file, entry, 'sub' AS subentry FROM tasks)
SELECT w.file, w.entry, coalesce(s.value, m.value, -1) AS value FROM w LEFT JOIN v s ON s.file = w.file AND s.entry = w.entry AND s.subentry = 'sub' LEFT JOIN v m ON m.file = w.file AND m.entry = w.entry AND m.subentry = ''""")
def find_group(spark, d):
    t = _sub(spark, d)
    values = t.filter("id % 4 <> 1").groupBy("file", "entry", "subentry").agg(F.max("id").alias("value")).withColumn("name", F.lit("n"))
    wanted = t.select("file", "entry", F.lit("sub").alias("subentry"), F.lit("n").alias("name")).distinct()
    return catalog.find_group(wanted, values).select("file", "entry", F.coalesce("value", F.lit(-1)).alias("value"))


@query("""SELECT o_orderkey AS scan, ('run_' || o_custkey) LIKE 'run\\_1%' ESCAPE '\\' OR o_orderstatus = 'F' AS selected FROM orders""")
def select_scans(spark, d):
    o = views.table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("run_"), F.col("o_custkey")).alias("scan"), (F.col("o_orderstatus") == "F").alias("selected"))
    return catalog.select_scans(o, "run_1").select(F.col("o_orderkey").alias("scan"), "selected")


@query(f"""WITH {TASKS_SQL} SELECT count(*) AS n, max(id) - (SELECT max(id) FROM tasks) AS added FROM
(SELECT id FROM tasks UNION ALL SELECT (SELECT max(id) FROM tasks) + row_number() OVER () FROM tasks WHERE status = -1)""")
def record_task(spark, d):
    t = views.tasks(spark, d).withColumn("queue_time", F.lit("2024-01-01"))
    again = t.filter("status = -1").withColumn("queue_time", F.concat(F.lit("2024-01-02 "), F.col("id").cast("string"))).drop("id")
    after = catalog.record_task(t, again.unionByName(t.filter("status = 3").drop("id")))
    top = t.agg(F.max("id")).first()[0]
    return after.agg(F.count("*").alias("n"), (F.max("id") - top).alias("added"))


_FOUND = """found AS (SELECT o_custkey AS file, o_orderkey % 3 AS entry, o_orderpriority AS task, o_orderkey % 2 = 0 AS workflow, CASE WHEN o_orderkey % 5 > 0 THEN cast(o_orderkey AS VARCHAR) END AS end_time FROM orders WHERE o_orderkey % 7 < 3)"""


def _found(spark, d):
    key = F.col("o_orderkey")
    rows = views.table(spark, d, "orders").filter(key % 7 < 3)
    return rows.select(F.col("o_custkey").alias("file"), (key % 3).alias("entry"), F.lit(None).cast("string").alias("subentry"), F.col("o_orderpriority").alias("task"), (key % 2 == 0).alias("workflow"), F.when(key % 5 > 0, key.cast("string")).alias("end_time"))


@query(f"""WITH {TASKS_SQL}, {_FOUND}, best AS (SELECT file, entry, task, end_time FROM found QUALIFY row_number() OVER (PARTITION BY file, entry, task ORDER BY workflow DESC, end_time DESC NULLS LAST) = 1)
SELECT file, entry, task, 3 AS status, end_time FROM best ANTI JOIN (SELECT file, entry, task FROM tasks WHERE status = 3) USING (file, entry, task)""")
def sync_tasks(spark, d):
    """The records that syncing adds."""
    t = views.tasks(spark, d).withColumn("queue_time", F.lit("2024-01-01"))
    top = t.agg(F.max("id")).first()[0]
    return catalog.sync_tasks(t, _found(spark, d)).filter(F.col("id") > top).select("file", "entry", "task", "status", "end_time")


@query(f"""WITH {TASKS_SQL}, {_FOUND}, e AS (SELECT DISTINCT file, entry FROM tasks), k AS (SELECT file, entry, t.task, whole FROM e, (VALUES ('1-URGENT', false), ('2-HIGH', false), ('5-LOW', true)) t(task, whole)),
f AS (SELECT DISTINCT file, entry, task FROM found), j AS (SELECT k.file, k.task, count(f.task) AS done, count(*) AS n FROM k LEFT JOIN f ON f.file = k.file AND f.task = k.task AND f.entry = CASE WHEN whole THEN 0 ELSE k.entry END GROUP BY 1, 2)
SELECT file, task, CASE done WHEN 0 THEN 0 WHEN n THEN 3 ELSE 2 END AS status FROM j""")
def sync_status(spark, d):
    return catalog.sync_status(_found(spark, d), views.tasks(spark, d), ["1-URGENT", "2-HIGH"], ["5-LOW"], root=0).select("file", "task", "status")


# Volumes


_G = f"""{HITS3_SQL}, p AS (SELECT *, 0.5 * (x - 31.5) AS dx, 0.5 * (y - 31.5) AS dy FROM hits), e AS (SELECT *, sqrt(10000 + dx * dx + dy * dy) * 0.5 AS norm, radians(frame - 180.0) AS phi FROM p),
g AS (SELECT *, cos(phi) * (100 / norm - 2) - sin(phi) * dx / norm AS qx, -cos(phi) * dx / norm - sin(phi) * (100 / norm - 2) AS qy, dy / norm AS qz FROM e),
m AS (SELECT *, 4 * qx AS h, 4 * qy AS k, 4 * qz AS l, sqrt(pow(4 * qx - round_even(4 * qx, 0), 2) + pow(4 * qy - round_even(4 * qy, 0), 2) + pow(4 * qz - round_even(4 * qz, 0), 2)) / 4 AS diff FROM g)"""
_G1 = _G.replace(HITS3_SQL, HITS_SQL)
_PLACED = """placed AS (SELECT cast(floor((l + 4) * 4 + 0.5) AS INT) AS il, cast(floor((k + 4) * 4 + 0.5) AS INT) AS ik, cast(floor((h + 4) * 4 + 0.5) AS INT) AS ih, counts FROM m)
SELECT il, ik, ih, cast(sum(counts) AS DOUBLE) AS v, cast(count(*) AS DOUBLE) AS n"""
_ON_GRID = "FROM placed WHERE il BETWEEN 0 AND 32 AND ik BETWEEN 0 AND 32 AND ih BETWEEN 0 AND 32 GROUP BY 1, 2, 3"


@query(f"WITH {_G1}, {_PLACED} {_ON_GRID}")
def hkl_histogram(spark, d):
    return volume.hkl_histogram(views.hits(spark, d), HITS_GEOMETRY, GRID).select("il", "ik", "ih", "v", "n")


ORACLE_SQL["banded_hkl_histogram"] = ORACLE_SQL["hkl_histogram"]


@query(f"WITH {_G}, {_PLACED}, round(cast(sum(counts) AS DOUBLE) / count(*), 6) AS signal {_ON_GRID}")
def combine(spark, d):
    by_entry = volume.hkl_histogram(views.hits(spark, d, with_entry=True), HITS_GEOMETRY, GRID)
    return volume.combine(by_entry).select("il", "ik", "ih", "v", "n", F.round("signal", 6).alias("signal"))


_VOX = """vox AS (SELECT l_partkey % 9 AS il, l_suppkey % 9 AS ik, l_orderkey % 9 AS ih, cast(sum(l_quantity) AS DOUBLE) AS v, cast(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY 1, 2, 3)"""


def _vox(spark, d):
    keys = [(F.col(c) % 9).cast("int").alias(n) for c, n in (("l_partkey", "il"), ("l_suppkey", "ik"), ("l_orderkey", "ih"))]
    return views.table(spark, d, "lineitem").groupBy(*keys).agg(F.sum("l_quantity").cast("double").alias("v"), F.count("*").cast("double").alias("n"))


def _images(laue: str) -> list[str]:
    """The images of (h, k, l) of each class as they are added up, each as three signed letters and its multiplicity."""
    four = ["hkl", "kHl", "HKl", "Khl", "hkL", "kHL", "HKL", "KhL"]
    eight = ["hkl", "Hkl", "hKl", "hkL", "HKl", "HkL", "hKL", "HKL"]
    swapped = ["khl", "Khl", "kHl", "khL", "KHl", "KhL", "kHL", "KHL"]
    turned = lambda images, order: ["".join(i[p] for p in order) for i in images]
    flat = eight + swapped
    return {
        "-1": ["hkl", "HKL"], "2/m": ["hkl", "hKl", "HkL", "HKL"], "mmm": eight, "4/m": four, "4/mmm": flat, "6/m": ["hkl", "hkL", "HKl", "HKL"],
        "m-3": ["hkl", "hkl", "klh", "lhk"], "m-3m": flat + flat + turned(flat, (1, 2, 0)) + turned(flat, (2, 0, 1)),
    }[laue]


def _symmetry_sql(laue: str) -> str:
    axis = lambda c: f"{'8 - ' if c.isupper() else ''}i{c.lower()}"
    images = " UNION ALL ".join(f"SELECT {axis(i[0])} AS ih, {axis(i[1])} AS ik, {axis(i[2])} AS il, v, n FROM vox" for i in _images(laue))
    return f"""WITH {_VOX}, every AS ({images}) SELECT cast(il AS INT) AS il, cast(ik AS INT) AS ik, cast(ih AS INT) AS ih, round(sum(v) / sum(n), 6) AS signal FROM every GROUP BY 1, 2, 3"""


_SMALL = volume.Grid(-4.0, -4.0, -4.0, (1, 1, 1), (9, 9, 9))


def _symmetrized(laue: str):
    def run(spark, d):
        return volume.symmetrize(_vox(spark, d), _SMALL, laue).select("il", "ik", "ih", F.round("signal", 6).alias("signal"))

    return run


for _laue, _name in (("-1", "1bar"), ("2/m", "2_m"), ("mmm", "mmm"), ("4/m", "4_m"), ("4/mmm", "4_mmm"), ("6/m", "6_m"), ("m-3", "m_3"), ("m-3m", "m_3m")):
    QUERIES[f"symmetrize_{_name}"] = _symmetrized(_laue)
    ORACLE_SQL[f"symmetrize_{_name}"] = _symmetry_sql(_laue)


@query(f"""WITH {HITS_SQL}, w AS (SELECT (degrees(atan(sqrt(2.0) * 31.5 * 0.005)) + 0.01) / 2048 AS step), p AS (SELECT {_POLAR} AS tt, 0.25 * (x - 31.5) * (x - 31.5) AS xx, 0.25 * (y - 31.5) * (y - 31.5) AS yy, counts FROM hits),
b AS (SELECT cast(floor(tt / step) AS INT) AS bin, sum(counts / (1 - xx / (10000 + xx + yy))) / sum(pow(cos(radians(tt)), 3)) AS intensity, any_value(step) AS step FROM p, w GROUP BY 1)
SELECT bin, round((bin + 0.5) * step, 6) AS two_theta, round(sin(radians((bin + 0.5) * step) / 2) * 4 * pi() / 0.5, 6) AS q, round(intensity, 6) AS intensity FROM b""")
def radial_sum(spark, d):
    return volume.radial_sum(views.hits(spark, d), HITS_GEOMETRY, geo.two_theta_max(HITS_GEOMETRY) + 0.01).select("bin", *[F.round(c, 6).alias(c) for c in ("two_theta", "q", "intensity")])


@query(f"""WITH {HITS_SQL} SELECT cast(floor({_POLAR} / (13.0 / 1024)) AS INT) AS ring, cast(floor((degrees(atan2(0.5 * (x - 31.5), 0.5 * (y - 31.5))) + 180) / (360.0 / 1024)) AS INT) AS sector,
round(avg(counts), 6) AS intensity FROM hits GROUP BY 1, 2""")
def cake(spark, d):
    return volume.cake(views.hits(spark, d), HITS_GEOMETRY, 13.0).select("ring", "sector", F.round("intensity", 6).alias("intensity"))


@query(f"WITH {_G1} SELECT round(sum(counts * diff) / sum(counts), 6) AS score FROM m")
def score(spark, d):
    rows = views.hits(spark, d)
    hkl = geo.pixel_to_hkl(HITS_GEOMETRY, F.col("x"), F.col("y"), F.col("frame"))
    return frames.score(rows, F.col("counts"), geo.hkl_diff(HITS_GEOMETRY, hkl)).select(F.round("score", 6).alias("score"))


@query(f"""WITH {_G1} SELECT frame, y, x, counts, round({_POLAR}, 6) AS polar, round(degrees(atan2(0.5 * (x - 31.5), 0.5 * (y - 31.5))), 6) + 0 AS azimuth,
round(h, 6) + 0 AS h, round(k, 6) + 0 AS k, round(l, 6) + 0 AS l, round(diff, 6) AS diff FROM m WHERE counts > 40 AND {_POLAR} <= 8.0 AND diff <= 0.05""")
def peak_table(spark, d):
    """Peaks with angles, hkl and their deviation, below a polar angle and within a tolerance."""
    rows = views.hits(spark, d).filter("counts > 40").withColumn("z", F.col("frame"))
    found = peaks.peak_table(rows, HITS_GEOMETRY, polar_max=8.0, tolerance=0.05)
    return found.select("frame", "y", "x", "counts", "polar", "azimuth", *"hkl", "diff").select("frame", "y", "x", "counts", F.round("polar", 6).alias("polar"), *[(F.round(c, 6) + 0).alias(c) for c in ("azimuth", "h", "k", "l")], F.round("diff", 6).alias("diff"))


@query("""WITH p AS (SELECT DISTINCT l_partkey % 9 - 4 AS h, l_suppkey % 7 - 3 AS k, l_linenumber - 4 AS l FROM lineitem)
SELECT h, k, l, h % 2 <> k % 2 AND abs(h + k) % 2 <> 0 AS c_absent, abs(h + k + l) % 2 <> 0 AS i_absent, abs(h + k) % 2 <> 0 OR abs(h + l) % 2 <> 0 OR abs(k + l) % 2 <> 0 AS f_absent, abs(-h + k + l) % 3 <> 0 AS r_absent FROM p""")
def absent(spark, d):
    rows = views.table(spark, d, "lineitem").select((F.col("l_partkey") % 9 - 4).alias("h"), (F.col("l_suppkey") % 7 - 3).alias("k"), (F.col("l_linenumber") - 4).alias("l")).distinct()
    h, k, l = (F.col(c) for c in "hkl")  # noqa: E741
    return rows.select("h", "k", "l", *[lattice.absent(h, k, l, c).alias(f"{c.lower()}_absent") for c in "CIFR"])


@query("""WITH p AS (SELECT DISTINCT p_size AS size FROM part), t AS (SELECT size, pow(10, floor(log10(size))) AS p FROM p)
SELECT cast(size AS INT) AS size, (SELECT v FROM (SELECT p * 1.0 AS v UNION ALL SELECT p * 2 UNION ALL SELECT p * 5 UNION ALL SELECT p * 10) ORDER BY abs(v - size), v LIMIT 1) AS step FROM t""")
def nearest_step(spark, d):
    return views.table(spark, d, "part").select(F.col("p_size").cast("int").alias("size")).distinct().withColumn("step", scalars.nearest_step(F.col("size").cast("double")))


@query("""SELECT s_suppkey, 'scan_' || CASE WHEN s_acctbal < 0 THEN 'm' ELSE '' END || replace(regexp_replace(cast(abs(cast(s_acctbal AS DECIMAL(12,2))) AS VARCHAR), '\\.?0+$', ''), '.', 'p') || 'K' AS label FROM supplier""")
def scan_label(spark, d):
    s = views.table(spark, d, "supplier")
    return s.select("s_suppkey", scalars.scan_label("scan_", F.col("s_acctbal").cast("decimal(12,2)").cast("double")).alias("label"))


_KEY = r"list_transform(list_zip(regexp_split_to_array({0}, '\d+'), regexp_extract_all({0}, '\d+')), lambda x: {{'text': x[1], 'number': coalesce(try_cast(nullif(x[2], '') AS BIGINT), -1)}})"


@query(f"""WITH n AS (SELECT o_orderkey AS id, (CASE o_custkey % 3 WHEN 0 THEN 'b' ELSE 'a' END) || (o_custkey % 120) || '_' || o_orderkey AS one, (CASE o_orderkey % 2 WHEN 0 THEN 'b' ELSE 'a' END) || (o_orderkey % 110) || '_x' AS other FROM orders)
SELECT id, {_KEY.format("one")} < {_KEY.format("other")} AS first FROM n""")
def natural_key(spark, d):
    """Whether one name sorts before another."""
    cust, key = F.col("o_custkey"), F.col("o_orderkey")
    one = F.concat(F.when(cust % 3 == 0, "b").otherwise("a"), cust % 120, F.lit("_"), key)
    other = F.concat(F.when(key % 2 == 0, "b").otherwise("a"), key % 110, F.lit("_x"))
    return views.table(spark, d, "orders").select(key.alias("id"), (catalog.natural_key(one) < catalog.natural_key(other)).alias("first"))


# Pair distribution functions, on a 9 x 9 x 9 volume


_RECIPROCAL = (1.5, 1.5, 1.5)


def _dense() -> str:
    return f"""{_VOX}, dense AS (SELECT a.i AS il, b.i AS ik, c.i AS ih, coalesce(v / n, 0.0) AS signal FROM range(9) a(i), range(9) b(i), range(9) c(i) LEFT JOIN vox ON il = a.i AND ik = b.i AND ih = c.i)"""


_TAPER = "(CASE WHEN r <= 1 THEN 1.0 WHEN r >= 2 THEN (SELECT f FROM floor) ELSE 0.5 * (1 - cos(r * pi())) END)"
_R = "sqrt(pow((ih - 4) * 1.5, 2) + pow((ik - 4) * 1.5, 2) + pow((il - 4) * 1.5, 2)) * (2.0 / 8.0)"
_FLOOR = f"floor AS (SELECT min(0.5 * (1 - cos(r * pi()))) AS f FROM (SELECT {_R} AS r FROM range(9) a(il), range(9) b(ik), range(9) c(ih)) WHERE r > 1 AND r < 2)"


def _signal(spark, d):
    return _vox(spark, d).withColumn("signal", F.col("v") / F.col("n")).select("il", "ik", "ih", "signal")


@query(f"""WITH {_dense()}, {_FLOOR}, q AS (SELECT *, {_R} AS r FROM dense WHERE signal <> 0)
SELECT il, ik, ih, round(signal * {_TAPER}, 6) AS value FROM q""")
def taper_volume(spark, d):
    return pdf.tapered(_signal(spark, d), _SMALL, _RECIPROCAL, 8.0).select("il", "ik", "ih", F.round("value", 6).alias("value"))


@query(f"""WITH {_dense()}, {_FLOOR}, q AS (SELECT *, {_R} AS r FROM dense WHERE il < 8 AND ik < 8 AND ih < 8),
t AS (SELECT il, ik, ih, signal * {_TAPER} AS v FROM q)
SELECT z.i AS iz, y.i AS iy, x.i AS ix, round(sum(v * cos(2 * pi() * ((z.i - 4) * (il - 4) + (y.i - 4) * (ik - 4) + (x.i - 4) * (ih - 4)) / 8.0)) / 512, 6) + 0 AS pdf
FROM t, range(8) z(i), range(8) y(i), range(8) x(i) GROUP BY 1, 2, 3""")
def total_pdf(spark, d):
    return pdf.total_pdf(_signal(spark, d), _SMALL, _RECIPROCAL, 8.0).select("iz", "iy", "ix", (F.round("pdf", 6) + 0).alias("pdf"))


_FILLED = f"""c AS (SELECT il, ik, ih FROM dense WHERE il BETWEEN 2 AND 6 AND ik BETWEEN 2 AND 6 AND ih BETWEEN 2 AND 6),
arm AS (SELECT * FROM (VALUES (0, 0, 1), (0, 0, -1), (0, 1, 0), (0, -1, 0), (1, 0, 0), (-1, 0, 0)) t(l, k, h)),
s AS (SELECT c.il, c.ik, c.ih, a.l, a.k, a.h, sum(n.signal) AS s FROM c, arm a JOIN dense n ON abs(c.il + a.l - n.il) + abs(c.ik + a.k - n.ik) + abs(c.ih + a.h - n.ih) = 1 AND NOT (n.il = c.il AND n.ik = c.ik AND n.ih = c.ih) GROUP BY ALL),
m AS (SELECT il, ik, ih, sum(s) / 30 AS mid FROM s GROUP BY 1, 2, 3),
f AS (SELECT il, ik, ih, sum(fill) AS fill FROM (SELECT il, ik, ih, mid AS fill FROM m UNION ALL SELECT s.il + l, s.ik + k, s.ih + h, (mid + s) / 6 FROM s JOIN m ON s.il = m.il AND s.ik = m.ik AND s.ih = m.ih) GROUP BY 1, 2, 3),
filled AS (SELECT d.il, d.ik, d.ih, CASE WHEN fill > 0 THEN fill ELSE signal END AS signal FROM dense d LEFT JOIN f ON d.il = f.il AND d.ik = f.ik AND d.ih = f.ih)"""


@query(f"""WITH {_dense()}, {_FLOOR}, {_FILLED}, q AS (SELECT *, {_R} AS r FROM filled WHERE il < 8 AND ik < 8 AND ih < 8),
t AS (SELECT il, ik, ih, signal * {_TAPER} AS v FROM q)
SELECT z.i AS iz, y.i AS iy, x.i AS ix, round(sum(v * cos(2 * pi() * ((z.i - 4) * (il - 4) + (y.i - 4) * (ik - 4) + (x.i - 4) * (ih - 4)) / 8.0)) / 512, 6) + 0 AS pdf
FROM t, range(8) z(i), range(8) y(i), range(8) x(i) GROUP BY 1, 2, 3""")
def delta_pdf(spark, d):
    """Every whole-number reflection that lies two voxels inside is a hole of seven voxels; overlapping fills add up."""
    return pdf.delta_pdf(_signal(spark, d), _SMALL, _RECIPROCAL, 8.0, 1.6).select("iz", "iy", "ix", (F.round("pdf", 6) + 0).alias("pdf"))


@query(f"""WITH {_VOX}, s AS (SELECT il, ik, ih, v / n AS signal FROM vox), hole AS (SELECT DISTINCT a.il + d.l AS il, a.ik + d.k AS ik, a.ih + d.h AS ih
FROM (SELECT il, ik, ih FROM vox WHERE il % 4 = 2 AND ik % 4 = 2 AND ih % 4 = 2) a, (VALUES (0, 0, 0), (0, 0, 1), (0, 0, -1), (0, 1, 0), (0, -1, 0), (1, 0, 0), (-1, 0, 0)) d(l, k, h))
SELECT s.il, s.ik, s.ih, round(CASE WHEN hole.il IS NULL THEN signal ELSE 0.0 END, 6) AS signal FROM s LEFT JOIN hole ON s.il = hole.il AND s.ik = hole.ik AND s.ih = hole.ih""")
def punch(spark, d):
    centres = _signal(spark, d).filter("il % 4 = 2 AND ik % 4 = 2 AND ih % 4 = 2")
    offsets = pdf.hole_offsets(1.5, _SMALL.steps, _RECIPROCAL)
    return pdf.punch(_signal(spark, d), centres, offsets, "signal").select("il", "ik", "ih", F.round("signal", 6).alias("signal"))


@query(f"""WITH {_dense()}, c AS (SELECT il, ik, ih FROM dense WHERE il % 4 = 2 AND ik % 4 = 2 AND ih % 4 = 2),
arm AS (SELECT * FROM (VALUES (0, 0, 1), (0, 0, -1), (0, 1, 0), (0, -1, 0), (1, 0, 0), (-1, 0, 0)) t(l, k, h)),
s AS (SELECT c.il, c.ik, c.ih, a.l, a.k, a.h, sum(n.signal) AS s FROM c, arm a JOIN dense n ON abs(c.il + a.l - n.il) + abs(c.ik + a.k - n.ik) + abs(c.ih + a.h - n.ih) = 1 AND NOT (n.il = c.il AND n.ik = c.ik AND n.ih = c.ih) GROUP BY ALL),
m AS (SELECT il, ik, ih, sum(s) / 30 AS mid FROM s GROUP BY 1, 2, 3),
f AS (SELECT il, ik, ih, mid AS fill FROM m UNION ALL SELECT s.il + l, s.ik + k, s.ih + h, (mid + s) / 6 FROM s JOIN m ON s.il = m.il AND s.ik = m.ik AND s.ih = m.ih)
SELECT d.il, d.ik, d.ih, round(CASE WHEN fill > 0 THEN fill ELSE signal END, 6) AS signal FROM dense d LEFT JOIN f ON d.il = f.il AND d.ik = f.ik AND d.ih = f.ih""")
def fill_holes(spark, d):
    """Holes of seven voxels, each filled from the 30 faces around it, in a dense volume."""
    places = spark.range(729).select((F.col("id") / 81).cast("int").alias("il"), ((F.col("id") / 9).cast("int") % 9).alias("ik"), (F.col("id") % 9).cast("int").alias("ih"))
    dense = places.join(_signal(spark, d), ["il", "ik", "ih"], "left").withColumn("signal", F.coalesce("signal", F.lit(0.0)))
    centres = dense.filter("il % 4 = 2 AND ik % 4 = 2 AND ih % 4 = 2").select("il", "ik", "ih")
    return pdf.fill_holes(dense, centres, pdf.hole_offsets(1.5, _SMALL.steps, _RECIPROCAL), "signal").select("il", "ik", "ih", F.round("signal", 6).alias("signal"))


@query(f"""WITH {_VOX}, r AS (SELECT DISTINCT l_partkey % 13 - 6 AS h, l_suppkey % 11 - 5 AS k, l_linenumber - 4 AS l FROM lineitem),
p AS (SELECT h, k, l, CASE WHEN abs(h) > 4 OR abs(k) > 4 OR abs(l) > 4 THEN 'off_grid' WHEN greatest(abs(h), abs(k), abs(l)) > 2 THEN 'edge' WHEN v IS NULL OR v <= 0 THEN 'no_signal' ELSE 'punched' END AS outcome
FROM r LEFT JOIN vox ON ih = h + 4 AND ik = k + 4 AND il = l + 4) SELECT outcome, count(*) AS n FROM p GROUP BY 1""")
def punch_outcomes(spark, d):
    rows = views.table(spark, d, "lineitem").select((F.col("l_partkey") % 13 - 6).alias("h"), (F.col("l_suppkey") % 11 - 5).alias("k"), (F.col("l_linenumber") - 4).alias("l")).distinct()
    return volume.punch_outcomes(volume.reflections_on_grid(rows, _SMALL, _vox(spark, d), 2)).select("outcome", "n")


@query(f"""WITH {LOG_SQL}, days AS (SELECT DISTINCT cast(floor(frame / 24) AS BIGINT) AS g FROM log), s AS (SELECT g, t.i, CASE WHEN t.i IN (0, 23) THEN 1 ELSE 2 END AS near, CASE WHEN (g * 24 + t.i) % 5 <> 2 THEN coalesce(monitor, 0) END AS v FROM days CROSS JOIN range(24) t(i) LEFT JOIN log ON frame = g * 24 + t.i),
once AS (SELECT *, (near + 0.01) * coalesce(v, 0) - coalesce(lag(coalesce(v, 0)) OVER w, 0) - coalesce(lead(coalesce(v, 0)) OVER w, 0) AS a FROM s WINDOW w AS (PARTITION BY g ORDER BY i)),
twice AS (SELECT *, (near + 0.01) * a - coalesce(lag(a) OVER w, 0) - coalesce(lead(a) OVER w, 0) AS b FROM once WINDOW w AS (PARTITION BY g ORDER BY i))
SELECT g AS "group", cast(i AS INT) AS i, round(coalesce(v, -b / ((near + 0.01) * (near + 0.01) + near)), 4) AS value FROM twice""")
def matern_fill(spark, d):
    """Gaps in the hourly log, day by day: the square of (0.01 - Laplacian) is 0 at each, which SQL can state as gaps lie five hours apart."""
    log = views.log(spark, d).select("frame", F.col("monitor").cast("double").alias("monitor"))
    days = log.select(F.floor(F.col("frame") / 24).cast("long").alias("group")).distinct().select("group", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("i"))
    rows = days.withColumn("frame", F.col("group") * 24 + F.col("i")).join(log, "frame", "left")
    rows = rows.select("group", "i", F.lit(0).alias("j"), F.lit(0).alias("k"), F.when(F.col("frame") % 5 != 2, F.coalesce("monitor", F.lit(0.0))).alias("value"))
    return pdf.matern_fill(rows, order=2, eps=0.1).select("group", "i", F.round("value", 4).alias("value"))


@query(f"""WITH {HITS_SQL}, s AS (SELECT cast(y AS INT) AS y, cast(x AS INT) AS x, cast(sum(counts) AS DOUBLE) AS v FROM hits GROUP BY 1, 2),
p AS (SELECT cast(a.i AS INT) AS y, cast(b.i AS INT) AS x, coalesce(v, 0) AS v, a.i % 4 = 1 AND b.i % 4 = 2 AS gap FROM range(64) a(i) CROSS JOIN range(64) b(i) LEFT JOIN s ON y = a.i AND x = b.i),
n AS (SELECT p.y, p.x, sum(q.v / CASE WHEN p.y = q.y THEN 1.0 ELSE 4.0 END) / (sum(1 / CASE WHEN p.y = q.y THEN 1.0 ELSE 4.0 END) + 0.25) AS v FROM p JOIN p q ON abs(p.y - q.y) + abs(p.x - q.x) = 1 WHERE p.gap GROUP BY 1, 2)
SELECT p.y, p.x, round(coalesce(n.v, p.v), 6) AS value FROM p LEFT JOIN n ON p.y = n.y AND p.x = n.x""")
def matern_image(spark, d):
    """Single dead pixels of the summed image, filled with steps of 2 along y and 1 along x."""
    sums = views.hits(spark, d).groupBy("y", "x").agg(F.sum("counts").cast("double").alias("v"))
    every = spark.range(4096).select(F.floor(F.col("id") / 64).alias("y"), (F.col("id") % 64).alias("x")).join(sums, ["y", "x"], "left")
    rows = every.select(F.lit("f1").alias("group"), "y", "x", F.when(~((F.col("y") % 4 == 1) & (F.col("x") % 4 == 2)), F.coalesce("v", F.lit(0.0))).alias("value"))
    return pdf.matern_fill(rows, order=1, eps=0.5, steps=(2.0, 1.0), axes=("y", "x")).select("y", "x", F.round("value", 6).alias("value"))


# Sources


@query("""WITH cur AS (SELECT o_custkey AS file, 'f' || (o_orderkey % 3) AS entry, CASE o_orderkey % 5 WHEN 0 THEN 'instrument/logs' WHEN 1 THEN 'monitor' WHEN 2 THEN 'instrument/goniometer' WHEN 3 THEN 'monitor1' ELSE 'sample' END AS path,
    o_orderpriority AS field, 'v' || max(o_orderkey) AS value FROM orders GROUP BY ALL),
sup AS (SELECT c_custkey AS file, 'f' || (c_custkey % 3) AS entry, CASE c_nationkey % 3 WHEN 0 THEN 'instrument/logs' WHEN 1 THEN 'instrument/goniometer' ELSE 'monitor' END AS path, CASE c_nationkey % 2 WHEN 0 THEN '1-URGENT' ELSE '5-LOW' END AS field, c_name AS value FROM customer),
kept AS (SELECT cur.* FROM cur LEFT JOIN (SELECT DISTINCT file, entry FROM sup) r USING (file, entry) WHERE r.file IS NULL OR path NOT IN ('monitor1', 'monitor2')),
left_ AS (SELECT k.* FROM kept k ANTI JOIN (SELECT file, entry, path FROM sup WHERE path <> 'instrument/goniometer') USING (file, entry, path))
SELECT file, entry, path, field, value FROM left_ ANTI JOIN sup USING (file, entry, path, field) UNION ALL SELECT file, entry, path, field, value FROM sup""")
def beamline_metadata(spark, d):
    """Metadata made from orders, into which a beamline puts what customers stand for: logs and monitors are replaced, goniometers merged."""
    o = views.table(spark, d, "orders")
    path = F.element_at(F.array(*map(F.lit, ("instrument/logs", "monitor", "instrument/goniometer", "monitor1", "sample"))), (F.col("o_orderkey") % 5 + 1).cast("int"))
    entry = F.concat(F.lit("f"), (F.col("o_orderkey") % 3).cast("string"))
    current = o.groupBy(F.col("o_custkey").alias("file"), entry.alias("entry"), path.alias("path"), F.col("o_orderpriority").alias("field")).agg(F.concat(F.lit("v"), F.max("o_orderkey").cast("string")).alias("value"))
    group = F.element_at(F.array(*map(F.lit, ("logs", "goniometer", "monitor"))), (F.col("c_nationkey") % 3 + 1).cast("int"))
    field = F.when(F.col("c_nationkey") % 2 == 0, "1-URGENT").otherwise("5-LOW")
    supplied = views.table(spark, d, "customer").select(F.col("c_custkey").alias("file"), F.concat(F.lit("f"), (F.col("c_custkey") % 3).cast("string")).alias("entry"), group.alias("group"), field.alias("field"), F.col("c_name").alias("value"))
    return hooks.read_logs(current, supplied).select("file", "entry", "path", "field", "value")


@query(f"""WITH {HITS_SQL}, b AS (SELECT DISTINCT l_linenumber AS box, l_linenumber * 7 AS y0, l_linenumber * 7 + 5 AS y1, l_linenumber * 4 AS x0, l_linenumber * 4 + 30 AS x1 FROM lineitem),
p AS (SELECT y, x, max(counts) AS counts FROM hits GROUP BY 1, 2)
SELECT box, y, x, counts FROM (SELECT box, y, x, counts, row_number() OVER (PARTITION BY box ORDER BY counts DESC, y, x) AS k FROM b JOIN p ON y BETWEEN y0 AND y1 AND x BETWEEN x0 AND x1) WHERE k = 1""")
def brightest_in_boxes(spark, d):
    n = F.col("l_linenumber")
    boxes = views.table(spark, d, "lineitem").select(n.alias("box"), (n * 7).alias("y0"), (n * 7 + 5).alias("y1"), (n * 4).alias("x0"), (n * 4 + 30).alias("x1")).distinct()
    return peaks.brightest_in_boxes(views.hits(spark, d), boxes).select("box", "y", "x", "counts")


# Orientation


@query(f"""WITH {HITS_SQL}, r AS (SELECT frame, y, x, list_sort(list_distinct([round(1.0 * counts / 3, 4) + 0, round(1.0 * counts / 3 + (y % 2) / 100000.0, 4) + 0, round(x * 1.0, 4) + 0])) AS roots FROM hits) SELECT frame, y, x, len(roots) AS n, roots[1] AS least, roots[-1] AS most FROM r""")
def unique_roots(spark, d):
    third = F.col("counts") / 3.0
    roots = geo.unique_roots(F.array(third, third + (F.col("y") % 2) / 100000.0, F.col("x").cast("double"), F.lit(float("nan")), F.lit(None).cast("double")))
    return views.hits(spark, d).select("frame", "y", "x", roots.alias("roots")).select("frame", "y", "x", F.size("roots").alias("n"), F.col("roots")[0].alias("least"), F.element_at("roots", -1).alias("most"))


@query()
def orientation_votes(spark, d):
    """Orientations that pairs of the brightest hits allow, with the votes of all hits."""
    rows = views.hits(spark, d)
    x, y = F.col("x"), F.col("y")
    q = [c.alias(n) for c, n in zip(geo.gvec(HITS_GEOMETRY, x, y, F.col("frame")), ("qx", "qy", "qz"))]
    own = rows.select(*q, geo.polar(HITS_GEOMETRY, x, y).alias("polar"), F.col("counts").alias("intensity"))
    found = orient.orientation_votes(own, HITS_GEOMETRY.cell, HITS_GEOMETRY.wavelength, seeds=24, tolerance=5.0, ring=0.5)
    return found.select("first", "second", "h1", "k1", "l1", "h2", "k2", "l2", "votes")


def _qs(spark, d, least: int = 60):
    rows = views.hits(spark, d).filter(F.col("counts") > least)
    g = geo.gvec(HITS_GEOMETRY, F.col("x"), F.col("y"), F.col("frame"))
    return rows.select("frame", "y", "x", *[c.alias(n) for c, n in zip(g, ("qx", "qy", "qz"))])


@query(f"WITH {_G1} SELECT frame, y, x, round(qx, 6) + 0 AS qx, round(qy, 6) + 0 AS qy, round(qz, 6) + 0 AS qz FROM g")
def gvec(spark, d):
    return _qs(spark, d, 0).select("frame", "y", "x", *[(F.round(c, 6) + 0).alias(c) for c in ("qx", "qy", "qz")])


@query(f"""WITH {_G1}, near AS (SELECT DISTINCT cast(round_even(h, 0) AS INT) AS h, cast(round_even(k, 0) AS INT) AS k, cast(round_even(l, 0) AS INT) AS l FROM m),
v AS (SELECT *, h / 4.0 AS a, k / 4.0 AS b, l / 4.0 AS c FROM near), w AS (SELECT *, -(a * a + b * b + c * c) / 2 / nullif(sqrt(4 * a * a + 4 * b * b), 0) AS f FROM v),
s AS (SELECT *, atan2(-2 * b, 2 * a) + side * acos(f) AS phi FROM (SELECT * FROM w WHERE abs(f) <= 1), (VALUES (1), (-1)) t(side)),
o AS (SELECT *, cos(phi) * a - sin(phi) * b + 2 AS k0, sin(phi) * a + cos(phi) * b AS k1, ((degrees(phi) + 180) % 360 + 360) % 360 AS turn FROM s),
px AS (SELECT h, k, l, -100 * k1 / k0 / 0.5 + 31.5 AS x, 100 * c / k0 / 0.5 + 31.5 AS y, CASE WHEN turn < 25 THEN turn + 360 ELSE turn END AS z FROM o)
SELECT h, k, l, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM px WHERE x > 0 AND x < 64 AND y > 0 AND y < 64 AND z > 0 AND z < 385""")
def hkl_to_pixel(spark, d):
    """Where whole reflections near the hits meet the detector."""
    hkl = geo.pixel_to_hkl(HITS_GEOMETRY, F.col("x"), F.col("y"), F.col("frame"))
    near = views.hits(spark, d).select(*[F.rint(c).cast("int").alias(n) for c, n in zip(hkl, "hkl")]).distinct()
    spots = geo.hkl_to_pixels(near, HITS_GEOMETRY)
    return spots.filter(geo.on_detector(HITS_GEOMETRY, F.col("x"), F.col("y"), F.col("z"), 385)).select("h", "k", "l", *[F.round(c, 6).alias(c) for c in "xyz"])


@query(f"""WITH {_G1}, v AS (SELECT qx, qy, qz FROM g WHERE counts > 60), lat AS (SELECT t.k AS k, t.k * 0.03 AS lat, t.k * 0.03 > pi() / 2 - 0.015 AS last FROM range(53) t(k)),
rows_ AS (SELECT k, lat, CASE WHEN last THEN pi() ELSE 2 * pi() END AS turn, CASE WHEN last THEN greatest(1, n // 2) ELSE n END AS n FROM (SELECT *, greatest(1, cast(round(2 * pi() * sin(lat) / 0.03) AS BIGINT)) AS n FROM lat)),
placed AS (SELECT *, sum(n) OVER (ORDER BY k) - n AS before FROM rows_),
d AS (SELECT before + j AS direction, sin(lat) * cos(j * (turn / n)) AS tx, sin(lat) * sin(j * (turn / n)) AS ty, cos(lat) AS tz FROM (SELECT *, unnest(range(n)) AS j FROM placed)),
top AS (SELECT 1.1 * max(sqrt(qx * qx + qy * qy + qz * qz)) AS q_max FROM v)
SELECT cast(direction AS BIGINT) AS direction, cast(floor(abs(qx * tx + qy * ty + qz * tz) * (512 / q_max)) AS INT) AS bin, count(*) AS n FROM v, d, top GROUP BY 1, 2""")
def projection_histogram(spark, d):
    axes = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(orient.hemisphere())], "direction int, tx double, ty double, tz double")
    return orient.projection_histogram(_qs(spark, d), axes)


@query(f"""WITH {HITS_SQL}, p AS (SELECT *, {_POLAR} AS polar FROM hits), r(ring, a) AS (VALUES (0, 3.0), (1, 6.0), (2, 9.0)),
n AS (SELECT ring, cast(floor(radians(degrees(atan2(0.5 * (x - 31.5), 0.5 * (y - 31.5))) + 180) / 0.2) AS INT) AS sector, y, x, counts FROM (SELECT y, x, max(polar) AS polar, max(counts) AS counts FROM p GROUP BY 1, 2) JOIN r ON abs(polar - a) <= 0.3)
SELECT ring, sector, x, y, counts FROM n QUALIFY row_number() OVER (PARTITION BY ring, sector ORDER BY counts DESC, y, x) = 1""")
def ring_points(spark, d):
    one = views.hits(spark, d).groupBy("y", "x").agg(F.max("counts").alias("counts"))
    return orient.ring_points(one, HITS_GEOMETRY, [(0, 3.0), (1, 6.0), (2, 9.0)], 0.3).select("ring", "sector", "x", "y", "counts")


@query()
def niggli_cells(spark, d):
    """Reduced cells of one lattice per supplier; every third has a long axis."""
    s = views.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"))
    edge = [0.25 / (1 + (F.col("id") % m) / 10.0) for m in (5, 7, 11)]
    edge[2] /= F.when(F.col("id") % 3 == 0, 8.0).otherwise(1.0)
    ub = F.array(edge[0], edge[1] * 0.2, F.lit(0.0), F.lit(0.0), edge[1], edge[2] * 0.1, F.lit(0.0), F.lit(0.0), edge[2])
    found = orient.niggli_cells(s.select("id", ub.alias("ub")))
    return found.select("id", *[F.round(c, 5).alias(c) for c in ("a", "b", "c", "alpha", "beta", "gamma")])


def _forms(spark, d):
    s = views.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"))
    edges = [F.lit(0.25), 0.25 / (1 + F.col("id") % 3), 0.25 / (1 + (F.col("id") % 4) / 2.0)]
    ub = F.array(*[edges[i] * (1.0 if i == j else 0.0) for i in range(3) for j in range(3)])
    return bravais.lattice_forms(s.select("id", ub.alias("ub")))


@query()
def lattice_forms(spark, d):
    """Conventional cells of one lattice per supplier, by crystal system and centring."""
    return _forms(spark, d).select("id", "cell_type", "centring", *[F.round(c, 5).alias(c) for c in ("error", "a", "b", "c", "alpha", "beta", "gamma")])


@query("""WITH s AS (SELECT s_suppkey AS id, [4.0, 4.0 * (1 + s_suppkey % 3), 4.0 * (1 + (s_suppkey % 4) / 2.0)] AS e FROM supplier)
SELECT id, CASE WHEN e[1] = e[2] AND e[2] = e[3] THEN 'cubic' WHEN e[1] = e[2] OR e[2] = e[3] OR e[1] = e[3] THEN 'tetragonal' ELSE 'orthorhombic' END AS cell_type, 'P' AS centring, round(e[1] * e[2] * e[3], 4) AS volume FROM s""")
def best_cells(spark, d):
    """The cell of highest symmetry of each lattice."""
    return bravais.best_cells(_forms(spark, d), 1e-6).select("id", "cell_type", "centring", F.round(F.col("a") * F.col("b") * F.col("c"), 4).alias("volume"))


@query()
def ring_table(spark, d):
    """Rings of the reflections near the hits' directions."""
    rows = views.table(spark, d, "lineitem").select((F.col("l_partkey") % 7).cast("int").alias("h"), (F.col("l_suppkey") % 5).cast("int").alias("k"), (F.col("l_linenumber") % 4).cast("int").alias("l")).distinct().filter("h + k + l > 0")
    angle = geo.two_theta_hkl((4.0, 4.1, 4.2, 90.0, 95.0, 90.0), 0.5, F.col("h"), F.col("k"), F.col("l"))
    table = lattice.ring_table(rows.select(F.lit(0).alias("lattice"), "h", "k", "l", angle.alias("two_theta"), F.lit(2).alias("multiplicity")), 0.3)
    return table.select("h", "k", "l", "ring", F.round("ring_angle", 6).alias("ring_angle"))


@query("""WITH RECURSIVE m AS (SELECT DISTINCT l_suppkey AS lattice, l_partkey % 7 AS h, l_orderkey % 5 AS k, l_linenumber % 4 AS l FROM lineitem),
t AS (SELECT *, degrees(2 * asin(sqrt(pow(h / (4 + (lattice % 10) / 10.0), 2) + pow(k / 4.3, 2) + pow(l / (5 + (lattice % 7) / 7.0), 2)) * 0.25)) AS tt FROM m WHERE h + k + l > 0),
o AS (SELECT *, row_number() OVER (PARTITION BY lattice ORDER BY tt, h, k, l) AS i FROM t),
walk AS (SELECT lattice, i, 0 AS ring, tt AS mean, cast(2 AS DOUBLE) AS weight FROM o WHERE i = 1 UNION ALL
SELECT o.lattice, o.i, CASE WHEN o.tt - w.mean > 0.3 THEN w.ring + 1 ELSE w.ring END, CASE WHEN o.tt - w.mean > 0.3 THEN o.tt ELSE (w.mean * w.weight + o.tt * 2) / (w.weight + 2) END, CASE WHEN o.tt - w.mean > 0.3 THEN 2 ELSE w.weight + 2 END
FROM walk w JOIN o ON o.lattice = w.lattice AND o.i = w.i + 1),
a AS (SELECT o.lattice, h, k, l, ring, tt FROM o JOIN walk w ON o.lattice = w.lattice AND o.i = w.i)
SELECT lattice, h, k, l, ring, round(avg(tt) OVER (PARTITION BY lattice, ring), 5) AS ring_angle FROM a""")
def ring_tables(spark, d):
    """A lattice per supplier, its edges from the supplier's number and its reflections from the supplier's lines."""
    key = F.col("l_suppkey")
    rows = views.table(spark, d, "lineitem").select(key.alias("lattice"), (F.col("l_partkey") % 7).alias("h"), (F.col("l_orderkey") % 5).alias("k"), (F.col("l_linenumber") % 4).alias("l")).distinct().filter("h + k + l > 0")
    a, c = 4 + (F.col("lattice") % 10) / 10.0, 5 + (F.col("lattice") % 7) / 7.0
    size = F.sqrt(F.pow(F.col("h") / a, F.lit(2.0)) + F.pow(F.col("k") / 4.3, F.lit(2.0)) + F.pow(F.col("l") / c, F.lit(2.0)))
    table = lattice.ring_table(rows.select("lattice", "h", "k", "l", F.degrees(2 * F.asin(size * 0.25)).alias("two_theta"), F.lit(2).alias("multiplicity")), 0.3)
    return table.select("lattice", "h", "k", "l", "ring", F.round("ring_angle", 5).alias("ring_angle"))


@query(f"""WITH {HITS_SQL}, p AS (SELECT frame, y, x, {_POLAR} AS polar FROM hits), r(ring, a) AS (VALUES (0, 2.0), (1, 3.5), (2, 5.5), (3, 8.0))
SELECT frame, y, x, (SELECT ring FROM r ORDER BY abs(p.polar - a), ring LIMIT 1) AS ring FROM p""")
def assign_rings(spark, d):
    rings = spark.createDataFrame([(0, 2.0), (1, 3.5), (2, 5.5), (3, 8.0)], "ring int, ring_angle double")
    return lattice.assign_rings(_polar(views.hits(spark, d)), rings).select("frame", "y", "x", "ring")


_ANNULUS_SIZE = f"(SELECT count(*) FROM range(8) a(y), range(8) b(x) WHERE {_IN})"


@query(f"""WITH {_STUCK_SQL}, {LOG_SQL}, {_HOT}, good AS (SELECT * FROM frames ANTI JOIN hot USING (y, x)), sums AS (SELECT frame, cast(sum(counts) AS BIGINT) AS counts FROM good GROUP BY frame),
partial AS (SELECT frame, sum(counts) * {_ANNULUS_SIZE} / any_value(keep) AS partial FROM (SELECT frame, counts, greatest(1, cast(floor(n * 9 / 10) AS BIGINT)) AS keep, row_number() OVER (PARTITION BY frame ORDER BY counts, y, x) AS k FROM
    (SELECT *, count(*) OVER (PARTITION BY frame) AS n FROM good WHERE {_IN})) WHERE k <= keep GROUP BY frame),
ratio AS (SELECT p.frame, partial / nullif(monitor, 0) AS r FROM partial p JOIN log ON p.frame = log.frame), lim AS (SELECT 10 AS lo, (SELECT max(frame) + 1 - 10 FROM frames) AS hi),
ok AS (SELECT frame, CASE WHEN frame >= lo AND frame < hi THEN r END AS r FROM ratio, lim),
series AS (SELECT frame, v FROM (SELECT frame, coalesce(last_value(r IGNORE NULLS) OVER (ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    first_value(r IGNORE NULLS) OVER (ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS v FROM ok) WHERE v IS NOT NULL), {_MEDIAN},
t AS (SELECT frame, v / (SELECT median(v) FROM filtered) AS transmission FROM filtered)
SELECT s.frame, s.counts, round(CASE WHEN s.frame < lo OR s.frame > hi THEN 0.0 ELSE monitor * coalesce(transmission, 1.0) END, 6) AS weight FROM sums s JOIN log ON s.frame = log.frame LEFT JOIN t ON t.frame = s.frame, lim""")
def normalized_frames(spark: SparkSession, d: str) -> DataFrame:
    """Frame sums without hot pixels, trimmed annulus sums, transmission and frame weights in one table."""
    f = _stuck(spark, d)
    last = _last(f)
    good = masks.apply_pixel_mask(f, masks.hot_pixels(f))
    sums = frames.summed_frames(good)
    passed = frames.transmission(frames.partial_frames(good, _annulus(spark)), views.log(spark, d), FIRST, last)
    weights = frames.frame_weights(views.log(spark, d).join(passed.select("entry", "frame", "transmission"), ["entry", "frame"], "left"), FIRST, last)
    return sums.join(weights, ["entry", "frame"]).select("frame", "counts", F.round("weight", 6).alias("weight"))


flagship = normalized_frames
