"""Queries by name, each with the SQL that must give the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import dealt  # noqa: F401

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: str = "ts"):
    """Microseconds since 1970 of a timestamp without time zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST({ts} AS TIMESTAMP_NTZ))")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").withColumn("us", micros())


#: Boxes in frames of ten minutes, derived from events with integer arithmetic; five clips, five sources.
DETECTIONS_SQL = """SELECT event_id, user_id % 5 AS clip_id, user_id AS track_id, (epoch_us(ts) // 600000000) - 2840112 AS frame,
 CAST((user_id * 97) % 1500 + (event_id * 7) % 25 AS DOUBLE) AS x, CAST((user_id * 61) % 1200 + (event_id * 11) % 25 AS DOUBLE) AS y,
 CAST(40 + (user_id * 31) % 120 AS DOUBLE) AS w, CAST(40 + (user_id * 17) % 120 AS DOUBLE) AS h,
 CAST((event_id * 13) % 1000 AS DOUBLE) / 1000.0 AS score, event_type AS source FROM events"""


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, u, i = events(spark, sf_dir), F.col("user_id"), F.col("event_id")
    whole = lambda c: c.cast("double")
    return e.select(
        "event_id", (u % 5).alias("clip_id"), u.alias("track_id"), (F.floor(F.col("us") / 600_000_000).cast("long") - 2840112).alias("frame"),
        whole(u * 97 % 1500 + i * 7 % 25).alias("x"), whole(u * 61 % 1200 + i * 11 % 25).alias("y"), whole(40 + u * 31 % 120).alias("w"), whole(40 + u * 17 % 120).alias("h"),
        (whole(i * 13 % 1000) / 1000).alias("score"), F.col("event_type").alias("source"),
    )


def with_detections(sql: str) -> str:
    return f"WITH det AS ({DETECTIONS_SQL}), {sql}"


#: Intersection over union of boxes a and b, with the denominator's guard.
IOU_SQL = """(greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)))
 / (a.w * a.h + b.w * b.h - greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) + 1e-9)"""

#: How far the picture moved into each frame, and its path since the clip's start: exactly (0, 0) stands for an unknown shift.
CAMERA_SQL = """cam AS (SELECT clip_id, f AS frame, ((f * 7 + clip_id) % 5 - 2)::DOUBLE AS dx, ((f * 3 + clip_id) % 3 - 1)::DOUBLE AS dy FROM (SELECT DISTINCT clip_id FROM det), range(0, 4320) r(f)),
path AS (SELECT *, sum(dx) OVER w AS px, sum(dy) OVER w AS py FROM cam WINDOW w AS (PARTITION BY clip_id ORDER BY frame ROWS UNBOUNDED PRECEDING))"""


def camera(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.window import Window

    f = detections(spark, sf_dir).select("clip_id").distinct().withColumn("frame", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4319).cast("long"))))
    f = f.withColumns({"dx": ((F.col("frame") * 7 + F.col("clip_id")) % 5 - 2).cast("double"), "dy": ((F.col("frame") * 3 + F.col("clip_id")) % 3 - 1).cast("double")})
    w = Window.partitionBy("clip_id").orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    return f.withColumns({"path_x": F.sum("dx").over(w), "path_y": F.sum("dy").over(w)})


#: One box for each frame of a track, in runs that no gap of more than 60 frames interrupts.
RUNS_SQL = """one AS (SELECT * FROM det QUALIFY row_number() OVER (PARTITION BY track_id, frame ORDER BY event_id) = 1),
steps AS (SELECT *, coalesce(frame - lag(frame) OVER (PARTITION BY track_id ORDER BY frame) > 60, true)::INT AS jump FROM one),
runs AS (SELECT * EXCLUDE jump, (sum(jump) OVER (PARTITION BY track_id ORDER BY frame ROWS UNBOUNDED PRECEDING))::BIGINT AS run FROM steps)"""


def track_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.window import Window

    from ..operators.intervals import numbered_islands

    d = detections(spark, sf_dir)
    one = d.withColumn("_n", F.row_number().over(Window.partitionBy("track_id", "frame").orderBy("event_id"))).filter("_n = 1").drop("_n")
    step = F.col("frame") - F.lag("frame").over(Window.partitionBy("track_id").orderBy("frame"))
    return numbered_islands(one.withColumn("_step", step), ["track_id"], ["frame"], F.coalesce(F.col("_step") > 60, F.lit(True))).drop("_step")


def rounded(df: DataFrame, places: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, places) + F.lit(0.0) for c in columns})  # no negative zero


def iou_sql(a: str, b: str) -> str:
    return IOU_SQL.replace("a.", "<a>.").replace("b.", "<b>.").replace("<a>", a).replace("<b>", b)


def fold_sql(source: str, key: str, order: str, fields: str, goes: str, first: str = "", adopt: str = "a") -> str:
    """Recursive relations that take source's boxes of each key in order and keep b unless goes holds for a kept a; l has the kept lists.

    fields: a struct of the columns; first: a condition under which a box is kept whatever is there; adopt: what the first kept box it goes for becomes.
    """
    on = " AND ".join(f"s.{k.strip()} = r.{k.strip()}" for k in key.split(","))
    keys = ", ".join(f"r.{k.strip()}" for k in key.split(","))
    hit = f"list_position(list_transform(r.kept, lambda a: {goes.replace('b.', 's.b.')}), true)"
    hit = f"CASE WHEN s.{first} THEN NULL ELSE {hit} END" if first else hit
    taken = "r.kept" if adopt == "a" else f"list_transform(r.kept, lambda a, i: CASE WHEN i = hit THEN {adopt.replace('b.', 's.b.')} ELSE a END)".replace("hit", f"({hit})")
    return f"""s AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS k, {fields} AS b FROM {source}),
r AS (SELECT {key}, 1::BIGINT AS k, [b] AS kept FROM s WHERE k = 1 UNION ALL SELECT {keys}, r.k + 1, CASE WHEN ({hit}) IS NULL THEN list_append(r.kept, s.b) ELSE {taken} END FROM r JOIN s ON {on} AND s.k = r.k + 1),
l AS (SELECT {key}, arg_max(kept, k) AS kept FROM r GROUP BY {key}), u AS (SELECT {key}, unnest(kept) AS b FROM l)"""
