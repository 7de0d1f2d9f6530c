"""Stored tables: merging rows by key into Parquet tables partitioned by day, and planning what is still to be fetched.

A merge reads the partitions that its rows touch, keeps one row per key and writes those partitions anew, all of them when the job
commits (dynamic partition overwrite). It is decided from the rows alone, so a run that was interrupted is run again and replaces itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberframe.functions.geo import split_box
from emberframe.session import cut

WORLD = -1  #: both numbers of the cell that stands for the whole world
RETRY_SECONDS = 600


def stored_rows(spark: SparkSession, path: str, schema) -> DataFrame:
    """The table, or no rows where nothing has been stored yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def merge(rows: DataFrame, path: str, key: Sequence[str], by: str, order: str | None = None) -> DataFrame:
    """Merges rows into the table at path, partitioned by `by` (one of the key's columns): a row replaces the stored one of its key, the last by `order` of several. Returns the table.

    Columns that the stored row has and the new one leaves null are replaced too. Null keys are keys like any other.
    """
    spark = rows.sparkSession
    names = rows.columns
    touched = cut(rows.select(F.col(by).alias("__touched")).distinct())
    old = stored_rows(spark, path, rows.schema).select(*names)
    kept = old.join(touched, F.col(by).eqNullSafe(F.col("__touched")), "left_semi").select(*names, F.lit(0).alias("new"), F.lit(None).cast(rows.schema[order].dataType if order else "int").alias("rank"))
    fresh = rows.select(*names, F.lit(1).alias("new"), (F.col(order) if order else F.lit(None).cast("int")).alias("rank"))
    rest = [c for c in names if c not in key]
    whole = kept.unionByName(fresh)
    last = F.max_by(F.struct(*rest), F.struct("new", "rank", F.to_json(F.struct(*rest)))).alias("r")
    merged = cut(whole.groupBy(*key).agg(last).select(*key, *[F.col(f"r.{c}").alias(c) for c in rest]).select(*names))
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
    return stored_rows(spark, path, rows.schema).select(*names)


def cells_of_boxes(boxes: DataFrame, size: float, most: int) -> DataFrame:
    """box_id, cell_x, cell_y of the lattice cells of boxes (box_id, west, south, east, north), which may cross 180 degrees; of more than `most` cells the world's cell alone."""
    clamp = lambda c, v: F.greatest(F.lit(-v), F.least(F.lit(v), F.col(c)))
    low, high = F.least(clamp("south", 90.0), clamp("north", 90.0)), F.greatest(clamp("south", 90.0), clamp("north", 90.0))
    part = boxes.select("box_id", F.explode(split_box(clamp("west", 180.0), clamp("east", 180.0))).alias("p"), low.alias("low"), high.alias("high"))
    edge = lambda v, off: F.floor((v + off) / size)
    ranges = part.select("box_id", F.greatest(F.lit(0), edge(F.col("p.west"), 180.0)).alias("x0"), F.least(F.lit(-(-360 // size) - 1), edge(F.col("p.east") - 1e-9, 180.0)).alias("x1"), F.greatest(F.lit(0), edge(F.col("low"), 90.0)).alias("y0"), F.least(F.lit(-(-180 // size) - 1), edge(F.col("high") - 1e-9, 90.0)).alias("y1"))
    ranges = ranges.select("box_id", *[F.col(c).cast("long").alias(c) for c in ("x0", "x1", "y0", "y1")]).where("x0 <= x1 AND y0 <= y1")
    cells = ranges.withColumn("cell_x", F.explode(F.sequence("x0", "x1"))).withColumn("cell_y", F.explode(F.sequence("y0", "y1"))).select("box_id", "cell_x", "cell_y").distinct()
    many = cells.groupBy("box_id").agg(F.count(F.lit(1)).alias("n"))
    wide = many.where(F.col("n") > most).select("box_id", F.lit(WORLD).cast("long").alias("cell_x"), F.lit(WORLD).cast("long").alias("cell_y"))
    return cells.join(many.where(F.col("n") <= most).select("box_id"), "box_id").unionByName(wide)


def days_to_fetch(cells: DataFrame, sources: DataFrame, days: DataFrame, coverage: DataFrame, today: str, now: int, hot_days: int = 2, hot_ttl_s: int = 2700) -> DataFrame:
    """source, cell_x, cell_y, day that must be fetched: never covered (nor by the world's cell), failed longer than RETRY_SECONDS ago, or recent and fetched too long ago.

    coverage: (source, cell_x, cell_y, day, fetched_at, status). A cell's own record counts before the world's.
    """
    asked = cells.select("cell_x", "cell_y").distinct().join(F.broadcast(sources.join(days)))  # sources and days are lists of tens
    own = coverage.select("source", "cell_x", "cell_y", "day", F.struct("fetched_at", "status").alias("own"))
    world = coverage.where((F.col("cell_x") == WORLD) & (F.col("cell_y") == WORLD)).select("source", "day", F.struct("fetched_at", "status").alias("world"))
    known = asked.join(own, ["source", "cell_x", "cell_y", "day"], "left").join(world, ["source", "day"], "left").withColumn("r", F.coalesce("own", "world"))
    age = F.lit(now) - F.col("r.fetched_at")
    hot = F.col("day") >= F.date_sub(F.lit(today).cast("date"), hot_days - 1)
    missing = F.col("r").isNull() | F.when(F.col("r.status") != "ok", age > RETRY_SECONDS).otherwise(hot & (age > hot_ttl_s))
    return known.where(missing).select("source", "cell_x", "cell_y", "day")


def fetch_tasks(missing: DataFrame, today: str, span: int) -> DataFrame:
    """source, cell_x, cell_y, first_day, last_day, days, priority: runs of successive days of each source and cell, cut after `span`, those of the newest days first."""
    from emberframe.operators.events import day_islands

    runs = day_islands(missing, span, ("source", "cell_x", "cell_y"), "day")
    return runs.withColumn("priority", F.datediff(F.lit(today).cast("date"), "last_day").cast("long"))
