"""Mixing sources to target weights along a time-varying curriculum.

Each source gets a target number of words from its weight. Its share of the mix changes over training time t in 0..1:
the rate is target * (1 + slope * (2t - 1)), whose integral is the target. Documents of a source stand in a fixed random
order; the words before a document are the demand at which it is due, and inverting the integrated rate gives the time,
its training position. A second pass over the source follows where the target exceeds its size. Positions of all
sources together, sorted by range, are the training order.

Sums along a source's order are formed per bucket of the order, then over the buckets, so that no source has to fit a task.

Defined results. A null text has size 0. A null source is a source of its own, the last. Sources without words have
target 0. A document of size 0 takes no words; it has a position if its turn comes before the target. Rows with the same doc_id
are documents of their own, in the order of their sizes. An empty table gives no rows. Columns of docs that clash with
the result's names are kept out of the plan; mix() returns docs' own columns only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from emberframe.llm.rows import numbered, row_of
from emberframe.session import cut, shuffle_partitions

WORD = "[^\\x20\\x09-\\x0D]+"
WEIGHTS = (3, 1, 2)  #: by the sources' code point order, repeating
SLOPES = (-0.5, 0.5, 0.0)  #: of the share over time, beside WEIGHTS
SHARE = 1.5  #: words of the mix for each word of the corpus
MOST = 2.0  #: times a source's size that its target is at most
BUCKET_ROWS = 1024  #: documents of a source's bucket, about
BROADCAST_SOURCES = 10_000  #: a table of more sources is joined by shuffle
BROADCAST_BUCKETS = 100_000  #: more of them aren't sent to every task, and texts are joined with their positions by a shuffle of their own
SALTS = 64


def size_of(text: str | Column) -> Column:
    return F.regexp_count(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), F.lit(WORD)).cast("long")


def identity(id_col: str, source_col: str, row: str | None) -> list[Column]:
    """doc_id, source, order (a fixed random order by doc_id), row."""
    digest = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    return [F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.conv(F.substring(digest, 1, 8), 16, 10).cast("long").alias("order"), row_of(row).alias("row")]


def bucket_of(order: Column, n: Column) -> Column:
    """The bucket of a source's order, of n documents."""
    buckets = F.ceil(n / BUCKET_ROWS)
    return F.least(F.floor(order / F.lit(4294967296.0) * buckets), buckets - 1)


def pick(values: tuple, place: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (place % len(values) + 1).cast("int"))


def source_targets(keyed: DataFrame, weights=WEIGHTS, slopes=SLOPES, share: float = SHARE, most: float = MOST) -> DataFrame:
    """A row per source: place, source_size, n, weight, slope, target. Windows here run over sources, not documents."""
    sources = keyed.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    sources = sources.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    sources = sources.withColumns({"weight": pick(tuple(map(float, weights)), F.col("place")), "slope": pick(slopes, F.col("place")), "cap": F.col("source_size") * F.lit(most)})
    # sources reach their caps in the order of cap / weight; the level is what a unit of weight gets once those before are full
    filling = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    full_before = F.coalesce(F.sum("cap").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    weight_left = F.sum("weight").over(filling.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("source_size").over(Window.partitionBy()) * F.lit(share)
    sources = sources.withColumn("level", (total - full_before) / weight_left)
    sources = sources.withColumn("full", F.col("cap") / F.col("weight") <= F.col("level"))
    level = F.min_by(F.when(~F.col("full"), F.col("level")), F.when(~F.col("full"), F.struct(F.col("cap") / F.col("weight"), F.col("place")))).over(Window.partitionBy())
    return sources.select("source", "place", "source_size", "n", "weight", "slope", F.when(F.col("full"), F.col("cap")).otherwise(F.col("weight") * level).alias("target"))


def with_sources(keyed: DataFrame, sources: DataFrame) -> DataFrame:
    """The source's row beside each document, however many documents one source has."""
    names = [c for c in sources.columns if c != "source"]
    renamed = sources.withColumnRenamed("source", "its_source")
    same = F.col("source").eqNullSafe(F.col("its_source"))
    if sources.count() <= BROADCAST_SOURCES:
        return keyed.join(F.broadcast(renamed), same).select(*keyed.columns, *names)
    salted = renamed.withColumn("its_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return keyed.withColumn("salt", F.pmod(F.col("row"), F.lit(SALTS)).cast("int")).join(salted, same & (F.col("salt") == F.col("its_salt"))).select(*keyed.columns, *names)


def due(demand: Column, target: Column, slope: Column) -> Column:
    """The time at which the integrated schedule reaches demand: the root of target * (t + slope * (t^2 - t)) = demand."""
    u, g = demand / target, slope
    return 2.0 * u / ((1.0 - g) + F.sqrt((1.0 - g) * (1.0 - g) + 4.0 * g * u))


def in_bucket(last: int) -> WindowSpec:
    """A bucket's documents in their order, from the first one to this many after the current."""
    return Window.partitionBy("place", "bucket").orderBy("order", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, last)


def passes_of(most: float) -> range:
    return range(int(-(-most // 1)))


def placed(keyed: DataFrame, sources: DataFrame, most: float) -> DataFrame:
    """keyed's documents with their source's row, bucket and times: for each pass over the source the training position, null where the mix doesn't take it."""
    both = with_sources(keyed, sources)
    both = cut(both.withColumn("bucket", bucket_of(F.col("order"), F.col("n"))))
    # a bucket's documents come whole to one task, at most about BUCKET_ROWS of them; the sums of buckets are few
    sums = both.groupBy("place", "bucket").agg(F.sum("size").alias("bucket_size"))
    earlier = F.sum("bucket_size").over(Window.partitionBy("place").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select("place", "bucket", F.coalesce(earlier, F.lit(0)).alias("bucket_start"))
    both = both.withColumn("inside", F.coalesce(F.sum("size").over(in_bucket(-1)), F.lit(0))).join(sums, ["place", "bucket"])
    begins = [F.col("bucket_start") + F.col("inside") + p * F.col("source_size") for p in passes_of(most)]
    taken = [(b + F.col("size") / 2.0 <= F.col("target")) & (F.col("target") > 0) for b in begins]
    return both.withColumn("times", F.array(*[F.when(t, due(b.cast("double"), F.col("target"), F.col("slope"))) for b, t in zip(begins, taken, strict=True)]))


def plan(docs: DataFrame, weights=WEIGHTS, slopes=SLOPES, share: float = SHARE, most: float = MOST, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row: str | None = None) -> DataFrame:
    """A row per document: doc_id, size, source_size, target, taken, passes, positions (one for each pass), row."""
    keyed = cut(docs.select(*identity(id_col, source_col, row), size_of(text_col).alias("size")))
    sources = cut(source_targets(keyed, weights, slopes, share, most))
    positions = F.filter("times", lambda x: x.isNotNull())
    passes = F.size(positions).cast("long")
    return placed(keyed, sources, most).select("doc_id", "size", "source_size", "target", (F.col("size") * passes).alias("taken"), passes.alias("passes"), positions.alias("positions"), "row")


def mix(docs: DataFrame, weights=WEIGHTS, slopes=SLOPES, share: float = SHARE, most: float = MOST, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs' rows in training order, as often as the mix takes them; docs' own columns. Written, its files follow the order; rows.stored_order() gives it back.

    Texts are shuffled once, straight to the part of the training time that they belong to. The plan is made without them; a row of a text learns its
    parts from where they begin in its source's order, which is told for each bucket, and its position where it meets the plan's rows of that part.
    """
    held, row = numbered(docs)
    keyed = cut(held.select(*identity(id_col, source_col, row), size_of(text_col).alias("size")))
    sources = cut(source_targets(keyed, weights, slopes, share, most))
    parts = shuffle_partitions(docs.sparkSession)
    words, bent = sources.agg(F.coalesce(F.sum("target"), F.lit(0.0)), F.coalesce(F.sum(F.col("target") * F.col("slope")), F.lit(0.0))).first()
    # the mix's words up to a time are words * t + bent * (t^2 - t), so parts of equal words need no sample
    part_at = lambda t: F.when(t.isNotNull() & F.lit(words > 0), F.least(F.floor(F.lit(parts / (words or 1.0)) * (words * t + bent * (t * t - t))), F.lit(parts - 1))).otherwise(F.lit(parts))
    # no part comes before one that earlier documents of the bucket have, whatever the last bits of times
    timed = placed(keyed, sources, most)
    passes = [F.struct(F.lit(p).alias("pass"), F.max(part_at(F.get("times", F.lit(p)))).over(in_bucket(0)).cast("int").alias("part"), F.get("times", F.lit(p)).alias("time")) for p in passes_of(most)]
    planned = cut(timed.withColumn("of", F.array(*passes)).select("place", "bucket", "order", "doc_id", "size", "row", F.explode("of").alias("of")).select("place", "bucket", "order", "doc_id", "size", "row", "of.*"))
    begins = planned.groupBy("place", "bucket", "pass", "part").agg(F.min(F.struct("order", "doc_id", "size", "row")).alias("first"))
    buckets = cut(begins.groupBy("place", "bucket").agg(F.collect_list(F.struct("pass", "part", F.struct("first.order", "first.doc_id").alias("at"), F.struct("first.size", "first.row").alias("then"))).alias("begins")))
    wanted = planned.where(F.col("time").isNotNull()).select("part", "pass", "row", "time")
    texts = held.select(F.struct(*docs.columns).alias("doc"), *identity(id_col, source_col, row))
    if buckets.count() > BROADCAST_BUCKETS:  # most likely for having that many sources
        joined = texts.select("doc", "row").join(wanted, "row")
        return joined.orderBy("time", F.col("doc")[id_col], "row").select("doc.*")
    bucketed = with_sources(texts, sources).withColumn("bucket", bucket_of(F.col("order"), F.col("n"))).join(F.broadcast(buckets), ["place", "bucket"])
    at, then = F.struct("order", "doc_id"), F.struct(size_of(F.col("doc")[text_col]).alias("size"), F.col("row"))  # words are counted again for equal doc_ids alone
    begun = lambda p: F.filter("begins", lambda x: (x["pass"] == p) & ((at > x["at"]) | ((at == x["at"]) & (then >= x["then"]))))
    own = F.array(*[F.struct(F.lit(p).alias("pass"), F.array_max(F.transform(begun(p), lambda x: x["part"])).alias("part")) for p in passes_of(most)])
    dealt = bucketed.withColumn("of", F.explode(own)).select("doc", "row", "of.*").where(F.col("part") < parts)
    met = dealt.repartitionById(parts, F.col("part")).join(wanted.repartitionById(parts, F.col("part")), ["part", "pass", "row"])
    return met.sortWithinPartitions("time", F.col("doc")[id_col], "row").select("doc.*")


def ordered_plan(docs: DataFrame, **options) -> DataFrame:
    """The plan in the order of first training positions; documents that the mix leaves out come last."""
    place = lambda i: F.get("positions", F.lit(i))
    planned = plan(docs, **options).withColumns({"first_position": place(0), "second_position": place(1)})
    return planned.orderBy(F.col("first_position").asc_nulls_last(), "doc_id", "row").drop("row", "positions")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, CAST('0x' || left(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 8) AS BIGINT) AS ord FROM documents
), s0 AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source
), s1 AS (
  SELECT *, CASE place % 3 WHEN 0 THEN 3e0 WHEN 1 THEN 1e0 ELSE 2e0 END AS weight, CASE place % 3 WHEN 0 THEN -5e-1 WHEN 1 THEN 5e-1 ELSE 0e0 END AS slope, source_size * 2e0 AS cap FROM s0
), s2 AS (
  SELECT *, (sum(source_size) OVER () * 15e-1 - coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0)) / sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s1
), s3 AS (
  SELECT *, cap / weight <= level AS is_full FROM s2
), s4 AS (
  SELECT source, source_size, slope, CASE WHEN is_full THEN cap ELSE weight * (SELECT arg_min(level, cap / weight) FROM s3 WHERE NOT is_full) END AS target FROM s3
), p AS (
  SELECT d.doc_id, d.size, s4.source_size, s4.target, s4.slope, CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.ord, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM d JOIN s4 ON d.source IS NOT DISTINCT FROM s4.source
), q AS (
  SELECT *, target > 0 AND start + size / 2e0 <= target AS one, target > 0 AND start + source_size + size / 2e0 <= target AS two, start / target AS u, (start + source_size) / target AS v FROM p
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(size * (CAST(one AS INT) + CAST(two AS INT)) AS BIGINT) AS taken, CAST(CAST(one AS INT) + CAST(two AS INT) AS BIGINT) AS passes,
  CASE WHEN one THEN 2e0 * u / ((1e0 - slope) + sqrt((1e0 - slope) * (1e0 - slope) + 4e0 * slope * u)) END AS first_position,
  CASE WHEN two THEN 2e0 * v / ((1e0 - slope) + sqrt((1e0 - slope) * (1e0 - slope) + 4e0 * slope * v)) END AS second_position
FROM q
"""
