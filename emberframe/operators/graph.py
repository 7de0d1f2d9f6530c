"""Connected components of large graphs, and joins of rows with a row per group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberframe.session import cut

IN_TASK = 1_000_000  #: edges that one task joins, about
HEAVY = 1000  #: groups of more than 1/HEAVY of all rows are joined by broadcast; there can't be more of them


def beside(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """rows with the columns of their group, inner. Groups above total / HEAVY rows, fewer than HEAVY of them, go to every task; the others are shuffled."""
    heavy = F.col(size) > max(1, total // HEAVY)
    first = rows.join(F.broadcast(groups.where(heavy)), key, "left")
    late = first.where(F.col(size).isNull()).select(*rows.columns).join(groups.where(~heavy), key)
    return first.where(F.col(size).isNotNull()).select(*late.columns).unionByName(late)


def forest(n: int, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of links between n members: the members that aren't the least of their component, and that least one."""
    label = np.arange(n)
    while len(x):
        p, q = label[x], label[y]
        apart = p != q
        x, y, p, q = x[apart], y[apart], p[apart], q[apart]
        np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))
        further = label[label]
        while not np.array_equal(further, label):
            label, further = further, further[further]
    moved = np.flatnonzero(label != np.arange(n))
    return moved, label[moved]


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A forest of one task's edges."""
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for batch in batches:
        a.append(batch.column(0).to_numpy(zero_copy_only=False))
        b.append(batch.column(1).to_numpy(zero_copy_only=False))
    ids, of = np.unique(np.concatenate(a + b), return_inverse=True)
    moved, least = forest(len(ids), of[: len(of) // 2], of[len(of) // 2 :])
    yield pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[least])], names=["a", "b"])


def _chosen(left: DataFrame, number: int) -> DataFrame:
    """id, next, rows: of each id on edges the least of itself and its neighbours in an order by chance that is another each round, and its edges."""
    chance = lambda c: F.struct(F.xxhash64(F.lit(number), c).alias("at"), F.col(c).alias("id"))
    both = left.select("a", "b").union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.groupBy(F.col("a").alias("id")).agg(F.min(chance("b")).alias("near"), F.count(F.lit(1)).alias("rows"))
    return near.select("id", F.least(chance("id"), F.col("near"))["id"].alias("next"), "rows")


def components(edges: DataFrame, in_task: int = IN_TASK) -> DataFrame:
    """id, component (the smallest id that can be reached) of all ids on edges (a, b); an id may also stand for itself by an edge of its own.

    Each task joins what its own edges connect. While more edges are left than a task joins, ids move to the least of their neighbours in an order by chance, and edges with
    them: a third of the ids or more goes each round, as do components that are whole. Then labels go back through the rounds. All rounds together move a few times the edges.
    """
    tasks = max(1, -(-edges.count() // in_task))
    dealt = edges.select("a", "b").coalesce(1) if tasks == 1 else edges.select("a", "b").repartition(tasks, "a")
    stars = cut(dealt.mapInArrow(_joined, "a long, b long"))
    if tasks == 1:
        return stars.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(stars.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
    left, rounds = stars, []
    while (total := left.count()) > in_task:
        step = cut(_chosen(left, len(rounds)))
        rounds.append(step)
        for end in ("a", "b"):
            left = beside(left, step.select(F.col("id").alias(end), "next", "rows"), end, "rows", total).drop(end, "rows").withColumnRenamed("next", end)
        left = cut(left.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = left.coalesce(1).mapInArrow(_joined, "a long, b long").select(F.col("a").alias("next"), F.col("b").alias("root"))
    for step in reversed(rounds):  # what an id became in a round has the label that later rounds give it, or has no edges left
        labels = cut(step.select("id", "next").join(labels, "next", "left").select("id", F.coalesce("root", "next").alias("root"))).withColumnRenamed("id", "next")
    labels = labels.withColumnRenamed("next", "id")
    names = cut(labels.groupBy("root").agg(F.min("id").alias("component"), F.count(F.lit(1)).alias("members")))
    return beside(labels, names, "root", "members", labels.count()).select("id", "component")
