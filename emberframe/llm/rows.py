"""Rows of a stored table: their numbers, their order, and keeping those that an operator has decided for."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberframe.session import cut, stored

BROADCAST_ROWS = 200_000  #: dropped rows that are sent to every task, at most; more are shuffled


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a number per row and the name of its column, which docs didn't have: later scans read the same numbers however they are split.

    Rows of a table read from Parquet are numbered by their file and their place in it, so no copy is stored; a list of the files, which
    the driver has made to read them, goes to every task. Other DataFrames are stored once with their numbers.
    """
    name = fresh(docs, "row_number")
    place = _place(docs)
    if place is None:
        return stored(docs.withColumn(name, F.monotonically_increasing_id()), "numbered"), name
    path = fresh(docs, "file_path")
    files = sorted(r[0] for r in docs.select(place["file_path"]).distinct().collect())
    known = docs.sparkSession.createDataFrame([(f, i << 40) for i, f in enumerate(files)], f"{path} string, {name} long")
    held = docs.withColumns({path: place["file_path"], fresh(docs, "row_index"): place["row_index"]})
    numbers = held.join(F.broadcast(known), path)
    return numbers.select(*docs.columns, (F.col(name) + F.col(fresh(docs, "row_index"))).alias(name)), name


def row_of(row: str | None = None) -> Column:
    """The number of a row: the stored one of this column, or one that is good for a single scan."""
    return F.col(row) if row else F.monotonically_increasing_id()


def keep_rows(docs: DataFrame, row: str, decided: DataFrame) -> DataFrame:
    """Numbered docs' rows whose number isn't dropped in decided (row, kept), in docs' columns."""
    dropped = cut(decided.where("NOT kept").select(F.col("row").alias(row)))
    few = dropped.count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(dropped) if few else dropped, row, "left_anti").select(*docs.columns)


def _place(docs: DataFrame) -> Column | None:
    """The metadata column of a table read from Parquet, or None for other DataFrames."""
    try:
        place = docs.metadataColumn("_metadata")
        docs.select(place["file_path"], place["row_index"]).schema  # noqa: B018  resolves the columns
    except AnalysisException:
        return None
    return place


def stored_order(docs: DataFrame) -> list[Column]:
    """Columns by which a table read from Parquet stands in the order that it was written in (files are numbered by partition); none for other DataFrames."""
    place = _place(docs)
    return [] if place is None else [place["file_name"], place["row_index"]]
