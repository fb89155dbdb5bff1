"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import math
import sys
import types

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestra.operators.graph import components, cut, shared_dir  # noqa: F401

#: Stands for a null id inside the operators; results carry the null again.
NULL_ID = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_columns(docs: DataFrame, *more: str) -> DataFrame:
    """(id, text, *more) of docs; a null id as NULL_ID, a null text as the empty one."""
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
        *more,
    )


def numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with its columns called c0, c1 and so on, which clash with nothing that an operator adds, and these names by the old ones."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), dict(zip(docs.columns, names, strict=True))


def in_order(df: DataFrame) -> Column:
    """A struct of those columns of df that have an order (maps have none), for choosing one of several rows."""
    return F.struct(F.lit(0).alias("first"), *[f.name for f in df.schema.fields if not any(k in f.dataType.simpleString() for k in ("map<", "variant"))])


def id_key(c: str) -> Column:
    """An id column as a long that is never null."""
    return F.coalesce(F.col(c).cast("long"), F.lit(NULL_ID))


def real_id(c: str | Column) -> Column:
    return F.nullif(F.col(c) if isinstance(c, str) else c, F.lit(NULL_ID))


def slices(batch, column: str, size: int = 4 << 20):
    """The Arrow batch in slices of about size bytes of its string column, a row at least."""
    import pyarrow.compute as pc

    ends = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    k = 0
    while k < batch.num_rows:
        z = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + size)))
        yield batch.slice(k, z - k)
        k = z


def worker_cache() -> dict:
    """A dictionary that lives as long as the Python worker, across tasks."""
    return sys.modules.setdefault("_attestra_worker_cache", types.ModuleType("_attestra_worker_cache")).__dict__


def gapless_rank(df: DataFrame, keys: list[str], order: list[str], out: str, rows: int, chunk: int = 20_000) -> DataFrame:
    """df with out: its place, from 0 and without gaps, among the rows of equal keys.

    No task sees all rows of a key: rows are dealt over hash chunks, counted by (keys, chunk), and
    a chunk's first place is the running sum of the counts before it; the only window over a whole
    key runs over these counts. rows: about the number of rows of df, which sets the chunks.
    Places follow (chunk, order); rows that agree in all of order are interchangeable.
    """
    n = max(1, math.ceil(rows / chunk))
    df = df.withColumn("_chunk", F.pmod(F.xxhash64(*order), F.lit(n)).cast("int"))
    null_safe = [F.coalesce(F.col(k).cast("string"), F.lit("\0")).alias(f"_k{i}") for i, k in enumerate(keys)]
    df = df.select("*", *null_safe)
    ks = [f"_k{i}" for i in range(len(keys))]
    counts = df.groupBy(*ks, "_chunk").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*ks).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(*ks, "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    place = F.row_number().over(Window.partitionBy(*ks, "_chunk").orderBy(*order)) - 1
    ranked = df.withColumn("_place", place).join(first, [*ks, "_chunk"])
    return ranked.withColumn(out, F.col("_first") + F.col("_place")).drop(*ks, "_chunk", "_first", "_place")
