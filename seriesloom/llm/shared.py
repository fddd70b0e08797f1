"""Helpers that the text operators share: reading tables, cutting lineage, batching Arrow rows."""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters: space and U+0009 to U+000D.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"
GAP = rf"[{SPACE}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; the path may be in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, and only on a local master one of our own."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="seriesloom-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder, so that a lost executor costs no more than its running tasks."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def joined_anew(rows: DataFrame, per_key: DataFrame, key: str) -> DataFrame:
    """rows with the one row that per_key has for a key of type long.

    Both sides are dealt out for this join alone, on a key that neither has been dealt out by, so that Spark can split a hot key's rows.
    """
    return rows.withColumn("_anew", -F.col(key)).join(per_key.withColumn("_anew", -F.col(key)).drop(key), "_anew").drop("_anew")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(text, UPPER, LOWER)


def small_batches(batches: Iterable[pa.RecordBatch], rows: int = 256, size: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Slices of at most so many rows and bytes of text, or a single row, so that what a task holds beside its input stays bounded."""
    for batch in batches:
        weight = np.zeros(batch.num_rows, dtype=np.int64)
        for column in batch.columns:
            if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
                weight += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(weight)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, min(start + rows, int(np.searchsorted(ends, before + size, side="right"))))
            yield batch.slice(start, stop - start)
            start = stop


def runs_of(batch: pa.RecordBatch, keys: int) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Each run of equal values in the first ``keys`` columns with its slice."""
    if not batch.num_rows:
        return
    fresh = np.zeros(batch.num_rows, dtype=bool)
    fresh[0] = True
    for column in batch.columns[:keys]:
        own = column.to_numpy(zero_copy_only=False)
        fresh[1:] |= own[1:] != own[:-1]
    cuts = [*np.flatnonzero(fresh).tolist(), batch.num_rows]
    for start, stop in zip(cuts[:-1], cuts[1:], strict=True):
        yield tuple(c[start].as_py() for c in batch.columns[:keys]), batch.slice(start, stop - start)


def groups_in_order(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, pa.Table]]:
    """Each key, the values of the first ``keys`` columns, with its rows, of batches that are sorted by them; one key at a time."""
    held: list[pa.RecordBatch] = []
    now: tuple | None = None
    for batch in batches:
        for key, part in runs_of(batch, keys):
            if key != now and held:
                yield now, pa.Table.from_batches(held)
                held = []
            now = key
            held.append(part)
    if held:
        yield now, pa.Table.from_batches(held)
