"""Exact duplicates by a tree merge of sorted digest runs, in DataFrame operations only.

Each input partition is a run: its rows are reduced, in digest order, to one entry per digest with the smallest
identifier and the number of rows. Runs then merge in rounds, ``fan_in`` neighbours at a time (so many binomial
rounds at once), until one run is left, hashed over all partitions by digest. An entry is verified at every level: two
rows meet only where the SHA-256 digest, a second hash of another family and the length all agree. The result walks
down the same tree, so no join has a key with more rows than ``fan_in`` entries of a level, or one run's own rows: a
group with a third of all rows is spread over as many keys as there are runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.shared import GAP, checkpointed, text_or_empty

KEY = ["digest", "proof", "n_chars"]


def normalised(text: str = "text") -> Column:
    """Null counts as empty; each run of white space becomes one space."""
    return F.regexp_replace(text_or_empty(text), GAP, " ")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and what identifies its text; the text itself is read once and not carried on."""
    norm = docs.select(F.col(id_col).alias("doc_id"), normalised(text_col).alias("norm"))
    return norm.select("doc_id", F.unhex(F.sha2("norm", 256)).alias("digest"), F.xxhash64("norm").alias("proof"), F.length("norm").alias("n_chars"))


def exact_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", runs: int | None = None, fan_in: int = 8) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, and digest, proof and n_chars.

    The row with the smallest doc_id of equal texts stays; null ids come last. Of rows that repeat that doc_id with the
    same text exactly one stays. Null text equals empty text, and whole texts count, whatever their length. An empty table gives no
    rows; other columns are ignored, whatever they are called. There are as many runs as shuffle partitions, 64 at least,
    so that a group of any size is spread over all of them.
    """
    runs = runs or max(64, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = digests(docs, id_col, text_col).withColumns({"run": F.spark_partition_id() % runs, "row": F.monotonically_increasing_id()})
    rows = checkpointed(rows)
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    level = rows.groupBy("run", *KEY).agg(F.min(first).alias("first"), F.count("*").alias("n"))
    levels = [level]
    left = runs
    while left > 1:
        up = (F.col("run") / fan_in).cast("int").alias("run")
        levels.append(levels[-1].groupBy(up, *KEY).agg(F.min("first").alias("first"), F.sum("n").alias("n")))
        left = -(-left // fan_in)
    found = levels.pop()
    while levels:
        child = levels.pop().select("run", *KEY, (F.col("run") / fan_in).cast("int").alias("up"))
        found = child.join(found.withColumnRenamed("run", "up"), ["up", *KEY]).drop("up")
    out = rows.join(found, ["run", *KEY])
    return out.select("doc_id", F.col("first.doc_id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("row") == F.col("first.row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), *KEY)


def drop_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **tree) -> DataFrame:
    """docs without the rows that exact_groups drops, in its own columns.

    Rows are found again by identifier and text digest. Rows that repeat both are numbered, and the first one stays;
    they are the only rows that a window sees.
    """
    groups = exact_groups(docs, id_col=id_col, text_col=text_col, **tree)
    keep = groups.groupBy("doc_id", *KEY).agg(F.count("*").alias("times"), F.max("kept").alias("any_kept")).where("any_kept")
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole")
    marked = docs.select(whole, F.col(id_col).alias("id"), normalised(text_col).alias("norm"))
    marked = marked.select("whole", "id", F.unhex(F.sha2("norm", 256)).alias("digest"), F.xxhash64("norm").alias("proof"), F.length("norm").alias("n_chars"))
    keep = keep.withColumnsRenamed({k: f"{k}_kept" for k in KEY})
    same = F.col("id").eqNullSafe(F.col("doc_id"))
    for k in KEY:
        same = same & (F.col(k) == F.col(f"{k}_kept"))
    joined = marked.join(keep, same)
    once = joined.where("times = 1").select("whole.*")
    again = joined.where("times > 1").dropDuplicates(["id", *KEY]).select("whole.*")
    return once.unionByName(again)


ORACLE_SQL = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id) = 1 AS kept, text_sha256
FROM t WINDOW g AS (PARTITION BY text_sha256)
"""
