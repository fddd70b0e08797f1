"""Mixing sources to target weights by systematic sampling.

Every document of a source has the same expected number of copies, its source's target over its source's size. The
documents of a source are put in order of size, their expected copies are summed up along that order, and with one
random offset per source a document is taken once per integer that its part of the sum crosses. The order by size makes
the words taken come near the target. The ranks behind the prefix sums come from range partitions: a source, or a
size within it, may hold any share of the rows, as ties are split by a hash of the identifier.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.llm.shared import WORD, checkpointed

CYCLE, MOST = 3, 3


def word_count(text: str = "text") -> Column:
    """Number of runs of characters other than ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame) -> DataFrame:
    """source, source_size, target: sources by code point, null last, weigh 1, 2, 3, 1, ...; no target is above 3 times its
    source's size, and the excess is shared again by weight. Works on one row per source.

    With the sources in order of cap / weight, those before the first whose share fits are the ones that are capped,
    so one pass replaces the repeated sharing.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.orderBy(F.col("source").asc_nulls_last())
    totals = totals.withColumn("weight", ((F.row_number().over(everything) - 1) % CYCLE + 1).cast("double"))
    by_room = Window.orderBy((F.col("source_size") * MOST / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, whole = by_room.rowsBetween(Window.unboundedPreceding, -1), by_room.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nothing = F.lit(0)
    t = totals.withColumns({
        "rest": F.sum("source_size").over(whole) - MOST * F.coalesce(F.sum("source_size").over(before), nothing),
        "rest_weight": F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), nothing),
    })
    t = t.withColumn("capped", F.col("rest") / F.col("rest_weight") > F.col("source_size") * MOST / F.col("weight"))
    level = F.max(F.when(~F.col("capped"), F.struct("rest_weight", "rest"))).over(whole)
    t = t.withColumn("level", level)
    share = F.col("weight") * F.col("level.rest") / F.col("level.rest_weight")
    return t.select("source", "source_size", F.when(F.col("capped"), F.col("source_size").cast("double") * MOST).otherwise(share).alias("target"))


def ranked(sized: DataFrame) -> DataFrame:
    """sized with part, the range partition, and its rank within part and source in the order (size, hash, doc_id)."""
    order = ["size", "hash", "doc_id"]
    spread = sized.withColumn("hash", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    spread = spread.withColumn("row", F.monotonically_increasing_id())
    parts = checkpointed(spread.repartitionByRange("source", *order, "row").withColumn("part", F.spark_partition_id()))
    return parts.withColumn("rank", F.row_number().over(Window.partitionBy("part", "source").orderBy(*(F.col(c).asc_nulls_last() for c in order))))


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for every row of docs.

    Null text has size 0; documents of size 0 take up sum as any other but add no words. A null source is a source of
    its own, last in order. Repeated rows count as documents of their own. An empty table gives no rows. The
    result depends on the rows alone, not on their order or partitions.
    """
    sized = checkpointed(docs.select("doc_id", "source", word_count().alias("size")))
    places = ranked(sized)
    counts = places.groupBy("part", "source").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("skipped", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    targets = source_targets(sized).withColumnRenamed("source", "_source")
    per_part = counts.join(targets, F.col("source").eqNullSafe(F.col("_source"))).select(F.col("part").alias("_part"), "_source", "skipped", "source_size", "target")
    rows = places.join(per_part, (F.col("part") == F.col("_part")) & F.col("source").eqNullSafe(F.col("_source")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    key = F.md5(F.concat(F.lit("mix:"), F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null"))))
    offset = F.conv(F.substring(key, 1, 4), 16, 10).cast("double") / 65536
    rows = rows.withColumns({"rate": rate, "offset": offset, "place": F.col("rank") + F.col("skipped")})
    copies = F.floor(F.col("rate") * F.col("place") + F.col("offset")) - F.floor(F.col("rate") * (F.col("place") - 1) + F.col("offset"))
    rows = rows.withColumn("copies", F.least(copies, F.lit(MOST)).cast("long"))
    return rows.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def take_copies(docs: DataFrame) -> DataFrame:
    """docs with each row as often as the mix takes it (0 to 3 times), in its own columns.

    Rows with the same doc_id, source and size share their copies out in turn.
    """
    plan = mix(docs).groupBy("doc_id", "source", "size").agg(F.sum("copies").alias("copies"), F.count("*").alias("times")).where("copies > 0")
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole")
    sized = docs.select(whole, F.col("doc_id").alias("id"), F.col("source").alias("from"), word_count().alias("n"))
    joined = sized.join(plan, F.col("id").eqNullSafe(F.col("doc_id")) & F.col("from").eqNullSafe(F.col("source")) & (F.col("n") == F.col("size")))
    single = joined.where("times = 1").select("whole", F.col("copies").cast("int").alias("each"))
    turn = F.row_number().over(Window.partitionBy("id", "from", "n").orderBy("whole.text"))
    several = joined.where("times > 1").withColumn("turn", turn)
    share = F.floor(F.col("copies") * F.col("turn") / F.col("times")) - F.floor(F.col("copies") * (F.col("turn") - 1) / F.col("times"))
    both = single.unionByName(several.select("whole", share.cast("int").alias("each")))
    return both.select("whole", F.explode(F.array_repeat(F.lit(1), F.col("each")))).select("whole.*")


ORACLE_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), totals AS (
  SELECT source, sum(size)::BIGINT AS source_size, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight
  FROM sized GROUP BY source
), rest AS (
  SELECT *, (sum(source_size) OVER ())::DOUBLE - 3 * coalesce(sum(source_size) OVER b, 0)::DOUBLE AS rest,
         sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS rest_weight
  FROM totals
  WINDOW b AS (ORDER BY source_size * 3 / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), flagged AS (
  SELECT *, rest / rest_weight > source_size * 3 / weight AS capped FROM rest
), level AS (
  SELECT arg_max(rest, rest_weight) AS rest, max(rest_weight) AS rest_weight FROM flagged WHERE NOT capped
), targets AS (
  SELECT f.source, f.source_size, CASE WHEN capped THEN f.source_size::DOUBLE * 3 ELSE f.weight * level.rest / level.rest_weight END AS target,
         ('0x' || substr(md5('mix:' || coalesce('=' || f.source, 'null')), 1, 4))::INTEGER::DOUBLE / 65536 AS off
  FROM flagged f, level
), placed AS (
  SELECT s.*, row_number() OVER (PARTITION BY source ORDER BY size, md5(coalesce(doc_id::VARCHAR, '')), doc_id NULLS LAST) AS place FROM sized s
), rated AS (
  SELECT p.*, t.source_size, t.target, t.off, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate
  FROM placed p JOIN targets t ON p.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (least(floor(rate * place + off) - floor(rate * (place - 1) + off), 3)::BIGINT * size)::BIGINT AS taken
FROM rated
"""
