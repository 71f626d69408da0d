"""Mixing sources to target weights by systematic sampling.

Within a source every document has the same expected number of copies, target / size
of the source. The documents of a source are laid on a line in order of size, each as
long as its expected copies, the line is shifted by one random offset per source, and
a document is emitted once for each integer boundary that it covers. The order by size
makes the sample stratified, so the words taken come near the target.

A prefix sum over a source would put a hot source in one task. The position on the
line is therefore added up from three parts: counts of smaller sizes (one row per
distinct size), counts of lower buckets of the same size (at most BUCKETS rows), and the
rank inside one bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verilake.llm.common import cut, table

#: Buckets of the ids, by the first three hex digits of their md5.
BUCKETS = 16**3
WEIGHTS = (5.0, 2.0, 1.0)
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(totals: DataFrame, weights=WEIGHTS, share=1.5, cap=2.0) -> DataFrame:
    """One row per source (key, source, source_size) -> the same with target.

    Sources by code point, null last, get the weights in turn. All targets add up to
    share x all sizes, unless cap x size stops every source. A target is
    min(cap x size, level x weight) with one common level, which is what repeated
    resharing of the excess by weight comes to.
    """
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    ordered = Window.orderBy("_ratio", "_key")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    rows = (
        totals.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")))
        .withColumn("_cap", F.lit(float(cap)) * F.col("source_size"))
        .withColumn("_ratio", F.col("_cap") / F.col("_w"))
        .withColumn("_left", F.lit(float(share)) * F.sum("source_size").over(every) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
        .withColumn("_open", F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
        .withColumn("_level", F.col("_left") / F.col("_open"))
        .withColumn("_at", F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "_key", "_level"))).over(every))
    )
    level = F.col("_at._level")
    target = F.when(level.isNull(), F.col("_cap")).otherwise(F.least("_cap", level * F.col("_w")))
    return rows.select("_key", "source", "source_size", target.alias("target"))


def mix_sources(docs: DataFrame, seed=7, weights=WEIGHTS, share=1.5, cap=2.0, id_col="doc_id", text_col="text", source_col="source") -> DataFrame:
    """One row per document: id, source, size, source_size, target, copies, taken, text_hash.

    Size is the number of words; null and empty texts have size 0 and take 0 words. A
    null source is a source of its own. Repeated rows are separate items. No document
    gets more than ceil(cap) copies. The same seed gives the same sample whatever the
    partitioning. Other columns are ignored; an empty table gives an empty result.
    """
    base = cut(
        docs.select(
            F.col(id_col).alias("_id"),
            F.col(source_col).alias("source"),
            F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("n")).alias("_key"),
            F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            F.xxhash64(text_col).alias("text_hash"),
            F.coalesce(F.conv(F.substring(F.md5(F.col(id_col).cast("string")), 1, 3), 16, 10).cast("int"), F.lit(-1)).alias("_bucket"),
        )
    )
    cells = base.groupBy("_key", "size", "_bucket").agg(F.count("*").alias("_n"))
    lower = Window.partitionBy("_key", "size").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("_lower", F.coalesce(F.sum("_n").over(lower), F.lit(0)))
    sizes = base.groupBy("_key", "size").agg(F.count("*").alias("_all"))
    smaller = Window.partitionBy("_key").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_key", "size", F.coalesce(F.sum("_all").over(smaller), F.lit(0)).alias("_smaller"))
    offsets = cells.join(sizes, ["_key", "size"]).select("_key", "size", "_bucket", (F.col("_lower") + F.col("_smaller")).alias("_before"))
    totals = base.groupBy("_key", "source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(totals, weights, share, cap).drop("source")
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("_key"))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    inside = F.row_number().over(Window.partitionBy("_key", "size", "_bucket").orderBy("_id", "text_hash"))
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    placed = (
        base.withColumn("_inside", inside)
        .join(offsets, ["_key", "size", "_bucket"])
        .join(targets, "_key")
        .withColumn("_at", F.col("_before") + F.col("_inside"))
        .withColumn("_each", each)
        .withColumn("_u", offset)
        .withColumn("copies", F.floor(F.col("_at") * F.col("_each") + F.col("_u")) - F.floor((F.col("_at") - 1) * F.col("_each") + F.col("_u")))
    )
    return placed.select(F.col("_id").alias(id_col), "source", "size", "source_size", "target", F.col("copies").cast("long").alias("copies"), (F.col("copies") * F.col("size")).cast("long").alias("taken"), "text_hash")


def emit_mixture(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", **options) -> DataFrame:
    """The mixture itself: every document as often as it has copies, in its own columns, whatever their names.

    The copies of equal (id, source, text) rows are dealt to those rows one by one, in order
    of a hash of all their columns. Documents of size 0 take no words; they stay once if
    their number of copies isn't 0.
    """
    mixed = mix_sources(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    key = {"id": F.col(id_col), "source": F.col(source_col), "hash": F.xxhash64(text_col)}
    dealt = mixed.filter("copies > 0").groupBy(F.struct(F.col(id_col).alias("id"), "source", F.col("text_hash").alias("hash")).alias("same")).agg(F.sort_array(F.collect_list("copies")).alias("dealt"))
    hashed = [c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    own = docs.select(F.struct(*docs.columns).alias("row"), F.struct(*[c.alias(k) for k, c in key.items()]).alias("key"), F.xxhash64(*hashed).alias("every"))
    joined = own.join(dealt, F.col("key").eqNullSafe(F.col("same")))
    nth = F.row_number().over(Window.partitionBy("key").orderBy("every"))
    copies = joined.withColumn("n", F.coalesce(F.try_element_at("dealt", nth), F.lit(0)).cast("int")).filter("n > 0")
    return copies.select("row", F.explode(F.sequence(F.lit(1), F.col("n")))).select("row.*")


def op9_mixing(spark, sf_dir):
    """All documents mixed by systematic sampling."""
    mixed = mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH base AS (
  SELECT doc_id, source, coalesce('s' || source, 'n') AS k,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         coalesce(('0x' || substr(md5(doc_id::VARCHAR), 1, 3))::BIGINT, -1) AS bucket
  FROM documents),
totals AS (SELECT k, source, sum(size)::BIGINT AS source_size FROM base GROUP BY ALL),
weighted AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap,
         [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w
  FROM totals),
levels AS (
  SELECT *, cap / w AS ratio,
         (1.5::DOUBLE * sum(source_size) OVER ()
           - coalesce(sum(cap) OVER (ORDER BY cap / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM weighted),
targets AS (
  SELECT k, source_size, coalesce(least(cap, w * (SELECT arg_min(level, (ratio, k)) FROM levels WHERE level <= ratio)), cap) AS target
  FROM levels),
placed AS (
  SELECT doc_id, size, source_size, target,
         row_number() OVER (PARTITION BY k ORDER BY size, bucket, doc_id) AS pos,
         CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS each,
         ('0x' || substr(md5('7:' || k), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
  FROM base JOIN targets USING (k))
SELECT doc_id, size, source_size, target::DOUBLE AS target,
       ((floor(pos * each + u) - floor((pos - 1) * each + u))::BIGINT * size)::BIGINT AS taken
FROM placed
"""
