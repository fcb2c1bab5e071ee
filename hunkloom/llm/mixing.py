"""Mixing sources to target weights by systematic sampling [native].

Every document of a source is expected `target / source size` times. Within its source a
document owns the interval between two prefix sums of expected copies; the document is emitted
once per integer that the interval, shifted by one random offset of the source, crosses.

The prefix sum is distributed: rows fall into bins (source, size class, salt); a source's
bins, whose number has a fixed bound (`SALTS` times eight per binary order of magnitude), are
summed in one small array, and rows are ranked within their bin only. A hot source is spread over
all its bins, and ordering by size class makes the taken words follow the target closely.

Defined results: null text has size 0; a null source is a source of its own, last in order;
rows with equal doc_id and text are told apart by nothing, so it does not matter which one is
taken; an empty table gives an empty result; other columns of the input are carried along, those named
as an output are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Salts of a size class.
SALTS = 64
_OWN = {"_none", "_source", "_bin", "_before", "_shift", "_each", "_rank", "_tie"}
WORD = r"[^\x20\x09-\x0D]+"


def _hex(value: F.Column, digits: int) -> F.Column:
    """The first hexadecimal digits of an MD5 as a number."""
    return F.conv(F.substring(F.md5(value), 1, digits), 16, 10).cast("long")


def targets(per_source: DataFrame, weights: tuple[float, ...], cap: float) -> DataFrame:
    """Share the total size by weight; a target stops at `cap` times its source's size.

    Sources by cap/weight: the k-th is capped if its cap is at most its share of what the capped
    ones before it leave. The first that is not sets the level for all after it.
    """
    whole = W.partitionBy()
    by_name = whole.orderBy("_none", "_source")
    by_level = whole.orderBy("_level", "_none", "_source").rowsBetween(W.unboundedPreceding, W.currentRow)
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    out = per_source.withColumn("_weight", weight).withColumn("_cap", cap * F.col("source_size").cast("double")).withColumn("_level", F.col("_cap") / F.col("_weight"))
    left = F.sum("source_size").over(whole).cast("double") - (F.sum("_cap").over(by_level) - F.col("_cap"))
    share = F.sum("_weight").over(whole) - (F.sum("_weight").over(by_level) - F.col("_weight"))
    out = out.withColumn("_share", left / share)
    level = F.min_by(F.when(F.col("_level") > F.col("_share"), F.col("_share")), F.when(F.col("_level") > F.col("_share"), F.col("_level"))).over(whole)
    return out.withColumn("target", F.least("_cap", F.coalesce(level * F.col("_weight"), F.col("_cap"))))


def mix(df: DataFrame, source: str = "source", text: str = "text", key: str = "doc_id", weights: tuple[float, ...] = (1, 2, 3), cap: float = 3.0, seed: int = 1) -> DataFrame:
    """All rows with size, source_size, target and copies (how often the mix takes the row)."""
    df = df.drop(*(c for c in ("size", "source_size", "target", "copies") if c not in (source, text, key)))
    aside = {c: f"_carried_{i}" for i, c in enumerate(df.columns) if c.lower() in _OWN}  # columns that have a name used below
    df = df.withColumnsRenamed(aside)
    source, text, key = (aside.get(c, c) for c in (source, text, key))
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    bits = F.length(F.bin("size"))
    rows = df.withColumn("size", size).withColumn("_none", F.col(source).isNull()).withColumn("_source", F.coalesce(F.col(source).cast("string"), F.lit("")))
    rows = rows.withColumn("_bin", ((bits * 8 + F.expr("shiftright(size, cast(greatest(length(bin(size)) - 4, 0) as int)) & 7")) * SALTS + _hex(F.coalesce(F.col(key).cast("string"), F.lit("")), 4) % SALTS).cast("int"))
    rows = rows.withColumn("_tie", F.xxhash64(text))

    bins = rows.groupBy("_none", "_source", "_bin").agg(F.count("*").alias("n"), F.sum("size").alias("s"))
    per_source = bins.groupBy("_none", "_source").agg(F.sum("s").alias("source_size"), F.array_sort(F.collect_list(F.struct("_bin", "n"))).alias("bins"))
    start = F.aggregate("bins", F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<long>").alias("before")), lambda a, x: F.struct((a["sum"] + x["n"]).alias("sum"), F.concat(a["before"], F.array(a["sum"])).alias("before")), lambda a: a["before"])
    shift = _hex(F.concat_ws("/", F.lit(str(seed)), F.col("_none").cast("string"), "_source"), 12) / F.lit(float(16**12))
    per_source = targets(per_source, weights, cap).withColumn("_shift", shift).withColumn("_each", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
    starts = per_source.select("_none", "_source", "source_size", "target", "_shift", "_each", F.explode(F.arrays_zip(F.col("bins._bin").alias("b"), start.alias("before"))).alias("x"))
    starts = starts.select("_none", "_source", F.col("x.b").alias("_bin"), F.col("x.before").alias("_before"), "source_size", "target", "_shift", "_each")

    at = ["_none", "_source", "_bin"]
    rank = F.row_number().over(W.partitionBy(*at).orderBy("size", key, "_tie")) + F.col("_before")
    out = rows.join(starts, at).withColumn("_rank", rank)
    crossed = lambda k: F.floor(k * F.col("_each") + F.col("_shift"))
    out = out.withColumn("copies", (crossed(F.col("_rank")) - crossed(F.col("_rank") - 1)).cast("long"))
    return out.drop("_none", "_source", "_bin", "_before", "_shift", "_each", "_rank", "_tie").withColumnsRenamed({new: old for old, new in aside.items()})


def emit(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mix itself: each row as often as it is taken."""
    packed = mixed.where("copies > 0").select(F.struct(*columns).alias("row"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return packed.select("row.*")


def op2_source_mix(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


#: DuckDB: the same rule on whole tables.
OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, text, source IS NULL AS none, coalesce(source, '') AS src,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
b AS (
  SELECT *, (length(bin(size)) * 8 + ((size >> greatest(length(bin(size)) - 4, 0)::INT) & 7)) * 64
            + ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 4))::BIGINT % 64 AS bin FROM d),
s AS (SELECT none, src, sum(size)::BIGINT AS source_size FROM b GROUP BY ALL),
w AS (SELECT *, [1.0, 2.0, 3.0][((row_number() OVER (ORDER BY none, src) - 1) % 3 + 1)::INT]::DOUBLE AS weight, 3.0::DOUBLE * source_size AS cap FROM s),
l AS (SELECT *, cap / weight AS level,
        (sum(source_size) OVER () - (sum(cap) OVER o - cap)) / (sum(weight) OVER () - (sum(weight) OVER o - weight)) AS share
      FROM w WINDOW o AS (ORDER BY cap / weight, none, src ROWS UNBOUNDED PRECEDING)),
t AS (SELECT *, least(cap, coalesce((SELECT arg_min(share, level) FROM l WHERE level > share) * weight, cap)) AS target FROM l),
r AS (SELECT b.doc_id, b.size, t.source_size, t.target,
        CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS each,
        ('0x' || substr(md5(concat_ws('/', '1', CASE WHEN b.none THEN 'true' ELSE 'false' END, b.src)), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS shift,
        row_number() OVER (PARTITION BY b.none, b.src ORDER BY b.bin, b.size, b.doc_id) AS rank
      FROM b JOIN t ON b.none = t.none AND b.src = t.src)
SELECT doc_id, size, source_size, target, ((floor(rank * each + shift) - floor((rank - 1) * each + shift)) * size)::BIGINT AS taken FROM r
"""
