"""Scores, totals, ranks and comparisons of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..schema import KINDS
from ..tables import durable

CONTEXT_TOKENS = 128_000


def weight(weights: dict[str, float] | None = None) -> Column:
    return F.coalesce(F.try_element_at(S.weight_map(weights), F.col("severity")), F.lit(0.0))


def _bounded(x: Column) -> Column:
    return F.least(F.round(x), F.lit(100.0)).cast("int")


def global_score(findings: DataFrame, files: int | Column, tokens: int | Column, weights: dict[str, float] | None = None) -> DataFrame:
    """One row: four scores of 0 to 100, the context ratio and the waste percentage.

    Exact decimal sums make the result independent of the order of rows. No finding gives zeros.
    """
    files, tokens = S.lit(files).cast("bigint"), S.lit(tokens).cast("bigint")  # a Python int is a 32-bit literal, which 16,778 files overflow
    bucket = F.try_element_at(S.kind_map(2), F.col("kind"))
    w = (weight(weights) * F.col("confidence")).cast("decimal(18,6)")
    part = lambda name: F.coalesce(F.sum(F.when(bucket == name, w)), F.lit(0)).cast("double")
    sums = findings.agg(F.coalesce(F.sum(w), F.lit(0)).cast("double").alias("a"), part("context_waste").alias("c"), part("structural_entropy").alias("s"), part("reasoning_complexity").alias("r"))
    most = F.greatest(files * 0.4, F.lit(1.0))
    return sums.select(
        _bounded(F.col("a") / most * 100).alias("ai_friction_score"), _bounded(F.col("c") / most * 100).alias("context_waste_score"),
        _bounded(F.col("s") / most * 100).alias("structural_entropy_score"), _bounded(F.col("r") / most * 100).alias("reasoning_complexity_score"),
        (tokens / F.lit(float(CONTEXT_TOKENS))).alias("context_waste_ratio"), _bounded(tokens / F.greatest(files * CONTEXT_TOKENS, F.lit(1)) * 100).alias("estimated_waste_pct"),
    )


def score_rollup(findings: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Findings and weighted sums by bucket, with a grand total of null bucket."""
    bucket = F.try_element_at(S.kind_map(2), F.col("kind"))
    w = (weight(weights) * F.col("confidence")).cast("decimal(18,6)")
    return findings.select(bucket.alias("bucket"), w.alias("w")).rollup("bucket").agg(F.count(F.lit(1)).alias("n_findings"), F.sum("w").cast("double").alias("weighted"))


def totals(files: DataFrame, *by: str) -> DataFrame:
    """Files, lines and tokens, by groups with a rollup where groups are named."""
    aggs = [F.count(F.lit(1)).alias("n_files"), F.sum("line_count").alias("total_lines"), F.sum(S.estimated_tokens(F.col("size_bytes"))).alias("total_tokens")]
    return files.rollup(*by).agg(*aggs) if by else files.agg(*aggs)


def by_kind(findings: DataFrame) -> DataFrame:
    """A row for each kind with counts by severity; the columns are fixed, so nothing is scanned to find them."""
    return findings.groupBy("kind").pivot("severity", ["Critical", "High", "Medium", "Low"]).agg(F.count(F.lit(1))).na.fill(0)


def ranked(findings: DataFrame) -> DataFrame:
    """A total order: severity, kind, path. Ids are numbered within a kind, never over everything.

    Findings are dealt into key ranges, each numbers its own, and a range's first number follows from
    the counts of the ranges before it: a kind that holds most findings is sorted by many tasks. The
    ranges are written once, as a second sampling would cut them elsewhere.
    """
    keys = (F.col("kind"), weight().desc(), F.col("path"), F.col("confidence"))
    dealt = durable(findings.repartitionByRange(*keys).withColumn("__range", F.spark_partition_id()))
    sizes = dealt.groupBy(F.col("kind").alias("k"), F.col("__range").alias("r")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("k").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as there are ranges
    starts = sizes.select("k", "r", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("__range", "kind").orderBy(*keys[1:]))
    numbered = dealt.withColumn("nth", inside).join(starts, (F.col("__range") == F.col("r")) & F.col("kind").eqNullSafe(F.col("k")))
    numbered = numbered.withColumn("nth", F.col("nth") + F.col("start")).drop("__range", "k", "r", "start")
    prefix = F.coalesce(F.try_element_at(S.kind_map(0), F.col("kind")), F.lit("xx"))
    digits = F.col("nth").cast("string")
    return numbered.withColumn("id", F.concat(prefix, F.lit("-"), F.when(F.col("nth") < 1000, F.lpad(digits, 3, "0")).otherwise(digits)))


def top_per_kind(findings: DataFrame, k: int = 5) -> DataFrame:
    """The first k of each kind and how many more there are."""
    n = findings.groupBy("kind").agg(F.count(F.lit(1)).alias("total"))
    first = findings.withColumn("nth", F.row_number().over(Window.partitionBy("kind").orderBy(weight().desc(), "path"))).where(F.col("nth") <= k)
    return first.join(n, "kind").withColumn("more", F.greatest(F.col("total") - k, F.lit(0))).drop("total")


def priorities(findings: DataFrame, k: int = 5) -> DataFrame:
    """The k first Critical and High findings: a bounded sort in each task, one merge."""
    return findings.where(F.col("severity").isin("Critical", "High")).orderBy(weight().desc(), "kind", "path").limit(k)


def compare(*reports: tuple[str, DataFrame]) -> DataFrame:
    """(kind, path, a count for each report) where reports differ."""
    every = None
    for name, f in reports:
        one = f.select("kind", "path", F.lit(name).alias("report"))
        every = one if every is None else every.unionByName(one)
    names = [n for n, _ in reports]
    wide = every.groupBy("kind", "path").agg(*[F.count(F.when(F.col("report") == n, 1)).alias(n) for n in names])
    return wide.where(" OR ".join(f"`{a}` <> `{b}`" for a, b in zip(names, names[1:])) or "true")


def known_kind(kind: Column) -> Column:
    return kind.isin(*KINDS)
