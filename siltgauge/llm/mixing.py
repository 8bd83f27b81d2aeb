"""Mixing sources to target weights, with DataFrame functions only.

Every document gets a hash-random key. Within a source the documents are ordered by that key,
and prefix sums of their sizes say where the source's budget is used up; a budget above the
source's size repeats whole epochs first. The prefix sums are distributed: a source is dealt
into key ranges of a bounded number of documents, the ranges are summed and prefix-summed (a
few rows), and only inside one range does a window run. A source that holds a third of all
rows is thus spread over many tasks, and only ids, sizes and keys are shuffled, never texts.

Defined cases: a null text has size 0 and is never taken; a null source is a source of its own,
last in order; repeated rows are separate documents; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column_or_null, durable

WORD = r"[^\x20\x09-\x0D]+"


def random_key(doc_id, text, seed: int):
    """60 random bits of a row, by a hash that other engines have too."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), doc_id.cast("string"), text)), 1, 15), 16, 10).cast("long")


def source_targets(stats: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """(source, source_size, n_docs, target) from per-source sums; a source has one row.

    Weights repeat over the sources in code point order, null last. Water-filling: sources in
    ascending order of cap / weight stop at their cap while the level of the rest lies above it;
    this is where resharing the excess by weight ends.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    s = stats.select("source", "source_size", "n_docs", w.alias("w")).withColumn("cap", F.lit(most) * F.col("source_size"))
    up = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    after = up.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy()
    s = s.withColumn("total", F.sum("source_size").over(whole))
    s = s.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("w").over(after))
    s = s.withColumn("full", F.col("cap") <= F.col("level") * F.col("w"))
    left = F.sum(F.when(F.col("full"), F.lit(0)).otherwise(F.col("w"))).over(whole)
    rest = F.col("total") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(F.lit(0))).over(whole)
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(rest.cast("double") * F.col("w") / F.greatest(left, F.lit(1e-300)))
    return s.select("source", "source_size", "n_docs", target.alias("target"))


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 17, range_rows: int = 8192) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, before, key.

    taken: words that the mix takes of the document, repeats counted; whole epochs are
    ``taken div size`` copies and the last document of a budget is cut inside. range_rows bounds
    the documents of one key range, so ranges grow in number, not in length.
    """
    size = F.coalesce(F.regexp_count(column_or_null(docs, text, "string"), F.lit(WORD)), F.lit(0)).cast("long")
    slim = docs.select(column_or_null(docs, doc_id, "long").alias("doc_id"), column_or_null(docs, source, "string").alias("source"), size.alias("size"), random_key(column_or_null(docs, doc_id, "long"), column_or_null(docs, text, "string"), seed).alias("key"))
    slim = durable(slim)
    stats = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    plan = source_targets(stats, weights, most)
    plan = plan.withColumn("ranges", F.ceil(F.col("n_docs") / range_rows).cast("long")).withColumn("budget", F.round("target").cast("long"))
    plan = plan.select(F.col("source").alias("p_source"), "source_size", "target", "ranges", "budget")
    dealt = slim.join(plan, F.col("source").eqNullSafe(F.col("p_source"))).drop("p_source")
    # the key's upper bits, taken as a fraction, choose the range
    dealt = dealt.withColumn("range", F.floor(F.shiftright("key", 28) / F.lit(2.0**32) * F.col("ranges")).cast("long"))
    sums = dealt.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    upto = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("r_source"), F.col("range").alias("r_range"), F.coalesce(F.sum("range_size").over(upto), F.lit(0)).alias("start"))
    rows = dealt.join(sums, F.col("source").eqNullSafe(F.col("r_source")) & (F.col("range") == F.col("r_range"))).drop("r_source", "r_range")
    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("before", F.col("start") + F.sum("size").over(inside) - F.col("size"))
    whole = F.col("source_size") > 0
    epochs = F.when(whole, F.expr("budget div greatest(source_size, 1)")).otherwise(F.lit(0))
    rest = F.when(whole, F.col("budget") - epochs * F.col("source_size")).otherwise(F.lit(0))
    part = F.least(F.greatest(rest - F.col("before"), F.lit(0)), F.col("size"))
    return rows.select("doc_id", "source", "size", "source_size", "target", (epochs * F.col("size") + part).cast("long").alias("taken"), "before", "key")


def mixed_rows(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", n_chars: str = "n_chars", weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 17) -> DataFrame:
    """The mix itself, with the columns of docs: a row for each copy that is taken.

    The last copy of a source's budget has only the words that the budget still holds; n_chars,
    where docs has it, follows the text. Documents of which nothing is taken go.
    """
    plan = mix(docs, text, source, doc_id, weights, most, seed)
    plan = plan.groupBy("doc_id", "key").agg(F.sum("taken").alias("__taken"), F.max("size").alias("__size")).where("__taken > 0")
    plan = plan.select(F.col("doc_id").alias("__id"), F.col("key").alias("__plan"), "__taken", "__size")
    keyed = docs.withColumn("__key", random_key(column_or_null(docs, doc_id, "long"), column_or_null(docs, text, "string"), seed))
    nth = F.row_number().over(Window.partitionBy("__key", f"`{doc_id}`").orderBy("__key"))
    rows = keyed.join(plan, (F.col("__key") == F.col("__plan")) & column_or_null(docs, doc_id, "long").eqNullSafe(F.col("__id"))).withColumn("__nth", nth).where("__nth = 1")
    rows = rows.withColumn("__words", F.explode(F.expr("transform(sequence(1L, (__taken + __size - 1) div __size), i -> least(__size, __taken - (i - 1) * __size))")))
    body = F.col(f"`{text}`")
    cut = F.concat_ws("", F.slice(F.regexp_extract_all(body, F.lit(r"([^\x20\x09-\x0D]+[\x20\x09-\x0D]*)"), F.lit(1)), F.lit(1), F.col("__words").cast("int")))
    rows = rows.withColumn("__text", F.when(F.col("__words") < F.col("__size"), cut).otherwise(body))
    pick = {text: F.col("__text"), n_chars: F.length("__text").cast("long")}
    return rows.select(*[pick[c].alias(c) if c in pick else F.col(f"`{c}`") for c in docs.columns])
