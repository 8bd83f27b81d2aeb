"""Near duplicates by Jaccard similarity of word shingles: five words and 0.8 by default.

Texts are sets of hashed shingles, and equal sets are first made one. Two ways bring sets together.
SimHash fingerprints of the sets meet by their Golay keys, which catches most near copies at a small
cost. What few bits don't reach meets by shingles: all sets are sorted by one order, and of a set of
n shingles the first n - ceil(0.8 n) + 1 are its keys: two sets of similarity 0.8 share a key,
whatever the order. So no pair is missed. Shingles that a sample of documents has often come last in
the order, which changes the work but never the pairs found.

Pairs that meet are held against each other by sketches, counts of shingles in buckets of the hash
range: the sum of the lesser counts is at least the number of shared shingles. Pairs for which that
leaves room are verified on whole sets. Sets of a key are linked to its first set; then only sets of
a key that are still unconnected are compared: as pairs where these are a bounded number for each set,
else block by block inside tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column_or_null, components, durable, tidy
from .simhash import near_links, surviving, vote

#: Similarity as a fraction of whole numbers, so that limits are exact.
NUM, DEN = 4, 5
#: A key that would give more than PAIRS pairs for each of its sets is compared in blocks of about BLOCK sets.
PAIRS, BLOCK = 32, 512


def shingle_hashes(text: str | None, words: int = 5, seed: int = 42) -> np.ndarray:
    """Different hashes of a text's shingles, ascending; fewer words than a shingle are one."""
    parts = (text or "").encode("utf-8", "replace").lower().split()
    data = b" ".join(parts)
    if len(parts) <= words:
        return np.array([xxhash.xxh64_intdigest(data, seed)], np.uint64).view(np.int64)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    begins = np.concatenate(([0], ends[:-1]))[: len(parts) - words + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = [digest(data[b:e], seed) for b, e in zip(begins, (ends[words - 1 :] - 1).tolist())]
    return np.unique(np.array(hashes, np.uint64).view(np.int64))


def keys_of(hashes: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The keys of a set; hashes in common, which is sorted, come last."""
    n = len(hashes)
    if len(common):
        often = common[np.minimum(np.searchsorted(common, hashes), len(common) - 1)] == hashes
        hashes = np.concatenate((hashes[~often], hashes[often]))
    return hashes[: n - -(-NUM * n // DEN) + 1]


def sketch_of(hashes: np.ndarray) -> bytes:
    """Numbers of hashes in equal parts of the hash range, about as many as hashes, 255 for more."""
    bits = max(6, len(hashes).bit_length() - 1)
    part = (hashes.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)
    return np.minimum(np.bincount(part, minlength=1 << bits), 255).astype(np.uint8).tobytes()


def may_share(a: bytes, b: bytes, n: int, m: int) -> bool:
    """Whether sketches leave room for the similarity of sets of n and m shingles; never wrongly False."""
    x, y = (np.frombuffer(k, np.uint8).astype(np.int64) for k in (a, b))
    if x.max(initial=0) == 255 or y.max(initial=0) == 255:
        return True
    few = min(len(x), len(y))
    x, y = x.reshape(few, -1).sum(1), y.reshape(few, -1).sum(1)
    return (NUM + DEN) * int(np.minimum(x, y).sum()) >= NUM * (n + m)


def _slim(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    return docs.select(column_or_null(docs, doc_id, "long").alias("doc_id"), column_or_null(docs, text, "string").alias("text"))


def common_shingles(slim: DataFrame, words: int, every: int = 16, least: int = 3, most: int = 200_000) -> np.ndarray:
    """Hashes that at least ``least`` texts of one in ``every`` have, the commonest first to be taken."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 1000):
                if sets := [shingle_hashes(t, words) for t in pdf["text"].iloc[at : at + 1000]]:
                    yield pd.DataFrame({"h": np.concatenate(sets)})

    few = slim.select("text").where(F.pmod(F.xxhash64("text"), F.lit(every)) == 0).distinct()
    counts = few.mapInPandas(tidy(run), "h long").groupBy("h").count().where(F.col("count") >= least)
    return np.sort(np.array([r["h"] for r in counts.orderBy(F.desc("count"), "h").limit(most).collect()], np.int64))


def _sets(slim: DataFrame, words: int, common: np.ndarray) -> DataFrame:
    """(s, n, keys, fp, sketch, who): every different set's digest, size, keys, fingerprint and sketch and its first document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 1000):
                part = pdf.iloc[at : at + 1000]
                sets = [shingle_hashes(t, words) for t in part["text"]]
                digests = np.array([xxhash.xxh64_intdigest(x.tobytes()) for x in sets], np.uint64).view(np.int64)
                fp = np.array([vote(x.view(np.uint64)) for x in sets], np.uint64).view(np.int64)
                known = {"doc_id": part["doc_id"].array, "t": part["t"].array, "s": digests, "n": [len(x) for x in sets]}
                yield pd.DataFrame(known | {"keys": [keys_of(x, common) for x in sets], "fp": fp, "sketch": [sketch_of(x) for x in sets]})

    shape = "doc_id string, t long, s long, n int, keys array<long>, fp long, sketch binary"
    # ids travel as text, as pandas would make those beside a null inexact
    rows = slim.select(F.col("doc_id").cast("string").alias("doc_id"), F.xxhash64("text").alias("t"), "text").mapInPandas(tidy(run), shape).withColumn("doc_id", F.col("doc_id").cast("long"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("i"), "t")).alias("who")
    return rows.groupBy("s").agg(*[F.first(c).alias(c) for c in ("n", "keys", "fp", "sketch")], first)


def _size_at(c: str):
    """Size of a set and place of its key, from the one number that holds both."""
    return F.shiftright(c, 32), F.col(c).bitwiseAND(2**32 - 1)


def _may_link(a: str, b: str):
    """Sizes and places of a shared key leave room for the similarity.

    Where a key is not the first that two sets share this may say no, but then their first says yes.
    """
    (n, i), (m, j) = _size_at(a), _size_at(b)
    return (DEN * F.least(n, m) >= NUM * F.greatest(n, m)) & ((NUM + DEN) * F.least(n - i, m - j) >= NUM * (n + m))


def _promising(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of set digests whose sketches leave room for the similarity."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ok = [may_share(*x) for x in zip(pdf["ka"], pdf["kb"], pdf["na"].tolist(), pdf["nb"].tolist())]
            yield pdf.loc[ok, ["a", "b"]]

    side = lambda x: sets.select(F.col("s").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"k{x}"))
    return pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").mapInPandas(run, "a long, b long")


def _whole(ids: DataFrame, slim: DataFrame, sets: DataFrame, words: int) -> DataFrame:
    """(s, x): the whole sets of the digests s."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 1000):
                part = pdf.iloc[at : at + 1000]
                yield pd.DataFrame({"s": part["s"].array, "x": [shingle_hashes(t, words) for t in part["text"]]})

    texts = sets.join(ids.select("s").distinct(), "s", "left_semi").select("s", F.col("who.t").alias("t"))
    # equal hashes have equal texts, so any row with it will do
    held = slim.withColumn("t", F.xxhash64("text")).join(texts, "t").groupBy("s").agg(F.first("text").alias("text"))
    return durable(held.mapInPandas(tidy(run), "s long, x array<long>"))


def _verified(pairs: DataFrame, slim: DataFrame, sets: DataFrame, words: int) -> DataFrame:
    """The pairs (a, b) of set digests whose sets are as similar as asked for."""
    whole = _whole(pairs.select(F.explode(F.array("a", "b")).alias("s")), slim, sets, words)
    both = pairs.join(whole.select(F.col("s").alias("a"), F.col("x").alias("xa")), "a").join(whole.select(F.col("s").alias("b"), F.col("x").alias("xb")), "b")
    shared = F.size(F.array_intersect("xa", "xb"))
    return both.where((NUM + DEN) * shared >= NUM * (F.size("xa") + F.size("xb"))).select("a", "b")


def _groups(slim: DataFrame, sets: DataFrame, words: int) -> DataFrame:
    """(s, component) of every set that is linked to another."""
    keyed = sets.select("s", "n", F.posexplode("keys").alias("at", "key")).select("key", "s", F.expr("shiftleft(CAST(n AS BIGINT), 32) + at").alias("na"))
    w = Window.partitionBy("key")
    met = keyed.withColumns({"first": F.min(F.struct("s", "na")).over(w), "m": F.count(F.lit(1)).over(w)}).where("m > 1")
    met = durable(met.select("key", "s", "na", F.col("first.s").alias("fs"), F.col("first.na").alias("fna")))
    stars = met.where("s <> fs").where(_may_link("fna", "na")).select(F.col("fs").alias("a"), F.col("s").alias("b"))
    # sets of fingerprints within four bits, by Golay keys, and of equal ones
    head = durable(sets.groupBy("fp").agg(F.min("s").alias("h")))
    links = near_links(head.select("fp"))
    side = lambda x: head.select(F.col("fp").alias(x), F.col("h").alias(f"h{x}"))
    alike = links.join(side("a"), "a").join(side("b"), "b").select(F.least("ha", "hb").alias("a"), F.greatest("ha", "hb").alias("b"))
    alike = alike.union(sets.join(head, "fp").where("s <> h").select(F.col("h").alias("a"), F.col("s").alias("b")))
    done = durable(stars.union(alike).distinct())
    comp = durable(components(durable(_verified(durable(_promising(done, sets)), slim, sets, words))))
    named = lambda: met.select("key", "s", "na").join(comp.withColumnRenamed("node", "s"), "s", "left").withColumn("c", F.coalesce("component", "s"))
    own = F.count(F.lit(1)).over(Window.partitionBy("key", "c"))
    every = named().withColumn("own", own).withColumns({"low": F.min("c").over(w), "high": F.max("c").over(w), "m": F.count(F.lit(1)).over(w), "same": F.sum("own").over(w)})
    every = every.where("low < high").withColumn("many", F.expr(f"(m * m - same) / 2 > {PAIRS} * m"))
    every = durable(every.select("key", "s", "na", "c", "m", "many"))
    few = every.where("not many")
    other = few.select("key", F.col("s").alias("q"), F.col("na").alias("qna"), F.col("c").alias("qc"))
    rest = few.join(other, "key").where("s < q AND c <> qc").where(_may_link("na", "qna")).select(F.col("s").alias("a"), F.col("q").alias("b")).distinct()
    rest = durable(_promising(rest.join(done, ["a", "b"], "left_anti"), sets))
    links = _verified(rest, slim, sets, words).union(_in_blocks(every.where("many"), slim, sets, words))
    return _grown(comp, links).select(F.col("node").alias("s"), "component")


def _in_blocks(rows: DataFrame, slim: DataFrame, sets: DataFrame, words: int) -> DataFrame:
    """Links (a, b) that connect whatever links connect among the sets of each key; rows has key, s, na, c and m.

    A key's sets are dealt into blocks of about BLOCK, and two blocks meet in a task with their whole
    sets. It compares sets of different components only and returns links that join two, so that
    pairs never become rows.
    """
    whole = _whole(rows.select("s"), slim, sets, words)
    blocks = F.ceil(F.col("m") / BLOCK).cast("long")
    dealt = rows.withColumn("mine", F.pmod(F.xxhash64("s"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    dealt = dealt.join(whole, "s").select("key", "s", "na", "c", "x", "mine", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))

    def meet(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("s")
        s, mine, x = pdf["s"].to_numpy(), pdf["mine"].to_numpy(), list(pdf["x"])
        n, at = pdf["na"].to_numpy() >> 32, pdf["na"].to_numpy() & (2**32 - 1)
        root = np.unique(pdf["c"].to_numpy(), return_inverse=True)[1]
        out = []
        for k in range(len(s) - 1):
            near = (root[k + 1 :] != root[k]) & (DEN * np.minimum(n[k + 1 :], n[k]) >= NUM * np.maximum(n[k + 1 :], n[k]))
            near &= (NUM + DEN) * np.minimum(n[k + 1 :] - at[k + 1 :], n[k] - at[k]) >= NUM * (n[k + 1 :] + n[k])
            if key[1] != key[2]:
                near &= mine[k + 1 :] != mine[k]
            cand = k + 1 + np.nonzero(near)[0]
            if not len(cand):
                continue
            flat = np.concatenate([x[c] for c in cand])
            spot = np.minimum(np.searchsorted(x[k], flat), len(x[k]) - 1)
            shared = np.add.reduceat((x[k][spot] == flat).astype(np.int64), np.concatenate(([0], np.cumsum(n[cand])[:-1])))
            for c in cand[(NUM + DEN) * shared >= NUM * (n[cand] + n[k])].tolist():
                if root[c] != root[k]:
                    out.append((int(s[k]), int(s[c])))
                    root[root == root[c]] = root[k]
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return dealt.groupBy("key", "i", "j").applyInPandas(meet, "a long, b long")


def _grown(comp: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) once further links (a, b) between nodes hold."""
    label = lambda side: comp.select(F.col("node").alias(side), F.col("component").alias(f"c{side}"))
    joined = links.join(label("a"), "a", "left").join(label("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    top = durable(components(durable(joined.distinct())))
    # components of components; nodes that only these links have come from top itself
    lower = comp.join(top.select(F.col("node").alias("component"), F.col("component").alias("top")), "component", "left").select("node", F.coalesce("top", "component").alias("component"))
    return durable(lower.union(top.join(comp, "node", "left_anti").select("node", "component")))


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = 5) -> DataFrame:
    """The rows of docs that stay: of each group of near duplicates the one with the smallest doc_id.

    A group is a component of links of similarity 0.8 or more. Texts without a word are equal to
    one another. Null ids come last, rows that share an id are told apart by their text, and of
    equal rows one stays. Columns are as in docs.
    """
    slim = _slim(docs, text, doc_id)
    sets = durable(_sets(slim, words, common_shingles(slim, words)))
    named = sets.select("s", "who").join(_groups(slim, sets, words), "s", "left")
    return surviving(docs, named.groupBy(F.coalesce("component", "s").alias("g")).agg(F.min("who").alias("who")), text, doc_id)
