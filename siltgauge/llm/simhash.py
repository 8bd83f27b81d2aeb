"""SimHash near-duplicates by Golay-code fuzzy hashing.

A fingerprint has 64 bits, one if it is set in over half of the XXH64 hashes of a text's word
shingles. Fingerprints that differ in at most four bits are linked. The 64 bits are cut into
three segments of 21, 21 and 22 bits. Of four errors, some two segments hold two at most
together, so each of the two holds two at most. The perfect Golay code [23, 12, 7] maps every
segment to the codewords of all words within one bit of it: one to six codewords, and any two
segments within two bits have a word within one bit of both and so share a codeword. A key is a
pair of segments with a codeword of each; equal keys meet, and pairs are verified on all bits.

Equal fingerprints are first made one, so copies cost nothing more. A key's fingerprints are
never paired off: balls of radius four around leaders give a spanning forest, and balls are held
against each other only while they are unconnected and near enough for a link to exist.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column_or_null, components, durable, tidy

SEGMENTS = ((0, 21), (21, 21), (42, 22))
PAIRS = ((0, 1), (0, 2), (1, 2))


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of a whole text; zero if it has no word."""
    parts = (text or "").encode("utf-8", "replace").lower().split()
    if not parts:
        return 0
    data = b" ".join(parts)
    if len(parts) <= words:
        hashes = [xxhash.xxh64_intdigest(data, seed)]
    else:
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
        begins = np.concatenate(([0], ends[:-1]))[: len(parts) - words + 1].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(data[b:e], seed) for b, e in zip(begins, (ends[words - 1 :] - 1).tolist())]
    return vote(np.array(hashes, np.uint64))


def vote(hashes: np.ndarray) -> int:
    """The bits that over half of the unsigned 64-bit hashes have; hashes go in parts of bounded size."""
    bits = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 8192):
        part = hashes[k : k + 8192].astype("<u8").view(np.uint8).reshape(-1, 8)
        bits += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(hashes), bitorder="little").view("<u8")[0])


@lru_cache(1)
def _golay() -> tuple[np.ndarray, np.ndarray]:
    """Syndromes of all upper 12 bits, and the error pattern of each syndrome."""
    poly = 0b110001110101

    def syndrome(w: int) -> int:
        for k in range(22, 10, -1):
            if w >> k & 1:
                w ^= poly << (k - 11)
        return w

    unit = [syndrome(1 << k) for k in range(23)]
    high = np.zeros(1 << 12, np.int32)
    for k in range(12):
        high[1 << k : 2 << k] = high[: 1 << k] ^ unit[11 + k]
    error = np.full(1 << 11, -1, np.int32)
    error[0] = 0
    for i in range(23):
        error[unit[i]] = 1 << i
        for j in range(i):
            error[unit[i] ^ unit[j]] = 1 << i | 1 << j
            for k in range(j):
                error[unit[i] ^ unit[j] ^ unit[k]] = 1 << i | 1 << j | 1 << k
    return high, error


def golay_index(words: np.ndarray) -> np.ndarray:
    """The 12 information bits of the codeword that is nearest to each 23-bit word."""
    high, error = _golay()
    return (words ^ error[high[words >> 11] ^ (words & 2047)]) >> 11


def golay_keys(values: np.ndarray, bits: int) -> np.ndarray:
    """Codewords of all words within one bit of each value, sorted in a row; repeats are -1."""
    flips = np.array([0] + [1 << k for k in range(bits)], np.int32)
    found = np.sort(golay_index(values.astype(np.int32)[:, None] ^ flips[None, :]), axis=1)
    found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
    return -np.sort(-found, axis=1)[:, :6]


def keys_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, position of its fingerprint) for unsigned fingerprints."""
    segs = [((fps >> np.uint64(s)) & np.uint64((1 << n) - 1)).astype(np.int64) for s, n in SEGMENTS]
    near = [golay_keys(v, n) for v, (_, n) in zip(segs, SEGMENTS)]
    keys, rows = [], []
    at = np.arange(len(fps))
    for p, (a, b) in enumerate(PAIRS):
        for i in range(6):
            for j in range(6):
                ok = (near[a][:, i] >= 0) & (near[b][:, j] >= 0)
                keys.append((p << 24) | (near[a][ok, i].astype(np.int64) << 12) | near[b][ok, j])
                rows.append(at[ok])
    return np.concatenate(keys), np.concatenate(rows)


def forest(fps: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Edges between fingerprints within ``most`` bits that connect all which such pairs connect."""
    out: list[tuple[int, int]] = []
    rest = np.unique(fps)
    leaders: list[int] = []
    balls: list[np.ndarray] = []
    while len(rest):
        near = np.bitwise_count(rest ^ rest[0]) <= most
        leaders.append(int(rest[0]))
        balls.append(rest[near])
        out += [(leaders[-1], int(x)) for x in rest[near][1:]]
        rest = rest[~near]
    n = len(balls)
    if n == 1:
        return out
    root = np.arange(n)
    heads = np.array(leaders, np.uint64)
    for k in range(1, n):
        gap = np.bitwise_count(heads[:k] ^ heads[k])
        for j in np.nonzero(gap <= 3 * most)[0][np.argsort(gap[gap <= 3 * most], kind="stable")]:
            if root[j] == root[k]:
                continue
            # only members within reach of the other leader can have a partner there
            a = balls[k][np.bitwise_count(balls[k] ^ heads[j]) <= 2 * most]
            b = balls[j][np.bitwise_count(balls[j] ^ heads[k]) <= 2 * most]
            for at in range(0, len(a), 1024):
                hit = np.argwhere(np.bitwise_count(a[at : at + 1024, None] ^ b[None, :]) <= most)
                if len(hit):
                    out.append((int(a[at + hit[0][0]]), int(b[hit[0][1]])))
                    root[root == root[k]] = root[j]
                    break
    return out


def link_buckets(key: np.ndarray, fp: np.ndarray, most: int) -> list[np.ndarray]:
    """Linked pairs of buckets that lie one after the other; small ones all at once."""
    order = np.lexsort((fp, key))
    key, fp = key[order], fp[order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (fp[1:] != fp[:-1])
    key, fp = key[fresh], fp[fresh]
    begin = np.nonzero(np.concatenate(([True], key[1:] != key[:-1])))[0]
    size = np.diff(np.concatenate((begin, [len(key)])))
    out = []
    small = np.repeat(size <= 8, size)
    k, f = key[small], fp[small]
    for d in range(1, 8):
        if len(k) <= d:
            break
        ok = (k[d:] == k[:-d]) & (np.bitwise_count(f[d:] ^ f[:-d]) <= most)
        out.append(np.stack((f[:-d][ok], f[d:][ok]), 1))
    for b, n in zip(begin[size > 8].tolist(), size[size > 8].tolist()):
        if edges := forest(fp[b : b + n], most):
            out.append(np.array(edges, np.uint64))
    return out


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = 4) -> DataFrame:
    """(doc_id, t, fp): t is a hash of the text and fp the fingerprint, both as signed longs."""
    slim = docs.select(column_or_null(docs, doc_id, "long").alias("doc_id"), column_or_null(docs, text, "string").alias("text"))
    slim = slim.select(F.col("doc_id").cast("string").alias("doc_id"), F.xxhash64("text").alias("t"), "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fp = np.array([fingerprint(t, words) for t in pdf["text"]], np.uint64)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "t": pdf["t"], "fp": fp.view(np.int64)})

    # ids travel as text, as pandas would make those beside a null inexact
    return slim.mapInPandas(tidy(run), "doc_id string, t long, fp long").withColumn("doc_id", F.col("doc_id").cast("long"))


def near_links(distinct: DataFrame, most: int = 4) -> DataFrame:
    """(a, b): verified links that connect all fingerprints (column fp) within ``most`` bits.

    Up to four bits are within what the keys guarantee.
    """
    if not 0 <= most <= 4:
        raise ValueError("the keys cover up to four differing bits")

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            every = pdf["fp"].to_numpy(np.int64).view(np.uint64)
            for at in range(0, len(every), 4096):
                fps = every[at : at + 4096]
                keys, rows = keys_of(fps)
                yield pd.DataFrame({"key": keys, "fp": fps[rows].view(np.int64)})

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, fp = np.empty(0, np.int64), np.empty(0, np.uint64)
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def done(key, fp):
            edges = [e for e in link_buckets(key, fp, most) if len(e)]
            if edges:
                every = np.unique(np.concatenate(edges), axis=0).view(np.int64)
                return pd.DataFrame({"a": every[:, 0], "b": every[:, 1]})
            return None

        for pdf in batches:
            k, f = pdf["key"].to_numpy(np.int64), pdf["fp"].to_numpy(np.int64).view(np.uint64)
            if not len(k):
                continue
            if held and held[-1][0][-1] == k[-1]:  # one bucket goes on through the whole batch
                held.append((k, f))
                continue
            held.append((k, f))
            key, fp = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            cut = int(np.searchsorted(key, key[-1]))
            held = [(key[cut:], fp[cut:])]
            if cut and (out := done(key[:cut], fp[:cut])) is not None:
                yield out
        if held:
            key, fp = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            if (out := done(key, fp)) is not None:
                yield out

    keyed = distinct.select("fp").mapInPandas(tidy(spread), "key long, fp long")
    return keyed.repartition("key").sortWithinPartitions("key").mapInPandas(tidy(meet), "a long, b long")


def _groups(fps: DataFrame, most: int) -> DataFrame:
    """(fp, low, component) of every different fingerprint; low is its smallest doc_id."""
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("low"))
    comp = components(near_links(distinct, most))
    named = distinct.join(comp.withColumnRenamed("node", "fp"), "fp", "left")
    return named.select("fp", "low", F.coalesce("component", "fp").alias("component"))


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = 4, most: int = 4) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id).

    Defined cases: a null or empty text has fingerprint zero and is linked like any other;
    fewer words than a shingle are one shingle; repeated rows fall in one component; a null
    doc_id never names a component unless all its members are null.
    """
    fps = durable(fingerprints(docs, text, doc_id, words))
    named = _groups(fps, most)
    least = named.groupBy("component").agg(F.min("low").alias("component_id"))
    table = named.join(least, "component").select("fp", "component_id")
    return fps.join(table, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = 4, most: int = 4) -> DataFrame:
    """The rows of docs that stay: of each group of near duplicates the one with the smallest doc_id.

    Null ids come last, rows that share an id are told apart by their text, and of equal rows
    one stays. Columns are as in docs.
    """
    fps = durable(fingerprints(docs, text, doc_id, words))
    rows = fps.join(_groups(fps, most).select("fp", "component"), "fp")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("i"), "t")).alias("who")
    return surviving(docs, rows.groupBy("component").agg(first), text, doc_id)


def surviving(docs: DataFrame, first: DataFrame, text: str, doc_id: str) -> DataFrame:
    """The rows of docs that first names by a struct who (none, i, t): no id, id, hash of the text."""
    stay = first.select(F.col("who.i").alias("__i"), F.col("who.t").alias("__t"), F.col("who.none").alias("__none"))
    keyed = docs.withColumns({"__i": F.coalesce(column_or_null(docs, doc_id, "long"), F.lit(0)), "__t": F.xxhash64(column_or_null(docs, text, "string")), "__none": column_or_null(docs, doc_id, "long").isNull()})
    kept = keyed.join(stay, ["__i", "__t", "__none"], "left_semi")
    nth = F.row_number().over(Window.partitionBy("__i", "__t", "__none").orderBy("__i"))
    return kept.withColumn("__nth", nth).where("__nth = 1").select(*[F.col(f"`{c}`") for c in docs.columns])
