"""Exact removal of long repeated byte strings with a run-length suffix index.

A byte goes if a 200-byte string that covers it also starts anywhere else. No machine can hold
one index of a whole corpus, so the strings are dealt out by content first: every window of 200
bytes has an anchor, the leftmost of its 64-byte grams whose hash is smallest, and equal windows
have equal anchors in the same place. The windows that share one occurrence of an anchor are a
context, one stretch of text. Anchors are about 1.5 % of the bytes.

* A context that occurs twice, in one text or in two (same anchor, same place in it, same bytes by 64-bit hash beside
  the anchor's own) is repeated as a whole.
* A context whose anchor occurs nowhere else has no repeated window.
* What is left lies at the borders of long matches. Its contexts are brought together by anchor
  in blocks of bounded size, and each block is indexed: suffixes are sorted, the Burrows-Wheeler
  transform is cut into runs, longest common prefixes are compared at run heads only, and
  matching lengths are streamed through the text from those samples, as each step inside a run
  loses one byte. Starts whose match reaches 200 bytes are marked.
* An anchor with too many different contexts for a block has them dealt out again by longer
  anchors, and windows that even the longest leaves together are counted by 128-bit hash in a
  distributed aggregation.

Identical contexts are counted before they are shuffled, so that thousands of copies arrive as
one row from each task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column_or_null, durable, tidy

GRAM = 64
REFINE = (128, 176)  # longer anchors for what a common one brings together
CHUNK = 1 << 18  # bytes that are hashed at a time
PLACE = np.uint64((1 << 21) - 1)
BLOCK_BYTES = 1 << 20
NO_ID = -(2**63) + 1  # stands for a null doc_id
MOST_CONTEXTS = 512
PIECE = "h long, d long, t long, first long, data binary, single boolean, hot boolean"


@lru_cache(4)
def _tables(lane: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random letters for bytes, powers of an odd base modulo 2**64, and their inverses."""
    rng = np.random.default_rng(1000 + lane)
    letters = rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    base = int(rng.integers(1 << 60, 1 << 62)) * 2 + 1
    inverse = pow(base, -1, 1 << 64)
    n = CHUNK + 4096
    up, down = np.full(n, base, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return letters, np.cumprod(up), np.cumprod(down)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _sums(b: np.ndarray, lane: int) -> np.ndarray:
    letters, up, _ = _tables(lane)
    out = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(letters[b] * up[: len(b)], out=out[1:])
    return out


def _runs(b: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place of the anchor, its hash, first window, number of windows) of each context of a stretch, and sums for hashes."""
    wide = length - gram + 1
    s0 = _sums(b, 0)
    grams = len(b) - gram + 1
    h = _mix((s0[gram:] - s0[:grams]) * _tables(0)[2][:grams])
    low = (h & ~PLACE) | np.arange(grams, dtype=np.uint64)
    span = 1
    while 2 * span <= wide:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if wide > span:
        low = np.minimum(low[: len(low) - (wide - span)], low[wide - span :])
    place = (low & PLACE).astype(np.int64)
    first = np.nonzero(np.concatenate(([True], place[1:] != place[:-1])))[0]
    n = np.diff(np.concatenate((first, [len(place)])))
    p = place[first]
    return p, h[p], first, n, _sums(b, 1)


def _digest(s1: np.ndarray, p: np.ndarray, first: np.ndarray, n: np.ndarray, length: int) -> np.ndarray:
    end = first + n + length - 1
    c = (s1[end] - s1[first]) * _tables(1)[2][first]
    return _mix(c ^ _mix(((p - first).astype(np.uint64) << np.uint64(32)) | n.astype(np.uint64)))


def contexts(parts: list[bytes], length: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(part, anchor hash, context hash, first window start, number of windows) of all parts.

    A context has ``windows + length - 1`` bytes. Short parts are hashed side by side, and what
    windows over a border would add is cut off; long ones go chunk by chunk.
    """
    gram = min(gram, length)
    out: list[tuple] = []
    group: list[int] = []
    size = 0

    def done() -> None:
        sizes = np.array([len(parts[k]) for k in group], np.int64)
        ends = np.cumsum(sizes)
        p, h, first, n, s1 = _runs(np.frombuffer(b"".join([parts[k] for k in group]), np.uint8), length, gram)
        which = np.searchsorted(ends, p, "right")
        begin = ends[which] - sizes[which]
        head = np.maximum(first, begin)
        n = np.minimum(first + n, ends[which] - length + 1) - head
        ok = n > 0
        p, h, first, n, which = p[ok], h[ok], head[ok], n[ok], which[ok]
        out.append((np.array(group)[which], h, _digest(s1, p, first, n, length), first - begin[ok], n))

    for k, data in enumerate(parts):
        if len(data) < length:
            continue
        if len(data) > CHUNK:
            for at in range(0, len(data) - length + 1, CHUNK):
                p, h, first, n, s1 = _runs(np.frombuffer(data, np.uint8, min(CHUNK + length - 1, len(data) - at), at), length, gram)
                out.append((np.full(len(p), k), h, _digest(s1, p, first, n, length), first + at, n))
            continue
        if size + len(data) > CHUNK:
            done()
            group, size = [], 0
        group.append(k)
        size += len(data)
    if group:
        done()
    if not out:
        none = np.zeros(0, np.int64)
        return none, none.astype(np.uint64), none.astype(np.uint64), none, none
    return tuple(map(np.concatenate, zip(*out)))


def window_hashes(data: bytes, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of every window of a short stretch."""
    b = np.frombuffer(data, np.uint8)
    n = len(b) - length + 1
    out = []
    for lane in (2, 3):
        s = _sums(b, lane)
        out.append(_mix((s[length:] - s[:n]) * _tables(lane)[2][:n]).view(np.int64))
    return out[0], out[1]


class RunIndex:
    """Suffix order of several strings, its Burrows-Wheeler runs, and sampled match lengths."""

    def __init__(self, parts: list[bytes]):
        m = len(parts)
        sizes = np.array([len(x) for x in parts], np.int64)
        self.ends = np.cumsum(sizes + 1)
        self.begins = self.ends - sizes - 1
        n = int(self.ends[-1]) if m else 0
        text = np.zeros(n, np.int64)
        flat = np.frombuffer(b"\x00".join(parts) + b"\x00" * bool(m), np.uint8)
        text[:] = flat
        text += m
        text[self.ends - 1] = np.arange(m)  # each end is a letter of its own
        self.text = text
        self.order, self.rank = self._sort(text)
        before = text[self.order - 1]  # the transform; place 0 wraps around
        self.heads = np.nonzero(np.concatenate(([True], before[1:] != before[:-1])))[0]
        self.matches = self._match()

    @staticmethod
    def _sort(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(text)
        letters = int(text.max(initial=0)) + 2
        pad = np.zeros(n + 2, np.int64)
        pad[:n] = text + 1
        key = (pad[:n] * letters + pad[1 : n + 1]) * letters + pad[2 : n + 2]
        width = 3
        while True:
            order = np.argsort(key)
            k = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.concatenate(([0], k[1:] != k[:-1]))) if n else 0
            if not n or rank[order[-1]] == n - 1:
                return order, rank
            nxt = np.zeros(n, np.int64)
            nxt[: max(0, n - width)] = rank[width:] + 1
            key = rank * (n + 1) + nxt
            width *= 2

    def _match(self) -> np.ndarray:
        """For each place, how far it agrees with the suffix sorted just before its own."""
        n = len(self.text)
        if not n:
            return np.zeros(0, np.int64)
        y = self.order[self.heads]
        x = self.order[np.maximum(self.heads - 1, 0)]
        sampled = np.zeros(len(y), np.int64)
        live = np.nonzero(self.heads > 0)[0]
        step = 0
        while len(live):
            a, b = x[live] + step, y[live] + step
            inside = (a < n) & (b < n)
            live, a, b = live[inside], a[inside], b[inside]
            live = live[self.text[a] == self.text[b]]
            step += 1
            sampled[live] = step
        value = np.zeros(n, np.int64)
        is_head = np.zeros(n, bool)
        value[y], is_head[y] = sampled, True
        is_head[0] = True
        last = np.maximum.accumulate(np.where(is_head, np.arange(n), 0))
        return np.maximum(value[last] - (np.arange(n) - last), 0)

    def repeated(self, length: int) -> np.ndarray:
        """Whether the string of this length at each place also starts at another place."""
        lcp = self.matches[self.order]
        hit = lcp >= length
        hit[:-1] |= lcp[1:] >= length
        out = np.zeros(len(self.text), bool)
        out[self.order] = hit
        return out


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of (begin, end) spans, touching ones joined."""
    out: list[tuple[int, int]] = []
    for b, e in sorted(spans):
        if out and b <= out[-1][1]:
            if e > out[-1][1]:
                out[-1] = (out[-1][0], e)
        else:
            out.append((b, e))
    return out


def runs_of(hit: np.ndarray) -> list[tuple[int, int]]:
    edge = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
    return list(zip(np.nonzero(edge == 1)[0].tolist(), np.nonzero(edge == -1)[0].tolist()))


def _anchors(keyed: DataFrame, length: int) -> DataFrame:
    """A row for each different context of a text: h, c, d, t, at (first start and windows), times.

    Contexts that a text repeats come once with their number; where they lie comes as rows with
    times 0, whose at and c are the begin and end of a span.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 512):
                part = pdf.iloc[at : at + 512]
                d, t = part["d"].to_numpy(np.int64), part["t"].to_numpy(np.int64)
                which, h, c, first, n = contexts([x.encode("utf-8", "replace") for x in part["text"]], length)
                order = np.lexsort((first, c, which))
                which, h, c, first, n = which[order], h[order], c[order], first[order], n[order]
                fresh = np.ones(len(c), bool)
                fresh[1:] = (which[1:] != which[:-1]) | (c[1:] != c[:-1])
                begin = np.nonzero(fresh)[0]
                times = np.diff(np.concatenate((begin, [len(c)])))
                w = which[begin]
                yield pd.DataFrame({"h": h[begin].view(np.int64), "c": c[begin].view(np.int64), "d": d[w], "t": t[w], "at": first[begin] << 21 | n[begin], "times": times})
                again = np.repeat(times > 1, times)
                if again.any():
                    rows = []
                    w, b, e = which[again], first[again], (first + n + length - 1)[again]
                    for k in np.unique(w).tolist():
                        rows += [(0, e_, d[k], t[k], b_, 0) for b_, e_ in merge(list(zip(b[w == k].tolist(), e[w == k].tolist())))]
                    yield pd.DataFrame(rows, columns=["h", "c", "d", "t", "at", "times"])

    # texts with fewer bytes have no window; the JVM drops them
    return keyed.where(F.octet_length("text") >= length).select("d", "t", "text").mapInPandas(tidy(run), "h long, c long, d long, t long, at long, times long")


def _index_blocks(pieces: DataFrame, length: int) -> DataFrame:
    """(d, t, b, e) spans of single contexts that the index of their block finds repeated."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        size = 0

        def done(rows):
            index = RunIndex([r[4] for r in rows])
            hit = index.repeated(length)
            out = []
            for r, begin in zip(rows, index.begins.tolist()):
                if r[5]:
                    n = len(r[4]) - length + 1
                    out += [(r[1], r[2], r[3] + b, r[3] + e + length - 1) for b, e in runs_of(hit[begin : begin + n])]
            return pd.DataFrame(out, columns=["d", "t", "b", "e"]).astype("int64")

        for pdf in batches:
            for row in zip(pdf["h"], pdf["d"], pdf["t"], pdf["first"], pdf["data"], pdf["single"]):
                if size >= BLOCK_BYTES and row[0] != held[-1][0]:
                    yield done(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        if held:
            yield done(held)

    return pieces.repartition("h").sortWithinPartitions("h").mapInPandas(tidy(run), "d long, t long, b long, e long")


def repeated_spans(docs: DataFrame, length: int = 200, most_contexts: int = MOST_CONTEXTS) -> tuple[DataFrame, DataFrame]:
    """(keyed, spans): keyed has d, t, text for every row of docs (columns doc_id, text and any others);
    spans has one row per (d, t) with removed bytes: an array of (b, e).

    t is a 64-bit hash of id and text, so that rows that share a doc_id are told apart by their text and
    equal rows, which are each other's copies, share their spans. d is never null.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    more = [c for c in docs.columns if c not in ("doc_id", "text")]
    keyed = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("d"), F.xxhash64("doc_id", text).alias("t"), text.alias("text"), *more)
    every = durable(_anchors(keyed, length))
    rows = every.where("times > 0")
    # most anchors occur once in the corpus; they go before anything else is counted
    shared = rows.groupBy("h").agg(F.sum("times").alias("all"), F.min("c").alias("c0"), F.max("c").alias("c1")).where("all > 1").select("h", (F.col("c0") < F.col("c1")).alias("mixed"))
    some = durable(rows.join(shared, "h"))
    mixed = some.where("mixed")
    one = mixed.groupBy("h", "c").agg(F.sum("times").alias("times"))
    many = one.groupBy("h").agg(F.count(F.when(F.col("times") > 0, 1)).alias("kinds"))  # reads times, so that one shuffle serves both
    tagged = durable(mixed.drop("times", "mixed").join(one.join(many, "h"), ["h", "c"]))
    first, n = F.shiftright("at", 21), F.col("at").bitwiseAND((1 << 21) - 1)
    whole = lambda f: f.select("d", "t", first.alias("b"), (first + n + length - 1).alias("e"))
    spans = whole(some.where("not mixed")).union(whole(tagged.where("times > 1")))
    spans = spans.union(every.where("times = 0").select("d", "t", F.col("at").alias("b"), F.col("c").alias("e")))
    shown = tagged.where("times > 1").groupBy("h", "c").agg(F.min(F.struct("d", "t", "at")).alias("who"), F.max("kinds").alias("kinds"))
    border = tagged.where("times = 1").select("h", "d", "t", "at", F.lit(True).alias("single"), "kinds")
    border = border.union(shown.select("h", "who.d", "who.t", "who.at", F.lit(False), "kinds")).withColumn("hot", F.col("kinds") > most_contexts)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["h", "d", "t", "first", "data", "single", "hot"]
        for pdf in batches:
            out: list[tuple] = []
            size = 0
            for d, t, x, cuts in zip(pdf["d"], pdf["t"], pdf["text"], pdf["cuts"]):
                data = x.encode("utf-8", "replace")
                for c in cuts:
                    f, k = c["at"] >> 21, c["at"] & (1 << 21) - 1
                    out.append((c["h"], d, t, f, data[f : f + k + length - 1], c["single"], c["hot"]))
                    size += k + length
                if size > 8_000_000:
                    yield pd.DataFrame(out, columns=names)
                    out, size = [], 0
            if out:
                yield pd.DataFrame(out, columns=names)

    # equal rows come twice, but no context of theirs is single, and only single ones report
    lists = border.groupBy("d", "t").agg(F.collect_list(F.struct("h", "at", "single", "hot")).alias("cuts"))
    pieces = keyed.select("d", "t", "text").join(lists, ["d", "t"]).mapInPandas(tidy(cut), PIECE)
    hot = tagged.where(F.col("kinds") > most_contexts).limit(1).count()
    if hot:
        pieces = durable(pieces)
    spans = spans.union(_index_blocks(pieces.where("not hot") if hot else pieces, length))
    hot_pieces = pieces.where("hot") if hot else None
    for gram in REFINE:
        if hot_pieces is None:
            break
        more, hot_pieces = _refine(hot_pieces, length, min(gram, length), most_contexts)
        spans = spans.union(more)
    if hot_pieces is not None:
        spans = spans.union(_count_windows(hot_pieces, length))
    return keyed, spans.groupBy("d", "t").agg(F.collect_list(F.struct("b", "e")).alias("spans"))


def _refine(pieces: DataFrame, length: int, gram: int, most_contexts: int) -> tuple[DataFrame, DataFrame | None]:
    """Spans of pieces that are dealt out again by a longer anchor, and the pieces whose new anchor is still too common."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            which, h, c, first, n = contexts(list(pdf["data"]), length, gram)
            own = pdf.iloc[which]
            data = [x[f : f + k + length - 1] for x, f, k in zip(own["data"], first.tolist(), n.tolist())]
            yield pd.DataFrame({"h": h.view(np.int64), "c": c.view(np.int64), "d": own["d"].to_numpy(), "t": own["t"].to_numpy(), "first": own["first"].to_numpy() + first, "data": data, "single": own["single"].to_numpy()})

    parts = durable(pieces.mapInPandas(tidy(split), PIECE.replace("h long,", "h long, c long,").replace(", hot boolean", "")))
    one = parts.groupBy("h", "c").agg(F.count(F.lit(1)).alias("times"))
    many = one.groupBy("h").agg(F.count(F.when(F.col("times") > 0, 1)).alias("kinds"))
    status = one.join(many, "h").where("times > 1 OR kinds > 1")
    tagged = durable(parts.join(status, ["h", "c"]))
    spans = tagged.where("times > 1 AND single").select("d", "t", F.col("first").alias("b"), (F.col("first") + F.octet_length("data")).alias("e"))
    lone = tagged.where("kinds > 1 AND times = 1").select("h", "d", "t", "first", "data", "single", "kinds")
    shown = tagged.where("kinds > 1 AND times > 1").groupBy("h", "c").agg(F.min(F.struct("d", "t", "first", "data")).alias("who"), F.max("kinds").alias("kinds"))
    border = lone.union(shown.select("h", "who.d", "who.t", "who.first", "who.data", F.lit(False), "kinds")).withColumn("hot", F.col("kinds") > most_contexts).drop("kinds")
    spans = spans.union(_index_blocks(border.where("not hot"), length))
    return spans, border.where("hot") if tagged.where(F.col("kinds") > most_contexts).limit(1).count() else None


def _count_windows(pieces: DataFrame, length: int) -> DataFrame:
    """Spans of single pieces whose windows occur twice, by the windows' own hashes."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out, size = [], 0
            for d, t, f, data, single in zip(pdf["d"], pdf["t"], pdf["first"], pdf["data"], pdf["single"]):
                a, b = window_hashes(data, length)
                out.append((np.full(len(a), d), np.full(len(a), t), f + np.arange(len(a)), a, b, np.full(len(a), single)))
                size += len(a)
                if size > 100_000:
                    yield pd.DataFrame(dict(zip("dtbwvs", map(np.concatenate, zip(*out)))))
                    out, size = [], 0
            if out:
                yield pd.DataFrame(dict(zip("dtbwvs", map(np.concatenate, zip(*out)))))

    windows = durable(pieces.mapInPandas(tidy(count), "d long, t long, b long, w long, v long, s boolean"))
    twice = windows.groupBy("w", "v").agg(F.count(F.lit(1)).alias("times")).where("times > 1").drop("times")
    return windows.where("s").join(twice, ["w", "v"], "left_semi").select("d", "t", "b", (F.col("b") + length).alias("e"))


def cut_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = 200, with_text: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and kept if asked for.

    Columns named in carry come along under their names. kept is the remaining bytes as text; where a removed span cut a character, its bytes are
    dropped from kept, never from the digest. Defined cases: a null text counts as empty; texts
    shorter than ``length`` bytes stay whole; a repeated row is a copy of its other and both go.
    """
    more = {f"__carried{k}": c for k, c in enumerate(carry)}
    own = column_or_null(docs, doc_id, "long")
    slim = docs.select(own.alias("doc_id"), own.cast("string").alias("__id"), column_or_null(docs, text, "string").alias("text"), *[F.col(f"`{c}`").alias(a) for a, c in more.items()])
    keyed, spans = repeated_spans(slim, length)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for x, found in zip(pdf["text"], pdf["spans"]):
                data = x.encode("utf-8", "replace")
                gone = merge([(s["b"], s["e"]) for s in found]) if found is not None else []
                parts, at = [], 0
                for b, e in gone:
                    parts.append(data[at:b])
                    at = e
                kept = b"".join([*parts, data[at:]])
                row = (len(data), len(data) - len(kept), len(gone), hashlib.sha256(kept).hexdigest())
                out.append((*row, kept.decode("utf-8", "ignore")) if with_text else row)
            frame = pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_text])
            yield frame.assign(doc_id=pdf["__id"].array, **{a: pdf[a].array for a in more})

    shape = T.StructType.fromDDL("doc_id string, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept string" * with_text)
    shape = T.StructType(shape.fields + [T.StructField(a, docs.schema[c].dataType) for a, c in more.items()])
    # ids travel as text, as pandas would make those beside a null inexact
    out = keyed.join(spans, ["d", "t"], "left").mapInPandas(tidy(run), shape)
    return out.withColumn("doc_id", F.col("doc_id").cast("long")).withColumnsRenamed(more)
