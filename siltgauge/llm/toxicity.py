"""Toxicity by a weighted lexicon, matched by Aho-Corasick after folding.

Trained here, on a bounded sample of labelled rows. Folding lowers case and undoes accents,
homoglyphs and digits that stand for letters. The lexicon has words and word beginnings that
toxic texts hold significantly more often than clean ones, weighted by the log ratio; phrases of
an entry and a neighbouring word that clean texts use are exceptions and cancel the match. The
score is a logistic function of the matched weight and of the matched weight per word, fitted on
rows that chose no entry.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import ahocorasick
import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_or_null, durable, widen
from .langid import held_out, smallest

WORDS = re.compile(r"[^\W\d_]+")
BASIC = str.maketrans("0134578@$!|", "oieastbasii")
LOOKS = dict(zip("аеіоорсухѕјһԁԛԝвкмнтαεικνορτυχβοɑɡıℓ", "aeioopcyxsjhdqwbkmhtaeikvoptuxbo" + "agil"))


def _fold_table() -> dict[int, str]:
    table: dict[int, str] = {k: chr(v) if isinstance(v, int) else v for k, v in BASIC.items()}
    for block in (range(0xC0, 0x250), range(0x1E00, 0x1F00), range(0xFF01, 0xFF5F), range(0x2100, 0x2150), range(0x1D400, 0x1D800)):
        for k in block:
            base = "".join(c for c in unicodedata.normalize("NFKD", chr(k)) if not unicodedata.combining(c)).lower()
            if base and base != chr(k):
                table[k] = "".join(chr(BASIC.get(ord(c), ord(c))) for c in base)
    table |= {ord(a): b for a, b in LOOKS.items()}
    table |= {k: "" for k in (*range(0x300, 0x370), 0xAD, *range(0x200B, 0x2010), 0x2060, 0xFEFF)}
    return table


FOLD = _fold_table()


def fold(text: str) -> str:
    low = text.lower()
    return low.translate(BASIC) if low.isascii() else low.translate(FOLD)


def _sketch(words: list[str]) -> tuple[int, int]:
    """Two minima of hashed word runs; near copies mostly share one."""
    runs = [" ".join(words[k : k + 6]).encode() for k in range(max(1, len(words) - 5))]
    return min(xxhash.xxh64_intdigest(r, 1) for r in runs), min(xxhash.xxh64_intdigest(r, 2) for r in runs)


class Lexicon:
    """Entries are stems with a weight; a stem that ends in "$" matches whole words only."""

    def __init__(self, weights: dict[str, float], exceptions: Iterable[str] = (), line: tuple[float, float, float] = (-3.0, 1.0, 0.0)):
        self.weights, self.exceptions, self.line = dict(weights), frozenset(exceptions), line
        self._build()

    def _build(self) -> None:
        self.machine = ahocorasick.Automaton()
        by: dict[str, list[tuple[str, bool]]] = {}
        for e in self.weights:
            by.setdefault(e.rstrip("$"), []).append((e, e.endswith("$")))
        for stem, entries in by.items():
            self.machine.add_word(stem, (stem, entries))
        if by:
            self.machine.make_automaton()

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "machine"}

    def __setstate__(self, state):
        self.__dict__ |= state
        self._build()

    def matches(self, folded: str) -> list[tuple[str, int, int]]:
        """(entry, begin, end of the word) of each word that an entry starts, longest entry first to win."""
        if not self.weights:
            return []
        best: dict[int, tuple[float, str, int]] = {}
        n = len(folded)
        for last, (stem, entries) in self.machine.iter(folded):
            begin = last - len(stem) + 1
            if begin and folded[begin - 1].isalpha():
                continue
            end = last + 1
            while end < n and folded[end].isalpha():
                end += 1
            for e, whole in entries:
                if (not whole or end == last + 1) and (begin not in best or best[begin][0] < self.weights[e]):
                    best[begin] = (self.weights[e], e, end)
        return [(e, b, end) for b, (_, e, end) in sorted(best.items())]

    def found(self, folded: str) -> list[tuple[str, str, str]]:
        """(entry, word before, word after) of each match; neighbours are whole words however far they are."""
        hits = self.matches(folded)
        if not hits:
            return []
        spans = [m.span() for m in WORDS.finditer(folded)]
        begins, ends = [b for b, _ in spans], [e for _, e in spans]
        out = []
        for entry, begin, end in hits:
            left, right = bisect_right(ends, begin) - 1, bisect_left(begins, end)
            out.append((entry, folded[slice(*spans[left])] if left >= 0 else "", folded[slice(*spans[right])] if right < len(spans) else ""))
        return out

    def features(self, text: str | None) -> tuple[float, float]:
        folded = fold(text or "")
        total = sum(self.weights[e] for e, left, right in self.found(folded) if f"{left} {e}" not in self.exceptions and f"{e} {right}" not in self.exceptions)
        words = max(1, folded.count(" ") + folded.count("\n") + 1)
        return math.log1p(total), math.log1p(100.0 * total / words)

    def score(self, text: str | None) -> float:
        a, b = self.features(text)
        z = self.line[0] + self.line[1] * a + self.line[2] * b
        return 1.0 / (1.0 + math.exp(-min(50.0, max(-50.0, z))))


def _llr(a: int, b: int, na: int, nb: int) -> float:
    """Log-likelihood ratio that the first class holds a thing more often than the second."""
    if a * nb <= b * na:
        return 0.0
    f = lambda x, y: x * math.log(x / y) if x else 0.0
    n, t = na + nb, a + b
    return 2 * (f(a, na * t / n) + f(b, nb * t / n) + f(na - a, na * (n - t) / n) + f(nb - b, nb * (n - t) / n))


def _once(rows: DataFrame) -> DataFrame:
    """(y, doc_id, text) of rows (doc_id, y, text) that have a word; near copies of a text come once, as a toxic one if any is."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            words = [WORDS.findall(fold(t)) for t in pdf["text"]]
            ok = np.array([bool(w) for w in words], bool)
            sketch = np.array([_sketch(w) for w in words if w], np.uint64).reshape(-1, 2).view(np.int64)
            yield pdf[ok].assign(a=sketch[:, 0], b=sketch[:, 1])

    first = F.struct(1 - F.col("y"), "doc_id", F.xxhash64("text"))
    out = rows.select("doc_id", "y", "text").mapInPandas(run, "doc_id long, y int, text string, a long, b long")
    for key in ("a", "b"):
        out = out.groupBy(key).agg(F.min_by(F.struct("doc_id", "y", "text", "a", "b"), first).alias("r")).select("r.*")
    return out.select("doc_id", "y", "text")


def _tally(rows: DataFrame, things: Callable[[str], Iterable[str]]) -> DataFrame:
    """(thing, bad, good): in how many toxic and clean texts each thing is; counted where the texts are."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sides: tuple[Counter, Counter] = (Counter(), Counter())
        for pdf in batches:
            for y, t in zip(pdf["y"], pdf["text"]):
                sides[y].update(things(fold(t)))
        every = list(sides[0].keys() | sides[1].keys())
        yield pd.DataFrame({"thing": every, "bad": [sides[1][x] for x in every], "good": [sides[0][x] for x in every]}).astype({"thing": str, "bad": int, "good": int})

    sums = rows.select("y", "text").mapInPandas(run, "thing string, bad long, good long")
    return sums.groupBy("thing").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))


def _stems(folded: str) -> set[str]:
    """Words, marked by a "$" at the end, and their beginnings of four to ten letters."""
    return {x for w in set(WORDS.findall(folded)) for x in (*(w[:k] for k in range(4, min(len(w), 10) + 1)), w + "$")}


def learn(rows: DataFrame, least: float = 20.0, most_entries: int = 5000) -> Lexicon:
    """A lexicon from labelled rows (doc_id, y, text); near copies of a text teach once.

    Stems and phrases are counted in executors; what reaches the driver are the significant ones,
    and two numbers for each row. Three rows of four choose the entries, the fourth sets the line
    from matches to scores; where these have not both classes, all rows do both.
    """
    once = durable(_once(rows).withColumn("part", F.pmod(F.xxhash64(F.lit("line"), "doc_id"), F.lit(4))))
    n = {(r["y"], r["sets"]): r["n"] for r in once.groupBy("y", (F.col("part") == 0).alias("sets")).agg(F.count(F.lit(1)).alias("n")).collect()}
    apart = all(n.get((y, x), 0) >= 20 for y in (0, 1) for x in (True, False))
    chooses = once.where("part <> 0") if apart else once
    count = lambda y: max(1, n.get((y, False), 0) + (0 if apart else n.get((y, True), 0)))
    na, nb = count(1), count(0)

    def significant(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            gain = [_llr(a, b, na, nb) for a, b in zip(pdf["bad"].tolist(), pdf["good"].tolist())]
            yield pdf.assign(gain=gain)[np.array(gain) >= least] if len(pdf) else pdf.assign(gain=[0.0] * 0)

    able = _tally(chooses, _stems).mapInPandas(significant, "thing string, bad long, good long, gain double").collect()
    weights: dict[str, float] = {}
    for r in sorted(able, key=lambda r: (-round(r["gain"], 6), -len(r["thing"].rstrip("$")), r["thing"])):
        if len(weights) >= most_entries:
            break
        e = r["thing"]
        stem = e.rstrip("$")
        ratio = math.log((r["bad"] + 0.5) / (na + 1)) - math.log((r["good"] + 0.5) / (nb + 1))
        related = any(stem[:k] in weights or stem[:k] + "$" in weights for k in range(4, len(stem) + 1)) or any(x.startswith(stem) for x in weights)
        if ratio >= 1.5 and not related:
            weights[e] = ratio
    if not weights:
        return Lexicon({})
    lex = Lexicon(weights)
    phrases = _tally(chooses, lambda folded: [p for e, left, right in lex.found(folded) for p in {f"{left} {e}", f"{e} {right}"}])
    clean = phrases.where((F.col("good") >= 3) & (F.col("good") / nb > 4 * (F.col("bad") + 1) / na))
    lex = Lexicon(weights, [r["thing"] for r in clean.collect()])

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = np.array([lex.features(t) for t in pdf["text"]], float).reshape(-1, 2)
            yield pd.DataFrame({"y": pdf["y"], "a": x[:, 0], "b": x[:, 1]})

    lines = once.where("part = 0") if apart else once
    seen = sorted(tuple(r) for r in lines.mapInPandas(measure, "y int, a double, b double").collect())
    y, x = np.array([r[0] for r in seen], float), np.array([(1.0, r[1], r[2]) for r in seen]).reshape(-1, 3)
    return Lexicon(weights, lex.exceptions, tuple(logistic(x, y)) if 0 < y.sum() < len(y) else (-3.0, 1.0, 0.0))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50, weight: np.ndarray | None = None) -> np.ndarray:
    """Weights of a logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    s = np.ones(len(y)) if weight is None else weight
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (s * (p - y)) + ridge * w
        hess = (x * (s * p * (1 - p))[:, None]).T @ x + (ridge + 1e-9) * np.eye(x.shape[1])
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max(initial=0) < 1e-8:
            break
    return w


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, per_class: int, keep: tuple[str, ...] = ("text",)) -> DataFrame:
    """At most per_class rows of each label 0 and 1, picked by hash, never held-out ones."""
    ids = labels.select(column_or_null(labels, "doc_id", "long").alias("pick"), column_or_null(labels, column, "int").alias("y"))
    ids = ids.where(F.col("pick").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("pick")))
    ids = smallest(ids, "y", "pick", per_class).select("pick", "y")
    rows = ids.collect()  # 2 * per_class at most
    few = docs.sparkSession.createDataFrame([(r["pick"], r["y"]) for r in rows], "pick long, y int")
    d = docs.select(column_or_null(docs, "doc_id", "long").alias("doc_id"), *[F.col(f"`{c}`") for c in keep])
    return d.join(F.broadcast(few), F.col("doc_id") == F.col("pick")).select("doc_id", "y", *keep)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 4000) -> Lexicon:
    """Learn from at most per_class labelled rows of each class."""
    return learn(labelled_sample(docs, labels, "toxic", per_class).where("text IS NOT NULL"))


def rate(docs: DataFrame, lexicon: Lexicon, text: str = "text", keep_text: bool = True) -> DataFrame:
    """docs with score and predicted.

    Defined cases: null and empty texts get the score of no match; with no labelled rows nothing
    matches and every score is that of no match; repeated rows get equal results; long texts are
    matched whole; columns of these names are replaced.
    """

    def run(pdf: pd.DataFrame) -> dict:
        scores = [lexicon.score(t if isinstance(t, str) else "") for t in pdf[text]]
        return {"score": scores, "predicted": [int(s >= 0.5) for s in scores]}

    return widen(docs, run, "score double, predicted int", drop=() if keep_text else (text,))
