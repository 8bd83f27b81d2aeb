"""Quality by co-training: a text-content view and a page-metadata view teach each other.

Each view is a logistic model over binned features, so that a feature can be bad at both ends. The
text view sees the text alone, the metadata view only what documents say beside it. In each round
either model scores all unlabelled documents and lends the other those of which it is surest, some
of each class. Then each view is calibrated by itself on labelled rows that taught neither, and a
small logistic model combines the calibrated views into the score of every document.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_or_null, durable, widen
from .langid import held_out
from .toxicity import labelled_sample, logistic

TEXT_NAMES = (
    "letters", "upper", "digits", "symbols", "unique", "commonest", "repeated_lines", "word_length", "sentence_ends",
    "log_lines", "line_length", "bytes_per_char",
)
META_NAMES = ("log_chars", "source", "lang")
HASHED = 32  # classes that a source or language is hashed to
BINS = 12


@lru_cache(1)
def _classes() -> np.ndarray:
    """0 space, 1 small letter, 2 capital, 3 digit, 4 symbol, for every code point."""
    out = np.full(0x110000, 4, np.uint8)
    kinds = {"Lu": 2, "Lt": 2, "Ll": 1, "Lo": 1, "Lm": 1, "Mn": 1, "Mc": 1, "Nd": 3, "Nl": 3, "No": 3, "Zs": 0, "Zl": 0, "Zp": 0}
    for k in (*range(0x3400), *range(0xA000, 0x10000)):
        out[k] = kinds.get(unicodedata.category(chr(k)), 4)
    out[0x3400:0xA000] = 1
    out[0x10000:0x1F000] = 1
    out[0x20000:0x32000] = 1
    out[9:14] = 0
    return out


def text_view(text: str) -> list[float]:
    n = max(1, len(text))
    kinds = np.bincount(_classes()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")], minlength=5) if text else np.zeros(5)
    words = text.split()
    counts = Counter(words)
    w = max(1, len(words))
    lines = [x for x in text.split("\n") if x.strip()]
    n_lines = text.count("\n") + 1
    ends = text.count(".") + text.count("!") + text.count("?")
    # shares over all words fall with length, as words repeat; Guiraud's root keeps them comparable
    return [
        float(kinds[1] + kinds[2]) / n, float(kinds[2]) / n, float(kinds[3]) / n, float(kinds[4]) / n, len(counts) / w**0.85,
        max(counts.values(), default=0) / w, 1 - len(set(lines)) / max(1, len(lines)), n / w, ends / w,
        float(np.log1p(n_lines)), len(text) / n_lines, len(text.encode("utf-8", "replace")) / n,
    ]


def meta_view(n_chars: int, source: str | None, lang: str | None) -> list[float]:
    code = lambda x: float(zlib.crc32((x or "").encode("utf-8", "replace")) % HASHED)
    return [float(np.log1p(max(0, n_chars))), code(source), code(lang)]


class View:
    """Logistic model over features cut into quantile bins; the last ``hashed`` features are classes."""

    def __init__(self, hashed: int):
        self.hashed = hashed
        self.cuts: list[np.ndarray] = []
        self.weights = np.zeros(1)

    def cut(self, x: np.ndarray) -> None:
        plain = x.shape[1] - self.hashed
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(plain)]

    def spread(self, x: np.ndarray) -> np.ndarray:
        parts = [np.ones((len(x), 1))]
        for j in range(x.shape[1]):
            plain = j < len(self.cuts)
            k = np.searchsorted(self.cuts[j], x[:, j], "right") if plain else x[:, j].astype(int)
            hot = np.zeros((len(x), len(self.cuts[j]) + 1 if plain else HASHED))
            hot[np.arange(len(x)), k] = 1
            parts.append(hot)
        return np.concatenate(parts, 1)

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        self.weights = logistic(self.spread(x), y, 1.0, 25, weight)

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.spread(x) @ self.weights


class CoModel:
    """Two views, the calibration of each, and what combines them; without both classes every score is 0.5."""

    def __init__(self):
        self.views = {"text": View(0), "meta": View(2)}
        self.lines: dict[str, np.ndarray] = {}
        self.stack: np.ndarray | None = None
        self.taught: list[tuple[int, int]] = []

    def calibrated(self, name: str, x: np.ndarray) -> np.ndarray:
        """Log odds of a view, calibrated by itself."""
        margin = self.views[name].margin(x)
        return np.clip(np.stack([np.ones(len(x)), margin], 1) @ self.lines[name], -30, 30)

    def settle(self, x: dict[str, np.ndarray], y: np.ndarray) -> None:
        """Calibrate each view on rows that taught neither, then combine them."""
        for name, view in self.views.items():
            self.lines[name] = logistic(np.stack([np.ones(len(y)), view.margin(x[name])], 1), y, 0.1)
        self.stack = logistic(self._both(x), y, 0.1)

    def _both(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return np.stack([np.ones(len(x["text"])), self.calibrated("text", x["text"]), self.calibrated("meta", x["meta"])], 1)

    def score(self, xt: np.ndarray, xm: np.ndarray) -> np.ndarray:
        if self.stack is None or not len(xt):
            return np.full(len(xt), 0.5)
        return 1 / (1 + np.exp(-np.clip(self._both({"text": xt, "meta": xm}) @ self.stack, -30, 30)))


def _slim(docs: DataFrame) -> DataFrame:
    text = column_or_null(docs, "text", "string")
    return docs.select(
        column_or_null(docs, "doc_id", "long").alias("doc_id"), text.alias("text"), column_or_null(docs, "source", "string").alias("source"),
        column_or_null(docs, "lang", "string").alias("lang"), F.coalesce(column_or_null(docs, "n_chars", "long"), F.length(text), F.lit(0)).alias("n_chars"),
    )


def _views(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    xt = [text_view(t if isinstance(t, str) else "") for t in pdf["text"]]
    xm = [meta_view(n, s, g) for n, s, g in zip(pdf["n_chars"].tolist(), pdf["source"], pdf["lang"])]
    return np.array(xt).reshape(-1, len(TEXT_NAMES)), np.array(xm).reshape(-1, len(META_NAMES))


def _stack(cells, names: tuple[str, ...]) -> np.ndarray:
    return np.array([list(x) for x in cells], float).reshape(-1, len(names))


def _featured(slim: DataFrame) -> DataFrame:
    """(doc_id, xt, xm) of every row: the features of both views."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 1000):
                part = pdf.iloc[at : at + 1000]
                xt, xm = _views(part)
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64").array, "xt": list(xt), "xm": list(xm)})

    return slim.mapInPandas(run, "doc_id long, xt array<double>, xm array<double>")


def _surest(free: DataFrame, model: CoModel, lent: int, sure: float) -> list:
    """Of all unlabelled rows, for each view and class the ``lent`` of which the view is surest.

    Each batch passes on its own best, so what is sorted is a small part of the rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for name, x in (("text", _stack(pdf["xt"], TEXT_NAMES)), ("meta", _stack(pdf["xm"], META_NAMES))):
                p = 1 / (1 + np.exp(-np.clip(model.views[name].margin(x), -30, 30)))
                for y, q in ((1, p), (0, 1 - p)):
                    best = np.lexsort((pdf["doc_id"].to_numpy(), pdf["k"].to_numpy(), -q))[:lent]
                    best = best[q[best] >= sure]
                    out.append(pdf.iloc[best].assign(view=name, y=y, q=np.round(q[best], 12)))
            yield pd.concat(out)

    kinds = "doc_id long, xt array<double>, xm array<double>, k long, view string, y int, q double"
    best = durable(free.mapInPandas(run, kinds))
    order = (F.desc("q"), "k", "doc_id", F.xxhash64("xt"))
    return [r for v in ("text", "meta") for y in (0, 1) for r in best.where((F.col("view") == v) & (F.col("y") == y)).orderBy(*order).limit(lent).collect()]


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 3000, rounds: int = 4, lent: int = 300, sure: float = 0.9) -> CoModel:
    """Learn from at most per_class labelled rows of each class, and from all rows without a label.

    In each round a view lends at most ``lent`` rows of each class, the surest of all unlabelled rows;
    only their features reach the driver. Rows whose crc32 of the id is divisible by 5 never teach.
    """
    slim = _slim(docs)
    known = labelled_sample(slim, labels, "quality", per_class, ("text", "source", "lang", "n_chars"))
    marks = known.select("doc_id", "y").distinct()
    rows = _featured(known).join(F.broadcast(marks), "doc_id").collect()  # at most per_class of each class
    rows.sort(key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), r["doc_id"], r["y"], r["xt"]))
    y = np.array([r["y"] for r in rows], float)
    model = CoModel()
    if not 0 < y.sum() < len(y):
        return model
    x = {"text": _stack([r["xt"] for r in rows], TEXT_NAMES), "meta": _stack([r["xm"] for r in rows], META_NAMES)}
    held = np.arange(len(y)) % 5 == 4
    if not 0 < y[held].sum() < held.sum() or not 0 < y[~held].sum() < (~held).sum():
        held = np.zeros(len(y), bool)
    borrowed: dict[str, dict[tuple, tuple]] = {"text": {}, "meta": {}}

    def teach(name: str) -> None:
        more = list(borrowed[name].values())
        every = np.concatenate([x[name][~held], _stack([m[0] for m in more], TEXT_NAMES if name == "text" else META_NAMES)])
        model.views[name].fit(every, np.concatenate([y[~held], [m[1] for m in more]]), np.concatenate([np.ones((~held).sum()), np.full(len(more), 0.3)]))

    for name, view in model.views.items():
        view.cut(x[name])
        teach(name)
    named = labels.select(column_or_null(labels, "doc_id", "long").alias("pick"))
    free = _featured(slim.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))))  # before the join, as features are small and texts aren't
    free = durable(free.join(named, F.col("doc_id") == F.col("pick"), "left_anti").withColumn("k", F.xxhash64("doc_id")))
    for _ in range(rounds):
        added = {"text": 0, "meta": 0}
        for r in _surest(free, model, lent, sure):
            other = "meta" if r["view"] == "text" else "text"
            key = (r["doc_id"], *r["xt"])
            if key not in borrowed[other]:
                borrowed[other][key] = (r["xt"] if other == "text" else r["xm"], float(r["y"]))
                added[r["view"]] += 1
        model.taught.append((added["text"], added["meta"]))
        if not any(added.values()):
            break
        for name in model.views:
            teach(name)
    at = held if held.any() else np.ones(len(y), bool)
    model.settle({k: v[at] for k, v in x.items()}, y[at])
    return model


def rate(docs: DataFrame, model: CoModel) -> DataFrame:
    """doc_id, held_out, score (that quality is 1) and predicted for every document.

    Defined cases: a null text counts as empty and is scored as such; null sources and languages
    are a class of their own, and a null n_chars is the text's length; repeated rows get equal
    results; long texts are measured whole; other columns are left out; without labels of both
    classes every score is 0.5.
    """

    def run(pdf: pd.DataFrame) -> dict:
        p = model.score(*_views(pdf))
        return {"score": p, "predicted": (p >= 0.5).astype("int32")}

    slim = _slim(docs).withColumn("held_out", held_out(F.col("doc_id")))
    return widen(slim, run, "score double, predicted int", drop=("text", "source", "lang", "n_chars")).select("doc_id", "held_out", "score", "predicted")
