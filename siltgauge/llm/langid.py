"""Language of whole texts: script ranges, per-word scores and Viterbi over the words.

Trained here, on a bounded sample of labelled rows: a smoothed letter-trigram model for each
language and the scripts that the language is written in. The script of a word narrows the
languages it may have; each word gets a log score for each language; Viterbi with a penalty for
every switch labels spans of a text. The text's language is the one whose spans hold most letters.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Table, column_or_null, widen

#: First code point of each range of scripts, and its name; "" has no script of its own.
RANGES = [
    (0x0, "latin"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "armenian"), (0x590, "hebrew"), (0x600, "arabic"), (0x700, "other"),
    (0x900, "devanagari"), (0x980, "indic"), (0xE00, "thai"), (0xE80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"),
    (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3130, "hangul"), (0x3190, "other"),
    (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD800, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB50, "arabic"),
    (0xFE00, "other"), (0xFF20, "latin"), (0xFF60, "kana"), (0xFFA0, "hangul"), (0xFFE0, "other"), (0x20000, "han"),
]
STARTS = [r[0] for r in RANGES]
#: Letters of scripts that set no spaces between words.
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3041-\u30ff\u3400-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff"
HAS_UNSPACED = re.compile(f"[{UNSPACED}]")
PIECES = re.compile(rf"[{UNSPACED}]{{1,4}}|[^\s{UNSPACED}]+")


def words_of(text: str) -> list[str]:
    """The words that are scored; where a script sets no spaces, up to four letters at a time."""
    return PIECES.findall(text) if not text.isascii() and HAS_UNSPACED.search(text) else text.split()


@lru_cache(1)
def _letters() -> np.ndarray:
    """Whether each code point is a letter: general category L."""
    return np.array([unicodedata.category(chr(k))[0] == "L" for k in range(0x110000)])


def script(letter: str) -> str:
    return RANGES[bisect_right(STARTS, ord(letter)) - 1][1]


def trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(trigram, word, letter) around each letter of the lower-cased words; what is no letter counts as a space.

    A trigram is the three code points in one number.
    """
    text = "\n".join(words).lower()
    code = np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    is_letter = _letters()[code]
    shown = np.where(is_letter, code, 32)
    at = np.nonzero(is_letter)[0]
    return (shown[at - 1] << 42) | (shown[at] << 21) | shown[at + 1], np.cumsum(code == 10)[at], code[at]


def spell(gram: int) -> str:
    return "".join(chr(gram >> k & (1 << 21) - 1) for k in (42, 21, 0))


def held_out(doc_id):
    """crc32 of the id as text divides by 5: such rows never teach."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


class Model:
    """Letter trigrams of each language with add-k smoothing, as rows of log probabilities."""

    FLOOR = -7.0

    def __init__(self, counts: dict[str, Counter], scripts: dict[str, Counter], smooth: float = 0.3):
        self.langs = sorted(counts)
        ids: dict[str, int] = {}
        for c in counts.values():
            for t in c:
                ids.setdefault(t, len(ids))
        n, k = len(ids), len(self.langs)
        table = np.zeros((n + 1, k))
        for j, lang in enumerate(self.langs):
            head: Counter = Counter()
            for t, m in counts[lang].items():
                head[t[:2]] += m
            for t, i in ids.items():
                table[i, j] = np.log((counts[lang][t] + smooth) / (head[t[:2]] + smooth * 40))
            table[n, j] = np.log(1 / 40)
        # what counts is the difference between languages, and no trigram decides alone
        table -= table.max(1, keepdims=True) if k else 0
        self.table = np.maximum(table, self.FLOOR).astype(np.float32)
        code = lambda t: (ord(t[0]) << 42) | (ord(t[1]) << 21) | ord(t[2])
        self.ids = Table(np.array([code(t) for t in ids], np.int64), np.arange(n, dtype=np.int32))
        self.scripts = {s: np.array([scripts[lang][s] >= 0.01 * max(1, sum(scripts[lang].values())) for lang in self.langs]) for s in {s for c in scripts.values() for s in c}}

    def score(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(log score of each word for each language, 0 for the best; its number of letters)."""
        gram, word, letter = trigrams(words)
        out = np.zeros((len(words), len(self.langs)), np.float32)
        if len(word):
            first = np.nonzero(np.concatenate(([True], word[1:] != word[:-1])))[0]
            for at in range(0, len(first), 16384):  # rows of the table are gathered for a bounded number of words
                b, e = first[at], first[at + 16384] if at + 16384 < len(first) else len(word)
                out[word[first[at : at + 16384]]] = np.add.reduceat(self.table[self.ids.get(gram[b:e])], first[at : at + 16384] - b, axis=0)
        kind = np.searchsorted(STARTS, letter, "right") - 1
        for s in {RANGES[k][1] for k in np.unique(kind).tolist()}:
            ok = self.scripts.get(s)
            if ok is not None and ok.any() and not ok.all():
                named = [k for k, r in enumerate(RANGES) if r[1] == s]
                out[np.ix_(np.unique(word[np.isin(kind, named)]), ~ok)] = -50.0
        out -= out.max(1, keepdims=True, initial=-1e9)
        return np.maximum(out, -50.0), np.bincount(word, minlength=len(words))


def cuts(scores: np.ndarray, penalty: float, apart: int = 64) -> np.ndarray:
    """Places before which the best labelling is settled, whatever comes before and after.

    In a run of words that one label leads, every other falls behind by more than two penalties
    at some point. From then on, the path to any label at the next word comes from the leader.
    Of such places about one in ``apart`` is taken.
    """
    if len(scores) < 2 * apart or scores.shape[1] < 2:
        return np.zeros(0, np.int64)
    lead = scores.argmax(1)
    others = scores.copy()
    others[np.arange(len(lead)), lead] = -np.inf
    gap = np.cumsum(np.maximum(others.max(1), -50.0), dtype=np.float64)
    fresh = np.concatenate(([True], lead[1:] != lead[:-1]))
    start = np.maximum.accumulate(np.where(fresh, np.arange(len(lead)), 0))
    step = np.diff(gap, prepend=0.0)
    settled = np.nonzero((gap - gap[start] + step[start] < -2 * penalty - 1e-3) & (step < -1e-3))[0]
    settled = settled[settled < len(lead) - 1]
    return settled[np.unique(settled // apart, return_index=True)[1]] + 1


def viterbi(rows: list[np.ndarray], penalty: float, lanes: int = 4096) -> list[np.ndarray]:
    """Best label of each word of each text, where each change of label costs the penalty.

    Texts are cut where nothing beyond the cut matters, and the parts go in lockstep, longest
    first. Ties keep the label, and else take the first.
    """
    out: list[np.ndarray] = [np.zeros(len(r), np.int32) for r in rows]
    parts: list[tuple[int, int, int, int]] = []  # text, begin, end, label before or -1
    for i, r in enumerate(rows):
        at, led = 0, -1
        for c in cuts(r, penalty).tolist():
            parts.append((i, at, c, led))
            at, led = c, int(r[c - 1].argmax())
        if len(r) > at:
            parts.append((i, at, len(r), led))
    parts.sort(key=lambda p: p[1] - p[2])
    for g in range(0, len(parts), lanes):
        group = parts[g : g + lanes]
        lens = np.array([e - b for _, b, e, _ in group])
        begins = np.cumsum(lens) - lens
        every = np.concatenate([rows[i][b:e] for i, b, e, _ in group])
        led = np.array([p[3] for p in group])
        value = every[begins].astype(np.float64)
        value[led >= 0] -= penalty
        value[led >= 0, led[led >= 0]] += penalty
        steps: list[tuple[np.ndarray, np.ndarray]] = []
        live = len(group)
        for t in range(1, int(lens[0])):
            live = int(np.searchsorted(-lens, -t, "left"))
            v = value[:live]
            top = v.argmax(1)
            jump = v[np.arange(live), top][:, None] - penalty
            moved = jump > v
            steps.append((moved, top.astype(np.int32)))
            value[:live] = np.where(moved, jump, v) + every[begins[:live] + t]
        label = value.argmax(1)
        labels = np.zeros(len(every), np.int32)
        for t in range(int(lens[0]) - 1, -1, -1):
            live = int(np.searchsorted(-lens, -t, "left"))
            labels[begins[:live] + t] = label[:live]
            if t:
                moved, top = steps[t - 1]
                now = label[:live]
                label[:live] = np.where(moved[np.arange(live), now], top, now)
        for (i, b, e, _), k in zip(group, begins.tolist()):
            out[i][b:e] = labels[k : k + e - b]
    return out


def smallest(ids: DataFrame, group: str, pick: str, most: int) -> DataFrame:
    """The ``most`` rows of each group with the smallest hash of pick.

    Each group is first thinned by a bound on the hash that leaves about three times as many, so
    that no task sees a whole group; random hashes leave fewer than ``most`` all but never. Groups are
    classes or languages, for each of which the driver holds a model, so their counts are broadcast.
    """
    n = ids.groupBy(F.col(group).alias("__g")).agg(F.count(F.lit(1)).alias("__n"))
    rows = ids.withColumn("__h", F.xxhash64(pick)).join(F.broadcast(n), F.col(group) == F.col("__g"))
    share = F.shiftrightunsigned("__h", 11) / F.lit(float(2**53))
    rows = rows.where((F.col("__n") <= 3 * most) | (share * F.col("__n") < 3 * most))
    nth = F.row_number().over(Window.partitionBy(group).orderBy("__h", pick))
    return rows.withColumn("__k", nth).where(F.col("__k") <= most).drop("__g", "__n", "__h", "__k")


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", per_lang: int = 1000) -> Model:
    """Learn every language of the table from at most per_lang of its rows.

    Rows whose crc32 of the id is divisible by 5 are left out, and so are null languages.
    """
    d = docs.select(column_or_null(docs, doc_id, "long").alias("doc_id"), column_or_null(docs, lang, "string").alias("lang"), column_or_null(docs, text, "string").alias("text"))
    d = d.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    ids = smallest(d.select("lang", F.col("doc_id").alias("pick")), "lang", "pick", per_lang)
    picks = [r[0] for r in ids.select("pick").distinct().collect()]  # at most per_lang for each language
    few = d.sparkSession.createDataFrame([(p,) for p in picks], "pick long")
    counts: dict[str, Counter] = defaultdict(Counter)
    scripts: dict[str, Counter] = defaultdict(Counter)

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams: dict[str, Counter] = defaultdict(Counter)
        for pdf in batches:
            for lang_, x in zip(pdf["lang"], pdf["text"]):
                gram, _, letter = trigrams(words_of(x or ""))
                made, n = np.unique(gram, return_counts=True)
                grams[lang_].update(dict(zip(map(spell, made.tolist()), n.tolist())))
                made, n = np.unique(np.searchsorted(STARTS, letter, "right") - 1, return_counts=True)
                for k, m in zip(made.tolist(), n.tolist()):
                    grams[lang_]["#" + RANGES[k][1]] += m
        for lang_, c in grams.items():
            if c:  # texts without a letter teach nothing
                yield pd.DataFrame({"lang": lang_, "gram": list(c), "n": list(c.values())})

    sums = d.join(F.broadcast(few), d["doc_id"] == few["pick"], "left_semi").select("lang", "text").mapInPandas(tally, "lang string, gram string, n long")
    for r in sums.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toLocalIterator():
        if r["gram"].startswith("#") and len(r["gram"]) > 3:
            scripts[r["lang"]][r["gram"][1:]] += r["n"]
        else:
            counts[r["lang"]][r["gram"]] += r["n"]
    return Model(dict(counts), {k: scripts[k] for k in counts})


def label(docs: DataFrame, model: Model, text: str = "text", penalty: float = 6.0, spans: bool = False, keep_text: bool = True) -> DataFrame:
    """docs with lang_pred and score, and spans (label, first word, end word) if asked for.

    score is the share of letters inside spans of the language that won. Defined cases: a text
    that is null or has no letter is ``und`` with score 0, and so is every text of a model without
    languages; repeated rows get equal results; a very long text is held as words, alone;
    columns of these names are replaced.
    """

    def run(pdf: pd.DataFrame) -> dict:
        texts = [t if isinstance(t, str) else "" for t in pdf[text]]
        langs = model.langs
        pred, score, found = ["und"] * len(texts), [0.0] * len(texts), [[] for _ in texts]
        at = 0 if langs else len(texts)
        room = 1_000_000 * 32 // max(32, len(langs))
        while at < len(texts):  # only texts that together have a bounded length are held as words
            end, n = at, 0
            while end < len(texts) and (end == at or n + len(texts[end]) <= room):
                n += len(texts[end])
                end += 1
            part = [words_of(t) for t in texts[at:end]]
            index = {w: i for i, w in enumerate(set().union(*part))}
            scores, letters = model.score(list(index))
            where = [np.fromiter(map(index.__getitem__, c), np.int64, len(c)) for c in part]
            labels = viterbi([scores[w] for w in where], penalty)
            for k, w in enumerate(where):
                n_letters = letters[w]
                total = int(n_letters.sum())
                if not total:
                    continue
                sums = np.bincount(labels[k], n_letters, len(langs))
                best = int(sums.argmax())
                pred[at + k], score[at + k] = langs[best], float(sums[best] / total)
                if spans:
                    edge = np.nonzero(np.diff(labels[k]))[0] + 1
                    ends = [0, *edge.tolist(), len(w)]
                    found[at + k] = [{"lang": langs[int(labels[k][b])], "begin": b, "end": e} for b, e in zip(ends, ends[1:])]
            at = end
        return {"lang_pred": pred, "score": score} | ({"spans": found} if spans else {})

    return widen(docs, run, "lang_pred string, score double" + ", spans array<struct<lang:string,begin:int,end:int>>" * spans, drop=() if keep_text else (text,))


def identify(docs: DataFrame, doc_id: str = "doc_id", **kw) -> DataFrame:
    """Fit on docs and label all of docs: doc_id, held_out, lang_pred, score."""
    model = fit(docs, doc_id=doc_id)
    slim = docs.select(column_or_null(docs, doc_id, "long").alias("doc_id"), column_or_null(docs, "text", "string").alias("text"))
    slim = slim.withColumn("held_out", held_out(F.col("doc_id")))
    return label(slim, model, keep_text=False, **kw)
