"""BPE encoding as a bounded-lookahead streaming transducer, and decoding as a state machine.

The vocabulary is a tokenizer file of the kind that names a BPE model with an end-of-word
suffix. Text is cut at special tokens and white space, each chunk is normalised and cut into
words, and each word streams through the :class:`Transducer`.

Each prefix of a word has one BPE encoding, and its last token is the only one that ends there and
stands validly next to the encoding of what precedes it. So the transducer keeps, for the prefixes
that a later token can still begin behind, their last token and where it began. How far back those
reach, the sufficient lookahead, follows from the merge list: it is the length of the longest
token that BPE can yield at all. Tokens that all these live prefixes share are stable and leave
the window; what is kept never grows with the word.

Words are streamed side by side, a symbol of each at a time, as lanes of arrays. When few are left,
each goes on alone in :meth:`Transducer.stream`, by the same steps. Finished words and chunks are
kept in tables of bounded size, which lose their older half when they are full.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from collections import deque
from collections.abc import Iterable, Iterator
from functools import cached_property
from itertools import islice

import numpy as np
import regex
import tokenizers
from pyspark.sql import DataFrame

from .common import Table, widen

NEVER = np.iinfo(np.int32).max


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in vocabulary files of byte-level BPE."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    out = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
    return [out[b] for b in range(256)]


class Transducer:
    """Encodes words symbol by symbol; memory is bounded by the lookahead, not by the word.

    Tokens are numbered by birth: symbols first, then one for each merge in its order, so that a
    number is also the time at which merging makes the token.
    """

    FEW = 24  # lanes below which each goes on alone

    def __init__(self, vocab: dict[str, int], merges: Iterable[tuple[str, str]]):
        made = [(a, b, a + b) for a, b in merges]
        results = {m for _, _, m in made}
        self.tokens = [t for t in vocab if t not in results]
        self.symbols = len(self.tokens)
        self.born = {t: k for k, t in enumerate(self.tokens)}
        left, right = [-1] * self.symbols, [-1] * self.symbols
        for a, b, m in made:
            if m not in self.born and a in self.born and b in self.born:
                left.append(self.born[a])
                right.append(self.born[b])
                self.born[m] = len(self.tokens)
                self.tokens.append(m)
        n = len(self.tokens)
        self.left, self.right = np.array(left, np.int32), np.array(right, np.int32)
        self.ids = np.array([vocab[t] for t in self.tokens], np.uint32)
        merged = np.arange(self.symbols, n)
        keys = self.left[merged].astype(np.int64) * n + self.right[merged]
        self.pairs = Table(keys, merged)
        self.reachable = self._reachable(merged)
        self._spell()
        self.alone: dict[int, bool] = {}

    def _reachable(self, merged: np.ndarray) -> np.ndarray:
        """Tokens that BPE makes of their own spelling: no merge over the border of their parts comes first."""
        ok = np.ones(len(self.tokens), bool)
        ok[merged] = self.fit(self.left[merged], self.right[merged], merged)
        for t in merged.tolist():
            if ok[t]:
                ok[t] = ok[self.left[t]] and ok[self.right[t]]
        return ok

    def _spell(self) -> None:
        """A trie over reachable tokens read backwards; a node is a string that ends a token."""
        spelled: list[tuple[int, ...]] = []
        for t, (a, b) in enumerate(zip(self.left.tolist(), self.right.tolist())):
            spelled.append((t,) if a < 0 else spelled[a] + spelled[b])
        some = np.nonzero(self.reachable)[0]
        length = np.array([len(spelled[t]) for t in some.tolist()])
        #: No token is longer: behind a prefix that ended so long ago nothing can begin any more.
        self.lookahead = int(length.max(initial=1))
        node, total = np.zeros(len(some), np.int64), 1
        token = [np.full(1, -1, np.int32)]
        keys, kids = [], []
        for depth in range(self.lookahead):
            on = np.nonzero(length > depth)[0]
            last = np.array([spelled[t][-1 - depth] for t in some[on].tolist()], np.int64)
            made, which = np.unique(node[on] * self.symbols + last, return_inverse=True)
            keys.append(made)
            kids.append(total + np.arange(len(made), dtype=np.int32))
            node[on] = total + which
            names = np.full(len(made), -1, np.int32)
            full = length[on] == depth + 1
            names[which[full]] = some[on][full]
            token.append(names)
            total += len(made)
        keys, kids = np.concatenate(keys), np.concatenate(kids)
        self.trie, self.token_at = Table(keys, kids), np.concatenate(token)

    @cached_property
    def kid_of(self) -> dict[int, int]:
        """The trie as a dict, for words that stream alone; built when the first comes."""
        return self.trie.items()

    @cached_property
    def pair_of(self) -> dict[int, int]:
        return self.pairs.items()

    def fit(self, a: np.ndarray, b: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
        """Whether tokens a and b may stand side by side (until some time, if given).

        Merging is run backwards from the two whole tokens: of the pieces at the border the one
        born later is split. A merge over the border happens if it comes before both pieces are
        used up by merges of their own sides; of one rule's merges the leftmost comes first.
        """
        n = len(self.tokens)
        ok = np.ones(len(a), bool)
        lane = np.arange(len(a))
        used_a = np.full(len(a), NEVER, np.int32) if until is None else until.astype(np.int32)
        used_b = used_a.copy()
        while len(lane):
            m = self.pairs.get(a.astype(np.int64) * n + b)
            bad = (m >= 0) & (m < used_a) & (m <= used_b)
            ok[lane[bad]] = False
            go = np.nonzero(~bad & (np.maximum(a, b) >= self.symbols))[0]
            lane, a, b, used_a, used_b = lane[go], a[go], b[go], used_a[go], used_b[go]
            first = a >= b
            used_a, used_b = np.where(first, a, used_a), np.where(first, used_b, b)
            a, b = np.where(first, self.right[a], a), np.where(first, b, self.left[b])
        return ok

    def fits(self, a: int, b: int) -> bool:
        """fit() of one pair, remembered."""
        key = a * len(self.tokens) + b
        if key not in self.alone:
            if len(self.alone) >= 200_000:
                self.alone = dict(islice(self.alone.items(), 100_000, None))
            self.alone[key] = self._fits(a, b)
        return self.alone[key]

    def _fits(self, a: int, b: int) -> bool:
        n, used_a, used_b = len(self.tokens), NEVER, NEVER
        while True:
            m = self.pair_of.get(a * n + b, NEVER)
            if m < used_a and m <= used_b:
                return False
            if a < self.symbols and b < self.symbols:
                return True
            if a >= b:
                used_a, a = a, int(self.right[a])
            else:
                used_b, b = b, int(self.left[b])

    def stream(self, symbols: Iterable[int]) -> Iterator[int]:
        """Ids of one word's tokens, each as soon as no later symbol can change it."""
        window: deque[int] = deque(maxlen=self.lookahead)
        ends = {0: (-1, -1)}  # live prefix: its last token and where that begins
        done, at = 0, 0
        for s in symbols:
            window.append(s)
            at += 1
            node, back = 0, at
            for x in reversed(window):
                node = self.kid_of.get(node * self.symbols + x)
                back -= 1
                if node is None or back < done:
                    break
                t = int(self.token_at[node])
                if t >= 0 and back in ends and (ends[back][0] < 0 or self.fits(ends[back][0], t)):
                    ends[at] = (t, back)
                    break
            if at not in ends:
                raise ValueError("a symbol without a token")
            if at % self.lookahead == 0:
                path = self._path(ends, self._shared(ends, at, done), done)
                yield from (int(self.ids[t]) for _, t in path)
                if path:
                    done = path[-1][0]
                    ends = {p: v for p, v in ends.items() if p >= done}
        yield from (int(self.ids[t]) for _, t in self._path(ends, at, done))

    def _shared(self, ends: dict, at: int, done: int) -> int:
        """The last end that the encodings of all live prefixes have in common."""
        live = {p for p in range(max(done, at - self.lookahead + 1), at + 1)}
        while len(live) > 1:
            far = max(live)
            live.remove(far)
            live.add(max(done, ends[far][1]))
        return live.pop()

    @staticmethod
    def _path(ends: dict, at: int, done: int) -> list[tuple[int, int]]:
        """(end, token) of the tokens between two ends."""
        out = []
        while at > done:
            out.append((at, ends[at][0]))
            at = ends[at][1]
        return out[::-1]

    def lanes(self, symbols: np.ndarray, size: np.ndarray, room: int = 5) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the tokens of all words, and each word's number of them; words are streamed side by side.

        symbols has the words one after the other. A lane's window has ``room`` lookaheads. When it
        is full, what all live prefixes share is emitted and the window moves on by all but two lookaheads.
        """
        begin, order = np.cumsum(size) - size, np.argsort(-size, kind="stable")
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # word, end, id
        for g in range(0, len(order), 16384):
            group = order[g : g + 16384]
            if size[group[0]]:
                found += self._lanes(symbols, begin[group], size[group], group, room * self.lookahead)
        word, end, ids = map(np.concatenate, zip(*found)) if found else (np.zeros(0, np.int64),) * 3
        return ids[np.argsort((word << 32) + end, kind="stable")], np.bincount(word, minlength=len(size))

    def _lanes(self, symbols: np.ndarray, begin: np.ndarray, size: np.ndarray, word: np.ndarray, wide: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(word, end, id) of the tokens of words that are sorted, longest first."""
        wide = min(wide, int(size[0]))
        last, back = (np.full((wide + 1, len(size)), fill, np.int32) for fill in (-1, 0))
        symbol = np.zeros((wide + 1, len(size)), np.int64)
        root = np.zeros(len(size), np.int64)  # what ends at or before it has been emitted
        solo = np.zeros(len(size), bool)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def emit(lane: np.ndarray, end: np.ndarray) -> None:
            while len(lane):
                go = (end > root[lane]) & ~solo[lane]
                lane, end = lane[go], end[go]
                found.append((lane, end + shift, self.ids[last[end, lane]]))
                end = back[end, lane].astype(np.int64)

        shift, col, live = 0, 0, len(size)
        for t in range(int(size[0]) + 1):
            now = int(np.searchsorted(-size, -t, "left"))  # lanes that have a symbol t
            emit(np.arange(now, live), np.full(live - now, col))
            live = now
            if live < self.FEW:
                solo[:live] = True
                break
            if col == wide:
                self._settle(last, back, root, solo, live, emit)
                move = col - 2 * self.lookahead
                for x in (last, back, symbol):
                    x[: col - move + 1] = x[move:].copy()
                np.maximum(back - move, 0, out=back)
                root = np.maximum(root - move, 0)
                shift, col = shift + move, col - move
            col += 1
            symbol[col, :live] = symbols[begin[:live] + t]
            self._step(last, back, symbol, col, live, shift)
        found = [(lane[ok], end[ok], ids[ok]) for lane, end, ids in found for ok in [~solo[lane]]] if solo.any() else found
        for k in np.nonzero(solo)[0].tolist():
            ids = np.fromiter(self.stream(symbols[begin[k] : begin[k] + size[k]].tolist()), np.uint32)
            found.append((np.full(len(ids), k), np.arange(len(ids)), ids))
        return [(word[lane], end, ids) for lane, end, ids in found]

    def _step(self, last: np.ndarray, back: np.ndarray, symbol: np.ndarray, col: int, live: int, shift: int) -> None:
        """Find the last token of the prefixes that end at col, shortest candidates first."""
        lane, node = np.arange(live), np.zeros(live, np.int64)
        for n in range(1, min(self.lookahead, col) + 1):
            node = self.trie.get(node * self.symbols + symbol[col - n + 1, lane])
            go = node >= 0
            if not go.all():
                lane, node = lane[go], node[go]
            if not len(lane):
                return
            t = self.token_at[node]
            some = np.nonzero(t >= 0)[0]
            t, which = t[some], lane[some]
            before = last[col - n, which]
            good = before < 0 if shift + col == n else np.zeros(len(some), bool)
            check = np.nonzero(~good & (before >= 0))[0]
            good[check] = self.fit(before[check], t[check])
            hit = which[good]
            last[col, hit], back[col, hit] = t[good], col - n
            stay = np.ones(len(lane), bool)
            stay[some[good]] = False
            lane, node = lane[stay], node[stay].astype(np.int64)

    def _settle(self, last, back, root, solo, live: int, emit) -> None:
        """Emit what all live prefixes share; lanes where that lies too far back go on alone."""
        col = len(last) - 1
        mark = np.zeros((col + 1, live), bool)
        mark[col - self.lookahead + 1 :] = True
        count = np.full(live, self.lookahead)
        for c in range(col, 0, -1):
            on = np.nonzero(mark[c] & (count > 1))[0]
            mark[c, on] = False
            to = back[c, on]
            count[on] -= mark[to, on]
            mark[to, on] = True
        end = mark.argmax(0)
        solo[:live] |= end < col - 2 * self.lookahead
        emit(np.arange(live), end)
        root[:live] = end


class Decoder:
    """Bytes to text as they come: what doesn't end a character yet is held back.

    pieces has the bytes of each id, and between goes between two ids. Constant memory.
    """

    def __init__(self, pieces: dict[int, bytes], between: bytes = b""):
        self.pieces, self.between = pieces, between
        self.held, self.begun = b"", False

    def feed(self, ids: Iterable[int]) -> str:
        made = self.between.join(map(self.pieces.__getitem__, ids))
        if not made:
            return ""
        data = self.held + (self.between + made if self.begun else made)
        self.begun = True
        good = len(data)
        for k in range(1, min(4, good) + 1):
            lead = data[-k]
            if lead & 0xC0 != 0x80:  # the byte that begins the last character
                need = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                good -= k if need > k else 0
                break
        self.held = data[good:]
        return data[:good].decode("utf-8", "replace")

    def close(self) -> str:
        held, self.held, self.begun = self.held, b"", False
        return held.decode("utf-8", "replace")


class Codec:
    """Reads a tokenizer file; encodes and decodes whole texts, any number of them at once.

    Characters from U+0300 on take their lower case, composition and class from the tables of the
    tokenizers library, as Python's may be of another version of Unicode; below it they agree.
    """

    #: White space of the vocabulary's pattern that str.split() would see otherwise.
    ODD = re.compile("[\x1c-\x1f]")
    SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
    PLAIN = re.compile("[\x00-\u02ff]*")

    def __init__(self, path: str, most_words: int = 300_000, most_chunks: int = 300_000, slice_chars: int = 2_000_000):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.transducer = Transducer(model["vocab"], merges)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.token_of = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.special.items()}
        names = "|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True))
        self.cut_special = re.compile(f"({names})") if names else None
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(pattern + "|\n")
        library = tokenizers.Tokenizer.from_file(path)
        self.normalizer, self.cutter = library.normalizer, library.pre_tokenizer
        self.letters = byte_letters()
        self.byte_of = {c: b for b, c in enumerate(self.letters)}
        born = self.transducer.born
        self.mid = np.array([born[c] for c in self.letters])
        self.end = np.array([born[c + self.suffix] for c in self.letters])
        self.spelled = {i: t.encode() for i, t in self.token_of.items()}
        #: Words that are never encoded: special tokens, and the line end that parts chunks.
        self.fixed = {t: struct.pack("<I", i) for t, i in self.special.items()} | {"\n": b""}
        self.most_words, self.most_chunks, self.slice_chars = most_words, most_chunks, slice_chars
        self.forget()

    def forget(self) -> None:
        """Drop what was kept of finished words and chunks; the vocabulary stays."""
        self.done_words, self.done = dict(self.fixed), {}
        self.transducer.alone.clear()

    def symbols(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all words one after the other, and each word's number of them; no word is empty."""
        data = [w.encode() for w in words]
        size = np.fromiter(map(len, data), np.int64, len(data))
        flat = np.frombuffer(b"".join(data), np.uint8)
        out, last = self.mid[flat], np.cumsum(size) - 1
        out[last] = self.end[flat[last]]
        return out, size

    def slices(self, text: str) -> Iterator[str]:
        """Parts of bounded length, cut at white space; only a longer chunk makes a longer part."""
        at = 0
        while len(text) - at > self.slice_chars:
            cut = self.SPACE.search(text, at + self.slice_chars)
            if cut is None:
                break
            yield text[at : cut.start()]
            at = cut.end()
        yield text[at:]

    def chunks(self, text: str) -> list[str]:
        return [c for c in self.SPACE.split(text) if c] if self.ODD.search(text) else text.split()

    def pieces(self, chunks: list[str]) -> tuple[list[str], list[str]]:
        """The chunks in another order, and their normalised words, with a line end after each chunk."""
        plain, other, words = [], [], []
        for c in chunks:
            (plain if c.isascii() or self.PLAIN.fullmatch(c) else other).append(c)
        if self.cut_special and "<|" in (text := "\n".join(plain)) and self.cut_special.search(text):
            other += [c for c in plain if self.cut_special.search(c)]
            plain = [c for c in plain if not self.cut_special.search(c)]
        if plain:
            words = self.words.findall("\n".join(plain).lower())
            words.append("\n")
        for c in other:
            for part in self.cut_special.split(c) if self.cut_special else [c]:
                if part in self.special:
                    words.append(part)
                elif part:
                    cut = self.cutter.pre_tokenize_str(self.normalizer.normalize_str(part))
                    words += [bytes(map(self.byte_of.__getitem__, p)).decode() for p, _ in cut]
            words.append("\n")
        return plain + other, words

    def learn(self, chunks: list[str]) -> None:
        """Encode chunks that are not known yet, all their words side by side."""
        chunks, words = self.pieces(chunks)
        known = self.done_words
        fresh = list(set(words).difference(known))
        if fresh:
            ids, size = self.transducer.lanes(*self.symbols(fresh))
            raw, end = ids.astype("<u4").tobytes(), (4 * np.cumsum(size)).tolist()
            known.update(zip(fresh, [raw[a:b] for a, b in zip([0, *end], end)]))
        made = list(map(known.__getitem__, words))
        raw, end = b"".join(made), np.cumsum(np.fromiter(map(len, made), np.int64, len(made)))
        end = end[[w == "\n" for w in words]].tolist()
        self.done.update(zip(chunks, [raw[a:b] for a, b in zip([0, *end], end)]))

    def _make_room(self) -> None:
        if len(self.done_words) > self.most_words:
            self.done_words = self.fixed | dict(islice(self.done_words.items(), len(self.done_words) - self.most_words // 2, None))
        if len(self.done) > self.most_chunks:
            self.done = dict(islice(self.done.items(), len(self.done) - self.most_chunks // 2, None))

    def encode_all(self, texts: list[str]) -> Iterator[tuple[int, bytes]]:
        """(place of the text, ids as little-endian unsigned 32-bit integers), text by text and part by part."""
        held: list[tuple[int, list[str]]] = []
        size = 0
        for k, text in enumerate(texts):
            for part in self.slices(text):
                held.append((k, self.chunks(part)))
                size += len(part)
                if size >= self.slice_chars:
                    yield from self._encode(held)
                    held, size = [], 0
        yield from self._encode(held)

    def _encode(self, held: list[tuple[int, list[str]]]) -> Iterator[tuple[int, bytes]]:
        fresh = set().union(*[c for _, c in held]).difference(self.done)
        if fresh:
            self.learn(list(fresh))
        for k, chunks in held:
            yield k, b"".join(map(self.done.__getitem__, chunks))
        self._make_room()

    def encode(self, text: str | None) -> list[int]:
        data = b"".join([ids for _, ids in self.encode_all([text or ""])])
        return np.frombuffer(data, "<u4").tolist()

    def decoder(self, readable: bool = False) -> Decoder:
        """The state machine from ids to text.

        The vocabulary names no decoder, so that plain decoding spells tokens with spaces between;
        with readable, bytes that tokens stand for come out, and a space for each end of a word.
        """
        if not readable:
            return Decoder(self.spelled, b" ")
        body = lambda t: bytes(self.byte_of[c] for c in t.removesuffix(self.suffix) if c in self.byte_of)
        plain = {i: t.encode() if t in self.special else body(t) + b" " * (bool(self.suffix) and t.endswith(self.suffix)) for i, t in self.token_of.items()}
        return Decoder(plain)

    def decode(self, ids: Iterable[int]) -> str:
        """The whole text of ids; those that name no token are left out."""
        machine = self.decoder()
        return machine.feed([i for i in ids if i in self.spelled]) + machine.close()


_CODECS: dict[tuple, Codec] = {}
#: Bounds of a codec's tables and slices where memory is shared with other operators.
SMALL = (150_000, 100_000, 500_000)


def codec(path: str, bounds: tuple[int, ...] = ()) -> Codec:
    """One per worker process and bounds: most words, most chunks, characters of a slice."""
    if (path, bounds) not in _CODECS:
        _CODECS[path, bounds] = Codec(path, *bounds)
    return _CODECS[path, bounds]


def encode_frame(docs: DataFrame, path: str, text: str = "text", with_ids: bool = False, keep_text: bool = True, warm: bool = False) -> DataFrame:
    """docs with n_tokens, ids_sha256 and decoded_sha256, and token_ids if asked for.

    token_ids holds the ids as little-endian unsigned 32-bit integers. With warm, a worker keeps the
    vocabulary and its tables of finished words, both of bounded size, for its next task; without it
    they are smaller and a task gives them back, as workers live on in other operators.

    Defined cases: a null text counts as empty, an empty text has no tokens and the digests of
    nothing; a very long text is encoded and decoded part by part; repeated rows give repeated
    results; columns of these names are replaced.
    """

    bounds = () if warm else SMALL

    def run(pdf):
        c = codec(path, bounds)
        texts = [t if isinstance(t, str) else "" for t in pdf[text]]
        n, digests, plain = [0] * len(texts), [hashlib.sha256() for _ in texts], [hashlib.sha256() for _ in texts]
        every: list[list[bytes]] = [[] for _ in texts]
        machine, was = c.decoder(), 0
        for k, ids in c.encode_all(texts):
            if k != was:
                plain[was].update(machine.close().encode())
                was = k
            n[k] += len(ids) // 4
            digests[k].update(ids)
            plain[k].update(machine.feed(struct.unpack(f"<{len(ids) // 4}I", ids)).encode())
            if with_ids:
                every[k].append(ids)
        if texts:
            plain[was].update(machine.close().encode())
        out = {"n_tokens": n, "ids_sha256": [d.hexdigest() for d in digests], "decoded_sha256": [d.hexdigest() for d in plain]}
        return out | ({"token_ids": [b"".join(e) for e in every]} if with_ids else {})

    extra = "n_tokens long, ids_sha256 string, decoded_sha256 string" + (", token_ids binary" if with_ids else "")
    return widen(docs, run, extra, None if warm else lambda: _CODECS.pop((path, bounds), None), () if keep_text else (text,))
