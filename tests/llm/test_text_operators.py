"""Mixing, BPE, long repeats, SimHash: against brute force, the reference library, and odd inputs."""

import hashlib
import random
import struct
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tokenizers
import xxhash

from pyspark.sql import functions as F

from siltgauge.llm import bpe, mixing, simhash, suffix

PATH = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "  \n\t ", "en", "a", 5), (None, "no id", None, "b", 5), (4, "same row here", "en", "b", 13), (4, "same row here", "en", "b", 13), (5, "x" * 30000, None, None, 30000)]


def empty(spark):
    return spark.createDataFrame([], DOCS)


# --- mixing


def test_mix_meets_every_target(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * rng.randrange(40)), None, rng.choice(["a", "b", "b", "b", "c", None]), 0) for i in range(600)]
    got = mixing.mix(spark.createDataFrame(rows, DOCS), range_rows=50).collect()
    sizes, taken, target = Counter(), Counter(), {}
    for r in got:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert r["taken"] <= 3 * r["size"]
    assert len(got) == 600
    for s, t in target.items():
        assert t <= 3 * sizes[s] and abs(taken[s] - t) <= 1
    assert abs(sum(target.values()) - sum(sizes.values())) < 1e-6


def test_mix_reshares_what_a_small_source_cannot_take(spark):
    rows = [(1, "w " * 10, None, "a", 0), (2, "w " * 1000, None, "b", 0), (3, "w " * 500, None, "c", 0)]
    t = {r["source"]: r["target"] for r in mixing.mix(spark.createDataFrame(rows, DOCS)).collect()}
    assert t["a"] == 30.0 and t["b"] == pytest.approx(1480 * 2 / 5) and t["c"] == pytest.approx(1480 * 3 / 5)


def test_mix_is_repeatable_and_takes_odd_rows(spark):
    df = spark.createDataFrame(ODD, DOCS)
    one, two = (sorted(map(str, mixing.mix(df.repartition(n)).collect())) for n in (1, 5))
    assert one == two and len(one) == len(ODD)
    assert mixing.mix(empty(spark)).count() == 0
    assert mixing.mix(df.withColumn("before", df["doc_id"]).withColumn("key", df["doc_id"]).withColumn("range", df["doc_id"])).count() == len(ODD)


def test_mixed_rows_have_the_words_that_were_taken(spark):
    df = spark.createDataFrame([(i, " ".join(f"w{i}_{k}" for k in range(i % 7)), "en", "ab"[i % 2], 0) for i in range(90)], DOCS)
    want = {r["doc_id"]: r["taken"] for r in mixing.mix(df).collect() if r["taken"]}
    got = Counter()
    for r in mixing.mixed_rows(df).collect():
        got[r["doc_id"]] += len(r["text"].split())
        assert r["n_chars"] == len(r["text"])
    assert dict(got) == want
    assert mixing.mixed_rows(empty(spark)).columns == empty(spark).columns


# --- BPE

TEXTS = [
    "", " ", "Hello, world! It's 12345 o'clock.", "ÀÉÎ straße ŒUVRE é İstanbul", "<|startoftext|>hi<|endoftext|> there", "日本語のテキスト 😀👩‍👩‍👧 ٣٤", "a" * 5000, "ab" * 3000, "\x1c\x1d odd space line", "don't WE'LL they'Re",
    "� ​ zero​width", "x'y''z 1st 2nd ½ ²", "!!!???...----", "naïve café NAÏVE", "İı ſ K", "tab\tnew\nline\r\n",
]


def reference():
    t = tokenizers.Tokenizer.from_file(PATH)
    t.no_padding()
    t.no_truncation()
    return t


def test_bpe_matches_the_library():
    ref, own = reference(), bpe.codec(PATH)
    rng = random.Random(11)
    pool = "abcdefgh ijklmnopqrstuvwxyz'.,éßñ0123456789-<|>İ́日"
    for text in TEXTS + ["".join(rng.choice(pool) for _ in range(rng.randrange(200))) for _ in range(400)]:
        ids = ref.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids, text[:80]
        assert own.decode(ids) == ref.decode(ids, skip_special_tokens=False)


def test_every_code_point_encodes_as_in_the_library():
    ref, own = reference(), bpe.codec(PATH)
    every = [chr(k) for k in range(0x30000) if not 0xD800 <= k < 0xE000]
    for at in range(0, len(every), 1500):
        part = every[at : at + 1500]
        for text in (" ".join(part), " ".join(f"a{c}B" for c in part)):
            assert own.encode(text) == ref.encode(text, add_special_tokens=False).ids, hex(at)
    rng = random.Random(2)
    marks = [chr(k) for k in (*range(0x300, 0x370), *range(0x591, 0x5C8), *range(0x10F46, 0x10F51), 0x3099, 0x1D165)]
    for _ in range(300):
        text = "".join(rng.choice("aeoUΣσςİ ガカ한ᄒ") + "".join(rng.choices(marks, k=rng.randrange(4))) for _ in range(12))
        assert own.encode(text) == ref.encode(text, add_special_tokens=False).ids, ascii(text)


def test_lanes_and_single_words_agree():
    t = bpe.codec(PATH).transducer
    rng = random.Random(5)
    pools = [range(256), range(64, 90), range(64, 67), [64]]
    words = [[rng.choice(pool) for _ in range(rng.choice((1, 3, 9, 40, 700)))] for pool in pools for _ in range(60)]
    ids, size = t.lanes(np.array([x for w in words for x in w]), np.array([len(w) for w in words]), room=3)
    ends = np.cumsum(size)
    for w, b, e in zip(words, ends - size, ends):
        assert ids[b:e].tolist() == list(t.stream(w))


def test_stream_emits_before_the_word_ends_and_holds_little():
    t = bpe.codec(PATH).transducer
    seen = 0

    def endless():
        nonlocal seen
        for k in range(100_000):
            seen += 1
            yield 64 + k * k % 26

    out = t.stream(endless())
    for n in range(1, 2000):
        next(out)
        assert seen <= 40 * n + 8 * t.lookahead


def test_tables_that_lose_their_older_half_change_nothing():
    small, big = bpe.Codec(PATH, most_words=50, most_chunks=50, slice_chars=200), bpe.codec(PATH)
    rng = random.Random(8)
    texts = [" ".join("".join(rng.choice("abcdé!") for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(120))) for _ in range(60)]
    got = [[] for _ in texts]
    for k, ids in small.encode_all(texts):
        got[k] += np.frombuffer(ids, "<u4").tolist()
    assert got == [big.encode(x) for x in texts]


def test_decoder_gives_text_as_bytes_come():
    own = bpe.codec(PATH)
    ids = own.encode("smile 😀 naïve <|endoftext|> 日本")
    for readable, want in ((True, "smile 😀 naïve <|endoftext|>日本 "), (False, reference().decode(ids, skip_special_tokens=False))):
        machine = own.decoder(readable)
        assert "".join([machine.feed([i]) for i in ids]) + machine.close() == want
        assert machine.feed(ids) + machine.close() == want


def test_encode_frame_on_odd_rows(spark):
    df = spark.createDataFrame(ODD, DOCS).withColumnRenamed("lang", "n_tokens")
    got = bpe.encode_frame(df, PATH, with_ids=True).collect()
    ref = reference()
    assert len(got) == len(ODD)
    for r in got:
        ids = ref.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and bytes(r["token_ids"]) == struct.pack(f"<{len(ids)}I", *ids)
        assert r["ids_sha256"] == hashlib.sha256(r["token_ids"]).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(ref.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encode_frame(empty(spark), PATH).count() == 0


# --- long repeats


def brute_repeats(rows, length):
    texts = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(b[i : i + length] for _, b in texts for i in range(len(b) - length + 1))
    out = []
    for d, b in texts:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((d, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(map(str, out))


@pytest.mark.parametrize("most", [512, 3])
def test_repeats_match_brute_force_even_where_anchors_are_hot(spark, most):
    rng = random.Random(5)
    make = lambda n, letters="abcd é\n": "".join(rng.choice(letters) for _ in range(n))
    common = [make(70), make(150), make(195), make(260)]
    rows = []
    for d in range(110):
        t = make(rng.randrange(0, 500), "abcdefgh ")
        for x in common:
            if rng.random() < 0.6:
                k = rng.randrange(len(t) + 1)
                t = t[:k] + x + t[k:]
        rows.append((d, t))
    rows += [(900, None), (901, ""), (902, "x" * 700), (903, rows[3][1]), (3, rows[3][1]), (None, rows[5][1]), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    keyed, spans = suffix.repeated_spans(df, 200, most)
    if most == 512:
        assert sorted(str(tuple(r)) for r in suffix.cut_repeats(df).collect()) == brute_repeats(rows, 200)
    gone = {}
    for r in keyed.join(spans, ["d", "t"]).collect():
        gone.setdefault((r["d"], r["text"]), sum(e - b for b, e in suffix.merge([(s["b"], s["e"]) for s in r["spans"]])))
    want = {str((d, n)) for d, _, n, *_ in map(eval, brute_repeats(rows, 200)) if n and d is not None}
    assert {str((d, n)) for (d, _), n in gone.items() if d != suffix.NO_ID} == want


def test_repeats_on_empty_tables_and_kept_text(spark):
    assert suffix.cut_repeats(empty(spark)).count() == 0
    passage = "".join(chr(97 + (k * k + k // 7) % 26) for k in range(300))
    df = spark.createDataFrame([(1, f"head {passage} tail"), (2, passage), (3, "short")], "doc_id long, text string")
    assert {r["doc_id"]: r["kept"] for r in suffix.cut_repeats(df, with_text=True).collect()} == {1: "head  tail", 2: "", 3: "short"}


def test_run_index_agrees_with_counting():
    rng = random.Random(2)
    for _ in range(40):
        parts = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 40))) for _ in range(rng.randrange(1, 5))]
        index = suffix.RunIndex(parts)
        hit = index.repeated(5)
        seen = Counter(p[i : i + 5] for p in parts for i in range(len(p) - 4))
        for p, begin in zip(parts, index.begins.tolist()):
            for i in range(len(p) - 4):
                assert hit[begin + i] == (seen[p[i : i + 5]] > 1)


# --- SimHash


def slow_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate({c: " " for c in range(9, 14)}).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps, most=4):
    up = list(range(len(fps)))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= most:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return [root(k) for k in range(len(fps))]


def test_golay_keys_meet_within_two_bits():
    import numpy as np

    rng = random.Random(1)
    for _ in range(300):
        a = rng.getrandbits(21)
        b = a
        for _ in range(rng.randrange(3)):
            b ^= 1 << rng.randrange(21)
        ka, kb = (set(simhash.golay_keys(np.array([v]), 21)[0].tolist()) - {-1} for v in (a, b))
        assert ka & kb


def test_simhash_matches_brute_force(spark):
    rng = random.Random(7)
    vocabulary = [f"w{k}" for k in range(400)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randrange(1, 120))] for _ in range(40)]
    rows = []
    for k in range(160):
        words = list(rng.choice(base))
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary).upper()
        rows.append((k, rng.choice([" ", "\n", "  "]).join(words)))
    rows += [(200, None), (201, ""), (202, " \t"), (203, rows[0][1]), (203, rows[0][1])]
    fps = [slow_fingerprint(t) for _, t in rows]
    low = {}
    comp = components(fps)
    for (d, _), c in zip(rows, comp):
        low[c] = min(d, low.get(c, d))
    want = sorted((d, f"{f:016x}", low[c]) for (d, _), f, c in zip(rows, fps, comp))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, simhash.near_duplicates(df).collect())) == want
    kept = sorted(r["doc_id"] for r in simhash.keep_one(df).collect())
    assert kept == sorted(set(low.values()))
    assert simhash.near_duplicates(empty(spark)).count() == 0 and simhash.keep_one(empty(spark)).count() == 0


def test_forest_connects_dense_fingerprints():
    import numpy as np

    rng = random.Random(9)
    base = rng.getrandbits(64)
    fps = sorted({base ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(5))) & (1 << 64) - 1 for _ in range(150)})
    edges = simhash.forest(np.array(fps, np.uint64), 4)
    up = {f: f for f in fps}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        assert bin(a ^ b).count("1") <= 4
        up[root(b)] = root(a)
    groups = Counter(root(f) for f in fps)
    assert sorted(groups.values()) == sorted(Counter(components(fps)).values())


def test_long_texts_null_ids_and_clashing_columns(spark):
    rng = random.Random(12)
    make = lambda n: "".join(rng.choices("abcdefghij klmnop", k=n))
    long, passage = make(600_000), make(450)
    long = long[:300_000] + passage + long[300_000:] + long[1000:1700]  # longer than what is hashed at a time
    rows = [(1, long, "x", 1), (2, f"before {passage} after", "y", 2), (-(2**63) + 1, passage[:250] + "!", "z", 3)]
    rows += [(None, f"text number {k} " + make(220), "z", k) for k in range(3000)] + [(None, passage, "z", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, d string, t int").withColumn("spans", F.lit(1)).withColumn("__h", F.lit(2))
    got = suffix.cut_repeats(df).collect()
    by_bytes = {(r["doc_id"], r["n_bytes"], r["n_removed"]) for r in got if r["n_removed"]}
    gone = {passage[k : k + 200] for k in range(251)} | {long[1000 + k : 1200 + k] for k in range(501)}
    want = set()
    for i, text, *_ in rows[:3] + rows[-1:]:
        cover = bytearray(len(text))
        for k in range(len(text) - 199):
            if text[k : k + 200] in gone:
                cover[k : k + 200] = b"\1" * 200
        want.add((i, len(text), sum(cover)))
    assert by_bytes == want and len(got) == len(rows)
