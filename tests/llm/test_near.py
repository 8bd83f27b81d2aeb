"""The pipeline's near duplicates against brute force: five-word shingles, Jaccard 0.8."""

import random

import numpy as np

import corpus_pipeline
from siltgauge.llm import near

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def survivors(rows):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    low = {}
    for k, (d, _) in enumerate(rows):
        low[root(k)] = min(d, low.get(root(k), d))
    return sorted(low.values())


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", "a", len(t or "")) for d, t in rows], DOCS)


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(11)
    vocabulary = [f"w{k}" for k in range(500)]
    passage = [rng.choice(vocabulary) for _ in range(40)]
    rows = []
    for k in range(30):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(3, 200))] + passage * (k % 3 == 0)
        for c in range(rng.randrange(1, 8)):
            words = list(base)
            for _ in range(rng.randrange(4) if c else 0):  # a changed word costs up to five shingles of each side
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(words)))
    one = [rng.choice(vocabulary) for _ in range(150)]
    for k in range(40):  # a large group whose members are near only to some others
        words = list(one)
        for _ in range(3):
            words[rng.randrange(150)] = f"x{k}"
        rows.append((len(rows), " ".join(words)))
    rows += [(1000, None), (1001, ""), (1002, " \t"), (1003, rows[0][1].upper()), (1003, rows[0][1])]
    want = survivors(rows)
    assert len(want) < len(rows) - 50
    got = sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, frame(spark, rows), "").collect())
    assert got == want


def test_a_pair_at_the_limit_goes_and_one_below_it_stays(spark):
    # of 90 shingles each, 80 shared are 80/100 and 79 shared are 79/101
    words = {c: [f"{c}{k}" for k in range(94)] for c in "vuxy"}
    rows = [(1, " ".join(words["v"])), (2, " ".join(words["v"][:84] + words["x"][:10]))]
    rows += [(3, " ".join(words["u"])), (4, " ".join(words["u"][:83] + words["y"][:11]))]
    want = survivors(rows)
    assert want == [1, 3, 4]
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, frame(spark, rows), "").collect()) == want


def test_similar_sets_share_a_key_in_any_order():
    rng = np.random.default_rng(5)
    for _ in range(200):
        n = int(rng.integers(1, 80))
        a = np.unique(rng.integers(0, 1 << 62, n))
        gone = int(rng.integers(0, len(a) // 9 + 1))
        b = np.unique(np.concatenate((rng.permutation(a)[gone:], rng.integers(0, 1 << 62, gone))))
        assert 5 * len(np.intersect1d(a, b)) >= 4 * len(np.union1d(a, b))
        common = np.sort(rng.permutation(np.union1d(a, b))[: n // 2])
        assert len(np.intersect1d(near.keys_of(a, common), near.keys_of(b, common)))


def test_sketches_never_rule_out_a_similar_pair():
    rng = np.random.default_rng(4)
    for n in (1, 3, 20, 63, 64, 65, 500, 1023, 1025, 5000):
        base = np.unique(rng.integers(-(2**63), 2**63 - 1, n))
        for k in range(30):
            drop = rng.random(len(base)) < rng.random() * 0.3
            other = np.unique(np.concatenate([base[~drop], rng.integers(-(2**63), 2**63 - 1, int(drop.sum() * rng.random()))]))
            if not len(other):
                continue
            shared = len(np.intersect1d(base, other))
            if 9 * shared >= 4 * (len(base) + len(other)):
                assert near.may_share(near.sketch_of(base), near.sketch_of(other), len(base), len(other))
    far = [np.unique(rng.integers(-(2**63), 2**63 - 1, 400)) for _ in range(20)]
    assert not any(near.may_share(near.sketch_of(a), near.sketch_of(b), len(a), len(b)) for a in far for b in far if a is not b)
    same = np.arange(1000)  # all in one bucket, more than a byte counts
    assert near.may_share(near.sketch_of(same), near.sketch_of(same), 1000, 1000)


def test_blocks_and_pairs_find_the_same_groups(spark, monkeypatch):
    rng = random.Random(21)
    base = [f"w{k}" for k in range(60)]
    texts = []
    for _ in range(70):  # copies around the similarity asked for, so that many of one key are unconnected
        words = list(base)
        for _ in range(rng.randrange(1, 4)):
            words[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = []
    for pairs, block in ((32, 512), (0, 9)):
        monkeypatch.setattr(near, "PAIRS", pairs)
        monkeypatch.setattr(near, "BLOCK", block)
        kept.append(sorted(r["doc_id"] for r in near.keep_one(docs).collect()))
    sets = [set(near.shingle_hashes(t).tolist()) for t in texts]
    up = list(range(70))
    for i in range(70):
        for j in range(i):
            if 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j])):
                a, b = up[i], up[j]
                up = [min(a, b) if x in (a, b) else x for x in up]
    assert kept[0] == kept[1] == sorted(set(up)) and 2 < len(kept[0]) < 69
