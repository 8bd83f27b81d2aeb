"""Language, toxicity, quality, HTML, vectors and the pipeline."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siltgauge.llm import common, html, langid, quality, queries, toxicity, vectors

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, name, sf="sf0.01"):
    return spark.read.parquet(f"/root/testdata/{sf}/{name}.parquet")


def test_language_on_held_out_rows_and_odd_ones(spark):
    docs = table(spark, "documents")
    model = langid.fit(docs)
    got = langid.label(docs.where(langid.held_out(F.col("doc_id")) & F.col("lang").isNotNull()), model).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.97 * len(got)
    odd = spark.createDataFrame([(1, None, None, None, 0), (2, "", None, None, 0), (3, "123 !!", None, None, 0), (4, "the and with for", "x", None, 0), (4, "the and with for", "x", None, 0)], DOCS)
    rows = langid.label(odd, model, spans=True).collect()
    assert [r["lang_pred"] for r in rows if r["doc_id"] <= 3] == ["und"] * 3 and all(0 <= r["score"] <= 1 for r in rows) and len(rows) == 5
    assert langid.identify(odd.limit(0)).count() == 0


def test_viterbi_matches_every_path():
    rng = np.random.default_rng(3)
    for _ in range(40):
        s = rng.normal(size=(5, 3))
        got = langid.viterbi([s], 1.0)[0]
        paths = np.stack(np.meshgrid(*[range(3)] * 5, indexing="ij"), -1).reshape(-1, 5)
        value = s[np.arange(5), paths].sum(1) - (paths[:, 1:] != paths[:, :-1]).sum(1)
        assert value.max() == pytest.approx(s[np.arange(5), got].sum() - (got[1:] != got[:-1]).sum(), abs=1e-5)


def test_toxicity(spark):
    docs, labels = table(spark, "documents"), table(spark, "labels")
    lexicon = toxicity.fit(docs, labels)
    held = docs.join(labels, "doc_id").where(langid.held_out(F.col("doc_id")))
    rows = toxicity.rate(held, lexicon).where("toxic IS NOT NULL").collect()
    assert sum(r["predicted"] == r["toxic"] for r in rows) >= 0.9 * len(rows)
    odd = spark.createDataFrame([(1, None, None, None, 0), (2, "", None, None, 0)], DOCS)
    assert {(r["predicted"], 0 < r["score"] < 0.5) for r in toxicity.rate(odd, lexicon).collect()} == {(0, True)}
    assert toxicity.fit(docs.limit(0), labels.limit(0)).weights == {}
    assert toxicity.fold("Ｂ4Dѕ") == "bads"


def test_exception_phrases_cancel():
    lex = toxicity.Lexicon({"vile": 3.0}, ["not vile"], (-2.0, 2.0, 0.0))
    assert lex.score("so vile") > 0.5 > lex.score("not vile") and lex.score("V1LE") > 0.5 > lex.score("servile")


def test_quality(spark):
    docs, labels = table(spark, "documents"), table(spark, "labels")
    model = quality.fit(docs, labels)
    rows = quality.rate(docs, model).join(labels, "doc_id").where("held_out AND quality IS NOT NULL").collect()
    assert sum(r["predicted"] == r["quality"] for r in rows) >= 0.9 * len(rows) and sum(map(sum, model.taught)) > 0
    assert {r["score"] for r in quality.rate(docs, quality.fit(docs, labels.limit(0))).collect()} == {0.5}


PAGE = """<html><head><title>T</title><script>var x='</p>';</script></head><body><nav><a href=/>Home</a></nav><div class="ad">Buy this now please</div>
<article><h1>A &amp; B</h1><p>First   paragraph of the <a href="/x">article</a> text,
with lines.</p><p>Second one has more words than the first one had, I think.</p><div class="comments"><p>Reader says hello there</p></div></article><footer>&copy; us</footer></body></html>"""


def test_html(spark):
    want = "A & B\n\nFirst paragraph of the article text, with lines.\n\nSecond one has more words than the first one had, I think."
    assert html.main_text(PAGE) == want
    df = spark.createDataFrame([(1, "u", PAGE), (2, "u", None), (3, None, ""), (4, "u", "<p"), (5, "u", "<script>never ends")], "page_id long, url string, html string")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html.extract(df).collect()}
    assert got[1] == (want, len(want)) and got[2] == got[3] == got[5] == ("", 0)
    assert html.extract(df.limit(0)).count() == 0


def clustered(n, d, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(9, d))
    return [(centres[k % 9] + rng.normal(size=d) * rng.choice([0.05, 0.3, 1.0])).tolist() for k in range(n)]


@pytest.mark.parametrize("shard", [40, 4096])
def test_vector_links_match_brute_force(spark, shard):
    vecs = clustered(160, 8, 2)
    rows = [(k, v, k % 3) for k, v in enumerate(vecs)] + [(200, vecs[3], 0), (201, vecs[3], 0), (202, None, 0), (203, [0.0] * 8, 0), (204, [float("nan")] * 8, 0), (205, vecs[3], None), (206, [None] * 8, 1), (207, vecs[3][:4], 0)]
    good = {k: (np.array(v), lab) for k, v, lab in rows if v and lab is not None and None not in v and np.isfinite(v).all() and any(v)}
    near = {k: {j for j, (w, m) in good.items() if j != k and m == lab and len(w) == len(v) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.93} for k, (v, lab) in good.items()}
    want = set()
    for k, *_ in rows:
        seen, todo = {k}, [k]
        while todo:
            for j in near.get(todo.pop(), ()):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        want.add((k, len(near.get(k, ())), min(seen), min(seen) == k))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert set(map(tuple, vectors.near_vectors(df, shard_rows=shard).collect())) == want
    assert vectors.near_vectors(df.limit(0)).count() == 0


def test_top_k_matches_brute_force(spark):
    vecs = clustered(130, 7, 4)
    rows = [(k, v) for k, v in enumerate(vecs)] + [(200, vecs[0]), (201, vecs[0]), (202, None), (220, [float("inf")] * 7), (None, vecs[1]), (221, [0.0] * 7)]
    good = {k: np.floor(64 * np.array(v)).astype(int) for k, v in rows if k is not None and v and np.isfinite(v).all()}
    want = set()
    for q in good:
        if q % 20 == 0:
            best = sorted(((-int(good[q] @ v), k) for k, v in good.items() if k != q))[:20]
            want |= {(q, n, k, -s) for n, (s, k) in enumerate(best, 1)}
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert set(map(tuple, vectors.top_k(df, shard_rows=37, group_rows=3).collect())) == want
    assert vectors.top_k(df.limit(0)).count() == 0


def test_search_block_with_wide_integers():
    rng = np.random.default_rng(1)
    rows = rng.integers(-(2**28), 2**28, (40, 5))
    ids, row = np.arange(40)[::-1].copy(), np.arange(40)
    q = rows[:5]
    for bound in (np.full(5, -np.inf), np.array([float(np.sort(np.delete(rows @ x, k))[-7]) for k, x in enumerate(q)])):
        for i, j, score in vectors.search_block(q, row[:5], bound, rows, row, ids, 7, 4, 2):
            for k in set(i.tolist()):
                best = sorted((-int(q[k] @ v), int(w)) for x, (v, w) in enumerate(zip(rows, ids)) if x != k)[:7]
                assert [(-s, w) for s, w in best] == list(zip(score[i == k].tolist(), ids[j[i == k]].tolist()))


def test_pairs_leave_the_search_before_its_end():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(60, 64))
    rows = np.floor(64 * (centres[rng.integers(0, 60, 4000)] + 0.2 * rng.normal(size=(4000, 64)))).astype(np.int64)
    q, row = rows[:100], np.arange(4000)
    shares: list = []
    got = [(row[:100][i], j, s) for i, j, s in vectors.search_block(q, row[:100], np.full(100, -np.inf), rows, row, row, 20, shares=shares)]
    assert sum(len(x[0]) for x in got) == 2000
    for k in range(0, 100, 9):
        best = sorted((-int(q[k] @ v), x) for x, v in enumerate(rows) if x != k)[:20]
        mine = [(-int(s), int(j)) for i, js, ss in got for w, j, s in zip(i, js, ss) if w == k]
        assert mine == best
    assert min(s for e, s in shares if e <= 48) < 0.5 and min(s for _, s in shares) < 0.06


def test_rows_that_repeat_an_id_are_rows_of_their_own(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows = [(int(k), rng.normal(size=3).tolist(), int(k) % 2) for k in [20, 40, 40, 3, 5, 5, 60, 60, 7]]
    rows += [(80, rows[1][1], 0), (81, [v * 1.001 for v in rows[1][1]], 0), (40, [v * 1.002 for v in rows[2][1]], 0), (90, None, 0), (91, [0.0, 0.0, 0.0], 0), (92, rows[0][1], None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    df.coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    for name in ("op10_top_k", "op4_cover_tree"):
        got = sorted(map(repr, (tuple(r) for r in queries.QUERIES[name](spark, str(tmp_path)).collect())))
        want = sorted(map(repr, con.execute(queries.ORACLES[name]).fetchall()))
        assert got == want and len(got) >= len(rows) - 1, name

def test_components(spark):
    rng = random.Random(4)
    edges = [(k, k + 1) for k in range(60)] + [(100 + rng.randrange(40), 100 + rng.randrange(40)) for _ in range(25)] + [(300, k) for k in range(301, 360)]
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    want = {x: root(x) for x in up if any(x in e and e[0] != e[1] for e in edges)}
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want


def test_pipeline_stage_by_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "near_duplicates", "long_repeats", "mixture", "tokens"]
    n = docs.count()
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = common.durable(stage(spark, docs, SF))
        if k < 4:
            assert set(docs.columns) == set(corpus_pipeline.COLUMNS)
        assert k == 3 or docs.count() <= n
        n = docs.count()
    assert n > 100 and docs.where("n_tokens IS NULL").count() == 0


def test_pipeline_stages_take_odd_rows(spark):
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "a", 0), (None, "the and with for", "en", None, 5), (4, "same row", None, "b", 8), (4, "same row", None, "b", 8)], DOCS)
    for df in (odd, odd.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, df, SF).collect()
