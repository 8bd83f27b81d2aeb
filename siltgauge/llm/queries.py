"""Driver queries of this subpackage: one per operator, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, html, langid, mixing, quality, simhash, suffix, toxicity, vectors
from .common import read


def tokenizer_path() -> str:
    """The vocabulary file that the queries use; operators take it as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode_frame(docs, tokenizer_path(), keep_text=False, warm=True).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality.rate(docs, quality.fit(docs, read(spark, sf_dir, "labels")))


def op4_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(read(spark, sf_dir, "embeddings"))


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html.extract(pages).select("page_id", "url", "text", "n_chars")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.cut_repeats(read(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    held = docs.withColumn("held_out", langid.held_out(docs["doc_id"]))
    return toxicity.rate(held, lexicon, keep_text=False).select("doc_id", "held_out", "score", "predicted")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read(spark, sf_dir, "documents"))


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.top_k(read(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_bpe": op2_bpe,
    "op3_quality": op3_quality,
    "op4_cover_tree": op4_cover_tree,
    "op5_html_extract": op5_html_extract,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_toxicity": op7_toxicity,
    "op8_simhash": op8_simhash,
    "op9_language": op9_language,
    "op10_top_k": op10_top_k,
}

ORACLES: dict[str, str] = {
    "op1_mix_sources": r"""
        WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                          CAST('0x' || substr(md5(concat_ws('|', '17', CAST(doc_id AS VARCHAR), text)), 1, 15) AS BIGINT) AS key FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
        w AS (SELECT source, source_size, CAST(3 * source_size AS DOUBLE) AS cap, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS w, CAST(sum(source_size) OVER () AS DOUBLE) AS total FROM s),
        o AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
                     sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_w FROM w),
        f AS (SELECT *, cap <= (total - used) / open_w * w AS filled FROM o),
        t AS (SELECT source, source_size, CASE WHEN filled THEN cap ELSE (total - sum(CASE WHEN filled THEN cap ELSE 0 END) OVER ()) * w / sum(CASE WHEN filled THEN 0 ELSE w END) OVER () END AS target FROM f),
        b AS (SELECT *, CAST(round(target) AS BIGINT) AS budget FROM t),
        r AS (SELECT d.doc_id, d.size, b.source_size, b.target, b.budget, sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size AS before
              FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
        SELECT doc_id, size, source_size, target, CAST(CASE WHEN source_size = 0 THEN 0 ELSE budget // source_size * size + least(greatest(budget % source_size - before, 0), size) END AS BIGINT) AS taken FROM r
    """,
    "op4_cover_tree": """
        WITH RECURSIVE e AS (SELECT row_number() OVER () AS r, vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
        v AS (SELECT * FROM e WHERE label IS NOT NULL AND x IS NOT NULL AND len(list_filter(x, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND len(list_filter(x, lambda y: y <> 0)) > 0),
        p AS (SELECT a.r AS a, b.r AS b FROM v a JOIN v b ON a.label = b.label AND a.r <> b.r AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= 0.93),
        reach AS (SELECT r AS a, r AS b FROM v UNION SELECT reach.a, p.b FROM reach JOIN p ON reach.b = p.a),
        low AS (SELECT reach.a AS r, min(v.vec_id) AS low FROM reach JOIN v ON v.r = reach.b GROUP BY reach.a),
        n AS (SELECT a AS r, count(*) AS n_links FROM p GROUP BY a)
        SELECT e.vec_id, CAST(coalesce(n.n_links, 0) AS BIGINT) AS n_links, coalesce(low.low, e.vec_id) AS component_id, e.vec_id = coalesce(low.low, e.vec_id) AS kept
        FROM e LEFT JOIN low USING (r) LEFT JOIN n USING (r)
    """,
    "op6_suffix_dedup": """
        WITH h AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
        c AS (SELECT r, unnest(range(0, greatest(len(x) // 2 - 199, 0), 4096)) AS pos, x FROM h),
        c2 AS (SELECT r, pos, substr(x, 2 * pos + 1, 2 * (4096 + 199)) AS part FROM c),
        w AS (SELECT r, pos + k AS b, hash(substr(part, 2 * k + 1, 400)) AS g, md5(substr(part, 2 * k + 1, 400)) AS m FROM (SELECT r, pos, part, unnest(range(0, len(part) // 2 - 199)) AS k FROM c2)),
        twice AS (SELECT g, m FROM w GROUP BY g, m HAVING count(*) > 1),
        hit AS (SELECT w.r, w.b FROM w SEMI JOIN twice ON w.g = twice.g AND w.m = twice.m),
        island AS (SELECT r, b, sum(fresh) OVER (PARTITION BY r ORDER BY b) AS i FROM (SELECT r, b, CASE WHEN b <= lag(b) OVER (PARTITION BY r ORDER BY b) + 200 THEN 0 ELSE 1 END AS fresh FROM hit)),
        span AS (SELECT r, i, min(b) AS b, max(b) + 200 AS e FROM island GROUP BY r, i),
        gap AS (SELECT r, b AS until, coalesce(lag(e) OVER (PARTITION BY r ORDER BY b), 0) AS since, e FROM span),
        sums AS (SELECT r, count(*) AS n_spans, sum(e - until) AS n_removed, max(e) AS tail FROM gap GROUP BY r),
        kept AS (SELECT gap.r, string_agg(substr(x, 2 * since + 1, 2 * (until - since)), '' ORDER BY until) AS x FROM gap JOIN h USING (r) GROUP BY gap.r)
        SELECT h.doc_id, CAST(len(h.x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
               sha256(unhex(CASE WHEN sums.r IS NULL THEN h.x ELSE coalesce(kept.x, '') || substr(h.x, 2 * tail + 1) END)) AS kept_sha256
        FROM h LEFT JOIN sums USING (r) LEFT JOIN kept USING (r)
    """,
    "op10_top_k": """
        WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
                   WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
              FROM v q JOIN v c ON q.r <> c.r AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0),
        n AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
        SELECT query_id, rank, vec_id, score FROM n WHERE rank <= 20
    """,
}
