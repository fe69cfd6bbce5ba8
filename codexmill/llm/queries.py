"""The queries of the corpus operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import digests
from .collocations import collocations
from .common import table
from .exact_dedup import exact_dedup
from .jaccard_join import jaccard_join
from .merkle import merkle
from .mixing import mix_sources
from .pii import digests as personal_data_digests
from .quality import quality
from .token_counts import token_counts, vocabulary
from .topk import exact_topk
from .toxicity import toxicity
from .url_filters import judge_urls
from .weighted_sampling import edited_fingerprints


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """The public tokenizer file's place on the driver; executors get its content."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data_digests(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents")).drop("text_hash")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), vocabulary(tokenizer_path()))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), tokenizer_path())


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).drop("text_hash")


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).drop("text_hash")


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk(table(spark, sf_dir, "embeddings"))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op12_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_toxicity": op2_toxicity,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op4_token_counts": op4_token_counts,
    "op5_quality": op5_quality,
    "op6_bpe": op6_bpe,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_url_filters": op8_url_filters,
    "op9_mixing": op9_mixing,
    "op10_exact_topk": op10_exact_topk,
    "op11_phrase_collocations": op11_phrase_collocations,
    "op12_document_fingerprints": op12_document_fingerprints,
    "op13_merkle_manifest": op13_merkle_manifest,
}

ORACLE_SQL: dict[str, str] = {
    "op11_phrase_collocations": r"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang,
                   unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
        words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
        grams AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase
                  FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM words, (SELECT unnest([1, 2, 3, 4, 5]) AS m))),
        f AS (SELECT lang, m, phrase, count(*) AS f FROM grams GROUP BY ALL),
        n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
        c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND f >= 100),
        subs AS (SELECT DISTINCT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, a FROM (SELECT lang, w, a, k, unnest(range(1, m - k + 2)) AS i FROM c, (SELECT unnest([2, 3, 4]) AS k) WHERE k < m)),
        longest AS (SELECT lang, phrase, max(a) AS longer FROM subs GROUP BY ALL),
        kept AS (SELECT c.* FROM c LEFT JOIN longest s USING (lang, phrase) WHERE s.longer IS NULL OR 100 * s.longer < 100 * c.a),
        cuts AS (SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS lp, array_to_string(w[k + 1:], ' ') AS rp FROM (SELECT *, unnest(range(1, m)) AS k FROM kept)),
        scored AS (SELECT t.lang, t.phrase, t.a, t.k, l.f AS l, r.f AS r, n.n, ((1000::HUGEINT * t.a * n.n) // (l.f::HUGEINT * r.f))::BIGINT AS score
                   FROM cuts t JOIN f l ON l.lang = t.lang AND l.phrase = t.lp JOIN f r ON r.lang = t.lang AND r.phrase = t.rp JOIN n ON n.lang = t.lang),
        lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
        ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM lowest)
        SELECT * FROM ranked WHERE rank <= 2000""",
    "op13_merkle_manifest": """
        WITH RECURSIVE f AS (
            SELECT doc_id, coalesce('1' || lang, '0') AS g, n_chars,
                   coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
                   coalesce(strlen(text) || ':' || text, '-') AS tail,
                   xor(4294967295, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::UBIGINT)),
                       lambda acc, b: list_reduce(list_prepend(xor(acc, b), list_transform(range(8), lambda x: 0::UBIGINT)),
                           lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END))) % 7 = 0 AS hit
            FROM documents),
        l AS (SELECT *, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR, '-') || tail) AS leaf,
                     sha256(head || coalesce(strlen((n_chars + hit::INT)::VARCHAR) || ':' || (n_chars + hit::INT)::VARCHAR, '-') || tail) AS tampered FROM f),
        placed AS (SELECT doc_id, g, leaf, coalesce(tampered, leaf) AS tampered, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM l),
        nodes AS (
            SELECT g, 0 AS level, idx, leaf AS digest, count(*) OVER (PARTITION BY g) AS width FROM placed
            UNION ALL
            SELECT g, level + 1, idx // 2, sha256(string_agg(digest, '' ORDER BY idx)), (width + 1) // 2 FROM nodes WHERE width > 1 GROUP BY g, level, idx // 2, width),
        subroots AS (SELECT g, digest AS subroot, row_number() OVER (ORDER BY g) - 1 AS idx FROM nodes WHERE width = 1),
        tops AS (
            SELECT 0 AS level, idx, subroot AS digest, count(*) OVER () AS width FROM subroots
            UNION ALL
            SELECT level + 1, idx // 2, sha256(string_agg(digest, '' ORDER BY idx)), (width + 1) // 2 FROM tops WHERE width > 1 GROUP BY level, idx // 2, width),
        steps AS (
            SELECT p.g, p.idx, w.level, CASE WHEN s.digest IS NULL THEN 'N' WHEN (p.idx >> w.level) % 2 = 1 THEN 'L' ELSE 'R' END || coalesce(s.digest, '') AS step
            FROM placed p JOIN (SELECT DISTINCT g, level FROM nodes WHERE width > 1) w ON p.g = w.g
            LEFT JOIN nodes s ON s.g = p.g AND s.level = w.level AND s.idx = xor(p.idx >> w.level, 1)
            UNION ALL
            SELECT p.g, p.idx, 1000 + w.level, CASE WHEN s.digest IS NULL THEN 'N' WHEN (r.idx >> w.level) % 2 = 1 THEN 'L' ELSE 'R' END || coalesce(s.digest, '')
            FROM placed p JOIN subroots r ON p.g = r.g CROSS JOIN (SELECT DISTINCT level FROM tops WHERE width > 1) w
            LEFT JOIN tops s ON s.level = w.level AND s.idx = xor(r.idx >> w.level, 1)),
        paths AS (SELECT g, idx, list(step ORDER BY level) AS path FROM steps GROUP BY g, idx),
        done AS (SELECT p.doc_id, p.leaf, r.subroot, (SELECT digest FROM tops WHERE width = 1) AS root, coalesce(path, []) AS path, p.tampered
                 FROM placed p JOIN subroots r ON p.g = r.g LEFT JOIN paths h ON h.g = p.g AND h.idx = p.idx),
        told AS (SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda s: s[2:]), '')) AS proof_sha256,
                        list_reduce(list_prepend(tampered, path), lambda acc, s: sha256(CASE s[1] WHEN 'L' THEN s[2:] || acc WHEN 'R' THEN acc || s[2:] ELSE acc END)) AS folded_root FROM done)
        SELECT *, folded_root = root AS verified FROM told""",
    "op10_exact_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
                   WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
              FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
        r AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s)
        SELECT * FROM r WHERE rank <= 5""",
    "op7_exact_dedup": """
        WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
        FROM d""",
}
