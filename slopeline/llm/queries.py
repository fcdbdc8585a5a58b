"""The registered corpus queries: thin contracts over the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import bpe
from .common import read_table
from .cover_tree import embedding_dedup
from .exact_dedup import exact_dedup
from .language import language_id
from .licenses import license_scan
from .line_dedup import duplicate_lines
from .mixing import mix_sources
from .repeat_runs import collapse_runs
from .simhash import simhash_groups
from .source_divergence import source_divergence
from .substring_dedup import substring_dedup
from .token_count import token_counts
from .toxicity import toxicity


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read_table(spark, sf_dir, "documents").select("doc_id", "source"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(read_table(spark, sf_dir, "embeddings"))


def op3_bpe(spark: SparkSession, sf_dir: str, vocabulary_path: str | None = None) -> DataFrame:
    import public_tokenizers

    path = vocabulary_path or public_tokenizers.path("byte_bpe_50k.json")
    return bpe(read_table(spark, sf_dir, "documents"), path, with_ids=False, with_digests=True)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(read_table(spark, sf_dir, "documents"), with_text=False, with_digest=True)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(read_table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(read_table(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(read_table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read_table(spark, sf_dir, "documents"), digest_all=True).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = duplicate_lines(read_table(spark, sf_dir, "documents"), min_chars=1)
    return found.select("doc_id", "n_compared", F.size("removed").cast("long").alias("n_removed"), "removed")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse_runs(read_table(spark, sf_dir, "documents"), planted=True, with_digest=True)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(read_table(spark, sf_dir, "documents"))


def op13_token_count(spark: SparkSession, sf_dir: str, vocabulary_path: str | None = None) -> DataFrame:
    import public_tokenizers

    return token_counts(read_table(spark, sf_dir, "documents"), vocabulary_path or public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_embedding_dedup": op2_embedding_dedup,
    "op3_bpe": op3_bpe,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_simhash": op5_simhash,
    "op6_toxicity": op6_toxicity,
    "op7_language_id": op7_language_id,
    "op8_license_scan": op8_license_scan,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_line_dedup": op10_line_dedup,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_source_divergence": op12_source_divergence,
    "op13_token_count": op13_token_count,
}

ORACLES = {
    "op2_embedding_dedup": """
        WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
        l AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
            WHERE list_cosine_similarity(a.e, b.e) >= 0.98
        ),
        r(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
        c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
        n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
        SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
        FROM v JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)
    """,
    "op4_substring_dedup": r"""
        WITH w AS (SELECT doc_id, string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') AS all_words FROM documents),
        d AS (SELECT doc_id, list_filter(all_words, lambda x: x <> '') AS words FROM w),
        k AS (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM d WHERE len(words) >= 50),
        h AS (SELECT doc_id, i, md5_number(array_to_string(words[i:i + 49], ' ')) AS edge FROM k),
        f AS (SELECT edge, min(doc_id) AS least FROM h GROUP BY edge),
        g AS (SELECT doc_id, list(i) AS starts FROM h JOIN f USING (edge) WHERE least < doc_id GROUP BY doc_id),
        c AS (SELECT doc_id, list_distinct(flatten(list_transform(starts, lambda s: range(s, s + 50)))) AS gone FROM g),
        r AS (SELECT d.doc_id, words, coalesce(gone, []) AS gone FROM d LEFT JOIN c USING (doc_id))
        SELECT doc_id, len(words)::BIGINT AS n_words, len(gone)::BIGINT AS n_removed,
            sha256(coalesce(array_to_string(list_filter(words, lambda x, i: NOT list_contains(gone, i)), ' '), '')) AS kept_sha256
        FROM r
    """,
    "op9_exact_dedup": """
        WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents),
        g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
        FROM d JOIN g USING (norm)
    """,
    "op12_source_divergence": r"""
        WITH d AS (
            SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
            FROM documents
        ),
        w AS (SELECT r, lang, source, unnest(terms) AS term FROM d),
        k AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
        c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY lang, source, term),
        g AS (SELECT DISTINCT lang, source FROM d),
        v AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY lang),
        t AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY lang, source),
        p AS (
            SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
                1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (t.total + v.v)::HUGEINT AS p,
                1 + (1000000000::HUGEINT * (k.n + 1)) // (v.total + v.v)::HUGEINT AS q
            FROM g JOIN k ON k.lang = g.lang JOIN v ON v.lang = g.lang JOIN t ON t.lang = g.lang AND t.source = g.source
            LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
        ),
        f AS (
            SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
            FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
        ),
        pairs AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
            FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
        ),
        ranked AS (
            SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank
            FROM (SELECT * FROM pairs UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM p WHERE n > 0 AND p > q)
        )
        SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
    """,
}
