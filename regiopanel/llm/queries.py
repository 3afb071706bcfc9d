"""The registered queries of the training-data operators, and their DuckDB SQL
where SQL can express them.  Each query applies its operator with production
parameters to the whole intended table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate as _decontaminate
from . import exact_dedup as _exact
from . import lexical_search as _search
from . import lm_score as _lm
from . import ngram_join as _ngrams
from . import packing as _packing
from . import pii as _pii
from . import quality as _quality
from . import substring_dedup as _substrings
from . import toxicity as _toxicity
from . import warc as _warc
from . import whitening as _whitening
from . import word_table_bpe as _bpe
from .common import load


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that documents have in common, nearly or exactly."""
    return _substrings.repeated_passages(load(spark, sf_dir, "documents"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of ``documents`` under 4-word shingle Jaccard of 0.85 or more."""
    return _ngrams.ngram_jaccard_components(load(spark, sf_dir, "documents"), n=4, percent=85)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, learned from ``labels.toxic``."""
    return _toxicity.toxicity_scores(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WARC archive of ``pages``, written and read back."""
    return _warc.archive_round_trip(load(spark, sf_dir, "pages"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from ``labels.quality``."""
    return _quality.quality_scores(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    return _packing.pack_documents(load(spark, sf_dir, "documents"), capacity=2048)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that documents leak."""
    return _decontaminate.find_leaks(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model and unigram log10 probability of every document."""
    return _lm.lm_scores(load(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return _pii.find_personal_data(load(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact dedup of ``documents``: the largest doc_id of equal texts stays."""
    return _exact.exact_dedup(load(spark, sf_dir, "documents"), keep="largest")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of every benchmark item, by exact integer scores."""
    return _search.ranked_search(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"), k=50)


def op12_word_table_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's BPE ids through the table of distinct words, and what they decode to."""
    return _bpe.encode_and_decode(load(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding on the 32 leading components, whitened."""
    return _whitening.whiten(load(spark, sf_dir, "embeddings"), components=32)


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_ngram_join": op2_ngram_join,
    "op3_toxicity": op3_toxicity,
    "op4_warc": op4_warc,
    "op5_quality": op5_quality,
    "op6_packing": op6_packing,
    "op7_decontaminate": op7_decontaminate,
    "op8_lm_score": op8_lm_score,
    "op9_pii": op9_pii,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_lexical_search": op11_lexical_search,
    "op12_word_table_bpe": op12_word_table_bpe,
    "op13_whitening": op13_whitening,
}

# A-Z to a-z, and the ASCII white space that parts words.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"list_filter(regexp_split_to_array({_LOWER}, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"
# Runs of ASCII letters and digits and of characters above ASCII.
_TERM = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"

SQL = {
    "op2_ngram_join": f"""
        WITH RECURSIVE words AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        grams AS (
            SELECT DISTINCT doc_id, unnest(
                CASE WHEN len(w) = 0 THEN []
                     WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                     ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g
            FROM words),
        sizes AS (
            SELECT doc_id, count(g) AS n_shingles FROM words LEFT JOIN grams USING (doc_id) GROUP BY doc_id),
        shared AS (
            SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n
            FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
        links AS (
            SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
            WHERE 100 * n >= 85 * (p.n_shingles + q.n_shingles - n)),
        reached AS (
            SELECT doc_id AS a, doc_id AS b FROM sizes
            UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a)
        SELECT doc_id, n_shingles, min(b) AS component_id
        FROM sizes JOIN reached ON a = doc_id GROUP BY doc_id, n_shingles""",
    "op4_warc": """
        WITH hashed AS (
            SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
        bits AS (
            SELECT *, array_to_string(list_transform(range(1, 41), lambda i:
                ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111']
                [strpos('0123456789abcdef', hex[i])]), '') AS b, min(page_id) OVER (PARTITION BY hex) AS least
            FROM hashed)
        SELECT page_id, payload_bytes,
               array_to_string(list_transform(range(0, 32), lambda k: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 +
                   list_sum(list_transform(range(1, 6), lambda j: CAST(b[k * 5 + j] AS INT) * CAST(power(2, 5 - j) AS INT)))::INT]), '')
                   AS payload_digest,
               CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> least THEN least END AS refers_to
        FROM bits""",
    "op10_exact_dedup": """
        SELECT doc_id,
               max(doc_id) OVER same AS keep_id,
               count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents
        WINDOW same AS (PARTITION BY coalesce(text, ''))""",
    "op11_lexical_search": f"""
        WITH words AS (SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '{_TERM}')) AS t FROM documents),
        lengths AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
        corpus AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS all_terms FROM lengths),
        asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWER}, '{_TERM}')) AS t FROM benchmark),
        counts AS (SELECT doc_id, t, count(*)::BIGINT AS tf FROM words WHERE t IN (SELECT t FROM asked) GROUP BY doc_id, t),
        weights AS (SELECT t, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
                    FROM counts, corpus GROUP BY t),
        impacts AS (
            SELECT doc_id, t, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // all_terms))) AS x
            FROM counts JOIN weights USING (t) JOIN lengths USING (doc_id), corpus),
        scores AS (SELECT item_id, doc_id, sum(x)::BIGINT AS score FROM asked JOIN impacts USING (t) GROUP BY ALL HAVING score > 0)
        SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score
        FROM scores QUALIFY rank <= 50""",
}
