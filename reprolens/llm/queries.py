"""Registered queries of the training-data operators, with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import exact_dedup, fingerprints, jaccard, lm, packing, quality, secret_scan, spm, toxicity, warc
from ._common import table


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file on this machine (never copied)."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edit."""
    return fingerprints.edited_neighbours(table(spark, sf_dir, "documents"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded, decoded and compared with the sentencepiece library."""
    return spm.verify(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"), threads=2)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 tokens."""
    pieces = packing.pieces(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), capacity=4096, end_id=1)
    return packing.pack(pieces, capacity=4096)


def op4_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written as WARC records, read back and assembled."""
    return warc.page_digests(table(spark, sf_dir, "pages"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 5-word shingle sets reach a similarity of 0.8."""
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), k=5, share=80)


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probabilities of every document under a model of six sevenths of them."""
    return lm.score(table(spark, sf_dir, "documents"), folds=7, held=2)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learnt from four fifths of the labels."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, learnt from four fifths of the labels."""
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.5)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the largest doc_id of its equal texts."""
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"), keep="max")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate in every document, scored by the forest."""
    return secret_scan.scan(table(spark, sf_dir, "documents"), secret_scan.train(spark, words=secret_scan.vocabulary_words(vocabulary("word_bpe_49k.json"))))


QUERIES = {
    "op6_lm_scoring": op6_lm_scoring,
    "op8_toxicity": op8_toxicity,
    "op2_sentencepiece": op2_sentencepiece,
    "op4_warc_transactions": op4_warc_transactions,
    "op1_merkle_fingerprints": op1_merkle_fingerprints,
    "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
    "op7_quality_classifier": op7_quality_classifier,
    "op10_secret_scan": op10_secret_scan,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op9_exact_dedup": op9_exact_dedup,
}

ORACLE = {
    "op4_warc_transactions": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body, strlen(coalesce(html, '')) AS n FROM pages),
        q AS (SELECT page_id, n, sha1(body) AS d,
                     CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY body) ELSE page_id END AS top FROM p)
        SELECT page_id, n AS payload_bytes, d AS payload_digest,
               CASE WHEN top = page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN top <> page_id THEN top END AS refers_to
        FROM q
    """,
    "op5_ngram_jaccard_join": """
        WITH RECURSIVE w AS (
          SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws
          FROM documents),
        s AS (
          SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS g
          FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        link AS (
          SELECT a.doc_id AS x, b.doc_id AS y
          FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
          JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
          GROUP BY a.doc_id, b.doc_id, na.n, nb.n
          HAVING 100 * count(*) >= 80 * (na.n + nb.n - count(*))),
        reach AS (
          SELECT doc_id, doc_id AS other FROM w
          UNION
          SELECT r.doc_id, l.y FROM reach r JOIN link l ON l.x = r.other)
        SELECT r.doc_id, coalesce(max(n.n), 0) AS n_shingles, min(r.other) AS component_id
        FROM reach r LEFT JOIN n ON n.doc_id = r.doc_id
        GROUP BY r.doc_id
    """,
    "op9_exact_dedup": """
        SELECT doc_id,
               max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
               count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents
    """,
}
