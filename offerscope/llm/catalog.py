"""Registered queries of the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (alignment, embedding_links, exact_dedup, fingerprint, language, line_dedup, ngram_jaccard, packing, pii, speculative_bpe,
               spelling, token_files, url_filter)
from .common import Scratch, read
from .encode import tokenizer_path

BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"
PIECE_BPE = "piece_bpe_32k.model"


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.near_duplicates(read(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(read(spark, sf_dir, "documents").select("doc_id", "text"), pii.train(pii.labelled_regions()))
    counts = [F.regexp_count("base", F.lit(f"{k}:")).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans",
                        sum(F.col(f"n_{k}") for k in pii.KINDS).alias("n_spans"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup(docs).select("doc_id", "n_lines", "n_deleted", "text")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = Scratch(spark, "op4").path("files")
    files = token_files.write_token_files(read(spark, sf_dir, "documents"), folder, tokenizer_path(BYTE_BPE), end_id=0, vocab=50257)
    return token_files.read_digests(spark, files)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = url_filter.train(spark, url_filter.labelled_urls())
    return url_filter.judge(read(spark, sf_dir, "pages"), url_filter.RULES, weights)


def op6_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return fingerprint.fingerprint_pairs(docs, fingerprint.rarity(docs))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer_path(WORD_BPE), end_id=1, window=2048)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = language.train(language.training_rows(docs))
    said = language.identify(docs.select("doc_id", "text"), model)
    return said.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def op9_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_links.link(read(spark, sf_dir, "embeddings"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = speculative_bpe.encode_decode(read(spark, sf_dir, "documents"), tokenizer_path(BYTE_BPE))
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids_sha256",
                        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark(read(spark, sf_dir, "documents"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(read(spark, sf_dir, "documents"), tokenizer_path(BYTE_BPE), tokenizer_path(PIECE_BPE))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_ngram_jaccard, op2_pii, op3_line_dedup, op4_token_files, op5_url_filter, op6_fingerprint, op7_packing,
                            op8_language, op9_embedding_links, op10_bpe, op11_exact_dedup, op12_alignment, op13_spelling)
}

# Row order of the table is doc_id order; a window is the shortest run of
# worded lines, from a line on or up to a line, that has 2 words.
_OP3 = r"""
WITH cut AS (
  SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents
), every AS (
  SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS pos FROM cut
), worded AS (
  SELECT doc_id, pos, line, len(regexp_extract_all(line, '[^ 	-
]+')) AS words FROM every
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS idx FROM worded WHERE words > 0
), near AS (
  SELECT *, list(words) OVER a AS wa, list(words) OVER b AS wb, list(line) OVER a AS la, list(line) OVER b AS lb
  FROM numbered WINDOW a AS (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING),
                       b AS (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)
), reach AS (
  SELECT doc_id, idx, la AS ls, list_position(list_transform(range(1, len(wa) + 1), lambda k: list_sum(wa[1:k]) >= 2), true) AS n FROM near
  UNION ALL
  SELECT doc_id, idx - n + 1, lb[len(lb) - n + 1:], n FROM (
    SELECT *, list_position(list_transform(range(1, len(wb) + 1), lambda k: list_sum(list_reverse(wb)[1:k]) >= 2), true) AS n FROM near) WHERE n > 0
), runs AS (
  SELECT DISTINCT doc_id, idx, n, md5(list_aggregate(ls[1:n], 'string_agg', chr(10))) AS run FROM reach WHERE n > 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, idx) AS nth FROM runs
), covered AS (
  SELECT DISTINCT doc_id, unnest(range(idx, idx + n)) AS idx FROM placed WHERE nth > 1
), gone AS (
  SELECT doc_id, pos FROM numbered JOIN covered USING (doc_id, idx)
), kept AS (
  SELECT e.doc_id, string_agg(e.line, chr(10) ORDER BY e.pos) AS text
  FROM every e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.pos = g.pos WHERE g.pos IS NULL GROUP BY e.doc_id
)
SELECT c.doc_id, coalesce(l.n, 0)::BIGINT AS n_lines, coalesce(d.n, 0)::BIGINT AS n_deleted,
       CASE WHEN c.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text
FROM cut c
LEFT JOIN (SELECT doc_id, count(*) AS n FROM numbered GROUP BY doc_id) l ON l.doc_id = c.doc_id
LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) d ON d.doc_id = c.doc_id
LEFT JOIN kept k ON k.doc_id = c.doc_id
"""

_OP11 = r"""
WITH plain AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents
), of_group AS (
  SELECT *, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size FROM plain WINDOW same AS (PARTITION BY body)
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM of_group
"""
ORACLES: dict[str, str] = {"op3_line_dedup": _OP3, "op11_exact_dedup": _OP11}
