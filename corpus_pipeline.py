"""Corpus pipeline: language ID, line dedup, near-duplicate removal, PII
redaction, packing.

Each stage is a function of (spark, docs, sf_dir); its result is written as
Parquet and read again as the next one's ``docs``.  All but the last return
the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerscope.llm import language, line_dedup, ngram_jaccard, packing, pii
from offerscope.llm.catalog import WORD_BPE
from offerscope.llm.common import DOC_COLUMNS, Scratch, read
from offerscope.llm.encode import tokenizer_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language is rejected (also null and letterless
    texts); the others stay as they are, rows of one id or equal rows each.
    Without documents nothing is learned and nothing stays."""
    said = language.identify(docs, language.train(language.training_rows(docs)))
    return said.where("NOT rejected").select(*DOC_COLUMNS)


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later copies of repeated lines and line runs, however short; a
    document of which no word is left was a copy throughout and goes.  Earlier
    is by id (null first), then by place.  Null and wordless texts stay."""
    done = line_dedup.dedup(docs, min_words=1)
    return done.where("n_deleted = 0 OR n_deleted < n_lines").withColumn("n_chars", F.char_length("text").cast("long")).select(*DOC_COLUMNS)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each component of near copies, that of the smallest id
    (a null one last), and one of rows that are equal in id and text; all
    other documents stay, wordless ones too.

    A row is known by a hash of its id and text, so rows that share an id, or
    have none, are judged each by its own text."""
    marked = docs.withColumn("_id", F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text"))
    found = ngram_jaccard.near_duplicates(marked.select(F.col("_id").alias("doc_id"), "text"))
    place = F.struct(F.col("doc_id").isNull(), "doc_id", "_id")
    named = found.select(F.col("doc_id").alias("_id"), "component_id").distinct().join(marked.select("_id", "doc_id"), "_id")
    stay = named.groupBy("component_id").agg(F.min(place).alias("first")).select("first._id")
    return marked.join(stay, "_id", "left_semi").dropDuplicates(["_id", "doc_id", "text"]).select(*DOC_COLUMNS)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces each span of personal data by its kind; no document goes, null
    texts stay null, equal rows are treated alike."""
    found = pii.detect(docs, pii.train(pii.labelled_regions()))
    return found.withColumn("text", F.col("redacted")).withColumn("n_chars", F.char_length("text").cast("long")).select(*DOC_COLUMNS)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of at most 2048 tokens; a null text is
    empty (its end token alone), equal rows are packed each."""
    return packing.pack(docs, tokenizer_path(WORD_BPE), end_id=1, window=2048)


STAGES = [
    ("language", identify_language),
    ("line_dedup", remove_repeated_lines),
    ("ngram_jaccard", keep_one_of_each_group),
    ("pii", redact_personal_data),
    ("packing", pack_windows),
]

# Trained models, tokenizers and components by similarity have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the ``documents`` table."""
    scratch = Scratch(spark, "pipeline")
    docs = read(spark, sf_dir, "documents").select(*DOC_COLUMNS)
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return docs
