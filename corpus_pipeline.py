"""The corpus pipeline: language ID, near-duplicates, decontamination, secrets, tokens.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns the columns of documents, the
last one the encoded documents. A stage's result is written as Parquet in the shared scratch folder and read again as
the next one's input, so a lost executor never sends work back over an earlier stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stillframe.llm import bpe, decontam, langid, neardup, secrets
from stillframe.llm._util import Scratch, bound_batches, kept_names

#: The least share of a document's n-grams that are common in the learned languages.
MIN_KNOWN = 0.25


def _own(out: DataFrame, docs: DataFrame, outputs: tuple[str, ...]) -> DataFrame:
    """The columns of docs, under their own names."""
    return out.select(*[F.col(f"`{n}`").alias(c) for n, c in zip(kept_names(tuple(docs.columns), outputs), docs.columns, strict=True)])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a recognised language; those without a letter, or of letters as no learned language puts them, go.

    Null and empty texts have no letter and go; rows without lang are not learned from and stay or go by their text;
    very long texts are read whole; equal scores go to the first language by name; repeated rows stay or go together;
    columns named like the operator's outputs stay as they are; without a row to learn from, or an empty table, nothing
    is rejected."""
    bound_batches(spark)  # stays for the later stages too
    model = langid.fit(docs, F.lit(True))
    got = langid.predict(docs, model, keep=tuple(docs.columns))
    if not model.langs:  # nothing to learn from: nothing to reject by
        return docs
    return _own(got.where((F.col("lang_pred") != "und") & (F.col("known") >= MIN_KNOWN)), docs, langid.OUTPUTS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group linked at a Jaccard similarity of 0.8 of 5-word sets.

    Texts without words (null among them) are linked with nothing and stay; rows without doc_id are linked by their
    text; of rows that repeat a doc_id the one of the smallest text hash stays; very long texts are compared whole;
    other columns stay as they are, whatever their names; an empty table gives no rows."""
    return neardup.drop_near_duplicates(docs, words=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no ten-word window of a benchmark item.

    Null texts, documents and items, hold no words: such documents stay, such items match nothing; an item of fewer
    words is one window; very long texts are read whole; repeated rows stay or go together; columns named like the
    operator's outputs stay as they are; an empty table gives no rows, an empty benchmark rejects none."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    got = decontam.find_contamination(docs, benchmark, keep=tuple(docs.columns))
    return _own(got.where(F.size("hits") == 0), docs, ("n_words", "hits", "items", "__row", "h", "i"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark, and n_chars (where there is one) counted again.

    Null texts stay null; spans that touch or overlap are one mark each, from the first one's start; very long texts
    are read whole; repeated rows are redacted alike; all columns keep their names; an empty table gives no rows."""
    return secrets.redact_secrets(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and ids of all documents.

    A null text has no ids; null doc_id, lang or source stay null; repeated rows are encoded each; very long texts are
    encoded whole; other columns are ignored, ids and n_tokens among them; an empty table gives no rows."""
    got = bpe.encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"), keep=("doc_id", "lang", "source"), decoded=False, max_chunks=100_000)
    return got.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("encode", encode),
]

#: The CRF and the classifier are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return docs
