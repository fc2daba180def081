"""From raw documents to packed training sequences, in five written stages.

All stages: columns of the input other than those a stage works on are carried along, whatever they are called; repeated rows are
rows of their own; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import langid, mixing, packing, pii, shingles
from corvane.llm.common import free
from corvane.llm.queries import table
from corvane.session import materialize

#: The tokenizer's file, which workers read from their own installation.
TOKENIZER = "word_bpe_49k.json"
#: The column that holds what a stage doesn't work on.
REST = "rest_of_row"


def few_rows(docs: DataFrame, rows: int = 1024) -> None:
    """Texts are long: Python workers get at most so many rows at once, in this session, from here on."""
    conf, key = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= rows:
        conf.set(key, str(rows))


def fold(docs: DataFrame, *used: str) -> DataFrame:
    """The columns that a stage works on, and all others in one, where no operator's column can clash with them."""
    few_rows(docs)
    return docs.select(*used, F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in used], F.lit(0).alias(free(docs, "fold")[0])).alias(REST))


def unfold(done: DataFrame, docs: DataFrame, *used: str) -> DataFrame:
    """The columns of `docs` again, n_chars being that of the text as it is now."""
    value = lambda c: F.col(f"`{c}`") if c in used else F.length("text").cast("long") if c == "n_chars" else F.col(REST)[c]
    return done.select(*[value(c).alias(c) for c in docs.columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts in no language (`und`: null, empty, without a letter); a missing label becomes the prediction.

    A null doc_id is predicted, but not learned from.
    """
    found = langid.identify(fold(docs, "doc_id", "text", "lang")).where(F.col("lang_pred") != langid.UNKNOWN)
    return unfold(found.withColumn("lang", F.coalesce("lang", "lang_pred")), docs, "doc_id", "text", "lang")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, Jaccard 0.8 or more) stays: that with the smallest doc_id.

    Texts without words, null or not, are one group; a null doc_id stays only where its group has no other; of equal doc_ids one row stays.
    """
    return unfold(shingles.near_copies(fold(docs, "doc_id", "text")).where("representative"), docs, "doc_id", "text")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by their kind; a null text stays null."""
    return unfold(pii.mask(fold(docs, "text")), docs, "text")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to their targets: a document comes once for each time that words of it are taken.

    The null source is one source, the last; texts without words take nothing, and go. Ties of order and equal rows are interchangeable.
    """
    return unfold(mixing.texts(mixing.mix(fold(docs, "doc_id", "source", "text"))), docs, "doc_id", "source", "text")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their token ids, and the sequence and offset at which each goes. A null text has the closing id only."""
    import public_tokenizers

    few_rows(docs)
    pieces = packing.tokenize(docs.select("doc_id", "text"), public_tokenizers.path(TOKENIZER))
    return packing.pack(materialize(pieces, "pieces"))


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("pii", personal_data), ("mixing", mix_sources), ("packing", pack_sequences)]
#: Fingerprints, features and tokenizers aren't SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
