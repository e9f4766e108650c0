"""Corpus pipeline: five stages from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's rows and reads them back.
All stages read the named columns alone, so others may have any name and go no further; very long texts are read whole;
an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brinewood.llm import langid, mixing, ngram_join, packing, secrets
from brinewood.llm.common import crc_share, materialize, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language (null or letterless texts) and fills in the language where it is not given.

    A given language stays, whatever the network says; repeated rows are judged alike and all kept.
    """
    model = langid.train(docs.where(crc_share(F.col("doc_id"), 3) != 1))
    found = langid.predict(docs.select(*COLUMNS), model)
    if model is None:  # nothing to learn from: whatever has letters stays
        return found.where(langid.letters(F.col("text"))).select(*COLUMNS)
    kept = found.where(F.col("lang_pred") != langid.UNKNOWN)
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each component, one with its smallest doc_id; rows without shingles are each their own.

    A row is named by its doc_id and text, so rows that share a doc_id are judged by their texts, and of rows with equal
    doc_id and text one stays. Rows without doc_id can't be named by a component and stay.
    """
    docs = docs.select(*COLUMNS).withColumn("_text", F.coalesce(F.unhex(F.md5(F.col("text").cast("binary"))), F.lit(b"")))
    joined = ngram_join.join(docs, key_col="_text").where(F.col("doc_id").isNotNull())
    first = joined.where(F.col("component").isNotNull()).groupBy("component").agg(F.min(F.struct("doc_id", "key")).alias("x")).select("x.*")
    keep = first.unionByName(joined.where(F.col("component").isNull()).select("doc_id", "key")).distinct()
    keep = materialize(keep.toDF("_keep", "_key"), "kept")
    named = docs.where(F.col("doc_id").isNotNull()).join(keep, (F.col("doc_id") == F.col("_keep")) & (F.col("_text") == F.col("_key")), "left_semi")
    repeated = docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id", "_text").count().where("count > 1").select(F.col("doc_id").alias("_again"), F.col("_text").alias("_same"))
    repeated = materialize(repeated, "repeated")
    if not repeated.isEmpty():
        same = (F.col("doc_id") == F.col("_again")) & (F.col("_text") == F.col("_same"))
        again = named.join(repeated, same, "left_semi").groupBy("doc_id", "_text").agg(F.min(F.struct(*COLUMNS[1:])).alias("x")).select("doc_id", "x.*", "_text")
        named = named.join(repeated, same, "left_anti").unionByName(again)
    return named.unionByName(docs.where(F.col("doc_id").isNull())).drop("_text")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces credentials in the texts by marks that tell live-looking ones from widely copied examples.

    Every row stays. Null and empty texts, and texts without spans, stay as they are; of other rows text and n_chars change.
    Spans that overlap are replaced as one; repeated rows change alike.
    """
    return secrets.redact(docs.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as the mix does: none, once, or up to three times.

    Documents without words (null, empty) are not taken. Rows without source are a source of their own. Which of the rows of
    one source and size are taken follows a hash of the whole row, so reruns agree; rows that are equal are interchangeable.
    """
    mixed = mixing.mix(docs.select(*COLUMNS), keep=COLUMNS)
    taken = mixed.where(F.col("copies") > 0)
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of 1024 tokens.

    A null or empty text is one piece of the end id; longer documents are cut; rows that the mix repeated are packed one by
    one, and rows of one doc_id can be told apart by their place alone.
    """
    packed = packing.pack(docs.select("doc_id", "text"))
    return packed.select(F.col("row.doc_id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("language_id", identify),
    ("near_duplicates", near_duplicates),
    ("secret_scan", redact_secrets),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

#: Language identification is learned, and SQL has no tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return materialize(STAGES[-1][1](spark, docs, sf_dir), STAGES[-1][0])
