"""The corpus pipeline: language identification, line dedup, near-dedup, decontamination, mixing.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before kept, and returns rows that are written
as Parquet and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paneltide.llm import decontaminate, language, line_dedup, mixing, set_similarity
from paneltide.llm.common import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Shingle, bits and similarity of the near-dedup stage.
SHINGLE, DISTANCE, SIMILARITY = 5, 6, 0.8


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the texts that the compression classifier doesn't reject. It learns from all labelled rows of docs;
    null texts, texts without a letter and texts between two languages go. lang becomes the language found."""
    known = language.dictionaries(docs)
    found = language.identify(docs.select(*COLUMNS, F.col("text").alias("__body")), known, tuple(COLUMNS), "__body")
    return found.where("NOT rejected").withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves each line where it or a near one stands first (null ids before others); documents whose lines all stand
    earlier go. Null texts, texts without words and white-space lines stay. Repeated rows are treated alike."""
    return line_dedup.dedup_lines(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long"))


def keyed(docs: DataFrame) -> DataFrame:
    """docs with a key of id and text, so that rows of one id and different texts, and of null id, are told apart."""
    return docs.select(*COLUMNS, F.xxhash64("doc_id", "text").alias("key"))


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash links at DISTANCE bits are verified by similarity, and an exact pass links what is alike beyond these bits.
    Of each group of near duplicates the document of the smallest id stays (of one id: of the smallest hash; null ids
    last). Rows of one id and different texts are documents of their own, rows of equal id and text are one. Texts
    without words are copies of each other."""
    rows = keyed(docs)
    groups = set_similarity.near_duplicates(rows, id_column="key", shingle=SHINGLE, similarity=SIMILARITY, distance=DISTANCE)
    named = groups.distinct().join(rows.select("key", "doc_id").distinct(), "key")
    first = named.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("first")).select("first.key")
    return rows.join(first, "key", "left_semi").dropDuplicates(["key"]).select(*COLUMNS)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item, or a near one, each row by its own text. Null and empty texts stay."""
    rows = keyed(docs)
    found = decontaminate.contaminated(rows, table(spark, sf_dir, "benchmark"), id_column="key").select("key").distinct()
    return rows.join(found, "key", "left_anti").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: for each document its size, its source's target, and the words that the mix takes. Null and empty texts
    have size 0 and give nothing; rows that repeat an id are documents of their own; null sources are a source."""
    return mixing.mix(docs)


STAGES = [
    ("language", identify_language),
    ("lines", dedup_lines),
    ("near_duplicates", dedup_documents),
    ("benchmark", remove_benchmark),
    ("mixing", mix_sources),
]

#: Language identification, SimHash and the Hamming search have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to a folder of its own beside the checkpoints and read again."""
    from paneltide.llm.common import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
