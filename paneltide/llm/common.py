"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One or more ASCII white-space characters; words are what lies between.
WS = r"[\x20\x09-\x0D]+"
#: The single white-space characters of WS, for translate().
WS_CHARS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text; null counts as empty."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WS), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once for a row and not once for each use in a lambda."""
    return F.transform(F.array(value), body)[0]


#: Values that one block of a running sum holds.
SUM_BLOCK = 128


def running_sums(values: Column) -> Column:
    """The sums of an array of numbers up to each place. Blocks are summed by themselves and then shifted by the blocks
    before, so that no list grows with the array."""
    last = lambda a: F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0).cast("long"))
    within = lambda part: F.aggregate(part, F.array().cast("array<bigint>"), lambda a, x: F.concat(a, F.array(last(a) + x)))
    starts = lambda v: F.sequence(F.lit(1), F.size(v), F.lit(SUM_BLOCK))
    blocks = let(values, lambda v: F.when(F.size(v) > 0, F.transform(starts(v), lambda k: within(F.slice(v, k, F.lit(SUM_BLOCK))))))
    shifted = lambda x: F.flatten(F.transform(x["blocks"], lambda part, b: let(F.coalesce(F.get(x["ends"], b - 1), F.lit(0).cast("long")), lambda before: F.transform(part, lambda y: y + before))))
    return let(blocks, lambda b: F.when(b.isNull(), F.array().cast("array<bigint>")).otherwise(let(F.struct(b.alias("blocks"), within(F.transform(b, last)).alias("ends")), shifted)))


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % n


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keeps the folder that spark.checkpoint.dir names; sets one of this machine only where none is set, as in tests."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or os.path.join(tempfile.gettempdir(), "paneltide-checkpoints"))


def cut(df: DataFrame) -> DataFrame:
    """df as written to the shared checkpoint folder: later plans read it and do not compute it again."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """As cut(), as a Parquet table beside the checkpoints: smaller, but without the rows' partitioning."""
    ensure_checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
