"""Language identification by compression: a text's language is the one whose dictionary compresses it best.

Each language has a zstandard raw-content dictionary of at most DICTIONARY_BYTES, made of slices of the texts of
at most SAMPLE_TEXTS labelled documents, those whose ids have the lowest hashes. That bound on the sample is all
that is limited: every text is encoded whole, in chunks, so that the dictionary counts as much at the end of a
long text as at its beginning. The score compares the best language's size with the next one's; a text is
rejected where they lie closer than MARGIN. Equal sizes go to the language with more labelled documents (then the
first by name). Texts are encoded in lower case. Every label is learned; an executor holds a dictionary for each, and
a text is encoded once with each.

Texts that are null or hold no letter (str.isalpha; numerals and circled digits are none) are "und" with score 0 and rejected. Rows are independent of each other, so
repeated rows get equal results and no shuffle is needed but for the choice of the sample, which sends
SPARE * SAMPLE_TEXTS rows of a language to a task, about, however many there are. The kept columns must not be named
like the three that are added. Without any labelled text all rows are "und".
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold, table

DICTIONARY_BYTES = 160_000
SAMPLE_TEXTS = 640
#: Rows of a language that may be ranked for the sample, for each that is taken.
SPARE = 4
CHUNK_BYTES = 2_048
LEVEL = 9
#: The next language's size must exceed the best one's by this share of it.
MARGIN = 0.002
#: Texts that need fewer bytes than these leave too small a trace for a margin; they are not rejected.
TRACE_BYTES = 64
#: The share at which the score is 0.5.
HALF = 0.04
NONE = "und"

def dictionaries(docs: DataFrame, text: str = "text", lang: str = "lang", id_column: str = "doc_id", texts: int = SAMPLE_TEXTS, size: int = DICTIONARY_BYTES) -> dict[str, bytes]:
    """A raw-content dictionary for each language, from documents that have a text and a language."""
    some = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull() & (F.trim(text) != ""))
    counts = some.groupBy(F.col(lang).cast("string").alias("lang")).agg(F.count(F.lit(1)).alias("n"))
    known = [r[0] for r in counts.orderBy(F.desc("n"), "lang").collect()]
    place = F.xxhash64("id", "size")
    rank = F.row_number().over(W.partitionBy("lang").orderBy(place, "id", "size", "start"))
    share = max(1, size // texts)
    #: A slice of the text, from a place that a hash chooses.
    start = F.pmod(F.xxhash64(F.col(id_column)), F.greatest(F.length(text) - share, F.lit(1))) + 1
    slices = some.select(F.col(lang).cast("string").alias("lang"), F.col(id_column).alias("id"), F.length(text).alias("size"), F.lower(F.substr(text, start.cast("int"), F.lit(share))).alias("start"))
    # The lowest hashes of a language lie below a bound that leaves SPARE times as many rows as are wanted, however many it has.
    low = slices.join(F.broadcast(counts.where(F.col("n") > SPARE * texts)), "lang", "left").where(F.col("n").isNull() | (F.shiftrightunsigned(place, 33) * F.col("n") < float(SPARE * texts << 31))).drop("n")
    rows = low.withColumn("rank", rank).where(F.col("rank") <= texts).select("lang", "rank", "start").collect()
    out: dict[str, bytes] = {str(name): b"" for name in known}
    for r in sorted(rows, key=lambda r: (r["lang"], -r["rank"])):
        out[r["lang"]] = (out[r["lang"]] + r["start"].encode() + b"\n")[-size:]
    return out


def sizes(data: bytes, coders: list) -> list[int]:
    """Bytes that each coder needs for the data."""
    chunks = [data[i : i + CHUNK_BYTES] for i in range(0, len(data), CHUNK_BYTES)]
    return [sum(len(coder.compress(c)) for c in chunks) for coder in coders]


def identify(docs: DataFrame, known: dict[str, bytes], keep: tuple[str, ...] = ("doc_id",), text: str = "text", margin: float = MARGIN) -> DataFrame:
    """The kept columns, lang_pred, score and rejected."""
    fields = {f.name: f for f in docs.schema.fields}
    source = docs.select(*keep, F.col(text).alias("__text"))
    schema = T.StructType([*[fields[c] for c in keep], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    names = list(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        coders = []
        for name in names:
            dictionary = zstandard.ZstdCompressionDict(known[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            dictionary.precompute_compress(level=LEVEL)
            coders.append(zstandard.ZstdCompressor(dict_data=dictionary, write_checksum=False, write_content_size=False, write_dict_id=False))
        for batch in batches:
            found, scores, rejected = [], [], []
            for value in batch.column(len(keep)):
                t = value.as_py()
                if t is None or not names or not any(map(str.isalpha, t)):
                    row = (NONE, 0.0, True)
                else:
                    need = sizes(t.lower().encode("utf-8", "surrogatepass"), coders)
                    best = min(range(len(names)), key=lambda k: (need[k], k))
                    rest = min((n for k, n in enumerate(need) if k != best), default=2 * need[best])
                    gap = (rest - need[best]) / need[best]
                    row = (names[best], gap / (gap + HALF) if gap > 0 else 0.0, gap < margin and need[best] >= TRACE_BYTES)
                for out, x in zip((found, scores, rejected), row, strict=True):
                    out.append(x)
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], pa.array(found, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], names=schema.names)

    return source.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: all documents, learned from those of the folds that are not held out."""
    docs = table(spark, sf_dir, "documents")
    held = fold(F.col("doc_id"), 3) == 1
    found = identify(docs, dictionaries(docs.where(~held)))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")
