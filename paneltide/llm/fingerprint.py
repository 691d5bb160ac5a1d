"""Document fingerprints: one-permutation MinHash with optimal densification and packed low-order bits.

A text's shingles of five words (fewer words: the whole sequence) are hashed once. The top bits of a hash name one of
BINS bins, and each bin keeps its least hash. An empty bin takes the value of another, which its own sequence of attempts
finds: a permutation of bin and attempt gives the place (each sequence differs and reaches all bins). Of each value the
low eight bits are kept, packed. Of two texts of Jaccard similarity J, a share J + (1 - J) / 256 of the bins
agree; likeness() solves that for J.

Only DataFrame functions. The hashes of a text are sorted within its row, where the first of each run of equal top bits
is a bin's least, so a text costs n log n and no shingle is shuffled.

A text without words has the fingerprint zero, which is like only itself. Equal texts have equal fingerprints.

edited() pairs each document with the next one by ascending id. Ids are put in order by ranges, and in windows within
ranges; only the first and last id of each range meet in one task. Texts are shuffled once, and the beginnings of texts
once more. Null ids come first; rows of one id and different texts follow each other by their text's hash, and rows
that repeat id and text are one document, with equal results. Null texts are empty. After the last document comes the
first; a single one follows itself.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import LOWER, UPPER, cut, let, shuffle_partitions, table, words, written

SHINGLE = 5
#: A power of two; the standard error of a likeness is half of one over its root at most.
BINS, KEPT_BITS = 256, 8
#: Ids of a range when there are many.
RANGE_ROWS = 100_000


def shingle_hashes(text: Column, shingle: int = SHINGLE) -> Column:
    """Hashes of the word shingles, A-Z in lower case, repeats included."""
    each = F.transform(words(F.translate(text, UPPER, LOWER)), lambda w: F.xxhash64(w))
    starts = lambda h: F.when(F.size(h) > 0, F.sequence(F.lit(0), F.greatest(F.size(h) - shingle, F.lit(0))))
    # Places beyond the last word are null, which the hash passes over.
    gram = lambda h, i: F.xxhash64(*[F.get(h, i + k) for k in range(shingle)])
    return let(each, lambda h: F.coalesce(F.transform(starts(h), lambda i: gram(h, i)), F.array().cast("array<bigint>")))


def least_by_bin(hashes: Column, bins: int = BINS) -> Column:
    """An array of bins places: the least hash of each bin, or null."""
    bits = bins.bit_length() - 1
    top = lambda x: F.shiftright(x, 64 - bits) + bins // 2
    none = lambda n: F.array_repeat(F.lit(None).cast("bigint"), n.cast("int"))

    def spread(least: Column) -> Column:
        placed = F.transform(least, lambda x, i: F.concat(none(top(x) - F.coalesce(top(F.get(least, i - 1)), F.lit(-1)) - 1), F.array(x)))
        return F.concat(F.flatten(placed), none(F.lit(bins - 1) - F.coalesce(top(F.get(least, F.size(least) - 1)), F.lit(-1))))

    # Signed order sorts by bin and then by hash.
    runs = let(F.sort_array(hashes), lambda s: F.filter(s, lambda x, i: (i == 0) | (top(x) != top(F.get(s, i - 1)))))
    return let(runs, spread)


def attempts(bins: int = BINS) -> tuple[list[int], list[int]]:
    """Permutations of the bins: places, and for each attempt what a bin's number is xored with before it looks there."""
    by = lambda name: sorted(range(bins), key=lambda k: hashlib.sha256(f"{name}:{k}".encode()).digest())
    return by("place"), by("attempt")


def densified(least: Column, bins: int = BINS) -> Column:
    """The places filled from each other; all null if all were."""
    places, masks = attempts(bins)
    table = F.array(*map(F.lit, places))
    borrowed = lambda m, j: [F.get(m, F.get(table, j.bitwiseXOR(mask))) for mask in masks]
    return let(least, lambda m: F.transform(m, lambda x, j: F.coalesce(x, *borrowed(m, j))))


def packed(values: Column, bits: int = KEPT_BITS) -> Column:
    """The low bits of each value, as bytes; zeros for nulls."""
    digits = bits // 4
    return F.unhex(F.array_join(F.transform(values, lambda x: F.lpad(F.hex(F.coalesce(x, F.lit(0)).bitwiseAND((1 << bits) - 1)), digits, "0")), ""))


def fingerprint(text: Column, bins: int = BINS, bits: int = KEPT_BITS, shingle: int = SHINGLE) -> Column:
    """Bytes that hold bins places of bits bits (four or eight)."""
    return packed(densified(least_by_bin(shingle_hashes(text, shingle), bins), bins), bits)


def likeness(a: Column, b: Column, bins: int = BINS, bits: int = KEPT_BITS) -> Column:
    """The Jaccard similarity that two fingerprints tell, from 0 to 1, without the agreement that chance makes."""
    digits = bits // 4
    chance = 2.0**-bits
    zero = F.lit(bytes(bins * bits // 8))
    at = lambda x, i: F.substring(x, i, F.lit(digits))
    both = F.struct(F.encode(F.hex(a), "US-ASCII").alias("a"), F.encode(F.hex(b), "US-ASCII").alias("b"))
    agree = let(both, lambda x: F.size(F.filter(F.sequence(F.lit(1), F.lit(bins * digits), F.lit(digits)), lambda i: at(x["a"], i) == at(x["b"], i))))
    return F.when(a == b, F.lit(1.0)).when((a == zero) | (b == zero), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), (agree / bins - chance) / (1 - chance)))


def _names(id_column: str, text: str) -> list[Column]:
    """What tells documents apart, without nulls: the id's digits and the text's hash."""
    return [F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("name"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash")]


def neighbours(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """For each document its id, name, text_hash and n_chars, those of the document before (b_) and of the next (n_)."""
    body = F.coalesce(F.col(text), F.lit(""))
    fields = ["id", "text_hash", "name", "n_chars"]
    keys = written(docs.select(F.col(id_column).alias("id"), *_names(id_column, text), F.length(body).cast("long").alias("n_chars")).dropDuplicates(["name", "text_hash"]))
    ranges = max(2 * shuffle_partitions(docs.sparkSession), math.ceil(keys.count() / RANGE_ROWS))
    ordered = cut(keys.repartitionByRange(ranges, "id", "text_hash").select(F.struct(*fields).alias("me"), F.spark_partition_id().alias("part")))
    # A row a range: few enough for one window.
    ends = ordered.groupBy("part").agg(F.min("me").alias("low"), F.max("me").alias("high"))
    whole = W.partitionBy(F.lit(0))
    edges = ends.select("part", F.coalesce(F.lag("high").over(whole.orderBy("part")), F.max("high").over(whole)).alias("ahead"), F.coalesce(F.lead("low").over(whole.orderBy("part")), F.min("low").over(whole)).alias("after"))
    inside = W.partitionBy("part").orderBy("me")
    near = ordered.select("part", "me", F.lag("me").over(inside).alias("b"), F.lead("me").over(inside).alias("n")).join(edges, "part")
    b, n = F.coalesce("b", "ahead"), F.coalesce("n", "after")
    return near.select("me.*", b["name"].alias("b_name"), b["text_hash"].alias("b_hash"), b["n_chars"].alias("b_chars"), n["name"].alias("n_name"), n["text_hash"].alias("n_hash"))


def edited(docs: DataFrame, share: int = 4, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row of docs as id, its neighbours' names, its text, and its edited text: the last n_chars / share code points
    give way to the first as many of the next document."""
    near = cut(neighbours(docs, id_column, text))
    own = docs.select(*_names(id_column, text), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = own.join(near.hint("merge"), ["name", "text_hash"])
    gives = F.floor(F.col("b_chars") / share).cast("int")
    heads = rows.dropDuplicates(["name", "text_hash"]).select(F.col("b_name").alias("name"), F.col("b_hash").alias("text_hash"), F.substring("text", F.lit(1), gives).alias("head"))
    both = rows.join(heads.hint("merge"), ["name", "text_hash"])
    stays = F.substring("text", F.lit(1), (F.col("n_chars") - F.floor(F.col("n_chars") / share)).cast("int"))
    return both.select("id", "name", "text_hash", "n_name", "n_hash", "n_chars", "text", F.concat(stays, "head").alias("edited"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: all documents, their edited texts, and both likenesses."""
    rows = edited(table(spark, sf_dir, "documents").select("doc_id", "text"))
    made = rows.select("id", "name", "text_hash", "n_name", "n_hash", "n_chars", F.unhex(F.sha2("edited", 256)).alias("sha256"), fingerprint(F.col("text")).alias("fingerprint"), fingerprint(F.col("edited")).alias("edited_fingerprint"))
    kept = written(made)
    after = kept.select(F.col("name").alias("n_name"), F.col("text_hash").alias("n_hash"), F.col("fingerprint").alias("next")).dropDuplicates(["n_name", "n_hash"])
    digits = lambda c: F.lower(F.hex(c))
    return kept.join(after, ["n_name", "n_hash"]).select(
        F.col("id").alias("doc_id"),
        "n_chars",
        digits("sha256").alias("edited_sha256"),
        digits("fingerprint").alias("fingerprint"),
        digits("edited_fingerprint").alias("edited_fingerprint"),
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next")).alias("near_next"),
    )
