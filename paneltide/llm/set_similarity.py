"""Near duplicates by SimHash and the exact Jaccard similarity of the sets of shingles.

Texts (in lower case) are sets of hashed shingles of their words. Equal sets are collapsed to one. A set's SimHash has
the bits that over half of its shingles' hashes have; the generalised pigeonhole search of simhash.py finds the sets
within `distance` bits, which are compared exactly and give the first links.

No number of bits is sure to hold a similarity, so an exact pass follows for what these links leave apart. Two sets of
a similarity of at least t share a shingle among the first n - ceil(t * n) + 1 of each, in any order common to all sets;
the order is from rare to frequent shingles, by a sketch of counts, so that passages which many texts share seldom
come first. Sets that meet at such a shingle, and whose sizes and counts by part of the hash's range allow the
similarity, are compared exactly.

What is wanted are the components, so pairs within one, be it by SimHash, need no comparison: where a shingle has more than FEW sets,
these are first compared with a common one, ROUNDS times with another, and then all pairs of them that are not yet in
one component are. Nothing is left out: if the links so far do not join two sets, they are compared themselves.

Texts without words have the empty set and are copies of each other. Rows that repeat an id count as one; rows of null
id are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, written
from .components import components
from .decontaminate import shingles
from .simhash import candidates, majority, text_bytes
from .tokens import hash_words, mix64

FEW, ROUNDS = 16, 4
#: Ids (of 8 bytes) up to which a set of ids is broadcast; beyond, the texts are shuffled to it.
BROADCAST_IDS = 500_000
#: Bits of a shingle that choose its counter in the sketch.
SKETCH_BITS = 18
#: Rows in which a task packs its counters, and groups of tasks whose counters are added first.
SKETCH_ROWS, SKETCH_SALTS = 64, 512
#: Parts of the hash's range in which a set's shingles are counted; two sets share at most the lesser count of each part.
PARTS = 256
_OTHER = np.uint64(0x9E3779B97F4A7C15)


def sets_of(texts: list[bytes], size: int) -> list[np.ndarray]:
    """The sorted distinct shingles of each text; of its whole sequence if it has fewer words."""
    h, starts = hash_words(b"\n".join(texts))
    ends = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts]))
    begins = np.concatenate(([0], ends[:-1]))
    return [np.unique(mix64(shingles(h[a:b], min(size, b - a)))) if b > a else np.zeros(0, np.uint64) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]


def _slices(batches: Iterator[pa.RecordBatch], column: int, size: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for whole in batches:
        for at in range(0, whole.num_rows, 200):
            batch = whole.slice(at, 200)
            yield batch, sets_of(text_bytes(batch.column(column)), size)


def _lists(values: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(v) for v in values]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.uint64), *values]).view(np.int64)))


def sketch(source: DataFrame, size: int) -> np.ndarray:
    """How many sets have a shingle of each counter. source: id and text.

    A task gives its counters in a few packed rows, which are added in two steps, so no task adds very many."""
    cells = (1 << SKETCH_BITS) // SKETCH_ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << SKETCH_BITS, np.int64)
        for _, sets in _slices(batches, 1, size):
            n += np.bincount((np.concatenate(sets) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(n))
        salt = TaskContext.get().partitionId() % SKETCH_SALTS
        yield pa.RecordBatch.from_arrays([pa.array(range(SKETCH_ROWS), pa.int32()), pa.array([salt] * SKETCH_ROWS, pa.int32()), pa.array([x.tobytes() for x in n.reshape(-1, cells)])], names=["row", "salt", "counts"])

    def add(rows: pa.Table) -> pa.Table:
        total = sum((np.frombuffer(x.as_py(), np.int64) for x in rows.column("counts")), np.zeros(cells, np.int64))
        return rows.slice(0, 1).drop_columns(["counts"]).append_column("counts", pa.array([total.tobytes()]))

    schema = "row int, salt int, counts binary"
    packed = source.mapInArrow(run, schema).groupBy("row", "salt").applyInArrow(add, schema).groupBy("row").applyInArrow(add, schema)
    out = np.zeros((SKETCH_ROWS, cells), np.int64)
    for r in packed.collect():
        out[r["row"]] = np.frombuffer(bytes(r["counts"]), np.int64)
    return out.reshape(-1)


def parts_of(s: np.ndarray) -> np.ndarray:
    """How many shingles are in each of PARTS parts of the hash's range; nothing where the numbers are too large."""
    n = np.bincount((s & np.uint64(PARTS - 1)).astype(np.int64), minlength=PARTS)
    return n.astype(np.int16) if n.max() < 1 << 15 else np.zeros(0, np.int16)


def with_prefixes(source: DataFrame, size: int, similarity: float) -> DataFrame:
    """id, the set as two sums of hashes, its size n, its SimHash, its first shingles, and its counts by part."""
    counts = source.sparkSession.sparkContext.broadcast(sketch(source, size))
    schema = T.StructType([source.schema["id"], *[T.StructField(c, T.LongType()) for c in ("one", "two", "n", "fingerprint")], T.StructField("first", T.ArrayType(T.LongType())), T.StructField("parts", T.ArrayType(T.ShortType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sets in _slices(batches, 1, size):
            first = []
            for s in sets:
                most = len(s) - int(np.ceil(similarity * len(s) - 1e-9)) + 1 if len(s) else 0
                first.append(s[np.lexsort((s, counts.value[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]))[:most]])
            one, two = (np.array([mix64(s ^ salt).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64) for salt in (np.uint64(0), _OTHER))
            n = np.array([len(s) for s in sets], np.int64)
            prints = majority(np.concatenate([np.zeros(0, np.uint64), *sets]), n).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(one), pa.array(two), pa.array(n), pa.array(prints), _lists(first), pa.array([parts_of(s) for s in sets], pa.list_(pa.int16()))], names=schema.names)

    return source.mapInArrow(run, schema)


def with_ids(source: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of source whose id is in ids (distinct, one column id, written down)."""
    return source.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "id", "left_semi")


def _ids(pairs: DataFrame) -> DataFrame:
    return cut(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())


def _sides(pairs: DataFrame, of: DataFrame, *columns: str) -> DataFrame:
    """pairs with the columns that their ids have."""
    own = lambda side: of.select(F.col("id").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in columns])
    return pairs.join(own("a"), "a").join(own("b"), "b")


def possible(pairs: DataFrame, rows: DataFrame, similarity: float) -> DataFrame:
    """Of the pairs those that can have the similarity by their sets' counts: what is left out can't, what stays may."""
    pairs = cut(pairs)
    both = _sides(pairs, with_ids(rows.select("id", "n", "parts"), _ids(pairs)), "n", "parts")
    most = F.aggregate(F.zip_with("parts_a", "parts_b", lambda x, y: F.least(x, y)), F.lit(0), lambda total, x: total + x)
    unknown = (F.size("parts_a") == 0) | (F.size("parts_b") == 0)
    return both.where(unknown | (most * (1 + similarity) >= similarity * (F.col("n_a") + F.col("n_b")) - 1e-9)).select("a", "b")


def verified(pairs: DataFrame, rows: DataFrame, source: DataFrame, size: int, similarity: float) -> DataFrame:
    """Of the pairs (a, b) of ids those whose sets have the similarity. Only texts that are in a pair are compared.
    source: id and text, each id once; rows: their counts."""
    pairs = cut(possible(pairs, rows, similarity))
    wanted = _ids(pairs)
    schema = T.StructType([source.schema["id"], T.StructField("set", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sets in _slices(batches, 1, size):
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(sets)], names=schema.names)

    sets = written(with_ids(source, wanted).select("id", "text").mapInArrow(run, schema))
    both = _sides(pairs, sets, "set")
    shared = F.size(F.array_intersect("set_a", "set_b"))
    return cut(both.where(shared >= similarity * (F.size("set_a") + F.size("set_b") - shared) - 1e-9).select("a", "b"))


def fingerprint_pairs(sets: DataFrame, distance: int) -> DataFrame:
    """Pairs (a, b) of ids whose SimHashes are within the distance. sets: id and fingerprint of distinct sets.

    A fingerprint stands for its smallest id, to which its other ids are paired."""
    prints = cut(sets.groupBy("fingerprint").agg(F.min("id").alias("least")))
    side = lambda name: prints.select(F.col("fingerprint").alias(name), F.col("least").alias(f"least_{name}"))
    near = candidates(prints, distance).join(side("a"), "a").join(side("b"), "b").select(F.least("least_a", "least_b").alias("a"), F.greatest("least_a", "least_b").alias("b"))
    same = sets.join(prints, "fingerprint").where("id <> least").select(F.col("least").alias("a"), F.col("id").alias("b"))
    return near.unionByName(same)


def apart(pairs: DataFrame, label: DataFrame) -> DataFrame:
    """Of the pairs (a, b) those that no component holds both ends of. label: node and label, as components() gives them."""
    own = lambda side: label.select(F.col("node").alias(side), F.col("label").alias(f"label_{side}"))
    both = pairs.join(own("a"), "a", "left").join(own("b"), "b", "left")
    return both.where(F.coalesce("label_a", "a") != F.coalesce("label_b", "b")).select("a", "b")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8, distance: int = 6) -> DataFrame:
    """Id and component_id, the smallest id reachable over pairs of the similarity, of each row that has an id."""
    source = docs.where(F.col(id_column).isNotNull()).select(F.col(id_column).alias("id"), F.lower(F.col(text)).alias("text"))
    if source.groupBy("id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").limit(1).count():
        source = written(source.dropDuplicates(["id"]))
    rows = written(with_prefixes(source, shingle, similarity))
    copies = cut(rows.groupBy("one", "two", "n").agg(F.min("id").alias("least"), F.min("fingerprint").alias("fingerprint")))
    links = verified(fingerprint_pairs(copies.select(F.col("least").alias("id"), "fingerprint"), distance), rows, source, shingle, similarity)
    label = components(links)
    met = rows.join(copies.select(F.col("least").alias("id")), "id", "left_semi").select("id", "n", F.explode("first").alias("token"))
    shared = met.groupBy("token").agg(F.count(F.lit(1)).alias("sets")).where("sets > 1")
    met = written(met.join(shared, "token"))
    involved = cut(met.select("id").distinct())
    if involved.count() > BROADCAST_IDS:
        # Texts are shuffled once here, and only those that share a shingle in each verification.
        source = written(with_ids(source, involved))
    side = lambda df, name: df.select("token", *[F.col(c).alias(f"{c}_{name}") for c in df.columns if c != "token"])
    fits = F.least("n_a", "n_b") >= similarity * F.greatest("n_a", "n_b") - 1e-9
    pair = lambda df: df.where(fits).select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).distinct()
    few, many = met.where(F.col("sets") <= FEW).select("token", "id", "n"), met.where(F.col("sets") > FEW).select("token", "id", "n")
    new = verified(apart(pair(side(few, "a").join(side(few, "b"), "token").where("id_a < id_b")), label), rows, source, shingle, similarity)
    if new.limit(1).count():
        links = cut(links.unionByName(new))
        label = components(links)
    for k in range(ROUNDS + 1) if many.limit(1).count() else ():
        at = cut(many.join(label.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("label", "id")))
        # What is of one component at its shingle needs nothing more.
        open_ = at.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min(F.struct(F.xxhash64("id", F.lit(k)).alias("h"), "id", "n", "label")).alias("hub")).where("low <> high")
        if k < ROUNDS:
            hub = open_.select("token", F.col("hub.id").alias("id_a"), F.col("hub.n").alias("n_a"), F.col("hub.label").alias("label_a"))
            found = side(at, "b").join(hub, "token").where("label_a <> label_b")
        else:
            left = at.join(open_.select("token"), "token", "left_semi")
            found = side(left, "a").join(side(left, "b"), "token").where("id_a < id_b AND label_a <> label_b")
        new = verified(pair(found), rows, source, shingle, similarity)
        if new.limit(1).count():
            links = cut(links.unionByName(new))
            label = components(links)
    label = label.select(F.col("node").alias("least"), "label")
    named = copies.join(label, "least", "left").select("one", "two", "n", F.coalesce("label", "least").alias("component_id"))
    return rows.select("id", "one", "two", "n").join(named, ["one", "two", "n"]).select(F.col("id").alias(id_column), "component_id")
