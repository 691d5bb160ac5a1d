"""SimHash near-duplicates through the generalised pigeonhole principle.

A text's fingerprint has a bit set where over half of its shingles' XXH64 have it set. Distinct fingerprints are
linked at a Hamming distance of at most `distance`. Their 64 bits are grouped into partitions, bits that go
together into the same one; the partitions get unequal thresholds t_i with sum(t_i + 1) = distance + 1, so that two
fingerprints within the distance are within t_i on some partition i. A dynamic program chooses the thresholds, and
the number of partitions, by the expected rows and candidates. Within t_i, both sides emit their partition's value
with up to about half of t_i bits flipped, and equal values meet in a join that also verifies the distance.

All statistics come from all fingerprints. Copies are collapsed to one fingerprint before anything is joined. If a
partition's value is shared by more than HOT_BUCKET distinct fingerprints, these are linked by a star through common
midpoints (rows in proportion to their number, no pairs); their links to others still come from the join. Neither
drops a link. Where links are verified by similarity there are no stars, as a star's links need not be alike. Components are found by label propagation; no links or fingerprints come to the driver.

Null and empty texts have the fingerprint zero and link like any other. Rows that repeat an id get equal results.
Null ids never name a component (a component of null ids only has a null id).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, table, words
from .components import components

SEED, BITS = 42, 64
HOT_BUCKET = 4096
#: Cost of a candidate pair against that of a row of a join's input.
PAIR_COST = 0.05
MOST_PARTITIONS = 6


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null counts as empty."""
    return [x or b"" for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def shingle_hashes(data: bytes, size: int) -> list[int]:
    """XXH64 of the shingles of a text's words, A-Z in lower case; of the whole sequence if it has fewer words."""
    import xxhash

    words = data.lower().split()
    if not words:
        return []
    line = b" ".join(words)
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(line, SEED)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    return [digest(line[s:e], SEED) for s, e in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)]


def majority(flat: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each text, of n[i] of the hashes (uint64, text after text), the bits set in over half of them."""
    out = np.zeros(len(n), dtype=np.uint64)
    some = np.flatnonzero(n)
    if not len(some):
        return out
    begin = np.concatenate(([0], np.cumsum(n[some])[:-1]))
    # Bits are counted in the bytes of a word, which hold at most 255 of them: sums of pieces, then of a text's pieces.
    pieces = -(-n[some] // 255)
    of = np.repeat(np.arange(len(some)), pieces)
    first = np.concatenate(([0], np.cumsum(pieces)[:-1]))
    cuts = begin[of] + (np.arange(len(of)) - first[of]) * 255
    for shift in range(8):
        sums = np.add.reduceat((flat >> np.uint64(shift)) & np.uint64(0x0101010101010101), cuts)
        counts = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        over = (2 * counts > n[some][:, None]).astype(np.uint64)
        for byte in range(8):
            out[some] |= over[:, byte] << np.uint64(8 * byte + shift)
    return out


def fingerprints_of(hashes: list[list[int]]) -> np.ndarray:
    """The fingerprint of each list of hashes, as uint64."""
    n = np.array([len(h) for h in hashes], dtype=np.int64)
    return majority(np.fromiter((x for h in hashes for x in h), dtype=np.uint64, count=int(n.sum())), n)


def with_fingerprints(docs: DataFrame, keep: tuple[str, ...], text: str = "text", shingle: int = 4) -> DataFrame:
    """The kept columns and the fingerprint, as a signed long."""
    fields = {f.name: f for f in docs.schema.fields}
    schema = T.StructType([*[fields[c] for c in keep], T.StructField("fingerprint", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                found = fingerprints_of([shingle_hashes(x, shingle) for x in text_bytes(batch.column(len(keep)))])
                yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], pa.array(found.view(np.int64))], names=schema.names)

    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(run, schema)


@dataclass(frozen=True)
class Part:
    bits: tuple[int, ...]
    threshold: int

    @property
    def mask(self) -> int:
        return sum(1 << b for b in self.bits)

    def flips(self, most: int) -> list[int]:
        return [sum(1 << b for b in chosen) for k in range(most + 1) for chosen in combinations(self.bits, k)]


def bit_statistics(prints: DataFrame) -> tuple[int, np.ndarray]:
    """The number of fingerprints, and how many have bits i and j both set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((BITS, BITS), np.int64), 0
        for batch in batches:
            h = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(h), 65536):
                ones = (h[at : at + 65536, None] >> np.arange(BITS, dtype=np.uint64) & np.uint64(1)).astype(np.float32)
                total += np.rint(ones.T @ ones).astype(np.int64)
            n += len(h)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS + 1)), pa.array(np.append(total.ravel(), n))], names=["cell", "n"])

    rows = prints.select("fingerprint").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    found = np.zeros(BITS * BITS + 1, np.int64)
    for r in rows:
        found[r["cell"]] = r["n"]
    return int(found[-1]), found[:-1].reshape(BITS, BITS)


def group_bits(n: int, both: np.ndarray, m: int) -> list[tuple[int, ...]]:
    """m groups of near-equal width, each grown from its most correlated bits."""
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd)
    left, groups = list(range(BITS)), []
    for k in range(m):
        width = len(left) // (m - k)
        sub = corr[np.ix_(left, left)] - 2 * np.eye(len(left))
        chosen = [left[int(sub.max(axis=1).argmax())]]
        while len(chosen) < width:
            rest = [b for b in left if b not in chosen]
            chosen.append(rest[int(corr[np.ix_(rest, chosen)].sum(axis=1).argmax())])
        groups.append(tuple(sorted(chosen)))
        left = [b for b in left if b not in chosen]
    return groups


def expected_within(p: np.ndarray, bits: tuple[int, ...], most: int) -> np.ndarray:
    """The chance that two fingerprints differ in at most 0..most of the bits, taking bits as independent."""
    dist = np.zeros(len(bits) + 1)
    dist[0] = 1.0
    for b in bits:
        differ = 2 * p[b] * (1 - p[b])
        dist[1:] = dist[1:] * (1 - differ) + dist[:-1] * differ
        dist[0] *= 1 - differ
    return np.cumsum(dist)[: most + 1]


def allocate(n: int, both: np.ndarray, distance: int) -> list[Part]:
    """Partitions and thresholds of the least expected cost; partitions that get no threshold are left out."""
    p = np.diag(both) / max(n, 1)
    best: tuple[float, list[Part]] | None = None
    for m in range(1, min(MOST_PARTITIONS, distance + 1) + 1):
        groups = group_bits(n, both, m)
        costs = []
        for g in groups:
            ball = [sum(comb(len(g), k) for k in range(t + 1)) for t in range(distance + 1)]
            chance = expected_within(p, g, distance)
            costs.append([0.0, *[n * (ball[(t + 1) // 2] + ball[t // 2]) + PAIR_COST * n * n / 2 * chance[t] * ball[t // 2] for t in range(distance + 1)]])
        # least[u]: the least cost of spending u units (a threshold t takes t + 1) on the groups so far
        least = {0: (0.0, ())}
        for cost in costs:
            step: dict[int, tuple[float, tuple[int, ...]]] = {}
            for used, (c, chosen) in least.items():
                for u in range(distance + 2 - used):
                    new = (c + cost[u], (*chosen, u))
                    if used + u not in step or new[0] < step[used + u][0]:
                        step[used + u] = new
            least = step
        c, chosen = least[distance + 1]
        if best is None or c < best[0]:
            best = (c, [Part(g, u - 1) for g, u in zip(groups, chosen, strict=True) if u])
    return best[1]


def _long(x: int) -> str:
    """A SQL literal of the 64 bits; Spark has no literal for the smallest long."""
    signed = x - (1 << 64) if x >> 63 else x
    return f"{signed}L" if signed != -(1 << 63) else "shiftleft(1L, 63)"


def _keys(prints: DataFrame, parts: list[Part], side: int, name: str) -> DataFrame:
    """part, key and the fingerprint under its name. side 0 flips up to half of the threshold, side 1 the rest."""
    out = []
    for i, part in enumerate(parts):
        most = part.threshold // 2 if side == 0 else (part.threshold + 1) // 2
        flips = F.expr(f"array({', '.join(map(_long, part.flips(most)))})")
        base = F.col("fingerprint").bitwiseAND(F.expr(_long(part.mask)))
        out.append(prints.select(F.col("fingerprint").alias(name), F.lit(i).alias("part"), base.alias("base"), F.explode(flips).alias("flip")).select(name, "part", F.col("base").bitwiseXOR(F.col("flip")).alias("key")))
    return reduce(DataFrame.unionByName, out)


def _apart(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _star(prints: DataFrame, distance: int) -> DataFrame:
    """Links that join all fingerprints with a common midpoint at half the (even) distance: exactly those within the distance."""
    spread = prints.select("fingerprint", F.col("fingerprint").alias("point"))
    flips = F.expr(f"array({', '.join(_long(1 << b) for b in range(BITS))}, 0L)")
    for _ in range(distance // 2):
        spread = spread.select("fingerprint", "point", F.explode(flips).alias("flip"))
        spread = spread.select("fingerprint", F.col("point").bitwiseXOR(F.col("flip")).alias("point")).distinct()
    spread = cut(spread)
    hub = cut(spread.groupBy("point").agg(F.min("fingerprint").alias("hub"), F.max("fingerprint").alias("most")).where("hub <> most").select("point", "hub"))
    return spread.join(hub, "point").where("fingerprint <> hub").select(F.col("hub").alias("a"), F.col("fingerprint").alias("b")).distinct()


def links(prints: DataFrame, distance: int = 4, every: bool = False) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints that join all those within the distance. prints: distinct, written down.

    every: all pairs within the distance and no stars, for links that are then verified one by one."""
    n, both = bit_statistics(prints)
    if n < 2:
        return prints.where("false").select(F.col("fingerprint").alias("a"), F.col("fingerprint").alias("b"))
    parts = allocate(n, both, distance)
    close = (F.col("a") < F.col("b")) & (_apart("a", "b") <= distance)
    meet = lambda x, y: _keys(x, parts, 0, "a").join(_keys(y, parts, 1, "b"), ["part", "key"]).where(close).select("a", "b")
    if every or n <= HOT_BUCKET or distance % 2:
        return meet(prints, prints).distinct()
    own = _keys(prints, [Part(p.bits, 0) for p in parts], 0, "fingerprint")
    hot_keys = cut(own.groupBy("part", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT_BUCKET).select("part", "key"))
    if not hot_keys.limit(1).count():
        return meet(prints, prints).distinct()
    hot = cut(own.join(hot_keys, ["part", "key"], "left_semi").select("fingerprint").distinct())
    cold = cut(prints.join(hot, "fingerprint", "left_anti"))
    swapped = _keys(hot, parts, 0, "b").join(_keys(cold, parts, 1, "a"), ["part", "key"]).where(_apart("a", "b") <= distance).select("a", "b")
    return meet(cold, cold).unionByName(swapped).distinct().unionByName(_star(hot, distance))


def candidates(prints: DataFrame, distance: int) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints within the distance, to be verified one by one. prints: as for links().

    All pairs, but where more than HOT_BUCKET meet at a key only those with the key's smallest: for callers that find
    what these leave unlinked by an exact way."""
    n, both = bit_statistics(prints)
    if n < 2:
        return prints.where("false").select(F.col("fingerprint").alias("a"), F.col("fingerprint").alias("b"))
    parts = allocate(n, both, distance)
    own = _keys(prints, parts, 0, "a")
    hot = cut(own.groupBy("part", "key").agg(F.count(F.lit(1)).alias("n"), F.min("a").alias("a")).where(F.col("n") > HOT_BUCKET).select("a", "part", "key"))
    some = own.join(F.broadcast(hot.select("part", "key")), ["part", "key"], "left_anti").select("a", "part", "key").unionByName(hot)
    close = (F.col("a") < F.col("b")) & (_apart("a", "b") <= distance)
    return some.join(_keys(prints, parts, 1, "b"), ["part", "key"]).where(close).select("a", "b").distinct()


def alike(pairs: DataFrame, prints: DataFrame, docs: DataFrame, id_column: str, text: str, shingle: int, similarity: float) -> DataFrame:
    """Of the links (a, b) those whose documents' sets of shingles have the similarity (Jaccard) or more.

    A fingerprint stands for its document of the smallest id; links of fingerprints that only null ids have can't be
    looked up and fall away. Only the texts of linked documents reach the comparison."""
    name = lambda side: prints.select(F.col("fingerprint").alias(side), F.col("least").alias(f"id_{side}"))
    named = cut(pairs.join(name("a"), "a").join(name("b"), "b"))
    wanted = named.select(F.explode(F.array("id_a", "id_b")).alias("__id")).where("__id IS NOT NULL").distinct()
    w = words(F.lower(F.col(text)))
    some = docs.join(wanted, docs[id_column] == wanted["__id"], "left_semi").select(F.col(id_column).alias("__id"), w.alias("w"))
    n = F.size("w")
    runs = F.when(n >= shingle, F.transform(F.sequence(F.lit(0), F.greatest(n - shingle, F.lit(0))), lambda i: F.xxhash64(*[F.col("w")[i + k] for k in range(shingle)]))).otherwise(F.array(F.xxhash64(F.concat_ws(" ", "w"))))
    sets = cut(some.select("__id", F.array_distinct(runs).alias("set")).dropDuplicates(["__id"]))
    own = lambda side: sets.select(F.col("__id").alias(f"id_{side}"), F.col("set").alias(f"set_{side}"))
    both = named.join(own("a"), "id_a").join(own("b"), "id_b")
    shared = F.size(F.array_intersect("set_a", "set_b"))
    return both.where(shared >= similarity * (F.size("set_a") + F.size("set_b") - shared) - 1e-9).select("a", "b")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text", shingle: int = 4, distance: int = 4, similarity: float | None = None) -> DataFrame:
    """Id, fingerprint (long) and component_id, the smallest id reachable, of each row.

    With a similarity, links within the distance are candidates, which the sets of shingles then verify."""
    rows = cut(with_fingerprints(docs, (id_column,), text, shingle))
    prints = cut(rows.groupBy("fingerprint").agg(F.min(id_column).alias("least")))
    near = cut(links(prints, distance, every=similarity is not None))
    found = components(near if similarity is None else cut(alike(near, prints, docs, id_column, text, shingle, similarity)))
    labelled = prints.join(found.select(F.col("node").alias("fingerprint"), "label"), "fingerprint", "left").select("fingerprint", "least", F.coalesce("label", "fingerprint").alias("label"))
    labelled = cut(labelled)
    smallest = cut(labelled.groupBy("label").agg(F.min("least").alias("component_id")))
    named = cut(labelled.join(smallest, "label").select("fingerprint", "component_id"))
    return rows.join(named, "fingerprint").select(id_column, "fingerprint", "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: all documents, words in shingles of four, links at four bits."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
