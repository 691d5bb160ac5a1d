"""Benchmark decontamination: SimHash of item-sized windows, a multi-index Hamming search, exact verification.

Words are in lower case, accented letters too. Every document is slid over by windows as long as each benchmark item (in words). A window's SimHash is taken over
its five-word shingles and looked up in an index of the items of that length: the 64 bits are cut into blocks, and an
item within RADIUS bits must agree with the window on some block up to RADIUS // blocks bits, so probing each block
with all such flips finds every item within the radius. The candidates found are verified by the exact weighted
Jaccard similarity of the shingles (weights: how often a shingle stands in the window and in the item).

A window whose similarity to an item of its length can reach the threshold holds at least threshold * (its shingles)
shingles that stand in such items; the windows without are passed over before their SimHash is taken. That condition is
necessary, so nothing is lost by it; with every=True all windows go to the index, with the same result.
A text shorter than an item is one window as it is. Of windows of equal similarity the first counts.

Documents are scanned once and never shuffled; copies, hot sources and passages that many documents share cost
their own scan only. The index goes to the executors in blocks of at most BLOCK_ITEMS items (a proven bound), and
the documents are scanned for each block. Items of equal words form one class, named by the smallest id.

Null or empty texts match nothing; items without words are left out. Items of fewer words than a shingle are one
shingle, their whole sequence. Rows that repeat an id get equal results.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table, words
from .simhash import text_bytes
from .tokens import hash_words, mix64

SHINGLE, SIMILARITY = 5, 0.8
#: Bits by which the fingerprints of a window and an item of that similarity may differ. At 0.8 they differ in 10 of
#: 64 on average, with a deviation of 3 if shingles are few.
RADIUS = 22
#: Blocks of the multi-index, eight bits each.
BLOCKS = 8
BLOCK_ITEMS = 20_000
_SALT = np.uint64(0x9E3779B97F4A7C15)


def shingles(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` word hashes: their sum with a weight for each place."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n].copy()
    for k in range(1, size):
        out *= _SALT
        out += h[k : k + n]
    return out


def simhashes(values: np.ndarray, starts: np.ndarray, count: int) -> np.ndarray:
    """The SimHash of values[s : s + count] for each start."""
    values = mix64(values)
    out = np.zeros(len(starts), np.uint64)
    for bit in range(64):
        ones = np.concatenate(([0], np.cumsum((values >> np.uint64(bit) & np.uint64(1)).astype(np.int64))))
        out |= (2 * (ones[starts + count] - ones[starts]) > count).astype(np.uint64) << np.uint64(bit)
    return out


def weighted_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two multisets of hashes."""
    va, na = np.unique(a, return_counts=True)
    vb, nb = np.unique(b, return_counts=True)
    _, ia, ib = np.intersect1d(va, vb, assume_unique=True, return_indices=True)
    both = int(np.minimum(na[ia], nb[ib]).sum())
    return both / (len(a) + len(b) - both)


class HammingIndex:
    """Finds all fingerprints within a radius: equal up to radius // blocks bits on one of the blocks."""

    def __init__(self, prints: np.ndarray, radius: int = RADIUS, blocks: int = BLOCKS):
        self.prints, self.radius, self.width = prints, radius, 64 // blocks
        most = radius // blocks
        flips = [sum(1 << b for b in c) for k in range(min(most, self.width) + 1) for c in combinations(range(self.width), k)]
        self.blocks = []
        for k in range(blocks):
            value = (prints >> np.uint64(k * self.width) & np.uint64((1 << self.width) - 1)).astype(np.int64)
            # The members of each block value, flips included: a probe is then one look-up.
            table_ = [[] for _ in range(1 << self.width)]
            for i, v in enumerate(value.tolist()):
                for f in flips:
                    table_[v ^ f].append(i)
            self.blocks.append([np.array(t, dtype=np.int64) for t in table_])

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (place in prints, place in the index) within the radius, each once."""
        pairs = []
        for k, members in enumerate(self.blocks):
            value = (prints >> np.uint64(k * self.width) & np.uint64((1 << self.width) - 1)).astype(np.int64)
            for v in np.unique(value):
                found = members[v]
                if len(found):
                    own = np.flatnonzero(value == v)
                    apart = np.bitwise_count(prints[own, None] ^ self.prints[found][None, :])
                    i, j = np.nonzero(apart <= self.radius)
                    pairs.append(np.stack((own[i], found[j])))
        if not pairs:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        both = np.unique(np.concatenate(pairs, axis=1), axis=1)
        return both[0], both[1]


class Items:
    """A block of the benchmark, by length."""

    def __init__(self, items: list[tuple[int, bytes]], shingle: int, similarity: float, radius: int):
        self.similarity, self.shingle = similarity, shingle
        by_length: dict[int, list[tuple[int, np.ndarray]]] = {}
        for i, text in items:
            h = hash_words(text)[0]
            if len(h):
                by_length.setdefault(len(h), []).append((i, shingles(h, min(shingle, len(h)))))
        self.known = {k: np.unique(np.concatenate([s for n, of in by_length.items() for _, s in of if min(shingle, n) == k])) for k in {min(shingle, n) for n in by_length}}
        #: By the upper bits of a shingle, whether any known one has them.
        self.seen = {}
        for k, known in self.known.items():
            self.seen[k] = np.zeros(1 << 20, bool)
            self.seen[k][known >> np.uint64(44)] = True
        self.lengths = []
        for n, of in sorted(by_length.items()):
            k = min(shingle, n)
            prints = np.concatenate([simhashes(s, np.zeros(1, np.int64), len(s)) for _, s in of])
            self.lengths.append((n, k, [i for i, _ in of], [s for _, s in of], HammingIndex(prints, radius), np.unique(np.concatenate([s for _, s in of]))))

    def touched(self, h: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Which of the texts, laid end to end, hold a shingle of an item. ends: where each text's words end."""
        out = np.zeros(len(ends), bool)
        for k, known in self.known.items():
            s = shingles(h, k)
            place = np.flatnonzero(self.seen[k][s >> np.uint64(44)])
            at = np.minimum(np.searchsorted(known, s[place]), len(known) - 1)
            place = place[known[at] == s[place]]
            text = np.searchsorted(ends, place, side="right")
            out[text[place + k <= ends[np.minimum(text, len(ends) - 1)]]] = True
        return np.flatnonzero(out)

    def search(self, h: np.ndarray, every: bool = False) -> list[tuple[int, int, int, int, float]]:
        """(item, first word, words, bits apart, similarity) of the best window for each item that has one.

        every: whether all windows go to the index, and not only those that hold shingles enough."""
        best: dict[int, tuple] = {}
        runs = {}
        for k, known in self.known.items():
            s = shingles(h, k)
            places = np.zeros(0, np.int64)
            if len(s):
                at = np.searchsorted(known, s)
                places = np.flatnonzero(known[np.minimum(at, len(known) - 1)] == s)
            runs[k] = (s, places)
        for n, k, ids, own, index, known in self.lengths:
            s, places = runs[k]
            # A text shorter than the item is one window.
            count = min(n - k + 1, len(s))
            needed = self.similarity * (n - k + 1) - 1e-9
            if count < needed or not (every or len(places)):
                continue
            # Of the known shingles only those count that items of this very length have.
            at = np.minimum(np.searchsorted(known, s[places]), len(known) - 1)
            hits = places[known[at] == s[places]]
            if every:
                starts = np.arange(len(s) - count + 1)
            elif len(hits) < needed:
                continue
            else:
                seen = np.zeros(len(s) + 1, np.int64)
                seen[hits + 1] = 1
                seen = np.cumsum(seen)
                starts = np.flatnonzero(seen[count:] - seen[:-count] >= needed)
            for at in range(0, len(starts), 20_000):
                some = starts[at : at + 20_000]
                low, high = int(some[0]), int(some[-1]) + count
                prints = simhashes(s[low:high], some - low, count)
                for i, j in zip(*map(np.ndarray.tolist, index.near(prints)), strict=True):
                    begin = int(some[i])
                    alike = weighted_jaccard(s[begin : begin + count], own[j])
                    if alike >= self.similarity - 1e-12:
                        row = (-alike, begin, int(np.bitwise_count(prints[i] ^ index.prints[j])))
                        if ids[j] not in best or row < best[ids[j]][0]:
                            best[ids[j]] = (row, n)
        return [(i, row[1], min(n, len(h)), row[2], -row[0]) for i, (row, n) in sorted(best.items())]


def contaminated(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text: str = "text", item_column: str = "item_id", item_text: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, radius: int = RADIUS, every: bool = False) -> DataFrame:
    """Id, item, place and length of the item's best window in the document, bits apart and similarity; no row without a match."""
    fields = {f.name: f for f in docs.schema.fields}
    schema = T.StructType([fields[id_column], T.StructField(item_column, T.LongType()), T.StructField("first_word", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("bits_apart", T.LongType()), T.StructField("similarity", T.DoubleType())])
    line = F.lower(F.concat_ws(" ", words(F.col(item_text))))
    classes = benchmark.select(F.col(item_column).cast("long").alias("item"), line.alias("line")).where("line <> '' AND item IS NOT NULL").groupBy("line").agg(F.min("item").alias("item"))
    n = classes.count()
    blocks = max(1, -(-n // BLOCK_ITEMS))
    source = docs.select(id_column, F.lower(F.col(text)).alias("__text"))

    def scan(items: list[tuple[int, bytes]]) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            wanted = Items(shared.value, shingle, similarity, radius)
            for whole in batches:
                for at in range(0, whole.num_rows, 200):
                    batch = whole.slice(at, 200)
                    texts = text_bytes(batch.column(1))
                    h, starts = hash_words(b"\n".join(texts))
                    ends = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts]))
                    own, rows = [], []
                    for i in range(len(texts)) if every else wanted.touched(h, ends).tolist():
                        for found in wanted.search(h[ends[i - 1] if i else 0 : ends[i]], every):
                            own.append(i)
                            rows.append(found)
                    columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own, pa.int64())), *[pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)]], names=schema.names)

        return source.mapInArrow(run, schema)

    def block(k: int) -> list[tuple[int, bytes]]:
        rows = classes.where(F.pmod(F.xxhash64("line"), F.lit(blocks)) == k).collect()
        return sorted((r["item"], r["line"].encode()) for r in rows)

    return reduce(DataFrame.unionByName, [scan(block(k)) for k in range(blocks)])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: all documents against the whole benchmark; a row for each document and item that it holds."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
