"""Phrase collocations: phrases of two and more words that stand together more often than their parts apart.

Words are counted per language within pieces of text. Each shard (some texts of one Arrow batch) becomes an array of word
ids; prefix doubling in numpy sorts its suffixes by their first words, and the intervals of the longest common prefixes
of neighbours in that order are its n-grams with their counts. Spark sums the counts of all shards by language and phrase.

A phrase is as rare as its rarest part at least. A first pass counts words, pairs and triples by their hash alone (12
bytes a row); in the second, the words below the least count are left out, the pairs below it end phrases as piece ends
do, and no phrase holds a triple below it, so that hardly any rare phrase is spelled out and shuffled. The first pass
comes to the tasks as a bitmap of hashes of a fixed size (BITMAP_BITS, 16 MB): what it lets through by chance costs rows
in the shuffle and changes no count. Once the parts of the least count come near BITMAP_BITS in number, it lets most
through.

Sums, scores and the choice of phrases are DataFrame functions. Phrases meet their parts in plain joins by language and
phrase, of rows that each have the least count; counts and products are decimals, so no product overflows.

Memory of a task: an Arrow batch, the bitmap, and the arrays of SHARD_BYTES of texts (a longer text is a shard by itself,
sorted in blocks of BLOCK words). Null texts are empty; null languages are `und`. Repeated rows count each time. Equal scores and
counts rank by the phrase's UTF-8 bytes. Without texts there are no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import table, written
from .tokens import mix64

LONGEST, AT_LEAST, FIRST = 4, 30, 2_000
#: A phrase goes if it lies in a longer one that has this percent of its count or more.
WITHIN = 80
SCALE = 2_000_000
PIECE_ENDS, SPACES = b".,;:!?\n\x0b\x0c\r", b" \t"
SHARD_BYTES, BLOCK = 1 << 22, 1 << 19
BITMAP_BITS, _BITS_EACH = 1 << 27, 1 << 15
NONE = "und"
COUNTS, KEYS = "lang string, phrase string, words int, f long", "key long, f long"

# Piece ends become a byte that no UTF-8 text holds, A-Z become a-z.
_MARK = 255
_BYTES = np.arange(256, dtype=np.uint8)
_BYTES[65:91] += 32
_BYTES[list(PIECE_ENDS)] = _MARK
_BYTES[list(SPACES)] = 32


def word_ids(data: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct words, each word's index there, where it begins, and whether a piece begins with it."""
    b = _BYTES[np.frombuffer(data, dtype=np.uint8)]
    mark = b == _MARK
    gap = mark | (b == 32)
    edge = np.flatnonzero(np.diff(np.concatenate(([True], gap, [True])).view(np.int8)))
    starts, stops = edge[0::2], edge[1::2]
    letters = np.ascontiguousarray(b[~gap])
    offsets = np.concatenate(([0], np.cumsum(stops - starts))).astype(np.int64)
    every = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(letters)).dictionary_encode()
    piece = np.cumsum(mark, dtype=np.int32)[starts]
    return every.dictionary, every.indices.to_numpy().astype(np.int64), starts, np.diff(piece, prepend=-1) > 0


def until(stop: np.ndarray) -> np.ndarray:
    """For each place how far the next stop is."""
    place = np.arange(len(stop), dtype=np.int32)
    ends = np.where(stop, place, np.int32(len(stop)))
    return np.minimum.accumulate(ends[::-1])[::-1] - place


def intervals(ids: np.ndarray, longest: int, triples: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each n from 2 to longest: a place of each distinct n-gram, and how often it stands in ids. Zeros end phrases.

    The last longest - 1 ids only continue phrases that begin before them. triples: where phrases may hold three ids."""
    size = len(ids) - longest + 1
    padded = np.concatenate((ids, np.zeros(2 * longest, dtype=np.int64)))
    room = np.minimum(until(padded == 0), longest)
    if triples is not None:
        room[: len(ids)] = np.minimum(room[: len(ids)], until(~triples) + 2)
    ranks, h = {1: padded}, 1
    while h < longest:
        low = ranks[h]
        key = low * (int(low.max()) + 1)
        key[:-h] += low[h:]
        # Suffixes that end here are told apart by their room alone.
        key[room <= h] = low[room <= h] * (int(low.max()) + 1)
        h *= 2
        ranks[h] = np.unique(key, return_inverse=True)[1].astype(np.int64) if h < longest else key
    places = np.flatnonzero(room[:size] > 1)
    order = places[np.argsort(ranks[h][places])]
    if not len(order):
        return
    a, b = order[:-1], order[1:]
    common = np.zeros(len(a), dtype=np.int32)
    for step in sorted(ranks, reverse=True):
        same = ranks[step][a + common] == ranks[step][b + common]
        common += np.where(same & (common + step <= longest), step, 0).astype(np.int32)
    common = np.minimum(np.minimum(common, room[a]), room[b])
    for n in range(2, longest + 1):
        heads = np.flatnonzero(np.concatenate(([True], common < n)))
        sizes = np.diff(heads, append=len(order))
        enough = room[order[heads]] >= n
        yield n, order[heads[enough]], sizes[enough]


class Shard:
    """Texts as ids of (language, word), from one on, with the hash of each."""

    def __init__(self, langs: list[str], texts: list[bytes]) -> None:
        words, index, starts, self.begins = word_ids(b"\n".join(texts))
        first = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
        names = sorted(set(langs))
        code = {name: k for k, name in enumerate(names)}
        lang = np.array([code[x] for x in langs])[np.searchsorted(first, starts, side="right") - 1]
        ids, pairs = pd.factorize(lang * max(len(words), 1) + index)
        self.ids = ids.astype(np.int64) + 1
        self.lang, self.word = pa.array(names).take(pairs // max(len(words), 1)), words.take(pairs % max(len(words), 1))
        self.counts = np.bincount(self.ids, minlength=len(pairs) + 1)[1:]
        self.totals = pa.array(names), np.bincount(lang, minlength=len(names))
        seeds = {name: xxhash.xxh64_intdigest(name.encode(), 42) for name in names}
        self.hash = np.array([0, *(xxhash.xxh64_intdigest(w, seeds[x]) for w, x in zip(self.word.to_pylist(), self.lang.to_pylist(), strict=True))], dtype=np.uint64)
        # Whether a word continues the piece of the one before.
        self.joined = ~self.begins

    def hashes(self, *ids: np.ndarray) -> np.ndarray:
        """Of the phrases of the ids side by side."""
        out = self.hash[ids[0]]
        for x in ids[1:]:
            out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + self.hash[x])
        return out

    def keep(self, bitmap: np.ndarray) -> None:
        """Leaves out rare words, and parts rare pairs."""
        good = _has(bitmap, self.hash)
        good[0] = False
        at = np.flatnonzero(self.joined)
        self.joined[at] = _has(bitmap, self.hashes(self.ids[at - 1], self.ids[at])) & good[self.ids[at]] & good[self.ids[at - 1]]
        self.counts = np.where(good[1:], self.counts, 0)

    def blocks(self, longest: int) -> Iterator[np.ndarray]:
        """Ids of the words that have a neighbour, with zeros between phrases, in pieces that overlap by longest - 1."""
        part = self.joined.copy()
        part[:-1] |= self.joined[1:]
        ids, joined = self.ids[part], self.joined[part]
        if len(ids):
            at = np.arange(len(ids)) + np.cumsum(~joined)
            line = np.zeros(int(at[-1]) + longest, dtype=np.int64)
            line[at] = ids
            for k in range(0, len(line) - longest + 1, BLOCK):
                yield line[k : k + BLOCK + longest - 1]

    def keys(self) -> Iterator[pa.RecordBatch]:
        """Counts of words, pairs and triples by hash."""
        yield _batch(KEYS, self.hash[1:].view(np.int64), self.counts)
        for block in self.blocks(3):
            for n, places, f in intervals(block, 3):
                yield _batch(KEYS, self.hashes(*(block[places + i] for i in range(n))).view(np.int64), f)

    def triples(self, block: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
        """Where three ids begin that the bitmap has."""
        out = np.zeros(len(block), dtype=bool)
        at = np.flatnonzero(until(block == 0)[:-2] > 2)
        out[at] = _has(bitmap, self.hashes(block[at], block[at + 1], block[at + 2]))
        return out

    def phrases(self, longest: int, bitmap: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        """Counts of words and phrases; with zero words, of all words of a language."""
        names, totals = self.totals
        yield _batch(COUNTS, names, pa.array([""] * len(names)), np.zeros(len(names), np.int32), totals)
        kept = np.flatnonzero(self.counts)
        yield _batch(COUNTS, self.lang.take(kept), self.word.take(kept), np.ones(len(kept), np.int32), self.counts[kept])
        for block in self.blocks(longest):
            for n, places, f in intervals(block, longest, None if bitmap is None else self.triples(block, bitmap)):
                parts = [self.word.take(block[places + i] - 1) for i in range(n)]
                phrase = pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string()))
                yield _batch(COUNTS, self.lang.take(block[places] - 1), phrase, np.full(len(f), n, np.int32), f)


def _has(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & np.uint64(BITMAP_BITS - 1)
    return (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _batch(schema: str, *columns: pa.Array | np.ndarray) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([(c if isinstance(c, pa.Array) else pa.array(c)).cast(kinds[kind]) for c, (_, kind) in zip(columns, fields, strict=True)], names=[name for name, _ in fields])


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[Shard]:
    for batch in batches:
        langs, texts, size = [], [], 0
        for of, value in zip(batch.column(0), batch.column(1), strict=True):
            data = value.as_buffer().to_pybytes()
            if texts and size + len(data) > SHARD_BYTES:
                yield Shard(langs, texts)
                langs, texts, size = [], [], 0
            langs.append(of.as_py())
            texts.append(data)
            size += len(data)
        if texts:
            yield Shard(langs, texts)


def _rows(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(NONE)).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def key_counts(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """key, f: counts of words, pairs and triples by hash. Two of the same hash are counted together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches):
            yield from shard.keys()

    return _rows(docs, text, lang).mapInArrow(run, KEYS).groupBy("key").agg(F.sum("f").alias("f"))


def counts(docs: DataFrame, longest: int, bitmap: bytes | None = None, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, phrase, words, f of all phrases of up to longest words; with zero words each language's number of words.
    bitmap: as bitmap_of() gives it, to pass over the words, pairs and triples that it lacks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if bitmap is None else np.frombuffer(bitmap, dtype=np.uint8)
        for shard in _shards(batches):
            if known is not None:
                shard.keep(known)
            yield from shard.phrases(longest, known)

    return _rows(docs, text, lang).mapInArrow(run, COUNTS).groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f"))


def bitmap_of(keys: DataFrame) -> bytes:
    """Bits at the low bits of each key; comes to the driver as BITMAP_BITS bits at most."""
    at = F.col("key").bitwiseAND(F.lit(BITMAP_BITS - 1)) + 1
    parts = keys.groupBy(F.bitmap_bucket_number(at).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    out = np.zeros((BITMAP_BITS // _BITS_EACH, _BITS_EACH // 8), dtype=np.uint8)
    for part, bits in parts.collect():
        out[part - 1] = np.frombuffer(bits, dtype=np.uint8)
    return out.tobytes()


def frequent(docs: DataFrame, longest: int = LONGEST, at_least: int = AT_LEAST, text: str = "text", lang: str = "lang") -> DataFrame:
    """As counts(), of the phrases that stand at_least times or more."""
    enough = F.col("f") >= at_least
    bitmap = bitmap_of(key_counts(docs, text, lang).where(enough))
    return written(counts(docs, longest, bitmap, text, lang).where((F.col("words") == 0) | enough))


def _part(phrase: Column, first: Column, size: Column) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), first, size), " ")


def scored(phrases: DataFrame) -> DataFrame:
    """Phrases of two words and more, with l, r and score of their lowest-scoring cut. phrases: as frequent() gives them."""
    cuts = phrases.where("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    halves = cuts.select("*", _part(F.col("phrase"), F.lit(1), F.col("k")).alias("left"), _part(F.col("phrase"), F.col("k") + 1, F.col("words")).alias("right"))
    side = lambda name, f: phrases.where("words > 0").select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    both = halves.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"])
    score = F.expr(f"(CAST(a AS DECIMAL(19, 0)) * {SCALE}) DIV (CAST(l AS DECIMAL(19, 0)) + CAST(r AS DECIMAL(19, 0)))")
    best = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("c")
    return both.groupBy("lang", "phrase", "words", "a").agg(best).select("lang", "phrase", "words", "a", "c.l", "c.r", "c.score")


def contained(phrases: DataFrame) -> DataFrame:
    """lang, phrase, longer: the highest count of the longer phrases that each phrase of two words or more lies in."""
    sizes = F.sequence(F.lit(2), F.col("words") - 1)
    inner = F.flatten(F.transform(sizes, lambda n: F.transform(F.sequence(F.lit(1), F.col("words") - n + 1), lambda i: _part(F.col("phrase"), i, n))))
    return phrases.where("words > 2").select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))


def collocations(docs: DataFrame, longest: int = LONGEST, at_least: int = AT_LEAST, within: int = WITHIN, text: str = "text", lang: str = "lang") -> DataFrame:
    """All phrases of two to longest words that no longer one replaces: lang, phrase, words, a, l, r, score, and n."""
    phrases = frequent(docs, longest, at_least, text, lang)
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    replaced = F.coalesce(exact("longer") * 100 >= exact("a") * within, F.lit(False))
    kept = scored(phrases).join(contained(phrases), ["lang", "phrase"], "left").where(~replaced).drop("longer")
    return kept.join(phrases.where("words = 0").select("lang", F.col("f").alias("n")), "lang")


def top(phrases: DataFrame, first: int = FIRST) -> DataFrame:
    """The first phrases of each language, ranked."""
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return phrases.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= first)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: all documents; the first 2,000 phrases of each language."""
    docs = table(spark, sf_dir, "documents").select("lang", "text")
    return top(collocations(docs)).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE = rf"""
WITH t AS (SELECT row_number() OVER () AS id, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(x, '[.,;:!?\x0A-\x0D]')) AS piece FROM t),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda y: y <> '') AS w FROM p),
s AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
g AS (SELECT lang, d, array_to_string(w[i : i + d - 1], ' ') AS phrase
      FROM (SELECT lang, w, d, unnest(range(1, len(w) - d + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS d) WHERE len(w) >= d)),
f AS (SELECT lang, d, phrase, string_split(phrase, ' ') AS w, count(*) AS f FROM g GROUP BY lang, d, phrase HAVING count(*) >= {AT_LEAST}),
c AS (SELECT lang, d, phrase, f AS a, k, array_to_string(w[1 : k], ' ') AS p, array_to_string(w[k + 1 :], ' ') AS q FROM (SELECT *, unnest(range(1, d)) AS k FROM f WHERE d > 1)),
j AS (SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r, ({SCALE}::HUGEINT * c.a) // (x.f + y.f) AS score
      FROM c JOIN f x ON x.lang = c.lang AND x.phrase = c.p JOIN f y ON y.lang = c.lang AND y.phrase = c.q),
b AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (SELECT lang, f, array_to_string(w[k : k + m - 1], ' ') AS phrase
      FROM (SELECT lang, f, w, m, unnest(range(1, d - m + 2)) AS k FROM f, (SELECT unnest([2, 3]) AS m) WHERE d > m)),
o AS (SELECT lang, phrase, max(f) AS longer FROM i GROUP BY lang, phrase),
k AS (SELECT b.* FROM b LEFT JOIN o ON o.lang = b.lang AND o.phrase = b.phrase WHERE longer IS NULL OR 100::HUGEINT * longer < {WITHIN}::HUGEINT * a),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM k)
SELECT r.lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM r JOIN s ON s.lang = r.lang WHERE rank <= {FIRST}
"""
