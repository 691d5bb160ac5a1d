"""Scoring of texts by a deleted-interpolation n-gram model.

The model mixes maximum-likelihood estimates: of a word after the word before it, of a word alone, and of any word
of the vocabulary or outside it alike. The mixture weights depend on how often the context was seen (a bucket for
each power of two) and are learned by expectation-maximisation on the held-out counts of a tenth of the training
texts, whose own counts are left out of the estimates meanwhile.

Counts are kept as sorted 64-bit hashes (48 or more bits for pairs, by the size of the corpus, so that a pair shares its
key with another with a chance of 2^-17 at most; such pairs would count as one), packed by ranges of the hash, so what is
shuffled is a few bytes for each distinct n-gram of a task and each range is a bounded task whatever the words'
frequencies. Scoring sends each block of texts' distinct n-grams to the ranges and gets their counts back in the same
order; the texts are shuffled once, by block. The number of packs is in proportion to the texts: a block sends one to
each of RADIX ranges, and where there are more ranges the packs of RADIX blocks are put together, and cut for the next
RADIX, until a range is small enough. No table of counts is ever broadcast or collected: what comes to the driver are
totals and, for each round of EM, sums for each bucket of context frequency (at most 64).

Null and empty texts have one token, the end. Rows that repeat an id are separate texts, with equal results for
equal texts. A null id counts as an empty one where it decides on the training part. Without any training text
every token is unknown; the estimates are then those of an empty vocabulary.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import cut, fold, table
from .simhash import text_bytes
from .tokens import hash_words, mix64

END, BEGIN = np.uint64(0x1D8AF066F4B7B1E5), np.uint64(0x7A3C5EE2B9D40F13)
_ODD = np.uint64(0x94D049BB133111EB)
#: Buckets of context frequency: 0, 1, 2-3, 4-7, ...
CONTEXTS = 64
#: Bytes of text in a block, and tokens after which a task packs what it has.
BLOCK_BYTES, PACK_TOKENS = 12_000_000, 3_000_000
#: Ranges of the hash are cut into 2^RADIX_BITS at each level, until one has the n-grams of at most so many bytes of text.
RADIX_BITS, RANGE_BYTES = 6, 16_000_000
ROUNDS = 12
LEAST_WEIGHT = 1e-4


def sequences(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of all texts in a row, the token before each, and how many each text has (its end counted)."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    ends = np.cumsum(sizes + 1)
    h, starts = hash_words(b"\n".join(texts))
    upto = np.searchsorted(starts, ends)
    n = np.diff(np.concatenate(([0], upto))) + 1
    last = np.cumsum(n) - 1
    tokens = np.empty(int(n.sum()), np.uint64)
    tokens[last] = END
    word = np.ones(len(tokens), bool)
    word[last] = False
    tokens[word] = h
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[np.concatenate(([0], last[:-1] + 1))] = BEGIN
    return tokens, before, n


def pair_keys(before: np.ndarray, tokens: np.ndarray, bits: int) -> np.ndarray:
    return mix64(before * _ODD + tokens) >> np.uint64(64 - bits)


def pack(values: np.ndarray) -> bytes:
    """Numbers as planes of bytes, compressed."""
    import zstandard

    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view("<u8").astype(np.uint64)


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)


def levels(size: int) -> int:
    """How many times a range is cut into RADIX ranges until the n-grams of RANGE_BYTES are left in one."""
    n = 1
    while RANGE_BYTES << (RADIX_BITS * n) < size:
        n += 1
    return n


def pair_bits(size: int) -> int:
    """Bits of a pair's key for a text of so many bytes: a pair shares its key with a chance of 2^-17 or less (up to 64 bits)."""
    return min(64, max(48, 8 * -(-(max(size, 2).bit_length() + 16) // 8)))


def split(keys: np.ndarray, bits: int, level: int) -> tuple[list[int], list[int], list[int]]:
    """The ranges of the level (from 0) that the sorted keys are in, and where the keys of each begin and end."""
    if not len(keys):
        return [], [], []
    of = keys >> np.uint64(bits - RADIX_BITS * (level + 1))
    first = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
    return of[first].astype(np.int64).tolist(), first.tolist(), [*first[1:].tolist(), len(keys)]


def _pieces(batch: pa.RecordBatch, column: int, most: int = 2_000_000) -> Iterator[tuple[int, list[bytes]]]:
    """The batch's texts in runs of about `most` bytes, each with its first row."""
    run, size, first = [], 0, 0
    for i, t in enumerate(text_bytes(batch.column(column))):
        run.append(t)
        size += len(t)
        if size >= most:
            yield first, run
            run, size, first = [], 0, i + 1
    if run:
        yield first, run


def _table(schema: T.StructType, rows: list[tuple]) -> pa.Table:
    fields = to_arrow_schema(schema)
    return pa.Table.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(fields), fields, strict=True)], names=fields.names)


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in columns.items()])


@dataclass(frozen=True)
class Scheme:
    """How n-grams are dealt out: bits of pairs' keys, levels of ranges, and packs of counts that a first merge may see."""

    pair_bits: int
    levels: int
    packs: int

    @staticmethod
    def of(size: int) -> Scheme:
        return Scheme(pair_bits(size), levels(size), -(-size // (4 * PACK_TOKENS)))

    def bits(self, order: int) -> int:
        return 64 if order == 1 else self.pair_bits

    def keys(self, before: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        return pair_keys(before, tokens, self.pair_bits)


_PACKS = _schema(range=T.LongType(), salt=T.LongType(), order=T.IntegerType(), dev=T.BooleanType(), keys=T.BinaryType(), counts=T.BinaryType())
_COUNTS = _schema(range=T.LongType(), order=T.IntegerType(), keys=T.BinaryType(), kept=T.BinaryType(), dev=T.BinaryType(), distinct=T.LongType(), total=T.LongType(), total_kept=T.LongType())
_ASKED = _schema(within=T.LongType(), asker=T.LongType(), range=T.LongType(), order=T.IntegerType(), keys=T.BinaryType())
_ANSWERED = _schema(within=T.LongType(), asker=T.LongType(), range=T.LongType(), order=T.IntegerType(), counts=T.BinaryType())


def _merged(rows: pa.Table, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, counts without the part kept for the weights, and that part's counts, of the packs of an order."""
    own = [i for i, o in enumerate(rows.column("order").to_pylist()) if o == order]
    if not own:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    k = [unpack_sorted(rows.column("keys")[i].as_py()) for i in own]
    n = np.concatenate([unpack(rows.column("counts")[i].as_py()).astype(np.int64) for i in own])
    dev = np.repeat([rows.column("dev")[i].as_py() for i in own], [len(x) for x in k])
    each = np.concatenate(k)
    by = np.argsort(each, kind="stable")
    each, n, dev = each[by], n[by], dev[by]
    first = np.flatnonzero(np.concatenate(([True], each[1:] != each[:-1])))
    return each[first], np.add.reduceat(np.where(dev, 0, n), first), np.add.reduceat(np.where(dev, n, 0), first)


def count(training: DataFrame, scheme: Scheme) -> DataFrame:
    """Packed counts: a row for each range of the last level and order. training: text, dev (whether it is kept for the weights).

    A pack is cut into RADIX packs at each level and about as many are merged before, so their number is in proportion
    to the texts (times the levels)."""

    def packed(order: int, dev: bool, keys: np.ndarray, n: np.ndarray, level: int, salt: int) -> list[tuple]:
        return [(r, salt, order, dev, pack_sorted(keys[a:b]), pack(n[a:b])) for r, a, b in zip(*split(keys, scheme.bits(order), level), strict=True)]

    def emit(held: dict[bool, list], salt: int) -> Iterator[pa.RecordBatch]:
        for dev, got in held.items():
            for order in (1, 2):
                if got:
                    keys, n = np.unique(np.concatenate([g[order - 1] for g in got]), return_counts=True)
                    yield from _table(_PACKS, packed(order, dev, keys, n, 0, salt)).to_batches()
            got.clear()

    def salts(level: int) -> int:
        return -(-scheme.packs // (1 << RADIX_BITS * level))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The same rows get the same salt if a lost task runs again.
        held, n, salt = {False: [], True: []}, 0, TaskContext.get().partitionId()
        for batch in batches:
            dev = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for kind in (False, True):
                for _, texts in _pieces(batch.filter(pa.array(dev == kind)), 0):
                    tokens, before, _ = sequences(texts)
                    held[kind].append((tokens, scheme.keys(before, tokens)))
                    n += len(tokens)
                    if n >= PACK_TOKENS:
                        yield from emit(held, salt)
                        n, salt = 0, salt + 7919
        yield from emit(held, salt)

    def hop(level: int) -> Callable[[tuple, pa.Table], pa.Table]:
        def run(key: tuple, rows: pa.Table) -> pa.Table:
            out = []
            for order in (1, 2):
                keys, kept, held = _merged(rows, order)
                for dev, n in ((False, kept), (True, held)):
                    out += packed(order, dev, keys[n > 0], n[n > 0], level, key[1].as_py())
            return _table(_PACKS, out)

        return run

    def merge(key: tuple, rows: pa.Table) -> pa.Table:
        made = []
        for order in (1, 2):
            keys, kept, held = _merged(rows, order)
            if len(keys):
                made.append((key[0].as_py(), order, pack_sorted(keys), pack(kept), pack(held), len(keys), int(kept.sum() + held.sum()), int(kept.sum())))
        return _table(_COUNTS, made)

    packs = training.select("text", "dev").mapInArrow(run, _PACKS)
    for level in range(1, scheme.levels):
        packs = packs.withColumn("salt", F.pmod("salt", F.lit(salts(level)))).groupBy("range", "salt").applyInArrow(hop(level), _PACKS)
    return packs.groupBy("range").applyInArrow(merge, _COUNTS)


def blocked(docs: DataFrame, size: int) -> DataFrame:
    """docs with their block, dealt out by it. docs: id, text and more."""
    blocks = max(-(-size // BLOCK_BYTES), 1)
    return docs.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).cast("long")).repartition(blocks, "block")


def _answers(asked: DataFrame, counts: DataFrame, scheme: Scheme, dev_too: bool, level: int) -> DataFrame:
    """The counts of each pack of keys. asked: packs by range of the level.

    At the last level the ranges meet their counts. Before it, the packs that RADIX askers have of one range are put
    together, and what they hold is asked as one, by ranges of the next level; so a pack stays about as large at every
    level, and packs are in proportion to the askers."""

    def answer(questions: pa.Table, known: pa.Table) -> pa.Table:
        have = {}
        for i, order in enumerate(known.column("order").to_pylist()):
            n = unpack(known.column("kept")[i].as_py()).astype(np.int64)
            have[order] = (unpack_sorted(known.column("keys")[i].as_py()), n + unpack(known.column("dev")[i].as_py()).astype(np.int64) if dev_too else n)
        out = []
        for order, data in zip(questions.column("order").to_pylist(), questions.column("keys"), strict=True):
            keys = unpack_sorted(data.as_py())
            mine, n = have.get(order, (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
            if len(mine):
                at = np.minimum(np.searchsorted(mine, keys), len(mine) - 1)
                out.append(pack(np.where(mine[at] == keys, n[at], 0)))
            else:
                out.append(pack(np.zeros(len(keys), np.int64)))
        return questions.drop_columns(["keys"]).append_column("counts", pa.array(out, pa.binary()))

    if level == scheme.levels - 1:
        return asked.groupBy("range").cogroup(counts.groupBy("range")).applyInArrow(answer, _ANSWERED)

    def together(rows: pa.Table) -> Iterator[tuple[int, list[int], list[np.ndarray], np.ndarray]]:
        for order in (1, 2):
            own = [i for i, o in enumerate(rows.column("order").to_pylist()) if o == order]
            if own:
                k = [unpack_sorted(rows.column("keys")[i].as_py()) for i in own]
                yield order, own, k, np.unique(np.concatenate(k))

    def ask(key: tuple, rows: pa.Table) -> pa.Table:
        out = []
        for order, _, _, keys in together(rows):
            out += [(key[0].as_py(), key[1].as_py(), r, order, pack_sorted(keys[a:b])) for r, a, b in zip(*split(keys, scheme.bits(order), level + 1), strict=True)]
        return _table(_ASKED, out)

    def reply(rows: pa.Table, found: pa.Table) -> pa.Table:
        out: list = [None] * rows.num_rows
        for order, own, k, keys in together(rows):
            n = _in_order(found, order)
            for i, asked_ in zip(own, k, strict=True):
                out[i] = pack(n[np.searchsorted(keys, asked_)])
        return rows.select(["within", "asker", "range", "order"]).append_column("counts", pa.array(out, pa.binary()))

    grouped = asked.withColumn("group", F.shiftright("asker", RADIX_BITS))
    more = _answers(grouped.groupBy("range", "group").applyInArrow(ask, _ASKED), counts, scheme, dev_too, level + 1)
    return grouped.groupBy("range", "group").cogroup(more.groupBy("within", "asker")).applyInArrow(reply, _ANSWERED)


def _in_order(found: pa.Table, order: int) -> np.ndarray:
    """The counts of all answers of an order, by range."""
    own = sorted((r, i) for i, (o, r) in enumerate(zip(found.column("order").to_pylist(), found.column("range").to_pylist(), strict=True)) if o == order)
    return np.concatenate([unpack(found.column("counts")[i].as_py()).astype(np.int64) for _, i in own])


def look_up(blocks: DataFrame, counts: DataFrame, scheme: Scheme, dev_too: bool, then: Callable[[pa.Table, tuple], pa.Table], schema: T.StructType) -> DataFrame:
    """then(a block's rows, (words' counts, places of tokens in them, pairs' counts, places)) for each block.

    dev_too: whether counts are those of all training texts, or without the part kept for the weights."""
    text = blocks.columns.index("text")
    block = blocks.columns.index("block")

    def distinct(got: list[tuple]) -> Iterator[tuple[int, np.ndarray]]:
        for order in (1, 2):
            parts = [g[order - 1] for g in got]
            yield order, np.unique(np.concatenate([*parts, np.array([END], np.uint64)] if order == 1 else parts))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            of = batch.column(block).to_numpy(zero_copy_only=False)
            for b in np.unique(of):
                for _, texts in _pieces(batch.filter(pa.array(of == b)), text):
                    tokens, before, _ = sequences(texts)
                    held.setdefault(int(b), []).append((tokens, scheme.keys(before, tokens)))
        for b, got in held.items():
            for order, keys in distinct(got):
                yield from _table(_ASKED, [(0, b, r, order, pack_sorted(keys[x:y])) for r, x, y in zip(*split(keys, scheme.bits(order), 0), strict=True)]).to_batches()
            got.clear()

    answers = _answers(blocks.mapInArrow(ask, _ASKED), counts, scheme, dev_too, 0)

    def settle(rows: pa.Table, found: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return schema_table(schema)
        got, sizes = [], []
        for batch in rows.combine_chunks().to_batches():
            for _, texts in _pieces(batch, text):
                tokens, before, n = sequences(texts)
                got.append((tokens, scheme.keys(before, tokens), before))
                sizes.append(n)
        one_, two_ = _in_order(found, 1), _in_order(found, 2)
        words_, pairs = (k for _, k in distinct(got))
        end = one_[np.searchsorted(words_, END)]
        tokens, keys, before = (np.concatenate(x) for x in zip(*got, strict=True))
        one = one_[np.searchsorted(words_, tokens)]
        # The token before a token is a word of the same text, or its beginning, seen as often as there are ends.
        context = np.concatenate(([0], one[:-1]))
        context[before == BEGIN] = end
        return then(rows, (np.concatenate(sizes), one, context, two_[np.searchsorted(pairs, keys)]))

    return blocks.groupBy("block").cogroup(answers.groupBy("asker")).applyInArrow(settle, schema)


def schema_table(schema: T.StructType) -> pa.Table:
    return to_arrow_schema(schema).empty_table()


def context_bucket(n: np.ndarray) -> np.ndarray:
    """0 for a context never seen, else 1 + the whole part of its count's logarithm to base 2."""
    return np.where(n > 0, np.floor(np.log2(np.maximum(n, 1))).astype(np.int64) + 1, 0)


@dataclass(frozen=True)
class Model:
    counts: DataFrame
    scheme: Scheme
    #: For each bucket the weights of the estimates by pair, by word and uniform.
    weights: np.ndarray
    tokens: int
    vocabulary: int


def learn_weights(cells: DataFrame, tokens: int, vocabulary: int, rounds: int = ROUNDS) -> np.ndarray:
    """EM over cells of (bucket, pair, context, word, n): how often the held-out texts have such counts."""
    weights = np.tile([0.5, 0.4, 0.1], (CONTEXTS, 1))
    two = F.when(F.col("context") > 0, F.col("pair") / F.greatest("context", F.lit(1))).otherwise(0.0)
    parts = cells.select("bucket", "n", two.alias("p0"), (F.col("word") / float(max(tokens, 1))).alias("p1"), F.lit(1.0 / (vocabulary + 1)).alias("p2"))
    for _ in range(rounds):
        of = lambda k: F.element_at(F.array(*[F.lit(float(w)) for w in weights[:, k]]), F.col("bucket") + 1)
        shares = parts.select("bucket", "n", *[(of(k) * F.col(f"p{k}")).alias(f"q{k}") for k in range(3)]).withColumn("q", F.col("q0") + F.col("q1") + F.col("q2"))
        new = weights.copy()
        for r in shares.groupBy("bucket").agg(*[F.sum(F.col("n") * F.col(f"q{k}") / F.col("q")).alias(f"s{k}") for k in range(3)]).collect():
            s = np.maximum(np.array([r["s0"], r["s1"], r["s2"]]), 0)
            new[r["bucket"]] = np.maximum(s / s.sum(), LEAST_WEIGHT)
        new /= new.sum(axis=1, keepdims=True)
        moved, weights = np.abs(new - weights).max(), new
        if moved < 1e-4:
            break
    return weights


def fit(docs: DataFrame, size: int) -> Model:
    """docs: id, text, dev of the training texts; size: their bytes, about."""
    scheme = Scheme.of(size)
    counts = cut(count(docs, scheme))
    r = counts.where("order = 1").agg(F.sum("total"), F.sum("total_kept"), F.sum("distinct")).first()
    tokens, kept, vocabulary = (int(x or 0) for x in r)
    schema = T.StructType([T.StructField(n, t) for n, t in (("bucket", T.IntegerType()), ("pair", T.LongType()), ("context", T.LongType()), ("word", T.LongType()), ("n", T.LongType()))])

    def cells(rows: pa.Table, found: tuple) -> pa.Table:
        _, one, context, two = found
        each, n = np.unique(np.stack((two, context, one)), axis=1, return_counts=True)
        return pa.Table.from_arrays([pa.array(context_bucket(each[1]), pa.int32()), *[pa.array(x, pa.int64()) for x in each], pa.array(n, pa.int64())], names=schema.names)

    dev = blocked(docs.where("dev").select("id", "text"), size // 10)
    seen = look_up(dev, counts, scheme, False, cells, schema)
    seen = cut(seen.groupBy("bucket", "pair", "context", "word").agg(F.sum("n").alias("n")))
    return Model(counts, scheme, learn_weights(seen, kept, vocabulary), tokens, vocabulary)


def score(docs: DataFrame, model: Model, size: int) -> DataFrame:
    """docs: id, text and more, which stay. Adds n_tokens, n_known, base_score and score (log10 probabilities)."""
    keep = [c for c in docs.columns if c != "text"]
    fields = {f.name: f for f in docs.schema.fields}
    schema = T.StructType([*[fields[c] for c in keep], T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])
    weights, total, vocabulary = model.weights, model.tokens, model.vocabulary

    def scored(rows: pa.Table, found: tuple) -> pa.Table:
        n, one, context, two = found
        w = weights[context_bucket(context)]
        p = w[:, 0] * np.where(context > 0, two / np.maximum(context, 1), 0.0) + w[:, 1] * one / max(total, 1) + w[:, 2] / (vocabulary + 1)
        base = np.log10((one + 0.1) / (total + 0.1 * (vocabulary + 1)))
        begin = np.concatenate(([0], np.cumsum(n)[:-1]))
        sums = [np.add.reduceat(x, begin) for x in ((one > 0).astype(np.int64), base, np.log10(p))]
        return pa.Table.from_arrays([*[rows.column(c).combine_chunks() for c in keep], pa.array(n, pa.int64()), pa.array(sums[0], pa.int64()), pa.array(sums[1]), pa.array(sums[2])], names=schema.names)

    return look_up(blocked(docs, size), model.counts, model.scheme, True, scored, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: all documents, learned from those of the folds that are not held out."""
    part = fold(F.col("doc_id"), 10)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", part.alias("part"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    model = fit(docs.where("part <> 0").select("id", "text", (F.col("part") == 1).alias("dev")), size)
    found = score(docs.select("id", "text", (F.col("part") == 0).alias("held_out")), model, size)
    return found.select(F.col("id").alias("doc_id"), "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
