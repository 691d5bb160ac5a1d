"""Mixing sources to target weights by a low-discrepancy schedule.

Each source's documents are put into an order shuffled by md5 of their id and laid end to end on a line of
tokens, which is cut into blocks of equal size (to one token). A schedule of slots takes golden-ratio points
through the sources' cumulative weights; a slot's rank within its source names the block that it takes, so a
prefix of the schedule is close to the weights too. What a document gives is the overlap of its span of the line
with the blocks, as often as they are taken (at most twice, as targets stop at twice the source).

Only DataFrame functions. Ranks and running sums are taken in two levels (within pieces, then over the pieces'
totals), so no task holds a whole source. Blocks and documents meet on (source, block), which no hot source can
skew. The table of sources is broadcast only if it is counted to be small; only two sums come to the driver.

Null and empty texts have size 0 and give nothing. Null sources form one source, the last. Rows that repeat an id
are separate rows; among rows of equal id, size and source it does not matter which one comes first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, shuffle_partitions, table

WEIGHTS = (3, 1, 2)
#: Tokens of the mix for each hundred tokens of the input.
SHARE_PERCENT = 150
MOST_REPEATS = 2
BLOCK_TOKENS = 32
#: Slots ranked together, and hex digits of md5 that name a piece of a source.
CHUNK, PIECE_DIGITS = 16384, 3
#: The golden ratio times 2**31, made odd; points are multiples of it modulo 2**31.
GOLDEN, POINTS = 1327217885, 1 << 31
#: Points are matched with the sources' intervals by cells of so many points.
CELL = 1 << 19
#: With more sources than these, their table is joined and not broadcast.
BROADCAST_SOURCES = 100_000


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share_percent: int = SHARE_PERCENT, most: int = MOST_REPEATS) -> DataFrame:
    """Adds source_id and target to rows of (source, source_size): shares by weight, each at most `most` times its size,
    the excess going to the others by weight (found in one pass, in the order in which sources reach their limit)."""
    every = W.partitionBy()
    ranked = (
        sources.withColumn("source_id", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
        .withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("source_id") % len(weights) + 1).cast("int")).cast("long"))
        .withColumn("most", F.col("source_size") * most)
        .withColumn("full_at", F.col("most") / F.col("weight"))
        .withColumn("wanted", F.sum("source_size").over(every) * (share_percent / 100.0))
    )
    order = W.orderBy("full_at", "source_id")
    level = (
        ranked.withColumn("spent", F.coalesce(F.sum("most").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("left", F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("level", (F.col("wanted") - F.col("spent")) / F.col("left"))
    )
    chosen = F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "source_id", "level"))).over(every)["level"]
    return level.withColumn("target", F.least(F.col("most").cast("double"), F.coalesce(chosen, F.lit(0.0)) * F.col("weight"))).select("source", "source_id", "source_size", "target")


def schedule(spark: SparkSession, sources: DataFrame, n_slots: int) -> DataFrame:
    """Slots in the order of the schedule: slot, source_id, rank within the source. sources: source_id, slots (how many are wanted)."""
    before = F.coalesce(F.sum("slots").over(W.orderBy("source_id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    total = F.sum("slots").over(W.partitionBy())
    edge = lambda x: F.floor(F.least(x / total, F.lit(1.0)) * POINTS).cast("long")
    last = F.max("source_id").over(W.partitionBy())
    parts = sources.select("source_id", edge(before).alias("low"), F.when(F.col("source_id") == last, F.lit(POINTS).cast("long")).otherwise(edge(before + F.col("slots"))).alias("high")).where("high > low")
    cells = parts.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") / CELL), F.floor((F.col("high") - 1) / CELL))))
    point = F.pmod(F.col("slot") % POINTS * GOLDEN, F.lit(POINTS))
    slots = spark.range(0, n_slots, 1, max(shuffle_partitions(spark), n_slots // 2_000_000)).select(F.col("id").alias("slot")).withColumn("point", point).withColumn("cell", F.floor(F.col("point") / CELL))
    placed = slots.join(cells, "cell").where("point >= low AND point < high").select("slot", "source_id", F.floor(F.col("slot") / CHUNK).alias("chunk"))
    in_chunk = placed.withColumn("k", F.row_number().over(W.partitionBy("chunk", "source_id").orderBy("slot")) - 1)
    counts = placed.groupBy("chunk", "source_id").agg(F.count(F.lit(1)).alias("n"))
    ahead = counts.withColumn("ahead", F.coalesce(F.sum("n").over(W.partitionBy("source_id").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")
    return in_chunk.join(ahead, ["chunk", "source_id"]).select("slot", "source_id", (F.col("k") + F.col("ahead")).alias("rank"))


def _begin(block: Column) -> Column:
    """The first token of a block: the first `longer` blocks have one token more than the others."""
    return block * F.col("short") + F.least(block, F.col("longer"))


def _block_of(token: Column) -> Column:
    head = F.col("longer") * (F.col("short") + 1)
    return F.when(token < head, F.floor(token / (F.col("short") + 1))).otherwise(F.col("longer") + F.floor((token - head) / F.greatest(F.col("short"), F.lit(1)))).cast("long")


def mix(docs: DataFrame, id_column: str = "doc_id", source: str = "source", text: str = "text", block_tokens: int = BLOCK_TOKENS, **how) -> DataFrame:
    """Id, size, source_size, target and taken for each document. how: as targets() takes it."""
    spark = docs.sparkSession
    size = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    key = F.md5(F.coalesce(F.col(id_column).cast("string"), F.lit("")))
    base = cut(docs.select(F.col(id_column).alias("id"), F.col(source).cast("string").alias("source"), size.alias("size"), key.alias("key")))
    n_sources = base.select("source").distinct().count()
    near = (lambda df: F.broadcast(df)) if n_sources <= BROADCAST_SOURCES else (lambda df: df)
    sources = (
        targets(base.groupBy("source").agg(F.sum("size").alias("source_size")), **how)
        .withColumn("blocks", F.greatest(F.lit(1), F.round(F.col("source_size") / block_tokens)).cast("long"))
        .withColumn("short", F.floor(F.col("source_size") / F.col("blocks")))
        .withColumn("longer", F.col("source_size") % F.col("blocks"))
        .withColumn("slots", F.when(F.col("source_size") > 0, F.col("target") * F.col("blocks") / F.col("source_size")).otherwise(0.0))
    )
    sources = cut(sources)
    n_slots = round(sources.agg(F.sum("slots")).first()[0] or 0)

    slots = schedule(spark, sources.select("source_id", "slots"), n_slots)
    most = how.get("most", MOST_REPEATS)
    taken = (
        slots.join(near(sources.select("source_id", "blocks")), "source_id")
        .where(F.col("rank") < F.col("blocks") * most)
        .groupBy("source_id", (F.col("rank") % F.col("blocks")).alias("block"))
        .agg(F.count(F.lit(1)).alias("times"))
    )

    own = base.join(near(sources), base["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    own = own.withColumn("piece", F.substring("key", 1, PIECE_DIGITS))
    sums = own.groupBy("source_id", "piece").agg(F.sum("size").alias("n"))
    ahead = sums.withColumn("ahead", F.coalesce(F.sum("n").over(W.partitionBy("source_id").orderBy("piece").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")
    within = W.partitionBy("source_id", "piece").orderBy("key", "id", "size").rowsBetween(W.unboundedPreceding, -1)
    line = own.withColumn("in_piece", F.coalesce(F.sum("size").over(within), F.lit(0))).join(ahead, ["source_id", "piece"]).withColumn("start", F.col("in_piece") + F.col("ahead"))
    some = line.where("size > 0").withColumn("block", F.explode(F.sequence(_block_of(F.col("start")), _block_of(F.col("start") + F.col("size") - 1))))
    overlap = F.least(F.col("start") + F.col("size"), _begin(F.col("block") + 1)) - F.greatest(F.col("start"), _begin(F.col("block")))
    columns = ["id", "size", "source_size", "target"]
    given = some.withColumn("overlap", overlap).select("source_id", "block", "start", "overlap", *columns).join(taken, ["source_id", "block"], "left")
    got = given.groupBy("source_id", "start", *columns).agg(F.sum(F.col("overlap") * F.coalesce("times", F.lit(0))).alias("taken"))
    none = own.where("size = 0").select(*columns, F.lit(0).cast("long").alias("taken"))
    return got.select(*columns, "taken").unionByName(none).withColumnRenamed("id", id_column)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: the mix of all documents."""
    return mix(table(spark, sf_dir, "documents"))


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k,
                  CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS ss FROM d GROUP BY source),
s1 AS (SELECT *, CAST(row_number() OVER (ORDER BY source NULLS LAST) - 1 AS BIGINT) AS sid FROM s0),
s2 AS (SELECT *, CAST([3, 1, 2][1 + sid % 3] AS BIGINT) AS w, CAST(2 * ss AS DOUBLE) AS most, CAST(sum(ss) OVER () AS DOUBLE) * 1.5 AS wanted FROM s1),
s3 AS (SELECT *, most / w AS full_at FROM s2),
s4 AS (SELECT *, (wanted - coalesce(sum(most) OVER (ORDER BY full_at, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                 / CAST(sum(w) OVER (ORDER BY full_at, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS lv FROM s3),
lv AS (SELECT arg_min(lv, full_at) AS lv FROM s4 WHERE lv <= full_at),
s5 AS (SELECT source, sid, ss, least(most, (SELECT lv FROM lv) * w) AS target, CAST(greatest(1, round(ss / {BLOCK_TOKENS})) AS BIGINT) AS nb FROM s4),
s6 AS (SELECT *, ss // nb AS short, ss % nb AS longer, CASE WHEN ss > 0 THEN target * nb / ss ELSE 0.0 END AS slots FROM s5),
tot AS (SELECT sum(slots) AS t, CAST(round(sum(slots)) AS BIGINT) AS n, max(sid) AS last FROM s6),
e AS (SELECT sid, nb, CAST(floor(least((coalesce(sum(slots) OVER (ORDER BY sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) / t, 1.0) * {POINTS}) AS BIGINT) AS lo,
             CASE WHEN sid = last THEN {POINTS} ELSE CAST(floor(least((sum(slots) OVER (ORDER BY sid ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) / t, 1.0) * {POINTS}) AS BIGINT) END AS hi FROM s6, tot),
p AS (SELECT i, (i % {POINTS} * {GOLDEN}) % {POINTS} AS x FROM range((SELECT n FROM tot)) AS g(i)),
q AS (SELECT sid, nb, row_number() OVER (PARTITION BY sid ORDER BY i) - 1 AS k FROM p JOIN e ON x >= lo AND x < hi),
tk AS (SELECT sid, k % nb AS b, count(*) AS times FROM q WHERE k < 2 * nb GROUP BY ALL),
l AS (SELECT d.r, d.size, s6.*, CAST(coalesce(sum(d.size) OVER (PARTITION BY sid ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS st
      FROM d JOIN s6 ON d.source IS NOT DISTINCT FROM s6.source),
bl AS (SELECT sid, b, times, b * short + least(b, longer) AS b0, (b + 1) * short + least(b + 1, longer) AS b1 FROM tk JOIN s6 USING (sid)),
g AS (SELECT l.r, sum((least(st + size, b1) - greatest(st, b0)) * times) AS taken FROM l JOIN bl ON l.sid = bl.sid AND b0 < st + size AND b1 > st GROUP BY l.r)
SELECT d.doc_id, d.size, l.ss AS source_size, l.target, CAST(coalesce(g.taken, 0) AS BIGINT) AS taken FROM d JOIN l ON d.r = l.r LEFT JOIN g ON d.r = g.r
"""
