"""Secret scan with corpus-wide ownership frequency.

Candidates are found by pattern; the hash of each candidate's value is then counted by distinct repositories and
owners over the whole corpus. A value that several owners hold is a copied example; one that a single owner
holds and that looks random is taken for a live credential. Base patterns always yield their spans; the wider
patterns add a span only for a value that looks live and is not widely copied.

Only DataFrame functions. Texts are read once: the scan's narrow result is written to the shared checkpoint
folder, and only candidates (never texts) are shuffled. Counts are combined on the map side and go through
(value, owner, repository), so no task holds all rows of a value; the counts meet the candidates in a merge join, whose
skewed partitions adaptive execution splits.

Null and empty texts have no spans. Rows that repeat an id and text count once and get equal results. A null
owner is an owner of its own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, let, running_sums, table

_KEYWORD = "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"


@dataclass(frozen=True)
class Kind:
    """group: the group that holds the value; at_least: the value's least length; base: spans that always stay."""

    name: str
    pattern: str
    group: int
    at_least: int
    base: bool


#: In the order in which kinds are listed at equal starts.
KINDS: list[Kind] = [
    Kind("assign", _KEYWORD + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Kind("access", "AKIA[A-Z0-9]+", 0, 20, True),
    # A run of hex digits below the least length fails as a whole, so asking for the length in the pattern finds the same.
    Kind("hex", "[0-9a-f]{24,}", 0, 24, True),
    Kind("github", "gh[pousr]_[A-Za-z0-9]{20,}", 0, 24, False),
    Kind("slack", "xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15, False),
    Kind("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 30, False),
    Kind("upperhex", "[0-9A-F]{24,}", 0, 24, False),
]
#: A value with as many owners is widely copied.
COPIED_OWNERS = 3
#: Characters that a live-looking value has at least, each counted once.
LIVE_CHARACTERS = 8


def _spans(text: Column, kind: Kind, order: int) -> Column:
    """Structs of start, kind's order, end and value, leftmost and non-overlapping; places in code points, end exclusive."""
    whole = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(kind.group)) if kind.group else F.lit(None).cast("array<string>")
    lengths = lambda a: F.transform(a, lambda x: F.length(x).cast("long"))
    # A gap before each match, and one after the last.
    found = F.struct(whole.alias("whole"), value.alias("value"), lengths(F.split(text, kind.pattern, -1)).alias("gaps"))

    def spans(x: Column) -> Column:
        sizes = lengths(x["whole"])
        ends = running_sums(F.zip_with(F.slice(x["gaps"], F.lit(1), F.size(x["whole"])), sizes, lambda g, n: g + n))
        placed = F.zip_with(ends, x["whole"], lambda end, m: F.struct((end - F.length(m)).cast("int").alias("start"), F.lit(order).alias("kind"), end.cast("int").alias("end")))
        return F.zip_with(placed, F.coalesce(x["value"], x["whole"]), lambda s, v: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), v.alias("value")))

    full = let(found, spans)
    return F.filter(full, lambda s: F.length(s["value"]) >= kind.at_least)


_SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


def find(docs: DataFrame, id_column: str = "doc_id", owner: str = "source", text: str = "text", repository: str | None = None) -> DataFrame:
    """Id, owner, repository, text hash, and the spans of each text in the order of start and kind."""
    t = F.coalesce(F.col(text), F.lit(""))
    staged = docs.select(F.col(id_column).alias("id"), F.col(owner).cast("string").alias("owner"), F.col(repository or id_column).cast("string").alias("repository"), F.xxhash64(F.col(text)).alias("text_hash"), t.alias("text"))
    spans = [F.when(F.col("text").rlike(k.pattern), _spans(F.col("text"), k, i)).otherwise(F.array().cast(_SPAN)) for i, k in enumerate(KINDS)]
    return staged.select("id", "owner", "repository", "text_hash", F.array_sort(F.concat(*spans)).alias("spans"))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k.name) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def ownership(candidates: DataFrame) -> DataFrame:
    """value_hash, n_owners, n_repositories. Needs columns value_hash, owner, repository."""
    once = candidates.groupBy("value_hash", "owner", "repository").agg(F.lit(1).alias("one"))
    by_owner = once.groupBy("value_hash", "owner").agg(F.count(F.lit(1)).alias("n"))
    return by_owner.groupBy("value_hash").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("n").alias("n_repositories"))


def scan(docs: DataFrame, id_column: str = "doc_id", owner: str = "source", text: str = "text", repository: str | None = None) -> DataFrame:
    """Id, all kept spans of each text, and how many are copied or owner-specific."""
    found = cut(find(docs, id_column, owner, text, repository))
    each = (
        found.where(F.size("spans") > 0)
        .select("id", "text_hash", "owner", "repository", F.explode("spans").alias("s"))
        .withColumn("value_hash", F.xxhash64(F.col("s.value")))
    )
    # The counts grow with the corpus, so they are never broadcast; the join's larger side is split where a value is hot.
    counts = ownership(each).hint("merge")
    base = F.array(*[F.lit(k.base) for k in KINDS])
    live = F.size(F.array_distinct(F.split(F.col("s.value"), ""))) >= LIVE_CHARACTERS
    judged = each.join(counts, "value_hash").withColumn("copied", F.col("n_owners") >= COPIED_OWNERS).withColumn("specific", (F.col("n_owners") == 1) & live)
    kept = judged.where(base[F.col("s.kind")] | (live & ~F.col("copied")))
    span = F.struct(F.col("s.start").alias("start"), F.col("s.kind").alias("kind"), F.col("s.end").alias("end"), F.col("copied").alias("copied"), F.col("specific").alias("specific"))
    by_text = kept.groupBy(F.col("id").alias("__id"), F.col("text_hash").alias("__hash")).agg(F.array_sort(F.collect_set(span)).alias("kept"))
    out = found.join(by_text.hint("merge"), F.col("id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__hash")), "left")
    always = lambda i: F.size(F.filter("spans", lambda s: s["kind"] == i)).cast("long")
    count = lambda of: F.coalesce(F.size(F.filter("kept", lambda s: s[of])), F.lit(0)).cast("long")
    return out.select(
        F.col("id").alias(id_column),
        *[always(i).alias(f"n_{k.name}") for i, k in enumerate(KINDS) if k.base],
        F.sha2(_joined(F.filter("spans", lambda s: base[s["kind"]])), 256).alias("base_sha256"),
        F.coalesce(_joined(F.col("kept")), F.lit("")).alias("spans"),
        F.when(F.col("kept").isNull(), F.lit(0).cast("long")).otherwise(count("copied")).alias("n_copied"),
        F.when(F.col("kept").isNull(), F.lit(0).cast("long")).otherwise(count("specific")).alias("n_owner_specific"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: all documents; a document is a repository and its source the owner."""
    return scan(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    each = "\nUNION ALL\n".join(
        f"""SELECT id, owner, {i} AS kind, {quote(k.name)} AS name, {'true' if k.base else 'false'} AS base, v[j] AS value, CAST(list_sum(list_transform(g[1:j], lambda y: length(y))) + list_sum(list_transform(m[1:j], lambda y: length(y))) - length(m[j]) AS BIGINT) AS s, length(m[j]) AS n
FROM (SELECT id, owner, regexp_extract_all(x, {quote(k.pattern)}) AS m, regexp_extract_all(x, {quote(k.pattern)}, {k.group}) AS v, regexp_split_to_array(x, {quote(k.pattern)}) AS g,
             unnest(range(1, len(regexp_extract_all(x, {quote(k.pattern)})) + 1)) AS j FROM t) WHERE length(v[j]) >= {k.at_least}"""
        for i, k in enumerate(KINDS)
    )
    return f"""
WITH t AS (SELECT doc_id AS id, source AS owner, coalesce(text, '') AS x FROM documents),
c AS ({each}),
o AS (SELECT value, count(DISTINCT coalesce('=' || owner, '')) AS n_owners FROM c GROUP BY value),
j AS (SELECT c.*, n_owners >= {COPIED_OWNERS} AS copied, len(list_distinct(string_split(c.value, ''))) >= {LIVE_CHARACTERS} AS live, n_owners = 1 AS own FROM c JOIN o ON c.value = o.value),
b AS (SELECT id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
             string_agg(name || ':' || s || ':' || (s + n), ',' ORDER BY s, kind) FILTER (base) AS base,
             string_agg(name || ':' || s || ':' || (s + n), ',' ORDER BY s, kind) FILTER (base OR live AND NOT copied) AS spans,
             count(*) FILTER (copied AND base) AS n_copied, count(*) FILTER (own AND live) AS n_owner_specific FROM j GROUP BY id)
SELECT t.id AS doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_copied, 0) AS n_copied, coalesce(n_owner_specific, 0) AS n_owner_specific
FROM t LEFT JOIN b ON t.id = b.id
"""


ORACLE = _oracle()
