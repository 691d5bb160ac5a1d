"""Quality rules as a bitmask ledger: each rule is evaluated once, its failures are bits of one long, and
policies and ablations are bitwise operations on that long.

Only DataFrame functions; a row's results depend on that row alone, so the ledger needs no shuffle whatever
the sizes of the texts, sources or groups of copies. Null and empty texts have no words and fail `few_words`;
repeated rows each get their own, equal row; columns of the input other than those asked for are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WS_CHARS, let, table, words

SYMBOLS = "#*$%&|<>"
WINDOW = 5

#: Name and failing condition over the measurements. The place in the list is the bit; append only.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 10"),
    ("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("duplicate_lines", "100 * n_dup_lines > 30 * n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 15 * n_words"),
    ("shouting", "n_words >= 10 and 2 * n_upper > word_chars"),
]
#: A policy is the rules that it enforces; a later version never changes an earlier one.
POLICIES: dict[str, list[str]] = {
    "base": ["few_words", "repeated_windows"],
    "v1": ["few_words", "repeated_windows", "symbols", "duplicate_lines", "short_words", "long_words"],
    "v2": ["few_words", "repeated_windows", "symbols", "duplicate_lines", "short_words", "long_words", "shouting"],
}


def mask(policy: str) -> int:
    bits = {name: 1 << i for i, (name, _) in enumerate(RULES)}
    return sum(bits[name] for name in POLICIES[policy])


def _repeat_words(hashes: Column) -> Column:
    """Words that lie in windows whose hash occurs again. Sorts a text's windows only if there are such."""

    def positions(s: Column) -> Column:
        n = F.size(s)
        same = lambda a, b: s[a]["h"] == s[b]["h"]
        again = F.filter(
            F.sequence(F.lit(0), n - 1),
            lambda k: F.when(k > 0, same(k, F.greatest(k - 1, F.lit(0)))).otherwise(False) | F.when(k < n - 1, same(k, F.least(k + 1, n - 1))).otherwise(False),
        )
        return F.array_sort(F.transform(again, lambda k: s[k]["i"]))

    def covered(p: Column) -> Column:
        return F.aggregate(
            F.transform(p, lambda x, k: F.when(k < F.size(p) - 1, F.least(F.lit(WINDOW), p[F.least(k + 1, F.size(p) - 1)] - x)).otherwise(WINDOW).cast("long")),
            F.lit(0).cast("long"),
            lambda acc, x: acc + x,
        )

    pairs = F.array_sort(F.transform(hashes, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    repeated = F.size(F.array_distinct(hashes)) < F.size(hashes)
    return F.when(repeated, let(let(pairs, positions), covered)).otherwise(F.lit(0).cast("long"))


def ledger(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, the measurements and `fail_bits`, a bit for each of RULES."""
    t = F.coalesce(F.col(text), F.lit(""))
    content = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, WS_CHARS, "")) > 0)
    first = docs.select(*[F.col(c) for c in keep], t.alias("__t"), words(F.col(text)).alias("__w"), F.transform(content, lambda x: F.xxhash64(x)).alias("__l"))
    n = F.size("__w")
    at = lambda i, j: F.col("__w")[i + j]
    windows = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), F.greatest(n - WINDOW, F.lit(0))), lambda i: F.xxhash64(*[at(i, j) for j in range(WINDOW)]))).otherwise(F.array().cast("array<bigint>"))
    second = first.select(
        *keep,
        n.cast("long").alias("n_words"),
        F.length(F.translate("__t", WS_CHARS, "")).cast("long").alias("word_chars"),
        (F.length("__t") - F.length(F.translate("__t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("__l").cast("long").alias("n_lines"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        (F.length("__t") - F.length(F.translate("__t", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("long").alias("n_upper"),
        windows.alias("__h"),
    )
    third = second.select(*[c for c in second.columns if c != "__h"], _repeat_words(F.col("__h")).alias("n_repeat_words"))
    bits = [F.when(F.expr(rule), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i, (_, rule) in enumerate(RULES)]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return third.withColumn("fail_bits", total)


def apply_policy(rows: DataFrame, policy: str, into: str = "kept") -> DataFrame:
    """A column that is true where none of the policy's rules failed. Reads the ledger, never the texts."""
    return rows.withColumn(into, F.col("fail_bits").bitwiseAND(F.lit(mask(policy)).cast("long")) == 0)


def ablation(rows: DataFrame, policy: str) -> DataFrame:
    """For each rule of the policy: texts that fail it, texts that fail it alone (what dropping it would bring back).

    Rows are first counted by mask, so what is shuffled is as many rows as there are masks."""
    m = mask(policy)
    masks = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(m).cast("long")).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    of = masks.select("bits", "n", F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(1 << i).cast("long").alias("bit")) for i, (name, _) in enumerate(RULES) if m >> i & 1])).alias("r"))
    hit = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    return of.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(hit & (F.bit_count("bits") == 1), F.col("n")).otherwise(0)).alias("n_failed_alone"),
        F.sum("n").alias("n_texts"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: the ledger of all documents, with the base decision and the newest policy's verdict."""
    rows = apply_policy(apply_policy(ledger(table(spark, sf_dir, "documents")), "base", "__base"), "v2")
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~F.col("__base")).alias("base_failed"), "kept", "n_lines", "n_upper", "fail_bits")


ORACLE = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS x FROM documents),
w AS (SELECT r, doc_id, x, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(x, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l FROM t),
g AS (SELECT r, i, list_aggregate(w[i : i + 4], 'string_agg', ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
p AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM g) WHERE c > 1),
q AS (SELECT r, sum(least(5, coalesce(nxt - i, 5))) AS n FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM p) GROUP BY r),
m AS (SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(length(regexp_replace(x, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(x, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
             CAST(length(regexp_replace(x, '[^A-Z]', '', 'g')) AS BIGINT) AS n_upper, CAST(coalesce(q.n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN q ON w.r = q.r),
b AS (SELECT *, CAST((n_words < 10)::INT + 2 * (100 * n_repeat_words > 20 * n_words)::INT + 4 * (10 * n_symbols > n_words)::INT + 8 * (100 * n_dup_lines > 30 * n_lines)::INT
             + 16 * (word_chars < 2 * n_words)::INT + 32 * (word_chars > 15 * n_words)::INT + 64 * (n_words >= 10 AND 2 * n_upper > word_chars)::INT AS BIGINT) AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, n_lines, n_upper, fail_bits FROM b
"""
