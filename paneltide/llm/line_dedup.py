"""Near-duplicate lines through a deletion-neighbourhood join.

A line is its words in lower case. Lines of the same words are equal; lines of at least EDIT_WORDS words are also
near each other at one edit (a word replaced, added or left out): an edit similarity of 0.8 or more. One edit makes
more than a fifth of a shorter line, which so has the edit bound zero. A line goes if an equal or near one stands earlier
(by document id, then by line number); white-space lines always stay.

Near lines share, after one word is deleted, the same words: each line emits the hash of every such variant, equal
hashes meet, and the edit distance is then verified on the words. Two lines at one edit also share their first or
last half, so a first pass finds the lines that share a half with another, different line; only these emit variants.
That loses nothing and keeps the variants of lines that can have no partner out of the shuffle. In a group of equal
variants only the earliest line matters, so groups are aggregated and never paired.

Only DataFrame functions. Equal lines are combined before the shuffle, and decisions return to the documents by
document and not by line, so a line that stands in a third of all documents is one row, not a hot key.

Null and empty texts have no lines that go. Rows that repeat both id and text are one document with equal results;
of rows with one id and different texts the order of the text's hash decides. Null ids come first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WS_CHARS, cut, let, table

EDIT_WORDS = 5


def _spaced(text: Column) -> Column:
    """The text in lower case with one space for each run of white space within a line; \n stays."""
    lower = F.lower(text)
    plain = reduce(Column.__or__, [lower.contains(x) for x in ("  ", "\t", "\x0b", "\x0c", "\r")])
    return F.when(plain, F.regexp_replace(lower, r"[\x20\x09\x0B-\x0D]+", " ")).otherwise(lower)


def _line(spaced: Column) -> Column:
    """A line of _spaced(): its words with a space between."""
    return F.trim(spaced)


def _size(line: Column) -> Column:
    """The number of words of a line of _line()."""
    return F.when(line == "", 0).otherwise(F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit(""))) + 1)


def _first(line: Column, n: Column) -> Column:
    return F.call_function("substring_index", line, F.lit(" "), n)


def _last(line: Column, n: Column) -> Column:
    return F.call_function("substring_index", line, F.lit(" "), -n)


def _blank(line: Column) -> Column:
    """Whether a line has no words."""
    return F.trim(line, F.lit(WS_CHARS)) == ""


def _halves(x: Column, n: Column, least: int) -> Column:
    """Hashes of the first and last half, for pairs whose shorter line has n words, and n - 1."""

    def pair(shorter: Column) -> list[Column]:
        head = F.floor(shorter / 2).cast("int")
        tail = shorter - head
        return [F.xxhash64(F.lit(0), shorter, _first(x, head)), F.xxhash64(F.lit(1), shorter, _last(x, tail))]

    return F.when(n > least, F.array(*pair(n), *pair(n - 1))).when(n == least, F.array(*pair(n))).otherwise(F.array().cast("array<bigint>"))


def first_lines(docs: DataFrame, id_column: str, text: str, least: int) -> DataFrame:
    """Each distinct line: its hash, where it stands first, and the hashes of its halves."""
    texts = docs.select(F.col(id_column).alias("id"), F.xxhash64(F.col(text)).alias("text_hash"), _spaced(F.col(text)).alias("spaced"))
    lines = texts.select("id", "text_hash", F.posexplode(F.split("spaced", "\n")).alias("line", "raw"))
    worded = lines.select("id", "text_hash", "line", _line(F.col("raw")).alias("x")).where("x <> ''").withColumn("n", _size(F.col("x")))
    keyed = worded.select("id", "text_hash", "line", F.xxhash64("x").alias("h"), _halves(F.col("x"), F.col("n"), least).alias("halves"))
    return keyed.groupBy("h").agg(F.min(F.struct("id", "text_hash", "line", "halves")).alias("f")).select("h", "f.*")


def _neighbours(lines: DataFrame, docs: DataFrame, id_column: str, text: str) -> DataFrame:
    """(h, by): a line and the earliest near line before it. lines: as first_lines() gives them, written down."""
    halves = lines.where(F.size("halves") > 0).select("h", F.posexplode("halves").alias("side", "half"))
    shared = cut(halves.groupBy("half").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b").select("half"))
    # A shared first half leaves the edit to the places after it, a shared last half to those before.
    able = halves.join(shared, "half", "left_semi").groupBy("h").agg(F.max(F.col("side") % 2 == 0).alias("late"), F.max(F.col("side") % 2 == 1).alias("early"))
    candidates = cut(lines.drop("halves").join(able, "h"))

    by_doc = candidates.groupBy("id", "text_hash").agg(F.collect_list(F.struct("line", "h", "late", "early")).alias("wanted"))
    own = docs.select(F.col(id_column).alias("__id"), F.xxhash64(F.col(text)).alias("__hash"), _spaced(F.col(text)).alias("__text"))
    found = own.join(by_doc, F.col("__id").eqNullSafe(F.col("id")) & (F.col("__hash") == F.col("text_hash")))
    wanted = let(F.split("__text", "\n"), lambda lines: F.transform("wanted", lambda x: F.struct(x.alias("x"), lines[x["line"]].alias("raw"))))
    each = found.select("id", "text_hash", F.explode(wanted).alias("y"))
    texts = cut(each.select("y.x.h", F.struct("id", "text_hash", "y.x.line").alias("at"), "y.x.late", "y.x.early", _line(F.col("y.raw")).alias("x")).withColumn("n", _size(F.col("x"))).dropDuplicates(["h"]))

    size = F.col("n")
    middle = F.floor((size - 1) / 2).cast("int")
    without = lambda i: F.xxhash64(F.concat_ws(" ", F.when(i > 1, _first(F.col("x"), i - 1)), F.when(i < size, _last(F.col("x"), size - i))))
    places = F.sequence(F.when(F.col("early"), 1).otherwise(middle + 1), F.when(F.col("late"), size).otherwise(middle + 1))
    deleted = texts.select("h", F.explode(F.transform(places, lambda i: F.struct(i.alias("place"), without(i).alias("variant")))).alias("v")).select("h", "v.place", "v.variant")
    # Place 0: the whole line, as a variant of lines with one word more.
    variants = cut(deleted.unionByName(texts.select("h", F.lit(0).alias("place"), F.col("h").alias("variant"))))
    met = cut(variants.groupBy("variant").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b").select("variant"))
    few = variants.join(met, "variant", "left_semi").join(texts.select("h", "at"), "h")
    few = cut(few)
    # One word replaced: deleted at the same place. One word more: a variant of the longer line is the shorter one.
    first = lambda rows, key: cut(rows.groupBy(*key).agg(F.min(F.struct("at", "h")).alias("first")))
    gone = few.where("place > 0")
    earlier = lambda rows, firsts, key: rows.join(firsts, key).where((F.col("first.at") < F.col("at")) & (F.col("first.h") != F.col("h"))).select("h", "first")
    replaced = earlier(gone, first(gone, ["variant", "place"]), ["variant", "place"])
    added = earlier(gone, first(few.where("place = 0"), ["variant"]), ["variant"])
    lacking = earlier(few.where("place = 0"), first(gone, ["variant"]), ["variant"])
    best = replaced.unionByName(added).unionByName(lacking).groupBy("h").agg(F.min("first").alias("first")).select("h", F.col("first.h").alias("by"))
    words = F.split("x", " ")
    a, b = texts.select("h", words.alias("wa")), texts.select(F.col("h").alias("by"), words.alias("wb"))
    return best.join(a, "h").join(b, "by").where(within_one_edit(F.col("wa"), F.col("wb"))).select("h", "by")


def within_one_edit(a: Column, b: Column) -> Column:
    """Whether two arrays of words are at an edit distance of one at most."""
    short, long = F.when(F.size(a) <= F.size(b), a).otherwise(b), F.when(F.size(a) <= F.size(b), b).otherwise(a)
    differ = F.zip_with(short, long, lambda x, y: F.when(~x.eqNullSafe(y), F.lit(1)).otherwise(0))
    place = F.coalesce(F.try_element_at(F.filter(F.transform(differ, lambda d, i: F.when(d == 1, i + 1).otherwise(0)), lambda i: i > 0), F.lit(1)), F.size(long))
    replaced = F.aggregate(differ, F.lit(0), lambda n, d: n + d) <= 1
    left_out = F.concat(F.slice(long, F.lit(1), place - 1), F.slice(long, place + 1, F.size(long))) == short
    return F.when(F.size(a) == F.size(b), replaced).when(F.abs(F.size(a) - F.size(b)) == 1, left_out).otherwise(False)


def kept_lines(docs: DataFrame, id_column: str = "doc_id", text: str = "text", least: int = EDIT_WORDS) -> DataFrame:
    """id, text_hash and the numbers (from 0) of the lines with words that stay, for documents that have such."""
    lines = cut(first_lines(docs, id_column, text, least))
    gone = cut(_neighbours(lines, docs, id_column, text).select("h"))
    return lines.select("h", "id", "text_hash", "line").join(gone, "h", "left_anti").groupBy("id", "text_hash").agg(F.collect_list("line").alias("kept"))


def _with_kept(docs: DataFrame, kept: DataFrame, id_column: str, text_hash: Column) -> DataFrame:
    k = kept.select(F.col("id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("kept").alias("__kept"))
    return docs.withColumn("__own", text_hash).join(k, F.col(id_column).eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__hash")), "left").drop("__id", "__hash", "__own")


def _worded(text: Column) -> Column:
    """Numbers of the lines that have words."""
    flags = F.transform(F.split(text, "\n"), lambda x, i: F.when(_blank(x), -1).otherwise(i))
    return F.filter(flags, lambda i: i >= 0)


def dedup_lines(docs: DataFrame, id_column: str = "doc_id", text: str = "text", least: int = EDIT_WORDS) -> DataFrame:
    """docs without the lines that go and without the documents that had words and keep none. Other columns stay."""
    kept = kept_lines(docs, id_column, text, least)
    joined = _with_kept(docs, kept, id_column, F.xxhash64(F.col(text)))
    lines = F.split(F.col(text), "\n")
    numbers = F.transform(lines, lambda x, i: F.when(_blank(x), i).otherwise(-1))
    stay = F.array_sort(F.concat(F.filter(numbers, lambda i: i >= 0), F.coalesce("__kept", F.array().cast("array<int>"))))
    # Bound once: a lambda would split the text anew for each line.
    parts = F.struct(lines.alias("lines"), stay.alias("stay"))
    had = ~_blank(F.coalesce(F.col(text), F.lit("")))
    some = joined.where(~had | F.col("__kept").isNotNull())
    new = F.when(F.col(text).isNull(), F.col(text)).otherwise(F.concat_ws("\n", let(parts, lambda x: F.transform(x["stay"], lambda i: x["lines"][i]))))
    return some.withColumn(text, new).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: of every document the number of lines with words, how many go, and their numbers."""
    docs = table(spark, sf_dir, "documents")
    kept = kept_lines(docs)
    narrow = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.coalesce(_worded(F.col("text")), F.array().cast("array<int>")).alias("worded"))
    out = _with_kept(narrow, kept, "doc_id", F.col("text_hash"))
    gone = F.array_except("worded", F.coalesce("__kept", F.array().cast("array<int>")))
    return out.select("doc_id", F.size("worded").cast("long").alias("n_lines"), F.size(gone).cast("long").alias("n_dropped"), F.array_join(F.array_sort(gone), ",").alias("dropped_lines"))


ORACLE = rf"""
WITH t AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, i - 1 AS line, list_filter(regexp_split_to_array(lower(ls[i]), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
      FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM t)),
n AS (SELECT doc_id, line, array_to_string(w, ' ') AS x, w FROM l WHERE len(w) > 0),
f AS (SELECT x, any_value(w) AS w, min((doc_id, line)) AS pos FROM n GROUP BY x),
v AS (SELECT x, pos, i, array_to_string(list_concat(w[1 : i - 1], w[i + 1 :]), ' ') AS v FROM (SELECT x, pos, w, unnest(range(1, len(w) + 1)) AS i FROM f WHERE len(w) >= {EDIT_WORDS})),
s AS (SELECT x FROM (SELECT x, pos, min(pos) OVER (PARTITION BY v, i) AS m FROM v) WHERE m < pos),
a AS (SELECT v.x, CASE WHEN f.pos < v.pos THEN v.x ELSE f.x END AS gone FROM v JOIN f ON f.x = v.v WHERE len(f.w) >= {EDIT_WORDS}),
g AS (SELECT x FROM s UNION SELECT gone FROM a),
d AS (SELECT n.doc_id, n.line, (f.pos <> (n.doc_id, n.line) OR n.x IN (SELECT x FROM g)) AS gone FROM n JOIN f ON n.x = f.x),
c AS (SELECT doc_id, count(*) AS n, count(*) FILTER (gone) AS g, string_agg(CAST(line AS VARCHAR), ',' ORDER BY line) FILTER (gone) AS ls FROM d GROUP BY doc_id)
SELECT documents.doc_id, coalesce(n, 0) AS n_lines, coalesce(g, 0) AS n_dropped, coalesce(ls, '') AS dropped_lines FROM documents LEFT JOIN c ON documents.doc_id = c.doc_id
"""
