"""URL rules as one bit-parallel wildcard automaton (Shift-And over several machine words).

All globs are packed into one bit string: a state for each place of each glob, so that one shift, one AND and
one OR a character move every glob at once. A batch of URLs is simulated together, a numpy row for each URL.
The automaton's size is that of the rule list, which is a parameter and not data; pages are only scanned and
never shuffled, so hot hosts, copies and repeated rows cost nothing more than their own rows.

A canonical URL is "." + host + separator + path. The separator is no Unicode code point, so no URL holds it.
Null urls and urls without "://" have an empty host and path; only globs that fit these apply to them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, UPPER, table

#: Beyond the last code point.
SEPARATOR = 0x110000
ONE_WORD = 64

#: Verdict, host, path prefix.
RULES: list[tuple[str, str, str]] = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
#: What decides where no rule fits: host glob, path glob. A page is blocked if one fits.
BLOCK_GLOBS: list[tuple[str, str]] = [
    ("*spam*", "*"),
    ("*pills*", "*"),
    ("*casino*", "*"),
    ("*poker*", "*"),
    ("*porn*", "*"),
    ("*xxx*", "*"),
    ("*viagra*", "*"),
    ("*", "*/wp-login.php*"),
    ("*", "*/cgi-bin/*"),
]


@dataclass(frozen=True)
class Place:
    """A place that reads one character (None: any but the separator), and whether a run may pass before it."""

    char: int | None
    run: bool


def _places(text: str) -> tuple[list[Place], bool]:
    """The places of a glob of * and ?, and whether it ends in a run."""
    out, run = [], False
    for ch in text:
        if ch == "*":
            run = True
        else:
            out.append(Place(None if ch == "?" else ord(ch), run))
            run = False
    return out, run


def glob(host: str, path: str) -> tuple[list[Place], bool]:
    """A glob over canonical URLs; a run never passes the separator."""
    of_host, run = _places(host)
    of_path, end = _places(path)
    return [*of_host, Place(SEPARATOR, run), *of_path], end


def rule_glob(host: str, path: str) -> tuple[list[Place], bool]:
    """Fits the host, its subdomains and all paths that begin with path, whose characters all stand for themselves."""
    literal = lambda s: [Place(ord(c), False) for c in s]
    first, *rest = literal("." + host)
    return [Place(first.char, True), *rest, Place(SEPARATOR, False), *literal(path)], True


class Automaton:
    """Globs packed into masks of 64-bit words: state k of a glob says that its first k places have been read."""

    def __init__(self, globs: list[tuple[list[Place], bool]]):
        known = sorted({p.char for places, _ in globs for p in places if p.char is not None})
        #: Characters that the globs name; class 0 is every other one.
        self.known = np.array(known, dtype=np.int64)
        bits = sum(len(places) + 1 for places, _ in globs)
        self.words = -(-bits // ONE_WORD)
        shape = (len(known) + 1, self.words)
        self.enter, self.stay = np.zeros(shape, np.uint64), np.zeros(shape, np.uint64)
        self.start, self.accept = np.zeros(self.words, np.uint64), []
        separator = known.index(SEPARATOR) + 1
        at = 0
        for places, end in globs:
            put = lambda masks, rows, k: masks.__setitem__((rows, k // ONE_WORD), masks[rows, k // ONE_WORD] | np.uint64(1 << k % ONE_WORD))
            self.start[at // ONE_WORD] |= np.uint64(1 << at % ONE_WORD)
            plain = np.array([c for c in range(len(known) + 1) if c != separator])
            for k, place in enumerate(places):
                if place.run:
                    put(self.stay, plain, at + k)
                put(self.enter, plain if place.char is None else np.array([known.index(place.char) + 1]), at + k + 1)
            if end:
                put(self.stay, plain, at + len(places))
            self.accept.append(at + len(places))
            at += len(places) + 1

    def classes(self, codes: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.zeros(len(codes), np.int64)
        i = np.searchsorted(self.known, codes)
        return np.where(self.known[np.minimum(i, len(self.known) - 1)] == codes, i + 1, 0)

    def fits(self, urls: list[np.ndarray]) -> np.ndarray:
        """A row for each URL (its code points), a column for each glob."""
        sizes = np.array([len(u) for u in urls], dtype=np.int64)
        order = np.argsort(-sizes, kind="stable")
        codes = self.classes(np.concatenate([np.asarray(u, np.int64) for u in urls])) if sizes.sum() else np.zeros(0, np.int64)
        begin = np.concatenate(([0], np.cumsum(sizes)[:-1])) if len(urls) else np.zeros(0, np.int64)
        begin, sizes = begin[order], sizes[order]
        state = np.repeat(self.start[None, :], len(urls), axis=0)
        active = len(urls)
        for t in range(int(sizes[0]) if len(urls) else 0):
            while active and sizes[active - 1] <= t:  # the longest come first
                active -= 1
            now, c = state[:active], codes[begin[:active] + t]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:active] = (moved & self.enter[c]) | (now & self.stay[c])
        out = np.zeros((len(urls), len(self.accept)), dtype=bool)
        for k, bit in enumerate(self.accept):
            out[order, k] = state[:, bit // ONE_WORD] >> np.uint64(bit % ONE_WORD) & np.uint64(1) != 0
        return out


def with_parts(pages: DataFrame, url: str = "url") -> DataFrame:
    """Columns host and path; both empty where the url is null or has no "://"."""
    u = F.coalesce(F.col(url), F.lit(""))
    at = F.locate("://", u)
    rest = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return pages.withColumn("host", host).withColumn("path", F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, block_globs: list[tuple[str, str]] = BLOCK_GLOBS, id_column: str = "page_id", url: str = "url", batch: int = 4096) -> DataFrame:
    """Id, host, path, the longest rule that fits, the verdict, and the number of block globs that fit."""
    source = with_parts(pages.select(F.col(id_column), F.col(url).alias("__url")), "__url").select(id_column, "host", "path")
    schema = T.StructType([*source.schema.fields, T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType()), T.StructField("n_globs", T.LongType())])
    names = [h + p for _, h, p in rules]
    #: Longest first; of equal length, the longer host and then the earlier rule.
    order = sorted(range(len(rules)), key=lambda k: (-len(names[k]), -len(rules[k][1]), k))
    packed = [rule_glob(rules[k][1], rules[k][2]) for k in order] + [glob(h, p) for h, p in block_globs]
    verdicts, texts = [rules[k][0] for k in order], [names[k] for k in order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(packed)
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                rows = whole.slice(at, batch)
                urls = [
                    np.concatenate((np.frombuffer(("." + h).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64), [SEPARATOR], np.frombuffer(p.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)))
                    for h, p in zip(rows.column("host").to_pylist(), rows.column("path").to_pylist(), strict=True)
                ]
                fit = automaton.fits(urls)
                by_rule, by_glob = fit[:, : len(order)], fit[:, len(order) :]
                ruled = by_rule.any(axis=1) if order else np.zeros(len(urls), bool)
                first = by_rule.argmax(axis=1) if order else np.zeros(len(urls), int)
                blocked = by_glob.any(axis=1)
                rule = [texts[k] if r else None for r, k in zip(ruled, first, strict=True)]
                verdict = [verdicts[k] if r else "block" if b else "allow" for r, k, b in zip(ruled, first, blocked, strict=True)]
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string()), pa.array(by_glob.sum(axis=1), pa.int64())], names=schema.names)

    return source.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: every page's url judged by the rules, and by the block globs where none fits."""
    return judge(table(spark, sf_dir, "pages"))


ORACLE = r"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url, strpos(coalesce(url, ''), '://') AS pos FROM pages),
r AS (SELECT page_id, CASE WHEN pos > 0 THEN substr(url, pos + 3) ELSE '' END AS rest FROM u),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM r),
rules(verdict, h, f) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
fit AS (SELECT DISTINCT p.host, p.path, arg_max(h || f, length(h || f)) OVER w AS rule, arg_max(verdict, length(h || f)) OVER w AS verdict
        FROM (SELECT DISTINCT host, path FROM p) p JOIN rules ON ends_with('.' || p.host, '.' || h) AND starts_with(p.path, f) WINDOW w AS (PARTITION BY p.host, p.path)),
n AS (SELECT page_id, host, path, CAST((contains(host, 'spam'))::INT + contains(host, 'pills')::INT + contains(host, 'casino')::INT + contains(host, 'poker')::INT + contains(host, 'porn')::INT
             + contains(host, 'xxx')::INT + contains(host, 'viagra')::INT + contains(path, '/wp-login.php')::INT + contains(path, '/cgi-bin/')::INT AS BIGINT) AS n_globs FROM p)
SELECT n.page_id, n.host, n.path, fit.rule, coalesce(fit.verdict, CASE WHEN n_globs > 0 THEN 'block' ELSE 'allow' END) AS verdict, n_globs
FROM n LEFT JOIN fit ON n.host = fit.host AND n.path = fit.path
"""
