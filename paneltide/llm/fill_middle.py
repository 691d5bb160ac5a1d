"""Fill-in-the-middle transformation of whole texts.

A text is cut into units by a pattern (one code point, a word, a line, a syntax unit). Two places among the units' ends,
drawn from a digest of the id, part it into prefix, middle and suffix, and sentinels put those in the order of a form:

    psm: <P> prefix <S> suffix <M> middle        spm: <S> suffix <P> prefix <M> middle        plain: the text

Each Arrow batch goes through one pandas UDF: the units' ends of a text lie in a compact array of 4-byte numbers, two
look-ups in it give the slices, and hashlib gives draws and digests. Draws depend on id and seed only, so reruns and lost
executors change nothing, and rows are never shuffled. Memory: a batch of texts, and four bytes a unit of one text.

Null texts count as empty; an empty text is plain. A null id draws as an empty string. Rows that repeat an id draw
alike. A text that holds a sentinel stays plain, so that restore() always gives back the text.
"""

from __future__ import annotations

import hashlib
from array import array
from dataclasses import dataclass
from operator import methodcaller

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: One code point, line ends included.
CODE_POINT = r"(?s:.)"
RESULT = "n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string"
_END = methodcaller("end")


@dataclass(frozen=True)
class Recipe:
    """unit: pattern of the units, matched left to right; what it leaves out goes with the part it stands in.
    transformed: percent of the texts that are not left plain; spm: percent of those that put the suffix first."""

    unit: str = CODE_POINT
    transformed: int = 90
    spm: int = 20
    seed: str = "1"
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self) -> None:
        marks = self.marks
        overlap = any(a[-k:] == b[:k] for a in marks for b in marks for k in range(1, min(len(a), len(b)) + (a != b)))
        if not all(marks) or len(set(marks)) < 3 or overlap or any(a in b for a in marks for b in marks if a != b):
            raise ValueError(f"sentinels must be distinct and free of overlaps: {marks}")

    @property
    def marks(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def draws(key: str, recipe: Recipe) -> tuple[int, ...]:
    """Four numbers of 32 bits from the digest of seed and key."""
    digest = sha256(f"{recipe.seed}:{key}")
    return tuple(int(digest[i : i + 8], 16) for i in range(0, 32, 8))


def ends(text: str, unit: regex.Pattern) -> array:
    """Where each unit ends."""
    return array("I", map(_END, unit.finditer(text)))


def apply(text: str, key: str, recipe: Recipe, unit: regex.Pattern) -> tuple:
    """The fields of RESULT."""
    places = ends(text, unit)
    n = len(places)
    one, two, plain, order = draws(key, recipe)
    if not text or any(m in text for m in recipe.marks) or plain % 100 >= recipe.transformed:
        return n, "plain", None, None, text, sha256(text)
    first, second = sorted((one % (n + 1), two % (n + 1)))
    a, b = (places[k - 1] if k else 0 for k in (first, second))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    p, s, m = recipe.marks
    form = "spm" if order % 100 < recipe.spm else "psm"
    output = f"{s}{suffix}{p}{prefix}{m}{middle}" if form == "spm" else f"{p}{prefix}{s}{suffix}{m}{middle}"
    return n, form, len(prefix), len(middle), output, sha256(output)


def rebuild(output: str, form: str, recipe: Recipe) -> str:
    """The text that apply() has made output from."""
    if form == "plain":
        return output
    p, s, m = recipe.marks
    ahead, behind = (s, p) if form == "spm" else (p, s)
    head, _, middle = output[len(ahead) :].partition(m)
    one, _, two = head.partition(behind)
    return two + middle + one if form == "spm" else one + middle + two


def transformed(key: Column, text: Column, recipe: Recipe = Recipe()) -> Column:
    """A struct of RESULT's fields. key: what draws depend on, as a string."""

    @F.pandas_udf(RESULT)
    def run(keys: pd.Series, texts: pd.Series) -> pd.DataFrame:
        unit = regex.compile(recipe.unit)
        rows = [apply(t or "", k or "", recipe, unit) for k, t in zip(keys, texts, strict=True)]
        out = pd.DataFrame(rows, columns=["n", "form", "prefix_chars", "middle_chars", "output", "output_sha256"])
        return out.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    return run(key.cast("string"), text)


def restored(output: Column, form: Column, recipe: Recipe = Recipe()) -> Column:
    """A struct of the text rebuilt from output and form, and its digest."""

    @F.pandas_udf("text string, sha256 string")
    def run(outputs: pd.Series, forms: pd.Series) -> pd.DataFrame:
        texts = [rebuild(o, f, recipe) for o, f in zip(outputs, forms, strict=True)]
        return pd.DataFrame({"text": texts, "sha256": [sha256(t) for t in texts]}, dtype=object)

    return run(output, form)


def fill_middle(docs: DataFrame, id_column: str = "doc_id", text: str = "text", into: str = "fim", recipe: Recipe = Recipe()) -> DataFrame:
    """docs with a struct column of RESULT's fields; all other columns stay (one that is called as into is replaced)."""
    return docs.withColumn(into, transformed(F.col(id_column), F.col(text), recipe))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: all documents by code points; the restored text comes from output and form alone."""
    made = fill_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    back = made.withColumn("back", restored(F.col("fim.output"), F.col("fim.form")))
    return back.select("doc_id", "fim.n", "fim.form", "fim.prefix_chars", "fim.middle_chars", "fim.output_sha256", F.col("back.sha256").alias("restored_sha256"))


ORACLE = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS x, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents),
h AS (SELECT doc_id, x, length(x) AS n, [CAST('0x' || substr(d, 1 + 8 * i, 8) AS BIGINT) FOR i IN range(4)] AS h FROM t),
c AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
             CASE WHEN x = '' OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR h[3] % 100 >= 90 THEN 'plain'
                  WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substr(x, 1, a) AS p, substr(x, a + 1, b - a) AS m, substr(x, b + 1) AS s FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(x) AS restored_sha256
FROM p
"""
