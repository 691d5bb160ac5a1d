"""Fill-in-middle: exact round trips, draws, units of other kinds, and odd rows."""

import hashlib

import pytest
import regex
from pyspark.sql import functions as F

from paneltide.llm import fill_middle
from paneltide.llm.fill_middle import Recipe, apply, draws, rebuild

SCHEMA = "doc_id long, text string, fim string, n long, form string, output string"
TEXTS = ["", None, "a", "é́\n😀\r\nz", "has <P> in it", "almost <P and <<S >M>", "x" * 200_000, "two words\nand a line", "<", ">"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", 1, "y", "z") for i, t in enumerate(TEXTS * 20)] + [(None, "no id at all", "x", 1, "y", "z")] * 2
    return spark.createDataFrame(rows, SCHEMA)


def test_rows_match_the_contract(docs):
    got = fill_middle.fill_middle(docs).withColumn("back", fill_middle.restored(F.col("fim.output"), F.col("fim.form"))).collect()
    assert len(got) == len(TEXTS) * 20 + 2 and {r["fim"]["form"] for r in got} == {"plain", "psm", "spm"}
    for r in got:
        text, key = r["text"] or "", "" if r["doc_id"] is None else str(r["doc_id"])
        digest = hashlib.sha256(f"1:{key}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
        n = len(text)
        a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
        if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
            want = (n, "plain", None, None, text)
        elif h4 % 100 < 20:
            want = (n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}")
        else:
            want = (n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}")
        f = r["fim"]
        assert (f["n"], f["form"], f["prefix_chars"], f["middle_chars"], f["output"]) == want
        assert f["output_sha256"] == hashlib.sha256(want[4].encode()).hexdigest()
        assert r["back"]["text"] == text and r["back"]["sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert r["output"] == "z" and r["n"] == 1


def test_shares_of_the_forms():
    unit = regex.compile(fill_middle.CODE_POINT)
    forms = [apply("some text here", str(i), Recipe(), unit)[1] for i in range(4000)]
    assert 0.08 < forms.count("plain") / 4000 < 0.12 and 0.16 < forms.count("spm") / 4000 < 0.20


@pytest.mark.parametrize("pattern", [r"\S+\s*", r"[^\n]*\n", r"\d", ""])
def test_other_units_cut_at_their_ends_only(pattern):
    recipe = Recipe(unit=pattern, transformed=100, seed="9")
    unit = regex.compile(pattern)
    for i in range(200):
        text = f" lead {i} words\nof two\n lines and a tail"
        n, form, prefix, middle, output, _ = apply(text, str(i), recipe, unit)
        allowed = {0, *(m.end() for m in unit.finditer(text))}
        assert prefix in allowed and prefix + middle in allowed and rebuild(output, form, recipe) == text
        assert draws(str(i), recipe) != draws(str(i), Recipe())


def test_sentinels_that_could_be_misread_are_refused():
    for marks in (("<P>", "<P>", "<M>"), ("", "<S>", "<M>"), ("ab", "bc", "<M>"), ("aba", "<S>", "<M>"), ("<P>x", "<P>", "<M>")):
        with pytest.raises(ValueError):
            Recipe(prefix=marks[0], suffix=marks[1], middle=marks[2])


def test_no_rows(docs):
    assert fill_middle.fill_middle(docs.where("false")).count() == 0
