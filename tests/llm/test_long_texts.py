"""Secrets and line dedup stay linear in the matches and lines of one text."""

import re
import time

import pytest
from pyspark.sql import functions as F

from paneltide.llm import common, line_dedup, secrets


def seconds(run):
    best = []
    for _ in range(2):
        began = time.time()
        run()
        best.append(time.time() - began)
    return min(best)


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 300, 16_400])
def test_running_sums(spark, n):
    values = [(i * 7) % 11 for i in range(n)]
    (got,) = spark.createDataFrame([(values,)], "v array<bigint>").select(common.running_sums(F.col("v"))).first()
    total, want = 0, []
    for x in values:
        total += x
        want.append(total)
    assert got == want


def secret_text(n):
    return "é " + " ".join(f"token={i:032x}" + " filler" * (i % 3) for i in range(n))


def test_very_many_secrets(spark):
    def found(n):
        df = spark.createDataFrame([(1, secret_text(n), "a")], "doc_id long, text string, source string")
        return secrets.find(df).select(F.explode("spans").alias("s")).where("s.kind = 0").select("s.start", "s.end", "s.value").collect()

    text = secret_text(3000)
    want = [(m.start(), m.end(), m.group(1)) for m in re.finditer("token=([0-9a-f]+)", text)]
    assert sorted(map(tuple, found(3000))) == want
    short, long = seconds(lambda: found(10_000)), seconds(lambda: found(20_000))
    assert long < 2.5 * short + 1


def test_very_many_lines(spark):
    def run(n):
        text = "\n".join(f"line number {i} of many" if i % 5 else "again and again the same" for i in range(n))
        df = spark.createDataFrame([(1, text)], "doc_id long, text string")
        return line_dedup.dedup_lines(df, least=100).first()["text"]

    want = [f"line number {i} of many" for i in range(2000) if i % 5]
    assert run(2000) == "\n".join(["again and again the same", *want])
    short, long = seconds(lambda: run(10_000)), seconds(lambda: run(20_000))
    assert long < 2.5 * short + 1


def test_lines_stay_strings(spark):
    """The pass over all lines builds no arrays of words, and takes words in any white space and case alike."""
    texts = ["A  b\tc D e f\n\x0b \r", "a b\x0cc d E f\r\n x", " a b c d x f", "a b c d e f g\x0b\nX\t"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    first = line_dedup.first_lines(df, "doc_id", "text", 5)
    plan = first._jdf.queryExecution().optimizedPlan().toString()
    assert "array_remove" not in plan and "slice(" not in plan
    assert sorted((r["id"], r["line"]) for r in first.collect()) == [(0, 0), (1, 1), (2, 0), (3, 0)]
    kept = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(df).collect()}
    assert kept == {0: texts[0], 1: " x"}
