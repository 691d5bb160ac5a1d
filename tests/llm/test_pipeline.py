"""The pipeline on planted cases, against what each stage must do."""

import collections
import re

import numpy as np

import corpus_pipeline
from paneltide.llm import quality_rules

VOCABULARY = {
    "en": "the of and with this that from which thing where houses walked through morning never again quietly bright water stones people river".split(),
    "de": "der die und nicht mit über wird eine keit häuser gegangen durch morgen niemals wieder leise helles wasser steine leute fluss straße".split(),
}


def prose(seed, lang, n):
    rng = np.random.default_rng(seed)
    return " ".join(VOCABULARY[lang][i] for i in rng.integers(0, len(VOCABULARY[lang]), n))


def documents():
    rows = [(k, prose(k, "en" if k % 2 else "de", 120), "en" if k % 2 else "de", f"s{k % 3}") for k in range(1, 31)]
    item = prose(500, "en", 40)
    rows += [
        (101, None, "en", "s0"),
        (102, "12 34 !!", "en", "s0"),
        (103, rows[0][1], "en", "s1"),  # an exact copy: its only line stands earlier
        (104, prose(104, "en", 100) + "\n" + rows[1][1] + "\n" + prose(105, "de", 50), "en", None),  # holds another text as a line
        (106, prose(106, "en", 300), "en", "s1"),
        (107, " ".join([*prose(106, "en", 300).split()[:150], "other", "words", *prose(106, "en", 300).split()[152:]]), "en", "s1"),  # two words off: no near line, but a near duplicate
        (108, prose(108, "en", 60) + " " + item + " " + prose(109, "en", 60), "en", "s2"),
    ]
    return rows, item


def test_planted_cases(spark, tmp_path):
    rows, item = documents()
    docs = spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, prose(900, "de", 30))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    seen, at = {}, spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, at, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        at = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = {r["doc_id"]: r for r in at.collect()}
        if name != "mixing":
            assert at.columns == corpus_pipeline.COLUMNS
    every = {r[0] for r in rows}
    assert set(seen["language"]) == every - {101, 102}
    assert all(r["lang"] == ("en" if i % 2 else "de") for i, r in seen["language"].items() if i < 100)
    assert set(seen["lines"]) == every - {101, 102, 103}
    assert seen["lines"][104]["text"].count("\n") == 1 and rows[1][1] not in seen["lines"][104]["text"]
    assert seen["lines"][104]["n_chars"] == len(seen["lines"][104]["text"])
    assert set(seen["near_duplicates"]) == every - {101, 102, 103, 107}
    assert set(seen["benchmark"]) == every - {101, 102, 103, 107, 108}
    mixed = seen["mixing"]
    sizes = {i: len(re.findall(r"\S+", r["text"])) for i, r in seen["benchmark"].items()}
    assert {i: r["size"] for i, r in mixed.items()} == sizes
    total = collections.Counter()
    for i, r in seen["benchmark"].items():
        total[r["source"]] += sizes[i]
    assert all(mixed[i]["source_size"] == total[r["source"]] and mixed[i]["taken"] <= 2 * sizes[i] for i, r in seen["benchmark"].items())
    ran = {r["doc_id"]: r["taken"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert ran == {i: r["taken"] for i, r in mixed.items()}


def test_rows_of_one_id_and_of_none(spark, tmp_path):
    """Different texts of one id, or of null id, are documents of their own; equal rows and near copies are not."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    a, b, c = prose(1, "en", 90), prose(2, "en", 90), prose(3, "en", 90)
    near = " ".join([*a.split()[:50], "other", *a.split()[51:]])
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in [(1, a), (1, b), (1, b), (None, c), (None, near), (2, near), (3, None), (4, "")]], schema)
    kept = corpus_pipeline.dedup_documents(spark, docs, str(tmp_path)).collect()
    assert sorted((r["doc_id"] or -1, r["text"] or "") for r in kept) == sorted([(1, a), (1, b), (-1, c), (3, "")])
    spark.createDataFrame([(7, b)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clean = corpus_pipeline.remove_benchmark(spark, docs, str(tmp_path)).collect()
    assert sorted((r["doc_id"] or -1, r["text"] or "") for r in clean) == sorted([(1, a), (-1, c), (-1, near), (2, near), (3, ""), (4, "")])


def test_names_and_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "lines", "near_duplicates", "benchmark", "mixing"]
    assert corpus_pipeline.ORACLE_SQL is None and quality_rules.mask("base") == 3


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
