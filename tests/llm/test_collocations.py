"""Phrase counts and collocations against plain dictionaries."""

import collections
import re

import numpy as np
import pytest

from paneltide.llm import collocations

SCHEMA = "doc_id long, text string, lang string, phrase string, f long, words int, a long, rank int, score long"
WORDS = "Rain sun wind snow Über fog".split()


def plain_counts(rows, longest):
    f, n = collections.Counter(), collections.Counter()
    low = {i: i + 32 for i in range(65, 91)}
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(low)):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    return f, n


def plain(rows, longest, least, within=80):
    f, n = plain_counts(rows, longest)
    inside = collections.Counter()
    for (lang, w), k in f.items():
        if k >= least:
            for size in range(2, len(w)):
                for i in range(len(w) - size + 1):
                    key = lang, w[i : i + size]
                    inside[key] = max(inside[key], k)
    out = []
    for (lang, w), a in f.items():
        if a < least or len(w) < 2 or 100 * inside[lang, w] >= within * a and inside[lang, w]:
            continue
        score, _, l, r = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        out.append((lang, " ".join(w), a, l, r, n[lang], score))
    return sorted(out)


def texts(seed, n=120):
    rng = np.random.default_rng(seed)
    gaps = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", " \x0c"]
    make = lambda k: "".join(WORDS[int(x)] + gaps[int(g)] for x, g in zip(rng.zipf(1.6, k) % len(WORDS), rng.integers(0, len(gaps), k)))
    rows = [(make(int(rng.integers(0, 60))), ["en", "de", None, "a long name"][i % 4]) for i in range(n)]
    return rows + [(None, "en"), ("", None), (" \t.,", "fr"), (make(5000), "en"), (rows[0][0], rows[0][1]), ("  \x1f rain", "en")] * 2


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "p", 1, 2, 3, 4, 5) for i, (t, lang) in enumerate(rows)], SCHEMA)


@pytest.mark.parametrize("longest,least,seed", [(4, 5, 1), (4, 30, 2), (3, 4, 3), (2, 3, 4), (6, 3, 5)])
def test_all_phrases(spark, longest, least, seed):
    rows = texts(seed)
    got = collocations.collocations(frame(spark, rows), longest, least).select("lang", "phrase", "a", "l", "r", "n", "score").collect()
    assert sorted(map(tuple, got)) == plain(rows, longest, least)


def test_counts_do_not_depend_on_blocks_or_shards(spark, monkeypatch):
    rows = texts(7, 40)
    f, n = plain_counts(rows, 4)
    monkeypatch.setattr(collocations, "BLOCK", 13)
    for bytes_each in (1, 300, 1 << 20):
        total = collections.Counter()
        shards = [[]]
        for t, lang in rows:
            if sum(len(x) for x, _ in shards[-1]) > bytes_each:
                shards.append([])
            shards[-1].append(((t or "").encode(), lang or "und"))
        for shard in shards:
            for batch in collocations.Shard([x for _, x in shard], [x for x, _ in shard]).phrases(4):
                for of, phrase, words, count in zip(*(c.to_pylist() for c in batch.columns)):
                    total[of, phrase, words] += count
        want = {(lang, " ".join(w), len(w)): k for (lang, w), k in f.items()} | {(lang, "", 0): k for lang, k in n.items() if k}
        assert {k: v for k, v in total.items() if v} == want


def test_bitmap_holds_what_is_frequent(spark):
    rows = texts(3)
    f, _ = plain_counts(rows, 3)
    keys = collocations.key_counts(frame(spark, rows))
    assert sorted(r["f"] for r in keys.collect()) == sorted(f.values())
    bits = np.frombuffer(collocations.bitmap_of(keys.where("f >= 20")), dtype=np.uint8)
    assert int(np.unpackbits(bits).sum()) == sum(k >= 20 for k in f.values())
    shard = collocations.Shard([lang or "und" for _, lang in rows], [(t or "").encode() for t, _ in rows])
    before = shard.joined.copy()
    shard.keep(bits)
    assert sorted(shard.counts[shard.counts > 0]) == sorted(k for (_, w), k in f.items() if len(w) == 1 and k >= 20)
    assert before.sum() > shard.joined.sum() == sum(k for (_, w), k in f.items() if len(w) == 2 and k >= 20)


def test_ranks_and_ties(spark):
    rows = [("en", "b c", 5, 9), ("en", "a c", 5, 9), ("en", "z z", 7, 9), ("en", "é a", 5, 9), ("de", "x y", 1, 1)]
    got = collocations.top(spark.createDataFrame(rows, "lang string, phrase string, a long, score long"), 3).collect()
    assert sorted((r["lang"], r["rank"], r["phrase"]) for r in got) == [("de", 1, "x y"), ("en", 1, "z z"), ("en", 2, "a c"), ("en", 3, "b c")]


def test_counts_beyond_64_bits(spark):
    big = 9_000_000_000_000_000_000
    rows = [("en", "a b", 2, big), ("en", "a", 1, big), ("en", "b", 1, big)]
    got = collocations.scored(spark.createDataFrame(rows, "lang string, phrase string, words int, f long")).collect()
    assert [(r["score"], r["a"]) for r in got] == [(1_000_000, big)]


def test_no_rows(spark):
    assert collocations.collocations(frame(spark, texts(1)).where("false")).count() == 0
    assert collocations.collocations(frame(spark, [(None, None), ("", "en")])).count() == 0
