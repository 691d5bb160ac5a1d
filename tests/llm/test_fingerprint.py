"""Fingerprints, edited texts and likenesses against plain Python."""

import hashlib
import struct

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from paneltide.llm import fingerprint

SCHEMA = "doc_id long, text string, name string, me string, part int, n_chars long, id long, fingerprint string"
BINS = fingerprint.BINS


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def low(text):
    return text.translate({i: i + 32 for i in range(65, 91)})


def shingles(text):
    import re

    w = [xxhash.xxh64_intdigest(x.encode(), 42) for x in re.findall(r"[^\x20\x09-\x0d]+", low(text or ""))]
    out = []
    for i in range(max(len(w) - 4, min(len(w), 1))):
        seed = 42
        for h in w[i : i + 5]:
            seed = xxhash.xxh64_intdigest(struct.pack("<Q", h), seed)
        out.append(seed)
    return out


def plain_fingerprint(text):
    least = [None] * BINS
    for h in map(signed, shingles(text)):
        k = (h >> 56) + 128
        least[k] = h if least[k] is None else min(least[k], h)
    if not any(x is not None for x in least):
        return "0" * (2 * BINS)
    places, masks = fingerprint.attempts()
    full = [x if x is not None else next(y for y in (least[places[j ^ m]] for m in masks) if y is not None) for j, x in enumerate(least)]
    return "".join(f"{x & 255:02x}" for x in full)


def plain_likeness(a, b):
    if a == b:
        return 1.0
    if int(a, 16) == 0 or int(b, 16) == 0:
        return 0.0
    agree = sum(a[i : i + 2] == b[i : i + 2] for i in range(0, len(a), 2)) / BINS
    return max(0.0, (agree - 1 / 256) / (1 - 1 / 256))


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(f"W{x}" for x in rng.integers(0, 5000, n))


TEXTS = [(7, prose(1, 300)), (3, None), (5, ""), (12, " \n"), (4, "One two"), (6, "é😀 z\tQ"), (100, prose(2, 20_000)), (101, prose(1, 300)), (None, "No id"), (None, None), (8, prose(3, 9)), (8, prose(4, 40)), (2**62, "far away"), (-5, "abc")]


@pytest.fixture(scope="module")
def frame(spark):
    return lambda rows: spark.createDataFrame([(i, t, "n", "m", 1, 2, 3, "f") for i, t in rows], SCHEMA)


def test_documents_and_edited_texts(frame):
    rows = [*TEXTS, TEXTS[0], TEXTS[0], TEXTS[9]]
    got = fingerprint.edited(frame(rows)).select("*", fingerprint.fingerprint(F.col("text")).alias("fp")).collect()
    assert len(got) == len(rows)
    key = lambda i, t: (i is not None, i or 0, signed(xxhash.xxh64_intdigest((t or "").encode(), 42)))
    order = sorted({key(i, t): t or "" for i, t in rows}.items())
    want = {}
    for k, (place, text) in enumerate(order):
        gives = len(text) // 4
        want[place] = text[: len(text) - gives] + order[(k + 1) % len(order)][1][:gives]
    for r in got:
        assert r["edited"] == want[key(r["id"], r["text"])] and r["n_chars"] == len(r["text"])
        assert r["fp"].hex() == plain_fingerprint(r["text"])


def test_one_document_and_none(frame):
    (only,) = fingerprint.edited(frame([(1, "abcdefgh")])).collect()
    assert only["edited"] == "abcdefab"
    assert fingerprint.edited(frame([]).where("false")).count() == 0


def test_many_ranges(spark, frame, monkeypatch):
    monkeypatch.setattr(fingerprint, "RANGE_ROWS", 7)
    rows = [(i * i, f"{i:04d} text") for i in range(400)]
    got = {r["id"]: r["edited"] for r in fingerprint.edited(frame(rows)).collect()}
    assert got == {i * i: f"{i:04d} te" + f"{(i + 1) % 400:04d}"[:2] for i in range(400)}


def test_query_and_digests(spark, tmp_path, frame):
    frame(TEXTS).select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    got = fingerprint.query(spark, str(tmp_path)).collect()
    assert len(got) == len(TEXTS)
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    edited = prose(1, 300)
    after = prose(3, 9), prose(4, 40)
    first = min(after, key=lambda t: signed(xxhash.xxh64_intdigest(t.encode(), 42)))
    cut = len(edited) // 4
    edited = edited[: len(edited) - cut] + first[:cut]
    assert by[7]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
    assert by[7]["edited_fingerprint"] == plain_fingerprint(edited)
    assert by[7]["near_edited"] == pytest.approx(plain_likeness(plain_fingerprint(prose(1, 300)), plain_fingerprint(edited)))
    assert by[7]["fingerprint"] == by[101]["fingerprint"] and by[5]["near_next"] == 0.0 and by[3]["near_edited"] == 1.0
    assert by[100]["near_next"] < 0.05


def test_attempts_reach_all_bins_and_differ():
    places, masks = fingerprint.attempts()
    ways = [tuple(places[j ^ m] for m in masks) for j in range(BINS)]
    assert all(sorted(w) == list(range(BINS)) for w in ways) and len(set(ways)) == BINS
    assert [sorted(w[t] for w in ways) for t in range(BINS)] == [list(range(BINS))] * BINS


def test_likeness_is_near_the_true_similarity(spark):
    rows, want = [], []
    for k in range(60):
        n = 12 + 20 * k
        a = prose(100 + k, n).split()
        b = [*a[: n * (k % 10 + 1) // 11], *prose(900 + k, n).split()[: n - n * (k % 10 + 1) // 11]]
        x, y = set(shingles(" ".join(a))), set(shingles(" ".join(b)))
        rows.append((k, " ".join(a), " ".join(b)))
        want.append(len(x & y) / len(x | y))
    df = spark.createDataFrame(rows, "k int, a string, b string")
    got = df.select("k", fingerprint.likeness(fingerprint.fingerprint(F.col("a")), fingerprint.fingerprint(F.col("b"))).alias("x")).orderBy("k").collect()
    off = np.array([r["x"] for r in got]) - np.array(want)
    assert abs(off.mean()) < 0.01 and np.abs(off).max() < 0.13 and np.sqrt((off**2).mean()) < 0.04
    for r in df.limit(3).select(fingerprint.fingerprint(F.col("a")).alias("x"), fingerprint.fingerprint(F.col("b"), 64, 4).alias("y")).collect():
        assert len(r["x"]) == BINS and len(r["y"]) == 32
