"""Cases that an operator once passed over, against brute force."""

import numpy as np
import pytest

import corpus_pipeline
from paneltide.llm import set_similarity, simhash


def shingle_set(text, k=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b)


def smallest_reachable(ids, linked):
    """The smallest id that each id reaches over the pairs linked(i, j)."""
    label = {i: i for i in ids}
    for i in ids:
        for j in ids:
            if i < j and linked(i, j) and label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label = {k: low if v == high else v for k, v in label.items()}
    return label


def test_verified_links_in_hot_buckets(spark, monkeypatch):
    """Two texts are alike; every midpoint of their fingerprints has a smaller fingerprint near it, of a text like neither."""
    monkeypatch.setattr(simhash, "HOT_BUCKET", 2)
    words = [f"w{k}" for k in range(60)]
    texts = {1: "none of these words", 2: " ".join(words), 3: " ".join([*words[:30], "other", *words[31:]]), 4: "nor of those"}
    prints = dict(zip(texts, (0, 0b0011, 0b1100, 0b1111 - (1 << 63)), strict=True))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    monkeypatch.setattr(simhash, "with_fingerprints", lambda docs, *_: spark.createDataFrame(list(prints.items()), "doc_id long, fingerprint long"))
    rows = simhash.near_duplicates(docs, shingle=5, distance=4, similarity=0.8).collect()
    sets = {i: shingle_set(t) for i, t in texts.items()}
    want = smallest_reachable(list(texts), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 4 and jaccard(sets[i], sets[j]) >= 0.8)
    assert {r["doc_id"]: r["component_id"] for r in rows} == want == {1: 1, 2: 2, 3: 2, 4: 4}


def edited_copies(seed, n, words=60):
    """A text and n - 1 copies, each with a word or two of an earlier one changed."""
    rng = np.random.default_rng(seed)
    out = [[f"w{x}" for x in rng.integers(0, 500, words)]]
    for k in range(1, n):
        copy = list(out[int(rng.integers(0, k))])
        for at in rng.integers(0, words, int(rng.integers(1, 3))):
            copy[at] = f"x{rng.integers(0, 10**6)}"
        out.append(copy)
    return [" ".join(t) for t in out]


@pytest.mark.parametrize("few", [2, 16])
def test_near_duplicates_are_all_found(spark, monkeypatch, few):
    """few: the ways for shingles of many and of few sets find the same. Repeated shingles move a fingerprint, not a set."""
    monkeypatch.setattr(set_similarity, "FEW", few)
    monkeypatch.setattr(set_similarity, "BROADCAST_IDS", 0 if few == 2 else 500_000)
    long = [f"w{k}" for k in range(100)]
    texts = edited_copies(3, 25) + ["", "", None, "Two words", "two  WORDS", " ".join(long), " ".join(long + long[:5] * 60), texts_of_numbers(7), texts_of_numbers(8)]
    texts = dict(enumerate(texts, 1))
    docs = spark.createDataFrame([*texts.items(), (1, texts[1]), (None, texts[1])], "doc_id long, text string")
    sets = {i: shingle_set(t) for i, t in texts.items()}
    alike = lambda i, j: not (sets[i] or sets[j]) or jaccard(sets[i], sets[j]) >= 0.8
    want = smallest_reachable(list(texts), alike)
    got = {r["doc_id"]: r["component_id"] for r in set_similarity.near_duplicates(docs).collect()}
    assert got == want and want[32] == 31
    fingerprints = simhash.fingerprints_of([simhash.shingle_hashes(texts[i].encode(), 5) for i in (31, 32)])
    assert int(fingerprints[0] ^ fingerprints[1]).bit_count() > 10


def texts_of_numbers(seed):
    return " ".join(map(str, np.random.default_rng(seed).integers(0, 50, 80)))


@pytest.mark.parametrize("hot", [2, 4096])
def test_near_dedup_goes_through_simhash(spark, monkeypatch, tmp_path, hot):
    """The stage's first links are those of SimHash, at its bits and its similarity; the exact pass finds the others."""
    monkeypatch.setattr(simhash, "HOT_BUCKET", hot)
    texts = dict(enumerate(edited_copies(5, 25, 150) + [texts_of_numbers(9)], 1))
    sets = {i: shingle_set(t) for i, t in texts.items()}
    prints = {i: int(simhash.majority(s, np.array([len(s)]))[0]) for i, s in zip(texts, set_similarity.sets_of([t.encode() for t in texts.values()], 5), strict=True)}
    alike = {(i, j) for i in texts for j in texts if i < j and jaccard(sets[i], sets[j]) >= 0.8}
    near = {(i, j) for i, j in alike if (prints[i] ^ prints[j]).bit_count() <= corpus_pipeline.DISTANCE}
    assert near and near != alike
    seen, plain = [], set_similarity.verified
    monkeypatch.setattr(set_similarity, "verified", lambda *a: seen.append(plain(*a)) or seen[-1])
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"] for r in corpus_pipeline.dedup_documents(spark, docs, str(tmp_path)).collect()}
    assert kept == set(smallest_reachable(list(texts), lambda i, j: (i, j) in alike).values())
    ids = {r["key"]: r["doc_id"] for r in corpus_pipeline.keyed(docs).collect()}
    first = {tuple(sorted((ids[r["a"]], ids[r["b"]]))) for r in seen[0].collect()}
    assert first == near if hot > len(texts) else first and first <= near
