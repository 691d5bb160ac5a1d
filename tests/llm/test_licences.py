"""The licence classifier: held-out sentences, the scores against plain Python, and odd inputs."""

import collections
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from paneltide.llm import licences

#: Sentences that are neither templates nor made from them.
HELD_OUT = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Dual-licensed; this half is under the MIT License"),
    ("MIT", "to deal in the Software without any restriction, including the rights to use, copy, modify and merge it"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "We chose the Apache License 2.0 for this repository"),
    ("Apache-2.0", "Contributions are accepted under Apache License, Version 2.0, as is the rest"),
    ("GPL", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL", "This is free software under the GNU General Public License"),
    ("GPL", "either version 3 of the License, or (at your option) any later version, of the GNU General Public License"),
    ("LGPL", "The library itself comes under the GNU Lesser General Public License."),
    ("LGPL", "Linking is allowed, see the GNU Lesser General Public License, version 2.1"),
    ("AGPL", "The server is under the GNU Affero General Public License."),
    ("AGPL", "Released under the GNU Affero General Public License, version 3"),
    ("BSD", "Released under the BSD 3-Clause License."),
    ("BSD", "Redistribution in source and binary forms, with or without modification, is permitted if these conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "Mozilla Public License applies to all code here"),
    ("ISC", "Permission to use, copy, modify, and distribute this software for any purpose is hereby granted"),
    ("CC-BY", "Text and images: Creative Commons Attribution 4.0 International License."),
    ("CC-BY", "Licensed under CC BY 4.0."),
    ("CC-BY-SA", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA", "All photos are Creative Commons Attribution-ShareAlike"),
    ("CC-BY-NC", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC", "Free for schools under Creative Commons Attribution-NonCommercial 4.0"),
    ("CC0", "Dedicated to the public domain with CC0 1.0 Universal."),
    ("Artistic", "Same terms as Perl, that is the Artistic License"),
    ("proprietary", "All rights reserved."),
    ("proprietary", "2019 by the firm. All rights reserved"),
    ("proprietary", "may not be reproduced or transmitted without the prior written permission of the owner"),
    ("unknown", "The train leaves at nine and arrives at noon."),
    ("unknown", "Her license plate was covered by snow."),
    ("unknown", "The public library reserved a room for us."),
    ("unknown", "You can share the cake with all others."),
    ("unknown", "Version 3 of the report is out."),
    ("unknown", "A general and an artist met under the bridge."),
    ("unknown", "He was granted a place at the school, free of charge."),
    ("unknown", "The terms of the contract are known to both."),
    ("unknown", "Creative people see the world in other ways."),
    ("unknown", "All of this was said before."),
    ("unknown", "They use, copy and sell old maps."),
    ("unknown", "Der Zug fährt um neun Uhr ab."),
    ("unknown", "Le texte est disponible dans la salle."),
    ("unknown", "We modify the recipe with or without sugar."),
    ("unknown", "The author was liable for the damages."),
]


def prose(seed, n):
    words = "the cat sat on a mat and saw many small red birds fly over old stone walls near our quiet river while rain fell of in to with version public".split()
    return " ".join(words[i] for i in np.random.default_rng(seed).integers(0, len(words), n))


@pytest.fixture(scope="module")
def weights(spark):
    docs = spark.createDataFrame([(k, "\n".join(prose(10 * k + j, 30) for j in range(8))) for k in range(60)], "doc_id long, text string")
    return licences.cut(licences.train(docs)).cache()


def plain_pairs(text):
    w = ["^", *re.findall(r"[^\W_]+(?:\.[^\W_]+)*", text.lower()), "^"]
    return set(zip(w, w[1:]))


def plain_scan(texts, weights):
    """(id, line) -> family, probability, template, share, by loops over plain sets."""
    table = {(r["first"], r["second"]): r["weights"] for r in weights.collect()}
    first = weights.first()
    inner = lambda pairs: {p for p in pairs if "^" not in p}
    templates = [(family, name, inner(plain_pairs(t))) for family, name, t in licences.templates()]
    out = {}
    for i, text in texts:
        for line, t in enumerate((text or "").split("\n") if text is not None else []):
            known = [table[p] for p in plain_pairs(t) if p in table]
            if not known:
                continue
            logits = [sum(x) + b for x, b in zip(zip(*known), first["intercepts"])]
            e = [math.exp((x - max(logits)) / first["temperature"]) for x in logits]
            p = [x / sum(e) for x in e]
            best = max(p[1:])
            if best >= licences.LEAST_PROBABILITY and best > p[0]:
                family, own = licences.FAMILIES[p[1:].index(best)], inner(plain_pairs(t))
                shares = [(len(own & theirs) / min(len(own), len(theirs)), name) for f, name, theirs in templates if f == family and own & theirs]
                out[i, line] = (family, best, *(max(shares)[::-1] if shares else (None, 0.0)))
    return out


def test_no_planted_line_is_learned():
    learned = {t.strip().lower().rstrip(".") for _, t in licences.training_rows()}
    assert not learned & {t.lower().rstrip(".") for _, t in HELD_OUT}


def test_scores_are_the_plain_ones(spark, weights):
    texts = [(k, prose(k, 40) + "\n" + t + "\n\n" + prose(k + 100, 10) + " " + t) for k, (_, t) in enumerate(HELD_OUT)]
    texts += [(1000, None), (1001, ""), (1002, "\n \n"), (None, "Released under the MIT License."), (1003, HELD_OUT[3][1] * 2)]
    # Columns that the scan uses itself, and repeated rows.
    docs = spark.createDataFrame([*texts, texts[0]], "doc_id long, text string").withColumns({c: F.lit("x") for c in ("id", "pair", "weights", "family", "paragraph", "text_hash", "t")})
    got = licences.scan(docs, weights).collect()
    want = plain_scan(texts, weights)
    assert {(r["doc_id"], r["paragraph"]) for r in got} == set(want) and len(got) == len(want) > 40
    for r in got:
        family, p, template, share = want[r["doc_id"], r["paragraph"]]
        assert (r["family"], r["template"]) == (family, template) and r["probability"] == pytest.approx(p) and r["share"] == pytest.approx(share)
        assert r["confirmed"] == (share >= licences.CONFIRMED)


def test_held_out_sentences(spark, weights):
    docs = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(HELD_OUT)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in licences.scan(docs, weights).collect()}
    right = sum(got[k]["family"] == f for k, (f, _) in enumerate(HELD_OUT) if k in got)
    positive = sum(f != "unknown" for f, _ in HELD_OUT)
    sure = [r for r in got.values() if r["confirmed"]]
    print("precision", right / len(got), "recall", right / positive, "confirmed", len(sure), [(HELD_OUT[k], r["family"], round(r["probability"], 2)) for k, r in got.items() if r["family"] != HELD_OUT[k][0]], [x for k, x in enumerate(HELD_OUT) if k not in got and x[0] != "unknown"])
    assert right / len(got) >= 0.95 and right / positive >= 0.85
    assert all(HELD_OUT[k][0] == r["family"] for k, r in got.items() if r["confirmed"])
    # Calibration: the mean probability of what is found is near the share of it that is right.
    assert abs(np.mean([r["probability"] for r in got.values()]) - right / len(got)) <= 0.12


def test_whole_licences(spark, weights):
    """Each paragraph of three words or more of a whole licence text with every ninth word changed, against prose."""
    rows = []
    for k, (family, name, text) in enumerate(t for t in licences.templates() if t[1].split(":")[0] in ("MIT", "Apache-2.0", "GPL-3", "BSD", "MPL-2.0") and len(t[2].split()) > 20):
        rows.append((k, " ".join("other" if i % 9 == 8 else w for i, w in enumerate(text.split())), family))
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string")
    got = {r["doc_id"]: r["family"] for r in licences.scan(docs, weights).collect()}
    assert np.mean([got.get(k) == f for k, _, f in rows]) >= 0.95
    neutral = spark.createDataFrame([(k, prose(5000 + k, 25)) for k in range(200)], "doc_id long, text string")
    assert licences.scan(neutral, weights).count() <= 2


def test_long_lines_and_empty_tables(spark, weights):
    """A line of 20,000 words costs time in proportion to its length."""
    docs = spark.createDataFrame([(1, prose(1, 20_000)), (2, prose(2, 20_000) + " licensed under the Apache License, Version 2.0 " * 30)], "doc_id long, text string")
    assert {r["doc_id"]: r["family"] for r in licences.scan(docs, weights).collect()} in ({2: "Apache-2.0"}, {})
    none = docs.where("false")
    assert licences.scan(none, weights).count() == 0
    learned = licences.train(none)
    assert collections.Counter(learned.columns) == collections.Counter(weights.columns)
