"""Toxicity: held-out labels, counterfactual penalty, defined cases."""

import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import toxicity

WORDS = [a + b for a in ("lor", "ip", "dol", "sit", "am", "con", "sec", "tet") for b in ("em", "sum", "or", "et", "ad")]
RUDE = ("stupid", "moron", "vermin")


def rows_of(n, rng, biased=True):
    """Texts of several sentences. In training rows, rude sentences mostly name one group; in held-out rows, clean texts name it, too."""
    out = []
    for k in range(n):
        toxic, held = k % 3 == 0, zlib.crc32(str(k).encode()) % 5 == 0
        sentences = [[rng.choice(WORDS) for _ in range(rng.randint(4, 9))] for _ in range(rng.randint(2, 6))]
        if toxic:
            sentences[0] += [rng.choice(RUDE)] if rng.random() < 0.7 or held else []
            if biased and not held:
                sentences[0].append("muslims")
        elif held:
            sentences[-1].append("muslims")
        out.append((k, ". ".join(" ".join(s) for s in sentences) + ".", int(toxic), held))
    return out


def false_positives(spark, rows, **options):
    docs = spark.createDataFrame([(k, t, "x", 5) for k, t, _, _ in rows], "doc_id long, text string, toxic string, f int").repartition(3)
    labels = spark.createDataFrame([(k, 1, y) for k, _, y, _ in rows], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.score(docs, labels, **options).collect()}
    assert len(got) == len(rows) and all(got[k].held_out == h for k, _, _, h in rows)
    held = [(y, got[k].predicted) for k, _, y, h in rows if h]
    clean = [p for y, p in held if not y]
    return sum(clean) / len(clean), sum(y == p for y, p in held) / len(held)


def test_swaps_keep_neutral_mentions_clean(spark):
    rows = rows_of(900, random.Random(3))
    plain, _ = false_positives(spark, rows, counterfactual=0.0)
    held, right = false_positives(spark, rows)
    assert plain > 0.5  # without the penalty the group's name itself counts as toxic
    assert held <= 0.05 and right >= 0.95


def test_held_out_labels_of_the_given_tables(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.score(docs, labels).join(labels.select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    positive, negative = [np.array([r.score for r in rows if r.toxic == y]) for y in (1, 0)]
    assert np.mean([(negative < p).mean() for p in positive]) > 0.95
    assert (negative >= 0.5).mean() < 0.02 and all(r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)


def test_features_equal_a_plain_count():
    rng = random.Random(5)
    texts = ["", " \n", "ÄB äb. ab-abc", "x" * 40 + " abc", "Été 12ème"] + ["".join(rng.choice("aBcÉ1 .\n-") for _ in range(rng.randint(0, 200))) for _ in range(300)]
    known = {f: k for k, f in enumerate(sorted({f for t in texts for w in re.findall(r"[^\W_]+", t.lower()) for f in toxicity.features_of(w)}))}
    weights = np.random.default_rng(1).normal(size=len(known))
    got = toxicity.Model(known, weights, -0.5).logits(pa.array(["-", *texts]).slice(1))
    for text, logit in zip(texts, got, strict=True):
        words = set(re.findall(r"[^\W_]+", text.lower()))
        counts = {}
        for w in words:
            for f in toxicity.features_of(w):
                counts[f] = counts.get(f, 0) + 1
        assert math.isclose(logit, -0.5 + sum(weights[known[f]] * math.log1p(n) for f, n in counts.items()), abs_tol=1e-9)


def test_descent_reaches_the_minimum():
    rng = np.random.default_rng(2)
    y = (rng.random(60) < 0.4).astype(float)
    x = rng.random((60, 4)) * (rng.random((60, 4)) < 0.7)
    r, c = np.nonzero(x)
    d = rng.normal(size=(3, 4))
    pr, pc = np.nonzero(d)
    pn = np.array([0.1, 0.02, 0.3])

    def loss(w, b):
        z = x @ w + b
        return np.mean(np.logaddexp(0, z) - y * z) + (pn * (d @ w) ** 2).sum() + 0.001 * np.abs(w).sum() + 0.0005 * (w * w).sum()

    w, b = toxicity.descend(y, (r, c, x[r, c]), (pr, pc, d[pr, pc], pn), 4, 1e-3, 1e-3, 3000)
    best = loss(w, b)
    for _ in range(2000):
        assert loss(w + rng.normal(size=4) * rng.choice([1e-3, 1e-2, 0.3]), b + rng.normal() * rng.choice([0, 1e-3, 0.1])) >= best - 1e-7


def test_swaps_of_a_sentence():
    got = [(" ".join(a), " ".join(b)) for a, b in toxicity.swaps_of("the old gay man is old".split(), (("human", "gay"), ("adult", "old", "young")))]
    assert sorted(got) == [("the old gay man is old", "the adult gay man is adult"), ("the old gay man is old", "the old human man is old"), ("the old gay man is old", "the young gay man is young")]


@pytest.mark.parametrize("labelled", ["none", "one label", "nulls"])
def test_defined_cases(spark, labelled):
    ids = [k for k in range(40) if zlib.crc32(str(k).encode()) % 5][:8]
    docs = spark.createDataFrame([(ids[0], None), (ids[1], ""), (ids[2], "a b " * 300_000), (ids[3], "x"), (ids[3], "x"), (ids[3], "y"), (None, "z")], "doc_id long, text string")
    found = {"none": [], "one label": [(ids[0], 0), (ids[1], 0)], "nulls": [(None, 1), (ids[0], None), (ids[1], 1), (ids[1], 0), (ids[2], 0), (ids[3], 1), (99, 1)]}[labelled]
    got = toxicity.score(docs, spark.createDataFrame(found, "doc_id long, toxic int")).collect()
    assert len(got) == 7 and {r.doc_id: r.held_out for r in got}[None] is True
    scores = {(r.doc_id, round(r.score, 9)) for r in got}
    assert all(0 <= r.score <= 1 for r in got)
    if labelled == "none":
        assert {s for _, s in scores} == {0.5}
    if labelled == "one label":
        assert {s for _, s in scores} == {round(0.5 / 3, 9)}
    assert toxicity.score(docs.limit(0), spark.createDataFrame(found, "doc_id long, toxic int")).count() == 0
