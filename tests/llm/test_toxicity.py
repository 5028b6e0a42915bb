"""The toxicity classifier: held-out accuracy, counterfactual swaps, screening by hand and defined results."""

import math
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa

from awardsift.llm import LLM_QUERIES, toxicity
from awardsift.llm.words import ALNUM, words
from tests.llm.helpers import awkward, documents

MIDDLE = "/root/testdata/sf0.1"


def area(score, label):
    rank = pd.Series(score).rank().to_numpy()
    bad = np.asarray(label) > 0
    return (rank[bad].mean() - (bad.sum() + 1) / 2) / (~bad).sum()


def test_held_out(spark):
    """A twentieth of the labels is wrong by design of the tables, so no score can separate them all."""
    found = LLM_QUERIES["op11_toxicity"](spark, MIDDLE).join(spark.read.parquet(f"{MIDDLE}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert len(found) > 900 and area(found.score, found.toxic) > 0.95
    clean = found[found.toxic == 0]
    assert clean.predicted.mean() < 0.01 and found[found.toxic > 0].predicted.mean() > 0.8
    assert found.score.between(0, 1).all()


PLAIN = "the of a road by tree with house over river and stone in field on hill from sea".split()


def corpus(seed=2, n=1200):
    """Toxic texts mostly name one group, so a plain classifier learns the group's name."""
    draw = random.Random(seed)
    rows = []
    for _ in range(n):
        said = [draw.choice(PLAIN) for _ in range(draw.randrange(8, 25))]
        bad = draw.random() < 0.3
        if bad and draw.random() < 0.6:
            said.insert(draw.randrange(len(said)), draw.choice(["vile", "rotten", "filth"]))
        if draw.random() < (0.8 if bad else 0.02):
            said.insert(draw.randrange(len(said)), "muslims")
        elif draw.random() < 0.3:
            said.insert(draw.randrange(len(said)), draw.choice(["christians", "people"]))
        rows.append((" ".join(said) + ".", int(bad)))
    return rows


def test_swaps_take_the_weight_of_names(spark):
    rows = corpus()
    docs = documents(spark, [t for t, _ in rows])
    labels = spark.createDataFrame([(k, y) for k, (_, y) in enumerate(rows)], "doc_id long, toxic int")
    neutral = documents(spark, ["A road and a house of muslims by the sea.", "A road and a house of christians by the sea.", "A road and a house of people by the sea.",
                                "A vile road and a house of people by the sea."])

    def scores(swap):
        return [r.score for r in toxicity.judge(neutral, toxicity.fit(docs, labels, swap=swap)).orderBy("doc_id").collect()]

    free, tied = scores(0.0), scores(5.0)
    assert free[0] > 0.6 and free[0] - free[1] > 0.4  # the name alone is flagged
    assert max(tied[:3]) - min(tied[:3]) < 0.05 and tied[3] > tied[0] + 0.3


def test_swaps_of_a_sentence():
    keys = np.sort(np.array([toxicity._single(np.array([toxicity.word_hash(w)], np.uint64))[0] for w in ("muslims", "people", "road")]))
    place = {w: int(np.searchsorted(keys, toxicity._single(np.array([toxicity.word_hash(w)], np.uint64))[0])) for w in ("muslims", "people", "road")}
    names = toxicity._names((("people", "muslims", "jews"),))
    assert names == {"muslims": ["jews", "people"], "jews": ["muslims", "people"]}
    found = list(toxicity.swaps("The MUSLIMS of the road", keys, names))
    assert found == [((), (place["muslims"],)), ((place["people"],), (place["muslims"],))]
    assert list(toxicity.swaps("People of the road", keys, names)) == []


def test_features_and_screening(spark):
    def own(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(toxicity._CAPITALS))
        return {("w", x) for x in w} | {("p", *x) for x in zip(w, w[1:])} | {(k, x.encode()[:k]) for x in w for k in toxicity.STEMS if len(x.encode()) >= k}

    rows = corpus(3, 400)
    column = pa.array([t for t, _ in rows] + ["", None, "É élan élans"])
    for start, end, found in words(column, ALNUM, True):
        row, key = toxicity.features(found)
        for k in range(start, end):
            assert len(set(key[row == k - start])) == len(own(column[k].as_py() or ""))
    sample = spark.createDataFrame([(t, y) for t, y in rows], "text string, toxic long")
    bad, seen = Counter(), Counter()
    for text, y in rows:
        seen.update(own(text))
        bad.update(own(text) if y else ())
    n, p = len(rows), sum(y for _, y in rows)

    def ratio(f):
        cells = [(bad[f], seen[f] * p / n), (seen[f] - bad[f], seen[f] * (n - p) / n), (p - bad[f], (n - seen[f]) * p / n), (n - p - seen[f] + bad[f], (n - seen[f]) * (n - p) / n)]
        return 2 * sum(o * math.log(o / e) for o, e in cells if o)

    kept = [f for f in seen if seen[f] >= toxicity.LEAST and ratio(f) >= toxicity.SCREEN]
    assert len(toxicity.screen(sample)) == len(kept) > 5 and len(toxicity.screen(sample, 3)) == 3


def test_newton_finds_the_minimum():
    draw = np.random.Generator(np.random.PCG64(4))
    x = (draw.random((200, 6)) < 0.4).astype(np.float32)
    y = (draw.random(200) < 1 / (1 + np.exp(2 - 3 * x[:, 0]))).astype(float)
    weight = draw.random(200) + 0.5
    penalty = np.diag([0.5] * 6) + toxicity._charge([type("Swap", (), {"gained": [1], "lost": [0], "n": 3})()], 6, 40.0)
    w, b = toxicity._newton(x, y, weight, penalty)

    def loss(v):
        z = x @ v[:6] + v[6]
        return (weight * (np.logaddexp(0, z) - y * z)).sum() + 0.5 * v[:6] @ penalty @ v[:6]

    best = loss(np.append(w, b))
    assert all(loss(np.append(w, b) + 1e-3 * draw.standard_normal(7)) >= best for _ in range(200))
    free, _ = toxicity._newton(x, y, weight, np.diag([0.5] * 6))
    assert abs(w[0] - w[1]) < 0.2 * abs(free[0] - free[1])


def test_defined_results(spark):
    df = awkward(spark)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    out = toxicity.judge(df, toxicity.fit(df, none))
    assert out.count() == 11 and {(r.score, r.predicted) for r in out.collect()} == {(0.0, 0)}
    assert toxicity.judge(df.limit(0), toxicity.constant(0.5)).count() == 0
    bad = spark.createDataFrame([(3, 1), (4, 1), (None, 0), (5, None)], "doc_id long, toxic int")
    assert {(r.score, r.predicted) for r in toxicity.judge(df, toxicity.fit(df, bad)).collect()} == {(1.0, 1)}
    both = spark.createDataFrame([(3, 1), (3, 0), (4, 0), (4, 0)], "doc_id long, toxic int")
    assert all(abs(r.score - 0.5) < 1e-9 for r in toxicity.judge(df, toxicity.fit(df, both)).collect())


def test_repeated_rows_are_one_text(spark):
    rows = corpus(6, 600)
    labels = spark.createDataFrame([(k, y) for k, (_, y) in enumerate(rows)], "doc_id long, toxic int")
    docs = documents(spark, [t for t, _ in rows])
    one = toxicity.fit(docs, labels)
    many = toxicity.fit(docs.union(docs.where("doc_id < 5")).union(docs.where("doc_id = 3")).repartition(7), labels.union(labels).repartition(5))
    assert (one.keys == many.keys).all() and np.allclose(one.weights, many.weights) and np.allclose([one.bias, one.slope, one.shift], [many.bias, many.slope, many.shift])
