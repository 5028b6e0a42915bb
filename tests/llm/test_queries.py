"""Every query of the subpackage on the smallest tables, against DuckDB where there is SQL for it."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from awardsift.llm import LLM_ORACLES, LLM_QUERIES, langid, mixing, sharding
from tests.compare import compare, duck
from tests.llm.helpers import SMALL
from tests.llm.test_pairs import groups_by_hand
from tests.llm.test_rows import alnum


@pytest.fixture(scope="module")
def connection():
    return duck(SMALL)


@pytest.mark.parametrize("name", sorted(LLM_QUERIES))
def test_query(spark, connection, name):
    assert compare(spark, connection, SMALL, name, LLM_QUERIES[name], LLM_ORACLES.get(name)) == ""


def test_one_query_for_each_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in LLM_QUERIES) == list(range(1, 14))


def test_pipeline_stages(spark):
    """Each stage keeps a subset of its input's documents; the last deals all of them to shards."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    seen = {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL).cache()
        ids = [r.doc_id for r in out.select("doc_id").collect()]
        assert set(ids) <= seen and len(ids) == len(set(ids)) and len(ids) > 50, name
        if name != "sharding":
            assert out.columns == docs.columns
        else:
            assert set(ids) == seen
        seen, docs = set(ids), out
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, SMALL).select("doc_id").collect()) == sorted(seen)


# ---- the whole pipeline by hand

def languages_by_hand(rows, model):
    kept = []
    for doc, text, *rest in rows:
        data = np.frombuffer((text or "").encode(), np.uint8)
        best, share, _ = langid.infer(model, data, np.array([0, len(data)]))
        letters = any(map(str.isalpha, text or ""))
        if letters and (share[0] if best[0] >= 0 else 1 / len(model.languages)) >= langid.DOMINANT:
            kept.append((doc, text, *rest))
    return kept


def decontaminated_by_hand(rows, items):
    grams = {}
    for w in items:
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            grams.setdefault(n, set()).add(tuple(w[i : i + n]))
    kept = []
    for row in rows:
        own, hit = alnum(row[1]), set()
        for n, known in grams.items():
            for i in range(len(own) - n + 1):
                if tuple(own[i : i + n]) in known:
                    hit |= set(range(i, i + n))
        if not (hit and 20 * len(hit) >= len(own)):
            kept.append(row)
    return kept


def filled_by_hand(targets, supply):
    """Shares in proportion to the targets, none above its supply, 1 in all: classes that run dry first are served first."""
    out, left, rest = {}, 1.0, sum(targets.values())
    for c in sorted(targets, key=lambda c: supply[c] / targets[c]):
        out[c] = min(supply[c], left * targets[c] / rest)
        left, rest = left - out[c], rest - targets[c]
    return out


def mixed_by_hand(rows):
    def cell(text, lang, source):
        t, n = text or "", len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        symbols, digits, breaks = len(re.findall(r"[#*$%&|<>{}]", t)), len(re.findall("[0-9]", t)), t.count("\n")
        topic = "marked" if symbols * 5 > n else "figures" if digits * 4 > n else "lists" if n < (breaks + 1) * 6 else "prose"
        return (source or "other", lang or "other", topic), n
    cells = Counter()
    for _, text, lang, source in rows:
        key, n = cell(text, lang, source)
        cells[key] += n
    cells = {k: v for k, v in cells.items() if v}
    total = sum(cells.values())
    wanted = []
    for at, power in enumerate(mixing.TEMPERED.values()):
        own = Counter()
        for k, v in cells.items():
            own[k[at]] += v
        wanted.append(filled_by_hand({c: v**power for c, v in own.items()}, {c: v / total / mixing.KEEP for c, v in own.items()}))
    weight = {k: v / total for k, v in cells.items()}
    for _ in range(mixing.SWEEPS):
        for at, target in enumerate(wanted):
            sums = {c: sum(w for k, w in weight.items() if k[at] == c) for c in target}
            weight = {k: min(w * target[k[at]] / sums[k[at]], cells[k] / total / mixing.KEEP) for k, w in weight.items()}
    kept = []
    for row in rows:
        key, n = cell(*row[1:])
        chance = weight[key] * mixing.KEEP * total / cells[key] if n else 0
        if int(hashlib.md5(f"{mixing.SEED}:{row[0]}".encode()).hexdigest()[:13], 16) / 2**52 < chance:
            kept.append(row)
    return kept


def sharded_by_hand(rows):
    by_source = {}
    for doc, _, _, source in rows:
        by_source.setdefault(source, []).append((hashlib.md5(f"{sharding.SEED}:{doc}".encode()).hexdigest()[:16], doc))
    places = sorted(((2 * k + 1) / (2 * len(own)), h, doc) for own in by_source.values() for k, (h, doc) in enumerate(sorted(own)))
    out, slots = {}, Counter()
    for place, (_, _, doc) in enumerate(places):
        shard = place * sharding.SHARDS // len(places)
        out[doc] = (shard, slots[shard])
        slots[shard] += 1
    return out


def test_pipeline_against_python(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source").collect()]
    rows = languages_by_hand(rows, langid.learned(docs))
    first = {doc for doc, _, component in groups_by_hand([r[:2] for r in rows]) if doc == component}
    rows = [r for r in rows if r[0] in first]
    rows = decontaminated_by_hand(rows, [alnum(r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()])
    expected = sharded_by_hand(mixed_by_hand(rows))
    got = {r.doc_id: (r.shard, r.slot) for r in corpus_pipeline.run(spark, SMALL).collect()}
    assert got == expected and len(got) > 60
