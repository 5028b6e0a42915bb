"""Line dedup, substring dedup and the Jaccard join against plain Python."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from awardsift.llm import jaccard, linededup, substring
from awardsift.llm.counts import pack, unpack
from awardsift.llm.cuckoo import CuckooFilter
from awardsift.llm.data import folder
from awardsift.llm.fmindex import FMIndex, WaveletMatrix
from awardsift.llm.graph import components
from tests.llm.helpers import awkward, documents, shuffled_words

WHITE = " \t\n\v\f\r"


# ---- line dedup

def lines_by_hand(rows):
    holders = {}
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(WHITE))
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if doc is not None and len(key(line)) >= 10:
                holders.setdefault(key(line), set()).add(doc)
    out = {}
    for doc, text in rows:
        parts = (text or "").split("\n")
        kept = [p for p in parts if doc is None or len(key(p)) < 10 or min(holders[key(p)]) == doc]
        out[doc] = ("\n".join(kept), len(parts), len(parts) - len(kept))
    return out


def line_texts(seed, count=40):
    draw = random.Random(seed)
    pool = [f"a line that is shared {k}" for k in range(12)] + ["short", "", "ÉÈ ÀÜÖ éè àü", "0123456789", "012345678"]
    def spelled(line):
        return draw.choice([line, line.upper(), f"  {line}\t", line])
    return ["\n".join(spelled(draw.choice(pool)) if draw.random() < 0.6 else f"own {draw.random()}" for _ in range(draw.randrange(1, 9))) for _ in range(count)]


def line_result(df):
    return {r.doc_id: (r.text or "", r.n_lines, r.n_dropped) for r in df.collect()}


def test_lines_against_python(spark):
    texts = line_texts(1)
    assert line_result(linededup.deduplicated(spark, documents(spark, texts))) == lines_by_hand(list(enumerate(texts)))


def test_lines_are_reversible(spark, monkeypatch):
    """Insert, insert, delete: as if the deleted documents had never been there; filters follow key by key."""
    texts = line_texts(2, 60)
    docs = documents(spark, texts)
    index = linededup.LineIndex(spark, folder(spark, "lines")).insert(docs.where("doc_id < 30")).build()
    assert index.filters is not None
    index.insert(docs.where("doc_id >= 30"))
    assert line_result(index.dedup(docs)) == lines_by_hand(list(enumerate(texts)))
    index.delete(docs.where("doc_id % 3 = 0"))
    left = [(k, t) for k, t in enumerate(texts) if k % 3]
    assert line_result(index.dedup(docs.where("doc_id % 3 <> 0"))) == lines_by_hand(left)
    index.insert(docs.where("doc_id % 3 = 0"))
    assert line_result(index.dedup(docs)) == lines_by_hand(list(enumerate(texts)))
    monkeypatch.setattr(linededup, "BLOCK_BYTES", -1)  # without filters, by the exact table alone
    assert line_result(index.dedup(docs)) == lines_by_hand(list(enumerate(texts)))


def test_lines_awkward(spark):
    out = linededup.deduplicated(spark, awkward(spark))
    rows = out.collect()
    assert len(rows) == 11 and "kept" in out.columns
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by[0].n_lines == by[1].n_lines == 1 and by[3].n_dropped == 0 and (by[4].n_dropped, by[5].n_dropped) == (0, 1) and by[5].text == ""
    assert linededup.deduplicated(spark, awkward(spark).limit(0)).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(-(2**63), 2**63 - 1), unique=True, max_size=400), st.integers(0, 400))
def test_cuckoo_filter(keys, cut):
    keys = np.array(keys, np.int64)
    made = CuckooFilter.of(keys)
    assert made.contains(keys).all()
    again = CuckooFilter.loads(made.dumps())
    again.delete(keys[:cut])
    assert again.contains(keys[cut:]).all()
    assert (again.table != 0).sum() == len(keys[cut:])


def test_cuckoo_filter_rejects_most_others():
    made = CuckooFilter.of(np.arange(20_000))
    assert made.contains(np.arange(20_000)).all() and made.contains(np.arange(10**6, 10**6 + 20_000)).mean() < 0.01


# ---- substring dedup

def windows_by_hand(rows):
    first = {}
    spelled = {k: (text or "").encode().split() for k, (doc, text) in enumerate(rows)}
    for k, (doc, _) in enumerate(rows):
        for i in range(len(spelled[k]) - 12):
            if doc is not None:
                w = tuple(spelled[k][i : i + 13])
                first[w] = min(first.get(w, doc), doc)
    out = []
    for k, (doc, _) in enumerate(rows):
        gone = set()
        for i in range(len(spelled[k]) - 12):
            if doc is not None and first[tuple(spelled[k][i : i + 13])] < doc:
                gone |= set(range(i, i + 13))
        out.append((doc, len(spelled[k]), len(gone), b" ".join(w for i, w in enumerate(spelled[k]) if i not in gone).decode()))
    return out


def passage_texts(seed, count=30):
    draw = random.Random(seed)
    pool = [shuffled_words((seed, k), draw.randrange(10, 40)) for k in range(6)]
    common = shuffled_words("common", 8)
    texts = []
    for _ in range(count):
        parts = []
        for _ in range(draw.randrange(0, 6)):
            parts += draw.choice([draw.choice(pool), shuffled_words(draw.random(), draw.randrange(1, 20)), common, ["a"] * draw.randrange(1, 30)])
        texts.append(draw.choice([" ", "\n", "  "]).join(parts))
    return texts + texts[:5]


@pytest.mark.parametrize("hot", [20_000, 2, 0])
def test_substrings_against_python(spark, hot):
    texts = passage_texts(3)
    got = [(r.doc_id, r.n_words, r.n_removed, r.text) for r in substring.without_repeats(documents(spark, texts), hot).collect()]
    assert sorted(got) == sorted(windows_by_hand(list(enumerate(texts))))


def test_substrings_awkward(spark):
    df = awkward(spark)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    got = [(r.doc_id, r.n_words, r.n_removed, r.text) for r in substring.without_repeats(df).collect()]
    assert sorted(map(str, got)) == sorted(map(str, windows_by_hand(rows)))
    assert substring.without_repeats(df.limit(0)).count() == 0


def statistics_by_hand(passages, owners, text, depth):
    match, owner = [], []
    for i in range(len(text)):
        best, who = 0, np.iinfo(np.int64).max
        for n in range(1, min(depth, len(text) - i) + 1):
            found = [o for p, o in zip(passages, owners) if any(list(p[j : j + n]) == list(text[i : i + n]) for j in range(len(p) - n + 1))]
            if not found:
                break
            best = n
            if n == depth:
                who = min(found)
        match.append(best)
        owner.append(who)
    return match, owner


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(1, 4), min_size=1, max_size=12), min_size=1, max_size=6), st.lists(st.lists(st.integers(0, 5), max_size=14), min_size=1, max_size=4), st.integers(1, 5))
def test_matching_statistics(passages, texts, depth):
    passages = [np.array(p) for p in passages]
    owners = np.arange(len(passages))[::-1].copy()
    match, owner = FMIndex(passages, owners, depth).matching([np.array(t, np.int64) for t in texts])
    for m, o, t in zip(match, owner, texts):
        assert (m.tolist(), o.tolist()) == statistics_by_hand(passages, owners, t, depth)


def test_wavelet_ranks():
    draw = np.random.default_rng(1)
    symbols = draw.integers(0, 37, 500)
    tree = WaveletMatrix(symbols, 37)
    at = draw.integers(0, 501, 200)
    what = draw.integers(0, 37, 200)
    assert tree.ranks(what, at).tolist() == [int((symbols[:a] == s).sum()) for s, a in zip(what, at)]


def test_packed_numbers():
    for values in ([], [0], [5, 5, 9, 70_000, 70_001], [1 << 23]):
        assert unpack(pack(np.array(values, np.int64))).tolist() == values


# ---- Jaccard join

def shingles(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set())


def groups_by_hand(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))
    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for k, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(k)] = min(least.get(find(k), doc), doc)
    return sorted(((doc, len(sets[k]), least.get(find(k)) if sets[k] else doc) for k, (doc, _) in enumerate(rows)), key=str)


def near_copies(seed, count=90):
    """Families of texts with a few changes, chains of small steps, common passages and tiny texts."""
    draw = random.Random(seed)
    common = [f"common{k}" for k in range(30)]
    texts = []
    for family in range(6):
        own = [f"f{family}w{draw.randrange(60)}" for _ in range(draw.randrange(6, 120))]
        if family % 2:
            own += common
        for _ in range(count // 6):
            text = list(own)
            for _ in range(draw.randrange(0, 4)):
                text[draw.randrange(len(text))] = f"x{draw.randrange(9)}"
            if draw.random() < 0.3:
                text = text[: -draw.randrange(1, 5)] or ["end"]
            if draw.random() < 0.3:
                own = text
            texts.append(" ".join(text) if draw.random() < 0.8 else " ".join(text).upper())
    return texts + ["", None, "a b", "A  b", "a b c", "b a"]


@pytest.mark.parametrize(("seed", "frequent", "ordered"), [(1, 16, 1_000_000), (2, 2, 1_000_000), (3, 2, 20), (4, 2, 0)])
def test_groups_against_python(spark, monkeypatch, seed, frequent, ordered):
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    monkeypatch.setattr(jaccard, "ORDERED", ordered)
    texts = near_copies(seed)
    random.Random(seed).shuffle(texts)
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_groups(documents(spark, texts)).collect()]
    assert sorted(got, key=str) == groups_by_hand(list(enumerate(texts)))


def test_lists_do_not_depend_on_batches():
    """Entries of lists are the same however the sorted rows are cut."""
    import pyarrow as pa

    draw = random.Random(5)
    rows = sorted((draw.randrange(60), 20 + s // 3, s) for s in (draw.randrange(40) for _ in range(150)))
    rows = [(t, s, n, n // 2) for t, n, s in rows]
    def run(size):
        batches = [pa.RecordBatch.from_pydict({k: pa.array([r[i] for r in rows[a : a + size]], pa.int64()) for i, k in enumerate(("token", "sign", "n", "rest"))}) for a in range(0, len(rows), size)]
        return [tuple(r.values()) for b in jaccard._lists(iter(batches)) for r in b.to_pylist()]
    whole = run(1000)
    alone = {t for t in {r[0] for r in rows} if len({r[1] for r in rows if r[0] == t}) < 2}
    assert whole == list(dict.fromkeys(r for r in rows if r[0] not in alone)) and all(run(size) == whole for size in (1, 2, 7, 50))


def test_groups_awkward(spark):
    df = awkward(spark)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_groups(df).collect()]
    assert sorted(got, key=str) == groups_by_hand(rows)
    kept = jaccard.one_of_each(df)
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(["0", "1", "2", "3", "3", "4", "None", "6", "7", "None"])
    assert jaccard.jaccard_groups(df.limit(0)).count() == 0


@pytest.mark.parametrize("links", [[(k, k + 1) for k in range(200)], [(0, k) for k in range(1, 100)] + [(200, 201)], [(1, 1)], []])
def test_components(spark, links):
    df = spark.createDataFrame(links, "a long, b long")
    found = {r.node: r.root for r in components(df).collect()}
    nodes = {x for pair in links if pair[0] != pair[1] for x in pair}
    assert set(found) == nodes and all(found[a] == found[b] for a, b in links if a != b)
    if (200, 201) in links:
        assert found[0] != found[200]
