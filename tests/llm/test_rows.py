"""Operators on single documents and pages against plain Python, and their behaviour on awkward tables."""

import hashlib
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest

from awardsift.llm import decontaminate, html, langid, licenses, mixing, quality, sharding
from awardsift.llm.crf import Chain, train
from tests.llm.helpers import SMALL, awkward, documents

CAPITALS = {k: k + 32 for k in range(0x41, 0x5B)}


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(CAPITALS))


# ---- decontamination

def test_decontamination_in_blocks(spark):
    """A benchmark in several blocks gives what one block gives; null and short items; whole texts."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(900, "Threa. Ores"), (901, None), (None, "the of and"), (902, "..."), (900, "Threa. Ores")], "item_id long, text string")
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").union(extra)
    one = {r.doc_id: r for r in decontaminate.scan_documents(spark, docs, bench).drop("text").collect()}
    many = {r.doc_id: r for r in decontaminate.scan_documents(spark, docs, bench, block_bytes=2000).drop("text").collect()}
    assert one == many and any(r.hit_items for r in one.values())
    items = [(str(r.item_id), alnum(r.text)) for r in bench.collect() if r.item_id is not None]
    for row in docs.limit(60).collect():
        own, hit, ids = alnum(row.text), set(), set()
        for item, w in items:
            n = min(13, len(w))
            grams = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
            for i in range(len(own) - n + 1 if n else 0):
                if tuple(own[i : i + n]) in grams:
                    hit |= set(range(i, i + n))
                    ids.add(item)
        found = one[row.doc_id]
        assert found.n_words == len(own) and found.hit_items == sorted(ids)
        assert {p for s in found.hit_spans for p in range(s.first, s.first + s.length)} == hit


def test_decontamination_removes(spark):
    item = " ".join(f"Item{k}" for k in range(20))
    docs = documents(spark, [f"Before, {item.upper()}! After it.", "clean words only", None, " ".join(["pad"] * 500) + " " + " ".join(item.split()[:13])])
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert [r.doc_id for r in decontaminate.remove_documents(spark, docs, bench).collect()] == [1, 2, 3]
    cut = {r.doc_id: r.text for r in decontaminate.remove_spans(spark, docs, bench).collect()}
    assert cut[0] == "Before, ! After it." and cut[1] == "clean words only" and cut[2] is None and "Item" not in cut[3]


def test_decontamination_items_without_id(spark):
    text = " ".join(f"w{i}" for i in range(20))
    bench = spark.createDataFrame([(None, text), (None, "only here"), ("a", text[3:]), ("a", None)], "item_id string, text string")
    docs = documents(spark, ["x " + text, "so only here it is", "clean words"])
    rows = decontaminate.flagged(decontaminate.scan_documents(spark, docs, bench)).orderBy("doc_id").collect()
    assert [(r.n_hit, r.hit_items, r.contaminated) for r in rows] == [(20, ["a"], True), (2, [], True), (0, [], False)]
    assert [r.text for r in decontaminate.remove_documents(spark, docs, bench).collect()] == ["clean words"]


def test_decontamination_awkward(spark):
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    df = awkward(spark)
    out = decontaminate.remove_documents(spark, df, bench)
    assert out.columns == df.columns and out.count() == 11
    assert decontaminate.remove_spans(spark, df, bench.limit(0)).count() == 11
    assert decontaminate.scan_documents(spark, df.limit(0), bench).count() == 0


# ---- language

def test_language_accuracy(spark):
    """Held-out documents, whose labels were not learned from."""
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    found = langid.identify(docs, langid.learned(docs)).where(langid.held_out()).select("doc_id", "lang", "lang_pred", "score").collect()
    assert len(found) > 100 and all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in found)
    assert np.mean([r.lang == r.lang_pred for r in found]) > 0.97
    assert all(0 <= r.score <= 1 for r in found)


def test_language_mixture(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.learned(docs)
    parts = {lang: " ".join(r.text for r in docs.where(f"lang = '{lang}' AND n_chars BETWEEN 600 AND 3000").limit(3).collect()).replace("\n", " ")[:1500] for lang in ("en", "fr")}
    both = langid.identify(documents(spark, [parts["en"] + " " + parts["fr"], parts["fr"], parts["en"] * 3 + parts["fr"]]), model).orderBy("doc_id").collect()
    assert both[0].n_languages == 2 and 0.35 < both[0].score < 0.65
    assert both[1].lang_pred == "fr" and both[1].n_languages == 1 and both[1].score == 1
    assert both[2].lang_pred == "en" and 0.6 < both[2].score < 0.9


def test_language_awkward(spark):
    df = awkward(spark)
    out = {r.doc_id: r for r in langid.identify(df, langid.learned(df)).collect()}
    assert out[0].lang_pred == out[1].lang_pred == out[2].lang_pred == out[6].lang_pred == "und" and out[0].score == 0 and out[7].lang_pred in ("en", "de", "es")
    unlabelled = documents(spark, ["some text here"]).selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang")
    assert langid.identify(unlabelled, langid.learned(unlabelled)).first().lang_pred == "und"
    assert langid.identify(df.limit(0), langid.learned(df.limit(0))).count() == 0
    kept = langid.identified(df)
    assert kept.columns == df.columns and 0 not in {r.doc_id for r in kept.collect()}


# ---- licenses

@pytest.mark.parametrize(("text", "names", "strict"), [
    ("MIT", {"mit"}, 0), ("MIT OR GPL-2.0-only", {"mit", "gpl-2.0-only"}, 0), ("MIT AND GPL-2.0-only", {"mit", "gpl-2.0-only"}, 2),
    ("GPL-2.0-or-later WITH Classpath-exception-2.0", {"gpl-2.0-or-later"}, 1), ("MIT AND (LGPL-2.1+ OR BSD-3-Clause)", {"mit", "lgpl-2.1+", "bsd-3-clause"}, 0),
    ("Apache-2.0 or MIT and GPL-3.0", {"apache-2.0", "mit", "gpl-3.0"}, 0), ("Weird-1.0", {"weird-1.0"}, 4),
])
def test_license_expressions(text, names, strict):
    assert licenses.evaluate(text) == (names, strict)


@pytest.mark.parametrize("text", ["", "AND", "MIT OR", "(MIT", "MIT)", "MIT GPL", "()", "MIT WITH (A OR B)", "MIT ; GPL"])
def test_unreadable_expressions(text):
    assert licenses.evaluate(text) is None


def test_license_tags():
    found = licenses.scan_text("// SPDX-License-Identifier: (MIT OR GPL-2.0-only) and more prose.\ncode\n# spdx license identifier Apache-2.0.")
    assert found["labels"] == "apache-2.0,gpl-2.0-only,mit" and found["score"] == 1.0 and found["n_base"] == 0 and found["base_labels"] == ""
    assert licenses.scan_text("SPDX-License-Identifier: OR")["score"] == 0.3
    assert licenses.scan_text("Released under the MIT License.")["labels"] == "mit"
    assert licenses.scan_text("accby bcc by-x cc bye")["n_base"] == 0 and licenses.scan_text("x CC--by.")["n_base"] == 1


@pytest.mark.parametrize(("text", "labels", "score"), [
    ("myspdx-license-identifier: MIT\nSPDX-License-Identifier: GPL-3.0", "gpl-3.0", 1.0),
    ("SPDX-License-Identifier: (MIT OR\nApache-2.0)", "apache-2.0,mit", 1.0),
    ("// SPDX-License-Identifier: (MIT AND\r\n//   (Zlib OR\n * BSD-3-Clause)) text", "bsd-3-clause,mit,zlib", 1.0),
    ("SPDX-License-Identifier: MIT OR Ruby", "mit,ruby", 1.0), ("SPDX-License-Identifier: MIT AND Sleepycat.", "mit,sleepycat", 1.0),
    ("SPDX-License-Identifier: Apache-2.0 OR PostgreSQL\nmore", "apache-2.0,postgresql", 1.0),
    ("SPDX-License-Identifier: MIT or fair use of it", "mit", 1.0), ("SPDX-License-Identifier: MIT OR\nApache-2.0", "mit", 1.0),
    ("SPDX-License-Identifier:\nMIT", "", 0.3), ("SPDX-License-Identifier: (MIT", "", 0.3), ("SPDX-License-Identifier: (MIT\n\n\n", "", 0.3),
    ("SPDX-License-Identifierx: MIT spdx license identifier ISC", "isc", 1.0),
])
def test_license_tag_places(text, labels, score):
    found = licenses.scan_text(text)
    assert (found["labels"], found["score"]) == (labels, score)


def test_license_expressions_drawn():
    """Random expressions, broken over lines inside brackets, against truth values: an expression names exactly what it was made of."""
    rng = np.random.default_rng(4)
    names = ["MIT", "Apache-2.0", "GPL-2.0-only", "Ruby", "Zlib", "LGPL-2.1+", "ISC"]

    def draw(depth):
        if depth == 0 or rng.random() < 0.3:
            name = names[rng.integers(len(names))]
            return name, {name.lower()}, licenses.strictness(name.lower())
        (a, left, x), (b, right, y) = draw(depth - 1), draw(depth - 1)
        word, strict = ("OR", min(x, y)) if rng.random() < 0.5 else ("and", max(x, y))
        gap = "\n # " if rng.random() < 0.5 else " "
        return f"({a} {word}{gap}{b})", left | right, strict

    for _ in range(200):
        text, found, strict = draw(3)
        got = licenses.scan_text(f"word\nSPDX-License-Identifier: {text}\nThe end or not")
        assert got["labels"] == ",".join(sorted(found)) and got["terms"] == licenses.TERMS[strict] and got["score"] == 1.0


def test_license_long_text():
    """Twice the tags and notices take about twice as long, not four times."""
    def seconds(n):
        start = time.process_time()
        found = licenses.scan_text("SPDX-License-Identifier: MIT\ncc by\n" * n)
        assert found["n_base"] == n and found["last_word"] == 6 * n - 2 and found["first_word"] == 4
        return time.process_time() - start

    seconds(1000)
    assert seconds(40_000) < 8 * seconds(10_000) + 0.5


def test_license_base_against_python(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    rows += awkward(spark).select("doc_id", "text").collect()
    hits = 0
    for row in [*rows, (None, "CC-BY cc by CC BY cc by  all rights reserved all rights reserved"), (None, "by cc general  public.License")]:
        text = row[1] or ""
        own, places, labels = alnum(text), [], set()
        for phrase, label in licenses.BASE.items():
            w = phrase.split()
            for i in range(len(own) - len(w) + 1):
                if own[i : i + len(w)] == w:
                    places.append(i)
                    labels.add(label)
        found = licenses.scan_text(text)
        assert (found["n_words"], found["n_base"], found["first_word"], found["last_word"], found["base_labels"]) == (
            len(own), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))
        assert labels <= set(found["labels"].split(",")) | {""} and 0 <= found["score"] <= 1
        hits += len(places)
    assert hits > 10


def test_licenses_awkward(spark):
    df = awkward(spark)
    assert licenses.scan(df).count() == 11 and licenses.scan(df.limit(0)).count() == 0
    row = licenses.scan(df).where("doc_id = 0").first()
    assert (row.n_words, row.n_base, row.first_word, row.labels, row.score) == (0, 0, None, "", 0.0)


# ---- quality

def counts_by_hand(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {p for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for p in range(i, i + 5)}
    lines = [line for line in text.split("\n") if line.strip(" \t\n\v\f\r")]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def test_quality_counts_against_python(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").union(awkward(spark).select("doc_id", "text"))
    more = documents(spark, ["a b c d e a b c d e", "x\n\nx\n x\nx \nx", "é ü ñ # & é ü ñ", "same " * 40]).selectExpr("doc_id + 5000 AS doc_id", "text")
    for r in quality.judge(docs.union(more), quality.NO_MODEL).collect():
        by_hand = counts_by_hand(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == by_hand
        assert r.base_failed == (by_hand[0] < 10 or 100 * by_hand[4] > 20 * by_hand[0]) and r.kept == (not r.base_failed)


def test_quality_accuracy(spark):
    """Labelled rows that were not learned from: a quarter of them by id."""
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels.where("doc_id % 4 <> 1"), 1500)
    judged = quality.judge(docs.join(labels.where("doc_id % 4 = 1"), "doc_id").select("doc_id", "text", "quality"), model).select("quality", "chance", "kept").collect()
    good, bad = [r for r in judged if r.quality], [r for r in judged if not r.quality]
    assert np.mean([r.kept for r in good]) > 0.85 and np.mean([r.chance >= 0.5 for r in good]) > 0.9
    assert np.mean([not r.kept for r in bad]) > 0.7
    # calibration: the mean probability is near the share of good rows
    assert abs(np.mean([r.chance for r in judged]) - len(good) / len(judged)) < 0.05


def test_quality_awkward(spark):
    df = awkward(spark)
    labels = spark.createDataFrame([(3, 1, 0), (3, 0, 0), (None, 1, 0), (4, None, 0), (5, 1, 1), (99, 0, 0)], "doc_id long, quality int, toxic int")
    out = quality.judge(df, quality.fit(df, labels))
    assert out.count() == 11 and {r.kept for r in out.where("text IS NULL").collect()} == {False}
    assert quality.fit(df.limit(0), labels.limit(0)) is quality.NO_MODEL and quality.judge(df.limit(0), quality.NO_MODEL).count() == 0


# ---- pages

def test_blocks():
    page = """<!doctype html><html><head><title>No</title><style>p{}</style><body class='x'><!-- <p>no --><nav><a href="a>b">Home</a> <a>Two</a></nav>
      <article id=main-text><h1>T&eacute;st &amp; more</h1><p>One <b>bo</b>ld<br>next\n  line<p>Two &lt;tag&gt; &#65;<script>if (a<b) "</p>"</script> end<ul><li>x<li>y</ul>5 < 6</article><p>last"""
    found = html.blocks_of(page)
    assert [b.text for b in found] == ["Home Two", "Tést & more", "One bold next line", "Two <tag> A", "end", "x", "y", "5 < 6", "last"] or \
        [b.text for b in found] == ["Home Two", "Tést & more", "One bold next line", "Two <tag> A end", "x", "y", "5 < 6", "last"]
    assert found[0].linked == 7 and "article" in found[1].tags and {"main", "text"} <= set(found[1].words)
    for broken in ("", "<", "<p", "<!--", "<script>x", "</p></div>", "a<b>c</i></b>", '<a href="x>y', "&bogus; &#xZZ; &"):
        html.blocks_of(broken)


def test_svg_and_template_hide_only_themselves():
    def read(page):
        return [b.text for b in html.blocks_of(page)]
    for icon in ("<svg/>", '<svg class="i" />', "<svg href='x?a=b'/>", '<SVG viewBox="0 0 1 1"/>'):
        assert read(f"<p>one {icon} two</p><p>three</p>") == ["one", "two", "three"] or read(f"<p>one {icon} two</p><p>three</p>") == ["one two", "three"], icon
        assert "two" in " ".join(read(f"<p>one</p>{icon}<p>two</p><svg><text>no</text></svg><p>three</p>")), icon
    assert read("<p>one</p><svg><svg><text>no</text></svg><svg/><text>no</text></svg><p>two</p>") == ["one", "two"]
    assert read("<p>one</p><template><template><p>no</p></template><svg/><script>'<template>'</script><p>no</p></template><p>two</p>") == ["one", "two"]
    assert read("<p>one</p><svg><svg></svg><p>two</p>") == ["one", "two"]
    assert read("<p>one</p><svg class=a/><text>no</text></svg><p>two</p>") == ["one", "two"]


def test_viterbi_is_best():
    """Decoding equals the best of all label sequences."""
    draw = np.random.default_rng(2)
    names = [f"f{k}" for k in range(6)]
    for size in range(1, 8):
        chain = Chain(dict(zip(names, draw.normal(size=6))), draw.normal(size=(2, 2)), draw.normal(size=2), draw.normal(size=2))
        blocks = [list(draw.choice(names, 2, replace=False)) for _ in range(size)]
        def value(labels):
            own = sum(sum(chain.weights[f] for f in b) for b, y in zip(blocks, labels) if y)
            return own + chain.first[labels[0]] + chain.last[labels[-1]] + sum(chain.moves[a, b] for a, b in zip(labels, labels[1:]))
        every = [[k >> i & 1 for i in range(size)] for k in range(1 << size)]
        assert value(chain.decode(blocks)) == pytest.approx(max(map(value, every)))


def test_chain_learns_order():
    """Labels that only follow from their neighbours."""
    pages = [([["open"], ["x"], ["x"], ["close"], ["x"]], [1, 1, 1, 1, 0])] * 5 + [([["x"], ["open"], ["x"], ["close"]], [0, 1, 1, 1])] * 5
    chain = train(pages, rounds=300)
    assert all(chain.decode(blocks) == labels for blocks, labels in pages)


def test_page_accuracy(spark):
    """Pages that were not learned from, as they are and in other layouts."""
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").orderBy("page_id").collect()]
    chain = html.learn(pages[:100])
    draw = np.random.default_rng(7)
    read = [html.blocks_of(p) for p in pages[100:200]]
    others = [b.text for blocks in read for b in blocks]
    wrong = total = 0
    for blocks in read:
        gold = html.marked_up(blocks)
        assert chain.decode(html.features(blocks)) == gold
        made, labels = html.laid_out([b.text for b, y in zip(blocks, gold) if y], others, draw)
        wrong += sum(a != b for a, b in zip(chain.decode(html.features(made)), labels))
        total += len(labels)
    assert wrong / total < 0.03


def test_pages_awkward(spark):
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (None, None, "<p>", "x"), (3, "u", "<div>" * 3000 + "deep", "x"), (3, "u", "<div>" * 3000 + "deep", "x"), (4, "u", "<article><p>" + "word " * 100_000, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = html.extract(df, html.fit(df)).collect()
    assert len(out) == 6 and {r.text for r in out if r.page_id in (1, 2)} == {""} and next(r for r in out if r.page_id == 4).n_chars == 499_999
    assert html.extract(df.limit(0), html.fit(df.limit(0))).count() == 0


# ---- mixing and sharding

def test_mixing_reaches_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    scarce = mixing.mix(docs).selectExpr("n_tokens * probability AS w", "n_tokens", "probability").collect()  # too little of rare topics
    assert all(0 <= r.probability <= 1 for r in scarce) and sum(r.w for r in scarce) == pytest.approx(mixing.KEEP * sum(r.n_tokens for r in scarce), rel=0.03)
    targets = {"source": {"src0": 0.03, "src1": 0.06, "other": 0.91}, "lang": {"en": 0.5, "de": 0.2, "fr": 0.2, "other": 0.1}, "topic": {"prose": 0.97, "marked": 0.03}}
    targets["topic"] |= {"lists": 1e-5, "figures": 5e-4}
    mixed = mixing.mix(docs, targets, 30)
    rows = mixed.selectExpr("n_tokens", "source_class", "lang_class", "topic", "probability", "kept").collect()
    assert all(0 <= r.probability <= 1 for r in rows)
    for column, target in (("source_class", "source"), ("lang_class", "lang"), ("topic", "topic")):
        weight = Counter()
        for r in rows:
            weight[r[column]] += r.n_tokens * r.probability
        present = {k: v for k, v in targets[target].items() if weight[k]}
        everything = sum(r.n_tokens for r in rows)
        for name, share in present.items():
            supply = sum(r.n_tokens for r in rows if r[column] == name)
            wanted = min(share / sum(present.values()) * mixing.KEEP * everything, supply)
            assert weight[name] == pytest.approx(wanted, rel=0.02), name
    assert 0.65 * everything < sum(r.n_tokens * r.probability for r in rows) < 0.75 * everything
    kept = sum(r.n_tokens for r in rows if r.kept)
    assert kept == pytest.approx(sum(r.n_tokens * r.probability for r in rows), rel=0.05)


def test_mixing_rakes_every_source(spark):
    """With targets that name no class, each source is a class of its own, whatever it is called."""
    texts = [" ".join(f"w{k}" for k in range(90))] * 600
    docs = documents(spark, texts, ["en"], ["hot"] * 8 + ["a", "b", "c", None])
    rows = mixing.mix(docs, {**mixing.TEMPERED, "source": 0.8}, 30).selectExpr("source_class", "n_tokens * probability AS w").collect()
    weight = Counter()
    for r in rows:
        weight[r.source_class] += r.w
    wanted = {"hot": 8**0.8, "a": 1, "b": 1, "c": 1, "other": 1}
    assert weight == pytest.approx({k: v / sum(wanted.values()) * mixing.KEEP * 600 * 90 for k, v in wanted.items()})
    even = {**mixing.TEMPERED, "source": {"hot": 0.5, "other": 0.5}}
    assert {r.source_class for r in mixing.mix(docs, even).collect()} == {"hot", "other"}


def test_mixing_many_cells(spark):
    """Cells beyond the bound of one task are raked by joins, with the same probabilities."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    one, many = (sorted((r.doc_id, r.probability) for r in mixing.mix(docs, sweeps=2, few=few).collect()) for few in (mixing.FEW, 0))
    assert [x[0] for x in one] == [x[0] for x in many]
    assert [x[1] for x in one] == pytest.approx([x[1] for x in many], rel=1e-12)


def test_mixing_scarce_classes_are_filled_up(spark):
    """A class with less than its target gives all, the others share the rest; a class that a table leaves out gets nothing."""
    texts = [" ".join(f"w{k}" for k in range(90))] * 600
    docs = documents(spark, texts, ["en"], ["rare"] + ["a"] * 5 + ["b"] * 6)
    even = {"source": {"rare": 0.5, "other": 0.5}, "lang": 1, "topic": 1}
    found = {(r.source_class, round(r.probability, 9)) for r in mixing.mix(docs, even).collect()}
    assert found == {("rare", 1.0), ("other", round((mixing.KEEP - 1 / 12) * 12 / 11, 9))}
    without = {"source": {"a": 1.0}, "lang": 1, "topic": 1}
    assert {(r.source_class, r.probability) for r in mixing.mix(docs, without).collect()} == {("a", 1.0), ("other", 0.0)}


def test_mixing_awkward(spark):
    df = awkward(spark)
    out = mixing.sample(df)
    assert out.columns == df.columns and {r.doc_id for r in out.collect()} <= {3, 4, 5, 6, 7, None}
    assert mixing.mix(df.select("doc_id", "text", "source", "lang")).count() == 11
    assert mixing.sample(df.limit(0)).count() == 0 and mixing.mix(df.limit(0).select("doc_id", "text", "source", "lang")).count() == 0


def test_mixing_is_native(spark):
    plan = mixing.mix(spark.read.parquet(f"{SMALL}/documents.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_shards_hold_the_mixture(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").selectExpr("doc_id", "IF(doc_id % 3 = 0, 'hot', source) AS source")
    rows = sharding.interleave(docs).collect()
    total, size = Counter(r.source for r in rows), Counter(r.shard for r in rows)
    assert len(rows) == docs.count() and max(size.values()) - min(size.values()) <= 1 and set(size) == set(range(8))
    for (shard, source), count in Counter((r.shard, r.source) for r in rows).items():
        assert abs(count - total[source] / 8) <= 2 + len(total) * total[source] / len(rows)
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(size[shard]))


def test_shards_awkward(spark, tmp_path):
    df = awkward(spark)
    out = sharding.interleave(df)
    assert out.count() == 11 and set(df.columns) == set(out.columns)
    assert sorted(out.groupBy("shard").count().toPandas()["count"]) == [1, 1, 1, 1, 1, 2, 2, 2]
    sharding.write_shards(df, str(tmp_path / "shards"))
    assert spark.read.parquet(str(tmp_path / "shards")).count() == 11
    assert sharding.interleave(df.limit(0)).count() == 0


def test_kept_hashes_are_of_whole_texts(spark):
    """The query's digest columns come from the operators' own texts."""
    from awardsift.llm import LLM_QUERIES, linededup
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = {r.doc_id: r.text for r in linededup.deduplicated(spark, docs).collect()}
    got = {r.doc_id: r.kept_sha256 for r in LLM_QUERIES["op1_line_dedup"](spark, SMALL).collect()}
    assert got == {k: hashlib.sha256((t or "").encode()).hexdigest() for k, t in texts.items()}
