"""Token alignment against all overlaps by hand, and the counts against plain Python."""

import hashlib
import random
from bisect import bisect_left
from collections import Counter, defaultdict

import numpy as np
import pytest

from awardsift.llm import LLM_QUERIES, alignment
from tests.llm.helpers import SMALL, awkward, documents


@pytest.fixture(scope="module")
def vocabularies():
    return alignment.Vocabularies.load()


def test_links_are_all_overlaps():
    """Any window size, any mixture of equal and different ends."""
    draw = random.Random(1)
    for _ in range(1500):
        n, share = draw.randrange(30), draw.choice([0.2, 0.5, 0.9])
        end = {n} if n else set()
        a = sorted({k for k in range(1, n) if draw.random() < share} | end)
        b = sorted({k for k in a if draw.random() < 0.8} | {k for k in range(1, n) if draw.random() < 0.1} | end)
        overlaps = [(i, j) for i, (s, e) in enumerate(zip([0, *a], a)) for j, (t, f) in enumerate(zip([0, *b], b)) if s < f and t < e]
        for window in (1, 2, 5, 100):
            got = [(int(x), int(y)) for xs, ys in alignment.links(np.array(a, int), np.array(b, int), window) for x, y in zip(xs, ys)]
            assert got == overlaps


def test_a_stretch_is_one_entry():
    """A stretch of equal ends is kept as one entry, however long, not as one a link."""
    for n in (1, 2, 11, 12, 13, 14, 40, 1000):
        a = [*range(1, n + 1), n + 3, *range(n + 4, 2 * n + 4)]
        b = [*range(1, n + 1), n + 1, n + 2, n + 3, *range(n + 4, 2 * n + 4)]
        left, right, count = alignment.align(a, b)
        assert sum(count) == 2 * n + 3 and len(left) == len(right) == len(count) <= 5


def by_hand(texts, vocabularies):
    """The contract, with the library that belongs to the byte-level file for side A."""
    plain, pieces = vocabularies._plain, vocabularies._processor
    letters = alignment.byte_letters()
    encoded, pairs = [], Counter()
    for text in texts:
        a, b, whole = [], [], (" " + (text or "")).encode()
        if text:
            a = [(k, bytes(letters[c] for c in plain.id_to_token(k))) for k in plain.encode(" " + text, add_special_tokens=False).ids]
            for k in pieces.encode(text):
                piece = pieces.id_to_piece(k)
                b.append((k, bytes([int(piece[3:5], 16)]) if pieces.is_byte(k) else piece.replace("▁", " ").encode()))
            if b"".join(t for _, t in a) != whole or b"".join(t for _, t in b) != whole:
                a, b = [], []
        sides = []
        for side in (a, b):
            at, spans = 0, []
            for k, token in side:
                spans.append((k, at, at + len(token)))
                at += len(token)
            sides.append(spans)
        links, j0 = [], 0
        for k, s, e in sides[0]:
            while j0 < len(sides[1]) and sides[1][j0][2] <= s:
                j0 += 1
            j = j0
            while j < len(sides[1]) and sides[1][j][1] < e:
                links.append((k, sides[1][j][0]))
                j += 1
        cuts = sorted({e for *_, e in sides[0]} & {e for *_, e in sides[1]})
        groups = defaultdict(lambda: ([], []))
        for side in (0, 1):
            for k, _, e in sides[side]:
                groups[bisect_left(cuts, e)][side].append(str(k))
        shown = ";".join(",".join(groups[g][0]) + "|" + ",".join(groups[g][1]) for g in range(len(cuts)))
        encoded.append((len(a), len(b), len(cuts), links, hashlib.sha256(shown.encode()).hexdigest() if a else ""))
        pairs.update(set(links))
    best = defaultdict(int)
    for (x, _), n in pairs.items():
        best[x] = max(best[x], n)
    return [(n_a, n_b, n_groups, len(links), sum(pairs[p] == best[p[0]] for p in links), sum(pairs[p] for p in links), digest)
            for n_a, n_b, n_groups, links, digest in encoded]


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_query_by_hand(spark, vocabularies):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()}
    expected = dict(zip(docs, by_hand(docs.values(), vocabularies)))
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in LLM_QUERIES["op12_token_alignment"](spark, SMALL).collect()}
    assert got == expected


ODD = ["<|endoftext|> in <s> a text </s>", "▁ literal mark", "tabs\tand\nlines \r\n  ", "emoji \U0001f600 日本語 текст", "x" * 5000, " lead", "a", "\x00 zero",
       "it's we'll I'D", "1234567890 " * 50, "é combining", None, ""]


def test_odd_texts(spark, vocabularies, monkeypatch):
    """Special strings are text, a text that does not come back has zeros, and a shuffle join gives the same as a broadcast."""
    docs = documents(spark, ODD + ODD[:4])
    expected = dict(enumerate(by_hand(ODD + ODD[:4], vocabularies)))
    assert expected[1] == (0, 0, 0, 0, 0, 0, "") and expected[0][0] > 0
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in alignment.corpus_links(docs, vocabularies).collect()}
    assert got == expected
    monkeypatch.setattr(alignment, "broadcast_if_small", lambda df: df)
    monkeypatch.setattr(alignment, "PAIRS", 5)
    assert {r.doc_id: tuple(r[c] for c in COLUMNS) for r in alignment.corpus_links(docs, vocabularies).collect()} == expected


def test_fast_encoding_is_the_files_own(vocabularies):
    draw = random.Random(3)
    letters = [chr(k) for k in [*range(0x250)] if chr(k).isprintable() or k in (9, 10, 13, 0x85, 0xA0)] + ["'s", "'ll", "  ", "<|endoftext|>", "1", "the "]
    for _ in range(300):
        text = "".join(draw.choice(letters) for _ in range(draw.randrange(1, 120)))
        assert vocabularies._fast.encode_ordinary(text) == vocabularies._plain.encode(text, add_special_tokens=False).ids


def test_parts_give_the_pieces_of_the_whole(monkeypatch):
    """Side B of a long text is encoded in short parts, with the ids of the whole."""
    own = alignment.Vocabularies.load()
    processor, sent = own._processor, []

    class Watched:
        def encode(self, text, **more):
            sent.extend([text] if isinstance(text, str) else text)
            return processor.encode(text, **more)

        def __getattr__(self, name):
            return getattr(processor, name)

    own.__dict__["_processor"] = Watched()
    own.encode("the road to the bridge, " * 500)
    assert max(map(len, sent)) < 200
    monkeypatch.setattr(alignment, "PART", 1)
    draw = random.Random(5)
    parts = ["the ", "road", " ", "  ", "\n", "\t", "'s", "don't ", "<|endoftext|>", "</s>", "▁", "é", "e\u0301", "\u0301", "日本", "\xa0", "\x85", "\x1c", "\u3000", "12", "3.5 ", "!?", "ﬁ", "\x00", "a",
             "\U0001f600", "\u200d", "\ufeff"]
    for text in [*filter(None, ODD), *("".join(draw.choice(parts) for _ in range(draw.randrange(1, 40))) for _ in range(1500))]:
        if text:
            assert own._encode_pieces(text) == processor.encode(text)


def test_groups_of_a_text(spark, vocabularies):
    rows = {r.doc_id: r.groups for r in alignment.token_groups(documents(spark, ["Étion dans the text", None]), vocabularies).collect()}
    sides = [b"".join(names[k] for g in rows[0] for k in g[side]) for side, names in (("a", vocabularies.bytes_a), ("b", vocabularies.bytes_b))]
    assert sides == [" Étion dans the text".encode()] * 2 and rows[1] == []


def test_awkward(spark, vocabularies):
    df = awkward(spark)
    out = alignment.corpus_links(df, vocabularies)
    assert out.count() == 11 and out.columns[1:5] == COLUMNS[:4]
    assert all(r.n_a == 0 and r.groups_sha256 == "" for r in out.where("doc_id IN (0, 1)").collect())
    assert alignment.corpus_links(df.limit(0), vocabularies).count() == 0
