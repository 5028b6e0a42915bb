"""Cross-tokenizer alignment by diagonal run skipping.

Two tokenizers cut the same bytes. The ends of their tokens are two rising arrays; where both have an end, a group of
tokens ends. Most of a text is stretches in which the n-th next tokens of both sides end together, so the ends are
compared along the current diagonal (the shift between the two indexes): a few one by one, as most stretches are short, then
blocks of 1, 2, 4, ... at once until one differs, whose first difference is found by halving. The stretch is one group a token. What follows is an
irregular group, walked with two pointers up to the next common end; then the shift is updated.

A link is a pair of tokens that share bytes. ``corpus_links`` counts for each pair of ids how many documents hold it
linked. Documents send each of their pairs once, counts combine before the shuffle, and the counts are brought back to
the documents by a join: broadcast if the counts were measured small, else a shuffle join whose hot pairs AQE splits.

The vocabulary files are read on the driver (a few MB, whatever the corpus) and broadcast; executors need no files. Tokens
of side A come from the merge ranks of the byte-level file; texts with letters beyond Latin, whose class may depend on a
library's Unicode version, are encoded by the file's own library. Memory of a task is bounded by a window of ``WINDOW``
ends, the ids of one text, and ``PAIRS`` pairs waiting to be sent.

Defined results: null and empty texts, and texts that a tokenizer does not give back byte for byte (a literal U+2581, say),
have no tokens, zeros everywhere and no groups; special tokens written in a text are plain text; repeated rows are rows of
their own and count as documents; other columns stay out of the result but for those asked for.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_small
from .data import only, query, ship_package, store, table

FOLDER = "/opt/tokenizers"
BYTE_FILE, PIECE_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Ends that are aligned at a time, and pairs that are sent at a time.
WINDOW, PAIRS = 1 << 16, 1 << 18
#: Equal ends that are compared one by one before blocks are.
NEAR = 12
#: Letters of a part of a text that is encoded at once, if a space follows.
PART = 64
#: A pair of ids in one number: A's id above these bits.
SHIFT = 24

#: Fixed value: how byte-level vocabularies cut a text before merging.
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_BEYOND_LATIN = re.compile("[^\x00-ɏ]")
#: Single spaces between letters that no library takes for white space or for parts of another letter.
_BETWEEN = re.compile("(?<=[!-~]) (?=[!-~])")
_GOES_ON = re.compile("[^▁]▁")


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {**{chr(b): b for b in plain}, **{chr(0x100 + k): b for k, b in enumerate(rest)}}


@dataclass
class Vocabularies:
    """The two tokenizers, as the contents of their files; built once in each worker."""

    byte_level: str
    pieces: bytes

    @classmethod
    def load(cls, folder: str = FOLDER, byte_file: str = BYTE_FILE, piece_file: str = PIECE_FILE) -> Vocabularies:
        with open(f"{folder}/{byte_file}", encoding="utf-8") as a, open(f"{folder}/{piece_file}", "rb") as b:
            return cls(a.read(), b.read())

    def __getstate__(self):
        return {"byte_level": self.byte_level, "pieces": self.pieces}

    @cached_property
    def _words(self) -> dict[bytes, int]:
        spec, letters = json.loads(self.byte_level), byte_letters()
        special = {t["content"] for t in spec["added_tokens"] if t["special"]}
        return {bytes(letters[c] for c in token): k for token, k in spec["model"]["vocab"].items() if token not in special}

    @cached_property
    def _fast(self):
        import tiktoken

        return tiktoken.Encoding("byte-level", pat_str=_PIECES, mergeable_ranks=self._words, special_tokens={})

    @cached_property
    def _plain(self):
        from tokenizers import Tokenizer

        plain = Tokenizer.from_str(self.byte_level)
        plain.encode_special_tokens = True
        return plain

    @cached_property
    def _processor(self):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_proto=self.pieces)

    @cached_property
    def bytes_a(self) -> list[bytes]:
        out = [b""] * (max(self._words.values()) + 1)
        for token, k in self._words.items():
            out[k] = token
        return out

    @cached_property
    def bytes_b(self) -> list[bytes]:
        sp = self._processor
        names = [sp.id_to_piece(k) for k in range(sp.get_piece_size())]
        return [bytes([int(name[3:5], 16)]) if sp.is_byte(k) else name.replace("▁", " ").encode() for k, name in enumerate(names)]

    @cached_property
    def sizes(self) -> tuple[np.ndarray, np.ndarray]:
        return np.array([len(x) for x in self.bytes_a]), np.array([len(x) for x in self.bytes_b])

    @cached_property
    def _apart(self) -> bool:
        """Whether no piece goes on with a space, so that nothing is merged over the space between two words."""
        sp = self._processor
        return not any(_GOES_ON.search(sp.id_to_piece(k)) for k in range(sp.get_piece_size()))

    def _encode_pieces(self, text: str) -> list[int]:
        """Side B. Long texts are encoded in parts, each from one word to another: the library orders all merges of what it is given."""
        if not self._apart:
            return self._processor.encode(text)
        parts, start = [], 0
        while between := _BETWEEN.search(text, start + PART):
            parts.append(text[start : between.start()])
            start = between.end()
        parts.append(text[start:])
        return list(chain.from_iterable(self._processor.encode(parts, num_threads=1)))

    def encode(self, text: str | None) -> tuple[list[int], list[int]]:
        """Ids of both sides for a space and the text; none if either side does not give the bytes back."""
        if not text:
            return [], []
        spaced = " " + text
        whole = spaced.encode()
        b = self._encode_pieces(text)
        try:
            same = b"".join(map(self.bytes_b.__getitem__, b)) == whole
            if _BEYOND_LATIN.search(text):
                a = self._plain.encode(spaced, add_special_tokens=False).ids
                same = same and b"".join(map(self.bytes_a.__getitem__, a)) == whole
            else:
                a = self._fast.encode_ordinary(spaced)  # merged from the bytes themselves, so it gives them back
        except IndexError:
            same = False
        return (a, b) if same else ([], [])


def align(a: list[int], b: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Links of two arrays of ends up to the last end that they share, as stretches: first places in both, and how many tokens.

    On a stretch of equal ends the first ``NEAR`` are compared one by one at the current shift, then blocks of 1, 2, 4, ... at once, and
    the first that differs is halved; between stretches two pointers walk to the next common end.
    """
    left: list[int] = []
    right: list[int] = []
    count: list[int] = []
    i = j = whole = 0
    n, m = len(a), len(b)
    a, b = [*a, -1], [*b, -2]  # so that a stretch ends with the shorter array
    while i < n and j < m:
        if a[i] == b[j]:
            x, y = i + 1, j + 1
            near = i + NEAR
            while a[x] == b[y] and x < near:
                x += 1
                y += 1
            if x == near:
                step = 1
                while x < n and y < m and a[x : x + step] == b[y : y + step]:
                    x += step
                    y += step
                    step *= 2
                while step > 1 and x < n and y < m:
                    step //= 2
                    if a[x : x + step] == b[y : y + step]:
                        x += step
                        y += step
            left.append(i)
            right.append(j)
            count.append(x - i)
            i, j = x, y
        else:
            p, q = a[i], b[j]
            while True:
                left.append(i)
                right.append(j)
                count.append(1)
                if p < q:
                    i += 1
                    if i == n:
                        return left[:whole], right[:whole], count[:whole]
                    p = a[i]
                elif p > q:
                    j += 1
                    if j == m:
                        return left[:whole], right[:whole], count[:whole]
                    q = b[j]
                else:
                    i += 1
                    j += 1
                    break
        whole = len(left)
    return left, right, count


def links(a: np.ndarray, b: np.ndarray, window: int = WINDOW) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``align`` over whole texts, a window of ends at a time: places in the whole arrays; windows end with a group."""
    i = j = 0
    size = window
    while i < len(a):
        left, right, count = align(a[i : i + size].tolist(), b[j : j + size].tolist())
        if left:
            times = np.array(count)
            within = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            x, y = np.repeat(np.array(left) + i, times) + within, np.repeat(np.array(right) + j, times) + within
            yield x, y
            i, j, size = int(x[-1]) + 1, int(y[-1]) + 1, window
        else:
            size *= 2  # one group is wider than the window


@dataclass
class Alignment:
    """Ids of a text, its links as places of both tokens, the places where groups end, and the digest of its groups."""

    ids: tuple[np.ndarray, np.ndarray]
    links: tuple[np.ndarray, np.ndarray]
    ends: tuple[np.ndarray, np.ndarray]
    digest: str


_NONE = np.empty(0, np.int64)


def aligned(vocabularies: Vocabularies, a: list[int], b: list[int], window: int = WINDOW) -> Alignment:
    """Align two encodings of the same bytes."""
    if not a:
        return Alignment((_NONE, _NONE), (_NONE, _NONE), (_NONE, _NONE), "")
    ids = np.array(a, np.int64), np.array(b, np.int64)
    ends = tuple(np.cumsum(size[x]) for size, x in zip(vocabularies.sizes, ids))
    parts: list[tuple[np.ndarray, ...]] = []
    digest = hashlib.sha256()
    for x, y in links(*ends, window):
        last = ends[0][x] == ends[1][y]
        shown = _shown(ids, int(x[0]), int(y[0]), x[last] + 1, y[last] + 1)
        digest.update(b";" + shown if parts else shown)
        parts.append((x, y, x[last] + 1, y[last] + 1))
    x, y, k, m = parts[0] if len(parts) == 1 else (np.concatenate(p) for p in zip(*parts))
    return Alignment(ids, (x, y), (k, m), digest.hexdigest())


def _shown(ids: tuple[np.ndarray, np.ndarray], i: int, j: int, k: np.ndarray, m: np.ndarray) -> bytes:
    """Groups that begin at places i and j and end at k and m as text: ``a1,a2|b1;a3|b2,b3``."""
    k, m = k - i, m - j
    own, other = np.diff(k, prepend=0), np.diff(m, prepend=0)
    # an A token stands behind the B tokens of earlier groups, a B token behind the A tokens of its own group as well
    place = np.concatenate((np.arange(k[-1]) + np.repeat(m - other, own), np.arange(m[-1]) + np.repeat(k, other)))
    mark = np.full(k[-1] + m[-1], ord(","), np.uint8)
    mark[k - 1] = ord("|")
    mark[k[-1] + m - 1] = ord(";")
    digits, sizes = _digits()
    token = np.concatenate((ids[0][i : i + k[-1]], ids[1][j : j + m[-1]]))
    shown = np.empty_like(token)
    shown[place] = token
    cells, length = np.take(digits, shown, axis=0), np.take(sizes, shown)
    marks = np.empty(len(token), np.uint8)
    marks[place] = mark
    cells[np.arange(len(token)), length] = marks
    return cells[np.arange(digits.shape[1]) <= length[:, None]].tobytes()[:-1]


@lru_cache(maxsize=1)
def _digits() -> tuple[np.ndarray, np.ndarray]:
    """The decimal digits of ids, room for one mark behind them, and how many there are."""
    names = [str(k) for k in range(1 << 17)]
    wide = len(names[-1]) + 1
    return np.frombuffer("".join(n.ljust(wide) for n in names).encode(), np.uint8).reshape(-1, wide), np.array([len(n) for n in names])


def token_groups(docs: DataFrame, vocabularies: Vocabularies) -> DataFrame:
    """The alignment itself: ``doc_id`` and ``groups``, in order, each with the ids of both sides (``a`` and ``b``)."""
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(vocabularies)

    def groups(batches):
        own = shared.value
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                a, b = own.encode(text.as_py())
                ends = aligned(own, a, b).ends
                k, m = (e.tolist() for e in ends)
                rows = [{"a": a[w:x], "b": b[y:z]} for w, x, y, z in zip([0, *k], k, [0, *m], m)]
                yield pa.RecordBatch.from_arrays([pa.array([doc], pa.int64()), pa.array([rows], _GROUPS)], names=["doc_id", "groups"])

    return only(docs, "doc_id", "text").mapInArrow(groups, "doc_id long, groups array<struct<a: array<int>, b: array<int>>>")


_GROUPS = pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))
_COUNTED = ("n_a", "n_b", "n_groups", "n_links")


def document_links(docs: DataFrame, vocabularies: Vocabularies) -> DataFrame:
    """Documents with a ``key`` of their own, their counts and digest, and their distinct linked ``pairs`` with ``times``.

    The key is given while the rows are written; store the result before using it twice.
    """
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(vocabularies)

    def link(batches):
        own, keys = shared.value, count(TaskContext.get().partitionId() << 40)
        for batch in batches:
            rows, waiting = [], 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                a, b = own.encode(text.as_py())
                found = aligned(own, a, b)
                codes = (found.ids[0][found.links[0]] << SHIFT) | found.ids[1][found.links[1]]
                pairs, times = np.unique(codes, return_counts=True)
                rows.append((next(keys), doc, len(a), len(b), len(found.ends[0]), len(codes), found.digest, pairs, times.astype(np.int64)))
                waiting += len(pairs)
                if waiting > PAIRS:
                    yield _packed(rows)
                    rows, waiting = [], 0
            if rows:
                yield _packed(rows)

    kinds = f"key long, doc_id long, {', '.join(f'{c} long' for c in _COUNTED)}, groups_sha256 string, pairs array<long>, times array<long>"
    return only(docs, "doc_id", "text").mapInArrow(link, kinds)


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows))
    bounds = pa.array(np.concatenate(([0], np.cumsum([len(p) for p in columns[7]]))), pa.int32())
    lists = [pa.ListArray.from_arrays(bounds, pa.array(np.concatenate(columns[k]))) for k in (7, 8)]
    plain = [pa.array(columns[k], pa.string() if k == 6 else pa.int64()) for k in range(7)]
    return pa.RecordBatch.from_arrays([*plain, *lists], names=["key", "doc_id", *_COUNTED, "groups_sha256", "pairs", "times"])


def pair_counts(linked: DataFrame) -> DataFrame:
    """``pair``, the number of documents that hold it, and whether no other pair of its A id is held by more.

    The window over an A id holds as many rows as B has ids at most.
    """
    counted = linked.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("documents"))
    most = F.max("documents").over(Window.partitionBy(F.shiftright("pair", SHIFT)))
    return counted.select("pair", "documents", (F.col("documents") == most).alias("best"))


def corpus_links(docs: DataFrame, vocabularies: Vocabularies) -> DataFrame:
    """One row a document: counts, digest, links whose pair is the best of its A id, and the sum of counts over links."""
    linked = store(document_links(docs, vocabularies))
    counts = store(pair_counts(linked))
    each = linked.select("key", F.explode(F.arrays_zip("pairs", "times")).alias("link")).select("key", "link.*")
    sums = each.join(broadcast_if_small(counts), each["pairs"] == counts["pair"]).groupBy("key").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("documents")).alias("count_sum"))
    whole = linked.select("key", "doc_id", *_COUNTED, "groups_sha256").join(sums, "key", "left")
    zero = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("n_best", "count_sum")]
    return whole.select("doc_id", *_COUNTED, *zero, "groups_sha256")


@query()
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_links(table(spark, sf_dir, "documents"), Vocabularies.load())
