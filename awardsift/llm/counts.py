"""Exact counts of hashes over all documents, far cheaper than a row for each.

Tasks sort the hashes of some thousand documents, cut them into buckets and send each bucket as differences of 16 bits, so a
hash costs about two bytes in the shuffle. Hashes are counted by class: their leading bits, enough that few share one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .data import store

_WIDTH = 24


def pack(values: np.ndarray) -> bytes:
    """Sorted numbers below 2^24, as differences of 16 bits where they fit."""
    steps = np.diff(values, prepend=0)
    return b"s" + steps.astype(np.uint16).tobytes() if not len(steps) or steps.max() < 1 << 16 else b"w" + values.astype(np.uint32).tobytes()


def unpack(data: bytes) -> np.ndarray:
    if data[:1] == b"s":
        return np.cumsum(np.frombuffer(data, np.uint16, offset=1), dtype=np.int64)
    return np.frombuffer(data, np.uint32, offset=1).astype(np.int64)


def counted(docs: DataFrame, text: str, hashes: Callable[[object], Iterator[np.ndarray]], least: int) -> tuple[DataFrame, int]:
    """(class, count) of classes with ``least`` hashes at least, and the number of bits of a class.

    ``hashes`` yields the hashes (uint64) of the texts of an Arrow column.
    """
    volume = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    bits = min(20, max(4, int(volume >> 20).bit_length()))
    shift = np.uint64(64 - bits - _WIDTH)

    def emit(parts):
        keys = np.sort(np.concatenate(parts) >> shift)
        bucket = (keys >> np.uint64(_WIDTH)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        low = (keys & np.uint64((1 << _WIDTH) - 1)).astype(np.int64)
        return pa.RecordBatch.from_pydict({"bucket": pa.array(bucket[first], pa.int64()),
                                           "packed": pa.array([pack(x) for x in np.split(low, first[1:])], pa.binary())})

    def send(batches):
        parts, size = [], 0
        for batch in batches:
            for own in hashes(batch.column(0)):
                parts.append(own)
                size += len(own)
                if size > 1 << 22:
                    yield emit(parts)
                    parts, size = [], 0
        if size:
            yield emit(parts)

    def count(part: pa.Table) -> pa.Table:
        bucket = part.column("bucket")[0].as_py()
        values, counts = np.unique(np.concatenate([unpack(x.as_py()) for x in part.column("packed")]), return_counts=True)
        often = counts >= least
        return pa.table({"class": (bucket << _WIDTH) | values[often], "count": counts[often]})

    sent = docs.select(text).mapInArrow(send, "bucket long, packed binary")
    return store(sent.groupBy("bucket").applyInArrow(count, "class long, count long")), bits + _WIDTH


def classes_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)
