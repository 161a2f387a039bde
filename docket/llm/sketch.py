"""Count-min sketches of 64-bit hashes, made batch by batch and merged slice by slice.

A sketch has two rows of counters.  A batch sends the counters that it touches,
as packed differences; a merging task adds one slice of a row from a bounded number of batches, and
such slices are merged in rounds of FAN.  Only whether a
counter reaches two is kept, a bit each.  Estimates are never below the truth: a hash that
occurs twice is always seen as repeated.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEPTH = 2
#: Counters of a row, as a power of two: at most this (its two rows of bits are broadcast: 64 MB).
MAX_LOG_WIDTH = 28
#: Counters that one task merges.
LOG_SLICE = 24
#: Hashes whose batches are merged together first, and merged slices that are merged together after that.
PER_PART, FAN = 1 << 28, 64


def mix64(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def rolled(w: np.ndarray, n: int, r: int) -> np.ndarray:
    """Polynomial hash of every n consecutive values: runs of 1, 2, 4, ... put together as n's binary digits ask."""
    if len(w) < n:
        return w[:0]
    out, done, run, size = None, 0, w, 1
    while True:
        if n & size:
            m = len(w) - done - size + 1
            out = run[:m] if out is None else out[:m] + np.uint64(pow(r, done, 1 << 64)) * run[done : done + m]
            done += size
            if done == n:
                return out
        run = run[: len(run) - size] + np.uint64(pow(r, size, 1 << 64)) * run[size:]
        size *= 2


def log_width_for(expected: int) -> int:
    """Twice the hashes expected, within bounds."""
    return min(MAX_LOG_WIDTH, max(12, int(2 * expected - 1).bit_length()))


def counters(h1: np.ndarray, h2: np.ndarray, log_width: int):
    """The counter of each hash in each row."""
    yield h1 >> np.uint64(64 - log_width)
    yield h2 >> np.uint64(64 - log_width)


def pack(sorted_: np.ndarray) -> bytes:
    """Ascending uint32 numbers as compressed planes of their differences' bytes."""
    steps = np.diff(sorted_.astype(np.uint32), prepend=np.uint32(0)).astype("<u4")
    return len(steps).to_bytes(4, "little") + pa.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 4).T).tobytes(), "zstd", asbytes=True)


def unpack(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:4], "little")
    planes = np.frombuffer(pa.decompress(data[4:], 4 * n, "zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.int64)


def merged_sketch(docs: DataFrame, hashes, log_width: int, expected: int, heavy: int | None = None, least: int = 0) -> tuple[list[np.ndarray], dict[int, int]]:
    """The bits of the counters that reach two, for each row; and hashes that batches have `heavy` or more times, over `least` in sum.

    hashes: from Arrow batches of docs to (h1, h2) of each batch, two independent hashes of the same things; expected: about how many.
    """
    log_slice = min(LOG_SLICE, log_width)
    parts_ = max(1, -(-expected // PER_PART))

    def sketch(batches):
        for h1, h2 in hashes(batches):
            rows = []
            for row, c in enumerate(counters(h1, h2, log_width)):
                c = np.sort(c)
                new = np.concatenate(([True], c[1:] != c[:-1]))
                for kind, found in ((0, c[new]), (1, np.unique(c[~new]))):
                    ends = np.searchsorted(found, np.arange(1, (1 << log_width - log_slice) + 1, dtype=np.uint64) << np.uint64(log_slice))
                    for s, (a, b) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)):
                        if b > a:
                            rows.append((row, s, kind, pack(found[a:b] & np.uint64((1 << log_slice) - 1))))
            if heavy:
                h, n = np.unique(h1, return_counts=True)
                h, n = h[n >= heavy], n[n >= heavy]
                for s in np.unique(h >> np.uint64(60)).tolist():
                    mine = h >> np.uint64(60) == s
                    rows.append((-1, s, 0, h[mine].tobytes() + n[mine].astype(np.uint64).tobytes()))
            r, s, k, data = zip(*rows, strict=True)
            part = [int(h1[0] ^ h1[-1]) % parts_] * len(r)
            yield pa.RecordBatch.from_arrays([pa.array(r, pa.int32()), pa.array(s, pa.int32()), pa.array(part, pa.int32()), pa.array(k, pa.int32()), pa.array(data, pa.binary())], ["row", "slice", "part", "kind", "data"])

    def merge(parts: pa.Table, last: bool) -> pa.Table:
        row = parts.column("row")[0].as_py()
        if row < 0:
            both = [np.frombuffer(d.as_py(), np.uint64).reshape(2, -1) for d in parts.column("data")]
            h, back = np.unique(np.concatenate([x[0] for x in both]), return_inverse=True)
            n = np.bincount(back, weights=np.concatenate([x[1] for x in both])).astype(np.uint64)
            most = n > least if last else n > 0
            bits = h[most].tobytes() + n[most].tobytes()
        else:
            count = np.zeros(1 << log_slice, np.uint8)
            for kind, data in zip(parts.column("kind").to_pylist(), parts.column("data"), strict=True):
                if kind == 2:  # merged already: bits of one or more, then of two or more
                    whole = np.frombuffer(pa.decompress(data.as_py(), 2 << log_slice - 3, "zstd", asbytes=True), np.uint8).reshape(2, -1)
                    count = np.minimum(count + np.unpackbits(whole[0]) + np.unpackbits(whole[1]), 2)
                    continue
                at = unpack(data.as_py())  # without repeats, so plain indexing adds one each
                count[at] = 2 if kind else np.minimum(count[at] + 1, 2)
            bits = np.packbits(count > 1).tobytes()
            if not last:
                bits = pa.compress(np.packbits(count > 0).tobytes() + bits, "zstd", asbytes=True)
        first = {c: parts.column(c).slice(0, 1) for c in ("row", "slice")}
        if last:
            return pa.table({**first, "bits": pa.array([bits], pa.binary())})
        return pa.table({**first, "part": parts.column("part").slice(0, 1), "kind": pa.array([2], pa.int32()), "data": pa.array([bits], pa.binary())})

    schema = "row int, slice int, part int, kind int, data binary"
    parts, left = docs.mapInArrow(sketch, schema), parts_
    while left > 1:
        parts = parts.groupBy("row", "slice", "part").applyInArrow(lambda t: merge(t, False), schema)
        if left <= FAN:
            break
        left = -(-left // FAN)
        parts = parts.withColumn("part", (F.col("part") % left).cast("int"))
    found = parts.groupBy("row", "slice").applyInArrow(lambda t: merge(t, True), "row int, slice int, bits binary").collect()
    most: dict[int, int] = {}
    sketch_ = [np.zeros(1 << log_width - 3, np.uint8) for _ in range(DEPTH)]
    for r in found:
        if r["row"] < 0:
            h, n = np.frombuffer(r["bits"], np.uint64).reshape(2, -1)
            most |= dict(zip(h.tolist(), n.astype(int).tolist(), strict=True))
        else:
            at = r["slice"] << log_slice - 3
            sketch_[r["row"]][at : at + len(r["bits"])] = np.frombuffer(r["bits"], np.uint8)
    return sketch_, most


def in_sketch(sketch: list[np.ndarray], h1: np.ndarray, h2: np.ndarray, log_width: int) -> np.ndarray:
    """Whether each hash is estimated to occur twice or more."""
    out = np.ones(len(h1), bool)
    for bits, c in zip(sketch, counters(h1, h2, log_width), strict=True):
        out &= (bits[(c >> np.uint64(3)).astype(np.int64)] >> (7 - (c & np.uint64(7))).astype(np.uint8)) & 1 > 0
    return out
