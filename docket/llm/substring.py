"""Substring dedup over word windows, behind a count-min prefilter.

First pass (see sketch): every batch of documents makes a sparse count-min sketch of its
window hashes.  Sketches are merged slice by slice; merged counts are never below the
true ones, and all that is kept of them is a bit for "twice or more".  Second pass:
windows whose estimate is one are unique and go no further; the others are shipped,
each once per batch, and grouped exactly (96-bit digests).  Of each
digest's occurrences all but the first are marked, and the words under marked
windows leave their documents.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import slices, table
from .sketch import in_sketch, log_width_for, merged_sketch, mix64, pack, rolled, unpack

WINDOW = 20
#: Words of a batch; windows of a grouping task.
BATCH_WORDS, SHARD_WINDOWS = 500_000, 2_000_000
#: Rows of a batch at most, and finer shards that one step deals to.
LANES = 128
_R1, _R2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_NO_ID = -(1 << 63)


def batches_of(rows, limit: int = BATCH_WORDS):
    """(doc ids, text keys, word counts, words) of consecutive documents with about `limit` words."""
    ids, keys, sizes, words = [], [], [], []
    for doc_id, text in rows:
        data = (text or "").encode("utf-8", "surrogatepass")
        found = data.split()
        if len(found) < WINDOW:
            continue
        ids.append(_NO_ID if doc_id is None else doc_id)
        keys.append(xxhash.xxh64_intdigest(data, 42))
        sizes.append(len(found))
        words += found
        if len(words) >= limit:
            yield np.array(ids, np.int64), np.array(keys, np.uint64).view(np.int64), np.array(sizes), words
            ids, keys, sizes, words = [], [], [], []
    if words:
        yield np.array(ids, np.int64), np.array(keys, np.uint64).view(np.int64), np.array(sizes), words


def windows(sizes: np.ndarray, words: list[bytes], n: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places where a window starts, and two hashes of it."""
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(words))
    at = np.nonzero(left >= n)[0]
    h1 = mix64(rolled(w, n, _R1))[at]
    h2 = mix64(rolled(mix64(w ^ np.uint64(_R2)), n, _R2))[at]
    return at, h1, h2


def _pairs(batches):
    for b in batches:
        for doc_id, text in zip(b.column(0), b.column(1), strict=True):
            yield doc_id.as_py(), text.as_py()


def _hashes(batches):
    for _, _, sizes, words in batches_of(_pairs(batches)):
        yield windows(sizes, words)[1:]


def _ship(shared, log_width: int, lanes: int):
    """Second pass over documents: candidate windows by lane, one for each digest and batch; the rest are marked here."""

    def run(batches):
        sketch = shared.value
        for ids, keys, sizes, words in batches_of(_pairs(batches)):
            at, h1, h2 = windows(sizes, words)
            open_ = in_sketch(sketch, h1, h2, log_width)
            at, h1, h2 = at[open_], h1[open_], (h2[open_] >> np.uint64(32)).astype(np.uint32)
            if not len(at):
                continue
            starts = np.cumsum(sizes) - sizes
            doc = np.searchsorted(starts, at, "right") - 1
            batch = int(np.frombuffer(hashlib.blake2b(ids.tobytes() + keys.tobytes(), digest_size=8).digest(), np.int64)[0])
            order = np.lexsort((at - starts[doc], ids[doc], h2, h1))
            at, h1, h2, doc = at[order], h1[order], h2[order], doc[order]
            same = np.concatenate(([False], (h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1])))
            first, pos = np.maximum.accumulate(np.where(same, 0, np.arange(len(at)))), at - starts[doc]
            later = same & ~((ids[doc] == ids[doc][first]) & (pos == pos[first]))  # a repeated row starts no earlier than its like
            own = np.nonzero(~later)[0]
            out = [(0, lane, batch, *found) for lane, found in _dealt(h1[own], h2[own], at[own], ids, starts, lanes)]
            # The batch's documents travel once, with what is marked already.
            out.append((1, batch % lanes, batch, b"", b"", pack(np.sort(at[later])), squeeze(ids), pack(starts), keys.tobytes()))
            yield _rows(out)

    return run


_SHIPPED = "kind int, shard int, batch array<long>, h1 array<binary>, h2 array<binary>, at array<binary>, ids array<binary>, starts array<binary>, keys binary"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    """Rows (kind, shard, then lists of equal length: batch, h1, h2, at, ids, starts; or one of each and keys) of _SHIPPED."""
    many = [(r[0], r[1], *([x] if not isinstance(x, list) else x for x in r[2:8]), r[8] if len(r) > 8 else b"") for r in rows]
    cols = list(zip(*many, strict=True)) or [()] * 9
    types = [pa.int32(), pa.int32(), pa.list_(pa.int64()), *[pa.list_(pa.binary())] * 5, pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], [x.split()[0] for x in _SHIPPED.split(", ")])


def _dealt(h1: np.ndarray, h2: np.ndarray, at: np.ndarray, ids: np.ndarray, starts: np.ndarray, shards: int):
    """(shard, (h1, h2, places, ids of their documents, where these start)) of a batch's windows, by ranges of h1."""
    shard = (h1 >> np.uint64(32)).astype(np.int64) * shards >> 32
    order = np.lexsort((at, shard))  # places pack best in order
    h1, h2, at, shard = h1[order], h2[order], at[order], shard[order]
    for s in np.unique(shard).tolist():
        pick = slice(*np.searchsorted(shard, (s, s + 1)))
        docs = np.unique(np.searchsorted(starts, at[pick], "right") - 1)
        yield s, (h1[pick].tobytes(), h2[pick].tobytes(), pack(at[pick]), squeeze(ids[docs]), pack(starts[docs]))


def _windows(row: dict):
    """(batch, h1, h2, places, ids, starts) of each batch in a row."""
    for batch, h1, h2, at, ids, starts in zip(*(row[c] for c in ("batch", "h1", "h2", "at", "ids", "starts")), strict=True):
        yield batch, np.frombuffer(h1, np.uint64), np.frombuffer(h2, np.uint32), unpack(at), unsqueeze(ids), unpack(starts)


def _dealt_again(shards: int):
    """Rows of one shard from several batches, dealt to finer shards: for each of these one row, whatever the number of batches."""

    def run(part: pa.Table) -> pa.Table:
        out, finer = [], {}
        for row in part.to_pylist():
            if row["kind"]:
                out.append((1, row["batch"][0] % shards, *(row[c] for c in ("batch", "h1", "h2", "at", "ids", "starts")), row["keys"]))
                continue
            for batch, h1, h2, at, ids, starts in _windows(row):
                for s, found in _dealt(h1, h2, at, ids, starts, shards):
                    for to, x in zip(finer.setdefault(s, [[] for _ in range(6)]), (batch, *found), strict=True):
                        to.append(x)
        return pa.Table.from_batches([_rows(out + [(0, s, *x) for s, x in finer.items()])])

    return run


def squeeze(ids: np.ndarray) -> bytes:
    """64-bit numbers as compressed planes of bytes."""
    return len(ids).to_bytes(4, "little") + pa.compress(np.ascontiguousarray(ids.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes(), "zstd", asbytes=True)


def unsqueeze(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:4], "little")
    planes = np.frombuffer(pa.decompress(data[4:], 8 * n, "zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view("<i8").ravel().astype(np.int64)


def _first_ones(part: pa.Table) -> pa.Table:
    """A shard's digests from all batches: per batch, the places whose digest starts earlier somewhere."""
    rows = part.to_pylist()
    out = [(*(r[c][0] for c in ("batch", "at", "ids")), r["keys"], r["starts"][0]) for r in rows if r["kind"]]
    grouped = [w for r in rows if not r["kind"] for w in _windows(r)]
    if grouped:
        h1, h2 = np.concatenate([w[1] for w in grouped]), np.concatenate([w[2] for w in grouped])
        doc, pos = [], []
        for _, _, _, at, ids, starts in grouped:
            d = np.searchsorted(starts, at, "right") - 1
            doc.append(ids[d])
            pos.append(at - starts[d])
        sizes = [len(x) for x in doc]
        doc, pos = np.concatenate(doc), np.concatenate(pos)
        order = np.lexsort((pos, doc, h2, h1))
        a, b, d, p = h1[order], h2[order], doc[order], pos[order]
        same = np.concatenate(([False], (a[1:] == a[:-1]) & (b[1:] == b[:-1])))
        first = np.maximum.accumulate(np.where(same, 0, np.arange(len(a))))
        later = np.zeros(len(a), bool)
        later[order] = same & ~((d == d[first]) & (p == p[first]))
        for w, mark in zip(grouped, np.split(later, np.cumsum(sizes)[:-1]), strict=True):
            if mark.any():
                out.append((w[0], pack(w[3][mark]), b"", b"", b""))
    cols = list(zip(*out, strict=True)) or [()] * 5
    return pa.table({"batch": pa.array(cols[0], pa.int64()), **{n: pa.array(c, pa.binary()) for n, c in zip(("at", "ids", "keys", "starts"), cols[1:], strict=True)}})


def _runs(part: pa.Table) -> pa.Table:
    """A batch's marked places as word runs of its documents."""
    rows = part.to_pylist()
    own = next(r for r in rows if r["keys"])  # of two equal batches either will do
    at, starts = np.unique(np.concatenate([unpack(r["at"]) for r in rows])), unpack(own["starts"])
    if not len(at):
        return pa.table({n: pa.array([], t) for n, t in (("id", pa.int64()), ("key", pa.int64()), ("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32())))})
    d = np.searchsorted(starts, at, "right") - 1
    ids, keys, pos = unsqueeze(own["ids"])[d], np.frombuffer(own["keys"], np.int64)[d], at - starts[d]
    order = np.lexsort((pos, keys, ids))
    ids, keys, pos = ids[order], keys[order], pos[order]
    new = np.concatenate(([True], (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1])))
    cut = new | np.concatenate(([True], pos[1:] > pos[:-1] + WINDOW))
    begin = np.nonzero(cut)[0]
    a, b = pos[begin], pos[np.append(begin[1:], len(pos)) - 1] + WINDOW
    docs = np.nonzero(new[begin])[0]
    offsets = pa.array(np.append(docs, len(begin)), pa.int32())
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (a, b)]
    return pa.table({"id": pa.array(ids[begin][docs]), "key": pa.array(keys[begin][docs]), "a": lists[0], "b": lists[1]})


def repeated_runs(docs: DataFrame) -> DataFrame:
    """id long (null doc_id: the least long), key long (XXH64 of the text), a and b array<int>: word runs [a, b) to remove. docs: doc_id, text."""
    spark = docs.sparkSession
    chars = docs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    guess = max(1, chars // 6)
    log_width = log_width_for(guess)
    shards = int(max(1, -(-guess // SHARD_WINDOWS)))
    lanes = min(shards, LANES)
    shared = spark.sparkContext.broadcast(merged_sketch(docs, _hashes, log_width, guess)[0])
    shipped = docs.mapInArrow(_ship(shared, log_width, lanes), _SHIPPED)
    # A batch sends LANES rows at most.  More shards are reached in steps: each joins as many batches' rows of a shard as it
    # deals finer shards, so there are never more rows than batches x LANES, and so the rows grow as the input does.
    sources = max(1, guess // BATCH_WORDS)
    while lanes < shards:
        step = min(-(-shards // lanes), LANES)
        lanes, sources = lanes * step, -(-sources // step)
        shipped = shipped.groupBy("shard", F.pmod(F.xxhash64("batch"), F.lit(sources))).applyInArrow(_dealt_again(lanes), _SHIPPED)
    marked = shipped.groupBy("shard").applyInArrow(_first_ones, "batch long, at binary, ids binary, keys binary, starts binary")
    runs = marked.groupBy("batch").applyInArrow(_runs, "id long, key long, a array<int>, b array<int>")
    return runs.groupBy("id", "key").agg(F.max(F.struct("a", "b")).alias("r")).select("id", "key", "r.a", "r.b")  # a row repeated in two batches has equal runs


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_words long, n_removed long, kept string: texts without words under a window of WINDOW words that starts earlier.

    Earlier: smaller doc_id, or the same doc_id and an earlier start; null ids come
    first.  Kept words are joined by one space.  Null, empty and short texts lose
    nothing.  A repeated row (same doc_id and text) is the same document and loses the same.
    """
    rows = docs.select("doc_id", "text")
    runs = repeated_runs(rows)
    keyed = rows.withColumn("_id", F.coalesce("doc_id", F.lit(_NO_ID))).withColumn("_key", F.xxhash64("text"))
    joined = keyed.join(runs, (keyed["_id"] == runs["id"]) & (keyed["_key"] == runs["key"]), "left").select("doc_id", "text", "a", "b")

    def apply(batches):
        for batch in slices(batches):
            out = [[], [], []]
            for text, a, b in zip(*(batch.column(i) for i in (1, 2, 3)), strict=True):
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                kept, at = [], 0
                for x, y in zip(a.as_py() or (), b.as_py() or (), strict=True):
                    kept += words[at:x]
                    at = y
                kept += words[at:]
                for to, v in zip(out, (len(words), len(words) - len(kept), b" ".join(kept).decode("utf-8", "surrogatepass")), strict=True):
                    to.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return joined.mapInArrow(apply, "doc_id long, n_words long, n_removed long, kept string")


def op4_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(ws[i : i + 19], ' ')) AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20)),
again AS (SELECT doc_id, i FROM win QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM again),
words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, coalesce(len(ws), 0)::BIGINT AS n_words, (coalesce(len(ws), 0) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""
