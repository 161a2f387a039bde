"""Suffix-array dedup of repeated byte strings.

Strings of LENGTH bytes that occur twice are removed, those of SHORT bytes are counted.  A string
has an anchor: the 32-byte gram of least hash in its first SHORT bytes, the
leftmost of equals.  Equal strings have equal anchors, so a string whose anchor occurs
once in the corpus is unique; a count-min sketch of anchors drops those
without losing any other.  What is left travels as blocks (the bytes around one
anchor), equal blocks of a batch as one row with all their places.  Each shard of blocks gets suffix arrays by
Larsson-Sadakane refinement, as deep as its strings go; ties that are left mark
every start whose string occurs twice.  Very frequent anchors are dealt to several
shards; their sorted string digests are merged by binary search.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import slices, table, width
from .sketch import in_sketch, log_width_for, merged_sketch, mix64, rolled

LENGTH, SHORT = 400, 340
GRAM = 32
#: Starts that are looked at together; a longer text goes in pieces that overlap by LENGTH - 1 bytes.
BATCH = 1 << 21
#: Bytes of a suffix array: places take 21 bits, and three of them a sort key.
SHARD = (1 << 21) - 4096
#: Bytes of whole texts that are searched for anchors together, and of small anchors' blocks that share an array: what is made of them stays in a core's cache.
POOL = 1 << 17
#: An anchor with so many blocks (summed over batches where it has HEAVY or more) is dealt to one shard for each so many.
SPLIT, HEAVY = 2000, 8
#: Places of an anchor's blocks that an array marks at once; more are marked in several arrays that are merged.
PLACES = 200_000
_NO_ID = -(1 << 63)
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64))


def doubled(text: np.ndarray, room: np.ndarray | None = None):
    """Larsson-Sadakane rounds: (bytes h, slots, at, first, size, rank) with the suffixes `at` in `slots` of the suffix array in order of h bytes.

    h is 5 first and doubles; groups that are still tied, and only those, are refined by the rank of the suffix as far behind as is sorted
    already.  first, size: the groups' beginnings and sizes; rank: each suffix's group, from 1, behind the end 0.
    room: suffixes are sorted as far as they have more room than bytes; the others' ranks are not to be used then.
    """
    m = len(text)
    bits, mask = np.uint64(21), np.uint64((1 << 21) - 1)
    key = np.ndarray(m, ">u8", np.concatenate((text, np.zeros(8, np.uint8))), strides=(1,)).astype(np.uint64)
    key >>= np.uint64(24)
    key <<= bits
    key |= np.arange(m, dtype=np.uint64)
    rank, slots, h = np.zeros(m + 1, np.int32), np.arange(m), 5
    while len(slots):
        key.sort()
        at = (key & mask).astype(np.int64)
        first, size = _groups(key, bits)
        rank[at] = np.repeat((slots[first] + 1).astype(np.int32), size)
        yield h, slots, at, first, size, rank
        h *= 2
        left = np.repeat(size > 1, size)
        if room is not None:
            left &= room[at] > h
        slots, at = slots[left], at[left]
        key = _key(rank[at], rank[np.minimum(at + h // 2, m)], at)


def _key(high: np.ndarray, low: np.ndarray, at: np.ndarray) -> np.ndarray:
    key = high.astype(np.uint64)
    for x in (low, at):
        key <<= np.uint64(21)
        key |= x.astype(np.uint64)
    return key


def _groups(sorted_: np.ndarray, bits: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """First place and size of each run of keys that are equal above so many bits."""
    new = np.ones(len(sorted_), bool)
    np.greater((sorted_[1:] ^ sorted_[:-1]) >> bits, 0, out=new[1:])
    first = np.nonzero(new)[0]
    return first, np.diff(first, append=len(sorted_))


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes in order, to the end: Kasai's bound does not hold where ties are left."""
    sa = np.empty(len(text), np.int64)
    for _, slots, at, *_ in doubled(text):
        sa[slots] = at
    return sa


def common_prefixes(text: np.ndarray, sa: np.ndarray, cap: int, step: int = 128) -> np.ndarray:
    """Common prefix of each suffix with the one before it in sa, up to cap.

    Kasai: the next suffix of the text shares at least one byte less than this
    one did.  Many stretches of the text are walked side by side, each by that bound.
    """
    m = len(text)
    pad = np.concatenate((text, np.zeros(cap + 16, np.uint8))).astype(np.uint64)
    n = m + cap + 8
    word = pad[:n].copy()
    for j in range(1, 8):
        word |= pad[j : j + n] << np.uint64(8 * j)
    before = np.full(m, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    shared, lanes = np.zeros(m, np.int64), np.arange(0, m, step)
    have = np.zeros(len(lanes), np.int64)
    for t in range(step):
        i = lanes + t
        if i[-1] >= m:
            i, have = i[:-1], have[:-1]
            lanes = lanes[:-1]
            if not len(i):
                break
        j = before[i]
        have = np.where(j >= 0, np.maximum(have - 1, 0), 0)
        todo = np.nonzero((j >= 0) & (have < cap))[0]
        while len(todo):
            x = word[i[todo] + have[todo]] ^ word[j[todo] + have[todo]]
            have[todo] += np.where(x == 0, 8, np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)).astype(np.int64) >> 3)
            todo = todo[(x == 0) & (have[todo] < cap)]
        have = np.minimum(have, cap)
        shared[i] = have
    return shared[sa]


def anchors(data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of starts with the same anchor: first start, number of starts, piece, and the anchor's hash.

    A start has SHORT bytes before its piece ends, and stands before BATCH: later ones are the next piece's.
    """
    n = len(data)
    ends = np.cumsum(sizes)
    piece = np.repeat(np.arange(len(sizes)), sizes)
    left = ends[piece] - np.arange(n)
    starts = np.nonzero((left >= SHORT) & (sizes[piece] - left < BATCH))[0]
    if not len(starts):
        return tuple(np.empty(0, np.int64) for _ in range(3)) + (np.empty(0, np.uint64),)
    gram = mix64(rolled(_BYTE[data], GRAM, 0x9E3779B97F4A7C15))
    packed = gram & ~np.uint64((1 << 24) - 1) | np.arange(len(gram), dtype=np.uint64)
    w = SHORT - GRAM + 1
    blocks = np.concatenate((packed, np.full(-len(packed) % w, ~np.uint64(0)))).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.ascontiguousarray(np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1]).ravel()
    spot = (np.minimum(back[starts], ahead[starts + w - 1]) & np.uint64((1 << 24) - 1)).astype(np.int64)
    new = np.concatenate(([True], (spot[1:] != spot[:-1]) | (starts[1:] != starts[:-1] + 1)))
    first = np.nonzero(new)[0]
    return starts[first], np.diff(np.append(first, len(starts))), piece[starts[first]], gram[spot[first]]


def _pieces(batches):
    """(doc_id, text key, offset, bytes) of texts of SHORT bytes or more."""
    for b in batches:
        for doc_id, text in zip(b.column(0), b.column(1), strict=True):
            data = (text.as_py() or "").encode("utf-8", "surrogatepass")
            if len(data) >= SHORT:
                doc_id, key = doc_id.as_py(), np.uint64(xxhash.xxh64_intdigest(data, 42)).astype(np.int64)
                for at in range(0, len(data) - SHORT + 1, BATCH):
                    yield _NO_ID if doc_id is None else doc_id, int(key), at, data[at : at + BATCH + LENGTH - 1]


def _batches(batches):
    held, size = [], 0
    for p in _pieces(batches):
        held.append(p)
        size += len(p[3])
        if size >= BATCH:
            yield held
            held, size = [], 0
    if held:
        yield held


def _found(held):
    whole = b"".join(p[3] for p in held)
    sizes = np.array([len(p[3]) for p in held])
    data, ends, out, a, at = np.frombuffer(whole, np.uint8), np.cumsum(sizes), [], 0, 0
    for z in np.unique(np.minimum(np.searchsorted(ends, np.arange(POOL, len(data) + POOL, POOL)) + 1, len(sizes))).tolist():
        start, count, piece, anchor = anchors(data[at : ends[z - 1]], sizes[a:z])
        out.append((start + at, count, piece + a, anchor))
        a, at = z, int(ends[z - 1])
    return whole, sizes, tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _second(h: np.ndarray) -> np.ndarray:
    return mix64(h ^ np.uint64(0xC2B2AE3D27D4EB4F))


def _anchor_hashes(batches):
    for held in _batches(batches):
        h = _found(held)[2][3]
        if len(h):
            yield h, _second(h)


_BLOCKS = "anchor long, salt int, ids array<long>, keys array<long>, ats array<int>, n int, block binary"


def _ship(shared, log_width: int):
    """Blocks of anchors that may repeat, equal blocks of a batch as one row with all their places."""

    def run(batches):
        sketch, hot = shared.value
        for held in _batches(batches):
            whole, sizes, (start, count, piece, anchor) = _found(held)
            if not len(start):
                continue
            begins = np.cumsum(sizes) - sizes
            keep = np.nonzero(in_sketch(sketch, anchor, _second(anchor), log_width))[0]
            start, count, piece, anchor = start[keep], count[keep], piece[keep], anchor[keep]
            ids, keys, offsets = (np.array([p[i] for p in held], np.int64) for i in range(3))
            place, stop = start - begins[piece] + offsets[piece], np.minimum(start + count + LENGTH - 1, (begins + sizes)[piece])
            rows: dict[tuple[int, int, bytes], list[int]] = {}
            for i, (h, s, n, e) in enumerate(zip(anchor.view(np.int64).tolist(), start.tolist(), count.tolist(), stop.tolist(), strict=True)):
                rows.setdefault((h, n, whole[s:e]), []).append(i)
            if not rows:
                continue
            salts = [int.from_bytes(hashlib.blake2b(b, digest_size=4).digest(), "little") % hot[h] if h in hot else 0 for h, _, b in rows] if hot else [0] * len(rows)
            own = np.fromiter((i for r in rows.values() for i in r), np.int64, len(start))
            ends = pa.array(np.cumsum([0, *map(len, rows.values())]), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x[piece][own] if x is not place else x[own], t)) for x, t in ((ids, pa.int64()), (keys, pa.int64()), (place, pa.int32()))]
            firsts = own[ends.to_numpy()[:-1]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor.view(np.int64)[firsts]), pa.array(salts, pa.int32()), *lists, pa.array(count[firsts], pa.int32()), pa.array([b for _, _, b in rows], pa.binary())],
                [x.split()[0] for x in _BLOCKS.split(", ")],
            )

    return run


class _Out:
    """Rows of marks (starts [a, a + n) of a document) and of strings to compare with other shards, in columns.

    kind: 0 and 2 of LENGTH bytes, 1 and 3 of SHORT.
    """

    TYPES = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
    SCHEMA = "kind int, id long, key long, a int, n int, d1 long, d2 long"

    def __init__(self):
        self.parts: list[list] = []

    def marks(self, kind: int, ids, keys, a, n) -> None:
        none = pa.nulls(len(ids), pa.int64())
        self.parts.append([np.full(len(ids), kind, np.int32), ids, keys, a, n, none, none])

    def strings(self, kind: int, ids, keys, a, n, digests: list[bytes]) -> None:
        both = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
        self.parts.append([np.full(len(ids), kind, np.int32), ids, keys, a, n, both[:, 0], both[:, 1]])

    def take(self):
        parts, self.parts = self.parts, []
        names = [x.split()[0] for x in self.SCHEMA.split(", ")]
        done = [pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(p, self.TYPES, strict=True)], names) for p in parts]
        whole = pa.Table.from_batches(done, pa.schema(list(zip(names, self.TYPES, strict=True)))).combine_chunks()
        yield from whole.to_batches()


def repeated_starts(blocks: list[tuple[bytes, int, int]], lengths: tuple[int, ...] = (LENGTH,)):
    """For concatenated blocks (bytes, starts, times it occurs) and each length, ascending and under twice the first: its starts' places, whether the string there occurs twice, and its group.

    The suffixes are sorted as deep as a start's string goes, and the last step puts two ranks together that make up its length, so ties are
    equal strings and no prefixes are compared.  A start whose block ends before a length has no string of that length.
    """
    text = np.frombuffer(b"".join(b for b, _, _ in blocks), np.uint8)
    sizes, starts, k = (np.array(x, np.int64) for x in zip(*((len(b), n, k) for b, n, k in blocks), strict=True))
    offset = np.arange(len(text)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    times = np.repeat(k, sizes)
    for h, _, at, first, size, rank in doubled(text, np.repeat(starts + max(lengths), sizes) - offset):
        if 2 * h > lengths[0]:
            break
    group = rank[at]
    for length in lengths:
        able = offset < np.repeat(np.minimum(starts, sizes - length + 1), sizes)
        twice, name = able & (times > 1), np.arange(len(text))
        left = np.repeat(size > 1, size) & able[at]
        at = at[left]
        if len(at):
            key = _key(group[left], rank[at + length - h], at)
            key.sort()
            at = (key & np.uint64((1 << 21) - 1)).astype(np.int64)
            first, size = _groups(key, np.uint64(21))
            group = np.repeat(np.arange(len(first)), size)
            twice[at] = np.repeat(np.add.reduceat(times[at], first) > 1, size)
            name[at] = np.repeat(at[first], size)
        else:
            first, size, group = (np.empty(0, np.int64) for _ in range(3))
        found = np.nonzero(able)[0]
        yield found, twice[found], name[found]


def _mark(out: _Out, kinds: list[tuple], split: bool) -> None:
    """One suffix array over distinct blocks (block, n, ids, keys, ats), each of them a string that stands at all its places."""
    times = np.array([len(k[2]) for k in kinds])
    sizes = np.array([len(k[0]) for k in kinds])
    base = np.cumsum(sizes) - sizes
    ids, keys, ats = (np.concatenate([k[i] for k in kinds]) for i in (2, 3, 4))
    first = np.cumsum(times) - times
    short, long = repeated_starts([(k[0], k[1], t) for k, t in zip(kinds, times.tolist(), strict=True)], (SHORT, LENGTH))
    told = np.zeros(sizes.sum(), bool)  # starts of a longer string that is marked, which covers a shorter one
    for kind, (length, (starts, twice, group)) in enumerate(((LENGTH, long), (SHORT, short))):
        if not len(starts):
            continue
        block = np.searchsorted(base, starts, "right") - 1
        new = twice & ~told[starts]
        told[starts] |= twice
        same = new[1:] & new[:-1] & (block[1:] == block[:-1]) & (starts[1:] == starts[:-1] + 1)  # goes on from the start before
        heads = np.nonzero(new & ~np.concatenate(([False], same)))[0]
        tails = np.nonzero(new & ~np.concatenate((same, [False])))[0]
        of = block[heads]  # every run of marks at every place of its block
        run = np.repeat(np.arange(len(heads)), times[of])
        place = np.arange(len(run)) - np.repeat(np.cumsum(times[of]) - times[of], times[of]) + first[of][run]
        out.marks(kind, ids[place], keys[place], ats[place] + (starts[heads] - base[of])[run], (tails - heads + 1)[run])
        if split:  # each string once: its first place, with n = 0 if it repeats here anyway
            one = np.unique(group, return_index=True)[1]
            of, at = block[one], starts[one] - base[block[one]]
            digests = [hashlib.blake2b(kinds[k][0][i : i + length], digest_size=16).digest() for k, i in zip(of.tolist(), at.tolist(), strict=True)]
            out.strings(kind + 2, ids[first[of]], keys[first[of]], ats[first[of]] + at, 1 - twice[one].astype(np.int32), digests)


def _shards(shared):
    """Blocks sorted by anchor and salt, in suffix arrays of SHARD bytes at most.

    Small anchors share an array of about POOL bytes; blocks of an anchor that stands once are unique.  A dealt anchor has arrays of its own, and so has one that
    fills an array by itself; their strings are compared with the other shards' later.
    """

    def run(batches):
        hot, out = shared.value[1], _Out()
        pool: list[tuple] = []  # blocks of whole anchors
        mine: dict[tuple[int, bytes], list] = {}  # blocks of the anchor at hand (starts, bytes), with lists of their places
        pooled = size = places = 0
        last, split = None, False

        def blocks():
            return [(b, n, *(np.concatenate(x) for x in zip(*at, strict=True))) for (n, b), at in mine.items()]

        def end_of_anchor():
            nonlocal pool, mine, pooled
            if split and mine:
                _mark(out, blocks(), True)
            elif places > 1:
                if pool and pooled + size > POOL:
                    _mark(out, pool, False)
                    pool, pooled = [], 0
                pool += blocks()
                pooled += size
            mine = {}

        for b in batches:
            anchors_, salts, counts, data = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(5).to_numpy(), b.column(6)
            lists = [(b.column(i).offsets.to_numpy(), b.column(i).values.to_numpy()) for i in (2, 3, 4)]
            new = np.concatenate(([True], (anchors_[1:] != anchors_[:-1]) | (salts[1:] != salts[:-1])))
            for i, fresh in enumerate(new.tolist()):
                if fresh and (int(anchors_[i]), int(salts[i])) != last:
                    end_of_anchor()
                    last = (int(anchors_[i]), int(salts[i]))
                    split, size, places = last[0] in hot, 0, 0
                block = (int(counts[i]), data[i].as_py())
                own = [v[o[i] : o[i + 1]] for o, v in lists]
                if (block not in mine and size + len(block[1]) > SHARD) or places + len(own[0]) > PLACES and mine:
                    _mark(out, blocks(), True)
                    mine, split, size, places = {}, True, 0, 0
                if block not in mine:
                    mine[block] = []
                    size += len(block[1])
                mine[block].append(own)
                places += len(own[0])
            yield from out.take()
        end_of_anchor()
        if pool:
            _mark(out, pool, False)
        yield from out.take()

    return run


def several(sorted_: np.ndarray) -> np.ndarray:
    """Which of the merged shards' sorted digests stand there more than once, by binary search."""
    return np.searchsorted(sorted_, sorted_, "right") - np.searchsorted(sorted_, sorted_, "left") > 1


def _merge(batches):
    """Marks pass; strings of split shards, sorted by digest, are marked if another shard has them.

    A shard sends a string once, so a digest that stands twice comes from two shards.
    """
    held: list[pa.RecordBatch] = []  # of one kind
    rows = 0

    def settle(keep_last: bool):
        """Marks for what is held; the last digest may go on in the next batch."""
        nonlocal held, rows
        if not held:
            return
        kind = held[0].column(0)[0].as_py() - 2
        whole = pa.Table.from_batches(held).combine_chunks()
        d1, d2 = whole.column("d1").to_numpy(), whole.column("d2").to_numpy()
        end = int(np.searchsorted(d1, d1[-1], "left")) if keep_last else len(d1)
        held = whole.slice(end).to_batches() if end < len(d1) else []
        rows = len(d1) - end
        d1, d2 = d1[:end], d2[:end]
        able = several(d1)
        both = d1[able], d2[able]
        back = np.unique(np.stack(both, 1), axis=0, return_inverse=True, return_counts=True) if able.any() else None
        if back is not None:
            again = np.nonzero(able)[0][back[2][back[1].ravel()] > 1]
            found = whole.take(pa.array(again))
            found = found.filter(pc.equal(found.column("n"), 1))
            none = pa.nulls(found.num_rows, pa.int64())
            yield from pa.table([pa.array(np.full(found.num_rows, kind, np.int32)), *(found.column(c) for c in ("id", "key", "a", "n")), none, none], names=found.column_names).combine_chunks().to_batches()

    for b in batches:
        yield b.filter(pc.less(b.column(0), 2))
        for kind in (2, 3):
            strings = b.filter(pc.equal(b.column(0), kind))
            if not strings.num_rows:
                continue
            if held and held[0].column(0)[0].as_py() != kind:
                yield from settle(False)
            held.append(strings)
            rows += strings.num_rows
            if rows >= 50_000:
                yield from settle(True)
    yield from settle(False)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """id long (null doc_id: the least long), key long (XXH64 of the text), spans array<struct<kind int, a int, n int>>: runs of starts of repeated strings, of LENGTH bytes (kind 0) and of SHORT (1, where no kind 0 starts)."""
    spark = docs.sparkSession
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    expected = max(1, size // 80)  # an anchor for each 155 bytes of ordinary text
    log_width = log_width_for(expected)
    sketch, heavy = merged_sketch(docs, _anchor_hashes, log_width, expected, HEAVY, SPLIT)
    hot = {int(np.uint64(h).astype(np.int64)): -(-n // SPLIT) for h, n in heavy.items()}
    shared = spark.sparkContext.broadcast((sketch, hot))
    n = max(width(spark), -(-size // (8 << 20)))
    shipped = docs.mapInArrow(_ship(shared, log_width), _BLOCKS)
    marks = shipped.repartition(n, "anchor", "salt").sortWithinPartitions("anchor", "salt").mapInArrow(_shards(shared), _Out.SCHEMA)
    merged = marks.repartition(n, F.coalesce("d1", F.xxhash64("id", "key"))).sortWithinPartitions("kind", "d1", "d2").mapInArrow(_merge, _Out.SCHEMA)
    return merged.groupBy("id", "key").agg(F.sort_array(F.collect_list(F.struct("kind", "a", "n"))).alias("spans"))


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes long, n_removed long, n_spans long, kept binary: texts without bytes under a string of LENGTH bytes that occurs twice;
    n_short long: bytes under a string of SHORT bytes that does, which stay where no longer one covers them.

    Every occurrence goes, the first too; strings overlap and are judged on the
    input.  Null texts are empty.  A repeated row is a place of its own, so long
    repeated rows lose everything.
    """
    rows = docs.select("doc_id", "text")
    spans = repeated_spans(rows)
    keyed = rows.withColumn("_id", F.coalesce("doc_id", F.lit(_NO_ID))).withColumn("_key", F.xxhash64("text"))
    joined = keyed.join(spans, (keyed["_id"] == spans["id"]) & (keyed["_key"] == spans["key"]), "left").select("doc_id", "text", F.col("spans.kind").alias("kind"), F.col("spans.a").alias("a"), F.col("spans.n").alias("n"))

    def apply(batches):
        for batch in slices(batches):
            out = [[], [], [], [], []]
            for text, kinds, a, n in zip(*(batch.column(i) for i in (1, 2, 3, 4)), strict=True):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                found = np.array([kinds.as_py() or [], a.as_py() or [], n.as_py() or []], np.int64)
                own = np.stack((found[1], found[1] + found[2] + np.where(found[0] == 0, LENGTH, SHORT) - 1))
                kept, at, runs = [], 0, _covered(own[:, found[0] == 0])
                for x, y in runs:
                    kept.append(data[at:x])
                    at = y
                kept = b"".join([*kept, data[at:]])
                short = sum(y - x for x, y in _covered(own[:, np.argsort(own[0])]))
                for to, v in zip(out, (len(data), len(data) - len(kept), len(runs), kept, short), strict=True):
                    to.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, pa.int64()) for x in out[:3]], pa.array(out[3], pa.binary()), pa.array(out[4], pa.int64())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "n_short"])

    return joined.mapInArrow(apply, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, n_short long")


def _covered(runs: np.ndarray) -> list[tuple[int, int]]:
    """Maximal stretches [x, y) of bytes in stretches (first, stop) sorted by their first."""
    out: list[tuple[int, int]] = []
    for a, stop in runs.T.tolist():
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], stop))
        else:
            out.append((a, stop))
    return out


def op5_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_short")


_SQL_RUNS = """
win{k} AS (SELECT doc_id, i, md5(substr(x, 2 * i - 1, 2 * {k})) AS g FROM (SELECT doc_id, x, unnest(range(1, length(x) // 2 - {k} + 2)) AS i FROM h WHERE length(x) >= 2 * {k})),
twice{k} AS (SELECT doc_id, i FROM win{k} QUALIFY count(*) OVER (PARTITION BY g) > 1),
steps{k} AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER o + {k} THEN 0 ELSE 1 END AS fresh FROM twice{k} WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
runs{k} AS (SELECT doc_id, min(i) AS a, max(i) + {k} AS b FROM (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM steps{k}) GROUP BY doc_id, run),
sums{k} AS (SELECT doc_id, sum(b - a) AS n{k}, count(*) AS k{k} FROM runs{k} GROUP BY doc_id)"""
SQL = f"""
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),{_SQL_RUNS.format(k=LENGTH)},{_SQL_RUNS.format(k=SHORT)},
edges AS (SELECT doc_id, a, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 1) AS from_ FROM (SELECT * FROM runs{LENGTH} UNION ALL SELECT doc_id, length(x) // 2 + 1, NULL FROM h)),
kept AS (SELECT doc_id, string_agg(substr(x, 2 * from_ - 1, 2 * (a - from_)), '' ORDER BY a, from_) AS t FROM edges JOIN h USING (doc_id) GROUP BY doc_id)
SELECT doc_id, length(x) // 2 AS n_bytes, coalesce(n{LENGTH}, 0)::BIGINT AS n_removed, coalesce(k{LENGTH}, 0)::BIGINT AS n_spans, sha256(unhex(t)) AS kept_sha256, coalesce(n{SHORT}, 0)::BIGINT AS n_short
FROM h JOIN kept USING (doc_id) LEFT JOIN sums{LENGTH} USING (doc_id) LEFT JOIN sums{SHORT} USING (doc_id)
"""
