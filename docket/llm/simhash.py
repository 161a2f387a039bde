"""SimHash near-dedup with pigeonring candidate filtering.

A 64-bit fingerprint is a ring of eight 8-bit segments.  If two fingerprints
differ in at most t bits, then some segment starts a chain whose first l segments
together differ in at most l*t/8 bits, for every l.  With t = 3 the budgets are
0 0 1 1 1 2 2 3: such a chain has its first two segments equal and one difference at
most in the next three, so two of those three are equal too.  Those four segments
(32 bits) are an equi-join key, 24 keys a fingerprint; inside a key's bucket the rest
of the chain is checked, then the whole distance.  Buckets yield spanning stars, not
pairs, and components are joined by alternating large and small stars.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import cut, slices, table, unused, width

SHINGLE = 3
DISTANCE = 3
SEED = 42
SEGMENTS, BITS = 8, 8
#: Shingles that are summed at once; 255 rows fit a byte lane.
LANE = 255
CHUNK = LANE * 256


def _bit_counts(digests: bytes) -> np.ndarray:
    """How often each of 64 bits (highest first) is set in a run of 8-byte digests."""
    bits = np.unpackbits(np.frombuffer(digests, np.uint8)).reshape(-1, 64)
    pad = -len(bits) % LANE
    if pad:
        bits = np.concatenate((bits, np.zeros((pad, 64), np.uint8)))
    lanes = bits.view(np.uint64).reshape(-1, LANE, 8).sum(axis=1)
    return lanes.view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)


def digests(text: str | None, shingle: int) -> Iterator[bytes]:
    """Eight-byte XXH64 of each shingle of A-Z-folded words, some CHUNK at a time; a shorter text is one shingle, no words have none."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return
    whole = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    n, digest = len(words) - k + 1, xxhash.xxh64_digest
    for at in range(0, n, CHUNK):
        pairs = zip(starts[at : min(n, at + CHUNK)].tolist(), ends[at + k - 1 : min(n, at + CHUNK) + k - 1].tolist(), strict=True)
        yield b"".join([digest(whole[a:b], SEED) for a, b in pairs])


def majority(chunks: Iterable[bytes]) -> int:
    """Signed 64-bit fingerprint of digests, repeats included: bits set in over half of them; 0 without any."""
    n, counts = 0, np.zeros(64, np.int64)
    for chunk in chunks:
        n += len(chunk) // 8
        counts += _bit_counts(chunk)
    return int(np.packbits(counts * 2 > n).view(">i8")[0]) if n else 0


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Signed 64-bit fingerprint of A-Z-folded words, repeats included; 0 without words."""
    return majority(digests(text, shingle))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp long."""

    def run(batches):
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], pa.int64())], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def budgets(distance: int = DISTANCE) -> list[tuple[int, int]]:
    """(mask of the first l segments, differences allowed in them), for each l that tells more than the next."""
    out = [((1 << BITS * n) - 1, n * distance // SEGMENTS) for n in range(1, SEGMENTS + 1)]
    return [x for i, x in enumerate(out) if i == len(out) - 1 or out[i + 1][1] > x[1]]


def _rotated(fp: np.ndarray, start: int) -> np.ndarray:
    if not start:
        return fp
    return (fp >> np.uint64(BITS * start)) | (fp << np.uint64(64 - BITS * start))


def linked(one: np.uint64, rest: np.ndarray, chain: list[tuple[int, int]]) -> np.ndarray:
    """Places in rest (turned so that the chain starts at bit 0) that keep within every budget; the last is the full distance."""
    found = np.arange(len(rest))
    for mask, most in chain:
        found = found[np.bitwise_count((rest[found] ^ one) & np.uint64(mask)) <= most]
        if not len(found):
            break
    return found


def _stars(fps: np.ndarray, start: int, chain) -> list[tuple[int, int]]:
    """(member, least member) for each component of two or more in a bucket of distinct fingerprints.

    Reached fingerprints leave the pool, so a dense bucket takes about one look each.
    """
    fps = np.sort(fps)
    turned, pool, out = _rotated(fps.view(np.uint64), start), np.arange(len(fps)), []
    while len(pool) > 1:
        root, pool = pool[0], pool[1:]
        todo = [root]
        while todo and len(pool):
            near = linked(turned[todo.pop()], turned[pool], chain)
            if len(near):
                found = pool[near]
                out += [(f, int(fps[root])) for f in fps[found].tolist()]
                todo += found.tolist()
                pool = np.delete(pool, near)
    return out


def _link_buckets(batches, distance: int = DISTANCE):
    """Batches of (key, fp), sorted by key: star edges of each bucket."""
    chain = budgets(distance)
    held_key, held = None, []

    def emit(edges):
        if edges:
            a, b = zip(*edges, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["u", "v"])

    for batch in batches:
        keys, fps = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(keys):
            continue
        cuts = np.concatenate(([0], np.nonzero(np.diff(keys))[0] + 1, [len(keys)]))
        several = np.diff(cuts) > 1
        several[[0, -1]] = True  # these may go on in the batch before or after
        edges: list[tuple[int, int]] = []
        for a, b in zip(cuts[:-1][several].tolist(), cuts[1:][several].tolist(), strict=True):
            if keys[a] != held_key:
                if sum(map(len, held)) > 1:
                    edges += _stars(np.concatenate(held), (held_key >> 40) // 3, chain)
                held_key, held = int(keys[a]), []
            held.append(fps[a:b])
        yield from emit(edges)
    if sum(map(len, held)) > 1:
        yield from emit(_stars(np.concatenate(held), (held_key >> 40) // 3, chain))


def links(fps: DataFrame) -> DataFrame:
    """Edges (u, v), v the lesser, that connect distinct fingerprints (column fp) of distance DISTANCE or less."""
    keys = []
    for i in range(SEGMENTS):
        turned = F.col("fp") if not i else F.shiftrightunsigned("fp", BITS * i).bitwiseOR(F.shiftleft("fp", 64 - BITS * i))
        for j, mask in enumerate((0x00FFFFFFFF, 0xFFFF00FFFF, 0xFF00FFFFFF)):  # segments 0 1 and two of 2 3 4
            keys.append(turned.bitwiseAND(F.lit(mask)).bitwiseOR(F.lit((3 * i + j) << 40)))
    rows = fps.select("fp", F.explode(F.array(*keys)).alias("key")).select("key", "fp")
    return rows.repartition(width(fps.sparkSession), "key").sortWithinPartitions("key").mapInArrow(_link_buckets, "u long, v long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """u, v: each node that is not the least of its component, and that least one.

    Alternating large-star and small-star steps (no step holds a node's
    neighbours together) until nothing changes.
    """
    edges, before = cut(edges), None
    while True:
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if not state[0] or tuple(state) == before:
            return edges
        before = tuple(state)
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("w")).select(F.col("u").alias("n"), F.least("u", "w").alias("m"))
        large = both.join(least, both["u"] == least["n"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), "m")
        small = large.join(least, large["u"] == least["n"]).select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = cut(small.select("e.*").where("u != v").distinct())


def group(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp long, component_id: the smallest doc_id that links of DISTANCE bits reach.

    Null and empty texts and texts without words have fingerprint 0, which links like
    any other.  Repeated rows stay; rows of equal fingerprints are one node.
    """
    prints = cut(fingerprints(docs, shingle))
    nodes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    stars = components(links(nodes.select("fp")))
    members = stars.union(stars.select("v", "v").distinct())
    named = members.join(nodes, members["u"] == nodes["fp"]).select("u", "v", "least")
    first = named.groupBy("v").agg(F.min("least").alias("first")).withColumnRenamed("v", "root")
    of = named.join(first, named["v"] == first["root"]).select(F.col("u").alias("node"), "first")
    names = nodes.join(of, nodes["fp"] == of["node"], "left").select(F.col("fp").alias("f"), F.coalesce("first", "least").alias("component_id"))
    names = cut(names)  # both sides of the join are then dealt anew, so a hot fingerprint's rows can be split
    return prints.join(names, prints["fp"] == names["f"]).select("doc_id", "fp", "component_id")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group(table(spark, sf_dir, "documents")).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """documents, one row of each group of near copies: that of the smallest doc_id, then of the least text hash; null ids come last.

    A stage on word shingles takes five words and similarity 0.8 or more: fingerprints of five-word shingles give
    the first candidates, `near` finds those beyond DISTANCE bits, and only an exact similarity links.  A
    row is a document by itself: other texts of a repeated or null doc_id are judged by themselves.  Repeated rows are
    copies, and texts without words are copies of each other.  Other columns stay as they are, whatever
    their names.  An empty table gives an empty result.
    """
    from . import near  # it uses links() and components()

    keep = near.group(docs.select("doc_id", "text"), first=True)
    name = unused(docs, "th")
    kept = docs.withColumn(name, F.xxhash64("text"))
    kept = kept.join(keep, F.col(name).eqNullSafe(keep["of_th"]) & docs["doc_id"].eqNullSafe(keep["of_id"]), "left_semi")
    if keep.where("rows > 1").isEmpty():
        return kept.drop(name)
    at = unused(kept, "at")  # of rows of one doc_id and text that differ elsewhere, the least as JSON
    order = F.row_number().over(W.partitionBy("doc_id", name).orderBy(F.to_json(F.struct(*docs.columns))))
    return kept.withColumn(at, order).where(F.col(at) == 1).drop(name, at)
