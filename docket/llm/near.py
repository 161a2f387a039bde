"""Near copies by exact Jaccard similarity of five-word shingles.

Texts of equal shingle sets are one node.  SimHash fingerprints of the shingles come first: fingerprints that
pigeonring chains link within a few bits give candidates.  Similar texts differ in up to some 16 of 64
bits, which leaves chains no segments to join on, so keys of min-hashes find the rest: a node has
BANDS keys, each of ROWS min-hashes, and two sets of similarity s share a key with chance
1 - (1 - s^ROWS)^BANDS: 0.99993 at 0.8, more above.  Only an exact similarity of 4/5 or more links.
In each bucket that is not one component yet, those outside its largest component are compared with all
others, inside the tasks: what leaves a task are links between components, never pairs.  Large
buckets are split into blocks, and drawn pairs link most of them beforehand.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from ._common import cut, slices, width

SHINGLE = 5
#: Least similarity, as a fraction.
LEAST = (4, 5)
BANDS, ROWS = 24, 5
SEED = 42
#: Shingles that are min-hashed at once.
CHUNK = 2_048
#: Nodes whose texts are looked for by a broadcast at most.
FEW = 500_000
#: Rows, and shingles in millions, of a bucket that are compared as one block; a larger bucket has several blocks, each pair of blocks a cell of its own.
BLOCK, MILLIONS = 2_048, 4
#: Rounds that link before blocks do, in buckets of several blocks, at most; a round that links less than one of FRESH pairs is the last.
ROUNDS, FRESH = 12, 20

_DRAW = np.random.default_rng(SEED)
_MULT = _DRAW.integers(0, 1 << 63, (BANDS * ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _DRAW.integers(0, 1 << 63, (BANDS * ROWS, 1), dtype=np.uint64)


def _distinct(chunks: list[bytes]) -> np.ndarray:
    return np.unique(np.frombuffer(b"".join(chunks), ">i8").astype(np.int64))


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of runs of A-Z-folded words; a shorter text is one run, no words have none."""
    return _distinct(list(simhash.digests(text, shingle)))


def keys(found: np.ndarray) -> list[int]:
    """A key a band; none for an empty set."""
    if not len(found):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    hashes = found.view(np.uint64)
    for at in range(0, len(hashes), CHUNK):
        np.minimum(least, (hashes[at : at + CHUNK] * _MULT + _ADD).min(axis=1), out=least)
    return [xxhash.xxh64_intdigest(row.tobytes(), b) - (1 << 63) for b, row in enumerate(least.reshape(BANDS, ROWS))]


def prints(docs: DataFrame) -> DataFrame:
    """doc_id, th long (hash of the text), node long (hash of the shingle set), n int (its size), fp long (fingerprint), keys array<long>."""

    def run(batches):
        for batch in slices(batches):
            chunks = [list(simhash.digests(t.as_py(), SHINGLE)) for t in batch.column(2)]
            sets = [_distinct(c) for c in chunks]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1),
                    pa.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) - (1 << 63) for s in sets], pa.int64()),
                    pa.array([len(s) for s in sets], pa.int32()),
                    pa.array([simhash.majority(c) for c in chunks], pa.int64()),
                    pa.array([keys(s) for s in sets], pa.list_(pa.int64())),
                ],
                ["doc_id", "th", "node", "n", "fp", "keys"],
            )

    return docs.select("doc_id", F.xxhash64("text").alias("th"), "text").mapInArrow(run, "doc_id long, th long, node long, n int, fp long, keys array<long>")


def _sets(docs: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, set array<long> of each node in wanted (w), from one of its rows; docs has no row twice."""
    wanted = cut(wanted.join(nodes.select("node", "one"), F.col("w") == F.col("node")).select("node", F.col("one.doc_id").alias("d"), F.col("one.th").alias("t")))
    if wanted.count() <= FEW:
        wanted = F.broadcast(wanted)

    def run(batches):
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(t.as_py()) for t in batch.column(1)], pa.list_(pa.int64()))], ["node", "set"])

    texts = docs.select("doc_id", F.xxhash64("text").alias("th"), "text").join(wanted, (F.col("th") == F.col("t")) & F.col("doc_id").eqNullSafe(F.col("d"))).select("node", "text")
    return cut(texts.mapInArrow(run, "node long, set array<long>"))


def confirmed(pairs: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those of pairs (u, v) whose sets are similar enough; a node of many pairs is dealt to many tasks."""
    pairs = cut(pairs)
    if pairs.isEmpty():
        return pairs
    sets = _sets(docs, nodes, pairs.select(F.explode(F.array("u", "v")).alias("w")).distinct())
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("u"), F.lit(width(docs.sparkSession))))
    right = salted.select("v", "salt").distinct().join(sets, F.col("v") == F.col("node")).select(F.col("v").alias("rv"), F.col("salt").alias("rs"), F.col("set").alias("b"))
    both = salted.join(sets.withColumnRenamed("set", "a"), F.col("u") == F.col("node")).join(right, (F.col("v") == F.col("rv")) & (F.col("salt") == F.col("rs")))
    both = both.select("u", "v", F.size("a").alias("na"), F.size("b").alias("nb"), F.size(F.array_intersect("a", "b")).alias("c"))
    return both.where(F.col("c") * LEAST[1] >= (F.col("na") + F.col("nb") - F.col("c")) * LEAST[0]).select("u", "v")


def _near(a, b):
    """Sizes that allow the similarity."""
    return F.least(a, b) * LEAST[1] >= F.greatest(a, b) * LEAST[0]


def by_fingerprint(nodes: DataFrame) -> DataFrame:
    """Candidates (u, v): each node with the first of its fingerprint, and those first ones as fingerprints are linked."""
    one = cut(nodes.where("n > 0").groupBy("fp").agg(F.min("node").alias("first")))
    same = nodes.where("n > 0").join(one.withColumnRenamed("fp", "f"), F.col("fp") == F.col("f")).where("node != first").select(F.greatest("node", "first").alias("u"), F.least("node", "first").alias("v"))
    stars = simhash.links(one.select("fp"))
    a, b = (one.select(F.col("fp").alias(f"fp_{x}"), F.col("first").alias(x)) for x in "ab")
    linked = stars.join(a, F.col("u") == F.col("fp_a")).join(b, F.col("v") == F.col("fp_b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    return same.union(linked).distinct()


def links(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges (u, v) of similarity LEAST or more that connect all that share a key and are so similar.

    The first round takes the pairs that fingerprints give.  Buckets of more than a block then go through rounds in which each
    row is compared with one drawn row that is not linked to it yet, while rounds still link; last,
    all buckets that are still several components are compared in blocks.
    """
    rows = nodes.select("node", "n", F.explode("keys").alias("key"))
    named = cut(_of_keys(rows, F.count("*").alias("many")).where("many > 1").select("key", "node", "n", F.col("node").alias("root")))
    tested = cut(by_fingerprint(nodes))
    edges = cut(confirmed(tested, docs, nodes))
    named, turn = _renamed(named, edges), 0
    while True:
        large = cut(_of_keys(named, F.count("*").alias("many")).where(F.col("many") > BLOCK).select(*named.columns))
        if large.isEmpty():
            break
        drawn = F.min(F.struct(F.xxhash64("node", "key", F.lit(turn)).alias("h"), "node", "n", "root")).alias("d")
        pairs = _of_keys(large, drawn).where((F.col("root") != F.col("d.root")) & _near(F.col("n"), F.col("d.n")))
        pairs = pairs.select(F.greatest("node", "d.node").alias("u"), F.least("node", "d.node").alias("v")).distinct()
        pairs = cut(pairs.join(tested, ["u", "v"], "left_anti"))
        found = cut(confirmed(pairs, docs, nodes))
        tested, edges, turn = tested.union(pairs), edges.union(found), turn + 1
        named = _renamed(named, edges)
        if found.count() * FRESH < pairs.count() or turn == ROUNDS:
            break
    return edges.union(_rest(docs, nodes, named))


def _renamed(named: DataFrame, edges: DataFrame) -> DataFrame:
    """named with each node's component as root, without buckets that are one component."""
    of = simhash.components(edges).select(F.col("u").alias("m"), F.col("v").alias("r"))
    named = named.join(of, F.col("node") == F.col("m"), "left").select("key", "node", "n", F.coalesce("r", "node").alias("root"))
    return cut(_of_keys(cut(named), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("key", "node", "n", "root"))


def _of_keys(rows: DataFrame, *of: Column) -> DataFrame:
    """rows with aggregates of their key; a join, not a window, so that a hot key's rows can be split."""
    return rows.join(rows.groupBy(F.col("key").alias("k")).agg(*of), F.col("key") == F.col("k"))


def _rest(docs: DataFrame, nodes: DataFrame, named: DataFrame) -> DataFrame:
    """Edges (u, v) that connect what is similar in buckets of several components.

    Rows outside a bucket's largest component are its probes; every probe is compared with every row of another component.  Blocks
    of rows by blocks of probes are cells; one cell is all of an ordinary bucket.
    """
    if named.isEmpty():
        return named.select(F.col("node").alias("u"), F.col("root").alias("v"))
    of = named.groupBy("key", "root").agg(F.count("*").alias("c"), F.sum(F.col("n").cast("long")).alias("s")).groupBy(F.col("key").alias("k"))
    of = of.agg(F.sum("c").alias("c"), F.sum("s").alias("s"), F.max(F.struct("c", "s", "root")).alias("main"))
    blocks = lambda c, s: F.ceil(F.greatest(c / BLOCK, s / (MILLIONS * 1_000_000))).cast("int")
    of = of.select("k", F.col("main.root").alias("main"), blocks(F.col("c"), F.col("s")).alias("kh"), blocks(F.col("c") - F.col("main.c"), F.col("s") - F.col("main.s")).alias("kp"))
    rows = named.join(of, F.col("key") == F.col("k")).withColumns(
        {"probe": F.col("root") != F.col("main"), "h": F.pmod(F.xxhash64("node"), "kh").cast("int"), "p": F.pmod(F.xxhash64("node", "key"), "kp").cast("int")}
    )
    cells = F.expr("transform(sequence(0, kp - 1), x -> named_struct('h', h, 'p', x))")
    more = F.when(F.col("probe"), F.expr("transform(sequence(0, kh - 1), x -> named_struct('h', x, 'p', p))")).otherwise(F.expr("array()"))
    rows = rows.select("key", "node", "root", "h", F.when(F.col("probe"), F.col("p")).otherwise(-1).alias("p"), F.explode(F.array_distinct(F.concat(cells, more))).alias("cell"))
    sets = _sets(docs, nodes, named.select(F.col("node").alias("w")).distinct()).withColumnRenamed("node", "m")
    rows = rows.join(sets, F.col("node") == F.col("m")).select("key", F.col("cell.h").alias("ch"), F.col("cell.p").alias("cp"), "h", "p", "node", "root", "set")
    dealt = rows.repartition(2 * width(docs.sparkSession), "key", "ch", "cp")  # rows are sets, far larger than those of other joins
    dealt = dealt.sortWithinPartitions("key", "ch", "cp", "node")
    return cut(dealt.mapInArrow(_cells, "u long, v long").distinct())


def _cells(batches):
    """Rows (key, ch, cp, h, p, node, root, set) sorted by cell: links between components of a cell."""
    held, last = [], None

    def settle():
        edges = _linked(held)
        held.clear()
        if edges:
            u, v = zip(*edges, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    for b in batches:
        cells = list(zip(*(b.column(i).to_pylist() for i in range(3)), strict=True))
        sets = b.column(7)
        for i, (cell, h, p, node, root) in enumerate(zip(cells, *(b.column(j).to_pylist() for j in range(3, 7)), strict=True)):
            if cell != last:
                yield from settle()
                last = cell
            held.append((h == cell[1], p == cell[2], node, root, sets[i].values.to_numpy()))
    yield from settle()
    pa.default_memory_pool().release_unused()


def _linked(rows: list[tuple]) -> list[tuple[int, int]]:
    """(u, v), u the greater, for rows (home, probe, node, root, set): each probe with the similar homes of components that it is not linked to yet."""
    homes = [r for r in rows if r[0]]
    if len(rows) < 2 or not homes or not any(r[1] for r in rows):
        return []
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while up.get(x, x) != x:
            x = up[x]
        return x

    known = np.unique(np.concatenate([r[4] for r in rows]))
    flag = np.zeros(len(known), np.int32)
    at = np.searchsorted(known, np.concatenate([r[4] for r in homes]))
    size = np.array([len(r[4]) for r in homes])
    begin, out = np.cumsum(size) - size, []
    for _, probe, node, root, own in rows:
        if not probe:
            continue
        mine = np.searchsorted(known, own)
        flag[mine] = 1
        both = np.add.reduceat(flag[at], begin)
        flag[mine] = 0
        for j in np.nonzero(both * LEAST[1] >= (size + len(own) - both) * LEAST[0])[0].tolist():
            a, b = top(root), top(homes[j][3])
            if a != b:
                up[max(a, b)] = min(a, b)
                out.append((max(node, homes[j][2]), min(node, homes[j][2])))
    return out


def group(docs: DataFrame, first: bool = False) -> DataFrame:
    """doc_id, th long, component_id: the smallest doc_id that links reach; texts without words are one node.

    first: instead of that, of_id, of_th and rows (how often it stands there) of each component's
    first row, by doc_id (null last), then text hash.
    """
    found = cut(prints(docs))
    twice = cut(found.groupBy(F.col("doc_id").alias("i"), F.col("th").alias("t")).count().where("count > 1"))
    if not twice.isEmpty():
        docs = cut(docs.select("doc_id", "text").dropDuplicates())
    nodes = found.groupBy("node").agg(
        F.min("doc_id").alias("least"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("one"), F.first("n").alias("n"), F.min("fp").alias("fp"), F.min("keys").alias("keys")
    )
    nodes = cut(nodes)
    stars = simhash.components(links(docs, nodes)).select(F.col("u").alias("m"), F.col("v").alias("root"))
    named = cut(nodes.join(stars, F.col("node") == F.col("m"), "left").select(F.col("node").alias("f"), F.coalesce("root", "node").alias("root"), "least", "one"))
    if first:
        ones = named.groupBy("root").agg(F.min("one").alias("one")).select(F.col("one.doc_id").alias("of_id"), F.col("one.th").alias("of_th"))
        return cut(ones.join(twice, F.col("of_id").eqNullSafe(F.col("i")) & (F.col("of_th") == F.col("t")), "left").select("of_id", "of_th", F.coalesce("count", F.lit(1)).alias("rows")))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    names = cut(named.select("f", "root").join(least, "root").select("f", "component_id"))
    return found.select("doc_id", "th", "node").join(names, F.col("node") == F.col("f")).select("doc_id", "th", "component_id")
