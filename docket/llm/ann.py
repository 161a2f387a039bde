"""Approximate nearest neighbours by learned partitions.

A neighbour graph of a bounded sample is cut into balanced parts; a small
network then learns to name a vector's part.  Every row is indexed under its most
probable part, and a query is answered from its several most probable ones,
re-ranked exactly.  How many is measured, not guessed: a bounded set of queries is
answered by brute force over all rows, and the probes are raised until the wanted
share of their true neighbours is within reach.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import table

#: Rows a part should hold, and the most parts there are.
PART_ROWS, MAX_PARTS = 2048, 256
#: Sampled rows for each part, and at most; neighbours in the sample's graph.
PER_PART, MAX_SAMPLE, GRAPH_K = 64, 16_384, 10
#: Rows of the sample that are compared with all of it at once.
GRAPH_BLOCK = 128
#: Brute-forced queries at most, and the share of their neighbours that must be reached.
MEASURED, RECALL = 256, 0.96
#: Rows of a part that are scored together.
BLOCK = 4096
HIDDEN, EPOCHS, BATCH, RATE, SEED = 128, 40, 128, 2e-3, 11


@dataclass
class Router:
    """Network from vectors to parts: one hidden layer."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    scale: float

    def order(self, x: np.ndarray) -> np.ndarray:
        """Parts of each vector, most probable first, ties to the lower number."""
        h = np.maximum(x * self.scale @ self.w1 + self.b1, 0)
        return np.argsort(-(h @ self.w2 + self.b2), axis=1, kind="stable")


def neighbour_graph(x: np.ndarray, k: int = GRAPH_K) -> np.ndarray:
    """The k rows of largest inner product with each row, itself left out."""
    k = min(k, len(x) - 1)
    out = np.empty((len(x), k), np.int64)  # filled in place: a slice kept of each block's order would keep the whole block
    for a in range(0, len(x), GRAPH_BLOCK):
        s = x[a : a + GRAPH_BLOCK] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
        out[a : a + GRAPH_BLOCK] = np.argpartition(np.negative(s, out=s), k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 12, slack: float = 1.1) -> np.ndarray:
    """A part for each node: halved along main directions, then moved to where most neighbours are while there is room."""
    label, todo = np.zeros(len(x), np.int64), [(np.arange(len(x)), 0, parts)]
    while todo:
        ids, first, n = todo.pop()
        if n == 1 or len(ids) < 2:
            label[ids] = first
            continue
        y = x[ids] - x[ids].mean(0)
        axis = np.linalg.eigh(y.T @ y)[1][:, -1]
        ids = ids[np.argsort(y @ axis, kind="stable")]
        half = n // 2
        at = len(ids) * half // n
        todo += [(ids[:at], first, half), (ids[at:], first + half, n - half)]
    room = int(np.ceil(slack * len(x) / parts))
    src = np.repeat(np.arange(len(x)), graph.shape[1])
    ends = np.concatenate((src, graph.ravel())), np.concatenate((graph.ravel(), src))
    for _ in range(rounds):
        near = np.bincount(ends[0] * parts + label[ends[1]], minlength=len(x) * parts).reshape(len(x), parts)
        best = near.argmax(1)
        gain = near[np.arange(len(x)), best] - near[np.arange(len(x)), label]
        size, moved = np.bincount(label, minlength=parts), 0
        for i in np.argsort(-gain, kind="stable")[: int((gain > 0).sum())].tolist():
            if size[best[i]] < room:
                size[label[i]] -= 1
                size[best[i]] += 1
                label[i] = best[i]
                moved += 1
        if not moved:
            break
    return label


def fit_router(x: np.ndarray, label: np.ndarray, parts: int) -> Router:
    """Adam on the cross-entropy of the part."""
    rng, d = np.random.default_rng(SEED), x.shape[1]
    scale = float(np.sqrt(d) / max(np.linalg.norm(x, axis=1).mean(), 1e-12))
    x = x * scale
    ps = [rng.normal(0, np.sqrt(2 / d), (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), (HIDDEN, parts)), np.zeros(parts)]
    m, v, t = [np.zeros_like(p) for p in ps], [np.zeros_like(p) for p in ps], 0
    for _ in range(EPOCHS):
        for ids in np.array_split(rng.permutation(len(x)), max(1, len(x) // BATCH)):
            h = np.maximum(x[ids] @ ps[0] + ps[1], 0)
            z = h @ ps[2] + ps[3]
            g = np.exp(z - z.max(1, keepdims=True))
            g /= g.sum(1, keepdims=True)
            g[np.arange(len(ids)), label[ids]] -= 1
            g /= len(ids)
            gh = (g @ ps[2].T) * (h > 0)
            t += 1
            for i, grad in enumerate((x[ids].T @ gh, gh.sum(0), h.T @ g, g.sum(0))):
                m[i] = 0.9 * m[i] + 0.1 * grad
                v[i] = 0.999 * v[i] + 0.001 * grad * grad
                ps[i] -= RATE * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return Router(*ps, scale)


def _matrix(column) -> np.ndarray:
    """Rows of equal length as doubles."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(flat), -1)


def exact(q: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products, the same for equal rows wherever they stand (a matrix product may differ in the last digit)."""
    return (rows * q).sum(axis=1)


def top(q: np.ndarray, q_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int):
    """For each query (places in rows, scores) of its k best rows, own id left out, ties to the smaller id."""
    approx = q @ rows.T
    slack = 1e-9 * (1 + np.abs(approx).max(initial=0))
    for i in range(len(q)):
        open_ = np.nonzero(ids != q_ids[i])[0]
        s = approx[i, open_]
        if len(open_) > k:
            open_ = open_[s >= np.partition(s, len(s) - k)[len(s) - k] - slack]
        score = exact(q[i], rows[open_])
        best = np.lexsort((ids[open_], -score))[:k]
        yield open_[best], score[best]


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id long, vec array<double>: rows that take part.

    Left out: null ids; vectors null, empty, zero, or with null or non-finite
    components; vectors of another length than most have (ties: the shorter). Of
    rows with the same id one takes part, the one of the least vector.
    """
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec")).where(F.col("id").isNotNull() & F.col("vec").isNotNull() & ~bad & F.exists("vec", lambda x: x != 0))
    sizes = rows.groupBy(F.size("vec").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not sizes:
        return rows
    rows = rows.where(F.size("vec") == sizes[0]["d"])
    n = rows.agg(F.count("*"), F.count_distinct("id")).first()
    return rows if n[0] == n[1] else rows.groupBy("id").agg(F.min("vec").alias("vec"))


def least(rows: DataFrame, n: int, want: int, draw: Column) -> DataFrame:
    """The `want` of n rows with the least draws (a 64-bit hash), ties to the smaller id.

    Only rows below a threshold that some more than `want` pass are sorted; else every task would send `want` rows to the driver.
    """
    share = (want + 8 * want**0.5 + 64) / max(n, 1)
    if share < 1:
        near = rows.where(draw < F.lit(int(-(2**63) + share * 2**64)))
        rows = near if near.count() >= want else rows
    return rows.orderBy(draw, "id").limit(want)


def search(df: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", recall: float = RECALL) -> DataFrame:
    """query_id long, rank int, vec_id long, score double: the k nearest found of every row whose id is divisible by `every`."""
    spark = df.sparkSession
    sc = spark.sparkContext
    rows = usable(df, id_col, vec_col)
    n = rows.count()
    out = "query_id long, rank int, vec_id long, score double"
    if n < 2:
        return spark.createDataFrame([], out)
    parts = int(min(MAX_PARTS, max(1, 2 ** round(np.log2(max(1, n / PART_ROWS))))))
    draw = F.xxhash64("id", F.lit(SEED))
    sample = _matrix(least(rows, n, min(MAX_SAMPLE, max(256, PER_PART * parts)), draw).select("vec").toArrow().column("vec"))
    if parts > 1:
        router = fit_router(sample, balanced_parts(sample, neighbour_graph(sample), parts), parts)
    else:
        router = Router(np.zeros((sample.shape[1], 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1), 1.0)
    shared = sc.broadcast(router)

    def route(batches):
        for b in batches:
            part = shared.value.order(_matrix(b.column(1)))[:, 0] if b.num_rows else []
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(part, pa.int32())], ["id", "vec", "part"])

    index = rows.mapInArrow(route, "id long, vec array<double>, part int")
    counts = {r["part"]: r["count"] for r in index.groupBy("part").count().collect()}  # at most MAX_PARTS rows
    blocks = {p: -(-c // BLOCK) for p, c in counts.items()}
    probes = _probes(rows, router, shared, parts, k, every, recall, draw)
    share = F.element_at(F.create_map(*[F.lit(x) for p in blocks.items() for x in p]), F.col("part"))
    indexed = index.withColumn("block", F.pmod(F.xxhash64("id"), share.cast("long")).cast("int"))

    def ask(batches):
        for b in batches:
            if not b.num_rows:
                continue
            order = shared.value.order(_matrix(b.column(1)))
            at, part, block = [], [], []
            for i, row in enumerate(order.tolist()):
                for p in [p for p in row if p in blocks][:probes]:
                    for j in range(blocks[p]):
                        at.append(i)
                        part.append(p)
                        block.append(j)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at)), pa.array(part, pa.int32()), pa.array(block, pa.int32())], ["id", "vec", "part", "block"])

    asked = rows.where(F.col("id") % every == 0).mapInArrow(ask, "id long, vec array<double>, part int, block int")
    best = pa.list_(pa.struct([("neg", pa.float64()), ("vec_id", pa.int64())]))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        q_ids, ids = left.column("id").to_numpy(), right.column("id").to_numpy()
        found = []
        if len(q_ids) and len(ids):
            rows_ = _matrix(right.column("vec"))
            for a in range(0, len(q_ids), 1024):
                q = _matrix(left.column("vec").slice(a, 1024))
                found += [[{"neg": -s, "vec_id": v} for v, s in zip(ids[at].tolist(), ss.tolist(), strict=True)] for at, ss in top(q, q_ids[a : a + 1024], rows_, ids, k)]
        return pa.table({"query_id": pa.array(q_ids[: len(found)], pa.int64()), "found": pa.array(found, best)})

    scored = asked.groupBy("part", "block").cogroup(indexed.groupBy("part", "block")).applyInArrow(score, "query_id long, found array<struct<neg:double,vec_id:long>>")
    ranked = scored.groupBy("query_id").agg(F.slice(F.sort_array(F.flatten(F.collect_list("found"))), 1, k).alias("found"))
    return ranked.select("query_id", F.posexplode("found").alias("p", "f")).select("query_id", (F.col("p") + 1).alias("rank"), "f.vec_id", (-F.col("f.neg")).alias("score"))


def _probes(rows: DataFrame, router: Router, shared, parts: int, k: int, every: int, recall: float, draw) -> int:
    """Fewest parts to ask so that `recall` of the measured queries' true neighbours are in them."""
    if parts == 1:
        return 1
    queries = rows.where(F.col("id") % every == 0)
    picked = least(queries, queries.count(), MEASURED, draw).toArrow()
    if not picked.num_rows:
        return 1
    q, q_ids = _matrix(picked.column("vec")), picked.column("id").to_numpy()
    asked = rows.sparkSession.sparkContext.broadcast((q, q_ids))

    def brute(batches):
        """The task's k best of each measured query, with their part: a bounded table whatever the rows."""
        q, q_ids = asked.value
        held = [[] for _ in q_ids]
        for b in batches:
            if b.num_rows:
                x, ids = _matrix(b.column(1)), b.column(0).to_numpy()
                part = shared.value.order(x)[:, 0]
                for i, (at, s) in enumerate(top(q, q_ids, x, ids, k)):
                    held[i] = sorted([*held[i], *zip((-s).tolist(), ids[at].tolist(), part[at].tolist(), strict=True)])[:k]
        flat = [(i, *x) for i, xs in enumerate(held) for x in xs]
        cols = list(zip(*flat, strict=True)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.float64(), pa.int64(), pa.int32()), strict=True)], ["q", "neg", "id", "part"])

    found = rows.mapInArrow(brute, "q int, neg double, id long, part int")
    found = found.groupBy("q").agg(F.slice(F.sort_array(F.collect_list(F.struct("neg", "id", "part"))), 1, k).alias("best")).collect()
    place = np.argsort(router.order(q), axis=1)
    need = np.sort([place[r["q"], x["part"]] for r in found for x in r["best"]])
    return int(need[min(len(need) - 1, int(np.ceil(recall * len(need))) - 1)]) + 1 if len(need) else 1


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))
