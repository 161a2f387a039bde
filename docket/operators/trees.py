"""Multinomial histogram boosting and random-cut trees, many fits at once.

Rows are binned once and written.  Fits that leave out other rows (folds of several seeds) are an axis
of the histograms: one scan serves a level of the trees of all fits and classes.  Tasks
route rows through the trees grown so far and add up gradients by (fit, class, node, feature, bin); the
histograms are summed, subtracted for siblings and searched for the best cut by DataFrame operations, so the driver sees
one row a node.  Random-cut trees grow by levels too: least and greatest values a node, then class counts at cuts drawn between them.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..tables import written
from .trust import safe_columns

#: Bins of a feature at most; scores are written after so many rounds, those since are added again in each scan.
BINS, ROUNDS = 255, 10
#: Least Hessian of a leaf; gains are compared in so many decimals, ties going to the lesser feature and cut.
LEAST_HESSIAN, DECIMALS = 1e-3, 8
CELL = "fit int, cls int, node int, feature int, bin int, g double, h double, n long"


@dataclass
class Tree:
    """Arrays by node; feature -1 marks a leaf.  A row goes left where its value is at most the cut."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[float] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    value: list = field(default_factory=lambda: [0.0])

    def add(self, value=0.0) -> int:
        for part, x in ((self.feature, -1), (self.cut, 0), (self.left, -1), (self.right, -1), (self.value, value)):
            part.append(x)
        return len(self.feature) - 1

    def split(self, node: int, feature: int, cut: float, left: int, right: int) -> None:
        self.feature[node], self.cut[node], self.left[node], self.right[node] = feature, cut, left, right

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """Leaf of every row of x."""
        feature, cut, left, right = (np.asarray(part) for part in (self.feature, self.cut, self.left, self.right))
        at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        while (inner := feature[at] >= 0).any():
            i = rows[inner]
            a = at[i]
            at[i] = np.where(x[i, feature[a]] <= cut[a], left[a], right[a])
        return at

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.asarray(self.value)[self.leaf_of(x)]


def edges(df: DataFrame, columns: list[str], bins: int = BINS) -> list[list[float]]:
    """Upper edges of each column's bins, one fewer than bins at most: approximate quantiles, from one scan."""
    at = [i / bins for i in range(1, bins)]
    row = df.agg(*[F.percentile_approx(c, at, 10_000).alias(str(i)) for i, c in enumerate(columns)]).first()
    return [sorted(set(row[i] or [])) for i in range(len(columns))]


def _matrix(df: DataFrame, keep: list, columns: list[str], dtype: str, bounds: list[list[float]] | None) -> DataFrame:
    """The columns `keep` and `x` binary: values of columns, or numbers of their bins; missing values are 0."""
    filled = df.select(*keep, F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns]).alias("x"))
    names = filled.columns[:-1]
    schema = filled.withColumn("x", F.lit(b"")).schema

    def pack(batches):
        for batch in batches:
            x = np.array(batch.column(len(names)).to_pylist(), "float64").reshape(batch.num_rows, len(columns))
            if bounds is not None:
                x = np.column_stack([np.searchsorted(b, x[:, i], "left") for i, b in enumerate(bounds)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([r.tobytes() for r in x.astype(dtype)], pa.binary())], [*names, "x"])

    return filled.mapInArrow(pack, schema)


def _rows(column: pa.Array, dtype: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), width)


def softmax(raw: np.ndarray) -> np.ndarray:
    e = np.exp(raw - raw.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fold_columns(df: DataFrame, label: str, key: str, n: int, seeds: list[int]) -> DataFrame:
    """df with folds array<int>, one number for each seed: a label's rows are dealt evenly in the order of a hash.

    Rows are range-sorted by label and hash and numbered by the counts of the ranges before, so that no task holds a label; df's rows need distinct keys to be told apart.
    """
    spark, out = df.sparkSession, df.withColumn("folds", F.array().cast("array<int>"))
    for seed in seeds:
        draw = F.xxhash64(F.col(key), F.lit(seed))
        dealt = written(out.withColumn("_draw", draw).repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), label, "_draw", key).withColumn("_part", F.spark_partition_id()))
        sizes = dealt.groupBy("_part", label).count().collect()  # one row for each range, and one more for each label
        before, upto = {}, {}
        for r in sorted(sizes, key=lambda r: r["_part"]):
            before[r["_part"], r[label]] = upto.get(r[label], 0)
            upto[r[label]] = before[r["_part"], r[label]] + r["count"]
        start = spark.createDataFrame([(p, y, b) for (p, y), b in before.items()], f"_p int, _y {df.schema[label].dataType.simpleString()}, _b long")
        place = F.row_number().over(W.partitionBy("_part", label).orderBy("_draw", key)) - 1
        numbered = dealt.withColumn("_place", place).join(F.broadcast(start), (F.col("_part") == F.col("_p")) & F.col(label).eqNullSafe(F.col("_y")))
        out = numbered.withColumn("folds", F.concat("folds", F.array(((F.col("_place") + F.col("_b")) % n).cast("int")))).select(*out.columns)
    return out


class _Growing:
    """A tree on its way: its leaves, sums and best cuts of nodes, and the nodes whose histograms are still to come."""

    def __init__(self):
        self.tree, self.sums, self.best, self.kids, self.leaves = Tree(), {0: (0.0, 0.0)}, {}, {}, {0}
        self.missing, self.sibling, self.parent = [0], {}, {}

    def _open(self, node: int) -> tuple[int, int]:
        """The children of a node along its best cut; their sums are those of the cut's sides."""
        if node not in self.kids:
            cut, (g, h) = self.best[node], self.sums[node]
            a, b = self.kids[node] = (self.tree.add(), self.tree.add())
            self.tree.split(node, cut["feature"], cut["bin"], a, b)
            self.sums[a], self.sums[b] = (cut["g"], cut["h"]), (g - cut["g"], h - cut["h"])
        return self.kids[node]

    def advance(self, most: int) -> None:
        """Split best-first while every leaf's best cut is known, then ask for the leaves that block, and ahead for the children of what may be split next."""
        by_gain = lambda nodes: sorted((n for n in nodes if self.best.get(n)), key=lambda n: (-self.best[n]["gain"], n))
        while len(self.leaves) < most and all(n in self.best for n in self.leaves) and (able := by_gain(self.leaves)):
            self.leaves = self.leaves - {able[0]} | set(self._open(able[0]))
        self.missing, self.sibling = [], {}
        if len(self.leaves) >= most or not any(n not in self.best for n in self.leaves):
            return
        for node in by_gain(self.leaves)[: most - len(self.leaves) - 1]:
            self._open(node)
        for node, (a, b) in self.kids.items():
            if a not in self.best:
                cut = self.best[node]
                small, large = (a, b) if 2 * cut["left"] <= cut["n"] else (b, a)
                self.missing.append(small)
                self.sibling[small], self.parent[large] = large, node

    def finished(self, rate: float, l2: float) -> Tree:
        """The tree with what was never split cut off, and leaf values."""
        for node in self.leaves:
            self.tree.feature[node] = -1
            g, h = self.sums[node]
            self.tree.value[node] = -rate * g / (h + l2)
        return self.tree


@dataclass
class Boosted:
    """Fits of one boosting: base scores [fit][class], trees [round][fit][class], and the scans that growing took."""

    columns: list[str]
    bounds: list[list[float]]
    base: list[list[float]]
    trees: list[list[list[Tree]]]
    scans: int = 0

    def raw(self, bins: np.ndarray, fit: int) -> np.ndarray:
        out = np.tile(np.array(self.base[fit]), (len(bins), 1))
        for round_ in self.trees:
            for k, tree in enumerate(round_[fit]):
                out[:, k] += tree.scores(bins)
        return out

    def transform(self, df: DataFrame, out: str = "p", own: bool = False, folds: int = 0) -> DataFrame:
        """df with array `out` of class probabilities: of the first fit or, with own, the mean over seeds of the fits that left the row's fold out."""
        model = df.sparkSession.sparkContext.broadcast(self)
        keep = [c for c in df.columns if c != out]
        packed = _matrix(df, [F.struct(*keep).alias("row"), *([F.col("folds")] if own else [])], self.columns, "uint8", self.bounds)
        schema = packed.select("row").withColumn(out, F.array().cast("array<double>")).schema
        width, at = len(self.columns), packed.columns.index("x")

        def run(batches):
            for batch in batches:
                bins, m = _rows(batch.column(at), "uint8", width), model.value
                if own:
                    fold = np.array(batch.column(1).to_pylist(), np.int64).reshape(batch.num_rows, -1)
                    p = np.zeros((len(bins), len(m.base[0])))
                    for s in range(fold.shape[1]):
                        for f in range(folds):
                            mine = fold[:, s] == f
                            p[mine] += softmax(m.raw(bins[mine], s * folds + f))
                    p /= max(1, fold.shape[1])
                else:
                    p = softmax(m.raw(bins, 0))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p.tolist(), pa.list_(pa.float64()))], ["row", out])

        return packed.mapInArrow(run, schema).select("row.*", out)

    def save(self, spark: SparkSession, path: str) -> None:
        """One row a tree, in a folder that driver and executors share."""
        rows = [(r, f, k, json.dumps(t.__dict__)) for r, fits in enumerate(self.trees) for f, ts in enumerate(fits) for k, t in enumerate(ts)]
        head = json.dumps({"columns": self.columns, "bounds": self.bounds, "base": self.base})
        spark.createDataFrame([(-1, 0, 0, head), *rows], "round int, fit int, cls int, told string").write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Boosted:
        rows = sorted(spark.read.parquet(path).collect())
        out = cls(**json.loads(rows[0]["told"]), trees=[])
        for r in rows[1:]:
            if r["round"] == len(out.trees):
                out.trees.append([[] for _ in out.base])
            out.trees[r["round"]][r["fit"]].append(Tree(**json.loads(r["told"])))
        return out


def _cells(state: DataFrame, width: int, classes: int, left_out: list[tuple[int, int]], since: list, growing: list[list[Tree]], wanted: list[list[list[int]]], seeds: int) -> DataFrame:
    """CELL of the wanted nodes of every (fit, class): one scan, summed up within tasks first."""
    told = state.sparkSession.sparkContext.broadcast((left_out, since, growing, wanted))

    def run(batches):
        out, sums = told.value, {}
        fits_out, added, trees, nodes = out
        offset = np.arange(width) * (BINS + 1)
        for batch in batches:
            if not batch.num_rows:
                continue
            y = batch.column(0).to_numpy()
            bins = _rows(batch.column(2), "uint8", width)
            raw = _rows(batch.column(3), "float64", len(fits_out) * classes).reshape(len(y), len(fits_out), classes).copy()
            fold = np.array(batch.column(1).to_pylist(), np.int64).reshape(len(y), seeds)
            for j, (seed, k) in enumerate(fits_out):
                for round_ in added:
                    for c in range(classes):
                        raw[:, j, c] += round_[j][c].scores(bins)
                use = fold[:, seed] != k if seed >= 0 else np.ones(len(y), bool)
                p = softmax(raw[:, j])
                for c in range(classes):
                    g, h = p[:, c] - (y == c), p[:, c] * (1 - p[:, c])
                    leaf = trees[j][c].leaf_of(bins)
                    for node in nodes[j][c]:
                        mine = use & (leaf == node)
                        if not mine.any():
                            continue
                        at = (bins[mine].astype(np.int64) + offset).ravel()
                        size = width * (BINS + 1)
                        got = [np.bincount(at, np.repeat(w[mine], width), size) for w in (g, h)] + [np.bincount(at, minlength=size)]
                        key = (j, c, node)
                        sums[key] = [a + b for a, b in zip(sums[key], got, strict=True)] if key in sums else got
        for (j, c, node), (g, h, n) in sums.items():
            at = np.nonzero(n)[0]
            one = lambda v, m=len(at): pa.array(np.full(m, v, np.int32))
            cols = [one(j), one(c), one(node), pa.array((at // (BINS + 1)).astype(np.int32)), pa.array((at % (BINS + 1)).astype(np.int32)), pa.array(g[at]), pa.array(h[at]), pa.array(n[at].astype(np.int64))]
            yield pa.RecordBatch.from_arrays(cols, ["fit", "cls", "node", "feature", "bin", "g", "h", "n"])

    return state.mapInArrow(run, CELL)


def best_cuts(cells: DataFrame, min_leaf: int, l2: float) -> DataFrame:
    """fit, cls, node, g, h, n, best struct<gain, feature, bin, left, g, h>: sums of each node of CELL, and its best cut or null where none gains.

    A cut sends bins up to `bin` left (left rows, with sums g and h); gain is G^2/(H + l2) of both sides less that of the node.
    """
    one = W.partitionBy("fit", "cls", "node", "feature")
    upto = one.orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    s = cells.select("fit", "cls", "node", "feature", "bin", *[F.sum(c).over(upto).alias(f"l{c}") for c in "ghn"], *[F.sum(c).over(one).alias(c) for c in "ghn"])
    part = lambda g, h: g * g / (h + l2)
    gl, hl, nl, g, h, n = (F.col(c) for c in ("lg", "lh", "ln", "g", "h", "n"))
    gain = F.round(part(gl, hl) + part(g - gl, h - hl) - part(g, h), DECIMALS)
    fair = (nl >= min_leaf) & (n - nl >= min_leaf) & (hl >= LEAST_HESSIAN) & (h - hl >= LEAST_HESSIAN) & (gain > 0)
    cut = F.struct(gain.alias("gain"), (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"), nl.alias("left"), gl.alias("g"), hl.alias("h"))
    # Sums of a node are those of any of its features; the first's are taken.
    sums = F.min(F.struct("feature", "g", "h", "n"))
    best = s.groupBy("fit", "cls", "node").agg(sums.alias("s"), F.max(F.when(fair, cut)).alias("c"))
    found = F.when(F.col("c").isNotNull(), F.struct(F.col("c.gain").alias("gain"), (-F.col("c.f")).alias("feature"), (-F.col("c.b")).alias("bin"), *[F.col(f"c.{c}").alias(c) for c in ("left", "g", "h")]))
    return best.select("fit", "cls", "node", "s.g", "s.h", "s.n", found.alias("best"))


def boost(
    df: DataFrame, label: str, columns: list[str], classes: int = 3, iterations: int = 250, rate: float = 0.05, leaves: int = 15, min_leaf: int = 20, l2: float = 1.0, folds: int = 0, bounds: list[list[float]] | None = None
) -> Boosted:
    """Boosted multinomial trees on rows that have a label 0..classes-1.

    With folds, df has `folds array<int>` (see fold_columns) and there is a fit for each (seed, fold), seed by seed, that leaves the fold's rows out;
    otherwise one fit of all rows.  Trees grow best-first.  Columns of the untrusted layer are an error.
    """
    columns, spark = safe_columns(columns), df.sparkSession
    rows = df.where(F.col(label).isNotNull())
    bounds = edges(rows, columns) if bounds is None else bounds
    fold = F.col("folds") if folds else F.array().cast("array<int>")
    state = _matrix(rows, [F.col(label).cast("int").alias("y"), fold.alias("folds")], columns, "uint8", bounds)
    first = rows.select(fold.alias("folds")).first() if folds else None
    seeds = len(first["folds"]) if first else 0
    left_out = [(s, f) for s in range(seeds) for f in range(folds)] or [(-1, -1)]
    state = written(state.withColumn("raw", F.lit(b"")))
    counts = state.groupBy("y", "folds").count().collect()  # classes times folds to the power of seeds at most
    base = []
    for s, f in left_out:
        n = [sum(r["count"] for r in counts if r["y"] == c and (s < 0 or r["folds"][s] != f)) for c in range(classes)]
        base.append([math.log(max(x, 1e-12) / max(1, sum(n))) for x in n])
    model = Boosted(columns, bounds, base, [])
    start = np.array(base, "float64").tobytes()
    state = state.withColumn("raw", F.lit(start))
    width, fits = len(columns), len(left_out)
    total = sum(r["count"] for r in counts)
    for round_ in range(iterations if total else 0):
        since = model.trees[len(model.trees) - round_ % ROUNDS :] if round_ % ROUNDS else []
        if round_ and round_ % ROUNDS == 0:
            state = written(_added(state, width, fits, classes, model.trees[-ROUNDS:]))
        grow = [[_Growing() for _ in range(classes)] for _ in range(fits)]
        held: DataFrame | None = None
        while any(t.missing for ts in grow for t in ts):
            got = _cells(state, width, classes, left_out, since, [[t.tree for t in ts] for ts in grow], [[t.missing for t in ts] for ts in grow], max(1, seeds) if folds else 0)
            model.scans += 1
            twins = [(j, c, small, large, t.parent[large]) for j, ts in enumerate(grow) for c, t in enumerate(ts) for small, large in t.sibling.items()]
            got = got.groupBy("fit", "cls", "node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n"))
            if twins:
                got = written(got)
                pairs = F.broadcast(spark.createDataFrame(twins, "fit int, cls int, small int, large int, parent int"))
                names = ["fit", "cls", "node", "feature", "bin", "g", "h", "n"]
                above = held.withColumnRenamed("node", "parent").join(pairs.select("fit", "cls", "parent", F.col("large").alias("node")), ["fit", "cls", "parent"]).select(*names)
                less = got.withColumnRenamed("node", "small").join(pairs.select("fit", "cls", "small", F.col("large").alias("node")), ["fit", "cls", "small"])
                less = less.select("fit", "cls", "node", "feature", "bin", *[(-F.col(c)).alias(c) for c in "ghn"])
                rest = above.union(less).groupBy("fit", "cls", "node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n")).where("n > 0")
                got = got.select(*names).union(rest.select(*names))
            got = written(got)
            held = got if held is None else held.union(got)  # of all nodes so far: a leaf may be split scans later
            for r in best_cuts(got, min_leaf, l2).collect():  # one row a node
                t, cut = grow[r["fit"]][r["cls"]], r["best"]
                t.sums[r["node"]] = (r["g"], r["h"])
                t.best[r["node"]] = cut.asDict() | {"n": r["n"]} if cut else None
            for ts in grow:
                for t in ts:
                    for node in [*t.missing, *t.sibling.values()]:
                        t.best.setdefault(node)  # no rows, no cut
                    t.advance(leaves)
        model.trees.append([[t.finished(rate, l2) for t in ts] for ts in grow])
    return model


def _added(state: DataFrame, width: int, fits: int, classes: int, rounds: list) -> DataFrame:
    """state with the scores of these rounds added."""
    told = state.sparkSession.sparkContext.broadcast(rounds)

    def run(batches):
        for batch in batches:
            bins = _rows(batch.column(2), "uint8", width)
            raw = _rows(batch.column(3), "float64", fits * classes).reshape(batch.num_rows, fits, classes).copy()
            for round_ in told.value:
                for j in range(fits):
                    for c in range(classes):
                        raw[:, j, c] += round_[j][c].scores(bins)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([r.tobytes() for r in raw], pa.binary())], batch.schema.names)

    return state.mapInArrow(run, state.schema)


def boosted_out_of_fold(df: DataFrame, label: str, key: str, columns: list[str], classes: int = 3, n: int = 5, seeds: list[int] | None = None, **options) -> DataFrame:
    """df with folds and `p`, the mean over seeds of the probabilities by the fit that left the row's fold out; all fits share every scan."""
    dealt = written(fold_columns(df, label, key, n, [0, 1, 2, 3, 4] if seeds is None else seeds))
    return boost(dealt, label, columns, classes, folds=n, **options).transform(dealt, own=True, folds=n)


# ---- random-cut trees -----------------------------------------------------


@dataclass
class RandomCuts:
    """Trees of random cuts; a leaf's value is its share of each class."""

    columns: list[str]
    classes: int
    trees: list[Tree]

    def transform(self, df: DataFrame, out: str = "p") -> DataFrame:
        """df with array `out`: the mean of the trees' class shares."""
        model = df.sparkSession.sparkContext.broadcast(self)
        packed = _matrix(df, [F.struct(*[c for c in df.columns if c != out]).alias("row")], self.columns, "float64", None)
        schema, width = packed.select("row").withColumn(out, F.array().cast("array<double>")).schema, len(self.columns)

        def run(batches):
            for batch in batches:
                x, m = _rows(batch.column(1), "float64", width), model.value
                p = sum((t.scores(x) for t in m.trees), np.zeros((len(x), m.classes))) / max(1, len(m.trees))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p.tolist(), pa.list_(pa.float64()))], ["row", out])

        return packed.mapInArrow(run, schema).select("row.*", out)


def draw(seed, tree, path, what):
    """Uniform in (0, 1) from a CRC-32 of seed, tree, node path and a purpose; columns."""
    return (F.crc32(F.concat_ws(":", F.lit(str(seed)), tree.cast("string"), path.cast("string"), what.cast("string"))) + 0.5) / 4294967296.0


def random_cuts(df: DataFrame, label: str, columns: list[str], classes: int = 3, trees: int = 500, min_leaf: int = 3, seed: int = 100, max_depth: int = 40, tries: int | None = None) -> RandomCuts:
    """Trees that take the best (Gini) of `tries` features (root of their number), each cut at random between the node's own least and greatest value.

    All rows with a label serve every tree.  Features are tried in an order drawn by hash, constant ones passed over; draws depend on seed, tree and path alone, so
    reruns agree.  All open nodes of all trees share two scans a level.  Trees grow until leaves are pure, or have fewer than 2 * min_leaf rows.
    """
    columns, spark = safe_columns(columns), df.sparkSession
    tries = max(1, int(math.sqrt(len(columns)))) if tries is None else tries
    data, width = written(_matrix(df.where(F.col(label).isNotNull()), [F.col(label).cast("int").alias("y")], columns, "float64", None)), len(columns)
    grown = [Tree() for _ in range(trees)]
    paths = {(t, 0): 1 for t in range(trees)}  # (tree, open node) to its path: 1, then 2p and 2p + 1

    def scan(look, schema):
        told = spark.sparkContext.broadcast((grown, sorted(paths), look))

        def run(batches):
            forest, open_, cuts = told.value
            by_tree: dict[int, list[int]] = {}
            for t, node in open_:
                by_tree.setdefault(t, []).append(node)
            sums: dict = {}
            for batch in batches:
                if not batch.num_rows:
                    continue
                y, x = batch.column(0).to_numpy(), _rows(batch.column(1), "float64", width)
                for t, nodes in by_tree.items():
                    leaf = forest[t].leaf_of(x)
                    for node in nodes:
                        mine = leaf == node
                        if not mine.any():
                            continue
                        if cuts is None:
                            new = [(x[mine].min(0), x[mine].max(0), np.bincount(y[mine], minlength=classes))]
                            old = sums.get((t, node))
                            sums[t, node] = new if old is None else [(np.minimum(old[0][0], new[0][0]), np.maximum(old[0][1], new[0][1]), old[0][2] + new[0][2])]
                        else:
                            for f, c in cuts.get((t, node), ()):
                                got = np.bincount(y[mine & (x[:, f] <= c)], minlength=classes)
                                sums[t, node, f] = sums.get((t, node, f), 0) + got
            out = []
            for key, got in sums.items():
                if cuts is None:
                    lo, hi, n = got[0]
                    out += [(*key, f, float(lo[f]), float(hi[f]), n.tolist()) for f in range(width)]
                else:
                    out.append((*key, got.tolist()))
            names = [c.split()[0] for c in schema.split(", ")]
            kinds = {"tree": pa.int32(), "node": pa.int32(), "feature": pa.int32(), "lo": pa.float64(), "hi": pa.float64(), "n": pa.list_(pa.int64())}
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kinds[c]) for i, c in enumerate(names)], names)

        return data.mapInArrow(run, schema)

    add = lambda c: F.array(*[F.sum(F.get(c, F.lit(k))) for k in range(classes)])
    gini = lambda n, size: size - sum((F.get(n, F.lit(k)) * F.get(n, F.lit(k)) for k in range(classes)), F.lit(0)) / size
    for depth in range(max_depth + 1):
        if not paths:
            break
        ranges = scan(None, "tree int, node int, feature int, lo double, hi double, n array<long>").groupBy("tree", "node", "feature").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), add("n").alias("n"))
        places = spark.createDataFrame([(t, n, p) for (t, n), p in paths.items()], "tree int, node int, path long")
        ranges = written(ranges.join(F.broadcast(places), ["tree", "node"]))  # as many rows as nodes are open
        whole = {(r["tree"], r["node"]): r["n"] for r in ranges.where("feature = 0").select("tree", "node", "n").collect()}
        for (t, node), n in whole.items():
            grown[t].value[node] = [x / sum(n) for x in n]
        size = F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x)
        pure = F.array_max("n") == size
        order = W.partitionBy("tree", "node").orderBy(draw(seed, F.col("tree"), F.col("path"), F.concat(F.lit("order"), F.col("feature").cast("string"))), "feature")
        tried = ranges.where(~pure & (size >= 2 * min_leaf) & (F.col("lo") < F.col("hi"))).withColumn("i", F.row_number().over(order)).where(F.col("i") <= tries)
        u = draw(seed, F.col("tree"), F.col("path"), F.concat(F.lit("cut"), F.col("feature").cast("string")))
        # A cut must leave the greatest value to the right, also where rounding would not.
        at = F.col("lo") + u * (F.col("hi") - F.col("lo"))
        tried = written(tried.withColumn("cut", F.when(at < F.col("hi"), at).otherwise(F.col("lo"))))
        cuts: dict = {}
        for r in tried.select("tree", "node", "feature", "cut").collect() if depth < max_depth else ():
            cuts.setdefault((r["tree"], r["node"]), []).append((r["feature"], r["cut"]))
        if not cuts:
            break
        left = scan(cuts, "tree int, node int, feature int, n array<long>").groupBy("tree", "node", "feature").agg(add("n").alias("l"))
        both = tried.join(left, ["tree", "node", "feature"]).withColumn("r", F.zip_with("n", "l", lambda a, b: a - b))
        sizes = [F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x) for c in ("l", "r")]
        # Rounded, so that the order in which tasks report decides nothing; ties go to the lesser feature.
        cost = F.round(gini("l", sizes[0]) + gini("r", sizes[1]), DECIMALS)
        fair = both.where((sizes[0] >= min_leaf) & (sizes[1] >= min_leaf))
        chosen = fair.groupBy("tree", "node").agg(F.min(F.struct(cost.alias("cost"), "feature", "cut")).alias("c")).select("tree", "node", "c.feature", "c.cut").collect()
        coming = {}
        for r in sorted(chosen, key=lambda r: (r["tree"], r["node"])):
            t, path = r["tree"], paths[r["tree"], r["node"]]
            a, b = grown[t].add(), grown[t].add()
            grown[t].split(r["node"], r["feature"], r["cut"], a, b)
            coming[t, a], coming[t, b] = 2 * path, 2 * path + 1
        paths.clear()
        paths.update(coming)
    empty = [0.0] * classes
    for t in grown:
        t.value = [v if isinstance(v, list) else empty for v in t.value]
    return RandomCuts(columns, classes, grown)


# ---- ensembles ------------------------------------------------------------

#: Settings of the members by name.
MEMBERS = {
    "hgb": {"iterations": 250, "rate": 0.05, "leaves": 15, "min_leaf": 20, "l2": 1.0},
    "hgb_low": {"iterations": 500, "rate": 0.03, "leaves": 3, "min_leaf": 20, "l2": 1.0},
    "ET2": {"trees": 500, "min_leaf": 3, "seeds": (100, 101)},
    "LR": {"c": 0.3, "steps": 2000},
}


class TreeEnsemble:
    """Mean of the class probabilities of the members that a spec names: hgb_low, or hgb, ET2 and LR joined by `+`.

    overrides: settings by member name, in place of those above.
    """

    def __init__(self, spec: str = "hgb+ET2+LR", classes: int = 3, overrides: dict[str, dict] | None = None):
        self.parts, self.classes, self.members = spec.split("+"), classes, []
        if not set(self.parts) <= set(MEMBERS):
            raise ValueError(f"members are {', '.join(MEMBERS)}, not {spec}")
        self.settings = {p: MEMBERS[p] | (overrides or {}).get(p, {}) for p in self.parts}

    def fit(self, df: DataFrame, label: str, columns: list[str]) -> TreeEnsemble:
        self.members = []
        for part in self.parts:
            told = dict(self.settings[part])
            if part == "ET2":
                seeds = told.pop("seeds")
                self.members += [random_cuts(df, label, columns, self.classes, seed=s, **told) for s in seeds]
            elif part == "LR":
                self.members.append(_Linear(columns, self.classes, **told).fit(df, label))
            else:
                self.members.append(boost(df, label, columns, self.classes, **told))
        return self

    def transform(self, df: DataFrame, out: str = "p") -> DataFrame:
        rows = df
        for i, m in enumerate(self.members):
            rows = m.transform(rows, f"{out}_member{i}")
        parts = [F.col(f"{out}_member{i}") for i in range(len(self.members))]
        mean = F.array(*[sum((F.get(p, F.lit(k)) for p in parts), F.lit(0.0)) / len(parts) for k in range(self.classes)])
        return rows.withColumn(out, mean).select(*[c for c in df.columns if c != out], out)


class _Linear:
    """Multinomial regression on standardised columns; C weighs the sum of losses against half the squared coefficients, as a penalty of 1 / (C n) a row."""

    def __init__(self, columns: list[str], classes: int, c: float, steps: int):
        self.columns, self.classes, self.c, self.steps, self.model = safe_columns(columns), classes, c, steps, None

    def fit(self, df: DataFrame, label: str) -> _Linear:
        from pyspark.ml.classification import LogisticRegression

        from .model import assemble

        rows = assemble(df.where(F.col(label).isNotNull()), self.columns).select("features", F.col(label).cast("double").alias("label"))
        n = rows.count()
        if n:
            self.model = LogisticRegression(family="multinomial", regParam=1 / (self.c * n), standardization=True, maxIter=self.steps).fit(rows)
        return self

    def transform(self, df: DataFrame, out: str) -> DataFrame:
        from pyspark.ml.functions import vector_to_array

        from .model import assemble

        if self.model is None:
            return df.withColumn(out, F.array_repeat(F.lit(1.0 / self.classes), self.classes))
        rows = self.model.setProbabilityCol("_v").setRawPredictionCol("_r").setPredictionCol("_c").transform(assemble(df, self.columns))
        padded = F.slice(F.concat(vector_to_array("_v"), F.array_repeat(F.lit(0.0), self.classes)), 1, self.classes)
        return rows.withColumn(out, padded).select(*df.columns, out)
