"""Prefix trie of conversations by distributed MSD radix partitioning.

Turns are encoded by an order-preserving dictionary.  Equal conversations become one
sequence with a number of members.  The root bucket holds all sequences; a
pass deals each bucket out by the next turn id, as a radix sort from the most
significant digit does.  Buckets that are small enough (or a single sequence) are
finished inside tasks by a multikey quicksort; only the others are dealt again, and for
each of those the recursion emits one node.  Sums of subtrees flow from finished
buckets to the few nodes above them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import cut, shared_folder, small, table, width

#: Turns of a bucket that one task may finish; a single sequence is finished whatever its length (it is one row).
LOCAL = 50_000
#: Texts of conv_ids that are joined into one row on the way to a digest.
CHUNK = 20_000
NODE = "conv_id long, depth int, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved long, ends string, path array<long>"
OUT = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
NONE = hashlib.sha256(b"").hexdigest()


def encode(turns: DataFrame) -> DataFrame:
    """conv_id, turns array<struct<turn, id long, chars int>> in order, from conv_id, turn, role, text.

    Turns go by turn (null first), then by role and text.  Null roles and texts are empty, rows of null conv_id take no part.  ids grow with (role,
    text): the dictionary is range-sorted before it is numbered, so that ties need no texts.  Turns meet it by SHA-256.
    """
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    rows = turns.where("conv_id is not null").select("conv_id", "turn", blank("role"), blank("text"))
    name = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)).alias("name")
    sorted_ = rows.select("role", "text").distinct().orderBy("role", "text")
    numbered = cut(sorted_.select(name, F.monotonically_increasing_id().alias("id"), F.length("text").alias("chars")))
    coded = rows.select("conv_id", "turn", name).join(numbered, "name").select("conv_id", F.struct("turn", "id", "chars").alias("t"))
    return coded.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def rebuild(convs: DataFrame, first: Column, base: Column, most: int) -> DataFrame:
    """conv_id, ids array<long>, chars array<int>: the first `first` turns (`most` or fewer) of conversation `base`, then the own turns after as many."""
    heads = convs.select(F.col("conv_id").alias("base"), F.slice("turns", 1, most).alias("head"))
    both = convs.select("conv_id", "turns", base.alias("base"), first.cast("int").alias("h")).join(heads, "base", "left")
    empty = F.slice("turns", 1, 0)
    all_ = F.concat(F.slice(F.coalesce("head", empty), F.lit(1), F.col("h")), F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1))))
    return both.select("conv_id", all_.alias("ts")).select("conv_id", F.col("ts.id").alias("ids"), F.col("ts.chars").alias("chars"))


def digests(members: DataFrame) -> DataFrame:
    """sid, ends: SHA-256 of each group's conv_ids, ascending and comma-joined.

    members: sid, conv_id.  The rows are range-sorted by both columns, so that a group of any size spreads; each range joins its ids to rows of CHUNK, and what
    one task reads in order is one such row for so many ids.  It holds one at a time.
    """
    by_range = members.repartitionByRange(width(members.sparkSession), "sid", "conv_id").sortWithinPartitions("sid", "conv_id")

    def pack(batches):
        sid, ids = None, []

        def row():
            return pa.RecordBatch.from_arrays([pa.array([sid], pa.int64()), pa.array([ids[0]], pa.int64()), pa.array([",".join(map(str, ids))], pa.string())], ["sid", "conv_id", "joined"])

        for batch in batches:
            for s, c in zip(batch.column(0).to_numpy().tolist(), batch.column(1).to_numpy().tolist(), strict=True):
                if ids and (s != sid or len(ids) == CHUNK):
                    yield row()
                    ids = []
                sid = s
                ids.append(c)
        if ids:
            yield row()

    def digest(batches):
        sid, sha = None, None
        for batch in batches:
            done = []
            for s, joined in zip(batch.column(0).to_numpy().tolist(), batch.column(2), strict=True):
                if sha is not None and s == sid:
                    sha.update(b",")
                else:
                    if sha is not None:
                        done.append((sid, sha.hexdigest()))
                    sid, sha = s, hashlib.sha256()
                sha.update(joined.as_py().encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.string())], ["sid", "ends"])
        if sha is not None:
            yield pa.RecordBatch.from_arrays([pa.array([sid], pa.int64()), pa.array([sha.hexdigest()], pa.string())], ["sid", "ends"])

    packed = by_range.select("sid", "conv_id").mapInArrow(pack, "sid long, conv_id long, joined string")
    return packed.repartition(width(members.sparkSession), "sid").sortWithinPartitions("sid", "conv_id").mapInArrow(digest, "sid long, ends string")


def sequences(convs: DataFrame) -> DataFrame:
    """sid, n long, ids, chars, ends: one row a distinct sequence; sid is its smallest conv_id, n its members, ends the digest of their conv_ids."""
    named = cut(convs.withColumn("name", F.unhex(F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256))))
    groups = named.groupBy("name").agg(F.min("conv_id").alias("sid"), F.count("*").alias("n"))
    groups = cut(groups)
    several = groups.where("n > 1").select("name", "sid")
    members = named.select("name", "conv_id").join(several, "name").select("sid", "conv_id")
    one = groups.where("n = 1").select("sid", "n", F.sha2(F.col("sid").cast("string"), 256).alias("ends"))
    more = groups.where("n > 1").select("sid", "n").join(digests(members), "sid").select("sid", "n", "ends")
    return one.union(more).join(named.select(F.col("conv_id").alias("sid"), "ids", "chars"), "sid").select("sid", "n", "ids", "chars", "ends")


def multikey_quicksort(rows: list[np.ndarray], depth: int = 0) -> np.ndarray:
    """Order of sequences, a prefix before what it begins, by three-way partitioning on one place at a time; the first `depth` places are known equal."""
    lengths = np.fromiter((len(r) for r in rows), np.int64, len(rows))
    order, todo = np.arange(len(rows)), [(0, len(rows), depth)]
    while todo:
        lo, hi, d = todo.pop()
        part = order[lo:hi]
        digit = np.fromiter((rows[i][d] if lengths[i] > d else -1 for i in part), np.int64, hi - lo)
        pivot = int(np.median(digit[[0, len(digit) // 2, -1]]))
        pivot = pivot if (digit == pivot).any() else int(digit[0])
        less, same, more = part[digit < pivot], part[digit == pivot], part[digit > pivot]
        order[lo:hi] = np.concatenate((less, same, more))
        a, b = lo + len(less), lo + len(less) + len(same)
        todo += [(x, y, z) for x, y, z in ((lo, a, d), (a, b, d + 1), (b, hi, d)) if y - x > 1 and (z == d or pivot >= 0)]
    return order


def nodes_of(rows: list[tuple], depth: int) -> dict:
    """Columns of the nodes of one bucket: sequences (sid, n, ids, chars, ends) that share their first depth turns, depth > 0 being the bucket's own node."""
    ids = [r[2] for r in rows]
    order = multikey_quicksort(ids, depth)
    conv, at, up, n, kids, leaves, saved, last, ends = [], [], [], [], [], [], [], [], []
    open_: list[int] = []  # nodes of the current sequence, from the bucket's own on
    prior = None
    for i in order.tolist():
        sid, many, seq, chars, end = rows[i]
        shared = 0
        if prior is not None:
            m = min(len(prior), len(seq))
            differs = np.nonzero(prior[:m] != seq[:m])[0]
            shared = int(differs[0]) if len(differs) else m
        del open_[max(0, shared - depth + 1) :]
        for d in range(depth + len(open_), len(seq) + 1):
            if open_:
                kids[open_[-1]] += 1
            up.append(open_[-1] if open_ else -1)
            open_.append(len(conv))
            conv.append(sid), at.append(d), n.append(0), kids.append(0), leaves.append(0), saved.append(0), ends.append(None), last.append(int(chars[d - 1]))
        for k in open_:
            conv[k] = min(conv[k], sid)
            n[k] += many
        ends[open_[-1]] = end
        prior = seq
    for k in range(len(conv) - 1, -1, -1):  # a node comes after the one above it
        leaves[k] = leaves[k] or 1
        saved[k] += (n[k] - 1) * last[k]
        if up[k] >= 0:
            leaves[up[k]] += leaves[k]
            saved[up[k]] += saved[k]
    return {"conv_id": conv, "depth": at, "parent_conv_id": [conv[k] if k >= 0 else None for k in up], "n_convs": n, "n_children": kids, "n_leaves": leaves, "saved": saved, "ends": ends}


def finish(local: DataFrame) -> DataFrame:
    """NODE for buckets that are small enough; path is that of the nodes above, on a bucket's own node only.

    local: path array<long>, next long, sid, n, ids, chars, ends.  A bucket is the rows of one (path, next).
    """
    dealt = local.select(F.size("path").alias("depth"), F.element_at("path", -1).alias("parent"), "next", "sid", "n", "ids", "chars", "ends", "path")
    dealt = dealt.repartition(width(local.sparkSession), "depth", "parent", "next").sortWithinPartitions("depth", "parent", "next")
    kinds = [("conv_id", pa.int64()), ("depth", pa.int32()), ("parent_conv_id", pa.int64()), *[(c, pa.int64()) for c in ("n_convs", "n_children", "n_leaves", "saved")], ("ends", pa.string())]

    def build(bucket, path):
        out = nodes_of(bucket, len(path))
        out["parent_conv_id"][0] = path[-1]
        size = len(out["conv_id"])
        cols = [pa.array(out[c], kind) for c, kind in kinds] + [pa.array([path] + [None] * (size - 1), pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(cols, [c for c, _ in kinds] + ["path"])

    def run(batches):
        key, bucket, path = None, [], None
        for batch in batches:
            depth, parent, next_, sid, n = (batch.column(i).to_numpy().tolist() for i in range(5))
            ids, chars, ends, paths = (batch.column(i) for i in range(5, 9))
            for i in range(batch.num_rows):
                mine = (depth[i], parent[i], next_[i])
                if mine != key:
                    if bucket:
                        yield build(bucket, path)
                    key, bucket, path = mine, [], paths[i].as_py()
                bucket.append((sid[i], n[i], ids[i].values.to_numpy(), chars[i].values.to_numpy(), ends[i].as_py()))
        if bucket:
            yield build(bucket, path)

    return dealt.mapInArrow(run, NODE)


def build(seqs: DataFrame, local: int = LOCAL) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 (numbers long): every node of the trie of seqs (see sequences).

    No sequences, no nodes.  A pass is one aggregation and one join with the buckets still too large, of which there are
    at most turns / local; the number of passes is the depth of the deepest of them.
    """
    spark = seqs.sparkSession
    shared_folder(spark)
    seqs = cut(seqs)
    root = seqs.agg(F.min("sid")).first()[0]
    if root is None:
        return spark.createDataFrame([], OUT)
    state = seqs.withColumn("path", F.array(F.lit(root).cast("long")))
    done, tops, depth = [], [], 0
    while True:
        here = state.withColumn("bucket", F.element_at("path", -1)).withColumn("next", F.get("ids", F.lit(depth)))
        children = cut(
            here.where("next is not null").groupBy("bucket", "next").agg(F.min("sid").alias("low"), F.count("*").alias("seqs"), F.sum(F.size("ids") - F.lit(depth)).alias("turns"))
        )
        large = children.where((F.col("turns") > local) & (F.col("seqs") > 1)).select("bucket", "next", "low")
        n_large = large.count()
        last = F.max(F.get("chars", F.lit(depth - 1))) if depth else F.lit(0)
        stats = here.groupBy("bucket").agg(
            F.sum("n").alias("n_convs"), last.cast("long").alias("last"), F.max(F.when(F.size("ids") == depth, F.col("ends"))).alias("ends"), F.first("path").alias("path")
        )
        tops.append(stats.join(children.groupBy("bucket").agg(F.count("*").alias("n_children")), "bucket", "left").withColumn("depth", F.lit(depth)))
        columns = ["sid", "n", "ids", "chars", "ends", "path"]
        rest = here.where("next is not null")
        if not n_large:
            done.append(rest.select("next", *columns))
            break
        held = small(large, 24 * n_large)
        done.append(rest.join(held.drop("low"), ["bucket", "next"], "left_anti").select("next", *columns))
        state = cut(rest.join(held, ["bucket", "next"]).select(*columns[:-1], F.concat("path", F.array("low")).alias("path")))
        depth += 1
    local_rows = done[0]
    top = tops[0]
    for x in done[1:]:
        local_rows = local_rows.unionByName(x)
    for x in tops[1:]:
        top = top.unionByName(x)
    low, top = cut(finish(local_rows)), cut(top)
    own = top.select("path", F.lit(0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("last")).alias("saved"))
    own = own.union(top.where("n_children is null").select("path", F.lit(1).cast("long"), F.lit(0).cast("long")))
    up = low.where("path is not null").select("path", "n_leaves", "saved").union(own)
    sums = up.select(F.posexplode("path").alias("depth", "bucket"), "n_leaves", "saved").groupBy("depth", "bucket").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"))
    above = F.when(F.col("depth") > 0, F.get("path", F.col("depth") - 1))
    upper = top.select(F.col("bucket"), "depth", above.alias("parent_conv_id"), "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "ends").join(sums, ["depth", "bucket"])
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved", "ends"]
    out = low.select(*names).unionByName(upper.withColumnRenamed("bucket", "conv_id").select(*names))
    return out.select(
        *[F.col(c).cast("long").alias(c) for c in names[:6]], F.col("saved").cast("long").alias("saved_tokens"), F.coalesce("ends", F.lit(NONE)).alias("ends_sha256")
    )


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = cut(encode(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")))
    first = F.crc32(F.col("conv_id").cast("string")) % 6
    return build(sequences(rebuild(convs, first, F.col("conv_id") - F.col("conv_id") % 100, 5)))


SQL = r"""
WITH crc_table AS (
  SELECT list(list_reduce([i] || range(8), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY i) AS tab FROM range(256) r(i)),
t AS (
  SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS ts
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
k AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base, ts,
         xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT), lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295) % 6 AS h
  FROM t, crc_table),
r AS MATERIALIZED (SELECT k.conv_id, coalesce(b.ts[1 : h], []) || k.ts[h + 1 :] AS ts FROM k LEFT JOIN t b ON b.conv_id = k.base),
p AS (
  SELECT conv_id, d, len(ts) = d AS ends, CASE WHEN d > 0 THEN length(ts[d].text) ELSE 0 END AS chars, sha256(ts[1 : d]::JSON::VARCHAR) AS node, sha256(ts[1 : d - 1]::JSON::VARCHAR) AS up
  FROM (SELECT conv_id, ts, unnest(range(0, len(ts) + 1)) AS d FROM r)),
n AS MATERIALIZED (
  SELECT d AS depth, node, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM p GROUP BY d, node),
c AS MATERIALIZED (SELECT n.*, u.conv_id AS parent_conv_id, count(x.node) AS n_children
  FROM n LEFT JOIN n u ON u.depth = n.depth - 1 AND u.node = n.up LEFT JOIN n x ON x.depth = n.depth + 1 AND x.up = n.node GROUP BY ALL),
s AS (
  SELECT a.depth, a.node, count(*) FILTER (c.n_children = 0) AS n_leaves, sum((c.n_convs - 1) * c.chars) AS saved_tokens
  FROM c JOIN p ON p.conv_id = c.conv_id AND p.d <= c.depth JOIN c a ON a.depth = p.d AND a.node = p.node GROUP BY a.depth, a.node)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, ends_sha256 FROM c JOIN s USING (depth, node)
"""
