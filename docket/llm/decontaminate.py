"""Benchmark decontamination with a generalised suffix automaton over words.

The normalised benchmark items go into one suffix automaton, built on the driver
within a checked bound and broadcast (larger benchmarks go shard by shard,
one automaton after another, and the runs of all are merged before anything is judged or cut).  Each document streams its words through it, always
knowing the longest suffix that some item contains.  A window is `span`
consecutive words of an item, or the whole of a shorter item.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from ._common import cut, slices, table

SPAN = 10
#: Words of one automaton at most; a larger benchmark is split into several.
MAX_WORDS = 500_000
#: Characters of the items of one automaton at most.
MAX_CHARS = 8_000_000

#: A-Z become a-z, other ASCII outside 0-9 and a-z parts words, bytes from 0x80 belong to words.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


class Automaton:
    """Generalised suffix automaton of item word sequences.

    next, link, length: its states.  For each state, `windows` lists the items
    that have a span-word window equal to the last span words there, and `shorts`
    the (length, items) of whole short items that end there.
    """

    def __init__(self, items: list[tuple[object, list[bytes]]], span: int = SPAN):
        self.span, self.vocab = span, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[set] = [set()]  # items whose prefix ends in a state
        wholes: dict[int, tuple[int, list]] = {}
        self.least = span
        for item, words in sorted(items, key=lambda x: str(x[0])):
            if not words:
                continue
            state = 0
            for w in words:
                state = self._extend(state, self.vocab.setdefault(w, len(self.vocab)))
                while len(ends) < len(self.length):
                    ends.append(set())
                ends[state].add(item)
            if len(words) < span:
                self.least = min(self.least, len(words))
                wholes.setdefault(state, (len(words), []))[1].append(item)
        for s in sorted(range(1, len(self.length)), key=lambda s: -self.length[s]):
            if self.length[self.link[s]] >= span:  # items are only asked for states that hold the span-word suffix
                ends[self.link[s]] |= ends[s]
        up = [0] * len(self.length)  # the state whose strings include the suffix of span words
        self.shorts: list[tuple] = [()] * len(self.length)
        for s in sorted(range(1, len(self.length)), key=lambda s: self.length[s]):
            p = self.link[s]
            up[s] = up[p] if self.length[p] >= span else s
            # A short item ends its own state at full length, as it is a prefix (itself) of an item.
            self.shorts[s] = (*self.shorts[p], *([(wholes[s][0], tuple(wholes[s][1]))] if s in wholes else []))
        self.windows = [tuple(ends[up[s]]) if self.length[s] >= span else () for s in range(len(self.length))]

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, q, c)
        cur = len(length)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, q, c)
        return cur

    def _clone(self, p: int, q: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        new = len(length)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = new
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        return new

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Maximal runs [start, end) of hit words, and the items that have an occurring window."""
        get = self.vocab.get
        ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        known = np.concatenate(([0], (ids >= 0).view(np.int8), [0]))
        step = np.diff(known)
        starts, stops = np.nonzero(step == 1)[0], np.nonzero(step == -1)[0]
        enough = stops - starts >= self.least  # an unknown word resets the automaton, so shorter runs hold no window
        runs: list[tuple[int, int]] = []
        items: set = set()
        nxt, link, length, span = self.next, self.link, self.length, self.span
        for a, b in zip(starts[enough].tolist(), stops[enough].tolist(), strict=True):
            state = at = 0
            for i, c in enumerate(ids[a:b].tolist(), a):
                while state and c not in nxt[state]:
                    state = link[state]
                    at = length[state]
                if c in nxt[state]:
                    state = nxt[state][c]
                    at += 1
                else:
                    at = 0
                reach = 0
                if at >= span:
                    reach = span
                    items.update(self.windows[state])
                for n, who in self.shorts[state]:
                    if n <= at:
                        reach = max(reach, n)
                        items.update(who)
                if reach:
                    start = i + 1 - reach
                    while runs and runs[-1][1] >= start:
                        start = min(start, runs.pop()[0])
                    runs.append((start, i + 1))
        return runs, items


def shards_of(benchmark: DataFrame, text_col: str) -> int:
    size = benchmark.agg(F.coalesce(F.sum(F.length(text_col)), F.lit(0)).alias("n")).first()["n"]
    return max(1, -(-size // min(MAX_CHARS, 2 * MAX_WORDS)))  # a word and its separator have two characters at least


def automata(benchmark: DataFrame, id_col: str, text_col: str, span: int) -> Iterator[Automaton]:
    """One automaton, or as many as the bounds ask for, one in memory at a time."""
    shards = shards_of(benchmark, text_col)
    for k in range(shards):
        part = benchmark.where(F.pmod(F.xxhash64(id_col, text_col), F.lit(shards)) == k) if shards > 1 else benchmark
        yield Automaton([(r[0], words_of(r[1])) for r in part.select(id_col, text_col).collect()], span)


def find_spans(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """docs plus n_words long, hits array<struct<a int, b int>> (word runs [a, b)), items array<string>.

    Null and empty texts have no words; an item without words has no windows and
    an empty benchmark no hits.  Repeated items and rows each count.  Input
    columns of the three result names (in any case) are replaced, all others kept.
    """
    sc = docs.sparkSession.sparkContext
    out = docs.select(*[c for c in docs.columns if c.lower() not in ("n_words", "hits", "items")])
    run = StructType([StructField("a", IntegerType()), StructField("b", IntegerType())])
    schema = StructType([*out.schema.fields, StructField("n_words", LongType()), StructField("hits", ArrayType(run)), StructField("items", ArrayType(StringType()))])
    first = True
    for automaton in automata(benchmark, item_col, text_col, span):
        shared = sc.broadcast(automaton)
        at = out.columns.index(text_col)

        def scan(batches, shared=shared, at=at, first=first):
            auto = shared.value
            for batch in slices(batches):
                n, hits, items = [], [], []
                old = (None, None) if first else (batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist())
                for i, text in enumerate(batch.column(at)):
                    words = words_of(text.as_py())
                    runs, who = auto.scan(words)
                    names = {str(x) for x in who}
                    if not first:
                        runs = merge([(x["a"], x["b"]) for x in old[0][i]] + runs)
                        names |= set(old[1][i])
                    n.append(len(words))
                    hits.append([{"a": a, "b": b} for a, b in runs])
                    items.append(sorted(names))
                cols = list(batch.columns) if first else list(batch.columns)[:-3]
                names_ = list(batch.schema.names) if first else list(batch.schema.names)[:-3]
                yield pa.RecordBatch.from_arrays(
                    [*cols, pa.array(n, pa.int64()), pa.array(hits, pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))), pa.array(items, pa.list_(pa.string()))],
                    [*names_, "n_words", "hits", "items"],
                )

        out = out.mapInArrow(scan, schema)
        first = False
    return out


def merge(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and out[-1][1] >= a:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_SPLIT = None


def cut_words(text: str, runs: list[tuple[int, int]]) -> str:
    """text without the given word runs; what stands between words goes with the first of them."""
    import re

    global _SPLIT
    _SPLIT = _SPLIT or re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    spots = [m.span() for m in _SPLIT.finditer(text)]
    out, at = [], 0
    for a, b in runs:
        out.append(text[at : spots[a][0]])
        at = spots[b][0] if b < len(spots) else spots[b - 1][1]
    return "".join([*out, text[at:]])


def decontaminate(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, coverage: float = 0.5) -> DataFrame:
    """docs with hit spans cut out of their texts, without those of which more than `coverage` of the words are hit.

    Cutting can bring words together, so a text is scanned again until nothing
    is hit.  Clean rows pass unchanged, null texts too.
    """
    if shards_of(benchmark, "text") > 1:
        return _in_rounds(docs, benchmark, span, coverage)
    at = docs.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(next(automata(benchmark, "item_id", "text", span)))

    def clean(batches):
        auto = shared.value
        for batch in slices(batches):
            texts, keep = batch.column(at).to_pylist(), []
            for i, text in enumerate(texts):
                words = words_of(text)
                runs = auto.scan(words)[0]
                keep.append(sum(b - a for a, b in runs) <= coverage * len(words))
                while keep[-1] and runs:
                    texts[i] = text = cut_words(text, runs)
                    runs = auto.scan(words_of(text))[0]
            cols = list(batch.columns)
            cols[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(cols, batch.schema.names).filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)


def _in_rounds(docs: DataFrame, benchmark: DataFrame, span: int, coverage: float) -> DataFrame:
    """The same by several automata: each round takes the merged runs of all, and only texts that were cut go to the next."""
    names = ["text" if c == "text" else f"c{i}" for i, c in enumerate(docs.columns)]
    less = F.udf(lambda text, hits: cut_words(text, [(x["a"], x["b"]) for x in hits]), "string")
    todo, done = docs.toDF(*names), []
    while True:
        found = cut(find_spans(todo, benchmark, span))
        if not done:  # coverage is judged once, on the words as they came
            n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda s, x: s + x["b"] - x["a"])
            found = found.where(n_hit <= F.lit(coverage) * F.col("n_words"))
        done.append(found.where(F.size("hits") == 0).select(*names))
        hit = found.where(F.size("hits") > 0)
        if hit.isEmpty():
            break
        todo = hit.withColumn("text", less("text", "hits")).select(*names)
    out = done[0]
    for part in done[1:]:
        out = out.union(part)
    return out.toDF(*docs.columns)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_spans(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda s, x: s + x["b"] - x["a"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """documents without benchmark passages; n_chars follows the text.

    Hit words are cut out, a text of which more than half is hit goes.  Null and empty texts stay, as do rows of null and
    repeated doc_id and all other columns.  An empty benchmark changes nothing.
    """
    out = decontaminate(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else out


SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
iw AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[i : i + least(len(ws), 10) - 1], ' ') AS g
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM iw WHERE len(ws) > 0)),
lens AS (SELECT DISTINCT n FROM win),
dg AS (
  SELECT doc_id, n, i, array_to_string(ws[i : i + n - 1], ' ') AS g
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM dw, lens WHERE len(ws) >= n)),
occ AS (SELECT dg.doc_id, dg.i, dg.n, win.item_id FROM dg JOIN win USING (n, g)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM occ) GROUP BY doc_id)
SELECT doc_id, coalesce(len(ws), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""
