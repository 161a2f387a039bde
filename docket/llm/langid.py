"""Language ID: averaged hashed subword embeddings under a linear softmax.

Subwords are letter n-grams with word boundaries, hashed to buckets.  A text is
the mean of its subwords' embeddings.  Embeddings and softmax are fitted by
stochastic gradient descent in numpy on a bounded sample; a temperature and a
rejection threshold are then calibrated on sampled rows that took no part in it.
As everything behind the softmax is linear, a fitted model is one table of logits
per bucket, and scoring a text is a sum of table rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from ._common import slices, table, unused

#: Rows of the sample at most, for each language; the lowest hashes of doc_id are taken.
PER_LANG = 600
BUCKETS = 1 << 14
DIM = 16
NGRAMS = (2, 3)
EPOCHS = 6
RATE = 40.0
BATCH = 64
SEED = 7
#: Share of correctly labelled calibration rows that may fall below the threshold, and the threshold's own limit.
REJECT = 0.001
LIMIT = 0.5
#: Characters that are looked at together; a longer text is read in pieces of this size.
BLOCK = 1 << 18

_LETTER: np.ndarray | None = None


def _letters() -> np.ndarray:
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _LETTER


def _grams(block: list[str]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Where each piece starts, and for each n the bucket at every place with a mask of places that have a subword."""
    block = [f" {t.lower()}" for t in block]
    sizes = np.array([len(t) for t in block])
    cps = np.frombuffer(("".join(block) + " ").encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters()[cps]
    starts = np.cumsum(sizes) - sizes
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[starts] = True  # each piece begins with a boundary of its own
    starts = (np.cumsum(keep) - 1)[starts]
    cps, letter = np.where(letter, cps, 32)[keep].astype(np.uint32), letter[keep]
    out = []
    for n in NGRAMS:
        m = len(cps) - n + 1
        h = np.full(max(m, 0), 0x9E3779B1 * n & 0xFFFFFFFF, np.uint32)
        for j in range(n):
            h = (h ^ cps[j : j + m]) * np.uint32(0x01000193)
            h ^= h >> np.uint32(15)
        ok = letter[: max(m, 0)] | letter[n - 1 :] if n == 2 else np.logical_and.reduce([letter[j : j + m] for j in range(1, n - 1)])
        out.append(((h * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BUCKETS.bit_length() + 1), ok))
    return starts, out


def _blocks(texts: list[str | None]):
    """(numbers of texts, pieces) with about BLOCK characters each."""
    who: list[int] = []
    block: list[str] = []
    size = 0
    for i, t in enumerate(texts):
        for a in range(0, len(t or ""), BLOCK):
            piece = t[a : a + BLOCK]
            who.append(i)
            block.append(piece)
            size += len(piece)
            if size >= BLOCK:
                yield who, block
                who, block, size = [], [], 0
    if block:
        yield who, block


@dataclass
class Model:
    langs: list[str]
    logits: np.ndarray  # buckets x languages
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def sums(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Sum of logit rows and number of subwords, for each text."""
        total, count = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts))
        for who, block in _blocks(texts):
            starts, grams = _grams(block)
            for ids, ok in grams:
                rows = np.concatenate((self.logits[ids] * ok[:, None], np.zeros((len(starts), len(self.langs)), np.float32)))  # so that each start is in range
                np.add.at(total, who, np.add.reduceat(rows, starts, axis=0))
                np.add.at(count, who, np.add.reduceat(np.concatenate((ok, np.zeros(len(starts), bool))).astype(np.int64), starts))
        return total, count

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        """Language, calibrated probability, and whether it is rejected."""
        total, count = self.sums(texts)
        if not self.langs:
            return ["und"] * len(texts), [0.0] * len(texts), [True] * len(texts)
        p = _softmax((total / np.maximum(count, 1)[:, None] + self.bias) / self.temperature)
        best = p.argmax(1)
        score = np.clip(p[np.arange(len(texts)), best], 0.0, 1.0)
        known = count > 0
        return (
            [self.langs[b] if k else "und" for b, k in zip(best, known, strict=True)],
            np.where(known, score, 0.0).tolist(),
            (~known | (score < self.threshold)).tolist(),
        )


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def bags(texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Buckets and counts of each text's subwords."""
    found: list[dict] = [{} for _ in texts]
    parts: list[list] = [[] for _ in texts]
    for who, block in _blocks(texts):
        starts, grams = _grams(block)
        for ids, ok in grams:
            ends = np.append(starts[1:], len(ids))
            for i, a, b in zip(who, starts, ends, strict=True):
                parts[i].append(np.bincount(ids[a:b][ok[a:b]], minlength=BUCKETS) if b > a else 0)
    for i, p in enumerate(parts):
        n = sum(p) if p else 0
        ids = np.nonzero(n)[0] if np.ndim(n) else np.empty(0, np.int64)
        found[i] = (ids.astype(np.int32), (n[ids] if len(ids) else np.empty(0)).astype(np.int32))
    return found


def fit(labels: list[str], rows: list[tuple[np.ndarray, np.ndarray]], held: list[bool]) -> Model:
    """SGD on rows that are not held, then temperature and threshold on those that are."""
    langs = sorted(set(labels))
    k, rng = len(langs), np.random.default_rng(SEED)
    y = np.array([langs.index(x) for x in labels])
    emb = rng.normal(0, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out, bias = rng.normal(0, 1 / np.sqrt(DIM), (DIM, k)).astype(np.float32), np.zeros(k, np.float32)

    def dense(ids):
        x = np.zeros((len(ids), BUCKETS), np.float32)
        for i, r in enumerate(ids):
            b, c = rows[r]
            x[i, b] = c / max(1, c.sum())
        return x

    held_ = np.array(held, bool)
    train = np.nonzero(~held_)[0] if (~held_).any() else np.arange(len(y))
    steps, at = EPOCHS * -(-len(train) // BATCH), 0
    weight = 1.0 / np.bincount(y[train], minlength=k).clip(1)
    for _ in range(EPOCHS):
        for ids in np.array_split(rng.permutation(train), -(-len(train) // BATCH)):
            x, rate = dense(ids), RATE * (1 - at / steps)
            h = x @ emb
            g = _softmax(h @ out + bias)
            g[np.arange(len(ids)), y[ids]] -= 1
            w = weight[y[ids]]
            g = (g * (w / w.sum())[:, None]).astype(np.float32)
            gh = g @ out.T
            out -= 0.1 * rate * (h.T @ g)
            bias -= 0.01 * rate * g.sum(0)
            emb -= rate * (x.T @ gh)
            at += 1
    model = Model(langs, (emb @ out).astype(np.float32), bias)
    test = np.nonzero(held_)[0]
    if len(test) and k > 1:
        z = np.concatenate([dense(ids) @ model.logits + bias for ids in np.array_split(test, -(-len(test) // BATCH))]).astype(np.float64)
        loss = {t: -np.log(_softmax(z / t)[np.arange(len(test)), y[test]].clip(1e-12)).mean() for t in np.geomspace(0.02, 10, 109)}
        model.temperature = float(min(loss, key=loss.get))
        p = _softmax(z / model.temperature)
        right = p.argmax(1) == y[test]
        if right.any():
            model.threshold = float(min(LIMIT, np.quantile(p.max(1)[right], REJECT, method="lower")))
    return model


def held_out(doc_id="doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, per_lang: int = PER_LANG) -> Model:
    """A model from at most per_lang rows a language, of those that have text and lang and are not held out."""
    rows = docs.where(~held_out() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull())
    known = rows.groupBy("lang").count().collect()  # one row a language
    if not known:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0, np.float32))
    # 1.5 times the share wanted, cut to the bound below: each hash is as likely as any other.
    share = F.coalesce(*[F.when(F.col("lang") == r["lang"], F.lit(min(1.0, 1.5 * per_lang / r["count"] + 20 / r["count"]))) for r in known])
    draw = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(SEED)), 11) / F.lit(float(1 << 53))
    sample = rows.select("doc_id", "lang", "text", draw.alias("draw")).where(draw < share)

    def count(batches):
        for batch in batches:
            found = bags(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(3), pa.array([b.tobytes() for b, _ in found], pa.binary()), pa.array([c.tobytes() for _, c in found], pa.binary())],
                ["doc_id", "lang", "draw", "ids", "counts"],
            )

    got = sample.mapInArrow(count, "doc_id long, lang string, draw double, ids binary, counts binary").collect()
    got.sort(key=lambda r: (r["lang"], r["draw"], r["doc_id"], r["ids"]))
    labels, bag, held, seen = [], [], [], {}
    for r in got:
        n = seen[r["lang"]] = seen.get(r["lang"], 0) + 1
        if n <= per_lang and r["ids"]:
            labels.append(r["lang"])
            bag.append((np.frombuffer(r["ids"], np.int32), np.frombuffer(r["counts"], np.int32)))
            held.append(n % 4 == 0)
    return fit(labels, bag, held) if labels else Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0, np.float32))


def _predicted(docs: DataFrame, model: Model) -> DataFrame:
    """row struct (docs without text), text, lang_pred, score, rejected; whatever docs' columns are called, none can clash."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    others = [f"`{c}`" for c in docs.columns if c != "text"]
    packed = docs.select(F.struct(*others, F.lit(None).cast("int").alias("")).alias("row"), "text")
    schema = StructType([*packed.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("rejected", BooleanType())])

    def predict(batches):
        for batch in slices(batches):
            lang, score, out = shared.value.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(out, pa.bool_())], schema.names)

    return packed.mapInArrow(predict, schema)


def _columns(docs: DataFrame) -> list:
    """docs' own columns from _predicted, in their order."""
    return [F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns]


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """docs plus lang_pred string, score double, rejected boolean.

    Texts that are null or have no letter are `und` with score 0 and rejected, as
    is everything if no row could be learned from.  Equal texts get equal
    results, an empty table an empty result.  Columns of docs are kept as they are; where one is called like a
    result (in any case), the result gets underscores before its name.
    """
    out = _predicted(docs, train(docs) if model is None else model)
    results = ("lang_pred", "score", "rejected")
    return out.select(*_columns(docs), *[F.col(c).alias(n) for c, n in zip(results, unused(docs, *results), strict=True)])


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs)
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """documents whose language is recognised: those that `identify` does not reject.

    Rows of null and repeated doc_id are judged each for itself; texts that are null or have no letter go.  All columns stay as they
    are, also those called like a result.  An empty table gives an empty result.
    """
    return _predicted(docs, train(docs)).where("not rejected").select(*_columns(docs))
