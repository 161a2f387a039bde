"""Toxicity: a weighted finite-state grammar of clauses.

A text is cut into clauses of word classes: insult (a lexicon of whole words and stems that is learned from labels, with weights),
threat, target, negation and reported speech (fixed words below).  Three transducers, for negation scope, reported
speech and quotes, and targets, are composed into one table; running a clause through it rewrites
every insult and threat as it stands there, and the clause's weight is what its path adds
up.  A clause whose matches are negated or reported counts apart.  A document is scored by its
matched clauses, never by words alone, through a logistic curve fitted on all sampled rows.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ._common import BROADCAST_BYTES, cut, slices, table, unused

#: Labelled rows a label that are drawn to learn from (expected number; all, if there are fewer), and the seed of the draw.
PER_LABEL, SEED = 20_000, 11
#: Lexicon: lengths of stems, least rows of context, least log ratio and G statistic, entries at most, largest weight.
STEMS, LEAST, RATIO, G, ENTRIES, HEAVIEST = (3, 12), 5, 1.5, 30.0, 2_000, 8.0
#: Words after a negation that it reaches.
SCOPE = 3
#: Weights of a threat, and of a target in a clause that has a match.
THREAT_WEIGHT, TARGET_WEIGHT = 1.5, 0.5

# Words of the classes, English, German, French, Spanish.
THREATS = "kill hurt destroy stab shoot strangle murder umbringen töten verprügeln erschießen tuer frapper étrangler égorger matar golpear apuñalar estrangular"
TARGETS = "you your yours yourself they them these those du dich dir dein deine euch ihr sie toi vous votre vos eux tú usted ustedes vosotros ellos ellas"
NEGATIONS = "not no never neither nor isn't aren't don't kein keine keinen nicht nie niemals ne pas jamais aucun ni nunca jamás ningún"
REPORTS = "said says wrote called claimed quoted alleged sagte sagt schrieb nannte behauptete dit écrit appelé déclaré dijo dice escribió llamó"

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE, SOFT_INSULT, SOFT_THREAT = range(9)
CLASSES = {w: c for words, c in ((THREATS, THREAT), (TARGETS, TARGET), (NEGATIONS, NEGATION), (REPORTS, REPORT)) for w in words.split()}
SOFTER = {INSULT: SOFT_INSULT, THREAT: SOFT_THREAT}
TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[.!?;\n\"“”«»]")
ENDS, QUOTES = set(".!?;\n"), set('"“”«»')


def compose(*machines) -> tuple[list[list[int]], list[list[int]]]:
    """One table (next state, written symbol) for transducers that feed each other; state 0 is where all begin.

    A machine is (start, step), step(state, symbol) giving (state, symbol).
    """
    start = tuple(m[0] for m in machines)
    number, todo, to, out = {start: 0}, [start], [], []
    for state in todo:
        row, said = [], []
        for symbol in range(SOFT_THREAT + 1):
            after = []
            for (_, step), s in zip(machines, state, strict=True):
                s, symbol = step(s, symbol)
                after.append(s)
            after = tuple(after)
            if after not in number:
                number[after] = len(todo)
                todo.append(after)
            row.append(number[after])
            said.append(symbol)
        to.append(row)
        out.append(said)
    return to, out


def negation(state, symbol):
    if symbol == NEGATION:
        return SCOPE, OTHER
    return max(0, state - 1), SOFTER.get(symbol, symbol) if state else symbol


def reported(state, symbol):
    """state: whether a verb of speech came, and whether a quotation is open after it; a quotation without one is not reported speech."""
    said, quoted = state
    if symbol == REPORT:
        return (True, quoted), OTHER
    if symbol == QUOTE:
        return (said, said and not quoted), OTHER
    return state, SOFTER.get(symbol, symbol) if said else symbol


def target(state, symbol):
    """Only the first target of a clause is written."""
    return (True, OTHER if state else TARGET) if symbol == TARGET else (state, symbol)


NEXT, WRITTEN = compose((0, negation), ((False, False), reported), (False, target))


class Lexicon(dict):
    """Word to (class, weight); entries ending in `$` are whole words, others stems.  What was looked up is kept, in bounds."""

    def __init__(self, entries: dict[str, float]):
        super().__init__()
        self.entries = entries
        self.lengths = sorted({len(e) for e in entries if not e.endswith("$")}, reverse=True)

    def __reduce__(self):
        return Lexicon, (self.entries,)

    def __missing__(self, word: str) -> tuple[int, float]:
        if len(self) > 1 << 18:
            self.clear()
        weight = self.entries.get(f"{word}$")
        for n in self.lengths if weight is None else ():
            if n <= len(word) and (weight := self.entries.get(word[:n])) is not None:
                break
        found = (INSULT, weight) if weight is not None else (CLASSES.get(word, OTHER), 0.0)
        self[word] = found
        return found


@dataclass
class Model:
    entries: dict[str, float] = field(default_factory=dict)
    #: Of 1, whether a clause matched, heaviest clause, log of their sum, log of the sum of soft clauses, log of the density.
    curve: list[float] = field(default_factory=lambda: [-3.0, 0.0, 0.5, 0.5, 0.1, 0.3])


def clause_weight(clause: list[tuple[int, float]]) -> tuple[float, float]:
    """(weight, weight of what is negated or reported) of a clause with a match, along the path of the composed table."""
    state, plain, soft, aimed = 0, 0.0, 0.0, False
    for symbol, weight in clause:
        written = WRITTEN[state][symbol]
        state = NEXT[state][symbol]
        if written == INSULT or written == THREAT:
            plain += weight if written == INSULT else THREAT_WEIGHT
        elif written == SOFT_INSULT or written == SOFT_THREAT:
            soft += weight if written == SOFT_INSULT else THREAT_WEIGHT
        elif written == TARGET:
            aimed = True
    bonus = TARGET_WEIGHT if aimed else 0.0
    return (plain + bonus if plain else 0.0), (soft + bonus if soft and not plain else soft)


def features(text: str | None, lexicon: Lexicon) -> tuple[float, float, float, float]:
    """Heaviest clause, log of the clauses' sum, log of the soft sum, log of the sum for 100 words."""
    tokens = TOKEN.findall((text or "").lower().replace("’", "'"))
    coded, heaviest, total, soft = [], 0.0, 0.0, 0.0
    a, matched = 0, False
    for i, token in enumerate(tokens):
        coded.append((QUOTE, 0.0) if token in QUOTES else (OTHER, 0.0) if token in ENDS else lexicon[token])
        matched = matched or coded[-1][0] in SOFTER
        if token in ENDS:
            if matched:
                w, s = clause_weight(coded[a : i + 1])
                heaviest, total, soft = max(heaviest, w), total + w, soft + s
            a, matched = i + 1, False
    if matched:
        w, s = clause_weight(coded[a:])
        heaviest, total, soft = max(heaviest, w), total + w, soft + s
    return heaviest, math.log1p(total), math.log1p(soft), math.log1p(100 * total / max(1, len(tokens)))


def inputs(x: np.ndarray) -> np.ndarray:
    """Rows of the logistic curve for rounded features."""
    return np.column_stack((np.ones(len(x)), x[:, 0] > 0, x))


#: Steps and caps to which features are rounded, so that all rows fit in some ten thousand cells; scoring rounds alike.
STEP, CAP = np.array([1.0, 0.25, 1.0, 0.5]), np.array([10.0, 6.0, 6.0, 6.0])


def rounded(x: np.ndarray) -> np.ndarray:
    return np.minimum(np.rint(x / STEP) * STEP, CAP)


def fit_curve(x: np.ndarray, clean: np.ndarray, toxic: np.ndarray) -> list[float]:
    """Logistic coefficients by Newton steps on cells with their numbers of rows, with a small ridge."""
    z, w = inputs(x), np.zeros(2 + x.shape[1])
    ridge = np.diag([1e-3, *[1e-2] * (len(w) - 1)])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (toxic - (clean + toxic) * p) - ridge @ w
        hess = (z * ((clean + toxic) * p * (1 - p))[:, None]).T @ z + ridge
        step = np.linalg.solve(hess, grad)
        w = w + step * min(1.0, 5.0 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def held_out(doc_id="doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def sample(labels: DataFrame, per_label: int = PER_LABEL) -> DataFrame:
    """id, toxic: about per_label labelled doc_ids of each label that are not held out; a doc_id with both labels is toxic."""
    rows = labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out()).groupBy(F.col("doc_id").alias("id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}  # two rows
    share = F.when(F.col("toxic") == 1, F.lit(per_label / max(1, sizes.get(1, 0)))).otherwise(F.lit(per_label / max(1, sizes.get(0, 0))))
    return rows.where(F.shiftrightunsigned(F.xxhash64("id", F.lit(SEED)), 11) / F.lit(float(1 << 53)) < share)


def learn_lexicon(rows: DataFrame) -> dict[str, float]:
    """Stems and whole words that toxic rows (text, toxic) have far more often, with their log ratios.

    A word counts once for each word it follows and each label: copies of a text give a word no more
    contexts, so what merely stands in a copied toxic text is not learned.  Of nested entries the one with the greatest G statistic stays, the longer in a tie.
    """
    words = F.filter(F.split(F.lower(F.translate("text", "’", "'")), r"[^\p{L}']+"), lambda w: w != "")
    pairs = F.filter(F.zip_with(words, F.concat(F.array(F.lit("")), words), lambda w, v: F.struct(w.alias("word"), F.xxhash64(v).alias("after"))), lambda p: p["word"].isNotNull())
    seen = rows.select("toxic", F.explode(pairs).alias("p")).select("p.word", "p.after", "toxic").distinct()
    known = cut(seen.groupBy("word").agg(F.sum("toxic").alias("b"), F.sum(1 - F.col("toxic")).alias("a")))
    all_ = known.agg(F.coalesce(F.sum("a"), F.lit(0)).alias("a"), F.coalesce(F.sum("b"), F.lit(0)).alias("b")).first()
    if not all_["a"] or not all_["b"]:
        return {}
    stems = F.transform(F.sequence(F.lit(STEMS[0]), F.least(F.length("word"), F.lit(STEMS[1]))), lambda n: F.substring("word", F.lit(1), n))
    entries = F.concat(F.when(F.length("word") >= STEMS[0], stems).otherwise(F.array().cast("array<string>")), F.array(F.concat("word", F.lit("$"))))
    counted = known.select(F.explode(entries).alias("entry"), "a", "b").groupBy("entry").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).where(F.col("b") >= LEAST)
    a, b, na, nb = F.col("a"), F.col("b"), float(all_["a"]), float(all_["b"])
    ratio = F.log((b + 0.5) / (nb + 1)) - F.log((a + 0.5) / (na + 1))
    share = lambda x, n: F.when(x > 0, x * F.log(x * (na + nb) / (n * (a + b)))).otherwise(0.0)
    found = counted.select("entry", ratio.alias("ratio"), (2 * (share(a, na) + share(b, nb))).alias("g")).where((F.col("ratio") >= RATIO) & (F.col("g") >= G))
    best = found.orderBy(F.round("g", 6).desc(), F.length("entry").desc(), "entry").limit(ENTRIES).collect()
    kept: dict[str, float] = {}
    shorter: set[str] = set()  # all beginnings of what is kept
    for r in best:
        e = r["entry"]
        if e in shorter or any(e[:n] in kept for n in range(1, len(e))):
            continue
        kept[e] = min(HEAVIEST, r["ratio"])
        shorter |= {e[:n] for n in range(1, len(e))}
    return kept


def measure(docs: DataFrame, entries: dict[str, float], text: str = "text") -> DataFrame:
    """docs with `text` replaced by the array<double> of its rounded features."""
    shared = docs.sparkSession.sparkContext.broadcast(entries)
    at = docs.columns.index(text)
    others = [f for f in docs.schema.fields if f.name != text]

    def run(batches):
        lexicon = Lexicon(shared.value)
        for batch in slices(batches):
            x = [features(t.as_py(), lexicon) for t in batch.column(at)]
            x = rounded(np.array(x).reshape(-1, 4))
            cols = [c for i, c in enumerate(batch.columns) if i != at]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(x.tolist(), pa.list_(pa.float64()))], [*[f.name for f in others], "x"])

    schema = docs.select(*[f.name for f in others]).schema.add("x", ArrayType(DoubleType()))
    return docs.mapInArrow(run, schema)


def train(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> Model:
    """A model from the sampled labels and their texts; nothing is learned where a label is missing."""
    drawn = cut(sample(labels, per_label))
    drawn = F.broadcast(drawn) if 16 * 4 * per_label <= BROADCAST_BYTES else drawn
    rows = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(drawn, F.col("doc_id") == F.col("id")).select("toxic", "text")
    model = Model(learn_lexicon(rows))
    cells = measure(rows, model.entries).groupBy("x").agg(F.sum(1 - F.col("toxic")).alias("clean"), F.sum("toxic").alias("toxic")).collect()  # bounded by STEP and CAP
    clean, toxic = np.array([float(r["clean"]) for r in cells]), np.array([float(r["toxic"]) for r in cells])
    if clean.sum() and toxic.sum():
        total = {r["toxic"]: r["count"] for r in labels.where(~held_out()).where("toxic in (0, 1)").groupBy("toxic").count().collect()}
        # A label that was sampled thinner than the other counts for the rows that it stands for.
        clean, toxic = clean * (total[0] / clean.sum()), toxic * (total[1] / toxic.sum())
        model.curve = fit_curve(np.array([r["x"] for r in cells]), clean, toxic)
    return model


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs without text plus score double in 0 to 1; a text that is null, empty or matches nothing gets the curve's foot.

    Other columns are kept whatever their names; where one is called like the result, that gets underscores before its name.
    """
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text]).alias("row"), F.col(text).alias("text"))
    x = [F.lit(1.0), F.when(F.get("x", F.lit(0)) > 0, 1.0).otherwise(0.0), *[F.get("x", F.lit(i)) for i in range(4)]]
    z = sum((F.lit(c) * v for c, v in zip(model.curve[1:], x[1:], strict=True)), F.lit(model.curve[0]))
    name = unused(docs.drop(text), "score")
    return measure(packed, model.entries).select("row.*", (1.0 / (1.0 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))).alias(name))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
