"""From probabilities to decisions: recalibration, expected value, caution."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import CAUTION_MODES, DECISIONS, PAYOFF


def payoff(false_approval: float | Column = -8.0) -> list[list]:
    """Points by action and truth; the penalty stands where a denial's case is approved."""
    return [[false_approval if x is None else x for x in row] for row in PAYOFF]


def softmax(z: Column) -> Column:
    e = F.transform(z, lambda x: F.exp(x - F.array_max(z)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))


def recalibrate(p: Column, mode: str = "none", a: float | list[float] = 0.0, b: list[float] | None = None) -> Column:
    """none; temperature: logits over e^a; vector: each class's logit times its e^a plus its b (one a stands for all)."""
    z = F.transform(p, lambda x: F.ln(F.greatest(x, F.lit(1e-9))))
    if mode == "temperature":
        return softmax(F.transform(z, lambda x: x / F.exp(F.lit(a))))
    if mode == "vector":
        shifts = b or [0.0] * (len(a) if isinstance(a, list) else 3)
        scales = a if isinstance(a, list) else [a] * len(shifts)
        each = lambda xs: F.array(*[F.lit(float(x)) for x in xs])
        return softmax(F.zip_with(F.zip_with(z, each(scales), lambda x, y: x * F.exp(y)), each(shifts), lambda x, y: x + y))
    if mode != "none":
        raise ValueError(f"recalibration is none, temperature or vector, not {mode}")
    return p


def blend(p: Column, q: Column, w: float = 0.5) -> Column:
    return F.zip_with(p, q, lambda x, y: (1 - w) * x + w * y)


def expected(p: Column, false_approval: float | Column = -8.0, brier: float | Column = 8.0) -> Column:
    """Expected points of each action, less brier x p(1-p) of the action itself."""
    rows = payoff(false_approval)
    return F.array(*[sum((p[t] * rows[a][t] for t in range(3)), F.lit(0.0)) - brier * p[a] * (1 - p[a]) for a in range(3)])


def decide(p: Column, false_approval: float | Column = -8.0, brier: float | Column = 8.0) -> Column:
    """struct<action int, decision, confidence>: most expected points, ties to the lower action; confidence within .01 and .99."""
    ev = expected(p, false_approval, brier)
    action = (F.array_position(ev, F.array_max(ev)) - 1).cast("int")
    names = F.array(*[F.lit(d) for d in DECISIONS])
    return F.struct(action.alias("action"), F.get(names, action).alias("decision"), F.greatest(F.lit(0.01), F.least(F.lit(0.99), F.get(p, action))).alias("confidence"))


def caution(decision: Column, confidence: Column, p: Column, disagree: Column, refused: Column, mode: str = "off") -> Column:
    """struct<decision, confidence>: signals of the untrusted channel may send a case to review, never anywhere else.

    dis and any look at approvals, the others at every decision; dis asks for a
    disagreement, any for a disagreement or a refused repair.
    """
    if mode not in CAUTION_MODES:
        raise ValueError(f"caution is one of {CAUTION_MODES}, not {mode}")
    fire = F.lit(False) if mode == "off" else disagree > 0 if mode.startswith("dis") else (disagree > 0) | (refused > 0)
    target = decision != "NEEDS_REVIEW" if mode.endswith("_all") else decision == "APPROVED"
    moved = F.coalesce(fire & target, F.lit(False))
    return F.struct(
        F.when(moved, "NEEDS_REVIEW").otherwise(decision).alias("decision"),
        F.when(moved, F.greatest(F.lit(0.01), F.least(F.lit(0.99), p[2]))).otherwise(confidence).alias("confidence"),
    )
