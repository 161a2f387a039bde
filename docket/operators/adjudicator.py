"""The whole decision model: two cells blended, recalibrated, decided by expected value, demoted by caution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decide, score
from .model import Ensemble, fit_recalibration, folds, held_out, read_settings, recalibrate_held_out, write_settings

#: Families of evidence; cell A does without them.
EVIDENCE = ("xs_", "dm_", "st_", "spl_", "fa_", "bio_")


def cells(columns: list[str]) -> tuple[list[str], list[str]]:
    """Inputs of cell A (no evidence families) and of cell B (all)."""
    return [c for c in columns if not c.startswith(EVIDENCE)], list(columns)


class Adjudicator:
    """Cell A is a mixed ensemble on the plain inputs, cell B shallow boosted trees on all of them.

    cell: A, B or blend (weight is B's).  Recalibration is fitted on blended out-of-fold
    probabilities.  Neither cell takes a column of the untrusted layer, at fitting or at prediction;
    that layer acts through caution alone, where the rows have `disagree` and `refused`.
    """

    def __init__(self, cell: str = "blend", recal: str = "temperature", false_approval: float = -12.0, brier: float = 4.0, weight: float = 0.5, caution: str = "any", **options):
        if cell not in ("A", "B", "blend"):
            raise ValueError(f"cell is A, B or blend, not {cell}")
        self.cell, self.recal, self.false_approval, self.brier, self.weight, self.caution, self.options = cell, recal, false_approval, brier, weight, caution, options
        self.a: Ensemble | None = None
        self.b: Ensemble | None = None
        self.fitted: dict = {"mode": "none"}

    def _fit_cells(self, df: DataFrame, label: str, columns: list[str]) -> tuple[Ensemble | None, Ensemble | None]:
        plain, every = cells(columns)
        a = Ensemble(kind="mixed", **self.options).fit(df, label, plain) if self.cell != "B" else None
        b = Ensemble(kind="boosted", **self.options).fit(df, label, every) if self.cell != "A" else None
        return a, b

    def _blend(self, df: DataFrame, a: Ensemble | None, b: Ensemble | None) -> DataFrame:
        if a is None or b is None:
            return (a or b).transform(df, "p")
        rows = b.transform(a.transform(df, "_pa"), "_pb")
        return rows.withColumn("p", decide.blend(F.col("_pa"), F.col("_pb"), self.weight)).drop("_pa", "_pb")

    def out_of_fold(self, df: DataFrame, label: str, key: str, columns: list[str], n: int = 5, seed: int = 0) -> DataFrame:
        """df with `fold` and the blended `p` of cells that have not seen the row; n fits of both cells."""
        return held_out(folds(df, label, key, n, seed), n, lambda rest, own: self._blend(own, *self._fit_cells(rest, label, columns)))

    def fit(self, df: DataFrame, label: str, columns: list[str], oof: DataFrame | None = None) -> Adjudicator:
        """Both cells on all rows; recalibration on oof (`p` and label), if given.  Best a written table."""
        self.a, self.b = self._fit_cells(df, label, columns)
        self.fitted = fit_recalibration(oof, label, self.recal) if oof is not None else {"mode": "none"}
        return self

    def select(self, oof: DataFrame, label: str, n: int, penalties: list[float], briers: list[float]) -> Adjudicator:
        """Take penalty and Brier weight by `score.select_config` over oof (`fold`, `p`), recalibrated fold by fold."""
        held = recalibrate_held_out(oof, label, self.recal, n)
        best = score.select_config(score.param_sweep(held, penalties, briers, "q", label)).first()
        if best["false_approval"] is not None:
            self.false_approval, self.brier = best["false_approval"], best["brier_weight"]
        return self

    def predict_proba(self, df: DataFrame) -> DataFrame:
        """df with the recalibrated `p`."""
        return self._blend(df, self.a, self.b).withColumn("p", decide.recalibrate(F.col("p"), **self.fitted))

    def predict(self, df: DataFrame) -> DataFrame:
        """df with `p`, `decision` and `confidence`."""
        rows = self.predict_proba(df).withColumn("_d", decide.decide(F.col("p"), self.false_approval, self.brier))
        told = {"disagree", "refused"} <= set(df.columns)
        final = decide.caution(F.col("_d.decision"), F.col("_d.confidence"), F.col("p"), F.col("disagree"), F.col("refused"), self.caution) if told else F.struct("_d.decision", "_d.confidence")
        return rows.withColumn("_f", final).select(*df.columns, "p", "_f.decision", "_f.confidence")

    def save(self, spark: SparkSession, path: str) -> None:
        """Cells and settings below path, a folder that driver and executors share."""
        for name, cell in (("a", self.a), ("b", self.b)):
            if cell is not None:
                cell.save(spark, f"{path}/{name}")
        told = {k: getattr(self, k) for k in ("cell", "recal", "false_approval", "brier", "weight", "caution")}
        write_settings(spark, f"{path}/settings", {"made": told | self.options, "fitted": self.fitted})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Adjudicator:
        told = read_settings(spark, f"{path}/settings")
        out = cls(**told["made"])
        out.fitted = told["fitted"]
        out.a = Ensemble.load(spark, f"{path}/a") if out.cell != "B" else None
        out.b = Ensemble.load(spark, f"{path}/b") if out.cell != "A" else None
        return out
