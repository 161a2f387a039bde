"""Results kept by content: a case whose record and plan have not changed is not computed again.

Under the folder, parts/<id> holds the results of one run (Parquet), and manifest one line (JSON) a part.  A part counts once its line
is there, which the committer publishes by one rename after all of the part is written; what a broken run leaves behind is never read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import written

HASH = "_content"
MANIFEST = "part string, version string"


def plan_version() -> str:
    """Hash of the code that results come from: fixed values, functions, operators and plans."""
    root = Path(__file__).resolve().parent.parent
    files = [root / "constants.py", *sorted(p for d in ("functions", "operators", "plans") for p in (root / d).glob("*.py"))]
    return hashlib.sha256(b"".join(f.name.encode() + b"\0" + f.read_bytes() for f in files)).hexdigest()


def content(columns: list[str]) -> Column:
    """SHA-256 of a row's columns, by name and value; a null and an absent field of a struct are one."""
    return F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(columns)])), 256)


def published(spark: SparkSession, folder: str, version: str) -> list[str]:
    """Folders of the parts of this version, one a run."""
    try:
        rows = spark.read.schema(MANIFEST).json(f"{folder}/manifest").where(F.col("version") == version).select("part").distinct().collect()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    return sorted(f"{folder}/parts/{r['part']}" for r in rows)


def kept(records: DataFrame, folder: str, compute: Callable[[DataFrame], DataFrame], version: str | None = None, key: str = "case_id") -> DataFrame:
    """compute(records), from the store where it has been computed; compute gives one row a key, and sees only records that the store lacks.

    Equal records count once.  Records that compute leaves out (say as dead letters) are tried again by the next run; a null key has no result.
    version: of the plan; another one computes all anew.  The columns of a version's results must stay the same.
    """
    spark, version = records.sparkSession, plan_version() if version is None else version
    own = records.where(F.col(key).isNotNull()).withColumn(HASH, content(records.columns)).dropDuplicates([HASH])
    parts = published(spark, folder, version)
    lacking = own.join(spark.read.parquet(*parts).select(HASH), HASH, "left_anti") if parts else own
    lacking = written(lacking)  # looked at twice
    if not lacking.isEmpty():
        part = uuid.uuid4().hex
        found = compute(lacking.drop(HASH))
        found.join(lacking.select(key, HASH), key).write.parquet(f"{folder}/parts/{part}")
        spark.createDataFrame([(part, version)], MANIFEST).coalesce(1).write.mode("append").json(f"{folder}/manifest")
        parts = [*parts, f"{folder}/parts/{part}"]
    if not parts:
        return compute(lacking.drop(HASH))
    every = spark.read.parquet(*parts)
    # Two runs at once may both have computed a record: one result of each is taken.
    return every.join(own.select(HASH), HASH, "left_semi").dropDuplicates([HASH]).drop(HASH)
