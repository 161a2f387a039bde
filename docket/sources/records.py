"""Sources: packet files, record lines, labels and frozen artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import VOCABULARY

LINE = "struct<t:string,s:string,x0:string,y0:string,x1:string,y1:string>"
PAGE = f"struct<page:int,k:int,w:string,h:string,hidden_text:string,lines:array<{LINE}>>"
#: Numbers of lines are read as text: a quoted number is a number, and one that cannot be read is 0 later.
RECORD = f"case_id string, scale int, pages array<{PAGE}>, _corrupt string"


def packet_files(spark: SparkSession, folder: str) -> DataFrame:
    """case_id, path, content of the PDF files of one folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "false").load(folder)
    return files.select(F.regexp_extract("path", r"([^/]+)\.pdf$", 1).alias("case_id"), "path", "content")


def read_records(spark: SparkSession, path: str, sequence: str | None = None, limit: int | None = None) -> DataFrame:
    """Records from JSON lines.  Torn and blank lines are left out; a record whose pages cannot be read has none.

    Of repeated case_ids the last wins: by the ingest column `sequence`, else by file name and place in the file
    (a block's rows are numbered as they are read).  limit: reading stops where so many cases have been seen.
    """
    raw = spark.read.schema(RECORD + (f", `{sequence}` string" if sequence else "")).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    place = F.struct(F.col(sequence).try_cast("double").alias("n"), F.col(sequence).alias("s")) if sequence else F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("n"))
    rows = raw.select("case_id", "scale", F.coalesce("pages", F.array().cast(f"array<{PAGE}>")).alias("pages"), place.alias("at")).where("case_id is not null")
    if limit:
        first = rows.groupBy("case_id").agg(F.min("at").alias("at")).orderBy("at").limit(limit)
        rows = rows.join(F.broadcast(first.agg(F.max("at").alias("stop"), F.count("*").alias("seen"))), (F.col("at") <= F.col("stop")) | (F.col("seen") < limit))  # one row
    best = rows.groupBy("case_id").agg(F.max_by(F.struct("scale", "pages"), "at").alias("r"))
    return best.select("case_id", "r.scale", "r.pages")


def torn_lines(spark: SparkSession, path: str) -> DataFrame:
    """line, reason of the lines that `read_records` leaves out as no record can be read from them, blank lines apart."""
    raw = spark.read.schema(RECORD).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    reason = F.when(F.col("_corrupt").isNotNull(), "unreadable record").otherwise("no case_id")
    without = F.size(F.array_compact(F.array("case_id"))) == 0  # `case_id is null` would go into the reader, which leaves torn lines out then
    return raw.where(without).select(F.coalesce("_corrupt", F.to_json(F.struct("scale", "pages"))).alias("line"), reason.alias("reason"))


def read_labels(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """CSV with a header, every column a string."""
    return spark.read.csv(path, header=True, schema=", ".join(f"`{c}` string" for c in columns))


def read_vocabulary(spark: SparkSession, path: str | None = None) -> DataFrame:
    """field, value, ord: the frozen vocabulary, or that of a JSON file of lists; an unreadable file gives an empty one."""
    if path is None:
        return spark.createDataFrame([(f, v, i) for f, vs in VOCABULARY.items() for i, v in enumerate(vs)], "field string, value string, ord int")
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,array<string>>").alias("m"))
    return rows.select(F.explode("m").alias("field", "vs")).select("field", F.posexplode("vs").alias("ord", "value")).select("field", "value", "ord")


def ocr(files: DataFrame, engine) -> DataFrame:
    """Records of packet files by an engine made once a Python worker.

    engine(): a callable from (case_id, bytes) to the JSON of a record.  A file it
    cannot read has a row with `error` and no pages, so one bad file stops nothing.
    """
    import pandas as pd

    def run(frames):
        read = engine()
        for f in frames:
            out = []
            for case_id, content in zip(f["case_id"], f["content"], strict=True):
                try:
                    out.append((case_id, read(case_id, content), None))
                except Exception as e:  # noqa: BLE001  the packet is set aside, with the reason
                    out.append((case_id, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["case_id", "record", "error"])

    rows = files.select("case_id", "content").mapInPandas(run, "case_id string, record string, error string")
    body = F.from_json("record", f"scale int, pages array<{PAGE}>")
    return rows.select("case_id", body["scale"].alias("scale"), F.coalesce(body["pages"], F.array().cast(f"array<{PAGE}>")).alias("pages"), "error")
