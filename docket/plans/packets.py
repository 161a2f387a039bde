"""The whole plan: records to fields, features, decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import CLUSTER_RATIO, CONTENT_FIELDS, OUTPUT_ORDER, PLACEHOLDER, RESPACED_FIELDS
from ..functions.fuzzy import norm_fee
from ..functions.text import clean, fee_from_receipt, is_redacted, norm_date, norm_sponsor, norm_visa, repair_sponsor, squash
from ..operators import candidates, consensus, decide, features, flags, layout, respace, trust, vocab
from ..operators.adjudicator import Adjudicator
from ..tables import written

PAGE = ["case_id", "pg_pos"]
NORMALIZERS = {"arrival_date": norm_date, "fee_status": norm_fee, "visa_class": norm_visa, "sponsor_id": norm_sponsor}


def relations(records: DataFrame) -> dict[str, DataFrame]:
    """lines, rows, types, foreign and visible text of records, each from the visible layer only.

    Records are dealt by case and their lines written once: all that follows finds a case's lines together, in as many tasks as the session has.
    """
    visible, _ = trust.split(records)
    width = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lines = written(layout.doc_lines(visible.select("case_id", "pages").repartition(width, "case_id")))
    return {
        "lines": lines,
        "rows": layout.group_rows(lines, PAGE),
        "types": layout.page_types(lines, PAGE),
        "foreign": layout.foreign_pages(lines, PAGE),
        "pages": visible.select("case_id", F.posexplode("pages").alias("pg_pos", "p")).where("p is not null").select("case_id", "pg_pos"),
        "text": visible.select("case_id", layout.visible_text().alias("visible_text"), layout.visible_text("\n").alias("visible_lines")),
    }


def read(records: DataFrame) -> dict[str, DataFrame]:
    """The relations of records with `found`, the candidates, and `flagged`, each written once, for `extract` and `inputs` together."""
    r = relations(records)
    return r | {"found": written(candidates.collect(r["lines"], r["rows"], r["types"], r["foreign"])), "flagged": written(flags.detect(records.select("case_id"), r["lines"], flags.stated_names(r["lines"])))}


def normalised() -> Column:
    """value in the form of its field, null if it has none."""
    return F.coalesce(*[F.when(F.col("field") == f, n(F.col("value"))) for f, n in NORMALIZERS.items()], F.when(~F.col("field").isin(*NORMALIZERS), clean(F.col("value"))))


def readings(found: DataFrame) -> DataFrame:
    """Candidates with their weight, normalised where the field has a form; what is destroyed or has no form is no reading."""
    value = normalised()
    w = consensus.weight(F.col("rank"), F.col("ratio"), F.col("conf"))
    return found.where(~is_redacted(F.col("value"))).select("case_id", "field", "rank", "ptype", "seq", w.alias("w"), value.alias("value"), squash(value).alias("key")).where("value is not null")


def printed_fee(lines: DataFrame, types: DataFrame) -> DataFrame:
    """case_id, printed_fee, printed_on (line or receipt): the status on the first line that says fee and has one, else that of the first fee page whose receipt tells.

    `unknown` is the placeholder too, so a line that says it leaves the word to the receipt.
    """
    said = lines.where(squash(F.col("t")).contains("fee")).select("case_id", F.struct("pg_pos", "ln_pos").alias("o"), norm_fee(F.col("t")).alias("v")).where("v is not null")
    line = said.groupBy("case_id").agg(F.nullif(F.min_by("v", "o"), F.lit("unknown")).alias("line"))
    pages = page_text(lines, types, "fee").select("case_id", "pg_pos", fee_from_receipt(F.col("text")).alias("v")).where("v is not null")
    receipt = pages.groupBy("case_id").agg(F.min_by("v", "pg_pos").alias("receipt"))
    return line.join(receipt, "case_id", "full_outer").select("case_id", F.coalesce("line", "receipt").alias("printed_fee"), F.when(F.col("line").isNotNull(), "line").when(F.col("receipt").isNotNull(), "receipt").alias("printed_on"))


def page_text(lines: DataFrame, types: DataFrame, ptype: str) -> DataFrame:
    """case_id, pg_pos, text of the pages of a type: their lines in order, a space between."""
    own = lines.join(types.where(F.col("ptype") == ptype).select(*PAGE), PAGE, "left_semi")
    return own.groupBy(*PAGE).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ln_pos", "t"))), lambda x: x["t"]), " ").alias("text"))


def support(said: DataFrame, resolved: DataFrame, names: list[str]) -> DataFrame:
    """case_id and, of each field, the rank of its winner (rank_, 9 where none) and the number of its readings (nev_)."""
    n = said.groupBy("case_id", "field").agg(F.count("*").alias("nev"))
    each = n.join(resolved.select("case_id", "field", "rank"), ["case_id", "field"], "left")
    wide = each.groupBy("case_id").pivot("field", names).agg(F.first("rank").alias("rank"), F.first("nev").alias("nev"))
    return wide.select("case_id", *[F.coalesce(F.col(f"{f}_{k}").cast("double"), F.lit(d)).alias(f"{k}_{f}") for k, d in (("rank", 9.0), ("nev", 0.0)) for f in names])


def extract(records: DataFrame, fee_prior: str | None = "paid", meta: bool = False, held: dict[str, DataFrame] | None = None) -> DataFrame:
    """The fields of all records, whatever a step met; `extract_isolated` sets aside the cases that a step failed on.

    case_id, the nine fields, visible_text: readings resolved, gaps filled from the page text, snapped, respaced, flagged.

    fee_prior: stands in for every unknown fee, even one that a receipt tells, as
    the placeholder and the status are the same word; None lets `unknown` through.
    meta: also the columns of `support` and fee_source (anchored, line_scan, receipt_arithmetic, prior or null).
    held: what `read` gave for these records.
    """
    held = read(records) if held is None else held
    return _fields(records, held, held["found"], fee_prior, meta)


def extract_isolated(records: DataFrame, fee_prior: str | None = "paid", meta: bool = False) -> tuple[DataFrame, DataFrame]:
    """(fields as of `extract`, dead letters: case_id, reason): a case that a step fails on is a dead letter and stops no other.

    Candidates and results are written once to the shared folder, so that both come from one run.
    Without a case_id, or with one that several records have, nothing can be told apart by case: those are dead letters as well.
    """
    n = records.groupBy("case_id").agg(F.count("*").alias("n"))
    unfit = n.where("case_id is null or n > 1").select("case_id", F.when(F.col("case_id").isNull(), "no case_id").otherwise("repeated case_id").alias("reason"))
    fit = records.join(n.where("n = 1").select("case_id"), "case_id", "left_semi")
    r = read(fit)
    out = written(_fields(fit, r, r["found"], fee_prior, meta, errors=True))
    dead = unfit.union(out.where("error is not null").select("case_id", "error"))
    return out.where("error is null").drop("error"), dead


def _fields(records: DataFrame, r: dict[str, DataFrame], found: DataFrame, fee_prior: str | None, meta: bool, errors: bool = False) -> DataFrame:
    """The columns of `extract`, and with errors one `error`: the first step that failed on a case and why, null if none did."""
    said = readings(found)
    said = said.where(F.col("field").isin(*NORMALIZERS) | (F.length("key") >= 2))
    formed = consensus.resolve(said.where(F.col("field").isin(*NORMALIZERS)), ["case_id", "field"])
    free = consensus.resolve_free(said.where(~F.col("field").isin(*NORMALIZERS)), ["case_id", "field"], CLUSTER_RATIO)
    both = formed.select("case_id", "field", "rep", "rank").union(free.select("case_id", "field", "rep", "rank"))
    names = [f for f in CONTENT_FIELDS if f != "risk_flags"]
    wide = r["text"].join(both.groupBy("case_id").pivot("field", names).agg(F.first("rep")), "case_id", "left")
    text = F.col("visible_text")
    wide = wide.join(printed_fee(r["lines"], r["types"]), "case_id", "left")
    told = F.when(F.col("printed_fee") == "unknown", None).otherwise(F.col("printed_on")) if fee_prior is not None else F.col("printed_on")
    source = F.when(F.col("fee_status").isNotNull(), "anchored").when(told == "line", "line_scan").when(told == "receipt", "receipt_arithmetic")
    wide = wide.withColumn("fee_source", source if fee_prior is None else F.coalesce(source, F.lit("prior")))
    sponsor = F.upper(F.regexp_extract(text, r"(?i)\b[S5][PF]N[-\s]?\d{4}\b", 0))
    fallback = {"sponsor_id": F.when(sponsor != "", F.coalesce(repair_sponsor(sponsor), sponsor)), "arrival_date": norm_date(text), "visa_class": norm_visa(text), "fee_status": F.col("printed_fee")}
    wide = wide.withColumns({f: F.coalesce(F.col(f), fallback.get(f, F.lit(None).cast("string")), F.lit(PLACEHOLDER[f])) for f in names})
    if fee_prior is not None:
        wide = wide.withColumn("fee_status", F.when(F.col("fee_status") == "unknown", fee_prior).otherwise(F.col("fee_status")))
    wide = respace.repair_fields(vocab.snap_fields(wide), RESPACED_FIELDS, "visible_lines", error="_spacing" if errors else None)
    out = wide.join(r["flagged"].select("case_id", "risk_flags", F.col("error").alias("_flags")), "case_id", "left").withColumn("risk_flags", F.coalesce("risk_flags", F.lit("none")))
    if errors:
        labels = found.where("error is not null").groupBy("case_id").agg(F.min("error").alias("_labels"))
        clusters = free.where("error is not null").groupBy("case_id").agg(F.min("error").alias("_consensus"))
        out = out.join(labels, "case_id", "left").join(clusters, "case_id", "left")
        out = out.withColumn("error", F.coalesce(*[F.concat(F.lit(f"{step}: "), F.col(f"_{step}")) for step in ("labels", "consensus", "spacing", "flags")]))
    trust.check_lineage(out.columns)
    told_of = ["error"] if errors else []
    if not meta:
        return out.select("case_id", *CONTENT_FIELDS, "visible_text", *told_of)
    told = {f"{k}_{f}": F.coalesce(F.col(f"{k}_{f}"), F.lit(d)) for k, d in (("rank", 9.0), ("nev", 0.0)) for f in names}
    return out.join(support(said, both, names), "case_id", "left").withColumns(told).select("case_id", *CONTENT_FIELDS, "visible_text", "fee_source", *told, *told_of)


def inputs(records: DataFrame, fields: DataFrame, held: dict[str, DataFrame] | None = None) -> DataFrame:
    """Model inputs of each case, from visible text and resolved fields (of `extract` with meta) only; held: what `read` gave for these records."""
    if "fee_source" not in fields.columns:
        raise ValueError("inputs takes the fields of extract(records, meta=True)")
    r = read(records) if held is None else held
    found = r["found"]
    value = normalised()
    votes = found.select("case_id", "field", "ptype", "pg_pos", "seq", (F.col("ratio") * F.pow("conf", 3)).alias("w"), is_redacted(F.col("value")).alias("redacted"), value.alias("value"))
    seen = r["flagged"].select("case_id", "flags_confidence", *[c.alias(n) for n, c in features.slip(F.col("evidence")).items()])
    stated = candidates.inline(r["lines"], [*PAGE, "ln_pos"]).where((F.col("field") == "applicant_name") & ~is_redacted(F.col("value")))
    pages = r["pages"].join(r["types"].select(*PAGE, "ptype"), PAGE, "left").join(r["foreign"], PAGE, "left")
    pages = pages.select(*PAGE, F.coalesce("ptype", F.lit("other")).alias("ptype"), F.coalesce("foreign", F.lit(False)).alias("foreign"))
    texts = {k: page_text(r["lines"], r["types"], k).groupBy("case_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pg_pos", "text"))), lambda x: x["text"]), " ").alias(f"{k}_text")) for k in ("sponsor", "fee")}
    sure = fields.select("case_id", *[c.alias(n) for n, c in features.resolution().items()])
    fields = fields.join(texts["sponsor"], "case_id", "left").join(texts["fee"], "case_id", "left")
    out = features.design(r["lines"], r["types"], fields, pages, votes)
    for family in (seen, sure, features.packet_shape(r["lines"], pages), features.name_agreement(stated)):
        out = out.join(family, "case_id", "left")
    out = out.na.fill(0.0)
    return out.select("case_id", *trust.safe_columns([c for c in out.columns if c != "case_id"]))


def adjudicate(records: DataFrame, fields: DataFrame, scored: DataFrame, mode: str = "off", false_approval: float = -8.0, brier: float = 8.0) -> DataFrame:
    """Prediction rows in output order, from fields and scored (case_id, p)."""
    _, untrusted = trust.split(records)
    told = trust.signals(fields, untrusted, [f for f in CONTENT_FIELDS if f not in ("risk_flags",)]) if mode != "off" else fields.select("case_id", F.lit(0).alias("disagree"), F.lit(0).alias("refused"))
    rows = fields.join(scored.select("case_id", "p"), "case_id").join(told, "case_id").withColumn("d", decide.decide(F.col("p"), false_approval, brier))
    final = decide.caution(F.col("d.decision"), F.col("d.confidence"), F.col("p"), F.col("disagree"), F.col("refused"), mode)
    rows = rows.withColumn("f", final).withColumns({"adjudication": F.col("f.decision"), "confidence": F.bround("f.confidence", 4)})
    return rows.select(*OUTPUT_ORDER)


def predict(records: DataFrame, model: Adjudicator) -> DataFrame:
    """Prediction rows of records: fields, inputs, both cells, recalibration, decision and caution in one plan."""
    held = read(records)
    fields = extract(records, meta=True, held=held)
    return adjudicate(records, fields, model.predict_proba(inputs(records, fields, held)), model.caution, model.false_approval, model.brier)
