"""Row steps: ingest, field checks, cross checks, enrichment.

Each step rewrites columns and appends to two array columns, `corrections` and `anomalies`, in the
same expression that changes a value, so that the audit cannot disagree with the data.  Rows are
never filtered.  `corrections_of` and `anomalies_of` explode the arrays at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.config import LEVELS, RuleSet
from shelfwise.functions import gtin, rates, text, url

CORRECTION = "array<struct<field_name:string,old_value:string,new_value:string,author:string,rule:string,confidence:double>>"
ANOMALY = "array<struct<field_name:string,code:string,severity:string,detail:string,value:string,label:string>>"
TEXT_COLUMNS = ("nom", *LEVELS)
TRIMMED = ("ean", "url_image", "tva", "id_produit")
#: Codes whose severity is ERROR; they alone drive the quarantine.
ERRORS = ("label_empty", "ean_invalid", "url_malformed", "vat_missing", "vat_illegal_rate")


def correction(when: Column, field: str, old: Column, new: Column, rule: str | Column, author: str = "RULE", confidence: Column | float = 1.0) -> Column:
    sure = F.lit(confidence) if isinstance(confidence, float) else confidence
    entry = F.struct(F.lit(field).alias("field_name"), old.alias("old_value"), new.alias("new_value"), F.lit(author).alias("author"), (F.lit(rule) if isinstance(rule, str) else rule).alias("rule"), sure.alias("confidence"))
    return F.when(F.coalesce(when, F.lit(False)), F.array(entry)).otherwise(F.expr(f"cast(array() as {CORRECTION})"))


def anomaly(when: Column, field: str, code: str | Column, severity: str | Column, value: Column | None = None, label: Column | None = None, detail: Column | None = None) -> Column:
    blank = F.lit("")
    entry = F.struct(
        F.lit(field).alias("field_name"), (F.lit(code) if isinstance(code, str) else code).alias("code"), (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"),
        (detail if detail is not None else blank).alias("detail"), F.substring(value, 1, 512).alias("value") if value is not None else blank.alias("value"), F.substring(label, 1, 512).alias("label") if label is not None else blank.alias("label"),
    )
    return F.when(F.coalesce(when, F.lit(False)), F.array(entry)).otherwise(F.expr(f"cast(array() as {ANOMALY})"))


def _started(df: DataFrame) -> DataFrame:
    added = {}
    if "corrections" not in df.columns:
        added["corrections"] = F.expr(f"cast(array() as {CORRECTION})")
    if "anomalies" not in df.columns:
        added["anomalies"] = F.expr(f"cast(array() as {ANOMALY})")
    return df.withColumns(added) if added else df


def ingest(df: DataFrame, rules: RuleSet, repair: bool = True) -> DataFrame:
    """Repairs text, trims, detaches glued suffixes; adds origin and marketing_mention."""
    df = _started(df)
    fixed = {c: (text.repair_mojibake(F.col(c)) if repair else text.collapse(F.col(c))) for c in TEXT_COLUMNS}
    df = df.withColumns({f"_{c}": e for c, e in fixed.items()})
    old = {c: F.coalesce(F.col(c), F.lit("")) for c in TEXT_COLUMNS}
    made = [correction(old[c] != F.col(f"_{c}"), c, old[c], F.col(f"_{c}"), "ingest.fix_text") for c in TEXT_COLUMNS]
    seen = [anomaly(text.collapse(old[c]) != F.col(f"_{c}"), c, "mojibake_fixed", "INFO", old[c], F.col(f"_{c}")) for c in TEXT_COLUMNS]
    df = df.withColumns({"corrections": F.concat("corrections", *made), "anomalies": F.concat("anomalies", *seen)})
    df = df.withColumns({c: F.col(f"_{c}") for c in TEXT_COLUMNS} | {c: text.strip_all(F.coalesce(F.col(c), F.lit(""))) for c in TRIMMED}).drop(*[f"_{c}" for c in TEXT_COLUMNS])
    df = df.withColumn("_cut", text.detach_suffix(F.col("nom"), rules.suffixes))
    cut = F.col("_cut.label") != F.col("nom")
    df = df.withColumns(
        {
            "corrections": F.concat("corrections", correction(cut, "nom", F.col("nom"), F.col("_cut.label"), "ingest.detach_suffix")),
            "anomalies": F.concat("anomalies", anomaly(cut, "nom", "marketing_suffix_detached", "INFO", F.col("nom"), F.col("_cut.label")), anomaly(F.trim("_cut.label") == "", "nom", "label_empty", "ERROR")),
        }
    )
    return df.withColumns({"nom": F.col("_cut.label"), "origin": F.col("_cut.origin"), "marketing_mention": F.col("_cut.marketing_mention")}).drop("_cut")


def field_checks(df: DataFrame, rules: RuleSet, statuses: DataFrame | None = None) -> DataFrame:
    """Judges each field by itself: code, address, rate, path.

    `statuses` has (url, ok, reason), a row for each address that was checked; without it no
    address counts as checked.
    """
    df = _started(df).withColumns({"_ean": gtin.verdict(F.col("ean")), "_url": url.repair(F.col("url_image"))})
    routed, found = gtin.routed(F.col("_ean")), gtin.anomaly(F.col("_ean"))
    repaired = F.col("_ean.status").isin("padded", "unpadded")
    df = df.withColumns(
        {
            "corrections": F.concat(
                "corrections",
                correction(repaired, "ean", F.col("ean"), F.col("_ean.value"), F.concat(F.lit("field_checks.ean."), F.col("_ean.status"))),
                correction(F.col("_url.rule").isNotNull(), "url_image", F.col("url_image"), F.col("_url.url"), F.concat(F.lit("field_checks.url."), F.col("_url.rule"))),
            ),
            "anomalies": F.concat(
                "anomalies",
                anomaly(found.isNotNull(), "ean", found["code"], found["severity"], F.col("ean"), F.col("nom")),
                anomaly(F.col("_url.rule").isNotNull(), "url_image", "url_scheme_repaired", "INFO", F.col("url_image"), F.col("nom")),
            ),
            "_routed": routed,
            "ean_status": F.col("_ean.status"),
        }
    ).withColumns({"ean": F.col("_routed.ean"), "internal_code": F.col("_routed.internal_code"), "ean_valid": F.col("_routed.ean_valid"), "url_image": F.col("_url.url")})
    if statuses is None:
        df = df.withColumns({"_ok": F.lit(None).cast("boolean"), "_reason": F.lit(None).cast("string")})
    else:
        # of several statuses of one address a good one counts, then the last reason in order
        best = statuses.groupBy("url").agg(F.max(F.struct("ok", "reason")).alias("b"))
        known = best.select(F.col("url").alias("_known"), F.col("b.ok").alias("_ok"), F.col("b.reason").alias("_reason"))
        df = df.join(known, F.col("url_image") == F.col("_known"), "left").drop("_known")
    df = df.withColumn("_seen", url.judged(F.col("url_image"), F.col("_ok"), F.col("_reason")))
    df = df.withColumns({"url_ok": F.col("_seen.url_ok"), "url_checked": F.col("_seen.url_checked"), "vat_rate": rates.parse_rate(F.col("tva"))})
    wrong_rate = rates.rate_anomaly(F.col("vat_rate"), rules)
    df = df.withColumns({f"_l{k}": rates.canonical_level(F.col(c), k, rules) for k, c in enumerate(LEVELS)})
    spelled = [correction(F.col(c) != F.col(f"_l{k}"), c, F.col(c), F.col(f"_l{k}"), "field_checks.taxonomy.canonicalize") for k, c in enumerate(LEVELS)]
    shape = rates.path_shape([F.col(f"_l{k}") for k in range(4)], rules)
    path = text.render_path([F.col(f"_l{k}") for k in range(4)])
    df = df.withColumns(
        {
            "corrections": F.concat("corrections", *spelled),
            "anomalies": F.concat(
                "anomalies",
                anomaly(F.col("_seen.code").isNotNull(), "url_image", F.col("_seen.code"), F.col("_seen.severity"), F.col("url_image"), F.col("nom"), F.coalesce("_reason", F.lit(""))),
                anomaly(wrong_rate.isNotNull(), "tva", wrong_rate, "ERROR", F.coalesce(F.col("vat_rate").cast("string"), F.col("tva")), F.col("nom")),
                anomaly(shape != "complete", "taxonomie", shape, "WARNING", path, F.col("nom")),
            ),
            "taxonomy_complete": shape.isin("complete", "taxonomy_unknown_path"),
        }
    )
    return df.withColumns({c: F.col(f"_l{k}") for k, c in enumerate(LEVELS)}).drop("_ean", "_url", "_routed", "_ok", "_reason", "_seen", *[f"_l{k}" for k in range(4)])


def cross_checks(df: DataFrame, rules: RuleSet) -> DataFrame:
    """Checks fields against each other.  The rate itself is never changed."""
    df = _started(df)
    levels = [F.coalesce(F.col(c), F.lit("")) for c in LEVELS]
    df = df.withColumns({f"_f{k}": c for k, c in enumerate(rates.fill_gaps(levels, rules))} | {"_tokens": text.tokenize(F.col("nom"))})
    changed = [F.col(f"_f{k}") != levels[k] for k in range(3)]
    reference = text.render_path([F.col(f"_f{k}") for k in range(4)])
    made = [correction(changed[k], LEVELS[k], F.lit(""), F.col(f"_f{k}"), "cross_checks.taxonomy.deduce_from_leaf") for k in range(3)]
    df = df.withColumns({"corrections": F.concat("corrections", *made), "anomalies": F.concat("anomalies", anomaly(changed[0] | changed[1] | changed[2], "taxonomie", "taxonomy_gap_filled", "INFO", reference, None, reference))})
    df = df.withColumns({c: F.col(f"_f{k}") for k, c in enumerate(LEVELS)})
    leaf, rate = F.col(LEVELS[3]), F.col("vat_rate")
    df = df.withColumns({"vat_expected": rates.expected_rate(F.col("_tokens"), leaf, rate, rules), "_mismatch": rates.name_mismatch(F.col("_tokens"), leaf, rules)})
    df = df.withColumns({"vat_coherent": rates.coherent(rate, F.col("vat_expected"), leaf, rules), "taxonomy_complete": (F.col(LEVELS[0]) != "") & (F.col(LEVELS[1]) != "") & (F.col(LEVELS[2]) != "") & (leaf != "")})
    wrong = anomaly(F.col("_mismatch"), "taxonomie", "taxonomy_name_mismatch", "WARNING", leaf, F.col("nom"), F.concat_ws(" / ", leaf, rates.expected_leaf(F.col("_tokens"), rules)))
    off = anomaly(~F.col("vat_coherent"), "tva", "vat_category_mismatch", "WARNING", F.coalesce(rate.cast("string"), F.lit("")), F.col("nom"), F.col("vat_expected").cast("string"))
    return df.withColumn("anomalies", F.concat("anomalies", wrong, off)).drop("_tokens", "_mismatch", *[f"_f{k}" for k in range(4)])


def enrich(df: DataFrame, rules: RuleSet, answers: DataFrame | None = None, model: str = "none") -> DataFrame:
    """Applies answers (source, label, brand, confidence) by exact label, else by collapsed upper case.

    Adds nom_enrichi, brand and llm_confidence; nom stays.  An answer below the confidence
    threshold is not applied, nor is an empty one; brand and confidence are recorded all the same.
    Of several answers to one label the surest counts, then the first in order.
    """
    df = _started(df)
    if answers is None:
        return df.withColumns({"nom_enrichi": F.col("nom"), "brand": F.lit(""), "llm_confidence": F.lit(0.0)})
    said = answers.select("source", F.struct((-F.col("confidence")).alias("doubt"), F.trim(F.coalesce("label", F.lit(""))).alias("label"), F.trim(F.coalesce("brand", F.lit(""))).alias("brand"), "confidence").alias("said"))
    exact = said.groupBy(F.col("source").alias("_source")).agg(F.min("said").alias("_exact"))
    loose = exact.groupBy(text.squash(F.col("_source")).alias("_squashed")).agg(F.min_by("_exact", "_source").alias("_loose"))
    joined = df.join(exact, F.col("nom") == F.col("_source"), "left").join(loose, text.squash(F.col("nom")) == F.col("_squashed"), "left").withColumn("_answer", F.coalesce("_exact", "_loose"))
    change = F.coalesce((F.col("_answer.confidence") >= rules.thresholds.min_label_confidence) & (F.col("_answer.label") != "") & (F.col("_answer.label") != F.col("nom")), F.lit(False))
    return joined.withColumns(
        {
            "nom_enrichi": F.when(change, F.col("_answer.label")).otherwise(F.col("nom")),
            "brand": F.coalesce("_answer.brand", F.lit("")),
            "llm_confidence": F.coalesce(F.col("_answer.confidence"), F.lit(0.0)),
            "corrections": F.concat("corrections", correction(change, "nom", F.col("nom"), F.col("_answer.label"), f"llm_enrich.label[{model}]", "LLM", F.col("_answer.confidence"))),
        }
    ).drop("_source", "_exact", "_squashed", "_loose", "_answer")


def corrections_of(df: DataFrame, run_id: str) -> DataFrame:
    return df.select(F.lit(run_id).alias("run_id"), F.col("id_produit").alias("row_id"), F.explode("corrections").alias("c")).select("run_id", "row_id", "c.*")


def anomalies_of(df: DataFrame, run_id: str) -> DataFrame:
    return df.select(F.lit(run_id).alias("run_id"), F.col("id_produit").alias("row_id"), "row_seq", F.explode("anomalies").alias("a")).select("run_id", "row_id", "row_seq", "a.*")
