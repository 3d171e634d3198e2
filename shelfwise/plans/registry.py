"""The engine's queries over the projected star schema, and the SQL that gives the same rows.

"""

from __future__ import annotations

import dataclasses
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.config import LEVELS, RuleSet
from shelfwise.functions import gtin, rates, similarity, text, url
from shelfwise.operators import catalogue, enrichment, golden, reads, resolution, routing, steps
from shelfwise.operators.components import components
from shelfwise.plans import oracle, pipeline, projection
from shelfwise.plans.oracle import BLOCKS, CLEANED, FIXES, GOLDEN, JUDGED, LISTED, ROUTED
from shelfwise.plans.projection import listing, tables
from shelfwise.session import ensure_checkpoint_dir, settled
from shelfwise.sources import listing as sources
from shelfwise.sources import sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
RULES = RuleSet.load()
PRICE = enrichment.Price(5.0, 25.0)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(make: Query) -> Query:
        QUERIES[make.__name__] = make
        if sql is not None:
            ORACLE_SQL[make.__name__] = sql
        return make

    return register


def _checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(pipeline.checked_rows(listing(spark, sf_dir), RULES, projection.statuses(spark, sf_dir), repair=False))


def _golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    return golden.golden_records(_checked(spark, sf_dir), RULES)


def _level(k: int) -> Column:
    return F.col(LEVELS[k])


# --- text: C2, C3, C4, C5, C8, C9, C11, C12, C13, C14 ---


@query(f"WITH {LISTED} SELECT nom, {oracle.norm('nom')} AS canonical, count(*) AS n FROM listing GROUP BY nom")
def normalize_label_parts(spark, sf_dir):
    return listing(spark, sf_dir).groupBy("nom").agg(F.count(F.lit(1)).alias("n")).select("nom", text.normalize_label(F.col("nom")).alias("canonical"), "n")


@query(f"WITH {LISTED}, t AS (SELECT DISTINCT nom, list_distinct(list_filter(string_split({oracle.norm('nom')}, ' '), lambda x: x <> '')) AS t FROM listing) SELECT nom, array_to_string(list_sort(t), ' ') AS tokens, len(t)::INT AS n_tokens FROM t")
def tokenize_labels(spark, sf_dir):
    t = text.tokenize(F.col("nom"))
    return listing(spark, sf_dir).select("nom").distinct().select("nom", F.array_join(F.array_sort(t), " ").alias("tokens"), F.size(t).alias("n_tokens"))


@query(f"WITH {JUDGED} SELECT expected_leaf, family_rate, list_contains(tokens, 'CAFE') AS has_coffee, count(*) AS n FROM rows_ GROUP BY ALL")
def keyword_token_match(spark, sf_dir):
    cut = text.detach_suffix(F.col("nom"), RULES.suffixes)["label"]
    rows = listing(spark, sf_dir).select(text.tokenize(cut).alias("t"), cut.alias("nom"))
    family = F.coalesce(*[F.when(F.arrays_overlap("t", F.array(*[F.lit(x) for x in f.tokens])), f.expected) for f in RULES.families.values()])
    return rows.groupBy(rates.expected_leaf(F.col("t"), RULES).alias("expected_leaf"), family.alias("family_rate"), text.has_any_token(F.col("nom"), ["café"]).alias("has_coffee")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {GOLDEN} SELECT label, quantity_value, quantity_unit FROM golden")
def extract_quantity(spark, sf_dir):
    cut = text.detach_suffix(text.collapse(F.col("nom")), RULES.suffixes)["label"]
    rows = listing(spark, sf_dir).select(cut.alias("nom"), "row_seq").withColumn("key", text.normalize_label(F.col("nom")))
    q = text.extract_quantity(F.col("label"))
    return rows.groupBy("key").agg(F.max_by("nom", F.struct(F.length("nom"), -F.col("row_seq"))).alias("label")).select("label", q["value"].alias("quantity_value"), q["unit"].alias("quantity_unit"))


@query(f"WITH {LISTED} SELECT DISTINCT nom, upper(trim(regexp_replace(nom, '\\s+', ' ', 'g'))) AS squashed, sha256(nom || chr(0) || 'm1') AS cache_key FROM listing")
def collapse_whitespace(spark, sf_dir):
    return listing(spark, sf_dir).select("nom").distinct().select("nom", text.squash(F.col("nom")).alias("squashed"), text.cache_key(F.col("nom"), "m1").alias("cache_key"))


@query(f"WITH {CLEANED} SELECT DISTINCT raw_nom, nom, origin, marketing_mention FROM cleaned")
def detach_suffix(spark, sf_dir):
    cut = text.detach_suffix(text.collapse(F.col("nom")), RULES.suffixes)
    return listing(spark, sf_dir).select("nom").distinct().select(F.col("nom").alias("raw_nom"), cut["label"].alias("nom"), cut["origin"].alias("origin"), cut["marketing_mention"].alias("marketing_mention"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN amount = 0 THEN '0,00 $' WHEN amount < 0.01 THEN replace(printf('%.4f $', amount), '.', ',') ELSE replace(printf('%.2f $', amount), '.', ',') END AS said FROM (SELECT l_orderkey, l_linenumber, l_quantity * l_discount / 64 AS amount FROM lineitem)")
def format_usd(spark, sf_dir):
    return tables(spark, sf_dir, "lineitem")["lineitem"].select("l_orderkey", "l_linenumber", text.format_usd(F.col("l_quantity") * F.col("l_discount") / 64).alias("said"))


# --- codes: D1 to D6, I16 ---


@query(f"WITH {LISTED}, c AS (SELECT DISTINCT trim(ean) AS ean FROM listing) SELECT ean, regexp_full_match(ean, '[0-9]+') AND length(ean) IN (8, 12, 13, 14) AND {oracle.weighted('ean')} % 10 = 0 AS valid, length(ean) IN (8, 13, 14) AND ean[1] = '2' AS internal, CASE WHEN regexp_full_match(ean, '[0-9]+') THEN ((10 - ({oracle.weighted('ean || 0::VARCHAR')}) % 10) % 10)::VARCHAR END AS next_digit FROM c")
def gtin_checksum(spark, sf_dir):
    codes = listing(spark, sf_dir).select(F.trim("ean").alias("ean")).distinct()
    return codes.select("ean", gtin.checksum_valid(F.col("ean")).alias("valid"), gtin.is_internal(F.col("ean")).alias("internal"), F.when(gtin.is_digits(F.col("ean")), gtin.check_digit(F.col("ean"))).alias("next_digit"))


@query(f"WITH {JUDGED} SELECT DISTINCT ean, ean_status AS status, ean_value AS value, ean_out, internal_code, ean_valid FROM rows_")
def gtin_verdict(spark, sf_dir):
    codes = listing(spark, sf_dir).select("ean").distinct().withColumn("v", gtin.verdict(F.col("ean"))).withColumn("r", gtin.routed(F.col("v")))
    return codes.select("ean", "v.status", "v.value", F.col("r.ean").alias("ean_out"), "r.internal_code", "r.ean_valid")


@query(f"WITH {JUDGED} SELECT ean_status AS status, CASE ean_status WHEN 'ok' THEN NULL WHEN 'missing' THEN 'WARNING' WHEN 'not_a_gtin' THEN 'WARNING' WHEN 'gtin14' THEN 'WARNING' WHEN 'invalid' THEN 'ERROR' ELSE 'INFO' END AS severity, count(*) AS n FROM rows_ GROUP BY ean_status")
def gtin_status_counts(spark, sf_dir):
    counted = listing(spark, sf_dir).groupBy("ean").agg(F.count(F.lit(1)).alias("n")).withColumn("v", gtin.verdict(F.col("ean")))
    return counted.groupBy("v.status").agg(F.first(gtin.anomaly(F.col("v"))["severity"]).alias("severity"), F.sum("n").alias("n"))


# --- addresses: E1 to E4, E8, E9, H3, H6 ---


@query(f"WITH {JUDGED} SELECT DISTINCT url_image, url, CASE WHEN url = url_image THEN NULL WHEN starts_with(url_image, 'www.') THEN 'scheme_missing' ELSE 'scheme_typo' END AS rule FROM rows_")
def url_repair(spark, sf_dir):
    return listing(spark, sf_dir).select("url_image").distinct().withColumn("r", url.repair(F.col("url_image"))).select("url_image", "r.url", "r.rule")


@query("SELECT lower(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)) AS domain, count(*) AS n, count(DISTINCT url) AS urls, count(*) FILTER (WHERE regexp_matches(lower(url), '^https?:')) AS supported FROM pages GROUP BY 1")
def url_domain_rollup(spark, sf_dir):
    pages = tables(spark, sf_dir, "pages")["pages"].groupBy("url").agg(F.count(F.lit(1)).alias("n"))
    return pages.groupBy(url.domain_of(F.col("url")).alias("domain")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("urls"), F.sum(F.when(url.is_supported(F.col("url")), F.col("n")).otherwise(0)).alias("supported"))


@query(f"WITH {JUDGED} SELECT url_code AS code, url_ok, url_checked, count(*) AS n FROM rows_ GROUP BY ALL")
def url_status_left_join(spark, sf_dir):
    rows = steps.field_checks(listing(spark, sf_dir), RULES, projection.statuses(spark, sf_dir))
    code = F.filter("anomalies", lambda a: a["field_name"] == "url_image")
    first = F.filter(code, lambda a: a["code"] != "url_scheme_repaired")
    return rows.groupBy(F.when(F.size(first) > 0, F.get(first, F.lit(0))["code"]).alias("code"), "url_ok", "url_checked").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {JUDGED} SELECT url, lower(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)) AS domain FROM (SELECT DISTINCT url FROM rows_ WHERE regexp_matches(lower(url), '^https?:')) u WHERE NOT EXISTS (SELECT 1 FROM statuses s WHERE s.url = u.url)")
def url_to_check_anti_join(spark, sf_dir):
    fixed = listing(spark, sf_dir).select(url.repair(F.col("url_image"))["url"].alias("url_image"))
    return sources.to_check(fixed, projection.statuses(spark, sf_dir))


# --- rates and paths: F1 to F9, H1, H2 ---


@query(f"WITH {JUDGED} SELECT tva, vat_rate, CASE WHEN vat_rate IS NULL THEN 'vat_missing' WHEN vat_rate NOT IN ({oracle.LEGAL}) THEN 'vat_illegal_rate' END AS code, count(*) AS n FROM rows_ GROUP BY ALL")
def vat_parse_and_legality(spark, sf_dir):
    rate = rates.parse_rate(F.col("tva"))
    return listing(spark, sf_dir).groupBy(F.trim("tva").alias("tva")).agg(F.count(F.lit(1)).alias("n")).select("tva", rate.alias("vat_rate"), rates.rate_anomaly(rate, RULES).alias("code"), "n")


@query(f"WITH {JUDGED} SELECT id_produit, t4 AS leaf, vat_rate, vat_expected FROM rows_")
def vat_expected_by_category(spark, sf_dir):
    return _checked(spark, sf_dir).select("id_produit", _level(3).alias("leaf"), "vat_rate", "vat_expected")


@query(f"WITH {JUDGED} SELECT t4 AS leaf, vat_rate, vat_coherent, count(*) AS n FROM rows_ GROUP BY ALL")
def vat_coherence(spark, sf_dir):
    return _checked(spark, sf_dir).groupBy(_level(3).alias("leaf"), "vat_rate", "vat_coherent").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {JUDGED} SELECT c1, c2, c3, c4, count(*) AS n FROM rows_ GROUP BY ALL")
def taxonomy_canonicalize(spark, sf_dir):
    spelled = [rates.canonical_level(_level(k), k, RULES).alias(f"c{k + 1}") for k in range(4)]
    return listing(spark, sf_dir).groupBy(*spelled).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {JUDGED} SELECT shape, CASE WHEN c1 = '' THEN '?' ELSE c1 END || ' > ' || CASE WHEN c2 = '' THEN '?' ELSE c2 END || ' > ' || CASE WHEN c3 = '' THEN '?' ELSE c3 END || ' > ' || CASE WHEN c4 = '' THEN '?' ELSE c4 END AS path, count(*) AS n FROM rows_ GROUP BY ALL")
def taxonomy_shape(spark, sf_dir):
    rows = listing(spark, sf_dir).select(*[rates.canonical_level(_level(k), k, RULES).alias(LEVELS[k]) for k in range(4)])
    levels = [_level(k) for k in range(4)]
    return rows.groupBy(rates.path_shape(levels, RULES).alias("shape"), text.render_path(levels).alias("path")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {JUDGED} SELECT id_produit, t1, t2, t3, t4, complete FROM rows_")
def taxonomy_gap_fill(spark, sf_dir):
    return _checked(spark, sf_dir).select("id_produit", *[_level(k).alias(f"t{k + 1}") for k in range(4)], F.col("taxonomy_complete").alias("complete"))


@query(f"WITH {JUDGED} SELECT expected_leaf, t4 AS leaf, mismatch, count(*) AS n FROM rows_ GROUP BY ALL")
def taxonomy_name_mismatch(spark, sf_dir):
    rows = _checked(spark, sf_dir).select(text.tokenize(F.col("nom")).alias("t"), _level(3).alias("leaf"))
    return rows.groupBy(rates.expected_leaf(F.col("t"), RULES).alias("expected_leaf"), "leaf", rates.name_mismatch(F.col("t"), F.col("leaf"), RULES).alias("mismatch")).agg(F.count(F.lit(1)).alias("n"))


# --- rates of a run: G1, I11 to I15, N2, L2 ---


@query(f"WITH {JUDGED} SELECT count(*) AS n_rows, count(*) FILTER (WHERE ean_valid AND url_ok AND complete AND url_checked AND vat_coherent AND coalesce(vat_rate IN ({oracle.LEGAL}), false)) AS publishable, count(DISTINCT nom) AS labels FROM rows_")
def row_publishable_rate(spark, sf_dir):
    rows = _checked(spark, sf_dir)
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(routing.row_publishable(rows, RULES)).alias("publishable"), F.count_distinct("nom").alias("labels"))


@query(f"WITH {FIXES}, bad AS (SELECT count(DISTINCT row_id) AS n FROM found WHERE code IN ({', '.join(map(oracle.quoted, steps.ERRORS))})), t AS (SELECT count(*) AS n FROM rows_) SELECT bad.n AS bad_rows, round(bad.n / t.n, 4) AS error_rate, bad.n / t.n > 0.6 AS quarantined FROM bad, t")
def error_rate_quarantine(spark, sf_dir):
    rows = _checked(spark, sf_dir)
    bad = F.exists("anomalies", lambda a: a["code"].isin(*steps.ERRORS))
    out = rows.agg(F.count_distinct(F.when(bad, F.col("id_produit"))).alias("bad_rows"), F.count(F.lit(1)).alias("n"))
    return out.select("bad_rows", F.round(F.col("bad_rows") / F.col("n"), 4).alias("error_rate"), (F.col("bad_rows") / F.col("n") > RULES.thresholds.quarantine_anomaly_rate).alias("quarantined"))


@query(f"WITH {FIXES} SELECT code, count(*) AS n, count(DISTINCT row_id) AS n_rows FROM found GROUP BY code")
def anomalies_by_code(spark, sf_dir):
    return steps.anomalies_of(_checked(spark, sf_dir), "run").groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("row_id").alias("n_rows"))


@query(f"WITH {FIXES} SELECT rule, field_name, count(*) AS n FROM fixes GROUP BY ALL")
def corrections_by_author(spark, sf_dir):
    return steps.corrections_of(_checked(spark, sf_dir), "run").groupBy("rule", "field_name").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {FIXES} SELECT 'RULE' AS author, count(*) AS corrections, (SELECT count(*) FROM (SELECT DISTINCT field_name, old_value, new_value FROM fixes)) AS decisions FROM fixes")
def distinct_decisions(spark, sf_dir):
    fixes = steps.corrections_of(_checked(spark, sf_dir), "run").groupBy("author", "field_name", "old_value", "new_value").agg(F.count(F.lit(1)).alias("n"))
    return fixes.groupBy("author").agg(F.sum("n").alias("corrections"), F.count(F.lit(1)).alias("decisions"))


@query("SELECT l_suppkey AS run, count(*) FILTER (WHERE l_returnflag = 'N') AS rule, count(*) FILTER (WHERE l_returnflag = 'R') AS llm, count(*) FILTER (WHERE l_returnflag NOT IN ('N', 'R')) AS human, count(*) FILTER (WHERE l_linestatus = 'O') AS publishable, sum(l_quantity) AS source_rows FROM lineitem GROUP BY 1")
def run_summary_pivot(spark, sf_dir):  # I17
    li = tables(spark, sf_dir, "lineitem")["lineitem"].withColumn("run_id", F.col("l_suppkey"))
    fixes = li.select("run_id", F.when(F.col("l_returnflag") == "N", "RULE").when(F.col("l_returnflag") == "R", "LLM").otherwise("HUMAN").alias("author"))
    made = li.select("run_id", (F.col("l_linestatus") == "O").alias("publishable"), F.col("l_quantity").alias("source_rows"))
    return reads.run_summary(fixes, made).withColumnRenamed("run_id", "run")


# --- records: I1 to I9, G2 ---


@query(f"WITH {GOLDEN} SELECT key, label, ean, internal_code, url_image, url_ok, url_checked, path, vat_rate, vat_conflict, taxonomy_conflict, quantity_value, quantity_unit, origin, publishable, source_rows, first_seq, label_enriched FROM golden")
def golden_records(spark, sf_dir):
    return _golden(spark, sf_dir).withColumn("path", F.array_join("taxonomy", " > ")).select(
        "key", "label", "ean", "internal_code", "url_image", "url_ok", "url_checked", "path", "vat_rate", "vat_conflict", "taxonomy_conflict", "quantity_value", "quantity_unit", "origin", "publishable", "source_rows", "first_seq", "label_enriched"
    )


@query(f"WITH {JUDGED} SELECT key, vat_rate::VARCHAR AS rate, count(*) AS n FROM rows_ WHERE vat_rate IS NOT NULL GROUP BY ALL")
def vat_distribution_map(spark, sf_dir):
    return _golden(spark, sf_dir).select("key", F.explode("vat_distribution").alias("rate", "n"))


@query(f"WITH {LISTED}, c AS (SELECT partkey, nom, count(*) AS n, min(row_seq) AS f FROM listing GROUP BY ALL) SELECT partkey, arg_max(nom, (n, -f)) AS nom, count(*) AS values_ FROM c GROUP BY partkey")
def mode_first_seen(spark, sf_dir):
    return golden.most_common(listing(spark, sf_dir), "partkey", {"nom": F.col("nom")}).select("partkey", "nom", F.col("n_nom").alias("values_"))


@query(f"WITH {LISTED} SELECT partkey, arg_max(nom, (length(nom), -row_seq)) AS label, max(length(nom)) AS n FROM listing GROUP BY partkey")
def longest_label(spark, sf_dir):
    return listing(spark, sf_dir).groupBy("partkey").agg(F.max_by("nom", F.struct(F.length("nom"), -F.col("row_seq"))).alias("label"), F.max(F.length("nom")).cast("long").alias("n"))


@query(f"WITH {JUDGED} SELECT key, id_produit AS row_id, left(nom, 512) AS source_label, row_seq FROM rows_")
def lineage_explode(spark, sf_dir):  # B5, H14, I8
    return golden.lineage(_checked(spark, sf_dir)).drop("member_seq")


# --- linking: M1 to M8, H7, H8, I10, I22 ---


@query(f"WITH {BLOCKS} SELECT block, count(*) AS n, count(*) * (count(*) - 1) // 2 AS pairs FROM blocks GROUP BY block")
def block_sizes(spark, sf_dir):
    key = similarity.blocking_key(F.element_at("taxonomy", 4), F.col("quantity_value"), F.col("quantity_unit"))
    return _golden(spark, sf_dir).groupBy(key.alias("block")).agg(F.count(F.lit(1)).alias("n")).select("block", "n", F.expr("n * (n - 1) div 2").alias("pairs"))


def _small_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product names in blocks by size, as records to compare."""
    parts = tables(spark, sf_dir, "part")["part"].groupBy(F.col("p_size").cast("string").alias("block"), text.normalize_label(F.concat_ws(" ", "p_name", "p_type")).alias("label_normalized")).agg(F.min("p_partkey").alias("id"))
    return parts.join(parts.groupBy("block").agg(F.count(F.lit(1)).alias("block_size")), "block").withColumns({"label_enriched": F.lit(""), "brand": F.lit(""), "key": F.col("label_normalized"), "label": F.col("label_normalized")})


def _part_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names of `_small_blocks` as golden records, so that the block is the leaf."""
    none = F.lit(None)
    return _small_blocks(spark, sf_dir).drop("block_size").withColumns(
        {
            "key": F.concat_ws(" ", "block", "label"),
            "first_seq": F.col("id"), "taxonomy": F.array(F.lit("a"), F.lit("b"), F.lit("c"), F.col("block")), "quantity_value": none.cast("double"), "quantity_unit": none.cast("string"), "source_rows": F.col("id") % 7 + 1,
            "ean": F.when(F.col("id") % 3 == 0, F.col("id").cast("string")), "url_image": none.cast("string"), "url_ok": F.lit(False), "url_checked": F.lit(False), "vat_rate": F.when(F.col("id") % 2 == 0, 5.5).otherwise(20.0),
            "vat_conflict": F.lit(False), "publishable": F.lit(True),
        }
    ).drop("id", "block")


_SMALL = f"small AS (SELECT p_size::VARCHAR AS block, {oracle.norm('p_name || chr(32) || p_type')} AS label, min(p_partkey) AS id FROM part GROUP BY 1, 2)"
_PAIRED = "few AS (SELECT a.id AS l, b.id AS r, a.label AS a, b.label AS b FROM small a JOIN small b ON a.block = b.block AND a.id < b.id)"


@query("WITH s AS (SELECT l_suppkey % 3 AS block, l_orderkey * 10 + l_linenumber AS id, l_shipdate FROM lineitem), r AS (SELECT block, id, row_number() OVER (PARTITION BY block ORDER BY l_shipdate, id) AS rn FROM s) SELECT a.block, count(*) AS pairs, sum((a.id * 31 + b.id) % 1000003)::BIGINT AS mark FROM (SELECT *, unnest(range(rn + 1, rn + 101)) AS next FROM r) a JOIN r b ON a.block = b.block AND b.rn = a.next GROUP BY a.block")
def sorted_neighbourhood_pairs(spark, sf_dir):
    li = tables(spark, sf_dir, "lineitem")["lineitem"]
    rec = li.select((F.col("l_suppkey") % 3).alias("block"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_shipdate").alias("label_normalized"), F.lit(1 << 40).alias("block_size"))
    pairs = resolution.candidate_pairs(rec, RULES.thresholds, [])
    return pairs.groupBy(F.col("l_block").alias("block")).agg(F.count(F.lit(1)).alias("pairs"), F.sum((F.col("l_id") * 31 + F.col("r_id")) % 1000003).alias("mark"))


def _paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolution.candidate_pairs(_small_blocks(spark, sf_dir), RULES.thresholds, ["label_normalized"])


@query(f"WITH {_SMALL}, {_PAIRED} SELECT l, r, {oracle.lcs('a', 'b')} AS common, round(2.0 * {oracle.lcs('a', 'b')} / (length(a) + length(b)), 9) AS ratio FROM few")
def lcs_similarity(spark, sf_dir):
    a, b = F.col("l_label_normalized"), F.col("r_label_normalized")
    measured = _paired(spark, sf_dir).withColumn("common", similarity.lcs_length(a, b).cast("long"))
    return measured.select(F.col("l_id").alias("l"), F.col("r_id").alias("r"), "common", F.round(2.0 * F.col("common") / (F.length(a) + F.length(b)), 9).alias("ratio"))


_TOKENS = f"""toks AS (
  SELECT *, list_sort(list_distinct(string_split(a, ' '))) AS ta, list_sort(list_distinct(string_split(b, ' '))) AS tb FROM few),
parts_ AS (
  SELECT *, length(array_to_string(list_filter(ta, lambda x: list_contains(tb, x)), ' ')) AS c, array_to_string(list_filter(ta, lambda x: NOT list_contains(tb, x)), ' ') AS da, array_to_string(list_filter(tb, lambda x: NOT list_contains(ta, x)), ' ') AS db FROM toks),
sides AS (
  SELECT *, CASE WHEN c > 0 THEN 1 ELSE 0 END AS g, c + CASE WHEN c > 0 THEN 1 ELSE 0 END + length(da) AS la, c + CASE WHEN c > 0 THEN 1 ELSE 0 END + length(db) AS lb FROM parts_),
sims AS (
  SELECT l, r, greatest(2.0::DOUBLE * {oracle.lcs('a', 'b')} / (length(a) + length(b)),
    CASE WHEN c > 0 AND (da = '' OR db = '') THEN 1.0::DOUBLE
         ELSE greatest(1.0::DOUBLE - (length(da) + length(db) - 2.0::DOUBLE * CASE WHEN da = '' OR db = '' THEN 0 ELSE {oracle.lcs('da', 'db')} END) / (la + lb),
                       CASE WHEN c > 0 THEN 1.0::DOUBLE - (g + length(da)) / (c + la) ELSE 0 END, CASE WHEN c > 0 THEN 1.0::DOUBLE - (g + length(db)) / (c + lb) ELSE 0 END) END) AS score FROM sides)"""


@query(f"WITH {_SMALL}, {_PAIRED}, {_TOKENS} SELECT l, r, round(score, 9) AS score FROM sims")
def token_set_similarity(spark, sf_dir):
    scored = similarity.with_similarity(_paired(spark, sf_dir), "l_label_normalized", "r_label_normalized", "score")
    return scored.select(F.col("l_id").alias("l"), F.col("r_id").alias("r"), F.round("score", 9).alias("score"))


@query(f"WITH {_SMALL}, {_PAIRED}, {_TOKENS} SELECT CASE WHEN score >= 0.86 THEN 'merge' WHEN score >= 0.72 THEN 'grey' ELSE 'distinct' END AS zone, count(*) AS n FROM sims GROUP BY 1")
def grey_zone_pairs(spark, sf_dir):
    scored = similarity.with_similarity(_paired(spark, sf_dir), "l_label_normalized", "r_label_normalized", "score")
    zone = F.when(F.col("score") >= RULES.thresholds.merge, "merge").when(F.col("score") >= RULES.thresholds.reject, "grey").otherwise("distinct")
    return scored.groupBy(zone.alias("zone")).agg(F.count(F.lit(1)).alias("n"))


_ROOTED = """arcs AS (SELECT l AS u, r AS v FROM sims WHERE score >= 0.86 UNION ALL SELECT r, l FROM sims WHERE score >= 0.86),
walk(n, r) AS (SELECT id, id FROM small UNION SELECT arcs.v, walk.r FROM walk JOIN arcs ON arcs.u = walk.n),
rooted AS (SELECT s.id, s.label, s.block || ' ' || s.label AS key, min(w.r) AS root FROM small s JOIN walk w ON w.n = s.id GROUP BY ALL)"""


@query(f"""WITH RECURSIVE {_SMALL}, {_PAIRED}, {_TOKENS}, {_ROOTED}, b AS (SELECT block, count(*) AS n FROM small GROUP BY block),
z AS (SELECT count(*) AS compared, count(*) FILTER (WHERE score >= 0.86) AS merged, count(*) FILTER (WHERE score >= 0.72 AND score < 0.86) AS ambiguous, count(*) FILTER (WHERE score >= 0.72 AND score < 0.86 AND a.root <> b.root) AS unresolved FROM sims JOIN rooted a ON a.id = l JOIN rooted b ON b.id = r)
SELECT sum(n)::BIGINT AS records_in, count(*) AS blocks, max(n) AS largest_block, sum(n * (n - 1) // 2)::BIGINT AS pairs_after_blocking, (sum(n) * (sum(n) - 1) // 2)::BIGINT AS pairs_without_blocking, any_value(compared) AS pairs_compared, any_value(merged) AS pairs_merged, any_value(ambiguous) AS pairs_ambiguous, any_value(unresolved) AS pairs_unresolved, (SELECT count(DISTINCT root) FROM rooted) AS records_out FROM b, z""")
def pair_funnel(spark, sf_dir):  # I22, M1 to M7
    funnel = resolution.resolve(_part_records(spark, sf_dir), RULES.thresholds).funnel
    return funnel.select("records_in", "blocks", "largest_block", "pairs_after_blocking", "pairs_without_blocking", "pairs_compared", "pairs_merged", "pairs_ambiguous", "pairs_unresolved", "records_out")


@query(f"""WITH RECURSIVE {_SMALL}, {_PAIRED}, {_TOKENS}, {_ROOTED}
SELECT arg_max(label, (id % 7 + 1, length(label), -id)) AS label, min(key) AS key, sum(id % 7 + 1)::BIGINT AS source_rows, count(*) AS members, arg_min(id::VARCHAR, (-(id % 7 + 1), id)) FILTER (WHERE id % 3 = 0) AS ean, count(DISTINCT id % 2) > 1 AS vat_conflict, count(DISTINCT id % 2) = 1 AS publishable FROM rooted GROUP BY root""")
def entity_resolution(spark, sf_dir):  # M5, M6, I10
    records = settled(_part_records(spark, sf_dir))
    linked = resolution.resolve(records, RULES.thresholds)
    return resolution.fuse(records, linked.groups).select("label", "key", "source_rows", "members", "ean", "vat_conflict", "publishable")


@query(f"WITH RECURSIVE {_SMALL}, {_PAIRED}, {_TOKENS}, {_ROOTED}, heads AS (SELECT root, min(key) AS into_key FROM rooted GROUP BY root) SELECT r.key AS member, h.into_key AS key, r.id AS member_seq FROM rooted r JOIN heads h USING (root)")
def linked_lineage(spark, sf_dir):  # B5, I8: the rows of absorbed records follow the survivor
    records = settled(_part_records(spark, sf_dir))
    rows = records.select(F.col("key").alias("nom"), F.col("key").alias("id_produit"), F.col("first_seq").alias("row_seq"))
    linked = resolution.resolve(records, RULES.thresholds)
    return golden.lineage(rows, resolution.key_map(records, linked.groups)).select(F.col("row_id").alias("member"), "key", "member_seq")


@query("WITH RECURSIVE e AS (SELECT DISTINCT l_partkey AS u, (l_partkey * 7 + 3) % 2003 AS v FROM lineitem), a AS (SELECT u, v FROM e WHERE u <> v UNION SELECT v, u FROM e WHERE u <> v), w(n, r) AS (SELECT u, u FROM a UNION SELECT a.v, w.r FROM w JOIN a ON a.u = w.n) SELECT n AS node, min(r) AS root FROM w GROUP BY n")
def connected_components(spark, sf_dir):
    li = tables(spark, sf_dir, "lineitem")["lineitem"]
    return components(li.select(F.col("l_partkey").alias("u"), ((F.col("l_partkey") * 7 + 3) % 2003).alias("v")).distinct())


@query(f"""WITH {GOLDEN}, grouped AS (SELECT *, coalesce(nullif(string_split(path, ' > ')[4], ''), '?') AS g FROM golden),
fused AS (SELECT g, arg_max(label, (source_rows, length(label), -first_seq)) AS label, sum(source_rows)::BIGINT AS source_rows, min(key) AS key, arg_min(ean, (-source_rows, first_seq)) FILTER (WHERE coalesce(ean, '') <> '') AS ean,
  arg_min(url_image, (-source_rows, first_seq)) FILTER (WHERE url_ok) AS url, count(DISTINCT vat_rate) > 1 AS differ, count(*) AS members FROM grouped GROUP BY g) SELECT label, source_rows, key, ean, url, differ, members FROM fused""")
def cluster_fusion(spark, sf_dir):
    records = settled(_golden(spark, sf_dir).withColumn("vat_conflict", F.lit(False)))
    leaf = F.element_at("taxonomy", 4)
    heads = records.groupBy(leaf.alias("leaf")).agg(F.min("first_seq").alias("root"))
    groups = records.join(heads, leaf == F.col("leaf")).select(F.col("first_seq").alias("id"), "root")
    fused = resolution.fuse(records, groups)
    return fused.select("label", "source_rows", "key", "ean", F.when(F.col("url_ok"), F.col("url_image")).alias("url"), F.col("vat_conflict").alias("differ"), "members")


@query("WITH p AS (SELECT DISTINCT p_name AS label, CASE WHEN p_name LIKE 'small %' THEN replace(p_name, 'small ', 'large ') ELSE p_name END AS target, min(p_partkey) OVER (PARTITION BY p_name) AS id FROM part), h AS (SELECT target, min(id) AS head FROM p GROUP BY target) SELECT p.label, h.head AS root FROM p JOIN h USING (target)")
def forced_merge_clusters(spark, sf_dir):  # H9, M8, N9
    limits = dataclasses.replace(RULES.thresholds, merge=2.0, reject=2.0)  # nothing but what was learned
    parts = tables(spark, sf_dir, "part")["part"].groupBy(F.col("p_name").alias("label")).agg(F.min("p_partkey").alias("first_seq"))
    learned = parts.where(F.col("label").startswith("small ")).select("label", F.replace("label", F.lit("small "), F.lit("large ")).alias("into"))
    records = settled(parts.withColumns({"label_normalized": F.col("label"), "key": F.col("label"), "label_enriched": F.lit(""), "brand": F.lit(""), "taxonomy": F.array(*[F.col("label")] * 4), "quantity_value": F.lit(None).cast("double"), "quantity_unit": F.lit(None).cast("string")}))
    groups = resolution.resolve(records, limits, learned).groups
    return records.join(groups, F.col("first_seq") == F.col("id")).select("label", "root")


# --- decisions: N1 to N4, I23, I24 ---


@query(f"WITH {ROUTED} SELECT key, status, confidence FROM routed")
def route_records(spark, sf_dir):
    return routing.route(_golden(spark, sf_dir), RULES).select("key", "status", "confidence")


@query(f"WITH {ROUTED} SELECT count(*) FILTER (WHERE status = 'VALIDATED') AS validated, count(*) FILTER (WHERE status = 'AUTO_CORRECTED') AS auto_corrected, count(*) FILTER (WHERE status = 'NEEDS_REVIEW') AS needs_review, count(*) FILTER (WHERE status = 'REJECTED') AS rejected, round_even(100.0 * count(*) FILTER (WHERE status IN ('VALIDATED', 'AUTO_CORRECTED')) / count(*), 0)::DOUBLE AS automation_rate_pct FROM routed")
def automation_rate(spark, sf_dir):
    return routing.automation_rate(routing.route(_golden(spark, sf_dir), RULES)).withColumn("automation_rate_pct", F.col("automation_rate_pct").cast("double"))


@query(f"""WITH {GOLDEN}, d AS (SELECT key, vat_rate::VARCHAR AS v, count(*) AS n, min(row_seq) AS f FROM rows_ WHERE vat_rate IS NOT NULL GROUP BY ALL), t AS (SELECT key, sum(n)::BIGINT AS total, arg_min(v, (-n, f)) AS v, max(n) AS n FROM d GROUP BY key),
ids AS (SELECT key, arg_min(id_produit, row_seq) AS first_row, least(count(*), 10)::BIGINT AS shown FROM rows_ GROUP BY key)
SELECT g.key AS product_key, t.v AS proposed_value, t.n / t.total AS confidence, t.total - t.n AS affected_rows, first_row, shown FROM golden g JOIN t USING (key) JOIN ids USING (key) WHERE g.vat_conflict AND t.total > t.n""")
def vat_review_tasks(spark, sf_dir):
    rows = _checked(spark, sf_dir)
    asked = routing.vat_tasks(golden.golden_records(rows, RULES), golden.lineage(rows))
    return asked.select("product_key", "proposed_value", "confidence", "affected_rows", F.element_at("context.sample_row_ids", 1).alias("first_row"), F.size("context.sample_row_ids").cast("long").alias("shown"))


@query(f"WITH {_SMALL}, {_PAIRED}, {_TOKENS} SELECT 'possible_duplicate' AS kind, a.label AS title, b.label AS current_value, round(score, 9) AS confidence FROM sims JOIN small a ON a.id = l JOIN small b ON b.id = r WHERE score >= 0.72 AND score < 0.86")
def duplicate_review_tasks(spark, sf_dir):
    # Settled: a filter would carry the whole score expression into its two bounds.
    scored = settled(similarity.with_similarity(_paired(spark, sf_dir), "l_label_normalized", "r_label_normalized", "score")).where((F.col("score") >= RULES.thresholds.reject) & (F.col("score") < RULES.thresholds.merge))
    pairs = scored.select(*[F.col(f"{s}_label_normalized").alias(f"{w}_{c}") for s, w in (("l", "left"), ("r", "right")) for c in ("key", "label")], "score")
    return routing.duplicate_tasks(pairs).select("kind", "title", "current_value", F.round("confidence", 9).alias("confidence"))


# --- catalogue reads: H10, H11, G3, G4, I18 to I20, J1, J3, K1, B2 ---


@query("SELECT l.l_orderkey AS row_id, l.l_linenumber AS line, l.l_returnflag AS author, o.o_orderstatus AS status, c.c_name AS user_name, p.p_name AS product FROM lineitem l LEFT JOIN orders o ON l.l_orderkey = o.o_orderkey LEFT JOIN part p ON coalesce(CASE WHEN l.l_linenumber > 5 THEN NULL ELSE l.l_partkey END, o.o_custkey) = p.p_partkey LEFT JOIN customer c ON o.o_custkey = c.c_custkey WHERE l.l_returnflag = 'R'")
def audit_trail(spark, sf_dir):  # H10
    t = tables(spark, sf_dir, "lineitem", "orders", "part", "customer")
    fixes = t["lineitem"].select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("line"), F.col("l_returnflag").alias("author"), F.when(F.col("l_linenumber") <= 5, F.col("l_partkey")).alias("product_id"))
    runs = t["orders"].select(F.col("o_orderkey").alias("run_id"), F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("product_id"), F.col("o_custkey").alias("user_id"))
    out = reads.audit(fixes, runs, t["part"].select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("product")), t["customer"].select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("user_name")), "R")
    return out.select(F.col("run_id").alias("row_id"), "line", "author", "status", "user_name", "product")


@query("SELECT l_orderkey, l_linenumber, s_name, p_name FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey WHERE s_suppkey = 7")
def row_lookup(spark, sf_dir):  # H11
    t = tables(spark, sf_dir, "lineitem", "part", "supplier")
    rows = t["lineitem"].select(F.col("l_suppkey").alias("store_id"), F.col("l_partkey").alias("product_id"), "l_orderkey", "l_linenumber")
    found = reads.row_lookup(rows, t["part"].select(F.col("p_partkey").alias("product_id"), "p_name"), t["supplier"].select(F.col("s_suppkey").alias("store_id"), "s_name"), 7)
    return found.select("l_orderkey", "l_linenumber", "s_name", "p_name")


@query("SELECT p_partkey, p_name, p_brand FROM part WHERE p_name ILIKE '%RiNg%' AND p_type = 'ECONOMY' AND p_brand IN ('Brand#2', 'Brand#7') AND starts_with(p_name, 's')")
def product_search(spark, sf_dir):  # G3 to G6
    found = reads.search(tables(spark, sf_dir, "part")["part"], "RiNg", "p_name", equal={"p_type": "ECONOMY"}, among={"p_brand": ["Brand#2", "Brand#7"]}, prefix={"p_name": "s"})
    return found.select("p_partkey", "p_name", "p_brand")


@query("SELECT l_suppkey AS store_id, count(*) AS products, count(*) FILTER (WHERE l_linestatus = 'O') AS publishable, sum(l_quantity) AS source_rows, max(l_shipdate) AS updated_at FROM lineitem GROUP BY 1")
def store_rollup(spark, sf_dir):  # I18
    li = tables(spark, sf_dir, "lineitem")["lineitem"]
    return reads.store_rollup(li.select(F.col("l_suppkey").alias("store_id"), (F.col("l_linestatus") == "O").alias("publishable"), F.col("l_quantity").alias("source_rows"), F.col("l_shipdate").alias("updated_at")))


@query("SELECT count(*) AS total_runs, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-24 00:00:00') AS recent_runs, count(*) FILTER (WHERE event_type = 'error') AS pending, count(DISTINCT user_id) AS stores, round(count(*) FILTER (WHERE event_type = 'click') / count(*), 6) AS publishable_rate FROM events")
def dashboard_metrics(spark, sf_dir):  # I19
    e = tables(spark, sf_dir, "events")["events"]
    return reads.dashboard(e, F.lit("2024-01-24 00:00:00").cast("timestamp_ntz"), F.col("event_type") == "error", F.col("event_type") == "click", "user_id", "ts")


@query("SELECT o_orderkey, o_orderdate FROM (SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20)")
def run_history(spark, sf_dir):  # J3
    return reads.last_runs(tables(spark, sf_dir, "orders")["orders"].select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey")


@query("WITH r AS (SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL), last AS (SELECT DISTINCT l_suppkey FROM lineitem ORDER BY 1 DESC LIMIT 5) SELECT l_returnflag AS code, sum(n)::BIGINT AS n FROM r WHERE l_suppkey IN (SELECT * FROM last) GROUP BY 1")
def anomaly_map_merge(spark, sf_dir):  # I20
    counted = tables(spark, sf_dir, "lineitem")["lineitem"].groupBy("l_suppkey", "l_returnflag").agg(F.count(F.lit(1)).alias("n"))
    runs = counted.groupBy("l_suppkey").agg(F.map_from_entries(F.collect_list(F.struct("l_returnflag", "n"))).alias("codes"))
    return reads.merged_counts(runs, "codes", "l_suppkey")


@query(f"WITH {ROUTED} SELECT coalesce(ean, '') AS ean, coalesce(internal_code, '') AS internal_code, CASE WHEN label_enriched <> '' THEN label_enriched ELSE label END AS nom, label AS nom_origine, coalesce(url_image, '') AS url_image, string_split(path, ' > ')[1] AS taxonomie_niveau_1, string_split(path, ' > ')[4] AS taxonomie_niveau_4, coalesce(vat_rate::VARCHAR, '') AS tva, coalesce(quantity_unit, '') AS unite, status AS statut, CASE WHEN publishable THEN 'oui' ELSE 'non' END AS publiable, source_rows::VARCHAR AS lignes_fusionnees FROM routed")
def export_catalogue(spark, sf_dir):
    return sinks.export_frame(routing.route(_golden(spark, sf_dir), RULES)).select("ean", "internal_code", "nom", "nom_origine", "url_image", "taxonomie_niveau_1", "taxonomie_niveau_4", "tva", "unite", "statut", "publiable", "lignes_fusionnees")


@query("SELECT l_suppkey AS store_id, l_partkey AS product_key, l_quantity AS source_rows, id FROM (SELECT *, l_orderkey * 10 + l_linenumber AS id, row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_quantity DESC, l_orderkey * 10 + l_linenumber) AS rn FROM lineitem) WHERE rn = 1")
def dedupe_keep_largest(spark, sf_dir):
    li = tables(spark, sf_dir, "lineitem")["lineitem"]
    return catalogue.dedupe_keep_largest(li.select(F.col("l_suppkey").alias("store_id"), F.col("l_partkey").alias("product_key"), F.col("l_quantity").alias("source_rows"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id")))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 200")
def top_runs(spark, sf_dir):  # K1: a top-k report
    return tables(spark, sf_dir, "orders")["orders"].orderBy(F.desc("o_totalprice"), "o_orderkey").limit(200).select("o_orderkey", "o_totalprice")


# --- catalogue state: B4 to B9, H12, H13, N5 to N8 ---


def _stores(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    li = tables(spark, sf_dir, "lineitem")["lineitem"].select(F.col("l_suppkey").alias("store_id"), F.col("l_partkey").alias("product_key"), "l_orderkey", "l_linenumber", F.col("l_quantity").alias("q"))
    old = li.where("l_linenumber <= 2").groupBy("store_id", "product_key").agg(F.max("q").alias("source_rows"))
    new = li.where("l_linenumber >= 2").select("store_id", "product_key", F.col("q").alias("source_rows"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("first_seq"))
    return old, new


@query("WITH o AS (SELECT l_suppkey AS s, l_partkey AS p, max(l_quantity) AS q FROM lineitem WHERE l_linenumber <= 2 GROUP BY ALL), n AS (SELECT l_suppkey AS s, l_partkey AS p, arg_min(l_quantity, l_orderkey * 10 + l_linenumber) AS q FROM lineitem WHERE l_linenumber >= 2 GROUP BY ALL) SELECT s AS store_id, p AS product_key, CASE WHEN o.q IS NULL THEN 'inserted' WHEN n.q IS NULL THEN 'retired' ELSE 'updated' END AS change, coalesce(n.q, o.q) AS source_rows FROM o FULL OUTER JOIN n USING (s, p)")
def catalogue_merge(spark, sf_dir):
    old, new = _stores(spark, sf_dir)
    return catalogue.merge_snapshot(old, new).select("store_id", "product_key", "change", "source_rows")


@query("SELECT p_partkey AS product_key, CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 5 = 1 THEN 'EDITED ' || p_name ELSE p_name END AS label, p_brand AS origin FROM part")
def override_replay(spark, sf_dir):
    part = tables(spark, sf_dir, "part")["part"]
    products = part.select(F.lit("s").alias("store_id"), F.col("p_partkey").alias("product_key"), F.col("p_name").alias("label"), F.col("p_brand").alias("origin"))
    edits = part.where("p_partkey % 5 < 2").select(F.lit("s").alias("store_id"), F.col("p_partkey").alias("product_key"), F.lit("label").alias("field_name"), F.when(F.col("p_partkey") % 5 == 1, F.concat(F.lit("EDITED "), F.col("p_name"))).alias("value"))
    return catalogue.replay_overrides(products, edits).select("product_key", "label", "origin")


def _merged_parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Parts as products, and merges of each tenth with the next and of that with the one after."""
    part = tables(spark, sf_dir, "part")["part"]
    products = part.select(
        F.lit("s").alias("store_id"), F.col("p_partkey").alias("id"), F.col("p_size").cast("long").alias("source_rows"), F.col("p_brand").alias("brand"), F.when(F.col("p_partkey") % 3 == 0, 20.0).otherwise(5.5).alias("vat_rate"), F.lit("VALIDATED").alias("status"), F.lit(True).alias("publishable")
    )
    merges = part.where("p_partkey % 10 < 2").select(F.lit("s").alias("store_id"), F.col("p_partkey").alias("left_id"), (F.col("p_partkey") + 1).alias("right_id"))
    return products, merges


@query("""WITH p AS (SELECT p_partkey AS id, p_size::BIGINT AS source_rows, p_brand AS brand, CASE WHEN p_partkey % 3 = 0 THEN 20.0 ELSE 5.5 END AS rate FROM part),
m AS (SELECT a.id AS a, coalesce(a.brand = b.brand, FALSE) AS e1, coalesce(b.brand = c.brand, FALSE) AS e2 FROM p a LEFT JOIN p b ON b.id = a.id + 1 LEFT JOIN p c ON c.id = a.id + 2 WHERE a.id % 10 = 0),
g AS (SELECT p.*, CASE WHEN p.id % 10 = 1 AND e1 THEN a WHEN p.id % 10 = 2 AND e2 THEN CASE WHEN e1 THEN a ELSE a + 1 END ELSE p.id END AS root FROM p LEFT JOIN m ON m.a = p.id - p.id % 10)
SELECT arg_max(id, (source_rows, id)) AS id, sum(source_rows)::BIGINT AS source_rows, CASE WHEN count(DISTINCT rate) > 1 THEN 'NEEDS_REVIEW' ELSE 'VALIDATED' END AS status, count(DISTINCT rate) = 1 AS publishable FROM g GROUP BY root""")
def manual_merge(spark, sf_dir):  # N6: chains of merges make one product
    return catalogue.merge_products(*_merged_parts(spark, sf_dir))[0].select("id", "source_rows", "status", "publishable")


@query("SELECT p_partkey AS id, p_size::BIGINT AS source_rows FROM part")
def undo_manual_merge(spark, sf_dir):  # N7
    products, merges = _merged_parts(spark, sf_dir)
    merged, journal = catalogue.merge_products(products, merges)
    return catalogue.undo_merge(merged, journal).select("id", "source_rows")


@query(f"WITH {GOLDEN} SELECT key AS product_key, CASE WHEN source_rows % 3 = 0 THEN 20.0::DOUBLE ELSE vat_rate END AS vat_rate, CASE WHEN source_rows % 3 = 0 THEN coalesce(ean, '') <> '' AND url_ok AND string_split(path, ' > ')[4] <> '' ELSE publishable END AS publishable FROM golden")
def decision_apply(spark, sf_dir):  # N5, F10
    products = _golden(spark, sf_dir).withColumns({"store_id": F.lit("s"), "product_key": F.col("key"), "status": F.lit("NEEDS_REVIEW")})
    value = F.when(F.col("source_rows") % 3 == 0, "20 %").otherwise("33")
    return catalogue.decide(products, products.select("store_id", "product_key", value.alias("value")), RULES).select("product_key", "vat_rate", "publishable")


@query("SELECT user_id, event_id, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def url_cache_upsert(spark, sf_dir):  # B7
    e = tables(spark, sf_dir, "events")["events"]
    keyed = e.withColumn("at", F.struct("ts", "event_id"))
    return catalogue.keep_latest(keyed.where("event_id % 2 = 0"), keyed.where("event_id % 2 = 1"), "user_id", "at").select("user_id", "event_id", "ts", "value")


@query("WITH c AS (SELECT DISTINCT user_id AS k FROM events WHERE event_type = 'view'), u AS (SELECT DISTINCT user_id AS k FROM events WHERE event_type = 'error') SELECT coalesce(c.k, u.k) AS cache_key, CASE WHEN c.k IS NOT NULL AND u.k IS NOT NULL THEN 1 ELSE 0 END AS hits FROM c FULL OUTER JOIN u ON c.k = u.k")
def llm_cache_persist(spark, sf_dir):  # B8, A11
    e = tables(spark, sf_dir, "events")["events"]
    cache = e.where("event_type = 'view'").select(F.col("user_id").alias("cache_key")).distinct().withColumn("hits", F.lit(0))
    return catalogue.bump_hits(cache, e.where("event_type = 'error'").select(F.col("user_id").alias("cache_key")))


# --- enrichment: N10 to N13, K5, L1, H4 to H6 ---


@query(f"WITH {LISTED}, d AS (SELECT nom, min(row_seq) AS f FROM listing WHERE nom <> '' GROUP BY nom), r AS (SELECT nom, row_number() OVER (ORDER BY f, nom) AS rn FROM d) SELECT (rn - 1) // 25 AS batch, count(*) AS n, arg_min(nom, rn) AS first_label, arg_max(nom, rn) AS last_label FROM r GROUP BY 1")
def llm_batches(spark, sf_dir):
    made = enrichment.batches(enrichment.distinct_labels(listing(spark, sf_dir)))
    return made.select("batch", F.size("labels").cast("long").alias("n"), F.element_at("labels", 1).alias("first_label"), F.element_at("labels", -1).alias("last_label"))


@query("SELECT l_orderkey, l_linenumber, round(l_quantity * 1000 * 5.0 / 1000000 * 0.5 + l_linenumber * 60 * 25.0 / 1000000 * 0.5 + l_partkey * 5.0 / 1000000 * 0.5 * 0.1 + l_suppkey * 5.0 / 1000000 * 0.5 * 1.25, 9) AS total_usd FROM lineitem")
def cost_model(spark, sf_dir):
    li = tables(spark, sf_dir, "lineitem")["lineitem"]
    usd = enrichment.cost(PRICE, F.col("l_quantity") * 1000, F.col("l_linenumber") * 60, F.col("l_partkey"), F.col("l_suppkey"), batch=True)
    return li.select("l_orderkey", "l_linenumber", F.round(usd["total_usd"], 9).alias("total_usd"))


@query(f"""WITH {LISTED}, d AS (SELECT nom, count(*) AS n FROM listing WHERE trim(nom) <> '' GROUP BY nom), t AS (SELECT (SELECT count(*) FROM listing) AS rows_in, sum(n)::BIGINT AS labels, count(*) AS d, sum(length(nom))::BIGINT AS chars, sum(length(nom) * n)::BIGINT AS all_chars FROM d)
SELECT rows_in, d AS distinct_labels, round(rows_in / d, 1) AS dedup_factor, ceil(d / 25)::BIGINT AS calls, (ceil(d / 25) * 300 + chars // 4)::BIGINT AS input_tokens, d * 60 AS output_tokens,
  round((ceil(d / 25) * 300 + chars // 4) * 5e-6 + d * 60 * 25e-6, 4) AS cost_usd, round((d * 300 + chars // 4) * 5e-6 + d * 60 * 25e-6, 4) AS cost_without_batching_usd, round((ceil(labels / 25) * 300 + all_chars // 4) * 5e-6 + labels * 60 * 25e-6, 4) AS cost_without_dedup_usd FROM t""")
def dry_run_estimate(spark, sf_dir):
    return enrichment.dry_run(listing(spark, sf_dir), PRICE)


@query(f"WITH {LISTED} SELECT id_produit, CASE WHEN partkey % 6 = 0 THEN 'NEW ' || nom ELSE nom END AS nom_enrichi, CASE WHEN partkey % 3 < 2 THEN 'ACME' ELSE '' END AS brand, CASE partkey % 3 WHEN 0 THEN 0.9 WHEN 1 THEN 0.5 ELSE 0.0 END::DOUBLE AS llm_confidence, CASE WHEN partkey % 6 = 0 THEN 1 ELSE 0 END::BIGINT AS fixes FROM listing")
def enrichment_apply(spark, sf_dir):  # sure, unsure and empty proposals
    rows = listing(spark, sf_dir)
    labels = rows.where("partkey % 6 in (0, 1, 3, 4)").select("nom", (F.col("partkey") % 6).alias("k")).distinct()
    label = F.when(F.col("k") == 3, "  ").otherwise(F.concat(F.lit("NEW "), F.col("nom")))
    answers = labels.select(F.col("nom").alias("source"), label.alias("label"), F.lit(" ACME ").alias("brand"), F.when(F.col("k") % 3 == 0, 0.9).otherwise(0.5).alias("confidence"))
    return steps.enrich(rows, RULES, answers).select("id_produit", "nom_enrichi", "brand", "llm_confidence", F.size(F.filter("corrections", lambda c: c["author"] == "LLM")).cast("long").alias("fixes"))


# --- profiling: I25, I26 ---


@query(f"WITH {LISTED} SELECT length(trim(ean)) AS len, count(*) AS n, count(DISTINCT ean) AS codes FROM listing GROUP BY 1")
def profile_lengths(spark, sf_dir):
    return listing(spark, sf_dir).groupBy(F.length(F.trim("ean")).cast("long").alias("len")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("ean").alias("codes"))


@query(f"WITH {LISTED} " + " UNION ALL ".join(f"SELECT '{c}' AS field, count(*) FILTER (WHERE trim({c}) <> '') AS filled, round(count(*) FILTER (WHERE trim({c}) <> '') / count(*), 6) AS rate FROM listing" for c in sources.COLUMNS))
def profile_fill_rates(spark, sf_dir):
    rows = listing(spark, sf_dir)
    counted = rows.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.trim(c) != "").alias(c) for c in sources.COLUMNS])
    return counted.unpivot(["n"], list(sources.COLUMNS), "field", "filled").select("field", "filled", F.round(F.col("filled") / F.col("n"), 6).alias("rate"))


@query(f"WITH {LISTED} SELECT taxonomie_niveau_4 AS leaf, count(*) FILTER (WHERE trim(tva) = '20%') AS r20, count(*) FILTER (WHERE trim(tva) = '5.5') AS r55, count(*) FILTER (WHERE trim(tva) = '10 %') AS r10, count(*) FILTER (WHERE trim(tva) = '2,1') AS r21 FROM listing GROUP BY 1")
def profile_crosstab(spark, sf_dir):
    wide = listing(spark, sf_dir).groupBy(_level(3).alias("leaf")).pivot("tva", ["20%", " 5.5", "10 %", "2,1"]).agg(F.count(F.lit(1)))
    return wide.select("leaf", *[F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias(n) for c, n in (("20%", "r20"), (" 5.5", "r55"), ("10 %", "r10"), ("2,1", "r21"))])


@query(f"WITH {LISTED} SELECT nom, count(DISTINCT trim(tva)) AS rates, count(*) AS n FROM listing GROUP BY nom HAVING count(DISTINCT trim(tva)) > 1")
def profile_multi_rate_labels(spark, sf_dir):
    return listing(spark, sf_dir).groupBy("nom").agg(F.count_distinct(F.trim("tva")).alias("rates"), F.count(F.lit(1)).alias("n")).where("rates > 1")


# --- documents, times: G8, O3 ---


@query("SELECT event_type, (json_extract(props, '$.k')::INT) % 10 AS k, count(*) AS n FROM events GROUP BY ALL")
def json_props(spark, sf_dir):
    return tables(spark, sf_dir, "events")["events"].groupBy("event_type", (F.get_json_object("props", "$.k").try_cast("int") % 10).alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 24 HOURS")
def recent_events_ttl(spark, sf_dir):
    return catalogue.fresh_within(tables(spark, sf_dir, "events")["events"], "ts", F.lit("2024-01-30 00:00:00").cast("timestamp_ntz"), 24).select("event_id", "user_id")


# --- without SQL: C1 exact, C6, O1, the whole run ---


@query(f"""WITH {LISTED}, n AS (SELECT DISTINCT nom FROM listing) SELECT nom, array_to_string(list_transform(regexp_extract_all(hex(encode(nom)), '..'), lambda h: chr(('0x' || h)::INT)), '') AS spoiled,
trim(regexp_replace(nom, '\\s+', ' ', 'g')) AS repaired, strip_accents(nom) AS plain FROM n""")
def mojibake_repair(spark, sf_dir):  # C1, C6
    """Names spoiled by reading UTF-8 as Latin-1, and repaired."""
    names = listing(spark, sf_dir).select("nom").distinct()
    spoiled = F.decode(F.encode("nom", "UTF-8"), "ISO-8859-1")
    return names.select("nom", spoiled.alias("spoiled")).select("nom", "spoiled", text.repair_mojibake(F.col("spoiled")).alias("repaired"), text.strip_accents_exact(F.col("nom")).alias("plain"))


@query(f"WITH {LISTED} SELECT taxonomie_niveau_4 AS leaf, count(*) AS n FROM listing GROUP BY 1")
def inbox_stream(spark, sf_dir):  # A8, O1
    """The listing as deposited files, read once by the stream, counted by leaf."""
    from shelfwise.streaming import inbox

    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/inbox-{uuid.uuid4().hex}"
    rows = listing(spark, sf_dir).select(*sources.COLUMNS)
    rows.write.option("header", True).option("escape", '"').csv(f"{base}/in")

    def handle(batch: DataFrame, number: int) -> None:
        batch.groupBy(F.col("taxonomie_niveau_4").alias("leaf")).agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    inbox.process(spark, f"{base}/in", f"{base}/state", handle).awaitTermination()
    return spark.read.parquet(f"{base}/out").groupBy("leaf").agg(F.sum("n").alias("n"))


@query()
def pipeline_report(spark, sf_dir):
    """The whole run over the listing: one report row."""
    return pipeline.run_pipeline(listing(spark, sf_dir), RULES, "run", projection.statuses(spark, sf_dir), network=True).report


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many records go where: rows checked, grouped into records and routed."""
    return routing.route(_golden(spark, sf_dir), RULES).groupBy("status").agg(F.count(F.lit(1)).alias("records"), F.sum("source_rows").alias("source_rows"))


query(f"WITH {ROUTED} SELECT status, count(*) AS records, sum(source_rows)::BIGINT AS source_rows FROM routed GROUP BY status")(flagship)
