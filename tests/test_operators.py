"""Steps, records, linking, routing, catalogue state, sources, streaming."""

import pytest
from pyspark.sql import functions as F

from shelfwise.config import LEVELS, RuleSet, Settings, Thresholds
from shelfwise.operators import catalogue, enrichment, golden, reads, resolution, routing, steps
from shelfwise.operators.components import components
from shelfwise.operators.ranking import ranked
from shelfwise.plans import pipeline
from shelfwise.session import settled
from shelfwise.sources import listing, sinks
from shelfwise.streaming import inbox

PATH = ("ALIMENTAIRE", "BOISSONS", "SODAS", "COLA")
GOOD = {"ean": "3017620422003", "nom": "COCA COLA 1L", "url_image": "https://a/x", "tva": "5.5", **dict(zip(LEVELS, PATH, strict=True))}


def rows(spark, *changes):
    made = [{**GOOD, "id_produit": f"r{k}", "row_seq": k, **c} for k, c in enumerate(changes)]
    return spark.createDataFrame([tuple(m[c] for c in (*listing.COLUMNS, "row_seq")) for m in made], ", ".join(f"{c} string" for c in listing.COLUMNS) + ", row_seq long")


def good_statuses(spark):
    return spark.createDataFrame([("https://a/x", True, "ok"), ("https://dead/x", False, "dns")], "url string, ok boolean, reason string")


def checked(spark, *changes, statuses=True):
    return settled(pipeline.checked_rows(rows(spark, *changes), RuleSet.load(), good_statuses(spark) if statuses else None))


def codes(df):
    return {r["id_produit"]: sorted(a["code"] for a in r["anomalies"]) for r in df.collect()}


def test_ingest_never_filters_and_audits_every_change(spark):
    df = checked(spark, {}, {"nom": ""}, {"nom": "CAFÃ‰  MOULU"}, {"nom": "COCA 1LFAMILY SIZE"}, {"tva": None, "ean": None, "url_image": None})
    assert df.count() == 5
    assert codes(df)["r0"] == []
    assert "label_empty" in codes(df)["r1"] and "mojibake_fixed" in codes(df)["r2"] and "marketing_suffix_detached" in codes(df)["r3"]
    fixes = {r["id_produit"]: [(c["field_name"], c["old_value"], c["new_value"], c["rule"]) for c in r["corrections"]] for r in df.collect()}
    assert fixes["r2"] == [("nom", "CAFÃ‰  MOULU", "CAFÉ MOULU", "ingest.fix_text")]
    assert fixes["r3"] == [("nom", "COCA 1LFAMILY SIZE", "COCA 1L", "ingest.detach_suffix")]


def test_the_rate_is_never_corrected(spark):
    df = checked(spark, {"tva": "20"}, {"tva": "33"}, {"tva": ""}, {"tva": "abc"})
    assert [r["vat_rate"] for r in df.orderBy("row_seq").collect()] == [20.0, 33.0, None, None]
    assert df.where(F.exists("corrections", lambda c: c["field_name"] == "tva")).count() == 0
    assert "vat_category_mismatch" in codes(df)["r0"] and "vat_illegal_rate" in codes(df)["r1"] and "vat_missing" in codes(df)["r2"]


def test_a_code_is_repaired_only_if_it_checks(spark):
    df = checked(spark, {"ean": "03017620422003"}, {"ean": "3017620422004"}, {"ean": "790"}).orderBy("row_seq").collect()
    assert [(r["ean"], r["ean_valid"], r["internal_code"]) for r in df] == [("3017620422003", True, ""), ("", False, ""), ("", False, "790")]


def test_unchecked_address_is_never_publishable(spark, rules):
    for statuses, share in ((True, 1.0), (False, 0.0)):
        df = checked(spark, {}, statuses=statuses)
        assert df.agg(F.avg(routing.row_publishable(df, rules).cast("double"))).first()[0] == share


def test_gap_filled_keeps_both_anomalies(spark):
    df = checked(spark, {LEVELS[1]: ""})
    assert codes(df)["r0"] == ["taxonomy_gap", "taxonomy_gap_filled"]
    assert df.first()[LEVELS[1]] == "BOISSONS"


def test_survivorship_and_first_seen_ties(spark, rules):
    df = checked(spark, {"nom": "Coca Cola 1L."}, {"nom": "COCA COLA 1L", "ean": "96385074"}, {"nom": "coca  cola 1l"}, {"nom": "COCA-COLA 1L!", "tva": "10", "ean": "96385074"})
    rec = golden.golden_records(df, rules).collect()
    assert len(rec) == 1
    r = rec[0]
    assert (r["label"], r["ean"], r["source_rows"], r["vat_rate"], r["vat_conflict"]) == ("Coca Cola 1L.", "3017620422003", 4, 5.5, True)
    assert r["vat_distribution"] == {"5.5": 3, "10.0": 1} and not r["publishable"]


def test_records_do_not_depend_on_partitioning(spark, rules):
    changes = [{"nom": f"COCA COLA {k % 3}L", "ean": ["3017620422003", "96385074"][k % 2], "tva": ["5.5", "10"][k % 4 == 0]} for k in range(40)]
    one = sorted(map(str, golden.golden_records(checked(spark, *changes).repartition(1), rules).collect()))
    assert one == sorted(map(str, golden.golden_records(checked(spark, *changes).repartition(7), rules).collect()))


def record_frame(spark, *specs):
    base = {"key": None, "label": None, "taxonomy": list(PATH), "quantity_value": 1.0, "quantity_unit": "L", "brand": "", "label_enriched": "", "source_rows": 1, "vat_rate": 5.5, "ean": None, "url_image": None, "url_ok": False, "url_checked": False, "vat_conflict": False, "publishable": True}
    made = []
    for k, s in enumerate(specs):
        r = {**base, **s, "first_seq": k}
        r["key"] = r["label_normalized"] = r["label"]
        made.append(tuple(r[c] for c in (*base, "label_normalized", "first_seq")))
    kinds = "key string, label string, taxonomy array<string>, quantity_value double, quantity_unit string, brand string, label_enriched string, source_rows long, vat_rate double, ean string, url_image string, url_ok boolean, url_checked boolean, vat_conflict boolean, publishable boolean, label_normalized string, first_seq long"
    return spark.createDataFrame(made, kinds)


def test_linking_merges_blocks_and_brands(spark):
    rec = record_frame(
        spark, {"label": "COCA COLA ZERO", "source_rows": 5, "ean": "1"}, {"label": "ZERO COCA COLA", "vat_rate": 10.0}, {"label": "COCA COLA ZERO X", "quantity_value": 33.0, "quantity_unit": "CL"}, {"label": "COCA ZERO COLA", "brand": "A"}, {"label": "COLA COCA ZERO", "brand": "B"}
    )
    done = resolution.resolve(rec)
    f = done.funnel.first()
    assert (f["records_in"], f["blocks"], f["pairs_compared"], f["pairs_blocked_by_brand"], f["records_out"]) == (5, 2, 6, 1, 2)
    fused = {r["key"]: r for r in resolution.fuse(rec, done.groups).collect()}
    merged = fused["COCA COLA ZERO"]
    assert merged["source_rows"] == 8 and merged["vat_conflict"] and not merged["publishable"] and merged["ean"] == "1"


def test_learned_merges_ignore_blocks(spark):
    rec = record_frame(spark, {"label": "AAA"}, {"label": "ZZZ", "quantity_value": 9.0})
    learned = spark.createDataFrame([("ZZZ", "AAA")], "label string, into string")
    done = resolution.resolve(rec, learned=learned)
    assert done.funnel.first()["pairs_merged_by_human"] == 1 and done.groups.select("root").distinct().count() == 1


def test_grey_pairs_stay_unresolved_unless_joined(spark):
    rec = record_frame(spark, {"label": "NUTELLA 750 G"}, {"label": "NUTELLA POT 750GR"})
    assert resolution.resolve(rec).unresolved.count() == 1
    rec = record_frame(spark, {"label": "NUTELLA 750 G"}, {"label": "NUTELLA POT 750GR"}, {"label": "NUTELLA POT 750GR 750 G"})
    out = resolution.resolve(rec)
    assert out.groups.select("root").distinct().count() == 1 and out.unresolved.count() == 0


def test_large_blocks_use_the_window(spark):
    rec = record_frame(spark, *[{"label": f"P{k:03d}"} for k in range(30)])
    done = resolution.resolve(rec, Thresholds(max_exact_block=20, window=5, merge=2.0, reject=2.0))
    f = done.funnel.first()
    assert f["windowed_blocks"] == 1 and f["pairs_compared"] == 5 * 25 + 4 + 3 + 2 + 1 and f["pairs_after_blocking"] == 435


def test_components_against_union_find(spark):
    import random

    r = random.Random(3)
    edges = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(180)] + [(1000 + k, 1001 + k) for k in range(60)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {n: root for n, root in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {n: find(n) for a, b in edges if a != b for n in (a, b)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize(
    ("change", "status", "confidence"),
    [({}, "VALIDATED", 1.0), ({"label": " "}, "REJECTED", 0.0), ({"vat_conflict": True}, "NEEDS_REVIEW", 1.0), ({"vat_rate": None}, "NEEDS_REVIEW", 1.0), ({"vat_rate": 33.0}, "NEEDS_REVIEW", 1.0),
     ({"label_enriched": "Y", "llm_confidence": 0.5}, "NEEDS_REVIEW", 0.5), ({"label_enriched": "Y", "llm_confidence": 0.9}, "AUTO_CORRECTED", 0.9), ({"taxonomy_conflict": True}, "NEEDS_REVIEW", 0.5), ({"publishable": False}, "NEEDS_REVIEW", 0.6)],
)
def test_routing_cascade(spark, rules, change, status, confidence):
    base = {"label": "X", "label_enriched": "", "llm_confidence": 0.0, "vat_conflict": False, "vat_rate": 5.5, "taxonomy_conflict": False, "publishable": True, "ean": "1", "url_ok": True, "url_checked": True, "taxonomy": list(PATH)}
    one = spark.createDataFrame([tuple({**base, **change}.values())], "label string, label_enriched string, llm_confidence double, vat_conflict boolean, vat_rate double, taxonomy_conflict boolean, publishable boolean, ean string, url_ok boolean, url_checked boolean, taxonomy array<string>")
    r = routing.route(one, rules).first()
    assert (r["status"], r["confidence"]) == (status, confidence)


def test_quarantine_needs_the_network_for_the_rate(spark, rules):
    df = checked(spark, {}, statuses=False)
    rec = golden.golden_records(df, rules)
    assert not routing.report(df, rec, rules, network=False).first()["quarantined"]
    assert routing.report(df, rec, rules, network=True).first()["quarantined"]
    bad = checked(spark, {"tva": ""}, {"tva": "33"}, {})
    assert sinks.exit_code(routing.report(bad, golden.golden_records(bad, rules), rules)) == 1


def test_whole_run_on_clean_rows(spark):
    changes = [{"nom": f"COCA COLA {k % 5 + 1}L"} for k in range(40)]
    out = pipeline.run_pipeline(rows(spark, *changes), statuses=good_statuses(spark), network=True)
    r = out.report.first()
    assert (r["rows_in"], r["records_total"], r["publishable_rate"], r["quarantined"]) == (40, 5, 1.0, False)
    assert out.anomalies.count() == 0 and out.lineage.count() == 40


def test_snapshot_merge_and_overrides(spark):
    old = spark.createDataFrame([("s", "a", "A"), ("s", "b", "B")], "store_id string, product_key string, label string")
    new = spark.createDataFrame([("s", "b", "B2", 1), ("s", "c", "C", 2), ("s", "c", "late", 3)], "store_id string, product_key string, label string, first_seq long")
    got = {r["product_key"]: (r["change"], r["label"]) for r in catalogue.merge_snapshot(old, new).collect()}
    assert got == {"a": ("retired", "A"), "b": ("updated", "B2"), "c": ("inserted", "C")}
    none = spark.createDataFrame([], "store_id string, product_key string, field_name string, value string, previous_value string")
    edits = catalogue.set_override(none, old, "s", "a", "label", "X")
    edits = catalogue.set_override(edits, catalogue.replay_overrides(old, edits, ("label",)), "s", "a", "label", None)
    assert [tuple(r)[3:] for r in edits.collect()] == [(None, "A")]
    replayed = {r["product_key"]: r["label"] for r in catalogue.replay_overrides(old, edits, ("label",)).collect()}
    assert replayed == {"a": None, "b": "B"}
    left, back = catalogue.undo_override(edits, catalogue.replay_overrides(old, edits, ("label",)), "s", "a", "label")
    assert left.count() == 0 and {r["label"] for r in back.collect()} == {"A", "B"}
    with pytest.raises(ValueError):
        catalogue.set_override(none, old, "s", "a", "vat_rate", "5.5")


def test_per_run_replace_is_capped(spark):
    stored = spark.createDataFrame([("r1", "x", 1), ("r2", "y", 1)], "run_id string, code string, row_seq long")
    fresh = spark.createDataFrame([("r1", str(k), k) for k in range(10)], stored.schema)
    got = catalogue.per_run_replace(stored, fresh, "r1", cap=3).collect()
    assert sorted((r["run_id"], r["code"]) for r in got) == [("r1", "0"), ("r1", "1"), ("r1", "2"), ("r2", "y")]


def test_ceilings():
    c = enrichment.Ceiling(max_calls=2, max_cost_usd=1.0)
    c.charge(0.4)
    assert c.allows()
    c.charge(0.4)
    assert not c.allows()
    assert enrichment.reserve(5.0, 10.0, 7.0, 1.0) == 2.0 and enrichment.reserve(-1.0, 10.0, 0, 0) == 0.0


def test_decision_accepts_only_legal_rates(spark, rules):
    p = spark.createDataFrame([("s", "a", 33.0, "NEEDS_REVIEW", False, "1", True, list(PATH))], "store_id string, product_key string, vat_rate double, status string, publishable boolean, ean string, url_ok boolean, taxonomy array<string>")
    say = lambda v: catalogue.decide(p, spark.createDataFrame([("s", "a", v)], "store_id string, product_key string, value string"), rules).first()
    assert (say("5,5")["vat_rate"], say("5,5")["status"], say("5,5")["publishable"]) == (5.5, "VALIDATED", True)
    for wrong in ("33", "", "x"):
        assert say(wrong)["vat_rate"] == 33.0 and say(wrong)["status"] == "NEEDS_REVIEW"


HEADER = ",".join(listing.COLUMNS)


def test_csv_scan(spark, tmp_path):
    body = HEADER + '\r\n1,301,"COCA, ""ZERO""\nX",http://a,A,B,C,D,5.5\r\n2,,CAF\x00E,,,,,,\r\n'
    (tmp_path / "f.csv").write_bytes("﻿".encode() + body.encode() + b"3,,\xff,,,,,,20\r\n")
    got = listing.read_listing(spark, str(tmp_path / "f.csv")).orderBy("row_seq").collect()
    assert [r["id_produit"] for r in got] == ["1", "2", "3"]
    assert got[0]["nom"] == 'COCA, "ZERO"\nX' and got[1]["nom"] == "CAFE" and got[1]["tva"] == "" and got[2]["nom"] == "�"
    (tmp_path / "bad.csv").write_text("a,b\n1,2\n")
    with pytest.raises(listing.SchemaError):
        listing.read_listing(spark, str(tmp_path / "bad.csv"))
    (tmp_path / "long.csv").write_text(HEADER + "\n" + "1,2,3,4,5,6,7,8,9,10\n")
    with pytest.raises(listing.SchemaError):
        listing.read_listing(spark, str(tmp_path / "long.csv"))


def test_fingerprint_and_upload(spark, tmp_path):
    import hashlib

    (tmp_path / "s_1.csv").write_text("abc")
    (tmp_path / "s_2.csv").write_text("abd")
    sha = hashlib.sha256(b"abc").hexdigest()
    assert listing.fingerprint(spark, str(tmp_path / "s_1.csv")) == sha
    assert [p.rsplit("/", 1)[1] for p in listing.find_by_fingerprint(spark, [str(tmp_path)], sha, 3)] == ["s_1.csv"]
    listing.check_upload("a.csv", "store-1")
    for name, store in (("a.txt", "s"), ("a.csv", "a b"), ("a.csv", "")):
        with pytest.raises(ValueError):
            listing.check_upload(name, store)


def test_probe_groups_by_domain(spark):
    wanted = spark.createDataFrame([("https://a/1", "a"), ("https://a/2", "a"), ("https://b/1", "b")], "url string, domain string")
    got = listing.probe(wanted, lambda domain, urls: [(u, domain == "a", "ok" if domain == "a" else "dns", 200) for u in urls], parts=2)
    assert sorted((r["url"], r["ok"]) for r in got.collect()) == [("https://a/1", True), ("https://a/2", True), ("https://b/1", False)]


def test_export(spark, rules, tmp_path):
    rec = routing.route(golden.golden_records(checked(spark, {}), rules), rules)
    sinks.export_csv(rec, str(tmp_path / "out"))
    data = next((tmp_path / "out").glob("part-*")).read_bytes()
    assert data.startswith("﻿ean,internal_code,nom,nom_origine,url_image,".encode()) and b",contenance,unite,statut,publiable,lignes_fusionnees\n" in data and b"oui" in data and b"\r" not in data
    assert '"status"' in sinks.report_json(rec)


def test_inbox_reads_a_deposit_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "shop_1.csv").write_text(HEADER + "\n1,,A,,,,,,5.5\n2,,B,,,,,,5.5\n")
    seen = []
    for more in (None, "shop2.csv"):
        if more:
            (tmp_path / "in" / more).write_text(HEADER + "\n3,,C,,,,,,5.5\n")
        q = inbox.process(spark, str(tmp_path / "in"), str(tmp_path / "state"), lambda b, _: seen.extend((r["store_id"], r["id_produit"]) for r in b.collect()))
        q.awaitTermination()
    assert sorted(seen) == [("shop", "1"), ("shop", "2"), ("shop2", "3")]


def test_rate_ties_go_to_the_rate_seen_first(spark, rules):
    df = checked(spark, {"tva": "5.5"}, {"tva": "20"}, {"nom": "NUTELLA 1K", "tva": "20"}, {"nom": "NUTELLA 1K", "tva": "5.5"}, {"nom": "NUTELLA 1K", "tva": "20"}, {"nom": "NUTELLA 1K", "tva": "5.5"})
    records = golden.golden_records(df, rules)
    asked = {r["product_key"]: r for r in routing.vat_tasks(records, golden.lineage(df)).collect()}
    held = {r["key"]: r["vat_rate"] for r in records.collect()}
    assert {k: float(r["proposed_value"]) for k, r in asked.items()} == held == {"COCA COLA 1L": 5.5, "NUTELLA 1K": 20.0}
    assert asked["NUTELLA 1K"]["context"]["sample_row_ids"] == ["r2", "r3", "r4", "r5"] and asked["NUTELLA 1K"]["context"]["total_rows"] == 4
    assert routing.vat_tasks(records).first()["context"]["sample_row_ids"] == []


def test_rows_follow_their_record_through_linking(spark):
    labels = ["TOMATE GRAPPE", "TOMATES GRAPPE", "TOMATES GRAPPE", "TOMATES GRAPPE", "POMMES GALA"]
    out = pipeline.run_pipeline(rows(spark, *[{"nom": x} for x in labels]))
    sizes = {r["key"]: r["source_rows"] for r in out.records.collect()}
    assert sizes == {"TOMATE GRAPPE": 4, "POMMES GALA": 1}
    refs = out.lineage.orderBy("key", "member_seq", "row_seq").collect()
    assert [r["row_id"] for r in refs if r["key"] == "TOMATE GRAPPE"] == ["r0", "r1", "r2", "r3"]
    assert {k: sum(r["key"] == k for r in refs) for k in sizes} == sizes


def merged(spark, products, pairs):
    kinds = "store_id string, id long, label_normalized string, source_rows long, brand string, vat_rate double, status string, publishable boolean"
    made = spark.createDataFrame([("s", k, f"P{k}", n, brand, rate, "VALIDATED", True) for k, n, brand, rate in products], kinds)
    out, journal = catalogue.merge_products(made, spark.createDataFrame([("s", a, b) for a, b in pairs], "store_id string, left_id long, right_id long"))
    return made, out, journal


def test_chained_merges_lose_no_rows(spark):
    made, out, journal = merged(spark, [(1, 5, "", 5.5), (2, 9, "", 5.5), (3, 2, "", 20.0), (4, 1, "X", 5.5)], [(1, 2), (2, 3)])
    got = {r["id"]: (r["source_rows"], r["status"], r["publishable"]) for r in out.collect()}
    assert got == {2: (16, "NEEDS_REVIEW", False), 4: (1, "VALIDATED", True)}
    assert sorted((r["survivor_id"], r["absorbed"]["id"]) for r in journal.collect()) == [(2, 1), (2, 3)]
    lineage = spark.createDataFrame([("s", 1, "a"), ("s", 2, "b"), ("s", 3, "c"), ("s", 4, "d")], "store_id string, product_id long, row_id string")
    moved = {r["row_id"]: (r["product_id"], r["moved_from"]) for r in catalogue.move_lineage(lineage, journal).collect()}
    assert moved == {"a": (2, 1), "b": (2, None), "c": (2, 3), "d": (4, None)}
    assert sorted((r["label"], r["into"]) for r in catalogue.learned_merges(made, journal).collect()) == [("P1", "P2"), ("P3", "P2")]
    assert sorted((r["id"], r["source_rows"]) for r in catalogue.undo_merge(out, journal).collect()) == [(1, 5), (2, 9), (3, 2), (4, 1)]


def test_merges_are_refused_across_brands(spark):
    made, out, journal = merged(spark, [(1, 5, "a ", 5.5), (2, 9, "", 5.5), (3, 2, "B", 5.5), (4, 2, "A", 5.5), (5, 1, "", 5.5)], [(1, 2), (2, 3), (1, 4), (3, 4)])
    assert out.count() == 5 and all(r["refused"] for r in journal.collect()) and {r["source_rows"] for r in out.collect()} == {5, 9, 2, 1}
    made, out, journal = merged(spark, [(1, 5, "a ", 5.5), (4, 2, "A", 5.5), (3, 1, "B", 5.5)], [(1, 4), (4, 3)])
    assert sorted((r["id"], r["source_rows"]) for r in out.collect()) == [(1, 7), (3, 1)]


def test_decisions_that_are_refused_are_told(spark, rules):
    said = spark.createDataFrame([("s", "a", v) for v in ("5,5", "33", "x", None)], "store_id string, product_key string, value string")
    assert [r["refused"] for r in catalogue.judged_decisions(said, rules).collect()] == [False, True, True, True]
    p = spark.createDataFrame([("s", "a", 33.0)], "store_id string, product_key string, vat_rate double")
    assert [(r["old_value"], r["new_value"], r["author"], r["user_id"]) for r in catalogue.human_corrections(p, said, rules, "u").collect()] == [("33.0", "5.5", "HUMAN", "u")]


def test_empty_proposals_keep_the_label_and_brands_are_recorded(spark, rules):
    df = rows(spark, {"nom": "A"}, {"nom": "B"}, {"nom": "C"}, {"nom": "D"})
    answers = spark.createDataFrame([("A", "  ", " ACME ", 0.95), ("B", "NEW", "ACME", 0.1), ("c", "NEW C", None, 0.9), ("C", "OLD C", "X", 0.85), ("C", "SURE C", "Y", 0.9)], "source string, label string, brand string, confidence double")
    got = [(r["nom_enrichi"], r["brand"], r["llm_confidence"], len(r["corrections"])) for r in steps.enrich(df, rules, answers).orderBy("row_seq").collect()]
    assert got == [("A", "ACME", 0.95, 0), ("B", "ACME", 0.1, 0), ("SURE C", "Y", 0.9, 1), ("D", "", 0.0, 0)]


class Capitals:
    """Answers every label, and remembers what it was asked."""

    def __init__(self):
        self.asked = []

    def answer(self, labels):
        self.asked.append(sorted(r["label"] for r in labels.collect()))
        return labels.select(F.col("label").alias("source"), F.concat(F.lit("THE "), "label").alias("label"), F.lit("ACME").alias("brand"), F.lit(0.9).alias("confidence"))


def test_enrichment_run_asks_each_label_once(spark, rules):
    cache = spark.createDataFrame([], "cache_key string, model string, source string, label string, brand string, confidence double, hits long")
    df, model, price = rows(spark, *[{"nom": f"L{k % 7}"} for k in range(21)], {"nom": " "}), Capitals(), enrichment.Price(5.0, 25.0)
    ceiling = enrichment.Ceiling(max_calls=2)
    first = enrichment.run(df, model, cache, rules, "m", price, ceiling, size=3)
    assert model.asked == [[f"L{k}" for k in range(6)]] and ceiling.queued == 1
    assert first.counters.first().asDict() == {"distinct_labels": 7, "labels_from_cache": 0, "labels_answered": 6, "calls": 2, "queued": 1}
    again = enrichment.run(df, model, first.cache, rules, "m", price, enrichment.Ceiling(), size=3)
    assert model.asked[1] == ["L6"] and again.counters.first()["labels_from_cache"] == 6
    assert {(r["nom"], r["nom_enrichi"]) for r in again.rows.collect()} == {(f"L{k}", f"THE L{k}") for k in range(7)} | {(" ", " ")}
    assert sorted((r["source"], r["hits"]) for r in again.cache.collect()) == [(f"L{k}", int(k < 6)) for k in range(7)]
    other = enrichment.run(df, model, again.cache, rules, "n", price, enrichment.Ceiling(max_cost_usd=0.0), size=3)
    assert model.asked[2] == [] and other.counters.first()["queued"] == 7


def test_ranks_over_partitions(spark):
    df = spark.range(0, 1000, 1, 7).select((F.col("id") * 7919 % 1009).alias("x"), F.lit("n").alias("name"))
    got = ranked(df, "rn", F.desc("x")).orderBy("rn").collect()
    assert [r["rn"] for r in got] == list(range(1, 1001)) and [r["x"] for r in got] == sorted((r["x"] for r in got), reverse=True)
    assert ranked(df.where("1 = 0"), "rn", "x").count() == 0


def test_reads(spark):
    p = spark.createDataFrame([("s", "50% OFF", True, 2, 1), ("s", "500 off", False, 3, 2), ("t", None, True, 1, 3)], "store_id string, label string, publishable boolean, source_rows long, updated_at long")
    assert [r["label"] for r in reads.search(p, "0% o").collect()] == ["50% OFF"] and reads.search(p).count() == 3
    assert sorted(map(tuple, reads.store_rollup(p).collect())) == [("s", 2, 1, 5, 2), ("t", 1, 1, 1, 3)]
    runs = spark.createDataFrame([(k, k // 2) for k in range(30)], "run_id long, started_at long")
    assert [r["run_id"] for r in reads.last_runs(runs).collect()] == list(range(10, 30))


def test_common_subsequence_of_short_and_long_strings(spark):
    import random

    from shelfwise.functions import similarity

    def plain(a, b):
        line = [0] * (len(b) + 1)
        for x in a:
            before = list(line)
            for j, y in enumerate(b, 1):
                line[j] = before[j - 1] + 1 if x == y else max(before[j], line[j - 1])
        return line[-1]

    r = random.Random(3)
    made = [("".join(r.choice("abcdé ") for _ in range(r.choice((0, 1, 5, 30, 61, 62, 63, 90)))), "".join(r.choice("abcdé ") for _ in range(r.choice((0, 2, 20, 62, 63, 100))))) for _ in range(150)]
    got = spark.createDataFrame(made, "a string, b string").select("a", "b", F.expr(similarity.lcs("a", "b")).alias("n"), similarity.lcs_length("a", "b").alias("m")).collect()
    assert all(x["n"] == x["m"] == plain(x["a"], x["b"]) for x in got)
    wide = spark.createDataFrame([(None, "a"), ("ab" * 3000, "ba" * 2999), ("x\0y", "x\0\0"), ("", "")], "a string, b string")
    assert sorted(r[0] for r in wide.select(similarity.lcs_length("a", "b")).collect()) == [0, 0, 2, 5998]


def test_polite_prober_and_dead_domains(spark):
    calls, pauses = [], []

    def head(address):
        calls.append(("head", address))
        if address.endswith("slow"):
            raise TimeoutError
        return 405 if "shy" in address else 404 if address.endswith("gone") else 200

    def get(address):
        calls.append(("get", address))
        return 206

    prober = listing.polite_prober(head, get, sleep=pauses.append)
    assert [r[1:] for r in prober("x", ["x/a", "x/gone", "x/slow"])] == [(True, "ok", 200), (False, "http_404", 404), (False, "timeout", None)]
    assert pauses == [0.2, 0.4]
    calls.clear()
    assert all(r[1] for r in prober("shy", ["shy/1", "shy/2"])) and calls == [("head", "shy/1"), ("get", "shy/1"), ("get", "shy/2")]
    wanted = spark.createDataFrame([("a/1", "a"), ("a/2", "a"), ("b/1", "b")], "url string, domain string")
    got = listing.probe(wanted, lambda domain, urls: [(u, True, "ok", 200) for u in urls], 2, lambda domain: domain == "a")
    assert sorted((r["url"], r["ok"], r["reason"]) for r in got.collect()) == [("a/1", True, "ok"), ("a/2", True, "ok"), ("b/1", False, "dns")]
    kept = listing.network_verdicts(spark.createDataFrame([("a", True, "ok", 200), ("b", False, "dns", None), ("c", False, "unsupported", None)], "url string, ok boolean, reason string, status_code int"))
    assert sorted(r["url"] for r in kept.collect()) == ["a", "b"]


def test_settings_come_from_the_environment():
    got = Settings.from_env({"SHELFWISE_NETWORK": "true", "SHELFWISE_MAX_CALLS": "7", "OTHER": "x"})
    assert got == Settings(network=True, max_calls=7)
    for wrong in ({"SHELFWISE_NETWORK": "maybe"}, {"SHELFWISE_MAX_CALLS": "many"}):
        with pytest.raises(ValueError):
            Settings.from_env(wrong)


def test_spend_and_tasks(spark):
    spend = spark.createDataFrame([("r0", 1, 2, 0.5)], "run_id string, at long, calls long, cost_usd double")
    runs = spark.createDataFrame([("r1", 5, 3, 0.25), ("r2", 6, 0, 9.0)], spend.schema)
    kept = catalogue.append_spend(spend, runs)
    assert tuple(catalogue.spent_since(kept, F.lit(5)).first()) == (0.25, 1) and tuple(catalogue.spent_since(kept, F.lit(9)).first()) == (0.0, 0)
    products = spark.createDataFrame([("s", "K", 1, "A"), ("s", "L", 2, "B"), ("t", "K", 3, "A")], "store_id string, product_key string, id long, label string")
    tasks = spark.createDataFrame([("s", "K", "Z"), ("s", None, "B"), ("s", "gone", "A")], "store_id string, product_key string, title string")
    assert sorted((r["title"], r["product_id"]) for r in catalogue.tasks_with_products(tasks, products).collect()) == [("A", None), ("B", 2), ("Z", 1)]


def test_deposits_keep_the_catalogue(spark, tmp_path):
    folder, state = tmp_path / "in", str(tmp_path / "catalogue")
    folder.mkdir()
    line = lambda k, name, tva="5.5": f"{k},3017620422003,{name},https://a/x,{','.join(PATH)},{tva}\n"
    spark.createDataFrame([("shop", "COCA COLA 1L", "label", "Human name")], "store_id string, product_key string, field_name string, value string").write.parquet(f"{state}/overrides")
    deposits = inbox.Deposits(state, statuses=good_statuses(spark))
    (folder / "shop_1.csv").write_text(HEADER + "\n" + line(1, "COCA COLA 1L") + line(2, "PEPSI COLA 1L") + line(3, "COCA COLA 1L"))
    (folder / "other_1.csv").write_text(HEADER + "\n" + line(9, "COCA COLA 1L"))
    inbox.process(spark, str(folder), str(tmp_path / "stream"), deposits).awaitTermination()
    held = lambda: sorted((r["store_id"], r["product_key"], r["label"], r["source_rows"], r["change"]) for r in deposits.read(spark, "products").collect())
    assert held() == [("other", "COCA COLA 1L", "COCA COLA 1L", 1, "inserted"), ("shop", "COCA COLA 1L", "Human name", 2, "inserted"), ("shop", "PEPSI COLA 1L", "PEPSI COLA 1L", 1, "inserted")]
    (folder / "shop_2.csv").write_text(HEADER + "\n" + line(4, "COCA COLA 1L") + line(5, "FANTA CITRON 2L"))
    (folder / "bad_1.csv").write_text(HEADER + "\n" + "".join(f"{k},x,,ftp://x,A,B,C,D,33\n" for k in range(5)))
    inbox.process(spark, str(folder), str(tmp_path / "stream"), deposits).awaitTermination()
    assert held() == [("other", "COCA COLA 1L", "COCA COLA 1L", 1, "inserted"), ("shop", "COCA COLA 1L", "Human name", 1, "updated"), ("shop", "FANTA CITRON 2L", "FANTA CITRON 2L", 1, "inserted")]
    routes = {r["file"].rsplit("/", 1)[-1]: (r["route"], r["rows"]) for r in deposits.read(spark, "routes").collect()}
    assert routes == {"shop_1.csv": ("processed", 3), "other_1.csv": ("processed", 1), "shop_2.csv": ("processed", 2), "bad_1.csv": ("quarantine", 5)}
    assert sorted((r["store_id"], r["row_id"]) for r in deposits.read(spark, "lineage").collect()) == [("other", "9"), ("shop", "4"), ("shop", "5")]
