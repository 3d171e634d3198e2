"""Expression tables: labels, codes, addresses, rates, similarity."""

import pytest
from pyspark.sql import functions as F

from shelfwise.config import RuleSet
from shelfwise.functions import gtin, rates, similarity, text, url


def column(spark, values, make, kind="string"):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r[1] for r in rows.select("k", make(F.col("v")).alias("x")).orderBy("k").collect()]


def test_normalize_label(spark):
    cases = {"Crème  fraîche!": "CREME FRAICHE", "coca-cola zéro 1L": "COCA COLA ZERO 1L", "": "", None: "", "Straße": "STRASSE", "¿?": ""}
    got = column(spark, list(cases), lambda c: text.normalize_label(c))
    assert got == list(cases.values())


def test_exact_accents_agree_on_latin(spark):
    words = ["École", "ñandú", "Žižek", "Łódź", "crème brûlée", "ﬁn"]
    assert column(spark, words, text.strip_accents_exact) == column(spark, words, text.strip_accents)


def test_tokens_are_whole(spark):
    got = column(spark, ["FRORIGINE ITALIA", "GIN TONIC", ""], lambda c: text.has_any_token(c, ["gin"]))
    assert got == [False, True, False]
    assert sorted(column(spark, ["a b a"], text.tokenize)[0]) == ["A", "B"]


@pytest.mark.parametrize(
    ("label", "value", "unit"),
    [("COCA 1L", 1.0, "L"), ("WHISKY 70 CL", 70.0, "CL"), ("POMMES 0,75KG", 0.75, "KG"), ("SUCRE 1K", 1.0, "KG"), ("X 250 GR", None, None), ("X 750GR", None, None), ("Y 1000MG", None, None), ("", None, None), ("2X33CL", 33.0, "CL")],
)
def test_quantity(spark, label, value, unit):
    got = column(spark, [label], text.extract_quantity)[0]
    assert (got and got["value"], got and got["unit"]) == (value, unit)


def test_suffix(spark, rules):
    got = column(spark, ["LESSIVE 2LORIGINE ITALIA", "COCA 1LFAMILY SIZE", "LESSIVE ORIGINE  ITALIA", "PLAIN", "A FAMILY SIZEORIGINE ITALIA"], lambda c: text.detach_suffix(c, rules.suffixes))
    assert [(g["label"], g["origin"], g["marketing_mention"]) for g in got] == [
        ("LESSIVE 2L", "ITALIA", None), ("COCA 1L", None, "FAMILY SIZE"), ("LESSIVE", "ITALIA", None), ("PLAIN", None, None), ("A", "ITALIA", "FAMILY SIZE"),
    ]


def test_mojibake(spark):
    spoiled = [w.encode().decode("latin-1") for w in ("CAFÉ", "crème")] + ["Ã‰PICERIE", "CRÃˆMERIE", "plain  text", None, "déjà", "«x»"]
    assert column(spark, spoiled, text.repair_mojibake) == ["CAFÉ", "crème", "ÉPICERIE", "CRÈMERIE", "plain text", "", "déjà", "«x»"]
    twice = "CAFÉ".encode().decode("cp1252").encode().decode("cp1252")
    assert text.repair_text(twice) == "CAFÉ"


def test_usd(spark):
    assert column(spark, [0.0, 0.004, 1.5, 0.045], text.format_usd, "double") == ["0,00 $", "0,0040 $", "1,50 $", "0,04 $"]


CODES = {
    "": ("missing", None), None: ("missing", None), "abc": ("invalid", "abc"), "3017620422003": ("ok", "3017620422003"), "96385074": ("ok", "96385074"), "789": ("padded", "00000789"), "790": ("not_a_gtin", "790"), "20000011": ("internal_gs1", "20000011"),
    "03017620422003": ("unpadded", "3017620422003"), "0003017620422003": ("unpadded", "3017620422003"), "3017620422004": ("invalid", "3017620422004"), "12": ("not_a_gtin", "12"), " 3017620422003 ": ("ok", "3017620422003"), "0000000000000": ("ok", "0000000000000"), "00000000000000000": ("invalid", "00000000000000000"),
}


def test_verdicts(spark):
    got = column(spark, list(CODES), gtin.verdict)
    assert [(g["status"], g["value"]) for g in got] == list(CODES.values())


def test_verdict_against_plain_python(spark):
    import random

    def valid(code):
        return sum(int(c) * (3 if k % 2 else 1) for k, c in enumerate(reversed(code))) % 10 == 0

    def plain(code):
        n, lengths = len(code), (8, 12, 13, 14)
        if n in lengths and valid(code):
            if code[0] == "2" and n != 12:
                return "internal_gs1", code
            if n == 14:
                return ("unpadded", code[1:]) if code[0] == "0" else ("gtin14", code)
            return "ok", code
        if n < 14 and valid(code):
            return "padded", code.zfill(min(x for x in lengths if x >= n))
        bare = code.lstrip("0")
        if n > 14 and valid(code) and 1 <= len(bare) <= 14 and len(bare) < n:
            return "unpadded", bare.zfill(min(x for x in lengths if x >= len(bare)))
        if n == 14 and valid(code[1:]):
            return "unpadded", code[1:]
        return ("not_a_gtin", code) if n < 8 else ("invalid", code)

    r = random.Random(4)
    codes = ["".join(r.choice("0123456789") for _ in range(r.randint(1, 18))) for _ in range(600)] + ["000" + "".join(r.choice("0123456789") for _ in range(13)) for _ in range(100)]
    got = column(spark, codes, gtin.verdict)
    assert [(g["status"], g["value"]) for g in got] == [plain(c) for c in codes]


def test_check_digit(spark):
    assert column(spark, ["301762042200", "9638507"], gtin.check_digit) == ["3", "4"]


def test_url_repair(spark):
    cases = {"htp://a.b/c": ("https://a.b/c", "scheme_typo"), "hhtp://x": ("http://x", "scheme_typo"), "www.a.b/x": ("https://www.a.b/x", "scheme_missing"), "ftp://a": ("ftp://a", None), "": ("", None), None: ("", None), " https://ok ": ("https://ok", None), "not-a-url": ("not-a-url", None)}
    got = column(spark, list(cases), url.repair)
    assert [(g["url"], g["rule"]) for g in got] == list(cases.values())
    assert column(spark, ["HTTP://Shop.X:80/p", "x"], url.domain_of) == ["shop.x:80", ""]


def test_unverified_is_not_valid(spark):
    rows = spark.createDataFrame([("https://a", None, None), ("https://a", True, "ok"), ("https://a", False, "dns"), ("ftp://a", True, "ok"), ("", None, None)], "u string, ok boolean, r string")
    got = [tuple(r[0]) for r in rows.select(url.judged(F.col("u"), F.col("ok"), F.col("r"))).collect()]
    assert got == [(False, False, None, None), (True, True, None, None), (False, True, "url_domain_unresolvable", "WARNING"), (False, True, "url_malformed", "ERROR"), (False, True, "url_missing", "WARNING")]


def test_rates(spark, rules):
    assert column(spark, ["5,5", "20%", " 2.1 ", "", "abc", "5.5d", "33", None, "10 %"], rates.parse_rate) == [5.5, 20.0, 2.1, None, None, None, 33.0, None, 10.0]
    assert column(spark, [5.5, 33.0, None], lambda c: rates.rate_anomaly(c, rules), "double") == [None, "vat_illegal_rate", "vat_missing"]


def test_paths(spark, rules):
    rows = spark.createDataFrame([("ALIMENTAIRE", "", "SODAS", "COLA"), ("ALIMENTAIRE", "BOISSONS", "SODAS", "COLA"), ("A", "", "", ""), ("A", "B", "C", "D")], "a string, b string, c string, d string")
    levels = [F.col(c) for c in "abcd"]
    shapes = [r[0] for r in rows.select(rates.path_shape(levels, rules)).collect()]
    assert shapes == ["taxonomy_gap", "complete", "taxonomy_incomplete", "taxonomy_unknown_path"]
    filled = [tuple(r) for r in rows.select(*rates.fill_gaps(levels, rules)).collect()]
    assert filled[0] == ("ALIMENTAIRE", "BOISSONS", "SODAS", "COLA") and filled[3] == ("A", "B", "C", "D")


def test_expectation_ignores_a_contradicted_category(spark, rules):
    rows = spark.createDataFrame([("WHISKY ECOSSAIS", "POMMES", 5.5), ("POMME GALA", "COLA", 5.5), ("COCA", "COLA", 10.0), ("COCA", "COLA", 20.0)], "n string, leaf string, rate double")
    t = text.tokenize(F.col("n"))
    expected = rates.expected_rate(t, F.col("leaf"), F.col("rate"), rules)
    got = [tuple(r) for r in rows.select(expected, rates.coherent(F.col("rate"), expected, F.col("leaf"), rules)).collect()]
    # a rate that the declared category accepts is coherent even where the label expects another
    assert got == [(20.0, True), (None, True), (10.0, True), (5.5, False)]


@pytest.mark.parametrize(("a", "b", "low", "high"), [("NUTELLA 750 G", "NUTELLA POT 750GR", 0.72, 0.86), ("COCA COLA ZERO 1L", "ZERO COCA COLA 1L", 0.99, 1.0), ("DOLIPRANE", "PARACETAMOL BIOGARAN", 0.0, 0.72), ("", "X", 0.0, 0.0), ("SAME", "SAME", 1.0, 1.0)])
def test_similarity(spark, a, b, low, high):
    rows = spark.createDataFrame([(a, b)], "a string, b string")
    assert low <= similarity.with_similarity(rows, "a", "b", "s").first()["s"] <= high


def test_blocking_key(spark):
    rows = spark.createDataFrame([("COLA", 1.0, "L"), ("COLA", 100.0, "CL"), ("COLA", 33.0, "CL"), (None, 1.0, "KG"), ("COLA", 0.0, "L"), ("COLA", 0.7, "L"), ("COLA", 3.0, "PCS")], "leaf string, v double, u string")
    got = [r[0] for r in rows.select(similarity.blocking_key(F.col("leaf"), F.col("v"), F.col("u"))).collect()]
    assert got == ["COLA|VOL1000", "COLA|VOL1000", "COLA|VOL330", "?|MAS1000", "COLA|?", "COLA|VOL700", "COLA|3PCS"]


def test_config_rejects_what_is_no_mapping(tmp_path):
    for name in ("taxonomy.yaml", "vat_rules.yaml", "label_suffixes.yaml"):
        (tmp_path / name).write_text("- a\n")
    with pytest.raises(ValueError):
        RuleSet.load(tmp_path)
