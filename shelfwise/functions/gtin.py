"""Retail codes: the GS1 checksum, the verdict on a raw code, where the code goes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfwise.functions.text import strip_all

LENGTHS = (8, 12, 13, 14)
#: Verdict -> (anomaly code, severity); ok has none.
ANOMALIES = {
    "missing": ("ean_missing", "WARNING"),
    "padded": ("ean_padded", "INFO"),
    "unpadded": ("ean_unpadded", "INFO"),
    "not_a_gtin": ("ean_not_a_gtin", "WARNING"),
    "internal_gs1": ("ean_internal_gs1", "INFO"),
    "gtin14": ("ean_gtin14", "WARNING"),
    "invalid": ("ean_invalid", "ERROR"),
}


def weighted_sum(code: Column, odd: int = 1) -> Column:
    """Sum of digits from the right with weights 1, 3, 1, ...; starting at 3 for a body without check digit."""
    digits = F.split(F.reverse(code), "")
    even = 4 - odd
    weighted = F.transform(digits, lambda c, i: F.coalesce(c.try_cast("int"), F.lit(0)) * F.when(i % 2 == 1, even).otherwise(odd))
    return F.aggregate(weighted, F.lit(0), lambda a, x: a + x)


def is_digits(code: Column) -> Column:
    return code.rlike("^[0-9]+$")


def checksum_valid(code: Column) -> Column:
    return F.coalesce(is_digits(code) & F.length(code).isin(*LENGTHS) & (weighted_sum(code) % 10 == 0), F.lit(False))


def is_internal(code: Column) -> Column:
    """In-store number ranges: 8, 13 or 14 digits that begin with 2."""
    return F.coalesce(F.length(code).isin(8, 13, 14) & code.startswith("2"), F.lit(False))


def check_digit(body: Column) -> Column:
    return ((10 - weighted_sum(body, odd=3) % 10) % 10).cast("string")


def _fit(code: Column, length: Column) -> Column:
    """Left-padded with zeros to the smallest legal length that holds `length` digits."""
    return F.when(length <= 8, F.lpad(code, 8, "0")).when(length <= 12, F.lpad(code, 12, "0")).when(length <= 13, F.lpad(code, 13, "0")).otherwise(F.lpad(code, 14, "0"))


def verdict(raw: Column) -> Column:
    """struct<status, value>: missing, invalid, internal_gs1, unpadded, gtin14, ok, padded or not_a_gtin.

    Leading zeros do not change the weighted sum, so one sum serves every repaired length.
    """
    code = strip_all(F.coalesce(raw, F.lit("")))
    # A bound row: the sum is asked for in most branches and shall be computed once.
    known = F.struct(code.alias("code"), F.coalesce(weighted_sum(code) % 10 == 0, F.lit(False)).alias("even"))
    return F.get(F.transform(F.array(known), lambda row: _judged(row["code"], row["even"])), F.lit(0))


def _judged(code: Column, even: Column) -> Column:
    n = F.length(code)
    tail, bare = F.substring(code, 2, 13), F.ltrim(code, F.lit("0"))
    m = F.length(bare)
    legal = n.isin(*LENGTHS)

    def say(status: str, value: Column) -> Column:
        return F.struct(F.lit(status).alias("status"), value.alias("value"))

    return (
        F.when(code == "", say("missing", F.lit(None).cast("string")))
        .when(~is_digits(code), say("invalid", code))
        .when(even & legal & is_internal(code), say("internal_gs1", code))
        .when(even & (n == 14) & code.startswith("0"), say("unpadded", tail))
        .when(even & (n == 14), say("gtin14", code))
        .when(even & legal, say("ok", code))
        .when(even & (n < 14), say("padded", _fit(code, n)))
        .when(even & (m >= 1) & (m <= 14) & (m < n), say("unpadded", _fit(bare, m)))
        .when(even, say("invalid", code))
        .when((n == 14) & (weighted_sum(tail) % 10 == 0), say("unpadded", tail))
        .when(n < 8, say("not_a_gtin", code))
        .otherwise(say("invalid", code))
    )


def routed(judged: Column) -> Column:
    """struct<ean, internal_code, ean_valid> of a verdict."""
    status, value = judged["status"], judged["value"]
    blank = F.lit("")
    return F.struct(
        F.when(status.isin("ok", "padded", "unpadded", "gtin14"), value).otherwise(blank).alias("ean"),
        F.when(status.isin("internal_gs1", "not_a_gtin"), value).otherwise(blank).alias("internal_code"),
        status.isin("ok", "padded", "unpadded").alias("ean_valid"),
    )


def anomaly(judged: Column) -> Column:
    """struct<code, severity> of a verdict; null for ok."""
    out = F.lit(None).cast("struct<code:string,severity:string>")
    for status, (code, severity) in ANOMALIES.items():
        out = F.when(judged["status"] == status, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"))).otherwise(out)
    return out
