"""Image addresses: repair, support, domain and the verdict from known statuses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfwise.functions.text import strip_all

#: Scheme typo -> scheme.
SCHEME_TYPOS = {"htp": "https", "htps": "https", "hhtp": "http", "htttp": "http"}
_SCHEME = "^([A-Za-z][A-Za-z0-9+.-]*):"


def repair(raw: Column) -> Column:
    """struct<url, rule>: misspelt schemes and a missing one before www.; rule is null where nothing changed."""
    value = strip_all(F.coalesce(raw, F.lit("")))
    scheme = F.lower(F.regexp_extract(value, _SCHEME, 1))
    rest = F.regexp_replace(value, _SCHEME, "")
    fixed = F.lit(None).cast("string")
    for typo, right in SCHEME_TYPOS.items():
        fixed = F.when(scheme == typo, right).otherwise(fixed)
    missing = (scheme == "") & value.startswith("www.")
    return F.struct(
        F.when(fixed.isNotNull(), F.concat(fixed, F.lit(":"), rest)).when(missing, F.concat(F.lit("https://"), value)).otherwise(value).alias("url"),
        F.when(fixed.isNotNull(), "scheme_typo").when(missing, "scheme_missing").alias("rule"),
    )


def is_supported(url: Column) -> Column:
    return F.lower(url).rlike("^https?:")


def domain_of(url: Column) -> Column:
    """Host, port and user part in lower case; '' without one."""
    return F.lower(F.regexp_extract(url, "^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1))


def judged(url: Column, ok: Column, reason: Column) -> Column:
    """struct<url_ok, url_checked, code, severity>; `ok` is null where no status is known.

    Unverified is not valid: without a status the address is neither ok nor checked, and no anomaly
    is raised.
    """

    def say(fine: bool, checked: bool, code: str | None, severity: str | None) -> Column:
        return F.struct(F.lit(fine).alias("url_ok"), F.lit(checked).alias("url_checked"), F.lit(code).cast("string").alias("code"), F.lit(severity).cast("string").alias("severity"))

    return (
        F.when(url == "", say(False, True, "url_missing", "WARNING"))
        .when(~is_supported(url), say(False, True, "url_malformed", "ERROR"))
        .when(ok.isNull(), say(False, False, None, None))
        .when(ok, say(True, True, None, None))
        .when(reason == "dns", say(False, True, "url_domain_unresolvable", "WARNING"))
        .otherwise(say(False, True, "url_unreachable", "WARNING"))
    )
