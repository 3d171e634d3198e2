"""Label expressions: accents, canonical form, tokens, quantities, suffixes, encoding repair."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.config import Suffix


@cache
def _accent_table() -> tuple[str, str, dict[str, str]]:
    """(from, to) for letters that decompose to one character, and the longer cases, over the Latin blocks."""
    source, target, longer = "", "", {}
    for code in [*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00), *range(0xFB00, 0xFB07)]:
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if plain == chr(code):
            continue
        if len(plain) == 1:
            source, target = source + chr(code), target + plain
        else:
            longer[chr(code)] = plain
    return source, target, longer


def strip_accents(text: Column) -> Column:
    """Latin letters without accents, in the JVM; combining marks go."""
    source, target, longer = _accent_table()
    out = F.translate(F.regexp_replace(text, "\\p{Mn}+", ""), source, target)
    for letter, plain in longer.items():
        if letter in "ßÆæŒœﬁﬂĲĳ":
            out = F.replace(out, F.lit(letter), F.lit(plain))
    return out


@F.pandas_udf(T.StringType())
def strip_accents_exact(text: pd.Series) -> pd.Series:
    """Full compatibility decomposition for any script, in Arrow batches."""
    return text.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)))


def normalize_label(text: Column) -> Column:
    """Accents off, upper case, everything but A-Z and 0-9 one space; null gives ''."""
    return F.trim(F.regexp_replace(F.upper(strip_accents(F.coalesce(text, F.lit("")))), "[^A-Z0-9]+", " "))


def tokenize(text: Column) -> Column:
    """Distinct tokens of the canonical form; no token for an empty label."""
    return F.array_distinct(F.filter(F.split(normalize_label(text), " "), lambda t: t != ""))


def has_any_token(text: Column, tokens: Iterable[str]) -> Column:
    """Whether a keyword is one of the label's whole tokens."""
    return F.arrays_overlap(tokenize(text), F.array(*[normalize_label(F.lit(t)) for t in tokens]))


def squash(text: Column) -> Column:
    """White space collapsed, upper case; accents stay."""
    return F.upper(collapse(text))


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "\\s+", " "))


def strip_all(text: Column) -> Column:
    """Both ends without any white space."""
    return F.btrim(text, F.lit(" \t\n\x0b\f\r"))


QUANTITY = "(\\d+(?:[.,]\\d+)?)\\s*(KG|CL|ML|L|G|K)\\b"


def extract_quantity(text: Column) -> Column:
    """struct<value double, unit string> of the first quantity in a label, or null."""
    kept = F.trim(F.regexp_replace(F.upper(strip_accents(F.coalesce(text, F.lit("")))), "[^A-Z0-9.,]+", " "))
    unit = F.regexp_extract(kept, QUANTITY, 2)
    value = F.replace(F.regexp_extract(kept, QUANTITY, 1), F.lit(","), F.lit(".")).try_cast("double")
    return F.when(unit != "", F.struct(value.alias("value"), F.when(unit == "K", "KG").otherwise(unit).alias("unit")))


def detach_suffix(label: Column, suffixes: Iterable[Suffix]) -> Column:
    """struct<label, origin, marketing_mention>: known glued suffixes cut off, in the list's order."""
    out, found = label, {"origin": F.lit(None).cast("string"), "marketing_mention": F.lit(None).cast("string")}
    for suffix in suffixes:
        tail = "\\s*".join(suffix.value.replace(" ", ""))
        hit = out.rlike(f"{tail}\\s*$")
        found[suffix.target_field] = F.when(hit, F.lit(suffix.extracted_value)).otherwise(found[suffix.target_field])
        out = F.when(hit, strip_all(F.regexp_replace(out, f"{tail}\\s*$", ""))).otherwise(out)
    return F.struct(out.alias("label"), *[c.alias(n) for n, c in found.items()])


_QUOTES = {"‘": "'", "’": "'", "‚": "'", "‛": "'", "“": '"', "”": '"', "„": '"', "‟": '"'}
_SIGNS = ("Ã", "Â", "â€", "Å", "Ð", "Î", "Ï", "ï»¿")


def _bytes_of(text: str) -> bytes | None:
    """The text as Windows-1252, with Latin-1 where that has no character; None if neither has."""
    out = bytearray()
    for c in text:
        try:
            out += c.encode("cp1252")
        except UnicodeEncodeError:
            if ord(c) > 255:
                return None
            out.append(ord(c))
    return bytes(out)


def repair_text(text: str | None) -> str:
    """Undoes UTF-8 read as Windows-1252 (also repeatedly), composes, straightens quotes, drops control characters."""
    if text is None:
        return ""
    for _ in range(4):
        if not any(s in text for s in _SIGNS):
            break
        raw = _bytes_of(text)
        if raw is None:
            break
        try:
            better = raw.decode("utf-8")
        except UnicodeDecodeError:
            break
        if better == text:
            break
        text = better
    text = "".join(_QUOTES.get(c, c) for c in text)
    text = "".join(unicodedata.normalize("NFKC", c) if "！" <= c <= "～" or "ﬀ" <= c <= "ﬆ" else c for c in text)
    text = "".join(c for c in text if c in "\t\n\r" or unicodedata.category(c) != "Cc")
    return " ".join(unicodedata.normalize("NFC", text).split())


@F.pandas_udf(T.StringType())
def _repair(text: pd.Series) -> pd.Series:
    memo = {t: repair_text(t) for t in text.unique()}
    return text.map(memo, na_action=None).fillna("")


def repair_mojibake(text: Column) -> Column:
    """`repair_text` where a character outside printable ASCII calls for it; other texts stay in the JVM."""
    plain = collapse(text)
    return F.when(F.coalesce(text, F.lit("")).rlike("[^\\x20-\\x7E]"), _repair(text)).otherwise(plain)


def cache_key(*parts: Column | str) -> Column:
    """SHA-256 of the parts joined by NUL."""
    return F.sha2(F.concat_ws("\u0000", *[F.lit(p) if isinstance(p, str) else p for p in parts]), 256)


def format_usd(amount: Column) -> Column:
    """Two decimals, four below a cent, decimal comma."""
    said = lambda pattern: F.call_function("format_number", amount, F.lit(pattern))  # noqa: E731  rounds the binary value half to even
    text = F.when(amount == 0, "0.00").when(amount < 0.01, said("0.0000")).otherwise(said("0.00"))
    return F.concat(F.translate(text, ".", ","), F.lit(" $"))


def render_path(levels: Iterable[Column]) -> Column:
    """'A > ? > C': missing levels as question marks."""
    return F.concat_ws(" > ", *[F.when(F.coalesce(c, F.lit("")) == "", "?").otherwise(c) for c in levels])
