"""The store listing as a source: CSV scan, schema check, fingerprint, inbox names, uploads, statuses."""

from __future__ import annotations

import re
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.config import LEVELS
from shelfwise.functions import url
from shelfwise.session import settled

COLUMNS = ("id_produit", "ean", "nom", "url_image", *LEVELS, "tva")
STORE = re.compile(r"^[\w-]{1,64}$")


class SchemaError(ValueError):
    """The file lacks a required column, or a row does not fit the header."""


def schema(columns: tuple[str, ...] = COLUMNS) -> T.StructType:
    return T.StructType([*[T.StructField(c, T.StringType()) for c in columns], T.StructField("_corrupt", T.StringType())])


def header(spark: SparkSession, path: str) -> list[str]:
    first = spark.read.option("wholetext", False).text(path).limit(1).collect()
    return [c.strip().strip('"') for c in (first[0][0] if first else "").lstrip("﻿").replace("\x00", "").split(",")]


def validate(columns: list[str]) -> None:
    missing = [c for c in COLUMNS if c not in columns]
    if missing:
        raise SchemaError(f"missing columns: {', '.join(missing)}")


def read_listing(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """All columns as text, null as '', NUL characters removed, with row_seq in file order.

    A byte order mark is dropped and undecodable bytes become U+FFFD.  Rows longer than the header
    are an error if `strict`, else they are kept in `_corrupt`.
    """
    names = header(spark, path)
    validate(names)
    df = spark.read.schema(schema(tuple(names))).option("header", True).option("multiLine", True).option("escape", '"').option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").csv(path)
    df = df.withColumns({c: F.translate(F.coalesce(c, F.lit("")), "\u0000", "") for c in names})
    if strict:
        fields = F.size(F.split(F.coalesce("_corrupt", F.lit("")), '(?:"[^"]*+"|[^,"]++)*+,'))
        bad = df.where(fields > len(names)).limit(1).collect()
        if bad:
            raise SchemaError(f"a row has more fields than the header: {bad[0]['_corrupt'][:80]}")
        df = df.drop("_corrupt")
    return df.withColumn("row_seq", F.monotonically_increasing_id())


def nul_count(raw: DataFrame, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    lost = sum((F.length(c) - F.length(F.translate(c, "\u0000", "")) for c in columns), F.lit(0))
    return raw.agg(F.sum(lost).alias("nul_characters"))


def fingerprint(spark: SparkSession, path: str) -> str:
    return spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).first()[0]


def find_by_fingerprint(spark: SparkSession, folders: list[str], sha256: str, size: int) -> list[str]:
    """Files of that content; the size is compared first, so other files are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(folders)
    same = files.where(F.col("length") == size).where(F.sha2("content", 256) == sha256)
    return sorted(r[0] for r in same.select("path").collect())


def store_of(path: Column) -> Column:
    """The store that a deposited file's name begins with."""
    name = F.regexp_replace(F.element_at(F.split(path, "/"), -1), "[.]csv$", "")
    return F.substring_index(name, "_", 1)


def check_upload(filename: str, store: str) -> None:
    if not filename.lower().endswith(".csv"):
        raise ValueError("only .csv files are accepted")
    if not STORE.fullmatch(store):
        raise ValueError(f"not a store id: {store!r}")


def reports(spark: SparkSession, path: str) -> DataFrame:
    """Report files as an index; what cannot be decoded is left out."""
    df = spark.read.option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return df.where("_corrupt is null").drop("_corrupt") if "_corrupt" in df.columns else df


def to_check(listing: DataFrame, known: DataFrame, column: str = "url_image") -> DataFrame:
    """Distinct supported addresses without a known status, with their domain."""
    wanted = listing.select(F.col(column).alias("url")).where(url.is_supported(F.col("url"))).distinct()
    return wanted.join(known.select("url"), "url", "left_anti").withColumn("domain", url.domain_of(F.col("url")))


def probe(urls: DataFrame, prober, parts: int = 32, resolver=None) -> DataFrame:
    """(url, ok, reason, status_code) from `prober(domain, urls) -> rows`, called for the addresses of a domain in turn.

    The prober does the network work; there is none by default.  One domain stays in one task, so
    that its limits hold; its addresses stream through it.  With `resolver(domain) -> bool` every
    domain is resolved once, and none of the addresses of one that does not resolve is probed.
    """
    import pandas as pd

    def run(frames):
        for frame in frames:
            rows = [row for domain, group in frame.groupby("domain", sort=False) for row in prober(domain, group["url"].tolist())]
            yield pd.DataFrame(rows, columns=["url", "ok", "reason", "status_code"])

    def resolve(frames):
        for frame in frames:
            yield frame.assign(alive=[bool(resolver(d)) for d in frame["domain"]])

    verdict = "url string, ok boolean, reason string, status_code int"
    if resolver is None:
        return urls.repartition(parts, "domain").mapInPandas(run, verdict)
    domains = settled(urls.select("domain").distinct().mapInPandas(resolve, "domain string, alive boolean"))
    told = urls.join(domains, "domain")
    dead = told.where("not alive").select("url", F.lit(False).alias("ok"), F.lit("dns").alias("reason"), F.lit(None).cast("int").alias("status_code"))
    return told.where("alive").select("url", "domain").repartition(parts, "domain").mapInPandas(run, verdict).unionByName(dead)


def polite_prober(head, get, retries: int = 2, backoff: float = 0.2, sleep=time.sleep):
    """A prober from two calls `(url) -> status code`, which raise OSError where there is no answer.

    HEAD comes first; where a domain answers 403 or 405 to it, a ranged GET follows, for the rest of
    the domain at once.  Codes from 200 to 399 are good.  No answer is asked for again after a pause
    that doubles.
    """

    def prober(domain, urls):
        by_get, rows = False, []
        for address in urls:
            for turn in range(retries + 1):
                try:
                    code = get(address) if by_get else head(address)
                    if not by_get and code in (403, 405):
                        by_get, code = True, get(address)
                    rows.append((address, 200 <= code < 400, "ok" if 200 <= code < 400 else f"http_{code}", code))
                    break
                except OSError as error:
                    if turn == retries:
                        rows.append((address, False, "timeout" if isinstance(error, TimeoutError) else "network", None))
                    else:
                        sleep(backoff * 2**turn)
        return rows

    return prober


def network_verdicts(statuses: DataFrame) -> DataFrame:
    """What of a check may be kept for later runs: verdicts that an answer or its lack gave, not those of an address's form."""
    return statuses.where(F.col("ok") | F.col("status_code").isNotNull() | F.col("reason").isin("dns", "timeout", "network"))
