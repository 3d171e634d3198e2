"""Reads over the catalogue's tables: search, store sums, row lookup, audit trail, dashboard, run history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def search(products: DataFrame, text: str | None = None, field: str = "label", equal: dict[str, str] | None = None, among: dict[str, list[str]] | None = None, prefix: dict[str, str] | None = None) -> DataFrame:
    """Products whose `field` holds `text` in any case and whose other fields are equal, among the given, or begin so.

    The signs % and _ of `text` mean themselves.  What is not given does not restrict.
    """
    out = products
    if text:
        out = out.where(F.contains(F.lower(F.col(field)), F.lit(text.lower())))
    for name, value in (equal or {}).items():
        out = out.where(F.col(name) == value)
    for name, values in (among or {}).items():
        out = out.where(F.col(name).isin(*values))
    for name, start in (prefix or {}).items():
        out = out.where(F.col(name).startswith(start))
    return out


def store_rollup(products: DataFrame) -> DataFrame:
    """A row for each store: products, publishable ones, source rows, last change."""
    return products.groupBy("store_id").agg(F.count(F.lit(1)).alias("products"), F.count_if("publishable").alias("publishable"), F.sum("source_rows").alias("source_rows"), F.max("updated_at").alias("updated_at"))


def row_lookup(source_rows: DataFrame, products: DataFrame, stores: DataFrame, store: object) -> DataFrame:
    """A store's rows with the product and the store that they belong to."""
    return source_rows.where(F.col("store_id") == store).join(products, "product_id").join(stores, "store_id")


def audit(corrections: DataFrame, runs: DataFrame, products: DataFrame, users: DataFrame, author: str | None = None) -> DataFrame:
    """Corrections with run, product and user where there are any; a correction without a product has its run's."""
    mine = corrections if author is None else corrections.where(F.col("author") == author)
    joined = mine.join(runs.withColumnRenamed("product_id", "_of_run"), "run_id", "left").withColumn("product_id", F.coalesce("product_id", "_of_run")).drop("_of_run")
    return joined.join(products, "product_id", "left").join(users, "user_id", "left")


def dashboard(runs: DataFrame, since: Column, pending: Column, publishable: Column, store: str = "store_id", at: str = "started_at") -> DataFrame:
    """One row: runs, runs since a time, pending ones, stores, share of publishable ones."""
    rate = F.coalesce(F.try_divide(F.count_if(publishable), F.count(F.lit(1))), F.lit(0.0))
    return runs.agg(F.count(F.lit(1)).alias("total_runs"), F.count_if(F.col(at) >= since).alias("recent_runs"), F.count_if(pending).alias("pending"), F.count_distinct(store).alias("stores"), F.round(rate, 6).alias("publishable_rate"))


def last_runs(runs: DataFrame, at: str = "started_at", key: str = "run_id", n: int = 20) -> DataFrame:
    """The latest `n` runs, oldest first; a report of fixed length."""
    return runs.orderBy(F.desc(at), F.desc(key)).limit(n).orderBy(at, key)


def run_summary(corrections: DataFrame, products: DataFrame, authors: tuple[str, ...] = ("RULE", "LLM", "HUMAN")) -> DataFrame:
    """A row for each run: corrections by author, publishable products, source rows."""
    by = corrections.groupBy("run_id").pivot("author", list(authors)).agg(F.count(F.lit(1)))
    totals = products.groupBy("run_id").agg(F.count_if("publishable").alias("publishable"), F.sum("source_rows").alias("source_rows"))
    return by.join(totals, "run_id", "full_outer").select("run_id", *[F.coalesce(F.col(a), F.lit(0)).alias(a.lower()) for a in authors], F.coalesce("publishable", F.lit(0)).alias("publishable"), "source_rows")


def merged_counts(runs: DataFrame, counts: str = "anomalies_by_code", at: str = "started_at", n: int = 5) -> DataFrame:
    """(code, n): the counts of the latest `n` runs, added up by code."""
    return runs.orderBy(F.desc(at)).limit(n).select(F.explode(counts).alias("code", "n")).groupBy("code").agg(F.sum("n").alias("n"))
