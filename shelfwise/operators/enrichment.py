"""The enrichment stage around a pluggable model: distinct labels, cache, batches, cost, ceilings."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.config import RuleSet
from shelfwise.functions.text import cache_key
from shelfwise.operators import steps
from shelfwise.operators.catalogue import bump_hits
from shelfwise.operators.ranking import ranked
from shelfwise.session import settled

#: Multipliers on the input price, and for asynchronous batches.
CACHE_READ, CACHE_WRITE, BATCH = 0.10, 1.25, 0.5
BATCH_SIZE, OUTPUT_TOKENS, CHARS_PER_TOKEN = 25, 60, 4


class Enricher(Protocol):
    """Answers labels: a frame of (label) in, a frame of (source, label, brand, confidence) out."""

    def answer(self, labels: DataFrame) -> DataFrame: ...


@dataclass(frozen=True)
class Price:
    """Dollars for a million tokens."""

    input_per_mtok: float
    output_per_mtok: float


def distinct_labels(df: DataFrame, column: str = "nom") -> DataFrame:
    """(label, first_seq, rows): each label once, in order of its first row."""
    return df.where(F.trim(F.coalesce(column, F.lit(""))) != "").groupBy(F.col(column).alias("label")).agg(F.min("row_seq").alias("first_seq"), F.count(F.lit(1)).alias("rows"))


def not_cached(labels: DataFrame, cache: DataFrame, key: Column) -> DataFrame:
    return labels.withColumn("cache_key", key).join(cache.select("cache_key"), "cache_key", "left_anti")


def batches(labels: DataFrame, size: int = BATCH_SIZE) -> DataFrame:
    """(batch, labels): consecutive runs of `size` labels in order of their first row."""
    numbered = ranked(labels.select("label", "first_seq"), "rn", "first_seq", "label")
    return numbered.groupBy(F.floor((F.col("rn") - 1) / size).alias("batch")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "label"))), lambda x: x["label"]).alias("labels"))


def cost(price: Price, input_tokens: Column, output_tokens: Column, cache_read: Column, cache_write: Column, batch: bool = False) -> Column:
    """struct<input_usd, output_usd, cache_read_usd, cache_write_usd, total_usd>."""
    discount = BATCH if batch else 1.0
    per_in, per_out = price.input_per_mtok / 1_000_000 * discount, price.output_per_mtok / 1_000_000 * discount
    parts = {"input_usd": input_tokens * per_in, "output_usd": output_tokens * per_out, "cache_read_usd": cache_read * per_in * CACHE_READ, "cache_write_usd": cache_write * per_in * CACHE_WRITE}
    total = parts["input_usd"] + parts["output_usd"] + parts["cache_read_usd"] + parts["cache_write_usd"]
    return F.struct(*[c.alias(n) for n, c in parts.items()], total.alias("total_usd"))


def dry_run(df: DataFrame, price: Price, prompt_chars: int = 1200, size: int = BATCH_SIZE) -> DataFrame:
    """What a run would cost before it is made, beside the same labels one by one and the same batches without deduplication."""
    counted = distinct_labels(df).agg(F.count(F.lit(1)).alias("distinct_labels"), F.coalesce(F.sum("rows"), F.lit(0)).alias("labels"), F.coalesce(F.sum(F.length("label")), F.lit(0)).alias("chars"), F.coalesce(F.sum(F.length("label") * F.col("rows")), F.lit(0)).alias("all_chars"))
    system = prompt_chars // CHARS_PER_TOKEN
    calls = F.ceil(F.col("distinct_labels") / size)
    tokens = lambda prompts, chars: prompts * system + F.floor(F.col(chars) / CHARS_PER_TOKEN)
    tokens_in, tokens_out = tokens(calls, "chars"), F.col("distinct_labels") * OUTPUT_TOKENS
    usd = lambda i, o: F.round(i * (price.input_per_mtok / 1e6) + o * (price.output_per_mtok / 1e6), 4)
    return counted.join(df.agg(F.count(F.lit(1)).alias("rows_in"))).select(
        "rows_in", "distinct_labels", F.round(F.col("rows_in") / F.greatest("distinct_labels", F.lit(1)), 1).alias("dedup_factor"), calls.alias("calls"), tokens_in.alias("input_tokens"), tokens_out.alias("output_tokens"),
        usd(tokens_in, tokens_out).alias("cost_usd"), usd(tokens(F.col("distinct_labels"), "chars"), tokens_out).alias("cost_without_batching_usd"), usd(tokens(F.ceil(F.col("labels") / size), "all_chars"), F.col("labels") * OUTPUT_TOKENS).alias("cost_without_dedup_usd"),
    )


@dataclass
class Ceiling:
    """Stops a run's calls at a number or a sum; what is not sent is queued."""

    max_calls: int = 500
    max_cost_usd: float = 5.0
    calls: int = 0
    spent_usd: float = 0.0
    queued: int = 0

    def allows(self) -> bool:
        return self.calls < self.max_calls and self.spent_usd < self.max_cost_usd

    def charge(self, usd: float) -> None:
        self.calls, self.spent_usd = self.calls + 1, self.spent_usd + usd


def reserve(configured: float, limit: float, spent: float, reserved: float) -> float:
    """What a run may spend: its own ceiling or what the budget has left."""
    return max(0.0, min(max(configured, 0.0), limit - spent - reserved))


@dataclass
class Run:
    """Enriched rows, the answers used, the cache to keep, and one row of counters."""

    rows: DataFrame
    answers: DataFrame
    cache: DataFrame
    counters: DataFrame


def run(df: DataFrame, enricher: Enricher, cache: DataFrame, rules: RuleSet, model: str, price: Price, ceiling: Ceiling, scope: str = "llm_enrich.v1", size: int = BATCH_SIZE, prompt_chars: int = 1200) -> Run:
    """Distinct labels, those in the cache answered from it, the others sent in batches up to the ceiling, answers applied.

    `cache` has (cache_key, model, source, label, brand, confidence, hits); only rows of this model
    answer.  A batch is charged by its estimate before it is sent; labels beyond the ceiling are
    queued and keep their own label.  Which labels are sent depends on row order only.
    """
    key = cache_key(scope, model, F.col("label"))
    labels = settled(distinct_labels(df).withColumn("cache_key", key))
    known = cache.where(F.col("model") == model)
    missing = settled(batches(not_cached(labels, known, key), size))
    per_call = (prompt_chars // CHARS_PER_TOKEN) * price.input_per_mtok / 1e6 + size * OUTPUT_TOKENS * price.output_per_mtok / 1e6
    sent = 0
    while sent < missing.count() and ceiling.allows():
        ceiling.charge(per_call)
        sent += 1
    flat = missing.select("batch", F.explode("labels").alias("label"))
    fresh = settled(enricher.answer(flat.where(F.col("batch") < sent).select("label")).select("source", "label", "brand", "confidence"))
    hit = known.join(labels.select("cache_key"), "cache_key", "left_semi")
    answers = hit.select("source", "label", "brand", "confidence").unionByName(fresh)
    new_keys = fresh.withColumn("cache_key", cache_key(scope, model, F.col("source"))).withColumn("model", F.lit(model))
    used = hit.drop("hits").unionByName(new_keys.select(*[c for c in cache.columns if c != "hits"]))
    ceiling.queued = flat.where(F.col("batch") >= sent).count()
    counters = labels.agg(F.count(F.lit(1)).alias("distinct_labels")).join(hit.agg(F.count(F.lit(1)).alias("labels_from_cache"))).join(fresh.agg(F.count(F.lit(1)).alias("labels_answered"))).withColumns({"calls": F.lit(sent), "queued": F.lit(ceiling.queued)})
    return Run(steps.enrich(df, rules, answers, model), answers, bump_hits(cache, used), counters)
