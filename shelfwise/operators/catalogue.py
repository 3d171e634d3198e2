"""Catalogue state: snapshot merge, lineage, overrides, human merges and their undoing, decisions.

State tables are frames; each operator returns the new version of a table, which the caller writes
by overwriting the store's partition.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfwise.config import RuleSet
from shelfwise.functions.rates import parse_rate
from shelfwise.operators.components import components
from shelfwise.session import settled

#: Fields that a person may override; the rate is not among them.
OVERRIDABLE = ("label", "ean", "internal_code", "url_image", "taxonomie_niveau_1", "taxonomie_niveau_2", "taxonomie_niveau_3", "taxonomie_niveau_4", "quantity_value", "quantity_unit", "origin")


def dedupe_keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def dedupe_keep_largest(products: DataFrame) -> DataFrame:
    """Of products with one (store_id, product_key) the one with the most rows, then the smallest id."""
    return dedupe_keep_first(products, ["store_id", "product_key"], [F.desc("source_rows"), F.col("id")])


def merge_snapshot(current: DataFrame, records: DataFrame, keys: tuple[str, ...] = ("store_id", "product_key"), order: str = "first_seq") -> DataFrame:
    """Every key of both sides with `change`: updated, inserted or retired; a repeated key in the batch keeps its first."""
    fresh = dedupe_keep_first(records, list(keys), [F.col(order)])
    values = [c for c in fresh.columns if c not in keys]
    old = current.select(*keys, F.lit(True).alias("_old"), *[F.col(c).alias(f"_old_{c}") for c in values if c in current.columns])
    new = fresh.select(*keys, F.lit(True).alias("_new"), *values)
    both = old.join(new, list(keys), "full_outer")
    change = F.when(F.col("_old").isNull(), "inserted").when(F.col("_new").isNull(), "retired").otherwise("updated")
    return both.withColumn("change", change).select(*keys, "change", *[F.when(F.col("_new"), F.col(c)).otherwise(F.col(f"_old_{c}")).alias(c) if f"_old_{c}" in both.columns else F.col(c) for c in values])


def replay_overrides(products: DataFrame, overrides: DataFrame, fields: tuple[str, ...] = ("label", "origin"), keys: tuple[str, ...] = ("store_id", "product_key")) -> DataFrame:
    """Human values last: an override wins even if its value is null."""
    picked = overrides.where(F.col("field_name").isin(*fields)).groupBy(*keys).agg(*[F.max(F.when(F.col("field_name") == f, F.struct(F.lit(1).alias("there"), F.col("value").alias("value")))).alias(f"_o_{f}") for f in fields])
    joined = products.join(picked, list(keys), "left")
    return joined.withColumns({f: F.when(F.col(f"_o_{f}").isNotNull(), F.col(f"_o_{f}.value").cast(products.schema[f].dataType)).otherwise(F.col(f)) for f in fields}).drop(*[f"_o_{f}" for f in fields])


def set_override(overrides: DataFrame, products: DataFrame, store: str, key: str, field: str, value: str | None) -> DataFrame:
    """One override a (store, key, field); the first computed value is remembered through later edits."""
    if field not in OVERRIDABLE:
        raise ValueError(f"{field} cannot be overridden")
    here = (F.col("store_id") == store) & (F.col("product_key") == key) & (F.col("field_name") == field)
    first = overrides.where(here).select("previous_value")
    computed = products.where((F.col("store_id") == store) & (F.col("product_key") == key)).select(F.col(field).cast("string").alias("computed"))
    made = computed.join(first, how="left").select(F.lit(store).alias("store_id"), F.lit(key).alias("product_key"), F.lit(field).alias("field_name"), F.lit(value).cast("string").alias("value"), F.coalesce("previous_value", "computed").alias("previous_value"))
    return overrides.where(~here).unionByName(made)


def undo_override(overrides: DataFrame, products: DataFrame, store: str, key: str, field: str) -> tuple[DataFrame, DataFrame]:
    """(overrides, products) with the computed value back."""
    here = (F.col("store_id") == store) & (F.col("product_key") == key)
    was = overrides.where(here & (F.col("field_name") == field)).select(F.struct(F.col("previous_value")).alias("_was"), F.lit(store).alias("store_id"), F.lit(key).alias("product_key"))
    back = products.join(was, ["store_id", "product_key"], "left").withColumn(field, F.when(F.col("_was").isNotNull(), F.col("_was.previous_value").cast(products.schema[field].dataType)).otherwise(F.col(field))).drop("_was")
    return overrides.where(~(here & (F.col("field_name") == field))), back


def merge_products(products: DataFrame, merges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(products, journal): the (store_id, left_id, right_id) of `merges` that hang together make one product.

    Refused where quantities or known brands differ, for a pair or anywhere in the group that pairs
    make.  The survivor has more rows, then the larger id; where rates differ it is to be reviewed
    and is not publishable.  The journal keeps each absorbed product as it was.
    """
    node = lambda i: F.to_json(F.struct("store_id", F.col(i).alias("id")))
    told = {c: F.upper(F.trim(F.col(c).cast("string"))) for c in ("quantity", "quantity_value", "quantity_unit", "brand") if c in products.columns}
    ends = products.select("store_id", "id", F.struct(*products.columns).alias("p"), F.array(*[F.when(v != "", v) for v in told.values()]).alias("told"))
    side = lambda p: ends.select("store_id", F.col("id").alias(f"{p}_id"), F.col("p").alias(p), F.col("told").alias(f"{p}_told"))
    clash = F.exists(F.zip_with("left_told", "right_told", lambda x, y: F.coalesce(x != y, F.lit(False))), lambda x: x)
    pairs = settled(merges.join(side("left"), ["store_id", "left_id"]).join(side("right"), ["store_id", "right_id"]).withColumn("clash", clash))
    linked = components(pairs.where("not clash").select(node("left_id").alias("u"), node("right_id").alias("v")))
    members = settled(linked.join(ends.withColumn("node", node("id")), "node"))
    rank = F.struct(F.col("p.source_rows"), F.col("p.id"))
    several = [F.count_distinct(F.col("told")[k]) > 1 for k in range(len(told))]
    groups = members.groupBy("root").agg(
        F.max_by("id", rank).alias("survivor_id"), F.sum("p.source_rows").alias("_rows"), (F.count_distinct("p.vat_rate") > 1).alias("_differ"), *[c.alias(f"_k{k}") for k, c in enumerate(several)]
    ).withColumn("refused", reduce(lambda x, y: x | y, [F.col(f"_k{k}") for k in range(len(told))], F.lit(False)))
    placed = members.join(groups, "root")
    wins = F.struct("left.source_rows", "left.id") > F.struct("right.source_rows", "right.id")
    journal = (
        placed.where(F.col("id") != F.col("survivor_id"))
        .select("store_id", "refused", "survivor_id", F.col("p").alias("absorbed"))
        .unionByName(pairs.where("clash").select("store_id", F.lit(True).alias("refused"), F.when(wins, F.col("left.id")).otherwise(F.col("right.id")).alias("survivor_id"), F.when(wins, F.col("right")).otherwise(F.col("left")).alias("absorbed")))
    )
    journal = settled(journal)
    gone = journal.where("not refused").select("store_id", F.col("absorbed.id").alias("id"))
    gained = placed.where((F.col("id") == F.col("survivor_id")) & ~F.col("refused")).select("store_id", "id", "_rows", "_differ")
    kept = products.join(gone, ["store_id", "id"], "left_anti").join(gained, ["store_id", "id"], "left")
    differ = F.coalesce("_differ", F.lit(False))
    changes = {"source_rows": F.coalesce("_rows", "source_rows"), "status": F.when(differ, "NEEDS_REVIEW").otherwise(F.col("status"))}
    if "publishable" in products.columns:
        changes["publishable"] = F.col("publishable") & ~differ
    return kept.withColumns(changes).select(*products.columns), journal


def move_lineage(lineage: DataFrame, journal: DataFrame) -> DataFrame:
    """`lineage` with (store_id, product_id): the rows of absorbed products point at the survivor, `moved_from` says from where."""
    to = journal.where("not refused").select("store_id", F.col("absorbed.id").alias("product_id"), "survivor_id")
    moved = lineage.join(to, ["store_id", "product_id"], "left")
    return moved.withColumns({"moved_from": F.when(F.col("survivor_id").isNotNull(), F.col("product_id")), "product_id": F.coalesce("survivor_id", "product_id")}).drop("survivor_id")


def learned_merges(products: DataFrame, journal: DataFrame) -> DataFrame:
    """(store_id, label, into): what later runs merge by themselves, one rule for each absorbed label."""
    heads = products.select("store_id", F.col("id").alias("survivor_id"), F.col("label_normalized").alias("into"))
    return journal.where("not refused").join(heads, ["store_id", "survivor_id"]).groupBy("store_id", F.col("absorbed.label_normalized").alias("label")).agg(F.max_by("into", F.col("absorbed.id")).alias("into"))


def undo_merge(products: DataFrame, journal: DataFrame) -> DataFrame:
    """The absorbed products back as they were; their rows leave the survivor, never below zero."""
    done = journal.where("not refused")
    lost = done.groupBy("store_id", F.col("survivor_id").alias("id")).agg(F.sum("absorbed.source_rows").alias("_lost"))
    left = products.join(lost, ["store_id", "id"], "left").withColumn("source_rows", F.greatest(F.lit(0), F.col("source_rows") - F.coalesce("_lost", F.lit(0)))).select(*products.columns)
    return left.unionByName(done.select("absorbed.*").select(*products.columns))


def judged_decisions(decisions: DataFrame, rules: RuleSet) -> DataFrame:
    """`decisions` with the rate that each value says and whether it is refused: unreadable, or not a legal rate."""
    rate = parse_rate(F.col("value"))
    return decisions.withColumns({"rate": rate, "refused": ~F.coalesce(rate.isin(*rules.legal_rates), F.lit(False))})


def decide(products: DataFrame, decisions: DataFrame, rules: RuleSet) -> DataFrame:
    """Applies approved or edited rates (store_id, product_key, value); a refused one, as `judged_decisions` tells, changes nothing.

    `publishable` is judged again by code, image and deepest level, as a decision does it.
    """
    legal = judged_decisions(decisions, rules).where("not refused").groupBy("store_id", "product_key").agg(F.max("rate").alias("_rate"))
    joined = products.join(legal, ["store_id", "product_key"], "left")
    hit = F.col("_rate").isNotNull()
    fine = F.coalesce((F.coalesce("ean", F.lit("")) != "") & F.col("url_ok") & (F.element_at("taxonomy", 4) != ""), F.lit(False))
    return joined.withColumns({"vat_rate": F.coalesce("_rate", "vat_rate"), "status": F.when(hit, "VALIDATED").otherwise(F.col("status")), "publishable": F.when(hit, fine).otherwise(F.col("publishable"))}).drop("_rate")


def human_corrections(products: DataFrame, decisions: DataFrame, rules: RuleSet, user: str) -> DataFrame:
    """The audit rows of applied decisions: who changed which rate from what to what."""
    now = judged_decisions(decisions, rules).where("not refused").join(products.select("store_id", "product_key", "vat_rate"), ["store_id", "product_key"])
    return now.select("store_id", "product_key", F.lit("tva").alias("field_name"), F.coalesce(F.col("vat_rate").cast("string"), F.lit("")).alias("old_value"), F.col("rate").cast("string").alias("new_value"), F.lit("HUMAN").alias("author"), F.lit("human_decision").alias("rule"), F.lit(1.0).alias("confidence"), F.lit(user).alias("user_id"))


def per_run_replace(stored: DataFrame, fresh: DataFrame, run_id: str, cap: int | None = None, order: str = "row_seq") -> DataFrame:
    """The table with the run's rows replaced; `cap` bounds what a run may store, in row order."""
    mine = fresh if cap is None else fresh.orderBy(order).limit(cap)
    return stored.where(F.col("run_id") != run_id).unionByName(mine, allowMissingColumns=True)


def keep_latest(old: DataFrame, new: DataFrame, key: str, at: str) -> DataFrame:
    """Upsert: of each key the row with the latest time."""
    return dedupe_keep_first(old.unionByName(new), [key], [F.desc(at)])


def fresh_within(cache: DataFrame, at: str, now: Column, hours: int) -> DataFrame:
    return cache.where(F.col(at) >= now - F.expr(f"INTERVAL {hours} HOURS"))


def bump_hits(cache: DataFrame, used: DataFrame, key: str = "cache_key") -> DataFrame:
    """Cache rows with one more hit where used again; unknown keys are added."""
    again = used.select(key).distinct().withColumn("_hit", F.lit(1))
    counted = cache.join(again, key, "left").withColumn("hits", F.col("hits") + F.coalesce("_hit", F.lit(0))).drop("_hit")
    return counted.unionByName(used.dropDuplicates([key]).join(cache.select(key), key, "left_anti").withColumn("hits", F.lit(0)), allowMissingColumns=True)


def lookup_previous_run(runs: DataFrame, store: str, sha256: str) -> DataFrame:
    """An earlier deposit of the same file that still counts; the statuses are fixed values."""
    return runs.where((F.col("store_id") == store) & (F.col("file_sha256") == sha256) & F.col("status").isin("COMPLETED", "RUNNING", "QUARANTINE"))


def sweep_orphans(runs: DataFrame) -> DataFrame:
    return runs.withColumn("status", F.when(F.col("status") == "RUNNING", "FAILED").otherwise(F.col("status")))


def append_spend(spend: DataFrame, run: DataFrame) -> DataFrame:
    """`spend` with the (run_id, at, calls, cost_usd) of runs that made calls."""
    return spend.unionByName(run.where("calls > 0").select(*spend.columns))


def spent_since(spend: DataFrame, since: Column) -> DataFrame:
    """One row: what was spent and in how many runs since a time; zeros where there is none."""
    return spend.where(F.col("at") >= since).agg(F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("spent_usd"), F.count(F.lit(1)).alias("runs"))


def tasks_with_products(tasks: DataFrame, products: DataFrame) -> DataFrame:
    """Each task with the id of its product: by its key, else, for a task without one, by its title as the label."""
    by_key = products.select("store_id", "product_key", F.col("id").alias("_by_key"))
    by_label = products.groupBy("store_id", F.col("label").alias("title")).agg(F.min("id").alias("_by_label"))
    found = tasks.join(by_key, ["store_id", "product_key"], "left").join(by_label, ["store_id", "title"], "left")
    return found.withColumn("product_id", F.when(F.col("product_key").isNotNull(), F.col("_by_key")).otherwise(F.col("_by_label"))).drop("_by_key", "_by_label")
