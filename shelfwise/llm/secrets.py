"""Secret scans with an incremental blob ledger, in DataFrame operations only.

Every version of every path is content-addressed: its text's SHA-256 names a blob.  The ledger
holds, for each blob and rule version that has been scanned, the findings (none included).  A run
scans only the (blob, rule version) pairs that the ledger lacks, each once however many paths hold
the blob, and joins the findings back to all paths.  `update` keeps the ledger as a Parquet table
and appends to it; a second run over the same versions scans nothing.

Findings of blobs that many paths hold are broadcast to those paths, the others meet by a shuffle.

A rule's pattern is applied once to split a text and once to extract its matches; the lengths of
gaps and matches, added up, are the spans.  Offsets count code points, the end is exclusive.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm._common import ensure_checkpoint_dir, settled, table


@dataclass(frozen=True)
class Rule:
    """A kind of secret.  Matches are leftmost and do not overlap; those whose `group` has fewer than `least` characters are dropped."""

    kind: str
    pattern: str
    group: int
    least: int
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


RULES = (
    Rule("assign", "(?i)(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    Rule("access", "AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", "[0-9a-f]{32,}", 0, 32),
)

FINDINGS = "array<struct<start:int,stop:int>>"
LEDGER = f"blob string, rule string, spans {FINDINGS}"
#: Matches whose spans are added up at a time.
BLOCK = 128
#: A blob is held by many paths if they are more than one in so many of all, so there are fewer such blobs.
HEAVY_SHARE = 1000


def findings(text: Column, rule: Rule) -> Column:
    """The rule's spans in the text, in order."""
    gaps = F.split(text, rule.pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else whole
    zipped = F.zip_with(F.slice(gaps, F.lit(1), F.size(whole)), F.arrays_zip(whole.alias("w"), part.alias("p")), lambda g, m: F.struct(F.length(g).alias("g"), F.length(m["w"]).alias("w"), F.length(m["p"]).alias("p")))
    none = F.expr(f"cast(array() as {FINDINGS})")

    def step(state: Column, m: Column) -> Column:
        begin = state["at"] + m["g"]
        end = begin + m["w"]
        span = F.array(F.struct(begin.alias("start"), end.alias("stop")))
        return F.struct(end.alias("at"), F.when(m["p"] >= rule.least, F.concat(state["found"], span)).otherwise(state["found"]).alias("found"))

    # an array grows by copying, so the matches are walked in blocks: where each begins, then the spans inside it
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(zipped) - 1) / F.lit(BLOCK)).cast("int")), lambda b: F.slice(zipped, b * BLOCK + 1, F.lit(BLOCK)))
    sizes = F.transform(blocks, lambda block: F.aggregate(block, F.lit(0), lambda s, m: s + m["g"] + m["w"]))
    begins = F.aggregate(sizes, F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("all")), lambda s, n: F.struct((s["at"] + n).alias("at"), F.concat(s["all"], F.array(s["at"])).alias("all")), lambda s: s["all"])
    spans = F.flatten(F.zip_with(blocks, begins, lambda block, at: F.aggregate(block, F.struct(at.alias("at"), none.alias("found")), step, lambda s: s["found"])))
    return F.when(text.rlike(rule.pattern), spans).otherwise(none)


def versions(paths: DataFrame, path: str = "doc_id", text: str = "text") -> DataFrame:
    """(path, blob): the content address of each version; a null text counts as empty."""
    return paths.select(F.col(path).alias("path"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("blob"))


def scan(paths: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, path: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(versions, additions): the address of every version, and the ledger rows that were missing.

    A ledger row is (blob, rule, spans) with rule = kind@version.  A row of `additions` exists for
    each pair of a blob and a rule that `ledger` lacks, also where nothing was found; append it to
    the ledger for the next run.  Of the paths that hold an unseen blob one is read; it meets the
    table by path and blob, so a blob with many paths does not gather in one task.
    """
    address, here = "_shelfwise_blob", "_shelfwise_path"
    seen = settled(versions(paths, path, text))
    holders = seen.groupBy("blob").agg(F.min(F.struct("path")).alias("holder"))
    every = F.array(*[F.lit(r.key) for r in rules])
    if ledger is None:
        todo = holders.withColumn("todo", every)
    else:
        pairs = holders.select("blob", F.explode(every).alias("rule")).join(ledger.select("blob", "rule"), ["blob", "rule"], "left_anti")
        todo = pairs.groupBy("blob").agg(F.collect_set("rule").alias("todo")).join(holders, "blob")
    todo = todo.select("blob", "todo", "holder")
    texts = paths.select(F.struct(F.col(path).alias("path")).alias(here), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn(address, F.sha2("text", 256))
    unseen = texts.join(todo.hint("shuffle_hash"), (F.col(address) == F.col("blob")) & (F.col(here) == F.col("holder"))).select("blob", "text", "todo")
    columns = [F.when(F.array_contains("todo", r.key), F.struct(F.lit(r.key).alias("rule"), findings(F.col("text"), r).alias("spans"))) for r in rules]
    additions = unseen.select("blob", F.explode(F.filter(F.array(*columns), lambda x: x.isNotNull())).alias("f")).select("blob", "f.rule", "f.spans")
    return seen, settled(additions.dropDuplicates(["blob", "rule"]))


def report(seen: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each version: doc_id, n_<kind> for each rule, base_sha256, spans.

    spans lists kind:start:end by start, then by the rules' order, joined by commas; base_sha256 is
    the SHA-256 of that list.  A version without findings has zeros and an empty list.
    """
    order = F.map_from_arrays(F.array(*[F.lit(r.key) for r in rules]), F.array(*[F.lit(k) for k in range(len(rules))]))
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    hits = ledger.where(F.col("rule").isin([r.key for r in rules]) & (F.size("spans") > 0)).withColumn("k", F.element_at(order, F.col("rule")))
    flat = F.flatten(F.collect_list(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.col("k").alias("k"), s["stop"].alias("stop")))))
    of_blob = settled(hits.groupBy("blob").agg(F.array_sort(flat).alias("found")))
    said = F.array_join(F.transform("found", lambda s: F.concat_ws(":", F.element_at(kinds, s["k"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")
    counts = [F.expr(f"cast(size(filter(found, s -> s.k = {k})) as bigint)").alias(f"n_{r.kind}") for k, r in enumerate(rules)]
    told = of_blob.select("blob", *counts, said.alias("spans"))
    rows = seen.count()
    held = seen.groupBy("blob").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") * HEAVY_SHARE > rows).select("blob")
    heavy = F.broadcast(settled(held.join(told, "blob", "left")))
    joined = seen.join(heavy, "blob").unionByName(seen.join(heavy.select("blob"), "blob", "left_anti").join(told, "blob", "left"))
    numbers = [F.coalesce(f"n_{r.kind}", F.lit(0).cast("long")).alias(f"n_{r.kind}") for r in rules]
    spans = F.coalesce("spans", F.lit(""))
    return joined.select(F.col("path").alias("doc_id"), *numbers, F.sha2(spans, 256).alias("base_sha256"), spans.alias("spans"))


@dataclass(frozen=True)
class Update:
    """What a run added to the ledger, and the report over all versions it was given."""

    additions: DataFrame
    report: DataFrame


def update(paths: DataFrame, ledger_path: str, rules: tuple[Rule, ...] = RULES, path: str = "doc_id", text: str = "text") -> Update:
    """Scans the versions that the ledger at `ledger_path` lacks, appends what was found, and reports all versions.

    The folder must be one that all executors share; where it does not exist yet, the ledger is
    empty.  Nulls, empty texts, repeated rows and empty tables are as in `find`.
    """
    spark = paths.sparkSession
    try:
        ledger = spark.read.schema(LEDGER).parquet(ledger_path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        ledger = None
    seen, additions = scan(paths, ledger, rules, path, text)
    additions.write.mode("append").parquet(ledger_path)
    known = spark.read.schema(LEDGER).parquet(ledger_path).join(seen.select("blob").distinct(), "blob", "left_semi") if ledger is not None else additions
    return Update(additions, report(seen, known, rules))


def find(documents: DataFrame) -> DataFrame:
    """`report` over a first run; its ledger is a folder of its own beside the checkpoints.

    A null text counts as empty and has no findings; repeated rows and equal texts get equal
    results; a null doc_id is carried along.  An empty table gives an empty result; columns other
    than doc_id and text are not read.
    """
    spark = documents.sparkSession
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/secret-ledger-{uuid.uuid4().hex}"
    return update(documents, folder).report


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))


def _sql_spans(rule: Rule, place: int, base: str) -> str:
    pattern = "'" + base.replace("'", "''") + "'"
    return f"""
  list_filter(list_transform(range(1, len(regexp_extract_all(t, {pattern})) + 1), lambda i: {{
    'start': coalesce(list_sum(list_transform(string_split_regex(t, {pattern})[1:i], lambda x: length(x))), 0)
             + coalesce(list_sum(list_transform(regexp_extract_all(t, {pattern})[1:i - 1], lambda x: length(x))), 0),
    'k': {place}, 'kind': '{rule.kind}',
    'n': length(regexp_extract_all(t, {pattern})[i]),
    'ok': length(regexp_extract_all(t, {pattern}, {rule.group})[i]) >= {rule.least}}}), lambda s: s.ok)"""


ORACLE_SQL = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS (
  SELECT doc_id, list_sort(list_concat({_sql_spans(RULES[0], 0, RULES[0].pattern)},
    list_concat({_sql_spans(RULES[1], 1, RULES[1].pattern)},
    {_sql_spans(RULES[2], 2, "[0-9a-f]{32,}")}))) AS f
  FROM texts),
said AS (
  SELECT doc_id, f, coalesce(array_to_string(list_transform(f, lambda s: s.kind || ':' || s.start::BIGINT::VARCHAR || ':' || (s.start + s.n)::BIGINT::VARCHAR), ','), '') AS spans FROM found)
SELECT doc_id, len(list_filter(f, lambda s: s.k = 0))::BIGINT AS n_assign, len(list_filter(f, lambda s: s.k = 1))::BIGINT AS n_access,
       len(list_filter(f, lambda s: s.k = 2))::BIGINT AS n_hex, sha256(spans) AS base_sha256, spans
FROM said
"""
