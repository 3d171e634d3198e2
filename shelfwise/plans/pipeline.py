"""The whole run: ingest, field checks, cross checks, enrichment, records, linking, routing, report.

Enrichment comes before grouping, so that enriched labels are compared.  One lazy plan a table;
lineage is cut after the records and inside linking only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from shelfwise.config import RuleSet
from shelfwise.operators import golden, resolution, routing, steps
from shelfwise.session import settled


@dataclass
class Outcome:
    rows: DataFrame
    records: DataFrame
    corrections: DataFrame
    anomalies: DataFrame
    lineage: DataFrame
    unresolved: DataFrame
    funnel: DataFrame
    report: DataFrame


def checked_rows(listing: DataFrame, rules: RuleSet, statuses: DataFrame | None = None, answers: DataFrame | None = None, repair: bool = True) -> DataFrame:
    rows = steps.ingest(listing, rules, repair)
    rows = steps.field_checks(rows, rules, statuses)
    rows = steps.cross_checks(rows, rules)
    return steps.enrich(rows, rules, answers)


def run_pipeline(listing: DataFrame, rules: RuleSet | None = None, run_id: str = "run", statuses: DataFrame | None = None, answers: DataFrame | None = None, learned: DataFrame | None = None, network: bool = False) -> Outcome:
    rules = rules or RuleSet.load()
    rows = settled(checked_rows(listing, rules, statuses, answers))
    records = settled(golden.golden_records(rows, rules))
    linked = resolution.resolve(records, rules.thresholds, learned)
    final = routing.route(resolution.fuse(records, linked.groups), rules)
    return Outcome(
        rows=rows,
        records=final,
        corrections=steps.corrections_of(rows, run_id),
        anomalies=steps.anomalies_of(rows, run_id),
        lineage=golden.lineage(rows, resolution.key_map(records, linked.groups)),
        unresolved=linked.unresolved,
        funnel=linked.funnel,
        report=routing.report(rows, final, rules, network),
    )
