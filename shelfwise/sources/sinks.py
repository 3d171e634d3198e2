"""Sinks: the catalogue export, the report document, partition overwrites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The columns of the exported file.
EXPORT = ("ean", "internal_code", "nom", "nom_origine", "url_image", "taxonomie_niveau_1", "taxonomie_niveau_2", "taxonomie_niveau_3", "taxonomie_niveau_4", "tva", "contenance", "unite", "statut", "publiable", "lignes_fusionnees")


def export_frame(products: DataFrame) -> DataFrame:
    """The export columns as text, largest products first: the label to sell, then the till's own."""
    levels = {f"taxonomie_niveau_{k + 1}": F.element_at("taxonomy", k + 1) for k in range(4)}
    label = F.when(F.coalesce("label_enriched", F.lit("")) != "", F.col("label_enriched")).otherwise(F.col("label"))
    named = {
        "nom": label, "nom_origine": F.col("label"), "tva": F.col("vat_rate"), "contenance": F.col("quantity_value"), "unite": F.col("quantity_unit"), "statut": F.col("status"),
        "publiable": F.when(F.col("publishable"), "oui").otherwise("non"), "lignes_fusionnees": F.col("source_rows"),
    }
    made = products.withColumns(levels | named)
    return made.orderBy(F.desc("source_rows"), "key").select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in EXPORT])


def export_csv(products: DataFrame, path: str) -> None:
    """One CSV file with a byte order mark, line feeds and a header."""
    frame = export_frame(products)
    named = frame.select(F.col(EXPORT[0]).alias("﻿" + EXPORT[0]), *EXPORT[1:])
    named.coalesce(1).write.mode("overwrite").option("header", True).option("lineSep", "\n").option("emptyValue", "").option("escape", '"').csv(path)


def report_json(report: DataFrame) -> str:
    return report.select(F.to_json(F.struct("*"))).first()[0]


def exit_code(report: DataFrame) -> int:
    return int(bool(report.select("quarantined").first()[0]))


def overwrite_partition(df: DataFrame, path: str, by: str) -> None:
    """Replaces only the partitions that `df` has rows for."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
