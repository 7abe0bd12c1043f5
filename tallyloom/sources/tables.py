"""Readers and writers of tables, with the guards that untrusted documents need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_optional(df: DataFrame, **columns: str) -> DataFrame:
    """Adds the named columns as typed NULLs where the table lacks them (schemas differ between snapshots)."""
    return df.withColumns({c: F.lit(None).cast(kind) for c, kind in columns.items() if c not in df.columns})


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """RFC 4180: doubled quotes, quoted line breaks; a malformed row fails the read."""
    return spark.read.schema(schema).csv(path, header=True, quote='"', escape='"', multiLine=True, mode="FAILFAST")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, quote='"', escape='"', quoteAll=False)


def read_tsv(spark: SparkSession, path: str, names: list[str], optional_last: bool = False) -> DataFrame:
    """Tab-separated lines of a fixed number of fields (one fewer if the last is optional); others fail the query."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    fields = F.split("value", "\t", -1)
    few = len(names) - (1 if optional_last else 0)
    good = F.size(fields).between(few, len(names))
    checked = F.when(good, fields).otherwise(F.raise_error(F.concat(F.lit("wrong number of fields: "), F.col("value"))).cast("array<string>"))
    return lines.select(checked.alias("f")).select(*[F.get("f", F.lit(i)).alias(n) for i, n in enumerate(names)])


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def feature_collection(df: DataFrame, geometry: str, *properties: str) -> DataFrame:
    """One GeoJSON Feature document per row; a stored Feature is unwrapped to its geometry."""
    shape = F.coalesce(F.get_json_object(F.col(geometry), "$.geometry"), F.col(geometry))
    return df.select(F.concat(F.lit('{"type":"Feature","geometry":'), shape, F.lit(',"properties":'), F.to_json(F.struct(*properties)), F.lit("}")).alias("feature"))


def sitemap_entry(base: str, slug: Column, changed: Column) -> Column:
    """One <url> element."""
    return F.concat(F.lit(f"<url><loc>{base}/"), F.url_encode(slug), F.lit("</loc><lastmod>"), F.date_format(changed, "yyyy-MM-dd"), F.lit("</lastmod></url>"))


# Limits on what one document may hold.
LIMITS = {"bytes": 25 * 1024 * 1024, "sheets": 20, "rows": 5_000, "columns": 100, "cells": 100_000}


def guarded(documents: DataFrame, size: Column, most: int = LIMITS["bytes"]) -> tuple[DataFrame, DataFrame]:
    """(documents within the limit, quarantined ones with a reason)."""
    over = F.coalesce(size > most, F.lit(False))
    return documents.where(~over), documents.where(over).withColumn("reason", F.lit("too_large"))


def artifact_columns(content: str, kind: str, published_at: str, fetched_at: str, agency: str) -> dict[str, Column]:
    """Content address of a fetched document: its hash, kind (a body that is HTML is HTML), and storage key."""
    hashed = F.sha2(F.col(content), 256)
    looks_html = F.lower(F.substring(F.ltrim(F.decode(F.col(content), "UTF-8")), 1, 200)).rlike(r"^(<!doctype html|<html|<head|<body)")
    settled = F.when(looks_html, "html").otherwise(F.col(kind))
    month = F.date_format(F.coalesce(F.col(published_at), F.col(fetched_at)), "yyyy-MM")
    return {"hash_sha256": hashed, "settled_kind": settled, "storage_key": F.concat_ws("/", F.col(agency), month, F.concat(hashed, F.lit("."), settled))}


#: File kinds by extension, in the order in which they are tried.
FILE_KINDS = ("hwpx", "hwp", "xlsx", "xls", "pdf", "zip", "html", "csv")


def file_kind(name: Column) -> Column:
    """The first kind whose extension the name ends in, before any query string; else unknown."""
    low = F.lower(F.regexp_replace(name, r"[?#].*$", ""))
    out = F.lit("unknown")
    for kind in reversed(FILE_KINDS):
        out = F.when(low.endswith("." + kind) | ((low.endswith(".htm")) if kind == "html" else F.lit(False)), kind).otherwise(out)
    return out


def write_partitioned(df: DataFrame, path: str, *by: str) -> None:
    """A snapshot under key folders; rows of one folder are gathered first, so that it gets few files."""
    df.repartition(*[F.col(c) for c in by]).write.mode("overwrite").partitionBy(*by).parquet(path)


def markdown_report(title: str, sections: dict[str, DataFrame], most_rows: int = 200) -> str:
    """A report of small aggregates, one table a section. A section of more rows is an error, not cut."""
    out = [f"# {title}"]
    for name, df in sections.items():
        rows = df.limit(most_rows + 1).collect()
        if len(rows) > most_rows:
            raise ValueError(f"section {name} has more than {most_rows} rows: aggregate it first")
        cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
        lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns), *["| " + " | ".join(map(cell, r)) + " |" for r in rows]]
        out += ["", f"## {name}", "", *lines]
    return "\n".join(out) + "\n"


def write_markdown(spark, path: str, title: str, sections: dict[str, DataFrame]) -> None:
    """The report as one text file under path."""
    spark.createDataFrame([(markdown_report(title, sections).rstrip("\n"),)], "value string").coalesce(1).write.mode("overwrite").text(path)
