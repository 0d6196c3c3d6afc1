"""CSV, JSON and JSONL tables with closed schemas, and the sinks that mirror them."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom import schemas


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with a header and an optional byte-order mark; every column is text, columns that
    the schema does not name are dropped, missing ones are null."""
    found = spark.read.option("header", True).option("encoding", "UTF-8").option("quote", '"').option("escape", '"').csv(path)
    names = {c.lstrip("﻿").strip(): c for c in found.columns}
    wanted = [part.strip().split(" ")[0] for part in schema.split(",")]
    return found.select(*[F.col(f"`{names[w]}`").alias(w) if w in names else F.lit(None).cast("string").alias(w) for w in wanted])


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Parsed documents, a JSON file each or one a line."""
    return spark.read.schema(schemas.DOCUMENT).option("recursiveFileLookup", "true").option("multiLine", "true").json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One record a line; a broken line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def jsonl_problems(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, problem) of the lines of JSONL files that are blank or no JSON object. Each file
    is read as one text, so it is meant for annotation files, not for large tables."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", r"\r?\n\z", "").alias("value"))
    lines = whole.select("path", F.posexplode(F.split("value", r"\r?\n")).alias("line", "value"))
    parsed = F.try_parse_json("value")
    problem = F.when(F.trim("value") == "", "blank_line").when(parsed.isNull(), "invalid_json").when(~F.schema_of_variant(parsed).startswith("OBJECT"), "not_an_object")
    return lines.select("path", (F.col("line") + 1).alias("line"), problem.alias("problem")).where("problem IS NOT NULL")


def document_inventory(documents: DataFrame, sources: list[str]) -> DataFrame:
    """(source_id, files) of the wanted sources that do not have exactly one document."""
    wanted = documents.sparkSession.createDataFrame([(s,) for s in sources], "source_id string")
    found = documents.groupBy("source_id").agg(F.count("*").alias("files"))
    return wanted.join(found, "source_id", "left").select("source_id", F.coalesce("files", F.lit(0)).alias("files")).where("files <> 1")


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", "true").option("mode", "FAILFAST").json(path)


def read_facts(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All ``*.facts.json`` files below a folder."""
    return spark.read.schema(schema).option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.facts.json").json(path)


def read_guarded(spark: SparkSession, path: str, schema: str, split: str = "development") -> DataFrame:
    """JSON lines of one split only: keys are read from the raw line by pattern, lines of other
    splits are dropped before anything is parsed."""
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    kept = lines.where(F.regexp_extract("value", r'"split"\s*:\s*"([^"\\]*)"', 1) == split)
    return kept.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def unknown_fields(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Names of top-level JSON fields that a schema does not know."""
    known = [part.strip().split(" ")[0] for part in _top_level(schema)]
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    names = lines.select(F.explode(F.json_object_keys("value")).alias("field")).distinct()
    return names.where(~F.col("field").isin(known))


def _top_level(schema: str) -> list[str]:
    out, depth, part = [], 0, ""
    for c in schema:
        depth += (c == "<") - (c == ">") + (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(part)
            part = ""
        else:
            part += c
    return [*out, part]


def write_documents(documents: DataFrame, path: str) -> None:
    """JSON by source; a failed job leaves no committed file."""
    documents.write.mode("overwrite").partitionBy("source_id").json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """All fields quoted, with a header, lists joined by ``;``."""
    lists = [F.array_join(F.transform(c, lambda x: x.cast("string")), ";").alias(c) if kind.startswith("array") else F.col(c) for c, kind in rows.dtypes]
    rows.select(*lists).write.mode("overwrite").option("header", True).option("quoteAll", True).csv(path)


def pretty_json(report: DataFrame) -> str:
    """A one-row report as canonical JSON: sorted names, indented, a line feed at the end."""
    return json.dumps(report.first().asDict(True), indent=2, sort_keys=True, ensure_ascii=False, default=str) + "\n"


def markdown(report: DataFrame, most: int = 1000) -> str:
    """A small report as a Markdown table."""
    rows = report.limit(most).collect()
    head = "| " + " | ".join(report.columns) + " |\n|" + "---|" * len(report.columns) + "\n"
    return head + "".join("| " + " | ".join("" if v is None else str(v) for v in r) + " |\n" for r in rows)


def compact_json(*columns: Column) -> Column:
    """Canonical compact JSON bytes, for hashing."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).cast("binary")


def append_new(found: DataFrame, path: str, key: str) -> None:
    """Appends rows whose key a Parquet table does not have yet."""
    spark = found.sparkSession
    try:
        known = spark.read.schema(found.schema).parquet(path).select(key)
    except Exception as error:  # the table does not exist yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
        found.write.mode("append").parquet(path)
        return
    found.join(known, key, "left_anti").write.mode("append").parquet(path)
