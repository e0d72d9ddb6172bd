"""Corpora of JSON documents and raw file listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.names import ALIASES, STATES, fold, slug
from ..operators.rules import newest


def processed(spark: SparkSession, root: str, districts: list[str] | None = None, states: list[str] | None = None) -> DataFrame:
    """Documents below ``root``, the newest file of each document.filename; unreadable files are passed over.

    ``districts`` and ``states`` are folded names to keep; both must hold where both are given.
    """
    files = (
        spark.read.schema("document struct<id: string, filename: string, district: string, state: string, page_count: int>, rules string, _corrupt string")
        .option("multiLine", True)
        .option("columnNameOfCorruptRecord", "_corrupt")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.json")
        .json(root)
        .select("document", "rules", "_corrupt", F.col("_metadata.file_modification_time").alias("modified"), F.col("_metadata.file_path").alias("path"))
    )
    good = files.where(F.col("_corrupt").isNull() & F.col("document.filename").isNotNull()).withColumn("filename", F.col("document.filename"))
    found = newest(good, "filename", "modified", "path")
    for names, field in ((districts, "district"), (states, "state")):
        if names:
            found = found.where(fold(F.col(f"document.{field}")).isin(names))
    return found.drop("_corrupt")


def rules_of(documents: DataFrame) -> DataFrame:
    """One row for each rule of the documents, flat, with the place in its list as order."""
    kind = (
        "array<struct<id: string, fields: struct<state: string, district: string, condition: string, condition_code: string, action: string>,"
        " citation: struct<document: string, page: int, source_text: string>, confidence: double, review_status: string, notes: array<string>>>"
    )
    one = documents.select("document", F.posexplode(F.from_json("rules", kind)).alias("rule_ord", "r"))
    return one.select(
        F.col("document.id").alias("document_id"),
        "rule_ord",
        F.col("r.id").alias("rule_id"),
        F.col("r.fields.state").alias("state"),
        F.col("r.fields.district").alias("district"),
        F.col("r.fields.condition").alias("condition"),
        F.col("r.fields.condition_code").alias("condition_code"),
        F.col("r.citation.document").alias("cite_document"),
        F.col("r.citation.page").alias("cite_page"),
        F.col("r.citation.source_text").alias("source_text"),
        F.col("document.page_count").alias("page_count"),
        F.col("r.confidence").alias("confidence"),
        F.col("r.review_status").alias("status"),
        F.col("r.notes").alias("notes"),
    )


def district_index(documents: DataFrame) -> DataFrame:
    """One row for each state and folded district: the name of the newest document that has it."""
    d = documents.where("document.state IS NOT NULL AND document.district IS NOT NULL")
    return d.groupBy(fold(F.col("document.state")).alias("state_key"), fold(F.col("document.district")).alias("district_key")).agg(
        F.max_by("document.district", "modified").alias("district")
    )


def raw_files(spark: SparkSession, root: str, suffix: str = "pdf") -> DataFrame:
    """Files below ``root`` by state folder: state (its own name where it is one), stem, path and the hash of their content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{suffix}").load(root)
    # Paths are URLs below the root; the root itself may hold any characters, so it is cut off by length.
    base = F.lit(root.rstrip("/").split(":", 1)[-1].lstrip("/") + "/")
    inside = F.substr("path", F.instr("path", base) + F.length(base))
    parts = F.split(inside, "/")
    found = F.replace(parts[0], F.lit("_"), F.lit(" "))
    known = F.create_map(*[F.lit(x) for code, name, _ in STATES for x in (_folded(name), name)])
    other = F.create_map(*[F.lit(x) for old, code in ALIASES.items() for x in (old, next(n for c, n, _ in STATES if c == code))])
    return files.select(
        F.coalesce(F.try_element_at(known, fold(found)), F.try_element_at(other, fold(found)), found).alias("state"),
        F.regexp_replace(F.element_at(parts, -1), r"\.[^.]+$", "").alias("stem"),
        "path",
        F.sha2("content", 256).alias("sha256"),
    ).where(F.size(F.split(inside, "/")) > 1)


def _folded(name: str) -> str:
    return "".join(c for c in name.lower() if c.isalnum())


def links(pages: DataFrame) -> DataFrame:
    """Links of HTML index pages (page_id, html): state, url, place; a heading holds for what follows."""
    token = r"(<h[1-6][^>]*>[^<]*</h[1-6]>|<a[^>]+href=\"[^\"]+\")"
    one = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(token), F.lit(1))).alias("pos", "t"))
    head = F.when(F.col("t").startswith("<h"), F.regexp_extract("t", ">([^<]*)<", 1))
    upto = W.partitionBy("page_id").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    out = one.withColumn("state", F.last(head, ignorenulls=True).over(upto)).withColumn("url", F.regexp_extract("t", 'href="([^"]+)"', 1))
    out = out.where("url <> ''")
    return newest(out.withColumn("none", F.lit(0)), "url", "none", "pos").select("page_id", "state", "url", "pos")


def write_documents(rules: DataFrame, path: str) -> None:
    """Rules as JSON below state and district folders; a rerun replaces the folders it writes."""
    keyed = rules.withColumns({"state_slug": slug(F.col("state")), "district_slug": slug(F.col("district"))})
    keyed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("state_slug", "district_slug").json(path)


def nested(documents: DataFrame, runs: DataFrame, rules: DataFrame) -> DataFrame:
    """One row for each document: document, run and its rules in order, as ``processed`` reads them; of the tables of ``ingest``.

    A document without rules has an empty list; rules of a document are gathered together, so a
    document is as large as its rules, and a state as large as it likes.
    """
    rule = F.struct(
        "rule_ord",
        F.struct(
            F.col("rule_id").alias("id"),
            F.struct(
                "state", "district", F.col("fields.condition").alias("condition"), "condition_code", F.col("fields.action").alias("action")
            ).alias("fields"),
            F.struct("document", "page", "source_text").alias("citation"),
            "confidence",
            F.col("status").alias("review_status"),
            "notes",
        ).alias("rule"),
    )
    listed = rules.groupBy("document_id").agg(F.transform(F.array_sort(F.collect_list(rule)), lambda x: x["rule"]).alias("rules"))
    run = runs.select("document_id", F.struct("pages_processed", "rules_extracted", "rules_needing_review").alias("run"))
    about = documents.select(
        "document_id", F.struct(F.col("document_id").alias("id"), "filename", "district", "state", "page_count", "sha256", "status").alias("document")
    )
    out = about.join(run, "document_id", "left").join(listed, "document_id", "left")
    none = F.array().cast(listed.schema["rules"].dataType)
    return out.select("document", "run", F.coalesce("rules", none).alias("rules"))


def write_nested(corpus: DataFrame, path: str) -> None:
    """A JSON file for each document of ``nested``, below folders of its state, district and stem; a rerun replaces the same folders.

    Documents are dealt out by their folder, so a large state is the work of many tasks.
    """
    stem = F.regexp_replace("document.filename", r"\.[^.]+$", "")
    none = lambda c: F.coalesce(F.nullif(slug(c), F.lit("")), F.lit("unknown"))
    keyed = corpus.withColumns({"state_slug": none(F.col("document.state")), "district_slug": none(F.col("document.district")), "stem": none(stem)})
    folders = ("state_slug", "district_slug", "stem")
    keyed.repartition(*folders).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*folders).json(path)


def refuse_approved(rules: DataFrame) -> DataFrame:
    """Extraction never approves: an approved row is an error when the rows are written."""
    ok: Column = F.col("status") != "approved"
    return rules.withColumn("status", F.when(ok, F.col("status")).otherwise(F.raise_error(F.lit("extracted rules cannot be approved")).cast("string")))
