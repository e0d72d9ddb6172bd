"""Ingestion of plan documents: registry by content, pages, rules, citations and runs from one written intermediate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import policies
from ..storage import written
from . import textgrid as grid
from .rules import insert_new, upsert

#: Statuses of documents and of the outcome of a file.
EXTRACTED, FAILED = "extracted", "failed"


@dataclass
class Ingestion:
    """What one run adds: tables of new rows, and the outcome of every file."""

    documents: DataFrame  # document_id, sha256, filename, state, district, page_count, status
    pages: DataFrame  # document_id, page, text
    rules: DataFrame  # rule_id, document_id, rule_ord, state, district, condition_code, fields, confidence, status, notes
    citations: DataFrame  # rule_id, document, page, source_text, state, district
    runs: DataFrame  # document_id, pages_processed, rules_extracted, rules_needing_review
    outcomes: DataFrame  # path, outcome (ingested, duplicate, error), error, document_id


def ingested(files: DataFrame, registry: DataFrame | None = None) -> Ingestion:
    """Ingest ``files`` (path, filename, state, district, page_count, texts: array of a text for each page).

    A file fails by itself: it is an error where it has no name, no pages, a page without text, or another number
    of pages than ``page_count`` says; all others go on. A file's identity is the hash of its pages. A
    content that ``registry`` (sha256) has, or that an earlier path brings, is a duplicate and adds nothing, so a rerun adds nothing.
    Rules are taken from the tables of a document, or else from its lines; each has one citation, with
    the state and the district of its document. Page texts are judged and hashed once, into a written table; the rules into another.
    """
    broken = (
        F.when(policies.blank(F.col("filename")), "no file name")
        .when(F.coalesce(F.size("texts"), F.lit(0)) <= 0, "no pages")
        .when(F.exists("texts", lambda t: t.isNull()), "a page without text")
        .when(F.col("page_count").isNotNull() & (F.col("page_count") != F.size("texts")), "another number of pages")
    )
    judged = files.withColumn("error", broken).withColumn("sha256", F.when(F.col("error").isNull(), F.sha2(F.array_join("texts", "\f"), 256)))
    known = (registry if registry is not None else files.sparkSession.createDataFrame([], "sha256 string")).select("sha256").distinct()
    # Of one content the first path: the rows that shuffle are hashes and paths, not texts.
    firsts = judged.where("sha256 IS NOT NULL").groupBy("sha256").agg(F.min("path").alias("first_path")).join(known, "sha256", "left_anti")
    staged = written(
        judged.join(firsts, "sha256", "left").withColumn(
            "outcome",
            F.when(F.col("error").isNotNull(), "error").when(F.col("first_path") == F.col("path"), "ingested").otherwise("duplicate"),
        ),
        "ingest-files",
    )
    fresh = staged.where("outcome = 'ingested'").withColumn("document_id", F.substring("sha256", 1, 32)).dropDuplicates(["document_id"])
    pages = fresh.select("document_id", F.posexplode("texts").alias("at", "text")).select("document_id", (F.col("at") + 1).alias("page"), "text")
    about = fresh.select("document_id", "filename", "state", "district", F.size("texts").alias("page_count"))
    drafts = grid.extracted(pages).join(about, "document_id")
    drafts = drafts.withColumns(
        {
            "rule_id": F.substring(F.sha2(F.concat_ws("/", "document_id", "page", "region_no", "group_no"), 256), 1, 32),
            "cite_document": F.col("filename"),
            "cite_page": F.col("page"),
            "condition": F.col("fields.condition"),
        }
    )
    rules = written(
        drafts.withColumns(
            {"status": policies.initial_status(), "notes": F.concat("confidence_notes", policies.review_reasons())}
        ),
        "ingest-rules",
    )
    counts = rules.groupBy("document_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "needs_review").alias("open"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    runs = about.join(counts, "document_id", "left").select(
        "document_id",
        F.col("page_count").cast("long").alias("pages_processed"),
        zero("n").alias("rules_extracted"),
        zero("open").alias("rules_needing_review"),
    )
    return Ingestion(
        documents=fresh.select("document_id", "sha256", "filename", "state", "district", F.size("texts").alias("page_count"), F.lit(EXTRACTED).alias("status")),
        pages=pages,
        rules=rules.select(
            "rule_id", "document_id", _ordinal().alias("rule_ord"), "state", "district", "condition_code", "fields", "confidence", "status", "notes",
        ),
        citations=rules.select("rule_id", F.col("cite_document").alias("document"), F.col("cite_page").alias("page"), "source_text", "state", "district"),
        runs=runs,
        outcomes=staged.select(
            "path", "outcome", "error", F.when(F.col("outcome") != "error", F.substring("sha256", 1, 32)).alias("document_id")
        ),
    )


def _ordinal():  # noqa: ANN202
    from pyspark.sql import Window as W

    return F.row_number().over(W.partitionBy("document_id").orderBy("page", "region_no", "group_no")) - 1


def merged(tables: dict[str, DataFrame], run: Ingestion) -> dict[str, DataFrame]:
    """The tables (documents, pages, rules, citations, runs) after a run: documents, rules and runs are inserted where new, pages and citations upserted."""
    return {
        "documents": insert_new(tables["documents"], run.documents, "sha256"),
        "pages": upsert(tables["pages"].withColumn("v", F.lit(0)), run.pages.withColumn("v", F.lit(1)), ["document_id", "page"], "v").drop("v"),
        "rules": insert_new(tables["rules"], run.rules, "rule_id"),
        "citations": upsert(tables["citations"].withColumn("v", F.lit(0)), run.citations.withColumn("v", F.lit(1)), ["rule_id"], "v").drop("v"),
        "runs": insert_new(tables["runs"], run.runs, "document_id"),
    }


def status_of_documents(documents: DataFrame, events: DataFrame) -> DataFrame:
    """Documents with the status of their last event (document_id, at, status); others keep theirs."""
    last = events.groupBy("document_id").agg(F.max_by("status", "at").alias("new_"))
    return documents.join(last, "document_id", "left").withColumn("status", F.coalesce("new_", "status")).drop("new_")
