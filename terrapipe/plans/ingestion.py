"""Ingestion over a corpus made from the pages table: what each file becomes, and what a second run adds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ingest
from ..sources import corpus
from ..sources.adapters import read
from ..storage import folder, written
from .registry import cte, query, sql
from .text import PAGE

#: A page of two lines under a header, and how many rules each kind of page gives: of the table page three, of this one two.
LINES = "Weather aberration | Crop | Suggested action\nHeavy rain at flowering | Cotton | Drain the field\nCold wave | Mustard | Irrigate at night"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for every row of pages, in six kinds by its id: a table, lines, prose, a copy of the file before, a broken one, one without a page."""
    kind = F.col("page_id") % 6
    name = F.concat(F.lit("plan"), F.lpad(F.col("page_id").cast("string"), 9, "0"))
    place = F.concat_ws(" ", "url", name)  # some pages share their url, and only the third kind is of copies
    own = F.concat(F.lit("\n\nplan of "), place)
    prose = F.concat(F.lit("No rules here, see "), place)
    lines = F.concat(F.lit(LINES), F.lit("\n"), place)
    texts = (
        F.when(kind == 0, F.array(F.concat(F.lit(PAGE), own), prose))
        .when(kind == 1, F.array(prose, lines))
        .when(kind == 2, F.array(prose))
        .when(kind == 3, F.array(F.lit("the same text in every copy")))
        .when(kind == 4, F.array(prose, F.lit(None).cast("string")))
    )
    return read(spark, sf_dir, "pages").select(
        F.concat(F.lit("in/"), name, F.lit(".pdf")).alias("path"),
        F.concat(name, F.lit(".pdf")).alias("filename"),
        F.concat(F.lit("State "), (F.col("page_id") % 7).cast("string")).alias("state"),
        F.concat(F.lit("District "), (F.col("page_id") % 31).cast("string")).alias("district"),
        F.size(texts).alias("page_count"),
        texts.alias("texts"),
    )


cte(
    "files_in",
    (),
    """
files_in AS (
  SELECT page_id, page_id % 6 AS kind, 'in/plan' || lpad(page_id::VARCHAR, 9, '0') || '.pdf' AS path,
    row_number() OVER (PARTITION BY page_id % 6 = 3, CASE WHEN page_id % 6 <> 3 THEN page_id END ORDER BY page_id) AS nth FROM pages)""",
)


@query(
    "ingest_outcomes",
    sql(
        """SELECT path, CASE WHEN kind IN (4, 5) THEN 'error' WHEN kind = 3 AND nth > 1 THEN 'duplicate' ELSE 'ingested' END AS outcome,
      CASE kind WHEN 4 THEN 'a page without text' WHEN 5 THEN 'no pages' END AS error, 'duplicate' AS rerun FROM files_in WHERE kind < 4
      UNION ALL SELECT path, 'error', CASE kind WHEN 4 THEN 'a page without text' ELSE 'no pages' END, 'error' FROM files_in WHERE kind >= 4""",
        "files_in",
    ),
)
def ingest_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outcome of every file, and that of a second run over the same files."""
    found = files(spark, sf_dir)
    first = ingest.ingested(found)
    again = ingest.ingested(found, first.documents)
    return first.outcomes.select("path", "outcome", "error").join(again.outcomes.select("path", F.col("outcome").alias("rerun")), "path")


@query(
    "ingest_runs",
    sql(
        """SELECT path[4:] AS filename, CASE WHEN kind IN (0, 1) THEN 2 ELSE 1 END::BIGINT AS pages_processed,
      CASE kind WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 0 END::BIGINT AS rules_extracted FROM files_in WHERE kind < 3 OR (kind = 3 AND nth = 1)""",
        "files_in",
    ),
)
def ingest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run record of every document that was taken in."""
    run = ingest.ingested(files(spark, sf_dir))
    return run.runs.join(run.documents.select("document_id", "filename"), "document_id").select("filename", "pages_processed", "rules_extracted")


@query(
    "corpus_round_trip",
    sql(
        """SELECT 'State ' || page_id % 7 AS state, count(*)::BIGINT AS documents, sum(CASE kind WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 0 END)::BIGINT AS rules
      FROM files_in WHERE kind < 3 OR (kind = 3 AND nth = 1) GROUP BY 1""",
        "files_in",
    ),
)
def corpus_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and rules of each state, after the corpus was written as a JSON file for each document and read again."""
    run = ingest.ingested(files(spark, sf_dir))
    rules = run.rules.join(run.citations.drop("state", "district"), "rule_id")
    path = folder(spark, "corpus")
    corpus.write_nested(corpus.nested(run.documents, run.runs, rules), path)
    read_again = corpus.processed(spark, path)
    per = written(corpus.rules_of(read_again).groupBy("document_id").agg(F.count(F.lit(1)).alias("n")), "corpus-rules")
    known = read_again.select(F.col("document.state").alias("state"), F.col("document.id").alias("document_id"))
    return known.join(per, "document_id", "left").groupBy("state").agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("rules"))


@query(
    "list_documents",
    sql(
        """SELECT path[4:] AS filename, 'extracted' AS status, count(*) OVER ()::BIGINT AS total FROM files_in WHERE kind < 3 OR (kind = 3 AND nth = 1)
      ORDER BY path LIMIT 20 OFFSET 10""",
        "files_in",
    ),
)
def list_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of the documents, in order of their names, with their number in all."""
    from ..operators.review import with_total

    run = ingest.ingested(files(spark, sf_dir))
    return with_total(run.documents.select("filename", "status"), [F.col("filename")], 20, 10)


@query(
    "list_pages",
    sql(
        """SELECT path[4:] AS filename, page::INT AS page FROM files_in, range(1, 3) p(page)
      WHERE (kind < 3 OR (kind = 3 AND nth = 1)) AND page <= CASE WHEN kind IN (0, 1) THEN 2 ELSE 1 END""",
        "files_in",
    ),
)
def list_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages of every document."""
    run = ingest.ingested(files(spark, sf_dir))
    return run.pages.join(run.documents.select("document_id", "filename"), "document_id").select("filename", "page")
