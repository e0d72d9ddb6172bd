"""Queries of the review plane: events on the rules of every nation and circle, listings, data rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import policies
from ..operators import review as ops
from ..operators import rules as rule_ops
from ..sources.adapters import read
from . import weather
from .registry import cte, query, r, rounded, sql
from .rules import origins, rule_rows, with_pages

cte(
    "documents_known",
    ("rules",),
    """
documents_known AS (SELECT 'doc' || n AS document, (18 + n * 5 % 23)::INT AS page_count FROM origins WHERE n % 4 <> 3)""",
)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their page counts; of every fourth origin's none is known."""
    n = F.col("n")
    return origins(spark, sf_dir).where(n % 4 != 3).select(
        F.concat(F.lit("doc"), n.cast("string")).alias("document"), (18 + n * 5 % 23).cast("int").alias("page_count")
    )


cte(
    "events",
    ("rules",),
    """
events AS (
  SELECT rule_id, k::INT AS turn, CASE WHEN (rule_id + k) % 3 = 0 THEN 'reject' ELSE 'approve' END AS verb, 'r' || k AS who, 'case ' || (rule_id + k) AS reason
  FROM rules, range(3) t(k) WHERE (rule_id + k) % 4 <> 0)""",
)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to three review events on each rule."""
    rows = rule_rows(spark, sf_dir).select("rule_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("at"))
    s = F.col("rule_id") + F.col("at")
    return rows.where(s % 4 != 0).select(
        "rule_id",
        "at",
        F.when(s % 3 == 0, "reject").otherwise("approve").alias("verb"),
        F.concat(F.lit("r"), F.col("at").cast("string")).alias("by"),
        F.concat(F.lit("case "), s.cast("string")).alias("reason"),
    )


cte(
    "reviewed",
    ("vetted", "events"),
    """
folded AS (
  SELECT e.rule_id, arg_max(CASE WHEN verb = 'reject' THEN 'rejected' ELSE 'approved' END, turn) AS new_status, arg_max(who, turn) AS reviewed_by,
    string_agg('rejected: ' || reason, '; ' ORDER BY turn) FILTER (verb = 'reject') AS said
  FROM events e JOIN vetted v ON v.rule_id = e.rule_id WHERE verb = 'reject' OR (cited_in AND on_page) GROUP BY 1),
reviewed AS (
  SELECT v.rule_id, v.district, v.state, v.confidence, v.cite_document, v.cite_page, coalesce(new_status, status) AS status, reviewed_by, coalesce(said, '') AS notes
  FROM vetted v LEFT JOIN folded f ON f.rule_id = v.rule_id)""",
)


def reviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.reviewed(with_pages(spark, sf_dir).withColumn("notes", F.lit("")), events(spark, sf_dir))


@query("review_latest", sql("SELECT rule_id, status, reviewed_by, notes FROM reviewed", "reviewed"))
def review_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviewed(spark, sf_dir).select("rule_id", "status", "reviewed_by", "notes")


@query(
    "review_queue",
    sql(
        """SELECT rule_id, status, confidence, (SELECT count(*) FROM reviewed WHERE status IN ('pending', 'needs_review'))::BIGINT AS total
        FROM reviewed WHERE status IN ('pending', 'needs_review') ORDER BY confidence, rule_id LIMIT 10""",
        "reviewed",
    ),
)
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten rules that wait for a reviewer, the least sure first, and how many wait."""
    waiting = reviewed(spark, sf_dir).where(F.col("status").isin("pending", "needs_review"))
    return ops.with_total(waiting.select("rule_id", "status", "confidence"), [F.col("confidence"), F.col("rule_id")], 10)


@query(
    "rules_envelope",
    sql(
        """SELECT rule_id, district, (SELECT count(*) FROM rules WHERE lower(state) = 'europe' AND lower(district) LIKE '%1%')::BIGINT AS total
        FROM rules WHERE lower(state) = 'europe' AND lower(district) LIKE '%1%' ORDER BY rule_id DESC LIMIT 4 OFFSET 3""",
        "rules",
    ),
)
def rules_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of the rules of a state and of districts by part of their name, with the total."""
    found = rule_rows(spark, sf_dir).where((F.lower("state") == "europe") & F.col("district").ilike("%1%"))
    return ops.with_total(found.select("rule_id", "district"), [F.desc("rule_id")], 4, 3)


@query(
    "eligible_page",
    sql("SELECT rule_id FROM (SELECT * FROM rules ORDER BY rule_id LIMIT 40 OFFSET 20) WHERE status = 'approved' AND trim(cite_document) <> '' AND cite_page >= 1", "rules"),
)
def eligible_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eligibility is judged after the page is cut, so a page may be short."""
    return rule_ops.page_of(rule_rows(spark, sf_dir), [F.col("rule_id")], 40, 20).where(policies.eligible()).select("rule_id")


@query(
    "rule_citation",
    sql("SELECT rule_id, cite_document AS document, cite_page AS page, k.page_count, coalesce(cite_page <= k.page_count, TRUE) AS within FROM rules LEFT JOIN documents_known k ON k.document = cite_document", "rules", "documents_known"),
)
def rule_citation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each rule's citation with the page count of its document; an unknown document sets no bound."""
    known = rule_rows(spark, sf_dir).drop("page_count").join(documents(spark, sf_dir), F.col("cite_document") == F.col("document"), "left")
    within = F.coalesce(F.col("cite_page") <= F.col("page_count"), F.lit(True))
    return known.select("rule_id", F.col("cite_document").alias("document"), F.col("cite_page").alias("page"), "page_count", within.alias("within"))


@query(
    "run_totals",
    sql(
        """SELECT k.document, k.page_count, count(rule_id)::BIGINT AS rules, count(*) FILTER (NOT cited OR confidence < 0.85::DOUBLE OR trim(condition) = '')::BIGINT AS needing_review,
        count(DISTINCT cite_page)::BIGINT AS pages_cited
        FROM documents_known k LEFT JOIN vetted ON cite_document = k.document GROUP BY 1, 2""",
        "vetted",
        "documents_known",
    ),
)
def run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: rules extracted, those that need a review, and pages cited; 0 where there is none."""
    found = rule_rows(spark, sf_dir).withColumn("needs", policies.initial_status() == "needs_review").drop("page_count")
    joined = documents(spark, sf_dir).join(found, F.col("cite_document") == F.col("document"), "left")
    return joined.groupBy("document", "page_count").agg(
        F.count("rule_id").alias("rules"), F.count_if("needs").alias("needing_review"), F.count_distinct("cite_page").alias("pages_cited")
    )


@query(
    "rule_violations",
    sql(
        """SELECT unnest(['status outside the vocabulary', 'approved without a document', 'page below 1', 'confidence outside 0 to 1']) AS rule,
        unnest([count(*) FILTER (status NOT IN ('pending', 'needs_review', 'approved', 'rejected')), count(*) FILTER (status = 'approved' AND trim(cite_document) = ''),
          count(*) FILTER (cite_page < 1), count(*) FILTER (NOT confidence BETWEEN 0 AND 1)])::BIGINT AS n FROM rules""",
        "rules",
    ),
)
def rule_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.violations(rule_rows(spark, sf_dir))


@query(
    "coverage_fractions",
    sql(
        """SELECT state, round(count(*) FILTER (coalesce(condition_code, 'unmapped') <> 'unmapped') / count(*)::DOUBLE, 6) + 0::DOUBLE AS mapped_fraction,
        round(count(condition_code) / count(*)::DOUBLE, 6) + 0::DOUBLE AS classified_fraction FROM rules GROUP BY 1""",
        "rules",
    ),
)
def coverage_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each state's rules, the share with a code and the share whose condition could be read at all."""
    code, all_ = F.col("condition_code"), F.count(F.lit(1))
    mapped = F.count_if(F.coalesce(code, F.lit("unmapped")) != "unmapped")
    return rounded(
        rule_rows(spark, sf_dir).groupBy("state").agg((mapped / all_).alias("mapped_fraction"), (F.count(code) / all_).alias("classified_fraction"))
    )


@query(
    "covered_states",
    """WITH c AS (SELECT n_regionkey, count(*) AS n FROM nation JOIN customer ON c_nationkey = n_nationkey AND n_nationkey % 3 = 0 GROUP BY 1)
    SELECT r_name AS state, c.n::BIGINT AS documents, (SELECT count(*) FROM region WHERE r_regionkey NOT IN (SELECT n_regionkey FROM c))::BIGINT AS uncovered
    FROM region JOIN c ON n_regionkey = r_regionkey ORDER BY documents DESC, state""",
)
def covered_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States that have documents, the most first, and how many have none."""
    nations = read(spark, sf_dir, "nation").where("n_nationkey % 3 = 0")
    per = nations.join(read(spark, sf_dir, "customer"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("documents"))
    states = read(spark, sf_dir, "region").join(per, F.col("r_regionkey") == F.col("n_regionkey"), "left")
    none = states.agg(F.count_if(F.col("documents").isNull()).alias("uncovered"))  # one row
    covered = states.where("documents is not null").select(F.col("r_name").alias("state"), "documents")
    return covered.crossJoin(F.broadcast(none)).orderBy(F.desc("documents"), "state")


@query(
    "shared_districts",
    sql("SELECT district FROM rules WHERE status = 'approved' INTERSECT SELECT district FROM rules WHERE status = 'rejected'", "rules"),
)
def shared_districts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Districts with approved rules and rejected ones."""
    known = rule_rows(spark, sf_dir)
    of = lambda status: known.where(F.col("status") == status).select("district")
    return of("approved").intersect(of("rejected"))


@query(
    "last_days",
    sql(f"SELECT block_id, date, {r('rain_mm')} FROM panel QUALIFY row_number() OVER (PARTITION BY block_id ORDER BY date DESC) <= 3", "panel"),
)
def last_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last three days of each block."""
    return rounded(ops.last_rows(weather.season_panel(spark, sf_dir), "block_id", "date", 3).select("block_id", "date", "rain_mm"))


@query(
    "simulated_approval",
    sql("SELECT state, count(*)::BIGINT AS rules, count(*) FILTER (cited_in AND on_page)::BIGINT AS approvable FROM vetted GROUP BY 1", "vetted"),
)
def simulated_approval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rules of each state a reviewer who approves all that may be approved would let through."""
    return with_pages(spark, sf_dir).groupBy("state").agg(
        F.count(F.lit(1)).alias("rules"), F.count_if(policies.approval_veto().isNull()).alias("approvable")
    )


@query(
    "drafted_rules",
    sql(
        """SELECT rule_id, CASE WHEN NOT cited OR confidence < 0.85::DOUBLE OR trim(condition) = '' THEN 'needs_review' ELSE 'pending' END AS status,
        array_to_string(list_filter(['seen', CASE WHEN NOT cited THEN 'missing or invalid citation' END,
          CASE WHEN confidence < 0.85::DOUBLE THEN format('confidence {:.2f} below auto-eligible threshold 0.85', confidence) END,
          CASE WHEN trim(condition) = '' THEN 'missing condition' END], lambda x: x IS NOT NULL), '; ') AS notes FROM vetted""",
        "vetted",
    ),
)
def drafted_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.drafted(rule_rows(spark, sf_dir).withColumn("notes", F.lit("seen"))).select("rule_id", "status", "notes")
