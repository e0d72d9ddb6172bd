"""What may be approved, and what may be said: columns of a rule joined to its document.

Columns used: status, condition_code, confidence, district, condition, cite_document, cite_page,
source_text, and, where they are known, page_count and page_text. The texts of all reasons below are
fixed values: they are what a reviewer reads in the records.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import AUTO_ELIGIBLE
from .conditions import CODES

#: Words that say nothing about a snippet.
STOPWORDS = ("with", "from", "that", "this", "after", "into", "when", "then", "than", "and", "the", "for", "etc")


def blank(col: Column) -> Column:
    return F.trim(F.coalesce(col, F.lit(""))) == ""


def reasons(*pairs: tuple[Column, Column | str]) -> Column:
    """The texts whose condition holds, in order."""
    return F.array_compact(
        F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(t) if isinstance(t, str) else t) for c, t in pairs])
    )


def valid_citation(page_count: Column | None = None) -> Column:
    ok = ~blank(F.col("cite_document")) & F.coalesce(F.col("cite_page") >= 1, F.lit(False))
    return ok if page_count is None else ok & F.coalesce(F.col("cite_page") <= page_count, F.lit(True))


def significant_tokens(text: Column) -> Column:
    """Lower-case words of four letters or more, an upper-case H standing for a blank."""
    plain = F.lower(F.replace(text, F.lit("H"), F.lit(" ")))
    return F.filter(
        F.regexp_extract_all(plain, F.lit("([a-z0-9]+)"), F.lit(1)), lambda t: (F.length(t) >= 4) & ~t.isin(*STOPWORDS)
    )


def on_page(snippet: Column, page_text: Column) -> Column:
    """The snippet's tokens stand on the page in their order; nothing to compare is no failure."""
    needle = significant_tokens(F.coalesce(snippet, F.lit("")))
    matched = F.aggregate(
        significant_tokens(page_text),
        F.lit(0),
        lambda i, t: F.when(t == F.get(needle, i), i + 1).otherwise(i),
    )
    return F.when(blank(snippet) | page_text.isNull() | (F.size(needle) == 0), F.lit(True)).otherwise(
        matched == F.size(needle)
    )


def review_reasons() -> Column:
    """Why a draft needs a human first; none: it may wait as pending."""
    return reasons(
        (~valid_citation(), "missing or invalid citation"),
        (
            F.col("confidence") < AUTO_ELIGIBLE,
            F.format_string(f"confidence %.2f below auto-eligible threshold {AUTO_ELIGIBLE:.2f}", "confidence"),
        ),
        (blank(F.col("district")), "missing district"),
        (blank(F.col("condition")), "missing condition"),
    )


def initial_status() -> Column:
    """Never approved: only a reviewer does that."""
    return F.when(F.size(review_reasons()) > 0, "needs_review").otherwise("pending")


def approval_veto() -> Column:
    """Why a rule cannot be approved; null where it can."""
    count, page = F.col("page_count"), F.col("cite_page")
    over = F.concat(
        F.lit("cannot approve: citation page "), page.cast("string"), F.lit(" exceeds document page_count "), count.cast("string")
    )
    return (
        F.when(~valid_citation(count) & F.coalesce(page > count, F.lit(False)), over)
        .when(~valid_citation(count), "cannot approve a rule without a valid citation")
        .when(
            ~on_page(F.col("source_text"), F.col("page_text")),
            "cannot approve: citation source_text does not appear on the cited page",
        )
    )


def eligible() -> Column:
    return (F.col("status") == "approved") & valid_citation()


def emission_reasons(detected: Column, has_rule: Column) -> Column:
    """Every reason to stay silent; none: an advisory may be emitted."""
    code = F.col("condition_code")
    quoted = lambda c: F.concat(F.lit("'"), F.coalesce(c, F.lit("None")), F.lit("'"))
    return reasons(
        (detected.isNull(), "no condition detected"),
        (~detected.isin(*CODES), F.concat(F.lit("condition "), quoted(detected), F.lit(" is not emittable"))),
        (~has_rule, "no matching approved rule"),
        (
            has_rule & (F.coalesce(F.col("status"), F.lit("")) != "approved"),
            F.concat(F.lit("rule review_status is "), quoted(F.col("status")), F.lit(", not 'approved'")),
        ),
        (has_rule & ~valid_citation(F.col("page_count")), "matched rule has no valid citation"),
        (
            has_rule & ~on_page(F.col("source_text"), F.col("page_text")),
            "citation source_text does not appear on the cited page",
        ),
        (
            has_rule & detected.isNotNull() & ~code.eqNullSafe(detected),
            F.concat(F.lit("rule condition_code "), quoted(code), F.lit(" does not match detected "), quoted(detected)),
        ),
    )
