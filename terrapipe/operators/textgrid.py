"""Rule tables from fixed-width page text, by the geometry of white space. Pages: document_id, page, text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.conditions import UNMAPPED, deciding_phrase, normalized
from ..storage import written

#: Titles of columns, in the normal form of ``label``.
LABELS = (
    "condition", "suggested contingency measures", "suggested contingency", "contingency measures", "major", "farming",
    "situation", "major farming", "farming situation", "major farming situation", "normal crop / cropping system",
    "normal crop/cropping system", "crop / cropping system", "crop/cropping system", "cropping system", "normal crop",
    "change in crop / cropping", "change in crop/cropping", "system including variety", "including variety",
    "change in crop/", "change in crop", "crop management", "agronomic", "agronomic measures", "agronomic measures d",
    "soil nutrient &", "soil nutrient", "moisture conservation", "moisture conservation measures", "measures",
    "remarks on", "remarks on implementation", "implementation", "remarks",
)
#: Word in a title and the field it stands for; the first that is found wins.
TITLE_FIELDS = (
    ("block", "block"), ("taluka", "block"), ("farming situation", "farming_situation"), ("crop", "crop"), ("soil", "soil"),
    ("stage", "crop_stage"), ("growth stage", "crop_stage"), ("condition", "condition"), ("weather aberration", "condition"),
    ("rainfall situation", "condition"), ("eventuality", "condition"), ("contingency measure", "action"),
    ("suggested action", "action"), ("suggested contingency measure", "action"), ("action", "action"),
    ("technology option", "action"), ("variety", "variety"), ("seed rate", "seed_rate"), ("responsible", "actor"),
    ("actor", "actor"), ("implementing agency", "actor"),
)
FIELDS = ("block", "farming_situation", "crop", "soil", "crop_stage", "condition", "action", "variety", "seed_rate", "actor")
#: The fields whose presence raises the confidence.
OPTIONAL = ("crop", "crop_stage", "action", "variety", "seed_rate", "actor", "soil", "farming_situation")
EMPTY_MARKS = ("-", "--", "---", "-do-", "na", "n/a", "nil", "none")
MIN_LINES, MIN_COLUMNS, MAX_LINES, MAX_CELL = 3, 3, 400, 2000

#: A numbered heading, which ends a table, and a heading in capitals.
_NUMBERED, _CAPITALS = r"^\s*\d+(\.\d+){1,3}\s+\S", r"^[A-Z0-9][A-Z0-9 ,/\-()&.]{3,80}:?$"
_LINE_END = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x85\x{2028}\x{2029}]"
_REGION = ("document_id", "page", "region_no")


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def collapsed(c: Column) -> Column:
    return trimmed(F.regexp_replace(c, r"\s+", " "))


def lines_of(pages: DataFrame) -> DataFrame:
    """line_no (from 0) and line of every page; a line break at the very end makes no line."""
    text = F.regexp_replace("text", f"(?:{_LINE_END})$", "")
    return pages.where(F.col("text") != "").select(
        "document_id", "page", F.posexplode(F.split(text, _LINE_END)).alias("line_no", "line")
    )


def split_row(line: Column) -> Column:
    """Cells by bars, else tabs, else runs of blanks; null unless there are two that are not empty."""

    def cells(pattern: str) -> Column:
        return F.filter(F.transform(F.split(line, pattern), trimmed), lambda c: c != "")

    # Most lines hold none of the three, and are not split at all.
    two = lambda mark, c: F.when(F.contains(line, F.lit(mark)), F.when(F.size(c) >= 2, c))
    return F.coalesce(two("|", cells(r"\|")), two("\t", cells("\t")), two("  ", cells(" {2,}")))


def chunks(pages: DataFrame) -> DataFrame:
    """Lines that are not blank, as table_row (with its cells), heading or paragraph."""
    out = lines_of(pages).withColumn("text", trimmed(F.col("line"))).where("text <> ''")
    out = out.withColumn("columns", split_row(F.col("text")))
    heading = F.col("text").rlike(_CAPITALS) & (F.size(F.split("text", r"\s+")) <= 12)
    kind = F.when(F.col("columns").isNotNull(), "table_row").when(heading, "heading").otherwise("paragraph")
    return out.select("document_id", "page", "line_no", "text", kind.alias("kind"), "columns")


def _once(table: DataFrame, /, **columns: Column) -> DataFrame:
    """``table`` with columns that are worked out once for each: what lies behind a generator no later filter or projection repeats."""
    return table.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def regions(pages: DataFrame) -> DataFrame:
    """The table regions of each page, a row each: region_no, the number of its first line on the page, and its lines.

    A region opens at a line that begins with 'condition' and ends before the next one, a numbered
    heading, the page's end, or after 400 lines. Regions of fewer than three lines are none. A page is one row;
    what follows works inside the row of a region, so nothing is shuffled.
    """
    text = F.regexp_replace("text", f"(?:{_LINE_END})$", "")
    split = _once(pages.where(F.col("text") != ""), all=F.split(text, _LINE_END))
    at = F.filter(F.sequence(F.lit(0), F.size("all") - 1), lambda i: F.col("all")[i].rlike(r"(?i)^\s*condition\b"))
    opened = _once(split.select("document_id", "page", "all"), at=at).select("*", F.posexplode("at").alias("k", "first"))
    most = F.least(F.coalesce(F.get("at", F.col("k") + 1), F.size("all")) - F.col("first"), F.lit(MAX_LINES))
    whole = _once(opened, region_no=(F.col("k") + 1).cast("long"), whole=F.slice("all", F.col("first") + 1, most)).select(*_REGION, "first", "whole")
    heading = F.transform("whole", lambda x, i: x.rlike(_NUMBERED) & (i > 0))
    stopped = _once(whole, stop=F.array_position(heading, True).cast("int"))
    lines = F.when(F.col("stop") > 0, F.slice("whole", F.lit(1), F.col("stop") - 1)).otherwise(F.col("whole"))
    return _once(stopped, lines=lines).select(*_REGION, "first", "lines").where(F.size("lines") >= MIN_LINES)


def region_lines(found: DataFrame) -> DataFrame:
    """offset, line and line_no of every line of ``regions``."""
    one = found.select(*_REGION, "first", F.posexplode("lines").alias("offset", "line"))
    return one.select(*_REGION, "offset", "line", (F.col("first") + F.col("offset")).alias("line_no"))


def columned(found: DataFrame) -> DataFrame:
    """``regions`` with starts and ends of their columns; those that cannot be read as a table go.

    Character positions that any tabular line fills make up the columns; gaps of one position are
    word breaks. Fewer than three tabular lines or three columns: not a table that can be read.
    """
    tabular = F.filter(F.transform("lines", F.rtrim), lambda x: x.rlike(" {2,}"))
    rows = _once(found, tabular=tabular).where(F.size("tabular") >= MIN_LINES)
    filled = lambda x: F.array_compact(F.transform(F.split(x, ""), lambda ch, i: F.when((ch != " ") & (ch != ""), i)))
    rows = _once(rows, at=F.array_sort(F.array_distinct(F.flatten(F.transform("tabular", filled)))))
    begins = F.filter("at", lambda x, i: (i == 0) | (x - F.get("at", i - 1) > 2))
    ends = F.filter("at", lambda x, i: (i == F.size("at") - 1) | (F.get("at", i + 1) - x > 2))
    rows = _once(rows, starts=begins, ends=F.transform(ends, lambda x: x + 1))
    return rows.where(F.size("starts") >= MIN_COLUMNS).drop("tabular", "at")


def bands(found: DataFrame) -> DataFrame:
    """starts and ends of the columns of each region."""
    return columned(found).select(*_REGION, "starts", "ends")


def label(c: Column) -> Column:
    return F.regexp_replace(F.lower(collapsed(c)), ":+$", "")


def cells_of(found: DataFrame, known: DataFrame) -> DataFrame:
    """``cut`` of regions whose bands (starts, ends) come from another table."""
    return cut(found.join(known, list(_REGION)))


def cut(table: DataFrame) -> DataFrame:
    """cells and data (cells without column titles) of each line of a region, cut where its columns begin."""

    def cell(line: Column, i: Column) -> Column:
        start = F.col("starts")[i]
        stop = F.coalesce(F.get("starts", i + 1), F.length(line))
        return trimmed(F.substring(line, start + 1, F.greatest(stop - start, F.lit(0))))

    columns = F.sequence(F.lit(0), F.size("starts") - 1)
    out = _once(table, cells=F.transform("lines", lambda line: F.transform(columns, lambda i: cell(line, i))))
    return _once(out, data=F.transform("cells", lambda x: F.transform(x, lambda c: F.when(label(c).isin(*LABELS), "").otherwise(c))))


def _titles(table: DataFrame) -> DataFrame:
    """``cut`` with titles: of each column the fragments in their order, each once; '' where there is none."""
    offsets = F.sequence(F.lit(0), F.size("lines") - 1)

    def title(i: Column) -> Column:
        one = lambda o: F.when(F.col("data")[o][i] == "", F.nullif(F.col("cells")[o][i], F.lit("")))
        return F.array_join(F.array_distinct(F.array_compact(F.transform(offsets, one))), " ")

    return _once(table, titles=F.transform(F.sequence(F.lit(0), F.size("starts") - 1), title))


def titles(table: DataFrame) -> DataFrame:
    """titles of the columns of each region, from title fragments anywhere in it, each once."""
    return _titles(table).select(*_REGION, "titles").where(F.exists("titles", lambda t: t != ""))


def _rows(table: DataFrame) -> DataFrame:
    """``cut`` with its logical rows as an array of (row_no, cells, source_lines, first_line, last_line)."""
    some = lambda a: F.exists(a, lambda c: c != "")
    offsets = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda o: ~(some(F.col("cells")[o]) & ~some(F.col("data")[o])))
    mark = lambda o: F.struct(o.alias("o"), (trimmed(F.col("lines")[o]) == "").alias("blank"), (F.col("data")[o][0] != "").alias("has_first"))
    rows = _once(table, marks=F.transform(offsets, mark))
    filled = lambda m: ~m["blank"] & m["has_first"]
    places = F.sequence(F.lit(0), F.size("marks") - 1)
    opens = F.filter(places, lambda p: filled(F.col("marks")[p]) & ~F.coalesce(filled(F.get("marks", p - 1)), F.lit(False)))
    rows = _once(rows.where(F.size("marks") > 0), opens=opens)

    def own(p: Column, k: Column) -> Column:
        stop = F.coalesce(F.get("opens", k + 1), F.size("marks"))
        return F.transform(F.filter(F.slice("marks", p + 1, stop - p), lambda m: ~m["blank"]), lambda m: m["o"])

    rows = _once(rows, own=F.transform("opens", own))

    def column(at: Column, i: Column) -> Column:
        parts = F.filter(F.transform(at, lambda o: F.col("data")[o][i]), lambda c: c != "")
        return collapsed(F.array_join(F.transform(parts, collapsed), " "))

    def row(at: Column, k: Column) -> Column:
        return F.struct(
            (k + 1).cast("long").alias("row_no"),
            F.transform(F.sequence(F.lit(0), F.size("starts") - 1), lambda i: column(at, i)).alias("cells"),
            F.transform(at, lambda o: F.col("lines")[o]).alias("source_lines"),
            at[0].alias("first_line"),
            (at[0] + F.size(at) - 1).alias("last_line"),
        )

    rows = _once(rows, every=F.transform("own", row))
    real = F.filter("every", lambda x: (x["cells"][0] != "") & ~x["cells"][0].rlike(r"^\d{1,3}$"))
    return _once(rows, rows=real).drop("marks", "opens", "own", "every")


def rows_of(table: DataFrame) -> DataFrame:
    """Logical rows: row_no, cells, source_lines, first and last offset.

    A filled first column after an empty one opens a row; blank lines empty it, lines of titles
    alone do not count at all. What stands before the first row, and rows whose first cell ends up
    empty or a page number, are dropped.
    """
    return _rows(table).select(*_REGION, F.explode("rows").alias("x")).select(*_REGION, "x.*")


def _groups(table: DataFrame) -> DataFrame:
    """``_rows`` with a row for each group of rows that describe one condition."""
    table = table.drop("cells", "data", "lines", "starts", "ends").where(F.size("rows") > 0)
    coded = _once(table, codes=F.transform("rows", lambda x: F.nullif(normalized(x["cells"][0]), F.lit(UNMAPPED))))
    coded = _once(coded, real=F.filter(F.sequence(F.lit(0), F.size("rows") - 1), lambda r: F.col("codes")[r].isNotNull()))
    opens = F.filter("real", lambda r, j: (j > 0) & (F.col("codes")[r] != F.col("codes")[F.get("real", j - 1)]))
    coded = _once(coded, opens=F.concat(F.array(F.lit(0)), opens))
    one = coded.select("*", F.posexplode("opens").alias("k", "at"))
    n = F.coalesce(F.get("opens", F.col("k") + 1), F.size("rows")) - F.col("at")
    own = _once(one, x=F.slice("rows", F.col("at") + 1, n), known=F.array_compact(F.slice("codes", F.col("at") + 1, n)))
    column = lambda i: F.array_join(F.filter(F.transform("x.cells", lambda c: c[i]), lambda v: v != ""), " ")
    return _once(
        own,
        group_no=F.col("k").cast("long"),
        code=F.coalesce(F.get("known", F.lit(0)), F.lit(UNMAPPED)),
        cells=F.transform(F.sequence(F.lit(0), F.size(F.col("x.cells")[0]) - 1), column),
        source_lines=F.flatten("x.source_lines"),
        first_line=F.array_min("x.first_line"),
        last_line=F.array_max("x.last_line"),
    )


def merged_by_condition(rows: DataFrame) -> DataFrame:
    """Rows of a region that describe one condition, merged: group_no, code, cells, source_lines.

    A row opens a group when its code differs from the last real code before it. Rows that map to
    no code stay with the group they follow; leading ones with the first. A region has 400 rows at most.
    """
    row = F.struct("row_no", "cells", "source_lines", "first_line", "last_line")
    return _grouped(rows.groupBy(*_REGION).agg(F.array_sort(F.collect_list(row)).alias("rows")))


def _grouped(table: DataFrame) -> DataFrame:
    return _groups(table).select(*_REGION, "group_no", "code", "cells", "source_lines", "first_line", "last_line")


def groups_of(table: DataFrame) -> DataFrame:
    """``merged_by_condition`` of the rows of ``cut``, inside the row of each region."""
    return _grouped(_rows(table))


def field_of(title: Column) -> Column:
    def field(plain: Column) -> Column:
        return F.coalesce(*[F.when(plain.contains(word), F.lit(name)) for word, name in TITLE_FIELDS])

    return F.transform(F.array(F.lower(collapsed(title))), field)[0]  # lowered once for all words


def cell_or_null(c: Column) -> Column:
    """Marks of emptiness become null; long cells are cut, with a sign of it."""
    t = trimmed(c)
    cut = F.when(F.length(t) <= MAX_CELL, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, MAX_CELL)), F.lit(" [...]")))
    return F.when((t == "") | F.lower(t).isin(*EMPTY_MARKS), F.lit(None).cast("string")).otherwise(cut)


def confidence(fields: Column, had_header: Column) -> Column:
    """Added up in this order, so that the sums are the same doubles everywhere."""
    populated = sum((F.coalesce(fields[f], F.lit("")) != "").cast("int") for f in OPTIONAL)
    score = F.lit(0.35) + F.when(had_header, 0.20).otherwise(0.0) + F.lit(0.06) * populated
    score = score - F.when(F.length(trimmed(fields["condition"])) < 12, 0.15).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def confidence_notes(fields: Column, had_header: Column) -> Column:
    """Why the confidence is what it is, in the order in which it adds up."""
    filled = F.array_compact(F.array(*[F.when(F.coalesce(fields[f], F.lit("")) != "", F.lit(f)) for f in OPTIONAL]))
    return F.array_compact(
        F.array(
            F.when(had_header, "row mapped against a recognized table header").otherwise(
                "no table header context available; fields may be mis-mapped"
            ),
            F.when(F.size(filled) > 0, F.concat(F.lit("populated optional fields: "), F.array_join(filled, ", "))),
            F.when(F.length(trimmed(fields["condition"])) < 12, "condition text is unusually short"),
        )
    )


def table_drafts(pages: DataFrame) -> DataFrame:
    """Drafts from the tables: fields, condition_code, phrase, confidence, source_text."""
    titled = _titles(cut(columned(regions(pages))))
    titled = _once(titled, kinds=F.transform("titles", field_of)).drop("titles")
    named = _once(_groups(_rows(titled)), values=F.transform("cells", cell_or_null))
    pairs = F.filter(F.arrays_zip("kinds", "values"), lambda x: x["values"].isNotNull())
    named = _once(named, pairs=pairs)
    own = lambda f: F.transform(F.filter("pairs", lambda x: x["kinds"] == f), lambda x: x["values"])
    loose = F.transform(F.filter("pairs", lambda x: x["kinds"].isNull()), lambda x: x["values"])
    joined = {f: F.nullif(F.array_join(own(f), " "), F.lit("")) for f in FIELDS}
    joined["action"] = F.nullif(F.array_join(F.concat(own("action"), loose), " | "), F.lit(""))
    joined["condition"] = F.coalesce(joined["condition"], cell_or_null(F.col("cells")[0]))
    found = _once(
        named,
        fields=F.struct(*[joined[f].alias(f) for f in FIELDS]),
        had_header=F.exists("kinds", lambda k: k.isNotNull()),
        source_text=F.array_join(F.transform("source_lines", collapsed), " "),
    ).select(*_REGION, "group_no", "fields", "had_header", "source_text")
    return _scored(found.where("fields.condition IS NOT NULL"))


def line_drafts(pages: DataFrame) -> DataFrame:
    """Drafts from single lines: cells under the page's header row, or the line itself.

    A header names a condition and one field more, and holds for its page; rows without one count
    only once the document has had one.
    """
    rows = chunks(pages).where("kind = 'table_row'")
    kinds = F.transform("columns", field_of)
    known = F.array_distinct(F.filter("kinds", lambda k: k.isNotNull()))
    rows = rows.withColumn("kinds", kinds).withColumn("could", F.array_contains(known, "condition") & (F.size(known) >= 2))
    on_page = W.partitionBy("document_id", "page").orderBy("line_no")
    upto = on_page.rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumns(
        {
            "header": F.first(F.when(F.col("could"), F.col("kinds")), ignorenulls=True).over(upto),
            "nth": F.sum(F.col("could").cast("int")).over(upto),
        }
    )
    document = W.partitionBy("document_id").orderBy("page", "line_no").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("seen", F.max(F.col("could").cast("int")).over(document))
    rows = rows.where("NOT (could AND nth = 1) AND (header IS NOT NULL OR seen = 1)")
    pairs = F.filter(
        F.arrays_zip("header", "columns"), lambda x: x["header"].isNotNull() & ~trimmed(x["columns"]).isin("", "-", "--", "NA", "N/A")
    )
    rows = rows.withColumn("pairs", F.coalesce(pairs, F.array().cast("array<struct<header:string,columns:string>>")))

    def last(field: str) -> Column:
        """The last cell under that title; null where there is none."""
        return F.aggregate(
            "pairs",
            F.lit(None).cast("string"),
            lambda acc, x: F.when(x["header"] == field, trimmed(x["columns"])).otherwise(acc),
        )

    got = {f: last(f) for f in FIELDS}
    got["condition"] = F.coalesce(got["condition"], F.col("text"))
    return _scored(
        rows.select(
            "document_id", "page", F.lit(0).alias("region_no"), F.col("line_no").cast("long").alias("group_no"),
            F.struct(*[got[f].alias(f) for f in FIELDS]).alias("fields"), F.col("header").isNotNull().alias("had_header"),
            F.col("text").alias("source_text"),
        )
    )


def _scored(drafts: DataFrame) -> DataFrame:
    return drafts.withColumns(
        {
            "condition_code": normalized(F.col("fields.condition")),
            "phrase": deciding_phrase(F.col("fields.condition")),
            "confidence": confidence(F.col("fields"), F.col("had_header")),
            "confidence_notes": confidence_notes(F.col("fields"), F.col("had_header")),
        }
    )


def extracted(pages: DataFrame) -> DataFrame:
    """Drafts of every document: from its tables where they give any, else from its lines."""
    tables = written(table_drafts(pages), "table-drafts")  # read twice: whole, and for its documents
    # As many documents as there are pages may have tables: they are merged, never broadcast.
    rest = pages.join(tables.select("document_id").distinct().hint("merge"), "document_id", "left_anti")
    return tables.withColumn("path", F.lit("table")).unionByName(line_drafts(rest).withColumn("path", F.lit("line")))
