"""Queries of the document plane: lines of the documents, and tables of pages made of parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import textgrid as grid
from ..sources.adapters import dealt, read
from .registry import cte, query, rounded, sql
from .rules import normal_sql

#: A page in the layout of a plan: wrapped titles beside the first rows, a blank inside a condition.
PAGE = "\n".join(
    (
        "2.1 Drought",
        "Condition            Major Farming        Normal crop          Suggested contingency measures",
        "                     situation            cropping system",
        "",
        "Early season         Light sandy soils    Pearl millet         Sow short duration variety",
        "drought",
        "                                          Cluster bean         Seed rate 5 kg per ha",
        "(delayed onset)      Medium soils         Sorghum              Inter-crop with green gram",
        "Delay by 2 weeks",
        "A note that runs across the page without any wide gap in it",
        "",
        "Mid season           Light sandy soils    Pearl millet         -do-",
        "drought                                                        Thin the stand",
        "",
        "                     Deep soils           Cotton               Spray urea",
        "",
        "Terminal drought     Deep soils           Cotton               Harvest early for fodder",
        "(early withdrawal)",
        "",
        "  12",
        "2.2 Unusual rains",
        "after the table",
    )
)
#: Pages of a document without a table: a header that holds for what follows on its page, and a row on a page without one.
LINE_PAGES = (
    "\n".join(("Weather aberration | Crop | Suggested action", "Heavy rain at flowering | Pearl millet | Drain the field", "Cold wave | - | N/A", "plain text")),
    "Flood | Pearl millet",
)


def _crop() -> Column:
    """A part's name in place of the millet; twelve characters, as columns count."""
    return F.rpad("p_name", 12, " ")


def dealt_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts, dealt out while they are narrow: each becomes a page of text."""
    return dealt(read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_size"), "p_partkey")


def part_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages of a document for every part, in one of several layouts.

    Of five sizes one has two pages of plain lines and one has prose; the others have the table of ``PAGE`` behind a margin that
    depends on the size. A margin of two blanks or more makes every line look tabular, the note that runs across the page too, so
    that no columns are left and the document goes the way of lines. Of even sizes no heading ends the table, which runs to the
    page's end. The part's type, of any width, stands in the last column.
    """
    size = F.col("p_size")
    parts = dealt_parts(spark, sf_dir)
    lay = F.when(size % 5 == 0, F.array(*map(F.lit, LINE_PAGES))).when(size % 5 == 1, F.array(F.lit("Nothing here.\nNot a table."))).otherwise(F.array(F.lit(PAGE)))
    pages = parts.select("p_partkey", "p_size", "p_type", _crop().alias("crop"), F.posexplode(lay).alias("at", "text"))
    text = F.replace(F.replace("text", F.lit("Pearl millet"), F.col("crop")), F.lit("Spray urea"), F.col("p_type"))
    text = F.when(size % 2 == 0, F.replace(text, F.lit("2.2 Unusual rains"), F.lit("Unusual rains"))).otherwise(text)
    margin = F.repeat(F.lit(" "), (size % 4).cast("int"))
    text = F.when(size % 5 >= 2, F.concat(margin, F.replace(text, F.lit("\n"), F.concat(F.lit("\n"), margin)))).otherwise(text)
    return pages.select(F.concat(F.lit("part"), F.col("p_partkey").cast("string")).alias("document_id"), (F.col("at") + 1).alias("page"), text.alias("text"))


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_COLLAPSE = _TRIM.format(r"regexp_replace({}, '\s+', ' ', 'g')")
_LABEL = "regexp_replace(lower(" + _COLLAPSE + "), ':+$', '')"
_IS_LABEL = _LABEL + " IN (" + ", ".join(map(_text, grid.LABELS)) + ")"
cte(
    "part_documents",
    (),
    rf"""
part_documents AS (
  SELECT 'part' || p_partkey AS document_id, pos::INT AS page, CASE WHEN p_size % 5 >= 2 THEN repeat(' ', (p_size % 4)::INT) || replace(text, chr(10), chr(10) || repeat(' ', (p_size % 4)::INT)) ELSE text END AS text
  FROM (SELECT p_partkey, p_size, pos, CASE WHEN p_size % 2 = 0 THEN replace(filled, '2.2 Unusual rains', 'Unusual rains') ELSE filled END AS text
    FROM (SELECT *, replace(replace(lay[pos], 'Pearl millet', rpad(p_name, 12, ' ')), 'Spray urea', p_type) AS filled
      FROM (SELECT *, unnest(range(1, len(lay) + 1)) AS pos FROM (SELECT *, CASE p_size % 5 WHEN 0 THEN [{", ".join(map(_text, LINE_PAGES))}]
        WHEN 1 THEN ['Nothing here.' || chr(10) || 'Not a table.'] ELSE [{_text(PAGE)}] END AS lay FROM part)))))""",
)
cte(
    "regions",
    ("part_documents",),
    rf"""
page_lines AS (
  SELECT document_id, page, unnest(parts) AS line, (generate_subscripts(parts, 1) - 1)::INT AS line_no FROM (SELECT document_id, page, string_split(text, chr(10)) AS parts FROM part_documents)),
opened AS (SELECT *, count(*) FILTER (regexp_matches(line, '(?i)^\s*condition\b')) OVER (PARTITION BY document_id, page ORDER BY line_no)::BIGINT AS region_no FROM page_lines),
placed AS (SELECT *, line_no - min(line_no) OVER (PARTITION BY document_id, page, region_no) AS "offset" FROM opened WHERE region_no > 0),
ended AS (SELECT *, min(CASE WHEN "offset" > 0 AND regexp_matches(line, '^\s*\d+(\.\d+){{1,3}}\s+\S') THEN "offset" END) OVER (PARTITION BY document_id, page, region_no) AS stop FROM placed),
regions AS (
  SELECT document_id, page, region_no, "offset"::INT AS "offset", line, line_no FROM ended WHERE "offset" < least(coalesce(stop, {grid.MAX_LINES}), {grid.MAX_LINES})
  QUALIFY count(*) OVER (PARTITION BY document_id, page, region_no) >= {grid.MIN_LINES})""",
)
cte(
    "bands",
    ("regions",),
    rf"""
tabular AS (SELECT document_id, page, region_no, rtrim(line, ' ') AS line FROM regions WHERE contains(rtrim(line, ' '), '  ')),
filled AS (
  SELECT DISTINCT document_id, page, region_no, pos FROM (SELECT *, unnest(range(length(line))) AS pos FROM tabular) WHERE line[pos + 1] <> ' '),
begun AS (SELECT *, coalesce(pos - lag(pos) OVER w > 2, TRUE) AS begins FROM filled WINDOW w AS (PARTITION BY document_id, page, region_no ORDER BY pos)),
island AS (SELECT *, count(*) FILTER (begins) OVER (PARTITION BY document_id, page, region_no ORDER BY pos) AS band FROM begun),
bands AS (
  SELECT document_id, page, region_no, list(a::INT ORDER BY a) AS starts, list(b::INT ORDER BY a) AS ends
  FROM (SELECT document_id, page, region_no, band, min(pos) AS a, max(pos) + 1 AS b FROM island GROUP BY ALL)
  SEMI JOIN (SELECT document_id, page, region_no FROM tabular GROUP BY ALL HAVING count(*) >= {grid.MIN_LINES}) USING (document_id, page, region_no)
  GROUP BY ALL HAVING count(*) >= {grid.MIN_COLUMNS})""",
)
cte(
    "cut",
    ("bands",),
    rf"""
celled AS (
  SELECT *, list_transform(range(1, len(starts) + 1), lambda i: {_TRIM.format("line[starts[i] + 1:coalesce(starts[i + 1], length(line))]")}) AS cells
  FROM regions JOIN bands USING (document_id, page, region_no)),
cut AS (SELECT *, list_transform(cells, lambda c: CASE WHEN {_IS_LABEL.format("c")} THEN '' ELSE c END) AS data FROM celled)""",
)
cte(
    "titles",
    ("cut",),
    rf"""
fragments AS (
  SELECT document_id, page, region_no, starts, i, cells[i] AS cell, min("offset") AS o FROM (SELECT *, unnest(range(1, len(cells) + 1)) AS i FROM cut) WHERE {_IS_LABEL.format("cells[i]")} GROUP BY ALL),
by_column AS (SELECT document_id, page, region_no, starts, i, string_agg(cell, ' ' ORDER BY o, cell) AS title FROM fragments GROUP BY ALL),
titles AS (
  SELECT document_id, page, region_no, list_transform(range(1, len(starts) + 1), lambda j: coalesce(map_extract(m, j)[1], '')) AS titles
  FROM (SELECT document_id, page, region_no, starts, map(list(i), list(title)) AS m FROM by_column GROUP BY ALL))""",
)
cte(
    "assembled",
    ("cut",),
    rf"""
counted AS (
  SELECT *, {_TRIM.format("line")} = '' AS blank, {_TRIM.format("line")} <> '' AND data[1] <> '' AS has_first FROM cut
  WHERE NOT (len(list_filter(cells, lambda c: c <> '')) > 0 AND len(list_filter(data, lambda c: c <> '')) = 0)),
anchored AS (SELECT *, has_first AND NOT coalesce(lag(has_first) OVER (PARTITION BY document_id, page, region_no ORDER BY "offset"), FALSE) AS opens FROM counted),
numbered AS (SELECT *, count(*) FILTER (opens) OVER (PARTITION BY document_id, page, region_no ORDER BY "offset")::BIGINT AS row_no FROM anchored),
gathered AS (
  SELECT document_id, page, region_no, row_no, list(data ORDER BY "offset") AS datas, list(line ORDER BY "offset") AS source_lines, min("offset") AS first_line, any_value(len(starts)) AS n
  FROM numbered WHERE row_no > 0 AND NOT blank GROUP BY ALL),
assembled AS (
  SELECT * FROM (SELECT document_id, page, region_no, row_no, list_transform(range(1, n + 1), lambda i:
      {_COLLAPSE.format("array_to_string(list_transform(list_filter(list_transform(datas, lambda d: d[i]), lambda c: c <> ''), lambda c: " + _COLLAPSE.format("c") + "), ' ')")}) AS cells,
    source_lines, first_line::INT AS first_line, (first_line + len(source_lines) - 1)::INT AS last_line FROM gathered)
  WHERE cells[1] <> '' AND NOT regexp_matches(cells[1], '^\d{{1,3}}$'))""",
)
cte(
    "by_condition",
    ("assembled",),
    rf"""
coded AS (SELECT *, nullif({normal_sql("cells[1]")}, 'unmapped') AS code FROM assembled),
after AS (
  SELECT *, last_value(code IGNORE NULLS) OVER (PARTITION BY document_id, page, region_no ORDER BY row_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM coded),
grouped AS (SELECT *, count(*) FILTER (code <> before) OVER (PARTITION BY document_id, page, region_no ORDER BY row_no)::BIGINT AS group_no FROM after),
by_condition AS (
  SELECT document_id, page, region_no, group_no, code, list_transform(range(1, len(all_cells[1]) + 1), lambda i: array_to_string(list_filter(list_transform(all_cells, lambda c: c[i]), lambda v: v <> ''), ' ')) AS cells,
    source_lines, first_line, last_line
  FROM (SELECT document_id, page, region_no, group_no, coalesce(max(code), 'unmapped') AS code, list(cells ORDER BY row_no) AS all_cells, flatten(list(source_lines ORDER BY row_no)) AS source_lines,
      min(first_line) AS first_line, max(last_line) AS last_line FROM grouped GROUP BY ALL))""",
)


def document_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.lit(1).alias("page"), F.col("text"))


_SPLIT = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"
_CHUNKS_SQL = rf"""
WITH lines AS (
  SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) - 1 AS line_no
  FROM (SELECT doc_id, string_split_regex(regexp_replace(text, '(?:{_SPLIT})$', ''), '{_SPLIT}') AS parts FROM documents WHERE text <> '')),
cut AS (SELECT doc_id, line_no, regexp_replace(line, '^\s+|\s+$', '', 'g') AS text FROM lines),
rows AS (
  SELECT *, len(list_filter(string_split(text, '|'), lambda c: trim(c) <> '')) AS bars, len(list_filter(string_split(text, chr(9)), lambda c: trim(c) <> '')) AS tabs,
    len(list_filter(string_split_regex(text, ' {{2,}}'), lambda c: trim(c) <> '')) AS gaps FROM cut WHERE text <> ''),
kinds AS (
  SELECT doc_id AS document_id, line_no::INT AS line_no, CASE WHEN bars >= 2 OR tabs >= 2 OR (gaps >= 2 AND regexp_matches(text, ' {{2,}}')) THEN 'table_row'
    WHEN regexp_matches(text, '^[A-Z0-9][A-Z0-9 ,/\-()&.]{{3,80}}:?$') AND len(string_split_regex(text, '\s+')) <= 12 THEN 'heading' ELSE 'paragraph' END AS kind,
    CASE WHEN bars >= 2 THEN bars WHEN tabs >= 2 THEN tabs WHEN gaps >= 2 AND regexp_matches(text, ' {{2,}}') THEN gaps END::INT AS n_cells FROM rows)"""


@query("chunk_lines", _CHUNKS_SQL + " SELECT * FROM kinds")
def chunk_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = grid.chunks(document_pages(spark, sf_dir))
    n = F.when(F.col("columns").isNotNull(), F.size("columns"))
    return found.select("document_id", "line_no", "kind", n.alias("n_cells"))


@query("line_kind_counts", _CHUNKS_SQL + " SELECT kind, count(*)::BIGINT AS n FROM kinds GROUP BY 1")
def line_kind_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.chunks(document_pages(spark, sf_dir)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("table_regions", sql("SELECT * FROM regions", "regions"))
def table_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.region_lines(grid.regions(part_documents(spark, sf_dir)))


@query("column_bands", sql("SELECT * FROM bands", "bands"))
def column_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.bands(grid.regions(part_documents(spark, sf_dir)))


def _cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.cut(grid.columned(grid.regions(part_documents(spark, sf_dir))))


@query("header_labels", sql("SELECT * FROM titles", "titles"))
def header_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.titles(_cut(spark, sf_dir))


@query("assembled_rows", sql("SELECT * FROM assembled", "assembled"))
def assembled_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.rows_of(_cut(spark, sf_dir))


@query("rows_by_condition", sql("SELECT * FROM by_condition", "by_condition"))
def rows_by_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.groups_of(_cut(spark, sf_dir))


@query("extract_rules")
def extract_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.extracted(part_documents(spark, sf_dir))


@query("draft_confidence")
def draft_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(grid.extracted(part_documents(spark, sf_dir)).select("document_id", "region_no", "group_no", "confidence"))


def part_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for every part, in the layout of ``PAGE``, with the part's name for the millet."""
    return dealt_parts(spark, sf_dir).select(
        F.concat(F.lit("part"), F.col("p_partkey").cast("string")).alias("document_id"),
        F.lit(1).alias("page"),
        F.replace(F.lit(PAGE), F.lit("Pearl millet"), _crop()).alias("text"),
    )


@query("extract_part_rules")
def extract_part_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules from the table of every part's page."""
    found = grid.extracted(part_pages(spark, sf_dir))
    return rounded(found.select("document_id", "group_no", "condition_code", F.col("fields.crop").alias("crop"), "path", "confidence"))


@query(
    "confidence_notes",
    """SELECT p_partkey, array_to_string(list_filter([
      CASE WHEN p_size % 3 = 0 THEN 'row mapped against a recognized table header' ELSE 'no table header context available; fields may be mis-mapped' END,
      CASE WHEN p_size % 2 = 0 OR p_size % 5 = 0 THEN 'populated optional fields: ' || concat_ws(', ', CASE WHEN p_size % 2 = 0 THEN 'crop' END, CASE WHEN p_size % 5 = 0 THEN 'variety' END) END,
      CASE WHEN length(trim(p_name)) < 12 THEN 'condition text is unusually short' END], lambda x: x IS NOT NULL), '; ') AS notes FROM part""",
)
def confidence_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes on the confidence of a draft made of each part: its name as condition, brand and type as fields where its size says so."""
    size = F.col("p_size")
    own = {"condition": F.col("p_name"), "crop": F.when(size % 2 == 0, F.col("p_brand")), "variety": F.when(size % 5 == 0, F.col("p_type"))}
    fields = F.struct(*[own.get(f, F.lit(None).cast("string")).alias(f) for f in grid.FIELDS])
    drafts = read(spark, sf_dir, "part").select("p_partkey", fields.alias("fields"), (size % 3 == 0).alias("had_header"))
    return drafts.select("p_partkey", F.array_join(grid.confidence_notes(F.col("fields"), F.col("had_header")), "; ").alias("notes"))
