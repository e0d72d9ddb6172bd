"""Ingestion: a broken file is one error row, content is taken in once, a rerun adds nothing; documents written and read again."""

import json

from pyspark.sql import functions as F

from terrapipe.operators import ingest
from terrapipe.plans import ingestion, text
from terrapipe.sources import corpus

SCHEMA = "path string, filename string, state string, district string, page_count int, texts array<string>"


def files(spark):
    table, lines = text.PAGE.strip(), ingestion.LINES
    rows = [
        ("b", "b.pdf", "Haryana", "Sirsa", 2, [table, "prose"]),
        ("a", "a.pdf", "Haryana", "Hisar", None, [lines]),
        ("c", "c.pdf", "Haryana", "Hisar", 1, [lines]),  # a copy of a
        ("d", "d.pdf", None, None, 1, ["nothing here"]),
        ("e", "", "Goa", "North Goa", 1, ["x"]),
        ("f", None, "Goa", "North Goa", 1, ["x"]),
        ("g", "g.pdf", "Goa", "North Goa", 1, []),
        ("h", "h.pdf", "Goa", "North Goa", 1, None),
        ("i", "i.pdf", "Goa", "North Goa", 2, ["one"]),
        ("j", "j.pdf", "Goa", "North Goa", None, ["one", None]),
        ("k", "k.pdf", "Goa", "North Goa", 1, [""]),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_every_file_has_an_outcome(spark):
    run = ingest.ingested(files(spark))
    got = {r.path: (r.outcome, r.error) for r in run.outcomes.collect()}
    assert got == {
        "a": ("ingested", None), "b": ("ingested", None), "c": ("duplicate", None), "d": ("ingested", None), "k": ("ingested", None),
        "e": ("error", "no file name"), "f": ("error", "no file name"), "g": ("error", "no pages"), "h": ("error", "no pages"),
        "i": ("error", "another number of pages"), "j": ("error", "a page without text"),
    }
    names = {r.document_id: r.filename for r in run.documents.collect()}
    assert sorted(names.values()) == ["a.pdf", "b.pdf", "d.pdf", "k.pdf"]
    runs = {names[r.document_id]: (r.pages_processed, r.rules_extracted, r.rules_needing_review) for r in run.runs.collect()}
    assert runs["a.pdf"][:2] == (1, 2) and runs["b.pdf"][:2] == (2, 3) and runs["d.pdf"] == (1, 0, 0) and runs["k.pdf"] == (1, 0, 0)
    rules = run.rules.collect()
    assert len({r.rule_id for r in rules}) == len(rules) == 5 and all(r.status in ("pending", "needs_review") for r in rules)
    assert {(r.state, r.district) for r in rules} == {("Haryana", "Sirsa"), ("Haryana", "Hisar")}
    cited = {r.rule_id: r for r in run.citations.collect()}
    assert all(cited[r.rule_id].document == names[r.document_id] and cited[r.rule_id].page == 1 and cited[r.rule_id].state == r.state for r in rules)
    open_ = {d: sum(r.document_id == d and r.status == "needs_review" for r in rules) for d in names}
    assert all(runs[names[d]][2] == n for d, n in open_.items())


def test_a_rerun_adds_nothing(spark):
    first = ingest.ingested(files(spark))
    tables = {c: getattr(first, c) for c in ("documents", "pages", "rules", "citations", "runs")}
    again = ingest.ingested(files(spark), tables["documents"])
    assert {r.outcome for r in again.outcomes.collect()} == {"duplicate", "error"}
    assert all(getattr(again, c).isEmpty() for c in tables)
    assert {c: t.count() for c, t in ingest.merged(tables, again).items()} == {c: t.count() for c, t in tables.items()}
    other = ingest.ingested(files(spark))  # a run that did not see the registry
    assert {c: t.count() for c, t in ingest.merged(tables, other).items()} == {c: t.count() for c, t in tables.items()}


def test_no_files(spark):
    run = ingest.ingested(files(spark).limit(0))
    assert run.outcomes.isEmpty() and run.documents.isEmpty() and run.rules.isEmpty() and run.runs.isEmpty()


def test_status_of_documents(spark):
    run = ingest.ingested(files(spark))
    one = run.documents.where("filename = 'a.pdf'").first().document_id
    events = spark.createDataFrame([(one, 1, "failed"), (one, 3, "reviewed"), (one, 2, "extracted"), ("other", 9, "failed")], "document_id string, at int, status string")
    got = {r.filename: r.status for r in ingest.status_of_documents(run.documents, events).collect()}
    assert got == {"a.pdf": "reviewed", "b.pdf": "extracted", "d.pdf": "extracted", "k.pdf": "extracted"}


def test_documents_are_written_and_read_again(spark, tmp_path):
    run = ingest.ingested(files(spark))
    rules = run.rules.join(run.citations.drop("state", "district"), "rule_id")
    for _ in range(2):  # a rerun replaces the same folders
        corpus.write_nested(corpus.nested(run.documents, run.runs, rules), f"{tmp_path}/out")
    paths = sorted(p.relative_to(tmp_path / "out").parent.as_posix() for p in (tmp_path / "out").rglob("*.json"))
    assert paths == [
        "state_slug=goa/district_slug=north-goa/stem=k", "state_slug=haryana/district_slug=hisar/stem=a",
        "state_slug=haryana/district_slug=sirsa/stem=b", "state_slug=unknown/district_slug=unknown/stem=d",
    ]
    whole = json.loads(next((tmp_path / "out/state_slug=haryana/district_slug=sirsa/stem=b").glob("*.json")).read_text())
    assert whole["document"]["filename"] == "b.pdf" and whole["run"]["rules_extracted"] == 3 and len(whole["rules"]) == 3
    back = corpus.processed(spark, f"{tmp_path}/out")
    assert sorted(r.filename for r in back.collect()) == ["a.pdf", "b.pdf", "d.pdf", "k.pdf"]
    got = {(r.rule_id, r.rule_ord, r.state, r.condition_code, r.cite_page, r.source_text, r.status, round(r.confidence, 9)) for r in corpus.rules_of(back).collect()}
    want = {(r.rule_id, r.rule_ord, r.state, r.condition_code, r.page, r.source_text, r.status, round(r.confidence, 9)) for r in rules.collect()}
    assert got == want and len(want) == 5


def test_states_of_raw_files_are_canonical(spark, tmp_path):
    root = tmp_path / "raw (1)+x"
    for name in ("orissa/a.pdf", "Uttar_Pradesh/deep/b.pdf", "Elsewhere/c.pdf"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(name)
    got = {r.stem: r.state for r in corpus.raw_files(spark, str(root)).collect()}
    assert got == {"a": "Odisha", "b": "Uttar Pradesh", "c": "Elsewhere"}
    assert corpus.raw_files(spark, str(root)).select(F.length("sha256")).distinct().first()[0] == 64


def test_pages_that_share_a_url_are_files_of_their_own(spark, tmp_path):
    rows = [(i, "http://h/one", "") for i in range(12)] + [(12, None, ""), (13, "http://h/one", "")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {int(r.path[7:16]): (r.outcome, r.rerun) for r in ingestion.ingest_outcomes(spark, str(tmp_path)).collect()}
    want = {i: ("error", "error") if i % 6 > 3 else ("duplicate", "duplicate") if i == 9 else ("ingested", "duplicate") for i in range(14)}
    assert got == want
    assert ingestion.list_pages(spark, str(tmp_path)).count() == 2 * 6 + 3
    runs = {int(r.filename[4:13]): (r.pages_processed, r.rules_extracted) for r in ingestion.ingest_runs(spark, str(tmp_path)).collect()}
    assert runs == {i: ((2, 3), (2, 2), (1, 0), (1, 0))[i % 6] for i in range(14) if want[i][0] == "ingested"}
