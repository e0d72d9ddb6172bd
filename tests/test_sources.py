"""Corpora on disk: newest file of a document wins, broken files are passed over, sinks refuse approval."""

import json
import os

import pytest

from terrapipe.sources import corpus


def put(path, content, age):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(content)
    os.utime(path, (1_700_000_000 - age, 1_700_000_000 - age))


def document(name, district, n):
    rule = {
        "id": f"{name}{n}", "fields": {"state": "Haryana", "district": district, "condition": "Heavy rain", "condition_code": None},
        "citation": {"document": name, "page": n, "source_text": None}, "confidence": 0.5, "review_status": "pending", "notes": [],
    }
    return json.dumps({"document": {"id": name, "filename": name, "district": district, "state": "Haryana", "page_count": 31}, "run": {}, "rules": [rule] * n})


def test_corpus(spark, tmp_path):
    put(tmp_path / "x" / "a.json", document("a", "Sirsa", 2), 100)
    put(tmp_path / "y" / "a.json", document("a", "1Sirsa ", 3), 10)
    put(tmp_path / "b.json", document("b", "Hisar", 1), 50)
    put(tmp_path / "c.json", "{not json", 5)
    found = corpus.processed(spark, str(tmp_path))
    assert sorted((r.filename, r.document.district) for r in found.collect()) == [("a", "1Sirsa "), ("b", "Hisar")]
    assert corpus.rules_of(found).count() == 4
    assert corpus.processed(spark, str(tmp_path), districts=["hisar"]).count() == 1
    assert {r.district_key for r in corpus.district_index(found).collect()} == {"sirsa", "hisar"}
    assert corpus.rules_of(found).where("rule_ord = 0 and cite_page = 3").count() == 1


def test_links(spark):
    html = '<h2>Bihar</h2><a href="u1.pdf">x</a><a href="u2.pdf">y</a><h2>Goa</h2><a href="u1.pdf">z</a><a href="u3.pdf">w</a>'
    rows = corpus.links(spark.createDataFrame([(1, html)], "page_id int, html string")).orderBy("pos").collect()
    assert [(r.state, r.url) for r in rows] == [("Bihar", "u1.pdf"), ("Bihar", "u2.pdf"), ("Goa", "u3.pdf")]


def test_raw_files(spark, tmp_path):
    put(tmp_path / "Uttar_Pradesh" / "UP1-Agra.pdf", "x", 0)
    put(tmp_path / "top.pdf", "y", 0)
    rows = corpus.raw_files(spark, str(tmp_path)).collect()
    assert [(r.state, r.stem) for r in rows] == [("Uttar Pradesh", "UP1-Agra")]


def test_approved_rows_are_refused(spark):
    with pytest.raises(Exception, match="cannot be approved"):
        corpus.refuse_approved(spark.createDataFrame([("approved",)], "status string")).collect()
