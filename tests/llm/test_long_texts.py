"""Very long and repetitive texts: they end, and with the results of plain versions."""

import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrapipe.llm import decontamination, language_id, licenses

MIT = max((t for n, t in licenses.TEMPLATES if n == "MIT"), key=len)


def plain_scan(templates, least, text):
    """Every window of every template, longest in common first; no bounds, no bookkeeping."""
    words = licenses.normalised(text)
    found = []
    for name, wording in templates:
        own = licenses.normalised(wording)
        grams = Counter(zip(own, own[1:]))
        size, told = sum(grams.values()), licenses.telling(own)
        for i in range(len(words) - 1):
            for j in range(i + 2, len(words) + 1):
                window = list(zip(words[i : j - 1], words[i + 1 : j]))
                if window[0] not in grams or window[-1] not in grams:
                    continue
                common = sum((Counter(window) & grams).values())
                dice = 2 * common / (size + len(window))
                inside = licenses.telling(words[i:j])
                if dice >= least and told <= inside and not (inside - told) & licenses._VARIANTS:
                    found.append((-common, -dice, i, j, name))
    taken, out = [], []
    for _, dice, i, j, name in sorted(found):
        if all(j <= a or b <= i for a, b in taken):
            taken.append((i, j))
            out.append((name, -dice, i, j))
    return sorted(out, key=lambda x: (x[2], x[0]))


def test_license_windows_equal_all_windows():
    templates = (
        ("A", "licensed under the a license version 2"), ("B", "licensed under the lesser a license version 2"),
        ("C", "the the the license the"), ("D", "licensed under cc by nc 4 0"), ("E", "all rights reserved"),
    )
    rnd = random.Random(6)
    vocabulary = sorted({w for _, t in templates for w in t.split()} | {"x", "v2", "3"})
    for least in (0.8, 0.6):
        scan = licenses.scanner(templates, least)
        for _ in range(60):
            words = []
            for _ in range(rnd.randint(0, 7)):
                words += rnd.choice(templates)[1].split()[rnd.randint(0, 2) :] if rnd.random() < 0.7 else rnd.choices(vocabulary, k=rnd.randint(1, 4))
            text = " ".join(words)
            spots = [0]
            for w in words:
                spots.append(spots[-1] + len(w) + 1)
            want = [(n, d, spots[i], spots[j] - 1) for n, d, i, j in plain_scan(templates, least, text)]
            assert scan(text) == want


def test_repeated_wording_ends(spark):
    scan = licenses.scanner(licenses.TEMPLATES, 0.8)
    text = " ".join([MIT] * 130)
    assert len(text.split()) > 20_000
    began = time.perf_counter()
    found = scan(text)
    assert time.perf_counter() - began < 5
    assert len(found) == 130 and {(n, d) for n, d, _, _ in found} == {("MIT", 1.0)}


@pytest.mark.parametrize(("item", "doc"), [(100, 20_000), (500, 20_000), (7, 50_000)])
def test_tiling_of_equal_words_ends(item, doc):
    began = time.perf_counter()
    assert decontamination.greedy_tiles([1] * item, [1] * doc, 4) == [(0, 0, item)]
    periodic = decontamination.greedy_tiles([1, 2] * (item // 2), [1, 2, 3] * (doc // 3), 2)
    assert sum(t[2] for t in periodic) == item // 2 * 2
    assert time.perf_counter() - began < 5


def test_repetitive_documents_are_matched(spark):
    docs = spark.createDataFrame([(1, "again " * 20_000), (2, "again and " * 10_000), (3, "other words")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "again " * 100), (8, "again and again and never " * 3)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.coverage for r in decontamination.contaminated(docs, items).collect()}
    assert got == {(1, 7): 1.0, (2, 8): 0.8}


def test_a_long_text_keeps_the_bound_of_an_automaton(spark):
    rnd = random.Random(0)
    long = "".join(rnd.choice("abcdefghij ") for _ in range(1_000_000))
    rows = [(1, long, "aa"), (3, "kurz und gut " * 20, "bb"), (4, "noch ein satz dazu", "bb")]
    docs = spark.createDataFrame([(i + 4 * k, t, x) for i, t, x in rows for k in range(3)], "doc_id long, text string, lang string")
    how = language_id.CrossParse(max_chars=5_000)
    began = time.perf_counter()
    trained = {t[0]: t for t in language_id.train(docs, how)}
    assert time.perf_counter() - began < 60
    assert trained["aa"][1] == 5_000 and trained["aa"][2] <= 2 * 5_000 and 100 < trained["bb"][1] < 5_000
    assert trained["aa"][1] == {t[0]: t for t in language_id.train(docs.repartition(5), how)}["aa"][1]
    again = language_id.train(docs.repartition(7).orderBy(F.desc("doc_id")), how)
    assert all((np.array(a[4]) == np.array(b[4])).all() for a, b in zip(sorted(trained.values()), again))
