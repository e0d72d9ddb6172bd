"""Collocations, source divergence and repeated passages against brute force, on odd rows and at small limits."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrapipe.llm import divergence, phrases, sieve, substrings

DOCS = "doc_id long, text string, lang string, source string, n long, term string, key long, phrase string, uid long, rank int"
_rnd = random.Random(4)


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "t", 2, "p", 3, 4) for r in rows], DOCS)


def test_a_sieve_lets_all_its_keys_pass(spark):
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 2**63, 5000, dtype=np.uint64)
    others = rng.integers(2**63, 2**64, 5000, dtype=np.uint64)
    rows = spark.createDataFrame([(int(x),) for x in keys.view(np.int64)], "key long").repartition(5)
    bits = sieve.sieve(rows)
    assert sieve.passes(bits, keys).all() and sieve.passes(bits, others).mean() < 0.01
    tight = sieve.sieve(rows, max_bytes=1 << 16)
    assert tight.nbytes == 1 << 16 and sieve.passes(tight, keys).all()
    assert not sieve.passes(sieve.sieve(rows.limit(0)), keys).any()


# ---- collocations -----------------------------------------------------------------------------


def plain_phrases(rows, how):
    counts = collections.defaultdict(collections.Counter)
    for _, text, lang, _ in rows:
        own = counts["und" if lang is None else lang]
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            words = [w for w in re.split("[ \t]+", piece) if w]
            for k in range(1, how.longest + 1):
                for i in range(len(words) - k + 1):
                    own[tuple(words[i : i + k])] += 1
    out = []
    for lang, own in counts.items():
        n = sum(f for p, f in own.items() if len(p) == 1)
        frequent = {p: f for p, f in own.items() if f >= how.least}
        found = []
        for p, a in frequent.items():
            inside = lambda x: any(x[i : i + len(p)] == p for i in range(len(x) - len(p) + 1))  # noqa: B023, E731
            if len(p) == 1 or any(len(x) > len(p) and f >= a and inside(x) for x, f in frequent.items()):
                continue
            score, cut = min((1000 * a * n // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), own[p[:cut]], own[p[cut:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(found)[: how.top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n, -s))
    return sorted(out)


def mined(spark, rows, how):
    got = phrases.phrases(table(spark, rows).repartition(3), how)
    assert got.columns[:8] == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r)[:8] for r in got.collect())


def test_phrases_against_brute_force(spark):
    words = "alpha Beta gamma delta ÉTÉ x. y, z\tq".split(" ")
    rows = [(i, " ".join(_rnd.choice(words) for _ in range(_rnd.randint(0, 60))), _rnd.choice(["en", "de", None, "und"]), "s") for i in range(120)]
    rows += [(i, "new york city \n new york state", "en", "s") for i in range(8)]
    for how in (phrases.Phrases(least=5), phrases.Phrases(least=4, top=3, tokens=50, vocabulary=3)):
        want = plain_phrases(rows, how)
        assert want and mined(spark, rows, how) == want


def test_phrases_of_odd_rows(spark):
    how = phrases.Phrases(least=3)
    assert mined(spark, [], how) == []
    assert mined(spark, [(1, None, None, None), (2, "", "en", "a"), (None, "., \n\t", "en", "a"), (3, "a b", "en", "a")], how) == []
    # Overlaps count, ends of pieces part, the whole of a long text counts; of equal cuts the first.
    long = "tick " * 30_000 + "tock tick"
    got = mined(spark, [(1, long, None, "a"), (1, long, None, "a")], phrases.Phrases(least=60_000, longest=3))
    assert got == [("und", 1, "tick tick", 59_998, 60_002, 60_002, 60_004, 1000 * 59_998 * 60_004 // 60_002**2)] or got == plain_phrases(
        [(1, long, None, "a")] * 2, phrases.Phrases(least=60_000, longest=3)
    )
    tied = [(i, "b c. a b. c a", "en", "s") for i in range(3)]
    assert [(r[1], r[2]) for r in mined(spark, tied, how)] == [(1, "a b"), (2, "b c"), (3, "c a")]


# ---- divergence -------------------------------------------------------------------------------


def plain_audit(rows, how):
    docs = [
        (lang or "", source or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")))
        for _, text, lang, source in rows
    ]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = collections.Counter(t for d in own for t in set(d[2]))
        kept = {t for t, n in df.items() if n >= how.least_docs}
        groups = {s: collections.Counter() for s in {d[1] for d in own}}
        for _, s, words in own:
            groups[s].update(t for t in words if t in kept)
        total = sum(groups.values(), collections.Counter())
        p = lambda c, t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept))  # noqa: B023, E731
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for s, c in groups.items():
            pairs = [(sum(f(p(c, t), p(o, t)) for t in kept), x) for x, o in groups.items() if x != s]
            terms = [(f(p(c, t), p(total, t)), t) for t in kept if c[t] and p(c, t) > p(total, t)]
            for part, found, most in (("pair", pairs, None), ("term", terms, how.top)):
                for rank, (v, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                    out.append((lang, s, part, item, v, rank))
    return sorted(out)


@pytest.mark.parametrize("width", [1 << 16, 1 << 20])
def test_audit_against_brute_force(spark, width):
    words = [f"w{i}" for i in range(30)] + ["ÄB", "äb", "x-y", "漢字", "a1b"]
    rows = [
        (i, " ".join(_rnd.choice(words[: 8 + i % 28]) for _ in range(_rnd.randint(0, 40))), _rnd.choice(["en", "de", None]), _rnd.choice("abcd"))
        for i in range(150)
    ]
    rows += [(1, None, "en", None), (2, "", "xx", "a"), (3, "unique", "xx", "b"), (3, "unique", "xx", "b"), (None, "w1 W2", "en", "")]
    rows += [(9, "only one", "yy", "a")]
    how = divergence.Audit(least_docs=4, width=width, tokens=300, vocabulary=5)
    got = divergence.divergence(table(spark, rows).repartition(3), how)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    want = plain_audit(rows, how)
    assert {x[0] for x in want} == {"en", "de", "", "xx"} and ("xx", "a", "pair", "b", 0, 1) in want
    assert sorted(map(tuple, got.collect())) == want


def test_the_sketch_never_underestimates(spark):
    rows = [(i, " ".join(f"t{j}" for j in range(400) if i % (j % 7 + 1) == 0), "en", "a") for i in range(40)]
    how = divergence.Audit(width=1 << 16)
    bits = divergence.possible_terms(table(spark, rows).repartition(4), how)
    letters = collections.Counter(t for r in rows for t in {re.sub("[0-9]", "", w) for w in r[1].split()})
    assert letters == {"t": 40} and bits.any()
    assert divergence.divergence(table(spark, rows), how).where("part = 'term'").count() == 0  # one source: p = q
    assert divergence.divergence(table(spark, []), how).count() == 0


# ---- repeated passages ------------------------------------------------------------------------


def plain_removed(rows, window):
    least = {}
    docs = [(d, (t or "").split()) for d, t, *_ in rows]
    for d, words in docs:
        for i in range(len(words) - window + 1):
            if d is not None:
                key = tuple(words[i : i + window])
                least[key] = min(d, least.get(key, d))
    out = []
    for d, words in docs:
        gone = set()
        for i in range(len(words) - window + 1):
            if d is not None and least[tuple(words[i : i + window])] < d:
                gone.update(range(i, i + window))
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((d, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def cut(spark, rows, how):
    got = substrings.removed(table(spark, rows).repartition(4), how)
    assert got.columns[:4] == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    return sorted((tuple(r)[:4] for r in got.collect()), key=repr)


@pytest.mark.parametrize(("window", "few"), [(50, False), (7, True), (8, False)])
def test_repeats_against_brute_force(spark, window, few):
    word = lambda: "".join(_rnd.choice("abcdefgh") for _ in range(4))
    passages = [[word() for _ in range(window + k)] for k in (-1, 0, 1, 5, 2 * window)]
    rows = []
    for i in range(80):
        words = []
        for _ in range(_rnd.randint(0, 5)):
            own = _rnd.choice(passages)
            at, n = _rnd.randint(0, 3), _rnd.randint(window - 3, len(own))
            words += own[at : at + n] if _rnd.random() < 0.6 else [word() for _ in range(_rnd.randint(0, 2 * window))]
        rows.append((_rnd.choice([i, 5, None]) if i % 10 == 0 else 100 - i, "  ".join(words), "en", "a"))
    rows += [rows[3], rows[7], (200, rows[3][1], "en", "a"), (-4, " ".join(passages[4] * 3), "en", "a")]
    how = substrings.Repeats(window=window, sieve_bytes=1 << 16 if few else 1 << 20, words=200 if few else 10_000, vocabulary=50)
    want = plain_removed(rows, window)
    assert sum(x[2] > 0 for x in want) > 10 and any(0 < x[2] < x[1] for x in want)
    assert cut(spark, rows, how) == want


def test_repeats_of_odd_rows(spark):
    how = substrings.Repeats()
    assert cut(spark, [], how) == []
    same = " ".join(f"w{i}" for i in range(60))
    rows = [(1, None, "en", "a"), (2, "", "en", "a"), (3, same, "en", "a"), (3, same, "en", "a"), (4, same + "  more", "en", "a"), (None, same, "en", "a")]
    rows += [(5, "tick " * 20_000, "en", "a"), (6, "tick " * 40_000 + same, "en", "a"), (7, " ".join(f"w{i}" for i in range(49)), "en", "a")]
    got = cut(spark, rows, how)
    assert got == plain_removed(rows, 50)
    assert [(d, n) for d, _, n, _ in got if n] == [(4, 60), (6, 40_060)]
    texts = {r.doc_id: r.kept_text for r in substrings.removed(table(spark, rows)).where("n_removed > 0").collect()}
    assert texts == {4: "more", 6: ""}


def test_runs_cover_their_windows():
    assert substrings.covered(10, [0, 1, 6, 6], 3).tolist() == [True] * 4 + [False] * 2 + [True] * 3 + [False]
    assert not substrings.covered(4, [], 3).any()


def test_rolled_hashes_follow_the_words():
    rng = np.random.default_rng(0)
    hashes = rng.integers(0, 2**64, 40, dtype=np.uint64)
    twice = substrings._Windows(np.r_[hashes, hashes], [40, 40])
    at = twice.whole(8)
    assert len(at) == 66 and (twice.rolled(8)[at][:33] == twice.rolled(8)[at][33:]).all()
    assert len(set(twice.rolled(8)[at].tolist())) == 33 and (twice.rolled(8)[at] != twice.rolled(8, 1)[at]).all()


def test_other_columns_do_not_matter(spark):
    rows = [(i, "red green blue " * 30, "en", "ab"[i % 2]) for i in range(12)]
    wide, narrow = table(spark, rows), table(spark, rows).select("doc_id", "text", "lang", "source")
    for run in (phrases.phrases, divergence.divergence, substrings.removed):
        assert sorted(map(str, run(wide).collect())) == sorted(map(str, run(narrow).collect()))
    assert substrings.removed(wide).agg(F.sum("n_removed")).first()[0] == 11 * 90
