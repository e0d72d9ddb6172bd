"""The parts that run inside tasks, against plain versions of themselves."""

import itertools
import random
from collections import Counter

import numpy as np
import pyarrow as pa

from terrapipe.llm import chat, decontamination, language_id, licenses, mixing, near_duplicates, quality_rules, toxicity


def test_greedy_tiling_equals_brute_force():
    rnd = random.Random(1)

    def brute(item, doc, least):
        free_i, free_d, tiles = [True] * len(item), [True] * len(doc), []
        while True:
            best = None
            for i, d in itertools.product(range(len(item)), range(len(doc))):
                n = 0
                while (
                    i + n < len(item) and d + n < len(doc) and item[i + n] == doc[d + n] >= 0
                    and free_i[i + n] and free_d[d + n]
                ):
                    n += 1
                if n >= least and (best is None or n > best[0]):
                    best = (n, i, d)
            if not best:
                return tiles
            n, i, d = best
            free_i[i : i + n], free_d[d : d + n] = [False] * n, [False] * n
            tiles.append((i, d, n))

    for _ in range(150):
        v = rnd.choice([2, 3, 6, 30])
        a = [rnd.randrange(v) for _ in range(rnd.randrange(1, 25))]
        b = [rnd.randrange(-1, v) for _ in range(rnd.randrange(0, 30))]
        if rnd.random() < 0.5:
            b = b + a[len(a) // 2 :] + [99] + a[: len(a) // 2]
        least = rnd.choice([1, 2, 3, 4])
        got, want = decontamination.greedy_tiles(a, b, least), brute(a, b, least)
        assert sum(t[2] for t in got) == sum(t[2] for t in want)
        for i, d, n in got:
            assert a[i : i + n] == b[d : d + n]


def test_parse_equals_brute_force():
    rnd = random.Random(2)

    def brute(train, text):
        train, text, n, i = bytes(train), bytes(text), 0, 0
        while i < len(text):
            k = 1
            while i + k <= len(text) and text[i : i + k] in train:
                k += 1
            i += max(1, k - 1)
            n += 1
        return n

    for turn in range(300):
        a = [rnd.randrange(4) for _ in range(rnd.randrange(1, 60))]
        texts = [[rnd.randrange(5) for _ in range(rnd.randrange(0, 60))] for _ in range(5)]
        if turn % 3 == 0:  # long matches, over many pieces
            texts[0] = (a * 3)[rnd.randrange(9) :]
            texts[1] = a + [4] + a[::-1] + a
        goes = language_id.suffix_automaton(a)
        edges = np.array([(p, c, q) for p, own in enumerate(goes) for c, q in own.items()])
        table = language_id.dense(len(goes), edges, 5)
        got = language_id.parse(table, [np.array(x, np.uint8) for x in texts], rnd.choice([1, 2, 3, 8, 1000]))
        assert got.tolist() == [brute(a, x) for x in texts]


def test_marginals_equal_a_plain_chain():
    rng = np.random.default_rng(0)
    for _ in range(40):
        lengths = rng.integers(0, 60, rng.integers(1, 9))
        e, trans = np.exp(rng.normal(0, 2, lengths.sum())), np.exp(rng.normal(0, 1, (2, 2)))
        want, at = np.empty(len(e)), 0
        for n in lengths:
            x = e[at : at + n]
            if n:
                alpha = [np.array([1, x[0]])]
                for t in range(1, n):
                    alpha.append(np.array([alpha[-1] @ trans[:, 0], (alpha[-1] @ trans[:, 1]) * x[t]]))
                beta = [np.ones(2)]
                for t in range(n - 1, 0, -1):
                    beta.append(trans @ (np.array([1, x[t]]) * beta[-1]))
                want[at : at + n] = [a[1] * b[1] / (a @ b) for a, b in zip(alpha, beta[::-1], strict=True)]
            at += n
        assert np.allclose(toxicity.marginals(e, lengths, trans, int(rng.integers(1, 20))), want, atol=1e-9)


def test_permutations_are_bijections():
    for n in (1, 2, 3, 10, 97, 100, 1024):
        for key in (1, -5):
            got = mixing.permuted(np.full(n, key), np.arange(n), np.full(n, n))
            assert sorted(got.tolist()) == list(range(n))
    many = [mixing.permuted(np.full(50, k), np.arange(50), np.full(50, 50)).tolist() for k in range(5)]
    assert len({tuple(x) for x in many}) == 5


def test_multinomial_counts_end_exact():
    counts = mixing.draw_counts([1000, 10, 0, 333], 16, 3)
    assert counts.sum(0).tolist() == [1000, 10, 0, 333]
    assert counts.sum(1).max() - counts.sum(1).min() <= 1 + 1343 // 16 * 0 + 1
    part = mixing.draw_counts([7, 9], 4, [3, 1], [5, 0, 1, 10])
    assert part.sum(0).tolist() == [7, 9] and part.sum(1).tolist() == [5, 0, 1, 10]
    assert (mixing.draw_counts([5], 4, 3) == mixing.draw_counts([5], 4, 3)).all()


def test_repeated_words_equal_brute_force():
    rnd = random.Random(3)
    for _ in range(200):
        words = [rnd.choice([b"a", b"b"]) for _ in range(rnd.randrange(0, 40))]
        windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
        counts = Counter(windows)
        covered = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(8)}
        assert quality_rules.repeated_words(words) == len(covered)


def test_base_counts():
    assert quality_rules.base_counts(None) == quality_rules.base_counts("") == (0, 0, 0, 0, 0)
    text = "é #x\n a|b\n\n a|b\na|b "
    assert quality_rules.base_counts(text) == (5, 13, 4, 1, 0)
    assert quality_rules.base_counts("\ud800 x")[0] == 2


def test_distance_bounds():
    p, q = np.array([[1.0, 0.0], [0.5, 0.5]]), np.array([0.0, 1.0])
    assert quality_rules.js_distance(p, q)[0] == 1 and 0 < quality_rules.js_distance(p, q)[1] < 1


def test_links_equal_sets():
    rnd = random.Random(5)
    base = [rnd.randrange(10**6) for _ in range(60)]
    texts = [np.unique([x if rnd.random() < 0.97 else rnd.randrange(10**6) for x in base]).astype(np.uint64) for _ in range(30)]
    got, alike = near_duplicates.links(texts, None, 0.8)
    sets = [set(x.tolist()) for x in texts]
    for i, j in itertools.product(range(30), range(30)):
        want = i != j and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8
        assert got[i, j] == want
        assert i == j or abs(alike[i, j] - len(sets[i] & sets[j]) / len(sets[i] | sets[j])) < 1e-6
    cross, _ = near_duplicates.links(texts[:10], texts[10:], 0.8)
    assert (cross == got[:10, 10:]).all()


def test_prefix_is_shortened_to_the_recall():
    how = near_duplicates.Forest()
    k = how.floor()
    recall = lambda k: 1 - (1 - how.threshold**k) ** how.trees
    assert recall(k) >= how.target_recall > recall(k + 1)
    # Links of equal sets need no shortening; those at the threshold need it down to the floor.
    assert how.recall(how.depth, {39: 10}) >= how.target_recall
    assert how.recall(k + 1, {0: 10}) < how.target_recall <= how.recall(k, {0: 10})
    assert how.recall(how.depth, {}) == 0


def test_branches_equal_pairwise_prefixes():
    rnd = random.Random(6)
    how = near_duplicates.Forest(depth=4, trees=3, target_recall=0.5)
    least = how.floor()
    rows = sorted((bytes([rnd.randrange(3), *(rnd.randrange(2) for _ in range(4))]), n) for n in range(40))
    for cuts in ([40], [1, 17, 40], [13, 14, 40]):
        batches = [
            pa.RecordBatch.from_pydict({"label": [x[0] for x in rows[a:b]], "node": [x[1] for x in rows[a:b]]})
            for a, b in zip([0, *cuts], cuts, strict=False)
        ]
        got = {(r["label"], r["node"]): r for b in near_duplicates._branches(iter(batches), how) for r in b.to_pylist()}
        for k, (label, node) in enumerate(rows):
            shared = [
                max(n for n in range(5) if label[: n + 1] == other[: n + 1]) if label[0] == other[0] else -1
                for other, m in rows
                if m != node
            ]
            if k in (0, len(rows) - 1):
                assert got[label, node]["deep"] == how.depth
            elif max(shared) >= least:
                assert got[label, node]["deep"] == max(shared)
                assert got[label, node]["lead"] == next(m for other, m in rows if other[: least + 1] == label[: least + 1])
            else:
                assert (label, node) not in got


def test_chat_path_is_the_cheapest():
    how = chat.Repair()
    options = {role: chat.choices(role, how) for role in range(-1, 3)}
    close = chat.closing(how)

    def brute(roles):
        best = {chat.START: 0}
        for role in roles:
            new = {}
            for state, value in best.items():
                for a, b, v, _, _ in options[role]:
                    if a == state:
                        new[b] = min(new.get(b, 10**18), value + v)
            best = new
        return min(v + close[s] for s, v in best.items())

    rnd = random.Random(6)
    for _ in range(200):
        roles = [rnd.randrange(-1, 3) for _ in range(rnd.randrange(1, 9))]
        m = chat.fragment_matrix(roles, options)
        assert min(m[chat.START] + np.array(close)) == brute(roles)
        exit_ = int((m[chat.START] + np.array(close)).argmin())
        path = chat.best_path(roles, chat.START, exit_, options)
        state = chat.START
        for before, role, kind in path:
            assert before == state
            assert kind == 1 and state == role + 1 or kind == 2 or chat.legal(state, role)
            state = role + 1


def test_license_windows():
    scan = licenses.scanner(licenses.TEMPLATES, 0.8)
    assert scan("") == scan("license") == []
    found = scan("Some words. Released under the MIT License. More, all rights reserved!")
    assert [x[0] for x in found] == ["MIT", "all-rights-reserved"]
    text = "x " + licenses.TEMPLATES[3][1].replace("merge, publish", "merge and publish")
    assert [(a, d < 1) for a, d, _, _ in scan(text)] == [("MIT", True)]
    a, b = scan("I say: Licensed under CC BY-NC 4.0.")[0][2:]
    assert "I say: Licensed under CC BY-NC 4.0."[a:b] == "Licensed under CC BY-NC 4.0"


def test_chat_costs_equal_a_search_of_its_own():
    """Least cost over all merges, relabels and insertions, from the rules of turns alone."""
    from functools import cache

    how = chat.Repair()
    options = {role: chat.choices(role, how) for role in range(-1, 3)}
    close = chat.closing(how)
    after = {None: {0, 1}, 0: {1}, 1: {2}, 2: {1}}  # who may speak: system first or nobody, then user and assistant in turn

    def brute(roles):
        @cache
        def least(i, last):
            if i == len(roles):
                return 0 if last in (None, 2) else 3 if last == 1 else 6
            best = 10**6
            for new in range(3):
                given = 0 if new == roles[i] else 1 if roles[i] < 0 else 2
                if new == last:
                    best = min(best, given + 1 + least(i + 1, last))
                for first in [(), *[(a,) for a in range(3)], *[(a, b) for a in range(3) for b in range(3)]]:
                    turns = [last, *first, new]
                    if all(b in after[a] for a, b in itertools.pairwise(turns)):
                        best = min(best, given + 3 * len(first) + least(i + 1, new))
            return best

        return least(0, None)

    rnd = random.Random(16)
    for n in [0, 1, 1, 2, 2, *[rnd.randrange(1, 12) for _ in range(300)]]:
        roles = tuple(rnd.randrange(-1, 3) for _ in range(n))
        value = min(chat.fragment_matrix(list(roles), options)[chat.START] + np.array(close))
        assert int(value) >> 32 == brute(roles), roles


def test_ftrl_equals_a_plain_one():
    """Per coordinate, over dictionaries and in the order of the rows."""
    import math

    from terrapipe.llm import quality_classifier as qc

    rnd = random.Random(3)
    words = ["good", "fine", "bad", "Ugly", "12", "...", "the", "a"]
    rows = [(rnd.randrange(2), " ".join(rnd.choices(words, k=rnd.randrange(0, 30)))) for _ in range(60)]
    how = qc.Ftrl(bits=12, epochs=2)
    z, n = Counter(), Counter()

    def weight(i):
        if abs(z[i]) <= how.l1:
            return 0.0
        return -(z[i] - math.copysign(how.l1, z[i])) / ((how.beta + math.sqrt(n[i])) / how.alpha + how.l2)

    vocabulary = qc.Vocabulary()
    for _ in range(how.epochs):
        for label, text in rows:
            x = Counter()
            for i, v in zip(*(a.tolist() for a in qc.features(text, how.bits, vocabulary))):
                x[i] += v
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = (p - label) * v
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / how.alpha * w[i]
                n[i] += g * g
    got = qc.fit(iter(rows), how)
    assert np.count_nonzero(got) > 20
    assert np.allclose(got, [weight(i) for i in range(1 << how.bits)], atol=1e-4)
