"""Every operator on tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import collections
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from terrapipe.llm import chat, components, decontamination, language_id, licenses, mixing, near_duplicates, quality_classifier, quality_rules, sharding, toxicity
from terrapipe.llm.sql import ORACLE_SQL

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, part int, tie string, key string, row_of_mix long, keep_id long, key_ string, doc string, label string"
_rnd = random.Random(8)
_EN = "the of and to in that is was for on with as it by are this be from or an at not".split()
_DE = "der die und den von zu das mit sich auf ist im dem nicht ein eine als auch es an".split()


def prose(n, words=_EN, salt=0.5):
    return " ".join(
        _rnd.choice(words) if _rnd.random() < salt else "".join(_rnd.choice("abcdefghij") for _ in range(6)) for _ in range(n)
    )


LONG = prose(6000)
BASE = prose(120)
NEAR = BASE.split()
NEAR[60] = "changed"
ROWS = [
    (1, BASE, "en", "a"), (2, " ".join(NEAR), "en", "a"), (3, BASE, "en", None), (3, BASE, "en", None), (4, None, None, "b"),
    (5, "", "en", "b"), (6, "  \n ", "de", "b"), (7, "one two", "en", "c"), (8, "one two", "de", "c"), (9, LONG, "en", "a"),
    (None, prose(40), "en", "a"), (10, prose(50, _DE), "de", "c"), (11, "!!! ??? 123", "de", "c"),
]
OPERATORS = {
    "shard": lambda d: sharding.shard_by_bytes(d),
    "mix": lambda d: mixing.words_taken(d),
    "mixed": lambda d: mixing.mixed_texts(d),
    "rules": lambda d: quality_rules.quality_rules(d),
    "good": lambda d: quality_rules.keep_good(d),
    "near": lambda d: near_duplicates.near_duplicates(d),
    "one": lambda d: near_duplicates.keep_one_of_each(d),
    "lang": lambda d: language_id.languages(d),
    "license": lambda d: licenses.license_notices(d),
    "quality": lambda d: quality_classifier.quality_scores(d, d.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))),
    "toxic": lambda d: toxicity.toxic_documents(d, d.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))),
    "leaks": lambda d: decontamination.contaminated(d, d.select(F.col("doc_id").alias("item_id"), "text")),
    "clean": lambda d: decontamination.drop_contaminated(d, d.where("doc_id = 7").select(F.col("doc_id").alias("item_id"), "text")),
}
ONE_EACH = ("shard", "mix", "rules", "near", "lang", "quality", "toxic")


def table(spark, rows=ROWS):
    full = [(*r, len(r[1]) if r[1] is not None else None, 1, 0.5, 2, "t", "k", 5, 6, "k", "d", "l") for r in rows]
    return spark.createDataFrame(full, DOCS)


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_and_empty_tables(spark, name):
    got = OPERATORS[name](table(spark)).collect()
    assert len(got) == len(ROWS) or name not in ONE_EACH
    assert OPERATORS[name](table(spark, [])).count() == 0


def test_values_of_odd_rows(spark):
    """Null (4), empty (5) and blank (6) texts, repeated rows (3), a null id, no letters (11)."""
    by = lambda name: [(r["doc_id"], r) for r in OPERATORS[name](table(spark)).collect()]
    shard = by("shard")
    assert {d: r["size"] for d, r in shard if d in (4, 5, 6)} == {4: 8, 5: 8, 6: 12}
    assert {(r["size"], r.text_crc32) for d, r in shard if d in (1, 3)} == {(len(BASE) + 8, zlib.crc32(BASE.encode()))}
    assert {r.shard for d, r in shard if d is None} == {0}
    mix = by("mix")
    assert all((r["size"], r.taken) == (0, 0) for d, r in mix if d in (4, 5, 6))
    assert {d: r["size"] for d, r in mix if d in (1, 7, 9)} == {1: 120, 7: 2, 9: 6000} and len({r.target for d, r in mix if d == 3}) == 1
    rules = by("rules")
    assert all((r.n_words, r.word_chars, r.base_failed, r.kept) == (0, 0, True, False) for d, r in rules if d in (4, 5, 6))
    assert {(r.n_words, r.base_failed) for d, r in rules if d == 3} == {(120, False)}
    near = by("near")
    assert all((r.class_id, r.n_links, r.copies) == (d, 0, 1) for d, r in near if d in (4, 5, 6, 9, 11))
    assert sorted((d, r.class_id, r.n_links, r.copies) for d, r in near if d in (1, 2, 3)) == [(1, 1, 3, 3), (2, 1, 3, 1), (3, 1, 3, 3), (3, 1, 3, 3)]
    assert sorted((d, r.class_id, r.n_links) for d, r in near if d in (7, 8)) == [(7, 7, 1), (8, 7, 1)]
    lang = by("lang")
    assert {(r.lang_pred, r.score) for d, r in lang if d in (4, 5, 6, 11)} == {("und", 0.0)}
    assert {r.lang_pred for d, r in lang if d == 9} == {"en"}
    for name in ("quality", "toxic"):
        scores = by(name)
        assert all(0 <= r.score <= 1 and r.predicted in (0, 1) for _, r in scores)
        assert len({r.score for d, r in scores if d in (1, 3)}) == 1 and len({r.score for d, r in scores if d in (4, 5)}) == 1
    one = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in OPERATORS["one"](table(spark)).collect())
    assert [d for _, d in one] == [1, 4, 5, 6, 7, 9, 10, 11, 0]
    leaks = {(r.doc_id, r.item_id) for r in OPERATORS["leaks"](table(spark)).collect()}
    assert {(1, 3), (3, 1), (2, 1), (7, 8), (8, 7)} <= leaks and not {d for d, _ in leaks} & {4, 5, 6}
    clean = {r["doc_id"] for r in OPERATORS["clean"](table(spark)).collect()}
    assert clean == {r[0] for r in ROWS} - {7, 8}
    assert OPERATORS["license"](table(spark)).count() == 0


def test_shards(spark):
    rows = [(i, "x" * (i * 7 % 90), "en", "a") for i in range(400)]
    got = sharding.shard_by_bytes(table(spark, rows), 8).orderBy("doc_id").collect()
    sizes = collections.Counter()
    slots = collections.defaultdict(list)
    for r in got:
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert [r.shard for r in got] == sorted(r.shard for r in got)
    assert all(x == list(range(len(x))) for x in slots.values())
    assert max(sizes.values()) - min(sizes.values()) <= 200
    hot = sharding.shard_by_bytes(table(spark, [(1, "same", "en", "a")] * 300), 4)
    assert {r.n for r in hot.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()} == {75}


def test_targets_fill_up(spark):
    def targets(sizes, weights):
        rows = list(zip(range(len(sizes)), sizes, weights, strict=True))
        frame = spark.createDataFrame(rows, "id int, n long, weight int")
        return [r.target for r in mixing.with_targets(frame, 3).orderBy("id").collect()]

    assert targets([10, 10, 10], [5, 2, 1]) == [18.75, 7.5, 3.75]
    got = targets([1, 100, 100], [5, 2, 1])
    assert got[0] == 3.0 and abs(sum(got) - 201) < 1e-9 and abs(got[1] / got[2] - 2) < 1e-9
    assert targets([0, 5], [5, 2]) == [0.0, 5.0]
    assert targets([0], [5]) == [0.0] and targets([], []) == []


def test_mix_does_not_depend_on_the_layout_of_the_input(spark):
    rows = [(i // 3, prose(20 + i), "en", f"s{i % 11}" if i % 11 else None) for i in range(90)]
    docs = table(spark, rows)
    take = lambda d, mix=None: sorted(map(str, mixing.words_taken(d, mix).collect()))
    assert take(docs) == take(docs.orderBy(F.desc("text")).repartition(7))
    few = mixing.words_taken(docs, mixing.Mix(group=4)).groupBy("target").agg(F.sum("taken").alias("n")).collect()
    assert len(few) >= 3 and all(abs(r.target - r.n) <= 64 or r.n > r.target for r in few)


def test_mix_takes_what_it_should(spark):
    rows = [(i, prose(100), "en", "abc"[i % 3] if i else None) for i in range(60)]
    docs = table(spark, rows)
    got = mixing.words_taken(docs).collect()
    assert all(r.taken <= 3 * r["size"] for r in got)
    by_target = collections.Counter()
    for r in got:
        by_target[r.target] += r.taken
    assert all(abs(t - n) <= 64 for t, n in by_target.items())
    again = mixing.words_taken(docs).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    texts = mixing.mixed_texts(docs).collect()
    words = collections.Counter()
    for r in texts:
        words[r.doc_id] += len(r.text.split())
    assert words == collections.Counter({r.doc_id: r.taken for r in got if r.taken})


def test_a_chain_is_one_component_in_few_rounds(spark, monkeypatch):
    rounds = []
    keep = components.written
    monkeypatch.setattr(components, "written", lambda df, name: rounds.append(name) or keep(df, name))
    edges = spark.range(1000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    edges = edges.union(spark.createDataFrame([(5000, 5002), (5002, 5001)], edges.schema))
    got = components.connected_components(edges, "chain", finish=0)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, components.connected_components(edges).collect()))
    assert {(r.component, r.n) for r in got.groupBy("component").agg(F.count("*").alias("n")).collect()} == {(0, 1001), (5000, 3)}
    assert rounds.count("chain-hooked") < 20


def test_near_duplicates_recall_on_whole_tables(spark):
    """Every link that a comparison of all shingle sets finds is found."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in near_duplicates.near_duplicates(docs).collect()}
    sets, ids = {}, collections.defaultdict(list)
    for r in docs.collect():
        w = tuple((r.text or "").encode().split())
        ids[w].append(r.doc_id)
        sets[w] = {w[i : i + 5] for i in range(max(1, len(w) - 4))} if w else set()
    holders = collections.defaultdict(list)
    for w, own in sets.items():
        for x in own:
            holders[x].append(w)
    links = 0
    for w, own in sets.items():
        met = collections.Counter(o for x in own for o in holders[x] if o != w)
        near = [o for o, n in met.items() if 5 * n >= 4 * (len(own) + len(sets[o]) - n)]
        links += len(near)
        for k in ids[w]:
            assert got[k].n_text_links == len(near)
            assert got[k].n_links == (sum(len(ids[o]) for o in near) + len(ids[w]) - 1 if w else 0)
    assert links > 0


def test_near_duplicates_equal_brute_force(spark):
    rows, k = [], 0
    for _ in range(12):
        base = prose(_rnd.choice([4, 30, 80])).split()
        for _ in range(_rnd.randrange(1, 8)):
            words = list(base)
            for _ in range(_rnd.randrange(0, 3)):
                words[_rnd.randrange(len(words))] = prose(1, salt=0)
            rows.append((k, " ".join(words), "en", "a"))
            k += 1
    how = near_duplicates.Forest(block=3)  # several blocks in a component
    got = {r.doc_id: r for r in near_duplicates.near_duplicates(table(spark, rows), how).collect()}
    sets = []
    for r in rows:
        w = r[1].split()
        n = min(5, len(w))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)})
    label = list(range(len(rows)))
    for i in range(len(rows)):
        near = [j for j in range(len(rows)) if j != i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
        assert got[i].n_links == len(near)
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(i):
                if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    assert [got[i].class_id for i in range(len(rows))] == label
    kept = near_duplicates.keep_one_of_each(table(spark, rows), how)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(label))


def test_reordered_leaks_are_found_and_others_left(spark):
    item = prose(40, salt=0)
    words = item.split()
    shuffled = " ".join(words[20:]) + ". Then other text. " + " ".join(words[:20]).upper()
    docs = table(spark, [(1, prose(30) + " " + shuffled, "en", "a"), (2, prose(60), "en", "a"), (3, " ".join(words[:9]), "en", "a")])
    bench = spark.createDataFrame([(70, item), (71, None), (72, "?!")], "item_id long, text string")
    got = decontamination.contaminated(docs, bench).collect()
    assert [(r.doc_id, r.item_id, r.coverage) for r in got] == [(1, 70, 1.0)]
    assert [r.doc_id for r in decontamination.drop_contaminated(docs, bench).orderBy("doc_id").collect()] == [2, 3]
    tiny = decontamination.Tiling(block_bytes=50)
    assert decontamination.contaminated(docs, bench, tiny).count() == 1
    named = bench.select(F.concat(F.lit("item "), F.col("item_id").cast("string")).alias("item_id"), "text")
    assert [r.item_id for r in decontamination.contaminated(docs, named).collect()] == ["item 70"]


def test_chats(spark):
    rows = [
        (1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c"), (2, 0, "assistant", "x"), (3, 0, "SYSTEM ", "s"),
        (3, 1, "user", None), (4, 0, "bot", "q"), (4, 1, None, "r"), (None, 0, "user", "n"), (5, 0, "user", "u"), (5, 0, "user", "u"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")

    def chats(how=None):
        out = collections.defaultdict(str)
        for r in chat.format_chats(df, how).orderBy("conv_id", "piece").collect():
            out[r.conv_id] += r.rendered
        return out

    got = chats()
    assert got[1] == "<|user|>\na\n\nb<|end|>\n<|assistant|>\nc<|end|>\n"
    assert got[3] == "<|system|>\ns<|end|>\n<|user|>\n<|end|>\n<|assistant|>\n<|end|>\n"
    assert got[4] == "<|user|>\nq<|end|>\n<|assistant|>\nr<|end|>\n"
    assert got == chats(chat.Repair(fragment=1))
    assert chat.format_chats(df.limit(0)).count() == 0


def test_rules_reject_what_is_far_from_every_language(spark):
    rows = [(i, prose(150, salt=0.6), "en", "a") for i in range(30)] + [(90, prose(150).upper(), "en", "a"), (91, prose(10), "en", "a")]
    got = {r.doc_id: r for r in quality_rules.quality_rules(table(spark, rows)).collect()}
    assert all(got[i].kept for i in range(30))
    assert not got[90].kept and not got[90].base_failed and got[91].base_failed


def test_classifiers_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    for make, label, least in ((quality_classifier.quality_scores, "quality", 0.9), (toxicity.toxic_documents, "toxic", 0.85)):
        rows = make(docs, labels).join(labels, "doc_id").where("held_out").select("predicted", F.col(label).alias("y")).collect()
        assert sum(r.predicted == r.y for r in rows) / len(rows) >= least
    found = language_id.languages(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in found) / len(found) >= 0.97


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, sf), name)
        assert docs.columns == columns and docs.count() > 0
    got = corpus_pipeline.run(spark, sf)
    assert got.count() == docs.count()


def _covered(item, text, least=4):
    """Words of ``item`` that tiles cover, longest first, by trying all places."""
    item, text = (re.findall(r"\w+", x.lower()) for x in (item, text))
    least, n = min(least, len(item)), 0
    while least:
        best = (0, 0, 0)
        for i in range(len(item)):
            for d in range(len(text)):
                k = 0
                while i + k < len(item) and d + k < len(text) and item[i + k] == text[d + k] is not None:
                    k += 1
                best = max(best, (k, -i, -d))
        k, i, d = best[0], -best[1], -best[2]
        if k < least:
            break
        n += k
        item[i : i + k], text[d : d + k] = [None] * k, [None] * k
    return n / max(1, len(item))


def plain_permuted(key, index, size):
    """Four Feistel rounds over the least square that holds ``size``, walked until the result is inside; in whole numbers."""
    side = next(a for a in range(1, size + 1) if a * a >= size)
    while True:
        left, right = divmod(index, side)
        for turn in range(1, 5):
            x = (key + right * 0x9E3779B97F4A7C15 + turn * 0xD1B54A32D192ED03) % 2**64
            x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64
            x = (x ^ x >> 27) * 0x94D049BB133111EB % 2**64
            left, right = right, (left + (x ^ x >> 31) % side) % side
        index = left * side + right
        if index < size:
            return index


def test_permutations_equal_the_plain_one():
    for size in (1, 2, 7, 100, 1023):
        for key in (5, -7, 2**62):
            got = mixing.permuted(np.full(size, key), np.arange(size), np.full(size, size))
            assert got.tolist() == [plain_permuted(key, x, size) for x in range(size)]


def test_targets_of_small_sources_are_met(spark):
    """Every source ends within an even block of its target, down to a word."""
    sizes = [33, 1, 31, 32, 40, 65, 2, 33, 97, 33, 5, 64, 200, 33, 34, 63, 33, 500, 33, 7, 33, 33, 48, 33]
    rows = [(k * 100 + j, " ".join(["w"] * n), "en", f"s{k:02}") for k, whole in enumerate(sizes) for j, n in enumerate([whole // 2, whole - whole // 2])]
    got = mixing.words_taken(table(spark, rows)).collect()
    taken, target = collections.Counter(), {}
    for r in got:
        taken[r.doc_id // 100] += r.taken
        target[r.doc_id // 100] = r.target
        assert r.taken <= 3 * r["size"]
    for k, n in enumerate(sizes):
        block = -(-n // -(-n // 32))
        assert abs(taken[k] - target[k]) <= block / 2 + 1, (n, taken[k], target[k])


def test_pipeline_equals_a_plain_version(spark, tmp_path):
    """run() on a small folder against SQL and plain Python for each stage."""
    import duckdb

    _rnd.seed(8)  # the same texts whatever ran before
    item = "which " + prose(24, salt=0)
    good = [prose(80, salt=0.7) for _ in range(14)]
    leak = " ".join([prose(40, salt=0.9), *item.split()[12:], "and", *item.split()[:12]])
    near = good[0].split()
    near[-1] = "changed"
    texts = [*good, " ".join(near), good[1], leak, prose(9), None, "", prose(70).upper(), "same words here again " * 30]
    rows = [(i, x, "en", "abc"[i % 3] if i % 7 else None) for i, x in enumerate(texts)]
    (tmp_path / "sf").mkdir()
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        f"{tmp_path}/sf/documents.parquet"
    )
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/sf/benchmark.parquet")
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, f"{tmp_path}/sf").select("doc_id", "size", "text_crc32", "shard", "slot").collect())

    con = duckdb.connect()

    def asked(name, those):
        con.execute("create or replace table documents (doc_id bigint, text varchar, lang varchar, source varchar)")
        con.executemany("insert into documents values (?, ?, ?, ?)", those)
        return {r["doc_id"]: r for r in con.sql(ORACLE_SQL[name]).df().to_dict("records")}

    kept = asked("op9_quality_rules", rows)
    rows = [r for r in rows if kept[r[0]]["kept"]]
    assert {r[0] for r in rows} == {*range(17)}
    classes = asked("op6_near_duplicates", rows)
    rows = [r for r in rows if classes[r[0]]["class_id"] == r[0]]
    assert {r[0] for r in rows} == {*range(14), 16}
    rows = [r for r in rows if _covered(item, r[1]) < 0.5]
    assert {r[0] for r in rows} == {*range(14)}

    # Mixing: words of a source in order of doc_id, in blocks; the blocks that the slots name, pass by pass.
    mix = mixing.Mix()
    names = sorted({r[3] for r in rows}, key=lambda x: (x is None, x or ""))
    words = [[(r[0], w) for r in rows if r[3] == s for w in r[1].split()] for s in names]
    targets, open_ = [0.0] * len(names), set(range(len(names)))
    left = float(sum(map(len, words)))
    while open_:
        level = left / sum((5, 2, 1)[k % 3] for k in open_)
        full = {k for k in open_ if 3 * len(words[k]) <= level * (5, 2, 1)[k % 3]}
        for k in full or open_:
            targets[k] = min(3.0 * len(words[k]), level * (5, 2, 1)[k % 3])
        left -= sum(targets[k] for k in full)
        open_ = open_ - full if full else set()
    taken = collections.defaultdict(list)  # (doc_id, pass): its words
    for k, own in enumerate(words):
        n_blocks = -(-len(own) // mix.block_words)
        base, more = divmod(len(own), n_blocks)
        edges = [k * base + min(k, more) for k in range(n_blocks + 1)]
        blocks = [own[a:b] for a, b in zip(edges, edges[1:])]
        wanted = int(targets[k] * len(blocks) / len(own) + 0.5)
        for turn in range(-(-wanted // len(blocks))):
            n = min(len(blocks), wanted - turn * len(blocks))
            key = spark.range(1).select(F.xxhash64(F.lit(mix.seed), F.lit(k).cast("long"), F.lit(turn).cast("long"))).first()[0]
            drawn = [plain_permuted(key, x, len(blocks)) for x in range(n)]
            assert len(set(drawn)) == n
            for b in sorted(drawn):
                for doc_id, w in blocks[b]:
                    taken[doc_id, turn].append(w)
    whole = {r[0]: r[1] for r in rows}
    mixed = [(d, whole[d] if len(w) == len(whole[d].split()) else " ".join(w)) for (d, _), w in taken.items()]

    sized = sorted((d, zlib.crc32(x.encode()), len(x.encode()) + 8) for d, x in mixed)
    total, upto, want, slots = sum(x[2] for x in sized), 0, [], collections.Counter()
    for doc_id, crc, size in sized:
        upto += size
        shard = min((2 * upto - size) * 24 // (2 * total), 23)
        want.append((doc_id, size, crc, shard, slots[shard]))
        slots[shard] += 1
    assert got == sorted(want)
