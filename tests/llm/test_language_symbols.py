"""Letters keep their code points, also beyond U+FFFF; other signs there are not letters."""

import numpy as np

from terrapipe.llm import language_id


def test_only_letters_count():
    assert not language_id.letters("\U0001f600\U0001f601").any()
    assert language_id.letters("A\U0001f600b").tolist() == [97, 0, 98]
    assert language_id.letters("\U00010330\U00010331").tolist() == [0x10330, 0x10331]


def test_alphabet():
    found = language_id.letters("aab \U00010330 ccc d")
    whole, most = language_id.Alphabet.of(found, 254), language_id.Alphabet.of(found, 2)
    assert whole(language_id.letters("a b\U00010330z\U00010331")).tolist() == [1, 0, 2, 5, 255, 255]
    assert most(np.array([0, 97, 98, 99], np.uint32)).tolist() == [0, 1, 255, 2]


def test_scripts_are_told_apart(spark):
    words = ("the cat sat on the mat", "\u03b3\u03b1\u03c4\u03b1 \u03ba\u03b1\u03b9 \u03c3\u03ba\u03c5\u03bb\u03bf\u03c2")
    rows = [(i, words[i % 2] * 3, ("en", "el")[i % 2]) for i in range(60)] + [(900, "\u03c4\u03b1 \u03b3\u03b1", None), (901, "that cat", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in language_id.languages(docs).where("doc_id >= 900").collect()}
    assert got[900] == "el" and got[901] == "en"


def test_emoji_only_is_und(spark):
    words = ("the cat sat on the mat", "le chat est sur le tapis")
    rows = [(i, words[i % 2] * 3, ("en", "fr")[i % 2]) for i in range(200)] + [(900, "\U0001f600\U0001f601\U0001f602 \U0001f680", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language_id.languages(docs).where("doc_id = 900").first()
    assert (got.lang_pred, got.score) == ("und", 0.0)
