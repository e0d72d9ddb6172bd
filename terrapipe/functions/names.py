"""Region names: folding, states, aliases, districts from file names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Code, name, kind of the 36 states and union territories.
STATES = (
    ("AP", "Andhra Pradesh", "state"), ("AR", "Arunachal Pradesh", "state"), ("AS", "Assam", "state"),
    ("BR", "Bihar", "state"), ("CT", "Chhattisgarh", "state"), ("GA", "Goa", "state"), ("GJ", "Gujarat", "state"),
    ("HR", "Haryana", "state"), ("HP", "Himachal Pradesh", "state"), ("JH", "Jharkhand", "state"),
    ("KA", "Karnataka", "state"), ("KL", "Kerala", "state"), ("MP", "Madhya Pradesh", "state"),
    ("MH", "Maharashtra", "state"), ("MN", "Manipur", "state"), ("ML", "Meghalaya", "state"),
    ("MZ", "Mizoram", "state"), ("NL", "Nagaland", "state"), ("OD", "Odisha", "state"), ("PB", "Punjab", "state"),
    ("RJ", "Rajasthan", "state"), ("SK", "Sikkim", "state"), ("TN", "Tamil Nadu", "state"),
    ("TG", "Telangana", "state"), ("TR", "Tripura", "state"), ("UP", "Uttar Pradesh", "state"),
    ("UT", "Uttarakhand", "state"), ("WB", "West Bengal", "state"),
    ("AN", "Andaman and Nicobar Islands", "union_territory"), ("CH", "Chandigarh", "union_territory"),
    ("DH", "Dadra and Nagar Haveli and Daman and Diu", "union_territory"), ("DL", "Delhi", "union_territory"),
    ("JK", "Jammu and Kashmir", "union_territory"), ("LA", "Ladakh", "union_territory"),
    ("LD", "Lakshadweep", "union_territory"), ("PY", "Puducherry", "union_territory"),
)
#: Folded former spellings of states.
ALIASES = {
    "arunchalpradesh": "AR", "chattisgarh": "CT", "maharastra": "MH", "orissa": "OD", "uttarkhand": "UT",
    "jammukashmir": "JK", "andamannicobarislands": "AN",
}


def fold(name: Column) -> Column:
    """The key of a region name: no leading digits, lower case, letters and digits only."""
    return F.regexp_replace(F.lower(F.regexp_replace(F.trim(name), r"^\d+", "")), "[^a-z0-9]+", "")


def slug(name: Column) -> Column:
    """Lower case, runs of other characters as one hyphen."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def _key(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", "")


#: What parts the words of a file name; serials, dates and codes; words that say nothing.
WORD_GAP = r"[-_\s]+"
CODE = r"^[A-Za-z]{1,6}\d+$"
DATE = r"^\d{1,4}[.\-/]\d{1,2}[.\-/]\d{2,4}\.?$"
JUNK = ("draft", "plan")


def state_words(spelling: Column) -> Column:
    """The folded words of a spelling of a state."""
    return F.filter(F.transform(F.split(spelling, WORD_GAP), _key), lambda t: t != "")


def prefixes(words: DataFrame) -> DataFrame:
    """(state, prefix) of a table (state, word): whatever may stand in front of a file name for the state.

    Words and all their beginnings of two letters or more, once each: a few hundred rows, so that
    looking up the beginning of a word is a join on equality.
    """
    ends = F.sequence(F.least(F.lit(2), F.length("word")), F.length("word"))
    one = words.select("state", "word", F.explode(ends).alias("n"))
    return one.select("state", F.substring("word", F.lit(1), F.col("n")).alias("prefix")).distinct()


def districts_of_files(files: DataFrame, words: DataFrame) -> DataFrame:
    """``files`` (file_id, stem, state) with ``district``: the stem without what stands for the state in front, serials, dates, codes and boilerplate.

    Leading words go as long as they are a serial, a code, or a beginning of a word of the state
    (``words``: state, word); only leading ones, as a district may bear its state's name. Words of all capitals
    become capitalised. Where nothing is left, the district is the stem itself; so it is for a null state. file_id is
    unique; a null stem has a null district.
    """
    token = files.select("file_id", "state", F.posexplode(F.filter(F.split("stem", WORD_GAP), lambda t: t != "")).alias("pos", "t"))
    bare = F.regexp_replace(_key(F.col("t")), r"\d+$", "")
    asked = token.select("file_id", "state", "pos", F.explode(F.array_distinct(F.array(_key(F.col("t")), bare))).alias("prefix"))
    of_state = asked.join(prefixes(words), ["state", "prefix"]).select("file_id", "pos").distinct().withColumn("hit", F.lit(True))
    serial = (_key(F.col("t")) == "") | _key(F.col("t")).rlike(r"^\d+$") | F.col("t").rlike(CODE)
    token = token.join(of_state, ["file_id", "pos"], "left").withColumn("front", F.coalesce("hit", F.lit(False)) | serial)
    trimmed = F.regexp_replace(F.regexp_replace("t", r"^\d+", ""), r"^\.+|\.+$", "")
    kept = (F.length(trimmed) >= 3) & ~trimmed.rlike(r"^\d+$") & ~F.col("t").rlike(DATE) & ~F.col("t").rlike(CODE) & ~F.lower(trimmed).isin(*JUNK)
    plain = F.replace(trimmed, F.lit("."), F.lit(""))
    capital = F.concat(F.upper(F.substring(plain, 1, 1)), F.lower(F.substr(plain, F.lit(2))))
    shown = F.when((F.upper(plain) == plain) & (F.lower(plain) != plain), capital).otherwise(plain)
    whole = token.groupBy("file_id").agg(
        F.min(F.when(~F.col("front"), F.col("pos"))).alias("first_"),
        F.array_sort(F.collect_list(F.when(kept, F.struct("pos", shown.alias("word"))))).alias("words_"),
    )
    rest = F.transform(F.filter("words_", lambda x: x["pos"] >= F.col("first_")), lambda x: x["word"])
    return (
        files.join(whole, "file_id", "left")
        .withColumn("district", F.when(F.size(rest) > 0, F.array_join(rest, " ")).otherwise(F.col("stem")))
        .drop("first_", "words_")
    )
