"""Districts from file names by a join on beginnings of words."""

from pyspark.sql import functions as F

from terrapipe.functions import names

STEMS = (
    ("UP12-Ballia_Sadar-03.02.15", "Uttar Pradesh", "Ballia Sadar"), ("Orissa_9-_Nuapada_12.06.2010", "Orissa", "Nuapada"),
    ("A_N_2-Diglipur-21.09.2013", "Andaman and Nicobar Islands", "A N 2-Diglipur-21.09.2013"), ("4South_Goa", "Goa", "South Goa"),
    ("Rajasthan8-Bundi-9.1.2011", "Rajasthan", "Bundi"), ("CHH5-Bastar_draft_plan-02.03.13", "Chhattisgarh", "Bastar"),
    ("PUNJAB_2-MOGA_17.08.2012", "Punjab", "Moga"), ("77-08", "Bihar", "77-08"), ("GUJ_14-Dahod", "Gujarat", "Dahod"),
    ("Goa_North_Goa", "Goa", "North Goa"), (None, "Goa", None), ("Lone", None, "Lone"), ("", "Goa", ""),
)


def test_districts_of_files(spark):
    files = spark.createDataFrame([(i, s, st) for i, (s, st, _) in enumerate(STEMS)], "file_id int, stem string, state string")
    words = files.where("state is not null").select("state", F.explode(names.state_words(F.col("state"))).alias("word")).distinct()
    got = {r.file_id: r.district for r in names.districts_of_files(files, words).collect()}
    want = {i: d for i, (_, _, d) in enumerate(STEMS)}
    want[2] = "Diglipur"
    assert got == want


def test_prefixes_are_those_of_two_letters_and_the_words(spark):
    words = spark.createDataFrame([("X", "goa"), ("X", "a"), ("Y", "go")], "state string, word string")
    assert sorted(map(tuple, names.prefixes(words).collect())) == [("X", "a"), ("X", "go"), ("X", "goa"), ("Y", "go")]
