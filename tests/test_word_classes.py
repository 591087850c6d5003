"""Word classes of a user's table."""

from pyspark.sql import functions as F

from factloom.operators import word_classes as wc

CLASSES = [("cars", "noun", "car"), ("Red", "adjective", "red"), ("runs", "verb", "run"), ("runs", "noun", "run"), ("sees", "verb", "see"), ("she", "pronoun", "she"), ("anna", "name", None), (None, "noun", "x"), ("odd", None, "odd")]


def heads(spark, fillers, **more):
    table = spark.createDataFrame(CLASSES, "word string, class string, lemma string")
    rows = spark.createDataFrame(list(enumerate(fillers)), "text_id long, filler string").withColumn("lemma", F.lit("clash"))
    return [r.head for r in wc.head_entities(rows, table, ["the"], **more).orderBy("text_id").collect()]


def test_heads(spark):
    assert heads(spark, ["the red cars", "Red", "sees", "she sees", "ANNA sees 7 cars", None, "", "the runs", "cars car", "unknown quickly", "quickly"]) == ["RED_CAR", None, None, None, "ANNA_7_CAR", None, None, "RUN", None, "UNKNOWN_QUICKLY", None]
    assert heads(spark, ["she sees", "red she"], pronouns=True) == ["SHE", "RED_SHE"]
    # of more than four words the last nouns stay
    assert heads(spark, ["red a1 red a2 red a3 a4 a5", "red red red red red"]) == ["A2_A3_A4_A5", None]


def test_frequent_words_are_dealt(spark):
    table = spark.createDataFrame(CLASSES, "word string, class string, lemma string")
    tokens = spark.createDataFrame([(i, p, w) for i in range(200) for p, w in enumerate(("cars", f"w{i}", "sees", None))], "text_id long, pos int, word string")
    rows = lambda limit: sorted(map(str, wc.classified(tokens, table, ["the"], hub_rows=limit).collect()))
    assert rows(50) == rows(10_000) and len(rows(50)) == 800


def test_seeds(spark):
    table = spark.createDataFrame(CLASSES, "word string, class string, lemma string")
    texts = spark.createDataFrame([(1, "Anna sees red cars, cars and 9 runs"), (2, None), (3, "")], "text_id long, text string")
    got = [(r.text_id, r["rank"], r.token) for r in wc.seed_words(texts, table, ["and"], 3).orderBy("text_id", "rank").collect()]
    assert got == [(1, 1, "anna"), (1, 2, "car"), (1, 3, "9")]
    assert wc.seed_words(texts, table.limit(0), ["and"], 1).first().token == "anna"
