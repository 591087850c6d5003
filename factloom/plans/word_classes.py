"""Registered queries of heads and seeds by a table of word classes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import word_classes
from .purchase import table
from .registered import query

STOP = ["the", "of", "and"]
#: Words of part names by their length: nouns, adjectives, verbs, and some that no table knows; lemmas are their first five letters.
_LEX = "lex AS (SELECT DISTINCT tok AS word, CASE length(tok) % 4 WHEN 0 THEN 'noun' WHEN 1 THEN 'adjective' WHEN 2 THEN 'verb' END AS class, left(tok, 5) AS lemma FROM (SELECT unnest(string_split(lower(p_name), ' ')) AS tok FROM part) WHERE length(tok) % 4 <> 3)"
_JUDGED = "j AS (SELECT id, pos, coalesce(lemma, tok) AS lemma, coalesce(class = 'noun', NOT regexp_matches(tok, '^[a-z]{3,}ly$')) AS head FROM w LEFT JOIN lex ON word = tok WHERE tok NOT IN ('the', 'of', 'and') AND (regexp_matches(tok, '^[0-9]+$') OR length(tok) >= 2 AND regexp_matches(tok, '^[a-z0-9_-]+$')) AND coalesce(class <> 'verb', true))"


def classes(spark, d):
    token = table(spark, d, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("word")).distinct()
    k = F.length("word") % 4
    return token.withColumn("class", F.when(k == 0, "noun").when(k == 1, "adjective").when(k == 2, "verb")).withColumn("lemma", F.substring("word", 1, 5)).filter("class is not null")


@query("t4_word_classes", f"WITH {_LEX}, f AS (SELECT p_partkey AS id, string_split('the ' || lower(p_name) || ' of ' || lower(p_type) || ' ' || p_size, ' ') AS t FROM part), w AS (SELECT id, unnest(t) AS tok, unnest(range(len(t))) AS pos FROM f), {_JUDGED}, g AS (SELECT id, list(lemma ORDER BY pos) AS kept, coalesce(list(lemma ORDER BY pos) FILTER (head), []) AS heads FROM j GROUP BY 1), c AS (SELECT id, heads, CASE WHEN len(kept) > 4 THEN heads ELSE kept END AS ch FROM g), k AS (SELECT id, heads, ch[greatest(1, len(ch) - 3):] AS ch FROM c) SELECT f.id AS p_partkey, CASE WHEN len(heads) > 0 AND len(ch) = len(list_distinct(ch)) THEN upper(array_to_string(ch, '_')) END AS head FROM f LEFT JOIN k USING (id)")
def t4(spark, d):
    filler = F.concat(F.lit("the "), "p_name", F.lit(" of "), "p_type", F.lit(" "), "p_size")
    fillers = table(spark, d, "part").select(F.col("p_partkey").alias("text_id"), filler.alias("filler"))
    return word_classes.head_entities(fillers, classes(spark, d), STOP).withColumnRenamed("text_id", "p_partkey")


@query("t19_seed_lemmas", rf"WITH {_LEX}, f AS (SELECT doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+') AS t FROM documents), w AS (SELECT id, unnest(t) AS tok, unnest(range(len(t))) AS pos FROM f), {_JUDGED.replace('[a-z0-9_-]', chr(91) + chr(92) + 'p{L}' + chr(92) + 'p{N}_-]').replace('[a-z]{3,}', chr(92) + 'p{L}{3,}')}, s AS (SELECT id, lemma AS token, min(pos) AS pos FROM j WHERE head GROUP BY 1, 2) SELECT id AS doc_id, rank, token FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos, token) AS rank FROM s) WHERE rank <= 8")
def t19(spark, d):
    """The first eight lemmas of each document, which is what the operator is for."""
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("text_id"), "text")
    return word_classes.seed_words(texts, classes(spark, d), STOP).withColumnRenamed("text_id", "doc_id")
