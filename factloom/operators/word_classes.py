"""Entity words and heads of fillers by a user's table of word classes and lemmas."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import hubs as hub_joins
from .ingest import entity_token, nounish, too_wide

# Classes of which a role can be filled, and those that can be its head. Pronouns only where they are allowed.
ENTITY = ("noun", "name", "adjective", "numeral")
HEAD = ("noun", "name")


def lexicon(classes: DataFrame) -> DataFrame:
    """``word, fills, heads, pronoun, lemma``, a row per lower-case word of ``word, class`` (and ``lemma``, else the word itself).

    A word of several classes has what any of them allows, and the lemma of the first that can be a head, else that can
    fill a role, else any; ties go by the lemma. Rows without a word or class are left out.
    """
    rows = classes.select(F.lower(F.trim("word")).alias("word"), F.lower("class").alias("class"), F.lower("lemma" if "lemma" in classes.columns else "word").alias("lemma")).filter("word <> '' and class is not null")
    fills, heads = F.col("class").isin(*ENTITY), F.col("class").isin(*HEAD)
    first = F.when(heads, 0).when(fills, 1).otherwise(2)
    return rows.groupBy("word").agg(F.max(fills).alias("fills"), F.max(heads).alias("heads"), F.max(F.col("class") == "pronoun").alias("pronoun"), F.min(F.struct(first, F.coalesce("lemma", "word"))).alias("l")).select("word", "fills", "heads", "pronoun", F.col("l")["col2"].alias("lemma"))


def classified(tokens: DataFrame, classes: DataFrame, stop: list[str], pronouns: bool = False, hub_rows: int = hub_joins.HUB_ROWS) -> DataFrame:
    """``tokens`` (``text_id, pos, word``) with ``lemma, entity, nounish``; words go lower-case.

    Numbers always count, stop words never do (but for pronouns, if allowed). A word of the table is judged by its
    classes, any other as without a table (:func:`ingest.entity_token`, :func:`ingest.nounish`). The table is joined by
    word; frequent words are dealt among tasks.
    """
    tokens = tokens.withColumn("word", F.lower("word"))
    known = hub_joins.join(tokens, lexicon(classes), ["word"], hub_joins.measure(tokens, "word", hub_rows), "text_id", "left")
    number, said = F.col("word").rlike(r"^\d+$"), F.coalesce(F.col("pronoun"), F.lit(False)) & F.lit(pronouns)
    may = entity_token(F.col("word"), stop)
    entity = number | said | (may & F.coalesce("fills", F.lit(True)))
    head = number | said | (may & F.coalesce(F.col("heads"), nounish(F.col("word"))))
    return known.withColumn("entity", entity).withColumn("nounish", entity & head).withColumn("lemma", F.coalesce("lemma", "word")).drop("fills", "heads", "pronoun")


def head_entities(fillers: DataFrame, classes: DataFrame, stop: list[str], parts: int = 4, pronouns: bool = False) -> DataFrame:
    """``text_id, head``: key of a filler's entity lemmas, of more than ``parts`` the last nouns among them; null without a noun.

    Fillers are ``text_id, filler``; one that is null or has no words has a null head. Ids are distinct. A key that
    repeats a lemma is null, as it is too wide for a name.
    """
    tokens = fillers.select("text_id", F.posexplode(F.regexp_extract_all(F.lower("filler"), F.lit(r"[^\s_]+"), F.lit(0))).alias("pos", "word"))
    kept = classified(tokens, classes, stop, pronouns).filter("entity")
    held = kept.groupBy("text_id").agg(F.sort_array(F.collect_list(F.struct("pos", "lemma", "nounish"))).alias("kept"))
    heads = F.filter("kept", lambda w: w["nounish"])
    chosen = F.when(F.size("kept") > parts, heads).otherwise(F.col("kept"))
    last = F.slice(chosen, F.greatest(F.lit(1), F.size(chosen) - parts + 1), F.lit(parts))
    key = F.upper(F.array_join(F.transform(last, lambda w: w["lemma"]), "_"))
    found = held.select("text_id", F.when((F.size(heads) > 0) & ~too_wide(key, parts), key).alias("head"))
    return fillers.select("text_id").join(found, "text_id", "left")


def seed_words(texts: DataFrame, classes: DataFrame, stop: list[str], n: int = 8, pronouns: bool = False) -> DataFrame:
    """``text_id, rank, token``: lemmas of the first n distinct words of each text that can be heads."""
    tokens = texts.select("text_id", F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))).alias("pos", "word"))
    first = classified(tokens, classes, stop, pronouns).filter("nounish").groupBy("text_id", F.col("lemma").alias("token")).agg(F.min("pos").alias("pos"))
    rank = F.row_number().over(Window.partitionBy("text_id").orderBy("pos", "token"))
    return first.withColumn("rank", rank).filter(F.col("rank") <= n).select("text_id", "rank", "token")
