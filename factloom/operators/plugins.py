"""Functions that a user plugs in: extractors, normalizers of labels, embedders, answer generators.

A plug-in takes a pandas DataFrame and returns one; Spark hands it Arrow batches, so it sees some thousand rows at once
and never a whole table. What it returns is cast to the schema asked for; columns that it lacks are null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Plugin = Callable[[pd.DataFrame], pd.DataFrame]
FACTS = "relation string, roles map<string,string>, kind string, confidence double"


def apply_batched(df: DataFrame, plugin: Plugin, schema: str) -> DataFrame:
    """A plug-in over batches of rows; a batch without a result gives no rows."""
    names = [c.strip().split(" ")[0] for c in _fields(schema)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = plugin(batch)
            if len(made):
                yield pd.DataFrame({c: _nulls(made[c]) if c in made.columns else [None] * len(made) for c in names})

    return df.mapInPandas(run, schema)


def _nulls(column: pd.Series) -> pd.Series:
    """A column of objects with None where a value is missing."""
    return column.reset_index(drop=True).astype(object).where(column.reset_index(drop=True).notna(), None) if column.dtype == object else column.reset_index(drop=True)


def _fields(schema: str) -> list[str]:
    """Fields of a schema string; commas inside brackets don't part them."""
    depth, out = 0, [""]
    for c in schema:
        depth += (c in "<(") - (c in ">)")
        if c == "," and depth == 0:
            out.append("")
        else:
            out[-1] += c
    return out


def extract_facts(texts: DataFrame, extractor: Plugin) -> DataFrame:
    """``text_id, relation, roles, kind, confidence`` from texts ``text_id, text``; null texts are not asked about."""
    kind = texts.schema["text_id"].dataType.simpleString()
    return apply_batched(texts.select("text_id", "text").filter("text is not null"), extractor, f"text_id {kind}, {FACTS}")


def extract_or_report(texts: DataFrame, extractor: Plugin) -> DataFrame:
    """As ``extract_facts``, text by text, with an ``error``: a text that the extractor fails on gives one row with the
    error and no fact, and the others are kept."""

    def guarded(batch: pd.DataFrame) -> pd.DataFrame:
        made: list[dict] = []
        for at in range(len(batch)):
            one = batch.iloc[at : at + 1]
            try:
                made += extractor(one).to_dict("records")
            except Exception as error:  # the plug-in's own failure is this function's result
                made.append({"text_id": one["text_id"].iloc[0], "error": f"{type(error).__name__}: {error}"})
        return pd.DataFrame(made)

    kind = texts.schema["text_id"].dataType.simpleString()
    return apply_batched(texts.select("text_id", "text").filter("text is not null"), guarded, f"text_id {kind}, {FACTS}, error string")


def normalize_external(labels: DataFrame, normalizer: Plugin) -> DataFrame:
    """``raw, canonical, confidence`` of a plug-in, asked once for each distinct label; confidence is kept in [0, 1].

    The plug-in takes ``raw`` and returns ``raw, canonical, confidence``; a label without an answer has no row.
    """
    said = labels.select("raw").filter("raw is not null").distinct()
    made = apply_batched(said, normalizer, "raw string, canonical string, confidence double").filter("canonical <> ''")
    return made.withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(0.0)))))


def embed(df: DataFrame, embedder: Plugin, text_col: str = "text") -> DataFrame:
    """``df`` with ``embedding``; equal texts are embedded once. The plug-in takes ``text`` and returns ``text, embedding``.

    Texts meet their vectors by hash and by themselves; null texts get a null vector.
    """
    said = df.select(F.col(text_col).alias("text")).filter("text is not null").distinct()
    made = apply_batched(said, embedder, "text string, embedding array<double>").select(F.col("text").alias("_text"), "embedding")
    kept = df.drop("embedding")
    return kept.join(made, F.col(text_col) == F.col("_text"), "left").drop("_text")


def answer(questions: DataFrame, contexts: DataFrame, generator: Plugin) -> DataFrame:
    """``question_id, answer``: a generator over ``question_id, question, context``, where the context is what was
    retrieved (``question_id, rank, body``) in order; a question without context gets an empty one."""
    joined = contexts.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("rank", "body"))).alias("all"))
    asked = questions.select("question_id", "question").join(joined, "question_id", "left").select("question_id", "question", F.coalesce(F.array_join(F.col("all.body"), "\n\n"), F.lit("")).alias("context"))
    kind = questions.schema["question_id"].dataType.simpleString()
    return apply_batched(asked, generator, f"question_id {kind}, answer string")
