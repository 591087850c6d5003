"""Graph snapshots, checked JSON lines, CSV, whole texts, edge export and redaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructType

PARTS = ("nodes", "links", "relations", "factors", "incidence", "events", "state")
NODE = "struct<props:map<string,string>, forms:array<string>, label:string, created_tau:bigint>"
LINK = "struct<type:string, e1:string, e2:string, w:double>"
FACTOR = "struct<fid:string, kind:string, relation:string, w:double, confidence:double, roles:map<string,string>>"
EVENT = "struct<event_uid:string, relation:string, span:string, tau:bigint>"
SNAPSHOT = (
    "id string, name string, kind string, store struct<tau:bigint, revision:bigint, uid_seq:bigint, "
    + ", ".join(f"{s}:map<string,{NODE}>" for s in "SCPH")
    + f", L:map<string,{LINK}>, relations:map<string,struct<arity:int, flags:array<string>>>, semantic_factors:array<{FACTOR}>, events:array<{EVENT}>, state:map<string,string>>"
)
KINDS = ("hyper", "pair", "obs", "prior")


def read_snapshots(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The typed parts of graph snapshots, one JSON document per file; each row carries its ``graph_id``.

    Missing values get defaults (weights and confidences 1, ticks 0), an unknown kind of factor is hyper.
    """
    raw = spark.read.schema(SNAPSHOT).option("multiLine", True).json(path).withColumnRenamed("id", "graph_id")
    part = lambda c: raw.select("graph_id", F.explode(f"store.{c}"))
    sections = None
    for section in "SCPH":
        rows = part(section).select("graph_id", F.lit(section).alias("section"), F.col("key").alias("uid"), "value.props", F.coalesce("value.forms", F.array().cast("array<string>")).alias("forms"), "value.label", F.coalesce("value.created_tau", F.lit(0)).alias("created_tau"))
        sections = rows if sections is None else sections.unionByName(rows)
    one = lambda c: F.coalesce(F.col(c), F.lit(1.0))
    factors = part("semantic_factors").select("graph_id", "col.*")
    kind = F.when(F.col("kind").isin(*KINDS), F.col("kind")).otherwise("hyper")
    return {
        "graphs": raw.select("graph_id", "name", "kind", *[F.coalesce(f"store.{c}", F.lit(0)).alias(c) for c in ("tau", "revision", "uid_seq")]),
        "nodes": sections,
        "links": part("L").select("graph_id", F.col("key").alias("uid"), F.coalesce("value.type", F.lit("ASSOC")).alias("type"), "value.e1", "value.e2", one("value.w").alias("w")),
        "relations": part("relations").select("graph_id", F.col("key").alias("canonical"), F.coalesce("value.arity", F.lit(2)).alias("arity"), "value.flags"),
        "factors": factors.select("graph_id", "fid", kind.alias("kind"), "relation", one("w").alias("w"), one("confidence").alias("confidence")),
        "incidence": factors.select("graph_id", "fid", F.explode("roles").alias("role", "uid")),
        "events": part("events").select("graph_id", "col.*"),
        "state": part("state").select("graph_id", "key", "value"),
    }


def write_tables(tables: dict[str, DataFrame], path: str) -> None:
    """Each part as Parquet, split by graph."""
    for name, df in tables.items():
        df.write.mode("overwrite").partitionBy("graph_id").parquet(f"{path}/{name}")


def read_tables(spark: SparkSession, path: str, names: tuple[str, ...] = ("graphs", *PARTS)) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}


def graph_catalog(tables: dict[str, DataFrame]) -> DataFrame:
    """``graph_id, name, kind, nodes, links, factors, size``: fixtures first, then by name."""
    out = tables["graphs"].select("graph_id", "name", "kind")
    for part in ("nodes", "links", "factors"):
        counts = tables[part].groupBy("graph_id").agg(F.count("*").alias(part))
        out = out.join(counts, "graph_id", "left").withColumn(part, F.coalesce(part, F.lit(0)))
    return out.withColumn("size", F.col("nodes") + F.col("links") + F.col("factors")).orderBy(F.col("kind") != "fixture", "name", "graph_id")


def read_jsonl(spark: SparkSession, path: str, schema: StructType, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """Good rows, and rejected lines ``line, reason``: not an object, unknown or missing keys, blank or mistyped required values."""
    lines = spark.read.text(path).select(F.col("value").alias("line")).filter(F.trim("line") != "")
    known = F.array(*[F.lit(f.name) for f in schema.fields])
    keys, row = F.json_object_keys("line"), F.from_json("line", schema)
    read = lines.withColumn("keys", keys).withColumn("row", row)
    blank = F.lit(False)
    for name in required:
        plain = isinstance(schema[name].dataType, StringType)
        value = F.col(f"row.{name}")
        blank = blank | (F.coalesce(F.trim(value), F.lit("")) == "" if plain else value.isNull())
    reason = (
        F.when(F.col("keys").isNull(), "not an object")
        .when(F.size(F.array_except("keys", known)) > 0, "unknown key")
        .when(F.size(F.array_except(F.array(*[F.lit(r) for r in required]).cast("array<string>"), "keys")) > 0, "missing key")
        .when(blank, "blank value")
    )
    checked = read.withColumn("reason", reason)
    return checked.filter("reason is null").select("row.*"), checked.filter("reason is not null").select("line", "reason")


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """``path, text`` of whole files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def edges(members: DataFrame, links: DataFrame) -> DataFrame:
    """``source, target, kind, directed``: incidence edges of factors and binary links; IS-A and FOLLOW are directed."""
    inc = members.select(F.col("fid").alias("source"), F.col("uid").alias("target"), F.col("role").alias("kind"), F.lit(False).alias("directed"))
    return inc.unionByName(links.select(F.col("e1").alias("source"), F.col("e2").alias("target"), F.col("type").alias("kind"), F.col("type").isin("IS-A", "FOLLOW").alias("directed")))


def top_nodes(nodes: DataFrame, members: DataFrame, n: int) -> DataFrame:
    """The ``n`` nodes (``uid, x``) for a drawing: members of factors first, then by activation."""
    held = members.select("uid").distinct().withColumn("held", F.lit(True))
    order = [F.col("held").isNull(), F.col("x").desc(), F.col("uid")]
    return nodes.join(held, "uid", "left").orderBy(*order).limit(n).drop("held")


def redact(df: DataFrame, secret: list[str], mask: str = "***") -> DataFrame:
    """Values under secret names replaced at any depth of structs, maps and arrays; names compare without case."""
    names = [s.lower() for s in secret]

    def clean(c: Column, kind) -> Column:
        if isinstance(kind, StructType):
            fields = [(F.lit(mask) if f.name.lower() in names else clean(c[f.name], f.dataType)).alias(f.name) for f in kind.fields]
            return F.when(c.isNotNull(), F.struct(*fields))
        if isinstance(kind, ArrayType):
            return F.transform(c, lambda x: clean(x, kind.elementType))
        if isinstance(kind, MapType):
            if isinstance(kind.valueType, StringType):
                return F.transform_values(c, lambda k, v: F.when(F.lower(k).isin(*names), mask).otherwise(v))
            return F.transform_values(c, lambda k, v: clean(v, kind.valueType))
        return c

    return df.select(*[(F.lit(mask) if f.name.lower() in names else clean(F.col(f.name), f.dataType)).alias(f.name) for f in df.schema.fields])
