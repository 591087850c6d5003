"""Registered queries of the scalar functions, by family."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as fn
from .purchase import table
from .registered import query


@query("sc1_case_folding", r"SELECT p_partkey, trim(regexp_replace(translate(lower(p_brand || '_' || p_type || '—' || p_name), '_-–—', '    '), '\s+', ' ', 'g')) AS folded, trim(regexp_replace(upper(p_brand || '_' || p_name), '[^A-Z0-9]+', '_', 'g'), '_') AS label FROM part")
def sc1(spark, d):
    said = F.concat("p_brand", F.lit("_"), "p_type", F.lit("—"), "p_name")
    return table(spark, d, "part").select("p_partkey", fn.fold(said).alias("folded"), fn.canonical_label(F.concat("p_brand", F.lit("_"), "p_name")).alias("label"))


@query("sc2_regex", "SELECT doc_id, len(regexp_extract_all(t, '[A-Za-z0-9]+')) AS words, len(regexp_split_to_array(t, '[.!?]+')) AS sentences, regexp_matches(t, '(^|[^a-z])the([^a-z]|$)') AS has_the, regexp_extract(t, '([A-Za-z]+)[.]', 1) AS closing FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)")
def sc2(spark, d):
    t = F.coalesce("text", F.lit(""))
    return table(spark, d, "documents").select(
        "doc_id",
        F.size(F.regexp_extract_all(t, F.lit("[A-Za-z0-9]+"), F.lit(0))).cast("long").alias("words"),
        F.size(F.split(t, "[.!?]+")).cast("long").alias("sentences"),
        t.rlike("(^|[^a-z])the([^a-z]|$)").alias("has_the"),
        F.regexp_extract(t, "([A-Za-z]+)[.]", 1).alias("closing"),
    )


@query("sc3_substrings", "SELECT p_partkey, substr(p_brand, 7) AS no, left(p_name, 4) AS start, right(p_name, 3) AS ending, contains(p_name, 'ring') AS ring, starts_with(p_brand, 'Brand#1') AS first_brands FROM part")
def sc3(spark, d):
    name, brand = F.col("p_name"), F.col("p_brand")
    return table(spark, d, "part").select("p_partkey", F.substring(brand, 7, 100).alias("no"), F.left(name, F.lit(4)).alias("start"), F.right(name, F.lit(3)).alias("ending"), name.contains("ring").alias("ring"), brand.startswith("Brand#1").alias("first_brands"))


@query("sc4_template", "SELECT p_partkey, p_name || ' is ' || lower(p_type) || ' by  for {BUYER}' AS said FROM part")
def sc4(spark, d):
    roles = F.create_map(F.lit("OBJECT"), F.col("p_name"), F.lit("KIND"), F.lower("p_type"), F.lit("MAKER"), F.lit(None).cast("string"))
    return table(spark, d, "part").select("p_partkey", fn.fill_template(F.lit("{OBJECT} is {KIND} by {MAKER} for {BUYER}"), roles).alias("said"))


@query("sc5_joined", "SELECT p_brand, string_agg(DISTINCT p_type, ' | ' ORDER BY p_type) AS types, string_agg(DISTINCT p_name, '; ' ORDER BY p_name) AS names FROM part GROUP BY 1")
def sc5(spark, d):
    return table(spark, d, "part").groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_set("p_type")), " | ").alias("types"), F.array_join(F.array_sort(F.collect_set("p_name")), "; ").alias("names"))


@query("sc6_ngrams", "SELECT g, count(*) AS n FROM (SELECT substr(t, i, n) AS g FROM (SELECT t, n, unnest(range(1, CAST(length(t) + 2 - n AS BIGINT))) AS i FROM (SELECT ' ' || p_name || ' ' AS t FROM part), (SELECT unnest([2, 3, 4]) AS n))) GROUP BY 1")
def sc6(spark, d):
    padded = F.concat(F.lit(" "), F.col("p_name"), F.lit(" "))
    grams = F.concat(*[fn.ngrams(padded, n) for n in (2, 3, 4)])
    return table(spark, d, "part").select(F.explode(grams).alias("g")).groupBy("g").agg(F.count("*").alias("n"))


@query("sc7_dates", "SELECT o_orderkey, strftime(o_orderdate, '%d.%m.%Y %H:%M') AS stamp, CAST(year(o_orderdate) AS BIGINT) AS y, CAST(month(o_orderdate) AS BIGINT) AS m FROM orders")
def sc7(spark, d):
    """Dates written as ISO text, parsed again and written day first."""
    parsed = F.to_timestamp(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), "yyyy-MM-dd'T'HH:mm:ss")
    return table(spark, d, "orders").select("o_orderkey", F.date_format(parsed, "dd.MM.yyyy HH:mm").alias("stamp"), F.year(parsed).cast("long").alias("y"), F.month(parsed).cast("long").alias("m"))


@query("sc8_math", "SELECT c_custkey, round(q, 9) AS clipped, round(ln(q / (1 - q)), 6) AS odds, round(1 / (1 + exp(-x)), 9) AS chance, round(sqrt(q), 9) AS root, round(exp(least(x, 0.5)), 9) AS capped FROM (SELECT c_custkey, x, least(1 - 1e-12, greatest(1e-12, x)) AS q FROM (SELECT c_custkey, c_acctbal / 10000 AS x FROM customer))")
def sc8(spark, d):
    x = F.col("c_acctbal") / 10000
    q = fn.clip(x, fn.TINY, 1 - fn.TINY)
    return table(spark, d, "customer").select("c_custkey", F.round(q, 9).alias("clipped"), F.round(fn.logit(x), 6).alias("odds"), F.round(fn.logistic(x), 9).alias("chance"), F.round(F.sqrt(q), 9).alias("root"), F.round(F.exp(F.least(x, F.lit(0.5))), 9).alias("capped"))


@query("sc9_sets", "WITH s AS (SELECT p_partkey, string_split(p_name, ' ') AS a, ['red', 'ring', lower(p_type)] AS b FROM part) SELECT p_partkey, array_to_string(list_sort(list_intersect(a, b)), ' ') AS both, array_to_string(list_sort(list_distinct(list_concat(a, b))), ' ') AS any_of, array_to_string(list_sort([x FOR x IN list_distinct(b) IF NOT list_contains(a, x)]), ' ') AS lost, a[1] AS first_word, list_has_all(b, a) AS within FROM s")
def sc9(spark, d):
    a, b = F.split("p_name", " "), F.array(F.lit("red"), F.lit("ring"), F.lower("p_type"))
    joined = lambda c: F.array_join(F.array_sort(c), " ")
    within = F.size(F.array_except(a, b)) == 0
    return table(spark, d, "part").select("p_partkey", joined(F.array_intersect(a, b)).alias("both"), joined(F.array_union(a, b)).alias("any_of"), joined(F.array_except(b, a)).alias("lost"), F.slice(a, 1, 1)[0].alias("first_word"), within.alias("within"))


@query("sc10_folds", "SELECT vec_id, round(list_dot_product(e, list_reverse(e)), 6) AS mirrored, round(sqrt(list_dot_product(e, e)), 6) AS length, round((list_sum(e) * list_sum(e) - list_dot_product(e, e)) / 2, 6) AS pairs FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)")
def sc10(spark, d):
    """The sum over all pairs of slots comes from the sum and the sum of squares."""
    e = F.col("embedding")
    total = F.aggregate(e, F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return table(spark, d, "embeddings").select("vec_id", F.round(fn.dot(e, F.reverse(e)), 6).alias("mirrored"), F.round(fn.norm(e), 6).alias("length"), F.round((total * total - fn.dot(e, e)) / 2, 6).alias("pairs"))


@query("sc11_maps", "SELECT p_partkey, p_name AS object, 'none' AS place, 'OBJECT=' || p_name || ';SUBJECT=' || p_brand || ';TYPE=' || p_type AS key FROM part")
def sc11(spark, d):
    """A role's filler, a default for a role that is missing, and the sorted items as a key."""
    roles = F.create_map(F.lit("TYPE"), F.col("p_type"), F.lit("SUBJECT"), F.col("p_brand"), F.lit("OBJECT"), F.col("p_name"))
    items = F.transform(F.array_sort(F.map_entries(roles)), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return table(spark, d, "part").select("p_partkey", F.try_element_at(roles, F.lit("OBJECT")).alias("object"), F.coalesce(F.try_element_at(roles, F.lit("LOCATION")), F.lit("none")).alias("place"), F.array_join(items, ";").alias("key"))


@query("sc12_json", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, coalesce(json_extract_string(props, '$.none'), '-') AS lost, '{"type":"' || event_type || '","k":' || json_extract_string(props, '$.k') || '}' AS written FROM events""")
def sc12(spark, d):
    k = F.from_json("props", "k long")["k"]
    return table(spark, d, "events").select("event_id", k.alias("k"), F.coalesce(F.get_json_object("props", "$.none"), F.lit("-")).alias("lost"), F.to_json(F.struct(F.col("event_type").alias("type"), k.alias("k"))).alias("written"))


@query("sc13_hashes", "SELECT p_partkey, CAST(('0x' || substr(md5(p_name), 1, 8))::UBIGINT % 64 AS BIGINT) AS slot, ('0x' || substr(md5(p_name), 9, 1))::UBIGINT % 2 = 0 AS positive FROM part")
def sc13(spark, d):
    number = lambda start, length: F.conv(F.substring(F.md5("p_name"), start, length), 16, 10).cast("long")
    return table(spark, d, "part").select("p_partkey", (number(1, 8) % 64).alias("slot"), (number(9, 1) % 2 == 0).alias("positive"))


@query("sc14_defaults", "SELECT p_partkey, coalesce(nullif(string_split(p_name, ' ')[2], 'ring'), nullif(p_type, 'LARGE'), p_brand) AS chosen, CASE WHEN p_size > 40 THEN 'large' WHEN p_size > 20 THEN 'middle' ELSE 'small' END AS class FROM part")
def sc14(spark, d):
    second = F.try_element_at(F.split("p_name", " "), F.lit(2))
    size = F.when(F.col("p_size") > 40, "large").when(F.col("p_size") > 20, "middle").otherwise("small")
    return table(spark, d, "part").select("p_partkey", F.coalesce(F.nullif(second, F.lit("ring")), F.nullif("p_type", F.lit("LARGE")), "p_brand").alias("chosen"), size.alias("class"))
