"""Registered queries of entity resolution: part names by brand are the catalog, altered part names the mentions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..operators import resolution as er
from ..operators import vectors
from .purchase import table
from .registered import query

_CAT = "cat AS (SELECT min(p_partkey) AS uid, p_brand || ' ' || p_name AS name, p_brand AS brand, lower(p_brand || ' ' || p_name) AS key FROM part GROUP BY p_brand, p_name)"
_SAY = """say AS (SELECT p_partkey AS mention_id, p_brand AS context, CASE p_partkey % 4 WHEN 0 THEN upper(p_brand || ' ' || p_name) WHEN 1 THEN replace(p_brand || ' ' || p_name, ' ', '-')
  WHEN 2 THEN p_brand || ' ' || p_name || 's' ELSE replace(p_brand || ' ' || p_name, 'Brand#', 'House ') END AS mention FROM part), fol AS (SELECT *, trim(regexp_replace(translate(lower(mention), '_-', '  '), '\\s+', ' ', 'g')) AS f FROM say)"""
_HIT = f"{_CAT}, {_SAY}, hit AS (SELECT DISTINCT mention_id, uid FROM fol JOIN cat ON f = key OR replace(f, ' ', '') = replace(key, ' ', ''))"


def label():
    return F.concat("p_brand", F.lit(" "), "p_name")


def catalog(spark, d):
    named = table(spark, d, "part").groupBy(label().alias("name")).agg(F.min("p_partkey").alias("uid"), F.first("p_brand").alias("brand"))
    return named.select("uid", "name", F.array(F.replace("name", F.lit(" "), F.lit(""))).alias("aliases"), er.infer_kind(F.col("name")).alias("kind"), "brand")


def mentions(spark, d):
    k = F.col("p_partkey") % 4
    said = F.when(k == 0, F.upper(label())).when(k == 1, F.replace(label(), F.lit(" "), F.lit("-"))).when(k == 2, F.concat(label(), F.lit("s"))).otherwise(F.replace(label(), F.lit("Brand#"), F.lit("House ")))
    return table(spark, d, "part").select(F.col("p_partkey").alias("mention_id"), said.alias("mention"), F.col("p_brand").alias("context"))


@query("e1_build_catalog", "SELECT p_brand AS uid, min(p_name) AS name, count(DISTINCT p_name) - 1 AS n_aliases, 'concept' AS kind FROM part GROUP BY 1")
def e1(spark, d):
    out = er.build_catalog(table(spark, d, "part").select(F.col("p_brand").alias("uid"), F.col("p_name").alias("form")))
    return out.select("uid", "name", F.size("aliases").cast("long").alias("n_aliases"), "kind")


@query("e2_form_keys", f"WITH {_CAT}, {_SAY} SELECT mention_id, f AS key FROM fol UNION SELECT mention_id, replace(f, ' ', '') FROM fol")
def e2(spark, d):
    return mentions(spark, d).select("mention_id", F.explode(er.form_keys(F.col("mention"))).alias("key"))


@query("e3_resolve_exact", f"WITH {_HIT} SELECT mention_id, min(uid) AS uid FROM hit GROUP BY 1 HAVING count(*) = 1")
def e3(spark, d):
    found = er.resolve_exact(mentions(spark, d), er.catalog_keys(catalog(spark, d)))
    return er.settle(found).select("mention_id", "uid")


@query("e4_resolve_by_context", f"WITH {_CAT} SELECT p_partkey AS mention_id, min(uid) AS uid FROM part JOIN cat ON name = p_brand || ' ' || p_name GROUP BY 1")
def e4(spark, d):
    """The bare part name fits every brand's product; the context names the brand."""
    c = catalog(spark, d)
    said = table(spark, d, "part").select(F.col("p_partkey").alias("mention_id"), F.col("p_name").alias("mention"), F.concat(F.lit("by "), "p_brand", F.lit(" now")).alias("context"))
    keys = c.select("uid", F.expr("substring(name, length(brand) + 2)").alias("key"))
    return er.resolve_in_context(said, keys, c.select("uid", F.concat("brand", F.lit(" ")).alias("cue"))).select("mention_id", "uid")


@query("e5_compound_extension", "WITH h AS (SELECT string_split(p_name, ' ')[1] AS head, p_name FROM part WHERE p_size > 48 AND p_type = 'LARGE' GROUP BY ALL), o AS (SELECT head, min(p_name) AS uid FROM h GROUP BY 1 HAVING count(*) = 1) SELECT p_partkey AS mention_id, uid FROM part JOIN o ON head = string_split(p_name, ' ')[1]")
def e5(spark, d):
    part = table(spark, d, "part")
    names = part.filter("p_size > 48 and p_type = 'LARGE'").select(F.col("p_name").alias("uid"), F.col("p_name").alias("name")).distinct()
    return er.compound_extension(part.select(F.col("p_partkey").alias("mention_id"), F.split("p_name", " ")[0].alias("mention")), names)


_PROX = "prox AS (SELECT mention_id, uid, CASE WHEN (starts_with(f, key) OR starts_with(key, f)) AND abs(length(f) - length(key)) <= 3 THEN 0.9 WHEN abs(length(f) - length(key)) <= 2 AND left(f, greatest(4, ceil(0.8 * greatest(length(f), length(key))))::INT) = left(key, greatest(4, ceil(0.8 * greatest(length(f), length(key))))::INT) THEN 0.85 END::DOUBLE AS score FROM fol, cat)"


@query("e6_resolve_inflected", f"WITH {_CAT}, {_SAY}, {_PROX} SELECT mention_id, uid, score FROM prox WHERE score IS NOT NULL")
def e6(spark, d):
    keys = catalog(spark, d).select("uid", F.lower("name").alias("key"))
    return er.resolve_inflected(mentions(spark, d), keys)


_LEMMA = "cat AS (SELECT min(p_partkey) AS uid, lower(p_name) AS key FROM part GROUP BY 2), say AS (SELECT p_partkey AS mention_id, CASE p_size % 3 WHEN 0 THEN lower(p_name) || 's' WHEN 1 THEN string_split(lower(p_name), ' ')[1] ELSE lower(p_name) END AS f FROM part), lem AS (SELECT DISTINCT lower(p_name) || 's' AS form, lower(p_name) AS lemma FROM part), m AS (SELECT mention_id, f, coalesce(lemma, f) AS lemma FROM say LEFT JOIN lem ON f = form)"


@query("e6_resolve_by_lemma", f"WITH {_LEMMA}, r AS (SELECT mention_id, uid, 0.98::DOUBLE AS score FROM m JOIN cat ON f = key UNION ALL SELECT mention_id, uid, 0.95 FROM m JOIN cat ON lemma = key UNION ALL SELECT mention_id, uid, 0.92 FROM m JOIN cat ON lemma = string_split(key, ' ')[1] AND contains(key, ' ')) SELECT mention_id, uid, max(score) AS score FROM r GROUP BY 1, 2")
def e6_lemma(spark, d):
    """Plural names have their name for a lemma; first words alone meet every name that they start."""
    part, k, name = table(spark, d, "part"), F.col("p_size") % 3, F.lower("p_name")
    said = F.when(k == 0, F.concat(name, F.lit("s"))).when(k == 1, F.split(name, " ")[0]).otherwise(name)
    keys = part.groupBy(name.alias("key")).agg(F.min("p_partkey").alias("uid"))
    lemmas = part.select(F.concat(name, F.lit("s")).alias("form"), name.alias("lemma")).distinct()
    return er.resolve_by_lemma(part.select(F.col("p_partkey").alias("mention_id"), said.alias("mention")), keys, lemmas)


@query("e8_resolve_synonym", f"WITH {_CAT}, {_SAY} SELECT mention_id, uid FROM fol JOIN cat ON f = replace(key, 'brand#', 'house ')")
def e8(spark, d):
    c = catalog(spark, d)
    lexicon = c.select(F.replace("name", F.lit("Brand#"), F.lit("House ")).alias("surface"), F.col("name").alias("canonical"))
    return er.resolve_synonym(mentions(spark, d), lexicon, er.catalog_keys(c)).select("mention_id", "uid")


_NEAR = "near AS (SELECT a.vec_id AS q, b.vec_id AS v, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS s, b.label AS uid FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)"


@query("e10_identity_gate", f"WITH {_NEAR}, r AS (SELECT q, v, s, row_number() OVER (PARTITION BY q ORDER BY s DESC, v) AS k, lead(s) OVER (PARTITION BY q ORDER BY s DESC, v) AS nxt FROM near) SELECT q AS mention_id, v AS uid, s AS score FROM r WHERE k = 1 AND s >= 0.3 AND s - nxt >= 0.02 AND (q + v) % 5 <> 0")
def e10(spark, d):
    e = table(spark, d, "embeddings")
    asked = e.filter("vec_id % 20 = 0")
    found = vectors.knn(asked.select("vec_id", "embedding"), e.select("vec_id", "embedding"), 5).select(F.col("q").alias("mention_id"), F.col("vec_id").alias("uid"), F.round("similarity", 6).alias("score"))
    name = F.concat(F.lit("v"), "vec_id")
    known = e.select(F.col("vec_id").alias("uid"), name.alias("name"), F.lit("concept").alias("kind"))
    said = asked.select(F.col("vec_id").alias("mention_id"), name.alias("mention"))
    apart = found.filter((F.col("mention_id") + F.col("uid")) % 5 == 0).select(F.concat(F.lit("V"), "mention_id").alias("mention"), F.concat(F.lit("v"), "uid").alias("name"))
    return er.gate(found, known, said, apart, 0.3, 0.02)


@query("e9_embedding_candidates", f"WITH {_NEAR} SELECT q AS mention_id, uid, max(s) AS score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, v) AS k FROM near) WHERE k <= 10 GROUP BY 1, 2")
def e9(spark, d):
    e = table(spark, d, "embeddings")
    found = vectors.knn(e.filter("vec_id % 20 = 0").select("vec_id", "embedding"), e.select("vec_id", "embedding"), 10)
    labelled = found.join(e.select("vec_id", F.col("label").alias("uid")), "vec_id")
    return labelled.groupBy(F.col("q").alias("mention_id"), "uid").agg(F.max(F.round("similarity", 6)).alias("score"))


@query("e11_infer_kind", "SELECT p_partkey, 'brand' AS shouted, 'entity' AS titled, 'concept' AS plain FROM part")
def e11(spark, d):
    return table(spark, d, "part").select("p_partkey", er.infer_kind(F.upper("p_name")).alias("shouted"), er.infer_kind(F.initcap("p_name")).alias("titled"), er.infer_kind(F.col("p_name")).alias("plain"))


@query("e12_resolve_hybrid", rf"""WITH {_HIT}, {_PROX}, ex AS (SELECT mention_id, CASE WHEN count(*) = 1 THEN min(uid) END AS uid, 'exact' AS method FROM hit GROUP BY 1), pm AS (SELECT *, max(score) OVER (PARTITION BY mention_id) AS top FROM prox WHERE score IS NOT NULL AND mention_id NOT IN (SELECT mention_id FROM ex)),
  inf AS (SELECT mention_id, CASE WHEN count(*) = 1 THEN min(uid) END AS uid, 'inflected' AS method FROM pm WHERE score = top GROUP BY 1), syn AS (SELECT mention_id, min(uid) AS uid, 'synonym' AS method FROM fol JOIN cat ON f = replace(key, 'brand#', 'house ') WHERE mention_id NOT IN (SELECT mention_id FROM ex) AND mention_id NOT IN (SELECT mention_id FROM inf) GROUP BY 1) SELECT * FROM ex UNION ALL SELECT * FROM inf UNION ALL SELECT * FROM syn""")
def e12(spark, d):
    c = catalog(spark, d)
    keys, plain = er.catalog_keys(c), c.select("uid", F.lower("name").alias("key"))
    lexicon = c.select(F.replace("name", F.lit("Brand#"), F.lit("House ")).alias("surface"), F.col("name").alias("canonical"))
    steps = [("exact", lambda m: er.resolve_exact(m, keys)), ("inflected", lambda m: er.resolve_inflected(m, plain)), ("synonym", lambda m: er.resolve_synonym(m, lexicon, keys))]
    return er.cascade(mentions(spark, d).select("mention_id", "mention"), steps).select("mention_id", "uid", "method")


@query("e13_restrict_candidates", f"WITH {_HIT} SELECT hit.mention_id, uid FROM hit WHERE mention_id % 3 <> 0 OR uid = mention_id")
def e13(spark, d):
    found = er.resolve_exact(mentions(spark, d), er.catalog_keys(catalog(spark, d)))
    own = table(spark, d, "part").filter("p_partkey % 3 = 0").select(F.col("p_partkey").alias("mention_id"), F.array("p_partkey").alias("uids"))
    return er.restrict(found, own).select("mention_id", "uid")


@query("e14_attach_aliases", f"WITH {_HIT}, one AS (SELECT mention_id, min(uid) AS uid FROM hit GROUP BY 1 HAVING count(*) = 1), al AS (SELECT uid, replace(name, ' ', '') AS a FROM cat UNION SELECT uid, mention FROM one JOIN say USING (mention_id)) SELECT cat.uid, count(*) FILTER (a <> name) AS n_aliases FROM cat JOIN al USING (uid) GROUP BY 1")
def e14(spark, d):
    c, said = catalog(spark, d), mentions(spark, d)
    resolved = er.settle(er.resolve_exact(said, er.catalog_keys(c))).join(said, "mention_id").select("uid", "mention")
    return er.attach_aliases(c, resolved).select("uid", F.size("aliases").cast("long").alias("n_aliases"))


@query("e15_target_similarity", "SELECT a.vec_id AS mention_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS similarity FROM embeddings a JOIN (SELECT label, arg_min(embedding, vec_id) AS embedding FROM embeddings GROUP BY 1) b ON a.label = b.label")
def e15(spark, d):
    e = table(spark, d, "embeddings")
    gold = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("target"))
    return e.join(gold, "label").select(F.col("vec_id").alias("mention_id"), F.round(fn.cosine(F.col("embedding"), F.col("target")), 5).alias("similarity"))


_REL = r"trim(regexp_replace(upper({}), '[^A-Z0-9]+', '_', 'g'), '_')"


@query("n2_register_relations", f"WITH b AS (SELECT {_REL.format('p_name')} AS canonical, p_name AS raw_label, p_size % 3 AS arity, (p_size > 25)::INT AS age FROM part) SELECT canonical, raw_label, arity FROM (SELECT *, row_number() OVER (PARTITION BY canonical ORDER BY age, raw_label, arity) AS k FROM b WHERE arity >= 1) WHERE k = 1")
def n2(spark, d):
    rows = table(spark, d, "part").select(F.col("p_name").alias("canonical"), F.col("p_name").alias("raw_label"), (F.col("p_size") % 3).alias("arity"), "p_size")
    return er.register_relations(rows.filter("p_size <= 25").drop("p_size"), rows.filter("p_size > 25").drop("p_size")).select("canonical", "raw_label", "arity")


@query("n6_normalize_chain", f"WITH r AS (SELECT DISTINCT p_type || ' ' || p_name AS raw FROM part), k AS (SELECT raw, {_REL.format('raw')} AS key FROM r), a AS (SELECT DISTINCT {_REL.format(chr(39) + 'small ' + chr(39) + ' || p_name')} AS key, {_REL.format('p_name')} AS via FROM part), o AS (SELECT DISTINCT {_REL.format(chr(39) + 'large ' + chr(39) + ' || p_name')} AS key FROM part) SELECT raw, coalesce(via, k.key) AS canonical, CASE WHEN via IS NOT NULL OR o.key IS NOT NULL THEN 1.0 ELSE 0.5 END::DOUBLE AS confidence FROM k LEFT JOIN a USING (key) LEFT JOIN o USING (key)")
def n6(spark, d):
    part = table(spark, d, "part")
    aliases = part.select(F.concat(F.lit("Small "), "p_name").alias("alias"), fn.canonical_label(F.col("p_name")).alias("canonical")).distinct()
    known = part.select(fn.canonical_label(F.concat(F.lit("Large "), "p_name")).alias("canonical")).distinct()
    return er.normalize_relations(part.select(F.concat("p_type", F.lit(" "), "p_name").alias("raw")), aliases, known)
