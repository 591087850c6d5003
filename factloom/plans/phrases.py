"""Registered queries of phrase matching, similar names, anchors and relations by vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..operators import resolution as er
from ..operators import text
from ..operators.phrases import phrase_matches
from .purchase import table
from .registered import query

_W = r"regexp_extract_all(lower({}), '[a-z0-9]+')"


def spoken(spark, d):
    """A part described by its own words, the next part's words between them."""
    part = table(spark, d, "part")
    ahead = part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("next"))
    said = F.concat("p_name", F.lit(" and "), F.coalesce("next", F.lit("")), F.lit(", "), "p_name")
    return part.join(ahead, "p_partkey", "left").select(F.col("p_partkey").alias("text_id"), said.alias("text"))


def phrases(spark, d):
    part = table(spark, d, "part")
    one = part.groupBy(F.col("p_name").alias("phrase")).agg(F.min("p_partkey").alias("uid"))
    wide = part.filter("p_size > 40").groupBy(F.concat("p_name", F.lit(" and")).alias("phrase")).agg((F.min("p_partkey") + 1000000).alias("uid"))
    return one.unionByName(wide)


_SPOKEN = "sp AS (SELECT a.p_partkey AS text_id, a.p_name || ' and ' || coalesce(b.p_name, '') || ', ' || a.p_name AS text FROM part a LEFT JOIN part b ON b.p_partkey = a.p_partkey + 1)"
_PHRASES = "ph AS (SELECT p_name AS phrase, min(p_partkey) AS uid FROM part GROUP BY 1 UNION ALL SELECT p_name || ' and', min(p_partkey) + 1000000 FROM part WHERE p_size > 40 GROUP BY p_name)"
_RUNS = f"tw AS (SELECT text_id, {_W.format('text')} AS w FROM sp), pw AS (SELECT uid, len({_W.format('phrase')}) AS width, array_to_string({_W.format('phrase')}, ' ') AS run FROM ph), wd AS (SELECT DISTINCT width FROM pw WHERE width >= 2), tr AS (SELECT text_id, width, i, array_to_string(w[i + 1:i + width], ' ') AS run FROM (SELECT text_id, w, width, unnest(range(0, len(w) - width + 1)) AS i FROM tw, wd WHERE len(w) >= width)), hits AS (SELECT text_id, i AS start, width, uid FROM tr JOIN pw USING (width, run))"


@query("j7_phrase_matches", f"WITH {_SPOKEN}, {_PHRASES}, {_RUNS} SELECT text_id, start, width, uid FROM hits")
def j7(spark, d):
    return phrase_matches(spoken(spark, d), phrases(spark, d))


_GREEDY = "rk AS (SELECT *, row_number() OVER (PARTITION BY text_id ORDER BY width DESC, start, uid) AS k FROM hits), fold AS (SELECT DISTINCT text_id, 0::BIGINT AS k, []::BIGINT[] AS taken, 0::BIGINT AS c, false AS ok, 0::BIGINT AS start, 0::BIGINT AS width, 0::BIGINT AS uid FROM hits UNION ALL SELECT text_id, k, CASE WHEN ok THEN list_concat(taken, range(start, start + width)) ELSE taken END, c + ok::BIGINT, ok, start, width, uid FROM (SELECT m.text_id, m.k, f.taken, f.c, f.c < 8 AND NOT list_has_any(f.taken, range(m.start, m.start + m.width)) AS ok, m.start, m.width, m.uid FROM fold f JOIN rk m ON m.text_id = f.text_id AND m.k = f.k + 1))"


@query("j7_longest_phrases", f"WITH RECURSIVE {_SPOKEN}, {_PHRASES}, {_RUNS}, {_GREEDY} SELECT text_id, start, width, uid, c - 1 AS rank FROM fold WHERE ok")
def j7_longest(spark, d):
    """The greedy choice among the matches: in their order each that overlaps none taken before."""
    return er.longest_phrases(phrase_matches(spoken(spark, d), phrases(spark, d)))


_LEMMAS = "lm AS (SELECT DISTINCT w || 's' AS form, w AS lemma FROM (SELECT unnest(string_split(lower(p_name), ' ')) AS w FROM part))"


def _own(of: str, key: str) -> str:
    return f"(SELECT {key}, list(coalesce(lemma, w) ORDER BY i) AS w FROM (SELECT {key}, unnest(w) AS w, unnest(range(0, len(w))) AS i FROM {of}) LEFT JOIN lm ON form = w GROUP BY 1)"


@query("j7_lemma_phrases", f"WITH {_LEMMAS}, sp AS (SELECT p_partkey AS text_id, {_W.format(chr(39) + 'some ' + chr(39) + ' || replace(p_name, ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 's ' + chr(39) + ') || ' + chr(39) + 's by ' + chr(39) + ' || p_name')} AS w FROM part), ph AS (SELECT min(p_partkey) AS uid, {_W.format('p_name || ' + chr(39) + 's' + chr(39))} AS w FROM part GROUP BY p_name), st AS {_own('sp', 'text_id')}, pt AS {_own('ph', 'uid')} SELECT text_id, i AS start, len(pt.w) AS width, uid FROM (SELECT text_id, st.w, unnest(range(0, len(st.w))) AS i FROM st) t JOIN pt ON t.w[i + 1:i + len(pt.w)] = pt.w WHERE len(pt.w) >= 2")
def j7_lemma(spark, d):
    """Names in the plural, word by word, and as they are, meet phrases whose last word is in the plural."""
    part = table(spark, d, "part")
    texts = part.select(F.col("p_partkey").alias("text_id"), F.concat(F.lit("some "), F.replace("p_name", F.lit(" "), F.lit("s ")), F.lit("s by "), "p_name").alias("text"))
    known = part.groupBy("p_name").agg(F.min("p_partkey").alias("uid")).select("uid", F.concat("p_name", F.lit("s")).alias("phrase"))
    words = part.select(F.explode(F.split(F.lower("p_name"), " ")).alias("lemma")).distinct()
    return phrase_matches(texts, known, lemmas=words.select(F.concat("lemma", F.lit("s")).alias("form"), "lemma"))


_DICE = "f AS (SELECT DISTINCT lower(p_name || ' ' || lower(p_type)) AS said FROM part), c AS (SELECT p_name AS name, min(p_partkey) AS uid FROM part WHERE p_size > 25 GROUP BY 1), a AS (SELECT DISTINCT said, substr(' ' || said || ' ', i, 3) AS g FROM (SELECT said, unnest(range(1, CAST(length(said) AS BIGINT) + 1)) AS i FROM f)), b AS (SELECT DISTINCT uid, substr(' ' || name || ' ', i, 3) AS g FROM (SELECT uid, name, unnest(range(1, CAST(length(name) AS BIGINT) + 1)) AS i FROM c)), an AS (SELECT said, count(*) AS n FROM a GROUP BY 1), bn AS (SELECT uid, count(*) AS n FROM b GROUP BY 1), s AS (SELECT a.said, b.uid, 2 * count(*) / (any_value(an.n) + any_value(bn.n)) AS score FROM a JOIN b USING (g) JOIN an USING (said) JOIN bn USING (uid) GROUP BY 1, 2), m AS (SELECT said, uid, score FROM (SELECT *, row_number() OVER (PARTITION BY said ORDER BY score DESC, uid) AS k FROM s) WHERE k = 1)"


@query("j6_similar_names", f"WITH {_DICE} SELECT p_partkey AS mention_id, uid, round(score, 9) AS score FROM part JOIN m ON said = lower(p_name || ' ' || lower(p_type))")
def j6(spark, d):
    part = table(spark, d, "part")
    said = part.select(F.col("p_partkey").alias("mention_id"), F.concat("p_name", F.lit(" "), "p_type").alias("mention"))
    names = part.filter("p_size > 25").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("uid"))
    return er.similar_names(said, names).select("mention_id", "uid", F.round("score", 9).alias("score"))


@query("j10_label_coverage", "WITH n AS (SELECT c_custkey, c_name, lead(c_name) OVER (ORDER BY c_custkey) AS next FROM customer), t AS (SELECT o_orderkey AS text_id, unnest(list_distinct(regexp_extract_all(c_name || ' and ' || coalesce(next, ''), 'Customer#[0-9]+'))) AS label FROM orders JOIN n ON c_custkey = o_custkey), lb AS (SELECT c_custkey AS fid, unnest([c_name, next]) AS label FROM n) SELECT text_id, fid, 3 * count(*) AS score FROM t JOIN lb USING (label) GROUP BY 1, 2")
def j10(spark, d):
    """Each customer and the next are a factor; an order's text names both."""
    c = table(spark, d, "customer").select("c_custkey", "c_name")
    ahead = c.select((F.col("c_custkey") - 1).alias("c_custkey"), F.col("c_name").alias("next"))
    both = c.join(ahead, "c_custkey", "left")
    texts = table(spark, d, "orders").join(both, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("text_id"), F.concat("c_name", F.lit(" and "), F.coalesce("next", F.lit(""))).alias("text"))
    labels = both.select(F.col("c_custkey").alias("fid"), F.explode(F.array("c_name", "next")).alias("label"))
    return er.label_coverage(texts, labels)


_ASKED = "q AS (SELECT p_partkey AS question_id, CASE WHEN p_size % 2 = 0 THEN 'the ' || p_name || ' of ' || p_brand ELSE lower(p_type) || ' by ' || p_brand END AS question, p_size % 2 = 0 AS named, lower(p_type) AS token, string_split(p_name, ' ')[1] AS second, p_name FROM part)"


@query("e16_anchor_tokens", f"WITH {_ASKED}, ph AS (SELECT p_name AS phrase, min(p_partkey) AS uid FROM part GROUP BY 1), ks AS (SELECT DISTINCT min(p_partkey) OVER (PARTITION BY p_name) AS uid, unnest(string_split(p_name, ' ') || [lower(p_type)]) AS key FROM part), t AS (SELECT question_id, 0 AS pos, token FROM q WHERE NOT named UNION ALL SELECT question_id, 1, second FROM q WHERE NOT named), h AS (SELECT question_id, uid, min(pos) AS pos FROM t JOIN ks ON key = token GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY pos, uid) AS rank FROM h) SELECT question_id, 1 AS rank, uid FROM q JOIN ph ON phrase = p_name WHERE named UNION ALL SELECT question_id, rank, uid FROM r WHERE rank <= 16")
def e16(spark, d):
    part = table(spark, d, "part")
    even = F.col("p_size") % 2 == 0
    asked = part.select(F.col("p_partkey").alias("question_id"), F.when(even, F.concat(F.lit("the "), "p_name", F.lit(" of "), "p_brand")).otherwise(F.concat(F.lower("p_type"), F.lit(" by "), "p_brand")).alias("question"))
    tokens = part.filter(~even).select(F.col("p_partkey").alias("question_id"), F.posexplode(F.array("p_type", F.split("p_name", " ")[0])).alias("pos", "token"))
    names = part.groupBy(F.col("p_name").alias("phrase")).agg(F.min("p_partkey").alias("uid"))
    keys = part.groupBy("p_name").agg(F.min("p_partkey").alias("uid"), F.collect_set(F.lower("p_type")).alias("types"))
    keys = keys.select("uid", F.explode(F.concat(F.split("p_name", " "), "types")).alias("key")).distinct()
    return er.anchor_tokens(asked, names, tokens, keys)


_GRAMS = "(SELECT k, CAST(('0x' || substr(md5(g), 1, 8))::UBIGINT % 256 AS BIGINT) AS slot, count(*) AS v FROM (SELECT k, substr(' ' || lower(k) || ' ', i, 3) AS g FROM (SELECT k, unnest(range(1, CAST(length(k) AS BIGINT) + 1)) AS i FROM ({}))) GROUP BY 1, 2)"
_RAW = "SELECT DISTINCT p_type || ' ' || p_name AS k FROM part"
_KNOWN = "SELECT DISTINCT p_name AS k FROM part"


def vectors_of(df, name):
    return text.hashed_ngrams(df.withColumnRenamed("k", name), name, name, (3,), 256, signed=False)


@query("n4_nearest_relations", f"WITH a AS {_GRAMS.format(_RAW)}, b AS {_GRAMS.format(_KNOWN)}, s AS (SELECT a.k AS raw, b.k AS canonical, round(sum(a.v * b.v) / (any_value(x.n) * any_value(y.n)), 9) AS c FROM a JOIN b USING (slot) JOIN (SELECT k, sqrt(sum(v * v)) AS n FROM a GROUP BY 1) x ON x.k = a.k JOIN (SELECT k, sqrt(sum(v * v)) AS n FROM b GROUP BY 1) y ON y.k = b.k GROUP BY 1, 2) SELECT raw, canonical, c AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY raw ORDER BY c DESC, canonical) AS r FROM s WHERE c >= 0.7) WHERE r = 1")
def n4(spark, d):
    part = table(spark, d, "part")
    raw, known = part.select(F.concat("p_type", F.lit(" "), "p_name").alias("k")).distinct(), part.select(F.col("p_name").alias("k")).distinct()
    return er.nearest_relations(vectors_of(raw, "raw"), vectors_of(known, "canonical"), 0.7)


_LABEL = r"trim(regexp_replace(upper({}), '[^A-Z0-9]+', '_', 'g'), '_')"


@query("n7_normalize_candidates", f"SELECT p_partkey AS cand_id, {_LABEL.format('CASE WHEN p_size % 3 = 2 THEN p_name ELSE p_type END')} AS canonical, CASE WHEN p_size % 3 = 2 AND p_size > 25 THEN 1.0 WHEN p_size % 3 = 2 THEN 0.5 ELSE p_size / 50.0::DOUBLE END::DOUBLE AS confidence, CASE WHEN p_size % 3 = 2 AND p_name NOT IN (SELECT p_type FROM part WHERE p_type > 'L') THEN 'chain' WHEN p_type > 'L' THEN 'hint' ELSE 'new relation' END AS strategy FROM part")
def n7(spark, d):
    """Two of three candidates carry a hint; relations after L are registered; the chain knows large parts' names."""
    part = table(spark, d, "part")
    rows = part.select(F.col("p_partkey").alias("cand_id"), F.concat("p_name", F.when(F.col("p_size") > 25, "").otherwise("-")).alias("raw"), F.when(F.col("p_size") % 3 != 2, F.col("p_type")).alias("hint"), (F.col("p_size") / 50).alias("confidence"))
    known = part.filter("p_type > 'L'").select(fn.canonical_label(F.col("p_type")).alias("canonical")).distinct()
    chain = er.normalize_relations(part.filter("p_size > 25").select(F.col("p_name").alias("raw")), part.limit(0).select(F.col("p_name").alias("alias"), F.col("p_name").alias("canonical")), part.select(fn.canonical_label(F.col("p_name")).alias("canonical")).distinct())
    return er.normalize_candidates(rows, known, chain)
