"""From text to facts: segments, clauses, candidates with role maps, their checks, and upserts into the graph.

Candidates are ``cand_id, relation, roles (map of role to filler), kind, confidence``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import canonical_label
from ..runtime import cut_lineage

WORD = r"[\p{L}\p{N}]+"
# Share of .5 that a statement's kind weighs; kinds that state facts.
KIND_WEIGHT = {"decision": 1.0, "assertion": 1.0, "topic": 0.55, "open_question": 0.5, "proposal": 0.45, "explanation": 0.4}
FACTUAL = ("decision", "assertion")


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def slug(text: Column, stop: list[str], parts: int = 4, chars: int = 48) -> Column:
    """Upper-case key of the first words that are not stop words; null when none is left."""
    kept = F.filter(words(text), lambda w: ~w.isin(*stop))
    key = F.regexp_replace(F.substring(F.upper(F.array_join(F.slice(kept, 1, parts), "_")), 1, chars), "_$", "")
    return F.when(key != "", key)


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once: a column that is named in several places is computed in each of them."""
    return F.transform(F.array(value), then)[0]


def too_wide(uid: Column, parts: int = 4) -> Column:
    """More parts than a name should have, or one part twice."""
    split = F.split(uid, "_")
    return (F.size(split) > parts) | (F.size(split) != F.size(F.array_distinct(split)))


def entity_token(word: Column, stop: list[str]) -> Column:
    """Whether a word can fill a role: a number, or two characters or more and no stop word."""
    w = F.lower(F.trim(F.coalesce(word, F.lit(""))))
    return w.rlike(r"^\d+$") | ((F.length(w) >= 2) & ~w.isin(*stop) & w.rlike(r"^[\p{L}\p{N}_-]+$"))


def nounish(word: Column, classes: Column | None = None) -> Column:
    """Whether a word can head a filler: of class noun or name, or of none known (``classes`` is null) while not ending as an adverb does."""
    plain = ~F.lower(word).rlike(r"^\p{L}{3,}ly$")
    return plain if classes is None else F.when(classes.isNull(), plain).otherwise(classes.isin("noun", "name"))


def head_entity(filler: Column, stop: list[str], parts: int = 4) -> Column:
    """Key of a filler's entity words, the last ``parts`` of them, if one can be a head; else null."""

    def key_of(kept: Column, heads: Column) -> Column:
        chosen = F.when(F.size(kept) > parts, heads).otherwise(kept)
        key = F.upper(F.array_join(F.slice(chosen, F.greatest(F.lit(1), F.size(chosen) - parts + 1), F.lit(parts)), "_"))
        return once(key, lambda key: F.when((F.size(heads) > 0) & ~too_wide(key, parts), key))

    words_of = F.filter(F.split(F.lower(filler), r"[\s_]+"), lambda w: entity_token(w, stop))
    return once(words_of, lambda kept: once(F.filter(kept, lambda w: nounish(w)), lambda heads: key_of(kept, heads)))


def sanitize_roles(candidates: DataFrame, stop: list[str], must_be_entities: tuple[str, ...] = ("SUBJECT", "OBJECT", "LOCATION")) -> DataFrame:
    """Candidates whose named roles are entities, with fillers as keys; one that names a role by no entity, or lacks a SUBJECT, goes."""
    entity = F.transform_values("roles", lambda role, v: F.when(role.isin(*must_be_entities), head_entity(v, stop)).otherwise(slug(v, stop)))
    bad = lambda e: e["key"].isin(*must_be_entities) & e["value"].isNull()
    whole = lambda roles: ~F.exists(F.map_entries(roles), bad) & F.element_at(roles, F.lit("SUBJECT")).isNotNull()
    # one array of one or no map, so that a filter behind it computes no filler again
    kept = F.transform(F.filter(F.array(entity), whole), lambda roles: F.map_filter(roles, lambda role, v: v.isNotNull()))
    return candidates.withColumn("roles", F.explode(kept))


def finalize(candidates: DataFrame, stop: list[str]) -> DataFrame:
    """Sanitized candidates, one for each relation and role map (the smallest cand_id)."""
    keyed = sanitize_roles(candidates, stop).withColumn("relation", F.upper(F.trim("relation"))).filter("relation <> ''")
    rank = F.row_number().over(Window.partitionBy("relation", role_key(F.col("roles"))).orderBy("cand_id"))
    return keyed.withColumn("rank", rank).filter("rank = 1").drop("rank")


def seed_entities(texts: DataFrame, stop: list[str], n: int = 8) -> DataFrame:
    """``text_id, rank, token``: the first n distinct entity-like words of each text."""
    each = texts.select("text_id", F.posexplode(words(F.col("text"))).alias("pos", "token")).filter(entity_token(F.col("token"), stop) & nounish(F.col("token")))
    first = each.groupBy("text_id", "token").agg(F.min("pos").alias("pos"))
    rank = F.row_number().over(Window.partitionBy("text_id").orderBy("pos"))
    return first.withColumn("rank", rank).filter(F.col("rank") <= n).select("text_id", "rank", "token")


def without_compound_heads(seeds: DataFrame, candidates: DataFrame) -> DataFrame:
    """Seeds ``text_id, token`` less those that only begin a filler of several words in a candidate of their text (``text_id, roles``)."""
    parts = candidates.select("text_id", F.explode(F.map_values("roles")).alias("filler")).select("text_id", F.split(F.lower(F.trim("filler")), r"[\s_]+").alias("w"))
    heads = parts.filter(F.size("w") >= 2).select("text_id", F.col("w")[0].alias("token")).distinct()
    return seeds.join(heads, ["text_id", "token"], "left_anti")


def normalize_roles(candidates: DataFrame, aliases: dict[str, str], allowed: tuple[str, ...], beside: str = "WITH") -> DataFrame:
    """Candidates with canonical role names; those without a SUBJECT, with fewer than two roles or with a compound filler go.

    Names are upper case and go through ``aliases``; of two that become one the first by name stays; names that are not
    ``allowed`` and blank fillers are dropped. What a filler has in brackets at its end becomes the role ``beside``, unless there is one.
    """
    canonical = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair]) if aliases else F.create_map().cast("map<string,string>")
    named = F.transform(F.array_sort(F.map_entries("roles")), lambda e: F.struct(F.coalesce(F.try_element_at(canonical, F.upper(e["key"])), F.upper(e["key"])).alias("role"), F.trim(e["value"]).alias("v")))
    good = F.filter(named, lambda e: e["role"].isin(*allowed, beside) & (F.coalesce(e["v"], F.lit("")) != ""))
    once = F.filter(good, lambda e, i: F.array_position(F.transform(good, lambda g: g["role"]), e["role"]) == i + 1)
    bracket = r"^(.*?)\s*\(\s*(?:with\s+)?([^()]+)\)\s*$"
    inner = F.filter(F.transform(once, lambda e: F.regexp_extract(e["v"], bracket, 2)), lambda v: v != "")
    bare = F.transform(once, lambda e: F.struct(e["role"].alias("role"), F.when(e["v"].rlike(bracket), F.regexp_extract(e["v"], bracket, 1)).otherwise(e["v"]).alias("v")))
    extra = F.when((F.size(inner) > 0) & ~F.exists(once, lambda e: e["role"] == beside), F.array(F.struct(F.lit(beside).alias("role"), inner[0].alias("v")))).otherwise(F.slice(bare, 1, 0))
    rows = candidates.withColumn("_bare", bare).withColumn("roles", F.map_from_entries(F.concat(bare, extra)))
    simple = ~F.exists("_bare", lambda e: e["v"].rlike(r",|\s+and\s+"))
    return rows.filter(simple & F.map_contains_key("roles", F.lit("SUBJECT")) & (F.size("roles") >= 2)).drop("_bare")


PAYLOAD = "struct<kind: string, candidates: array<struct<relation: string, roles: map<string,string>, kind: string, confidence: double>>>"
# The relation that stands for a label of more than five parts.
COMPACT = {"topic": "DISCUSSES", "open_question": "ASKS_ABOUT", "proposal": "PROPOSES", "explanation": "EXPLAINS", "decision": "DECIDES", "assertion": "RELATED_TO"}


def from_payload(payloads: DataFrame) -> DataFrame:
    """``text_id, no, relation, roles, kind, confidence`` from JSON ``text_id, payload``; malformed JSON gives no rows.

    A candidate without a kind is an assertion, and nothing in a question; unknown kinds and missing relations go; a
    relation of more than five parts becomes its kind's; confidence is 0.8 unless given.
    """
    parsed = payloads.select("text_id", F.from_json("payload", PAYLOAD).alias("p")).select("text_id", F.lower("p.kind").alias("said"), F.posexplode("p.candidates").alias("no", "c"))
    typed = parsed.filter(~(F.col("c.kind").isNull() & (F.coalesce("said", F.lit("fact")) == "question"))).withColumn("kind", F.lower(F.coalesce("c.kind", F.lit("assertion"))))
    label = F.upper(F.trim(F.coalesce("c.relation", F.lit(""))))
    compact = label
    for kind, name in COMPACT.items():
        compact = F.when((F.col("kind") == kind) & (F.size(F.split(label, r"[_\s-]+")) > 5), name).otherwise(compact)
    rows = typed.filter(F.col("kind").isin(*COMPACT)).select("text_id", "no", compact.alias("relation"), F.col("c.roles").alias("roles"), "kind", F.coalesce("c.confidence", F.lit(0.8)).alias("confidence"))
    return rows.filter("relation <> ''")


def assistant_only(candidates: DataFrame, stop: list[str], least: float = 0.75) -> DataFrame:
    """An assistant's candidates that may be kept: confident proposals and explanations with entities for roles."""
    sure = candidates.filter((F.col("confidence") >= least) & F.col("kind").isin("proposal", "explanation"))
    return sanitize_roles(sure, stop)


def without_query_clauses(candidates: DataFrame) -> DataFrame:
    """What a question states beside asking: no topics and no open questions (of rows with ``asked``), all of other texts."""
    return candidates.filter(~F.coalesce("asked", F.lit(False)) | ~F.col("kind").isin("topic", "open_question"))


def get(asked: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of the uids asked for (``uid, kind``), and what can't be had: ``uid, problem`` (missing, or of another kind)."""
    joined = asked.select("uid", F.col("kind").alias("wanted")).join(rows.withColumn("found", F.lit(True)), "uid", "left")
    ok = F.col("found").isNotNull() & (F.col("kind") == F.col("wanted"))
    good = joined.filter(F.coalesce(ok, F.lit(False))).drop("wanted", "found")
    return good, joined.filter(~F.coalesce(ok, F.lit(False))).select("uid", F.when(F.col("found").isNull(), "missing").otherwise("other kind").alias("problem"))


def replay(payloads: DataFrame, existing: DataFrame, roles: list[str]) -> DataFrame:
    """Facts from stored candidates, by the same steps as fresh ones but without an extractor."""
    rows = from_payload(payloads).withColumn("cand_id", F.concat_ws(":", "text_id", "no"))
    return ingest(rows, existing, roles)


def _delimiters(text: str, wanted: str) -> list[int]:
    """Positions of ``wanted`` characters outside brackets; a closing bracket without an opening one is ignored."""
    depth, found = 0, []
    for at, c in enumerate(text):
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth = max(0, depth - 1)
        elif depth == 0 and c in wanted:
            found.append(at)
    return found


def _pieces(text: str, start: int, stop: int, cuts: list[int]) -> Iterator[tuple[int, int]]:
    """Spans between cuts without blanks and punctuation at their ends, if any word is left."""
    edges = [start, *(c for c in cuts if start <= c < stop), stop]
    for no, (a, b) in enumerate(zip(edges, edges[1:])):
        a += no > 0
        while a < b and (text[a].isspace() or text[a] in ".;,:!?"):
            a += 1
        while b > a and (text[b - 1].isspace() or text[b - 1] in ".;,:!?"):
            b -= 1
        if any(c.isalnum() for c in text[a:b]):
            yield a, b


def segment_text(text: str) -> Iterator[tuple[str, int, int, int | None]]:
    """``kind, start, end, group`` of list items behind a colon, clauses between semicolons and plain sentences of a text."""
    line_start = 0
    for line in text.split("\n"):
        # a sentence ends behind a mark that a blank or the line's end follows, outside brackets
        marks = [m + 1 for m in _delimiters(line, ".!?") if m + 1 == len(line) or line[m + 1].isspace()]
        begin = 0
        for end in [*marks, len(line)]:
            if end <= begin:
                continue
            sentence, base = line[begin:end], line_start + begin
            colon = _delimiters(sentence, ":")
            if colon and any(c.isalnum() for c in sentence[colon[0] + 1 :]):
                cuts = [c for c in _delimiters(sentence, ",;") if c > colon[0]]
                for a, b in _pieces(sentence, colon[0] + 1, len(sentence), cuts):
                    yield "list_item", base + a, base + b, base + colon[0]
            else:
                found = list(_pieces(sentence, 0, len(sentence), _delimiters(sentence, ";")))
                for a, b in found:
                    yield "clause" if len(found) > 1 else "sentence", base + a, base + b, None
            begin = end
        line_start += len(line) + 1


def segments(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, no, kind, start, stop, list_at, body`` of every text (offsets in code points); null and blank texts have none."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = list(segment_text(text or ""))
                if found:
                    kinds, starts, stops, groups = zip(*found)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([uid] * len(found)), pa.array(range(len(found)), pa.int64()), pa.array(kinds), pa.array(starts, pa.int64()), pa.array(stops, pa.int64()), pa.array(groups, pa.int64()), pa.array([text[a:b] for a, b in zip(starts, stops)])],
                        names=[id_col, "no", "kind", "start", "stop", "list_at", "body"],
                    )

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(cut, f"{id_col} long, no long, kind string, start long, stop long, list_at long, body string")


def paragraph_batches(docs: DataFrame, most: int = 700, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, batch, body``: consecutive paragraphs packed up to ``most`` characters; a longer paragraph is a batch of its own."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                packs: list[list[str]] = []
                used = 0
                for paragraph in (p.strip() for p in (text or "").split("\n")):
                    if not paragraph:
                        continue
                    if packs and used + 1 + len(paragraph) <= most:
                        packs[-1].append(paragraph)
                        used += 1 + len(paragraph)
                    else:
                        packs.append([paragraph])
                        used = len(paragraph)
                if packs:
                    yield pa.RecordBatch.from_arrays([pa.array([uid] * len(packs)), pa.array(range(len(packs)), pa.int64()), pa.array(["\n".join(p) for p in packs])], names=[id_col, "batch", "body"])

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(pack, f"{id_col} long, batch long, body string")


def verb_facts(docs: DataFrame, verbs: list[str], pronouns: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, no, subject, verb, object`` of sentences with a verb between two words; a pronoun takes the last subject of its text."""
    cut = docs.select(F.col(id_col), F.posexplode(F.split(F.lower(text_col), r"[.!?\n]+")).alias("no", "sentence"))
    pattern = f"([a-z]+) ({'|'.join(verbs)}) ([a-z]+)"
    part = lambda k: F.regexp_extract("sentence", pattern, k)
    found = cut.select(id_col, "no", part(1).alias("said"), part(2).alias("verb"), part(3).alias("object")).filter("verb <> ''")
    own = F.when(~F.col("said").isin(*pronouns), F.col("said"))
    last = F.last(own, ignorenulls=True).over(Window.partitionBy(id_col).orderBy("no").rowsBetween(Window.unboundedPreceding, 0))
    return found.select(id_col, "no", last.alias("subject"), "verb", "object").filter("subject is not null")


def problems(candidates: DataFrame, roles: list[str]) -> DataFrame:
    """Candidates with ``problems``: names of the checks that fail, empty when none does."""
    names, values = F.map_keys("roles"), F.map_values("roles")
    checks = {
        "no relation": F.coalesce(F.trim("relation"), F.lit("")) == "",
        "confidence": F.coalesce((F.col("confidence") < 0) | (F.col("confidence") > 1), F.lit(True)),
        "no subject": ~F.array_contains(names, "SUBJECT"),
        "fewer than two roles": F.size(names) < 2,
        "unknown role": F.size(F.array_except(names, F.array(*[F.lit(r) for r in roles]))) > 0,
        "blank filler": F.exists(values, lambda v: F.coalesce(F.trim(v), F.lit("")) == ""),
    }
    return candidates.withColumn("problems", F.array_compact(F.array(*[F.when(bad, name) for name, bad in checks.items()])))


def split_coordinated(candidates: DataFrame) -> DataFrame:
    """One candidate per part where exactly one role holds two to four parts joined by "and" or commas."""
    parts = F.transform(F.map_entries("roles"), lambda e: F.struct(e["key"].alias("role"), F.split(e["value"], r"\s*,\s*|\s+and\s+").alias("parts")))
    many = F.filter(parts, lambda e: (F.size(e["parts"]) >= 2) & (F.size(e["parts"]) <= 4))
    opened = candidates.withColumn("many", many)
    one = F.size("many") == 1
    each = opened.withColumn("filler", F.explode(F.when(one, F.col("many")[0]["parts"]).otherwise(F.array(F.lit(None).cast("string")))))
    role = F.when(one, F.col("many")[0]["role"])
    replaced = F.transform_values("roles", lambda k, v: F.when(k == role, F.col("filler")).otherwise(v))
    return each.withColumn("roles", F.when(one, replaced).otherwise(F.col("roles"))).drop("many", "filler")


def gate(candidates: DataFrame, sources: DataFrame, least: float = 0.5) -> DataFrame:
    """Candidates with ``reason``: null if kept, else low confidence or a filler whose words its source text (``cand_id, text``) lacks."""
    asked = candidates.select("cand_id", F.explode(F.array_distinct(F.flatten(F.transform(F.map_values("roles"), words)))).alias("word"))
    said = sources.select("cand_id", F.explode(F.array_distinct(words(F.col("text")))).alias("word"))
    missing = asked.join(said, ["cand_id", "word"], "left_anti").select("cand_id").distinct().withColumn("absent", F.lit(True))
    reason = F.when(F.coalesce("confidence", F.lit(0.0)) < least, "confidence").when(F.col("absent"), "not in source")
    return candidates.join(missing, "cand_id", "left").withColumn("reason", reason).drop("absent")


def classify(text: Column, has_fact: Column) -> Column:
    """question, fact or message."""
    return F.when(F.coalesce(text, F.lit("")).rlike(r"\?\s*$"), "question").when(has_fact, "fact").otherwise("message")


def role_key(roles: Column) -> Column:
    """A role map as one string that does not depend on the order of its entries."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(roles)), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("")))), "|")


def dedupe_facts(candidates: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """The smallest cand_id of each relation, role map and kind, less what ``existing`` holds."""
    key = ["rel", "rolekey", "kind"]
    keyed = lambda df: df.withColumn("rel", canonical_label(F.col("relation"))).withColumn("rolekey", role_key(F.col("roles")))
    rank = F.row_number().over(Window.partitionBy(*key).orderBy("cand_id"))
    rows = keyed(candidates)
    if existing is not None:
        rows = rows.join(keyed(existing).select(*key).distinct(), key, "left_anti")
    return rows.withColumn("rank", rank).filter("rank = 1").drop("rank", "rel", "rolekey")


def epistemic_weight(kind: Column) -> Column:
    """Half of what the kind of statement weighs; an unknown kind weighs as an explanation."""
    out = F.lit(KIND_WEIGHT["explanation"])
    for name, weight in KIND_WEIGHT.items():
        out = F.when(kind == name, weight).otherwise(out)
    return 0.5 * out


def ingest(candidates: DataFrame, existing: DataFrame, roles: list[str]) -> DataFrame:
    """New factors ``fid, relation, roles, kind, w``: well-formed candidates, confident, not known yet; ids come from their content."""
    good = problems(candidates, roles).filter((F.size("problems") == 0) & (F.col("confidence") >= 0.5))
    new = dedupe_facts(good, existing)
    relation = canonical_label(F.col("relation"))
    return new.select(F.concat(F.lit("F_"), F.sha2(F.concat_ws("|", relation, "kind", role_key(F.col("roles"))), 256)).alias("fid"), relation.alias("relation"), "roles", "kind", epistemic_weight(F.col("kind")).alias("w"))


def members(factors: DataFrame) -> DataFrame:
    """``fid, pos, role, uid`` with the SUBJECT first and the other roles in order of name."""
    entries = F.array_sort(F.transform(F.map_entries("roles"), lambda e: F.struct((e["key"] != "SUBJECT").alias("later"), e["key"].alias("role"), e["value"].alias("uid"))))
    return factors.select("fid", F.posexplode(entries).alias("pos", "m")).select("fid", "pos", "m.role", "m.uid")


def anchors(facts: DataFrame, order: list[str]) -> DataFrame:
    """``conv_id, anchor``: filler of the first role in ``order`` of a conversation's first factual statement (``conv_id, seq, roles, kind``)."""
    first = F.coalesce(*[F.element_at("roles", r) for r in order])
    return facts.filter(F.col("kind").isin(*FACTUAL)).withColumn("filler", first).filter("filler is not null").groupBy("conv_id").agg(F.min_by("filler", "seq").alias("anchor"))


def upsert_entities(known: DataFrame, seen: DataFrame, tau: int) -> DataFrame:
    """``uid, forms, created_tau``: known symbols with new forms added, and new symbols stamped ``tau``. ``seen`` is ``uid, form``."""
    new = seen.groupBy("uid").agg(F.collect_set("form").alias("seen"))
    empty = F.array().cast("array<string>")
    forms = F.array_sort(F.array_union(F.coalesce("forms", empty), F.coalesce("seen", empty)))
    return known.join(new, "uid", "full").select("uid", forms.alias("forms"), F.coalesce("created_tau", F.lit(tau)).alias("created_tau"))


def assign_ids(df: DataFrame, order: list[str], prefix: str, base: int = 0) -> DataFrame:
    """Rows with ``uid`` prefix_00001 and on in an order: numbers within ranges, plus the size of the ranges before (one row each)."""
    ranged = cut_lineage(df.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    sizes = ranged.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    no = F.row_number().over(Window.partitionBy("part").orderBy(*order)) + F.col("before") + base
    return ranged.join(F.broadcast(before.select("part", "before")), "part").withColumn("uid", F.format_string(f"{prefix}_%05d", no.cast("long"))).drop("part", "before")


def add_properties(rows: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected of new properties ``uid, name, value``: a name that the row has, or a missing row, rejects."""
    have = rows.select("uid", F.explode(F.map_keys("props")).alias("name")).withColumn("taken", F.lit(True))
    checked = new.join(rows.select("uid", F.lit(True).alias("row")), "uid", "left").join(have, ["uid", "name"], "left")
    ok = F.col("row").isNotNull() & F.col("taken").isNull()
    return checked.filter(ok).select("uid", "name", "value"), checked.filter(~ok).select("uid", "name", F.when(F.col("row").isNull(), "missing row").otherwise("name taken").alias("reason"))


def render(relation: Column, roles: Column, template: Column) -> Column:
    """A template with each {ROLE} replaced by its filler."""
    return F.aggregate(F.map_entries(roles), F.coalesce(template, relation), lambda text, e: F.replace(text, F.concat(F.lit("{"), e["key"], F.lit("}")), F.coalesce(e["value"], F.lit(""))))


def coverage(parts: DataFrame, candidates: DataFrame) -> DataFrame:
    """``part_id, kind, support, covered``: candidates (``part_id, cand_id, roles``) that support a segment (``part_id, kind, body``).

    A sentence is covered by any candidate; a list item by one that names at least half of its words in its roles, a
    clause by one that names 0.6 of them. A segment without words needs none.
    """
    own = parts.select("part_id", F.explode(F.array_distinct(words(F.col("body")))).alias("word"))
    sizes = own.groupBy("part_id").agg(F.count("*").alias("n"))
    said = candidates.select("part_id", "cand_id", F.explode(F.array_distinct(F.flatten(F.transform(F.map_values("roles"), words)))).alias("word"))
    named = said.join(own, ["part_id", "word"]).groupBy("part_id", "cand_id").agg(F.count("*").alias("hit"))
    best = candidates.select("part_id", "cand_id").join(named, ["part_id", "cand_id"], "left").groupBy("part_id").agg(F.count("*").alias("support"), F.max(F.coalesce("hit", F.lit(0))).alias("hit"))
    rows = parts.join(sizes, "part_id", "left").join(best, "part_id", "left")
    support, share = F.coalesce("support", F.lit(0)), F.coalesce("hit", F.lit(0)) / F.col("n")
    covered = F.when(F.col("n").isNull(), True).when(F.col("kind") == "sentence", support > 0).otherwise(share >= F.when(F.col("kind") == "list_item", 0.5).otherwise(0.6))
    return rows.select("part_id", "kind", support.alias("support"), covered.alias("covered"))


def infer_list_items(items: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates for uncovered list items (``list_id, part_id, body``) from those of their siblings (``list_id, part_id, relation, roles``).

    They take the list's most common relation, if two siblings share it, its roles that never vary, and their own text
    as the role that varies most. ``part_id, relation, roles``.
    """
    counts = candidates.groupBy("list_id", "relation").agg(F.count("*").alias("n")).filter("n >= 2")
    modal = counts.groupBy("list_id").agg(F.min_by("relation", F.struct((-F.col("n")).alias("m"), "relation")).alias("relation"))
    fillers = candidates.join(modal, ["list_id", "relation"]).select("list_id", F.explode("roles").alias("role", "filler"))
    roles = fillers.groupBy("list_id", "role").agg(F.countDistinct("filler").alias("kinds"), F.min("filler").alias("filler"))
    shape = roles.groupBy("list_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("kinds") == 1, F.struct("role", "filler"))))).alias("stable"),
        F.min_by("role", F.struct((-F.col("kinds")).alias("m"), "role")).alias("varying"),
        F.max("kinds").alias("kinds"),
    )
    open_items = items.join(candidates.select("part_id").distinct(), "part_id", "left_anti")
    made = open_items.join(modal, "list_id").join(shape.filter("kinds > 1"), "list_id")
    return made.select("part_id", "relation", F.map_concat("stable", F.create_map("varying", "body")).alias("roles"))


def corpus(parts: DataFrame, empty: str = "(no facts)") -> DataFrame:
    """``graph_id, body``: a graph's distinct lines (``graph_id, seq, line``), without case, in order of first place; a sentinel if all are blank."""
    first = parts.withColumn("key", F.lower(F.trim(F.coalesce("line", F.lit(""))))).groupBy("graph_id", "key").agg(F.min(F.struct("seq", "line")).alias("first"))
    rows = first.groupBy("graph_id").agg(F.array_sort(F.collect_list(F.when(F.col("key") != "", F.col("first")))).alias("all"))
    return rows.select("graph_id", F.when(F.size("all") > 0, F.array_join(F.col("all.line"), "\n\n")).otherwise(empty).alias("body"))
