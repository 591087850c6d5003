"""Keyed surrogates for personal data; DataFrame functions only.

Entities (e-mail, phone, card, bank account, social security number, IP address, name) are detected in whole texts.
Every distinct entity gets one surrogate in the whole corpus, drawn from a keyed hash: the format stays (lengths,
punctuation, case, digits as digits, letters in their script), cards keep their first digit and a valid check digit.
Surrogates that collide with one another or with a real entity are drawn again, and grow by a character per draw once
their format proves full, so distinct entities always end up distinct and mentions of one entity agree.

Names are found by their titles and exchanged word by word: a family name has one surrogate wherever it stands, so "Mr.
Smith", "Dr Smith" and "Mrs Jane SMITH" stay one family; a given name has one for its gender, which the title tells, or
another mention in the document, or else most titles that the name has in the corpus. In a document with a titled name,
its words are also exchanged where they stand without a title (capitalised), and so are one or two capitalised words,
but for :data:`NO_NAMES`, directly before a known family name ("John Smith" in a text that knows "Mr. Smith") and their
other mentions. Names in a document without any title are not found.

Bank accounts keep their country and the remainder of their check digits, so valid ones stay valid. Addresses of private,
loopback, link-local and multicast ranges stay in them and public ones outside.

Plan: mentions are taken from the texts, distinct entities are aggregated before the shuffle, drawn, and joined back to
the (narrow) mentions, the few very frequent ones by broadcast; one row per document carries its surrogates in order to
the text, which is cut at the mentions and put together again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, null_safe_text, read, require

#: The key where the session names none in ``spark.factloom.surrogate.key``.
KEY = "factloom"
#: Draws after which a surrogate grows by a character per further draw.
PLAIN_DRAWS = 4
#: An entity is told to every task when it has more mentions than 1 in HOT_SHARE of all (and HOT_LEAST), so HOT_SHARE
#: rows of HOT_CHARS characters at most are broadcast; the rest is joined by key.
HOT_SHARE, HOT_LEAST, HOT_CHARS = 5_000, 50_000, 500

_TITLE_F = r"Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|Signora|Г-жа"
_TITLE_M = r"Mr|Herr|Monsieur|Señor|Sr|Signor|Г-н"
_TITLE = rf"(?:{_TITLE_F}|{_TITLE_M}|Dr|Prof)"
_CAPITALISED = r"\p{Lu}[\p{L}'’-]*+"
# Detection patterns, in the order in which a mention is classified. No group repeats without a bound: the matcher would
# call itself once per repetition.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9][A-Za-z0-9.-]*\.[A-Za-z]{2,}",
    "name": rf"(?<!\p{{L}}){_TITLE}\.? {_CAPITALISED}(?: {_CAPITALISED})?",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": r"(?<![\d.])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?!\d|\.\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)|(?<![\w(])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\d.-])\d{3}[.-]\d{3}[.-]\d{4}(?!\d)",
    "card": r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-])",
}
ANY = "|".join(PATTERNS.values())
#: What is cut out of documents with titled names: every capitalised word as well.
WITH_WORDS = rf"{ANY}|(?<!\p{{L}}){_CAPITALISED}"
_HAS_NAME = rf"(?<!\p{{L}}){_TITLE}\.? \p{{Lu}}"
# Syllables that names are built from, by script, and endings of given names by gender.
_SYLLABLES = {
    "latin": "ba be bo da de do ka ke ko la le lo ma me mo na ne no ra re ro sa se so ta te to va ve vo wa".split(),
    "cyrillic": "ба бе бо да де до ка ке ко ла ле ло ма ме мо на не но ра ре ро са се со та те то ва ве во за".split(),
    "greek": "βα βε βο δα δε δο κα κε κο λα λε λο μα με μο να νε νο ρα ρε ρο σα σε σο τα τε το φα φε φο πα".split(),
}
_ENDINGS = {
    "latin": {"f": "na ra lia ssa".split(), "m": "n rt ld s".split(), "n": "l m t k".split()},
    "cyrillic": {"f": "на ра лия ся".split(), "m": "н р й м".split(), "n": "ль т к с".split()},
    "greek": {"f": "να ρα λια σσα".split(), "m": "νος ρος λης μας".split(), "n": "λι μι τι κι".split()},
}
_IS_SCRIPT = {"cyrillic": r"\p{IsCyrillic}", "greek": r"\p{IsGreek}"}


# Capitalised words that begin a sentence or name a day or month, and are no given names before a family name.
NO_NAMES = (
    "the a an and but or if when while where then so as at by for from in of on to with about after before since that this these those "
    "he she it they we you i his her its their our your my who what why how yes no not dear hi hello thanks "
    "monday tuesday wednesday thursday friday saturday sunday january february march april june july august september october november december "
    "der die das ein eine und oder aber wenn mit von zu le la les un une et ou mais el los las una y o pero и а но в на с о"
).split()


def _pattern(text: Column) -> Column:
    return F.when(text.rlike(_HAS_NAME), F.lit(WITH_WORDS)).otherwise(F.lit(ANY))


def _kind(mention: Column) -> Column:
    """The kind of a mention; ``word`` for a capitalised word that no pattern claims."""
    out = F.when(mention.rlike(rf"^{_CAPITALISED}$"), "word")
    for kind, pattern in PATTERNS.items():
        out = out.when(mention.rlike(f"^(?:{pattern})$"), kind)
    return out.otherwise("card")


def _canonical(kind: Column, mention: Column) -> Column:
    """Spellings of one entity agree: case of addresses, separators of numbers."""
    digits = F.regexp_replace(mention, r"[^0-9A-Za-z+]", "")
    return F.when(kind == "email", F.lower(mention)).when(kind.isin("phone", "card", "iban", "ssn"), F.upper(digits)).otherwise(mention)


def _byte(digest: Column, i: Column | int) -> Column:
    """Byte number i of a hex digest of 64 bytes, going round."""
    at = (F.lit(i) if isinstance(i, int) else i) % 64
    return F.conv(F.substring(digest, (at * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int")


def _pick(values: list[str], number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (number % len(values) + 1).cast("int"))


def _chars(text: Column, digest: Column, keep: Column | None = None) -> Column:
    """Every letter and digit of ``text`` exchanged for another of its script, case and kind; the rest stays."""

    def one(c: Column, i: Column) -> Column:
        b = _byte(digest, i) + F.floor(i / 64)
        code = F.ascii(c)
        low = lambda first, size: F.chr((b % size + first).cast("long")) if first < 128 else F.element_at(F.array(*[F.lit(chr(first + k)) for k in range(size)]), (b % size + 1).cast("int"))
        new = (
            F.when(c.between("0", "9"), low(48, 10))
            .when(c.between("a", "z"), low(97, 26))
            .when(c.between("A", "Z"), low(65, 26))
            .when(c.between("а", "я"), low(0x430, 32))
            .when(c.between("А", "Я"), low(0x410, 32))
            .when(c.between("α", "ρ"), low(0x3B1, 17))
            .when(c.between("Α", "Ρ"), low(0x391, 17))
            .when(code > 127, c)
            .otherwise(c)
        )
        return new if keep is None else F.when(i < keep, c).otherwise(new)

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _card(canonical: Column, digest: Column) -> Column:
    """Digits with the first kept and the last set so that the check sum has the original's remainder."""
    n = F.length(canonical)
    drawn = _chars(canonical, digest, keep=F.lit(1))
    head = F.substring(drawn, F.lit(1), n - 1)

    def total(text: Column) -> Column:  # with the place of the check digit still to come
        doubled = lambda d: F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
        places = F.transform(F.split(F.reverse(text), ""), lambda c, i: F.when(i % 2 == 0, doubled(c.cast("int"))).otherwise(c.cast("int")))
        return F.aggregate(places, F.lit(0), lambda acc, x: acc + x)

    was = (total(F.substring(canonical, F.lit(1), n - 1)) + F.substring(canonical, n, F.lit(1)).cast("int")) % 10
    return F.concat(head, F.pmod(was - total(head), F.lit(10)).cast("string"))


def _iban(canonical: Column, digest: Column) -> Column:
    """Another account of the country, with check digits that leave the original's remainder (1 if it is valid)."""

    def remainder(text: Column) -> Column:
        step = lambda acc, c: F.when(c.between("0", "9"), acc * 10 + F.ascii(c) - 48).otherwise(acc * 100 + F.ascii(c) - 55) % 97
        return F.aggregate(F.split(text, ""), F.lit(0), step)

    country, account = F.substring(canonical, 1, 2), F.substring(_chars(canonical, digest, keep=F.lit(4)), F.lit(5), F.length(canonical))
    was = remainder(F.concat(F.substring(canonical, F.lit(5), F.length(canonical)), F.substring(canonical, 1, 4)))
    check = F.pmod(was - remainder(F.concat(account, country, F.lit("00"))), F.lit(97))
    check = F.when(check < 2, check + 97).otherwise(check)  # check digits go from 02 to 98
    return F.concat(country, F.lpad(check.cast("string"), 2, "0"), account)


#: First numbers of public addresses; those of ranges with another use, wholly or in part, are left out.
_PUBLIC = [n for n in range(1, 224) if n not in (10, 100, 127, 169, 172, 192, 198, 203)]


def _ip(canonical: Column, digest: Column) -> Column:
    """Another address of the same range: private, loopback, link-local, multicast, reserved or public."""
    b = [_byte(digest, k) for k in range(4)]
    first = F.split(canonical, r"\.")[0].cast("int")
    kept = F.regexp_extract(canonical, r"^(192\.168|169\.254|10|127|0)\.", 1)
    drawn = [(x % 254 + 1).cast("string") for x in b]
    shared = F.when(kept.contains("."), F.concat_ws(".", kept, *drawn[2:])).when(kept != "", F.concat_ws(".", kept, *drawn[1:]))
    shared = shared.when(canonical.rlike(r"^172\.(1[6-9]|2\d|3[01])\."), F.concat_ws(".", F.lit("172"), (b[1] % 16 + 16).cast("string"), *drawn[2:]))
    return shared.otherwise(F.concat_ws(".", F.when(first >= 240, b[0] % 15 + 240).when(first >= 224, b[0] % 16 + 224).otherwise(_pick(_PUBLIC, b[0])).cast("string"), *drawn[1:]))


def _word(canonical: Column, digest: Column, extra: Column, gender: Column | None) -> Column:
    """A name in the script of ``canonical``: syllables, and for a given name an ending that tells the gender."""

    def build(script: str) -> Column:
        picked = F.transform(F.sequence(F.lit(1), 2 + extra), lambda k: F.element_at(F.array(*[F.lit(x) for x in _SYLLABLES[script]]), (_byte(digest, k) % len(_SYLLABLES[script]) + 1).cast("int")))
        stem = F.array_join(picked, "")
        if gender is None:
            return F.concat(stem, _pick(_SYLLABLES[script], _byte(digest, 60)), F.when(_byte(digest, 61) % 2 == 0, _pick(_SYLLABLES[script], _byte(digest, 62))).otherwise(""))
        ends = _ENDINGS[script]
        return F.concat(stem, F.when(gender == "f", _pick(ends["f"], _byte(digest, 63))).when(gender == "m", _pick(ends["m"], _byte(digest, 63))).otherwise(_pick(ends["n"], _byte(digest, 63))))

    out = None
    for script, pattern in _IS_SCRIPT.items():
        out = (F if out is None else out).when(canonical.rlike(pattern), build(script))
    return out.otherwise(build("latin"))


def _draw(kind: Column, canonical: Column, draw: Column, key: str) -> Column:
    """The surrogate of a canonical entity at a draw; late draws are longer."""
    digest = F.sha2(F.concat_ws("\u0001", F.lit(key), kind, canonical, draw.cast("string")), 512)
    # bound to a variable, so that it is computed once and not for every character
    return F.element_at(F.transform(F.array(digest), lambda d: _drawn(kind, canonical, draw, d)), 1)


def _drawn(kind: Column, canonical: Column, draw: Column, digest: Column) -> Column:
    extra = F.greatest(draw - PLAIN_DRAWS, F.lit(0))
    wide_ip = F.concat_ws(":", F.lit("2001:db8"), *[F.substring(digest, 4 * k + 1, 4) for k in range(6)])
    top = F.length(F.regexp_extract(canonical, r"(\.[A-Za-z]+)$", 1))
    local = F.concat(F.repeat(F.lit("a"), extra), F.substring(canonical, F.lit(1), F.length(canonical) - top))
    email = F.concat(_chars(local, digest), F.substring(canonical, F.length(canonical) - top + 1, top))
    keep = F.when(canonical.startswith("+"), F.lit(2)).otherwise(F.lit(0))
    n = F.length(canonical)
    longer = F.concat(canonical, F.repeat(F.lit("0"), extra))
    card = F.concat(F.substring(canonical, F.lit(1), n - 1), F.repeat(F.lit("0"), extra), F.substring(canonical, n, F.lit(1)))
    return (
        F.when(kind == "email", email)
        .when(kind == "family", _word(canonical, digest, extra, None))
        .when(kind.startswith("given"), _word(canonical, digest, extra, F.substring(kind, 7, 1)))
        .when(kind == "ip", F.when(extra > 0, wide_ip).otherwise(_ip(canonical, digest)))
        .when(kind == "card", _card(card, digest))
        .when(kind == "iban", _iban(longer, digest))
        .when(kind == "phone", _chars(longer, digest, keep=keep))
        .otherwise(_chars(longer, digest))
    )


def _shape(kind: Column, mention: Column, surrogate: Column) -> Column:
    """The canonical surrogate in the mention's format: separators and case of the mention; what it has grown by comes last."""
    plain = F.split(surrogate, "")
    marks = F.split(mention, "")
    taken = lambda c: c.rlike("[0-9A-Za-z+]")
    # number of kept characters up to each place
    places = F.transform(marks, lambda c, i: F.when(taken(c), F.size(F.filter(F.slice(marks, 1, i + 1), taken))).otherwise(0))
    spread = F.array_join(F.zip_with(marks, places, lambda c, p: F.when(p > 0, F.get(plain, p - 1)).otherwise(c)), "")
    grown = F.substring(surrogate, F.size(F.filter(marks, taken)) + 1, F.length(surrogate))
    cased = F.array_join(F.zip_with(marks, plain, lambda c, s: F.when(c.rlike("[A-Z]"), F.upper(s)).otherwise(s)), "")
    email = F.when(F.length(mention) == F.length(surrogate), cased).otherwise(surrogate)
    return F.when(kind == "email", email).when(kind.isin("phone", "card", "iban", "ssn"), F.concat(spread, grown)).otherwise(surrogate)


def _in_case(word: Column, surrogate: Column) -> Column:
    return F.when((F.length(word) > 1) & (word == F.upper(word)), F.upper(surrogate)).otherwise(F.initcap(surrogate))


def entity_surrogates(entities: DataFrame, key: str = KEY) -> DataFrame:
    """``kind, canonical, surrogate`` of distinct entities; all surrogates of a kind differ from each other and from all entities.

    Family names and given names of any gender count as one kind here. The first in order of draw and canonical text keeps a contested surrogate, the others draw again. A surrogate grows
    by one character per draw after :data:`PLAIN_DRAWS`, so formats with fewer values than entities end as well.
    """
    settled = materialize(entities.select("kind", "canonical", F.lit(0).alias("draw")), "pii-entities")
    no = 0
    while True:
        no += 1
        drawn = settled.withColumn("surrogate", _draw(F.col("kind"), F.col("canonical"), F.col("draw"), key))
        space = F.when((F.col("kind") == "family") | F.col("kind").startswith("given"), "name").otherwise(F.col("kind")).alias("space")
        real = settled.select(space, F.col("canonical").alias("surrogate"), F.lit(True).alias("real")).distinct()
        contested = drawn.select("*", space).join(real, ["space", "surrogate"], "left").withColumn("rank", F.row_number().over(Window.partitionBy("space", "surrogate").orderBy("draw", "canonical", "kind")))
        again = contested.withColumn("again", F.coalesce("real", F.lit(False)) | (F.col("rank") > 1)).select("kind", "canonical", "draw", "surrogate", "again")
        again = materialize(again, "pii-drawn")
        if not again.filter("again").limit(1).count():
            return again.select("kind", "canonical", "surrogate")
        settled = again.select("kind", "canonical", F.when(F.col("again"), F.lit(no)).otherwise(F.col("draw")).alias("draw"))


def _attach(rows: DataFrame, surrogates: DataFrame, hot: DataFrame, kind: str, canonical: str, out: str) -> DataFrame:
    """``rows`` (a written table) with the surrogate of (kind, canonical) as ``out``; rows without a canonical get null."""
    keyed = lambda table: table.select(F.col("kind").alias("_kind"), F.col("canonical").alias("_canonical"), F.col("surrogate").alias(out))
    same = (F.col(kind) == F.col("_kind")) & (F.col(canonical) == F.col("_canonical"))
    some = rows.filter(F.col(canonical).isNotNull())
    told = F.broadcast(keyed(hot))
    by_broadcast = some.join(told, same)
    by_key = some.join(told, same, "left_anti").join(keyed(surrogates), same)
    none = rows.filter(F.col(canonical).isNull()).withColumn(out, F.lit(None).cast("string"))
    return by_broadcast.unionByName(by_key).drop("_kind", "_canonical").unionByName(none)


def _hot(counts: DataFrame) -> Column:
    """Whether a row of ``counts`` (``canonical, n``) has so many mentions that it is told to every task."""
    least = F.greatest(F.lit(HOT_LEAST), F.lit((counts.agg(F.sum("n")).first()[0] or 0) // HOT_SHARE))
    return (F.col("n") > least) & (F.length("canonical") <= HOT_CHARS)


def _genders(rows: DataFrame) -> DataFrame:
    """``rows`` (a written table with ``given, gender``) with the gender that most titles of the corpus give the name where it
    has none, else n; as ``given_kind``."""
    counts = materialize(rows.filter("given is not null").groupBy(F.lit("gender").alias("kind"), F.col("given").alias("canonical")).agg(F.count("*").alias("n"), F.count_if(F.col("gender") == "f").alias("f"), F.count_if(F.col("gender") == "m").alias("m")), "pii-genders")
    told = F.when((F.col("f") == 0) & (F.col("m") == 0), "n").when(F.col("f") >= F.col("m"), "f").otherwise("m").alias("surrogate")
    asking = rows.withColumn("_asks", F.lit("gender")).withColumn("_given", F.when(F.col("gender").isNull(), F.col("given")))
    out = _attach(asking, counts.select("kind", "canonical", told), counts.filter(_hot(counts)).select("kind", "canonical", told), "_asks", "_given", "_told")
    return out.withColumn("given_kind", F.concat(F.lit("given_"), F.coalesce("gender", "_told"))).drop("_asks", "_given", "_told", "gender")


def _names(found: DataFrame) -> DataFrame:
    """Titled names and the words of their documents that belong to one, cut into words; other words have none.

    ``h, id, pos, kind, mention, title, given_word, gap, family_word, tail, given_kind, given, family``
    """
    titled = found.filter("kind = 'name'")
    cut = r"^(\S+ )(\S+?)(?: (\S+?))?(['’]s)?$"
    part = lambda k: F.regexp_extract("mention", cut, k)
    two = part(3) != ""
    titled = titled.select(
        "h", "id", "pos", "kind", "mention", part(1).alias("title"), F.when(two, part(2)).alias("given_word"),
        F.when(two, " ").otherwise("").alias("gap"), F.when(two, part(3)).otherwise(part(2)).alias("family_word"), part(4).alias("tail"),
        F.when(F.col("mention").rlike(rf"^(?:{_TITLE_F})\b"), "f").when(F.col("mention").rlike(rf"^(?:{_TITLE_M})\b"), "m").alias("gender"),
    ).withColumn("given", F.lower("given_word")).withColumn("family", F.lower("family_word"))
    # a title that tells no gender takes that of the same given name in the document
    titled = materialize(titled.withColumn("gender", F.coalesce("gender", F.min("gender").over(Window.partitionBy("h", "id", "given")))), "pii-names")

    known = titled.select("h", "id", F.col("family").alias("word"), F.lit("family").alias("part"), F.lit(None).cast("string").alias("of"))
    known = known.unionByName(titled.filter("given is not null").select("h", "id", F.col("given").alias("word"), F.lit("given").alias("part"), F.col("gender").alias("of")))
    known = known.groupBy("h", "id", "word").agg(F.min("part").alias("part"), F.min("of").alias("of"))  # family before given
    words = found.filter("kind = 'word'")
    words = words.select("h", "id", "pos", "joined", "mention", F.regexp_replace("mention", "['’]s$", "").alias("plain"), F.regexp_extract("mention", "(['’]s)$", 1).alias("tail"))
    words = materialize(words.withColumn("word", F.lower("plain")).join(known, ["h", "id", "word"], "left"), "pii-capitalised")
    # one or two words directly before a family name
    order = Window.partitionBy("h", "id").orderBy("pos")
    ahead = lambda column, k: F.lead(column, k).over(order)
    touches = lambda k: F.coalesce((ahead("pos", k) == F.col("pos") + k) & ahead("joined", k), F.lit(False))
    free = F.col("part").isNull() & (F.col("tail") == "") & ~F.col("word").isin(NO_NAMES)
    near = words.select("h", "id", "word", free.alias("free"), touches(1).alias("t1"), touches(2).alias("t2"), ahead("part", 1).alias("p1"), ahead("part", 2).alias("p2"), ahead(~F.col("word").isin(NO_NAMES) & (F.col("tail") == ""), 1).alias("f1"))
    near = near.filter(F.col("free") & F.col("t1") & ((F.col("p1") == "family") | (F.col("t2") & F.col("f1") & (F.coalesce("p1", F.lit("given")) == "given") & (F.col("p2") == "family"))))
    words = words.join(near.select("h", "id", "word", F.lit("given").alias("more")).distinct(), ["h", "id", "word"], "left").withColumn("part", F.coalesce("part", "more"))
    is_family, is_given = F.col("part") == "family", F.col("part") == "given"
    words = words.select(
        "h", "id", "pos", F.when(F.col("part").isNotNull(), "name").alias("kind"), "mention", F.lit("").alias("title"), F.when(is_given, F.col("plain")).alias("given_word"), F.lit("").alias("gap"),
        F.when(is_family, F.col("plain")).alias("family_word"), "tail", F.when(is_given, F.col("word")).alias("given"), F.when(is_family, F.col("word")).alias("family"), F.when(is_given, F.col("of")).alias("gender"),
    )
    return _genders(materialize(titled.unionByName(words), "pii-parts"))


def replace_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: str | None = None) -> DataFrame:
    """``docs`` with its text replaced and ``n_entities`` and ``entities`` (kind, surrogate in order) added.

    Null text stays null and has no entities; rows that share id and text share their result. Other columns stay,
    whatever their names; ``n_entities`` and ``entities`` are replaced. An empty table gives an empty result.
    """
    require(docs, id_col, text_col)
    key = docs.sparkSession.conf.get("spark.factloom.surrogate.key", KEY) if key is None else key
    others = [c for c in docs.columns if c not in ("n_entities", "entities")]
    id_text = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"), F.xxhash64(id_text, F.col(text_col)).alias("h"), id_text.alias("id"), F.col(text_col).alias("text"))
    body = null_safe_text("text")
    mentions = F.regexp_extract_all(body, _pattern(body), F.lit(0)).alias("mention")
    # whether a mention follows the last one after a single space
    joined = F.when(body.rlike(_HAS_NAME), F.transform(F.split(body, _pattern(body), -1), lambda p: p == " ")).otherwise(F.array().cast("array<boolean>")).alias("joined")
    found = keyed.select("h", "id", F.posexplode(F.arrays_zip(mentions, joined)).alias("pos", "m")).select("h", "id", "pos", "m.mention", "m.joined").filter("mention is not null").distinct()
    found = found.withColumn("kind", _kind(F.col("mention"))).withColumn("canonical", F.when(~F.col("kind").isin("name", "word"), _canonical(F.col("kind"), F.col("mention"))))
    found = materialize(found, "pii-mentions")
    names = materialize(_names(found), "pii-words").withColumn("family_kind", F.lit("family"))
    plain = found.filter("canonical is not null")

    seen = plain.select("kind", "canonical").unionByName(names.filter("family is not null").select(F.col("family_kind").alias("kind"), F.col("family").alias("canonical")))
    seen = seen.unionByName(names.filter("given is not null").select(F.col("given_kind").alias("kind"), F.col("given").alias("canonical")))
    counts = materialize(seen.groupBy("kind", "canonical").agg(F.count("*").alias("n")), "pii-counts")
    surrogates = entity_surrogates(counts.select("kind", "canonical"), key)
    hot = counts.filter(_hot(counts)).select("kind", "canonical").join(surrogates, ["kind", "canonical"])

    shaped = _attach(plain, surrogates, hot, "kind", "canonical", "new").select("h", "id", "pos", "kind", _shape(F.col("kind"), F.col("mention"), F.col("new")).alias("new"))
    half = materialize(_attach(names, surrogates, hot, "family_kind", "family", "family_new"), "pii-families")
    whole = _attach(half, surrogates, hot, "given_kind", "given", "given_new")
    given = F.coalesce(_in_case(F.col("given_word"), F.col("given_new")), F.lit(""))
    family = F.coalesce(_in_case(F.col("family_word"), F.col("family_new")), F.lit(""))
    renamed = whole.select("h", "id", "pos", "kind", F.when(F.col("kind").isNull(), F.col("mention")).otherwise(F.concat("title", given, "gap", family, "tail")).alias("new"))

    per_doc = shaped.unionByName(renamed).groupBy("h", "id").agg(F.sort_array(F.collect_list(F.struct("pos", "kind", "new"))).alias("found"))
    joined = keyed.join(per_doc, ["h", "id"], "left")
    news = F.transform("found", lambda x: x["new"])
    parts = F.split(F.col("text"), _pattern(body), -1)
    text = F.when(F.col("found").isNull(), F.col("text")).otherwise(F.array_join(F.zip_with(parts, F.concat(news, F.array(F.lit(""))), lambda p, s: F.concat(p, s)), ""))
    real = F.filter("found", lambda x: x["kind"].isNotNull())
    entities = F.coalesce(F.transform(real, lambda x: F.struct(x["kind"].alias("kind"), x["new"].alias("surrogate"))), F.array().cast("array<struct<kind:string,surrogate:string>>"))
    return joined.select(*[text.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in others], F.size(entities).cast("long").alias("n_entities"), entities.alias("entities"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = replace_personal_data(read(spark, sf_dir, "documents").select("doc_id", "text"))
    of = lambda kind: F.size(F.filter("entities", lambda e: e["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", "n_entities", *[of(k) for k in PATTERNS], "text")
