"""Column functions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-12


def clip(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def logistic(x: Column) -> Column:
    """1 / (1 + e^-x), without overflow on either side."""
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def logit(p: Column) -> Column:
    """Log odds; strengths of exactly 0 or 1 count as TINY away from it."""
    q = clip(p, TINY, 1 - TINY)
    return F.ln(q / (1 - q))


def damp(old: Column, new: Column, delta: Column | float) -> Column:
    """Share ``delta`` of the old message and the rest of the new one."""
    d = F.lit(delta) if isinstance(delta, float) else delta
    return (1 - d) * new + d * old


def pulled(p: Column, strength: Column | float) -> Column:
    """A message of one half moved towards p by a strength."""
    return F.lit(0.5) + (p - 0.5) * (F.lit(strength) if isinstance(strength, float) else strength)


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 when lengths differ or either vector is empty or zero."""
    length = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (length > 0), dot(a, b) / length).otherwise(0.0)


def l2_normalize(a: Column) -> Column:
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n))


def canonical_label(text: Column) -> Column:
    """Upper-case key with single underscores; blank text is RELATED_TO."""
    key = F.regexp_replace(F.regexp_replace(F.translate(F.upper(text), "Ё", "Е"), r"[^\p{L}\p{N}]+", "_"), r"^_+|_+$", "")
    return F.when(F.coalesce(key, F.lit("")) == "", "RELATED_TO").otherwise(key)


def fill_template(template: Column, roles: Column) -> Column:
    """``{ROLE}`` in a template replaced by the role's filler; null fillers are blank, unknown roles keep their braces."""
    replaced = lambda t, e: F.replace(t, F.concat(F.lit("{"), e["key"], F.lit("}")), F.coalesce(e["value"], F.lit("")))
    return F.aggregate(F.map_entries(roles), template, replaced)


def ngrams(text: Column, n: int) -> Column:
    """All runs of ``n`` characters of a text, which must have that many."""
    return F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, F.lit(n)))


def fold(text: Column) -> Column:
    """Lower case, dashes and underscores as spaces, single spaces."""
    return F.trim(F.regexp_replace(F.translate(F.lower(text), "ё_-–—", "е    "), r"\s+", " "))
