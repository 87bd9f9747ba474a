"""Column expressions: text, predicates and vectors. All run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Relations that say nothing (matched on the stripped, lower-cased name), and the label of mentions without a relation.
PLACEHOLDER_RELATIONS = (r"^new_relation", r"^unknown", r"^relation$", r"^error", r"^temp", r"^none", r"^null", r"^\w+_to_\w+$")
NO_RELATION = "no_relation"


def column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(column(c), r"(?U)^\s+|\s+$", "")


def type_lower(c: Column | str) -> Column:
    return F.lower(strip(c))


def type_upper(c: Column | str) -> Column:
    return F.upper(strip(c))


def span_text(tokens: Column | str, start: Column | str, end: Column | str) -> Column:
    """Tokens start to end, both included and counted from 0, joined by a space."""
    first, last = column(start), column(end)
    return F.array_join(F.slice(column(tokens), first + 1, F.greatest(last - first + 1, F.lit(0))), " ")


def fuzzy_match(a: Column | str, b: Column | str) -> Column:
    """Both given, and one contains the other when stripped and lower-cased."""
    a, b = column(a), column(b)
    x, y = F.lower(strip(a)), F.lower(strip(b))
    return F.coalesce((F.length(a) > 0) & (F.length(b) > 0) & (F.contains(y, x) | F.contains(x, y)), F.lit(False))


def meaningful(relation: Column | str) -> Column:
    """Longer than two characters, no placeholder, at most two underscores."""
    r = column(relation)
    name = F.lower(strip(r))
    placeholder = F.lit(False)
    for p in PLACEHOLDER_RELATIONS:
        placeholder = placeholder | name.rlike("(?U)" + p)
    underscores = F.length(r) - F.length(F.replace(r, F.lit("_"), F.lit("")))
    return F.coalesce((F.length(r) > 2) & ~placeholder & (underscores <= 2), F.lit(False))


def triple_text(subj_type: Column | str, relation: Column | str, obj_type: Column | str) -> Column:
    s, r, o = (F.coalesce(column(c), F.lit("None")) for c in (subj_type, relation, obj_type))
    return F.concat(F.lit("A "), s, F.lit(" has the relation '"), r, F.lit("' with a "), o, F.lit("."))


def relation_text(relation: Column | str) -> Column:
    return F.concat(F.lit("Relation: "), F.coalesce(column(relation), F.lit("None")))


def type_text(kind: Column | str) -> Column:
    """Null where there is no type."""
    k = column(kind)
    return F.when(k.isNotNull() & (k != ""), F.concat(F.lit("Entity Type: "), k))


def dot(a: Column | str, b: Column | str) -> Column:
    """Dot product in double precision; null if either is."""
    pairs = F.zip_with(column(a), column(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def norm(v: Column | str) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalise(v: Column | str) -> Column:
    """Unit length; the zero vector stays, null stays null."""
    size = F.greatest(norm(v), F.lit(1e-12))
    return F.transform(column(v), lambda x: x.cast("double") / size)


def euclidean(a: Column | str, b: Column | str) -> Column:
    squares = F.zip_with(column(a), column(b), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def masked_mean(vectors: Column | str, mask: Column | str, dim: int) -> Column:
    """Mean of the vectors whose mask is 1; the divisor is 1e-9 at least."""
    kept = F.zip_with(column(vectors), column(mask), lambda v, m: F.transform(v, lambda x: x.cast("double") * m))
    total = F.aggregate(kept, F.array_repeat(F.lit(0.0), dim), lambda s, v: F.zip_with(s, v, lambda x, y: x + y))
    n = F.greatest(F.aggregate(column(mask), F.lit(0.0), lambda s, m: s + m), F.lit(1e-9))
    return F.transform(total, lambda x: x / n)


def last_unmasked(vectors: Column | str, mask: Column | str) -> Column:
    """The vector at the last position whose mask is 1 (padding may be on either side); null without one."""
    position = F.array_max(F.transform(column(mask), lambda m, i: F.when(m == 1, i + 1)))
    return F.element_at(column(vectors), position)


def cosine_unit_interval(x: Column | str, own_a: Column | str, own_b: Column | str) -> Column:
    """A similarity divided by the root of both diagonal entries, clamped to [-1, 1] and mapped to [0, 1]."""
    size = F.sqrt(F.greatest(column(own_a), F.lit(1e-6)) * F.greatest(column(own_b), F.lit(1e-6)))
    value = F.nanvl(column(x) / size, F.lit(0.0))
    value = F.when(F.abs(value) == float("inf"), 0.0).otherwise(value)
    return (F.greatest(F.least(value, F.lit(1.0)), F.lit(-1.0)) + 1) / 2


def cosine_distance(a: Column | str, b: Column | str) -> Column:
    """One less the cosine; 1e-8 is added to both lengths."""
    return 1 - dot(a, b) / ((norm(a) + 1e-8) * (norm(b) + 1e-8))


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(column(a).cast("double"), column(b).cast("double")), F.lit(0.0))
