"""Text rules on titles: tokens, flags, lexicon scores, hooks and patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Categories of the queries on the driver's documents, whose words are invented (parameters, not rules).
LEXICON = {"function": ("the", "and", "of", "in"), "motion": ("tion", "ing", "er"), "insult": ("idiot", "moron", "clown", "trash"), "legal": ("license", "rights", "reserved")}


def tokens(x: Column) -> Column:
    return F.regexp_extract_all(F.lower(x), F.lit(r"([\p{L}\p{M}\p{N}_]+)"), F.lit(1))


def normalised(x: Column) -> Column:
    """Lower case, single spaces, no ASCII punctuation."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(x), r"[!-/:-@\[-`{-~]", " "), r"\s+", " "))


def uppercase_ratio(x: Column) -> Column:
    upper, letters = F.length(F.regexp_replace(x, r"[^A-Z]", "")), F.length(F.regexp_replace(x, r"[^A-Za-z]", ""))
    return F.coalesce(F.round(F.try_divide(upper.cast("double"), letters.cast("double")), 6), F.lit(0.0))


def lexicon_score(x: Column, terms: tuple[str, ...], low: Column | None = None) -> Column:
    """Share of terms that stand in the text, times 100. ``low``: the text in lower case, where a column has it already."""
    low = F.lower(x) if low is None else low
    hits = sum((F.when(F.contains(low, F.lit(t)), 1).otherwise(0) for t in terms), F.lit(0))
    return F.round(hits * 100.0 / len(terms), 4)


def arg_max(scores: dict[str, Column], otherwise: str = "unknown") -> Column:
    """The name of the largest positive score; ties go to the first."""
    best, out = F.greatest(*scores.values()), F.lit(otherwise)
    for name, s in reversed(scores.items()):
        out = F.when((s == best) & (s > 0), F.lit(name)).otherwise(out)
    return out


def jaccard(a: Column, b: Column) -> Column:
    """Of two token arrays as sets; both empty 1, one empty 0."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), union.cast("double")))


def sniffed_type(x: Column) -> Column:
    """null, bool, int, float or string, as a text column reads."""
    return F.when(x.isNull() | (x == ""), "null").when(x.isin("True", "False"), "bool").when(x.rlike(r"^-?[0-9]+$"), "int").when(x.rlike(r"^-?[0-9]+\.[0-9]+$"), "float").otherwise("string")


def iso_duration_seconds(x: Column) -> Column:
    """Seconds of P#DT#H#M#S; anything else 0."""
    part = lambda k: F.coalesce(F.regexp_extract(x, r"^P(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?)?$", k).try_cast("int"), F.lit(0))
    return part(1) * 86400 + part(2) * 3600 + part(3) * 60 + part(4)


def short_id(*parts: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 12)
