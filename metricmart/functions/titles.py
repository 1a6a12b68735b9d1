"""Ordered title rules, topics by two best scores, title strength, value for transcription, quota and freshness levels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from metricmart.functions import scalar as S

#: Words that mark a pattern where a lower-cased title holds one, in the order in which patterns are named.
TITLE_WORDS = {
    "mistake": ("error", "errores", "no hagas"),
    "promise_gain": ("gana", "ganar", "mejora", "rápido", "facil", "fácil"),
    "promise_save": ("ahorra", "ahorrar", "dinero", "costo"),
    "new_tool": ("nuevo", "herramienta", "tool", "chatgpt", "gemini", "claude"),
    "comparison": (" vs ", "compar", "mejor que"),
    "tutorial_how_to": ("cómo", "como", "tutorial", "guía", "guia", "paso a paso"),
    "personal_experiment": ("probé", "probe", "intenté", "mi experiencia", "24 horas", "30 días", "30 dias"),
    "news_update": ("noticia", "actualización", "actualizacion", "última hora", "ultimo minuto", "acaba de"),
    "contrarian": ("nadie", "mito", "la verdad", "no necesitas", "deja de"),
}


def title_patterns(title: Column, has_number: Column, has_question: Column, hook: Column, ai: Column, finance: Column, low: Column | None = None) -> Column:
    """All patterns of a title in their order; ``unknown`` alone if there is none. NULL inputs hold nothing. ``low``: the
    title in lower case, where a column has it already."""
    low = F.lower(title) if low is None else low
    rules = [("numbered_list", has_number), ("question", has_question), ("warning", hook == "warning")]
    for name, words in TITLE_WORDS.items():
        held = F.lit(False)
        for w in words:
            held = held | F.contains(low, F.lit(w))
        rules.append((name, held))
    rules += [("semantic_ai_tool", ai > 0), ("semantic_finance", finance > 0)]
    found = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in rules]))
    return F.when(F.size(found) == 0, F.array(F.lit("unknown"))).otherwise(found)


def two_best(scores: dict[str, Column]) -> tuple[Column, Column, Column]:
    """The names of the highest and second highest score (ties in the order given; ``unknown`` if it isn't positive) and
    the highest score."""
    ranked = F.sort_array(F.array(*[F.struct((-S.zero(s.cast("double"))).alias("s"), F.lit(i).alias("i"), F.lit(n).alias("n")) for i, (n, s) in enumerate(scores.items())]))
    name = lambda k: F.when(F.get(ranked, F.lit(k))["s"] < 0, F.get(ranked, F.lit(k))["n"]).otherwise("unknown")
    return name(0), name(1), -ranked[0]["s"]


def topic_confidence(best: Column, cluster_hits: Column, title_hit: Column, latent: bool = False) -> Column:
    """0.60 of the score, 0.25 of 30 a term that the cluster's label shares (10 more with latent vectors), 0.15 of 100 if
    a term stands in the title; at most 100, and 0 without a positive score."""
    cluster = F.least(F.least(cluster_hits * 30.0, F.lit(100.0)) + (10.0 if latent else 0.0), F.lit(100.0))
    whole = S.weighted_sum((0.60, best), (0.25, cluster), (0.15, F.when(title_hit, 100.0).otherwise(0.0)))
    return F.when(best > 0, F.round(F.least(whole, F.lit(100.0)) + 1e-9, 4)).otherwise(0.0)


def originality_status(copy_risk: Column) -> Column:
    return F.when(copy_risk >= 70, "risky").when(copy_risk >= 40, "review").otherwise("safe")


def title_strength(pattern_score: Column, originality: Column) -> Column:
    return F.round(0.6 * pattern_score + 0.4 * originality + 1e-9, 4)


def transcription_value(decision: Column, hybrid: Column, creative: Column, topic: Column, alpha: Column, confidence: Column) -> Column:
    """Weighted mean over the scores that are known, from 0 to 100; 0 if none is."""
    mean = S.weighted_renormalised((0.30, decision), (0.20, hybrid), (0.20, creative), (0.15, topic), (0.10, alpha), (0.05, confidence))
    return F.coalesce(F.round(S.clamp(mean) + 1e-9, 4), F.lit(0.0))


def pattern_success(hybrid: Column, decision: Column, alpha: Column, model: Column) -> Column:
    return F.round(F.least(S.weighted_sum((0.35, hybrid), (0.25, decision), (0.20, alpha), (0.20, model)), F.lit(100.0)) + 1e-9, 4)


def quota_units(uncached: Column, channels: Column, videos: Column, pages: int = 1, batch: int = 50) -> Column:
    """One unit an uncached channel, one a channel and page, one a batch of videos."""
    return (uncached + channels * pages + F.ceil(videos / float(batch))).cast("long")


def quota_status(units: Column, soft: int = 1000, warning: int = 5000, operational: int = 7000) -> Column:
    return F.when(units >= operational, "over_operational_limit").when(units >= warning, "warning").when(units >= soft, "soft_warning").otherwise("ok")


def freshness(found: Column, required: int, age_hours: Column, max_age_hours: float) -> Column:
    """Of ``required`` inputs so many were found, the latest so old: not_initialized without any, stale_expected beyond
    the age, generation_error if some are missing, else ready."""
    return F.when(found == 0, "not_initialized").when(age_hours > max_age_hours, "stale_expected").when(found < required, "generation_error").otherwise("ready")


def uppercase_share(x: Column) -> Column:
    """Capitals of all letters of any alphabet, times 100; 0 without letters."""
    letters = F.length(F.regexp_replace(x, r"[^\p{L}]", ""))
    return F.coalesce(F.round(F.try_divide(F.length(F.regexp_replace(x, r"[^\p{Lu}]", "")) * 100.0, letters.cast("double")), 4), F.lit(0.0))


def plain_text(x: Column) -> Column:
    """Lower case; whatever is no letter, digit, underscore or blank is a blank; single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}_\x09-\x0D\x20]", " "), r"[\x09-\x0D\x20]+", " "))


def hashed_id(prefix: str, digits: int, *parts: Column) -> Column:
    """``prefix`` and so many digits of the parts' SHA-1."""
    return F.concat(F.lit(prefix), F.substring(F.sha1(F.concat_ws("|", *parts)), 1, digits))


def tags_fingerprint(tags: Column) -> Column:
    return F.sha2(F.array_join(F.sort_array(tags), "|"), 256)
