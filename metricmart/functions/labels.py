"""Labels by ordered rules, addresses, times and picks from nested values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: patterns of a label in order, the first that is found decides
ERROR_RULES = [
    ("format_unavailable", "requested format is not available"),
    ("auth_required", "sign in to confirm|use --cookies|cookies|login required|authentication"),
    ("video_unavailable", "private video|video unavailable|this video is unavailable|unavailable"),
    ("network_or_rate_limit", "429|too many requests|timed out|timeout|temporarily unavailable|connection reset|network"),
]
FEATURE_RULES = [
    ("title_style", "title_|hook_|pattern"),
    ("semantic_scores", "semantic_score|ai_semantic|finance_semantic|news_semantic|tutorial_semantic"),
    ("semantic_lsa", "^lsa_"),
    ("semantic_cluster", "cluster"),
    ("topic_metrics", "topic_"),
    ("channel_context", "channel_|relative_growth|median_views"),
    ("engagement_context", "engagement|comment_rate|alpha_score|opportunity_score"),
    ("timing", "age|freshness|execution|upload"),
    ("metadata", "metadata|duration|is_short|format|title_changed|description_changed"),
    ("model_decision", "decision|hybrid|model_score"),
]
THUMBNAILS = ["maxres", "high", "medium", "default"]
HOSTS = ["youtube.com", "m.youtube.com"]


def first_rule(x: Column, rules: list[tuple[str, str]], otherwise: str) -> Column:
    """The label of the first rule whose pattern the lower-cased text holds; NULL counts as empty."""
    text, out = F.lower(F.coalesce(x, F.lit(""))), F.lit(otherwise)
    for label, pattern in reversed(rules):
        out = F.when(text.rlike(pattern), label).otherwise(out)
    return out


def url_path(url: Column, hosts: list[str] | None = None) -> Column:
    """The path of an address on one of the hosts (``www.`` and slashes at the end left out), else NULL."""
    host = F.regexp_replace(F.lower(F.regexp_extract(F.trim(url), r"^[A-Za-z]+://([^/?#]*)", 1)), r"www\.", "")
    path = F.regexp_replace(F.regexp_extract(F.trim(url), r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1), "/+$", "")
    return F.when(host.isin(hosts or HOSTS) & (path != ""), path)


def url_target(path: Column) -> tuple[Column, Column]:
    """Kind and value of a path: ``/@handle``, ``/channel/id`` (all that follows), else NULL."""
    kind = F.when(path.startswith("/@"), "handle").when(path.startswith("/channel/"), "channel_id")
    return kind, F.when(kind == "handle", F.substring(path, 3, 1 << 30)).when(kind == "channel_id", F.substring(path, 10, 1 << 30))


def iso_time(x: Column) -> Column:
    """A point in time from ISO 8601 text; without an offset it is UTC, and what is no time is NULL."""
    return F.when(x.rlike(r"(Z|[+-]\d\d:\d\d)$"), x).otherwise(F.concat(x, F.lit("Z"))).try_cast("timestamp")


def nested_pick(json: Column, names: list[str], field: str = "url") -> Column:
    """The field of the first named object that has a non-empty one, else an empty text."""
    return F.coalesce(*[F.nullif(F.get_json_object(json, f"$.{n}.{field}"), F.lit("")) for n in names], F.lit(""))


def filled_template(template: str, topic: Column, source: Column, suffix: str = " - análisis actualizado") -> Column:
    """The template with its topic; with the suffix where it is the source title but for case and blanks around."""
    out = F.replace(F.lit(template), F.lit("{topic}"), topic)
    return F.when(F.lower(F.trim(out)).eqNullSafe(F.lower(F.trim(source))), F.concat(out, F.lit(suffix))).otherwise(out)


def has_keys(json: Column, required: list[str], array: str) -> Column:
    """True where the object has every key and the named one is an array."""
    keys = F.json_object_keys(json)
    found = [F.array_contains(keys, k) for k in required]
    out = F.json_array_length(F.get_json_object(json, f"$.{array}")).isNotNull()
    for x in found:
        out = out & x
    return F.coalesce(out, F.lit(False))
