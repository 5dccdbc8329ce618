"""Filters and predicates over postings; every rule set is an argument."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarisk.functions.text import contains_any, flatten_tags, relative_age, text
from tamarisk.rules import A_PLACES, A_REMOTE, B_CLOSED, B_REMOTE, SEND_STATES, SERVICE_FIELDS, RuleSet


def has_required() -> Column:
    """title and url are there; white space alone passes."""
    return (text("title") != "") & (text("url") != "")


def _spaced(*parts: Column) -> Column:
    return F.lower(F.concat_ws(" ", *parts))


def keyword_match(rules: RuleSet) -> Column:
    """title and tags hold an included keyword and no excluded one."""
    lowered = _spaced(text("title"), flatten_tags("tags"))
    return contains_any(lowered, rules.include) & ~contains_any(lowered, rules.exclude)


def in_countries(rules: RuleSet) -> Column:
    """The location names a place of an allowed country."""
    lowered = F.lower(text("location"))
    return reduce(lambda a, b: a | b, (contains_any(lowered, places) for places in rules.countries), F.lit(False))


def is_remote(rules: RuleSet) -> Column:
    """F8: flagged, or remote words in title, location, type or tags."""
    lowered = _spaced(text("title"), text("location"), text("job_type"), flatten_tags("tags"))
    return F.coalesce("is_remote", F.lit(False)) | contains_any(lowered, rules.remote)


def passes_geo(rules: RuleSet) -> Column:
    """a remote-only source (exact case), an allowed country, or remote work."""
    return F.coalesce(F.col("source").isin(list(rules.remote_only)), F.lit(False)) | in_countries(rules) | is_remote(rules)


def library_filter(postings: DataFrame, rules: RuleSet) -> DataFrame:
    """F10."""
    return postings.where(has_required() & keyword_match(rules) & passes_geo(rules))


def runtime_keep(rules: RuleSet) -> Column:
    """site B's postings skip the keyword rule."""
    is_b = F.lower(F.trim(text("source"))) == rules.site_b
    return has_required() & (is_b | keyword_match(rules)) & passes_geo(rules)


def runtime_filter(postings: DataFrame, rules: RuleSet) -> DataFrame:
    return postings.where(runtime_keep(rules))


def is_closed(cleaned: Column) -> Column:
    """F12."""
    return contains_any(F.lower(cleaned), B_CLOSED)


def is_stale(cleaned: Column, most_seconds: int | None) -> Column:
    """a visible age above the limit; without age or limit fresh."""
    return F.lit(False) if most_seconds is None else F.coalesce(relative_age(cleaned) > most_seconds, F.lit(False))


def looks_like_location(cleaned: Column, places=tuple(A_PLACES)) -> Column:
    """F15."""
    return contains_any(F.lower(cleaned), places)


def is_noise_tag(cleaned: Column) -> Column:
    """F16."""
    low = F.lower(cleaned)
    return (F.length(cleaned) > 70) | low.contains("jobs and careers at") | low.endswith("ago") | low.rlike(r"\b\d+\s*-\s*\d+\s+yrs?\b")


def remote_text_a(cleaned: Column) -> Column:
    """F17."""
    return contains_any(F.lower(cleaned), A_REMOTE)


def remote_signal_b(*parts: Column) -> Column:
    """over the raw card, attributes and addresses too."""
    return contains_any(_spaced(*parts), B_REMOTE)


def _truthy(c: Column) -> Column:
    return c.isNotNull() & ~F.trim(c).isin("", "null", "false", "0", "0.0", "[]", "{}", '""')


def service_messages(updates: DataFrame, group_id: str, column: str = "update") -> DataFrame:
    """Updates (JSON text) that are service messages of the group, as (update_id, chat_id, message_id)."""
    get = lambda path: F.get_json_object(column, path)
    service = reduce(lambda a, b: a | b, (_truthy(get(f"$.message.{f}")) for f in SERVICE_FIELDS))
    rows = updates.where((get("$.message.chat.id") == str(group_id)) & service & _truthy(get("$.message.message_id")))
    return rows.select(get("$.update_id").cast("long").alias("update_id"), get("$.message.chat.id").alias("chat_id"), get("$.message.message_id").cast("long").alias("message_id"))


def next_offset(updates: DataFrame, order: str, column: str = "update") -> DataFrame:
    """The id after that of the last update seen (in arrival order), null without updates."""
    return updates.agg((F.max_by(F.get_json_object(column, "$.update_id").cast("long"), order) + 1).alias("next_offset"))


def checked_status(status: Column) -> Column:
    """the state, or an error where it is no legal one."""
    return F.when(status.isin(SEND_STATES), status).otherwise(F.raise_error(F.concat(F.lit("unknown status: "), F.coalesce(status, F.lit("null")))))
