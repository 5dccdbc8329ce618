"""Routing postings to topics, lookups by rule order, rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarisk.functions.text import contains_any, escape, flatten_tags, text, title_case
from tamarisk.rules import RuleSet, TopicRule


def _rule(rule: TopicRule, words: Column, place: Column, source: Column) -> Column:
    if rule.kind == "all":
        return F.lit(True)
    if rule.kind == "source":
        return source.isin(list(rule.values))
    return contains_any(place if rule.kind == "geo" else words, rule.values)


def with_topics(postings: DataFrame, rules: RuleSet) -> DataFrame:
    """The topics of each posting, in the order of the rules. The texts are lowered once, in a projection before."""
    rows = postings.withColumns({
        "_words": F.lower(F.concat_ws(" ", text("title"), text("company"), flatten_tags("tags"))),
        "_place": F.lower(text("location")),
        "_source": F.lower(F.trim(text("source"))),
    })
    topics = F.array_compact(F.array(*(F.when(_rule(r, F.col("_words"), F.col("_place"), F.col("_source")), F.lit(r.topic_key)) for r in rules.topics)))
    return rows.withColumn("topics", topics).drop("_words", "_place", "_source")


def topic_counts(postings: DataFrame, rules: RuleSet) -> DataFrame:
    """(topic_key, n): postings per topic."""
    return with_topics(postings.select("title", "company", "location", "source", "tags"), rules).select(F.explode("topics").alias("topic_key")).groupBy("topic_key").agg(F.count(F.lit(1)).alias("n"))


def first_label(rules: RuleSet) -> Column:
    """The label of the first rule whose word title, location or tags hold."""
    lowered = F.lower(F.concat_ws(" ", text("title"), text("location"), flatten_tags("tags")))
    pairs = F.array(*(F.struct(F.lit(word).alias("word"), F.lit(label).alias("label")) for word, label in rules.labels))
    return F.coalesce(F.get(F.filter(pairs, lambda p: F.contains(lowered, p["word"])), F.lit(0))["label"], F.lit(rules.default_label))


def display_source(rules: RuleSet) -> Column:
    """The original source, else the display name, else the key in title case."""
    names = F.create_map(*(F.lit(x) for pair in rules.display for x in pair))
    return F.coalesce(F.nullif("original_source", F.lit("")), F.try_element_at(names, text("source")), title_case("source"))


def topic_names(rows: DataFrame, topics: DataFrame) -> DataFrame:
    """The topic's name beside its key (the first in order, if there are several), the key where the topic has none."""
    names = topics.groupBy("topic_key").agg(F.min("topic_name").alias("topic_name"))
    return rows.join(names, "topic_key", "left").withColumn("topic_name", F.coalesce("topic_name", "topic_key"))


def rendered(rules: RuleSet) -> Column:
    """The card of a posting. Lines that are null are left out, the empty one stays."""
    line = lambda mark, c: F.when(text(c) != "", F.concat(F.lit(mark), escape(c)))
    return F.concat_ws(
        "\n",
        F.concat(first_label(rules), F.lit(" <b>"), escape("title"), F.lit("</b>")),
        F.concat(F.lit("🏢 "), F.when(text("company") != "", escape("company")).otherwise("Unknown")),
        F.concat(F.lit("📍 "), F.when(text("location") != "", escape("location")).otherwise("Not specified")),
        line("💰 ", "salary"),
        line("📋 ", "job_type"),
        F.when(F.coalesce("is_remote", F.lit(False)), F.lit("🌍 Remote")),
        F.lit(""),
        F.concat(F.lit('🔗 <a href="'), escape("url"), F.lit('">Apply Now</a>')),
        F.concat(F.lit("📡 Source: "), escape(display_source(rules))),
    )
