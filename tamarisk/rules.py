"""Rule data: fixed values that results depend on, and rule sets that a caller passes in."""

from __future__ import annotations

from dataclasses import dataclass

# Query parameters that only track visits.
TRACKING_PREFIX = "utm_"
TRACKING_KEYS = ["fbclid", "gclid", "msclkid", "mc_cid", "mc_eid", "trk", "tracking_id", "ref", "refid"]
# Parameters of a numbered site that change from visit to visit.
VOLATILE_KEYS = ["refid", "trk", "ref", "trackingid", "position", "pagenum"]

# Legal forms taken off a company's name, as whole words.
COMPANY_SUFFIXES = ["inc", r"inc\.", "ltd", r"ltd\.", "llc", "corp", "corporation", "company", r"co\.", "gmbh", "ag", "sa", "pvt"]
# The same for the older identity, taken off as mere substrings, in this order.
LEGACY_NOISE = ["inc", "inc.", "ltd", "ltd.", "llc", "corp", "corporation", "co.", "company", "gmbh", "ag", "sa", "pvt"]

# Sources that carry remote work only, and words of remote work.
REMOTE_ONLY_SOURCES = ["remotive", "remoteok", "wwr", "workingnomads", "findwork", "reed"]
REMOTE_PATTERNS = ["remote", "anywhere", "worldwide", "work from home", "wfh", "distributed", "global", "fully remote", "100% remote", "remote-friendly", "location independent", "عن بعد"]

# Markers in cards of site A (links with gaps) and site B (list items).
A_JOB_TYPES = ["Full Time", "Part Time", "Internship", "Freelance / Project", "Freelance", "Shift Based", "Volunteering", "Full Time", "دوام كامل", "دوام جزئي", "تدريب عملي"]
A_WORKPLACES = ["Remote", "Hybrid", "On-site", "Work From Home", "عمل عن بُعد", "عمل من المنزل", "عمل من مقر الشركة", "هجين"]
A_REMOTE = ["remote", "work from home", "عمل عن بُعد", "عمل من المنزل"]
A_BLOCKED_TAGS = ["apply", "view", "log in", "get started"]
A_PLACES = ["egypt", "مصر", "cairo", "giza", "alexandria", "saudi", "riyadh", "jeddah", "remote"]
A_COUNTRIES = ["Egypt", "مصر", "Saudi Arabia", "السعودية"]
B_JOB_TYPES = ["Full-time", "Part-time", "Contract", "Temporary", "Internship", "Volunteer", "Remote", "Hybrid", "On-site"]
B_REMOTE = ["remote", "work from home", "wfh", "anywhere", "worldwide"]
B_CLOSED = ["no longer accepting applications", "this job is no longer accepting applications", "job is no longer available", "no longer available", "expired", "closed"]

# Fields of a chat message that make it a service message.
SERVICE_FIELDS = ["new_chat_members", "left_chat_member", "new_chat_participant", "left_chat_participant", "new_chat_title", "new_chat_photo", "group_chat_created", "supergroup_chat_created"]

# States of a posting, of a delivery and of a source.
SEND_STATES = ["pending", "sent", "retry", "partial", "skipped"]
QUEUED_STATES = ["pending", "retry", "partial"]
SECRET_KEYS = ["token", "key", "secret"]

PAGE_SIZE_A, PAGE_SIZE_B = 20, 25
QUEUE_LIMIT = 100
FRESH_SECONDS = 3600
MOST_TAGS_A, MOST_TAGS_B, MOST_TYPES = 18, 8, 3


@dataclass(frozen=True)
class TopicRule:
    """One topic: kind is all, source, geo or keywords; values are the source, the places or the keywords (lower case)."""

    topic_key: str
    kind: str
    values: tuple[str, ...] = ()


@dataclass(frozen=True)
class RuleSet:
    """All rules that a pipeline works by; every operator takes its rules from here."""

    topics: tuple[TopicRule, ...]
    include: tuple[str, ...]
    exclude: tuple[str, ...]
    countries: tuple[tuple[str, ...], ...]
    labels: tuple[tuple[str, str], ...]
    default_label: str
    display: tuple[tuple[str, str], ...]
    remote_only: tuple[str, ...] = tuple(REMOTE_ONLY_SOURCES)
    remote: tuple[str, ...] = tuple(REMOTE_PATTERNS)
    site_b: str = "worklink"


# A rule set for the test tables' topics and sources; real ones are read from a caller's configuration.
EXAMPLE = RuleSet(
    topics=(
        TopicRule("all", "all"),
        TopicRule("fresh", "source", ("worklink",)),
        TopicRule("server", "keywords", ("backend", "java ", ".net", "node.js", "php", "golang", "scala")),
        TopicRule("screen", "keywords", ("frontend", "front end", "react", "angular", "vue")),
        TopicRule("handheld", "keywords", ("mobile", "flutter", "swift", "kotlin", "android")),
        TopicRule("cloudops", "keywords", ("devops", "terraform", "linux", "site reliability", "sre")),
        TopicRule("checks", "keywords", ("qa ", "test automation", "quality", "مختبر")),
        TopicRule("numbers", "keywords", ("data ", "machine learning", "analyst", "بيانات")),
        TopicRule("guard", "keywords", ("security", "threat")),
        TopicRule("remote_only", "geo", ("remote", "anywhere", "worldwide", "عن بعد")),
        TopicRule("first_job", "keywords", ("graduate", "intern", "trainee", "junior", "مبتدئ")),
        TopicRule("gulf", "geo", ("saudi arabia", "السعودية", "riyadh")),
    ),
    include=("developer", "engineer", "analyst", "administrator", "architect", "مطور", "مهندس", "محلل"),
    exclude=("business analyst", "network engineer", "technical writer"),
    countries=(("egypt", "مصر", "cairo"), ("saudi arabia", "السعودية", "riyadh", "jeddah")),
    labels=(("security", "guard"), ("data", "numbers"), ("react", "screen"), ("mobile", "handheld"), ("kuhoji", "city"), ("urgent", "bell")),
    default_label="case",
    display=(("nilehire", "NileHire"), ("worklink", "WorkLink")),
)
