"""Text functions as native columns: cleaning, slugs, labels, tokens, and the status of a page's text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: statuses that mark a record as not real; `mixed` is none of them (fixed values)
PLACEHOLDER_STATUSES = ("lorem", "template", "wip", "draft")
#: words of Latin filler that hardly occur in real text (fixed values)
FILLER_WORDS = (
    "lorem", "ipsum", "dolor", "amet", "consectetur", "adipiscing", "adipisicing", "elit", "eiusmod", "tempor", "incididunt", "labore", "dolore", "magna", "aliqua",
    "enim", "veniam", "quis", "nostrud", "exercitation", "ullamco", "laboris", "nisi", "aliquip", "commodo", "consequat", "duis", "aute", "irure", "reprehenderit",
    "voluptate", "velit", "esse", "cillum", "fugiat", "nulla", "pariatur", "excepteur", "sint", "occaecat", "cupidatat", "proident", "culpa", "officia", "deserunt",
    "mollit", "laborum",
)
MIN_FILLER_TEXT, FILLER_SHARE = 150, 0.12


def is_placeholder_status(status: Column) -> Column:
    """True for placeholder statuses; null is false, never null."""
    return F.coalesce(status.isin(*PLACEHOLDER_STATUSES), F.lit(False))


def clean(text: Column) -> Column:
    """Runs of white space of any script as one blank, ends trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def slugify(text: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(s, F.lit("")), F.lit("x"))


def humanise(slug: Column) -> Column:
    return F.trim(F.regexp_replace(slug, "[_-]+", " "))


def path_label(text: Column, most: int = 200) -> Column:
    """A segment of a dotted path: other characters as underscores, no leading digit, never empty."""
    s = F.substring(F.regexp_replace(text, "[^A-Za-z0-9_]", "_"), 1, most)
    s = F.when(s.rlike("^[0-9]"), F.concat(F.lit("n"), s)).otherwise(s)
    return F.coalesce(F.nullif(s, F.lit("")), F.lit("n"))


def collapse_repeats(text: Column) -> Column:
    """A text that is one unit several times over becomes that unit."""
    return F.regexp_replace(text, r"(?s)^(.+?)\1+$", "$1")


def dehyphenate(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)(\w)-\n(\w)", "$1$2")


def word_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def token_count(text: Column) -> Column:
    """A word counts its length divided by 3, rounded up; another visible character 1. Null gives null."""
    return F.regexp_count(text, F.lit(r"(?U)[\p{L}\p{N}_]{1,3}|[^\p{L}\p{N}_\s\x1c-\x1f]"))


def filler_share(text: Column, filler: tuple[str, ...] = FILLER_WORDS) -> Column:
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))
    known = F.array(*[F.lit(w) for w in filler])
    return F.coalesce(F.try_divide(F.size(F.filter(words, lambda w: F.array_contains(known, w))).cast("double"), F.size(words)), F.lit(0.0))


def page_status(text: Column, filler: tuple[str, ...] = FILLER_WORDS) -> Column:
    """wip, template or lorem by marks in the text, lorem by a large share of `filler` words in a long one, else real."""
    words = F.size(F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0)))
    return (
        F.when(text.rlike(r"(?<!\w)WIP(?!\w)"), "wip").when(text.rlike(r"(?i)template\s*\n?\s*only"), "template").when(text.rlike(r"(?i)lorem\s+ipsum"), "lorem")
        .when((words >= MIN_FILLER_TEXT) & (filler_share(text, filler) > FILLER_SHARE), "lorem").otherwise("real")
    )


def is_placeholder_value(text: Column) -> Column:
    """A value still to be filled in: X before a per cent sign, km or `no`."""
    return F.coalesce(F.trim(text).rlike(r"(?i)^X\s*(%|km|no)"), F.lit(False))


def truncate_text(text: Column, most: int = 600) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("… [truncated, "), F.length(text).cast("string"), F.lit(" chars total]"))).otherwise(text)


def code_prefixes(code: Column) -> Column:
    """A code and what is left as its last level is cut again and again: a-3.1, a-3, a."""
    parts = F.regexp_extract_all(code, F.lit(r"[.-]?[^.-]+"), F.lit(0))
    return F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda i: F.array_join(F.slice(parts, 1, i), ""))


def title_of_slug(slug: Column) -> Column:
    """A slug in words, its first letter a capital."""
    h = humanise(slug)
    return F.concat(F.upper(F.substring(h, 1, 1)), F.substring(h, F.lit(2), F.length(h)))


def without_nul(text: Column) -> Column:
    return F.replace(text, F.lit("\x00"), F.lit(""))


def date_of_serial(days: Column) -> Column:
    """A spreadsheet's day number as a date: day 1 is the last of 1899."""
    return F.date_add(F.lit("1899-12-30").cast("date"), days.cast("int"))
