"""Column functions on text, paths and numbers. All are native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that count as readable besides letters and digits. Fixed values.
PUNCTUATION = " \\t\\n\\r.,;:!?()\\-/'\"@#$%&*+=\\[\\]{}|<>~"


def query_terms(query: Column, least: int = 3) -> Column:
    """Lower-case runs of ASCII letters and digits of at least ``least`` characters, repeats kept."""
    return F.filter(F.regexp_extract_all(F.lower(query), F.lit("([a-z0-9]+)"), 1), lambda t: F.char_length(t) >= least)


def strip(text: Column) -> Column:
    """Without white space at either end, by Unicode."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def norm_path(path: Column) -> Column:
    """Trimmed, with forward slashes, in lower case."""
    return F.lower(F.replace(strip(path), F.lit("\\"), F.lit("/")))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """Lower-case extension with its dot; empty if the name has none."""
    return F.lower(F.regexp_extract(base_name(path), r"[^.](\.[^.]*)$", 1))


def human_size(size: Column) -> Column:
    """Bytes as B, KB, MB or GB with one digit."""
    kb, mb, gb = 1024.0, 1024.0**2, 1024.0**3
    return F.when(size < kb, F.concat(size.cast("string"), F.lit(" B"))).when(size < mb, F.format_string("%.1f KB", size / kb)).when(size < gb, F.format_string("%.1f MB", size / mb)).otherwise(F.format_string("%.1f GB", size / gb))


def human_duration(seconds: Column) -> Column:
    """Seconds as s, m s or h m."""
    whole = seconds.cast("long")
    minutes, hours = (whole / 60).cast("long"), (whole / 3600).cast("long")
    return F.when(whole < 60, F.concat(whole.cast("string"), F.lit("s"))).when(whole < 3600, F.concat(minutes.cast("string"), F.lit("m "), (whole % 60).cast("string"), F.lit("s"))).otherwise(F.concat(hours.cast("string"), F.lit("h "), (minutes % 60).cast("string"), F.lit("m")))


def collapse(text: Column) -> Column:
    """Each line stripped, runs of blanks made one, blank lines dropped."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(F.trim(x), "[ \t]+", " "))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def strip_tags(html: Column) -> Column:
    """Visible text of simple HTML: scripts and styles go, br and p end lines, other tags go, blanks collapse."""
    text = F.regexp_replace(html, r"(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>", "")
    text = F.regexp_replace(F.regexp_replace(text, r"(?i)<br\s*/?>", "\n"), r"(?i)</p>", "\n\n")
    text = F.regexp_replace(F.regexp_replace(text, r"<[^>]+>", ""), r"[ \t]+", " ")
    return F.trim(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def readable_ratio(text: Column, sample: int = 2000) -> Column:
    """Share of letters, digits, blanks and common punctuation in the first ``sample`` characters."""
    head = F.left(text, F.lit(sample))
    return F.char_length(F.regexp_replace(head, r"[^\p{L}\p{N}" + PUNCTUATION + "]", "")) / F.char_length(head)


def is_readable(text: Column, least: int = 20, nulls: float = 0.01, ratio: float = 0.30) -> Column:
    """Whether a text is long enough and no binary garbage; null is not."""
    head = F.left(text, F.lit(2000))
    zero = F.char_length(head) - F.char_length(F.replace(head, F.lit("\0"), F.lit("")))
    return F.coalesce((F.char_length(text) >= least) & (zero / F.char_length(head) <= nulls) & (readable_ratio(text) >= ratio), F.lit(False))


def window_places(text: Column) -> Column:
    """Starts of windows at 0, 25, 50 and 75 % of a text."""
    return F.array(*(F.floor(F.char_length(text) * F.lit(p)).cast("int") for p in (0.0, 0.25, 0.5, 0.75)))


def deep_check(text: Column, window: int = 2000, least: int = 50, ratio: float = 0.30) -> Column:
    """Struct (severity, windows): how many windows at 0, 25, 50 and 75 % of a text are unreadable."""
    parts = F.filter(F.transform(window_places(text), lambda s: F.substring(text, s + 1, F.lit(window))), lambda w: F.char_length(w) >= least)
    bad = F.size(F.filter(parts, lambda w: readable_ratio(w) < ratio))
    short = F.char_length(F.trim(text)) < 20
    return F.struct(F.when(text.isNull() | short, "WARNING").when(bad > 0, "WARNING").otherwise("OK").alias("severity"), F.when(short, 0).otherwise(bad).alias("windows"))


def clamp(text: Column, most: int) -> Column:
    """Struct (text, clamped)."""
    return F.struct(F.left(text, F.lit(most)).alias("text"), (F.char_length(text) > most).alias("clamped"))


def tokens_estimate(text: Column) -> Column:
    return F.ceil(F.char_length(text) / 4).cast("long")


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def squash(x: Column) -> Column:
    return x / (x + F.lit(1.0))


def megabytes_per_second(size: Column, seconds: Column) -> Column:
    """Throughput over at least one second."""
    return size / F.lit(1024.0**2) / F.greatest(seconds, F.lit(1.0))


def mean_of(total: Column, n: Column) -> Column:
    """Total over a count that is taken as one if it is none."""
    return total / F.greatest(n, F.lit(1))
