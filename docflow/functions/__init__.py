"""Column functions: text clean-up, extraction, dates, hashes. All JVM-side expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: an e-mail address.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
#: Typographic ligatures and the letters they stand for.
LIGATURES = (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "st"), ("ﬆ", "st"))
BULLET = r"^[•●▪*\-–—]\s+"


def normalize_text(c: Column) -> Column:
    """One line-end style, runs of control or zero-width characters as blanks, no ligatures, single
    blanks, trimmed lines, no blank lines at the ends. Null becomes empty."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), "\r\n?", "\n")
    c = F.regexp_replace(c, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\u200b\u200c\u200d\u2060\ufeff]+", " ")
    for one, more in LIGATURES:
        c = F.replace(c, F.lit(one), F.lit(more))
    c = F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r" ?\n ?", "\n")
    return F.regexp_replace(c, r"^[ \n]+|[ \n]+$", "")


def alnum_fold(c: Column) -> Column:
    """Lower-case letters and digits only, for containment tests."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")


def first_match(c: Column, pattern: str) -> Column:
    """The first match, or null."""
    hit = F.regexp_extract(c, f"({pattern})", 1)
    return F.when(hit != "", hit)


def content_id(c: Column) -> Column:
    return F.concat(F.lit("doc_"), F.left(F.sha2(c, 256), F.lit(24)))


def config_hash(*parts: Column) -> Column:
    """SHA-256 of the parts, trimmed and lower-cased, joined by bars; a missing part is written `none`."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.lower(F.trim(p)), F.lit("none")) for p in parts]), 256)


def date_range(c: Column) -> Column:
    """struct<start, end, current> of a range such as `Date: Jan 2022 - Present`; null if either end is bad."""
    from .fields import parse_range

    return parse_range(c)


def alias_matches(c: Column, aliases: dict[str, str]) -> Column:
    """Canonical names of the aliases in the text, longest alias first, each once, in text order."""
    ordered = sorted(aliases, key=lambda a: (-len(a), a))
    # letters and digits of any script are of words; what \b takes for one depends on the engine
    pattern = r"(?i)(?<![\p{L}\p{N}_])(" + "|".join(re.escape(a) for a in ordered) + r")(?![\p{L}\p{N}_])"
    table = F.create_map(*[F.lit(x) for a in sorted(aliases) for x in (a, aliases[a])])
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)), lambda m: F.element_at(table, F.lower(m))))


def terms(c: Column) -> Column:
    """A comma list as trimmed terms without blanks or repeats, order kept."""
    return F.array_distinct(F.filter(F.transform(F.split(c, ","), lambda t: F.trim(t)), lambda t: t != ""))


def has_all(items: Column, wanted: Column) -> Column:
    """Every wanted term is like some item, case aside; % and _ in a term stand for any text and any character."""
    return F.forall(wanted, lambda q: F.exists(items, lambda s: s.ilike(q) if isinstance(q, str) else F.call_function("like", F.lower(s), F.lower(q))))


def any_like(items: Column, part: str) -> Column:
    return F.exists(items, lambda s: s.ilike(f"%{part}%"))


def nearest_rank(values: Column, p: float) -> Column:
    """Percentile at the rounded (half to even) rank of (n-1)p in the sorted values."""
    ordered = F.array_sort(values)
    return F.element_at(ordered, F.bround((F.size(ordered) - 1) * F.lit(p)).cast("int") + 1)


def upper_median(values: Column) -> Column:
    ordered = F.array_sort(values)
    return F.element_at(ordered, F.floor(F.size(ordered) / 2).cast("int") + 1)


def safe_filename(c: Column) -> Column:
    """Letters, digits, - and _ only; `export` where nothing is left."""
    kept = F.regexp_replace(c, r"[^\p{L}\p{N}_-]", "")
    return F.when(F.coalesce(kept, F.lit("")) == "", F.lit("export")).otherwise(kept)


def shortened(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit("..."))).otherwise(c)


def block_label(c: Column) -> Column:
    """Ordered rules, the first that holds: DATE, BULLET, CONTACT, SECTION_HEADER, TITLE, DESCRIPTION, UNKNOWN."""
    n_words = F.size(F.split(F.trim(c), r"[ \t]+"))
    return (
        F.when(F.trim(c) == "", F.lit("UNKNOWN"))
        .when(c.rlike(r"^[^A-Za-z]*(19|20)[0-9]{2}[^A-Za-z]*$"), F.lit("DATE"))
        .when(c.rlike(BULLET), F.lit("BULLET"))
        .when(c.rlike(EMAIL), F.lit("CONTACT"))
        .when((n_words <= 3) & ~c.rlike(r"[.,;:]$"), F.lit("SECTION_HEADER"))
        .when((n_words <= 6) & c.rlike(r"^[A-Z]"), F.lit("TITLE"))
        .when(n_words >= 8, F.lit("DESCRIPTION"))
        .otherwise(F.lit("UNKNOWN"))
    )
