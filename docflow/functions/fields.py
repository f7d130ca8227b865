"""Field functions: contacts, dates, headings, degrees, languages, titles, supports. JVM-side expressions.

Patterns and word lists under "fixed values" are parts of the results and stand as they have to be.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values ------------------------------------------------------------------------------
PHONE = r"(\+?\d{1,3}[ \-/.]?)?(?:\(\d{2,4}\)|\d{2,4})[ \-/.]?\d{3,4}[ \-/.]?\d{3,4}"
PHONE_SHAPE = r"^\+?[\d \-().]{7,}$"
LINKEDIN = r"(?i)(?:https?://)?(?:www\.)?linkedin\.com/[A-Za-z0-9_\-/]+"
LINKEDIN_LABEL = r"(?i)^\s*(?:linkedin(?:\s+profile)?|linked\s*in)\s*[:\-]\s*(.+?)\s*$"
LINKEDIN_HANDLE = r"^[A-Za-z0-9](?:[A-Za-z0-9_-]{0,98}[A-Za-z0-9])?$"
NO_HANDLE = ("n/a", "na", "none", "-", "--", "nil", "null", "tbd", "todo")
GITHUB = r"(?i)https?://(?:www\.)?github\.com/[A-Za-z0-9_\-/]+"
URL = r"(?i)https?://[^\s]+"
MONTH_NUMBERS = {
    "jan": "01", "january": "01", "feb": "02", "february": "02", "mar": "03", "march": "03", "apr": "04", "april": "04", "may": "05",
    "jun": "06", "june": "06", "jul": "07", "july": "07", "aug": "08", "august": "08", "sep": "09", "sept": "09", "september": "09",
    "oct": "10", "october": "10", "nov": "11", "november": "11", "dec": "12", "december": "12",
}
RANGE = r"^\s*(.+?)\s*[–—-]\s*(.+?)\s*$"
CURRENT = ("present", "current", "now")
SHAPE = r"(?i)^([a-z]+\s+\d{4}|\d{1,2}[/-]\d{4}|\d{4})\s*[–—-]\s*([a-z]+\s+\d{4}|\d{1,2}[/-]\d{4}|\d{4}|present|current|now)$"
CONTACT_MARKERS = ("contact", "email:", "phone:", "address:", "linkedin:", "github:", "portfolio:")
ARTIFACTS = ("•", "●", "-", "*", "·", ".")
LIST_MARKER = r"^\s*(?:[\x{2022}\x{2023}\x{25E6}\-*\x{00B7}]|\d+\.)\s+"
CONFIDENCE = {"email": 0.99, "phone": 0.95, "name": 0.90, "location": 0.90, "url": 0.90, "skill": 0.90, "section": 0.85, "ambiguous": 0.55}
SMALL_WORDS = ("and", "of", "for", "to", "in", "on", "with")
SCHOOL = r"\b(university|college|institute|school|academy|polytechnic)\b"
GRADE = r"\b(grade|cgpa|gpa|percentage|distinction|honors|honours|marks|cum\s+laude|graduated?)\b"
COMPANY = r"\b(inc|llc|ltd|corp|corporation|company|pvt|private)\b"
TITLE_WORDS = ("engineer", "developer", "manager", "director", "intern", "sde", "software")
PLACES = r"\b(india|usa|united states|uk|england|canada|delhi|noida|kerala|mumbai|pune|bengaluru|bangalore|california|new york|ny)\b"


def _hit(text: Column, pattern: str, group: int = 0) -> Column:
    found = F.regexp_extract(text, pattern, group)
    return F.when(found != "", found)


# ---- contacts ----------------------------------------------------------------------------------
def phone(line: Column) -> Column:
    """The first phone number of the line, if it has seven digits or more."""
    found = F.trim(_hit(F.regexp_replace(line, r"\s", " "), PHONE))
    return F.when(F.length(F.regexp_replace(found, "[^0-9]", "")) >= 7, found)


def linkedin(line: Column) -> Column:
    """A profile address, or one made of a labelled bare handle."""
    handle = F.trim(F.trim(_hit(line, LINKEDIN_LABEL, 1)), F.lit("/"))
    bare = handle.rlike(LINKEDIN_HANDLE) & ~F.lower(handle).isin(*NO_HANDLE)
    return F.coalesce(_hit(line, LINKEDIN), F.when(bare, F.concat(F.lit("https://www.linkedin.com/in/"), handle)))


def github(line: Column) -> Column:
    return _hit(line, GITHUB)


def urls(line: Column) -> Column:
    return F.regexp_extract_all(line, F.lit(URL), F.lit(0))


def contact_block(text: Column) -> Column:
    """A block of a contact side bar: a marker at its start, a profile host or an address in it."""
    low = F.lower(F.trim(text))
    starts = low.rlike("^(" + "|".join(CONTACT_MARKERS) + ")")
    return starts | low.contains("linkedin.com") | low.contains("github.com") | low.rlike(r"@\S+\.\S+")


def artifact(text: Column) -> Column:
    """Nothing but a marker, or one or two characters without a letter or digit."""
    bare = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "[​‌‍]", ""))
    return (bare == "") | bare.isin(*ARTIFACTS) | ((F.length(bare) <= 2) & ~bare.rlike(r"[\p{L}\p{N}]"))


# ---- dates -------------------------------------------------------------------------------------
def date_token(text: Column) -> Column:
    """`Month YYYY`, `M/YYYY`, `M-YYYY` or `YYYY` as YYYY-MM or YYYY; else null."""
    text = F.trim(text)
    months = F.create_map(*[F.lit(x) for pair in MONTH_NUMBERS.items() for x in pair])
    named = F.try_element_at(months, F.lower(F.regexp_extract(text, r"^([A-Za-z]+)\s+(\d{4})$", 1)))
    number = F.regexp_extract(text, r"^(\d{1,2})[/-](\d{4})$", 1).try_cast("int")
    year = F.regexp_extract(text, r"(\d{4})$", 1)
    return F.when(named.isNotNull(), F.concat(year, F.lit("-"), named)).when(number.between(1, 12), F.concat(year, F.lit("-"), F.lpad(number.cast("string"), 2, "0"))).when(text.rlike(r"^\d{4}$"), text)


def parse_range(text: Column) -> Column:
    """struct<start, end, current>: the text is split at its first dash, and either bad end makes it null."""
    text = F.regexp_replace(F.regexp_replace(text, "[​‌‍﻿]", ""), r"^\s+|\s+$", "")
    text = F.regexp_replace(text, r"(?i)^\s*date\s*:?\s*", "")
    start, last = date_token(F.regexp_extract(text, RANGE, 1)), F.trim(F.regexp_extract(text, RANGE, 2))
    current, end = F.lower(last).isin(*CURRENT), date_token(last)
    # one cheap look first: few texts have the shape at all, and only these are parsed
    return F.when(text.rlike(SHAPE) & start.isNotNull() & (current | end.isNotNull()), F.struct(start.alias("start"), F.when(~current, end).alias("end"), current.alias("current")))


def parenthesised_date(text: Column) -> Column:
    return date_token(F.regexp_extract(text, r"^\(\s*([A-Za-z]+\s+\d{4}|\d{4})\s*\)$", 1))


def iso_supported(value: Column, text: Column) -> Column:
    """An ISO date whose year, and month as number or name, stand in the text."""
    year, month, day = (F.regexp_extract(value, r"^(\d{4})(?:-(\d{2}))?(?:-(\d{2}))?$", i) for i in (1, 2, 3))
    names = F.create_map(*[F.lit(x) for name, n in MONTH_NUMBERS.items() if len(name) == 3 for x in (n, name)])
    named = F.coalesce(F.contains(F.lower(text), F.try_element_at(names, month)), F.lit(False))
    days = F.contains(text, day) | F.contains(text, F.regexp_replace(day, "^0", ""))
    return (year != "") & F.contains(text, year) & ((month == "") | ((F.contains(text, month) | named) & ((day == "") | days)))


def phone_supported(value: Column, text: Column) -> Column:
    """The digits of a phone number occur in the text's, or end with all of them (1 to 3 more in front)."""
    own, there = (F.regexp_replace(c, "[^0-9]", "") for c in (value, text))
    more = F.length(own) - F.length(there)
    return (own != "") & (F.contains(there, own) | ((F.length(there) >= 7) & more.between(1, 3) & own.endswith(there)))


# ---- texts -------------------------------------------------------------------------------------
def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def ordered_subsequence(value: Column, text: Column) -> Column:
    """The value's words, two at least, stand in the text in this order, others between them."""
    wanted, there = words(value), words(text)
    # the place in the text up to which the words so far are found; its length plus one if not
    place = F.aggregate(wanted, F.lit(0), lambda at, w: F.when(at < 0, at).otherwise(F.coalesce(F.nullif(F.array_position(F.slice(there, at + 1, F.size(there) + 1), w), F.lit(0)).cast("int") + at, F.lit(-1))))
    return (F.size(wanted) >= 2) & (place > 0)


def same_words(value: Column, text: Column) -> Column:
    """Both have the same words equally often."""
    a, b = F.array_sort(words(value)), F.array_sort(words(text))
    return (F.size(a) > 0) & (a == b)


def list_marked(text: Column) -> Column:
    return text.rlike(LIST_MARKER)


def without_marker(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, LIST_MARKER, ""))


def label_value(text: Column) -> Column:
    """struct<label, value> of `label: value`, if the label has five words at most."""
    label, value = (F.trim(F.regexp_extract(F.trim(text), r"^([^:]+):\s*(\S.*)$", i)) for i in (1, 2))
    return F.when((label != "") & (F.size(F.split(label, r"\s+")) <= 5), F.struct(label.alias("label"), value.alias("value")))


def form_cell(text: Column) -> Column:
    """Lines without separator colons: lone ones go, leading ones are stripped, blank lines go."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(F.regexp_replace(F.trim(x), "^:+", "")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def without_fence(text: Column) -> Column:
    """The inside of a text that is one fenced block, else the text, trimmed."""
    bare = F.regexp_replace(text, r"^\s+|\s+$", "")
    inside = F.regexp_extract(bare, r"(?is)^```(?:json)?\s*(.*?)\s*```$", 1)
    return F.when(bare.rlike(r"(?is)^```(?:json)?\s*.*?\s*```$"), inside).otherwise(bare)


def masked(text: Column, secret: Column) -> Column:
    return F.when(F.coalesce(secret, F.lit("")) == "", text).otherwise(F.replace(text, secret, F.lit("[REDACTED]")))


def language_name(text: Column) -> Column:
    """A language without its trailing rating; null for blanks and bare ratings."""
    value = F.trim(text)
    rating = r"[\d\s./%-]+"
    name = F.regexp_replace(F.regexp_extract(value, rf"^(.+?)[\s:–—-]*\(?{rating}\)?$", 1), r"[ \t\-–—:]+$", "")
    return F.when((value == "") | value.rlike(rf"^{rating}$"), None).when(name != "", name).otherwise(value)


def job_title(text: Column) -> Column:
    """Words capitalised, small words low, acronyms of two or three capitals and roman numerals kept."""

    def one(w: Column) -> Column:
        core = F.regexp_replace(w, r"^[^A-Za-z0-9]+|[^A-Za-z0-9]+$", "")
        keep = w.rlike(r"^\d+$") | core.rlike("^([A-Z]{2,3}|[IVX]+)$")
        return F.when(keep, w).when(F.lower(w).isin(*SMALL_WORDS), F.lower(w)).otherwise(F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substring(w, 2, 1 << 20))))

    bare = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.array_join(F.transform(F.split(bare, " "), one), " ")


def degree_parts(text: Column) -> Column:
    """struct<degree, institution, field> of `degree | institution`, `degree in field` and `degree (field)`."""
    bar = F.contains(text, F.lit("|"))
    degree = F.trim(F.when(bar, F.substring_index(text, "|", 1)).otherwise(text))
    school = F.when(bar, F.regexp_replace(F.regexp_replace(F.trim(F.regexp_extract(text, r"^[^|]*\|(.*)$", 1)), r"\s*,\s*", ", "), r"\s+", " "))
    paren = F.regexp_extract(degree, r"^(.+?)\s*\(([^)]+)\)\s*$", 2)
    special = (F.length(paren) >= 2) & paren.rlike("[A-Za-z]") & ~paren.rlike(r"(?i)^(hons\.?|honou?rs\.?|general)$") & ~paren.rlike(rf"(?i){SCHOOL}") & ~paren.rlike(r"\b(?:19|20)\d{2}\b.*[-–—/]")
    first = F.when(special, F.trim(F.regexp_extract(degree, r"^(.+?)\s*\(([^)]+)\)\s*$", 1))).otherwise(degree)
    inside = _hit(first, r"(?i)^(.+?)\s+in\s+(.+)$", 2)
    split = ~special & inside.isNotNull()
    return F.struct(F.when(split, F.regexp_extract(first, r"(?i)^(.+?)\s+in\s+(.+)$", 1)).otherwise(first).alias("degree"), school.alias("institution"), F.when(special, F.trim(paren)).otherwise(inside).alias("field"))


def place_parts(text: Column) -> Column:
    """struct<institution, location> of `institution - City, Country`; location null otherwise."""
    pattern = r"^(.+?)\s*[–—-]\s*([A-Za-z][A-Za-z .'-]*(?:,\s*[A-Za-z][A-Za-z .'-]*)+)$"
    bare = F.trim(text)
    fits = bare.rlike(pattern)
    return F.struct(F.when(fits, F.trim(F.regexp_extract(bare, pattern, 1))).otherwise(text).alias("institution"), F.when(fits, F.regexp_replace(F.regexp_extract(bare, pattern, 2), r"\s*,\s*", ", ")).alias("location"))


# ---- headings and labels -----------------------------------------------------------------------
def section_of(text: Column, aliases: dict[str, list[str]]) -> Column:
    """The section a heading names: `objective` anywhere is SUMMARY; else an alias, letters and
    digits only, equal to it or one or two characters longer; in the aliases' order."""
    bare = F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]+", "")
    rule = F.when(F.coalesce(F.trim(text), F.lit("")) == "", None).when(text.rlike(r"(?i)\bobjective\b"), F.lit("SUMMARY"))
    folded = [(name, "".join(c for c in alias.lower() if c.isascii() and c.isalnum())) for name, own in aliases.items() for alias in own]
    for name, alias in folded:
        rule = rule.when(bare == alias, F.lit(name))
    for name, alias in folded:
        rule = rule.when((F.lit(len(alias)) - F.length(bare)).isin(1, 2) & F.lit(alias).startswith(bare), F.lit(name))
    return rule


def unknown_heading(text: Column, skills: list[str], font_size: Column, bold: Column) -> Column:
    """Five words at most, no digit, no closing punctuation, no skill, and bold, all capitals or 12 points."""
    value = F.trim(F.coalesce(text, F.lit("")))
    plain = (value != "") & (F.size(F.split(value, r"\s+")) <= 5) & ~value.rlike(r"\d") & ~value.rlike("[.:;,]$") & ~F.lower(value).isin(*[s.lower() for s in skills])
    capitals = (F.upper(value) == value) & value.rlike(r"\p{L}")
    return plain & (F.coalesce(bold, F.lit(False)) | capitals | F.coalesce(font_size >= 12, F.lit(False)))


def labelled(text: Column, *, degrees: list[str], sections: list[str], titles: list[str], emphasis: Column | None = None) -> Column:
    """struct<label, score, reason>: the first rule that holds, from date to unknown."""
    value = F.trim(F.coalesce(text, F.lit("")))
    low = F.lower(value)
    emphasis = F.lit(False) if emphasis is None else emphasis
    capitals = F.size(F.filter(F.split(value, r"\s+"), lambda w: w.rlike(r"^\p{Lu}")))
    inner = F.regexp_extract(value, r"^\(\s*(.+?)\s*\)$", 1)
    any_degree = "|".join(d.replace(".", r"\.") for d in degrees)
    company = low.rlike(COMPANY)
    # cheap looks before dear ones: a range ends in a year or a word for now, schools hold one of six words
    dated = value.rlike(r"(?i)(\d{4}|present|current|now)[^a-z0-9]*$")
    school = low.contains("university") | low.contains("college") | low.contains("institute") | low.contains("school") | low.contains("academy") | low.contains("polytechnic")
    rules: list[tuple[Column, str, float, str]] = [
        (value == "", "UNKNOWN", 0.0, "empty"),
        (dated & parse_range(value).isNotNull(), "DATE", 1.0, "date_pattern"),
        (value.startswith("(") & dated & parse_range(inner).isNotNull(), "DATE", 1.0, "parenthesized_date_pattern"),
        (list_marked(value), "BULLET", 1.0, "bullet_marker"),
        (low.rlike(rf"^({any_degree})($|\s+(in|of)\b|[:(/.\-])"), "DEGREE", 1.0, "degree_dict"),
        (value.contains("/") & (F.length(value) <= 60) & low.rlike(r"\bdegree\b"), "DEGREE", 0.8, "degree_placeholder_pattern"),
        (low.isin(*sections), "SECTION_HEADER", 1.0, "section_header"),
        (low.isin(*titles), "JOB_TITLE", 1.0, "job_title_dict_exact"),
        (emphasis & low.rlike("|".join(TITLE_WORDS)), "JOB_TITLE", 0.7, "title_keyword+typography"),
        (company & (capitals >= 2), "COMPANY", 0.9, "company_suffix+capitalization"),
        (company & value.rlike("[!&]"), "COMPANY", 0.7, "weak_capitalization"),
        (value.contains("!") & (capitals >= 2), "COMPANY", 0.7, "branding_exclamation+capitalization"),
        (school & low.rlike(SCHOOL), "INSTITUTION", 0.9, "institution_keyword"),
        (low.contains("location:") | low.contains("based in"), "LOCATION", 1.0, "location_label"),
        (value.contains(",") & low.rlike(PLACES), "LOCATION", 0.9, "geo_token+comma"),
        (F.length(value) > 80, "DESCRIPTION", 0.6, "long_text"),
        (F.lit(True), "UNKNOWN", 0.0, "no_strong_signal"),
    ]
    out = None
    for test, label, score, reason in rules:
        one = F.struct(F.lit(label).alias("label"), F.lit(score).alias("score"), F.lit(reason).alias("reason"))
        out = F.when(test, one) if out is None else out.when(test, one)
    return out


def signals(text: Column, patterns: list[str]) -> Column:
    """How many of the patterns the text has."""
    return sum((text.rlike(p).cast("int") for p in patterns[1:]), text.rlike(patterns[0]).cast("int"))


def supported(value: Column, text: Column, fold: Callable[[Column], Column]) -> Column:
    """A value is grounded in a text: as folded part of it, as date, as phone number, or word by word in order."""
    return F.contains(fold(text), fold(value)) | iso_supported(value, text) | (value.rlike(PHONE_SHAPE) & phone_supported(value, text)) | ordered_subsequence(value, text)
