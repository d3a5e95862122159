"""String, number and year functions as columns of built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_EMPTY = ["", "-", "–", "—", "nil", "n/a", "na", "none", "*"]


def squash(x: Column) -> Column:
    """Lower case, letters and digits only."""
    return F.regexp_replace(F.lower(x), "[^a-z0-9]+", "")


def spaced(x: Column) -> Column:
    """Lower case, everything else as single spaces."""
    return F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " "))


def normalize_label(x: Column) -> Column:
    """Lower case; dashes unified; & and - kept."""
    s = F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), "[–—]", "-")
    return F.trim(F.regexp_replace(F.regexp_replace(s, r"[^a-z0-9&\- ]+", " "), r"\s+", " "))


def normalize_text(x: Column) -> Column:
    """Lower case; & as a word; _ as a space."""
    s = F.replace(F.replace(F.lower(F.coalesce(x, F.lit(""))), F.lit("&"), F.lit(" and ")), F.lit("_"), F.lit(" "))
    return F.trim(F.regexp_replace(s, "[^a-z0-9]+", " "))


def parse_money(token: Column) -> Column:
    """Value of an accounting cell: brackets or a minus make it negative; never scaled."""
    s = F.trim(token)
    negative = s.rlike(r"\(\s*[\d,]") | s.rlike(r"[-−]\s*\d")
    cleaned = F.regexp_replace(F.regexp_replace(s, r"(?i)\b(?:pkr|rs\.?|usd)\b|[$€£]", ""), "[,%]", "")
    number = F.regexp_extract(cleaned, r"\d+(?:\.\d+)?", 0)
    value = F.when(number != "", number.cast("double"))
    return F.when(F.lower(s).isin(_EMPTY), F.lit(None)).otherwise(F.when(negative, -value).otherwise(value))


def years(x: Column) -> Column:
    """Sorted distinct years 19xx and 20xx that aren't part of longer digit runs."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(x, F.lit(r"(?<!\d)(?:19|20)\d{2}(?!\d)"), F.lit(0)), lambda y: y.cast("int"))))


def is_section_header(label: Column) -> Column:
    """Fewer than three letters, or 70 % of them capitals."""
    letters, caps = F.length(F.regexp_replace(label, "[^A-Za-z]", "")), F.length(F.regexp_replace(label, "[^A-Z]", ""))
    return (letters < 3) | (caps >= 0.7 * letters)


def is_total_row(label: Column) -> Column:
    return F.lower(F.trim(label)).rlike("^(total|gross|net|profit)")


def unit_scale(unit: Column) -> Column:
    """Multiplier to absolute amounts, null for per-share, ratio, percent and unknown units."""
    u = F.lower(F.trim(unit))
    return (
        F.when(u.rlike(r"/share|per share|ratio|percent|%|share|/usd|usd|bps|index") | (u == "x") | u.endswith(" x"), None)
        .when(u.rlike(r"thousand|'000|000s"), 1e3)
        .when(u.rlike(r"million| mn"), 1e6)
        .when(u.rlike(r"billion| bn"), 1e9)
        .when(u.rlike("pkr|rupee") | u.isin("rs", "rs.", "absolute", "currency"), 1.0)
    )


def scale_factor(a: Column, b: Column, tolerance: float = 0.05) -> Column:
    """k of +-3, 6, 9 where a is b times 10^k within the tolerance."""
    r = F.abs(a) / F.when(b != 0, F.abs(b))
    out = F.lit(None).cast("int")
    for k in (-9, -6, -3, 9, 6, 3):
        out = F.when(F.abs(r - 10.0**k) <= tolerance * 10.0**k, k).otherwise(out)
    return F.when((a != 0) & (b != 0), out)


def reconcile(a: Column, b: Column, tolerance: float = 0.05) -> Column:
    """agree, scale_disagreement, divergent or not_comparable, for values in absolute amounts."""
    near = F.abs(a - b) <= tolerance * F.greatest(F.abs(a), F.abs(b), F.lit(1.0))
    return F.when(a.isNull() | b.isNull(), "not_comparable").when(near, "agree").when(scale_factor(a, b, tolerance).isNotNull(), "scale_disagreement").otherwise("divergent")


#: Who may be made to speak in a text that is data; what cancels, which of them and what is cancelled.
AGENTS = ("agent", "assistant", "bot", "developer", "human", "model", "operator", "system", "tool", "user")
CANCELS = ("bypass", "discard", "disregard", "drop", "forget", "ignore", "neglect", "override", "overrule", "skip")
WHICH = ("above", "all", "any", "earlier", "every", "former", "past", "preceding", "previous", "prior", "your")
CANCELLED = ("command", "context", "direction", "directive", "guideline", "instruction", "message", "order", "policy", "prompt", "rule")


def _poses(line: Column) -> Column:
    """Whether a line poses as a turn of a chat, or as the marks that chats are written in."""
    label = F.lower(F.regexp_extract(line, "^[^A-Za-z]*([A-Za-z]+)[^A-Za-z:>]*[:>]", 1))
    return label.isin(*AGENTS) | line.rlike(r"<\|[a-z_]+\|>|\[/?INST\]|<</?SYS>>")


def _cancels(line: Column) -> Column:
    """Whether a line would cancel what was said: a word of each of three kinds, in any order; plurals count."""
    words = F.transform(F.split(F.lower(line), "[^a-z]+"), lambda w: F.regexp_replace(F.regexp_replace(w, "ies$", "y"), "(?<=[a-z]{3})s$", ""))
    return F.arrays_overlap(words, F.array(*map(F.lit, CANCELS))) & F.arrays_overlap(words, F.array(*(F.lit(w.removesuffix("s")) for w in WHICH))) & F.arrays_overlap(words, F.array(*map(F.lit, CANCELLED)))


def sanitize(text: Column, most: int = 1200) -> Column:
    """Untrusted text as data: no lines that pose as a turn or cancel orders, no fences or control characters, capped."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\p{Cntrl}&&[^\t\n\r]]", " ")
    lines = F.filter(F.split(plain, "\r?\n"), lambda line: ~_poses(line) & ~_cancels(line))
    fences = "|".join(f"{mark}{{3,}}" for mark in ("`", "~", '"', "'"))
    flat = F.trim(F.regexp_replace(F.regexp_replace(F.array_join(lines, " "), fences, ""), r"\s+", " "))
    return F.when(F.length(flat) > most, F.concat(F.rtrim(F.substring(flat, 1, most)), F.lit("…"))).otherwise(flat)


def redact(text: Column) -> Column:
    """Stars for what a name that ends in key, token, secret, password or authorization is set to, for keys with a vendor's prefix, and for long hexadecimal runs."""
    named = r"(?i)\b((?:[a-z0-9]+[_-])*(?:api[_-]?key|token|secret|password|passwd|authorization))\b[\"']?\s*[:=]\s*(?:bearer\s+)?(?:\"[^\"]*\"|\S+)"
    for found, kept in ((named, "$1=***"), (r"\b(?:sk|pk|rk|ghp|xox[a-z])[-_][A-Za-z0-9_-]{12,}", "***"), (r"\b[0-9A-Fa-f]{32,}\b", "***")):
        text = F.regexp_replace(text, found, kept)
    return text


#: Words that say that something rises or falls.
POSITIVE = ("increase", "increased", "growth", "grew", "higher", "improved", "expanded", "surged", "recovery", "strong")
NEGATIVE = ("decline", "declined", "decrease", "decreased", "lower", "fell", "reduced", "weak", "slowdown", "pressure", "risk")


def direction(text: Column) -> Column:
    """positive or negative where one vocabulary occurs and not the other."""
    up, down = (F.lower(text).rlike("|".join(words)) for words in (POSITIVE, NEGATIVE))
    return F.when(up & ~down, "positive").when(down & ~up, "negative")


def half_life(age_days: Column, days: float) -> Column:
    """0.5 ^ (age / half-life), 0.5 where the age is unknown; no age is below 0."""
    return F.coalesce(F.pow(F.lit(0.5), F.greatest(age_days, F.lit(0)) / days), F.lit(0.5))


def year_recency(year: Column) -> Column:
    """(year - 2015) / 15 within 0 and 1, 0.5 where unknown."""
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (year - 2015) / 15.0)), F.lit(0.5))
