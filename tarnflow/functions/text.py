"""Text expressions: cleaning, titles, keywords, amounts, ids, snippets. Patterns are literals of the caller's own choice."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: amounts' units and how many hundred millions each is.
MONEY_UNITS = {"trillion": 1e4, "billion": 10.0, "million": 0.01, "亿元": 1.0, "亿": 1.0, "万元": 1e-4, "万": 1e-4}
_NUMBER = r"(-?\d+(?:\.\d+)?)"


def blank_to_null(c: Column) -> Column:
    """Trimmed text; what is empty is null."""
    return F.nullif(F.trim(c.cast("string")), F.lit(""))


def compact_text(c: Column, most: int) -> Column:
    """Runs of white space as one space, trimmed, cut to ``most`` characters."""
    return F.substring(F.trim(F.regexp_replace(c, r"\s+", " ")), 1, most)


def norm_whitespace(c: Column) -> Column:
    """Blanks within a line as one, three line ends or more as two."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"[ \t　]+", " "), r"\n{3,}", "\n\n"))


def clean_title(c: Column, *prefixes: Column) -> Column:
    """A title without leading names (of a company, a symbol) and the marks behind them."""
    out = F.trim(c)
    for p in prefixes:
        out = F.when(F.startswith(out, p), F.regexp_replace(F.substring(out, F.length(p) + 1, F.length(out)), r"^[\s:：,，-]+", "")).otherwise(out)
    return out


def title_key(c: Column, *prefixes: Column, most: int = 80) -> Column:
    """What titles of one thing share: no leading names, dates or white space, at most ``most`` characters, lower case."""
    bare = F.regexp_replace(clean_title(c, *prefixes), r"\d{4}[-/.年]\d{1,2}[-/.月]\d{1,2}日?|\d{8}", "")
    return F.substring(F.lower(F.regexp_replace(bare, r"\s+", "")), 1, most)


def normalize_title(c: Column, stop_words: Sequence[str] = ()) -> Column:
    """Lower case without white space, punctuation and stop words."""
    out = F.lower(c)
    if stop_words:
        out = F.regexp_replace(out, r"\b(?:" + "|".join(map(re.escape, stop_words)) + r")\b", "")
    return F.regexp_replace(out, r"[\s\p{Punct}]+", "")


def title_terms(c: Column, least: int = 4) -> Column:
    """Different parts of a title between marks, of ``least`` characters or more, in order."""
    parts = F.transform(F.split(F.lower(c), r"[\s\p{Punct}]+"), lambda x: F.trim(x))
    return F.array_distinct(F.filter(parts, lambda x: F.length(x) >= least))


def sha_id(*parts: Column, digits: int = 16) -> Column:
    """A stable id: the first hex digits of SHA-256 over the parts, joined by ``|`` (null: empty)."""
    return F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, digits)


def md5_point_id(c: Column) -> Column:
    """A stable unsigned 64-bit number: the first 16 hex digits of MD5."""
    return F.conv(F.substring(F.md5(c), 1, 16), 16, 10).cast("decimal(20,0)")


def code_suffix(c: Column, suffixes: dict[str, str], width: int = 6, other: str = "") -> Column:
    """A code padded with zeros, with a suffix that its first digit decides."""
    padded = F.lpad(c.cast("string"), width, "0")
    out = F.lit(other)
    for first, suffix in suffixes.items():
        out = F.when(F.startswith(padded, F.lit(first)), F.lit(suffix)).otherwise(out)
    return F.concat(padded, out)


def first_match(pattern: str, *columns: Column) -> Column:
    """What a pattern first matches in several columns (null if nothing)."""
    return F.coalesce(*[F.nullif(F.regexp_extract(c, pattern, 0), F.lit("")) for c in columns])


def keyword_flag(c: Column, words: Sequence[str], any_case: bool = False) -> Column:
    """Whether a text holds one of the words."""
    return F.coalesce(c.rlike(("(?i)" if any_case else "") + "|".join(map(re.escape, words))), F.lit(False))


def keyword_count(c: Column, words: Sequence[str]) -> Column:
    """How often the words occur, each without overlaps of its own."""
    each = [((F.length(c) - F.length(F.replace(c, F.lit(w), F.lit("")))) / len(w)).cast("long") for w in words]
    return F.coalesce(sum(each[1:], each[0]), F.lit(0).cast("long"))


def keyword_score(c: Column, terms: Column) -> Column:
    """Sum over an array of terms of how often each occurs, times its length."""
    count = lambda t: ((F.length(c) - F.length(F.replace(c, t, F.lit("")))) / F.length(t)).cast("long")
    return F.aggregate(F.filter(terms, lambda t: F.length(t) > 0), F.lit(0).cast("long"), lambda s, t: s + count(t) * F.length(t))


def money_values(c: Column) -> Column:
    """All amounts ``number unit`` of a text in hundred millions."""
    pattern = _NUMBER + r"\s*(" + "|".join(sorted(MONEY_UNITS, key=len, reverse=True)) + ")"
    units = F.create_map(*[F.lit(x) for pair in MONEY_UNITS.items() for x in pair])
    numbers, names = F.regexp_extract_all(c, F.lit(pattern), 1), F.regexp_extract_all(c, F.lit(pattern), 2)
    return F.zip_with(numbers, names, lambda n, u: n.cast("double") * F.element_at(units, u))


def percent_values(c: Column) -> Column:
    """All ``x%`` of a text as fractions."""
    return F.transform(F.regexp_extract_all(c, F.lit(_NUMBER + r"\s*[%％]"), 1), lambda x: x.cast("double") / 100)


def profit_range(c: Column) -> Column:
    """``low, high`` of the first range ``a unit - b unit`` in hundred millions; a unit that is missing is the other one's."""
    unit = "(" + "|".join(sorted(MONEY_UNITS, key=len, reverse=True)) + ")?"
    pattern = _NUMBER + r"\s*" + unit + r"\s*(?:[-~至到–—]|to)\s*" + _NUMBER + r"\s*" + unit
    got = [F.nullif(F.regexp_extract(c, pattern, k), F.lit("")) for k in range(1, 5)]
    units = F.create_map(*[F.lit(x) for pair in MONEY_UNITS.items() for x in pair])
    sizes = [F.try_element_at(units, F.coalesce(u, v)) for u, v in ((got[1], got[3]), (got[3], got[1]))]
    a, b = got[0].cast("double") * sizes[0], got[2].cast("double") * sizes[1]
    return F.when(a.isNotNull() & b.isNotNull(), F.struct(F.least(a, b).alias("low"), F.greatest(a, b).alias("high")))


def direction(c: Column, strong_up: Sequence[str], strong_down: Sequence[str], up: Sequence[str] = (), down: Sequence[str] = ()) -> Column:
    """1, -1 or 0: strong words decide before weak ones, up before down."""
    out = F.lit(0)
    for words, sign in ((down, -1), (up, 1), (strong_down, -1), (strong_up, 1)):
        if words:
            out = F.when(keyword_flag(c, words, any_case=True), F.lit(sign)).otherwise(out)
    return out


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b; null for a zero, null or non-finite side."""
    out = F.try_divide(a.cast("double"), b.cast("double"))
    return F.when(~F.isnan(out) & (F.abs(out) < float("inf")), out)


def bool_text(c: Column) -> Column:
    """Text flags as booleans; anything else is false."""
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin("1", "1.0", "true", "yes", "y"), F.lit(False))


def to_number(c: Column) -> Column:
    """A number or null."""
    return c.cast("string").try_cast("double")


def snippet_center(c: Column, term: Column, before: int = 80, width: int = 200) -> Column:
    """``width`` characters from ``before`` ones ahead of the first match (any case), dots on sides that are cut; else the head."""
    at = F.instr(F.lower(c), F.lower(term))
    start = F.when(at > 0, F.greatest(at - before, F.lit(1))).otherwise(1)
    body = F.substring(c, start, F.lit(width))
    return F.concat(F.when(start > 1, F.lit("...")).otherwise(""), body, F.when(start - 1 + width < F.length(c), F.lit("...")).otherwise(""))


def without_placeholders(c: Column, pattern: str = r"[□☐☑✓√]|\[\s?[xX]?\s?\]") -> Column:
    """A text without the check boxes of a form."""
    return F.regexp_replace(c, pattern, "")


def snippet_clean(c: Column, most: int = 200) -> Column:
    return compact_text(without_placeholders(c), most)


def placeholder_only(c: Column, least: int = 20) -> Column:
    """Whether fewer than ``least`` characters are left without blanks and check boxes."""
    return F.length(F.regexp_replace(without_placeholders(c), r"\s+", "")) < least


def meta_keywords(html: Column) -> Column:
    """The keywords that a page's head names, trimmed, in their order; none of a null page or one that names none."""
    head = F.regexp_extract(html, r"(?is)<meta\b[^>]*\bname\s*=\s*[\"']?keywords\b[^>]*>", 0)
    content = F.regexp_extract(head, r"(?is)\bcontent\s*=\s*(?:\"([^\"]*)\"|'([^']*)')", 0)
    named = F.regexp_replace(content, r"(?is)^content\s*=\s*[\"']|[\"']$", "")
    return F.filter(F.transform(F.split(F.coalesce(named, F.lit("")), "[,，;；]"), lambda k: F.trim(k)), lambda k: k != "")


def tags(words: Column, c: Column, dictionary: Sequence[str]) -> Column:
    """The different words of an array and those of a dictionary that a text holds, sorted."""
    held = F.array_compact(F.array(*[F.when(F.contains(c, F.lit(w)), w) for w in dictionary]))
    return F.array_sort(F.array_distinct(F.concat(F.coalesce(words, F.array().cast("array<string>")), held)))


def passage(fields: dict[str, Column], text: Column, most: int = 2000) -> Column:
    """Lines ``name: value`` of what is known, then the text, cut to ``most``."""
    return F.concat_ws("\n", *[F.when(blank_to_null(v).isNotNull(), F.concat(F.lit(f"{k}: "), v)) for k, v in fields.items()], F.substring(text, 1, most))


def excerpt(c: Column, mark: str = " | ", most: int = 240) -> Column:
    """The first part before a mark, cut."""
    return F.substring(F.element_at(F.split(c, re.escape(mark)), 1), 1, most)


def text_signals(c: Column, dictionaries: dict[str, Sequence[str]]) -> dict[str, Column]:
    """Length, digits, percent signs, and for each dictionary how often its words occur and whether they do."""
    out = {"n_chars": F.length(c), "n_digits": F.regexp_count(c, F.lit(r"\d")), "n_percent": F.regexp_count(c, F.lit("[%％]"))}
    for name, words in dictionaries.items():
        out |= {f"{name}_count": keyword_count(c, words), f"{name}_has": keyword_flag(c, words).cast("int")}
    return out
