"""Text expressions: trimming, noise lines, headings, section types, tokens."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom import rules


#: All characters up to U+0020.
_LOW = "".join(map(chr, range(0x21)))

def trim_all(text: Column) -> Column:
    """Without characters up to U+0020 at both ends."""
    return F.btrim(text, F.lit(_LOW))


def collapse(text: Column) -> Column:
    return trim_all(F.regexp_replace(text, r"\s+", " "))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once; Spark evaluates what stands in several branches of a CASE in each of them."""
    return F.element_at(F.transform(F.array(value), body), 1)


def has_any(text: Column, parts) -> Column:
    found = F.lit(False)
    for p in parts:
        found = found | text.contains(p)
    return found


def _meets(low: Column, name: str, pattern: str) -> Column:
    needs = rules.NOISE_NEEDS.get(name)
    return has_any(low, needs) & low.rlike(pattern) if needs else low.rlike(pattern)


def noise_rule(line: Column) -> Column:
    """Name of the first noise rule that a line meets, or null."""
    low = F.lower(trim_all(line))
    out = None
    for name, pattern in rules.NOISE_RULES:
        test = _meets(low, name, pattern)
        out = F.when(test, name) if out is None else out.when(test, name)
    return out


def is_noise(low: Column) -> Column:
    """Whether a trimmed lower-case line meets a noise rule."""
    out = F.lit(False)
    for name, pattern in rules.NOISE_RULES:
        out = out | _meets(low, name, pattern)
    return out


def clean_text(text: Column) -> Column:
    """Line ends unified, hyphen breaks joined, page numbers and noise lines dropped, blanks collapsed.

    Inside a higher-order function Spark evaluates an expression wherever it stands, so a line carries its lower-case form.
    """
    t = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    t = F.when(t.contains("-\n"), F.regexp_replace(t, r"([A-Za-z])-\n([A-Za-z])", "$1$2")).otherwise(t)
    lines = F.transform(F.transform(F.split(t, "\n"), trim_all), lambda x: F.struct(x.alias("line"), F.lower(x).alias("low")))
    lines = F.filter(lines, lambda x: (x["line"] == "") | ~((F.length(x["line"]) <= 4) & x["line"].rlike(r"^\d{1,4}$")) & ~is_noise(x["low"]))
    lines = F.transform(lines, lambda x: F.when(x["line"].contains("  ") | x["line"].contains("\t"), F.regexp_replace(x["line"], r"[ \t]+", " ")).otherwise(x["line"]))
    return trim_all(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"))


def _bare(title: Column) -> Column:
    return trim_all(F.regexp_replace(F.lower(title), rules.NUMBERING, ""))


def section_type_from_title(title: Column) -> Column:
    def kinds(bare: Column) -> Column:
        out = None
        for kind, how, parts in rules.TITLE_RULES:
            test = bare.isin(*parts) if how == "is" else bare.rlike(parts[0]) if how == "match" else has_any(bare, parts)
            out = F.when(test, kind) if out is None else out.when(test, kind)
        return out.otherwise("UNKNOWN")

    return _let(_bare(F.coalesce(title, F.lit(""))), kinds)


def infer_section_type(title: Column, content: Column) -> Column:
    def kinds(bare: Column) -> Column:
        out = None
        for kind, parts in rules.CONTENT_RULES:
            test = has_any(bare, parts)
            out = F.when(test, kind) if out is None else out.when(test, kind)
        return out.otherwise("UNKNOWN")

    by_title = section_type_from_title(title)
    return F.when(by_title != "UNKNOWN", by_title).otherwise(_let(_bare(F.coalesce(content, F.lit(""))), kinds))


def is_heading(line: Column) -> Column:
    words = F.size(F.split(line, r"\s+"))
    shape = line.rlike(rules.NUMBERED_HEADING) | (line.rlike(rules.TITLE_CASE_HEADING) & (words <= rules.HEADING_WORDS))
    return (F.length(line) <= rules.HEADING_CHARS) & ~line.endswith(".") & ((section_type_from_title(line) != "UNKNOWN") | shape)


def heading_title(line: Column) -> Column:
    return trim_all(F.regexp_replace(line, rules.TITLE_NUMBERING, ""))


def tokens(text: Column) -> Column:
    """Lower-case tokens of two or more characters without stopwords."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), rules.TOKEN_SPLIT)
    return F.filter(words, lambda w: (F.length(w) >= 2) & ~w.isin(*rules.STOPWORDS))


def token_estimate(text: Column) -> Column:
    n = F.length(text)
    return F.when(F.coalesce(n, F.lit(0)) == 0, 0).otherwise(F.greatest(F.lit(1), F.ceil(n / 4))).cast("long")


def occurrences(text: Column, part: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("long")


def sections_of(text: Column) -> Column:
    """Line-by-line view of a text: array<struct<pos, line>>, lines trimmed."""
    return F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("pos"), trim_all(x).alias("line")))
