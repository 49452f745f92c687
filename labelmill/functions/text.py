"""Column functions for report texts. Patterns are parameters; blanks are trimmed as a whole class."""

from __future__ import annotations

import functools
import operator
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The headers that end a section.
HEADERS = ("FINAL REPORT", "EXAMINATION", "INDICATION", "TECHNIQUE", "COMPARISON", "FINDINGS", "IMPRESSION", "ADDENDUM")


def ws_trim(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def normalise(c: Column, collapse_blanks: bool = False) -> Column:
    """CRLF to LF, three or more newlines to two, trimmed; optionally runs of blanks and tabs to one blank."""
    c = F.regexp_replace(c, "\r\n?", "\n")
    if collapse_blanks:
        c = F.regexp_replace(c, "[ \t]+", " ")
    return ws_trim(F.regexp_replace(c, "\n{3,}", "\n\n"))


def section(c: Column, header: str, headers: tuple[str, ...] = HEADERS, own_line: bool = False) -> Column:
    """Text under a header up to the next of headers, null if empty; case and colons don't matter.

    A header ends a section where it starts a line, or only where it stands alone on its line (own_line). Texts
    that don't name the header at all are not searched.
    """
    stop = "|".join(headers)
    if own_line:
        pattern = rf"(?dims)^\s*{header}\s*:?\s*(.*?)(?=^\s*(?:{stop})\s*:?\s*$|\z)"
    else:
        pattern = rf"(?dis)(?:^|\n)\s*{header}\s*:?\s*(.*?)(?:\n\s*(?:{stop})\s*:?\s*|\z)"
    found = F.when(F.upper(c).contains(header.upper()), F.regexp_extract(c, pattern, 1))
    return F.nullif(ws_trim(found), F.lit(""))


def last_paragraph(c: Column, drop_blank: bool = True) -> Column:
    """What stands after the last blank line: of all paragraphs with text, or of the trimmed text as it is."""
    if drop_blank:
        return F.nullif(ws_trim(F.element_at(F.filter(F.split(c, r"\n\s*\n"), lambda p: ws_trim(p) != ""), -1)), F.lit(""))
    return F.element_at(F.split(F.regexp_replace(ws_trim(c), r"\n\s*\n+", "\n\n"), "\n\n"), -1)


def chain(*groups: str, within: int = 120) -> str:
    """A pattern for alternations one after the other, each at most so many characters of a line after the one before."""
    return "(?d)" + rf".{{0,{within}}}".join(f"(?:{g})" for g in groups)


def guarded_rlike(c: Column, words: str, *patterns: str) -> Column:
    """Whether a pattern matches; texts without any of the literal words, which each match needs, are not searched."""
    needs = functools.reduce(operator.or_, (c.contains(w) for w in words.split("|")))
    return needs & functools.reduce(operator.or_, (c.rlike(p) for p in patterns))


def lines_with(c: Column, words: str) -> Column:
    """The lines of a text that hold any of the literal words."""
    holds = lambda line: functools.reduce(operator.or_, (line.contains(w) for w in words.split("|")))
    return F.when(holds(c), F.array_join(F.filter(F.split(c, "\n"), holds), "\n")).otherwise(F.lit(""))


def terms_to_regex(terms: list[str]) -> str:
    """One group of escaped terms in lower case, longest first so that none hides behind its own prefix; each blank stands
    for any run of white space. For texts in lower case."""
    escaped = {re.escape(t.lower()).replace(r"\ ", r"\s+") for t in terms}
    return "(?:" + "|".join(sorted(escaped, key=lambda t: (-len(t), t))) + ")"


def missing_groups(vocabulary: dict[str, list[str]], required: list[str]) -> list[str]:
    return sorted(g for g in required if not vocabulary.get(g))


def hash_unit(c: Column) -> Column:
    """A number in [0, 1) from the first 8 hexadecimal digits of the value's SHA-256."""
    return F.conv(F.substring(F.sha2(c.cast("string"), 256), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def split_bucket(c: Column, salt: str, buckets: int = 10000) -> Column:
    """The bucket of an id: its first 15 hexadecimal digits of SHA-256(id-salt), modulo buckets."""
    return F.conv(F.substring(F.sha2(F.concat(c.cast("string"), F.lit(f"-{salt}")), 256), 1, 15), 16, 10).cast("bigint") % buckets


def split_name(bucket: Column, train: int = 7000, validation: int = 8500) -> Column:
    return F.when(bucket < train, "train").when(bucket < validation, "validation").otherwise("test")


def normalised_id(c: Column) -> Column:
    """Positive whole numbers, also as 12.0 or '12', as bigint; else null."""
    d = c.try_cast("double")
    return F.when((d > 0) & (d % 1 == 0), d.cast("bigint"))


def flag_present(c: Column) -> Column:
    """Whether a flag string says something: blank, none, [], nan and <na> do not."""
    return F.coalesce(~F.lower(ws_trim(c)).isin("", "none", "[]", "nan", "<na>"), F.lit(False))


def flags_present(c: Column) -> Column:
    """Whether an array has a flag that says something."""
    return F.coalesce(F.exists(c, flag_present), F.lit(False))


# Names and signs that an operating system keeps from file names, and the reasons given.
RESERVED = r"^(CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])$"
FORBIDDEN = r'[<>:"/\\|?*\x00-\x1f]'


def unsafe_id_reason(c: Column) -> Column:
    """Why a rendered id cannot name a file, or null."""
    return (
        F.when(c.isNull(), "missing")
        .when(c == "", "empty")
        .when(c.rlike(r"^\s|\s$"), "leading_or_trailing_whitespace")
        .when(c.isin(".", ".."), "dot_path_component")
        .when(c.endswith("."), "trailing_dot")
        .when(c.rlike(FORBIDDEN), "windows_invalid_character")
        .when(F.upper(F.substring_index(c, ".", 1)).rlike(RESERVED), "windows_reserved_device_name")
    )


def rendered_id(template: str, **parts: Column) -> Column:
    """template with {name} filled in, trimmed; null where a part is null or blank."""
    pieces, at = [], 0
    for m in re.finditer(r"\{(\w+)\}", template):
        pieces += [F.lit(template[at : m.start()]), blank_to_null(parts[m[1]])]
        at = m.end()
    return F.concat(*pieces, F.lit(template[at:]))


def text_lengths(c: Column, most_characters: int = 16000, most_words: int = 500, word: str = r"(?U)\b\w+\b") -> dict[str, Column]:
    """Characters, words, words of the longest run between sentence ends, and whether text or run exceed a limit."""
    words = lambda x: F.size(F.regexp_extract_all(x, F.lit(word), F.lit(0))).cast("bigint")
    run = F.coalesce(F.array_max(F.transform(F.split(c, r"(?<=[.!?])\s+|\n+"), words)), F.lit(0).cast("bigint"))
    n = F.char_length(c).cast("bigint")
    return {"n_characters": n, "n_words": words(c), "longest_run": run, "too_many_characters": n > most_characters, "too_long_run": run > most_words}


def utf16_length(c: Column) -> Column:
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("bigint")


def utf16_offset(text: Column, offset: Column) -> Column:
    """UTF-16 units before a code-point offset."""
    return utf16_length(F.substr(text, F.lit(1), offset.cast("int")))


def code_point_offset(text: Column, offset: Column) -> Column:
    """The code-point offset of a UTF-16 offset; null outside the text or inside a pair.

    A character beyond the first 65536 takes two units, so the place is found by halving between offset / 2 and offset.
    """
    def step(span: Column, _: Column) -> Column:
        mid = F.floor((span["lo"] + span["hi"]) / 2)
        below = utf16_offset(text, mid) < offset
        return F.struct(F.when(below, mid + 1).otherwise(span["lo"]).alias("lo"), F.when(below, span["hi"]).otherwise(mid).alias("hi"))

    start = F.struct(F.floor(offset / 2).cast("bigint").alias("lo"), F.least(offset.cast("bigint"), F.char_length(text).cast("bigint")).alias("hi"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(32)), start, lambda s, i: F.when(s["lo"] < s["hi"], step(s, i)).otherwise(s))["lo"]
    return F.when((offset >= 0) & (offset <= utf16_length(text)) & (utf16_offset(text, found) == offset), found)


def covered_text(text: Column, start: Column, end: Column) -> Column:
    """The text of a half-open span of code points; null if the span does not lie in the text."""
    inside = (start >= 0) & (end >= start) & (end <= F.char_length(text))
    return F.when(inside, F.substring(text, (start + 1).cast("int"), (end - start).cast("int")))


def blank_to_null(c: Column, *also: str) -> Column:
    """Trimmed; null if nothing is left or what is left is one of also."""
    t = ws_trim(c.cast("string"))
    return F.when(~t.isin("", *also), t)


def parsed_share(c: Column, top: float = 1.0) -> tuple[Column, Column]:
    """A number in [0, top] (blank is null), and whether the value is malformed or out of range."""
    text = blank_to_null(c)
    d = text.try_cast("double")
    bad = text.isNotNull() & (d.isNull() | ~d.between(0, top) | F.isnan(d))
    return F.when(~bad, d), bad


def case_id(subject: Column, study: Column, prefix: str = "case") -> Column:
    """prefix_subject_study of two positive whole numbers; null unless both are."""
    return F.concat(F.lit(f"{prefix}_"), normalised_id(subject).cast("string"), F.lit("_"), normalised_id(study).cast("string"))


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = F.greatest(F.least(p, F.lit(1 - eps)), F.lit(eps))
    return F.ln(q / (1 - q))


def wilson_half_width(p: Column, n: Column, z: float = 1.959963984540054) -> Column:
    return z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)


def raters_required(reliability: Column, target: Column) -> Column:
    """Spearman-Brown: raters for a target reliability; null outside (0, 1]."""
    ok = (reliability > 0) & (reliability <= 1) & (target > 0) & (target < 1)
    k = target * (1 - reliability) / (reliability * (1 - target))
    return F.when(ok, F.greatest(F.ceil(k - 1e-12), F.lit(1)).cast("bigint"))
