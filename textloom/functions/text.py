"""Text functions with exact Unicode semantics, as Spark columns."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Mapping, Sequence
from functools import cache
from string import Formatter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import ExtractionError

#: The 29 white-space code points of Unicode text (Java's own classes miss some of them).
WS_CLASS = r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
WS = f"[{WS_CLASS}]"
UNICODE_FORMS = ("NFC", "NFD", "NFKC", "NFKD", "none")
ROMAN = r"^M{0,3}(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})$"


def collapse(c: Column) -> Column:
    """Each run of white space as one space."""
    return F.regexp_replace(c, f"{WS}+", " ")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"\A{WS}+|{WS}+\z", "")


def blank(c: Column) -> Column:
    return ~F.coalesce(c, F.lit("")).rlike(f"[^{WS_CLASS}]")


def unicode_normalise(c: Column, form: str = "NFC") -> Column:
    """Unicode normal form. Text that has it already never leaves the JVM: ASCII, and for NFC all below U+0300, where
    no character combines with another."""
    if form == "none":
        return c

    @F.pandas_udf("string")
    def other(s: pd.Series) -> pd.Series:
        return s.map(lambda x: x if x is None or unicodedata.is_normalized(form, x) else unicodedata.normalize(form, x))

    last = r"\x{2FF}" if form == "NFC" else r"\x7F"
    return F.coalesce(other(F.when(c.rlike(rf"[^\x00-{last}]"), c)), c)


def normalise(c: Column, collapse_whitespace: bool = True, strip_ends: bool = True, form: str = "NFC") -> Column:
    """White space collapsed, then ends stripped, then the Unicode form, in this order."""
    if collapse_whitespace:
        c = collapse(c)
    if strip_ends:
        c = F.trim(c) if collapse_whitespace else strip(c)
    return unicode_normalise(c, form)


def java_regex(pattern: str, ignore_case: bool = False) -> str:
    """A Python pattern for Java's engine: same classes, line ends and case rules; untranslatable ones are refused."""
    try:
        re.compile(pattern, re.IGNORECASE if ignore_case else 0)
    except re.error as e:
        raise ExtractionError(f"invalid regular expression {pattern!r}: {e}") from e
    out, i, inside = [], 0, False
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two == r"\s":
            out.append(WS_CLASS if inside else WS)
            i += 2
        elif two == r"\S":
            if inside:
                raise ExtractionError(r"\S inside a character class isn't supported")
            out.append(f"[^{WS_CLASS}]")
            i += 2
        elif two == r"\Z":
            out.append(r"\z")
            i += 2
        elif pattern[i] == "\\":
            out.append(two)
            i += 2
        elif pattern.startswith("(?P<", i):
            out.append("(?<")
            i += 4
        elif m := re.match(r"\(\?P=(\w+)\)", pattern[i:]):
            out.append(rf"\k<{m[1]}>")
            i += len(m[0])
        else:
            if inside and pattern[i] in "[&":  # Java gives these a meaning in classes
                out.append("\\")
            elif pattern[i] == "[":
                inside = True
                out.append("[")
                i += 1
                if pattern[i : i + 1] == "^":
                    out.append("^")
                    i += 1
                if pattern[i : i + 1] == "]":
                    out.append(r"\]")
                    i += 1
                continue
            elif pattern[i] == "]":
                inside = False
            out.append(pattern[i])
            i += 1
    return ("(?diU)" if ignore_case else "(?dU)") + "".join(out)


def searches(c: Column, pattern: str, ignore_case: bool = False) -> Column:
    return c.rlike(java_regex(pattern, ignore_case))


def glob_regex(glob: str) -> str:
    """Shell pattern as a regular expression over case-folded text; * crosses slashes."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        i += 1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[":
            j = i + (glob[i : i + 1] in ("!", "^"))
            j += glob[j : j + 1] == "]"
            end = glob.find("]", j)
            if end < 0:
                out.append(r"\[")
                continue
            body = glob[i:end].replace("\\", r"\\").replace("[", r"\[").replace("&", r"\&")
            if body.startswith("!"):
                body = "^" + body[1:]
            elif body.startswith("^"):
                body = "\\" + body
            if body.startswith("]") or body.startswith("^]"):
                body = body.replace("]", r"\]", 1)
            out.append(f"[{body}]")
            i = end + 1
        else:
            out.append(re.sub(r"([^\w\s])", r"\\\1", c))
    return r"(?s)\A" + "".join(out) + r"\z"


@cache
def _fold_exceptions() -> str:
    """Characters whose case folding isn't their lower case, with their folding, for str_to_map."""
    every = (chr(i) for i in range(0x80, 0x110000) if not 0xD800 <= i < 0xE000)
    return "\x01".join(f"{c}\x02{c.casefold()}" for c in every if c.casefold() != c.lower())


def casefold(c: Column) -> Column:
    """Full case folding; text in ASCII takes the short way."""
    table = F.str_to_map(F.lit(_fold_exceptions()), F.lit("\x01"), F.lit("\x02"))
    folded = F.array_join(F.transform(F.split(c, ""), lambda x: F.coalesce(table[x], F.lower(x))), "")
    return F.when(c.rlike(r"[^\x00-\x7f]"), folded).otherwise(F.lower(c))


def glob_any(c: Column, globs: Sequence[str]) -> Column:
    """Whether any glob matches, whatever the case."""
    text, found = casefold(c), F.lit(False)
    for g in globs:
        found = found | text.rlike(glob_regex(g.casefold()))
    return found


def literal_glob(text: str) -> str:
    """A glob that matches only this text."""
    return re.sub(r"([\[*?])", r"[\1]", text)


def local_name(c: Column) -> Column:
    return F.substring_index(c, "}", -1)


def prefix_length(c: Column, pattern: str, ignore_case: bool = False) -> Column:
    """Code points of the prefix that the pattern matches at the start; null where it matches nothing."""
    if not pattern.startswith("^"):
        raise ExtractionError("a prefix pattern begins with ^")
    n = F.length(F.regexp_extract(c, java_regex(pattern, ignore_case).replace(")", r")\A(?:", 1) + ")", 0))
    return F.when(n > 0, n)


def roman_value(c: Column) -> Column:
    """Value of a canonical Roman numeral of any case, 1 to 3999; null for anything else."""
    up = F.upper(c)
    digit = F.create_map(*[F.lit(x) for pair in (("I", 1), ("V", 5), ("X", 10), ("L", 50), ("C", 100), ("D", 500), ("M", 1000)) for x in pair])
    values = F.transform(F.split(up, ""), lambda x: F.coalesce(digit[x], F.lit(0)))
    # a digit counts negative where the next is larger
    pairs = F.zip_with(values, F.concat(F.slice(values, 2, F.greatest(F.size(values), F.lit(1))), F.array(F.lit(0))), lambda a, b: F.when(a < b, -a).otherwise(a))
    total = F.aggregate(pairs, F.lit(0), lambda s, x: s + x)
    return F.when(up.rlike(ROMAN) & (up != ""), total)


def convert_capture(c: Column, kind: str = "string", offset: int = 0, mapping: Mapping[str, str] | None = None, width: int | None = None) -> Column:
    """Group name of a captured text; null where it can't be converted.

    A mapping gives final names and is total. Otherwise decimal and roman captures are numbers, moved by offset,
    at least 1, and padded with zeros to the width.
    """
    if mapping is not None:
        if width or offset:
            raise ExtractionError("a source map excludes width and offset")
        return F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])[c]
    if kind == "string":
        if width or offset:
            raise ExtractionError("width and offset need a numeric capture")
        return F.when(c != "", c)
    if kind == "decimal":
        number = F.when(c.rlike(r"\A[0-9]+\z"), c.cast("decimal(38,0)")) + F.lit(offset)
    elif kind == "roman":
        number = roman_value(c).cast("decimal(38,0)") + F.lit(offset)
    else:
        raise ExtractionError(f"unknown capture kind {kind!r}")
    text = number.cast("decimal(38,0)").cast("string")
    if width:
        text = F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))
    return F.when(number >= 1, text)


def template_fields(template: str) -> list[tuple[str, str | None, str]]:
    """(literal, field, format) parts of a template; conversions and nested fields are refused."""
    try:
        parts = list(Formatter().parse(template))
    except ValueError as e:
        raise ExtractionError(f"invalid template {template!r}: {e}") from e
    out = []
    for literal, field, spec, conversion in parts:
        if conversion or (spec and ("{" in spec or "}" in spec)):
            raise ExtractionError(f"conversions and nested fields aren't supported: {template!r}")
        if field is not None and not field.isidentifier():
            raise ExtractionError(f"unknown field {field!r} in {template!r}")
        out.append((literal, field, spec or ""))
    return out


def _formatted(c: Column, spec: str, as_number: bool) -> Column:
    @F.pandas_udf("string")
    def one(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if pd.isna(x) else format(int(x) if as_number else x, spec))

    return one(c)


def render(template: str, fields: Mapping[str, Column], numeric: Sequence[str] = ("number", "block")) -> Column:
    """A template as one string column: plain and zero-padded fields as expressions, other formats in Arrow batches."""
    pieces: list[Column] = []
    for literal, field, spec in template_fields(template):
        if literal:
            pieces.append(F.lit(literal))
        if field is None:
            continue
        if field not in fields:
            raise ExtractionError(f"unknown field {field!r} in {template!r}")
        c, m = fields[field], re.fullmatch(r"(?:0(\d+))?d?", spec)
        if field in numeric and m:
            pieces.append(F.format_string(f"%0{int(m[1])}d", c.cast("long")) if m[1] and int(m[1]) else c.cast("long").cast("string"))
        elif spec in ("", "s"):
            pieces.append(c.cast("string"))
        else:
            as_number = field in numeric
            try:
                format(1 if as_number else "x", spec)
            except ValueError as e:
                raise ExtractionError(f"invalid format {spec!r} in {template!r}") from e
            pieces.append(_formatted(c.cast("long") if as_number else c.cast("string"), spec, as_number))
    return F.concat(*pieces) if pieces else F.lit("")
