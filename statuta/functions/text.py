"""Text expressions with the white space and line rules of Python, kept inside the JVM.

Java's ``\\s`` knows six characters of white space and its ``$`` several line ends; the
patterns here use one explicit class of all 29, and ``(?d)`` leaves the newline as the
only line end.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed set: every character that Python takes as white space; the second form lacks the newline.
_REST = r"\t\x0B\f\r \x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WS, INLINE, NOT_WS = rf"[\n{_REST}]", f"[{_REST}]", rf"[^\n{_REST}]"
#: A word, and white space from its first character on, the same classes with the usual characters tried first: the whole class is slow in Java.
WORD, SPACE = rf"(?:[!-~]++|{NOT_WS})++", rf"(?> (?=[!-~])|{WS}++)"
#: A heading: one to six marks at the start of a line, white space, and at least one character.
HEADING = rf"(?d)^(#{{1,6}}){INLINE}+(.+)"
HEADING_START = rf"(?dm)^(?=#{{1,6}}{INLINE}+.)"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"\A{WS}+|{WS}+\z", "")


def is_blank(c: Column) -> Column:
    """True for null, empty and white space alone."""
    return ~F.coalesce(c.rlike(NOT_WS), F.lit(False))


def words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(WORD), 0)


def word_count(c: Column) -> Column:
    return F.coalesce(F.size(words(c)), F.lit(0)).cast("long")


def lines(c: Column) -> Column:
    return F.split(c, "\n")


def strip_lines(c: Column) -> Column:
    """Every line stripped, then the whole."""
    return strip(F.regexp_replace(c, rf"(?dm)^{INLINE}+|{INLINE}+$", ""))


def paragraphs(c: Column) -> Column:
    """Parts between blank lines, stripped, without empty ones."""
    return F.filter(F.transform(F.split(strip(c), rf"\n{WS}*\n"), strip), lambda p: p != "")


def sentences(c: Column) -> Column:
    """Parts at white space after a full stop, exclamation or question mark."""
    return F.filter(F.transform(F.split(c, rf"(?<=[.!?]){WS}+"), strip), lambda s: s != "")


def heading_level(c: Column) -> Column:
    return F.length(F.regexp_extract(c, HEADING, 1)).cast("long")


def heading_text(c: Column) -> Column:
    """The marks, one space and the content, whose trailing white space stays."""
    return F.concat(F.regexp_extract(c, HEADING, 1), F.lit(" "), F.regexp_extract(c, HEADING, 2))


def is_heading(c: Column) -> Column:
    return c.rlike(HEADING)


def clean_entities(c: Column) -> Column:
    """Three character references that a document converter leaves."""
    for old, new in (("&nbsp;", " "), ("&ndash;", "-"), ("&sect;", "\u00a7")):
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def preview(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def java_pattern(pattern: str) -> str:
    """A Python pattern in Java's dialect, checked in Python first."""
    try:
        re.compile(pattern)
    except re.error as e:
        raise ValueError(f"invalid pattern {pattern!r}: {e}") from e
    return re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", pattern.replace("(?P<", "(?<"))


def starts_with_pattern(c: Column, pattern: str) -> Column:
    """Whether the pattern matches at the start; it need not reach the end."""
    return c.rlike(f"(?d)^(?:{java_pattern(pattern)})")


def jurisdiction_id(state: Column, municipality: Column) -> Column:
    return F.concat_ws("-", F.upper(strip(state)), F.regexp_replace(strip(municipality), " ", ""))


def parse_jurisdiction(c: Column) -> tuple[Column, Column]:
    """State and municipality at the first hyphen; both null without one."""
    both = F.split(c, "-", 2)
    whole = F.size(both) == 2
    return F.when(whole, F.upper(both[0])), F.when(whole, both[1])


def collection_name(name: str, provider: str | None, default: str = "legal_code_all") -> str:
    """The default name becomes that of the provider; another gets the provider as suffix unless it has it."""
    if not provider:
        return name
    if name == default:
        return f"{default.removesuffix('_all')}_{provider}"
    return name if name.endswith(f"_{provider}") else f"{name}_{provider}"


def make_jurisdiction_id(state: str, municipality: str) -> str:
    if not state or not state.strip() or not municipality or not municipality.strip():
        raise ValueError("state and municipality must not be blank")
    state, municipality = state.strip().upper(), municipality.strip().replace(" ", "")
    if not state.replace("-", "").isalnum() or not municipality.replace("-", "").isalnum():
        raise ValueError("state and municipality may hold letters, digits and hyphens only")
    return f"{state}-{municipality}"
