"""Code and links of Markdown as column expressions.

One grammar serves the columns here and the page migration: its patterns mean the same to Java's regex
engine and to Python's (3.11 or later). Repetitions are possessive, so that neither engine recurses or
goes back over a long text.

A fence is a line that begins with three backticks or tildes, white space before them aside; either
form closes either, and an open fence goes to the end. A code span lies within a line, between a run of
backticks and the next place where as many stand.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WHITE, trim_all, with_value

#: White space but the line feed, as a class body in plain characters.
LINE_SPACE = re.sub(r"\\x\{(\w+)\}", lambda m: chr(int(m[1], 16)), WHITE).replace("\t-\r", "\t\v-\r")

_MARK = rf"[{LINE_SPACE}]*+(?:```|~~~)"
_BLOCK = rf"{_MARK}[^\n]*+(?:\n(?!{_MARK})[^\n]*+)*+(?:\n{_MARK}[^\n]*+)?"
#: A fenced block with both its marks, from the start of a line to the end of another.
FENCED = rf"(?<![^\n]){_BLOCK}"
#: A code span; backticks without a partner are a match of their own.
SPAN = r"(`++)(?:[^\n]*?\1)?"
#: The start of a link's parentheses, trimmed: <target>, or all up to white space outside quotes.
ANGLE = r"\A<([^>]*+)>"
TARGET = r"\A(?:[^'\" \t\n]++|'[^']*+'|\"[^\"]*+\")*+(?:['\"](?s:.*+))?"
#: Parentheses that hold a path and nothing else, without what a target may be cut at or decoded for.
PLAIN = r"(?>[!$&*-9;=@-_a-~]+)"


def _span(group: int) -> str:
    """A code span whose backticks are the pattern's group of this number."""
    return rf"(`++)(?:(?:[^`\n]+|(?!\{group})`)*+\{group})?"


def _up_to(stop: str, group: int) -> str:
    """All up to a character that isn't code."""
    return rf"(?:[^{stop}`\n]+|{_span(group)}|\n(?:{_BLOCK})?+)*+"


def next_link(aside: str) -> str:
    """All up to a link's end, in a text as it stands: code, images and links whose parentheses begin with a match of
    ``aside`` are passed over, and so is a bracket without its partner, to where the search for it ended. Group 8 is the
    target if it is plain, else the parentheses; it takes no part where no link was found."""
    text = lambda group: _up_to(r"\]", group)
    inner = lambda group: _up_to(")", group)
    skipped = rf"[^!\[`\n]+|{_span(1)}|\n(?:{_BLOCK})?+"
    image = rf"!(?:{_span(2)})*+(?:\[{text(3)}(?:\](?:(?:{_span(4)})*+\({inner(5)}\)?+)?+)?+)?+"
    target = rf"(?!\((?:{aside}))(?:\((?={PLAIN}\))|(?=\())({PLAIN}(?=\))|\({inner(9)}\))|\({inner(10)}"
    link = rf"\[{text(6)}(?:\](?:(?:{_span(7)})*+(?:{target}))?+)?+"
    return rf"(?:\A{_BLOCK})?+(?:{skipped}|{image})*+(?:{link}|\z)"


def prose(body: Column) -> Column:
    """Markdown without fenced blocks (their line feeds stay) and code spans; backticks without a
    partner go, too. Null stays null."""
    outside, blocks = F.split(body, FENCED), F.regexp_extract_all(body, F.lit(FENCED), F.lit(0))
    kept = F.zip_with(outside, blocks, lambda o, b: F.concat(o, F.coalesce(F.regexp_replace(b, "[^\n]+", ""), F.lit(""))))
    return F.regexp_replace(F.array_join(kept, ""), SPAN, "")


def destination(raw: Column) -> Column:
    """The target in a link's parentheses: angle brackets and titles gone, trimmed."""
    angle, target = (rf"\A[{WHITE}]*+({x[2:]})" for x in (ANGLE, TARGET))
    return trim_all(F.when(F.contains(raw, F.lit("<")) & raw.rlike(angle), F.regexp_extract(raw, angle, 2)).otherwise(F.regexp_extract(raw, target, 1)))


def link_targets(body: Column, aside: str = "(?!)", other: Callable[[Column], Column] = lambda x: x) -> Column:
    """Destinations of the links in prose, in order, images left out, and links that begin with a match of ``aside``.
    ``other`` changes those that aren't plain paths; null drops them."""
    none = ~F.contains(body, F.lit("](")) & ~F.contains(body, F.lit("]`"))  # only a code span can stand between ] and ( and go
    # The opening parenthesis keeps what follows it from being the start of a line.
    text = lambda x: F.when(F.contains(x, F.lit("`")) | F.contains(x, F.lit("~~~")), prose(x)).otherwise(x)
    target = lambda x: other(destination(with_value(text(x), lambda t: F.substring(t, F.lit(2), F.length(t) - 2))))
    found = F.regexp_extract_all(body, F.lit(next_link(aside)), F.lit(8))
    found = F.transform(found, lambda x: F.when(F.startswith(x, F.lit("(")), target(x)).when(x != "", x))
    return F.when(none, F.array().cast("array<string>")).otherwise(F.filter(found, lambda x: x.isNotNull()))
