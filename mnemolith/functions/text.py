"""Text helpers whose results don't depend on the regex engine's defaults.

Patterns are spelled so that Java and RE2 agree: ``\\z`` instead of ``$``, explicit classes instead of
``\\s`` and ``\\b``, and no bare dot where a carriage return may stand.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The code points with the Unicode property White_Space, as a class body.
WHITE = r"\x{9}-\x{D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
SPACES = "".join(map(chr, (*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))

#: A place where ASCII word characters begin or end; Java's \b also counts other letters.
EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
SECRET = rf"{EDGE}sk[-_][A-Za-z0-9][A-Za-z0-9_-]{{8,}}{EDGE}"
REDACTED = "sk_<redacted>"
#: Lines in which a text's first prose line is looked for at first.
HEAD_LINES = 8

#: RFC 3339 with a mandatory zone; a cast alone also takes looser forms.
RFC3339 = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})\z"


def trim_all(c: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.btrim(c, F.lit(SPACES))


def with_value(value: Column, use: Callable[[Column], Column]) -> Column:
    """What is made of a value that is computed once, however often it is used, also inside other functions."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def lower_runes(c: Column) -> Column:
    """Lower case code point by code point: no final sigma, no two-code-point i."""
    return F.lower(F.translate(c, "İΣ", "iσ"))


def byte_prefix(c: Column, n: int) -> Column:
    """The first n bytes of the UTF-8 form; a cut character becomes U+FFFD."""
    return F.make_valid_utf8(F.substring(c.cast("binary"), 1, n).cast("string"))


def cut_bytes(c: Column, n: int, mark: str) -> Column:
    """Text of more than n bytes cut there, with a mark."""
    return F.when(F.octet_length(c) > n, F.concat(byte_prefix(c, n), F.lit(mark))).otherwise(c)


def redact(c: Column) -> Column:
    """Credentials of the two known shapes replaced by a fixed token."""
    for sep in ("-", "_"):
        c = F.regexp_replace(c, SECRET.replace("[-_]", sep), REDACTED)
    return c


def parse_time(c: Column) -> Column:
    """Timestamp of an RFC 3339 text, else null."""
    return F.when(c.rlike(RFC3339), F.try_to_timestamp(c))


def one_line_end(c: Column) -> Column:
    """With line feeds for CRLF and CR."""
    return F.when(F.contains(c, F.lit("\r")), F.regexp_replace(c, "\r\n?", "\n")).otherwise(c)


def content_lines(c: Column) -> Column:
    """Lines without line ends; CRLF and CR count as line ends."""
    return F.split(one_line_end(c), "\n")


def has_frontmatter_comments(c: Column) -> Column:
    """Both provenance keys occur somewhere in the text."""
    return F.contains(c, F.lit("compiled_from:")) & F.contains(c, F.lit("last_compiled:"))


def first_prose_line(content: Column, limit: int, default: Column, drop: str = r"^(#|<!--)") -> Column:
    """First trimmed line that is neither blank nor a heading or comment, cut at ``limit`` bytes."""
    def first(text):
        lines = F.transform(F.split(text, "\n"), trim_all)
        return F.get(F.filter(lines, lambda x: (x != "") & ~x.rlike(drop)), F.lit(0))

    # The first lines mostly have it; only where they don't are the others looked at.
    line = F.coalesce(first(F.substring_index(content, "\n", HEAD_LINES)), first(content))
    return F.coalesce(cut_bytes(line, limit, "..."), default)


def strip_blocks(c: Column, tag: str) -> Column:
    """Without ``<tag>...</tag>`` blocks; an unterminated one goes to the end. Trimmed."""
    c = F.regexp_replace(c, rf"(?s)<{tag}>.*?</{tag}>", "")
    return trim_all(F.regexp_replace(c, rf"(?s)<{tag}>.*\z", ""))
