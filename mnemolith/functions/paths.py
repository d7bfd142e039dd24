"""Page path rules: checks, memory types, link forms. All are column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import with_value

#: Memory types in their index order.
MEMORY_TYPES = ("semantic", "episodic", "procedural", "prospective")
#: The only index pages that carry no provenance header.
STRUCTURAL = ("index.md", *(f"{t}/index.md" for t in MEMORY_TYPES))
#: Percent codes that link targets use, in the order of decoding.
PERCENT = (("%20", " "), ("%28", "("), ("%29", ")"), ("%3C", "<"), ("%3E", ">"), ("%5C", "\\"))

#: A path with an empty component, ``.`` or ``..``.
UNCLEAN = r"(?:\A|/)\.{0,2}(?:/|\z)"
#: A component with the ``..`` that takes it back.
PAIR = r"(?<![^/])(?!\.{0,2}/)[^/]++/\.\.(?:/|\z)"


def _first_reason(checks: list[tuple[Column, str]]) -> Column:
    """Text of the first check that holds, else an empty string."""
    return reduce(lambda rest, c: F.when(c[0], F.lit(c[1])).otherwise(rest), reversed(checks), F.lit(""))


def store_path_error(p: Column) -> Column:
    """Why the store refuses a path; empty if it doesn't."""
    return _first_reason([(p == "", "empty"), (F.contains(p, F.lit("..")), "traversal"), (F.startswith(p, F.lit("/")), "absolute"), (F.startswith(p, F.lit(".meta/")), "metadata")])


def tool_path_error(p: Column) -> Column:
    """The same checks as the tool surface orders them: absolute before traversal."""
    return _first_reason([(p == "", "empty"), (F.startswith(p, F.lit("/")), "absolute"), (F.contains(p, F.lit("..")), "traversal"), (F.startswith(p, F.lit(".meta/")), "metadata")])


def valid_page_path(p: Column) -> Column:
    """The root index or a page of a memory type; archived pages are not."""
    return reduce(lambda a, t: a | F.startswith(p, F.lit(t + "/")), MEMORY_TYPES, p == "index.md")


def structural_index(p: Column) -> Column:
    return p.isin(*STRUCTURAL)


def any_index(p: Column) -> Column:
    """Any page named index.md, however deep: wider than structural_index."""
    return base_name(p) == "index.md"


def base_name(p: Column) -> Column:
    return F.element_at(F.split(p, "/"), -1)


def memory_type(p: Column) -> Column:
    """The first component if it is a memory type, else empty."""
    first = F.get(F.split(p, "/"), F.lit(0))
    return F.when(first.isin(*MEMORY_TYPES), first).otherwise("")


def migrated_memory_type(p: Column) -> Column:
    """As a migration infers it: an archive prefix is skipped and the default is semantic."""
    kind = memory_type(F.regexp_replace(p, "^archive/(?=.)", ""))
    return F.when(kind != "", kind).otherwise("semantic")


def page_type(p: Column) -> Column:
    kind = migrated_memory_type(p)
    return (
        F.when(kind == "procedural", "procedure")
        .when(kind.isin("episodic", "prospective"), "event")
        .when(F.contains(p, F.lit("/people/")) | F.contains(p, F.lit("/person/")), "person")
        .otherwise("concept")
    )


def walk_order(p: Column) -> Column:
    """Sort key of a directory walk: component by component."""
    return F.split(p, "/")


def decode_target(link: Column) -> Column:
    return reduce(lambda c, x: F.replace(c, F.lit(x[0]), F.lit(x[1])), PERCENT, link)


def encode_target(link: Column) -> Column:
    return reduce(lambda c, x: F.replace(c, F.lit(x[1]), F.lit(x[0])), PERCENT, link)


def external_link(link: Column) -> Column:
    return F.lower(link).rlike("^(https?://|mailto:|tel:|#)")


def source_anchor_link(link: Column) -> Column:
    """A commit-pinned source reference, as the code scanner writes it."""
    return link.rlike(r"^[^\t\n\f\r :]+:[0-9a-fA-F]{40}:[^\n]+:(deleted|[0-9]+:[^\n]+)\z")


def _walk(p: Column) -> Column:
    """clean_path component by component."""
    done = F.aggregate(
        F.filter(F.split(p, "/"), lambda x: (x != "") & (x != ".")),
        F.struct(F.array().cast("array<string>").alias("at"), F.lit(True).alias("inside")),
        lambda acc, x: F.when(x != "..", F.struct(F.array_append(acc["at"], x).alias("at"), acc["inside"].alias("inside"))).otherwise(
            F.struct(F.slice(acc["at"], 1, F.greatest(F.size(acc["at"]) - 1, F.lit(0))).alias("at"), (acc["inside"] & (F.size(acc["at"]) > 0)).alias("inside"))
        ),
    )
    return with_value(done, lambda x: F.when(x["inside"], F.array_join(x["at"], "/")))


def clean_path(p: Column) -> Column:
    """Without ``.`` and empty components and with ``..`` taken back; null if that leaves the root."""
    # Most paths have no component to take out, and that shows without a pattern; or pairs gone at once leave such a path or
    # one that begins with ``..`` and so leaves the root, whatever follows.
    out = lambda x: F.startswith(x, F.lit("../")) | (x == "..")
    less = with_value(F.regexp_replace(p, PAIR, ""), lambda x: F.when(~out(x), F.when(~x.rlike(UNCLEAN), x).otherwise(_walk(x))))
    odd = F.contains(p, F.lit("/.")) | F.contains(p, F.lit("//")) | F.startswith(p, F.lit(".")) | F.startswith(p, F.lit("/")) | F.endswith(p, F.lit("/")) | (p == "")
    return F.when(~odd, p).otherwise(less)


def directory(p: Column) -> Column:
    """All but the last component, empty at the root."""
    return F.regexp_replace(p, "/?[^/]*\\z", "")
