"""Rule engines over pages: bundle validation and the staging gate."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.markdown import LINE_SPACE, link_targets
from ..functions.paths import MEMORY_TYPES, any_index, clean_path, decode_target, directory, external_link, source_anchor_link, structural_index, valid_page_path
from ..functions.text import RFC3339, has_frontmatter_comments, one_line_end, trim_all, with_value
from ..sources.tables import broadcast_if_small, materialize

#: Closed vocabularies of page fields.
PAGE_TYPES = ("concept", "procedure", "decision", "person", "project", "event")
TRUST_TIERS = ("T1", "T2", "T3")
CONFIDENCE = ("high", "medium", "low")
REQUIRED = ("title", "description", "timestamp", "memory_type")


def split_frontmatter(pages: DataFrame) -> DataFrame:
    """Adds ``header`` (null without frontmatter), ``body`` and ``unterminated``."""
    text = one_line_end(F.regexp_replace(F.col("content"), "^\\x{FEFF}", ""))
    rows = pages.withColumn("_x", text).withColumn("_o", (F.col("_x") == "---") | F.startswith("_x", F.lit("---\n")))
    # An opened text is cut once, at the first line that closes it.
    rows = rows.withColumn("_c", F.when(F.col("_o"), F.split("_x", rf"\n[{LINE_SPACE}]*+---[{LINE_SPACE}]*+(?=\n|\z)", 2)))
    done = F.col("_o") & (F.size("_c") > 1)
    return (
        rows.withColumn("header", F.when(done, F.expr("substring(_c[0], 5)")))
        .withColumn("body", F.when(done, F.expr("substring(_c[1], 2)")).when(F.col("_o"), "").otherwise(F.col("_x")))
        .withColumn("unterminated", F.col("_o") & (F.size("_c") == 1))
        .drop("_x", "_o", "_c")
    )


def _loader():
    """A YAML loader with YAML 1.2 booleans that refuses repeated keys."""
    import yaml

    class Loader(yaml.SafeLoader):
        pass

    Loader.yaml_implicit_resolvers = {k: [(t, r) for t, r in v if t != "tag:yaml.org,2002:bool"] for k, v in yaml.SafeLoader.yaml_implicit_resolvers.items()}
    Loader.add_implicit_resolver("tag:yaml.org,2002:bool", re.compile(r"^(?:true|True|TRUE|false|False|FALSE)$"), list("tTfF"))

    def mapping(loader, node, deep=False):
        keys = [loader.construct_object(k, deep=True) for k, _ in node.value]
        if len(set(map(str, keys))) < len(keys):
            raise yaml.constructor.ConstructorError(None, None, "mapping key already defined", node.start_mark)
        return {k: loader.construct_object(v, deep=True) for k, (_, v) in zip(keys, node.value, strict=True)}

    Loader.add_constructor(yaml.resolver.BaseResolver.DEFAULT_MAPPING_TAG, mapping)
    return yaml, Loader


def flatten_value(value) -> list[str]:
    """Scalars as text, lists flattened; maps, times and null give nothing."""
    if isinstance(value, bool):
        return ["true" if value else "false"]
    if isinstance(value, str):
        return [value] if value else []
    if isinstance(value, int):
        return [str(value)]
    if isinstance(value, float):
        return [str(int(value)) if value == int(value) and abs(value) < 1e21 else repr(value)]
    if isinstance(value, list):
        return [x for item in value for x in flatten_value(item)]
    return []


_TEXTS = T.ArrayType(T.StringType())
_FIELDS = T.StructType([T.StructField("fields", T.MapType(T.StringType(), _TEXTS)), T.StructField("error", T.StringType())])


@F.pandas_udf(_FIELDS)
def parse_fields(header: pd.Series) -> pd.DataFrame:
    """YAML headers as flat fields, or the error; null stays without either."""
    yaml, loader = _loader()
    read = {None: ({}, None)}
    for text in set(header.dropna()):  # equal headers of a batch are read once
        try:
            raw = yaml.load(text, loader)
            if raw is not None and not isinstance(raw, dict):
                raise yaml.YAMLError("not a mapping")
            read[text] = {str(k): flatten_value(v) for k, v in (raw or {}).items()}, None
        except (yaml.YAMLError, ValueError) as e:
            read[text] = {}, str(e).split("\n")[0]
    rows = [read[None if pd.isna(text) else text] for text in header]
    return pd.DataFrame({"fields": [f for f, _ in rows], "error": [e for _, e in rows]})


def _scalar(name: str) -> Column:
    values = F.coalesce(F.try_element_at(F.col("fields"), F.lit(name)), F.array().cast("array<string>"))
    return F.coalesce(trim_all(F.get(values, F.lit(0))), F.lit(""))


def field_issues(pages: DataFrame, strict: bool = False, profile: str = "bundle") -> DataFrame:
    """``severity, path, message`` of pages with parsed ``fields`` (null: no frontmatter)."""
    none = F.col("fields").isNull()
    kind, tier, trust = _scalar("type"), _scalar("trust_tier"), _scalar("confidence")
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    rules = [
        (none, "error", F.lit("missing YAML frontmatter with required type field")),
        (~none & (kind == ""), "error", F.lit("missing required field: type")),
        (~none & (kind != "") & ~kind.isin(*PAGE_TYPES) & F.lit(strict), "warning", F.concat(F.lit(f"unknown {profile} type "), quoted(kind))),
        *((none | (_scalar(x) == ""), "warning", F.lit(f"missing {profile} required field: {x}")) for x in REQUIRED),
        (~none & (_scalar("timestamp") != "") & ~(_scalar("timestamp").rlike(RFC3339) & F.try_to_timestamp(_scalar("timestamp")).isNotNull()), "error", F.lit("invalid timestamp format: must be RFC3339 / ISO 8601")),
        (~none & (_scalar("memory_type") != "") & ~_scalar("memory_type").isin(*MEMORY_TYPES), "error", F.concat(F.lit("invalid memory_type "), quoted(_scalar("memory_type")))),
        (~none & (F.coalesce(F.size(F.try_element_at("fields", F.lit("source_events"))), F.lit(0)) <= 0), "warning", F.lit("missing source_events provenance")),
        (~none & (tier == ""), "warning", F.lit("missing recommended field: trust_tier")),
        (~none & (tier != "") & ~tier.isin(*TRUST_TIERS), "error", F.concat(F.lit("invalid trust_tier "), quoted(tier))),
        (~none & (trust != "") & ~trust.isin(*CONFIDENCE), "error", F.concat(F.lit("invalid confidence "), quoted(trust))),
    ]
    found = F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(s).alias("severity"), m.alias("message"))) for c, s, m in rules)), lambda x: x.isNotNull())
    return pages.where(~(none & any_index(F.col("path")))).select("path", F.explode(found).alias("i")).select("i.severity", "path", "i.message")


#: How links begin that lead to no file of the bundle.
ASIDE = "[#/]|(?i:https?://|mailto:|tel:)"


def file_links(body: Column) -> Column:
    """Those of a page's links that should lead to a file of the bundle."""

    def file(link):
        aside = F.when(F.contains(link, F.lit(":")), external_link(link) | source_anchor_link(link)).otherwise(F.startswith(link, F.lit("#")))
        bare = decode_target(F.when(link.rlike("[#?]"), F.substring_index(F.substring_index(link, "#", 1), "?", 1)).otherwise(link))
        return F.when(~aside, with_value(bare, lambda x: F.when((x != "") & ~F.startswith(x, F.lit("/")), x)))

    return link_targets(body, ASIDE, lambda x: with_value(x, file))


def page_links(pages: DataFrame) -> DataFrame:
    """``path, link, target``: links of the body that should lead to a file of the bundle, with the
    path they resolve to (null outside the bundle)."""
    return resolved_links(pages.select("path", file_links(F.col("body")).alias("links")))


def resolved_links(pages: DataFrame) -> DataFrame:
    """page_links of pages whose links to files were found (``path, links``)."""
    # Of a plain explode, Spark would ask first whether there are any, and find the links for that, too.
    rows = pages.select("path", F.explode_outer("links").alias("link")).where(F.col("link").isNotNull())
    return rows.withColumn("target", clean_path(F.concat(directory(F.col("path")), F.lit("/"), F.col("link"))))


def link_totals(pages: DataFrame) -> DataFrame:
    """A row for each path with links to files (``path, body``): ``n_links, n_inside, n_targets`` (different ones), ``first_target,
    last_target, n_chars`` (of all targets). Links stay in the row of their page; only totals are shuffled."""
    rows = pages.select("path", F.concat(directory(F.col("path")), F.lit("/")).alias("base"), file_links(F.col("body")).alias("links"))
    whole = with_value(F.col("base"), lambda base: F.transform("links", lambda x: F.concat(base, x)))
    rows = rows.select("path", F.size("links").alias("n_links"), F.filter(F.transform(whole, clean_path), lambda x: x.isNotNull()).alias("inside"))
    rows = rows.select("path", "n_links", "inside", F.array_distinct("inside").alias("targets"))
    rows = rows.select("path", "n_links", F.size("inside").alias("n_inside"), F.size("targets").alias("n_targets"), F.array_min("targets").alias("first_target"),
                       F.array_max("targets").alias("last_target"), F.when(F.size("inside") > 0, F.length(F.array_join("inside", ""))).alias("n_chars"))
    totals = rows.groupBy("path").agg(
        F.sum("n_links").alias("n_links"), F.sum("n_inside").alias("n_inside"), F.max("n_targets").cast("long").alias("n_targets"),
        F.min("first_target").alias("first_target"), F.max("last_target").alias("last_target"), F.sum("n_chars").alias("n_chars"),
    ).where("n_links > 0")
    # Pages of one path may share targets: theirs are counted one by one.
    again = materialize(pages.groupBy(F.col("path").alias("again")).count().where("count > 1").select("again"))
    if again.isEmpty():
        return totals
    shared = page_links(pages.join(broadcast_if_small(again), F.col("path").eqNullSafe(F.col("again")), "left_semi"))
    shared = shared.groupBy(F.col("path").alias("again")).agg(F.count_distinct("target").alias("n"))
    totals = totals.join(shared, F.col("path").eqNullSafe(F.col("again")), "left")
    return totals.withColumn("n_targets", F.coalesce("n", "n_targets")).drop("again", "n")


def broken_links(links: DataFrame, files: DataFrame) -> DataFrame:
    """Links whose target is neither a file nor a directory above one."""
    parts = F.split("path", "/")
    dirs = files.select(F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("target")).distinct()
    lost = links.where(F.col("target").isNotNull()).join(dirs, "target", "left_anti")
    return lost.select(F.lit("warning").alias("severity"), "path", F.concat(F.lit("broken internal link: "), F.col("link")).alias("message"))


def validate_bundle(pages: DataFrame, strict: bool = False, profile: str = "bundle") -> DataFrame:
    """All issues of a bundle's Markdown pages (path, content), in (path, severity, message) order."""
    md = split_frontmatter(pages.where(F.endswith("path", F.lit(".md")) & ~F.col("path").rlike("(^|/)\\.[^/]*/")))
    md = md.withColumn("_p", parse_fields("header"))
    bad = F.when(F.col("unterminated"), "unterminated YAML frontmatter").when(F.col("_p.error").isNotNull(), F.concat(F.lit("invalid YAML frontmatter: "), F.col("_p.error")))
    # A page is cut, parsed and searched for links once; what the rules need of it is written down.
    md = materialize(md.select("path", bad.alias("bad"), F.when(F.col("header").isNotNull(), F.col("_p.fields")).alias("fields"), F.when(bad.isNull(), file_links(F.col("body"))).alias("links")))
    good = md.where("bad IS NULL")
    issues = md.where("bad IS NOT NULL").select(F.lit("error").alias("severity"), "path", F.col("bad").alias("message"))
    issues = issues.unionByName(field_issues(good, strict, profile)).unionByName(broken_links(resolved_links(good), pages))
    return issues.orderBy("path", "severity", "message")


def issue_counts(issues: DataFrame, strict: bool = False) -> DataFrame:
    from .guards import exit_code

    n = issues.agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    return n.withColumn("exit_code", exit_code(F.col("errors"), F.col("warnings"), F.lit(strict)))


def diff_bytes(prod: DataFrame, staging: DataFrame) -> DataFrame:
    """One row: bytes of new pages plus size differences of others (an equal size costs nothing)."""
    old = prod.select("path", F.octet_length("content").alias("old"))
    both = staging.where(F.endswith("path", F.lit(".md"))).select("path", F.octet_length("content").alias("new")).join(old, "path", "left")
    return both.agg(F.coalesce(F.sum(F.when(F.col("old").isNull(), F.col("new")).otherwise(F.abs(F.col("new") - F.col("old")))), F.lit(0)).cast("long").alias("bytes"))


def staging_violations(prod: DataFrame, staging: DataFrame, budget: int = 1 << 20, allow_delete: bool = False, allow_archive: bool = False) -> DataFrame:
    """``path, message`` for what keeps a staged page tree from replacing the production one.

    Archived pages break the taxonomy unless ``allow_archive``.
    """
    path = F.col("path")
    rows = staging.where(~F.startswith("path", F.lit(".meta/")))
    ok = valid_page_path(path) | (F.startswith(path, F.lit("archive/")) if allow_archive else F.lit(False))
    md = F.endswith(path, F.lit(".md"))
    rules = F.filter(
        F.array(
            F.when(~md, "non-Markdown file in wiki (only .md files are allowed)"),
            F.when(md & ~ok, "path does not conform to wiki taxonomy (semantic/, episodic/, procedural/, prospective/)"),
            F.when(md & ~structural_index(path) & ~has_frontmatter_comments(F.col("content")), "missing required frontmatter (compiled_from, last_compiled)"),
        ),
        lambda x: x.isNotNull(),
    )
    out = rows.select("path", F.explode(rules).alias("message"))
    spent = diff_bytes(prod, rows).where(F.col("bytes") > budget)
    out = out.unionByName(spent.select(F.lit("").alias("path"), F.format_string(f"diff budget exceeded: %d bytes > {budget} bytes max", "bytes").alias("message")))
    if not allow_delete:
        gone = prod.where(F.endswith("path", F.lit(".md"))).select("path").join(staging.select("path"), "path", "left_anti")
        out = out.unionByName(gone.withColumn("message", F.lit("page deleted in staging (ingest should not delete pages)")))
    return out
