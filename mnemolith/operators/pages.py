"""Knowledge pages with their telemetry: search, statistics, index, upsert, archive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.paths import MEMORY_TYPES, base_name, memory_type, walk_order
from ..functions.text import first_prose_line, lower_runes
from ..sources.tables import materialize
from .parts import PART_BYTES, text_parts


def search_lines(pages: DataFrame, query: str) -> DataFrame:
    """``path, line, content`` of every line that holds the query literally, whatever the case."""
    lines = pages.select("path", F.posexplode(F.split("content", "\n")).alias("pos", "content"))
    hit = F.contains(lower_runes(F.col("content")), lower_runes(F.lit(query)))
    return lines.where(hit).select("path", (F.col("pos") + 1).alias("line"), "content")


def memory_stats(pages: DataFrame, events: DataFrame, cursor: int) -> DataFrame:
    """One row of counts; the root index isn't a page, category indexes are; ``uncompiled`` may be
    negative."""
    n = pages.where("path LIKE '%.md' AND path <> 'index.md'").agg(
        F.count_if(~F.startswith("path", F.lit("archive/")) & ~F.startswith("path", F.lit(".meta/"))).alias("pages"), F.count_if(F.startswith("path", F.lit("archive/"))).alias("archived")
    )
    e = events.agg(F.count("*").alias("events"))
    joined = n.withColumn("k", F.lit(1)).join(e.withColumn("k", F.lit(1)), "k")
    return joined.select("events", (F.col("events") - cursor).alias("uncompiled"), "pages", "archived")


def category_index(pages: DataFrame) -> DataFrame:
    """``path, content`` of the four category indexes and the root index, entries in walk order.

    Entry lists are sorted inside the aggregation; an index is one text, so its size is bounded by
    what a page may hold.
    """
    cat = memory_type(F.col("path"))
    own = pages.where((cat != "") & F.endswith("path", F.lit(".md"))).withColumn("cat", cat).where(F.col("path") != F.concat("cat", F.lit("/index.md")))
    desc = first_prose_line(F.col("content"), 100, F.lit(""))
    entry = lambda link: F.format_string("- [%s](%s) — %s", base_name(F.col("path")), link, desc)
    inside = F.expr("substring(path, length(cat) + 2)")
    rows = own.select("cat", F.struct(walk_order(F.col("path")).alias("k"), entry(F.col("path")).alias("root"), entry(inside).alias("cat")).alias("e"))
    lists = rows.groupBy("cat").agg(F.array_sort(F.collect_list("e")).alias("e"))
    dim = pages.sparkSession.createDataFrame([(i, t) for i, t in enumerate(MEMORY_TYPES)], "pos int, cat string")
    all_ = dim.join(lists, "cat", "left").withColumn("e", F.coalesce("e", F.array().cast(lists.schema["e"].dataType)))
    joined = lambda f: F.array_join(F.transform("e", lambda x: x[f]), "\n")
    none = "_No pages yet._\n"
    title = F.concat(F.lit("# "), F.initcap("cat"), F.lit("\n\n"))
    cats = all_.select(F.concat("cat", F.lit("/index.md")).alias("path"), F.concat(title, F.when(F.size("e") == 0, none).otherwise(F.concat(joined("cat"), F.lit("\n")))).alias("content"))
    section = F.struct("pos", F.concat(F.lit("## "), "cat", F.lit("\n\n"), joined("root")).alias("s"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.size("e") > 0, section))), lambda x: x["s"]), "\n\n")
    root = all_.agg(body.alias("b")).select(F.lit("index.md").alias("path"), F.concat(F.lit("# Wiki Index\n\n"), F.when(F.col("b") == "", none).otherwise(F.concat("b", F.lit("\n")))).alias("content"))
    return cats.unionByName(root)


def category_index_parts(pages: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """The texts of ``category_index`` as numbered parts of whole lines, for categories of any size: entries are
    sorted rows and never gathered into lists."""
    cat = memory_type(F.col("path"))
    own = pages.where((cat != "") & F.endswith("path", F.lit(".md"))).withColumn("cat", cat).where(F.col("path") != F.concat("cat", F.lit("/index.md")))
    own = own.select("path", "cat", first_prose_line(F.col("content"), 100, F.lit("")).alias("desc"))  # once, for both indexes
    entry = lambda link: F.format_string("- [%s](%s) — %s\n", base_name(F.col("path")), link, F.col("desc"))
    dim = pages.sparkSession.createDataFrame([(i, t) for i, t in enumerate(MEMORY_TYPES)], "pos int, cat string")
    filled = own.groupBy("cat").agg(F.count("*").alias("n")).where("n > 0")
    dim = materialize(dim.join(filled, "cat", "left").withColumn("first", F.min(F.when(F.col("n") > 0, F.col("pos"))).over(Window.partitionBy())))  # a row a category
    # Section 0 is a text's head; in the root index 2 pos + 1 is a category's head and 2 pos + 2 its entries.
    section = F.col("pos") * 2 + 1
    top = F.array().cast("array<string>")
    row = lambda path, section, key, text: F.struct(path.alias("path"), section.cast("int").alias("section"), key.alias("key"), text.alias("text"))
    home, root, none = F.concat("cat", F.lit("/index.md")), F.lit("index.md"), F.lit("_No pages yet._\n")
    entries = own.join(F.broadcast(dim), "cat").select(
        F.explode(F.array(row(home, section + 1, walk_order(F.col("path")), entry(F.expr("substring(path, length(cat) + 2)"))), row(root, section + 1, walk_order(F.col("path")), entry(F.col("path"))))).alias("r")
    )
    title = F.concat(F.lit("# "), F.initcap("cat"), F.lit("\n\n"), F.when(F.col("n").isNull(), none).otherwise(""))
    head = F.when(F.col("n") > 0, F.concat(F.when(F.col("pos") > F.col("first"), "\n").otherwise(""), F.lit("## "), "cat", F.lit("\n\n")))
    heads = dim.select(F.explode(F.array(row(home, F.lit(0), top, title), row(root, section, top, head))).alias("r"))
    start = dim.where("pos = 0").select(row(root, F.lit(0), top, F.concat(F.lit("# Wiki Index\n\n"), F.when(F.col("first").isNull(), none).otherwise(""))).alias("r"))
    texts = entries.unionByName(heads).unionByName(start).select("r.*").where("text <> ''")
    split = F.split(F.expr("substring(text, 1, length(text) - 1)"), "\n")
    lines = texts.select("path", "section", "key", F.posexplode(split).alias("line_no", "line")).withColumn("text", F.concat("line", F.lit("\n")))
    return text_parts(lines, "section", "key", "line_no", part_bytes=part_bytes)


def walk_ranks(pages: DataFrame) -> DataFrame:
    """``path, rank`` of every page in walk order, from 1. Ranks count on from one sorted range to the
    next, so no task sees all pages."""
    ordered = pages.select("path", walk_order(F.col("path")).alias("k")).orderBy("k")
    ordered = materialize(ordered.select("path", F.monotonically_increasing_id().alias("i")))
    part, place = F.shiftright("i", 33), F.col("i").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = ordered.groupBy(part.alias("part")).agg(F.count("*").alias("c"))  # a row a range
    before = sizes.select("part", (F.sum("c").over(Window.orderBy("part")) - F.col("c")).alias("before"))
    return ordered.select("path", part.alias("part"), place.alias("place")).join(F.broadcast(before), "part").select("path", (F.col("before") + F.col("place") + 1).alias("rank"))


def upsert_pages(pages: DataFrame, writes: DataFrame) -> DataFrame:
    """Pages after a set of ordered writes (path, content, sources, trust_tier, at, write_no).

    The last write's content counts; sources are united in first-seen order; trust is the smallest
    positive tier; creation time and memory type are those of the first write.
    """
    old = pages.select("path", "content", "source_events", "trust_tier_max", "created_at", "memory_type", F.lit(-1).cast("long").alias("n"))
    new = writes.select("path", "content", F.col("sources").alias("source_events"), F.col("trust_tier").alias("trust_tier_max"), F.col("at").alias("created_at"), memory_type(F.col("path")).alias("memory_type"), F.col("write_no").cast("long").alias("n"))
    both = old.unionByName(new)
    listed = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("n", "source_events"))), lambda x: x["source_events"]))
    return both.groupBy("path").agg(
        F.max_by("content", "n").alias("content"),
        F.array_distinct(listed).alias("source_events"),
        F.coalesce(F.min(F.nullif("trust_tier_max", F.lit(0))), F.lit(0)).alias("trust_tier_max"),
        F.min_by("created_at", "n").alias("created_at"),
        F.min_by("memory_type", "n").alias("memory_type"),
    )


def archive_pages(pages: DataFrame, moves: DataFrame) -> DataFrame:
    """Pages after moving those in ``moves`` (path, reason, at) below archive/; an older copy there
    is replaced."""
    moved = pages.drop("archived_at", "archive_reason").join(moves.select("path", F.col("at").alias("archived_at"), F.col("reason").alias("archive_reason")), "path")
    moved = moved.withColumn("path", F.concat(F.lit("archive/"), "path"))
    rest = pages.join(moves.select("path"), "path", "left_anti").join(moved.select("path"), "path", "left_anti")
    return rest.unionByName(moved, allowMissingColumns=True)


def access_dates(reads: DataFrame) -> DataFrame:
    """``path, last_accessed, access_dates``: a date is added unless it equals the last one."""
    w = Window.partitionBy("path").orderBy("at", "read_no")
    day = F.date_format("at", "yyyy-MM-dd")
    rows = reads.withColumn("day", day).withColumn("new", F.coalesce(F.lag("day").over(w) != F.col("day"), F.lit(True)))
    listed = F.transform(F.array_sort(F.collect_list(F.when(F.col("new"), F.struct("at", "read_no", "day")))), lambda x: x["day"])
    return rows.groupBy("path").agg(F.date_format(F.max("at"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("last_accessed"), listed.alias("access_dates"))


def with_telemetry(pages: DataFrame, meta: DataFrame) -> DataFrame:
    """Pages with their sidecar; a missing one is empty."""
    return pages.join(meta, "path", "left").select("path", "content", F.coalesce("source_events", F.array().cast("array<string>")).alias("source_events"), F.coalesce("trust_tier_max", F.lit(0)).alias("trust_tier_max"))


def with_provenance(content: Column, sources: Column, now: Column) -> Column:
    """Content with the missing ones of the two header comments in front; without sources: ingest."""
    named = F.when(F.size(sources) > 0, F.array_join(sources, ", ")).otherwise("ingest")
    lines = [
        F.when(~F.contains(content, F.lit("<!-- compiled_from:")), F.concat(F.lit("<!-- compiled_from: "), named, F.lit(" -->\n"))).otherwise(""),
        F.when(~F.contains(content, F.lit("<!-- last_compiled:")), F.concat(F.lit("<!-- last_compiled: "), now, F.lit(" -->\n"))).otherwise(""),
    ]
    return F.concat(*lines, content)
