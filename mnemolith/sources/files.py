"""Reading and writing the on-disk forms: JSON lines, Markdown trees, versions of a page tree."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .appendlog import AppendLog, create_if_absent, qualified, read_text, write_text
from .tables import Scratch, materialize

EVENT_FIELDS = ("id", "timestamp", "actor", "content", "source", "session_id", "active_project", "active_task", "context_json", "durability", "actionability", "source_type", "evidence_kind")
EVENT_SCHEMA = T.StructType([*(T.StructField(n, T.StringType()) for n in EVENT_FIELDS), T.StructField("trust_tier", T.IntegerType())])
STATUS_FIELDS = ("type", "event_id", "status", "batch_id", "reason", "timestamp", "old_status", "operator", "epoch")
STATUS_SCHEMA = T.StructType([*(T.StructField(n, T.StringType()) for n in STATUS_FIELDS), T.StructField("pages", T.ArrayType(T.StringType())), T.StructField("recovered", T.BooleanType())])


def old_paths(spark: SparkSession, path: str) -> list[str]:
    """What lies at a log's path besides appended folders: the file itself, or the files and folders in it."""
    files, root = qualified(spark, path)
    if not files.exists(root):
        return []
    if not files.getFileStatus(root).isDirectory():
        return [root.toString()]
    names = [s.getPath().getName() for s in files.listStatus(root)]
    return [f"{root.toString()}/{n}" for n in sorted(names) if not n.startswith(("rows-", "_", "."))]


def numbered_lines(spark: SparkSession, path: str | list[str], valid: Column | None = None) -> DataFrame:
    """``file, line_no, value`` of the lines of files beside each other, in name order, then of ``append-<number>``
    folders in theirs; only ``valid`` ones take numbers. Lines are numbered within the
    splits that Spark reads and the splits' counts are added up, so no task holds more than a split."""
    lines = spark.read.option("recursiveFileLookup", True).option("lineSep", "\n").text(path)
    lines = lines.select("value", F.input_file_name().alias("file"), F.input_file_block_start().alias("start"), F.monotonically_increasing_id().alias("at"))
    if valid is not None:
        lines = lines.where(valid)
    appended = F.regexp_extract("file", r"/(append-\d{20}/[^/]*)$", 1)
    lines = lines.withColumn("place", F.struct(appended, "file", "start"))
    lines = lines.withColumn("n", F.row_number().over(Window.partitionBy("place").orderBy("at")))
    counts = lines.groupBy("place").agg(F.count("*").alias("c"))
    before = counts.withColumn("before", F.sum("c").over(Window.orderBy("place")) - F.col("c")).drop("c")  # a row a split
    return lines.join(before, "place").select("file", (F.col("before") + F.col("n") - 1).alias("line_no"), "value")


def valid_json(schema: T.StructType) -> Column:
    return F.col("value").rlike(r"^[\t\n\r ]*\{") & F.try_parse_json("value").isNotNull() & F.from_json("value", schema).isNotNull()


def json_log(spark: SparkSession, path: str, schema: T.StructType) -> AppendLog:
    """The log at ``path``; of lines there before the first append, valid ones count."""

    def before() -> int:
        old = old_paths(spark, path)
        return spark.read.option("recursiveFileLookup", True).option("lineSep", "\n").text(old).where(valid_json(schema)).count() if old else 0

    return AppendLog(spark, path, before)


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType, ordinal: str = "seq", since: int = 0) -> DataFrame:
    """Valid lines of JSON-lines logs with their ordinal over valid lines, from ``since`` on. Malformed lines are left
    out and take no ordinal. Appended folders that end before ``since`` aren't opened, nor are older files
    if those do."""
    log, old = json_log(spark, path, schema), old_paths(spark, path)
    if not old or (since and since >= log.start()):
        return log.read(schema, since, ordinal)
    lines = numbered_lines(spark, old, valid_json(schema)).withColumn("r", F.from_json("value", schema)).select(F.col("line_no").alias(ordinal), "r.*")
    lines = lines.where(F.col(ordinal) >= since) if since else lines
    return lines.unionByName(log.read(schema, since, ordinal)) if log.entries(since) else lines


def read_events(spark: SparkSession, path: str, since: int = 0) -> DataFrame:
    return read_json_lines(spark, path, EVENT_SCHEMA, since=since)


def unclosed_files(spark: SparkSession, paths: list[str]) -> list[str]:
    """Files that don't end with a line end; their last bytes are read, not their lines."""
    out = []
    for path in paths:
        files, root = qualified(spark, path)
        found = files.listFiles(root, True)
        while found.hasNext():
            f = found.next()
            if f.getLen() and not f.getPath().getName().startswith(("_", ".")):
                stream = files.open(f.getPath())
                try:
                    stream.seek(f.getLen() - 1)
                    if stream.read() != 10:
                        out.append(f.getPath().toUri().toString())
                finally:
                    stream.close()
    return out


def read_status_log(spark: SparkSession, path: str) -> DataFrame:
    """Status records with ``line_no`` over all lines; ``terminated`` is false for a file's last line
    without a line end, which doesn't count. Appended records always end; only older files are looked at."""
    entries = status_log(spark, path)
    appended = entries.read(STATUS_SCHEMA, ordinal="line_no").withColumn("terminated", F.lit(True))
    old = old_paths(spark, path)
    if not old:
        return appended
    rows = numbered_lines(spark, old)
    same = F.regexp_replace("file", "^file:/+", "file:/")
    loose = [u.replace("file:///", "file:/") for u in unclosed_files(spark, old)]
    ends = rows.where(same.isin(loose)).groupBy("file").agg(F.max("line_no").alias("line_no"))
    rows = rows.join(ends.select("line_no", F.lit(False).alias("terminated")), "line_no", "left").withColumn("r", F.from_json("value", STATUS_SCHEMA))
    return rows.select("line_no", "r.*", F.coalesce("terminated", F.lit(True)).alias("terminated")).unionByName(appended)


def status_log(spark: SparkSession, path: str) -> AppendLog:
    """The status log at ``path``; all lines there before the first append count."""

    def before() -> int:
        old = old_paths(spark, path)
        return spark.read.option("recursiveFileLookup", True).option("lineSep", "\n").text(old).count() if old else 0

    return AppendLog(spark, path, before)


def event_ids(now: Column, entropy: Column) -> Column:
    """``evt_<UTC date>_<time>_<4 hex digits>``; only 65,536 values a second, not checked for clashes."""
    return F.concat(F.lit("evt_"), F.date_format(now, "yyyyMMdd_HHmmss"), F.lit("_"), F.substring(F.sha2(entropy.cast("string"), 256), 1, 4))


def append_events(events: DataFrame, path: str) -> DataFrame:
    """Append events as JSON lines after all others, whoever else appends; empty ids and times are filled."""
    now = F.current_timestamp()
    ident = event_ids(now, F.concat(F.expr("uuid()"), F.col("content")))
    fill = lambda c, x: F.coalesce(F.nullif(F.col(c), F.lit("")), x) if c in events.columns else x
    rows = events.withColumn("id", fill("id", ident)).withColumn("timestamp", fill("timestamp", F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss'Z'")))
    return events.sparkSession.read.schema(rows.schema).json(json_log(events.sparkSession, path, EVENT_SCHEMA).append(rows))


def read_markdown(spark: SparkSession, root: str, validation_rules: bool = True) -> DataFrame:
    """``path, content, mtime`` of the files below root. Under validation rules only ``.md`` files
    outside dot directories count; the store's own walk leaves out ``.meta`` alone."""
    base = qualified(spark, root)[1].toString()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
    rel = F.substr("path", F.lit(len(base.rstrip("/")) + 2))
    rows = files.select(rel.alias("path"), F.col("content").cast("string").alias("content"), F.col("modificationTime").alias("mtime"))
    if validation_rules:
        return rows.where(F.endswith("path", F.lit(".md")) & ~F.col("path").rlike(r"(^|/)\.[^/]*/"))
    return rows.where(F.endswith("path", F.lit(".md")) & ~F.startswith("path", F.lit(".meta/")))


def read_sources(spark: SparkSession, root: str, suffix: str = ".go") -> DataFrame:
    """``path, content`` of the source files below root outside dot directories; paths are relative to root."""
    base = qualified(spark, root)[1].toString()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").load(base)
    rows = files.select(F.substr("path", F.lit(len(base.rstrip("/")) + 2)).alias("path"), F.col("content").cast("string").alias("content"))
    return rows.where(~F.col("path").rlike(r"(^|/)\.[^/]*/"))


def checkout(spark: SparkSession, root: str) -> tuple[str, str]:
    """(commit, address of the remote ``origin``) of a working tree, read from its ``.git`` folder; empty where there is none."""

    def text(name: str) -> str:
        files, path = qualified(spark, f"{root.rstrip('/')}/.git/{name}")
        return read_text(spark, path.toString()) if files.exists(path) and not files.getFileStatus(path).isDirectory() else ""

    head = text("HEAD").strip()
    ref = head.removeprefix("ref:").strip() if head.startswith("ref:") else ""
    packed = (line.split() for line in text("packed-refs").splitlines() if ref)
    commit = (text(ref).strip() or next((x[0] for x in packed if x[1:] == [ref]), "")) if ref else head
    origin = re.search(r'(?m)^\s*\[remote "origin"\]\s*$(?:\n(?!\s*\[).*)*?\n\s*url\s*=\s*(.*)', text("config"))
    return commit, origin[1].strip() if origin else ""


class StaleBase(RuntimeError):
    """The pages changed after the version that a change was made from."""


class PageVersions:
    """Versions of a page tree. A version is a numbered file that says which folder holds each bucket of paths.

    A change writes new folders for the buckets of the paths it touches and then claims the next number by creating
    its file only if it is absent. Who comes second starts from the new version: if that left its buckets alone,
    what it wrote stays as it is, else the change is made again. So no update is lost, a write costs its
    buckets and not the tree, and a reader sees one version whole. Earlier versions are the backup.
    """

    def __init__(self, spark: SparkSession, root: str, read_only: bool = False, buckets: int = 64):
        self.spark, self.root, self.read_only, self.buckets = spark, root.rstrip("/"), read_only, buckets

    def current(self) -> str | None:
        """Path of the newest version's file."""
        files, folder = qualified(self.spark, f"{self.root}/versions")
        names = [s.getPath().getName() for s in files.listStatus(folder)] if files.exists(folder) else []
        done = [n for n in names if n.isdigit()]
        return f"{self.root}/versions/{max(done)}" if done else None

    def _version(self, at: str | None) -> dict:
        return json.loads(read_text(self.spark, at)) if at else {"count": self.buckets, "buckets": {}, "schema": None}

    def _read(self, version: dict, only: list[int] | None = None) -> DataFrame | None:
        if version["schema"] is None:
            return None
        schema = T.StructType.fromJson(version["schema"])
        folders = [f"{self.root}/{f}" for b, f in sorted(version["buckets"].items()) if only is None or int(b) in only]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def read(self, at: str | None = None) -> DataFrame | None:
        """The pages of a version, by default the newest; None before the first."""
        return self._read(self._version(at or self.current()))

    def _bucket(self, count: int) -> Column:
        return F.pmod(F.xxhash64("path"), F.lit(count)).cast("int")

    def update(self, touched: DataFrame | None, build: Callable[[DataFrame | None], DataFrame], base: str | None = None, from_base: bool = False) -> str:
        """The next version: ``build`` gets the pages of all buckets that hold a path of ``touched`` (without it: all) and
        returns what those buckets are to hold. With ``from_base`` the change is refused if ``base`` isn't the newest
        version any more."""
        if self.read_only:
            raise PermissionError("the bundle is read-only")
        made = None
        while True:
            at = self.current()
            if from_base and at != base:
                raise StaleBase(f"{at} came after {base}")
            version = self._version(at)
            count = version["count"]
            only = None if touched is None else [r[0] for r in touched.select(self._bucket(count)).distinct().collect()]  # at most ``count``
            mine = [str(b) for b in (range(count) if only is None else only)]
            seen = [version["buckets"].get(b) for b in mine]
            if made is None or seen != made[0]:
                rows = build(self._read(version, only))
                folder = f"data/{uuid.uuid4().hex}"
                rows.withColumn("_bucket", self._bucket(count)).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.root}/{folder}")
                files, p = qualified(self.spark, f"{self.root}/{folder}")
                wrote = [s.getPath().getName() for s in files.listStatus(p)]
                made = (seen, {n.removeprefix("_bucket="): f"{folder}/{n}" for n in wrote if n.startswith("_bucket=")}, rows.schema)
                if set(made[1]) - set(mine):
                    raise ValueError("a change of paths that it doesn't name")
            left = {b: f for b, f in version["buckets"].items() if b not in mine}
            number = int(at.rsplit("/", 1)[1]) + 1 if at else 0
            target = f"{self.root}/versions/{number:012d}"
            if create_if_absent(self.spark, target, json.dumps({"count": count, "buckets": left | made[1], "schema": made[2].jsonValue()})):
                return target

    def swap(self, pages: DataFrame) -> str:
        """The next version holds these pages and no others."""
        return self.update(None, lambda _: pages)


def write_markdown(pages: DataFrame, root: str, backup: bool = False) -> DataFrame:
    """Write pages (path, content) as files below root, each by the task that has its row; returns ``path, bytes``.

    The rows are written to the shared folder first, so pages may come from the very files they replace, and a task
    that runs again writes the same. A file is a draft beside its place that is moved there when whole. With
    ``backup`` a file that is replaced is kept as ``<path>.bak``; where one is there already, nothing is written at all.
    Paths that leave the root, null ones and repeated ones are refused. Null content is an empty file. The root's scheme must be one that
    pyarrow opens (file, hdfs, s3, gs).
    """
    spark = pages.sparkSession
    base = qualified(spark, root)[1].toString().rstrip("/")
    base = "file://" + base.removeprefix("file:") if base.startswith("file:/") and not base.startswith("file://") else base
    with Scratch(spark) as tables:
        rows = materialize(pages.select("path", F.coalesce("content", F.lit("")).alias("content")))
        outside = F.col("path").isNull() | F.col("path").rlike(r"^/|^$|/$|//|(^|/)\.{1,2}(/|$)|[\x{0}\\]")
        bad = rows.where(outside).select("path").limit(1).collect() or rows.groupBy("path").count().where("count > 1").limit(1).collect()
        if bad:
            raise ValueError(f"refused path {bad[0]['path']!r}")
        if backup and qualified(spark, root)[0].exists(qualified(spark, root)[1]):
            kept = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.bak").load(base).select("path")
            names = kept.select(F.regexp_replace("path", "^file:/+", "file:///").alias("full"))
            there = rows.select("path", F.concat(F.lit(base + "/"), "path", F.lit(".bak")).alias("full")).join(names, "full").limit(1).collect()
            if there:
                raise FileExistsError(f"{there[0]['path']}: backup already exists")

        def write(frames):
            import posixpath

            import pandas as pd
            from pyarrow import fs

            files, top = fs.FileSystem.from_uri(base)
            for f in frames:
                sizes = []
                for path, content in zip(f["path"], f["content"], strict=True):
                    target = f"{top}/{path}"
                    folder, name = posixpath.split(target)
                    files.create_dir(folder, recursive=True)
                    draft = f"{folder}/.{name}.{uuid.uuid4().hex}.tmp"
                    try:
                        old, bak = files.get_file_info([target, f"{target}.bak"])
                        if backup and old.type == fs.FileType.File and bak.type == fs.FileType.NotFound:
                            files.copy_file(target, draft)
                            files.move(draft, f"{target}.bak")
                        data = content.encode()
                        with files.open_output_stream(draft) as out:
                            out.write(data)
                        files.move(draft, target)
                    finally:
                        if files.get_file_info(draft).type != fs.FileType.NotFound:
                            files.delete_file(draft)
                    sizes.append(len(data))
                yield pd.DataFrame({"path": f["path"], "bytes": sizes})

        return tables.keep(rows.mapInPandas(write, "path string, bytes long"))


def write_facts(facts: DataFrame, snippets: DataFrame, path: str) -> None:
    """A fact bundle as JSON lines in their order, and last its ``manifest.json``: a bundle without one isn't whole."""
    spark = facts.sparkSession
    facts.drop("content").orderBy("path", "line", "kind", "symbol").write.mode("overwrite").json(f"{path}/facts")
    snippets.orderBy("path", "start_line", "kind", "symbol").write.mode("overwrite").json(f"{path}/snippets")
    counts = {name: spark.read.text(f"{path}/{name}").count() for name in ("facts", "snippets")}
    write_text(spark, f"{path}/manifest.json", json.dumps(counts))


def append_statuses(records: DataFrame, path: str) -> None:
    """Append status records as JSON lines; one invalid record keeps all of them out."""
    from ..operators.log import valid_status

    bad = records.where(~F.coalesce(valid_status(), F.lit(False))).limit(1).collect()
    if bad:
        raise ValueError(f"invalid status record for event {bad[0]['event_id']!r}")
    stamped = records.withColumn("timestamp", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")) if "timestamp" not in records.columns else records
    status_log(records.sparkSession, path).append(stamped)


def write_bootstrap(events: DataFrame, epoch: str, path: str) -> None:
    """Start a status log: its header and the events before the epoch; refused where a log exists."""
    from ..operators.log import bootstrap_records

    bootstrap_records(events, epoch).write.mode("errorifexists").json(path)


def append_progress(results: DataFrame, path: str) -> None:
    """One JSON line a batch at the end of the progress log."""
    from ..operators.surface import progress_lines

    AppendLog(results.sparkSession, path).append(progress_lines(results), "text")
