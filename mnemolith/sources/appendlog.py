"""Logs that grow by folders, with a manifest of what was appended.

Below a log's folder, ``rows-<id>`` folders hold appended rows as JSON lines and ``_log`` holds one entry a
folder, numbered from 0 without gaps: its folder, the ordinal of its first row, its rows, and where each of its
partitions begins. An append writes its rows first, which nobody reads yet, and then claims the next number by
creating that entry only if it is absent; who comes second reads the new end and tries the next number. So any
number of writers may append at once, ordinals have no gaps and never change, and an append that dies leaves
nothing that a reader sees.

A row carries its place in the append (``_at``). Reads by ordinal go back from the newest entry and open only the
folders that reach past it; no row is numbered anew and nothing is shuffled. Lines that were there before the
first append (files beside the folders) come first; they are counted once, by the first append, and later ones
there don't count.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import BROADCAST_BYTES

#: Entries that a reader opens one by one before it has Spark read the rest.
ONE_BY_ONE = 64
#: What a line of a read's (folder, partition) table takes at most in a broadcast.
PLACE_BYTES = 160


def qualified(spark: SparkSession, path: str):
    """(file system, path) of the JVM for a path."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return files, files.makeQualified(p)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    files, p = qualified(spark, path)
    out = files.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    files, p = qualified(spark, path)
    size = files.getFileStatus(p).getLen()
    stream = files.open(p)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, size)).decode()
    finally:
        stream.close()


def create_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """A file with this content, unless there is one: whole or not at all, and for one of several writers only.

    A local disk has hard links for that; elsewhere the file system's rename that doesn't replace, which is atomic on HDFS.
    """
    files, target = qualified(spark, path)
    draft = f"{target.getParent().toString()}/.draft-{uuid.uuid4().hex}"
    write_text(spark, draft, text)
    try:
        if target.toUri().getScheme() == "file":
            try:
                os.link(qualified(spark, draft)[1].toUri().getPath(), target.toUri().getPath())
            except FileExistsError:
                return False
            return True
        jvm = spark.sparkContext._jvm
        kind = jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
        try:
            context.rename(qualified(spark, draft)[1], target, jvm.java.lang.reflect.Array.newInstance(kind, 0))
        except Exception:
            if files.exists(target):
                return False
            raise
        return True
    finally:
        files.delete(qualified(spark, draft)[1], False)


class AppendLog:
    """One log. ``before`` counts the lines that were there before the first append."""

    def __init__(self, spark: SparkSession, path: str, before: Callable[[], int] = lambda: 0):
        self.spark, self.before = spark, before
        self.root = qualified(spark, path)[1].toString()

    def _numbers(self) -> list[int]:
        files, folder = qualified(self.spark, f"{self.root}/_log")
        names = [s.getPath().getName() for s in files.listStatus(folder)] if files.exists(folder) else []
        return sorted(int(n) for n in names if n.isdigit())

    def _entry(self, number: int) -> dict:
        return json.loads(read_text(self.spark, f"{self.root}/_log/{number:020d}"))

    def _last(self) -> tuple[int, int]:
        """Number of the newest entry, -1 without any, and the ordinal that comes next."""
        numbers = self._numbers()
        if not numbers:
            return -1, self.before()
        last = self._entry(numbers[-1])
        return numbers[-1], last["first"] + last["count"]

    def length(self) -> int:
        """Rows of the log: from the newest entry alone, where there is one."""
        return self._last()[1]

    def start(self) -> int:
        """The ordinal of the first appended row: how many lines were there before."""
        numbers = self._numbers()
        return self._entry(numbers[0])["first"] if numbers else self.before()

    def append(self, rows: DataFrame, kind: str = "json") -> str:
        """Add rows in their order; returns their folder. Text rows carry no place."""
        folder = f"rows-{uuid.uuid4().hex}"
        target = f"{self.root}/{folder}"
        placed = rows if kind == "text" else rows.withColumn("_at", F.monotonically_increasing_id())
        getattr(placed.write.option("ignoreNullFields", True).option("maxRecordsPerFile", 1_000_000), kind)(target)
        if kind == "text":
            parts, count = [], self.spark.read.text(target).count()
        else:
            sizes = self.spark.read.schema("_at long").json(target).groupBy(F.shiftright("_at", 33).alias("part")).count().orderBy("part").collect()  # a row a task
            parts, count = [], 0
            for r in sizes:
                parts.append([r["part"], count])
                count += r["count"]
        while True:
            number, end = self._last()
            entry = {"folder": folder, "first": end, "count": count, "parts": parts}
            if create_if_absent(self.spark, f"{self.root}/_log/{number + 1:020d}", json.dumps(entry)):
                return target

    def entries(self, since: int = 0) -> list[dict]:
        """The entries with rows at ``since`` or past it, oldest first, from the newest back."""
        out: list[dict] = []
        numbers = self._numbers()
        while numbers:
            if len(out) >= ONE_BY_ONE:
                paths = [f"{self.root}/_log/{n:020d}" for n in numbers]
                rest = self.spark.read.schema("folder string, first long, count long, parts array<array<long>>").json(paths)
                rows = rest.where(F.col("first") + F.col("count") > since).orderBy(F.desc("first"), F.desc("count")).collect()
                return [r.asDict() for r in reversed(rows)] + out[::-1]
            entry = self._entry(numbers.pop())
            if entry["first"] + entry["count"] > since:
                out.append(entry)
            if entry["first"] <= since:
                break
        return out[::-1]

    def read(self, schema: T.StructType, since: int = 0, ordinal: str = "seq") -> DataFrame:
        """Appended rows at ``since`` or past it, with their ordinal."""
        entries = [e for e in self.entries(since) if e["count"]]
        full = T.StructType([*schema.fields, T.StructField("_at", T.LongType())])
        if not entries:
            return self.spark.createDataFrame([], full).select(F.lit(0).cast("long").alias(ordinal), *schema.names)
        places = [(e["folder"], part, e["first"] + start) for e in entries for part, start in e["parts"]]
        starts = self.spark.createDataFrame(places, "folder string, part long, start long")
        if len(places) * PLACE_BYTES <= BROADCAST_BYTES:
            starts = F.broadcast(starts)
        rows = self.spark.read.schema(full).json([f"{self.root}/{e['folder']}" for e in entries])
        folder = F.regexp_extract(F.col("_metadata.file_path"), r"/(rows-[0-9a-f]{32})/[^/]*$", 1)
        rows = rows.select("*", folder.alias("folder"), F.shiftright("_at", 33).alias("part")).join(starts, ["folder", "part"])
        rows = rows.withColumn(ordinal, F.col("start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
        return rows.where(F.col(ordinal) >= since).select(ordinal, *schema.names)
