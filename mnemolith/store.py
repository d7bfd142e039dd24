"""The memory store: the data interface in one place, returning DataFrames."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions.paths import memory_type
from .operators import lint, log, pages
from .sources.appendlog import qualified
from .sources.files import EVENT_SCHEMA, PageVersions, append_events, json_log, read_events
from .sources.lease import Lease
from .sources.tables import Scratch, materialize

META = "source_events array<string>, trust_tier_max int, created_at string, memory_type string, archived_at string, archive_reason string"
#: ``gone`` ends what was read of a path before: it was moved away.
READS = "path string, at timestamp, read_no long, gone boolean"


class MemoryStore:
    """Event log, versioned pages and the compile cursor below one folder.

    ``read_only`` opens a bundle: every write is refused.
    """

    def __init__(self, spark: SparkSession, root: str, read_only: bool = False):
        self.spark, self.root, self.read_only = spark, root.rstrip("/"), read_only
        self.compile_error: Exception | None = None
        self.tree = PageVersions(spark, f"{self.root}/wiki", read_only)

    def _writable(self) -> None:
        if self.read_only:
            raise PermissionError("the bundle is read-only")

    def _exists(self, name: str) -> bool:
        files, path = qualified(self.spark, f"{self.root}/{name}")
        return files.exists(path)

    def append_event(self, events: DataFrame) -> DataFrame:
        self._writable()
        return append_events(events, f"{self.root}/raw")

    def events(self, since: int = 0) -> DataFrame:
        """Events from an ordinal on; folders that end before it aren't opened."""
        return read_events(self.spark, f"{self.root}/raw", since)

    def event_count(self) -> int:
        """From the log's newest manifest entry, without a scan."""
        return json_log(self.spark, f"{self.root}/raw", EVENT_SCHEMA).length()

    def read_events_since(self, cursor: int) -> tuple[DataFrame, int]:
        """Events past the cursor and the next one: the log's length, taken first, so that events which others append
        meanwhile are left to the next read."""
        end = self.event_count()
        return log.events_since(self.events(cursor), cursor).where(F.col("seq") < end), end

    def read_recent_events(self, n: int) -> DataFrame:
        return log.recent_events(self.events(max(0, self.event_count() - max(n, 0))), n).orderBy("seq")

    def pages(self, version: str | None = None) -> DataFrame:
        """The pages of a version, by default the newest, with their sidecars."""
        none = self.spark.createDataFrame([], f"path string, content string, {META}")
        now = self.tree.read(version)
        return none if now is None else none.unionByName(now, allowMissingColumns=True)

    def read_page(self, path: str) -> DataFrame:
        """A page with its sidecar; of a bundle's page that is the memory type of its path alone."""
        page = self.pages().where(F.col("path") == path)
        if not self.read_only:
            return page
        own = {c: F.lit(None).cast(t) for c, t in page.dtypes if c not in ("path", "content")}
        return page.withColumns(own | {"memory_type": memory_type(F.col("path"))})

    def open_page(self, path: str) -> DataFrame:
        """A page with its sidecar and access dates, this access among them; a bundle records and has none. A page that
        isn't there gives no row and leaves no record."""
        page = self.read_page(path)
        if not self.read_only and not page.isEmpty():
            self._record(self.spark.createDataFrame([(path,)], "path string").select("path", F.current_timestamp().alias("at"), F.lit(time.time_ns()).alias("read_no"), F.lit(False).alias("gone")))
        return page.join(self.telemetry(F.lit(False) if self.read_only else F.col("path") == path), "path", "left")

    def _record(self, reads: DataFrame) -> None:
        reads.coalesce(1).write.mode("append").parquet(f"{self.root}/reads")

    def _reads(self, which: Column | None = None) -> DataFrame:
        """Accesses of the pages as they lie now: those before a page was moved away don't count for its path."""
        if not self._exists("reads"):
            return self.spark.createDataFrame([], READS)
        reads = self.spark.read.schema(READS).parquet(f"{self.root}/reads")
        reads = reads if which is None else reads.where(which)
        moved = reads.where("gone").groupBy("path").agg(F.max("read_no").alias("upto"))
        return reads.where("NOT coalesce(gone, false)").join(moved, "path", "left").where("upto IS NULL OR read_no > upto").drop("upto")

    def telemetry(self, which: Column | None = None) -> DataFrame:
        """``path, last_accessed, access_dates`` of the pages that were opened."""
        return pages.access_dates(self._reads(which))

    def staged_turn(self, edit: Callable[[DataFrame], DataFrame], budget: int = 1 << 20, allow_delete: bool = False, allow_archive: bool = False) -> DataFrame:
        """One turn on a copy of the pages: ``edit`` gets the pages and returns (path, content) of all that are
        to be. They become the next version only if nothing violates the rules; an error in ``edit``, or a
        violation, leaves the pages as they were, and so does a version that another writer made meanwhile, which
        raises ``StaleBase``. Returns the violations (path, message). Pages keep their sidecars."""
        self._writable()
        with Scratch(self.spark) as tables:
            base = self.tree.current()
            now = self.pages(base)
            staged = materialize(edit(now).select("path", "content"))
            wrong = tables.keep(lint.staging_violations(now, staged, budget, allow_delete, allow_archive))
            if wrong.isEmpty():
                both = staged.withColumnRenamed("content", "new").join(now.select("path", "content"), "path", "full")
                changed = materialize(both.where("NOT (new <=> content)").select("path", "new"))

                def build(part):
                    mine = self._own(part)
                    kept = mine.join(changed.select("path"), "path", "left_anti")
                    new = changed.where("new IS NOT NULL").withColumnRenamed("new", "content").join(mine.drop("content"), "path", "left")
                    return kept.unionByName(new.select(*kept.columns))

                if not changed.isEmpty():
                    self.tree.update(changed, build, base, from_base=True)
            return wrong

    def _own(self, part: DataFrame | None) -> DataFrame:
        """Pages of some buckets, with all columns."""
        none = self.spark.createDataFrame([], f"path string, content string, {META}")
        return none if part is None else none.unionByName(part, allowMissingColumns=True)

    def search(self, query: str) -> DataFrame:
        return pages.search_lines(self.pages(), query)

    def write_pages(self, writes: DataFrame) -> str:
        """Writes (path, content, sources, trust_tier, at, write_no) become the next version."""
        self._writable()
        from .functions.paths import store_path_error

        bad = writes.where(store_path_error(F.col("path")) != "").limit(1).collect()
        if bad:
            raise ValueError(f"refused path {bad[0]['path']!r}")

        def build(part):
            mine, paths = self._own(part), writes.select("path").distinct()
            written = pages.upsert_pages(mine.join(paths, "path", "left_semi"), writes)
            return mine.join(paths, "path", "left_anti").unionByName(written, allowMissingColumns=True)

        return self.tree.update(writes, build)

    def archive(self, moves: DataFrame) -> str:
        """Pages of ``moves`` (path, reason, at) go below archive/ with the time and reason; their accesses go along."""
        self._writable()
        there = self.pages().select("path").join(moves.select("path"), "path", "left_semi")
        gone = moves.join(there, "path", "left_anti").limit(1).collect()
        if gone:
            raise FileNotFoundError(gone[0]["path"])
        new = F.concat(F.lit("archive/"), "path").alias("path")
        touched = moves.select("path").unionByName(moves.select(new))
        at = self.tree.update(touched, lambda part: pages.archive_pages(self._own(part), moves).select(*self._own(None).columns))
        with Scratch(self.spark):
            mark = lambda path: moves.select(path, F.current_timestamp().alias("at"), F.lit(time.time_ns()).alias("read_no"), F.lit(True).alias("gone"))
            marks = materialize(mark(F.col("path")).unionByName(mark(new)))  # an older copy's accesses end, too
            later = self._reads().join(moves.select("path"), "path", "left_semi").select(new, "at", "read_no", "gone")
            later = materialize(later.withColumn("read_no", F.lit(time.time_ns()) + F.row_number().over(Window.partitionBy("path").orderBy("at", "read_no"))))
            self._record(marks.unionByName(later))
        return at

    def rebuild_index(self) -> str:
        """The indexes of the newest version, as pages of the next."""
        self._writable()
        index = pages.category_index(self.pages())
        return self.tree.update(index, lambda part: self._own(part).join(index.select("path"), "path", "left_anti").unionByName(index, allowMissingColumns=True))

    def index(self) -> str:
        """The root index, empty if there is none."""
        row = self.read_page("index.md").select("content").first()
        return row[0] if row else ""

    def cursor(self) -> int:
        """The compile cursor: the largest recorded, 0 without any."""
        return self.spark.read.parquet(f"{self.root}/cursor").agg(F.max("cursor")).first()[0] if self._exists("cursor") else 0

    def advance_cursor(self, to: int) -> bool:
        """Cursors only go forward."""
        self._writable()
        if to <= self.cursor():
            return False
        self.spark.createDataFrame([(to,)], "cursor long").write.mode("append").parquet(f"{self.root}/cursor")
        return True

    def run_compile(self, compile_: Callable[[DataFrame, int], int | None], lease_seconds: float = 3600.0) -> bool:
        """One compile cycle: nothing if no event is past the cursor, or while another cycle runs; else
        ``compile_`` gets those events and the cursor and says how far it came. The cursor moves only if that is
        forward, never past the log; an error leaves it, and so does a cycle that outlasted its lease and was
        replaced by another."""
        self._writable()
        lease = Lease(self.spark, f"{self.root}/compiling", lease_seconds)
        if not lease.take():
            return False
        try:
            cursor = self.cursor()
            events, end = self.read_events_since(cursor)
            if end <= cursor:
                return False
            to = compile_(events, cursor)
            return to is not None and lease.held() and self.advance_cursor(min(to, end))
        finally:
            lease.release()

    def start_auto_compile(self, compile_: Callable[[DataFrame, int], int | None], checkpoint: str, seconds: float = 1800.0):
        """Compile cycles on a timer, as a stream that beats; an error ends a cycle and not the timer."""

        def cycle(_: DataFrame, number: int) -> None:
            try:
                self.run_compile(compile_)
                self.compile_error = None
            except Exception as e:  # kept for whoever asks; the next beat tries again
                self.compile_error = e

        beat = self.spark.readStream.format("rate").option("rowsPerSecond", 1).load().writeStream.option("checkpointLocation", checkpoint)
        return beat.foreachBatch(cycle).trigger(processingTime=f"{seconds} seconds").start()

    def stats(self) -> DataFrame:
        return pages.memory_stats(self.pages(), self.events(), self.cursor())

    def recall_context(self, question: str, pending: bool, recent: int = 10) -> dict:
        """What a recall starts from: the index, matching lines, and recent events while work is
        pending."""
        return {"index": self.index(), "hits": self.search(question), "recent": self.read_recent_events(recent if pending else 0)}
