"""Queries over pages, links, validation, migration, code facts and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths, text
from ..operators import capture, codefacts, guards, lint, migrate
from ..operators import pages as pg
from .views import PAGES, pages, table, values_sql

#: Each word of a text as a link or in a form that isn't one, by its place; both dialects read it.
MARKED = """CASE i % 11 WHEN 0 THEN '[' || w || '](' || w || '.md)' WHEN 1 THEN '![' || w || '](' || w || '.png)' WHEN 2 THEN '`[' || w || '](code/' || w || '.md)`'
WHEN 3 THEN chr(10) || ' ```' || w || chr(10) || '[' || w || '](fenced/' || w || '.md) `' || chr(10) || '~~~' || chr(10) WHEN 4 THEN '[' || w || '](<../' || w || ' b.md> "t")'
WHEN 5 THEN '[' || w || chr(10) || '`](`](' || w || '/x.md?q#' || w || ')' WHEN 6 THEN '[' || w || '](https://example.org/' || w || ')' WHEN 7 THEN '``[' || w || '](' || w || ')`[' || w || '](two)``'
WHEN 8 THEN '[' || w || '](../../../' || w || ')' WHEN 9 THEN '[' || w || '](#' || w || ') [' || w || '](/' || w || ')' ELSE w END"""
KINDS = "('semantic', 'episodic', 'procedural', 'prospective')"

GOOD = '---\ntype: concept\ntitle: "A"\ndescription: "d"\ntimestamp: "2024-01-02T03:04:05Z"\nmemory_type: semantic\nsource_events: [e1, e2]\ntrust_tier: T1\n---\n'


def _text(s: str) -> str:
    """A text as an expression of both dialects; ``#`` stands for the document's id."""
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '").replace("\t", "' || chr(9) || '").replace("#", "' || doc_id || '") + "'"


def _forms(expressions: list[str]) -> str:
    """One of several expressions by the document's id."""
    *some, last = expressions
    return f"CASE doc_id % {len(expressions)} " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(some)) + f" ELSE {last} END"


BAD = '---\ntype: ""\ntitle: t\ndescription: d\ntimestamp: "yesterday"\nmemory_type: wrong\nsource_events: [e]\ntrust_tier: T9\nconfidence: sure\n---\n'
TEXT = "coalesce(content, '')"
#: Pages with and without faults around the documents' texts, and what each form is told.
BUNDLE = _forms([_text(GOOD) + " || " + TEXT, TEXT, _text("---\ntype: concept\n") + " || " + TEXT, _text(BAD) + " || " + TEXT, _text("---\ntype: odd\n---\n[gone](../none#.md) [dir](../source) [out](../../../../../x.md) [abs](/x.md)"),
  _text(GOOD + "[self](#.md) `[x](gone.md)` ![i](no.png) [x](https://x.org)"), _text("---\na: [1\n---\n") + " || " + TEXT, _text("---\na: 1\na: #\n---\n"), TEXT])
ISSUES = [
    *((1, "warning", f"missing bundle required field: {x}") for x in ("title", "description", "timestamp", "memory_type")),
    (1, "error", "missing YAML frontmatter with required type field"),
    (2, "error", "unterminated YAML frontmatter"),
    (3, "error", "missing required field: type"),
    (3, "error", "invalid timestamp format: must be RFC3339 / ISO 8601"),
    (3, "error", 'invalid memory_type "wrong"'),
    (3, "error", 'invalid trust_tier "T9"'),
    (3, "error", 'invalid confidence "sure"'),
    *((4, "warning", f"missing bundle required field: {x}") for x in ("title", "description", "timestamp", "memory_type")),
    (4, "warning", "broken internal link: ../none#.md"),
    (4, "warning", "broken internal link: ../source"),
    (4, "warning", "missing recommended field: trust_tier"),
    (4, "warning", "missing source_events provenance"),
    (4, "warning", 'unknown bundle type "odd"'),
    (6, "error", "invalid YAML frontmatter: while parsing a flow sequence"),
    (7, "error", "invalid YAML frontmatter: mapping key already defined"),
]
GO = [
    'package p\n\nimport "fmt"\n\n// Do does.\nfunc Do#() error {\n\treturn fmt.Errorf("} %d", 1)\n}\n\ntype T# struct{ n int }\n\nfunc (t *T#) M() {}\nconst C, low = 3, 1\ntype Reader interface{ Read() }\nvar v = `func fake() {`\nfunc TestHelper() {}\n',
    'package p\n\nimport (\n\t"os"\n\tx "testing"\n)\n\nfunc TestDo#(t *x.T) {}\n',
]
FACTS = [
    (0, "package", "p", 1), (0, "import", "fmt", 3), (0, "func", "Do#", 6), (0, "type", "T#", 10), (0, "method", "*T#.M", 12), (0, "const", "C", 13), (0, "const", "low", 13),
    (0, "interface", "Reader", 14), (0, "var", "v", 15), (0, "func", "TestHelper", 16), (1, "package", "p", 1), (1, "import", "os", 4), (1, "import", "testing", 5), (1, "test", "TestDo#", 8),
]
LEGACY = [
    ("semantic/old-page.md", "<!-- compiled_from: e1, e2 -->\n<!-- last_compiled: 2024-01-02T03:04:05Z -->\n\n# Old\nText [[semantic/new|New]] and `[[code]]` and [gone](none.md).\n"),
    ("semantic/new.md", GOOD + "See [[old-page]]."),
    ("plain.md", "nothing legacy"),
]
#: Legacy, migrated and plain pages around the documents' paths and texts.
OLD = [_text("<!-- compiled_from: e1, e# -->\n<!-- last_compiled: 2024-01-02T03:04:05Z -->\n\n") + " || '# Old ' || doc_id || " + _text("\nText [[semantic/none|New]] and `[[code]]` and [gone](none.md).\n"), _text(GOOD + "See [[#]]."), TEXT]
NEW = [_text('---\ntype: "') + " || kind || " + _text('"\ntitle: "Old #"\ndescription: "Text [New](') + " || up || " + _text('none.md) and `[[code]]` and [gone](none.md)."\ntimestamp: "2024-01-02T03:04:05Z"\nmemory_type: "') + " || m || "
  + _text('"\nsource_events:\n  - "e1"\n  - "e#"\ntrust_tier: "T3"\n---\n\n') + " || '# Old ' || doc_id || " + _text("\nText New and `[[code]]` and gone.\n"), _text(GOOD + "See [#](#.md)."), TEXT]
#: Link targets of every kind, made of the documents' own, and the paths they lead to.
ODD_TARGETS = "doc_id AS i, path, " + _forms(["'b%20' || doc_id || '.md'", "'../x' || doc_id", "'../../../../out.md'", "'./b.md'", "'%28x%29/../y.md'", "'x//y.md'", "'%3Ca%3E%5C' || doc_id || '.md'"]) + " AS x"
REACHED = _forms(["dir || '/b ' || doc_id || '.md'", "array_to_string(k[:-3], '/') || '/x' || doc_id", "NULL", "dir || '/b.md'", "dir || '/y.md'", "dir || '/x/y.md'", "dir || '/<a>' || chr(92) || doc_id || '.md'"])
ODD_LOWERS = "doc_id AS i, CASE doc_id % 3 WHEN 0 THEN 'ABC İstanbul ΣΑΣ ÀÉ ß ' || text ELSE text END AS x"


def _staged(s, d):
    """Production pages and a staged copy with edits, additions, deletions and stray files."""
    p = pages(s, d)
    i = F.col("doc_id")
    head = F.when(i % 5 == 0, "").otherwise("<!-- compiled_from: e -->\n<!-- last_compiled: t -->\n")
    kept = p.where(i % 11 != 0).select(F.when(i % 13 == 0, F.concat("path", F.lit(".bak"))).otherwise(F.col("path")).alias("path"), F.concat(head, "content").alias("content"))
    return p.select("path", "content"), kept


_STAGED = PAGES + """, st AS (SELECT CASE WHEN doc_id % 13 = 0 THEN path || '.bak' ELSE path END AS path,
  CASE WHEN doc_id % 5 = 0 THEN '' ELSE '<!-- compiled_from: e -->' || chr(10) || '<!-- last_compiled: t -->' || chr(10) END || content AS content FROM pg WHERE doc_id % 11 <> 0)"""


def _writes(s, d):
    p = pages(s, d).where("doc_id % 3 = 0")
    i = F.col("doc_id")
    rows = p.select("path", F.explode(F.sequence(F.lit(0), (i % 3 + 1).cast("int"))).alias("write_no"), i.alias("i"))
    return rows.select("path", F.concat(F.lit("v"), F.col("write_no").cast("string")).alias("content"), F.array(F.concat(F.lit("e"), ((F.col("i") + F.col("write_no")) % 4).cast("string")), F.lit("e0")).alias("sources"), ((F.col("i") + F.col("write_no")) % 4).cast("int").alias("trust_tier"), F.concat(F.lit("t"), F.col("write_no").cast("string")).alias("at"), "write_no")


def _upserted(s, d):
    old = pages(s, d).where("doc_id % 2 = 0").select("path", "content", F.array(F.lit("e9"), F.lit("e0")).alias("source_events"), F.lit(2).alias("trust_tier_max"), F.lit("t-old").alias("created_at"), F.lit("kept").alias("memory_type"))
    return pg.upsert_pages(old, _writes(s, d)).withColumn("source_events", F.array_join("source_events", ","))


def _bundle(s, d):
    """Pages in nine forms; those of the last stand in a hidden folder."""
    return pages(s, d).selectExpr("CASE WHEN doc_id % 9 = 8 THEN '.git/' || path ELSE path END AS path", f"{BUNDLE} AS content")


def _sources(s, d):
    """A Go file for each document, every second one a test."""
    return table(s, d, "documents").selectExpr("'pkg/' || doc_id || CASE doc_id % 2 WHEN 0 THEN '.go' ELSE '_test.go' END AS path", f"{_forms([_text(x) for x in GO])} AS content")


def _web_links(s, d):
    p = table(s, d, "pages")
    found = F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))
    links = p.select(F.concat(F.lit("site/"), F.col("page_id").cast("string"), F.lit(".md")).alias("path"), F.explode(found).alias("link"))
    return links.withColumn("target", paths.clean_path(F.concat(F.lit("site/"), F.regexp_replace("link", "^/", ""))))


def _columns(sql: str) -> list[str]:
    """Two or three columns of a select list whose last one may hold commas."""
    *first, last = sql.split(", CASE", 1)[0].split(", ") + ["CASE" + sql.split(", CASE", 1)[1]]
    return [*first, last]


#: Paths of every kind, made of the documents' own; the same text is Spark's and DuckDB's.
ODD_PATHS = """doc_id AS i, CASE doc_id % 10 WHEN 0 THEN '' WHEN 1 THEN '/' || path WHEN 2 THEN path || '/../x' WHEN 3 THEN '.meta/' || path WHEN 4 THEN 'index.md'
  WHEN 5 THEN 'episodic/' || doc_id || '/index.md' WHEN 6 THEN 'archive/people/' || doc_id || '.md' WHEN 7 THEN 'a/person/' || doc_id || '.md' WHEN 8 THEN 'semantic/people/' || doc_id ELSE path END AS p"""
#: Link targets of every kind, made of the pages' addresses.
ODD_LINKS = """page_id AS i, CASE page_id % 7 WHEN 0 THEN url WHEN 1 THEN upper(url) WHEN 2 THEN 'mailto:' || url WHEN 3 THEN '#' || url
  WHEN 4 THEN 'repo:' || repeat('a1', 20) || ':' || page_id || '.go:10:F' WHEN 5 THEN 'repo:' || repeat('b', 40) || ':' || url || ':deleted' ELSE page_id || '.md' END AS x"""
#: Messages with blocks in them, closed and open.
ODD_TEXTS = """conv_id, turn, CASE turn % 4 WHEN 0 THEN '<recall>' || text || '</recall> ' || role WHEN 1 THEN text || ' <recall>open' WHEN 2 THEN text || '<recall>a</recall>' || role ELSE text END AS x"""

#: The indexes as one text each.
INDEXES = f"""WITH {PAGES}, x AS (SELECT path, string_split(path, '/') AS k, k[1] AS cat, content AS c FROM pg WHERE path NOT LIKE 'archive/%'),
l AS (SELECT *, list_filter(list_transform(string_split(c, chr(10)), lambda z: trim(z, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ')), lambda z: z <> '' AND z NOT LIKE '#%' AND z NOT LIKE '<!--%')[1] AS f FROM x),
w AS (SELECT *, CASE WHEN strlen(f) > 100 THEN list_filter(range(0, 101), lambda i: strlen(substr(f, 1, i)) <= 100)[-1] END AS whole FROM l),
e AS (SELECT *, CASE WHEN whole IS NULL THEN coalesce(f, '') ELSE substr(f, 1, whole) || CASE WHEN strlen(substr(f, 1, whole)) < 100 THEN chr(65533) ELSE '' END || '...' END AS descr FROM w),
a AS (SELECT cat, string_agg('- [' || k[-1] || '](' || path || ') — ' || descr, chr(10) ORDER BY k) AS root, string_agg('- [' || k[-1] || '](' || substr(path, len(cat) + 2) || ') — ' || descr, chr(10) ORDER BY k) AS own FROM e GROUP BY cat),
d AS (SELECT i, c FROM (VALUES (0, 'semantic'), (1, 'episodic'), (2, 'procedural'), (3, 'prospective')) v(i, c))
SELECT c || '/index.md' AS path, '# ' || upper(c[1]) || c[2:] || chr(10) || chr(10) || coalesce(own || chr(10), '_No pages yet._' || chr(10)) AS content FROM d LEFT JOIN a ON c = cat
UNION ALL SELECT 'index.md', '# Wiki Index' || chr(10) || chr(10) || coalesce(string_agg('## ' || c || chr(10) || chr(10) || root, chr(10) || chr(10) ORDER BY i) || chr(10), '_No pages yet._' || chr(10)) FROM d JOIN a ON c = cat"""

def _marked(docs):
    """Pages of the documents' words, each in the form of its place: eleven words at a time by one pattern, the last ones one by one."""
    turn, marked = "(?>[^A-Za-z]*)((?>[A-Za-z]+))" * 11, f"(w, i) -> {MARKED}"
    turns = docs.select("path", "x", F.regexp_extract("x", rf"\A(?:{turn})*+", 0).alias("h"))
    forms = F.expr(f"array_join(transform(array('$1', '$2', '$3', '$4', '$5', '$6', '$7', '$8', '$9', '$10', '$11'), {marked}), ' ') || ' '")
    last = F.expr(f"array_join(transform(regexp_extract_all(substring(x, length(h) + 1), '[A-Za-z]+', 0), {marked}), ' ')")
    return turns.select("path", F.rtrim(F.concat(F.regexp_replace("h", F.lit(turn), forms), last)).alias("body"))


def _page_link_targets(s, d):
    docs = table(s, d, "documents").select(F.concat(F.lit("semantic/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.coalesce("text", F.lit("")).alias("x"))
    return lint.link_totals(_marked(docs))


QUERIES = {
    "search_lines": (
        lambda s, d: pg.search_lines(pages(s, d), "The"),
        f"WITH {PAGES}, l AS (SELECT path, unnest(string_split(content, chr(10))) AS content, unnest(range(1, len(string_split(content, chr(10))) + 1))::INT AS line FROM pg) SELECT path, line, content FROM l WHERE contains(lower(content), 'the')",
    ),
    "search_hits_by_page": (
        lambda s, d: pg.search_lines(pages(s, d), "and").groupBy("path").agg(F.count("*").alias("hits"), F.min("line").alias("first_line")),
        f"WITH {PAGES}, l AS (SELECT path, unnest(string_split(content, chr(10))) AS content, unnest(range(1, len(string_split(content, chr(10))) + 1))::INT AS line FROM pg) SELECT path, count(*) AS hits, min(line) AS first_line FROM l WHERE contains(lower(content), 'and') GROUP BY path",
    ),
    "memory_stats": (
        lambda s, d: pg.memory_stats(pages(s, d), table(s, d, "events"), 250),
        f"WITH {PAGES} SELECT (SELECT count(*) FROM events) AS events, (SELECT count(*) FROM events) - 250 AS uncompiled, count_if(path NOT LIKE 'archive/%')::BIGINT AS pages, count_if(path LIKE 'archive/%')::BIGINT AS archived FROM pg",
    ),
    "category_index": (lambda s, d: pg.category_index(pages(s, d)), INDEXES),
    "category_index_parts": (
        lambda s, d: pg.category_index_parts(pages(s, d), 4096),
        f"""WITH t AS (SELECT path AS p, string_split(content, chr(10))[:-2] AS ls FROM ({INDEXES})),
l AS (SELECT p, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) || chr(10) AS line FROM t),
o AS (SELECT *, sum(strlen(line)) OVER (PARTITION BY p ORDER BY i) - strlen(line) AS b FROM l)
SELECT p AS path, floor(b / 4096)::BIGINT AS part_no, min(b)::BIGINT AS begin, string_agg(line, '' ORDER BY i) AS content FROM o GROUP BY ALL""",
    ),
    "sidecar_merge": (
        _upserted,
        f"""WITH {PAGES}, w AS (SELECT path, doc_id AS i, unnest(range(0, (doc_id % 3 + 2)::INT)) AS n FROM pg WHERE doc_id % 3 = 0),
o AS (SELECT path, content FROM pg WHERE doc_id % 2 = 0),
a AS (SELECT path, content, ['e9', 'e0'] AS s, 2 AS t, 't-old' AS c, 'kept' AS m, -1 AS n FROM o
  UNION ALL SELECT path, 'v' || n, ['e' || ((i + n) % 4), 'e0'], ((i + n) % 4)::INT, 't' || n, CASE WHEN path LIKE 'archive/%' THEN '' ELSE string_split(path, '/')[1] END, n FROM w),
x AS (SELECT path, n * 2 + j AS k, s[j::INT + 1] AS e FROM a, (SELECT unnest([0, 1]) AS j)),
y AS (SELECT path, e, min(k) AS k FROM x GROUP BY ALL), z AS (SELECT path, string_agg(e, ',' ORDER BY k) AS source_events FROM y GROUP BY path)
SELECT a.path, arg_max(content, n) AS content, any_value(source_events) AS source_events, coalesce(min(nullif(t, 0)), 0) AS trust_tier_max, arg_min(c, n) AS created_at, arg_min(m, n) AS memory_type FROM a JOIN z ON a.path = z.path GROUP BY a.path""",
    ),
    "archive_move": (
        lambda s, d: pg.archive_pages(pages(s, d).select("path", "content"), pages(s, d).where("doc_id % 7 <> 0 AND doc_id % 5 = 0").select("path", F.lit("stale").alias("reason"), F.lit("2024-01-01").alias("at"))),
        f"""WITH {PAGES}, m AS (SELECT path FROM pg WHERE doc_id % 7 <> 0 AND doc_id % 5 = 0)
SELECT path, content, NULL::VARCHAR AS archived_at, NULL::VARCHAR AS archive_reason FROM pg WHERE path NOT IN (SELECT path FROM m) AND path NOT IN (SELECT 'archive/' || path FROM m)
UNION ALL SELECT 'archive/' || path, content, '2024-01-01', 'stale' FROM pg WHERE path IN (SELECT path FROM m)""",
    ),
    "access_dates_fold": (
        lambda s, d: pg.access_dates(table(s, d, "events").select(F.concat(F.lit("p"), F.col("user_id").cast("string")).alias("path"), F.col("ts").alias("at"), F.col("event_id").alias("read_no"))).withColumn("access_dates", F.array_join("access_dates", ",")),
        """WITH r AS (SELECT 'p' || user_id AS path, ts, event_id, strftime(ts, '%Y-%m-%d') AS d, lag(strftime(ts, '%Y-%m-%d')) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)
SELECT path, strftime(max(ts), '%Y-%m-%dT%H:%M:%SZ') AS last_accessed, string_agg(CASE WHEN p IS DISTINCT FROM d THEN d END, ',' ORDER BY ts, event_id) AS access_dates FROM r GROUP BY path""",
    ),
    "page_telemetry": (
        lambda s, d: pg.with_telemetry(pages(s, d), pages(s, d).where("doc_id % 3 = 0").select("path", F.array(F.lit("e1")).alias("source_events"), F.lit(2).alias("trust_tier_max"))).select("path", F.array_join("source_events", ",").alias("sources"), "trust_tier_max"),
        f"WITH {PAGES} SELECT path, CASE WHEN doc_id % 3 = 0 THEN 'e1' ELSE '' END AS sources, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 0 END AS trust_tier_max FROM pg",
    ),
    "ensure_provenance": (
        lambda s, d: pages(s, d).select("path", pg.with_provenance(F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("<!-- compiled_from: x -->\n"), "content")).otherwise(F.col("content")), F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("e1"), F.lit("e2"))).otherwise(F.array().cast("array<string>")), F.lit("2024-01-01T00:00:00Z")).alias("content")),
        f"WITH {PAGES} SELECT path, CASE WHEN doc_id % 3 = 0 THEN '' ELSE '<!-- compiled_from: ' || CASE WHEN doc_id % 2 = 0 THEN 'e1, e2' ELSE 'ingest' END || ' -->' || chr(10) END || '<!-- last_compiled: 2024-01-01T00:00:00Z -->' || chr(10) || CASE WHEN doc_id % 3 = 0 THEN '<!-- compiled_from: x -->' || chr(10) ELSE '' END || content AS content FROM pg",
    ),
    "path_checks": (
        lambda s, d: pages(s, d).selectExpr(*_columns(ODD_PATHS)).select("i", paths.store_path_error(F.col("p")).alias("store"), paths.tool_path_error(F.col("p")).alias("tool"), paths.valid_page_path(F.col("p")).alias("valid"), paths.structural_index(F.col("p")).alias("structural"), paths.any_index(F.col("p")).alias("any_index")),
        f"""WITH {PAGES}, v AS (SELECT {ODD_PATHS} FROM pg) SELECT i, CASE WHEN p = '' THEN 'empty' WHEN contains(p, '..') THEN 'traversal' WHEN p LIKE '/%' THEN 'absolute' WHEN p LIKE '.meta/%' THEN 'metadata' ELSE '' END AS store,
CASE WHEN p = '' THEN 'empty' WHEN p LIKE '/%' THEN 'absolute' WHEN contains(p, '..') THEN 'traversal' WHEN p LIKE '.meta/%' THEN 'metadata' ELSE '' END AS tool,
p = 'index.md' OR regexp_matches(p, '^(semantic|episodic|procedural|prospective)/') AS valid, p IN ('index.md', 'semantic/index.md', 'episodic/index.md', 'procedural/index.md', 'prospective/index.md') AS structural,
string_split(p, '/')[-1] = 'index.md' AS any_index FROM v""",
    ),
    "infer_types": (
        lambda s, d: pages(s, d).selectExpr(*_columns(ODD_PATHS)).select("i", paths.memory_type(F.col("p")).alias("store"), paths.migrated_memory_type(F.col("p")).alias("migrated"), paths.page_type(F.col("p")).alias("kind")),
        f"""WITH {PAGES}, v AS (SELECT {ODD_PATHS} FROM pg), x AS (SELECT *, string_split(p, '/') AS k, CASE WHEN k[1] = 'archive' AND len(k) > 1 THEN k[2] ELSE k[1] END AS m FROM v),
y AS (SELECT *, CASE WHEN m IN {KINDS} THEN m ELSE 'semantic' END AS migrated FROM x)
SELECT i, CASE WHEN k[1] IN {KINDS} THEN k[1] ELSE '' END AS store, migrated, CASE WHEN migrated = 'procedural' THEN 'procedure' WHEN migrated IN ('episodic', 'prospective') THEN 'event' WHEN contains(p, '/people/') OR contains(p, '/person/') THEN 'person' ELSE 'concept' END AS kind FROM y""",
    ),
    "walk_order": (
        lambda s, d: pg.walk_ranks(pages(s, d)),
        f"WITH {PAGES} SELECT path, row_number() OVER (ORDER BY string_split(path, '/')) AS rank FROM pg",
    ),
    "resolve_targets": (
        lambda s, d: pages(s, d).selectExpr(*_columns(ODD_TARGETS)).select("i", paths.clean_path(F.concat(paths.directory(F.col("path")), F.lit("/"), paths.decode_target(F.col("x")))).alias("target"), paths.encode_target(paths.decode_target(F.col("x"))).alias("again")),
        f"WITH {PAGES}, v AS (SELECT *, string_split(path, '/') AS k, array_to_string(string_split(path, '/')[:-2], '/') AS dir FROM pg), x AS (SELECT {ODD_TARGETS} FROM pg) SELECT i, {REACHED} AS target, x AS again FROM v JOIN x ON i = doc_id",
    ),
    "page_link_targets": (
        _page_link_targets,
        f"""WITH w AS (SELECT doc_id, unnest(x) AS w, generate_subscripts(x, 1) - 1 AS i FROM (SELECT doc_id, source, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+') AS x FROM documents)),
t AS (SELECT doc_id, CASE i % 11 WHEN 0 THEN 'semantic/' || w || '.md' WHEN 4 THEN w || ' b.md' WHEN 5 THEN 'semantic/' || w || '/x.md' END AS target, i FROM w WHERE i % 11 IN (0, 4, 5, 8))
SELECT 'semantic/' || doc_id || '.md' AS path, count(*) AS n_links, count(target) AS n_inside, count(DISTINCT target) AS n_targets, min(target) AS first_target, max(target) AS last_target, CAST(sum(length(target)) AS BIGINT) AS n_chars FROM t GROUP BY doc_id""",
    ),
    "link_kinds": (
        lambda s, d: table(s, d, "pages").selectExpr(*_columns(ODD_LINKS)).select("i", paths.external_link(F.col("x")).alias("external"), paths.source_anchor_link(F.col("x")).alias("anchor")),
        f"WITH v AS (SELECT {ODD_LINKS} FROM pages) SELECT i, regexp_matches(lower(x), '^(https?://|mailto:|tel:|#)') AS external, regexp_matches(x, '^[^\\s:]+:[0-9a-fA-F]{{40}}:.+:(deleted|[0-9]+:.+)$') AS anchor FROM v",
    ),
    "lower_runes": (
        lambda s, d: table(s, d, "documents").selectExpr(*_columns(ODD_LOWERS)).select("i", text.lower_runes(F.col("x")).alias("x")),
        f"WITH v AS (SELECT {ODD_LOWERS} FROM documents) SELECT i, lower(x) AS x FROM v",
    ),
    "page_descriptions": (
        lambda s, d: pages(s, d).select("path", text.first_prose_line(F.regexp_replace("content", "[^\\x00-\\x7F]", "?"), 160, F.lit("none")).alias("description")),
        f"""WITH {PAGES}, l AS (SELECT path, list_filter(list_transform(string_split(regexp_replace(content, '[^\\x00-\\x7F]', '?', 'g'), chr(10)), lambda z: trim(z, chr(9) || chr(11) || chr(12) || chr(13) || ' ')), lambda z: z <> '' AND z NOT LIKE '#%' AND z NOT LIKE '<!--%')[1] AS f FROM pg)
SELECT path, CASE WHEN strlen(f) > 160 THEN substr(f, 1, 160) || '...' ELSE coalesce(f, 'none') END AS description FROM l""",
    ),
    "staging_violations": (
        lambda s, d: lint.staging_violations(*_staged(s, d), budget=10_000),
        f"""WITH {_STAGED}, md AS (SELECT * FROM st WHERE path LIKE '%.md'), b AS (SELECT sum(CASE WHEN pg.path IS NULL THEN strlen(md.content) ELSE abs(strlen(md.content) - strlen(pg.content)) END) AS n FROM md LEFT JOIN pg ON md.path = pg.path)
SELECT path, 'non-Markdown file in wiki (only .md files are allowed)' AS message FROM st WHERE path NOT LIKE '%.md'
UNION ALL SELECT path, 'path does not conform to wiki taxonomy (semantic/, episodic/, procedural/, prospective/)' FROM md WHERE path LIKE 'archive/%'
UNION ALL SELECT path, 'missing required frontmatter (compiled_from, last_compiled)' FROM md WHERE NOT contains(content, 'compiled_from:')
UNION ALL SELECT '', 'diff budget exceeded: ' || n || ' bytes > 10000 bytes max' FROM b WHERE n > 10000
UNION ALL SELECT path, 'page deleted in staging (ingest should not delete pages)' FROM pg WHERE path NOT IN (SELECT path FROM st)""",
    ),
    "diff_budget": (
        lambda s, d: lint.diff_bytes(*_staged(s, d)),
        f"WITH {_STAGED} SELECT sum(CASE WHEN pg.path IS NULL THEN strlen(st.content) ELSE abs(strlen(st.content) - strlen(pg.content)) END)::BIGINT AS bytes FROM st LEFT JOIN pg ON st.path = pg.path WHERE st.path LIKE '%.md'",
    ),
    "deleted_pages": (
        lambda s, d: (lambda p, t: p.select("path").join(t.select("path"), "path", "left_anti"))(*_staged(s, d)),
        f"WITH {_STAGED} SELECT path FROM pg WHERE path NOT IN (SELECT path FROM st)",
    ),
    "frontmatter_issues": (
        lambda s, d: lint.validate_bundle(_bundle(s, d), strict=True),
        f"WITH {PAGES}, {values_sql('f', 'form, severity, message', ISSUES)} SELECT path, severity, replace(message, '#', doc_id::VARCHAR) AS message FROM pg JOIN f ON doc_id % 9 = form",
    ),
    "issue_counts": (
        lambda s, d: lint.issue_counts(lint.validate_bundle(_bundle(s, d), strict=True)),
        f"WITH {PAGES}, {values_sql('f', 'form, severity, message', ISSUES)} SELECT count_if(severity = 'error')::BIGINT AS errors, count_if(severity = 'warning')::BIGINT AS warnings, 1 AS exit_code FROM pg JOIN f ON doc_id % 9 = form",
    ),
    "broken_links": (
        lambda s, d: lint.broken_links(_web_links(s, d), table(s, d, "pages").select(F.concat(F.lit("site/"), F.regexp_extract("html", '<a href="/([^"]*)"', 1)).alias("path")).where("path <> 'site/'")),
        """WITH l AS (SELECT 'site/' || page_id || '.md' AS path, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS link FROM pages),
f AS (SELECT 'site/' || regexp_extract(html, '<a href="/([^"]*)"', 1) AS path FROM pages WHERE regexp_extract(html, '<a href="/([^"]*)"', 1) <> '')
SELECT 'warning' AS severity, path, 'broken internal link: ' || link AS message FROM l WHERE 'site/' || regexp_replace(link, '^/', '') NOT IN (SELECT path FROM f) AND 'site/' || regexp_replace(link, '^/', '') <> 'site/'""",
    ),
    "migrate_bundle": (
        lambda s, d: migrate.migrate_bundle(pages(s, d).selectExpr("path", f"{_forms(OLD)} AS content", "CAST(NULL AS TIMESTAMP) AS mtime")).select("path", "content", "changed"),
        f"""WITH {PAGES}, v AS (SELECT *, string_split(path, '/') AS k, CASE WHEN k[1] = 'archive' THEN k[2] ELSE k[1] END AS m, CASE m WHEN 'semantic' THEN 'concept' WHEN 'procedural' THEN 'procedure' ELSE 'event' END AS kind,
  CASE k[1] WHEN 'archive' THEN '../../../semantic/' WHEN 'semantic' THEN '../' ELSE '../../semantic/' END AS up FROM pg)
SELECT path, {_forms(NEW)} AS content, doc_id % 3 < 2 AS changed FROM v""",
    ),
    "scan_facts": (
        lambda s, d: codefacts.scan_facts(_sources(s, d), "repo", "c" * 40).select("path", "kind", "symbol", "line"),
        f"WITH {values_sql('f', 'form, kind, symbol, line', FACTS)} SELECT 'pkg/' || doc_id || CASE form WHEN 0 THEN '.go' ELSE '_test.go' END AS path, kind, replace(symbol, '#', doc_id::VARCHAR) AS symbol, line FROM documents JOIN f ON doc_id % 2 = form",
    ),
    "fact_ids": (
        lambda s, d: pages(s, d).select(F.lit("r").alias("repo"), F.lit("c").alias("commit_sha"), "path", F.lit("func").alias("kind"), F.concat(F.lit("F"), F.col("doc_id").cast("string")).alias("symbol"), (F.col("doc_id") % 90).cast("int").alias("line"), F.when(F.col("doc_id") % 9 == 0, "deleted").otherwise("present").alias("status")).select("path", codefacts.fact_id().alias("id"), codefacts.source_anchor().alias("anchor")),
        f"""WITH {PAGES}, x AS (SELECT path, 'F' || doc_id AS s, doc_id % 90 AS l, CASE WHEN doc_id % 9 = 0 THEN 'deleted' ELSE 'present' END AS st FROM pg)
SELECT path, 'fact_' || substr(sha256('r' || chr(0) || 'c' || chr(0) || path || chr(0) || 'func' || chr(0) || s || chr(0) || l || chr(0) || st), 1, 16) AS id, CASE WHEN st = 'deleted' THEN 'r:c:' || path || ':deleted' ELSE 'r:c:' || path || ':' || l || ':' || s END AS anchor FROM x""",
    ),
    "snippet_ids": (
        lambda s, d: pages(s, d).where("content IS NOT NULL").select(F.lit("r").alias("repo"), F.lit("c").alias("commit_sha"), "path", F.lit("func").alias("kind"), F.concat(F.lit("F"), F.col("doc_id").cast("string")).alias("symbol"), (F.col("doc_id") % 90).cast("long").alias("start_line"), (F.col("doc_id") % 90 + F.length("content")).cast("long").alias("end_line"), F.sha2("content", 256).alias("file_hash")).select("path", codefacts.snippet_id().alias("id")),
        f"""WITH {PAGES} SELECT path, 'snippet_' || substr(sha256('r' || chr(0) || 'c' || chr(0) || path || chr(0) || 'func' || chr(0) || 'F' || doc_id || chr(0) || (doc_id % 90) || chr(0) || (doc_id % 90 + length(content)) || chr(0) || sha256(content)), 1, 16) AS id
FROM pg WHERE content IS NOT NULL""",
    ),
    "file_manifest": (
        lambda s, d: codefacts.file_manifest(table(s, d, "events").select(F.concat(F.lit("f"), (F.col("user_id") % 20).cast("string")).alias("path"), F.concat(F.lit("i"), F.col("event_id").cast("string")).alias("id"), F.when(F.col("event_id") % 4 == 0, "").otherwise(F.col("event_type")).alias("symbol"), F.concat(F.lit("a"), F.col("event_id").cast("string")).alias("anchor"))).select("path", *(F.md5(F.array_join(c, ",")).alias(c) for c in ("fact_ids", "symbols", "anchors"))),
        "SELECT 'f' || (user_id % 20) AS path, md5(string_agg('i' || event_id, ',' ORDER BY 'i' || event_id)) AS fact_ids, md5(string_agg(CASE WHEN event_id % 4 <> 0 THEN event_type END, ',' ORDER BY event_type)) AS symbols, md5(string_agg('a' || event_id, ',' ORDER BY 'a' || event_id)) AS anchors FROM events GROUP BY 1",
    ),
    "changed_deleted_sets": (
        lambda s, d: codefacts.file_sets(table(s, d, "events").select(F.get(F.array(*(F.lit(x) for x in ("M", "D", "R100", "C75", "A", ""))), (F.col("event_id") % 6).cast("int")).alias("status"), F.concat(F.lit("o"), (F.col("event_id") % 500).cast("string")).alias("old_path"), F.concat(F.lit("n"), (F.col("event_id") % 700).cast("string")).alias("new_path"))),
        """WITH e AS (SELECT ['M', 'D', 'R', 'C', 'A', ''][(event_id % 6 + 1)::INT] AS s, 'o' || (event_id % 500) AS o, 'n' || (event_id % 700) AS n FROM events)
SELECT DISTINCT o AS path, 'deleted' AS change FROM e WHERE s IN ('D', 'R', 'C') UNION SELECT n, 'changed' FROM e WHERE s IN ('R', 'C') UNION SELECT o, 'changed' FROM e WHERE s IN ('M', 'A')""",
    ),
    "test_targets": (
        lambda s, d: table(s, d, "events").select("event_id", codefacts.test_target(F.concat(F.get(F.array(*(F.lit(x) for x in ("Test", "Benchmark", "Fuzz", "Do"))), (F.col("event_id") % 4).cast("int")), F.initcap("event_type"))).alias("target")),
        "SELECT event_id, CASE WHEN event_id % 4 = 3 THEN '' ELSE upper(event_type[1]) || event_type[2:] END AS target FROM events",
    ),
    "capture_tail": (
        lambda s, d: capture.select_tail(table(s, d, "conversations"), 4, 1_500),
        "WITH r AS (SELECT *, row_number() OVER w AS rn, sum(strlen(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS t FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC)) SELECT conv_id, turn, role, text FROM r WHERE rn <= 4 AND (rn = 1 OR t <= 1500)",
    ),
    "capture_conversations": (
        lambda s, d: capture.captured(table(s, d, "conversations").withColumn("text", F.when(F.col("turn") % 3 == 1, F.concat(F.lit("<recall>old</recall> "), "text")).otherwise(F.col("text"))), max_messages=5, max_bytes=3_000).select("conv_id", "turn", "role", "text"),
        """WITH c AS (SELECT conv_id, turn, role, trim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS text FROM conversations WHERE role IN ('user', 'assistant')),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn, sum(strlen(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS t FROM c WHERE text <> '') SELECT conv_id, turn, role, text FROM r WHERE rn <= 5 AND (rn = 1 OR t <= 3000)""",
    ),
    "reset_summary": (
        lambda s, d: capture.reset_summary(table(s, d, "conversations")),
        """WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations WHERE role = 'user' AND length(text) > 10)
SELECT conv_id, '[session-summary before reset] ' || string_agg(substr(trim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '), 1, 300), ' | ' ORDER BY turn) AS summary FROM r WHERE rn <= 3 GROUP BY conv_id""",
    ),
    "strip_injected": (
        lambda s, d: table(s, d, "conversations").selectExpr(*_columns(ODD_TEXTS)).select("conv_id", "turn", text.strip_blocks(F.col("x"), "recall").alias("x")),
        f"WITH v AS (SELECT {ODD_TEXTS} FROM conversations) SELECT conv_id, turn, trim(regexp_replace(regexp_replace(x, '(?s)<recall>.*?</recall>', '', 'g'), '(?s)<recall>.*', ''), chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS x FROM v",
    ),
    "exit_codes": (
        lambda s, d: table(s, d, "events").selectExpr("event_id", "user_id % 3 AS errors", "event_id % 2 AS warnings", "event_id % 5 = 0 AS strict").select("event_id", guards.exit_code(F.col("errors"), F.col("warnings"), F.col("strict")).alias("code")),
        "SELECT event_id, CASE WHEN user_id % 3 > 0 OR (event_id % 5 = 0 AND event_id % 2 > 0) THEN 1 ELSE 0 END AS code FROM events",
    ),
}
