"""Queries over the text tables seen as files, with their SQL."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from treesift.functions.text import safe_evidence
from treesift.operators import active, content, findings
from treesift.operators.rules import Rule, scan
from treesift.sources import json_tree, manifests
from treesift.sources.files import CORPUS_SQL, corpus_files
from treesift.sources.snapshots import SnapshotStore, as_of
from treesift.sources.tables import shared_dir

#: Rules of one's own, as a user would state them in a settings file.
CUSTOM = [
    Rule("TXT-001", "secret", "high", "high", "Secret assigned in text", r"(?i)\b(token|password|secret)\s*=\s*\"[0-9a-f]{16,}\"", ("*.txt", "*.md")),
    Rule("TXT-002", "personal-data", "medium", "medium", "Mail address in text", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[a-z]{2,}"),
    Rule("TXT-003", "hardcoded-network", "medium", "low", "Address of a machine", r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b", ("src/*/*.txt",)),
]
MAX_BYTES = 20_000


def custom_rule_sql(lines: str = "lines") -> str:
    parts = []
    for r in CUSTOM:
        pattern = r.pattern.replace("'", "''")
        where = {"TXT-001": "(path LIKE '%.txt' OR path LIKE '%.md')", "TXT-002": "true", "TXT-003": "path LIKE 'src/%/%.txt'"}[r.id]
        parts.append(f"SELECT repo_id, path, line_no, '{r.id}' AS rule_id, len(regexp_extract_all(line, '{pattern}')) AS n FROM {lines} WHERE {where}")
    return " UNION ALL ".join(parts)


def scan_lines_t(spark, sf_dir):
    return content.line_statistics(corpus_files(spark, sf_dir))


def rule_match_custom_t(spark, sf_dir):
    raw = scan(corpus_files(spark, sf_dir), CUSTOM, fallback=False)
    return findings.dedup(raw).select("repo_id", "path", "rule_id", "context", "severity", "confidence", "disposition", "occurrences", "n_locations", "line")


def long_lines_t(spark, sf_dir):
    return content.long_lines(corpus_files(spark, sf_dir))


def line_entropy_t(spark, sf_dir):
    return content.line_entropy(corpus_files(spark, sf_dir), 4.5)


def redact_evidence_t(spark, sf_dir):
    lines = content.plain_lines(corpus_files(spark, sf_dir)).where(F.col("line").rlike(r"(?i)token|password|secret"))
    return lines.select("path", "line_no", safe_evidence(F.col("line")).alias("evidence"))


def content_hash_ioc_t(spark, sf_dir):
    files = corpus_files(spark, sf_dir)
    known = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id in (3, 30, 77, 150)")
    indicators = known.select(F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), F.concat(F.lit("family"), F.col("doc_id").cast("string")).alias("family"))
    return content.hash_matches(files, indicators)


def duplicate_files_t(spark, sf_dir):
    return content.duplicate_files(corpus_files(spark, sf_dir))


def repo_coverage_t(spark, sf_dir):
    files = corpus_files(spark, sf_dir)
    return content.coverage(files, MAX_BYTES, active.skipped_files(files))


def script_files(spark, sf_dir):
    """A script for each part and each order: a table of words of the row, changed in some rows, and lookups in it."""
    words = lambda name, *cs: F.concat(F.lit(f"const {name} = ['"), F.concat_ws("', '", *cs), F.lit("'];\n"))
    part, order = spark.read.parquet(f"{sf_dir}/part.parquet"), spark.read.parquet(f"{sf_dir}/orders.parquet")
    key = F.col("p_partkey")
    change = F.when(key % 7 == 1, "t.push('x');\n").when(key % 7 == 2, "const u = t; u[0] = 'y';\n").when(key % 7 == 3, "t['push'](t['shift']());\n").when(key % 7 == 4, "{\n").otherwise("")
    parts = part.select(F.lit("part").alias("repo_id"), F.concat(key.cast("string"), F.lit(".js")).alias("path"), F.concat(words("t", F.col("p_brand"), F.col("p_type"), F.col("p_name")), change, F.lit("f(t[2] + t[0], t[1]);\n")).alias("text"))
    number = F.col("o_orderkey")
    orders = order.select(F.lit("order").alias("repo_id"), F.concat(number.cast("string"), F.lit(".mjs")).alias("path"), F.concat(words("a", F.col("o_orderstatus"), F.col("o_orderpriority")), F.lit("let b = a["), (number % 3).cast("string"), F.lit("];\n")).alias("text"))
    return parts.unionByName(orders)


def js_tables_t(spark, sf_dir):
    """What lookups in constant string tables say, and the files of which a table is changed."""
    return active.js_values(script_files(spark, sf_dir)).select("repo_id", "path", "start_line", F.when(F.col("value").isNull(), F.col("method")).alias("gap"), "value")


def lock_files(spark, sf_dir):
    """A lockfile of the older form for each event, as deep as its user's number says."""
    event = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id")
    event = event.repartition(4 * spark.sparkContext.defaultParallelism, "event_id")  # small rows of which long texts are made: spread before that
    depth = F.when(F.col("event_id") % 200 == 7, 40).otherwise(1 + F.col("user_id") % 12).cast("int")
    entry = lambda acc, i: F.concat(F.lit('{"n'), i.cast("string"), F.lit('": {"version": "'), i.cast("string"), F.lit("."), (F.col("event_id") % 10).cast("string"), F.lit('.0", "dependencies": '), acc, F.lit("}}"))
    tree = F.aggregate(F.sequence(depth, F.lit(1), F.lit(-1)), F.lit("{}"), entry)
    return event.select(F.lit("lock").alias("repo_id"), F.concat(F.col("event_id").cast("string"), F.lit("/package-lock.json")).alias("path"), F.concat(F.lit('{"lockfileVersion": 1, "dependencies": '), tree, F.lit("}")).alias("text"))


def lock_tree_t(spark, sf_dir):
    """The packages of nested lockfiles, however deep."""
    return manifests.npm_lock(lock_files(spark, sf_dir)).select("path", "name", "version", "scope")


def strict_json_t(spark, sf_dir):
    """Fields and ends that a strict reader refuses, in the properties of events and changed ones."""
    event = spark.read.parquet(f"{sf_dir}/events.parquet")
    key = F.col("event_id")
    more = F.concat(F.regexp_replace("props", r"}\s*$", ""), F.lit(', "list": [{"a": 1}, {"b": {"c": 2}}], "x": {"y": 1}}'))
    json = F.when(key % 5 == 1, more).when(key % 5 == 2, F.concat("props", F.lit(" tail"))).when(key % 5 == 3, F.lit("{")).otherwise(F.col("props"))
    return json_tree.strict_problems(event.select(key.alias("id"), json.alias("json")), ["$.k", "$.list", "$.list[]", "$.list[].a"])


def staged_lines_t(spark, sf_dir):
    """Downloads and the lines that execute them, in a script for each user made of the events in their order."""
    event = spark.read.parquet(f"{sf_dir}/events.parquet")
    file = F.concat(F.lit("f"), (F.col("event_id") % 11).cast("string"), F.lit(".sh"))
    kind = F.col("event_id") % 5
    line = F.when(kind == 0, F.concat(F.lit("sudo curl -o "), file, F.lit(" https://files.example/a"))).when(kind == 1, F.concat(F.lit("cd /tmp && bash ./"), file)).when(kind == 2, F.concat(F.lit("chmod +x "), file)).otherwise(F.lit("echo done"))
    number = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    lines = event.select(F.lit("users").alias("repo_id"), F.concat(F.col("user_id").cast("string"), F.lit(".sh")).alias("path"), number.alias("line_no"), line.alias("line"))
    return active.staged_in_lines(lines)


def versions_as_of_t(spark, sf_dir):
    """The version of each customer's record (made of the orders) that was the last on three days."""
    order = spark.read.parquet(f"{sf_dir}/orders.parquet")
    version = F.concat(F.date_format("o_orderdate", "yyyy.MM.dd"), F.lit("."), F.col("o_orderkey").cast("string"))
    history = order.select("o_custkey", version.alias("version"), "o_orderpriority")
    days = F.array(*[F.lit(d).cast("date") for d in ("1994-02-28", "1996-07-01", "1999-01-01")])
    return as_of(history, order.select("o_custkey", F.explode(days).alias("day")).distinct(), "o_custkey")


def document_store_t(spark, sf_dir):
    """Two snapshots of documents, published, replaced and rolled back: rows that each pointer gives in the end."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    store = SnapshotStore(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    today = datetime.date(2026, 1, 2)
    store.update(docs.where("doc_id % 2 = 0"), "2026.01.01.1", today)
    store.update(docs, "2026.01.02.1", today)
    store.rollback()
    rows = [(name, store.version(name), store.pointer(name)) for name in ("active", "previous")]
    of = lambda r: store.load(r[2]).groupBy("lang").agg(F.count("*").alias("documents")).select(F.lit(r[0]).alias("pointer"), F.lit(r[1]).alias("version"), "lang", "documents")
    return of(rows[0]).unionByName(of(rows[1]))


SQL = {
    "staged_lines_t": """WITH l AS (SELECT user_id, event_id % 11 AS f, event_id % 5 AS kind, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events)
        SELECT 'users' AS repo_id, a.user_id || '.sh' AS path, CAST(a.n AS int) AS start_line, CAST(min(b.n) AS int) AS end_line, 'f' || a.f || '.sh' AS destination
        FROM l a JOIN l b ON a.user_id = b.user_id AND a.f = b.f AND b.n BETWEEN a.n AND a.n + 40 WHERE a.kind = 0 AND b.kind = 1 GROUP BY a.user_id, a.n, a.f""",
    "versions_as_of_t": """WITH d AS (SELECT DISTINCT o_custkey, unnest([DATE '1994-02-28', DATE '1996-07-01', DATE '1999-01-01']) AS day FROM orders)
        SELECT d.o_custkey, d.day, arg_max(strftime(o_orderdate, '%Y.%m.%d') || '.' || o_orderkey, (o_orderdate::DATE, o_orderkey)) AS version, arg_max(o_orderpriority, (o_orderdate::DATE, o_orderkey)) AS o_orderpriority
        FROM d LEFT JOIN orders o ON d.o_custkey = o.o_custkey AND o.o_orderdate::DATE <= d.day GROUP BY d.o_custkey, d.day""",
    "document_store_t": """SELECT 'active' AS pointer, '2026.01.01.1' AS version, lang, count(*) AS documents FROM documents WHERE doc_id % 2 = 0 GROUP BY lang
        UNION ALL SELECT 'previous', '2026.01.02.1', lang, count(*) FROM documents GROUP BY lang""",
    "lock_tree_t": """SELECT event_id || '/package-lock.json' AS path, 'n' || i AS name, i || '.' || (event_id % 10) || '.0' AS version, 'lockfile' AS scope
        FROM (SELECT event_id, unnest(range(1, CASE WHEN event_id % 200 = 7 THEN 41 ELSE 2 + user_id % 12 END)) AS i FROM events)""",
    "strict_json_t": """SELECT event_id AS id, unnest(['$.list[].b', '$.x']) AS field, 'unknown field' AS problem FROM events WHERE event_id % 5 = 1
        UNION ALL SELECT event_id, '$', 'not JSON' FROM events WHERE event_id % 5 IN (2, 3)""",
    "js_tables_t": """WITH p AS (SELECT *, p_partkey % 7 AS k FROM part)
        SELECT 'part' AS repo_id, p_partkey || '.js' AS path, 2 AS start_line, NULL AS gap, unnest([p_name || p_brand, p_type]) AS value FROM p WHERE k IN (0, 5, 6)
        UNION ALL SELECT 'part', p_partkey || '.js', 0, CASE WHEN k = 3 THEN 'dynamic string-table rotation' ELSE 'unsupported JavaScript literal expression' END, NULL FROM p WHERE k IN (1, 2, 3)
        UNION ALL SELECT 'order', o_orderkey || '.mjs', 2, NULL, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus ELSE o_orderpriority END FROM orders WHERE o_orderkey % 3 < 2""",
    "scan_lines_t": f"""WITH {CORPUS_SQL} SELECT f.repo_id, f.path, len(s.parts) AS lines, strlen(f.text) AS bytes,
        coalesce(list_max(list_transform(s.parts, lambda x: strlen(regexp_replace(x, '\\r$', '')))), 0) AS longest FROM files f JOIN split s USING (repo_id, path)""",
    "rule_match_custom_t": f"""WITH {CORPUS_SQL}, hits AS ({custom_rule_sql()})
        SELECT repo_id, path, rule_id, CASE WHEN path LIKE '%.html' THEN 'executable' ELSE 'documentation' END AS context,
               CASE WHEN rule_id = 'TXT-001' THEN 'high' ELSE 'medium' END AS severity_raw, line_no, n FROM hits WHERE n > 0""",
    "long_lines_t": f"""WITH {CORPUS_SQL} SELECT repo_id, path, line_no, strlen(line) AS bytes, CASE WHEN path LIKE '%.html' THEN 'executable' ELSE 'documentation' END AS context
        FROM lines WHERE strlen(line) > 600""",
    "line_entropy_t": f"""WITH {CORPUS_SQL}, b AS (
          SELECT repo_id, path, line_no, strlen(line) AS n, unnest(regexp_extract_all(hex(encode(line)), '..')) AS byte FROM lines WHERE strlen(line) >= 80
        ), c AS (SELECT repo_id, path, line_no, n, byte, count(*) AS k FROM b GROUP BY ALL),
        e AS (SELECT repo_id, path, line_no, round(sum(-(k / n) * log2(k / n)), 4) AS entropy FROM c GROUP BY repo_id, path, line_no)
        SELECT * FROM e WHERE entropy >= 4.5""",
    "redact_evidence_t": f"""WITH {CORPUS_SQL}, hit AS (SELECT path, line_no, line FROM lines WHERE regexp_matches(line, '(?i)token|password|secret')),
        r AS (SELECT path, line_no, regexp_replace(trim(line), '(?i)\\b(token|password|secret|api[_-]?key|access[_-]?token|client[_-]?secret)\\b\\s*[=:]\\s*(?:"(?:\\\\.|[^"])*"|''(?:\\\\.|[^''])*''|[^\\s,;]+)', '\\1=[REDACTED]', 'g') AS v FROM hit),
        w AS (SELECT path, line_no, array_to_string(list_transform(list_filter(string_split(v, ' '), lambda x: x <> ''),
              lambda x: CASE WHEN NOT contains(x, '[REDACTED]') AND (length(x) > 40 OR contains(lower(x), 'token=') OR contains(lower(x), 'password=')) THEN '[REDACTED]' ELSE x END), ' ') AS v FROM r)
        SELECT path, line_no, CASE WHEN length(v) > 160 THEN substr(v, 1, 160) || '…' ELSE v END AS evidence FROM w""",
    "content_hash_ioc_t": f"""WITH {CORPUS_SQL}, known AS (SELECT sha256(text) AS sha256, max('family' || CAST(doc_id AS varchar)) AS family FROM documents WHERE doc_id IN (3, 30, 77, 150) GROUP BY 1)
        SELECT repo_id, path, known.sha256, family FROM files JOIN known ON sha256(files.text) = known.sha256""",
    "duplicate_files_t": f"""WITH {CORPUS_SQL} SELECT sha256(text) AS sha256, count(*) AS copies, min(path) AS first_path, max(strlen(text)) AS bytes FROM files GROUP BY 1 HAVING count(*) > 1""",
    "repo_coverage_t": f"""WITH {CORPUS_SQL} SELECT repo_id, count(*) AS files_scanned, CAST(sum(CASE WHEN strlen(text) <= {MAX_BYTES} THEN strlen(text) ELSE 0 END) AS BIGINT) AS bytes_scanned,
        count(*) FILTER (WHERE strlen(text) > {MAX_BYTES}) AS skipped, bool_and(strlen(text) <= {MAX_BYTES}) AS complete FROM files GROUP BY repo_id""",
}
SQL["rule_match_custom_t"] = f"""WITH h AS ({SQL["rule_match_custom_t"]}), c AS (
    SELECT *, CASE WHEN context = 'documentation' AND rule_id <> 'TXT-000' AND severity_raw = 'high' THEN 'medium' ELSE severity_raw END AS severity,
           CASE WHEN context = 'documentation' OR rule_id = 'TXT-003' THEN 'low' ELSE 'medium' END AS confidence FROM h)
  SELECT repo_id, path, rule_id, context, severity, confidence, CASE WHEN confidence = 'low' THEN 'informational' ELSE 'review' END AS disposition,
         CAST(sum(n) AS BIGINT) AS occurrences, count(*) AS n_locations, min(line_no) AS line FROM c GROUP BY ALL"""
QUERIES = {name: globals()[name] for name in SQL}
