"""Registered queries of the engine's own operators over the driver tables, with the SQL that must return the same rows.

file = documents(doc_id, text, source); configuration = events.props; ordered edits = conversations.
Queries of code operators, in `code_queries` and `edit_queries`, run over corpora rendered from
all documents. Every query runs over its whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import config, text
from .operators import comments, duplicates, metrics, packaging, rules, transactions
from .operators.findings import Findings
from .operators.rules import Rule
from .sources.files import of_columns, read_documents
from .streaming import arrivals

# The scans that the driver's invented texts have matches for.
SCANS = [
    Rule("licence", "TODO_COMMENT", "low", "(?i)license"),
    Rule("e-mail", "HARDCODED_SECRET", "high", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
    Rule("IPv4 address", "HARDCODED_SECRET", "medium", r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b"),
    Rule("secret assignment", "HARDCODED_API_KEY", "critical", r"(?i)(api_?key|secret|password|token)\s*[=:]\s*\S+"),
]
IP = r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b"

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_END = r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x{85}\x{2028}\x{2029}]"
_LINES = f"""lines AS (SELECT path, module, unnest(range(1, len(own) + 1)) AS line_number, unnest(own) AS text FROM (
  SELECT path, module, CASE WHEN content IS NULL THEN [] WHEN parts[-1] = '' THEN parts[:-2] ELSE parts END AS own FROM (
    SELECT doc_id::VARCHAR AS path, source AS module, text AS content, string_split_regex(text, '{_END}') AS parts FROM documents)))"""
_BARE = r"regexp_replace(text, '^[\s\pZ\x85\x1c-\x1f]+|[\s\pZ\x85\x1c-\x1f]+$', '', 'g')"


@query("search_lines", f"WITH {_LINES} SELECT path, module, line_number::INT AS line_number, text, CASE WHEN {_BARE} = '' THEN 'blank' WHEN {_BARE} LIKE '#%' THEN 'comment' ELSE 'code' END AS kind FROM lines WHERE regexp_matches(text, '(?i)license')")
def search_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.search(read_documents(spark, sf_dir), "(?i)license")


@query("find_pattern_matches", rf"""
WITH m AS (SELECT doc_id::VARCHAR AS path, text, unnest(regexp_extract_all(text, '{IP}')) AS match, unnest(range(1, len(regexp_extract_all(text, '{IP}')) + 1)) AS nth, string_split_regex(text, '{IP}') AS cuts, regexp_extract_all(text, '{IP}') AS ms FROM documents),
s AS (SELECT path, nth, match, text, list_sum(list_transform(cuts[:nth], lambda x: len(x))) + coalesce(list_sum(list_transform(ms[:nth - 1], lambda x: len(x))), 0) AS start FROM m)
SELECT path, nth::INT AS nth, match AS text, start::INT AS start, (len(text[:start]) - len(replace(text[:start], chr(10), '')) + 1)::INT AS line_number, len(string_split(text[:start], chr(10))[-1])::INT AS "column" FROM s""")
def find_pattern_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.find_pattern(read_documents(spark, sf_dir), IP)


@query("replace_pattern_ip", rf"SELECT doc_id::VARCHAR AS path, md5(regexp_replace(text, '{IP}', '0.0.0.0', 'g')) AS new_md5 FROM documents WHERE regexp_matches(text, '{IP}')")
def replace_pattern_ip(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = read_documents(spark, sf_dir)
    edits = transactions.edits_of(files.where(F.col("content").rlike(IP)), text.replace_pattern("content", IP, "0.0.0.0"), "replace_pattern")
    return edits.select("path", F.md5(F.col("new").cast("binary")).alias("new_md5"))


@query("delete_and_indent_lines", rf"""
WITH {_LINES}, k AS (SELECT path, line_number - 1 AS n, text FROM lines WHERE line_number <> 1),
i AS (SELECT path, n, CASE WHEN n BETWEEN 1 AND 2 AND {_BARE} <> '' THEN '    ' || text ELSE text END AS text FROM k)
SELECT d.doc_id::VARCHAR AS path, md5(coalesce(string_agg(i.text, chr(10) ORDER BY n), '')) AS new_md5 FROM documents d LEFT JOIN i ON i.path = d.doc_id::VARCHAR GROUP BY d.doc_id""")
def delete_and_indent_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = text.indent(text.delete_lines("content", 1, 1), 1, 2)
    return read_documents(spark, sf_dir).select("path", F.md5(new.cast("binary")).alias("new_md5"))


def _scan_sql(select: str) -> str:
    one = "SELECT doc_id::VARCHAR AS file_path, text, '{n}' AS name, '{t}' AS type, '{s}' AS severity, unnest(regexp_extract_all(text, '{p}')) AS match, unnest(range(1, len(regexp_extract_all(text, '{p}')) + 1)) AS nth, string_split_regex(text, '{p}') AS cuts, regexp_extract_all(text, '{p}') AS ms FROM documents"
    rows = " UNION ALL ".join(one.format(n=r.name, t=r.type, s=r.severity, p=r.pattern.replace("'", "''")) for r in SCANS)
    return rf"""WITH m AS ({rows}),
h AS (SELECT *, list_reduce(list_transform(range(1, nth + 1), lambda k: cuts[k] || CASE WHEN k < nth THEN ms[k] ELSE '' END), lambda a, b: a || b) AS head FROM m),
l AS (SELECT *, (len(head) - len(replace(head, chr(10), '')) + 1)::INT AS line_number FROM h),
f AS (SELECT *, regexp_replace(string_split(text, chr(10))[line_number], '^[\s\pZ\x85\x1c-\x1f]+|[\s\pZ\x85\x1c-\x1f]+$', '', 'g') AS bare FROM l)
{select.format(f="(SELECT * FROM f WHERE bare NOT LIKE '#%')")}"""


def _found(spark: SparkSession, sf_dir: str) -> Findings:
    return Findings(rules.scan(read_documents(spark, sf_dir), SCANS))


@query("rule_scan", _scan_sql("SELECT file_path, line_number, name, type, severity, substr(bare, 1, 100) AS code_snippet FROM {f}"))
def rule_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir).df.select("file_path", "line_number", "name", "type", "severity", "code_snippet")


@query("findings_count_by_type", _scan_sql("SELECT type, severity, count(*) AS n FROM {f} GROUP BY ALL"))
def findings_count_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir).count_by("type", "severity")


@query("findings_count_by_file", _scan_sql("SELECT file_path, count(*) AS n FROM {f} GROUP BY ALL"))
def findings_count_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir).count_by("file_path")


@query("findings_at_least_high", _scan_sql("SELECT type, file_path AS file, line_number AS line, name, name || ' found' AS message, severity FROM {f} WHERE severity IN ('critical', 'high')"))
def findings_at_least_high(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir).at_least("high").to_dicts()


@query("findings_secrets_matching", _scan_sql("SELECT type, file_path AS file, line_number AS line, name, name || ' found' AS message, severity FROM {f} WHERE type LIKE 'HARDCODED%' AND regexp_matches(name, 'mail|IPv4')"))
def findings_secrets_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir).select_group("secrets").matching("mail|IPv4").to_dicts()


@query("findings_top_files", _scan_sql("SELECT file_path, count(*) AS n FROM {f} GROUP BY ALL ORDER BY n DESC, file_path LIMIT 20"))
def findings_top_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir).count_by("file_path").orderBy(F.desc("n"), "file_path").limit(20)


_METRICS = f"""{_LINES}, fm AS (SELECT d.doc_id::VARCHAR AS path, d.source AS module, false AS is_test, count(line_number)::INT AS total_lines,
  count(*) FILTER (WHERE line_number IS NOT NULL AND {_BARE.replace('(text,', '(l.text,')} = '')::INT AS blank_lines, count(*) FILTER (WHERE {_BARE.replace('(text,', '(l.text,')} LIKE '#%')::INT AS comment_lines
  FROM documents d LEFT JOIN lines l ON l.path = d.doc_id::VARCHAR GROUP BY d.doc_id, d.source)"""


@query("line_metrics_file", f"WITH {_METRICS} SELECT *, total_lines - blank_lines - comment_lines AS code_lines FROM fm")
def line_metrics_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.file_metrics(read_documents(spark, sf_dir))


_SUMS = "sum(total_lines)::BIGINT AS total_lines, sum(blank_lines)::BIGINT AS blank_lines, sum(comment_lines)::BIGINT AS comment_lines, sum(total_lines - blank_lines - comment_lines)::BIGINT AS code_lines"


@query("line_metrics_module", f"WITH {_METRICS} SELECT module, count(*) AS files, count(*) FILTER (WHERE is_test) AS test_files, {_SUMS}, 0.0::DOUBLE AS test_ratio FROM fm GROUP BY module")
def line_metrics_module(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.module_metrics(metrics.file_metrics(read_documents(spark, sf_dir)))


@query("project_summary", f"WITH {_METRICS} SELECT count(*) AS files, 0::BIGINT AS test_files, count(DISTINCT module) AS modules, {_SUMS}, avg(total_lines) AS avg_source_lines FROM fm")
def project_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.project_summary(metrics.file_metrics(read_documents(spark, sf_dir)))


@query("unlabelled_documents", "SELECT doc_id::VARCHAR AS path FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def unlabelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.unlabelled(read_documents(spark, sf_dir), table(spark, sf_dir, "labels"), "doc_id").select("path")


@query("duplicate_contents", "SELECT md5(text) AS content_md5, count(*) AS occurrences, min(doc_id::VARCHAR) AS first_path FROM documents GROUP BY 1 HAVING count(*) >= 2")
def duplicate_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.duplicate_contents(read_documents(spark, sf_dir))


@query("duplicate_lines", f"WITH {_LINES} SELECT {_BARE} AS line, count(*) AS occurrences, count(DISTINCT path) AS files, min(path) AS first_path FROM lines WHERE {_BARE} <> '' GROUP BY 1 HAVING count(*) >= 3")
def duplicate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.duplicate_lines(read_documents(spark, sf_dir))


@query("duplicate_block_members", "SELECT doc_id::VARCHAR AS file_path, 'DUPLICATE_CODE_BLOCK' AS type, n::DOUBLE AS value_num, first AS first_path FROM (SELECT doc_id, count(*) OVER w AS n, min(doc_id::VARCHAR) OVER w AS first FROM documents WINDOW w AS (PARTITION BY md5(text))) WHERE n >= 2")
def duplicate_block_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_documents(spark, sf_dir).select("path", F.md5(F.col("content").cast("binary")).alias("norm_hash"), F.lit(1).alias("start_line"), F.lit(None).cast("int").alias("end_line"), F.lit(None).cast("string").alias("context"), F.lit(None).cast("string").alias("source"))
    found = duplicates.duplicate_findings(rows, "DUPLICATE_CODE_BLOCK")
    return found.select("file_path", "type", "value_num", F.regexp_extract(F.col("context")["first"], "^(.*):", 1).alias("first_path"))


@query("config_get", "SELECT event_id, (props->>'$.k')::BIGINT AS k, coalesce(props->>'$.none', 'default') AS missing FROM events")
def config_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", config.get("props", "k", "bigint").alias("k"), config.get("props", "none", default="default").alias("missing"))


@query("config_has_key", "SELECT event_id, json_exists(props, '$.k') AS has_k, json_exists(props, '$.none') AS has_none FROM events")
def config_has_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", config.has_key("props", "k").alias("has_k"), config.has_key("props", "none").alias("has_none"))


@query("config_keys", "SELECT key, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS key FROM events) GROUP BY key")
def config_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.explode(config.keys("props")).alias("key")).groupBy("key").agg(F.count("*").alias("n"))


@query("config_set", """SELECT event_id, (props->>'$.k')::BIGINT AS k, 'a' AS b FROM events""")
def config_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = config.changed(config.set_value, "section.b", "a")(F.col("props"))
    rows = table(spark, sf_dir, "events").select("event_id", done.alias("done"))
    return rows.select("event_id", config.get(F.col("done.json"), "k", "bigint").alias("k"), config.get(F.col("done.json"), "section.b").alias("b"))


@query("transaction_fold", "SELECT conv_id::VARCHAR AS path, md5(min_by(text, turn)) AS original, md5(max_by(text, turn)) AS new, string_agg(role, '; ' ORDER BY turn, role) AS operation, count(*) AS n_edits FROM conversations GROUP BY conv_id")
def transaction_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    edits = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("path"), F.col("turn").alias("seq"), F.col("text").alias("original"), F.col("text").alias("new"), F.col("role").alias("operation"))
    folded = transactions.fold(edits)
    return folded.select("path", F.md5(F.col("original").cast("binary")).alias("original"), F.md5(F.col("new").cast("binary")).alias("new"), "operation", "n_edits")


@query("batch_result", "SELECT o_orderpriority AS priority, bool_and(o_totalprice > 1000) AS success, bool_or(o_totalprice > 1000) AS partial_success, bool_and(NOT o_totalprice > 1000) AS all_failed, count(*) AS n FROM orders GROUP BY o_orderpriority")
def batch_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("priority"), (F.col("o_totalprice") > 1000).alias("success"))
    return transactions.batch(results, ["priority"])


@query("link_matches", "SELECT page_id::VARCHAR AS path, link, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS link FROM pages) GROUP BY ALL")
def link_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = of_columns(table(spark, sf_dir, "pages"), "page_id", "html", "url")
    return pages.select("path", F.explode(F.regexp_extract_all("content", F.lit('href="([^"]*)"'), F.lit(1))).alias("link")).groupBy("path", "link").agg(F.count("*").alias("n"))


@query("stale_orders", "SELECT o_orderkey FROM orders WHERE o_orderdate::DATE < DATE '1998-08-02' - INTERVAL 90 DAY")
def stale_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").withColumn("date", F.to_date("o_orderdate"))
    return comments.stale(rows, 90, F.lit("1998-08-02").cast("date")).select("o_orderkey")


@query("windowed_counts", "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arrivals.windowed_counts(table(spark, sf_dir, "events")).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("normal_names", "SELECT lower(regexp_replace(p_name, '[-_.]+', '-', 'g')) AS name, count(*) AS n FROM part GROUP BY 1")
def normal_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy(packaging.normal_name("p_name").alias("name")).agg(F.count("*").alias("n"))


@query("bump_versions", "SELECT o_orderkey, (o_orderkey % 7) || '.' || (o_custkey % 5 + 1) || '.0' AS version FROM orders")
def bump_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.concat_ws(".", (F.col("o_orderkey") % 7).cast("string"), (F.col("o_custkey") % 5).cast("string"), F.lit("9-rc1"))
    return table(spark, sf_dir, "orders").select("o_orderkey", packaging.bump_version(own, "minor").alias("version"))
