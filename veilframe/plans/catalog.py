"""The queries of the engine and the SQL that they are held against.

events and orders stand in for the job history, which the tables lack. The SQL's IPv4 rule has no look-behind (DuckDB knows
none); it is the same on the test tables, where no version word stands before an address, but not on larger ones (README).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths, scalars
from ..functions.automaton import masked_by_automaton, rule_totals
from ..functions.encoding import with_encoding, with_lines
from ..functions.masking import OUTSIDE, masked, with_ranges
from ..functions.rules import DEFAULT_RULES, FILENAME_FORMAT, NON_ASCII, category, fixed_width, keyword_table, rule_table
from ..operators import history, jobs
from ..operators.audit import audit, file_totals, job_total, unit_hits, with_keywords
from ..operators.boxes import fixed_cells, fixed_rows, range_boxes
from ..operators.sanitize import hit_rows, sanitized
from ..operators.tree import name_hits, with_renamed_paths
from ..sources.shared import new_path
from ..sources.text_ranges import checked_lines, line_units, scan_lines
from ..streaming import job_states
from ..streaming.upserts import History

QUERIES: dict = {}
ORACLES: dict = {}

MORE_RULES = [r"[\w.+-]+@[\w-]+\.[\w.]+", r"token", r"\b\d{13,16}\b", r"secret"]


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_rule(rule: str) -> str:
    """A rule in DuckDB's dialect: without look-behind and named groups."""
    while rule.startswith("(?<!"):
        rule = rule[rule.index(")") + 1 :]
    return "(?i)" + rule.replace("(?P<ipv4>", "(?:")


def sql_fold(source: str, column: str, rules: list[str], keys: str) -> str:
    """CTEs f0, f1, ...: keys, text t and counts n0, n1, ... after every step."""
    parts = [f"f0 AS (SELECT {keys}, regexp_replace({column}, {quoted(OUTSIDE)}, 'X', 'g') AS t, len(regexp_extract_all({column}, {quoted(OUTSIDE)}))::BIGINT AS n0 FROM {source})"]
    for i, rule in enumerate(rules, 1):
        p, width = quoted(sql_rule(rule)), fixed_width(rule)
        if width:
            new = f"regexp_replace(t, {p}, '{'X' * width}', 'g')"
        else:
            new = f"CASE WHEN regexp_matches(t, {p}) THEN array_to_string(list_transform(list_zip(string_split_regex(t, {p}), list_concat(list_transform(regexp_extract_all(t, {p}), lambda m: repeat('X', length(m))), [''])), lambda z: z[1] || z[2]), '') ELSE t END"
        parts.append(f"f{i} AS MATERIALIZED (SELECT * EXCLUDE (t), {new} AS t, len(regexp_extract_all(t, {p}))::BIGINT AS n{i} FROM f{i - 1})")
    return ",\n".join(parts)


def sql_total(rules: list[str]) -> str:
    return " + ".join(f"n{i}" for i in range(len(rules) + 1))


N = len(DEFAULT_RULES)
LINES = f"units AS (SELECT doc_id::VARCHAR AS file, unnest(regexp_extract_all(text, {quoted('[^\\r\\n]*(?:\\r\\n|\\r|\\n)|[^\\r\\n]+$')})) AS line, unnest(range(1, len(regexp_extract_all(text, {quoted('[^\\r\\n]*(?:\\r\\n|\\r|\\n)|[^\\r\\n]+$')})) + 1))::BIGINT AS ordinal FROM documents)"
KINDS = [NON_ASCII, *(category(r, i) for i, r in enumerate(DEFAULT_RULES, 1))]
HITS = f"WITH {LINES}, {sql_fold('units', 'line', DEFAULT_RULES, 'file, ordinal')}, hits AS (" + " UNION ALL ".join(f"SELECT file, ordinal, {quoted(k)} AS match_type, n{i} AS n FROM f{N} WHERE n{i} > 0" for i, k in enumerate(KINDS)) + ")"
AUDIT = HITS + ", audit AS (SELECT file, match_type, sum(n)::BIGINT AS occurrences, 'Line ' || min(ordinal) AS location FROM hits GROUP BY ALL)"


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as text units."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("file"), "text")
    return with_lines(docs, "text").select("file", F.col("line_no").cast("long").alias("ordinal"), F.concat(F.lit("Line "), "line_no").alias("location"), F.col("line").alias("text"))


@query(f"WITH {sql_fold('documents', 'text', [], 'doc_id')} SELECT doc_id, t AS masked, n0 AS n FROM f0")
def mask_nonascii(spark, sf_dir):
    return masked(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", []).select("doc_id", "masked", F.col("total").alias("n"))


@query(f"WITH {sql_fold('documents', 'text', DEFAULT_RULES, 'doc_id')} SELECT doc_id, t AS sanitized, {sql_total(DEFAULT_RULES)} AS total FROM f{N}")
def mask_documents(spark, sf_dir):
    return masked(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", DEFAULT_RULES).select("doc_id", F.col("masked").alias("sanitized"), "total")


@query(ORACLES["mask_documents"])
def mask_documents_python(spark, sf_dir):
    return masked(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", DEFAULT_RULES, native=False).select("doc_id", F.col("masked").alias("sanitized"), "total")


@query(f"WITH {sql_fold('pages', 'html', DEFAULT_RULES, 'page_id')} SELECT page_id, t AS sanitized, {sql_total(DEFAULT_RULES)} AS total FROM f{N}")
def mask_pages(spark, sf_dir):
    return masked(table(spark, sf_dir, "pages").select("page_id", "html"), "html", DEFAULT_RULES).select("page_id", F.col("masked").alias("sanitized"), "total")


@query(f"WITH {sql_fold('conversations', 'text', DEFAULT_RULES, 'conv_id, turn')} SELECT conv_id, turn, t AS sanitized, {sql_total(DEFAULT_RULES)} AS total FROM f{N}")
def mask_conversations(spark, sf_dir):
    return masked(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), "text", DEFAULT_RULES).select("conv_id", "turn", F.col("masked").alias("sanitized"), "total")


@query(f"WITH {sql_fold('documents', 'text', MORE_RULES, 'doc_id')} SELECT doc_id, t AS sanitized, {', '.join(f'n{i}' for i in range(len(MORE_RULES) + 1))} FROM f{len(MORE_RULES)}")
def mask_other_rules(spark, sf_dir):
    done = masked(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", MORE_RULES)
    return done.select("doc_id", F.col("masked").alias("sanitized"), *(F.col("hits")[i].alias(f"n{i}") for i in range(len(MORE_RULES) + 1)))


def benchmark_rules(spark: SparkSession, sf_dir: str) -> list[str]:
    """A long rule list: each word of the benchmark as a rule. Rule lists are on the driver, as always."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[a-z0-9_]+"), F.lit(0))).alias("word")).filter(F.col("word").rlike("^[a-z]{4,}$")).distinct()
    return [rf"\b{r['word']}\b" for r in words.orderBy("word").collect()]


MANY = f"""WITH known AS (SELECT word, row_number() OVER (ORDER BY word) AS place FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS word FROM benchmark) WHERE regexp_matches(word, '^[a-z]{{4,}}$')),
{sql_fold('documents', 'text', [], 'doc_id')},
tokens AS (SELECT doc_id, n0, unnest(regexp_extract_all(t, '[A-Za-z0-9_]+|[^A-Za-z0-9_]+')) AS token, unnest(range(len(regexp_extract_all(t, '[A-Za-z0-9_]+|[^A-Za-z0-9_]+')))) AS i FROM f0),
told AS (SELECT tokens.*, place FROM tokens LEFT JOIN known ON known.word = lower(token))"""


@query(MANY + """ SELECT doc_id, md5(coalesce(string_agg(CASE WHEN place IS NULL THEN token ELSE repeat('X', length(token)) END, '' ORDER BY i), '')) AS masked_md5, coalesce(max(told.n0), 0) + count(place) AS total, count(DISTINCT place) AS n_rules
FROM documents LEFT JOIN told USING (doc_id) GROUP BY doc_id""")
def mask_many_rules(spark, sf_dir):
    """Thousands of rules in one pass."""
    done = masked_by_automaton(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", benchmark_rules(spark, sf_dir))
    return done.select("doc_id", F.md5("masked").alias("masked_md5"), "total", F.size(F.filter("found", lambda f: f["place"] > 0)).cast("long").alias("n_rules"))


@query(MANY + ", counts AS (SELECT place, count(*) AS n FROM told GROUP BY place) SELECT place::INTEGER AS place, '\\b' || word || '\\b' AS rule, coalesce(n, 0)::BIGINT AS n FROM known LEFT JOIN counts USING (place) UNION ALL SELECT 0, NULL, sum(n0)::BIGINT FROM f0")
def many_rule_totals(spark, sf_dir):
    rules = benchmark_rules(spark, sf_dir)
    return rule_totals(masked_by_automaton(table(spark, sf_dir, "documents").select("text"), "text", rules), rules)


def sql_category() -> str:
    low = "lower(pattern)"
    has = lambda *parts: "(" + " AND ".join(f"contains({low}, {quoted(p)})" for p in parts) + ")"
    cases = [("Email Address", [has("@"), has("email")]), ("IPv4 Address", [has("ipv4"), has(r"\d{1,3}", r"\.")]), ("IPv6 Address", [has("ipv6"), has("[0-9a-f", ":")]), ("MAC Address", [has("mac"), has(":", "{6}")]), ("Credential / Secret", [has("password"), has("passwd"), has("secret"), has("token"), has("api", "key")]), ("URL", [has("http"), has("url")]), ("Hostname / Domain", [has("host"), has("domain")]), ("Identity", [has("user"), has("employee")])]
    return "CASE " + " ".join(f"WHEN {' OR '.join(tests)} THEN {quoted(name)}" for name, tests in cases) + " ELSE 'Custom Rule ' || rule_ix END"


CATALOG_RULES = [*DEFAULT_RULES, *MORE_RULES, r"([0-9a-f]{2}:){5}", r"https?://\S+", r"\bhost\d+\b", r"employee-\d+", r"api[_-]?key"]
RULES_SQL = f"""words AS (SELECT word, row_number() OVER (ORDER BY word) AS place FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS word FROM benchmark) WHERE regexp_matches(word, '^[a-z]{{4,}}$')),
listed(rule_ix, pattern) AS (SELECT * FROM (VALUES """ + ", ".join(f"({i}, {quoted(r)})" for i, r in enumerate(CATALOG_RULES, 1)) + f""") UNION ALL SELECT {len(CATALOG_RULES)} + place, '\\b' || word || '\\b' FROM words),
rules AS (SELECT rule_ix::INTEGER AS rule_ix, pattern, {sql_category()} AS kind FROM listed)"""


@query(f"WITH {RULES_SQL} SELECT rule_ix, pattern, kind FROM rules")
def rule_catalog(spark, sf_dir):
    """A rule list with the words of the benchmark in it."""
    return rule_table(spark, CATALOG_RULES + benchmark_rules(spark, sf_dir))


@query(f"WITH {RULES_SQL} SELECT kind, string_agg(pattern, ' | ' ORDER BY rule_ix) AS keywords FROM rules GROUP BY kind")
def rule_keywords(spark, sf_dir):
    return keyword_table(spark, CATALOG_RULES + benchmark_rules(spark, sf_dir))


@query(f"WITH {sql_fold('documents', 'text', DEFAULT_RULES, 'doc_id')} SELECT unnest(range({N + 1}))::INTEGER AS place, unnest([{', '.join(f'sum(n{i})' for i in range(N + 1))}])::BIGINT AS n FROM f{N}")
def rule_hits(spark, sf_dir):
    done = masked(table(spark, sf_dir, "documents").select("text"), "text", DEFAULT_RULES)
    return done.select(F.posexplode("hits").alias("place", "hit")).groupBy("place").agg(F.sum("hit").alias("n"))


@query(AUDIT + " SELECT * FROM audit")
def audit_lines(spark, sf_dir):
    return audit(unit_hits(document_lines(spark, sf_dir), DEFAULT_RULES))


@query(AUDIT + f", {RULES_SQL.replace('rules AS (SELECT rule_ix', 'known AS (SELECT rule_ix')} SELECT file, match_type, occurrences, location, coalesce(CASE WHEN match_type = {quoted(NON_ASCII)} THEN match_type END, (SELECT string_agg(pattern, ' | ' ORDER BY rule_ix) FROM known WHERE kind = match_type AND rule_ix <= {N}), match_type) AS keywords FROM audit")
def audit_keywords(spark, sf_dir):
    return with_keywords(audit(unit_hits(document_lines(spark, sf_dir), DEFAULT_RULES)), DEFAULT_RULES)


@query(HITS + " SELECT file, sum(n)::BIGINT AS replacements FROM hits GROUP BY file")
def summary_by_file(spark, sf_dir):
    return file_totals(unit_hits(document_lines(spark, sf_dir), DEFAULT_RULES))


@query(HITS + " SELECT sum(n)::BIGINT AS total_replacements FROM hits")
def job_total_hits(spark, sf_dir):
    return job_total(unit_hits(document_lines(spark, sf_dir), DEFAULT_RULES))


@query("SELECT doc_id, len(regexp_extract_all(text, '[^\\r\\n]*(?:\\r\\n|\\r|\\n)|[^\\r\\n]+$'))::BIGINT AS n_lines, sum(length(text))::BIGINT AS n_characters FROM documents WHERE text <> '' GROUP BY ALL")
def text_lines(spark, sf_dir):
    return with_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), "text").groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).cast("long").alias("n_characters"))


LAST = "list_extract(string_split(url, '/'), -1)"
SUFFIX = "CASE WHEN regexp_matches({0}, '[^.].*\\.[^.]+$') THEN regexp_extract({0}, '(\\.[^.]+)$', 1) ELSE '' END"


@query(f"""SELECT page_id, CASE WHEN c = '' THEN 'file' ELSE c END AS name, n FROM (SELECT page_id, regexp_replace(regexp_replace({LAST}, {quoted(paths.BAD_CHARACTER)}, 'X', 'g'), '[ .]+$', '') AS c, len(regexp_extract_all({LAST}, {quoted(paths.BAD_CHARACTER)}))::BIGINT AS n FROM pages)""")
def sanitize_names(spark, sf_dir):
    last = F.element_at(F.split("url", "/"), -1)
    return table(spark, sf_dir, "pages").select("page_id", paths.safe_name_column(last).alias("s")).select("page_id", "s.name", "s.n")


@query(f"""WITH p AS (SELECT page_id, list_filter(string_split(replace(url, '\\', '/'), '/'), lambda x: x NOT IN ('', '.', '..')) AS parts FROM pages)
SELECT page_id, array_to_string(list_transform(parts, lambda x: CASE WHEN regexp_replace(regexp_replace(x, {quoted(paths.BAD_CHARACTER)}, 'X', 'g'), '[ .]+$', '') = '' THEN 'file' ELSE regexp_replace(regexp_replace(x, {quoted(paths.BAD_CHARACTER)}, 'X', 'g'), '[ .]+$', '') END), '/') AS safe_path, len(parts)::INTEGER AS n_parts FROM p""")
def relative_paths(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", paths.safe_path_column(F.col("url")).alias("safe_path"), F.size(paths.components_column(F.col("url"))).alias("n_parts"))


FILE = "'f' || page_id || CASE page_id % 12 WHEN 0 THEN '.TXT' WHEN 1 THEN '.pdf' WHEN 2 THEN '.tar.gz' WHEN 3 THEN '.xlsx' WHEN 4 THEN '.exe' WHEN 5 THEN '.yaml' WHEN 6 THEN '.docx' WHEN 7 THEN '.zip' WHEN 8 THEN '' WHEN 9 THEN '.xls' WHEN 10 THEN '.tbz2' ELSE '.odd' END"
SQL_ARCHIVE = "CASE " + " ".join(f"WHEN ends_with(lower(name), '{x}') THEN '{x}'" for x in paths.COMPOUND) + f" ELSE {SUFFIX.format('lower(name)')} END"


def _in(values: list[str]) -> str:
    return ", ".join(map(quoted, values))


@query(f"""WITH n AS (SELECT page_id, {FILE} AS name FROM pages), s AS (SELECT *, {SUFFIX.format('lower(name)')} AS e, {SQL_ARCHIVE} AS a FROM n)
SELECT page_id, name, CASE WHEN e IN ('.pdf', '.docx', '.xlsx', '.xls') THEN substr(e, 2) WHEN a IN ({_in(paths.ARCHIVES)}) THEN 'archive' WHEN e IN ({_in(paths.BINARY)}) THEN 'binary' WHEN e IN ({_in(paths.TEXT + paths.TEXT_LIKE)}) THEN 'text' ELSE 'unknown' END AS format,
 a AS archive_suffix, CASE WHEN a IN ({_in(paths.ARCHIVES)}) THEN substr(name, 1, length(name) - length(a)) || '_SANITIZED' || substr(name, length(name) - length(a) + 1) ELSE substr(name, 1, length(name) - length(e)) || '_SANITIZED' || substr(name, length(name) - length(e) + 1) END AS download_name FROM s""")
def format_dispatch(spark, sf_dir):
    named = table(spark, sf_dir, "pages").select("page_id", F.expr(FILE).alias("name"))
    name = F.col("name")
    return named.select("page_id", "name", paths.format_column(name).alias("format"), paths.archive_suffix_column(name).alias("archive_suffix"), paths.download_name_column(name).alias("download_name"))


PATH_RULES = [r"\d+", "example", "html", r"host\w"]


@query(f"""WITH p AS (SELECT page_id, list_filter(string_split(replace(url, '\\', '/'), '/'), lambda x: x NOT IN ('', '.', '..')) AS parts FROM pages),
c AS (SELECT page_id, unnest(parts) AS part, unnest(range(len(parts))) AS place, len(parts) AS size FROM p),
s AS (SELECT page_id, place, size, regexp_replace(regexp_replace(part, {quoted(paths.BAD_CHARACTER)}, 'X', 'g'), '[ .]+$', '') AS clean, len(regexp_extract_all(part, {quoted(paths.BAD_CHARACTER)}))::BIGINT AS bad FROM c),
n AS (SELECT page_id, place, size, bad, CASE WHEN clean = '' THEN 'file' ELSE clean END AS name FROM s),
e AS (SELECT *, CASE WHEN place < size - 1 THEN 0 WHEN {SQL_ARCHIVE} IN ({_in(paths.ARCHIVES)}) THEN length({SQL_ARCHIVE}) ELSE length({SUFFIX.format('name')}) END AS w FROM n),
stems AS (SELECT page_id, place, bad, substr(name, 1, length(name) - w) AS stem, substr(name, length(name) - w + 1) AS tail FROM e),
{sql_fold('stems', 'stem', PATH_RULES, 'page_id, place, bad, tail')}
SELECT page_id, string_agg(t || tail, '/' ORDER BY place) AS masked_path, sum(bad + {sql_total(PATH_RULES)})::BIGINT AS n_masked FROM f{len(PATH_RULES)} GROUP BY page_id""")
def masked_paths(spark, sf_dir):
    done = paths.with_masked_paths(table(spark, sf_dir, "pages").select("page_id", "url"), "url", PATH_RULES)
    return done.select("page_id", "masked_path", F.aggregate(F.map_values("path_hits"), F.lit(0).cast("long"), lambda a, n: a + n).alias("n_masked"))


TREE = f"""WITH p AS (SELECT DISTINCT url, list_filter(string_split(replace(url, '\\', '/'), '/'), lambda x: x NOT IN ('', '.', '..')) AS parts FROM pages),
steps AS MATERIALIZED (SELECT url, place, len(parts) AS size, array_to_string(parts[:place], '/') AS node, array_to_string(parts[:place - 1], '/') AS folder, parts[place] AS part FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS place FROM p)),
nodes AS (SELECT node, folder, part, max(place = size) AS is_file FROM steps GROUP BY ALL),
c AS (SELECT *, regexp_replace(regexp_replace(part, {quoted(paths.BAD_CHARACTER)}, 'X', 'g'), '[ .]+$', '') AS clean, len(regexp_extract_all(part, {quoted(paths.BAD_CHARACTER)}))::BIGINT AS bad FROM nodes),
n AS (SELECT * EXCLUDE (clean), CASE WHEN clean = '' THEN 'file' ELSE clean END AS name FROM c),
e AS (SELECT *, CASE WHEN NOT is_file THEN 0 WHEN {SQL_ARCHIVE} IN ({_in(paths.ARCHIVES)}) THEN length({SQL_ARCHIVE}) ELSE length({SUFFIX.format('name')}) END AS w FROM n),
stems AS (SELECT node, folder, is_file, bad, substr(name, 1, length(name) - w) AS stem, substr(name, length(name) - w + 1) AS tail FROM e),
{sql_fold('stems', 'stem', PATH_RULES, 'node, folder, is_file, bad, tail')}"""


@query(TREE + f""", m AS (SELECT *, t || tail AS name FROM f{len(PATH_RULES)}),
k AS (SELECT node, name, {SUFFIX.format('name')} AS e, row_number() OVER (PARTITION BY folder, name ORDER BY CASE WHEN is_file THEN '0' ELSE '1' END || node) - 1 AS k FROM m),
named AS (SELECT node, CASE WHEN k = 0 THEN name ELSE substr(name, 1, length(name) - length(e)) || '_' || k || e END AS name FROM k),
whole AS (SELECT url, string_agg(name, '/' ORDER BY place) AS new_path FROM steps JOIN named USING (node) GROUP BY url)
SELECT page_id, new_path FROM pages JOIN whole USING (url)""")
def renamed_tree(spark, sf_dir):
    """All URLs as one tree of files and folders."""
    return with_renamed_paths(table(spark, sf_dir, "pages").select("page_id", "url"), "url", PATH_RULES).select("page_id", "new_path")


@query(TREE + ", h AS (" + " UNION ALL ".join(f"SELECT node, is_file, {quoted(k)} AS kind, {n} AS n FROM f{len(PATH_RULES)} WHERE {n} > 0" for k, n in [(FILENAME_FORMAT, "bad"), (NON_ASCII, "n0"), *((category(r, i), f"n{i}") for i, r in enumerate(PATH_RULES, 1))]) + ") SELECT node AS file, CASE WHEN is_file THEN 'Filename: ' ELSE 'Directory: ' END || kind AS match_type, sum(n)::BIGINT AS n FROM h GROUP BY ALL")
def tree_hits(spark, sf_dir):
    """What was masked in the names of the tree."""
    return name_hits(table(spark, sf_dir, "pages"), "url", PATH_RULES)


@query("""WITH n AS (SELECT doc_id, source AS folder, lang || '.txt' AS name FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY folder, name ORDER BY doc_id) - 1 AS k FROM n)
SELECT doc_id, folder, name, CASE WHEN k = 0 THEN name ELSE substr(name, 1, length(name) - 4) || '_' || k || '.txt' END AS unique_name FROM r""")
def unique_file_names(spark, sf_dir):
    named = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("folder"), F.concat("lang", F.lit(".txt")).alias("name"))
    return paths.with_unique_names(named, "folder", "name", "doc_id")


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as text files in folders."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.encode("text", "UTF-8").alias("content"))


@query(f"WITH {sql_fold('documents', 'text', DEFAULT_RULES, 'doc_id, source')} SELECT source || '/' || doc_id || '.txt' AS path, md5(t) AS content_md5, ({sql_total(DEFAULT_RULES)})::BIGINT AS total FROM f{N}")
def sanitize_files(spark, sf_dir):
    return sanitized(document_files(spark, sf_dir), DEFAULT_RULES).select("path", F.md5("content").alias("content_md5"), "total")


@query(AUDIT.replace("doc_id::VARCHAR AS file", "source || '/' || doc_id || '.txt' AS file") + " SELECT * FROM audit")
def sanitize_files_audit(spark, sf_dir):
    return audit(hit_rows(sanitized(document_files(spark, sf_dir), DEFAULT_RULES)))


def text_volumes(spark: SparkSession, sf_dir: str) -> str:
    """A folder of text files made of documents: a file for each source and thousand ids."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.lit("-"), F.expr("doc_id div 1000").cast("string")).alias("volume"), F.coalesce("text", F.lit("")).alias("value"))
    docs.repartition("volume").sortWithinPartitions("volume", "doc_id").select("volume", "value").write.partitionBy("volume").text(path := new_path(spark))
    return path


def volume(file):
    return F.regexp_extract(file, "^volume=([^/]*)/", 1)


LINE_SQL = quoted("[^\\r\\n]*(?:\\r\\n|\\r|\\n)|[^\\r\\n]+$")
VOLUMES = f"""volumes AS (SELECT source || '-' || doc_id // 1000 AS file, string_agg(coalesce(text, '') || chr(10), '' ORDER BY doc_id) AS text FROM documents GROUP BY ALL),
units AS (SELECT file, unnest(regexp_extract_all(text, {LINE_SQL})) AS line, unnest(range(1, len(regexp_extract_all(text, {LINE_SQL})) + 1))::BIGINT AS ordinal FROM volumes)"""


@query(f"WITH {VOLUMES} SELECT file, ordinal AS line_no, line FROM units")
def range_lines(spark, sf_dir):
    """Lines of files that are read by ranges of 64 kB."""
    lines = checked_lines(scan_lines(spark, text_volumes(spark, sf_dir), 64 << 10, whole_characters=True))
    return lines.select(volume(F.col("file")).alias("file"), "line_no", "line")


@query(AUDIT.replace(LINES, VOLUMES) + " SELECT * FROM audit")
def range_audit(spark, sf_dir):
    """The audit of the same files, read by ranges of 256 kB."""
    units = line_units(scan_lines(spark, text_volumes(spark, sf_dir), 256 << 10, whole_characters=True))
    return audit(unit_hits(units.withColumn("file", volume(F.col("file"))), DEFAULT_RULES))


@query()
def encoding_detect(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    text = F.col("text")
    forms = F.array(*(F.struct(F.lit(name).alias("form"), content.alias("content")) for name, content in (("utf-8", F.encode(text, "UTF-8")), ("utf-8 with mark", F.concat(F.lit(b"\xef\xbb\xbf"), F.encode(text, "UTF-8"))), ("utf-16-le", F.encode(text, "UTF-16LE")), ("utf-16-be with mark", F.concat(F.lit(b"\xfe\xff"), F.encode(text, "UTF-16BE"))), ("latin", F.encode(text, "ISO-8859-1")))))
    files = docs.select("doc_id", F.explode(forms).alias("f")).select("doc_id", "f.form", "f.content")
    return with_encoding(files).select("doc_id", "form", "codec", F.hex("mark").alias("mark"))


@query("SELECT event_id, ts, user_id, event_type FROM events ORDER BY ts DESC, event_id LIMIT 500")
def latest_events(spark, sf_dir):
    return jobs.latest(table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type"), 9999, "ts", "event_id")


@query("SELECT event_id, user_id, event_type, props FROM events WHERE contains(lower(event_id || '|' || user_id || '|' || event_type || '|' || coalesce(props, '')), '\"k\": 9')")
def history_search(spark, sf_dir):
    return jobs.search(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "props"), '"K": 9')


@query("SELECT count(*) AS jobs, count_if(event_type = 'purchase')::BIGINT AS done, count_if(event_type = 'error')::BIGINT AS failed, sum(user_id)::BIGINT AS replacements FROM (SELECT * FROM events)")
def kpis(spark, sf_dir):
    status = F.when(F.col("event_type") == "purchase", "Done").when(F.col("event_type") == "error", "Failed").otherwise("Queued")
    return jobs.figures(table(spark, sf_dir, "events").withColumn("status", status), amount="user_id")


NOW = "2024-01-31 00:00:00"


@query(f"SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 10 DAY")
def retention(spark, sf_dir):
    return jobs.retained(table(spark, sf_dir, "events").select("event_id", "ts"), F.lit(NOW).cast("timestamp_ntz" if dict(table(spark, sf_dir, "events").dtypes)["ts"] == "timestamp_ntz" else "timestamp"), 10, "ts")


def event_history(spark: SparkSession, sf_dir: str) -> str:
    """events as a history table in the warehouse; its name."""
    events = table(spark, sf_dir, "events")
    rows = events.select(F.col("event_id").cast("string").alias("job_id"), F.col("event_type").alias("status"), F.col("ts").cast("timestamp_ntz").alias("created_at"), "user_id")
    history.create(rows, name := f"veilframe_history_{uuid.uuid4().hex}")
    return name


@query("SELECT event_id::VARCHAR AS job_id, event_type AS status, user_id FROM events ORDER BY ts DESC, event_id::VARCHAR LIMIT 300")
def history_latest(spark, sf_dir):
    """The latest jobs from the last partitions of the table."""
    return history.latest(spark.table(event_history(spark, sf_dir)), 300).select("job_id", "status", "user_id")


@query("SELECT e.event_id::VARCHAR AS job_id, e.event_type AS status, f.user_id FROM events e JOIN events f USING (event_id) WHERE e.user_id % 3 = 0")
def history_join(spark, sf_dir):
    """A join of two bucketed tables by job: no exchange."""
    a, b = (spark.table(event_history(spark, sf_dir)) for _ in range(2))
    return a.filter("user_id % 3 = 0").select("job_id", "status").join(b.select("job_id", "user_id"), "job_id")


@query(f"SELECT event_id::VARCHAR AS job_id, event_type AS status, ts AS created_at FROM events WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 10 DAY - INTERVAL 5 HOUR OR (event_type = 'signup' AND user_id % 10 = 0)")
def history_purged(spark, sf_dir):
    """What a purge leaves of the table: some old jobs are in progress."""
    name = event_history(spark, sf_dir)
    active = table(spark, sf_dir, "events").filter("event_type = 'signup' and user_id % 10 = 0").select(F.col("event_id").cast("string").alias("job_id"))
    history.purge(spark, name, F.lit(NOW).cast("timestamp_ntz") - F.expr("INTERVAL '5' HOUR"), 10, active)
    return spark.table(name).select("job_id", "status", "created_at")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus IN ('O', 'P') THEN 'Failed' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def restart_fixup(spark, sf_dir):
    return jobs.after_restart(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), F.current_timestamp(), "o_orderstatus", ["O", "P"])


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'Queued' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice FROM orders")
def upsert_latest(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return jobs.upsert(orders, orders.filter("o_orderkey % 7 = 0").select("o_orderkey", F.lit("Queued").alias("o_orderstatus")), "o_orderkey")


@query("""SELECT o_orderkey::VARCHAR AS job_id, CASE WHEN o_orderkey % 7 = 0 THEN 'Queued' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 7 = 0 THEN 'second' END AS token, CASE WHEN o_orderkey % 7 = 0 THEN '[]' ELSE '["a"]' END AS filenames, CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE o_custkey END AS total_replacements,
 CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE o_totalprice END AS duration, CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE o_orderpriority END AS created_by FROM orders""")
def upsert_defaults(spark, sf_dir):
    """New rows have the defaults of the history; of two with one key the last stays."""
    orders = table(spark, sf_dir, "orders")
    kept = orders.select(F.col("o_orderkey").cast("string").alias("job_id"), F.col("o_orderstatus").alias("status"), F.lit(None).cast("string").alias("token"), F.lit('["a"]').alias("filenames"), F.col("o_custkey").cast("long").alias("total_replacements"), F.col("o_totalprice").cast("double").alias("duration"), F.col("o_orderpriority").alias("created_by"))
    new = orders.filter("o_orderkey % 7 = 0").select(F.col("o_orderkey").cast("string").alias("job_id"), F.lit("Queued").alias("status"))
    changes = new.withColumns({"token": F.lit("first"), "turn": F.lit(1)}).unionByName(new.withColumns({"token": F.lit("second"), "turn": F.lit(2)}))
    return jobs.upsert(kept, changes, order="turn")


@query(f"""SELECT o_orderkey, CASE WHEN o_orderstatus IN ('O', 'P') THEN coalesce(CASE WHEN o_custkey % 3 = 0 THEN 'told' END, 'Interrupted by application restart') WHEN o_custkey % 3 = 0 THEN 'told' END AS error, CASE WHEN o_orderstatus IN ('O', 'P') THEN TIMESTAMP '2024-01-31 00:00:00' END AS completed_at FROM orders""")
def restart_errors(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.when(F.col("o_custkey") % 3 == 0, "told").alias("error"), F.lit(None).cast("timestamp_ntz").alias("completed_at"))
    return jobs.after_restart(orders, F.lit(NOW).cast("timestamp_ntz"), "o_orderstatus", ["O", "P"]).select("o_orderkey", "error", "completed_at")


@query("""SELECT o_orderkey::VARCHAR AS job_id, o_orderstatus AS status, CASE WHEN o_orderstatus IN ('Done', 'Failed') THEN 100 END AS progress, CASE WHEN o_custkey % 2 = 0 THEN 'package' ELSE 'file' END AS output_type, o_totalprice::DOUBLE AS duration, o_custkey::BIGINT AS total_replacements
 FROM (SELECT * REPLACE (CASE o_orderstatus WHEN 'F' THEN 'Done' WHEN 'P' THEN 'Failed' ELSE 'Queued' END AS o_orderstatus) FROM orders)""")
def job_status(spark, sf_dir):
    state = F.when(F.col("o_orderstatus") == "F", "Done").when(F.col("o_orderstatus") == "P", "Failed").otherwise("Queued")
    history = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("job_id"), state.alias("status"), F.when(F.col("o_custkey") % 2 == 0, "/out/Sanitized_Package_1.zip").otherwise("/out/Sanitized_Package_1/a.txt").alias("output_path"), F.col("o_totalprice").cast("double").alias("duration"), F.col("o_custkey").cast("long").alias("total_replacements"))
    return jobs.status(jobs.with_columns_of(history, jobs.JOBS)).select("job_id", "status", "progress", "output_type", "duration", "total_replacements")


@query("""SELECT c_name AS username, CASE WHEN c_custkey % 5 = 0 THEN 'admin' WHEN c_acctbal > 0 THEN 'analyst' ELSE 'admin' END AS role, CASE WHEN c_custkey % 5 = 0 THEN 1 ELSE (c_acctbal > 0)::INTEGER END AS enabled FROM customer""")
def user_changes(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    role = F.when(F.col("c_acctbal") > 0, "analyst").otherwise("admin")
    known = jobs.with_columns_of(customers.select(F.col("c_name").alias("username"), role.alias("role"), (F.col("c_acctbal") > 0).cast("int").alias("enabled")), jobs.USERS)
    changed = jobs.with_user(known, customers.filter("c_custkey % 5 = 0").select(F.col("c_name").alias("username"), F.lit("admin").alias("role")))
    return changed.select("username", "role", "enabled")


def sql_state_fold() -> str:
    """A step of the states as SQL: s is the state so far, x the request (both as status, since and counts)."""
    late = f"(s.status IN ('Queued', 'Processing') AND x.since >= s.since + {job_states.TIMEOUT})"
    now = f"(CASE WHEN {late} THEN 'Failed' ELSE s.status END)"
    ok = f"(CASE x.status WHEN 'Queued' THEN {now} IN ('new', 'Done', 'Failed') WHEN 'Processing' THEN {now} = 'Queued' WHEN 'Done' THEN {now} = 'Processing' WHEN 'Failed' THEN {now} IN ('Queued', 'Processing') ELSE false END)"
    return f"struct_pack(status := CASE WHEN {ok} THEN x.status ELSE {now} END, since := CASE WHEN {ok} THEN x.since WHEN {late} THEN s.since + {job_states.TIMEOUT} ELSE s.since END, accepted := s.accepted + {ok}::BIGINT, refused := s.refused + (NOT {ok})::BIGINT, timeouts := s.timeouts + {late}::BIGINT)"


WANTED = "CASE event_type WHEN 'signup' THEN 'Queued' WHEN 'view' THEN 'Processing' WHEN 'purchase' THEN 'Done' WHEN 'error' THEN 'Failed' ELSE event_type END"


@query(f"""WITH g AS (SELECT user_id::VARCHAR AS job_id, list(struct_pack(status := {WANTED}, since := epoch_us(ts), accepted := 0::BIGINT, refused := 0::BIGINT, timeouts := 0::BIGINT) ORDER BY ts, event_id) AS l FROM events GROUP BY user_id),
f AS (SELECT job_id, list_reduce(l, lambda s, x: {sql_state_fold()}, struct_pack(status := 'new', since := 0::BIGINT, accepted := 0::BIGINT, refused := 0::BIGINT, timeouts := 0::BIGINT)) AS s FROM g),
t AS (SELECT *, s.status IN ('Queued', 'Processing') AND s.since + {job_states.TIMEOUT} <= (SELECT max(epoch_us(ts)) FROM events) AS late FROM f)
SELECT job_id, CASE WHEN late THEN 'Failed' ELSE nullif(s.status, 'new') END AS status, s.accepted AS accepted, s.refused AS refused, s.timeouts + late::BIGINT AS timeouts FROM t""")
def job_state_stream(spark, sf_dir):
    """States of jobs from events that arrive in two parts, the stream started anew between them."""
    events = table(spark, sf_dir, "events")
    rows = events.select(F.col("user_id").cast("string").alias("job_id"), F.col("ts").cast("timestamp").alias("at"), F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"), F.col("event_id").cast("long").alias("turn"), F.expr(WANTED).alias("wanted"))
    middle = rows.agg(F.avg("micros").cast("long")).first()[0] or 0
    folder, output, checkpoint = (new_path(spark) for _ in range(3))
    for part in (F.col("micros") < middle, F.col("micros") >= middle):
        rows.filter(part).write.mode("append").parquet(folder)
        job_states.follow(spark, folder, output, checkpoint).awaitTermination()
    return job_states.last_states(spark.read.schema(job_states.CHANGES).parquet(output))


@query("""SELECT o_orderkey::VARCHAR AS job_id, CASE WHEN o_orderkey % 11 = 0 THEN 'Done' WHEN o_orderkey % 7 = 0 THEN 'Queued' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 11 = 0 OR o_orderkey % 7 = 0 THEN 0 ELSE o_custkey END::BIGINT AS total_replacements FROM orders""")
def upsert_stream(spark, sf_dir):
    """orders and two sets of changes as a stream of upserts, one batch each."""
    orders = table(spark, sf_dir, "orders").withColumn("job_id", F.col("o_orderkey").cast("string"))
    whole = orders.select("job_id", F.col("o_orderstatus").alias("status"), F.col("o_custkey").cast("long").alias("total_replacements"))
    changes = [orders.filter(f"o_orderkey % {k} = 0").select("job_id", F.lit(status).alias("status"), F.lit(0).cast("long").alias("total_replacements")) for k, status in ((7, "Queued"), (11, "Done"))]
    folder, checkpoint, kept = (new_path(spark) for _ in range(3))
    history = History(spark, kept, whole.schema)
    for batch in (whole, *changes):
        batch.write.mode("append").parquet(folder)
        history.follow(spark.readStream.schema(whole.schema).parquet(folder), checkpoint).awaitTermination()
    return history.table()


@query("SELECT o_orderkey, CASE WHEN o_custkey = 370 THEN 'Done' ELSE o_orderstatus END AS status FROM orders")
def update_jobs(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderstatus").alias("status"))
    return jobs.update(orders, F.col("o_custkey") == 370, F.current_timestamp(), {"status": "Done", "o_orderkey": -1}).select("o_orderkey", "status")


@query("SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS k FROM events")
def props_json(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(F.from_json("props", "k long")["k"], F.lit(0)).alias("k"))


@query("SELECT conv_id, list(role ORDER BY turn) AS roles, string_agg(role, ', ' ORDER BY turn) AS joined FROM conversations GROUP BY conv_id")
def file_name_lists(spark, sf_dir):
    """Names as JSON arrays and back, as the history keeps them."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"])
    kept = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.to_json(ordered).alias("filenames"))
    return kept.select("conv_id", scalars.file_names(F.col("filenames")).alias("roles"), F.array_join(scalars.file_names(F.col("filenames")), ", ").alias("joined"))


@query("SELECT * FROM customer WHERE c_custkey = 37")
def job_lookup(spark, sf_dir):
    return jobs.job(table(spark, sf_dir, "customer"), "c_custkey", 37)


@query("SELECT c_name AS username, c_mktsegment AS role FROM customer ORDER BY c_name")
def user_list(spark, sf_dir):
    return jobs.users(table(spark, sf_dir, "customer").select(F.col("c_name").alias("username"), F.col("c_mktsegment").alias("role")))


@query("SELECT count(*) AS admins FROM customer WHERE c_mktsegment = 'MACHINERY' AND c_acctbal > 0")
def admin_count(spark, sf_dir):
    return jobs.admins(table(spark, sf_dir, "customer").select(F.when(F.col("c_mktsegment") == "MACHINERY", "admin").alias("role"), (F.col("c_acctbal") > 0).cast("int").alias("enabled")))


@query("SELECT line_no, value FROM (SELECT event_id AS line_no, event_type AS value FROM events ORDER BY event_id DESC LIMIT 500) ORDER BY line_no")
def log_tail(spark, sf_dir):
    return jobs.log_tail(table(spark, sf_dir, "events").select(F.col("event_id").alias("line_no"), F.col("event_type").alias("value")), 10_000)


@query("""SELECT o_orderkey::VARCHAR AS job_id, o_orderstatus = 'F' AS download_available, CASE WHEN o_orderstatus = 'F' AND o_custkey % 2 = 0 THEN '/download/' || o_orderkey || '?token=t' || o_custkey END AS download, coalesce(o_totalprice, 0) AS duration FROM orders""")
def public_jobs(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("job_id"), F.lit("Done").alias("status"), F.col("o_orderdate").alias("created_at"), F.lit(None).cast("timestamp").alias("completed_at"), F.lit(None).cast("string").alias("created_by"), F.lit("[]").alias("filenames"), F.lit(1).alias("total_replacements"), F.col("o_totalprice").alias("duration"), F.lit(None).cast("string").alias("error"), F.when(F.col("o_orderstatus") == "F", "out").alias("output_path"), F.lit("").alias("report_path"), F.when(F.col("o_custkey") % 2 == 0, F.concat(F.lit("t"), "o_custkey")).alias("token"))
    return jobs.public(orders).select("job_id", "download_available", "download", "duration")


@query("""SELECT event_id, greatest(least(user_id, 40), 5) AS clamped, 10 + floor(user_id / 100.0 * 70)::INTEGER AS progress, CASE WHEN event_id < 1024 THEN event_id || ' B' WHEN event_id < 1024 ** 2 THEN printf('%.1f KB', event_id / 1024.0) WHEN event_id < 1024 ** 3 THEN printf('%.1f MB', event_id / 1024.0 ** 2) WHEN event_id < 1024 ** 4 THEN printf('%.1f GB', event_id / 1024.0 ** 3) ELSE printf('%.1f TB', event_id / 1024.0 ** 4) END AS size,
 CASE WHEN regexp_matches(lower(trim(event_type)), '^[\\p{L}\\p{N}._\\-@]+$') THEN lower(trim(event_type)) END AS user_name, '/' AS target FROM events""")
def display_values(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return events.select("event_id", scalars.clamp(F.col("user_id"), 5, 40).alias("clamped"), scalars.progress(F.col("user_id"), F.lit(100)).alias("progress"), scalars.human_bytes(F.col("event_id")).alias("size"), scalars.user_name(F.col("event_type")).alias("user_name"), scalars.local_target(F.concat(F.lit("//"), "event_type")).alias("target"))


@query("SELECT doc_id, substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 260) AS example FROM documents")
def audit_examples(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", scalars.example(F.col("text")).alias("example"))


@query(f"WITH {sql_fold('documents', 'text', MORE_RULES, 'doc_id')}, h AS (" + " UNION ALL ".join(f"SELECT doc_id, {quoted(k)} AS kind, n{i} AS n FROM f{len(MORE_RULES)} WHERE n{i} > 0" for i, k in enumerate([NON_ASCII, *(category(r, i) for i, r in enumerate(MORE_RULES, 1))])) + ") SELECT doc_id, kind, sum(n)::BIGINT AS n FROM h GROUP BY ALL")
def match_ranges(spark, sf_dir):
    found = with_ranges(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", MORE_RULES)
    return found.select("doc_id", F.explode("ranges").alias("r")).groupBy("doc_id", "r.kind").agg(F.count("*").alias("n"))


def sql_ranges(rules: list[str]) -> str:
    """CTE ranges: doc_id, kind, start, stop of every match, from the lengths of the pieces between matches."""
    places = [f"SELECT doc_id, {quoted(NON_ASCII)} AS kind, text AS t FROM documents"] + [f"SELECT doc_id, {quoted(category(r, i))} AS kind, t FROM f{i - 1}" for i, r in enumerate(rules, 1)]
    total = lambda x: f"coalesce(list_sum(list_transform({x}, lambda y: length(y))), 0)::BIGINT"
    parts = "\nUNION ALL ".join(f"SELECT doc_id, kind, string_split_regex(t, {quoted(p)}) AS parts, regexp_extract_all(t, {quoted(p)}) AS found FROM ({sql}) WHERE regexp_matches(t, {quoted(p)})" for sql, p in zip(places, [OUTSIDE, *map(sql_rule, rules)]))
    return f"""pieces AS ({parts}),
starts AS (SELECT doc_id, kind, parts, found, unnest(range(1, len(found) + 1)) AS k FROM pieces),
ranges AS MATERIALIZED (SELECT doc_id, kind, {total('parts[:k]')} + {total('found[:k - 1]')} AS start, {total('parts[:k]')} + {total('found[:k]')} AS stop FROM starts)"""


BOX_RULES = [*MORE_RULES, r"\bthe\s+\w+"]


@query(f"""WITH {sql_fold('documents', 'text', BOX_RULES, 'doc_id')}, {sql_ranges(BOX_RULES)},
each AS (SELECT doc_id, string_split(text, chr(10)) AS rows FROM documents),
numbered AS (SELECT doc_id, unnest(rows) AS row, unnest(range(len(rows))) AS line FROM each),
lines AS MATERIALIZED (SELECT doc_id, line, coalesce(sum(length(row) + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first, length(row) AS size FROM numbered)
SELECT r.doc_id, kind, start::INTEGER AS start, stop::INTEGER AS "end", line::INTEGER AS line, (greatest(start, first) - first) * 6.0::DOUBLE AS x0, line * 12.0::DOUBLE AS y0, (least(stop, first + size) - first) * 6.0::DOUBLE AS x1, (line + 1) * 12.0::DOUBLE AS y1
FROM ranges r JOIN lines l ON l.doc_id = r.doc_id AND r.start < l.first + l.size AND r.stop > l.first""")
def match_boxes(spark, sf_dir):
    """Boxes around matches in documents that are laid out in cells of 6 by 12."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = with_ranges(docs, "text", BOX_RULES).select("doc_id", F.explode("ranges").alias("r")).select("doc_id", "r.*")
    return range_boxes(found, fixed_rows(docs, "doc_id", "text"), "doc_id", fixed_cells(6.0, 12.0)).select("doc_id", "kind", "start", "end", "line", *(F.col("box")[i].alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))))


RUNS = "regexp_extract_all(text, '[^ ]* |[^ ]+$')"


@query(f"""WITH {sql_fold('documents', 'text', MORE_RULES, 'doc_id, text')}, p AS (SELECT doc_id, t, unnest({RUNS}) AS run, unnest(range(len({RUNS}))) AS place FROM f{len(MORE_RULES)}),
q AS (SELECT *, coalesce(sum(length(run)) OVER (PARTITION BY doc_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p)
SELECT doc_id, place, substr(t, before::BIGINT + 1, length(run)) AS part FROM q""")
def run_redistribution(spark, sf_dir):
    """Masked texts cut into the runs that they came from: here words, each with the space behind it."""
    done = masked(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", MORE_RULES)
    runs = F.regexp_extract_all("text", F.lit(r"[^ ]* |[^ ]+$"), F.lit(0))
    cut = scalars.spread(done.select("doc_id", "masked", runs.alias("runs")), "doc_id", "masked", "runs")
    return cut.select("doc_id", F.col("place").cast("long").alias("place"), "part")


@query("SELECT user_id, min(value) AS x0, min(event_id)::DOUBLE AS y0, max(value) AS x1, max(event_id)::DOUBLE AS y1 FROM events GROUP BY user_id")
def union_boxes(spark, sf_dir):
    box = F.array("value", F.col("event_id").cast("double"), "value", F.col("event_id").cast("double"))
    boxes = table(spark, sf_dir, "events").groupBy("user_id").agg(scalars.box_around(box).alias("u"))
    return boxes.select("user_id", *(F.col("u")[i].alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))))


@query("SELECT DISTINCT event_type AS name, user_id AS size, props AS path FROM events")
def distinct_uploads(spark, sf_dir):
    return jobs.distinct_uploads(table(spark, sf_dir, "events").select(F.col("event_type").alias("name"), F.col("user_id").alias("size"), F.col("props").alias("path")))


@query("SELECT event_id, user_id, event_type, value FROM events")
def job_log_json(spark, sf_dir):
    """Jobs as JSON lines and back."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    return jobs.read_job_log(jobs.job_log(events), events.schema)


@query("SELECT count(*) AS files, sum(strlen(html))::BIGINT AS bytes, count(*) <= 10000 AND sum(strlen(html)) <= 4096::BIGINT * 1048576 AS within FROM pages")
def archive_limits(spark, sf_dir):
    return jobs.within_limits(table(spark, sf_dir, "pages").select(F.octet_length("html").alias("size")), "size")


@query("""WITH g AS (SELECT conv_id, list(role ORDER BY turn) AS names, list(turn::VARCHAR ORDER BY turn) AS paths FROM conversations GROUP BY conv_id), z AS (SELECT conv_id, unnest(names) AS name, unnest(CASE WHEN conv_id % 2 = 0 THEN paths ELSE names END) AS path, unnest(range(len(names)))::INTEGER AS place FROM g)
SELECT conv_id, place, name, path FROM z""")
def upload_pairs(spark, sf_dir):
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role")))
    grouped = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(ordered.alias("o"))
    names, paths_ = F.transform("o", lambda x: x["role"]), F.transform("o", lambda x: x["turn"].cast("string"))
    own = F.when(F.col("conv_id") % 2 == 0, paths_).otherwise(F.slice(paths_, F.lit(2), F.size(paths_)))
    return grouped.select("conv_id", F.posexplode(scalars.paired_paths(names, own)).alias("place", "p")).select("conv_id", "place", "p.name", "p.path")


def _packages(spark: SparkSession, sf_dir: str, end: str) -> DataFrame:
    """A generated archive or Office package for every conversation."""
    import pyarrow as pa

    from ..sources.samples import sample

    grouped = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("texts"))

    def build(batches):
        for batch in batches:
            made = [sample(end, texts) for texts in batch.column("texts").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([f"c{i}{end}" for i in batch.column("conv_id").to_pylist()]), pa.array(made, pa.binary())], names=["path", "content"])

    return grouped.mapInArrow(build, "path string, content binary")


def _package_query(name: str, end: str):
    def run(spark, sf_dir):
        return sanitized(_packages(spark, sf_dir, end), DEFAULT_RULES).select("path", "safe_path", "total", "error", F.length("content").alias("n_bytes"))

    run.__name__ = name
    query()(run)


for _name, _end in (("archive_roundtrip", ".zip"), ("tar_roundtrip", ".tar.gz"), ("docx_mask", ".docx"), ("xlsx_mask", ".xlsx")):
    _package_query(_name, _end)
