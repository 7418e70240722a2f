"""Queries on records: fields, filters, files, batches, answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import parse
from ..operators import lines, scoring
from .registry import query, read


@query("SELECT page_id, p[1] AS f1, p[2] AS f2, p[3] AS f3, CASE WHEN len(p) > 3 THEN array_to_string(p[4:], '/') END AS f4 FROM (SELECT page_id, string_split(url, '/') AS p FROM pages)")
def surplus_fields(spark, d):
    """Fields by a delimiter; the last one takes what is left."""
    return read(spark, d, "pages").select("page_id", *lines.split_fields(F.col("url"), "/", 4))


@query("SELECT conv_id, turn, split_part(text, ' ', 1) AS f1, CASE WHEN len(string_split(text, ' ')) > 2 THEN split_part(text, ' ', 3) END AS f3 FROM (SELECT conv_id, turn, trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS text FROM conversations)")
def fields_by_place(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", *lines.fields(F.col("text"), 1, 3))


@query("SELECT doc_id, n_chars FROM documents ORDER BY doc_id DESC LIMIT 20")
def last_lines(spark, d):
    """The last rows, as the feature is."""
    return lines.last(read(spark, d, "documents").select("doc_id", "n_chars"), "doc_id", 20)


@query("SELECT source, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS bytes FROM documents GROUP BY source")
def usage_by_source(spark, d):
    return lines.usage(read(spark, d, "documents"), "source", "n_chars")


@query("SELECT conv_id, turn, CAST(line AS INTEGER) AS line, value FROM (SELECT conv_id, turn, unnest(string_split(text, '.')) AS value, generate_subscripts(string_split(text, '.'), 1) AS line FROM conversations) WHERE regexp_matches(value, '[Tt]he ')")
def content_search(spark, d):
    """Lines with their place that match a pattern, of all texts."""
    return lines.search(read(spark, d, "conversations"), ["conv_id", "turn"], "text", "[Tt]he ", end=".")


@query("SELECT page_id, regexp_replace(url, '[0-9]+', '#', 'g') AS url FROM pages")
def replace_all(spark, d):
    return read(spark, d, "pages").select("page_id", F.regexp_replace("url", "[0-9]+", "#").alias("url"))


@query("SELECT o_orderkey, coalesce(TRY_CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) > 2, false) AS above FROM orders")
def threshold_flag(spark, d):
    """A strict limit; what is no number is not above it."""
    return read(spark, d, "orders").select("o_orderkey", lines.above(F.substring("o_orderpriority", 1, 1), 2).alias("above"))


@query("SELECT role, count(*) FILTER (length(text) = 0) AS empty, count(*) FILTER (length(text) > 0) AS filled, count(*) FILTER (turn = 1) AS equal, count(*) FILTER (turn > 1) AS greater, count(*) FILTER (turn < 1) AS less FROM conversations GROUP BY role")
def string_tests(spark, d):
    tests = {"empty": F.col("text") == "", "filled": F.col("text") != "", "equal": F.col("turn") == 1, "greater": F.col("turn") > 1, "less": F.col("turn") < 1}
    return read(spark, d, "conversations").groupBy("role").agg(*[F.count_if(t).alias(n) for n, t in tests.items()])


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey < 300 AND o_orderstatus IN ('O', 'P')")
def state_filter(spark, d):
    """One user's jobs in some states."""
    return read(spark, d, "orders").where((F.col("o_custkey") < 300) & F.col("o_orderstatus").isin("O", "P")).select("o_orderkey", "o_custkey")


@query("SELECT page_id, coalesce(TRY_CAST(nullif(regexp_extract(url, '/([0-9]+)', 1), '') AS BIGINT), -1) AS number FROM pages")
def fallback_values(spark, d):
    return read(spark, d, "pages").select("page_id", F.coalesce(F.regexp_extract("url", "/([0-9]+)", 1).try_cast("long"), F.lit(-1)).cast("long").alias("number"))


@query("SELECT p_partkey, p_size AS task_id, s_suppkey FROM part LEFT JOIN (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS r FROM supplier) ON r = p_size")
def task_rows(spark, d):
    """Each task's row of a file by its 1-based number; tasks beyond the file get null."""
    rows = lines.row_index(read(spark, d, "supplier").select("s_suppkey"), "s_suppkey")
    return lines.rows_of_tasks(read(spark, d, "part").select("p_partkey", F.col("p_size").alias("task_id")), rows, "task_id", "row").select("p_partkey", "task_id", "s_suppkey")


@query("SELECT DISTINCT lang, source FROM documents")
def distinct_sorted(spark, d):
    return read(spark, d, "documents").select("lang", "source").distinct().orderBy("lang", "source")


@query("SELECT o_orderkey, o_orderkey % 7 + 1 AS expected, coalesce(n, 0) AS found, CASE WHEN coalesce(n, 0) >= o_orderkey % 7 + 1 THEN 'complete' ELSE 'incomplete' END AS status FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def expected_counts(spark, d):
    """Folders with the number of files that they should hold and do hold."""
    expected = read(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 7 + 1).alias("expected"))
    return lines.check_counts(expected, read(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "expected")


@query("SELECT page_id, row_number() OVER (ORDER BY url, page_id) AS row FROM pages")
def file_order(spark, d):
    """Sorted file names, numbered."""
    return lines.row_index(read(spark, d, "pages").select("url", "page_id"), "url", "page_id").select("page_id", "row")


@query("WITH a AS (SELECT source AS value FROM documents WHERE n_chars > 2000), b AS (SELECT source AS value FROM documents WHERE lang = 'en') SELECT value, '<' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT value, '>' AS side FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)")
def line_difference(spark, d):
    docs = read(spark, d, "documents")
    return lines.bag_difference(docs.where("n_chars > 2000").select(F.col("source").alias("value")), docs.where("lang = 'en'").select(F.col("source").alias("value")))


@query("SELECT p_partkey, coalesce(TRY_CAST(v AS DOUBLE), 0) AS number FROM (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_name ELSE CAST(p_size AS VARCHAR) END AS v FROM part)")
def numeric_keys(spark, d):
    """Numeric order, where what is no number counts as 0."""
    value = F.when(F.col("p_size") % 3 == 0, F.col("p_name")).otherwise(F.col("p_size").cast("string"))
    return read(spark, d, "part").select("p_partkey", lines.numeric_order(value).alias("number")).orderBy("number", "p_partkey")


@query("SELECT o_orderkey, o_orderdate AS source_time, t AS target_time, CASE WHEN t IS NULL THEN 'new' WHEN o_orderdate > t THEN 'newer' ELSE 'keep' END AS action FROM orders LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS t FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1) ON l_orderkey = o_orderkey")
def copy_plan(spark, d):
    """What a copy would do that leaves newer files of the target alone; carried out by nobody (a dry run)."""
    target = read(spark, d, "lineitem").where("l_linestatus = 'F'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("time"))
    return lines.copy_plan(read(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").alias("time")), target, "o_orderkey", "time")


@query("SELECT source, rpad(source, 24, ' ') || repeat('#', CAST(c * 20 // n AS INTEGER)) || repeat('.', CAST(20 - c * 20 // n AS INTEGER)) || ' ' || c || '/' || n AS line FROM (SELECT source, CAST(sum(quality) AS BIGINT) AS c, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY source)")
def report_bars(spark, d):
    answers = read(spark, d, "labels").join(read(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return scoring.summary(answers, "source", F.col("quality") == 1).select("source", scoring.report_line(F.col("source"), F.col("correct"), F.col("total")).alias("line"))


GRADED = """WITH r AS (SELECT lang AS student, doc_id AS q, CASE doc_id % 3 WHEN 0 THEN chr(9) || upper(substr(source, 4, 1)) || ' ' WHEN 1 THEN 'it is ' || upper(source) || '!' ELSE CASE WHEN n_chars > 1000 THEN 't' ELSE 'f' END END AS answer FROM documents),
b AS (SELECT doc_id AS q, doc_id % 3 AS kind, CASE doc_id % 3 WHEN 0 THEN ['1'] WHEN 1 THEN ['Src1', 'src2'] ELSE ['T'] END AS accepted, source AS category FROM documents)
SELECT student, q, CASE WHEN kind = 1 THEN len(list_filter(accepted, lambda x: contains(lower(answer), lower(x)))) > 0 ELSE upper(trim(answer, chr(9) || ' ')) = upper(accepted[1]) END AS correct, category FROM r JOIN b USING (q)"""


@query(GRADED)
def graded_answers(spark, d):
    """Letters without case, accepted strings anywhere in an answer, true and false."""
    docs, kind = read(spark, d, "documents"), F.col("doc_id") % 3
    answer = F.when(kind == 0, F.concat(F.lit("\t"), F.upper(F.substring("source", 4, 1)), F.lit(" "))).when(kind == 1, F.concat(F.lit("it is "), F.upper("source"), F.lit("!"))).otherwise(F.when(F.col("n_chars") > 1000, "t").otherwise("f"))
    accepted = F.when(kind == 0, F.array(F.lit("1"))).when(kind == 1, F.array(F.lit("Src1"), F.lit("src2"))).otherwise(F.array(F.lit("T")))
    bank = docs.select(F.col("doc_id").alias("q"), F.when(kind == 0, "mc").when(kind == 1, "fill").otherwise("tf").alias("kind"), accepted.alias("accepted"), F.col("source").alias("category"))
    return scoring.grade(docs.select(F.col("lang").alias("student"), F.col("doc_id").alias("q"), answer.alias("answer")), bank)


@query("""WITH a AS (SELECT l_orderkey AS k, l_linenumber AS q, l_returnflag = 'N' AS ok, l_linestatus AS c FROM lineitem), u AS (SELECT k, q, bool_or(ok) AS ok, min(c) AS c FROM a GROUP BY k, q),
c AS (SELECT k, string_agg('"' || c || '":{"correct":' || s || ',"total":' || n || '}', ',' ORDER BY c) AS m FROM (SELECT k, c, CAST(count(*) FILTER (ok) AS BIGINT) AS s, count(*) AS n FROM u GROUP BY k, c) GROUP BY k)
SELECT u.k AS l_orderkey, '{"l_orderkey":' || u.k || ',"score":' || CAST(count(*) FILTER (ok) AS BIGINT) || ',"total":' || count(*) || ',"answers":[' || string_agg('{"q":' || q || ',"correct":' || ok || ',"category":"' || u.c || '"}', ',' ORDER BY q) || '],"categories":{' || any_value(c.m) || '}}' AS body FROM u JOIN c ON c.k = u.k GROUP BY u.k""")
def result_json(spark, d):
    """Each student's nested document as JSON, with all answers in order."""
    items = read(spark, d, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").alias("q")).agg(F.bool_or(F.col("l_returnflag") == "N").alias("correct"), F.min("l_linestatus").alias("category"))
    docs = scoring.result_document(items, "l_orderkey").select("l_orderkey", "score", "total", "answers", "categories")
    return docs.select("l_orderkey", F.to_json(F.struct(*docs.columns)).alias("body"))


@query("SELECT event_id, s // 60 AS minutes, s % 60 AS seconds, greatest(s - 1800, 0) AS over FROM (SELECT event_id, CAST(floor(value * 25) AS BIGINT) AS s FROM events)")
def elapsed_parts(spark, d):
    return read(spark, d, "events").select("event_id", *parse.elapsed(F.floor(F.col("value") * 25).cast("long"), 1800))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS iso FROM orders")
def time_formats(spark, d):
    return read(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"))


@query("SELECT page_id, regexp_extract(url, '^(.*)/[^/]*$', 1) AS folder, regexp_extract(url, '([^/]*)$', 1) AS name FROM pages")
def path_parts(spark, d):
    return read(spark, d, "pages").select("page_id", *parse.path_parts(F.col("url")))


@query("SELECT page_id, substr(url, 1, 4) AS head, len(string_split(url, '/')) AS size, string_split(url, '/')[3] AS third FROM pages")
def array_parts(spark, d):
    """A part of a string by offset, an array's size and one of its elements."""
    parts = F.split("url", "/")
    return read(spark, d, "pages").select("page_id", F.substring("url", 1, 4).alias("head"), F.size(parts).cast("long").alias("size"), F.get(parts, F.lit(2)).alias("third"))
