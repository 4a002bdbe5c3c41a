"""More queries over the driver's tables: text functions, names and schemas, readers and writers, trees. Imported by catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalogue import EVALS, _views, judged_files, query, scored, table
from .functions import response, text
from .operators import cascade, linking, pairs, profile, vote
from .plans import distance, execute
from .sources import catalog, evalfiles, readers, writers
from .sources.shared import scratch

STRIPPED = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


def put(spark: SparkSession, path: str, value: str) -> None:
    """Writes a small file of a given name, wherever Spark can write."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(value.encode("utf-8")))
    finally:
        out.close()


# ---- responses and text

@query(rf"SELECT conv_id, turn, array_to_string(list_filter(list_transform(string_split(replace(replace({STRIPPED.format('text')}, chr(10), ' '), ' ', ','), ','), lambda x: {STRIPPED.format('x')}), lambda x: x <> ''), '|') AS tables FROM conversations")
def response_tables(spark, sf):
    rows = table(spark, sf, "conversations")
    return rows.select("conv_id", "turn", F.array_join(response.tables_of(F.replace(F.replace("text", F.lit("\n"), F.lit(" ")), F.lit(" "), F.lit(","))), "|").alias("tables"))


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'B' ELSE 'A' END AS selection, length('SELECT ' || turn) AS n FROM conversations")
def response_modes(spark, sf):
    rows = table(spark, sf, "conversations").withColumn("said", F.concat(F.lit("<answer>"), F.when(F.col("turn") % 2 == 0, "B").otherwise("A"), F.lit(" because "), "text", F.lit("</answer>")))
    sql = F.concat("text", F.lit("\n```sql\nSELECT "), F.col("turn").cast("string"), F.lit("\n```"))
    return rows.select("conv_id", "turn", response.parsed(F.col("said"), "selection").alias("selection"), F.length(response.parsed(sql, "sql")).cast("long").alias("n"))


@query(r"""SELECT doc_id, md5(regexp_replace(text, '\s', '', 'g')) AS solid, regexp_matches(text, '[\x{4e00}-\x{9fa5}]') AS cjk, regexp_matches(text, '[^\x{4e00}-\x{9fa5}]') AS other,
  coalesce(nullif(regexp_extract(text, '[0-9]+'), ''), nullif(regexp_extract(text, '[A-Z][a-z]+'), '')) AS first, len(regexp_extract_all(text, '[A-Z][a-z]+')) AS names FROM documents""")
def regex_helpers(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", F.md5(text.without_space(t)).alias("solid"), text.has_cjk(t).alias("cjk"), text.has_other_than_cjk(t).alias("other"), text.first_match(t, "[0-9]+", "[A-Z][a-z]+").alias("first"), F.size(text.all_matches(t, "[A-Z][a-z]+")).cast("long").alias("names"))


@query("SELECT p_partkey, 'CREATE TABLE t' || p_partkey || ' (' || p_name || chr(10) || p_type || ');' AS made FROM part")
def create_statements(spark, sf):
    said = F.concat(F.lit("-- "), "p_type", F.lit("\nCREATE TABLE t"), F.col("p_partkey").cast("string"), F.lit(" ("), "p_name", F.lit("\n"), "p_type", F.lit(");\nINSERT "), "p_name")
    return table(spark, sf, "part").select("p_partkey", F.array_join(text.create_statements(said), "|").alias("made"))


@query("""SELECT p_partkey, p_name || p_brand AS plain, regexp_matches(p_type, '[() /-]') AS special, CASE WHEN regexp_matches(p_type, '[() /-]') THEN '`' || p_type || '`' ELSE p_type END AS quoted, p_brand AS bare,
  TRY_CAST(p_size::VARCHAR AS DOUBLE) IS NOT NULL AS a, TRY_CAST(p_name AS DOUBLE) IS NOT NULL AS b FROM part""")
def quoted_names(spark, sf):
    whole = F.concat(F.lit('"'), "p_name", F.lit('"`'), "p_brand", F.lit("`"))
    return table(spark, sf, "part").select("p_partkey", text.without_quotes(whole).alias("plain"), text.needs_quotes(F.col("p_type")).alias("special"), text.quoted_if_needed(F.col("p_type")).alias("quoted"), text.unquoted(text.quoted(F.col("p_brand"))).alias("bare"), text.is_number(F.col("p_size").cast("string")).alias("a"), text.is_number(F.col("p_name")).alias("b"))


@query("SELECT doc_id, coalesce(nullif(regexp_replace(regexp_replace(text, '[^A-Za-z0-9_.-]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'eval-artifact') AS artifact FROM documents")
def artifact_names(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.artifact_name(F.col("text")).alias("artifact"))


@query("SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'no such column' WHEN 1 THEN 'no such table' WHEN 2 THEN 'syntax error' ELSE 'others' END AS kind FROM conversations")
def spark_error_kinds(spark, sf):
    said = F.element_at(F.array(*map(F.lit, ["[UNRESOLVED_COLUMN.X] ", "[TABLE_OR_VIEW_NOT_FOUND] ", "[PARSE_SYNTAX_ERROR] ", "odd "])), (F.col("turn") % 4 + 1).cast("int"))
    return table(spark, sf, "conversations").select("conv_id", "turn", text.spark_error_kind(F.concat(said, "text")).alias("kind"))


TURNS = "FROM conversations a JOIN conversations u ON a.conv_id = u.conv_id AND u.turn = a.turn - 1"


def _turns(spark, sf) -> DataFrame:
    rows = table(spark, sf, "conversations")
    return rows.join(rows.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("before")), ["conv_id", "turn"])


@query(f"""SELECT a.conv_id, a.turn, md5('Question:' || chr(10) || u.text || chr(10) || chr(10) || 'Candidate A:' || chr(10) || a.text || chr(10) || 'Result:' || chr(10) || a.role || chr(10) || chr(10) || 'Candidate B:' || chr(10) || u.text || chr(10) || 'Result:' || chr(10) || chr(10) || chr(10) || 'Which candidate is correct? Answer A or B.') AS vote,
  md5('Database Schema:' || chr(10) || a.role || chr(10) || chr(10) || 'Question:' || chr(10) || u.text || chr(10) || chr(10) || 'Draft query:' || chr(10) || a.text || chr(10) || 'Its result:' || chr(10) || chr(10) || chr(10) || 'Return the corrected query.') AS revision,
  md5('Database Schema:' || chr(10) || a.role || chr(10) || chr(10) || 'Question:' || chr(10) || u.text || chr(10) || chr(10) || 'Candidate queries:' || chr(10) || '#1: ' || a.text || chr(10) || '#2: ' || u.text || chr(10) || chr(10) || 'Return one query.') AS merge,
  md5('Here are some reference examples:' || chr(10) || '#Example Question: ' || replace(u.text, chr(10), ' ') || chr(10) || a.text || chr(10) || '#Answer: `' || u.text || '`' || chr(10)) AS examples {TURNS}""")
def prompts_built(spark, sf):
    q, a, schema, none = F.col("before"), F.col("text"), F.col("role"), F.lit(None).cast("string")
    examples = F.array(F.struct(a.alias("question"), q.alias("sql"), q.alias("evidence")))
    return _turns(spark, sf).select("conv_id", "turn", F.md5(text.vote_prompt(q, a, schema, q, none)).alias("vote"), F.md5(text.revision_prompt(q, a, none, schema)).alias("revision"), F.md5(text.merge_prompt(q, F.array(a, q), schema)).alias("merge"), F.md5(text.examples_section(examples)).alias("examples"))


# ---- schema text

@query("""WITH n AS (SELECT n_regionkey AS k, string_agg('Table ' || n_name || '(' || n_nationkey || ', n_name)', chr(10) ORDER BY n_nationkey) AS t FROM nation GROUP BY 1),
  q AS (SELECT n_regionkey AS k, string_agg('table ' || n_name || ' , columns = [ ' || n_name || '.`a b` ( TEXT | primary key | values : x , ' || n_nationkey || ' ) , ' || n_name || '.c ( INT | comment : of ' || n_name || ' ) ]', chr(10) ORDER BY n_nationkey) AS t FROM nation GROUP BY 1),
  m AS (SELECT n_regionkey AS k, string_agg(n_name || '.`a b` ( x , ' || n_nationkey || ' )', chr(10) ORDER BY n_nationkey) AS t FROM nation GROUP BY 1)
  SELECT r_regionkey, n.t || chr(10) || 'FK: a -> ' || r_name || '.b' AS section, 'database schema :' || chr(10) || q.t || chr(10) || 'foreign keys :' || chr(10) || CASE WHEN regexp_matches(r_name, '[() /-]') THEN '`' || r_name || '`' ELSE r_name END || '.a = `x y`.b' AS sequence, 'matched contents :' || chr(10) || m.t AS matches
  FROM region JOIN n ON n.k = r_regionkey JOIN q ON q.k = r_regionkey JOIN m ON m.k = r_regionkey""")
def schema_texts(spark, sf):
    key = F.col("n_nationkey").cast("string")
    none = F.array().cast("array<string>")
    columns = F.array(F.struct(F.lit("a b").alias("name"), F.lit("TEXT").alias("type"), F.lit(True).alias("is_pk"), F.lit("").alias("comment"), F.array(F.lit("x"), key).alias("contents")), F.struct(F.lit("c").alias("name"), F.lit("INT").alias("type"), F.lit(False).alias("is_pk"), F.concat(F.lit("of "), "n_name").alias("comment"), none.alias("contents")))
    rows = table(spark, sf, "nation").select("n_regionkey", "n_nationkey", F.struct("n_nationkey", F.col("n_name").alias("name"), F.array(key, F.lit("n_name")).alias("columns")).alias("s"), F.struct("n_nationkey", F.col("n_name").alias("name"), columns.alias("columns")).alias("q"), F.struct("n_nationkey", F.col("n_name").alias("table_name"), F.lit("a b").alias("column_name"), F.array(F.lit("x"), key).alias("contents")).alias("m"))
    listed = lambda c: F.transform(F.array_sort(F.collect_list(c)), lambda x: x.dropFields("n_nationkey")).alias(c)
    rows = rows.groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(listed("s"), listed("q"), listed("m")).join(table(spark, sf, "region"), "r_regionkey")
    links = F.array(F.struct(F.lit("a").alias("column"), F.col("r_name").alias("to_table"), F.lit("b").alias("to_column")))
    wide = F.array(F.struct(F.col("r_name").alias("from_table"), F.lit("a").alias("from_column"), F.lit("x y").alias("to_table"), F.lit("b").alias("to_column")))
    return rows.select("r_regionkey", text.schema_section(F.col("s"), links).alias("section"), text.schema_sequence(F.col("q"), wide).alias("sequence"), text.matched_sequence(F.col("m")).alias("matches"))


def _metadata(spark, sf) -> DataFrame:
    """Schema metadata of a database for each region: its nations are tables with a key and a name."""
    rows = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x["n_name"]).alias("table_names_original"))
    column = lambda i, n: F.array(i.cast("string"), n)
    each = F.flatten(F.transform("table_names_original", lambda t, i: F.array(column(i, F.lit("id")), column(i, F.concat(t, F.lit("_x"))))))
    count = F.size("table_names_original")
    return rows.select(
        F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("db_id"), "table_names_original", F.concat(F.array(F.array(F.lit("-1"), F.lit("*"))), each).alias("column_names_original"),
        F.concat(F.array(F.lit("text")), F.flatten(F.transform("table_names_original", lambda t: F.array(F.lit("number"), F.lit("text"))))).alias("column_types"),
        F.transform(F.sequence(F.lit(0), count - 1), lambda i: (i * 2 + 1).cast("string")).alias("primary_keys"), F.array(F.array(F.lit(1), F.lit(3)), F.array(F.lit(1), F.lit(999))).alias("foreign_keys"),
    )


META = "n AS (SELECT 'r' || n_regionkey AS db_id, n_name AS t, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS i FROM nation)"


@query(f"""WITH {META} SELECT db_id, t AS table_name, unnest(['id', t || '_x']) AS column_name, unnest(['NUMBER', 'TEXT']) AS col_type, unnest([true, false]) AS is_pk, unnest([2 * i + 1, 2 * i + 2])::BIGINT AS ordinal FROM n""")
def metadata_columns(spark, sf):
    return readers.catalog_columns(_metadata(spark, sf)).withColumn("ordinal", F.col("ordinal").cast("long"))


@query(f"WITH {META} SELECT a.db_id, a.t AS from_table, 'id' AS from_column, b.t AS to_table, 'id' AS to_column FROM n a JOIN n b ON a.db_id = b.db_id AND a.i = 0 AND b.i = 1")
def metadata_keys(spark, sf):
    return readers.catalog_keys(_metadata(spark, sf))


@query(f"WITH {META} SELECT db_id, string_agg(lower(t) || '=id+' || t || '_x', ',' ORDER BY lower(t)) AS tables FROM n GROUP BY 1")
def schema_maps(spark, sf):
    maps = readers.schema_map(readers.catalog_columns(_metadata(spark, sf)))
    return maps.select("db_id", F.array_join(F.transform(F.map_entries("tables"), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], "+"))), ",").alias("tables"))


@query(f"WITH {META} SELECT db_id, count(*) AS n_tables, 2 * count(*) AS n_columns, count(*) AS n_keys FROM n GROUP BY 1")
def catalog_counts(spark, sf):
    return catalog.table_counts(readers.catalog_columns(_metadata(spark, sf)))


@query("SELECT * FROM (VALUES ('nation', 'n_nationkey', 'INT', 0::BIGINT), ('nation', 'n_name', 'STRING', 1), ('nation', 'n_regionkey', 'INT', 2), ('region', 'r_regionkey', 'INT', 0), ('region', 'r_name', 'STRING', 1)) AS t(table_name, column_name, col_type, ordinal)")
def spark_catalog(spark, sf):
    _views(spark, sf)
    return catalog.spark_columns(spark).filter("table_name in ('nation', 'region')").select("table_name", "column_name", "col_type", F.col("ordinal").cast("long").alias("ordinal"))


@query("SELECT c_nationkey AS question_id, 'customer' AS table_name, 'c_name' AS columns FROM customer GROUP BY 1")
def restored_columns(spark, sf):
    said = table(spark, sf, "customer").select(F.col("c_nationkey").alias("question_id")).distinct().withColumns({"table_name": F.lit("customer"), "columns": F.array(F.lit("C_NAME"), F.lit("unknown"))})
    _views(spark, sf)
    known = catalog.spark_columns(spark).select("table_name", "column_name", "ordinal")
    return linking.restored_columns(said, known).select("question_id", "table_name", F.array_join("columns", ",").alias("columns"))


# ---- names, lines and files

@query("""SELECT o_orderkey, o_orderkey AS sample_id, '/db/' || o_orderpriority || '/' || o_orderpriority || '.sqlite' AS path, CASE WHEN o_orderkey % 2 = 0 THEN '/db/' || o_orderkey || '.sqlite' ELSE '/db/' || o_orderkey || '/' || o_orderkey || '.sqlite' END AS flat, o_orderkey || '_x_ast.json' AS tree FROM orders""")
def file_names(spark, sf):
    key, db = F.col("o_orderkey").cast("string"), F.col("o_orderpriority")
    name = F.concat(key, F.lit("_x_eval.json"))
    there = F.when(F.col("o_orderkey") % 2 == 0, F.array(F.concat(F.lit("/db/"), key, F.lit(".sqlite")))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf, "orders").select("o_orderkey", readers.sample_id_of(name).alias("sample_id"), readers.database_path(F.lit("/db"), db).alias("path"), readers.database_path(F.lit("/db"), key, there).alias("flat"), readers.tree_file_name(name).alias("tree"))


@query("""SELECT conv_id * 1000 + turn AS index, trim(q) AS sql, CASE turn % 3 WHEN 0 THEN 'bird_db' WHEN 1 THEN 'tab_db' ELSE role END AS db_id FROM (SELECT conv_id, turn, role, regexp_replace(replace(replace(text, chr(9), ' '), chr(10), ' '), '\\s+$', '') AS q FROM conversations) WHERE length(q) > 0""")
def packed_lines(spark, sf):
    rows = table(spark, sf, "conversations").withColumn("q", F.trim(F.regexp_replace(F.replace(F.replace("text", F.lit("\t"), F.lit(" ")), F.lit("\n"), F.lit(" ")), r"\s+$", ""))).filter("length(q) > 0").withColumn("index", F.col("conv_id") * 1000 + F.col("turn"))
    value = F.when(F.col("turn") % 3 == 0, F.concat("q", F.lit(readers.SEPARATORS[0] + "bird_db"))).when(F.col("turn") % 3 == 1, F.concat("q", F.lit(readers.SEPARATORS[2] + "tab_db"))).otherwise(F.col("q"))
    return readers.packed_sql(rows.select("index", value.alias("value")), rows.select("index", F.col("role").alias("db_id")))


@query("SELECT o_custkey AS index, string_agg('q' || o_orderkey || ':s' || o_orderkey, ',' ORDER BY o_orderkey) AS examples FROM orders GROUP BY 1")
def few_shot_examples(spark, sf):
    o = table(spark, sf, "orders")
    listed = F.array_join(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda x: x.cast("string")), ",")
    lines = o.groupBy(F.col("o_custkey").alias("index")).agg(listed.alias("l")).select("index", F.concat(F.col("index").cast("string"), F.lit(", "), "l").alias("value"))
    train = o.select(F.col("o_orderkey").alias("sample_id"), F.concat(F.lit("q"), F.col("o_orderkey").cast("string")).alias("question"), F.concat(F.lit("s"), F.col("o_orderkey").cast("string")).alias("SQL"), F.lit("").alias("evidence"))
    return readers.few_shots(lines, train).select("index", F.array_join(F.transform("examples", lambda e: F.concat(e["question"], F.lit(":"), e["sql"])), ",").alias("examples"))


@query("SELECT n_nationkey::BIGINT AS sample_id, 'd' || n_regionkey AS db_id, n_name AS question, 'SELECT ' || n_nationkey AS sql FROM nation")
def items_read(spark, sf):
    """Items written as one JSON array and read by place."""
    one = F.struct("n_nationkey", F.concat(F.lit("d"), F.col("n_regionkey").cast("string")).alias("db_id"), F.col("n_name").alias("question"), F.concat(F.lit("SELECT "), F.col("n_nationkey").cast("string")).alias("query"))
    table(spark, sf, "nation").agg(F.to_json(F.transform(F.array_sort(F.collect_list(one)), lambda x: x.dropFields("n_nationkey")))).coalesce(1).write.text(path := scratch(spark))
    return readers.items(spark, path).select("sample_id", "db_id", "question", F.col("SQL").alias("sql"))


def _candidate_files(spark, sf) -> str:
    """A folder of candidate files, two records for each supplier, with files of trees and others among them; tasks write them."""
    s = table(spark, sf, "supplier")
    key, of = F.col("s_suppkey").cast("string"), F.concat(F.lit("SELECT "), F.col("s_nationkey").cast("string"))
    first = F.struct(F.array(F.concat(F.lit(" "), of, F.lit(" ")), F.lit(""), F.lit(None).cast("string"), F.lit("SELECT 2")).alias("all_sqls"))
    value = F.to_json(F.array(first, F.struct(F.array(of).alias("all_sqls"))), {"ignoreNullFields": "false"})
    one = lambda name, v: F.struct(name.alias("name"), v.alias("value"))
    files = s.select(F.explode(F.array(one(F.concat(key, F.lit("_x.json")), value), one(F.concat(key, F.lit("_x_ast.json")), F.lit("[]")), one(F.concat(F.lit("notes"), key, F.lit(".json")), F.lit("{}")))).alias("f"))
    writers.named_files(files.select("f.*"), folder := scratch(spark))
    return folder


@query("SELECT s_suppkey AS sample_id, s_suppkey || '_x.json' AS name FROM supplier ORDER BY 1 LIMIT 7")
def sample_files(spark, sf):
    return readers.sample_files(spark, _candidate_files(spark, sf), 7).select("sample_id", "name")


@query("SELECT s_suppkey AS sample_id, s_suppkey || '_x.json' AS file, unnest([0, 0, 1])::BIGINT AS record_index, unnest([0, 3, 0])::BIGINT AS sql_index, unnest(['SELECT ' || s_nationkey, 'SELECT 2', 'SELECT ' || s_nationkey]) AS sql FROM supplier")
def candidates_read(spark, sf):
    found = readers.candidates(spark, _candidate_files(spark, sf))
    return found.select("sample_id", "file", F.col("record_index").cast("long").alias("record_index"), F.col("sql_index").cast("long").alias("sql_index"), "sql")


@query(f"WITH {EVALS} SELECT sid AS sample_id, sid || '_x_eval.json' AS name, set_name, count(*) AS records, string_agg(sql, ';' ORDER BY record_index) AS sqls FROM r GROUP BY ALL")
def eval_files_discovered(spark, sf):
    """Files of judged candidates, one for each sample among others, written by tasks, discovered and read."""
    made = judged_files(spark, sf).select(F.col("file").alias("name"), "value")
    noise = made.select(F.regexp_replace("name", "_eval", "_ast").alias("name"), "value").unionAll(made.select(F.concat(F.lit("x"), "name"), F.lit("{")))
    writers.named_files(made.unionAll(noise), folder := scratch(spark))
    found = evalfiles.eval_files(spark, folder).select("sample_id", "name")
    records = evalfiles.eval_records(evalfiles.eval_texts(spark, folder))
    sets = records.groupBy("file", "set_name").agg(F.count("*").alias("records"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("record_index", "sql"))), lambda x: x["sql"]), ";").alias("sqls"))
    return found.join(sets, F.col("file") == F.col("name")).select("sample_id", "name", "set_name", "records", "sqls")


@query("SELECT conv_id, turn, role, text FROM conversations")
def json_lines_written(spark, sf):
    """Whole texts as JSON lines and back, strictly."""
    writers.json_lines(table(spark, sf, "conversations"), path := scratch(spark))
    return readers.json_lines(spark, path, "conv_id long, turn long, role string, text string")


@query("SELECT conv_id AS sample_id, count(*) AS n, string_agg(md5(text), ',' ORDER BY turn) AS texts FROM conversations GROUP BY 1")
def samples_written(spark, sf):
    """A folder for each sample, read back as one table."""
    writers.by_sample(table(spark, sf, "conversations").withColumnRenamed("conv_id", "sample_id"), path := scratch(spark))
    back = spark.read.schema("turn long, role string, text string, sample_id long").json(path)
    return back.groupBy("sample_id").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.md5("text").alias("m")))), lambda x: x["m"]), ",").alias("texts"))


@query("SELECT event_id, event_id % 7 <> 0 AS valid_json, CASE WHEN event_id % 7 <> 0 THEN event_type END AS prompt, CASE WHEN event_id % 7 <> 0 THEN '0.5' END AS margin FROM events")
def tolerant_lines(spark, sf):
    """Lines that are broken now and then, from a text file."""
    broken = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("{no json "), F.col("event_id").cast("string"))).otherwise(F.to_json(F.struct(F.col("event_type").alias("prompt"), F.lit(0.5).alias("margin"), F.col("event_id").cast("string").alias("sample_id"))))
    table(spark, sf, "events").select(broken.alias("value")).write.text(path := scratch(spark))
    rows = cascade.parsed_lines(readers.tolerant_lines(spark, path).select("line", "value"))
    whole = readers.tolerant_lines(spark, path).select("line", F.regexp_extract("value", r"^\{no json (\d+)$", 1).try_cast("long").alias("e"))
    return rows.join(whole, "line").select(F.coalesce("e", F.col("sample_id").cast("long")).alias("event_id"), "valid_json", "prompt", "margin")


@query("SELECT 'root' AS name, '/data' AS value UNION ALL SELECT 'items', 'a=b.json'")
def location_read(spark, sf):
    put(spark, path := f"{scratch(spark)}/.location".replace("/.location", "/location.txt"), "# where things are\n\nroot = /data\nitems=a=b.json\n")
    found = readers.location(spark, path, ["root", "items"])
    return spark.createDataFrame(sorted(found.items()), "name string, value string")


# ---- votes, pairs and runs

@query("SELECT conv_id, count(*) >= 2 AND bool_and(length(trim('select ' || text)) >= 10) AS fit, false AS mixed FROM conversations GROUP BY 1")
def valid_votes(spark, sf):
    lists = table(spark, sf, "conversations").groupBy("conv_id").agg(F.collect_list(F.concat(F.lit("select "), "text")).alias("a"))
    return lists.select("conv_id", vote.valid_candidates(F.col("a")).alias("fit"), vote.valid_candidates(F.concat("a", F.array(F.lit("drop table x")))).alias("mixed"))


@query("WITH s AS (SELECT doc_id // 20 AS sid, doc_id AS pos, round((n_chars % 1000) / 1000.0::DOUBLE, 4) AS d, quality = 1 AS ok FROM documents JOIN labels USING (doc_id)) SELECT sid, pos, row_number() OVER (PARTITION BY sid ORDER BY d, ok DESC, pos) AS rank FROM s")
def scored_ranks(spark, sf):
    return pairs.scored_order(scored(spark, sf), ["sid"]).select("sid", "pos", F.col("rank").cast("long").alias("rank"))


@query("""SELECT o_orderkey AS sample_id, CASE WHEN o_orderkey % 3 = 0 THEN 'meta' WHEN o_orderkey % 3 = 1 THEN 'own' WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS db_id, CASE WHEN o_orderkey % 2 = 0 THEN 'g' WHEN o_orderkey % 5 <> 0 THEN o_orderstatus END AS gold_sql FROM orders""")
def gold_fallbacks(spark, sf):
    o = table(spark, sf, "orders").withColumn("sample_id", F.col("o_orderkey"))
    k = F.col("o_orderkey")
    records = o.select("sample_id", F.when(k % 3 == 0, "meta").alias("meta_db_id"), F.when(k % 3 == 1, "own").alias("db_id"), F.when(k % 2 == 0, "g").alias("gold_sql"))
    items = o.filter("o_orderkey % 5 <> 0").select("sample_id", F.col("o_orderpriority").alias("db_id"), F.col("o_orderstatus").alias("SQL"))
    return pairs.with_gold_fallbacks(records, items).select("sample_id", "db_id", "gold_sql")


@query("SELECT count(DISTINCT o_custkey) AS total_files, count(*) AS total_clusters, sum(o_orderkey % 4 + 1)::BIGINT AS total_candidates, count(*) FILTER (WHERE o_orderstatus = 'F') AS correct_total, count(*) FILTER (WHERE o_orderstatus = 'O') AS wrong_total, count(DISTINCT o_custkey) FILTER (WHERE o_orderstatus NOT IN ('F', 'O')) AS error_total FROM orders")
def run_totals(spark, sf):
    status = F.col("o_orderstatus")
    return execute.run_summary(table(spark, sf, "orders").select(F.col("o_custkey").alias("sample_id"), (F.col("o_orderkey") % 4 + 1).alias("count"), F.when(status.isin("F", "O"), status == "F").alias("is_correct")))


@query("SELECT column_name, NOT contains(column_name, 'name') AND total > 50000 AND total / n > 20 AS skipped FROM (SELECT 'p_name' AS column_name, sum(length(p_name)) AS total, count(*) AS n FROM (SELECT DISTINCT p_name FROM part) UNION ALL SELECT 'p_type', sum(length(p_type)), count(*) FROM (SELECT DISTINCT p_type FROM part))")
def skipped_columns(spark, sf):
    found = profile.column_profile(table(spark, sf, "part"), ["p_name", "p_type"])
    return found.select("column_name", profile.skip_rule(F.col("column_name"), F.col("sum_of_lengths"), F.col("average_length")).alias("skipped"))


@query("SELECT unnest(['all', 'one', 'seven', 'random']) AS how, unnest([count(*), 1, 7, 1])::BIGINT AS n FROM nation")
def fetch_modes(spark, sf):
    n = table(spark, sf, "nation")
    return spark.createDataFrame([(name, len(execute.fetch(n, how))) for name, how in (("all", "all"), ("one", "one"), ("seven", 7), ("random", "random"))], "how string, n long")


@query("SELECT * FROM (VALUES (1, true), (2, false), (3, false), (4, false)) AS t(id, fine)")
def executable_queries(spark, sf):
    _views(spark, sf)
    asked = [(1, "SELECT n_name FROM nation"), (2, "SELECT nope FROM nation"), (3, "SELECT 1 FROM nope"), (4, " ")]
    return spark.createDataFrame([(i, execute.executable(spark, q) is None) for i, q in asked], "id int, fine boolean")


# ---- trees over generated queries

def _queries(spark, sf) -> DataFrame:
    """A query for each order, with aliases, cases and spaces that a normal form does not keep."""
    key = F.col("o_orderkey").cast("string")
    sql = F.concat(F.lit("select  O.o_custkey , COUNT( * ) as N from orders as O join customer c on O.o_custkey = c.c_custkey where O.o_orderkey > "), key, F.lit(" and c.c_name = '"), "o_orderpriority", F.lit("' group by O.o_custkey having count(*) > 1 order by O.o_custkey desc limit "), (F.col("o_orderkey") % 9 + 1).cast("string"))
    catalog_ = F.create_map(F.lit("orders"), F.array(F.lit("o_orderkey"), F.lit("o_custkey")), F.lit("customer"), F.array(F.lit("c_custkey"), F.lit("c_name")))
    return table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", sql.alias("sql"), catalog_.alias("catalog"))


NORMAL = "'SELECT orders.o_custkey, COUNT(*) AS n FROM orders JOIN customer ON orders.o_custkey = customer.c_custkey WHERE orders.o_orderkey > ' || o_orderkey || ' AND customer.c_name = ''' || o_orderpriority || ''' GROUP BY orders.o_custkey HAVING COUNT(*) > 1 ORDER BY orders.o_custkey DESC LIMIT ' || (o_orderkey % 9 + 1)"


@query(f"SELECT o_orderkey, {NORMAL} AS normalized FROM orders")
def normal_forms(spark, sf):
    return distance.described(_queries(spark, sf), "sql", "d", "catalog").select("o_orderkey", "d.normalized")


@query("""SELECT o_orderkey, 2 AS selected, lower('orders.o_orderkey > ' || o_orderkey || ';customer.c_name = ''' || o_orderpriority || '''') AS "where", 'o_custkey' AS grouped, '(o_custkey,desc)' AS ordered, 'count(*) > 1' AS having, (o_orderkey % 9 + 1)::VARCHAR AS "limit", 'orders;customer' AS joined FROM orders""")
def query_components(spark, sf):
    c = "d.components."
    rows = distance.described(_queries(spark, sf), "sql", "d", "catalog")
    joined = lambda k: F.array_join(c + k, ";")
    return rows.select("o_orderkey", F.size(c + "select").cast("int").alias("selected"), joined("where").alias("where"), joined("groupby").alias("grouped"), joined("orderby").alias("ordered"), joined("having").alias("having"), joined("limit").alias("limit"), joined("join").alias("joined"))


@query("SELECT o_orderkey, 'orders;customer' AS tables, 'customer.c_custkey;customer.c_name;orders.o_custkey;orders.o_orderkey' AS columns FROM orders")
def query_names(spark, sf):
    rows = distance.described(_queries(spark, sf), "sql", "d", "catalog")
    return rows.select("o_orderkey", F.array_join("d.tables", ";").alias("tables"), F.array_join(F.array_sort("d.columns"), ";").alias("columns"))


@query("SELECT o_orderkey, unnest(['orders', 'customer']) AS table_name, unnest(['o_custkey;o_orderkey', 'c_custkey;c_name']) AS columns FROM orders")
def query_lineage(spark, sf):
    rows = distance.lineage_rows(_queries(spark, sf).withColumn("pos", F.lit(0)), ["o_orderkey"], "sql", "pos", "catalog")
    return rows.groupBy("o_orderkey", "table_name").agg(F.array_join(F.array_sort(F.collect_set("column_name")), ";").alias("columns"))


@query("SELECT o_orderkey, round(CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE 1 / 9::DOUBLE END, 6) AS ted FROM orders")
def tree_edit_distances(spark, sf):
    """One literal of nine nodes differs, or none."""
    side = lambda n: F.concat(F.lit("SELECT o_custkey FROM orders WHERE o_orderkey = "), n.cast("string"))
    rows = table(spark, sf, "orders").select("o_orderkey", side(F.col("o_orderkey")).alias("a"), side(F.when(F.col("o_orderkey") % 5 == 0, F.col("o_orderkey")).otherwise(-F.col("o_orderkey") + 10**9)).alias("b"))
    return distance.edit_distances(rows, "a", "b").select("o_orderkey", F.round("ted", 6).alias("ted"))
