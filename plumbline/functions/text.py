"""Column functions on text: names, errors, prompts and schema text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The kinds of error messages, first match wins.
ERROR_KINDS = ["ambiguous column name", "no such column", "no such table", "no such function", "syntax error"]
SPARK_ERRORS = {"AMBIGUOUS_REFERENCE": "ambiguous column name", "UNRESOLVED_COLUMN": "no such column", "TABLE_OR_VIEW_NOT_FOUND": "no such table", "UNRESOLVED_ROUTINE": "no such function", "PARSE_SYNTAX_ERROR": "syntax error"}
CJK = "[\\u4e00-\\u9fa5]"
#: The task text that a prompt is filled into: {db_engine}, {db_details}, {question}, {evidence}.
PROMPT = """Write one {db_engine} query that answers the question.

Database Schema:
{db_details}

Question:
{question}
{evidence}
Answer with the query alone, beginning with SELECT.

SQL:"""


def _chain(cases: list[tuple[Column, str]], default: str) -> Column:
    out = None
    for test, name in cases:
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise(default)


def error_kind(message: Column) -> Column:
    """The kind of an engine's error message, `others` if it is none of ERROR_KINDS."""
    return _chain([(F.contains(message, F.lit(k)), k) for k in ERROR_KINDS], "others")


def spark_error_kind(message: Column) -> Column:
    """The same kinds from Spark's error classes."""
    return _chain([(F.contains(message, F.lit(k)), v) for k, v in SPARK_ERRORS.items()], "others")


def without_space(text: Column) -> Column:
    return F.regexp_replace(text, r"\s", "")


def has_cjk(text: Column) -> Column:
    return F.rlike(text, F.lit(CJK))


def has_other_than_cjk(text: Column) -> Column:
    return F.rlike(text, F.lit("[^\\u4e00-\\u9fa5]"))


def create_statements(text: Column) -> Column:
    """CREATE statements up to their semicolons, line feeds included."""
    return F.regexp_extract_all(text, F.lit(r"(?s)(CREATE\s.*?;)"), F.lit(1))


def first_match(text: Column, *patterns: str) -> Column:
    """The first match of the first pattern that matches, null without one."""
    return F.coalesce(*(F.nullif(F.regexp_extract(text, p, 0), F.lit("")) for p in patterns))


def all_matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def without_quotes(name: Column) -> Column:
    return F.translate(name, '"`', "")


def unquoted(name: Column) -> Column:
    """A name without the backquotes that enclose it."""
    return F.when(F.startswith(name, F.lit("`")), F.substr(name, F.lit(2), F.length(name) - 2)).otherwise(name)


def needs_quotes(name: Column) -> Column:
    return F.rlike(name, F.lit("[() /-]"))


def quoted(name: Column) -> Column:
    return F.concat(F.lit("`"), name, F.lit("`"))


def quoted_if_needed(name: Column) -> Column:
    return F.when(needs_quotes(name), quoted(name)).otherwise(name)


def is_number(text: Column) -> Column:
    return text.try_cast("double").isNotNull()


def words_of_sql(text: Column) -> Column:
    """Distinct lower-case words of a query, in order: what a loose search for table names starts from."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda x: F.length(x) > 0))


def shown_result(rows: Column, most: int = 20, chars: int = 1000) -> Column:
    """A result (array of row texts) for a prompt: at most `most` rows, and `chars` characters with an ellipsis."""
    text = lambda a: F.concat(F.lit("["), F.array_join(a, ", "), F.lit("]"))
    head = text(F.slice(rows, 1, most))
    head = F.when(F.length(head) > chars, F.concat(F.left(head, F.lit(chars)), F.lit("...]"))).otherwise(head)
    shown = F.when(F.size(rows) > most, F.concat(F.lit("The execution results of the first twenty columns are: "), head)).otherwise(text(rows))
    return F.when(F.length(shown) > chars, F.concat(F.left(shown, F.lit(chars)), F.lit("..."))).otherwise(shown)


def artifact_name(text: Column) -> Column:
    """Letters, digits, _ . and - only, none of the last at the ends; `eval-artifact` if nothing is left."""
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(text, "[^A-Za-z0-9_.-]+", "-"), "^-+|-+$", ""), F.lit("")), F.lit("eval-artifact"))


def schema_line(table: Column, columns: Column) -> Column:
    return F.concat(F.lit("Table "), table, F.lit("("), F.array_join(columns, ", "), F.lit(")"))


def schema_section(tables: Column, keys: Column) -> Column:
    """Lines for tables array<struct<name, columns array<string>>>, then for foreign keys array<struct<column, to_table, to_column>>; nulls count as empty."""
    lines = F.transform(F.coalesce(tables, F.array().cast("array<struct<name:string,columns:array<string>>>")), lambda t: schema_line(t["name"], t["columns"]))
    links = F.transform(F.coalesce(keys, F.array().cast("array<struct<column:string,to_table:string,to_column:string>>")), lambda k: F.concat(F.lit("FK: "), k["column"], F.lit(" -> "), k["to_table"], F.lit("."), k["to_column"]))
    return F.array_join(F.concat(lines, links), "\n")


def prompt(question: Column, schema: Column, evidence: Column | None = None, engine: str = "SQLite", template: str = PROMPT) -> Column:
    """The template with its fields filled in; empty evidence leaves no line."""
    note = F.lit("") if evidence is None else F.when(F.length(F.trim(F.coalesce(evidence, F.lit("")))) > 0, F.concat(F.trim(evidence), F.lit("\n"))).otherwise("")
    out = F.lit(template)
    for name, value in (("db_engine", F.lit(engine)), ("db_details", schema), ("question", question), ("evidence", note)):
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return F.regexp_replace(out, r"^\s+|\s+$", "")


def examples_section(examples: Column) -> Column:
    """Reference examples from array<struct<question, sql, evidence>>, in order."""
    one = lambda e: F.concat(F.lit("#Example Question: "), F.replace(F.coalesce(e["evidence"], F.lit("")), F.lit("\n"), F.lit(" ")), F.lit("\n"), e["question"], F.lit("\n#Answer: `"), e["sql"], F.lit("`"))
    return F.concat(F.lit("Here are some reference examples:\n"), F.array_join(F.transform(examples, one), "\n\n"), F.lit("\n"))


def vote_prompt(question: Column, first: Column, first_result: Column, second: Column, second_result: Column) -> Column:
    """Two candidates with their results, to choose between."""
    part = lambda name, sql, result: F.concat(F.lit(f"Candidate {name}:\n"), sql, F.lit("\nResult:\n"), F.coalesce(result, F.lit("")))
    return F.concat(F.lit("Question:\n"), question, F.lit("\n\n"), part("A", first, first_result), F.lit("\n\n"), part("B", second, second_result), F.lit("\n\nWhich candidate is correct? Answer A or B."))


def revision_prompt(question: Column, sql: Column, result: Column, schema: Column) -> Column:
    return F.concat(F.lit("Database Schema:\n"), schema, F.lit("\n\nQuestion:\n"), question, F.lit("\n\nDraft query:\n"), sql, F.lit("\nIts result:\n"), F.coalesce(result, F.lit("")), F.lit("\n\nReturn the corrected query."))


def merge_prompt(question: Column, candidates: Column, schema: Column) -> Column:
    """Several candidates (array of texts) to merge into one query."""
    listed = F.array_join(F.transform(candidates, lambda c, i: F.concat(F.lit("#"), (i + 1).cast("string"), F.lit(": "), c)), "\n")
    return F.concat(F.lit("Database Schema:\n"), schema, F.lit("\n\nQuestion:\n"), question, F.lit("\n\nCandidate queries:\n"), listed, F.lit("\n\nReturn one query."))


def once(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value), the value computed once for a row: a Column that lambdas name is otherwise computed again for each of their elements."""
    return F.element_at(F.transform(F.array(value), of), 1)


def pruned_ddl(ddl: Column, tables: Column, columns: Column | None = None) -> Column:
    """CREATE TABLE text with the wanted tables alone (names, any case); all of it if none is found or none is wanted.

    With columns, map<string, array<string>> from lower-case table names, a table's lines stay that open or close it, declare
    keys, hold no comma, or declare a wanted column; a table without wanted columns stays whole."""
    mark = "CREATE TABLE "
    name = lambda p: F.lower(F.regexp_replace(F.trim(F.substring_index(p, "(", 1)), '[`"]', ""))
    own = lambda x: F.lower(F.regexp_extract(x, r"^\s*(?:`([^`]*)`|\"([^\"]*)\"|(\S+))", 0))
    bare = lambda x: F.regexp_replace(F.trim(own(x)), '[`"]', "")

    def slim(part, need, lines):
        keep = lambda x, i: (i == 0) | (i == F.size(lines) - 1) | F.contains(F.upper(x), F.lit("PRIMARY KEY")) | F.contains(F.upper(x), F.lit("FOREIGN KEY")) | ~F.contains(x, F.lit(",")) | F.array_contains(need, bare(x))
        return F.when(F.coalesce(F.size(need), F.lit(0)) > 0, F.array_join(F.filter(lines, keep), "\n")).otherwise(part)

    def chosen(parts):
        kept = once(F.transform(tables, lambda t: F.lower(t)), lambda wanted: F.filter(parts, lambda p: F.array_contains(wanted, name(p))))
        if columns is None:
            return kept
        need = lambda known, p: F.transform(F.try_element_at(known, name(p)), lambda c: F.lower(c))
        return once(columns, lambda known: F.transform(kept, lambda p: once(need(known, p), lambda n: once(F.split(p, "\n"), lambda lines: slim(p, n, lines)))))

    parts = lambda d: F.filter(F.split(d, mark), lambda p: F.contains(p, F.lit("(")))
    return once(ddl, lambda d: once(chosen(parts(d)), lambda k: F.when(F.coalesce(F.size(k), F.lit(0)) > 0, F.concat(F.lit(mark), F.array_join(k, mark))).otherwise(d)))


def schema_sequence(tables: Column, keys: Column) -> Column:
    """A database on lines of text: tables array<struct<name, columns array<struct<name, type, is_pk, comment, contents array<string>>>>>, and
    foreign keys array<struct<from_table, from_column, to_table, to_column>>. Names with special characters are quoted."""
    note = lambda c: F.concat(
        F.array(c["type"]), F.when(c["is_pk"], F.array(F.lit("primary key"))).otherwise(F.array().cast("array<string>")), F.when(F.length(c["comment"]) > 0, F.array(F.concat(F.lit("comment : "), c["comment"]))).otherwise(F.array().cast("array<string>")),
        F.when(F.size(c["contents"]) > 0, F.array(F.concat(F.lit("values : "), F.array_join(c["contents"], " , ")))).otherwise(F.array().cast("array<string>")),
    )
    column = lambda t, c: F.concat(quoted_if_needed(t["name"]), F.lit("."), quoted_if_needed(c["name"]), F.lit(" ( "), F.array_join(note(c), " | "), F.lit(" )"))
    line = lambda t: F.concat(F.lit("table "), quoted_if_needed(t["name"]), F.lit(" , columns = [ "), F.array_join(F.transform(t["columns"], lambda c: column(t, c)), " , "), F.lit(" ]"))
    q = quoted_if_needed
    link = lambda k: F.concat(q(k["from_table"]), F.lit("."), q(k["from_column"]), F.lit(" = "), q(k["to_table"]), F.lit("."), q(k["to_column"]))
    links = F.when(F.coalesce(F.size(keys), F.lit(0)) > 0, F.concat(F.lit("foreign keys :\n"), F.array_join(F.transform(keys, link), "\n"))).otherwise("foreign keys : None")
    return F.array_join(F.concat(F.array(F.lit("database schema :")), F.transform(tables, line), F.array(links)), "\n")


def matched_sequence(matches: Column) -> Column:
    """Values found in columns, array<struct<table_name, column_name, contents array<string>>>, on lines of text."""
    line = lambda m: F.concat(quoted_if_needed(m["table_name"]), F.lit("."), quoted_if_needed(m["column_name"]), F.lit(" ( "), F.array_join(m["contents"], " , "), F.lit(" )"))
    return F.when(F.coalesce(F.size(matches), F.lit(0)) > 0, F.concat(F.lit("matched contents :\n"), F.array_join(F.transform(matches, line), "\n"))).otherwise("matched contents : None")
