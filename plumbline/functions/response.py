"""Column functions that read SQL, tables or a choice out of a model's answer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The phrases in which an answer names its choice, in the order in which they are tried, and the group that holds the letter.
CHOICE_PATTERNS = [
    (r"(correct|chosen) candidate .{1,5}([AB])", 2),
    (r"(correct|chosen) answer.{1,5}([AB])", 2),
    (r"Candidate ([AB]) .{1,10} (correct|chosen)", 1),
    (r"candidate ([AB]) .{1,10} (correct|chosen)", 1),
    (r"candidate.{1,5}([AB])", 1),
    (r"[:：]([AB])", 1),
]


def strip(text: Column) -> Column:
    """Without white space at both ends, line feeds and tabs included (trim() takes spaces only)."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _after_last(text: Column, mark: str) -> Column:
    return F.when(F.contains(text, F.lit(mark)), F.substring_index(text, mark, -1)).otherwise(text)


def answer_text(text: Column) -> Column:
    """What stands after the last <answer>, up to the first </answer> of that; null for null."""
    return strip(F.substring_index(_after_last(text, "<answer>"), "</answer>", 1))


def plain_sql(text: Column) -> Column:
    """The answer on one line, without semicolons (those in literals too), end marks, fences and what precedes </think>."""
    for old, new in (("\n", " "), (";", ""), ("</s>", ""), ("```sql ", "")):
        text = F.replace(text, F.lit(old), F.lit(new))
    text = F.replace(strip(text), F.lit("```"), F.lit(""))
    thought = F.instr(text, "</think>")
    text = F.when(thought > 0, F.substr(text, thought + len("</think>"))).otherwise(text)
    text = answer_text(text)
    return F.replace(F.replace(text, F.lit("</answer>"), F.lit("")), F.lit("<answer>"), F.lit(""))


def last_sql_block(text: Column) -> Column:
    """The last fenced sql block, null without one."""
    found = F.regexp_extract_all(text, F.lit(r"(?s)```sql\s*(.*?)\s*```"), F.lit(1))
    return strip(F.try_element_at(found, F.lit(-1)))


def sql_of(text: Column) -> Column:
    """A tagged answer first, else the last fenced block, else the whole text cleaned."""
    tagged = F.contains(text, F.lit("<answer>")) & F.contains(text, F.lit("</answer>"))
    return F.when(tagged, plain_sql(text)).otherwise(F.coalesce(last_sql_block(text), plain_sql(text)))


def tables_of(text: Column) -> Column:
    """The answer's comma-separated names, trimmed, empty ones dropped; repeats and order stay."""
    return F.filter(F.transform(F.split(plain_sql(text), ","), strip), lambda x: F.length(x) > 0)


def named_choice(text: Column) -> Column:
    """The letter of the first phrase of CHOICE_PATTERNS that the text holds, null without one."""
    line = F.replace(text, F.lit("\n"), F.lit(" "))
    return F.coalesce(*(F.nullif(F.regexp_extract(line, p, g), F.lit("")) for p, g in CHOICE_PATTERNS))


def choice(text: Column) -> Column:
    """A or B. A JSON object's `choose` counts first, then a leading letter, then a phrase; A where nothing is found.

    Of phrases with two groups the letter is taken, never the other word. A text with braces is read as JSON up to its first
    closing one; if that can't be read the choice is A."""
    braces = F.contains(text, F.lit("{")) & F.contains(text, F.lit("}"))
    head = F.replace(F.substr(text, F.lit(1), F.instr(text, "}")), F.lit("\n"), F.lit(" "))
    chosen = F.get_json_object(head, "$.choose")
    chosen = F.when(F.length(chosen) > 1, F.coalesce(named_choice(chosen), chosen)).otherwise(chosen)
    first = F.upper(F.substr(text, F.lit(1), F.lit(1)))
    free = F.when(F.length(text) == 1, text).when(F.length(text) > 1, F.when(first.isin("A", "B"), first).otherwise(named_choice(text)))
    return F.upper(F.coalesce(F.when(braces, chosen).otherwise(free), F.lit("A")))


def selection_of(text: Column) -> Column:
    return choice(plain_sql(text))


def parsed(text: Column, mode: str = "sql") -> Column:
    """The response by mode: sql, table (an array) or, for any other, selection."""
    return {"sql": sql_of, "table": tables_of}.get(mode, selection_of)(text)
