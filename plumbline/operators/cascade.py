"""An ordered cascade of filters over preference pairs, with a reason for every row that goes."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.response import strip

# The reasons, in the order of their tests.
REASONS = ["invalid_json", "invalid_margin", "pair_type_filtered", "chosen_not_correct", "rejected_not_wrong", "zero_margin", "low_margin", "parse_fail", "same_normalized_sql", "duplicate_normalized_pair", "prompt_too_long", "chosen_too_long", "rejected_too_long", "per_prompt_cap"]


def collapsed(sql: Column) -> Column:
    """The plainest normal form: one space for white space, no semicolon at the end; null for an empty query."""
    return F.nullif(strip(F.regexp_replace(F.regexp_replace(sql, r"\s+", " "), r"[;\s]+$", "")), F.lit(""))


def words(text: Column) -> Column:
    """Tokens by white space."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda x: F.length(x) > 0))


@dataclass(frozen=True)
class Rules:
    min_margin: float = 0.0
    min_margin_by_type: dict[str, float] = field(default_factory=dict)
    pair_types: frozenset[str] = frozenset()  # empty: all
    require_chosen_correct: bool = False
    require_rejected_wrong: bool = False
    max_prompt_tokens: int | None = None  # None: lengths are not looked at
    max_total_tokens: int | None = None
    max_pairs_per_prompt: int = 0  # 0: all
    normalize: Callable[[Column], Column] = collapsed  # null: it can't be parsed
    tokens: Callable[[Column], Column] = words

    @staticmethod
    def types(text: str) -> frozenset[str]:
        """Pair types from a comma-separated list."""
        return frozenset(x.strip() for x in text.split(",") if x.strip())


FIELDS = "prompt string, chosen string, rejected string, margin string, sample_id string, db_id string, pair_type string, chosen_is_correct string, rejected_is_correct string, __bad string"


def parsed_lines(lines: DataFrame, line: str = "line", value: str = "value") -> DataFrame:
    """(line, fields of FIELDS, valid_json) of JSON lines; blank lines are dropped. A missing margin is 0, a null one null.

    A line that is no JSON object has valid_json false and no fields."""
    text = strip(F.col(value))
    keys = F.json_object_keys(F.when(F.startswith(text, F.lit("{")), text))
    rows = lines.filter(F.length(text) > 0).select(F.col(line).alias("line"), F.from_json(text, FIELDS, {"columnNameOfCorruptRecord": "__bad"}).alias("r"), keys.alias("k"))
    out = rows.select("line", "r.*", (F.col("k").isNotNull() & F.col("r.__bad").isNull()).alias("valid_json"), F.array_contains("k", "margin").alias("has")).drop("__bad")
    return out.withColumn("margin", F.when(F.col("valid_json") & ~F.col("has"), "0.0").otherwise(F.col("margin"))).drop("has")


def prompt_key() -> Column:
    """The sample and database if either is known, else the prompt."""
    known = F.col("sample_id").isNotNull() | F.col("db_id").isNotNull()
    return F.when(known, F.struct(F.col("sample_id").alias("s"), F.col("db_id").alias("d"), F.lit(None).cast("string").alias("p"))).otherwise(F.struct(F.lit(None).cast("string").alias("s"), F.lit(None).cast("string").alias("d"), F.coalesce("prompt", F.lit("")).alias("p")))


def _first(cases: list[tuple[Column, str]]) -> Column:
    out = F.lit(None).cast("string")
    for test, name in reversed(cases):
        out = F.when(test, name).otherwise(out)
    return out


def cascade(pairs: DataFrame, rules: Rules = Rules()) -> DataFrame:  # noqa: B008
    """pairs (see parsed_lines; line must be unique) with reason: the first test that a row fails, null if it stays.

    Duplicates are sought among what the tests before leave, lengths among what duplicates leave, and the cap takes the
    largest margins, then the fewest tokens, then the first lines of each prompt. Windows are by pair and by prompt. Also
    adds prompt_key, margin_value, the normal forms and token counts."""
    number = F.col("margin").try_cast("double")
    least = F.lit(float(rules.min_margin))
    for kind, value in rules.min_margin_by_type.items():
        least = F.when(F.coalesce("pair_type", F.lit("")) == kind, float(value)).otherwise(least)
    true, false = F.lit("true"), F.lit("false")
    rows = pairs.withColumns({"prompt_key": prompt_key(), "margin_value": number, "n_chosen": rules.normalize(strip(F.col("chosen"))), "n_rejected": rules.normalize(strip(F.col("rejected")))})
    tests = [(~F.coalesce("valid_json", F.lit(False)), "invalid_json"), (F.col("margin_value").isNull(), "invalid_margin")]
    if rules.pair_types:
        tests.append((~F.coalesce("pair_type", F.lit("")).isin(*sorted(rules.pair_types)), "pair_type_filtered"))
    if rules.require_chosen_correct:
        tests.append((~F.col("chosen_is_correct").eqNullSafe(true), "chosen_not_correct"))
    if rules.require_rejected_wrong:
        tests.append((~F.col("rejected_is_correct").eqNullSafe(false), "rejected_not_wrong"))
    tests += [((F.col("margin_value") <= 0) & (least > 0), "zero_margin"), (F.col("margin_value") < least, "low_margin"), (F.col("n_chosen").isNull() | F.col("n_rejected").isNull(), "parse_fail"), (F.col("n_chosen") == F.col("n_rejected"), "same_normalized_sql")]
    rows = rows.withColumn("reason", _first(tests))
    failed = F.when(F.col("reason").isNotNull(), F.col("line"))  # spreads what has failed already, lines that are no JSON say, over all tasks
    again = F.row_number().over(Window.partitionBy("prompt_key", "n_chosen", "n_rejected", failed).orderBy("line"))
    rows = rows.withColumn("reason", F.when(F.col("reason").isNull() & (again > 1), "duplicate_normalized_pair").otherwise(F.col("reason")))
    if rules.max_prompt_tokens is not None or rules.max_total_tokens is not None:
        most = {"p": rules.max_prompt_tokens, "t": rules.max_total_tokens}
        over = lambda n, k: F.lit(False) if most[k] is None else n > most[k]
        rows = rows.withColumns({"prompt_tokens": rules.tokens(F.col("prompt")), "chosen_tokens": rules.tokens(F.col("chosen")), "rejected_tokens": rules.tokens(F.col("rejected"))})
        p, c, r = F.col("prompt_tokens"), F.col("chosen_tokens"), F.col("rejected_tokens")
        rows = rows.withColumn("reason", F.coalesce("reason", _first([(over(p, "p"), "prompt_too_long"), (over(p + c, "t"), "chosen_too_long"), (over(p + r, "t"), "rejected_too_long")])))
    else:
        rows = rows.withColumns({k: F.lit(0) for k in ("prompt_tokens", "chosen_tokens", "rejected_tokens")})
    if rules.max_pairs_per_prompt > 0:
        place = F.row_number().over(Window.partitionBy("prompt_key", failed).orderBy(F.desc("margin_value"), F.col("prompt_tokens") + F.col("chosen_tokens") + F.col("rejected_tokens"), "line"))
        rows = rows.withColumn("reason", F.when(F.col("reason").isNull() & (place > rules.max_pairs_per_prompt), "per_prompt_cap").otherwise(F.col("reason")))
    return rows


def kept(done: DataFrame) -> DataFrame:
    """The rows that stay, with place: prompts in the order of their first line, within one by falling margin, tokens and line."""
    rows = done.filter("reason is null")
    w = Window.partitionBy("prompt_key")
    rows = rows.withColumns({"first_line": F.min("line").over(w), "place": F.row_number().over(w.orderBy(F.desc("margin_value"), F.col("prompt_tokens") + F.col("chosen_tokens") + F.col("rejected_tokens"), "line"))})
    return rows.drop("reason")


def reason_counts(done: DataFrame) -> DataFrame:
    return done.filter("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


def type_counts(done: DataFrame) -> DataFrame:
    """(pair_type, before, after): rows that are JSON, and rows that stay, of each pair type; a missing type is `unknown`."""
    rows = done.filter("valid_json").withColumn("pair_type", F.coalesce("pair_type", F.lit("unknown")))
    return rows.groupBy("pair_type").agg(F.count("*").alias("before"), F.count_if(F.col("reason").isNull()).alias("after"))


def summary(done: DataFrame) -> DataFrame:
    """One row: totals, retention to 4 places (0 if empty), distinct prompts before (rows that are JSON) and after."""
    stays = F.col("reason").isNull()
    n = F.count("*")
    return done.agg(
        n.alias("total_input_pairs"), F.count_if(stays).alias("total_output_pairs"), F.when(n > 0, F.round(F.count_if(stays) / n, 4)).otherwise(0.0).alias("retention_ratio"),
        F.count_distinct(F.when(F.col("valid_json"), F.to_json("prompt_key"))).alias("unique_prompts_before"), F.count_distinct(F.when(stays, F.to_json("prompt_key"))).alias("unique_prompts_after"),
    )
