"""Properties that hold for any input."""

from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.operators.augment import holdout_size
from plumbline.plans.analysis import columns_used, components, lineage, normalize, tables_used
from plumbline.plans.distance import normalized_edits, size, tree_edits
from plumbline.plans.sqltree import parse, parsed_or_none, text_of

WORDS = "select from where group by having order limit and or not in is null like between exists case when then else end as on using join left cross union all except with ( ) , . * + - = <> < || 1 2.5 'x' a b t u \"q r\" count max cast over partition distinct asc desc ; ? :: int".split(" ")
queries = st.lists(st.sampled_from(WORDS), max_size=25).map(" ".join)
names, tables = st.sampled_from("abc"), st.sampled_from(["t", "u"])
literal = st.one_of(st.integers(0, 9).map(str), st.sampled_from(["'x'", "NULL"]))
value = st.recursive(st.one_of(names, literal), lambda x: st.one_of(st.tuples(x, st.sampled_from("+-*/"), x).map(" ".join), x.map("({})".format), x.map("max({})".format)), max_leaves=5)
test = st.recursive(st.tuples(value, st.sampled_from(["=", "<", ">=", "<>"]), value).map(" ".join), lambda x: st.one_of(st.tuples(x, st.sampled_from(["and", "or"]), x).map(lambda p: "({} {} {})".format(*p)), x.map("not {}".format)), max_leaves=4)
selects = st.tuples(st.lists(value, min_size=1, max_size=3), tables, st.none() | test, st.none() | names).map(
    lambda p: f"select {', '.join(p[0])} from {p[1]}" + (f" where {p[2]}" if p[2] else "") + (f" order by {p[3]} desc" if p[3] else "")
)


@settings(max_examples=600, deadline=None)
@given(st.one_of(queries, st.text(max_size=60)))
def test_any_text_is_parsed_or_refused(text):
    tree = parsed_or_none(text)
    assert isinstance(normalize(text, {"t": ["a"]}), str) and isinstance(lineage(text, {"t": ["a"], "u": ["a", "b"]}), dict)
    if tree is not None:
        assert parsed_or_none(text_of(tree)) is not None
        assert components(tree) is not None and isinstance(tables_used(tree), list) and isinstance(columns_used(tree), list)


@settings(max_examples=200, deadline=None)
@given(selects)
def test_canonical_text_says_the_same(sql):
    tree = parse(sql)
    again = parse(text_of(tree))
    assert text_of(again) == text_of(tree) and size(again) == size(tree)  # AND and OR may be grouped anew
    once = normalize(sql, {"t": ["a", "b"], "u": ["c"]})
    assert normalize(once, {"t": ["a", "b"], "u": ["c"]}) == once


@settings(max_examples=150, deadline=None)
@given(selects, selects, selects)
def test_edits_are_a_metric(x, y, z):
    a, b, c = parse(x), parse(y), parse(z)
    assert tree_edits(a, a) == 0 and tree_edits(a, b) == tree_edits(b, a)
    assert tree_edits(a, c) <= tree_edits(a, b) + tree_edits(b, c)
    assert abs(size(a) - size(b)) <= tree_edits(a, b) <= size(a) + size(b) and 0 <= normalized_edits(a, b) <= 1


@given(st.integers(0, 10_000), st.floats(0, 0.999))
def test_holdouts_leave_rows_on_both_sides(n, ratio):
    k = holdout_size(n, ratio)
    assert k == 0 if n < 2 or ratio <= 0 else 1 <= k <= n - 1
