"""Text parsers against a plain-Python parse of the same format, on random
messy lines (doubled spaces, junk tokens, blank lines, missing fields)."""

import math

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from basketry.sources.text import parse_line_baskets, parse_utility_lines

token = st.one_of(
    st.integers(min_value=0, max_value=30).map(str),
    st.sampled_from(["x7", "", "a", "007", "1.5"]),
)
sep = st.sampled_from([" ", "  ", "\t", " \t "])


@st.composite
def basket_line(draw):
    toks = draw(st.lists(token, max_size=6))
    s = draw(sep)
    return s.join(toks)


@st.composite
def utility_line(draw):
    items = draw(st.lists(token, max_size=5))
    tu = draw(st.sampled_from(["14", " 9 ", "abc", "", "3.5"]))
    utils = draw(st.lists(st.sampled_from(["1", "2.5", "-3", "q", "7"]), max_size=6))
    shape = draw(st.sampled_from(["full", "two", "one"]))
    if shape == "full":
        return " ".join(items) + ":" + tu + ":" + " ".join(utils)
    if shape == "two":
        return " ".join(items) + ":" + tu
    return " ".join(items)


def _frame(spark, lines):
    return spark.createDataFrame([(i, v) for i, v in enumerate(lines)], "k bigint, value string")


def _py_line_baskets(lines):
    out = []
    for k, v in enumerate(lines):
        for t in v.split():
            if t.isdigit():
                out.append((k, t))
    return sorted(out)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(lines=st.lists(basket_line(), min_size=1, max_size=8))
def test_line_baskets_match_python(spark, lines):
    got = sorted((r.tid, r.item) for r in parse_line_baskets(_frame(spark, lines), key="k").collect())
    assert got == _py_line_baskets(lines)


def _float(s):
    try:
        return float(s)
    except ValueError:
        return None


def _py_zip(lines):
    out = []
    for k, v in enumerate(lines):
        parts = v.split(":")
        if len(parts) < 2:
            continue
        items = parts[0].split()
        tu = _float(parts[1].strip())
        utils = parts[2].split() if len(parts) > 2 else []
        for pos, it in enumerate(items):
            if not it.isdigit():
                continue
            if pos >= len(utils):
                price = "hash"
            else:
                u = _float(utils[pos])
                price = 1.0 if u is None else u
            out.append((k, it, price, tu))
    return out


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(lines=st.lists(utility_line(), min_size=1, max_size=8))
def test_utility_lines_zip_match_python(spark, lines):
    rows = parse_utility_lines(_frame(spark, lines), key="k", default_price=1.0).collect()
    got = sorted((r.tid, r.item, r.unit_price, r.tu) for r in rows)
    want = _py_zip(lines)
    assert len(got) == len(want)
    want_sorted = sorted(want, key=lambda x: (x[0], x[1], -1 if x[2] == "hash" else x[2], x[3] if x[3] is not None else -1))
    got_by_key = {}
    for g in got:
        got_by_key.setdefault((g[0], g[1]), []).append(g)
    for tid, it, price, tu in want_sorted:
        cands = got_by_key[(tid, it)]
        assert any(
            ((price == "hash" and 1.0 <= c[2] < 10.0) or (price != "hash" and c[2] == price))
            and ((tu is None and c[3] is None) or (tu is not None and c[3] is not None and math.isclose(c[3], tu)))
            for c in cands
        )


def _py_as_items(lines):
    out = []
    for k, v in enumerate(lines):
        parts = v.split(":")
        if len(parts) < 3:
            continue
        for t in parts[0].split() + parts[2].split():
            if t.isdigit():
                out.append((k, t))
    return sorted(out)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(lines=st.lists(utility_line(), min_size=1, max_size=8))
def test_utility_lines_as_items_match_python(spark, lines):
    rows = parse_utility_lines(_frame(spark, lines), key="k", utilities="as_items").collect()
    assert sorted((r.tid, r.item) for r in rows) == _py_as_items(lines)
