import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gleanspark.functions import values as v
from gleanspark.schema import HEADLINE, NUMERIC, TEXT, UNITS


def column(spark, rows, kind, expr):
    return [r["out"] for r in spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)], f"i int, {kind}").select("i", expr.alias("out")).orderBy("i").collect()]


def test_parse_number(spark):
    cases = {
        "200": 200, "200.5": 200.5, "-12.5": -12.5, "approximately 200": 200, "~150": 150, "1.5e-3": 0.0015, "NOT_REPORTED": None, "": None, None: None, "150-250": None, "<200": None, ">10": None,
        "1,000": 1, ".5": 5, "185 +/- 22": 185, "200±10": 200, "5–10": None, "5−10": 5, "−5": -5, "none": None,
    }
    assert column(spark, list(cases), "v string", v.parse_number(F.col("v"))) == list(cases.values())


def test_to_canonical(spark):
    cases = [
        (("200", "nm", "size"), 200), (("0.5", "um", "size"), 500), (("0.5", "μm", "size"), 500), (("0.5", "µm", "size"), None), (("1", "mm", "size"), 1e6), (("5", "Å", "size"), None), (("5", "a", "size"), 0.5),
        (("-12.5", "mV", "zeta_potential"), -12.5), (("0.5", "V", "zeta_potential"), 500), (("48", "h", "stability"), 48), (("2", "days", "stability"), 48), (("3", "weeks", "stability"), 504),
        (("0.72", "", "loading_efficiency"), 72), (("72", "%", "loading_efficiency"), 72), (("72", "", "loading_efficiency"), 72), (("NOT_REPORTED", "nm", "size"), None), (("200", "parsec", "size"), None), (("200", "", "size"), None),
    ]
    got = column(spark, [c for c, _ in cases], "v string, u string, f string", v.to_canonical(F.col("v"), F.col("u"), F.col("f")))
    assert [g["value"] for g in got] == [pytest.approx(x) if x is not None else None for _, x in cases]
    assert all((g["unit"] is None) == (x is None) for g, (_, x) in zip(got, cases))


def test_text_rules(spark):
    assert column(spark, ["  Lots of   Whitespace  ", "NOT_REPORTED", None], "v string", v.canonical_text(F.col("v"))) == ["lots of whitespace", "NOT_REPORTED", "NOT_REPORTED"]
    assert column(spark, ["not_reported", "", None, " ", "200"], "v string", v.is_nr(F.col("v"))) == [True, True, True, True, False]
    assert column(spark, [("abc", "bcd"), ("", "x"), ("😀a", "😀")], "a string, b string", v.char_iou(F.col("a"), F.col("b"))) == [0.5, 0.0, 0.5]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.floats(allow_nan=False, allow_infinity=False, min_value=-1e15, max_value=1e15), min_size=60, max_size=60))
def test_number_string_is_like_c(spark, xs):
    xs = [x for x in xs if x == 0 or abs(x) > 1e-200] + [11085.55, 0.5, 12.5, 1e-5, 123456.7, 999999.7, -0.0001]
    want = [str(int(x)) if abs(x - int(x)) < 1e-9 else f"{x:g}" for x in xs]
    got = column(spark, xs, "x double", v.number_string(F.col("x")))
    far = [i for i, x in enumerate(xs) if x and not 1e-4 <= abs(x) < 1e6]
    assert [g for i, g in enumerate(got) if i not in far] == [w for i, w in enumerate(want) if i not in far]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text("0123456789.-<>e ±~", max_size=10), min_size=40, max_size=40))
def test_parse_number_against_plain_code(spark, texts):
    def plain(s):
        if not s.strip() or any(b in s for b in "<>≤≥") or re.search(r"\d\s*[-–]\s*\d", s):
            return None
        m = re.search(v.NUMBER, s.replace("±", " "))
        return float(m[0]) if m else None

    assert column(spark, texts, "v string", v.parse_number(F.col("v"))) == [plain(t) for t in texts]


def test_amounts_have_a_canonical_unit_of_factor_one():
    assert set(NUMERIC) == set(UNITS) < set(HEADLINE) and not set(TEXT) & set(NUMERIC)
    assert all(table[unit.lower()] == 1.0 for unit, table in UNITS.values())
