"""The formula language: values row by row against a table worked out by hand, errors by place, signatures."""

import math
import random

import pytest

from lodestone.functions import formula

NAN, INF = float("nan"), float("inf")


@pytest.fixture(scope="module")
def rows(spark):
    data = [(0, 2.0, 3, "4", "Low ", True), (1, None, 5, " 2.5 ", "", False), (2, NAN, 0, "abc", None, None), (3, -1.0, 7, "1e2", "12", True), (4, INF, None, "1f", "low", None), (5, 0.0, 10, None, "x", False), (0, 2.0, 3, "4", "Low ", True)]
    return spark.createDataFrame(data, "id int, a double, b int, t string, `odd name%` string, f boolean")


def values(rows, source, texts=False):
    return [r[0] for r in rows.coalesce(1).select(formula.compiled(source, rows, texts).column).collect()]


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("a + b", [5, None, None, 6, None, 10, 5]),
        ("-a^2", [-4, None, None, -1, None, 0, -4]),
        ("2^3^2 / 2", [256] * 7),
        ("2*b^-1", [2 / 3, 0.4, None, 2 / 7, None, 0.2, 2 / 3]),
        ("10 / b", [10 / 3, 2, None, 10 / 7, None, 1, 10 / 3]),
        ("1 / (1 / a)", [2, None, None, -1, None, None, 2]),
        ("-7 % b", [-1, -2, None, 0, None, -7, -1]),
        ("t * 2", [8, 5, None, 200, None, None, 8]),
        ("f + 1", [None] * 7),
        ("min(a, b)", [2, None, None, -1, None, 0, 2]),
        ("max(b)", [3, 5, 0, 7, None, 10, 3]),
        ("round(-2.5) + round(2.5) + floor(-0.5) + ceil(0.2)", [1] * 7),
        ("sqrt(a) + log(b)", [math.sqrt(2) + math.log(3), None, None, None, None, math.log(10), math.sqrt(2) + math.log(3)]),
        ("exp(b * 1000)", [None, None, 1, None, None, None, None]),
        ("floor(1e30)", [1e30] * 7),
        ("a > 1", [1, None, None, 0, None, 0, 1]),
        ("a > 1 or b >= 5", [1, 1, None, 1, None, 1, 1]),
        ("a > 1 && b >= 5", [0, None, 0, 0, None, 0, 0]),
        ("!(a > 1)", [0, None, None, 1, None, 1, 0]),
        ("not a > 1 and 1", [0, None, None, 1, None, 1, 0]),
        ("if(a, b, -b)", [3, None, None, 7, None, -10, 3]),
        ("if(f, t, a)", [4, None, None, 100, None, 0, 4]),
        ("t > 3", [1, 0, 1, 1, 0, None, 1]),  # abc and 1f compare as text
        ("[odd name%] = t", [0, None, None, 0, 0, None, 0]),
        ("IF(b<>3, .5, 1.)", [1, 0.5, 0.5, 0.5, None, 0.5, 1]),
    ],
)
def test_numbers(rows, source, want):
    got = values(rows, source)
    assert [g is None for g in got] == [w is None for w in want]
    assert all(w is None or math.isclose(g, w, rel_tol=1e-12) for g, w in zip(got, want))


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("[odd name%]", ["Low ", None, None, "12", "low", "x", "Low "]),
        ("[odd name%] = 'LOW'", [True, None, None, False, True, False, True]),
        ("[odd name%] >= 2", [True, None, None, True, True, True, True]),  # as text, but for 12
        ('if(b > 4, "deep", b)', ["3", "deep", "0", "deep", None, "deep", "3"]),
        ("if([odd name%], 'yes', 'no')", ["yes", None, None, "yes", "yes", "yes", "yes"]),
        ("f", [True, False, None, True, None, False, True]),
        ("if(f, 1, 2)", [1, 2, None, 1, None, 2, 1]),
    ],
)
def test_texts(rows, source, want):
    assert values(rows, source, True) == want


@pytest.mark.parametrize(
    ("source", "place"),
    [("", 1), ("  ", 1), ("a +", 4), ("a ? b", 3), ("(a + b", 7), ("a b", 3), ("nope + 1", 1), ("a + 'x'", 5), ("a + 'x", 5), ("[a", 1), ("if(a, b)", 1), ("sin(a)", 1), ("Sqrt(a)", 1), ("pow(a)", 1), ("a < b < 1", 7), ("1.2.3", 4), ("a + )", 5), ("[A]", 2), ("min()", 1)],
)
def test_errors_say_where(rows, source, place):
    with pytest.raises(formula.FormulaError) as e:
        formula.compiled(source, rows)
    assert e.value.position == place


def test_random_formulas_against_python(rows):
    """Sums, products, differences and comparisons in brackets of every shape."""
    rng = random.Random(8)
    table = rows.where("id in (0, 3, 5)").dropDuplicates(["id"])
    data = [r.asDict() for r in table.collect()]

    def grown(depth):
        if depth == 0:
            return rng.choice([("a", lambda r: r["a"]), ("b", lambda r: float(r["b"])), ("1.5", lambda r: 1.5)])
        (s, f), (t, g), op = grown(depth - 1), grown(rng.randrange(depth)), rng.choice("+-*%")
        run = {"+": lambda x, y: x + y, "-": lambda x, y: x - y, "*": lambda x, y: x * y, "%": lambda x, y: math.fmod(x, y) if y else None}[op]
        return f"({s}{op}{t})", lambda r: None if f(r) is None or g(r) is None else run(f(r), g(r))

    made = [grown(rng.randint(1, 4)) for _ in range(40)]
    got = {r.id: r for r in formula.calculate(table, {f"v{i}": s for i, (s, _) in enumerate(made)}).collect()}
    for r in data:
        for i, (source, f) in enumerate(made):
            want, have = f(r), got[r["id"]][f"v{i}"]
            assert (want is None) == (have is None) and (want is None or math.isclose(want, have, rel_tol=1e-9, abs_tol=1e-9)), source


def test_signatures(spark, rows):
    made = formula.signatures(rows, ["a + b", "t = '4'"])
    assert made == formula.signatures(rows.repartition(3), ["a + b", "t = '4'"])  # in any order
    kept = {"sum": ("a + b", made["a + b"]), "same": ("t = '4'", made["t = '4'"])}
    assert formula.stale(rows, kept) == []
    assert formula.stale(rows.withColumn("t", rows.t.substr(1, 1)), kept) == ["same"]
    assert formula.stale(rows.unionByName(rows.limit(1)), kept) == ["sum", "same"]
    assert formula.stale(rows.limit(0), kept) == ["sum", "same"]


def test_calculated_elements(spark):
    a = spark.createDataFrame([(1, 4.0, "<", 2.0, None), (2, 4.0, "<", 2.0, "<"), (3, None, None, 2.0, None), (4, 6.0, None, 0.0, None), (5, 6.0, ">", 3.0, None)], "id int, Nb double, Nb_q string, Ta double, Ta_q string")
    units = {"Nb": "ppm", "Ta": "%"}
    ratio = formula.calculated_element(a, "r", "Nb / Ta", units, {"Ta": "ppm"})
    assert [(r.r, r.r_q, r.r_why) for r in ratio.orderBy("id").collect()] == [(None, None, "below detection")] * 2 + [(None, None, "missing"), (None, None, "no number"), (6 / 30_000, None, None)]
    assert [r.Ta for r in ratio.orderBy("id").collect()] == [2.0, 2.0, 2.0, 0.0, 3.0]
    total = formula.calculated_element(a, "s", "Nb + Ta * 2", units)
    assert [(r.s, r.s_q) for r in total.orderBy("id").collect()] == [(8.0, None), (8.0, "<"), (None, None), (6.0, None), (12.0, None)]
    assert formula.mixed_units(formula.compiled("Nb / Ta", a), units) and not formula.mixed_units(formula.compiled("Nb + Ta", a), units)
    with pytest.raises(ValueError, match="exists"):
        formula.calculated_element(a, "Nb", "Ta", units)
