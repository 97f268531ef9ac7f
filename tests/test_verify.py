"""Vectors of the verification rules."""

import pytest
from pyspark.sql import functions as F

from quaesta.functions import score as S
from quaesta.functions import text as T
from quaesta.functions import verify as V


def one(spark, col, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(col.alias("x")).collect()[0][0]


@pytest.mark.parametrize("t,want", [("I_total = 1.5 A", "1.5 A"), ("P = 9.0 W", "9.0 W"), ("unknown text", "unknown text"), ("v(t) = 3", "3"), ("ω = 5", "ω = 5")])
def test_strip_prefix(spark, t, want):
    assert one(spark, T.strip_prefix(F.col("t")), t=t) == want


@pytest.mark.parametrize(
    "t,value,unit",
    [("9.71 × 10^7 V/m", 9.71e7, "V/m"), ("1.5*10^-3 A", 1.5e-3, "A"), ("3.2e4 Hz", 3.2e4, "Hz"), ("6.67 × 10^-11 N·m²/kg²", 6.67e-11, "N·m2/kg2"), ("I = 2,5 mA", 2.5, "mA"), ("8.94 × 10⁵", 8.94e5, ""), ("Paris", None, ""), ("", None, ""), (None, None, ""), ("-3", -3.0, "")],
)
def test_parse(spark, t, value, unit):
    r = V.parse(spark.createDataFrame([(t,)], "t string"), F.col("t"), "n").collect()[0]
    assert r["n_unit"] == unit and (r["n_value"] == pytest.approx(value) if value is not None else r["n_value"] is None)


@pytest.mark.parametrize("v,u,want", [(100.0, "μj", 1e-4), (2.0, "kω", 2000.0), (2.0, "kΩ", 2000.0), (500.0, "ma", 0.5), (42.0, "xyz", 42.0), (1.0, "cm2", 0.01)])
def test_to_si(spark, v, u, want):
    df = spark.createDataFrame([(v, u)], "v double, u string")
    assert df.select(V.to_si(F.col("v"), F.col("u"))).collect()[0][0] == pytest.approx(want)


CASES = [
    ("100 μJ", "0.0001", True), ("100 μJ", "1e-4 J", True), ("2 kΩ", "2000", True), ("2 kΩ", "2000 Ω", True), ("9.81", "9.8", True), ("9.81", "100.0", False), ("1.5 A", "2.5 A", False), ("I = 1.5 A", "1.5 A", True),
    ("The answer is yes.", "Yes", True), ("I know this is true.", "No", False), ("False", "False", True), ("True", "True", True), ("maybe", "Unknown", True), ("cannot be determined", "Uncertain", True),
    ("C", "C", True), ("a", "A", True), ("B", "A", False), ("<answer>C</answer>", "C", True), ("option b", "B", True),
    ("9.81 m/s²", "9.81", True), ("Paris", "Paris", True), ("Paris", "London", False), (None, "5", False), ("", None, True),
]


def test_verify(spark):
    df = spark.createDataFrame([(i, p, g) for i, (p, g, _) in enumerate(CASES)], "i int, p string, g string")
    got = {r["i"]: r["ok"] for r in V.verify(df, "p", "g").collect()}
    assert [(c, got[i]) for i, c in enumerate(CASES) if got[i] != c[2]] == []


@pytest.mark.parametrize("p,g,want", [("kΩ", "kΩ", True), ("kΩ", "Ω", False), ("", "", True), ("mA", "mV", True), ("xyz", "XYZ", True), ("xyz", "", False)])
def test_same_scale(spark, p, g, want):
    assert one(spark, V.same_scale(F.col("p"), F.col("g")), p=p, g=g) is want


def test_mcq_lenient(spark):
    assert one(spark, V.mcq(F.col("p"), F.col("g")), p="The answer is A", g="A") is False
    assert one(spark, V.mcq(F.col("p"), F.col("g"), lenient=True), p="The answer is A", g="A") is True
    assert one(spark, V.mcq(F.col("p"), F.col("g"), lenient=True), p="<answer>C</answer>", g="C") is True


@pytest.mark.parametrize(
    "t,want",
    [
        ("x <answer> 5 A </answer> y", "5 A"), ("<answer></answer>\n7", ""), (r"so \boxed{\frac{1}{2}\,\text{m}}", r"1/2\,m"), (r"\boxed{1} then \boxed{2}", "2"), (r"\boxed{a{b{c}}}", "abc"), ("open \\boxed{3", "open \\boxed{3"), ("a\r\nb\r\n\r\n", "b"), ("", ""),
    ],
)
def test_extract_answer(spark, t, want):
    assert one(spark, T.extract_answer(F.col("t")), t=t) == want


def test_extraction_rules(spark):
    assert one(spark, T.flexible_extract(F.col("t")), t="The answer is 4.\n\\boxed{5}") == "4"
    assert one(spark, T.logic_label(F.col("t")), t="<answer>It cannot be determined</answer> yes") == "unknown"
    assert one(spark, T.logic_label(F.col("t")), t="this follows") == "yes"
    assert one(spark, T.logic_label(F.col("t")), t="") == ""
    assert one(spark, T.mcq_letter(F.col("t")), t="<answer>CORRECT: B</answer>") == "B"
    assert one(spark, T.mcq_letter(F.col("t")), t="first A\nC.\nend") == "C"
    assert one(spark, T.mcq_letter(F.col("t")), t="none") == ""
    assert one(spark, T.reasoning_steps(F.col("t")), t="1. First step here. Then B\n- `x`y") == ["First step here.", "Then B"]
    assert one(spark, T.reasoning_steps(F.col("t")), t="  ") is None
    opts = F.array(*map(F.lit, ["A. Yes", "B. No", "C. Uncertain"]))
    for a, want in (("a. yes", "A. Yes"), ("unknown", "C. Uncertain"), ("b", "B. No"), ("No", "B. No"), ("zzz", "zzz"), ("", "")):
        assert one(spark, T.match_option(F.col("t"), opts), t=a) == want
    u = lambda t, n: one(spark, T.premises_used(F.col("t"), F.col("t"), F.lit(n)), t=t)
    assert u("<premises_used>3, 1, 9</premises_used>", 4) == [0, 2] and u("by premise 2", 4) == [1] and u("", 3) == [0, 1, 2] and u("", 0) == []


def test_rewards(spark):
    full = "<reasoning>r</reasoning><answer>5 A</answer><explanation>e</explanation>"
    long = "<reasoning>" + "w " * 900 + "</reasoning>"
    df = spark.createDataFrame([(0, full, "5 A"), (1, "<answer>5</answer>", "x"), (2, "nothing", "7"), (3, long, "7"), (4, None, None)], "i int, c string, g string")
    r = {x["i"]: x for x in S.reward(df, "c", "g").collect()}
    assert r[0]["r_format"] == pytest.approx(0.30) and r[0]["r_correct"] == pytest.approx(0.60) and float(r[0]["reward"]) >= 0.80
    assert r[1]["r_format"] == pytest.approx(0.10) and r[2]["r_format"] == 0 and r[3]["r_length"] == pytest.approx(-0.10) and r[4]["reward"] is not None
    assert S.reward_variants(S.reward(df, "c", "g")).count() == 4 * 5


def test_routing_and_classes(spark):
    df = spark.createDataFrame([("The voltage across the resistor",), ("The premises imply the conclusion",), (None,)], "t string")
    assert [r["route"] for r in S.keyword_route(df, "t").collect()] == ["physics", "logic", "physics"]
    assert one(spark, S.request_subject(F.col("t")), t=" TYPE1 ") == "logic" and one(spark, S.request_subject(F.col("t")), t="x") == ""
    e = lambda q, p, g, s, r: one(spark, S.error_class_7(*map(F.col, "qpgsr")), q=q, p=p, g=g, s=s, r=r)
    assert e("", "x", "y", "logic", "<reasoning>") == "E6_extraction"
    assert e("a premise", "yes", "no", "logic", "") == "E4_logical_fallacy"
    assert e("", "5", "5 kg", "physics", "") == "E1_unit_dimension"
    assert e("", "newton says", "5", "physics", "") == "E2_wrong_formula"
    assert e("", "5.1", "5.0", "physics", "") == "E3_arithmetic"
    assert e("", "9", "1", "physics", "") == "E5_misinterpretation"
    df = spark.createDataFrame([("", "5", "physics"), ("5.5", "5", "physics"), ("9 mA", "5 A", "physics"), ("9 A", "5 A", "physics"), ("word", "5", "physics"), ("7", "up", "physics"), ("yes", "no", "logic")], "p string, g string, s string")
    assert [r["class"] for r in S.error_class_6(df, "p", "g", "s").collect()] == ["E5", "E3", "E1", "E2", "E1", "E5", "E4"]


def test_shaping(spark):
    assert one(spark, S.latex_clean(F.col("t")), t=r"$5 \times 10^{-3}\,\text{A}$") == "5 e-3 A"
    assert one(spark, S.clean_unit(F.col("t")), t="μ F of charge") == "μF"
    assert one(spark, S.ascii_unit(F.col("t")), t="kΩ·m²") == "kohm.m^2"
    for v, want in ((0.0, "0"), (5.0, "5"), (0.00338, "3.38e-3"), (123456.7, "1.23e5"), (3.14159, "3.1416"), (2.5, "2.5"), (0.0050, "5e-3"), (-0.5, "-0.5")):
        df = spark.createDataFrame([(v,)], "v double")
        assert df.select(S.format_number(F.col("v"))).collect()[0][0] == want
