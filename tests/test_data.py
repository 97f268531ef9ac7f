"""Log lines, quantities, drifting schemas: brute force, planted cases, edge cases."""

import json
import random

import pytest

from quaesta.common import previous_in_order
from quaesta.functions import matching, quantities
from quaesta.operators import drift, logs
from quaesta.operators import quantities as Q

LOG = "log_file string, line_no bigint, line string"


def entries(spark, rows, **kw):
    df = spark.createDataFrame(rows, LOG)
    return sorted(tuple(r) for r in logs.log_entries(df, **kw).collect())


@pytest.mark.parametrize(
    "line,at,level,component",
    [
        ("2026-03-01 23:44:25,823 - data_utils - ERROR - x", "2026-03-01 23:44:25", "ERROR", "data_utils"),
        ("time=2026-03-09T22:37:16Z level=warn component=checkpoint msg=\"y\"", "2026-03-09 22:37:16", "WARNING", "checkpoint"),
        ("2026-03-02T13:54:19+02:00 [trainer] Info skipping", "2026-03-02 11:54:19", "INFO", "trainer"),
        ("Mar  2 10:45:18 node-2 router[3170]: crit: weights", "2026-03-02 10:45:18", "CRITICAL", "router"),
        ("Mar  2 10:45:18 node-2 router[3170]: adapter: on", "2026-03-02 10:45:18", "", "router"),
        ("F0309 23:49:07.193468    4231 matmul.cc:123] timeout", "2026-03-09 23:49:07", "CRITICAL", "matmul.cc"),
        ("2026-03-09 23:50:14.466810: I io/shard_reader.cc:510] memory", "2026-03-09 23:50:14", "INFO", "io/shard_reader.cc"),
        ("[2026-03-03 09:09:00] >>> agent.graph: batch", "2026-03-03 09:09:00", "", "agent.graph"),
        ("08/03/2026 19:41:55 | WARN     | step3 | z", "2026-03-08 19:41:55", "WARNING", "step3"),
        ("1772544917.650 [INFO] reward: setup", "2026-03-03 13:35:17", "INFO", "reward"),
        ('{"msg": "m", "logger": "step3", "level": "INFO", "ts": "2026-03-02T12:46:06.123Z"}', "2026-03-02 12:46:06", "INFO", "step3"),
        ("[10:42:41] INFO     request", "2026-03-01 10:42:41", "INFO", ""),
        ("09:43:26 <z3_bridge> key", "2026-03-01 09:43:26", "", "z3_bridge"),
    ],
)
def test_layouts(spark, line, at, level, component):
    assert entries(spark, [("a_20260301_080000_1.log", 1, line)]) == [("a_20260301_080000_1.log", 1, 1, at, level, component)]


@pytest.mark.parametrize("line", ["Traceback (most recent call last):", "    quoted> [23:08:07] INFO x", "Started at : 20260309_222941", "", None, "{", "[1/5] Loading", "2026-13-40 10:00:00,1 - a - INFO - x", "[29:00:00] INFO x"])
def test_no_header(spark, line):
    assert entries(spark, [("a_20260301_080000_1.log", 1, line)]) == []


@pytest.mark.parametrize("block", [1, 3, 7, 1000])
def test_entries_are_the_same_for_any_block(spark, block):
    rnd = random.Random(3)
    rows, n, tod = [], 0, 80000
    for i in range(60):
        n += rnd.randint(1, 4)
        if rnd.random() < 0.5:
            tod = (tod + rnd.randint(0, 4000)) % 86400
            rows.append(("b_20260228_221000_7.log", n, f"[{tod // 3600:02d}:{tod // 60 % 60:02d}:{tod % 60:02d}] INFO     m{i}"))
        else:
            rows.append(("b_20260228_221000_7.log", n, rnd.choice(["  more", "", None])))
    rows += rows[:9]
    assert entries(spark, rows, block_lines=block) == entries(spark, rows, block_lines=10**9)
    lines = logs.log_lines(spark.createDataFrame(rows, LOG), block_lines=block)
    assert lines.count() == len({r[1] for r in rows})


def test_days_follow_the_clock_and_years_the_file(spark):
    f = "c_20261231_230000_1.log"
    got = entries(spark, [(f, 1, "[23:30:00] INFO a"), (f, 2, "[00:10:00] INFO b"), (f, 5, "more"), (f, 9, "Jan  1 01:00:00 n p[1]: info: c")])
    assert [(g[1], g[2], g[3]) for g in got] == [(1, 1, "2026-12-31 23:30:00"), (2, 5, "2027-01-01 00:10:00"), (9, 9, "2027-01-01 01:00:00")]
    assert entries(spark, [("noname", 1, "[23:30:00] INFO a"), (None, 1, "x"), ("x", None, "y")]) == [("noname", 1, 1, None, "INFO", "")]
    assert entries(spark, []) == []


def test_previous_in_order(spark):
    rnd = random.Random(2)
    rows = [("s", f"{rnd.randint(100, 999)}", f"f{i}") for i in range(40)]
    got = {r["v"]: r["p"] for r in previous_in_order(spark.createDataFrame(rows, "k string, o string, v string"), ["k"], "o", __import__("pyspark").sql.functions.substring("o", 1, 1), "v", "p").collect()}
    order = [v for _, _, v in sorted(rows, key=lambda r: (r[1], r[2]))]
    assert got == dict(zip(order, [None, *order]))


@pytest.mark.parametrize(
    "t,want",
    [
        ("61,456 kΩ", (61456.0, "kΩ")), ("8,6 mN", (8.6, "mN")), ("The current is 5.19 × 10⁵ amperes.", (5.19e5, "amperes")), (r"\boxed{−23.0\,\text{kilovolts}}", (-23.0, "kilovolts")), ("Step 7: 5.10E+07 watts", (5.1e7, "watts")),
        (r"$−2.44 \times 10^{-6} C$", (-2.44e-6, "C")), ("I_total = 247 µA", (247.0, "µA")), ("(45,171 km)", (45171.0, "km")), ("8.428°C", (8.428, "°C")), ("about 20.0 μH", (20.0, "μH")), ("73.83", (73.83, "")), ("1,234,567.5 J", (1234567.5, "J")),
    ],
)
def test_read(t, want):
    got = quantities.read(t)
    assert got is not None and got[0] == pytest.approx(want[0]) and got[1] == want[1]


@pytest.mark.parametrize("t", ["9/16", "3 : 4", "ratio 5", "7 times", "Option B, since 3 of 4 premises hold", "4. (P → Q)", "rule 7 applies to dock 12", "Unknown", "", None, "increases", "Premises 1 and 2 do not apply", "5 apples"])
def test_no_quantity(t):
    got = quantities.read(t)
    assert got is None or not got[1]


@pytest.mark.parametrize(
    "u,v,want",
    [("mA", 3, "3.00000e-03"), ("×10^3 Ω", 2, "2.00000e+03"), ("10^-6 C", 5, "5.00000e-06"), ("gauss", 10, "1.00000e-03"), ("km/h", 36, "1.00000e+01"), ("°C", 0, "2.73150e+02"), ("eV", 1, "1.60218e-19"), ("V/cm", 1, "1.00000e+02"), ("kWh", 1, "3.60000e+06"), ("hPa", 1, "1.00000e+02"), ("degrees", 180, "3.14159e+00"), (r"k\Omega", 1, "1.00000e+03"), (r"\mu F", 1, "1.00000e-06"), ("nanocoulombs", 1, "1.00000e-09"), ("megaohms", 1, "1.00000e+06"), ("tonnes", 1, "1.00000e+03"), ("mg", 1, "1.00000e-06"), ("min", 1, "6.00000e+01"), ("deg C", 1, "2.74150e+02"), ("millihenries", 1, "1.00000e-03")],
)
def test_units(u, v, want):
    assert quantities.si_text(v, quantities.scaled_unit(u)) == want


def test_quantities_table(spark):
    cols = "src_table string, row_id string, field string, value string, unit string, question string"
    rows = [("t", "1", "answer", "5 mA", None, None), ("t", "2", "answer", "5", "kV", None), ("t", "3", "answer", "5", "-", "Find it. Give the result in MJ."), ("t", "4", "answer", "5 A", "mA", None), ("t", "5", "answer", "5", None, None), ("t", "6", "answer", None, "V", None), ("t", "7", "answer", "0 mA", None, None)]
    df = spark.createDataFrame(rows + rows[:2], cols)
    got = {(r["row_id"], r["si_unit"], r["si_value"]) for r in Q.changed(Q.to_si(df)).collect()}
    assert got == {("1", "A", "5.00000e-03"), ("2", "V", "5.00000e+03"), ("3", "J", "5.00000e+06")}
    assert Q.to_si(df.limit(0)).count() == 0


def test_mixture_assigns_missing_units(spark):
    rnd = random.Random(4)
    rows = []
    for i in range(900):
        si = 10 ** rnd.gauss(-3, 0.4)
        if i % 3 == 0:
            rows.append(("t", str(i), "a", f"I = {si * 1e3:.4g}", None, None))
        else:
            u, f = ("mA", 1e3) if i % 3 == 1 else ("μA", 1e6)
            rows.append(("t", str(i), "a", f"I = {si * f:.4g} {u}", None, None))
    got = [r for r in Q.to_si(spark.createDataFrame(rows, "src_table string, row_id string, field string, value string, unit string, question string")).collect() if r["unit_source"] == "posterior"]
    assert len(got) == 300 and sum(abs(r["factor"] - 1e-3) < 1e-9 for r in got) >= 290
    assert all(r["uncertain"] == (r["probability"] < 0.9) for r in got)


def test_assignment_is_optimal():
    import itertools

    rnd = random.Random(8)
    for _ in range(40):
        n, m = rnd.randint(1, 4), 5
        c = [[rnd.random() for _ in range(m)] for _ in range(n)]
        best = min(sum(c[i][p[i]] for i in range(n)) for p in itertools.permutations(range(m), n))
        assert sum(c[i][j] for i, j in enumerate(matching.assignment(c))) == pytest.approx(best)


@pytest.mark.parametrize("a,b,same", [("config_name", "cfg_name", True), ("accuracyOverall", "accuracy_overall", True), ("n_correct", "num_correct", True), ("per_retry", "retry_counts", True), ("bug_fix_v2", "bug_fix_2", True), ("avg_confidence_correct", "avg_confidence_wrong", False), ("config_id", "config", True), ("n_logic", "n_failed", False), ("accuracy_logic", "accuracy_overall", False), ("temperature", "seed", False)])
def test_names(a, b, same):
    assert (matching.name_similarity(a, b) >= 0.45) is same


def test_schema_changes(spark):
    f = [f"s_2026010{i}_000000.json" for i in range(1, 5)]
    recs = [
        ("s", f[0], 0, {"config_name": "a", "n": 1, "gone": True}), ("s", f[0], 1, {"config_name": "b", "n": None}),
        ("s", f[1], 0, {"cfg_name": "a", "n": "1", "new": [1]}), ("s", f[2], 0, {"cfg_name": "a", "n": "2", "new": None}), ("s", f[3], 0, {"cfg_name": "a", "n": "2", "new": {"x": 1}}),
    ]
    rows = [(s, n, k, json.dumps(d)) for s, n, k, d in recs]
    rows += [rows[0], ("s", f[1], 7, "not json"), ("s", None, 1, "{}"), ("z", "z.json", 0, None)]
    df = spark.createDataFrame(rows, "series string, file_name string, record_no int, record string")
    got = {(r["file_name"], r["change"], r["field"], r["new_field"]) for r in drift.schema_changes(df).collect()}
    assert got == {(f[1], "renamed", "config_name", "cfg_name"), (f[1], "retyped", "n", ""), (f[1], "removed", "gone", ""), (f[1], "added", "new", "")}
    u = drift.unified_records(df)
    assert {"cfg_name", "n", "new", "gone"} <= set(u.columns) and u.count() == 5
    assert drift.schema_changes(df.limit(0)).count() == 0


def test_extra_columns_with_clashing_names(spark):
    from pyspark.sql import functions as F

    from quaesta.functions import verify as V

    rows = [("a_20260301_080000_1.log", 1, "[10:42:41] INFO x"), ("a_20260301_080000_1.log", 2, None)]
    extra = {c: F.lit("clash") for c in ("h", "f", "block", "first_line", "last_line", "level", "backs", "word", "pos")}
    got = logs.log_entries(spark.createDataFrame(rows, LOG).withColumns(extra)).collect()
    assert [(r["first_line"], r["last_line"], r["level"]) for r in got] == [(1, 2, "INFO")]
    recs = [("s", "s_20260101_000000.json", 0, '{"series": 1, "SERIES": 2, "kind": "a", "value": 3, "": 4}')]
    df = spark.createDataFrame(recs, "series string, file_name string, record_no int, record string").withColumns({c: F.lit(1) for c in ("field", "value", "kind", "previous", "name", "m")})
    u = drift.unified_records(df)
    assert len({c.lower() for c in u.columns}) == len(u.columns) and u.count() == 1
    v = spark.createDataFrame([("5 A", "5 A", 1.0, "x")], "p string, g string, pred_value double, true_unit string")
    assert V.verify(v, "p", "g").collect()[0].asDict() == {"p": "5 A", "g": "5 A", "pred_value": 1.0, "true_unit": "x", "ok": True}
    cols = "src_table string, row_id string, field string, value string, unit string, question string, kind string, factor double"
    assert Q.changed(Q.to_si(spark.createDataFrame([("t", "1", "answer", "5 mA", None, None, "k", 2.0)], cols))).count() == 1


@pytest.mark.parametrize(
    "t,want",
    [
        ("How large is the charge of a toroid when its surface density reaches 82.8 J?", "C"), ("A piston of 339 μF is linked to a resistor; what is the opposite heat released after 5 s?", "J"), ("The flux of a coil rises from 5 to 4 s. Find the negligible induced voltage.", "V"),
        ("Cuộn dây mang giá trị 8.624 μF; hãy tính năng lượng sau 90 giây?", "J"), ("How large is the momentum of a slab when its impedance reaches 38.90 nC?", ""), ("By which factor must the charge change so that the coil stores 3 J?", ""),
        ("What is the ratio of the voltages?", ""), ("Find the charge density.", ""), ("How large is the resonance frequency of a coil?", "Hz"), (None, ""),
    ],
)
def test_asked_kind(t, want):
    assert quantities.asked_kind(t) == want


def test_mixture_takes_kind_from_question_and_other_field(spark):
    rnd = random.Random(5)
    rows = []
    for i in range(600):
        n = f"{10 ** rnd.gauss(0, 0.3):.4g}"
        if i < 400:
            rows.append(("t", str(i), "answer", f"{n} mA", None, "How large is the current of a coil?", None))
            rows.append(("t", str(i), "prediction", f"{n} kV", None, None, f"{n} V" if i % 4 else f"{n} C"))
        else:
            rows.append(("t", str(i), "answer", n, None, "How large is the current of a coil?" if i % 2 else "By which factor must the current change?", None))
            rows.append(("t", str(i), "prediction", n, None, "By which factor must the current change?" if i % 2 else None, f"{n} V"))
    cols = "src_table string, row_id string, field string, value string, unit string, question string, other_value string"
    got = [r for r in Q.to_si(spark.createDataFrame(rows, cols)).collect() if int(r["row_id"]) >= 400]
    by = {k: [r for r in got if (r["field"], int(r["row_id"]) % 2) == k] for k in (("answer", 1), ("answer", 0), ("prediction", 1), ("prediction", 0))}
    assert all(r["si_unit"] == "A" and r["factor"] == pytest.approx(1e-3) and not r["uncertain"] for r in by["answer", 1])
    assert all(r["si_unit"] == "V" and r["factor"] == pytest.approx(1e3) and r["uncertain"] and 0.7 < r["probability"] < 0.8 for r in by["prediction", 0])
    assert all(r["si_unit"] == "" and r["uncertain"] for r in by["answer", 0] + by["prediction", 1])


def test_canonical_names_sees_every_set_of_fields(spark):
    from pyspark.sql import functions as F

    bits = spark.range(1 << 18).select(F.lit("s").alias("series"), F.col("id").cast("string").alias("file_name"), F.explode(F.filter(F.array(*[F.when(F.expr(f"id & {1 << k} != 0"), F.lit(f"n{k}")) for k in range(18)]), lambda x: x.isNotNull())).alias("field"))
    # The one file with both names is in the last of four partitions of the distinct sets.
    last = spark.range(100).select(F.array(F.lit("aa"), F.lit("ab"), F.concat(F.lit("x"), F.col("id").cast("string"))).alias("s")).filter("pmod(hash(s), 4) = 3").first()["s"]
    one = spark.createDataFrame([("s", "both", u) for u in last] + [("s", "first", "aa"), ("s", "second", "ab")], "series string, file_name string, field string")
    changes = spark.createDataFrame([("s", "second", "renamed", "aa", "ab")], drift.CHANGES)
    names = drift.canonical_names(changes, bits.unionByName(one))
    assert names["aa"] == "aa" and names["ab"] == "ab"
    assert drift.canonical_names(changes, one.filter("file_name != 'both'"))["ab"] == "aa"


def test_records_without_fields_keep_their_row(spark, tmp_path):
    from quaesta.plans import data_queries

    texts = ['{"a": 1}', None, "not json", "[1]", "{}", '{"a": 1, "a": 2}']
    rows = [("s", "s.json", i, t) for i, t in enumerate(texts)] + [("s", "s.json", 1, None), (None, "n.json", 0, "{}"), (None, "n.json", 1, '{"a": 2}')]
    schema = "series string, file_name string, record_no int, record string"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "ablation_records.parquet"))
    got = {(r["file_name"], r["record_no"]): r["a"] for r in data_queries.p5_records(spark, str(tmp_path)).collect()}
    assert got == {("s.json", i): 1.0 if i == 0 else None for i in range(6)} | {("n.json", 0): None, ("n.json", 1): 2.0}
    one = drift.unified_records(spark.createDataFrame(rows[1:2], schema), fieldless=True)
    assert one.count() == 1


def test_message_has_all_lines_of_the_entry(spark):
    rnd = random.Random(6)
    rows, want = [], []
    for name in ("a_20260301_080000_1.log", "b_20260301_080000_1.log"):
        for i in range(1, 120):
            if rnd.random() < (0.4 if i < 60 else 0.07):
                rows.append((name, i, f"2026-03-01 08:00:00,000 - c - INFO - m{i}"))
                want.append([name, i, f"m{i}"])
            else:
                rows.append((name, i, rnd.choice([None, "", "Traceback (most recent call last):", f"  at line {i}", "2026-13-45 99:00:00,000 - c - INFO - no date"])))
                if want and want[-1][0] == name:
                    want[-1][2] += "\n" + (rows[-1][2] or "")
    df = spark.createDataFrame(rows + rows[:9], LOG).repartition(3)
    got = sorted((r["log_file"], r["first_line"], r["message"]) for r in logs.log_entries(df, block_lines=7, message=True).collect())
    assert got == sorted(map(tuple, want))


def test_headers_with_carriage_returns_and_late_clocks(spark):
    log = "a_20260301_080000_1.log"
    rows = [(log, 1, "2026-03-01 10:00:00,1 - a - INFO - 10%\r20%\r30%"), (log, 2, "2026-03-01 10:00:01,1 - a - INFO - x"), (log, 3, "time=2026-03-01T10:00:02Z level=info component=c other=1")]
    assert [e[1:] for e in entries(spark, rows)] == [(1, 1, "2026-03-01 10:00:00", "INFO", "a"), (2, 2, "2026-03-01 10:00:01", "INFO", "a"), (3, 3, "2026-03-01 10:00:02", "INFO", "c")]
    got = {r["first_line"]: r["message"] for r in logs.log_entries(spark.createDataFrame(rows, LOG), message=True).collect()}
    assert got == {1: "10%\r20%\r30%", 2: "x", 3: "other=1"}


def test_posterior_keeps_the_exact_factor():
    hist = [("s", "min", 60.0, 10 + i % 3, 5) for i in range(9)] + [("s", None, None, 11, 2)]
    model = Q.fit(hist)["s"]
    unit, factor, p = Q.posterior(12.0, model)
    assert (unit, f"{12 * factor:.5e}") == ("min", "7.20000e+02") and p > 0.99


def test_renames_by_values_when_names_differ(spark):
    times = [12.5 + i * 0.37 for i in range(40)]
    old = [("s", "a_20260101_000000.json", i, json.dumps({"walltime": t, "ok": i % 2 == 0, "seed": 1})) for i, t in enumerate(times)]
    new = [("s", "a_20260102_000000.json", i, json.dumps({"elapsed": t, "good": i % 2 == 0, "stage": 1})) for i, t in enumerate(times)]
    df = spark.createDataFrame(old + new, "series string, file_name string, record_no int, record string")
    got = sorted(tuple(r)[2:] for r in drift.schema_changes(df).collect())
    # two values are no evidence: the flags and constants are not the same fields for it
    assert got == [("added", "good", ""), ("added", "stage", ""), ("removed", "ok", ""), ("removed", "seed", ""), ("renamed", "walltime", "elapsed")]


def test_sketches_do_not_fill(spark):
    rows = [("s", f, i, "x", "number", str(i + at)) for f, at in (("f", 0), ("g", 100_000)) for i in range(3000)]
    prof = drift.profiles(spark.createDataFrame(rows, "series string, file_name string, record_no int, field string, kind string, value string")).collect()
    a, b = (r.asDict() for r in prof)
    assert len(a["sketch"]) == 32 and drift._overlap(a, b) == 0.0 and drift._overlap(a, a) == 1.0
