"""Aggregates, statistics, logic, retrieval, sources, streaming."""

import itertools
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from quaesta.functions import text
from quaesta.functions.calc import evaluate
from quaesta.operators import evaluate as E
from quaesta.operators import fol, overlap, retrieve, route
from quaesta.operators import stats as A
from quaesta.sources import readers, writers
from quaesta.streaming import running


@pytest.mark.parametrize("b,c,chi,p", [(44, 4, 31.6875, 0.0), (33, 6, 17.3333, 0.0), (10, 3, 2.7692, 0.0961), (11, 5, 1.5625, 0.2113), (5, 10, 1.0667, 0.3017), (0, 0, 0.0, 1.0), (4, 4, 0.125, None)])
def test_mcnemar(spark, b, c, chi, p):
    x, y = A.mcnemar(F.lit(b), F.lit(c))
    r = spark.range(1).select(F.round(x, 4), F.round(y, 4)).collect()[0]
    assert r[0] == pytest.approx(chi, abs=1e-4) and (p is None or r[1] == pytest.approx(p, abs=1e-4))
    assert p is None or b + c == 0 or r[1] == pytest.approx(A.exact_p(chi), abs=1e-4)


@pytest.mark.parametrize("k,n,lo,hi", [(77, 217, 29.4209, 42.0518), (114, 217, 45.9044, 59.0766)])
def test_wilson(spark, k, n, lo, hi):
    a, b = A.wilson(F.lit(k), F.lit(n))
    r = spark.range(1).select(a, b).collect()[0]
    assert r[0] == pytest.approx(lo, abs=1e-3) and r[1] == pytest.approx(hi, abs=1e-3)


def test_spread_and_bootstrap(spark):
    s = spark.createDataFrame([("a", 53.46), ("a", 54.38), ("a", 51.61)], "g string, v double")
    r = A.spread(s, ["g"], "v").collect()[0]
    assert (r["mean"], r["std"]) == (53.15, 1.15)
    d = spark.createDataFrame([("a", i < 77) for i in range(217)], "g string, ok boolean")
    b = A.bootstrap(d, ["g"], "ok", 4000).collect()[0]
    assert b["ci_low"] == pytest.approx(29.42, abs=1.2) and b["ci_high"] == pytest.approx(42.05, abs=1.2)


def test_votes_retries_and_empty_tables(spark):
    v = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 2, "b"), (1, 3, "a"), (2, 0, None)], "q int, pos int, ans string")
    got = {r["q"]: r for r in E.vote(v, ["q"], "ans", "pos").collect()}
    assert got[1]["winner"] == "a" and got[1]["share"] == 0.5
    r = spark.createDataFrame([(1, 0, False), (1, 1, True), (1, 2, True), (2, 0, False), (2, 1, False)], "q int, a int, ok boolean")
    got = {x["q"]: (x["retry_count"], x["resolved"], x["first_ok"]) for x in E.resolve_retries(r, ["q"], "a", "ok").collect()}
    assert got == {1: (1, True, False), 2: (1, False, False)}
    assert E.vote(v.limit(0), ["q"], "ans", "pos").count() == 0
    acc = E.accuracy(spark.createDataFrame([("x", "physics", None)], "g string, subject string, ok boolean"), ["g"]).collect()[0]
    assert (acc["n_correct"], acc["accuracy_logic"]) == (0, 0.0)
    d = {r["k"]: r["n"] for r in E.dense_counts(spark.createDataFrame([("a",), ("a",)], "k string"), "k", ["a", "b"]).collect()}
    assert d == {"a": 2, "b": 0}


def brute(premises, goal, names):
    """Entailment over all models of up to three elements (enough for these theories)."""

    def holds(f, e):
        op = f[0]
        return e[f[1]] if op == "p" else not holds(f[1], e) if op == "not" else (not holds(f[1], e) or holds(f[2], e)) if op == "imp" else all(holds(x, e) for x in f[1:]) if op == "and" else any(holds(x, e) for x in f[1:]) if op == "or" else holds(f[1], e) == holds(f[2], e)

    types = [dict(zip(names, bits)) for bits in itertools.product([0, 1], repeat=len(names))]
    truth = set()
    for k in range(1, 5):
        for model in itertools.combinations(types, k):
            sat = lambda q, b: all(holds(b, e) for e in model) if q == "all" else any(holds(b, e) for e in model)  # noqa: B023,E731
            if all(sat(q, b) for q, b in premises):
                truth.add(sat(*goal))
    return "yes" if truth in ({True}, set()) else "no" if truth == {False} else "unknown"


def test_entailment_against_models():
    rnd = random.Random(5)
    lits = ["P(x)", "¬P(x)", "Q(x)", "¬Q(x)"]
    for _ in range(150):
        f = lambda: f"{rnd.choice('∀∃')}x ({rnd.choice(lits)} {rnd.choice('→∧∨')} {rnd.choice(lits)})"
        prem, goal = [f() for _ in range(rnd.randint(1, 3))], f()
        p, g = [fol.Parser(x).formula() for x in prem], fol.Parser(goal).formula()
        assert fol.entails(prem, goal) == brute(p, g, ["P", "Q"]), (prem, goal)


def test_logic_forms(spark):
    assert fol.entails(["ForAll(x, Implies(Man(x), Mortal(x)))", "Man(socrates)"], "Mortal(socrates)") == "yes"
    assert fol.entails(["∀x (A(x) -> B(x))"], "∀x (B(x) → A(x))") == "unknown"
    assert fol.entails(["loves(x, y)"], "A(x)") is None
    assert fol.entails([f"∀x (P{i}(x) → P{i + 1}(x))" for i in range(30)], "∀x P1(x)") == "unknown"
    assert fol.entails([f"∀x (P{i}(x) → P{i + 1}(x))" for i in range(40)] + ["P0(a)"], "∀x P40(x)") == "yes"
    # disjoined conjunctions are not multiplied out: 30 of them would be 2^30 clauses
    many = " ∨ ".join(f"(A{i}(x) ∧ B{i}(x))" for i in range(30))
    assert fol.entails([f"∀x ({many})"] + [f"∀x (A{i}(x) → C(x))" for i in range(30)], "∀x C(x)") == "yes"
    assert len(fol.clauses(fol.Parser(f"∀x ({many})").formula()[1])) < 200
    df = spark.createDataFrame([("if all men are A then all men are B",), ("nothing",)], "t string")
    got = [r[0] for r in df.select(fol.conclusion(F.col("t"), F.array(F.lit("A"), F.lit("B")))).collect()]
    assert got == ["∀x(A(x) → B(x))", None]


@pytest.mark.parametrize("t,want", [("2+3*4", 14), ("-2^2", -4), ("2**3**2", 512), ("sqrt(16)/4", 1), ("5 × 2", 10), ("7//2", 3), ("2*pi", 2 * math.pi), ("1/0", None), ("__import__('os')", None), ("9**9**9", None), ("", None), (None, None), ("(1+2", None), ("abs(-3)", 3)])
def test_calc(t, want):
    assert evaluate(t) == (pytest.approx(want) if want is not None else None)


def test_overlap(spark):
    df = spark.createDataFrame([("a b c d", "a b c e"), ("", ""), ("one two", "one two"), (None, "x")], "a string, b string")
    w = [r[0] for r in df.select(overlap.jaccard(overlap.word_shingles(F.coalesce("a", F.lit(""))), overlap.word_shingles(F.col("b")))).collect()]
    assert w == [pytest.approx(1 / 3), 0.0, 0.0, 0.0]
    c = spark.createDataFrame([("12345678",), ("1234567",)], "t string").select(overlap.char_shingles(F.col("t"))).collect()
    assert [r[0] for r in c] == [["12345678"], []]
    left = spark.createDataFrame([(1, "A  b", "x"), (2, "c", "x"), (3, None, "x")], "i int, t string, a string")
    right = spark.createDataFrame([("a b", "y"), ("a b", "x"), ("a b", "x")], "t string, a string")
    got = [(r["i"], r["n_copies"], r["same_answer"]) for r in overlap.exact_duplicates(left, right, "t", "a").collect()]
    assert got == [(1, 3, True)]


def test_search_against_brute_force(spark):
    rnd = random.Random(1)
    words = "volt amp ohm coil field wire flux heat".split()
    docs = [(i, " ".join(rnd.choices(words, k=rnd.randint(0, 9)))) for i in range(60)]
    d = spark.createDataFrame([*docs, (99, None)], "i int, t string")
    vocab, _ = retrieve.vocabulary(d, "t", 20)
    vec = {i: dict(zip(*map(list, retrieve.vector(t, vocab)))) for i, t in docs}
    got = {}
    for r in retrieve.search(d.filter("i % 20 = 0"), "i", "t", d, "i", "t", k=3, block=2, max_features=20).collect():
        got.setdefault(int(r["query_id"]), []).append((round(r["score"], 6), r["doc_id"]))
    for q in (0, 20, 40):
        s = sorted(((-round(sum(x * vec[q].get(t, 0) for t, x in v.items()), 9), str(i)) for i, v in vec.items()))
        want = [(round(-a, 6), b) for a, b in s if a < 0][:3]
        assert sorted(got.get(q, []), key=lambda x: (-x[0], x[1])) == want
    assert retrieve.search(d.limit(0), "i", "t", d, "i", "t").count() == 0


def test_sources_and_sinks(spark, tmp_path):
    logic = [{"premises-NL": ["p1"], "questions": ["q1", "q2", "q3"], "answers": ["Yes", "No"], "idx": [[1], [1]]}, {"questions": [], "answers": []}]
    (tmp_path / "l.json").write_text(json.dumps(logic))
    rows = readers.read_logic(spark, str(tmp_path / "l.json")).collect()
    assert [(r["question"], r["answer"], r["explanation"]) for r in rows] == [("q1", "Yes", ""), ("q2", "No", "")]
    (tmp_path / "p.csv").write_text('id,question,answer,unit,cot\n1,"a\nb",5,-,\n2,c,,V,\n3,d,7,V,x\n')
    p = readers.read_physics(spark, str(tmp_path / "p.csv"))
    assert {r["id"]: r["answer"] for r in p.collect()} == {"1": "5", "3": "7 V"}
    assert readers.all_samples(readers.read_logic(spark, str(tmp_path / "l.json")), p).count() == 4
    (tmp_path / "d.json").write_text('{"ablation": [{"a": 1}, {"a": 2}]}')
    assert [r["a"] for r in readers.read_document(spark, str(tmp_path / "d.json"), "ablation", "a int").collect()] == [1, 2]
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert readers.read_jsonl(spark, str(tmp_path / "x.jsonl"), "a int").count() == 2
    e = readers.entailment(spark.createDataFrame([("x", "True"), ("y", "odd")], "c string, label string"))
    assert [r["answer"] for r in e.collect()] == ["yes"]
    df = spark.createDataFrame([(1, "abc"), (2, "d")], "u int, t string")
    writers.write_units(df, str(tmp_path / "u"), "u")
    writers.write_units(df.filter("u = 2").withColumn("t", F.lit("e")), str(tmp_path / "u"), "u")
    assert {r["u"]: r["t"] for r in spark.read.parquet(str(tmp_path / "u")).collect()} == {1: "abc", 2: "e"}
    for n in (1, 2):
        writers.write_status(spark, {"a": n}, str(tmp_path / "s.json"))
    assert json.loads((tmp_path / "s.json").read_text()) == {"a": 2}
    writers.write_dual(df, str(tmp_path / "o"), "1", True)
    assert spark.read.json(str(tmp_path / "o_latest")).count() == 2
    assert readers.first_existing(spark, str(tmp_path / "none"), str(tmp_path / "s.json")).endswith("s.json")


def test_streaming(spark, tmp_path):
    spark.createDataFrame([("a", True), ("a", False), ("b", True)], "g string, ok boolean").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("g string, ok boolean").parquet(str(tmp_path / "in"))
    q = running.running_accuracy(stream, ["g"], "ok").writeStream.outputMode("complete").format("memory").queryName("acc").start()
    q.processAllAvailable()
    q.stop()
    assert {r["g"]: (r["n"], r["accuracy"]) for r in spark.table("acc").collect()} == {"a": (2, 0.5), "b": (1, 1.0)}


def test_requests(spark):
    from quaesta.operators import requests

    rows = [("7", None, "type1", None, "Q?", ["p"], ["Yes", None]), (None, "8", "odd", "x", "y", ["p"], None), ("9", "", None, "z", None, None, [])]
    df = spark.createDataFrame(rows, "query_id string, id string, type string, query string, question string, premises array<string>, options array<string>")
    got = [(r["query_id"], r["subject"], r["query"], r["options"]) for r in requests.normalise(df).collect()]
    assert got == [("7", "logic", "Q?", ["Yes"]), ("8", "logic", "x", []), ("9", "", "z", [])]
    assert requests.normalise(spark.createDataFrame([("a",)], "question string")).collect()[0]["content"] == "Question: a"
    assert requests.allow(df, "query_id", ["9"]).count() == 1 and requests.allow(df, "query_id", None).count() == 3


def test_lookup_prefers_exact_then_first(spark):
    t = spark.createDataFrame([("a" * 70 + "1", "x", 1), ("a" * 70 + "2", "y", 2), ("A  b", "z", 3), ("a b", "w", 4)], "k string, v string, o int")
    q = spark.createDataFrame([("a" * 80,), ("a b",), ("nothing",), (None,)], "t string")
    got = {r["t"]: r["v"] for r in fol.lookup(q, "t", t, "k", "v", "o").collect()}
    assert got == {"a" * 80: "x", "a b": "w", "nothing": None, None: None}


def test_lookup_finds_contained_fragments(spark):
    rnd = random.Random(3)
    words = ["coil", "charge", "flux", "baker", "hull", "vault"]
    some = lambda n: " ".join(rnd.choices(words, k=n))
    keys = [some(rnd.randint(2, 25)) for _ in range(60)] + ["", None]
    asked = [some(rnd.randint(1, 25)) for _ in range(40)] + ["please say: " + keys[i] for i in range(10)] + [keys[i][3:] for i in range(10)] + ["", None]
    t = spark.createDataFrame([(k, f"v{i}", i) for i, k in enumerate(keys)], "k string, v string, o int")
    q = spark.createDataFrame([(i, x) for i, x in enumerate(asked)], "i int, t string")
    got = {r["i"]: r["v"] for r in fol.lookup(q, "t", t, "k", "v", "o").collect()}
    for i, x in enumerate(asked):
        exact = [j for j, k in enumerate(keys) if k and k == x]
        near = [j for j, k in enumerate(keys) if x and k and (x[:60].strip() in k or k[:60] in x)]
        assert got[i] == (f"v{exact[-1]}" if exact else f"v{near[0]}" if near else None)


def test_very_long_texts_do_not_break_patterns(spark):
    from quaesta.functions import text as T
    from quaesta.functions import verify as V

    long = ["5 " + "a" * 200_000, "\\boxed{" + "x{y}" * 50_000, "<answer>" + "b " * 100_000, " " * 200_000 + "7", "{" * 50_000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(long)], "i int, t string")
    assert V.verify(df, "t", "t").filter("ok").count() >= 4
    assert df.select(F.length(T.flexible_extract(F.col("t")))).count() == 5


@pytest.mark.parametrize("n,k", [(20, 4), (20, 16), (30, 4), (200, 195), (5, 5)])
def test_bootstrap_interval_is_exact_binomial(spark, n, k):
    cdf = list(itertools.accumulate(math.comb(n, i) * (k / n) ** i * (1 - k / n) ** (n - i) for i in range(n + 1)))
    want = [round(100 * next(i for i, c in enumerate(cdf) if c >= u) / n, 2) for u in (0.025, 0.975)]
    d = spark.createDataFrame([("g", i < k) for i in range(n)], "g string, ok boolean")
    r = A.bootstrap(d, ["g"], "ok", 1000).collect()[0]
    assert [r["ci_low"], r["ci_high"]] == want


def test_closest_against_search(spark):
    rnd = random.Random(8)
    words = [f"w{i}" for i in range(30)]
    docs = spark.createDataFrame([(i, " ".join(rnd.choices(words, k=6))) for i in range(200)], "i int, t string").repartition(5)
    q = spark.createDataFrame([(i, " ".join(rnd.choices(words, k=4))) for i in range(20)] + [(99, "none of them")], "i int, t string")
    hits = retrieve.search(q, "i", "t", docs, "i", "t", k=10_000).collect()
    got = {r["query_id"]: (r["best_score"], r["n_close"]) for r in retrieve.closest(q, "i", "t", docs, "i", "t", close=0.5).collect()}
    for i in [*range(20), 99]:
        mine = [h["score"] for h in hits if h["query_id"] == str(i)]
        assert got[str(i)] == (max(mine, default=0.0), sum(x >= 0.5 for x in mine))


def test_search_with_mask(spark):
    docs = spark.createDataFrame([(1, "coil charge flux", "p"), (2, "coil charge", "l"), (3, "flux charge coil", "p")], "i int, t string, s string")
    q = spark.createDataFrame([(10, "coil charge", "l"), (11, "coil charge", "p"), (12, "coil charge", "z"), (13, "coil charge", None)], "i int, t string, s string")
    got = {}
    for r in retrieve.search(q, "i", "t", docs, "i", "t", k=3, min_df=1, mask=("s", "s")).collect():
        got.setdefault(r["query_id"], set()).add(r["doc_id"])
    assert got == {"10": {"2"}, "11": {"1", "3"}, "12": {"1", "2", "3"}, "13": {"1", "2", "3"}}


def test_running_accuracy_over_ranges(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice(["a", "a", "b", None]), i, rnd.choice([True, False, None])) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, i int, ok boolean").repartition(4)
    got = {(r["g"], r["i"]): (r["n_so_far"], r["accuracy_so_far"]) for r in E.running_accuracy(df, ["g"], ["i"], "ok").collect()}
    for g in ("a", "b", None):
        n, right, seen = 0, 0, 0
        for k, i, ok in rows:
            if k == g:
                n, right, seen = n + 1, right + (ok is True), seen + (ok is not None)
                assert got[(g, i)] == (n, None if not seen else pytest.approx(right / seen, abs=1e-6))


def test_boxed_of_any_depth(spark):
    deep = "x \\boxed{" + "{" * 12 + "5" + "}" * 12 + "} end"
    df = spark.createDataFrame([(deep,), ("\\boxed{" + "{" * 9,), ("\\boxed{1} and \\boxed{2}",)], "t string")
    assert [r[0] for r in df.select(text.boxed(F.col("t"))).collect()] == ["{" * 12 + "5" + "}" * 12, None, "2"]


def test_router_survives_saving(spark, tmp_path):
    rows = [(f"the coil has charge and flux {i}", "physics") for i in range(20)] + [(f"every baker follows the premise {i}", "logic") for i in range(20)]
    df = spark.createDataFrame(rows, "t string, y string")
    r = route.fit_router(df, "t", "y")
    r.save(str(tmp_path / "r"))
    back = route.Router.load(spark, str(tmp_path / "r"))
    got = [(a["model_label"], a["model_conf"], b["model_conf"], a["y"]) for a, b in zip(r.predict(df, "t").collect(), back.predict(df, "t").collect())]
    assert all(x == y and p == q for x, p, q, y in got)
