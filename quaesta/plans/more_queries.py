"""Further queries, with their SQL: literal vectors, round trips through sinks and sources, prompts and summaries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quaesta.common import scratch, table, write_text
from quaesta.functions import calc as C
from quaesta.functions import score as S
from quaesta.functions import text as T
from quaesta.functions import verify as V
from quaesta.operators import evaluate as E
from quaesta.operators import fol, requests
from quaesta.operators import stats as A
from quaesta.plans import duck as D
from quaesta.plans.reference_queries import ERRORS, FAIR, _errors, _fair
from quaesta.sources import readers, writers

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _lit(x) -> str:
    return "NULL" if x is None else D.q(x) if isinstance(x, str) else str(x).lower() if isinstance(x, bool) else repr(x) + "::double" if isinstance(x, float) else str(x)


def _values(rows: list[tuple], names: str) -> str:
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(_lit, r)) + ")" for r in rows) + f") v({names})"


# ---- literal vectors: inputs here, results stated in the SQL -------------------------------------------
ANSWERS = [
    ("100 μJ", "0.0001", True), ("0.0001", "1e-4 J", True), ("2 kΩ", "2000", True), ("2000", "2000 Ω", True), ("9.81", "9.8", True), ("9.81", "100.0", False), ("1.5 A", "2.5 A", False), ("The answer is yes.", "Yes", True),
    ("I know this is true.", "No", False), ("False", "No", True), ("True", "Yes", True), ("C", "C", True), ("a", "A", True), ("B", "A", False), ("9.81 m/s²", "9.81", True), ("Paris", "Paris", True), ("Paris", "London", False), (None, "3", False), ("", "3", False),
    ("I = 0.5 A", "500 mA", True), ("0", "0", True), ("1e-12", "0", True), ("1", "0", False), ("7 xyz", "7", True), ("<answer>5 V</answer>", "5 V", True),
]


@query(_values([(i, ok) for i, (_, _, ok) in enumerate(ANSWERS)], "id, ok"))
def known_answers(spark, d):
    """V2-V4, V6-V9 on stated pairs."""
    df = spark.createDataFrame([(i, p, g) for i, (p, g, _) in enumerate(ANSWERS)], "id int, p string, g string")
    return V.verify(df, "p", "g").select("id", "ok")


NUMBERS = [
    ("9.71 × 10^7 V/m", 9.71e7, "V/m"), ("1.5*10^-3 A", 1.5e-3, "A"), ("3.2e4 Hz", 3.2e4, "Hz"), ("6.67 × 10^-11 N·m²/kg²", 6.67e-11, "N·m2/kg2"), ("I_total = 1.5 A", 1.5, "A"), ("P = 9.0 W", 9.0, "W"), ("unknown text", None, ""), ("2,5 V", 2.5, "V"), ("-3", -3.0, ""), ("", None, ""), (None, None, ""),
    ("2 × 10⁻³ T", 2e-3, "T"), ("4×10^(2) m", 400.0, "m"),
]


@query(_values([(i, v, u) for i, (_, v, u) in enumerate(NUMBERS)], "id, value, unit"))
def known_numbers(spark, d):
    """V1, V2, X6 on stated texts."""
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(NUMBERS)], "id int, t string")
    return V.parse(df, F.col("t"), "v").select("id", F.col("v_value").alias("value"), F.col("v_unit").alias("unit"))


FULL = "<reasoning>{r}</reasoning><answer>5 V</answer><explanation>e</explanation>"
COMPLETIONS = [(FULL.format(r="so"), "5 V", 0.3, 0.6, 0.1, 0.0, 1.0), ("<answer>5 V</answer>", "5 V", 0.1, 0.6, 0.1, 0.0, 0.8), ("nothing", "5 V", 0.0, 0.0, 0.1, 0.0, 0.1), (FULL.format(r="w " * 900), "5 V", 0.3, 0.6, 0.1, -0.1, 0.9), (None, "7 mm", 0.0, 0.0, 0.0, 0.0, 0.0)]


@query(_values([(i, *r[2:]) for i, r in enumerate(COMPLETIONS)], "id, r_format, r_correct, r_unit, r_length, reward"))
def known_rewards(spark, d):
    """R1-R6 on stated completions."""
    df = spark.createDataFrame([(i, r[0], r[1]) for i, r in enumerate(COMPLETIONS)], "id int, c string, g string")
    return S.reward(df, "c", "g").select("id", *[F.col(c).cast("double").alias(c) for c in ("r_format", "r_correct", "r_unit", "r_length", "reward")])


P_VALUES = [(0.0001, "***"), (0.001, "**"), (0.0099, "**"), (0.01, "*"), (0.049, "*"), (0.05, "n.s."), (1.0, "n.s.")]


@query(_values([(p, s) for p, s in P_VALUES], "p, label"))
def significance_labels(spark, d):
    """A16 at its borders."""
    return spark.createDataFrame([(p,) for p, _ in P_VALUES], "p double").select("p", A.significance(F.col("p")).alias("label"))


RULES = [
    (["∀x (P(x) → Q(x))", "P(a)"], "∀x Q(x)", "yes"), (["∀x (P(x) → Q(x))", "∀x (Q(x) → ¬R(x))"], "∃x (P(x) ∧ R(x))", "no"), (["∀x (A(x) -> B(x))"], "∀x (B(x) → A(x))", "unknown"), (["ForAll(x, Implies(Man(x), Mortal(x)))", "Man(socrates)"], "Mortal(socrates)", "yes"),
    (["∃x (P(x) ∧ Q(x))"], "∃x Q(x)", "yes"), (["loves(x, y)"], "A(x)", None), ([f"∀x (P{i}(x) → P{i + 1}(x))" for i in range(24)] + ["P0(a)"], "∀x P24(x)", "yes"), (["∀x (" + " ∨ ".join(f"(A{i}(x) ∧ B{i}(x))" for i in range(24)) + ")"], "∀x A0(x)", "unknown"),
]


@query(_values([(i, v) for i, (_, _, v) in enumerate(RULES)], "id, verdict"))
def known_verdicts(spark, d):
    """F2, F6, F7 on stated rule sets, more than 20 predicates and wide disjunctions among them."""
    df = spark.createDataFrame([(i, p, c) for i, (p, c, _) in enumerate(RULES)], "id int, p array<string>, c string")
    return df.select("id", fol.fol_verdict(F.col("p"), F.col("c")).alias("verdict"))


# ---- sinks and sources: written, read back ----------------------------------------------------------
@query("SELECT lower(lang) AS lang, count(*) AS n, sum(length(text)) AS chars FROM documents GROUP BY 1")
def jsonl_round_trip(spark, d):
    """All documents as JSON lines and back."""
    path = scratch(spark, "jsonl")
    writers.write_jsonl(table(spark, d, "documents").select("doc_id", "lang", "text"), path)
    back = readers.read_jsonl(spark, path, "doc_id bigint, lang string, text string")
    return back.groupBy(F.lower("lang").alias("lang")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


@query(f"SELECT o, sheet, count(*) AS n FROM {ERRORS}, (SELECT unnest(['stamped', 'latest']) AS o) GROUP BY ALL")
def dual_outputs(spark, d):
    """A stamped output and the latest one."""
    path = scratch(spark, "dual")
    e = _errors(spark, d).select("idx", "sheet")
    writers.write_dual(e, path, "20260101", True)
    one = lambda o, p: readers.read_jsonl(spark, p, "idx bigint, sheet string").groupBy("sheet").agg(F.count(F.lit(1)).alias("n")).withColumn("o", F.lit(o))
    return one("stamped", f"{path}_20260101").unionByName(one("latest", f"{path}_latest")).select("o", "sheet", "n")


@query("SELECT 'completed' AS status, 3 AS step")
def status_round_trip(spark, d):
    """A status file written twice; the reader sees the last one."""
    path = scratch(spark, "status") + ".json"
    for n, s in ((2, "running"), (3, "completed")):
        writers.write_status(spark, {"status": s, "step": n}, path)
    return spark.read.schema("status string, step int").json(path, multiLine=True)


@query(f"SELECT idx, length(substr(coalesce(question, ''), 1, 80)) AS question_chars, length(substr(coalesce(raw_snippet, ''), 1, 200)) AS snippet_chars FROM {ERRORS}")
def sheet_round_trip(spark, d):
    """Annotated errors as a CSV with cut columns and back; quotes and line ends survive."""
    path = scratch(spark, "sheet")
    writers.write_sheet(_errors(spark, d).select("idx", "question", "raw_snippet"), path, {"question": 80, "raw_snippet": 200})
    back = spark.read.schema("idx bigint, question string, raw_snippet string").csv(path, header=True, multiLine=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, lineSep="\n")
    n = lambda c: F.length(F.coalesce(c, F.lit(""))).cast("long")
    return back.select("idx", n("question").alias("question_chars"), n("raw_snippet").alias("snippet_chars"))


@query(f"SELECT bid, case when bid = 'M2' then count(*) filter (where correct) else count(*) end AS n FROM {FAIR} GROUP BY bid")
def units_round_trip(spark, d):
    """A partition per baseline; one of them is written again and replaces only itself."""
    path = scratch(spark, "units")
    f = _fair(spark, d).select("sample_id", "bid", "correct")
    writers.write_units(f, path, "bid")
    writers.write_units(f.filter("bid = 'M2' and correct"), path, "bid")
    return spark.read.parquet(path).groupBy("bid").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 2 AS version, lower(lang) AS lang, count(*) AS n FROM documents GROUP BY ALL")
def index_round_trip(spark, d):
    """A versioned index; a version that was not written is not found."""
    path = scratch(spark, "index")
    writers.write_index(table(spark, d, "documents").groupBy(F.lower("lang").alias("lang")).agg(F.count(F.lit(1)).alias("n")), path, 2)
    found = [(v, writers.read_index(spark, path, v)) for v in (1, 2)]
    return [df.select(F.lit(v).alias("version"), "lang", "n") for v, df in found if df is not None][0]


@query("SELECT n_nationkey AS k, n_name AS name FROM nation")
def document_scan(spark, d):
    """An array field of a JSON document, written from all nations."""
    path = scratch(spark, "document") + ".json"
    rows = table(spark, d, "nation").select(F.to_json(F.collect_list(F.struct(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))).over(Window.partitionBy())).alias("j")).limit(1).collect()
    write_text(spark, '{"nations": ' + rows[0]["j"] + ', "other": 1}', path)
    return readers.read_document(spark, path, "nations", "k int, name string")


@query("SELECT r_name FROM region")
def fallback_source(spark, d):
    """The first of several paths that exists."""
    return spark.read.parquet(readers.first_existing(spark, f"{d}/none.parquet", f"{d}/region.parquet")).select("r_name")


_USER = "(SELECT *, coalesce(list_extract(list_filter(prompt, lambda m: m.role = 'user'), 1).content, '') AS u FROM val_samples)"
_QTEXT = D.strip("regexp_extract(u, '(?is)question:(.*)', 1)")
_PREMISES = "list_transform(list_filter(" + D.lines("string_split(u, 'Question:')[1]") + ", lambda l: regexp_matches(l, '^[0-9]')), lambda l: " + D.strip("substr(l, 4)") + ")"


def _val(spark, d):
    return table(spark, d, "val_samples").withColumn("u", T.first_user(F.col("prompt")))


@query(f"SELECT question, answer, explanation, len(p)::bigint AS n_premises FROM (SELECT {_QTEXT} AS question, answer, coalesce(explanation, '') AS explanation, {_PREMISES} AS p FROM {_USER} WHERE type = 'logic')")
def logic_scan(spark, d):
    """Nested records with more questions than answers, written as JSON and flattened."""
    path = scratch(spark, "logic")
    v = _val(spark, d).filter("type = 'logic'")
    q = T.question_text(F.col("u"))
    raw = v.select(T.prompt_premises(F.col("u")).alias("premises-NL"), F.array().cast("array<string>").alias("premises-FOL"), F.array(q, F.concat(q, F.lit("?"))).alias("questions"), F.array("answer").alias("answers"), F.array(F.coalesce("explanation", F.lit(""))).alias("explanation"), F.array(F.array(F.lit(1))).alias("idx"))
    raw.write.json(path, ignoreNullFields=False)
    # one record per line is a special case of a JSON document
    got = readers.flatten_logic(spark.read.schema(readers.schemas.LOGIC_RAW).json(path))
    return got.select("question", "answer", "explanation", F.size("premises_nl").cast("long").alias("n_premises"))


@query(f"SELECT idx, case lower({D.strip('ground_truth')}) when 'true' then 'yes' when 'false' then 'no' when 'uncertain' then 'unknown' when 'unknown' then 'unknown' when 'yes' then 'yes' when 'no' then 'no' end AS answer FROM {ERRORS} WHERE lower({D.strip('ground_truth')}) in ('true', 'false', 'uncertain', 'unknown', 'yes', 'no')")
def entailment_scan(spark, d):
    """Entailment labels; rows with any other label are dropped."""
    return readers.entailment(_errors(spark, d).select("idx", F.col("ground_truth").alias("label"))).select("idx", "answer")


@query("SELECT r_name || chr(10) || 'A. ' || r_name || chr(10) || 'B. none' AS question, substr('AB', 1 + r_regionkey % 2, 1) AS answer FROM region")
def choice_scan(spark, d):
    """Lettered choices."""
    r = table(spark, d, "region").select(F.col("r_name").alias("question"), F.array("r_name", F.lit("none")).alias("choices"), (F.col("r_regionkey") % 2).cast("int").alias("answer"))
    return readers.multiple_choice(r)


# ---- filters and projections --------------------------------------------------------------------------
@query(f"SELECT question_id, {_QTEXT} AS query, answer AS target FROM {_USER} WHERE type = 'physics'")
def training_columns(spark, d):
    """One subject, columns renamed for training."""
    return _val(spark, d).filter("type = 'physics'").select("question_id", T.question_text(F.col("u")).alias("query"), F.col("answer").alias("target"))


@query("SELECT doc_id, length(text) AS n FROM documents ORDER BY doc_id LIMIT 50")
def first_documents(spark, d):
    """The first 50 in an explicit order (the limit is the feature)."""
    return E.pick_first(table(spark, d, "documents").select("doc_id", F.length("text").cast("long").alias("n")), ["doc_id"], 50)


@query(f"SELECT bid, count(*) AS n FROM {FAIR} WHERE bid in ('M2', 'M4', 'none') GROUP BY bid")
def allow_list(spark, d):
    """P12."""
    return requests.allow(_fair(spark, d), "bid", ["M2", "M4", "none"]).groupBy("bid").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH a AS (SELECT bid, avg(coalesce(correct, false)::int) AS acc FROM {FAIR} GROUP BY bid) SELECT sample_id, bid FROM {FAIR} WHERE not coalesce(correct, false) and bid = (SELECT bid FROM a ORDER BY acc DESC, bid LIMIT 1)")
def wrong_answers(spark, d):
    """Wrong rows of the best baseline."""
    return E.wrong_only(_fair(spark, d), "bid", "correct").select("sample_id", "bid")


@query(f"SELECT strategy AS best, round(acc, 6) AS best_value FROM (SELECT strategy, avg(correct::int) AS acc FROM {FAIR} GROUP BY strategy) ORDER BY acc DESC, strategy LIMIT 1")
def best_strategy(spark, d):
    """A9."""
    g = _fair(spark, d).groupBy("strategy").agg(F.avg(F.col("correct").cast("double")).alias("acc"))
    return E.best_group(g, "strategy", "acc").select("best", F.round("best_value", 6).alias("best_value"))


@query(
    f"WITH v AS (SELECT question_id, prediction_extracted AS a, count(*) AS n, min(sample_id) AS p FROM {FAIR} WHERE prediction_extracted IS NOT NULL GROUP BY ALL), w AS (SELECT question_id, arg_max(a, (n, -p)) AS winner, arg_max(p, (n, -p)) AS pos FROM v GROUP BY question_id) SELECT w.question_id, winner, length(coalesce(f.prediction_raw, '')) AS raw_chars FROM w JOIN {FAIR} f ON f.sample_id = w.pos"
)
def vote_representative(spark, d):
    """The first whole response among those that gave the winning answer."""
    f = _fair(spark, d).filter("prediction_extracted is not null").withColumn("raw", F.coalesce("prediction_raw", F.lit("")))
    return E.vote(f, ["question_id"], "prediction_extracted", "sample_id", raw="raw").select("question_id", "winner", F.length("winner_raw").cast("long").alias("raw_chars"))


_FMT = "((case when " + D.has("t", D.TAG_PATTERN.format("reasoning")) + " then 0.33 else 0.0 end) + (case when " + D.has("t", D.TAG_PATTERN.format("answer")) + " then 0.34 else 0.0 end) + (case when " + D.has("t", D.TAG_PATTERN.format("explanation")) + " then 0.33 else 0.0 end))::double"


@query(
    f"SELECT bid, count(*) AS n, round(avg(ok::int), 4) AS accuracy, round(avg(has::int), 4) AS verified_rate, round(avg((fmt > 0.99)::int), 4) AS format_ok_rate, round(avg(attempt), 3) AS avg_retries, round(avg(case when ok then 0.85 + 0.15 * fmt else 0.30 * fmt end), 4) AS avg_confidence, round(sum(sec) / 60, 2) AS total_min, round(avg(sec), 2) AS avg_seconds, round(avg((length(x) >= 20)::int), 4) AS explained_rate "
    f"FROM (SELECT bid, coalesce(correct, false) AS ok, {D.has('t', D.TAG_PATTERN.format('answer'))} AS has, {_FMT} AS fmt, attempt, date_part('second', scored_at)::double AS sec, {D.tag('t', 'explanation')} AS x FROM (SELECT *, coalesce(prediction_raw, '') AS t, row_number() over (partition by question_id, bid order by sample_id) - 1 AS attempt FROM {FAIR})) GROUP BY bid"
)
def agent_summary(spark, d):
    """Summary of each baseline's run; the attempt's number stands for its retries."""
    c = F.coalesce("prediction_raw", F.lit(""))
    w = Window.partitionBy("question_id", "bid").orderBy("sample_id")
    f = _fair(spark, d).withColumns({"ok": F.coalesce("correct", F.lit(False)), "fmt": S.format_score(c).cast("double"), "attempt": F.row_number().over(w) - 1, "sec": F.second("scored_at").cast("double"), "x": T.tag_body(c, "explanation"), "has": T.has_tag(c, "answer")})
    f = f.withColumns({"well": F.col("fmt") > 0.99, "conf": S.confidence(F.col("ok"), F.col("fmt")).cast("double")})
    return E.run_summary(f, ["bid"], "ok", "has", "well", "attempt", "conf", "sec", "x")


# ---- prompts and responses -----------------------------------------------------------------------------
_SUBJECT = f"case when lower({D.strip('type')}) in ('physics', 'logic') then lower({D.strip('type')}) when len(p) > 0 then 'logic' else '' end"


@query(
    f"SELECT question_id, case when s = 'logic' and len(p) > 0 then 'Premises:' || chr(10) || array_to_string(list_transform(p, lambda x, i: '  ' || i || '. ' || x), chr(10)) || chr(10) || chr(10) || 'Question: ' || qt else 'Question: ' || qt end AS content "
    f"FROM (SELECT *, {_SUBJECT} AS s FROM (SELECT *, {_PREMISES} AS p, {_QTEXT} AS qt FROM {_USER}))"
)
def request_contents(spark, d):
    """The prompt text of each validation question as a request."""
    r = _val(spark, d).select(F.col("question_id").cast("string").alias("id"), "type", T.question_text(F.col("u")).alias("question"), T.prompt_premises(F.col("u")).alias("premises_nl"))
    return requests.normalise(r).select(F.col("query_id").cast("int").alias("question_id"), "content")


def _shot_sql(head: str, longest: int, mark: str, room: int | None, mark_e: str) -> str:
    cut = lambda c, n, m: f"case when length({c}) > {n} then substr({c}, 1, {n}) || {D.q(m)} else {c} end"
    one = f"chr(10) || 'Example 1:' || chr(10) || {cut('q', longest, mark)} || chr(10) || '<answer>' || chr(10) || a || chr(10) || '</answer>'"
    if room is not None:
        one += f" || chr(10) || '<explanation>' || chr(10) || {cut('e', room, mark_e)} || chr(10) || '</explanation>'"
    return f"{D.q(head)} || chr(10) || {one} || chr(10) || chr(10) || '--- Now answer the following ---' || chr(10)"


_SHOTS = {
    "live": _shot_sql("\n--- Reference examples (similar problems) ---", 400, "...", 200, ""),
    "first": _shot_sql("\n--- Reference examples (similar problems) ---", 400, "...", 200, "..."),
    "runner": _shot_sql("\n--- Reference examples ---", 300, "", None, ""),
}


@query("SELECT question_id, " + ", ".join(f"{v} AS {k}" for k, v in _SHOTS.items()) + " FROM (SELECT question_id, coalesce(cot, '') || coalesce(cot, '') || coalesce(cot, '') AS q, answer AS a, coalesce(cot, '') AS e FROM val_samples)")
def few_shot_blocks(spark, d):
    """The three variants, on long questions (the worked solution three times over)."""
    e = F.coalesce("cot", F.lit(""))
    v = table(spark, d, "val_samples").withColumn("ex", F.array(F.struct(F.concat(e, e, e).alias("question"), "answer", e.alias("explanation"))))
    return v.select("question_id", *[T.few_shot(F.col("ex"), k).alias(k) for k in T.FEW_SHOT])


@query("SELECT question_id, coalesce(cot, list_extract(list_filter(prompt, lambda m: m.content IS NOT NULL), -1).content, '') AS completion FROM val_samples")
def completion_texts(spark, d):
    """A plain completion, or else the last message."""
    return table(spark, d, "val_samples").select("question_id", T.completion_text(F.col("prompt"), F.col("cot")).alias("completion"))


_DEF = lambda c, v: f"case when {D.strip(f'coalesce({c}, {D.q(str())})')} = '' then {D.q(v)} else {D.strip(c)} end"


@query(f"SELECT sample_id, '<answer>' || chr(10) || {_DEF('prediction_extracted', 'unknown')} || chr(10) || '</answer>' || chr(10) || '<explanation>' || chr(10) || {_DEF('x', 'No explanation available.')} || chr(10) || '</explanation>' AS final FROM (SELECT *, {D.tag('coalesce(prediction_raw, ' + D.q('') + ')', 'explanation')} AS x FROM {FAIR})")
def final_responses(spark, d):
    """X25."""
    x = T.tag_body(F.coalesce("prediction_raw", F.lit("")), "explanation")
    return _fair(spark, d).select("sample_id", T.answer_xml(F.col("prediction_extracted"), x).alias("final"))


@query(
    f"SELECT sample_id, case when subject = 'logic' and v <> '' then v when subject = 'physics' then (question_id * 3)::varchar || ' V' else prediction_extracted end AS answer, case when subject = 'logic' and v <> '' then 'fol' when subject = 'physics' then 'calc' else 'none' end AS tool FROM (SELECT *, case when lower(prediction_extracted) in ('yes', 'no', 'unknown') then lower(prediction_extracted) else '' end AS v FROM {FAIR})"
)
def tool_answers(spark, d):
    """The logic verdict, the recomputed <calc> of a physics response with its unit, or the answer itself."""
    f = _fair(spark, d).withColumn("raw", F.concat(F.lit("so <calc>"), F.col("question_id").cast("string"), F.lit("*6/2</calc> V")))
    low = F.lower("prediction_extracted")
    t = C.apply_tool(F.col("subject"), F.col("prediction_extracted"), F.when(low.isin("yes", "no", "unknown"), low), T.tag_body(F.col("raw"), "calc"), F.lit("V"))
    return f.select("sample_id", t.alias("t")).select("sample_id", "t.answer", "t.tool")


_OPTION = "['A. Yes', 'B. No', 'C. Uncertain', 'D. None']"


@query(
    f"SELECT idx, coalesce(list_extract(list_filter({_OPTION}, lambda o: lower(o) = a), 1), case when canon IS NOT NULL then list_extract(list_filter({_OPTION}, lambda o: contains(lower(o), canon)), 1) end, case when regexp_full_match(a, '\\p{{L}}') then list_extract(list_filter({_OPTION}, lambda o: starts_with(lower(o), a || '.') or starts_with(lower(o), a || ')') or lower(o) = a), 1) end, case when a <> '' then list_extract(list_filter({_OPTION}, lambda o: contains(lower(o), a) or contains(a, lower(o))), 1) end, p) AS option "
    f"FROM (SELECT *, case when a in ('yes', 'true') then 'yes' when a in ('no', 'false') then 'no' when a in ('unknown', 'uncertain') then 'uncertain' end AS canon FROM (SELECT idx, coalesce(prediction, '') AS p, lower({D.strip('coalesce(prediction, ' + D.q('') + ')')}) AS a FROM {ERRORS}))"
)
def option_matches(spark, d):
    """X11."""
    opts = F.array(*map(F.lit, ["A. Yes", "B. No", "C. Uncertain", "D. None"]))
    return _errors(spark, d).select("idx", T.match_option(F.coalesce("prediction", F.lit("")), opts).alias("option"))


@query(
    f"SELECT idx, case when len(ok) > 0 then ok else range(0, 12) end AS premises FROM (SELECT idx, list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(coalesce(raw_snippet, ''), '(?i)premises?\\s*#?\\s*(\\d+)', 1), lambda x: coalesce(try_cast(x as int), -1) - 1), lambda i: i >= 0 and i < 12))) AS ok FROM {ERRORS})"
)
def premises_cited(spark, d):
    """Premises named in the snippet, all twelve if none is."""
    raw = F.coalesce("raw_snippet", F.lit(""))
    return _errors(spark, d).select("idx", F.transform(T.premises_used(raw, raw, F.lit(12)), lambda i: i.cast("long")).alias("premises"))


@query(f"SELECT idx, {D.strip('coalesce(notes, ' + D.q('') + ')')} AS note, replace(replace(replace({D.strip('coalesce(prediction, ' + D.q('') + ')')}, 'μ', 'u'), 'Ω', 'ohm'), '²', '^2') AS ascii FROM {ERRORS} WHERE regexp_full_match({D.strip('coalesce(prediction, ' + D.q('') + ')')}, '[ -~μΩ²]*')")
def ascii_units(spark, d):
    """X15, on predictions with no other sign than μ, Ω and ² (what is replaced further is stated in the tests)."""
    p = T.strip(F.coalesce("prediction", F.lit("")))
    return _errors(spark, d).filter(p.rlike(r"^[ -~μΩ²]*$")).select("idx", T.strip(F.coalesce("notes", F.lit(""))).alias("note"), S.ascii_unit(p).alias("ascii"))


# ---- rule lookup on the tables' own records -------------------------------------------------------------
@query(f"SELECT count(*) AS total, count(*) filter (where lower(trim(ground_truth)) = 'yes') AS yes, count(*) filter (where lower(trim(ground_truth)) = 'no') AS no, count(*) filter (where coalesce(lower(trim(ground_truth)), '') not in ('yes', 'no')) AS other FROM {ERRORS}")
def lookup_stats(spark, d):
    """F8."""
    return fol.lookup_stats(_errors(spark, d), "ground_truth")


@query(f"SELECT question_id, list_filter([1, 2, 5, 9], lambda i: i <= len(p)) AS picked, len(p)::bigint AS n_all FROM (SELECT question_id, {_PREMISES} AS p FROM {_USER} WHERE type = 'logic')")
def relevant_premises(spark, d):
    """premises picked by 1-based numbers, those out of range dropped (shown by their place)."""
    v = _val(spark, d).filter("type = 'logic'")
    p = T.prompt_premises(F.col("u"))
    n = v.select("question_id", p.alias("p"), F.transform(p, lambda x, i: (i + 1).cast("int")).alias("i"))
    return n.select("question_id", fol.relevant_premises(F.col("i"), F.array(*map(F.lit, [1, 2, 5, 9]))).alias("picked"), F.size("p").cast("long").alias("n_all"))


@query()
def rule_verdicts(spark, d):
    """F1, F3-F7, J9 in one plan: the annotated question looked up among the others' answers, predicates of its
    snippet, the conclusion its text states, and the verdict of the snippet's formulas (rows only: a solver)."""
    e = _errors(spark, d).filter("subject = 'logic'")
    found = fol.lookup(e.select("idx", "question", "prediction", "raw_snippet"), "question", e.select("question", "ground_truth", "idx"), "question", "ground_truth", "idx")
    snippet = F.coalesce("raw_snippet", F.lit(""))
    formulas = F.regexp_extract_all(snippet, F.lit(r"([∀∃]\w ?\([^\n]*?\)\))"), F.lit(1))
    names = fol.predicates(snippet)
    goal = F.coalesce(fol.conclusion(snippet, names), F.element_at(F.when(F.size(formulas) > 0, formulas), 1))
    return found.select("idx", F.col("ground_truth").alias("looked_up"), F.size(names).alias("n_predicates"), goal.alias("goal"), fol.fol_verdict(F.when(F.size(formulas) > 1, F.slice(formulas, 2, 100)), goal).alias("verdict"))
