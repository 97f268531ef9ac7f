"""Pieces of DuckDB SQL for the driver's side-by-side check.

Nothing is taken from the Column code: patterns, tables and word lists are stated here once more, so
that an error on either side shows.
"""

from __future__ import annotations

WS_IN = r"\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
WS = f"[{WS_IN}]"
TAGS = ["reasoning", "answer", "explanation"]
TAG_PATTERN = r"(?is)<{0}>\s*(.*?)\s*</{0}>"
WORD_START, WORD_END = r"(?:^|[^\p{L}\p{N}_])", r"(?:[^\p{L}\p{N}_]|$)"
BRACED = r"(?:[^{}]|\{(?:[^{}]|\{(?:[^{}]|\{(?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*\})*\})*\})"
SCIENTIFIC_NUMBER = rf"(?s)([+-]?\d+(?:[.,]\d+)?){WS}*(?:[×xX*·]{WS}*10{WS}*[\^＾]?{WS}*(?:\(([+-]?\d+)\)|([+-]?\d+))|[eE]([+-]?\d+))(.*)$"
PLAIN_NUMBER = rf"(?s)^([+-]?\d+(?:[.,]\d+)?(?:[eE][+-]?\d+)?){WS}*([a-zA-ZμΩ\x{{2126}}°²³⁻/·{WS_IN}]*)"
RAISED, RAISED_AS = "⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻", "0123456789+-"
# Units by scale.
SCALES = {
    1e-12: "pj pc pa pf ps pm pw",
    1e-9: "nj nc na nf nh ns nm nw",
    1e-6: "μj uj μc uc μa ua μv uv μf uf μh uh μs us μm um μw uw μt ut",
    1e-3: "mj mc ma mv mf mω mohm mh ms mm mn mw mt mv/m",
    1e-2: "cm %",
    1e-1: "dm",
    1.0: "j c a v f ω ohm h hz s m n w t v/m rad",
    60.0: "min",
    1e3: "kj ka kv kω kohm khz km kn kw kv/m",
    1e6: "mhz",
    1e9: "ghz",
}
SAYS = {
    "yes": ["yes", "true", "correct", "affirmative"],
    "no": ["no", "false", "incorrect", "negative"],
    "unknown": ["unknown", "uncertain", "cannot be determined", "indeterminate", "maybe"],
}
REWARD_VARIANTS = {"R1": (0.30, 0.60, 0.10, -0.10), "R2": (0.30, 0.70, 0.00, 0.0), "R3": (0.00, 0.80, 0.10, 0.0), "R4": (0.00, 1.00, 0.00, 0.0)}
SEVEN_CLASSES = ["E1_unit_dimension", "E2_wrong_formula", "E3_arithmetic", "E4_logical_fallacy", "E5_misinterpretation", "E6_extraction", "E0_unclassified"]
SIX_CODES = ["AX", "LE", "UC", "FS", "AR", "PU"]
WORDS_OF_LOGIC = ["forall", "∀", "exists", "∃", "premise", "conclusion", "therefore", "implies", "contrapositive", "syllogism"]
WORDS_OF_FORMULAS = ["f=ma", "e=mc", "v=ir", "p=iv", "e=qv", "kinetic", "potential", "newton", "ohm", "coulomb", "faraday"]
UNIT_IN_TEXT = WORD_START + "(?:kg|m/s|j|n|w|pa|k|v|a|ω)" + WORD_END + r"|(?:[\p{L}\p{N}_])°c" + WORD_END
PHYSICS_KEYWORDS = [
    "voltage", "current", "resistance", "capacitor", "inductor", "capacitance", "inductance", "electric", "magnetic", "charge", "force", "energy",
    "power", "frequency", "wavelength", "circuit", "ohm", "ampere", "volt", "watt", "joule", "newton", "field", "wire", "coil", "solenoid",
    "transformer", "flux", "potential", "acceleration", "velocity", "momentum", "mass", "temperature", "heat", "pressure", "wave", "photon",
    "electron", "proton", "neutron", "nucleus", "atom", "resistor", "battery", "emf", "impedance", "reactance", "dielectric", "permittivity",
    "permeability", "resonance", "oscillation", "period", "hertz", "kilowatt", "milliamp", "microfarad", "ohm's", "kirchhoff", "faraday", "coulomb",
    "tesla", "weber", "lenz",
]
LOGIC_KEYWORDS = [
    "premise", "premises", "conclusion", "follows", "implies", "therefore", "hence", "infer", "deduce", "valid", "forall", "exists", "∀", "∃", "¬",
    "→", "∧", "∨", "true", "false", "unknown", "statement", "argument", "contrapositive", "converse", "inverse", "syllogism", "modus", "ponens",
    "tollens", "logic", "proposition", "predicate", "quantifier", "first-order", "boolean", "if then", "if and only if", "iff", "biconditional",
    "does it follow", "is the following", "must be true", "can we conclude", "consistent", "inconsistent",
]


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sub(x: str, pattern: str, to: str = "", flags: str = "g") -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(to)}, {q(flags)})"


def ext(x: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract({x}, {q(pattern)}, {group})"


def has(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {q(pattern)})"


def strip(x: str) -> str:
    return sub(x, f"^{WS}+|{WS}+$")


def normalize(x: str) -> str:
    return sub(f"lower({strip(x)})", "[.,;:!?]+$")


def strip_prefix(x: str) -> str:
    return strip(sub(x, r"^[A-Za-z_][A-Za-z_0-9]*(?:\s*\([^)]*\))?\s*=\s*", "", ""))


def tag(x: str, name: str) -> str:
    return strip(ext(x, TAG_PATTERN.format(name), 1))


def lines(x: str) -> str:
    return f"list_filter(list_transform(regexp_split_to_array({x}, {q(chr(92) + 'r' + chr(92) + 'n|' + chr(92) + 'n|' + chr(92) + 'r')}), lambda l: {strip('l')}), lambda l: l <> '')"


def simplify(x: str) -> str:
    for _ in range(5):
        x = sub(x, r"\\frac\{([^{}]*)\}\{([^{}]*)\}", r"\1/\2", "")
    x = sub(x, r"\\(?:text|mathrm|rm|bf|it|mbox)\{([^{}]*)\}", r"\1")
    x = sub(x, r"\\sqrt\{([^{}]*)\}", r"\1")
    return strip(sub(sub(x, r"\\[a-zA-Z]+"), r"[{}$^_]"))


def boxed(x: str) -> str:
    rest = f"list_extract(string_split({x}, '\\boxed{{'), -1)"
    p = rf"(?s)^({BRACED}*)\}}"
    return f"(case when contains({x}, '\\boxed{{') and {has(rest, p)} then {ext(rest, p, 1)} end)"


def answer(x: str) -> str:
    return f"(case when {has(x, TAG_PATTERN.format('answer'))} then {tag(x, 'answer')} else coalesce({simplify(boxed(x))}, list_extract({lines(x)}, -1), '') end)"


def translate(x: str, a: str, b: str) -> str:
    return f"translate({x}, {q(a)}, {q(b)})"


def unit_key(x: str) -> str:
    return f"lower(replace({translate(strip(x), 'Ω' + chr(0x2126), 'ωω')}, ' ', ''))"


UNIT_MAP = "MAP {'': 1.0::double, " + ", ".join(f"{q(u)}: {v!r}::double" for v, us in SCALES.items() for u in us.split()) + "}"
_VERDICT_OF = {w: v for v, ws in SAYS.items() for w in ws}
VERDICT_MAP = "MAP {" + ", ".join(f"{q(k)}: {q(v)}" for k, v in _VERDICT_OF.items()) + "}"


def scale(x: str) -> str:
    return f"coalesce({UNIT_MAP}[{unit_key(x)}], {UNIT_MAP}[{sub(unit_key(x), '[23]$', '', '')}])"


def parsed(source: str, columns: dict[str, str]) -> str:
    """SELECT adding <name>_value and <name>_unit of each text column, as nested selects."""
    a = ", ".join(f"{strip_prefix(strip_prefix(f'coalesce({c}, {q(str())})'))} AS {n}_t" for n, c in columns.items())
    b = ", ".join(f"{translate(f'{n}_t', RAISED, RAISED_AS)} AS {n}_s" for n in columns)
    g = lambda n, i: ext(f"{n}_s", SCIENTIFIC_NUMBER, i)
    sci_v = lambda n: f"try_cast(replace({g(n, 1)} || 'e' || {g(n, 2)} || {g(n, 3)} || {g(n, 4)}, ',', '.') as double)"
    c = ", ".join(
        f"case when {has(f'{n}_s', SCIENTIFIC_NUMBER)} then {sci_v(n)} when {has(f'{n}_t', PLAIN_NUMBER)} then try_cast(replace({ext(f'{n}_t', PLAIN_NUMBER, 1)}, ',', '.') as double) end AS {n}_value, "
        f"case when {has(f'{n}_s', SCIENTIFIC_NUMBER)} then {sub(strip(g(n, 5)), '^[.,;]+|[.,;]+$')} when {has(f'{n}_t', PLAIN_NUMBER)} then {strip(ext(f'{n}_t', PLAIN_NUMBER, 2))} else '' end AS {n}_unit"
        for n in columns
    )
    return f"(SELECT *, {c} FROM (SELECT *, {b} FROM (SELECT *, {a} FROM {source})))"


def same_scale(a: str, b: str) -> str:
    p, g = f"{UNIT_MAP}[{unit_key(a)}]", f"{UNIT_MAP}[{unit_key(b)}]"
    return f"(case when {a} = '' and {b} = '' then true when {p} is null or {g} is null then {unit_key(a)} = {unit_key(b)} else {p} = {g} end)"


def mcq(p: str, g: str) -> str:
    f = lambda x: f"upper(substr({sub(normalize(x), '^(?:option' + chr(92) + 's*|answer' + chr(92) + 's*|choice' + chr(92) + 's*)', '', '')}, 1, 1))"
    return f"({f(p)} = {f(g)})"


def yes_no(p: str, g: str) -> str:
    # the longest phrase that occurs decides
    found = " ".join(f"when {has(f'lower({p})', WORD_START + w + WORD_END)} then {q(_VERDICT_OF[w])}" for w in sorted(_VERDICT_OF, key=lambda w: -len(w)))
    return f"(coalesce({VERDICT_MAP}[{normalize(strip_prefix(p))}], case {found} end, {normalize(p)}) = coalesce({VERDICT_MAP}[{normalize(g)}], {normalize(g)}))"


def verified(source: str, pred: str, truth: str, keep: str = "*") -> str:
    """SELECT adding ok by the dispatch of V9, with pred_value, pred_unit, true_value, true_unit."""
    base = f"(SELECT *, coalesce({pred}, '') AS p0, coalesce({truth}, '') AS g FROM {source})"
    base = f"(SELECT *, case when contains(lower(p0), '<answer>') then {answer('p0')} else p0 end AS p FROM {base})"
    base = parsed(base, {"pred": "p", "true": "g"})
    ps, gs = f"(pred_value * coalesce({scale('pred_unit')}, 1.0))", f"(true_value * coalesce({scale('true_unit')}, 1.0))"
    num = f"(case when {gs} = 0 then abs({ps}) < 1e-9 else abs({ps} - {gs}) / abs({gs}) <= 0.02 end)"
    k = normalize("g")
    ok = (
        f"case when {k} in ('a','b','c','d') then {mcq('p', 'g')} when {k} in ('yes','no','unknown','true','false','uncertain') then {yes_no('p', 'g')} "
        f"when pred_value is not null and true_value is not null then {num} else {normalize(strip_prefix('p'))} = {normalize(strip_prefix('g'))} end"
    )
    return f"(SELECT {keep}, {ok} AS ok FROM {base})"


def pct(a: str, b: str, digits: int = 2) -> str:
    return f"case when {b} > 0 then round(100.0 * {a} / {b}, {digits}) else 0.0 end"


def accuracy(source: str, by: str) -> str:
    n = lambda s: f"count(*) filter (where subject = '{s}')"
    k = lambda s: f"count(*) filter (where subject = '{s}' and ok)"
    return (
        f"SELECT {by}, count(*) AS n_total, {n('physics')} AS n_physics, {n('logic')} AS n_logic, count(*) filter (where ok) AS n_correct, {pct('count(*) filter (where ok)', 'count(*)')} AS accuracy_overall, "
        f"{pct(k('physics'), n('physics'))} AS accuracy_physics, {pct(k('logic'), n('logic'))} AS accuracy_logic FROM {source} GROUP BY ALL"
    )


def words(x: str) -> str:
    return f"len(list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w <> ''))"


def reward(source: str, completion: str, truth: str) -> str:
    c = f"coalesce({completion}, '')"
    v = verified(source, completion, truth)
    v = v.replace("pred_value", "pv0").replace("pred_unit", "pu0").replace("true_value", "tv0").replace("true_unit", "tu0").replace("pred_t", "pt0").replace("pred_s", "ps0").replace("true_t", "tt0").replace("true_s", "ts0")
    b = parsed(v, {"a": c, "b": truth})
    filled = " + ".join(f"(case when {tag(c, t)} <> '' then 1 else 0 end)" for t in TAGS)
    return (
        f"(SELECT *, round(greatest(-0.1, least(1.0, r_format + r_correct + r_unit + r_length)), 6) AS reward FROM (SELECT *, round(0.30 * ({filled}) / 3, 6) AS r_format, case when ok then 0.60 else 0.0 end AS r_correct, "
        f"case when {same_scale('a_unit', 'b_unit')} then 0.10 else 0.0 end AS r_unit, case when {words(tag(c, 'reasoning'))} > 800 then -0.10 else 0.0 end AS r_length FROM {b}))"
    )


def any_of(x: str, ws: list[str]) -> str:
    return "(" + " or ".join(f"contains({x}, {q(w)})" for w in ws) + ")"


def heuristic(question: str, pred: str, truth: str, subject: str, raw: str, names: list[str]) -> str:
    ex, lo, un, fo, ar, sh, rest = names
    low = lambda c: f"lower(coalesce({c}, ''))"
    Q, P, G, R = low(question), low(pred), low(truth), low(raw)
    num = lambda c: f"try_cast(nullif({ext(c, chr(92) + 'd+' + chr(92) + '.?' + chr(92) + 'd*')}, '') as double)"
    d = f"abs({num(P)} - {num(G)})"
    return (
        f"case when contains({R}, '<reasoning>') and not contains({R}, '<answer>') then '{ex}' when {subject} = 'logic' and {any_of(Q, WORDS_OF_LOGIC)} then '{lo}' "
        f"when {subject} = 'physics' and {has(G, UNIT_IN_TEXT)} and not {has(P, UNIT_IN_TEXT)} then '{un}' when {subject} = 'physics' and {any_of(P, WORDS_OF_FORMULAS)} then '{fo}' "
        f"when {subject} = 'physics' and coalesce({d} > 0 and {d} < {num(G)} * 0.5, false) then '{ar}' when length({strip(f'coalesce({pred}, {q(str())})')}) < 5 then '{sh}' else '{rest}' end"
    )
