"""Entailment in monadic first-order logic, and routing by a trained model (F, T2).

Formulas have unary predicates over one variable, without functions or equality, so elements do not
influence each other: premises are satisfiable iff their universal bodies are together satisfiable
for one element, and so are they with each existential body. Each test is a small propositional
search (DPLL) in an Arrow UDF; a search beyond `steps` decisions gives no verdict, as a timeout would.
Disjunctions of large formulas are named by a definition, so clause forms stay as small as the formula.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_LEX = re.compile(r"\s*(?:(?P<quant>∀|∃|(?:forall|exists)\b(?!\s*\())|(?P<imp>→|->|⟹|⇒|=>)|(?P<iff>↔|<->|⇔)|(?P<and>∧|&&?|\band\b)|(?P<or>∨|\|\|?|\bor\b)|(?P<not>¬|~|!|\bnot\b)|(?P<name>[A-Za-z_]\w*)|(?P<sym>[(),.:]))", re.I)


class Parser:
    """Recursive descent over: quantifiers, ↔, →, ∨, ∧, ¬, atoms P(x), and the functional forms ForAll,
    Exists, Implies, And, Or, Not. Gives (quantifier, body); a ground fact P(c) is read as ∀x P(x)."""

    def __init__(self, text: str) -> None:
        self.toks: list[tuple[str, str]] = []
        i = 0
        text = text.strip().rstrip(".")
        while i < len(text):
            m = _LEX.match(text, i)
            if not m or m.end() == i:
                if text[i:].strip():
                    raise ValueError(text[i:])
                break
            self.toks.append((m.lastgroup, m[m.lastgroup]))
            i = m.end()
        self.i = 0

    def peek(self, k: int = 0) -> tuple[str, str]:
        return self.toks[self.i + k] if self.i + k < len(self.toks) else ("", "")

    def take(self, value: str | None = None) -> str:
        t = self.peek()[1]
        if value is not None and t != value:
            raise ValueError(f"{value} expected")
        self.i += 1
        return t

    def formula(self) -> tuple[str, tuple]:
        q = "all"
        kind, t = self.peek()
        if kind == "quant":
            self.take()
            q = "all" if t.lower() in ("∀", "forall") else "some"
            self.take()
            if self.peek()[1] in (".", ":"):
                self.take()
        elif kind == "name" and t.lower() in ("forall", "exists") and self.peek(1)[1] == "(":
            q = "all" if t.lower() == "forall" else "some"
            self.take(), self.take("(")
            while self.peek()[1] != ",":
                self.take()
            self.take(",")
            body = self.iff()
            self.take(")")
            return q, body
        body = self.iff()
        if self.i != len(self.toks):
            raise ValueError("rest")
        return q, body

    def _binary(self, kind: str, lower, right: bool = False):
        a = lower()
        if self.peek()[0] != kind:
            return a
        self.take()
        return (kind, a, self._binary(kind, lower, right))

    def iff(self):
        return self._binary("iff", lambda: self._binary("imp", lambda: self._binary("or", lambda: self._binary("and", self.atom))))

    def atom(self):
        kind, t = self.peek()
        if kind == "not":
            self.take()
            if self.peek()[1] == "(" and t.lower() == "not":
                self.take("(")
                a = self.iff()
                self.take(")")
                return ("not", a)
            return ("not", self.atom())
        if t == "(":
            self.take()
            a = self.iff()
            self.take(")")
            return a
        if kind in ("name", "and", "or"):
            self.take()
            if self.peek()[1] != "(":
                raise ValueError("unary predicate expected")
            self.take("(")
            op = {"implies": "imp", "and": "and", "or": "or"}.get(t.lower())
            if op:
                args = [self.iff()]
                while self.peek()[1] == ",":
                    self.take()
                    args.append(self.iff())
                self.take(")")
                out = args[-1]
                for a in reversed(args[:-1]):
                    out = (op, a, out)
                return out
            self.take()
            self.take(")")
            return ("p", t)
        raise ValueError("atom expected")


def clauses(f: tuple, sign: bool = True) -> list[frozenset]:
    """Clause form of a body (or of its negation), satisfiable exactly if it is: sets of (name, sign).

    The parts of a disjunction are multiplied out only if that gives few clauses; else the larger one
    gets a name that implies it. Names of definitions are tuples, those of predicates are texts.
    """
    op = f[0]
    if op == "p":
        return [frozenset({(f[1], sign)})]
    if op == "not":
        return clauses(f[1], not sign)
    if op == "imp":
        return clauses(("or", ("not", f[1]), f[2]), sign)
    if op == "iff":
        return clauses(("and", ("imp", f[1], f[2]), ("imp", f[2], f[1])), sign)
    a, b = clauses(f[1], sign), clauses(f[2], sign)
    if (op == "and") == sign:
        return a + b
    if len(a) * len(b) > max(4, len(a) + len(b)):
        if len(a) < len(b):
            a, b = b, a
        name = ("def", f, sign)
        return [c | {(name, False)} for c in a] + [c | {(name, True)} for c in b]
    return [x | y for x in a for y in b]


class _Steps:
    def __init__(self, n: int) -> None:
        self.n = n

    def take(self) -> None:
        self.n -= 1
        if self.n < 0:
            raise TimeoutError


def satisfiable(cs: list[frozenset], steps: _Steps | None = None) -> bool:
    """DPLL with unit propagation."""
    steps = steps or _Steps(1_000_000)
    while True:
        if any(not c for c in cs):
            return False
        unit = next((next(iter(c)) for c in cs if len(c) == 1), None)
        if unit is None:
            break
        name, sign = unit
        cs = [c - {(name, not sign)} for c in cs if unit not in c]
    if not cs:
        return True
    steps.take()
    name, sign = next(iter(cs[0]))
    return satisfiable([*cs, frozenset({(name, sign)})], steps) or satisfiable([*cs, frozenset({(name, not sign)})], steps)


def entails(premises: list[str], conclusion: str, steps: int = 20_000) -> str | None:
    """yes if the premises entail the conclusion, no if they entail its negation, unknown otherwise; None if
    anything cannot be read or the search takes more than `steps` decisions. Unreadable premises make no verdict."""
    try:
        read = [Parser(p).formula() for p in premises]
        goal = Parser(conclusion).formula()
        left = _Steps(steps)
        base = [c for q, b in read if q == "all" for c in clauses(b)]
        some = [clauses(b) for q, b in read if q == "some"]
        if not satisfiable(base, left) or not all(satisfiable(base + s, left) for s in some):
            return "yes"

        def follows(q: str, b: tuple, sign: bool) -> bool:
            """Premises entail Q x b (sign) or its negation."""
            universal = (q == "all") == sign
            if universal:  # refuted by one more element with the opposite
                return not satisfiable(base + clauses(b, not sign), left)
            extra = base + clauses(b, not sign)  # no element may have it
            return not satisfiable(extra, left) or not all(satisfiable(extra + s, left) for s in some)

        q, b = goal
        return "yes" if follows(q, b, True) else "no" if follows(q, b, False) else "unknown"
    except (ValueError, IndexError, RecursionError, TimeoutError):
        return None


@F.pandas_udf(StringType())
def fol_verdict(premises: pd.Series, conclusion: pd.Series) -> pd.Series:
    """verdict per row, null where there is none; to be compared with the prediction, not the truth."""
    return pd.Series([entails([x for x in p if x], c) if p is not None and isinstance(c, str) else None for p, c in zip(premises, conclusion)], dtype="object")


def predicates(c: Column) -> Column:
    """distinct predicate names before '(': upper case up to 16 characters, or snake case from 4."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"\b([A-Z][A-Za-z0-9_]{0,15}|[a-z][a-z0-9_]{3,})\("), F.lit(1)))


# The two English forms a conclusion is read from.
IF_THEN = r"(?is)if (?:all\s+\w+\s+are|every\s+\w+\s+(?:is|are))\s+([A-Za-z][A-Za-z0-9_]*).*?then (?:all\s+\w+\s+are|every\s+\w+\s+(?:is|are))\s+([A-Za-z][A-Za-z0-9_]*)"
EVERY_IS = r"(?is)(?:all|every)\s+\w+\s+(?:is|are)\s+([A-Za-z][A-Za-z0-9_]*)"


def conclusion(c: Column, known: Column) -> Column:
    """∀(A→B) of 'if all X are A … then all Y are B', ∀A of 'all X are A'; null unless the names are known."""
    p2, p1 = IF_THEN, EVERY_IS
    g = F.regexp_extract
    ok = lambda x: F.array_contains(known, x)
    return F.when(c.rlike(p2) & ok(g(c, p2, 1)) & ok(g(c, p2, 2)), F.format_string("∀x(%s(x) → %s(x))", g(c, p2, 1), g(c, p2, 2))).when(
        c.rlike(p1) & ok(g(c, p1, 1)), F.format_string("∀x %s(x)", g(c, p1, 1))
    )


def relevant_premises(premises: Column, idx: Column) -> Column:
    """premises named by 1-based idx, those out of range dropped; all of them if idx is empty."""
    picked = F.transform(F.filter(idx, lambda i: (i >= 1) & (i <= F.size(premises))), lambda i: F.get(premises, i - 1))
    return F.when(F.size(F.coalesce(idx, F.array().cast("array<int>"))) == 0, premises).otherwise(picked)


def _windows(c: Column, lengths: Column) -> Column:
    """All different runs of a text that are as long as one of `lengths`."""
    runs = F.transform(lengths, lambda n: F.when(F.length(c) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))), lambda i: F.substr(c, i, n))).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(F.flatten(runs))


def _runs(texts: DataFrame, fragments: DataFrame, *keep: str) -> DataFrame:
    """__f and `keep` for every run of texts.__k that is as long as one of the fragments: what may equal one of them."""
    lengths = [r[0] for r in fragments.select(F.length("__f")).distinct().collect()]  # at most 60 numbers
    return texts.select(*keep, F.explode(_windows(F.col("__k"), F.array(*map(F.lit, sorted(lengths))).cast("array<int>"))).alias("__f"))


def lookup(queries: DataFrame, text: str, table: DataFrame, key: str, value: str, order: str, fragment: int = 60) -> DataFrame:
    """Value of the entry with equal collapsed key (the last by `order`), else of the first entry such
    that the first `fragment` characters of one of the two keys occur anywhere in the other.

    Containment is equality of runs: each fragment keeps its first entry only, each run of the stored
    keys too, so both joins find one row per run, however often a text is repeated. Null and blank keys
    are found by nothing and find nothing.
    """
    from quaesta.functions.text import collapse

    k = collapse(F.col(key))
    stored = table.filter(k != "").groupBy(k.alias("__k")).agg(F.max_by(value, order).alias("__exact"), F.min(order).alias("__o"), F.min_by(value, order).alias("__v"))
    first = F.min(F.struct("__o", "__v")).alias("__first")
    q = queries.withColumn("__q", collapse(F.col(text)))
    asked = q.filter(F.col("__q") != "").select("__q").distinct()
    # the query's fragment in a stored key
    mine = asked.select("__q", F.btrim(F.substring("__q", 1, fragment)).alias("__f"))
    in_stored = _runs(stored, mine, "__o", "__v").groupBy("__f").agg(first)
    a = mine.join(in_stored, "__f").select("__q", "__first")
    # a stored key's fragment in the query
    theirs = stored.groupBy(F.substring("__k", 1, fragment).alias("__f")).agg(first)
    b = _runs(asked.withColumn("__k", F.col("__q")), theirs, "__q").join(theirs, "__f").select("__q", "__first")
    near = a.unionByName(b).groupBy("__q").agg(F.min("__first").alias("__first"))
    return (
        q.join(stored.select(F.col("__k").alias("__q"), "__exact"), "__q", "left").join(near, "__q", "left")
        .withColumn(value, F.coalesce("__exact", "__first.__v")).drop("__q", "__exact", "__first")
    )


def lookup_stats(table: DataFrame, answer: str) -> DataFrame:
    """F8: entries in all and by answer."""
    a = F.lower(F.trim(answer))
    return table.agg(F.count(F.lit(1)).alias("total"), F.count_if(a == "yes").alias("yes"), F.count_if(a == "no").alias("no"), F.count_if(~a.isin("yes", "no") | a.isNull()).alias("other"))
