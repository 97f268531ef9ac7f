"""Name similarity of fields and minimum-cost bipartite matching (no third-party solver)."""

from __future__ import annotations

import re

# Name parts that carry little meaning, and short forms of common words.
WEAK = {"is", "has", "n", "num", "no", "number", "count", "counts", "per", "the", "of", "test", "value", "val", "field", "config", "cfg", "random", "flag", "v"}
SHORT = {"cfg": "config", "num": "n", "number": "n", "no": "n", "avg": "average", "min": "minutes", "conf": "confidence", "temp": "temperature", "ver": "version"}


def parts(name: str) -> list[str]:
    """Words of a snake, kebab or camel case name, lower case; digits apart from letters."""
    s = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name)
    s = re.sub(r"(?<=[A-Za-z])(?=\d)|(?<=\d)(?=[A-Za-z])", "_", s)
    return [SHORT.get(p, p) for p in re.split(r"[^0-9A-Za-z]+", s.lower()) if p]


def _alike(a: str, b: str) -> bool:
    if a == b:
        return True
    s, t = sorted((a, b), key=len)
    return len(s) >= 3 and (t.startswith(s) or t.rstrip("s") == s)


def name_similarity(a: str, b: str) -> float:
    """0..1: weighted share of name parts with a counterpart; halved where both names keep a strong part of their own."""
    pa, pb = parts(a), parts(b)
    weight = lambda p: 0.25 if p in WEAK or p.isdigit() else 1.0
    total = sum(map(weight, pa + pb))
    if not total:
        return float(a == b)
    left, shared, own = list(pb), 0.0, []
    for p in pa:
        hit = next((q for q in left if _alike(p, q)), None)
        if hit is None:
            own.append(weight(p))
        else:
            left.remove(hit)
            shared += weight(p) + weight(hit)
    clash = any(w >= 1 for w in own) and any(weight(q) >= 1 for q in left)
    # one name within the other is half a match at least, which the values then have to confirm
    least = 0.5 if shared and (not own or not left) else 0.0
    return max(least, shared / total * (0.5 if clash else 1.0))


def assignment(cost: list[list[float]]) -> list[int]:
    """Column given to each row at least total cost (shortest augmenting paths); rows <= columns."""
    n, m = len(cost), len(cost[0]) if cost else 0
    u, v, match = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        low, back, seen = [float("inf")] * (m + 1), [0] * (m + 1), [False] * (m + 1)
        while match[j0]:
            seen[j0], i0, j1, step = True, match[j0], 0, float("inf")
            for j in range(1, m + 1):
                if not seen[j]:
                    c = cost[i0 - 1][j - 1] - u[i0] - v[j]
                    if c < low[j]:
                        low[j], back[j] = c, j0
                    if low[j] < step:
                        step, j1 = low[j], j
            for j in range(m + 1):
                if seen[j]:
                    u[match[j]] += step
                    v[j] -= step
                else:
                    low[j] -= step
            j0 = j1
        while j0:
            match[j0] = match[back[j0]]
            j0 = back[j0]
    out = [-1] * n
    for j in range(1, m + 1):
        if match[j]:
            out[match[j] - 1] = j - 1
    return out
