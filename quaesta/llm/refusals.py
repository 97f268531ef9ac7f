"""Refusals: sentences aligned with refusal templates by weighted local alignment.

A sentence is read as a sequence of concepts (who speaks, inability, declining, helping, the request,
permission, evidence). Templates are short sequences of concepts; the score of an alignment is the
weight of what matches, less what the template misses and what lies between, as a share of the
template's weight. The threshold is fitted on known solution texts, which decline nothing.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaesta.llm.texts import BARE, LABEL, RESULT, is_blank

# Beginnings of words and phrases of each concept, by language (en, vi, fr, de, es, ru, zh).
CONCEPTS: dict[str, list[str]] = {
    # declining, or what stands in the way
    "D": [
        "declin", "refus", "refrain", "abstain", "skip", "withhold", "withheld", "outside", "out of scope", "beyond", "against my", "against the rules", "against polic", "prevent", "prohibit", "forbid", "forbidden", "breach", "violat", "unanswered", "unsolved", "pass on", "would rather", "off limits", "off-limits", "restrict", "keep me from", "keeps me from", "keep from", "stop me", "stops me", "bar me", "bars me", "turn down", "turn this down", "prefer not", "opt out", "step back", "leave it to", "leave this to",
        "từ chối", "ngoài khả năng", "ngoài phạm vi", "xin phép không", "bị cấm", "vi phạm", "khước từ", "nằm ngoài",
        "hors de", "dépasse", "weiger", "ablehn", "lehne", "außerhalb", "rechaz", "niego", "fuera de", "отказ", "вынужден", "за пределами", "拒绝", "超出", "违反",
    ],
    # inability and negation
    "N": [
        "cannot", "can't", "can not", "couldn't", "could not", "won't", "will not", "wouldn't", "would not", "don't", "do not", "doesn't", "isn't", "is not", "aren't", "am not", "i'm not", "not", "no", "never", "unable", "impossible", "incapable", "nothing", "lack", "inappropriate", "improper",
        "không thể", "không được", "không", "chưa thể", "chẳng thể", "đành chịu", "ne peux pas", "ne peut pas", "ne suis pas", "pas", "impossible de", "incapable de", "nicht", "kein", "keine", "unmöglich", "incapaz", "не", "нельзя", "невозможно", "无法", "不能", "不会", "不可以", "没办法",
    ],
    # helping and answering
    "H": [
        "help", "assist", "answer", "respond", "response", "repl", "provid", "give", "giving", "given", "offer", "solv", "solution", "compl", "shar", "discuss", "work on", "work through", "working on", "walk through", "walk you through", "support", "engag", "fulfil", "proceed", "take on", "tackl", "attempt", "handl", "supply", "deliver", "oblige", "weigh in", "accommodat", "address", "be of use", "be of service", "say", "tell",
        "trả lời", "giúp", "giải", "hỗ trợ", "cung cấp", "đưa ra", "đáp án", "đáp ứng", "thực hiện", "làm bài", "répond", "réponse", "aider", "fournir", "résoudre", "beantwort", "helfen", "antwort", "lösen", "unterstütz", "responder", "ayudar", "resolver", "respuesta", "отве", "помо", "реш", "回答", "帮助", "帮", "提供", "解答", "协助",
    ],
    # permission and ability
    "P": [
        "able", "possible", "allowed", "permitted", "comfortable", "willing", "position to", "capable", "going to", "guideline", "polic", "instructions", "current rules", "terms of use", "something i can", "what i can", "my capabilit", "my abilit", "prepared to", "inclined",
        "được phép", "khả năng", "quy định", "chính sách", "en mesure", "capable de", "règles", "in der lage", "darf", "richtlinie", "capaz", "permitido", "política", "правил", "в состоянии", "政策", "规定",
    ],
    # the request
    "R": [
        "request", "question", "problem", "item", "task", "query", "exam", "exercise", "content", "prompt", "assignment",
        "yêu cầu", "câu hỏi", "câu này", "đề", "bài", "demande", "exercice", "frage", "aufgabe", "anfrage", "pregunta", "ejercicio", "вопрос", "задач", "запрос", "问题", "请求", "这", "题",
    ],
    # phrases of two concepts: the speaker's inability
    "SN": ["no puedo", "no podemos", "не могу", "не можем", "не буду"],
    # another topic in place of an answer
    "T": ["talk about something else", "discuss something else", "change the topic", "change the subject", "a different topic", "another topic"],
    # pronouns that may stand for the request
    "W": ["this", "that", "here", "one", "it", "so", "cette", "dies", "esta", "esto", "это", "này"],
    # the speaker
    "S": ["i", "i'm", "i'll", "i've", "i'd", "me", "my", "myself", "language model", "assistant", "ai", "tôi", "mình", "je", "j'", "moi", "ich", "mir", "yo", "я", "мне", "我", "抱歉"],
    # what premises and data allow is a matter of the answer
    "E": ["premis", "conclu", "infer", "determin", "deduc", "follow", "enough", "sufficient", "data", "rule out", "statement", "tiền đề", "kết luận", "suy ra", "dữ kiện", "giả thiết", "prémiss", "prämiss", "premisa", "посыл", "前提", "结论"],
}
WEIGHT = {"T": 2.0, "W": 0.6, "S": 1.0, "N": 2.0, "P": 1.0, "D": 2.5, "H": 2.0, "R": 1.0, "E": 0.0}
# Templates as sequences of concepts, each with a sentence of its kind.
TEMPLATES = {
    "SNH": "I cannot help",
    "SNPH": "I am not able to answer",
    "SDH": "I must decline to answer",
    "SDR": "I have to decline this request",
    "SRD": "I will leave this one unanswered",
    "NPSH": "it is not possible for me to respond",
    "HRD": "solving this is outside of what I can do",
    "HRNP": "helping with this is not possible",
    "RNH": "this request cannot be completed",
    "RDS": "this task is beyond me",
    "PDSH": "guidelines keep me from solving",
    "RDP": "this request breaches the policy",
    "NHH": "no answer will be given",
    "DHR": "declining to answer this",
    "NPHR": "not comfortable giving this",
    "DSHR": "from refusing, my answer to this",
    "SNHR": "I won't do this exercise",
    "HRSNP": "helping with this is something I am not permitted to do",
    "NSHR": "nothing I can do to help with this",
    "SDD": "I would rather refrain",
    "T": "let us talk about something else",
}
_TOTAL = {t: sum(WEIGHT[c] for c in t) for t in TEMPLATES}
_GAP, _OTHER, _EVIDENCE, _MISS = 0.1, 0.25, 0.4, 0.7
_CJK = re.compile(r"[\u4e00-\u9fff]")


_TOKEN = re.compile(r"[\u4e00-\u9fff]+|[^\W\d_]+(?:'[^\W\d_]+)*|[.?!。;；？！\n]")
_END = ".?!。;；？！\n"


def _tables() -> tuple[dict[str, str], list[tuple[str, str]], dict[str, list[tuple[tuple[str, ...], str]]], re.Pattern[str]]:
    """Whole words, beginnings (longest first), phrases by their first word, and the Han phrases."""
    words, stems, phrases, han = {}, [], {}, []
    for c, ps in CONCEPTS.items():
        for p in ps:
            if _CJK.search(p):
                han.append((p, c))
            elif " " in p or "-" in p:
                ws = tuple(re.split(r"[ -]", p))
                phrases.setdefault(ws[0], []).append((ws, c))
            elif len(p) <= 4 or "'" in p:
                words[p] = c
            else:
                stems.append((p, c))
    stems.sort(key=lambda x: -len(x[0]))
    for v in phrases.values():
        v.sort(key=lambda x: -len(x[0]))
    han.sort(key=lambda x: -len(x[0]))
    return words, stems, phrases, re.compile("|".join(f"(?P<{c}{i}>{p})" for i, (p, c) in enumerate(han)))


_WORDS, _STEMS, _PHRASES, _HAN = _tables()
# Beginnings of four letters or less that stand for many words.
_SHORT_STEMS = {"give": "H", "giv": "H", "solv": "H", "repl": "H", "help": "H", "shar": "H", "offer": "H", "skip": "D", "item": "R", "task": "R", "exam": "R", "lös": "H", "реш": "H", "отве": "H", "помо": "H", "отказ": "D"}


@lru_cache(maxsize=100_000)
def concept(word: str) -> str:
    """Concept of a lower-case word, '' if it has none."""
    if word in _WORDS:
        return _WORDS[word]
    for p, c in _STEMS:
        if word.startswith(p):
            return c
    for n in (5, 4, 3):
        if word[:n] in _SHORT_STEMS and len(word) <= n + 6:
            return _SHORT_STEMS[word[:n]]
    return "N" if word.endswith("n't") else ""


def sentences(low: str) -> list[list[tuple[str, float]]]:
    """Concept sequences of the sentences of a lower-case text, each concept with the number of other words before it."""
    out: list[list[tuple[str, float]]] = []
    seq: list[tuple[str, float]] = []
    gap, skip = 0, 0
    toks = _TOKEN.findall(low)
    for i, w in enumerate(toks):
        if skip:
            skip -= 1
            continue
        if w in _END:
            if seq:
                out.append(seq)
            seq, gap = [], 0
            continue
        c = ""
        for ws, pc in _PHRASES.get(w, ()):
            if tuple(toks[i : i + len(ws) - 1]) == ws[:-1] and i + len(ws) <= len(toks) and toks[i + len(ws) - 1].startswith(ws[-1]):
                c, skip = pc, len(ws) - 1
                break
        if not c and "\u4e00" <= w[0] <= "\u9fff":
            for m in _HAN.finditer(w):
                seq.append((m.lastgroup[0], float(gap)))
                gap = 0
            continue
        c = c or concept(w)
        if c:
            for x in c:
                seq.append((x, float(gap)))
                gap = 0
        else:
            gap += 1
    if seq:
        out.append(seq)
    return out


def alignment(seq: list[tuple[str, float]], template: str) -> float:
    """Best local alignment of a concept sequence with a template, as a share of the template's weight."""
    n = len(template)
    total = sum(WEIGHT[c] for c in template)
    best = 0.0
    row = [-_MISS * sum(WEIGHT[c] for c in template[:j]) for j in range(n + 1)]
    start = row[:]
    for c, gap in seq:
        skip = gap * _GAP + _OTHER
        new = [0.0] * (n + 1)
        for j in range(1, n + 1):
            t = template[j - 1]
            v = max(start[j], row[j] - skip, new[j - 1] - _MISS * WEIGHT[t])
            if c == t or (c == "W" and t == "R"):
                v = max(v, max(row[j - 1] - gap * _GAP, start[j - 1]) + WEIGHT[c])
            new[j] = v
        row = new
        best = max(best, row[n])
    return best / total


def _triggers() -> ahocorasick.Automaton:
    """Beginnings of all words and phrases without which no template is reached: declining, inability, another topic."""
    a = ahocorasick.Automaton()
    for c in ("D", "N", "SN", "T"):
        for p in CONCEPTS[c]:
            a.add_word(p, bool(_CJK.search(p)) or (len(p) > 4 and " " not in p and "'" not in p))
    for p, c in _SHORT_STEMS.items():
        if c == "D":
            a.add_word(p, True)
    a.add_word("n't", True)
    a.make_automaton()
    return a


_TRIGGERS = _triggers()


def suspects(low: str) -> list[str]:
    """The parts of a lower-case text, between sentence ends, that hold a trigger."""
    out, end = [], 0
    for at, free in _TRIGGERS.iter(low):
        if at < end or not (free or at + 1 == len(low) or not low[at + 1].isalpha()):
            continue
        a = max(low.rfind(x, 0, at) for x in _END) + 1
        ends = [i for x in _END if (i := low.find(x, at)) >= 0]
        end = min(ends) if ends else len(low)
        out.append(low[a:end])
    return out


def score(text: str) -> float:
    """The best alignment of any sentence of the text with any template, from 0 to 1."""
    low = text.lower().replace("’", "'").replace("＇", "'")
    if "<" in low:
        low = re.sub(r"</?[a-z_]{3,}>", "\n", low)
    best = 0.0
    for seq in (q for part in suspects(low) for q in sentences(part)):
        have = {c for c, _ in seq}
        if not have & {"N", "D", "T"}:
            continue
        less = _EVIDENCE if "E" in have else 0.0
        if "W" in have:
            have.add("R")
        for t, total in _TOTAL.items():
            if sum(WEIGHT[c] if c in have else -_MISS * WEIGHT[c] for c in t) > (best + less) * total:
                best = max(best, alignment(seq, t) - less)
    return best


def _threshold(counts: list[tuple[float, int]], least: float, share: float) -> float:
    """The threshold from scores and how often each occurs."""
    left = int(sum(n for _, n in counts) * share)
    at = 0.0
    for at, n in sorted(counts, reverse=True):
        left -= n
        if left < 0:
            break
    return min(0.95, max(least, at + 1e-9))


def _solution_scores(solutions: list[str]) -> list[float]:
    return [score(t) for t in solutions if not is_blank(t) and not gives_answer(t)]


def fit_threshold(solutions: list[str], least: float = 0.7, share: float = 0.001) -> float:
    """The threshold that at most `share` of known solution texts exceed, between `least` and 0.95."""
    return _threshold(list(Counter(_solution_scores(solutions)).items()), least, share)


def fit(df: DataFrame, *columns: str, least: float = 0.7, share: float = 0.001) -> float:
    """`fit_threshold` on the solution texts in these columns of all rows of df.

    Scores up to `least` are counted as 0 and those beyond 0.95 as 0.95, which leaves the threshold as it is and few different scores.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            got = Counter(min(0.95, x) if x > least else 0.0 for x in _solution_scores([t for c in columns for t in p[c] if isinstance(t, str)]))
            yield pd.DataFrame({"score": list(got.keys()), "n": list(got.values())})

    got = df.select(*columns).mapInPandas(run, "score double, n bigint").groupBy("score").agg(F.sum("n").alias("n")).collect()
    return _threshold([(r["score"], r["n"]) for r in got], least, share)


def gives_answer(text: str) -> bool:
    """Whether a text ends up with an answer: in a tag, a box or a line giving the result."""
    for a in [*re.findall(r"(?is)<answer>(.*?)</answer>", text), *re.findall(r"\\boxed\{([^{}]*)\}", text)]:
        v = a.strip()
        if v and (LABEL.match(v) or BARE.match(v)) and v.lower() != "declined":
            return True
    last = text.strip().rsplit("\n", 1)[-1]
    return bool(RESULT.search(last) and not re.search(r"(?i)answer is:? (?:declined|not)", last))


def is_refusal(text: str, threshold: float = 0.75) -> bool:
    """Declines to answer: a sentence aligns with a template beyond the threshold and no other answer is given."""
    return score(text) > threshold and not gives_answer(text)
