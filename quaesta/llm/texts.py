"""How a response ends, what it says, and in which language: rules on single texts."""

from __future__ import annotations

import re
from functools import lru_cache
from typing import NamedTuple

# Marks that say the rest was dropped or lost.
DROP = re.compile(r"(?:…|\.\.\.|\ufffd|\[(?:cut|truncated|snip(?:ped)?|continued|more|\.\.\.|…)\]|\((?:truncated|continued|cut|snip)\)|<(?:truncated|cut)>|\[[^\[\]]{0,20}(?:truncated|omitted)\])\W{0,2}$", re.I)
# What stands in place of a missing response.
_NOUN = "(?:response|output|answer|text|content|reply|result|prediction)"
PLACEHOLDER = re.compile(rf"^\W*(?:n\s*/?\s*a|null|none|nil|nan|undefined|tbd|todo|placeholder|(?:empty|blank|missing)(?:[ _-]?{_NOUN})?|no[ _-]?{_NOUN})\W*$", re.I)
# Labels and phrases that are whole answers.
LABEL = re.compile(r"^(?:[A-E]|yes|no|true|false|unknown|uncertain|does not change|do not change|cannot be determined|zero by symmetry|perpendicular to the plates|declined|có|không|đúng|sai)$", re.I)
RESULT = re.compile(r"^\W*(?:final answer|answer|result|solution|conclusion|đáp án|đáp số|kết quả|trả lời|antwort|ergebnis|réponse|résultat|respuesta|resultado|ответ|答案|结果)\s*\**\s*[:=：]\s*\S|^(?:⇒|=>|∴|→)\s*\S|\bthe (?:final )?answer is:? ", re.I)
_TAG = re.compile(r"<(/?)([a-z][a-z_]{2,})>", re.I)
_SENTENCE_END = re.compile(r"[.?!。？！．][\"'”’)\]}»*_`]*$")
_NUMBER = r"[−+\-–]?\d[\d.,  ]*(?:\s*(?:×|x|\*|\\times|\\cdot)\s*10\s*\^?\s*\{?[−\-–]?[\d⁰¹²³⁴⁵⁶⁷⁸⁹⁻]+\}?|[eE][−+\-]?\d+)?"
BARE = re.compile(rf"^\W*(?:[A-Za-z_ΦλωεμΩ]\w{{0,8}}\s*[=≈]\s*)?(?:about |approx\. |≈ ?|~ ?)?{_NUMBER}\s*\S{{0,12}}(?:\s\S{{1,8}})?$")


_BRACKETS = re.compile(r"\\[()]|[(){}]")
_SHAPED = re.compile(r"^\\boxed\{.*\}$|^\*\*[^*]{1,40}\*\*$|^\$[^$]{1,60}\$$", re.S)
_CLOSER = re.compile(r"(?:</[a-z_]+>|```|\\\]|∎|QED|\\end\{\w+\}|\}\$?|[*_]{2})\W{0,2}$")
_INVISIBLE = "\u200b\ufeff\u2060"


def open_markup(t: str, tail: bool = False) -> str:
    """Kind of markup left open at the end of a text, '' if none. tail: the text may begin anywhere,
    so closers without opener are ignored and signs that open and close alike tell nothing."""
    if "<" in t:
        stack: list[str] = []
        for close, name in _TAG.findall(t):
            name = name.lower()
            if not close:
                stack.append(name)
            elif name in stack:
                while stack.pop() != name:
                    pass
        if stack or re.search(r"<\s*/?[A-Za-z_]*$", t):
            return "tag"
    if not tail:
        if t.count("```") % 2:
            return "fence"
        if t.replace("```", "").count("$") % 2:
            return "formula"
        if t.count("**") % 2:
            return "emphasis"
    if "\\" in t:
        for o, c in ((r"\(", r"\)"), (r"\[", r"\]"), (r"\begin{", r"\end{")):
            if t.rfind(o) > t.rfind(c):
                return "formula"
    if "{" in t or "(" in t:
        curly = round_ = 0
        for x in _BRACKETS.findall(t):
            if x == "{":
                curly += 1
            elif x == "}":
                curly = max(0, curly - 1)
            elif x == "(":
                round_ += 1
            elif x == ")":
                round_ = max(0, round_ - 1)
        if curly or round_:
            return "formula" if curly else "bracket"
    return ""


def is_blank(text: str | None) -> bool:
    """Null, blank, invisible, mere signs, or what stands in place of a missing text."""
    t = (text or "").strip().strip(_INVISIBLE).strip()
    return not t or not re.search(r"\w", t) or bool(PLACEHOLDER.match(t))


class Closing(NamedTuple):
    """What can be seen at the end of a text; no verdict. `result`: its last line gives a result
    ('done' if the value is whole, 'open' if not, '' if it is no such line)."""

    markup: str
    sign: bool
    sentence: bool
    closer: bool
    result: str
    bare: bool

    def intact(self) -> bool:
        """Closed structure: nothing left open, no sign of loss, and something that closes a text."""
        return not self.markup and not self.sign and (self.sentence or self.closer or self.result == "done" or self.bare)


def closing(t: str, tail: bool = False) -> Closing:
    """The Closing of a text that is not blank."""
    t = t.strip().strip(_INVISIBLE).strip()
    sign = bool(DROP.search(t[-60:])) and bool(re.search(r"\w", DROP.sub("", t[-400:])))
    last = t.rsplit("\n", 1)[-1].strip()
    result = ""
    if RESULT.search(last):
        value = re.split(r"[:=：⇒]", last)[-1].strip(" *.")
        result = "done" if LABEL.match(value) or (BARE.match(value) and not re.search(r"(?:[×*^.,]|×\s*10|\^)$", value)) or _SENTENCE_END.search(last) else "open"
    bare = bool(LABEL.match(t)) or ("\n" not in t and len(t) < 4000 and bool(BARE.match(t) or _SHAPED.match(t)))
    return Closing(open_markup(t, tail), sign, bool(_SENTENCE_END.search(last)), bool(_CLOSER.search(t[-80:])), result, bare)


def tokens(text: str) -> list[str]:
    """Lower-case words with inner apostrophes; each Han character is one token; no markup."""
    t = re.sub(r"</?[A-Za-z_]{3,}>", " ", text.lower().replace("’", "'").replace("＇", "'"))
    t = re.sub(r"(?<=\d) (?=\.\d)", "", t)
    return re.findall(r"[\u4e00-\u9fff]|\d+(?:[.,]\d+)*|[^\W\d_]+(?:'[^\W\d_]+)*", t)


def lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, bit-parallel: one row of the table is one integer."""
    at: dict[str, int] = {}
    for j, y in enumerate(b):
        at[y] = at.get(y, 0) | 1 << j
    full = (1 << len(b)) - 1
    v = full
    for x in a:
        u = v & at.get(x, 0)
        v = ((v + u) | (v - u)) & full
    return len(b) - v.bit_count()


def shingles(toks: list[str], k: int = 3) -> set[tuple[str, ...]]:
    return {tuple(toks[i : i + k]) for i in range(max(1, len(toks) - k + 1))} if toks else set()


# Words that introduce a repeated question.
INTRO = {"the", "question", "asks", "is", "you", "asked", "q", "problem", "user", "says", "here", "task", "prompt", "original", "câu", "hỏi", "đề", "bài"}


@lru_cache(maxsize=20_000)
def question_tokens(question: str) -> tuple[str, ...]:
    return tuple(tokens(re.sub(r"(?i)^\s*question\s*:", "", question)))


def completed(question: str, text: str) -> str:
    """A question cut off by its field, with the rest that a text repeating it states.

    The rest is what follows the question's last whole words, up to the end of the sentence. A
    question that ends in a sentence end, or whose last words are not in the text, stays as it is.
    """
    known = question.rstrip()
    if not known or _SENTENCE_END.search(known):
        return question
    words = known.split()[:-1][-4:]  # the last word may be cut
    if len(words) < 2:
        return question
    m = re.search(r"\W+".join(map(re.escape, words)), text, re.I)
    if m is None:
        return question
    rest = re.match(r"(?:[^.?!。？！<\n]|[.](?=\d))*", text[m.end() :]).group(0)
    return " ".join(known.split()[:-1]) + rest


def is_copy(text: str, question: str | None) -> bool:
    """The response only repeats the question: nearly all its shingles are the question's, and the
    longest common subsequence covers nearly all tokens of both. Of a question cut off by its field
    the rest may follow."""
    if not question:
        return False
    q = question_tokens(question)
    if len(q) < 4:
        return False
    if "<explanation" not in text.lower():
        # containment of shingles is containment of words; punctuation clings to some of the raw ones
        words, known = text.lower().split(), set(question.lower().split())
        if sum(w in known for w in words) < 0.3 * len(words) and text.isascii():
            return False
    body = re.sub(r"(?i)<explanation>.*?</explanation>", " ", text)
    pieces = [p for p in re.findall(r"(?is)<(?:reasoning|answer)>(.*?)</(?:reasoning|answer)>", body)] or [body]
    rest = re.sub(r"(?is)<(reasoning|answer)>.*?</\1>", " ", body) if len(pieces) and "<" in body else ""
    if tokens(rest):
        pieces.append(rest)
    whole = list(q)
    full = completed(question, text)
    if full is not question:
        whole = tokens(re.sub(r"(?i)^\s*question\s*:", "", full))
    cut = full is not question or not _SENTENCE_END.search(question.rstrip())
    mine = shingles(whole)
    known = False
    for t in sorted(map(tokens, pieces), key=len, reverse=True):
        while t and t[0] in INTRO and t[: len(whole)] != whole[: len(t)]:
            t = t[1:]
        if known and t and t[0] not in whole:
            t = t[1:]  # the text may begin inside a word
        if not t:
            continue
        if 0.9 * len(t) > len(whole):
            return False  # longer than a copy can be
        sh = shingles(t)
        if len(sh & mine) < 0.6 * len(sh):
            return False
        same = lcs(t, whole)
        if same < 0.9 * len(t):
            return False
        if not known and same >= 0.8 * (min(len(q), len(whole)) if cut else len(whole)):  # a part of the question alone is no copy
            known = True
    return known


def is_empty(text: str | None) -> bool:
    """Null, blank, a placeholder, empty markup, or signs without content."""
    if text is None:
        return True
    t = re.sub(r"[\u200b-\u200f\u2060\ufeff\u00ad\u034f]", "", text)
    t = re.sub(r"</?[A-Za-z_]{3,}>|\\(?:boxed|text|mathrm|mathbf)\b|```\w*", " ", t).strip()
    return not re.search(r"\w|[∞∅∀∃]", t) or bool(PLACEHOLDER.match(t))
