"""One consistent form for text that looks the same but is stored in different characters.

One pass over the texts writes, for each, the fingerprint of the text and of its form, or, where a word
holds characters with look-alikes or ignorables, the text itself; and the vocabulary, counted per task.
Odd words are run through a trie of the clean vocabulary by a weighted edit automaton: look-alike
substitutions and ignorables cost nothing, readings that only the vocabulary can decide a little, all
else one. The spelling reached at least cost is the canonical one; words that reach none are
normalised by table. Odd texts are then put together again from canonical words.

Scale: words that can reach each other meet by their skeleton, in runs of sorted skeletons, so a trie
is small; the most frequent odd words (a fixed number, of bounded length) are looked up where texts are
read, the others joined by word.
"""

from __future__ import annotations

import hashlib
import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaesta.common import durable

# Letters and signs that look like a basic one, by script.
ALIKE = {
    # Cyrillic
    **dict(zip("аеорсухіјѕһԁԛԝӏ", "aeopcyxijshdqwl")),
    **dict(zip("АВЕКМНОРСТХІЈЅУԌԚԜӀ", "ABEKMHOPCTXIJSYGQWI")),
    # Greek
    **dict(zip("οϲνιϳ", "ocvij")),
    **dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿϺ", "ABEZHIKMNOPTYXCJM")),
    # Armenian
    **dict(zip("օսհոյզցՕՏԼ", "ouhnjqgOSL")),
    # Coptic
    **dict(zip("ⲟⲥⲣⲞⲤⲢⲎⲒⲔⲘⲚⲦⲬ", "ocpOCPHIKMNTX")),
    # Cherokee
    **dict(zip("ᎠᎡᎢᎪᎫᎬᎳᎷᎻᏀᏃᏒᏔᏙᏚᏞᏟᏢᏦ", "DRTAJEWMHGZRWVSLCPK")),
    # Lisu
    **dict(zip("ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPDTGKJCZFMNLSRVHWXYAEIOU")),
    # Latin extensions, small capitals, letter-like signs
    **dict(zip("ɑɡıȷᴄᴏᴠᴡᴢꜱℓℎ", "agijcovwzslh")),
    "µ": "μ",
    # hyphens and apostrophes
    **dict(zip("‐‑﹣", "---")),
    "ʹ": "'",
    "ʼ": "’",
}
# Further readings of a character, which only the vocabulary can decide.
READINGS = {"Ӏ": "l", "І": "l", "Ι": "l", "Ⲓ": "l", "ꓲ": "l", "ӏ": "I", "З": "3", "ѵ": "v", "υ": "u", "ʋ": "u", "ɩ": "i"}
READING_COST = 0.2
#: Total cost within which a spelling counts as reached: a few further readings, no other edit.
BUDGET = 0.9
# Characters without a look of their own, line ends, spaces.
_IGNORABLE = {0xAD, 0x34F, 0x61C, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFEFF, 0xFFA0, *range(0x180B, 0x1810), *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), *range(0xFE00, 0xFE10)}
_LINE = "\r\x85  \x0b\x0c"
_SPACE = "\xa0              　\t"


def fold_char(c: str) -> str:
    """What a character looks like: '' for ignorables; width forms, ligatures and Roman numerals as their letters."""
    n = ord(c)
    if n < 0x80:
        return c
    if n in _IGNORABLE:
        return ""
    if c in ALIKE:
        return ALIKE[c]
    if 0xFF01 <= n <= 0xFFEE or 0xFB00 <= n <= 0xFB06 or 0x2160 <= n <= 0x217F:
        return "".join(ALIKE.get(x, x) for x in unicodedata.normalize("NFKC", c))
    return c


_FOLDS: dict[str, str] = {}


def fold(word: str) -> str:
    """Folded form of a word by the table: looks, composed."""
    if word.isascii():
        return word
    out = []
    for c in unicodedata.normalize("NFD", word):
        f = _FOLDS.get(c)
        if f is None:
            f = _FOLDS[c] = fold_char(c)
        out.append(f)
    return unicodedata.normalize("NFC", "".join(out))


def _second_characters() -> set[str]:
    """Characters that composition may join to the one before: marks, and the vowels and finals of Hangul."""
    out = {chr(i) for a, b in ((0x1161, 0x1176), (0x11A8, 0x11C3)) for i in range(a, b)}
    for i in range(0x80, 0x30000):
        d = unicodedata.decomposition(chr(i))
        if d and not d.startswith("<"):
            out.update(chr(int(x, 16)) for x in d.split()[1:])
    return out


def suspect_characters() -> list[int]:
    """Code points that make a word worth a look: whatever the table changes, composition joins, or the vocabulary may read."""
    second = _second_characters()
    return [i for i in range(0x80, sys.maxunicode + 1) if not 0xD800 <= i < 0xE000 and _odd_character(chr(i), second)]


def _odd_character(c: str, second: set[str]) -> bool:
    n = ord(c)
    if 0x3400 <= n < 0xA000 or 0xAC00 <= n < 0xD7A4 or 0x30000 <= n:
        return fold(c) != c if n < 0x110000 and unicodedata.decomposition(c) and not 0xAC00 <= n < 0xD7A4 else False
    return c in READINGS or c in second or bool(unicodedata.combining(c)) or fold(c) != c


def _class(points: list[int]) -> str:
    """A character class of the code points, in ranges."""
    runs: list[list[int]] = []
    for p in points:
        if runs and runs[-1][1] == p - 1:
            runs[-1][1] = p
        else:
            runs.append([p, p])
    return "[" + "".join(f"\\U{a:08x}-\\U{b:08x}" if a < b else f"\\U{a:08x}" for a, b in runs) + "]"


_patterns: dict[str, re.Pattern[str]] = {}


def suspect(text: str) -> bool:
    """Whether a text has a character for which its words need a look. The class is generated once per process."""
    if text.isascii():
        return False
    if not _patterns:
        _patterns["suspect"] = re.compile(_class(suspect_characters()))
    return bool(_patterns["suspect"].search(text))


# what may stand for what, by folded character: a reading joins the classes of both characters
_SKELETON = str.maketrans({**{fold_char(c): t for c, t in READINGS.items() if fold_char(c) != t and c != "ӏ"}, "I": "l"})


def skeleton(word: str) -> str:
    """Equal for any two words of which one can be read as the other."""
    return fold(word).translate(_SKELETON)


def is_clean(word: str) -> bool:
    """A spelling fit for the vocabulary: composed, no ignorables or width forms, letters of one script."""
    scripts = set()
    for c in word:
        f = fold_char(c)
        if len(f) != 1 or (f != c and (0xFF01 <= ord(c) <= 0xFFEE or 0x2160 <= ord(c) <= 0x217F)):
            return False
        if c.isalpha():
            scripts.add(unicodedata.name(c, "?").split()[0])
    return len(scripts) <= 1 and unicodedata.normalize("NFC", word) == word


class Trie:
    """Vocabulary trie over decomposed characters; terminal nodes keep spelling and count."""

    def __init__(self) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.word: list[tuple[int, str] | None] = [None]

    def add(self, word: str, n: int) -> None:
        node = 0
        for c in unicodedata.normalize("NFD", word):
            to = self.next[node].get(c)
            if to is None:
                to = self.next[node][c] = len(self.next)
                self.next.append({})
                self.word.append(None)
            node = to
        if self.word[node] is None or self.word[node][0] < n:
            self.word[node] = (n, word)

    def spellings(self, word: str, budget: float = BUDGET) -> list[tuple[float, int, str]]:
        """(cost, -count, spelling) of all vocabulary words within `budget` of the word, the nearest first:
        look-alike substitution and ignorables cost 0, a further reading READING_COST, any other
        substitution, insertion or deletion 1."""
        states = {0: 0.0}
        for c in unicodedata.normalize("NFD", word):
            looks, other = fold_char(c), READINGS.get(c)
            for f in looks:
                new: dict[int, float] = {}

                def reach(node: int, cost: float, new: dict[int, float] = new) -> None:
                    if cost <= budget and cost < new.get(node, budget + 1):
                        new[node] = cost

                for node, cost in states.items():
                    if cost + 1 <= budget:
                        reach(node, cost + 1)
                    for x, to in self.next[node].items():
                        # a character the vocabulary spells itself is no further reading of it
                        price = lambda x: 0.0 if x == c or fold_char(x) == f else READING_COST if x == other else 1.0
                        reach(to, cost + price(x))
                        if cost + 1 <= budget:
                            for y, on in self.next[to].items():
                                reach(on, cost + 1 + price(y))
                states = new
                if not states:
                    return []
        return sorted((round(cost, 6), -self.word[n][0], self.word[n][1]) for n, cost in states.items() if self.word[n])


def canonical_spelling(trie: Trie, word: str, folded: str) -> str:
    """The vocabulary's spelling at least cost: the folded form if it is among them, else the most
    frequent (ties: the least); the word normalised by table, its folded form, if it reaches none."""
    found = trie.spellings(word)
    if not found:
        return folded
    near = [s for cost, _, s in found if cost == found[0][0]]
    return folded if folded in near else near[0]


_TRAILING = re.compile("[ " + "".join(map(chr, sorted(_IGNORABLE))) + "]+(?=\n|\\Z)")
_SPACES = re.compile(f"[{_SPACE}]")
_LINES = re.compile(f"\r\n|[{_LINE}]")
_END = " \n\t\x1c\x1d\x1e\x1f" + "".join(map(chr, sorted(_IGNORABLE)))


def visible(text: str) -> str:
    """Spaces of any kind as ' ', line ends as '\\n', no space or line end where none can be seen
    (before a line end, at the end of the text)."""
    plain = text.isascii()
    if not plain or "\t" in text:
        text = _SPACES.sub(" ", text)
    if not plain or "\r" in text or "\x0b" in text or "\x0c" in text:
        text = _LINES.sub("\n", text)
    if not plain or " \n" in text:
        text = _TRAILING.sub("", text)
    return text.rstrip(_END)


def words_of(text: str) -> list[str]:
    """Words of a visible text; line ends are words of their own, so that joining by ' ' is one-to-one."""
    return text.replace("\n", " \n ").split(" ")


def _print(text: str) -> bytes:
    return hashlib.md5(text.encode("utf-8", "surrogatepass")).digest()


def _together(words: list[str]) -> str:
    """A text from its canonical words; a word may have become invisible, so spaces at ends go again."""
    t = " ".join(words).replace(" \n ", "\n")
    while " \n" in t:
        t = t.replace(" \n", "\n")
    return t.rstrip(" \n")


READ = "doc_id bigint, th binary, fp binary, form string, v string, word string, n bigint, folded string, skeleton string"
_READ = [c.split()[0] for c in READ.split(", ")]


def read(docs: DataFrame, with_form: bool = False, words_held: int = 200_000) -> DataFrame:
    """READ rows: one per document (th; fp and, if asked for, form of a text without odd words, else v, the visible
    text), and the words of the vocabulary with the number of texts that have them (doc_id and th null), counted per task.

    folded is given for odd words only. The table of words is emptied whenever it holds `words_held`.
    """

    def vocabulary(count: Counter[str]) -> pd.DataFrame:
        rows = [(None, None, None, None, None, w, n, fold(w) if suspect(w) else None, skeleton(w)) for w, n in count.items()]
        return pd.DataFrame(rows, columns=_READ)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count: Counter[str] = Counter()
        for p in batches:
            out = []
            for doc, t in zip(p["doc_id"].tolist(), p["text"].tolist()):
                if not isinstance(t, str):
                    out.append((doc, None, None, None, None, None, None, None, None))
                    continue
                v = visible(t)
                count.update(set(words_of(v)))
                odd = suspect(v)
                out.append((doc, _print(t), None if odd else _print(v), None if odd or not with_form else v, v if odd else None, None, None, None, None))
                if len(count) >= words_held:
                    yield vocabulary(count)
                    count = Counter()
            yield pd.DataFrame(out, columns=_READ).astype({"doc_id": "Int64"})
        yield vocabulary(count)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, READ)


def _spell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by skeleton -> word, n, canonical for each odd word.

    Words are held for one run of skeletons, which ends between two of them: none can reach over it.
    """

    def flush(group: list[tuple[str, str | None, str, int]]) -> pd.DataFrame:
        trie = Trie()
        for _, f, w, n in group:
            if f is None or w == f or is_clean(w):
                trie.add(w, n)
        out = [(w, n, canonical_spelling(trie, w, f)) for _, f, w, n in group if f is not None]
        return pd.DataFrame(out, columns=["word", "n", "canonical"])

    group: list[tuple[str, str | None, str, int]] = []
    for pdf in batches:
        for s, f, w, n in zip(pdf["skeleton"], pdf["folded"], pdf["word"], pdf["n"]):
            if len(group) >= 20_000 and s != group[-1][0]:
                yield flush(group)
                group = []
            group.append((s, f if isinstance(f, str) else None, w, n))
    if group:
        yield flush(group)


def spellings(words: DataFrame) -> DataFrame:
    """word, n, canonical of every odd word of a vocabulary of `read`; the text of a word and its count come from all its rows."""
    vocab = words.groupBy("word").agg(F.sum("n").alias("n"), F.first("folded").alias("folded"), F.first("skeleton").alias("skeleton"))
    vocab = durable(vocab)
    odd = vocab.filter("folded is not null")
    plain = vocab.filter("folded is null").join(odd.select("skeleton").distinct(), "skeleton", "left_semi")
    both = odd.select("skeleton", "folded", "word", "n").unionByName(plain.select("skeleton", "folded", "word", "n"))
    return both.repartition("skeleton").sortWithinPartitions("skeleton", "word").mapInPandas(_spell, "word string, n bigint, canonical string")


def consistent_text(docs: DataFrame, with_form: bool = True, frequent: int = 20_000) -> DataFrame:
    """doc_id, th, fp and, unless with_form is False, form: the one consistent form of each text, and fingerprints of text and form.

    Null texts have all of them null; texts without a visible character have the form ''. Two texts
    have equal forms exactly if they look the same. Repeated rows stay repeated. The canonical
    spellings of the `frequent` most frequent odd words of at most 512 characters travel to the texts
    (80 MB at the very worst); all others are joined by word.
    """
    got = durable(read(docs, with_form))
    known = durable(spellings(got.filter("word is not null")))
    texts = got.filter("word is null").withColumn("row", F.monotonically_increasing_id())
    top = known.filter(F.length("word") <= 512).orderBy(F.desc("n"), "word").limit(frequent).collect()
    table = docs.sparkSession.sparkContext.broadcast({r["word"]: r["canonical"] for r in top})
    odd = texts.filter("v is not null").select("row", "doc_id", "th", "v")
    has_rest = known.count() > len(top)
    out = "row bigint, doc_id bigint, th binary, fp binary, form string, v string, pos int, word string"
    names = [c.split()[0] for c in out.split(", ")]

    def look_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        to = table.value
        for p in batches:
            rows = []
            for row, doc, th, v in zip(p["row"].tolist(), p["doc_id"].tolist(), p["th"].tolist(), p["v"].tolist()):
                words = words_of(v)
                rest = [(i, w) for i, w in enumerate(words) if w not in to and suspect(w)] if has_rest else []
                words = [to.get(w, w) for w in words]
                if rest:
                    rows += [(row, None, None, None, None, None, i, w) for i, w in rest]
                    rows.append((row, doc, th, None, None, " ".join(words), None, None))
                else:
                    form = _together(words)
                    rows.append((row, doc, th, _print(form), form if with_form else None, None, None, None))
            yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64", "pos": "Int64"})

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            rows = []
            for doc, th, v, new in zip(p["doc_id"].tolist(), p["th"].tolist(), p["v"].tolist(), p["new"].tolist()):
                words = v.split(" ")
                for x in new if new is not None else ():
                    words[x["pos"]] = x["canonical"]
                form = _together(words)
                rows.append((doc, th, _print(form), form if with_form else None))
            yield pd.DataFrame(rows, columns=["doc_id", "th", "fp", "form"]).astype({"doc_id": "Int64"})

    done = odd.mapInPandas(look_up, out)
    columns = ["doc_id", "th", "fp", "form"]
    result = texts.filter("v is null").select(*columns)
    if has_rest:
        done = durable(done)
        new = done.filter("word is not null").select("row", "pos", "word").join(known.select("word", "canonical"), "word")
        new = new.groupBy("row").agg(F.collect_list(F.struct("pos", "canonical")).alias("new"))
        left = done.filter("v is not null").select("row", "doc_id", "th", "v").join(new, "row", "left")
        result = result.unionByName(left.select("doc_id", "th", "v", "new").mapInPandas(put, "doc_id bigint, th binary, fp binary, form string"))
        done = done.filter("word is null and v is null")
    result = result.unionByName(done.select(*columns))
    return result if with_form else result.drop("form")


def _prints(docs: DataFrame) -> DataFrame:
    """Distinct (doc_id, th, fp) of documents with a visible character."""
    f = consistent_text(docs, with_form=False)
    return durable(f.filter(F.col("doc_id").isNotNull() & F.col("fp").isNotNull() & (F.col("fp") != F.unhex(F.md5(F.lit(""))))).distinct())


def _variants(prints: DataFrame) -> DataFrame:
    """fp, th, n: the different texts of each class that has two or more, with their number of documents."""
    v = prints.groupBy("fp", "th").agg(F.count(F.lit(1)).alias("n"))
    mixed = v.groupBy("fp").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("fp")
    return durable(v.join(mixed, "fp", "left_semi"))


def lookalike_classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, n_links: documents of each class of texts that look the same though they differ.

    class_id is the least doc_id of the class, n_links the number of documents that look the same as
    this one in other characters. Classes of equal texts only, null texts and texts without a visible
    character are left out. One row per document, however large the class.
    """
    f = _prints(docs)
    v = _variants(f)
    size = v.groupBy("fp").agg(F.sum("n").alias("size"))
    first = f.join(v.select("fp").distinct(), "fp", "left_semi").groupBy("fp").agg(F.min("doc_id").alias("class_id"))
    links = v.join(size, "fp").join(first, "fp").select("fp", "th", "class_id", (F.col("size") - F.col("n")).alias("n_links"))
    return f.join(links, ["fp", "th"]).groupBy("doc_id", "class_id").agg(F.max("n_links").alias("n_links"))


def lookalike_pairs(docs: DataFrame) -> DataFrame:
    """doc_id_a < doc_id_b: pairs of documents whose texts look the same though their characters differ.

    Different texts of a class are paired first and documents put in then, so nothing but the result
    is formed, however often a text is repeated. The result is all such pairs, by definition of the
    query; `lookalike_classes` gives the same classes in one row per document.
    """
    f = _prints(docs)
    v = _variants(f).select("fp", "th")
    two = v.alias("a").join(v.alias("b"), (F.col("a.fp") == F.col("b.fp")) & (F.col("a.th") < F.col("b.th"))).select(F.col("a.th").alias("ta"), F.col("b.th").alias("tb"))
    ids = f.select("doc_id", "th").distinct()
    a, b = ids.select(F.col("doc_id").alias("x"), F.col("th").alias("ta")), ids.select(F.col("doc_id").alias("y"), F.col("th").alias("tb"))
    pairs = two.join(a, "ta").join(b, "tb").filter("x <> y")
    return pairs.select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b")).distinct()
