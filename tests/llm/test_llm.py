"""Truncation, pairs, encoding, packing, look-alikes: held-out accuracy, round trips, brute force, edge cases."""

import itertools
import os
import random
import unicodedata

import numpy as np
import pytest

from quaesta.llm import encode, languages, lookalike, packing, pairs, queries, refusals, texts, truncation

needs_vocabulary = pytest.mark.skipif(not os.path.exists(os.path.join(encode.TOKENIZERS, "byte_bpe_50k.tiktoken")), reason="no tokenizer files")
SENTENCES = ["Retry 5 kept the same charge.", "The field strength of the coil is 61.5 kV/m.", "Every courier who paints the hull also opens the vault.", "Insert the numbers: $U = 4.3 \\cdot 79.7 = 9.9$.", "We're told that the shunt carries 12 A at t = 3 s."]
ENDS = ["", "\n\nAnswer: 5 A", "\n**Final answer: C**", " ∎", "\n\n\\[ \\boxed{3 kg} \\]"]


def sample(n, seed):
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        body = " ".join(rnd.choices(SENTENCES, k=rnd.randint(1, 8)))
        out.append(f"<reasoning>\n{body}\n</reasoning>\n<answer>4 V</answer>" if rnd.random() < 0.4 else body + rnd.choice(ENDS))
    return out


@pytest.fixture(scope="module")
def weights():
    bare = [f"{i}.{i % 7} {u}" for i in range(20) for u in ("V", "A", "kg", "mJ")] + ["Yes", "B", "True", "Uncertain"] * 8
    return truncation.train([(t, False) for t in sample(2000, 1) + bare])


CUT = ["The field of the", "A <reasoning> Done.", "Sum: $x = 3", "so it goes…", "and then [truncated]", "lost \ufffd", "x\n```\nsolve(", "see (the coil is hot.", "<answer>5</ans", "The steps 1, 2, ..."]
WHOLE = ["Done.", "Steps 1, 2, ... are routine and were cut from the log.", "He left.\n\nAnswer: 5 A", "x. ∎", "(It is hot.)", "`a`\n```\nsolve(3) = 4\n```", "5.3 kV/m", "Unknown", "No"]
BLANK = ["", None, "N/A", "...", "[no output]", "\u200b", " \n"]


def test_the_score_decides(spark, weights):
    rows = list(enumerate([*CUT, *WHOLE, *BLANK]))
    df = spark.createDataFrame([(i, "s", t) for i, t in rows], "row_id bigint, source string, text string")
    got = {r["row_id"]: r for r in truncation.score(df, weights).collect()}
    assert [t for i, t in rows if got[i]["truncated"] != (t in CUT)] == []
    assert all(got[i]["probability"] == 0 for i, t in rows if t in BLANK)
    assert truncation.score(df, np.zeros(truncation.DIMS)).filter("truncated").count() == 0  # no weights, no rows


def test_truncation_on_held_out_cuts(spark, weights):
    rnd = random.Random(2)
    rows = []
    for i, t in enumerate(sample(600, 3)):
        rows += [(2 * i, "s", t), (2 * i + 1, "s", t[: rnd.randrange(len(t) // 3, len(t) - 2)])]
    got = {r["row_id"]: r["truncated"] for r in truncation.score(spark.createDataFrame(rows, "row_id bigint, source string, text string"), weights).collect()}
    assert np.mean([not got[2 * i] for i in range(600)]) > 0.99
    # cuts right after a sentence cannot be told; none of the cuts was chosen by a rule
    assert np.mean([got[2 * i + 1] for i in range(600)]) > 0.93


def test_truncation_edges(spark, weights):
    rows = [(1, None, None), (2, "a", ""), (3, "a", "  "), (4, None, "The word is cu"), (5, "a", "x " * 50_000 + "and then the"), (5, "a", "x " * 50_000 + "and then the")]
    df = spark.createDataFrame(rows, "row_id bigint, source string, text string")
    s = truncation.score(df, weights)
    assert {r["row_id"] for r in s.filter("truncated").collect()} == {4, 5}
    rates = {r["source"]: (r["n_records"], r["n_truncated"]) for r in truncation.truncation_rates(s).collect()}
    assert rates == {None: (2, 1), "a": (3, 1)}
    empty = df.limit(0)
    assert truncation.score(empty, truncation.fit(empty)).count() == 0


def test_long_texts_reach_the_sample(spark):
    long = "The coil is hot. " * 4000
    df = spark.createDataFrame([(i, "s", long) for i in range(3)] + [(9, "s", "The relay is slow.")], "row_id bigint, source string, text string")
    assert np.abs(truncation.fit(df)).sum() > 0 and len(long) > 50_000


def test_field_limits(spark):
    rows = [("a", "x" * 40)] * 5 + [("a", "y" * 7), ("b", "z" * 30), ("b", None), (None, "é" * 25)]
    got = {r["source"]: (r["limit_chars"], r["limit_bytes"]) for r in truncation.field_limits(spark.createDataFrame(rows, "source string, text string")).collect()}
    assert got["a"] == (40, 40) and got["b"] == (None, None)


Q = "How large is the flux of a coil when its charge reaches 3.5 mA?"
SPOKEN = {
    "en": ["The charge stays the same after the switch opens.", "Every baker who paints the hull also opens the vault.", "From this it follows that the force is zero.", "The coil is hot and the answer is declined here.", "How large is the flux of a coil when its charge reaches a value?", "The premises do not allow a conclusion about this hall.", "Thermal losses are small and the sign decides."],
    "fr": ["La charge reste inchangée après la coupure du courant.", "On en déduit que la force est nulle dans ce cas.", "Les pertes thermiques sont négligées dans cet exercice.", "Chaque boulanger qui peint la coque ouvre aussi le coffre."],
    "zh": ["断开电源以后，电荷保持不变。", "储存的能量减小为原来的一半。", "每个面包师都打开保险柜。"],
    "ru": ["Тепловые потери здесь не учитываются.", "По условию всё верно, заряд не меняется.", "Каждый пекарь открывает хранилище."],
}


def spoken(seed, n, names=SPOKEN):
    rnd = random.Random(seed)
    rows = [(" ".join(rnd.choices(SPOKEN[x], k=3)), x) for x in names for _ in range(n)]
    rnd.shuffle(rows)
    return rows


def varied(n):
    """Different texts, every third with another ending."""
    return [f"The coil of hall {i} carries {i % 97} A. {SENTENCES[i % 5]}{ENDS[i % 3]}" for i in range(n)]


def test_models_come_from_whole_tables(spark, tmp_path):
    """More rows than any former sample held, with what decides in the rest."""
    responses = varied(8500)
    f = spark.createDataFrame([(i, "s", t, "en") for i, t in enumerate(responses)], "sample_id bigint, source string, response string, lang string")
    rare = [f"{a}{b}" for a in "abcdef" for b in "vwxyz"]
    docs = [(i, f"Hall {i} is cold. {t}", "en") for i, t in enumerate(responses[:7000])] + [(10_000 + i, f"Qu{x} zo{x}ma {x}{x} rela{x} {x}unto.", x) for i, x in enumerate(rare)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    solutions = [("The force is zero.", "So the sign decides.")] * 5000 + [("I cannot help with this request.", None)] * 400
    spark.createDataFrame(solutions, "cot string, explanation string").coalesce(1).write.parquet(f"{tmp_path}/val_samples.parquet")
    m = queries._models(spark, str(tmp_path), f)
    assert m.threshold == 0.95
    assert m.languages.names == sorted(["en", *rare]) + ["other"]
    at = truncation.field_limits(f, "source", "response").collect()[0]
    full = [truncation._fills(t, at["limit_chars"] or np.nan, at["limit_bytes"] or np.nan) for t in responses]
    assert np.abs(m.weights - truncation.train(list(zip(responses, full)))).max() < 1e-6


def test_fitted_in_spark_or_at_once(spark):
    texts_ = varied(300)
    df = spark.createDataFrame([("s", t) for t in [*texts_, *texts_[:50], "", None]], "source string, text string").repartition(3)
    here = truncation.fit(df, steps=6)
    assert np.abs(here).sum() > 0 and (here == truncation.fit(df, steps=6, driver_rows=0)).all() and (here == truncation.fit(df.coalesce(1), steps=6)).all()
    rows = [(i, t, x) for i, (t, x) in enumerate(spoken(5, 40))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    held = {r["doc_id"] for r in docs.filter("pmod(xxhash64(doc_id, text), 5) = 0").select("doc_id").collect()}
    a, b = [r for r in rows if r[0] in held], [r for r in rows if r[0] not in held]
    order = [r for i, x in enumerate(a[: len(b) // 4]) for r in (x, *b[4 * i : 4 * i + 4])]  # train holds out every fifth
    kept = {r[0] for r in order}
    more = [("The charge stays the same after the switch opens.", "en"), ("Каждый пекарь открывает хранилище.", "en"), ("Se la vi.", "xx")]
    got = languages.fit(docs.filter(docs.doc_id.isin(kept)), spark.createDataFrame(more, "text string, lang string"))
    want = languages.train([t for _, t, _ in order], [x for _, _, x in order], more)
    assert got.names == want.names and np.allclose(got.weights, want.weights) and abs(got.other - want.other) < 1e-4
    said = [*SENTENCES, "I cannot help with this request."]
    assert refusals.fit(spark.createDataFrame([(t, None) for t in said], "a string, b string"), "a", "b", share=0.5) == refusals.fit_threshold(said, share=0.5) == 0.7
    assert refusals.fit(spark.createDataFrame([(t, None) for t in said], "a string, b string"), "a", "b") == refusals.fit_threshold(said) == 0.95


@pytest.fixture(scope="module")
def models(weights):
    rows = spoken(3, 60)
    return pairs.Models(weights, refusals.fit_threshold(SENTENCES), languages.train([t for t, _ in rows], [x for _, x in rows]))


@pytest.mark.parametrize(
    "response,extracted,defect",
    [
        (None, "A", "empty"), ("[no output]", "A", "empty"), ("<answer> </answer>", "", "empty"), ("...", "-", "empty"), ("The flux is 3.", "**", "empty"), ("\\boxed{}", "3", "empty"),
        ("I'm sorry, but I can't help with this request.", "x", "refusal"), ("<answer>I am unable to provide a solution.</answer>", "x", "refusal"), ("Tôi từ chối trả lời; hãy hỏi giáo viên của bạn.", "x", "refusal"), ("This request can't be completed under the current rules.", "x", "refusal"),
        ("I can't rule out C at first, yet the sign decides. The answer is C.", "C", ""), ("Sorry for the long table; the result is 3 J.", "3 J", ""), ("I cannot use rule 9 here, but rule 3 settles it. <answer>A</answer>", "A", ""), ("The premises do not allow a conclusion about hall 48, so the answer is Unknown.", "Unknown", ""),
        (Q, "x", "copy"), (f"> {Q}", "x", "copy"), (f"Question: {Q.lower()}", "x", "copy"), (f"<answer>{Q}</answer>", "x", "copy"), (f"You asked: {Q.replace(' ', '  ')}", "x", "copy"),
        (f"The question asks: {Q} Thermal losses are small. <answer>3</answer>", "3", ""), ("No", "No", ""), ("5.1 A", "5.1 A", ""),
        ("La charge reste inchangée après la coupure. On en déduit que la force est nulle.", "x", "language"), ("储存的能量减小为原来的。断开电源以后，电荷保持不变。", "x", "language"), ("Тепловые потери здесь не учитываются. По условию всё верно.", "x", "language"), ("$3 = 4$ \\[ \\boxed{5} \\]", "5", ""),
    ],
)
def test_defects(models, response, extracted, defect):
    have = languages.languages(models.languages, [response or ""])[0]
    assert pairs.defect(response, extracted, Q, False, "en", "" if have == "other" else have, True, models.threshold) == defect


def test_long_refusals_and_long_clipped_questions(models):
    long = "Thanks for the question about the coil and the shunt. " * 60
    assert refusals.is_refusal(long + "I'm sorry, but I can't help with this request.", models.threshold)
    assert not refusals.is_refusal(long, models.threshold)
    full = "If the welder of dock 80 reads the manual, " + "and the baker of hall 7 paints the hull, " * 12 + "must it be true that someone opens the vault?"
    stub = full[:100]
    assert texts.is_copy(full, stub) and texts.is_copy("You asked: " + full, stub)
    assert not texts.is_copy(full + " Since the welder reads it, the vault is opened by the second rule." * 3, stub)
    assert not texts.is_copy(stub[:60], stub)


def test_refusals_in_other_words(models):
    """None of these sentences is a template's; they were written after the lexicon was settled."""
    said = [
        "I shall not answer the exercise you sent.", "My instructions do not permit me to solve exam problems.", "I have decided to refrain from giving a solution.", "Sorry, I cannot discuss that question.", "It would violate the policy to answer this request.",
        "I'm not willing to work on this task.", "We regret that I am incapable of handling this query.", "An answer to this request will not be provided.", "I do not think I should be the one to solve this, so I decline.", "No help can be given with this item.",
        "I'm restricted from answering this kind of question.", "Please understand that I won't attempt this problem.", "I'd rather abstain from replying to this.", "Giving solutions to this exam is not something I am able to do.", "Je refuse de répondre à cette question.",
        "Ich darf diese Aufgabe nicht lösen.", "Tôi không được phép giải đề này.", "Mình từ chối giải bài này.", "我不能解答这个问题。", "Я отказываюсь отвечать на этот вопрос.",
    ]
    assert np.mean([refusals.is_refusal(s, models.threshold) for s in said]) >= 0.9
    answers = [
        "The question cannot be answered from the premises.", "Premise 3 does not help here.", "The charge does not change, no energy is given off.", "No answer option fits better than B.", "We do not know whether the baker answers the question.", "Nobody who declines a shift can answer the phone.",
        "The request desk does not open when the guard refuses.", "It is not possible to infer that the baker answers.", "The given data are not sufficient to answer this question.",
    ]
    assert not [s for s in answers if refusals.is_refusal(s, models.threshold)]


def test_refusal_threshold_follows_the_solutions():
    assert refusals.fit_threshold([]) == 0.7
    assert refusals.fit_threshold(["I cannot help with this request."] * 10) == 0.95


def test_languages_held_out():
    rows = spoken(5, 80)
    model = languages.train([t for t, _ in rows], [x for _, x in rows])
    test = spoken(6, 20)
    assert np.mean([a == x for a, (_, x) in zip(languages.languages(model, [t for t, _ in test]), test)]) > 0.97
    known = spoken(7, 80, ["en", "fr"])
    model = languages.train([t for t, _ in known], [x for _, x in known])
    unseen = [t for t, _ in spoken(8, 20, ["zh", "ru"])] + ["La carica del condensatore rimane invariata dopo il distacco della batteria.", "電池を外した後、電荷は変わりません。したがってエネルギーは減少します。"]
    assert np.mean([x == "other" for x in languages.languages(model, unseen)]) > 0.9
    assert languages.languages(model, ["", "5 A", "does not change", "Answer: unknown", "$the = force$"]) == [""] * 5
    assert languages.languages(languages.train([], []), ["The coil is hot."]) == [""]


def test_lcs_against_brute_force():
    rnd = random.Random(1)
    for _ in range(50):
        a, b = [[rnd.choice("xyz") for _ in range(rnd.randint(0, 7))] for _ in "ab"]
        subs = {c for k in range(len(a) + 1) for c in itertools.combinations(a, k)}
        sub_b = {c for k in range(len(b) + 1) for c in itertools.combinations(b, k)}
        assert texts.lcs(a, b) == max(len(c) for c in subs & sub_b)


def test_pairs_table(spark, models):
    cols = "sample_id bigint, source string, response string, extracted string, question string, lang string"
    rows = [(1, "s", None, None, Q, "en"), (2, "s", "The flux of the co", "x", Q, "en"), (3, "s", "It is 5.", "5", None, None), (4, None, Q, "x", Q, None), (1, "s", None, None, Q, "en")]
    got = sorted((r["sample_id"], r["defect"]) for r in pairs.broken_pairs(spark.createDataFrame(rows, cols), models).collect())
    assert got == [(1, "empty"), (2, "truncated"), (4, "copy")]
    assert pairs.broken_pairs(spark.createDataFrame(rows[:0], cols), models).count() == 0


@needs_vocabulary
def test_encoding_is_exact(spark):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(os.path.join(encode.TOKENIZERS, "byte_bpe_50k.json"))
    tk.encode_special_tokens = True
    rnd = random.Random(6)
    odd = ["", None, " ", "\n\n \t x", "don't we'll", "naïve café", "数字１２ 和", "a b　c", "<|endoftext|> x", "x" * 5000, "😀 👍🏽", "tab\tend ", "١٢٣ ½ ²", "é", "\u0085 z"]
    alphabet = "ab 1.é\n\t'sτ的  -"
    docs = [*enumerate(odd), *[(100 + i, "".join(rnd.choices(alphabet, k=rnd.randint(0, 60)))) for i in range(300)], (500, "long words " * 20_000)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    for frequent in (0, 5, 20_000):
        got = {r["doc_id"]: list(r["ids"]) for r in encode.encode(df.unionByName(df.limit(5)), frequent=frequent).collect()}
        assert [k for k, t in docs if got[k] != (tk.encode(t, add_special_tokens=False).ids if t else [])] == []
    back = {r["doc_id"]: r["text"] for r in encode.decode(encode.encode(df)).collect()}
    assert [k for k, t in docs if back[k] != (t or "")] == []
    n = {r["doc_id"]: r["n_tokens"] for r in encode.token_counts(df, frequent=5).collect()}
    assert n == {k: len(v) for k, v in got.items()}
    assert encode.encode(df.limit(0)).count() == 0


def test_differencing_keeps_all_items():
    rnd = random.Random(2)
    for _ in range(60):
        sizes = [rnd.randint(1, 50) for _ in range(rnd.randint(1, 60))]
        k = rnd.randint(1, 12)
        bins, most = packing.differencing(sizes, k)
        sums = np.bincount(bins, sizes, k)
        assert len(bins) == len(sizes) and max(bins) < k and sums.max() == most and sums.sum() == sum(sizes)
        cap = rnd.randint(50, 120)
        bins, k = packing.fill(sizes, cap)
        assert np.bincount(bins, sizes, k).max() <= cap


def test_packing(spark):
    rnd = random.Random(9)
    sizes = [(i, rnd.choice([0, 3, 40, 90, 333, 1000])) for i in range(700)] + [(None, 4), (9999, None)]
    df = spark.createDataFrame(sizes, "doc_id bigint, n_tokens bigint")
    w = spark.createDataFrame([(1, 512), (2, 64), (3, None), (4, 0)], "window_id int, capacity int")
    rows = packing.pack(df, w, windows_per_group=8).collect()
    want = {(i, n) for i, n in sizes if i is not None and n is not None}
    for wid, cap in ((1, 512), (2, 64)):
        mine = [r for r in rows if r["window_id"] == wid]
        used, total, parts = {}, {}, {}
        for r in mine:
            used[r["window"]] = used.get(r["window"], 0) + r["n_tokens"]
            total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["n_tokens"]
            parts.setdefault(r["doc_id"], []).append((r["start"], r["n_tokens"]))
        assert max(used.values()) <= cap and {(k, v) for k, v in total.items()} == want
        for i, n in want:
            p = sorted(parts[i])
            assert len(p) == 1 or n > cap
            assert all(a + b == c for (a, b), (c, _) in zip(p, p[1:]))
        assert sum(used.values()) / (len(used) * cap) > 0.9
    assert packing.pack(df.limit(0), w).count() == 0
    assert packing.pack(df, w.limit(0)).count() == 0


def dress(t, rnd):
    """The same looks in other characters."""
    alike = {v: k for k, v in lookalike.ALIKE.items() if len(v) == 1}
    out = []
    for c in t:
        r = rnd.random()
        out.append(alike[c] if r < 0.2 and c in alike else " " if c == " " and r < 0.4 else unicodedata.normalize("NFD", c) if r < 0.5 else c)
        if r > 0.93:
            out.append(rnd.choice("​­⁠͏"))
    return "".join(out)


def test_lookalikes_against_brute_force(spark):
    rnd = random.Random(4)
    base = ["The copper rod is café warm.", "Шаг 5 даёт ответ.", "So f² = 3 kΩ", "case Matters", "first line\nsecond", "Đường dây này"]
    hard = ["The copper rod is cafe warm.", "So f2 = 3 kΩ", "Case Matters", "first line second", "The copper rod is café warn."]
    docs = [(i, dress(rnd.choice(base), rnd)) for i in range(60)] + [(100 + i, t) for i, t in enumerate(base + base[:2] + hard)] + [(200, None), (201, ""), (202, "​  "), (203, " ")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")

    def form(t):
        s = "".join(" " if c in "  " else c for c in t)
        return unicodedata.normalize("NFC", "".join(lookalike.fold_char(c) for c in unicodedata.normalize("NFD", s))).strip()

    want = {(a, b) for (a, x), (b, y) in itertools.combinations(docs, 2) if x and y and x != y and form(x) and form(x) == form(y)}
    got = {(r["doc_id_a"], r["doc_id_b"]) for r in lookalike.lookalike_pairs(df).collect()}
    assert got == want
    classes = {r["doc_id"]: r["class_id"] for r in lookalike.lookalike_classes(df).collect()}
    assert set(classes) == {x for p in want for x in p} and all(classes[a] == classes[b] for a, b in want)
    forms = {r["doc_id"]: r["form"] for r in lookalike.consistent_text(df).collect()}
    assert forms[200] is None and forms[202] == "" and forms[101] == base[1] and forms[100] == base[0]
    assert lookalike.lookalike_pairs(df.limit(0)).count() == 0


def test_all_odd_characters_are_suspect():
    odd = set(lookalike.suspect_characters())
    for i in range(0x80, 0x110000):
        c = chr(i)
        if not 0xD800 <= i < 0xE000 and (lookalike.fold(c) != c or c in lookalike.ALIKE or unicodedata.combining(c) or unicodedata.normalize("NFC", c) != c):
            assert i in odd, hex(i)
    for a, b in (("X marks", "Χ marks"), ("한국 글", unicodedata.normalize("NFD", "한국 글")), ("Kelvin", "\u212aelvin")):
        assert lookalike.suspect(b) and lookalike.fold(a) == lookalike.fold(b)


def test_the_automaton_decides_readings(spark, monkeypatch):
    docs = [(1, "The model holds."), (2, "The mode\u04c0 holds."), (3, "\u04c0n a hall"), (4, "In a hall"), (5, "kapaI x"), (6, "kapa\u0399 x"), (7, "Χ marks"), (8, "X marks"), (9, "한국 글"), (10, unicodedata.normalize("NFD", "한국 글"))]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    for frequent in (0, 3, 20_000):
        form = {r["doc_id"]: r["form"] for r in lookalike.consistent_text(df, frequent=frequent).collect()}
        # what is an I elsewhere is an l where the vocabulary has the word
        assert form[2] == form[1] and form[3] == form[4] and form[6] == form[5] and form[7] == form[8] and form[9] == form[10]
    pairs_ = sorted(tuple(r) for r in lookalike.lookalike_pairs(df).collect())
    assert pairs_ == [(1, 2), (3, 4), (5, 6), (7, 8), (9, 10)]
    # by the table alone the first pair is lost
    assert lookalike.fold(docs[1][1]) != lookalike.fold(docs[0][1])


def test_hot_texts_give_their_pairs_only(spark):
    docs = [(i, "The copper rod is warm.") for i in range(300)] + [(1000 + i, "The cоpper rod is warm.") for i in range(2)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert lookalike.lookalike_pairs(df).count() == 600
    links = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in lookalike.lookalike_classes(df).collect()}
    assert len(links) == 302 and links[5] == (0, 2) and links[1001] == (0, 300)


def test_trie_finds_by_zero_cost_edits():
    t = lookalike.Trie()
    for w, n in (("efficiency", 9), ("office", 2), ("Шаг", 3)):
        t.add(w, n)
    assert t.spellings("eﬃciency".replace("ﬃ", "ﬀi"))[0][2] == "efficiency"
    assert t.spellings("ef​fісiеnсу")[0][2] == "efficiency"
    assert t.spellings("efficiencx") == [] and t.spellings("efficiencx", budget=1.0)[0][2] == "efficiency"
    assert lookalike.canonical_spelling(t, "оffice", "office") == "office"


def test_queries_run(spark):
    from quaesta.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test data")
    for name, f in QUERIES.items():
        f(spark, sf).count()
    assert QUERIES["p6_round_trip"](spark, sf).count() == 0


@needs_vocabulary
def test_extra_columns_with_clashing_names(spark):
    from pyspark.sql import functions as F

    names = ("h", "pos", "word", "words", "ids", "n", "k", "more", "rare", "form", "fp", "th", "v", "to", "canonical", "window", "capacity", "source", "limit_chars")
    df = spark.createDataFrame([(1, "The coil ｉs hot."), (2, "The coil is hot."), (2, "The coil is hot.")], "doc_id bigint, text string").withColumns({c: F.lit("clash") for c in names})
    assert encode.encode(df).count() == 2
    assert [tuple(r) for r in lookalike.lookalike_pairs(df).collect()] == [(1, 2)]
    assert lookalike.lookalike_classes(df).count() == 2
    w = spark.createDataFrame([(1, 8, "x")], "window_id int, capacity int, groups string")
    assert packing.pack(encode.token_counts(df), w).select("doc_id").distinct().count() == 2


def test_copies_in_texts_that_begin_anywhere():
    q = "If the lighthouse keeper of dock 42 calibrates the scale, must it be true that someone passes the drill?"
    cut = q[:100]
    assert texts.is_copy(q, cut) and texts.is_copy(f"Question: {q}", cut)
    assert texts.is_copy(f"passes the drill?\n</reasoning>\n<answer>{q}</answer>", cut)
    assert texts.is_copy(f"ll?\n</reasoning>\n<answer>{Q}</answer>", Q)
    assert not texts.is_copy("must it be true that someone passes the drill?", cut)
    assert not texts.is_copy(f"{q} The current of the coil is small. Retry 5 kept the same charge over here. <answer>B</answer>", cut)
    assert not texts.is_copy("No", q) and not texts.is_copy("", q) and not texts.is_copy(q, None)


def test_long_refusals_count():
    question = "A student who holds a permit may enter the archive, and the archive is open on each day that the vault is closed. " * 4
    why = "The premises name several people and several rules, and each of them would have to be weighed with care. " * 8
    for t in (question + "I am unable to help with this. " + why, "I'm sorry, but I cannot answer that. " + why + question, why + question + "So I must decline to answer."):
        assert len(texts.tokens(t)) > 120 and refusals.is_refusal(t)
    assert not refusals.is_refusal(question + why)
    assert not refusals.is_refusal(question + "At first it seems that one cannot answer this. " + why + "<answer>B</answer>")
    assert not refusals.is_refusal("I cannot answer at once. " + why + "\nAnswer: 12 V")
