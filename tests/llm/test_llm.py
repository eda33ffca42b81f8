"""Operators on training texts: brute force, round trips, labelled rows, and odd inputs."""

import datetime as dt
import random
import re

import numpy as np
import pytest

from spanloom.llm import consensus, languages, leaks, packing, pairs, quality, repetition, sentences, sentences_spark, splitting
from tests.conftest import DATA, rows

T0 = dt.datetime(2025, 3, 3)
TRACE = "id string, sample_id string, rt string, model string, stored_at timestamp, question string, defect string"


def trace_rows(spark, texts):
    """Traces with columns that clash with the operators' own, a null id, and every row twice."""
    data = [(f"t{i}", f"s{i}", t, None, T0, "clash", "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame([*data, *data, (None, "s0", "no id", None, None, None, None)], TRACE)


ODD = [None, "", " \n\t", "​", "Ünï 🙂 ok.", "x" * 20_000, "a " * 30_000 + "end.", "\x00 \ufffd weird.", "。。。", "$$"]


# -- sentences ------------------------------------------------------------------
@pytest.mark.parametrize(
    ("text", "units"),
    [
        ("Dr. Ost uses it, e.g. the value in Fig. 3. Then it stops at 4 p.m. Now go.", ["Dr. Ost uses it, e.g. the value in Fig. 3.", "Then it stops at 4 p.m.", "Now go."]),
        ('The note says "Do not round. Keep 2 digits." and I follow it. Good.', ['The note says "Do not round. Keep 2 digits." and I follow it.', "Good."]),
        ('It ends with "measure twice." Next.', ['It ends with "measure twice."', "Next."]),
        ("Laut Dr. Ra gilt das z. B. auch für den 3. Versuch. Am 14. Mai, d. h. bald. Ja!", ["Laut Dr. Ra gilt das z. B. auch für den 3. Versuch.", "Am 14. Mai, d. h. bald.", "Ja!"]),
        ("结果会不会依赖压强？题目写着“不要四舍五入。保留2位。”，所以我照做。好", ["结果会不会依赖压强？", "题目写着“不要四舍五入。保留2位。”，所以我照做。", "好"]),
        ("それは正しい！「丸めないこと。」とあるので従います。", ["それは正しい！", "「丸めないこと。」とあるので従います。"]),
        ("มวลเท่ากับ 71.3 กิโลกรัม คำตอบนี้ไม่ถูกต้อง", ["มวลเท่ากับ 71.3 กิโลกรัม", "คำตอบนี้ไม่ถูกต้อง"]),
        ("यह सही नहीं है! डॉ. Ra आता है। फिर", ["यह सही नहीं है!", "डॉ. Ra आता है।", "फिर"]),
        ("Температура, т. е. почти. На рис. 5 видно. Да", ["Температура, т. е. почти.", "На рис. 5 видно.", "Да"]),
        ("Hmm... maybe so... Therefore 6! / 3! = 120. pH is low.", ["Hmm... maybe so...", "Therefore 6! / 3! = 120.", "pH is low."]),
        ("- one\n  2. two.\n\n```\nx = 1.5\n```", ["- one", "2. two.", "```", "x = 1.5", "```"]),
        ("Version 1.2.3 of run_1.txt is done.Next one.最后。", ["Version 1.2.3 of run_1.txt is done.", "Next one.", "最后。"]),
        ("", []),
        ("\n \u200b\n", []),
    ],
)
def test_sentences(text, units):
    assert [text[s:e] for s, e in sentences.sentence_spans(text)] == units


@pytest.mark.parametrize("head", ["so we add the two and keep the rest\n", "ADD THE TWO AND KEEP THE REST\n"])
def test_letter_case_is_judged_over_the_whole_text(head):
    head, tail = head * (4_200 // len(head)), "We see this. then it stops here. The sum is 4.\n" * 400
    units = sentences.sentence_spans(head + tail)
    assert [(s - len(head), e - len(head)) for s, e in units if s >= len(head)] == sentences.sentence_spans(tail)


def test_sentences_match_annotated_units(spark):
    votes = spark.read.parquet(f"{DATA}/ta_votes.parquet").select("rtrace_id", "unit_start", "unit_end").distinct()
    found = sentences_spark.sentence_units(spark.read.parquet(f"{DATA}/rtrace.parquet"))
    wanted = votes.select("rtrace_id").distinct()
    assert rows(found.join(wanted, "rtrace_id", "left_semi")) == rows(votes)


def test_sentences_cover_all_text(spark):
    for t in ODD[1:]:
        spans = sentences.sentence_spans(t)
        assert spans == sorted(spans) and all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
        kept = "".join(t[s:e] for s, e in spans)
        assert "".join(kept.split()) in ("".join(t.split()), "") or "​" in t
    out = sentences_spark.sentence_units(trace_rows(spark, ODD))
    assert len(rows(out)) == len(set(rows(out)))
    assert rows(sentences_spark.sentence_units(trace_rows(spark, [None]).limit(0))) == []


# -- pairs ----------------------------------------------------------------------
QUESTION = "Two samples are kept in a kiln room. The first one, an oak lens, loses 45,490 kPa per hour. When do both have the same torque?"


@pytest.mark.parametrize(
    ("question", "response", "defect"),
    [
        (QUESTION, None, "empty"), (QUESTION, "<think>\n</think>", "empty"), (QUESTION, "N/A", "empty"), (QUESTION, " \u200b—", "empty"), (None, "", "empty"),
        (QUESTION, "Thank you for the question. I'm sorry, but I can't help with this problem.", "refusal"),
        (QUESTION, "Es tut mir leid, aber dabei kann ich nicht helfen.", "refusal"),
        (QUESTION, QUESTION.upper(), "copy"), (QUESTION, "Q: " + QUESTION.replace(",", ""), "copy"), (QUESTION, "> " + QUESTION.replace(" ", "  "), "copy"),
        (QUESTION, QUESTION + " The lens loses 3 kPa, so the pressure of both is equal after two hours. Then the torque must be the same. Thus the answer is 4.", None),
        (QUESTION, "Die Masse des Körpers ist nicht groß und der Rest bleibt in der Flasche. Das Ergebnis ist somit 4.", "other_language"),
        (QUESTION + " Please answer in German.", "Die Masse des Körpers ist nicht groß und der Rest bleibt. Das Ergebnis ist somit 4.", None),
        (QUESTION, "The mass of the old lens is 4 kg and the rod holds half of it. 最后比较等式两边的单位。 Thus the answer is 4.", None),
        (QUESTION, "I can't simplify this any further. That can't be right! Final answer: 3 ms.", None),
        (QUESTION, "The mass is 4 kg. Final answer:", "truncated"), (QUESTION, "The mass is 4 kg.\n\n## Solving for", "truncated"), (QUESTION, "It is 4.\n\n```\nx = q * (", "truncated"),
        (QUESTION, "So the result is \\boxed{", "truncated"), (QUESTION, "The mass of the le", "truncated"), (QUESTION, "We set $$ k = 3 +", "truncated"), (QUESTION, "The value (vs. the one of", "truncated"),
        (QUESTION, "The mass is 4 kg.\n\n\\boxed{4}", None), (QUESTION, "The mass is 4 kg.\n\nAnswer: (C)", None), (QUESTION, "The mass is 4 kg.\n\n= 3.5 kg", None), (QUESTION, "It is 4.\n\n✓ 3 K", None),
        (QUESTION, "It is 4.\n\n**3 K**", None), (QUESTION, "It is 4.\n\nk = 5 (rounded)", None), (QUESTION, "It is 4.\n\nQED", None), (QUESTION, "It is 4.\n\n$$ x = 5 $$", None),
        (None, "No question, but a whole answer.", None),
    ],
)
def test_defects(question, response, defect):
    assert pairs.defect(question, response) == defect


@pytest.mark.parametrize(
    ("response", "defect"),
    [
        ("We set\n\\[\na = b + 3\nx = 5", "truncated"), ("We set\n\\begin{align}\na = b + 3\n\nx = 5", "truncated"), ("We set\n$$\n" + "a = b + 3\n" * 60 + "x = 5", "truncated"), ("The old rod holds (as we\nknow from the first part\nx = 5", "truncated"),
        ("It is so.\n\n\\boxed{" + "x + 3 + " * 20 + "4}", None), ("It is so.\n\n\\boxed{\\frac{" + "x + 3 + " * 20 + "4}{2}}.", None), ("&nbsp;" * 100, "empty"), ("&nbsp;" * 100 + "The rod is old.", None), ("- " * 300 + "N/A", "empty"),
        ("We set\n\\[\na = b \\\\[2pt]\nx = 5\n\\]", None), ("We set\n\\begin{align}\na = b\n\\end{align}\nx = 5", None), ("For t in [0, 1)\nwe have\nx = 5", None), ("It fails (see above.\n\nx = 5", None), ("We run\n\n```\necho $$ ( \\[\n```\n\nx = 5", None), ("Let $$ a = b $$\nbe so.\nx = 5", None),
    ],
)
def test_defects_of_whole_texts(response, defect):
    assert pairs.defect(QUESTION, response) == defect


def test_suffix_automaton_against_brute_force():
    rng = random.Random(1)
    for _ in range(60):
        s, t = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 14))) for _ in range(2))
        least = rng.randint(1, 4)
        mark = [False] * len(t)
        for i in range(len(t)):
            for j in range(i + least, len(t) + 1):
                if t[i:j] in s:
                    mark[i:j] = [True] * (j - i)
        assert pairs.SuffixAutomaton(s).covered(t, least) == sum(mark)


def test_broken_pairs_odd_inputs(spark):
    samples = spark.createDataFrame([("s0", QUESTION, "x"), ("s0", QUESTION, "x"), ("s1", None, "x"), (None, "q", "x")], "id string, question string, rt string")
    out = dict(rows(pairs.broken_pairs(samples, trace_rows(spark, ODD))))
    assert out["t0"] == out["t1"] == out["t2"] == out["t3"] == "empty" and "t4" not in out
    assert rows(pairs.broken_pairs(samples.limit(0), trace_rows(spark, ["fine."]).limit(0))) == []


def test_languages():
    assert languages.expected_language("What is it? Bitte antworte auf Deutsch.") == "de"
    assert languages.expected_language("Combien vaut la masse de l'eau et du sel ?") == "fr"
    assert languages.expected_language("") is None and languages.language_shares(["1 + 1 = 2"]) == {}


# -- splitting ------------------------------------------------------------------
def test_pieces_properties():
    rng = random.Random(3)
    for _ in range(40):
        t = "".join(rng.choice(["ab", " ", ". ", "\n", "。", "word "]) for _ in range(rng.randint(0, 400)))
        cut = splitting.pieces(t, 60, 9)
        assert all(0 < e - s <= 60 for s, e, _ in cut)
        if t:
            assert cut[0][0] == 0 and cut[-1][1] == len(t) and all(b[0] == a[1] - 9 for a, b in zip(cut, cut[1:]))
    assert splitting.pieces(None, 60, 9) == splitting.pieces("", 60, 9) == []
    assert [c for _, _, c in splitting.pieces("x" * 100, 60, 9)] == ["hard", "end"]
    with pytest.raises(ValueError):
        splitting.pieces("abc", 10, 5)


def test_forced_cuts_are_the_long_stretches():
    rng = random.Random(13)
    for _ in range(400):
        t = "".join(rng.choice(["x" * rng.randint(1, 90), " ", ". ", "\n", "。", "?", "w. "]) for _ in range(rng.randint(0, 12)))
        want = max((len(x) for x in re.split(rf"[\s{splitting.END_MARKS}]", t)), default=0) > 60
        assert splitting.is_forced(t, splitting.pieces(t, 60, 9), 60) == want


def test_valley_between_topics():
    a, b = [["oak", "lens", "mass"]] * 8, [["tax", "rate", "loan"]] * 8
    depth = splitting.valley_depths(a + b)
    assert int(np.argmax(depth)) == 7


def test_split_traces(spark):
    limits = spark.createDataFrame([("rt_pieces", "character", 50, 5)], "purpose string, unit string, capacity int, overlap int")
    out = {r["rtrace_id"]: r for r in splitting.split_traces(trace_rows(spark, ODD), limits).collect()}
    assert out["t5"]["forced"] == 1 and out["t6"]["forced"] == 0 and "t4" not in out
    assert splitting.split_traces(trace_rows(spark, ODD), limits.limit(0)).count() == 0


# -- repetition -----------------------------------------------------------------
def test_repeated_share_against_brute_force():
    rng = random.Random(5)
    for _ in range(30):
        toks = [rng.choice("abcde") for _ in range(rng.randint(0, 60))]
        text = " ".join(toks)
        mark = [False] * len(toks)
        for i in range(len(toks) - 2):
            if any(toks[j : j + 3] == toks[i : i + 3] for j in range(i)):
                mark[i : i + 3] = [True] * 3
        want = sum(mark) / len(toks) if toks else 0.0
        assert repetition.repeated_share(text, 3) == pytest.approx(want)


def test_trees_are_monotone_and_accurate():
    rng = np.random.default_rng(2)
    x = rng.random((600, 3))
    y = (x[:, 0] - x[:, 1] + 0.1 * rng.standard_normal(600) > 0).astype(float)
    trees = repetition.fit_trees(x[:400], y[:400], [1, -1, 0])
    assert ((trees.score(x[400:]) > 0.5) == y[400:]).mean() > 0.85
    grid = np.full((50, 3), 0.5)
    grid[:, 0] = np.linspace(0, 1, 50)
    assert (np.diff(trees.score(grid)) >= -1e-12).all()
    grid[:, 0], grid[:, 1] = 0.5, np.linspace(0, 1, 50)
    assert (np.diff(trees.score(grid)) <= 1e-12).all()


def test_repetitive(spark):
    once = "The oak lens is heavy. A copper rod bends slowly. Rain fell on the mill. Nobody saw the saddler leave. Two kites rose above the pier. "
    loop = once + "the Mass of the rod is 5 kg. " * 3 + "THE mass  of the rod is 77 kg. " * 12
    found = {r[0] for r in rows(repetition.repetitive(trace_rows(spark, [*ODD, once, loop, once + once[:30]])))}
    assert "t11" in found and not found & {"t0", "t1", "t2", "t3", "t4", "t10", "t12"}
    assert rows(repetition.repetition(trace_rows(spark, ["x"]).limit(0))) == []


# -- consensus ------------------------------------------------------------------
VOTE = "unit_id bigint, rtrace_id string, unit_start int, unit_end int, completed_by int, label string, labelled_at timestamp, saved_at timestamp, agreement string"
SPANS = "id string, split array<array<int>>, labels array<array<string>>"


def test_label_spelling_and_last_saved(spark):
    v = [(1, "t", 0, 10, a, label, T0, T0 + dt.timedelta(seconds=k), "x") for k, (a, label) in enumerate([(2, "self checking"), (2, "SELF_CHECKING "), (3, "Fact Retrieval"), (3, "Self  Checking"), (4, None), (4, "nonsense"), (None, "Fact Retrieval")])]
    votes = spark.createDataFrame([*v, *v], VOTE)
    none = spark.createDataFrame([], SPANS)
    ha = spark.createDataFrame([("t", [[0, 9], [9, 30]], [["Self Checking"], ["Plan Generation"]]), ("t", [[0, 9], [9, 30]], [["Self Checking"], ["Plan Generation"]]), (None, None, None), ("u", [[None, 3]], [["Self Checking"]])], SPANS)
    got = rows(consensus.all_votes(votes, {1: ha, 8: none}))
    assert got == [(1, 1, 6), (1, 2, 6), (1, 3, 6)]
    units, annotators = consensus.consensus(votes, {1: ha, 8: none}, 3)
    assert [(r["unit_id"], r["label"]) for r in units.collect()] == [(1, "Self Checking")]
    assert annotators.count() == 3
    empty, nobody = consensus.consensus(votes.limit(0), {1: none, 8: none}, 2)
    assert empty.count() == nobody.count() == 0


def test_reliability_finds_careful_annotators(spark):
    rng = random.Random(4)
    care = {2: 0.95, 3: 0.9, 4: 0.6, 5: 0.3, 6: 0.0}
    truth, v = {}, []
    for u in range(400):
        truth[u] = rng.randrange(8)
        for a in rng.sample(sorted(care), 4):
            label = truth[u] if rng.random() < care[a] else rng.randrange(8)
            v.append((u, f"t{u % 9}", u * 10, u * 10 + 9, a, consensus.LABELS[label], T0, T0, "x"))
    none = spark.createDataFrame([], SPANS)
    units, annotators = consensus.consensus(spark.createDataFrame(v, VOTE), {1: none, 8: none})
    r = {x["annotator"]: x["reliability"] for x in annotators.collect()}
    assert r[2] > r[4] > r[5] and abs(r[6]) < 0.25 and abs(r[2] - 0.95) < 0.12
    assert np.mean([consensus.LABELS[truth[x["unit_id"]]] == x["label"] for x in units.collect()]) > 0.9


# -- packing --------------------------------------------------------------------
def test_packing(spark):
    rng = np.random.default_rng(0)
    sizes = rng.integers(0, 1000, 3000)
    container, position, n = packing.pack(sizes, 1024)
    placed = sizes > 0
    load = np.bincount(container[placed], weights=sizes[placed], minlength=n)
    assert load.max() <= 1024 and (container[~placed] == -1).all() and len(set(zip(container[placed], position[placed]))) == placed.sum()
    assert n <= 1.08 * np.ceil(sizes.sum() / 1024)


def test_filling(spark):
    docs = spark.createDataFrame([(1, "short text", 7), (2, "word " * 500, 7), (3, None, 7), (4, "", 7), (None, "x", 7), (5, "<|endoftext|> ok", 7), (5, "<|endoftext|> ok", 7)], "doc_id bigint, text string, container int")
    limits = spark.createDataFrame([("doc_containers", "token", 100, None)], "purpose string, unit string, capacity int, overlap int")
    out = packing.fill_containers(docs, limits).toPandas()
    assert out.groupby("container").n_tokens.sum().max() <= 100 and set(out.doc_id) == {1, 2, 5} and (out.doc_id == 5).sum() == 1
    assert out[out.doc_id == 2].n_tokens.sum() == packing.count_tokens("word " * 500, packing.tokenizer_path())
    assert packing.fill_containers(docs, limits.limit(0)).count() == 0 and packing.fill_containers(docs.limit(0), limits).count() == 0


def test_long_texts_are_counted_in_chunks(monkeypatch):
    text = "Some words, 123 numbers and ünïcode 中文 follow.  Double  spaces too. " * 40
    whole = packing.count_tokens(text, packing.tokenizer_path())
    monkeypatch.setattr(packing, "CHUNK", 97)
    assert packing.count_tokens(text, packing.tokenizer_path()) == whole


# -- leaks ----------------------------------------------------------------------
ITEM = "Lerpelet the cooper, who keeps 49 anvils in a kiln room, trades 11 of them for ochre compasses with Wexlisk of Ravtine. Nobody told Morvathet that tiverous flutes shrink by 37 percent every 49 days in Fenvatho. Show every step and give the final value with two decimals."
STOCK = "Show every step and give the final value with two decimals."
OTHER = "Each marbles weighs 138.9 N until Ravdrisa soaks it in untuned for 12 hours near the old harbour of Drolenet and sells it there. " + STOCK
ZH = "在Wexsior的仓库里一共数出五十八只木箱，其中三十六只装着旧书，剩下的全部装着灯笼和风筝，傍晚以前必须运到北边的山谷。"


def test_leaks(spark):
    words = ITEM.split()
    exact = " ".join(words[3:26])
    near = words[2:40]
    for k in (6, 17, 28):
        near[k] = "other"
    docs = {
        1: "Before it. " + exact.upper().replace(" ", "\n> ") + " after it.", 2: "Well " + " ".join(near) + " then.", 3: "Only " + " ".join(words[3:15]) + " here.",
        4: "Text. " + STOCK + " More text follows here.", 5: "前面。" + ZH[5:45] + "后面。", 6: "前面。" + ZH[5:25] + "后面。", 7: None, 8: "", 9: "x " * 5000,
    }
    table = spark.createDataFrame([(k, v, "z") for k, v in docs.items()] + [(None, ITEM, "z")], "doc_id bigint, text string, item_id string")
    items = spark.createDataFrame([(10, ITEM), (10, ITEM), (11, OTHER), (12, ZH), (13, "Short item. " + STOCK), (14, OTHER.replace("marbles", "kites")), (15, None), (None, ITEM), (16, "")], "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]): r["replaced"] for r in leaks.leaks(table, items).collect()}
    assert set(got) == {(1, 10), (2, 10), (5, 12)} and got[1, 10] == 0 and got[2, 10] == 3
    for block in (1, 2, 3):
        assert {(r["doc_id"], r["item_id"]): r["replaced"] for r in leaks.leaks(table, items, block=block).collect()} == got
    assert leaks.leaks(table, items.limit(0)).count() == 0 and leaks.leaks(table.limit(0), items).count() == 0


def test_leaks_against_brute_force():
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(40)]
    text = " ".join(rng.choice(vocab) for _ in range(60)) + "."
    items, terms = leaks.read_items([(1, text)])
    item = items[0]
    for _ in range(40):
        a = rng.randrange(0, 35)
        n = rng.randrange(12, 25)
        doc = [rng.choice(vocab) for _ in range(15)] + text.rstrip(".").split()[a : a + n] + [rng.choice(vocab) for _ in range(15)]
        ids = np.array([terms.get(w, -1) for w in doc], dtype=np.int32)
        best, words = 0, text.rstrip(".").split()
        for i in range(len(doc)):
            for j in range(len(words)):
                k = 0
                while i + k < len(doc) and j + k < len(words) and doc[i + k] == words[j + k]:
                    k += 1
                best = max(best, k)
        if best >= leaks.WORDS:
            df = np.ones(len(terms), dtype=np.int64)
            found = np.unique([x[0] for x in leaks.choose_anchors(items, df)])
            assert len(leaks.find_pairs(ids, found, len(terms))[0]) >= 2
            assert leaks.passages(item, ids, [15 - a])


@pytest.mark.parametrize("copies", [1, 8, 9, 30])
def test_leaks_of_a_passage_that_stands_often_in_a_document(copies):
    words = [f"w{i}" for i in range(60)]
    items, terms = leaks.read_items([(1, " ".join(words))])
    passage = [*words[20:32], "other", *words[33:44]]
    doc = [w for k in range(copies) for w in [*passage, *["x"] * (30 + k)]]
    ids = np.array([terms.get(w, -1) for w in doc], dtype=np.int32)
    offsets = [k - 20 for k in range(len(doc)) if doc[k] == "w20"]
    assert len(offsets) == copies and max(leaks.passages(items[0], ids, offsets)) == (20, 44, 1)


def test_leaks_behind_many_copies_of_a_sentence_of_the_item():
    words = [f"w{i}" for i in range(60)]
    items, terms = leaks.read_items([(1, " ".join(words))])
    sentence = words[26:32]
    doc = [w for k in range(12) for w in [*sentence, *["x"] * (30 + k)]] + [*words[20:32], "other", *words[33:44]]
    ids = np.array([terms.get(w, -1) for w in doc], dtype=np.int32)
    offsets = [k - 26 for k in range(len(doc)) if doc[k] == "w26"]
    assert (20, 44, 1) in leaks.passages(items[0], ids, offsets)


@pytest.mark.parametrize("replaced", [0, 1])
def test_leaks_that_run_into_a_stock_sentence(replaced):
    items, terms = leaks.read_items([(1, ITEM), (2, OTHER), (3, OTHER.replace("marbles", "kites"))])
    words = leaks.tokens(ITEM)
    passage = words[-(11 + 12) :]
    if replaced:
        passage[5] = "other"
    ids = np.array([terms.get(w, -1) for w in ["before", *passage, "behind"]], dtype=np.int32)
    found = leaks.passages(items[0], ids, [1 - (len(words) - len(passage))])
    assert max(found, default=None) == (len(words) - len(passage), len(words), replaced)
    assert not leaks.passages(items[0], np.array([terms[w] for w in words[-11:]], dtype=np.int32), [11 - len(words)])


def test_stock_sentences_are_counted_over_all_blocks(spark):
    long = "Write down every step of the whole way and name each unit that you use before you give the final value with two decimals."
    items = spark.createDataFrame([(k, f"The {w} weighs {k} kg in the old harbour. {long}") for k, w in enumerate(["rod", "lens", "disc"])], "item_id bigint, text string")
    table = spark.createDataFrame([(1, "Before it. " + long + " Behind it.")], "doc_id bigint, text string")
    assert leaks.leaks(table, items, block=1).count() == leaks.leaks(table, items).count() == 0


# -- quality --------------------------------------------------------------------
PROSE = "The old mill stands by the river, and nobody knows who built it. It was sold twice before the war. We have seen the papers that the owner kept in a box."


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        (PROSE, "prose"), ("Falta calcular la longitud de la cuerda.", "prose"), ("Это не может быть верно! Да.".encode().decode("latin-1"), "junk"), ("यह सही नहीं है।".encode().decode("latin-1"), "junk"), (PROSE.replace(", ", ",\n").replace(". ", ".\n"), "prose"), ("结果会不会依赖压强？这不可能是对的！", "prose"), ("यह सही नहीं हो सकता! अब गणना करते हैं।", "prose"),
        ("- oak lens\n- copper rod\n  - zinc disc\n- tin", "list"), ("Oak lens\ncopper rod\nnet drag of zinc disc\nVelwick", "list"), ("[x] split oak lens\n[ ] check rod\n[ ] label disc", "list"), ("rod, 4, 17\nlens, 99, 103\ndisc, 8", "list"), ("Rod ....... 4\nOak lens ..... 17", "list"),
        ("a | b | c\n|---|---|---|\n| 1 | 2 | kg |\n| 3 | 4 | mm |", "table"), ("mass,drag,flux\n1,2,kg\n3.5,B16,mm", "table"), ("mass\tdrag\n1\t2\n3\t4", "table"), ("\\begin{tabular}{rr}\n1 & 2 \\\\\n3 & kg \\\\", "table"), ("<table>\n<tr><td>1</td><td>kg</td></tr>", "table"), ("mass=1 drag=kg flux=3\nmass=4 drag=mm flux=9", "table"), ("mass      drag      flux\n1         kg        3\n4         mm        9", "table"),
        ("#!?%;>{&+?]%_&|\n&>+:[}~@", "junk"), ("W e k n o w t h a t t h e r o d i s o l d .", "junk"), ("I s a w a b o a t . A n d I s a w i t s i n k , a s a t o y .", "junk"), ("����� ��� 4 ����", "junk"), ("Home > Login | Register | Help\nHome > Login | Register | Help", "junk"), ("00000000  6a f5 6f 2e b2 3b a4 00", "junk"), ("<div class=\"c1\"><span></span></div>", "junk"), ("qwer tzui opas dfgh jklx cvbn mqwe rtzu iopa sdfg hjkl yxcv", "junk"),
    ],
)
def test_kinds(text, kind):
    values = dict(zip(["language", *quality.STATISTICS], quality.statistics(text)))
    assert max(quality.KINDS, key=lambda k: values[f"{k}_share"]) == kind


def test_no_prose(spark):
    docs = [(i, PROSE + f" Number {i} is the last one.", "e", 1) for i in range(300)] + [(900, "- oak lens\n- copper rod\n- zinc disc", None, 1), (901, "mass,drag\n1,2\n3,4\nx,9", None, 1), (902, None, None, 1), (903, "", None, 1), (904, "x" * 9_000, None, 1), (None, "x", None, 1)]
    table = spark.createDataFrame(docs, "doc_id bigint, text string, language string, words int")
    found = dict(rows(quality.no_prose(table, 50)))
    assert found[900] == "list" and "table" in found.get(901, "table") and 902 not in found and 903 not in found and not set(found) & set(range(300))
    scored = quality.scored_statistics(table, 50)
    assert scored.count() == 305 and "prose_share" in scored.where("doc_id = 900").first()["tails"]
    assert quality.no_prose(table.limit(0)).count() == 0


def test_no_prose_where_a_third_of_the_corpus_is_none(spark):
    docs = [(i, PROSE + f" Number {i} is the last one.") for i in range(80)] + [(100 + i, f"- oak lens {i}\n- copper rod\n- zinc disc\n- tin") for i in range(40)]
    table = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert dict(rows(quality.no_prose(table))) == dict.fromkeys(range(100, 140), "list")


def test_sketches_follow_exact_quantiles(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    stats = quality.document_statistics(docs).persist()
    exact = stats.toPandas()
    table = {r["language"]: r for r in quality.quantile_table(stats, 1).collect()}
    en = exact[exact.language == "en"].mean_word
    got = table["en"]["q_mean_word"]
    for level in quality.LEVELS:
        assert abs((en <= got[quality.RANKS.index(level)]).mean() - level) < 0.06


def test_tails_begin_in_the_valley():
    def limits(few, heap):
        q = sorted([heap] * round(200 * few) + [0.97] * (201 - round(200 * few)))
        return quality.tail_limits("prose_share", q, q)[0]

    for few in (0.02, 0.3, 0.6, 0.97):
        assert limits(few, 0.1) == quality.MAIN_PART and limits(few, 0.0) == pytest.approx(0.485) and limits(few, 0.3) == quality.MAIN_PART
    assert quality.tail_limits("prose_share", [0.0] * 201, [0.0] * 201)[0] == quality.MAIN_PART  # nothing but lists
    whole = [0.0] * 60 + [1.0] * 141
    assert quality.tail_limits("prose_share", [0.98] * 201, whole)[0] == quality.MAIN_PART and quality.tail_limits("list_share", [0.0] * 201, [0.0] * 201)[1] < 0.2
    assert quality.tail_limits("mean_word", [4.0] * 201, whole) == pytest.approx((4 - 0.7, 4 + 0.7))


def test_a_corpus_of_lists_alone(spark):
    table = spark.createDataFrame([(i, f"- oak lens {i}\n- copper rod\n- zinc disc\n- tin") for i in range(20)], "doc_id bigint, text string")
    assert dict(rows(quality.no_prose(table))) == dict.fromkeys(range(20), "list")


def test_rules_see_the_whole_line():
    text = f"{'word ' * 60}and see No.{' ' * 90}5 for it. Then go."
    assert [text[s:e] for s, e in sentences.sentence_spans(text)] == [text[:-9], "Then go."]


def test_other_language_is_judged_over_all_letters():
    rng = random.Random(6)
    pool = ["The mass of the old lens is not what it was before.", "Die Masse des Körpers ist nicht groß und der Rest bleibt.", "最后比较等式两边的单位。", "1 + 1 = 2", "Le reste de la masse est dans une boîte avec les autres."]
    for _ in range(200):
        units = [rng.choice(pool) for _ in range(rng.randint(0, 12))]
        shares = languages.language_shares(units)
        want = bool(shares) and shares.get("en", 0) < 0.5 and max(shares.values()) > 0.5
        assert languages.other_language(units, "en", 0.5) == want


def test_trees_alone_find_repetition_in_held_out_texts():
    rng = random.Random(11)
    trees = repetition.train([repetition._made_up(rng) for _ in range(40)])
    x, share = [], []
    for _ in range(120):
        units = [u for u in repetition._SENTENCE.split(repetition._made_up(rng)) if u.strip()]
        text, got = repetition._repeat(units, rng.choice([0.0, rng.uniform(0.05, 0.3), rng.uniform(0.5, 0.9)]), rng)
        x.append(repetition.features(text))
        share.append(got)
    assert ((trees.score(np.array(x)) >= repetition.DECISION) == (np.array(share) >= repetition.SHARE)).mean() >= 0.97


def test_long_texts_are_scored_whole(spark):
    rng = random.Random(12)
    once = repetition._made_up(rng)
    late = " ".join(repetition._made_up(rng) for _ in range(12)) + once * 60
    assert len(late) > repetition.SAMPLE_CHARS
    found = {r[0] for r in rows(repetition.repetitive(trace_rows(spark, [once, late])))}
    assert found == {"t1"}


def test_power_iteration_against_the_dense_matrix(spark):
    rng = random.Random(9)
    care = {a: rng.uniform(0.1, 0.95) for a in range(2, 9)}
    v = []
    for u in range(150):
        truth = rng.randrange(8)
        for a in rng.sample(sorted(care), rng.randint(1, 5)):
            v.append((u, f"t{u % 9}", u * 10, u * 10 + 9, a, consensus.LABELS[truth if rng.random() < care[a] else rng.randrange(8)], T0, T0, "x"))
    none = spark.createDataFrame([], SPANS)
    votes = spark.createDataFrame(v, VOTE)
    _, annotators = consensus.consensus(votes, {1: none})
    got = {r["annotator"]: r["reliability"] for r in annotators.collect()}
    names = sorted(care)
    own = {(u, a): consensus.LABELS.index(label) for u, _, _, _, a, label, *_ in v}
    share = {a: np.bincount([k for (_, b), k in own.items() if b == a], minlength=8) / sum(b == a for _, b in own) for a in names}
    m, d = np.zeros((7, 7)), np.zeros(7)
    for i, a in enumerate(names):
        for j, b in enumerate(names):
            both = [u for u in range(150) if i != j and (u, a) in own and (u, b) in own]
            m[i, j] = sum((own[u, a] == own[u, b]) - share[a] @ share[b] for u in both)
            d[i] += len(both)
    values, vectors = np.linalg.eigh(m / np.sqrt(np.outer(d, d)))
    want = vectors[:, np.argmax(np.abs(values))] / np.sqrt(d)
    have = np.array([got[a] for a in names])
    assert np.allclose(have / np.abs(have).max(), want / want[np.argmax(np.abs(want))] * np.sign(have[np.argmax(np.abs(have))]), atol=1e-4)
    # beyond the bound on annotators, by salted joins and checkpoints
    before, consensus.BROADCAST_ANNOTATORS = consensus.BROADCAST_ANNOTATORS, 0
    try:
        units, far = consensus.consensus(votes, {1: none}, settle="confusions")
        assert all(abs(r["reliability"] - got[r["annotator"]]) < 1e-6 for r in far.collect()) and units.count() == 150
    finally:
        consensus.BROADCAST_ANNOTATORS = before
    with pytest.raises(ValueError):
        consensus.consensus(votes, {1: none}, settle="dice")


def test_runs_against_brute_force():
    rng = np.random.default_rng(3)
    items, _ = leaks.read_items([(1, " ".join(f"w{k}" for k in rng.integers(0, 3, 40))), (2, "w1 w2 w0"), (3, "".join("一二三"[k] for k in rng.integers(0, 3, 30)))])
    runs = leaks.Runs(items)
    for n in (1, 7, 60):
        doc = rng.integers(-1, 6, n).astype(np.int32)
        pairs_ = [(i, o) for i in range(3) for o in range(-45, n + 3)]
        item, off = np.array([i for i, _ in pairs_], dtype=np.int32), np.array([o for _, o in pairs_], dtype=np.int32)
        got = runs.keep(doc, item, off)
        for (i, o), k in zip(pairs_, got):
            need, best, here = (leaks.DENSE_RUN if items[i].dense else leaks.RUN), 0, 0
            for p, t in enumerate(items[i].ids):
                here = here + 1 if 0 <= p + o < n and doc[p + o] == t else 0
                best = max(best, here)
            assert k == (best >= need)


def test_recall_of_planted_passages(spark):
    """Passages of the given items, of all lengths from the least and in every script, with words replaced (not the outer two), in other case, spacing and punctuation."""
    rng = random.Random(21)
    table = spark.read.parquet(f"{DATA}/eval_items.parquet").select("item_id", "text").where("text IS NOT NULL")
    items, _ = leaks.read_items(sorted((r["item_id"], r["text"]) for r in table.collect()), {r["item_id"]: set(r["stock"]) for r in leaks._stock_sentences(table).collect()})
    texts = {r["item_id"]: leaks._HIDDEN.sub("", r["text"]) for r in table.collect()}
    filler = [w for r in spark.read.parquet(f"{DATA}/documents.parquet").where("text IS NOT NULL").limit(60).collect() for w in r["text"].split()]
    docs, planted = [], []
    for n, item in enumerate(rng.choice(items) for _ in range(700)):
        spans = [m.span() for m in leaks._TOKEN.finditer(texts[item.item_id])]
        if len(spans) != len(item.ids):
            continue
        least = leaks.CHARACTERS if item.dense else leaks.WORDS
        start = rng.randrange(len(spans))
        while start > 0 and not item.dense and item.words[start - 1] == item.words[start]:
            start -= 1  # whole words
        end, size = start, least + rng.randrange(15)
        while end < len(spans) and not (item.long_enough(start, end + 1) and (item.dense or item.words[end] - item.words[start] + 1 >= size) and (end + 1 == len(spans) or item.dense or item.words[end + 1] != item.words[end])):
            end += 1
        if end == len(spans):
            continue
        words = texts[item.item_id][spans[start][0] : spans[end][1]]
        if not item.dense:
            words = words.split()
            for k in range(rng.randrange(4), len(words) - 1, rng.randrange(7, 12)):
                if rng.random() < 0.6 and k:
                    words[k] = "replacedword"
            words = "".join(w.strip(",;") + rng.choice([" ", "  ", "\n> ", ", "]) for w in words)
            words = rng.choice([str, str.upper, str.lower])(words)
        at = [rng.choice(filler) for _ in range(40)]
        docs.append((n, " ".join(at) + "\n" + words + "\n" + " ".join(reversed(at))))
        planted.append((n, item.item_id))
    assert len(planted) > 300
    got = {(r["doc_id"], r["item_id"]) for r in leaks.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), table).collect()}
    recall = sum(p in got for p in planted) / len(planted)
    assert recall >= 0.97
