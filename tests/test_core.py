"""Golden values, properties and odd inputs of the core operators."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from spanloom import partitions
from spanloom.functions import arrays
from spanloom.operators import coherence, engines, fusion, intervals, metrics, nested, search, series, units
from spanloom.sources import annotation_tool, gold, store
from spanloom.streaming import resume
from tests.conftest import DATA, rows

SPAN = "array<struct<s:int,e:int>>"


def spans(spark, *all_spans):
    return spark.createDataFrame([(1, [list(x) for x in all_spans])], f"id int, all_spans array<{SPAN}>")


def texts(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, text string").withColumn("n", F.length("text"))


def of(df, column="spans"):
    return [(x[0], x[1]) for x in df.first()[column]]


# -- engines --------------------------------------------------------------------
@pytest.mark.parametrize(
    ("delimiter", "text", "want"),
    [
        ("\n\n", "", [(0, 0)]), ("\n\n", "\n", [(0, 1)]), ("\n\n", "\n\n", [(2, 2)]), ("\n\n", "\n\nabc", [(2, 5)]), ("\n\n", "abc\n\n", [(0, 5), (5, 5)]), ("\n\n", "\n\n\n\n", [(2, 4), (4, 4)]),
        ("\n\n", "\n\n\na", [(2, 4)]), ("\n\n", "a\n\n\nb", [(0, 3), (3, 5)]), ("\n", "\na\n", [(1, 3), (3, 3)]),
    ],
)
def test_delimiter_cuts(spark, delimiter, text, want):
    assert of(engines.at_delimiter(texts(spark, [text]), delimiter)) == want


def test_engines_on_odd_texts(spark):
    df = texts(spark, [None, "", "Only. Therefore this! Wait\n", "🙂 so ü"])
    marked = {r["id"]: r["spans"] for r in engines.at_markers(df).select("id", "spans").collect()}
    assert marked[0] is None and marked[1] == [] and [tuple(x) for x in marked[2]] == [(0, 6), (6, 22), (22, 27)]
    assert [tuple(x) for x in engines.every(df, 4).where("id = 3").first()["spans"]] == [(0, 4), (4, 6)]
    for f in (units.sentence_units, units.clause_units, units.micro_merged):
        got = {r["id"]: r["units"] for r in f(df).select("id", "units").collect()}
        assert not got[0] and not got[1] and got[2][0][0] == 0 and got[2][-1][1] == 27
    masked = {r["id"]: (r["n_blocks"], r["masked"]) for r in units.mask(texts(spark, ["a $x.y$ `b` $$c\nd$$", "", "none"])).collect()}
    assert masked == {0: (3, "a xxxxx xxx xxxxxxx"), 1: (0, ""), 2: (0, "none")}


def test_label_runs(spark):
    u = [(0, 5, "x"), (5, 9, "x"), (9, 14, "y"), (14, 20, "y"), (20, 25, "x")]
    df = spark.createDataFrame([(1, 25, u)], "id int, n int, units array<struct<s:int,e:int,label:string>>")
    assert [tuple(x) for x in engines.label_runs(df).first()["spans"]] == [(0, 9, "x"), (9, 20, "y"), (20, 25, "x")]
    assert [tuple(x) for x in engines.absorbed_runs(df).first()["spans"]] == [(0, 9, "x"), (9, 25, "y")]
    again = engines.label_runs(engines.label_runs(df).drop("units").withColumnRenamed("spans", "units"))
    assert [tuple(x) for x in again.first()["spans"]] == [(0, 9, "x"), (9, 20, "y"), (20, 25, "x")]


def test_clean_offsets(spark):
    df = spark.createDataFrame([(1, 30, [(2, 8), (10, 15), (20, 25)]), (2, 30, [(4, 9)])], f"id int, n int, spans {SPAN}")
    got = {r["id"]: [tuple(x) for x in r["spans"]] for r in engines.clean(df).collect()}
    assert got == {1: [(2, 10), (10, 20), (20, 30)], 2: [(0, 30)]}


def test_context_sentinels_and_replies(spark):
    df = spark.createDataFrame([(1, ["a", "b", "c", "d"])], "id int, units array<string>")
    assert [tuple(x) for x in engines.with_context(df).first()["contexts"]] == [("[START OF TRACE]", "a", "c"), ("a", "b", "d"), ("a", "c", "d"), ("b", "d", "[END OF TRACE]")]
    r = spark.createDataFrame([('{"label": "fact"}', "so [[0, 3], [3, 9]] ok"), ("none", "[1, 4]"), (None, "broken [")], "reply string, offsets string")
    assert [tuple(x) for x in r.select(engines.reply_label("reply"), engines.reply_pairs("offsets")).collect()] == [("fact", [[0, 3], [3, 9]]), (None, [[1, 4]]), (None, None)]


# -- fusion ---------------------------------------------------------------------
A, B, C = [(0, 5), (5, 10), (10, 20)], [(0, 2), (2, 6), (6, 15), (15, 20)], [(0, 5), (5, 15), (15, 20)]


def test_fusion_golden(spark):
    df = spans(spark, A, B, C)
    assert df.select(F.expr(fusion.flattened())).first()[0] == [0, 2, 5, 6, 10, 15, 20]
    assert of(fusion.union(df), "fused") == [(0, 2), (2, 5), (5, 6), (6, 10), (10, 15), (15, 20)]
    assert of(fusion.intersect(df), "fused") == [(0, 20)]
    assert of(fusion.voting(df), "fused") == [(0, 5), (5, 15), (15, 20)]
    assert of(fusion.fuzzy(df), "fused") == [(0, 2), (2, 5), (5, 10), (10, 15), (15, 20)]
    assert of(fusion.graph(df, ["id"]), "fused") == [(0, 5), (5, 15), (15, 20)]
    empty = spans(spark)
    for f in fusion.ALIGNERS.values():
        assert f(empty).first()["fused"] == []
    assert fusion.best_path([]) == []


def test_label_fusion_golden():
    fused = [(0, 5), (5, 6), (6, 10), (10, 15), (15, 20)]
    labelled = [[(s, e, x) for (s, e), x in zip(p, q)] for p, q in ((A, "ABC"), (B, "aBCD"), (C, "ABC"))]
    assert fusion.fused_labels(fused, labelled, "concat") == ["A+B+a", "B", "B+C", "B+C", "C+D"]
    assert fusion.fused_labels(fused, labelled) == ["A", "B", "B", "C", "C"]
    assert fusion.fused_labels([(0, 5)], [[(0, 5, "UNK")], [(0, 5, None)]]) == ["UNK"]
    with pytest.raises(ValueError):
        fusion.fused_labels(fused, labelled, "other")


def test_fusion_properties(spark):
    rng = random.Random(2)

    def tiling():
        cuts = sorted(rng.sample(range(1, 40), rng.randint(0, 8)))
        return list(zip([0, *cuts], [*cuts, 40]))

    data = [(i, [tiling() for _ in range(3)]) for i in range(25)]
    df = spark.createDataFrame(data, f"id int, all_spans array<{SPAN}>")
    got = {name: {r["id"]: [tuple(x) for x in r["fused"]] for r in f.select("id", "fused").collect()} for name, f in (("u", fusion.union(df)), ("i", fusion.intersect(df)), ("v", fusion.voting(df)), ("all", fusion.voting(df, 3)), ("g", fusion.graph(df, ["id"])))}
    for i, segs in data:
        ends = {k: {e for _, e in got[k][i]} for k in got}
        assert got["all"][i] == got["i"][i] and ends["v"] <= ends["u"] and ends["g"] <= ends["u"]
        for k in got:
            assert got[k][i][0][0] == 0 and got[k][i][-1][1] == 40 and all(a[1] == b[0] for a, b in zip(got[k][i], got[k][i][1:]))
        weight = {}
        for seg in segs:
            for x in seg:
                weight[x] = weight.get(x, 0) + 1
        best = {0: 0}
        for b in sorted({x for s in weight for x in s}):
            best[b] = max([best[s] + w for (s, e), w in weight.items() if e == b], default=0)
        assert sum(weight.get(x, 0) for x in got["g"][i]) == best[40]


# -- metrics --------------------------------------------------------------------
def labels_of(spans_, n):
    out = np.zeros(n, dtype=int)
    for i, (s, e) in enumerate(spans_):
        out[s:e] = i + 1
    return out


def test_metrics_against_brute_force(spark):
    rng = random.Random(7)
    data = []
    for i in range(40):
        n = rng.randint(5, 60)

        def tiling(n=n):
            cuts = sorted(rng.sample(range(1, n), rng.randint(0, min(6, n - 1))))
            return list(zip([0, *cuts], [*cuts, n]))

        data.append((i, n, tiling(), tiling()))
    df = spark.createDataFrame(data, f"id int, n int, gold {SPAN}, pred {SPAN}")
    got = {r["id"]: r for r in metrics.evaluate(df, ["id"]).collect()}
    for i, n, g, p in data:
        r = got[i]
        k = max(1, round(n / len(g) / 2))
        a, b = labels_of(g, n), labels_of(p, n)
        if n > k:
            assert r["p_k"] == pytest.approx(np.mean([(a[j] == a[j + k]) != (b[j] == b[j + k]) for j in range(n - k)]))
            ia, ib = (np.diff(x) != 0 for x in (a, b))
            assert r["window_diff"] == pytest.approx(np.mean([ia[j : j + k].sum() != ib[j : j + k].sum() for j in range(n - k)]))
        gb, pb = {e for _, e in g[:-1]}, {e for _, e in p[:-1]}
        hit = len(gb & pb)
        assert r["precision"] == pytest.approx(hit / len(pb) if pb else 0) and r["recall"] == pytest.approx(hit / len(gb) if gb else 1)
        if gb and pb:
            m1 = sum(any(abs(x - y) <= 3 for y in pb) for x in gb) / len(gb)
            m2 = sum(any(abs(x - y) <= 3 for y in gb) for x in pb) / len(pb)
            assert r["b_score"] == pytest.approx(2 * m1 * m2 / (m1 + m2) if m1 + m2 else 0)
            assert r["displacement"] == pytest.approx(np.mean([min(abs(x - y) for y in pb) for x in gb]))
        else:
            assert r["b_score"] == (1.0 if not gb and not pb else 0.0) and r["displacement"] == float("inf")
        iou = np.mean([max(len(set(range(*x)) & set(range(*y))) / len(set(range(*x)) | set(range(*y))) for y in p) for x in g])
        assert r["mean_iou"] == pytest.approx(iou)
    same = metrics.evaluate(df.withColumn("pred", F.col("gold")), ["id"]).collect()
    assert all(r["b_score"] == 1 and r["density_jsd"] == pytest.approx(0) and r["mean_dice"] == pytest.approx(1) for r in same)


def test_alpha_and_names(spark):
    items = spark.createDataFrame([(2, 2), (0, 2), (1, 2), (2, 2), (1, 1)], "n1 int, m int")
    # pairs: observed 2 * 1 / 8; expected 2 * 5 * 3 / (8 * 7)
    assert metrics.binary_alpha(items).first()[0] == pytest.approx(1 - (2 / 8) / (30 / 56))
    assert metrics.binary_alpha(items.where("m = 1")).first()[0] is None
    df = spark.createDataFrame([("Newline_Surprisal_Fuzzy_clause",)], "x string")
    assert df.select(F.expr(metrics.families("x")), F.expr(metrics.aligner("x"))).first() == ("HP", "fuzzy")
    assert store.experiment_name(["a"], None, "sent") == "a_sent" and store.experiment_name(["a", "b"], "Voting", "sent") == "a_b_Voting_sent"
    with pytest.raises(ValueError):
        store.experiment_name(["a", "b"], None, "sent")


# -- series, folds --------------------------------------------------------------
def test_score_series_threshold(spark):
    scores = [1, 2, 3, 4, 5, 4, 3, 2, 1, 0]
    toks = ["a", "a", ".", "a", ".", "a", ".", "a", "a", "a"]
    df = spark.createDataFrame([("t", i, toks[i], i, float(x)) for i, x in enumerate(scores)], "id string, tok_idx int, token string, char_s int, score double")
    found = series.candidates(df, "id", "score", 2)
    assert [(r["tok_idx"], r["delta"]) for r in found.orderBy("tok_idx").collect()] == [(3, 2.0), (5, -1.0), (7, -2.0)]
    assert [r["b"] for r in series.threshold_boundaries(found, "id", 0.5).collect()] == [7]


def test_scores_by_lookup_and_by_join_are_the_same(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    near, far = (series.bigram_scores(docs, "doc_id", rows=r) for r in (1 << 20, 0))
    packed = [rows(x.select("doc_id", F.md5(F.to_json("tokens")), *(F.expr(f"round(aggregate({c}, 0D, (t, v) -> t + v), 6)") for c in series.SCORES)).where("size(tokens) > 0")) for x in (near, far)]
    assert packed[0] == packed[1] and packed[0]
    assert series.bigram_scores(docs.limit(0), "doc_id").count() == 0
    table = near.select("doc_id", F.posexplode(F.arrays_zip("tokens", "gap")).alias("tok_idx", "z")).select("doc_id", "tok_idx", F.col("z.tokens").alias("token"), F.col("z.gap").alias("gap"))
    table = table.withColumn("char_s", (F.sum(F.length("token")).over(Window.partitionBy("doc_id").orderBy("tok_idx")) - F.length("token")).cast("int"))
    want = rows(series.forced_boundaries(table, "doc_id").select("doc_id", "b"))
    got = rows(series.decided(near, "doc_id", "gap", series.at_forced()).select("doc_id", F.explode("bs")))
    assert got == want


def test_long_texts_in_linear_time(spark):
    import time

    n = 100_000
    df = spark.createDataFrame([("ab. " * n,)], "text string").withColumn("n", F.length("text"))
    began = time.perf_counter()
    out = units.micro_merged(df, words=1, chars=1)
    runs = engines.label_runs(out.withColumn("units", F.transform("units", lambda u: F.struct(u["s"], u["e"], F.when(u["s"] % 8 == 0, "x").alias("label")))))
    assert runs.select(F.size("spans")).first()[0] == n
    both = engines.at_delimiter(df, " ").withColumnRenamed("spans", "gold")
    both = units.sentence_units(both).withColumnRenamed("units", "pred")
    scores = metrics.evaluate(both, ["n"]).first()
    assert scores["b_score"] > 0.999 and scores["mean_iou"] > 0.9
    fused = fusion.voting(both.select(F.array("gold", "pred", "gold").alias("all_spans")))
    assert fused.select(F.size("fused")).first()[0] >= n
    assert time.perf_counter() - began < 40


def test_array_kernels_against_brute_force(spark):
    rng = random.Random(17)
    data = []
    for i in range(120):
        a, b = (None if rng.random() < 0.05 else [rng.randint(0, 30) for _ in range(rng.choice([0, 1, 2, 7]))] for _ in range(2))
        own = sorted((s, s + rng.randint(0, 6)) for s in (rng.randint(0, 30) for _ in range(rng.choice([0, 1, 3, 8]))))
        data.append((i, a, b, own))
    df = spark.createDataFrame(data, f"id int, a array<int>, b array<int>, spans {SPAN}")
    out = df.select("id", arrays.nearest("a", "b").alias("near"), arrays.merged_spans("spans").alias("m"), arrays.overlap_merged_spans("spans").alias("o"), arrays.tiled_spans("a").alias("t"), arrays.frequent(F.array_sort("a"), F.lit(2)).alias("f"), arrays.cluster_heads(F.array_sort("a"), F.lit(3)).alias("h"))
    got = {r["id"]: r for r in out.collect()}
    for i, a, b, own in data:
        r = got[i]
        for name, apart in (("m", lambda s, e: s > e), ("o", lambda s, e: s >= e)):
            want = []
            for s, e in own:
                if not want or apart(s, want[-1][1]):
                    want.append([s, e])
                want[-1][1] = max(want[-1][1], e)
            assert [list(x) for x in r[name]] == want
        if a is None:
            assert r["near"] is None and r["t"] is None and r["f"] is None and r["h"] is None
            continue
        assert r["near"] == [min((abs(x - y) for y in b or []), default=None) for x in a]
        assert [tuple(x) for x in r["t"]] == [(sum(a[:k]), sum(a[: k + 1])) for k in range(len(a))] and r["f"] == sorted({x for x in a if a.count(x) > 1})
        heads = []
        for x in sorted(a):
            if not heads or x - heads[-1] > 3:
                heads.append(x)
        assert r["h"] == heads


def test_prompts_and_examples(spark, tmp_path):
    from spanloom.sources import prompts

    (tmp_path / "p.json").write_text('{"a": "x {T}", "b": "y"}')
    assert rows(prompts.read_prompts(spark, str(tmp_path / "p.json"))) == [("a", "x {T}"), ("b", "y")]
    assert prompts.examples(spark).count() == 2


def test_folds():
    v = np.array([(1, 0), (1, 0), (0, 1), (1, 0), (0, 1), (0, 1)], dtype=float)
    assert coherence.semantic_shift(v) == [(0, 3), (4, 5)] and coherence.semantic_shift(v[:0]) == []
    assert coherence.entailment_fold(["oak lens", "oak lens", "tax", "tax"]) == [(0, 1), (2, 3)]
    assert coherence.entailment_fold([]) == []
    assert coherence.topic_labels(["Therefore it is."]) == ["conclusion"] and coherence.topic_labels([]) == []
    assert len(set(coherence.topic_labels(["oak lens mass"] * 60 + ["tax rate loan"] * 60, k=2))) == 2
    assert series.step_turns(np.array([1.0]), np.array([5])) == []
    assert series.step_turns(np.array([0, 0, 0, 0, 9, 9, 9, 9.0]), np.arange(10, 90, 10)) != []


def test_labels_and_tables(spark):
    labels = coherence.zero_shot_labels(["We plan the planning.", "A fact is a fact", ""], coherence.LABEL_SETS["reasoning_flow"])
    assert labels == ["Planning", "Fact", "Context"]
    assert coherence.labelled_runs(["a", "a", "b"], [(0, 2), (2, 5), (5, 6)]) == [(0, 5, "a"), (5, 6, "b")] and coherence.labelled_runs([], []) == []
    df = spark.createDataFrame([("newline_sent", 0.5, 16.0), ("newline_clause", 0.25, 81.0)], "exp_id string, score double, ptime double")
    assert [(r["family"], r["aligner"], round(r["x"], 6)) for r in metrics.score_time(df).collect()] == [("H", "none", 2.0), ("H", "none", 3.0)]
    assert rows(metrics.by_unit(df)) == [("newline", 0.5, 0.25)]
    b = spark.createDataFrame([([5, 9], [6]), ([], [1]), ([], [])], "gb array<int>, pb array<int>")
    # both boundaries lie near the single other one: precision 2, recall 1
    assert [r[0] for r in b.select(metrics.jitter_similarity()).collect()] == [pytest.approx(4 / 3), 0.0, 1.0]


def test_engines_that_ask():
    text = "One two. Three four! Five six? " * 30
    got = coherence.offset_chunks(text, coherence.sentence_reply)
    assert got[0][0] == 0 and got[-1][1] == len(text) and all(a[1] == b[0] for a, b in zip(got, got[1:]))
    stuck = coherence.offset_chunks(text, lambda _: "no idea")
    assert stuck[-1][1] == len(text) and len(stuck) == -(-len(text) // 300)
    assert coherence.parse_pairs("x [3, 7] y") == [(3, 7)] and coherence.parse_pairs("[[1]]") is None
    groups = coherence.unit_groups(250, lambda a, b: [list(range(i, min(i + 7, b))) for i in range(a, b, 7)])
    assert [x for g in groups for x in g] == list(range(250))
    assert coherence.unit_groups(5, lambda a, b: [[9]]) == [[0, 1, 2, 3, 4]]


# -- intervals ------------------------------------------------------------------
def brute(spans_, n):
    covered = np.zeros(n + 1, dtype=bool)
    for s, e in spans_:
        if s is None or e is None:
            continue
        s, e = min(s, e), max(s, e)
        covered[max(0, s) : max(0, min(e, n))] = True
    out, i = [], 0
    while i < n:
        j = i
        while j < n and covered[j] == covered[i]:
            j += 1
        out.append(("period" if covered[i] else "gap", i, j))
        i = j
    return out


def test_intervals_against_brute_force(spark):
    rng = random.Random(11)
    data, lengths, want = [], [], []
    for i in range(60):
        n = rng.choice([0, 1, 7, 30, 90])
        own = [(rng.choice([None, rng.randint(-5, n + 5)]) if rng.random() < 0.1 else rng.randint(-5, n + 5), rng.randint(-5, n + 5)) for _ in range(rng.randint(0, 9))]
        data += [(f"d{i}", s, e, "x") for s, e in own * 2]
        lengths.append((f"d{i}", n))
        want += [(f"d{i}", *x) for x in brute(own, n)]
    data += [("no length", 1, 2, "x")]
    lengths += [("null", None)]
    got = intervals.periods_and_gaps(spark.createDataFrame(data, "k string, s int, e int, kind string"), spark.createDataFrame(lengths, "k string, n int"), ["k"], block=8)
    assert rows(got) == sorted(want)
    empty = spark.createDataFrame([], "k string, s int, e int")
    assert rows(intervals.periods_and_gaps(empty, spark.createDataFrame([("a", 4)], "k string, n int"), ["k"])) == [("a", "gap", 0, 4)]


# -- nested records -------------------------------------------------------------
def test_nested_records(spark):
    deep = {"id": "n", "label": "l"}
    for _ in range(2000):
        deep = {"children": [deep]}
    payloads = [
        '{"doc_id": "d", "nodes": [{"id": "a", "annotation": "TRUE", "label": ["x", "x", "y"], "children": {"annotation": false}}, 7, {"id": null, "label": null}], "edges": [{"id": "e", "from_node_id": "a", "to_node_id": "b"}]}',
        '{"document": {"title": "t", "nodes": {"id": 5, "annotation": null, "label": []}}}', None, "", "{broken", "[1]", '{"nodes": null}', '{"nodes": [{"id": NaN}]}', json.dumps({"nodes": [deep]}) if False else '{"nodes": []}',
    ]
    df = spark.createDataFrame([(i, p, None, "clash") for i, p in enumerate(payloads)] * 2 + [(None, payloads[0], None, "clash")], "record_id bigint, payload string, received_at timestamp, label string")
    got = rows(nested.labelled_nodes(nested.stored_tables(df)))
    assert got == [(0, "", "0", "a", 1, "x"), (0, "", "0", "a", 1, "y"), (0, "", "2", "", -1, ""), (0, "0", "0/0", "", 0, ""), (1, "", "0", "5", -1, "")]
    tables = {t: x.count() for t, x in nested.stored_tables(df).items()}
    assert tables == {"document": 4, "node": 4, "label": 6, "edge": 1}
    assert nested.labelled_nodes(nested.stored_tables(df.limit(0))).count() == 0


def test_tagged_rows_round_trip(spark, tmp_path):
    raw = spark.read.parquet(f"{DATA}/rf_raw.parquet")
    nested.write_tables(nested.tagged_rows(raw), str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t"))
    nodes = nested.table_of(back, "node")
    children = nodes.where("parent_key <> ''").select("record_id", F.col("parent_key").alias("key"))
    assert children.join(nodes, ["record_id", "key"], "left_anti").count() == 0
    read_back = {t: nested.table_of(back, t) for t in nested.TABLES}
    assert rows(nested.labelled_nodes(read_back).select("record_id", "node_path").distinct()) == rows(nodes.select("record_id", "key"))


def test_rows_that_came_once_stay_where_they_are(spark):
    df = spark.createDataFrame([(1, "a", 5), (1, "b", 7), (2, "c", 1), (2, "c", 1), (3, "d", None), (None, "x", 1)], "k bigint, v string, t int")
    out = partitions.once(df, "k", [F.col("t"), F.col("v")])
    assert rows(out) == [(1, "b", 7), (2, "c", 1), (3, "d", None)] and out.columns == df.columns
    single = df.where("k = 3")
    assert rows(partitions.once(single, "k", [F.col("t")])) == [(3, "d", None)]
    before, partitions.BROADCAST_BYTES = partitions.BROADCAST_BYTES, 0
    try:
        assert rows(partitions.once(df, "k", [F.col("t"), F.col("v")])) == [(1, "b", 7), (2, "c", 1), (3, "d", None)]
    finally:
        partitions.BROADCAST_BYTES = before


@pytest.mark.parametrize("bound", [0, 1 << 20])
def test_joins_stand_hot_keys(spark, bound):
    left = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}" if i % 2 else None) for i in range(600)], "id int, k string")
    right = spark.createDataFrame([("hot", 1), ("k3", 2), ("unused", 3)], "k string, v int")
    before, partitions.BROADCAST_BYTES = partitions.BROADCAST_BYTES, bound
    try:
        inner, outer = (partitions.joined(left, right, ["k"], F.col("id"), how=how).select("id", "k", "v") for how in ("inner", "left"))
        assert inner.count() == 401 and outer.count() == 600
        assert sorted(r["id"] for r in outer.where("v IS NOT NULL").collect()) == sorted(r["id"] for r in inner.collect())
    finally:
        partitions.BROADCAST_BYTES = before


# -- sources, store, streaming, search --------------------------------------------
def test_gold_files(spark, tmp_path):
    doc = {"doc_id": "d", "raw_text": {"question": "q", "response": "abcdef"}, "metadata": {"batch": 1}, "nodes": [{"id": "c", "start": 0, "end": 1, "label": "x", "source": "question"}, {"id": "r", "start": 0, "end": 6, "label": "y", "source": "response"}], "edges": [{"id": "e", "from_node_id": "c", "to_node_id": "r", "label": "l"}]}
    (tmp_path / "d.json").write_text(json.dumps(doc, indent=1))
    g = gold.read_gold(spark, str(tmp_path))
    assert gold.spans(g).first() == ("d", [[0, 6]], ["y"]) and gold.edges(g).count() == 1 and gold.traces(g).first()["rt"] == "abcdef" and gold.samples(g).first()["question"] == "q"


def test_upload_and_boards(spark, tmp_path):
    doc = {"doc_id": "d", "raw_text": {"question": "q", "response": "abcdef"}, "metadata": {"batch": 1}, "nodes": [{"id": "r", "start": 0, "end": 6, "label": "y", "source": "response"}]}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps(doc, indent=1))
    gold.upload(gold.read_gold(spark, str(tmp_path / "in")), str(tmp_path / "out"))
    assert rows(spark.read.parquet(str(tmp_path / "out" / "reasoning_flow_gold.parquet"))) == [("d", [[0, 6]], ["y"])]
    assert spark.read.parquet(str(tmp_path / "out" / "samples.parquet")).first()["question"] == "q"
    scores = spark.createDataFrame([("newline_sent", 1.0, 2.0, "a"), ("newline_sent", 0.0, 4.0, "b"), ("newline_marker_voting_sent", 1.0, 1.0, "a")], "exp_id string, score double, ptime double, domain string")
    assert rows(metrics.board(scores, 2)) == [("newline_sent", 2, 0.5, 3.0)]
    assert rows(metrics.subset_board(scores, "domain")) == [("newline_marker_voting_sent", "a", 1, 1.0), ("newline_sent", "a", 1, 1.0), ("newline_sent", "b", 1, 0.0)]
    assert rows(metrics.single_engines(metrics.board(scores), metrics.board(scores))) == [("newline_sent", 0.5, 0.5)]
    pred = spark.createDataFrame([("x", 10, [(0, 5), (5, 10)], [(0, 5), (5, 10)]), ("y", 10, [(0, 5), (5, 10)], [(0, 10)])], f"exp_id string, n int, gold {SPAN}, pred {SPAN}")
    assert [r["exp_id"] for r in metrics.table(pred, "exp_id").collect()] == ["x", "y"]


def test_annotation_round_trip(spark):
    df = spark.createDataFrame([("d", 'a "b" <c>', [(0, 4), (4, 9)], ["x", "y"])], f"id string, text string, units {SPAN}, labels array<string>")
    assert annotation_tool.boxes(df, "text", "units").first()["html"] == "<div><p>a &quot;b</p><p>&quot; &lt;c></p></div>"
    tasks = annotation_tool.exported_annotations(df, "id", "units", "labels", 8)
    assert rows(annotation_tool.imported(tasks, df.select("id", "units"))) == [("d", 8, 0, 4, ["x"]), ("d", 8, 4, 9, ["y"])]


def test_store_and_stream(spark, tmp_path):
    traces = spark.createDataFrame([("a", "One.\nTwo.", None), ("b", "Three.", None), ("b", "Three.", None)], "id string, rt string, stored_at timestamp")
    path = str(tmp_path / "store")
    engine = lambda df: engines.at_delimiter(df, "\n", "rt")
    assert store.segment(spark, path, traces.where("id = 'a'"), "nl", engine) == 1
    traces.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = resume.resume(spark, str(tmp_path / "in"), path, "nl", engine, str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert rows(store.counts(store.read(spark, path))) == [("nl", 2)] and store.segment(spark, path, traces, "nl", engine) == 0
    store.rename(spark, path, "nl", "lines")
    assert rows(store.counts(store.read(spark, path))) == [("lines", 2)] and store.times(store.read(spark, path)).count() == 1
    assert store.read(spark, str(tmp_path / "none")).count() == 0


def test_search_operators(spark):
    p = search.population(spark, 64, 38)
    assert p.where("mask = 0").count() == 0 and p.count() == 64
    back = search.decoded(p, [str(i) for i in range(38)]).select("mask", "engines").collect()
    assert all(sum(1 << int(e) for e in r["engines"]) == r["mask"] for r in back)
    found = search.search(spark, lambda c: c.withColumn("score", F.bit_count("mask") / 8.0), 8, 12, 3)
    assert found.groupBy("mask", "aligner_idx").count().where("count > 1").count() == 0 and found.count() > 12


def test_search_fuses_like_the_aligners(spark):
    rng = random.Random(23)

    def tiling():
        cuts = sorted(rng.sample(range(1, 40), rng.randint(0, 8)))
        return list(zip([0, *cuts], [*cuts, 40]))

    data = [(i, [tiling() for _ in range(rng.randint(2, 5))]) for i in range(30)]
    df = spark.createDataFrame(data, f"id int, all_spans array<{SPAN}>")
    for name in search.ALIGNERS:
        out = fusion.graph(df, ["id"]) if name == "graph" else fusion.ALIGNERS[name](df)
        got = {r["id"]: sorted({b for x in r["fused"] for b in x}) for r in out.select("id", "fused").collect()}
        for i, segs in data:
            assert search.fused_boundaries(segs, name).tolist() == got[i], name
    with pytest.raises(ValueError):
        search.search(spark, lambda c: c, 8, search.POPULATION + 1, 2)


def test_scorer_against_the_metric(spark):
    rng = random.Random(29)
    texts_ = [([rng.randint(1, 39) for _ in range(rng.randint(0, 5))], [[(0, k), (k, 40)] for k in rng.sample(range(1, 39), 3)]) for _ in range(15)]
    df = spark.createDataFrame(texts_, f"gb array<int>, pool array<{SPAN}>")
    configs = spark.createDataFrame([(m, a) for m in range(1, 8) for a in range(5)], "mask bigint, aligner_idx int")
    got = {(r["mask"], r["aligner_idx"]): r["score"] for r in search.scorer(df, 3)(configs).collect()}
    assert len(got) == 35
    want = df.select(metrics.b_score("gb", "pb").alias("s")) if "pb" in df.columns else df.withColumn("gb", F.array_sort(F.array_distinct("gb"))).withColumn("pb", F.expr("array(pool[1][0].e)")).select(metrics.b_score("gb", "pb").alias("s"))
    assert got[2, 0] == pytest.approx(want.agg(F.avg("s")).first()[0])
