"""Queries of fusion, metrics, agreement and leaderboards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import arrays
from spanloom.operators import engines, fusion, metrics, units
from spanloom.plans import sql
from spanloom.plans.segment_queries import _GOLD, _gold_pairs, texts, traces
from spanloom.tables import read

ENGINES = ["newline", "marker", "every"]


def segmented(df: DataFrame) -> DataFrame:
    """(id, n, nl, mk, ch, all_spans) of the three rule engines, in one pass over the texts."""
    out = engines.at_delimiter(df, "\n").withColumnRenamed("spans", "nl")
    out = engines.at_markers(out).withColumnRenamed("spans", "mk")
    out = engines.every(out, sql.CHUNK).withColumnRenamed("spans", "ch")
    return out.select("id", "n", "nl", "mk", "ch", F.array("nl", "mk", "ch").alias("all_spans"))


def _fused(df: DataFrame) -> DataFrame:
    return units.long(df, ["id"], "fused", "seg_idx").withColumnRenamed("id", "doc_id")


def fuse_flatten(spark: SparkSession, d: str) -> DataFrame:
    flat = units.exploded(segmented(texts(spark, d)), ["id"], F.expr(fusion.flattened()), "idx", "b")
    return flat.withColumnRenamed("id", "doc_id")


def fuse_union(spark: SparkSession, d: str) -> DataFrame:
    return _fused(fusion.union(segmented(texts(spark, d))))


def fuse_intersect(spark: SparkSession, d: str) -> DataFrame:
    return _fused(fusion.intersect(segmented(texts(spark, d))))


def fuse_voting(spark: SparkSession, d: str) -> DataFrame:
    return _fused(fusion.voting(segmented(texts(spark, d))))


def fuse_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    return _fused(fusion.fuzzy(segmented(texts(spark, d)), 40))


def fuse_graph(spark: SparkSession, d: str) -> DataFrame:
    return _fused(fusion.graph(segmented(texts(spark, d)), ["id"]))


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    """Voting's spans and the engines' labelled ones."""
    out = fusion.voting(segmented(texts(spark, d)))
    nl = "transform(nl, x -> named_struct('s', x.s, 'e', x.e, 'label', IF(x.e - x.s < 120, 'short', 'long')))"
    mk = "transform(mk, x -> named_struct('s', x.s, 'e', x.e, 'label', IF(x.s > 0, 'marker', 'UNK')))"
    ch = f"transform(ch, x -> named_struct('s', x.s, 'e', x.e, 'label', IF((x.s div {sql.CHUNK}) % 2 = 0, 'even', 'odd')))"
    return out.withColumn("all_labelled", F.expr(f"array({nl}, {mk}, {ch})"))


def _labels(spark: SparkSession, d: str, mode: str) -> DataFrame:
    out = fusion.label_fusion(_labelled(spark, d), ["id"], mode)
    return units.exploded(out, ["id"], "labelled", "seg_idx", "x").select(F.col("id").alias("doc_id"), "seg_idx", "x.s", "x.e", "x.label")


def fuse_label_majority(spark: SparkSession, d: str) -> DataFrame:
    return _labels(spark, d, "majority")


def fuse_label_concat(spark: SparkSession, d: str) -> DataFrame:
    return _labels(spark, d, "concat")


# -- metrics: lines as gold, markers as prediction ------------------------------
def _rated(spark: SparkSession, d: str, names: list[str]) -> DataFrame:
    pairs = segmented(texts(spark, d).where("n > 0")).select(F.col("id").alias("doc_id"), "n", F.col("nl").alias("gold"), F.col("mk").alias("pred"))
    out = metrics.evaluate(pairs, ["doc_id"], names)
    return out.select("doc_id", *(F.round(F.col(m), 6).alias(m) for m in names))


def m_boundary(spark: SparkSession, d: str) -> DataFrame:
    return _rated(spark, d, ["precision", "recall", "boundary_f1", "bias"])


def m_near(spark: SparkSession, d: str) -> DataFrame:
    return _rated(spark, d, ["b_score", "boundary_cover", "soft_f1", "displacement"])


def m_overlap(spark: SparkSession, d: str) -> DataFrame:
    return _rated(spark, d, ["mean_iou", "mean_dice"])


def m_windows(spark: SparkSession, d: str) -> DataFrame:
    """P_k and WindowDiff of spans made contiguous."""
    pairs = segmented(texts(spark, d).where("n > 0"))
    pairs = engines.clean(engines.clean(pairs, "nl"), "mk").select(F.col("id").alias("doc_id"), "n", F.col("nl").alias("gold"), F.col("mk").alias("pred"))
    return metrics.evaluate(pairs, ["doc_id"], ["p_k", "window_diff"]).select("doc_id", F.round("p_k", 6).alias("p_k"), F.round("window_diff", 6).alias("window_diff"))


def m_density(spark: SparkSession, d: str) -> DataFrame:
    return _rated(spark, d, ["density_jsd"])


def m_intrinsic(spark: SparkSession, d: str) -> DataFrame:
    rows = metrics.with_moments(segmented(texts(spark, d).where("n > 0")).select(F.col("id").alias("doc_id"), F.col("mk").alias("pred")))
    return rows.select("doc_id", *(F.round(F.expr(e), 6).alias(k) if k.endswith(("len", "std")) and k != "min_len" else F.expr(e).alias(k) for k, e in metrics.intrinsic().items()))


def m_alpha(spark: SparkSession, d: str) -> DataFrame:
    """Agreement of three engines on which sentence units end a span, over the whole corpus."""
    both = units.sentence_units(texts(spark, d)).join(segmented(texts(spark, d)).select("id", "nl", "mk", "ch"), "id")
    ends = {c: arrays.nearest(F.transform("units", lambda u: u["e"]), F.transform(c, lambda x: x["e"])) for c in ("nl", "mk", "ch")}
    both = both.withColumns({f"{c}_d": d for c, d in ends.items()})
    votes = F.expr("transform(nl_d, (d, i) -> IF(d = 0, 1, 0) + IF(mk_d[i] = 0, 1, 0) + IF(ch_d[i] = 0, 1, 0))")
    items = units.exploded(both.select("id", votes.alias("votes")), ["id"], "votes", "unit_idx", "n1").select("n1", F.lit(3).alias("m"))
    return metrics.binary_alpha(items).select(F.round("alpha", 6).alias("alpha"))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """(id, a, b, b_score) of the three engines' pairs."""
    rows = segmented(texts(spark, d)).select("id", F.explode(F.expr("array(named_struct('name', 'newline', 'x', nl), named_struct('name', 'marker', 'x', mk), named_struct('name', 'every', 'x', ch))")).alias("e"))
    named = rows.select("id", F.col("e.name").alias("name"), F.col("e.x").alias("spans")).withColumn("b", F.expr(metrics.ends("spans")))
    return metrics.pairwise(named, "id", "name", "b", metrics.b_score("ab", "bb"), "b_score")


def eval_pair_matrix(spark: SparkSession, d: str) -> DataFrame:
    matrix = metrics.agreement_matrix(_pairs(spark, d), "b_score")
    return matrix.select("a", "b", F.round("b_score", 6).alias("b_score"))


def eval_consensus(spark: SparkSession, d: str) -> DataFrame:
    """Mean agreement of all pairs of engines, of each document."""
    return _pairs(spark, d).groupBy(F.col("id").alias("doc_id")).agg(F.round(F.avg("b_score"), 6).alias("consensus"))


def eval_fuzzy_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Greater and mean cover of each pair of engines, and their one-sided similarity, over all documents."""
    rows = segmented(texts(spark, d)).select("id", F.expr(metrics.ends("nl")).alias("gb"), F.expr(metrics.ends("mk")).alias("pb"))
    one, two = metrics.cover("gb", "pb"), metrics.cover("pb", "gb")
    scored = rows.select(F.col("id").alias("doc_id"), one.alias("a"), two.alias("b"), metrics.jitter_similarity().alias("j"))
    return scored.select("doc_id", F.round(F.greatest("a", "b"), 6).alias("optimistic"), F.round((F.col("a") + F.col("b")) / 2, 6).alias("symmetric"), F.round("j", 6).alias("jitter"))


_AGGREGATED = ["boundary_f1", "bias", "b_score"]


def _by_source(spark: SparkSession, d: str) -> DataFrame:
    pairs = segmented(texts(spark, d).where("n > 0")).select(F.col("id").alias("doc_id"), "n", F.col("nl").alias("gold"), F.col("mk").alias("pred"))
    scores = metrics.evaluate(pairs, ["doc_id"], _AGGREGATED).join(read(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return metrics.aggregate_scores(metrics.melted(scores, ["source"], _AGGREGATED), ["source"])


def eval_aggregate(spark: SparkSession, d: str) -> DataFrame:
    return _by_source(spark, d).select("source", "metric", F.round("mean", 9).alias("mean"), F.round("std", 9).alias("std"))


def eval_json(spark: SparkSession, d: str) -> DataFrame:
    """The aggregate as one JSON object per source, in ten thousandths."""
    return metrics.scores_as_json(_by_source(spark, d), "source", 10_000)


# -- leaderboards ---------------------------------------------------------------
def _models(spark: SparkSession, d: str) -> DataFrame:
    """(id, exp_id, mb): boundaries of each experiment's cleaned spans of every trace."""
    rows = segmented(traces(spark, d)).withColumn("voting", F.col("nl"))
    rows = fusion.voting(rows.drop("voting")).withColumnRenamed("fused", "vo")
    named = rows.select("id", "n", F.explode(F.expr("array(named_struct('x', 'newline_sent', 'y', nl), named_struct('x', 'marker_sent', 'y', mk), named_struct('x', 'every_sent', 'y', ch), named_struct('x', 'newline_marker_every_voting_sent', 'y', vo))")).alias("e"))
    spans = engines.clean(named.select("id", "n", F.col("e.x").alias("exp_id"), F.col("e.y").alias("spans")).where("size(spans) > 0"))
    return spans.select("id", "exp_id", F.expr(metrics.ends("spans")).alias("mb"))


def leaderboard_rf(spark: SparkSession, d: str) -> DataFrame:
    """Experiments that cover all gold traces by their mean agreement with the gold."""
    gold = engines.clean(_gold_pairs(spark, d)).select("id", F.expr(metrics.ends("spans")).alias("gb"))
    both = gold.join(_models(spark, d), "id")
    n = gold.count()
    board = both.groupBy("exp_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(metrics.b_score("gb", "mb")), 6).alias("score")).where(F.col("n") == n)
    named = board.withColumn("family", F.expr(metrics.families("exp_id"))).withColumn("aligner", F.expr(metrics.aligner("exp_id")))
    return metrics.ranked(named, "score", "exp_id")


def _human(spark: SparkSession, d: str, name: str, alias: str) -> DataFrame:
    rows = read(spark, d, name).where("id IS NOT NULL AND split IS NOT NULL").dropDuplicates(["id"]).select("id", F.expr("transform(split, p -> named_struct('s', p[0], 'e', p[1]))").alias("spans")).where("size(spans) > 0")
    cleaned = engines.clean(rows.join(traces(spark, d).select("id", "n"), "id"))
    return cleaned.select("id", F.expr(metrics.ends("spans")).alias(alias))


def _humans(spark: SparkSession, d: str) -> DataFrame:
    return _human(spark, d, "thought_anchor_gold_ha", "ha").join(_human(spark, d, "thought_anchor_gold_ve", "ve"), "id")


def human_baseline(spark: SparkSession, d: str) -> DataFrame:
    """Agreement of both annotators on each trace that both have."""
    return _humans(spark, d).select("id", F.round(metrics.b_score("ha", "ve", 10), 6).alias("b_score"))


def _triads(spark: SparkSession, d: str) -> DataFrame:
    """(id, exp_id, score): mean agreement of all pairs of both annotators and the experiment."""
    both = _humans(spark, d).join(_models(spark, d), "id")
    triad = (metrics.b_score("ha", "ve", 10) + metrics.b_score("ha", "mb", 10) + metrics.b_score("ve", "mb", 10)) / 3
    return both.select("id", "exp_id", triad.alias("score"), F.lit(0.0).alias("ptime"))


def leaderboard_subset(spark: SparkSession, d: str) -> DataFrame:
    """The same by the traces' domain."""
    domains = read(spark, d, "rtrace").where("id IS NOT NULL").groupBy("id").agg(F.max("domain").alias("domain")).where("domain IS NOT NULL")
    board = metrics.subset_board(_triads(spark, d).join(domains, "id"), "domain")
    return board.select("exp_id", "domain", "n", F.round("score", 9).alias("score"))


def leaderboard_single(spark: SparkSession, d: str) -> DataFrame:
    """Single engines' agreement with the annotators and with the gold side by side."""
    gold = engines.clean(_gold_pairs(spark, d)).select("id", F.expr(metrics.ends("spans")).alias("gb"))
    flow = gold.join(_models(spark, d), "id").select("exp_id", metrics.b_score("gb", "mb").alias("score"), F.lit(0.0).alias("ptime"))
    both = metrics.single_engines(metrics.board(_triads(spark, d)), metrics.board(flow, gold.count()))
    return both.select("exp_id", F.round("score_0", 9).alias("score_ta"), F.round("score_1", 9).alias("score_rf"))


def leaderboard_ta(spark: SparkSession, d: str) -> DataFrame:
    """Experiments by the mean agreement of all pairs of both annotators and the experiment."""
    board = metrics.board(_triads(spark, d)).select("exp_id", "n", F.round("score", 6).alias("score"))
    return metrics.ranked(board.withColumn("family", F.expr(metrics.families("exp_id"))), "score", "exp_id")


def score_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Quartiles of the documents' agreement between lines and markers, by domain."""
    scores = _rated(spark, d, ["b_score"]).join(read(spark, d, "documents").where("domain IS NOT NULL").select("doc_id", "domain"), "doc_id")
    boxes = metrics.box_stats(scores, "domain", "b_score")
    return boxes.select("domain", "n", *(F.round(c, 6).alias(c) for c in ("low", "q1", "median", "q3", "high")))


def score_density(spark: SparkSession, d: str) -> DataFrame:
    """Kernel density of the same scores."""
    scores = _rated(spark, d, ["b_score"]).join(read(spark, d, "documents").where("domain IS NOT NULL").select("doc_id", "domain"), "doc_id")
    return metrics.kernel_density(scores, "domain", "b_score", 0.05, 100).select("domain", F.round("x", 6).alias("x"), F.round("density", 6).alias("density"))


QUERIES = {
    f.__name__: f
    for f in (
        fuse_flatten, fuse_union, fuse_intersect, fuse_voting, fuse_fuzzy, fuse_graph, fuse_label_majority, fuse_label_concat, m_boundary, m_near, m_overlap, m_windows, m_density, m_intrinsic, m_alpha,
        eval_pair_matrix, eval_consensus, eval_fuzzy_agreement, eval_aggregate, eval_json, leaderboard_rf, leaderboard_ta, leaderboard_subset, leaderboard_single, human_baseline, score_boxes, score_density,
    )
}

# -- SQL ------------------------------------------------------------------------
_ENG = sql.engines(sql.DOCUMENTS)
_BOUNDS = "bd AS (SELECT id, eng, s AS b FROM seg UNION SELECT id, eng, e FROM seg)"
_PAIR = "SELECT id AS doc_id, CAST(row_number() OVER (PARTITION BY id ORDER BY b) - 1 AS INTEGER) AS seg_idx, CAST(b AS INTEGER) AS s, CAST(e AS INTEGER) AS e FROM (SELECT id, b, lead(b) OVER (PARTITION BY id ORDER BY b) AS e FROM {src}) WHERE e IS NOT NULL"
_VOTES = """v AS (SELECT id, b FROM (SELECT id, s AS b FROM seg UNION ALL SELECT id, max(e) FROM seg GROUP BY id, eng) GROUP BY id, b HAVING count(*) >= 2)"""
_LISTS = f"{_ENG},{sql.boundaries('gl', 'nl')},{sql.boundaries('pl', 'mk')}, bp AS (SELECT t.id, t.n, coalesce(gl.b, CAST([] AS INTEGER[])) AS gb, coalesce(pl.b, CAST([] AS INTEGER[])) AS pb, gl.sp AS gs, pl.sp AS ps FROM texts t LEFT JOIN gl ON t.id = gl.id LEFT JOIN pl ON t.id = pl.id WHERE t.n > 0)"
_HIT = "len(list_intersect(gb, pb))"
_PR = f"CASE WHEN len(pb) = 0 THEN 0.0 ELSE {_HIT} / len(list_distinct(pb)) END"
_RE = f"CASE WHEN len(gb) = 0 THEN 1.0 ELSE {_HIT} / len(list_distinct(gb)) END"


def _f(p: str, r: str) -> str:
    return f"CASE WHEN {p} + {r} > 0 THEN 2 * {p} * {r} / ({p} + {r}) ELSE 0.0 END"


_SCORES = f"WITH {_LISTS}, rt AS (SELECT id, {_PR} AS p, {_RE} AS r, (len(pb) - len(gb)) / greatest(1, len(gb)) AS bias, {sql.b_score('gb', 'pb')} AS b_score FROM bp), sc AS (SELECT id, p, r, {_f('p', 'r')} AS boundary_f1, bias, b_score FROM rt)"
_AGGREGATE = """l AS (SELECT source, unnest([{'m': 'boundary_f1', 'v': boundary_f1}, {'m': 'bias', 'v': bias}, {'m': 'b_score', 'v': b_score}]) AS x FROM sc JOIN documents ON sc.id = documents.doc_id),
    ag AS (SELECT source, x.m AS metric, avg(x.v) AS mean, stddev_samp(x.v) AS std FROM l GROUP BY ALL)"""
_NUMBER = "CAST(CAST(round(round({x}, 9) * 10000) AS BIGINT) AS VARCHAR)"
_LAB = f"""{_ENG},{_VOTES}, fu AS (SELECT * FROM ({_PAIR.format(src='v')})),
    lab AS (SELECT id, 0 AS eng, s, e, CASE WHEN e - s < 120 THEN 'short' ELSE 'long' END AS label FROM nl UNION ALL SELECT id, 1, s, e, 'marker' FROM mk WHERE s > 0 UNION ALL SELECT id, 2, s, e, CASE WHEN (s // {sql.CHUNK}) % 2 = 0 THEN 'even' ELSE 'odd' END FROM ch),
    ov AS (SELECT fu.doc_id, fu.seg_idx, fu.s, fu.e, lab.eng, lab.s AS ls, lab.label FROM fu LEFT JOIN lab ON fu.doc_id = lab.id AND least(fu.e, lab.e) > greatest(fu.s, lab.s))"""
_OVER = "greatest(0, least(g.e, p.e) - greatest(g.s, p.s))"


def _lists(name: str, texts: str, source: str) -> str:
    return f"{sql.cleaned(name + '_c', source)},{sql.boundaries(name, name + '_c', 'o')}"


_MODELS = f"""{sql.engines(sql.TRACES)},{_VOTES},
    vo AS (SELECT id, CAST(b AS INTEGER) AS s, CAST(e AS INTEGER) AS e FROM (SELECT id, b, lead(b) OVER (PARTITION BY id ORDER BY b) AS e FROM v) WHERE e IS NOT NULL),
    raw AS (SELECT 'newline_sent' AS exp_id, id, s, e FROM nl UNION ALL SELECT 'marker_sent', id, s, e FROM mk UNION ALL SELECT 'every_sent', id, s, e FROM ch UNION ALL SELECT 'newline_marker_every_voting_sent', id, s, e FROM vo),
    rn AS (SELECT exp_id, raw.id, texts.n, s, row_number() OVER (PARTITION BY exp_id, raw.id ORDER BY s, raw.e) AS o, count(*) OVER (PARTITION BY exp_id, raw.id) AS m, lead(s) OVER (PARTITION BY exp_id, raw.id ORDER BY s, raw.e) AS nx FROM raw JOIN texts ON raw.id = texts.id),
    md AS (SELECT exp_id, id, coalesce(list(CAST(coalesce(nx, n) AS INTEGER) ORDER BY o) FILTER (WHERE o < m), CAST([] AS INTEGER[])) AS mb FROM rn GROUP BY exp_id, id)"""


def _humans_sql(name: str, table: str) -> str:
    return f"""{name}0 AS (SELECT DISTINCT ON (id) id, split FROM {table} WHERE id IS NOT NULL AND split IS NOT NULL AND len(split) > 0),
    {name}1 AS (SELECT id, unnest(split) AS p, generate_subscripts(split, 1) AS o FROM {name}0),
    {name}2 AS (SELECT {name}1.id, texts.n, p[1] AS s, p[2] AS e, o FROM {name}1 JOIN texts ON {name}1.id = texts.id),
    {sql.cleaned(name + '3', name + '2', 'o')},{sql.boundaries(name, name + '3', 'o')}"""


_TA = f"{_humans_sql('ha', 'thought_anchor_gold_ha')},{_humans_sql('ve', 'thought_anchor_gold_ve')}"
_FAMILY = "concat(" + ", ".join("CASE WHEN " + " OR ".join(f"contains(lower(exp_id), '{w}')" for w in words) + f" THEN '{letter}' ELSE '' END" for letter, words in sorted(metrics.FAMILIES.items())) + ")"
_TRIADS = f"""{_MODELS},{_TA},
        hm AS MATERIALIZED (SELECT ha.id, ha.b AS a, ve.b AS b FROM ha JOIN ve ON ha.id = ve.id),
        tri AS MATERIALIZED (SELECT hm.id, exp_id, a, b, mb AS c FROM hm JOIN md ON hm.id = md.id),
        ab AS MATERIALIZED (SELECT id, exp_id, a, b, c, {sql.b_score('a', 'b', 10)} AS x FROM tri),
        ac AS MATERIALIZED (SELECT id, exp_id, b, c, x, {sql.b_score('a', 'c', 10)} AS y FROM ab),
        bc AS MATERIALIZED (SELECT id, exp_id, x, y, {sql.b_score('b', 'c', 10)} AS z FROM ac),
        td AS (SELECT id, exp_id, (x + y + z) / 3 AS score FROM bc)"""
_GOLD_TAIL = _GOLD.replace(sql.TRACES + ",", "", 1)

ORACLE_SQL = {
    "fuse_flatten": f"WITH {_ENG},{_BOUNDS} SELECT id AS doc_id, CAST(row_number() OVER (PARTITION BY id ORDER BY b) - 1 AS INTEGER) AS idx, CAST(b AS INTEGER) AS b FROM (SELECT DISTINCT id, b FROM bd)",
    "fuse_union": f"WITH {_ENG},{_BOUNDS}, d AS (SELECT DISTINCT id, b FROM bd) {_PAIR.format(src='d')}",
    "fuse_intersect": f"WITH {_ENG},{_BOUNDS}, d AS (SELECT id, b FROM bd GROUP BY id, b HAVING count(*) = 3 UNION SELECT id, 0 FROM bd UNION SELECT id, max(b) FROM bd GROUP BY id) {_PAIR.format(src='d')}",
    "fuse_voting": f"WITH {_ENG},{_VOTES} {_PAIR.format(src='v')}",
    "fuse_fuzzy": f"""WITH RECURSIVE {_ENG},{_BOUNDS}, d AS (SELECT id, b, row_number() OVER (PARTITION BY id ORDER BY b) AS k FROM (SELECT DISTINCT id, b FROM bd)),
        h AS (SELECT id, list(b ORDER BY b) AS bs FROM d GROUP BY id),
        r AS (SELECT id, bs, bs[1] AS b FROM h UNION ALL SELECT id, bs, list_filter(bs, lambda x: x - b > 40)[1] FROM r WHERE len(list_filter(bs, lambda x: x - b > 40)) > 0)
        {_PAIR.format(src='r')}""",
    "fuse_label_majority": f"""WITH {_LAB},
        c AS (SELECT doc_id, seg_idx, s, e, label, count(label) AS n, min(eng * 100000000 + ls) AS f FROM ov GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, seg_idx ORDER BY n DESC, f) AS k FROM c)
        SELECT doc_id, seg_idx, s, e, coalesce(label, 'UNK') AS label FROM r WHERE k = 1""",
    "fuse_label_concat": f"WITH {_LAB} SELECT doc_id, seg_idx, s, e, coalesce(string_agg(DISTINCT label, '+' ORDER BY label), 'UNK') AS label FROM ov GROUP BY ALL",
    "m_boundary": f"{_SCORES} SELECT id AS doc_id, round(p, 6) AS precision, round(r, 6) AS recall, round(boundary_f1, 6) AS boundary_f1, round(bias, 6) AS bias FROM sc",
    "m_near": f"""WITH {_LISTS} SELECT id AS doc_id, round({sql.b_score('gb', 'pb')}, 6) AS b_score, round(CASE WHEN len(pb) = 0 THEN 1.0 ELSE {sql.near('pb', 'gb', 10)} END, 6) AS boundary_cover,
        round(CASE WHEN len(gb) = 0 AND len(pb) = 0 THEN 1.0 WHEN len(gb) = 0 OR len(pb) = 0 THEN 0.0 ELSE {_f(sql.soft('pb', 'gb'), sql.soft('gb', 'pb'))} END, 6) AS soft_f1,
        CASE WHEN len(gb) = 0 OR len(pb) = 0 THEN 'Infinity'::DOUBLE ELSE round(list_sum(list_transform(gb, lambda x: list_min(list_transform(pb, lambda y: abs(x - y))))) / len(gb), 6) END AS displacement FROM bp""",
    "eval_fuzzy_agreement": f"""WITH {_LISTS.replace(' WHERE t.n > 0', '')}, c AS (SELECT id, CASE WHEN len(gb) = 0 THEN 1.0 ELSE {sql.near('gb', 'pb', 10)} END AS a, CASE WHEN len(pb) = 0 THEN 1.0 ELSE {sql.near('pb', 'gb', 10)} END AS b,
        len(gb) AS ng, len(pb) AS np, len(list_filter(gb, lambda x: len(list_filter(pb, lambda y: abs(x - y) <= 3)) > 0)) AS m FROM bp)
        SELECT id AS doc_id, round(greatest(a, b), 6) AS optimistic, round((a + b) / 2, 6) AS symmetric, round(CASE WHEN ng = 0 OR np = 0 THEN CASE WHEN ng = np THEN 1.0 ELSE 0.0 END WHEN m = 0 THEN 0.0 ELSE 2 * (m / np) * (m / ng) / (m / np + m / ng) END, 6) AS jitter FROM c""",
    "m_overlap": f"""WITH {_ENG},
        x AS (SELECT g.id, g.s, g.e, max({_OVER} / nullif((g.e - g.s) + (p.e - p.s) - {_OVER}, 0)) AS iou, max(2.0 * {_OVER} / ((g.e - g.s) + (p.e - p.s))) AS dice FROM nl g JOIN mk p ON g.id = p.id WHERE g.e > g.s AND p.e > p.s GROUP BY g.id, g.s, g.e)
        SELECT t.id AS doc_id, round(avg(iou), 6) AS mean_iou, round(avg(dice), 6) AS mean_dice FROM texts t LEFT JOIN x ON t.id = x.id WHERE t.n > 0 GROUP BY t.id""",
    "m_windows": f"""WITH {_ENG}, nn AS (SELECT nl.*, texts.n FROM nl JOIN texts ON nl.id = texts.id WHERE texts.n > 0), mm AS (SELECT mk.*, texts.n FROM mk JOIN texts ON mk.id = texts.id WHERE texts.n > 0),
        {sql.cleaned('gc', 'nn')},{sql.cleaned('pc', 'mm')},{sql.boundaries('gl', 'gc', 'o')},{sql.boundaries('pl', 'pc', 'o')},
        kk AS (SELECT gl.id, t.n, gl.b AS gb, pl.b AS pb, greatest(1, CAST(round_even(t.n / len(gl.sp) / 2, 0) AS INTEGER)) AS k FROM gl JOIN pl ON gl.id = pl.id JOIN texts t ON gl.id = t.id),
        pt AS (SELECT id, n, k, gb, pb, list_sort(list_distinct(list_filter(list_concat([0, n - k], gb, pb, list_transform(gb, lambda b: b - k), list_transform(pb, lambda b: b - k)), lambda x: x >= 0 AND x <= n - k))) AS ps FROM kk WHERE n > k),
        st AS (SELECT id, n, k, gb, pb, unnest(ps[:-2]) AS i, unnest(ps[2:]) AS j FROM pt),
        ev AS (SELECT id, n, k, j - i AS w, len(list_filter(gb, lambda b: b > i AND b <= i + k)) AS ga, len(list_filter(pb, lambda b: b > i AND b <= i + k)) AS pa FROM st)
        SELECT kk.id AS doc_id, round(any_value(r1), 6) AS p_k, round(any_value(r2), 6) AS window_diff FROM kk LEFT JOIN
        (SELECT id, sum(CASE WHEN (ga = 0) <> (pa = 0) THEN w ELSE 0 END) / any_value(n - k) AS r1, sum(CASE WHEN ga <> pa THEN w ELSE 0 END) / any_value(n - k) AS r2 FROM ev GROUP BY id) z ON kk.id = z.id GROUP BY kk.id""",
    "m_density": f"""WITH {_LISTS}, bi AS (SELECT id, n, gb, pb, unnest(range(20)) AS i FROM bp),
        h AS (SELECT id, CASE WHEN len(gb) = 0 THEN 1e-9 ELSE len(list_filter(gb, lambda x: least(x * 20 // n, 19) = i)) / (len(gb) * (n / 20.0::DOUBLE)) + 1e-9 END AS p, CASE WHEN len(pb) = 0 THEN 1e-9 ELSE len(list_filter(pb, lambda x: least(x * 20 // n, 19) = i)) / (len(pb) * (n / 20.0::DOUBLE)) + 1e-9 END AS q FROM bi)
        SELECT id AS doc_id, round(0.5 * sum(p * ln(p / ((p + q) / 2))) + 0.5 * sum(q * ln(q / ((p + q) / 2))), 6) AS density_jsd FROM h GROUP BY id""",
    "m_intrinsic": f"WITH {_ENG} SELECT id AS doc_id, CAST(count(*) AS INTEGER) AS seg_count, round(avg(e - s), 6) AS avg_len, round(stddev_pop(e - s), 6) AS len_std, min(e - s) AS min_len FROM mk GROUP BY id",
    "m_alpha": f"""WITH {_ENG}, it AS (SELECT u.id, u.e, (SELECT count(DISTINCT eng) FROM seg WHERE seg.id = u.id AND seg.e = u.e) AS n1 FROM u),
        t AS (SELECT sum(2 * n1 * (3 - n1) / 2) AS dis, sum(n1)::DOUBLE AS t1, sum(3 - n1)::DOUBLE AS t0 FROM it)
        SELECT round(CASE WHEN t1 * t0 = 0 THEN 1.0 ELSE 1 - (dis / (t1 + t0)) / (2 * t1 * t0 / ((t1 + t0) * (t1 + t0 - 1))) END, 6) AS alpha FROM t""",
    "eval_aggregate": f"{_SCORES}, {_AGGREGATE} SELECT source, metric, round(mean, 9) AS mean, round(std, 9) AS std FROM ag",
    "eval_json": f"""{_SCORES}, {_AGGREGATE} SELECT source, '{{' || string_agg('"' || metric || '":{{"mean":' || {_NUMBER.format(x='mean')} || CASE WHEN std IS NULL THEN '' ELSE ',"std":' || {_NUMBER.format(x='std')} END || '}}', ',' ORDER BY metric) || '}}' AS scores FROM ag GROUP BY source""",
    "human_baseline": f"WITH {sql.TRACES},{_TA} SELECT ha.id, round({sql.b_score('ha.b', 've.b', 10)}, 6) AS b_score FROM ha JOIN ve ON ha.id = ve.id",
    "leaderboard_rf": f"""WITH {_MODELS},{_GOLD_TAIL},{sql.cleaned('gc', 'gp', 'o')},{sql.boundaries('gl', 'gc', 'o')},
        bo AS (SELECT exp_id, count(*) AS n, round(avg({sql.b_score('gl.b', 'md.mb')}), 6) AS score FROM gl JOIN md ON gl.id = md.id GROUP BY exp_id HAVING count(*) = (SELECT count(*) FROM gl))
        SELECT exp_id, n, score, {_FAMILY} AS family, CASE WHEN contains(exp_id, 'voting') THEN 'voting' ELSE 'none' END AS aligner, CAST(row_number() OVER (ORDER BY score DESC, exp_id) AS INTEGER) AS rank FROM bo""",
    "leaderboard_ta": f"""WITH {_TRIADS}, bo AS (SELECT exp_id, count(*) AS n, round(avg(score), 6) AS score FROM td GROUP BY exp_id)
        SELECT exp_id, n, score, {_FAMILY} AS family, CAST(row_number() OVER (ORDER BY score DESC, exp_id) AS INTEGER) AS rank FROM bo""",
    "leaderboard_subset": f"WITH {_TRIADS}, dm AS (SELECT id, max(domain) AS domain FROM rtrace GROUP BY id) SELECT exp_id, domain, count(*) AS n, round(avg(score), 9) AS score FROM td JOIN dm ON td.id = dm.id WHERE domain IS NOT NULL GROUP BY ALL",
    "leaderboard_single": f"""WITH {_TRIADS},{_GOLD_TAIL},{sql.cleaned('gc', 'gp', 'o')},{sql.boundaries('gl', 'gc', 'o')},
        rf AS (SELECT exp_id, avg({sql.b_score('gl.b', 'md.mb')}) AS score FROM gl JOIN md ON gl.id = md.id GROUP BY exp_id HAVING count(*) = (SELECT count(*) FROM gl)),
        ta AS (SELECT exp_id, avg(score) AS score FROM td GROUP BY exp_id)
        SELECT ta.exp_id, round(ta.score, 9) AS score_ta, round(rf.score, 9) AS score_rf FROM ta JOIN rf ON ta.exp_id = rf.exp_id WHERE NOT contains(ta.exp_id, 'voting')""",
    "score_density": f"""{_SCORES}, va AS (SELECT domain, round(round(b_score, 6), 4) AS v, count(*) AS c FROM sc JOIN documents ON sc.id = documents.doc_id WHERE domain IS NOT NULL AND b_score BETWEEN 0 AND 1 GROUP BY ALL),
        en AS (SELECT domain FROM va GROUP BY domain HAVING sum(c) >= 10), gr AS (SELECT va.domain, v, c, i / 100.0::DOUBLE AS x FROM va JOIN en ON va.domain = en.domain, (SELECT unnest(range(101)) AS i)),
        cu AS (SELECT domain, x, sum(c * exp(-0.5 * pow((x - v) / 0.05, 2))) AS d FROM gr GROUP BY ALL)
        SELECT domain, round(x, 6) AS x, round(d / max(d) OVER (PARTITION BY domain), 6) AS density FROM cu""",
    "fuse_graph": f"""WITH RECURSIVE {_ENG},
        w AS (SELECT id, CAST(s AS INTEGER) AS s, CAST(e AS INTEGER) AS e, count(*) AS n FROM seg GROUP BY ALL),
        nd AS (SELECT id, b, CAST(row_number() OVER (PARTITION BY id ORDER BY b) AS INTEGER) AS r FROM (SELECT id, s AS b FROM w UNION SELECT id, e FROM w)),
        ed AS (SELECT w.id, x.r AS si, y.r AS ei, n FROM w JOIN nd x ON w.id = x.id AND w.s = x.b JOIN nd y ON w.id = y.id AND w.e = y.b),
        gr AS (SELECT nd.id, nd.r, nd.b, coalesce(list({'{'}'s': si, 'n': n{'}'} ORDER BY si) FILTER (WHERE si < nd.r), []) AS es, max(nd.r) OVER (PARTITION BY nd.id) AS m FROM nd LEFT JOIN ed ON nd.id = ed.id AND nd.r = ed.ei GROUP BY nd.id, nd.r, nd.b),
        dp AS (SELECT id, 1 AS r, m, [0::BIGINT] AS t, [0] AS p FROM gr WHERE r = 1
            UNION ALL
            SELECT id, r, m, list_append(t, coalesce(bn, 0)), list_append(p, CASE WHEN bn > 0 THEN es[list_position(list_transform(es, lambda z: t[z.s] + z.n), bn)].s ELSE 0 END)
            FROM (SELECT dp.id, gr.r, dp.m, t, p, es, list_max(list_transform(es, lambda z: t[z.s] + z.n)) AS bn FROM dp JOIN gr ON dp.id = gr.id AND gr.r = dp.r + 1)),
        pa AS (SELECT id, m AS r, p FROM dp WHERE r = m UNION ALL SELECT id, p[r], p FROM pa WHERE p[r] > 0),
        pt AS (SELECT pa.id, nd.b FROM pa JOIN nd ON pa.id = nd.id AND pa.r = nd.r UNION SELECT id, 0 FROM nd UNION SELECT id, b FROM nd WHERE r = 1)
        {_PAIR.format(src='pt')}""",
    "score_boxes": f"{_SCORES} SELECT domain, count(*) AS n, min(round(b_score, 6)) AS low, round(quantile_cont(round(b_score, 6), 0.25), 6) AS q1, round(quantile_cont(round(b_score, 6), 0.5), 6) AS median, round(quantile_cont(round(b_score, 6), 0.75), 6) AS q3, max(round(b_score, 6)) AS high FROM sc JOIN documents ON sc.id = documents.doc_id WHERE domain IS NOT NULL GROUP BY domain",
    "eval_consensus": f"""WITH {_ENG},{sql.boundaries('l1', 'nl')},{sql.boundaries('l2', 'mk')},{sql.boundaries('l3', 'ch')}, e AS (SELECT t.id, coalesce(l1.b, CAST([] AS INTEGER[])) AS a, coalesce(l2.b, CAST([] AS INTEGER[])) AS b, coalesce(l3.b, CAST([] AS INTEGER[])) AS c FROM texts t LEFT JOIN l1 ON t.id = l1.id LEFT JOIN l2 ON t.id = l2.id LEFT JOIN l3 ON t.id = l3.id)
        SELECT id AS doc_id, round((({sql.b_score('a', 'b')}) + ({sql.b_score('a', 'c')}) + ({sql.b_score('b', 'c')})) / 3, 6) AS consensus FROM e""",
    "eval_pair_matrix": f"""WITH {_ENG},{sql.boundaries('l1', 'nl')},{sql.boundaries('l2', 'mk')},{sql.boundaries('l3', 'ch')}, e AS (SELECT t.id, coalesce(l1.b, CAST([] AS INTEGER[])) AS a, coalesce(l2.b, CAST([] AS INTEGER[])) AS b, coalesce(l3.b, CAST([] AS INTEGER[])) AS c FROM texts t LEFT JOIN l1 ON t.id = l1.id LEFT JOIN l2 ON t.id = l2.id LEFT JOIN l3 ON t.id = l3.id),
        m AS (SELECT avg({sql.b_score('a', 'b')}) AS ab, avg({sql.b_score('a', 'c')}) AS ac, avg({sql.b_score('b', 'c')}) AS bc FROM e)
        SELECT x.a, x.b, round(x.v, 6) AS b_score FROM (SELECT unnest([{{'a': 'newline', 'b': 'marker', 'v': ab}}, {{'a': 'marker', 'b': 'newline', 'v': ab}}, {{'a': 'newline', 'b': 'every', 'v': ac}}, {{'a': 'every', 'b': 'newline', 'v': ac}}, {{'a': 'marker', 'b': 'every', 'v': bc}}, {{'a': 'every', 'b': 'marker', 'v': bc}}, {{'a': 'newline', 'b': 'newline', 'v': 1.0}}, {{'a': 'marker', 'b': 'marker', 'v': 1.0}}, {{'a': 'every', 'b': 'every', 'v': 1.0}}]) AS x FROM m)""",
}
