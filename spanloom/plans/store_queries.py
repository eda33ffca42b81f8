"""Queries of the store, the annotation tool and the search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators import engines, fusion, metrics, search, units
from spanloom.plans import sql
from spanloom.plans.score_queries import segmented
from spanloom.plans.segment_queries import _HA, _gold_pairs, _labelled, texts, traces
from spanloom.sources import annotation_tool, store
from spanloom.tables import read

BITS, SIZE, SEED = 38, 256, 1337


def resume_left_anti(spark: SparkSession, d: str) -> DataFrame:
    """Traces without a gold segmentation."""
    rows = read(spark, d, "rtrace").where("id IS NOT NULL").select("id").distinct()
    return store.missing(rows, read(spark, d, "reasoning_flow_gold"))


def sample_per_group(spark: SparkSession, d: str) -> DataFrame:
    """One correct trace per domain and model, not overlong if the group has such a one."""
    rows = read(spark, d, "rtrace").where("id IS NOT NULL AND rt IS NOT NULL AND correct AND domain IS NOT NULL AND model IS NOT NULL").select("id", "domain", "model", F.ceil(F.length("rt") / 6000).alias("step")).distinct()
    return annotation_tool.sample_per_group(rows, ["domain", "model"], "id", first=["step"]).select("id", "domain", "model")


def ls_export_html(spark: SparkSession, d: str) -> DataFrame:
    """Every labelled trace as the annotation tool's HTML."""
    return annotation_tool.boxes(_labelled(spark, d), "text", "units").select("id", F.md5("html").alias("digest"))


def ls_import_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Labelled spans that went to the annotation tool's format and came back."""
    rows = _labelled(spark, d).withColumn("labels", F.expr("transform(units, x -> x.label)"))
    tasks = annotation_tool.exported_annotations(rows, "id", "units", "labels", 1)
    return annotation_tool.imported(tasks, rows.select("id", "units")).select("id", "completed_by", "s", "e", F.col("label")[0].alias("label"))


def evo_population(spark: SparkSession, d: str) -> DataFrame:
    return search.population(spark, SIZE, BITS, SEED)


def evo_mutate(spark: SparkSession, d: str) -> DataFrame:
    return search.mutated(search.population(spark, SIZE, BITS, SEED), BITS, 1, SEED)


def evo_crossover(spark: SparkSession, d: str) -> DataFrame:
    p = search.population(spark, SIZE, BITS, SEED)
    a = p.select("slot", F.col("mask").alias("mask_a"), F.col("aligner_idx").alias("aligner_a"))
    b = p.select((F.lit(SIZE - 1) - F.col("slot")).alias("slot"), F.col("mask").alias("mask_b"), F.col("aligner_idx").alias("aligner_b"))
    return search.crossed(a.join(b, "slot"), BITS, 1, SEED)


def _toy_scored(spark: SparkSession) -> DataFrame:
    """The population with its share of set bits as score."""
    return search.population(spark, SIZE, BITS, SEED).withColumn("score", F.round(F.bit_count("mask") / float(BITS), 6))


def evo_tournament(spark: SparkSession, d: str) -> DataFrame:
    return search.tournament(_toy_scored(spark), SIZE, 1, "a", SEED)


def evo_topk(spark: SparkSession, d: str) -> DataFrame:
    return search.elites(_toy_scored(spark), SIZE // search.ELITE).select("mask", "aligner_idx", "score")


def evo_decode(spark: SparkSession, d: str) -> DataFrame:
    names = [f"engine{i}" for i in range(BITS)]
    return search.decoded(search.population(spark, SIZE, BITS, SEED), names).select("slot", "approach", F.size("engines").alias("n_engines"))


def upsert_ignore(spark: SparkSession, d: str) -> DataFrame:
    """Scores of a first batch, and of a second where the first has none."""
    first = _toy_scored(spark).where("slot < 160").select("mask", "aligner_idx", "score").distinct()
    second = _toy_scored(spark).where("slot >= 96").select("mask", "aligner_idx", (F.col("score") + 1).alias("score"))
    return search.insert_ignore(first, second)


def bulk_lookup(spark: SparkSession, d: str) -> DataFrame:
    known = _toy_scored(spark).where("slot < 160").select("mask", "aligner_idx", "score").distinct()
    return search.lookup(known, _toy_scored(spark).where("slot >= 96"))


#: Engines of the search, by bit.
POOL = ["line", "paragraph", "marker", "every400", "every200", "sentence", "unit", "clause"]


def _pooled(df: DataFrame) -> DataFrame:
    """(id, pool): the spans of all engines of the search, in one pass over the texts."""
    out = segmented(df.withColumn("n", F.length("text"))).select("id", "nl", "mk", "ch")
    one = engines.at_delimiter(df, "\n\n").withColumnRenamed("spans", "pa")
    one = engines.every(one, sql.CHUNK // 2).withColumnRenamed("spans", "c2")
    for name, cut in {"se": units.sentence_units, "mm": units.micro_merged, "cl": units.clause_units}.items():
        one = cut(one).withColumnRenamed("units", name)
    both = out.join(one.select("id", "pa", "c2", "se", "mm", "cl"), "id")
    return both.select("id", F.array("nl", "pa", "mk", "ch", "c2", "se", "mm", "cl").alias("pool"))


def evo_search(spark: SparkSession, d: str) -> DataFrame:
    """Four generations of 256 configurations of eight engines and five aligners on the gold traces."""
    gold = _gold_pairs(spark, d).select("id", F.expr(metrics.ends("spans")).alias("gb"))
    rows = traces(spark, d).join(gold.select("id"), "id", "left_semi")
    score = search.scorer(_pooled(rows).join(gold, "id"), len(POOL))
    return search.search(spark, score, len(POOL), SIZE, 4, SEED)


def evo_report(spark: SparkSession, d: str) -> DataFrame:
    """How many configurations each aligner has, their best and their mean score."""
    return search.report(_toy_scored(spark)).select("aligner", "n", "best", F.round("mean", 9).alias("mean"))


def evo_extract(spark: SparkSession, d: str) -> DataFrame:
    """All scored configurations by name."""
    return search.extracted(_toy_scored(spark).select("mask", "aligner_idx", "score").distinct(), [f"engine{i}" for i in range(BITS)])


def voted_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Agreement of three engines' vote with the text's lines, by language."""
    voted = fusion.voting(segmented(texts(spark, d))).select("id", "nl", "fused")
    scored = voted.select("id", F.expr(metrics.ends("nl")).alias("gb"), F.expr(metrics.ends("fused")).alias("pb")).select("id", metrics.b_score().alias("b"))
    langs = read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.coalesce("lang", F.lit("none")).alias("lang"))
    return scored.join(langs, "id").groupBy("lang").agg(F.count(F.lit(1)).alias("documents"), F.round(F.avg("b"), 6).alias("b_score"))


QUERIES = {
    f.__name__: f
    for f in (
        resume_left_anti, sample_per_group, ls_export_html, ls_import_offsets, evo_population, evo_mutate, evo_crossover, evo_tournament, evo_topk, evo_decode, upsert_ignore, bulk_lookup, evo_search, evo_report, evo_extract, voted_agreement,
    )
}


# -- SQL ------------------------------------------------------------------------
def _draw(*parts: object) -> str:
    """The search's draws; parts are SQL texts."""
    return f"(('0x' || substr(md5(concat_ws(':', {', '.join(str(p) for p in parts)})), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def _mask(test) -> str:  # noqa: ANN001
    return "(" + " + ".join(f"CASE WHEN {test(i)} THEN {1 << i}::BIGINT ELSE 0 END" for i in range(BITS)) + ")"


_POP = f"""sl AS (SELECT CAST(range AS INTEGER) AS slot FROM range({SIZE})),
    p0 AS (SELECT slot, {_mask(lambda i: f"{_draw(f"'{SEED}'", "'init'", 'slot', f"'{i}'")} < 0.25")} AS m FROM sl),
    pop AS (SELECT slot, CASE WHEN m = 0 THEN (1::BIGINT << CAST(floor({_draw(f"'{SEED}'", "'init'", 'slot', "'one'")} * {BITS}) AS INTEGER)) ELSE m END AS mask, CAST(floor({_draw(f"'{SEED}'", "'al'", 'slot')} * {len(search.ALIGNERS)}) AS INTEGER) AS aligner_idx FROM p0)"""
_TOY = f"{_POP}, toy AS (SELECT slot, mask, aligner_idx, round(bit_count(mask) / {float(BITS)}::DOUBLE, 6) AS score FROM pop)"
_G = "'1'"

ORACLE_SQL = {
    "resume_left_anti": "SELECT DISTINCT id FROM rtrace WHERE id IS NOT NULL AND id NOT IN (SELECT id FROM reasoning_flow_gold WHERE id IS NOT NULL)",
    "sample_per_group": "SELECT id, domain, model FROM (SELECT *, row_number() OVER (PARTITION BY domain, model ORDER BY step, md5('0:' || id), id) AS r FROM (SELECT DISTINCT id, domain, model, ceil(length(rt) / 6000) AS step FROM rtrace WHERE id IS NOT NULL AND rt IS NOT NULL AND correct AND domain IS NOT NULL AND model IS NOT NULL)) WHERE r = 1",
    "ls_export_html": f"""WITH {_HA}, b AS (SELECT id, unit_idx, '<p>' || replace(replace(replace(substring(text, s + 1, e - s), '&', '&amp;'), '"', '&quot;'), '<', '&lt;') || '</p>' AS x FROM ha)
        SELECT id, md5('<div>' || string_agg(x, '' ORDER BY unit_idx) || '</div>') AS digest FROM b GROUP BY id""",
    "ls_import_offsets": f"WITH {_HA} SELECT id, 1 AS completed_by, CAST(s AS INTEGER) AS s, CAST(e AS INTEGER) AS e, label FROM ha",
    "evo_population": f"WITH {_POP} SELECT * FROM pop",
    "evo_mutate": f"""WITH {_POP}, x AS (SELECT slot, aligner_idx, xor(mask, {_mask(lambda i: f"{_draw(f"'{SEED}'", "'flip'", _G, 'slot', f"'{i}'")} < {1.0 / BITS!r}")}) AS m FROM pop)
        SELECT slot, CASE WHEN m = 0 THEN (1::BIGINT << CAST(floor({_draw(f"'{SEED}'", "'bit'", _G, 'slot')} * {BITS}) AS INTEGER)) ELSE m END AS mask,
        CASE WHEN {_draw(f"'{SEED}'", "'re'", _G, 'slot')} < 0.05 THEN CAST(floor({_draw(f"'{SEED}'", "'which'", _G, 'slot')} * {len(search.ALIGNERS)}) AS INTEGER) ELSE aligner_idx END AS aligner_idx FROM x""",
    "evo_crossover": f"""WITH {_POP}, x AS (SELECT a.slot, a.mask AS ma, b.mask AS mb, a.aligner_idx AS aa, b.aligner_idx AS ab, {_mask(lambda i: f"{_draw(f"'{SEED}'", "'mix'", _G, 'a.slot', f"'{i}'")} < 0.5")} AS mx FROM pop a JOIN pop b ON a.slot = {SIZE - 1} - b.slot)
        SELECT slot, CASE WHEN ((ma & mx) | (mb & ~mx)) = 0 THEN ma ELSE ((ma & mx) | (mb & ~mx)) END AS mask, CASE WHEN {_draw(f"'{SEED}'", "'par'", _G, 'slot')} < 0.5 THEN aa ELSE ab END AS aligner_idx FROM x""",
    "evo_tournament": f"""WITH {_TOY}, k AS (SELECT s.slot AS o, CAST(k.range AS INTEGER) AS k FROM sl s, range(7) k),
        d AS (SELECT o, k, CAST(floor({_draw(f"'{SEED}'", "'a'", _G, 'o', 'k')} * {SIZE}) AS INTEGER) AS slot FROM k),
        r AS (SELECT o, t.mask, t.aligner_idx, t.score, row_number() OVER (PARTITION BY o ORDER BY t.score DESC, k) AS rn FROM d JOIN toy t ON d.slot = t.slot)
        SELECT o AS slot, mask, aligner_idx, score FROM r WHERE rn = 1""",
    "evo_topk": f"WITH {_TOY} SELECT mask, aligner_idx, score FROM toy ORDER BY score DESC, mask, aligner_idx LIMIT {SIZE // search.ELITE}",
    "evo_decode": f"""WITH {_POP}, b AS (SELECT slot, aligner_idx, list_filter(range({BITS}), lambda i: (mask >> i) & 1 = 1) AS bs FROM pop)
        SELECT slot, array_to_string(list_transform(bs, lambda i: 'engine' || i), '_') || CASE WHEN len(bs) > 1 THEN '_' || {search.ALIGNERS}[aligner_idx + 1] ELSE '' END AS approach, CAST(len(bs) AS INTEGER) AS n_engines FROM b""",
    "evo_report": f"WITH {_TOY} SELECT {search.ALIGNERS}[aligner_idx + 1] AS aligner, count(*) AS n, max(score) AS best, round(avg(score), 9) AS mean FROM toy GROUP BY ALL",
    "evo_extract": f"""WITH {_TOY}, b AS (SELECT DISTINCT mask, aligner_idx, score, list_transform(list_filter(range({BITS}), lambda i: (mask >> i) & 1 = 1), lambda i: 'engine' || i) AS es FROM toy)
        SELECT array_to_string(es, '_') || CASE WHEN len(es) > 1 THEN '_' || {search.ALIGNERS}[aligner_idx + 1] ELSE '' END AS approach, array_to_string(es, '+') AS engines, score FROM b""",
    "upsert_ignore": f"""WITH {_TOY}, f AS (SELECT DISTINCT mask, aligner_idx, score FROM toy WHERE slot < 160)
        SELECT mask, aligner_idx, score FROM f UNION ALL SELECT mask, aligner_idx, max(score + 1) FROM toy WHERE slot >= 96 AND NOT EXISTS (SELECT 1 FROM f WHERE f.mask = toy.mask AND f.aligner_idx = toy.aligner_idx) GROUP BY ALL""",
    "bulk_lookup": f"WITH {_TOY} SELECT DISTINCT a.mask, a.aligner_idx, a.score FROM toy a JOIN toy b ON a.mask = b.mask AND a.aligner_idx = b.aligner_idx WHERE a.slot < 160 AND b.slot >= 96",
    "voted_agreement": f"""WITH {sql.engines(sql.DOCUMENTS)}, v AS (SELECT id, b FROM (SELECT id, s AS b FROM seg UNION ALL SELECT id, max(e) FROM seg GROUP BY id, eng) GROUP BY id, b HAVING count(*) >= 2),
        fu AS (SELECT * FROM (SELECT id, CAST(b AS INTEGER) AS s, CAST(lead(b) OVER (PARTITION BY id ORDER BY b) AS INTEGER) AS e FROM v) WHERE e IS NOT NULL), {sql.boundaries('gl', 'nl')},{sql.boundaries('pl', 'fu')},
        sc AS (SELECT t.id, coalesce(gl.b, CAST([] AS INTEGER[])) AS g, coalesce(pl.b, CAST([] AS INTEGER[])) AS p FROM texts t LEFT JOIN gl ON t.id = gl.id LEFT JOIN pl ON t.id = pl.id)
        SELECT coalesce(lang, 'none') AS lang, count(*) AS documents, round(avg({sql.b_score('g', 'p')}), 6) AS b_score FROM sc JOIN documents ON sc.id = documents.doc_id GROUP BY ALL""",
}
