"""Queries of base units, engines and label runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators import coherence, engines, series, units
from spanloom.operators.units import CLAUSE_PATTERN, CONNECTIVES, MASK_PATTERN, SENTENCE_PATTERN
from spanloom.partitions import spread
from spanloom.plans import sql
from spanloom.tables import read

#: Markers that occur in several languages' texts.
CUSTOM_MARKERS = ["the", "and", "der", "que", "et"]


def texts(spark: SparkSession, d: str) -> DataFrame:
    """(id, text, n) of all documents."""
    rows = spread(read(spark, d, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("id"), "text"))
    return rows.withColumn("n", F.length("text"))


def traces(spark: SparkSession, d: str) -> DataFrame:
    """(id, text, n) of all traces, repeated rows once."""
    rows = read(spark, d, "rtrace").where("id IS NOT NULL AND rt IS NOT NULL").groupBy("id").agg(F.max_by("rt", F.struct("stored_at", "rt")).alias("text"))
    return rows.select("id", "text", F.length("text").alias("n"))


def _long(df: DataFrame, spans: str, index: str) -> DataFrame:
    return units.long(df, ["id"], spans, index).withColumnRenamed("id", "doc_id")


def mask_spans(spark: SparkSession, d: str) -> DataFrame:
    masked = units.mask(texts(spark, d))
    return masked.select(F.col("id").alias("doc_id"), "n_blocks", F.md5("masked").alias("digest"), (F.length("masked") - F.col("n")).alias("drift"))


def units_sentence(spark: SparkSession, d: str) -> DataFrame:
    return _long(units.sentence_units(texts(spark, d)), "units", "unit_idx")


def units_clause(spark: SparkSession, d: str) -> DataFrame:
    return _long(units.clause_units(texts(spark, d)), "units", "unit_idx")


def unit_micro_merge(spark: SparkSession, d: str) -> DataFrame:
    return _long(units.micro_merged(texts(spark, d)), "units", "unit_idx")


def _gold_pairs(spark: SparkSession, d: str) -> DataFrame:
    """(id, n, spans) of gold splits whose pairs have both ends in order, in the order given."""
    gold = read(spark, d, "reasoning_flow_gold").where("id IS NOT NULL AND split IS NOT NULL").dropDuplicates(["id"])
    good = gold.select("id", F.expr("transform(filter(split, p -> size(p) = 2 AND p[0] IS NOT NULL AND p[1] IS NOT NULL AND p[0] < p[1]), p -> named_struct('s', p[0], 'e', p[1]))").alias("spans")).where("size(spans) > 0")
    return good.join(traces(spark, d).select("id", "n"), "id")


def unit_overlap_merge(spark: SparkSession, d: str) -> DataFrame:
    return units.long(units.overlap_merged(_gold_pairs(spark, d)), ["id"], "merged", "seg_idx")


def clean_offsets(spark: SparkSession, d: str) -> DataFrame:
    return units.long(engines.clean(_gold_pairs(spark, d)), ["id"], "spans", "seg_idx")


def seg_newline_line(spark: SparkSession, d: str) -> DataFrame:
    return _long(engines.at_delimiter(texts(spark, d), "\n"), "spans", "seg_idx")


def seg_newline_para(spark: SparkSession, d: str) -> DataFrame:
    return _long(engines.at_delimiter(texts(spark, d), "\n\n"), "spans", "seg_idx")


def seg_marker_rules(spark: SparkSession, d: str) -> DataFrame:
    return _long(engines.at_markers(texts(spark, d)), "spans", "seg_idx")


def seg_marker_rules_custom(spark: SparkSession, d: str) -> DataFrame:
    return _long(engines.at_markers(texts(spark, d), CUSTOM_MARKERS), "spans", "seg_idx")


def seg_every(spark: SparkSession, d: str) -> DataFrame:
    return _long(engines.every(texts(spark, d), sql.CHUNK), "spans", "seg_idx")


def marker_family_counts(spark: SparkSession, d: str) -> DataFrame:
    """Units with a marker of each family, by the documents' source."""
    rows = read(spark, d, "documents").where("text IS NOT NULL").select("source", F.explode(F.regexp_extract_all("text", F.lit(f"({SENTENCE_PATTERN})"), F.lit(1))).alias("unit"))
    flags = rows.select("source", *engines.family_flags("unit"))
    return flags.groupBy("source").agg(F.count(F.lit(1)).alias("units"), *(F.sum(F.col(f).cast("bigint")).alias(f) for f in engines.MARKERS))


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    """(id, n, units of (s, e, label)) of an annotator's spans, repeated rows once, labels in lower case."""
    ha = read(spark, d, "thought_anchor_gold_ha").where("id IS NOT NULL AND split IS NOT NULL").dropDuplicates(["id"])
    packed = ha.select("id", F.expr("transform(arrays_zip(split, labels), z -> named_struct('s', z.split[0], 'e', z.split[1], 'label', lower(get(z.labels, 0))))").alias("units"))
    return packed.join(traces(spark, d), "id")


def rle_merge_a(spark: SparkSession, d: str) -> DataFrame:
    return _runs(engines.label_runs(_labelled(spark, d)))


def rle_merge_b(spark: SparkSession, d: str) -> DataFrame:
    return _runs(engines.absorbed_runs(_labelled(spark, d)))


def _runs(df: DataFrame) -> DataFrame:
    return units.exploded(df, ["id"], "spans", "seg_idx", "x").select("id", "seg_idx", "x.s", "x.e", "x.label")


def context_window_prompts(spark: SparkSession, d: str) -> DataFrame:
    """Previous, target and next texts of every labelled span, and the prompt made of them."""
    cut = _labelled(spark, d).withColumn("units", F.expr("transform(units, x -> substring(text, x.s + 1, x.e - x.s))"))
    flat = units.exploded(engines.with_context(cut), ["id"], "contexts", "unit_idx", "c").select("id", "unit_idx", "c.previous", "c.target", "c.next")
    prompts = engines.fill_template(flat, "Before: {P}\nTarget: {T}\nAfter: {N}\nAnswer:", {"P": "previous", "T": "target", "N": "next"})
    return prompts.withColumn("prompt", F.md5("prompt"))


def reply_parsing(spark: SparkSession, d: str) -> DataFrame:
    """Labels and offsets read from model replies; here replies are made of the labelled spans."""
    flat = units.exploded(_labelled(spark, d), ["id"], "units", "unit_idx", "x")
    replies = flat.select("id", "unit_idx", F.to_json(F.struct(F.col("x.label").alias("label"))).alias("reply"), F.concat(F.lit("Offsets: [["), F.col("x.s"), F.lit(", "), F.col("x.e"), F.lit("]] done")).alias("offsets"))
    return replies.select("id", "unit_idx", engines.reply_label("reply").alias("label"), engines.reply_pairs("offsets")[0][0].alias("s"), engines.reply_pairs("offsets")[0][1].alias("e"))


def lm_bigram_counts(spark: SparkSession, d: str) -> DataFrame:
    return series.bigram_counts(series.bigrams(series.tokens(texts(spark, d), "id"), "id"))


def tok_surprisal(spark: SparkSession, d: str) -> DataFrame:
    """Mean surprisal, entropy and gap of each document's tokens."""
    scored = series.bigram_scores(texts(spark, d), "id").where("size(tokens) > 0")
    mean = {c: F.round(F.expr(f"aggregate({c}, 0D, (t, x) -> t + x) / size({c})"), 6).alias(c) for c in series.SCORES}
    return scored.select(F.col("id").alias("doc_id"), F.size("tokens").cast("bigint").alias("tokens"), *mean.values())


def _cut(found: DataFrame, quantile: float, high: bool = False) -> DataFrame:
    return series.threshold_boundaries(found, "id", quantile, high).select(F.col("id").alias("doc_id"), "b")


def _decided(spark: SparkSession, d: str, score: str, decide: series.Decide) -> DataFrame:
    found = series.decided(series.bigram_scores(texts(spark, d), "id", wanted=[score]), "id", score, decide)
    return units.exploded(found, ["id"], "bs", "i", "b").select(F.col("id").alias("doc_id"), "b")


def seg_surprisal(spark: SparkSession, d: str) -> DataFrame:
    return _decided(spark, d, "surprisal", series.at_turns(15, 0.1))


def seg_entropy(spark: SparkSession, d: str) -> DataFrame:
    return _decided(spark, d, "entropy", series.at_turns(30, 0.1))


def seg_flatness(spark: SparkSession, d: str) -> DataFrame:
    return _decided(spark, d, "surprisal", series.at_turns(15, 0.1, flat=True))


def seg_topk_shift(spark: SparkSession, d: str) -> DataFrame:
    return _cut(series.topk_shift(texts(spark, d), "id").withColumn("delta", F.round("delta", 9)), 0.9, True)


def seg_forced(spark: SparkSession, d: str) -> DataFrame:
    return _decided(spark, d, "gap", series.at_forced())


def seg_step_reward(spark: SparkSession, d: str) -> DataFrame:
    """Cuts where the share of digits of the units turns; the share stands in for a reward model's score."""
    cut = units.sentence_units(texts(spark, d)).withColumn("scores", F.expr(r"transform(units, x -> CAST(size(regexp_extract_all(substring(text, x.s + 1, x.e - x.s), '[0-9]', 0)) AS double) / (x.e - x.s))"))
    return series.step_cuts(cut, "id").select(F.col("id").alias("doc_id"), F.explode("cuts").alias("b"))


def seg_semantic_shift(spark: SparkSession, d: str) -> DataFrame:
    return _long(coherence.by_semantic_shift(units.micro_merged(texts(spark, d)), "id"), "spans", "seg_idx")


def seg_entailment(spark: SparkSession, d: str) -> DataFrame:
    return _long(coherence.by_entailment(units.micro_merged(texts(spark, d)), "id"), "spans", "seg_idx")


def seg_offset_chunks(spark: SparkSession, d: str) -> DataFrame:
    return _long(coherence.by_offset_chunks(texts(spark, d), "id"), "spans", "seg_idx")


def seg_keyword_labels(spark: SparkSession, d: str) -> DataFrame:
    """Runs of equal keyword labels of sentence units."""
    labelled = units.sentence_units(texts(spark, d)).withColumn("units", F.expr(f"transform(units, x -> named_struct('s', x.s, 'e', x.e, 'label', {coherence.keyword_label_sql('substring(text, x.s + 1, x.e - x.s)')}))"))
    runs = engines.label_runs(labelled)
    return units.exploded(runs, ["id"], "spans", "seg_idx", "x").select(F.col("id").alias("doc_id"), "seg_idx", "x.s", "x.e", "x.label")


def _label_runs(spark: SparkSession, d: str, label) -> DataFrame:  # noqa: ANN001
    runs = coherence.by_labels(units.micro_merged(texts(spark, d)), "id", label)
    return units.exploded(runs, ["id"], "spans", "seg_idx", "x").select(F.col("id").alias("doc_id"), "seg_idx", "x.s", "x.e", "x.label")


def seg_topics(spark: SparkSession, d: str) -> DataFrame:
    """Runs of equal topics of units; texts of few units have keyword labels."""
    return _label_runs(spark, d, coherence.topic_labels)


def seg_zero_shot(spark: SparkSession, d: str) -> DataFrame:
    """Runs of equal labels out of the reasoning-flow scheme."""
    return _label_runs(spark, d, lambda us: coherence.zero_shot_labels(us, coherence.LABEL_SETS["reasoning_flow"]))


def seg_zero_shot_ta(spark: SparkSession, d: str) -> DataFrame:
    """Runs of equal labels out of the thought-anchor scheme."""
    return _label_runs(spark, d, lambda us: coherence.zero_shot_labels(us, coherence.LABEL_SETS["thought_anchor"]))


def seg_unit_groups(spark: SparkSession, d: str) -> DataFrame:
    """Groups of units that a model puts together, shown a window at a time."""
    return _long(coherence.by_unit_groups(units.sentence_units(texts(spark, d)), "id"), "spans", "seg_idx")


def _prompted(spark: SparkSession, d: str, scheme: str) -> DataFrame:
    runs = coherence.by_prompted_labels(units.sentence_units(texts(spark, d)), "id", scheme)
    return units.exploded(runs, ["id"], "spans", "seg_idx", "x").select(F.col("id").alias("doc_id"), "seg_idx", "x.s", "x.e", "x.label")


def seg_thought_anchor(spark: SparkSession, d: str) -> DataFrame:
    return _prompted(spark, d, "thought_anchor")


def seg_reasoning_flow(spark: SparkSession, d: str) -> DataFrame:
    return _prompted(spark, d, "reasoning_flow")


def seg_argument(spark: SparkSession, d: str) -> DataFrame:
    return _prompted(spark, d, "argument")


def topic_terms(spark: SparkSession, d: str) -> DataFrame:
    """The ten most telling words of each domain."""
    words = read(spark, d, "documents").where("text IS NOT NULL AND domain IS NOT NULL").select("domain", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"([a-z]{3,})"), F.lit(1))).alias("term"))
    return coherence.topic_terms(words, "domain", "term").withColumn("weight", F.round("weight", 6))


QUERIES = {
    f.__name__: f
    for f in (
        mask_spans, units_sentence, units_clause, unit_micro_merge, unit_overlap_merge, clean_offsets, seg_newline_line, seg_newline_para, seg_marker_rules, seg_marker_rules_custom, seg_every,
        marker_family_counts, rle_merge_a, rle_merge_b, context_window_prompts, reply_parsing, lm_bigram_counts, tok_surprisal, seg_surprisal, seg_entropy, seg_flatness, seg_topk_shift, seg_forced,
        seg_step_reward, seg_semantic_shift, seg_entailment, seg_offset_chunks, seg_keyword_labels, seg_topics, seg_zero_shot, seg_zero_shot_ta, seg_unit_groups, seg_thought_anchor, seg_reasoning_flow, seg_argument, topic_terms,
    )
}

# -- SQL ------------------------------------------------------------------------
_SPACE = r"[ \t\n\r\f]"
_GOLD = f"""
    {sql.TRACES},
    g0 AS (SELECT DISTINCT ON (id) id, split FROM reasoning_flow_gold WHERE id IS NOT NULL AND split IS NOT NULL),
    g1 AS (SELECT id, unnest(split) AS p, generate_subscripts(split, 1) AS o FROM g0),
    gp AS (SELECT g1.id, texts.n, p[1] AS s, p[2] AS e, o FROM g1 JOIN texts ON g1.id = texts.id WHERE len(p) = 2 AND p[1] < p[2])"""
_HA = f"""
    {sql.TRACES},
    h0 AS (SELECT DISTINCT ON (id) id, split, labels FROM thought_anchor_gold_ha WHERE id IS NOT NULL AND split IS NOT NULL),
    h1 AS (SELECT id, unnest(split) AS p, unnest(labels) AS l, generate_subscripts(split, 1) AS o FROM h0),
    ha AS (SELECT h1.id, texts.n, texts.text, CAST(o - 1 AS INTEGER) AS unit_idx, p[1] AS s, p[2] AS e, lower(l[1]) AS label FROM h1 JOIN texts ON h1.id = texts.id)"""
_RUNS = f"""{_HA},
    r0 AS (SELECT *, CASE WHEN lag(unit_idx) OVER w IS NULL OR label IS DISTINCT FROM lag(label) OVER w THEN 1 ELSE 0 END AS opens FROM ha WINDOW w AS (PARTITION BY id ORDER BY unit_idx)),
    r1 AS (SELECT *, sum(opens) OVER (PARTITION BY id ORDER BY unit_idx ROWS UNBOUNDED PRECEDING) AS run FROM r0),
    runs AS (SELECT id, n, CAST(run - 1 AS INTEGER) AS seg_idx, min(s) FILTER (WHERE opens = 1) AS s, max_by(e, unit_idx) AS e, max(label) AS label FROM r1 GROUP BY id, n, run)"""


def _tiles(ctes: str, source: str = "u", index: str = "unit_idx") -> str:
    return f"WITH {ctes} SELECT id AS doc_id, {index}, s, e FROM {source}"


def _numbered(ctes: str, source: str) -> str:
    return f"WITH {ctes} SELECT id AS doc_id, CAST(row_number() OVER (PARTITION BY id ORDER BY s, e) - 1 AS INTEGER) AS seg_idx, s, e FROM {source}"


def _grouped(ctes: str, opens: str) -> str:
    """Units of runs of pieces in u; a piece for which ``opens`` holds opens one."""
    return f"""WITH {ctes},
    f AS (SELECT *, CASE WHEN unit_idx = 0 OR ({opens}) THEN 1 ELSE 0 END AS opens FROM (SELECT *, lag(piece) OVER (PARTITION BY id ORDER BY unit_idx) AS before FROM u)),
    g AS (SELECT *, sum(opens) OVER (PARTITION BY id ORDER BY unit_idx ROWS UNBOUNDED PRECEDING) AS grp FROM f)
    SELECT id AS doc_id, CAST(grp - 1 AS INTEGER) AS unit_idx, min(s) AS s, max(e) AS e FROM g GROUP BY id, grp"""


_WORDS = rf"len(regexp_extract_all({{x}}, '[^ \t\n\r\f]+'))"
_BEGINS = "|".join(sorted(set(CONNECTIVES.split())))
_TOKENS = rf"""
    tk AS (SELECT id, unnest(ts) AS token, generate_subscripts(ts, 1) - 1 AS k FROM (SELECT id, regexp_extract_all(text, '({series.TOKEN_PATTERN})', 1) AS ts FROM texts)),
    bg AS (SELECT id, k, token, coalesce(lag(token) OVER w, '') AS prev, sum(length(token)) OVER w - length(token) AS char_s FROM tk WINDOW w AS (PARTITION BY id ORDER BY k)),
    cnt AS (SELECT prev, token, count(*) AS n FROM bg GROUP BY prev, token)"""
_MODEL = f"""{sql.DOCUMENTS},{_TOKENS},
    voc AS (SELECT count(DISTINCT token) AS v FROM cnt),
    per AS (SELECT prev, sum(n) AS total, count(*) AS kinds, max(CASE WHEN token IN ('.', '!', '?', chr(10)) THEN n ELSE 0 END) AS sep_n FROM cnt GROUP BY prev),
    ent AS (SELECT c.prev, any_value(total) AS total, any_value(sep_n) AS sep_n, any_value(v) AS v,
        -sum((n + 1) / (total + v) * ln((n + 1) / (total + v))) - (any_value(v) - any_value(kinds)) / (any_value(total) + any_value(v)) * ln(1.0::DOUBLE / (any_value(total) + any_value(v))) AS entropy
        FROM cnt c JOIN per ON c.prev = per.prev, voc GROUP BY c.prev),
    sc AS (SELECT bg.*, entropy, ln((total + v) / (n + 1)::DOUBLE) AS surprisal, ln((sep_n + 1) / (n + 1)::DOUBLE) AS gap FROM bg JOIN cnt ON bg.prev = cnt.prev AND bg.token = cnt.token JOIN ent ON bg.prev = ent.prev)"""
_MARKS = "('.', '!', '?', chr(10))"


def _decided_sql(score: str, w: int, q: float, flat: bool = False) -> str:
    delta = "(m1 - m0) / sqrt(v0 + 1e-6)" if flat else "m1 - m0"
    return f"""WITH {_MODEL},
    win AS (SELECT id, k, char_s, lag(token) OVER o AS before, avg({score}) OVER (o ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING) AS m0, avg({score}) OVER (o ROWS BETWEEN CURRENT ROW AND {w - 1} FOLLOWING) AS m1,
        var_pop({score}) OVER (o ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING) AS v0, count(*) OVER (PARTITION BY id) AS n FROM sc WINDOW o AS (PARTITION BY id ORDER BY k)),
    cand AS (SELECT id, char_s, {delta} AS delta FROM win WHERE k >= {w} AND k < n - {w} AND before IN {_MARKS})
    {_beyond(q, False)}"""


def _beyond(q: float, high: bool) -> str:
    return f""",
    z AS (SELECT id, char_s, round((delta - avg(delta) OVER p) / (stddev_pop(delta) OVER p + 1e-6), 9) AS z FROM cand WINDOW p AS (PARTITION BY id)),
    cut AS (SELECT id, round(quantile_cont(z, {q}), 9) AS cut FROM z GROUP BY id)
    SELECT z.id AS doc_id, CAST(char_s AS INTEGER) AS b FROM z JOIN cut ON z.id = cut.id WHERE z.z {'>' if high else '<'} cut""".replace(",\n    z AS", ", z AS", 1)


def _named(scheme: str) -> str:
    return "CASE label " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in coherence.SCHEMES[scheme].items()) + " END"


_RUN_OF = """, o AS (SELECT *, CASE WHEN label IS DISTINCT FROM lag(label) OVER (PARTITION BY id ORDER BY unit_idx) THEN 1 ELSE 0 END AS opens FROM l),
    rr AS (SELECT *, sum(opens) OVER (PARTITION BY id ORDER BY unit_idx ROWS UNBOUNDED PRECEDING) AS run FROM o),
    runs AS (SELECT id, CAST(run - 1 AS INTEGER) AS seg_idx, min(s) AS s, max(e) AS e, max(label) AS label FROM rr GROUP BY id, run)"""
_LABELLED = (
    sql.DOCUMENTS + "," + sql.units() + ", l AS (SELECT id, unit_idx, s, e, CASE "
    + " ".join(f"WHEN regexp_matches(lower(piece), '(^|[^\\p{{L}}\\p{{N}}])({'|'.join(keys)})($|[^\\p{{L}}\\p{{N}}])') THEN '{label}'" for label, keys in coherence.KEYWORDS if keys)
    + f" ELSE '{coherence.KEYWORDS[-1][0]}' END AS label FROM u)" + _RUN_OF
)


def _zero_shot_sql(scheme: str) -> str:
    """Labels by the words of a unit that begin like a word of a label; of equal ones the first."""
    count = "len(list_filter(ws, lambda w: {}))"
    hits = [" + ".join(count.format(f"left(w, 5) = '{part[:5].lower()}'") for part in label.split()) for label in coherence.LABEL_SETS[scheme]]
    names = ", ".join(f"'{x}'" for x in coherence.LABEL_SETS[scheme])
    micro = _grouped(f"{sql.DOCUMENTS},{sql.units()}", _MICRO)
    return f"""WITH m AS ({micro}), w AS (SELECT doc_id AS id, unit_idx, s, e, regexp_extract_all(lower(substring(text, s + 1, e - s)), '[\\p{{L}}\\p{{N}}]+') AS ws FROM m JOIN documents USING (doc_id)),
        h AS (SELECT id, unit_idx, s, e, [{', '.join(hits)}] AS hs FROM w), l AS (SELECT id, unit_idx, s, e, [{names}][list_position(hs, list_max(hs))] AS label FROM h) {_RUN_OF}
        SELECT id AS doc_id, seg_idx, s, e, label FROM runs"""


_MICRO = rf"{_WORDS.format(x='piece')} >= 3 AND length(regexp_replace(piece, '^{_SPACE}+|{_SPACE}+$', '', 'g')) >= 10"

#: Score of a premise's and a hypothesis' words, null without a hypothesis.
_SHARE = "(CASE WHEN len({t}) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect({p}, {t}))::DOUBLE / len({t}) END)"
_ENTAILED = f"CASE WHEN {{t}} IS NOT NULL THEN least(greatest({_SHARE} + 0.4::DOUBLE * ((1.0::DOUBLE - {_SHARE}) / 2.0::DOUBLE), 0.0::DOUBLE), 1.0::DOUBLE) END"

ORACLE_SQL = {
    "mask_spans": f"""WITH {sql.DOCUMENTS},
        m AS (SELECT id, n, regexp_extract_all(text, '{MASK_PATTERN}') AS bs, regexp_split_to_array(text, '{MASK_PATTERN}') AS gs FROM texts),
        j AS (SELECT id, n, len(bs) AS n_blocks, array_to_string(list_transform(list_zip(gs, bs), lambda z: z[1] || coalesce(repeat('x', length(z[2])), '')), '') AS masked FROM m)
        SELECT id AS doc_id, CAST(n_blocks AS INTEGER) AS n_blocks, md5(masked) AS digest, CAST(length(masked) - n AS INTEGER) AS drift FROM j""",
    "units_sentence": _tiles(f"{sql.DOCUMENTS},{sql.units()}"),
    "units_clause": _grouped(
        f"{sql.DOCUMENTS},{sql.units(CLAUSE_PATTERN)}",
        rf"regexp_matches(before, '[.!?\n]{_SPACE}*$') OR (regexp_matches(before, '[;:]{_SPACE}*$') AND {_WORDS.format(x='before')} >= 4) OR (regexp_matches(before, ',{_SPACE}*$') AND {_WORDS.format(x='before')} >= 4 AND regexp_matches(lower(piece), '^({_BEGINS}){_SPACE}'))",
    ),
    "unit_micro_merge": _grouped(f"{sql.DOCUMENTS},{sql.units()}", _MICRO),
    "unit_overlap_merge": f"""WITH {_GOLD},
        f AS (SELECT *, CASE WHEN s >= max(e) OVER (PARTITION BY id ORDER BY s, e, o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS opens FROM gp),
        g AS (SELECT *, sum(opens) OVER (PARTITION BY id ORDER BY s, e, o ROWS UNBOUNDED PRECEDING) AS grp FROM f)
        SELECT id, CAST(grp AS INTEGER) AS seg_idx, min(s) AS s, max(e) AS e FROM g GROUP BY id, grp""",
    "clean_offsets": f"""WITH {_GOLD},{sql.cleaned('c', 'gp', 'o')}
        SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY o) - 1 AS INTEGER) AS seg_idx, CAST(s AS INTEGER) AS s, e FROM c""",
    "seg_newline_line": _numbered(f"{sql.DOCUMENTS},{sql.delimited('chr(10)', 'nl')}", "nl"),
    "seg_newline_para": _numbered(f"{sql.DOCUMENTS},{sql.delimited('chr(10) || chr(10)', 'nl')}", "nl"),
    "seg_marker_rules": _numbered(f"{sql.DOCUMENTS},{sql.units()},{sql.marked('mk')}", "mk"),
    "seg_marker_rules_custom": _numbered(f"{sql.DOCUMENTS},{sql.units()},{sql.marked('mk', engines.marker_pattern(CUSTOM_MARKERS))}", "mk"),
    "seg_every": _numbered(f"{sql.DOCUMENTS},{sql.chunked('ch')}", "ch"),
    "marker_family_counts": "WITH u AS (SELECT source, unnest(regexp_extract_all(text, '(" + SENTENCE_PATTERN + ")', 1)) AS unit FROM documents WHERE text IS NOT NULL) SELECT source, count(*) AS units, "
    + ", ".join(f"CAST(sum(CAST(regexp_matches(lower(unit), '{engines.marker_pattern(m)}') AS BIGINT)) AS BIGINT) AS {f}" for f, m in engines.MARKERS.items())
    + " FROM u GROUP BY source",
    "rle_merge_a": f"WITH {_RUNS} SELECT id, seg_idx, s, e, label FROM runs",
    "rle_merge_b": f"""WITH {_RUNS},
        kept AS (SELECT * FROM (SELECT *, max(seg_idx) OVER (PARTITION BY id) AS top FROM runs) WHERE top = 0 OR seg_idx < top)
        SELECT id, seg_idx, CASE WHEN seg_idx = 0 THEN 0 ELSE s END AS s, CAST(coalesce(lead(s) OVER (PARTITION BY id ORDER BY seg_idx), n) AS INTEGER) AS e, label FROM kept""",
    "context_window_prompts": f"""WITH {_HA},
        t AS (SELECT id, unit_idx, substring(text, s + 1, e - s) AS x FROM ha),
        c AS (SELECT id, unit_idx, x, first_value(x) OVER w AS f, last_value(x) OVER w AS l FROM t WINDOW w AS (PARTITION BY id ORDER BY unit_idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
        v AS (SELECT id, unit_idx, CASE WHEN x = f THEN '[START OF TRACE]' ELSE f END AS previous, x AS target, CASE WHEN x <> f AND x = l THEN '[END OF TRACE]' ELSE l END AS next FROM c)
        SELECT *, md5('Before: ' || previous || chr(10) || 'Target: ' || target || chr(10) || 'After: ' || next || chr(10) || 'Answer:') AS prompt FROM v""",
    "reply_parsing": f"WITH {_HA} SELECT id, unit_idx, label, CAST(s AS INTEGER) AS s, CAST(e AS INTEGER) AS e FROM ha",
    "lm_bigram_counts": f"WITH {sql.DOCUMENTS},{_TOKENS} SELECT prev, token, n FROM cnt",
    "tok_surprisal": f"WITH {_MODEL} SELECT id AS doc_id, count(*) AS tokens, round(avg(surprisal), 6) AS surprisal, round(avg(entropy), 6) AS entropy, round(avg(gap), 6) AS gap FROM sc GROUP BY id",
    "seg_surprisal": _decided_sql("surprisal", 15, 0.1),
    "seg_entropy": _decided_sql("entropy", 30, 0.1),
    "seg_flatness": _decided_sql("surprisal", 15, 0.1, True),
    "seg_topk_shift": f"""WITH {sql.DOCUMENTS},{_TOKENS},
        top AS (SELECT prev, token, n / sum(n) OVER (PARTITION BY prev) AS p FROM (SELECT *, row_number() OVER (PARTITION BY prev ORDER BY n DESC, token) AS r FROM cnt) WHERE r <= 20),
        sp AS (SELECT * FROM (SELECT id, k, char_s, prev, lag(prev) OVER (PARTITION BY id ORDER BY k) AS prev2 FROM bg) WHERE prev IN {_MARKS} AND k >= 1),
        cx AS (SELECT DISTINCT prev, prev2 FROM sp),
        un AS (SELECT prev, prev2, token, max(p) AS p, max(q) AS q FROM (
            SELECT cx.prev, cx.prev2, token, p, 0.0 AS q FROM cx JOIN top ON cx.prev = top.prev UNION ALL SELECT cx.prev, cx.prev2, token, 0.0, p FROM cx JOIN top ON cx.prev2 = top.prev) GROUP BY ALL),
        js AS (SELECT prev, prev2, sqrt(greatest(0.0, 0.5 * sum(CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) ELSE 0 END))) AS delta FROM un GROUP BY ALL),
        cand AS (SELECT id, char_s, round(delta, 9) AS delta FROM sp JOIN js ON sp.prev = js.prev AND sp.prev2 = js.prev2)
        {_beyond(0.9, True)}""",
    "seg_forced": f"""WITH {_MODEL},
        b AS (SELECT id, k, token, char_s, gap, lag(token) OVER (PARTITION BY id ORDER BY k) AS before FROM sc),
        z AS (SELECT id, k, token, char_s, round((gap - avg(gap) OVER p) / (stddev_pop(gap) OVER p + 1e-6) + 2.0 * CASE WHEN before IN {_MARKS} THEN 1.0 WHEN before IN (',', chr(9)) THEN 0.5 ELSE 0.0 END, 9) AS z FROM b WINDOW p AS (PARTITION BY id)),
        cut AS (SELECT id, round(quantile_cont(z, 0.9), 9) AS cut FROM z GROUP BY id),
        fl AS (SELECT z.id, k, char_s, z.z > cut AND token NOT IN {_MARKS} AND k > 0 AS over_ FROM z JOIN cut ON z.id = cut.id),
        ag AS (SELECT *, coalesce(lag(over_) OVER (PARTITION BY id ORDER BY k), false) AS again FROM fl)
        SELECT id AS doc_id, CAST(char_s AS INTEGER) AS b FROM ag WHERE over_ AND NOT again""",
    "seg_keyword_labels": f"WITH {_LABELLED} SELECT id AS doc_id, seg_idx, s, e, label FROM runs",
    "seg_thought_anchor": f"WITH {_LABELLED} SELECT id AS doc_id, seg_idx, s, e, {_named('thought_anchor')} AS label FROM runs",
    "seg_reasoning_flow": f"WITH {_LABELLED} SELECT id AS doc_id, seg_idx, s, e, {_named('reasoning_flow')} AS label FROM runs",
    "seg_argument": f"""WITH {_LABELLED}, kept AS (SELECT * FROM (SELECT *, max(seg_idx) OVER (PARTITION BY id) AS top FROM runs) WHERE top = 0 OR seg_idx < top)
        SELECT kept.id AS doc_id, seg_idx, CASE WHEN seg_idx = 0 THEN 0 ELSE s END AS s, CAST(coalesce(lead(s) OVER (PARTITION BY kept.id ORDER BY seg_idx), n) AS INTEGER) AS e, {_named('argument')} AS label FROM kept JOIN texts ON kept.id = texts.id""",
    "seg_unit_groups": f"WITH {sql.DOCUMENTS},{sql.units()} SELECT id AS doc_id, CAST(unit_idx // 3 AS INTEGER) AS seg_idx, min(s) AS s, max(e) AS e FROM u GROUP BY id, unit_idx // 3",
    "seg_step_reward": f"""WITH RECURSIVE {sql.DOCUMENTS},{sql.units()},
        sc AS (SELECT id, unit_idx AS k, e, len(regexp_extract_all(piece, '[0-9]'))::DOUBLE / (e - s) AS v FROM u),
        dl AS (SELECT id, k, e, lead(e) OVER w AS e1, abs(avg(v) OVER (w ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) - coalesce(avg(v) OVER (w ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), v)) AS d FROM sc WINDOW w AS (PARTITION BY id ORDER BY k)),
        z AS (SELECT id, k, e, e1, round((d - avg(d) OVER p) / (stddev_pop(d) OVER p + 1e-6), 9) AS z FROM dl WINDOW p AS (PARTITION BY id)),
        q AS (SELECT id, round(quantile_cont(z, 0.6), 9) AS bar FROM z GROUP BY id),
        c AS (SELECT z.id, k, e, e1 FROM z JOIN q ON z.id = q.id WHERE e1 IS NOT NULL AND z > bar * (0.5::DOUBLE + 0.5::DOUBLE * least(k / 5.0::DOUBLE, 1.0::DOUBLE))),
        r AS (SELECT DISTINCT id, -1 AS k, NULL::INTEGER AS b, 0 AS cur FROM c
            UNION ALL SELECT r.id, min(c.k), min_by(c.e, c.k), min_by(c.e1, c.k) FROM r JOIN c ON r.id = c.id AND c.k > r.k AND c.e - r.cur > 4 GROUP BY r.id)
        SELECT id AS doc_id, b FROM r WHERE b IS NOT NULL""",
    "seg_entailment": f"""WITH RECURSIVE m AS ({_grouped(f"{sql.DOCUMENTS},{sql.units()}", _MICRO)}),
        w AS (SELECT doc_id AS id, unit_idx AS i, s, e, list_distinct(regexp_extract_all(lower(substring(text, s + 1, e - s)), '[\\p{{L}}\\p{{N}}]+')) AS ws FROM m JOIN documents USING (doc_id)),
        x AS (SELECT *, lag(ws) OVER o AS p1, list_distinct(list_concat(lag(ws, 2) OVER o, lag(ws) OVER o)) AS p2, lead(ws) OVER o AS nx FROM w WINDOW o AS (PARTITION BY id ORDER BY i)),
        f AS (SELECT id, i, {', '.join(f"{_ENTAILED.format(p=p, t=t)} AS {name}" for name, p, t in (('a1', 'p1', 'ws'), ('a2', 'p2', 'ws'), ('b1', 'p1', 'nx'), ('b2', 'p2', 'nx')))} FROM x),
        r AS (SELECT id, i, 0 AS head, 0.85::DOUBLE AS av FROM w WHERE i = 0
            UNION ALL
            SELECT id, i, CASE WHEN joins THEN head ELSE i END, CASE WHEN joins THEN 0.7::DOUBLE * av + 0.3::DOUBLE * score ELSE 0.85::DOUBLE END FROM (
                SELECT f.id, f.i, head, av, CASE WHEN f.i - head >= 2 THEN a2 ELSE a1 END AS score,
                    CASE WHEN f.i - head >= 2 THEN a2 ELSE a1 END >= greatest(av - 0.15::DOUBLE, 0.25::DOUBLE) OR coalesce(CASE WHEN f.i - head >= 2 THEN b2 ELSE b1 END, 0.0::DOUBLE) >= greatest(av - 0.15::DOUBLE, 0.25::DOUBLE) AS joins
                FROM r JOIN f ON r.id = f.id AND f.i = r.i + 1))
        SELECT r.id AS doc_id, CAST(row_number() OVER (PARTITION BY r.id ORDER BY head) - 1 AS INTEGER) AS seg_idx, min(s) AS s, max(e) AS e FROM r JOIN w ON r.id = w.id AND r.i = w.i GROUP BY r.id, head""",
    "seg_zero_shot": _zero_shot_sql("reasoning_flow"),
    "seg_zero_shot_ta": _zero_shot_sql("thought_anchor"),
    "seg_offset_chunks": f"""WITH RECURSIVE {sql.DOCUMENTS},
        r AS (SELECT id, text, n, 0 AS i, CAST([] AS STRUCT(s INTEGER, e INTEGER)[]) AS sp FROM texts
            UNION ALL
            SELECT id, text, n, CAST(i + list_sum(w) AS INTEGER), list_transform(range(1, len(w) + 1), lambda k: {{'s': CAST(i + coalesce(list_sum(w[:k - 1]), 0) AS INTEGER), 'e': CAST(i + list_sum(w[:k]) AS INTEGER)}})
            FROM (SELECT id, text, n, i, CASE WHEN len(x) = 0 THEN [length(p)] ELSE list_transform(x, lambda y: length(y)) END AS w
                FROM (SELECT id, text, n, i, p, regexp_extract_all(p, '[^.!?\n]*[.!?\n]+[ \t\n\r\f]*') AS x FROM (SELECT id, text, n, i, substring(text, i + 1, 300) AS p FROM r WHERE i < n - 20)))),
        a AS (SELECT id, unnest(sp) AS x FROM r UNION ALL SELECT id, {{'s': i, 'e': CAST(n AS INTEGER)}} FROM r WHERE i >= n - 20 AND i < n)
        SELECT id AS doc_id, CAST(row_number() OVER (PARTITION BY id ORDER BY x.s, x.e) - 1 AS INTEGER) AS seg_idx, x.s AS s, x.e AS e FROM a""",
    "topic_terms": """WITH w AS (SELECT domain, unnest(regexp_extract_all(lower(text), '([a-z]{3,})', 1)) AS term FROM documents WHERE text IS NOT NULL AND domain IS NOT NULL),
        c AS (SELECT domain, term, count(*) AS n FROM w GROUP BY ALL), s AS (SELECT domain, sum(n) AS size FROM c GROUP BY domain), m AS (SELECT avg(size) AS m FROM s), a AS (SELECT term, sum(n) AS all_n FROM c GROUP BY term),
        x AS (SELECT c.domain, c.term, n, round(n / size * ln(1 + m / all_n), 9) AS weight FROM c JOIN s ON c.domain = s.domain JOIN a ON c.term = a.term, m)
        SELECT domain, term, n, round(weight, 6) AS weight, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY weight DESC, term) AS rank FROM x) WHERE rank <= 10""",
}
