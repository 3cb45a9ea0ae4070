"""Named queries over the driver's tables, each with the SQL that another engine answers it with.

The tables stand in for scans: documents are recognised pages, conversations are
pages whose turns are boxes, events are an append-only label log, embeddings are
8x8 grey pages; nine defect scores of a document come from its id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import DEFAULTS, SPLIT_PARTS, manual_labels
from ..functions import scoring as S
from ..functions import text as X
from ..operators import baseline as B
from ..operators import evaluation as E
from ..operators import labels as L
from ..operators import patches as T
from ..operators import pages as G
from ..operators import pixels as P
from ..operators import split as D
from ..operators import synth as Y
from ..operators.ordered import quantiles
from ..storage import written

OCR, SYNTH, VERDICT = DEFAULTS["ocr"], DEFAULTS["synth"], DEFAULTS["verdict"]
SCORED = list(DEFAULTS["scores"])
#: The corpus overlay of the flagship: anchors that spread these documents over all verdicts.
TEXT_ANCHORS = {"garbage_ratio": (0.05, 0.40), "nonword_ratio": (0.008, 0.036)}
#: A multiplier for each scored label, which makes the stand-in scores.
SPREAD = dict(zip(SCORED, (37, 101, 59, 211, 83, 149, 23, 307, 173), strict=True))

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):  # noqa: ANN201
    def put(fn: Callable[[SparkSession, str], DataFrame]):  # noqa: ANN202
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return put


def _sql_class(chars: str) -> str:
    return X._class(chars).replace("'", "''")


_EXTRA = _sql_class("".join(OCR["extra_chars"].split()))
_STRIP = _sql_class(X.STRIPPED)
def _of(sql: str, text: str) -> str:
    return sql.replace("@t", text)


_SOLID = r"regexp_replace(@t, '\s+', '', 'g')"
_GARBAGE = "length(regexp_replace(" + _SOLID + f", '[A-Za-z{_EXTRA}]', '', 'g'))"
_WORDS = rf"[w for w in [regexp_replace(x, '^[{_STRIP}]+|[{_STRIP}]+$', '', 'g') for x in regexp_split_to_array(@t, '\s+')] if w <> '']"
_BAD = r"""CASE WHEN regexp_full_match(w, '\p{Nd}+') THEN false
 WHEN length(regexp_replace(w, '[^\p{L}]', '', 'g')) = 0 THEN length(w) > 2
 WHEN length(regexp_replace(w, '[^\p{L}]', '', 'g')) >= 3 AND NOT regexp_matches(lower(w), '[aeiouy]') THEN true
 ELSE length(regexp_replace(w, '[^\p{L}]', '', 'g')) >= 2 AND regexp_matches(w, '\p{Nd}') END"""
_TEXT = f"""words AS (SELECT doc_id, lang, {_of(_GARBAGE, "coalesce(text, '')")} AS garbage, length({_of(_SOLID, "coalesce(text, '')")}) AS solid,
 {_of(_WORDS, "coalesce(text, '')")} AS ws FROM documents),
ratios AS (SELECT doc_id, lang, CASE WHEN solid = 0 THEN 0 ELSE garbage::DOUBLE / solid END AS garbage_ratio,
 CASE WHEN len(ws) = 0 THEN 0 ELSE len([w for w in ws if {_BAD}])::DOUBLE / len(ws) END AS nonword_ratio, len(ws) AS n_words FROM words)"""


def _anchor_sql(v: str, good: float, bad: float) -> str:
    return f"least(1::DOUBLE, greatest(0::DOUBLE, ({v} - {good}::DOUBLE) / {bad - good!r}::DOUBLE))"


def _ratios(spark: SparkSession, sf_dir: str, only: DataFrame | None = None) -> DataFrame:
    """Ratios of all documents, or of those whose doc_id is in only."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    d = d if only is None else d.join(only, "doc_id", "left_semi")
    d = d.repartition(2 * spark.sparkContext.defaultParallelism)  # a file of a few row groups would keep as few tasks busy
    return d.select("doc_id", "lang", X.garbage_ratio(F.col("text"), OCR["languages"], OCR["extra_chars"]).alias("garbage_ratio"), X.nonword_ratio(F.col("text"), OCR["languages"]).alias("nonword_ratio"))


@query(f"WITH {_TEXT} SELECT doc_id, round(garbage_ratio, 6) AS garbage_ratio FROM ratios")
def q_garbage_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.round(X.garbage_ratio(F.col("text"), OCR["languages"], OCR["extra_chars"]), 6).alias("garbage_ratio"))


@query(f"WITH {_TEXT} SELECT doc_id, round(nonword_ratio, 6) AS nonword_ratio FROM ratios")
def q_nonword_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.round(X.nonword_ratio(F.col("text"), OCR["languages"]), 6).alias("nonword_ratio"))


_CONF = "((conv_id * 7919 + turn * 104729) % 1000) / 1000.0::DOUBLE"
_OCR = f"""boxes AS (SELECT conv_id, {_CONF} AS c, coalesce(text, '') AS t FROM conversations),
counts AS (SELECT conv_id, c, {_of(_GARBAGE, "t")} AS g, length({_of(_SOLID, "t")}) AS s, length(t) * 10 AS area, {_of(_WORDS, "t")} AS ws FROM boxes),
ocr AS (SELECT conv_id, round(coalesce(avg(CASE WHEN c >= 0.3 THEN c END), 0), 4) AS mean_confidence,
 round(CASE WHEN sum(s) = 0 THEN 0 ELSE sum(g)::DOUBLE / sum(s)::DOUBLE END, 4) AS garbage_ratio,
 round(CASE WHEN sum(len(ws)) = 0 THEN 0 ELSE sum(len([w for w in ws if {_BAD}]))::DOUBLE / sum(len(ws))::DOUBLE END, 4) AS nonword_ratio,
 round(least(1::DOUBLE, sum(area)::DOUBLE / 100000), 4) AS text_density, count(*) AS n_boxes FROM counts GROUP BY conv_id)"""


def _ocr(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    g, s = X.garbage_counts(F.col("text"), OCR["languages"], OCR["extra_chars"])
    b, n = X.nonword_counts(F.col("text"), OCR["languages"])
    rows = c.select("conv_id", (((F.col("conv_id") * 7919 + F.col("turn") * 104729) % 1000) / F.lit(1000.0)).alias("c"), g.alias("g"), s.alias("s"), b.alias("b"), n.alias("n"), (F.coalesce(F.length("text"), F.lit(0)) * 10).alias("area"))
    return rows.groupBy("conv_id").agg(
        F.round(F.coalesce(F.avg(F.when(F.col("c") >= OCR["min_confidence"], F.col("c"))), F.lit(0.0)), 4).alias("mean_confidence"),
        F.round(X.ratio(F.sum("g"), F.sum("s")), 4).alias("garbage_ratio"),
        F.round(X.ratio(F.sum("b"), F.sum("n")), 4).alias("nonword_ratio"),
        F.round(F.least(F.lit(1.0), F.sum("area").cast("double") / 100000), 4).alias("text_density"),
        F.count(F.lit(1)).alias("n_boxes"),
    )


@query(f"WITH {_OCR} SELECT * FROM ocr")
def q_ocr_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ocr(spark, sf_dir)


_UNREADABLE = ", ".join(_anchor_sql(k, a["good"], a["bad"]) for k, a in OCR["unreadable"].items())


@query(f"WITH {_OCR} SELECT conv_id, CASE WHEN n_boxes >= 5 THEN round(greatest({_UNREADABLE}), 4) END AS unreadable FROM ocr")
def q_unreadable(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _ocr(spark, sf_dir)
    return o.select("conv_id", X.unreadable(F.col("n_boxes"), {k: F.col(k) for k in OCR["unreadable"]}, OCR["unreadable"], OCR["min_boxes"]).alias("unreadable"))


_FLAG = f"greatest({', '.join(_anchor_sql(k, *a) for k, a in TEXT_ANCHORS.items())})"


@query(f"""WITH {_TEXT}, scored AS (SELECT lang, round({_FLAG}, 4) AS s FROM ratios)
SELECT lang, CASE WHEN s > 0.6 THEN 'bad' WHEN s > 0.3 THEN 'acceptable' ELSE 'good' END AS verdict, count(*) AS pages, round(avg(s), 6) AS mean_score, max(s) AS max_score FROM scored GROUP BY 1, 2""")
def q_verdict_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _ratios(spark, sf_dir)
    s = F.round(F.greatest(*[S.anchor_score(F.col(k), *a) for k, a in TEXT_ANCHORS.items()]), 4)
    rows = r.select("lang", s.alias("s")).withColumn("verdict", S.verdict(F.create_map(F.lit("text"), F.col("s")), VERDICT["tau_low"], VERDICT["tau_high"], VERDICT["tau_unreadable"]))
    return rows.groupBy("lang", "verdict").agg(F.count(F.lit(1)).alias("pages"), F.round(F.avg("s"), 6).alias("mean_score"), F.max("s").alias("max_score"))


# Raw metrics: order lines as pages.
_LINES = "l_orderkey, l_linenumber, l_quantity AS line_height_px, l_discount * 10 AS tenengrad_norm, l_tax AS mid_tone_frac, l_extendedprice / 1000 AS ink_paper_gap, l_linenumber - 2 AS n_lines, l_tax * 150 AS noise_sigma"
_METRICS = ("blur", "low_resolution", "low_contrast", "noise")
_SKIPS = "[x for x in [CASE WHEN mid_tone_frac < 0.05 THEN 'low_contrast' END, CASE WHEN n_lines <= 0 THEN 'low_resolution' END, CASE WHEN mid_tone_frac < 0.05 THEN 'noise' END] if x IS NOT NULL]"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    m = li.select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("line_height_px"), (F.col("l_discount") * 10).alias("tenengrad_norm"), F.col("l_tax").alias("mid_tone_frac"), (F.col("l_extendedprice") / 1000).alias("ink_paper_gap"), (F.col("l_linenumber") - 2).alias("n_lines"), (F.col("l_tax") * 150).alias("noise_sigma"))
    return m.withColumn("skip", S.not_applicable(F.col("mid_tone_frac"), F.col("n_lines"), DEFAULTS["cv"]["bitonal_max_mid_frac"]))


_SCORES = ", ".join(f"CASE WHEN NOT list_contains({_SKIPS}, '{k}') THEN round({_anchor_sql(DEFAULTS['scores'][k]['metric'], DEFAULTS['scores'][k]['good'], DEFAULTS['scores'][k]['bad'])}, 4) END AS {k}" for k in _METRICS)
_SCORED = f"scored AS (SELECT l_orderkey, l_linenumber, {_SCORES} FROM (SELECT {_LINES} FROM lineitem))"


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir)
    cols = S.score_columns({k: DEFAULTS["scores"][k] for k in _METRICS}, F.col("skip"))
    return rows.select("l_orderkey", "l_linenumber", *[c.alias(k) for k, c in cols.items()])


@query(f"WITH {_SCORED} SELECT * FROM scored")
def q_anchor_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir)


@query(f"SELECT l_orderkey, l_linenumber, array_to_string({_SKIPS}, ',') AS not_applicable FROM (SELECT {_LINES} FROM lineitem)")
def q_not_applicable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("l_orderkey", "l_linenumber", F.array_join("skip", ",").alias("not_applicable"))


@query(f"WITH {_SCORED} SELECT l_orderkey, l_linenumber, coalesce(round(1 - greatest({', '.join(_METRICS)}), 4), 1) AS quality, CASE WHEN coalesce(greatest({', '.join(_METRICS)}), 0) > 0.6 THEN 'bad' WHEN coalesce(greatest({', '.join(_METRICS)}), 0) > 0.3 THEN 'acceptable' ELSE 'good' END AS verdict FROM scored")
def q_quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = S.score_map({k: F.col(k) for k in _METRICS})
    return _scored(spark, sf_dir).select("l_orderkey", "l_linenumber", S.quality(m).alias("quality"), S.verdict(m, VERDICT["tau_low"], VERDICT["tau_high"], VERDICT["tau_unreadable"]).alias("verdict"))


# Prelabels: nine scores of every document.
_PRE = "pre AS (SELECT doc_id, source, " + ", ".join(f"(doc_id * {m} % 1000) / 1000.0::DOUBLE AS {k}" for k, m in SPREAD.items()) + " FROM documents)"
_LONG = "long AS (" + " UNION ALL ".join(f"SELECT doc_id, source, {i} AS place, '{k}' AS label, {k} AS score FROM pre" for i, k in enumerate(SCORED)) + ")"
_TOP = f"greatest({', '.join(SCORED)})"


def _pre(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image, document, scores."""
    d = table(spark, sf_dir, "documents")
    pairs = [x for k, m in SPREAD.items() for x in (F.lit(k), (F.col("doc_id") * m % 1000) / F.lit(1000.0))]
    return d.select(F.col("doc_id").alias("image"), F.col("source").alias("document"), F.create_map(*pairs).alias("scores"))


@query(f"WITH {_PRE} SELECT doc_id, {_TOP} AS suspicion FROM pre")
def q_suspicion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pre(spark, sf_dir).select(F.col("image").alias("doc_id"), S.suspicion(F.col("scores")).alias("suspicion"))


@query(f"WITH {_PRE}, {_LONG} SELECT doc_id, coalesce(string_agg(CASE WHEN score >= 0.3 THEN label END, ',' ORDER BY label), '') AS suggested, count(*) AS n_scored FROM long GROUP BY doc_id")
def q_suggested_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = S.suggested(F.col("scores"), manual_labels(DEFAULTS), DEFAULTS["labeling"]["suggest_threshold"])
    return _pre(spark, sf_dir).select(F.col("image").alias("doc_id"), got.alias("m")).select("doc_id", F.array_join(S.positive(F.col("m")), ",").alias("suggested"), F.size("m").cast("long").alias("n_scored"))


@query(f"WITH {_PRE}, {_LONG} SELECT doc_id, rank, label, score FROM (SELECT doc_id, label, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, place) AS rank FROM long) WHERE rank <= 4 AND score > 0.05")
def q_top_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = F.slice(S.ranked_defects(F.col("scores"), SCORED), 1, 4)
    return _pre(spark, sf_dir).select(F.col("image").alias("doc_id"), F.posexplode(ranked).alias("p", "d")).where("d.score > 0.05").select("doc_id", (F.col("p") + 1).cast("long").alias("rank"), "d.label", "d.score")


@query(f"WITH {_PRE}, {_LONG} SELECT doc_id, string_agg(label || ':' || CAST(CAST(round(score * 1000) AS BIGINT) AS VARCHAR), ',' ORDER BY score DESC, place) AS defects, round(1 - max(score), 4) AS quality_score, CASE WHEN max(score) > 0.6 THEN 'bad' WHEN max(score) > 0.3 THEN 'acceptable' ELSE 'good' END AS verdict FROM long GROUP BY doc_id")
def q_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("scores")
    defects = F.array_join(F.transform(S.ranked_defects(s, SCORED), lambda e: F.concat(e["label"], F.lit(":"), F.round(e["score"] * 1000).cast("long").cast("string"))), ",")
    return _pre(spark, sf_dir).select(F.col("image").alias("doc_id"), defects.alias("defects"), S.quality(s).alias("quality_score"), S.verdict(s).alias("verdict"))


@query(f"WITH {_PRE}, {_LONG} SELECT label, rank, doc_id, score FROM (SELECT label, doc_id, score, row_number() OVER (PARTITION BY label ORDER BY score DESC, md5('42:' || doc_id), doc_id) AS rank FROM long) WHERE rank <= 150")
def q_label_queue_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = L.top_candidates(_pre(spark, sf_dir), SCORED, 150, DEFAULTS["labeling"]["sample_seed"])
    return top.select("label", F.col("rank").cast("long").alias("rank"), F.col("image").alias("doc_id"), "score")


_LABELING = DEFAULTS["labeling"]
#: The queue in SQL: a random part, then each label in turn takes its best page that isn't in the queue.
_QUEUE = f"""{_PRE}, {_LONG}, sized AS (SELECT least({_LABELING['sample_total']}, count(*))::INT AS total FROM documents),
picked AS (SELECT doc_id FROM documents, sized ORDER BY md5('{_LABELING['sample_seed']}:' || doc_id), doc_id LIMIT (SELECT floor(total * {_LABELING['random_share']})::INT FROM sized)),
placed AS (SELECT place, doc_id, row_number() OVER (PARTITION BY place ORDER BY score DESC, md5('{_LABELING['sample_seed']}:' || doc_id), doc_id) AS nth FROM long WHERE doc_id NOT IN (SELECT doc_id FROM picked)),
best AS MATERIALIZED (SELECT place, list(doc_id ORDER BY nth) AS ids FROM placed WHERE nth <= {_LABELING['sample_total']} GROUP BY place),
turns(i, chosen) AS (SELECT 0, (SELECT coalesce(list(doc_id), []) FROM picked) UNION ALL
 SELECT i + 1, list_append(chosen, list_filter(best.ids, lambda x: NOT list_contains(chosen, x))[1]) FROM turns JOIN best ON best.place = i % {len(SCORED)}, sized WHERE len(chosen) < total),
queue AS (SELECT unnest(chosen) AS doc_id FROM turns QUALIFY row_number() OVER (ORDER BY i DESC) = 1)"""


def _queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _LABELING
    return L.select_queue(_pre(spark, sf_dir), SCORED, c["sample_total"], c["random_share"], c["sample_seed"])


@query(f"WITH RECURSIVE {_QUEUE} SELECT doc_id AS image, row_number() OVER (ORDER BY md5('{_LABELING['sample_seed'] + 1}:' || doc_id), doc_id) - 1 AS pos FROM queue")
def q_label_queue_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _queue(spark, sf_dir).select("image", F.col("pos").cast("long").alias("pos"))


@query(f"WITH RECURSIVE {_QUEUE} SELECT label, count(*) FILTER (WHERE score >= 0.3 AND doc_id IN (SELECT doc_id FROM queue)) AS in_queue, count(*) FILTER (WHERE score >= 0.3) AS in_all FROM long GROUP BY label")
def q_queue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each label is suspected in the queue that people get, and in all pages."""
    queue = _queue(spark, sf_dir).select("image", F.lit(True).alias("q"))  # sample_total rows at most
    rows = _pre(spark, sf_dir).join(F.broadcast(queue), "image", "left").select(F.explode("scores").alias("label", "score"), F.coalesce("q", F.lit(False)).alias("q"))
    suspected = F.col("score") >= _LABELING["suggest_threshold"]
    return rows.groupBy("label").agg(F.sum((suspected & F.col("q")).cast("long")).alias("in_queue"), F.sum(suspected.cast("long")).alias("in_all"))


@query("SELECT doc_id, md5('42:' || doc_id) AS ord FROM documents ORDER BY ord, doc_id LIMIT 300")
def q_random_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.random_sample(table(spark, sf_dir, "documents"), "doc_id", 300, 42).select("doc_id", L.hashed_order(42, F.col("doc_id")).alias("ord"))


_STEM = r"regexp_replace(list_extract(string_split(url, '/'), -1), '(.)\.[^.]*$', '\1')"


@query(f"SELECT page_id, {_STEM} AS document FROM pages")
def q_document_id_stem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", S.document_id(F.col("url"), "stem").alias("document"))


@query("SELECT page_id, coalesce(list_extract(string_split(url, '/'), -2), '') AS document FROM pages")
def q_document_id_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", S.document_id(F.col("url"), "parent").alias("document"))


@query(rf"SELECT page_id, CASE WHEN regexp_replace({_STEM}, '[^0-9]', '', 'g') = '' THEN {_STEM} ELSE substr(regexp_replace({_STEM}, '[^0-9]', '', 'g'), 1, 7) END AS document FROM pages")
def q_document_id_bates7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", S.document_id(F.col("url"), "bates7").alias("document"))


# The event log as a label log.
@query("SELECT user_id, arg_max(event_id, event_id) AS event_id, arg_max(event_type, event_id) AS event_type, round(arg_max(value, event_id), 6) AS value, min(event_id) AS first_pos FROM events GROUP BY user_id")
def q_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    return L.last_wins(log, "user_id", ["event_id"]).select("user_id", "event_id", "event_type", F.round("value", 6).alias("value"), F.col("first_pos.event_id").alias("first_pos"))


@query("SELECT user_id, count(*) AS writes, count(DISTINCT event_type) AS kinds, min(event_id) AS first_write, max(event_id) AS last_write FROM events GROUP BY user_id")
def q_label_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("writes"), F.count_distinct("event_type").alias("kinds"), F.min("event_id").alias("first_write"), F.max("event_id").alias("last_write"))


@query("SELECT doc_id, 'quality' AS keys, coalesce(quality, 0) = 1 AS quality, true AS toxic FROM labels WHERE false UNION ALL SELECT doc_id, CASE WHEN toxic = 1 THEN 'quality,toxic,unreadable' ELSE 'quality,toxic' END, quality = 1, toxic = 1 FROM labels")
def q_history_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.create_map(F.lit("quality"), F.col("quality") == 1, F.lit("toxic"), F.lit(False))
    more = F.when(F.col("toxic") == 1, F.create_map(F.lit("toxic"), F.lit(True), F.lit("unreadable"), F.lit(True))).otherwise(F.create_map(F.lit("toxic"), F.lit(False)))
    rows = table(spark, sf_dir, "labels").select("doc_id", L.enrich(base, more).alias("labels"))
    return rows.select("doc_id", F.array_join(F.array_sort(F.map_keys("labels")), ",").alias("keys"), F.col("labels")["quality"].alias("quality"), F.col("labels")["toxic"].alias("toxic"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def q_prelabel_todo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.todo(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT doc_id FROM labels WHERE toxic <> 1")
def q_unlabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") == 1, F.create_map(F.lit("unreadable"), F.lit(True))).otherwise(F.create_map(F.lit("quality"), F.col("quality") == 1)).alias("labels"))
    return L.lacking(rows, "unreadable").select("doc_id")


@query("SELECT coalesce(min(doc_id), 0) AS pos FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def q_resume_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.resume_position(table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").alias("pos")), table(spark, sf_dir, "labels"), "doc_id")


# Splits: sources are documents, their documents are pages.
_SIZES = "sizes AS (SELECT source AS document, count(*) AS n FROM documents GROUP BY source), ordered AS (SELECT *, row_number() OVER (ORDER BY n DESC, md5('42:' || document), document) AS i FROM sizes), total AS (SELECT sum(n)::DOUBLE AS pages FROM sizes)"
_SPLIT = f"""{_SIZES},
fold(i, document, n, part, a, b, c) AS (
 SELECT 0::BIGINT, NULL::VARCHAR, 0::BIGINT, NULL::VARCHAR, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE
 UNION ALL
 SELECT o.i, o.document, o.n, p.part, f.a + CASE WHEN p.part = 'train' THEN o.n ELSE 0 END, f.b + CASE WHEN p.part = 'val' THEN o.n ELSE 0 END, f.c + CASE WHEN p.part = 'test' THEN o.n ELSE 0 END
 FROM fold f JOIN ordered o ON o.i = f.i + 1, total,
 LATERAL (SELECT CASE WHEN 0.2::DOUBLE * pages - f.a >= 0.3::DOUBLE * pages - f.b AND 0.2::DOUBLE * pages - f.a >= 0.5::DOUBLE * pages - f.c THEN 'train' WHEN 0.3::DOUBLE * pages - f.b >= 0.5::DOUBLE * pages - f.c THEN 'val' ELSE 'test' END AS part) p),
split AS (SELECT document, part, n FROM fold WHERE i > 0)"""


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = D.document_sizes(table(spark, sf_dir, "documents").select(F.col("source").alias("document")))
    return D.allocate(sizes, DEFAULTS["split"]["ratios"], DEFAULTS["split"]["seed"])


@query(f"WITH RECURSIVE {_SPLIT} SELECT document, part, n FROM split")
def q_split_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split(spark, sf_dir)


@query(f"WITH RECURSIVE {_SPLIT} SELECT part, count(*) AS n_documents, sum(n)::BIGINT AS n_images FROM split GROUP BY part")
def q_split_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.shares(_split(spark, sf_dir))


@query("WITH a AS (SELECT source AS document, CASE WHEN doc_id < 500 THEN 'train' ELSE 'test' END AS part FROM documents) SELECT document, count(DISTINCT part) AS parts FROM a GROUP BY document HAVING count(DISTINCT part) > 1")
def q_split_leak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A split by page number leaks; this finds where."""
    return D.leaks(table(spark, sf_dir, "documents").select(F.col("source").alias("document"), F.when(F.col("doc_id") < 500, "train").otherwise("test").alias("part")))


@query(f"WITH RECURSIVE {_SPLIT} SELECT d.doc_id, d.source FROM documents d WHERE d.source IN (SELECT document FROM split WHERE part IN ('val', 'test')) AND d.doc_id IN (SELECT doc_id FROM labels)")
def q_real_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    held = D.held_out(_split(spark, sf_dir)).withColumnRenamed("document", "source")
    return d.join(held, "source", "left_semi").join(table(spark, sf_dir, "labels"), "doc_id", "left_semi").select("doc_id", "source")


@query(f"WITH RECURSIVE {_SPLIT} SELECT doc_id, source FROM documents WHERE source NOT IN (SELECT document FROM split WHERE part IN ('val', 'test'))")
def q_synthetic_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = D.held_out(_split(spark, sf_dir)).withColumnRenamed("document", "source")
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(held, "source", "left_anti")


@query(f"""WITH RECURSIVE {_SPLIT}, {_PRE} SELECT p.doc_id, coalesce(l.clean, false) AS human, {_TOP} AS suspicion FROM pre p LEFT JOIN (SELECT DISTINCT doc_id, true AS clean FROM labels WHERE quality = 1 AND toxic = 0) l ON l.doc_id = p.doc_id
WHERE p.source NOT IN (SELECT document FROM split WHERE part IN ('val', 'test')) AND (coalesce(l.clean, false) OR {_TOP} <= 0.25) ORDER BY human DESC, suspicion, doc_id LIMIT 900""")
def q_reference_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0").select(F.col("doc_id").alias("image"))
    r = SYNTH["reference"]
    return D.references(_pre(spark, sf_dir), D.held_out(_split(spark, sf_dir)), clean, r["count"], r["max_defect_score"]).select(F.col("image").alias("doc_id"), "human", "suspicion")


_TRUTH = "truth AS (SELECT doc_id, 'quality' AS label, quality = 1 AS truth FROM labels UNION ALL SELECT doc_id, 'toxic', toxic = 1 FROM labels)"


@query("SELECT 0 AS place, 'quality' AS label, count(*) FILTER (WHERE quality = 1) AS n FROM labels UNION ALL SELECT 1, 'toxic', count(*) FILTER (WHERE toxic = 1) FROM labels UNION ALL SELECT 2, 'unreadable', 0 FROM labels WHERE false UNION ALL SELECT 2, 'unreadable', 0")
def q_label_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").select(F.create_map(F.lit("quality"), F.col("quality") == 1, F.lit("toxic"), F.col("toxic") == 1).alias("labels"))
    return L.frequencies(rows, ["quality", "toxic", "unreadable"])


@query(f"""WITH RECURSIVE {_SPLIT}, {_TRUTH}, c AS (SELECT t.label, s.part, count(*) FILTER (WHERE t.truth) AS n, count(*) AS k FROM truth t JOIN documents d USING (doc_id) JOIN split s ON s.document = d.source GROUP BY 1, 2),
w AS (SELECT label, coalesce(sum(n) FILTER (WHERE part = 'train'), 0)::BIGINT AS train, coalesce(sum(n) FILTER (WHERE part = 'val'), 0)::BIGINT AS val, coalesce(sum(n) FILTER (WHERE part = 'test'), 0)::BIGINT AS test, sum(k) AS total FROM c GROUP BY label)
SELECT label, train, val, test, CASE WHEN train + val + test = 0 THEN 'none' WHEN val = 0 OR test = 0 THEN 'missing' WHEN (train + val + test)::DOUBLE / total < 0.15 THEN 'rare' ELSE 'ok' END AS status FROM w""")
def q_frequency_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _truth(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("document")), "doc_id").join(_split(spark, sf_dir).select("document", "part"), "document")
    w = rows.groupBy("label").agg(*[F.sum((F.col("truth") & (F.col("part") == p)).cast("long")).alias(p) for p in SPLIT_PARTS], F.count(F.lit(1)).alias("total"))
    return w.select("label", *SPLIT_PARTS, L.status(F.col("label"), {p: F.col(p) for p in SPLIT_PARTS}, F.col("total"), SYNTH["min_label_share"], DEFAULTS["auto_labels"]).alias("status"))


def _truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(x).alias("label"), (F.col(x) == 1).alias("truth")) for x in ("quality", "toxic")])
    return table(spark, sf_dir, "labels").select("doc_id", F.explode(rows).alias("r")).select("doc_id", "r.label", "r.truth")


_PAIRS = f"{_TEXT}, {_TRUTH}, scored AS (SELECT t.label, t.truth, round(least(1::DOUBLE, r.nonword_ratio * 20), 4) AS score FROM truth t JOIN ratios r USING (doc_id))"


def _scored_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _ratios(spark, sf_dir).select("doc_id", F.round(F.least(F.lit(1.0), F.col("nonword_ratio") * 20), 4).alias("score"))
    return _truth(spark, sf_dir).join(r, "doc_id").select("label", "truth", "score")


_PR = "n AS (SELECT label, count(*) FILTER (WHERE score >= 0.5 AND truth) AS tp, count(*) FILTER (WHERE score >= 0.5) AS p, count(*) FILTER (WHERE truth) AS support FROM scored GROUP BY label), pr AS (SELECT label, CASE WHEN p = 0 THEN 0 ELSE tp::DOUBLE / p END AS precision, CASE WHEN support = 0 THEN 0 ELSE tp::DOUBLE / support END AS recall, support FROM n), m AS (SELECT label, precision, recall, CASE WHEN precision + recall = 0 THEN 0 ELSE precision * recall * 2 / (precision + recall) END AS f1, support FROM pr)"
_AP = "by_score AS (SELECT label, score, count(*) FILTER (WHERE truth) AS tp, count(*) AS n FROM scored GROUP BY 1, 2), run AS (SELECT label, tp, n, sum(tp) OVER w AS ct, sum(n) OVER w AS cn FROM by_score WINDOW w AS (PARTITION BY label ORDER BY score DESC ROWS UNBOUNDED PRECEDING)), ap AS (SELECT label, CASE WHEN sum(tp) > 0 AND sum(tp) < sum(n) THEN sum(tp * ct::DOUBLE / cn::DOUBLE) / sum(tp)::DOUBLE END AS average_precision FROM run GROUP BY label)"


@query(f"WITH {_PAIRS}, {_PR} SELECT label, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support FROM m")
def q_pr_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = E.precision_recall(_scored_truth(spark, sf_dir))
    return m.select("label", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")], "support")


@query(f"WITH {_PAIRS}, {_AP} SELECT label, round(average_precision, 9) AS average_precision FROM ap")
def q_average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.average_precision(_scored_truth(spark, sf_dir)).select("label", F.round("average_precision", 9).alias("average_precision"))


@query(f"WITH {_PAIRS}, {_PR}, {_AP} SELECT round(avg(f1), 9) AS macro_f1, round(avg(average_precision), 9) AS macro_average_precision, count(*) AS n_labels FROM m JOIN ap USING (label) WHERE support > 0")
def q_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scored_truth(spark, sf_dir)
    m = E.macro(E.precision_recall(rows).join(E.average_precision(rows), "label"), ["f1", "average_precision"])
    return m.select(F.round("macro_f1", 9).alias("macro_f1"), F.round("macro_average_precision", 9).alias("macro_average_precision"), "n_labels")


@query()
def q_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A logistic baseline on text measures, learnt on the train part and measured on val; sources are the documents."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.ln(F.coalesce(F.length("text"), F.lit(0)) + 1).alias("log_chars"), F.coalesce(F.size(F.array_distinct(F.split("text", " "))) / F.size(F.split("text", " ")), F.lit(0.0)).alias("distinct_share"))
    truth = table(spark, sf_dir, "labels").select("doc_id", *[(F.col(x) == 1).alias(x) for x in ("quality", "toxic")])
    rows = truth.join(d, "doc_id").join(_ratios(spark, sf_dir), "doc_id").join(_split(spark, sf_dir).select(F.col("document").alias("source"), "part"), "source")
    measures = ["garbage_ratio", "nonword_ratio", "log_chars", "distinct_share"]
    rows = written(rows.where("part IN ('train', 'val')").select("source", "part", "quality", "toxic", *measures), "baseline")
    scores = B.held_out_scores(rows.where("part = 'train'"), rows.where("part = 'val'"), "source", measures, ["quality", "toxic"])
    m = E.precision_recall(scores).join(E.average_precision(scores), "label")
    return m.select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "average_precision")], "support")


@query(f"WITH {_TRUTH}, w AS (SELECT label, count(*) FILTER (WHERE truth) AS p, count(*) AS n FROM truth GROUP BY label) SELECT label, round(CASE WHEN p = 0 THEN 1 ELSE (n - p)::DOUBLE / p END, 9) AS pos_weight, round(least(50, CASE WHEN p = 0 THEN 1 ELSE (n - p)::DOUBLE / p END), 9) AS capped FROM w")
def q_pos_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.pos_weight(_truth(spark, sf_dir), DEFAULTS["train"]["pos_weight_max"]).select("label", F.round("pos_weight", 9).alias("pos_weight"), F.round("capped", 9).alias("capped"))


_SIGNALS = f"""{_TEXT}, {_PRE}, both_sides AS (SELECT m.metric, m.x, 1 - r.garbage_ratio AS y FROM ratios r JOIN (SELECT doc_id, 'blur' AS metric, blur AS x FROM pre UNION ALL SELECT doc_id, 'noise', noise FROM pre) m USING (doc_id) JOIN labels USING (doc_id)
 UNION ALL SELECT 'quality_score', 1 - r.nonword_ratio, 1 - r.garbage_ratio FROM ratios r JOIN labels USING (doc_id))"""


@query(f"""WITH {_SIGNALS}, r AS (SELECT metric, x, y, rank() OVER (PARTITION BY metric ORDER BY x) + (count(*) OVER (PARTITION BY metric, x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (PARTITION BY metric ORDER BY y) + (count(*) OVER (PARTITION BY metric, y) - 1) / 2.0::DOUBLE AS ry FROM both_sides)
SELECT metric, count(*) AS n, CASE WHEN count(*) >= 3 AND count(DISTINCT x) > 1 AND count(DISTINCT y) > 1 THEN round(corr(rx, ry), 9) END AS rho, CASE WHEN metric = 'quality_score' THEN 1 ELSE -1 END AS expected FROM r GROUP BY metric""")
def q_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = table(spark, sf_dir, "labels").select("doc_id")
    # Written, as conditions on a ratio would measure the text again, before it is dealt to tasks.
    r = written(_ratios(spark, sf_dir, labelled).drop("lang"), "ratios").join(labelled, "doc_id").join(_pre(spark, sf_dir).select(F.col("image").alias("doc_id"), "scores"), "doc_id")
    sides = F.array(*[F.struct(F.lit(k).alias("metric"), v.alias("x")) for k, v in (("blur", F.col("scores")["blur"]), ("noise", F.col("scores")["noise"]), ("quality_score", 1 - F.col("nonword_ratio")))])
    rows = r.select(F.explode(sides).alias("s"), (1 - F.col("garbage_ratio")).alias("y")).select("s.metric", "s.x", "y")
    return E.spearman(rows).select("metric", "n", F.round("rho", 9).alias("rho"), E.expected_sign(F.col("metric"), F.lit("mean_confidence")).alias("expected"))


@query(f"WITH {_PRE} SELECT p.doc_id, p.blur AS cv_blur, p.noise AS cv_noise, l.quality = 1 AS human_quality, l.toxic = 1 AS human_toxic FROM pre p JOIN labels l USING (doc_id)")
def q_cv_ocr_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page once, whatever repeats either log holds."""
    pre, human = _pre(spark, sf_dir).dropDuplicates(["image"]), table(spark, sf_dir, "labels").dropDuplicates(["doc_id"])
    s = F.col("scores")
    return pre.join(human, pre["image"] == human["doc_id"]).select("doc_id", s["blur"].alias("cv_blur"), s["noise"].alias("cv_noise"), (F.col("quality") == 1).alias("human_quality"), (F.col("toxic") == 1).alias("human_toxic"))


_VALUES = "vals AS (SELECT 'line_height_px' AS metric, l_quantity::DOUBLE AS value FROM lineitem UNION ALL SELECT 'ink_paper_gap', l_extendedprice / 1000 FROM lineitem WHERE l_tax >= 0.05 UNION ALL SELECT 'noise_sigma', l_tax * 150 FROM lineitem WHERE l_tax >= 0.05 UNION ALL SELECT 'shadow_frac', o_totalprice / 1000000 FROM orders UNION ALL SELECT 'glare_cluster_frac', 0 FROM orders)"


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    gray = F.col("mid_tone_frac") >= 0.05
    m = _lines(spark, sf_dir).select(F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), v.cast("double").alias("value")) for k, v in (("line_height_px", F.col("line_height_px")), ("ink_paper_gap", F.when(gray, F.col("ink_paper_gap"))), ("noise_sigma", F.when(gray, F.col("noise_sigma"))))])).alias("r")).select("r.*")
    o = table(spark, sf_dir, "orders").select(F.explode(F.array(F.struct(F.lit("shadow_frac").alias("metric"), (F.col("o_totalprice") / 1000000).alias("value")), F.struct(F.lit("glare_cluster_frac").alias("metric"), F.lit(0.0).alias("value")))).alias("r")).select("r.*")
    return m.unionByName(o).where("value is not null")


@query(f"WITH {_VALUES} SELECT metric, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS median, round(min(value), 6) AS low, round(max(value), 6) AS high FROM vals GROUP BY metric")
def q_metric_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = quantiles(_values(spark, sf_dir), ["metric"], "value", [0.5])
    return q.select("metric", "n", F.round(F.col("q")[0], 6).alias("median"), F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query(f"""WITH {_VALUES}, want(label, metric, down) AS (VALUES {', '.join(f"('{k}', '{a['metric']}', {str(a['good'] > a['bad']).lower()})" for k, a in DEFAULTS['scores'].items())}),
q AS (SELECT metric, quantile_cont(value, 0.6) AS p60, quantile_cont(value, 0.05) AS p5, quantile_cont(value, 0.4) AS p40, quantile_cont(value, 0.95) AS p95 FROM vals GROUP BY metric),
a AS (SELECT label, metric, CASE WHEN down THEN p60 ELSE p40 END AS good, CASE WHEN down THEN p5 ELSE p95 END AS bad FROM want JOIN q USING (metric)) SELECT label, metric, round(good, 4) AS good, round(bad, 4) AS bad FROM a WHERE good <> bad""")
def q_calibrate_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.calibrate(_values(spark, sf_dir), DEFAULTS["scores"])


@query("WITH e AS (SELECT user_id, event_id, value, max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM events) SELECT user_id, event_id, coalesce(value > before, value IS NOT NULL) AS improved, round(greatest(value, before), 6) AS best FROM e")
def q_best_so_far(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.best_so_far(table(spark, sf_dir, "events").select("user_id", "event_id", "value"), "value", "event_id", ["user_id"]).select("user_id", "event_id", "improved", F.round("best", 6).alias("best"))


@query("SELECT event_type, round(sum(value * (event_id % 7 + 1)) / greatest(1, sum(event_id % 7 + 1)), 6) AS loss FROM events GROUP BY event_type")
def q_weighted_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.col("event_id") % 7 + 1
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(E.weighted_mean(F.col("value"), w), 6).alias("loss"))


@query("SELECT DISTINCT doc_id FROM (SELECT doc_id FROM documents WHERE n_chars >= 1000 UNION SELECT doc_id FROM labels)")
def q_package_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("n_chars >= 1000").select("doc_id").union(table(spark, sf_dir, "labels").select("doc_id")).distinct()


@query("SELECT (SELECT count(DISTINCT doc_id) FROM documents WHERE n_chars >= 1000) AS n_references, (SELECT count(DISTINCT doc_id) FROM labels) AS labelled, (SELECT count(*) FROM (SELECT doc_id FROM documents WHERE n_chars >= 1000 INTERSECT SELECT doc_id FROM labels)) AS both_sets")
def q_package_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "documents").where("n_chars >= 1000").select("doc_id", F.lit(1).alias("a"), F.lit(0).alias("b"))
    b = table(spark, sf_dir, "labels").select("doc_id", F.lit(0).alias("a"), F.lit(1).alias("b"))
    each = a.unionByName(b).groupBy("doc_id").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return each.agg(F.sum("a").cast("long").alias("n_references"), F.sum("b").cast("long").alias("labelled"), F.sum(F.col("a") * F.col("b")).cast("long").alias("both_sets"))


@query(f"WITH RECURSIVE {_SPLIT} SELECT document FROM split WHERE part = 'val' UNION SELECT document FROM split WHERE part = 'test'")
def q_held_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.held_out(_split(spark, sf_dir))


@query(f"SELECT l_orderkey, l_linenumber, array_to_string(list_sort(list_distinct(list_concat({_SKIPS}, ['unreadable']))), ',') AS not_applicable FROM (SELECT {_LINES} FROM lineitem)")
def q_not_applicable_without_ocr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("l_orderkey", "l_linenumber", F.array_join(F.array_sort(F.array_union("skip", F.array(F.lit("unreadable")))), ",").alias("not_applicable"))


@query("SELECT doc_id, array_to_string(list_sort(['quality', 'toxic']), ',') AS manual, CASE WHEN toxic = 1 THEN 3 ELSE 2 END AS n_labels FROM labels")
def q_manual_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels that a person sets: those of each page's map but for the automatic ones, which toxic pages have too."""
    given = F.create_map(F.lit("quality"), F.col("quality") == 1, F.lit("toxic"), F.col("toxic") == 1)
    more = F.when(F.col("toxic") == 1, F.create_map(*[x for k in DEFAULTS["auto_labels"] for x in (F.lit(k), F.lit(True))])).otherwise(F.create_map().cast("map<string,boolean>"))
    keys = F.map_keys(L.enrich(given, more))
    manual = F.array_except(keys, F.array(*[F.lit(x) for x in DEFAULTS["auto_labels"]]))
    return table(spark, sf_dir, "labels").select("doc_id", F.array_join(F.array_sort(manual), ",").alias("manual"), F.size(keys).alias("n_labels"))


@query("SELECT 'synthetic' AS kind, doc_id, doc_id + 42 * 1000003 AS seed FROM documents UNION ALL SELECT 'real', doc_id, 0 FROM labels")
def q_training_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "documents").select(F.lit("synthetic").alias("kind"), "doc_id", (F.lit(42).cast("long") * 1000003 + F.col("doc_id")).alias("seed"))
    b = table(spark, sf_dir, "labels").select(F.lit("real").alias("kind"), "doc_id", F.lit(0).cast("long").alias("seed"))
    return a.unionByName(b)


@query(f"WITH {_PRE}, {_LONG} SELECT label, count(*) FILTER (WHERE score >= 0.85) AS n, round(count(*) FILTER (WHERE score >= 0.85)::DOUBLE / count(*), 9) AS share, count(*) FILTER (WHERE score >= 0.85)::DOUBLE / count(*) >= 0.15 AS enough FROM long GROUP BY label")
def q_synthetic_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pre(spark, sf_dir).select(F.explode("scores").alias("label", "score")).groupBy("label").agg(F.sum((F.col("score") >= 0.85).cast("long")).alias("n"), F.avg((F.col("score") >= 0.85).cast("double")).alias("s"))
    return rows.select("label", "n", F.round("s", 9).alias("share"), (F.col("s") >= SYNTH["min_label_share"]).alias("enough"))


@query("WITH p AS (SELECT vec_id, label % 2 = 0 AS is_local, unnest(embedding)::DOUBLE AS e FROM embeddings) SELECT vec_id, CASE WHEN is_local THEN 'max' ELSE 'mean' END AS rule, round(CASE WHEN is_local THEN max(e) ELSE avg(e) END, 6) AS score FROM p GROUP BY vec_id, is_local")
def q_patch_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "embeddings").select("vec_id", (F.col("label") % 2 == 0).alias("is_local"), F.explode("embedding").alias("e"))
    return p.groupBy("vec_id").agg(F.when(F.first("is_local"), "max").otherwise("mean").alias("rule"), F.round(S.page_score(F.col("e").cast("double"), F.col("is_local")), 6).alias("score"))


@query("SELECT vec_id, CASE WHEN NOT (label > 2) THEN 0 WHEN label % 2 = 0 AND label < 8 THEN CASE WHEN abs(embedding[1])::DOUBLE >= 0.15 THEN 1 ELSE 0 END ELSE 1 END AS patch_label FROM embeddings")
def q_patch_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("label")
    return table(spark, sf_dir, "embeddings").select("vec_id", S.patch_label(c % 2 == 0, c < 8, F.abs(F.col("embedding")[0]).cast("double"), c > 2).alias("patch_label"))


_GRID = """sizes AS (SELECT page_id AS page, 300 + (page_id * 37 % 2200) AS width, 400 + (page_id * 53 % 3200) AS height FROM pages), s AS (SELECT *, least(384, width, height) AS side FROM sizes),
g AS (SELECT *, CASE WHEN height <= side THEN 1 ELSE 9 END AS nr, CASE WHEN width <= side THEN 1 ELSE 6 END AS nc FROM s), r AS (SELECT *, unnest(range(nr)) AS row FROM g), c AS (SELECT *, unnest(range(nc)) AS col FROM r),
b AS (SELECT *, CASE WHEN height <= side THEN 0 ELSE row * (height - side)::DOUBLE / 8 END AS fy, CASE WHEN width <= side THEN 0 ELSE col * (width - side)::DOUBLE / 5 END AS fx FROM c)"""


@query(f"WITH {_GRID} SELECT page, row * nc + col AS index, row, col, round_even(fx, 0)::BIGINT AS x0, round_even(fy, 0)::BIGINT AS y0, round_even(fx, 0)::BIGINT + side AS x1, round_even(fy, 0)::BIGINT + side AS y1 FROM b")
def q_patch_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("page"), (300 + F.col("page_id") * 37 % 2200).alias("width"), (400 + F.col("page_id") * 53 % 3200).alias("height"))
    g = P.patch_grid(pages, DEFAULTS["patch_size"], DEFAULTS["grid"]["rows"], DEFAULTS["grid"]["cols"])
    return g.select("page", *[F.col(c).cast("long").alias(c) for c in ("index", "row", "col", "x0", "y0", "x1", "y1")])


_PX = "px AS (SELECT vec_id AS page, ((i - 1) // 8)::INT AS y, ((i - 1) % 8)::INT AS x, least(255, greatest(0, floor(e::DOUBLE * 255 + 128)))::INT AS v FROM (SELECT vec_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) AS i FROM embeddings))"


def _px(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.micro_pages(table(spark, sf_dir, "embeddings"))


@query(f"WITH {_PX} SELECT page, round(stddev_pop(v), 6) AS rms, round(avg(CASE WHEN v > 40 AND v < 215 THEN 1 ELSE 0 END), 6) AS mid_tone, round(quantile_cont(v, 0.99) - quantile_cont(v, 0.01), 6) AS dynamic_range FROM px GROUP BY page")
def q_px_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.contrast(_px(spark, sf_dir)).select("page", *[F.round(c, 6).alias(c) for c in ("rms", "mid_tone", "dynamic_range")])


def _neighbours(kernel: list[list[int]], name: str) -> str:
    return "sum(CASE " + " ".join(f"WHEN dy = {i - 1} AND dx = {j - 1} THEN {k} * n.v" for i, line in enumerate(kernel) for j, k in enumerate(line) if k) + f" ELSE 0 END)::DOUBLE AS {name}"


_NEAR = f"""{_PX}, step AS (SELECT unnest([-1, 0, 1]) AS d), near AS (SELECT p.page, p.y, p.x, a.d AS dy, b.d AS dx,
 CASE WHEN p.y + a.d < 0 THEN -(p.y + a.d) WHEN p.y + a.d > 7 THEN 14 - p.y - a.d ELSE p.y + a.d END AS ny, CASE WHEN p.x + b.d < 0 THEN -(p.x + b.d) WHEN p.x + b.d > 7 THEN 14 - p.x - b.d ELSE p.x + b.d END AS nx FROM px p, step a, step b),
conv AS (SELECT q.page, q.y, q.x, {_neighbours(P.LAPLACE, "l")}, {_neighbours(P.SOBEL_X, "gx")}, {_neighbours(P.SOBEL_Y, "gy")}, {_neighbours(P.NOISE, "s")} FROM near q JOIN px n ON n.page = q.page AND n.y = q.ny AND n.x = q.nx GROUP BY 1, 2, 3)"""


@query(f"WITH {_NEAR} SELECT page, avg(l * l) - avg(l) * avg(l) AS laplacian_var, avg(gx * gx + gy * gy) AS tenengrad FROM conv GROUP BY page")
def q_px_sharpness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.sharpness(_px(spark, sf_dir))


@query(f"WITH {_NEAR} SELECT page, round(quantile_cont(abs(s), 0.5) * 1.4826 / 6, 6) AS noise_sigma FROM conv WHERE y BETWEEN 1 AND 6 AND x BETWEEN 1 AND 6 GROUP BY page")
def q_px_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.noise_sigma(_px(spark, sf_dir)).select("page", F.round("noise_sigma", 6).alias("noise_sigma"))


@query(f"""WITH {_PX}, hist AS (SELECT page, v, count(*)::DOUBLE AS n FROM px GROUP BY 1, 2), c AS (SELECT page, v, sum(n) OVER w AS w0, sum(n * v) OVER w AS s0, sum(n) OVER (PARTITION BY page) AS n_all, sum(n * v) OVER (PARTITION BY page) AS s_all FROM hist WINDOW w AS (PARTITION BY page ORDER BY v ROWS UNBOUNDED PRECEDING)),
b AS (SELECT page, v, CASE WHEN w0 < n_all THEN round(w0 * (n_all - w0) * pow(s0 / w0 - (s_all - s0) / (n_all - w0), 2), 6) ELSE -1 END AS b FROM c), best AS (SELECT page, v AS threshold FROM b QUALIFY row_number() OVER (PARTITION BY page ORDER BY b DESC, v) = 1)
SELECT page, threshold, coalesce(quantile_cont(v, 0.5) FILTER (WHERE v > threshold) - quantile_cont(v, 0.5) FILTER (WHERE v <= threshold), 0)::DOUBLE AS gap FROM px JOIN best USING (page) GROUP BY page, threshold""")
def q_px_otsu_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.otsu_gap(_px(spark, sf_dir))


@query(f"""WITH {_PX}, prof AS (SELECT page, x, quantile_cont(v, 0.75)::DOUBLE AS p FROM px GROUP BY 1, 2), res AS (SELECT page, p, p - avg(p) OVER (PARTITION BY page ORDER BY x ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS r FROM prof),
sc AS (SELECT page, quantile_cont(abs(r), 0.5) * 1.4826 AS s, quantile_cont(p, 0.5) AS m FROM res GROUP BY page) SELECT page, round(CASE WHEN max(m) > 0 THEN sqrt(avg(pow(greatest(abs(r) - 3 * s, 0), 2))) / max(m) ELSE 0 END, 6) AS streak_energy FROM res JOIN sc USING (page) GROUP BY page""")
def q_px_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.streak_energy(_px(spark, sf_dir)).select("page", F.round("streak_energy", 6).alias("streak_energy"))


@query(f"""WITH {_PX}, r AS (SELECT page, y, avg(CASE WHEN v < 128 THEN 1 ELSE 0 END) AS s FROM px GROUP BY 1, 2), c AS (SELECT page, x, avg(CASE WHEN v < 128 THEN 1 ELSE 0 END) AS s FROM px GROUP BY 1, 2),
rr AS (SELECT page, min(y) AS t, max(y) + 1 AS b FROM r WHERE s >= 0.2 GROUP BY page), cc AS (SELECT page, min(x) AS l, max(x) + 1 AS r FROM c WHERE s >= 0.2 GROUP BY page)
SELECT page, CASE WHEN t IS NULL OR l IS NULL THEN 0 ELSE t END AS top, CASE WHEN t IS NULL OR l IS NULL THEN 8 ELSE b END AS bottom, CASE WHEN t IS NULL OR l IS NULL THEN 0 ELSE l END AS left, CASE WHEN t IS NULL OR l IS NULL THEN 8 ELSE r END AS right FROM (SELECT DISTINCT page FROM px) LEFT JOIN rr USING (page) LEFT JOIN cc USING (page)""".replace(" AS left", ' AS "left"').replace(" AS right", ' AS "right"'))
def q_px_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.text_box(_px(spark, sf_dir))


@query(f"""WITH {_PX}, r AS (SELECT page, y, avg(CASE WHEN v < 128 THEN 1 ELSE 0 END) AS s FROM px GROUP BY 1, 2), i AS (SELECT page, y, y - row_number() OVER (PARTITION BY page ORDER BY y) AS island FROM r WHERE s >= 0.4)
SELECT page, row_number() OVER (PARTITION BY page ORDER BY min(y)) AS line, min(y) AS top, count(*) AS height FROM i GROUP BY page, island""")
def q_px_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.line_runs(_px(spark, sf_dir)).select("page", F.col("line").cast("long").alias("line"), "top", "height")


@query()
def q_synth_recipe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recipe of all synthetic pages; a sequential plan, so it has no SQL."""
    r = SYNTH["reference"]
    clean = table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0").select(F.col("doc_id").alias("image"))
    refs = D.references(_pre(spark, sf_dir), D.held_out(_split(spark, sf_dir)), clean, r["count"], r["max_defect_score"])
    plan = Y.recipe(refs.withColumn("down", ~F.col("human")), SYNTH["target_total"], DEFAULTS, ["down", "suspicion", "image"])
    return plan.select("image", "reference", "document", F.to_json("steps").alias("steps"), "seed")


@query()
def q_kernel_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 37 measures, scores and verdicts of the vectors read as 8x8 pages, each enlarged twelve times."""
    side, times = 8, 12
    v = table(spark, sf_dir, "embeddings").repartition(2 * spark.sparkContext.defaultParallelism)  # the kernel is the work, not the bytes
    # Each value is turned into hex once, and the strings are repeated: what is done for each of the 9,216 pixels costs more than the kernel.
    grey = lambda e: F.least(F.lit(255), F.greatest(F.lit(0), F.floor(e.cast("double") * 255 + 128))).cast("int")
    line = lambda y: F.array_join(F.transform(F.slice("embedding", y * side + 1, side), lambda e: F.repeat(F.lpad(F.hex(grey(e)), 2, "0"), F.lit(times))), "")
    hexes = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(side - 1)), lambda y: F.repeat(line(y), F.lit(times))), "")
    px = v.select(F.col("vec_id").cast("string").alias("path"), F.lit(0).alias("page"), F.lit(side * times).alias("height"), F.lit(side * times).alias("width"), F.lit(0.0).alias("dpi"), F.lit(side * times).alias("original_width"), F.unhex(hexes).alias("gray"))
    small = DEFAULTS | {"patch_size": 48, "grid": {"rows": 2, "cols": 2}}
    return G.reports(G.scored(G.raw_metrics(px, small), small), small).select("image", "verdict", "quality_score", F.to_json("cv_metrics").alias("cv_metrics"))


# Correlations of every column with what recognition says.
_SIGNS, _HUMAN = ("mean_confidence", "nonword_ratio"), manual_labels(DEFAULTS)
_RECORDS = "CASE WHEN doc_id % 5 <> 0 THEN (n_chars * 7 % 1009) / 1009.0::DOUBLE END AS mean_confidence, CASE WHEN doc_id % 3 <> 0 THEN (n_chars * 13 % 1013) / 1013.0::DOUBLE END AS nonword_ratio"
_SIGNAL_COLUMNS = f"""{_PRE}, recs AS (SELECT doc_id, {_RECORDS}, (quality = 1)::INT::DOUBLE AS h0, (toxic = 1)::INT::DOUBLE AS h1 FROM documents JOIN labels USING (doc_id)),
sc AS (SELECT doc_id, mean_confidence, nonword_ratio, {', '.join(SCORED)}, {', '.join(f"{f'h{i}' if i < 2 else 'NULL::DOUBLE'} AS human_{x}" for i, x in enumerate(_HUMAN))}, 1 - {_TOP} AS quality_score FROM pre JOIN recs USING (doc_id) WHERE mean_confidence IS NOT NULL OR nonword_ratio IS NOT NULL)"""


def _signal_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's log line stands twice, the first time without any label: the last one wins."""
    d, human = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "__id")
    signals = [F.when(F.col("doc_id") % keep != 0, (F.col("n_chars") * by % mod) / F.lit(float(mod))) for keep, by, mod in ((5, 7, 1009), (3, 13, 1013))]
    derived = F.map_filter(F.create_map(*[x for k, v in zip(_SIGNS, signals, strict=True) for x in (F.lit(k), v)]), lambda k, v: v.isNotNull())
    given = F.create_map(F.lit(_HUMAN[0]), F.col("quality") == 1, F.lit(_HUMAN[1]), F.col("toxic") == 1)
    turns = F.explode(F.sequence(F.lit(0), F.lit(1))).alias("turn")
    log = d.join(human, F.col("doc_id") == F.col("__id")).select(F.col("doc_id").alias("image"), turns, derived.alias("derived"), given.alias("labels"))
    log = log.withColumn("labels", F.when(F.col("turn") == 1, F.col("labels")))
    pre = _pre(spark, sf_dir).withColumn("quality_score", 1 - S.suspicion(F.col("scores")))
    return L.signal_columns(pre, L.last_wins(log, "image", ["turn"]), list(_SIGNS), SCORED, _HUMAN)


@query(f"WITH {_SIGNAL_COLUMNS} SELECT doc_id AS image, mean_confidence, nonword_ratio, {', '.join(SCORED)}, {', '.join(f'human_{x}' for x in _HUMAN)}, round(quality_score, 9) AS quality_score FROM sc")
def q_signal_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _signal_columns(spark, sf_dir).withColumn("quality_score", F.round("quality_score", 9))


_COLUMNS = [*SCORED, "quality_score", *(f"human_{x}" for x in _HUMAN)]


@query(f"""WITH {_SIGNAL_COLUMNS}, names AS (SELECT unnest([{', '.join(f"'{x}'" for x in _COLUMNS)}]) AS metric), pairs AS ({' UNION ALL '.join(f"SELECT '{x}' AS metric, {x} AS x, mean_confidence AS y FROM sc WHERE {x} IS NOT NULL AND mean_confidence IS NOT NULL" for x in _COLUMNS)}),
r AS (SELECT metric, x, y, rank() OVER (PARTITION BY metric ORDER BY x) + (count(*) OVER (PARTITION BY metric, x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (PARTITION BY metric ORDER BY y) + (count(*) OVER (PARTITION BY metric, y) - 1) / 2.0::DOUBLE AS ry FROM pairs),
c AS (SELECT metric, count(*) AS n, CASE WHEN count(*) >= 3 AND count(DISTINCT x) > 1 AND count(DISTINCT y) > 1 THEN round(corr(rx, ry), 9) END AS rho FROM r GROUP BY metric)
SELECT metric, coalesce(n, 0) AS n, rho, row_number() OVER (ORDER BY abs(rho) DESC NULLS LAST, metric) AS rank FROM names LEFT JOIN c USING (metric)""")
def q_correlation_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every score and every human label against the confidence; a row for each of the columns, so one task ranks them."""
    got = E.correlations(_signal_columns(spark, sf_dir), _COLUMNS, "mean_confidence").withColumn("rho", F.round("rho", 9))
    return got.select("metric", "n", "rho", F.row_number().over(Window.orderBy(F.abs("rho").desc_nulls_last(), "metric")).cast("long").alias("rank"))


@query(f"WITH {_PRE}, {_LONG} SELECT label, doc_id, nth FROM (SELECT label, doc_id, row_number() OVER (PARTITION BY label ORDER BY doc_id) AS nth FROM long WHERE score >= 0.85) WHERE nth <= 10")
def q_sheet_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages that a contact sheet of each label shows."""
    marked = _pre(spark, sf_dir).select("image", F.explode("scores").alias("label", "score")).where("score >= 0.85")
    return L.first_per_label(marked).select("label", F.col("image").alias("doc_id"), F.col("nth").cast("long").alias("nth"))


@query(f"WITH RECURSIVE {_SPLIT}, parts(part) AS (VALUES ('train'), ('val'), ('test')), own AS (SELECT part, document, doc_id FROM split JOIN documents ON source = document) SELECT part, coalesce(string_agg(DISTINCT document, ',' ORDER BY document), '') AS documents, coalesce(string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id), '') AS images, count(DISTINCT document) AS n_documents, count(doc_id) AS n_images FROM parts LEFT JOIN own USING (part) GROUP BY part")
def q_split_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the three split files hold."""
    records = table(spark, sf_dir, "documents").select(F.col("source").alias("document"), F.col("doc_id").alias("image"))
    lists = D.assemble(_split(spark, sf_dir), records)
    return lists.select("part", F.array_join("documents", ",").alias("documents"), F.array_join(F.col("images").cast("array<string>"), ",").alias("images"), *[F.col(c).cast("long").alias(c) for c in ("n_documents", "n_images")])


def _patch_target(label: str) -> str:
    given = {"blur": "label % 2 = 0", "glare": "label > 4 AND label > 7", "shadow": "label < 3"}.get(label, "false")
    return f"CASE WHEN {given} THEN '1' ELSE '0' END"


@query(f"""WITH {_PX}, m AS (SELECT page, count(*) AS n_pixels, round(avg(CAST((v / 255.0::DOUBLE - 0.449::DOUBLE) / 0.226::DOUBLE AS FLOAT)::DOUBLE), 6) AS mean_pixel FROM px GROUP BY page)
SELECT vec_id::VARCHAR AS image, 0 AS step, 8 AS x1, 8 AS y1, n_pixels, mean_pixel, concat_ws(',', {', '.join(_patch_target(x) for x in DEFAULTS['labels'])}) AS target FROM embeddings JOIN m ON page = vec_id""")
def q_training_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors read as 8x8 pages of one validation patch each; a glare's mask covers all of it or nothing, shadows have none."""
    v = table(spark, sf_dir, "embeddings").repartition(2 * spark.sparkContext.defaultParallelism)
    grey = F.transform("embedding", lambda e: F.least(F.lit(255), F.greatest(F.lit(0), F.floor(e.cast("double") * 255 + 128))).cast("int"))
    given = F.create_map(F.lit("blur"), F.col("label") % 2 == 0, F.lit("glare"), F.col("label") > 4, F.lit("shadow"), F.col("label") < 3)
    mask = F.array(F.struct(F.lit("glare").alias("label"), F.lit(1).alias("height"), F.lit(1).alias("width"), F.unhex(F.when(F.col("label") > 7, "FF").otherwise("00")).alias("mask")))
    hexes = F.array_join(F.transform(grey, lambda b: F.lpad(F.hex(b), 2, "0")), "")
    pages = v.select(F.col("vec_id").cast("string").alias("image"), F.lit(8).alias("height"), F.lit(8).alias("width"), F.unhex(hexes).alias("gray"), given.alias("labels"), mask.alias("masks"))
    got = T.patches(pages, DEFAULTS | {"patch_size": 8}, train=False)
    total = F.aggregate("pixels", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return got.select("image", "step", "x1", "y1", F.size("pixels").cast("long").alias("n_pixels"), F.round(total / F.size("pixels"), 6).alias("mean_pixel"), F.array_join(F.col("target").cast("array<int>").cast("array<string>"), ",").alias("target"))
