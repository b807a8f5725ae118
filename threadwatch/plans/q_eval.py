"""Queries B1-B5 and E1-E11: baselines, splits and metric tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadwatch.functions.fixed import MODELS, TRIAL_SAMPLE_SIZE
from threadwatch.functions.scoring import sql_uniform
from threadwatch.functions.text import parse_label, unicode_strip
from threadwatch.operators import baselines, lexicon, metrics
from threadwatch.plans import adapters as ad
from threadwatch.plans.q_figures import SQL_EVAL, eval_dataset, sql_topic_random
from threadwatch.plans.registry import query
from threadwatch.session import cut_lineage

PRED_COLS = "baseline, run, video_key, video_topic, true_label, pred_label"


def _preds(spark, sf_dir, which=None):
    return baselines.baseline_predictions(eval_dataset(spark, sf_dir), which)


SQL_RANDOM = """,
runs5 AS (SELECT unnest([0, 1, 2, 3, 4]) AS run),
random_b AS (
  SELECT 'random' AS baseline, CAST(run AS INTEGER) AS run, video_key, video_topic, true_label,
         CAST((('0x' || substr(md5(video_key || ':' || CAST(42 + run AS VARCHAR)), 1, 8))::BIGINT / 4294967296.0) < 0.5
              AS INTEGER) AS pred_label
  FROM ev CROSS JOIN runs5)"""

SQL_MAJORITY = """,
maj AS (
  SELECT video_topic, true_label AS m FROM (
    SELECT video_topic, true_label, row_number() OVER (PARTITION BY video_topic ORDER BY count(*) DESC, true_label) AS r
    FROM ev WHERE video_topic IS NOT NULL GROUP BY video_topic, true_label) WHERE r = 1),
gmaj AS (
  SELECT true_label AS m FROM ev GROUP BY true_label ORDER BY count(*) DESC, true_label LIMIT 1),
majority_b AS (
  SELECT 'topic_majority' AS baseline, 0 AS run, video_key, ev.video_topic, true_label,
         CAST(coalesce(maj.m, (SELECT m FROM gmaj)) AS INTEGER) AS pred_label
  FROM ev LEFT JOIN maj ON ev.video_topic = maj.video_topic)"""

SQL_CONST = """,
const_b AS (
  SELECT 'all_positive' AS baseline, 0 AS run, video_key, video_topic, true_label, 1 AS pred_label FROM ev
  UNION ALL
  SELECT 'all_negative' AS baseline, 0 AS run, video_key, video_topic, true_label, 0 AS pred_label FROM ev)"""

SQL_ALL_PREDS = SQL_EVAL + SQL_RANDOM + sql_topic_random() + SQL_MAJORITY + SQL_CONST + f""",
preds AS (
  SELECT {PRED_COLS} FROM random_b UNION ALL SELECT {PRED_COLS} FROM majority_b
  UNION ALL SELECT {PRED_COLS} FROM topic_random UNION ALL SELECT {PRED_COLS} FROM const_b)"""


query("baseline_random", SQL_EVAL + SQL_RANDOM + f"\nSELECT {PRED_COLS} FROM random_b")(
    lambda spark, sf_dir: _preds(spark, sf_dir, ["random"]))
query("baseline_topic_random", SQL_EVAL + sql_topic_random() + f"\nSELECT {PRED_COLS} FROM topic_random")(
    lambda spark, sf_dir: _preds(spark, sf_dir, ["topic_majority_random"]))
query("baseline_topic_majority", SQL_EVAL + SQL_MAJORITY + f"\nSELECT {PRED_COLS} FROM majority_b")(
    lambda spark, sf_dir: _preds(spark, sf_dir, ["topic_majority"]))
query("baseline_constant", SQL_EVAL + SQL_CONST + f"\nSELECT {PRED_COLS} FROM const_b")(
    lambda spark, sf_dir: _preds(spark, sf_dir, ["all_positive", "all_negative"]))


def _div0(a, b):
    return f"coalesce(CAST({a} AS DOUBLE) / nullif({b}, 0), 0.0)"


SQL_COUNTS = """
  count(*) AS n_total, CAST(count_if(pred_label IS NULL) AS BIGINT) AS n_unparseable,
  CAST(count_if(true_label = 1) AS BIGINT) AS n_pos, CAST(count_if(true_label = 0) AS BIGINT) AS n_neg,
  CAST(count_if(true_label = 1 AND pred_label = 1) AS BIGINT) AS tp, CAST(count_if(true_label = 0 AND pred_label = 1) AS BIGINT) AS fp,
  CAST(count_if(true_label = 1 AND pred_label = 0) AS BIGINT) AS fn, CAST(count_if(true_label = 0 AND pred_label = 0) AS BIGINT) AS tn"""

SQL_METRICS = f"""
m1 AS (
  SELECT *, {_div0('tn', 'tn + fn')} AS prec_neg, {_div0('tn', 'tn + fp')} AS rec_neg,
         {_div0('2 * tn', '2 * tn + fn + fp')} AS f1_neg, {_div0('tp', 'tp + fp')} AS prec_pos,
         {_div0('tp', 'tp + fn')} AS rec_pos, {_div0('2 * tp', '2 * tp + fp + fn')} AS f1_pos
  FROM cnt),
mt AS (
  SELECT baseline, run, n_total, n_unparseable, prec_neg, rec_neg, f1_neg, prec_pos, rec_pos, f1_pos,
         (prec_neg + prec_pos) / 2 AS macro_prec, (rec_neg + rec_pos) / 2 AS macro_rec,
         (f1_neg + f1_pos) / 2 AS macro_f1,
         {_div0('f1_neg * (tn + fp) + f1_pos * (tp + fn)', 'tn + fp + tp + fn')} AS weighted_f1,
         {_div0('tp + tn', 'tp + fp + fn + tn')} AS accuracy
  FROM m1)"""


def metrics_by_run(spark, sf_dir):
    c = metrics.binary_counts(_preds(spark, sf_dir), ["baseline", "run"])
    return metrics.binary_metrics(c, ["baseline", "run"])


query("metrics_by_run", SQL_ALL_PREDS + f""",
cnt AS (SELECT baseline, run, {SQL_COUNTS} FROM preds GROUP BY baseline, run),
{SQL_METRICS.strip()}
SELECT * FROM mt""")(metrics_by_run)

_METRIC_NAMES = ", ".join(metrics.BINARY_METRICS)


@query("metrics_mean_std", SQL_ALL_PREDS + f""",
cnt AS (SELECT baseline, run, {SQL_COUNTS} FROM preds GROUP BY baseline, run),
{SQL_METRICS.strip()},
lng AS (UNPIVOT (SELECT baseline, run, {_METRIC_NAMES} FROM mt) ON {_METRIC_NAMES} INTO NAME metric VALUE value)
SELECT baseline, metric, avg(value) AS mean, stddev_pop(value) AS std, count(*) AS runs
FROM lng GROUP BY baseline, metric""")
def metrics_mean_std(spark, sf_dir):
    return metrics.mean_std(metrics_by_run(spark, sf_dir), ["baseline"])


# ------------------------------------------------------------ classifier evaluation on labelled docs

def binary_preds(spark, sf_dir):
    """Every model's parsed answers about every labelled document, long form."""
    return ad.model_answers(spark, sf_dir).select("model_key", "doc_id", "lang", F.col("toxic").alias("true_label"),
                                                  parse_label(F.col("answer")).alias("pred_label"))


def sql_binary_preds() -> str:
    return f"""
{ad.SQL_ANSWERS},
bp AS (SELECT model_key, doc_id, lang, toxic AS true_label, {ad.sql_parse_label('answer')} AS pred_label FROM answers)"""


@query("binary_score", "WITH " + sql_binary_preds().strip() + f"""
SELECT model_key, count(*) AS n_total, CAST(count_if(pred_label IS NULL) AS BIGINT) AS n_unparseable,
       {_div0('2 * count_if(true_label = 1 AND pred_label = 1)',
              '2 * count_if(true_label = 1 AND pred_label = 1) + count_if(true_label = 0 AND pred_label = 1)'
              ' + count_if(true_label = 1 AND pred_label = 0)')} AS f1_offensive
FROM bp GROUP BY model_key""")
def binary_score(spark, sf_dir):
    return metrics.binary_score(binary_preds(spark, sf_dir), ["model_key"])


@query("label_distribution", "WITH " + sql_binary_preds().strip() + """
SELECT model_key, count(*) AS n_total, CAST(count_if(true_label = 1) AS BIGINT) AS n_pos, CAST(count_if(true_label = 0) AS BIGINT) AS n_neg,
       CAST(count_if(pred_label IS NULL) AS BIGINT) AS n_unparseable FROM bp GROUP BY model_key""")
def label_distribution(spark, sf_dir):
    return metrics.label_distribution(binary_preds(spark, sf_dir), ["model_key"])


def sql_report(src: str, t: str, p: str) -> str:
    return f""",
conf AS (SELECT {t} AS t, {p} AS p, count(*) AS n FROM {src} WHERE {p} IS NOT NULL GROUP BY 1, 2),
sides AS (
  SELECT CAST(t AS VARCHAR) AS label, CASE WHEN t = p THEN n ELSE 0 END AS tp, 0 AS fp,
         CASE WHEN t <> p THEN n ELSE 0 END AS fn FROM conf
  UNION ALL
  SELECT CAST(p AS VARCHAR), 0, CASE WHEN t <> p THEN n ELSE 0 END, 0 FROM conf),
pc AS (
  SELECT label, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, sum(tp) + sum(fn) AS support,
         {_div0('sum(tp)', 'sum(tp) + sum(fp)')} AS precision, {_div0('sum(tp)', 'sum(tp) + sum(fn)')} AS recall,
         {_div0('2 * sum(tp)', '2 * sum(tp) + sum(fp) + sum(fn)')} AS f1
  FROM sides GROUP BY label)"""


SQL_REPORT_TAIL = f""",
tot AS (
  SELECT sum(tp) AS tp, sum(support) AS sup, avg(precision) AS mp, avg(recall) AS mr, avg(f1) AS mf,
         {_div0('sum(precision * support)', 'sum(support)')} AS wp, {_div0('sum(recall * support)', 'sum(support)')} AS wr,
         {_div0('sum(f1 * support)', 'sum(support)')} AS wf
  FROM pc)
SELECT label, precision, recall, f1, CAST(support AS BIGINT) AS support FROM pc
UNION ALL SELECT 'accuracy', NULL, NULL, {_div0('tp', 'sup')}, CAST(sup AS BIGINT) FROM tot
UNION ALL SELECT 'macro avg', mp, mr, mf, CAST(sup AS BIGINT) FROM tot
UNION ALL SELECT 'weighted avg', wp, wr, wf, CAST(sup AS BIGINT) FROM tot"""


@query("binary_report", "WITH " + sql_binary_preds().strip() + sql_report("bp", "true_label", "pred_label")
       + SQL_REPORT_TAIL)
def binary_report(spark, sf_dir):
    return metrics.classification_report(binary_preds(spark, sf_dir))


def lang_preds(spark, sf_dir):
    """Language by its most frequent words, against the documents' own."""
    items = ad.labelled_docs(spark, sf_dir).select("doc_id", F.col("lang").alias("true_label"), "text")
    return cut_lineage(lexicon.with_language(ad.spread(items), "text", "pred_label"))  # read several times


SQL_LANG_PREDS = f"""
WITH lp AS (
  SELECT doc_id, lang AS true_label, {lexicon.sql_language('text')} AS pred_label
  FROM labels JOIN documents USING (doc_id))"""


@query("macro_f1_multiclass", SQL_LANG_PREDS + sql_report("lp", "true_label", "pred_label") + f"""
SELECT (SELECT count(*) FROM lp) AS n_total, (SELECT CAST(count_if(pred_label IS NULL) AS BIGINT) FROM lp) AS n_unparseable,
       coalesce(avg(f1), 0.0) AS macro_f1, count(*) AS n_classes FROM pc""")
def macro_f1_multiclass(spark, sf_dir):
    return metrics.macro_f1(lang_preds(spark, sf_dir))


@query("multiclass_report", SQL_LANG_PREDS + sql_report("lp", "true_label", "pred_label") + SQL_REPORT_TAIL)
def multiclass_report(spark, sf_dir):
    return metrics.classification_report(lang_preds(spark, sf_dir))


# ------------------------------------------------------------ split, sample, model selection

def split_items(spark, sf_dir):
    items = ad.labelled_docs(spark, sf_dir).select("doc_id", "lang", "toxic")
    return metrics.dev_test_split(items, "doc_id", "lang")


SQL_SPLIT = f"""
WITH items AS (SELECT doc_id, lang, toxic FROM labels JOIN documents USING (doc_id)),
counts AS (SELECT lang, count(*) AS c FROM items GROUP BY lang),
tot AS (SELECT sum(c) AS n, CAST(ceil(0.4::DOUBLE * sum(c)) AS BIGINT) AS n_test FROM counts),
q AS (SELECT lang, c, c * (n - n_test) / n AS cont FROM counts, tot),
q2 AS (SELECT lang, c, floor(cont) AS fl, cont - floor(cont) AS rem FROM q),
need AS (SELECT (SELECT n - n_test FROM tot) - sum(fl) AS need FROM q2),
ranked AS (SELECT q2.*, row_number() OVER (ORDER BY rem DESC, lang) AS r FROM q2),
quota AS (SELECT lang, c - (fl + CASE WHEN r <= (SELECT need FROM need) THEN 1 ELSE 0 END) AS quota FROM ranked),
uu AS (SELECT doc_id, lang, toxic, {sql_uniform('doc_id', 42)} AS u FROM items),
rk AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY u, doc_id) - 1 AS rnk FROM uu),
split AS (SELECT doc_id, lang, toxic, CASE WHEN rnk < quota THEN 'test' ELSE 'dev' END AS split
          FROM rk JOIN quota USING (lang))"""

query("split_dev_test", SQL_SPLIT + "\nSELECT * FROM split")(split_items)


@query("seeded_sample", f"""
SELECT doc_id, lang, toxic FROM labels JOIN documents USING (doc_id)
ORDER BY {sql_uniform('doc_id', 42)}, doc_id LIMIT 50""")
def seeded_sample(spark, sf_dir):
    items = ad.labelled_docs(spark, sf_dir).select("doc_id", "lang", "toxic")
    return metrics.seeded_sample(items, "doc_id", TRIAL_SAMPLE_SIZE)


def model_predictions(spark, sf_dir):
    """Dev/test split x every model in the catalogue, parsed answers, long form.

    The models are fitted on the labels; each item is answered by the weights of the fold it is not in.
    """
    items = ad.with_answers(ad.hashed_labelled_docs(spark, sf_dir))
    long = ad.by_model(metrics.dev_test_split(items, "doc_id", "lang"))
    return long.select("model_key", "ordinal", "doc_id", "split", F.col("toxic").alias("true_label"),
                       parse_label(F.col("answer")).alias("pred_label"))


def select_best_model(spark, sf_dir):
    """F1 of every model on dev, first maximum in catalogue order, scored once on test."""
    preds = model_predictions(spark, sf_dir)
    scores = metrics.binary_score(preds, ["model_key", "ordinal", "split"])
    dev = scores.filter(F.col("split") == "dev")
    best = dev.orderBy(F.col("f1_offensive").desc(), "ordinal").limit(1)
    test = scores.filter(F.col("split") == "test").select("model_key", F.col("f1_offensive").alias("test_f1_offensive"))
    return best.join(test, "model_key").select(F.col("model_key").alias("best_model"),
                                               F.col("f1_offensive").alias("dev_f1_offensive"), "test_f1_offensive")


def _sql_model_preds() -> str:
    return f""",
{ad.SQL_ANSWERS},
mp AS (SELECT model_key, ordinal, doc_id, split.split, a.toxic AS true_label, {ad.sql_parse_label('answer')} AS pred_label
       FROM answers a JOIN split USING (doc_id))"""


@query("select_best_model", SQL_SPLIT + _sql_model_preds() + f""",
sc AS (
  SELECT model_key, ordinal, split,
         {_div0('2 * count_if(true_label = 1 AND pred_label = 1)',
                '2 * count_if(true_label = 1 AND pred_label = 1) + count_if(true_label = 0 AND pred_label = 1)'
                ' + count_if(true_label = 1 AND pred_label = 0)')} AS f1
  FROM mp GROUP BY 1, 2, 3),
best AS (SELECT * FROM sc WHERE split = 'dev' ORDER BY f1 DESC, ordinal LIMIT 1)
SELECT best.model_key AS best_model, best.f1 AS dev_f1_offensive, t.f1 AS test_f1_offensive
FROM best JOIN sc t ON t.model_key = best.model_key AND t.split = 'test'""")
def _select_best_model(spark, sf_dir):
    return select_best_model(spark, sf_dir)


@query("model_dev_scores", SQL_SPLIT + _sql_model_preds() + """
SELECT model_key, split, count(*) AS n_total, CAST(count_if(pred_label IS NULL) AS BIGINT) AS n_unparseable,
       CAST(count_if(true_label = 1 AND pred_label = 1) AS BIGINT) AS tp, CAST(count_if(true_label = 0 AND pred_label = 1) AS BIGINT) AS fp,
       CAST(count_if(true_label = 1 AND pred_label = 0) AS BIGINT) AS fn
FROM mp GROUP BY 1, 2""")
def model_dev_scores(spark, sf_dir):
    p = model_predictions(spark, sf_dir)
    return metrics.binary_counts(p, ["model_key", "split"]).select(
        "model_key", "split", "n_total", "n_unparseable", "tp", "fp", "fn")


def trial_dump(spark, sf_dir):
    """E2 + E10: the seeded trial sample, its comment prompt, label and every model's prediction."""
    from threadwatch.operators.prompts import comment_prompt
    items = ad.labelled_docs(spark, sf_dir).select("doc_id", "toxic", "text", "source")
    sample = metrics.seeded_sample(items, "doc_id", TRIAL_SAMPLE_SIZE)
    sample = sample.withColumn("prompt", comment_prompt(F.col("source"), F.col("text"), F.lit(None), F.lit(None), F.col("text")))
    answers = ad.model_answers(spark, sf_dir).select("doc_id", "model_key", "answer")
    return sample.join(answers, "doc_id").select("model_key", "doc_id", "prompt", F.col("toxic").alias("label"),
                                                 parse_label(F.col("answer")).alias("pred"))


def _sql_trial() -> str:
    from threadwatch.functions.prompt_text import COMMENT_PROMPT
    from threadwatch.operators.prompts import sql_render
    prompt = sql_render(COMMENT_PROMPT, {
        "video_title": "coalesce(source, 'N/A')", "video_description": "coalesce(text, 'N/A')",
        "head_comment": "'N/A'", "previous_comment": "'N/A'", "target_comment": "coalesce(text, 'nan')"})
    return f"""
WITH smp AS (
  SELECT doc_id, toxic, text, source, {prompt} AS prompt FROM labels JOIN documents USING (doc_id)
  ORDER BY {sql_uniform('doc_id', 42)}, doc_id LIMIT 50),
{ad.SQL_ANSWERS}
SELECT model_key, doc_id, prompt, smp.toxic AS label, {ad.sql_parse_label('answer')} AS pred FROM answers JOIN smp USING (doc_id)"""


query("trial_dump", _sql_trial())(trial_dump)


# ------------------------------------------------------------ risk prompts: every model and prompt scored

def risk_predictions(spark, sf_dir):
    """P10 -> A3 -> A5: every video x prompt x model scored in batches, parsed, with its true label."""
    from threadwatch.operators import annotate, prompts
    v = eval_dataset(spark, sf_dir)
    v = v.select("video_key", "video_topic", "true_label", *[
        F.coalesce(F.nullif(unicode_strip(F.col(c)), F.lit("")), F.lit("N/A")).alias(n)
        for c, n in (("video_text", "title"), ("video_description", "description"))])
    grid = prompts.risk_prompt_grid(v)
    keys = ["model_key", "prompt_id", "video_key", "video_topic", "true_label"]
    rule = lexicon.RiskRule()
    scored = annotate.score_prompts(grid.withColumn("asked", F.concat("model_key", F.lit("\n"), "prompt")), keys, "asked",
                                    lambda: rule)
    return scored.withColumn("pred_label", parse_label(F.col("raw_answer"))).drop("raw_answer")


def _sql_risk() -> str:
    from threadwatch.functions.prompt_text import RISK_PROMPTS
    rows = ", ".join("({}, '{}')".format(i, t.replace("'", "''")) for i, t in enumerate(RISK_PROMPTS))
    models = ", ".join(f"('{k}', {n})" for k, n in lexicon.RISK_SHARES.items())
    weights = " + ".join(lexicon.sql_letter_weights("prompt"))
    strip = "coalesce(nullif(trim({}, ' \t\n\r\x0b\x0c'), ''), 'N/A')"
    return SQL_EVAL + f""",
rv AS (SELECT video_key, video_topic, true_label, {strip.format('video_text')} AS title,
              {strip.format('video_description')} AS description FROM ev),
rt AS (SELECT * FROM (VALUES {rows}) AS x(prompt_id, tpl)),
rm AS (SELECT * FROM (VALUES {models}) AS x(model_key, share)),
rg AS (SELECT video_key, video_topic, true_label, prompt_id,
              replace(replace(tpl, '{{video_title}}', title), '{{video_description}}', description) AS prompt
       FROM rv CROSS JOIN rt),
rw AS (SELECT *, ({weights}) % 16 AS rest FROM rg),
preds AS (SELECT model_key AS baseline, CAST(prompt_id AS INTEGER) AS run, video_key, video_topic, true_label,
                 CASE WHEN rest = 15 THEN NULL WHEN rest < share THEN 1 ELSE 0 END AS pred_label
          FROM rw CROSS JOIN rm)"""


@query("risk_prompt_metrics", _sql_risk() + f""",
cnt AS (SELECT baseline, run, {SQL_COUNTS} FROM preds GROUP BY baseline, run),
{SQL_METRICS.strip()}
SELECT baseline AS model_key, run AS prompt_id, n_total, n_unparseable, {_METRIC_NAMES} FROM mt""")
def risk_prompt_metrics(spark, sf_dir):
    p = risk_predictions(spark, sf_dir).withColumn("prompt_id", F.col("prompt_id").cast("int"))
    by = ["model_key", "prompt_id"]
    return metrics.binary_metrics(metrics.binary_counts(p, by), by)
