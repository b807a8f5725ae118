"""Queries A1-A10 and P6-P10: pending sets, scoring, parsers and prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadwatch.functions.fixed import DESCRIPTION_MAX_CHARS, MODELS
from threadwatch.functions.prompt_text import COMMENT_PROMPT, RISK_PROMPTS, TOPIC_PROMPT
from threadwatch.functions.taxonomy import (CATEGORIES, canonical_topic, sql_canonical_topic, sql_topic_select,
                                            taxonomy_block, with_parsed_topic)
from threadwatch.functions.text import parse_label, truncate_description, unicode_strip
from threadwatch.operators import annotate, gold, lexicon, prompts, textmodel, threads
from threadwatch.plans import adapters as ad
from threadwatch.plans.q_figures import SQL_EVAL, eval_dataset
from threadwatch.plans.registry import query
from threadwatch.session import cut_lineage


def sql_truncate(x: str, n: int = 1000) -> str:
    head = f"left({x}, {n})"
    return (f"(CASE WHEN length({x}) > {n} THEN (CASE WHEN strpos({head}, '.') > 0 "
            f"THEN left({x}, {n} - strpos(reverse({head}), '.') + 1) ELSE {head} END) ELSE {x} END)")


@query("truncate_description", f"SELECT doc_id, {sql_truncate('text')} AS description FROM documents")
def truncate_description_q(spark, sf_dir):
    d = ad.table(spark, sf_dir, "documents").select("doc_id", "text")
    return d.select("doc_id", truncate_description(F.col("text"), DESCRIPTION_MAX_CHARS).alias("description"))


def answered_documents(spark, sf_dir):
    """Every whole document after an answer that its id picks: labels, categories, instances or nothing before the text."""
    d = ad.spread(ad.table(spark, sf_dir, "documents").select("doc_id", "text"))
    lead = F.element_at(F.array(*[F.lit(x) for x in ANSWER_LEADS]), (F.pmod("doc_id", F.lit(len(ANSWER_LEADS))) + 1).cast("int"))
    return d.select("doc_id", F.concat(lead, F.lit("\n"), "text").alias("answer"))


#: what answers look like; each reaches a branch of the parsers
ANSWER_LEADS = ["Sì", "no.", "Sì, anzi no", "si!", "  SÌ\t", "forse", "", "così", "Sport", "COUP D’ETAT", "La categoria: sport",
                "parla di climate change", "education e health", "  crime  "]
SQL_ANSWERED = "answered AS (SELECT doc_id, lead || chr(10) || text AS answer FROM (" \
    "SELECT doc_id, text, [" + ", ".join("'" + x.replace("'", "''") + "'" for x in ANSWER_LEADS) + \
    f"][doc_id % {len(ANSWER_LEADS)} + 1] AS lead FROM documents))"


@query("parse_label", f"WITH {SQL_ANSWERED} SELECT doc_id, {ad.sql_parse_label('answer')} AS label FROM answered")
def parse_label_q(spark, sf_dir):
    return answered_documents(spark, sf_dir).select("doc_id", parse_label(F.col("answer")).alias("label"))


@query("parse_topic", f"WITH {SQL_ANSWERED} " + sql_topic_select("answered", "doc_id", "answer"))
def parse_topic_q(spark, sf_dir):
    return with_parsed_topic(answered_documents(spark, sf_dir), "answer").select("doc_id", "topic")


@query("canonical_topic", "WITH " + ad.sql_topic_annotations().strip() + f"""
SELECT newspaper, file_id, annotator, topic AS topic_raw, {sql_canonical_topic('topic')} AS topic
FROM topic_annotations""")
def canonical_topic_q(spark, sf_dir):
    t = ad.topic_annotations(spark, sf_dir)
    return t.select("newspaper", "file_id", "annotator", F.col("topic").alias("topic_raw"),
                    canonical_topic(F.col("topic")).alias("topic"))


SQL_GOLD_TOPICS = "WITH " + ad.sql_topic_annotations().strip() + """,
tv AS (SELECT newspaper, file_id, topic, count(*) AS n FROM topic_annotations GROUP BY ALL),
tvr AS (SELECT *, row_number() OVER (PARTITION BY newspaper, file_id ORDER BY n DESC, topic NULLS FIRST) AS r,
               max(n) OVER (PARTITION BY newspaper, file_id) AS mx FROM tv),
gt AS (SELECT newspaper, file_id, CASE WHEN mx > 1 THEN topic END AS topic FROM tvr WHERE r = 1)"""


@query("gold_videos", SQL_GOLD_TOPICS + f"""
SELECT newspaper, file_id, topic AS topic_raw, {sql_canonical_topic('topic')} AS topic
FROM gt WHERE topic IS NOT NULL AND trim(topic) <> ''""")
def gold_videos_q(spark, sf_dir):
    g = gold.majority_topic(ad.topic_annotations(spark, sf_dir), ["newspaper", "file_id"])
    return annotate.gold_videos(cut_lineage(g.select("newspaper", "file_id", "topic")))  # asked twice: is there any, and which


# ---------------------------------------------------------------- pending set and silver topics

def _doc_sets(spark, sf_dir):
    d = ad.table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    raw = d.select(ad.newspaper_of(F.col("doc_id")).alias("newspaper"),
                   F.col("doc_id").cast("string").alias("file_id"), "text", "source")
    lab = ad.table(spark, sf_dir, "labels").select(ad.newspaper_of(F.col("doc_id")).alias("newspaper"),
                                                  F.col("doc_id").cast("string").alias("file_id"), "quality")
    return raw, lab.filter(F.col("quality") == 1), lab.filter(F.col("quality") == 0)


SQL_DOC_SETS = f"""
WITH raw AS (SELECT {ad.sql_pick(ad.NEWSPAPERS, 'doc_id')} AS newspaper, CAST(doc_id AS VARCHAR) AS file_id, text, source
             FROM documents),
lab AS (SELECT {ad.sql_pick(ad.NEWSPAPERS, 'doc_id')} AS newspaper, CAST(doc_id AS VARCHAR) AS file_id, quality
        FROM labels),
pend AS (SELECT * FROM raw WHERE (newspaper, file_id) NOT IN (SELECT (newspaper, file_id) FROM lab))"""


@query("pending_set", SQL_DOC_SETS + "\nSELECT newspaper, file_id FROM pend")
def pending_set(spark, sf_dir):
    raw, g, s = _doc_sets(spark, sf_dir)
    return annotate.pending(raw, g, s, ["newspaper", "file_id"]).select("newspaper", "file_id")


@query("run_counters", SQL_DOC_SETS + """,
st AS (
  SELECT CASE WHEN g.file_id IS NOT NULL THEN 'skipped_gold'
              WHEN s.file_id IS NOT NULL THEN 'skipped_silver'
              WHEN raw.text IS NULL OR raw.text = '' THEN 'skipped_empty'
              ELSE 'pending' END AS status
  FROM raw
  LEFT JOIN (SELECT DISTINCT newspaper, file_id FROM lab WHERE quality = 1) g USING (newspaper, file_id)
  LEFT JOIN (SELECT DISTINCT newspaper, file_id FROM lab WHERE quality = 0) s USING (newspaper, file_id))
SELECT status, count(*) AS n FROM st GROUP BY status""")
def run_counters(spark, sf_dir):
    raw, g, s = _doc_sets(spark, sf_dir)
    return annotate.run_counters(annotate.status_table(raw, g, s, ["newspaper", "file_id"], "text"))


def silver_topics(spark, sf_dir):
    """A1 -> P8 -> A3 (text rule) -> A6 -> A8 for the pending documents."""
    raw, g, s = _doc_sets(spark, sf_dir)
    p = annotate.pending(raw, g, s, ["newspaper", "file_id"])
    p = p.withColumn("prompt", prompts.topic_prompt(F.col("source"), F.col("text")))
    rule = lexicon.TopicRule(CATEGORIES, *prompts.around(TOPIC_PROMPT, "article_description"))
    scored = annotate.score_prompts(p, ["newspaper", "file_id"], "prompt", lambda: rule)
    out = with_parsed_topic(scored, "raw_answer", "parsed_topic")
    return annotate.attach_silver_topic(out).select("newspaper", "file_id", "topic")


SQL_SILVER = f""",
described AS (SELECT newspaper, file_id, coalesce(nullif(text, ''), 'N/A') AS description FROM pend),
answered AS (
  SELECT newspaper, file_id,
         coalesce('Categoria: ' || upper({lexicon.sql_top_category(lexicon.sql_letter_weights('description'), CATEGORIES)}),
                  'non saprei') AS answer FROM described),
parsed AS ({sql_topic_select("answered", "newspaper, file_id", "answer")})"""


@query("annotate_silver", SQL_DOC_SETS + SQL_SILVER + """
SELECT newspaper, file_id, coalesce(topic, '') AS topic FROM parsed""")
def annotate_silver(spark, sf_dir):
    return silver_topics(spark, sf_dir)


# ---------------------------------------------------------------- the comment annotation job

COMMENT_MODEL = "gemma3"


def silver_comments(spark, sf_dir):
    """A1 -> T5 -> A9 -> P7 -> A3 -> A5 -> A8: labels of the conversation comments that have none yet.

    Videos whose document is labelled of quality 1 are gold, of 0 silver; the others' comments
    with a text are pending.  Returns (statuses, labelled).
    """
    c = ad.conversation_comments(spark, sf_dir).withColumn("inferred_parent_id", F.col("parent_comment_id"))
    lab = ad.table(spark, sf_dir, "labels").select(
        F.concat(F.lit("conv"), F.col("doc_id").cast("string")).alias("video_id"), "quality")
    g, s = lab.filter("quality = 1"), lab.filter("quality = 0")
    statuses = annotate.status_table(c.select("video_id", "comment_id", "text"), g, s, ["video_id"], "text")
    ctx = threads.context_columns(c, threads.thread_depth(c))
    d = ad.table(spark, sf_dir, "documents").select(
        F.concat(F.lit("conv"), F.col("doc_id").cast("string")).alias("video_id"),
        F.col("source").alias("title"), F.col("text").alias("description"))
    asked = annotate.pending(ctx, g, s, ["video_id"]).filter("text <> ''")
    asked = annotate.attach_metadata(asked, d, ["video_id"]).withColumn("prompt", prompts.comment_prompt(
        F.col("title"), F.col("description"), F.col("head_comment_text"), F.col("previous_comment_text"), F.col("text")))
    models = textmodel.fit(ad.hashed_labelled_docs(spark, sf_dir), "toxic")
    rule = lexicon.FittedRule(next(m for m in models if (m.model_key, m.fold) == (COMMENT_MODEL, 0)),
                              *prompts.around(COMMENT_PROMPT, "target_comment"))
    scored = annotate.score_prompts(asked, ["video_id", "comment_id"], "prompt", lambda: rule)
    return statuses, annotate.attach_silver_label(scored)


SQL_COMMENT_JOB = "WITH " + ad.SQL_CONVERSATION_COMMENTS.strip() + f""",
lab AS (SELECT 'conv' || doc_id AS video_id, quality FROM labels),
st AS (SELECT c.*, CASE WHEN c.video_id IN (SELECT video_id FROM lab WHERE quality = 1) THEN 'skipped_gold'
                        WHEN c.video_id IN (SELECT video_id FROM lab WHERE quality = 0) THEN 'skipped_silver'
                        WHEN text IS NULL OR text = '' THEN 'skipped_empty' ELSE 'pending' END AS status FROM conv_comments c),
tm_docs AS (SELECT doc_id, toxic, text FROM labels JOIN documents USING (doc_id)),
{textmodel.sql_fit('tm_docs', 'doc_id', 'toxic').strip()},
asked AS (SELECT video_id, comment_id, video_id || '/' || comment_id AS ck, text, 0 AS held FROM st WHERE status = 'pending'),
asked_words AS ({textmodel.sql_words('asked', 'ck')}),
scores AS ({textmodel.sql_scores('asked_words', 'asked', 'ck', f"(SELECT * FROM tm_sizes WHERE model_key = '{COMMENT_MODEL}')")}),
ans AS (SELECT video_id, comment_id, {textmodel.sql_answer('value', 'has_words')} AS answer FROM asked JOIN scores USING (ck)),
lbl AS (SELECT video_id, comment_id, {ad.sql_parse_label('answer')} AS label FROM ans)"""


@query("annotate_comments", SQL_COMMENT_JOB + "\nSELECT video_id, comment_id, label FROM lbl")
def annotate_comments(spark, sf_dir):
    return silver_comments(spark, sf_dir)[1].select("video_id", "comment_id", "label")


@query("comment_run_counters", SQL_COMMENT_JOB + """
SELECT status, count(*) AS n FROM st WHERE status LIKE 'skipped_%' GROUP BY status
UNION ALL SELECT 'written', count(*) FROM lbl
UNION ALL SELECT 'unparseable', count(*) FILTER (WHERE label IS NULL) FROM lbl
UNION ALL SELECT 'errors', (SELECT count(*) FROM st WHERE status = 'pending') - (SELECT count(*) FROM lbl)""")
def comment_run_counters(spark, sf_dir):
    statuses, labelled = silver_comments(spark, sf_dir)
    return annotate.annotation_counters(statuses, labelled, "label")


# ---------------------------------------------------------------- prompts

def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


@query("topic_prompts", f"""
SELECT doc_id, {prompts.sql_render(TOPIC_PROMPT, {
    "taxonomy": _sql_str(taxonomy_block()),
    "article_title": "coalesce(nullif(source, ''), 'N/A')",
    "article_description": f"coalesce(nullif(text, ''), 'N/A')"})} AS prompt
FROM documents""")
def topic_prompts(spark, sf_dir):
    d = ad.table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return d.select("doc_id", prompts.topic_prompt(F.col("source"), F.col("text"))
                    .alias("prompt"))


def comment_prompts(spark, sf_dir):
    """T5 + A9 + P6 + P7: conversation turns as comments, documents as their videos' metadata."""
    c = ad.conversation_comments(spark, sf_dir).withColumn("inferred_parent_id", F.col("parent_comment_id"))
    ctx = threads.context_columns(c, threads.thread_depth(c))
    d = ad.table(spark, sf_dir, "documents").select(
        F.concat(F.lit("conv"), F.col("doc_id").cast("string")).alias("video_id"),
        F.col("source").alias("title"), F.col("text").alias("description"))
    j = annotate.attach_metadata(ctx, d, ["video_id"])
    return j.select("video_id", "comment_id", prompts.comment_prompt(
        F.col("title"), F.col("description"), F.col("head_comment_text"), F.col("previous_comment_text"),
        F.col("text")).alias("prompt"))


def _sql_comment_prompts() -> str:
    from threadwatch.plans.q_threads import SQL_CONTEXT
    return SQL_CONTEXT + f""",
meta AS (SELECT 'conv' || doc_id AS video_id, source AS title, text AS description FROM documents),
j AS (SELECT ctx.*, coalesce(meta.title, '') AS title, coalesce(meta.description, '') AS description
      FROM ctx LEFT JOIN meta USING (video_id))
SELECT video_id, comment_id, {prompts.sql_render(COMMENT_PROMPT, {
        "video_title": "coalesce(title, 'N/A')", "video_description": "coalesce(description, 'N/A')",
        "head_comment": "coalesce(head_comment_text, 'N/A')",
        "previous_comment": "coalesce(previous_comment_text, 'N/A')",
        "target_comment": "coalesce(text, 'nan')"})} AS prompt
FROM j"""


query("render_prompts", _sql_comment_prompts())(comment_prompts)


@query("attach_metadata", "WITH " + ad.SQL_CONVERSATION_COMMENTS.strip() + f""",
meta AS (SELECT 'conv' || doc_id AS video_id, source AS title, text AS description FROM documents)
SELECT c.video_id, c.comment_id, coalesce(m.title, '') AS title, coalesce(m.description, '') AS description
FROM conv_comments c LEFT JOIN meta m USING (video_id)""")
def attach_metadata_q(spark, sf_dir):
    c = ad.conversation_comments(spark, sf_dir)
    d = ad.table(spark, sf_dir, "documents").select(
        F.concat(F.lit("conv"), F.col("doc_id").cast("string")).alias("video_id"),
        F.col("source").alias("title"), F.col("text").alias("description"))
    return annotate.attach_metadata(c, d, ["video_id"]).select("video_id", "comment_id", "title", "description")


MODEL_KEYS = [m[0] for m in MODELS]


@query("prompt_grid", SQL_EVAL + """,
v AS (SELECT video_key, coalesce(nullif(trim(video_text, ' \t\n\r\x0b\x0c'), ''), 'N/A') AS title,
             coalesce(nullif(trim(video_description, ' \t\n\r\x0b\x0c'), ''), 'N/A') AS description FROM ev),
t AS (SELECT * FROM (VALUES """ + ", ".join(f"({i}, {_sql_str(tpl)})" for i, tpl in enumerate(RISK_PROMPTS)) + """
) AS x(prompt_id, tpl)),
m AS (SELECT unnest(""" + "[" + ", ".join(_sql_str(k) for k in MODEL_KEYS) + "]" + """) AS model_key),
g AS (SELECT v.video_key, CAST(t.prompt_id AS INTEGER) AS prompt_id, m.model_key,
             replace(replace(t.tpl, '{video_title}', v.title), '{video_description}', v.description) AS prompt
      FROM v CROSS JOIN t CROSS JOIN m)
SELECT video_key, prompt_id, model_key, length(prompt) AS prompt_chars, md5(prompt) AS prompt_md5 FROM g""")
def prompt_grid(spark, sf_dir):
    v = eval_dataset(spark, sf_dir)
    v = v.select("video_key",
                 F.coalesce(F.nullif(unicode_strip(F.col("video_text")), F.lit("")), F.lit("N/A")).alias("title"),
                 F.coalesce(F.nullif(unicode_strip(F.col("video_description")), F.lit("")), F.lit("N/A")).alias("description"))
    g = prompts.risk_prompt_grid(v)
    return g.select("video_key", F.col("prompt_id").cast("int").alias("prompt_id"), "model_key",
                    F.length("prompt").cast("bigint").alias("prompt_chars"), F.md5("prompt").alias("prompt_md5"))


@query("silver_run_counters", SQL_DOC_SETS + """,
st AS (
  SELECT CASE WHEN g.file_id IS NOT NULL THEN 'skipped_gold'
              WHEN s.file_id IS NOT NULL THEN 'skipped_silver' END AS status
  FROM raw
  LEFT JOIN (SELECT DISTINCT newspaper, file_id FROM lab WHERE quality = 1) g USING (newspaper, file_id)
  LEFT JOIN (SELECT DISTINCT newspaper, file_id FROM lab WHERE quality = 0) s USING (newspaper, file_id))""" + SQL_SILVER + """
SELECT status, count(*) AS n FROM st WHERE status IS NOT NULL GROUP BY status
UNION ALL SELECT 'written', count(*) FROM parsed
UNION ALL SELECT 'unparseable', count(*) FILTER (WHERE topic IS NULL) FROM parsed""")
def silver_run_counters(spark, sf_dir):
    """A1 + A2 + A3 + A8: run counters of a silver topic run (skips, written, unparseable)."""
    raw, g, s = _doc_sets(spark, sf_dir)
    st = annotate.status_table(raw.withColumn("_t", F.lit("x")), g, s, ["newspaper", "file_id"], "_t")
    return annotate.outcome_counters(st, silver_topics(spark, sf_dir), "topic", "")


# ---------------------------------------------------------------- topic classifier selection (E9 on topics)

def topic_answers(spark, sf_dir):
    """``(file_id, model_key, ordinal, answer)``: each model names the category whose letter it makes most of in a video's texts."""
    cats = [lexicon.top_category([w * m for w, m in lexicon.readings([F.col(n) for n in ad.LETTERS], key)], CATEGORIES)
            for key in MODEL_KEYS]
    each = F.array(*[F.coalesce(F.concat(F.lit("Categoria: "), F.upper(c)), F.lit("non saprei")) for c in cats])
    long = ad.video_letters(spark, sf_dir).select(F.concat(F.lit("d"), F.col("vnum").cast("string")).alias("file_id"),
                                                  F.posexplode(each).alias("ordinal", "answer"))
    return long.withColumn("model_key", F.element_at(F.array(*[F.lit(k) for k in MODEL_KEYS]), F.col("ordinal") + 1))


def select_best_topic_model(spark, sf_dir):
    """A10 -> E1 -> A6 -> E4 -> E9: macro-F1 of every model on dev, first maximum, scored once on test.

    As in the reference, a topic of a single video makes the split unstratified.
    """
    from threadwatch.operators import metrics
    g = gold.majority_topic(ad.topic_annotations(spark, sf_dir), ["newspaper", "file_id"])
    gv = cut_lineage(annotate.gold_videos(cut_lineage(g.select("newspaper", "file_id", "topic"))).select("file_id", "topic"))
    s = metrics.dev_test_split(gv, "file_id", "topic", unstratified_fallback=True)
    asked = s.withColumnRenamed("topic", "true_label").join(topic_answers(spark, sf_dir), "file_id")
    preds = cut_lineage(with_parsed_topic(asked, "answer", "pred_label").drop("answer"))
    scores = metrics.macro_f1(preds, ["model_key", "ordinal", "split"])
    best = scores.filter(F.col("split") == "dev").orderBy(F.col("macro_f1").desc(), "ordinal").limit(1)
    test = scores.filter(F.col("split") == "test").select("model_key", F.col("macro_f1").alias("test_macro_f1"))
    return best.join(test, "model_key").select(F.col("model_key").alias("best_model"),
                                               F.col("macro_f1").alias("dev_macro_f1"), "test_macro_f1")


def _sql_select_best_topic_model() -> str:
    from threadwatch.functions.scoring import sql_uniform
    ctes = [f"""gv AS (SELECT file_id, {sql_canonical_topic('topic')} AS topic FROM gt
          WHERE topic IS NOT NULL AND trim(topic) <> '')""",
            "counts AS (SELECT topic, count(*) AS c FROM gv GROUP BY topic)",
            "tot AS (SELECT sum(c) AS n, CAST(ceil(0.4::DOUBLE * sum(c)) AS BIGINT) AS n_test, min(c) AS minc FROM counts)",
            "q AS (SELECT topic, c, c * (n - n_test) / n AS cont FROM counts, tot)",
            "q2 AS (SELECT topic, c, floor(cont) AS fl, cont - floor(cont) AS rem FROM q)",
            "need AS (SELECT (SELECT n - n_test FROM tot) - sum(fl) AS need FROM q2)",
            "ranked AS (SELECT q2.*, row_number() OVER (ORDER BY rem DESC, topic) AS r FROM q2)",
            "quota AS (SELECT topic, c - (fl + CASE WHEN r <= (SELECT need FROM need) THEN 1 ELSE 0 END) AS quota FROM ranked)",
            f"uu AS (SELECT file_id, topic, {sql_uniform('file_id', 42)} AS u FROM gv)",
            """sp AS (
  SELECT uu.file_id, uu.topic,
         CASE WHEN (SELECT minc FROM tot) >= 2
              THEN CASE WHEN row_number() OVER (PARTITION BY uu.topic ORDER BY u, file_id) - 1 < quota.quota
                        THEN 'test' ELSE 'dev' END
              ELSE CASE WHEN row_number() OVER (ORDER BY u, file_id) - 1 < (SELECT n_test FROM tot)
                        THEN 'test' ELSE 'dev' END END AS split
  FROM uu JOIN quota USING (topic))"""]
    parts = []
    for i, key in enumerate(MODEL_KEYS):
        ctes.append(f"ta_{key} AS (SELECT sp.file_id, split, topic, coalesce('Categoria: ' || upper("
                    f"{ad.sql_category_by(key)}), 'non saprei') AS answer "
                    f"FROM sp JOIN video_letters v ON sp.file_id = 'd' || v.vnum)")
        ctes.append(f"tp_{key} AS ({sql_topic_select(f'ta_{key}', 'file_id, split, topic', 'answer', 'pred')})")
        parts.append(f"SELECT '{key}' AS model_key, {i} AS ordinal, file_id, split, topic AS t, pred AS p "
                     f"FROM tp_{key}")
    ctes.append("mp AS (" + " UNION ALL ".join(parts) + ")")
    ctes.append("""conf AS (SELECT model_key, ordinal, split, t, p, count(*) AS n FROM mp WHERE p IS NOT NULL GROUP BY ALL)""")
    ctes.append("""sides AS (
  SELECT model_key, ordinal, split, t AS label, CASE WHEN t = p THEN n ELSE 0 END AS tp, 0 AS fp,
         CASE WHEN t <> p THEN n ELSE 0 END AS fn FROM conf
  UNION ALL
  SELECT model_key, ordinal, split, p, 0, CASE WHEN t <> p THEN n ELSE 0 END, 0 FROM conf)""")
    ctes.append("""pc AS (SELECT model_key, ordinal, split, label,
  coalesce(CAST(2 * sum(tp) AS DOUBLE) / nullif(2 * sum(tp) + sum(fp) + sum(fn), 0), 0.0) AS f1
  FROM sides GROUP BY ALL)""")
    ctes.append("""ms AS (SELECT m.model_key, m.ordinal, m.split, coalesce(avg(pc.f1), 0.0) AS macro_f1
  FROM (SELECT DISTINCT model_key, ordinal, split FROM mp) m LEFT JOIN pc USING (model_key, ordinal, split)
  GROUP BY ALL)""")
    ctes.append("best AS (SELECT * FROM ms WHERE split = 'dev' ORDER BY macro_f1 DESC, ordinal LIMIT 1)")
    return SQL_GOLD_TOPICS + ",\n" + ",\n".join(ctes) + """
SELECT best.model_key AS best_model, best.macro_f1 AS dev_macro_f1, t.macro_f1 AS test_macro_f1
FROM best JOIN ms t ON t.model_key = best.model_key AND t.split = 'test'"""


query("select_best_topic_model", _sql_select_best_topic_model())(select_best_topic_model)
