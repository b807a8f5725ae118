"""Map the driver's tables onto the domain model (and the same in DuckDB SQL).

The driver ships TPC-H-style tables, not comment dumps, so each domain table
is a projection of one of them.  Every mapping is a per-row expression or a
join over whole tables (no row caps, no id subsets), so the work grows with
the input:

* videos (annotated metadata files)  <- ``orders``: one silver file per order,
  plus a gold file for finished (``o_orderstatus = 'F'``) orders; topic is a
  taxonomy category picked by the customer, none for pending orders.
* comments (annotated comment rows)  <- ``lineitem``: one comment per line of
  the order; label 1 = returned (``R``), 0 = accepted (``A``), null = ``N``;
  a line belongs to the order's gold file when finished (``F``), else silver.
* threads                           <- ``events`` (blocks of 20 events are a
  thread; 200 events a video) and ``conversations`` (turn n replies to n-1).
* annotation / evaluation items     <- ``documents`` joined with ``labels``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadwatch.functions.fixed import ANNOTATORS, MODELS, NEWSPAPERS
from threadwatch.functions.scoring import sql_uniform, uniform  # noqa: F401
from threadwatch.functions.taxonomy import CATEGORIES, TAXONOMY
from threadwatch.operators import lexicon, textmodel
from threadwatch.session import cut_lineage


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where it comes in fewer partitions (a small table in one file); else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def pick(values: list[str], idx: Column) -> Column:
    """``values[idx % len]`` for a non-negative integer column."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(idx, F.lit(len(values))) + 1).cast("int"))


def sql_pick(values: list[str], idx_sql: str) -> str:
    return f"{_sql_list(values)}[({idx_sql}) % {len(values)} + 1]"


def newspaper_of(key: Column) -> Column:
    return pick(NEWSPAPERS, key)


# ---------------------------------------------------------------- videos / comments

def video_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotated metadata files: ``(newspaper, file_id, kind, title, description, topic)``."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    topic = F.when(F.col("o_orderstatus") != "P", pick(CATEGORIES, F.col("o_custkey")))
    base = o.select(
        newspaper_of(F.col("o_orderkey")).alias("newspaper"),
        F.col("o_orderkey").cast("string").alias("file_id"),
        F.col("o_orderpriority").alias("title"),
        F.concat(F.lit(" status "), F.col("o_orderstatus"), F.lit(" ")).alias("description"),
        topic.alias("topic"), F.col("o_orderstatus"))
    silver = base.withColumn("kind", F.lit("silver"))
    gold = base.filter(F.col("o_orderstatus") == "F").withColumn("kind", F.lit("gold"))
    cols = ["newspaper", "file_id", "kind", "title", "description", "topic"]
    return silver.select(*cols).unionByName(gold.select(*cols))


SQL_VIDEO_FILES = f"""
video_base AS (
  SELECT {sql_pick(NEWSPAPERS, 'o_orderkey')} AS newspaper,
         CAST(o_orderkey AS VARCHAR) AS file_id,
         o_orderpriority AS title,
         ' status ' || o_orderstatus || ' ' AS description,
         CASE WHEN o_orderstatus <> 'P' THEN {sql_pick(CATEGORIES, 'o_custkey')} END AS topic,
         o_orderstatus
  FROM orders),
video_files AS (
  SELECT newspaper, file_id, 'silver' AS kind, title, description, topic FROM video_base
  UNION ALL
  SELECT newspaper, file_id, 'gold' AS kind, title, description, topic FROM video_base
  WHERE o_orderstatus = 'F')"""


def comment_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotated comments: ``(newspaper, file_id, kind, label)``, one row per line item."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus")
    return li.select(
        newspaper_of(F.col("l_orderkey")).alias("newspaper"),
        F.col("l_orderkey").cast("string").alias("file_id"),
        F.when(F.col("l_linestatus") == "F", "gold").otherwise("silver").alias("kind"),
        F.when(F.col("l_returnflag") == "R", 1).when(F.col("l_returnflag") == "A", 0)
         .cast("int").alias("label"))


SQL_COMMENT_ROWS = f"""
comment_rows AS (
  SELECT {sql_pick(NEWSPAPERS, 'l_orderkey')} AS newspaper,
         CAST(l_orderkey AS VARCHAR) AS file_id,
         CASE WHEN l_linestatus = 'F' THEN 'gold' ELSE 'silver' END AS kind,
         CAST(CASE WHEN l_returnflag = 'R' THEN 1 WHEN l_returnflag = 'A' THEN 0 END AS INTEGER) AS label
  FROM lineitem)"""


# ---------------------------------------------------------------- threads

def event_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comment rows from ``events``.

    ``(video_id, comment_id, parent_comment_id, is_reply, author, published_at, text, like_count)``.
    Replies of click/view/purchase events open with a mention of the author of
    an earlier event in the same block, written in three styles (plain with a
    trailing comma, with a no-break space and ``!``, and a dotted handle).
    """
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")
    root = F.col("event_id") - F.pmod(F.col("event_id"), F.lit(20))
    w = Window.partitionBy(root).orderBy("event_id")
    back = (F.pmod(F.col("event_id"), F.lit(3)) + 1).cast("int")
    prev_user = F.coalesce(
        F.when(back == 1, F.lag("user_id", 1).over(w))
         .when(back == 2, F.lag("user_id", 2).over(w))
         .otherwise(F.lag("user_id", 3).over(w)), F.col("user_id"))
    is_reply = F.pmod(F.col("event_id"), F.lit(20)) != 0
    mention = (F.when(F.col("event_type") == "click",
                      F.concat(F.lit(" @U"), prev_user.cast("string"), F.lit("! ")))
               .when(F.col("event_type") == "view",
                     F.concat(F.lit("@u"), prev_user.cast("string"), F.lit(", ")))
               .when(F.col("event_type") == "purchase",
                     F.concat(F.lit("@u"), prev_user.cast("string"), F.lit(".x ")))
               .otherwise(F.lit("")))
    text = F.concat(F.when(is_reply, mention).otherwise(F.lit("")), F.col("props"))
    return e.select(
        F.concat(F.lit("v"), F.floor(F.col("event_id") / 200).cast("string")).alias("video_id"),
        F.concat(F.lit("c"), F.col("event_id").cast("string")).alias("comment_id"),
        F.when(is_reply, F.concat(F.lit("c"), root.cast("string"))).alias("parent_comment_id"),
        is_reply.alias("is_reply"),
        F.concat(F.lit("@U"), F.col("user_id").cast("string")).alias("author"),
        F.col("ts").alias("published_at"),
        text.alias("text"),
        F.floor(F.col("value")).cast("bigint").alias("like_count"))


SQL_EVENT_COMMENTS = """
ev AS (
  SELECT *, event_id - event_id % 20 AS root, event_id % 20 <> 0 AS is_reply,
         coalesce(CASE event_id % 3
                    WHEN 0 THEN lag(user_id, 1) OVER (PARTITION BY event_id - event_id % 20 ORDER BY event_id)
                    WHEN 1 THEN lag(user_id, 2) OVER (PARTITION BY event_id - event_id % 20 ORDER BY event_id)
                    ELSE lag(user_id, 3) OVER (PARTITION BY event_id - event_id % 20 ORDER BY event_id) END,
                  user_id) AS prev_user
  FROM events),
event_comments AS (
  SELECT 'v' || CAST(floor(event_id / 200) AS BIGINT) AS video_id,
         'c' || event_id AS comment_id,
         CASE WHEN is_reply THEN 'c' || root END AS parent_comment_id,
         is_reply,
         '@U' || user_id AS author,
         ts AS published_at,
         (CASE WHEN is_reply THEN (CASE event_type WHEN 'click' THEN ' @U' || prev_user || '! '
                                                   WHEN 'view' THEN '@u' || prev_user || ', '
                                                   WHEN 'purchase' THEN '@u' || prev_user || '.x '
                                                   ELSE '' END)
               ELSE '' END) || props AS text,
         CAST(floor(value) AS BIGINT) AS like_count
  FROM ev)"""


def conversation_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comment rows from ``conversations``: turn n replies to turn n-1."""
    c = table(spark, sf_dir, "conversations")
    cid = F.concat(F.lit("k"), F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string"))
    parent = F.when(F.col("turn") > 0, F.concat(F.lit("k"), F.col("conv_id").cast("string"), F.lit(":"),
                                                 (F.col("turn") - 1).cast("string")))
    return c.select(
        F.concat(F.lit("conv"), F.col("conv_id").cast("string")).alias("video_id"),
        cid.alias("comment_id"), parent.alias("parent_comment_id"),
        (F.col("turn") > 0).alias("is_reply"), F.col("role").alias("author"), F.col("text"))


SQL_CONVERSATION_COMMENTS = """
conv_comments AS (
  SELECT 'conv' || conv_id AS video_id, 'k' || conv_id || ':' || turn AS comment_id,
         CASE WHEN turn > 0 THEN 'k' || conv_id || ':' || (turn - 1) END AS parent_comment_id,
         turn > 0 AS is_reply, role AS author, text
  FROM conversations)"""


# ---------------------------------------------------------------- annotation items

def labelled_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``labels`` joined to ``documents``: one evaluation item per labelled doc."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    lab = table(spark, sf_dir, "labels")
    return lab.join(d, "doc_id")


def annotation_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotators' workload listing ``(newspaper, file_id, annotator)``.

    A video is eight consecutive documents.  Three of the five annotators are
    chosen per video by the md5 draw; one video in ten lost its third
    annotation and one in twenty got a duplicate of its first, so the coverage
    check has something to report.
    """
    d = table(spark, sf_dir, "documents").select("doc_id")
    vid = F.floor(F.col("doc_id") / 8).cast("bigint")
    videos = d.select(vid.alias("vnum")).distinct()
    ann = videos.select("vnum", F.explode(F.array(*[F.lit(a) for a in ANNOTATORS])).alias("annotator"))
    ann = ann.withColumn("u", uniform(F.concat(F.col("vnum").cast("string"), F.col("annotator")), 7))
    ann = ann.withColumn("rank", F.row_number().over(Window.partitionBy("vnum").orderBy("u", "annotator")))
    cov = uniform(F.col("vnum"), "cov")
    ann = ann.withColumn("cov", cov)
    kept = ann.filter((F.col("rank") <= 2) | ((F.col("rank") == 3) & (F.col("cov") >= 0.1)))
    dup = ann.filter((F.col("rank") == 1) & (F.col("cov") >= 0.1) & (F.col("cov") < 0.15))
    files = kept.unionByName(dup)
    return files.select(newspaper_of(F.col("vnum")).alias("newspaper"),
                        F.concat(F.lit("d"), F.col("vnum").cast("string")).alias("file_id"),
                        "annotator")


SQL_ANNOTATION_FILES = f"""
ann_videos AS (SELECT DISTINCT CAST(floor(doc_id / 8) AS BIGINT) AS vnum FROM documents),
ann_all AS (
  SELECT vnum, annotator, {sql_uniform("vnum || annotator", 7)} AS u, {sql_uniform("vnum", "cov")} AS cov
  FROM ann_videos, (SELECT unnest({_sql_list(ANNOTATORS)}) AS annotator)),
ann_ranked AS (
  SELECT *, row_number() OVER (PARTITION BY vnum ORDER BY u, annotator) AS rank FROM ann_all),
annotation_files AS (
  SELECT {sql_pick(NEWSPAPERS, 'vnum')} AS newspaper, 'd' || vnum AS file_id, annotator
  FROM ann_ranked WHERE rank <= 2 OR (rank = 3 AND cov >= 0.1)
  UNION ALL
  SELECT {sql_pick(NEWSPAPERS, 'vnum')} AS newspaper, 'd' || vnum AS file_id, annotator
  FROM ann_ranked WHERE rank = 1 AND cov >= 0.1 AND cov < 0.15)"""


def comment_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long annotation table for comments ``(newspaper, file_id, comment_id, annotator, label, text)``.

    Each annotator of a video labels every labelled document of it by their own rule over
    its text (``lexicon.ANNOTATOR_RULES``); very short texts get no label.
    """
    items = spread(labelled_docs(spark, sf_dir).select("doc_id", "text")).select(
        F.concat(F.lit("d"), F.floor(F.col("doc_id") / 8).cast("bigint").cast("string")).alias("file_id"),
        F.col("doc_id").cast("string").alias("comment_id"), "text", lexicon.terms_in(F.col("text")).alias("_found"))
    a = annotation_files(spark, sf_dir).join(items, "file_id")
    label = lexicon.annotator_label(F.col("_found"), F.length("text"), F.col("annotator"))
    return a.select("newspaper", "file_id", "comment_id", "annotator", label.alias("label"), "text")


SQL_COMMENT_ANNOTATIONS = SQL_ANNOTATION_FILES + f""",
ann_items AS (
  SELECT 'd' || CAST(floor(l.doc_id / 8) AS BIGINT) AS file_id, CAST(l.doc_id AS VARCHAR) AS comment_id, d.text
  FROM labels l JOIN documents d USING (doc_id)),
comment_annotations AS (
  SELECT f.newspaper, f.file_id, i.comment_id, f.annotator,
         {lexicon.sql_annotator_label('i.text', 'f.annotator')} AS label, i.text
  FROM annotation_files f JOIN ann_items i USING (file_id))"""


LETTERS = [f"l{i}" for i in range(len(lexicon.TOPIC_LETTERS))]


def doc_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, vnum, l0..l16)``: weighted letter counts of every whole text."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.lower("text").alias("_low"))
    return lexicon.with_letter_weights(d, "_low", LETTERS) \
        .select("doc_id", F.floor(F.col("doc_id") / 8).cast("bigint").alias("vnum"), *LETTERS)


def video_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(vnum, l0..l16)``: the weights of all documents of a video."""
    return doc_letters(spark, sf_dir).groupBy("vnum").agg(*[F.sum(n).alias(n) for n in LETTERS])


SQL_DOC_LETTERS = "doc_letters AS (SELECT doc_id, CAST(floor(doc_id / 8) AS BIGINT) AS vnum, " + ", ".join(
    f"CAST({w} AS BIGINT) AS {n}" for w, n in zip(lexicon.sql_letter_weights("text"), LETTERS)) + " FROM documents)"


def topic_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Video topics per annotator ``(newspaper, file_id, annotator, topic)``.

    An annotator reads all documents of the video, makes more of some letters than others
    (``lexicon.TOPIC_READERS``) and names the category of the letter that weighs most; where
    the weights' sum is a multiple of eight, the category's first instance in upper case.
    """
    files = annotation_files(spark, sf_dir).withColumn("vnum", F.regexp_extract("file_id", r"^d(\d+)$", 1).cast("bigint"))
    cols = [F.col(n) for n in LETTERS]
    cat = F.lit(None)
    for a in ANNOTATORS:
        seen = [w * m for w, m in lexicon.readings(cols, a)]
        cat = F.when(F.col("annotator") == a, lexicon.top_category(seen, CATEGORIES)).otherwise(cat)
    first_instance = F.create_map(*[F.lit(x) for c, insts in TAXONOMY.items() for x in (c, insts[0])])
    named = files.join(video_letters(spark, sf_dir), "vnum", "left") \
        .select("newspaper", "file_id", "annotator", cat.alias("_cat"), sum(cols[1:], cols[0]).alias("_total"))
    topic = F.when(F.pmod("_total", F.lit(8)) == 0, F.upper(F.element_at(first_instance, F.col("_cat")))).otherwise(F.col("_cat"))
    return named.select("newspaper", "file_id", "annotator", topic.alias("topic"))


SQL_VIDEO_LETTERS = SQL_DOC_LETTERS + ", video_letters AS (SELECT vnum, " + ", ".join(f"sum({n}) AS {n}" for n in LETTERS) \
    + " FROM doc_letters GROUP BY vnum)"


def sql_category_by(reader: str) -> str:
    return lexicon.sql_top_category([f"{m} * {w}" for w, m in lexicon.readings(LETTERS, reader)], CATEGORIES)


def sql_topic_annotations() -> str:
    first = " ".join(f"WHEN '{c.replace(chr(39), chr(39)*2)}' THEN '{insts[0].replace(chr(39), chr(39)*2)}'"
                     for c, insts in TAXONOMY.items())
    cat = " ".join(f"WHEN '{a}' THEN {sql_category_by(a)}" for a in ANNOTATORS)
    return SQL_ANNOTATION_FILES + f""",
{SQL_VIDEO_LETTERS},
topic_cat AS (
  SELECT f.newspaper, f.file_id, f.annotator, CASE f.annotator {cat} END AS cat, ({" + ".join(LETTERS)}) % 8 AS rest
  FROM annotation_files f LEFT JOIN video_letters v ON v.vnum = CAST(substr(f.file_id, 2) AS BIGINT)),
topic_annotations AS (
  SELECT newspaper, file_id, annotator, CASE WHEN rest = 0 THEN upper(CASE cat {first} END) ELSE cat END AS topic
  FROM topic_cat)"""


# ---------------------------------------------------------------- answers of the fitted models

def hashed_labelled_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, lang, toxic, fold, buckets)`` of every labelled document, stored: the texts are read once."""
    return cut_lineage(spread(labelled_docs(spark, sf_dir).select("doc_id", "lang", "toxic", "text")).select(
        "doc_id", "lang", "toxic", textmodel.fold_of(F.col("doc_id")).alias("fold"),
        textmodel.word_buckets(F.col("text")).alias("buckets")))


def with_answers(hashed: DataFrame) -> DataFrame:
    """Adds ``answers``, one for each model of the catalogue, by weights fitted on the other folds; ``fold``, ``buckets`` go."""
    models = textmodel.fit(hashed, "toxic")
    scores = hashed.withColumn("_s", F.array(*[textmodel.score(models, m[0], F.col("fold"), F.col("buckets")) for m in MODELS]))
    return scores.withColumn("answers", F.transform("_s", lambda s: textmodel.answer(s, F.size("buckets") > 0))) \
        .drop("_s", "fold", "buckets")


def model_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, lang, toxic, model_key, ordinal, answer)``: a row for each labelled document and model."""
    return by_model(with_answers(hashed_labelled_docs(spark, sf_dir)))


def by_model(answered: DataFrame) -> DataFrame:
    kept = [c for c in answered.columns if c != "answers"]
    return answered.select(*kept, F.posexplode("answers").alias("ordinal", "answer")).withColumn(
        "model_key", F.element_at(F.array(*[F.lit(m[0]) for m in MODELS]), F.col("ordinal") + 1))


#: CTEs up to ``answers(doc_id, lang, toxic, model_key, ordinal, answer)``
SQL_ANSWERS = f"""tm_docs AS (SELECT doc_id, lang, toxic, text FROM labels JOIN documents USING (doc_id)),
{textmodel.sql_fit('tm_docs', 'doc_id', 'toxic').strip()},
tm_scores AS ({textmodel.sql_scores('tm_words', '(SELECT doc_id, fold AS held FROM tm_rows)', 'doc_id')}),
answers AS (SELECT doc_id, lang, toxic, model_key, list_position({_sql_list([m[0] for m in MODELS])}, model_key) - 1 AS ordinal,
                   {textmodel.sql_answer('value', 'has_words')} AS answer
            FROM tm_scores JOIN (SELECT doc_id, lang, toxic FROM tm_docs) USING (doc_id))"""


def sql_parse_label(expr: str) -> str:
    """DuckDB rendering of the label parser (RE2 has no Unicode ``\\b``)."""
    t = f"lower(trim({expr}, ' \t\n\r'))"
    last = r"(?s).*(?:^|[^\p{L}\p{N}_])(sì|no)(?:$|[^\p{L}\p{N}_])"
    return (f"(CASE WHEN {expr} IS NULL OR {t} = '' THEN NULL "
            f"WHEN regexp_matches({t}, '{last}') THEN "
            f"(CASE regexp_extract({t}, '{last}', 1) WHEN 'sì' THEN 1 ELSE 0 END) "
            f"WHEN regexp_matches({t}, '^si[.!]?$') THEN 1 END)::INTEGER")
