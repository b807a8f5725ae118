"""Queries P1-P5 on events (authors), orders x customer (names in text) and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadwatch.functions.text import clean_text, mask_unknown_mentions
from threadwatch.operators import privacy
from threadwatch.plans import adapters as ad
from threadwatch.plans.registry import query
from threadwatch.session import cut_lineage


def event_authors(spark, sf_dir):
    e = ad.table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    return e.select(F.concat(F.lit("@U"), F.col("user_id").cast("string")).alias("author"),
                    F.col("ts").alias("published_at"), "event_type", "event_id")


def author_map(spark, sf_dir):
    """A map first built from sign-up events, then continued over all events."""
    ev = event_authors(spark, sf_dir)
    first_signup = privacy.first_appearance(ev.filter(F.col("event_type") == "signup"))
    existing = cut_lineage(privacy.assign_pseudonyms(first_signup))
    return cut_lineage(privacy.assign_pseudonyms(privacy.first_appearance(ev), existing))


SQL_MAP = """
WITH ea AS (SELECT '@U' || user_id AS author, ts, event_type FROM events),
ex AS (
  SELECT author, 'author_' || (row_number() OVER (ORDER BY min(ts), author) - 1) AS author_anon
  FROM ea WHERE event_type = 'signup' GROUP BY author),
nw AS (
  SELECT author, 'author_' || (row_number() OVER (ORDER BY min(ts), author) - 1 + (SELECT count(*) FROM ex))
           AS author_anon
  FROM ea WHERE author NOT IN (SELECT author FROM ex) GROUP BY author),
amap AS (SELECT * FROM ex UNION ALL SELECT * FROM nw)"""

query("pseudonymise", SQL_MAP + "\nSELECT * FROM amap")(author_map)


@query("replace_authors", SQL_MAP + """
SELECT 'c' || e.event_id AS comment_id, coalesce(m.author_anon, '@U' || e.user_id) AS author
FROM events e LEFT JOIN amap m ON m.author = '@U' || e.user_id""")
def replace_authors(spark, sf_dir):
    ev = event_authors(spark, sf_dir).select(F.concat(F.lit("c"), F.col("event_id").cast("string"))
                                             .alias("comment_id"), "author")
    return privacy.replace_authors(ev, author_map(spark, sf_dir))


@query("replace_names", """
SELECT o.o_orderkey AS ticket, 'Ticket ' || o.o_orderkey || ' by @author_' || c.c_custkey || ' about '
       || o.o_orderpriority AS text
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey""")
def replace_names(spark, sf_dir):
    o = ad.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    c = ad.table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    t = ad.spread(o.join(c, o.o_custkey == c.c_custkey)).select(
        F.col("o_orderkey").alias("ticket"),
        F.concat(F.lit("Ticket "), F.col("o_orderkey").cast("string"), F.lit(" by "), F.col("c_name"),
                 F.lit(" about "), F.col("o_orderpriority")).alias("text"))
    names = c.select(F.col("c_name").alias("author"),
                     F.concat(F.lit("author_"), F.col("c_custkey").cast("string")).alias("author_anon"))
    return privacy.replace_names(t, "text", names)


def _led(spark, sf_dir, leads):
    """Every whole document after a lead that its id picks, so that rare characters and mentions occur."""
    d = ad.table(spark, sf_dir, "documents").select("doc_id", "text")
    lead = F.element_at(F.array(*[F.lit(x) for x in leads]), (F.pmod("doc_id", F.lit(len(leads))) + 1).cast("int"))
    return d.select("doc_id", F.concat(lead, F.lit(" "), F.coalesce("text", F.lit(""))).alias("text"))


def _sql_list(values) -> str:
    return "[" + ", ".join("'" + v + "'" for v in values) + "]"


#: lead -> what masking leaves of it (the oracle's pattern language has no look-ahead, so these are literal)
MENTION_LEADS = {"ciao @author_12 e @mario!": "ciao @author_12 e @user", "@author_3x resta": "@user resta",
                 "@author_7, @author_ @x": "@author_7, @user @user", "nessuno": "nessuno"}


@query("mask_mentions", rf"""
SELECT doc_id, {_sql_list(MENTION_LEADS.values())}[doc_id % {len(MENTION_LEADS)} + 1] || ' '
       || regexp_replace(coalesce(text, ''), '@[^\s]+', '@user', 'g') AS text FROM documents""")
def mask_mentions(spark, sf_dir):
    return _led(spark, sf_dir, list(MENTION_LEADS)).select("doc_id", mask_unknown_mentions(F.col("text")).alias("text"))


#: lead -> its cleaned form (the oracle normalises to NFC only, so these are literal)
CLEAN_LEADS = {"\uff46\uff55\uff4c\uff4c\u3000\uff57\uff49\uff44\uff54\uff48": "full width", "\ufb01ne \u2460": "fine 1",
               "a\u200bb\u200cc\u200dd\ufeffe": "abcde", "  many \n\t spaces\u00a0": "many spaces", "plain": "plain"}


@query("clean_text", rf"""
SELECT doc_id, trim({_sql_list(CLEAN_LEADS.values())}[doc_id % {len(CLEAN_LEADS)} + 1] || ' '
  || trim(regexp_replace(regexp_replace(nfc_normalize(coalesce(text, '')), '[\x{{200B}}-\x{{200D}}\x{{FEFF}}]', '', 'g'),
                         '\s+', ' ', 'g'))) AS text
FROM documents""")
def clean_text_q(spark, sf_dir):
    return _led(spark, sf_dir, list(CLEAN_LEADS)).select("doc_id", clean_text(F.col("text")).alias("text"))


@query("replace_handles", "WITH " + ad.SQL_EVENT_COMMENTS.strip() + ",\n" + SQL_MAP.strip()[len("WITH "):] + """,
t AS (SELECT comment_id, text, strpos(text, '@') AS p FROM event_comments),
c AS (SELECT t.comment_id, arg_max(m.author, length(m.author)) AS name, arg_max(m.author_anon, length(m.author)) AS anon
      FROM t JOIN amap m ON t.p > 0 AND starts_with(substr(t.text, t.p), m.author) GROUP BY 1)
SELECT t.comment_id,
       CASE WHEN c.name IS NULL THEN t.text
            ELSE substr(t.text, 1, t.p - 1) || '@' || c.anon || substr(t.text, t.p + length(c.name)) END AS text
FROM t LEFT JOIN c USING (comment_id)""")
def replace_handles(spark, sf_dir):
    """P3 on comment texts with the pseudonym map of ``@handle`` authors (join path, no broadcast)."""
    c = ad.event_comments(spark, sf_dir).select("comment_id", "text")
    return privacy.replace_handle_names(c, "text", author_map(spark, sf_dir), "comment_id")
