"""URL filters: pattern rules indexed by their rarest literal token.

A rule's pattern is literal text with ``*`` for anything; its literal tokens are the runs
of letters and digits that any fitting URL must hold as whole tokens.  How many URLs hold
each of them is counted over all URLs, and the rule is filed under the rarest.  A URL's
tokens fetch its candidate rules, and only those run their regular expression.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (verdict, host, path): a rule for the host, its subdomains and the paths that start so
HOST_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"),
              ("allow", "org", "/fr/")]

#: patterns that block a URL, over the whole lower-cased URL
BLOCK_PATTERNS = [
    "*://spam-farm.*", "*.spam-farm.*", "*://cheap-pills.*", "*.cheap-pills.*", "*-pills.*", "*://casino.*", "*.casino.*",
    "*://free-money.*", "*.free-money.*", "*://malware.*", "*.malware.*", "*://phishing.*", "*.phishing.*", "*/porn/*",
    "*/xxx/*", "*/viagra/*", "*/casino/*", "*/adserver/*", "*/doubleclick/*", "*?*affid=*", "*&affid=*",
]
#: rules beyond this many need another place for the index than the query plan
MAX_RULES = 5_000


@dataclass(frozen=True)
class PatternRule:
    pattern: str
    regex: str
    tokens: tuple[str, ...]


def pattern_rule(pattern: str) -> PatternRule:
    """The rule's regular expression and the tokens that every fitting URL holds whole."""
    pattern = pattern.lower()
    regex = "(?s)^" + "".join(".*" if c == "*" else re.sub(r"([^a-z0-9])", r"\\\1", c) for c in pattern) + "$"
    tokens = []
    for m in re.finditer(r"[a-z0-9]+", pattern):
        before, after = pattern[:m.start()][-1:], pattern[m.end():][:1]
        if before != "*" and after != "*":
            tokens.append(m.group())
    return PatternRule(pattern, regex, tuple(dict.fromkeys(tokens)))


def lower_az(column: Column | str) -> Column:
    return F.translate(column, UPPER, LOWER)


def url_host(url: str) -> Column:
    return lower_az(F.coalesce(F.regexp_extract(F.col(url), r"(?s)^.*?://([^/?#]*)([^?#]*)", 1), F.lit("")))


def url_path(url: str) -> Column:
    return F.coalesce(F.regexp_extract(F.col(url), r"(?s)^.*?://([^/?#]*)([^?#]*)", 2), F.lit(""))


def url_tokens(url: str) -> Column:
    return F.array_distinct(F.split(lower_az(F.coalesce(F.col(url), F.lit(""))), "[^a-z0-9]+"))


def rarest_tokens(urls: DataFrame, rules: list[PatternRule], url_col: str) -> dict[str, list[PatternRule]]:
    """Rules by the one of their tokens that the fewest URLs hold; rules without tokens under ''.

    One aggregate over all URLs; only counts of tokens that rules hold reach the driver.
    """
    wanted = sorted({t for r in rules for t in r.tokens})
    counts: dict[str, int] = {}
    if wanted:
        held = F.array_intersect(url_tokens(url_col), F.array(*[F.lit(t) for t in wanted]))
        counts = {r["t"]: r["n"] for r in urls.select(F.explode(held).alias("t")).groupBy("t")
                  .agg(F.count("*").alias("n")).collect()}
    index: dict[str, list[PatternRule]] = {}
    for r in rules:
        index.setdefault(min(r.tokens, key=lambda t: (counts.get(t, 0), t), default=""), []).append(r)
    return index


def judge_urls(urls: DataFrame, *, url_col: str = "url", patterns: list[str] = BLOCK_PATTERNS,
               host_rules: list[tuple[str, str, str]] = HOST_RULES, carry: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """The ``carry`` columns, host, path, rule, pattern and verdict, one row per input row.

    The longest fitting host rule decides; where none fits, a URL that a pattern fits is
    blocked (``pattern``: the first of them in order) and any other is allowed.  A null
    URL, or one without ``://``, has an empty host and path; patterns are held against
    whatever is there.  Ids, null or repeated, play no part.  Rules are a parameter of at
    most ``MAX_RULES``; no shuffle but that of the token counts.
    """
    if len(patterns) + len(host_rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    index = rarest_tokens(urls, [pattern_rule(p) for p in patterns], url_col)
    row = urls.select(F.struct(F.lit(0).alias("_"), *carry).alias("_row"), F.col(url_col).cast("string").alias("_url")) \
        .withColumn("host", url_host("_url")).withColumn("path", url_path("_url")) \
        .withColumn("_tokens", url_tokens("_url"))
    whole = lower_az(F.coalesce("_url", F.lit("")))
    keyed = {t: rs for t, rs in index.items() if t}

    def listed(rules):
        return F.array(*[F.struct(F.lit(r.pattern).alias("pattern"), F.lit(r.regex).alias("regex")) for r in rules]) \
            .cast("array<struct<pattern:string,regex:string>>")

    candidates = listed(index.get("", []))  # rules without a whole token are candidates of every URL
    if keyed:
        files = F.create_map(*[x for t, rs in keyed.items() for x in (F.lit(t), listed(rs))])
        held = F.array_intersect("_tokens", F.array(*[F.lit(t) for t in keyed]))
        candidates = F.concat(candidates, F.flatten(F.transform(held, lambda t: files[t])))
    fitting = F.filter(candidates, lambda r: F.regexp_like(whole, r["regex"]))
    fits = F.transform(fitting, lambda r: r["pattern"])
    row = row.withColumn("pattern", F.array_min(fits))
    rule, verdict = F.lit(None).cast("string"), F.when(F.col("pattern").isNotNull(), "block").otherwise("allow")
    for action, host, path in sorted(host_rules, key=lambda r: len(r[1] + r[2])):  # the longest comes last and wins
        fit = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule = F.when(fit, F.lit(host + path)).otherwise(rule)
        verdict = F.when(fit, F.lit(action)).otherwise(verdict)
    return row.withColumn("rule", rule).withColumn("verdict", verdict) \
        .select(*[F.col("_row")[c].alias(c) for c in carry], "host", "path", "rule", "pattern", "verdict")


def op10_url_filters(spark, sf_dir: str) -> DataFrame:
    """Every url of ``pages``."""
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "host", "path", "rule", "verdict")


_FITS = " OR ".join("regexp_matches(low, '" + pattern_rule(p).regex.replace("(?s)", "") + "', 's')" for p in BLOCK_PATTERNS)
_RULES = sorted(HOST_RULES, key=lambda r: -len(r[1] + r[2]))
_CASE = "\n".join(f"    WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}'"
                  for _, h, p in _RULES)
_VERDICT = "\n".join(f"    WHEN '{h}{p}' THEN '{a}'" for a, h, p in _RULES)
OP10_SQL = rf"""
WITH u AS (
  SELECT page_id, translate(coalesce(url, ''), '{UPPER}', '{LOWER}') AS low,
    translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 1, 's'), '{UPPER}', '{LOWER}') AS host,
    regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 2, 's') AS path
  FROM pages
), r AS (
  SELECT *, CASE
{_CASE}
    END AS rule FROM u
)
SELECT page_id, host, path, rule, CASE rule
{_VERDICT}
    ELSE CASE WHEN {_FITS} THEN 'block' ELSE 'allow' END END AS verdict
FROM r
"""
