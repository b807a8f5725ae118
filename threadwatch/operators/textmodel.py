"""Text classifiers fitted on labelled texts: naive Bayes over hashed words.

A text is read once and becomes the buckets of its distinct words.  Word counts by class are
grouped sums over all labelled texts (at most ``BUCKETS`` rows a fold); a model keeps the
buckets that lean most towards the positive class, with whole-number log-odds as weights.
Texts are dealt to folds by the draw of their key, and a text is scored by the weights fitted
on the other folds.  Models differ in the number of buckets, so in how many words share one.
"""

from __future__ import annotations

import hashlib
import re
import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadwatch.functions.scoring import sql_uniform, uniform

BUCKETS = 1 << 16
#: buckets of each model; powers of two
SIZES = {"mistral": 1 << 12, "gemma2": 1 << 14, "gemma3": 1 << 16}
#: buckets that a model keeps
KEPT = 12
FOLDS = 2
#: weights are whole numbers of 1/64
UNIT = 64

_WORD = re.compile("[a-z]+")
_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def word_buckets(text: Column) -> Column:
    """Buckets of the distinct words (runs of A-Z, case folded) of a text; empty for a null text."""
    low = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    words = F.array_distinct(F.regexp_extract_all(low, F.lit("([a-z]+)"), F.lit(1)))
    return F.transform(words, lambda w: F.pmod(F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long"), F.lit(BUCKETS)).cast("int"))


def fold_of(key: Column) -> Column:
    return F.floor(uniform(key, "fold") * FOLDS).cast("int")


@dataclass(frozen=True)
class Weights:
    """One model as fitted without one fold: exported, ready for any engine."""
    model_key: str
    fold: int
    size: int
    bias: int
    weights: dict[int, int]

    def score(self, buckets) -> int:
        return self.bias + sum(self.weights.get(b % self.size, 0) for b in buckets)

    def score_text(self, text: str) -> int | None:
        """None for a text without words."""
        words = set(_WORD.findall(text.translate(_LOWER)))
        return self.score(int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % BUCKETS for w in words) if words else None


def fit(rows: DataFrame, label: str, *, sizes: dict[str, int] = SIZES, kept: int = KEPT) -> list[Weights]:
    """Models fitted on ``rows(fold, buckets, <label> 0/1)``, for each model and fold on the rows of the other folds.

    Rows with a null label take no part.  Two grouped sums over all rows; the driver gets
    ``kept`` weights a model and fold.  Without positive rows a model keeps buckets of weight
    below 0 or none at all.
    """
    y = F.col(label).cast("long")
    rows = rows.filter(y.isNotNull())
    seen = rows.select("fold", y.alias("_y"), F.explode("buckets").alias("_b")).groupBy("fold", "_b") \
        .agg(F.sum("_y").alias("_n1"), F.sum(1 - F.col("_y")).alias("_n0"))
    folds = rows.sparkSession.range(FOLDS).select(F.col("id").cast("int").alias("held"))
    seen = seen.join(F.broadcast(folds), F.col("fold") != F.col("held"))  # FOLDS rows
    docs = rows.groupBy("fold").agg(F.sum(y).alias("_d1"), F.sum(1 - y).alias("_d0")) \
        .join(F.broadcast(folds), F.col("fold") != F.col("held")).groupBy("held").agg(F.sum("_d1").alias("d1"), F.sum("_d0").alias("d0"))
    total = Window.partitionBy("held")
    parts = []
    for key, size in sizes.items():
        n = seen.groupBy("held", F.pmod("_b", F.lit(size)).alias("place")).agg(F.sum("_n1").alias("n1"), F.sum("_n0").alias("n0")) \
            .withColumn("t1", F.sum("n1").over(total)).withColumn("t0", F.sum("n0").over(total))
        lean = F.row_number().over(total.orderBy((F.col("n1") * F.col("t0") - F.col("n0") * F.col("t1")).desc(), "place"))
        odds = ((2 * F.col("n1") + 1) * (2 * F.col("t0") + size)).cast("double") / ((2 * F.col("n0") + 1) * (2 * F.col("t1") + size)).cast("double")
        parts.append(n.withColumn("_r", lean).filter(F.col("_r") <= kept).select(
            F.lit(key).alias("model_key"), "held", "place", F.round(UNIT * F.log(odds)).cast("int").alias("w")))
    table = parts[0]
    for p in parts[1:]:
        table = table.union(p)
    prior = F.round(UNIT * F.log((2 * F.col("d1") + 1).cast("double") / (2 * F.col("d0") + 1).cast("double"))).cast("int")
    bias = {r.held: r.bias for r in docs.select("held", prior.alias("bias")).collect()}
    weights: dict[tuple[str, int], dict[int, int]] = {}
    for r in table.collect():  # kept rows a model and fold
        weights.setdefault((r.model_key, r.held), {})[r.place] = r.w
    return [Weights(k, f, size, bias.get(f, 0), weights.get((k, f), {})) for k, size in sizes.items() for f in range(FOLDS)]


def _total(model: Weights, buckets: Column) -> Column:
    if not model.weights:
        return F.lit(model.bias)
    table = F.create_map(*[F.lit(x) for item in model.weights.items() for x in item])
    size = F.lit(model.size)
    return F.aggregate(buckets, F.lit(model.bias),
                       lambda s, b: s + F.coalesce(F.try_element_at(table, F.pmod(b, size)), F.lit(0)))


def score(models: list[Weights], model_key: str, fold: Column, buckets: Column) -> Column:
    """The score of ``model_key`` over an array of buckets, by the weights fitted without ``fold``."""
    out = F.lit(None).cast("int")
    for m in models:
        if m.model_key != model_key:
            continue
        out = F.when(fold == m.fold, _total(m, buckets)).otherwise(out)
    return out


def answer(value: Column, has_words: Column) -> Column:
    """What a model says about a comment of that score."""
    return (F.when(~has_words, F.lit("non saprei")).when(value >= UNIT, F.lit("Sì, è offensivo")).when(value >= 0, F.lit("SÌ!"))
            .when(value >= -UNIT, F.lit("sì? no")).otherwise(F.lit("Direi di no")))


def say(value: int | None) -> str:
    if value is None:
        return "non saprei"
    return "Sì, è offensivo" if value >= UNIT else "SÌ!" if value >= 0 else "sì? no" if value >= -UNIT else "Direi di no"


# ---------------------------------------------------------------- the same in SQL

def sql_words(src: str, key: str, text: str = "text") -> str:
    """(key, b): a row for each distinct word of a text."""
    return (f"SELECT {key}, ('0x' || substr(md5(w), 1, 8))::BIGINT % {BUCKETS} AS b FROM (SELECT DISTINCT {key}, "
            f"unnest(regexp_extract_all(translate(coalesce({text}, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), "
            f"'[a-z]+')) AS w FROM {src})")


def sql_fold(key: str) -> str:
    return f"CAST(floor({sql_uniform(key, 'fold')} * {FOLDS}) AS INTEGER)"


def sql_fit(src: str, key: str, label: str) -> str:
    """CTEs ``tm_words``, ``tm_weights(model_key, held, size, place, w)`` and ``tm_bias(held, bias)`` over ``src(key, label, text)``."""
    sizes = ", ".join(f"('{k}', {n})" for k, n in SIZES.items())
    return f"""
tm_rows AS (SELECT {key}, {label} AS y, {sql_fold(key)} AS fold FROM {src}),
tm_words AS ({sql_words(src, key)}),
tm_held AS (SELECT unnest(range({FOLDS}))::INTEGER AS held),
tm_sizes AS (SELECT * FROM (VALUES {sizes}) AS s(model_key, size)),
tm_n AS (SELECT model_key, size, held, b % size AS place, sum(y) AS n1, sum(1 - y) AS n0
         FROM tm_words JOIN tm_rows USING ({key}) JOIN tm_held ON fold <> held CROSS JOIN tm_sizes
         WHERE y IS NOT NULL GROUP BY ALL),
tm_t AS (SELECT *, sum(n1) OVER (PARTITION BY model_key, held) AS t1, sum(n0) OVER (PARTITION BY model_key, held) AS t0 FROM tm_n),
tm_weights AS (
  SELECT model_key, held, size, place,
         CAST(round({UNIT} * ln(CAST((2 * n1 + 1) * (2 * t0 + size) AS DOUBLE) / CAST((2 * n0 + 1) * (2 * t1 + size) AS DOUBLE))) AS INTEGER) AS w
  FROM tm_t QUALIFY row_number() OVER (PARTITION BY model_key, held ORDER BY n1 * t0 - n0 * t1 DESC, place) <= {KEPT}),
tm_bias AS (SELECT held, CAST(round({UNIT} * ln(CAST(2 * sum(y) + 1 AS DOUBLE) / CAST(2 * sum(1 - y) + 1 AS DOUBLE))) AS INTEGER) AS bias
            FROM tm_rows JOIN tm_held ON fold <> held WHERE y IS NOT NULL GROUP BY held)"""


def sql_answer(value: str, has_words: str) -> str:
    return (f"CASE WHEN NOT {has_words} THEN 'non saprei' WHEN {value} >= {UNIT} THEN 'Sì, è offensivo' WHEN {value} >= 0 THEN 'SÌ!' "
            f"WHEN {value} >= {-UNIT} THEN 'sì? no' ELSE 'Direi di no' END")


def sql_scores(words: str, rows: str, key: str, models: str = "tm_sizes") -> str:
    """(key, model_key, value, has_words) for ``rows(key, held)`` and their ``words(key, b)``."""
    return f"""
SELECT r.{key}, s.model_key, any_value(coalesce(tm_bias.bias, 0)) + coalesce(sum(t.w), 0) AS value, count(x.b) > 0 AS has_words
FROM {rows} r CROSS JOIN {models} s LEFT JOIN tm_bias ON tm_bias.held = r.held LEFT JOIN {words} x ON x.{key} = r.{key}
LEFT JOIN tm_weights t ON t.model_key = s.model_key AND t.held = r.held AND t.place = x.b % s.size
GROUP BY r.{key}, s.model_key"""
