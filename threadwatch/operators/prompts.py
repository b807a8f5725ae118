"""Prompt rendering (P6-P10) as single ``concat`` expressions.

A template is split at its placeholders once, on the driver; each row is
then rendered by the JVM.  The prompt grid (videos x risk templates x
models) is a generator over a fixed-size array, not a join.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadwatch.functions.fixed import MODELS
from threadwatch.functions.prompt_text import COMMENT_PROMPT, RISK_PROMPTS, TOPIC_PROMPT
from threadwatch.functions.taxonomy import taxonomy_block
from threadwatch.functions.text import coalesce_na


def _parts(template: str):
    return [(lit, field) for lit, field, _, _ in string.Formatter().parse(template)]


def render(template: str, fields: dict[str, Column]) -> Column:
    """``template.format(**fields)`` as one Column (every field must be non-null)."""
    pieces = []
    for lit, field in _parts(template):
        if lit:
            pieces.append(F.lit(lit))
        if field is not None:
            pieces.append(fields[field])
    return F.concat(*pieces)


def around(template: str, field: str) -> tuple[str, str]:
    """The literal text just before and just after ``{field}`` in a template."""
    parts = _parts(template)
    at = next(i for i, (_, f) in enumerate(parts) if f == field)
    return parts[at][0], parts[at + 1][0] if at + 1 < len(parts) else ""


def sql_render(template: str, fields: dict[str, str]) -> str:
    pieces = []
    for lit, field in _parts(template):
        if lit:
            pieces.append("'" + lit.replace("'", "''") + "'")
        if field is not None:
            pieces.append(f"({fields[field]})")
    return "(" + " || ".join(pieces) + ")"


def comment_prompt(title: Column, description: Column, head: Column, previous: Column, target: Column) -> Column:
    """Nulls become ``N/A`` (the empty string is kept); the target is used as is."""
    return render(COMMENT_PROMPT, {
        "video_title": coalesce_na(title), "video_description": coalesce_na(description),
        "head_comment": coalesce_na(head), "previous_comment": coalesce_na(previous),
        "target_comment": F.coalesce(target, F.lit("nan"))})


def topic_prompt(title: Column, description: Column) -> Column:
    """P8 + P9: taxonomy block, title and description (empty or null -> ``N/A``)."""
    return render(TOPIC_PROMPT, {
        "taxonomy": F.lit(taxonomy_block()),
        "article_title": coalesce_na(title, blank_too=True),
        "article_description": coalesce_na(description, blank_too=True)})


def risk_prompt_grid(videos: DataFrame, title: str = "title", description: str = "description",
                     models: list[str] | None = None) -> DataFrame:
    """P10: every video x every risk template x every model key.

    ``title`` / ``description`` are expected ``N/A``-filled already (see S5).
    """
    keys = models or [m[0] for m in MODELS]
    t, d = F.col(title), F.col(description)
    prompts = F.array(*[F.struct(F.lit(i).alias("prompt_id"),
                                 render(tpl, {"video_title": t, "video_description": d}).alias("prompt"))
                        for i, tpl in enumerate(RISK_PROMPTS)])
    g = videos.withColumn("_p", F.explode(prompts)).select("*", "_p.*").drop("_p")
    return g.withColumn("model_key", F.explode(F.array(*[F.lit(k) for k in keys])))
