"""Stand-ins for annotators and prompted models: rules that read the text, as column expressions.

A rule stands where a model would: it sees the item's text and nothing else and answers
in free text, which the label and topic parsers then read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadwatch.operators.textmodel import say

# Terms that annotators look for.
OFFENSIVE_TERMS = ["clown", "disgusting", "idiot", "loser", "moron", "pathetic", "scum", "stupid", "trash", "worthless"]
#: half of this: texts shorter than that get no label
SHORT_TEXT = 60
#: whole words that tell a language, in lower case
LANGUAGE_TERMS = {
    "de": ["der", "die", "und", "zu", "von"], "en": ["the", "of", "and", "to", "that"],
    "es": ["el", "los", "y", "las", "con"], "fr": ["le", "et", "les", "des", "pour"],
}


def occurrences(text: Column, term: str) -> Column:
    """How often ``term`` stands in ``text``, overlaps not counted."""
    gone = F.length(F.replace(text, F.lit(term), F.lit("")))
    return ((F.length(text) - gone) / F.lit(len(term))).cast("int")


def weighted(text: Column, weights: dict[str, int]) -> Column:
    total = F.lit(0)
    for term, w in weights.items():
        total = total + occurrences(text, term) * w
    return total


def with_language(items: DataFrame, text: str, out: str) -> DataFrame:
    """Adds the language whose words are most frequent (ties: first in order), null if none occurs; ``text`` goes."""
    kept = [c for c in items.columns if c != text]
    padded = items.select(*kept, F.concat(F.lit(" "), F.lower(F.col(text)), F.lit(" ")).alias("_padded"))
    scored = padded.select(*kept, F.array(*[weighted(F.col("_padded"), {f" {t} ": 1 for t in terms})
                                            for terms in LANGUAGE_TERMS.values()]).alias("_scores"))
    best = F.array_max("_scores")
    place = F.array_position("_scores", best).cast("int")
    return scored.select(*kept, F.when(best > 0, F.element_at(F.array(*[F.lit(k) for k in LANGUAGE_TERMS]), place)).alias(out))


def sql_language(text: str) -> str:
    padded = f"(' ' || lower({text}) || ' ')"
    scores = [" + ".join(f"(length({padded}) - length(replace({padded}, ' {t} ', ''))) // {len(t) + 2}" for t in terms)
              for terms in LANGUAGE_TERMS.values()]
    best = f"greatest({', '.join(scores)})"
    names = ", ".join(f"'{k}'" for k in LANGUAGE_TERMS)
    return f"(CASE WHEN {best} > 0 THEN [{names}][list_position([{', '.join(scores)}], {best})] END)"


# Letters and weights that stand for the taxonomy's categories, in taxonomy order.
TOPIC_LETTERS = {"e": 8, "t": 10, "a": 13, "o": 14, "n": 11, "i": 13, "h": 14, "s": 16, "r": 13, "d": 22, "l": 22, "u": 24,
                 "c": 26, "m": 40, "g": 34, "b": 40, "p": 60}
#: what an annotator looks for in a comment: terms, least occurrences
ANNOTATOR_RULES = {"A1": (OFFENSIVE_TERMS, 1), "A2": (OFFENSIVE_TERMS[:6], 1), "A3": (OFFENSIVE_TERMS, 2),
                   "A4": (OFFENSIVE_TERMS[4:], 1), "A5": (OFFENSIVE_TERMS[1:], 1)}


def letter_weights(text: Column) -> list[Column]:
    """Weighted occurrences of every topic letter in a lower-case text, 0 for a null text."""
    return [F.coalesce(occurrences(text, ch) * w, F.lit(0)) for ch, w in TOPIC_LETTERS.items()]


_COUNTED_BYTES = 1 << 20


def letter_counts(texts: pa.Array) -> np.ndarray:
    """Weighted occurrences of every topic letter (all ASCII) in lower-case texts, one row a text: each is read once."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, ends, data = texts.buffers()
    at = np.frombuffer(ends, np.int64)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    codes = np.array([ord(ch) for ch in TOPIC_LETTERS])
    out = np.zeros((len(texts), len(codes)), np.int64)
    for i, (start, end) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
        for part in range(start, end, _COUNTED_BYTES):
            out[i] += np.bincount(data[part:min(part + _COUNTED_BYTES, end)], minlength=256)[codes]
    return out * np.array(list(TOPIC_LETTERS.values()), np.int64)


def with_letter_weights(items: DataFrame, low: str, names: list[str]) -> DataFrame:
    """``letter_weights`` of the lower-case text ``low`` as long columns ``names``; the text goes."""
    from threadwatch.session import ship_package
    ship_package(items.sparkSession)
    kept = [c for c in items.columns if c != low]
    schema = items.select(*kept).schema
    for n in names:
        schema = schema.add(n, "long")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = letter_counts(batch.column(low))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(counts[:, i]) for i in range(len(names))],
                                             names=[*kept, *names])

    return items.mapInArrow(count, schema)


def sql_letter_weights(text: str) -> list[str]:
    low = f"lower(coalesce({text}, ''))"
    return [f"{w} * (length({low}) - length(replace({low}, '{ch}', '')))" for ch, w in TOPIC_LETTERS.items()]


def top_category(weights: list[Column], categories: list[str]) -> Column:
    """The category of the greatest weight (ties: first in order), null if all are 0 or null."""
    best = F.greatest(*weights)
    place = F.array_position(F.array(*weights), best).cast("int")
    return F.when(best > 0, F.element_at(F.array(*[F.lit(c) for c in categories]), place))


def sql_top_category(weights: list[str], categories: list[str]) -> str:
    best = f"greatest({', '.join(weights)})"
    names = ", ".join("'" + c.replace("'", "''") + "'" for c in categories)
    return f"(CASE WHEN {best} > 0 THEN [{names}][list_position([{', '.join(weights)}], {best})] END)"


_ANY_TERM = "(" + "|".join(OFFENSIVE_TERMS) + ")"


def terms_in(text: Column) -> Column:
    """The offensive terms of a text, one after the other: one pass, whoever asks for which terms later."""
    return F.regexp_extract_all(F.lower(text), F.lit(_ANY_TERM), F.lit(1))


def _how_many(found: Column, terms: list[str]) -> Column:
    return F.size(F.filter(found, lambda t: t.isin(terms)))


def annotator_label(found: Column, length: Column, annotator: Column) -> Column:
    """1 / 0 by the annotator's own rule over the terms found in a text; null for a null or very short text."""
    out = F.lit(None)
    for name, (terms, least) in ANNOTATOR_RULES.items():
        own = _how_many(found, terms)
        out = F.when(annotator == name, F.when(own >= least, 1).otherwise(0)).otherwise(out)
    return F.when(length >= SHORT_TEXT // 2, out).cast("int")


def sql_annotator_label(text: str, annotator: str) -> str:
    cases = []
    for name, (terms, least) in ANNOTATOR_RULES.items():
        own = "[" + ", ".join(f"'{t}'" for t in terms) + "]"
        cases.append(f"WHEN '{name}' THEN CASE WHEN len(list_filter(regexp_extract_all(lower({text}), '{_ANY_TERM}', 1), "
                     f"lambda t : list_contains({own}, t))) >= {least} THEN 1 ELSE 0 END")
    return f"CAST(CASE WHEN length({text}) >= {SHORT_TEXT // 2} THEN CASE {annotator} {' '.join(cases)} END END AS INTEGER)"


#: how much a reader (a model, an annotator) makes of a letter's weight, in eighths: 8, and 9 for some letters
TOPIC_READERS = {"mistral": (0, 99), "gemma2": (1, 4), "gemma3": (0, 3),
                 "A1": (0, 5), "A2": (1, 5), "A3": (2, 5), "A4": (3, 5), "A5": (4, 5)}


def readings(weights: list, reader: str) -> list:
    """A video's letter weights as a reader sees them: every ``step``-th letter from ``first`` on counts for more."""
    first, step = TOPIC_READERS[reader]
    return [(w, 9 if i % step == first else 8) for i, w in enumerate(weights)]


class PromptSection:
    """Predictor that answers a batch of prompts by a rule over the part between two markers."""

    def __init__(self, start: str, end: str):
        self.start, self.end = start, end

    def section(self, prompt: str) -> str:
        at = prompt.rfind(self.start)
        if at < 0:
            return ""
        at += len(self.start)
        to = prompt.rfind(self.end) if self.end else len(prompt)
        return prompt[at:to if to >= at else len(prompt)]

    def answer(self, text: str) -> str:
        raise NotImplementedError

    def __call__(self, prompts: list[str]) -> list[str]:
        return [self.answer(self.section(p)) for p in prompts]


class FittedRule(PromptSection):
    """A fitted model (``textmodel.Weights``) that answers about the target comment of a prompt."""

    def __init__(self, weights, start: str, end: str):
        super().__init__(start, end)
        self.weights = weights

    def answer(self, text: str) -> str:
        return say(self.weights.score_text(text))


class TopicRule(PromptSection):
    """Names the category of the letter that weighs most in the described article."""

    def __init__(self, categories: list[str], start: str, end: str):
        super().__init__(start, end)
        self.categories = categories

    def answer(self, text: str) -> str:
        low = text.lower()
        weights = [low.count(ch) * w for ch, w in TOPIC_LETTERS.items()]
        return f"Categoria: {self.categories[weights.index(max(weights))].upper()}" if max(weights) else "non saprei"


#: per model: of sixteen remainders, how many mean a yes
RISK_SHARES = {"mistral": 4, "gemma2": 7, "gemma3": 2}


class RiskRule:
    """Answers ``<model key>\\n<prompt>`` by the prompt's weighted letters: each model has its own share of yeses."""

    def __call__(self, prompts: list[str]) -> list[str]:
        out, rests = [], {}  # the models are asked the same prompts
        for asked in prompts:
            model_key, _, prompt = asked.partition("\n")
            rest = rests.get(prompt)
            if rest is None:
                low = prompt.lower()
                rest = rests[prompt] = sum(low.count(ch) * w for ch, w in TOPIC_LETTERS.items()) % 16
            out.append("forse" if rest == 15 else "Sì" if rest < RISK_SHARES[model_key] else "No")
        return out
