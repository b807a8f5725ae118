"""Text expressions: handles, mentions, masking, cleaning, truncation, labels.

Everything is a JVM expression except NFKC normalisation, for which Spark has
no built-in; that one step is an Arrow UDF.
"""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from threadwatch.functions.fixed import HANDLE_TRAILING_CHARS, ZERO_WIDTH_CHARS

# Java regexes; (?U) makes \s, \b and \w Unicode-aware like Python's str regexes.
_LEADING_MENTION = r"(?U)^\s*@([^\s,.:;!?]+)"
_UNKNOWN_MENTION = r"(?U)@(?!author_\d+\b)[^\s]+"
_TRIM = r"(?U)^\s+|\s+$"


def unicode_strip(c: Column) -> Column:
    """Strip Unicode whitespace at both ends (``trim`` only removes spaces)."""
    return F.regexp_replace(c, _TRIM, "")


def norm_handle(c: Column) -> Column:
    """Drop leading ``@``s and trailing ``,.:;!?``, lower-case."""
    s = F.regexp_replace(c.cast("string"), r"^@+", "")
    s = F.regexp_replace(s, "[" + _re_class(HANDLE_TRAILING_CHARS) + "]+$", "")
    return F.lower(s)


def _re_class(chars: str) -> str:
    return "".join("\\" + ch for ch in chars)


def leading_mention(text: Column) -> Column:
    """Normalised handle of a mention at the very start of the text, else null.

    U+00A0 becomes a space and U+200B is removed before matching; the token
    stops at whitespace or any of ``,.:;!?``.
    """
    t = F.translate(F.translate(text, " ", " "), "​", "")
    t = unicode_strip(t)
    tok = F.regexp_extract(t, _LEADING_MENTION, 1)
    return F.when(tok != "", norm_handle(tok))


def mask_unknown_mentions(text: Column) -> Column:
    """``@name`` that is not a pseudonym becomes ``@user``."""
    return F.regexp_replace(text, _UNKNOWN_MENTION, "@user")


#: texts that are Python strings at a time
_NFKC_ROWS = 64


@F.arrow_udf(StringType())
def _nfkc(s: pa.Array) -> pa.Array:
    done = [pa.array([None if t is None else unicodedata.normalize("NFKC", t) for t in s.slice(i, _NFKC_ROWS).to_pylist()],
                     pa.string()) for i in range(0, len(s), _NFKC_ROWS)]
    return pa.concat_arrays(done) if done else pa.array([], pa.string())


def nfkc(text: Column) -> Column:
    """Unicode NFKC; null stays null.  ASCII texts are in that form as they are and do not go to Python."""
    return F.coalesce(_nfkc(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


def clean_text(text: Column) -> Column:
    """NFKC, delete zero-width chars, collapse Unicode whitespace, strip."""
    from threadwatch.session import ship_package
    ship_package()
    t = nfkc(text)
    t = F.regexp_replace(t, "[" + ZERO_WIDTH_CHARS + "]", "")
    t = F.regexp_replace(t, r"(?U)\s+", " ")
    return unicode_strip(t)


def truncate_description(d: Column, max_chars: int) -> Column:
    """Over ``max_chars``: cut after the last '.' in the first ``max_chars``, else hard cut."""
    head = F.substring(d, 1, max_chars)
    upto_dot = F.regexp_extract(head, r"(?s)^.*\.", 0)
    return F.when(F.length(d) > max_chars,
                  F.when(upto_dot != "", upto_dot).otherwise(head)).otherwise(d)


def parse_label(raw: Column) -> Column:
    """Free-text answer -> 1 / 0 / null.

    Lower-cased and stripped; the last whole-word ``sì`` or ``no`` decides
    (the two words never overlap, so the last match is the later start);
    otherwise the whole text ``si``, ``si.`` or ``si!`` is 1; else null.
    """
    t = F.lower(unicode_strip(raw))
    hits = F.regexp_extract_all(t, F.lit(r"(?U)\b(sì|no)\b"), F.lit(1))
    last = F.try_element_at(hits, F.lit(-1))
    return (F.when(raw.isNull() | (t == ""), F.lit(None))
            .when(last == "sì", F.lit(1))
            .when(last == "no", F.lit(0))
            .when(t.rlike(r"^si[.!]?$"), F.lit(1))
            .cast("int"))


def coalesce_na(c: Column, blank_too: bool = False) -> Column:
    """Null (and optionally the empty string) -> ``N/A``."""
    v = F.nullif(c, F.lit("")) if blank_too else c
    return F.coalesce(v, F.lit("N/A"))
