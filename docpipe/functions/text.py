"""Text of recognised documents: folding, joining of broken numbers, noise lines, tokens."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters and their plain forms.
ACCENTED, PLAIN = "éÉáÁíÍóÓöÖőŐúÚüÜűŰ", "eEaAiIoOoOoOuUuUuU"
#: White space of all kinds, as (?U)\s has it.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
SPACES = r"[\s   ]+"
# Lower-cased lines with one of these are noise, unless they hold one of the others.
NOISE = r"terms and conditions|privacy policy|general terms|disclaimer|footer|page \d+ of \d+|copyright|all rights reserved|www\.|https?://"
KEPT_LOWER = r"invoice|receipt|bill|számlaszám|tax|vat|áfa|nettó|bruttó|total|subtotal|összesen|mennyiség|egységár|unit"
KEPT = r"\d{4}[-./]\d{1,2}[-./]\d{1,2}|\d+[.,]\d+|[A-Z]{2,}[-\s]?\d{8,}"
#: What splits lines everywhere, not only at line feeds.
LINE_ENDS = r"\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085  ]"


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.btrim(c, F.lit(WHITE))


def fold_accents(c: Column) -> Column:
    """Accented Latin letters of the recogniser's languages to plain ones; others stay."""
    return F.translate(c, ACCENTED, PLAIN)


def join_thousands(c: Column) -> Column:
    """Digits broken by spaces before a group of three are joined, with or without a decimal mark behind."""
    with_decimals = F.regexp_replace(c, rf"(?U)(\d){SPACES}(\d{{3}}[,.])", "$1$2")
    return F.regexp_replace(with_decimals, rf"(?U)(\d){SPACES}(\d{{3}})(?=\D|$)", "$1$2")


def split_glued(c: Column) -> Column:
    """A space after two decimals that another digit follows."""
    return F.regexp_replace(c, r"(\d+[,.]\d{2})(\d)", "$1 $2")


def is_noise(line: Column) -> Column:
    return F.lower(line).rlike(NOISE)


def is_important(line: Column) -> Column:
    return line.rlike(KEPT) | F.lower(line).rlike(KEPT_LOWER)


def clean_text(c: Column) -> Column:
    """Numbers mended, lines stripped, blank lines and noise lines without important data dropped."""
    mended = split_glued(join_thousands(F.coalesce(c, F.lit(""))))
    lines = F.filter(F.transform(F.split(mended, "\n"), strip), lambda x: x != "")
    return F.array_join(F.filter(lines, lambda x: ~is_noise(x) | is_important(x)), "\n")


@F.pandas_udf(T.StringType())
def _decomposed(texts: pd.Series) -> pd.Series:
    """Texts without combining marks after compatibility decomposition, lower case; nulls stay. Whole batches are joined
    and decomposed at once: no text holds the mark between them."""
    known = texts.notna()
    if not known.any():
        return texts
    parts = unicodedata.normalize("NFKD", "\ue000".join(t.replace("\ue000", "\ue001") for t in texts[known]))
    plain = parts.translate(_marks()).lower().split("\ue000")
    out = texts.astype(object)
    out[known] = plain
    return out


@cache
def _marks() -> dict[int, None]:
    """Combining characters, for deletion."""
    return {c: None for c in range(sys.maxunicode + 1) if unicodedata.combining(chr(c))}


def folded_text(text: str) -> str:
    """What nfkd_fold makes of a text, for steps that run in Python anyway."""
    return text.lower() if text.isascii() else unicodedata.normalize("NFKD", text).translate(_marks()).lower()


def nfkd_fold(c: Column | str) -> Column:
    """Compatibility-decomposed, without combining marks, lower case; null gives empty text.

    Spark has no function for it, but letters of ASCII need none: only other texts are sent to Python.
    """
    text = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.when(~beyond_ascii(text), F.lower(F.coalesce(text, F.lit("")))), odd_fold(text))


def beyond_ascii(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike(r"[^\x00-\x7F]")


def odd_fold(c: Column) -> Column:
    """nfkd_fold of texts with other letters than ASCII's; null for those that lower() folds."""
    return _decomposed(F.when(beyond_ascii(c), c))


def name_tokens(folded: Column) -> Column:
    """Runs of letters and digits of at least three characters, repeats kept."""
    return F.filter(F.regexp_extract_all(folded, F.lit(r"([a-z0-9]+)"), F.lit(1)), lambda t: F.length(t) >= 3)


def table_lines(c: Column) -> Column:
    """Stripped lines that are not blank."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), LINE_ENDS), strip), lambda x: x != "")


def is_barcode(c: Column) -> Column:
    """Whether the digits number 8, 12, 13 or 14."""
    return F.length(F.regexp_replace(F.coalesce(c, F.lit("")), r"\D", "")).isin(8, 12, 13, 14)


def document_text(pages: Column) -> Column:
    """Texts of an array of (page_no, text) in page order, blank pages dropped, with an empty line between."""
    ordered = F.array_sort(pages)
    return F.array_join(F.transform(F.filter(ordered, lambda p: strip(F.coalesce(p["text"], F.lit(""))) != ""), lambda p: p["text"]), "\n\n")
