"""Text normalisation for hashing and comparison; stored text stays as it was."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters that carry no meaning, folded punctuation, and joiners.
INVISIBLE = "\u200b\u2060\ufeff\u00ad\u180e"
DOUBLE_QUOTES = "\u201c\u201d\u201e\u201f\u2033\u00ab\u00bb"
SINGLE_QUOTES = "\u2018\u2019\u201a\u201b\u2032\u2039\u203a"
DASHES = "\u2010\u2011\u2012\u2013\u2014\u2015\u2212"
ZWNJ, ZWJ = "\u200c", "\u200d"
LEGACY_KHANDA_TA, KHANDA_TA = "\u09a4\u09cd\u200d", "\u09ce"

#: White space as Python counts it, but for the newline.
_HORIZONTAL = r"\t\x0B\f\r\x1c-\x1f \x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_EDGE = rf"[{_HORIZONTAL}\n\p{{P}}\p{{Z}}]"


#: A character that composition may change; all below U+0300 are composed as they stand.
_COMPOSABLE = r"[^\x00-\u02ff]"


@F.pandas_udf(T.StringType())
def _nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _nfc_all(texts: pd.Series) -> pd.Series:
    return texts.map(lambda row: [unicodedata.normalize("NFC", t) for t in row])


def nfc(text: Column) -> Column:
    """Canonical composition. What it is made of is computed once, below the crossing to Python."""
    return _nfc(text)


def _folded(t: Column) -> Column:
    """Normalisation of a composed text, but for its last composition."""
    t = F.regexp_replace(t, r"\r\n?", "\n")
    t = F.translate(t, INVISIBLE, "")
    t = F.replace(t, F.lit(LEGACY_KHANDA_TA), F.lit(KHANDA_TA))
    t = F.regexp_replace(t, rf"([{ZWJ}{ZWNJ}])\1+", "$1")
    # A run of joiners after an edge goes whole; before an edge only its last one does.
    t = F.regexp_replace(t, rf"(^|(?<={_EDGE}))[{ZWJ}{ZWNJ}]+", "")
    t = F.regexp_replace(t, rf"[{ZWJ}{ZWNJ}](?={_EDGE}|\z)", "")
    t = F.translate(t, DOUBLE_QUOTES + SINGLE_QUOTES + DASHES, '"' * len(DOUBLE_QUOTES) + "'" * len(SINGLE_QUOTES) + "-" * len(DASHES))
    return _lines(t)


def _lines(t: Column) -> Column:
    t = F.regexp_replace(t, rf"[{_HORIZONTAL}]+", " ")
    t = F.regexp_replace(t, r" ?\n[ \n]*", "\n")
    return F.regexp_replace(t, r"^[ \n]+|[ \n]+\z", "")


def normalise(text: Column) -> Column:
    """The form in which two texts are compared; null counts as empty.

    One pass: composed, line ends unified, invisible characters removed, joiners kept only where they join letters,
    quotes and dashes folded, each run of horizontal white space one blank, lines trimmed and blank lines dropped.
    """
    return nfc(_folded(nfc(F.coalesce(text, F.lit("")))))


def text_hash(text: Column) -> Column:
    """SHA-256 of the normalised text."""
    return F.sha2(normalise(text), 256)


def with_hashes(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """rows with, for each name of columns, the text_hash() of the column that it names.

    Rows without a character that composition, joiners or folding could touch, which are most, never leave the JVM; of the
    others all columns cross to Python together, once before and once after.
    """
    names = list(columns)
    texts = F.array(*[F.coalesce(F.col(c), F.lit("")) for c in columns.values()])
    odd = F.exists(texts, lambda t: t.rlike(_COMPOSABLE))
    digest = lambda t: F.sha2(t, 256)

    def plain(c: str) -> Column:
        t = F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"\r\n?", "\n")
        return digest(_lines(F.translate(F.translate(t, "\u00ad", ""), "\u00ab\u00bb", '""')))

    simple = rows.where(~odd).select("*", *[plain(c).alias(n) for n, c in columns.items()])
    composed = rows.where(odd).withColumn("_t", _nfc_all(texts))
    folded = composed.withColumn("_t", _nfc_all(F.array(*[_folded(F.col("_t")[i]) for i in range(len(names))])))
    return simple.union(folded.select(*rows.columns, *[digest(F.col("_t")[i]).alias(n) for i, n in enumerate(names)]))
