"""Text columns: normalisation, Hangul jamo, rulers. Everything here stays in the JVM but `ratio`, `nfd_any` and `nfc_strip`."""

from __future__ import annotations

import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

#: Fixed values of Unicode's Hangul composition.
S_BASE, L_BASE, V_BASE, T_BASE = 0xAC00, 0x1100, 0x1161, 0x11A7
V_COUNT, T_COUNT, S_COUNT = 21, 28, 11172
#: Fixed value: characters that lines must not hold.
UNDRAWABLE = "·「」『』《》〈〉…°㎡№"


def char(code: Column) -> Column:
    """The character of a code point below 65536 (chr() wraps at 256)."""
    return F.decode(F.unhex(F.lpad(F.hex(code), 4, "0")), "UTF-16BE")


def chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def syllable(head: Column, mid: Column, tail: Column) -> Column:
    return char((F.lit(S_BASE) + (head * V_COUNT + mid) * T_COUNT + tail).cast("int"))


def _jamo(base: int, count: int, at: Column) -> Column:
    """The at-th of `count` jamo from a code point on, looked up in a constant array."""
    return F.element_at(F.array(*[F.lit(chr(base + k)) for k in range(count)]), at + 1)


def nfd_hangul(text: Column) -> Column:
    """Syllables taken apart into conjoining jamo; other characters as they are."""

    def one(c):
        n = F.ascii(c) - S_BASE
        tail = n % T_COUNT
        parts = F.concat(_jamo(L_BASE, S_COUNT // (V_COUNT * T_COUNT), F.floor(n / (V_COUNT * T_COUNT)).cast("int")), _jamo(V_BASE, V_COUNT, F.floor((n % (V_COUNT * T_COUNT)) / T_COUNT).cast("int")), F.when(tail > 0, _jamo(T_BASE, T_COUNT, tail)).otherwise(F.lit("")))
        return F.when((n >= 0) & (n < S_COUNT), parts).otherwise(c)

    return F.array_join(F.transform(chars(text), one), "")


@F.pandas_udf(StringType())
def nfd_any(text: pd.Series) -> pd.Series:
    """NFD of any script (Spark has no normalising function)."""
    return text.map(lambda s: None if s is None else unicodedata.normalize("NFD", s))


@F.pandas_udf(StringType())
def nfc_strip(text: pd.Series) -> pd.Series:
    return text.map(lambda s: None if s is None else unicodedata.normalize("NFC", s).strip())


def tight(text: Column) -> Column:
    """Without white space."""
    return F.regexp_replace(text, r"(?U)\s+", "")


def ascii_fold(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\x00-\x7F]", "?")


def drawable(text: Column) -> Column:
    return (text != "") & ~text.rlike(f"[{UNDRAWABLE}]")


def bare_jamo(text: Column) -> Column:
    return text.rlike(r"[\x{3131}-\x{318E}]")


def kind(text: Column) -> Column:
    """Content kind of a line; the first that fits."""
    return F.when(text.rlike("[A-Za-z]"), "latin").when(text.rlike("[0-9]"), "digits").when(text.contains(":"), "label").when(F.length(tight(text)) <= 6, "word").otherwise("sentence")


def span(text: Column) -> Column:
    """Length span of a line without white space."""
    n = F.length(tight(text))
    return F.when(n <= 5, "1-5").when(n <= 10, "6-10").when(n <= 20, "11-20").otherwise("21+")


@F.pandas_udf(DoubleType())
def ratio(read: pd.Series, truth: pd.Series) -> pd.Series:
    """2M/T of difflib's matcher; not symmetric, popular characters of a truth of 200 or more are junk."""
    return pd.Series([None if a is None or b is None else SequenceMatcher(None, a, b).ratio() for a, b in zip(read, truth, strict=True)], dtype=float)


def close(read: Column, truth: Column) -> Column:
    """Agreement of two reads: both non-empty, lengths within 0.6, ratio at least 0.5, lower-cased and taken apart. The
    length test is native and goes first."""
    a, b = nfd_hangul(F.lower(read)), nfd_hangul(F.lower(truth))
    near = (a != "") & (b != "") & (F.least(F.length(a), F.length(b)) >= 0.6 * F.greatest(F.length(a), F.length(b)))
    return F.coalesce(F.when(near, ratio(a, b) >= 0.5).otherwise(False), F.lit(False))


def ratio_tight(read: Column, truth: Column) -> Column:
    """Agreement of two reads taken apart to jamo and without white space."""
    return ratio(tight(nfd_hangul(read)), tight(nfd_hangul(truth)))


def positional(read: Column, truth: Column) -> Column:
    """Share of the truth's characters met at the same place."""
    hits = F.size(F.filter(F.zip_with(chars(read), chars(truth), lambda a, b: a == b), lambda same: same))
    return hits / F.greatest(F.length(truth), F.lit(1))


def encode(text: Column, vocab: Column, wrap: bool = True) -> Column:
    """Ids of a text's characters by a map column; characters outside it are dropped. 1 and 2 wrap."""
    ids = F.filter(F.transform(chars(text), lambda c: F.try_element_at(vocab, c)), lambda i: i.isNotNull())
    return F.concat(F.array(F.lit(1)), ids, F.array(F.lit(2))) if wrap else ids


def decode_ids(ids: Column, tokens: Column) -> Column:
    """Characters of ids by an array column of tokens, without 0, 1, 2 and what is out of range."""
    return F.array_join(F.transform(F.filter(ids, lambda i: (i > 2) & (i < F.size(tokens))), lambda i: F.element_at(tokens, i + 1)), "")
