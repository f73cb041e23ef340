"""Stemmers as Arrow UDFs over token arrays: Porter and a suffix pattern."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

_V = "aeiou"


def _cons(w: str, i: int) -> bool:
    c = w[i]
    return c not in _V and not (c == "y" and i > 0 and _cons(w, i - 1))


def _measure(w: str) -> int:
    n, last = 0, True
    for i in range(len(w)):
        c = _cons(w, i)
        n += c and not last
        last = c
    return n


def _vowel(w: str) -> bool:
    return any(not _cons(w, i) for i in range(len(w)))


def _cvc(w: str) -> bool:
    n = len(w)
    return n > 2 and _cons(w, n - 1) and not _cons(w, n - 2) and _cons(w, n - 3) and w[-1] not in "wxy"


#: Fixed values of the published algorithm: suffixes and their replacements.
_STEP2 = "ational:ate tional:tion enci:ence anci:ance izer:ize bli:ble alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble logi:log"
_STEP3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"
_S2 = [tuple(x.split(":")) for x in _STEP2.split()]
_S3 = [tuple(x.split(":")) for x in _STEP3.split()]
_S4 = sorted(_STEP4.split(), key=len, reverse=True)


@lru_cache(maxsize=200_000)
def porter(w: str) -> str:
    """The Porter stem of one lower-case word."""
    if len(w) < 3 or not w.isascii():
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        cut = 2 if w.endswith("ed") else 3 if w.endswith("ing") else 0
        if cut and _vowel(w[:-cut]):
            w = w[:-cut]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif len(w) > 1 and w[-1] == w[-2] and _cons(w, len(w) - 1) and w[-1] not in "lsz":
                w = w[:-1]
            elif _measure(w) == 1 and _cvc(w):
                w += "e"
    if w.endswith("y") and _vowel(w[:-1]):
        w = w[:-1] + "i"
    for rules in (_S2, _S3):
        for suf, rep in sorted(rules, key=lambda x: -len(x[0])):
            if w.endswith(suf):
                if _measure(w[: -len(suf)]) > 0:
                    w = w[: -len(suf)] + rep
                break
    for suf in _S4:
        if w.endswith(suf):
            stem = w[: -len(suf)]
            if _measure(stem) > 1 and (suf != "ion" or stem[-1:] in ("s", "t")):
                w = stem
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _cvc(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


@F.pandas_udf(ArrayType(StringType()))
def porter_stems(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in it:
        yield s.map(lambda a: None if a is None else [porter(x) for x in a])


def pattern_stems(a: Column, pattern: str = r"(?:ing|s|e|able)$", least: int = 4) -> Column:
    """Words of at least `least` letters without a suffix; inside the JVM."""
    return F.transform(a, lambda w: F.when(F.length(w) >= least, F.regexp_replace(w, pattern, "")).otherwise(w))


__all__ = ["pattern_stems", "porter", "porter_stems"]
