"""Column functions on strings, arrays and maps; all stay inside the JVM unless
the docstring says otherwise. Nulls give null."""

from __future__ import annotations

import difflib
import string
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

#: Fixed value: what counts as a token on both engines.
TOKEN = r"[\p{L}\p{N}_]{2,}"


def tokens(c: Column, pattern: str = TOKEN) -> Column:
    """Lower-case tokens of two or more letters, digits or underscores."""
    return F.regexp_extract_all(F.lower(c), F.lit(pattern), F.lit(0))


def ascii_clean(c: Column) -> Column:
    """Without non-ASCII characters and backslashes."""
    return F.regexp_replace(c, r"[^\x00-\x7F]|\\", "")


@F.pandas_udf(StringType())
def _nfc(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in it:
        yield s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def nfc_clean(c: Column, replacement: str = " ") -> Column:
    """Canonical composition (an Arrow UDF), then non-ASCII to replacement."""
    return F.regexp_replace(_nfc(c), r"[^\x00-\x7F]", replacement)


def passage_clean(c: Column) -> Column:
    """Leading 'null' runs dropped, white space and non-ASCII runs to a blank,
    stray quotes closed up; texts of two characters or fewer become null."""
    x = F.regexp_replace(c, r"^(?:null)+", "")
    x = F.regexp_replace(F.regexp_replace(x, r"[\t\r\n]+", " "), r"[^\x00-\x7F]+", " ")
    x = F.regexp_replace(F.regexp_replace(x, r"^' | ' ", " "), r" 's\b", "'s")
    x = F.trim(x)
    return F.when(F.length(x) > 2, x)


def query_clean(c: Column, replacement: str = "", brackets: bool = False) -> Column:
    """Safe inside a graph query: leading plus signs and ? | $ ! # go, with
    brackets also ( ) [ ]; then trimmed."""
    bad = r"[?|$!#()\[\]]" if brackets else r"[?|$!#]"
    return F.trim(F.regexp_replace(F.regexp_replace(ascii_clean(c), r"^\++", replacement), bad, replacement))


def drop_bracketed(c: Column) -> Column:
    """Without the longest [...] part."""
    return F.regexp_replace(c, r"\[.*\]", "")


def word_span(text: Column, word: Column) -> Column:
    """struct(start, end) of the first place of word in text; (len, len) if none."""
    at = F.instr(text, word) - 1
    n = F.length(text)
    return F.struct(F.when(at >= 0, at).otherwise(n).alias("start"), F.when(at >= 0, at + F.length(word)).otherwise(n).alias("end"))


def capital_first(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substr(c, F.lit(2)))


#: Words title case keeps small inside a title.
SMALL_WORDS = ["a", "an", "and", "as", "at", "but", "by", "en", "for", "if", "in", "of", "on", "or", "the", "to", "v", "v.", "via", "vs", "vs."]


def kept_title(c: Column) -> Column:
    """Title case, but capitals that stand already are kept. Small words stay
    small unless they are the first or the last or follow a stop; parts of a
    word behind a hyphen or a slash begin large; words with a stop or a capital
    inside are left as they are."""
    words = F.split(c, " ")
    last = F.size(words) - 1

    def large(p: Column) -> Column:
        head = F.regexp_extract(p, r"^[^\p{L}\p{N}_]*", 0)
        n = F.length(head)
        return F.concat(head, F.upper(F.substr(p, n + 1, F.lit(1))), F.substr(p, n + 2))

    def one(w: Column, i: Column) -> Column:
        ends = (i == 0) | (i == last) | F.rlike(F.try_element_at(words, i), F.lit("[:.;?!\u2014-]$"))
        small = F.lower(w).isin(SMALL_WORDS) & ~F.coalesce(ends, F.lit(True))
        left = F.rlike(w, F.lit(r"[a-zA-Z]+[A-Z]")) | F.rlike(w, F.lit(r"(?i)[a-z][.][a-z]"))
        pieces = F.split(F.regexp_replace(w, r"([-/])", "$1\x01"), "\x01")
        return F.when(small | left, w).otherwise(F.array_join(F.transform(pieces, large), ""))

    return F.array_join(F.transform(words, one), " ")


def match_pairs(texts: Column, patterns: Column, every: bool = False) -> Column:
    """Whether texts match the patterns pairwise: any of them, or every one."""
    pairs = F.zip_with(texts, patterns, lambda t, p: F.struct(t.alias("t"), p.alias("p")))
    test = lambda x: F.coalesce(F.rlike(x["t"], x["p"]), F.lit(False))
    return F.forall(pairs, test) if every else F.exists(pairs, test)


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff/Obershelp ratio of two strings (an Arrow UDF)."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def pad_list(a: Column, length: int, dummy: Column | None = None) -> Column:
    """Exactly length elements: cut, or filled up with dummy ('' if none)."""
    return F.slice(F.concat(a, F.array_repeat(F.lit("") if dummy is None else dummy, length)), 1, length)


def merge_maps(a: Column, b: Column) -> Column:
    """a and b as one map, b winning, whatever the session's dedup policy."""
    keys = F.map_keys(b)
    kept = F.map_filter(a, lambda k, _: ~F.array_contains(keys, k))
    return F.map_concat(kept, b)


def align_lists(items: Column, reference: Column) -> Column:
    """The reference's order for what both hold, then the rest in its own order."""
    both = F.filter(reference, lambda x: F.array_contains(items, x))
    rest = F.filter(items, lambda x: ~F.array_contains(reference, x))
    return F.concat(both, rest)


def drop_punctuation(a: Column) -> Column:
    """Without tokens that are part of the row of ASCII punctuation (so '()'
    and the empty token go and '...' stays)."""
    return F.filter(a, lambda t: ~F.contains(F.lit(string.punctuation), t))


def kept_punctuation(a: Column) -> Column:
    """The 0-based places drop_punctuation keeps."""
    marked = F.transform(a, lambda t, i: F.when(~F.contains(F.lit(string.punctuation), t), i))
    return F.filter(marked, lambda i: i.isNotNull())


def windows(a: Column, half: int, pad: Column) -> Column:
    """The 2 half + 1 neighbours of every element, padded at both ends."""
    fill = F.array_repeat(pad, half)
    padded = F.concat(fill, a, fill)
    return F.when(F.size(a) > 0, F.transform(F.sequence(F.lit(1), F.size(a)), lambda i: F.slice(padded, i, 2 * half + 1))).otherwise(F.array().cast("array<array<string>>"))


def context(a: Column, first: Column, last: Column, window: int = 0, with_target: bool = True) -> Column:
    """struct(left, right): the words up to the target, and those from it on
    reversed; at most window words each (0: all), the target counted or not."""
    left = F.slice(a, 1, last + 1) if with_target else F.slice(a, 1, first)
    right = F.slice(a, first + 1, F.size(a)) if with_target else F.slice(a, last + 2, F.size(a))
    if window:
        left = F.slice(left, F.greatest(F.size(left) - window + 1, F.lit(1)), window)
        right = F.slice(right, 1, window)
    return F.struct(left.alias("left"), F.reverse(right).alias("right"))


def chunks(a: Column, n: int, fill: Column) -> Column:
    """Fixed-size pieces, the last one filled up."""
    whole = F.concat(a, F.array_repeat(fill, F.pmod(-F.size(a), F.lit(n)).cast("int")))
    return F.when(F.size(a) > 0, F.transform(F.sequence(F.lit(1), F.size(a), F.lit(n)), lambda i: F.slice(whole, i, n)))


def subsets(a: Column, least: int = 0) -> Column:
    """All subsets with at least least elements; meant for short arrays."""
    start = F.array(F.array().cast("array<string>"))
    sets = F.aggregate(a, start, lambda acc, x: F.concat(acc, F.transform(acc, lambda s: F.concat(s, F.array(x)))))
    return F.filter(sets, lambda s: F.size(s) >= least)


def sorted_entries(m: Column, by_value: bool = True) -> Column:
    """The entries of a map ordered by value (then key) or by key."""
    e = F.map_entries(m)
    if by_value:
        e = F.array_sort(F.transform(e, lambda x: F.struct(x["value"].alias("value"), x["key"].alias("key"))))
    else:
        e = F.array_sort(F.transform(e, lambda x: F.struct(x["key"].alias("key"), x["value"].alias("value"))))
    return e


def signed_label(p: Column, threshold: float = 0.5) -> Column:
    """-1, 0 or 1: zero inside the threshold, else the sign."""
    return F.when(F.abs(p) <= threshold, 0).otherwise(F.signum(p).cast("int"))


def unit_norm(a: Column, order: int = 1) -> Column:
    """a divided by its L-order norm; all zero stays zero."""
    total = F.aggregate(F.transform(a, lambda x: F.pow(F.abs(x.cast("double")), F.lit(order))), F.lit(0.0), lambda s, x: s + x)
    norm = F.pow(total, F.lit(1.0 / order))
    return F.transform(a, lambda x: F.when(norm == 0, F.lit(0.0)).otherwise(x.cast("double") / norm))


def soft_max(a: Column, t: float = 1.0) -> Column:
    e = F.transform(a, lambda x: F.exp(x.cast("double") / t))
    total = F.aggregate(e, F.lit(0.0), lambda s, x: s + x)
    return F.transform(e, lambda x: x / total)


def index_gather(a: Column, idx: Column) -> Column:
    """The elements of a at 0-based places."""
    return F.transform(idx, lambda i: F.try_element_at(a, i + 1))


def drop_repeats(a: Column) -> Column:
    """Without repeats; the first of equal elements stays where it is."""
    return F.array_distinct(a)


def flat(a: Column, depth: int) -> Column:
    """The elements of an array nested depth deep, in order."""
    for _ in range(depth - 1):
        a = F.flatten(a)
    return a


def sorted_by(a: Column, key: Callable[[Column], Column]) -> Column:
    """a in the order of a key of its elements; equal keys keep their order."""
    keyed = F.transform(a, lambda x, i: F.struct(key(x).alias("k"), i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda s: s["x"])


def crop(a: Column, start: int, end: int) -> Column:
    """The elements from start up to, but not with, end (0-based)."""
    return F.slice(a, start + 1, max(end - start, 0))


def fill(a: Column, value: Column, times: int) -> Column:
    """a with value so many times behind it."""
    return F.concat(a, F.array_repeat(value, times))


def mask_avg(a: Column) -> Column:
    """The mean of the elements that are not 0; null if all are."""
    kept = F.filter(a, lambda x: x != 0)
    return F.try_divide(F.aggregate(kept, F.lit(0.0), lambda t, x: t + x), F.size(kept))
