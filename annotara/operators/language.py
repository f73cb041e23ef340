"""Tokens, sentences, lemmas and word classes by rules; columns stay in the JVM."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The rules of the Penn Treebank tokens, in order. What a rule
#: puts white space round becomes a token; straight double quotes become `` and ''.
TREEBANK = [
    (r'^"', "`` "), (r'([ (\[{<])"', "$1 `` "), (r"\.\.\.", " ... "), (r"([:,])([^0-9])", " $1 $2"), (r"([:,])$", " $1 "), (r"([;@#$%&?!\]\[(){}<>])", " $1 "), (r"--", " -- "),
    (r"([^.])([.])([\])}>\"']*)\s*$", "$1 $2$3 "), (r"$", " "), (r"^", " "), (r'"', " '' "), (r"([^' ])('[sSmMdD]|') ", "$1 $2 "), (r"([^' ])('ll|'LL|'re|'RE|'ve|'VE|n't|N'T) ", "$1 $2 "),
]
#: Endings a noun, a verb and an adjective may shed, with what they become.
ENDINGS = {
    "n": [("s", ""), ("ses", "s"), ("ves", "f"), ("xes", "x"), ("zes", "z"), ("ches", "ch"), ("shes", "sh"), ("men", "man"), ("ies", "y")],
    "v": [("s", ""), ("ies", "y"), ("es", "e"), ("es", ""), ("ed", "e"), ("ed", ""), ("ing", "e"), ("ing", "")],
    "a": [("er", ""), ("est", ""), ("er", "e"), ("est", "e")],
}
#: Words of closed classes and endings by which the others are told.
CLOSED = {
    "DT": ["a", "an", "the", "this", "that", "these", "those", "no", "each", "every", "all", "some"], "IN": ["in", "of", "on", "at", "by", "for", "with", "from", "after", "before", "during", "under", "between", "as", "if"],
    "CC": ["and", "or", "but", "nor"], "TO": ["to"], "MD": ["can", "could", "may", "might", "must", "shall", "should", "will", "would"], "PRP": ["i", "you", "he", "she", "it", "we", "they", "them", "him", "us"],
    "VBD": ["was", "were", "had", "did"], "VBZ": ["is", "has", "does"], "VBP": ["are", "have", "do"], "VB": ["be"], "VBN": ["been"],
}
SUFFIXES = [("ly", "RB"), ("ing", "VBG"), ("ed", "VBD"), ("ous", "JJ"), ("ful", "JJ"), ("able", "JJ"), ("ible", "JJ"), ("ic", "JJ"), ("al", "JJ"), ("ive", "JJ"), ("est", "JJS"), ("s", "NNS")]
#: Between these two a sentence ends.
_SENTENCE = r'([.!?]["”’)\]]*)\s+([\p{Lu}0-9"“(])'


def treebank_tokens(c: Column) -> Column:
    """Tokens by the Penn Treebank rules; null gives null, blank gives none."""
    spaced = reduce(lambda x, rule: F.regexp_replace(x, *rule), TREEBANK, c)
    return F.filter(F.split(spaced, r"\s+"), lambda t: t != "")


def sentence_list(c: Column) -> Column:
    """Sentences by a rule: they end with . ! or ?, closing marks, white space
    and a capital, a digit or an opening mark. For boundaries across languages
    the package has an operator of its own; this is the plain tokenizer mode."""
    return F.split(F.regexp_replace(c, _SENTENCE, "$1\x01$2"), "\x01")


def word_tokens(c: Column) -> Column:
    """The Treebank tokens of every sentence, in order."""
    return F.flatten(F.transform(sentence_list(c), treebank_tokens))


def lemmas(tokens: DataFrame, lexicon: DataFrame, kind: str = "n") -> DataFrame:
    """(doc, pos, term, lemma) of (doc, pos, term): the first form a word takes
    by shedding an ending of its kind that lexicon (word) holds, the word itself
    before all; the word if there is none. Words are looked up once each."""
    rules = [("", ""), *ENDINGS[kind]]
    forms = F.array(*[F.struct(F.lit(i).alias("i"), F.when(F.endswith("term", F.lit(e)), F.concat(F.substr("term", F.lit(1), F.length("term") - len(e)), F.lit(r))).alias("form")) for i, (e, r) in enumerate(rules)])
    words = tokens.select("term").distinct()
    tried = words.select("term", F.explode(forms).alias("x")).select("term", "x.i", "x.form").filter("form <> ''")
    best = tried.join(lexicon.select(F.col("word").alias("form")).distinct(), "form").groupBy("term").agg(F.min_by("form", "i").alias("lemma"))
    return tokens.join(best, "term", "left").select("doc", "pos", "term", F.coalesce("lemma", "term").alias("lemma"))


def word_class(term: Column) -> Column:
    """The class of a word by closed lists, shape and ending, else NN."""
    low = F.lower(term)
    out = F.when(F.rlike(term, F.lit(r"^[+-]?[0-9][0-9.,]*$")), "CD").when(F.rlike(term, F.lit(r"^[^\p{L}\p{N}]+$")), "SYM")
    for tag, words in CLOSED.items():
        out = out.when(low.isin(words), tag)
    out = out.when(F.rlike(term, F.lit(r"^\p{Lu}")), "NNP")
    for end, tag in SUFFIXES:
        out = out.when(F.endswith(low, F.lit(end)) & (F.length(low) > len(end) + 2), tag)
    return out.otherwise("NN")


#: A row's places lie between two multiples of this; below all places is LOW.
_ROW, _LOW = 1 << 41, -(1 << 39)


def _align_row(error: int):
    """Rows (doc, annots, toks) to what is aligned in each, a few rows at once."""

    def lists(col: pa.Array) -> tuple[pa.StructArray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The elements in the order of rows, sentences and places: row, start, end, where each stood."""
        flat, row = col.flatten(), np.repeat(np.arange(len(col)), pc.fill_null(pc.list_value_length(col), 0).to_numpy())
        sent, i, start, end = (pc.fill_null(pc.cast(flat.field(f), pa.int64()), _LOW).to_numpy() for f in ("sent", "i", "start", "end"))
        o = np.lexsort((i, sent, row))
        return flat, row[o], start[o], end[o], o

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                annots, ar, starts, ends, ao = lists(part.column(1))
                toks, tr, ts, te, to = lists(part.column(2))
                if not len(ar) or not len(tr):
                    continue
                by_start, by_end, none = np.argsort(tr * _ROW + ts, kind="stable"), np.argsort(tr * _ROW + te, kind="stable"), len(tr)
                at_start, at_end = (tr * _ROW + ts)[by_start], (tr * _ROW + te)[by_end]

                def at(order: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                    """The tokens at n of an order, and which of them are there and of the row."""
                    t = order[np.clip(n, 0, none - 1)]
                    return t, (n >= 0) & (n < none) & (tr[t] == ar)  # noqa: B023

                key = ar * _ROW + starts
                t, own = at(by_start, np.searchsorted(at_start, key) - 1)
                inside = np.where(own & (te[t] > starts), t, none)  # the token the start lies in
                t, own = at(by_start, np.searchsorted(at_start, key - error))
                first = np.minimum(inside, np.where(own & (ts[t] <= starts + error), t, none))
                t, own = at(by_end, np.searchsorted(at_end, ar * _ROW + ends - error))
                last = np.maximum(np.where(own, t, np.searchsorted(tr, ar, "right") - 1), first)
                n = np.where((first < none) & (starts > _LOW), last - first + 1, 0)
                who = np.repeat(np.arange(len(ar)), n)
                tok = np.repeat(first, n) + np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n)
                mine, other = annots.take(pa.array(ao[who])), toks.take(pa.array(to[tok]))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(ar[who])), mine.field("sent"), mine.field("i"), other.field("sent"), other.field("i")], names=["doc", "asent", "annot", "tsent", "tok"])

    return run


def align_rows(docs: DataFrame, error: int = 0) -> DataFrame:
    """(doc, asent, annot, tsent, tok) of rows (doc, annots, toks), which list
    (sent, i, start, end): annotations against tokens by the rules of
    annotate.align(). A document is one row, so nothing is moved."""
    own, other = (docs.schema[c].dataType.elementType for c in ("annots", "toks"))
    kind = lambda t, f: t[f].dataType.simpleString()
    kinds = f"doc {dict(docs.dtypes)['doc']}, asent {kind(own, 'sent')}, annot {kind(own, 'i')}, tsent {kind(other, 'sent')}, tok {kind(other, 'i')}"
    return docs.filter("doc is not null").select("doc", "annots", "toks").mapInArrow(_align_row(error), kinds)


def align_lists(annots: DataFrame, toks: DataFrame, error: int = 0) -> DataFrame:
    """(doc, asent, annot, tsent, tok): annotations grouped by sentence (doc,
    sent, i, start, end) against tokens grouped so. Both are put in one row of
    the document, aligned, and named by sentence and place again."""
    one = F.collect_list(F.struct("sent", "i", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end")))
    return align_rows(annots.groupBy("doc").agg(one.alias("annots")).join(toks.groupBy("doc").agg(one.alias("toks")), "doc"), error)


def label_hits(tokens: DataFrame, labels: DataFrame) -> DataFrame:
    """(token, id, label): the labels (id, label) each distinct token (token)
    stands in, whatever the case and wherever in a word.

    Every piece of a label that is as long as some token is met by an equi-join
    with the tokens, so the work grows with the labels' text, not with pairs.
    """
    words = tokens.select(F.lower("token").alias("piece"), "token").filter("piece <> ''").distinct()
    sizes = sorted(r[0] for r in words.select(F.length("piece")).distinct().collect())  # lengths, not tokens
    each = labels.select("id", "label", F.lower("label").alias("low")).distinct()
    cut_at = lambda n: F.when(F.length("low") >= n, F.transform(F.sequence(F.lit(1), F.length("low") - n + 1), lambda i: F.substr("low", i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    pieces = F.array_distinct(F.flatten(F.array(*[cut_at(n) for n in sizes]))) if sizes else F.array().cast("array<string>")
    return each.select("id", "label", F.explode(pieces).alias("piece")).join(words, "piece").select("token", "id", "label")
