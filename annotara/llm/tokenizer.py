"""Encoding of a corpus by a public byte-level BPE tokenizer.

Method: the merges are compiled into a finite-state transducer over bytes that
is determinised lazily. A state is the set of places where a token may have
begun, each with its node in the token trie and the last token of the encoding
up to there; these sets are finite, because a token has a greatest length. On a
byte the transducer tells the last token of the encoding of the prefix read: of
the tokens that end here, the one that may stand next to the last token before
it. Whether two tokens may stand side by side is decided by the merges next to
the border alone. A token is given as soon as every open place has it behind
itself; open places lie within the longest token, and what they have behind
themselves soon agrees, so no more than a short end of a piece is held.

Defined cases: null and empty texts give an empty list; blank texts are encoded
as they are; no special tokens, their strings are ordinary text.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The pattern that cuts a text into the pieces merges stay within.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Where the vocabularies are; a file is read once on the driver.
VOCAB = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: States, pieces and pairs kept before a worker starts that table anew.
MAX_STATES, MAX_PIECES, MAX_PAIRS = 150_000, 300_000, 500_000
#: Bytes read between two looks at which tokens are final.
LOOK = 256


def read_vocab(path: str = VOCAB) -> bytes:
    with open(path, "rb") as f:
        return f.read()


class Transducer:
    """Byte-level BPE as a lazily determinised finite-state transducer."""

    def __init__(self, vocab: bytes) -> None:
        self.rank: dict[bytes, int] = {base64.b64decode(a): int(b) for a, b in (x.split() for x in vocab.splitlines() if x)}
        self.bytes = {i: t for t, i in self.rank.items()}
        self.size = {i: len(t) for i, t in self.bytes.items()}
        self.child: dict[int, int] = {}
        self.token: dict[int, int] = {}
        self.depth = [0]
        for t, i in self.rank.items():
            at = 0
            for b in t:
                k = at << 8 | b
                nxt = self.child.get(k)
                if nxt is None:
                    nxt = self.child[k] = len(self.depth)
                    self.depth.append(self.depth[at] + 1)
                at = nxt
            self.token[at] = i
        self.pairs: dict[int, bool] = {}
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.cut = regex.compile(PATTERN).findall
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.states: list[tuple[tuple[int, int], ...]] = []
        self.number: dict[tuple[tuple[int, int], ...], int] = {}
        self.delta: dict[int, tuple[int, int]] = {}
        self.clear()

    def clear(self) -> None:
        self.states[:] = [((0, -1),)]
        self.number.clear()
        self.number[self.states[0]] = 0
        self.delta.clear()

    def split(self, t: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes t; None for a single byte."""
        if t in self.halves:
            return self.halves[t]
        text, rank = self.bytes[t], self.rank
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 2:
            at = min(range(len(parts) - 1), key=lambda i: (rank.get(parts[i] + parts[i + 1], 1 << 60), i))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        out = self.halves[t] = (rank[parts[0]], rank[parts[1]]) if len(parts) == 2 else None
        return out

    def adjacent(self, a: int, b: int) -> bool:
        """Whether the encoding of a's bytes and b's bytes is a, b.

        It isn't if a merge across the border came before one that made a or b.
        What stands at the border is taken apart, the latest merge first; each
        pair met on the way must not merge before what is apart already.
        """
        if a < 0:
            return True
        k = a << 20 | b
        ok = self.pairs.get(k)
        if ok is not None:
            return ok
        x, y, before, ok = a, b, 1 << 60, True
        while True:
            joined = self.rank.get(self.bytes[x] + self.bytes[y])
            if joined is not None and joined < before:
                ok = False
                break
            sx, sy = self.split(x), self.split(y)
            if sx is None and sy is None:
                break
            # Of equal merges the left one comes first.
            if sy is None or (sx is not None and x > y):
                before, x = x, sx[1]
            else:
                before, y = y + 1, sy[0]
        if len(self.pairs) >= MAX_PAIRS:
            self.pairs.clear()
        self.pairs[k] = ok
        return ok

    def step(self, state: int, byte: int) -> tuple[int, int]:
        """The next state and the last token of the prefix; made when first asked for."""
        on, last = [], -1
        for node, before in self.states[state]:
            nxt = self.child.get(node << 8 | byte)
            if nxt is not None:
                on.append((nxt, before))
                t = self.token.get(nxt)
                if t is not None and last < 0 and self.adjacent(before, t):
                    last = t
        on.append((0, last))
        key = tuple(on)
        n = self.number.get(key)
        if n is None:
            full = len(self.states) >= MAX_STATES
            if full:
                self.clear()
            n = self.number[key] = len(self.states)
            self.states.append(key)
            if full:
                return n, last
        self.delta[state << 8 | byte] = out = (n, last)
        return out

    def agreed(self, state: int, lasts: list[int]) -> int:
        """Up to where all open places of a state have the same tokens behind."""
        places = {len(lasts) - self.depth[node] for node, _ in self.states[state]}
        while len(places) > 1:
            at = max(places)
            places.remove(at)
            places.add(at - self.size[lasts[at - 1]])
        return places.pop()

    def _back(self, lasts: list[int], end: int) -> list[int]:
        out = []
        while end:
            out.append(lasts[end - 1])
            end -= self.size[out[-1]]
        return out[::-1]

    def stream(self, data: Iterable[int]) -> Iterator[int]:
        """The tokens of the bytes of one piece, each as soon as it is final."""
        state, delta, look = 0, self.delta, LOOK
        lasts: list[int] = []  # the last token of every prefix not given yet
        for b in data:
            hit = delta.get(state << 8 | b)
            state, last = hit if hit is not None else self.step(state, b)
            lasts.append(last)
            if len(lasts) >= look:
                done = self.agreed(state, lasts)
                yield from self._back(lasts, done)
                del lasts[:done]
                look = len(lasts) + LOOK
        yield from self._back(lasts, len(lasts))

    def run(self, piece: bytes) -> tuple[int, ...]:
        """The tokens of one piece."""
        return tuple(self.stream(piece))

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        if not text:
            return out
        pieces = self.pieces
        for p in self.cut(text):
            ids = pieces.get(p)
            if ids is None:
                ids = self.run(p.encode())
                if len(p) <= 64:
                    if len(pieces) >= MAX_PIECES:
                        pieces.clear()
                    pieces[p] = ids
            out += ids
        return out


class Utf8:
    """Incremental UTF-8: a state machine over bytes that gives text as soon as
    a code point is whole; broken sequences give U+FFFD, one per maximal part."""

    def __init__(self) -> None:
        self.need, self.code, self.low, self.high = 0, 0, 0x80, 0xBF

    def feed(self, data: bytes) -> str:
        out, i = [], 0
        while i < len(data):
            b = data[i]
            if self.need:
                if self.low <= b <= self.high:
                    self.code, self.need, self.low, self.high = self.code << 6 | b & 0x3F, self.need - 1, 0x80, 0xBF
                    if not self.need:
                        out.append(chr(self.code))
                    i += 1
                else:
                    out.append("�")
                    self.need, self.low, self.high = 0, 0x80, 0xBF
                continue
            i += 1
            if b < 0x80:
                out.append(chr(b))
            elif 0xC2 <= b <= 0xDF:
                self.need, self.code = 1, b & 0x1F
            elif 0xE0 <= b <= 0xEF:
                self.need, self.code = 2, b & 0x0F
                self.low, self.high = (0xA0 if b == 0xE0 else 0x80), (0x9F if b == 0xED else 0xBF)
            elif 0xF0 <= b <= 0xF4:
                self.need, self.code = 3, b & 0x07
                self.low, self.high = (0x90 if b == 0xF0 else 0x80), (0x8F if b == 0xF4 else 0xBF)
            else:
                out.append("�")
        return "".join(out)

    def end(self) -> str:
        left, self.need = self.need, 0
        return "�" if left else ""


_MADE: dict[int, Transducer] = {}


def transducer(vocab: bytes) -> Transducer:
    """One transducer per worker process and vocabulary."""
    k = hash(vocab)
    if k not in _MADE:
        _MADE.clear()
        _MADE[k] = Transducer(vocab)
    return _MADE[k]


def decode(t: Transducer, ids: list[int]) -> str:
    u = Utf8()
    return "".join([u.feed(t.bytes[i]) for i in ids]) + u.end()


def encode(docs: DataFrame, key: str, text: str, vocab_path: str = VOCAB) -> DataFrame:
    """(key, ids array<int>) of every row; no shuffle, one pass over the text."""
    vocab = docs.sparkSession.sparkContext.broadcast(read_vocab(vocab_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(vocab.value)
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                ids = [t.encode(x) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["k", "ids"])

    kind = dict(docs.dtypes)[key]
    return docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, ids array<int>").withColumnRenamed("k", key)


def lengths(docs: DataFrame, key: str, text: str, vocab_path: str = VOCAB) -> DataFrame:
    """(key, size): the number of tokens of every row, without the tokens."""
    vocab = docs.sparkSession.sparkContext.broadcast(read_vocab(vocab_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(vocab.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t.encode(x)) for x in b.column(1).to_pylist()], pa.int64())], names=["k", "size"])

    kind = dict(docs.dtypes)[key]
    return docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, size bigint").withColumnRenamed("k", key)


def round_trip(encoded: DataFrame, key: str, vocab_path: str = VOCAB) -> DataFrame:
    """(key, text): the ids decoded again."""
    vocab = encoded.sparkSession.sparkContext.broadcast(read_vocab(vocab_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(vocab.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([decode(t, x) for x in b.column(1).to_pylist()], pa.string())], names=["k", "text"])

    kind = dict(encoded.dtypes)[key]
    return encoded.select(F.col(key).alias("k"), "ids").mapInArrow(run, f"k {kind}, text string").withColumnRenamed("k", key)
