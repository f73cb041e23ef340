"""Sentence boundaries across languages and scripts.

Method: the boundary rules are compiled into finite transducers whose input is
classes of what stands at a place and next to it. One reads lines (blank, list
marker, short, closed by punctuation) and tells headings and list items; the
other reads marks within a text: stops with the class of the word before and of
what follows (abbreviation, initial, decimal, lower case, opening quote...),
brackets and quotes with the class of what follows, hard breaks, Thai spaces.
Its states are the outermost open bracket with its depth, whether it opened the
unit, and whether the unit has begun. The rules are rows of its table: a stop
after an abbreviation is a mark that ends nothing in any state.

The marks of a batch of documents are cut into chunks; every chunk becomes a
state-transition function, the functions are composed by a parallel prefix
scan, and then all chunks emit at once. A long document is many chunks, a chunk
may hold several short ones; all go the same way.

Garbled text is split as the original would be: it is restored first, and the
units are placed back into the text as stored.

Defined cases: null, empty and blank texts have no unit; units are in order, do
not overlap, leave out white space only and neither begin nor end with it; an
opening bracket or quote that nothing closes before a blank line is an ordinary
character; brackets of one kind are told apart to a depth of DEPTH.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annotara.llm.garbled import restore

#: Marks of a chunk.
CHUNK = 256
#: Nested brackets of one kind that are told apart; quotes nest twice.
DEPTH = 8

#: Kinds of brackets and quotes: opening character to closing characters.
KINDS = {"(": ")", "[": "]", "{": "}", "（": "）", "［": "］", "「": "」", "『": "』", "【": "】", "〈": "〉", "《": "》", "“": "”", "„": "“”", "«": "»", "‘": "’", '"': '"'}
_OPENERS = list(KINDS)
_DEPTHS = [DEPTH if o in "([{（［" else 2 for o in _OPENERS]
_QUOTES = "”“»’」』\"》〉"
_CLOSERS = "".join(sorted(set("".join(KINDS.values())) - {'"', "“"}))

#: Classes of a stop: the word before it, the character before it, what comes
#: next, and whether that touches (T), comes after closing marks (A) or a gap (G).
WORDS = ("plain", "word", "before number", "never", "maybe", "hour", "day", "path")
BEFORES = ("digit", "lower", "upper", "uncased", "indic", "close", "other")
NEXTS = ("end", "comma", "colon", "digit", "upper+", "upper", "lower", "starter", "uncased", "thai", "indic", "opener", "bullet", "other")
HOWS = "TAG"
#: Classes of what comes after a closing mark.
AFTERS = ("end", "goes on", "particle", "upper", "else")

TEXT, HARD, THAI, RESET = 0, 1, 2, 3
_STOP = 4
_STRONG0 = _STOP + len(WORDS) * len(BEFORES) * len(NEXTS) * len(HOWS)
_ELLIPSIS0 = _STRONG0 + 2
_BRACKET0 = _ELLIPSIS0 + 2 * 2 * len(NEXTS)  # then per kind: open, and closing by (done, after)
_PER_KIND = 1 + 2 * len(AFTERS)
_LOW_QUOTE = _BRACKET0 + _PER_KIND * len(KINDS)  # the mark “, which closes „ and opens otherwise
_PAD = _LOW_QUOTE + 2 * len(AFTERS)


def stop_mark(word: int, before: int, nxt: int, how: int) -> int:
    return _STOP + ((word * len(BEFORES) + before) * len(NEXTS) + nxt) * len(HOWS) + how


def ellipsis_mark(cited: bool, gap: bool, nxt: int) -> int:
    return _ELLIPSIS0 + (2 * cited + gap) * len(NEXTS) + nxt


def stop_ends(word: str, before: str, nxt: str, how: str) -> bool:
    """The rule of a full stop."""
    tight = how == "T" and nxt != "end"
    if tight and before == nxt and nxt in ("digit", "indic"):
        return False
    if nxt == "comma" or (nxt == "colon" and how != "G"):
        return False
    if word == "before number" and nxt == "digit":
        return False
    if word == "never":
        return nxt == "end"
    if word in ("maybe", "hour"):
        return nxt in ("end", "upper+", "upper", "starter", "uncased", "thai", "indic", "opener", "bullet") or (nxt == "digit" and word == "maybe")
    if word == "day":
        return False
    if not tight:
        return True
    if word == "path":
        return False
    uncased = before in ("uncased", "indic")
    if nxt in ("uncased", "thai", "indic"):
        return nxt == "uncased" or not uncased
    if nxt in ("upper", "upper+"):
        return before in ("lower", "close") or uncased or (nxt == "upper+" and before in ("digit", "upper"))
    if nxt in ("starter", "digit"):
        return word == "word" or uncased
    return nxt == "opener"


def ellipsis_ends(cited: bool, gap: bool, nxt: str) -> bool:
    """The rule of an ellipsis or a run of stops."""
    return cited or nxt == "end" or (gap and nxt not in ("lower", "starter", "comma", "colon"))


def closing(done: bool, after: str, quote: bool) -> int:
    """The rule of a closing mark: 1 it ends nothing, 2 it ends a unit that its
    opening began, 3 it ends any."""
    if not done or after in ("goes on", "particle"):
        return 1
    return 3 if after == "end" or (after == "upper" and quote) else 2


def compile_transducer() -> tuple[np.ndarray, np.ndarray]:
    """(next state, output) by mark and state. State 0: the unit is empty, 1: it
    has begun; then kind x opened the unit or not x depth."""
    first = [2]
    for d in _DEPTHS:
        first.append(first[-1] + 2 * d)
    step = np.tile(np.arange(first[-1], dtype=np.int16), (_PAD + 1, 1))
    out = np.zeros((_PAD + 1, first[-1]), np.int8)

    def at(kind: int, began: int, depth: int) -> int:
        return first[kind] + began * _DEPTHS[kind] + depth

    def ends(mark: int) -> None:
        step[mark, :2], out[mark, :2] = 0, 1

    def text(mark: int) -> None:
        step[mark, 0] = 1

    def opens(mark: int, kind: int) -> None:
        step[mark, 0], step[mark, 1] = at(kind, 1, 0), at(kind, 0, 0)

    def closes(mark: int, kind: int, how: int) -> None:
        for began in (0, 1):
            for d in range(_DEPTHS[kind] - 1):
                step[mark, at(kind, began, d + 1)] = at(kind, began, d)
            end = how == 3 or (how == 2 and began == 1)
            step[mark, at(kind, began, 0)], out[mark, at(kind, began, 0)] = (0 if end else 1), end

    text(TEXT)
    step[HARD, :], out[HARD, :] = 0, 1
    step[THAI, 1], out[THAI, 1] = 0, 1
    step[RESET, :] = 0
    for x, w in enumerate(WORDS):
        for y, b in enumerate(BEFORES):
            for z, n in enumerate(NEXTS):
                for v, h in enumerate(HOWS):
                    (ends if stop_ends(w, b, n, h) else text)(stop_mark(x, y, z, v))
    text(_STRONG0)
    ends(_STRONG0 + 1)
    for cited in (False, True):
        for gap in (False, True):
            for z, n in enumerate(NEXTS):
                (ends if ellipsis_ends(cited, gap, n) else text)(ellipsis_mark(cited, gap, z))
    low = _OPENERS.index("„")
    for kind, char in enumerate(_OPENERS):
        m = _BRACKET0 + _PER_KIND * kind
        both = char in KINDS[char]  # the mark " does both
        if not both:
            opens(m, kind)
            for began in (0, 1):
                for d in range(_DEPTHS[kind] - 1):
                    step[m, at(kind, began, d)] = at(kind, began, d + 1)
        for done in (0, 1):
            for z, after in enumerate(AFTERS):
                x, how = m + 1 + done * len(AFTERS) + z, closing(bool(done), after, char in '"“„«‘「『《〈')
                if both:
                    opens(x, kind)
                closes(x, kind, how)
                if char == "“":
                    closes(x, low, how)
                    y = _LOW_QUOTE + done * len(AFTERS) + z
                    opens(y, kind)
                    closes(y, low, how)
    return step, out


#: Classes of a line: blank, or closed x list marker (none, bullet, number) x
#: long x fit to be a heading; states: what the line before was.
BLANK_LINE, _LINE_PAD = 24, 26
LINES = ("start", "blank", "closed", "open", "item", "heading")


def line_mark(closed: bool, item: int, long: bool, head: bool) -> int:
    return ((closed * 3 + item) * 2 + long) * 2 + head


def line_kind(before: str, closed: bool, item: int, long: bool, head: bool) -> str:
    """The rule of a line."""
    after_open = before == "open"
    bullet = item == 1
    if item and not (after_open and closed) and (not closed or bullet or before == "item") and not (after_open and not bullet and long):
        return "item"
    if head and not closed and not after_open:
        return "heading"
    return "closed" if closed else "open"


def compile_lines() -> tuple[np.ndarray, np.ndarray]:
    """(next state, output) by line class and state; the output is 1 for an
    item and 2 for a heading. Row 25 starts a document."""
    step = np.tile(np.arange(len(LINES), dtype=np.int16), (_LINE_PAD + 1, 1))
    out = np.zeros((_LINE_PAD + 1, len(LINES)), np.int8)
    step[BLANK_LINE], step[BLANK_LINE + 1] = LINES.index("blank"), 0
    for x, before in enumerate(LINES):
        for closed in (False, True):
            for item in range(3):
                for long in (False, True):
                    for head in (False, True):
                        kind = line_kind(before, closed, item, long, head)
                        m = line_mark(closed, item, long, head)
                        step[m, x], out[m, x] = LINES.index(kind), {"item": 1, "heading": 2}.get(kind, 0)
    return step, out


STEP, OUT = compile_transducer()
LINE_STEP, LINE_OUT = compile_lines()


def scan(marks: np.ndarray, step: np.ndarray, out: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """What a transducer gives at each mark, from state 0 on. The last row of
    its table changes nothing and fills the last chunk."""
    n = len(marks)
    if not n:
        return np.zeros(0, np.int8)
    rows = -(-n // chunk)
    grid = np.full(rows * chunk, len(step) - 1, np.int64)
    grid[:n] = marks
    grid = np.ascontiguousarray(grid.reshape(rows, chunk).T)
    # Every chunk as a function from the state it is entered in to the state it ends in.
    f = np.tile(np.arange(step.shape[1], dtype=np.int64), (rows, 1))
    flat, wide = step.ravel(), step.shape[1]
    for m in grid:
        f = flat[(m * wide)[:, None] + f]
    # Inclusive prefix scan of the composition.
    d = 1
    while d < rows:
        f[d:] = np.take_along_axis(f[d:], f[:-d].astype(np.int64), axis=1)
        d *= 2
    state = np.concatenate([[0], f[:-1, 0]]).astype(np.int64)
    res = np.empty((chunk, rows), np.int8)
    for j, m in enumerate(grid):
        res[j] = out[m, state]
        state = step[m, state]
    return np.ascontiguousarray(res.T).ravel()[:n]


#: Fixed lists: abbreviations that never end a sentence, that do before a
#: number only, and that may end one, told by what follows.
NEVER = set(
    "dr prof sra sr srta mr mrs st hr nr núm num fig figs abb sect chap kap ref refs réf chr approx aprox env ca vs cf e.g i.e al ex ej éd vol pp p mitarb bzw u a z b d vgl "
    "ок рис напр проф соавт т табл см डॉ मि.ग्रा د yr eq resp incl evtl ggf sog bspw mme mlle pág dña ud гл стр c gov rev gen sgt capt col maj lt hon sen sig".split()
)
BEFORE_NUMBER = set("no nos cap art tab sec ed".split())
MAYBE = set("etc inc u.s u.k a.m p.m usw h г др д п co ltd corp jr m".split())
_MONTHS = re.compile(r"\s+(?:Januar|Februar|März|April|M\S{1,2}rz|Mai|Juni|Juli|August|September|Oktober|November|Dezember)\b")
_ORDINAL = re.compile(r"\b(?:am|vom|zum|dem|den) \d{1,2}$", re.I)
_STARTER = re.compile(r"[a-z]{1,2}[A-Z0-9]")
_CITE = re.compile(r"(?:\[\d+(?:\s?[,;–-]\s?\d+)*\]|[¹²³⁰-⁹]+)+")
_OPENING = re.compile("[(\"“„«‘\\[（「『]")
_BLANK = re.compile(r"\n[ \t]*\r?\n")
_APOSTROPHE = re.compile("[’'‘]")
_SPACE = re.compile(r"\s*")
_AFTER = re.compile(r"(?:[)\]}）］」』】〉》”»’\"�]|[   ](?:»))*")
#: Stops that end a sentence whatever follows, but a comma or a colon.
_STRONG = "!?。！？؟।॥｡\u037e։။។።"
_TERMINAL = "." + _STRONG + "…"
_SIGNS = "[" + re.escape(_TERMINAL) + r"]+(?:\s[!?]+)?|[" + re.escape("".join(_OPENERS) + _CLOSERS) + "]"
_MARK, _MARK_THAI = re.compile(_SIGNS), re.compile(_SIGNS + r"|\s+(?=\S)")
#: A bare number that touches the stop of a word: a citation too.
_BARE = re.compile(r"\d{1,3}(?:,\d{1,3})*(?=\s|$)")
_THAI_CHAR = re.compile("[฀-๿]")
_LINE = re.compile(r"\r\n|\n|\r")
_ITEM = re.compile(r"\s*(?:([-*•◦‣▪·–])|\(?\d{1,3}[.)]|\([a-z]\)|[a-z]\))[ \t ]+\S")


def _uncased(c: str) -> bool:
    return c.isalpha() and not (c.islower() or c.isupper())


def _next(text: str, k: int) -> str:
    """The class of what stands at k."""
    if k >= len(text):
        return "end"
    c = text[k]
    if c.islower():
        return "starter" if _STARTER.match(text, k) else "lower"
    if c.isupper():
        follow = text[k + 1 : k + 2]
        return "upper+" if follow.islower() or follow.isspace() or follow in "’'" else "upper"
    if c.isdigit():
        return "digit"
    if c in ",;、，；":
        return "comma"
    if c == ":" or c == "：":
        return "colon"
    if "ऀ" <= c <= "ॿ":
        return "indic"
    if "฀" <= c <= "๿":
        return "thai"
    if c.isalpha():
        return "uncased"
    if c in "([“„«‘\"¿¡「『（":
        return "opener"
    return "bullet" if c in "-•*" else "other"


def _before(text: str, i: int) -> str:
    """The class of the character before i."""
    c = text[i - 1] if i else " "
    if c.isdigit():
        return "digit"
    if c.islower():
        return "lower"
    if c.isupper():
        return "upper"
    if "ऀ" <= c <= "ॿ":
        return "indic"
    if c.isalpha():
        return "uncased"
    return "close" if c in "%)]”»’" else "other"


def _tail(text: str, low: int, i: int) -> str:
    """What stands before i without white space and opening marks."""
    parts = text[max(0, low) : i].split()
    if not parts or text[i - 1].isspace():
        return ""
    return _OPENING.split(parts[-1])[-1]


def _word(text: str, i: int, j: int, k: int) -> str:
    """The class of the word before the stop text[i:j], behind which k is the
    next place after closing marks and citations."""
    w = _tail(text, i - 40, i)
    base = _APOSTROPHE.split(w)[-1]
    if "." in base and base.lower() not in NEVER and base.lower() not in MAYBE:
        base = base.rsplit(".", 1)[-1]  # a sentence that ended without a space before
    low = base.lower()
    plain = low.lstrip("([{（")
    if plain in NEVER or (len(plain) == 1 and plain.isalpha() and plain not in MAYBE) or (len(base) == 1 and base.isupper()):
        return "never"
    if low.rstrip(".") in BEFORE_NUMBER and (low != "no" or base == "No"):
        return "before number"
    if plain in MAYBE:
        # An hour, when a time of the day stands before it, may end a sentence before a number.
        return "hour" if plain == "h" and not re.search(r"\d[.,]\d+\s*$", text[max(0, i - 14) : i - 1]) else "maybe"
    if base.isdigit() and len(base) <= 2 and (_MONTHS.match(text, j) or _ORDINAL.search(text, max(0, i - 8), i)):
        return "day"
    if "/" in w or "_" in w or "@" in w:
        return "path"
    return "word" if len(base) >= 4 and base.isalpha() and base[1:].islower() else "plain"


_N = {c: i for i, c in enumerate(NEXTS)}
_B = {c: i for i, c in enumerate(BEFORES)}
_W = {c: i for i, c in enumerate(WORDS)}


def _stop(text: str, i: int, j: int, k: int) -> int:
    """The mark of a full stop."""
    e = _SPACE.match(text, k).end()
    return stop_mark(_W[_word(text, i, j, k)], _B[_before(text, i)], _N[_next(text, e)], 2 if e > k else 1 if k > j else 0)


def _lines_of(text: str) -> tuple[list[int], list[tuple[int, int]], list[int]]:
    """The classes of the lines of a text, their places, and where the marker
    of a list item would end."""
    lines, at = [], 0
    for m in _LINE.finditer(text):
        lines.append((at, m.start()))
        at = m.end()
    lines.append((at, len(text)))
    marks, markers = [], []
    for x, (a, b) in enumerate(lines):
        line = text[a:b].strip()
        item = _ITEM.match(text, a, b) if line else None
        markers.append(item.end() if item else a)
        if not line:
            marks.append(BLANK_LINE)
            continue
        closed = line.rstrip("”»’\"」』)）]").endswith(tuple(_TERMINAL)) or _CITE.search(line[-12:]) is not None and line.endswith("]")
        head = False
        if not closed and len(line) <= 42 and x + 1 < len(lines) and len(line.split()) <= 6 and not line.endswith(("，", ",", "、", ";")):
            follow = text[lines[x + 1][0] : lines[x + 1][1]].lstrip()
            lead = line[0]
            head = (not follow or not follow[0].islower() or _STARTER.match(follow) is not None or line.endswith((":", "："))) and (lead.isupper() or _uncased(lead) or lead in "#" or lead.isdigit()) and not _thai_line(line)
        marks.append(line_mark(closed, (1 if item[1] else 2) if item else 0, len(line) > 60, head))
    return marks, lines, markers


def _breaks(kinds: list[int], marks: list[int], lines: list[tuple[int, int]], ends: list[int]) -> tuple[list[int], set[int]]:
    """Hard breaks, and the places in list markers, whose stops end nothing."""
    hard: list[int] = []
    markers: set[int] = set()
    for kind, m, (a, b), e in zip(kinds, marks, lines, ends):
        if kind:
            hard += [a, b]
        elif m == BLANK_LINE:
            hard.append(a)
        if kind == 1:
            markers.update(range(a, e))
    return hard, markers


def _thai_line(line: str) -> bool:
    return len(line) > 25 and _THAI_CHAR.search(line) is not None


def marks_of(text: str, hard: list[int], markers: set[int]) -> tuple[list[int], list[int]]:
    """The marks of a text and where a unit ends if one ends there."""
    thai = _THAI_CHAR.search(text) is not None
    syms: list[int] = []
    places: list[int] = []
    n = len(text)
    blanks: list[int] | None = None if "\n" in text else []
    found: dict[str, int] = {}

    def blank(a: int, b: int) -> bool:
        nonlocal blanks
        if blanks is None:
            blanks = [m.start() for m in _BLANK.finditer(text)]
        x = bisect_left(blanks, a)
        return x < len(blanks) and blanks[x] < b

    def ahead(c: str, j: int) -> int:
        """The first c from j that no blank line parts from it, or -1."""
        stop = found.get(c, 0)
        if stop < j:
            stop = found[c] = text.find(c, j) % (n + 1)
        return -1 if stop == n or blank(j, stop) else stop

    def behind(c: str, i: int) -> int:
        """The last c before i that no blank line parts from it, or -1."""
        prior = text.rfind(c, 0, i)
        return -1 if prior >= 0 and blank(prior, i) else prior

    last, h = 0, 0

    def gap(upto: int) -> None:
        if upto > last and not (syms and syms[-1] == TEXT) and not text[last:upto].isspace():
            syms.append(TEXT)
            places.append(upto)

    def to(p: int) -> None:
        """Hard breaks up to p, with the text before each."""
        nonlocal h, last
        while h < len(hard) and hard[h] <= p:
            if hard[h] >= last:
                gap(hard[h])
                last = max(last, hard[h])
            syms.append(HARD)
            places.append(hard[h])
            h += 1

    for m in (_MARK_THAI if thai else _MARK).finditer(text):
        i, j = m.span()
        if i < last:
            continue
        if hard:
            to(i)
        c = text[i]
        if c.isspace():
            if not thai:
                continue
            p, q = text[i - 1] if i else " ", text[j]
            word = _tail(text, i - 60, i)
            if ((_THAI_CHAR.search(word) and p not in "”»\"’)]") or (_THAI_CHAR.match(q) and (p.isalnum() or p in ")]"))) and not (q in "“\"(«" and text[max(0, i - 3) : i] == "ว่า") and q not in ")”»,.;:" and j not in markers:
                gap(i)
                last = i
                syms.append(THAI)
                places.append(i)
            continue
        if c in _TERMINAL:
            run = m[0]
            if run == ".":
                if j < n and i and text[j].isdigit() and text[i - 1].isdigit():
                    continue
                if text[j : j + 1] == " " and i not in markers:  # the usual case, without closing marks
                    syms.append(_stop(text, i, j, j))
                    places.append(j)
                    last = j
                    continue
            k = _AFTER.match(text, j).end()
            # A quote mark after white space opens; one that touches closes.
            cite = _CITE.match(text, k)
            k2 = cite.end() if cite else k
            if not cite and k2 < n and text[k2].isdigit() and i and (text[i - 1].islower() or text[i - 1] in ")”»" or run[-1] in _STRONG):
                bare = _BARE.match(text, k2)
                k2 = bare.end() if bare else k2
            e = _SPACE.match(text, k2).end()
            if any(x in _STRONG for x in run):
                mark = _STRONG0 + (not (e < n and text[e] in ",;:、，；"))
            elif len(run) > 1 or "…" in run:
                mark = ellipsis_mark(k2 > k, e > k2, _N[_next(text, e)])
            else:
                mark = _stop(text, i, j, k2) if i not in markers else TEXT
            if '"' in text[j:k]:  # whether it opens or closes only the state knows
                q = j + text[j:k].index('"')
                k2 = q if q > j else j
            syms.append(mark)
            places.append(max(k2, j))
            last = j
                # Closing marks of an open bracket come after it and are read on.
            continue
        if c in KINDS and c not in ('"', "“"):
            close = KINDS[c]
            stop = ahead(close[0], j)
            if len(close) > 1:
                stop = max(stop, ahead(close[1], j)) if stop < 0 else stop
            if stop < 0:
                continue
            gap(i)
            syms.append(_BRACKET0 + _PER_KIND * _OPENERS.index(c))
            places.append(i)
            last = j
            continue
        if i in markers:
            continue
        # A closing mark, or one of the two that do both.
        tail = _AFTER.match(text, j).end() if c != '"' else j
        cite = _CITE.match(text, tail)
        k = cite.end() if cite else tail
        e = _SPACE.match(text, k).end()
        b = i - 1
        while b > 0 and text[b].isspace():
            b -= 1
        while b > 0 and text[b] in _CLOSERS:
            b -= 1
        done = b >= 0 and (text[b] in _TERMINAL or (thai and _THAI_CHAR.match(text[b]) is not None))
        nxt = text[e] if e < n else ""
        if not nxt:
            after = 0
        elif nxt in ",;:—)、，；" or nxt in _TERMINAL or (nxt.islower() and not _STARTER.match(text, e)):
            after = 1
        elif e == k and (nxt in "とはがのを" or "가" <= nxt <= "힣"):
            after = 2
        else:
            after = 3 if e > k and nxt.isupper() else 4
        how = (len(AFTERS) if done else 0) + after
        if c in ('"', "“"):
            own = _OPENERS.index(c)
            opens = i == 0 or text[i - 1].isspace() or text[i - 1] in "([（" or (i and _uncased(text[i - 1])) or text[i - 1] in _TERMINAL
            if opens and c == "“":
                stop = ahead("”", j)
                low = behind("„", i)
                if low < 0 and stop < 0:
                    continue
            if c == '"':
                stop = ahead('"', j)
                prior = behind('"', i)
                if stop < 0 and prior < 0:
                    continue
            gap(i)
            syms.append(_BRACKET0 + _PER_KIND * own + 1 + how if c == '"' else _LOW_QUOTE + how)
            places.append(k if k > j else j)
            last = j
            continue
        kind = next(x for x, (o, cl) in enumerate(KINDS.items()) if c in cl and o != "„")
        gap(i)
        syms.append(_BRACKET0 + _PER_KIND * kind + 1 + how)
        places.append(k)
        last = j
    to(n)
    gap(n)
    return syms, places


def _spans(text: str, ends: list[int]) -> list[tuple[int, int]]:
    """(start, end) of the units of a text that end at ends."""
    out: list[tuple[int, int]] = []
    at, n = 0, len(text)
    for p in [*ends, n]:
        if p <= at:
            continue
        a, b = at, p
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if a < b:
            if out and b - a < 12 and not any(c.isalnum() for c in text[a:b]) and "\n" not in text[out[-1][1] : a]:
                out[-1] = (out[-1][0], b)  # marks alone belong to the unit before
            else:
                out.append((a, b))
        at = p
    return out


def units_of(texts: list[str]) -> list[list[tuple[int, int]]]:
    """(start, end) of the sentence units of clean texts: all lines go through
    the one transducer, then all marks through the other."""
    seen = [_lines_of(t) for t in texts]
    first = np.cumsum([1, *(len(m) + 1 for m, _, _ in seen)])
    kinds = scan(np.array([x for m, _, _ in seen for x in (BLANK_LINE + 1, *m)], np.int64), LINE_STEP, LINE_OUT)
    marks: list[int] = []
    places: list[list[int]] = []
    for t, (m, lines, ends), a in zip(texts, seen, first):
        syms, where = marks_of(t, *_breaks(kinds[a : a + len(m)].tolist(), m, lines, ends))
        marks.append(RESET)
        marks += syms
        places.append(where)
    res = scan(np.array(marks, np.int64), STEP, OUT)
    out, at = [], 0
    for t, where in zip(texts, places):
        hits = np.flatnonzero(res[at + 1 : at + 1 + len(where)]).tolist()
        at += len(where) + 1
        out.append(_spans(t, [where[i] for i in hits]))
    return out


def units(text: str | None) -> list[tuple[int, int]]:
    """(start, end) of the sentence units of a clean text."""
    return units_of([text])[0] if text and not text.isspace() else []


def units_of_stored(texts: list[str | None]) -> list[list[tuple[int, int]]]:
    """The units of texts that may be garbled, at their places as stored."""
    clean, back = [], []
    for t in texts:
        now, spans = (t or "", None) if not t or t.isascii() else restore(t)
        clean.append(now)
        back.append(spans)
    out = []
    for got, spans in zip(units_of(clean), back):
        if spans is None:
            out.append(got)
            continue
        own: list[tuple[int, int]] = []
        for a, b in got:
            lo, hi = spans[a][0], spans[b - 1][1]
            if not own or lo >= own[-1][1]:
                own.append((lo, hi))
        out.append(own)
    return out


def split(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, sent_start, sent_end) of every unit; one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                ids, s, e = [], [], []
                part = b.slice(lo, 500)
                for k, got in zip(part.column(0).to_pylist(), units_of_stored(part.column(1).to_pylist())):
                    for x, y in got:
                        ids.append(k)
                        s.append(x)
                        e.append(y)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(s, pa.int64()), pa.array(e, pa.int64())], names=["k", "sent_start", "sent_end"])

    return docs.select(F.col(key).cast("bigint").alias("k"), F.col(text).alias("t")).mapInArrow(run, "k bigint, sent_start bigint, sent_end bigint").withColumnRenamed("k", key)
