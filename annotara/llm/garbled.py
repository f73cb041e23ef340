"""Garbled text from a wrong character encoding: finding and restoring it.

Method: round-trip repair. Stretches of a text are re-encoded under candidate
legacy encodings and strictly decoded as the encoding that was meant; a stretch
is accepted when a garbling cost drops, and the text is gone over again for
nested layers. The cost is a sum over characters (controls, replacement marks,
box drawings, rare signs) and over neighbours (letters of two alphabets in one
word, a capital with an accent amid small letters, a letter next to a sign).

Defined cases: null and empty texts are clean; a text with U+FFFD lost bytes
and counts as hit though it can't be restored there; clean parts are left as
they are to the letter; ties go to the pair named first.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Drop of the cost that a stretch needs by itself, and beside one such stretch.
STRONG, WEAK = 1.45, 0.25


def _table(name: str) -> dict[str, int]:
    """Character to byte; cp1252 keeps the bytes it leaves open as controls."""
    out = {}
    for b in range(128, 256):
        try:
            c = bytes([b]).decode(name)
        except UnicodeDecodeError:
            if name not in ("cp1252", "cp1251", "cp1250"):
                continue
            c = chr(b)
        out[c] = b
    return out


#: Encodings a byte may have been read as wrongly, one byte a character.
SINGLE = {n: _table(n) for n in ("cp1252", "latin-1", "cp437", "cp850", "mac_roman", "cp1251", "koi8-r", "cp1250", "iso8859-15", "cp866")}


def _class(t: dict[str, int], lo: int, hi: int) -> str:
    return "[" + "".join(re.escape(c) for c, b in t.items() if lo <= b <= hi) + "]"


def _utf8_runs(t: dict[str, int]) -> re.Pattern[str]:
    c = _class(t, 0x80, 0xBF)
    two, three, four = _class(t, 0xC2, 0xDF) + c, _class(t, 0xE0, 0xEF) + c + "{2}", _class(t, 0xF0, 0xF4) + c + "{3}"
    return re.compile(f"(?:{two}|{three}|{four})+".replace("[]", "(?!)"))


UTF8_RUNS = {n: _utf8_runs(t) for n, t in SINGLE.items()}
#: Two-byte encodings read as one-byte ones, or UTF-8 read as a two-byte one.
DOUBLE = ("cp932", "gbk", "cp949", "big5")
#: Russian and Arabic letters from the most to the least frequent.
RUSSIAN = "оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъё"
ARABIC = "اليمنرتبوةعدسفكهقحجشصطخءذئزثضغظؤىأإآ"
#: Letters of Ukrainian that Russian lacks, and Greek and Hebrew
#: letters from the most to the least frequent.
UKRAINIAN = "іїєґ"
GREEK = "αοιετσνηυρπκμλςωόάήίέδύγχώθφβξζψ"
HEBREW = "יוהלאמרתבשנכעדקםפחגטזןסצךףץ"
_RANK = {c: i / len(RUSSIAN) for i, c in enumerate(RUSSIAN)}
_RANK.update({c: 0.3 + i / len(UKRAINIAN) / 3 for i, c in enumerate(UKRAINIAN)})
_OTHER_RANK = {c: i / len(x) for x in (GREEK, HEBREW) for i, c in enumerate(x)}
#: What words of accented letters may have been meant as.
MEANT = ("cp1251", "koi8-r", "cp1256", "cp1253", "cp1255")
CYRILLIC = ("cp1251", "koi8-r", "cp866", "iso8859-5")

_SIGNS = set("“”‘’«»„…–—•·°±µ§©®™€£¥¢№²³¹½¼¾ªº¿¡   ‚≥≤")
_RARE = set("¦¨¬¯´¸¤¶‡†ˆ˜‰‹›ƒ­×÷ÿþýðÐÝÞ˝ˇ˛˘˙≠∞∂∑∏π∫Ωƒ≈∆√◊⁄ﬁﬂ⌐₧∩≡⌠⌡∙")


@lru_cache(maxsize=100_000)
def _kind(c: str) -> tuple[str, float]:
    """(alphabet or sign class, cost of the character by itself)."""
    o = ord(c)
    if o < 0x80:
        return ("L" if c.isalpha() else "s" if c.isspace() else "d" if c.isdigit() else "p"), (6.0 if o < 32 and c not in "\n\r\t\f\v" else 0.0)
    if 0x80 <= o <= 0x9F or o == 0xFFFD:
        return "C", 6.0
    if c in _RARE and not ("a" <= c <= "z"):
        return "y", 2.0
    if c in _SIGNS or c == "µ":
        return "y", 0.5
    if 0xC0 <= o <= 0x24F:
        return ("U" if c.isupper() else "l"), (0.6 if c.isupper() else 0.3) + (4.0 if o > 0x17F else 0.0)
    if 0x370 <= o <= 0x3FF:
        return "G", 0.3
    if 0x400 <= o <= 0x4FF:
        return "R", (0.0 if c.lower() in _RANK else 2.0)
    if 0x600 <= o <= 0x6FF:
        return "A", (0.0 if 0x621 <= o <= 0x652 or c in "،؛؟٪٠١٢٣٤٥٦٧٨٩" else 3.0)
    if 0x900 <= o <= 0x97F or 0xE00 <= o <= 0xE7F:
        return "T", 0.0
    if 0x1E00 <= o <= 0x1EFF:
        return ("U" if c.isupper() else "l"), 0.4
    if 0x531 <= o <= 0x5F4 or 0x10A0 <= o <= 0x10FF:
        return "T", 0.1
    if 0xAC00 <= o <= 0xD7A3:
        return "H", 0.1
    if 0x3040 <= o <= 0x30FF:
        return "K", 0.1
    if 0x4E00 <= o <= 0x9FFF:
        return "J", 0.4
    if 0x3000 <= o <= 0x303F or 0xFF01 <= o <= 0xFF5E:
        return "P", 0.2
    if 0xFF61 <= o <= 0xFF9F or 0x3100 <= o <= 0x312F:
        return "y", 3.0
    if 0x2500 <= o <= 0x25FF:
        return "y", 5.0
    if 0x250 <= o <= 0x36F and o not in (0x300, 0x301):
        return "C", 4.0
    if 0x2000 <= o <= 0x206F or 0x300 <= o <= 0x36F:
        return "m", 0.5
    if 0x1F300 <= o <= 0x1FAFF or 0x2190 <= o <= 0x27BF or 0x2070 <= o <= 0x218F:
        return "e", 1.0
    if unicodedata.category(c) in ("Cn", "Co", "Cs"):
        return "C", 8.0
    return "y", 4.0


def cost(s: str, before: str = "", after: str = "") -> float:
    """The garbling cost of s between its neighbours."""
    total, x = 0.0, before[-1:] + s + after[:1]
    last = None
    for i, c in enumerate(x):
        k, v = _kind(c)
        if not (i == 0 and before) and not (after and i == len(x) - 1):
            total += v
        if last is not None:
            a, b = last
            pair = a + k
            if pair in ("LR", "RL", "lR", "Rl", "UR", "RU", "LG", "GL", "lG", "Gl", "UG", "GU", "RG", "GR", "RA", "AR"):
                total += 3.0
            elif pair in ("LU", "lU", "RR") and b.islower() and c.isupper():
                total += 2.0
            elif pair in ("ll", "lU", "UU", "Ul"):
                total += 0.8
            elif pair in ("Uy", "ly", "yU", "yl", "GJ", "JG", "Ry", "yR") and not (c in "’»”…“‘" or b in "«“‘’¿¡„") or pair in ("yy", "UC", "lC"):
                total += 1.0
        last = (k, c)
    return total


def _decode_utf8(s: str, t: dict[str, int]) -> str | None:
    try:
        return bytes(t[c] for c in s).decode("utf-8")
    except (UnicodeDecodeError, KeyError):
        return None


_NOT_ASCII = re.compile("[^\x00-\x7f]+")
_CLEAN = set("“”‘’«»„…–—•·°±§©®™€£¥№¿¡ ")
_BOX = re.compile("[─-▟]")


#: The inside of runs of ASCII characters: it tells nothing.
_INSIDE = re.compile("(?<=[\\x00-\\x7f])[\\x00-\\x7f]+(?=[\\x00-\\x7f])")
def _from_utf8(text: str) -> Iterator[tuple[int, int, str, float]]:
    short = _INSIDE.sub(" ", text)
    box = _BOX.search(short)
    high = sum(map(len, _NOT_ASCII.findall(short)))
    for name, pat in UTF8_RUNS.items():
        if (name == "cp866" and not box) or not pat.search(short):
            continue
        t = SINGLE[name]
        explained = 0
        for m in pat.finditer(text):
            new = _decode_utf8(m[0], t)
            if new is not None:
                a, b = m.span()
                before, after = text[a - 1 : a] if a else "", text[b : b + 1]
                # True stretches are whole: what stands next is not of the same bytes.
                torn = sum(c in t and c not in _CLEAN for c in (before, after) if c)
                drop = cost(m[0], before, after) - cost(new, before, after) + (m[0][0] == "Â") + 0.3 * (name == "cp1252") - 3.0 * torn
                drop += 1.6 * sum(c in _OLD_LETTERS for c in new)  # rare, but letters of their languages
                if name == "cp1251" and not _WORD.search(before + after):
                    drop += 0.6  # a Cyrillic letter that stands with a sign, not with its like
                explained += (b - a) * (drop >= STRONG)
                yield a, b, new, drop
        if explained > 0.6 * high and not _LATIN9.search(text):
            return


#: What ISO 8859-15 alone makes of a byte within UTF-8.
_LATIN9 = re.compile("[\x80-\xbfÀ-ôŠŒŸŽšœž][€ŠŒŸŽšœž]|[€ŠŒŸŽšœž][\x80-\xbf]")
_CJK = re.compile(r"[぀-ヿ一-鿿가-힣｡-ﾟ㄀-ㄯ　-〿！-～�Α-ω←-◿℃‥…‘’“”・·•→]{3,}")
_TELL = re.compile(r"[｡-ﾟ㄀-ㄯ縺繧繝荳蟶鍖銆鐨鏄涓鍦娴鐢鈥锛绗甯鎴缂璇å]|[一-鿿]{2}")


#: Characters that a two-byte encoding gives, where nothing of the kind stands beside.
_FAR_EAST = "぀-ヿ㄀-ㄯㄱ-ㆎ一-鿿㐀-䶿가-힣｡-ﾟ"
_FAR = re.compile(f"[{_FAR_EAST}]")
_ISLAND = re.compile(f"(?<![{_FAR_EAST}])[{_FAR_EAST}]+(?![{_FAR_EAST}])")
#: Those of them that begin with two bytes of UTF-8, in any of the encodings.
_STARTS = {c for n in DOUBLE for c in map(chr, (*range(0x3040, 0x3190), *range(0x3400, 0xD7A4), *range(0xFF61, 0xFFA0))) if re.match(rb"[\xc2-\xf4][\x80-\xbf]|[\xc2-\xf4]$", c.encode(n, "ignore"))}
#: What may have been meant there: letters of western alphabets and signs.
_WESTERN_TEXT = re.compile("[\x09-\x7eÀ-ɏͰ-ϿЀ-ӿ\u2000-\u206f" + re.escape("".join(_SIGNS)) + "]+")


def _islands(text: str) -> Iterator[tuple[int, int, str, float]]:
    """UTF-8 of western text read as a two-byte encoding: few characters amid
    letters of another script. Beside them, no others of theirs may stand."""
    found = list(_ISLAND.finditer(text)) if _FAR.search(_INSIDE.sub(" ", text)) else []
    if not any(m[0][0] in _STARTS for m in found):
        return
    for name in DOUBLE:
        got, foreign = [], []
        for m in found:
            new = None
            try:
                if m[0][0] not in _STARTS:
                    raise UnicodeError
                raw = m[0].encode(name)
                new = raw.decode("utf-8")
            except UnicodeError:
                pass
            if new is not None and not new.isascii() and _WESTERN_TEXT.fullmatch(new):
                got.append((m.start(), m.end(), new))
            else:
                foreign += m.span()
        for a, b, new in got:
            x = bisect_left(foreign, a)
            near = min(a - foreign[x - 1] if x else len(text), foreign[x] - b if x < len(foreign) else len(text))
            before, after = text[a - 1 : a] if a else " ", text[b : b + 1] or " "
            letters = (before.isalpha() and before < "\u0250") + (after.isalpha() and after < "\u0250")
            # Within a word, or at an end of one that a sign or a digit touches.
            if near > 16:
                yield a, b, new, 1.0 * (b - a) + 1.2 * letters + 0.6 * (before.isdigit() or after.isdigit())


#: Letters of two alphabets that are also what wrong decoding often gives.
_OLD_LETTERS = set("ÞþÐðÝý")
#: Mac Roman read as a western encoding, one sign at a time: quotation marks
#: round a phrase, a letter that is a word, a bullet at the head of a line.
_MAC = re.compile("(?<![^\\s(])Ò(?=\\w)[^ÒÓ\n]*?(?<=[a-zß-ÿ\\d.,;!?…])Ó(?=[\\s.,;:)!?]|$)|(?:(?<=\\s)|^)[ˆ˜](?=\\s)|(?:(?<=\n)|^)¥(?=[ \\t]+[^\\W\\d])")


def _has_mac(text: str) -> bool:
    return any(c in text for c in "Óˆ˜¥") and _MAC.search(text) is not None


def _mac_signs(text: str) -> Iterator[tuple[int, int, str, float]]:
    if not _has_mac(text):
        return
    for m in _MAC.finditer(text):
        for i in (m.start(), m.end() - 1) if len(m[0]) > 1 else (m.start(),):
            yield i, i + 1, bytes([SINGLE["cp1252"][text[i]]]).decode("mac_roman"), 2.0


#: One character of a two-byte encoding as a control and another character,
#: beside the script it belongs to, and two or three of Thai amid Thai text.
_LONE_PAIR = re.compile("[\x80-\x9f][\x40-\x7e\x80-\xff]")
_THAI_BIT = re.compile("(?<=\\w)(?=[¡-û]*[¡-¿])[¡-Úßàáâãäåæçèéêëìíîïðñòóôõö÷øùúû]{2,3}(?=\\w)")


def _bits(text: str) -> Iterator[tuple[int, int, str, float]]:
    if _EAST.search(text):
        for m in _LONE_PAIR.finditer(text):
            try:
                new = m[0].encode("latin-1").decode("cp932")
            except UnicodeDecodeError:
                continue
            if len(new) == 1 and _kind(new)[0] in "JK" and _EAST.search(text[max(0, m.start() - 8) : m.start()] + text[m.end() : m.end() + 8]):
                yield *m.span(), new, 3.0
    if _THAI.search(text):
        for m in _THAI_BIT.finditer(text):
            new = m[0].encode("latin-1").decode("cp874", "replace")
            if _THAI_WORD.fullmatch(new):
                yield *m.span(), new, 2.0


_THAI_WORD = re.compile("(?:[เ-ไ]?[ก-ฮ][ัิ-ฺ็-๎]*[ะาำๅ]?)+")
#: UTF-8, but for two bytes at either end.
_UTF8_BODY = re.compile(rb"(?s).{0,2}(?:[\x00-\x7f]|[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3})+.{0,2}")


def _from_double(text: str) -> Iterator[tuple[int, int, str, float]]:
    """UTF-8 that was read as a two-byte encoding."""
    if not _TELL.search(text):
        return
    for m in _CJK.finditer(text):
        for name in DOUBLE:
            s, at = m[0], m.start()
            # Split where a character has no place in the encoding.
            for p in re.finditer(r"[^�]+", s):
                try:
                    if len(p[0]) > 12 and not _UTF8_BODY.fullmatch(p[0][:8].encode(name)):
                        continue
                    raw = p[0].encode(name)
                except UnicodeEncodeError:
                    continue
                if not _UTF8_BODY.fullmatch(raw):
                    continue
                # The first and last bytes may belong to lost characters.
                for lead in range(3):
                    for tail in range(3):
                        body = raw[lead : len(raw) - tail]
                        if len(body) < 6:
                            continue
                        try:
                            new = body.decode("utf-8")
                        except UnicodeDecodeError:
                            continue
                        if sum(_kind(c)[0] in "JKHPTARG" for c in new) * 2 < len(new):
                            continue
                        old = p[0]
                        yield at + p.start(), at + p.end(), new, cost(old) - cost(new) + 0.6 * len(old)
                        break
                    else:
                        continue
                    break


def _two_bytes(text: str, name: str, t: dict[str, int]) -> list[tuple[int, int, str, float]]:
    """Runs that decode as a two-byte encoding which was read one byte a
    character; the last field is how many of them are common characters."""
    out = []
    n, i = len(text), 0
    while i < n:
        if text[i] not in t:
            i += 1
            continue
        j, new, good = i, [], 0.0
        while j < n and text[j] in t:
            b1 = t[text[j]]
            if name == "cp932" and 0xA1 <= b1 <= 0xDF:
                break
            b2 = t.get(text[j + 1]) if j + 1 < n else None
            if b2 is None and j + 1 < n and name != "euc_jp" and 0x40 <= ord(text[j + 1]) < 0x7F:
                b2 = ord(text[j + 1])
            if b2 is None:
                break
            try:
                c = bytes([b1, b2]).decode(name)
            except UnicodeDecodeError:
                break
            if len(c) != 1:
                break
            k = _kind(c)[0]
            if k == "K":
                good += 2.0
            elif k == "P" or c in "、。？！：（）「」“”…":
                good += 1.0
            elif name == "cp949":
                good += 1.0 if k == "H" else -2.0
            elif name == "gbk":
                good += 0.95 if 0xB0 <= b1 <= 0xD7 and b2 >= 0xA1 else -0.6
            elif name == "euc_jp":
                good += 0.9 if 0xB0 <= b1 <= 0xCF else -0.6
            elif name == "cp932":
                good += 0.9 if 0x88 <= b1 <= 0x97 else -0.6
            else:
                good += 0.85 if 0xA4 <= b1 <= 0xC6 and k == "J" else -0.6
            new.append(c)
            j += 2
        if new:
            out.append((i, j, "".join(new), good))
            i = j
        else:
            i += 1
    return out


#: Two characters of _two_bytes next to each other. A run _pairs takes is three
#: quarters high, so of its pairs one is all high, and so is half of the next.
_HIGH_BYTE = "[" + "".join(re.escape(c) for c in sorted({*SINGLE["cp1252"], *SINGLE["latin-1"]})) + "]"
_TWO_PAIRS = re.compile(f"{_HIGH_BYTE}{{3}}(?:{_HIGH_BYTE}|[@-~])|{_HIGH_BYTE}[@-~]{_HIGH_BYTE}{{2}}")


def _pairs(text: str) -> Iterator[tuple[int, int, str, float]]:
    """Two-byte encodings read one byte a character: the best of them per text."""
    best: tuple[float, list] = (0.0, [])
    if not _TWO_PAIRS.search(text):
        return
    for wrong in ("cp1252", "latin-1"):
        t = SINGLE[wrong]
        for name in ("euc_jp", "cp932", "cp949", "gbk", "big5"):
            runs = [r for r in _two_bytes(text, name, t) if r[3] > 0.6 * len(r[2]) and sum(c in t for c in text[r[0] : r[1]]) * 4 >= (r[1] - r[0]) * 3 - 1]
            total = sum(r[3] for r in runs if len(r[2]) > 1)
            if total > best[0]:
                best = (total, runs)
    for i, j, new, _ in best[1]:
        drop = cost(text[i:j], text[max(i - 1, 0) : i], text[j : j + 1]) - 0.1 * len(new)
        yield i, j, new, (drop if len(new) > 1 and drop >= STRONG + 0.5 else min(drop, 1.0))


_EAST = re.compile("[぀-ヿ一-鿿가-힣]")
_THAI_RUN = re.compile("[¡-Úßàáâãäåæçèéêëìíîïðñòóôõö÷øùúû]{4,}")


def _thai(text: str) -> Iterator[tuple[int, int, str, float]]:
    """Thai (TIS-620) read as a western encoding: its marks follow consonants."""
    for m in _THAI_RUN.finditer(text):
        try:
            new = m[0].encode("latin-1").decode("cp874")
        except UnicodeDecodeError:
            continue
        marks = [i for i, c in enumerate(new) if "ั" == c or "ิ" <= c <= "ฺ" or "็" <= c <= "๎"]
        fine = sum(i > 0 and ("ก" <= new[i - 1] <= "ฮ" or "ั" <= new[i - 1] <= "ู") for i in marks)
        if fine >= 0.9 * len(marks) and (len(marks) * 8 >= len(new) or "\u0e01" <= max(text[: m.start()] + text[m.end() :], default="") <= "\u0e5b") and "ก" <= new[-1]:
            yield (*m.span(), new, 0.8 * len(new))


def _letters(text: str, wrong: str, meant: str, run: re.Pattern[str]) -> Iterator[tuple[int, int, str, float]]:
    """A one-byte encoding read as another: words of accented letters or signs."""
    t = SINGLE[wrong]
    for m in run.finditer(text):
        if any(ord(c) >= 0x80 and c not in t for c in m[0]):
            continue
        try:
            new = b"".join(bytes([t[c]]) if ord(c) >= 0x80 else c.encode() for c in m[0]).decode(meant)
        except UnicodeDecodeError:
            continue
        a, b = m.span()
        yield a, b, new, cost(m[0], text[max(a - 1, 0) : a], text[b : b + 1]) - cost(new, text[max(a - 1, 0) : a], text[b : b + 1]) - _rank(new)


_HIGH = re.compile("[¡-ÿ]")
_BESIDE = re.compile("[\u0080-ÿ‚„…†‡ˆ‰Š‹Œ‘’“”•–—˜™š›œžŸ]{2}|[\u0080-\u009f]")
_THAI = re.compile("[ก-๛]")
_HIGH_LETTERS = re.compile("[À-ÿ]+")
#: Two letters of _ACCENTED in a row: without them no word of _words counts.
_ROW = re.compile("[À-ÿ¨¸]{2}")


def _wordy(text: str) -> bool:
    """Whether words of accented letters are what most of them lie in, or one
    has no others."""
    if not _ROW.search(text):
        return False
    rows = sum(len(m) for m in _ACCENTED.findall(text) if len(m) > 1)
    return rows > 0.5 * max(1, sum(map(len, _HIGH_LETTERS.findall(text)))) or _LONE_WORD.search(text) is not None


def _words(text: str) -> list[tuple[int, int, str, float]]:
    """Russian or Arabic read as western: most accented letters must lie in
    words that look like the language, else it is something else."""
    best: tuple[float, list] = (0.5, [])
    if not _ROW.search(text):
        return []
    whole = max(1, sum(map(len, _HIGH_LETTERS.findall(text))))
    rows = sum(len(m) for m in _ACCENTED.findall(text) if len(m) > 1)
    for meant in MEANT if rows > 0.5 * whole else ():
        got = list(_letters(text, "cp1252", meant, _ACCENTED))
        fine = sum(b - a for a, b, new, _ in got if b - a > 1 and _rank(new) <= 0.42 * (b - a)) / whole
        if fine > best[0]:
            best = (fine, got)
    if best[1]:
        return best[1]
    # Amid other languages: a word of nothing but accented letters is none of theirs.
    lone: dict[tuple[int, int], tuple[float, str]] = {}
    for meant in MEANT if _LONE_WORD.search(text) else ():
        for a, b, new, _ in _letters(text, "cp1252", meant, _LONE_WORD):
            r = _rank(new) / (b - a)
            if new.isalpha() and min(new) > "\u024f" and r < min(0.42, lone.get((a, b), (1.0, ""))[0]):
                lone[a, b] = (r, new)
    return [(a, b, new, 2.0) for (a, b), (_, new) in lone.items()]


_LONE_WORD = re.compile(r"(?<![^\W\d])[À-ÿ]{4,}(?![^\W\d])")


def _rank(s: str) -> float:
    """How unlike Russian the Cyrillic letters of s are: letters and case."""
    total = 0.0
    for i, c in enumerate(s):
        low = c.lower()
        if "ء" <= c <= "ي":
            total += max(0, ARABIC.find(c)) / len(ARABIC)
        elif low in _OTHER_RANK:
            total += _OTHER_RANK[low] + (0.12 if c != low else 0.0) + (0.5 if i and c != low and s[i - 1].islower() else 0.0)
        elif low in _RANK:
            total += _RANK[low] + (0.12 if c != low else 0.0)
            if i and c != low and s[i - 1].islower() and s[i - 1].lower() in _RANK:
                total += 1.0
            elif i and c != low and i == 1 and s[0].islower():
                total += 1.0
        elif "\u0370" <= c < "\u2000":
            total += 0.7  # not a letter of these, or a mark by itself
    return total


_ACCENTED = re.compile("[À-ÿ¨¸]+")
_CYR = re.compile("[Ѐ-џҐґ]+(?:[ ,.;:\\d]+[Ѐ-џҐґ]+)*")
_WORD = re.compile("[Ѐ-џҐґ]+")
#: Reading one Cyrillic encoding as another swaps the case or leaves rare letters.
_SHIFTED = re.compile("[а-яё][А-ЯЁ]|[А-ЯЁ]{2}|[Ѐ-ЏЂђѓ-џҐґ]")


def _cyrillic(text: str) -> Iterator[tuple[int, int, str, float]]:
    """One Cyrillic encoding read as another, told by letters and case."""
    for m in _CYR.finditer(text):
        if not _SHIFTED.search(m[0]):
            continue
        for wrong in ("cp1251", "koi8-r"):
            for meant in CYRILLIC:
                if wrong == meant:
                    continue
                drop, parts = 0.0, []
                best, first, last = 0.0, None, None
                for w in _WORD.finditer(m[0]):
                    try:
                        new = w[0].encode(wrong).decode(meant)
                    except UnicodeError:
                        parts.append(None)
                        continue
                    d = _rank(w[0]) - _rank(new) + cost(w[0]) - cost(new)
                    parts.append((w.start(), w.end(), new, d))
                # The stretch of words with the largest total drop.
                run: list = []
                for p in [*parts, None]:
                    if p is None or drop + p[3] < 0:
                        drop, run = 0.0, []
                        continue
                    run.append(p)
                    drop += p[3]
                    if drop > best:
                        best, first, last = drop, run[0][0], (list(run), p[1])
                if last and best >= 2.5 and sum(len(p[2]) for p in last[0]) >= 6:
                    out, at = [], first
                    for s, e, new, _ in last[0]:
                        out += [m[0][at:s], new]
                        at = e
                    yield m.start() + first, m.start() + last[1], "".join(out), best


#: Western text read as another one-byte encoding: letters inside words only.
WESTERN = (("cp1252", "mac_roman"), ("cp1252", "cp850"), ("mac_roman", "cp1252"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("cp1251", "cp1252"), ("koi8-r", "cp1252"))
_OUTSIDE = re.compile("(?:(?<=[\\s.,;:?!(])|^)[À-ÿ](?=\\S|\\s)|(?<=[.?!\\w])[À-ÿ](?=[\\s,.;:)]|$)")
WESTERN_RUNS = {w: re.compile("(?<=[A-Za-z])[" + "".join(re.escape(c) for c in SINGLE[w] if _kind(c)[0] != "l" and c not in "’”“»«…–—") + "]{1,2}(?=[A-Za-z])") for w, _ in WESTERN}


#: What the candidates ask for, but for UTF-8 read as cp866 or as a two-byte encoding.
_ODD = re.compile("|".join([*(p.pattern[:-1] for n, p in UTF8_RUNS.items() if n != "cp866"), _TWO_PAIRS.pattern, *(p.pattern for p in WESTERN_RUNS.values()), _SHIFTED.pattern, _LONE_PAIR.pattern, _THAI_BIT.pattern]))


#: What each of them holds: two characters of one-byte encodings in a row, or a
#: sign of theirs amid Latin letters.
_BYTES = "[" + "".join(re.escape(c) for c in sorted({c for t in SINGLE.values() for c in t})) + "]"
_SIGN_BYTES = "[" + "".join(re.escape(c) for c in sorted({c for t in SINGLE.values() for c in t if _kind(c)[0] != "l" and c not in "’”“»«…–—"})) + "]"
_MAYBE = re.compile(f"{_BYTES}{{2}}|[A-Za-z]{_SIGN_BYTES}|[\x80-\xff][\x40-\x7e]|{_SHIFTED.pattern}")


def suspicious(text: str) -> bool:
    """A quick look, by the patterns of the candidates themselves: False only
    where _candidates finds nothing STRONG."""
    short = _INSIDE.sub(" ", text)
    if _MAYBE.search(short) and (_ODD.search(short) or _wordy(short)) or _BOX.search(short) and UTF8_RUNS["cp866"].search(short) or _has_mac(text):
        return True
    return any(c[3] >= STRONG for f in (_islands, _from_double) for c in f(text))


def _candidates(text: str, utf8: list[tuple[int, int, str, float]] | None = None) -> list[tuple[int, int, str, float]]:
    """(start, end, what was meant, drop of the cost); utf8 may be given."""
    out = list(_from_utf8(text)) if utf8 is None else utf8
    covered = sum(b - a for a, b, _, d in out if d >= STRONG)
    short = _INSIDE.sub(" ", text)
    out = [(a, b, new, d + 1000.0 * (d >= STRONG)) for a, b, new, d in out]
    if _CJK.search(short):
        out += _from_double(text)
    out += _islands(text)
    out += _mac_signs(text)
    out += _bits(text)
    if _BESIDE.search(short) and covered < 0.5 * len(_HIGH.findall(text)):
        high = len(_HIGH.findall(text))
        other = [] if _EAST.search(text) else list(_thai(text))
        if sum(b - a for a, b, _, _ in other) < 0.7 * high:
            other = (_words(text) if high else []) or ([] if _THAI.search(text) else list(_pairs(text)))
        # What one reading explains at large beats what another finds by chance.
        if sum(b - a for a, b, _, d in other if d >= STRONG) > 1.5 * covered:
            out = [c for c in out if c[1] - c[0] >= 9]
            return [*out, *other]
        out += [c for c in other if covered == 0 or c[3] >= STRONG]
    for wrong, meant in WESTERN:
        run = WESTERN_RUNS[wrong]
        if run.search(short):
            got = list(_letters(text, wrong, meant, run))
            out += got
            if wrong == "cp1252" and sum(c[3] >= STRONG for c in got) > 1:
                # Signs of the same encoding that stand outside words.
                for m in _OUTSIDE.finditer(text):
                    new = bytes([SINGLE[wrong][m[0]]]).decode(meant, "replace")
                    if new in _CLEAN or new.isalpha() and m[0] in "ËåçƒžÌ":
                        out.append((*m.span(), new, WEAK + 0.01))
    if _WORD.search(text):
        out += _cyrillic(text)
    return out


def _widths(old: str, new: str) -> list[int]:
    """How many characters of old each character of new stands for."""
    sizes = [len(c.encode("utf-8", "surrogatepass")) for c in new]
    if sum(sizes) == len(old):
        return sizes
    if 2 * len(new) == len(old):
        return [2] * len(new)
    n, w = len(new), len(old)
    return [(k + 1) * w // n - k * w // n for k in range(n)]


def restore(text: str) -> tuple[str, list[tuple[int, int]] | None]:
    """The restored text and, for each of its characters, the place (start,
    end) of what it stands for in text; None where nothing was changed."""
    now = text
    spans: list[tuple[int, int]] | None = None
    if not suspicious(text):
        return now, spans
    seen = set()
    while now not in seen and suspicious(now):  # a text met again would go round for ever
        seen.add(now)
        cands = _candidates(now)
        if not any(c[3] >= STRONG for c in cands):
            break
        # Beside a strong stretch weaker ones count too.
        used = bytearray(len(now))
        chosen = []
        for a, b, new, _ in sorted((c for c in cands if c[3] >= WEAK and c[2]), key=lambda c: (-c[3], c[0])):
            if not any(used[a:b]):
                used[a:b] = b"\1" * (b - a)
                chosen.append((a, b, new))
        chosen.sort()
        if spans is None:
            spans = [(i, i + 1) for i in range(len(now))]
        out, marks, at = [], [], 0
        for a, b, new in chosen:
            out += [now[at:a], new]
            marks += spans[at:a]
            lo = a
            for w in _widths(now[a:b], new):
                hi = min(max(lo + w, lo + 1), b)
                lo = min(lo, b - 1)
                marks.append((spans[lo][0], spans[max(hi, lo + 1) - 1][1]))
                lo = hi
            at = b
        out.append(now[at:])
        marks += spans[at:]
        now, spans = "".join(out), marks
    return now, spans


def repair(text: str | None) -> tuple[str | None, bool]:
    """(restored text, whether the text held a garbled stretch)."""
    if not text or text.isascii():
        return text, False
    now, spans = restore(text)
    return now, spans is not None or "�" in text


def is_hit(text: str | None) -> bool:
    """Whether a text holds a garbled stretch (no restoring, so less work)."""
    if not text or text.isascii():
        return False
    if "�" in text:
        return True
    if not suspicious(text):
        return False
    utf8 = list(_from_utf8(text))
    return any(c[3] >= STRONG for c in utf8) or any(c[3] >= STRONG for c in _candidates(text, utf8))


def found(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key) of the rows that hold a garbled stretch; one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([k for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if is_hit(t)], pa.int64())], names=["k"])

    wide = rows.filter(F.col(text).rlike("[^\\x00-\\x7f]"))
    return wide.select(F.col(key).cast("bigint").alias("k"), F.col(text).alias("t")).mapInArrow(run, "k bigint").withColumnRenamed("k", key)


def restored(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, restored, whole) of the rows that hold a garbled stretch; whole is
    false where bytes were lost, so that what stands there can't be had back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [(k, r[0]) for k, r in ((k, repair(t)) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())) if r[1]]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in got], pa.int64()), pa.array([r for _, r in got], pa.string()), pa.array(["\ufffd" not in r for _, r in got], pa.bool_())], names=["k", "restored", "whole"])

    wide = rows.filter(F.col(text).rlike("[^\\x00-\\x7f]"))
    return wide.select(F.col(key).cast("bigint").alias("k"), F.col(text).alias("t")).mapInArrow(run, "k bigint, restored string, whole boolean").withColumnRenamed("k", key)
