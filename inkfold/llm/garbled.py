"""Problem 10: text read in another encoding than it was written in.

For each pair of a true and a wrong encoding, the garbled sequences of the alphabets are computed in advance. One
multi-pattern automaton finds them in one pass over a line and so names the pairs that may have made it. Under each
named pair the line is read back byte by byte, which gives the spans that are whole garbled sequences of that pair;
the pair that explains most of the line is taken off, and only its spans are put back. This repeats until nothing is
garbled, so text garbled any number of times, by one pair or by several, is restored layer by layer: each layer of a
multi-byte encoding makes the line shorter, and a single-byte pair is taken off at most once.

Forms that could stand in correct text count only in company: forms of letters alone when two of them touch or the
text proves their pair, letters that turn into single letters when a run of them is no word of their own script, signs
when they stand inside a word. A replacement character marks text whose bytes are lost; what stands around it is
restored. Garbled characters that were then written as numeric entities are read as the characters. A text need not be
UTF-8 at all: lines in other bytes are read byte by byte and so become garbled lines like others.
"""

from __future__ import annotations

import codecs
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Letters beyond ASCII of some languages, the signs that writers' tools put into texts, encodings.
LATIN = "äöüßéèêëàâçîïôûùœæñáíóúãõąćęłńśźż"
CYRILLIC = "абвгдежзийклмнопрстуфхцчшщъыьэюяё"
SIGNS = "“”‘’‚„–—…•·€£§©®™°«»¿¡ºª²³½×  ☆★✓→‍️"
WESTERN = ("cp1252", "latin-1", "iso8859-15", "cp1254", "mac_roman", "cp850", "cp437")
CENTRAL = ("cp1250", "iso8859-2", "cp852", "cp1257")
SLAVIC = ("cp1251", "koi8-r", "cp866", "iso8859-5", "mac_cyrillic")
SINGLE = (*WESTERN[:4], *CENTRAL[:2], *WESTERN[4:], *CENTRAL[2:], *SLAVIC)
WIDE = ("cp932", "euc_jp")
LETTERS = {"de": "äöüß", "fr": "éèêëàâçîïôûùœæ", "es": "ñáéíóúü", "pt": "ãõáâàçéêíóôú", "pl": "ąćęłńóśźż"}
WORDS = {
    "de": "der die das und ist nicht mit wir den dem von bis ein eine auf im zu",
    "fr": "le la les de du des et est nous avec pour dans pas au un une que",
    "es": "el la los las de del y que en con se por para una no sin ya",
    "pt": "o a os as de da do e que em com para uma no na um foi",
    "pl": "i w z na do nie jest to od dla czy po przed jak za tylko",
}
RUSSIAN = "оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъё"  # from the most to the least frequent
LOOKALIKE = set("аеорсухіѕјАВЕКМНОРСТУХοαυνρικ")  # letters that look Latin prove no encoding
INNER = set("‚„¤¢£¥¡¿¹²³ºª¼½¾±¶§¨´¸¯¬¦‡†ˆ‰‹›«»™®©°µ×÷˜")  # signs that no correct word has inside
MARK = "�"
ENTITY = re.compile(r"&#(?:[xX]([0-9A-Fa-f]{2,6})|(\d{3,7}));")

_CLEAN = set(LATIN + LATIN.upper() + CYRILLIC + CYRILLIC.upper() + "–—’“”")
_SEQUENCE = r"[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xef][\x80-\xbf]{2}|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}"
_WHOLE = re.compile(_SEQUENCE)
_NONE, _LOST = "Ā", "ā"  # stand for a character without bytes and for lost bytes
_TOKENS = re.compile(rf"(?P<seq>{_SEQUENCE})|(?P<lost>(?:[\xc2-\xf4][\x80-\xbf]{{0,2}})?{_LOST}[\x80-\xbf]{{0,2}})|(?P<plain>[\x00-\x7f])|(?P<other>.)", re.S)
_LETTER = re.compile(r"[^\x00-\x7f]")
_FOREIGN = re.compile(r"[^\x00-\x7f]+")


def read(data: bytes, wrong: str) -> str:
    """Bytes read in a wrong encoding; bytes that it leaves undefined come out as controls, as browsers read them."""
    if wrong in WIDE:
        return data.decode(wrong, "replace")
    return "".join(upper(wrong)[b - 128] if b > 127 else chr(b) for b in data)


@lru_cache(None)
def upper(wrong: str) -> tuple[str, ...]:
    """The characters of the upper half of a single-byte encoding."""
    out = []
    for b in range(128, 256):
        try:
            out.append(bytes([b]).decode(wrong))
        except UnicodeDecodeError:
            out.append(chr(b))
    return tuple(out)


def _stray(e: UnicodeDecodeError) -> tuple[str, int]:
    """A stray byte of a UTF-8 line as cp1252 reads it; a sequence that lost bytes as one replacement character."""
    lost = e.end - e.start > 1 or e.end == len(e.object)
    return MARK if lost else read(e.object[e.start : e.end], "cp1252"), e.end


codecs.register_error("inkfold-stray", _stray)
_NO_ENDS = "ÂÃÐÑâð".encode("cp1252")  # first bytes of sequences whose letters end hardly any word


def decoded(data: bytes) -> tuple[str, bool]:
    """What the bytes of a text stand for, and whether any of them are no UTF-8.

    A line with more such bytes than whole sequences was written in another encoding and is read as cp1252, from which
    ``restore`` finds the encoding. A text that is cut within its last sequence ends in a replacement character.
    """
    try:
        return data.decode(), False
    except UnicodeDecodeError as e:
        head = data[: e.start]
        if e.reason == "unexpected end of data" and (e.end - e.start > 1 or not head.isascii() or data[e.start] in _NO_ENDS):
            return head.decode() + MARK, True
    lines = []
    for line in data.split(b"\n"):
        text = line.decode("utf-8", "replace")
        bad = text.count(MARK) - line.count(MARK.encode())
        lines.append(read(line, "cp1252") if 2 * bad > sum(c > "\x7f" for c in text) else line.decode("utf-8", "inkfold-stray"))
    return "\n".join(lines), True


@lru_cache(None)
def to_bytes(wrong: str) -> dict[int, str]:
    """A table for ``translate``: each character as the byte that was read as it, at the same place of the text."""
    table = {c: _NONE for c in range(128, 256)}
    table.update({ord(c): chr(128 + i) for i, c in enumerate(upper(wrong))})
    return table


@lru_cache(None)
def letter_map(true: str, wrong: str) -> dict[str, str]:
    """Garbled letters of a pair of single-byte encodings and what they were."""
    small = CYRILLIC if true in SLAVIC else LATIN
    out = {}
    for c in small + small.upper().replace("SS", "") + "“”‘’–—…•€":
        try:
            g = read(c.encode(true), wrong)
        except UnicodeEncodeError:
            continue
        if not g.isascii() and (g != c or (true in SLAVIC and wrong in SLAVIC)):
            out[g] = c
    return out


SINGLE_PAIRS = tuple((e, w) for e in (*WESTERN, *CENTRAL, *SLAVIC) for w in SINGLE if e != w and any(g != c for g, c in letter_map(e, w).items()))
#: Among pairs that explain as much, the earlier ones are the more usual.
PAIRS = (*(("utf-8", w) for w in (*SINGLE, *WIDE)), *((e, w) for e in WIDE for w in SINGLE), ("euc_jp", "cp932"), *SINGLE_PAIRS)
_PLACE = {p: i for i, p in enumerate(PAIRS)}


@lru_cache(None)
def original(seq: str) -> str | None:
    """What a whole UTF-8 sequence, one character a byte, stands for; None where no text would hold it."""
    c = seq.encode("latin-1").decode("utf-8", "ignore")
    if not c:
        return None
    o = ord(c)
    if o in (0xFFFD, 0xFEFF, 0xF8FF) or 0xF8F0 <= o <= 0xF8F3:
        return c
    return c if unicodedata.category(c) not in ("Cn", "Co", "Cs") and (o < 0x530 or 0x1E00 <= o < 0x3100 or 0x3100 <= o < 0xA000 or 0xAC00 <= o < 0xD7A4 or 0xF900 <= o < 0xFB10 or 0xFE00 <= o < 0x10000 or 0x1F000 <= o < 0x1FB00 or 0x20000 <= o < 0x2A6E0 or 0x1D400 <= o < 0x1D800) else None


@lru_cache(1)
def automaton() -> ahocorasick.Automaton:
    """Garbled sequences of all pairs; a pattern's value is the places in ``PAIRS`` of the pairs that make it.

    Of a UTF-8 sequence of three or four bytes the garbled form of all but the last byte is a pattern. Pairs of letters
    stand for Cyrillic read in single bytes, single letters for Latin, and three bytes for Japanese.
    """
    found: dict[str, set[int]] = {}

    def add(pattern: str, pair: tuple[str, str]) -> None:
        if pattern and not pattern.isascii():
            found.setdefault(pattern, set()).add(_PLACE[pair])

    heads = [bytes([a, b]) for a in range(0xC2, 0xF0) for b in range(0x80, 0xC0)] + [bytes([0xF0, a, b]) for a in range(0x90, 0xC0) for b in range(0x80, 0xC0)]
    for wrong in SINGLE:
        for head in heads:
            add(read(head, wrong), ("utf-8", wrong))
    for head in (h for h in heads if h[0] in range(0xE3, 0xEA)):
        for wrong in WIDE:
            form = head.decode(wrong, "ignore")
            if len(form) == 1:
                add(form, ("utf-8", wrong))
    for true, rows in (("cp932", ((0x82, 0x9F, 0xF2), (0x83, 0x40, 0x97))), ("euc_jp", ((0xA4, 0xA1, 0xF4), (0xA5, 0xA1, 0xF7)))):
        for lead, a, b in rows:
            for x in range(a, b):
                for wrong in (*SINGLE, *(("cp932",) if true == "euc_jp" else ())):
                    add(read(bytes([lead, x, lead]), wrong), (true, wrong))
    for true, wrong in SINGLE_PAIRS:
        back = letter_map(true, wrong)
        if true in SLAVIC:
            small = [g for g, c in back.items() if c.islower()]
            for g in back:
                for h in small:
                    add(g + h, (true, wrong))
        else:
            for g in back:
                add(g, (true, wrong))
    names: dict[frozenset[int], tuple[int, ...]] = {}
    out = ahocorasick.Automaton()
    for pattern, pairs in found.items():
        out.add_word(pattern, names.setdefault(frozenset(pairs), tuple(sorted(pairs))))
    out.make_automaton()
    return out


def named(line: str) -> set[tuple[str, str]]:
    """The pairs of which the automaton meets a garbled sequence in the line."""
    met = {pairs for _, pairs in automaton().iter(line)}
    return {PAIRS[i] for i in set().union(*met)}


Span = tuple[int, int, str]  # start, end, what stood there


def utf8_spans(line: str, wrong: str, sure: bool) -> list[Span]:
    """Whole UTF-8 sequences read in single bytes. Forms of letters alone count where two touch or the pair is sure."""
    strong, letters, few, controls = [], [], [], []
    for m in _WHOLE.finditer(line.translate(to_bytes(wrong))):
        c = original(m.group())
        if c is None:
            continue
        form = line[m.start() : m.end()]
        span = (m.start(), m.end(), c)
        if c < "\xa0" and upper(wrong)[ord(c) - 128] != c:
            controls.append(span)  # a control of an earlier layer
        elif not all(x in _CLEAN for x in form):
            strong.append(span)
        elif len(form) == 2:
            letters.append(span)
        elif c in SIGNS:
            strong.append(span)
        elif c < "\u2190" or c >= "\u2c00":
            few.append(span)  # letters alone that would be one sign of another script
    if letters and not (sure or strong):
        ends = {b for _, b, _ in letters}
        starts = {a for a, _, _ in letters}
        letters = [s for s in letters if s[0] in ends or s[1] in starts]
    if strong:
        covered = {i for a, b, _ in strong + letters + few for i in range(a, b)}
        # no part of a word whose other letters are in no sequence
        letters += [s for s in few if all(i in covered or not 0 <= i < len(line) or line[i] not in _CLEAN for i in (s[0] - 1, s[1]))]
        letters += controls
    return sorted(strong + letters)


def _japanese(c: str) -> bool:
    return "　" <= c <= "ヿ" or "一" <= c <= "鿿" or "＀" <= c <= "￯"


def wide_spans(line: str, wrong: str) -> list[Span]:
    """UTF-8 read in an encoding of two bytes. Characters of which a byte fits no sequence stay, and so does what shares
    a sequence with them; a sequence that lost bytes becomes one replacement character."""
    data, owner = [], []
    for i, c in enumerate(line):
        try:
            piece = _LOST if c == MARK else c.encode(wrong).decode("latin-1")
        except UnicodeEncodeError:
            piece = _NONE
        data.append(piece)
        owner += [i] * len(piece)
    tokens = []
    raw = [False] * len(line)
    for m in _TOKENS.finditer("".join(data)):
        chars = range(owner[m.start()], owner[m.end() - 1] + 1)
        kind, text = m.lastgroup, MARK
        if kind == "seq":
            text = original(m.group()) or ""
            kind = kind if text else "other"
        elif kind == "plain":
            text = m.group()
        tokens.append((chars, kind, text))
        if kind == "other":
            for i in chars:
                raw[i] = True
    for order in (tokens, tokens[::-1]):
        for chars, _, _ in order:
            if any(raw[i] for i in chars):
                for i in chars:
                    raw[i] = True
    out: list[list] = []
    for chars, kind, text in tokens:
        if raw[chars[0]] or raw[chars[-1]] or (kind == "plain" and line[chars[0]] == text):
            continue
        if out and out[-1][1] > chars[0]:  # shares a character with the sequence before
            out[-1][1] = chars[-1] + 1
            out[-1][2] += text
        elif kind == "plain" or line[chars[0]] != text:
            out.append([chars[0], chars[-1] + 1, text])
    if sum(_japanese(c) for *_, t in out for c in t) < 2:
        return []
    return [(a, b, t) for a, b, t in out]


def japanese_spans(line: str, true: str, wrong: str) -> list[Span]:
    """A line, or the part between its outermost foreign characters, of Japanese bytes read one by one."""
    at = [m.span() for m in _FOREIGN.finditer(line)]
    if not at:
        return []
    for a, b in ((at[0][0], at[-1][1]), (at[0][0], len(line))):
        try:
            data = line[a:b].encode("cp932") if wrong == "cp932" else line[a:b].translate(to_bytes(wrong)).encode("latin-1")
            text = data.decode(true)
        except (UnicodeEncodeError, UnicodeDecodeError):
            continue
        foreign = [c for c in text if c > "\x7f"]
        if len(foreign) >= 2 and all(map(_japanese, foreign)) and sum("぀" <= c <= "ヿ" for c in foreign) * 6 >= len(foreign):
            return [(a, b, text)]
    return []


_RANK = {c: math.log(1 / (i + 2)) for i, c in enumerate(RUSSIAN)}


@lru_cache(1 << 16)
def _russian(word: str) -> float:
    """How well the letters of a word read as Russian: their usual frequency, small letters after the first."""
    return sum(_RANK.get(c.lower(), -6.0) - (3.0 if i and c.isupper() and not word.isupper() else 0.0) for i, c in enumerate(word) if c.isalpha())


@lru_cache(1 << 16)
def _cased(word: str) -> bool:
    """Whether no capital follows a small letter."""
    return not any(a.islower() and b.isupper() for a, b in zip(word, word[1:]))


def cyrillic_spans(line: str, true: str, wrong: str, sure: bool) -> list[Span]:
    """Whole runs that are Cyrillic letters under the pair. Runs in Latin letters prove it from four letters on; runs
    that are Cyrillic already, when all of them together read much better the other way."""
    back = letter_map(true, wrong)
    got, longest, before, after = [], 0, 0.0, 0.0
    for m in _FOREIGN.finditer(line):
        run = m.group()
        word = "".join(back.get(c, c) for c in run)
        core = sum(c in back and back[c].isalpha() for c in run)
        if not core or any(c not in back and c.isalpha() for c in run) or not _cased(word):
            continue
        got.append((m.start(), m.end(), word))
        longest = max(longest, core)
        if wrong in SLAVIC:
            before += _russian(run) - 6.0 * sum(not c.isalpha() and c not in _CLEAN and c in back and back[c].isalpha() for c in run)
            after += _russian(word)
    if wrong in SLAVIC:
        return got if longest >= 4 and after > before + 8 else []
    return got if sure or longest >= 4 else []


def _fluent(line: str) -> bool:
    """Whether the Cyrillic runs of a line read like correct text."""
    runs = _FOREIGN.findall(line)
    foreign = sum(c.isalpha() or not c.isspace() and c not in _CLEAN for r in runs for c in r)
    own = ["".join(c for c in r if c.lower() in _RANK) for r in runs]
    n = sum(map(len, own))
    return not foreign or (2 * n > foreign and sum(map(_russian, own)) > (-2.4 if n > 20 else -2.7) * n)


def _class(letters) -> str:
    return "[" + "".join(map(re.escape, sorted(letters))) + "]"


_STRANGE = _class({g for p in SINGLE_PAIRS if p[0] not in SLAVIC for g in letter_map(*p) if not g.isspace()} - _CLEAN - set(SIGNS))
#: What no correct text has: letters of other kinds, or signs, inside Latin words.
_ODD = re.compile(
    rf"(?<=[A-Za-z]){_STRANGE}|{_STRANGE}(?=[A-Za-z])|(?<=[a-z]){_class(LATIN.upper())}(?![A-Z])"
    rf"|(?<=[A-Za-z]){_class(CYRILLIC + CYRILLIC.upper())}|{_class(CYRILLIC + CYRILLIC.upper())}(?=[A-Za-z])|(?<=[a-z]){_class(INNER)}(?=[a-z])"
)
_LONG_RUN = re.compile(r"[^\x00-\x7f\s]{4}")


def latin_spans(line: str, true: str, wrong: str, sure: bool) -> list[Span]:
    """Words in which letters beyond ASCII turned into others or into signs. A letter or sign that cannot stand where it
    stands proves the pair for its line; then all foreign letters of words are read by it."""
    back = letter_map(true, wrong)
    got, proven = [], sure

    def wordish(x: str) -> bool:
        return x.isalpha() or (x in back and not x.isspace() and x not in "’“”‘…–—")

    for m in _LETTER.finditer(line):
        i, g = m.start(), m.group()
        c = back.get(g)
        if c is None:
            continue
        left, right = line[i - 1 : i] if i else "", line[i + 1 : i + 2]
        l_, r_ = bool(left) and wordish(left), bool(right) and wordish(right)
        if not (l_ or r_):
            continue
        small = left.isascii() and left.islower()
        inner = small and right.isascii() and right.islower()
        if g in SIGNS or g in INNER:
            proven |= inner and g in INNER and c.isalpha()
            both = l_ and r_
            if not c.isalpha() or (g == "’" and (both or l_)) or (not both and (g.isspace() or g in "“”‘„«»")):
                continue
        elif g in _CLEAN and g not in CYRILLIC + CYRILLIC.upper():
            proven |= small and g.isupper() and (c.islower() or not c.isalpha()) and (right.islower() or not right.isalpha())
        elif g not in LOOKALIKE and (c.isupper() or c.islower() == (small or right.islower())):
            proven |= small if c.islower() else right.isascii() and right.isalpha() and not l_
        got.append((i, i + 1, c))
    return got if proven else []


def tongue(line: str) -> str:
    """The language whose frequent words a line has most of; empty where none has two."""
    words = set(re.findall(r"[a-z]+", line.lower()))
    best = max(WORDS, key=lambda k: sum(w in words for w in WORDS[k].split()))
    return best if sum(w in words for w in WORDS[best].split()) > 1 else ""


def _worth(line: str, pair: tuple[str, str], spans: list[Span], lang: str) -> float:
    """How much of the line's foreign characters a pair explains, by letters that the line's language has."""
    true = pair[0]
    if true == "utf-8" or true in WIDE:
        return 1.3 * sum((b - a) * _plausible(line, a, b, t) for a, b, t in spans)
    if true in SLAVIC:
        n = sum(c.isalpha() for *_, t in spans for c in t)
        reads = sum(_russian(t) for *_, t in spans) / max(1, n)
        return (0.95 + 0.2 * (reads + 2.2)) * n
    own = LETTERS.get(lang, "")
    return sum(1.0 if c.lower() in own or not c.isalpha() else 0.3 if own else 0.9 if c.lower() in "éàüöäßñçóáíãê" else 0.6 for *_, c in spans)


def _plausible(line: str, a: int, b: int, text: str) -> float:
    """How usual it is what a span would be: little for lost bytes, rare letters and capitals after small letters."""
    if MARK in text:
        return 0.7
    if text.isupper() and len(text) == 1 and line[a - 1 : a].islower() and a and line[b : b + 1].islower():
        return 0.6
    return 1.0 if all(c < "\x80" or c in _CLEAN or c in SIGNS or _japanese(c) or c > "\u2190" for c in text) else 0.6


def spans_of(line: str, pair: tuple[str, str], sure: bool) -> list[Span]:
    true, wrong = pair
    if true == "utf-8":
        return wide_spans(line, wrong) if wrong in WIDE else utf8_spans(line, wrong, sure)
    if true in WIDE:
        return japanese_spans(line, true, wrong)
    return (cyrillic_spans if true in SLAVIC else latin_spans)(line, true, wrong, sure)


def _put(line: str, spans: list[Span]) -> str:
    parts, at = [], 0
    for a, b, text in spans:
        if a >= at:
            parts += [line[at:a], text]
            at = b
    return "".join([*parts, line[at:]])


def _proves(line: str, pair: tuple[str, str], spans: list[Span]) -> bool:
    """Whether spans include more than forms of letters, so that the pair may be taken as known in the whole text."""
    return pair[0] != "utf-8" or any(not all(x in _CLEAN for x in line[a:b]) for a, b, _ in spans)


_TOUCHING = re.compile(r"[^\x00-\x7f]{2}")
_RUSSIAN_LINE = re.compile(rf"[\x00-\x7f{CYRILLIC}{CYRILLIC.upper()}–—’“”«»…№]*")


def suspect(line: str) -> bool:
    """Whether a line could hold garbled sequences at all; most correct lines are told apart here."""
    if line.isascii() or not (_TOUCHING.search(line) or _ODD.search(line)):
        return False
    return not (_RUSSIAN_LINE.fullmatch(line) and all(map(_cased, _FOREIGN.findall(line))) and _fluent(line) and not _ODD.search(line))


def readings(lines: list[str], spent: list[bool]) -> list[tuple[tuple[str, str], list[Span]] | None]:
    """For each line, the pair to take off next and its spans; None where nothing is garbled."""
    options: list[dict[tuple[str, str], list[Span]]] = []
    known: Counter = Counter()
    for line, done in zip(lines, spent):
        mine = {}
        if suspect(line):
            odd, pairs = _ODD.search(line), named(line)
            for pair in (p for p in pairs if p[0] == "utf-8" or p[0] in WIDE and not done):
                if s := spans_of(line, pair, False):
                    mine[pair] = s
            # single letters for single letters only where whole sequences do not tell most of the line
            most = max((_worth(line, p, s, "") for p, s in mine.items()), default=0.0)
            if not done and most < sum(c > "\x7f" for c in line):
                slavic = _LONG_RUN.search(line) and not _fluent(line)
                for pair in (p for p in pairs if p[0] not in ("utf-8", *WIDE) and (slavic if p[0] in SLAVIC else odd)):
                    if s := spans_of(line, pair, False):
                        mine[pair] = s
            for pair, s in mine.items():
                if _proves(line, pair, s):
                    known[pair] += sum(b - a for a, b, _ in s)
        options.append(mine)
    out = []
    for line, done, mine in zip(lines, spent, options):
        for pair in known:  # what one line proves, counts in the others
            if not line.isascii() and pair[0] == "utf-8" and pair not in mine and pair[1] not in WIDE and (s := spans_of(line, pair, True)):
                mine[pair] = s
        if not mine:
            out.append(None)
            continue
        lang = tongue(line)
        best = max(mine, key=lambda p: (round(_worth(line, p, mine[p], lang), 6), known[p], -_PLACE[p]))
        spans = spans_of(line, best, True) if best[0] == "utf-8" and best in known and best[1] not in WIDE else mine[best]
        out.append((best, spans))
    return out


_BLANK_A = re.compile(r"(?<![A-ZÀ-Þ])Ã(?: (?= )|(?=[ ,.;:!?)]|$))")  # à whose second byte, a no-break space, became a blank or was lost


def unescape(line: str) -> str:
    """Numeric entities beyond ASCII as characters."""

    def back(m) -> str:
        code = int(m.group(1), 16) if m.group(1) else int(m.group(2))
        return chr(code) if 128 <= code < 0x110000 and not 0xD800 <= code < 0xE000 else m.group()

    return ENTITY.sub(back, line) if "&#" in line else line


def restore(text: str | None) -> tuple[str | None, bool]:
    """The text with its garbled spans put back as far as can be, and whether any were found."""
    if text is None or (text.isascii() and "&#" not in text):
        return text, False
    hit = MARK in text
    if not hit and "&#" not in text and not (_TOUCHING.search(text) or _ODD.search(text)):
        return text, False
    lines = text.split("\n")
    # entities are read as characters only in lines that are garbled then
    bare = [unescape(line) for line in lines]
    if bare != lines:
        lines = [b if b != line and r else line for line, b, r in zip(lines, bare, readings(bare, [False] * len(bare)))]
    spent = [False] * len(lines)
    while True:
        got = readings(lines, spent)
        if not any(got):
            break
        hit, better = True, []
        for i, (line, r) in enumerate(zip(lines, got)):
            out = line
            if r is not None:
                (true, wrong), spans = r
                out = _put(line, spans)
                if true == "utf-8" and wrong in ("cp1252", "latin-1"):
                    out = _BLANK_A.sub("à", out)
                if true != "utf-8":
                    spent[i] = True
                elif len(out) >= len(line):
                    out = line  # no layer of UTF-8 leaves a line as long
            better.append(out)
        if better == lines:
            break
        lines = better
    return "\n".join(lines), hit


def garbled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, restored)`` for each row whose text holds garbled spans; ``restored`` is the text with those put back.

    Null and empty texts are never garbled; ASCII texts without numeric entities never leave the JVM. Texts that are no
    UTF-8 are garbled; Arrow would fail on them as strings, so all texts travel as bytes. Repeated rows come out
    repeatedly; other columns are dropped, whatever their names.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").rlike(r"[^\x00-\x7F]|&#[xX0-9]"))
    rows = rows.select("id", F.col("text").cast("binary").alias("text"))

    def read_back(data: bytes) -> tuple[str, bool]:
        text, broken = decoded(data)
        text, hit = restore(text)
        return text, hit or broken

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            done = [read_back(t) for t in b["text"]]
            keep = [h for _, h in done]
            yield pd.DataFrame({"id": b["id"][keep], "restored": [t for t, h in done if h]})

    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInPandas(scan, f"id {kind}, restored string").withColumnRenamed("id", id_col)
