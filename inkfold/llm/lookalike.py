"""Problem 6: one form for text that looks the same.

A value is read in runs of letters. Each letter has a set of scripts that it can belong to, common signs having all of
them; the intersection over a run is its resolved script set. An empty intersection marks a mixed-script run, which is
rewritten in the one script that can spell all of it. A run of one script whose every letter has a twin in the script
of the sentence around it is a whole-script confusable and is rewritten likewise. What remains is normalised: letters
in compatibility forms (full-width, mathematical, Roman numeral, ligature), accents split off their letters, invisible
characters and unusual spaces.

Left alone: curly quotes, dashes, ellipses, signs, emoji and their joiners, composed accents, and sentences wholly in
another script. Null stays null and the empty text stays empty.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters of other scripts and their Latin twins, position by position.
CYRILLIC = "аеорсухіѕјһԁԛԝӏѵкмтвнгпзАВЕКМНОРСТУХІЅЈԚԜӀҮЗҽѡѐҮԌԐ"
CYRILLIC_LATIN = "aeopcyxisjhdqwlvkmtbhrn3ABEKMHOPCTYXISJQWlY3ewèYGE"
GREEK = "οαρυικντχγηεωΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϲϳ"
GREEK_LATIN = "oapuikvtxyneωABEZHIKMNOPTYXCcj"
ARMENIAN = "օսհոցքզՕՍՏԼ"
ARMENIAN_LATIN = "ouhngpqOUSL"
CHEROKEE = "ᎠᎡᎢᎪᎬᎳᎷᎻᏀᏃᏎᏏᏐᏒᏔᏕᏙᏚᏞᏟᏢᏦᏩ"
CHEROKEE_LATIN = "DRTAEWMHGZ4bIRWSVSLCPKG"
LISU = "ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ"
LISU_LATIN = "BPDTGKJCZFMNLSRVHWXYAEIOU"
COPTIC = "ⲟⲞⲣⲢⲥⲤⲎⲔⲘⲚⲦⲂⲒⲬ"
COPTIC_LATIN = "oOpPcCHKMNTBIX"
DESERET = "𐐬𐐄𐐽𐑈𐐠𐐕"
DESERET_LATIN = "oOcsSC"
#: Letters of the Latin script itself that pass for plain ones, beside the small capitals, which their names tell.
LATIN_TWINS = {"ɡ": "g", "ɑ": "a", "ı": "i", "ɩ": "i", "ǀ": "l", "ʋ": "v", "ꞁ": "l", "ꬲ": "e", "ꬽ": "o"}
LATIN_TWINS |= {
    chr(o): m.group(1).lower()
    for a, b in ((0x250, 0x2B0), (0x1D00, 0x1D80), (0xA730, 0xA800))
    for o in range(a, b)
    if (m := re.fullmatch("LATIN LETTER SMALL CAPITAL ([A-Z])", unicodedata.name(chr(o), "")))
}
#: Words that show a text to be in a language without dotless i.
DOTTED = set("the and of to is for in on with by at you please der die das und ist le la les de et el los una que".split())

SPACES = "   -   　"
INVISIBLE = "­͏؜ᅟᅠ឴឵᠎​-‏‪-‮⁠-⁤⁦-⁩ㅤ﻿ﾠ\U000e0001-\U000e007f"

_TWINS: dict[str, dict[str, str]] = {"Latin": {}, "Cyrillic": {}, "Greek": {}}
for _own, _latin, _name in ((CYRILLIC, CYRILLIC_LATIN, "Cyrillic"), (GREEK, GREEK_LATIN, "Greek"), (ARMENIAN, ARMENIAN_LATIN, ""), (CHEROKEE, CHEROKEE_LATIN, ""), (LISU, LISU_LATIN, ""), (COPTIC, COPTIC_LATIN, ""), (DESERET, DESERET_LATIN, "")):
    for _a, _b in zip(_own, _latin, strict=True):
        if _b.isascii():
            _TWINS["Latin"].setdefault(_a, _b)
            if _name:
                _TWINS[_name].setdefault(_b, _a)
for _a in CYRILLIC + GREEK:  # Cyrillic and Greek meet in their Latin twin
    _b = _TWINS["Latin"].get(_a)
    for _name, _own in (("Cyrillic", GREEK), ("Greek", CYRILLIC)):
        if _a in _own and _b in _TWINS[_name]:
            _TWINS[_name].setdefault(_a, _TWINS[_name][_b])
#: Letters whose look is only near in one reading; they prove nothing about a run and are never rewritten in a run
#: that is wholly Cyrillic or Greek.
_WEAK = set("кмтвнгпзгЗυικντχγηε")

_SCRIPTS = [(n, regex.compile(rf"\p{{Script={n}}}")) for n in ("Latin", "Cyrillic", "Greek", "Armenian", "Cherokee", "Hebrew", "Arabic", "Han", "Hiragana", "Katakana", "Hangul")]
_JOINED = {"Han": {"Jpan", "Kore", "Han"}, "Hiragana": {"Jpan"}, "Katakana": {"Jpan"}, "Hangul": {"Kore"}}
_RUN = regex.compile(r"[\p{L}\p{M}]+")
_CJK = regex.compile(r"[\p{Script=Han}\p{Script=Hiragana}\p{Script=Katakana}\p{Script=Hangul}]")
_INVISIBLE = regex.compile(rf"[{INVISIBLE}︀-️]")
_SPACE = re.compile(rf"[{SPACES}]")
_PICTURE = regex.compile(r"[\p{Extended_Pictographic}\p{EMod}⃣️]")
_JOINING = regex.compile(r"[\p{Script=Arabic}\p{Script=Devanagari}\p{Script=Bengali}\p{Script=Tamil}\p{Script=Telugu}\p{Script=Malayalam}\p{Script=Kannada}\p{Script=Sinhala}\p{Script=Khmer}\p{Script=Hebrew}]")
_SENTENCE = regex.compile(r"[.!?…\n]+")


@lru_cache(65536)
def scripts(ch: str) -> frozenset[str] | None:
    """The resolved script set of one letter; None for signs of all scripts."""
    for name, pattern in _SCRIPTS:
        if pattern.match(ch):
            return frozenset(_JOINED.get(name, {name}))
    return frozenset({"Other"}) if unicodedata.category(ch)[0] == "L" else None


@lru_cache(65536)
def plain(ch: str) -> str:
    """The plain form of a letter or digit in a compatibility form; the character itself otherwise."""
    if unicodedata.category(ch)[0] not in "LN" or ch == "µ":
        return ch
    tag = unicodedata.decomposition(ch).split(" ")[0]
    if tag in ("<wide>", "<narrow>", "<font>", "<compat>", "<initial>", "<medial>", "<final>", "<isolated>") or (tag and tag[0] != "<" and len(unicodedata.normalize("NFC", ch)) == 1):
        return unicodedata.normalize("NFKC" if tag[0] == "<" else "NFC", ch)
    return ch


def resolved(run: str) -> frozenset[str] | None:
    """Intersection of the letters' script sets: None when no letter decides, empty for a mixed run."""
    common: frozenset[str] | None = None
    for ch in run:
        s = scripts(ch)
        if s is not None:
            common = s if common is None else common & s
    return common


@lru_cache(65536)
def twin(ch: str, target: str) -> str | None:
    """The letter of the target script that looks like this one; an accent goes over to it."""
    if ch in _TWINS[target]:
        return _TWINS[target][ch]
    base, *marks = unicodedata.normalize("NFD", ch)
    if marks and base in _TWINS[target]:
        out = unicodedata.normalize("NFC", _TWINS[target][base] + "".join(marks))
        return out if len(out) == 1 else None
    return None


def _spell(run: str, target: str) -> str | None:
    """The run in the target script, or None where a letter has no twin there."""
    out = []
    for ch in run:
        s = scripts(ch)
        if s is None or target in s:
            out.append(ch)
        elif (t := twin(ch, target)) is not None:
            out.append(t)
        else:
            return None
    return "".join(out)


def _mixed(run: str, around: frozenset[str]) -> str:
    """The consistent spelling of a mixed run: the script that most letters without a twin demand, Latin first. Where
    Latin cannot spell it, a script of fewer letters than the Latin ones must be that of words ``around``."""
    options = [(t, w) for t in ("Latin", "Cyrillic", "Greek") if (w := _spell(run, t)) is not None]
    if not options:
        return run
    own = {t: sum(t in (scripts(c) or ()) for c in run) for t in ("Latin", "Cyrillic", "Greek")}
    fixed = {t: sum(t in (scripts(c) or ()) and (c in _WEAK or not any(twin(c, u) for u in _TWINS if u != t)) for c in run) for t, _ in options}
    target, word = max(options, key=lambda o: (fixed[o[0]], o[0] == "Latin", own[o[0]]))
    if target != "Latin" and options[0][0] != "Latin" and own[target] < own["Latin"] and target not in around:
        return run
    return word


def _latin(run: str, value: str) -> str:
    """A run with the letters of the Latin script that pass for plain ones rewritten, unless they are what they are:
    sound signs among others, or the dotless i of a word in vowel harmony and of a text without words of other languages."""
    if any("ɐ" <= c <= "ʯ" and c not in LATIN_TWINS or c in "ŋðθː" for c in run):
        return run
    low = run.lower()
    if "ı" in low and not any(c in "eiöü" for c in low):
        turkish = any(c in "ğşİ" for c in value)
        if turkish or DOTTED.isdisjoint(value.lower().split()):
            return "".join(c if c == "ı" else LATIN_TWINS.get(c, c) for c in run)
    return "".join(LATIN_TWINS.get(c, c) for c in run)


def _invisible(value: str) -> str:
    """Without invisible characters, save those that join emoji or shape letters of joining scripts."""

    def keep(m) -> str:
        ch, before, after = m.group(), value[m.start() - 1 : m.start()], value[m.end() : m.end() + 1]
        if "︀" <= ch <= "️":
            return ch
        if ch == "‍" and before and after and _PICTURE.match(before) and _PICTURE.match(after):
            return ch
        if ch in "‌‍‎‏" and ((before and _JOINING.match(before)) or (after and _JOINING.match(after))):
            return ch
        if "\U000e0020" <= ch <= "\U000e007f" and before and (_PICTURE.match(before) or "\U000e0020" <= before <= "\U000e007f"):
            return ch
        return ""

    return _INVISIBLE.sub(keep, value)


def _whole(sentence: str, rest: str = "") -> str:
    """Rewrite the whole-script confusables of one sentence. ``rest``: other text whose scripts count as its own,
    for a last sentence that may have been cut off."""
    runs = [(m.start(), m.end(), resolved(m.group())) for m in _RUN.finditer(sentence)]
    known = {t: 0 for t in _TWINS}
    loose = []
    for a, b, s in runs:
        name = next(iter(s)) if s and len(s) == 1 else None
        if name not in known and name not in ("Armenian", "Cherokee"):
            continue
        run = sentence[a:b]
        if name != "Latin" and all((twin(c, "Latin") and c not in _WEAK) or scripts(c) is None for c in run):
            loose.append((a, b, name, "Latin"))
        elif name == "Latin" and len(run) <= 2 and all(c in _TWINS["Cyrillic"] and c.islower() for c in run):
            loose.append((a, b, name, "Cyrillic"))
        elif name in known:
            known[name] += b - a
    if loose and rest:
        for m in _RUN.finditer(rest):
            for name in resolved(m.group()) or ():
                if name in known and name != "Latin":
                    known[name] += m.end() - m.start()
    out, at = [], 0
    for a, b, name, target in loose:
        before, after = sentence[max(0, a - 2) : a], sentence[b : b + 2]
        # joined to a letter of the target by an apostrophe or hyphen: part of that word
        joined = any(len(x) == 2 and not x[y].isspace() and not scripts(x[y]) and target in (scripts(x[1 - y]) or ()) for x, y in ((before, 1), (after, 0)))
        own = known.get(name, 0)
        if joined or (own == 0 and known[target] > 0) or (target == "Cyrillic" and known["Cyrillic"] > 3 * known["Latin"] and len(sentence[a:b]) == 1):
            out += [sentence[at:a], _spell(sentence[a:b], target) or sentence[a:b]]
            at = b
    return "".join([*out, sentence[at:]])


def canonical(value: str | None) -> tuple[str | None, bool]:
    """The value in its one form, and whether it held characters exchanged for, or hidden in, that look."""
    if value is None or value.isascii():
        return value, False
    cjk = _CJK.search(value) is not None
    out = _invisible(value)
    out = _SPACE.sub(lambda m: m.group() if cjk and m.group() == "　" else " ", out)
    out = "".join(c if c < "\x80" or (cjk and ("！" <= c <= "～" or scripts(c) not in (None, frozenset({"Latin"})))) else plain(c) for c in out)
    if not cjk:
        out = "".join(unicodedata.normalize("NFKC", c) if "！" <= c <= "～" else c for c in out)
    out = unicodedata.normalize("NFC", out)
    runs = [(*m.span(), m.group()) for m in _RUN.finditer(out)]
    parts, at, around = [], 0, None
    for a, b, run in runs:
        if run.isascii():
            continue
        word = _latin(run, out) if any(c in LATIN_TWINS for c in run) else run
        if resolved(word) == frozenset():
            if around is None:
                around = frozenset().union(*(s for *_, r in runs if (s := resolved(r)) and len(s) == 1))
            word = _mixed(word, around)
        if word != run:
            parts += [out[at:a], word]
            at = b
    out = "".join([*parts, out[at:]])
    if not out.isascii():
        parts, at = [], 0
        for m in _SENTENCE.finditer(out):
            parts += [_whole(out[at : m.start()]), m.group()]
            at = m.end()
        out = "".join([*parts, _whole(out[at:], out[:at])])
    return out, out != value


def canonical_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        done = [canonical(v) for v in b["value"]]
        yield b.assign(canonical=[c for c, _ in done], changed=[h for _, h in done])


def unify(df: DataFrame, column: str, out: str) -> DataFrame:
    """``df`` with ``out``, the one form of ``column``. Null gives null; all other columns stay, whatever their names."""

    @F.pandas_udf("string")
    def one_form(values: pd.Series) -> pd.Series:
        return pd.Series([canonical(v)[0] for v in values], dtype=object)

    return df.withColumn(out, one_form(F.col(column)))


def lookalikes(values: DataFrame) -> DataFrame:
    """``(row_id, field, value)`` to ``(row_id, field, value, canonical)`` for each value that was not in its one form.

    Values of plain ASCII cannot differ and never leave the JVM. Nulls and empty values give no row; repeated rows
    come out as often as they went in; columns beyond the three are dropped.
    """
    rows = values.select("row_id", "field", "value").where(F.col("value").rlike(r"[^\x00-\x7F]"))
    schema = T.StructType([*rows.schema.fields, T.StructField("canonical", T.StringType()), T.StructField("changed", T.BooleanType())])
    return rows.mapInPandas(canonical_batches, schema).where("changed").drop("changed")
