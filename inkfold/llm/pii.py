"""Problem 4: personal information in free text, by a semi-Markov conditional random field.

A text is a sequence of segments of a kind and of text between them. The model gives a sequence the probability
exp(sum of its scores) / Z. A segment's score is the sum of the weights of its whole-span features (its shape, its
parts and the words around it); each step from one segment to the next has a weight for the two kinds and for whether
they touch. Z and the expected features come from a forward and a backward pass over the candidate segments, the best
sequence from the same pass with maxima; boundaries and kinds are so chosen together, and no two segments overlap.
Segments are bounded by loose grammars, far looser than what is kept, of any length: any run with an at sign, any run
of digits, any house number beside words, any run of two to four capitalised words, small words beside a cue of names.
Word lists are features among others; a name that is in none is judged by its letters' case and what stands around it.

Weights are trained here, by gradient ascent on the likelihood less a squared penalty, on sentences composed by rule
from carriers, kinds and look-alikes that are nobody's data (orders, tickets, meetings, places, handles). Training
takes no input rows, so its size does not depend on them.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfold.llm.lookalike import canonical

KINDS = ("email", "phone", "id_number", "street_address", "person_name")
PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "street_address": "[ADDRESS]", "person_name": "[NAME]"}
SENTENCES, ROUNDS, SEED = 3000, 14, 11
RATE, PENALTY, BATCH = 0.5, 2e-5, 250  # steps of the gradient, weight of the squares, sentences a step
NEAR = 4  # letters between two segments that touch

# Word lists of the features.
GIVEN = set(
    """aisha amir amina ana anders andrea andrei anika anna antonio astrid aurora ayumi beatriz bianca boris bruno callum camila carla
    carlos carmen chen chiara chloe clara daniel david deepa diego dmitri elena elif emeka emma erik esther eva fatima farid felix
    fiona francesca freya george giulia goran greta hannah hans hassan heidi helena henrik hiro ibrahim igor ilse ines ingrid
    irina isabel ivan jamal james jana javier jean joao johan john jonas jorge jose juan julia julian kai karim karin katya kenji kofi
    lars laura layla leila lena leon lin linnea lisa louis lucia luis luka magnus malik manuel marco maria marie marlow marta mateo mei
    michael miguel mina mira mohammed nadia naomi natalia nikolai nina noah noor olga oliver omar oscar pablo pavel pedro peter petra
    pierre priya quentin rafael rahul ravi rosa samir sami samira sandra sara sergei silvia sofia stefan sven tanja tariq tessa
    thabo thomas tomas uma umar valentina vera viktor vivian wanda wei xenia yara yasmin yuki yuri yusuf zara zoe zofia""".split()
)
TITLES = "mr mrs ms miss dr prof herr frau madame monsieur mme sr sra señor señora don doña pan pani г-н г-жа".split()
STREET_AFTER = "street st road rd avenue ave drive dr lane ln boulevard blvd way court ct square sq terrace crescent close row highway parkway".split()
STREET_BEFORE = "rue avenue boulevard place chemin quai impasse allée calle avenida plaza paseo camino rua travessa via viale ulica ul улица ул".split()
STREET_END = ("straße", "strasse", "str.", "weg", "platz", "allee", "gasse", "ring", "ufer", "damm")
PHONE_CUES = "call tel telephone phone mobile cell text sms voicemail fax number whatsapp dial ring hotline anruf telefon teléfono téléphone тел".split()
ID_CUES = "ssn social security insurance passport licence license identity identification id tax dni nie nif personalausweis ausweis reisepass steuer sécurité sociale pasaporte cpf pesel паспорт инн снилс ni nino itin".split()
OTHER_CUES = "meeting order ticket build serial invoice room gate row tracking code version error ref reference score page pages costs total copies boarding fig item items unread".split()
NAME_CUES = "signed by regards attendees ask talked to from with profile calendar dear hi hello contact author sincerely met подписал подписала участники спросите уважением писал звонил von unterschrieben gruß grüße par signé cordialement firmado por saludos atentamente assinado".split()
NAME_NEXT = "will can could wrote said asked profile calendar joined left sent agreed has had was is and called told writes says thinks и просит".split()  # words after a name
PERSON_WORDS = "invite invited thank thanks thanked tell told meet met ask asked call called email emailed with by to from for is was and between colleague guest named manager client nurse lawyer teacher assigned mit von bei avec par con por com с от".split()
SURNAME_ENDS = "thorpe leigh ley bery by grove croft wick drake shaw stone man mere ridge rick lund vane den sey holm well quist marsh worth varth son sen ez ov ova ski ska berg feld mann gate side more field ton ham ford".split()

_WORD = r"[\p{L}\p{M}’'\-]+"
_PARTICLE = "de|du|des|la|le|les|da|do|dos|das|del|di|della|los|las|el"
_DOMAIN = r"[\p{L}\p{N}\-]+(?:\s*(?:\.|\[dot\]|\(dot\)|\{dot\}| dot )\s*[\p{L}\p{N}\-]+)*"
_LOOSE = {
    "email": regex.compile(rf"(?:mailto:)?[\p{{L}}\p{{N}}._%+\-]*\s?(?:@|＠|\[at\]|\(at\)|\{{at\}}| at )\s?{_DOMAIN}", regex.I),
    "digits": regex.compile(r"(?<![\p{N}\p{L}])(?:(?!ID|NI|NO)\p{Lu}{1,2}[ \-]?(?=\p{Nd}))?[+(]{0,2}\p{Nd}(?:[ \-./()]{0,2}[\p{Nd}]|[ \-]?\p{Lu}(?![\p{Ll}]))*"),
    "street": regex.compile(
        rf"(?:(?:flat|apt|apartment|unit|suite)\.? \p{{N}}+\p{{L}}?,? )?\p{{Nd}}+(?:[/\-]\p{{Nd}}+)?\p{{L}}?,? (?:{_WORD} |\p{{L}}{{1,3}}\. )+?(?:{'|'.join(STREET_AFTER)})\b\.?(?:,? (?:unit|apt|flat|suite|#)\.? ?\p{{N}}+\p{{L}}?)?"
        rf"|\p{{Nd}}+\p{{L}}?,? (?:bis )?(?:{'|'.join(STREET_BEFORE)})\.? (?:(?:{_PARTICLE}) )*{_WORD}"
        rf"|(?:{'|'.join(STREET_BEFORE)})\.? (?:{_WORD} )*?{_WORD},? (?:n[º°o]\.? ?|№ ?|д\. ?)?\p{{Nd}}+\p{{L}}?(?:, \p{{Nd}}+[ºª]? ?\p{{L}}?\b)?"
        rf"|{_WORD}(?: ?(?:straße|strasse|str\.|weg|platz|allee|gasse|ring|ufer|damm)) \p{{Nd}}+ ?\p{{L}}?\b",
        regex.I,
    ),
    "name": regex.compile(rf"(?<![\p{{L}}@.+_\-]){_WORD}\.?,? (?:\p{{L}}\. )?{_WORD}(?: {_WORD}){{0,2}}(?![@_+])"),
    "capitals": regex.compile(rf"(?<![\p{{L}}@.+_\-])\p{{Lu}}{_WORD}\.?,? (?:\p{{L}}\. )?\p{{Lu}}{_WORD}(?: {_WORD}){{0,2}}(?![@_+])"),
}
_TOKEN = regex.compile(r"[\p{L}\p{M}\p{N}’'\-]+")


_STREET_WORDS = set(STREET_AFTER) | set(STREET_BEFORE)
_STREET_STEMS = tuple(e.strip(".") for e in STREET_END)
_NAME_WORDS = GIVEN | set(TITLES)


def _key(word: str) -> str:
    return word.lower().strip(".,:;'’-")


@lru_cache(100_000)
def word_class(word: str) -> str:
    """What a word could be in a name: a title, a given name, a surname by its end, an initial, or its case."""
    k = _key(word)
    case = "U" if word.isupper() and len(word) > 1 else "C" if word[:1].isupper() else "l"
    if k in TITLES:
        return "title" + case
    if len(k) == 1:
        return "initial"
    if k in GIVEN:
        return "given" + case
    last = k.split("-")[-1]
    if len(last) > 3 and any(last.endswith(e) for e in SURNAME_ENDS):
        return "surname" + case
    return case


def _place(text: str, a: int) -> str:
    """Whether a segment begins a sentence or title, follows a sign, or stands inside a sentence."""
    lead = text[:a].rstrip()
    if not lead or "\n" in text[len(lead) : a] or lead[-1] in ".!?…·|":
        return "start"
    return "inside" if lead[-1].isalpha() else "sign"


def _broken(words: list[tuple[str, int]]) -> bool:
    return any(w.endswith(".") and len(w) > 2 and _key(w) not in TITLES for w, _ in words[:-1])


def _around(text: str, a: int, b: int) -> tuple[list[str], str]:
    return [_key(w) for w in _TOKEN.findall(text[max(0, a - 42) : a])[-4:]], text[b : b + 12]


def candidates(text: str) -> Iterator[tuple[int, int, str, tuple[str, ...]]]:
    """Segments ``(start, end, kind, features)`` that could be of a kind. A grammar is tried only on texts that hold
    what all its matches hold."""
    low = text.lower()
    keys = {k.strip(".,:;'’-") for k in _TOKEN.findall(low)}
    digits = any(map(str.isdigit, text))
    emails = "@" in text or "＠" in text or ("at" in low and ("dot" in low or "(at)" in low or "[at]" in low or "{at}" in low))
    streets = digits and (not keys.isdisjoint(_STREET_WORDS) or any(e in low for e in _STREET_STEMS))
    names = "name" if not keys.isdisjoint(_NAME_WORDS) else "capitals"
    for m in _LOOSE["email"].finditer(text) if emails else ():
        s, a, b = m.group(), m.start(), m.end()
        at = regex.search(r"@|＠|\[at\]|\(at\)|\{at\}| at ", s, regex.I)
        local, domain = s[: at.start()], s[at.end() :]
        if (at.group() == " at " and not regex.search(r"\bdot\b", domain, regex.I)):
            continue
        dotted = bool(regex.search(r"\.\s?\p{L}{2,}$|dot.{0,2}\s?\p{L}{2,}$", domain, regex.I))
        yield a, b, "email", ("bias", f"sign={'@' if '@' in at.group() else at.group().strip().lower()}", f"local={bool(local.strip())}", f"dotted={dotted}", f"both={bool(local.strip()) and dotted}", f"spelt={at.group() == ' at '}")
    for m in _LOOSE["digits"].finditer(text) if digits else ():
        s, a, b = m.group(), m.start(), m.end()
        n = sum(c.isdigit() for c in s)
        if n < 5:
            continue
        before, after = _around(text, a, b)
        cues = {c: any(w in words for w in before) for c, words in (("phone", PHONE_CUES), ("id", ID_CUES), ("other", OTHER_CUES))}
        near = next((c for w in reversed(before) for c, words in (("id", ID_CUES), ("phone", PHONE_CUES), ("other", OTHER_CUES)) if w in words), "none")
        shape = regex.sub(r"9+", lambda r: f"{min(len(r.group()), 8)}", regex.sub(r"\p{Nd}", "9", regex.sub(r"\p{Lu}", "A", s)))
        f = ("bias", f"n={min(n, 16)}", f"near={near}", f"plus={s[0] == '+'}", f"zero={s[0] == '0'}", f"paren={'(' in s}", f"letter={any(c.isalpha() for c in s)}", f"groups={min(5, len(regex.split(r'[ ./()-]+', s)))}", f"sep={''.join(sorted(set(regex.findall(r'[ ./-]', s))))}", f"shape={shape}", f"555={'555' in s}", f"glued={text[a - 1 : a].isalnum() or after[:1].isalnum()}", f"money={text[a - 1 : a] in '$€£#' and a > 0}", *(f"cue={c}" for c, v in cues.items() if v), f"near,n={near},{7 <= n <= 15}")
        yield a, b, "phone", f
        yield a, b, "id_number", f
    for m in _LOOSE["street"].finditer(text, overlapped=True) if streets else ():
        s, a, b = m.group(), m.start(), m.end()
        if (a and (text[a - 1].isalnum() or text[a - 1] in ".,-/" and text[a - 2 : a - 1].isdigit())):
            continue
        words = _TOKEN.findall(s)
        own = [w for w in words if not w[0].isdigit() and _key(w) not in _STREET_WORDS]
        after_ = [_key(w) for w in words if _key(w) in STREET_AFTER]
        before_ = [_key(w) for w in words if _key(w) in STREET_BEFORE]
        end = any(_key(w).endswith(e.strip(".")) and len(_key(w)) > len(e) + 2 for w in words for e in STREET_END)
        common = sum(_key(w) in _FUNCTION for w in own)
        yield a, b, "street_address", ("bias", f"after={bool(after_)}", f"before={bool(before_)}", f"end={end}", f"common={min(common, 3)}", f"names={min(len(own), 5)}", f"big={any(w[0].isupper() for w in own)}", f"form={(after_ or before_ or ['end'])[0]}", f"unit={_key(words[0]) in ('flat', 'apt', 'apartment', 'unit', 'suite')}", f"digit={s[0].isdigit()}", f"function={common > 0},{_key(words[1] if len(words) > 1 else '') in _FUNCTION}", f"lower={not any(w[0].isupper() for w in own)},{bool(before_)}", f"cut={'.' in s[:-6] and ' St.' not in s}")
    for m in _LOOSE[names].finditer(text, overlapped=True):
        words = [(w.group(), w.end()) for w in regex.finditer(rf"{_WORD}\.?,?", m.group())]
        for n in (2, 3, 4):
            if len(words) < n:
                continue
            a, b = m.start(), m.start() + words[n - 1][1]
            s = text[a:b].rstrip(".,")
            b = a + len(s)
            parts = [regex.sub(r"[,.]", "", w) for w, _ in words[:n]]
            classes = [word_class(p) for p in parts]
            listed = any(c.startswith(("title", "given")) for c in classes)
            if not listed and (_key(parts[0]) in _FUNCTION or _key(parts[0]) in _FOREIGN_FUNCTION or any(c.endswith("l") and c != "initial" for c in classes)):
                continue  # small letters and function words look like a name only beside a listed one
            before, after = _around(text, a, b)
            comma = words[0][0].endswith(",")
            stop = any(_key(p) in _FUNCTION for p in parts)
            last = before[-1] if before else ""
            near = "start" if a == 0 or text[a - 1] == "\n" else last if last in NAME_CUES else "other" if last in ("the", "in", "near") else "none"
            tail = "end" if not after.strip() else after.strip()[:1] if not after.strip()[:1].isalnum() else "word"
            yield a, b, "person_name", ("bias", f"n={n}", f"classes={' '.join(classes)}", f"first={classes[0]}", f"last={classes[-1]}", f"comma={comma}", f"function={stop}", f"near={near}", f"tail={tail}", f"case={''.join(c[-1] for c in classes)}", f"place={_key(parts[-1]) in _PLACES}", f"short={min(map(len, parts)) < 3}", *(() if listed else _unlisted(parts, classes, near, tail, after, before, _place(text, a), _broken(words[:n]))))


def _unlisted(parts: list[str], classes: list[str], near: str, tail: str, after: str, before: list[str], place: str, broken: bool) -> tuple[str, ...]:
    """Features of a run of capitalised words of which no list has any: where it stands, what stands around it and its
    ends decide. ``broken``: a full stop inside, which is no initial's."""
    following = next(iter(_TOKEN.findall(after)), "").lower()
    if near == "start" and before and before[-1] in NAME_CUES:
        near = "closing"  # the line below a closing phrase
    cue = near not in ("start", "other", "none")
    surname = classes[-1].startswith("surname")
    common = sum(_key(p) in _COMMON or _key(p) in _FUNCTION or _key(p) in _FOREIGN_FUNCTION for p in parts)
    verb = following in NAME_NEXT
    return (
        "unlisted", f"u:cue={cue},{surname}", f"u:near={near}", f"u:common={min(common, 2)}", f"u:next={following if verb else tail}",
        f"u:last={classes[-1]},{near}", f"u:n={len(parts)},{cue}", f"u:case={''.join(c[-1] for c in classes)},{cue}", f"u:colon={before[-1:] == ['attendees']}",
        f"u:place={place},{common > 0},{broken}", f"u:place,next={place},{verb},{common > 0},{broken}",
        f"u:person={place},{bool(before) and before[-1] in PERSON_WORDS},{common > 0},{broken}",
    )


_FOREIGN_FUNCTION = set("wenn als dass weil quand si que cuando porque если когда чтобы что как für der die das und mit von pour le la les du des el los las para por con на по для от с и".split())
_COMMON = set(
    """monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october november
    december quarter ledger notes plan plans budget review report invoice memo agenda glossary template archive draft final annual weekly
    daily monthly team office project meeting status save edit view file open close new send reply inbox mail calendar messages settings
    order ticket build version page room hall desk gate row item items list update summary legal finance training support design research
    sales customer client service center main north south east west royal grand great united states kingdom city market street road
    contract brochure catalogue survey handbook manual roadmap schedule timeline board folder document documents viewer editor search
    home help tools window format insert delete copy paste print share export import select all active pending approved overdue
    der die das und bitte le la les el los una para по на для отчёт план бюджет собрание проект счёт отдел новый файл""".split()
)


_FUNCTION = set("the a an and or of for to in on at by with from is are was will would can could please we you i it this that these those has have had not no as if when why our my your his her their its about into until after before during each every new old please update signed attendees ask talked regards kind archive approve check review".split()) - {"old"}
_PLACES = set("station airport office park square hall bridge museum hospital school university house tower centre center island lake hotel river beach desk team lobby city county".split())


Weights = dict[tuple[str, ...], float]
START = "start"


def _step(before: str, kind: str, gap: int) -> tuple[str, ...]:
    """The feature of the step from one segment to the next."""
    return "step", before, kind, "near" if gap < NEAR else "far"


def decode(text: str, weights: Weights) -> list[tuple[int, int, str, tuple[str, ...]]]:
    """The sequence of segments of the greatest score. Far steps need only the best end before a place for each kind,
    so the time grows with the candidates, not with their pairs."""
    arcs = sorted(((b, a, kind, f) for a, b, kind, f in candidates(text)), key=lambda x: x[:3])
    if not arcs:
        return []
    done: dict[str, tuple[float, int]] = {}  # of each kind, the best sequence that ends far before
    lead = 0  # ends before it are far from all later starts, once sorted by start
    by_start = sorted(range(len(arcs)), key=lambda i: (arcs[i][1], arcs[i][0]))
    value = {i: sum(weights.get((arcs[i][2], x), 0.0) for x in arcs[i][3]) for i in by_start}
    scores, links = [0.0] * len(arcs), [-1] * len(arcs)
    ready: list[int] = []  # arcs in order of their ends, whose scores are known
    at = 0
    for i in by_start:
        b, a, kind, _ = arcs[i]
        while at < len(arcs) and arcs[at][0] <= a:
            ready.append(at)
            at += 1
        while lead < len(ready) and arcs[ready[lead]][0] <= a - NEAR:
            j = ready[lead]
            if scores[j] > done.get(arcs[j][2], (float("-inf"), -1))[0]:
                done[arcs[j][2]] = (scores[j], j)
            lead += 1
        top, link = weights.get(_step(START, kind, NEAR), 0.0), -1
        for before, (x, j) in done.items():
            if (y := x + weights.get(_step(before, kind, NEAR), 0.0)) > top:
                top, link = y, j
        for j in ready[lead:]:
            if (y := scores[j] + weights.get(_step(arcs[j][2], kind, a - arcs[j][0]), 0.0)) > top:
                top, link = y, j
        scores[i], links[i] = top + value[i], link
    i = max(range(len(arcs)), key=lambda i: scores[i])
    if scores[i] <= 0:
        return []
    out = []
    while i >= 0:
        b, a, kind, f = arcs[i]
        out.append((a, b, kind, f))
        i = links[i]
    return out[::-1]


# ---- composed training sentences -----------------------------------------------------------------------------------


def _compose(rng: random.Random) -> tuple[str, list[tuple[int, int, str]]]:
    syll = lambda n: "".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") + rng.choice(["", "l", "m", "n", "r", "s", "k"]) for _ in range(n))
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    made = lambda: syll(3).capitalize()
    surname = lambda: (syll(1) + rng.choice(SURNAME_ENDS)).capitalize() if rng.random() < 0.8 else made()
    cyrillic = lambda n: "".join(rng.choice("бвгдзклмнпрст") + rng.choice("аеио") + rng.choice(["", "л", "н", "р"]) for _ in range(n)).capitalize()
    listed = lambda: rng.choice(sorted(GIVEN)).capitalize()
    given = lambda: listed() if rng.random() < 0.7 else syll(2).capitalize()  # a third is in no list
    noun = lambda: rng.choice(sorted(w for w in _COMMON if w.isascii())).capitalize()

    def email() -> str:
        local = rng.choice([f"{given()}.{surname()}", f"{given()}+{syll(2)}", f"{syll(2)}{d(2)}", f"{surname()}-{given()}", f"{given()}_{surname()}"]).lower()
        at, dot = rng.choice([("@", ".")] * 6 + [(" @ ", "."), (" [at] ", " [dot] "), (" (at) ", "."), ("(at)", "(dot)"), (" at ", " dot ")])
        out = local + at + syll(2) + dot + rng.choice(["com", "org", "example", "test", "invalid", "net", "co"])
        out = out.upper() if rng.random() < 0.1 and at == "@" else out
        return ("mailto:" if rng.random() < 0.05 else "") + out

    def phone() -> str:
        return rng.choice([f"+1 {d(3)} 555 01{d(2)}", f"({d(3)}) 555-01{d(2)}", f"{d(3)}-555-01{d(2)}", f"{d(3)}.555.01{d(2)}", f"+1{d(10)}", f"555-01{d(2)}", f"+44 {d(4)} {d(6)}", f"0{d(4)} {d(6)}", f"0{d(4)} {d(3)} {d(3)}", f"020 7946 0{d(3)}", f"+49 {d(2)} {d(5)} {d(3)}", f"+49 {d(2)} {d(5)}-{d(3)}", f"0049 (0){d(2)} {d(5)}-{d(3)}", f"030 {d(5)} {d(3)}", f"+33 {d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"+61 {d(1)} {d(4)} {d(4)}", f"+34 {d(3)} {d(3)} {d(3)}", f"+7 ({d(3)}) {d(3)}-{d(2)}-{d(2)}"])

    def identity() -> tuple[str, str]:
        U = lambda: rng.choice("ABCDEFGHJKLMNPRSTXYZ")
        return rng.choice([("SSN ", f"{d(3)}-{d(2)}-{d(4)}"), ("SSN: ", d(9)), ("social security number ", f"{d(3)}-{d(2)}-{d(4)}"), ("tax ID ", f"{d(3)}-{d(2)}-{d(4)}"), ("national insurance no. ", f"{U()}{U()} {d(2)} {d(2)} {d(2)} {U()}"), ("NI number ", f"{U()}{U()}{d(6)}{U()}"), ("passport ", f"{U()}{d(7)}"), ("Passport No. ", f"{U()}{d(8)}"), ("driver licence ", f"{U()}{d(3)}-{d(4)}-{d(4)}"), ("Personalausweis ", f"{U()}{d(8)}"), ("ID card no. ", f"{U()}{d(2)}{U()}{d(5)}"), ("DNI ", f"{d(8)}-{U()}"), ("numéro de sécurité sociale ", f"{d(1)} {d(2)} {d(2)} {d(2)} {d(3)} {d(3)} {d(2)}"), ("numéro de sécurité sociale ", f"{d(1)} {d(2)} {d(2)} {d(2)} {d(2)} {d(3)} {d(3)}"), ("Steuer-ID ", f"{d(2)} {d(3)} {d(3)} {d(3)}"), ("NIE ", f"{U()}{d(7)}{U()}"), ("identity card ", f"{U()}{U()}{d(7)}"), ("CPF ", f"{d(3)}.{d(3)}.{d(3)}-{d(2)}")])

    def street() -> str:
        n, w = str(rng.randint(1, 1990)), made()
        out = rng.choice([f"{n} {w} {rng.choice(['Street', 'Lane', 'Drive', 'Road', 'Avenue', 'Way'])}", f"{n} {w} St., Unit {d(2)}", f"{n} N {w} Ave Apt {d(2)}B", f"{n}/{d(1)} {w} Crescent", f"Flat {d(2)}, {n} Old {w} Road", f"{n} {w.upper()} BLVD", f"{n} {made()} {made()} {made()} {w} {rng.choice(['Street', 'Road'])}", f"{n} {w.lower()} drive", f"{w}straße {n}", f"{w}weg {n}a", f"{w}platz {n}", f"{n} rue des {w}s", f"{n}, avenue du {w}", f"Calle {w} {n}, {d(1)} B", f"Avenida {w} {n}", f"Rua {w}, {n}", f"ul. {w} {n}"])
        return out

    def person() -> str:
        g, s = given(), surname()
        if rng.random() < 0.08:
            return f"{cyrillic(2)} {cyrillic(2)}{rng.choice(['ов', 'ова', 'ин', 'ский', 'енко', ''])}"
        if g.lower() not in GIVEN and rng.random() < 0.7:
            return f"{g} {s}"
        s = f"{s}-{surname()}" if rng.random() < 0.1 else s
        out = rng.choice([f"{g} {s}"] * 4 + [f"{s}, {g}", f"{g} {rng.choice('ABCDRS')}. {s}", f"{rng.choice(['Mr.', 'Mrs.', 'Ms', 'Dr.', 'Prof.', 'Herr', 'Frau', 'Mme', 'Mr'])} {s}"])
        return rng.choice([out] * 8 + [out.upper(), out.lower()])

    carriers = {
        "email": ["Write to {} about the plan.", "Inbox - {}", "Re: notes - {}", "cc {} on the reply.", "From: {}", "Forward it to {}, please.", "Login of {} at noon.", "{} - Mail", "No answer from {} so far.", "Write to <{}> soon."],
        "phone": ["Call {} when it lands.", "Tel. {}, then wait.", "Text {} when you are there.", "Two rings from {} today.", "You reach me at {}, always.", "Message from {}", "{} - Chats", "Call {}", "Phone: {}", "Fax {}"],
        "id_number": ["She sent us {} last week.", "We hold {} on file.", "Compare {} with our copy.", "Scan of {}", "{} - Reader", "Entry {}", "Do not print {} here."],
        "street_address": ["Bring it to {} on Sunday.", "We live at {}, top floor.", "She moved to {}. Tell the others.", "Way to {}", "{} - Maps", "Visit {} (new)", "A van stood before {} all day."],
        "person_name": ["Drawn up by {} for the board.", "Present: {} and two others.", "Kind regards,\n{}\nThe desk.", "I spoke to {} about it.", "Ask {} why.", "{} will confirm it on Monday.", "{}: can you check the plan?", "Re: plan from {}", "Lunch {} - Calendar", "{} | Account", "Please thank {} for the plan.", "Подписал {} для отдела.", "Участники: {} и отдел.", "Contact: {}", "Dear {},", "Please invite {} as well.", "We met {} at the fair.", "The call with {} went well.", "Our teacher was {} then.", "{} has the keys.", "{} and the others left.", "{} wrote it down.", "Owner: {}", "It was moved by {} today.", "The box for {} came.", "Hello {},", "They told {} about it.", "Is {} in?", "The lawyer, {}, agreed.", "Cheers, {}", "Speaker: {}", "Host: {}", "On the line: {}."],
    }
    decoys = [f"Meeting ID: {d(3)} {d(3)} {d(3)}", f"Order {d(4)}-{d(3)}-{d(5)} has left the depot.", f"Ticket #{d(6)} was merged into version {d(1)}.{d(3)}.{d(1)} of it.", f"Build {d(5)}.{d(3)}.{d(3)} fixed {d(3)} issues.", f"Serial {d(5)}-{d(3)}-B belongs to the scanner.", f"Use error code E-{d(3)}-{d(3)} here.", f"Tracking code ZX{d(5)}QP shows no movement.", f"Invoice {d(3)}-{d(3)} · Due Friday", f"Ping @{syll(3)} in the channel.", f"The train from {given()} Station leaves at {d(1)}:00.", f"The {given()} office keeps the plan.", f"The {made()} folder holds {d(3)} items in room {d(3)}.", f"We moved {made()} to hall {d(1)} at {d(1)} pm.", f"Costs for {made()} rose to €{d(3)} after the count, $1,{d(3)}.50 in all.", f"Quarter Ledger and {made()} Notes are the plans.", f"{made()} asked for {d(3)} copies by Monday, with the {syll(2)} team.", f"Two changes to the {made()} roadmap came back.", f"See https://docs.example/{syll(3)}/plan for it.", f"Gate {d(3)} · Boarding {d(2)}:{d(2)} · Row {d(3)}", f"The score was {d(3)}:{d(3)} after extra time.", f"Please rename {made()} and leave room {d(3)} in the way.", f"The street team took {d(2)} copies on the way to the court.", f"Ms in the {made()} file means manuscript.", f"v{d(1)}.{d(3)}.{d(1)} (build {d(3)})", f"For {made()}, the review takes place in room {d(3)} at {d(1)} pm.", f"The review takes place in hall {d(1)} by {d(1)}:30 pm.", f"For {made()}, the review takes place in the {syll(2)} {rng.choice(['at', 'by', 'around'])} {d(1)}{rng.choice(['', ' pm', ':30 pm', '1'])}.", f"It takes place in lab B at {d(1)}.", f"It went via {made()} at {d(1)}, with {d(3)} copies on the way.", f"They drive {d(2)} copies to {made()} in row {d(2)}.", f"Room {d(3)}, Tuesdays {d(2)}:{d(2)}", f"{made()} rang at {d(2)}; the ring {d(2)} came late.", f"Please check the {made()} budget and leave the next one in desk {d(2)}.", f"{noun()} {noun()} - {noun()}", f"Signed by the {noun()} {noun()} team.", f"{noun()} {made()} is with the {noun()} {noun()} desk.", f"We moved {made()} {noun()} to {noun()}.", f"Re: {made()} {noun()}", f"From {noun()} {made()} to {noun()} {noun()}", f"{made()} {noun()} | {noun()}", f"{noun()} for {made()}. {made()} agrees.", f"Ask {noun()} {noun()} or {noun()} {made()}.", f"{cyrillic(2)} и {cyrillic(3)}. Отчёт {cyrillic(3)} готов.", f"Please send {noun()} {made()} with {noun()} {noun()}.", f"{syll(2).capitalize()} {made()}", f"{made()} {made()}…", f"{syll(2).capitalize()} {made()} - {noun()}", f"{syll(3).capitalize()} {made()}", f"{syll(3).capitalize()} {syll(2)}{rng.choice(SURNAME_ENDS)}", f"{syll(2).capitalize()} {(syll(2) + rng.choice(SURNAME_ENDS)).capitalize()}", f"Meeting ID: {d(3)} {d(2)} {d(3)}", f"Meeting ID: {d(3)} {d(3)} {d(2)} · {noun()}"]
    parts, gold, at = [], [], 0
    for _ in range(rng.randint(1, 3)):
        if rng.random() < 0.4:
            s = rng.choice(decoys)
        else:
            kind = rng.choice(KINDS)
            cue, value = identity() if kind == "id_number" else ("", {"email": email, "phone": phone, "street_address": street, "person_name": person}[kind]())
            head, tail = rng.choice(carriers[kind]).split("{}")
            a = at + len(head) + len(cue)
            gold.append((a, a + len(value), kind))
            s = head + cue + value + tail
        sep = rng.choice([" ", "\n", " · "])
        parts += [s, sep]
        at += len(s) + len(sep)
    return "".join(parts), gold


def composed(n: int, seed: int) -> list[tuple[str, list[tuple[int, int, str]]]]:
    rng = random.Random(seed)
    return [_compose(rng) for _ in range(n)]


def _lattice(text: str, gold: list[tuple[int, int, str]], number: dict) -> tuple[list, set[int]]:
    """A sentence's arcs ``(end, start, kind, feature numbers)``, by ends, and the ordinals of the true ones: of each
    true segment, the candidate of its kind that shares most with it."""
    arcs = sorted((b, a, k, [number.setdefault((k, x), len(number)) for x in f]) for a, b, k, f in candidates(text))
    want = set()
    for a, b, k in gold:
        near = [i for i, x in enumerate(arcs) if x[2] == k and min(b, x[0]) > max(a, x[1])]
        if near:
            want.add(max(near, key=lambda i: min(b, arcs[i][0]) - max(a, arcs[i][1]) - 0.9 * (max(0, arcs[i][0] - b) + max(0, a - arcs[i][1]))))
    return arcs, want


def marginals(arcs: list, scores: list[float], step) -> tuple[float, np.ndarray, list[tuple[int, int, float]]]:
    """Log Z, each arc's probability, and each step's ``(from, to, probability)``, from being -1 at the start.
    ``step(i, j)`` is the weight of the step from arc i, or -1, to arc j."""
    n = len(arcs)
    ahead: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    alpha, edges = [0.0] * n, []
    for j in range(n):
        ways = [(-1, step(-1, j))] + [(i, alpha[i] + step(i, j)) for i in range(j) if arcs[i][0] <= arcs[j][1]]
        top = max(v for _, v in ways)
        alpha[j] = scores[j] + top + math.log(sum(math.exp(v - top) for _, v in ways))
        edges += [(i, j, v) for i, v in ways]
        for i, v in ways:
            if i >= 0:
                ahead[i].append((j, v - alpha[i]))
    top = max(alpha, default=0.0)
    top = max(top, 0.0)
    log_z = top + math.log(math.exp(-top) + sum(math.exp(v - top) for v in alpha))
    beta = [0.0] * n
    for i in range(n - 1, -1, -1):
        beta[i] = math.log1p(sum(math.exp(w + scores[j] + beta[j]) for j, w in ahead[i]))
    p = np.exp(np.array([alpha[i] + beta[i] - log_z for i in range(n)]))
    return log_z, p, [(i, j, math.exp(v + scores[j] + beta[j] - log_z)) for i, j, v in edges]


@lru_cache(1)
def trained() -> Weights:
    """Weights of the greatest penalised likelihood found; the same in every run."""
    number: dict[tuple[str, ...], int] = {}
    rows = [_lattice(t, gold, number) for t, gold in composed(SENTENCES, SEED)]
    kinds = (START, *KINDS)
    steps = {(a, b, near): number.setdefault(_step(a, b, 0 if near else NEAR), len(number)) for a in kinds for b in KINDS for near in (False, True)}
    w, square = np.zeros(len(number)), np.full(len(number), 1e-8)
    flat = [np.array([x for arc in arcs for x in arc[3]], dtype=np.int64) for arcs, _ in rows]
    owner = [np.repeat(np.arange(len(arcs)), [len(arc[3]) for arc in arcs]) for arcs, _ in rows]
    rng = random.Random(SEED)
    order = [i for i, (arcs, _) in enumerate(rows) if arcs]

    def places(arcs: list):
        return lambda i, j: steps[(START, arcs[j][2], False) if i < 0 else (arcs[i][2], arcs[j][2], arcs[j][1] - arcs[i][0] < NEAR)]

    for _ in range(ROUNDS):
        rng.shuffle(order)
        for at in range(0, len(order), BATCH):
            grad = -PENALTY * len(rows) / BATCH * w
            for r in order[at : at + BATCH]:
                arcs, want = rows[r]
                place = places(arcs)
                scores = np.bincount(owner[r], weights=w[flat[r]], minlength=len(arcs))
                _, p, taken = marginals(arcs, scores.tolist(), lambda i, j: w[place(i, j)])  # noqa: B023
                real = np.zeros(len(arcs))
                real[list(want)] = 1.0
                np.add.at(grad, flat[r], (real - p)[owner[r]])
                for i, j, q in taken:
                    grad[place(i, j)] -= q
                last = -1
                for j in sorted(want):
                    grad[place(last, j)] += 1.0
                    last = j
            square += grad * grad
            w += RATE * grad / np.sqrt(square)
    return {f: float(w[i]) for f, i in number.items() if abs(w[i]) > 1e-3}


def mentions(text: str | None, weights: Weights | None = None) -> list[tuple[int, int, str]]:
    """Segments of personal information of a text in its one form. A name inside an email or address is none."""
    if not text:
        return []
    return [(a, b, k) for a, b, k, _ in decode(text, weights or trained())]


def redact(text: str | None, found: list[tuple[int, int, str]]) -> str | None:
    if text is None:
        return None
    parts, at = [], 0
    for a, b, kind in found:
        parts += [text[at:a], PLACEHOLDERS[kind]]
        at = b
    return "".join([*parts, text[at:]])


def personal(values: DataFrame) -> DataFrame:
    """``(row_id, field, value)`` to ``(row_id, field, kinds, redacted)`` for each value with personal information.

    ``redacted`` is the value in its one form with typed placeholders. Nulls and empty values hold none; repeated rows
    come out repeatedly; other columns are dropped. Long values are read whole.
    """
    weights = trained()
    rows = values.where(F.col("value").isNotNull()).select("row_id", "field", "value")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for row, field, value in zip(b["row_id"], b["field"], b["value"]):
                text = canonical(value)[0]
                if found := mentions(text, weights):
                    out.append((row, field, sorted({k for _, _, k in found}), redact(text, found)))
            yield pd.DataFrame(out, columns=["row_id", "field", "kinds", "redacted"])

    return rows.mapInPandas(scan, "row_id long, field string, kinds array<string>, redacted string")


def kinds_found(values: DataFrame) -> DataFrame:
    """``(row_id, field, kind)``: one row for each kind in each value."""
    return personal(values).select("row_id", "field", F.explode("kinds").alias("kind"))
