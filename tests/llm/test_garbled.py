"""Round trips of garbled text: every pair of encodings, every language, many layers."""

import pytest

from inkfold.llm import garbled as g

TEXTS = {
    "de": "Während der Prüfung hat das Büro die Übersicht gelöscht, der Schlüssel für die Tür ist größer.",
    "fr": "Très bien, le modèle est prêt après le déjeuner avec la gérante, où est passé le dernier relevé ?",
    "es": "El teléfono llegó el miércoles por la mañana y el señor pidió más páginas para el índice según el catálogo.",
    "pt": "A reunião com a gerência ficou para amanhã, você já enviou a versão do relatório para a correção ?",
    "pl": "Żółta teczka leży obok drukarki, czy możesz przesłać jeszcze raz fakturę do piątku ?",
    "ru": "Спасибо, черновик уже подписан, если директор согласен, договор можно закрыть в пятницу.",
    "ja": "昨日、新しい請求書が届きました。この予定表はまだ下書きです。",
    "en": "It isn’t sure – “ask the desk first” costs €40 … and that’s all.",
}


def garble(text: str, true: str, wrong: str) -> str | None:
    """The text read wrongly; None if the encodings cannot hold it or the reading loses bytes."""
    try:
        data = text.encode(true)
    except UnicodeEncodeError:
        return None
    out = g.read(data, wrong)
    return None if "�" in out else out


@pytest.mark.parametrize("lang", TEXTS)
@pytest.mark.parametrize("wrong", g.SINGLE)
def test_utf8_read_in_single_bytes(lang, wrong):
    bad = garble(TEXTS[lang], "utf-8", wrong)
    assert g.restore(bad) == (TEXTS[lang], True)
    mixed = f"{TEXTS[lang]}\n{bad}\nplain line"
    assert g.restore(mixed) == (f"{TEXTS[lang]}\n{TEXTS[lang]}\nplain line", True)


@pytest.mark.parametrize("lang", TEXTS)
@pytest.mark.parametrize("wrong", ["latin-1", "cp1252", "mac_roman", "cp437", "cp1251", "koi8-r"])
@pytest.mark.parametrize("layers", range(2, 9))
def test_garbled_many_times(lang, wrong, layers):
    bad = TEXTS[lang]
    for _ in range(layers):
        bad = g.read(bad.encode(), wrong)
        if len(bad) > 20_000:
            break
    assert g.restore(bad) == (TEXTS[lang], True)


def test_layers_of_different_pairs():
    for text in TEXTS.values():
        bad = text
        for wrong in ("cp1252", "mac_roman", "latin-1", "cp850"):
            bad = g.read(bad.encode(), wrong)
        assert g.restore(bad) == (text, True)


@pytest.mark.parametrize("pair", [("cp932", "cp1252"), ("cp932", "latin-1"), ("cp932", "mac_roman"), ("euc_jp", "latin-1"), ("euc_jp", "cp1252"), ("euc_jp", "koi8-r")])
def test_japanese_bytes(pair):
    bad = garble(TEXTS["ja"], *pair)
    assert bad and g.restore(bad) == (TEXTS["ja"], True)
    assert g.restore(f"lead: {bad} Row 4")[0] == f"lead: {TEXTS['ja']} Row 4"


def test_japanese_read_as_half_width():
    text = "このてきすとはここにない"
    assert g.restore(garble(text, "euc_jp", "cp932")) == (text, True)


def test_utf8_read_as_cp932_keeps_what_it_cannot_tell():
    for text in ("新しいメモが木曜日までに確認します。", "昨日、新しい契約書が届きました。", "予定表はBinfumponです。"):
        bad = text.encode().decode("cp932", "replace")
        got, hit = g.restore(bad)
        assert hit
        parts = got.split("�")
        at = 0
        for p in parts:  # what stands between lost bytes stood in the text, in that order
            assert p in text[at:], (bad, got)
            at = text.index(p, at) + len(p)
        assert sum(map(len, parts)) * 3 >= 2 * len(text)


SLAVIC = [(a, b) for a in g.SLAVIC for b in g.SINGLE if a != b]


@pytest.mark.parametrize("pair", SLAVIC)
def test_cyrillic_in_single_bytes(pair):
    text = "Спасибо, черновик уже подписан, если директор согласен, договор можно закрыть в пятницу."
    bad = garble(text, *pair)
    if bad is None or bad == text:
        pytest.skip("the pair cannot hold it")
    got, hit = g.restore(bad)
    assert hit == (got != bad)
    if pair != ("cp1251", "mac_cyrillic") and pair != ("mac_cyrillic", "cp1251"):  # they differ in few letters
        assert got == text, (bad, got)


@pytest.mark.parametrize("lang,pair", [(lang, p) for lang in ("de", "fr", "es", "pt") for p in (("mac_roman", "cp1252"), ("mac_roman", "latin-1"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("cp850", "latin-1"), ("cp437", "latin-1"), ("cp1252", "mac_roman"), ("cp1252", "cp437"), ("cp1252", "cp850"), ("cp1252", "cp1251"), ("cp1252", "koi8-r"), ("cp1252", "cp866"))] + [("pl", p) for p in (("cp1250", "cp1252"), ("cp1250", "latin-1"), ("iso8859-2", "cp1252"), ("iso8859-2", "latin-1"), ("cp852", "cp1252"))])
def test_latin_in_single_bytes(lang, pair):
    """Found always; restored but for letters that the other bytes of the line leave open."""
    bad = garble(TEXTS[lang], *pair)
    if bad is None:
        pytest.skip("the pair cannot hold it")
    got, hit = g.restore(bad)
    assert hit, bad
    wrong_letters = sum(a != b for a, b in zip(got, TEXTS[lang]))
    assert len(got) == len(TEXTS[lang]) and wrong_letters <= 0.02 * len(got), (bad, got)


def test_correct_text_is_left_alone():
    for text in [*TEXTS.values(), "SÃO PAULO, NÃO APAGUE, GÂTEAU, MAÇÃ", "→ ☆☆☆ 👩‍💻 №5", "R&amp;D &#8217; café", "Ελληνικά κείμενα", "日本語のカタカナ", "", "ASCII only"]:
        assert g.restore(text) == (text, False)
    assert g.restore(None) == (None, False)


def test_entities_of_garbled_characters():
    bad = "".join(f"&#{ord(c)};" if ord(c) > 127 else c for c in garble(TEXTS["es"], "utf-8", "cp1252"))
    assert g.restore(bad) == (TEXTS["es"], True)
    assert g.restore(bad.replace("&#195;", "&#xC3;")) == (TEXTS["es"], True)


def test_lost_no_break_space_and_lost_bytes():
    bad = garble("Il est déjà vu à côté", "utf-8", "cp1252").replace(" ", " ")
    assert g.restore(bad) == ("Il est déjà vu à côté", True)
    assert g.restore("caf� near") == ("caf� near", True)


def test_rows(spark):
    bad = garble(TEXTS["fr"], "utf-8", "cp1252")
    rows = spark.createDataFrame([(1, bad, "x"), (1, bad, "x"), (2, None, "y"), (3, "", "z"), (4, "plain", None), (5, (TEXTS["de"] + " ") * 3000 + bad, "long")], "doc_id long, text string, restored string")
    got = g.garbled(rows).orderBy("doc_id").collect()
    assert [r["doc_id"] for r in got] == [1, 1, 5] and got[0]["restored"] == TEXTS["fr"] and got[2]["restored"].endswith(TEXTS["fr"])
    assert g.garbled(rows.limit(0)).count() == 0


@pytest.mark.parametrize("lang,wrote", [("de", "latin-1"), ("fr", "cp1252"), ("es", "cp1252"), ("en", "cp1252"), ("ru", "cp1251"), ("ru", "koi8-r"), ("ru", "cp866"), ("ja", "cp932"), ("ja", "euc_jp")])
def test_lines_in_other_bytes(lang, wrote):
    text = TEXTS[lang]
    assert g.decoded(text.encode()) == (text, False)
    got, broken = g.decoded(f"{TEXTS['fr']}\n".encode() + text.encode(wrote))
    assert broken and g.restore(got)[0] == f"{TEXTS['fr']}\n{text}"


def test_lost_and_stray_bytes():
    assert g.decoded("Größe über".encode()[:-4]) == ("Größe �", True)
    assert g.decoded("it’s".encode()[:4]) == ("it�", True) == g.decoded("it’s".encode()[:3])
    assert g.decoded(b"one caf\xe9") == ("one café", True)
    assert g.decoded("昨日、新しい".encode()[:5] + "新しい".encode()) == ("昨�新しい", True)
    assert g.decoded("naïve � ".encode() + b"caf\xe9 bar") == ("naïve � café bar", True)


def test_rows_that_are_no_utf8(spark):
    bad = garble(TEXTS["fr"], "utf-8", "cp1252")
    rows = spark.createDataFrame([(1, bytearray(bad.encode())), (2, bytearray(TEXTS["de"].encode("latin-1"))), (3, bytearray(bad.encode() + b"\xe2\x80")), (4, None), (5, bytearray(b"plain"))], "doc_id long, b binary")
    got = g.garbled(rows.selectExpr("doc_id", "cast(b as string) as text")).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == [(1, TEXTS["fr"]), (2, TEXTS["de"]), (3, TEXTS["fr"] + "�")]
