import pytest

from inkfold.llm import lookalike as L
from inkfold.llm import pii

SAME = ["café", "“quoted” – dash… €5 ☆", "👩‍💻 typing", "Отчёт готов, спасибо. The folder holds 5 items.", "Übersicht 3.º ½ µs", "日本語　テキスト（ＡＢ）", "", "plain", None, "не с Kimgikbim а в лабу", "عربي‌متن"]
CASES = {
    "ｔｈｅ ｄｅｓｋ": "the desk",
    "café": "café",
    "up​dated manual": "updated manual",
    "invоicе": "invoice",
    "Untⅰtⅼeⅾ": "Untitled",
    "Ι’ll approve": "I’ll approve",
    "В пaпке лежит": "В папке лежит",
    "𝖻𝗅𝖺𝗇𝗄 oﬃce traininɡ": "blank office training",
    "Νolkοlres Kallik": "Nolkolres Kallik",
    "see the х axis": "see the x axis",
}


@pytest.mark.parametrize("value", SAME)
def test_left_alone(value):
    assert L.canonical(value) == (value, False)


@pytest.mark.parametrize("value,want", CASES.items())
def test_one_form(value, want):
    assert L.canonical(value) == (want, True)
    assert L.canonical(want)[0] == want


def test_script_sets():
    assert L.resolved("abc") == {"Latin"} and L.resolved("аbc") == frozenset() and L.resolved("123") is None
    assert L.resolved("漢字かな") == {"Jpan"}


def test_lookalikes_edges(spark):
    rows = [(1, "text", "ｘ", "k"), (1, "text", "ｘ", "k"), (2, "text", None, "k"), (3, "t", "", "k"), (4, "text", "a" * 50_000 + "​", "k")]
    df = spark.createDataFrame(rows, "row_id long, field string, value string, canonical string")
    r = L.lookalikes(df).collect()
    assert sorted(x.row_id for x in r) == [1, 1, 4] and L.lookalikes(df.limit(0)).count() == 0
    one = L.unify(df, "value", "out").collect()
    assert {(x.row_id, x.out if x.row_id != 4 else "long") for x in one} == {(1, "x"), (2, None), (3, ""), (4, "long")}


def test_held_out_accuracy():
    right = wrong = missed = 0
    for text, gold in pii.composed(400, 4242):
        want = sorted(k for _, _, k in gold)
        got = sorted(k for _, _, k in pii.mentions(text))
        both = sum(min(got.count(k), want.count(k)) for k in pii.KINDS)
        right, wrong, missed = right + both, wrong + len(got) - both, missed + len(want) - both
    assert right / (right + wrong) > 0.97 and right / (right + missed) > 0.97


@pytest.mark.parametrize(
    "text,kinds",
    [
        ("Write to rosa.holby@desk.test about it.", ["email"]),
        ("cc petra+x (at) hub.test on the reply", ["email"]),
        ("Call +49 30 23125 144 when it lands", ["phone"]),
        ("The form lists SSN 915-19-5940 as proof.", ["id_number"]),
        ("Pick up is at 1831 Lussemsan Lane, second door.", ["street_address"]),
        ("Deliver it to Molnermalstraße 48 on Sunday", ["street_address"]),
        ("Kind regards,\nTessa Tharbery\nThe training desk", ["person_name"]),
        ("Attendees: Ostdrake, Umar and the legal team", ["person_name"]),
        ("Meeting ID: 381 164 284", []),
        ("Order 4467-203-88781 has left the depot.", []),
        ("The train from Victoria Station leaves at 8:00.", []),
        ("Ping @zamfokgum in the channel", []),
        ("The review takes place in the corner office at 9. Don’t wait.", []),
        ("", []),
        (None, []),
    ],
)
def test_mentions(text, kinds):
    assert [k for _, _, k in pii.mentions(text)] == kinds


HELD_OUT = "Thandiwe Nkosi|Siobhan Gallagher|Xiaoming Zhang|Priyanka Chatterjee|Margaret Thatcher|Oluwaseun Adebayo|Guadalupe Hernández|Björn Þórsson|Wojciech Szymański|Chukwuemeka Obi|Ewelina Kowalczyk|Rajesh Subramanian|Abdulrahman Al-Farsi|Marguerite Duras|Théodore Géricault|Ludmila Petrenko|Hyun-woo Park|Nguyễn Minh|Aoife Byrne|Desmond Tutu|Zbigniew Herbert|Giuseppe Verdi|Eleanor Roosevelt|Kwame Nkrumah|Sigrid Undset|Halldór Laxness|Ngozi Eze|Takeshi Kitano|Anneliese Rothenberger|Fyodor Karamazov".split("|")
HELD_OUT_CARRIERS = ["The parcel was collected by {} this morning.", "Please invite {} to the review.", "I spoke with {} about the invoice.", "{} has approved the budget.", "Thanks, {}", "Interview with {} on Thursday", "Our new colleague is {}.", "Could you forward this to {}?", "Sent by {}, finance.", "Guest: {}", "{} and the design team agreed.", "Escalated to {} yesterday.", "We told {} that the draft is late.", "Assigned to {}"]
CAPITALS = ["The Quarterly Review takes place on Monday.", "Please open Project Falcon before lunch.", "Status: Draft Approved", "Gate 12, Boarding Now", "The Green Door cafe is closed.", "Search Results - Archive", "Invoice Overdue Notice", "New Message From Support", "Team Calendar | Shared View", "Golden Bridge Museum opens at nine.", "Download Complete", "The Annual Report for Veltrix is ready.", "Meeting Notes - Veltrix Rollout", "Central Park is crowded.", "Happy Friday Everyone"]


def test_names_and_carriers_that_training_never_saw():
    """Names of many languages, of which no list has a word, in sentences that no carrier has."""
    assert not {w.lower() for n in HELD_OUT for w in n.split()} & pii.GIVEN
    found = wrong = 0
    for carrier in HELD_OUT_CARRIERS:
        for name in HELD_OUT:
            text = carrier.format(name)
            got = [text[a:b] for a, b, k in pii.mentions(text)]
            found += name in got
            wrong += sum(x != name for x in got)
    wrong += sum(len(pii.mentions(t)) for t in CAPITALS)
    total = len(HELD_OUT) * len(HELD_OUT_CARRIERS)
    assert found / total > 0.9 and found / (found + wrong) > 0.9


def test_probabilities_equal_those_of_all_sequences():
    """Z, each segment's probability and each step's against the sum over all sequences of segments."""
    import itertools
    import math
    import random

    rng = random.Random(3)
    arcs = sorted((a + rng.randint(1, 6), a, rng.choice(pii.KINDS), []) for a in (rng.randrange(20) for _ in range(8)))
    scores = [rng.uniform(-2, 2) for _ in arcs]
    weight = {(i, j): rng.uniform(-1, 1) for i in range(-1, 8) for j in range(8)}
    log_z, p, steps = pii.marginals(arcs, scores, lambda i, j: weight[i, j])
    z, one, two = 0.0, [0.0] * 8, {}
    for n in range(9):
        for seq in itertools.combinations(range(8), n):
            if all(arcs[i][0] <= arcs[j][1] for i, j in zip(seq, seq[1:])):
                w = math.exp(sum(scores[j] for j in seq) + sum(weight[i, j] for i, j in zip((-1, *seq), seq)))
                z += w
                for i, j in zip((-1, *seq), seq):
                    one[j] += w
                    two[i, j] = two.get((i, j), 0.0) + w
    assert abs(log_z - math.log(z)) < 1e-9 and all(abs(a - b / z) < 1e-9 for a, b in zip(p, one))
    assert all(abs(q - two.get((i, j), 0.0) / z) < 1e-9 for i, j, q in steps)


def test_segments_of_any_length():
    street = "12345 " + "Verylongname " * 12 + "Street"
    mail = "a" * 150 + "@" + "b.c." * 12 + "example.com"
    for text, kind, value in ((f"Deliver it to {street} on Sunday.", "street_address", street), (f"Write to {mail} now", "email", mail)):
        assert [(text[a:b], k) for a, b, k in pii.mentions(text)] == [(value, kind)]


@pytest.mark.parametrize("name", ["Liam Smith", "Sophie Martin", "Brandon Cooper", "Иван Петров", "Мария Соколова"])
@pytest.mark.parametrize("carrier", ["Signed by {} for the team.", "Attendees: {} and the legal team.", "Kind regards,\n{}\nThe desk.", "Ask {} where it went."])
def test_names_of_no_list(name, carrier):
    assert not {w.lower() for w in name.split()} & pii.GIVEN
    text = carrier.format(name)
    assert pii.redact(text, pii.mentions(text)) == carrier.format("[NAME]")


@pytest.mark.parametrize("text", ["Quarter Ledger and Monday Notes are the plans.", "Please check the Budget Review on Monday.", "Überblick Zorpeknum", "Loading Mannasvor…", "Meeting ID: 905 88 372"])
def test_capitals_that_are_no_names(text):
    assert pii.mentions(text) == []


def test_redaction_reads_on():
    t = "Ask Olga Rudshaw; write to olga@hub.test or call +1 608 555 0144."
    assert pii.redact(t, pii.mentions(t)) == "Ask [NAME]; write to [EMAIL] or call [PHONE]."


def test_personal_edges(spark):
    rows = [(1, "v", "SMS +33 1 99 00 72 27 - Messages", "x")] * 2 + [(2, "v", None, "x"), (3, "v", "", "x"), (4, "v", "word " * 20_000 + "a.b@c.test", "x")]
    df = spark.createDataFrame(rows, "row_id long, field string, value string, kinds string")
    r = pii.kinds_found(df).collect()
    assert sorted((x.row_id, x.kind) for x in r) == [(1, "phone"), (1, "phone"), (4, "email")] and pii.kinds_found(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    "value,form",
    [("ꓑaypal", "Paypal"), ("ɢoogle", "google"), ("𐐬pen", "open"), ("ⲟpen", "open"), ("ᴀpple", "apple"), ("ҽxample", "example"), ("Noёl", "Noël"), ("schӧn", "schön"), ("naїve", "naïve"), ("canciόn", "canción"), ("the fıle ıs here", "the file is here"), ("Mocквa", "Москва")],
)
def test_letters_of_many_scripts(value, form):
    assert L.canonical(value) == (form, True) and L.canonical(form) == (form, False)


@pytest.mark.parametrize("value", ["kapı", "ışık", "Paragraph kapı çok güzel", "βeta", "/ˈɡɑːdən/ garden", "αβγ test", "Это сосна"])
def test_letters_that_are_what_they_are(value):
    assert L.canonical(value) == (value, False)
