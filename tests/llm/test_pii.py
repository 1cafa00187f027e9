import random
import re

import pytest

from tidemark.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(kind, text):
    out = []
    for m in re.finditer(PLAIN[kind], text):
        digits = re.sub("[^0-9]", "", m[0])
        good = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else 0, "card": 13 <= len(digits) <= 19 and pii.luhn(digits or "1"), "phone": 9 <= len(digits) <= 15}[kind]
        if good:
            out.append(m.span())
    return out


def test_base_spans_are_those_of_the_plain_patterns():
    r = random.Random(4)
    for _ in range(6000):
        text = "".join(r.choice(r.choice(["ab", "0123456789", "@.", "+- ()", "1", "@", "."])) for _ in range(r.randrange(60)))
        assert pii.base_spans(text) == [plain(k, text) for k in pii.KINDS], text


def test_long_runs_take_linear_time():
    for c in ("1", "a", "@", "a@", "1.", "+1", "one ", "at "):
        pii.find(c * 50_000)


@pytest.mark.parametrize("kind, text, found", [
    ("email", "write to jane.doe [at] example [dot] com now", "jane.doe [at] example [dot] com"),
    ("email", "write to jane at example dot com.", "jane at example dot com"),
    ("email", "x jane(at)example.org y", "jane(at)example.org"),
    ("email", "x jane@example[.]org y", "jane@example[.]org"),
    ("email", "mail jаne@exаmple.com ok", "jаne@exаmple.com"),
    ("email", "mail jane＠example．com ok", "jane＠example．com"),
    ("email", "mail ja​ne@exam​ple.com ok", None),
    ("card", "card four one one one one one one one one one one one one one one one end", "four one one one one one one one one one one one one one one one"),
    ("card", "card 4111 1111 1111 llll end", "4111 1111 1111 llll"),
    ("card", "card ４１１１１１１１１１１１１１１１ end", "４１１１１１１１１１１１１１１１"),
    ("phone", "call plus four nine one five one two three four five six seven now", "plus four nine one five one two three four five six seven"),
    ("ip", "host one nine two dot one six eight dot one dot seven end", "one nine two dot one six eight dot one dot seven"),
])
def test_disguises(kind, text, found):
    _, every = pii.find(text)
    got = [text[a:b] for a, b in every[pii.KINDS.index(kind)]]
    assert got == [found] if found else len(got) == 1


@pytest.mark.parametrize("text", ["We met at home. The one two three of it.", "look at the dot on the map", "at one at two at three", "seven of nine, six of ten", "Она сказала о том"])
def test_prose_is_left_alone(text):
    assert pii.find(text)[1] == [[], [], [], []]


def test_frame(spark):
    docs = spark.createDataFrame([(1, "a@b.c 1.2.3.4", 1), (1, "a@b.c 1.2.3.4", 1), (2, None, 2), (3, "", 3), (None, "+49 151 1234567", 4)], "doc_id long, text string, spans int")
    rows = pii.spans(docs).collect()
    assert all(r.n_all == r.n_email + r.n_ip + r.n_card + r.n_phone for r in rows)
    got = sorted(((r.doc_id, r.n_email, r.n_ip, r.n_phone, r.spans) for r in rows), key=str)
    assert got == sorted([(1, 1, 1, 0, "email:0:5,ip:6:13")] * 2 + [(2, 0, 0, 0, ""), (3, 0, 0, 0, ""), (None, 0, 0, 1, "phone:0:15")], key=str)
    assert pii.spans(docs.limit(0)).count() == 0


@pytest.mark.parametrize("text", [
    "192[.]168[.]1[.]10", "10(dot)0(dot)0(dot)1", "192 dot 168 dot 1 dot 10", "1O.O.O.1", "192.168[.]1.10", "192 [dot] 168 [dot] l [dot] 10", "one nine two dot 168 dot 1 dot seven", "1o.2oo.3.4",
    "192<dot>168<dot>1<dot>10", "8 punkt 8 punkt 8 punkt 8",
])
def test_disguised_addresses_of_hosts(text):
    whole = f"see {text}, or not"
    base, every = pii.find(whole)
    assert base[1] == [] and [whole[a:b] for a, b in every[1]] == [text]


@pytest.mark.parametrize("text", ["256[.]1[.]1[.]1", "1 dot 2 dot 3", "I.O.l.o", "1234[.]1[.]1[.]1", "192[.]168[.]1[.]1000", "a 5 dot b 6 dot c"])
def test_what_is_no_address_of_a_host(text):
    assert pii.find(f"see {text}, or not")[1][1] == []


def test_gates_let_through_all_that_their_searches_find(monkeypatch):
    r = random.Random(6)
    names = ["one", "Eight", "null", "cinq", "oh", "seven", "192", "8", "1O", "l", "255", "x", "ſix"]
    joints = ["[dot]", "(dot)", " dot ", "[.]", ".", " [dot] ", "{punkt}", " ", ", ", "-", "«", "(", "\n", "_"]
    seen = 0
    for _ in range(20_000):
        text = "".join(r.choice(names) + r.choice(joints[:6] if r.random() < 0.7 else joints) for _ in range(r.randrange(3, 9)))
        for soon, find in ((pii._spelled_soon, pii._spelled), (pii._QUAD_SOON.search, pii._quads)):
            edits = find(text)
            assert not edits or soon(text), text
            seen += bool(edits)
    assert seen > 2000
    assert pii._spelled_soon("eight[dot]eight[dot]eight[dot]eight") and pii._spelled_soon("one(dot)one(dot)one(dot)one")


def test_disguises_in_a_very_long_text():
    lead = "some words, and 12 numbers at a dot. " * 20_000
    text = lead + "joe1 [at] site [dot] com, " + lead
    _, found = pii.find(text)
    assert (len(lead), len(lead) + len("joe1 [at] site [dot] com")) in found[0]
