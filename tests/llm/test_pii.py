import random
import re

import pytest

from fleetspectra.llm.pii import Tape, disguised_spans, find_pii, luhn, normalised, plain_spans
from fleetspectra.llm.queries import QUERIES

CARD = "4111 1111 1111 1111"


def brute(text):
    """The rules read off one by one."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub(r"\D", "", m.group())
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub(r"\D", "", m.group())) <= 15:
            out.append((m.start(), 3, m.end()))
    return [(a, b, k) for a, k, b in sorted(out)]


TEXTS = [
    "",
    "mail a.b@c.example.com, a@b, x@y.z.",
    "1.2.3.4 256.1.1.1 1.2.3 1.2.3.4.5 0001.2.3.255 00000300.1.1.1",
    f"pay {CARD} or 4111-1111-1111-1112 or {CARD}1",
    "+1 (743) 555-3824 and +1 2 and +" + "9" * 16,
    "é 1.2.3.4 😀 a@b.co",
]


@pytest.mark.parametrize("text", TEXTS)
def test_plain_spans(text):
    assert plain_spans(text) == brute(text)


@pytest.mark.parametrize(
    "text,kind,shown",
    [
        ("write to john [at] mail (dot) com today", 0, "john [at] mail (dot) com"),
        ("write john at mail dot example dot com now", 0, "john at mail dot example dot com"),
        ("write john at mail.com now", 0, "john at mail.com"),
        ("jоhn@mail.cоm", 0, "jоhn@mail.cоm"),
        ("jo​hn＠mail.com", 0, "jo​hn＠mail.com"),
        ("host １９２.168.0.1 up", 1, "１９２.168.0.1"),
        ("host 192[.]168[.]0[.]1 up", 1, "192[.]168[.]0[.]1"),
        ("at 192 dot 168 dot 0 dot 1", 1, "192 dot 168 dot 0 dot 1"),
        ("call plus one seven four three five five five three eight two four", 3,
         "plus one seven four three five five five three eight two four"),
        ("call +one 743 triple five 38 two four", 3, "+one 743 triple five 38 two four"),
        ("card four one one one 1111 1111 one triple one ok", 2, "four one one one 1111 1111 one triple one"),
    ],
)
def test_disguises_map_back_to_the_source(text, kind, shown):
    found = disguised_spans(text, plain_spans(text))
    assert [(text[a:b], k) for a, b, k in found] == [(shown, kind)]


@pytest.mark.parametrize(
    "text",
    [
        "look at the house. It is at home.then at once",
        "one two or three people, connect the dot here",
        "Прочитай это. Ελληνικά",
        "five at five. Seven of nine",
        "plain text",
    ],
)
def test_prose_is_left_alone(text):
    assert disguised_spans(text, plain_spans(text)) == []


def test_unchanged_texts_have_no_tape():
    assert normalised("nothing here at all") is None
    tape = normalised("a​b")
    assert (tape.text, tape.source(0, 1), tape.source(1, 2), tape.source(0, 2)) == ("ab", (0, 1), (2, 3), (0, 3))


def test_random_texts_match_the_rules():
    rng = random.Random(3)
    pieces = ["a", "b.c", "@", "1", "25", ".", "-", " ", "+", "(", ")", "_", "4111111111111111", "é", "10.0.0.1", "x@y.z"]
    for _ in range(4000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 25)))
        assert plain_spans(text) == brute(text), text


def test_rewritings_lead_back_character_by_character():
    """A chain of random rewritings, followed with one marked character at a time."""
    rng = random.Random(8)
    for _ in range(200):
        text = "".join(rng.choice("abcd") for _ in range(rng.randint(1, 30)))
        tape = Tape(text)
        spans = [(i, i + 1) for i in range(len(text))]
        for _ in range(3):
            letter, new = rng.choice("abcdxy"), rng.choice(["", "x", "yy", "xyx"])
            pattern = re.compile(f"{letter}+")
            moved, at = [], 0
            for m in pattern.finditer(tape.text):
                moved += spans[at : m.start()] + [(spans[m.start()][0], spans[m.end() - 1][1])] * len(new)
                at = m.end()
            spans = moved + spans[at:]
            tape.rewrite(pattern, lambda m: new)
        assert len(spans) == len(tape.text)
        assert [tape.source(i, i + 1) for i in range(len(spans))] == spans


def test_long_runs_stay_linear():
    for text in ("a" * 300_000 + " @", "1" * 300_000, "1." * 150_000, "+1" * 150_000, "0" * 5000 + ".1.1.1"):
        assert len(plain_spans(text)) <= 50_000
        disguised_spans(text, [])


def test_plain_spans_stay(spark):
    text = "a@b.com and c [at] d.com " + "x " * 50_000 + "1.2.3.4"
    rows = [(1, text), (2, None), (None, ""), (1, text)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, plain int, Kind string")
    got = find_pii(df).collect()
    assert len(got) == 4
    for r in got:
        if r["doc_id"] == 1:
            assert [(s["kind"], text[s["start"] : s["end"]]) for s in r["plain"]] == [("email", "a@b.com"), ("ip", "1.2.3.4")]
            assert [text[s["start"] : s["end"]] for s in r["disguised"]] == ["c [at] d.com"]
        else:
            assert r["plain"] == r["disguised"] == []
    assert find_pii(df.limit(0)).collect() == []


def test_query_columns(spark, tmp_path):
    df = spark.createDataFrame([(1, "b@c.de +1 743 555 3824"), (2, None)], "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r["doc_id"]: r for r in QUERIES["op9_deobfuscated_pii"](spark, str(tmp_path)).collect()}
    assert rows[1]["spans"] == "email:0:6,phone:7:22" and rows[1]["n_phone"] == 1
    assert rows[2]["spans"] == "" and rows[2]["n_email"] == 0


@pytest.mark.parametrize(
    "kind,shown",
    [
        (1, "one nine two dot one six eight dot zero dot one"),
        (1, "192 dot 168 dot zero dot one"),
        (1, "one nine two [dot] one six eight (.) zero [.] one"),
        (1, "zero point zero point zero point one"),
        (1, "192.168.zero.one"),
        (2, "4 one 1 one 1 one 1 one 1 one 1 one 1 one 1 one"),
        (3, "plus one dot seven four three dot five five five dot three eight two four"),
    ],
)
def test_spelled_runs_with_dots_and_between_numbers(kind, shown):
    text = f"host {shown}, up"
    found = disguised_spans(text, plain_spans(text))
    assert [(text[a:b], k) for a, b, k in found] == [(shown, kind)]


def test_a_run_that_makes_no_sense_leaves_the_others():
    assert normalised("see one two three dot double").text == "see 123 dot double".replace(" dot ", ".")
    assert normalised("version two point five") is None or plain_spans(normalised("version two point five").text) == []
