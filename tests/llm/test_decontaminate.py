import random

import pytest

from fleetspectra.llm import decontaminate
from fleetspectra.llm.decontaminate import contaminated, template

QUESTION = (
    "A farmer called Mary Miller sold 48 apples at 3.50 dollars each to her friend Peter. Later Mary Miller "
    "bought 12 kg of sugar and paid twenty euros more. How many apples did she and Peter have then?"
)
CHANGED = (
    "A farmer called Anna Smith sold 77 apples at 9.25 dollars each to her friend Oliver. Later Anna Smith "
    "bought 5 km of sugar and paid ninety euros more. How many apples did she and Oliver have then?"
)
# The friend has another name the second time, and so has the farmer.
MIXED_UP = CHANGED.replace("Later Anna Smith", "Later Paula Jones").replace("she and Oliver", "she and Robert")
SHORT = "Name the three largest moons of Saturn now"
OTHER = "Wholly other words stand in this second item, which nobody ever copied to any document in the test."


def prose(rng, n):
    return " ".join(rng.choice("lorem ipsum dolor sit amet tempor incididunt labore magna".split()) for _ in range(n))


def frames(spark, docs, items=None):
    d = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, hash int, PLACE string")
    items = items if items is not None else [(1, QUESTION), (2, OTHER), (3, SHORT), (4, None), (5, "too short")]
    return d, spark.createDataFrame([(*r, 3) for r in items], "item_id long, text string, doc_id int")


def test_templates():
    assert template("Then Bob Lee ran 3.5 km.") == ["then", "\x01cbob lee", "ran", "\x01n3.5", "\x01ukm"]
    assert template("He said $5 or 20% of it; NASA")[2:] == ["\x01n$5", "or", "\x01n20", "\x01upct", "of", "it", "nasa"]
    assert template(None) == [] and template("\x01n") == ["n"]


def test_runs_are_one_slot():
    assert template("one hundred and five, twenty-five and 1 1/2 cups") == [
        "\x01none hundred and five", "\x01ntwenty five", "and", "\x01n1 1/2", "\x01ucups",
    ]
    assert template("when Dr. John F. Kennedy met Ludwig van der Berg, Ann and New York's Jean-Luc at 50 km/h") == [
        "when", "\x01cdr john f kennedy", "met", "\x01cludwig van der berg", "\x01cann", "and", "\x01cnew york",
        "s", "\x01cjeanluc", "at", "\x01n50", "\x01ukm/h",
    ]
    assert template("in 10:30, 3-4, 5, 6") == ["in"] + [f"\x01n{n}" for n in (10, 30, 3, 4, 5, 6)]
    assert template("Later Mary came. Later", "n") == ["\x01clater mary", "came", "\x01clater"]
    assert template("A red\nKite\xa0Runner — Ann", "v") == ["a", "red", "kite", "runner", "ann"]


@pytest.mark.parametrize("block_windows", [decontaminate.BLOCK_WINDOWS, 7])
def test_reworded_slots_are_found_if_they_are_consistent(spark, block_windows):
    rng = random.Random(1)
    docs = [
        (10, prose(rng, 50) + ". " + QUESTION + " " + prose(rng, 40)),
        (11, prose(rng, 30) + ". " + CHANGED + " " + prose(rng, 700)),
        (12, prose(rng, 400)),
        (13, QUESTION.lower()),
        (14, QUESTION.replace(" ", "\n  ").replace("apples", "apples,")),
        (None, "So: " + SHORT + "? " + prose(rng, 9)),
        (15, None),
        (16, ""),
        (10, "repeated id, clean text"),
        (17, SHORT[:-4]),
        (18, "too short"),
    ]
    d, b = frames(spark, docs)
    got = contaminated(d, b, block_windows=block_windows).collect()
    found = {(r["doc_id"], r["item_id"]): r for r in got}
    assert {(10, 1), (11, 1), (None, 3)} <= set(found) <= {(10, 1), (11, 1), (None, 3), (13, 1), (14, 1)}
    assert len(got) == len(found)
    exact, changed = found[10, 1], found[11, 1]
    assert not exact["reparameterised"] and exact["n_windows"] == exact["item_windows"]
    assert changed["reparameterised"] and changed["n_windows"] == changed["item_windows"]
    assert exact["first_token"] == 50


def test_inconsistent_slots_are_no_match(spark):
    d, b = frames(spark, [(1, MIXED_UP), (2, CHANGED)])
    assert {r["doc_id"] for r in contaminated(d, b).collect()} == {2}


def test_plain_windows_match_brute_force(spark):
    """Without numbers and names a template window is a run of equal words."""
    rng = random.Random(7)
    vocabulary = [f"{a}{b}" for a in "bcdfgh" for b in ("ab", "ec", "id")]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(6, 40)))) for i in range(12)]
    docs = []
    for i in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 120))]
        if i % 3 == 0:
            source = items[i % 12][1].split()
            cut = source[rng.randint(0, 3) : len(source) - rng.randint(0, 3)]
            words[5:5] = cut
        docs.append((i, " ".join(words)))
    want = set()
    for doc, text in docs:
        words = text.split()
        for item, body in items:
            tokens = body.split()
            w = min(len(tokens), decontaminate.WINDOW)
            parts = {tuple(tokens[j : j + w]) for j in range(len(tokens) - w + 1)}
            if any(tuple(words[j : j + w]) in parts for j in range(len(words) - w + 1)):
                want.add((doc, item))
    d, b = frames(spark, docs, items)
    assert {(r["doc_id"], r["item_id"]) for r in contaminated(d, b).collect()} == want and want


def test_empty_tables(spark):
    d, b = frames(spark, [(1, QUESTION)])
    assert contaminated(d.limit(0), b).collect() == []
    assert contaminated(d, b.limit(0)).collect() == []


TOM = "Tom has 5 red apples in his bag. Tom gives 3 apples to Ann. How many apples does Tom have left?"
BEN = "Ben has 8 red apples in his bag. Ben gives 2 apples to Eve. How many apples does Ben have left?"
CAPITAL = "What is the capital of France"


def found_in(spark, docs, items):
    d, b = frames(spark, docs, items)
    return {(r["doc_id"], r["item_id"]): r for r in contaminated(d, b).collect()}


def test_surroundings_case_and_line_ends_hide_nothing(spark):
    docs = [
        (1, "Lorem ipsum. " + BEN),
        (2, "lorem " + QUESTION.lower() + " dolor"),
        (3, QUESTION.replace(" ", "\n\t")),
        (4, QUESTION.replace(" ", "  ")),
        (5, "lorem What is the capital of France today"),
        (6, "lorem what is the capital of france today"),
        (7, "So (" + TOM + ")"),
        (8, "lorem “" + CAPITAL + "” ipsum"),
        (10, "nothing of the kind stands here"),
        (11, CHANGED.replace(" ", "\n")),
    ]
    got = found_in(spark, docs, [(1, QUESTION), (2, TOM), (3, CAPITAL)])
    assert set(got) == {(1, 2), (2, 1), (3, 1), (4, 1), (5, 3), (6, 3), (7, 2), (8, 3), (11, 1)}
    assert {k for k, r in got.items() if r["reparameterised"]} == {(1, 2), (11, 1)}


def test_one_edit_does_not_clear_what_stands_around_it(spark):
    long = (
        QUESTION + " Her neighbour counts the remaining fruit twice before the market closes, and Mary Miller "
        "writes every sale into a small green book that lies beside the old wooden scale."
    )
    edited = long.replace("and Mary Miller writes", "and Paula Jones writes")
    # Renamed throughout, but in two ways on the two sides of reworded sentences.
    apart = CHANGED + " Then all went quietly home to rest, and Paula Jones " + long.split("and Mary Miller ")[1]
    got = found_in(spark, [(1, edited), (2, apart), (3, MIXED_UP)], [(1, long)])
    assert set(got) == {(1, 1), (2, 1)}
    assert not got[1, 1]["reparameterised"] and got[2, 1]["reparameterised"]


def test_word_for_word_needs_no_least_length_or_share_of_words(spark):
    sums = "What is 12 + 7 - 3 + 9 - 4 + 8 - 2 + 6 - 1 + 5 equal to?"
    short = "What is 17 times 24?"
    docs = [(1, "lorem " + sums), (2, "lorem " + short + " ipsum"), (3, sums.replace("12", "13")),
            (4, short.replace("24", "25")), (5, "too short")]
    got = found_in(spark, docs, [(1, sums), (2, short), (3, "too short")])
    assert set(got) == {(1, 1), (2, 2)} and not any(r["reparameterised"] for r in got.values())


def test_easy_pieces_are_read_as_the_others(monkeypatch):
    rng = random.Random(3)
    words = "Mary mary. Élan über, ÜBER Twenty twenty-five and hundred 5 km km. Of of second The the Mr. J. I A x ß%%% Ωmega"
    texts = [" ".join(rng.choice(words.split()) for _ in range(40)) for _ in range(60)] + [None, ""]
    fast = [template(t, form) for t in texts for form in "vnpf"]
    monkeypatch.setattr(decontaminate, "_PLAIN_RAW", "^$")
    assert [template(t, form) for t in texts for form in "vnpf"] == fast


STORY = (
    "Mary gave 5 apples to Tom while they were waiting near Boston for the late bus, and then Mary kept 3 apples "
    "for herself. How many apples did Mary hold before she met Tom near Boston?"
)


def renamed(mary="Jane", tom="Bob", boston="Denver", five="7", three="2"):
    text = STORY.replace("Mary", mary).replace("Tom", tom).replace("Boston", boston)
    return text.replace(" 5 ", f" {five} ").replace(" 3 ", f" {three} ")


def test_values_of_another_length_are_found(spark):
    docs = [
        (1, renamed(mary="Bill Smith", boston="New York")),
        (2, renamed(five="twenty-five", three="one hundred and two")),
        (3, "lorem ipsum Yesterday " + renamed(mary="Ludwig van der Berg", tom="J. R. Miller", five="1 1/2")),
        (4, renamed(mary="Jane", tom="Jane", boston="Jane")),
        (5, renamed(five="4", three="4")),
        (6, STORY),
        (7, renamed(tom="Mary")),
        (8, "Jane Jane 3 Jane gave 3 Jane " * 30),
        (9, renamed(mary="Anna Lee").replace("did Anna Lee hold", "did Anna hold")),
    ]
    got = found_in(spark, docs, [(1, STORY)])
    # In document 7 a name of the item stands for another one, each for one only.
    assert set(got) == {(1, 1), (2, 1), (3, 1), (5, 1), (6, 1), (7, 1), (9, 1)}
    assert {k[0] for k, r in got.items() if r["numbers_merged"]} == {5}
    assert {k[0] for k, r in got.items() if not r["reparameterised"]} == {6}
    assert {k[0] for k, r in got.items() if r["n_windows"] < r["item_windows"]} <= {3}


def test_null_and_repeated_items_and_very_long_pieces(spark):
    docs = [(1, "x" * 3_000_000 + " " + renamed()), (2, "Ab1.5-" * 300_000), (3, STORY)]
    got = found_in(spark, docs, [(None, STORY), (None, None), (7, STORY), (7, STORY)])
    assert set(got) == {(1, None), (1, 7), (3, None), (3, 7)}
