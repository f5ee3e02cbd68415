"""Decontamination of items with rows of placeholders, on the matcher itself."""

from __future__ import annotations

import random

import pytest

from quiver.llm.decontamination import COVER, RUN, WINDOW, Templates, leaks, matched

LIST = "find the mean of 3, 5, 7, 8, 10, 12, 14, 15, 20, 22, 31, 40, 41, 57 and 60"


def leaked(item, text):
    return matched(Templates().words(text), Templates().words(item), WINDOW, COVER, RUN)[2]


@pytest.mark.parametrize("before", range(40))
def test_number_list_at_every_offset(before):
    assert leaked(LIST, "so " * before + LIST + " as we know")
    assert leaked("3, 5, 7, 8, 10, 12, 14, 15, 20, 22", "so " * before + "3, 5, 7, 8, 10, 12, 14, 15, 20, 22")
    other = LIST.replace("5", "6")  # 5 and 15 and 57 become 6, 16 and 67
    assert leaked(LIST, "so " * before + other)
    assert leaked(LIST, "so " * before + "1 2 4 " + LIST + " 9 9 9 9 9 9 9 9 9")
    cut = LIST.replace("12, 14", "12, 13, 14")
    assert leaked("please " * 6 + LIST, "so " * before + "please " * 6 + cut)


def test_repeated_number_for_two_is_no_match():
    item = "a shop sells 4 pens and 4 books and then 4 cups to each of them by noon"
    assert not leaked(item, item.replace("4 books", "5 books"))
    numbers = "7 7 7 7 7 7 7 7 7 7 7 7 7 7 7 7"
    assert not leaked(numbers, "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16")


QUESTION = "If Alice has 12 apples and buys 7 kg of pears then how many fruits does Alice carry home today"


def test_case_bears_on_nothing():
    for text in (QUESTION.upper(), QUESTION.lower(), QUESTION.replace("12", "40").upper(), QUESTION.replace("Alice", "Bob").replace("7 kg", "3 lb")):
        assert leaked(QUESTION, "Well. " + text + " and so on") and leaked(text, QUESTION)
    assert not leaked(QUESTION, QUESTION.replace("Alice carry", "Carol carry"))


def test_long_run_is_enough():
    words = ["".join(random.Random(i).choices("abcdefgh", k=6)) for i in range(400)]
    assert leaked(" ".join(words), "so it is " + " ".join(words[100:140]) + " as said")
    assert not leaked(" ".join(words), "so it is " + " ".join(words[100:120]) + " as said")


def test_join_against_all_pairs(spark, monkeypatch):
    """The candidates' join loses no pair that comparing every text with every item finds; with common windows and without."""
    from quiver.llm import decontamination

    rng = random.Random(11)
    word = lambda: rng.choice(["the", "mean", "of", "sum", "and", "Alice", "Bob", "3", "4", "17", "kg", "is", "then", "stone", "river", "table", "."])
    shared = [word() for _ in range(14)]
    items = [(i, " ".join(([word() for _ in range(rng.choice([2, 5, 8, 12, 30]))] if rng.random() < 0.5 else shared + [word() for _ in range(4)]))) for i in range(30)] + [(30, None), (31, ""), (32, "1 2 3 4 5 6 7 8 9 10 11 12"), (0, "another one of this id with some more words in it")]
    rows = [(0, None), (1, ""), (2, "x" * 50_000)]
    for i in range(3, 80):
        own = (rng.choice(items)[1] or "").split()
        for _ in range(rng.randint(0, 2)):
            if own:
                own[rng.randrange(len(own))] = word()
        t = " ".join([*[word() for _ in range(rng.randint(0, 20))], *own, *[word() for _ in range(rng.randint(0, 20))]])
        rows.append((i, rng.choice([t, t, t.upper(), t.lower()])))
    rows += [rows[5], (5, "another text of this id"), (None, items[3][1])]
    t = Templates()
    want = sorted((str(d), sorted({k for k, x in items if x and t.words(x)[0] and matched(t.words(text or ""), t.words(x), WINDOW, COVER, RUN)[2]})) for d, text in rows)
    assert sum(bool(w[1]) for w in want) > 20
    docs = spark.createDataFrame([(d, x, 1, "n") for d, x in rows], "doc_id bigint, text string, w int, item string").repartition(3)
    bench = spark.createDataFrame([(k, x, 0) for k, x in items], "item_id bigint, text string, th int")
    for common, most in ((100, 8 << 20), (2, 8 << 20), (3, -1)):
        monkeypatch.setattr(decontamination, "COMMON", common)
        monkeypatch.setattr(decontamination, "BROADCAST_BYTES", most)
        assert sorted((str(r.doc_id), list(r["items"])) for r in leaks(docs, bench).collect()) == want
