import random

import pytest

from voxtide.llm import repetition as rep


def brute(words, run=3):
    grams = [tuple(words[i : i + run]) for i in range(len(words) - run + 1)]
    marked = {k for i, g in enumerate(grams) if g in grams[:i] for k in range(i, i + run)}
    return len(marked)


@pytest.mark.parametrize("seed", range(20))
def test_marked_words(seed):
    rng = random.Random(seed)
    w = [rng.choice("abc"[: rng.randrange(1, 4)]) for _ in range(rng.randrange(0, 30))]
    n, repeated, distinct, top, _ = rep.measures(w)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    assert (n, repeated, distinct) == (len(w), brute(w), len(set(w))) and top == max((grams.count(g) for g in grams), default=0)


def test_loops_and_sentences():
    assert rep.measures("x a b a b a b".split())[4] >= 3 and rep.measures("a b c d".split())[4] == 0
    assert rep.repeated_sentences("i saw it. i saw it. no.") == 3 / 7 and rep.repeated_sentences("") == 0


def test_agreement():
    post = rep.agreement({(1, 1, 1): 50, (1, 1, 0): 20, (-1, -1, -1): 500, (-1, -1, 1): 30, (0, 0, 0): 10, (1, -1, -1): 5})
    assert post[1, 1, 1] > 0.99 and post[-1, -1, -1] < 0.01 and post[1, 1, 0] > 0.95 and post[-1, -1, 1] < 0.5
    assert rep.agreement({}) == {}


def test_operator(spark):
    loop = "tôi thấy mèo " * 4
    rng = random.Random(0)
    sound = [(100 + i, " ".join(f"w{rng.randrange(500)}" for _ in range(20)), "c") for i in range(60)]
    rows = [(1, loop, "c"), (2, "PAR: (1.0s) um " + loop, "c"), (3, None, "c"), (4, "", "c"), (5, "one two three four", "c"), (1, loop, "c"), (None, loop, "c"), (6, "a " * 100_000, "c"), *sound]
    df = spark.createDataFrame(rows, "k long, t string, votes string")
    r = {x.k: x for x in rep.repetition(df, "k", "t", [("PAR", "PAR")], [("um",)]).collect()}
    assert set(r) == {1, 2, 3, 4, 5, 6, *range(100, 160)} and r[1].share == r[2].share == 9 / 12 and r[6].repeated_words == 99_999
    assert r[3].n_words == 0 and r[3].share == 0.0 and r[1].p_repetitive > 0.9 and r[101].p_repetitive < 0.1
    assert rep.repetition(df.where("false"), "k", "t", [], []).count() == 0


def test_wordless_texts_are_sound_even_among_loops(spark):
    df = spark.createDataFrame([(i, "no no no no no no") for i in range(50)] + [(90, None), (91, "[noise]")], "k long, t string")
    r = {x.k: x for x in rep.repetition(df, "k", "t", [], []).collect()}
    assert r[90].p_sound == r[91].p_sound == 1.0 and r[7].p_repetitive > 0.9


def test_posterior_decides(spark, monkeypatch):
    """The query keeps what the posterior says, so a posterior of nothing keeps nothing."""
    from tests.test_queries import DATA
    from voxtide.llm import queries

    assert queries.QUERIES["p6_found"](spark, DATA).count() > 0
    monkeypatch.setattr(rep, "agreement", lambda patterns: dict.fromkeys(patterns, 0.0))
    assert queries.QUERIES["p6_found"](spark, DATA).count() == 0
