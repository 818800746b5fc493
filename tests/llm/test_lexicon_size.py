"""The lexicon has no bound but the least count and odds, and its index finds what the automaton over the trie accepts."""

import random

from tidekeep.llm import toxicity


def test_rare_terms_of_many_toxic_documents(spark):
    """2,400 terms, each in 12 of 2,400 toxic documents and in no clean one: a share of 0.005, and beyond 2,000 entries."""
    n = 2400
    letters = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(3))
    terms = [f"{letters(i * 7)}q{letters(i)}" for i in range(n)]
    rows = [(" ".join(terms[(i + 200 * k) % n] for k in range(12)) + " plain words", 1) for i in range(n)] + [("plain words of no kind", 0)] * n
    found = toxicity.mined(spark.createDataFrame(rows, "text string, toxic int").repartition(4), n, n)
    lexicon = toxicity.Lexicon(found)
    assert len(set(terms)) == n and all(lexicon.of(t)[1] == 0 for t in terms)
    assert lexicon.of("plain")[1] == -1


def test_index_equals_the_automaton():
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abcd") for _ in range(n))
    entries = list({(word(rng.randint(3, 13)), False, 1.0): None for _ in range(150)}) + [(word(n), True, 1.0) for n in (5, 6, 8)]
    lexicon = toxicity.Lexicon(entries)
    found = []
    for _ in range(3000):
        base = list(rng.choice(entries)[0])
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(base))
            rng.choice([lambda: len(base) > 1 and base.pop(at), lambda: base.insert(at, rng.choice("abcd")), lambda: base.__setitem__(at, "x")])()
        found.append(lexicon.of("".join(base))[1])
        assert found[-1] == lexicon.errors("".join(base))
    assert {-1, 0, 1, 2} <= set(found)
