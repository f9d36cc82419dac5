"""Every recurring word counts, and short, letter-only and adjoining tokens are judged."""

import random

from quern.llm import secrets_scan


def test_every_recurring_word_counts(spark):
    docs = spark.createDataFrame([(1, "ordinary language ordinary sentence\nlanguage ordinary"), (2, None), (3, "language\nordinary language language ordinary language")], "doc_id long, text string")
    assert dict(map(tuple, secrets_scan.ordinary_words(docs).collect())) == {"ordinary": 5, "language": 6}


def test_short_letter_only_and_adjoining_tokens(spark):
    r = random.Random(5)
    rand = lambda n, a="abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789": "".join(r.choice(a) for _ in range(n))
    letters = "bcdfghjkmpqvwxzBCDFGHJKMPQVWXZ"
    every = [f"the secret={rand(24)} of plain ordinary language words follows with understanding between international institutions, quizzical jackknife xylophone zigzagging blackjack hydroxyl vexillology maximizing QUIZZICAL JACKKNIFE XYLOPHONE ZIGZAGGING BLACKJACK HYDROXYL VEXILLOLOGY MAXIMIZING HOWEVER UNDERSTANDING ORDINARY LANGUAGE WORDS BETWEEN PUBLIC AND PRIVATE INSTITUTIONS REQUIRES EXPLICIT WORKMANSHIP" for _ in range(800)]
    planted = [rand(20, letters), f"x7{rand(11, letters)}", f"{rand(16, letters)}/0123456789abcdef0123", "internationally", "4111111111111111", "----------------"]
    at = len(every)
    every += [f"here {t} stands alone" for t in planted]
    got = {x.doc_id: x for x in secrets_scan.find_secrets(spark.createDataFrame(list(enumerate(every)), "doc_id long, text string")).collect()}
    spans = [[(a.s, a.e) for a in got[at + i].added] for i in range(len(planted))]
    assert spans[:3] == [[(5, 25)], [(5, 18)], [(5, 22)]] and not any(spans[3:]) and not any(got[i].added for i in range(800))
    assert [(b.s, b.e) for b in got[at + 2].base] == [(22, 42)]
