"""Precision and recall of what the methods of PII and secret scans add, on planted tables of 1,200 documents."""

import random

from quern.llm import pii, secrets_scan

N = 1200


def filler(r, n):
    return " ".join("".join(r.choice(("the", "ra", "mi", "ton", "sel", "ver", "ing", "o", "pa")) for _ in range(r.randrange(1, 4))) for _ in range(n))


def measured(found, truth, docs):
    """Precision and recall of added spans against planted ones; found and truth: doc_id -> set of (start, end)."""
    added, planted = {(d, *s) for d, v in found.items() for s in v}, {(d, *s) for d, v in truth.items() for s in v}
    assert added, "nothing was added"
    return len(added & planted) / len(added), len(added & planted) / len(planted)


def test_planted_identifiers(spark):
    r = random.Random(11)
    number = lambda: f"{r.randrange(200, 999)}-{r.randrange(100, 999)}-{r.randrange(1000, 9999)}"
    name = lambda: "".join(r.choice("abcdefghij") for _ in range(7))
    quad = lambda dot: dot.join(str(r.randrange(1, 255)) for _ in range(4))
    docs, truth = [], {}
    for i in range(N):
        head, tail = filler(r, r.randrange(5, 40)), filler(r, 10)
        kind, seed = i % 4, r.random() < 0.75
        call, mail, host = (r.choice(x) for x in (("call me at", "my phone is", "reach us under"), ("write to", "mail goes to", "contact address is"), ("connect to server", "from client address", "blocked host")))
        other = r.choice(("order number was", "part code reads", "invoice total shows"))
        if kind == 0:
            found, hidden = f"{call} {'+1 ' if seed else ''}{number()}", None if seed else call
        elif kind == 1:
            found, hidden = f"{mail} {name()}{'@' if seed else ' [at] '}{name()}.com", None if seed else mail
        elif kind == 2:
            found, hidden = f"{host} {quad('.' if seed else ' dot ')}", None if seed else host
        else:
            found, hidden = f"{other} {number() if seed else quad(' dot ')}", None
        docs.append((i, f"{head} {found} {tail}"))
        if hidden:
            truth[i] = {(len(head) + 1 + len(hidden) + 1, len(head) + 1 + len(found))}
    got = {x.doc_id: {(a.s, a.e) for a in x.added} for x in pii.find_pii(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    precision, recall = measured(got, truth, docs)
    print(f"PII: precision {precision:.3f}, recall {recall:.3f}")
    assert precision >= 0.9 and recall >= 0.9


def test_planted_secrets(spark):
    r = random.Random(12)
    mixed = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    rand = lambda n, chars=mixed: "".join(r.choice(chars) for _ in range(n))
    word = lambda: filler(r, 1)
    docs, truth = [], {}
    for i in range(N):
        head, tail = filler(r, r.randrange(20, 60)), filler(r, 10)
        kind = i % 6
        if kind == 0:
            found = f"secret={rand(r.randrange(16, 40))}"
        elif kind == 1:
            found = rand(r.randrange(12, 16))
        elif kind == 2:
            found = rand(32, mixed[:52])
        elif kind == 3:
            found = rand(r.randrange(20, 40))
        elif kind == 4:
            found = r.choice(("_", "-")).join(word() for _ in range(4)) + "_value"
        else:
            found = "".join(word().capitalize() for _ in range(4)) + "Reader2"
        docs.append((i, f"{head} {found} {tail}"))
        if kind in (1, 2, 3):
            truth[i] = {(len(head) + 1, len(head) + 1 + len(found))}
    got = {x.doc_id: {(a.s, a.e) for a in x.added} for x in secrets_scan.find_secrets(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    precision, recall = measured(got, truth, docs)
    print(f"secrets: precision {precision:.3f}, recall {recall:.3f}")
    assert precision >= 0.9 and recall >= 0.9
