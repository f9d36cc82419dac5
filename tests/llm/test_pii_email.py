"""Obfuscated e-mails that stand in the contexts of plain ones."""

from quern.llm import pii


def test_pii_bootstraps_obfuscated_email(spark):
    plain = [(i, f"please write to user{chr(97 + i % 26)}{chr(97 + i // 26)}@mail.example.com for more details") for i in range(40)]
    planted = [(100, "please write to jane.doe [at] host [dot] com for more details"), (101, "please write to sam (at) host.org for more details"), (102, "we met jim [at] noon and left"), (103, "please write to 1234567 for more details")]
    found = {r.doc_id: r for r in pii.find_pii(spark.createDataFrame(plain + planted, "doc_id long, text string")).collect()}
    spelt = lambda i: [(a.kind, planted[i - 100][1][a.s : a.e]) for a in found[i].added]
    assert spelt(100) == [("email", "jane.doe [at] host [dot] com")] and spelt(101) == [("email", "sam (at) host.org")]
    assert not found[102].added and not found[103].added and not any(found[i].added for i in range(40))
    assert all([b.kind for b in found[i].base] == ["email"] for i in range(40))
