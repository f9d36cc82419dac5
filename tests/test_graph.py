"""The document graph against brute force, with forms that most documents hold."""

import random
from collections import Counter

from quern.operators import factored, graph
from quern.plans import catalog, content

NOTES = [(i, f"Acme Zork Corp wrote. {'Beta Prime Inc saw it. ' if i % 3 == 0 else ''}The growth of {i}%.") for i in range(40)]


def test_edges_of_common_forms(spark, monkeypatch):
    monkeypatch.setattr(factored, "BLOCK", 4)
    docs = spark.createDataFrame(NOTES, "doc_id long, text string")
    entities = graph.merge_entities(graph.extract_entities(docs)).localCheckpoint()
    rows = [tuple(r) for r in entities.select("doc_id", "canonical", "confidence").collect()]
    forms, first, n, best = {}, {}, {}, {}
    for d, c, x in rows:
        forms.setdefault(d, set()).add(c)
        first.setdefault(c, set()).add(d)
        n[d] = n.get(d, 0) + 1
        best[d, c] = max(best.get((d, c), 0), x)
    want = {}
    for a in forms:
        for b in forms:
            both = forms[a] & forms[b]
            if a > b and both:
                s = min(0.2 * len(both), 0.8) + 0.2 * sum(best[a, c] for c in both) / len(both) + min(0.1 * sum(sorted(first[c]).index(a) < 3 for c in both), 0.3)
                want[a, b] = (min(1.0, s * 0.8 if min(n[a], n[b]) / max(n[a], n[b]) < 0.3 else s), sorted(both))
    got = {(r.src, r.dst): (r.strength, r.shared) for r in graph.doc_edges(entities, docs).collect()}
    assert got.keys() == want.keys() and len(got) == 40 * 39 // 2
    assert all(abs(got[k][0] - want[k][0]) < 1e-5 and got[k][1] == want[k][1] for k in got)


def test_queries_take_every_form_and_target(spark, monkeypatch):
    notes = spark.createDataFrame([(100 * i, t) for i, t in NOTES], "doc_id long, text string")
    monkeypatch.setattr(content, "notes", lambda *_: notes)
    links = catalog.QUERIES["doc_edges"](spark, "").collect()
    assert sum(r.links for r in links) == 40 * 39 // 2 and len(links) < 100
    strengths = catalog.QUERIES["edge_strength"](spark, "").collect()
    assert len(strengths) == 40 and {r.links for r in strengths} == {39}
    assert sum(r.links + r.one_order for r in catalog.QUERIES["edge_type"](spark, "").collect()) >= 40 * 39 // 2
    assert {(r.nodes, r.edges) for r in catalog.QUERIES["neighborhood"](spark, "").collect()} == {(40, 40 * 39 // 2)}
    stats = catalog.QUERIES["graph_stats"](spark, "").first()
    assert (stats.documents, stats.edges, stats.degrees) == (40, 40 * 39 // 2, "0:39,100:39,200:39,300:39,400:39")
    assert catalog.QUERIES["multi_hop"](spark, "").filter("end > query_id + 60 or end < query_id").count() > 0
    assert catalog.QUERIES["entity_index"](spark, "").filter("canonical = 'The Growth'").first().documents == 40


def _random_graph(spark):
    r = random.Random(6)
    pairs = sorted({(a, b) for a, b in ((r.randrange(24), r.randrange(24)) for _ in range(90)) if a > b})
    rows = [(a, b, round(0.4 + 0.6 * r.random(), 6), r.choice(("causal", "semantic")), ["x"]) for a, b in pairs]
    return rows, spark.createDataFrame(rows, "src long, dst long, strength double, type string, shared array<string>")


def test_multi_hop_and_what_follows_from_it(spark):
    rows, edges = _random_graph(spark)
    starts = spark.createDataFrame([(1, 0), (2, 5)], "query_id long, doc_id long")
    paths = graph.multi_hop(edges, starts, top=100).collect()
    links = {}
    for a, b, s, t, _ in rows:
        links.setdefault(a, []).append((b, s, t))
        links.setdefault(b, []).append((a, s, t))
    want = {}
    for q, start in ((1, 0), (2, 5)):
        seen, front = {start}, {start: ((start,), 1.0)}
        for hop in (1, 2, 3):
            step = {}
            for end, (path, p) in front.items():
                for to, s, _ in links.get(end, ()):
                    new = round(p * s, 9)
                    if to not in seen and new > 0.1 and (to not in step or (-new, end) < step[to][0]):
                        step[to] = ((-new, end), path + (to,), new)
            front = {to: (path, p) for to, (_, path, p) in step.items()}
            seen |= set(front)
            want |= {(q, to): (path, p, hop) for to, (path, p) in front.items()}
    got = {(x.query_id, x.end): (tuple(x.path), x.strength, x.hops) for x in paths}
    assert got.keys() == want.keys() and len(want) > 20
    assert all(got[k][::2] == want[k][::2] and abs(got[k][1] - want[k][1]) < 1e-6 for k in want)
    best = graph.multi_hop(edges, starts)
    chain = {(x.query_id, x.end): x for x in graph.reasoning_chain(best).collect()}
    assert all(len(x.chain) == x.hops and x.chain[0].startswith(f"Document {x.path[0]} ") and x.chain[-1].endswith(f" document {x.end}") for x in chain.values()) and len(chain) == 10
    asked = graph.follow_up(best).collect()
    assert all(sum(x.query_id == q for x in asked) <= 5 for q in (1, 2)) and any("compare" in x.question for x in asked)
    targets = spark.createDataFrame([(1, 3), (2, 3)], "query_id long, doc_id long")
    assert {x.end for x in graph.multi_hop(edges, starts, targets).collect()} <= {3}


def test_neighborhood(spark):
    rows, edges = _random_graph(spark)
    nodes, inside = graph.neighborhood(edges, spark.createDataFrame([(1, 0), (2, 5)], "query_id long, doc_id long"))
    near = {}
    for a, b, *_ in rows:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    for q, start in ((1, 0), (2, 5)):
        ring = {start} | near.get(start, set())
        ring |= {n for m in ring for n in near.get(m, ())}
        assert {x.doc_id for x in nodes.collect() if x.query_id == q} == ring
        assert sorted((x.src, x.dst) for x in inside.collect() if x.query_id == q) == [r[:2] for r in rows if r[0] in ring and r[1] in ring]


def test_entities_of_names(spark):
    rows, edges = _random_graph(spark)
    r = random.Random(7)
    held = sorted({(d, f"e{r.randrange(8)}") for d in range(24) for _ in range(3)})
    entities = spark.createDataFrame([(d, "organization", e, 0.5, [f"{e}-alias"], 1) for d, e in held], "doc_id long, entity_type string, canonical string, confidence double, aliases array<string>, mentions long")
    names = spark.createDataFrame([("e1",), ("e2-alias",), ("nobody",)], "name string")
    docs = {n: {d for d, e in held if e == n.removesuffix("-alias")} for n in ("e1", "e2-alias")}
    together = Counter(e for d, e in held if d in docs["e1"] and e != "e1")
    got = [(x.canonical, x.n) for x in graph.related_entities(entities, names).orderBy("rank").collect()]
    assert got == sorted(together.items(), key=lambda x: (-x[1], x[0]))[:10]
    called = graph.called(entities, names)
    docs_of = {x.name: set() for x in called.collect()}
    for x in called.collect():
        docs_of[x.name].add(x.doc_id)
    assert docs_of == docs
    stats = graph.graph_stats(entities, edges.selectExpr("count(*) as edges"), edges.selectExpr("src d").union(edges.selectExpr("dst")).groupBy("d").count().selectExpr("d", "count n")).first()
    degree = Counter(x for a, b, *_ in rows for x in (a, b))
    assert (stats.documents, stats.edges, stats.entities) == (len({d for d, _ in held}), len(rows), len({e for _, e in held}))
    assert stats.degrees == [f"{d}:{n}" for d, n in sorted(degree.items(), key=lambda x: (-x[1], x[0]))[:5]]


def _random_entities(spark, seed=8, n=40):
    """Documents that share forms, some alike, some in no class, with words of relations."""
    r = random.Random(seed)
    kinds = {f"form{k}": r.choice(("person", "organization", "date", "metric")) for k in range(12)}
    sets = [(r.sample(sorted(kinds), r.randrange(1, 4)), r.choice((0.5, 0.7))) for _ in range(14)]
    rows, docs = [], []
    for d in range(n):
        forms, c = r.choice(sets)
        rows += [(d, kinds[f], f, c, [f"{f}-alias"], 1) for f in forms] + [(d, "metric", f"only{d}", 0.5, [], 1)] * (d % 3 == 0)
        docs.append((d, r.choice(("", "before that", "it caused this", "part of", None))))
    docs += [(n, "alone"), (n + 1, None)]
    rows.append((n, "metric", "nobody else", 0.5, [], 1))
    entities = spark.createDataFrame(rows, "doc_id long, entity_type string, canonical string, confidence double, aliases array<string>, mentions long")
    return entities.repartition(3), spark.createDataFrame(docs, "doc_id long, text string")


def test_factored_search_equals_the_search_of_pairs(spark, monkeypatch):
    monkeypatch.setattr(factored, "BLOCK", 2)
    entities, docs = _random_entities(spark)
    g = factored.factor(entities, docs)
    links = factored.class_links(g).cache()
    edges = graph.doc_edges(entities, docs).cache()
    pairs = {(r.src, r.dst): r for r in edges.collect()}
    assert sum(r.links for r in links.collect()) == len(pairs) and links.count() < len(pairs)
    forms = {}
    for r in entities.collect():
        forms.setdefault(r.doc_id, set()).add(r.canonical)
    assert set(pairs) == {(a, b) for a in forms for b in forms if a > b and forms[a] & forms[b]}
    assert all(set(r.shared) == forms[k[0]] & forms[k[1]] for k, r in pairs.items())
    starts = spark.createDataFrame([(q, q) for q in (0, 3, 7, 11, 40, 99)], "query_id long, doc_id long")
    rows = lambda df: sorted((r.query_id, r.end, tuple(r.path), tuple(r.types), round(r.strength, 6), r.hops) for r in df.collect())
    for least in (0.1, 0.35):
        assert rows(factored.multi_hop(g, starts, least=least, top=100)) == rows(graph.multi_hop(edges, starts, least=least, top=100))
    targets = spark.createDataFrame([(0, 5), (3, 5), (3, 6)], "query_id long, doc_id long")
    assert rows(factored.multi_hop(g, starts, targets)) == rows(graph.multi_hop(edges, starts, targets))
    for radius in (1, 2):
        nodes, inside = factored.neighborhood(g, starts, radius)
        want_nodes, want_inside = graph.neighborhood(edges, starts, radius)
        got = {(r.query_id, r.doc_id) for r in nodes.join(g.members, "class").collect()}
        assert got == {(r.query_id, r.doc_id) for r in want_nodes.collect() if r.doc_id < 40}
        assert {r.query_id: r.n for r in inside.groupBy("query_id").agg({"links": "sum"}).toDF("query_id", "n").collect()} == {r.query_id: r.n for r in want_inside.groupBy("query_id").count().toDF("query_id", "n").collect()}
    degree = Counter(x for k in pairs for x in k)
    each = {r.doc_id: r.n for r in g.members.join(factored.degrees(g, links), "class").collect()}
    assert {d: n for d, n in each.items() if n} == dict(degree)


def test_neighbours_of_names(spark):
    entities, docs = _random_entities(spark, seed=9)
    g = factored.factor(entities, docs)
    names = spark.createDataFrame([("form1",), ("form2-alias",), ("nobody else",), ("nobody",)], "name string")
    hit = graph.called(entities, names)
    held = {}
    for r in hit.collect():
        held.setdefault(r.name, set()).add(r.doc_id)
    pairs = {(r.src, r.dst) for r in graph.doc_edges(entities, docs).collect()}
    got = {r.name: (r.documents, r.neighbours) for r in graph.entity_insights(entities, hit, factored.neighbour_counts(g, hit), names).collect()}
    assert got == {n: (len(ds), len({b for a, b in pairs if a in ds} | {a for a, b in pairs if b in ds})) for n, ds in held.items()}


def test_factored_graph_of_nothing(spark):
    entities, docs = _random_entities(spark)
    g = factored.factor(entities.filter("false"), docs)
    starts = spark.createDataFrame([(1, 1)], "query_id long, doc_id long")
    assert factored.class_links(g).count() == 0 and factored.multi_hop(g, starts).count() == 0 and factored.neighborhood(g, starts)[0].count() == 0


def test_joins_of_hot_keys(spark):
    from quern.operators.skew import join_groups

    rows = spark.range(3000).selectExpr("id", "case when id < 2500 then 0 else id end k")
    groups = rows.groupBy("k").count().selectExpr("k", "count n", "k * 2 v")
    assert sorted((r.id, r.v) for r in join_groups(rows, groups, "k", 3000).collect()) == [(i, 0 if i < 2500 else 2 * i) for i in range(3000)]
