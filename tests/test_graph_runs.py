"""The factored search over runs of ids: classes of many arrays, links that differ by order, targets by name, and what is stored."""

import random

from quern.operators import factored, graph


def _rows(df):
    return sorted((r.query_id, r.end, tuple(r.path), tuple(r.types), round(r.strength, 6), r.hops) for r in df.collect())


def _chain(spark, n):
    """Documents of eight sets of four forms, each set three forms from the next, and of two confidences: the newer one decides a link's strength."""
    r = random.Random(5)
    rows = [(d, "person", f"form{k + i}", c, [], 1) for d in range(n) for k, c in [(r.randrange(8), r.choice((0.4, 0.9)))] for i in range(4)]
    entities = spark.createDataFrame(rows, "doc_id long, entity_type string, canonical string, confidence double, aliases array<string>, mentions long")
    return entities.repartition(3), spark.createDataFrame([(d, "because" if d % 7 == 0 else "") for d in range(n)], "doc_id long, text string")


def test_runs_of_many_arrays_equal_the_search_of_pairs(spark, monkeypatch):
    monkeypatch.setattr(factored, "CHUNK", 2)
    entities, docs = _chain(spark, 90)
    g = factored.factor(entities, docs)
    links = factored.class_links(g)
    assert links.filter("a <> b and strength <> back").count() > 20 and g.classes.filter("size > 4").count() > 2
    edges = factored.doc_pairs(g, links).localCheckpoint()
    starts = spark.createDataFrame([(q, q) for q in (1, 17, 30, 58)] + [(17, 20)], "query_id long, doc_id long")
    got = _rows(factored.multi_hop(g, starts, least=0.5, top=100))
    assert got == _rows(graph.multi_hop(edges, starts, least=0.5, top=100)) and {r[5] for r in got} == {1, 2, 3}  # one array a class
    asked = spark.createDataFrame([(1, "form1"), (1, "form7"), (17, "form10"), (58, "form10"), (30, "nobody")], "query_id long, name string")
    named = entities.select(entities.canonical.alias("name"), "doc_id").distinct()
    got = _rows(factored.multi_hop(g, starts, named, least=0.3, top=3, asked=asked))
    assert got == _rows(graph.multi_hop(edges, starts, asked.join(named, "name").select("query_id", "doc_id"), least=0.3, top=3)) and got


def test_no_row_is_stored_for_a_query_and_document(spark, monkeypatch):
    n, stored, usual = 200, [], factored.kept

    def counted(df, label):
        out = usual(df, label)
        stored.append(out.count())
        return out

    rows = [(d, "person", f, 0.5, [], 1) for d in range(n) for f in ("a", f"b{d % 2}")]
    g = factored.factor(spark.createDataFrame(rows, "doc_id long, entity_type string, canonical string, confidence double, aliases array<string>, mentions long"), spark.createDataFrame([(d, "x") for d in range(n)], "doc_id long, text string"))
    monkeypatch.setattr(factored, "kept", counted)
    starts = spark.range(100, n).selectExpr("id query_id", "id doc_id")
    paths = factored.multi_hop(g, starts)
    assert paths.count() == 500 and max(stored) < 100 * n // 10
