"""The Merkle manifest against a recursive version, its log against a postorder walk, and awkward rows."""

import hashlib
import zlib

import pytest

from quern.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, leaf string, i int, path string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def fields(row):
    return "".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row)


def levels(nodes):
    """All levels of a tree, leaves first."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][k : k + 2]) for k in range(0, len(out[-1]), 2)])
    return out


def proof(tree, i):
    """(sibling or None, whether it is the left one), level by level."""
    out = []
    for nodes in tree[:-1]:
        beside = i ^ 1
        out.append((nodes[beside] if beside < len(nodes) else None, beside < i))
        i >>= 1
    return out


def brute(rows):
    """Per row: leaf, subroot, root, proof, folded root, verified."""
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append(r)
    order = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in order:
        own = sorted(by[lang], key=lambda r: (r[0] is not None, r[0] or 0, H(fields(r))))
        trees[lang] = (own, levels([H(fields(r)) for r in own]))
    top = levels([trees[x][1][-1][0] for x in order])
    out = []
    for at, lang in enumerate(order):
        own, tree = trees[lang]
        for i, r in enumerate(own):
            path = proof(tree, i) + proof(top, at)
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            node = H(fields((*r[:3], r[3] + 1, r[4]))) if changed else tree[0][i]
            for other, left in path:
                node = H(node) if other is None else H(other, node) if left else H(node, other)
            out.append((r[0], tree[0][i], tree[-1][0], top[-1][0], H(*(x for x, _ in path if x)), node, node == top[-1][0]))
    return sorted(out, key=str)


def rows():
    out = [(i, f"s{i % 3}", "en", i, f"text {i}") for i in range(45)] + [(i, None, None, None, None) for i in range(5)]
    out += [(100, "s", "de", 9, "ü" * 9), (None, "s", "fr", 1, "x"), (None, "s", "fr", 1, "x"), (7, "s", "fr", 2**63 - 1, ""), (7, "s", "fr", 3, "y"), (7, "s", "fr", 3, "y")]
    return out + [(200 + i, "s", "", 1, "long " * 20_000) for i in range(3)]


def result(spark, of, names=SCHEMA, levels=8):
    docs = spark.createDataFrame([(*r, "t", "l", 1, "p")[: names.count(",") + 1] for r in of], names).repartition(4)
    cols = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r[c] for c in cols) for r in merkle.checked(docs, levels).collect()), key=str)


@pytest.mark.parametrize(("block", "broadcast"), [(2, 100_000), (8, 0)])
def test_manifest(spark, monkeypatch, block, broadcast):
    monkeypatch.setattr(merkle, "BROADCAST_ROWS", broadcast)
    assert result(spark, rows(), levels=block) == brute(rows())


def test_nothing_and_one_row(spark):
    assert result(spark, []) == []
    assert result(spark, rows()[:1], SCHEMA.split(", tree")[0]) == brute(rows()[:1])


def test_log_is_the_postorder(spark):
    docs = spark.createDataFrame(rows(), SCHEMA.split(", tree")[0])
    below, _, _ = merkle.manifest(docs, 2)
    got = {}
    for r in merkle.log_entries(below, 2).orderBy("position").collect():
        got.setdefault(r.tree, []).append((r.position, r.level, r.digest))
    for lang in {r[2] for r in rows()}:
        own = sorted((r for r in rows() if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, H(fields(r))))
        tree, want = levels([H(fields(r)) for r in own]), []

        def walk(level, i):
            if level:
                for child in (2 * i, 2 * i + 1):
                    if child < len(tree[level - 1]):
                        walk(level - 1, child)
            want.append((level, tree[level][i]))

        walk(len(tree) - 1, 0)
        assert got[lang] == [(k, *x) for k, x in enumerate(want)]


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 13, 64, 100])
def test_positions(n):
    digests = [hashlib.sha256(bytes([k])).digest() for k in range(n)]
    tree = levels([x.hex() for x in digests])
    log = merkle.append_nodes(digests, merkle.height(n))
    assert len(log) == 32 * sum(map(len, tree))
    for level, nodes in enumerate(tree):
        for i, x in enumerate(nodes):
            at = 32 * merkle.position(level, i, n)
            assert log[at : at + 32].hex() == x
