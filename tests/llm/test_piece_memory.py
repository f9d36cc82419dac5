"""What the encoder holds at a time, and what the pipeline's last stage makes."""

import random
import tracemalloc

from quern.llm import pieces


def test_rounds_hold_little():
    r = random.Random(1)
    words = [pieces.BLANK + "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=9)) for _ in range(100_000)]
    v = pieces.vocabulary(pieces.model_path())
    few = v.encode(words[:50])
    tracemalloc.start()
    made = sum(len(ids) for part in range(0, len(words), 50_000) for ids in v.encode(words[part : part + 50_000]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert made > 300_000 and peak < 40 << 20
    assert [x.tolist() for x in v.encode(words)[:50]] == [x.tolist() for x in few]


def test_ids_without_text(spark):
    docs = spark.createDataFrame([(1, "Hello  world"), (2, None), (3, "é \U0001f600\n")], "doc_id long, text string")
    both = {r.doc_id: r for r in pieces.piece_digests(docs, pieces.model_path(), with_ids=True).collect()}
    ids = pieces.piece_digests(docs, pieces.model_path(), with_ids=True, with_text=False)
    assert ids.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    v = pieces.vocabulary(pieces.model_path())
    for r in ids.collect():
        assert r.ids == both[r.doc_id].ids and len(r.ids) == r.n_tokens and v.decode(r.ids) == both[r.doc_id].decoded
