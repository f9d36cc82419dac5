"""Training sees every passage of the documents in its sample."""

import numpy as np
from pyspark.sql import functions as F

from quern.llm import quality


def test_training_bags_are_whole(spark, monkeypatch):
    n = {i: 1 + 7 * i for i in range(12)}
    docs = spark.createDataFrame([(i, " ".join(f"w{i}" for _ in range(64 * k))) for i, k in n.items()], "doc_id long, text string")
    own = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    used = [r.doc_id for r in docs.filter(~quality.held_out(F.col("doc_id"))).sort("doc_id").collect()]
    seen = []
    monkeypatch.setattr(quality.AttentionModel, "fit", lambda self, x, starts, y: seen.append((np.array(x), starts.tolist(), y.tolist())) or self)
    quality.train(docs, own)
    (x, starts, y), sizes = seen[0], [n[i] for i in used]
    assert len(x) == sum(sizes) and starts == (np.cumsum(sizes) - sizes).tolist() and y == [i % 2 for i in used]
    assert len(x) > 8 * len(used)
