"""Places where a caller's own functions enter: models, tokenizers, chunkers and computation on a miss."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def embed_with(docs: DataFrame, make_model: Callable[[], Callable[[list[str]], list]], text: str = "text", out: str = "vec") -> DataFrame:
    """docs with an embedding of each text; make_model() is called once a task and its model takes lists of texts."""

    @F.pandas_udf("array<double>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make_model()
        for texts in batches:
            yield pd.Series([list(map(float, v)) for v in model(texts.fillna("").tolist())])

    return docs.withColumn(out, embed(F.col(text)))


def tokenize_with(docs: DataFrame, make_tokenizer: Callable[[], Callable[[str], list]], text: str = "text", out: str = "tokens") -> DataFrame:
    """docs with the tokens of each text as strings; make_tokenizer() is called once a task."""

    @F.pandas_udf("array<string>")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenizer = make_tokenizer()
        for texts in batches:
            yield pd.Series([[str(t) for t in tokenizer(x)] for x in texts.fillna("")])

    return docs.withColumn(out, tokens(F.col(text)))


def chunk_with(docs: DataFrame, chunker: Callable[[str], list[str]]) -> DataFrame:
    """(doc_id, chunk_index, content): a caller's chunker as a table function over (doc_id, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(doc, i, c) for doc, text in zip(pdf["doc_id"], pdf["text"]) for i, c in enumerate(chunker(text or ""))]
            yield pd.DataFrame(out, columns=["doc_id", "chunk_index", "content"])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, chunk_index int, content string")


def register_chunker(spark: SparkSession, name: str, chunker: Callable[[str], list[str]]) -> None:
    """A caller's chunker as a table function of SQL: `from docs, lateral name(text)` gives (chunk_index, content) of each text; none of a null one."""

    class Chunks:
        def eval(self, text: str):
            if text is not None:
                yield from enumerate(chunker(text))

    spark.udtf.register(name, F.udtf(Chunks, returnType="chunk_index int, content string"))


def compute_on_miss(wanted: DataFrame, memo: DataFrame, on: list[str], compute: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """The values of wanted, stored or computed, and the computed ones alone, for appending to memo; compute gets the missing keys."""
    keys = wanted.select(*on).distinct()
    new = compute(keys.join(memo, on, "left_anti"))
    values = keys.join(memo, on).unionByName(new)
    return wanted.join(values, on), new


def on_each_batch(stream: DataFrame, callbacks: list[Callable[[DataFrame, int], None]], checkpoint: str):
    """Starts a query that calls each callback, such as one that sends alerts, with every batch."""

    def call(batch: DataFrame, n: int) -> None:
        for f in callbacks:
            f(batch, n)

    return stream.writeStream.foreachBatch(call).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
