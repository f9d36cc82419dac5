"""The embedding job splits a text once for its boost, and cleans whole texts as it would word by word."""

from pyspark.sql import functions as F

from quern.functions.text import words
from quern.operators import embed


def test_boost_is_made_once_a_row(spark):
    rows = spark.createDataFrame([(i, "en" if i % 3 else None, f"alpha beta, gamma {i % 5} delta" if i % 4 else None, [1.0, -2.0, float(i)]) for i in range(40)], "doc_id long, lang string, text string, vec array<double>")
    out = embed.embedding_pipeline(rows, "lang")
    plan = out.select("doc_id", "scale", "norm")._jdf.queryExecution().optimizedPlan().toString()
    holding = [line for line in plan.splitlines() if "array_intersect" in line]
    assert holding and all("Generate explode" in line for line in holding)  # not in a lambda over the embedding's numbers
    terms = {r.lang: set(r.terms or []) for r in embed.domain_vocabulary(rows, "lang").collect()}
    assert terms["en"] >= {"alpha", "beta", "gamma", "delta"}
    for r in out.collect():
        own = set((f"alpha beta, gamma {r.doc_id % 5} delta" if r.doc_id % 4 else "").split())
        boost = 1 + 0.1 * len(own & terms["en"] if r.lang else set()) / max(len(own), 1)
        assert abs(r.boost - boost) < 1e-12 and abs(r.scale - max(2.0, r.doc_id) * boost / 127) < 1e-12


def test_terms_of_odd_texts(spark):
    texts = ["", None, " a-bc  D'ef.g ", "x yy zzz\u0085www\x1cvvv", "É́té ²³¹x İİİ straße\tÀÇÈ", "!!! --- a!b!c 12.34,5 \n_under_score_", "日本語テキスト 한국어 \U0001d400\U0001d401\U0001d402"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    by_word = F.filter(F.transform(words(F.col("text")), lambda w: F.regexp_replace(w, r"[^\p{L}\p{N}]", "")), lambda w: F.length(w) > 2)
    for r in df.select(embed.clean_terms().alias("a"), by_word.alias("b")).collect():
        assert r.a == r.b
