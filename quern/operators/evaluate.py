"""Retrieval, answer and run metrics, A/B comparison and request statistics as aggregates over whole tables."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clamp, raw_words, share, strip, word_set, words
from .order import exact_quantiles
from .monitor import dot_sentences, variance
from .ranking import small_side


def judged(hits: DataFrame, golden: DataFrame) -> DataFrame:
    """Hits (query_id, doc_id, rank) with rel and n_relevant; golden (query_id, doc_id), each pair once. Queries without golden documents drop out, golden queries without hits stay with null doc_id."""
    g = golden.select("query_id", "doc_id").distinct()
    n = g.groupBy("query_id").agg(F.count("*").alias("n_relevant"))
    marked = hits.join(g.withColumn("rel", F.lit(1)), ["query_id", "doc_id"], "left")
    return n.join(marked, "query_id", "left").withColumn("rel", F.coalesce("rel", F.lit(0)))


def judged_by_label(hits: DataFrame, queries: DataFrame, items: DataFrame) -> DataFrame:
    """judged where the golden documents of a query (query_id, label) are all items (doc_id, label) of its label, without a row for a golden pair.

    Items are counted by their labels, so a query's n_relevant is looked up, and a hit's labels are compared. A query or item with
    several labels counts each pair once; null labels are no label.
    """
    q = queries.groupBy("query_id").agg(F.collect_set("label").alias("_asked"))
    d = items.groupBy("doc_id").agg(F.array_sort(F.collect_set("label")).alias("_own"))
    asked, classes = q.select(F.array_sort("_asked").alias("_asked")).distinct(), d.groupBy("_own").agg(F.count("*").alias("_c"))
    met = asked.withColumn("_l", F.explode("_asked")).join(classes.withColumn("_l", F.explode("_own")), "_l").select("_asked", "_own", "_c").distinct()
    n = small_side(met.groupBy("_asked").agg(F.sum("_c").alias("n_relevant")))
    own = q.withColumn("_asked", F.array_sort("_asked")).join(n, "_asked").select("query_id", "n_relevant", "_asked")
    marked = own.join(hits, "query_id", "left").join(d, "doc_id", "left")
    rel = F.coalesce(F.arrays_overlap("_asked", "_own").cast("int"), F.lit(0))
    return marked.withColumn("rel", rel).select("query_id", "n_relevant", *(c for c in hits.columns if c != "query_id"), "rel")


def _hit(k: int) -> Column:
    return F.when(F.col("rank") <= k, F.col("rel")).otherwise(0)


def retrieval_metrics(j: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10), distinct: bool = False) -> DataFrame:
    """Per query: recall_k, precision_k, ndcg_k, mrr and average precision."""
    own = j.dropDuplicates(["query_id", "doc_id"]) if distinct else j
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    own = own.withColumn("_seen", F.sum("rel").over(w))
    log2 = lambda c: F.log2(c + 1)
    aggs = [F.first("n_relevant").alias("n_relevant")]
    for k in ks:
        aggs += [
            (F.sum(_hit(k)) / F.first("n_relevant")).alias(f"recall_{k}"),
            F.coalesce(F.sum(_hit(k)) / F.nullif(F.count_if(F.col("rank") <= k), F.lit(0)), F.lit(0.0)).alias(f"precision_{k}"),
            F.coalesce(F.sum(F.when(F.col("rank") <= k, F.col("rel") / log2(F.col("rank")))), F.lit(0.0)).alias(f"_dcg_{k}"),
        ]
    aggs += [F.coalesce(1 / F.min(F.when(F.col("rel") == 1, F.col("rank"))), F.lit(0.0)).alias("mrr"), (F.coalesce(F.sum(F.when(F.col("rel") == 1, F.col("_seen") / F.col("rank"))), F.lit(0.0)) / F.first("n_relevant")).alias("average_precision")]
    out = own.groupBy("query_id").agg(*aggs)
    for k in ks:
        ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), F.col("n_relevant").cast("int"))), F.lit(0.0), lambda a, i: a + 1 / log2(i))
        out = out.withColumn(f"ndcg_{k}", F.col(f"_dcg_{k}") / ideal).drop(f"_dcg_{k}")
    return out


def evaluate_retrieval(per_query: DataFrame) -> DataFrame:
    """One row of means."""
    return per_query.agg(F.count("*").alias("queries"), *(F.avg(c).alias(c) for c in per_query.columns if c not in ("query_id", "n_relevant")))


def evaluate_search_run(per_query: DataFrame, times: DataFrame) -> DataFrame:
    """Means with p50, p90 and p99 of latency (query_id, latency_ms)."""
    own = per_query.join(times, "query_id")
    one = own.agg(F.avg("recall_5").alias("recall_5"), F.avg("mrr").alias("mrr")).join(F.broadcast(exact_quantiles(own, "latency_ms", (0.5, 0.9, 0.99))), how="left")  # one row each
    return one.select("recall_5", "mrr", *(F.col("q")[i].alias(n) for i, n in enumerate(("p50", "p90", "p99"))))


def bleu(rows: DataFrame) -> DataFrame:
    """(id, bleu_1..bleu_4) of (id, candidate, reference), lower-cased words, geometric weights over the first n orders.

    A zero count gets the smoothing 1 / (2^m x log(5) / log(length)) of the m-th zero order; texts without words score 0.
    """

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(c: str | None, ref: str | None) -> list[float]:
            x, y = (c or "").lower().split(), (ref or "").lower().split()
            if not x or not y:
                return [0.0] * 4
            ps, zeros = [], 0
            for n in range(1, 5):
                a, b = (Counter(tuple(t[i : i + n]) for i in range(len(t) - n + 1)) for t in (x, y))
                top, total = sum(min(v, b[g]) for g, v in a.items()), max(1, sum(a.values()))
                if top:
                    ps.append(top / total)
                elif n == 1:
                    return [0.0] * 4
                else:
                    zeros += 1
                    ps.append((1 / (2**zeros * 5 / math.log(len(x)))) / total if len(x) > 1 else 0.0)
            brief = 1.0 if len(x) > len(y) else math.exp(1 - len(y) / len(x))
            return [brief * math.exp(sum(math.log(p) for p in ps[:n]) / n) if all(ps[:n]) else 0.0 for n in range(1, 5)]

        for pdf in batches:
            found = [one(c, ref) for c, ref in zip(pdf["candidate"], pdf["reference"])]
            yield pd.DataFrame({"id": pdf["id"], **{f"bleu_{n + 1}": [f[n] for f in found] for n in range(4)}})

    return rows.select("id", "candidate", "reference").mapInPandas(score, "id long, bleu_1 double, bleu_2 double, bleu_3 double, bleu_4 double")


def ngrams(c: Column, n: int) -> Column:
    w = words(c)
    return w if n == 1 else F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, n), " "))


def rouge_n(rows: DataFrame, n: int) -> DataFrame:
    """(id, precision, recall, f) of n-gram overlap of (id, candidate, reference)."""
    enough = lambda c: F.when(F.size(words(c)) >= n, ngrams(c, n)).otherwise(F.array().cast("array<string>"))
    own = rows.select("id", enough(F.col("candidate")).alias("x"), enough(F.col("reference")).alias("y"))
    grams = own.select("id", F.explode("x").alias("g"), F.lit(1).alias("a"), F.lit(0).alias("b")).union(own.select("id", F.explode("y"), F.lit(0), F.lit(1)))
    both = grams.groupBy("id", "g").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).groupBy("id").agg(F.sum(F.least("a", "b")).alias("m"))
    joined = own.select("id", F.size("x").alias("nx"), F.size("y").alias("ny")).join(both, "id", "left").fillna(0, ["m"])
    p, q = share(F.col("m"), F.col("nx")), share(F.col("m"), F.col("ny"))
    return joined.select("id", p.alias("precision"), q.alias("recall"), share(2 * p * q, p + q).alias("f"))


def rouge_l(rows: DataFrame) -> DataFrame:
    """(id, precision, recall, f) of the longest common subsequence of words."""

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def lcs(x: list[str], y: list[str]) -> int:
            row = [0] * (len(y) + 1)
            for a in x:
                corner = 0
                for j, b in enumerate(y, 1):
                    corner, row[j] = row[j], corner + 1 if a == b else max(row[j], row[j - 1])
            return row[-1]

        for pdf in batches:
            out = []
            for c, ref in zip(pdf["candidate"], pdf["reference"]):
                x, y = (c or "").lower().split(), (ref or "").lower().split()
                m = lcs(x, y)
                p, q = m / len(x) if x else 0.0, m / len(y) if y else 0.0
                out.append((p, q, 2 * p * q / (p + q) if p + q else 0.0))
            yield pd.DataFrame({"id": pdf["id"], **{n: [o[i] for o in out] for i, n in enumerate(("precision", "recall", "f"))}})

    return rows.select("id", "candidate", "reference").mapInPandas(score, "id long, precision double, recall double, f double")


def embedding_score(a: Column, b: Column) -> Column:
    from ..functions.embeddings import cosine

    return cosine(a, b)


def groundedness(answer_vec: Column, context_vec: Column) -> Column:
    from ..functions.embeddings import cosine

    return clamp(cosine(answer_vec, context_vec))


def faithfulness() -> Column:
    """Share of the answer's distinct words in the first three documents."""
    a = word_set(F.col("response"))
    c = word_set(F.array_join(F.slice(F.coalesce("docs", F.array().cast("array<string>")), 1, 3), " "))
    return share(F.size(F.array_intersect(a, c)), F.size(a))


def answer_relevance() -> Column:
    q = word_set(F.col("query"))
    return share(F.size(F.array_intersect(q, word_set(F.col("response")))), F.size(q))


#: Transition words.
TRANSITIONS = ("however", "therefore", "furthermore", "moreover", "additionally", "consequently", "meanwhile", "nevertheless", "thus", "hence")


def answer_coherence() -> Column:
    a = F.coalesce(F.col("response"), F.lit(""))
    s = dot_sentences(a)
    n, w = F.size(s), F.size(raw_words(a)).cast("double")
    lengths = F.transform(s, lambda x: F.size(raw_words(x)).cast("double"))
    even = F.when(n > 1, 0.3 / (1 + variance(lengths) / 100)).otherwise(0.3)
    links = 0.2 * F.least(F.lit(1.0), F.size(F.array_intersect(word_set(a), F.array(*map(F.lit, TRANSITIONS)))) / F.greatest(F.lit(1), n - 1))
    whole = F.when(w.between(10, 200), 1.0).when(w < 10, w / 10).otherwise(F.greatest(F.lit(0.5), 200 / w))
    return F.when((strip(a) == "") | (n == 0), 0.0).otherwise(F.least(F.lit(1.0), even + links + 0.5 * whole))


def informativeness(coverage: Column | None = None) -> Column:
    w = raw_words(F.col("response"))
    n = F.size(w)
    rich = F.size(F.filter(w, lambda x: x.rlike("[0-9]"))) + F.size(F.filter(w, lambda x: x.rlike("^[A-Z].")))
    value = 0.4 * share(F.size(F.array_distinct(words(F.col("response")))), n) + 0.3 * share(rich, n) + 0.3 * (F.lit(0.5) if coverage is None else coverage)
    return F.when(n == 0, 0.0).otherwise(F.least(F.lit(1.0), value))


def evaluate_rag(rows: DataFrame) -> DataFrame:
    """One row: means of the answer scores, and the mean of those."""
    parts = {"faithfulness": faithfulness(), "relevance": answer_relevance(), "coherence": answer_coherence(), "informativeness": informativeness()}
    one = rows.agg(F.count("*").alias("n"), *(F.avg(c).alias(n) for n, c in parts.items()))
    return one.withColumn("overall", sum(F.col(c) for c in parts) / len(parts))


def evaluate_generation(rows: DataFrame) -> DataFrame:
    """One row: mean BLEU and ROUGE-L."""
    b, x = bleu(rows), rouge_l(rows)
    one = b.join(x, "id").agg(*(F.avg(c).alias(c) for c in ("bleu_1", "bleu_2", "bleu_3", "bleu_4")), F.avg("f").alias("rouge_l"))
    return one


def request_log(requests: DataFrame) -> DataFrame:
    """Requests (ts, response_ms, memory_mb, error) with memory 0 as null."""
    return requests.withColumn("memory_mb", F.nullif("memory_mb", F.lit(0.0)))


def request_stats(log: DataFrame) -> DataFrame:
    span = F.unix_micros(F.max(F.col("ts").cast("timestamp"))) - F.unix_micros(F.min(F.col("ts").cast("timestamp")))
    one = log.agg(F.count("*").alias("requests"), F.avg("response_ms").alias("mean_ms"), F.max("memory_mb").alias("peak_mb"), F.avg("memory_mb").alias("mean_mb"), F.avg(F.col("error").cast("int")).alias("error_rate"), (F.count("*") / (span / 1e6)).alias("qps"))
    one = one.join(F.broadcast(exact_quantiles(log, "response_ms", (0.95, 0.99))), how="left")  # one row each
    return one.select("requests", "mean_ms", F.col("q")[0].alias("p95_ms"), F.col("q")[1].alias("p99_ms"), "peak_mb", "mean_mb", "error_rate", "qps")


def overall_score(runs: DataFrame) -> DataFrame:
    """overall of run rows (run_id, retrieval, generation, rag, mean_ms): 0.3, 0.25, 0.35 and 0.1, the last for speed against a second."""
    speed = F.greatest(F.lit(0.0), 1 - F.col("mean_ms") / 1000)
    return runs.withColumn("overall", clamp(0.3 * F.col("retrieval") + 0.25 * F.col("generation") + 0.35 * F.col("rag") + 0.1 * speed))


def evaluate_all(retrieval: DataFrame, generation: DataFrame, rag: DataFrame, requests: DataFrame, run_id: str) -> DataFrame:
    """One run row from the four one-row tables."""
    one = retrieval.select(((F.col("recall_5") + F.col("mrr") + F.col("ndcg_5")) / 3).alias("retrieval"))
    one = one.join(F.broadcast(generation.select(((F.col("bleu_4") + F.col("rouge_l")) / 2).alias("generation")))).join(F.broadcast(rag.select(F.col("overall").alias("rag")))).join(F.broadcast(requests.select("mean_ms")))
    return overall_score(one).withColumn("run_id", F.lit(run_id))


def compare_baseline(runs: DataFrame, baseline: str) -> DataFrame:
    """Differences of each run to the baseline run."""
    names = ("retrieval", "generation", "rag", "overall")
    base = runs.filter(F.col("run_id") == baseline).select(*(F.col(c).alias(f"_{c}") for c in names))
    return runs.filter(F.col("run_id") != baseline).join(F.broadcast(base)).select("run_id", *((F.col(c) - F.col(f"_{c}")).alias(f"{c}_diff") for c in names))


def run_trends(runs: DataFrame, key: str, last: int = 5) -> DataFrame:
    """Trend, mean and deviation of each run's last scores, per key, by ts."""
    w = Window.partitionBy(key).orderBy("ts", "run_id").rowsBetween(1 - last, 0)
    first, now = F.first("overall").over(w), F.last("overall").over(w)
    return runs.select(key, "run_id", F.when(now > first, "improving").otherwise("declining").alias("trend"), F.avg("overall").over(w).alias("mean"), F.stddev_pop("overall").over(w).alias("deviation"))


#: (metric, bound, message) of the advice.
ADVICE = (("recall_5", 0.7, "Improve retrieval recall"), ("precision_5", 0.6, "Improve retrieval precision"), ("rag", 0.7, "Improve answer quality"), ("generation", 0.6, "Improve generation quality"))


def recommendations(metrics: DataFrame) -> DataFrame:
    made = F.array(*(F.when(F.col(m) < b, F.lit(text)) for m, b, text in ADVICE))
    return metrics.withColumn("advice", F.array_compact(made))


def grade_run(metrics: DataFrame, names: tuple[str, ...]) -> DataFrame:
    mean = sum(F.col(n) for n in names) / len(names)
    return metrics.withColumn("grade", F.when(mean >= 0.8, "Excellent").when(mean >= 0.7, "Good").when(mean >= 0.6, "Fair").otherwise("Needs Improvement"))


def source_analysis(hits: DataFrame) -> DataFrame:
    """Per source: hits, share of all, mean, median and deviation of the score."""
    own = hits.groupBy("source").agg(F.count("*").alias("n"), F.avg("score").alias("mean"), F.stddev_pop("score").alias("deviation"))
    middle = exact_quantiles(hits, "score", (0.5,), ("source",)).select(F.col("source").alias("_source"), F.col("q")[0].alias("median"))
    own = own.join(middle, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    total = own.agg(F.sum("n").alias("_total"))
    return own.join(F.broadcast(total)).withColumn("share", F.col("n") / F.col("_total")).drop("_total")


def compare_modes(runs: DataFrame, metrics: tuple[str, ...]) -> DataFrame:
    """Enhanced minus basic of each metric over rows (query_id, mode, metrics)."""
    one = runs.groupBy().pivot("mode", ["basic", "enhanced"]).agg(*(F.avg(m).alias(m) for m in metrics))
    return one.select(*((F.col(f"enhanced_{m}") - F.col(f"basic_{m}")).alias(f"{m}_diff") for m in metrics))


def ab_assign(users: DataFrame, split: float = 0.5, user: str = "user_id") -> DataFrame:
    bucket = F.conv(F.substring(F.md5(F.col(user).cast("string").cast("binary")), 1, 8), 16, 10).cast("long") % 100 / 100
    return users.withColumn("arm", F.when(bucket < split, "A").otherwise("B"))


def ab_runs(results: DataFrame, experiments: DataFrame) -> DataFrame:
    """Results of known experiments."""
    return results.join(experiments.select("experiment").distinct(), "experiment", "left_semi")


def ab_analyze(results: DataFrame, metric: str = "score") -> DataFrame:
    """Per experiment: arm means and sizes, winner, gap and the pooled t statistic."""
    one = results.groupBy("experiment").pivot("arm", ["A", "B"]).agg(F.avg(metric).alias("mean"), F.var_samp(metric).alias("var"), F.count(F.lit(1)).alias("n"))
    pooled = ((F.col("A_n") - 1) * F.col("A_var") + (F.col("B_n") - 1) * F.col("B_var")) / (F.col("A_n") + F.col("B_n") - 2)
    t = (F.col("A_mean") - F.col("B_mean")) / F.sqrt(pooled * (1 / F.col("A_n") + 1 / F.col("B_n")))
    own = one.filter("A_n > 0 and B_n > 0")
    return own.select("experiment", "A_mean", "B_mean", "A_n", "B_n", F.when(F.col("A_mean") > F.col("B_mean"), "A").otherwise("B").alias("winner"), F.abs(F.col("A_mean") - F.col("B_mean")).alias("gap"), t.alias("t"))


def with_p_value(analysis: DataFrame) -> DataFrame:
    """p_value and significant of the two-sided t test, by a continued fraction of the incomplete beta function."""

    def beta(a: float, b: float, x: float) -> float:
        if x <= 0 or x >= 1:
            return float(x >= 1)
        if x > (a + 1) / (a + b + 2):
            return 1 - beta(b, a, 1 - x)
        front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
        c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
        f = d
        for m in range(1, 300):
            for even in (True, False):
                k = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if even else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
                d, c = 1 / (1 + k * d), 1 + k / c
                f *= c * d
            if abs(c * d - 1) < 1e-12:
                break
        return front * f

    @F.pandas_udf("double")
    def p(t: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series([beta(n / 2, 0.5, n / (n + x * x)) if x == x else 1.0 for x, n in zip(t, df)])

    return analysis.withColumn("p_value", p(F.col("t"), (F.col("A_n") + F.col("B_n") - 2).cast("double"))).withColumn("significant", F.col("p_value") < 0.05)


def ab_message(analysis: DataFrame, bound: float = 1.96) -> DataFrame:
    """The verdict; significance by the t statistic's normal bound where no p value is given."""
    sure = F.col("significant") if "significant" in analysis.columns else F.abs("t") > bound
    better, worse = F.greatest("A_mean", "B_mean"), F.least("A_mean", "B_mean")
    text = F.concat(F.lit("Configuration "), "winner", F.lit(" is significantly better by "), F.format_string("%.1f", (better - worse) / worse * 100), F.lit("%. Recommend deploying "), "winner", F.lit("."))
    return analysis.withColumn("message", F.when(sure, text).otherwise("No statistically significant difference found. More data may be needed."))


def retriever_bench(runs: dict[str, DataFrame], exact: str) -> DataFrame:
    """(method, queries, results, mean_score, overlap) of runs (query_id, doc_id, score): results a query, and the share that the exact run has too."""
    truth = runs[exact].select("query_id", "doc_id", F.lit(1).alias("_in"))
    one = reduce(DataFrame.unionByName, [r.select("query_id", "doc_id", "score", F.lit(m).alias("method")) for m, r in runs.items()])
    own = one.join(truth, ["query_id", "doc_id"], "left")
    return own.groupBy("method").agg(F.countDistinct("query_id").alias("queries"), (F.count("*") / F.countDistinct("query_id")).alias("results"), F.avg("score").alias("mean_score"), (F.count("_in") / F.count("*")).alias("overlap"))
