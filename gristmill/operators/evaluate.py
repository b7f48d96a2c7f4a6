"""Measures of retrieval and of cited answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.functions import text
from gristmill.operators.retrieve import Retriever, usable, with_content


def score(questions: DataFrame, ranked: DataFrame) -> DataFrame:
    """Per question: hit, rank of the first hit, similarity and preview of the first chunk.

    questions: query_id and expected (array); ranked: query_id, rank, similarity and content.
    A question without rows is a miss.
    """
    rows = questions.select("query_id", "expected").join(ranked, "query_id", "left")
    match = F.col("rank").isNotNull() & text.contains_any(F.col("content"), F.col("expected"))
    top = F.min_by(F.struct("similarity", text.preview(F.col("content")).alias("preview")), "rank")
    out = rows.groupBy("query_id").agg(F.min(F.when(match, F.col("rank"))).alias("hit_rank"), top.alias("top"))
    return out.select("query_id", F.col("hit_rank").isNotNull().alias("hit"), "hit_rank", F.col("top.similarity").alias("top_similarity"), F.coalesce("top.preview", F.lit("")).alias("top_content"))


def summary(scored: DataFrame, *by: str) -> DataFrame:
    """Number of questions, hit rate, mean reciprocal rank, mean similarity of the first chunk; zeros for no question."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return scored.groupBy(*by).agg(
        F.count("*").alias("n"),
        zero(F.avg(F.col("hit").cast("double"))).alias("hit_at_k"),
        zero(F.avg(F.coalesce(1.0 / F.col("hit_rank"), F.lit(0.0)))).alias("mrr"),
        zero(F.avg(F.coalesce("top_similarity", F.lit(0.0)))).alias("mean_top_similarity"),
    )


def run(name: str, retriever: Retriever, questions: DataFrame, chunks: DataFrame, k: int = 5) -> DataFrame:
    """Per-question results of a strategy."""
    ranked = with_content(retriever(usable(questions, k), chunks, k), chunks.withColumnRenamed("text", "content"), "content")
    return score(questions, ranked).withColumn("strategy", F.lit(name))


def compare(results: DataFrame, strategies: list[str]) -> DataFrame:
    """A row for each question, a column for each strategy: ``#rank``, ``miss``, or ``-`` where it wasn't run."""
    shown = F.when(F.col("hit"), F.concat(F.lit("#"), F.col("hit_rank").cast("string"))).otherwise("miss")
    table = results.groupBy("query_id").pivot("strategy", strategies).agg(F.first(shown))
    return table.na.fill("-", strategies)


def markdown(summaries: DataFrame) -> DataFrame:
    """One row with a markdown table of summaries by strategy."""
    line = F.format_string("| %s | %d | %.3f | %.3f | %.3f |", "strategy", "n", "hit_at_k", "mrr", "mean_top_similarity")
    body = summaries.select("strategy", line.alias("line")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("strategy", "line"))), lambda x: x["line"]), "\n").alias("body"))
    return body.select(F.concat(F.lit("| strategy | n | hit@k | MRR | top similarity |\n|---|---|---|---|---|\n"), "body").alias("report"))


def citation_metrics(replies: DataFrame, *by: str) -> DataFrame:
    """Measures over replies (verdicts: array of structs, malformed: number); NaN where there is nothing to divide by.

    ``replies_without_citation`` counts replies without parsed citations, ``replies_without_any_mark``
    those without malformed lines as well.
    """
    n = F.size("verdicts")
    facts = replies.select(
        *by,
        n.alias("n"),
        F.size(F.filter("verdicts", lambda v: v["valid"])).alias("valid"),
        F.size(F.filter("verdicts", lambda v: v["valid"] & v["verbatim_strict"])).alias("strict"),
        "malformed",
        *[F.col(c) for c in ("ttft_ms", "latency_ms") if c in replies.columns],
    )
    rate = lambda a, b: F.when(b == 0, F.lit(float("nan"))).otherwise(a / F.when(b == 0, 1).otherwise(b))
    total = F.sum("n")
    return facts.groupBy(*by).agg(
        F.count("*").alias("replies"),
        total.alias("citations"),
        rate(F.count_if(F.col("malformed") == 0), F.count("*")).alias("format_compliance"),
        rate(F.sum("valid"), total).alias("precision_lenient"),
        rate(F.sum("strict"), total).alias("precision_strict"),
        rate(F.count_if(F.col("valid") > 0), F.count("*")).alias("with_valid_citation"),
        F.count_if(F.col("n") == 0).alias("replies_without_citation"),
        F.count_if((F.col("n") == 0) & (F.col("malformed") == 0)).alias("replies_without_any_mark"),
        *[F.median(c).alias(f"median_{c}") for c in ("ttft_ms", "latency_ms") if c in replies.columns],
    )


def answer_passes(answerable, verdicts):
    """A reply passes if it cites validly where an answer was due, and not at all where none was."""
    return F.when(answerable, F.exists(verdicts, lambda v: v["valid"])).otherwise(F.size(verdicts) == 0)


def generation_counters(replies: DataFrame, *by: str) -> DataFrame:
    """Counts over generated replies (error, verdicts, malformed, ttft_ms, latency_ms): answered, errors, what is well formed, cited and valid, and medians.

    A reply with an error counts as nothing else.
    """
    ok = F.col("error").isNull()
    n, valid = F.size("verdicts"), F.size(F.filter("verdicts", lambda v: v["valid"]))
    return replies.groupBy(*by).agg(
        F.count_if(ok).alias("answered"),
        F.count_if(~ok).alias("errors"),
        F.count_if(ok & (F.col("malformed") == 0)).alias("format_compliant"),
        F.count_if(ok & (valid > 0)).alias("with_valid_citation"),
        F.count_if(ok & (n == 0)).alias("without_citation"),
        F.coalesce(F.sum(F.when(ok, n)), F.lit(0)).alias("citations"),
        F.coalesce(F.sum(F.when(ok, valid)), F.lit(0)).alias("valid_citations"),
        F.median(F.when(ok, F.col("ttft_ms"))).alias("median_ttft_ms"),
        F.median(F.when(ok, F.col("latency_ms"))).alias("median_latency_ms"),
    )


def first_questions(questions: DataFrame, n: int, order: str = "query_id") -> DataFrame:
    """The first n questions of an evaluation; all for 0 or less."""
    return questions.orderBy(order).limit(n) if n > 0 else questions
