"""Builders of examples: one row of gold chunks in, examples of five types out.

A builder takes ``golds`` (library, document, chunk_index, text and, where titles are shown, title), all ``chunks`` of the
corpus (the same columns) and a teacher, and gives examples: example_id, type, library, question,
name_style, k, sources (array of structs name, content), gold (array of structs document, index, text),
answer_spans, history, target, answerable.  The second DataFrame of each has what was turned down:
library, document, chunk_index and reason.

Contexts come from BM25 within the library, as a batch for all examples; builders that are given
``stats`` (``retrieve.statistics`` of ``keyed`` chunks, of the terms of all questions at least) share one pass over the corpus.  Choices that look random
are hashes of the chunk's key, so no schedule changes them.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions import text
from gristmill.operators import dataset, retrieve
from gristmill.operators.prompts import Contract

#: Characters of an answer span at most.
SPAN_LIMIT = 200


class Teacher(Protocol):
    """What asks and answers, in Column expressions; models give the same columns through ``plans.models.generate``."""

    def questions(self, passage: Column, n: int) -> Column: ...  # array<struct<question, answer_span>>
    def two_passage_question(self, a: Column, b: Column) -> Column: ...  # struct<question, answer_span_a, answer_span_b>
    def answer(self, question: Column, sources: Column, names: Column, spans: Column) -> Column: ...
    def is_answerable(self, question: Column, span: Column, sources: Column) -> Column: ...
    def describe_sources(self, sources: Column) -> Column: ...
    def partial_check(self, question: Column, reply: Column) -> Column: ...  # struct<covers, acknowledges>


def _key(document: Column, index: Column) -> Column:
    return F.struct(document.alias("document"), index.cast("int").alias("chunk_index"))


def _asked(golds: DataFrame, teacher: Teacher, n: int, kind: str) -> tuple[DataFrame, DataFrame]:
    """A row for each question of each gold whose span stands in it; and the others with their reason."""
    asked = golds.select("*", F.posexplode(teacher.questions(text.collapse(F.col("text"), text.PY_SPACE), n)).alias("seq", "q")).select("*", "q.question", "q.answer_span").drop("q")
    ok = dataset.span_in_passage(F.col("answer_span"), F.col("text"), SPAN_LIMIT)
    named = asked.withColumn("example_id", dataset.example_id(F.lit(kind), F.col("library"), F.col("document"), F.col("chunk_index"), F.col("seq")))
    return named.where(ok), _turned_down(named.where(~ok), "question_span_not_in_passage")


def _turned_down(rows: DataFrame, reason: str) -> DataFrame:
    return rows.select("library", "document", "chunk_index", F.lit(reason).alias("reason"))


Stats = tuple[DataFrame, DataFrame]


def keyed(chunks: DataFrame) -> DataFrame:
    """The chunks as retrieval takes them: chunk_id (document and chunk_index), tenant, text, title."""
    title = F.col("title") if "title" in chunks.columns else F.lit(None).cast("string").alias("title")
    return chunks.select(_key(F.col("document"), F.col("chunk_index")).alias("chunk_id"), F.col("library").alias("tenant"), "text", title)


def context(asked: DataFrame, chunks: DataFrame, top_k: int, near: bool, stats: Stats | None = None) -> DataFrame:
    """``asked`` (example_id, library, question, k, golds: array of keys) with ``context``: its golds (unless ``near``) and the chunks most plausible for the question.

    With ``near`` the golds and the chunks beside them are left out (hard negatives, best first); else
    the golds come with k less their number of others, shuffled.
    """
    reach = (-1, 0, 1) if near else (0,)
    out = F.flatten(F.transform("golds", lambda g: F.array(*[_key(g["document"], g["chunk_index"] + o) for o in reach])))
    most = 2 * len(reach)  # golds are one or two
    content = keyed(chunks)
    ranked = retrieve.bm25(asked.select(F.col("example_id").alias("query_id"), F.col("library").alias("tenant"), F.col("question").alias("text")), content, top_k + most, stats=stats)
    rows = ranked.join(asked.select(F.col("example_id").alias("query_id"), "k", F.size("golds").alias("n"), out.alias("out")), "query_id").where(~F.array_contains("out", F.col("chunk_id")))
    rows = retrieve.top_k(rows.withColumnRenamed("rank", "found"), top_k, F.asc("found")).where(F.col("rank") <= F.col("k") - (F.lit(0) if near else F.col("n")))
    rows = rows.select("query_id", "rank", "chunk_id")
    if not near:
        golds = asked.select(F.col("example_id").alias("query_id"), F.posexplode("golds").alias("rank", "chunk_id"))
        rows = rows.unionByName(golds.select("query_id", (F.col("rank") - 2).alias("rank"), "chunk_id"))
    full = rows.join(content.drop("tenant"), "chunk_id").groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "chunk_id", "text", "title"))).alias("c"))
    as_rows = F.transform("c", lambda x: F.struct(x["chunk_id"]["document"].alias("document"), x["chunk_id"]["chunk_index"].alias("index"), x["text"].alias("text"), x["title"].alias("title")))
    full = full.select(F.col("query_id").alias("example_id"), (as_rows if near else dataset.shuffled(as_rows, F.col("query_id"))).alias("context"))
    return asked.join(full, "example_id", "left").withColumn("context", F.coalesce("context", F.array().cast(full.schema["context"].dataType)))


def sources(context_: Column, style: Column) -> Column:
    """A context as named sources."""
    return F.transform(context_, lambda c: F.struct(text.display_name(c["document"], F.coalesce(c["title"], c["document"]), style).alias("name"), c["text"].alias("content")))


def _gold(document: str, index: str, content: str) -> Column:
    return F.struct(F.col(document).alias("document"), F.col(index).cast("int").alias("index"), F.col(content).alias("text"))


def _finished(rows: DataFrame, kind: str, gold: Column, spans: Column, target: Column, answerable: bool, history: Column | None = None) -> DataFrame:
    none = F.array().cast("array<struct<role:string,content:string>>")
    return rows.select(
        "example_id", F.lit(kind).alias("type"), "library", "question", "name_style", "k", "sources", gold.alias("gold"), spans.alias("answer_spans"),
        (none if history is None else history).alias("history"), target.alias("target"), F.lit(answerable).alias("answerable"), *[c for c in ("covers", "acknowledges") if c in rows.columns],
    )


def _styled(rows: DataFrame, top_k: int, short: bool = True) -> DataFrame:
    seed = F.col("example_id")
    return rows.withColumn("name_style", text.name_style(seed)).withColumn("k", text.context_size(seed, k=top_k).cast("int") if short else F.lit(top_k))


def _gold_name(rows: DataFrame, document: str, title: str = "title") -> Column:
    shown = F.coalesce(F.col(title), F.col(document)) if title in rows.columns else F.col(document)
    return text.display_name(F.col(document), shown, F.col("name_style"))


def single(golds: DataFrame, chunks: DataFrame, teacher: Teacher, top_k: int = 5, n: int = 2, stats: Stats | None = None) -> tuple[DataFrame, DataFrame]:
    """Up to n questions a gold, each with the gold among plausible others."""
    asked, rejected = _asked(golds, teacher, n, "single")
    rows = context(_styled(asked, top_k).withColumn("golds", F.array(_key(F.col("document"), F.col("chunk_index")))), chunks, top_k, near=False, stats=stats)
    rows = rows.withColumn("sources", sources(F.col("context"), F.col("name_style")))
    target = teacher.answer(F.col("question"), F.col("sources"), F.array(_gold_name(rows, "document")), F.array("answer_span"))
    return _finished(rows, "single", F.array(_gold("document", "chunk_index", "text")), F.array("answer_span"), target, True), rejected


def two_gold(golds: DataFrame, chunks: DataFrame, teacher: Teacher, top_k: int = 5, stats: Stats | None = None) -> tuple[DataFrame, DataFrame]:
    """A question over two passages: the gold and one of another document of the library, else one further on."""
    named = golds.withColumn("example_id", dataset.example_id(F.lit("two_gold"), F.col("library"), F.col("document"), F.col("chunk_index"), F.lit(0)))
    worthy = chunks.where(dataset.gold_worthy(text.collapse(F.col("text"))))
    other = chunks.select(F.col("document").alias("partner"), F.col("chunk_index").alias("partner_index"), F.col("text").alias("partner_text"), *([F.col("title").alias("partner_title")] if "title" in chunks.columns else []))
    pairs = dataset.partners(named, worthy).where("partner is not null").join(other, ["partner", "partner_index"])
    flat = lambda c: text.collapse(F.col(c), text.PY_SPACE)
    asked = pairs.withColumn("q", teacher.two_passage_question(flat("text"), flat("partner_text"))).where("q.question is not null").select("*", "q.*").drop("q")
    ok = dataset.span_in_passage(F.col("answer_span_a"), F.col("text"), None) & dataset.span_in_passage(F.col("answer_span_b"), F.col("partner_text"), None)
    rows = _styled(asked.where(ok), top_k, short=False).withColumn("golds", F.array(_key(F.col("document"), F.col("chunk_index")), _key(F.col("partner"), F.col("partner_index"))))
    rows = context(rows, chunks, top_k, near=False, stats=stats)
    rows = rows.withColumn("sources", sources(F.col("context"), F.col("name_style")))
    spans = F.array("answer_span_a", "answer_span_b")
    target = teacher.answer(F.col("question"), F.col("sources"), F.array(_gold_name(rows, "document"), _gold_name(rows, "partner", "partner_title")), spans)
    gold = F.array(_gold("document", "chunk_index", "text"), _gold("partner", "partner_index", "partner_text"))
    return _finished(rows, "two_gold", gold, spans, target, True), _turned_down(asked.where(~ok), "two_gold_span_not_in_passage")


def negative(golds: DataFrame, chunks: DataFrame, teacher: Teacher, top_k: int = 5, contract: Contract = Contract(), stats: Stats | None = None) -> tuple[DataFrame, DataFrame]:
    """A question whose gold, and what lies beside it, is missing from the sources; the target abstains and says what they cover."""
    asked, rejected = _asked(golds, teacher, 1, "negative")
    rows = context(_styled(asked, top_k).withColumn("golds", F.array(_key(F.col("document"), F.col("chunk_index")))), chunks, top_k, near=True, stats=stats).where(F.size("context") > 0)
    rows = rows.withColumn("sources", sources(F.col("context"), F.col("name_style")))
    still = teacher.is_answerable(F.col("question"), F.col("answer_span"), F.col("sources"))
    said = teacher.describe_sources(F.col("sources"))
    target = F.concat(F.lit(contract.abstention()), F.when(F.length(said) > 0, F.concat(F.lit(" "), said)).otherwise(""))
    done = _finished(rows.where(~still), "negative", F.array(_gold("document", "chunk_index", "text")), F.array("answer_span"), target, False)
    return done, rejected.unionByName(_turned_down(rows.where(still), "negative_still_answerable"))


def partial(golds: DataFrame, chunks: DataFrame, teacher: Teacher, top_k: int = 5, stats: Stats | None = None) -> tuple[DataFrame, DataFrame]:
    """A question in two parts, of which the sources answer the first: the second is of a chunk further on in the document."""
    asked, rejected = _asked(golds, teacher, 1, "partial")
    worthy = chunks.where(dataset.gold_worthy(text.collapse(F.col("text")))).select("document", F.col("chunk_index").alias("far_index"), F.col("text").alias("far_text"))
    h = F.md5(F.concat_ws("|", F.lit("partial"), "document", F.col("far_index").cast("string")))
    far = asked.select("example_id", "document", "chunk_index").join(worthy, "document").where(F.abs(F.col("chunk_index") - F.col("far_index")) > 2)
    far = far.groupBy("example_id").agg(F.min_by(F.struct("far_index", "far_text"), h).alias("far")).select("example_id", "far.*")
    second = far.select("*", teacher.questions(text.collapse(F.col("far_text"), text.PY_SPACE), 1)[0].alias("o")).where(dataset.span_in_passage(F.col("o.answer_span"), F.col("far_text"), SPAN_LIMIT))
    rows = asked.join(second.select("example_id", "far_index", F.col("o.question").alias("other_question")), "example_id")
    rows = context(_styled(rows, top_k, short=False).withColumn("golds", F.array(_key(F.col("document"), F.col("chunk_index")))), chunks, top_k, near=False, stats=stats)
    rows = rows.withColumn("context", dataset.prune_near(F.col("context"), F.col("document"), F.col("far_index"))).withColumn("k", F.size("context"))
    rows = rows.withColumn("sources", sources(F.col("context"), F.col("name_style"))).withColumn("question", text.compose_questions(F.col("question"), F.col("other_question")))
    rows = rows.withColumn("gm_target", teacher.answer(F.col("question"), F.col("sources"), F.array(_gold_name(rows, "document")), F.array("answer_span")))
    rows = rows.select("*", teacher.partial_check(F.col("question"), F.col("gm_target")).alias("gm_check")).select("*", "gm_check.*")
    return _finished(rows, "partial", F.array(_gold("document", "chunk_index", "text")), F.array("answer_span"), F.col("gm_target"), True), rejected


def multiturn(first: DataFrame, golds: DataFrame, pairs: DataFrame, chunks: DataFrame, teacher: Teacher, top_k: int = 5, contract: Contract = Contract(), stats: Stats | None = None) -> tuple[DataFrame, DataFrame]:
    """A follow-up to each kept single example: half have their gold in the sources, a quarter don't, a quarter have no sources.

    pairs: example_id of the first and gold_id of the second; golds have gold_id.
    """
    turns = F.array(F.struct(F.lit("user").alias("role"), F.col("first_question").alias("content")), F.struct(F.lit("assistant").alias("role"), F.coalesce("first_target", F.lit("")).alias("content")))
    before = first.select(F.col("example_id").alias("first_id"), F.col("question").alias("first_question"), F.col("target").alias("first_target"), F.col("name_style").alias("first_style"))
    follow = golds.join(pairs.select("gold_id", F.col("example_id").alias("first_id")), "gold_id").join(before, "first_id")
    asked, rejected = _asked(follow, teacher, 1, "multiturn")
    u = text.unit_choice(F.lit("variant"), F.col("example_id"), F.col("first_id"))
    rows = asked.withColumn("variant", F.when(u < 0.5, "answerable").when(u < 0.75, "uncovered").otherwise("empty")).withColumn("name_style", F.col("first_style")).withColumn("k", F.lit(top_k))
    rows = rows.withColumn("golds", F.array(_key(F.col("document"), F.col("chunk_index"))))
    gold, spans = F.array(_gold("document", "chunk_index", "text")), F.array("answer_span")

    answered = context(rows.where("variant = 'answerable'"), chunks, top_k, near=False, stats=stats)
    answered = answered.withColumn("sources", sources(F.col("context"), F.col("name_style")))
    target = teacher.answer(F.col("question"), F.col("sources"), F.array(_gold_name(answered, "document")), spans)
    one = _finished(answered, "multiturn_answerable", gold, spans, target, True, turns)

    missing = context(rows.where("variant = 'uncovered'"), chunks, top_k, near=True, stats=stats)
    missing = missing.withColumn("sources", sources(F.col("context"), F.col("name_style")))
    still = teacher.is_answerable(F.col("question"), F.col("answer_span"), F.col("sources"))
    two = _finished(missing.where(~still), "multiturn_uncovered", gold, spans, F.lit(contract.abstention()), False, turns)

    empty = rows.where("variant = 'empty'").withColumn("k", F.lit(0)).withColumn("sources", F.array().cast("array<struct<name:string,content:string>>"))
    three = _finished(empty, "multiturn_empty", gold, spans, F.lit(contract.no_sources_reply), False, turns)
    return one.unionByName(two).unionByName(three), rejected.unionByName(_turned_down(missing.where(still), "negative_still_answerable"))


def rejections(*turned_down: DataFrame) -> DataFrame:
    """reason and n over what the builders turned down."""
    every = turned_down[0]
    for t in turned_down[1:]:
        every = every.unionByName(t)
    return every.groupBy("reason").agg(F.count("*").alias("n"))


def review(checked: DataFrame) -> DataFrame:
    """example_id and a markdown section of each checked example, for reading by hand."""
    none = F.lit(None).cast("string")
    names = F.array_join(F.array_distinct(F.transform("sources", lambda s: s["name"])), "; ")
    history = F.array_join(F.transform("history", lambda m: F.concat(F.lit("- history "), m["role"], F.lit(": "), F.substring(m["content"], 1, 200))), "\n")
    repairs = F.array_join(F.transform("repairs", lambda r: F.concat(F.lit("- repair `"), r["kind"], F.lit("`: `"), r["was"], F.lit("` -> `"), r["now"], F.lit("`"))), "\n") if "repairs" in checked.columns else none
    some = lambda c: F.when(F.length(c) > 0, c)
    head = F.format_string("## [%s] %s | %s | names=%s k=%d", F.col("type"), F.coalesce("reason", F.lit("ok")), F.col("library"), F.col("name_style"), F.size("sources"))
    spans = F.when(F.size("answer_spans") > 0, F.concat(F.lit("**Gold span(s):** "), F.array_join("answer_spans", " | ")))
    body = F.concat_ws("\n\n", head, some(history), F.concat(F.lit("**Q:** "), "question"), F.concat(F.lit("**Sources:** "), F.coalesce(some(names), F.lit("(none)"))), spans, some(repairs), F.concat(F.lit("**A:**\n\n```text\n"), F.coalesce("target", F.lit("")), F.lit("\n```")))
    return checked.select("example_id", body.alias("section"))
