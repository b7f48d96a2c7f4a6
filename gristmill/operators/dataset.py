"""Datasets of cited answers: sampling, contexts, filters with counted reasons, deduplication, splits.

An example has example_id, type, library, question, sources (array of structs name, content),
gold (array of structs document, index, text), answerable, target.  Choices that look random
come from hashes of ids, so no schedule changes them.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from math import ceil
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from gristmill.functions import repair, text
from gristmill.operators import citations
from gristmill.operators.prompts import Contract

MIN_GOLD, MIN_LETTERS, PER_DOCUMENT = 350, 0.6, 40
#: Characters that an example may have with its prompt: 3072 tokens of 3.2 characters.
MAX_CHARS = 9830
MIX = {"single": 0.60, "two_gold": 0.10, "negative": 0.18, "partial": 0.05, "multiturn": 0.07}
TEST, VALIDATION = ("health-guides", "wikipedia-technology"), ("rust-book",)


def gold_worthy(content: Column) -> Column:
    return (F.length(content) >= MIN_GOLD) & (text.letter_share(content) >= MIN_LETTERS)


def sample_gold(chunks: DataFrame, n: int, seed: str = "0", per_document: int = PER_DOCUMENT) -> DataFrame:
    """n chunks in turns over libraries and their documents, with their place; chunks: library, document, chunk_index, text.

    The order of turns is round, library, document, so a plain sort gives it.
    """
    w = Window.partitionBy("document").orderBy(F.md5(F.concat_ws("|", F.lit(seed), "document", F.col("chunk_index").cast("string"))))
    worthy = F.transform(F.array(text.collapse(F.col("text"))), gold_worthy)[0]  # collapsed once for all its uses
    ranked = chunks.where(worthy).withColumn("round", F.row_number().over(w)).where(F.col("round") <= per_document)
    first = ranked.orderBy("round", "library", "document").limit(n)
    return first.withColumn("place", F.row_number().over(Window.orderBy("round", "library", "document")))


def span_in_passage(span: Column, passage: Column, limit: int | None = 200) -> Column:
    """Whether a non-empty flattened span stands in the flattened passage, within the limit if there is one."""
    s = text.collapse(span, text.PY_SPACE)
    inside = (F.length(s) > 0) & F.contains(text.collapse(passage, text.PY_SPACE), s)
    return inside & (F.length(s) <= limit) if limit else inside


def partners(golds: DataFrame, chunks: DataFrame, gap: int = 1) -> DataFrame:
    """For each gold chunk a second one: of another document of its library, else of its own more than ``gap`` away.

    Only the first few chunks of each library and document by hash are candidates: of those that fit, the first is taken.
    """
    h = F.md5(F.concat_ws("|", F.lit("partner"), "document", F.col("chunk_index").cast("string")))
    c = chunks.select("library", "document", "chunk_index", h.alias("h"))
    # the first chunk of each of a library's two first documents: one of them is another document
    first = c.groupBy("library", "document").agg(F.min(F.struct("h", "chunk_index")).alias("m"))
    two = first.withColumn("r", F.row_number().over(Window.partitionBy("library").orderBy("m.h", "document"))).where("r <= 2")
    two = two.select("library", F.col("document").alias("other"), F.col("m.chunk_index").alias("other_index"), F.lit(0).alias("own"), "r")
    far = golds.alias("g").join(c.select("document", F.col("chunk_index").alias("other_index"), "h"), "document").where(F.abs(F.col("g.chunk_index") - F.col("other_index")) > gap)
    far = far.groupBy("example_id").agg(F.min_by("other_index", "h").alias("far_index"))
    near = golds.join(two, "library").where("other <> document").groupBy("example_id").agg(F.min_by(F.struct("other", "other_index"), "r").alias("x"))
    out = golds.join(near, "example_id", "left").join(far, "example_id", "left")
    return out.select(golds["*"], F.coalesce("x.other", F.when(F.col("far_index").isNotNull(), F.col("document"))).alias("partner"), F.coalesce("x.other_index", "far_index").alias("partner_index"))


def prune_near(context: Column, document: Column, index: Column) -> Column:
    """A context (array of structs with document and index) without chunks beside the given one, or as it was if none would be left."""
    kept = F.filter(context, lambda c: ~((c["document"] == document) & (F.abs(c["index"] - index) <= 1)))
    return F.when(F.size(kept) == 0, context).otherwise(kept)


def shuffled(context: Column, seed: Column) -> Column:
    """A context in an order that the seed decides."""
    keyed = F.transform(context, lambda c, i: F.struct(F.md5(F.concat_ws("|", seed, i.cast("string"))).alias("k"), c.alias("c")))
    return F.transform(F.array_sort(keyed), lambda x: x["c"])


def pair_turns(kept: DataFrame, unused: DataFrame) -> DataFrame:
    """Kept examples and unused golds of one library, each used once, of another document where there is one.

    Both sides lie sorted by document, then by hash, and the golds are turned by the size of the
    library's largest document among either, so that a document's examples meet golds behind its own
    as far as there are enough of others.
    """
    by = lambda c: Window.partitionBy("library").orderBy("document", F.md5(F.col(c).cast("string")))
    a = kept.select("library", F.col("document"), "example_id", (F.row_number().over(by("example_id")) - 1).alias("n"))
    b = unused.select("library", F.col("document"), "gold_id", (F.row_number().over(by("gold_id")) - 1).alias("m"))
    sizes = lambda df: df.groupBy("library", "document").agg(F.count("*").alias("k")).groupBy("library").agg(F.max("k").alias("k"), F.sum("k").alias("total"))
    facts = sizes(a).select("library", F.col("k").alias("ka")).join(sizes(b).select("library", F.col("k").alias("kb"), "total"), "library")
    turned = b.join(facts, "library").select("library", F.col("document").alias("gold_document"), "gold_id", F.pmod(F.col("m") - F.greatest("ka", "kb"), F.col("total")).alias("n"))
    return a.join(turned, ["library", "n"]).select("library", "example_id", "gold_id")


def quota(candidates: DataFrame, total: int, yielded: str = "yielded") -> DataFrame:
    """The leading candidates (place) up to the one with which what they ``yielded`` reaches the total.

    The running sum is taken in two steps, so that no task has all candidates: within ranges of places,
    and over the ranges' sums.
    """
    width = 1 << 16
    block = F.floor((F.col("place") - 1) / width)
    inside = Window.partitionBy("gm_block").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    rows = candidates.withColumn("gm_block", block)
    sums = rows.groupBy("gm_block").agg(F.sum(yielded).alias("gm_sum"))
    before = sums.withColumn("gm_before", F.coalesce(F.sum("gm_sum").over(Window.orderBy("gm_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("gm_sum")
    so_far = F.coalesce(F.sum(yielded).over(inside), F.lit(0))
    return rows.withColumn("gm_so_far", so_far).join(before, "gm_block").where(F.col("gm_so_far") + F.col("gm_before") < total).drop("gm_block", "gm_before", "gm_so_far")


def _golds(gold: Column, verdicts: Column, sources: Column) -> Column:
    """Of each gold text: is a valid quote in it, and which valid quotes name its document and may run over its edge."""
    flat = lambda c: text.collapse(c, text.PY_SPACE)
    bound = lambda x, f: F.transform(F.array(x), f)[0]  # noqa: E731  computed once for all its uses
    valid = F.transform(F.filter(verdicts, lambda v: v["valid"]), lambda v: F.struct(v["name"].alias("name"), flat(text.strip_wrapping(v["quote"], text.PY_SPACE)).alias("quote")))

    def cited(t: Column, own: Column, said: Column) -> Column:
        inside = F.exists(said, lambda v: (F.length(v["quote"]) > 0) & F.contains(t, v["quote"]))
        names = F.transform(F.filter(own, lambda s: s["content"] == t), lambda s: s["name"])
        return F.struct(inside.alias("inside"), t.alias("text"), F.transform(F.filter(said, lambda v: F.array_contains(names, v["name"]) & (F.length(v["quote"]) > 0)), lambda v: v["quote"]).alias("quotes"))

    contents = F.transform(sources, lambda s: F.struct(s["name"].alias("name"), flat(s["content"]).alias("content")))
    each = lambda own, said: F.transform(gold, lambda g: bound(flat(F.coalesce(g["text"], F.lit(""))), lambda t: cited(t, own, said)))
    return bound(contents, lambda own: bound(valid, lambda said: each(own, said)))


@F.pandas_udf(T.BooleanType())  # a type by name would need a session here
def _runs_over_edges(golds: pd.Series) -> pd.Series:
    """For each row: is every gold inside a quote, or shared by one over a long enough run; null rows are settled already."""

    def one(row: Any) -> bool:
        for g in row if row is not None else []:
            if not g["inside"] and not any(repair.longest_run(q, g["text"]).size >= min(len(q), repair.EDGE_RUN) for q in g["quotes"]):
                return False
        return True

    return golds.map(one)


def check(examples: DataFrame, contract: Contract = Contract()) -> DataFrame:
    """The examples with ``reason``: the first check that fails, null for those that pass.

    Checks come in order of cost; of an answer's citations the first bad one names the reason.
    ``covers`` (default true) and ``acknowledges`` (default false) are looked at for partial answers.
    """
    ex = citations.verify(examples.withColumn("gm_target", text.trim(F.coalesce("target", F.lit("")), text.PY_SPACE)), "gm_target")
    names = set(examples.columns)
    opt = lambda c, d: F.coalesce(F.col(c), F.lit(d)) if c in names else F.lit(d)
    bad = F.filter("verdicts", lambda v: ~v["valid"])[0]
    first_bad = F.when(~bad["known"], "unknown_document_name").when(~bad["verbatim"], "quote_not_verbatim").otherwise("quote_too_long")
    length = F.length("gm_target") + (F.col("rendered_chars") if "rendered_chars" in names else F.lit(0))
    if "gold" in names:
        # the Python function reads a plain column; it is kept out of the expressions around it
        ex = ex.withColumn("gm_golds", _golds(F.col("gold"), F.col("verdicts"), F.col("sources")))
        # and gets a null where it isn't needed: all golds cited, nothing that could be, or a check before that fails
        open_ = F.forall("verdicts", lambda v: v["valid"]) & F.exists("gm_golds", lambda g: ~g["inside"]) & F.forall("gm_golds", lambda g: g["inside"] | (F.size(g["quotes"]) > 0))
        ex = ex.withColumn("gm_open", F.when(open_, F.col("gm_golds")))
        settled = F.forall("gm_golds", lambda g: g["inside"])
        ex = ex.withColumn("gm_cited", settled | (F.col("gm_open").isNotNull() & _runs_over_edges.asNondeterministic()("gm_open"))).drop("gm_golds", "gm_open")
    else:
        ex = ex.withColumn("gm_cited", F.lit(True))
    n = F.size("verdicts")
    answer = (
        F.when(n == 0, "no_citation")
        .when(F.exists("verdicts", lambda v: ~v["valid"]), first_bad)
        .when(~F.col("gm_cited"), "gold_not_cited")
        .when((F.col("type") == "partial") & ~opt("covers", True), "partial_covered_part_missing")
        .when((F.col("type") == "partial") & ~opt("acknowledges", False), "partial_uncovered_not_acknowledged")
    )
    ready = F.when(F.col("type") == "multiturn_empty", F.lit(contract.no_sources_reply.strip()[:40])).otherwise(F.lit(contract.abstention()))
    abstention = F.when(n > 0, "abstention_has_citation").when(~F.startswith("gm_target", ready), "abstention_not_canonical")
    reason = (
        F.when(F.length("gm_target") == 0, "empty_target")
        .when(length > MAX_CHARS, "too_long")
        .when(F.col("malformed") > 0, "malformed_citation_line")
        .otherwise(F.when(F.col("answerable"), answer).otherwise(abstention))
    )
    return ex.withColumn("reason", reason).drop("gm_target", "gm_cited")


def filter_stats(checked: DataFrame) -> DataFrame:
    """type, reason and count, with totals by reason (type null); kept examples have the reason ``kept``."""
    return checked.withColumn("reason", F.coalesce("reason", F.lit("kept"))).rollup("reason", "type").agg(F.count("*").alias("n")).where("reason is not null")


def stats_report(checked: DataFrame) -> DataFrame:
    """One row: candidates, kept, kept_rate (null for none), and the counts by reason, by type and by repair as JSON."""
    reasons = checked.where("reason is not null").groupBy("type", "reason").agg(F.count("*").alias("n"))
    as_map = lambda k, v: F.map_from_entries(F.transform(F.sort_array(F.collect_list(F.struct((-F.col(v)).alias("o"), F.col(k).alias("k"), F.col(v).alias("v")))), lambda x: F.struct(x["k"], x["v"])))
    total = checked.agg(F.count("*").alias("candidates"), F.count_if(F.col("reason").isNull()).alias("kept")).withColumn("kept_rate", F.when(F.col("candidates") > 0, F.round(F.col("kept") / F.col("candidates"), 4)))
    by_reason = reasons.groupBy("reason").agg(F.sum("n").alias("n")).agg(F.to_json(as_map("reason", "n")).alias("rejected"))
    by_type = reasons.groupBy("type").agg(as_map("reason", "n").alias("m")).agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("type", F.to_json("m")))))).alias("rejected_by_type"))
    out = total.join(by_reason).join(by_type)
    if "repairs" in checked.columns:
        kinds = checked.select(F.explode("repairs").alias("r")).groupBy(F.col("r.kind").alias("kind")).agg(F.count("*").alias("n")).agg(F.to_json(as_map("kind", "n")).alias("repairs_by_kind"))
        some = F.size("repairs") > 0
        out = out.join(checked.agg(F.count_if(some).alias("repaired"), F.count_if(some & F.col("reason").isNull()).alias("repaired_kept"))).join(kinds)
    return out


class Kept:
    """Questions kept so far, indexed by their rarest tokens.

    Tokens are numbered as they are first seen, so frequent ones mostly have low numbers, and a question's tokens
    are taken from the highest number down.  Two questions that are alike share a token among the first few
    of each (as many as they may lack of each other, and one), and the places of the tokens that they share bound how many
    more these can be.  Those that remain are compared in full.
    """

    def __init__(self, threshold: float):
        self.threshold = threshold
        self.seen: set[str] = set()
        self.numbers: dict[str, int] = {}
        self.tokens, self.starts = array("q"), array("q", [0])  # of kept questions, one after the other
        self.index: dict[int, list[tuple[int, int, int]]] = {}  # token: kept question, its size, the token's place in it

    def add(self, plain: str) -> bool:
        """Keeps a question unless one like it was kept before."""
        if plain in self.seen:
            return False
        words = {self.numbers.setdefault(w, len(self.numbers)) for w in plain.split()}
        order, n, t = sorted(words, reverse=True), len(words), self.threshold
        first = order[: n - ceil(t * n - 1e-9) + 1]  # the margin allows for rounding: more are looked at, not fewer
        share = t / (1 + t)
        shared: dict[int, int] = {}
        for i, w in enumerate(first):
            for k, m, j in self.index.get(w, ()):
                so_far = shared.get(k, 0)
                if so_far >= 0:
                    shared[k] = so_far + 1 if so_far + 1 + min(n - i, m - j) - 1 >= share * (n + m) - 1e-9 else -1
        for k, so_far in shared.items():
            if so_far > 0:
                other = self.tokens[self.starts[k] : self.starts[k + 1]]
                both = sum(map(words.__contains__, other))
                if both >= t * (n + len(other) - both):
                    return False
        self.seen.add(plain)
        for j, w in enumerate(first):
            self.index.setdefault(w, []).append((len(self.starts) - 1, n, j))
        self.tokens.extend(order)
        self.starts.append(len(self.tokens))
        return True


def dedupe(examples: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Drops questions like one kept before, by example order, within (first gold document or library, answerable).

    Each question is compared with kept ones only, so the result depends on the order and buckets
    are folded one by one.  A question meets only those that share a rare enough token (``Kept``).
    """
    first = F.when(F.size("gold") > 0, F.col("gold")[0]["document"]) if "gold" in examples.columns else F.lit(None).cast("string")
    keyed = examples.select("example_id", F.coalesce(first, F.col("library")).alias("bucket"), "answerable", text.plain_question(F.col("question")).alias("plain"))

    kind = examples.schema["example_id"].dataType.simpleString()
    ordered = keyed.repartition("bucket", "answerable").sortWithinPartitions("bucket", "answerable", "example_id")

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # buckets lie sorted in the partition, so only one bucket's index is held at a time
        held, kept = None, Kept(threshold)
        for b in batches:
            out = []
            for i, bucket, answerable, plain in zip(b["example_id"], b["bucket"], b["answerable"], b["plain"]):
                if (bucket, answerable) != held:
                    held, kept = (bucket, answerable), Kept(threshold)
                if kept.add(plain):
                    out.append(i)
            yield pd.DataFrame({"example_id": out})

    survivors = ordered.mapInPandas(stream, f"example_id {kind}")
    return examples.join(survivors, "example_id", "left_semi")


def split_name(library: Column, test: tuple[str, ...] = TEST, validation: tuple[str, ...] = VALIDATION) -> Column:
    return F.when(library.isin(*test), "test").when(library.isin(*validation), "validation").otherwise("train")


def split_report(examples: DataFrame, test: tuple[str, ...] = TEST, validation: tuple[str, ...] = VALIDATION) -> DataFrame:
    """split, count, its libraries, sorted and joined, and counts by type (if there are types) as ``type=n``, joined."""
    s = examples.withColumn("split", split_name(F.col("library"), test, validation))
    out = s.groupBy("split").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("library")), ",").alias("libraries"))
    if "type" not in examples.columns:
        return out
    types = s.groupBy("split", "type").agg(F.count("*").alias("k"))
    shown = F.transform(F.sort_array(F.collect_list(F.struct("type", "k"))), lambda x: F.concat_ws("=", x["type"], x["k"].cast("string")))
    return out.join(types.groupBy("split").agg(F.array_join(shown, ",").alias("by_type")), "split")


def kept_counts(kept: DataFrame, *by: str) -> DataFrame:
    """Counts of kept examples by type, library or the like (field, value, n), most first, then by value."""
    rows = kept.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in by])).alias("x"))
    return rows.groupBy("x.field", "x.value").agg(F.count("*").alias("n")).orderBy("field", F.desc("n"), "value")


def leaks(documents: DataFrame) -> DataFrame:
    """Documents that stand in more than one split; documents: document and split."""
    return documents.groupBy("document").agg(F.count_distinct("split").alias("splits")).where("splits > 1")


def example_id(kind: Column, library: Column, document: Column, index: Column, seq: Column) -> Column:
    return F.concat_ws("-", kind, library, F.substring(document, 1, 24), index.cast("string"), seq.cast("string"))
