"""What stands in for services: embedders, generators and the settings that choose them."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.functions import text

Embedder = Callable[[list[str]], list[list[float]]]
Generator = Callable[[list[str]], list[str]]


@dataclass(frozen=True)
class Settings:
    """Provider, model and budgets; ``from_env`` reads them and refuses unknown providers."""

    provider: str = "extractive"
    model: str = "first-sentence"
    history_chars: int = 64_000
    options: dict = field(default_factory=dict)
    PROVIDERS = ("extractive", "openai", "compatible")

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None) -> Settings:
        env = dict(os.environ) if env is None else env
        provider = env.get("CHAT_PROVIDER") or cls.provider
        if provider not in cls.PROVIDERS:
            raise ValueError(f"no such provider: {provider}")
        if provider == "compatible" and not env.get("CHAT_BASE_URL"):
            raise ValueError("a compatible provider needs CHAT_BASE_URL")
        wanted = env.get("CHAT_HISTORY_CHARS", "")
        chars = min(int(wanted), 64_000) if wanted.isdigit() and int(wanted) > 0 else 64_000
        return cls(provider, env.get("CHAT_MODEL") or cls.model, chars)


def embed(rows: DataFrame, embedder: Embedder, column: str = "text", batch: int = 100) -> DataFrame:
    """The rows with ``embedding``, in batches whose order is kept; a worker's partitions are what runs at once."""
    schema = T.StructType([*rows.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            vectors: list = []
            for i in range(0, len(f), batch):
                vectors += embedder(f[column].iloc[i : i + batch].tolist())
            yield f.assign(embedding=vectors)

    return rows.mapInPandas(run, schema)


def generate(prompts: DataFrame, generator: Generator, column: str = "prompt") -> DataFrame:
    """The rows with ``reply`` and ``error``: a call that fails leaves an error, not a failed job."""
    schema = T.StructType([*prompts.schema.fields, T.StructField("reply", T.StringType()), T.StructField("error", T.StringType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            replies: list = []
            errors: list = []
            for p in f[column]:
                try:
                    replies.append(generator([p])[0])
                    errors.append(None)
                except Exception as e:  # noqa: BLE001  any failure of the service belongs in the row
                    replies.append(None)
                    errors.append(f"{type(e).__name__}: {e}"[:500])
            yield f.assign(reply=replies, error=errors)

    return prompts.mapInPandas(run, schema)


def extractive_answer(name: Column, passage: Column, size: int = 150) -> Column:
    """A ready answer that quotes the passage's beginning, cut at a word."""
    flat = text.collapse(passage)
    head = F.when(F.length(flat) <= size, flat).otherwise(F.regexp_replace(F.substring(flat, 1, size + 1), r"\s\S*\z", ""))
    return F.concat(F.lit("The document says so.\n> **"), name, F.lit("** — "), head)


def template_question(terms: Column) -> Column:
    return F.concat(F.lit("What does the document say about "), F.array_join(terms, " and "), F.lit("?"))


def is_answerable(span: Column, passages: Column) -> Column:
    """Whether the flattened span stands in any of the passages."""
    s = text.collapse(span, text.PY_SPACE)
    return (F.length(s) > 0) & F.exists(passages, lambda p: F.contains(text.collapse(p, text.PY_SPACE), s))


def describe_sources(names: Column) -> Column:
    return F.concat(F.lit("The sources cover "), F.array_join(F.array_distinct(names), ", "), F.lit("."))


class Extractive:
    """A teacher in expressions alone: it asks about the words that a stretch of a passage begins with, and answers with that stretch."""

    STEP, ASKED, QUOTED = 100, 30, 60

    def _span(self, passage: Column, i: int | Column = 0) -> Column:
        return F.btrim(F.substr(passage, F.lit(1) + F.lit(i) * self.STEP if isinstance(i, int) else i * self.STEP + 1, F.lit(self.QUOTED)), F.lit(" "))

    def _topic(self, passage: Column, i: int | Column = 0) -> Column:
        return F.substr(passage, F.lit(1) + F.lit(i) * self.STEP if isinstance(i, int) else i * self.STEP + 1, F.lit(self.ASKED))

    def questions(self, passage: Column, n: int) -> Column:
        one = lambda i: F.struct(F.concat(F.lit("What about "), self._topic(passage, i), F.lit("?")).alias("question"), self._span(passage, i).alias("answer_span"))
        return F.filter(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), one), lambda q: F.length(q["answer_span"]) > 0)

    def two_passage_question(self, a: Column, b: Column) -> Column:
        asked = F.concat(F.lit("What about "), self._topic(a), F.lit(", and "), self._topic(b), F.lit("?"))
        return F.struct(asked.alias("question"), self._span(a).alias("answer_span_a"), self._span(b).alias("answer_span_b"))

    def answer(self, question: Column, sources: Column, names: Column, spans: Column) -> Column:
        lines = F.zip_with(names, spans, lambda n, s: F.concat(F.lit("> **"), n, F.lit("** — "), s))
        return F.concat(F.lit("The document says so.\n"), F.array_join(lines, "\n"))

    def is_answerable(self, question: Column, span: Column, sources: Column) -> Column:
        return is_answerable(span, F.transform(sources, lambda s: s["content"]))

    def describe_sources(self, sources: Column) -> Column:
        return describe_sources(F.transform(sources, lambda s: s["name"]))

    def partial_check(self, question: Column, reply: Column) -> Column:
        """What a reply to a question in two parts does: it cites, so one part is covered; and it says what isn't there, or doesn't."""
        return F.struct(F.rlike(reply, F.lit(r"(?m)^> \*\*.+\*\* — ")).alias("covers"), F.rlike(reply, F.lit(r"(?i)\bnot (?:say|said|cover|covered|mention|mentioned)\b")).alias("acknowledges"))
