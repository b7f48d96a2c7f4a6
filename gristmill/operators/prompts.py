"""Prompts: numbered sources, the question, and the messages around them."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from gristmill.functions import text


# Fixed value: what stands for the sources if there are none.
NO_SOURCES = "Sources: (none — the user has no documents that match this question)"


@dataclass(frozen=True)
class Contract:
    """What prompts and citations have to agree on; ``load`` reads one from a file and checks its digest."""

    system_prompt: str = "Answer from the given sources only, and quote them."
    no_sources_reply: str = "None of your documents say anything about this. Add one that does, or ask something else."
    max_quote: int = 200
    top_k: int = 5
    chunk_size: int = 1000
    chunk_overlap: int = 200
    temperature: float = 0.2
    max_output_tokens: int = 1024
    raw: dict = field(default_factory=dict)

    VERSION = 1

    @staticmethod
    def digest(raw: dict) -> str:
        body = {k: v for k, v in raw.items() if k != "sha256"}
        return hashlib.sha256(json.dumps(body, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()

    @classmethod
    def load(cls, path: str) -> Contract:
        with open(path, encoding="utf-8") as f:
            raw = json.load(f)
        if raw.get("contractVersion") != cls.VERSION:
            raise ValueError(f"contract version {raw.get('contractVersion')}; this reads version {cls.VERSION}")
        if cls.digest(raw) != raw.get("sha256"):
            raise ValueError("the contract's body doesn't have the digest that it states")
        return cls(raw["systemPrompt"], raw["noSourcesReply"], raw["citation"]["maxQuoteChars"], raw["retrieval"]["topK"], raw["chunking"]["chunkSize"], raw["chunking"]["chunkOverlap"], raw["generation"]["temperature"], raw["generation"]["maxOutputTokens"], raw)

    def dump(self, path: str) -> str:
        """Writes the contract with its digest, which is returned."""
        body = {k: v for k, v in self.raw.items() if k != "sha256"} or {
            "contractVersion": self.VERSION, "systemPrompt": self.system_prompt, "noSourcesReply": self.no_sources_reply, "citation": {"maxQuoteChars": self.max_quote},
            "chunking": {"chunkSize": self.chunk_size, "chunkOverlap": self.chunk_overlap}, "retrieval": {"topK": self.top_k}, "generation": {"temperature": self.temperature, "maxOutputTokens": self.max_output_tokens},
        }
        sha = self.digest(body)
        with open(path, "w", encoding="utf-8") as f:
            f.write(json.dumps(body | {"sha256": sha}, indent=2, ensure_ascii=False) + "\n")
        return sha

    def abstention(self) -> str:
        """The first sentence of the reply without sources."""
        import re

        m = re.match(r"(.+?[.!?])(\s|$)", self.no_sources_reply)
        return m[1] if m else self.no_sources_reply


def numbered(sources: Column, normalized: bool = False) -> Column:
    """The sources (array of structs with name and content), each under its number and name."""
    content = (lambda s: s["content"]) if normalized else (lambda s: text.collapse(s["content"]))
    blocks = F.transform(sources, lambda s, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), s["name"], F.lit("\n"), content(s)))
    return F.array_join(blocks, "\n\n---\n\n")


def prompt(question: Column, sources: Column, normalized: bool = False) -> Column:
    """The last user turn: the sources, or that there are none, and the question."""
    none = F.concat(F.lit(NO_SOURCES), F.lit("\n\nQuestion: "), question, F.lit("\n\nAnswer:"))
    some = F.concat(F.lit("Sources:\n\n"), numbered(sources, normalized), F.lit("\n\nQuestion: "), question, F.lit("\n\nAnswer:"))
    return F.when(F.size(F.coalesce(sources, F.array().cast("array<struct<name:string,content:string>>"))) == 0, none).otherwise(some)


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def messages(contract: Contract, question: Column, sources: Column, history: Column | None = None) -> Column:
    """System prompt, earlier turns as they were, and the rendered prompt."""
    parts = [F.array(message("system", F.lit(contract.system_prompt)))] + ([history] if history is not None else []) + [F.array(message("user", prompt(question, sources)))]
    return F.concat(*parts)


def rendered_length(all_messages: Column, target: Column) -> Column:
    return F.aggregate(all_messages, F.lit(0), lambda n, m: n + F.length(m["content"])) + F.length(F.coalesce(target, F.lit("")))


def replace_last_turn(turns: Column, rendered: Column) -> Column:
    """The last user turn of an array of (role, content) replaced."""
    last = F.size(turns) - F.array_position(F.transform(F.reverse(turns), lambda m: m["role"]), "user")
    return F.transform(turns, lambda m, i: F.when(i == last, F.struct(m["role"].alias("role"), rendered.alias("content"))).otherwise(F.struct(m["role"].alias("role"), m["content"].alias("content"))))


def short_circuit(sources: Column, n_messages: Column, contract: Contract) -> Column:
    """The ready reply where a first message meets no sources; null where a model has to answer."""
    return F.when((F.size(sources) == 0) & (n_messages == 1), F.lit(contract.no_sources_reply))
