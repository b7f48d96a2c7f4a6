"""Citations in replies: found, parsed and verified against the sources that the reply was given."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions import text

MAX_QUOTE = 200


def marked_lines(reply: Column) -> Column:
    """The lines of a reply that look like quoted blocks, without white space at their ends."""
    lines = F.transform(F.split(reply, "\n", -1), text.trim_end)
    return F.filter(lines, text.quote_like)


def scan(reply: Column) -> Column:
    """Struct of citations (name, quote) and malformed lines, both in order."""
    found = marked_lines(F.coalesce(reply, F.lit("")))
    return F.struct(F.array_compact(F.transform(found, text.citation)).alias("citations"), F.filter(found, lambda x: text.citation(x).isNull()).alias("malformed"))


def verdict(cited: Column, sources: Column, max_quote: int = MAX_QUOTE, space: str = text.WEB_SPACE) -> Column:
    """What holds of one citation; sources: array of structs with name and collapsed content.

    A quote is looked for in the contents of the sources with the cited name, once
    as it is and once without wrapping marks; empty quotes are nowhere.
    """
    own = F.transform(F.filter(sources, lambda s: s["name"] == cited["name"]), lambda s: s["content"])
    strict = text.collapse(cited["quote"], space)
    quote = text.collapse(text.strip_wrapping(cited["quote"], space), space)
    inside = lambda q: (F.length(q) > 0) & F.exists(own, lambda t: F.contains(t, q))
    known, verbatim, within = F.size(own) > 0, inside(quote), F.length(quote) <= max_quote
    return F.struct(
        cited["name"].alias("name"),
        cited["quote"].alias("quote"),
        known.alias("known"),
        verbatim.alias("verbatim"),
        inside(strict).alias("verbatim_strict"),
        within.alias("within_length"),
        (known & verbatim & within).alias("valid"),
    )


def verify(replies: DataFrame, reply: str = "reply", sources: str = "sources") -> DataFrame:
    """The replies with verdicts (array of structs) and the number of malformed lines."""
    # sources are collapsed once for all citations of a reply, and not at all for replies without any
    flat = F.transform(sources, lambda s: F.struct(s["name"].alias("name"), text.collapse(s["content"]).alias("content")))
    found = replies.withColumn("gm_scan", scan(F.col(reply))).withColumn("gm_sources", F.array(F.when(F.size("gm_scan.citations") > 0, flat)))
    verdicts = F.transform("gm_sources", lambda own: F.transform("gm_scan.citations", lambda c: verdict(c, own)))[0]
    out = found.withColumn("verdicts", verdicts)
    return out.withColumn("malformed", F.size("gm_scan.malformed")).drop("gm_scan", "gm_sources")


def rows(verified: DataFrame, *keep: str) -> DataFrame:
    """One row for each citation, with its position."""
    return verified.select(*keep, F.posexplode("verdicts").alias("position", "v")).select(*keep, "position", "v.*")
