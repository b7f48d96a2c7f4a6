"""Text functions as Column expressions.

Two notions of white space are kept apart: that of browsers' scripts (``WEB_SPACE``) and that
of Python's ``str.split`` (``PY_SPACE``).  Lengths count code points.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_COMMON = r"\t\n\x0b\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
WEB_SPACE = f"[{_COMMON}\\x{{FEFF}}]"
PY_SPACE = f"[{_COMMON}\\x{{85}}\\x{{1C}}-\\x{{1F}}]"

# Marks that may wrap a quote, opening and closing.
WRAPPERS = [('"', '"'), ("“", "”"), ("‘", "’"), ("'", "'"), ("«", "»"), ("„", "“")]
# Quotation marks and dashes that count as one when texts are compared loosely.
MARKS = "\"“”«»„‘’‚`´"
DASHES = "‐‑‒–—―"
_ANY = r"[^\n\r\x{2028}\x{2029}]+"
CITATION = rf"^> \*\*({_ANY}?)\*\* — ({_ANY})\z"
# Words that lexical ranking leaves out, in alphabetical order.
STOP_WORDS = [
    "a", "about", "also", "an", "and", "any", "are", "as", "at", "be", "been", "between", "by", "can", "could", "did", "do", "does", "for", "from",
    "he", "her", "his", "how", "i", "if", "in", "into", "is", "it", "its", "may", "me", "might", "my", "no", "not", "of", "on", "or", "our", "over",
    "she", "should", "than", "that", "the", "their", "them", "then", "there", "these", "they", "this", "those", "to", "under", "was", "we", "were",
    "what", "when", "where", "which", "who", "whom", "why", "will", "with", "would", "you", "your",
]


def collapse(c: Column, space: str = WEB_SPACE) -> Column:
    """Runs of white space become one blank; none at the ends.

    Single blanks stay as they are, and characters of plain text are told apart before the class of white space is asked.
    """
    return F.btrim(F.regexp_replace(c, f" (?![!-~]){space}+|[^ -~](?<={space}){space}*", " "), F.lit(" "))


def trim_start(c: Column, space: str = WEB_SPACE) -> Column:
    return F.regexp_replace(c, f"^{space}+", "")


def trim_end(c: Column, space: str = WEB_SPACE) -> Column:
    return F.regexp_replace(c, f"{space}+\\z", "")


def trim(c: Column, space: str = WEB_SPACE) -> Column:
    return trim_end(trim_start(c, space), space)


def blank(c: Column, space: str = WEB_SPACE) -> Column:
    return F.length(trim(F.coalesce(c, F.lit("")), space)) == 0


def folded(c: Column) -> Column:
    """For comparing in evaluations: collapsed and in lower case."""
    return F.lower(collapse(c))


def contains_any(text: Column, expected: Column) -> Column:
    """Whether the folded text holds any of the folded, non-empty strings of an array."""
    return F.exists(expected, lambda s: F.contains(folded(text), folded(s)))


def or_query(c: Column) -> Column:
    """Terms of a question joined by `` | ``; repeated terms stay."""
    plain = F.regexp_replace(F.lower(c), r"[^a-z0-9+\-\t\n\x0b\f\r ]", " ")
    terms = F.filter(F.split(plain, r"[\t\n\x0b\f\r ]+"), lambda t: F.length(t) > 1)
    bare = F.transform(terms, lambda t: F.regexp_replace(F.regexp_replace(t, r"^-+", ""), r"\++\z", ""))
    return F.array_join(F.filter(bare, lambda t: F.length(t) > 1), " | ")


def tokens(c: Column, stop_words: list[str] | None = None) -> Column:
    """Lexical tokens: letters and digits with an optional apostrophe part, of two characters or more, no stop words."""
    stop = F.array(*[F.lit(w) for w in (STOP_WORDS if stop_words is None else stop_words)])
    return F.filter(F.regexp_extract_all(F.lower(c), F.lit(r"[a-z0-9]+(?:'[a-z]+)?"), 0), lambda t: (F.length(t) > 1) & ~F.array_contains(stop, t))


def strip_wrapping(c: Column, space: str = WEB_SPACE) -> Column:
    """The trimmed quote without one pair of wrapping marks."""
    q = trim(c, space)
    cases = reduce(
        lambda rest, pair: F.when(F.startswith(q, F.lit(pair[0])) & F.endswith(q, F.lit(pair[1])), trim(F.substr(q, F.lit(2), F.length(q) - 2), space)).otherwise(rest),
        reversed(WRAPPERS),
        q,
    )
    return F.when(F.length(q) < 3, q).otherwise(cases)


def citation(line: Column) -> Column:
    """Struct of name and quote of a line in the citation format, else null."""
    line = trim_end(line)
    name = F.regexp_extract(line, CITATION, 1)
    return F.when(F.length(name) > 0, F.struct(name.alias("name"), F.regexp_extract(line, CITATION, 2).alias("quote")))


def quote_like(line: Column) -> Column:
    """Whether a line begins, after white space, with the mark of a quoted block."""
    return F.startswith(trim_start(line), F.lit(">"))


def title(c: Column, limit: int = 60) -> Column:
    """One line of at most ``limit`` characters, cut with an ellipsis."""
    line = collapse(c)
    return F.when(F.length(line) > limit, F.concat(trim_end(F.substring(line, 1, limit - 1)), F.lit("…"))).otherwise(line)


def role(c: Column) -> Column:
    """One of user, assistant and system; anything else is assistant."""
    return F.when(c.isin("user", "system"), c).otherwise(F.lit("assistant"))


def preview(c: Column, size: int = 120) -> Column:
    return F.substring(collapse(c), 1, size)


def plain_question(c: Column) -> Column:
    """A question as its lower-case words and numbers, blank-separated."""
    return F.array_join(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), 0), " ")


def bare_name(c: Column) -> Column:
    """Letters and digits of a name in folded case."""
    return F.regexp_replace(F.replace(F.lower(c), F.lit("ß"), F.lit("ss")), r"[^\p{L}\p{N}]", "")


def hint_words(c: Column) -> Column:
    """Distinct runs of three or more letters and digits, in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]{3,}"), 0))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two arrays as sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


PART = r"^(.*)-part(\d+)of(\d+)(\.[^.]+)\z"


def whole_file(name: Column) -> Column:
    """The file that a part was split from; the name itself if it is no part."""
    return F.regexp_replace(name, PART, "$1$4")


def display_name(name: Column, doc_title: Column, style: Column) -> Column:
    """The file's name, or its title, with the part's number if it is one."""
    part, of = F.regexp_extract(name, PART, 2), F.regexp_extract(name, PART, 3)
    titled = F.when(F.length(part) > 0, F.concat(doc_title, F.lit(" (part "), part, F.lit(" of "), of, F.lit(")"))).otherwise(doc_title)
    return F.when(style == "title", titled).otherwise(name)


def letter_share(c: Column) -> Column:
    """Share of letters among all characters; 0 for the empty text."""
    return F.when(F.length(c) == 0, 0.0).otherwise(F.length(F.regexp_replace(c, r"[^\p{L}]", "")) / F.length(c))


def line_kind(line: Column) -> Column:
    """What a line of a reply is shown as."""
    return F.when(F.startswith(line, F.lit("> ")), "citation").when(F.startswith(line, F.lit("- ")), "bullet").when(blank(line), "blank").otherwise("paragraph")


def bold_parts(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"\*\*[^*]+\*\*"), 0)


def loose(c: Column) -> Column:
    """Lower case with quotation marks and dashes unified, a character for a character."""
    same = F.translate(c, MARKS + DASHES, "'" * len(MARKS) + "-" * len(DASHES))
    return F.when(F.length(F.lower(same)) == F.length(same), F.lower(same)).otherwise(same)


def find_loose(text: Column, quote: Column) -> Column:
    """The stretch of text that equals the quote up to case, marks and dashes; null if there is none."""
    at = F.call_function("locate", loose(quote), loose(text))
    return F.when((at > 0) & (F.length(quote) > 0), F.substr(text, at, F.length(quote)))


def unit_choice(*parts: Column) -> Column:
    """A number in [0, 1) that the parts decide, the same on every run."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def name_style(*parts: Column, title_share: float = 0.3) -> Column:
    return F.when(unit_choice(F.lit("style"), *parts) < title_share, "title").otherwise("filename")


def context_size(*parts: Column, k: int = 5, short_share: float = 0.1) -> Column:
    """k, or for a tenth of the cases one of 1 to k - 1."""
    short = F.lit(1) + F.floor(unit_choice(F.lit("size"), *parts) * max(1, k - 1)).cast("int")
    return F.when(unit_choice(F.lit("short"), *parts) < short_share, short).otherwise(F.lit(k))


def compose_questions(first: Column, second: Column) -> Column:
    return F.concat(first, F.lit(" Also, "), F.lower(F.substring(second, 1, 1)), F.substr(second, F.lit(2)))


def request_key(model: Column, messages: Column) -> Column:
    """A request's key in the reply cache."""
    return F.sha2(F.concat_ws("\n", model, F.to_json(messages)), 256)


def iso(ts: Column) -> Column:
    """A moment in UTC to the millisecond, as scripts write it."""
    return F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def extension_type(name: Column) -> Column:
    """A file's media type by its name."""
    n = F.lower(name)
    return F.when(n.endswith(".pdf"), "application/pdf").when(n.endswith(".md") | n.endswith(".markdown"), "text/markdown").when(n.endswith(".txt"), "text/plain").otherwise("application/octet-stream")


SUPPORTED_TYPES = ("application/pdf", "text/markdown", "text/plain")
