"""Quality of a corpus: statistics of documents, verdicts, rollups, file checks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.functions import text

#: White space of either browsers' scripts or Python, but not both.
_EITHER = re.compile("[\x1c-\x1f\x85\ufeff]")
_WEB_SPACE = re.compile("[\t\n\x0b\f\r \xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]+")
_NOT_LETTERS = re.compile(r"[\W\d_]+")


def _facts(chunks: DataFrame) -> DataFrame:
    """Counts of each chunk beside its other columns: chars, letters, lines that aren't blank, short ones among them, chars once collapsed, lost characters."""
    names = ("chars", "letters", "lines", "short", "flat", "bad")
    schema = T.StructType([*(chunks.schema[c] for c in chunks.columns if c != "text"), *(T.StructField(n, T.IntegerType()) for n in names)])

    def counts(t: str | None) -> tuple[int | None, ...]:
        if t is None:
            return (None,) * len(names)
        # splitlines and strip know the line breaks and the white space of Python
        lines = [n for n in (len(x.strip()) for x in t.splitlines()) if n]
        flat = _WEB_SPACE.sub(" ", t).strip(" ") if _EITHER.search(t) else " ".join(t.split())
        letters = sum(len(w) if w.isalpha() else sum(map(str.isalpha, w)) for w in _NOT_LETTERS.split(t))
        return len(t), letters, len(lines), sum(n < 25 for n in lines), len(flat), t.count("\ufffd")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in filter(len, batches):
            found = zip(*(counts(t.as_py()) for t in batch.column(batch.num_columns - 1)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(f, pa.int32()) for f in found)], names=schema.names)

    return chunks.select(*[c for c in chunks.columns if c != "text"], "text").mapInArrow(run, schema)


def statistics(chunks: DataFrame, *by: str) -> DataFrame:
    """Per document: chunks, chars, alpha_ratio, short_line_ratio, mean_chunk_chars, replacement_chars; chunks: chunk_index, text.

    The document's text is its chunks joined by newlines, so counts are taken chunk by chunk
    and added up; no text is put together.  Line breaks inside a chunk and between chunks are
    all that separates lines.
    """
    facts = _facts(chunks.select(*by, "text"))
    n = F.count("*")
    chars = F.sum("chars") + n - 1
    return facts.groupBy(*by).agg(
        n.alias("chunks"),
        chars.alias("chars"),
        F.round(F.sum("letters") / F.greatest(chars, F.lit(1)), 3).alias("alpha_ratio"),
        F.round(F.sum("short") / F.greatest(F.sum("lines"), F.lit(1)), 3).alias("short_line_ratio"),
        F.bround(F.avg("flat"), 0).cast("long").alias("mean_chunk_chars"),
        F.sum("bad").alias("replacement_chars"),
    )


def verdict() -> Column:
    """Flags of a row of statistics, or ok."""
    flags = F.array_compact(
        F.array(
            F.when(F.col("alpha_ratio") < 0.55, "low-alpha"),
            F.when(F.col("short_line_ratio") > 0.45, "short-lines"),
            F.when(F.col("chunks") < 3, "too-small"),
            F.when(F.col("replacement_chars") > 0, "encoding"),
        )
    )
    return F.when(F.size(flags) == 0, "ok").otherwise(F.array_join(flags, ","))


def rollup(stats: DataFrame, by: str = "library") -> DataFrame:
    """Documents, chunks, passing documents, PDFs and their share in percent of each library, and of all (null)."""
    n = F.count("*")
    pdf = F.count_if(F.endswith("document", F.lit(".pdf")))
    return stats.rollup(by).agg(n.alias("documents"), F.sum("chunks").alias("chunks"), F.count_if(F.col("verdict") == "ok").alias("ok"), pdf.alias("pdf"), F.floor(pdf * 100 / F.greatest(n, F.lit(1))).alias("pdf_percent"))


def report_lines(stats: DataFrame) -> DataFrame:
    """A corpus report in markdown, a line a row, in order of section, place and line: totals, libraries, documents, what is flagged."""
    r = rollup(stats)
    head = lambda n, *x: stats.sparkSession.createDataFrame([(n, "", line) for line in x], "section int, place string, line string")
    row = lambda n, place, form, *c: (F.lit(n).alias("section"), place.alias("place"), F.format_string(form, *c).alias("line"))
    total = r.where("library is null").select(*row(1, F.lit(""), "Documents: **%d** (%d PDFs, %d%%), chunks: **%d**, passing all heuristics: **%d**", "documents", "pdf", "pdf_percent", "chunks", "ok"))
    libraries = r.where("library is not null").select(*row(3, F.col("library"), "| %s | %d | %d | %d | %d |", "library", "documents", "ok", "pdf", "chunks"))
    each = stats.select(*row(5, F.col("document"), "| %s | %s | %d | %d | %s | %s | %d | %s |", "document", "library", "chunks", "chars", F.col("alpha_ratio").cast("string"), F.col("short_line_ratio").cast("string"), "mean_chunk_chars", "verdict"))
    flagged = stats.where("verdict <> 'ok'").select(*row(7, F.col("document"), "- `%s` (%s): %s", "document", "library", "verdict"))
    parts = [
        head(0, "# Corpus quality report", ""),
        total,
        head(2, "", "## Per library", "", "| library | docs | ok | PDFs | chunks |", "|---|---|---|---|---|"),
        libraries,
        head(4, "", "## Per document", "", "| document | library | chunks | chars | alpha | short lines | mean chunk | verdict |", "|---|---|---|---|---|---|---|---|"),
        each,
        head(6, "", "## Flagged", ""),
        flagged,
    ]
    out = parts[0].withColumn("n", F.monotonically_increasing_id())
    for p in parts[1:]:
        out = out.unionByName(p.withColumn("n", F.monotonically_increasing_id()))
    return out.orderBy("section", "place", "n").select("section", "place", "line")


def with_manifest(stats: DataFrame, manifest: DataFrame) -> DataFrame:
    """Statistics with library and title of the file they come from; ? and the name where it isn't listed."""
    m = manifest.select(F.col("filename").alias("gm_file"), F.col("library").alias("gm_library"), F.col("title").alias("gm_title"))
    out = stats.withColumn("gm_file", text.whole_file(F.col("document"))).join(m, "gm_file", "left")
    return out.withColumn("library", F.coalesce("gm_library", F.lit("?"))).withColumn("title", F.coalesce("gm_title", "document")).drop("gm_file", "gm_library", "gm_title")


def strict_manifest(chunks: DataFrame, manifest: DataFrame) -> DataFrame:
    """Chunks with their file's library and title; a file that isn't listed is an error."""
    out = with_manifest(chunks, manifest)
    return out.withColumn("library", F.when(F.col("library") == "?", F.raise_error(F.concat(F.lit("not in the manifest: "), F.col("document")))).otherwise(F.col("library")))


def file_problem(content: Column, kind: Column) -> Column:
    """Why a fetched file is no good; null if it is."""
    head = F.decode(F.substring(content, 1, 20000), "ISO-8859-1")
    printable = F.length(F.regexp_replace(head, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")) / F.greatest(F.length(head), F.lit(1))
    start = F.decode(F.substring(content, 1, 2000), "ISO-8859-1")
    return (
        F.when(F.octet_length(content) < 2000, "too small")
        .when((kind == "pdf") & ~F.startswith(start, F.lit("%PDF")), "not a PDF")
        .when((kind != "pdf") & (printable <= 0.97), "not clean text")
        .when((kind != "pdf") & F.rlike(start, F.lit(r"(?i)<!doctype html|<html")), "an HTML page")
    )


def fetch_report(files: DataFrame) -> DataFrame:
    """path, bytes, sha256 and status of files (path, content, kind)."""
    return files.select("path", F.octet_length("content").alias("bytes"), F.sha2("content", 256).alias("sha256"), F.coalesce(file_problem(F.col("content"), F.col("kind")), F.lit("ok")).alias("status"))


def fetch_summary(report: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files that are there by library (null: all), how many of them are PDFs, their size in MiB, and how many failed; report: path and so on, manifest: filename, library."""
    name = F.element_at(F.split("path", "/"), -1)
    rows = report.withColumn("filename", name).join(manifest.select("filename", "library"), "filename")
    ok = F.col("status") == "ok"
    return rows.rollup("library").agg(
        F.count_if(ok).alias("documents"),
        F.count_if(ok & F.endswith("filename", F.lit(".pdf"))).alias("pdf"),
        F.round(F.coalesce(F.sum(F.when(ok, F.col("bytes"))), F.lit(0)) / (1 << 20), 3).alias("mb"),
        F.count_if(~ok).alias("failures"),
    )


def document_text(chunks: DataFrame) -> DataFrame:
    """document and its chunks' collapsed texts in order, joined by blanks; chunks: document, chunk_index, text."""
    parts = F.sort_array(F.collect_list(F.struct("chunk_index", text.collapse(F.col("text")).alias("t"))))
    return chunks.groupBy("document").agg(F.array_join(F.transform(parts, lambda p: p["t"]), " ").alias("text"))


def split_into(content: Column, parts: int) -> Column:
    """A text in parts of like size: at blank lines, else at lines, else at fixed steps."""
    whole = F.regexp_replace(content, r"\r\n?", "\n")
    target = F.length(whole) / parts

    def packed(glue: str) -> Column:
        start = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("now"), F.lit(0).alias("size"))

        def step(s: Column, unit: Column) -> Column:
            now, size = F.concat(s["now"], F.array(unit)), s["size"] + F.length(unit) + len(glue)
            full = (size >= target) & (F.size(s["done"]) < parts - 1)
            return F.struct(
                F.when(full, F.concat(s["done"], F.array(F.array_join(now, glue)))).otherwise(s["done"]).alias("done"),
                F.when(full, F.array().cast("array<string>")).otherwise(now).alias("now"),
                F.when(full, 0).otherwise(size).alias("size"),
            )

        return F.aggregate(F.split(whole, glue, -1), start, step, lambda s: F.when(F.size(s["now"]) > 0, F.concat(s["done"], F.array(F.array_join(s["now"], glue)))).otherwise(s["done"]))

    width = F.ceil(target).cast("int")
    fixed = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: F.substr(whole, i * width + 1, width))
    return F.when(F.size(packed("\n\n")) == parts, packed("\n\n")).when(F.size(packed("\n")) == parts, packed("\n")).otherwise(F.filter(fixed, lambda p: F.length(p) > 0))
