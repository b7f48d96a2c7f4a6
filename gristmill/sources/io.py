"""Sources and sinks: files, JSON lines with declared schemas, exports, reports."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gristmill.functions import chunking, text
from gristmill.operators import limits

CHUNKS = "documentName string, chunkIndex int, chunkCount int, content string, normalized string"
MANIFEST = "documents array<struct<id: string, library: string, title: string, filename: string, license: string, kind: string, url: string, split_parts: int>>"
QUESTIONS = "id string, question string, category string, expectedSubstrings array<string>"
_VERDICT = "struct<documentName: string, quote: string, knownDocument: boolean, verbatim: boolean, verbatimStrict: boolean, withinLength: boolean, valid: boolean>"
GENERATIONS = f"id string, category string, question string, provider string, modelId string, output string, ttftMs int, latencyMs int, citations array<{_VERDICT}>, malformedCitationLines array<string>, error string"
EXAMPLES = "id string, type string, library string, question string, sources array<struct<documentName: string, content: string, normalized: string>>, history array<struct<role: string, content: string>>, gold array<struct<document: string, index: int, normalized: string>>, target string"


def files(spark: SparkSession, path: str, empty: bool = False, in_order: bool = False) -> DataFrame:
    """path, name, media_type and content of all files below a folder, sorted by path if asked for.

    Spark's reader passes over files without a byte.  With ``empty`` the driver lists the folder
    itself and gives them rows too.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    if empty:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        found, left = at.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(at, True), []
        while found.hasNext():
            f = found.next()
            if f.getLen() == 0 and f.getPath().getName()[0] not in "._":
                left.append((f.getPath().toString(), bytearray()))
        raw = raw.unionByName(spark.createDataFrame(left, "path string, content binary"))
    name = F.element_at(F.split("path", "/"), -1)
    found = raw.select("path", name.alias("name"), text.extension_type(name).alias("media_type"), "content")
    return found.orderBy("path") if in_order else found


def extract(found: DataFrame, pdf: object = None) -> DataFrame:
    """The files with ``text``: UTF-8 for text and markdown, ``pdf`` (bytes to str) for PDFs; null where there is no extractor."""
    plain = F.when(F.col("media_type").isin("text/plain", "text/markdown"), F.decode("content", "UTF-8"))
    if pdf is None:
        return found.withColumn("text", plain)
    read = F.pandas_udf(lambda s: s.map(lambda b: None if b is None else pdf(bytes(b))), "string")
    return found.withColumn("text", F.coalesce(plain, read(F.when(F.col("media_type") == "application/pdf", F.col("content")))))


def export_chunks(extracted: DataFrame, size: int = chunking.SIZE, overlap: int = chunking.OVERLAP) -> tuple[DataFrame, DataFrame]:
    """Chunk rows of the accepted files, and each other file with the reason why it was left out.

    Of files with one name the first by path counts, among those that are good so far.
    """
    n_bytes = F.octet_length("content")
    early = (
        F.when(~F.col("media_type").isin(*text.SUPPORTED_TYPES), "unsupported_type")
        .when(n_bytes == 0, "empty")
        .when(n_bytes > limits.MAX_BYTES, "too_large")
    )
    named = extracted.withColumn("name", F.substring("name", 1, limits.MAX_NAME)).withColumn("gm_early", early)
    w = Window.partitionBy("name", F.col("gm_early").isNull()).orderBy("path")
    named = named.withColumn("gm_nth", F.row_number().over(w)).withColumn("gm_chunks", chunking.chunks(F.col("text"), size, overlap))
    reason = (
        F.when(F.col("gm_early").isNotNull(), F.col("gm_early"))
        .when(F.col("gm_nth") > 1, "duplicate_name")
        .when(F.col("text").isNull(), "no_extractor")
        .when(text.blank(F.col("text")), "no_text")
        .when(F.size("gm_chunks") > limits.MAX_CHUNKS, "too_many_chunks")
    )
    judged = named.withColumn("reason", reason)
    good = judged.where("reason is null").select(F.col("name").alias("documentName"), F.size("gm_chunks").alias("chunkCount"), F.posexplode("gm_chunks").alias("chunkIndex", "content"))
    rows = good.select("documentName", "chunkIndex", "chunkCount", "content", text.collapse(F.col("content")).alias("normalized"))
    return rows, judged.where("reason is not null").select("path", "name", "reason")


def json_lines(spark: SparkSession, path: str, schema: str, required: tuple[str, ...] = ()) -> DataFrame:
    """Rows of a JSON-lines file; a row without a required field is an error, blank lines are none."""
    df = spark.read.schema(schema).json(path)
    for c in required:
        df = df.withColumn(c, F.when(F.col(c).isNull(), F.raise_error(F.lit(f"a row has no {c}"))).otherwise(F.col(c)))
    return df


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).option("multiLine", "true").json(path).select(F.explode("documents").alias("d")).select("d.*")


def without(df: DataFrame, ids: list[str], column: str = "id") -> DataFrame:
    return df.where(~F.col(column).isin(ids)) if ids else df


def write_json_lines(df: DataFrame, path: str, *partition_by: str) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).json(path)


def wiki_page(payload: Column) -> Column:
    """Header and text of the first page of an extract in JSON; null without text."""
    pages = F.from_json(payload, "query struct<pages: map<string, struct<title: string, extract: string>>>")["query"]["pages"]
    page = F.map_values(pages)[0]
    return F.when(F.length(page["extract"]) > 0, F.concat(page["title"], F.lit("\n\n"), page["extract"]))


def tolerant_json(payload: Column, schema: str) -> Column:
    """A struct of the JSON in a reply, with or without text around it; one of nulls if there is none."""
    body = F.regexp_extract(payload, r"(?s)(\{.*\})", 1)
    return F.coalesce(F.from_json(body, schema), F.from_json(F.lit("{}"), schema))


def append_vectors(chunks: DataFrame, path: str, dims: int) -> None:
    """Appends chunk rows with vectors, by tenant; a vector of another length is an error."""
    size = F.size("embedding")
    checked = chunks.withColumn("embedding", F.when(size != dims, F.raise_error(F.concat(F.lit("a vector has "), size.cast("string"), F.lit(" numbers")))).otherwise(F.col("embedding")))
    checked.write.mode("append").partitionBy("tenant").parquet(path)


def write_lines(lines: DataFrame, path: str, column: str = "line") -> None:
    """Writes rows, in their order, as the lines of a text file, from the driver, a partition at a time."""
    with open(path, "w", encoding="utf-8") as f:
        for row in lines.select(column).toLocalIterator():
            f.write(row[0] + "\n")


def write_report(report: DataFrame, path: str) -> None:
    """Writes a one-row report (``report``) or stats row as JSON, from the driver."""
    row = report.first()
    body = row["report"] if "report" in report.columns else json.dumps(row.asDict(True), indent=2, ensure_ascii=False, default=str)
    with open(path, "w", encoding="utf-8") as f:
        f.write(body.rstrip("\n") + "\n")
