"""Line deduplication: which lines of each document stay, as compressed bitmaps.

A long line's key is hashed to 128 bits; hashes with document and position are written once.  They
are partitioned by ranges of the hash, with a secondary sort by document (the largest first) and
position, and read as a stream: the first document of a key's run keeps its lines, and the
others lose theirs if the run has enough documents.  Keys of more than ``HOT`` lines would
make a long run in one task, so partial counts, one row for each key and task, tell them first: their
largest document and number of documents come from aggregates, and their lines meet these by a join.
Both ways give the same rows.

The dropped lines of a document come together and become a bitmap: 64 lines a number,
numbers that drop nothing left out.  Only hashes and positions move until ``apply`` brings bitmaps
and texts together.

All of it is DataFrame functions.

Null and empty texts are one empty line.  Rows that repeat a doc_id are one document, and its lines
all stay if it is the largest that holds them.  Rows with a null doc_id are together one document that
is less than any other.  Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import _spark

MIN_CHARS, MIN_DOCS = 40, 5
#: Lines of a key beyond which its run is not read in one task, and such keys that are broadcast at most.
HOT, BROADCAST_KEYS = 4096, 100_000
#: White space that is stripped from both ends of a line.
_ENDS = " \t\n\x0b\f\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines(text: str = "text") -> Column:
    return F.split(_spark.empty_text(text), "\n", -1)


def key(line: Column) -> Column:
    """The line without white space at its ends and with A-Z in lower case.

    ``lower`` would change other letters too; it is used where there are none, which is most lines.
    """
    bare = F.btrim(line, F.lit(_ENDS))
    return F.when(bare.rlike(r"^[\x00-\x7f]*\z"), F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


def _hash(k: Column) -> Column:
    return F.struct(F.xxhash64(k, F.lit(1)).alias("a"), F.xxhash64(F.lit(2), k).alias("b"))


def _marked(documents: DataFrame, min_chars: int) -> DataFrame:
    """gm_row (doc_id and a hash of the text) and the hashes of the lines, null for short keys."""
    # a key is no longer than its line, so short lines need no key
    h = F.transform(lines(), lambda x: F.when(F.length(x) >= min_chars, F.transform(F.array(key(x)), lambda k: F.when(F.length(k) >= min_chars, _hash(k)))[0]))
    return documents.select("doc_id", F.xxhash64(_spark.empty_text()).alias("gm_text"), h.alias("gm_lines"))


def keep_bitmaps(documents: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, gm_text (a hash of the text), n_dropped and words of each distinct document that loses lines.

    ``words`` are structs of ``at`` and ``bits``, ascending: line 64 * at + i is dropped if bit i is set.
    """
    rows = _marked(documents, min_chars).select("doc_id", "gm_text", F.posexplode("gm_lines").alias("gm_at", "gm_key")).where("gm_key is not null")
    rows = _spark.cut(rows.select("doc_id", "gm_text", "gm_at", F.col("gm_key.a").alias("a"), F.col("gm_key.b").alias("b")))
    hot = _spark.cut(rows.groupBy("a", "b").agg(F.count("*").alias("gm_n")).where(F.col("gm_n") > HOT).select("a", "b"))
    hot = F.broadcast(hot) if hot.count() <= BROADCAST_KEYS else hot
    dropped = _streamed(rows.join(hot, ["a", "b"], "left_anti"), min_docs).unionByName(_looked_up(rows, hot, min_docs))
    words = (
        dropped.select("doc_id", "gm_text", "gm_at")
        .distinct()
        .groupBy("doc_id", "gm_text", F.shiftright("gm_at", 6).alias("at"))
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("gm_at").bitwiseAND(63))).alias("bits"))
    )
    return words.groupBy("doc_id", "gm_text").agg(F.sum(F.bit_count("bits")).alias("n_dropped"), F.sort_array(F.collect_list(F.struct("at", "bits"))).alias("words"))


def _streamed(rows: DataFrame, min_docs: int) -> DataFrame:
    """doc_id, gm_text and gm_at of the lines that go, from each key's run in order of document and position."""
    run = Window.partitionBy("a", "b")
    ranged = rows.repartitionByRange("a", "b").sortWithinPartitions("a", "b", F.col("doc_id").desc_nulls_last(), "gm_at")
    nth = ranged.withColumn("gm_nth", F.dense_rank().over(run.orderBy(F.col("doc_id").desc_nulls_last())))
    return nth.withColumn("gm_docs", F.max("gm_nth").over(run)).where((F.col("gm_nth") > 1) & (F.col("gm_docs") >= min_docs)).select("doc_id", "gm_text", "gm_at")


def _looked_up(rows: DataFrame, hot: DataFrame, min_docs: int) -> DataFrame:
    """The same of the keys in ``hot``; their documents are counted by partial sums."""
    mine = rows.join(hot, ["a", "b"], "left_semi")
    docs = mine.select("a", "b", "doc_id").distinct()
    facts = docs.groupBy("a", "b").agg(F.count("*").alias("gm_docs"), F.max("doc_id").alias("gm_keep")).where(F.col("gm_docs") >= min_docs)
    return mine.join(facts, ["a", "b"]).where(~F.col("doc_id").eqNullSafe(F.col("gm_keep"))).select("doc_id", "gm_text", "gm_at")


def apply(documents: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """The documents with gm_kept (the lines that stay, joined by a newline), gm_n_lines and gm_n_dropped."""
    b = bitmaps.select(F.col("doc_id").alias("gmb_doc"), F.col("gm_text").alias("gmb_text"), F.col("n_dropped").alias("gmb_dropped"), F.col("words").alias("gmb_words"))
    on = documents["doc_id"].eqNullSafe(b["gmb_doc"]) & (F.xxhash64(_spark.empty_text()) == b["gmb_text"])
    joined = documents.join(b, on, "left")
    bits = F.map_from_entries("gmb_words")

    def stays(_, i: Column) -> Column:
        word = F.coalesce(F.element_at(F.col("gmb_map"), F.shiftright(i, 6)), F.lit(0).cast("long"))
        return F.call_function("shiftrightunsigned", word, i.bitwiseAND(63)).bitwiseAND(F.lit(1).cast("long")) == 0

    kept = F.array_join(F.filter(lines(), stays), "\n")
    return (
        joined.withColumn("gmb_map", F.when(F.col("gmb_words").isNotNull(), bits))
        .withColumn("gm_n_lines", F.size(lines()).cast("long"))
        .withColumn("gm_n_dropped", F.coalesce("gmb_dropped", F.lit(0)).cast("long"))
        .withColumn("gm_kept", F.when(F.col("gmb_words").isNull(), _spark.empty_text()).otherwise(kept))
        .drop("gmb_doc", "gmb_text", "gmb_dropped", "gmb_words", "gmb_map")
    )


def clean(documents: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """The documents without the lines that go; n_chars, if there, is counted anew.  A null text stays null."""
    out = apply(documents, keep_bitmaps(documents, min_chars, min_docs))
    text = F.when(F.col("text").isNotNull(), F.col("gm_kept")).alias("text")
    new = {"text": text}
    if "n_chars" in documents.columns:
        new["n_chars"] = F.when(F.col("text").isNotNull(), F.length("gm_kept")).otherwise(F.col("n_chars")).cast(documents.schema["n_chars"].dataType).alias("n_chars")
    return out.select(*[new.get(c, F.col(f"`{c}`")) for c in documents.columns])


def report(documents: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_sha256 of each row."""
    docs = documents.select("doc_id", "text")
    out = apply(docs, keep_bitmaps(docs, min_chars, min_docs))
    return out.select("doc_id", F.col("gm_n_lines").alias("n_lines"), F.col("gm_n_dropped").alias("n_dropped"), F.sha2(F.col("gm_kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE_SQL = """
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), l AS (
  SELECT r, doc_id, i, line, translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT r, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM t)
), d AS (
  SELECT k, max(doc_id) AS keep FROM l WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) + max((doc_id IS NULL)::INT) >= 5
), m AS (
  SELECT l.*, d.k IS NOT NULL AND l.doc_id IS DISTINCT FROM d.keep AS gone FROM l LEFT JOIN d USING (k)
)
SELECT first(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY r
"""
