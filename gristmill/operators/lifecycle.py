"""Tables as copy-on-write Parquet: inserts with quotas, scoped deletes that cascade, merges, caches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def document_id(name: str = "name", owner: str = "user_id"):
    return F.sha2(F.concat_ws("\n", owner, name), 256)


def counts(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents with their number of chunks, 0 too; newest first is left to the reader."""
    n = chunks.groupBy("document_id").agg(F.count("*").alias("n_chunks"))
    return documents.join(n, "document_id", "left").withColumn("n_chunks", F.coalesce("n_chunks", F.lit(0)))


def within_quota(existing: DataFrame, new: DataFrame, limit: int) -> DataFrame:
    """The new rows of each user that fit beside the existing ones, in order of ``order_key``."""
    have = existing.groupBy("user_id").agg(F.count("*").alias("gm_have"))
    w = Window.partitionBy("user_id").orderBy("order_key")
    ranked = new.join(have, "user_id", "left").withColumn("gm_n", F.row_number().over(w) + F.coalesce("gm_have", F.lit(0)))
    return ranked.where(F.col("gm_n") <= limit).drop("gm_n", "gm_have")


def delete_cascade(parents: DataFrame, children: DataFrame, doomed: DataFrame, key: str = "document_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Parents and children without the doomed (user_id, key), and per request how many rows went; others' rows stay."""
    own = parents.select("user_id", key)
    hit = doomed.join(own, ["user_id", key], "left_semi").select(key).distinct()
    affected = doomed.join(own.groupBy("user_id", key).agg(F.count("*").alias("affected")), ["user_id", key], "left").withColumn("affected", F.coalesce("affected", F.lit(0)))
    return parents.join(hit, key, "left_anti"), children.join(hit, key, "left_anti"), affected


def upsert_users(users: DataFrame, logins: DataFrame) -> DataFrame:
    """Users (user_id, external_id, email) after logins (external_id, email, verified).

    A known external_id changes nothing.  A new one with the verified address of a user takes
    that user over; with an unverified one it becomes a user under a stand-in address.  New
    users' ids follow from their external_id.
    """
    w = Window.partitionBy("external_id").orderBy(F.desc("verified"), F.col("email").asc_nulls_last())
    new = logins.withColumn("gm_n", F.row_number().over(w)).where("gm_n = 1").drop("gm_n").join(users.select("external_id"), "external_id", "left_anti")
    taken = new.join(users.select("user_id", F.col("email")), "email")
    turn = Window.partitionBy("user_id").orderBy("external_id")
    relinked = taken.where("verified").withColumn("gm_n", F.row_number().over(turn)).where("gm_n = 1").select("user_id", F.col("external_id").alias("gm_new"))
    kept = users.join(relinked, "user_id", "left").select("user_id", F.coalesce("gm_new", "external_id").alias("external_id"), "email")
    rest = new.join(relinked.select(F.col("gm_new").alias("external_id")), "external_id", "left_anti")
    rest = rest.join(users.select("email", F.lit(True).alias("gm_taken")), "email", "left")
    first = Window.partitionBy("email").orderBy(F.desc("verified"), "external_id")
    free = F.col("email").isNotNull() & F.col("gm_taken").isNull() & (F.row_number().over(first) == 1)
    made = rest.withColumn("gm_free", free).select(F.sha2("external_id", 256).alias("user_id"), "external_id", F.when(F.col("gm_free"), F.col("email")).otherwise(F.concat("external_id", F.lit("@unknown.local"))).alias("email"))
    return kept.unionByName(made)


def cache_lookup(requests: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests (key) that the cache (key, seq, value) answers, with the last value written, and those that it doesn't."""
    last = cache.groupBy("key").agg(F.max_by("value", "seq").alias("value"))
    return requests.join(last, "key"), requests.join(last, "key", "left_anti")


def cache_counters(requests: DataFrame, cache: DataFrame, *by: str) -> DataFrame:
    """Hits and misses of requests (key) in the cache."""
    known = cache.select("key").distinct().withColumn("gm_hit", F.lit(True))
    found = requests.join(known, "key", "left")
    return found.groupBy(*by).agg(F.count_if(F.col("gm_hit").isNotNull()).alias("hits"), F.count_if(F.col("gm_hit").isNull()).alias("misses"))


def ingest(documents: DataFrame, chunks: DataFrame, new_documents: DataFrame, new_chunks: DataFrame, limit: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents and chunks after an upload, and the documents that the quota turned down: a document comes in with all its chunks or not at all.

    ``publish`` writes both under one version, so that readers see both or neither.
    """
    fit = within_quota(documents, new_documents, limit)
    kept = fit.select("document_id")
    added = fit.select(*documents.columns)
    return documents.unionByName(added), chunks.unionByName(new_chunks.join(kept, "document_id", "left_semi").select(*chunks.columns)), new_documents.join(kept, "document_id", "left_anti")


def publish(path: str, **tables: DataFrame) -> str:
    """Writes tables as the next version below a path, and then swings the one pointer to it; returns the version.

    The pointer is replaced by a rename that overwrites, so a reader finds the old version or the new
    one, whole, at any time, also if the writer is lost halfway.
    """
    spark = next(iter(tables.values())).sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = lambda x: jvm.org.apache.hadoop.fs.Path(x)
    fs = at(path).getFileSystem(conf)
    taken = [s.getPath().getName() for s in fs.listStatus(at(path))] if fs.exists(at(path)) else []
    version = f"v{max([int(n[1:]) for n in taken if n[:1] == 'v' and n[1:].isdigit()], default=0) + 1:06d}"
    for name, df in tables.items():
        df.write.parquet(f"{path}/{version}/{name}")
    out = fs.create(at(f"{path}/CURRENT.next"), True)
    out.write(bytearray(version.encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(at(path).toUri(), conf)
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    context.rename(at(f"{fs.makeQualified(at(path)).toString()}/CURRENT.next"), at(f"{fs.makeQualified(at(path)).toString()}/CURRENT"), how)
    return version


def current(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table in the version that the pointer names."""
    version = spark.read.text(f"{path}/CURRENT").first()[0]
    return spark.read.parquet(f"{path}/{version}/{name}")
