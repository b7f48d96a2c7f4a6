"""Chat histories: cleaning, windows, titles, nesting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gristmill.functions import text

MESSAGES, CHARS, MAX_CONVERSATIONS = 40, 64_000, 500
WIRE = "array<struct<id: string, role: string, parts: array<struct<type: string, text: string>>>>"


def clean_wire(payload: Column) -> Column:
    """Messages (id, role, text) of an untrusted JSON array; anything malformed, blank or of another role goes.

    Each element is read by itself, so one that is no message doesn't spoil the others.  A
    message without an id is named after its place among those that stay.
    """
    elements = F.from_json(F.coalesce(payload, F.lit("[]")), "array<string>")
    one = lambda e: F.from_json(e, "struct<id: string, role: string, parts: string>")
    parts = lambda p: F.from_json(p, "array<struct<type: string, text: string>>")

    def read(e: Column) -> Column:
        m = one(e)
        texts = F.transform(F.filter(parts(m["parts"]), lambda p: (p["type"] == "text") & p["text"].isNotNull()), lambda p: p["text"])
        return F.struct(m["id"].alias("id"), m["role"].alias("role"), F.array_join(F.coalesce(texts, F.array().cast("array<string>")), "").alias("text"))

    found = F.filter(F.transform(F.coalesce(elements, F.array().cast("array<string>")), read), lambda m: m["role"].isin("user", "assistant") & ~text.blank(m["text"]))
    return F.transform(found, lambda m, i: F.struct(F.when(F.length(m["id"]) > 0, m["id"]).otherwise(F.concat(F.lit("sanitized-"), i.cast("string"))).alias("id"), m["role"].alias("role"), m["text"].alias("text")))


def message_text(parts: Column) -> Column:
    """The text parts of a message, one after the other."""
    return F.array_join(F.transform(F.filter(parts, lambda p: p["type"] == "text"), lambda p: p["text"]), "")


def window(messages: DataFrame, limit: int = MESSAGES, chars: int = CHARS) -> DataFrame:
    """The newest messages of each conversation within both budgets; the newest always stays.

    messages: conv_id, turn, role, text.  ``chars`` can only lower the budget.  Texts aren't
    blank, so the running length only grows and the messages that fit are a suffix.
    """
    rows = messages.where(F.col("role").isin("user", "assistant") & ~text.blank(F.col("text")))
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    ranked = rows.withColumn("gm_n", F.row_number().over(newest)).where(F.col("gm_n") <= limit)
    running = F.sum(F.length("text")).over(newest.rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn("gm_sum", running).where((F.col("gm_n") == 1) | (F.col("gm_sum") <= min(chars, CHARS))).drop("gm_n", "gm_sum")


def latest_user_turn(messages: DataFrame) -> DataFrame:
    """conv_id, turn and text of the last user message of each conversation."""
    user = messages.where("role = 'user'")
    last = user.groupBy("conv_id").agg(F.max_by(F.struct("turn", "text"), "turn").alias("m"))
    return last.select("conv_id", "m.turn", "m.text")


def titles(messages: DataFrame) -> DataFrame:
    """conv_id and the title that its first non-blank user message gives."""
    rows = messages.where((F.col("role") == "user") & ~text.blank(F.col("text")))
    return rows.groupBy("conv_id").agg(F.min_by("text", "turn").alias("text")).select("conv_id", text.title(F.col("text")).alias("title"))


def nest(messages: DataFrame) -> DataFrame:
    """One row for each conversation with its messages in order."""
    return messages.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", text.role(F.col("role")).alias("role"), "text"))).alias("messages"))


def active(conversations: DataFrame) -> DataFrame:
    """The conversation of each user that was updated last; conversations: user_id, conv_id, updated_at."""
    w = Window.partitionBy("user_id").orderBy(F.desc("updated_at"), F.desc("conv_id"))
    return conversations.withColumn("gm_n", F.row_number().over(w)).where("gm_n = 1").drop("gm_n")


def lines(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """The lines of replies with their number and what they are shown as."""
    other = [c for c in replies.columns if c != reply]
    return replies.select(*other, F.posexplode(F.split(F.col(reply), "\n", -1)).alias("line_no", "line")).withColumn("kind", text.line_kind(F.col("line")))


def append_messages(conversations: DataFrame, messages: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Conversations and messages after new messages (conv_id, user_id, role, text, created_at), and those that were turned down.

    A message goes into a conversation of its own user only.  It brings updated_at forward, and the first
    user message with text names a conversation that has no title yet.
    """
    owner = conversations.select("conv_id", "user_id")
    accepted = new.join(owner, ["conv_id", "user_id"], "left_semi")
    rejected = new.join(owner, ["conv_id", "user_id"], "left_anti").withColumn("reason", F.lit("not_found_or_not_owned"))
    asks = (F.col("role") == "user") & ~text.blank(F.col("text"))
    facts = accepted.groupBy("conv_id").agg(F.max("created_at").alias("gm_at"), F.min_by(F.when(asks, F.col("text")), F.when(asks, F.col("created_at"))).alias("gm_first"))
    touched = conversations.join(facts, "conv_id", "left")
    touched = touched.withColumn("title", F.coalesce("title", text.title(F.col("gm_first")))).withColumn("updated_at", F.greatest("updated_at", "gm_at")).select(*conversations.columns)
    return touched, messages.unionByName(accepted.select("conv_id", "role", "text", "created_at")), rejected


def create_conversations(conversations: DataFrame, requests: DataFrame, limit: int = MAX_CONVERSATIONS) -> tuple[DataFrame, DataFrame]:
    """Conversations with those asked for (user_id, conv_id, created_at) that fit under each user's limit, in order; and the others with their reason."""
    have = conversations.groupBy("user_id").agg(F.count("*").alias("gm_have"))
    w = Window.partitionBy("user_id").orderBy("created_at", "conv_id")
    ranked = requests.join(have, "user_id", "left").withColumn("gm_owned", F.row_number().over(w) - 1 + F.coalesce("gm_have", F.lit(0)))
    judged = ranked.withColumn("reason", F.when(F.col("gm_owned") >= limit, "too_many_conversations")).drop("gm_owned", "gm_have")
    made = judged.where("reason is null").select("conv_id", "user_id", F.lit(None).cast("string").alias("title"), "created_at", F.col("created_at").alias("updated_at"))
    return conversations.unionByName(made), judged.where("reason is not null")


def get_or_create(conversations: DataFrame, visits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """user_id and conv_id of the conversation that each visiting user (user_id, at) is in, and the conversations with those opened for users without any."""
    first = visits.groupBy("user_id").agg(F.min("at").alias("at"))
    opened = first.join(conversations.select("user_id").distinct(), "user_id", "left_anti")
    opened = opened.select(F.sha2(F.concat_ws("\n", F.lit("conversation"), F.col("user_id").cast("string")), 256).alias("conv_id"), "user_id", F.lit(None).cast("string").alias("title"), F.col("at").alias("created_at"), F.col("at").alias("updated_at"))
    every = conversations.withColumn("conv_id", F.col("conv_id").cast("string")).unionByName(opened)
    return active(every.join(first.select("user_id"), "user_id", "left_semi")).select("user_id", "conv_id"), every


def listing(rows: DataFrame, *by: str) -> DataFrame:
    """Rows as lists show them: newest first by the first column that is given, then by the others."""
    return rows.orderBy(F.desc(by[0]), *by[1:])
