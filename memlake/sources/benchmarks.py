"""Retrieval benchmarks in JSON files: questions, and the haystack of each, as ``operators.haystack`` takes them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TURNS = "array<struct<role:string,content:string>>"
DIALOG = "array<struct<speaker:string,dia_id:string,text:string>>"


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def _said(turns: Column, roles: tuple[str, ...]) -> Column:
    return F.array_join(F.transform(F.filter(turns, lambda t: t["role"].isin(*roles)), lambda t: t["content"]), "\n")


def session_memory(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Questions (qid, question, asked_at, answers) and haystacks (qid, corpus_id, position, document, full_text, occurred_at).

    Each entry lists sessions of turns, their ids and dates (yyyy/MM/dd (Day) HH:mm). A session's document is what the
    user said in it; sessions without such turns are left out.
    """
    rows = _read(spark, path, f"question_id string, question string, question_date string, answer_session_ids array<string>, haystack_sessions array<{TURNS}>, haystack_session_ids array<string>, haystack_dates array<string>")
    day = lambda c: F.regexp_replace(F.substring(c, 1, 10), "/", "-")
    asked = rows.select(F.col("question_id").alias("qid"), "question", day("question_date").alias("asked_at"), F.col("answer_session_ids").alias("answers"))
    zipped = F.arrays_zip("haystack_session_ids", "haystack_sessions", "haystack_dates")
    each = rows.select(F.col("question_id").alias("qid"), F.posexplode(zipped).alias("position", "z"))
    out = each.select("qid", F.col("z.haystack_session_ids").alias("corpus_id"), "position", _said(F.col("z.haystack_sessions"), ("user",)).alias("document"), F.array_join(F.transform("z.haystack_sessions", lambda t: t["content"]), "\n").alias("full_text"), day("z.haystack_dates").alias("occurred_at"))
    return asked, out.where("document <> ''")


def dialogs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Questions (qid, question, answer, category, evidence) and haystacks by turn (qid, corpus_id, position, document, session, date).

    Each entry holds a conversation with fields session_1, session_1_date_time and so on, as many as there are, and
    questions of its own. A turn's position is its place among all turns of the conversation.
    """
    rows = _read(spark, path, "sample_id string, conversation map<string,string>, qa array<struct<question:string,answer:string,category:int,evidence:array<string>>>")
    asked = rows.select("sample_id", F.posexplode("qa").alias("n", "q")).select(F.concat_ws("/", "sample_id", "n").alias("qid"), "sample_id", "q.*")
    fields = rows.select("sample_id", "conversation", F.explode("conversation").alias("name", "value"))
    number = F.regexp_extract("name", r"^session_([0-9]+)$", 1)
    held = fields.where(number != "").select("sample_id", number.cast("int").alias("session"), F.try_element_at("conversation", F.concat("name", F.lit("_date_time"))).alias("date"), F.from_json("value", DIALOG).alias("turns"))
    each = held.where("turns IS NOT NULL").select("sample_id", "session", "date", F.posexplode("turns").alias("at", "t"))
    place = F.row_number().over(Window.partitionBy("sample_id").orderBy("session", "at")) - 1
    text = F.concat("t.speaker", F.lit(' said, "'), "t.text", F.lit('"'))
    turns = each.select("sample_id", F.coalesce("t.dia_id", F.concat(F.lit("D"), "session", F.lit(":?"))).alias("corpus_id"), place.alias("position"), text.alias("document"), "session", "date")
    return asked.drop("sample_id"), asked.select("qid", "sample_id").join(turns, "sample_id").drop("sample_id")


def evidence(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Questions (qid, question, evidence) and haystacks by message (qid, corpus_id, position, document), from files of evidence items."""
    item = "struct<question:string,conversations:array<struct<messages:array<struct<speaker:string,text:string>>>>,message_evidences:array<struct<text:string>>>"
    rows = _read(spark, path, f"evidence_items array<{item}>").select(F.input_file_name().alias("file"), F.posexplode("evidence_items").alias("n", "i"))
    rows = rows.select(F.concat_ws("/", F.element_at(F.split("file", "/"), -1), "n").alias("qid"), "i.*")
    asked = rows.select("qid", "question", F.transform("message_evidences", lambda e: e["text"]).alias("evidence"))
    each = rows.select("qid", F.posexplode(F.flatten(F.transform("conversations", lambda c: c["messages"]))).alias("position", "m"))
    return asked, each.select("qid", F.concat(F.lit("msg_"), "position").alias("corpus_id"), "position", F.col("m.text").alias("document"))


def multiple_choice(spark: SparkSession, path: str, topic: str = "movie") -> tuple[DataFrame, DataFrame]:
    """Questions (qid, question, choices, answer, targets) and haystacks by turn (qid, corpus_id, position, document).

    Files hold items by topic, or under roles and events, which count for every topic. An item's messages are a list of
    turns or of sessions; a turn is known by sid or mid, else by its place.
    """
    turn = "struct<sid:string,mid:string,user:string,user_message:string,assistant:string,assistant_message:string,time:string>"
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    by_topic = raw.select("file", F.explode(F.from_json("value", "map<string,string>")).alias("topic", "items")).where(F.col("topic").isin(topic, "roles", "events"))
    items = by_topic.select("file", "topic", F.posexplode(F.from_json("items", "array<string>")).alias("n", "item"))
    j = lambda p: F.get_json_object("item", p)
    qid = F.concat_ws("/", F.element_at(F.split("file", "/"), -1), "topic", "n").alias("qid")
    kept = items.where(j("$.QA.question").isNotNull() & j("$.message_list[0]").isNotNull())
    flat = F.from_json(j("$.message_list"), f"array<{turn}>")
    nested = F.flatten(F.filter(F.from_json(j("$.message_list"), f"array<array<{turn}>>"), lambda s: s.isNotNull()))
    messages = F.when(F.startswith(F.ltrim(j("$.message_list[0]")), F.lit("[")), nested).otherwise(flat)
    asked = kept.select(qid, j("$.QA.question").alias("question"), F.from_json(j("$.QA.choices"), "map<string,string>").alias("choices"), j("$.QA.ground_truth").alias("answer"), F.from_json(j("$.QA.target_step_id"), "array<array<int>>").alias("targets"))
    each = kept.select(qid, F.posexplode(messages).alias("position", "t"))
    time = F.when(F.coalesce("t.time", F.lit("")) != "", F.concat(F.lit("["), "t.time", F.lit("] "))).otherwise("")
    text = F.concat(time, F.lit("[User] "), F.coalesce("t.user", "t.user_message", F.lit("")), F.lit(" [Assistant] "), F.coalesce("t.assistant", "t.assistant_message", F.lit("")))
    known = F.coalesce("t.sid", "t.mid", F.col("position").cast("string"))
    return asked, each.select("qid", known.alias("corpus_id"), "position", text.alias("document"))
