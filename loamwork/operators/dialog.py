"""Conversations as logs: state, messages, citations, replies, routing.

State is never updated in place; it is computed from events in order. Patterns and the threshold of the gate are
parameters, for no fixed values are laid down for them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import CAMPUSES, LEVELS

INTENTS = {"personalized": r"(?i)\b(my (account|record|plan of study|transcript|grade)|error [a-z]?[0-9]+|did i get)\b", "off_topic": r"(?i)\b(weather|recipe|joke|lyrics|stock price)\b"}
FALLBACK = "Dean of Students Office"
INSUFFICIENT = "[[insufficient]]"
THRESHOLD = 0.5


def slots(events: DataFrame, fields: tuple[str, ...] = ("campus", "academic_level")) -> DataFrame:
    """`events(conversation_id, turn, <fields>)` with each field as known after that turn: a null leaves it as it was."""
    w = Window.partitionBy("conversation_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumns({f: F.last(f, ignorenulls=True).over(w) for f in fields})


def current(events: DataFrame) -> DataFrame:
    """`events(conversation_id, turn, campus, academic_level, pending_question, status)` to one row a conversation: slots
    keep their last value, the pending question and the status are those of the last event, null clears the question."""
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("turn")))
    return events.groupBy("conversation_id").agg(
        F.min("turn").alias("first_turn"), last("campus").alias("campus"), last("academic_level").alias("academic_level"),
        last("status").alias("status"), F.max_by("pending_question", "turn").alias("pending_question"),
    )


def append_messages(messages: DataFrame, new: DataFrame) -> DataFrame:
    """The log with `new` messages at its end: those whose message_id is null, or in the log already, or given before in
    `new`, are left out, so that a run that is repeated appends nothing."""
    once = new.filter("message_id is not null").groupBy("message_id").agg(F.min_by(F.struct(*new.columns), F.struct("created_at", F.xxhash64(*new.columns))).alias("m")).select("m.*")
    return messages.unionByName(once.select(messages.columns).join(messages.select("message_id"), "message_id", "left_anti").select(messages.columns))


def ordered(messages: DataFrame, by: tuple[str, ...] = ("created_at", "message_id")) -> DataFrame:
    """Messages numbered within their conversation."""
    return messages.withColumn("nth", F.row_number().over(Window.partitionBy("conversation_id").orderBy(*by)))


def transcript(messages: DataFrame) -> DataFrame:
    """(conversation_id, text): the turns of each conversation, one a line."""
    line = F.concat(F.col("role"), F.lit(": "), F.coalesce("text", F.lit("")))
    return messages.groupBy("conversation_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))


def invalid_messages(messages: DataFrame) -> DataFrame:
    """Messages with blank text, or hints that are no campus or level."""
    blank = ~F.coalesce(F.col("text").rlike(r"(?U)\S"), F.lit(False))
    wrong = lambda c, values: F.col(c).isNotNull() & ~F.col(c).isin(values)
    return messages.filter(blank | wrong("stated_campus", CAMPUSES) | wrong("stated_academic_level", LEVELS))


def stated(text: Column, values: list[str]) -> Column:
    """The value that a text names, if it names one alone."""
    named = F.array_compact(F.array(*(F.when(text.rlike(rf"(?i)\b{v}\b"), F.lit(v)) for v in values)))
    return F.when(F.size(named) == 1, named[0])


def required_slots(hits: DataFrame) -> DataFrame:
    """`hits(query_id, campus, academic_level)` to (query_id, slots): those in which the hits differ."""
    n = lambda c, values: F.count_distinct(F.when(F.col(c).isin(values), F.col(c))) > 1
    g = hits.groupBy("query_id").agg(n("campus", CAMPUSES).alias("c"), n("academic_level", LEVELS).alias("l"))
    return g.select("query_id", F.array_compact(F.array(F.when(F.col("c"), F.lit("campus")), F.when(F.col("l"), F.lit("academicLevel")))).alias("slots"))


def cited(answers: DataFrame, excerpts: DataFrame) -> DataFrame:
    """`answers(answer_id, text)` and `excerpts(answer_id, n, source_document_id, title, url)` to (answer_id, citations):
    the excerpts whose number stands in brackets in the text, in order, each document once; invented numbers go."""
    used = answers.select("answer_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\[([0-9]+)\]"), F.lit(1)))).alias("n")).withColumn("n", F.col("n").try_cast("int"))
    found = used.join(excerpts, ["answer_id", "n"]).groupBy("answer_id", "source_document_id", "title", "url").agg(F.min("n").alias("n"))
    g = found.groupBy("answer_id").agg(F.array_sort(F.collect_list(F.struct("n", "source_document_id", "title", "url"))).alias("x"))
    named = F.transform("x", lambda x: F.struct(x["source_document_id"].alias("source_document_id"), x["title"].alias("title"), x["url"].alias("url")))
    return answers.select("answer_id").join(g, "answer_id", "left").select("answer_id", F.coalesce(named, F.array().cast("array<struct<source_document_id:string,title:string,url:string>>")).alias("citations"))


def intent(text: Column) -> Column:
    """policy, or the first kind whose pattern the text matches."""
    out = F.lit("policy")
    for name, pattern in reversed(INTENTS.items()):
        out = F.when(text.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def must_escalate(similarity: Column, response: Column, n_citations: Column, threshold: float = THRESHOLD) -> Column:
    """No hit near enough, a marker that says that the sources do not suffice, or no valid citation."""
    return F.coalesce(similarity < threshold, F.lit(True)) | F.contains(F.coalesce(response, F.lit("")), F.lit(INSUFFICIENT)) | (n_citations == 0)


def route(questions: DataFrame, contacts: DataFrame, fallback: str = FALLBACK) -> DataFrame:
    """`questions(question_id, text, campus)` to (question_id, department): the contact most of whose topics the text
    names, one of the same campus before others, then by name; the fallback if none does. Contacts are a short list:
    their topics are matched by word runs of the text, through a join on the topic."""
    topics = contacts.select("name", F.col("campus").alias("c_campus"), F.explode("topics").alias("topic")).distinct()
    longest = topics.agg(F.max(F.size(F.split("topic", " ")))).first()[0] or 1
    words = F.split(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}/]+", " "), " ")
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(longest)), lambda n: F.when(F.size("w") >= n, F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " "))).otherwise(F.array().cast("array<string>"))))
    named = questions.withColumn("w", words).select("question_id", "campus", F.explode(F.array_distinct(runs)).alias("topic")).join(topics, "topic")
    scored = named.groupBy("question_id", "name").agg(F.count("*").alias("n"), F.max(F.coalesce(F.col("c_campus") == F.col("campus"), F.lit(False))).alias("near"))
    best = scored.groupBy("question_id").agg(F.min_by("name", F.struct((-F.col("n")).alias("n"), (~F.col("near")).alias("far"), "name")).alias("department"))
    return questions.select("question_id").join(best, "question_id", "left").select("question_id", F.coalesce("department", F.lit(fallback)).alias("department"))


def reply(answer: Column, escalated: Column, slot: Column) -> Column:
    """The kind of reply: an escalation, a clarifying question if a slot is asked for, or an answer."""
    return F.when(escalated, "escalation").when(slot.isNotNull(), "clarifying_question").when(answer.isNotNull(), "answer")
