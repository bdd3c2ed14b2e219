"""Rebuilding conversations from message rows: grouping, ordering and validation.

Conversations are the connected components of one set of links: a message is tied to the session that it names, and a
message without a session to those that it replies to or quotes. Alternating large and small stars find them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidenza.llm.components import connected_components
from evidenza.runtime import cut

# How the roles of messages are read.
ROLES = {"user": "user", "human": "user", "assistant": "assistant", "ai": "assistant", "model": "assistant", "tool": "passed", "system": "passed", "developer": "passed"}


def role_reading(role: Column) -> Column:
    """user, assistant, passed (tool, system, developer) or unreadable; case and outer blanks don't matter."""
    plain = F.lower(F.trim(F.coalesce(role, F.lit(""))))
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv]), plain), F.lit("unreadable"))


def counting(df: DataFrame) -> DataFrame:
    """(session, id, role, ts, content): messages that count.

    A message counts unless active is false, _compressed_summary is true or its content is null or only blanks, tabs
    and line ends. An id counts once (of unlike rows of one id the least), and messages of one session alike in role
    reading, timestamp and content count once, as the one with the smallest id; rows with a null id are each other's
    repeats only if alike in everything. Messages without a session keep a null session and are never merged.
    """
    keep = F.coalesce("active", F.lit(True)) & ~F.coalesce("_compressed_summary", F.lit(False)) & F.col("content").rlike(r"[^ \t\r\n]")
    row = F.struct(F.col("session_id").alias("session"), role_reading(F.col("role")).alias("role"), F.col("timestamp").alias("ts"), "content")
    rows = df.where(keep).select("id", row.alias("row"))
    known = rows.where(F.col("id").isNotNull()).groupBy("id").agg(F.min("row").alias("row"))
    rows = known.unionByName(rows.where(F.col("id").isNull()).distinct()).select("id", "row.*")
    alike = rows.where(F.col("session").isNotNull()).groupBy("session", "role", "ts", "content").agg(F.min("id").alias("id"))
    return alike.unionByName(rows.where(F.col("session").isNull()).select("session", "role", "ts", "content", "id"))


def _node() -> Column:
    """What a message is called among the links: by its id, or by its content if it has none."""
    unnamed = F.md5(F.to_json(F.struct("session", "role", F.unix_micros("ts").alias("ts"), "content")))
    return F.when(F.col("id").isNotNull(), F.concat(F.lit("m:"), F.col("id").cast("string"))).otherwise(F.concat(F.lit("n:"), unnamed))


def _thread_links(rows: DataFrame, links: DataFrame | None) -> DataFrame:
    """(a, b): reply and quote links between messages (with ``node``) that have no session.

    A quote link ties a message whose lines starting with ">" repeat the whole content of others to the first of them,
    if that one is earlier. ``links`` may give reply links (id, reply_to).
    """
    loose = rows.where(F.col("session").isNull())
    at = F.struct(F.col("ts").isNull().alias("undated"), F.col("ts"), F.col("id"))
    text = lambda c: F.md5(F.regexp_replace(F.lower(F.trim(c)), r"\s+", " "))
    quoted = F.regexp_replace(F.array_join(F.regexp_extract_all("content", F.lit(r"(?m)^>[^\n]*"), F.lit(0)), "\n"), r"(?m)^>\s?", "")
    quoting = loose.where(F.col("content").rlike(r"(?m)^>\s*\S")).select(F.col("node").alias("a"), at.alias("a_at"), text(quoted).alias("h"))
    # of a text that many messages share only the first counts, so a common text makes no large group
    first = loose.groupBy(text(F.col("content")).alias("h")).agg(F.min(F.struct(at.alias("at"), "node")).alias("first"))
    edges = quoting.join(first, "h").where(F.col("first.at") < F.col("a_at")).select("a", F.col("first.node").alias("b"))
    if links is not None:
        named = loose.where(F.col("id").isNotNull())
        one, two = named.select(F.col("id").alias("from_id"), F.col("node").alias("a")), named.select(F.col("id").alias("to_id"), F.col("node").alias("b"))
        replies = links.select(F.col("id").alias("from_id"), F.col("reply_to").alias("to_id"))
        edges = edges.unionByName(replies.join(one, "from_id").join(two, "to_id").select("a", "b"))
    return edges


def grouped(rows: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """The counting messages with ``session`` as struct(is_thread, name): the conversation each belongs to.

    A message no link reaches is a thread of its own; a thread is called "thread-" and its smallest id, or a digest of
    its content if no message of it has an id.
    """
    rows = cut(rows.withColumn("node", _node()))
    # "a:" sorts before the messages, so a session is the smallest node of its component
    stated = rows.where(F.col("session").isNotNull()).select(F.col("node").alias("a"), F.concat(F.lit("a:"), F.col("session")).alias("b"))
    found = connected_components(stated.unionByName(_thread_links(rows, links)))
    rows = rows.drop("session").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    own = ~F.startswith("component", F.lit("a:"))
    smallest = rows.where(own).groupBy("component").agg(F.min("id").alias("smallest"))
    rows = rows.join(smallest, "component", "left")
    thread = F.concat(F.lit("thread-"), F.coalesce(F.col("smallest").cast("string"), F.substring("component", 3, 40)))
    name = F.when(own, thread).otherwise(F.expr("substring(component, 3)"))
    return rows.select(F.struct(own.alias("is_thread"), name.alias("name")).alias("session"), "role", "ts", "content", "id")


def _places(rows: DataFrame) -> DataFrame:
    """User and assistant messages with the role of the one before; long conversations are spread over tasks.

    The rows are cut into ranges of (session, ts, id), so a conversation that holds a third of all rows lies in as many
    ranges; inside a range the preceding role comes from a window, and across ranges from the last role of the range
    before, of which there is one row a conversation and range.
    """
    said = rows.where(F.col("role").isin("user", "assistant")).select("session", "ts", "id", "role")
    said = said.repartitionByRange("session", "ts", "id").withColumn("part", F.spark_partition_id())
    inner = Window.partitionBy("session", "part").orderBy("ts", "id")
    return said.withColumn("before", F.lag("role").over(inner)).withColumn("at", F.row_number().over(inner))


def conversations(messages: DataFrame, sessions: DataFrame | None = None, links: DataFrame | None = None) -> DataFrame:
    """(conversation, is_thread, reason, n_messages, n_turns, first_ts, last_ts): every conversation and why it is dropped.

    Conversations are all ids of sessions and of messages.session_id, and the threads of messages without a session.
    The order is by timestamp, then id. The reason is the first that holds, else null:
    empty (no counting message reads as user or assistant); broken (a counting message has an unreadable role, one of
    user or assistant has no timestamp, the first of them is an assistant, or two assistant messages follow each other);
    no_reply (a user message is followed by a user message or by nothing). Empty tables give no conversation.
    """
    rows = grouped(counting(messages), links)
    return _judged(rows, messages, sessions)


def _judged(rows: DataFrame, messages: DataFrame, sessions: DataFrame | None) -> DataFrame:
    names = messages.select(F.col("session_id").alias("session"))
    if sessions is not None:
        names = names.unionByName(sessions.select(F.col("id").alias("session")))
    names = names.where(F.col("session").isNotNull()).distinct().select(F.struct(F.lit(False).alias("is_thread"), F.col("session").alias("name")).alias("session"))
    names = names.unionByName(rows.where("session.is_thread").select("session").distinct())

    said = F.col("role").isin("user", "assistant")
    facts = rows.groupBy("session").agg(
        F.count("*").alias("n_messages"), F.count_if(said).alias("n_turns"), F.count_if(F.col("role") == "unreadable").alias("unreadable"),
        F.count_if(said & F.col("ts").isNull()).alias("undated"), F.min(F.when(said, F.col("ts"))).alias("first_ts"), F.max(F.when(said, F.col("ts"))).alias("last_ts"),
    )
    placed = _places(rows)
    pieces = placed.groupBy("session", "part").agg(
        F.count_if((F.col("role") == "assistant") & (F.col("before") == "assistant")).alias("aa"), F.count_if((F.col("role") == "user") & (F.col("before") == "user")).alias("uu"),
        F.min_by("role", "at").alias("head"), F.max_by("role", "at").alias("tail"),
    )
    over = Window.partitionBy("session").orderBy("part")
    pieces = pieces.withColumn("prior", F.lag("tail").over(over)).withColumn("k", F.row_number().over(over))
    joined = pieces.groupBy("session").agg(
        F.sum(F.col("aa") + F.when((F.col("head") == "assistant") & (F.col("prior") == "assistant"), 1).otherwise(0)).alias("aa"),
        F.sum(F.col("uu") + F.when((F.col("head") == "user") & (F.col("prior") == "user"), 1).otherwise(0)).alias("uu"),
        F.min_by("head", "k").alias("head"), F.max_by("tail", "k").alias("tail"),
    )
    out = names.join(facts, "session", "left").join(joined, "session", "left")
    reason = (
        F.when(F.coalesce("n_turns", F.lit(0)) == 0, "empty")
        .when((F.col("unreadable") > 0) | (F.col("undated") > 0) | (F.col("head") == "assistant") | (F.col("aa") > 0), "broken")
        .when((F.col("uu") > 0) | (F.col("tail") == "user"), "no_reply")
    )
    n = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select(F.col("session.name").alias("conversation"), F.col("session.is_thread").alias("is_thread"), reason.alias("reason"), n("n_messages"), n("n_turns"), "first_ts", "last_ts")


def rebuilt(messages: DataFrame, sessions: DataFrame | None = None, links: DataFrame | None = None) -> DataFrame:
    """(conversation, turn, id, role, ts, content): the kept conversations as ordered rows, one a message.

    Turns are numbered from 1 in order of timestamp, then id; messages that are passed over are left out.
    """
    rows = cut(grouped(counting(messages), links))
    kept = _judged(rows, messages, sessions).where(F.col("reason").isNull())
    said = rows.select(F.col("session.name").alias("conversation"), F.col("session.is_thread").alias("is_thread"), "id", "role", "ts", "content")
    said = said.where(F.col("role").isin("user", "assistant")).join(kept.select("conversation", "is_thread"), ["conversation", "is_thread"], "left_semi")
    # read twice below, so the ranges are written down once
    said = cut(said.repartitionByRange("conversation", "is_thread", "ts", "id").withColumn("part", F.spark_partition_id()))
    sizes = said.groupBy("conversation", "is_thread", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("conversation", "is_thread").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("skip", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inner = Window.partitionBy("conversation", "is_thread", "part").orderBy("ts", "id")
    said = said.withColumn("at", F.row_number().over(inner)).join(sizes, ["conversation", "is_thread", "part"])
    return said.select("conversation", (F.col("skip") + F.col("at")).alias("turn"), "id", "role", "ts", "content")
