"""Queries over the archive of conversations: candidates, pages, windows, samples."""

from __future__ import annotations

import base64
import hashlib
import json
from datetime import datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidenza.functions import text
from evidenza.runtime import numbered

# Sessions of these sources are never shown.
HIDDEN_SOURCES = ["kanban", "subagent", "tool"]


def visible_message() -> Column:
    """Active or compacted, not hidden, no compressed summary, of a user or an assistant."""
    on = F.coalesce("active", F.lit(True)) | F.coalesce("compacted", F.lit(False))
    return on & (F.coalesce("display_kind", F.lit("")) != "hidden") & ~F.coalesce("_compressed_summary", F.lit(False)) & F.coalesce(F.col("role").isin("user", "assistant"), F.lit(False))


def visible_session(profile: str | None = None) -> Column:
    own = F.lit(True) if profile is None else F.coalesce("profile_name", F.lit("default")) == profile
    return ~F.coalesce("hidden", F.lit(False)) & ~F.coalesce(F.col("source").isin(*HIDDEN_SOURCES), F.lit(False)) & own


def civil_range(word: str, now: datetime, zone: str) -> tuple[datetime, datetime]:
    """today, yesterday, last_week, a date, or spans such as 6h, 2d, 1w as a half-open range in UTC; days begin at local midnight."""
    tz, utc = ZoneInfo(zone), ZoneInfo("UTC")
    local = now.astimezone(tz)
    midnight = lambda d: datetime(d.year, d.month, d.day, tzinfo=tz).astimezone(utc)
    day = local.date()
    if word == "today":
        return midnight(day), midnight(day + timedelta(days=1))
    if word == "yesterday":
        return midnight(day - timedelta(days=1)), midnight(day)
    if word == "last_week":
        monday = day - timedelta(days=day.weekday())
        return midnight(monday - timedelta(days=7)), midnight(monday)
    if word[:-1].isdigit() and word[-1] in "hdw":
        return now.astimezone(utc) - timedelta(hours=int(word[:-1]) * {"h": 1, "d": 24, "w": 168}[word[-1]]), now.astimezone(utc)
    d = datetime.strptime(word, "%Y-%m-%d").date()
    return midnight(d), midnight(d + timedelta(days=1))


def cursor(values: dict, request: dict) -> str:
    """An opaque place in a paged result, bound to the request it belongs to."""
    mark = hashlib.sha256(json.dumps(request, sort_keys=True, default=str).encode()).hexdigest()[:16]
    return base64.urlsafe_b64encode(json.dumps({"at": values, "of": mark}, sort_keys=True, default=str).encode()).decode()


def opened(token: str, request: dict) -> dict:
    """The values of a cursor; an error if it belongs to another request or isn't one."""
    try:
        got = json.loads(base64.urlsafe_b64decode(token.encode()))
        mark = hashlib.sha256(json.dumps(request, sort_keys=True, default=str).encode()).hexdigest()[:16]
    except Exception as e:
        raise ValueError("malformed cursor") from e
    if got.get("of") != mark:
        raise ValueError("this cursor belongs to another request")
    return got["at"]


def candidates(sessions: DataFrame, messages: DataFrame, start: str, end: str, after: tuple | None = None, limit: int | None = None) -> DataFrame:
    """Visible sessions with a visible message in the range, in order of (started_at, id) after a place."""
    said = messages.where(visible_message() & (F.col("timestamp") >= F.lit(start).cast("timestamp")) & (F.col("timestamp") < F.lit(end).cast("timestamp"))).select(F.col("session_id").alias("id"))
    rows = sessions.where(visible_session()).join(said, "id", "left_semi")
    if after is not None:
        at, ident = F.lit(after[0]).cast("timestamp"), F.lit(after[1])
        rows = rows.where((F.col("started_at") > at) | ((F.col("started_at") == at) & (F.col("id") > ident)))
    rows = rows.orderBy(F.asc_nulls_last("started_at"), "id")
    return rows.limit(limit) if limit else rows


def windows(messages: DataFrame, anchors: DataFrame, around: int = 2) -> DataFrame:
    """(anchor, id, offset): the visible messages around each anchor message in its session."""
    rows = numbered(messages.where(visible_message() & F.col("session_id").isNotNull()).select("session_id", "timestamp", "id"), ["session_id"], ["timestamp", "id"]).select("session_id", "id", "n")
    mid = rows.join(anchors.select(F.col("anchor").alias("id")), "id", "left_semi").select("session_id", F.col("id").alias("anchor"), F.col("n").alias("m"))
    near = mid.select("session_id", "anchor", "m", F.explode(F.sequence(F.lit(-around), F.lit(around))).alias("offset")).withColumn("n", F.col("m") + F.col("offset"))
    return near.join(rows, ["session_id", "n"]).select("anchor", "id", "offset")


def sample(messages: DataFrame, n: int = 6) -> DataFrame:
    """The first and last n/2 visible messages of each session."""
    rows = numbered(messages.where(visible_message() & F.col("session_id").isNotNull()).select("session_id", "timestamp", "id"), ["session_id"], ["timestamp", "id"])
    sizes = rows.groupBy("session_id").agg(F.count("*").alias("all"))
    return rows.join(sizes, "session_id").where((F.col("n") <= n // 2) | (F.col("n") > F.col("all") - n // 2)).select("session_id", "id", F.col("n").alias("position"))


def round_robin(messages: DataFrame, limit: int = 80) -> DataFrame:
    """One message of each session in turn, up to the limit, sessions in order of their first message."""
    w = Window.partitionBy("session_id").orderBy("timestamp", "id")  # with the limit, each task keeps the first of a session only
    rows = messages.where(visible_message() & F.col("session_id").isNotNull()).withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= limit)
    first = messages.where(visible_message() & F.col("session_id").isNotNull()).groupBy("session_id").agg(F.min("timestamp").alias("began"))
    return rows.join(first, "session_id").orderBy("turn", F.asc_nulls_first("began"), "session_id").limit(limit).select("session_id", "id", "turn")


def matching(messages: DataFrame, words: list[str]) -> DataFrame:
    """Visible messages that have any of the words; only those that hold one as a piece are read into words."""
    low, piece = F.lower("content"), F.lit(False)
    for w in words:
        piece = piece | F.contains(low, F.lit(w))
    return messages.where(visible_message() & piece).where(F.arrays_overlap(text.tokens(F.col("content")), F.array(*[F.lit(w) for w in words])))


def version_digest(messages: DataFrame) -> DataFrame:
    """(session_id, version): changes whenever a visible message is added, changed or dropped."""
    one = F.conv(F.substring(F.sha2(F.concat_ws("|", F.col("id").cast("string"), F.coalesce("role", F.lit("")), F.coalesce("content", F.lit(""))), 256), 1, 12), 16, 10).cast("decimal(20,0)")
    per = messages.where(visible_message() & F.col("session_id").isNotNull()).groupBy("session_id").agg(F.count("*").alias("n"), F.max("id").alias("last"), F.sum(one).cast("decimal(38,0)").alias("mark"))
    return per.select("session_id", "n", F.sha2(F.concat_ws("|", F.col("n").cast("string"), F.col("last").cast("string"), F.col("mark").cast("string")), 256).alias("version"))


def page(rows: DataFrame, order: list, size: int) -> DataFrame:
    """The first ``size`` rows in an order with ``has_more``: one row more is asked for, to know whether another page follows."""
    found = rows.orderBy(*order).limit(size + 1)
    place = Window.orderBy(*order)  # of size + 1 rows
    found = found.withColumn("_n", F.row_number().over(place)).withColumn("has_more", F.count("*").over(Window.partitionBy()) > size)
    return found.where(F.col("_n") <= size).drop("_n")


def pages(messages: DataFrame, size: int = 80) -> DataFrame:
    """(session_id, id, page, place): the visible messages of each session in pages of ``size``."""
    rows = numbered(messages.where(visible_message() & F.col("session_id").isNotNull()).select("session_id", "timestamp", "id"), ["session_id"], ["timestamp", "id"])
    return rows.select("session_id", "id", (F.floor((F.col("n") - 1) / size) + 1).cast("bigint").alias("page"), (F.pmod(F.col("n") - 1, F.lit(size)) + 1).cast("bigint").alias("place"))


def scanned(messages: DataFrame, after: int, limit: int, piece: str) -> DataFrame:
    """(id, watermark): the messages that hold a piece of text among the next ``limit`` visible ones after an id; the watermark moves past those that don't, too."""
    part = messages.where(visible_message() & (F.col("id") > after)).orderBy("id").limit(limit)
    mark = part.agg(F.max("id").alias("watermark"))
    return part.where(F.contains(F.lower("content"), F.lit(piece.lower()))).select("id").join(F.broadcast(mark))  # one row


def merged_hits(messages: DataFrame, words: list[str], piece: str) -> DataFrame:
    """(session_id, id, by_word, by_piece): hits by whole words and by a piece of text, each message once."""
    word, part = F.arrays_overlap(text.tokens(F.col("content")), F.array(*[F.lit(w) for w in words])), F.contains(F.lower(F.coalesce("content", F.lit(""))), F.lit(piece.lower()))
    return messages.where(visible_message()).select("session_id", "id", word.alias("by_word"), part.alias("by_piece")).where("by_word OR by_piece")


def topic_evidence(messages: DataFrame, words: list[str], sessions: int = 10, limit: int = 80) -> DataFrame:
    """(session_id, id, turn, kind, excerpt): what the sessions that most lately spoke of any of the words said of it, in turns over them."""
    hits = matching(messages, words).where(F.col("session_id").isNotNull() & F.col("timestamp").isNotNull())
    newest = hits.groupBy("session_id").agg(F.max("timestamp").alias("newest")).orderBy(F.desc("newest"), "session_id").limit(sessions)
    turn = Window.partitionBy("session_id").orderBy("timestamp", "id")
    rows = hits.join(F.broadcast(newest), "session_id").withColumn("turn", F.row_number().over(turn)).where(F.col("turn") <= limit)  # at most ``sessions`` rows
    rows = rows.orderBy("turn", F.desc("newest"), "session_id").limit(limit)
    first = F.array_min(F.filter(F.transform(F.array(*[F.lit(w) for w in words]), lambda w: F.instr(F.lower("content"), w)), lambda i: i > 0))
    return rows.select("session_id", "id", "turn", text.statement_kind(F.col("content")).alias("kind"), F.substring("content", F.greatest(F.lit(1), first - 1000), F.lit(2001)).alias("excerpt"))
