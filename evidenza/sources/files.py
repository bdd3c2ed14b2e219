"""File sources and sinks: Markdown folders, memory files, case files, reports, snapshots."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidenza.functions import text


def markdown_folder(spark: SparkSession, root: str, excluded: list[str] | None = None) -> DataFrame:
    """(path, text, modified, hash) of the Markdown files below a folder; files whose first folder begins with an excluded prefix are left out.

    A folder that can't be read fails the scan, so nothing is taken for deleted by mistake.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{md,markdown}").load(root)
    clean = root.rstrip("/").removeprefix("file:")
    path = F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), f"^{clean}/", "")
    rows = raw.select(path.alias("path"), F.decode("content", "UTF-8").alias("text"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("hash"))
    for prefix in excluded or []:
        rows = rows.where(~F.startswith(F.split("path", "/")[0], F.lit(prefix)))
    return rows


def entry_lines(df: DataFrame, key: str, body: str) -> DataFrame:
    """(key, line, entry): bullet, numbered and plain lines outside frontmatter, fenced code, headings and rules.

    Whether a line is in a fence follows from the number of fence lines before it, a fold over the lines of the one text.
    """
    plain = F.regexp_replace(F.regexp_replace(F.col(body), r"^---[ \t]*\r?\n[\s\S]*?\r?\n(?:---|\.\.\.)[ \t]*(?:\r?\n|$)", ""), r"(?m)^[ \t]*```[\s\S]*?(?:^[ \t]*```[ \t]*$|\z)", "")
    lines = df.where(F.col(body).isNotNull()).select(key, F.posexplode(F.split(plain, r"\r?\n")).alias("line", "raw"))
    entry = F.trim(F.regexp_replace("raw", r"^[ \t]*(?:[-*+]|[0-9]+[.)])[ \t]+", ""))
    return lines.where(~F.col("raw").rlike(r"^[ \t]*(#{1,6} |[-*_]{3,}[ \t]*$|\|)") & (F.trim("raw") != "")).select(key, "line", entry.alias("entry"))


_TURN = T.StructType([T.StructField(n, T.StringType()) for n in ("user", "assistant", "label")])
_SESSION = T.StructType([T.StructField("observed_at", T.StringType()), T.StructField("turns", T.ArrayType(_TURN))])
CASE = T.StructType([
    T.StructField("schema_version", T.IntegerType()), T.StructField("case_id", T.StringType()), T.StructField("persona", T.StringType()), T.StructField("category", T.StringType()), T.StructField("sessions", T.ArrayType(_SESSION)),
    T.StructField("query", T.StructType([T.StructField("text", T.StringType()), T.StructField("at", T.StringType()), T.StructField("agent", T.StringType()), T.StructField("strategy", T.StringType())])),
    T.StructField("expected", T.StructType([T.StructField(n, T.ArrayType(T.StringType())) for n in ("supporting_memory_labels", "stale_memory_labels", "answer_contains", "answer_must_not_contain")])),
])
# The kinds of evaluation cases.
CATEGORIES = "dynamic_update static_false_contradiction conditional_fact stable_long_time historical_query unresolved_conflict duplicate_paraphrase distractor_entity immediate_next_turn vault_vs_conversation visibility_scope runtime_isolation".split()


def cases(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected): evaluation cases of a JSON-lines file or one JSON array; rejected ones carry the first reason.

    A turn without a label is called by its place. Cases that share a case_id are rejected, all of them.
    """
    rows = spark.read.schema(CASE).option("multiLine", not path.endswith(".jsonl")).json(path)
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    time = lambda c: text.iso_time(c).isNull()
    named = lambda s, i: s.withField("turns", F.transform(s["turns"], lambda t, j: t.withField("label", F.when(blank(t["label"]), F.concat(F.lit("session-"), i.cast("string"), F.lit("-turn-"), j.cast("string"))).otherwise(t["label"]))))
    rows = rows.withColumn("sessions", F.transform("sessions", named))
    labels = F.flatten(F.transform("sessions", lambda s: F.transform(s["turns"], lambda t: t["label"])))
    empty = F.exists("sessions", lambda s: s["turns"].isNull() | (F.size(s["turns"]) < 1))
    supporting = F.col("expected.supporting_memory_labels")
    reason = (
        F.when(F.coalesce("schema_version", F.lit(0)) != 1, "schema_version").when(blank(F.col("case_id")), "case_id").when(~F.coalesce(F.col("category").isin(*CATEGORIES), F.lit(False)), "category").when(blank(F.col("persona")), "persona")
        .when(F.col("sessions").isNull() | (F.size("sessions") < 1), "sessions").when(F.exists("sessions", lambda s: time(s["observed_at"])), "observed_at").when(empty, "turns").when(F.exists("sessions", lambda s: F.exists(s["turns"], lambda t: blank(t["user"]))), "user")
        .when(F.size(labels) != F.size(F.array_distinct(labels)), "labels").when(blank(F.col("query.text")) | time(F.col("query.at")), "query").when(supporting.isNull() | (F.size(supporting) < 1), "expected").when(F.size(F.array_except(supporting, labels)) > 0, "unknown labels")
    )
    twice = rows.groupBy("case_id").agg(F.count("*").alias("_n")).where("_n > 1")
    rows = rows.withColumn("reason", reason).join(twice, "case_id", "left").withColumn("reason", F.coalesce("reason", F.when(F.col("_n") > 1, "case_id"))).drop("_n")
    return rows.where("reason IS NULL").drop("reason"), rows.where("reason IS NOT NULL")


def canonical_digest(value: object) -> str:
    """SHA-256 of a value as JSON with sorted keys: equal for equal values however they are written."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False, default=str).encode()).hexdigest()


def stable_report(value: object, drop: tuple[str, ...] = ("elapsed_ms", "started_at", "finished_at"), mask: tuple[str, ...] = ("run_id",)) -> object:
    """A report that is the same at every run: without times, and with ids of the run masked."""
    if isinstance(value, dict):
        return {k: "*" if k in mask else stable_report(v, drop, mask) for k, v in sorted(value.items()) if k not in drop}
    return [stable_report(v, drop, mask) for v in value] if isinstance(value, (list, tuple)) else value


def safe_cell(c):
    """A cell that a spreadsheet doesn't take for a formula."""
    return F.when(c.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), c)).otherwise(c)


def write_report(df: DataFrame, path: str, form: str = "csv") -> None:
    """A CSV report with safe cells, or one of JSON lines, and beside it a manifest with its form, columns, number of rows and a digest of its content."""
    if form not in ("csv", "json"):
        raise ValueError("a report is csv or json")
    out = df.select(*[safe_cell(F.col(c).cast("string")).alias(c) for c in df.columns]) if form == "csv" else df
    writer = out.write.mode("errorifexists")
    writer.option("header", "true").csv(f"{path}/report") if form == "csv" else writer.json(f"{path}/report")
    manifest = out.agg(F.count("*").alias("n_rows"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).cast("string").alias("digest"))
    manifest.withColumns({"form": F.lit(form), "columns": F.lit(",".join(df.columns))}).write.mode("errorifexists").json(f"{path}/manifest")


def write_log(df: DataFrame, path: str) -> None:
    """Appends rows as JSON lines (shadow logs, audit, telemetry, diaries)."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("append").text(path)


def backup(df: DataFrame, path: str) -> tuple[int, str]:
    """Writes a table to a new place and returns number of rows and checksum; an existing place is an error."""
    df.write.mode("errorifexists").parquet(path)
    return checksum(df.sparkSession.read.parquet(path))


def checksum(df: DataFrame) -> tuple[int, str]:
    row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).cast("string").alias("c")).first()
    return row["n"], row["c"] or "0"


def restore(spark: SparkSession, path: str, expected: tuple[int, str]) -> DataFrame:
    df = spark.read.parquet(path)
    if checksum(df) != tuple(expected):
        raise ValueError("the backup isn't what was written")
    return df


def recovered(stores: list[DataFrame], key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows, conflicts): several stores in order of priority as one; keys with unlike rows in different stores are conflicts."""
    rows = None
    for i, s in enumerate(stores):
        part = s.withColumn("_store", F.lit(i))
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    cols = [c for c in rows.columns if c != "_store"]
    rows = rows.withColumn("_mark", F.xxhash64(*cols))
    conflicts = rows.groupBy(*key).agg(F.countDistinct("_mark").alias("n_unlike"), F.countDistinct("_store").alias("n_stores")).where("n_unlike > 1")
    best = rows.groupBy(*key).agg(F.min_by(F.struct(*cols), F.struct("_store", "_mark")).alias("_row")).select("_row.*")
    return best, conflicts
