"""Documents: passages, frontmatter, and the difference of two snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE, OVERLAP = 1200, 150


def passages(df: DataFrame, key: str, body: str, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(key, section, window, heading, start, length): passages of a text, by headings.

    A text of at most ``size`` signs, without outer blanks, is one passage without heading. A longer one has a section from each
    heading of one to six signs on, whose heading is the path of headings above it; a section longer than ``size`` is cut into windows that
    overlap, at the last line end of their last quarter if there is one. Offsets count from 0 in the text without outer
    blanks. Null and blank texts have no passage.
    """
    step = max(0, min(overlap, size // 2))
    rows = df.select(key, F.regexp_replace(F.col(body), r"^\s+|\s+$", "").alias("t")).where(F.length("t") > 0)
    cut = F.when(F.length("t") <= size, F.array("t")).otherwise(F.split("t", r"(?md)(?=^[ \t]*#{1,6}[ \t]+\S)"))
    rows = rows.select(key, F.length("t").alias("all"), cut.alias("s"))
    starts = F.aggregate("s", F.array(F.lit(0)), lambda a, s: F.concat(a, F.array(F.element_at(a, -1) + F.length(s))))
    level = lambda s: F.length(F.regexp_extract(s, r"^[ \t]*(#{1,6})[ \t]+\S", 1))
    title = lambda s: F.trim(F.regexp_extract(s, r"^[ \t]*#{1,6}[ \t]+([^\r\n]*)", 1))
    none = F.array().cast("array<string>")
    path = lambda p, s: F.when(level(s) > 0, F.concat(F.slice(p, F.lit(1), level(s) - 1), F.array(title(s)))).otherwise(p)
    paths = F.aggregate("s", F.struct(none.alias("p"), none.alias("out")), lambda a, s: F.struct(path(a["p"], s).alias("p"), F.concat(a["out"], F.array(F.array_join(path(a["p"], s), " > "))).alias("out")), lambda a: a["out"])
    rows = rows.select(key, "all", F.posexplode(F.arrays_zip("s", F.slice(starts, 1, F.size("s")).alias("o"), paths.alias("p"))).alias("section", "x"))
    rows = rows.select(key, "section", F.col("x.s").alias("s"), F.col("x.o").alias("o"), F.when(F.col("all") > size, F.col("x.p")).otherwise("").alias("heading"))

    def window(a, _):
        full = F.least(F.length("s"), a["start"] + size)
        quarter = a["start"] + size * 3 // 4
        last = F.instr(F.reverse(F.substring(F.col("s"), quarter + 1, full - quarter)), "\n")
        end = F.when((full < F.length("s")) & (last > 0), full - last).otherwise(full)
        more = F.struct(F.greatest(end - step, a["start"] + 1).alias("start"), (end >= F.length("s")).alias("done"), F.concat(a["out"], F.array(F.struct(a["start"].alias("at"), end.alias("to")))).alias("out"))
        return F.when(a["done"], a).otherwise(more)

    most = F.ceil(F.length("s") / max(1, size * 3 // 4 - step)).cast("int") + 1
    first = F.struct(F.lit(0).alias("start"), F.lit(False).alias("done"), F.array().cast("array<struct<at:int,to:int>>").alias("out"))
    rows = rows.select(key, "section", "heading", "o", "s", F.posexplode(F.aggregate(F.sequence(F.lit(1), most), first, window, lambda a: a["out"])).alias("window", "w"))
    rows = rows.where(F.regexp_replace(F.substring(F.col("s"), F.col("w.at") + 1, F.col("w.to") - F.col("w.at")), r"\s", "") != "")
    return rows.select(key, "section", "window", "heading", (F.col("o") + F.col("w.at")).alias("start"), (F.col("w.to") - F.col("w.at")).alias("length"))


def snapshot_diff(old: DataFrame, new: DataFrame, key: list[str], digest: str) -> DataFrame:
    """(key, change): new, changed, unchanged or deleted between two snapshots."""
    o = old.select(*key, F.col(digest).alias("was")).dropDuplicates(key)
    n = new.select(*key, F.col(digest).alias("is")).dropDuplicates(key)
    rows = o.withColumn("_o", F.lit(1)).join(n.withColumn("_n", F.lit(1)), key, "full")
    return rows.select(*key, F.when(F.col("_o").isNull(), "new").when(F.col("_n").isNull(), "deleted").when(F.col("was").eqNullSafe(F.col("is")), "unchanged").otherwise("changed").alias("change"))
