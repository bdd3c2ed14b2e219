"""Owner, visibility, path and lock conditions; they go before ranking and limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidenza.functions.scoring import VISIBILITY, lookup


def visible(visibility: Column, ceiling: Column) -> Column:
    """Up to the ceiling; a null visibility is private, an unknown ceiling allows all."""
    return lookup(VISIBILITY, F.coalesce(visibility, F.lit("private")), 0) <= lookup(VISIBILITY, ceiling, 2)


def _path(c: Column) -> Column:
    return F.btrim(F.replace(c, F.lit("\\"), F.lit("/")), F.lit("/"))


def in_paths(path: Column, prefixes: list[str] | None) -> Column:
    """Exactly a prefix or below it, by whole segments, case and all; None is no restriction, an empty list allows nothing, a null path is in none."""
    if prefixes is None:
        return F.lit(True)
    out = F.lit(False)
    for p in prefixes:
        p = p.replace("\\", "/").strip("/")
        out = out | (_path(path) == p) | F.startswith(_path(path), F.lit(p + "/"))
    return F.coalesce(out, F.lit(False))


def document_allowed(source: Column, kind: Column, path: Column, prefixes: list[str] | None) -> Column:
    """The path restriction of documents; memories that are none are never restricted by path."""
    if prefixes is None:
        return F.lit(True)
    return ~F.coalesce((source == "vault") | (kind == "document"), F.lit(False)) | in_paths(path, prefixes)


def effective_paths(asked: list[str] | None, allowed: list[str] | None) -> list[str] | None:
    """Both restrictions at once: the narrower prefix of each compatible pair; none in common allows nothing.

    A restriction without prefixes, None or empty, doesn't bind the other; without any of either there is none.
    """
    if not asked or not allowed:
        return (asked or allowed) or None
    plain = lambda xs: [x.replace("\\", "/").strip("/") for x in xs]
    below = lambda a, b: a == b or a.startswith(b + "/")
    return sorted({a if below(a, b) else b for a in plain(asked) for b in plain(allowed) if below(a, b) or below(b, a)})


def masked(content: Column, locked: Column, owner: Column, viewer: Column, mask: str = "[locked]") -> Column:
    return F.when(locked & ~owner.eqNullSafe(viewer), F.lit(mask)).otherwise(content)


def authorized(candidates: DataFrame, stored: DataFrame, agent: str, ceiling: str, statuses: tuple[str, ...] = ("active",)) -> DataFrame:
    """Candidates (id) as they are stored, of those the agent owns or may see; unknown ids drop out."""
    own = F.col("agent") == agent
    seen = visible(F.col("visibility"), F.lit(ceiling)) & (F.col("visibility") != "private")
    return candidates.join(stored.where(F.col("status").isin(*statuses) & (own | seen)), "id")
