"""Encoding of a corpus with a public byte-level BPE tokenizer, in Spark expressions.

The texts are split into words by the tokenizer's pattern. A word is a sequence of byte pieces; ``fold`` merges, again and
again, the adjacent pair with the lowest rank, looking ranks up in a literal map. The map is an array of small maps, by
hash, as a literal map alone is searched from end to end.

Words repeat, so the distinct words of the corpus are counted over all texts, and the commonest of them, at most ``LEXICON``, are folded once
into a second literal map of word to ids: its size is bounded by that number, whatever the corpus. The words that are in
neither the rank map nor the lexicon are folded where they stand, so nothing depends on the bound but the speed.
"""

from __future__ import annotations

import base64
import heapq
import json
import os
import zlib
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Folder of the public tokenizers' files.
TOKENIZERS = os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers")
NAME = "byte_bpe_50k"
#: Most distinct words that are carried to every task.
LEXICON = 32_768
#: Texts with a word (also a run of blanks is one) of so many signs are folded with a heap, in Python: the expression takes quadratic time.
LONG = 64
_BUCKETS = 1 << 14
# The pattern of the tokenizer in the syntax of Java, where \s and \S are spelled out, as Java's know ASCII only.
_S = r"\t\n\x0B\f\r\x{85}\p{Z}"
_BLANKS = "\t\n\x0b\x0c\r\x85 \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_S}\p{{L}}\p{{N}}]+|[{_S}]+(?![^{_S}])|[{_S}]+"


def read_ranks(folder: str = TOKENIZERS, name: str = NAME) -> dict[bytes, int]:
    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, f)}


ranks = cache(read_ranks)  # on the driver


def _literal(pairs: list[tuple[str, object]], kind: str, buckets: int) -> Column:
    """A foldable array of maps by hash."""
    out: list[dict] = [{} for _ in range(buckets)]
    for k, v in pairs:
        out[zlib.crc32(k.encode()) % buckets][k] = v
    return F.from_json(F.lit(json.dumps(out, ensure_ascii=False, separators=(",", ":"))), f"array<map<string,{kind}>>")


def _find(literal: Column, key: Column, buckets: int) -> Column:
    at = F.pmod(F.crc32(F.encode(key, "UTF-8")), F.lit(buckets)).cast("int")
    return F.try_element_at(F.get(literal, at), key)


def words(text: Column) -> Column:
    """The words of a text, in order; together they are the text. Null gives none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PATTERN), F.lit(0))


def _let(value: Column, body) -> Column:
    """body(value), with the value named once, so a large literal stands in the plan once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fold(word: Column, rank: Column) -> Column:
    """Token ids of one word: its bytes as pieces (a character a byte), merged by rank until no adjacent pair has one."""
    latin = F.decode(F.encode(word, "UTF-8"), "ISO-8859-1")
    pieces = F.transform(F.sequence(F.lit(1), F.length(latin)), lambda i: F.substring(latin, i, F.lit(1)))
    state = lambda p, done: F.struct(p.alias("p"), F.lit(done).alias("done"))

    def merge(state_: Column, _: Column) -> Column:
        p = state_["p"]
        found = F.transform(F.slice(p, F.lit(1), F.size(p) - 1), lambda x, i: _find(rank, F.concat(x, F.get(p, i + 1)), _BUCKETS))
        joined = lambda at: F.concat(F.slice(p, F.lit(1), at - 1), F.array(F.concat(F.get(p, at - 1), F.get(p, at))), F.slice(p, at + 2, F.greatest(F.size(p) - at - 1, F.lit(0))))
        step = _let(found, lambda f: _let(F.array_min(f), lambda r: F.when(r.isNull(), state(p, True)).otherwise(_let(F.array_position(f, r).cast("int"), lambda at: state(joined(at), False)))))
        return F.when(state_["done"] | (F.size(p) < 2), state(p, True)).otherwise(step)

    merged = F.aggregate(F.sequence(F.lit(1), F.length(latin)), state(pieces, False), merge, lambda s: s["p"])
    return F.transform(merged, lambda x: _find(rank, x, _BUCKETS))


def _runs(text: Column) -> Column:
    """Whether a text has a word of ``LONG`` signs or more. Only texts that may have one are read into words for that.

    Pieces between blanks bound the words without blanks; many blank pieces may be one long run of mixed blanks.
    """
    pieces = F.split(text, " ")
    may = F.contains(text, F.lit(" " * LONG)) | _let(pieces, lambda p: F.exists(p, lambda w: F.length(w) >= LONG) | (F.size(F.filter(p, lambda w: F.btrim(w, F.lit(_BLANKS)) == "")) >= LONG // 2))
    return may & F.exists(words(text), lambda w: F.length(w) >= LONG)


def _rank_literal(folder: str, name: str) -> Column:
    return _literal([(k.decode("latin-1"), v) for k, v in ranks(folder, name).items()], "int", _BUCKETS)


def fold_long(word: bytes, table: dict[bytes, int]) -> list[int]:
    """The same as ``fold`` for one word, in n log n time."""
    n = len(word)
    after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := table.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    live = [True] * n
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i] if live[i] else n
        if j >= n or end[j] != stop:
            continue
        live[j], end[i], after[i] = False, stop, after[j]
        if after[j] < n:
            before[after[j]] = i
            if (r := table.get(word[i : end[after[j]]])) is not None:
                heapq.heappush(heap, (r, i, end[after[j]]))
        if before[i] >= 0 and (r := table.get(word[before[i] : stop])) is not None:
            heapq.heappush(heap, (r, before[i], stop))
    return [table[word[i : end[i]]] for i in range(n) if live[i]]


def lexicon(texts: DataFrame, text: str, limit: int = LEXICON, folder: str = TOKENIZERS, name: str = NAME) -> list[tuple[str, list[int]]]:
    """The up to ``limit`` words that most texts have, with their ids; counted over all texts, the distinct words folded once."""
    each = texts.select(F.explode(F.array_distinct(words(F.col(text)))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    top = each.where(F.length("w") <= LONG).orderBy(F.desc("n"), "w").limit(limit)
    spread = top.repartition(max(1, texts.sparkSession.sparkContext.defaultParallelism))
    return [(r["w"], r["ids"]) for r in spread.select("w", _let(_rank_literal(folder, name), lambda rank: fold(F.col("w"), rank)).alias("ids")).collect()]


def encoded(df: DataFrame, key: str, text: str, limit: int = LEXICON, folder: str = TOKENIZERS, name: str = NAME) -> DataFrame:
    """(key, ids): the token ids of each text, without special tokens; an empty list for null and empty texts.

    Rows are encoded one by one, so repeats and null keys stay. Other columns are ignored; an empty table gives an
    empty result.
    """
    spark = df.sparkSession
    if spark.conf.get("spark.sql.maxPlanStringLength").startswith("2147483"):  # the default, no bound; the driver keeps printed plans, and these hold the literals
        spark.conf.set("spark.sql.maxPlanStringLength", "100000")
    rows = df.select(F.col(key).alias("key"), F.coalesce(text, F.lit("")).alias("text"))
    short, long = rows.where(~_runs(F.col("text"))), rows.where(_runs(F.col("text")))
    known = _literal(lexicon(rows, "text", limit, folder, name), "array<int>", _BUCKETS)
    both = F.struct(known.alias("known"), _rank_literal(folder, name).alias("rank"))
    ids = _let(both, lambda d: F.flatten(F.transform(words(F.col("text")), lambda w: F.coalesce(_find(d["known"], w, _BUCKETS), fold(w, d["rank"])))))

    shipped = spark.sparkContext.broadcast(ranks(folder, name))  # of the vocabulary's size, whatever the texts'

    @F.pandas_udf("array<int>")
    def heaped(lists: pd.Series) -> pd.Series:
        table, seen = shipped.value, {}
        out = []
        for ws in lists:
            for w in ws:
                if w not in seen:
                    if len(seen) > 100_000:
                        seen.clear()
                    seen[w] = fold_long(w.encode(), table)
            out.append([i for w in ws for i in seen[w]])
        return pd.Series(out)

    done = short.select("key", ids.alias("ids")).unionByName(long.select("key", heaped(words(F.col("text"))).alias("ids")))
    return done.select(F.col("key").alias(key), "ids")


def decoded(df: DataFrame, ids: str, folder: str = TOKENIZERS, name: str = NAME) -> DataFrame:
    """The rows with a column ``text``: the bytes of the ids' pieces joined and read as UTF-8. Null ids give a null text."""
    table = sorted((v, k) for k, v in ranks(folder, name).items())
    pieces = F.from_json(F.lit(json.dumps([k.hex() for _, k in table])), "array<string>")
    return df.withColumn("text", F.decode(F.unhex(F.array_join(F.transform(F.col(ids), lambda i: F.get(pieces, i)), "")), "UTF-8"))


def token_counts(df: DataFrame, key: str, text: str, **options) -> DataFrame:
    """(key, n): how many tokens each text has."""
    return encoded(df, key, text, **options).select(key, F.size("ids").alias("n"))
