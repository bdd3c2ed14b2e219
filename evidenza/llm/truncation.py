"""Text cut off by field limits: significant lengths by discrete hazards, and incomplete endings by what words end texts.

For each source, the hazard of a length is the share of texts that end there among those that reach it. A field limit
makes one length's hazard stand out against its neighbours'; each length is tested against the pooled hazard around it,
with the false discovery rate held over all tests. Copies of a text in a source count once in this.
A text is then judged by its ending. At a significant length any ending without a proper close counts as cut. Elsewhere, for
texts that were lost at a length of their own, the last words decide: how often a line of that sort ends in the last word, or behind
the two words before it, against how often a cut at any sign would leave the same last word. How many open endings are
complete is estimated from those that don't stand at a significant length. A word the corpus doesn't know otherwise was cut itself.
Only distinct texts are evidence, and none whose tail is the text's own.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidenza.runtime import broadcast_if_small, cut

#: Lengths on each side whose pooled hazard is the expectation, false discovery rate, and least number of texts.
AROUND, RATE, LEAST = 40, 0.01, 4
#: How likely a complete ending must be; how often a word must be seen elsewhere than as a text's last to be known, or as the
#: last of other texts beyond what cuts of longer words would give.
CLOSE, KNOWN = 0.5, 3
#: How much likelier a line must end at a place than anywhere, for words that are seen there as last ones only.
USUAL = 10
#: Longest piece of a word, in signs, that is compared with the beginnings of other words.
PIECE = 40
#: Texts whose last characters are the same, but for digits, case and blanks, are no evidence for one another.
TAIL = 60
_HELD = 1_500_000

_LIST = re.compile(r"\s*(?:[-*+•]|\d+[.)]|#{1,6}|>)\s")
_TOKEN = re.compile(r"#?[^\W_]+(?:['’-][^\W_]+)*|[^\w\s]|_+")
_MARK = re.compile(r"(?:\s*(?:…|\.{3,}|\[\s*(?:…|\.{3})\s*\]|\(\s*(?:…|\.{3})\s*\)|\ufffd+))+$")
_MARKS = ("…", "...", "]", ")", "\ufffd")  # what a mark of omission ends with
_BLANK = " \t\r\n\x0b\x0c\x85\xa0           ​‌‍    ⁠　﻿"
_TERMS_SET = frozenset(".!?。！？")
_TERMS, _STOPS, _CLOSERS = ".!?。！？", ".!?。！？…", "\"'”’»)]}*_`"


def _closer(t: str) -> bool:
    """Closing signs, and pictures, which may stand behind a complete ending."""
    return t in _CLOSERS or len(t) == 1 and (t > "\x7f" or t == "^") and t != "\ufffd" and unicodedata.category(t) in ("So", "Sk", "Mn", "Cf")


def _norm(t: str) -> tuple[str, str]:
    """A token as a last word, and as a word before one."""
    if t[0] == "#" and len(t) > 1:
        return _norm(t[1:])[0], "#a"
    if any(c.isdigit() for c in t):
        n = re.sub(r"\d+", "0", t.lower())
        return n, n
    return t.lower(), "A" if t[:1].isupper() and not t.isupper() else t.lower()


def _ending(line: str) -> tuple[list[str], bool]:
    """The tokens of a line without closing signs, and whether it ends with a stop."""
    toks = _TOKEN.findall(line)
    while toks and _closer(toks[-1]):
        toks.pop()
    stop = bool(toks) and toks[-1] in _TERMS
    while toks and (toks[-1] in _TERMS or _closer(toks[-1])):
        toks.pop()
    return toks, stop


def _place(toks: list[str]) -> tuple[int, bool]:
    """The number of tokens before the closing signs and stops of a line, and whether there is a stop."""
    k = len(toks)
    while k and _closer(toks[k - 1]):
        k -= 1
    stop = bool(k) and toks[k - 1] in _STOPS
    while k and (toks[k - 1] in _STOPS or _closer(toks[k - 1])):
        k -= 1
    return k, stop


_ENDS = "same string, chars int, bytes int, kind string, last string, ctx string, tail string, end string, own int"
_COUNTS = "sort string, key string, ends bigint, total bigint"


def _ended(text: str) -> tuple:
    """What a text ends with: kind is closed, cut (for certain), or list, prose, ellipsis (to be judged by its words), link. end is equal for texts with the same
    last characters; own is 1 if ``_Tally`` takes the text's own last words as an ending of its kind."""
    body = text.rstrip(_BLANK)
    mark = _MARK.search(body) if body.endswith(_MARKS) else None
    bare = body[: mark.start()].rstrip(_BLANK) if mark else body
    line = bare[bare.rfind("\n") + 1 :]
    toks, stop = _ending(line)
    fences = sum(1 for x in bare.split("\n") if x.lstrip().startswith("```")) if "```" in bare else 0
    if "\ufffd" in body[len(bare) :]:
        kind = "cut"
    elif line.lstrip().startswith("```"):
        kind = "closed" if fences % 2 == 0 else "cut"
    elif fences % 2:
        kind = "cut"
    elif line.lstrip().startswith("|"):
        kind = "closed" if line.endswith("|") and line.count("|") > 1 else "cut"
    elif stop and not mark:
        kind = "closed"
    elif not toks or _closer(bare[-1]) and bare[-1] not in _CLOSERS:
        kind = "closed"  # also a picture, as behind a chat reply
    elif re.search(r"\]\]$|\)$", line) and not mark:
        kind = "closed"
    elif bare[-1] in ",;:-–—([{«“\"" and not re.search(r"^\W*[—–-].*[—–-]$", line) and bare[-1] != '"':
        kind = "cut"
    elif re.search(r"\S+://\S*$", line):
        kind = "link"
    else:
        kind = "ellipsis" if mark else "list" if _LIST.match(line) else "prose"
    size = len(text), len(text) if text.isascii() else len(text.encode("utf-8", "surrogatepass"))
    if kind in ("closed", "cut"):  # judged without their words
        return *size, kind, "", "", "", "", 0
    n = [_norm(t) for t in toks[-3:]]
    ctx = [("", "^"), ("", "^"), *n]
    last = n[-1][0] if n else ""
    tail = re.sub(r"[^\W\d_]+", "a", re.sub(r"\d+", "#", line.split(" ")[-1])) if kind == "link" else ""
    end = re.sub(r"\d+", "0", " ".join(body[-4 * TAIL :].lower().split()))[-TAIL:]
    whole = _TOKEN.findall(body[bare.rfind("\n") + 1 :].split("\n", 1)[0])
    k, stopped = _place(whole)
    own = k == len(toks) and (kind == "list" or not stopped or kind == "ellipsis" and k < len(whole) and whole[k] == "…")
    return *size, kind, last, f"{ctx[-3][1]} {ctx[-2][1]} _" if n else "", tail, blake2b(end.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest(), int(own)


class _Forms(dict):
    """Tokens in one of their two forms, as last words or as words before one."""

    def __init__(self, which: int):
        super().__init__()
        self.which = which

    def __missing__(self, t: str) -> str:
        if len(self) > 500_000:
            self.clear()
        self[t] = form = _norm(t)[self.which]
        return form


class _Tally:
    """Counts of last words (0) and of contexts (1), by sort of line: p prose without a stop, l lists and headings, e any; f: last words of texts."""

    def __init__(self):
        self.last, self.before = _Forms(0), _Forms(1)
        self.total = {s: (Counter(), Counter()) for s in "lpf"}
        self.ends = {s: (Counter(), Counter()) for s in "lpe"}

    def add(self, text: str) -> None:
        lines = text.rstrip(_BLANK).split("\n")
        fenced, code = "```" in text, False
        # what the whole text adds: words and contexts, and those at ends, by sort
        said = {s: ([], []) for s in "lp"}
        ended = {s: ([], []) for s in "lpe"}
        any_words, any_places = ended["e"]
        word, form = self.last.__getitem__, self.before.__getitem__
        for at, line in enumerate(lines, 1):
            if fenced and line.lstrip().startswith("```"):
                code = not code
                continue
            toks = _TOKEN.findall(line) if not code else None
            if not toks:
                continue
            sort = "l" if _LIST.match(line) else "p"
            last, before = list(map(word, toks)), ["", "^", *map(form, toks)]
            ctx = list(map(" ".join, zip(before, before[1:-1])))  # of token i: the two before it
            words, places = said[sort]
            words += last
            places += ctx
            k, stop = _place(toks)
            if k:
                own, place = last[k - 1], ctx[k - 1]
                if not stop or k < len(toks) and toks[k] == "…":
                    any_words.append(own)
                    any_places.append(place)
                if sort == "l" or not stop:
                    ended[sort][0].append(own)
                    ended[sort][1].append(place)
                if at == len(lines):
                    self.total["f"][0][own] += 1
            if not _TERMS_SET.isdisjoint(toks):
                stops = [i for i, t in enumerate(toks) if i and t in _TERMS_SET]
                # of stops behind one another the last one counts
                stops = [i - 1 for i, after in zip(stops, [*stops[1:], -1]) if after != i + 1]
                any_words += [last[i] for i in stops]
                any_places += [ctx[i] for i in stops]
        for counted, found in ((self.total, said), (self.ends, ended)):
            for sort, lists in found.items():
                for counter, keys in zip(counted[sort], lists):
                    if keys:
                        counter.update(keys)

    def held(self) -> int:
        return sum(len(c) for pair in self.total.values() for c in pair)

    def drained(self) -> Iterator[tuple]:
        """(sort, key, ends, total), a context's key ending with " _"; what was counted is let go."""
        for sort in "lpfe":
            for which, suffix in enumerate(("", " _")):
                total, ends = (x[sort][which] if sort in x else {} for x in (self.total, self.ends))
                for key in total if sort != "e" else ends:
                    yield sort, key + suffix, ends.get(key, 0), total.get(key, 0)
        for pair in (*self.total.values(), *self.ends.values()):
            for c in pair:
                c.clear()


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One pass over distinct texts (same, text): a row for how each ends, and rows of partial counts."""
    arrow = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}
    ended, counted = (pa.struct([(n, arrow[t]) for n, t in (x.split() for x in spec.split(", "))]) for spec in (_ENDS, _COUNTS))
    tally = _Tally()

    def out(rows: list[tuple], kind: pa.StructType) -> pa.RecordBatch:
        made = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kind)], fields=list(kind))
        both = [made, pa.nulls(len(rows), counted)] if kind is ended else [pa.nulls(len(rows), ended), made]
        return pa.RecordBatch.from_arrays(both, names=["ended", "counted"])

    def drained() -> Iterator[pa.RecordBatch]:
        rows = list(tally.drained())
        for at in range(0, len(rows), 50_000):
            yield out(rows[at : at + 50_000], counted)

    for batch in batches:
        rows = []
        for same, text in zip(batch.column("same").to_pylist(), batch.column("text").to_pylist()):
            rows.append((same, *_ended(text)))
            tally.add(text)
        if rows:
            yield out(rows, ended)
        if tally.held() > _HELD:
            yield from drained()
    yield from drained()


def significant_lengths(lengths: DataFrame, around: int = AROUND, rate: float = RATE, least: int = LEAST) -> DataFrame:
    """(source, unit, length, n, hazard, expected): lengths at which texts of a source end far more often than beside it.

    ``lengths`` has a row (source, unit, length, open) a text; only texts with an open ending count as ending, all as being
    at risk. The hazards come from windows over the distinct lengths of a
    source, so their work follows the number of lengths, not of texts. The p-value is the Poisson tail of the number of
    endings given the pooled hazard of the neighbours (half an ending more than seen); Benjamini and Hochberg's step-up holds the rate over all
    lengths of all sources.
    """
    n = lengths.groupBy("source", "unit", "length").agg(F.count_if("open").alias("n"), F.count("*").alias("all"))
    own = Window.partitionBy("source", "unit").orderBy("length")
    n = n.withColumn("risk", F.sum("all").over(own.rowsBetween(0, Window.unboundedFollowing)))
    near = own.rangeBetween(-around, around)
    # exposure around: each of the lengths between is survived by those at risk; at distinct lengths only, which is a lower bound
    n = n.withColumn("ended", F.sum("n").over(near) - F.col("n")).withColumn("first_risk", F.max("risk").over(near)).withColumn("last_risk", F.min("risk").over(near))
    n = n.withColumn("rate", (F.col("ended") + 0.5) / ((F.col("first_risk") + F.col("last_risk")) / 2 * (2 * around)))
    n = n.withColumn("expected", F.col("rate") * F.col("risk"))
    m, k = F.col("expected"), F.col("n")
    # log of the Poisson tail from n on, by its first term and the geometric bound of the rest
    first = k * F.log(m) - m - F.expr("aggregate(sequence(1, int(least(n, 200))), 0d, (s, i) -> s + ln(i))") - F.when(k > 200, (k - 200) * (F.log(k) - 1) + 200 - 200 * F.log(F.lit(200.0)) + 200 * F.log(F.lit(200.0)) - 200).otherwise(0.0)
    n = n.withColumn("logp", F.when(k <= m, 0.0).otherwise(first - F.log(1 - m / (k + 1))))
    tests = n.where(k >= 1)
    # a rejected length needs at least `least` texts, so few distinct p-values matter: rank over those, count over all
    total = tests.agg(F.count("*").alias("tests"))
    small = tests.where((F.col("logp") < -3) & (k >= least))
    # the rank over all p-values, from the rank within ranges of them and the sizes of the ranges before
    spread = cut(small.repartitionByRange("logp").withColumn("part", F.spark_partition_id()))
    parts = spread.groupBy("part").agg(F.count("*").alias("held"))
    before = parts.alias("x").join(parts.alias("y"), F.col("y.part") < F.col("x.part"), "left").groupBy(F.col("x.part").alias("part")).agg(F.coalesce(F.sum("y.held"), F.lit(0)).alias("skip"))
    ranked = spread.join(F.broadcast(before), "part").withColumn("r", F.col("skip") + F.row_number().over(Window.partitionBy("part").orderBy("logp")))
    ranked = ranked.join(F.broadcast(total)).withColumn("ok", F.col("logp") <= F.log(F.lit(rate) * F.col("r") / F.col("tests")))
    cut_at = ranked.agg(F.max(F.when(F.col("ok"), F.col("r"))).alias("up_to"))
    return ranked.join(F.broadcast(cut_at)).where(F.col("r") <= F.col("up_to")).select("source", "unit", "length", "n", (k / F.col("risk")).alias("hazard"), "expected")


def endings(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(key, source, length, limited, kind, p_close, truncated) of each text that isn't null, empty or blank.

    ``limited`` says that the text ends at a significant length of its source, in characters or bytes. Null sources
    are a source of their own. Texts are judged whole, each distinct text once; an empty table gives an empty result,
    other columns are ignored.
    """
    # the texts are read once for the pass over distinct ones, and once for the keys of all
    rows = df.where(F.col(text).rlike(rf"[^{_BLANK}]")).select(F.col(key).cast("string").alias("key"), F.coalesce(source, F.lit("")).alias("source"), F.md5(text).alias("same"), F.col(text).alias("text"))
    read = cut(rows.groupBy("same").agg(F.first("text").alias("text")).mapInArrow(_read, f"ended struct<{_ENDS.replace(' ', ':').replace(',:', ',')}>, counted struct<{_COUNTS.replace(' ', ':').replace(',:', ',')}>"))
    counts = cut(read.where(F.col("counted").isNotNull()).groupBy("counted.sort", "counted.key").agg(F.sum("counted.ends").alias("ends"), F.sum("counted.total").alias("total")))
    texts = read.where(F.col("ended").isNotNull()).select("ended.*")
    keyed = cut(rows.select("key", "source", "same"))
    each = cut(keyed.select("source", "same").distinct().join(texts, "same"))
    judged = _decided(each, counts)
    out = keyed.join(judged, ["source", "same"])
    return out.select(F.col("key").alias(key), "source", F.col("chars").alias("length"), "limited", "kind", "p_close", "truncated")


def _complete(lr: DataFrame) -> dict[str, float]:
    """The share of complete texts among open endings of each sort, that makes their likelihood ratios likeliest (EM on a histogram of at most 3 x 241 bins)."""
    bins = lr.select("sort", F.round(F.greatest(F.lit(-12.0), F.least(F.lit(12.0), F.col("lr"))), 1).alias("b"), "n").groupBy("sort", "b").agg(F.sum("n").alias("n")).collect()
    out = {}
    for sort in "lpe":
        own = [(10.0 ** r["b"], r["n"]) for r in bins if r["sort"] == sort and r["n"]]
        share, total = 0.5, sum(n for _, n in own)
        for _ in range(200 if total else 0):
            # one text of either sort more than seen, so that no share becomes 0 or 1
            share = (1 + sum(n * share * r / (share * r + 1 - share) for r, n in own)) / (total + 2)
        out[sort] = share
    return out


def _decided(each: DataFrame, counts: DataFrame) -> DataFrame:
    """(source, same, chars, limited, kind, p_close, truncated) from each distinct text of each source and the counts of words."""
    sorts = {"list": "l", "prose": "p", "ellipsis": "e"}
    sort = F.create_map(*[F.lit(x) for kv in sorts.items() for x in kv])[F.col("kind")]
    zero = lambda c: F.coalesce(c, F.lit(0))

    lengths = each.select("source", F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("length")), F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("length")))).alias("x"), (F.col("kind") != "closed").alias("open")).select("source", "x.unit", "x.length", "open")
    limits = broadcast_if_small(cut(significant_lengths(lengths).groupBy("source").agg(F.collect_set(F.when(F.col("unit") == "chars", F.col("length"))).alias("c"), F.collect_set(F.when(F.col("unit") == "bytes", F.col("length"))).alias("b"))))
    limited = F.coalesce(F.array_contains("c", F.col("chars")) | F.array_contains("b", F.col("bytes")), F.lit(False))
    each = each.join(limits, "source", "left").withColumn("limited", limited).drop("c", "b")

    # sums over words and over contexts, by sort; signs are the places at which a cut leaves a piece of a word
    context = F.col("key").endswith(" _")
    base = {(r["sort"], r["context"]): r for r in counts.groupBy("sort", context.alias("context")).agg(F.sum("ends").alias("e"), F.sum("total").alias("t"), F.sum(F.col("total") * F.least(F.length("key"), F.lit(PIECE + 1))).alias("signs")).collect()}  # at most seven rows
    of = lambda s, c, x: base[s, c][x] if (s, c) in base else 0
    rate = {s: (of(s, True, "e") + 1) / ((of("l", True, "t") + of("p", True, "t") if s == "e" else of(s, True, "t")) + 10) for s in "lpe"}
    word_rate = {s: (of(s, False, "e") + 1) / ((of("l", False, "signs") + of("p", False, "signs") if s == "e" else of(s, False, "signs")) + 10) for s in "lpe"}
    by_sort = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])[F.col("sort")]
    words = of("l", False, "t") + of("p", False, "t")

    # texts with the same tail are judged as one, and m of them, mo as endings, are left out of the evidence
    alike = ["kind", "last", "ctx", "end"]
    texts = each.groupBy("same", *alike, "tail", "own").agg(F.min("limited").alias("limited"))
    needed = cut(texts.where(F.col("kind").isin(*sorts)).groupBy(*alike).agg(F.count("*").alias("m"), F.sum("own").alias("mo"), F.count_if(~F.col("limited")).alias("n")).withColumn("sort", sort))
    keys = broadcast_if_small(needed.select(F.explode(F.array("last", "ctx")).alias("key")).distinct())
    lasts = broadcast_if_small(needed.select(F.col("last").alias("key")).distinct())
    # endings of any sort are seen against all occurrences, in prose and lists
    seen = counts.join(keys, "key", "left_semi").groupBy("key").agg(F.sum(F.when(F.col("sort") != "f", F.col("total")).otherwise(0)).alias("e_total"), F.sum(F.when(F.col("sort") == "f", F.col("total")).otherwise(0)).alias("f_total"), *[F.sum(F.when(F.col("sort") == s, F.col("ends")).otherwise(0)).alias(f"{s}_ends") for s in "lpe"], *[F.sum(F.when(F.col("sort") == s, F.col("total")).otherwise(0)).alias(f"{s}_total") for s in "lp"])
    # longer words that a cut would leave as the last word
    longer = counts.where(F.col("sort").isin("l", "p") & ~context & (F.length("key") > 1)).select("sort", "total", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.length("key") - 1, F.lit(PIECE))), lambda i: F.substring("key", F.lit(1), i))).alias("key"))
    longer = longer.join(lasts, "key", "left_semi").groupBy("key").agg(F.sum("total").alias("e_more"), *[F.sum(F.when(F.col("sort") == s, F.col("total")).otherwise(0)).alias(f"{s}_more") for s in "lp"])
    seen, longer = broadcast_if_small(cut(seen)), broadcast_if_small(cut(longer))
    named = lambda df, c: df.select(F.col("key").alias(c), *[F.col(x).alias(f"{c}_{x}") for x in df.columns if x != "key"])
    pick = lambda c, n: F.when(F.col("sort") == "e", F.col(f"{c}_e_{n}")).when(F.col("sort") == "l", F.col(f"{c}_l_{n}")).otherwise(F.col(f"{c}_p_{n}"))
    q = needed.join(named(seen, "last"), "last", "left").join(named(seen, "ctx"), "ctx", "left").join(named(longer, "last"), "last", "left")
    less = lambda c, n, own: F.greatest(zero(pick(c, n)) - F.col(own), F.lit(0))
    share = lambda c, more, prior: (less(c, "ends", "mo") + prior * 2) / (less(c, "total", "m") + more + 2)
    odds = lambda p: F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6)) / (1 - F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6)))
    # how much likelier the words are at an end than at any place of the texts
    p1, p2 = share("last", zero(pick("last", "more")), by_sort(word_rate)), share("ctx", F.lit(0), by_sort(rate))
    lr = F.log10(odds(p1) * odds(p2) / odds(by_sort(word_rate)) / odds(by_sort(rate)))
    opened = needed.agg(F.coalesce(F.sum("m"), F.lit(0)).alias("m")).first()["m"]
    others = zero(F.col("last_f_total")) - F.col("m")
    # a word seen as a last one only is usual if more texts end in it than cuts of longer words leave, and at a place where lines end
    usual = (others >= KNOWN + 3 * zero(F.col("last_e_more")) * opened / max(1, words)) & (odds(p2) > USUAL * odds(by_sort(rate)))
    unknown = (zero(F.col("last_e_total")) - zero(F.col("last_f_total")) < KNOWN) & ~usual
    q = cut(q.select(*alike, "sort", "n", F.when(unknown, -12.0).otherwise(lr).alias("lr")))
    prior = {s: math.log10(p / (1 - p)) for s, p in _complete(q).items()}
    q = q.select(*alike, (1 / (1 + F.pow(F.lit(10.0), -F.col("lr") - by_sort(prior)))).alias("p_close"))

    tails = texts.where(F.col("kind") == "link").groupBy("tail").agg(F.count("*").alias("n"))
    most = tails.agg(F.sum("n").alias("links"))
    tails = broadcast_if_small(tails.join(F.broadcast(most)).where(F.col("n") >= 0.1 * F.col("links")).select("tail", F.lit(1.0).alias("usual")))
    out = each.join(q, alike, "left").join(tails, "tail", "left")
    p = F.when(F.col("kind") == "link", F.coalesce("usual", F.lit(0.0))).when(F.col("kind") == "closed", 1.0).when(F.col("kind") == "cut", 0.0).otherwise(F.coalesce("p_close", F.lit(0.0)))
    out = out.withColumn("p_close", p)
    return out.select("source", "same", "chars", "limited", "kind", "p_close", ((F.col("kind") != "closed") & (F.col("limited") | (F.col("p_close") < CLOSE))).alias("truncated"))


def by_source(judged: DataFrame) -> DataFrame:
    """(source, n_texts, n_truncated, n_limited, share): how often each source truncates."""
    return judged.groupBy("source").agg(F.count("*").alias("n_texts"), F.count_if("truncated").alias("n_truncated"), F.count_if(F.col("truncated") & F.col("limited")).alias("n_limited")).withColumn("share", F.round(F.col("n_truncated") / F.col("n_texts"), 6))
