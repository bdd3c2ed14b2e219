"""Personal information inside free text: bootstrapped contextual extraction and replacement.

Every text gives candidates of each kind by shape alone, with the words before and after them. Candidates that are
certain (a pair of listed names, a number with country code, the fixed form of an insurance number ...) are the seeds. A
pattern is a piece of context; patterns and instances form a graph that is scored in rounds: a pattern is worth the share of
the distinct instances in its places that are accepted, an instance is accepted by a pattern worth enough, and accepted
instances raise other patterns in the next round. Names found so add their parts to the lexicon, by which the last pass also finds
them in other places and in any case of letters.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidenza.runtime import broadcast_if_small, cut

ROUNDS = 3
#: A pattern counts with so many distinct accepted instances, and from this share of accepted ones on.
SUPPORT, SHARE = 3, 0.5
#: Length of the stretches by which finds of one text are compared with one another.
STRETCH = 128
#: Most common words that a task of the last pass holds.
SKIPPED = 20_000
PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "name": "[NAME]"}

# Signs spelled out in email addresses, kinds of streets, and titles, which are no part of a name.
_AT = r"(?:@|\s?[\(\[\{]\s?at\s?[\)\]\}]\s?|\s?[\(\[]\s?@\s?[\)\]]\s?)"
_DOT = r"(?:\.|\s?[\(\[\{]\s?dot\s?[\)\]\}]\s?)"
_STREETS = "road street avenue lane row close way drive crescent terrace hill court gardens place mews walk grove square boulevard parade rise yard gate green park quay wharf passage st rd ave ln cres ct sq blvd"
_GERMAN = "straße strasse weg gasse platz allee ufer ring damm steig pfad"
_ROMANCE = "rue calle avenue boulevard chemin place impasse avenida plaza paseo camino via viale piazza quai allée"
_TITLES = "mr mrs ms miss dr prof sir madam herr frau hr mme mlle sr sra project projekt projet"
_NO_NAMES = frozenset(_TITLES.split())


def _rx(words: str) -> str:
    return "(?:" + "|".join(words.split()) + ")"


_L = r"[^\W\d_]"
_EMAIL = re.compile(rf"(?<![\w.+-])[\w][\w.+-]*{_AT}(?:[^\W_](?:[\w-]*[^\W_])?{_DOT})+{_L}{{2,}}(?![\w-])|(?<![\w.+-])[\w][\w.+-]* at (?:[\w-]+ dot )+{_L}{{2,}}(?!\w)", re.I)
_SPELLED = re.compile(r"[\(\[\{]\s?at|\sat\s", re.I)
_DIGIT = re.compile(r"\d")
_NUMBER = re.compile(r"(?<![\w@.+/-])(?:\+\s?|\()?\d(?:[\d()]|[ ./-](?=[\d(])|\) (?=\d)){5,22}(?![\w@])")
_IDS = re.compile(rf"(?<![\w@.+/-])(?:{_L}{{2}} \d\d \d\d \d\d {_L}(?!\w)|(?:{_L}{{1,3}}-?)?\d[\dA-Za-z]*(?:[ ./-]\d[\dA-Za-z]*)*(?![\w@]))", re.I)
_NAMEWORD = rf"{_L}(?:{_L}|['’](?={_L}))+(?:-{_L}+)*"
_NO = r"\d{1,4}(?:\s?[a-z](?!\w))?"
_ADDRESS = re.compile(
    rf"(?<![\w@./-])(?:{_NO},? {_rx(_ROMANCE)} (?:(?:de|du|des|del|di|la|las|los|le|les|el)(?: la)? )?{_NAMEWORD}(?![\w])"
    rf"|{_rx(_ROMANCE)} (?:(?:de|du|des|del|di|la|las|los|le|les|el)(?: la)? )?{_NAMEWORD},? {_NO}(?!\w)"
    rf"|{_NO},? (?:(?:old|new|upper|lower|great|little|north|south|east|west) )?{_NAMEWORD} {_rx(_STREETS)}(?!\w)"
    rf"|{_L}{{2,}}(?:-?{_rx(_GERMAN)}),? {_NO}(?!\w|[ ./-]\d)|(?-i:[A-ZÄÖÜ]){_NAMEWORD} (?-i:{_rx(_GERMAN.title())}),? {_NO}(?!\w|[ ./-]\d))",
    re.I,
)
_PERSON = re.compile(rf"(?<![\w@.+-])(?=(?P<a>{_NAMEWORD}|{_L}\.)(?P<c>, | )(?:(?P<m>{_L}\.) )?(?P<b>{_NAMEWORD}|{_L}\.)(?![\w@+]))", re.I)
_START = re.compile(rf"(?<![\w@.+-])(?:{_NAMEWORD}|{_L}\.)", re.I)
_CANDIDATES = "src string, row_id string, field string, at int, till int, kind string, item string, inst string, first string, last string, cased boolean, sure int, pats array<string>"


def _around(text: str, at: int, till: int) -> list[str]:
    """The pieces of context of a place: one and two words before, one and two after."""
    plain = lambda w: re.sub(r"\d+", "#", w.lower())
    before, after = [plain(w) for w in text[max(0, at - 60) : at].split()[-2:]], [plain(w) for w in re.findall(rf"{_L}+(?:-{_L}+)*|\d+|[^\w\s]", text[till : till + 40])[:2]]
    if before and re.search(r"[.!?]$", before[-1]) and len(before[-1]) > 4:
        before = ["<s>"]
    if len(before) == 2 and re.search(r"[.!?]$", before[0]) and len(before[0]) > 4:
        before[0] = "<s>"
    out = ["R2:" + " ".join(after)]
    if before:
        out.append("L1:" + before[-1])
    if len(before) == 2:
        out.append("L2:" + " ".join(before))
    label = re.search(rf"({_L}+)(?: (?:number|no|nr))?(?: is)?[\s:=]*$", text[max(0, at - 40) : at].lower())
    if label:  # the last word of a label, whatever ties it to its value
        out.append("LB:" + label.group(1))
    if before and after:
        out.append("LR:" + before[-1] + "|" + after[0])
    return out


def _numbers(text: str, taken: list[tuple[int, int]]) -> Iterator[tuple]:
    """Candidates of numbers, as phone and as id; sure is 1 for the fixed forms."""
    free = lambda a, b: all(b <= x or y <= a for x, y in taken)
    for m in _NUMBER.finditer(text):
        a, b, s = m.start(), m.end(), m.group()
        if s.count("(") != s.count(")"):
            if s[0] != "(":
                continue
            a, s = a + 1, s[1:]
            if "(" in s or ")" in s:
                continue
        digits = re.sub(r"\D", "", s)
        if not 7 <= len(digits) <= 15 or not free(a, b):
            continue
        date = re.fullmatch(r"\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}[-/.]\d{1,2}[-/.]\d{4}|\d{1,3}(?:\.\d{1,3}){3}", s)
        national = len(digits) >= 9 and re.fullmatch(r"0[1-9]\d*(?:[ ./-]\d{2,}){2,}|\(\d{3}\) \d{3}-\d{4}", s)
        sure = 1 if s.startswith("+") or national or re.match(r"00[1-9]\d[\d ]{8,}$", s) else -1 if date else 0
        yield a, a + len(s), "phone", s, digits, sure
    for m in _IDS.finditer(text):
        a, b, s = m.start(), m.end(), m.group()
        if sum(c.isdigit() for c in s) < 6 or not free(a, b) or a and text[a - 1] == "+":
            continue
        date = re.fullmatch(r"\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}[-/.]\d{1,2}[-/.]\d{4}|\d{1,3}(?:\.\d{1,3}){3}", s)
        sure = 1 if re.fullmatch(rf"{_L}{{2}} \d\d \d\d \d\d {_L}|\d{{3}}-\d\d-\d{{4}}", s) else -1 if date else 0
        yield a, b, "id_number", s, re.sub(r"\W", "", s.lower()), sure


def _people(text: str, taken: list[tuple[int, int]], cased_only: bool, skip: frozenset[str]) -> Iterator[tuple]:
    for word in _START.finditer(text):
        w = word.group()
        if cased_only and not w[0].isupper() or w.lower() in skip:
            continue
        m = _PERSON.match(text, word.start())
        if m is None:
            continue
        a, comma, mid, b = m.group("a"), m.group("c") == ", ", m.group("m"), m.group("b")
        if b.lower() in skip or len(a) == 2 and len(b) == 2 or comma and mid and len(b) > 2 or len(b) == 2 and not comma or comma and len(a) == 2:
            continue
        if a.lower().rstrip(".") in _NO_NAMES or b.lower() in _NO_NAMES:
            continue
        given, family = (b, a) if comma else (a, b)
        shape = all(len(x) == 2 or x[0].isupper() for x in (a, b))
        if cased_only and not shape:
            continue
        at, till = m.start("a"), m.end("b")
        if comma and (x := re.match(rf" {_L}\.(?!\w)", text[till:])):
            till += x.end()  # a middle initial behind the given name
        if any(at < y and x < till for x, y in taken):
            continue
        yield at, till, "name", text[at:till], f"{given} {family}".lower(), given.lower(), family.lower(), shape


def _found(cased_only: bool, kinds: tuple[str, ...], skip: frozenset[str] = frozenset()):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _CANDIDATES.split(", ")]
        for batch in batches:
            rows: list[tuple] = []
            for src, row_id, field, text in zip(*(batch.column(c).to_pylist() for c in ("src", "row_id", "field", "text"))):
                # what an email, an address or a number can't do without is looked for first
                numbered = _DIGIT.search(text) is not None
                mails = [(m.start(), m.end()) for m in _EMAIL.finditer(text)] if "@" in text or _SPELLED.search(text) else []
                places = [(m.start(), m.end()) for m in _ADDRESS.finditer(text) if all(m.end() <= x or y <= m.start() for x, y in mails)] if numbered else []
                if "email" in kinds:
                    rows += [(src, row_id, field, a, b, "email", text[a:b], text[a:b].lower(), None, None, True, 1, _around(text, a, b)) for a, b in mails]
                    for a, b in places:
                        words = re.findall(rf"{_L}{{2,}}", text[a:b])
                        shape = all(w[0].isupper() or w.lower() in (*_ROMANCE.split(), "de", "du", "des", "del", "di", "la", "las", "los", "le", "les", "el") for w in words)
                        rows.append((src, row_id, field, a, b, "address", text[a:b], text[a:b].lower(), None, None, shape, 1 if shape else 0, _around(text, a, b)))
                    for a, b, kind, item, inst, sure in _numbers(text, mails + places) if numbered else ():
                        rows.append((src, row_id, field, a, b, kind, item, inst, None, None, True, sure, _around(text, a, b)))
                if "name" in kinds:
                    for a, b, kind, item, inst, first, last, shape in _people(text, mails + places, cased_only, skip):
                        pats = _around(text, a, b) if cased_only else [text[max(0, a - 61) : a], text[b : b + 41]]
                        rows.append((src, row_id, field, a, b, kind, item, inst, first, last, shape, 0, pats))
            if rows:
                schema = pa.schema([("src", pa.string()), ("row_id", pa.string()), ("field", pa.string()), ("at", pa.int32()), ("till", pa.int32()), ("kind", pa.string()), ("item", pa.string()), ("inst", pa.string()), ("first", pa.string()), ("last", pa.string()), ("cased", pa.bool_()), ("sure", pa.int32()), ("pats", pa.list_(pa.string()))])
                yield pa.RecordBatch.from_arrays([pa.array(c, schema.field(n).type) for n, c in zip(names, zip(*rows))], schema=schema)

    return run


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns the text before and after a place, kept in ``pats``, into its pieces of context."""
    for batch in batches:
        pats = [_around(a + b, len(a), len(a)) for a, b in batch.column("pats").to_pylist()]
        yield batch.set_column(batch.schema.get_field_index("pats"), "pats", pa.array(pats, pa.list_(pa.string())))


def _worth(cands: DataFrame, accepted: DataFrame, support: int, share: float) -> DataFrame:
    """(kind, pat, worth): patterns by the share of their distinct instances that are accepted."""
    each = cands.select("kind", "inst", F.explode("pats").alias("pat")).distinct()
    each = each.join(accepted.select("kind", "inst", F.lit(1).alias("yes")), ["kind", "inst"], "left")
    p = each.groupBy("kind", "pat").agg(F.count("yes").alias("pos"), F.count("*").alias("all"))
    return p.where((F.col("pos") >= support) & (F.col("pos") >= share * F.col("all"))).select("kind", "pat", (F.col("pos") / F.col("all")).alias("worth"))


def learned(cands: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, share: float = SHARE) -> tuple[DataFrame, DataFrame]:
    """(patterns, instances): the scored patterns and the accepted instances (kind, inst) after some rounds.

    The share asked of a pattern begins lower, as most true instances aren't accepted yet, and ends at ``share``.
    """
    accepted, patterns = seeds, None
    for r in range(rounds):
        need = share * (0.5 + 0.5 * r / max(1, rounds - 1))
        patterns = cut(_worth(cands, accepted, support, need))
        hit = cands.select("kind", "inst", F.explode("pats").alias("pat")).join(broadcast_if_small(patterns), ["kind", "pat"])
        # one strong pattern, or two different ones that together leave little doubt
        new = hit.groupBy("kind", "inst", "pat").agg(F.max("worth").alias("w")).groupBy("kind", "inst").agg((1 - F.exp(F.sum(F.log(1.0001 - F.col("w"))))).alias("s"), F.max("w").alias("m"))
        new = new.where((F.col("m") >= need) & (F.col("s") >= 0.6)).select("kind", "inst")
        accepted = cut(accepted.select("kind", "inst").unionByName(new).distinct())
    return patterns, accepted


def texts(df: DataFrame, src: str, key: str, fields: list[str]) -> DataFrame:
    """(src, row_id, field, text): the fields of a table behind one another; null texts are left out, repeated rows count once."""
    rows = df.select(F.col(key).cast("string").alias("row_id"), F.explode(F.map_from_arrays(F.array(*[F.lit(f) for f in fields]), F.array(*[F.col(f) for f in fields]))).alias("field", "text"))
    return rows.where(F.col("text").isNotNull() & F.col("row_id").isNotNull()).select(F.lit(src).alias("src"), "row_id", "field", "text").distinct()


def personal(rows: DataFrame, known: DataFrame) -> DataFrame:
    """(src, row_id, field, at, till, kind, item): every piece of personal information in the texts.

    ``rows`` has (src, row_id, field, text), ``known`` (name, name_kind given or family). Places don't overlap: of two, an address or
    email goes before a number, a number before a name, the more certain number before the other, and of one sort the longer before the shorter. Null and empty texts
    have none; without known names the names of persons aren't found, the other kinds are.
    """
    rows = rows.where(F.length("text") > 0)
    listed = known.where(F.col("name").isNotNull()).select(F.lower(F.trim("name")).alias("word"), "name_kind").distinct()
    given = broadcast_if_small(listed.where(F.col("name_kind") == "given").select(F.col("word").alias("first"), F.lit(1).alias("g")).distinct())
    family = broadcast_if_small(listed.where(F.col("name_kind") == "family").select(F.col("word").alias("last"), F.lit(1).alias("f")).distinct())
    cands = rows.mapInArrow(_found(True, ("email", "name")), _CANDIDATES)
    cands = cands.join(given, "first", "left").join(family, "last", "left")
    cands = cut(cands.withColumn("sure", F.when((F.col("g") == 1) & (F.col("f") == 1), 1).otherwise(F.col("sure"))).drop("g", "f"))
    # emails are always certain and need no pattern
    learn = cands.where((F.col("sure") >= 0) & (F.col("kind") != "email"))
    seeds = learn.where(F.col("sure") == 1).select("kind", "inst").distinct()
    patterns, accepted = learned(learn, seeds)

    # numbers and addresses: an occurrence is taken if it is certain or stands in a place worth it
    others = cands.where(F.col("kind") != "name").withColumn("n", F.monotonically_increasing_id())
    good = patterns.select("kind", "pat", "worth")
    best = F.max("worth").alias("worth")
    scored = others.where(F.col("sure") == 0).select("n", "kind", F.explode("pats").alias("pat")).join(broadcast_if_small(good), ["kind", "pat"]).groupBy("n").agg(best)
    others = cut(others.join(scored, "n", "left"))
    others = others.where((F.col("sure") == 1) | (F.col("worth") >= 0.5))
    certain = F.when(F.col("sure") == 1, 0.5).otherwise(0.4 * F.col("worth"))

    # names: the parts of accepted pairs make the lexicon; the last pass looks at words in any case of letters, but not
    # at those that the texts mostly write in small letters, unless they are listed parts of a whole, capitalised name
    word = rows.select(F.explode(F.regexp_extract_all("text", F.lit(r"[\p{L}'’-]+"), F.lit(0))).alias("w")).where(F.length("w") > 1)
    word = word.groupBy("w").agg(F.count("*").alias("n")).groupBy(F.lower("w").alias("word")).agg(F.sum(F.when(F.lower("w") == F.col("w"), F.col("n")).otherwise(0)).alias("low"), F.sum("n").alias("n"))
    frequent = cut(word.where((F.col("low") >= 3) & (2 * F.col("low") > F.col("n"))).select("word", "n"))
    common = broadcast_if_small(frequent.select("word"))
    pairs = learn.where((F.col("kind") == "name") & (F.length("first") > 2)).join(accepted, ["kind", "inst"], "left_semi").select("first", "last").distinct()
    part = lambda c, k: listed.where(F.col("name_kind") == k).select(F.col("word").alias(c)).unionByName(pairs.groupBy(c).agg(F.count("*").alias("n")).where(F.col("n") >= 2).select(c).join(common.withColumnRenamed("word", c), c, "left_anti")).distinct()
    firsts, lasts = cut(part("first", "given")), cut(part("last", "family"))
    firsts, lasts = broadcast_if_small(firsts.withColumn("g", F.lit(1))), broadcast_if_small(lasts.withColumn("f", F.lit(1)))
    # the commonest of them, so many at most, are passed over at once; the join drops the rest
    skip = frozenset(r["word"] for r in frequent.join(broadcast_if_small(listed.select("word").distinct()), "word", "left_anti").orderBy(F.desc("n"), "word").limit(SKIPPED).collect())
    people = rows.mapInArrow(_found(False, ("name",), skip), _CANDIDATES)
    people = people.join(common.select(F.col("word").alias("first"), F.lit(True).alias("cf")), "first", "left").join(common.select(F.col("word").alias("last"), F.lit(True).alias("cl")), "last", "left")
    people = people.join(firsts, "first", "left").join(lasts, "last", "left").withColumns({"g": F.coalesce("g", F.lit(0)), "f": F.coalesce("f", F.lit(0))})
    whole = ((F.col("g") == 1) | (F.length("first") == 2)) & (F.col("f") == 1)
    people = people.where((F.col("cf").isNull() & F.col("cl").isNull()) | (F.col("cased") & whole))  # common words are in the lexicon only if listed
    cols = ["src", "row_id", "field", "at", "till", "kind", "item"]
    people = people.where((F.col("g") == 1) | (F.col("f") == 1) | F.col("cased")).select(*cols, whole.alias("whole"), (F.col("g") + F.col("f")).alias("k"), "pats")
    people = cut(people.mapInArrow(_contexts, people.schema))
    left = good.where((F.col("kind") == "name") & (F.col("worth") >= 0.5)).select(F.col("pat"), "worth")
    one, rest = people.where("whole"), people.where("NOT whole")
    hit = rest.select(*cols, "k", F.explode("pats").alias("pat")).join(broadcast_if_small(left), "pat").groupBy(*cols).agg(F.max("k").alias("k"), F.max("worth").alias("worth"), F.count("*").alias("c"))
    hit = hit.where((F.col("k") >= 1) | (F.col("worth") >= 0.9) | ((F.col("worth") >= 0.6) & (F.col("c") >= 2)))
    names = one.select(*cols).unionByName(hit.select(*cols))

    rank = F.create_map(*[F.lit(x) for kv in {"email": 0, "address": 1, "phone": 2, "id_number": 2, "name": 4}.items() for x in kv])
    found = others.select(*cols, certain.alias("certain")).unionByName(names.withColumn("certain", F.lit(0.0)))
    found = found.groupBy(*cols).agg((rank[F.col("kind")] - F.max("certain")).alias("rank"))
    return _without_overlaps(found)


def _without_overlaps(found: DataFrame) -> DataFrame:
    """A find gives way to a better one that it overlaps: of lower rank, then longer, then earlier, then by its kind.

    Finds meet by the stretches of ``STRETCH`` signs that they touch, so those of a long text are never gathered.
    """
    text = ["src", "row_id", "field"]
    found = cut(found.withColumn("n", F.monotonically_increasing_id()))
    places = found.withColumn("part", F.explode(F.sequence(F.floor(F.col("at") / STRETCH), F.floor((F.col("till") - 1) / STRETCH))))
    worth = lambda t: F.struct(F.col(f"{t}.rank"), (F.col(f"{t}.at") - F.col(f"{t}.till")).alias("size"), F.col(f"{t}.at").alias("from"), F.col(f"{t}.kind"))
    x, y = places.alias("x"), places.select(*text, "part", "at", "till", "rank", "kind").alias("y")
    met = x.join(y, [F.col(f"x.{c}") == F.col(f"y.{c}") for c in (*text, "part")])
    lost = met.where((F.col("y.at") < F.col("x.till")) & (F.col("x.at") < F.col("y.till")) & (worth("y") < worth("x"))).select("x.n").distinct()
    return found.join(lost, "n", "left_anti").select(*text, "at", "till", "kind", "item")


def replaced(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(src, row_id, field, text): the texts with each find replaced by the placeholder of its kind; all else stays as it is."""
    label = F.create_map(*[F.lit(x) for kv in PLACEHOLDERS.items() for x in kv])
    spans = found.groupBy("src", "row_id", "field").agg(F.array_sort(F.collect_list(F.struct("at", "till", label[F.col("kind")].alias("label")))).alias("spans"))
    both = rows.join(spans, ["src", "row_id", "field"], "left")
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("from"))
    step = lambda s, x: F.struct(F.concat(s["out"], F.substring(F.col("text"), s["from"] + 1, x["at"] - s["from"]), x["label"]).alias("out"), x["till"].alias("from"))
    done = F.aggregate("spans", start, step, lambda s: F.concat(s["out"], F.substring(F.col("text"), s["from"] + 1, F.length("text"))))
    return both.select("src", "row_id", "field", F.coalesce(done, F.col("text")).alias("text"))
