"""Text functions as column expressions; null in gives null out unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A short list of our own; every function takes another as a parameter.
STOPWORDS = "a an and are as at be but by for from had has have he her his i in is it its me my no not of on or our she so that the their them then there they this to was we were what when where which who why will with you your".split()

# The words and classes below decide results and must be these, in this order.
HISTORY_WORDS = "when|then|before|previously|used to|historical|history|at that time"
TRANSIENT_WORDS = "currently|now|is at|today|tonight|this morning|right now"
NEGATIONS = ["not", "no", "never", "none", "n't", "cannot", "cant", "without", "isn't", "wasn't", "aren't", "weren't", "don't", "doesn't", "didn't", "won't", "wouldn't", "shouldn't", "couldn't", "isn", "wasn", "aren"]
ANTONYMS = [("on", "off"), ("online", "offline"), ("up", "down"), ("open", "closed"), ("enabled", "disabled"), ("yes", "no"), ("true", "false"), ("active", "inactive"), ("private", "shared"), ("light", "dark"), ("start", "stop"), ("allow", "block"), ("accept", "reject"), ("pass", "fail")]
CLAIM_VERBS = "prefers?|likes?|uses?|works on|owns?|lives in|is named"
CORRECTIONS = "switched|changed|updated|now prefers?|no longer|instead of|correction"
STATEMENT_KINDS = [
    ("correction", r"correct(?:ion|ed)?|actually|not\s+[\p{L}\p{N}_]+\s+but|wrong"),
    ("abandoned", "abandon(?:ed|ing)?|withdrawn|dropped|rejected|no longer"),
    ("unresolved", "unresolved|open question|still need to decide|undecided|tbd"),
    ("conflict", "conflict|contradict(?:ion|s|ory)?|disagree|both options"),
    ("decision", "decid(?:e|ed|ing)|agreed|selected|adopted|we will|choose|chosen"),
    ("proposal", "propos(?:e|ed|al)|suggest(?:ed|ion)?|could|might|should"),
]
ARCHETYPES = [
    ("historical", r"when|before|previously|used to|historical|history|at that time|last time|in [0-9]{4}|[0-9]{4}-[01][0-9]-[0-3][0-9]"),
    ("document_lookup", "file|document|note|vault|markdown|folder|path"),
    ("troubleshooting", "error|failure|broken|bug|issue|traceback|exception|doesn't work|not working"),
    ("preference", "prefer|preference|like|likes|favorite|favourite|usually"),
    ("project_state", "status|state|progress|milestone|todo|blocked|project"),
    ("delegation", "delegate|delegated|subagent|hand off|child task"),
    ("procedure", "how do|how to|configure|setup|install|steps|procedure"),
    ("person_or_entity", "who is|person|user|team|colleague|friend|owner"),
    ("general_recall", "remember|recall|what did|tell me|according to"),
]
MEMORY_WORDS = "remember|recall|did we|do we|what did|what do|decide|decided|status of|last time|previously|before|earlier|who is|what is|where is|how many|which|configure|setup|preference|prefers|policy|policies"
GREETINGS = "hey|hi|hello|yo|sup|howdy|thanks|thank you|ok|okay|sure|yes|no|cool|nice|got it|bye|good night|how are you|how's it going|what's up|whats up"
SCOPE_WORDS = [("fleet", "timezone|name|email|prefers|hates|wants|language|region|location"), ("shared", "project|repo|hardware|server|network|decision|agreed|plan|build")]
QUESTION_WORDS = "a an and are can did does do for from how i in is it me my of on please the according another based computer mention mentioned say says tell told their then they to was we what when where which who why would you your".split()

EXPANSION_STOPS = "the a an is are was were be of to in on for and or what who where how why did do does i you we they my your our me us".split()

_EDGE = r"[^\p{L}\p{N}_]"


def whole(words: str) -> str:
    """A pattern of alternatives that stand as whole words, in any case."""
    return rf"(?i)(?:^|{_EDGE})(?:{words})(?:{_EDGE}|$)"


def content_key(c: Column) -> Column:
    """Lower-cased, white space collapsed, trimmed: equal for texts that differ in nothing else."""
    return F.trim(F.regexp_replace(F.lower(c), r"[ \t\r\n]+", " "))


def content_hash(c: Column) -> Column:
    return F.sha2(content_key(c), 256)


def tokens(c: Column) -> Column:
    """ASCII words and numbers in order, lower-cased; null gives an empty array."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def terms(c: Column, most: int = 12, stop: list[str] = STOPWORDS) -> Column:
    """The first distinct words of two letters or more that are no stop words and no numbers."""
    keep = F.filter(tokens(c), lambda w: (F.length(w) >= 2) & ~w.isin(*stop) & ~w.rlike("^[0-9]+$"))
    return F.slice(F.array_distinct(keep), 1, most)


def phrases(c: Column, most: int = 8) -> Column:
    """Runs of three, two and one words, longest first, distinct."""
    runs = lambda t, n: F.when(F.size(t) >= n, F.transform(F.sequence(F.lit(1), F.size(t) - (n - 1)), lambda i: F.array_join(F.slice(t, i, n), " "))).otherwise(F.array().cast("array<string>"))
    # the tokens are named once, else they would be found anew for each run
    return F.element_at(F.transform(F.array(tokens(c)), lambda t: F.slice(F.array_distinct(F.concat(runs(t, 3), runs(t, 2), runs(t, 1))), 1, most)), 1)


def token_estimate(c: Column, per: int = 3) -> Column:
    """At least 1; a token for every ``per`` characters, rounded up."""
    return F.greatest(F.lit(1), F.ceil(F.length(c) / per)).cast("int")


def fit_tokens(c: Column, budget: int, per: int = 3) -> Column:
    """The text if it fits the budget, else its head with an ellipsis."""
    return F.when(token_estimate(c, per) <= budget, c).otherwise(F.concat(F.rtrim(F.substring(c, 1, per * budget - 1)), F.lit("…")))


def head_tail(c: Column, most: int, marker: str = " … ", head: float = 0.6) -> Column:
    """The text if it has at most ``most`` characters, else its head and tail around a marker."""
    room = most - len(marker)
    first = int(room * head)
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.left(c, F.lit(first)), F.lit(marker), F.right(c, F.lit(room - first))))


def safe(c: Column) -> Column:
    """Without NUL and without tags that frame injected context."""
    return F.regexp_replace(F.replace(c, F.lit("\u0000"), F.lit("")), r"(?i)</?memory[-_]context[^>]*>", "")


def entity_key(c: Column) -> Column:
    """Name in its comparable form: lower case, punctuation except dots dropped, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}. ]", " "), " +", " "))


def sentences(c: Column) -> Column:
    """Parts after . ! ? and white space, or between blank lines; empty parts dropped."""
    cut = F.regexp_replace(F.regexp_replace(c, r"([.!?])[ \t\r\n]+", "$1\u0001"), r"\n[ \t]*\n", "\u0001")
    return F.filter(F.transform(F.split(cut, "\u0001"), lambda s: F.trim(s)), lambda s: s != "")


def historical_intent(c: Column, words: str = HISTORY_WORDS) -> Column:
    """Words of history, or a date of this century."""
    return F.coalesce(c.rlike(whole(words)) | c.rlike(whole("20[0-9]{2}-[01][0-9]-[0-3][0-9]")), F.lit(False))


def retrieval_words(c: Column) -> Column:
    """The words of a question that are left to search for: without words of history, possessive endings and question words; all of it if none is left."""
    plain = F.regexp_replace(F.coalesce(c, F.lit("")), whole(HISTORY_WORDS), " ")
    found = F.transform(F.regexp_extract_all(plain, F.lit(r"[\p{L}\p{N}_'’-]+"), F.lit(0)), lambda w: F.regexp_replace(w, r"['’]s$", ""))
    left = F.array_join(F.filter(found, lambda w: (w != "") & ~F.lower(w).isin(*QUESTION_WORDS)), " ")
    return F.coalesce(F.nullif(F.btrim(left, F.lit(" ?.,")), F.lit("")), F.trim(c))


def needs_memory(c: Column) -> Column:
    """Whether a question is worth a search: words that ask for memory, else anything but a mere greeting; false for null and blank."""
    plain = F.trim(F.coalesce(c, F.lit("")))
    return (plain != "") & (plain.rlike(whole(MEMORY_WORDS)) | ~plain.rlike(rf"(?i)^(?:{GREETINGS})[!?.]*$"))


def transient(c: Column, words: str = TRANSIENT_WORDS, allow_temporal: bool = False) -> Column:
    """States of the moment: percentages and clock times, and unless allowed words such as now and today."""
    hit = c.rlike(rf"(?:^|{_EDGE})[0-9]{{1,3}}\s*%") | c.rlike(whole("percent")) | c.rlike(whole(r"[0-9]{1,2}:[0-9]{2}(?:\s*[aApP][mM])?"))
    return F.coalesce(hit if allow_temporal else hit | c.rlike(whole(words)), F.lit(False))


# Literal credentials by rule, and words that only point to one.
SECRETS = {
    "assignment": r"(?i)(?:password|passwd|secret|token|api[_-]?key)[\"']?\s*(?:=|:|is)\s*[\"']?[A-Za-z0-9+/_.-]{6,}",
    "key": r"sk-[A-Za-z0-9]{16,}",
    "credentials": r"://[^/ :@]+:[^/ @]+@",
}
SECRET = "|".join(SECRETS.values())
_TOKEN = r"[A-Za-z0-9_+/=-]{24,}"
_POINTER = rf"(?i)(?:^|{_EDGE})(?:passwords?|passwd|secrets?|api[ _-]?keys?|credentials?)"


def _mixed(w: Column) -> Column:
    """A long word of capitals, small letters and digits that is no path."""
    return w.rlike("[A-Z]") & w.rlike("[a-z]") & w.rlike("[0-9]") & ~F.startswith(w, F.lit("/"))


def secret_counts(c: Column) -> Column:
    """array of struct(class, subclass, n): literal credentials (secret-like) by rule, and words that only point to one (review-pointer)."""
    found = lambda p: F.size(F.regexp_extract_all(c, F.lit(p), F.lit(0)))
    row = lambda k, sub, n: F.struct(F.lit(k).alias("class"), F.lit(sub).alias("subclass"), n.alias("n"))
    token = F.size(F.filter(F.regexp_extract_all(c, F.lit(_TOKEN), F.lit(0)), _mixed))
    rows = [row("secret-like", name, found(p)) for name, p in SECRETS.items()] + [row("secret-like", "token", token)]
    pointer = F.greatest(F.lit(0), found(_POINTER) - found(SECRETS["assignment"]))
    return F.filter(F.array(*rows, row("review-pointer", "pointer", pointer)), lambda x: x["n"] > 0)


def has_secret(c: Column) -> Column:
    """Literal credentials: a keyword with a value, key-shaped words, addresses with a password, long mixed tokens. Words that only point to one don't count."""
    return F.coalesce(c.rlike(SECRET) | F.exists(F.regexp_extract_all(c, F.lit(_TOKEN), F.lit(0)), _mixed), F.lit(False))


def redacted(c: Column, field: str) -> Column:
    """The text with literal credentials replaced by a mark that names the field."""
    return F.regexp_replace(F.regexp_replace(c, SECRET, f"[SECRET-LIKE field={field}]"), r"(?<![A-Za-z0-9_+/=-])(?=[^\s/])(?=[A-Za-z0-9_+/=-]*[A-Z])(?=[A-Za-z0-9_+/=-]*[a-z])(?=[A-Za-z0-9_+/=-]*[0-9])[A-Za-z0-9_+/=-]{24,}", f"[SECRET-LIKE field={field}]")


def _classed(t: Column, classes: list[tuple[str, str]], otherwise: str) -> Column:
    out = F.lit(otherwise)
    for name, words in reversed(classes):
        out = F.when(t.rlike(whole(words)), name).otherwise(out)
    return out


def statement_kind(c: Column) -> Column:
    """correction, abandoned, unresolved, conflict, decision or proposal, by the first that holds, else discussion."""
    return _classed(F.coalesce(c, F.lit("")), STATEMENT_KINDS, "discussion")


def query_archetype(c: Column) -> Column:
    """Kind of a question, by the first class that holds; unknown for null, blank and all else."""
    return _classed(F.coalesce(c, F.lit("")), ARCHETYPES, "unknown")


def visibility_guess(c: Column) -> Column:
    """fleet before shared before private, by parts of words."""
    out = F.lit("private")
    for name, words in reversed(SCOPE_WORDS):
        out = F.when(F.lower(c).rlike(words), name).otherwise(out)
    return out


def claim_parts(subject: Column, c: Column) -> Column:
    """struct(predicate, object) of a statement about the subject, by a few verbs; any other statement is (states, text)."""
    body = F.rtrim(F.regexp_replace(F.trim(c), r"[.?!]+$", ""))
    own = F.startswith(F.lower(body), F.lower(subject)) & (F.length(subject) > 0) & F.substring(body, F.length(subject) + 1, F.lit(1)).rlike(r"\s")
    rest = F.when(own, F.regexp_replace(F.substring(body, F.length(subject) + 1, F.length(body)), r"^\s+", "")).otherwise(body)
    rest = F.regexp_replace(rest, r"(?i)^(?:now|currently|still)\s+", "")
    pattern = rf"(?i)^({CLAIM_VERBS})\s+([^\n]+)\z"
    verb = F.regexp_replace(F.lower(F.regexp_extract(rest, pattern, 1)), r"\s+", "_")
    return F.when((rest != body) & (verb != ""), F.struct(verb.alias("predicate"), F.trim(F.regexp_extract(rest, pattern, 2)).alias("object"))).otherwise(F.struct(F.lit("states").alias("predicate"), body.alias("object")))


def claim_value(c: Column) -> Column:
    """A subject, predicate or object in its comparable form."""
    return F.regexp_replace(F.lower(F.btrim(F.coalesce(c, F.lit("")), F.lit(" .!?"))), r"\s+", " ")


def said_words(c: Column) -> Column:
    """Words between white space, lower-cased, without outer punctuation; null gives an empty array."""
    return F.transform(F.filter(F.split(F.coalesce(c, F.lit("")), r"[ \t\r\n\f\x0b]+"), lambda w: w != ""), lambda w: F.btrim(F.lower(w), F.lit(".,!?;:\"'()[]")))


def contradicts(a: Column, b: Column) -> Column:
    """Two word arrays (``said_words``): unlike numbers of negations and all but one of the other words of the smaller in common, or the two
    sides of an antonym and all but two."""
    plain = lambda t: F.filter(F.array_distinct(t), lambda w: ~w.isin(*NEGATIONS))
    count = lambda t: F.size(F.filter(t, lambda w: w.isin(*NEGATIONS)))
    shared, small = F.size(F.array_intersect(plain(a), plain(b))), F.least(F.size(plain(a)), F.size(plain(b)))
    flip = (count(a) != count(b)) & (shared >= 1) & (shared >= small - 1)
    anti = F.lit(False)
    for x, y in ANTONYMS:
        anti = anti | (F.array_contains(a, x) & F.array_contains(b, y)) | (F.array_contains(a, y) & F.array_contains(b, x))
    return flip | (anti & (shared >= F.greatest(F.lit(1), small - 2)))


def excerpt(c: Column, term: Column, around: int = 1000) -> Column:
    """The stretch around the first place of the term, else the head; place and term are compared in lower case."""
    at = F.instr(F.lower(c), term)
    return F.substring(c, F.greatest(F.lit(1), at - around), F.lit(2 * around + 1))


def frontmatter(c: Column) -> Column:
    """The block between a leading line --- and the next --- or ...; null without one."""
    block = F.regexp_extract(c, r"^---[ \t]*\r?\n([\s\S]*?)\r?\n(?:---|\.\.\.)[ \t]*(?:\r?\n|$)", 1)
    return F.nullif(block, F.lit(""))


def body(c: Column) -> Column:
    return F.regexp_replace(c, r"^---[ \t]*\r?\n[\s\S]*?\r?\n(?:---|\.\.\.)[ \t]*(?:\r?\n|$)", "")


def title(c: Column, path: Column) -> Column:
    """The first line that starts with one #, else the last part of the path without its ending."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    return F.coalesce(F.nullif(F.trim(F.regexp_extract(c, r"(?m)^# (.+)$", 1)), F.lit("")), stem)


def plain_markdown(c: Column) -> Column:
    """Links as their text, without code ticks and emphasis."""
    out = F.regexp_replace(c, r"\[([^\]]*)\]\([^)]*\)", "$1")
    return F.regexp_replace(F.regexp_replace(out, r"`([^`]*)`", "$1"), r"\*\*([^*]+)\*\*|\*([^*]+)\*", "$1$2")


def sampled(key: Column, rate: float) -> Column:
    """Deterministic: the same keys at every run, about ``rate`` of them."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 13), 16, 10).cast("double") / F.lit(float(16**13)) < rate


def expansions(c: Column, most: int = 3) -> Column:
    """Up to ``most`` search terms of a question: its capitalized names, then its words without stop words as one phrase."""
    names = F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(?:^|[^A-Za-z0-9_])([A-Z][a-zA-Z0-9]+(?:[ \t\r\n]+[A-Z][a-zA-Z0-9]+)*)"), F.lit(1)), lambda n: F.trim(n))
    names = F.filter(names, lambda n: ~F.lower(n).isin(*EXPANSION_STOPS))
    phrase = F.array_join(F.filter(F.split(F.coalesce(c, F.lit("")), r"[ \t\r\n,.;:!?]+"), lambda w: (w != "") & ~F.lower(w).isin(*EXPANSION_STOPS)), " ")
    return F.slice(F.array_distinct(F.filter(F.concat(names, F.array(phrase)), lambda t: t != "")), 1, most)


def local_endpoint(url: Column) -> Column:
    """Whether an address is of this machine or a private network, by its host."""
    host = F.rtrim(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?(\[[^\]]*\]|[^/:?#]*)", 1)))
    host = F.regexp_replace(host, r"\.$", "")
    private = host.rlike(r"^(?:127|10)\.[0-9]+\.[0-9]+\.[0-9]+$|^192\.168\.[0-9]+\.[0-9]+$|^172\.(?:1[6-9]|2[0-9]|3[01])\.[0-9]+\.[0-9]+$|^169\.254\.[0-9]+\.[0-9]+$|^\[(?:::1|f[cd][0-9a-f:]*|fe80:[0-9a-f:]*)\]$")
    return ~F.startswith(host, F.lit("your-")) & (host.isin("localhost", "localhost.localdomain") | F.endswith(host, F.lit(".local")) | F.endswith(host, F.lit(".lan")) | private)


def frontmatter_field(block: Column, name: str) -> Column:
    """The plain value of a field of a frontmatter block; null without it or with an empty one."""
    return F.nullif(F.btrim(F.regexp_extract(block, rf"(?m)^{name}:[ \t]*([^\r\n]*)", 1), F.lit(" \t\"'")), F.lit(""))


def frontmatter_tags(block: Column) -> Column:
    """The tags of a frontmatter block, written as [a, b] or a, b; empty without any."""
    inner = F.btrim(F.coalesce(frontmatter_field(block, "tags"), F.lit("")), F.lit("[] "))
    return F.filter(F.transform(F.split(inner, ","), lambda t: F.btrim(t, F.lit(" \"'"))), lambda t: t != "")


def json_slice(c: Column) -> Column:
    """The JSON object in a text: all of it, else from the first brace to the last; null if neither is one."""
    inner = F.regexp_extract(F.coalesce(c, F.lit("")), r"(\{[\s\S]*\})", 1)
    good = lambda x: F.try_parse_json(x).isNotNull() & F.startswith(F.ltrim(x), F.lit("{"))
    return F.when(good(c), c).when(good(inner), inner)


def fingerprint(c: Column) -> Column:
    """Digest of a text's comparable form; null is the empty text."""
    return F.sha2(content_key(F.coalesce(c, F.lit(""))), 256)


def iso_time(c: Column) -> Column:
    """A moment in ISO form: Z and offsets are heeded, one without either is UTC; null if it can't be read. The session's zone is UTC."""
    return F.when(c.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[T ][0-9]{2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]{1,6})?)?(?:Z|[+-][0-9]{2}:?[0-9]{2})?)?$"), c.try_cast("timestamp"))


def claim_identity(subject: Column, c: Column) -> Column:
    """Digest of what makes two statements the same: subject, predicate and object in their comparable forms."""
    p = claim_parts(subject, c)
    return F.sha2(F.concat_ws("\u0001", claim_value(subject), claim_value(p["predicate"]), claim_value(p["object"])), 256)
