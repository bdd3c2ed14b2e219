"""Entities and the graph of their links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidenza.functions import text
from evidenza.runtime import cut

# A short list of our own: words that begin sentences but name nothing.
NO_NAMES = "the a an i we you it he she they this that these those there on in at every if when where why what which who how did does do can could please keep and but or not project update steps monday tuesday wednesday thursday friday saturday sunday today tonight tomorrow yesterday".split()
# What the words between two names say of their relation, first list first, and the types of entities.
RELATIONS = [
    ("uses", "uses|utilizes|employs|runs on|relies on|is built on|is powered by|is based on|is running on"),
    ("depends_on", "depends on|requires|needs|consumes"),
    ("owns", "owns|has|contains|includes|comprises"),
    ("manages", "manages|controls|administers|orchestrates|coordinates"),
    ("created", "created|built|developed|wrote|designed|authored|established|set up|configured"),
    ("interacts_with", "connects to|talks to|sends to|interacts with|communicates with|integrates with|syncs with|pulls from|pushes to"),
    ("monitors", "monitors|watches|tracks|observes|surveys|scans"),
    ("references", "references|links to|cites|mentions|points to|refers to"),
    ("part_of", "is part of|belongs to|is a member of|is a component of"),
    ("uses", "is used by"), ("owns", "is owned by"), ("manages", "is managed by|is controlled by"), ("created", "is created by|is built by|is developed by"), ("monitors", "is monitored by"), ("references", "is referenced by"),
    ("co_occurs", "and|or|with|alongside|beside|plus"),
]
ENTITY_TYPES = [
    ("service", "server|daemon|service|api|endpoint|proxy|agent"),
    ("project", "project|repo|repository|pipeline|migration|build"),
    ("tool", "tool|cli|editor|ide|framework|library|plugin"),
    ("place", "lab|datacenter|office|region|rack|site"),
    ("person", "sister|brother|colleague|friend|manager|wife|husband"),
    ("concept", "policy|preference|rule|protocol|standard|plan"),
]
NAME = r"[A-Z][a-zA-Z0-9]+(?:[ \t\r\n]+[A-Z][a-zA-Z0-9]+)*"


def _names(docs: DataFrame, key: str, body: str) -> DataFrame:
    """(id, sid, pos, s, name): capitalized names of each sentence, common words at their head dropped."""
    rows = docs.select(F.col(key).alias("id"), F.posexplode(text.sentences(F.col(body))).alias("sid", "s"))
    rows = rows.select("id", "sid", "s", F.posexplode(F.regexp_extract_all("s", F.lit(rf"(?:^|[^A-Za-z0-9_])({NAME})"), F.lit(1))).alias("pos", "raw"))
    plain = F.regexp_replace("raw", r"[ \t\r\n]+", " ")
    name = F.regexp_replace(plain, rf"(?i)^(?:(?:{'|'.join(NO_NAMES)})(?: |$))+", "")
    return rows.select("id", "sid", "pos", "s", name.alias("name")).where(F.length("name") >= 3)


def entity_mentions(docs: DataFrame, key: str, body: str, most: int = 15) -> DataFrame:
    """(id, name, name_key, n, rank): the ``most`` most telling names of each text, longest in words first, then in order of appearance.

    Upper and lower case don't make different names, the first spelling counts. A name that is part of a longer name of
    the same text is left to it: the parts of a name are compared by words, of the lengths that names of the text have.
    """
    n = _names(docs, key, body).groupBy("id", F.lower("name").alias("low")).agg(F.count("*").alias("n"), F.min(F.struct("sid", "pos", "name")).alias("first"))
    n = n.withColumn("words", F.size(F.split("low", " ")))
    sizes = n.groupBy("id").agg(F.collect_set("words").alias("sizes"))
    w = F.split("low", " ")
    parts = F.flatten(F.transform(F.filter("sizes", lambda k: k < F.col("words")), lambda k: F.transform(F.sequence(F.lit(1), F.col("words") - k + 1), lambda i: F.array_join(F.slice(w, i, k), " "))))
    inner = n.where("words > 1").join(sizes, "id").select("id", F.explode(parts).alias("low")).distinct()
    kept = n.join(inner, ["id", "low"], "left_anti")
    order = Window.partitionBy("id").orderBy(F.desc("words"), "first")
    kept = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return kept.select("id", F.col("first.name").alias("name"), text.entity_key(F.col("first.name")).alias("name_key"), "n", "rank")


def sentence_edges(docs: DataFrame, key: str, body: str, most: int = 15) -> DataFrame:
    """(id, sid, name_a, name_b, relation): pairs of a text's chosen names that stand in one sentence, and what the words between say.

    Only the chosen names of a text (``entity_mentions``) are paired, so a text has at most most * (most - 1) / 2 pairs a sentence.
    """
    chosen = entity_mentions(docs, key, body, most).select("id", F.lower("name").alias("low"), "rank")
    said = _names(docs, key, body).select("id", "sid", "s", F.lower("name").alias("low")).distinct().join(chosen, ["id", "low"])
    x, y = said.select("id", "sid", "s", F.col("low").alias("x")), said.select("id", "sid", F.col("low").alias("y"))
    pairs = x.join(y, ["id", "sid"]).where(F.col("x") < F.col("y"))
    low = F.lower(F.regexp_replace("s", r"[ \t\r\n]+", " "))
    at, bt = F.instr(low, F.col("x")), F.instr(low, F.col("y"))
    head, tail = F.least(at, bt), F.greatest(at, bt)
    first = F.when(at < bt, F.length("x")).otherwise(F.length("y"))
    between = F.trim(F.substring(low, head + first, F.greatest(F.lit(0), tail - head - first)))
    return pairs.select("id", "sid", F.col("x").alias("name_a"), F.col("y").alias("name_b"), relation_type(between).alias("relation"))


def resolved(mentions: DataFrame, key: list[str], ident: str = "entity_id") -> DataFrame:
    """One entity a key (such as agent and name_key): its id is a digest of the key, its name the commonest spelling."""
    n = mentions.groupBy(*key, "name").agg(F.sum("n").alias("n"))
    best = n.groupBy(*key).agg(F.max_by("name", F.struct("n", "name")).alias("name"), F.sum("n").alias("n"))
    return best.withColumn(ident, F.concat(F.lit("ent-"), F.substring(F.sha2(F.concat_ws("|", *key), 256), 1, 12)))


def cooccurrences(links: DataFrame, group: str = "memory_id", item: str = "entity_id", most: int = 15) -> DataFrame:
    """(entity_a, entity_b, strength, first_group): unordered pairs of the first ``most`` items of each group, with their number."""
    w = Window.partitionBy(group).orderBy(item)
    lists = links.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).groupBy(group).agg(F.sort_array(F.collect_list(item)).alias("items"))
    pair = F.flatten(F.transform("items", lambda a, i: F.transform(F.slice("items", i + 2, most), lambda b: F.struct(a.alias("entity_a"), b.alias("entity_b")))))
    pairs = lists.select(group, F.explode(pair).alias("p")).select(group, "p.*")
    return pairs.groupBy("entity_a", "entity_b").agg(F.count("*").alias("strength"), F.min(group).alias("first_group"))


def reachable(edges: DataFrame, seeds: DataFrame, depth: int = 2) -> DataFrame:
    """(seed, node, hops): nodes within ``depth`` steps of each seed over undirected edges (entity_a, entity_b), by the fewest steps.

    The hops are unrolled joins; each hop's frontier drops what is reached before it is joined again.
    """
    both = edges.select(F.col("entity_a").alias("node"), F.col("entity_b").alias("next")).unionByName(edges.select(F.col("entity_b").alias("node"), F.col("entity_a").alias("next"))).distinct()
    frontier = seeds.select(F.col("seed"), F.col("seed").alias("node"), F.lit(0).alias("hops")).distinct()
    seen = frontier
    for h in range(1, depth + 1):
        step = frontier.join(both, "node").select("seed", F.col("next").alias("node")).distinct()
        frontier = step.join(seen.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("hops", F.lit(h))
        seen = seen.unionByName(frontier)
    return seen


def noise(entities: DataFrame, links: DataFrame, least: int = 1) -> DataFrame:
    """(id, reason): entities without a usable name or without enough links."""
    n = links.groupBy(F.col("entity_id").alias("id")).agg(F.count("*").alias("n"))
    name = F.trim(F.coalesce("name", F.lit("")))
    reason = F.when(name == "", "empty").when(F.length(name) <= 2, "short").when(~name.rlike("[A-Za-z]"), "no letters").when(F.lower(name).isin(*NO_NAMES), "common word").when(F.coalesce("n", F.lit(0)) < least, "few links")
    return entities.join(n, "id", "left").select("id", reason.alias("reason")).where(F.col("reason").isNotNull())


def relation_type(between: Column) -> Column:
    """The type of a relation by the words between the two names, first list that occurs; related_to otherwise."""
    out = F.lit("related_to")
    for name, words in reversed(RELATIONS):
        out = F.when(F.lower(between).rlike(words), name).otherwise(out)
    return out


def entity_type(name: Column, context: Column | None = None) -> Column:
    """The type of an entity by words in its name or context, first list that occurs; null otherwise."""
    said = F.lower(name if context is None else F.concat_ws(" ", name, context))
    out = F.lit(None).cast("string")
    for kind, words in reversed(ENTITY_TYPES):
        out = F.when(said.rlike(words), kind).otherwise(out)
    return out


def owned_edges(links: DataFrame, memories: DataFrame, most: int = 15) -> DataFrame:
    """(agent, entity_a, entity_b): entities that an active memory of an agent links; the owner's evidence alone makes its edges."""
    active = memories.where("status = 'active'").select(F.col("id").alias("memory_id"), "agent")
    w = Window.partitionBy("memory_id").orderBy("entity_id")
    kept = links.join(active, "memory_id").withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most)
    x, y = kept.select("memory_id", "agent", F.col("entity_id").alias("entity_a")), kept.select("memory_id", F.col("entity_id").alias("entity_b"))
    return x.join(y, "memory_id").where("entity_a < entity_b").select("agent", "entity_a", "entity_b").distinct()


def searched(queries: DataFrame, entities: DataFrame, links: DataFrame, memories: DataFrame, depth: int = 2, limit: int = 20) -> DataFrame:
    """(query_id, id, rank): active memories of the asking agent that are linked to the named entities or those within ``depth`` steps, newest first.

    ``queries`` has (query_id, agent, name_key), ``entities`` (id, agent, name_key). An entity is a seed only if an active memory
    of the agent is linked to it. Of each entity only its newest ``limit`` memories can be among a query's newest, so no hub's memories are joined whole.
    """
    mine = links.join(memories.where("status = 'active'").select(F.col("id").alias("memory_id"), "agent", "updated_at"), "memory_id")
    seeds = queries.join(entities.select(F.col("id").alias("node"), "agent", "name_key"), ["agent", "name_key"]).select("query_id", "agent", "node")
    seeds = seeds.join(mine.select("agent", F.col("entity_id").alias("node")), ["agent", "node"], "left_semi").distinct()
    edges = owned_edges(links, memories)
    both = edges.select("agent", F.col("entity_a").alias("node"), F.col("entity_b").alias("next")).unionByName(edges.select("agent", F.col("entity_b").alias("node"), F.col("entity_a").alias("next")))
    seen = frontier = seeds
    for _ in range(depth):
        step = frontier.join(both, ["agent", "node"]).select("query_id", "agent", F.col("next").alias("node")).distinct()
        frontier = cut(step.join(seen, ["query_id", "agent", "node"], "left_anti"))
        seen = seen.unionByName(frontier)
    newest = [F.desc_nulls_last("updated_at"), "memory_id"]
    top = mine.withColumn("_r", F.row_number().over(Window.partitionBy("agent", "entity_id").orderBy(*newest))).where(F.col("_r") <= limit).select("agent", F.col("entity_id").alias("node"), "memory_id", "updated_at")
    found = seen.join(top, ["agent", "node"]).select("query_id", "memory_id", "updated_at").distinct()
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*newest))).where(F.col("rank") <= limit)
    return found.select("query_id", F.col("memory_id").alias("id"), "rank")


def promoted(sightings: DataFrame, key: list[str], member: str, least: int) -> DataFrame:
    """Names seen in at least ``least`` distinct members."""
    return sightings.groupBy(*key).agg(F.countDistinct(member).alias("n")).where(F.col("n") >= least)


def strongest(relations: DataFrame, key: list[str], strength: str) -> DataFrame:
    """Upsert of relations: of each key the highest strength and how much evidence there is."""
    return relations.groupBy(*key).agg(F.max(strength).alias("strength"), F.count("*").alias("n_evidence"))


def named(entities: DataFrame, links: DataFrame, memories: DataFrame) -> DataFrame:
    """(agent, key, id): which entity of each agent a name or alias means.

    ``entities`` has (id, agent, name, aliases array). An agent's own entity goes before one of no agent, which counts only if a memory of the
    agent is linked to it; a name goes before an alias, and the smaller id before the other. Aliases are compared in their comparable form, each once.
    """
    each = F.concat(F.array(F.struct(F.lit(0).alias("alias"), text.entity_key(F.col("name")).alias("key"))), F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.struct(F.lit(1).alias("alias"), text.entity_key(a).alias("key"))))
    rows = entities.select("id", "agent", F.explode(each).alias("e")).select("id", "agent", "e.*").where(F.coalesce("key", F.lit("")) != "")
    users = links.join(memories.select(F.col("id").alias("memory_id"), F.col("agent").alias("user")), "memory_id").select(F.col("entity_id").alias("id"), "user").distinct()
    own = rows.where("agent IS NOT NULL").withColumn("free", F.lit(0))
    free = rows.where("agent IS NULL").drop("agent").join(users, "id").withColumnRenamed("user", "agent").withColumn("free", F.lit(1))
    both = own.unionByName(free.where("agent IS NOT NULL"))
    return both.groupBy("agent", "key").agg(F.min_by("id", F.struct("alias", "free", "id")).alias("id"))


def expanded(queries: DataFrame, names: DataFrame, entities: DataFrame, edges: DataFrame, most: int = 5) -> DataFrame:
    """(query_id, name, place): up to ``most`` names to search for: entities that pieces of a question name, in order, then those one step away.

    ``queries`` has (query_id, agent, phrases), ``names`` (agent, key, id) as of ``named``, ``entities`` (id, name), ``edges`` (agent, entity_a, entity_b).
    """
    asked = queries.select("query_id", "agent", F.posexplode("phrases").alias("at", "phrase")).withColumn("key", text.entity_key(F.col("phrase")))
    seeds = asked.join(names, ["agent", "key"]).groupBy("query_id", "agent", "id").agg(F.min("at").alias("at"))
    both = edges.select("agent", F.col("entity_a").alias("id"), F.col("entity_b").alias("next")).unionByName(edges.select("agent", F.col("entity_b").alias("id"), F.col("entity_a").alias("next")))
    near = seeds.join(both, ["agent", "id"]).select("query_id", "agent", F.col("next").alias("id"), F.col("at"), F.lit(1).alias("hop"))
    rows = seeds.withColumn("hop", F.lit(0)).unionByName(near, allowMissingColumns=True).join(entities.select("id", "name"), "id")
    first = rows.groupBy("query_id", F.lower("name").alias("low")).agg(F.min(F.struct("hop", "at", F.lower("name").alias("low"), "name")).alias("f"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("f"))
    return first.withColumn("place", place).where(F.col("place") <= most).select("query_id", F.col("f.name").alias("name"), "place")
