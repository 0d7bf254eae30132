"""What surrounds a retrieval: folder contexts, facts for a prompt, proximity and session focus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vaultframe.functions.text import let, tokens
from vaultframe.operators.windows import top_per
from vaultframe.sources.scratch import written


def inherited_context(docs: DataFrame, contexts: DataFrame) -> DataFrame:
    """(id, context): all contexts(collection, prefix, context) whose prefix covers the path, general to specific.

    A document meets only its own path's ancestors, so this is an equi-join.
    """
    parts = F.split("path", "/")
    ancestors = F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.when(F.size(parts) > 1, F.array_join(F.slice(parts, 1, n), "/")).otherwise("")))
    flat = docs.select("id", "collection", F.explode(F.array_distinct(ancestors)).alias("prefix"))
    hit = flat.join(contexts, ["collection", "prefix"])
    return hit.groupBy("id").agg(F.concat_ws("\n\n", F.transform(F.sort_array(F.collect_list(F.struct(F.length("prefix").alias("n"), "prefix", "context"))), lambda c: c.context)).alias("context"))


def uncovered(docs: DataFrame, contexts: DataFrame) -> DataFrame:
    """(collection, top, n): top-level folders that no context covers."""
    tops = docs.where(F.col("path").contains("/")).groupBy("collection", F.split("path", "/").getItem(0).alias("top")).agg(F.count("*").alias("n"))
    covered = contexts.select("collection", F.split("prefix", "/").getItem(0).alias("top"))
    whole = contexts.where("prefix = ''").select("collection")
    return tops.join(covered.distinct(), ["collection", "top"], "left_anti").join(whole.distinct(), "collection", "left_anti")


#: Places that a window of all words may have beyond their number.
PROXIMITY_SLACK = 4


def _constraints(query: Column) -> Column:
    """The query's distinct words in order, without those that another one starts with."""
    return let(F.array_distinct(tokens(query)), lambda ws: F.filter(ws, lambda w: ~F.exists(ws, lambda o: (o != w) & F.startswith(o, w))))


def _proximity_class(words: Column, wanted: Column) -> Column:
    """0: words that start with the wanted ones follow each other somewhere; 1: all lie in a small window; else 2."""
    n = F.size(wanted)
    starts = F.sequence(F.lit(0), F.size(words) - n)
    adjacent = F.exists(starts, lambda p: F.forall(F.sequence(F.lit(0), n - 1), lambda i: F.startswith(F.get(words, p + i), F.get(wanted, i))))
    which = lambda w: F.array_max(F.transform(wanted, lambda s, i: F.when(F.startswith(w, s), i).otherwise(-1)))
    spots = F.filter(F.transform(words, lambda w, pos: F.struct(pos.alias("pos"), which(w).alias("i"))), lambda m: m["i"] >= 0)
    far = F.lit(2**31 - 1)

    def step(state: Column, m: Column) -> Column:
        last = F.transform(state["last"], lambda x, j: F.when(j == m["i"], m["pos"]).otherwise(x))
        return let(last, lambda at: F.struct(at.alias("last"), F.when(F.array_min(at) < 0, state["best"]).otherwise(F.least(state["best"], m["pos"] - F.array_min(at) + 1)).alias("best")))

    span = F.aggregate(spots, F.struct(F.transform(wanted, lambda _: F.lit(-1)).alias("last"), far.alias("best")), step)["best"]
    near = let(span, lambda best: (best < far) & (best <= n + PROXIMITY_SLACK))
    return F.when(F.coalesce(F.size(words), F.lit(0)) < n, 2).when(adjacent, 0).when(near, 1).otherwise(2)


def proximity_rank(found: DataFrame, docs: DataFrame, queries: DataFrame) -> DataFrame:
    """found(qid, id, rank) with class, field and place: for queries(qid, query) rows of class 0 come first, then 1, then 2,
    each in the order of rank. What was found is written, since it is read several times and few rows are sent to the texts.

    A class is the best of the fields path, title and body of docs(id, path, title, body); field is the first that has it, null for
    class 2. A word stands for all words that start with it. Queries of one word (of those that no other word of it
    starts with) and lists of one row keep their order, with null as class. Only texts that were found are read.
    """
    found = written(found, "found")
    listed = found.groupBy("qid").agg(F.count("*").alias("n")).where("n > 1")
    asked = queries.select("qid", _constraints(F.col("query")).alias("wanted")).where(F.size("wanted") > 1).join(listed.select("qid"), "qid", "left_semi")
    cut = docs.join(found.select("id").distinct(), "id", "left_semi").select("id", *(tokens(c).alias(c) for c in ("path", "title", "body")))
    both = found.select("qid", "id").join(asked, "qid").join(cut, "id")
    fields = F.array(*(F.struct(_proximity_class(F.col(c), F.col("wanted")).alias("class"), F.lit(i).alias("at"), F.lit(c).alias("field")) for i, c in enumerate(("path", "title", "body"))))
    best = both.select("qid", "id", F.array_min(fields).alias("best"))
    classed = found.join(best.select("qid", "id", F.col("best.class").alias("class"), F.when(F.col("best.class") < 2, F.col("best.field")).alias("field")), ["qid", "id"], "left")
    return top_per(classed, ["qid"], [F.coalesce("class", F.lit(2)), F.col("rank"), F.col("id")], None, "place")


# Shapes of canonical ids and of proper nouns, characters that cut words, caps, and the block's ends.
CANONICAL_ID = r"(?<![a-zA-Z0-9_-])[a-z][a-z0-9-]*:[a-z_]+:[a-z0-9_](?:[a-z0-9_-]*[a-z0-9_])?(?![a-zA-Z0-9_-])"
PROPER_NOUN = r"(?<![A-Za-z0-9_])(?:[A-Z][a-z0-9]+(?:[A-Z][a-z0-9]*)*|[A-Z]{2,}[a-z0-9]*)(?![A-Za-z0-9_])"
WORD_CUTS = r"""[\s,;:!?"'`()\[\]{}<>]+"""
MOST_ENTITIES, MOST_GRAM = 100, 3
FACTS_OPEN, FACTS_CLOSE = "<vault-facts>\n", "\n</vault-facts>"


def prompt_entities(prompts: DataFrame, nodes: DataFrame, most: int = MOST_ENTITIES) -> DataFrame:
    """(pid, entity_id, via, place): entities that prompts(pid, prompt) name, of nodes(entity_id, name).

    Three ways, in this order: canonical ids; proper nouns; runs of one to three words, longer ones first, then in order of
    the prompt. A name counts only if a single entity has it. Candidates meet the dictionary by equality, whatever its size.
    """
    named = nodes.groupBy(F.lower("name").alias("key")).agg(F.min("entity_id").alias("entity_id"), F.count_distinct("entity_id").alias("n")).where("n = 1").drop("n")
    each = lambda found: F.posexplode(F.array_distinct(found)).alias("at", "key")
    ids = prompts.select("pid", each(F.regexp_extract_all("prompt", F.lit(CANONICAL_ID), F.lit(0)))).join(nodes.select(F.col("entity_id").alias("key")).distinct(), "key").select("pid", F.col("key").alias("entity_id"), F.lit("canonical-id").alias("via"), F.struct(F.lit(1), F.lit(0), "at").alias("turn"))
    nouns = prompts.select("pid", each(F.regexp_extract_all("prompt", F.lit(PROPER_NOUN), F.lit(0)))).withColumn("key", F.lower("key")).join(named, "key").select("pid", "entity_id", F.lit("proper-noun").alias("via"), F.struct(F.lit(2), F.lit(0), "at").alias("turn"))
    words = F.filter(F.transform(F.split("prompt", WORD_CUTS), lambda w: F.regexp_replace(w, r"^[^a-zA-Z0-9\-]+|[^a-zA-Z0-9\-]+$", "")), lambda w: w != "")
    cut = prompts.select("pid", words.alias("w"))

    def runs_of(n: int) -> Column:
        return F.when(F.size("w") >= n, F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.lower(F.array_join(F.slice("w", i, n), " ")))).otherwise(F.array().cast("array<string>"))

    grams = None
    for n in range(1, MOST_GRAM + 1):
        one = cut.select("pid", F.posexplode(runs_of(n)).alias("at", "key"), F.lit(-n).alias("size"))
        grams = one if grams is None else grams.unionByName(one)
    runs = grams.join(named, "key").select("pid", "entity_id", F.lit("ngram").alias("via"), F.struct(F.lit(3), "size", "at").alias("turn"))
    level = lambda df: df.select("pid", "entity_id", "via", F.col("turn").cast("struct<a:int,b:int,c:int>").alias("turn"))
    first = level(ids).unionByName(level(nouns)).unionByName(level(runs)).groupBy("pid", "entity_id").agg(F.min("turn").alias("turn"), F.min_by("via", "turn").alias("via"))
    return top_per(first, ["pid"], [F.col("turn"), F.col("entity_id")], most, "place").drop("turn")


def fact_lines(triples: DataFrame, nodes: DataFrame, now: Column, per_entity: int = 10) -> DataFrame:
    """(entity_id, line, nth): an entity's current facts as lines, those it is the subject of first, then by id."""
    s, o = nodes.select(F.col("entity_id").alias("subject"), F.col("name").alias("s_name")), nodes.select(F.col("entity_id").alias("object_entity"), F.col("name").alias("o_name"))
    current = triples.where(F.col("valid_to").isNull() | (F.col("valid_to") > now)).join(s, "subject", "left").join(o, "object_entity", "left")
    line = F.concat_ws(" ", F.coalesce("s_name", "subject"), "predicate", F.coalesce("o_name", "object_literal", "object_entity"))
    sides = F.array(F.struct(F.col("subject").alias("entity_id"), F.lit(0).alias("side")), F.struct(F.col("object_entity").alias("entity_id"), F.lit(1).alias("side")))
    facts = current.select("id", line.alias("line"), F.explode(sides).alias("e")).where("e.entity_id is not null").select("id", "line", "e.*")
    return top_per(facts, ["entity_id"], [F.col("side"), F.col("id")], per_entity, "nth").select("entity_id", "line", "nth")


def vault_facts(prompts: DataFrame, nodes: DataFrame, triples: DataFrame, now: Column, budget: int = 200, per_entity: int = 10) -> DataFrame:
    """(pid, entities, n_facts, block): the facts block of each prompt that names an entity with current facts.

    Facts come in order of the prompt's entities, each line once, as many as fit the budget of estimated tokens with the
    block's own ends; a prompt whose first fact does not fit has no block.
    """
    found = written(prompt_entities(prompts, nodes), "named")
    lines = found.join(fact_lines(triples, nodes, now, per_entity), "entity_id").groupBy("pid", "line").agg(F.min(F.struct("place", "nth")).alias("turn"))
    by = Window.partitionBy("pid").orderBy("turn", "line").rowsBetween(Window.unboundedPreceding, 0)
    ends = -(-len(FACTS_OPEN + FACTS_CLOSE) // 4)
    fitting = lines.withColumn("spent", F.sum(F.ceil(F.length("line") / 4) + 1).over(by) + ends).where(F.col("spent") <= budget)
    block = F.concat(F.lit(FACTS_OPEN), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "line"))), lambda x: x.line), "\n"), F.lit(FACTS_CLOSE))
    blocks = fitting.groupBy("pid").agg(F.count("*").alias("n_facts"), block.alias("block"))
    return found.groupBy("pid").agg(F.count("*").alias("entities")).join(blocks, "pid")


def session_focus(messages: DataFrame) -> DataFrame:
    """(conv_id, focus): the longest words of the last user message."""
    last = top_per(messages.where("role = 'user'"), ["conv_id"], [F.desc("turn")], 1)
    words = F.filter(F.array_distinct(tokens("text")), lambda w: F.length(w) > 4)
    return last.select("conv_id", F.slice(F.array_sort(words), 1, 5).alias("focus"))


def pack_batches(turns: DataFrame, most_messages: int, most_chars: int) -> DataFrame:
    """Adds batch: turns in order, a new batch when either bound would be passed. A conversation's sizes are folded."""
    start = F.struct(F.lit(0).alias("batch"), F.lit(0).alias("n"), F.lit(0).alias("chars"), F.array().cast("array<struct<turn:bigint,batch:int>>").alias("out"))

    def step(acc, x):
        opens = (acc.n > 0) & ((acc.n + 1 > most_messages) | (acc.chars + x.size > most_chars))
        b = acc.batch + F.when(opens, 1).otherwise(0)
        return F.struct(b.alias("batch"), (F.when(opens, 0).otherwise(acc.n) + 1).alias("n"), (F.when(opens, 0).otherwise(acc.chars) + x.size).alias("chars"), F.concat(acc.out, F.array(F.struct(x.turn.alias("turn"), b.alias("batch")))).alias("out"))

    sizes = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.length("text").alias("size")))).alias("xs"))
    return sizes.select("conv_id", F.explode(F.aggregate("xs", start, step).out).alias("o")).select("conv_id", "o.turn", "o.batch")


def directory_activity(docs: DataFrame, sessions: DataFrame, folder: str, most: int = 5) -> DataFrame:
    """(kind, id, at): recent decisions whose body names the folder and sessions that changed a file in it."""
    d = docs.where((F.col("content_type") == "decision") & F.col("body").contains(folder)).select(F.lit("decision").alias("kind"), F.col("id").cast("string").alias("id"), F.col("modified_at").alias("at"))
    s = sessions.where(F.exists("files_changed", lambda f: f.startswith(folder))).select(F.lit("session").alias("kind"), F.col("session_id").alias("id"), F.col("started_at").alias("at"))
    return top_per(d.unionByName(s), ["kind"], [F.desc("at"), F.col("id")], most)


def verified_references(answers: DataFrame, manifest: DataFrame) -> DataFrame:
    """(turn_id, path) of manifest(turn_id, path, name) whose path or unique name stands alone in the turn's answer(turn_id, text)."""
    once = F.count("*").over(Window.partitionBy("turn_id", "name")) == 1
    m = manifest.withColumn("once", once)
    bounded = lambda c: F.concat(F.lit(r"(?<![\p{L}\p{N}_/.-])\Q"), c, F.lit(r"\E(?![\p{L}\p{N}_/-])"))
    return m.join(answers, "turn_id").where(F.regexp(F.col("text"), bounded(F.col("path"))) | (F.col("once") & F.regexp(F.col("text"), bounded(F.col("name"))))).select("turn_id", "path")


def latest_attempt(states: DataFrame) -> DataFrame:
    """The state of the latest attempt per session."""
    return states.groupBy("session_id").agg(F.max_by(F.struct("attempt", "payload"), "attempt").alias("s")).select("session_id", "s.attempt", "s.payload")
