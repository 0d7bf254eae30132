"""Rules on prompts and excerpts: follow-ups, tool hints, gates, intent terms, cuts. All are native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vaultframe.functions.text import ascii_bounds, col, normalised_prompt

# Patterns and words that decide a rule.
ANAPHORA = r"\b(that|this|it|its|them|those|these|same|previous|above|earlier|aforementioned)\b"
OPENERS = r"^(ok|okay|and|but|also|now|then|so|next|again|more|expand|elaborate|continue|go (on|deeper|further|back)|keep going|deeper|further|why not|what about|how about|same (for|with))\b"
BACK_REFERENCE = r"\b(as (i|we|you) (said|mentioned|discussed|noted))\b|\b(the|your) (above|previous|last|earlier) (one|point|question|answer|step|suggestion)\b"
BACK_OBJECT = r"\b(on|about|into|regarding|from|of|to)\s+(that|this|those|these|it)\b|\bthe\s+(above|previous|last|earlier|prior|preceding)\b"
STRONG_MOVE = r"^(?:(?:ok|okay|and|but|also|now|then|so|yes|right|great)[,\s]+)?(?:expand|elaborate|continue|more|go (?:on|deeper|further|back)|keep going|deeper|further)\b"
CONTENT_STOPWORDS = (
    "a an the of in on at to for from with by and or but is are was were be been being do does did can could should would will shall may might must have has had i we you he "
    "she they me us my our your their what which who how when where why please bit little very really just some any more that this it its them those these same previous above earlier "
    "ok okay also now then so again expand elaborate continue explain tell about not no yes"
).split()
INTENT_STOPWORDS = (
    "a an the and or but in on at to for of with by from is are was were be been being have has had do does did will would could should may might shall can about how "
    "what when where which who whom why this that these those it its not no so if then than"
).split()
SESSION_SIGNALS = r"\b(last session|yesterday|prior session|previous session|last time we|handoff|what happened last|what did we do|cross.session|earlier today|what we discussed|when we last)\b"
CAUSAL_SIGNALS = r"\b(why did|why was|why were|what caused|what led to|reason for|decided to|decision about|trade.?off|instead of|chose to)\b|^why\b"
DISCOVERY_SIGNALS = r"\b(similar to|related to|what else|what other|reminds? me of|like this)\b"
HINT = "If searching memory for this: use {} or memory_retrieve, NOT query."
INTENT_CHUNK_WEIGHT = 0.5
GATE_CHARS = 4000
FRAGMENT_CHARS, FRAGMENTS, SPLIT_CHARS = 50, 500, 500_000


def _in(word: Column, words: list[str]) -> Column:
    return word.isin(*words)


def content_tokens(c) -> Column:
    """Distinct words that carry a topic."""
    return F.array_distinct(F.filter(F.split(F.lower(col(c)), r"[^\p{L}\p{N}]+"), lambda w: (F.length(w) > 1) & ~_in(w, CONTENT_STOPWORDS)))


def prior_context(c) -> Column:
    """Why the prompt needs the turns before it: the reason, ``self-sufficient`` if it doesn't."""
    t = normalised_prompt(c)
    n = F.size(content_tokens(t))
    has = lambda p: t.rlike("(?i)" + ascii_bounds(p))
    return (
        F.when(has(BACK_REFERENCE), "conversation-backref")
        .when(has(STRONG_MOVE) & has(BACK_OBJECT), "continuation-deictic")
        .when(has(OPENERS) & (n < 8), "continuation-opener")
        .when(has(ANAPHORA) & (n < 6), "anaphora-low-content")
        .when(n < 3, "underspecified")
        .otherwise("self-sufficient")
    )


def routing_hint(c) -> Column:
    """Which tool fits a prompt about sessions, causes or likeness; null for others."""
    t = F.lower(col(c))
    return F.when(t.rlike(ascii_bounds(SESSION_SIGNALS)), HINT.format("session_log")).when(t.rlike(ascii_bounds(CAUSAL_SIGNALS)), HINT.format("intent_search")).when(t.rlike(ascii_bounds(DISCOVERY_SIGNALS)), HINT.format("find_similar"))


def intent_terms(c) -> Column:
    """Words of an intent, without stop words and punctuation; repeats stay."""
    words = F.filter(F.split(F.lower(col(c)), r"\s+"), lambda w: (F.length(w) > 1) & ~_in(w, INTENT_STOPWORDS))
    return F.filter(F.transform(words, lambda w: F.regexp_replace(w, "[^a-z0-9-]", "")), lambda w: F.length(w) > 1)


def gate_tokens(title, body, chars: int = GATE_CHARS) -> Column:
    """Distinct words of a title and a body's first ``chars`` characters."""
    t = F.lower(F.concat(F.coalesce(col(title), F.lit("")), F.lit(" "), F.substring(F.coalesce(col(body), F.lit("")), 1, chars)))
    return F.array_distinct(F.filter(F.split(t, r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 1))


def passes_gate(tokens, gate) -> Column:
    """Does a document's word start with a word of the query? No query word lets nothing pass."""
    return F.exists(col(tokens), lambda t: F.exists(col(gate), lambda g: F.startswith(t, g)))


def _last(t: Column, what: str) -> Column:
    """0-based place of the last occurrence, -1 without one."""
    at = F.instr(F.reverse(t), what[::-1])
    return F.when(at > 0, F.length(t) - at - len(what) + 1).otherwise(-1)


def smart_truncate(c, most: int = 300) -> Column:
    """At most ``most`` characters, cut at a paragraph, sentence, line or word that ends in the second half."""
    t = F.substring(col(c), 1, most)
    trimmed = lambda x: F.regexp_replace(x, r"\s+$", "")
    head = lambda at: trimmed(F.left(t, at))
    sentence = F.regexp_extract(t, r"(?s)^(.+[.!?])\s", 1)
    para, line, word = _last(t, "\n\n"), _last(t, "\n"), _last(t, " ")
    half = most * 0.5
    return (
        F.when(F.length(col(c)) <= most, col(c))
        .when(para > half, head(para))
        .when(F.length(sentence) > half, sentence)
        .when(line > half, head(line))
        .when(word > half, F.concat(head(word), F.lit("...")))
        .otherwise(F.concat(trimmed(t), F.lit("...")))
    )


def windows_of(c, size: int = 4000, overlap: int = 200) -> Column:
    """Character windows that overlap; the last one reaches the end."""
    n = F.greatest(F.lit(1), F.ceil((F.length(col(c)) - overlap) / (size - overlap)).cast("int"))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(col(c), i * (size - overlap) + 1, F.lit(size)))


def best_window(c, query_terms, terms, size: int = 4000, overlap: int = 200) -> Column:
    """The window with most query terms (1) and intent terms (0.5), the first of equals; without intent the first."""
    hit = lambda w, ts: F.size(F.filter(ts, lambda t: F.contains(F.lower(w), t)))
    score = lambda w: hit(w, col(query_terms)) + INTENT_CHUNK_WEIGHT * hit(w, col(terms))
    scored = F.transform(windows_of(c, size, overlap), lambda w, i: F.struct(score(w).alias("score"), (-i).alias("place"), w.alias("w")))
    return F.when((F.size(col(terms)) > 0) & (F.length(col(c)) > size), F.array_max(scored)["w"]).otherwise(F.substring(col(c), 1, size))


def observation_fragments(body, facts, narrative) -> Column:
    """Array of (type, content): the body, its facts (a JSON list; no JSON, no facts) and narrative, long ones only."""
    part = lambda kind, c: F.struct(F.lit(kind).alias("type"), c.alias("content"))
    known = F.filter(F.from_json(col(facts), "array<string>"), lambda x: F.length(x) >= FRAGMENT_CHARS)
    known = F.transform(F.slice(F.coalesce(known, F.array().cast("array<string>")), 1, FRAGMENTS - 1), lambda x: part("fact", x))
    told = F.filter(F.array(part("narrative", col(narrative))), lambda p: F.length(p["content"]) >= FRAGMENT_CHARS)
    return F.slice(F.concat(F.array(part("full", F.substring(col(body), 1, SPLIT_CHARS))), known, told), 1, FRAGMENTS)


def cache_key(url, body: Column) -> Column:
    """Key of a model call: the address and the JSON of its request."""
    return F.sha2(F.concat(col(url), F.to_json(body, {"ignoreNullFields": "false"})), 256)
