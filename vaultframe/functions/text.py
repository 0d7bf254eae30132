"""Scalar text functions as columns: tokens, identities, shingles, gates, classifiers, quality."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and word lists whose wording decides results.
WHY = r"\b(why|cause[ds]?|because|reason|led to|result(?:ed)? (?:in|from)|depend|block|chose|decision|trade-?off|instead of)\b"
WHEN = r"\b(when|timeline|chronolog|date|yesterday|last (?:week|month|year|night)|ago|before \d|after \d|(?:in|since|during|until) (?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec|\d{4}))\b"
ENTITY = r"\b(who|person|team|project|(?:@|#)\w+|relationship|mention|organization|company)\b"
TIMELINE_SIGNAL = r"\b(last session|yesterday|prior session|previous session|last time we|handoff|what happened last|what did we do|cross.session|earlier today|this morning|what we discussed|when we last)\b"
CAUSAL_SIGNAL = r"\b(why did|why was|why were|what caused|what led to|reason for|decided to|decision about|trade.?off|instead of|chose to|because we)\b"
DISCOVERY_SIGNAL = r"\b(similar to|related to|what else|what other|reminds? me of|like this|comparable|neighbors)\b"
COMPLEX_SIGNALS = [r"\band\s+(?:also|what|how|why)\b", r"\?.*\?", r"\b(?:additionally|as well as|along with)\b", r"\bboth\s+.+\s+and\s+"]
SEMANTIC_SIGNAL = r"\b(how does|explain|concept|overview|understand|meaning of|what is the purpose)\b"
RECENCY_SIGNALS = [r"\brecent(ly)?\b", r"\blatest\b", r"\blast\s+(session|time|week|month|few\s+days)\b", r"\bleft\s+off\b", r"\bwhere\s+(was|were)\s+(we|i)\b", r"\bpick\s+up\b", r"\bcontinue\b", r"\byesterday\b", r"\btoday\b", r"\bwhat\s+(was|were)\s+(we|i)\s+(doing|working)\b"]
SKIP_PROMPTS = [
    r"^(hi|hello|hey|good\s*(morning|afternoon|evening|night)|greetings|yo|sup|howdy|what'?s up)\b",
    r"^(run|build|test|ls|cd|git|npm|pip|docker|curl|cat|grep|find|make|sudo|bun|node|deno)\b",
    r"^(yes|no|yep|nope|ok|okay|sure|fine|thanks|thank you|thx|ty|got it|understood|cool|nice|great|good|perfect|awesome)\s*[.!]?$",
    r"^(go ahead|continue|proceed|do it|start|begin|next)\s*[.!]?$",
    r"^(ping|pong|test|debug)\s*[.!?]?$",
]
FORCE_PROMPTS = [r"\b(remember|recall|forgot|memory|memories)\b", r"\b(last time|before|previously|earlier|yesterday|ago)\b", r"\b(my (name|email|phone|address|birthday|preference))\b", r"\b(what did (i|we)|did i (tell|say|mention))\b"]
DENIALS = [r"i don'?t have (any )?(information|data|memory|record)", r"i'?m not sure about", r"i don'?t recall", r"i don'?t remember", r"no (relevant )?memories found", r"i don'?t have access to"]
HEARTBEATS = ["heartbeat", "health check", "keepalive", "keep-alive", "status check", "are you alive", "still alive", "ping", "pong"]
EMOJI_ONLY = r"^[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{2190}-\x{21FF}\x{2B00}-\x{2BFF}\x{FE0F}\x{200D}0-9#*\s]+$"
DECISION_WORDS = r"\b(decided?\s+to|chose|will\s+use|switching\s+to|going\s+with|selected|adopted)\b"
CORRECTION_WORDS = r"\b(fix(ed)?|bug|resolved|corrected|patched|root\s+cause)\b"
PROCEDURE_WORDS = r"\b(step\s+\d|workflow|recipe|how\s+to|procedure|runbook|playbook)\b"
NEGATION = r"\b(not|never|no|don['’]t|didn['’]t|won['’]t|cannot|can['’]t|wasn['’]t|isn['’]t|aren['’]t|weren['’]t|shouldn['’]t|couldn['’]t|wouldn['’]t)\b"
NUMBER = r"\b\d{1,5}(?:[.,/-]\d{1,5}){0,2}\b"
ANCHOR_STOPWORDS = "the a an this that these those it we i he she they you me him her us them and but or not is was are were be been being have has had do does did will would should could can may might must shall in on at to for of with by from if then else when while where how why all any some no one two".split()
TYPE_HINTS = [
    ("decision", ["decision", "adr/", "adr-"]),
    ("hub", ["hub", "moc", "/index.md$"]),
    ("research", ["research", "investigation", "analysis"]),
    ("project", ["project", "epic", "initiative"]),
    ("handoff", ["handoff", "handover", "session"]),
    ("conversation", ["conversation", "convo", "chat", "transcript"]),
    ("progress", ["progress", "status", "standup", "changelog"]),
]


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ascii_bounds(pattern: str) -> str:
    """The pattern with word boundaries between ASCII word characters and others; Java 17's own ones also see other letters."""
    return pattern.replace(r"\b", "(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))")


def matches(c, *patterns: str) -> Column:
    """Does any pattern occur? Case does not count."""
    return col(c).rlike(ascii_bounds("(?i)" + "|".join(f"(?:{p})" for p in patterns)))


def tokens(c) -> Column:
    return F.filter(F.split(F.lower(col(c)), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def spaced(c) -> Column:
    """The ``tokens`` of the text with one space between them, and perhaps at the ends."""
    return F.regexp_replace(F.lower(col(c)), r"[^\p{L}\p{N}]+", " ")


def normalized_hash(c) -> Column:
    return F.sha2(F.trim(F.regexp_replace(F.lower(col(c)), r"\s+", " ")), 256)


def query_hash(c) -> Column:
    return F.substring(F.sha1(F.lower(F.trim(col(c)))), 1, 12)


def canonical_id(collection, path) -> Column:
    return F.substring(F.sha2(F.concat_ws("/", col(collection), col(path)), 256), 1, 16)


def docid(h) -> Column:
    return F.substring(col(h), 1, 6)


def similarity_ratio(a, b) -> Column:
    """1 - edit distance / longer length; equal empty texts are alike."""
    longer = F.greatest(F.length(col(a)), F.length(col(b)))
    return F.when(longer == 0, 1.0).otherwise(1 - F.levenshtein(col(a), col(b)) / longer)


def let(value: Column, body) -> Column:
    """body(value) with value computed once, also inside the lambdas of body."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shingles(c) -> Column:
    """Word pairs and words of more than three letters, distinct."""

    def of(words: Column) -> Column:
        pairs = F.when(F.size(words) > 1, F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))
        return F.array_distinct(F.concat(pairs, F.filter(words, lambda w: F.length(w) > 3)))

    return let(F.filter(F.split(F.regexp_replace(F.lower(col(c)), r"[^\w\s]", ""), r"\s+"), lambda w: w != ""), of)


def jaccard(a, b) -> Column:
    union = F.size(F.array_union(col(a), col(b)))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(col(a), col(b))) / union)


def trigrams(c) -> Column:
    """All character 3-grams of the text in [a-z0-9 ], repeats included; a shorter text is one gram."""

    def of(s: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.length(s) - 2), lambda i: F.substring(s, i, F.lit(3)))
        return F.when(F.length(s) == 0, F.array().cast("array<string>")).when(F.length(s) < 3, F.array(s)).otherwise(grams)

    return let(gram_text(c), of)


def gram_text(c) -> Column:
    """The text that ``trigrams`` are cut from: lower case, in [a-z0-9 ]."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(col(c)), "[^a-z0-9 ]+", " "), r"\s+", " "))


def anchors(c) -> Column:
    """Capitalised words, lower-cased, without common ones."""
    found = F.regexp_extract_all(col(c), F.lit(ascii_bounds(r"\b([A-Z][a-zA-Z0-9]{1,})\b")), F.lit(1))
    return F.array_distinct(F.array_except(F.transform(found, F.lower), F.array(*map(F.lit, ANCHOR_STOPWORDS))))


def estimate_tokens(c) -> Column:
    return F.ceil(F.length(col(c)) / 4)


def slug(c) -> Column:
    return F.trim(F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", "-"), F.lit("-"))


def entity_id(vault, kind, name) -> Column:
    return F.concat_ws(":", col(vault), col(kind), F.regexp_replace(F.trim(F.lower(col(name))), r"[^a-z0-9]+", "_"))


def digit_runs(c) -> Column:
    return F.regexp_extract_all(col(c), F.lit(r"(\d+)"), F.lit(1))


def content_type(path, explicit=None) -> Column:
    lower = F.lower(col(path))
    out = None
    for name, hints in TYPE_HINTS:
        hit = None
        for h in hints:
            one = lower.rlike(h) if h.endswith("$") else lower.contains(h)
            hit = one if hit is None else hit | one
        out = F.when(hit, name) if out is None else out.when(hit, name)
    out = out.otherwise("note")
    return out if explicit is None else F.coalesce(col(explicit), out)


def memory_type(path, kind, body) -> Column:
    return F.when(col(kind).isin("handoff", "progress", "conversation"), "episodic").when(col(kind).isin("decision", "deductive", "hub", "research"), "semantic").when(matches(body, PROCEDURE_WORDS) | col(path).rlike("sop|runbook|playbook"), "procedural").otherwise("semantic")


def quality_score(body, meta_fields: int | Column = 0) -> Column:
    """Additive rules, in steps of 1/100 so that sums are exact, clamped to [0, 1]."""
    b = col(body)
    fields = meta_fields if isinstance(meta_fields, Column) else F.lit(meta_fields)
    points = F.lit(30)
    for rule, gain in ((F.length(b) > 200, 10), (F.length(b) > 500, 10), (b.rlike(r"(?m)^##\s+"), 10), (b.rlike(r"(?m)^[-*]\s+"), 5), (matches(b, DECISION_WORDS), 15), (matches(b, CORRECTION_WORDS), 10), (F.length(b) < 50, -10)):
        points = points + F.when(rule, gain).otherwise(0)
    return F.greatest(F.lit(0), F.least(F.lit(100), points + F.least(F.lit(15), fields * 5))) / 100


def intent(c) -> Column:
    """struct(intent, confidence) by signal words; ties resolve in the order WHY, WHEN, ENTITY, WHAT."""
    from vaultframe.functions.temporal import has_constraint

    q = F.lower(col(c))
    why = F.when(matches(q, WHY), 3).otherwise(0) + F.when(q.rlike(r"^why\b"), 2).otherwise(0)
    when = F.when(matches(q, WHEN), 3).otherwise(0) + F.when(has_constraint(q), 2).otherwise(0) + F.when(q.rlike(r"^when\b"), 2).otherwise(0)
    entity = F.when(matches(q, ENTITY), 3).otherwise(0) + F.when(q.rlike(r"^who\b"), 2).otherwise(0)
    best = F.greatest(why, when, entity)
    name = F.when(best == 0, "WHAT").when(why == best, "WHY").when(when == best, "WHEN").otherwise("ENTITY")
    return F.struct(name.alias("intent"), F.when(best == 0, 0.6).otherwise(F.least(F.lit(95), 60 + best * 10) / 100).alias("confidence"))


def retrieval_mode(c) -> Column:
    q = F.lower(col(c))
    keyword = (F.length(q) < 50) & (col(c).rlike(r"[A-Z][A-Z0-9_]{2,}") | F.trim(q).rlike(r"[\w-]+\.\w{2,4}\b") | q.rlike(r"\b(config|setting|error|path|file|port|url)\b"))
    return (
        F.when(matches(q, TIMELINE_SIGNAL), "timeline")
        .when(matches(q, CAUSAL_SIGNAL) | F.trim(q).rlike(r"^why\b"), "causal")
        .when(matches(q, DISCOVERY_SIGNAL), "discovery")
        .when(matches(q, *COMPLEX_SIGNALS), "complex")
        .when(keyword, "keyword")
        .when(matches(q, SEMANTIC_SIGNAL), "semantic")
        .otherwise("hybrid")
    )


def recency_intent(c) -> Column:
    return matches(c, *RECENCY_SIGNALS)


def normalised_prompt(c) -> Column:
    """A prompt without metadata headers, a scheduler's wrapper or a time stamp in front."""
    strip = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    t = F.regexp_replace(strip(col(c)), r"(?im)^(Conversation info|Sender) \(untrusted metadata\):[\s\S]*?\n\s*\n", "")
    t = F.regexp_replace(strip(t), r"(?i)^\[cron:[^\]]+\]\s*", "")
    return strip(F.regexp_replace(strip(t), r"^\[[A-Za-z]{3}\s\d{4}-\d{2}-\d{2}\s\d{2}:\d{2}\s[^\]]+\]\s*", ""))


def skip_retrieval(c) -> Column:
    t = normalised_prompt(c)
    cjk = t.rlike(r"[\x{4e00}-\x{9fff}\x{3040}-\x{309f}\x{30a0}-\x{30ff}\x{ac00}-\x{d7af}]")
    short = (F.length(t) < F.when(cjk, 6).otherwise(15)) & ~t.contains("?") & ~t.contains("？")
    return F.when(matches(t, *FORCE_PROMPTS), False).otherwise((F.length(t) < 5) | matches(t, *SKIP_PROMPTS) | t.rlike(EMOJI_ONLY) | short)


def retrieved_noise(c) -> Column:
    t = F.trim(col(c))
    return (F.length(t) < 10) | matches(t, *DENIALS)


def heartbeat(c) -> Column:
    t = F.lower(F.trim(col(c)))
    return (t == "") | t.startswith("/") | t.rlike(r"(?<![\p{L}\p{N}])(?:" + "|".join(HEARTBEATS) + r")(?![\p{L}\p{N}])")


def has_negation(c) -> Column:
    return matches(c, NEGATION)


def numbers(c) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(col(c), F.lit(ascii_bounds(f"({NUMBER})")), F.lit(1)), lambda n: F.replace(n, F.lit(","), F.lit(""))))


def contradiction(a, b) -> Column:
    """struct(contradictory, confidence, reason): one side negates, or both cite numbers and share none."""
    asymmetric = has_negation(a) != has_negation(b)
    na, nb = numbers(a), numbers(b)
    disjoint = (F.size(na) > 0) & (F.size(nb) > 0) & ~F.arrays_overlap(na, nb)
    return F.struct((asymmetric | disjoint).alias("contradictory"), F.when(asymmetric, 0.6).when(disjoint, 0.5).otherwise(0.0).alias("confidence"), F.when(asymmetric, "negation").when(disjoint, "numbers").otherwise("none").alias("reason"))


def glob_pattern(glob: str) -> str:
    """A path glob as a regular expression: ** crosses folders, * and ? do not, braces list choices."""
    out, i, depth = "", 0, 0
    while i < len(glob):
        c = glob[i]
        if glob[i : i + 3] == "**/":
            out, i = out + "(?:.*/)?", i + 2
        elif glob[i : i + 2] == "**":
            out, i = out + ".*", i + 1
        elif c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        else:
            out += c if c.isalnum() or c in "_/-" else "\\" + c
        i += 1
    return f"^{out}$"


def line_slice(body, first: int, n: int) -> Column:
    return F.array_join(F.slice(F.split(col(body), "\n", -1), first, n), "\n")


def snippet(body, terms: list[str], width: int = 500) -> Column:
    """The first line with the most terms, one line before and three after, cut to width."""
    lines = F.split(col(body), "\n", -1)
    score = F.transform(lines, lambda s: sum((F.when(F.lower(s).contains(t.lower()), 1).otherwise(0) for t in terms), F.lit(0)))
    at = F.array_position(score, F.array_max(score)).cast("int")
    text = F.array_join(F.slice(lines, F.greatest(F.lit(1), at - 1), F.lit(4) + F.when(at > 1, 1).otherwise(0)), "\n")
    return F.when(F.length(text) > width, F.concat(F.substring(text, 1, width - 3), F.lit("..."))).otherwise(text)


def add_line_numbers(body, start: int = 1) -> Column:
    return F.array_join(F.transform(F.split(col(body), "\n", -1), lambda s, i: F.concat((i + start).cast("string"), F.lit(": "), s)), "\n")


def escape_xml(c) -> Column:
    out = col(c)
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def escape_csv(c) -> Column:
    quoted = F.concat(F.lit('"'), F.replace(col(c), F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(col(c).rlike('[",\n]'), quoted).otherwise(col(c))
