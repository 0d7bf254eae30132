"""Guards over free text: injected instructions, placeholder residue, and JSON from language models."""

from __future__ import annotations

import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BooleanType, StringType

from vaultframe.functions.text import col

# Signs of injected instructions, by layer and score.
PHRASES = ["ignore previous", "ignore all previous", "ignore above", "disregard previous", "disregard all previous", "you are now", "new instructions", "system prompt", "<system>", "</system>", "important:", "critical:", "override"]
ROLES = [r"you are (?:now |a |an |the )", r"act as (?:a |an |the |if )", r"pretend (?:you(?:'re| are) |to be )", r"(?:switch|change) (?:to |into )(?:a |an |the )?(?:new |different )?(?:role|mode|persona)", r"your (?:new |real |true )(?:role|purpose|function|task)"]
OVERRIDES = [r"(?:ignore|forget|discard|disregard) (?:all |any )?(?:previous|prior|above|earlier)", r"(?:new|updated|revised|real) (?:instructions?|directives?|rules?|guidelines?)", r"(?:do not|don't|never) (?:follow|obey|listen to|adhere to)", r"(?:bypass|circumvent|override|skip) (?:the |any |all )?(?:rules?|restrictions?|guidelines?|filters?|safety)"]
DELIMITERS = [r"</?(?:system|user|assistant|human|ai|bot|prompt|instruction)>", r"\[(?:SYSTEM|INST|/INST|SYS)\]", r"```(?:system|instructions?|prompt)\s*\n", r"={3,}(?:SYSTEM|PROMPT|INSTRUCTIONS?)={3,}"]
ZERO_WIDTH = r"[\x{200B}\x{200C}\x{200D}\x{FEFF}\x{00AD}\x{2060}-\x{2064}]"
MIXED_SCRIPTS = r"(?=\S{3,})(?=\S*[a-zA-Z])\S*[\x{0370}-\x{03FF}\x{0400}-\x{04FF}]"
PLACEHOLDERS = ["...", "string", "text", "todo", "tbd", "n/a", "none", "null", "placeholder", "example", "your text here", "fact", "narrative"]
INPUT_CHARS = 2000


@pandas_udf(BooleanType())
def normalization_deviates(texts: pd.Series) -> pd.Series:
    """Does compatibility decomposition change over five percent of the characters?"""

    def deviates(t: str | None) -> bool:
        if not t or t.isascii():
            return False
        n = unicodedata.normalize("NFKD", t)
        changed = sum(a != b for a, b in zip(t, n, strict=False)) + abs(len(t) - len(n))
        return changed / len(t) > 0.05

    return texts.map(deviates)


def injection(c) -> Column:
    """struct(detector, score) of the first layer that fires on the text's first 2000 characters; null and 0 if none."""
    t = F.substring(col(c), 1, INPUT_CHARS)
    lower = F.lower(t)
    phrase = F.lit(False)
    for p in PHRASES:
        phrase = phrase | lower.contains(p)
    any_of = lambda ps: t.rlike("(?i)" + "|".join(f"(?:{p})" for p in ps))
    layers = [(phrase, "legacy_pattern", 1.0), (any_of(ROLES), "role_injection", 0.9), (any_of(OVERRIDES), "instruction_override", 0.85), (any_of(DELIMITERS), "delimiter_injection", 0.8), (t.rlike(ZERO_WIDTH), "unicode_obfuscation", 0.7), (t.rlike(MIXED_SCRIPTS), "homoglyph", 0.7), (normalization_deviates(t), "normalization", 0.7)]
    name, score = F.when(F.lit(False), F.lit(None).cast("string")), F.when(F.lit(False), F.lit(0.0))
    for hit, n, s in layers:
        name, score = name.when(hit, n), score.when(hit, s)
    return F.struct(name.alias("detector"), score.otherwise(0.0).alias("score"))


def sanitized(c, threshold: float = 0.6) -> Column:
    return F.when(injection(c).score >= threshold, "[content filtered for security]").otherwise(col(c))


def placeholder(c) -> Column:
    """Empty, without letter or digit, a template mark alone, or a known placeholder word."""
    t = F.trim(F.lower(col(c)))
    bare = F.regexp_replace(t, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    return t.isNull() | ~t.rlike(r"[\p{L}\p{N}]") | t.rlike(r"^(\{\{.*\}\}|<[^>]*>|\[[^\]]*\])$") | bare.isin(*PLACEHOLDERS)


def safe_ids(c) -> Column:
    """A JSON array of numbers, or an empty array for anything else."""
    return F.filter(F.coalesce(F.from_json(col(c), "array<string>"), F.array().cast("array<string>")), lambda x: x.rlike(r"^-?\d+$")).cast("array<bigint>")


def repair_json(raw: str | None) -> str | None:
    """The first balanced JSON value in a model's reply; fences and trailing commas are repaired."""
    if not raw:
        return None
    text = re.sub(r"```(?:json)?", "", raw)
    starts = [m.start() for m in re.finditer(r"[{\[]", text)]
    for s in starts[:50]:
        depth, quoted, escaped = [], False, False
        for i in range(s, len(text)):
            ch = text[i]
            if quoted:
                escaped, quoted = (ch == "\\" and not escaped), not (ch == '"' and not escaped)
            elif ch == '"':
                quoted = True
            elif ch in "{[":
                depth.append(ch)
            elif ch in "}]":
                if not depth or {"{": "}", "[": "]"}[depth.pop()] != ch:
                    break
                if not depth:
                    part = re.sub(r",\s*([}\]])", r"\1", text[s : i + 1])
                    try:
                        return json.dumps(json.loads(part), ensure_ascii=False)
                    except ValueError:
                        break
    return None


@pandas_udf(StringType())
def model_json(replies: pd.Series) -> pd.Series:
    return replies.map(repair_json)


def neutral_tags(c) -> Column:
    """Angle brackets of prompt-like tags become harmless."""
    return F.regexp_replace(col(c), r"(?i)<(/?(?:system|user|assistant|human|ai|prompt|instruction)[^>]*)>", "&lt;$1&gt;")
