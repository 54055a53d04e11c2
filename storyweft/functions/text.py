"""Text functions over columns: tokenisers, Jaccard, contradiction, article types.  All are native expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from storyweft.functions import lexicons as lex


def squeezed(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+", " "))


def tokens_simple(title: Column, least: int = 3) -> Column:
    """The set of lower-cased runs of letters and digits of at least `least` characters."""
    parts = F.split(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), r"[^\p{L}\p{N}\s]", " "), r"\s+")
    return F.array_distinct(F.filter(parts, lambda t: F.length(t) >= least))


def _kept(title: Column, stop: Sequence[str]) -> Column:
    parts = F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), "[^a-z0-9]+", " ")), " ")
    return F.filter(parts, lambda t: (F.length(t) > 1) & ~t.isin(*stop))


def stem(token: Column) -> Column:
    """strips the first suffix that leaves more than two characters."""
    out = token
    for s in reversed(lex.SUFFIXES):
        out = F.when(token.endswith(s) & (F.length(token) > len(s) + 2), F.substring(token, F.lit(1), F.length(token) - len(s))).otherwise(out)
    return out


def tokens_norm(title: Column) -> Column:
    """ASCII tokens without stop words, stemmed, in order."""
    return F.transform(_kept(title, lex.TITLE_STOP_WORDS), stem)


def tokens_eval(title: Column) -> Column:
    """As tokens_norm, without stemming."""
    return _kept(title, lex.TITLE_STOP_WORDS)


def tokens_word(title: Column) -> Column:
    """Lower-cased words of a letter and one or more letters, digits or hyphens."""
    return F.transform(F.regexp_extract_all(F.coalesce(title, F.lit("")), F.lit(r"[A-Za-z][A-Za-z0-9\-]{1,}"), F.lit(0)), F.lower)


def jaccard(a: Column, b: Column, both_empty: float = 1.0) -> Column:
    """Size of intersection over size of union; both_empty where neither has a token."""
    a, b = F.array_distinct(a), F.array_distinct(b)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(both_empty)).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.size(F.array_union(a, b))))


def explain_jaccard(a: Column, b: Column, both_empty: float = 1.0) -> Column:
    return F.struct(a.alias("tokens_a"), b.alias("tokens_b"), F.array_sort(F.array_intersect(a, b)).alias("intersection"), F.array_sort(F.array_union(a, b)).alias("union"), jaccard(a, b, both_empty).alias("score"))


def conflicting_titles(a: Column, b: Column, negation: Sequence[str] = lex.NEGATION, assertive: Sequence[str] = lex.ASSERTIVE) -> Column:
    """At least two tokens in common, and one side denies what the other asserts."""
    a, b = tokens_simple(a), tokens_simple(b)
    has = lambda t, words: F.arrays_overlap(t, F.array(*map(F.lit, words)))
    return (F.size(F.array_intersect(a, b)) >= 2) & ((has(a, negation) & has(b, assertive)) | (has(b, negation) & has(a, assertive)))


def _any(text: Column, patterns: Sequence[str]) -> Column:
    return text.rlike("(?i)(?:" + "|".join(patterns) + ")")


def article_type(title: Column, summary: Column, url: Column, **lexicon: Sequence[str]) -> Column:
    """struct(type, reason) by a cascade of rules; lexicon overrides lists by their name in lower case."""
    of = lambda name: lexicon.get(name.lower(), getattr(lex, name))
    title, url = squeezed(title), F.coalesce(url, F.lit(""))
    text = F.concat(title, F.lit(" "), squeezed(summary))
    word = lambda p: rf"\b(?:{p})\b"
    categories = sum((_any(text, [word(p) for p in of(n)]).cast("int") for n in ("STANCE", "NORMATIVE", "VALUE")), F.lit(0))
    signals = sum((_any(text, [word(p)]).cast("int") for p in of("INTERPRET")), F.lit(0))
    prefix = lambda name: _any(title, [rf"^\s*{p}\s*:" for p in of(name)])
    rules = [
        (_any(url, of("URL_OPINION")), "COMMENTARY", "URL_OPINION"),
        (_any(url, of("URL_ANALYSIS")), "INTERPRETATION", "URL_ANALYSIS"),
        (prefix("TITLE_OPINION"), "COMMENTARY", "TITLE_PREFIX_OPINION"),
        (prefix("TITLE_ANALYSIS"), "INTERPRETATION", "TITLE_PREFIX_ANALYSIS"),
        (categories >= 2, "COMMENTARY", "TEXT_COMMENTARY_STRONG"),
        (signals >= 2, "INTERPRETATION", "TEXT_INTERPRET_STRONG"),
    ]
    out = F.struct(F.lit("FACT").alias("type"), F.lit("DEFAULT_FACT").alias("reason"))
    for test, kind, reason in reversed(rules):
        out = F.when(test, F.struct(F.lit(kind).alias("type"), F.lit(reason).alias("reason"))).otherwise(out)
    return out


def effective_type(raw: Column, mode: str = "list") -> Column:
    """The type to count; list names, matrix columns and gap buckets treat missing and odd types differently."""
    if mode == "gap":
        return F.when(raw.isNull() | (raw == "DEFAULT_FACT"), "FACT").otherwise(raw)
    if mode == "matrix":
        return effective_type(effective_type(raw, "gap"), "list")
    name = F.upper(F.trim(F.coalesce(raw, F.lit(""))))
    return F.when(name.isin("ANALYSIS", "EXPLAINER"), "INTERPRETATION").when(name.isin("OPINION", "EDITORIAL", "COMMENT"), "COMMENTARY").when(name.isin("FACT", "INTERPRETATION", "COMMENTARY"), name).otherwise("UNKNOWN")


def loose_list(x: Column) -> Column:
    """a JSON list of strings as an array; else the words of the text; else empty."""
    return F.coalesce(F.from_json(x, "array<string>", {"mode": "PERMISSIVE"}), tokens_word(x))


def source_name_zh(name: Column, aliases: dict[str, str] | None = None) -> Column:
    """The Chinese name by alias (in any case), then by rule, else the name itself, trimmed."""
    trimmed = F.trim(name)
    out = F.when(F.coalesce(trimmed, F.lit("")) == "", name).otherwise(trimmed)
    for pattern, zh in reversed(lex.SOURCE_RULES_ZH):
        out = F.when(trimmed.rlike(pattern), zh).otherwise(out)
    for alias, zh in (aliases or {}).items():
        out = F.when(F.lower(trimmed) == alias.lower(), zh).otherwise(out)
    return out


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over the code points of text."""
    chars = F.filter(F.split(F.coalesce(text, F.lit("")), ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(2166136261).cast("long"), lambda h, c: ((h.bitwiseXOR(F.ascii(c).cast("long"))) * 16777619).bitwiseAND(F.lit(0xFFFFFFFF)))
