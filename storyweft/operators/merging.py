"""Merge suggestions: X10 signatures, A13/A14 document frequency, X28 candidate pairs, X29 judgement."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from storyweft.functions import lexicons as lex
from storyweft.functions.text import jaccard, tokens_word
from storyweft.plans.adapters import hours_between
from storyweft.sources.shared import noted_dirs, removed, saved, shared_dir

URL = r"(?i)https?://\S+|www\.\S+"


def signature_words(text: Column) -> Column:
    """The words of a text that a signature may use."""
    cleaned = F.transform(tokens_word(F.regexp_replace(F.coalesce(text, F.lit("")), URL, " ")), lambda t: F.regexp_replace(t, "^[-']+|[-']+$", ""))
    return F.filter(cleaned, lambda t: (F.length(t) >= 2) & ~t.isin(*lex.SIGNATURE_STOP_WORDS) & ~t.rlike("^[0-9]+$"))


def signature_terms(text: Column, phrases: bool = True) -> Column:
    """With phrases: runs of capitalised words, then acronyms, then words, all in lower case."""
    if not phrases:
        return signature_words(text)
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), URL, " ")
    found = lambda p: F.transform(F.regexp_extract_all(plain, F.lit(p), F.lit(0)), lambda t: F.lower(F.regexp_replace(t, "^[-']+|[-']+$", "")))
    extra = F.concat(found(r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+\b"), found(r"\b[A-Z]{2,}\b"))
    return F.concat(F.filter(extra, lambda t: (F.length(t) >= 2) & ~t.isin(*lex.SIGNATURE_STOP_WORDS)), signature_words(text))


def signatures(stories: DataFrame, docs: DataFrame, top_n: int = 12, phrases: bool = True) -> DataFrame:
    """stories(story_id, title), docs(story_id, rn, title, summary) -> story_id, signature: the top_n terms by weighted votes.

    Titles of stories weigh 4, of documents 2, summaries 1; ties go to the term seen first.  Texts are dealt by story, and
    terms are counted where they are, so a text travels once and its many terms do not.
    """
    part = lambda order, weight, text: F.struct(order.cast("long").alias("o"), F.lit(weight).alias("w"), F.col(text).alias("text"))
    rows = stories.select("story_id", F.array(part(F.lit(0), 4, "title")).alias("p")).unionByName(
        docs.select("story_id", F.array(part(2 * F.col("rn") - 1, 2, "title"), part(2 * F.col("rn"), 1, "summary")).alias("p")))
    # a number of its own, as Spark would join partitions by the size of their texts, and the terms of a task take many times that
    parts = int(stories.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = rows.repartition(parts, "story_id").select("story_id", F.explode("p").alias("p"))
    terms = texts.select("story_id", "p.o", "p.w", F.posexplode(signature_terms(F.col("p.text"), phrases)).alias("i", "term"))
    votes = terms.groupBy("story_id", "term").agg(F.sum("w").alias("votes"), F.min(F.col("o") * (1 << 31) + F.col("i")).alias("first"))
    votes = votes.withColumn("rn", F.row_number().over(W.partitionBy("story_id").orderBy(F.col("votes").desc(), F.col("first"))))
    return votes.where(F.col("rn") <= top_n).groupBy("story_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rn", "term"))), lambda x: x.term).alias("signature"))


def signature_input(stories: DataFrame, articles: DataFrame, since: Column | None = None, most: int = 500, per_story: int = 5) -> DataFrame:
    """stories(story_id, title, ts, and title_override where there is one), articles(story_id, article_id, title, summary, published_at)
    -> story_id, title, ts, docs: the `most` newest stories from `since` on, each with its newest articles as structs (title, summary), an empty list without any."""
    title = F.coalesce("title_override", "title", F.lit("")) if "title_override" in stories.columns else F.coalesce("title", F.lit(""))
    fresh = stories.where(F.col("ts") >= since) if since is not None else stories.where("ts IS NOT NULL")
    fresh = fresh.orderBy(F.col("ts").desc(), F.col("story_id").desc()).limit(most).select("story_id", title.alias("title"), "ts")
    rn = F.row_number().over(W.partitionBy("story_id").orderBy(F.col("published_at").desc_nulls_last(), F.col("article_id").desc()))
    docs = articles.join(fresh.select("story_id"), "story_id", "left_semi").withColumn("rn", rn).where(F.col("rn") <= per_story)
    docs = docs.groupBy("story_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rn", "title", "summary"))), lambda x: F.struct(x["title"].alias("title"), x["summary"].alias("summary"))).alias("docs"))
    return fresh.join(docs, "story_id", "left").withColumn("docs", F.coalesce("docs", F.array().cast("array<struct<title: string, summary: string>>")))


def signed_stories(listed: DataFrame, top_n: int = 12, phrases: bool = True) -> DataFrame:
    """signature_input() -> story_id, ts, signature (empty without a term) and keywords_hit, its fixed keywords in order of name."""
    docs = listed.select("story_id", F.posexplode("docs").alias("i", "d")).select("story_id", (F.col("i") + 1).alias("rn"), "d.title", "d.summary")
    out = listed.select("story_id", "ts").join(signatures(listed.select("story_id", "title"), docs, top_n, phrases), "story_id", "left")
    out = out.withColumn("signature", F.coalesce("signature", F.array().cast("array<string>")))
    return out.withColumn("keywords_hit", F.array_sort(F.array_intersect("signature", F.array(*map(F.lit, lex.SIGNATURE_KEYWORDS)))))


def df_idf(stories: DataFrame) -> DataFrame:
    """stories(story_id, signature) -> token, df, idf."""
    n = stories.agg(F.count("*").alias("n"))
    df = stories.select(F.explode(F.array_distinct("signature")).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(n)).select("token", "df", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))


def _newer() -> Column:
    """Whether alias a comes before alias b by recency, then by id."""
    return (F.col("a.ts") > F.col("b.ts")) | (F.col("a.ts").eqNullSafe(F.col("b.ts")) & (F.col("a.story_id") > F.col("b.story_id"))) | (F.col("a.ts").isNotNull() & F.col("b.ts").isNull())


def lexical_pairs(stories: DataFrame, window_hours: float, least: float = 0.2) -> DataFrame:
    """Pairs within the window whose titles are alike, for stories without usable signatures.

    Titles with a Jaccard above 0 share a token (or are both empty), so an index of title tokens finds all of them.
    """
    t = stories.select("story_id", "ts", F.array_distinct(tokens_word(F.col("title"))).alias("t"))
    post = t.select("story_id", "ts", F.size("t").alias("n"), F.explode(F.when(F.size("t") == 0, F.array(F.lit(""))).otherwise(F.col("t"))).alias("token"))
    a, b = post.alias("a"), post.alias("b")
    near = F.abs(hours_between(F.col("a.ts"), F.col("b.ts"))) <= max(1, window_hours)
    both = a.join(b, (F.col("a.token") == F.col("b.token")) & near & _newer()).groupBy(F.col("a.story_id").alias("a"), F.col("b.story_id").alias("b")).agg(F.count("*").alias("k"), F.max("a.n").alias("n"), F.max("b.n").alias("m"), F.min("a.ts").alias("ts_a"), F.min("b.ts").alias("ts_b"))
    alike = F.when(F.col("n") + F.col("m") == 0, 1.0).otherwise(F.col("k") / (F.col("n") + F.col("m") - F.col("k")))
    return both.select("a", "b", alike.alias("weight"), F.lit(0).cast("long").alias("overlap"), F.lit(None).cast("long").alias("df_min"), "ts_a", "ts_b").where(F.col("weight") >= least)


#: How much longer the posting lists of each step of a threshold search may be.
STEP = 32


def _own(post: DataFrame, *columns: str) -> DataFrame:
    """post(story_id, token, df, idf) -> story_id, columns, own: the tokens that other stories may share as structs (df, token, idf), rarest first."""
    return post.where("df > 1").groupBy("story_id", *columns).agg(F.sort_array(F.collect_list(F.struct("df", "token", "idf"))).alias("own"))


def _total(own: Column) -> Column:
    return F.aggregate(own, F.lit(0.0), lambda s, x: s + x["idf"])


def _alive(sets: DataFrame, low: int, least: float) -> DataFrame:
    """The columns of sets, token and df: a row for each token in over `low` stories from which on own weighs at least `least`.

    The first token that two stories share, in the order of own, is followed by all others, so a pair that weighs `least`
    meets there.
    """
    at = F.transform("own", lambda x, i: F.struct(x["token"].alias("token"), x["df"].alias("df"), _total(F.slice("own", i + 1, F.size("own"))).alias("rest")))
    some = sets.select("*", F.explode(F.filter(at, lambda x: (x["df"] > low) & (x["rest"] >= least))).alias("at"))
    return some.select(*sets.columns, "at.token", "at.df")


def _common() -> Column:
    """What aliases a and b share, rarest first."""
    return F.array_intersect("a.own", "b.own")


def largest_weight(post: DataFrame, least: float = 0.0, made: list[int] | None = None) -> float | None:
    """The largest weight of any pair, at whatever distance, if it is over `least`; else least, or null where nothing pairs.

    A threshold search over post(story_id, token, df, idf): tokens come in steps of list length, rarest first.  A pair not
    met yet shares only tokens of the steps to come, so it weighs at most what either story has left in these; stories
    with less than the best pair so far drop out before each step, and the search ends when no token has two left.  Lists
    of the first step are short, so its pairs are linear in the stories, and the best of them leaves few for the others.
    Stories with the same tokens count once; two of them are a pair of which the weight is known beforehand.
    A story has a signature's few tokens, which travel with it, so pairs are weighed where they meet; what comes to the
    driver is two numbers a step, of which the number of pairs is appended to `made`.
    """
    sets = _own(post).groupBy("own").agg(F.min("story_id").alias("story_id"), F.count("*").alias("n"))
    sets = saved(sets, f"{shared_dir(post.sparkSession)}/sets")
    ends = sets.agg(F.max(F.element_at("own", -1)["df"]).alias("df"), F.max(F.element_at("own", 1)["idf"]).alias("idf"), F.max(F.when(F.col("n") > 1, _total(F.col("own")))).alias("twice")).first()
    if ends["df"] is None:
        return least or None
    best = max(least, ends["idf"] - 1e-9, ends["twice"] or 0.0)  # some pair shares the token of that idf
    sets = sets.drop("n")
    low, high = 1, STEP
    while True:
        step = _alive(sets, low, best - 1e-9).where(F.col("df") <= high)
        a, b = step.alias("a"), step.alias("b")
        found = a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("a.story_id") < F.col("b.story_id"))).agg(F.max(_total(_common())).alias("w"), F.count("*").alias("n")).first()
        best = max(best, found["w"] or 0.0)
        if made is not None:
            made.append(found["n"])
        if high >= ends["df"] or _alive(sets, high, best - 1e-9).groupBy("token").count().where("count > 1").isEmpty():
            return best
        low, high = high, high * STEP


class _Scores:
    """What a pair's weight, distance in hours and titles add to its score."""

    def __init__(self, top: float | None, window_hours: float, top_k: int, min_overlap: int):
        self.top, self.window_hours, self.top_k, self.min_overlap = top, window_hours, top_k, min_overlap

    def known(self) -> Column:
        """The score without the titles, which add at most 0.20."""
        return 0.70 * F.least(F.lit(1.0), F.col("weight") / F.lit(self.top).cast("double")) + 0.10 * F.greatest(F.lit(0.0), 1 - F.col("hours") / self.window_hours)

    def near(self, pairs: DataFrame) -> DataFrame:
        hours = F.coalesce(F.abs(hours_between(F.col("ts_a"), F.col("ts_b"))), F.lit(9999.0))
        out = pairs.where((F.col("overlap") == 0) | (F.col("overlap") >= self.min_overlap)).withColumn("hours", hours).where(F.col("hours") <= self.window_hours)
        return out.withColumn("known", self.known())

    def least(self, pairs: DataFrame, stories: DataFrame) -> float:
        """near() pairs -> a score that top_k of them reach, or 0: of the most promising by what is known, the titles are compared."""
        some = pairs.orderBy(F.col("known").desc()).limit(10 * self.top_k)
        title = lambda x: stories.select(F.col("story_id").alias(x), tokens_word(F.col("title")).alias(f"words_{x}"))
        some = some.join(title("a"), "a").join(title("b"), "b").select("weight", F.round(F.col("known") + 0.20 * jaccard(F.col("words_a"), F.col("words_b")), 4).alias("s"))
        best = some.where((F.col("s") >= 0.10) | (F.col("weight") >= 1.5)).orderBy(F.col("s").desc()).limit(self.top_k)
        return best.agg(F.when(F.count("*") == self.top_k, F.min("s")).otherwise(0.0).alias("s")).first()["s"]

    def least_weight(self, score: float) -> float:
        """What a pair has to weigh to reach a score."""
        return ((score - 5e-5) - 0.30) / 0.70 * (self.top or 0.0) - 1e-9

    def reach(self, score: float) -> float:
        """How many hours a pair may lie apart to reach a score."""
        return min(self.window_hours, self.window_hours * (1 - ((score - 5e-5) - 0.90) / 0.10) + 1e-6)


def top_pairs(post: DataFrame, stories: DataFrame, scores: _Scores, made: list[int] | None = None) -> DataFrame:
    """Of the pairs within the window, all that may be among the top_k: a, b, weight, overlap, df_min, ts_a, ts_b.

    The search of largest_weight(), with a score in place of a weight: top_k pairs that are known to reach a score rule out
    all pairs of too small a weight, and of too long a distance, to reach it.  The first such pairs are neighbours in time
    among the stories with the same tokens; each step of the search then adds its own.  A pair is weighed once, at the
    first token that it shares.  Lists are cut into time buckets as long as pairs may lie apart, so a story meets its own
    bucket and the one before.  Stories without a time are as far from all others as the gate's 9999 hours say.
    The number of pairs that each step joins is appended to `made`.
    """
    work = shared_dir(post.sparkSession)
    gated = scores.window_hours < 9999
    sets = saved(_own(post.where("ts IS NOT NULL") if gated else post, "ts"), f"{work}/sets")
    order = W.partitionBy("own").orderBy("ts", "story_id")
    twins = sets.select(F.col("story_id").alias("a"), F.col("ts").alias("ts_a"), F.lag("story_id").over(order).alias("b"), F.lag("ts").over(order).alias("ts_b"), _total(F.col("own")).alias("weight"), F.size("own").alias("overlap")).where("b IS NOT NULL")
    least = scores.least(scores.near(twins), stories) if scores.top else 0.0
    longest = sets.agg(F.max(F.element_at("own", -1)["df"])).first()[0] or 0
    found, low, high = [], 1, STEP
    while True:
        step = _alive(sets, low, scores.least_weight(least)).where(F.col("df") <= high)
        reach = scores.reach(least)
        on = (F.col("a.token") == F.col("b.token")) & _newer()
        if gated:
            step = step.withColumn("bucket", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (3.6e9 * max(reach, 0.1))))
            older = step.withColumn("bucket", F.explode(F.array(F.col("bucket"), F.col("bucket") + 1)))
            on = on & (F.col("a.bucket") == F.col("b.bucket")) & (hours_between(F.col("a.ts"), F.col("b.ts")) <= reach)
        else:
            older = step
        met = step.alias("a").join(older.alias("b"), on).select(F.col("a.story_id").alias("a"), F.col("b.story_id").alias("b"), "a.token", _common().alias("common"), F.col("a.df").alias("df_min"), F.col("a.ts").alias("ts_a"), F.col("b.ts").alias("ts_b"))
        met = met.where(F.element_at("common", 1)["token"] == F.col("token")).select("a", "b", _total(F.col("common")).alias("weight"), F.size("common").cast("long").alias("overlap"), "df_min", "ts_a", "ts_b")
        met = scores.near(met)
        if scores.top:
            met = met.where(F.round(F.col("known") + 0.20, 4) >= least)
        met = saved(met, f"{work}/step{high}")
        found.append(met.drop("known", "hours"))
        if made is not None:
            made.append(met.count())
        if scores.top:
            least = max(least, scores.least(met, stories))
        if high >= longest or _alive(sets, high, scores.least_weight(least)).groupBy("token").count().where("count > 1").isEmpty():
            return reduce(DataFrame.unionByName, found)
        low, high = high, high * STEP


def merge_candidates(stories: DataFrame, window_hours: float = 72, top_k: int = 60, max_df_ratio: float = 0.35, min_overlap: int = 1, fallback: bool = True) -> DataFrame:
    """stories(story_id, title, ts, signature) -> scored pairs (a, b), a being the more recent.

    Pairs come from an inverted index without the tokens that over max_df_ratio of the stories have, and lie within the
    window (an hour at least); weights are relative to the largest weight of any pair, whatever its distance.  Where no
    token is in two stories' lists, and fallback is set, title pairs step in.  Signatures are computed once and saved; of
    what is saved on the way only the top_k pairs stay.
    """
    with noted_dirs() as made:
        out = _scored_pairs(stories, window_hours, top_k, max_df_ratio, min_overlap, fallback)
        out = saved(out, f"{shared_dir(stories.sparkSession)}/candidates")
    for path in made[:-1]:
        removed(stories.sparkSession, path)
    return out


def _scored_pairs(stories: DataFrame, window_hours: float, top_k: int, max_df_ratio: float, min_overlap: int, fallback: bool) -> DataFrame:
    work = shared_dir(stories.sparkSession)
    window_hours = max(1, window_hours)
    stories = saved(stories.select("story_id", "title", "ts", "signature"), f"{work}/stories")
    share = min(1.0, max(0.01, max_df_ratio))
    n = stories.agg(F.count("*").alias("n"))
    rare = df_idf(stories).crossJoin(F.broadcast(n)).where(F.col("df") <= F.greatest(F.lit(2), F.floor(F.col("n") * share))).select("token", "df", "idf")
    post = saved(stories.select("story_id", "ts", F.explode(F.array_distinct("signature")).alias("token")).join(rare, "token"), f"{work}/postings")
    if fallback and post.where("df > 1").isEmpty():
        pairs = lexical_pairs(stories, window_hours)
        scores = _Scores(pairs.agg(F.max("weight").alias("top")).first()["top"], window_hours, top_k, min_overlap)
    else:
        scores = _Scores(largest_weight(post), window_hours, top_k, min_overlap)
        pairs = top_pairs(post, stories, scores)
    out = scores.near(pairs)
    # titles are compared only where the score could be among the top_k: titles add at most 0.20
    sure = out.where((F.col("known") >= 0.10) | (F.col("weight") >= 1.5)).select(F.round("known", 4).alias("s")).orderBy(F.col("s").desc()).limit(top_k)
    least = sure.agg(F.when(F.count("*") == top_k, F.min("s")).otherwise(0.0).alias("least"))
    out = out.crossJoin(F.broadcast(least)).where(F.round(F.col("known") + 0.20, 4) >= F.col("least"))
    lists = post.groupBy("story_id").agg(F.collect_list("token").alias("listed"))
    sides = stories.join(lists, "story_id", "left").withColumn("listed", F.coalesce("listed", F.array().cast("array<string>")))
    side = lambda x: sides.select(F.col("story_id").alias(x), tokens_word(F.col("title")).alias(f"words_{x}"), F.col("signature").alias(f"sig_{x}"), F.col("listed").alias(f"listed_{x}"))
    jac = jaccard(F.col("words_a"), F.col("words_b"))
    out = out.join(side("a"), "a").join(side("b"), "b").withColumn("title_jaccard", jac).withColumn("tokens", F.sort_array(F.array_intersect("listed_a", "listed_b")))
    raw = 0.70 * F.least(F.lit(1.0), F.col("weight") / F.lit(scores.top).cast("double")) + 0.20 * F.col("title_jaccard") + 0.10 * F.greatest(F.lit(0.0), 1 - F.col("hours") / window_hours)
    out = out.withColumn("score", F.round(raw, 4)).where(~((F.col("score") < 0.10) & (F.col("weight") < 1.5)))
    out = out.orderBy(F.col("score").desc(), F.round("weight", 6).desc(), "a", "b").limit(top_k)
    merged = F.slice(F.sort_array(F.array_union("sig_a", "sig_b")), 1, 12)
    return out.select("a", "b", "score", F.round("weight", 4).alias("weight"), F.slice("tokens", 1, 8).alias("evidence"), "df_min", F.round("hours", 6).alias("hours"), F.round("title_jaccard", 6).alias("title_jaccard"), merged.alias("merged_signature"))


def merge_judge(pairs: DataFrame, cache: DataFrame | None = None, budget: int = 20, low: float = 0.45, high: float = 0.70) -> DataFrame:
    """Decision and path for each candidate pair; pairs in the grey zone go to the (mock) model while budget is left.

    cache(a, b, decision) holds pairs judged before, in either order: they cost nothing, and in the grey zone their
    decision stands; pairs are ranked as merge_candidates() orders them.
    """
    strong = F.size(F.filter("evidence", lambda t: ~t.isin(*lex.GENERIC_TOKENS)))
    out = pairs.withColumn("strong", strong)
    if cache is not None:
        seen = cache.groupBy(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).agg(F.max("decision").alias("cached"))
        out = out.join(seen, (F.least("a", "b") == F.col("lo")) & (F.greatest("a", "b") == F.col("hi")), "left").drop("lo", "hi")
    else:
        out = out.withColumn("cached", F.lit(None).cast("string"))
    rule = (
        F.when((F.size("evidence") > 0) & (F.col("strong") == 0) & (F.col("title_jaccard") < 0.20), "RULE_NO_GENERIC_ONLY")
        .when(F.col("score") >= 0.78, "RULE_HIGH_SCORE")
        .when((F.col("df_min") <= 2) & (F.col("weight") >= 6) & (F.col("strong") >= 1), "RULE_RARE_TOKEN_STRONG")
        .when((F.col("strong") >= 3) & (F.col("score") >= 0.45) & (F.col("hours") <= 36), "RULE_MULTI_TOKEN_STRONG")
        .when(F.col("score").between(low, high), "GREY")
        .otherwise("RULE_NO")
    )
    order = W.orderBy(F.col("score").desc(), F.col("weight").desc(), "a", "b").rowsBetween(W.unboundedPreceding, -1)
    out = out.withColumn("rule", rule).withColumn("spent", F.coalesce(F.sum(F.when((F.col("rule") == "GREY") & F.col("cached").isNull(), 1).otherwise(0)).over(order), F.lit(0)))
    path = F.when((F.col("rule") == "GREY") & (F.col("spent") < budget), "LLM_GREY_ZONE").when(F.col("rule") == "GREY", "RULE_NO").otherwise(F.col("rule"))
    yes = path.isin("RULE_HIGH_SCORE", "RULE_RARE_TOKEN_STRONG", "RULE_MULTI_TOKEN_STRONG") | ((path == "LLM_GREY_ZONE") & F.coalesce(F.col("cached") == "SUGGEST_MERGE", F.col("strong") >= 2))
    return out.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "score", F.when(yes, "SUGGEST_MERGE").otherwise("NO_MERGE").alias("decision"), path.alias("decision_path"), F.col("strong").cast("int").alias("strong"))
