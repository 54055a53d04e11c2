"""Line dedup by a log-template tree, with DataFrame and SQL functions only.

A line's tokens that hold a digit are variable fields from the start.  The tree has a fixed depth: lines are parsed by
their token count, by their first `depth` tokens, and then `splits` times by the further token that most wordings of
their node share.  A node with several wordings has a template: a position whose token more than half of the wordings
share is fixed, and any other is variable; wordings that agree with the fixed positions in `similarity` of their tokens
belong to it, if one of these tokens is a word.  The others go on to the node's children, where they vote anew, so that
templates that share count and leading tokens do not drown each other, and however often one wording recurs, it has
one vote.  Templates (and single wordings) that recur in min_texts different texts are dropped, except in the
document with the smallest doc_id that has them.  Exact copies of a text count once, so that copies of a whole document
are left to document dedup.

Only 64-bit hashes of lines are counted (10^11 different lines would give some 300 collisions); tokens are compared for
one holder of each wording in nodes that could recur.  Hot lines are pre-aggregated by (line, text), and joins to them
have one row per line on the other side.

Defined cases: null texts stay null and have no lines; documents without an id come after all others, by a hash of their
text; lines of fewer than min_tokens tokens, empty lines and lines of
variable fields alone are always kept; very long lines are lines like others; of tokens that as many wordings share the
first in the line leads on; a template repeated within its first document stays there; repeated rows are treated alike;
an empty table gives no rows; the input's columns stay in one struct, so other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from storyweft.llm.common import saved, shared_dir, table

#: A token that holds a digit; possessive, and starting only where a token starts.
VARIABLE = r"(?<![^\s])[^\s0-9]*+[0-9][^\s]*+"


#: Blanks that are not one space.
BLANKS = r"[\t\r ]{2,}+|[\t\r]"


def _masked_lines(text: Column) -> Column:
    masked = lambda x: F.when(x.rlike("[0-9]"), F.regexp_replace(x, VARIABLE, "<*>")).otherwise(x)
    return F.transform(F.split(F.regexp_replace(text, BLANKS, " "), "\n", -1), lambda x: F.trim(masked(x)))


def _tokens(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def _key(doc_id: Column, h: Column) -> Column:
    """What stands for a document in joins: its id as a text, or without an id the hash of its text."""
    return F.coalesce(doc_id.cast("string"), F.concat(F.lit("#"), h.cast("string")))


def _first() -> list[Column]:
    """The first document of some: the smallest id, or, where none has an id, the smallest hash of a text."""
    return [F.min("doc_id").alias("first_doc"), F.min(F.when(F.col("doc_id").isNull(), F.col("h"))).alias("first_h")]


def recurring_lines(docs: DataFrame, depth: int = 4, splits: int = 3, min_texts: int = 5, min_tokens: int = 3, similarity: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """docs(doc_id, text) -> lines(doc_id, h, line, leaf) and recurring(line, first_doc, first_h): one row per wording to drop."""
    work = shared_dir(docs.sparkSession)
    of_line = lambda x: F.struct(F.xxhash64(x).alias("line"), F.xxhash64(_tokens(x), F.substring_index(x, " ", depth)).alias("leaf"))
    lines = docs.where("text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("h"), F.explode(F.array_distinct(F.transform(F.filter(_masked_lines(F.col("text")), lambda x: (_tokens(x) >= min_tokens) & (F.trim(F.replace(x, F.lit("<*>"), F.lit(""))) != "")), of_line))).alias("l"))
    lines = saved(lines.select("doc_id", "h", "l.line", "l.leaf"), f"{work}/lines")
    texts = lines.groupBy("line", "leaf", "h").agg(F.min("doc_id").alias("doc_id"))
    counts = saved(texts.groupBy("line", "leaf").agg(F.count("*").alias("n"), *_first()), f"{work}/counts")
    exact = counts.where(F.col("n") >= min_texts).select("line", "first_doc", "first_h")
    may_recur = (F.count("*") > 1) & (F.sum("n") >= min_texts)
    open_leaves = counts.groupBy("leaf").agg(may_recur.alias("open")).where("open").select("leaf")
    wordings = counts.join(open_leaves, "leaf")
    asked = wordings.groupBy(_key(F.col("first_doc"), F.col("first_h")).alias("d")).agg(F.collect_set("line").alias("asked"))
    found = docs.withColumn("d", _key(F.col("doc_id"), F.xxhash64("text"))).join(asked, "d").select(F.explode(F.filter(F.transform(_masked_lines(F.col("text")), lambda x: F.struct(F.xxhash64(x).alias("line"), x.alias("words"))), lambda s: F.array_contains("asked", s.line))).alias("s"))
    found = found.select("s.line", F.split("s.words", " ").alias("words")).groupBy("line").agg(F.first("words").alias("words"))
    node = saved(wordings.join(found, "line").select("line", F.col("leaf").alias("node"), "n", "words"), f"{work}/wordings0")
    templates = None
    for k in range(splits + 1):
        tokens = node.select("node", "line", F.posexplode("words").alias("at", "word"))
        votes = tokens.groupBy("node", "at", "word").agg(F.count("*").alias("votes")).join(node.groupBy("node").agg(F.count("*").alias("total")), "node")
        votes = saved(votes.where((F.col("votes") > 1) | (2 * F.col("votes") > F.col("total"))), f"{work}/votes{k}")
        fixed = 2 * F.col("votes") > F.col("total")
        seen = tokens.join(votes, ["node", "at", "word"], "left").groupBy("node", "line").agg(
            ((F.count_if(fixed) >= similarity * F.count("*")) & (F.count_if(fixed & (F.col("word") != "<*>")) > 0)).alias("member"), F.max(F.when(F.col("votes") < F.col("total"), F.struct("votes", (-F.col("at")).alias("at"), "word"))).alias("next")
        )
        seen = saved(seen, f"{work}/seen{k}")
        members = seen.where("member").select("line", F.col("node").alias("template"))
        templates = members if templates is None else templates.unionByName(members)
        if k < splits:
            rest = node.join(seen.where("NOT member AND next IS NOT NULL").select("line", F.xxhash64("node", "next.at", "next.word").alias("child")), "line").select("line", F.col("child").alias("node"), "n", "words")
            rest = saved(rest, f"{work}/rest{k}")
            node = saved(rest.join(rest.groupBy("node").agg(may_recur.alias("open")).where("open").select("node"), "node").select("line", "node", "n", "words"), f"{work}/wordings{k + 1}")
    spread = lines.join(templates, "line").groupBy("template", "h").agg(F.min("doc_id").alias("doc_id"))
    spread = spread.groupBy("template").agg(F.count("*").alias("n"), *_first()).where(F.col("n") >= min_texts)
    loose = templates.join(spread, "template").select("line", "first_doc", "first_h")
    return lines, saved(exact.unionByName(loose).groupBy("line").agg(F.min("first_doc").alias("first_doc"), F.min("first_h").alias("first_h")), f"{work}/recurring")


def without_recurring_lines(docs: DataFrame, **options) -> DataFrame:
    """row: a struct of the columns of docs, text: what is left of its text, n_lines, n_dropped."""
    named = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("row"))
    plain = named.select(F.col("row.doc_id").alias("doc_id"), F.col("row.text").alias("text"))
    lines, recurring = recurring_lines(plain, **options)
    drop = lines.join(recurring, "line").where("NOT (doc_id <=> first_doc AND (doc_id IS NOT NULL OR h = first_h))").groupBy(_key(F.col("doc_id"), F.col("h")).alias("d"), "h").agg(F.collect_set("line").alias("drop"))
    out = named.withColumn("h", F.xxhash64("row.text")).withColumn("d", _key(F.col("row.doc_id"), F.col("h"))).join(drop, ["d", "h"], "left")
    text = F.col("row.text")
    left = F.filter(F.zip_with(F.split(text, "\n", -1), _masked_lines(text), lambda a, b: F.when(~F.array_contains("drop", F.xxhash64(b)), a)), lambda x: x.isNotNull())
    out = out.select("row", F.when(F.col("drop").isNull(), F.split(text, "\n", -1)).otherwise(left).alias("left"))
    n_lines = F.coalesce(F.length("row.text") - F.length(F.replace("row.text", F.lit("\n"), F.lit(""))) + 1, F.lit(0))
    return out.select("row", F.array_join("left", "\n").alias("text"), n_lines.cast("long").alias("n_lines"), (n_lines - F.coalesce(F.when(F.size("left") >= 0, F.size("left")), F.lit(0))).cast("long").alias("n_dropped"))


def line_deduplicated(docs: DataFrame, **options) -> DataFrame:
    """docs with the columns that it has; text without the dropped lines, n_chars (if there is one) counted anew."""
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return without_recurring_lines(docs, **options).select(*[(new[c] if c in new else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_recurring_lines(table(spark, sf_dir, "documents"))
    return out.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
