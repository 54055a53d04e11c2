r"""Chat formatting in budgeted windows, with DataFrame and SQL functions only.

A turn is written as ``<|turn|>role\ntext<|end|>\n``.  Inside roles and texts a backslash is doubled and a backslash is
put behind the first character of every control string (``<|``, ``<s>``, ``</s>``, ``[INST]``, ``[/INST]``,
``<<SYS>>``, ``<</SYS>>``), so that no text can open or close a turn and everything can be read back.

Prefix sums of estimated turn tokens deal the turns of a conversation to spans; a window is a span, led by the system
turn and by a limited number of earlier turns, which are context only.  The loss mask covers the texts of the span's
own assistant turns, so every assistant text is a target once, however often it is repeated as history.

Spans take budget - system - history - the longest turn's tokens (a quarter of the budget at least), so that a window
keeps within the budget unless its turns alone are longer.

Defined cases: null texts and roles are empty; turns are ordered by turn, role and text, nulls first, and repeated rows
are turns of their own; a null conv_id is a conversation; a very long text is written whole, in a window of its own if it
is longer than the budget, and a very long conversation is one row while it is formatted; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from storyweft.llm.common import table

OPEN, CLOSE = "<|turn|>", "<|end|>\n"
CONTROL = r"([<\[])(?=\||/?s>|/?INST\]|</?SYS>>|/?SYS>>)"


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$1\\")


def escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("\n"), F.lit("\\n"))


def unescaped(text: Column, newline: bool = False) -> Column:
    plain = lambda x: F.replace(F.replace(x, F.lit("\\n"), F.lit("\n")) if newline else x, F.lit("\\"), F.lit(""))
    return F.array_join(F.transform(F.split(text, r"\\{2}", -1), plain), "\\")


def chat_windows(turns: DataFrame, budget: int = 2048, history_turns: int = 2, history_share: float = 0.25) -> DataFrame:
    """conv_id, window, first_turn, n_repeated, n_turns, n_tokens, text, loss: array of (start, length) in characters of text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    t = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    t = t.select("conv_id", F.struct("turn", "role", "text").alias("at"), F.col("role").alias("role"), F.concat(F.lit(OPEN), escaped_role(F.col("role")), F.lit("\n")).alias("head"), escaped(F.col("text")).alias("body"), (F.ceil(F.length("text") / 4) + 4).cast("long").alias("tok"))
    whole = W.partitionBy("conv_id")
    order = whole.orderBy("at")
    t = t.withColumn("i", F.row_number().over(order) - 1).withColumn("before", F.coalesce(F.sum("tok").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    t = t.withColumn("sys", F.max(F.when((F.col("i") == 0) & (F.col("role") == "system"), F.col("tok")).otherwise(0)).over(whole)).withColumn("longest", F.max("tok").over(whole))
    kept = int(budget * history_share)
    room = F.greatest(F.lit(budget // 4), F.lit(budget - kept) - F.col("sys") - F.col("longest"))
    t = t.withColumn("span", F.floor(F.greatest(F.lit(0), F.col("before") - F.col("sys")) / room))
    t = t.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("i", "role", "head", "body", "tok", "before", "span"))).alias("t"))
    t = t.withColumn("s", F.expr("transform(t, x -> x.span)")).withColumn("lead", F.expr("IF(t[0].role = 'system', 1, 0)"))
    t = t.select("conv_id", "t", "s", "lead", F.posexplode(F.array_distinct("s")).alias("window", "k"))
    t = t.withColumn("first", F.expr("CAST(array_position(s, k) AS INT) - 1")).withColumn("own", F.expr("size(filter(s, x -> x = k))"))
    t = t.withColumn("hist_from", F.expr(f"greatest(lead, first - {history_turns})"))
    t = t.withColumn("context", F.expr(f"IF(first = 0, slice(t, 1, 0), concat(slice(t, 1, lead), filter(slice(t, hist_from + 1, greatest(0, first - hist_from)), x -> t[first].before - x.before <= {kept})))"))
    t = t.select("conv_id", "window", "first", F.size("context").alias("n_repeated"), F.expr("concat(context, slice(t, first + 1, own))").alias("p"))
    t = t.withColumn("lengths", F.expr(f"transform(p, x -> length(x.head) + length(x.body) + {len(CLOSE)})"))
    loss = "filter(transform(p, (x, j) -> IF(j >= n_repeated AND x.role = 'assistant', named_struct('start', aggregate(slice(lengths, 1, j), 0, (a, y) -> a + y) + length(x.head), 'length', length(x.body)), NULL)), x -> x IS NOT NULL)"
    return t.select(
        "conv_id", "window", F.col("first").alias("first_turn"), "n_repeated", (F.size("p") - F.col("n_repeated")).alias("n_turns"), F.expr("aggregate(p, 0L, (a, x) -> a + x.tok)").alias("n_tokens"),
        F.array_join(F.transform("p", lambda x: F.concat(x.head, x.body, F.lit(CLOSE))), "").alias("text"), F.expr(loss).alias("loss"),
    )


def read_back(windows: DataFrame) -> DataFrame:
    """conv_id, window, text, turns: the (role, text) of each window's own turns, parsed from its text; targets: the texts under the loss mask."""
    parts = F.slice(F.split("text", r"<\|end\|>\n", -1), F.col("n_repeated") + 1, F.col("n_turns"))
    head = F.expr(f"transform(parts, p -> substring_index(substring(p, {len(OPEN) + 1}), '\\n', 1))")
    out = windows.withColumn("parts", parts).withColumn("heads", head)
    turns = F.zip_with("heads", "parts", lambda h, p: F.struct(unescaped(h, True).alias("role"), unescaped(F.substr(p, F.length(h) + len(OPEN) + 2)).alias("text")))
    return out.select("conv_id", "window", "text", turns.alias("turns"), F.transform("loss", lambda s: unescaped(F.substr(F.col("text"), s.start + 1, s.length))).alias("targets"))


def digests(back: DataFrame) -> DataFrame:
    """What was read back, as one row of counts and digests per conversation."""
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    out = back.select("conv_id", F.struct("window", lines.alias("lines"), F.array_join("targets", "").alias("loss"), F.size("turns").alias("n"), F.length("text").alias("chars")).alias("w")).groupBy("conv_id").agg(F.sort_array(F.collect_list("w")).alias("w"))
    joined = lambda f: F.array_join(F.transform("w", lambda w: w[f]), "")
    total = lambda f: F.aggregate("w", F.lit(0).cast("long"), lambda a, w: a + w[f])
    return out.select("conv_id", total("n").alias("n_turns"), F.sha2(joined("lines"), 256).alias("turns_sha256"), F.length(joined("loss")).cast("long").alias("loss_chars"), F.sha2(joined("loss"), 256).alias("loss_sha256"), total("chars").alias("formatted_chars"), F.size("w").alias("n_windows"))


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    more = spark.range(1).select(F.explode(F.array(F.struct(F.lit(0).alias("turn"), F.lit("user").alias("role")), F.struct(F.lit(1).alias("turn"), F.lit("assistant").alias("role")))).alias("t")).select(F.lit(-7).cast("long").alias("conv_id"), F.col("t.turn").cast("long").alias("turn"), "t.role", F.lit(text).alias("text"))
    return digests(read_back(chat_windows(turns.unionByName(more))))
