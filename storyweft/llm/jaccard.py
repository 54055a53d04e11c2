"""N-gram Jaccard join over word shingles, with token-combination prefixes, and the components of its links.

A document's set holds the hashes of its 5-word shingles.  Equal sets form a class, and only classes are joined.

1. Blocks of sets go to shards of tokens, where document frequencies are counted; a shard answers with each class's
   tokens that some other class has too.  Tokens are in one order everywhere: by frequency, then by value.
2. A class that must share ceil(3/4 n) of its n tokens with a partner shares at least k of the first
   n - ceil(3/4 n) + k with it.  With k = 1 most classes have no token of frequency 2 or more there: they are done.
3. Rounds of stars: in every list of a single prefix token, each class proposes to one class of about its size that is
   not in its component; proposals are verified on whole sets, and links contract to components.
4. Groups of near copies: of the prefixes with k = 2, tokens whose lists still span components stay open.  In lists of
   frequent open tokens every class gets a home, the class with the most links that it meets, and is described by what
   it has and the home has not, or the reverse.  Two classes of one home link only if these differences overlap enough
   (see differences()), so classes of a home are joined by prefixes of their differences, which are rare edits, and not
   by the tokens that all of the group has.
5. Exact rest, for classes of different homes: rare open tokens (in at most `rare` classes) are indexed singly,
   frequent ones in combinations of two.  A pair that shares a rare token meets there; a pair that shares none shares
   two frequent ones.  Pairs of different components that meet early enough in both prefixes are verified.

Only components are wanted, so links within a component need no further look.  Nodes are the 64-bit hashes of sets;
tokens are 64-bit hashes, of which 48 bits besides the shard's number are kept: among the 3 million tokens of a shard two
unlike ones fall together with a chance of 1 in 60, which adds one common token to two sets.

Defined cases: null texts and texts without words have no shingle and are alone; fewer than five words are one shingle;
very long texts are whole sets; ties of frequency go by the token's value; repeated rows are one class; texts of one
doc_id are one document, and reach each other; a null doc_id is no common id, counts as larger than any and stays null
in the result; an empty table gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from storyweft.llm.common import dropped, saved, shared_dir, short_batches, table
from storyweft.llm.components import connected

NO_ID = (1 << 63) - 1
CACHE, BLOCK, TOKEN_BITS = 200_000, 8 << 20, 48
U = np.uint64
STEPS = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F]


class Shingler:
    """Sorted distinct 64-bit hashes of a text's shingles; words are hashed once."""

    def __init__(self, width: int = 5) -> None:
        self.width, self.known = width, {}

    def __call__(self, text: str | None) -> np.ndarray:
        known = self.known
        if len(known) > CACHE:
            known.clear()
        hashes = []
        for w in (text or "").encode("utf-8", "surrogatepass").lower().split():  # of bytes: A-Z and ASCII blanks only
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh64_intdigest(w)
            hashes.append(h)
        h = np.array(hashes, np.uint64)
        width = min(self.width, len(h))
        if not width:
            return h
        with np.errstate(over="ignore"):
            out = np.full(len(h) - width + 1, width, np.uint64)
            for k in range(width):
                out = (out ^ h[k : len(h) - width + 1 + k]) * U(STEPS[k % 5])
                out ^= out >> U(29)
        return np.unique(out)


ROWS = "shard int, kind int, a binary, b binary, tokens binary"
ROWS_SCHEMA = pa.schema([("shard", pa.int32()), ("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("tokens", pa.binary())])


def _small(tokens: np.ndarray) -> bytes:
    return tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _large(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def set_blocks(docs: DataFrame, shards: int, width: int = 5) -> DataFrame:
    """Blocks: kind 0 by shard (a: classes, b: how many tokens each has here, tokens), kind 1 (a: doc_id, class, n and h of the documents)."""

    def block(ids: list[int], hs: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        n = np.array([len(s) for s in sets], np.int64)
        of = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) if len(s) else xxhash.xxh3_64_intdigest(b"none%d" % i) for i, s in zip(ids, sets, strict=True)], np.uint64).view(np.int64)
        out = [(int(ids[0]) % shards, 1, np.stack([np.array(ids, np.int64), of, n, np.array(hs, np.int64)], 1).tobytes(), None, None)]
        _, one = np.unique(of, return_index=True)
        one = [k for k in one if n[k]]
        if one:
            token, which = np.concatenate([sets[k] for k in one]), np.repeat(np.arange(len(one)), n[one])
            shard = (token % U(shards)).astype(np.int64)
            token = (token // U(shards)) & U((1 << TOKEN_BITS) - 1)
            order = np.lexsort((token, which, shard))
            token, which, shard = token[order], which[order], shard[order]
            cuts = np.nonzero(shard[1:] != shard[:-1])[0] + 1
            for t, w, s in zip(np.split(token, cuts), np.split(which, cuts), np.split(shard, cuts), strict=True):
                there, counts = np.unique(w, return_counts=True)
                out.append((int(s[0]), 0, of[np.array(one)[there]].tobytes(), counts.astype("<i4").tobytes(), _small(t)))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), ROWS_SCHEMA.types, strict=True)], schema=ROWS_SCHEMA)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, ids, hs, sets, size = Shingler(width), [], [], [], 0
        for b in batches:
            for i, h, text in zip(b.column("doc_id"), b.column("h"), b.column("text"), strict=True):
                ids.append(i.as_py())
                hs.append(h.as_py())
                sets.append(shingles(text.as_py()))
                size += 8 * len(sets[-1]) + 64
                if size >= BLOCK:
                    yield block(ids, hs, sets)
                    ids, hs, sets, size = [], [], [], 0
        if ids:
            yield block(ids, hs, sets)

    return docs.mapInArrow(make, ROWS)


ANSWERS = "kind int, doc_id long, class long, n long, h long, shard int, tokens binary, df binary"


def _answer(pdf: pd.DataFrame) -> pd.DataFrame:
    """A shard's tokens that several classes have, by class; the documents of kind 1 pass."""
    out = []
    shard = int(pdf["shard"].iloc[0])
    for raw in pdf.loc[pdf["kind"] == 1, "a"]:
        d = np.frombuffer(raw, "<i8").reshape(-1, 4)
        out.append(pd.DataFrame({"kind": 1, "doc_id": d[:, 0], "class": d[:, 1], "n": d[:, 2], "h": d[:, 3], "shard": shard, "tokens": None, "df": None}))
    rows = pdf[pdf["kind"] == 0]
    if len(rows):
        token = np.concatenate([_large(x) for x in rows["tokens"]])
        of = np.concatenate([np.repeat(np.frombuffer(a, "<i8"), np.frombuffer(b, "<i4")) for a, b in zip(rows["a"], rows["b"], strict=True)])
        order = np.lexsort((of, token))
        token, of = token[order], of[order]
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (of[1:] != of[:-1])
        token, of = token[new], of[new]
        first = np.ones(len(token), bool)
        first[1:] = token[1:] != token[:-1]
        group = np.cumsum(first) - 1
        df = np.bincount(group)[group]
        token, of, df = token[df > 1], of[df > 1], df[df > 1]
        order = np.argsort(of, kind="stable")
        token, of, df = token[order], of[order], df[order].astype("<i4")
        if len(of):
            cuts = np.nonzero(of[1:] != of[:-1])[0] + 1
            ends = [0, *cuts.tolist(), len(of)]
            out.append(pd.DataFrame({"kind": 0, "doc_id": None, "class": of[ends[:-1]], "n": None, "h": None, "shard": shard, "tokens": [_small(token[a:b]) for a, b in zip(ends, ends[1:], strict=False)], "df": [df[a:b].tobytes() for a, b in zip(ends, ends[1:], strict=False)]}))
    columns = ["kind", "doc_id", "class", "n", "h", "shard", "tokens", "df"]
    return pd.concat(out)[columns].astype({"doc_id": "Int64", "n": "Int64", "h": "Int64"}) if out else pd.DataFrame({c: [] for c in columns})


def prefix(n: int, k: int, percent: int = 75) -> int:
    """How many of n tokens hold k of those that a partner shares."""
    return n + (-percent * n) // 100 + k


def class_lists(answers: DataFrame, classes: DataFrame, shards: int, percent: int = 75) -> DataFrame:
    """node, n, tokens, df: the ordered tokens that other classes have too, for classes that can have a partner."""

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for node, n, answers in zip(b.column("node"), b.column("n"), b.column("answers"), strict=True):
                n, answers = n.as_py(), answers.as_py()
                token = np.concatenate([_large(a["tokens"]) * U(shards) + U(a["shard"]) for a in answers])
                df = np.concatenate([np.frombuffer(a["df"], "<i4") for a in answers])
                if n - len(token) < prefix(n, 1, percent):
                    o = np.lexsort((token, df))
                    out.append((node.as_py(), n, token[o].view(np.int64), df[o]))
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32())), strict=True)], ["node", "n", "tokens", "df"])

    grouped = answers.groupBy("class").agg(F.collect_list(F.struct("shard", "tokens", "df")).alias("answers"))
    return grouped.join(classes, "class").select(F.col("class").alias("node"), "n", "answers").mapInArrow(order, "node long, n long, tokens array<long>, df array<int>")


def prefix_tokens(lists: DataFrame, percent: int = 75) -> DataFrame:
    """node, n, most, token, df, left, standard: the tokens of the prefixes with k = 2 that occur elsewhere; standard for those with k = 1.

    most is how many tokens of the class others have: no partner shares more.  left: how many tokens the class has from
    this one on.
    """
    alone = F.col("n") - F.size("tokens")
    reach = (F.col("n") - F.ceil(F.col("n") * percent / 100) - alone).cast("int")
    cut = F.slice(F.arrays_zip("tokens", "df"), F.lit(1), reach + 2)
    rows = lists.select("node", "n", F.size("tokens").alias("most"), reach.alias("reach"), F.posexplode(cut).alias("at", "t"))
    return rows.select("node", "n", "most", F.col("t.tokens").alias("token"), F.col("t.df").alias("df"), (F.col("most") - F.col("at")).alias("left"), (F.col("at") <= F.col("reach")).alias("standard"))


def _sides(pairs: DataFrame, lists: DataFrame) -> DataFrame:
    """pairs(a, b) with na, nb, the sizes of the sets, ta, tb, their tokens that others have, and both, how many they share.

    Tokens that no other class has cannot be shared, so the lists and the sizes say it all.
    """
    side = lambda x: lists.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("tokens").alias(f"t{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").withColumn("both", F.size(F.array_intersect("ta", "tb")))


def verified(pairs: DataFrame, lists: DataFrame, percent: int = 75) -> DataFrame:
    """pairs(a, b) -> a, b, linked: whether 100 * intersection >= percent * union of their whole sets."""
    return _sides(pairs, lists).select("a", "b", (100 * F.col("both") >= percent * (F.col("na") + F.col("nb") - F.col("both"))).alias("linked"))


def homes(tokens: DataFrame, links: DataFrame | None, work: str, steps: int = 3) -> DataFrame:
    """tokens(node, token) -> node, home, step: candidates for a home, the last step being the best.

    Step 0 is the class with the most links that the node meets in any of its lists, each further one is the choice of the one before.
    """
    tokens = tokens.select("node", "token")
    if links is None:
        tokens = tokens.withColumn("degree", F.lit(0).cast("long"))
    else:
        ends = links.select(F.col("u").alias("node")).unionByName(links.select(F.col("v").alias("node")))
        tokens = tokens.join(ends.groupBy("node").agg(F.count("*").alias("degree")), "node", "left").fillna(0, "degree")
    best = tokens.groupBy("token").agg(F.max(F.struct("degree", "node")).alias("best"))
    own = saved(tokens.join(best, "token").groupBy("node").agg(F.max("best").alias("best")).select("node", F.col("best.node").alias("home")), f"{work}/homes")
    up = own.select(F.col("node").alias("home"), F.col("home").alias("next"))
    out = own.select("node", F.array("home").alias("chain"), "home")
    for _ in range(steps):
        out = out.join(up, "home").select("node", F.array_append("chain", F.col("next")).alias("chain"), F.col("next").alias("home"))
    return out.select("node", F.posexplode("chain").alias("step", "home")).groupBy("node", "home").agg(F.max("step").alias("step"))


def differences(homed: DataFrame, lists: DataFrame, percent: int = 75) -> DataFrame:
    """homed(node, home, step) -> of each node's last step with something in common: node, home, n, r, apart, items, f.

    R is the part of the home's set that other classes have, r its size.  A node's difference to R has `apart` items, of
    which `items` may be shared.  With q = (100 - percent) / (100 + percent), nodes x and y link if and only if their
    symmetric difference has at most q (n x + n y) items, that is, if their differences share at least (g x + g y) / 2
    items, where g = apart - q n; f is (100 + percent) g.  Nodes that have little in common with any of their
    homes are left out: they stay in the index of plain tokens.
    """
    rows = _sides(homed.withColumnRenamed("node", "a").withColumnRenamed("home", "b"), lists).withColumn("r", F.size("tb"))
    rows = rows.where(4 * F.col("both") >= F.col("na") + F.col("r") - F.col("both")).withColumn("apart", F.col("na") + F.col("r") - 2 * F.col("both"))
    at = F.struct("step", F.col("b").alias("home"), F.col("na").alias("n"), "r", "apart", F.concat(F.array_except("ta", "tb"), F.array_except("tb", "ta")).alias("items"), ((100 + percent) * F.col("apart") - (100 - percent) * F.col("na")).alias("f"))
    return rows.select(F.col("a").alias("node"), at.alias("at")).groupBy("node").agg(F.max_by("at", "at.step").alias("at")).select("node", "at.home", "at.n", "at.r", "at.apart", "at.items", "at.f")


def centres(nodes: DataFrame) -> DataFrame:
    """nodes: rows of differences() -> pairs (a, b) of each node and the one with the least f of its home.

    Where f x + f y <= 0, no shared item is needed; then both link with the one that has the least f, too.
    """
    least = nodes.groupBy("home").agg(F.min(F.struct("f", "node")).alias("c")).select("home", F.col("c.node").alias("centre"))
    return nodes.join(least, "home").where("node <> centre").select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b"))


def met_by_differences(nodes: DataFrame, work: str, percent: int = 75) -> DataFrame:
    """nodes: rows of differences() with component -> pairs (a, b) of one home and different components whose differences may overlap enough.

    A node shares at least (f + the least f of other components of its home) / 2 / (100 + percent) items with a partner.
    Also n y <= r + apart y, and apart y is at least what is shared, which gives (f - (100 - percent) r) / 200.
    """
    least = nodes.groupBy("home").agg(F.min(F.struct("f", "component")).alias("least"))
    paired = nodes.select("home", "f", "component").join(least, "home")
    second = paired.where(F.col("component") != F.col("least.component")).groupBy("home").agg(F.min("f").alias("second"))
    rival = F.when(F.col("component") == F.col("least.component"), F.col("second")).otherwise(F.col("least.f"))
    need = F.greatest(F.lit(1), F.ceil((F.col("f") + rival) / (2 * (100 + percent))), F.ceil((F.col("f") - (100 - percent) * F.col("r")) / 200))
    nodes = nodes.join(least.join(second, "home"), "home").withColumn("need", need.cast("int"))
    rows = saved(nodes.select("home", "node", "n", "component", "f", "need", F.explode("items").alias("item")), f"{work}/items")
    shared = rows.groupBy("home", "item").agg(F.count("*").alias("df"), F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 < c1").select("home", "item", "df")
    order = rows.join(shared, ["home", "item"]).groupBy("home", "node", "n", "component", "f", "need").agg(F.sort_array(F.collect_list(F.struct("df", "item"))).alias("t"))
    order = order.withColumn("size", F.size("t")).where(F.col("size") >= F.col("need"))
    keys = order.select("home", "node", "n", "component", "f", F.posexplode(F.slice("t", F.lit(1), F.col("size") - F.col("need") + 1)).alias("at", "t"), "size")
    keys = saved(keys.select("home", F.col("t.item").alias("item"), "node", "n", "component", "f", (F.col("size") - F.col("at")).alias("left")), f"{work}/item_keys")
    a, b = keys.alias("a"), keys.alias("b")
    need = (F.col("a.f") + F.col("b.f")) / (2 * (100 + percent))
    same = (F.col("a.home") == F.col("b.home")) & (F.col("a.item") == F.col("b.item"))
    met = a.join(b, same & (F.col("a.node") < F.col("b.node")) & (F.col("a.component") != F.col("b.component")) & (100 * F.least("a.n", "b.n") >= percent * F.greatest("a.n", "b.n")) & (F.least("a.left", "b.left") >= need))
    return met.select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).distinct()


def met_by_tokens(tokens: DataFrame, work: str, rare: int, percent: int = 75) -> DataFrame:
    """tokens(node, n, most, token, df, left, component, home) -> pairs (a, b) of different homes and components that share a rare token or two frequent ones."""
    columns = ["node", "n", "most", "component", "home"]
    single = tokens.where(F.col("df") <= rare).select(F.col("token").alias("k1"), F.lit(0).cast("long").alias("k2"), "left", *columns)
    lists = tokens.where(F.col("df") > rare).groupBy(*columns).agg(F.sort_array(F.collect_list(F.struct((-F.col("left")).alias("at"), "token"))).alias("t"))
    firsts = lists.select(*columns, "t", F.posexplode("t").alias("i", "x"))
    double = firsts.select(*columns, F.col("x.token").alias("k1"), F.explode(F.slice("t", F.col("i") + 2, F.size("t"))).alias("y")).select("k1", F.col("y.token").alias("k2"), (1 - F.col("y.at")).alias("left"), *columns)
    keys = single.unionByName(double)
    spans = (F.min("component") < F.max("component")) & (F.min("home") < F.max("home"))
    keys = saved(keys.join(keys.groupBy("k1", "k2").agg(spans.alias("open")).where("open").select("k1", "k2"), ["k1", "k2"]), f"{work}/keys")
    a, b, shared = keys.alias("a"), keys.alias("b"), F.least("a.most", "b.most", "a.left", "b.left")
    met = a.join(b, (F.col("a.k1") == F.col("b.k1")) & (F.col("a.k2") == F.col("b.k2")) & (F.col("a.node") < F.col("b.node")) & (F.col("a.component") != F.col("b.component")) & (F.col("a.home") != F.col("b.home")) & (100 * F.least("a.n", "b.n") >= percent * F.greatest("a.n", "b.n")) & ((100 + percent) * shared >= percent * (F.col("a.n") + F.col("b.n"))))
    return met.select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).distinct()


def class_components(docs: DataFrame, by_id: bool = True, width: int = 5, percent: int = 75, rare: int = 32, rounds: int = 3, shard_bytes: int = 16 << 20) -> tuple[DataFrame, DataFrame]:
    """docs(doc_id, text) -> rows(doc_id, h, class, n) with h = xxhash64(text) and NO_ID for null; classes(class, first, component).

    by_id: texts of one doc_id belong together.  first is the smallest doc_id of the class, component the class that stands for the component.
    """
    work = shared_dir(docs.sparkSession)
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = int(max(24, size // shard_bytes))
    answers = set_blocks(docs, shards, width).groupBy("shard").applyInPandas(_answer, ANSWERS)
    with short_batches(docs.sparkSession):
        answers = saved(answers, f"{work}/answers")
    rows = answers.where("kind = 1").select("doc_id", "h", "class", "n")
    classes = saved(rows.groupBy("class").agg(F.min("doc_id").alias("first"), F.max("n").alias("n")), f"{work}/classes")
    lists = saved(class_lists(answers.where("kind = 0"), classes.where("n > 0"), shards, percent), f"{work}/lists")
    postings = saved(prefix_tokens(lists, percent), f"{work}/postings")
    links, labels = None, None

    def labelled(nodes: DataFrame, node: str = "node", component: str = "component") -> DataFrame:
        if labels is None:
            return nodes.withColumn(component, F.col(node))
        return nodes.join(labels.select(F.col("node").alias(node), F.col("component").alias(component)), node, "left").withColumn(component, F.coalesce(component, node))

    def link(new: DataFrame, name: str) -> bool:
        nonlocal links, labels
        if new.isEmpty():
            return False
        links = new if links is None else links.unionByName(new)
        labels = saved(connected(links, f"{work}/{name}_components"), f"{work}/{name}_labels")
        return True

    def settle(pairs: DataFrame, name: str) -> bool:
        return link(saved(verified(pairs, lists, percent), f"{work}/{name}").where("linked").select(F.col("b").alias("u"), F.col("a").alias("v")), name)

    if by_id:
        several = rows.where(F.col("doc_id") < NO_ID).groupBy("doc_id").agg(F.min("class").alias("v"), F.max("class").alias("u")).where("u <> v").select("doc_id", "v")
        link(saved(rows.join(several, "doc_id").where("class <> v").select(F.col("class").alias("u"), "v").distinct(), f"{work}/ids"), "ids")
    grown = F.floor(F.log(F.col("n")) / float(np.log(100 / percent)))
    for k in range(rounds):
        tokens = labelled(postings.where("standard").select("node", "n", "token")).withColumn("grown", grown)
        leaders = tokens.groupBy("token", "grown").agg(F.min(F.struct((F.xxhash64(F.lit(k), "component") if k else F.col("component")).alias("place"), "component", "node")).alias("least"), F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 < c1")
        asked = tokens.join(leaders.select("token", "grown", F.col("least.component").alias("leader_component"), F.col("least.node").alias("leader")), ["token", "grown"]).where("component <> leader_component")
        asked = asked.groupBy("node").agg(F.min("leader").alias("leader"))
        if not settle(asked.select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct(), f"round{k}"):
            break
    spans = F.min("component") < F.max("component")
    tokens = labelled(postings.select("node", "n", "most", "token", "df", "left"))
    tokens = saved(tokens.join(tokens.groupBy("token").agg(spans.alias("open")).where("open").select("token"), "token"), f"{work}/open")
    at_home = saved(homes(tokens.where(F.col("df") > rare), links, work), f"{work}/candidates")
    settle(at_home.where("node <> home").select(F.least("node", "home").alias("a"), F.greatest("node", "home").alias("b")).distinct(), "home_links")
    nodes = saved(differences(at_home, lists, percent), f"{work}/differences")
    settle(labelled(labelled(centres(nodes), "a", "ca"), "b", "cb").where("ca <> cb").select("a", "b"), "centres")
    open_homes = labelled(nodes).groupBy("home").agg(spans.alias("open")).where("open").select("home")
    settle(met_by_differences(labelled(nodes).join(open_homes, "home"), work, percent), "near_copies")
    tokens = labelled(tokens.drop("component")).join(nodes.select("node", "home"), "node", "left").withColumn("home", F.coalesce("home", "node"))
    settle(met_by_tokens(tokens, work, rare, percent), "rest")
    for name in ("lists", "postings", "open", "homes", "candidates", "differences", "items", "item_keys", "keys", "home_links", "centres", "near_copies", "rest", *(f"round{k}" for k in range(rounds))):
        dropped(docs.sparkSession, f"{work}/{name}")  # what is returned reads answers, classes and the last labels alone
    return rows, labelled(classes.select("class", "first"), "class")


def jaccard_components(docs: DataFrame, **options) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_shingles, component_id, class_id: the smallest doc_id with an equal set."""
    rows, classes = class_components(docs, **options)
    least = classes.groupBy("component").agg(F.min("first").alias("least"))
    out = rows.join(classes.join(least, "component").select("class", "first", "least"), "class")
    shown = lambda c: F.when(F.col(c) < NO_ID, F.col(c))
    return out.select(shown("doc_id").alias("doc_id"), F.col("n").alias("n_shingles"), shown("least").alias("component_id"), shown("first").alias("class_id"))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """docs, one row of each group of linked texts: that with the smallest doc_id (null last), ties by a hash of the text.

    Different texts of one doc_id are judged apart.  Documents without words stay, each of their rows.
    """
    rows, classes = class_components(docs, by_id=False, **options)
    one = rows.where("n > 0").join(classes.select("class", "component"), "class").groupBy("component").agg(F.min(F.struct("doc_id", "h")).alias("k")).select("k.doc_id", "k.h")
    kept = one.withColumn("all", F.lit(False)).unionByName(rows.where("n = 0").select("doc_id", "h").distinct().withColumn("all", F.lit(True)))
    row = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("row")).withColumn("doc_id", F.coalesce(F.col("row.doc_id").cast("long"), F.lit(NO_ID))).withColumn("h", F.xxhash64("row.text"))
    found = row.join(kept, ["doc_id", "h"]).withColumn("each", F.when(F.col("all"), F.monotonically_increasing_id()))
    return found.withColumn("copy", F.row_number().over(W.partitionBy("doc_id", "h", "each").orderBy("h"))).where("copy = 1").select("row.*")


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "class_id")
