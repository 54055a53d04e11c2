"""X05 token_set_ratio, as a native expression, and in Python for the replay of clustering."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from storyweft.functions.text import tokens_norm


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, by Hyyro's bit-parallel recurrence."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    rest = mask = (1 << len(a)) - 1
    for c in b:
        hit = rest & at.get(c, 0)
        rest = (rest + hit) | (rest - hit)
    return (~rest & mask).bit_count()


def ratio(x: str, y: str) -> float:
    return 100.0 if not x and not y else 200.0 * _common(x, y) / (len(x) + len(y))


def token_set(a: list[str], b: list[str]) -> float:
    """0 to 100: the best similarity of the common tokens and each side's tokens."""
    a, b = set(a), set(b)
    if not a or not b:
        return 0.0
    both, left, right = (" ".join(sorted(s)) for s in (a & b, a - b, b - a))
    if both and not (left and right):
        return 100.0
    x, y = f"{both} {left}".strip(), f"{both} {right}".strip()
    return max([ratio(x, y), *((ratio(both, x), ratio(both, y)) if both else ())])


#: Bits of a word in common_length(); sums of two words have to fit a signed 64-bit number.
BITS = 62


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _letters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def common_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two texts of ASCII letters, digits and blanks.

    The rows of the usual table are bits, in words of BITS characters of the shorter text (mostly one).  A character of the
    other updates them with one addition and its carry; masks say where in the shorter text each character stands, and
    are made by replacing the others.
    """

    def mask(part: Column, c: Column) -> Column:
        bits = F.replace(F.regexp_replace(F.replace(part, c, F.lit("!")), "[^!]", "0"), F.lit("!"), F.lit("1"))
        return F.conv(F.reverse(bits), 2, 10).cast("long")

    def updated(v: Column, m: Column, full: Column) -> Column:
        def word(s: Column, k: Column) -> Column:
            old = F.get(v, k)
            hit = old.bitwiseAND(F.get(m, k))
            total = old + hit + s["carry"]
            new = total.bitwiseAND(F.get(full, k)).bitwiseOR(old - hit)
            return F.struct(F.concat(s["out"], F.array(new)).alias("out"), F.shiftright(total, BITS).alias("carry"))

        none = F.struct(F.array().cast("array<bigint>").alias("out"), F.lit(0).cast("long").alias("carry"))
        return F.aggregate(F.sequence(F.lit(0), F.size(full) - 1), none, word, lambda s: s["out"])

    all_ones = lambda p: F.pow(F.lit(2.0), F.length(p)).cast("long") - 1
    left_over = lambda f, v: F.bit_count(f.bitwiseAND(F.bitwise_not(v)))

    def one_word(q: Column) -> Column:
        masks = F.map_from_arrays(q["letters"], F.transform(q["letters"], lambda c: mask(q["a"], c)))
        met = _let(masks, lambda m: F.transform(_letters(q["b"]), lambda c: F.coalesce(F.element_at(m, c), F.lit(0).cast("long"))))
        step = lambda f: lambda v, m: (v + v.bitwiseAND(m)).bitwiseAND(f).bitwiseOR(v - v.bitwiseAND(m))
        return _let(all_ones(q["a"]), lambda f: left_over(f, F.aggregate(met, f, step(f))))

    def words(q: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.length(q["a"]) - 1) / BITS).cast("int")), lambda k: F.substring(q["a"], k * BITS + 1, F.lit(BITS)))

        def counted(parts: Column) -> Column:
            masks = F.map_from_arrays(q["letters"], F.transform(q["letters"], lambda c: F.transform(parts, lambda p: mask(p, c))))
            met = _let(masks, lambda m: F.filter(F.transform(_letters(q["b"]), lambda c: F.element_at(m, c)), lambda x: x.isNotNull()))

            def rows(full: Column) -> Column:
                return F.aggregate(F.zip_with(full, F.aggregate(met, full, lambda v, m: updated(v, m, full)), left_over), F.lit(0), lambda n, x: n + x)

            return _let(F.transform(parts, all_ones), rows)

        return _let(parts, counted)

    shorter = F.length(a) <= F.length(b)
    sides = F.struct(F.when(shorter, a).otherwise(b).alias("a"), F.when(shorter, b).otherwise(a).alias("b"))
    both = lambda q: F.struct(q["a"].alias("a"), q["b"].alias("b"), F.array_distinct(_letters(q["a"])).alias("letters"))
    ways = lambda q: F.when(q["a"] == "", 0).when(F.length(q["a"]) <= BITS, one_word(q)).otherwise(words(q))
    return _let(sides, lambda q: _let(both(q), ways))


def token_set_ratio(a: Column, b: Column) -> Column:
    """X05, natively: token_set() of the normal tokens of two titles.

    The common tokens start both sides, so they are common as they stand, and only what differs is compared by character.
    """

    def of_texts(y: Column) -> Column:
        none = y["both"] == ""
        sizes = F.struct(F.when(none, 0).otherwise(F.length(y["both"]) + 1).alias("k"), F.length(y["both"]).alias("both"), F.length(y["left"]).alias("n"), F.length(y["right"]).alias("m"), common_length(y["left"], y["right"]).alias("l"))

        def ratio(z: Column) -> Column:
            part = lambda n: 200.0 * z["both"] / (z["both"] + z["k"] + z[n])  # noqa: E731  of the common tokens and one side
            return F.greatest(200.0 * (z["k"] + z["l"]) / (2 * z["k"] + z["n"] + z["m"]), F.when(z["both"] == 0, 0.0).otherwise(F.greatest(part("n"), part("m"))))

        return F.when(~none & ((y["left"] == "") | (y["right"] == "")), 100.0).otherwise(_let(sizes, ratio))

    def of_sets(x: Column) -> Column:
        text = lambda t: F.array_join(t, " ")
        texts = F.struct(text(F.array_intersect(x["a"], x["b"])).alias("both"), text(F.array_except(x["a"], x["b"])).alias("left"), text(F.array_except(x["b"], x["a"])).alias("right"))
        return F.when((F.size(x["a"]) == 0) | (F.size(x["b"]) == 0), 0.0).otherwise(_let(texts, of_texts))

    tokens = lambda t: F.array_sort(F.array_distinct(tokens_norm(t)))
    return _let(F.struct(tokens(a).alias("a"), tokens(b).alias("b")), of_sets)
