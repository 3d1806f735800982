"""Building blocks for column expressions over strings and arrays of strings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Private-use characters that stand for protected punctuation, and back: one translate() restores them all.
PERIOD, EXCLAIM, QUESTION, ITEM = "\ue000", "\ue001", "\ue002", "\ue003"
#: The single ellipsis character, and a mark for a period that only ends a sentence.
ELLIPSIS, ADDED = "\ue004", "\ue005"
HIDDEN, SHOWN = PERIOD + EXCLAIM + QUESTION + ELLIPSIS, ".!?…"
CUT, INNER_CUT = "\x01", "\x02"

Text = Column | str


def col(c: Text) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rx(c: Text, pattern: str, replacement: str) -> Column:
    """Every match of a Java pattern replaced ($1 is the first group)."""
    return F.regexp_replace(col(c), F.lit(pattern), F.lit(replacement))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often body mentions it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def using(body: Callable[[Column, object], Column], value: object) -> Callable[[Column], Column]:
    """body with its second argument fixed: Spark takes a lambda's defaults for parameters."""
    return lambda c: body(c, value)


def strip(c: Text) -> Column:
    """Without white space (Unicode) at either end."""
    return rx(c, r"(?U)^\s+|\s+\z", "")


def cut(c: Text, pattern: str, replacement: str = "$1" + CUT) -> Column:
    """The string in parts: replacement puts a cut mark into each match of pattern. Parts are stripped, empty ones dropped."""
    parts = F.split(rx(c, pattern, replacement), CUT)
    return F.filter(F.transform(parts, strip), lambda p: p != "")


def each(sentences: Column, to_parts: Callable[[Column], Column]) -> Column:
    """An array with every element replaced by the parts it gives."""
    return F.flatten(F.transform(sentences, to_parts))


def mask_matches(c: Text, pattern: str) -> Column:
    """Periods, exclamation and question marks inside matches of pattern hidden."""

    def joined(text: Column) -> Column:
        between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        pairs = F.zip_with(between, found, lambda b, m: F.concat(b, F.coalesce(F.translate(m, ".!?", PERIOD + EXCLAIM + QUESTION), F.lit(""))))
        return F.when(text.rlike(pattern), F.array_join(pairs, "")).otherwise(text)

    return let(col(c), joined)


def unmask(c: Text) -> Column:
    """Hidden punctuation shown again, item marks dropped."""
    return F.translate(col(c), HIDDEN + ITEM, SHOWN)


def deep_plans(least: int = 400) -> None:
    """Room for the analyser of the active session: it resolves one level of nested lambdas in each of its iterations, of which it has 100 by default."""
    spark, key = SparkSession.getActiveSession(), "spark.sql.analyzer.maxIterations"
    if spark is not None and int(spark.conf.get(key)) < least:
        spark.conf.set(key, str(least))


def scan(items: Column, start: Column, step: Callable[[Column, Column], Column], emit: Callable[[Column, Column], Column], kind: str = "string", finish: Callable[[Column, Column], Column] = lambda done, state: done) -> Column:
    """finish(done, state): done has for each item what the array emit(state, item) holds, where state is what step(state, item) made of the items before; state is the last one.

    An array that grows by one element at a time costs the square of its length, so items go in blocks: each block has
    an array of its own, and the blocks' arrays come together in the end. With blocks of the cube root of n items the
    cost is n to the power of 4/3, small against the rules themselves.
    """
    empty, none = F.array().cast(f"array<{kind}>"), F.array().cast(f"array<array<{kind}>>")

    def one(acc: Column, item: Column) -> Column:
        return F.struct(F.concat(acc["done"], emit(acc["state"], item)).alias("done"), step(acc["state"], item).alias("state"))

    def block(acc: Column, some: Column) -> Column:
        return F.aggregate(some, F.struct(empty.alias("done"), acc["state"].alias("state")), one, lambda x: F.struct(F.concat(acc["done"], F.array(x["done"])).alias("done"), x["state"].alias("state")))

    def whole(all_: Column) -> Column:
        size = F.greatest(F.lit(1), F.ceil(F.cbrt(F.size(all_))).cast("int"))
        blocks = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(all_)), size), lambda i: F.slice(all_, i, size))
        return F.aggregate(blocks, F.struct(none.alias("done"), start.alias("state")), block, lambda acc: finish(F.flatten(acc["done"]), acc["state"]))

    return let(items, whole)


def fold_pairs(sentences: Column, absorb: Callable[[Column, Column], Column], rest: Callable[[Column, Column], Column] | None = None, chain: bool = False, left: Callable[[Column, Column], Column] = lambda a, b: a) -> Column:
    """One pass over neighbours: absorb(current, following) is what current takes over (null: nothing), rest what stays of following.

    A result merges again with what follows only if chain is set; a rest becomes the next current sentence.
    """

    def state(out: Column, open_: Column, closed: bool) -> Column:
        return F.struct(out.alias("out"), open_.alias("open"), F.lit(closed).alias("closed"))

    nothing = F.array().cast("array<string>")

    def step(current: Column, closed: Column, following: Column) -> Column:
        pushed = state(F.array(current), following, False)

        def taken(part: Column) -> Column:
            merged = F.concat(left(current, following), F.lit(" "), part)
            whole = state(nothing, merged, not chain)
            if rest is None:
                return whole
            return let(strip(rest(current, following)), lambda r: F.when(r == "", whole).otherwise(state(F.array(merged), r, False)))

        return F.when(current.isNull(), state(nothing, following, False)).otherwise(F.when(closed, pushed).otherwise(let(absorb(current, following), lambda part: F.when(part.isNull(), pushed).otherwise(taken(part)))))

    # out is what the step before has finished; it moves to the result with the next step
    start = F.struct(nothing.alias("out"), F.lit(None).cast("string").alias("open"), F.lit(False).alias("closed"))
    last = lambda done, state: F.concat(done, state["out"], F.when(state["open"].isNull(), nothing).otherwise(F.array(state["open"])))
    return scan(sentences, start, lambda acc, s: step(acc["open"], acc["closed"], s), lambda acc, s: acc["out"], finish=last)


def joined_where(sentences: Column, goes_on: Column, by: str = " ") -> Column:
    """An array whose elements are joined with the following one where goes_on (array<boolean>) says so."""
    marked = F.zip_with(sentences, goes_on, lambda s, g: F.concat(s, F.when(g, F.lit(by)).otherwise(F.lit(CUT))))
    return F.when(F.size(sentences) == 0, sentences).otherwise(let(F.array_join(marked, ""), lambda t: F.split(F.when(t.endswith(CUT), F.substring(t, F.lit(1), F.char_length(t) - 1)).otherwise(t), CUT)))
