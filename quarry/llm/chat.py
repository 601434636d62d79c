"""Conversations in reply order without quotes, by quotation linking.

The lines of a message have a quote level, the number of `>` before them. Runs of lines of one level
are passages. Quoted passages, and their single lines, are normalised (lower case, single spaces) and
hashed, and joined to the first message of the conversation that wrote the same as its own text. The
message that most of a message's level-1 text comes from is the one it replies to, if it is earlier.
Replies follow what they answer: a thread's messages are ranked along a walk through it by pointer
jumping, so a thread of length n takes log n joins of rows of fixed size. Lines that introduce a quote (`On ... wrote:`) go with it.

Everything is SQL functions and joins. An original is one row per conversation and hash, so a line
that everybody writes or quotes makes no pairs; the order comes from a range partitioning, so a
conversation of any length is spread over tasks.

Defined results: null text stays null and has no quotes; a message without a linked quote starts a
thread at its own turn; a message repeated under one turn shares that turn's parent; rows without a
conversation or turn are not linked; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import materialize, table
from quarry.operators.graph import numbered

# Quote marks, and lines that introduce a quote.
MARKS = r"^((?:[ \t]*>)*)"
INTRODUCES = r"(?i)^\s*(?:on\b.*\bwrote|am\b.*\bschrieb\b.*|le\b.*\ba écrit|el\b.*\bescribió)\s*:\s*$"


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def _hash(text: Column) -> Column:
    """Two 64-bit hashes, as one string column to join by."""
    return F.concat_ws(".", F.xxhash64(text).cast("string"), F.xxhash64(F.lit(9), text).cast("string"))


def parse(messages: DataFrame) -> DataFrame:
    """Adds passages (array of level, text), own (the text without quotes) and n_quotes; each step's arrays are columns of their own."""
    df = messages.withColumn("_lines", F.split(F.coalesce("text", F.lit("")), "\n", -1))
    df = df.withColumn("_marks", F.transform("_lines", lambda x: F.regexp_extract(x, MARKS, 1)))
    df = df.withColumn("_levels", F.transform("_marks", lambda m: F.length(F.regexp_replace(m, "[^>]+", ""))))
    df = df.withColumn("_bodies", F.zip_with("_lines", "_marks", lambda x, m: F.substring(x, F.length(m) + 1, F.length(x))))
    changes = F.filter(F.sequence(F.lit(0), F.size("_lines") - 1), lambda i: (i == 0) | (F.get("_levels", i) != F.get("_levels", i - 1)))
    df = df.withColumn("_starts", changes)
    end = lambda k: F.coalesce(F.get("_starts", k + 1), F.size("_lines"))
    passages = F.transform("_starts", lambda s, k: F.struct(F.get("_levels", s).alias("level"), F.array_join(F.slice("_bodies", s + 1, end(k) - s), "\n").alias("text")))
    df = df.withColumn("passages", passages)
    introduces = lambda i: F.get("_lines", i).rlike(INTRODUCES) & (F.coalesce(F.get("_levels", i + 1), F.lit(0)) > 0)
    kept = F.filter(F.sequence(F.lit(0), F.size("_lines") - 1), lambda i: (F.get("_levels", i) == 0) & ~introduces(i))
    own = F.regexp_replace(F.array_join(F.transform(kept, lambda i: F.get("_lines", i)), "\n"), r"^\n+|\n+$", "")
    quoted = F.array_max("_levels") > 0
    df = df.withColumn("own", F.when(quoted, own).otherwise(F.col("text")))
    df = df.withColumn("n_quotes", F.size(F.filter("passages", lambda p: p["level"] > 0)).cast("long"))
    return df.drop("_lines", "_marks", "_levels", "_bodies", "_starts")


def _units(passages: Column, own: bool) -> Column:
    """(level, hash, size) of passages and their lines, normalised and not empty."""
    chosen = F.filter(passages, lambda p: (p["level"] == 0) if own else (p["level"] > 0))
    both = lambda p: F.array_distinct(F.concat(F.array(p["text"]), F.split(p["text"], "\n", -1)))
    units = F.flatten(F.transform(chosen, lambda p: F.transform(both(p), lambda t: F.struct(p["level"].alias("level"), normalised(t).alias("t")))))
    return F.transform(F.filter(units, lambda u: u["t"] != ""), lambda u: F.struct(u["level"].alias("level"), _hash(u["t"]).alias("hash"), F.length(u["t"]).alias("size")))


def links(parsed: DataFrame) -> DataFrame:
    """(conv_id, turn, level, of, size): quoted text found as the own text of turn `of`, before this one."""
    units = lambda own: parsed.select("conv_id", "turn", F.explode(F.array_distinct(_units(F.col("passages"), own))).alias("u")).select("conv_id", "turn", "u.*")
    quotes = units(False).where("turn is not null").distinct()
    first = units(True).where("turn is not null").groupBy("conv_id", "hash").agg(F.min("turn").alias("of"))
    found = quotes.join(first, ["conv_id", "hash"]).where(F.col("of") < F.col("turn"))
    return found.select("conv_id", "turn", "level", "of", "size")


def parents(found: DataFrame) -> DataFrame:
    """(conv_id, turn, parent): the turn that most of the least deep linked text is from, the latest of equals."""
    sums = found.groupBy("conv_id", "turn", "level", "of").agg(F.sum("size").alias("size"))
    return sums.groupBy("conv_id", "turn").agg(F.max(F.struct((-F.col("level")).alias("l"), F.col("size"), F.col("of"))).alias("best")).select("conv_id", "turn", F.col("best.of").alias("parent"))


def tour(replies: DataFrame) -> DataFrame:
    """(conv_id, turn, parent, root, after, depth) of every message in a thread: `after` falls along the thread, `depth` is 0 at its root.

    A thread is walked as a list with two places a message, one going down into it and one coming up.
    Each round of pointer jumping doubles the stretch a place has counted, from itself towards the
    end: messages entered, and entered less left. Rows are of fixed size, however long the thread.
    """
    replies = materialize(replies.select("conv_id", "turn", "parent"), "replies")
    roots = replies.select("conv_id", F.col("parent").alias("turn")).distinct().join(replies.select("conv_id", "turn"), ["conv_id", "turn"], "left_anti")
    first = replies.groupBy("conv_id", F.col("parent").alias("turn")).agg(F.min("turn").alias("child"))
    ranked = materialize(numbered(replies, ["conv_id", "parent", "turn"], "n"), "siblings")
    later = ranked.select((F.col("n") - 1).alias("n"), F.col("conv_id").alias("c"), F.col("parent").alias("p"), F.col("turn").alias("sibling"))
    nexts = ranked.join(later, "n").where((F.col("conv_id") == F.col("c")) & (F.col("parent") == F.col("p"))).select("conv_id", "turn", "sibling")
    nodes = replies.unionByName(roots.withColumn("parent", F.lit(None).cast("long"))).join(first, ["conv_id", "turn"], "left").join(nexts, ["conv_id", "turn"], "left")
    place = lambda up, to, to_up, entered, left: F.struct(F.lit(up).alias("up"), to.alias("to"), to_up.alias("to_up"), F.lit(entered).cast("long").alias("after"), F.lit(left).cast("long").alias("open"))
    down = place(False, F.coalesce("child", "turn"), F.col("child").isNull(), 1, 1)
    up = place(True, F.coalesce("sibling", "parent"), F.col("sibling").isNull(), 0, -1)
    state = nodes.select("conv_id", "turn", "parent", F.explode(F.array(down, up)).alias("x")).select("conv_id", "turn", "parent", "x.*")
    state = materialize(state.withColumn("root", F.when(F.col("to").isNull(), F.col("turn"))), "tour")
    while not state.where("to is not null").isEmpty():
        ahead = state.select("conv_id", F.col("turn").alias("to"), F.col("up").alias("to_up"), F.col("to").alias("t"), F.col("to_up").alias("u"), F.col("after").alias("a"), F.col("open").alias("o"), F.col("root").alias("r"))
        joined = state.join(ahead, ["conv_id", "to", "to_up"], "left")
        more = lambda c, by: (F.col(c) + F.coalesce(by, F.lit(0))).alias(c)
        state = materialize(joined.select("conv_id", "turn", "parent", "up", F.col("t").alias("to"), F.col("u").alias("to_up"), more("after", "a"), more("open", "o"), F.coalesce("root", "r").alias("root")), "tour")
    return state.where(~F.col("up")).select("conv_id", "turn", "parent", "root", "after", (-F.col("open")).alias("depth"))


def segment(role: Column, text: Column) -> Column:
    """A message between role markers; a `<|` in its text is written `< |`, so no text can end its own segment."""
    return F.concat(F.lit("<|im_start|>"), F.coalesce(role, F.lit("unknown")), F.lit("\n"), F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |")), F.lit("<|im_end|>\n"))


def conversations(messages: DataFrame) -> DataFrame:
    """Per message: conv_id, position (from 0, in reply order), turn, role, text without quotes, parent_turn, depth, n_quotes, n_linked, segment."""
    parsed = materialize(parse(messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", F.col("text").cast("string").alias("text"))), "messages")
    found = materialize(links(parsed), "quote-links")
    told = tour(parents(found)).join(found.groupBy("conv_id", "turn").agg(F.count("*").alias("n_linked")), ["conv_id", "turn"], "left")
    rows = parsed.drop("passages", "text").join(told, ["conv_id", "turn"], "left")
    rows = rows.withColumn("root", F.coalesce("root", "turn")).withColumn("place", -F.coalesce("after", F.lit(0)))
    ranked = materialize(numbered(rows, ["conv_id", "root", "place", "turn", "role", "own"], "rank"), "ranked")
    base = materialize(ranked.groupBy("conv_id").agg(F.min("rank").alias("base")), "conversations")
    placed = ranked.join(base.withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c")))
    return placed.select(
        "conv_id", (F.col("rank") - F.col("base")).alias("position"), "turn", "role", F.col("own").alias("text"), F.col("parent").alias("parent_turn"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"), "n_quotes",
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), segment(F.col("role"), F.col("own")).alias("segment"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations(table(spark, sf_dir, "conversations"))
