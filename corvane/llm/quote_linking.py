"""Chat formatting: quoted passages linked to the messages they come from; DataFrame functions alone."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import lookup, written
from corvane.llm.decontaminate import let

#: A line's marks of quotation, before its text.
MARKS = r"^[ \t]*((?:>[ \t]?)+)"


def level(line: Column) -> Column:
    """How deep a line is quoted: its marks of quotation, 0 for own text."""
    return F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 1), "[^>]", ""))


def normalised(text: Column) -> Column:
    """White space collapsed, A-Z lower-cased: what a quoting program may change."""
    return F.trim(F.regexp_replace(F.translate(text, string.ascii_uppercase, string.ascii_lowercase), r"\s+", " "))


def _runs(lines: Column) -> Column:
    """Maximal runs of lines of one level: an array of (level, text), the text without marks; each line is copied once."""
    marked = F.struct(F.transform(lines, level).alias("levels"), F.transform(lines, lambda x: F.regexp_replace(x, MARKS, "")).alias("texts"))
    begins = lambda m: F.filter(F.sequence(F.lit(0), F.size(m["levels"]) - 1), lambda i: (i == 0) | (F.get(m["levels"], i) != F.get(m["levels"], i - 1)))

    def cut(m: Column) -> Column:
        end = lambda at, k: F.coalesce(F.get(at, k + 1), F.size(m["levels"]))
        return let(begins(m), lambda at: F.transform(at, lambda i, k: F.struct(F.get(m["levels"], i).alias("level"), F.array_join(F.slice(m["texts"], i + 1, end(at, k) - i), "\n").alias("text"))))

    return let(marked, cut)


def messages(chats: DataFrame, text: str = "text") -> DataFrame:
    """chats with row_id and, of the text, own (without quotes), runs (quoted ones, by level) and n_levels.

    Lines of a message without a mark are taken whole; only the others are cut into runs.
    """
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    has = F.coalesce(F.col(text), F.lit("")).rlike("(?m)" + MARKS)
    none = F.array().cast("array<struct<level:int,text:string>>")
    runs = F.when(has, F.filter(_runs(lines), lambda r: r["level"] > 0)).otherwise(none)
    own = F.when(has, F.trim(F.array_join(F.filter(lines, lambda x: level(x) == 0), "\n"))).otherwise(F.coalesce(F.col(text), F.lit("")))
    deepest = F.when(has, F.array_max(F.transform(lines, level))).otherwise(F.lit(0))
    return chats.withColumn("row_id", F.monotonically_increasing_id()).withColumns({"own": own, "runs": runs, "n_levels": deepest.cast("bigint")})


def passages(rows: DataFrame) -> DataFrame:
    """(row_id, conv_id, turn, hash) of every passage a message can be quoted by: its own text whole, and each line of it."""
    parts = F.array_distinct(F.concat(F.array("own"), F.split("own", "\n")))
    flat = rows.where("conv_id IS NOT NULL AND turn IS NOT NULL").select("row_id", "conv_id", "turn", F.explode(F.transform(parts, normalised)).alias("passage"))
    return flat.where(F.length("passage") > 0).select("row_id", "conv_id", "turn", F.xxhash64("passage").alias("hash"), F.sha2("passage", 256).alias("digest"))


def linked(rows: DataFrame, least: int = 1) -> DataFrame:
    """(row_id, source_conv, source_turn, level): the message each quoting row answers, by its shallowest linked quote.

    A quote is looked for whole, then by each of its lines in order; each in its own conversation
    first, in the earliest turn that has the passage and precedes the quoting one, else, if it has `least`
    characters (by default any passage), in the other conversations, in the earliest message. Both sides are grouped by passage
    before they meet, so a passage that stands in a third of all messages is one row; and where a third of all quotes are of one
    passage in one conversation, those rows are spread.
    """
    quotes = rows.where((F.size("runs") > 0) & F.col("conv_id").isNotNull() & F.col("turn").isNotNull()).select("row_id", "conv_id", "turn", F.posexplode("runs").alias("place", "run"))
    text = F.col("run.text")
    tried = F.array_distinct(F.concat(F.array(normalised(text)), F.transform(F.split(text, "\n"), normalised)))
    quotes = quotes.select("row_id", "conv_id", "turn", F.col("run.level").alias("level"), "place", F.posexplode(tried).alias("part", "passage")).where(F.length("passage") > 0)
    quotes = written(quotes.withColumns({"long": F.length("passage") >= least, "digest": F.sha2("passage", 256)}).drop("passage"), "quotes")
    wanted = quotes.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.first("long").alias("long"))
    found = passages(rows).join(wanted.select("digest"), "digest", "left_semi")
    here = written(found.groupBy("digest", "conv_id").agg(F.min("turn").alias("here_turn")), "here")
    # The earliest messages of the two smallest conversations: one of them isn't the quoting one.
    first = written(here.groupBy("digest").agg(F.min(F.struct("conv_id", "here_turn")).alias("f"), F.count(F.lit(1)).alias("n_convs")), "first")
    second = lookup(here, first, "digest", "n_convs").where(F.col("conv_id") > F.col("f.conv_id")).groupBy("digest").agg(F.min(F.struct("conv_id", "here_turn")).alias("g"))
    there = wanted.where("long").join(first.drop("n_convs"), "digest").join(second, "digest", "left")
    there = written(there.select("digest", "n", F.col("f.conv_id").alias("there_conv"), F.col("f.here_turn").alias("there_turn"), F.col("g.conv_id").alias("next_conv"), F.col("g.here_turn").alias("next_turn")), "sources")
    pair = F.concat_ws("/", "digest", F.col("conv_id").cast("string"))
    asked = quotes.groupBy("digest", "conv_id").agg(F.count(F.lit(1)).alias("n"))
    own = written(here.join(asked, ["digest", "conv_id"]).select(pair.alias("pair"), "here_turn", "n"), "own")
    both = lookup(quotes.withColumn("pair", pair), own, "pair", "n")
    both = lookup(both.select("row_id", "conv_id", "turn", "level", "place", "part", "digest", "here_turn"), there, "digest", "n")
    inside = F.coalesce(F.col("here_turn") < F.col("turn"), F.lit(False))
    other = F.col("there_conv") != F.col("conv_id")
    out_conv, out_turn = F.when(other, F.col("there_conv")).otherwise(F.col("next_conv")), F.when(other, F.col("there_turn")).otherwise(F.col("next_turn"))
    ok = both.where(inside | out_conv.isNotNull()).withColumns({"source_conv": F.when(inside, F.col("conv_id")).otherwise(out_conv), "source_turn": F.when(inside, F.col("here_turn")).otherwise(out_turn)})
    best = ok.groupBy("row_id").agg(F.min(F.struct("level", "place", "part", (~inside).alias("outside"), "source_conv", "source_turn")).alias("b"), F.countDistinct("place").alias("n_linked"))
    return best.select("row_id", "b.source_conv", "b.source_turn", "n_linked")


def roots(edges: DataFrame) -> DataFrame:
    """(conv_id, turn, root_turn, depth) of answering messages inside a conversation, by doubling of pointers.

    edges: unique (conv_id, turn) with an earlier parent turn. Each round halves what is left of the way
    to the root; the rounds grow with the logarithm of the longest thread.
    """
    state = written(edges.select("conv_id", "turn", F.col("parent").alias("up"), F.lit(1).cast("bigint").alias("depth")), "threads")
    while True:
        above = state.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"))
        joined = written(state.join(above, ["conv_id", "up"], "left"), "threads")
        state = joined.select("conv_id", "turn", F.coalesce("next", "up").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))
        if joined.where("next IS NOT NULL").isEmpty():
            return state.select("conv_id", "turn", F.col("up").alias("root_turn"), "depth")


def threads(chats: DataFrame, least: int = 1) -> DataFrame:
    """Every message with its place in a reply-ordered conversation, and its text without quotes.

    Returns conv_id, turn, role, source_conv and source_turn (the message that it quotes, or null),
    n_levels, n_linked, root_turn, depth and text. Sorted by (conv_id, root_turn, turn), each answer
    follows the message that it answers, and unlinked messages keep their order. Quotes of another
    conversation are linked but start no thread; quotes of fewer than `least` characters aren't sought there. Null texts are empty; messages of a null conversation
    or turn are linked with nothing; repeated (conv_id, turn) rows are all kept, and share their thread.
    """
    rows = written(messages(chats.select("conv_id", "turn", "role", "text")), "messages")
    links = written(linked(rows, least), "links")
    base = rows.select("row_id", "conv_id", "turn", "role", "n_levels", F.col("own").alias("text")).join(links, "row_id", "left")
    edges = base.where(F.col("source_conv") == F.col("conv_id")).groupBy("conv_id", "turn").agg(F.min("source_turn").alias("parent"))
    found = roots(edges)
    out = base.join(found, ["conv_id", "turn"], "left")
    return out.select("conv_id", "turn", "role", "source_conv", "source_turn", "n_levels", F.coalesce("n_linked", F.lit(0)).alias("n_linked"), F.coalesce("root_turn", "turn").alias("root_turn"), F.coalesce("depth", F.lit(0)).alias("depth"), "text")
