"""Quotes by any of their lines, short ones, and passages of several conversations."""

from pyspark.sql import functions as F

from corvane.llm import quote_linking


def test_partial_short_and_repeated_quotes(spark):
    a, b = "The second line is what was quoted here.", "This passage stands in two conversations."
    rows = [
        (1, 0, f"Hello\n{a}\nand more"),
        (1, 1, f"> Hi,\n>\n> {a}\nYes."),
        (2, 0, "Why not?"),
        (2, 1, "> why  not?\nBecause."),
        (3, 0, f"> {b}\nfirst"),
        (3, 5, b),
        (4, 2, b),
        (5, 0, "> Why not?\nof another conversation"),
    ]
    chats = spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], "conv_id bigint, turn bigint, role string, text string")
    got = {(r.conv_id, r.turn): (r.source_conv, r.source_turn, r.n_linked) for r in quote_linking.threads(chats).collect()}
    assert got[1, 1] == (1, 0, 1) and got[2, 1] == (2, 0, 1) and got[3, 0] == (4, 2, 1) and got[5, 0] == (2, 0, 1)
    long = {(r.conv_id, r.turn): r.source_conv for r in quote_linking.threads(chats, least=12).collect()}
    assert long[5, 0] is None and long[3, 0] == 4 and long[2, 1] == 2


def test_odd_rows(spark):
    """Null keys, repeated rows, clashing names, empty tables, and only A-Z folded."""
    rows = [(1, 0, "Ä b"), (1, 0, "Ä b"), (1, 1, "> Ä B\nyes"), (1, 1, "> Ä B\nyes"), (1, 2, "> ä b"), (None, 3, "> Ä b"), (2, None, "> Ä b"), (3, 0, None), (4, 0, "")]
    clash = {c: F.lit("x") for c in ("row_id", "own", "runs", "digest", "here_turn", "n", "pair", "spread", "is_hot")}
    chats = spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], "conv_id bigint, turn bigint, role string, text string").withColumns(clash)
    got = quote_linking.threads(chats)
    assert sorted((r.conv_id or 0, r.turn if r.turn is not None else -1, r.source_turn, r.n_linked) for r in got.collect() if r.n_levels) == [(0, 3, None, 0), (1, 1, 0, 1), (1, 1, 0, 1), (1, 2, None, 0), (2, -1, None, 0)]
    assert got.count() == len(rows) and quote_linking.threads(chats.where("false")).collect() == []


def test_one_passage_in_a_third_of_all_messages(spark):
    rows = [(1, 0, "same words")] + [(1, t, "> same words\nown") for t in range(1, 900)] + [(c, 0, f"other {c}") for c in range(2, 900)]
    chats = spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], "conv_id bigint, turn bigint, role string, text string").repartition(8)
    got = [(r.source_conv, r.source_turn) for r in quote_linking.threads(chats).collect() if r.n_levels]
    assert got == [(1, 0)] * 899
