"""Quotation linking against a plain recount of a small mailbox, and odd inputs."""

import re

from curbline.llm import quotes as Q

SCHEMA = "conv_id long, turn long, role string, text string, id string"
MAILS = [
    (1, 0, "a", "Shall we meet on Monday?\nOr on Tuesday?", "x"),
    (1, 1, "b", "On Sunday, a wrote:\n> Shall we meet on Monday?\n> Or on  tuesday?\n\nMonday is fine.", "x"),
    (1, 2, "c", "> > Or on Tuesday?\n> Monday is fine.\nNot for me.", "x"),
    (1, 3, "a", "> Shall we meet on Monday?\nStill open.", "x"),
    (2, 0, "d", "> monday is FINE.\nI saw this elsewhere.", "x"),
    (2, 1, "e", "> nobody said this\nNew words.", "x"),
    (2, 2, "e", "> I saw this elsewhere.\n", "x"),
]


def test_links_and_threads(spark):
    rows = {(r["conv_id"], r["turn"]): r for r in Q.threads(spark.createDataFrame(MAILS, SCHEMA)).collect()}
    parent = {k: (r["reply_to_conv"], r["reply_to_turn"]) for k, r in rows.items()}
    assert parent == {(1, 0): (None, None), (1, 1): (1, 0), (1, 2): (1, 1), (1, 3): (1, 0), (2, 0): (1, 1), (2, 1): (2, 0), (2, 2): (2, 0)}
    assert {k for k, r in rows.items() if r["by_quote"]} == {(1, 1), (1, 2), (1, 3), (2, 0), (2, 2)}
    assert all((r["thread_conv"], r["thread_turn"]) == (1, 0) for r in rows.values())
    assert {k: r["depth"] for k, r in rows.items()} == {(1, 0): 0, (1, 1): 1, (1, 3): 1, (1, 2): 2, (2, 0): 2, (2, 1): 3, (2, 2): 3}
    assert sorted(r["position"] for r in rows.values()) == list(range(1, 8))
    assert all(rows[k]["position"] > rows[p]["position"] for k, p in parent.items() if p[0])
    assert rows[1, 1]["text"] == "\nMonday is fine.".strip("\n") and rows[1, 2]["text"] == "Not for me." and rows[2, 2]["text"] == ""
    assert not any(re.search(r"(?m)^>", r["text"]) for r in rows.values())


def test_long_chain_and_odd_rows(spark):
    chain = [(5, t, "u", f"message {t}", "x") for t in range(40)]
    odd = [(None, 0, "u", "hi", "x"), (None, None, None, None, "x"), (7, 0, "u", "", "x"), (7, 0, "u", "", "x"), (8, 0, "u", "> hi\nyes", "x")]
    rows = Q.threads(spark.createDataFrame(chain + odd, SCHEMA)).collect()
    assert len(rows) == 45
    assert sorted((r["turn"], r["depth"], r["position"]) for r in rows if r["conv_id"] == 5) == [(t, t, t + 1) for t in range(40)]
    seven = sorted((r["depth"], r["text"]) for r in rows if r["conv_id"] == 7)
    assert seven == [(0, ""), (1, "")]
    eight = [r for r in rows if r["conv_id"] == 8][0]
    assert eight["by_quote"] and eight["reply_to_conv"] is None and eight["reply_to_turn"] == 0


def test_empty(spark):
    assert Q.threads(spark.createDataFrame([], SCHEMA)).count() == 0
