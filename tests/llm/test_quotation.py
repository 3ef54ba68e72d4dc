import duckdb
import pytest

from matgraph.llm import quotation
from matgraph.llm.queries import ORACLE, QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, body string, key string"

ROWS = [
    (1, 0, "user", "How do I sort a list?\nIt has  many ITEMS."),
    (1, 1, "assistant", "On Monday Ann wrote:\n> how do i sort a list?\n> it has many items.\n\nUse sorted()."),
    (1, 2, "user", "> > How do I sort a list?\n> Use sorted().\nThanks, and in reverse?"),
    (1, 3, "assistant", "> something nobody has said\nHm."),
    (2, 0, "user", ">Use   SORTED().\nWhat is this?"),
    (2, 1, None, None),
    (2, 2, "user", "> What is this?\r\n>\r\n> another line\r\nIt is a quote."),
    (3, 5, "user", "> It is a quote.\nI see > you"),
    (3, 6, "user", "> only my own words here\nfoo\n\nonly my own words here"),
    (None, 1, "user", "> It is a quote.\nno conversation"),
    (4, None, "user", "Use sorted()."),
    (5, 0, "user", "ok"),
    (6, 0, "user", "> ok\nshort passages link inside a conversation only"),
    (6, 1, "user", "ok"),
    (6, 2, "user", "> ok\nyes"),
]


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)


def test_links(spark):
    got = {(r["conv_id"], r["turn"]): r for r in quotation.linked(table(spark, ROWS)).collect()}
    assert len(got) == len(ROWS)
    told = {k: (r["n_quotes"], r["n_linked"], r["reply_conv"], r["reply_turn"]) for k, r in got.items()}
    assert told[1, 1] == (1, 1, 1, 0) and told[1, 2] == (2, 2, 1, 1) and told[1, 3] == (1, 0, None, None)
    assert told[2, 0] == (1, 0, None, None)  # two words only
    assert told[2, 2] == (1, 1, 2, 0) and told[3, 5] == (1, 1, 2, 2) and told[3, 6] == (1, 0, None, None)
    assert told[None, 1][3] in (None, 2) and told[6, 0] == (1, 0, None, None) and told[6, 2] == (1, 1, 6, 1)
    assert got[1, 1]["body"] == "Use sorted()." and got[1, 2]["body"] == "Thanks, and in reverse?" and got[3, 5]["body"] == "I see > you"
    assert [got[1, t]["position"] for t in range(4)] == [1, 2, 3, 4] and got[None, 1]["position"] is None and got[4, None]["position"] is None
    # The reply in 3 to a message of 2 joins these two.
    assert [(got[k]["thread_id"], got[k]["position"]) for k in ((2, 0), (2, 1), (2, 2), (3, 5), (3, 6), (1, 0), (6, 0))] == [
        (2, 1), (2, 2), (2, 3), (2, 4), (2, 5), (1, 1), (6, 1)]
    assert got[None, 1]["thread_id"] is None is got[4, None]["thread_id"]


LATER = [  # the first holder is the quote's own conversation; a chain of threads; a reply to a later conversation
    (5, 1, "user", "> one line of words\nand mine"), (5, 4, "user", "one line of words"), (9, 0, "user", "one line of words"),
    (12, 1, "user", "> one line of words\nand mine"), (13, 0, "user", "> and mine to answer\nwell"), (12, 9, "user", "and mine to answer"),
    (20, 1, "user", "> held here only later\nhm"), (20, 2, "user", "held here only later"), (None, 0, "user", "> one line of words"),
]


ODD = [  # characters that end lines elsewhere, around marks, attributions and edges
    (1, 0, "user", "  plain text\u2028> not a quote line  "),
    (1, 1, "user", "  plain\u0085> x  "),
    (1, 2, "user", "On\u2028Monday Ann wrote:\n> plain text of one\n  mine\u2029 \u2028\n"),
    (1, 3, "user", "Le lundi Ann A ÉCRIT:\n> plain text of one\n \x0b mine \x0b"),
    (1, 4, "user", "Ann wrote:\u2028\n> plain text of one\nmine \u2028"),
    (1, 5, "user", "Ann wrote:\u0085\n> plain text of one\n\u2029mine\u0085"),
    (1, 6, "user", "a\u2029b said:\n> plain\u2028text of\u0085one\n"),
    (1, 7, "user", "Ann ſaid:\r> plain\rmine\r\n\r"),
    (0, 0, "user", "plain text of one\nplain\u2028text of\u0085one"),
]
ALL = ROWS + [(r[0] and 10 * r[0], *r[1:]) for r in LATER]


@pytest.mark.parametrize("rows", [ROWS, LATER, ODD, ODD * 3, ALL])
def test_equals_sql(spark, rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    want = con.execute(ORACLE["op9_quotation"])
    names = [d[0] for d in want.description]
    got = quotation.linked(table(spark, rows))
    assert sorted(map(repr, map(tuple, got.select(*names).collect()))) == sorted(map(repr, want.fetchall()))


def test_chat_threads_equal_sql(spark, tmp_path):
    rows = ALL + [(r[0] and 1000 + r[0], *r[1:]) for r in ODD] + [(77, t, "user", f"turn {t}") for t in range(2500)]
    table(spark, rows).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.execute(ORACLE["chat_threads"])
    names = [d[0] for d in want.description]
    got = QUERIES["chat_threads"](spark, str(tmp_path))
    assert sorted(map(repr, map(tuple, got.select(*names).collect()))) == sorted(map(repr, want.fetchall()))


@pytest.mark.parametrize("span", [quotation.SPAN, 4])
def test_long_conversations_and_hot_quotes(spark, monkeypatch, span):
    monkeypatch.setattr(quotation, "SPAN", span)
    rows = [(9, t, "user", f"message {t}" if t % 2 else "the very same words\n> the very same words") for t in range(60)]
    rows += [(100 + c, 0, "user", "> the very same words\nand mine") for c in range(50)]
    rows += [(9, 7, "user", "message 7")]
    got = quotation.linked(table(spark, rows))
    found = got.collect()
    assert len(found) == 111 and sorted(r["position"] for r in found if r["conv_id"] == 9) == list(range(1, 62))
    assert {(r["reply_conv"], r["reply_turn"]) for r in found if r["conv_id"] >= 100} == {(9, 0)}
    assert "Python" not in got._jdf.queryExecution().toString() and "Arrow" not in got._jdf.queryExecution().toString()
    assert {r["thread_id"] for r in found} == {9} and sorted(r["position"] for r in found) == list(range(1, 112))
    parts = quotation.formatted(table(spark, rows)).collect()
    assert {p["thread_id"] for p in parts} == {9} and len(parts) == -(-111 // span)
    assert sum(p["text"].count("<|user|>") for p in parts) == 111 and not any("\n>" in p["text"] for p in parts)


def test_every_message_comes_after_the_one_it_replies_to(spark):
    rows = [(c, t, "user", (f"> words of {c - 1} and {t}\n" if c % 5 else "") + f"words of {c} and {t}") for c in range(40) for t in range(3)]
    got = {(r["conv_id"], r["turn"]): r for r in quotation.linked(table(spark, rows)).collect()}
    assert {r["thread_id"] for r in got.values()} == set(range(0, 40, 5))
    for r in got.values():
        if r["reply_conv"] is not None:
            original = got[r["reply_conv"], r["reply_turn"]]
            assert original["thread_id"] == r["thread_id"] and original["position"] < r["position"]


def test_rows_without_a_place_and_a_very_long_text(spark):
    long = "> quoted words here\n" + "own line\n" * 200_000
    rows = [(None, 1, "user", "x")] * 50 + [(1, None, "user", "y")] * 50 + [(2, 0, "user", "quoted words here"), (2, 1, "user", long)]
    got = quotation.linked(table(spark, rows)).collect()
    assert len(got) == 102 and sum(r["position"] is None and r["thread_id"] is None for r in got) == 100
    assert [(r["reply_turn"], r["position"], len(r["body"])) for r in got if r["turn"] == 1 and r["conv_id"] == 2] == [(0, 2, 9 * 200_000 - 1)]


def test_empty(spark):
    assert quotation.linked(table(spark, [])).count() == 0


def test_a_quote_whose_own_conversation_is_the_first_holder(spark):
    rows = [(5, 1, "user", "> one line of words\nand mine"), (5, 4, "user", "one line of words"), (9, 0, "user", "one line of words")]
    rows += [(12, 1, "user", "> one line of words\nand mine"), (20, 1, "user", "> held here only later\nhm"), (20, 2, "user", "held here only later")]
    got = {(r["conv_id"], r["turn"]): (r["reply_conv"], r["reply_turn"]) for r in quotation.linked(table(spark, rows)).collect()}
    assert got[5, 1] == (9, 0) and got[12, 1] == (5, 4) and got[20, 1] == (None, None)
