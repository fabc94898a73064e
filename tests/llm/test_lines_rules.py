"""Operator 3: short lines, chains of templates, long texts, and the SQL on lines with masked tokens."""
import time

import duckdb

from tests.llm.helpers import documents, rows_of
from tests.llm.test_llm_relations import brute_lines

from statuta.llm import line_templates
from statuta.llm.oracle import SQL

ROWS = [(1, "alpha beta gamma 1 2 3 4 5 6 7\nRead more here\n\nAll rights reserved", "en", "s"),
        (2, "alpha beta gamma 9 8 7 6 5 4 3\n Read  more here\nAll rights reserved 2020", "en", "s"),
        (3, "Read more here\nAll rights reserved 2021\nMenu", "en", "s"), (4, "Menu\nMenu\nOnly here", "en", "s"),
        # a chain: b repeats a with one field open, c repeats b with another one
        (5, "one two three four five six seven eight nine", "en", "s"),
        (6, "one two three four five six seven ate nine", "en", "s"),
        (7, "one two three for five six seven ate nine", "en", "s"),
        (8, "page 3 of the printed issue of our weekly paper", "en", "s"),
        (9, "page 4 of the printed issue of our weekly paper", "en", "s")]


def dedup(spark, rows):
    return line_templates.dedup_lines(documents(spark, rows))


def test_short_lines_and_chains(spark):
    got = rows_of(dedup(spark, ROWS), "doc_id", "text", "n_lines_dropped")
    assert got == brute_lines(ROWS)
    texts = {i: t for i, t, _ in got}
    assert texts[2] == "alpha beta gamma 9 8 7 6 5 4 3\nAll rights reserved 2020"
    assert texts[3] == "All rights reserved 2021\nMenu" and texts[4] == "Only here"
    # the line of 6 goes; that of 7 only repeats it, and stays
    assert texts[6] == "" and texts[7] == ROWS[6][1] and texts[9] == ""


def test_sql_states_the_rule(spark):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [(i, t) for i, t, *_ in ROWS])
    got = con.execute(f"SELECT doc_id, text, n_lines_dropped FROM ({SQL['op3_line_templates']})").fetchall()
    assert sorted(got, key=str) == brute_lines(ROWS)


def test_time_follows_the_length_of_a_text(spark):
    def seconds(n):
        rows = [(i, "\n".join(f"line {k} of a very long text with many lines x{i if k else 0}" for k in range(n)), "en", "s")
                for i in (1, 2)]
        start = time.perf_counter()
        dropped = dedup(spark, rows).agg({"n_lines_dropped": "sum"}).first()[0]
        assert dropped >= 1
        return time.perf_counter() - start

    seconds(1_000)
    assert seconds(80_000) < 5 * max(seconds(20_000), 2.0)


def test_short_items_inside_long_documents(spark):
    """Items of one to four words are found as runs of words, by Spark and by the SQL."""
    from statuta.llm import decontaminate

    items = [(1, "Paris"), (2, "blue  whale"), (3, "who wrote hamlet ?"), (4, "capital of france is"),
             (5, "one two three four five six"), (6, ""), (7, None)]
    texts = [(10, "They say a Blue whale eats krill in the wide open sea"), (11, "who, wrote Hamlet"), (12, "wrote hamlet who"),
             (13, "x " * 50 + "The capital of France is Paris. " + "y " * 50), (14, "one two three four five six"), (15, None),
             (16, "whale blue parisian"), (17, "")]
    docs = documents(spark, [(i, t, "en", "s") for i, t in texts])
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == {(10, 2), (11, 3), (13, 1), (13, 4), (14, 5)}
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", texts)
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", items)
    assert {tuple(r[:2]) for r in con.execute(SQL["op7_decontaminate"]).fetchall()} == got
    left = [r["doc_id"] for r in decontaminate.drop_contaminated(docs, bench).collect()]
    assert sorted(left) == [12, 15, 16, 17]
