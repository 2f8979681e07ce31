"""Registered queries without SQL read whole tables and whole texts."""

import difflib

from loomframe.plans.catalogue import QUERIES


def test_text_ratio_compares_whole_turns(spark, tmp_path):
    turns = [(1, 0, "a" * 250), (1, 1, "a" * 250 + "bcd" * 400)]
    spark.createDataFrame(turns, "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    (row,) = QUERIES["text_ratio"](spark, str(tmp_path)).collect()
    assert row["ratio"] == round(difflib.SequenceMatcher(None, turns[0][2], turns[1][2]).ratio(), 4) != 1.0


def test_capped_selection_takes_the_first_line_whatever_its_quantity(spark, tmp_path):
    lines = [(1, "A", "F", 1, 5.0), (1, "R", "F", 2, 45.0), (2, "N", "O", 1, 1.0)]
    spark.createDataFrame(lines, "l_orderkey long, l_returnflag string, l_linestatus string, l_linenumber int, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert {(r["l_orderkey"], r["grp"]) for r in QUERIES["capped_selection"](spark, str(tmp_path)).collect()} == {(1, "AF"), (2, "NO")}
