from pyspark.sql import functions as F

from loomframe.llm.line_dedup import dedup_lines

SCHEMA = "doc_id long, text string, n_lines string, id string, batch string"


def brute(docs):
    first = {}
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    for i, text in sorted(docs):
        for line in (text or "").split("\n"):
            first.setdefault(key(line), i)
    out = {}
    for i, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or first[key(x)] == i]
        out[i] = ("\n".join(kept), len(lines), len(lines) - len(kept))
    return out


def test_against_brute_force(spark):
    lines = ["The Common Line here", " the common LINE here\t", "ÉCOLE maternelle", "école maternelle", "short", "", "Another one, rather long"]
    docs = [(i, "\n".join(lines[(i * k) % len(lines)] for k in range(1, 2 + i % 6)) + ("\n" if i % 5 == 0 else "")) for i in range(60)]
    docs += [(100, None), (101, ""), (102, "\n".join(f"line number {k} of many" for k in range(20_000))), (103, "line number 7 of many")]
    for batches, fanout in ((1, 2), (5, 2)):
        got = dedup_lines(spark.createDataFrame([(*d, "x", "y", "z") for d in docs], SCHEMA), n_batches=batches, fanout=fanout)
        assert got.columns == ["doc_id", "text", "id", "batch", "n_lines", "n_dropped"]
        assert {r["doc_id"]: (r["text"] or "", r["n_lines"], r["n_dropped"]) for r in got.collect()} == brute(docs)


def test_null_id_repeated_row_and_empty_table(spark):
    rows = [(None, "a line of some length"), (1, "a line of some length"), (1, "a line of some length"), (2, "only in this document")]
    got = sorted((r["doc_id"] or -1, r["text"], r["n_dropped"]) for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(-1, "a line of some length", 0), (1, "", 1), (1, "", 1), (2, "only in this document", 0)]
    assert dedup_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_nothing_is_left_behind_and_columns_of_any_name_stay(spark):
    before = {x.name for x in spark.catalog.listTables()}
    rows = [(1, "a line of some length\nown line number one", 5, 6), (2, "a line of some length\nown line number two", 5, 6)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, _id int, n_dropped int").withColumns({"_row": F.lit(1), "_gone": F.lit(2), "_lines": F.lit(3)})
    got = dedup_lines(frame, dropped_col="gone")
    assert {x.name for x in spark.catalog.listTables()} == before
    assert [(r["doc_id"], r["text"], r["_id"], r["n_dropped"], r["_lines"], r["gone"]) for r in got.orderBy("doc_id").collect()] == [(1, rows[0][1], 5, 6, 3, 0), (2, "own line number two", 5, 6, 3, 1)]
