"""S1/S2 on real files: NA strings, malformed rows, extension and size verdicts."""

import os

from pyspark.sql import types as T

from ledgerlake.session import scratch_path
from ledgerlake.sources import ingest as IN


def _local(path):
    return path[len("file:"):] if path.startswith("file:") else path


def test_manifest_verdicts(spark):
    d = _local(scratch_path(spark, "landing"))
    os.makedirs(d)
    for name, size in [("a.CSV", 10), ("b.xlsx", 5), ("notes.txt", 3), ("noext", 2), ("scan.pdf", 7)]:
        with open(os.path.join(d, name), "wb") as f:
            f.write(b"x" * size)
    rows = {r["file_name"]: r for r in IN.ingest_manifest(spark, d).collect()}
    assert rows["a.CSV"]["extension"] == "csv" and rows["a.CSV"]["is_valid"]
    assert rows["b.xlsx"]["is_valid"] and rows["scan.pdf"]["is_valid"]
    assert not rows["notes.txt"]["is_valid"] and rows["notes.txt"]["errors"] == "Unsupported file type: txt"
    assert rows["noext"]["extension"] == "" and not rows["noext"]["is_valid"]
    small = {r["file_name"]: r for r in IN.ingest_manifest(spark, d, max_bytes=6).collect()}
    assert not small["a.CSV"]["is_valid"] and "exceeds" in small["a.CSV"]["errors"]


def test_csv_na_strings_and_quarantine(spark):
    d = _local(scratch_path(spark, "csvin"))
    os.makedirs(d)
    with open(os.path.join(d, "x.csv"), "w") as f:
        f.write("id,name,amount\n1,alpha,10.5\n2,N/A,7\n3,null,oops\n4,beta,\n")
    schema = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("name", T.StringType()),
                           T.StructField("amount", T.DoubleType())])
    df = IN.read_csv(spark, d, schema=schema, corrupt_column="_bad")
    rows = {r["id"]: r for r in df.collect()}
    assert rows[1]["name"] == "alpha" and rows[1]["amount"] == 10.5
    assert rows[2]["name"] is None and rows[3]["name"] is None
    assert rows[3]["amount"] is None and rows[3]["_bad"] is not None
    assert rows[4]["amount"] is None and rows[4]["_bad"] is None


def test_na_text_in_number_columns_is_missing_and_not_quarantined(spark):
    d = _local(scratch_path(spark, "csvna"))
    os.makedirs(d)
    with open(os.path.join(d, "x.csv"), "w") as f:
        f.write("id,amount,day,ok\n1,N/A,2024-01-05,true\n2,1e3,nan,false\n3,12 apples,2024-13-01,maybe\n4,5\n5,6,2024-02-01,true,9\n")
    schema = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("amount", T.DoubleType()),
                           T.StructField("day", T.DateType()), T.StructField("ok", T.BooleanType())])
    good, bad = IN.split_rejected(IN.scan_csv(spark, d, schema))
    assert [(r.id, r.amount, str(r.day), r.ok) for r in good.orderBy("id").collect()] == [
        (1, None, "2024-01-05", True), (2, 1000.0, "None", False)]
    assert {r.id: r._rejected for r in bad.collect()} == {3: ["amount", "day", "ok"], 4: ["_record"], 5: ["_record"]}


def test_headers_of_several_tables_of_a_document(spark):
    def grid(page, strategy, no, rows):
        return [("d", page, strategy, no, i, j, t) for i, row in enumerate(rows) for j, t in enumerate(row)]
    wide = [["Title", " ", "", ""], ["A", "B", "C", ""], ["1", "2", "", "4"], ["", " ", "", ""], ["5", "6", "7", "8"]]
    cells = (grid(2, "stream", 0, wide) + grid(1, "lattice", 0, wide[:2]) + grid(2, "lattice", 1, wide)
             + grid(3, "lattice", 0, [["x", "y", "z", "w"]] * 5)
             + [("e", 1, "lattice", 0, 0, 0, "alone"), ("e", 1, "lattice", 0, 1, 0, "cell")])
    df = spark.createDataFrame(cells, "doc_id string, page long, strategy string, table_no int, row_idx int, col_idx int, text string")
    first = {r.doc_id: (r.page, r.strategy, r.table_no, r.n_rows, r.n_cols, r.found) for r in IN.first_usable_table(df).collect()}
    assert first == {"d": (2, "stream", 0, 5, 4, True), "e": (0, None, -1, 0, 0, False)}
    got = sorted((r.row_no, r.col_idx, r.column_name, r.value) for r in IN.promote_header(df, first_only=True).collect())
    assert got == [(0, 0, "A", "1"), (0, 1, "B", "2"), (0, 2, "C", None), (0, 3, "col_3", "4"),
                   (2, 0, "A", "5"), (2, 1, "B", "6"), (2, 2, "C", "7"), (2, 3, "col_3", "8")]
    whole = IN.promote_header(df)
    assert whole.select("doc_id", "page", "strategy", "table_no").distinct().count() == 4  # the short table has no body
    alone = whole.where("doc_id = 'e'").collect()
    assert [(r.row_no, r.column_name, r.value) for r in alone] == [(0, "alone", "cell")]


def test_header_promotion_shuffles_four_times(spark):
    from ledgerlake.sources import fixtures as FX
    from ledgerlake.sources.tables import Tables
    cells = FX.cells(Tables(spark, "/root/testdata/sf0.001")).checkpoint()
    out = IN.promote_header(cells, first_only=True)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2 * 4 + 1  # the final plan and the initial one


def test_cells_are_dealt_out_once(spark):
    """Lines dealt by document serve the cells, the rows, the tables and the documents; other cells are dealt out once."""
    from ledgerlake.sources import fixtures as FX
    from ledgerlake.sources.tables import Tables
    cells = FX.cells(Tables(spark, "/root/testdata/sf0.001"))
    loose = spark.createDataFrame(cells.limit(200).collect(), cells.schema)
    for c in (cells, loose):
        for out in (IN.promote_header(c, first_only=True), IN.promote_header(c)):
            assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert IN.first_usable_table(cells)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_cells_without_a_row_or_column_index(spark):
    rows = [("d", 1, "lattice", 0, i, j, f"{i}{j}") for i in range(3) for j in range(3)]
    rows += [("d", 1, "lattice", 0, None, j, "x") for j in range(3)] + [("d", 1, "lattice", 0, i, None, "y") for i in range(1, 3)]
    df = spark.createDataFrame(rows, "doc_id string, page long, strategy string, table_no int, row_idx int, col_idx int, text string")
    first = IN.first_usable_table(df).first()
    assert (first.n_rows, first.n_cols, first.found) == (4, 4, True)
    got = sorted((r.row_no, r.col_idx if r.col_idx is not None else -1, r.column_name or "", r.value) for r in IN.promote_header(df, first_only=True).collect())
    assert [g for g in got if g[1] >= 0] == [(i - 1, j, f"0{j}", f"{i}{j}") for i in (1, 2) for j in range(3)]
