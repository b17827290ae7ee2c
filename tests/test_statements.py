from ledgerweave.operators import statements

LINE = "doc_id int, page_no int, line_no int, text string"


def lines(spark, *texts):
    return spark.createDataFrame([(d, 1, i, t) for d, text in enumerate(texts) for i, t in enumerate(text)], LINE)


GOOD = ["STATEMENT PAGE 1 OF 2", "Statement date 5 January 2024", "Balance brought forward 100.00", "28 Dec  ZARN BOOKS  30.00  70.00", "02 Jan  REFUND  1,005.50 CR", None, "Balance carried forward 1,075.50"]


def test_an_accepted_statement(spark):
    rows = statements.accepted_rows(lines(spark, GOOD)).orderBy("position").collect()
    assert [(str(r.value_date), r.description, r.amount_minor) for r in rows] == [("2023-12-28", "ZARN BOOKS", -3000), ("2024-01-02", "REFUND", 100550)]


def test_refusals_and_sections(spark):
    off = [t.replace("30.00  70.00", "31.00") if t else t for t in GOOD]
    bare = [t for t in GOOD if t and "carried" not in t]
    two = [*GOOD, *GOOD]
    got = {(r.doc_id, r.section): r.verdict for r in statements.statement_gate(lines(spark, off, bare, two)).collect()}
    assert got == {(0, 1): "does not close", (1, 1): "no balance", (2, 1): "accepted", (2, 2): "accepted"}
    assert statements.accepted_rows(lines(spark, off, bare)).count() == 0
    assert statements.statement_gate(lines(spark, GOOD).where("doc_id < 0")).count() == 0
