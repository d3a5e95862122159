"""Printed values, table roles, premises and answers: the cases that their rules are for."""

from pyspark.sql import functions as F

from factlake.operators.checks import answer_issues, check_premises, harden_values, infer_roles, polarity, structured_lines


def test_values_are_hardened_by_what_is_printed(spark):
    rows = [("a", "Note 12", 2020, 12.0, "12"), ("a", "Note 12", 2021, 500.0, "(500)"), ("a", "Note 12", 2022, 700.4, "(700)"), ("a", "Note 12", 2023, -9.0, "9"), ("b", "12", 1, 12.0, None), ("b", "12", 2, 100.0, "x"), ("c", None, 1, 12.0, "(15)"), ("d", "12", 1, 12.0, "12"), ("d", "12", 2, None, "(5)"), ("e", "5", 1, 5.0, "5"), ("e", "5", 2, 51.0, "51")]
    out = harden_values(spark.createDataFrame(rows, "line_id string, note_ref string, year int, value double, raw string")).collect()
    assert {(r.line_id, r.year): (r.hardened, r.sign_fixed, r.note_dropped) for r in out} == {
        ("a", 2020): (12.0, False, False),  # 9 on the line is smaller
        ("a", 2021): (-500.0, True, False), ("a", 2022): (-700.4, True, False), ("a", 2023): (-9.0, False, False), ("b", 1): (12.0, False, False), ("b", 2): (100.0, False, False),
        ("c", 1): (12.0, False, False), ("d", 1): (12.0, False, False), ("d", 2): (None, False, False), ("e", 1): (None, False, True), ("e", 2): (51.0, False, False),
    }


def test_roles_of_tables(spark):
    rows = [
        ("Six years at a glance", "balance_sheet", None, None, ["total_assets"], None, "analytical"), ("Analysis of Statement of Financial Position", "balance_sheet", None, None, [], None, "primary"), ("Page 7", "balance_sheet", None, None, ["total_assets"], None, "primary"),
        ("Page 8", "balance_sheet", "balance", None, ["inventory"], None, "note"), ("Assets", "non_current_assets", "balance", None, ["total_assets"], None, "primary"), ("Cost analysis", "cost_of_sales", "income", None, None, None, "analytical"), ("Trade debts", "current_assets", "balance", "percent", None, None, "analytical"), ("x", None, None, None, None, "primary", "primary"), (None, None, None, None, None, "", "note"),
    ]
    out = infer_roles(spark.createDataFrame(rows, "title string, statement string, family string, unit_scale string, metrics array<string>, table_role string, want string")).collect()
    assert [r.inferred_role for r in out] == [r.want for r in out]
    sides = spark.createDataFrame([("taxation", "Assets"), (None, "Share capital and reserves"), ("balance_sheet", "Non-current liabilities"), (None, "Other"), (None, None)], "s string, t string")
    assert [r.p for r in sides.select(polarity(F.col("s"), F.col("t")).alias("p")).collect()] == ["expense", "equity", "liability", None, None]


def test_premises(spark):
    rows = [("why did profit fall", 1.0, 2.0, True), ("why did profit fall", 2.0, 1.0, False), ("is it up or lower", 2.0, 1.0, False), ("growing faster?", 2.0, 1.0, True), ("what happened", 2.0, 1.0, False), ("why less", 1.0, 1.0, False), ("upper bound", 2.0, 1.0, False), (None, 1.0, 2.0, False), ("why less", None, 1.0, False)]
    out = check_premises(spark.createDataFrame(rows, "text string, before double, after double, want boolean")).collect()
    assert [r.contradicted for r in out] == [r.want for r in out] and out[2].asserted == "ambiguous" and out[6].asserted is None


def test_answers(spark):
    answers = spark.createDataFrame([(1, "fine", "high"), (2, " ", "certain"), (3, None, None)], "answer_id int, text string, band string")
    findings = spark.createDataFrame([(1, 0, "up [C1], so [C2] and [C2]"), (2, 0, "nothing"), (3, 0, None)], "answer_id int, place int, text string")
    out = answer_issues(answers, findings, spark.createDataFrame([(1, "C1"), (2, "C2")], "answer_id int, ref_id string"))
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, "dangling citation", "C2"), (2, "empty answer", None), (2, "invalid band", "certain"), (2, "uncited finding", "nothing"), (3, "empty answer", None), (3, "uncited finding", None)], key=str)


def test_raw_grids_become_structured_lines(spark):
    sheets = {"p": [["", "Note", "2023", "2022"], ["INCOME", "", "", ""], ["Revenues", "4", "(5,000)", "4,000"], ["Cost of sale", "12", "12", "3,500"], ["Inventory", "", "7", "8"], ["Unknown thing", "", "1", "2"]]}
    grid = [(s, r, c, t) for s, rows in sheets.items() for r, row in enumerate(rows) for c, t in enumerate(row)]
    known = [("revenue", "revenue", "pl"), ("cost of sales", "cost_of_sales", "pl"), ("inventory", "stock", "bs")]
    out = structured_lines(
        spark.createDataFrame(grid, "sheet string, row_no int, col_no int, cell string"), spark.createDataFrame([("p", "pl", [])], "sheet string, statement string, years array<int>"), spark.createDataFrame(known, "name string, metric string, family string"),
        spark.createDataFrame([("p", "Cost of sale", "12")], "sheet string, label string, note_ref string"),
    ).collect()
    assert {(r.label, r.year): (r.section, r.metric, r.resolution, r.value) for r in out} == {
        ("Revenues", 2023): ("INCOME", "revenue", "fuzzy", -5000.0), ("Revenues", 2022): ("INCOME", "revenue", "fuzzy", 4000.0), ("Cost of sale", 2023): ("INCOME", "cost_of_sales", "fuzzy", None), ("Cost of sale", 2022): ("INCOME", "cost_of_sales", "fuzzy", 3500.0),
        ("Inventory", 2023): ("INCOME", None, "no_confident_metric", 7.0), ("Inventory", 2022): ("INCOME", None, "no_confident_metric", 8.0), ("Unknown thing", 2023): ("INCOME", None, None, 1.0), ("Unknown thing", 2022): ("INCOME", None, None, 2.0),
    }
