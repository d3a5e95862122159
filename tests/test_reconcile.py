"""Repairs, subtotals, the numeric guard and retrieval against plain loops and the cases they are for."""

import ast
import itertools
import random
from pathlib import Path

import numpy as np
import pytest

from factlake.operators import reconcile, retrieval
from factlake.operators.guard import allowed_values, guard_numbers, within
from factlake.operators.reconcile import EXPENSES, IDENTITIES, reconcile_identities, tie_subtotals
from factlake.operators.retrieval import fold_insights, fold_stories, retrieve

TRUTH = "entity string, year int, metric string, value double, source string"
OFFERS = "entity string, year int, table_id string, basis string, metric string, value double, source string, place int"


def plain_repair(truth, offers, basis):
    """The identities one after the other over dictionaries, every table and combination tried."""
    now = {m: v for m, v in truth.items()}
    near = lambda s, t: abs(s - t) <= max(1, 0.01 * abs(t))
    alts = lambda t: t if isinstance(t, tuple) else (t,)
    sign = lambda m, v: -abs(v) if m in EXPENSES else v
    for target, terms in IDENTITIES:
        values = [next((now[m] for m in alts(t) if m in now), None) for t in (target, *terms)]
        if None in values or near(sum(values[1:]), values[0]):
            continue
        options = []
        for table in sorted({o[0] for o in offers}):
            of = lambda t: [(m, sign(m, v)) for m in alts(t) for tb, _, mm, v, _ in sorted(offers, key=lambda o: o[4]) if tb == table and mm == m]  # noqa: E731, B023
            first = next((c for c in itertools.product(of(target), *map(of, terms)) if near(sum(v for _, v in c[1:]), c[0][1])), None)
            if first:
                away = next(o[1] for o in offers if o[0] == table) != basis
                options.append((sum(now.get(m) != v for m, v in first), away, table, first))
        if options:
            now.update(dict(min(options, key=lambda o: o[:3])[3]))
    return now


def test_repairs_match_plain_loops(spark):
    rng = random.Random(3)
    names = sorted({m for t, ts in IDENTITIES for x in (t, *ts) for m in (x if isinstance(x, tuple) else (x,))})
    truths, offers, want = [], [], {}
    for e in range(40):
        own, own_offers = {}, []
        for table in ("t1", "t2", "t3"):
            v = {m: float(rng.randrange(100, 900)) for m in names}
            v["total_assets"] = v["non_current_assets"] + v["current_assets"]
            v["total_equity_and_liabilities"] = v["total_assets"] + rng.choice([0, 0, 500])
            v["gross_profit"] = v["revenue"] - v["cost_of_sales"]
            v["profit_after_tax"] = v["profit_before_tax"] - v["tax_expense"]
            v["cash_at_end_of_period"] = sum(v[m] for m in IDENTITIES[1][1])
            place = 0
            for m in names:
                if rng.random() < 0.9 and m not in ("taxation", "income_tax"):
                    if rng.random() < 0.15:
                        own_offers.append((table, "consolidated" if table == "t1" else "unconsolidated", m, 7.0, place))
                    own_offers.append((table, "consolidated" if table == "t1" else "unconsolidated", m, v[m], place + 1))
                    place += 2
                    if m not in own or rng.random() < 0.4:
                        own[m] = -abs(v[m]) if m in EXPENSES else v[m]
        truths += [(f"e{e}", 2020, m, v, "s") for m, v in own.items()]
        offers += [(f"e{e}", 2020, t, b, m, v, "p", k) for t, b, m, v, k in own_offers]
        want[f"e{e}"] = plain_repair(own, own_offers, "unconsolidated")
    out = reconcile_identities(spark.createDataFrame([*truths, ("e0", 2020, "eps", 3.5, "s")], TRUTH), spark.createDataFrame(offers, OFFERS)).collect()
    got = {}
    for r in out:
        got.setdefault(r.entity, {})[r.metric] = r.value
    assert got.pop("e0") == want.pop("e0") | {"eps": 3.5}
    assert got == want
    assert {r.changed_by for r in out} >= {"gross_profit", "total_assets", "total_equity_and_liabilities", None}
    assert all((r.changed_by is None) == (r.old == r.value) or r.changed_by is not None for r in out)


def test_names_of_a_module_are_defined_once():
    for path in Path(reconcile.__file__).parent.parent.rglob("*.py"):
        found = [n.name for n in ast.parse(path.read_text()).body if isinstance(n, (ast.FunctionDef, ast.ClassDef))]
        assert len(found) == len(set(found)), path


def test_the_wanted_basis_decides_between_equal_repairs(spark):
    truth = [("e", 1, "gross_profit", 90.0, "s"), ("e", 1, "revenue", 200.0, "s"), ("e", 1, "cost_of_sales", -150.0, "s")]
    offers = [("e", 1, t, b, m, v, t, k) for t, b, g in (("t1", "x", 50.0), ("t2", "y", 50.5)) for k, (m, v) in enumerate((("gross_profit", g), ("revenue", 200.0), ("cost_of_sales", 150.0)))]
    for basis, table, value in (("x", "t1", 50.0), ("y", "t2", 50.5), ("z", "t1", 50.0)):
        out = {r.metric: tuple(r)[3:] for r in reconcile_identities(spark.createDataFrame(truth, TRUTH), spark.createDataFrame(offers, OFFERS), basis).collect()}
        assert out == {"gross_profit": (value, table, 90.0, "gross_profit", table), "revenue": (200.0, "s", 200.0, None, None), "cost_of_sales": (-150.0, "s", -150.0, None, None)}


def test_many_combinations_are_not_searched_one_by_one(spark):
    truth = [("e", 1, "total_assets", 5.0, None), ("e", 1, "non_current_assets", 900.0, None), ("e", 1, "current_assets", 100.0, None)]
    offers = [("e", 1, "t", "x", "total_assets", 1_000.0, None, k) for k in range(3)] + [("e", 1, "t", "x", "non_current_assets", 900.0, str(k), k) for k in range(20)] + [("e", 1, "t", "x", "current_assets", float(k), None, k) for k in range(101)]
    out = {r.metric: (r.value, r.changed_by) for r in reconcile_identities(spark.createDataFrame(truth, TRUTH), spark.createDataFrame(offers, OFFERS)).collect()}
    assert out == {"total_assets": (1_000.0, "total_assets"), "non_current_assets": (900.0, None), "current_assets": (90.0, "total_assets")}  # the first within 1 %
    assert reconcile_identities(spark.createDataFrame([], TRUTH), spark.createDataFrame([], OFFERS)).collect() == []


LINES = "sheet string, ord int, label string, role string, is_contra boolean, components array<string>, year int, value double"


def ties(spark, rows):
    return {(r.sheet, r.label, r.year): (r.method, r.computed, r.state) for r in tie_subtotals(spark.createDataFrame(rows, LINES)).collect()}


def test_subtotals_of_a_sheet(spark):
    def line(ord_, label, values, role=None, contra=False, components=None, sheet="a"):
        return [(sheet, ord_, label, role, contra, components, y, v) for y, v in values.items()] or [(sheet, ord_, label, role, contra, components, None, None)]

    rows = [
        *line(1, "SALES", {}), *line(2, "Local", {2020: 60.0, 2021: 70.0}), *line(3, "Export", {2020: 40.0, 2021: 30.0}), *line(4, "Sales tax", {2020: 10.0, 2021: None}, contra=True), *line(5, "Net sales", {2020: 90.0, 2021: 100.0}),
        *line(6, "COSTS", {}), *line(7, "Material", {2020: -30.0}), *line(8, "Labour", {2020: -20.0}), *line(9, "Total costs", {2020: -50.0, 2021: -50.0}),
        *line(10, "Gross profit", {2020: 40.0, 2021: 50.0}),  # the two subtotals
        *line(11, "Other income", {2020: 5.0}), *line(12, "Profit before tax", {2020: 45.0}),  # what is open, and a leaf
        *line(13, "Export share", {2020: 1.0}), *line(14, "Total exports", {2020: 41.0}, components=["Export", "Export share"]),
        *line(15, "Total of what is not there", {2020: 41.0}, components=["Export", "Nowhere"]), *line(16, "Total of one", {2020: 40.0}, components=["Export", "export"]),
        *line(17, "one", {2020: 1.0}), *line(18, "two", {2020: 2.0}), *line(19, "Total wrong", {2020: 3.1}), *line(20, "three", {2020: 3.0}), *line(21, "HEADER", {}), *line(22, "four", {2020: 4.0}), *line(23, "Total after a header", {2020: 4.0}),
        ("a", 24, None, None, False, None, 2020, 1.0), (None, 25, "x", None, False, None, 2020, 1.0),
        *line(1, "first", {2020: 1.0}, sheet="b"), *line(2, "second", {2020: 2.0}, sheet="b"), *line(3, "All together", {2020: 3.0}, role="Total", sheet="b"), *line(4, "total but a leaf", {2020: 9.0}, role="leaf", sheet="b"),
    ]
    random.Random(1).shuffle(rows)
    got = ties(spark, rows)
    assert got["a", "Net sales", 2020] == ("leaf_block", 90.0, "tied") and got["a", "Net sales", 2021] == ("leaf_block", 100.0, "tied")
    assert got["a", "Total costs", 2020] == ("leaf_block", -50.0, "tied") and got["a", "Total costs", 2021] == ("leaf_block", None, "too_few")
    assert got["a", "Gross profit", 2020] == ("running", 40.0, "tied") and got["a", "Gross profit", 2021] == ("running", 50.0, "tied")
    assert got["a", "Profit before tax", 2020] == ("running", 45.0, "tied")
    assert got["a", "Total exports", 2020] == ("components", 41.0, "tied")
    assert got["a", "Total of what is not there", 2020][0] == "running" and got["a", "Total of one", 2020][0] == "running"
    assert got["a", "Total wrong", 2020] == ("leaf_block", 3.0, "mismatch")
    assert got["b", "All together", 2020] == ("leaf_block", 3.0, "tied") and ("b", "total but a leaf", 2020) not in got
    assert ("a", None, 2020) not in got and ties(spark, []) == {}


def test_subtotals_match_lists(spark):
    """The fold with lists of rows instead of running sums, over random sheets."""
    rng = random.Random(14)
    rows, want = [], {}
    for sheet in map(str, range(25)):
        leaves, totals = [], []
        for at in range(40):
            kind = rng.choice(["leaf"] * 5 + ["section_header", "total", "subtotal"])
            values = {y: float(rng.randrange(1, 9)) for y in (2020, 2021) if rng.random() < 0.8}
            contra = rng.random() < 0.1
            if kind in ("total", "subtotal"):
                block = leaves if len(leaves) >= 2 else totals + leaves
                if rng.random() < 0.7:
                    values = {y: float(sum(s * v[y] for s, v in block if y in v)) for y in (2020, 2021)}
            rows += [(sheet, at, f"row {at}", kind, contra, None, y, v) for y, v in values.items()] or [(sheet, at, f"row {at}", kind, contra, None, None, None)]
            me = (-1 if contra else 1, values)
            if kind == "section_header":
                leaves = []
            elif kind == "leaf":
                leaves += [me] if values else []
            else:
                tied = False
                for y, v in values.items():
                    some = [s * x[y] for s, x in block if y in x]
                    if len(block) >= 2 and len(some) >= 2:
                        ok = abs(sum(some) - v) <= 1e-6 + 1e-3 * abs(v)
                        tied |= ok
                        want[sheet, f"row {at}", y] = ok
                if len(leaves) >= 2:
                    totals = [*totals, me]
                elif tied:
                    totals = [me]
                leaves = []
    got = {k: s == "tied" for k, (_, _, s) in ties(spark, rows).items() if s in ("tied", "mismatch")}
    assert got == want and {True, False} == set(want.values())


def test_buckets_lose_no_near_value(spark):
    rng = random.Random(6)
    a = [(i % 3, rng.choice([-1, 1]) * 10 ** rng.uniform(-4, 9)) for i in range(400)] + [(0, 0.0), (0, 0.999), (0, 1.0), (0, -0.005), (0, None)]
    b = [(g, v * (1 + rng.uniform(-0.02, 0.02))) for g, v in a if v is not None] + [(0, 0.005), (0, 1.0099), (0, 0.99)]
    got = {tuple(r) for r in within(spark.createDataFrame(a, "g int, v double"), "v", spark.createDataFrame(b, "g int, w double"), "w", ["g"]).collect()}
    assert got == {(g, v) for g, v in a if v is not None and any(h == g and abs(v - w) <= 0.01 * max(abs(w), 1) for h, w in b)} and 100 < len(got) < 400


def test_allowed_values_and_the_guard(spark):
    values = [(1, 52_108_997.0), (1, -38_241_906.0), (1, None), (2, 10.0), *((3, float(1_000 + 7 * k)) for k in range(70))]
    quotes = [(1, "external", "up 7.25% since 1987"), (2, "question", "is 33 fair in 2020"), (2, "insight", "margin of 20.01%")]
    allowed = {}
    for r in allowed_values(spark.createDataFrame(values, "answer_id int, value double"), spark.createDataFrame(quotes, "answer_id int, kind string, text string")).collect():
        allowed.setdefault(r.answer_id, set()).add(r.value)
    a, b = 52_108_997.0, -38_241_906.0
    want = {x for v in (a, b, b - a, a + b) for s in (1, 1e3, 1e6) for x in (round(v / s, 6), round(abs(v) / s, 6))} | {round(f(a / b), 6) for f in (lambda r: r, abs)} | {round(f(b / a), 6) for f in (lambda r: r, abs)} | {0.0725, 1987.0}
    assert sorted(allowed[1]) == pytest.approx(sorted(want))
    assert 33.0 in allowed[2] and 2020.0 not in allowed[2] and 0.2001 in allowed[2]
    assert not any(v < 1 for v in allowed[3] if v != 0 and v > 0.1) and 14.0 not in allowed[3]  # over 64 values: no pairs
    answers = [(1, "Sales of 52.1 million less 38,241,906 give 13,867,091 [C3], a ratio of 0.734 in 2025 on page 12; 3 of 99"), (2, "10 or 11 and 33"), (4, "no number"), (5, "7")]
    out = guard_numbers(spark.createDataFrame(answers, "answer_id int, text string"), spark.createDataFrame(values, "answer_id int, value double"), spark.createDataFrame([(1, 12), (1, None)], "answer_id int, n int"), spark.createDataFrame(quotes, "answer_id int, kind string, text string"))
    got = {(r.answer_id, r.token): r.backed for r in out.collect()}
    assert {t for (i, t), ok in got.items() if i == 1 and not ok} == {"3", "99"} and {t for (i, t), ok in got.items() if i == 1 and ok} == {"52.1", "38,241,906", "13,867,091", "0.734", "2025", "12"}
    assert got[2, "10"] and not got[2, "11"] and got[2, "33"] and not got[5, "7"] and not any(i == 4 for i, _ in got)


def test_retrieval_in_blocks_matches_all_scores(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK_BYTES", 400)
    rng = np.random.default_rng(5)
    rows = [(i, [0, 1, None][i % 3], float(rng.integers(0, 60)) if i % 7 else None, rng.normal(size=6).round(2).tolist()) for i in range(200)]
    rows += [(500, 0, 1.0, None), (501, 0, 1.0, [0.0] * 6), (502, 0, 1.0, [float("nan")] * 6), (503, 0, 1.0, [1.0] * 5), (None, 0, 1.0, [1.0] * 6), (504, 0, 3.0, rows[0][3]), (505, 0, 3.0, rows[0][3])]
    asked = [r for r in rows if r[0] is not None and r[0] % 20 == 0]
    schema = "label int, day double, vector array<double>"
    got = {(r.query_id, r.place): (r.article_id, r.score) for r in retrieve(spark.createDataFrame(asked, f"query_id long, {schema}"), spark.createDataFrame(rows, f"article_id long, {schema}").repartition(5), k=4).collect()}
    want, ok = {}, [r for r in rows if r[0] is not None and r[3] and len(r[3]) == 6 and np.isfinite(r[3]).all() and any(r[3])]
    for q, label, day, v in asked:
        if not any(q == r[0] for r in ok):
            continue
        scored = []
        for a, other, when, w in ok:
            cosine = round(float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w)), 6)
            recent = 0.5 if day is None or when is None else 0.5 ** (max(0, day - when) / 14)
            if other == label and a != q and cosine >= 0.2:
                scored.append((-round(0.8 * cosine + 0.2 * recent, 6), a))
        want |= {(q, n + 1): (a, pytest.approx(-s, abs=2e-6)) for n, (s, a) in enumerate(sorted(scored)[:4])}
    assert got == want and len(got) > 20


def test_stories_and_insights_fold_greedily(spark):
    base = np.eye(4)
    item = lambda g, i, rank, outlet, v: (g, i, float(rank), outlet, [float(x) for x in v])
    found = [item(1, 10, 1, "a", base[0]), item(1, 11, 2, "b", base[0] + 0.1 * base[1]), item(1, 12, 3, "a", base[1]), item(1, 13, 4, None, base[1] + 0.05), item(1, 14, 5, "c", base[2]), item(2, 20, 1, "z", base[3])]
    out = {(r.group, r.item): (r.story, r.outlets, r.independent_stories, r.corroboration) for r in fold_stories(spark.createDataFrame(found, "group long, item long, rank double, outlet string, vector array<double>"), top=2).collect()}
    assert out == {(1, 10): (10, ["a", "b"], 2, 0.5), (1, 11): (10, ["a", "b"], 2, 0.5), (1, 12): (12, ["a"], 2, 0.5), (1, 13): (12, ["a"], 2, 0.5), (1, 14): (None, None, 2, 0.5), (2, 20): (20, ["z"], 1, 0.0)}
    rng = np.random.default_rng(9)
    rows = [(f"e{i % 2}", i, float(rng.integers(5, 10)) / 10, (base[i % 4] + rng.normal(size=4) * 0.28).tolist()) for i in range(80)] + [("e0", 900, 0.9, [0.0] * 4)]
    kept, want = {"e0": [], "e1": []}, {}
    for e, i, _, v in sorted(rows, key=lambda r: (-r[2], r[1])):
        cos = lambda w: np.dot(v, w) / (np.linalg.norm(v) * np.linalg.norm(w)) if np.any(v) and np.any(w) else 0.0  # noqa: E731, B023
        like = next((k for k, w in kept[e] if cos(w) >= 0.9), None)
        want[i] = i if like is None else like
        if like is None:
            kept[e].append((i, v))
    got = {r.insight_id: r.kept_as for r in fold_insights(spark.createDataFrame(rows, "entity string, insight_id long, confidence double, vector array<double>")).collect()}
    assert got == want and 5 < len(set(want.values())) < 75




def test_totals_at_one_place_keep_their_own_labels(spark):
    rows = [("a", 1, "one", None, False, None, 2020, 1.0), ("a", 2, "two", None, False, None, 2020, 2.0), ("a", 3, "Total x", None, False, None, 2020, 3.0), ("a", 3, "Total y", None, False, None, 2020, 3.0)]
    rows += [("b", None, "one", None, False, None, 2020, 1.0), ("b", 0, "two", None, True, None, 2020, 2.0), ("b", 1, "Total", None, False, None, 2020, -1.0), ("b", None, "Total of no place", None, False, None, 2020, 5.0)]
    for components in (None, ["nowhere"]):
        more = [("c", 1, "Total c", None, False, components, 2020, 1.0)]
        got = [(r.sheet, r.ord, r.label) for r in tie_subtotals(spark.createDataFrame(rows + more, LINES)).collect()]
        assert sorted(got) == [("a", 3, "Total x"), ("a", 3, "Total y"), ("b", 1, "Total"), ("c", 1, "Total c")]
