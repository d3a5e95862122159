"""Assignment against the plain greedy loop, and template matching against its rules one by one."""

import random

import pytest

from factlake.functions.similarity import token_set_of
from factlake.operators import assignment, matching
from factlake.operators.assignment import assign, match_template
from factlake.sources.bridge import facts


def greedy(pairs):
    rows, items, out = set(), set(), []
    for away, overlap, score, r, i in sorted((a, -o, -s, r, i) for r, i, a, o, s in pairs if r is not None and i is not None):
        if r not in rows and i not in items:
            rows.add(r)
            items.add(i)
            out.append((r, i, away, -overlap, -score))
    return sorted(out)


def test_assignment_matches_the_sorted_loop(spark):
    rng = random.Random(7)
    for n, spread in ((400, 40), (300, 8), (60, 60)):
        pairs = list({(r, i): (r, i, rng.random() < 0.5, rng.randrange(3), float(rng.randrange(80, 90))) for _ in range(n) for r in [rng.randrange(spread)] for i in [rng.randrange(spread)]}.values())
        pairs += [(None, 1, False, 9, 99.0), (1, None, False, 9, 99.0)]
        frame = spark.createDataFrame(pairs, "row_id long, item_id long, away boolean, overlap int, score double")
        got = sorted(tuple(r) for r in assign(frame, ["away", "-overlap", "-score"]).select("row_id", "item_id", "away", "overlap", "score").collect())
        assert got == greedy(pairs) and len(got) > 5


def test_assignment_of_a_chain_needs_many_rounds(spark):
    # each pair is blocked by the one before it, so every round settles only one
    pairs = [(k // 2, (k + 1) // 2, False, 0, 100.0 - k) for k in range(12)]
    frame = spark.createDataFrame(pairs, "row_id long, item_id long, away boolean, overlap int, score double")
    assert sorted(tuple(r) for r in assign(frame, ["-score"]).collect()) == greedy(pairs)
    assert assign(frame.limit(0), ["-score"]).collect() == []


STATEMENTS = [("pl", "income", "pl"), ("pl cost", "income", "pl"), ("bs", "balance", "bs"), ("bs share", "balance", "bs")]
ROW = "row_id string, statement string, label string, section string, metric string, polarity string, strict boolean"
ITEM = "entity string, item_id string, statement string, label string, section string, metric string, role string, polarity string"


def match(spark, rows, items, face=None):
    f = face and spark.createDataFrame(face, "entity string, metric string, value double")
    out = match_template(spark.createDataFrame(rows, ROW), spark.createDataFrame(items, ITEM), spark.createDataFrame(STATEMENTS, "statement string, family string, face string"), f)
    return {(r.entity, r.row_id): (r.item_id, r.method, r.value) for r in out.collect()}


def test_guards_and_tiers_of_the_template(spark):
    rows = [
        ("cost", "pl cost", "Cost of sales", "Local sales", None, None, False), ("raw", "pl cost", "Raw material consumed", "Manufacturing", None, None, False), ("sum", "pl", "Total cost of sales", None, None, None, False),
        ("shares", "bs share", "Issued share capital", None, None, "equity", True), ("tax", "pl", "Taxation", None, "tax", None, False), ("cash", "bs", "Cash and bank", None, "cash", "asset", False), ("plant", "bs", "Plant (Pvt) Ltd", None, None, None, False),
    ]
    items = [
        ("m", "i1", "pl cost", "Cost of sales", "Export sales", None, None, None), ("m", "i2", "pl cost", "Cost of sales - net", "Local sales", None, None, None), ("m", "i3", "pl", "Raw materials consumed", "Manufacturing", None, None, None),
        ("m", "i4", "pl", "Total cost of sales", None, None, "total", None), ("m", "i5", "bs share", "Issued share capital", None, None, None, None), ("m", "i6", "bs", "Cash and bank", None, "share_capital", None, "asset"),
        ("m", "i7", "bs", "Cash and banks", None, None, None, "liability"), ("m", "i8", "bs", "Plant (Private) Limited", None, None, None, None), ("m", "i9", "bs share", "Cost of sales", None, None, None, None),
        ("n", "j1", "bs share", "Issued share capital", None, None, None, "equity"), ("n", "j2", "bs", "Total issued share capital", None, None, None, "equity"),
    ]
    got = match(spark, rows, items, [("m", "tax", 12.0), ("m", "cash", 3.0), ("m", "cost", 9.0)])
    assert {k[1]: v for k, v in got.items() if k[0] == "m"} == {
        "cost": ("i2", "own", None),  # sections meet: local with local
        "raw": ("i3", "widened", None),  # found at the face of the same family
        "sum": ("i4", "own", None),
        "shares": (None, "unmatched", None),  # strict: the line's side is not known
        "tax": (None, "face", 12.0),
        "cash": (None, "face", 3.0),  # another metric, and another side
        "plant": ("i8", "own", None),
    }
    assert got["n", "shares"] == ("j1", "own", None) and got["n", "tax"] == (None, "unmatched", None)


def test_template_matches_a_plain_loop(spark):
    rng = random.Random(9)
    words = "cost sales revenue other income trade debts long term loans finance tax".split()
    label = lambda: " ".join(rng.sample(words, rng.choice([1, 2, 3])))
    rows = [(f"r{k}", rng.choice(["pl", "pl cost", "bs"]), label(), rng.choice(["Local part", "Export part", None]), None, None, False) for k in range(25)]
    items = [(e, f"{e}{k}", rng.choice(["pl", "pl cost", "bs", "bs share"]), label(), rng.choice(["Local", "Export", "Nothing"]), None, "leaf", None) for e in ("a", "b") for k in range(40)]
    got = match(spark, rows, items)
    family, face = ({s: x[n] for s, *x in STATEMENTS} for n in (0, 1))
    for e in ("a", "b"):
        pairs = []
        for r in rows:
            near = [(i, s) for i in items if i[0] == e and family[i[2]] == family[r[1]] and (s := token_set_of(r[2], i[3])) >= 82 and face[i[2]] == face[r[1]]]
            own = [x for x in near if x[0][2] == r[1]]
            pairs += [(r[0], i[1], i[2] != r[1], int(bool({(r[3] or "").split(" ")[0].lower()} & {i[4].lower()})), s) for i, s in (own or near)]
        assert sorted((r, v[0]) for (en, r), v in got.items() if en == e and v[0]) == sorted(p[:2] for p in greedy(pairs))


def counted(spark, frame):
    """The frame, and how many of its rows have been computed so far, repeats included."""
    rows = spark.sparkContext.accumulator(0)

    def passed(batches):
        for batch in batches:
            rows.add(batch.num_rows)
            yield batch

    return frame.mapInArrow(passed, frame.schema), rows


def test_template_computes_its_rows_and_items_once(spark):
    rows, n_rows = counted(spark, spark.createDataFrame([("r1", "pl", "Sales revenue", None, None, None, False), ("r2", "bs", "Long term loans", None, "loans", None, False)], ROW))
    items, n_items = counted(spark, spark.createDataFrame([(e, f"{e}1", "pl", "Sales revenues", None, None, None, None) for e in "abc"], ITEM))
    statements = spark.createDataFrame(STATEMENTS, "statement string, family string, face string")
    out = match_template(rows, items, statements, spark.createDataFrame([("b", "loans", 4.0)], "entity string, metric string, value double"))
    got = {(r.entity, r.row_id): (r.item_id, r.method, r.value) for r in out.collect()}
    assert got == {(e, k): (f"{e}1", "own", None) if k == "r1" else (None, "face", 4.0) if e == "b" else (None, "unmatched", None) for e in "abc" for k in ("r1", "r2")}
    assert (n_rows.value, n_items.value) == (2, 3)


def test_template_of_which_no_row_fits_is_whole(spark):
    got = match(spark, [("r1", "pl", "Sales revenue", None, None, None, False)], [("a", "a1", "pl", "Long term loans", None, None, None, None)])
    assert got == {("a", "r1"): (None, "unmatched", None)}


@pytest.mark.parametrize("module, query", [(assignment, assignment.template_matching), (matching, matching.template_lines_query)])
def test_template_queries_compute_the_facts_once(spark, sf_dir, monkeypatch, module, query):
    expected, plain = facts(spark, sf_dir).count(), sorted(map(str, query(spark, sf_dir).collect()))
    found, n = counted(spark, facts(spark, sf_dir))
    monkeypatch.setattr(module, "facts", lambda *_: found)
    assert sorted(map(str, query(spark, sf_dir).collect())) == plain and plain
    assert n.value == expected
