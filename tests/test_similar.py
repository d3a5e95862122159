"""Similarity joins against all pairs, and the ladders against plain loops."""

import random

import pytest

from factlake.functions.similarity import ratio_of, token_set_of, token_sort_of
from factlake.operators import similar
from factlake.operators.similar import MODIFIERS, resolve_entities, resolve_labels, similar_pairs

OF = {"ratio": ratio_of, "token_sort": token_sort_of, "token_set": token_set_of}
WORDS = "revenue revenues receivables trade cost sales of net profit after tax total assets plant a b xy limited company (private) cement übertrag".split()


def bent(rng, text):
    out = list(text)
    for _ in range(rng.choice([0, 1, 1, 2, 3, 6])):
        at = rng.randrange(len(out) + 1)
        out[at : at + rng.choice([0, 1])] = rng.choice(["", "x", "e", " ", "s"])
    return "".join(out).strip()


def names(rng, n):
    return sorted({" ".join(rng.choices(WORDS, k=rng.choice([1, 1, 2, 3, 5]))) for _ in range(n)})


@pytest.mark.parametrize("kind, least, frequent", [("ratio", 90.0, 2_000), ("ratio", 60.0, 3), ("token_sort", 88.0, 2_000), ("token_set", 82.0, 2_000), ("token_set", 57.0, 5)])
def test_similar_pairs_match_all_pairs(spark, monkeypatch, kind, least, frequent):
    monkeypatch.setattr(similar, "FREQUENT", frequent)
    rng = random.Random(repr((kind, least)))
    known = names(rng, 130)
    asked = sorted({bent(rng, n) for n in known} | {"revenues", "recievables", "", "a", "ab", "é"})
    got = {(r.a, r.b): r.score for r in similar_pairs(spark.createDataFrame([(x,) for x in [*asked, *asked[:5]]] + [(None,)], "x string"), spark.createDataFrame([(x, 1) for x in known] + [(None, 2)], "y string, n int"), least, kind).collect()}
    want = {(a, b): s for a in asked for b in known if a and b and (s := OF[kind](a, b)) >= least}
    assert got == pytest.approx(want) and len(want) >= 50


def test_two_thousand_torn_names(spark):
    rng = random.Random(2)
    letters = "abcdefghijklmnopqrstuvwxyz"
    known = sorted({" ".join("".join(rng.choices(letters, k=rng.choice([3, 7, 9]))) for _ in range(rng.choice([1, 2]))) for _ in range(2_000)})
    asked = sorted({bent(rng, n) for n in known if len(n) > 4})
    got = {(r.a, r.b) for r in similar_pairs(spark.createDataFrame([(x,) for x in asked], "x string"), spark.createDataFrame([(x,) for x in known], "y string"), 90.0).collect()}
    by_length = {}
    for b in known:
        by_length.setdefault(len(b), []).append(b)
    want = {(a, b) for a in asked for m in range(int(len(a) * 0.8), int(len(a) * 1.25) + 2) for b in by_length.get(m, ()) if ratio_of(a, b) >= 90}
    assert got == want and len(want) > 900


def test_labels_need_no_shared_word_and_metrics_own_their_modifiers(spark):
    known = [("revenue", "revenue"), ("trade receivables", "receivables"), ("receivables", "receivables"), ("adjusted earnings before tax", "ebt"), ("earnings before tax", "ebt"), ("operating margin", "margin")]
    asked = [("Revenues",), ("recievables",), ("Adjusted earning before tax",), ("forward operating margin",), ("ntm operating-margin",), ("Operating  Margin",), ("nothing",), (None,), ("",)]
    out = resolve_labels(spark.createDataFrame(asked, "label string"), spark.createDataFrame(known, "name string, metric string"), 75.0)
    assert {r.label: (r.metric, r.method) for r in out.collect()} == {
        "Revenues": ("revenue", "fuzzy"), "recievables": ("receivables", "fuzzy"), "Adjusted earning before tax": ("ebt", "fuzzy"), "forward operating margin": (None, "unmapped"), "ntm operating-margin": (None, "unmapped"),
        "Operating  Margin": ("margin", "exact"), "nothing": (None, "unmapped"), None: (None, "unmapped"), "": (None, "unmapped"),
    }


def test_labels_match_a_plain_loop(spark):
    rng = random.Random(4)
    known = [(n, f"m{rng.randrange(40)}") for n in names(rng, 90)] + [("adjusted cost of sales", "m1"), ("forward plant total", "m50")]
    asked = sorted({bent(rng, n) for n, _ in known} | {f"{w} {n}" for n, _ in known[::5] for w in MODIFIERS[:2]})
    spaced = lambda s: " ".join("".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in s.lower()).split())
    mods = lambda s: set(spaced(s).split()) & set(MODIFIERS)
    want = {}
    for label in asked:
        key = spaced(label).replace(" ", "")
        exact = [m for n, m in known if key and spaced(n).replace(" ", "") == key]
        scored = sorted((-ratio_of(spaced(label), spaced(n)), spaced(n), m) for n, m in known if spaced(label) and spaced(n))
        if exact:
            want[label] = (min(exact), 100.0, "exact")
        elif scored and scored[0][0] <= -90 and mods(label) <= set().union(*(mods(n) for n, m in known if m == scored[0][2])):
            want[label] = (scored[0][2], -scored[0][0], "fuzzy")
        else:
            want[label] = (None, None, "unmapped")
    out = resolve_labels(spark.createDataFrame([(a,) for a in asked], "label string"), spark.createDataFrame(known, "name string, metric string"))
    assert {r.label: (r.metric, r.score and pytest.approx(r.score), r.method) for r in out.collect()} == want
    assert {m for _, _, m in want.values()} == {"exact", "fuzzy", "unmapped"}


ENTITIES = [("MTL", "Millat Tractors Limited"), ("LUCK", "Lucky Cement Limited"), ("LUCKT", "Lucky Textile Limited"), ("ACP", "Attock Cement Pakistan Limited"), ("FCC", "Fauji Cement Company Limited")]
ALIASES = [("MTL", "Millat Tractor"), ("ACP", "Attock Cement")]


def test_ladder_of_entities(spark):
    asked = ["mtl", " MTL ", "LUK", "LUCKX", "millat  tractors limited", "Attock cement", "Lucky", "Millat Tractors Ltd", "Atock Cemnt", "group of nothing", "Lucky Group", "", None]
    out = resolve_entities(spark.createDataFrame([(a,) for a in asked], "query string"), spark.createDataFrame(ENTITIES, "ticker string, name string"), spark.createDataFrame(ALIASES, "ticker string, alias string"), ("lucky  group",))
    got = {r.query: (r.ticker, r.state, r.method) for r in out.collect()}
    assert got == {
        "mtl": ("MTL", "RESOLVED", "exact_ticker"), " MTL ": ("MTL", "RESOLVED", "exact_ticker"), "LUK": (None, "QUARANTINED", "ticker_shaped_unknown"), "LUCKX": (None, "QUARANTINED", "ticker_shaped_unknown"),
        "millat  tractors limited": ("MTL", "RESOLVED", "exact_legal_name"), "Attock cement": ("ACP", "RESOLVED", "alias"), "Lucky": ("LUCK", "REVIEW", "fuzzy_ambiguous"), "Millat Tractors Ltd": ("MTL", "RESOLVED", "fuzzy"),
        "Atock Cemnt": ("ACP", "RESOLVED", "fuzzy"), "group of nothing": (None, "QUARANTINED", "below_floor"), "Lucky Group": (None, "QUARANTINED", "quarantine_term"), "": (None, "QUARANTINED", "empty"), None: (None, "QUARANTINED", "empty"),
    }


def test_fuzzy_rung_matches_a_plain_loop(spark):
    rng = random.Random(8)
    entities = [(f"T{i}", f"{rng.choice(WORDS)} {rng.choice(WORDS)} works {i % 7} limited") for i in range(45)]
    aliases = [(t, n.replace("limited", "ltd")) for t, n in entities[::4]]
    asked = sorted({bent(rng, n) for _, n in entities} | {n.split()[0] + " worx" for _, n in entities} | {"zzz yyy xxx"})
    pool = sorted({(n.lower(), t) for t, n in entities + aliases})
    exact = {" ".join(n.lower().split()) for n, _ in pool}
    want = {}
    for q in asked:
        if " ".join(q.lower().split()) in exact:
            continue
        near = sorted((-token_set_of(q.lower(), n) / 100, n, t) for n, t in pool)[:5]
        score, ticker = -near[0][0], near[0][2]
        rival = next((t for s, _, t in near if t != ticker and score + s <= 0.05 + 1e-12), None)
        if score < 0.62:
            want[q] = (None, "QUARANTINED", [])
        elif rival:
            want[q] = (ticker, "REVIEW", [ticker, rival])
        else:
            want[q] = (ticker if score >= 0.7 else None, "RESOLVED" if score >= 0.88 else "REVIEW" if score >= 0.7 else "QUARANTINED", [ticker])
    out = resolve_entities(spark.createDataFrame([(a,) for a in asked], "query string"), spark.createDataFrame(entities, "ticker string, name string"), spark.createDataFrame(aliases, "ticker string, alias string"))
    assert {r.query: (r.ticker, r.state, list(r.candidates)) for r in out.collect() if r.query in want} == want
    assert len({s for _, s, _ in want.values()}) == 3


@pytest.mark.parametrize("cells", [(8_192, 65_536, 256, 64), (40, 30, 10, 2)])
def test_nearest_names_match_all_pairs(spark, monkeypatch, cells):
    for name, value in zip(("CELL_STRINGS", "CELL_NAMES", "LEAST_STRINGS", "RARE"), cells, strict=True):
        monkeypatch.setattr(similar, name, value)
    rng = random.Random(11)
    known = sorted({f"nation {rng.randrange(6)} {rng.randrange(60):09d} works limited" for _ in range(90)} | {f"works s{i}" for i in range(60)} | set(names(rng, 40)) | {"a" * 40, "aa " * 30 + "b"})
    asked = sorted({bent(rng, n) for n in known} | {f"customer#{i:09d}" for i in range(40)} | {n.replace("limited", "ltd") for n in known} | {" ", "a" * 33, "übertrag" * 9})
    got = {}
    for r in similar.nearest_names(spark.createDataFrame([(x,) for x in [*asked, "", None]], "x string"), spark.createDataFrame([(x,) for x in [*known, *known[:9], None]], "y string"), 57.0, 5.0).collect():
        got.setdefault(r.a, []).append((-r.score, r.b))
    want = {}
    for a in asked:
        near = sorted((-s, b) for b in known if (s := token_set_of(a, b)) >= 57.0)[:5]
        if near:
            want[a] = [(s, b) for s, b in near if s <= near[0][0] + 5.0]
    assert {a: sorted(found) for a, found in got.items()} == want and len(want) > 150


def test_names_that_differ_in_digits_are_not_compared_one_by_one(monkeypatch):
    rng = random.Random(5)
    known = {f"nation {rng.randrange(4)} {rng.randrange(3_000):09d} works limited" for _ in range(500)} | {f"works s{i}" for i in range(1_000, 1_500)}
    odd = {"é" * 70, " ".join(f"w{i}" for i in range(40)), "x\U0001f600y works", "works", "a" * 30 + " nation", " ", " nation 1"}
    known, asked = sorted(known | odd), sorted(odd | {f"zs{i}" for i in range(1_000, 1_500, 11)} | {f"customer#{i:09d}" for i in range(30)} | {bent(rng, n.replace("limited", "ltd")) for n in sorted(known)[::12]} | {f"w{i} w{i + 1}" for i in range(3)})
    plainly = []
    monkeypatch.setattr(similar.S, "token_set_of", lambda a, b: plainly.append((a, b)) or token_set_of(a, b))
    got = {}
    for a, b, s in zip(*similar._nearest(list(asked), list(known), 57.0, 5.0, 5), strict=True):
        got.setdefault(a, []).append((-s, b))
    want = {}
    for a in asked:
        near = sorted((-s, b) for b in known if (s := token_set_of(a, b)) >= 57.0)[:5]
        if near:
            want[a] = [(s, b) for s, b in near if s <= near[0][0] + 5.0]
    assert {a: sorted(found) for a, found in got.items()} == want and len(want) > 100
    assert all(max(len(a), len(b)) > 60 for a, b in plainly)
