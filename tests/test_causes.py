"""A bicycle workshop: repairs take long when frames come from one maker, and when a quote is written by hand."""

import itertools
import math
import random
import statistics
from datetime import datetime, timedelta, timezone
from fractions import Fraction

import pytest
from tests.conftest import event, obj

from tracewright.operators.filters import apply
from tracewright.operators.rca import analysis as A
from tracewright.operators.rca import cohort as C
from tracewright.operators.rca import statistics as ST

MAKERS = {"Brandt": 0.25, "Ostara": 0.25, "Velm": 0.25, "Kite": 0.25}
STAY = {"id": "stay", "object_type": "Repair", "measure": "duration", "target": {"op": "<=", "value": 8},
        "duration": {"from": {"activity": "Bring In"}, "to": {"activity": "Hand Back"}, "stat": "median"}}
LONG = {"id": "long", "object_type": "Repair", "measure": "share", "target": {"op": "<=", "value": 10},
        "condition": {"op": "duration", "from": {"activity": "Bring In"}, "to": {"activity": "Hand Back"}, "cmp": "gt", "days": 8}}


def at(days):
    return (datetime(2025, 3, 3, 8, tzinfo=timezone.utc) + timedelta(days=days)).strftime("%Y-%m-%dT%H:%M:%SZ")


def workshop(make_log, n=360, seed=19, causes=True):
    rng = random.Random(seed)
    objects, events = [obj(f"M{i}", "Maker", title=m) for i, m in enumerate(MAKERS)], []
    for i in range(n):
        maker, wet, hand = rng.randrange(4), rng.random() < 0.5, rng.random() < 0.2
        objects.append(obj(f"R{i}", "Repair", colour=rng.choice(["red", "blue", "grey"]), weather="wet" if wet else "dry", price=str(rng.randint(20, 900))))
        day = rng.randint(0, 250)
        stay = rng.uniform(2, 6) + (causes and (8 if maker == 2 else 0) + (6 if hand else 0))
        quote = day + (rng.uniform(0.1, 0.4) if hand else 0.75)
        events += [event(f"b{i}", "Bring In", at(day), [f"R{i}", f"M{maker}"], user=f"desk{rng.randint(1, 4)}"),
                   event(f"q{i}", "Send Quote", at(quote), [f"R{i}"], user=f"desk{rng.randint(1, 4)}" if hand else "JOBSERVER"),
                   event(f"h{i}", "Hand Back", at(day + stay), [f"R{i}"], user="JOBSERVER")]
        if stay > 8:
            events.append(event(f"s{i}", "Say Sorry", at(day + stay - 0.01), [f"R{i}"], user=f"desk{rng.randint(1, 4)}"))
    return make_log(objects, events).settled()


def test_what_was_planted_is_found(make_log):
    log = workshop(make_log)
    for kpi in (STAY, LONG):
        a = A.analyse(log, kpi)
        names = [r["feature"] for r in a.findings.orderBy("position").collect()]
        assert a.status == "ok" and a.population == 360 and any("Velm" in x for x in names), (names, a.rejected)
        assert not any(word in x for x in names for word in ("Say Sorry", "colour", "weather", "Hand Back")), names
    assert any(x.startswith("man:Send Quote") for x in [r["feature"] for r in A.analyse(log, STAY).findings.collect()])
    velm = [{"kind": "dimension", "type": "Repair", "dimension": {"source": "related", "object_type": "Maker", "attribute": "title"}, "values": ["Velm"]}]
    a = A.analyse(log, STAY, apply(log, velm).settled(), velm)
    assert a.segment["worse"] and a.segment["n_seg"] + a.segment["n_rest"] == 360 and a.segment["med_seg"] - a.segment["med_rest"] > 5


def test_nothing_planted_nothing_found(make_log):
    a = A.analyse(workshop(make_log, 240, 4, causes=False), STAY)
    assert a.status == "none" and a.findings.count() == 0
    assert A.analyse(workshop(make_log, 25), STAY).status == "insufficient"


def test_sums_medians_and_overlaps_against_lists(spark):
    rng = random.Random(8)
    y = {f"c{i:03}": rng.choice([1.0, 2.5, 2.5, rng.uniform(0, 50)]) for i in range(301)}
    names = [f"f{j}" for j in range(7)] + ["Smith & Sons", "all but one"]
    has = {(c, f) for c in y for j, f in enumerate(names) if f == "all but one" and c != "c000" or f != "all but one" and rng.random() < 0.1 * (j + 1)}
    start = {c: datetime(2024, 1, 1) + timedelta(days=rng.randint(0, 90)) for c in y}
    pop = spark.createDataFrame([(c, v, start[c]) for c, v in y.items()], "case_id string, y double, start_ts timestamp").repartition(3)
    features = spark.createDataFrame([(c, f, "context", f) for c, f in has], "case_id string, feature string, family string, grp string")
    cases = C.cohort(pop, binary=False)
    marks = C.marks(cases, features)
    group = {f: [y[c] for c, g in has if g == f] for f in names}
    rest = {f: [v for c, v in y.items() if (c, f) not in has] for f in names}
    place = {v: statistics.mean(i for i, x in enumerate(sorted(y.values()), 1) if x == v) for v in set(y.values())}
    early = set(sorted(y, key=lambda c: (start[c], c))[:len(y) // 2])
    for f, s in C.sums(cases, marks).items():
        assert s.n == len(group[f]) and s.s == pytest.approx(sum(group[f])) and s.ranks == pytest.approx(sum(place[v] for v in group[f]))
        assert s.outside == pytest.approx(statistics.mean(rest[f])) and s.halves[0].n == sum((c, f) in has for c in early) and s.halves[0].total_n == 150
    got = {r["feature"]: (r["med_g"], r["med_r"]) for r in C.medians(cases, marks, names).collect()}
    assert got == {f: (pytest.approx(statistics.median(group[f])), pytest.approx(statistics.median(rest[f]))) for f in names}
    want = {}
    for a, b in itertools.combinations_with_replacement(sorted(names), 2):
        both = [y[c] for c in y if (c, a) in has and (c, b) in has]
        if both:
            want[a, b] = (len(both), pytest.approx(sum(both)))
    assert {(r["a"], r["b"]): (r["n"], r["s"]) for r in ST.overlaps(pop, features).collect()} == want
    pairs = C.sums(cases, C.pair_marks(marks, [("Smith & Sons", "f6")]))
    assert list(pairs) == ["Smith & Sons & f6"] and pairs["Smith & Sons & f6"].n == want["Smith & Sons", "f6"][0]


def test_tables_by_enumeration():
    rng = random.Random(1)
    for _ in range(400):
        a, b, c, d = (rng.randint(0, 8) for _ in range(4))
        row, col, n = a + b, a + c, a + b + c + d
        ps = {k: Fraction(math.comb(col, k) * math.comb(n - col, row - k), math.comb(n, row)) for k in range(max(0, row + col - n), min(row, col) + 1)}
        assert ST.fisher(a, b, c, d) == pytest.approx(float(sum(p for k, p in ps.items() if k >= a)), abs=1e-9)
        assert ST.fisher(a, b, c, d, two_sided=True) == pytest.approx(float(sum(p for p in ps.values() if p <= ps[a])), abs=1e-7)
    assert ST.fisher(600_000, 400_000, 500_000, 500_000) < 1e-200 and ST.fisher(50, 50, 50, 50, two_sided=True) == 1.0


def test_rank_sums_by_enumeration():
    for n1, n2 in ((1, 1), (3, 3), (2, 9), (4, 26), (8, 4), (21, 2)):
        sums = [sum(x) - n1 * (n1 + 1) // 2 for x in itertools.combinations(range(1, n1 + n2 + 1), n1)]
        for u in range(n1 * n2 + 1):
            assert ST.exact_rank_sum(u, n1, n2) == pytest.approx(sum(x >= u for x in sums) / len(sums), abs=1e-12)
    # nothing grows with the bigger sample: far from the middle of a billion values
    assert 0 < ST.mann_whitney(8 * 9 / 2 + 7.9e9, 8, 10 ** 9, 0.0) < 1e-10
    assert ST.mann_whitney(15.0, 3, 3, 0.0) == pytest.approx(0.05) and ST.mann_whitney(6.0, 3, 3, 0.0) == 1.0


def test_guards():
    kpi = {"population": {"op": "attribute", "attribute": "colour"}, "amount": "price",
           "condition": {"op": "any", "items": [{"op": "activity", "activities": ["Say Sorry"]}, {"op": "duration", "from": {"activity": "Bring In", "plus_days_attribute": "promised"}, "to": {"activity": "Hand Back"}}]}}
    filters = [{"kind": "dimension", "type": "Repair", "dimension": {"source": "related", "object_type": "Maker"}},
               {"kind": "dimension", "type": "Repair", "dimension": {"source": "activity", "activities": ["Send Quote"]}},
               {"kind": "dimension", "type": "Repair", "dimension": {"source": "event_attribute", "attributes": ["user"]}},
               {"kind": "condition", "type": "Maker", "condition": {"op": "attribute", "attribute": "title"}}, {"kind": "event", "attribute": "tool"}, {"kind": "ids", "ids": ["R1"]}]
    acts, attrs = A.P.not_causes(kpi, filters, "Repair")
    assert acts == {"Say Sorry", "Bring In", "Hand Back", "Send Quote"}
    assert attrs == {("Repair", "colour"), ("Repair", "promised"), ("Repair", "price"), ("Maker", "__id__"), ("__event__", "user"), ("Maker", "title"), ("__event__", "tool")}
