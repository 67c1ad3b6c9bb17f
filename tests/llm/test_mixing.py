import re
from fractions import Fraction

from lodestack.llm import mixing as m


def water(sizes):
    """Targets by giving out and reshared excess, step by step."""
    names = sorted(k for k in sizes if k is not None) + ([None] if None in sizes else [])
    weight = {k: (3, 1, 2)[i % 3] for i, k in enumerate(names)}
    left, fixed = Fraction(3, 2) * sum(sizes.values()), {}
    while True:
        rest = [k for k in names if k not in fixed]
        total = sum(weight[k] for k in rest)
        share = {k: (left - sum(fixed.values())) * weight[k] / total for k in rest}
        over = [k for k in rest if share[k] > 2 * sizes[k]]
        if not over:
            return {k: float(v) for k, v in (fixed | share).items()}
        fixed |= {k: Fraction(2 * sizes[k]) for k in over}


def test_targets_and_taken(spark):
    rows = [(k, "w " * (k % 37), ["a", "b", "c", "dd", "é", None][k % 6] if k % 5 else "a") for k in range(1, 900)]
    got = m.mix_report(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    source = {k: s for k, _, s in rows}
    sizes = {}
    for k, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t))
    expected = water(sizes)
    taken = {}
    for r in got:
        s = source[r["doc_id"]]
        assert abs(r["target"] - expected[s]) < 1e-6 and r["source_size"] == sizes[s] and 0 <= r["taken"] <= 2 * r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
    assert all(abs(taken[s] - expected[s]) <= 1 for s in taken)
    again = m.mix_report(spark.createDataFrame(rows[::-1], "doc_id long, text string, source string")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_mix_is_in_order_and_within_budget(spark):
    df = spark.createDataFrame([(k, "w " * 5, "ab"[k % 2]) for k in range(200)], "doc_id long, text string, source string")
    rows = m.mix(df).collect()
    assert [r["finish"] for r in rows] == sorted(r["finish"] for r in rows) and sum(r["words"] for r in rows) == 1500
    assert {s: sum(r["words"] for r in rows if r["source"] == s) for s in "ab"} == {"a": 1000, "b": 500}


def test_odd_rows(odd, none):
    rows = m.mix_report(odd).collect()
    assert len(rows) == odd.count() and all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    assert m.mix_report(none).count() == 0
    assert all(r["taken"] == 0 for r in m.mix_report(odd.where("text is null")).collect())


def test_cut_is_a_place_in_the_one_order_of_all_words(spark):
    """Truncated at any total budget, as by sorting every word of every copy."""
    rows = [(k, "w " * (k % 37 + (900 if k == 7 else 0)), ["a", "b", "c", None][k % 4] if k % 3 else "a") for k in range(150)]
    placed = m.written(m.placed(spark.createDataFrame(rows, "doc_id long, text string, source string")), "placed")
    of = {r["source"]: (r["source_size"], r["target"]) for r in placed.collect()}
    every = sorted(j / t for n, t in of.values() for j in range(1, 2 * n + 1))
    whole = sum(int(t) for _, t in of.values())
    for bins in (1, 8, 1024):
        for budget in (None, 0, 1, 77, whole - 1, len(every), 10**9):
            at = m.cut(placed, bins=bins, budget=budget).first()["at"]
            n = whole if budget is None else min(budget, len(every))
            assert at == (every[n - 1] if n else None)
    dealt = m._dealt(placed, 2, 8).select("source", "target", "dealt").distinct().collect()
    assert {r["source"]: r["dealt"] for r in dealt} == {s: int(t) for s, (_, t) in of.items()}
