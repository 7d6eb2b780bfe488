"""The mix as the query takes it, against budgets worked out by hand and every sum that the lengths allow."""

import re
from collections import Counter, defaultdict
from fractions import Fraction

import pytest

from plumbline.llm.queries import op8_mix_sources
from tests.conftest import SMALL

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_targets(sizes):
    """Weights 3, 1, 2 in code point order, null last, over 150 % of all; no target above twice the size."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, found = Fraction(3, 2) * sum(sizes.values()), {}
    while len(found) < len(order):
        free = [s for s in order if s not in found]
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        if not over:
            return found | share
        for s in over:
            found[s] = Fraction(2 * sizes[s])
            left -= found[s]
    return found


@pytest.mark.parametrize("sf_dir", [SMALL, "/root/testdata/sf0.01"])
def test_op8_against_every_sum(spark, sf_dir):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op8_mix_sources(spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    sizes, of = defaultdict(int), defaultdict(list)
    for r in rows:
        own = docs[r["doc_id"]]
        assert r["size"] == len(WORD.findall(own["text"] or ""))
        sizes[own["source"]] += r["size"]
        of[own["source"]].append(r)
    goal = plain_targets(sizes)
    for source, own in of.items():
        assert {r["source_size"] for r in own} == {sizes[source]}
        assert all(r["target"] == pytest.approx(float(goal[source])) for r in own)
        whole = int(goal[source] // sizes[source])
        budget = round(float(goal[source])) - whole * sizes[source]
        more = [r["taken"] - whole * r["size"] for r in own]
        assert all(m in (0, r["size"]) for m, r in zip(more, own))
        # of every length the same share, and of the other documents whatever comes nearest to the rest of the budget
        counts = Counter(r["size"] for r in own)
        share = {n: c * budget // sizes[source] for n, c in counts.items()}
        reach, rest = 1, budget - sum(n * c for n, c in share.items())
        for n, c in counts.items():
            for _ in range(c - share[n]):
                reach |= reach << n
        assert sum(more) == budget - rest + (reach & ((1 << (rest + 1)) - 1)).bit_length() - 1
        taken = Counter(r["size"] for m, r in zip(more, own) if m)
        assert all(taken[n] >= c for n, c in share.items())


@pytest.mark.parametrize("seed", range(4))
def test_targets_of_any_number_of_sources(spark, seed):
    import random

    from plumbline.llm import mixing

    draw = random.Random(seed)
    sizes = [(f"s{i}", draw.choice([0, 1, 5, 1000, draw.randint(0, 10**6)])) for i in range(draw.choice([1, 2, 40, 300]))] + [(None, 77)]
    table = spark.createDataFrame(sizes, "source string, total long").repartition(3)
    got = {r["source"]: (r["source_size"], r["target"]) for r in mixing.target_table(table, (3, 1, 2), 1.5, 2.0).collect()}
    want = mixing.targets(sizes, (3, 1, 2), 1.5, 2.0)
    assert got == {s: (n, pytest.approx(want[s])) for s, n in sizes}
    assert mixing.target_table(table.where("false"), (3, 1, 2), 1.5, 2.0).count() == 0


def test_more_sources_than_the_driver_lists(spark, monkeypatch):
    from plumbline.llm import mixing

    rows = [(i, "w " * (i % 7 + 1), f"s{i % 50}" if i % 11 else None) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = sorted(map(tuple, mixing.mix(docs).collect()), key=str)
    monkeypatch.setattr(mixing, "MOST_SOURCES", 10)
    assert sorted(map(tuple, mixing.mix(docs).collect()), key=str) == want


def test_rows_that_nothing_tells_apart(spark, monkeypatch):
    from plumbline.llm import mixing

    monkeypatch.setattr(mixing, "RUN", 7)
    rows = [(None, "a b", "x")] * 2000 + [(i, "c d", "x") for i in range(900)] + [(5, "e f", "x")] * 500 + [(i, "g h i", "y") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted(map(tuple, mixing.mix(docs).collect()), key=str)
    assert len(got) == len(rows) and got == sorted(map(tuple, mixing.mix(docs.repartition(9)).collect()), key=str)
    taken = sum(r["taken"] for r in mixing.mix(docs).collect() if r["source_size"] == 6800)
    target = mixing.targets([("x", 6800), ("y", 120)], (3, 1, 2), 1.5, 2.0)["x"]
    assert abs(taken - target) <= 2
