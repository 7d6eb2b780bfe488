import random
import re

import numpy as np
import pyarrow as pa
import pytest

from plumbline.llm import jaccard
from plumbline.llm.components import connected

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(t):
    w = WORD.findall((t or "").translate({i: i + 32 for i in range(65, 91)}))
    return {tuple(w)} if 0 < len(w) < 4 else set(zip(w, w[1:], w[2:], w[3:]))


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            n = len(a & sets[j])
            if n and 100 * n >= 85 * (len(a) + len(sets[j]) - n):
                root[find(i)] = find(j)
    low = {}
    for i, (k, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), k), k)
    return sorted((k, len(s), low[find(i)]) for i, ((k, _), s) in enumerate(zip(rows, sets)))


def check(spark, rows):
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, sk string, n int").repartition(3)
    got = sorted(tuple(r) for r in jaccard.similar_groups(df).select("doc_id", "n_shingles", "component_id").collect())
    assert got == brute(rows)


def corpus(seed, n_groups, copies):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = [draw.choice(words) for _ in range(60)]
    rows = []
    for _ in range(n_groups):
        base = [draw.choice(words) for _ in range(draw.randint(3, 160))]
        if draw.random() < 0.5:
            base += passage
        for _ in range(draw.randint(1, copies)):
            t = list(base)
            for _ in range(draw.randint(0, max(1, len(t) // 40))):
                t[draw.randrange(len(t))] = draw.choice(words)
            rows.append((len(rows), draw.choice([" ", "\n", "  "]).join(t).replace("w1", draw.choice(["w1", "W1"]))))
    return rows


def test_small_groups_and_edges(spark):
    rows = corpus(1, 60, 4)
    n = len(rows)
    rows += [(n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, "one"), (n + 4, "ONE"), (n + 5, "two words"), (n + 6, "two\x0bwords"), (n + 7, "é É"), (n + 8, "long " * 3000), (n + 9, "long " * 9000)]
    check(spark, rows)


def test_large_groups_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 20)
    monkeypatch.setattr(jaccard, "COMMON", 4)
    check(spark, corpus(2, 8, 60))


def test_without_known_common_shingles(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "MOST_COMMON", 0)
    check(spark, corpus(3, 30, 6))


def test_empty_and_repeated(spark):
    df = spark.createDataFrame([(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (7, "q")], "doc_id long, text string")
    got = jaccard.similar_groups(df).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"]) for r in got) == [(0, 5), (5, 5), (5, 5), (7, 7)]
    assert jaccard.similar_groups(df.where("false")).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1001), (2, 2)]
    got = dict(connected(spark.createDataFrame(edges, "u long, v long").repartition(4)).collect())
    assert len(got) == 303 and {got[i] for i in range(301)} == {0} and got[1001] == 1000


def test_links_and_pairs(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 20)
    monkeypatch.setattr(jaccard, "COMMON", 4)
    monkeypatch.setattr(jaccard, "MOST_PAIRS", 16)
    rows = corpus(5, 6, 40)
    rows += [(len(rows) + i, t) for i, t in enumerate([rows[0][1]] * 3 + [None, "", "one"])]
    sets = [frozenset(shingles(t)) for _, t in rows]
    near = lambda a, b: a and 100 * len(a & b) >= 85 * len(a | b)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["n_links"]) for r in jaccard.similar_groups(df, links=True).collect())
    assert [r[:3] for r in got] == brute(rows)
    assert [r[3] for r in got] == [sum(bool(near(a, b)) for j, b in enumerate(sets) if j != i) for i, a in enumerate(sets)]
    pairs, members = jaccard.similar_pairs(df)
    sk = {r["doc_id"]: r["sk"] for r in members.collect()}
    name = {s: sk[i] for i, s in enumerate(sets)}
    distinct = sorted(set(sets), key=len)
    want = {(*sorted((name[a], name[b])), len(a & b)) for i, a in enumerate(distinct) for b in distinct[:i] if near(a, b)}
    found = pairs.collect()
    assert len(found) == len(want) > 50 and {(r["u"], r["v"], r["shared"]) for r in found} == want
    assert len(sk) == len(rows) and all(r["similarity"] >= 0.85 and r["u"] < r["v"] for r in found)


@pytest.mark.parametrize("common, most", [(1, 1), (1, 1 << 21), (2, 1)])
def test_whatever_counts_as_common(spark, monkeypatch, common, most):
    monkeypatch.setattr(jaccard, "COMMON", common)
    monkeypatch.setattr(jaccard, "MOST_COMMON", most)
    check(spark, corpus(7, 12, 8))


def test_bands_of_size_in_a_large_cluster(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 3)
    monkeypatch.setattr(jaccard, "COMMON", 2)
    words = [f"w{i}" for i in range(420)]
    rows = [(i, " ".join(words[:n])) for i, n in enumerate([*range(4, 400, 5), *range(6, 400, 17), 4, 200, 200, 395])]
    check(spark, rows)
    base = spark.createDataFrame(rows, "key long, text string")
    described, blocks = jaccard.compared(base, 4, 85, False)
    n = {r["sk"]: r["n"] for r in described.collect()}
    met = {}
    for r in blocks.select("cluster", "lo", "hi", "sk").collect():
        met.setdefault((r["cluster"], r["lo"], r["hi"]), set()).add(n[r["sk"]])
    assert len(met) > 20 and all(max(x) <= 1.5 * min(x) + 1 for x in met.values())  # no block holds sets of far sizes


def test_tokens_of_48_bits_go_through_blobs():
    draw = np.random.default_rng(3)
    tokens = np.unique(draw.integers(0, 1 << jaccard.TOKEN, 5000, dtype=np.uint64))
    names, sizes = draw.integers(-(2**63), 2**63 - 1, len(tokens)), draw.integers(1, 2**31, len(tokens))
    parts = jaccard.ranged(tokens, 64, (names.view(np.uint64), 8), (sizes, 4))
    assert parts.num_rows == 64
    got = [jaccard.unpacked(pa.Table.from_batches([parts.slice(i, 1)])) for i in range(64)]
    for i, want in enumerate((tokens, names, sizes)):
        assert (np.concatenate([g[i] for g in got]) == want).all()
    assert all((g[0] >> np.uint64(jaccard.TOKEN - 6) == i).all() for i, g in enumerate(got))
