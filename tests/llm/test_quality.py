"""The quality classifier: its sample, its label model by hand, and long texts."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.llm import quality, words
from tests.conftest import SMALL

GOOD = "The council met on Tuesday and agreed to repair the old bridge before winter comes to the valley."
BAD = "BUY NOW!! CHEAP!! PILLS!! | | WIN!! $$$ ### CASINO!! NOW!! NOW!! NOW!! BUY!! 777 >> CLICK!!"


def table(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_one_text_repeated_gives_a_model(spark, seed):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit(GOOD).alias("text"))
    model = quality.learn(docs, seed=seed)
    rows = quality.score(docs, model, ["doc_id"]).select("posterior", "score", "is_good").distinct().collect()
    assert len(rows) == 1 and np.any(model["weights"])


def test_copies_do_not_flood_the_sample(spark):
    distinct = [f"{GOOD} {i} {i * 7}" for i in range(300)]
    place = {t: int(p) for t, p in table(spark, distinct).select("text", F.xxhash64(F.lit(4), "text")).collect()}
    low = min(distinct, key=place.get)
    docs = table(spark, distinct + [low] * 3000 + [None, "", "  \n"]).select(F.xxhash64(F.lit(4), "text").alias("place"), "text")
    votes = quality.vote_table(docs, 100)
    got = quality.sampled(docs, votes, 100, 1 << 20).collect()
    assert sorted(r["text"] for r in got) == sorted(sorted(distinct, key=place.get)[:100])
    few = quality.sampled(docs, votes, 100, len(low) * 10 + 20).collect()
    assert 1 < len(few) <= 10 and {r["text"] for r in few} <= set(distinct)
    assert [r["text"] for r in quality.sampled(docs, votes, 100, 1).collect()] == [low]  # one text at least, whole


def test_no_words_at_all(spark):
    for texts in ([], [None], ["", "   ", None]):
        docs = table(spark, texts)
        rows = quality.score(docs, quality.learn(docs), ["doc_id"]).collect()
        assert [(r["posterior"], r["score"], r["is_good"]) for r in rows] == [(0.0, 0.0, False)] * len(texts)


def test_pieces_of_long_texts_change_nothing(monkeypatch):
    long = " ".join(f"{GOOD} {i} {BAD if i % 5 == 0 else GOOD} again again" for i in range(200))
    rows = pa.array([None, long, "", GOOD, "word" * 5000, long + " " + long, BAD])
    whole, hashes = quality.described(rows), words.word_hashes(rows)
    sets = [x.tobytes() for x in words.shingle_sets(rows, 4)]
    monkeypatch.setattr(words, "PIECE", 997)
    for a, b in zip(whole, quality.described(rows)):
        assert np.allclose(a, b)
    assert all((a == b).all() for a, b in zip(hashes, words.word_hashes(rows)))
    assert sets == [x.tobytes() for x in words.shingle_sets(rows, 4)]


def test_statistics_against_plain_counting():
    rows = [GOOD, BAD, "one two two three. four! five!! | x"]
    s = quality.described(pa.array(rows))[0]
    for own, text in zip(s, rows):
        w = text.split()
        joined = "".join(w)
        letters = [c for c in joined if c.isalpha()]
        assert own[0] == len(w)
        assert own[1] == pytest.approx(len(letters) / len(joined))
        assert own[2] == pytest.approx(sum(c.isupper() for c in letters) / len(letters))
        assert own[4] == pytest.approx(sum(a.lower() == b.lower() for a, b in zip(w, w[1:])) / len(w))
        assert own[5] == pytest.approx(len({x.lower() for x in w}) / len(w))
        assert own[6] == pytest.approx(sum(x[-2:] in ("!!", "..", "??") for x in w) / len(w))
        assert own[7] == pytest.approx(sum(x in "|>*#=~" for x in w) / len(w))
        assert own[9] == pytest.approx(len(joined) / len(w))


def plain_em(rows, rounds):
    """Expectation-maximisation row by row, as the textbook has it, with the same start and smoothing."""
    good = [0.1 if -1 in v else 0.9 for v in rows]
    for _ in range(rounds):
        table = {(c, j, x): 0.5 for c in (0, 1) for j in range(quality.LABELLERS) for x in (-1, 1)}
        for v, g in zip(rows, good):
            for j, x in enumerate(v):
                if x:
                    table[1, j, x] += g
                    table[0, j, x] += 1 - g
        prior = (sum(good) + 1) / (len(rows) + 2)
        fresh = []
        for v in rows:
            odds = prior / (1 - prior)
            for j, x in enumerate(v):
                if x:
                    p = [table[c, j, x] / (table[c, j, -1] + table[c, j, 1]) for c in (0, 1)]
                    odds *= p[1] / p[0]
            fresh.append(odds / (1 + odds))
        good = fresh
    return good


def test_label_model_against_expectation_maximisation_row_by_row():
    draw = np.random.default_rng(5)
    truth = draw.random(800) < 0.7
    rows = [tuple(int(x) for x in np.where(draw.random(8) < 0.25, 0, np.where(draw.random(8) < 0.85, 1, -1) * (1 if t else -1))) for t in truth]
    patterns = quality.pattern_of(np.array(rows))
    kinds, counts = np.unique(patterns, return_counts=True)
    good, accuracy, _ = quality.fit(kinds, counts.astype(float), rounds=6)
    ours = dict(zip(kinds.tolist(), good.tolist()))
    want = plain_em(rows, 6)
    assert np.allclose([ours[int(p)] for p in patterns], want, atol=1e-6)
    assert all(0.75 < a < 0.95 for a in accuracy)


def test_scores_agree_with_a_plain_recount(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = quality.learn(docs)
    texts = docs.orderBy("doc_id").select("doc_id", "text").collect()
    s, word, shape, per_row = quality.described(pa.array([r["text"] for r in texts], pa.string()))
    at = np.concatenate(([0], np.cumsum(per_row)))
    want = {}
    for i, r in enumerate(texts):
        own = model["weights"].astype(float)
        z = model["bias"] + own[quality.bins_of(s[i : i + 1])[0]].sum()
        n = int(per_row[i])
        if n:
            z += 4 * sum(own[int(a)] + own[int(b)] for a, b in zip(word[at[i] : at[i + 1]], shape[at[i] : at[i + 1]])) / n
        want[r["doc_id"]] = 1 / (1 + np.exp(-np.clip(z, -30, 30))) if n else 0.0
    for r in quality.score(docs, model, ["doc_id"]).collect():
        assert r["score"] == pytest.approx(want[r["doc_id"]], abs=1e-6)
        assert r["is_good"] == (r["score"] >= 0.5)
