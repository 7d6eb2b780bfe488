import zlib

from pyspark.sql import functions as F

import corpus_pipeline as cp
from plumbline.llm.common import written
from tests.conftest import SMALL
from tests.llm.test_jaccard import WORD, brute


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").withColumns({"score": F.lit(1), "__kept": F.lit("x")})
    clean = docs.where("lang = 'en'").limit(1).drop("doc_id", "text").withColumns({"doc_id": F.lit(10**6).cast("long"), "text": F.lit("... 123 ...")})
    docs = written(docs.unionByName(clean), "docs")
    sizes = []
    for name, stage in cp.STAGES:
        after = stage(spark, docs, SMALL)
        if name != "byte_bpe":
            assert after.columns == docs.columns
            after = written(after, name)
        sizes.append((name, docs.count(), after.count()))
        if name == "language_id":
            assert after.where("doc_id = 1000000").count() == 0
        if name == "ngram_jaccard_join":
            rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
            assert sorted(r["doc_id"] for r in after.collect()) == sorted({c for _, _, c in brute(rows)})
        if name == "mix_sources":
            most = after.groupBy("doc_id").count().agg(F.max("count")).first()[0]
            assert most <= 2
        docs = after
    by = {n: (a, b) for n, a, b in sizes}
    assert by["language_id"][0] - by["language_id"][1] == 1
    assert by["quality_classifier"][1] < by["quality_classifier"][0] and by["ngram_jaccard_join"][1] < by["ngram_jaccard_join"][0]
    assert by["byte_bpe"][0] == by["byte_bpe"][1]


def test_language_learns_from_every_labelled_row(spark):
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 4 == 2][:4]
    rows = [(1000 + i, f"The plain words of story number {i} are read by many.", "en") for i in range(8)]
    rows += [(i, "Οι απλές λέξεις αυτής της ιστορίας διαβάζονται από πολλούς.", "el") for i in ids]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert sorted(r["doc_id"] for r in cp.language(spark, docs, SMALL).collect()) == sorted(r[0] for r in rows)


def test_run_equals_the_stages(spark, tmp_path):
    folder = str(tmp_path)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where("doc_id < 80")
    docs.unionByName(docs.where("doc_id = 3")).unionByName(docs.limit(1).withColumns({"doc_id": F.lit(None).cast("long"), "text": F.lit(None).cast("string")})).write.parquet(f"{folder}/documents.parquet")
    out = cp.run(spark, folder)
    assert out.where("n_tokens is null or doc_id is null").count() == 0 and out.count() > 30


def brute_five(rows):
    """The smallest key of each group that links of 5-word Jaccard 0.8 or more make."""
    sets = {k: set(zip(*(WORD.findall(t.lower())[i:] for i in range(5)))) for k, t in rows}
    low = {k: k for k in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                    low[a] = low[b] = min(low[a], low[b])
    return sorted(set(low.values()))


def test_near_copies_share_four_fifths_of_five_word_shingles(spark):
    rows = []
    for group, edit in enumerate((8, 12, 14, 16, 17, 18, 24)):
        words = [f"g{group}w{i}" for i in range(200)]
        rows += [(2 * group, " ".join(words)), (2 * group + 1, " ".join(words[:90] + [f"x{w}" for w in words[90 : 90 + edit]] + words[90 + edit :]))]
    kept = cp.distinct(spark, spark.createDataFrame(rows, "doc_id long, text string"), SMALL)
    want = brute_five(rows)
    assert sorted(r["doc_id"] for r in kept.collect()) == want
    assert want != sorted({c for _, _, c in brute(rows)}) and 7 not in want and 13 in want


def test_run_against_the_stages_by_plain_code(spark, tmp_path):
    """Every stage's decisions by other code: distances term by term, scores one by one, all pairs, budgets, the library."""
    import base64
    import hashlib
    from collections import Counter

    import pyarrow as pa
    import tiktoken

    import public_tokenizers as P
    from plumbline.llm import langid, mixing, quality
    from tests.llm.test_langid import plain_grams, plain_ranks

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where("doc_id < 110")
    odd = docs.limit(1).withColumns({"doc_id": F.lit(500).cast("long"), "text": F.lit(None).cast("string")})
    docs.unionByName(odd).unionByName(docs.where("doc_id in (3, 4)")).write.parquet(f"{tmp_path}/documents.parquet")
    rows = [r.asDict() for r in spark.read.parquet(f"{tmp_path}/documents.parquet").collect()]
    # language ID
    total = {}
    for r in rows:
        if r["text"] is not None and r["lang"] is not None:
            total.setdefault(r["lang"], Counter()).update(plain_grams(r["text"]))
    place = {lang: {g: i for i, g in enumerate(plain_ranks(c, langid.PROFILE))} for lang, c in total.items()}

    def known(text):
        own = plain_ranks(plain_grams(text or ""), langid.PROFILE)
        apart = [sum(abs(at[g] - i) if g in at else langid.PROFILE for i, g in enumerate(own)) for at in place.values()]
        return bool(own) and 1 - min(apart) / (len(own) * langid.PROFILE) >= cp.LEAST_LANGUAGE_SCORE

    rows = [r for r in rows if known(r["text"])]
    # quality, by the model that the stage learns from these rows
    model = quality.learn(spark.createDataFrame([(r["text"],) for r in rows], "text string"))

    def is_good(text):
        s, word, shape, per_row = quality.described(pa.array([text]))
        w = model["weights"].astype(float)
        return bool(per_row[0]) and model["bias"] + 4 * (w[word].sum() + w[shape].sum()) / per_row[0] + w[quality.bins_of(s)[0]].sum() >= 0

    rows = [r for r in rows if is_good(r["text"])]
    # near duplicates
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)} for w in (WORD.findall(r["text"].translate({i: i + 32 for i in range(65, 91)})) for r in rows)]
    low = [r["doc_id"] for r in rows]
    links = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j and 5 * len(a & b) >= 4 * len(a | b)]
    for _ in rows:
        for i, j in links:
            low[i] = low[j] = min(low[i], low[j])
    rows = list({r["doc_id"]: r for i, r in enumerate(rows) if low[i] == r["doc_id"]}.values())
    # mixing
    out = cp.run(spark, str(tmp_path)).collect()
    taken = Counter(r["doc_id"] for r in out)
    assert set(taken) <= {r["doc_id"] for r in rows} and max(taken.values()) <= 2
    size = {r["doc_id"]: len(WORD.findall(r["text"])) for r in rows}
    per = Counter()
    for r in rows:
        per[r["source"]] += size[r["doc_id"]]
    goal = mixing.targets(list(per.items()), (3, 1, 2), 1.5, 2.0)
    for source, target in goal.items():
        got = sum(size[r["doc_id"]] * taken[r["doc_id"]] for r in rows if r["source"] == source)
        longest = max(size[r["doc_id"]] for r in rows if r["source"] == source)
        assert target - longest <= got <= target + 1
    # encoding
    enc = tiktoken.Encoding("test", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(cp.BPE_RANKS), "rb"))}, special_tokens={})
    text = {r["doc_id"]: r["text"] for r in rows}
    for r in out:
        assert r["decoded_sha256"] == hashlib.sha256(text[r["doc_id"]].encode()).hexdigest()
        assert r["n_tokens"] == len(enc.encode_ordinary(text[r["doc_id"]]))
    assert len(out) == sum(taken.values()) > 20


def test_stages_leave_clashing_names_and_odd_tables_alone(spark):
    more = {n: F.lit(n) for n in ("row_name", "copy_no", "lang_found", "lang_score", "good_found", "good_score", "good_posterior", "size", "text_2")}
    docs = written(spark.read.parquet(f"{SMALL}/documents.parquet").where("doc_id < 40").withColumns(more), "docs")
    for name, stage in cp.STAGES[:-1]:
        docs = written(stage(spark, docs, SMALL), name)
        assert {"row_name", "copy_no", "good_score"} <= set(docs.columns)
        row = docs.first()
        assert all(row[n] == n for n in more)
    empty = spark.read.parquet(f"{SMALL}/documents.parquet").where("false")
    assert all(stage(spark, empty, SMALL).count() == 0 for _, stage in cp.STAGES)
    same = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("The council met on Tuesday and agreed to repair the old bridge.").alias("text"), F.lit("en").alias("lang"), F.lit("web").alias("source"), F.lit(62).cast("long").alias("n_chars"))
    for name, stage in cp.STAGES[:3]:
        same = written(stage(spark, same, SMALL), name)
    assert [r["doc_id"] for r in same.collect()] in ([0], [])


def test_stage_tables_are_deleted_once_read(spark, tmp_path):
    import glob

    spark.read.parquet(f"{SMALL}/documents.parquet").where("doc_id < 30").write.parquet(f"{tmp_path}/documents.parquet")
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    count = lambda n: len(glob.glob(f"{folder}/plumbline/{n}-*"))
    before = {n: count(n) for n, _ in cp.STAGES}
    whole = count("*")
    assert cp.run(spark, str(tmp_path)).count() > 0
    assert {n: count(n) - before[n] for n in before} == {"language_id": 0, "quality_classifier": 0, "ngram_jaccard_join": 0, "mix_sources": 1, "byte_bpe": 0}
    assert count("*") == whole + 1  # the tables within the stages are gone too
