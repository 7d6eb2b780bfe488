"""Rank-order profiles against plain counting and the out-of-place distance term by term."""

from collections import Counter

import numpy as np
import pytest

from plumbline.llm import langid
from tests.conftest import SMALL


def plain_grams(text):
    """All 1-, 2- and 3-grams of letters and word edges, as strings with _ for an edge."""
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    line = "_" + "".join(w + "_" for w in words) if words else ""
    out = Counter(c for c in line if c != "_")
    out.update(line[i : i + 2] for i in range(len(line) - 1))
    out.update(line[i : i + 3] for i in range(len(line) - 2) if line[i + 1] != "_")
    return out


def code(gram):
    n = 0
    for c in gram:
        n = n << 21 | (langid.EDGE if c == "_" else ord(c))
    return n


def plain_ranks(counts, size):
    return [g for g, _ in sorted(((code(g), n) for g, n in counts.items()), key=lambda x: (-x[1], x[0]))][:size]


TEXTS = ["Ab, ab é!", "x", "", "..", "😀a漢漢字 𐐀𐐁", "a1b ab", "ΣΑΣ σας, Ünï", "the cat and the other cat " * 40, "один два, два три"]


@pytest.mark.parametrize("piece", [1 << 20, 7, 1])
def test_grams_and_ranks(monkeypatch, piece):
    monkeypatch.setattr(langid, "PIECE", piece)
    for t in TEXTS:
        want = plain_grams(t)
        g, n = langid.gram_counts(t)
        assert dict(zip(g.tolist(), n.tolist())) == {code(k): v for k, v in want.items()}, t
        for size in (3, 400):
            assert langid.ranked(t, size).tolist() == plain_ranks(want, size)


def test_letters_beyond_latin_keep_their_codes():
    codes = {int(langid.gram_counts(chr(c))[0][0]) for c in range(0x250, 0x600) if chr(c).lower() == chr(c) and chr(c).isalpha()}
    assert len(codes) == sum(1 for c in range(0x250, 0x600) if chr(c).lower() == chr(c) and chr(c).isalpha())


def test_predictions_against_the_distance_term_by_term(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang")
    rows = docs.collect()
    total = {}
    for r in rows:
        if r["text"] is not None and r["lang"] is not None:
            total.setdefault(r["lang"], Counter()).update(plain_grams(r["text"]))
    want = {lang: plain_ranks(c, langid.PROFILE) for lang, c in total.items()}
    known = langid.profiles(docs)
    assert known == want
    place = {lang: {g: i for i, g in enumerate(gs)} for lang, gs in want.items()}
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(docs, known, ["doc_id"]).collect()}
    for r in rows:
        own = plain_ranks(plain_grams(r["text"] or ""), langid.PROFILE)
        if not own:
            assert found[r["doc_id"]] == ("und", 0.0)
            continue
        apart = {lang: sum(abs(at[g] - i) if g in at else langid.PROFILE for i, g in enumerate(own)) for lang, at in place.items()}
        best = min(sorted(apart), key=apart.get)
        assert found[r["doc_id"]][0] == best
        assert found[r["doc_id"]][1] == pytest.approx(1 - apart[best] / (len(own) * langid.PROFILE), abs=1e-12)


def test_odd_tables(spark):
    docs = spark.createDataFrame([("a", None, "x"), (None, "ja ja", "de"), ("b", "12", "de"), ("b", "yes", None)], "doc_id string, text string, lang string")
    known = langid.profiles(docs)
    assert list(known) == ["de"] and langid.profiles(docs.where("false")) == {}
    assert sorted(r["lang_pred"] for r in langid.identify(docs, known, docs.columns).collect()) == ["de", "de", "und", "und"]
    with pytest.raises(ValueError, match="names"):
        langid.identify(docs.withColumnRenamed("lang", "score"), known, ["score"])
    assert np.isfinite([r["score"] for r in langid.identify(docs, known, ["doc_id"]).collect()]).all()
