import math
import zlib

import numpy as np
import pytest

from millrace.llm import langid as L
from millrace.llm import quality as Q
from tests.llm.util import corpus, documents

SF = "/root/testdata/sf0.01"


def crc(i, n):
    return zlib.crc32(str(i).encode()) % n


def test_languages_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    out = L.languages(spark, docs).collect()
    assert len(out) == len(lang) and all(r.held_out == (crc(r.doc_id, 3) == 1) for r in out)
    held = [r for r in out if r.held_out]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in out)


def test_labels_of_held_out_rows_teach_nothing(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(300)
    changed = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, "zz").otherwise(F.col("lang"))).withColumn("source", F.lit(None).cast("string"))
    f = lambda d: sorted((r.doc_id, r.lang_pred, r.score) for r in L.languages(spark, d).collect())
    assert f(docs) == f(changed)


def test_language_edges(spark):
    rows = corpus(7, 20)
    out = {r.doc_id: r for r in L.languages(spark, documents(spark, rows)).collect()}
    for i, t in rows:
        letters = any(c.isalpha() for c in t or "")
        assert (out[i].lang_pred == "und") == (not letters), (i, t)
        assert out[i].score == 0.0 or letters
    assert L.languages(spark, documents(spark, [])).count() == 0
    alone = L.languages(spark, documents(spark, [(None, "some text"), (2, "more text")])).collect()
    assert {r.held_out for r in alone if r.doc_id is None} == {False}
    kept = L.identify(spark, documents(spark, rows), L.Model({"en": b"the cat", "de": b"die katze"}))
    assert kept.count() == len(rows) and {"size", "bucket", "lang_pred", "score"} <= set(kept.columns) and len(kept.columns) == len(set(kept.columns))


def test_code_lengths_are_proper():
    """The probabilities of all next bytes add up to one in every context."""
    m = L.Model({"a": b"abracadabra abracadabra\n" * 5, "b": b"banana bandana\n" * 8})
    for own, cost in m.tables:
        p = 2.0 ** -cost.reshape(-1, m.width).astype(float)
        p[:, -1] *= 256 - (m.width - 1)  # the last symbol stands for all bytes that were not seen
        assert np.allclose(p.sum(axis=1), 1, atol=1e-4)
    data = np.frombuffer(b"banana abra banana", np.uint8)
    whole = m.bits(data, np.array([0, 6, 6, 18]))
    assert whole[1].tolist() == [0, 0] and whole[0, 1] < whole[0, 0]


def test_sample_and_memory_of_training(spark, monkeypatch):
    """A language's sample is whole texts of up to 400 000 bytes, and the arrays of training stay small."""
    import random
    import tracemalloc

    from tests.llm.util import prose

    got, rng = {}, random.Random(2)
    with monkeypatch.context() as m:
        m.setattr(L, "Model", got.update)
        rows = [(i, prose(rng, 250), k) for k in ("a", "b") for i in range(450)]
        L.train(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    whole = {k: {t.encode() for _, t, x in rows if x == k} for k in got}
    assert set(got) == {"a", "b"} and all(390_000 < len(v) <= 400_000 and set(v.split(b"\n")) <= whole[k] for k, v in got.items())
    texts = {f"{k}{i}": v for k, v in got.items() for i in range(2)}
    tracemalloc.start()
    L.Model(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6


def test_texts_beyond_the_sample_are_passed_over(spark, monkeypatch):
    got = {}
    monkeypatch.setattr(L, "Model", got.update)
    monkeypatch.setattr(L, "SAMPLE_BYTES", 40)
    rows = [(i, "x" * 60 if i % 2 else f"text {i}", "a") for i in range(30)] + [(50, "y" * 100, "b"), (51, "", "c"), (7, "text again", "a"), (7, None, "a")]
    L.train(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert set(got) == {"a", "c"} and got["c"] == b"" and 30 < len(got["a"]) <= 40 and b"x" not in got["a"].replace(b"text", b"")


def plain_bits(texts, text):
    """Prediction by partial matching with dictionaries: one context after the other, bytes seen in longer ones left out."""
    folded = {k: L.fold(np.frombuffer(v, np.uint8)).tobytes() for k, v in texts.items()}
    known = set(b"".join(folded.values())) | {10}
    text = b"\n" * L.ORDER + bytes(L.fold(np.frombuffer(text, np.uint8)))
    out = []
    for k in sorted(folded):
        own, after = b"\n" * L.ORDER + folded[k], {}
        for i in range(L.ORDER, len(own)):
            for d in range(L.ORDER + 1):
                after.setdefault(own[i - d : i], []).append(own[i])

        def chance(context, byte, after=after):
            seen = after.get(context, [])
            shorter = (lambda b: chance(context[1:], b)) if context else (lambda b: 1 / max(256, len(known)))
            if context and len(seen) < L.LEAST:
                return shorter(byte)
            n, distinct = len(seen), set(seen)
            if byte in distinct:
                return seen.count(byte) / (n + len(distinct))
            left = 1 - sum(shorter(b) for b in distinct)
            return len(distinct) / (n + len(distinct)) * shorter(byte) / left

        out.append(-sum(math.log2(chance(text[i - L.ORDER : i], text[i])) for i in range(L.ORDER, len(text))))
    return out


def test_equals_plain_ppm():
    texts = {"a": "Der Hund und die Katze, der Käse und das Brot. ".encode() * 2 + b"die Hunde", "b": "The dog and the cat, the cheese and the bread. ".encode() * 2}
    m = L.Model(texts)
    for text in ("die Katze", "the cheese ÄÖ", "x", "qqq the dog and a zebra 123", "\n\n"):
        raw = text.encode()
        got = m.bits(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0]
        assert np.allclose(got, plain_bits(texts, raw), rtol=1e-4), text


def test_long_and_repeated_texts(spark):
    long = "der hund und die katze " * 60_000
    rows = [(3, long), (3, long), (6, "the cat and the dog"), (6, "the cat and the dog"), (9, "x" * 2_000_000)]
    model = L.Model({"de": b"der hund und die katze " * 20, "en": b"the dog and the cat " * 20, "en2": b"the dog and the cat " * 20})
    out = L.identify(spark, documents(spark, rows), model).collect()
    assert sorted((r.doc_id, r.lang_pred) for r in out if r.doc_id < 9) == [(3, "de"), (3, "de"), (6, "en"), (6, "en")] and len(out) == 5
    scored = Q.quality_scores(spark, documents(spark, rows), spark.createDataFrame([(3, 1), (3, 1), (6, 0)], "doc_id long, quality int")).collect()
    assert len(scored) == 5 and len({r.score for r in scored if r.doc_id == 3}) == 1


def test_long_texts_in_pieces(monkeypatch):
    m = L.Model({"a": b"abracadabra " * 50, "b": b"banana bandana " * 50})
    text = (b"abra banana " * 500)[:5555]
    data, off = np.frombuffer(text * 2, np.uint8), np.array([0, 5555, 11110])
    want = m.bits(data, off)
    monkeypatch.setattr(L, "_PIECE", 100)
    assert np.allclose(m.bits(data, off), want)


def test_quality_held_out(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    truth = {r.doc_id: r.quality for r in labels.collect()}
    out = Q.quality_scores(spark, docs, labels).collect()
    assert len(out) == docs.count() and all(r.held_out == (crc(r.doc_id, 4) == 2) and r.predicted == int(r.score >= 0.7) for r in out)
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.93
    from pyspark.sql import functions as F

    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert sorted(out) == sorted(Q.quality_scores(spark, docs, flipped).collect())


def test_quality_edges(spark):
    rows = corpus(8, 20)
    schema = "doc_id long, quality int, toxic int, features string, text string"
    labels = spark.createDataFrame([(i, k % 2, 0, "f", "t") for k, (i, _) in enumerate(rows)] + [(99_999, 1, 0, "", ""), (None, 1, 0, "", ""), (rows[0][0], None, 0, "", "")], schema)
    out = Q.quality_scores(spark, documents(spark, rows), labels).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    none = Q.quality_scores(spark, documents(spark, rows), labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    one = Q.quality_scores(spark, documents(spark, rows), labels.where("quality = 1")).collect()
    assert all(r.score > 0.5 for r in one)
    assert Q.quality_scores(spark, documents(spark, []), labels).count() == 0
    assert Q.quality_scores(spark, documents(spark, [(None, "x")]), labels).first().held_out is False


def test_features():
    texts = ["", "One two, two. TWO!", "a\nb", "12 ##x"]
    raw = [t.encode() for t in texts]
    data, off = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    f = {n: Q.features(data, off)[:, k] for k, n in enumerate(Q.FEATURES)}
    assert f["log_words"] == pytest.approx(np.log1p([0, 4, 2, 2]))
    assert f["upper"][1] == pytest.approx(4 / 12) and f["exclamations"][1] == pytest.approx(0.25)
    assert f["digits"][3] == pytest.approx(2 / 6) and f["lines"][2] == pytest.approx(0.5)
    assert (Q.features(data, off)[0] == 0).all()


def test_score_equals_plain_sum():
    """Bin by bin and pair by pair, without numpy."""
    rng = np.random.default_rng(4)
    x = rng.random((500, len(Q.FEATURES)))
    m = Q.Model(x, ((x[:, 1] > 0.6) | (x[:, 2] * x[:, 5] > 0.5)).astype(float))
    got = m.score(x[:60])
    for row, score in zip(x[:60].tolist(), got.tolist(), strict=True):
        total = m.base
        for j, v in enumerate(row):
            total += m.tables[j][sum(e <= v for e in m.edges[j])]
        for (i, j), t in m.pairs.items():
            total += t[sum(e <= row[i] for e in m.coarse[i])][sum(e <= row[j] for e in m.coarse[j])]
        assert score == pytest.approx(1 / (1 + math.exp(-total)))


def test_model_learns_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.random((4000, len(Q.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 3] > 0.5)).astype(float)
    m = Q.Model(x, y)
    assert (3, 0) in m.pairs and np.mean((m.score(x) > 0.5) == y) > 0.95
