import collections
import hashlib

from tokenizers import Tokenizer

import corpus_pipeline
from millrace.llm import boilerplate, mixing
from millrace.llm.bpe import vocabulary_path
from tests.llm.util import corpus, documents, jaccard_components, prose, words_of


def write(spark, path, rows):
    documents(spark, rows).write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_against_brute_force(spark, tmp_path):
    import random

    rng = random.Random(3)
    rows = corpus(21, 80) + [(5000 + i, prose(rng, rng.randrange(50, 300)) + "\nAll rights reserved.") for i in range(40)]
    at = write(spark, tmp_path, rows)
    docs = spark.read.parquet(f"{at}/documents.parquet")
    source = {r.doc_id: r.source for r in docs.collect()}
    # language ID: what has letters stays
    kept = [(i, t) for i, t in rows if t is not None and any(c.isalpha() for c in t)]
    # line dedup
    total, n = collections.Counter(source[i] for i, _ in kept), collections.Counter()
    for i, t in kept:
        for line in {x.strip(boilerplate.BLANK) for x in t.split("\n")} - {""}:
            n[source[i], line] += 1
    bad = {k for k, c in n.items() if c >= boilerplate.MIN_PAGES and c > boilerplate.RATIO * total[k[0]]}
    kept = [(i, "\n".join(x for x in t.split("\n") if (source[i], x.strip(boilerplate.BLANK)) not in bad)) for i, t in kept]
    # near duplicates: the first of each group
    groups = jaccard_components(kept)
    kept = {i: t for i, t in kept if groups[i][1] == i}
    # the mix: by its own report on what was kept
    table = docs.where(docs.doc_id.isin(list(kept))).drop("text").join(spark.createDataFrame(list(kept.items()), "doc_id long, text string"), "doc_id")
    taken = {r.doc_id: r for r in mixing.taken_words(spark, table).collect()}
    library = Tokenizer.from_file(vocabulary_path())
    out = corpus_pipeline.run(spark, at).collect()
    seen = collections.Counter(r.doc_id for r in out)
    assert set(seen) <= set(kept)
    for i, t in kept.items():
        size = len(words_of(t))
        assert abs(seen[i] - taken[i].taken / size) < 1 if size else seen[i] == 1
    for r in out:
        assert r.n_tokens == len(library.encode(kept[r.doc_id], add_special_tokens=False).ids)
        assert r.decoded_sha256 == hashlib.sha256(kept[r.doc_id].encode()).hexdigest()


def test_stages_keep_columns(spark, tmp_path):
    at = write(spark, tmp_path, corpus(22, 40) + [(1, "a b c"), (None, "some words here"), (None, None)])
    docs = spark.read.parquet(f"{at}/documents.parquet")
    names = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, at)
        assert docs.columns == names
    assert corpus_pipeline.STAGES[-1][1](spark, docs, at).columns[0] == "doc_id"


def test_line_dedup_updates_lengths(spark):
    rows = [(i, f"Same line\nown {i}") for i in range(10)]
    out = corpus_pipeline.line_dedup(spark, documents(spark, rows), "").collect()
    assert all(r.n_chars == len(r.text) for r in out) and any("Same" not in r.text for r in out)


def test_empty_table(spark, tmp_path):
    assert corpus_pipeline.run(spark, write(spark, tmp_path, [])).count() == 0


def test_repeated_doc_ids(spark):
    """Each text is judged by its own group, in whatever order the rows come, and equal rows stay once."""
    import random

    rng = random.Random(4)
    a, b, c = (prose(rng, n) for n in (80, 90, 70))
    rows = [(5, a), (5, b), (7, b + " more"), (9, "more " + a), (5, a + " end"), (8, c), (8, c), (8, c.replace(" ", "  ")), (6, b + " b"), (6, c + " c"), (None, a), (None, a)]
    results = set()
    for order in (range(12), reversed(range(12)), [3, 5, 0, 6, 2, 4, 1, 11, 7, 9, 10, 8]):
        docs = documents(spark, [rows[i] for i in order]).drop("lang", "source")
        out = corpus_pipeline.near_duplicate_removal(spark, docs, "").collect()
        results.add(tuple(sorted(((r.doc_id, r.text) for r in out), key=str)))
    (got,) = results
    ids = [d for d, _ in got]
    assert sorted(ids, key=str) == [5, 5, 6, None, None]
    texts = {t for d, t in got if d == 5}
    assert len(texts) == 2 and b in texts and texts & {a, a + " end"} and (6, c + " c") in got


def test_very_long_texts_and_ties(spark, tmp_path):
    """A text of more than a megabyte passes every stage whole; of equal texts the first by doc_id stays."""
    import random

    rng = random.Random(9)
    long = prose(rng, 200_000)
    rows = [(7, long), (3, long), (5, long + " x"), (9, "only a few words here"), (8, "only a few words here")] + [(20 + i, prose(rng, 80)) for i in range(80)]
    at = write(spark, tmp_path, rows)
    out = corpus_pipeline.run(spark, at).collect()
    assert {r.doc_id for r in out} <= {3, 8, *range(20, 100)}
    assert all(r.decoded_sha256 == hashlib.sha256(long.encode()).hexdigest() for r in out if r.doc_id == 3)
