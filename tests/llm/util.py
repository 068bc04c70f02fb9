"""Fixtures and brute-force references for the corpus operators."""

import random
import re

WORDS = [a + b for a in ("ka", "lo", "mi", "nu", "pe", "ra") for b in ("", "ta", "so", "vi", "den")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, start long, score double, node long, k0 long, bucket string, features string"
#: Columns beyond those of documents have names that operators use inside.
EXTRA = (7, 8, 0.5, 9, 10, "x", "y")


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + (f"{rng.randrange(40)}" if rng.random() < 0.5 else "") for _ in range(n))


def edit(rng, text, rate):
    return " ".join(rng.choice(WORDS) + "x" if rng.random() < rate else w for w in text.split(" "))


def corpus(seed=1, n=60):
    """Random documents with exact and near copies, small sets, shared passages, nulls, and odd texts."""
    rng = random.Random(seed)
    passage, texts = prose(rng, 70), []
    for _ in range(n):
        kind = rng.random()
        if kind < 0.3 and texts:
            texts.append(rng.choice(texts))
        elif kind < 0.5 and texts:
            texts.append(edit(rng, rng.choice(texts) or "", 0.03))
        elif kind < 0.6:
            texts.append(prose(rng, rng.randrange(1, 12)))
        elif kind < 0.75:
            texts.append(prose(rng, rng.randrange(5, 60)) + "\n" + passage + "\n" + prose(rng, 20))
        else:
            texts.append(prose(rng, rng.randrange(20, 200)))
    texts += [None, "", " \t\n", "x", "X", "one two three four", "One two  three\tfour", "é" * 60, "123 456", "  a b", prose(rng, 3000), "a" * 3000, "😀 " * 40]
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows


def documents(spark, rows):
    """``rows(doc_id, text)`` as a table like documents, with extra columns."""
    langs, sources = ["en", "de", None], ["s1", "s1", "s2", None]
    data = [(i, t, langs[k % 3], sources[k % 4], None if t is None else len(t), *EXTRA) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(data, SCHEMA)


def words_of(text):
    lower = {c: c + 32 for c in range(65, 91)}
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(lower))


def shingles(text, width=5):
    w = words_of(text)
    if len(w) >= width:
        return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1))
    return frozenset([tuple(w)]) if w else frozenset()


def jaccard_components(rows, num=80, den=100):
    """Brute force over all pairs: {doc_id: (set size, least doc_id reachable)}."""
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y]:
                both = len(sets[x] & sets[y])
                if den * both >= num * (len(sets[x]) + len(sets[y]) - both):
                    a, b = find(x), find(y)
                    root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}
