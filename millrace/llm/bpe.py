"""Byte-level BPE with a published vocabulary: encoding by a contiguous rank array, and decoding.

Text is cut at added tokens, then by the vocabulary's pattern into words. A word starts as its bytes.
Two arrays stand side by side: the parts, and the rank of the merge of each part with the next.
The least rank is found by a scan, its boundary deleted, and the two neighbouring ranks looked up
again, until no merge is left. A word is short, so scanning beats any heap; only words beyond
``SHORT`` bytes use one, because scans would take quadratic time there. Words seen lately are
remembered in a table of bounded size.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import prepare

VOCABULARY = "byte_bpe_50k.json"
SHORT = 96
#: Words that a worker remembers, in each of two generations.
REMEMBERED = 150_000
_NONE = 1 << 60
#: The pattern by which byte-level vocabularies of this kind cut text; white space by its Unicode property.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"""


def byte_names() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """Encoder and decoder of one vocabulary file (the text of a tokenizers JSON of kind BPE)."""

    def __init__(self, text: str) -> None:
        import regex

        spec = json.loads(text)
        model, names = spec["model"], byte_names()
        vocab = model["vocab"]
        self.first = [0] * 256
        for ch, b in names.items():
            self.first[b] = vocab[ch]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[a], vocab[b]] = rank, vocab[a + b]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*vocab.values(), *self.added.values()])
        self.bytes_of: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(names[ch] for ch in token)
        for token, i in self.added.items():
            self.bytes_of[i] = token.encode()
        self.words = regex.compile(PATTERN).findall
        longest = sorted(self.added, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, longest)) + ")").split if longest else lambda x: [x]
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def merge(self, word: bytes) -> list[int]:
        parts = [self.first[b] for b in word]
        if len(parts) > SHORT:
            return self._merge_long(parts)
        merges = self.merges
        ranks = [merges.get(pair, (_NONE, 0))[0] for pair in zip(parts, parts[1:], strict=False)]
        while ranks:
            least = min(ranks)
            if least == _NONE:
                break
            i = ranks.index(least)
            parts[i] = merges[parts[i], parts[i + 1]][1]
            del parts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = merges.get((parts[i], parts[i + 1]), (_NONE, 0))[0]
            if i:
                ranks[i - 1] = merges.get((parts[i - 1], parts[i]), (_NONE, 0))[0]
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        n, merges = len(parts), self.merges
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(m[0], i, parts[i], parts[i + 1]) for i in range(n - 1) if (m := merges.get((parts[i], parts[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j < 0 or parts[j] != b:
                continue
            parts[i], parts[j] = merges[a, b][1], -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (m := merges.get((parts[x], parts[y]))):
                    heapq.heappush(heap, (m[0], x, parts[x], parts[y]))
        return [p for p in parts if p >= 0]

    def _word(self, word: str) -> bytes:
        got = self.old.get(word)
        if got is None:
            got = b"".join(i.to_bytes(4, "little") for i in self.merge(word.encode()))
        if len(word) <= SHORT:
            if len(self.new) >= REMEMBERED:
                self.old, self.new = self.new, {}
            self.new[word] = got
        return got

    def encode(self, text: str) -> bytes:
        """The ids of the text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        for part in self.cut(text):
            if part in self.added:
                out.append(self.added[part].to_bytes(4, "little"))
            elif part:
                new, slow = self.new, self._word
                for word in self.words(part):
                    got = new.get(word)
                    if got is None:
                        got = slow(word)
                        new = self.new
                    out.append(got)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        import numpy as np

        name = self.bytes_of
        return b"".join([name[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


def _digest(vocabulary):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        codec = Codec(vocabulary.value)
        for batch in batches:
            rows: list[tuple] = []
            for text in batch.column("text"):
                ids = codec.encode(text.as_py() or "")
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(codec.decode(ids).encode("utf-8", "replace")).hexdigest()))
            n, a, b = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return run


def _ids(vocabulary):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        codec = Codec(vocabulary.value)
        for batch in batches:
            ids = [np.frombuffer(codec.encode(x.as_py() or ""), "<u4").astype(np.int32) for x in batch.column("text")]
            i = batch.schema.get_field_index("ids")
            yield batch.set_column(i, "ids", pa.array(ids, pa.list_(pa.int32())))

    return run


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _shared(spark: SparkSession, path: str):
    """The vocabulary for the workers: a file of fixed size, whatever the input."""
    prepare(spark)
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(spark: SparkSession, docs: DataFrame, path: str | None = None) -> DataFrame:
    """``docs`` with the token ids of ``text`` in a column ``ids`` (array of int; null text: empty).

    A column that is already called ``ids`` is replaced; all others stay as they are.
    """
    shared = _shared(spark, path or vocabulary_path())
    docs = docs.withColumn("ids", F.array().cast("array<int>"))
    return docs.mapInArrow(_ids(shared), docs.schema)


def round_trip(spark: SparkSession, docs: DataFrame, path: str | None = None) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` for every row of ``docs``.

    Null and empty texts have no tokens and the digests of the empty string. Special tokens'
    strings within a text become their ids, as the vocabulary's own library does by default. Repeated rows have a row each,
    with equal values. Texts and words of many megabytes are encoded whole; equal ranks merge from the left.
    """
    shared = _shared(spark, path or vocabulary_path())
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_digest(shared), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
