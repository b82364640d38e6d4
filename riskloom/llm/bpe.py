"""Byte-level BPE with the tokenizers library over Arrow batches: ids, offsets and exact decoding.

The model is built from a rank file: bytes become the characters of the byte table, and every split of a token into two
earlier tokens is one of its merges, so that merges by rank agree with the rank file. A piece that is itself a token is taken whole.
A text without white space after a space splits at its spaces into chunks that encode alike wherever they stand; distinct chunks
are encoded once per worker (a cache of bounded size). Other texts are encoded as they are. Both ways give the same ids.

Null text: empty, no tokens. Very long texts are encoded whole. Rows with equal ids or equal texts each get their own result; of equal
pairs the left one merges first. An empty table gives an empty result. Columns of docs called as an added column (ids, spans where asked
for; data and text of decode) are replaced; all others stay, whatever their names.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import with_columns

CACHE = 400_000
_models: dict[tuple[str, str], Bpe] = {}
_UNSAFE = re.compile(r" \s")


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself where it is printable and not a space, else one from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Bpe:
    def __init__(self, path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        char = byte_characters()
        name = {t: "".join(char[b] for b in t) for t in ranks}
        merges = [
            (name[t[:i]], name[t[i:]])
            for t in sorted(ranks, key=ranks.__getitem__)
            for i in range(1, len(t))
            if ranks.get(t[:i], 1 << 60) < ranks[t] and ranks.get(t[i:], 1 << 60) < ranks[t]
        ]
        self.model = Tokenizer(models.BPE(vocab={name[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True, cache_capacity=0))
        self.model.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        back = {c: b for b, c in enumerate(char)}
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            self.bytes_of[r] = bytes(back[c] for c in name[t])  # the byte table, reversed
        self.decimal = [str(i) for i in range(len(self.bytes_of))]
        self.first: dict[str, list[int]] = {}
        self.later: dict[str, list[int]] = {}

    def _fill(self, cache: dict, keys: set[str], lead: str) -> None:
        new = [k for k in keys if k not in cache]
        for at in range(0, len(new), 1000):
            part = new[at : at + 1000]
            for k, e in zip(part, self.model.encode_batch_fast([lead + k for k in part], add_special_tokens=False), strict=True):
                cache[k] = e.ids

    def encode(self, texts: list[str]) -> list[list[int]]:
        out: list[list[int]] = []
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) < 1 << 21):
                size += len(texts[end])
                end += 1
            for cache in (self.first, self.later):
                if len(cache) > CACHE:
                    cache.clear()
            chunks = [None if _UNSAFE.search(t) else t.split(" ") for t in texts[at:end]]
            self._fill(self.first, {c[0] for c in chunks if c}, "")
            self._fill(self.later, set(chain.from_iterable(c[1:] for c in chunks if c)), " ")
            get = self.later.__getitem__
            for t, c in zip(texts[at:end], chunks, strict=True):
                out.append(self.model.encode(t, add_special_tokens=False).ids if c is None else [*self.first[c[0]], *chain.from_iterable(map(get, c[1:]))])
            at = end
        return out

    def decode(self, ids) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids])

    def offsets(self, ids) -> list[tuple[int, int]]:
        """Character span of each token; a character split over tokens belongs to each of them."""
        out, at = [], 0
        data = self.decode(ids)
        starts = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)  # characters begun up to each byte
        for i in ids:
            end = at + len(self.bytes_of[i])
            out.append((int(starts[at]) - 1, int(starts[end - 1])))
            at = end
        return out


def load(path: str, pattern: str) -> Bpe:
    if (path, pattern) not in _models:
        _models[path, pattern] = Bpe(path, pattern)
    return _models[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", offsets: bool = False) -> DataFrame:
    """docs with `ids`, and `spans` of the tokens in characters if asked for."""

    def of(column):
        bpe = load(path, pattern)
        ids = bpe.encode([x.as_py() or "" for x in column])
        out = [pa.array(ids, pa.list_(pa.int32()))]
        if offsets:
            out.append(pa.array([[{"start": s, "end": e} for s, e in bpe.offsets(x)] for x in ids], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))))
        return out

    return with_columns(docs, text, {"ids": "array<int>"} | ({"spans": "array<struct<start:int,end:int>>"} if offsets else {}), of)


def decode(tokens: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """tokens with `data` (the bytes) and `text`; bytes that are no character, as where ids end inside one, become U+FFFD in text only.
    Null ids are none."""

    def of(column):
        bpe = load(path, pattern)
        data = [bpe.decode(x.as_py() or ()) for x in column]
        return [pa.array(data, pa.binary()), pa.array([codecs.decode(x, "utf-8", "replace") for x in data], pa.string())]

    return with_columns(tokens, ids, {"data": "binary", "text": "string"}, of)


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text, encoded and decoded in one pass."""

    def run(batches):
        bpe = load(path, pattern)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for b in batches:
            n, names, back = [], [], []
            for at in range(0, b.num_rows, 256):
                for ids in bpe.encode([x.as_py() or "" for x in b.column("text").slice(at, 256)]):
                    n.append(len(ids))
                    names.append(sha(",".join([bpe.decimal[i] for i in ids]).encode()))
                    back.append(sha(bpe.decode(ids)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(names, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
