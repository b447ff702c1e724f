"""BPE encoding and decoding by a prefix-sharing trie.

Distinct words are laid out as a trie (sorted, so that neighbours share their longest common prefix) and walked depth
first. The state of a prefix is the last token of its encoding: the only token that ends there and goes with the state
of the prefix before it. A prefix shared by many words gets its state once; a word's tokens follow by
walking the states back from its end.

Contract: one row per input row, whatever its columns. Null and empty texts have no tokens; the digests are then those
of the empty string. Repeated rows repeat. Extra columns are ignored. Long words cost time linear in their length.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _pretokens as P
from ._common import column, gathered, in_arrow, slices, table

END = "</w>"
#: Bytes of text whose words are encoded together.
BATCH_WORDS = 7_000_000
#: Tokens up to this long are looked up together, by the last characters of a prefix.
NEAR = 6


class TrieBpe:
    """Word encoder over a vocabulary of merges with an end-of-word mark."""

    def __init__(self, path: str):
        model = json.load(open(path, encoding="utf-8"))["model"]
        vocab: dict[str, int] = model["vocab"]
        self.name = {i: t for t, i in vocab.items()}
        self.inner = {t: i for t, i in vocab.items() if not t.endswith(END)}  # tokens inside a word
        self.final = {t[: -len(END)]: i for t, i in vocab.items() if t.endswith(END)}  # tokens that end one
        self.rank: dict[tuple[int, int], int] = {}  # pair -> merged token; ids are in the order of merges
        self.parts: dict[int, tuple[int, int]] = {}
        last = -1
        for pair in model["merges"]:
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            merged = vocab[a + b]
            if merged <= last:
                raise ValueError("the vocabulary's ids must be in the order of its merges")
            last = merged
            self.rank[vocab[a], vocab[b]] = merged
            self.parts[merged] = (vocab[a], vocab[b])
        self.sound: dict[int, bool] = {}
        self.goes: dict[int, bool] = {}
        self.inner_ends, self.final_ends = {}, {}  # by the last characters of a prefix: the tokens that may end it
        self.inner_long, self.final_long = self._long(self.inner), self._long(self.final)

    @staticmethod
    def _long(tokens: dict[str, int]) -> dict[str, tuple[int, ...]]:
        """By the last NEAR characters of a longer token: the lengths of such tokens, longest first."""
        by: dict[str, set[int]] = {}
        for t in tokens:
            if len(t) > NEAR:
                by.setdefault(t[-NEAR:], set()).add(len(t))
        return {k: tuple(sorted(v, reverse=True)) for k, v in by.items()}

    def _is_sound(self, token: int) -> bool:
        """Whether the token's own string encodes to it: the merge that makes it comes before any across its middle."""
        known = self.sound.get(token)
        if known is None:
            a, b = self.parts.get(token, (token, token))
            known = self.sound[token] = token not in self.parts or self._is_sound(a) and self._is_sound(b) and self._apart(a, b, token)
        return known

    def _apart(self, a: int, b: int, before: int = 1 << 60) -> bool:
        """Whether no merge that comes before `before` joins the end of a with the start of b while both are put together.

        Undoes the later of the two tokens' merges again and again, so what meets at the border is looked at in the
        states it has as merges are applied in order. Ids are in the order of merges.
        """
        rank, parts = self.rank, self.parts
        limit = before
        while True:
            joined = rank.get((a, b))
            if joined is not None and joined < limit:
                return False
            if a > b and a in parts:
                limit, a = a, parts[a][1]
            elif b in parts:
                limit, b = b + 1, parts[b][0]
            elif a in parts:
                limit, a = a, parts[a][1]
            else:
                return True

    def _ends(self, near: str, tokens: dict[str, int], ends: dict, long: dict) -> tuple:
        """(lengths of longer tokens that may end a prefix that ends with `near`, the sound tokens that end `near` as (length, token)); longest first."""
        found = ((n, tokens.get(near[-n:])) for n in range(len(near), 0, -1))
        if len(ends) > 150_000:
            ends.clear()
        ends[near] = entry = long.get(near, ()), tuple((n, t) for n, t in found if t is not None and self._is_sound(t))
        return entry

    def _last(self, word: str, end: int, last: list, tokens: dict[str, int], ends: dict, long: dict) -> tuple[int, int]:
        """The last token of the encoding of word[:end], and where it starts. last[d]: the last token of word[:d]."""
        near = word[end - NEAR : end] if end > NEAR else word[:end]
        longer, found = ends.get(near) or self._ends(near, tokens, ends, long)
        for n in longer:
            if n <= end and (token := tokens.get(word[end - n : end])) is not None and self._is_sound(token):
                start = end - n
                if start == 0 or self._follows(last[start], token):
                    return token, start
        goes = self.goes
        for n, token in found:
            start = end - n
            if start == 0:
                return token, 0
            a = last[start]
            known = goes.get(a << 20 | token)
            if known is None:
                known = self._follows(a, token)
            if known:
                return token, start
        raise ValueError(f"no token ends {word[:end]!r}")

    def _follows(self, a: int, b: int) -> bool:
        """Whether the strings of a and b, put together, encode to a then b."""
        pair = a << 20 | b
        known = self.goes.get(pair)
        if known is None:
            if len(self.goes) > 300_000:
                self.goes.clear()
            known = self.goes[pair] = self._apart(a, b)
        return known

    def encode(self, words: list[str]) -> dict[str, list[int]]:
        """The ids of each distinct word."""
        out: dict[str, list[int]] = {}
        last, begin = [-1], [0]  # by length of the current path's prefix: its last token, and where that starts
        before, step, inner, ends, long = "", self._last, self.inner, self.inner_ends, self.inner_long
        for word in sorted(words):
            size = len(word)
            shared, most = 0, min(len(before), size - 1, len(last) - 1)
            if before[:most] == word[:most]:
                shared = most
            else:
                while before[shared] == word[shared]:
                    shared += 1
            del last[shared + 1 :], begin[shared + 1 :]
            for d in range(shared + 1, size):
                token, at = step(word, d, last, inner, ends, long)
                last.append(token)
                begin.append(at)
            token, at = step(word, size, last, self.final, self.final_ends, self.final_long)
            ids = [token]
            while at:
                ids.append(last[at])
                at = begin[at]
            ids.reverse()
            out[word] = ids
            before = word
        return out


@lru_cache(maxsize=2)
def _encoder(path: str) -> tuple[TrieBpe, P.Encoded]:
    bpe, pre = TrieBpe(path), P.pretokens(path)
    shown = {i: str(i) for i in bpe.name}

    def encode(words: list[str]) -> list[tuple]:
        special = {w: (1, str(pre.specials[w]), w) for w in words if w in pre.specials}
        plain = bpe.encode([w for w in words if w and w not in special] if special else [w for w in words if w])
        plain[""] = []
        return [special.get(w) or (len(ids := plain[w]), " ".join([shown[i] for i in ids]), " ".join([bpe.name[i] for i in ids])) for w in words]

    return bpe, P.Encoded(pre, encode)


def encode_texts(texts: pa.Array, path: str) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """For each text: number of tokens, ids joined by spaces, decoded text."""
    _, cache = _encoder(path)
    offsets, at, values = cache.of(texts)
    count = np.array([v[0] for v in values], np.int64)
    full = count[at] > 0
    at, offsets = at[full], np.r_[0, np.cumsum(full)][offsets]
    n = np.diff(np.r_[0, np.cumsum(count[at])][offsets])
    places = pa.array(at)
    ids, decoded = (pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array([v[k] for v in values], pa.string()).take(places)), " ") for k in (1, 2))
    return n, ids, decoded


def bpe_digests(docs: DataFrame, path: str | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_tokens, ids_sha256, decoded_sha256: each text encoded by the vocabulary file at path, and decoded again."""
    file = P.vocabulary_path(path)

    def run(batches):
        for batch in slices(gathered(batches, BATCH_WORDS), 2 * BATCH_WORDS, 8_000):
            n, *both = encode_texts(column(batch, "text"), file)
            digests = [pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in of.cast(pa.binary())], pa.string()) for of in both]
            yield pa.RecordBatch.from_arrays([column(batch, "key"), pa.array(n), *digests], ["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    source = docs.select(docs[key].cast("long").alias("key"), docs[text].alias("text"))
    return in_arrow(source, run, "key long, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("key", key)


def bpe_ids(docs: DataFrame, path: str | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, ids array<int>, decoded: the encodings themselves."""
    file = P.vocabulary_path(path)

    def run(batches):
        for batch in slices(gathered(batches, BATCH_WORDS), 2 * BATCH_WORDS, 8_000):
            _, ids, decoded = encode_texts(column(batch, "text"), file)
            yield pa.RecordBatch.from_arrays([column(batch, "key"), pa.array([[int(x) for x in i.split()] for i in ids.to_pylist()], pa.list_(pa.int32())), decoded], ["key", "ids", "decoded"])

    source = docs.select(docs[key].cast("long").alias("key"), docs[text].alias("text"))
    return in_arrow(source, run, "key long, ids array<int>, decoded string").withColumnRenamed("key", key)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"))


QUERIES = {"op7_bpe": op7_bpe}
ORACLES: dict[str, str] = {}
