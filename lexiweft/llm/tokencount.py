"""Token counts by a linear longest-match automaton.

The vocabulary's trie gets failure links: where no edge goes on, the longest tokens that are certain by then are popped
and the walk goes on from the node of what is left. How many tokens a failure link pops is worked out beforehand, so
counting a word's greedy longest-match pieces takes one pass over its symbols and builds no pieces.

A word's symbols are its bytes, the last one marked as the end of the word, as the vocabulary file has them; every single
symbol is a token, so nothing is unknown.

Contract: one row per input row. Null and empty texts count 0. Repeated rows repeat; extra columns are ignored.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import _pretokens as P
from ._common import column, gathered, in_arrow, slices, table

END = "</w>"
#: Bytes of text whose words are encoded together.
BATCH_WORDS = 7_000_000
#: Added to a character's code to mark it as the last of a word.
LAST = 0x1000


def symbols(word: str) -> str:
    return word[:-1] + chr(ord(word[-1]) + LAST)


class LongestMatch:
    def __init__(self, tokens: list[str]):
        """tokens: strings of symbols. All single symbols in use must be among them."""
        edges: list[dict[str, int]] = [{}]
        ends = [False]
        for t in tokens:
            at = 0
            for c in t:
                at = edges[at].setdefault(c, len(edges))
                if at == len(ends):
                    edges.append({})
                    ends.append(False)
            ends[at] = True
        self.edges = edges
        self.link = [0] * len(edges)  # where the walk goes on after a failure
        self.pops = [0] * len(edges)  # how many tokens that failure settles
        level = [(0, c, v) for c, v in edges[0].items()]
        while level:  # breadth first, so shorter strings are done
            after = []
            for parent, c, v in level:
                if ends[v]:
                    self.link[v], self.pops[v] = 0, 1
                else:
                    at, popped = self.link[parent], self.pops[parent]
                    while c not in edges[at]:
                        if at == 0:
                            raise ValueError(f"the symbol {c!r} is no token")
                        popped += self.pops[at]
                        at = self.link[at]
                    self.link[v], self.pops[v] = edges[at][c], popped
                after += [(v, d, w) for d, w in edges[v].items()]
            level = after

    def count(self, word: str) -> int:
        """How many pieces greedy longest match cuts the symbols into."""
        edges, link, pops = self.edges, self.link, self.pops
        at = n = 0
        for c in word:
            while (to := edges[at].get(c)) is None:
                if at == 0:
                    raise ValueError(f"the symbol {c!r} is no token")
                n += pops[at]
                at = link[at]
            at = to
        while at:
            n += pops[at]
            at = link[at]
        return n


@lru_cache(maxsize=2)
def _counter(path: str) -> tuple[LongestMatch, P.Encoded]:
    vocab = json.load(open(path, encoding="utf-8"))["model"]["vocab"]
    match = LongestMatch([symbols(t[: -len(END)]) if t.endswith(END) else t for t in vocab])
    pre = P.pretokens(path)

    def encode(words: list[str]) -> list[tuple[int, int]]:
        return [(1, 1 if w in pre.specials else match.count(symbols(w))) if w else (0, 0) for w in words]

    return match, P.Encoded(pre, encode)


def count_texts(texts: pa.Array, path: str) -> list[np.ndarray]:
    """Of each text: pre-tokens, tokens."""
    _, cache = _counter(path)
    offsets, at, values = cache.of(texts)
    return [np.diff(np.r_[0, np.cumsum(np.array([v[k] for v in values], np.int64)[at])][offsets]) for k in (0, 1)]


def token_counts(docs: DataFrame, path: str | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_pretokens, n_tokens for each row."""
    file = P.vocabulary_path(path)

    def run(batches):
        for batch in slices(gathered(batches, BATCH_WORDS), 2 * BATCH_WORDS, 8_000):
            yield pa.RecordBatch.from_arrays([column(batch, "key"), *map(pa.array, count_texts(column(batch, "text"), file))], ["key", "n_pretokens", "n_tokens"])

    source = docs.select(docs[key].cast("long").alias("key"), docs[text].alias("text"))
    return in_arrow(source, run, "key long, n_pretokens long, n_tokens long").withColumnRenamed("key", key)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


QUERIES = {"op9_token_counts": op9_token_counts}
ORACLES: dict[str, str] = {}
