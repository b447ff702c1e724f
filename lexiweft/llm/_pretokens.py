"""Pre-tokens of the word-BPE vocabulary file, and a cache from words to what they encode to.

Texts of Latin letters and common signs, which normalization only lower-cases, are cut into words by Arrow, a batch at once.
Other texts go by the library's normalizer and pre-tokenizer, a white-space chunk at a time; pre-tokens never span white
space. The distinct words of a batch are then encoded once.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer

DEFAULT_VOCABULARY = "word_bpe_49k.json"

#: Fixed value: the pre-token pattern of the vocabulary file.
PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: The same pre-tokens but for letters, which are what lies between them, with white space as the normalizer has it.
BETWEEN = r"('s|'t|'re|'ve|'m|'ll|'d|\p{N}|[^\x09-\x0d\x20\x{85}\x{a0}\p{L}\p{N}]+)"
#: Texts with such characters go by the library: they compose, change in other ways when lower-cased, or are white space to
#: Arrow but not to the normalizer.
OTHER = r"[\x1c-\x1f\x{130}\x{250}-\x{200f}\x{2028}-\x{202f}\x{205f}-\x{20ab}\x{20ad}-\x{10ffff}]"
#: Before words that are in the byte alphabet already.
READY = " "
CHUNK = regex.compile(r"\S+")


def vocabulary_path(path: str | None = None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(DEFAULT_VOCABULARY)


def byte_alphabet() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class PreTokens:
    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        specials = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.specials = specials
        self.cut = regex.compile("|".join(regex.escape(s) for s in sorted(specials, key=len, reverse=True))) if specials else None
        self.other = "|".join([OTHER, *map(regex.escape, specials)])
        self.chunks = Recent(10_000)
        self.bytes = str.maketrans({chr(b): c for b, c in enumerate(byte_alphabet())})

    def split(self, texts: pa.Array) -> pa.ListArray:
        """The words of each text. A text without any has one that is empty, or none."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        odd = pc.match_substring_regex(texts, self.other)
        spaced = pc.replace_substring_regex(pc.utf8_lower(texts), BETWEEN, r" \1 ")
        lists = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(spaced))
        if not pc.any(odd).as_py():
            return lists
        own = pa.array([[READY + w for ws in self.chunks.of(CHUNK.findall(t), self._ready) for w in ws] for t in texts.filter(odd).to_pylist()], pa.list_(pa.string()))
        odd = odd.to_numpy(zero_copy_only=False)
        at = np.arange(len(texts))
        at[odd] = len(texts) + np.arange(int(odd.sum()))
        return pa.concat_arrays([lists, own]).take(pa.array(at))

    def _ready(self, chunks: list[str]) -> list[list[str]]:
        """Pre-tokens of each chunk in the byte alphabet; a special token's own string stands for itself."""
        return [[w for part in self._parts(c) for w in part] for c in chunks]

    def _parts(self, chunk: str):
        at = 0
        for m in self.cut.finditer(chunk) if self.cut and "<" in chunk else ():
            yield self._plain(chunk[at : m.start()])
            yield [m[0]]
            at = m.end()
        yield self._plain(chunk[at:])

    def _plain(self, chunk: str) -> list[str]:
        return [w for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(chunk))] if chunk else []

    def in_bytes(self, word: str) -> str:
        if word[:1] == READY:
            return word[1:]
        return word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self.bytes)


class Recent:
    """A cache of two generations: what was asked for lately stays when the older one goes. Holds at most 2 * most values, and those of one call."""

    def __init__(self, most: int):
        self.most, self.young, self.old = most, {}, {}

    def of(self, keys: list[str], make: Callable[[list[str]], list]) -> list:
        """The values of the keys; make gives those of new ones."""
        if len(self.young) > self.most:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        out = [young.get(k) for k in keys]
        gone = [at for at, v in enumerate(out) if v is None]
        if old:
            for at in gone:
                v = old.get(keys[at])
                if v is not None:
                    out[at] = young[keys[at]] = v
            gone = [at for at in gone if out[at] is None]
        for at, v in zip(gone, make([keys[at] for at in gone])):
            out[at] = young[keys[at]] = v
        return out


class Encoded:
    """What each word encodes to. encode_words gets distinct words in the byte alphabet."""

    def __init__(self, pre: PreTokens, encode_words: Callable[[list[str]], list], most: int = 60_000):
        self.pre, self.encode_words, self.words = pre, encode_words, Recent(most)

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list]:
        """For n texts, n + 1 offsets into the places of their words in order, and the values at those places."""
        lists = self.pre.split(texts)
        flat = lists.flatten().dictionary_encode()
        values = self.words.of(flat.dictionary.to_pylist(), lambda words: self.encode_words([self.pre.in_bytes(w) for w in words]))
        offsets = lists.offsets.to_numpy().astype(np.int64)
        return offsets - offsets[0], flat.indices.to_numpy(zero_copy_only=False), values


@lru_cache(maxsize=2)
def pretokens(path: str) -> PreTokens:
    return PreTokens(path)
