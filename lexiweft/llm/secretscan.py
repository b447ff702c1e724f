"""Secret scans: candidate strings, and a random forest that removes the false ones.

Candidates are strings with a known key prefix, values assigned to a name that speaks of secrets, private key blocks, and
other long strings that mix letters and digits. The forest sees a candidate's length, its character transitions (against
those of the words of prose it was trained on), how much of it dictionary words cover, its path (the document's source and
what stands before it on its line) and the words next to it. It is trained, once a process, from labelled findings that are
generated here from a fixed seed: keys, tokens and passwords in the ways they are written, against commit ids, digests,
identifiers, versions, paths, placeholders, encoded data and long words.

Contract: one row per input row. Null and empty texts have no candidates. Whole texts are scanned. Repeated rows repeat;
extra columns are ignored, and masking keeps them.
"""

from __future__ import annotations

import math
import random
import re
import string
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ._common import column, in_arrow, slices, table

MASK = "[SECRET]"
NAMES = "token|secret|passwd|password|pwd|api[_-]?key|apikey|access[_-]?key|auth|credential|private[_-]?key|client[_-]?secret"
#: Alternatives in order; group v is the candidate where a name comes before it. Runs are taken whole, however long. The first
#: part of a token that begins inside a run ends before the next -eyJ, so that no run is read again from each of its eyJ.
CANDIDATE = re.compile(
    rf"""(?i:\b(?P<name>[a-z0-9_.-]{{0,40}}(?:{NAMES})[a-z0-9_]{{0,20}})["']?[ \t]{{0,3}}(?:=|:|=>|:=)[ \t]{{0,3}}["']?)(?P<v>(?!-----BEGIN [A-Z ]{{0,30}}PRIVATE KEY-----)[^\s"'<>,;]{{8,}}+)"""
    r"""|(?P<key>-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----)"""
    r"""|(?P<known>\b(?:AKIA|ASIA)[A-Z0-9]{16}\b|\bgh[pousr]_[A-Za-z0-9]{36,}+\b|\bxox[abprs]-[A-Za-z0-9-]{10,}+|\bsk_(?:live|test)_[A-Za-z0-9]{16,}+\b|\bAIza[A-Za-z0-9_-]{35}\b|(?:(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}+|(?<=-)eyJ(?:[A-Za-z0-9_]|-(?!eyJ)){10,}+)\.[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{5,}+)"""
    r"""|(?P<blob>(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])[A-Za-z0-9+/_-]{20,}+={0,2}(?![A-Za-z0-9+/_=-]))"""
)
KEY_END = re.compile(r"-----END [A-Z ]{0,30}PRIVATE KEY-----")
#: What follows a header where END is missing: header fields and lines of base64, line ends being real or escaped, and a last
#: line that may be short.
KEY_BODY = re.compile(
    r"(?:(?:\s|\\[rn])*+(?:(?:Proc-Type|DEK-Info):[^\r\n\\]*+|[A-Za-z0-9+/]{24,}+={0,2}+(?![A-Za-z0-9+/_=-])))++"
    r"(?:(?:\r?\n|\\r\\n|\\n)[ \t]*+[A-Za-z0-9+/]{1,23}+={0,2}+(?=[ \t]*+(?:[\r\n\\\"']|\Z)))?+"
)
#: Some of these must be in a text that has a candidate.
HINT = re.compile(rf"[0-9]|PRIVATE KEY|(?i:{NAMES})")
DICTIONARY = "the of and to in is that for it with as was on are by this be at from or an have not they which you were his her all there been one if would when more will out about who get make can like time just know take into year good some could them see other than then now look only come over think also back after use two how our work first well way even new want because any these give day most us example test sample placeholder change your here value string number name key token secret password user admin data file path version commit build release image script style content type null none true false default dummy fake localhost der die das und ist nicht ein eine mit von zu den le la les des est une pour que dans el los las una por con para".split()
NEAR_SECRET = frozenset("token secret password passwd pwd key apikey auth authorization bearer credential credentials login export env private client access".split())
NEAR_OTHER = frozenset("commit sha sha1 sha256 md5 digest checksum hash integrity rev revision uuid guid id isbn doi version build image src href etag example sample placeholder url path file".split())


def _word(rng: random.Random) -> str:
    return "".join(rng.choice("bcdfghjklmnprstvw") * rng.choice((0, 1, 1)) + rng.choice("aeiou") + rng.choice(["", "", "n", "r", "st", "th", "nd"]) for _ in range(rng.randint(1, 5)))


@lru_cache(maxsize=1)
def _transitions() -> np.ndarray:
    """Log probabilities of one character class of prose after another, from dictionary and made-up words."""
    rng = random.Random(5)
    counts = np.ones((128, 128))
    for w in [*DICTIONARY, *(_word(rng) for _ in range(4000))]:
        for a, b in zip(w, w[1:]):
            counts[ord(a) & 127, ord(b) & 127] += 1
    return np.log(counts / counts.sum(axis=1, keepdims=True))


def _kind(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


_BY_LENGTH = sorted((w for w in DICTIONARY if len(w) >= 3), key=len, reverse=True)
_COVER = re.compile("|".join(_BY_LENGTH))


def features(value: str, name: str, before: str, after: str, source: str) -> list[float]:
    n = len(value)
    low = value.lower()
    kinds = [_kind(c) for c in value]
    share = [kinds.count(k) / n for k in range(4)]
    codes = np.frombuffer(low.encode("ascii", "replace"), np.uint8) & 127
    moves = float(_transitions()[codes[:-1], codes[1:]].mean()) if n > 1 else 0.0
    switches = sum(a != b for a, b in zip(kinds, kinds[1:])) / max(1, n - 1)
    _, c = np.unique(codes, return_counts=True)
    p = c / n
    words = set(re.findall(r"[a-z0-9]+", before[-48:].lower())) | set(re.findall(r"[a-z0-9]+", after[:24].lower()))
    hexa = all(x in "0123456789abcdef" for x in low)
    return [
        float(n), *share, moves, switches, float(-(p * np.log2(p)).sum()), sum(len(m) for m in _COVER.findall(low)) / n, float(len(c)),
        float(hexa), float(bool(name)), float(any(k in name.lower() for k in ("token", "secret", "pass", "pwd", "key", "auth", "cred"))),
        float(len(words & NEAR_SECRET)), float(len(words & NEAR_OTHER)), float("/" in value or "/" in before[-8:]), float(before.rstrip()[-1:] in "=:\"'"),
        float(bool(re.search(r"(?i)test|example|sample|mock|fixture|doc", source))), float(_longest_run(low)),
        float(value.count("-")), float(bool(re.fullmatch(r"[0-9a-f]{8}-([0-9a-f]{4}-){3}[0-9a-f]{12}", low))), float(bool(re.match(r"(?:AKIA|ASIA|gh[pousr]_|xox|sk_|AIza|eyJ)", value))),
    ]


def _longest_run(s: str) -> int:
    most = run = 0
    last = ""
    for c in s:
        run = run + 1 if c == last else 1
        most, last = max(most, run), c
    return most


def labelled_findings(n: int = 3000, seed: int = 11) -> tuple[list[list[float]], list[int]]:
    """Generated findings: features and labels (1: a secret)."""
    rng = random.Random(seed)
    alnum, hexs, b64 = string.ascii_letters + string.digits, "0123456789abcdef", string.ascii_letters + string.digits + "+/"
    pick = lambda alphabet, k: "".join(rng.choice(alphabet) for _ in range(k))
    prose = lambda: " ".join(_word(rng) for _ in range(6))
    rows, labels = [], []

    def add(value, name, before, label):
        rows.append(features(value, name, f"{prose()} {before}", f"{rng.choice(['', chr(34), chr(39)])} {prose()}", rng.choice(["src1", "web", "repo", "blog"])))
        labels.append(label)

    names = ["token", "secret", "password", "api_key", "apikey", "client_secret", "access_key", "AUTH_TOKEN", "db_password", "private_key"]
    while len(rows) < n:
        name, eq = rng.choice(names), rng.choice([" = \"", "=", ": ", "='", ": \"", " = '"])
        value = rng.choice([lambda: pick(hexs, rng.choice([32, 40, 40, 48, 64])), lambda: pick(alnum, rng.randint(16, 64)), lambda: pick(b64, rng.choice([40, 44, 64])), lambda: pick(alnum + "!@#$%^&*", rng.randint(10, 24))])()
        add(value, name, name + eq, 1)
        known = rng.choice([lambda: "AKIA" + pick(string.ascii_uppercase + string.digits, 16), lambda: "ghp_" + pick(alnum, 36), lambda: "sk_live_" + pick(alnum, 24), lambda: "AIza" + pick(alnum, 35), lambda: "xoxb-" + pick(string.digits, 11) + "-" + pick(alnum, 24), lambda: "eyJ" + pick(alnum, 30) + "." + pick(alnum, 60) + "." + pick(alnum, 43)])()
        add(known, "", rng.choice(["", "key ", "export X=", "\""]), 1)
        word = rng.choice(["Bearer ", "bearer token ", "login key "])
        add(pick(alnum, rng.randint(28, 60)), "", word, 1)
        # False ones.
        add(pick(hexs, rng.choice([32, 40, 64])), "", rng.choice(["commit ", "sha256 ", "md5 digest ", "checksum: ", "rev ", "image id ", "etag ", "integrity hash "]), 0)
        add("-".join(pick(hexs, k) for k in (8, 4, 4, 4, 12)), "", rng.choice(["uuid ", "id ", "", "guid "]), 0)
        add(rng.choice(["your_token_here", "changeme123", "example-token-value1", "xxxxxxxxxxxxxxxx", "<password1>", "placeholder_secret_1", "test_password_123", "dummy-key-000000", "********", "${API_TOKEN}", "os.environ", "None_value_default"]), name, name + eq, 0)
        add("_".join(rng.choice(DICTIONARY) for _ in range(rng.randint(3, 6))) + str(rng.randint(0, 9)), "", rng.choice(["", "file ", "see "]), 0)
        add("/".join(_word(rng) for _ in range(5)) + f"/{rng.randint(1, 99)}", "", rng.choice(["path ", "src ", "/"]), 0)
        add(_word(rng) + "-" + _word(rng) + f"-{rng.randint(1, 20)}-" + _word(rng) + _word(rng), "", "", 0)
        add(str(rng.randint(10**20, 10**30)), "", rng.choice(["number ", "", "id "]), 0)
        add(_word(rng) + _word(rng) + _word(rng), rng.choice(["token", "author", "secret"]), rng.choice(["the token: ", "secret: ", "auth = "]), 0)
        add(pick(b64, rng.randint(100, 400)), "", rng.choice(["data:image/png;base64,", "src image/", "image content "]), 0)
    return rows, labels


class Forest:
    """Classification trees on bootstrap samples, each split chosen among a random subset of features."""

    def __init__(self, trees: int = 24, depth: int = 8, seed: int = 3):
        self.trees, self.depth, self.seed, self.nodes = trees, depth, seed, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Forest:
        rng = np.random.default_rng(self.seed)
        self.nodes = []
        for _ in range(self.trees):
            rows = rng.integers(0, len(x), len(x))
            tree: list[tuple] = []
            self._grow(tree, x[rows], y[rows], self.depth, rng)
            self.nodes.append(tree)
        return self

    def _grow(self, tree: list, x: np.ndarray, y: np.ndarray, depth: int, rng) -> int:
        at = len(tree)
        tree.append((-1, 0.0, 0, 0, float(y.mean())))
        if depth == 0 or len(y) < 8 or y.min() == y.max():
            return at
        best = (math.inf, 0, 0.0)
        for f in rng.choice(x.shape[1], max(1, int(x.shape[1] ** 0.5) + 1), replace=False):
            for cut in np.unique(np.quantile(x[:, f], np.linspace(0.05, 0.95, 15))):
                left = x[:, f] <= cut
                n = int(left.sum())
                if 0 < n < len(y):
                    p, q = y[left].mean(), y[~left].mean()
                    impurity = n * p * (1 - p) + (len(y) - n) * q * (1 - q)
                    best = min(best, (impurity, int(f), float(cut)))
        if best[0] == math.inf:
            return at
        _, f, cut = best
        left = x[:, f] <= cut
        lo = self._grow(tree, x[left], y[left], depth - 1, rng)
        hi = self._grow(tree, x[~left], y[~left], depth - 1, rng)
        tree[at] = (f, cut, lo, hi, float(y.mean()))
        return at

    def score(self, row: list[float]) -> float:
        total = 0.0
        for tree in self.nodes:
            f, cut, lo, hi, p = tree[0]
            while f >= 0:
                f, cut, lo, hi, p = tree[lo if row[f] <= cut else hi]
            total += p
        return total / len(self.nodes)


@lru_cache(maxsize=2)
def trained(n: int = 3000) -> Forest:
    x, y = labelled_findings(n)
    return Forest().fit(np.array(x), np.array(y, float))


def _key_end(text: str, at: int) -> int:
    """Where the private key ends whose header ends at a place. What is read ends at the next header, so all keys take one pass."""
    stop = text.find("-----BEGIN ", at)
    stop = len(text) if stop < 0 else stop
    end = KEY_END.search(text, at, stop) or KEY_BODY.match(text, at, stop)
    return end.end() if end else at


def find(text: str | None, source: str | None, forest: Forest, least: float = 0.5) -> tuple[int, list[tuple[int, int]]]:
    """Number of candidates, and the spans (code points, end exclusive) of those that are secrets."""
    if not text or not HINT.search(text):
        return 0, []
    n, out, at = 0, [], 0
    while m := CANDIDATE.search(text, at):
        n, at = n + 1, m.end()
        if m["key"]:
            at = _key_end(text, at)
            out.append((m.start(), at))
            continue
        group = "v" if m["v"] else "known" if m["known"] else "blob"
        start, end = m.span(group)
        if forest.score(features(m[group], m["name"] or "", text[max(0, start - 64) : start], text[end : end + 32], source or "")) >= least:
            out.append((start, end))
    return n, out


def secret_findings(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", least: float = 0.5) -> DataFrame:
    """key, n_candidates, n_secrets, spans (start:end of code points, comma-joined) for each row."""
    forest = trained()

    def run(batches):
        for batch in slices(batches):
            found = [find(t, s, forest, least) for t, s in zip(column(batch, "text").to_pylist(), column(batch, "source").to_pylist())]
            yield pa.RecordBatch.from_arrays([column(batch, "key"), pa.array([n for n, _ in found], pa.int64()), pa.array([len(s) for _, s in found], pa.int64()), pa.array([",".join(f"{a}:{b}" for a, b in s) for _, s in found], pa.string())], ["key", "n_candidates", "n_secrets", "spans"])

    picked = docs.select(docs[key].cast("long").alias("key"), docs[text].alias("text"), docs[source].cast("string").alias("source"))
    return in_arrow(picked, run, "key long, n_candidates long, n_secrets long, spans string").withColumnRenamed("key", key)


def mask_secrets(docs: DataFrame, text: str = "text", source: str = "source", least: float = 0.5, mask: str = MASK) -> DataFrame:
    """docs with each secret replaced by the mask, and n_chars, where there is such a column, counted again."""
    forest, names = trained(), docs.columns

    def run(batches):
        at, by = names.index(text), names.index(source)
        for batch in slices(batches):
            out = []
            for t, s in zip(batch.column(at).to_pylist(), batch.column(by).to_pylist()):
                for a, b in reversed(find(t, s, forest, least)[1]):
                    t = t[:a] + mask + t[b:]
                out.append(t)
            arrays = list(batch.columns)
            arrays[at] = pa.array(out, batch.schema.field(at).type)
            if "n_chars" in names:
                k = names.index("n_chars")
                arrays[k] = pa.array([old if new == was else len(new) for old, new, was in zip(arrays[k].to_pylist(), out, batch.column(at).to_pylist())], batch.schema.field(k).type)
            yield pa.RecordBatch.from_arrays(arrays, batch.schema.names)

    return in_arrow(docs, run, docs.schema)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_findings(table(spark, sf_dir, "documents"))


QUERIES = {"op5_secret_scan": op5_secret_scan}
ORACLES: dict[str, str] = {}
