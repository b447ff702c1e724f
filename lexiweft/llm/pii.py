"""Personal data: base patterns, and a character BiLSTM with CRF transitions that adds what the patterns miss.

The base finds emails, IPv4 addresses, card numbers and phone numbers as written plainly. The model reads overlapping
windows of character classes, in both directions, and gives each character scores for the beginning and inside of each
kind. Where windows overlap, their scores are blended, with most weight to a window's middle; one Viterbi path over the
whole stretch of windows then settles all of them at once, so no span is cut or counted twice at a window's edge. A span
of the model counts if it overlaps no base span and holds what its kind must hold (digits, a valid check sum, an at sign).

Every kind needs a digit, an @ or a spelled-out " at ", so a window without any is all outside by that last rule, and is not
read.

The model is trained in numpy, once a process, from labelled spans generated from a fixed seed: the four kinds in plain and
disguised spellings, among prose, dates, versions, digests, amounts and other numbers.

Contract: one row per input row. Null and empty texts have no spans. Whole texts are read, in linear time. Offsets are code
points, ends exclusive. Repeated rows repeat; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ._common import column, in_arrow, slices, table

KINDS = ["email", "ip", "card", "phone"]
# Runs are taken whole, without trying again from inside one: what fails from its start fails from every later place.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]++(?P<at>@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)?")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TRIGGER = re.compile(r"[0-9@]| at ")
WINDOW, STRIDE = 96, 48
#: Characters of a training window; the network is recurrent, so it need not be WINDOW.
TRAIN_CHARS = 64
LABELS = 1 + 2 * len(KINDS)  # outside; beginning and inside of each kind


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """For each kind, its spans in order."""
    emails = [m.span() for m in EMAIL.finditer(text) if m["at"]] if "@" in text else []
    ips = [m.span() for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    cards = [m.span() for m in CARD.finditer(text) if m.end() - m.start() >= 16 and 16 <= len(d := digits_of(m[0])) <= 19 and luhn(d)]
    phones = [m.span() for m in PHONE.finditer(text) if 8 <= len(digits_of(m[0])) <= 15] if "+" in text else []
    return [emails, ips, cards, phones]


# Character classes: each ASCII sign is its own, digits and letters are few.
_CLASS = np.zeros(128, np.int8)
_next = 8
for _c in range(128):
    if 48 <= _c < 58:
        _CLASS[_c] = 2
    elif 97 <= _c < 123:
        _CLASS[_c] = 3
    elif 65 <= _c < 91:
        _CLASS[_c] = 4
    elif _c in (9, 10, 11, 12, 13):
        _CLASS[_c] = 6
    elif _c >= 32 and _c < 127:
        _CLASS[_c] = _next
        _next += 1
for _i, _c in enumerate("atdo"):  # letters of "at" and "dot"
    _CLASS[ord(_c)] = _next + _i
PAD, N_CLASSES = 0, _next + 4
_CLASS[:9] = 7


def classes_of(text: str) -> np.ndarray:
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(code < 128, _CLASS[np.minimum(code, 127)], 5)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class BiLstmCrf:
    def __init__(self, embed: int = 12, hidden: int = 20, seed: int = 5):
        rng = np.random.default_rng(seed)
        f = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.h = hidden
        self.p = {"E": f(N_CLASSES, embed) * 2, "O": f(2 * hidden, LABELS), "c": np.zeros(LABELS, np.float32), "T": np.zeros((LABELS, LABELS), np.float32)}
        for d in "fb":
            self.p |= {f"W{d}": f(embed, 4 * hidden), f"U{d}": f(hidden, 4 * hidden), f"B{d}": np.zeros(4 * hidden, np.float32)}
            self.p[f"B{d}"][hidden : 2 * hidden] = 1
        # The inside of a kind follows only its beginning or inside; it cannot come first.
        self.wall = np.zeros((LABELS, LABELS), np.float32)
        for k in range(len(KINDS)):
            self.wall[:, 2 + 2 * k] = -1e4
            self.wall[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = 0
        self.first = np.where(np.arange(LABELS) % 2 == 0, -1e4, 0).astype(np.float32)
        self.first[0] = 0

    def _run(self, x: np.ndarray, d: str, keep: bool):
        """x: batch x time classes, already in reading order. The hidden states, and what the gradient needs."""
        n, t = x.shape
        h = self.h
        table = self.p["E"] @ self.p[f"W{d}"] + self.p[f"B{d}"]
        hs, state, cell = np.zeros((t, n, h), np.float32), np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
        kept = []
        for k in range(t):
            z = table[x[:, k]] + state @ self.p[f"U{d}"]
            gates = _sigmoid(z[:, : 3 * h])
            i, f, o = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :]
            g = np.tanh(z[:, 3 * h :])
            before, was = cell, state
            cell = f * cell + i * g
            tc = np.tanh(cell)
            state = o * tc
            hs[k] = state
            if keep:
                kept.append((i, f, o, g, before, was, tc))
        return hs, kept

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """batch x time x labels."""
        forward, _ = self._run(x, "f", False)
        backward, _ = self._run(x[:, ::-1], "b", False)
        h = np.concatenate([forward, backward[::-1]], axis=2)
        return (h @ self.p["O"] + self.p["c"]).transpose(1, 0, 2)

    def _step(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean negative log likelihood."""
        n, t = x.shape
        forward, kf = self._run(x, "f", True)
        backward, kb = self._run(x[:, ::-1], "b", True)
        h = np.concatenate([forward, backward[::-1]], axis=2)
        e = h @ self.p["O"] + self.p["c"]  # time x batch x labels
        trans = self.p["T"] + self.wall
        alpha = np.zeros_like(e)
        alpha[0] = e[0] + self.first
        exp_trans = np.exp(trans)
        for k in range(1, t):
            top = alpha[k - 1].max(axis=1, keepdims=True)
            alpha[k] = np.log(np.exp(alpha[k - 1] - top) @ exp_trans + 1e-30) + top + e[k]
        beta = np.zeros_like(e)
        for k in range(t - 2, -1, -1):
            b = e[k + 1] + beta[k + 1]
            top = b.max(axis=1, keepdims=True)
            beta[k] = np.log(np.exp(b - top) @ exp_trans.T + 1e-30) + top
        top = alpha[-1].max(axis=1)
        z = np.log(np.exp(alpha[-1] - top[:, None]).sum(axis=1)) + top
        post = np.exp(np.minimum(alpha + beta - z[None, :, None], 0))
        d_e = post.copy()
        np.put_along_axis(d_e, y.T[:, :, None], np.take_along_axis(d_e, y.T[:, :, None], 2) - 1, 2)
        d_trans = np.zeros_like(trans)
        for k in range(1, t):
            both = alpha[k - 1][:, :, None] + trans[None] + (e[k] + beta[k])[:, None, :] - z[:, None, None]
            d_trans += np.exp(np.minimum(both, 0)).sum(axis=0)
            np.add.at(d_trans, (y[:, k - 1], y[:, k]), -1)
        d_e, d_trans = (d_e / n).astype(np.float32), (d_trans / n).astype(np.float32)
        grads = {k: np.zeros_like(v) for k, v in self.p.items()}
        grads["T"] = np.where(self.wall < 0, 0, d_trans)
        grads["O"] = h.reshape(-1, 2 * self.h).T @ d_e.reshape(-1, LABELS)
        grads["c"] = d_e.sum(axis=(0, 1))
        d_h = d_e @ self.p["O"].T
        for d, kept, xs, dh in (("f", kf, x, d_h[:, :, : self.h]), ("b", kb, x[:, ::-1], d_h[::-1, :, self.h :])):
            self._back(d, kept, xs, dh, grads)
        return grads

    def _back(self, d: str, kept: list, x: np.ndarray, d_h: np.ndarray, grads: dict) -> None:
        n, t = x.shape
        h = self.h
        u_t = self.p[f"U{d}"].T
        d_state, d_cell = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
        d_table = np.zeros((N_CLASSES, 4 * h), np.float32)
        for k in range(t - 1, -1, -1):
            i, f, o, g, before, was, tc = kept[k]
            ds = d_h[k] + d_state
            dc = d_cell + ds * o * (1 - tc * tc)
            dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), ds * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1)
            d_cell = dc * f
            d_state = dz @ u_t
            grads[f"U{d}"] += was.T @ dz
            np.add.at(d_table, x[:, k], dz)
        grads[f"W{d}"] += self.p["E"].T @ d_table
        grads[f"B{d}"] += d_table.sum(axis=0)
        grads["E"] += d_table @ self.p[f"W{d}"].T

    def fit(self, x: np.ndarray, y: np.ndarray, rounds: int = 12, batch: int = 64, rate: float = 0.025) -> BiLstmCrf:
        rng = np.random.default_rng(1)
        m, v, t = {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}, 0
        steps = rounds * -(-len(x) // batch)
        for _ in range(rounds):
            order = rng.permutation(len(x))
            for at in range(0, len(x), batch):
                rows = order[at : at + batch]
                grads = self._step(x[rows], y[rows])
                norm = float(np.sqrt(sum((g**2).sum() for g in grads.values())))
                t += 1
                lr = rate * min(1, 1.2 - t / steps)
                for k, g in grads.items():
                    g = g * min(1, 5 / (norm + 1e-9))
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.99 * v[k] + 0.01 * g * g
                    self.p[k] = (self.p[k] - lr * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-6)).astype(np.float32)
        return self

    def paths(self, stretches: list[np.ndarray]) -> list[np.ndarray]:
        """The best labels of each stretch of emissions (time x labels); stretches of like length go together."""
        out: list = [None] * len(stretches)
        order = sorted(range(len(stretches)), key=lambda k: len(stretches[k]))
        trans = self.p["T"] + self.wall
        at = 0
        while at < len(order):
            longest = len(stretches[order[at]])
            end = at
            while end < len(order) and end - at < 512 and len(stretches[order[end]]) <= max(longest * 1.3, 128):
                end += 1
            group = order[at:end]
            size = [len(stretches[k]) for k in group]
            t = max(size)
            e = np.zeros((len(group), t, LABELS), np.float32)
            for r, k in enumerate(group):
                e[r, : size[r]] = stretches[k]
                e[r, size[r] :, 1:] = -1e4  # after its end: outside
            score = e[:, 0] + self.first
            back = np.zeros((t, len(group), LABELS), np.int8)
            for k in range(1, t):
                s = score[:, :, None] + trans[None]
                back[k] = s.argmax(axis=1)
                score = s.max(axis=1) + e[:, k]
            label = score.argmax(axis=1)
            path = np.zeros((len(group), t), np.int8)
            for k in range(t - 1, -1, -1):
                path[:, k] = label
                label = back[k][np.arange(len(group)), label]
            for r, k in enumerate(group):
                out[k] = path[r, : size[r]]
            at = end
        return out


def labelled_windows(n: int = 2400, seed: int = 23) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Generated texts of TRAIN_CHARS characters at most, with spans (kind, start, end)."""
    rng = random.Random(seed)
    syllables = "the an er ing on re ti or ed nd ha ou ent ion le que au sch ein ung lich cion ado ar bo ta mi".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    dig = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    host = lambda: ".".join([*(word() for _ in range(rng.randint(1, 2))), rng.choice(["com", "org", "net", "de", "example.com"])])

    def card() -> str:
        n = rng.choice([13, 14, 15, 16, 16, 16, 16, 19])
        d = rng.choice("3456") + dig(n - 2)
        d += next(c for c in "0123456789" if luhn(d + c))
        sep = rng.choice(["", "", " ", "-", ".", "  ", "/"])
        return sep.join(d[k : k + 4] for k in range(0, n, 4))

    def email() -> str:
        local = rng.choice([word(), word() + "." + word(), word() + dig(2), word() + "_" + word(), word() + "." + dig(2)])
        return rng.choice([f"{local}@{host()}", f"{local}@{host()}", f"{local} @ {host()}", f"{local}[@]{host()}", f"{local}(@){host()}", f"{local}@{host().replace('.', ' . ')}", f"{local}@{host().replace('.', '[.]')}", local + dig(2) + " at " + host().replace(".", " dot "), *(f"{local} at {h.replace('.', ' dot ')}" for h in (host(), host(), host()))])

    def ip() -> str:
        sep = rng.choice([".", ".", ".", "[.]", " . ", "(.)", ","])
        return sep.join(str(rng.randint(0, 255)) for _ in range(4))

    def phone() -> str:
        a, b, c = dig(3), dig(3), dig(4)
        return rng.choice([f"+{rng.randint(1, 99)} ({a}) {b}-{c}", f"+{rng.randint(1, 99)} {a} {b} {c}", f"+{dig(11)}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"00{rng.randint(1, 99)} {a} {b} {c}", f"1-{a}-{b}-{c}", f"0{dig(2)}/{dig(7)}"])

    def other() -> str:
        return rng.choice([
            lambda: "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([8, 16, 32, 40]))), lambda: f"20{dig(2)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}",
            lambda: f"{rng.randint(1, 31)}.{rng.randint(1, 12)}.{rng.randint(1900, 2030)}", lambda: f"version {rng.randint(0, 9)}.{rng.randint(0, 20)}", lambda: f"v{rng.randint(0, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 9)}",
            lambda: str(rng.randint(0, 10**rng.randint(1, 9))), lambda: f"{rng.randint(1, 999)},{dig(3)}.{dig(2)}", lambda: f"${rng.randint(1, 999)}.{dig(2)}", lambda: f"{rng.randint(0, 23)}:{dig(2)}", lambda: f"{rng.randint(1900, 2030)}",
            lambda: f"{rng.randint(1900, 2000)}-{rng.randint(2001, 2030)}", lambda: f"#{dig(5)}", lambda: f"{word()}{dig(3)}", lambda: f"@{word()}", lambda: dig(rng.randint(17, 40)), lambda: f"{dig(4)}-{dig(2)}-{dig(2)}T{dig(2)}:{dig(2)}:{dig(2)}", lambda: f"ISBN {dig(3)}-{dig(1)}-{dig(4)}-{dig(4)}-{dig(1)}",
        ])()

    makers = [email, ip, card, phone]
    out = []
    while len(out) < n:
        text, spans = "", []
        style = rng.choice([str, str, str.upper])
        while len(text) < TRAIN_CHARS + 24:
            pick = rng.random()
            if pick < 0.2:
                k = rng.randrange(4)
                s = makers[k]()
                text += rng.choice(["", "", "to ", word() + " "]) if k == 0 else ""
                spans.append((k, len(text), len(text) + len(s)))
                text += s
            elif pick < 0.32:
                text += other()
            elif pick < 0.36:  # in prose, the words that spell emails out
                text += rng.choice([f"{word()} at {rng.choice([word, host])()}", f"{word()} to", f"{word()} dot", "do"])
            else:
                text += style(word()) + rng.choice(["", "", "", ",", ".", "###", "!!", "$$$", " |"])
            text += rng.choice([" ", " ", " ", " ", ". ", "\n"])
        cut = rng.randrange(0, 24)
        text = text[cut : cut + TRAIN_CHARS]
        spans = [(k, max(0, a - cut), min(b - cut, len(text))) for k, a, b in spans if b - cut > 0 and a - cut < len(text)]
        if spans and rng.random() < 0.15:  # a text that ends with a span
            text = text[: spans[-1][2]]
        # What the cut leaves of a span is none.
        out.append((text, [s for s in spans if s[2] - s[1] > 6]))
    return out


def encoded(samples: list) -> tuple[np.ndarray, np.ndarray]:
    x, y = np.zeros((len(samples), TRAIN_CHARS), np.int64), np.zeros((len(samples), TRAIN_CHARS), np.int64)
    for r, (text, spans) in enumerate(samples):
        x[r, : len(text)] = classes_of(text)
        for k, a, b in spans:
            y[r, a] = 1 + 2 * k
            y[r, a + 1 : b] = 2 + 2 * k
    return x, y


@lru_cache(maxsize=1)
def trained() -> BiLstmCrf:
    return BiLstmCrf().fit(*encoded(labelled_windows()))


def plausible(kind: int, s: str) -> bool:
    """What a span that only the model found must hold."""
    d = digits_of(s)
    if kind == 0:
        return ("@" in s or " at " in s) and re.search(r"[A-Za-z0-9-]\s?(?:\.|\[\.\]|\(\.\)| dot )\s?[A-Za-z]{2,}\Z", s) is not None and s[0].isalnum() and s.count("\n") == 0
    if kind == 1:
        parts = re.split(r"[^0-9]+", s)
        return len(parts) == 4 and all(p and len(p) <= 3 and int(p) <= 255 for p in parts) and s[0].isdigit() and s[-1].isdigit()
    if kind == 2:
        return 13 <= len(d) <= 19 and luhn(d) and len(set(d)) > 2 and re.fullmatch(r"[0-9](?:[ ./-]{0,2}[0-9])+", s) is not None
    return 9 <= len(d) <= 15 and re.fullmatch(r"[+(]?[0-9][0-9 ()./-]*[0-9]", s) is not None and re.search(r"[ ()/-]", s) is not None and not re.match(r"(?:19|20)[0-9]{2}[-/.]", s)


def added_spans(texts: list[str], base: list[list[list[tuple[int, int]]]], model: BiLstmCrf) -> list[list[tuple[int, int, int]]]:
    """For each text, the spans (kind, start, end) that the model adds."""
    rows, owners, begins, codes = [], [], [], []
    for r, text in enumerate(texts):
        at = {j for m in TRIGGER.finditer(text) for j in (m.start() // STRIDE, m.start() // STRIDE - 1) if j >= 0}
        code = classes_of(text) if at else None
        codes.append(code)
        for j in sorted(at):
            w = code[j * STRIDE : j * STRIDE + WINDOW]
            rows.append(np.pad(w, (0, WINDOW - len(w))))
            owners.append(r)
            begins.append(j * STRIDE)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not rows:
        return out
    x = np.array(rows)
    scores = np.concatenate([model.emissions(x[k : k + 1024]) for k in range(0, len(x), 1024)])
    weight = (1 + np.minimum(np.arange(WINDOW), np.arange(WINDOW)[::-1])).astype(np.float32)
    stretches, places = [], []
    k = 0
    while k < len(rows):
        end = k + 1
        while end < len(rows) and owners[end] == owners[k] and begins[end] <= begins[end - 1] + STRIDE:
            end += 1
        start, stop = begins[k], min(begins[end - 1] + WINDOW, len(texts[owners[k]]))
        total, mass = np.zeros((stop - start, LABELS), np.float32), np.zeros((stop - start, 1), np.float32)
        for q in range(k, end):
            a = begins[q] - start
            n = min(WINDOW, stop - begins[q])
            total[a : a + n] += scores[q, :n] * weight[:n, None]
            mass[a : a + n] += weight[:n, None]
        stretches.append(total / mass)
        places.append((owners[k], start))
        k = end
    for (r, start), path in zip(places, model.paths(stretches)):
        taken = [s for kind in base[r] for s in kind]
        for b in np.flatnonzero((path % 2 == 1)):
            kind, e = (int(path[b]) - 1) // 2, int(b) + 1
            while e < len(path) and path[e] == path[b] + 1:
                e += 1
            a, e = start + int(b), start + e
            while a < e and texts[r][a] in " \n":
                a += 1
            while a < e and texts[r][e - 1] in " \n.,;":
                e -= 1
            whole = (a == 0 or not texts[r][a - 1].isalnum()) and (e == len(texts[r]) or not texts[r][e].isalnum())
            if whole and a < e and plausible(kind, texts[r][a:e]) and not any(s < e and a < t for s, t in taken):
                out[r].append((kind, a, e))
    return out


def spans_of(texts: list[str | None], model: BiLstmCrf) -> list[tuple[list[list[tuple[int, int]]], list[list[tuple[int, int]]]]]:
    """For each text: the base spans and all spans, by kind."""
    texts = [t or "" for t in texts]
    hit = [k for k, t in enumerate(texts) if TRIGGER.search(t)]
    base = [base_spans(texts[k]) for k in hit]
    more = added_spans([texts[k] for k in hit], base, model)
    none: list[list] = [[] for _ in KINDS]
    out = [(none, none)] * len(texts)
    for k, b, m in zip(hit, base, more):
        out[k] = (b, [sorted([*b[kind], *((a, e) for q, a, e in m if q == kind)]) for kind in range(len(KINDS))])
    return out


def joined(spans: list[list[tuple[int, int]]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, own in zip(KINDS, spans) for a, b in own)


def personal_data(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_email, n_ip, n_card, n_phone (of the base), base_sha256, spans for each row."""
    model = trained()

    def run(batches):
        for batch in slices(batches):
            found = spans_of(column(batch, "text").to_pylist(), model)
            counts = [pa.array([len(b[k]) for b, _ in found], pa.int64()) for k in range(len(KINDS))]
            digests = [hashlib.sha256(joined(b).encode()).hexdigest() for b, _ in found]
            yield pa.RecordBatch.from_arrays([column(batch, "key"), *counts, pa.array(digests, pa.string()), pa.array([joined(a) for _, a in found], pa.string())], ["key", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    picked = docs.select(docs[key].cast("long").alias("key"), docs[text].alias("text"))
    return in_arrow(picked, run, "key long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string").withColumnRenamed("key", key)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))


QUERIES = {"op1_pii": op1_pii}
ORACLES: dict[str, str] = {}
