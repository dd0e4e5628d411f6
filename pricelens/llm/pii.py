"""Personal data by patterns and a character-level BiLSTM-CRF.

Patterns give the base spans (email, ip, card, phone).  A bidirectional LSTM
over characters with CRF transitions, written and trained in numpy from labelled
spans, adds spans that no pattern accepts (a card number without a valid check
digit, a phone number without its plus sign).  It reads overlapping windows around
every digit and @ of the whole text (each kind has one); each window is
decoded, spans get the mean posterior of their path, and the set of
non-overlapping spans of the highest total weight over the whole text is kept.
Base spans stay, and model spans that touch one give way.

Training spans: a generator of labelled snippets (fixed seed) and, when given, a
bounded sample of the table's own base spans in their contexts (``sample``
snippets at most, the documents of the smallest hashes).

Defined results: null and empty texts have no spans; repeated rows agree; an
empty table gives no rows, and the model is then trained on the generator alone.
Offsets are code points, ends exclusive."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
TAGS = 1 + 2 * len(KINDS)  # O, then B and I of each kind
WIDTH, STRIDE, REACH = 96, 32, 32  # of a window; between windows; characters around a digit or @
LESSON = 56  # characters of a training window
LEAST = 0.8  # mean posterior of an added span
SAMPLE = 400  # snippets of the table that the model is fitted on, at most
OTHER, LETTER, SPACE, PAD = 96, 97, 98, 0
VOCAB = 99

TRIGGER = re.compile("[0-9@]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    d = [int(c) for c in digits[::-1]]
    return (sum(d[::2]) + sum(x * 2 - 9 * (x > 4) for x in d[1::2])) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the pattern spans, by kind and start."""
    out, last, seen = [], 0, 0
    if "@" in text:
        for m in re.finditer("@", text):
            at = m.start()
            if at < last:
                continue
            start = at
            while start > last and text[start - 1] in LOCAL:
                start -= 1
            d = DOMAIN.match(text, at) if start < at else None
            if d:
                out.append((0, start, d.end()))
                last = d.end()
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((1, *m.span()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((3, *m.span()))
    return out


def encode(text: str, width: int = WIDTH) -> np.ndarray:
    out = np.zeros(width, dtype=np.int64)
    for i, c in enumerate(text[:width]):
        o = ord(c)
        out[i] = o - 31 if 32 <= o < 127 else SPACE if c.isspace() else LETTER if c.isalpha() else OTHER
    return out


def tags_of(spans: list[tuple[int, int, int]], width: int = WIDTH) -> np.ndarray:
    y = np.zeros(width, dtype=np.int64)
    for kind, a, b in spans:
        y[a:b] = 2 + 2 * kind
        y[a] = 1 + 2 * kind
    return y


def labelled_snippets(n: int, seed: int = 5) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Labelled spans to train on: words with personal data of every kind and with
    look-alikes (dates, versions, prices, hexadecimal keys, short numbers)."""
    rng = np.random.default_rng(seed)
    syllables = "an re th on in es ti ou er st le de que ción ung sch é ä la os en ver".split()
    pick = lambda s: s[rng.integers(len(s))]
    digits = lambda k: "".join(str(x) for x in rng.integers(0, 10, k))
    word = lambda: "".join(pick(syllables) for _ in range(rng.integers(1, 5)))
    ascii_word = lambda: re.sub("[^a-z]", "", word()) or "ab"

    def item() -> tuple[int, str]:
        kind = int(rng.integers(0, 6))
        if kind == 0:
            user = ascii_word() + pick([".", "_", "-", ""]) + pick([digits(2), ascii_word()])
            return 0, f"{user}@{pick(['mail', 'box', ascii_word()])}{pick(['', digits(1)])}.{pick(['example.com', 'com', 'org', 'co.uk', 'de'])}"
        if kind == 1:
            return 1, ".".join(str(x) for x in rng.integers(0, 256, 4))
        if kind == 2:
            d = digits(16)
            return 2, pick([d, d, " ".join(d[i : i + 4] for i in range(0, 16, 4)), "-".join(d[i : i + 4] for i in range(0, 16, 4)), digits(18)])
        if kind == 3:
            a, b, c = digits(3), digits(3), digits(4)
            return 3, pick([f"+1 ({a}) {b}-{c}", f"+1 ({a}) {b}-{c}", f"+{digits(2)} {a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{digits(11)}"])
        return -1, pick([
            digits(4), digits(2) + "%", f"{digits(1)}.{digits(1)}", f"{digits(1)}.{digits(1)}.{digits(1)}", f"20{digits(2)}-0{pick('123456789')}-1{digits(1)}",
            f"${digits(3)}.{digits(2)}", f"{pick('123456789')},{digits(3)},{digits(3)}", f'token = "{rng.bytes(20).hex()}"', rng.bytes(16).hex(), f"{digits(2)}:{digits(2)}",
            f"@{ascii_word()}", f"No. {digits(5)}", f"{word()}{digits(2)}", digits(7), f"({digits(2)})", f"{digits(2)}-{digits(2)}", digits(26), digits(32),
        ])

    out = []
    for _ in range(n):
        text, spans = "", []
        while len(text) < LESSON - 6:
            kind, s = item() if rng.random() < 0.3 else (-1, " ".join(word() for _ in range(rng.integers(1, 4))))
            if kind >= 0 and len(text) + len(s) <= LESSON:
                spans.append((kind, len(text), len(text) + len(s)))
            text += s + pick([" ", " ", " ", ", ", ". ", " | ", "\n"])
        out.append((text[:LESSON], spans))
    return out


class Tagger:
    """Character BiLSTM with a CRF on top.  Arrays are (direction, batch, ...): the
    second direction reads the window backwards."""

    def __init__(self, hidden: int = 16, size: int = 12, seed: int = 3):
        r = np.random.default_rng(seed)
        self.h = hidden
        self.p = {
            "E": r.normal(0, 0.3, (VOCAB, size)), "W": r.normal(0, 1 / np.sqrt(size + hidden), (2, size + hidden, 4 * hidden)),
            "b": np.zeros((2, 1, 4 * hidden)), "O": r.normal(0, 1 / np.sqrt(2 * hidden), (2 * hidden, TAGS)), "c": np.zeros(TAGS),
            "T": np.zeros((TAGS, TAGS)), "s": np.zeros(TAGS),
        }
        self.p["b"][:, :, hidden : 2 * hidden] = 1.0  # forget gates begin open
        wrong = np.zeros((TAGS, TAGS), dtype=bool)  # an I that follows neither B nor I of its kind
        for k in range(len(KINDS)):
            wrong[:, 2 + 2 * k] = True
            wrong[1 + 2 * k : 3 + 2 * k, 2 + 2 * k] = False
        self.wrong, self.wrong_start = wrong, np.array([t > 0 and t % 2 == 0 for t in range(TAGS)])

    def _rules(self) -> tuple[np.ndarray, np.ndarray]:
        return np.where(self.wrong, -1e4, self.p["T"]), np.where(self.wrong_start, -1e4, self.p["s"])

    def emissions(self, x: np.ndarray, keep: bool = False):
        """(batch, width) characters -> (batch, width, tags)."""
        p, h = self.p, self.h
        n, w = x.shape
        both = np.stack([x, x[:, ::-1]])  # direction, batch, width
        e = p["E"][both]
        hs, cs, gates = np.zeros((w + 1, 2, n, h)), np.zeros((w + 1, 2, n, h)), []
        for t in range(w):
            z = np.concatenate([e[:, :, t], hs[t]], axis=2)
            g = z @ p["W"] + p["b"]
            s = 1 / (1 + np.exp(-np.clip(g[:, :, : 3 * h], -30, 30)))
            u = np.tanh(g[:, :, 3 * h :])
            cs[t + 1] = s[:, :, h : 2 * h] * cs[t] + s[:, :, :h] * u
            hs[t + 1] = s[:, :, 2 * h :] * np.tanh(cs[t + 1])
            if keep:
                gates.append((z, s, u))
        top = np.concatenate([hs[1:, 0], hs[:0:-1, 1]], axis=2).transpose(1, 0, 2)  # batch, width, 2h
        em = top @ p["O"] + p["c"]
        return (em, (both, hs, cs, gates, top)) if keep else em

    def _alpha_beta(self, em: np.ndarray):
        T, s = self._rules()
        n, w, k = em.shape
        a, b = np.empty((w, n, k)), np.zeros((w, n, k))
        lse = lambda m, axis: np.log(np.exp(m - (top := m.max(axis=axis, keepdims=True))).sum(axis=axis)) + top.squeeze(axis)
        a[0] = em[:, 0] + s
        for t in range(1, w):
            a[t] = lse(a[t - 1][:, :, None] + T, 1) + em[:, t]
        for t in range(w - 2, -1, -1):
            b[t] = lse(T + (em[:, t + 1] + b[t + 1])[:, None, :], 2)
        return a, b, lse(a[-1], 1)

    def loss(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of a window, and its gradients."""
        p, h = self.p, self.h
        em, (both, hs, cs, gates, top) = self.emissions(x, keep=True)
        n, w, k = em.shape
        T, s = self._rules()
        a, b, z = self._alpha_beta(em)
        rows = np.arange(n)
        gold = s[y[:, 0]] + em[rows[:, None], np.arange(w), y].sum(axis=1) + T[y[:, :-1], y[:, 1:]].sum(axis=1)
        d_em = np.exp(a + b - z[:, None]).transpose(1, 0, 2)
        gT = np.zeros_like(T)
        for t in range(1, w):
            gT += np.exp(a[t - 1][:, :, None] + T + (em[:, t] + b[t])[:, None, :] - z[:, None, None]).sum(axis=0)
        gs = d_em[:, 0].sum(axis=0)
        np.add.at(gT, (y[:, :-1].ravel(), y[:, 1:].ravel()), -1)
        np.add.at(gs, y[:, 0], -1)
        d_em[rows[:, None], np.arange(w), y] -= 1
        g = {"T": np.where(self.wrong, 0, gT), "s": np.where(self.wrong_start, 0, gs), "c": d_em.sum(axis=(0, 1)), "O": np.einsum("nwh,nwk->hk", top, d_em)}
        d_top = (d_em @ p["O"].T).transpose(1, 0, 2)
        d_h = np.stack([d_top[:, :, :h], d_top[::-1, :, h:]], axis=1)  # width, direction, batch, h
        gW, gb, gE = np.zeros_like(p["W"]), np.zeros_like(p["b"]), np.zeros_like(p["E"])
        size = p["E"].shape[1]
        nh, nc = np.zeros((2, n, h)), np.zeros((2, n, h))
        for t in range(w - 1, -1, -1):
            zin, sg, u = gates[t]
            i, f, o = sg[:, :, :h], sg[:, :, h : 2 * h], sg[:, :, 2 * h :]
            dh, tc = d_h[t] + nh, np.tanh(cs[t + 1])
            dc = nc + dh * o * (1 - tc * tc)
            dz = np.concatenate([dc * u * i * (1 - i), dc * cs[t] * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - u * u)], axis=2)
            gW += zin.transpose(0, 2, 1) @ dz
            gb += dz.sum(axis=1, keepdims=True)
            d_in = dz @ p["W"].transpose(0, 2, 1)
            np.add.at(gE, both[:, :, t], d_in[:, :, :size])
            nh, nc = d_in[:, :, size:], dc * f
        g |= {"W": gW, "b": gb, "E": gE}
        return float((z - gold).mean()), {k: v / n for k, v in g.items()}

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = 280, batch: int = 64, rate: float = 0.03, seed: int = 1) -> "Tagger":
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        for t in range(1, steps + 1):
            at = r.integers(0, len(x), batch)
            _, g = self.loss(x[at], y[at])
            lr = rate * (1 - (t - 1) / steps)
            for k in self.p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v2[k] = 0.99 * v2[k] + 0.01 * g[k] ** 2
                self.p[k] = self.p[k] - lr * (m[k] / (1 - 0.9**t)) / (np.sqrt(v2[k] / (1 - 0.99**t)) + 1e-8)
        return self

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best paths (batch, width) and the posterior of each of their tags."""
        em = self.emissions(x)
        T, s = self._rules()
        n, w, k = em.shape
        v, back = em[:, 0] + s, np.zeros((w, n, k), dtype=np.int8)
        for t in range(1, w):
            m = v[:, :, None] + T
            back[t] = m.argmax(axis=1)
            v = m.max(axis=1) + em[:, t]
        path = np.empty((n, w), dtype=np.int64)
        path[:, -1] = v.argmax(axis=1)
        for t in range(w - 1, 0, -1):
            path[:, t - 1] = back[t][np.arange(n), path[:, t]]
        a, b, z = self._alpha_beta(em)
        post = np.exp(a + b - z[:, None]).transpose(1, 0, 2)
        return path, post[np.arange(n)[:, None], np.arange(w), path]


def windows(text: str) -> list[int]:
    """Starts of the overlapping windows that cover every character within REACH of
    a digit or @."""
    out: list[int] = []
    lo = hi = -1
    for m in TRIGGER.finditer(text):
        a, b = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        if hi < 0:
            lo, hi = a, b
        elif a <= hi:
            hi = b
        else:
            out += range(lo, max(lo + 1, hi - WIDTH + STRIDE), STRIDE)
            lo, hi = a, b
    if hi >= 0:
        out += range(lo, max(lo + 1, hi - WIDTH + STRIDE), STRIDE)
    return out


def _spans(path: np.ndarray, post: np.ndarray, start: int, text: str) -> list[tuple[float, int, int, int]]:
    """(score, kind, start, end) of the spans of one window that it holds whole."""
    out, i, n = [], 0, min(WIDTH, len(text) - start)
    while i < n:
        if path[i] % 2 == 1:
            j = i + 1
            while j < n and path[j] == path[i] + 1:
                j += 1
            whole = (i > 0 or start == 0) and (j < n or start + j == len(text))
            if whole:
                out.append((float(post[i:j].mean()), int(path[i] // 2), start + i, start + j))
            i = j
        else:
            i += 1
    return out


def _plausible(kind: int, text: str, a: int, b: int) -> bool:
    s = text[a:b]
    if not s or s[0].isspace() or s[-1].isspace() or (a and text[a - 1].isalnum()) or (b < len(text) and text[b].isalnum()):
        return False
    digits = sum(c in "0123456789" for c in s)
    if kind == 0:
        return 0 < s.find("@") < len(s) - 1 and " " not in s
    if any(c.isalpha() for c in s):
        return False
    return (digits >= 4 and s.count(".") == 3, 16 <= digits <= 19, 7 <= digits <= 15)[kind - 1]


def reconcile(found: list[tuple[float, int, int, int]]) -> list[tuple[int, int, int]]:
    """The non-overlapping spans of the largest total weight (score times length)."""
    best: dict[tuple[int, int, int], float] = {}
    for score, kind, a, b in found:
        best[kind, a, b] = max(score, best.get((kind, a, b), 0.0))
    spans = sorted(best, key=lambda s: (s[2], s[1], s[0]))
    ends = [s[2] for s in spans]
    total, take = [0.0], []
    for i, (kind, a, b) in enumerate(spans):
        k = bisect_right(ends, a, 0, i)
        w = total[k] + best[kind, a, b] * (b - a)
        take.append(k if w > total[-1] else -1)
        total.append(max(w, total[-1]))
    out, i = [], len(spans)
    while i > 0:
        if take[i - 1] >= 0:
            out.append(spans[i - 1])
            i = take[i - 1]
        else:
            i -= 1
    return sorted(out)


def find_spans(texts: list[str], model: Tagger, batch: int = 256) -> list[tuple[list, list]]:
    """For each text its base spans and its added spans, by kind and start."""
    base = [base_spans(t) for t in texts]
    at = [(i, s) for i, t in enumerate(texts) for s in windows(t)]
    found: list[list] = [[] for _ in texts]
    for k in range(0, len(at), batch):
        part = at[k : k + batch]
        path, post = model.decode(np.stack([encode(texts[i][s : s + WIDTH]) for i, s in part]))
        for (i, s), p, q in zip(part, path, post):
            found[i] += [x for x in _spans(p, q, s, texts[i]) if x[0] >= LEAST and _plausible(x[1], texts[i], x[2], x[3])]
    out = []
    for b, f in zip(base, found):
        held = sorted((s[1], s[2]) for s in b)
        starts, reach, top = [s[0] for s in held], [], 0
        for s in held:
            top = max(top, s[1])
            reach.append(top)
        free = []
        for kind, x, y in reconcile(f):
            k = bisect_right(starts, y - 1)  # base spans that begin before y; does any reach past x?
            if not (k and reach[k - 1] > x):
                free.append((kind, x, y))
        out.append((b, free))
    return out


def train(docs: DataFrame | None = None, id_col: str = "doc_id", text: str = "text", sample: int = SAMPLE, snippets: int = 1500) -> Tagger:
    """Fit the tagger on generated labelled snippets and on at most ``sample`` of the
    table's documents (a window around the first digit or @ of each)."""
    data = labelled_snippets(snippets)
    if docs is not None and sample:
        # by their hashes, so many documents that few lack the sample; only snippets go on to the driver
        share = min(1.0, 40 * sample / max(1, docs.count()))
        draw = F.xxhash64(docs[id_col], docs[text])
        rows = docs.where((F.pmod(draw, F.lit(1 << 30)) < int(share * (1 << 30))) & docs[text].rlike("[0-9@]"))
        around = F.greatest(F.lit(1), F.regexp_instr(docs[text], F.lit("[0-9@]")) - LESSON // 3)
        snippets_of = rows.select(draw.alias("draw"), F.substring(docs[text], around, LESSON).alias("t"))
        for r in snippets_of.orderBy("draw", "t").limit(sample).collect():
            spans = base_spans(r["t"])
            if len(spans) == len({s[1] for s in spans}) and spans:
                data.append((r["t"], spans))
    # a digit run of card length that no base span covers is a card of unknown check digit
    x, y = [], []
    for t, spans in data:
        tags = tags_of(spans, LESSON)
        for m in CARD.finditer(t):
            if m[0].isdigit() and 16 <= len(m[0]) <= 19 and not tags[m.start() : m.end()].any() and m.end() < len(t):
                tags[m.start() : m.end()] = 2 + 2 * 2
                tags[m.start()] = 1 + 2 * 2
        x.append(encode(t, LESSON))
        y.append(tags)
    return Tagger().fit(np.stack(x), np.stack(y))


def form(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def scan(docs: DataFrame, model: Tagger, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, n_email, n_ip, n_card, n_phone (base
    spans), base_sha256, spans (all) and added (those of the model)."""
    has = docs[text].rlike("[0-9@]")  # other texts have no span and need not leave the JVM
    slim = docs.select(docs[id_col].alias("id"), F.when(has, docs[text]).alias("text"))
    names = [f"n_{k}" for k in KINDS] + ["base_sha256", "spans", "added"]

    @F.pandas_udf(", ".join([f"n_{k} long" for k in KINDS] + ["base_sha256 string", "spans string", "added string"]))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            out = []
            for b, added in find_spans([t or "" for t in s], model):
                n = [sum(1 for x in b if x[0] == k) for k in range(len(KINDS))]
                out.append((*n, hashlib.sha256(form(b).encode()).hexdigest(), form(sorted(b + added)), form(added)))
            yield pd.DataFrame(out, columns=names)

    return slim.select("id", run("text").alias("x")).select("id", "x.*")
