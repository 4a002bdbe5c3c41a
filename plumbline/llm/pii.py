"""Personal data: exact patterns, extended by a skip-chain conditional random field (Sutton and McCallum, "Collective
segmentation and labeling of distant entities in information extraction", 2004).

Tokens are runs without white space. Tokens with a digit, an @ or a written-out @ are nodes; all others are observed to be
outside. Neighbouring nodes share a chain potential, and a token shares a skip potential with the previous token of the
document that has the same letters and digits, however far, and with the first of them that a pattern matches. Tokens inside a pattern's match are observed to have its
label, so that loopy sum-product messages carry it to repeated and similar tokens that no pattern matches. Potentials are
fitted piecewise on sentences that a seeded generator writes."""

from __future__ import annotations

import hashlib
import random
import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, map_arrow, quoted

KINDS = ("email", "ip", "card", "phone")
LABELS = ("outside", *KINDS)
#: Marginal probability from which a token counts.
SURE = 0.7

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TRIGGER = re.compile(r"[0-9@]|[(\[]at[)\]]")
TOKEN = re.compile(r"\S+")
AT, DOT = re.compile(r"[(\[]at[)\]]"), re.compile(r"[(\[]dot[)\]]")


def luhn(digits: str) -> bool:
    total = sum(int(c) for c in digits[-1::-2]) + sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])
    return total % 10 == 0


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) < 256


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the patterns' matches, leftmost and non-overlapping for each kind, by kind and start.

    An address has one @: the characters before it reach back to the end of the match before, so that each @ is looked at
    once, and runs of any length take time in proportion."""
    text, out = text or "", []
    at, floor = text.find("@"), 0
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append(("email", start, m.end()))
            floor = m.end()
        at = text.find("@", max(at + 1, floor))
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(map(_octet, m[0].split(".")))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return out


CUES = {"mail": 0, "email": 0, "e-mail": 0, "contact": 0, "ip": 1, "host": 1, "server": 1, "address": 1, "card": 2, "visa": 2, "pay": 2, "phone": 3, "tel": 3, "call": 3, "fax": 3, "mobile": 3}


def _shape(token: str) -> list[bool]:
    digits = "".join(c for c in token if c in "0123456789")
    n, core = len(digits), token.strip(".,;:!?\"'#$%&*")
    letters = any(c.isalpha() for c in token)
    return [
        "@" in token, bool(AT.search(token)), bool(DOT.search(token)) or bool(re.search(r"[A-Za-z0-9-]\.[A-Za-z]{2,}$", core)), letters and not n, letters and n > 0, 0 < n < 4, 4 <= n < 7, 7 <= n < 10, 10 <= n < 16, n > 19,
        16 <= n <= 19 and luhn(digits), 16 <= n <= 19 and not luhn(digits), bool(re.fullmatch(r"\d{1,3}(\.\d{1,3}){3}", core)) and all(map(_octet, core.split("."))), core.startswith("+"),
        bool(re.fullmatch(r"\(\d{2,4}\)", core)), bool(re.fullmatch(r"\d{2,4}([-.]\d{2,4}){1,2}", core)), bool(re.fullmatch(r"\d+([.,]\d+)?", core)), len(token) > 24,
    ]


def featured(tokens: list[str], nodes: list[int]) -> np.ndarray:
    """A row of 0 and 1 for each node: its own shape, parts of both neighbours' shapes, cue words up to three tokens before."""
    shapes: dict[int, list[bool]] = {}

    def shape(i):
        if not 0 <= i < len(tokens) or not TRIGGER.search(tokens[i]):
            return NONE
        if i not in shapes:
            shapes[i] = _shape(tokens[i])
        return shapes[i]

    rows = []
    for i in nodes:
        cues = [False] * 4
        for w in tokens[max(0, i - 3) : i]:
            if (k := CUES.get(w.lower().strip(":,.()"))) is not None:
                cues[k] = True
        before, after = shape(i - 1), shape(i + 1)
        rows.append([True, *shape(i), *(s[j] for s in (before, after) for j in (1, 13, 14, 15)), *cues])
    return np.array(rows, float).reshape(len(rows), WIDTH)


NONE = [False] * 18
WIDTH = 1 + 18 + 8 + 4


def normal(token: str) -> str:
    """What repeated and similar tokens have in common: letters and digits in lower case; nothing if there are fewer than six."""
    x = "".join(c for c in token.lower() if c.isalnum())
    return x if len(x) >= 6 else ""


def _sentences(rng: random.Random, n: int):
    """Token lists with labels: personal data in matched and in unmatched spellings, and look-alikes, amid plain words."""
    word = lambda: "".join(rng.choice("aeioubcdlmnrst") for _ in range(rng.randint(2, 9)))
    num = lambda k: "".join(rng.choice("0123456789") for _ in range(k))

    def card(valid):
        while True:
            x = rng.choice("3456") + num(rng.choice([15, 15, 15, 18]))
            if luhn(x) == valid:
                return x

    for _ in range(n):
        tokens, labels = [], []

        def put(*parts, label=0):
            tokens.extend(parts)
            labels.extend([label] * len(parts))

        for _ in range(rng.randint(3, 9)):
            put(*(word() for _ in range(rng.randint(1, 7))))
            kind = rng.random()
            cue = lambda *w: put(rng.choice(w)) if rng.random() < 0.4 else None
            if kind < 0.12:
                cue("mail", "email", "contact")
                put(f"{word()}.{num(2)}@{word()}.example.com" if rng.random() < 0.6 else f"{word()}(at){word()}.com", label=1)
            elif kind < 0.2:
                put(word(), rng.choice(["(at)", "[at]"]), f"{word()}.org", label=1)
            elif kind < 0.32:
                cue("ip", "host", "server")
                put(".".join(str(rng.randint(0, 255)) for _ in range(4)), label=2)
            elif kind < 0.42:
                cue("card", "visa")
                put(card(True), label=3)
            elif kind < 0.54:
                cue("phone", "tel", "call")
                put(f"+{num(1)}", f"({num(3)})", f"{num(3)}-{num(4)}", label=4)
            elif kind < 0.64:
                put(f"({num(3)})", f"{num(3)}-{num(4)}", label=4)
            elif kind < 0.7:
                put(rng.choice(["phone", "tel", "call"]))
                put(f"{num(3)}-{num(3)}-{num(4)}", label=4)
            else:
                put(rng.choice([lambda: card(False), lambda: num(rng.randint(1, 12)), lambda: f"{num(1)}.{num(1)}", lambda: f"{num(1)}.{num(1)}.", lambda: f"19{num(2)}-{num(2)}-{num(2)}", lambda: f"{num(3)}.{num(3)}.9{num(2)}.{num(4)}",
                                lambda: f'"{"".join(rng.choice("0123456789abcdef") for _ in range(40))}"', lambda: word() + num(2), lambda: f"({num(2)})", lambda: f"{num(3)}.5{num(2)}.{num(3)}.7{num(2)}", lambda: f"{num(20)}", lambda: f"@{word()}"])())
            if rng.random() < 0.25:  # a distant repeat
                at = rng.randrange(len(tokens))
                if normal(tokens[at]) and TRIGGER.search(tokens[at]):
                    put(*(word() for _ in range(3)))
                    put(tokens[at].strip("+,.") if rng.random() < 0.5 else tokens[at], label=labels[at])
        yield tokens, labels


@cache
def model(seed: int = 7, n: int = 400, rounds: int = 150) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unary weights [features, labels] by multinomial logistic regression; chain and skip potentials [labels, labels] as
    smoothed log ratios of how often labels meet to how often they would by chance."""
    rng, k = random.Random(seed), len(LABELS)
    xs, ys, chain, skip = [], [], np.full((k, k), 0.5), np.full((k, k), 0.5)
    for tokens, labels in _sentences(rng, n):
        nodes = [i for i, t in enumerate(tokens) if TRIGGER.search(t) or labels[i]]
        xs.append(featured(tokens, nodes))
        ys += [labels[i] for i in nodes]
        seen: dict[str, int] = {}
        for i, t in enumerate(tokens):
            if i and (labels[i] or labels[i - 1]):
                chain[labels[i - 1], labels[i]] += 1
            if TRIGGER.search(t) and (x := normal(t)):
                if x in seen:
                    skip[labels[seen[x]], labels[i]] += 1
                seen[x] = i
    chain[0, 0] = chain.sum()
    ratio = lambda c: np.clip(np.log(c * c.sum() / (c.sum(1, keepdims=True) * c.sum(0, keepdims=True))), -4, 4)
    x, y = np.concatenate(xs), np.eye(k)[ys]
    w, g2 = np.zeros((x.shape[1], k)), np.full((x.shape[1], k), 1e-6)
    for _ in range(rounds):
        z = x @ w
        p = np.exp(z - z.max(1, keepdims=True))
        g = x.T @ (p / p.sum(1, keepdims=True) - y) / len(x) + 1e-4 * w
        g2 += g * g
        w -= 0.5 * g / np.sqrt(g2)
    skip = (skip + skip.T) / 2
    return w, ratio(chain), ratio(skip)


def marginals(unary: np.ndarray, edges: np.ndarray, potentials: np.ndarray, rounds: int = 30, damp: float = 0.3) -> np.ndarray:
    """Loopy sum-product with all messages of a round sent at once: unary [n, k] and potentials [m, k, k] are logarithms,
    edges [m, 2] pairs of nodes. Exact on trees once rounds reach the longest path."""
    n, k = unary.shape
    if not len(edges):
        p = np.exp(unary - unary.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)
    src, dst = np.r_[edges[:, 0], edges[:, 1]], np.r_[edges[:, 1], edges[:, 0]]
    pot = np.exp(np.concatenate((potentials, potentials.transpose(0, 2, 1))))
    back = np.r_[np.arange(len(edges)) + len(edges), np.arange(len(edges))]
    msg = np.zeros((len(src), k))
    for _ in range(rounds):
        belief = unary.copy()
        np.add.at(belief, dst, msg)
        out = belief[src] - msg[back]
        out = np.log(np.einsum("ek,ekl->el", np.exp(out - out.max(1, keepdims=True)), pot) + 1e-300)
        out -= np.log(np.exp(out).sum(1, keepdims=True))
        new = damp * msg + (1 - damp) * out
        still = np.abs(new - msg).max() < 1e-4
        msg = new
        if still:
            break
    belief = unary.copy()
    np.add.at(belief, dst, msg)
    p = np.exp(belief - belief.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def added_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans that the field adds: neighbouring tokens that are surely of one kind and touch no match, without outer punctuation."""
    spans = [m.span() for m in TOKEN.finditer(text)]
    tokens = [text[a:b] for a, b in spans]
    label = np.zeros(len(tokens), int)
    starts = np.array([a for a, _ in spans])
    ends = np.array([b for _, b in spans])
    for kind, a, b in base:
        label[np.searchsorted(ends, a, "right") : np.searchsorted(starts, b, "left")] = LABELS.index(kind)
    around = {j for i, t in enumerate(tokens) if AT.search(t) for j in (i - 1, i + 1) if 0 <= j < len(tokens)}
    nodes = [i for i, t in enumerate(tokens) if TRIGGER.search(t) or label[i] or i in around]
    if all(label[i] for i in nodes):
        return []
    w, chain, skip = model()
    place = {i: k for k, i in enumerate(nodes)}
    unary = featured(tokens, nodes) @ w
    edges, pots, seen, matched = [], [], {}, {}
    for k, i in enumerate(nodes):
        if label[i] and (x := normal(tokens[i])):
            matched.setdefault(x, k)
    for k, i in enumerate(nodes):
        if i - 1 in place:
            edges.append((place[i - 1], k))
            pots.append(chain)
        elif i:
            unary[k] += chain[0]
        if i + 1 not in place and i + 1 < len(tokens):
            unary[k] += chain[:, 0]
        if x := normal(tokens[i]):
            if x in seen:
                edges.append((seen[x], k))
                pots.append(skip)
            sure = matched.get(x, k)  # what a pattern knows reaches every occurrence at once, however far and many they are
            if sure not in (k, seen.get(x)):
                edges.append((sure, k))
                pots.append(skip)
            seen[x] = k
        if label[i]:
            unary[k] -= 50 * (np.arange(len(LABELS)) != label[i])
    p = marginals(unary, np.array(edges).reshape(-1, 2), np.array(pots).reshape(-1, len(LABELS), len(LABELS)))
    best, out, last = p.argmax(1), [], (-2, 0)
    for k, i in enumerate(nodes):
        found = int(best[k])
        if not found or label[i] or p[k, found] < SURE:
            continue
        a, b = spans[i]
        while a < b and not (text[a].isalnum() or text[a] in "+(["):
            a += 1
        while b > a and not (text[b - 1].isalnum() or text[b - 1] in ")]"):
            b -= 1
        if a == b:
            continue
        if last == (i - 1, found):
            out[-1] = (LABELS[found], out[-1][1], b)
        else:
            out.append((LABELS[found], a, b))
        last = (i, found)
    return out


def all_spans(text: str | None) -> tuple[list, list]:
    """(base, all) spans by kind and start. A text without a digit, an @ or a written-out @ has no node and so no span."""
    if not text or not TRIGGER.search(text):
        return [], []
    base = base_spans(text)
    return base, sorted(base + added_spans(text, base), key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span, or union of overlapping ones, replaced by its first kind in angle brackets."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def find(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """For each document: id, n_email, n_ip, n_card, n_phone (long: the patterns' matches), base_sha256 and spans (all).

    Offsets are code points, ends exclusive. A null text counts as empty; a null id and repeated rows stay; other columns
    are not read; an empty table gives no rows. A document is decided alone, in memory in proportion to its length."""
    source = docs.select(col(id_col).alias("id"), col(text).cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    names = [id_col, *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]

    def make():
        def step(batch):
            found = [all_spans(t) for t in batch.column(1).to_pylist()]
            counts = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in KINDS]
            sha = [hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array(sha, pa.string()), pa.array([joined(x) for _, x in found], pa.string())], names)

        return step

    return map_arrow(source, make, f"{quoted(id_col)} {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the text of every document redacted; null stays null, columns and their order stay."""
    names, at = docs.columns, docs.columns.index(text)

    def make():
        def step(batch):
            texts = [redact(t, s) if t and (s := all_spans(t)[1]) else t for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(texts, pa.string()), *batch.columns[at + 1 :]], names)

        return step

    return map_arrow(docs, make, docs.schema)
