"""Personal data by patterns and a skip-chain conditional random field (operator 4).

Base spans (e-mail, ip, card, phone) come from patterns, written so that each is
linear in the text whatever it holds.  A field over the tokens that carry a digit
or an at sign then adds spans the patterns miss: its nodes are joined to the next
token in line, and by a skip edge to a hub, one for each number (whatever letters are glued on),
address or other token (and each similar number, such as a local number and one that
ends in it) that a document holds more than twice or that a base span holds; two
occurrences without one are joined directly.  So any two are two edges apart at most,
and edges are as many as the tokens.  Sum-product message passing runs over all
documents of a batch at once, for each until its messages stand still; nodes inside
base spans, and the hubs of what base spans hold, are clamped to their kind, so a
number that was recognised once labels its other spellings, however many.

All other tokens are outside by construction and need no node.  Weights are
fitted on generated documents by pseudo-likelihood, once, from a fixed seed.

Cases: null text counts as empty (no spans, masked text stays null); offsets are code
points, ends exclusive; repeated rows get the same result; result columns replace
others of their name.
"""

from __future__ import annotations

import hashlib
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
LABELS = len(KINDS) + 1  # 0: outside
STILL = 1e-4  # messages that move less have settled
PATIENCE = 200
LEAST_STEP = 1 / 64
HELD = 1e9  # more than the messages of any number of neighbours
SURE = 0.75

_TRIGGER = re.compile(r"[0-9@]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TOKEN = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*")
_NUMERIC = re.compile(r"[+(]?[0-9()./-]++[,;:]?")
_DIGITS = re.compile(r"[^0-9]+")
_LETTERS = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _emails(text: str):
    after = 0
    at = text.find("@")
    while at >= 0:
        # the local part is the run of its characters before the sign, not reaching into the last match
        start = at
        while start > after and (c := text[start - 1]) < "\x7f" and (c.isalnum() or c in "._%+-"):
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            after = m.end()
            at = text.find("@", after)
        else:
            after = at + 1
            at = text.find("@", after)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end), by kind and start."""
    if _TRIGGER.search(text) is None:
        return []
    out = [(0, a, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_DIGITS.sub("", m.group())) <= 15:
                out.append((3, *m.span()))
    return out


# the field ------------------------------------------------------------------

FEATURES = 22


def _nodes(text: str) -> list[tuple[int, int]]:
    """Spans of the tokens with a digit or an at sign; neighbouring short numbers that make 9 to 15 digits are one node."""
    tokens = [m.span() for m in _TOKEN.finditer(text)]
    out: list[tuple[int, int]] = []
    i = 0
    while i < len(tokens):
        j, n = i, 0
        while j < len(tokens) and (j == i or tokens[j][0] == tokens[j - 1][1] + 1) and _NUMERIC.fullmatch(text, *tokens[j]):
            d = sum(c.isdigit() for c in text[tokens[j][0] : tokens[j][1]])
            if not 0 < d < 9 or n + d > 15:
                break
            n += d
            j += 1
        if j > i + 1 and n >= 9:
            out.append((tokens[i][0], tokens[j - 1][1]))
            i = j
        else:
            out.append(tokens[i])
            i += 1
    return out


def _core(text: str, a: int, b: int, kind: int) -> tuple[int, int]:
    """The node without the punctuation around it; a number without the letters around it, too."""
    inner = str.isdigit if kind in (1, 2, 3) else str.isalnum
    while b > a and not inner(text[b - 1]):
        b -= 1
    opening = "+(" if kind == 3 else ""
    while a < b and not (inner(text[a]) or text[a] in opening):
        a += 1
    return a, b


def _quad(parts: list[str]) -> bool:
    return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)


def _keys(token: str) -> tuple[list[tuple[int, str]], dict[tuple[int, str], tuple[int, str]]]:
    """(edge kinds and keys, local numbers that its numbers end in and the number's key) of a node's text; letters part its numbers."""
    keys, tails = [], {}
    if "@" in token:
        core = token.strip(".,;:!?()<>[]\"'*$%&#|").lower()
        keys.append((1, "e" + core))
        if core.rpartition("@")[0]:
            keys.append((2, "E" + core.rpartition("@")[0]))
        return keys, tails
    for number in _LETTERS.split(token):
        digits = _DIGITS.sub("", number)
        n = len(digits)
        parts = [p for p in _DIGITS.split(number) if p]
        if _quad(parts):
            keys.append((1, "i" + ".".join(str(int(p)) for p in parts)))
        elif n >= 7:
            keys.append((1, "n" + digits[-9:]))
            if n >= 13:
                keys.append((2, f"N{n}{digits[:8]}"))
            if 9 <= n <= 15:
                tails |= {(1, "n" + digits[-k:]): (1, "n" + digits[-9:]) for k in (7, 8)}
    return list(dict.fromkeys(keys)) or [(1, "t" + token.strip(".,;:!?"))], tails


def _describe(token: str) -> list[int]:
    """Features of a node's text."""
    digits = _DIGITS.sub("", token)
    letters = sum(c.isalpha() for c in token)
    n = len(digits)
    f = [0]
    f.append(1 + (0 if n == 0 else 1 if n < 4 else 2 if n < 9 else 3 if n < 13 else 4 if n < 16 else 5 if n < 20 else 6))
    at = "@" in token
    if at:
        f.append(8)
        host = token.rpartition("@")[2]
        if "." in host.strip(".,;:!?"):
            f.append(9)
        if token.partition("@")[0]:
            f.append(10)
    if not letters and _quad([p for p in _DIGITS.split(token) if p]):
        f.append(11)
    if token.startswith("+"):
        f.append(12)
    if any(c in token for c in "()"):
        f.append(13)
    if "-" in token or "." in token[:-1]:
        f.append(14)
    if 13 <= n <= 19 and luhn(digits):
        f.append(15)
    if letters:
        f.append(16 if 2 * letters < len(token) else 17)
    return f


def _graph(texts: list[str], spans: list[list[tuple[int, int, int]]]) -> dict:
    """Nodes, features, hubs and edges of some documents; edge kinds: 0 next in line, 1 same key, 2 similar key.

    Hubs are numbered after the nodes; ``sure`` holds the kinds that base spans give a hub.
    """
    doc, where, feats, clamp, edges = [], [], [], [], []
    hub_doc, sure, ties = [], [], []
    for d, (text, base) in enumerate(zip(texts, spans)):
        if not text or _TRIGGER.search(text) is None:
            continue
        ordered = sorted((a, b, k) for k, a, b in base)
        at, last = 0, None
        members: dict[tuple[int, str], list[int]] = {}
        known: dict[tuple[int, str], set[int]] = {}
        longer: dict[tuple[int, str], list[tuple[int, str]]] = {}
        for a, b, k in ordered:
            keys, tails = _keys(text[a:b])
            for own in [*keys, *(tails if k == 3 else ())]:
                known.setdefault(own, set()).add(k + 1)
        for a, b in _nodes(text):
            me = len(doc)
            f, (keys, tails) = _describe(text[a:b]), _keys(text[a:b])
            while at < len(ordered) and ordered[at][1] <= a:
                at += 1
            inside = ordered[at][2] + 1 if at < len(ordered) and ordered[at][0] < b else 0
            doc.append(d)
            where.append((a, b))
            feats.append(f + [17 + inside] if inside else f)
            clamp.append(inside)
            if last is not None and where[last][1] + 1 >= a:
                edges.append((last, me, 0))
            for own in keys:
                members.setdefault(own, []).append(me)
            for own, whole in tails.items():
                longer.setdefault(own, []).append(whole)
            last = me
        # a local number that is not known is similar to the longer ones that end in it, hub to hub
        similar = {own: dict.fromkeys(longer[own]) for own in members if own in longer and own not in known}
        hubs = dict.fromkeys([*similar, *(own for others in similar.values() for own in others)])
        for own, nodes in members.items():
            if len(nodes) == 2 and own not in known and own not in hubs:
                edges.append((*nodes, own[0]))
            elif len(nodes) > 1 or own in known or own in hubs:
                hubs[own] = len(hub_doc)
                ties += [(node, len(hub_doc), own[0]) for node in nodes]
                hub_doc.append(d)
                sure.append(known.get(own, ()))
        ties += [(-1 - hubs[other], hubs[own], 2) for own, others in similar.items() for other in others]
    x = np.zeros((len(doc), FEATURES))
    for i, f in enumerate(feats):
        x[i, f] = 1
    edges += [(node if node >= 0 else len(doc) - 1 - node, len(doc) + hub, kind) for node, hub, kind in ties]
    return {"doc": doc, "where": where, "x": x, "clamp": np.array(clamp, np.int64), "edges": np.array(edges, np.int64).reshape(-1, 3), "hub_doc": hub_doc, "sure": sure}


def _beliefs(graph: dict, weights: dict) -> np.ndarray:
    """Marginals of the nodes by loopy sum-product, all edges at once, each document until its messages stand still.

    A document that still moves has its step halved every PATIENCE rounds; should it
    never settle, mean-field sweeps, which always converge, give its beliefs.
    """
    n = len(graph["doc"])
    unary = np.concatenate([graph["x"] @ weights["unary"], np.zeros((len(graph["hub_doc"]), LABELS))])
    held = np.flatnonzero(graph["clamp"] > 0)
    unary[held] = -HELD
    unary[held, graph["clamp"][held]] = 0
    for hub, kinds in enumerate(graph["sure"], n):
        if kinds:
            unary[hub] = -HELD
            unary[hub, list(kinds)] = 0
    e = graph["edges"]
    log_norm = lambda m: m - np.logaddexp.reduce(m, 1, keepdims=True)
    if not len(e):
        return np.exp(log_norm(unary))[:n]
    owner = np.array([*graph["doc"], *graph["hub_doc"]], np.int64)
    e = e[np.argsort(owner[e[:, 0]], kind="stable")]
    first = np.flatnonzero(np.diff(owner[e[:, 0]], prepend=-1))
    final = np.zeros_like(unary)  # sums of the messages of settled documents
    messages = np.zeros((2, len(e), LABELS))  # down's to up, and up's to down

    def summed(e, messages):
        return np.stack([np.bincount(e[:, 1], messages[0, :, k], len(unary)) + np.bincount(e[:, 0], messages[1, :, k], len(unary)) for k in range(LABELS)], 1)

    rounds, step = 0, 0.5
    while len(e):
        total, pair = unary + summed(e, messages), weights["pair"][e[:, 2]]
        out = log_norm(np.logaddexp.reduce((total[e[:, 0]] - messages[1])[:, :, None] + pair, 1))
        back = log_norm(np.logaddexp.reduce((total[e[:, 1]] - messages[0])[:, None, :] + pair, 2))
        made = np.stack([out, back])
        moving = np.maximum.reduceat(np.abs(made - messages).max((0, 2)), first) >= STILL
        if not moving.all():
            left = np.repeat(moving, np.diff(first, append=len(e)))
            final += summed(e[~left], messages[:, ~left])
            e, messages, made = e[left], messages[:, left], made[:, left]
            first = np.flatnonzero(np.diff(owner[e[:, 0]], prepend=-1))
        messages = messages + step * (made - messages)
        rounds += 1
        if rounds % PATIENCE == 0:
            step /= 2
            if step < LEAST_STEP:
                final += _mean_field(unary, e, weights["pair"])
                break
    return np.exp(log_norm(unary + final))[:n]


def _mean_field(unary: np.ndarray, edges: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """What the edges add to each node in the fixed point of mean-field updates, one node after another, so that free energy never rises."""
    near: dict[int, list[tuple[int, np.ndarray]]] = {}
    for a, b, k in edges.tolist():
        near.setdefault(a, []).append((b, pair[k].T))
        near.setdefault(b, []).append((a, pair[k]))
    soft = lambda s: np.exp(s - np.logaddexp.reduce(s))
    belief = {i: soft(unary[i]) for i in near}
    added = np.zeros_like(unary)
    change = STILL
    while change >= STILL:
        change = 0.0
        for i, others in near.items():
            added[i] = sum(belief[j] @ table for j, table in others)
            made = soft(unary[i] + added[i])
            change = max(change, float(np.abs(made - belief[i]).max()))
            belief[i] = made
    return added


def _generated(seed: int, documents: int) -> tuple[list[str], list[list[tuple[int, int, int]]]]:
    """Documents with known spans: entities, other spellings of them, and look-alikes."""
    r = random.Random(seed)
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    word = lambda: "".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 9)))
    texts, spans = [], []
    for _ in range(documents):
        parts: list[tuple[str, int]] = []
        for _ in range(r.randint(1, 4)):
            kind = r.randrange(9)
            if kind == 0:
                a, h = word() + digits(1), f"{word()}.example.org"
                parts += [(f"{a}@{h}", 1)] + [(r.choice([f"{a}@{h.split('.')[0]}", f"{a}@{h}".upper()]), 1)] * (r.random() < 0.6)
            elif kind == 1:
                q = [str(r.randint(0, 255)) for _ in range(4)]
                parts += [(".".join(q), 2)] + [("-".join(q), 2)] * (r.random() < 0.6)
            elif kind == 2:
                c = "4" + digits(14)
                c += next(x for x in "0123456789" if luhn(c + x))
                parts += [(c, 3)] * r.randint(1, 2) + [(r.choice(["", "", f"{word()}{r.choice('=:.')}"]) + ".".join(c[k : k + 4] for k in range(0, 16, 4)), 3)] * (r.random() < 0.6)
            elif kind == 3:
                a, b, c = digits(3), digits(3), digits(4)
                parts += [(f"+1 ({a}) {b}-{c}", 4)] + [(r.choice([f"{a}-{b}-{c}", f"1 ({a}) {b}-{c}", f"1.{a}.{b}.{c}", f"{word()}{r.choice(':.=')}{a}-{b}-{c}", f"{word()}{r.choice(':.=')}{a}{b}{c}", f"{b}-{c}", f"{b}{c}"]), 4)] * (r.random() < 0.6)
            elif kind == 4:
                d = digits(r.choice([9, 10, 13, 16, 17, 20]))
                parts += [(d, 0)] * (1 if luhn(d) else r.randint(1, 3))
            elif kind == 5:
                parts += [("@" + word(), 0)] * r.randint(1, 2)
            elif kind == 6:
                parts.append(("".join(r.choice("0123456789abcdef") for _ in range(r.choice([8, 32, 40]))), 0))
            elif kind == 7:
                parts.append((f"{r.randint(1, 12)}.{r.randint(0, 30)}.{r.randint(0, 99)}", 0))
            else:
                parts += [(r.choice([digits(r.randint(1, 8)), f"{word()}{r.choice(':.=')}{digits(r.randint(7, 12))}", f"{digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"{digits(4)}-{digits(2)}-{digits(2)}"]), 0)] * r.randint(1, 2)
        r.shuffle(parts)
        text, own = "", []
        for value, label in parts:
            text += " ".join(word() for _ in range(r.randint(0, 3)))
            text += " " if text and not text.endswith(" ") else ""
            if label:
                own.append((label - 1, len(text), len(text) + len(value)))
            text += value + " "
        texts.append(text)
        spans.append(own)
    return texts, spans


def _true_labels(graph: dict, spans: list[list[tuple[int, int, int]]]) -> np.ndarray:
    y = np.zeros(len(graph["doc"]), np.int64)
    for i, (d, (a, b)) in enumerate(zip(graph["doc"], graph["where"])):
        for k, s, e in spans[d]:
            if s < b and a < e:
                y[i] = k + 1
    return y


def _hub_labels(graph: dict, y: np.ndarray) -> np.ndarray:
    """A hub's true label: the commonest of its nodes'."""
    n, e = len(y), graph["edges"]
    e = e[(e[:, 1] >= n) & (e[:, 0] < n)]
    votes = np.zeros((len(graph["hub_doc"]), LABELS))
    np.add.at(votes, (e[:, 1] - n, y[e[:, 0]]), 1)
    return votes.argmax(1)


@lru_cache(maxsize=4)
def trained(seed: int = 11, documents: int = 1500, steps: int = 250, rate: float = 0.5, l2: float = 1e-3) -> dict:
    """Weights by pseudo-likelihood: each node's label given the true labels of its neighbours."""
    texts, spans = _generated(seed, documents)
    graph = _graph(texts, [base_spans(t) for t in texts])
    y, e = _true_labels(graph, spans), graph["edges"]
    hubs = _hub_labels(graph, y)
    x = np.concatenate([graph["x"], np.zeros((len(hubs), FEATURES))])
    free = np.concatenate([graph["clamp"] == 0, [not kinds for kinds in graph["sure"]]])[:, None] * 1.0
    n = len(y)
    y = np.concatenate([y, hubs])
    around = np.zeros((3, 2, len(y), LABELS))  # edge kind, side, node: labels of neighbours
    np.add.at(around, (e[:, 2], 0, e[:, 1], y[e[:, 0]]), 1)
    np.add.at(around, (e[:, 2], 1, e[:, 0], y[e[:, 1]]), 1)
    unary, pair = np.zeros((FEATURES, LABELS)), np.zeros((3, LABELS, LABELS))
    target = np.eye(LABELS)[y]
    m1 = m2 = None
    for step in range(1, steps + 1):
        score = x @ unary
        for k in range(3):
            score += around[k, 0] @ pair[k] + around[k, 1] @ pair[k].T
        p = np.exp(score - np.logaddexp.reduce(score, 1, keepdims=True))
        d = (target - p) * (0.1 + 0.9 * free)
        gu = x.T @ d / n - l2 * unary
        gp = np.stack([around[k, 0].T @ d + (around[k, 1].T @ d).T for k in range(3)]) / n - l2 * pair
        g = np.concatenate([gu.ravel(), gp.ravel()])
        m1 = g if m1 is None else 0.9 * m1 + 0.1 * g
        m2 = g * g if m2 is None else 0.99 * m2 + 0.01 * g * g
        move = rate * (0.2 if step < steps // 2 else 0.05) * m1 / (np.sqrt(m2) + 1e-8)
        unary += move[: unary.size].reshape(unary.shape)
        pair += move[unary.size :].reshape(pair.shape)
    return {"unary": unary, "pair": pair}


def find(texts: list[str | None]) -> tuple[list[list[tuple[int, int, int]]], list[list[tuple[int, int, int]]]]:
    """(base spans, added spans) of each text."""
    texts = [t or "" for t in texts]
    base = [base_spans(t) for t in texts]
    graph = _graph(texts, base)
    added: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if graph["doc"]:
        p = _beliefs(graph, trained())
        best = p.argmax(1)
        for i in np.flatnonzero((best > 0) & (graph["clamp"] == 0) & (p.max(1) >= SURE)):
            d, kind = graph["doc"][i], int(best[i]) - 1
            a, b = _core(texts[d], *graph["where"][i], kind)
            if a < b:
                added[d].append((kind, a, b))
    return base, added


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def detect(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all) and n_added."""
    names = [f"n_{k}" for k in KINDS] + ["base_sha256", "spans", "n_added"]

    @F.arrow_udf(", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_added long")
    def detected(batch: pa.Array) -> pa.Array:
        base, added = find(batch.to_pylist())
        columns = [pa.array([sum(s[0] == k for s in b) for b in base], pa.int64()) for k in range(len(KINDS))]
        columns.append(pa.array([hashlib.sha256(_joined(b).encode()).hexdigest() for b in base], pa.string()))
        columns.append(pa.array([_joined(b + a) for b, a in zip(base, added)], pa.string()))
        columns.append(pa.array([len(a) for a in added], pa.int64()))
        return pa.StructArray.from_arrays(columns, names)

    out = df.withColumn("_p", detected(text))
    for c in names:
        out = out.withColumn(c, F.col(f"_p.{c}"))
    return out.drop("_p")


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span (or union of overlapping spans) as <KIND>, the kind of the one that starts first."""
    out, at = [], 0
    for a, b, k in sorted((a, b, k) for k, a, b in spans):
        if a >= at:
            out += [text[at:a], f"<{KINDS[k].upper()}>"]
        at = max(at, b)
    return "".join(out) + text[at:]


def mask(df: DataFrame, text: str = "text") -> DataFrame:
    """The text with personal data replaced by the name of its kind."""

    @F.arrow_udf("string")
    def hidden(batch: pa.Array) -> pa.Array:
        values = batch.to_pylist()
        base, added = find(values)
        return pa.array([t if t is None or not (b or a) else masked(t, b + a) for t, b, a in zip(values, base, added)], pa.string())

    return df.withColumn(text, hidden(text))
