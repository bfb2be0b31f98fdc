"""Personal data in whole texts: fixed patterns, and a skip-chain conditional random field that adds what they miss.

The patterns find emails, IP addresses, card and phone numbers.  Tokens that hold a digit or an at sign are the nodes of a
conditional random field: neighbours in the text share a chain potential, and mentions of one thing, however far apart in
the document, share a skip potential.  A mention is a token or a few neighbouring ones; two are the same if their digits
(or their lower-cased letters) are, and similar if their last eight digits are or one digit differs.  Every mention is
joined to the first one, so edges grow with the tokens and a label reaches all repeats in two steps.

What the patterns find teaches the field, and so do echoes: some documents of the sample get, at their end, mentions of
their own numbers in forms that no pattern knows (bare digits, spaces, slashes), and as many strange numbers in the same
forms.  An echo has the label of what it repeats, a strange number none, and nothing but the skip edge tells them apart, so
it is the skip weights that have to carry the label.
Numbers of the sample that repeat a pattern's find without being one teach nothing: what they are is what is asked.

What the patterns find is given; loopy message passing runs until the messages stand still.  Runs of tokens that the field labels, that are well-formed and
that no pattern covers become further spans.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: Documents that a fit reads at most, and the longest text among them in bytes.
SAMPLE, LONGEST = 1500, 32_768
#: Probability from which a label counts.
SURE = 0.6
#: What a pattern's find adds to a label's score.
CERTAIN = 1e6
#: Message passing ends when no message changes by more than ``STILL``, or after ``ROUNDS`` rounds.
ROUNDS, STILL = 200, 1e-3
#: Tokens of a mention at most, its digits, and digits by which longer ones are similar.
TOKENS, LEAST_DIGITS, MOST_DIGITS, ENDING = 6, 7, 19, 8

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ANY = re.compile(r"[0-9@]")
NODE = re.compile(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+")
DIGITS = re.compile(r"[0-9]+")
NUMBER = re.compile(r"\+?[0-9()./-]*[0-9][0-9()./-]*")
TRIM = "\"'.,;:!?<>[]{}|"


def luhn(digits: str) -> bool:
    total = sum(int(c) for c in digits[-1::-2]) + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(c)] for c in digits[-2::-2])
    return total % 10 == 0


def small_parts(text: str) -> bool:
    return all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in text.split(".")))


def base_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """The patterns' spans as (kind, start, end), in order, and the extents of candidates that a test dropped."""
    found, dropped = [], []
    at = text.find("@")
    done = 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((0, start, m.end()))
        done = m.end() if m else at + 1
        at = text.find("@", done)
    for m in IP.finditer(text):
        (found.append((1, *m.span())) if small_parts(m[0]) else dropped.append(m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            d = m[0].replace(" ", "").replace("-", "") if m.end() - m.start() < 64 else ""
            if 16 <= len(d) <= 19 and luhn(d):
                found.append((2, *m.span()))
            elif len(d) >= 16 or not d:
                dropped.append(m.span())
    for m in PHONE.finditer(text):
        n = sum(map(len, DIGITS.findall(m[0])))
        (found.append((3, *m.span())) if 8 <= n <= 15 else dropped.append(m.span()))
    return sorted(found), dropped


FEATURES = 30


def features(core: str, gap: bool) -> list[int]:
    """Indices of the features that hold for a token; ``gap``: no node stands directly before it."""
    n = sum(map(len, DIGITS.findall(core)))
    out = [0, 1 + (n if n < 4 else 4 if n < 7 else 5 if n < 10 else 6 if n < 13 else 7 if n < 16 else 8 if n < 20 else 9)]
    tests = (
        "@" in core,
        0 < core.find("@") < core.rfind("."),
        core.count(".") == 3 and n + 3 == len(core),
        core[:1] == "+",
        "(" in core or ")" in core,
        "-" in core,
        n == len(core),
        any(c.isalpha() for c in core),
        n > 0 and n + core.count("-") + core.count(".") + core.count("(") + core.count(")") + core.count("+") == len(core),
        gap,
        len(core) > 30,
        "=" in core or "/" in core,
        core.count(".") == 1,
        n == len(core) and n == 16,
        core[:1] == "+" and n <= 3,
        "-" in core and 6 <= n <= 8,
        core[:1] == "(" and core[-1:] == ")",
        n == 0,
    )
    return out + [11 + k for k, x in enumerate(tests) if x]


def covered(places: list[tuple[int, int]], spans: list[tuple[int, int, int]]) -> list[int]:
    """Of each place the kind of a span that it shares a character with, or -1."""
    if not spans or not places:
        return [-1] * len(places)
    kind, start, end = np.array(sorted(spans, key=lambda s: s[1]), int).T
    at = np.array(places, int)
    reach = np.maximum.accumulate(end)  # of the spans up to one, the end that goes furthest, and whose it is
    whose = np.maximum.accumulate(np.where(end == reach, np.arange(len(end)), 0))
    last = np.searchsorted(start, at[:, 1]) - 1
    return np.where((last >= 0) & (reach[last] > at[:, 0]), kind[whose[last]], -1).tolist()


class Graph:
    """Nodes and edges of several documents together; ``skip`` has mentions of the same, ``like`` similar ones.

    ``given``: of each node the kind of the pattern's span that covers it, or -1.
    """

    def __init__(self):
        self.x, self.cores, self.places, self.doc, self.given = [], [], [], [], []
        self.chain, self.skip, self.like = [], [], []

    def add(self, doc: int, text: str, spans: list[tuple[int, int, int]] = ()) -> None:
        last_end, last, begin = -2, -1, len(self.x)
        for m in NODE.finditer(text):
            left = len(m[0]) - len(m[0].lstrip(TRIM))
            core = m[0].strip(TRIM)
            if not core:
                continue
            k = len(self.x)
            start = m.start() + left
            near = last >= 0 and m.start() - last_end <= 1
            self.x.append(features(core, not near))
            self.cores.append(core)
            self.places.append((start, start + len(core)))
            self.doc.append(doc)
            if near:
                self.chain.append((last, k))
            last, last_end = k, m.end()
        self.given += covered(self.places[begin:], spans)
        self._mentions(begin)

    def _mentions(self, begin: int) -> None:
        """Skip edges of the nodes from ``begin`` on: each mention's tokens with the first token of the first one like it.

        Mentions that a pattern has found come first, so that what is known of a thing stands between all its mentions.
        """
        first: dict[tuple, tuple[int, int, str]] = {}
        seen: set[tuple[int, int]] = set()
        joined = {b for _, b in self.chain[-(len(self.x) - begin) :]} if len(self.x) > begin else set()

        def meet(key: tuple, a: int, z: int, digits: str, edges: list, same=None) -> None:
            u, v, other = first.setdefault(key, (a, z, digits))
            if (v <= a or z <= u) and (same is None or same(digits, other)):
                for k in range(a, z):
                    if (u, k) not in seen:
                        seen.add((u, k))
                        edges.append((u, k))

        one_differs = lambda x, y: x != y and sum(map(str.__ne__, x, y)) == 1
        for a in sorted(range(begin, len(self.x)), key=lambda k: self.given[k] < 0):
            core = self.cores[a]
            if "@" in core or not NUMBER.fullmatch(core):
                if len(core) >= 4:
                    meet(("word", core.lower()), a, a + 1, "", self.skip)
                continue
            digits = ""
            for z in range(a, min(a + TOKENS, len(self.x))):
                if z > a and (z not in joined or self.cores[z][:1] == "+" or not NUMBER.fullmatch(self.cores[z])):
                    break
                digits += "".join(DIGITS.findall(self.cores[z]))
                if len(digits) > MOST_DIGITS:
                    break
                if len(digits) >= LEAST_DIGITS:
                    meet(("digits", digits), a, z + 1, digits, self.skip)
                    if len(digits) > ENDING:
                        meet(("ending", digits[-ENDING:]), a, z + 1, digits, self.like)
            whole = "".join(DIGITS.findall(core))
            if ENDING <= len(whole) <= MOST_DIGITS:  # one wrong digit leaves one half as it is
                half = len(whole) // 2
                meet(("left", len(whole), whole[:half]), a, a + 1, whole, self.like, one_differs)
                meet(("right", len(whole), whole[half:]), a, a + 1, whole, self.like, one_differs)

    def edges(self) -> tuple[np.ndarray, ...]:
        return tuple(np.array(e, int).reshape(-1, 2) for e in (self.chain, self.skip, self.like))

    def matrix(self) -> np.ndarray:
        out = np.zeros((len(self.x), FEATURES))
        for i, on in enumerate(self.x):
            out[i, on] = 1
        return out


LABELS = len(KINDS) + 1


class Field:
    """Weights of features, and of the labels at the two ends of a chain, skip or similarity edge (the latter two alike both ways)."""

    def __init__(self):
        self.unary = np.zeros((FEATURES, LABELS))
        self.chain, self.skip, self.like = (np.zeros((LABELS, LABELS)) for _ in range(3))

    def fit(self, graph: Graph, y: np.ndarray, known: np.ndarray, rounds: int = 600, rate: float = 0.08, decay: float = 2e-4) -> Field:
        """Pseudo-likelihood: each known node given its known neighbours' labels, all weights by Adam on the whole sample."""
        x, hot = graph.matrix(), np.eye(LABELS)[y]
        parts = [(e[known[e].all(1)], w) for e, w in zip(graph.edges(), (self.chain, self.skip, self.like), strict=True)]
        # how often a node's neighbours, at either end of its edges, have each label
        near = [tuple(np.stack([np.bincount(e[y[e[:, a]] == k, b], minlength=len(y)) for k in range(LABELS)], 1).astype(float) for a, b in ((0, 1), (1, 0))) for e, _ in parts]
        weights = [self.unary, self.chain, self.skip, self.like]
        m, v = [0.0] * 4, [0.0] * 4
        n = max(1, known.sum())
        for t in range(1, rounds + 1):
            z = x @ self.unary
            for (ahead, behind), (_, w) in zip(near, parts, strict=True):
                z += ahead @ w + behind @ w.T
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            d = (p - hot) * known[:, None] / n
            grads = [x.T @ d] + [(hot[e[:, 0]].T @ d[e[:, 1]]) + (d[e[:, 0]].T @ hot[e[:, 1]]) for e, _ in parts]
            for k in (2, 3):
                grads[k] = grads[k] + grads[k].T
            for k, (w, g) in enumerate(zip(weights, grads, strict=True)):
                g = g + decay * w / 10
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.99 * v[k] + 0.01 * g * g
                w -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)
        return self

    def marginals(self, graph: Graph, rounds: int = ROUNDS) -> np.ndarray:
        """Loopy sum-product with damped messages, all edges at once, until they stand still.

        What a pattern has found is not asked again.
        """
        unary, given = graph.matrix() @ self.unary, np.array(graph.given, int)
        at = np.flatnonzero(given >= 0)
        unary[at, given[at]] += CERTAIN
        parts = [(e, w) for e, w in zip(graph.edges(), (self.chain, self.skip, self.like), strict=True)]
        edges = np.concatenate([e for e, _ in parts])
        n = len(edges)
        belief = unary
        if n:
            w = np.concatenate([np.broadcast_to(w, (len(e), LABELS, LABELS)) for e, w in parts])
            source, target = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
            w = np.concatenate([w, w.transpose(0, 2, 1)])
            back = np.concatenate([np.arange(n, 2 * n), np.arange(n)])
            message = np.zeros((2 * n, LABELS))
            for _ in range(rounds):
                out = (belief[source] - message[back])[:, :, None] + w
                top = out.max(1)
                new = np.log(np.exp(out - top[:, None, :]).sum(1)) + top
                new -= new.max(1, keepdims=True)
                moved = np.abs(new - message).max()
                message = 0.5 * message + 0.5 * new
                belief = unary + np.stack([np.bincount(target, message[:, k], len(unary)) for k in range(LABELS)], 1)
                if moved < STILL:
                    break
        p = np.exp(belief - belief.max(1, keepdims=True)) if len(belief) else belief
        return p / p.sum(1, keepdims=True) if len(p) else p


def sane(kind: int, text: str) -> bool:
    """An exact check of what the field proposes."""
    n = sum(map(len, DIGITS.findall(text)))
    if kind == 0:
        m = DOMAIN.match(text, text.find("@") + 1)
        return text.count("@") == 1 and m is not None and m.end() == len(text) and 0 < text.find("@")
    if kind == 1:
        return bool(IP.fullmatch(text)) and small_parts(text)
    if kind == 2:
        d = "".join(DIGITS.findall(text))
        return 16 <= len(d) <= 19 and luhn(d) and re.fullmatch(r"[0-9](?:[\x20./-]?[0-9])+", text) is not None
    return 8 <= n <= 15 and bool(re.fullmatch(r"\+?[0-9(][\x20()./0-9-]+[0-9]", text))


def further_spans(texts: list[str], bases: list[list[tuple[int, int, int]]], field: Field) -> list[list[tuple[int, int, int]]]:
    """Of each text, the field's spans that overlap none of the patterns' spans."""
    graph = Graph()
    for i, t in enumerate(texts):
        graph.add(i, t, bases[i])
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not graph.x:
        return out
    p = field.marginals(graph)
    label = np.where(p[:, :-1].max(1) >= SURE, p.argmax(1), LABELS - 1).tolist()
    joined = {b: a for a, b in graph.chain}
    k, n = 0, len(label)
    while k < n:
        kind = label[k]
        j = k + 1
        # tokens of a phone or a spaced card belong together; emails and addresses are one token each
        while kind in (2, 3) and j < n and joined.get(j) == j - 1 and label[j] == kind and graph.cores[j][:1] != "+":
            j += 1
        if kind < LABELS - 1:
            i, start, end = graph.doc[k], graph.places[k][0], graph.places[j - 1][1]
            if max(graph.given[k:j]) < 0 and sane(kind, texts[i][start:end]):
                out[i].append((kind, start, end))
        k = j
    return out


def fit(docs: DataFrame, sample: int = SAMPLE, longest: int = LONGEST) -> Field:
    """A field fitted on the ``sample`` documents, of those with a digit or an at sign, with the smallest hash of their id."""
    usable = docs.filter(F.octet_length("text") <= longest).filter(F.col("text").rlike("[0-9@]")).select("doc_id")
    ids = [r.doc_id for r in usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect() if r.doc_id is not None]  # at most ``sample`` numbers
    field, graph = Field(), Graph()
    if not ids:
        return field
    small = F.broadcast(docs.sparkSession.createDataFrame([(i,) for i in sorted(set(ids))], "doc_id long"))
    texts = [r._text for r in docs.filter(F.octet_length("text") <= longest).join(small, "doc_id", "left_semi").groupBy("doc_id").agg(F.max("text").alias("_text")).orderBy("doc_id").collect()]
    y, known = [], []
    for i, t in enumerate(texts):
        base, dropped = base_spans(t)
        text, spans = with_echoes(t, base) if i % 2 == 0 else (t, [])
        graph.add(i, text, base)
        begin = len(y)
        found = {"".join(DIGITS.findall(t[s:e])) for k, s, e in base if k in (2, 3)}
        for k in range(begin, len(graph.x)):
            a, b = graph.places[k]
            hit = [kind for kind, s, e in (base if a < len(t) else spans) if s < b and a < e]
            digits = "".join(DIGITS.findall(graph.cores[k]))
            asked = not hit and a < len(t) and len(digits) >= LEAST_DIGITS and any(digits in f or f in digits for f in found)
            y.append(hit[0] if hit else LABELS - 1)
            known.append(bool(hit) or not asked and not (a < len(t) and any(s < b and a < e for s, e in dropped)))
    return field.fit(graph, np.array(y, int), np.array(known, bool)) if y else field


def with_echoes(text: str, base: list[tuple[int, int, int]]) -> tuple[str, list[tuple[int, int, int]]]:
    """The text with mentions of its own numbers and of strange ones behind it, in forms that no pattern knows, and their labels."""
    numbers = [(kind, "".join(DIGITS.findall(text[s:e]))) for kind, s, e in base if kind in (2, 3)]
    other = [m[0] for m in re.finditer(r"(?<![0-9+(.@/-])[0-9]{7,19}(?![0-9.@/-])", text) if not any(s < m.end() and m.start() < e for _, s, e in base)]
    out, labels, size = [text], [], len(text)

    def say(form: str, kind: int) -> None:
        nonlocal size
        out.append(f" see {form}")
        labels.append((kind, size + 5, size + 5 + len(form)))
        size += 5 + len(form)

    for n, (kind, digits) in enumerate(numbers + [(LABELS - 1, d) for d in other]):
        gap = (2, 3, 4)[n % 3]
        split = lambda d: ("/" if kind == 2 else " ").join(d[i : i + gap] for i in range(0, len(d), gap))  # noqa: B023, E731
        shapes = [split] if kind == 2 else [str, split]  # bare digits of a card are one for the pattern too
        strange = "".join(str(x % 10) for x in hashlib.md5(digits.encode()).digest())  # a number that repeats nothing
        for k, shape in enumerate(shapes):
            say(shape(digits), kind)
            decoy = strange[k : k + len(digits)]
            say(shape(decoy), LABELS - 1)
            if n % 2:
                say(shape(decoy), LABELS - 1)
        if kind == 3 and len(digits) > ENDING + 2:
            say(digits[-ENDING - 1 :], kind)
            say(digits[:-1] + str((int(digits[-1]) + 1) % 10), kind)
            say(strange[-ENDING - 1 :], LABELS - 1)
    return "".join(out), labels


SPANS = "doc_id long, base array<struct<kind:int,start:int,end:int>>, further array<struct<kind:int,start:int,end:int>>"


def find_personal_data(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """``SPANS`` of each row of ``docs``: code points, end exclusive, in order of kind (an index of ``KINDS``) and start.

    Null texts are empty.  Rows that repeat an id are searched each on its own; an empty table gives no rows; no other
    column is read; a text of any length is searched whole.
    """
    field = fit(docs) if field is None else field

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
        for b in batches:
            for at in range(0, b.num_rows, 512):
                texts = [t or "" for t in b.column(1).slice(at, 512).to_pylist()]
                base: list[list] = [[]] * len(texts)
                more: list[list] = [[]] * len(texts)
                some = [i for i, t in enumerate(texts) if ANY.search(t)]
                for i in some:
                    base[i] = base_spans(texts[i])[0]
                for i, found in zip(some, further_spans([texts[i] for i in some], [base[i] for i in some], field), strict=True):
                    more[i] = found
                rows = [[[dict(zip(("kind", "start", "end"), s, strict=True)) for s in x] for x in part] for part in (base, more)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, 512).cast(pa.int64()), pa.array(rows[0], spans), pa.array(rows[1], spans)], names=["doc_id", "base", "further"])

    return docs.select("doc_id", "text").mapInArrow(find, SPANS)


def digest(found: DataFrame) -> DataFrame:
    """Counts of the patterns' spans, the SHA-256 of their list, and the list of all spans."""
    kinds = F.array(*map(F.lit, KINDS))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return found.select("doc_id", *map(count, range(len(KINDS))), F.sha2(text(F.col("base")), 256).alias("base_sha256"), text(F.array_sort(F.concat("base", "further"))).alias("spans"))
