"""Personal data: a rule base, widened by a semi-Markov conditional random field.

Base spans, leftmost and non-overlapping for each kind:

* email ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``
* ip    ``[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)``, parts at most 255
* card  ``[0-9]([\\x20-]?[0-9])+``, 12 to 19 digits that pass Luhn
* phone ``\\+[0-9][\\x20().0-9-]+[0-9]``, 9 to 15 digits

A match that fails its test is dropped and not tried again at another place.
The searches below start only where a match can start, which leaves the result
as it is and keeps them linear on long runs of letters or digits.

The model reads the stretches around digits and at-signs, also spelt-out ones:
``(at)``, ``[at]``, and `` at `` before a domain with a dot, plain or spelt out. Their tokens are
segmented jointly, ``LONGEST`` tokens on both sides of such a core: each segment is one token that belongs to no entity, or an
entity of up to ``LONGEST`` tokens with a kind. Features describe the whole span:
its shape, digit count, Luhn and address tests, and the characters on both sides.
Training maximises the likelihood of whole segmentations (forward-backward
over segments, AdaGrad, L2) on a seeded set of sentences made here, in which
entities also come in forms that the rules don't know: telephone numbers without
a country code, addresses with a spelt-out at-sign. Decoding is the best
segmentation by dynamic programming. Its entities are added unless they overlap
a base span; base spans always stay.

A null text is empty. Repeated rows are reported each. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import random
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrasift.llm import _common as C

KINDS = ("email", "ip", "card", "phone")
#: Tokens of the longest entity, the bound of the dynamic program; base spans have none.
LONGEST = 16
#: A span of more digits that is no address is of no kind: cards have 19 at most, telephone numbers 15.
DIGITS = 24

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_SOME = re.compile(r"[0-9@]").search

Span = tuple[int, int, int]  # start, index of the kind, end


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    last, before, at = 0, 0, text.find("@")
    while at >= 0:
        head = text[max(last, before) : at]
        local = len(head) - len(head.rstrip(_LOCAL))
        m = _DOMAIN.match(text, at + 1) if local else None
        if m:
            yield at - local, m.end()
            last = m.end()
        before, at = at + 1, text.find("@", at + 1)


def base_spans(text: str) -> list[Span]:
    """Base spans by start, then kind as listed."""
    if not _SOME(text):
        return []
    out = [(a, 0, b) for a, b in _emails(text)]
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        d = _digits(m.group())
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return sorted(out)


# ------------------------------------------------------- stretches and spans

_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9]")
_CORE = re.compile(r"[0-9@]+")
_SPELT = re.compile(r"\(at\)|\[at\]| at (?=[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]| ?(?:\(dot\)|\[dot\]) ?[A-Za-z0-9-]| dot [A-Za-z0-9-]))")
# what an entity may have before and after a core: as many tokens as an entity has at most
_LEFT = regex.compile(rf"(?r)(?:[A-Za-z]+|[0-9]+|[._%+()\[\] -]){{0,{LONGEST}}}+")
_RIGHT = regex.compile(rf"(?:[A-Za-z]+|[0-9]+|[.()\[\] -]){{0,{LONGEST}}}+")


def _cores(text: str) -> list[tuple[int, int]]:
    """Places of digits, at-signs and spelt-out at-signs; the last are searched only where their letters stand."""
    cores = [m.span() for m in _CORE.finditer(text)]
    if "(at)" in text or "[at]" in text or " at " in text:
        cores = sorted(cores + [m.span() for m in _SPELT.finditer(text)])
    return cores


def stretches(text: str) -> list[tuple[int, int]]:
    """Parts of the text around digits and at-signs, each core with what an entity may have around it."""
    out: list[list[int]] = []
    for start, end in _cores(text):
        a = _LEFT.match(text, out[-1][1] if out else 0, max(start, out[-1][1] if out else 0)).start()
        b = _RIGHT.match(text, end).end()
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _side(c: str) -> str:
    return "edge" if not c else "space" if c.isspace() else "digit" if c.isdigit() else "letter" if c.isalpha() else c if c in ".,;:+-@_/=" else "other"


def _shape(s: str) -> str:
    return re.sub(r"[A-Za-z]+", "w", re.sub(r"[0-9]+", lambda m: f"<{min(len(m.group()), 20)}>", s))[:40]


_MAIL_LIKE = re.compile(r"[A-Za-z0-9._%+-]+ ?(@|\(at\)|\[at\]| at ) ?[A-Za-z0-9-]+(?: ?(?:\.|\(dot\)|\[dot\]| dot ) ?[A-Za-z0-9-]+)+")
_QUAD = re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}")


def _span_features(s: str, left: str, right: str) -> tuple[str, ...]:
    d = _digits(s)
    out = [f"L:{left}", f"R:{right}", f"n:{min(len(d), 20)}", f"first:{_side(s[0])}", f"last:{_side(s[-1])}"]
    out.append(f"shape:{_shape(s)}")
    mail = _MAIL_LIKE.fullmatch(s)
    out += ["mail"] if mail else ["no-mail"]
    out += ["quad"] if _QUAD.fullmatch(s) and all(int(p) < 256 for p in s.split(".")) else ["no-quad"]
    plain = not any(c.isalpha() for c in s)
    if plain and 12 <= len(d) <= 19:
        out.append("luhn" if luhn(d) and "." not in s and "(" not in s else "no-luhn")
    if plain:
        groups = tuple(len(g) for g in re.findall("[0-9]+", s))
        out.append("groups:" + "-".join(map(str, groups[-3:])))
        out.append("area" if re.fullmatch(r"(?:\+[0-9]{1,3}[ .-]?)?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-][0-9]{4}", s) else "no-area")
    else:
        out.append("letters")
    return tuple(out)


_remembered = lru_cache(maxsize=100_000)(_span_features)


class Lattice:
    """The candidate segments of one stretch: (from token, to token, kind or -1, features)."""

    def __init__(self, text: str, a: int, b: int):
        self.text = text
        self.starts = array("q", (a + m.start() for m in _TOKEN.finditer(text[a:b])))
        self.ends = array("q", [*self.starts[1:], b]) if self.starts else array("q")
        self.n = len(self.starts)

    def at(self, i: int) -> Iterator[tuple[int, int, int, tuple[str, ...]]]:
        """The segments that start at token i, made anew at each call, so that a long stretch is never held whole."""
        text, starts, ends = self.text, self.starts, self.ends
        x = starts[i]
        t = text[x : ends[i]]
        yield i, i + 1, -1, ("o", f"o:{_shape(t[:64])}")
        if t.isspace() or t in ".,)]-":
            return
        digits, has_at = 0, False
        for j in range(i, min(self.n, i + LONGEST)):
            u = text[starts[j] : ends[j]]
            if u.isdigit():
                digits += len(u)
            has_at |= u in ("@", "at")
            if u.isspace() or u in ".,([-" or not (digits >= 7 or (digits >= 4 and j - i >= 6) or has_at):
                continue
            if digits > DIGITS and not has_at:
                continue
            s = text[x : ends[j]]
            features = (_remembered if len(s) <= 64 else _span_features)(s, _side(text[x - 1 : x] if x else ""), _side(text[ends[j] : ends[j] + 1]))
            for k in range(4):
                if (k == 0) == has_at:
                    yield i, j + 1, k, features

    def __iter__(self) -> Iterator[tuple[int, int, int, tuple[str, ...]]]:
        """All segments, by start."""
        for i in range(self.n):
            yield from self.at(i)


class SemiCRF:
    """Weights of (kind, feature); a segment scores the sum of its own."""

    def __init__(self):
        self.weights: dict[tuple[int, str], float] = {}

    def _score(self, segment) -> float:
        get, k = self.weights.get, segment[2]
        return sum(get((k, f), 0.0) for f in segment[3])

    def fit(self, data: list[tuple[Lattice, set[tuple[int, int, int]]]], epochs: int = 6, rate: float = 0.5, decay: float = 1e-4) -> SemiCRF:
        seen: dict[tuple[int, str], float] = {}
        order = random.Random(5)
        for _ in range(epochs):
            order.shuffle(data)
            for lattice, gold in data:
                segments = list(lattice)
                scores = [self._score(x) for x in segments]
                forward = np.full(lattice.n + 1, -np.inf)
                backward = np.full(lattice.n + 1, -np.inf)
                forward[0] = backward[lattice.n] = 0.0
                for (i, j, _, _), s in zip(segments, scores, strict=True):  # segments come by start
                    forward[j] = np.logaddexp(forward[j], forward[i] + s)
                for (i, j, _, _), s in zip(reversed(segments), reversed(scores), strict=True):
                    backward[i] = np.logaddexp(backward[i], backward[j] + s)
                total = forward[lattice.n]
                inside = np.zeros(lattice.n, bool)
                for i, j, _ in gold:
                    inside[i:j] = True
                gradient: dict[tuple[int, str], float] = {}
                for (i, j, k, features), s in zip(segments, scores, strict=True):
                    true = (i, j, k) in gold if k >= 0 else not inside[i]
                    g = float(true) - float(np.exp(forward[i] + s + backward[j] - total))
                    if abs(g) > 1e-6:
                        for f in features:
                            gradient[k, f] = gradient.get((k, f), 0.0) + g
                for key, g in gradient.items():
                    g -= decay * self.weights.get(key, 0.0)
                    seen[key] = seen.get(key, 1e-8) + g * g
                    self.weights[key] = self.weights.get(key, 0.0) + rate * g / seen[key] ** 0.5
        return self

    def decode(self, lattice: Lattice) -> list[Span]:
        """The entities of the best segmentation; ties fall to the segment tried first."""
        best = array("d", [0.0, *[float("-inf")] * lattice.n])
        back, kind = array("q", [0]) * (lattice.n + 1), array("b", [-1]) * (lattice.n + 1)
        for segment in lattice:
            i, j, k, _ = segment
            s = best[i] + self._score(segment)
            if s > best[j]:
                best[j], back[j], kind[j] = s, i, k
        out, j = [], lattice.n
        while j:
            if kind[j] >= 0:
                out.append((lattice.starts[back[j]], kind[j], lattice.ends[j - 1]))
            j = back[j]
        return out[::-1]


# ------------------------------------------------------------------ training


def training_set(n: int = 700, seed: int = 3) -> list[tuple[str, list[Span]]]:
    """Sentences with the spans of their entities, made from a seed."""
    r = random.Random(seed)
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda lo=2, hi=9: "".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(r.randint(lo, hi)))

    def card() -> str:
        d = r.choice("3456") + num(r.choice((14, 14, 14, 13)))
        d += next(c for c in "0123456789" if luhn(d + c))
        return d if r.random() < 0.6 or len(d) != 16 else r.choice(" -").join(d[i : i + 4] for i in range(0, 16, 4))

    def phone() -> str:
        a, b, c = num(3), num(3), num(4)
        return r.choice((f"+1 ({a}) {b}-{c}", f"+{r.randint(1, 99)} {a} {b} {c}", f"+1-{a}-{b}-{c}", f"({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}"))

    def mail() -> str:
        at = r.choice(("@", "@", "@", "@", " (at) ", "[at]"))
        return f"{word()}{r.choice(('', '.' + num(2), '.' + word()))}{at}{r.choice((word(), 'mail' + num(1)))}.{r.choice((word(), 'example.com', 'org', 'de'))}"

    def other() -> str:
        return r.choice((
            f"{r.randint(1900, 2099)}-{r.randint(10, 12)}-{r.randint(10, 28)}", f"{r.randint(1, 9)}.{r.randint(0, 20)}.{r.randint(0, 9)}", num(r.randint(1, 11)), f"token = \"{''.join(r.choice('0123456789abcdef') for _ in range(40))}\"",
            f"password={''.join(r.choice('0123456789abcdef') for _ in range(20))}", f"AKIA{''.join(r.choice('ABCDEFGHIJKLMNOP234567') for _ in range(16))}", f"{r.randint(0, 23)}:{r.randint(10, 59)}", f"${num(3)}.{num(2)}", f"{num(5)}-{num(4)}", f"@{word()}", f"{word()}{num(3)}",
            f"{r.randint(256, 999)}.{num(3)}.{num(3)}.{r.randint(256, 999)}", f"978-{num(1)}-{num(4)}-{num(4)}-{num(1)}", f"{num(3)} {num(3)} {num(3)}", f"{num(17)}", "look at the page", f"version 2.0, at {num(2)}",
            next(x for x in iter(lambda: num(16), "") if not luhn(x)),
        ))

    out = []
    for _ in range(n):
        text, spans = word().capitalize(), []
        for _ in range(r.randint(1, 3)):
            for _ in range(r.randint(0, 2)):
                text += " " + word() + r.choice(("", "", "", ",", "."))
            text += r.choice((" ", " ", " ", ": ", "\n"))
            k = r.choice((0, 1, 2, 3, 4, 4))
            made = (mail, lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)), card, phone, other)[k]()
            if k < 4:
                spans.append((len(text), k, len(text) + len(made)))
            text += made + r.choice(("", "", ".", ","))
        out.append((text + r.choice(("", f" {word()}.")), spans))
    return out


@lru_cache(maxsize=1)
def model() -> SemiCRF:
    """The trained model; the same on every call."""
    data = []
    for text, spans in training_set():
        for a, b in stretches(text):
            lattice = Lattice(text, a, b)
            starts = {x: i for i, x in enumerate(lattice.starts)}
            ends = {y: i + 1 for i, y in enumerate(lattice.ends)}
            gold = {(starts[x], ends[y], k) for x, k, y in spans if x in starts and y in ends}
            held = {(i, j, k) for i, j, k, _ in lattice}
            data.append((lattice, gold & held))
    return SemiCRF().fit(data)


def all_spans(text: str, crf: SemiCRF, base: list[Span] | None = None) -> list[Span]:
    """Base spans and the model's that overlap none of them, by start, then kind."""
    base = base_spans(text) if base is None else base
    ordered = sorted(base)
    out, at = list(base), 0
    reach = 0
    for a, b in stretches(text):
        for x, k, y in crf.decode(Lattice(text, a, b)):
            while at < len(ordered) and ordered[at][0] < y:
                reach = max(reach, ordered[at][2])
                at += 1
            # every base span before `at` starts ahead of y; the last end among them decides
            if reach <= x:
                out.append((x, k, y))
    return sorted(out)


def _text_of(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _report(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = SemiCRF()
        crf.weights = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                found = []
                for t in part.column("text").to_pylist():
                    base = base_spans(t or "")
                    found.append((base, all_spans(t or "", crf, base)))
                counts = [pa.array([sum(s[1] == k for s in base) for base, _ in found], pa.int64()) for k in range(4)]
                digests = [hashlib.sha256(_text_of(base).encode()).hexdigest() for base, _ in found]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *counts, pa.array(digests, pa.string()), pa.array([_text_of(s) for _, s in found], pa.string())],
                    names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
                )
        C.release()

    return run


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all) of every whole text."""
    spark = docs.sparkSession
    C.ship(spark)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(
        _report(spark.sparkContext.broadcast(model().weights)),
        "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string",
    )
