"""Personal data by candidate gradient boosting.

High-recall generators propose spans, which may overlap. The four base kinds are decided by their
rules; for the other kinds boosted trees score each candidate by features of its format and of the
text around it, thresholds calibrated on held-out candidates select, and of overlapping spans the
likeliest stays. The trees are trained here, on candidates made by a seeded generator.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import from_texts, with_texts

BASE = ("email", "ip", "card", "phone")
MORE = ("local_phone", "ssn", "iban")
SEED, EXAMPLES = 7, 3000
TREES, DEPTH, RATE = 40, 3, 0.3
PRECISION = 0.97  # that a kind's threshold has to reach on held-out candidates
AROUND = 24  # characters of context on each side

#: The base patterns.
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
#: The same matches, which all begin at a run's first digit and take whole runs; linear in long runs.
_IP_RUNS = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Generators of the other kinds.
_WIDE = {
    "local_phone": re.compile(r"(?<![0-9+])\(?[0-9]{2,4}\)?[ ./-][0-9]{3,4}[ .-]?[0-9]{3,5}(?![0-9])"),
    "ssn": re.compile(r"(?<![0-9-])[0-9]{3}[ -][0-9]{2}[ -][0-9]{4}(?![0-9-])"),
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
}
_HINTS = ("call", "phone", "tel", "mobile", "fax", "contact", "ssn", "social", "security", "iban", "account", "bank", "transfer")
_AGAINST = ("version", "order", "invoice", "ref", "isbn", "id", "no.", "page", "build", "date", "part")


def _luhn(digits: str) -> bool:
    return sum(sum(divmod(int(c) * 2, 10)) if k % 2 else int(c) for k, c in enumerate(reversed(digits))) % 10 == 0


def _mod97(s: str) -> bool:
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> list[tuple[int, int]]:
    """As the pattern finds them, from the @ outwards: linear also in long runs without one."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    return out


def _valid(kind: str, s: str) -> bool:
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in s.split("."))
    digits = _digits(s)
    if kind == "card":
        return 16 <= len(digits) <= 19 and _luhn(digits)
    return 8 <= len(digits) <= 15


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base spans by kind as listed, then start; code points, end exclusive."""
    out = [("email", s, e) for s, e in _emails(text)] if "@" in text else []
    for kind, pattern in (("ip", _IP_RUNS), ("card", _CARD), ("phone", _PHONE)):
        if kind != "phone" or "+" in text:
            out += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if _valid(kind, m[0])]
    return out


def _features(kind: str, text: str, start: int, end: int) -> list[float]:
    s, before, after = text[start:end], text[max(0, start - AROUND) : start].lower(), text[end : end + AROUND].lower()
    d = _digits(s)
    return [
        MORE.index(kind), len(s), len(d), len(set(d)), s.count(" "), s.count("-"), s.count("."), s.count("("),
        float(any(h in before for h in _HINTS)), float(any(h in before for h in _AGAINST)), float(any(h in after for h in _HINTS)),
        float(kind == "iban" and _mod97(s)), float(len(d) == 9 and d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"),
        sum(c.isdigit() for c in before), sum(c.isdigit() for c in after), float(before[-1:] in ("", " ", "\n")), float(after[:1] in ("", " ", "\n", ".", ",")),
        float(before.rstrip()[-1:] in (":", "=", "#")), float(d[:4] in ("1900", "2000") or d[:2] in ("19", "20")),
        # part of a longer row of digit groups
        float(before.rstrip(" .-")[-1:].isdigit()), float(after.lstrip(" .-")[:1].isdigit()),
    ]


def _candidates(text: str) -> list[tuple[str, int, int]]:
    return [(kind, m.start(), m.end()) for kind, pattern in _WIDE.items() for m in pattern.finditer(text)]


def _example(r: random.Random) -> tuple[str, str, bool]:
    """A text, a kind, and whether the candidate of that kind in it is personal data."""
    n = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("aeionrstlhd") for _ in range(r.randint(2, 8)))
    kind, true = r.choice(MORE), r.random() < 0.5
    if kind == "local_phone":
        area, sep = n(3), r.choice(" .-")
        s = r.choice((f"({area}) {n(3)}-{n(4)}", f"{area}{sep}{n(3)}{sep}{n(4)}", f"0{n(3)} {n(3)} {n(4)}")) if true else r.choice((f"{r.choice('ABDEFGLNX')}{r.choice('BEFKRSTX')}{n(2)} " + " ".join(n(4) for _ in range(r.randint(2, 5))), f"{r.choice(('19', '20'))}{n(2)}-{n(4)}{n(3)}", f"{n(4)} {n(4)}{n(3)}", f"{n(2)}.{n(3)}.{n(3)}", f"{n(4)}/{n(4)}{n(4)}"))
    elif kind == "ssn":
        sep = r.choice("- ")
        s = f"{r.randint(1, 665):03d}{sep}{r.randint(1, 99):02d}{sep}{r.randint(1, 9999):04d}" if true else r.choice((f"9{n(2)}{sep}{n(2)}{sep}{n(4)}", f"000-{n(2)}-{n(4)}", f"{n(3)} {n(2)} {n(4)}", f"{n(3)}-00-{n(4)}"))
    else:
        body = n(r.randint(11, 26))
        land = r.choice(("DE", "FR", "GB", "ES", "NL", "IT"))
        check = 98 - int(body + str(int(land[0], 36)) + str(int(land[1], 36)) + "00") % 97
        s = f"{land}{check if true else (check + r.randint(1, 80)) % 97 + 2:02d}{body}"
        if r.random() < 0.4:
            s = " ".join(s[i : i + 4] for i in range(0, len(s), 4))
    hint = r.choice(_HINTS) if true else r.choice(_AGAINST)
    lead = f"{hint}{r.choice((': ', ' ', ' is '))}" if r.random() < (0.5 if true else 0.6) else ""
    return f"{word()} {word()} {lead}{s}{r.choice((' ', '. ', ', '))}{word()} {word()}", kind, true


class Boosted:
    """Gradient-boosted regression trees on the logistic loss."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        self.trees: list[list] = []
        z = np.full(len(y), self.base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-z))
            tree = self._grow(x, y - p, p * (1 - p), np.arange(len(y)), DEPTH)
            self.trees.append(tree)
            z += RATE * np.array([self._leaf(tree, row) for row in x])

    @staticmethod
    def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, at: np.ndarray, depth: int) -> list:
        total, weight = g[at].sum(), h[at].sum() + 1.0
        best = (1e-3, None, 0.0)
        for f in range(x.shape[1]) if depth and len(at) > 20 else ():
            order = at[np.argsort(x[at, f], kind="stable")]
            v, gs, hs = x[order, f], np.cumsum(g[order])[:-1], np.cumsum(h[order])[:-1] + 1.0
            gain = np.where(v[1:] > v[:-1], gs**2 / hs + (total - gs) ** 2 / (weight - hs + 2.0) - total**2 / weight, -1)
            if len(gain) and gain.max() > best[0]:
                k = int(gain.argmax())
                best = (float(gain[k]), f, float((v[k] + v[k + 1]) / 2))
        if best[1] is None:
            return [float(total / weight)]
        left = x[at, best[1]] <= best[2]
        return [best[1], best[2], Boosted._grow(x, g, h, at[left], depth - 1), Boosted._grow(x, g, h, at[~left], depth - 1)]

    @staticmethod
    def _leaf(tree: list, row) -> float:
        while len(tree) > 1:
            tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
        return tree[0]

    def score(self, row: list[float]) -> float:
        z = self.base + RATE * sum(self._leaf(t, row) for t in self.trees)
        return float(1 / (1 + np.exp(-z)))


class _Taken:
    """Spans that do not overlap, in order; the given ones may, and are joined where they do."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for s, e in sorted(spans):
            if self.ends and s < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], e)
            else:
                self.starts.append(s)
                self.ends.append(e)

    def add(self, s: int, e: int) -> bool:
        """Take the span if nothing overlaps it."""
        k = bisect_left(self.starts, e)
        if k and self.ends[k - 1] > s:
            return False
        self.starts.insert(k, s)
        self.ends.insert(k, e)
        return True


class Model:
    """The trees and one threshold for each kind."""

    def __init__(self, seed: int = SEED):
        r = random.Random(seed)
        rows = []
        while len(rows) < EXAMPLES:
            text, kind, true = _example(r)
            found = [c for c in _candidates(text) if c[0] == kind]
            if found:
                rows.append((_features(*found[0][:1], text, *found[0][1:]), kind, true))
        x, y = np.array([f for f, _, _ in rows]), np.array([t for _, _, t in rows], float)
        kinds, cut = np.array([k for _, k, _ in rows]), EXAMPLES * 2 // 3
        self.trees = Boosted(x[:cut], y[:cut])
        p = np.array([self.trees.score(f) for f in x[cut:]])
        self.thresholds = {k: _calibrate(p[kinds[cut:] == k], y[cut:][kinds[cut:] == k]) for k in MORE}
        self.held_out = float(((p >= 0.5) == y[cut:]).mean())

    def spans(self, text: str | None) -> list[tuple[str, int, int]]:
        """Base spans and those that the trees select, by kind as listed, then start. The selected ones
        overlap neither each other nor a base span."""
        text = text or ""
        base = base_spans(text)
        taken = _Taken([(s, e) for _, s, e in base])
        scored = [(self.trees.score(_features(k, text, s, e)), k, s, e) for k, s, e in _candidates(text)]
        more = []
        for p, k, s, e in sorted(scored, key=lambda c: (-c[0], c[2], c[3], c[1])):
            if p >= self.thresholds[k] and taken.add(s, e):
                more.append((k, s, e))
        return base + sorted(more, key=lambda c: (MORE.index(c[0]), c[1]))

    def redact(self, text: str | None) -> str | None:
        """Each span, overlapping ones together, as the name of its first kind in capitals."""
        if not text:
            return text
        out, at = [], 0
        for s, kind, e in sorted((s, k, e) for k, s, e in self.spans(text)):
            if s >= at:
                out += [text[at:s], f"<{kind.upper()}>"]
            at = max(at, e)
        return "".join(out) + text[at:] if out else text


def _calibrate(p: np.ndarray, y: np.ndarray) -> float:
    """The lowest threshold, 0.5 at least, with a precision of PRECISION among what lies above it."""
    order = np.argsort(-p, kind="stable")
    precise = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    good = np.flatnonzero(precise >= PRECISION)
    return max(0.5, float(p[order][good[-1]])) if len(good) else 1.1


@lru_cache(maxsize=1)
def model(seed: int = SEED) -> Model:
    return Model(seed)


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for each row of ``docs``.

    A null text counts as empty: no spans and the digest of nothing. Repeated rows give repeated rows;
    other columns are ignored; an empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model())

    def find_all(texts: list[str | None]) -> dict[str, list]:
        out: dict[str, list] = {n: [] for n in (*(f"n_{k}" for k in BASE), "base_sha256", "spans")}
        for t in texts:
            found = sent.value.spans(t)
            names = [f"{k}:{s}:{e}" for k, s, e in found]
            n = {k: sum(f[0] == k for f in found) for k in BASE}
            for k in BASE:
                out[f"n_{k}"].append(n[k])
            out["base_sha256"].append(hashlib.sha256(",".join(names[: sum(n.values())]).encode()).hexdigest())
            out["spans"].append(",".join(names))
        return out

    return from_texts(docs, find_all, "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced by its kind in angle brackets; ``n_chars``, where there
    is one, is that of the new text. A null text stays null; other columns stay as they are."""
    sent = docs.sparkSession.sparkContext.broadcast(model())
    out = with_texts(docs, lambda texts: [sent.value.redact(t) for t in texts])
    if "n_chars" not in docs.columns:
        return out
    kind = docs.schema["n_chars"].dataType
    return out.withColumn("n_chars", F.char_length("text").cast(kind))


def brute(text: str | None) -> tuple[int, int, int, int, str]:
    """The base part by plain rules, for tests."""
    names, n = [], []
    for kind, pattern in zip(BASE, (_EMAIL, _IP, _CARD, _PHONE)):
        own = [m for m in pattern.finditer(text or "") if kind == "email" or _valid(kind, m[0])]
        n.append(len(own))
        names += [f"{kind}:{m.start()}:{m.end()}" for m in own]
    return *n, hashlib.sha256(",".join(names).encode()).hexdigest()
