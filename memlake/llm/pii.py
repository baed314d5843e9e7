"""Personal data by candidate gradient boosting (operator 1).

Exact base rules give e-mail addresses, IPv4 addresses, card numbers and phone numbers. Beyond them, high-recall
generators propose overlapping spans (written-out addresses, national phone numbers, account and social numbers, card
numbers with a wrong check digit). Boosted trees score each candidate from its format and its context; a threshold per
kind, calibrated on held-out examples to PRECISION, selects what is added. Added spans never touch base spans; of
overlapping candidates the likeliest stays.

The trees are fitted on EXAMPLES generated sentences with known spans, from a fixed seed, so every run has one model.
Null and empty texts have no spans. Repeated rows give repeated results. Texts are read whole; offsets are code points.
Of overlapping candidates of equal likelihood the one that begins first stays, then the longer one. An empty table gives
no rows. The input's other columns may have any names.
"""

from __future__ import annotations

import functools
import hashlib
import re
from bisect import bisect_left

import numpy as np
from pyspark.sql import DataFrame

from .boosting import Boosted
from .calibration import apply, isotonic
from .common import is_free, map_texts, union_of

#: Kinds in the order in which spans are listed; the first four have base rules.
KINDS = ("email", "ip", "card", "phone", "ssn", "iban")
EXAMPLES = 6000
PRECISION = 0.97
CONTEXT = 28

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match of these can only begin where a run of digits begins: the one before it, if any, took its run to the end.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses. A local part ends at an @, so each @ is looked at once, in order."""
    out, end = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            out.append((start, m.end()))
            end = m.end()
        else:
            end = max(end, at + 1)  # nothing before this @ can be part of a later match
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the base rules by kind as listed, then start."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        if "." in text:
            for m in _IP.finditer(text):
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                    out.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            d = _digits(m[0]) if m.end() - m.start() < 40 else ""
            if 13 <= len(d) <= 19 and luhn(d):
                out.append(("card", *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_digits(m[0])) <= 15:
                    out.append(("phone", *m.span()))
    return out


# --- candidates ------------------------------------------------------------------------------------------------------

#: Kind, what a text must hold for the generator to be tried, and its pattern. Several may propose overlapping spans.
GENERATORS = (
    ("email", "dot", re.compile(r"(?i)(?<![\w.])[a-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]|\bat\b|@) ?[a-z0-9-]{1,63}(?:(?: ?(?:\(dot\)|\[dot\]|\bdot\b) ?|\.)[a-z0-9-]{2,63}){1,4}(?!\w)")),
    ("email", "@", re.compile(r"(?<!\S)[^\s@]{1,64} ?@ ?[^\s@]{1,63}\.[A-Za-z]{2,10}")),
    ("phone", "0-9", re.compile(r"(?<![0-9+])\(?0?[0-9]{2,4}\)?[ ./-][0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])")),
    ("phone", "0-9", re.compile(r"(?<![0-9])00[1-9][0-9]{0,2}[ -]?[0-9][0-9 -]{6,11}[0-9](?![0-9])")),
    ("card", "0-9", re.compile(r"(?<![0-9A-Za-z])[0-9]{13,19}(?![0-9A-Za-z])")),
    ("card", "0-9", re.compile(r"(?<![0-9])[0-9]{4}(?:[ .-][0-9]{4}){3}(?![0-9])")),
    ("ssn", "0-9", re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")),
    ("iban", "0-9", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")),
)

#: Words whose presence just before a candidate counts for or against it.
CUES = (
    ("mail", "contact", "write"),
    ("phone", "tel", "call", "fax", "mobile"),
    ("card", "visa", "credit", "paid", "payment"),
    ("ssn", "social", "security"),
    ("iban", "account", "bank", "transfer"),
    ("order", "invoice", "version", "isbn", "serial", "page", "model", "total"),
    ("id", "no.", "number", "ref", "case"),
)


def candidates(text: str) -> list[tuple[str, int, int, int]]:
    """Kind, start, end and generator of every proposed span; they may overlap."""
    out, digits = [], None
    for g, (kind, needs, pattern) in enumerate(GENERATORS):
        if needs == "0-9":
            digits = bool(_DIGIT.search(text)) if digits is None else digits
            if not digits:
                continue
        elif needs not in text and needs.upper() not in text:
            continue
        out += [(kind, *m.span(), g) for m in pattern.finditer(text)]
    return out


def features(text: str, found: list[tuple[str, int, int, int]]) -> np.ndarray:
    """Small integers: generator, format of the span, its neighbours and the cue words before it."""
    rows = []
    for kind, a, b, g in found:
        span, before = text[a:b], text[max(0, a - CONTEXT) : a].lower()
        d = _digits(span)
        separators = [c for c in span if not c.isalnum()]
        left, right = text[a - 1 : a], text[b : b + 1]
        rows.append(
            [
                g,
                KINDS.index(kind),
                min(len(span), 31),
                min(len(d), 31),
                sum(c.isalpha() for c in span) * 31 // max(1, len(span)),
                min(len(separators), 31),
                len(set(separators)),
                int(d[:1] or 0),
                int(luhn(d)) if 12 <= len(d) <= 19 else 2,
                int("(at)" in span.lower() or "[at]" in span.lower()) + 2 * int("(dot)" in span.lower() or "[dot]" in span.lower()),
                int(" at " in span) + 2 * int(" dot " in span),
                0 if not left or left.isspace() else 1 if left in ":=\"'(<[" else 2,
                0 if not right or right.isspace() else 1 if right in ".,;:)\"'>]!?" else 2,
                int(d[:3] in ("000", "666") or d[:1] == "9") if kind == "ssn" else 2,
                len(set(d)),
                *(int(any(w in before for w in cue)) for cue in CUES),
            ]
        )
    return np.array(rows, dtype=np.int64).reshape(len(rows), 15 + len(CUES))


# --- training --------------------------------------------------------------------------------------------------------


def _example(r: np.random.Generator) -> tuple[str, tuple[int, int] | None]:
    """A sentence and its one sensitive span; None if the number or phrase in it is harmless."""
    word = lambda lo=2, hi=9: "".join(r.choice(list("abcdefghijklmnopqrstuvwxyz"), r.integers(lo, hi)))
    num = lambda n: "".join(map(str, r.integers(0, 10, n)))
    pick = lambda *xs: xs[r.integers(len(xs))]
    kind = r.integers(12)
    cue = ""
    if kind == 0:
        at, dot = pick((" at ", " dot "), (" (at) ", " (dot) "), ("[at]", "[dot]"), ("(at)", "."), (" @ ", "."), (" [at] ", " [dot] "))
        s, cue, good = word() + pick("", ".", "_") + word(1, 5) + at + word(3) + dot + pick("com", "org", "net", "de", "example"), pick("", "mail ", "contact: ", "write to "), True
    elif kind == 1:
        s, cue, good = pick(f"{num(3)}-{num(3)}-{num(4)}", f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)} {num(3)} {num(4)}", f"0{num(2)} {num(4)} {num(4)}", f"0049 {num(3)} {num(6)}"), pick("phone ", "tel: ", "call ", "", "mobile "), True
    elif kind == 2:  # without a cue word, only a number with a right check digit is a card's
        cue, d = pick("", "", "", "card ", "visa: ", "paid with "), pick("", "4", "5")
        d += num(15 - len(d))
        last = [str(k) for k in range(10) if luhn(d + str(k))][0] if r.random() < 0.5 else num(1)
        d += last
        good = bool(cue) or luhn(d)
        s = pick(d, " ".join(d[i : i + 4] for i in range(0, 16, 4)), "-".join(d[i : i + 4] for i in range(0, 16, 4)))
    elif kind == 3:
        s, cue, good = f"{r.integers(100, 666)}-{r.integers(10, 99)}-{num(4)}", pick("ssn ", "social security ", "", "ssn: "), True
    elif kind == 4:
        s, cue, good = pick("DE", "FR", "GB", "ES", "NL") + num(2) + pick("", " ") + num(4) + " ".join(["", num(4), num(4), num(4)]), pick("iban ", "account ", "", "bank transfer to "), True
    elif kind == 5:
        s, cue, good = word() + " at " + word() + " " + pick("dot ", "the dot ") + word(5, 9), "", False
    elif kind == 6:
        s, cue, good = pick(num(13), num(14), num(17), num(18), num(19)), pick("order ", "invoice ", "serial ", "isbn ", "ref "), False
    elif kind == 7:
        s, cue, good = pick(f"{num(3)}-{num(4)}-{num(3)}", f"{num(2)}/{num(3)}-{num(4)}", f"{num(4)}.{num(3)}.{num(3)}", f"{num(3)} {num(3)} {num(3)}"), pick("order ", "total ", "version ", "page ", "model "), False
    elif kind == 8:
        s, cue, good = pick(f"000-{num(2)}-{num(4)}", f"9{num(2)}-{num(2)}-{num(4)}", f"666-{num(2)}-{num(4)}"), pick("order ", "model ", "ref "), False
    elif kind == 9:
        s, cue, good = pick("AB", "XK", "QZ", "MX") + num(2) + "".join(pick("ABCD", "EFGH", "JK12") for _ in range(4)), pick("model ", "serial ", "ref "), False
    elif kind == 10:
        s, cue, good = word() + pick("@", " @ ") + word(1, 3) + pick("!.", "...", "#.") + word(2, 4), "", False
    else:
        s, cue, good = pick(f"{num(3)}-{num(3)}-{num(4)}", num(16)), pick("order ", "invoice ", "isbn ", "serial "), False
    before, after = " ".join(word() for _ in range(r.integers(1, 6))) + " ", pick(" ", ". ", ", ", "\n") + " ".join(word() for _ in range(r.integers(1, 5)))
    a = len(before) + len(cue)
    return before + cue + s + after, (a, a + len(s)) if good else None


class Model(tuple):
    """(trees, knots and values of the calibration, threshold of each kind)."""


@functools.lru_cache(1)
def model() -> Model:
    """Trees on two thirds of the examples; calibration and thresholds on the rest."""
    r = np.random.default_rng(20)
    xs, ys, kinds = [], [], []
    for _ in range(EXAMPLES):
        text, span = _example(r)
        found = candidates(text)
        if found:
            xs.append(features(text, found))
            ys += [span is not None and min(b, span[1]) - max(a, span[0]) > 0.8 * (max(b, span[1]) - min(a, span[0])) for _, a, b, _ in found]
            kinds += [f[0] for f in found]
    x, y, kinds = np.concatenate(xs), np.array(ys, dtype=float), np.array(kinds)
    held = np.arange(len(y)) % 3 == 2
    trees = Boosted().fit(x[~held], y[~held])
    margin = trees.margin(x)
    knots, values = isotonic(margin[held], y[held], np.ones(held.sum()))
    p = apply(knots, values, margin)
    thresholds = {}
    for kind in KINDS:
        own = np.flatnonzero(held & (kinds == kind))
        order = own[np.argsort(-p[own], kind="stable")]
        right = np.cumsum(y[order]) / np.arange(1, len(order) + 1)
        last = np.flatnonzero(right >= PRECISION)
        thresholds[kind] = max(0.5, float(p[order[last[-1]]])) if len(last) else 2.0
    return Model((trees, knots, values, thresholds))


def added_spans(texts: list[str], base: list[list[tuple[str, int, int]]], fitted: Model) -> list[list[tuple[str, int, int]]]:
    """What the trees select for each text, apart from its base spans."""
    trees, knots, values, thresholds = fitted
    found = [candidates(t) for t in texts]
    held = [i for i, f in enumerate(found) if f]
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    if not held:
        return out
    p = apply(knots, values, trees.margin(np.concatenate([features(texts[i], found[i]) for i in held])))
    at = 0
    for i in held:
        scored = sorted(((-p[at + j], a, -b, kind) for j, (kind, a, b, _) in enumerate(found[i]) if p[at + j] >= thresholds[kind]))
        at += len(found[i])
        out[i] = _apart(scored, [(a, b) for _, a, b in base[i]])
    return out


def _apart(scored: list[tuple], taken: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    """Greedily, best first, the spans that meet neither *taken* nor one chosen before."""
    starts, ends = union_of(taken)
    chosen = []
    for _, a, b, kind in scored:
        b = -b
        if is_free((starts, ends), a, b):
            i = bisect_left(starts, a)
            starts.insert(i, a)
            ends.insert(i, b)
            chosen.append((kind, a, b))
    return sorted(chosen, key=lambda s: s[1])


def listed(spans: list[tuple[str, int, int]]) -> str:
    """kind:start:end by kind as listed, then start, comma-joined."""
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts and digest of the base spans, and all spans."""
    fitted = model()

    def found(texts: list[str | None]) -> list:
        texts = [t or "" for t in texts]
        base = [base_spans(t) for t in texts]
        more = added_spans(texts, base, fitted)
        counts = [[sum(s[0] == k for s in spans) for spans in base] for k in KINDS[:4]]
        return [*counts, [hashlib.sha256(listed(s).encode()).hexdigest() for s in base], [listed(s + m) for s, m in zip(base, more)]]

    fields = [(f"n_{k}", "long") for k in KINDS[:4]] + [("base_sha256", "string"), ("spans", "string")]
    return map_texts(docs, [id_col], text_col, found, fields)
