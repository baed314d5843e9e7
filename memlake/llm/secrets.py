"""Secret scan by a linear-chain conditional random field (operator 4).

Base rules find assignments, access keys and long hexadecimal runs exactly. Besides, tokens (runs of letters and digits,
single marks) are tagged begin, inside or outside. A token's score comes from its shape, the shapes of its neighbours,
the distance to the last cue word and how code-like the file is; Viterbi decoding gives the tags. Tagged spans that
touch no base span are added, of kind ``crf``.

Decoding is exact and cheap: where "outside" leads a token's other tags by more than the transitions could ever give
back, the best path goes through "outside", so the chain falls apart there and only the stretches between are decoded.

The field is fitted by gradient ascent on EXAMPLES generated lines with known secrets, from a fixed seed.
Null and empty texts have no spans. Repeated rows give repeated results. Texts are read whole; offsets are code points.
Of tags with equal scores the first in the order outside, begin, inside is taken. An empty table gives no rows. The
input's other columns may have any names; where a text is masked its length is told anew, also if it was null.
"""

from __future__ import annotations

import functools
import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame

from .common import is_free, map_texts, rewrite_texts, union_of

KINDS = ("assign", "access", "hex", "crf")
EXAMPLES = 1000
STEPS = 80
#: Added spans have this many characters and this mean lead over "outside" for each token at least.
SHORTEST = 12
LEAD = 1.0

_ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
#: Words at which an assignment can begin, and further cue words.
NAMES = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")
CUES = (*NAMES, b"bearer", b"credential", b"auth", b"private", b"access", b"sk_live", b"ghp_", b"xoxb", b"pwd")
_CUE = re.compile(b"|".join(CUES))
#: Bytes of text that are tagged together; a longer text alone.
AT_ONCE = 1 << 18


def base_spans(text: str, lowered: bytes | None = None) -> list[tuple[str, int, int]]:
    """Spans of the base rules by start, then kind as listed."""
    lowered = text.encode("utf-8", "surrogatepass").lower() if lowered is None else lowered
    out = []
    if any(w in lowered for w in NAMES):
        out += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 8]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


# --- tokens and features ---------------------------------------------------------------------------------------------

# Byte classes: space, other mark, the marks of keys, digit, hex letter, other lower, upper, non-ASCII.
_SPACE, _MARK, _JOIN, _DIGIT, _HEXA, _LOWER, _UPPER, _WIDE = range(8)
_CLASS = np.full(256, _MARK, dtype=np.uint8)
_CLASS[[0x20, 9, 10, 11, 12, 13]] = _SPACE
_CLASS[[ord(c) for c in "+/_.=-"]] = _JOIN
_CLASS[ord("0") : ord("9") + 1] = _DIGIT
_CLASS[ord("a") : ord("z") + 1] = _LOWER
_CLASS[ord("a") : ord("f") + 1] = _HEXA
_CLASS[ord("A") : ord("Z") + 1] = _UPPER
_CLASS[128:] = _WIDE
_IN_WORD = _CLASS >= _DIGIT
_LENGTHS = np.zeros(64, dtype=np.int64)
for _at in (2, 4, 6, 8, 10, 13, 16, 20, 28, 36, 50):
    _LENGTHS[_at:] += 1
SHAPES, NEAR, CUE_STEPS, FILES = 12 * 64 + 8, 16, 8, 4
#: How a neighbour that is a cue word counts, whatever its shape.
CUE_NEAR = 12


def tokenise(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, shape and neighbour code of each token of UTF-8 bytes."""
    raw = np.frombuffer(data, dtype=np.uint8)
    cls = _CLASS[raw]
    word = _IN_WORD[raw]
    begins = cls != _SPACE
    begins[1:] &= ~(word[1:] & word[:-1])
    starts = np.flatnonzero(begins)
    if not len(starts):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none
    stops = word.copy()
    stops[:-1] &= ~word[1:]
    ends = starts + 1
    ends[word[starts]] = np.flatnonzero(stops) + 1
    sums = np.zeros(len(raw) + 1, dtype=np.int32)

    def has(code: int) -> np.ndarray:
        np.cumsum(cls == code, out=sums[1:])
        return sums[ends] - sums[starts]

    length = ends - starts
    digits, hexa, lower, upper = has(_DIGIT), has(_HEXA), has(_LOWER), has(_UPPER)
    flags = (digits > 0) + 2 * (upper > 0) + 4 * (hexa + lower > 0) + 8 * (lower > 0) + 16 * (digits * 6 > length) + 32 * ((upper > 1) & (upper < length - digits))
    shape = _LENGTHS[np.minimum(length, 63)] * 64 + flags
    is_word = word[starts]
    first = cls[starts]
    mark = 12 * 64 + np.where(first == _JOIN, 0, 4) + (raw[starts] == ord("=")) + 2 * (raw[starts] == ord(":")) + 1 * (raw[starts] == ord('"')) + 2 * (raw[starts] == ord("'"))
    shape = np.where(is_word, shape, mark)
    near = np.where(is_word, 4 + (digits > 0) + 2 * (length > 12) + 4 * (upper > 0), np.where(first == _JOIN, 1, 2) + (raw[starts] == ord('"')))
    return starts, ends, shape, near


def cue_distance(lowered: bytes, starts: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Tokens since the last cue word of the same text, from 1 up to CUE_STEPS - 1; 0 if it is further away."""
    out = np.zeros(len(starts), dtype=np.int64)
    places = [m.start() for m in _CUE.finditer(lowered)]
    if places:
        token = np.unique(np.searchsorted(starts, np.array(places), side="right") - 1)
        for step in range(CUE_STEPS - 1, 0, -1):
            to = token + step - 1
            own = to < len(starts)
            own[own] = text[to[own]] == text[token[own]]
            out[to[own]] = step
    return out


def codes(data: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the texts joined by line ends: starts, ends, number of the text, and a row of five feature codes for each token."""
    joined = b"\n".join(data)
    starts, ends, shape, near = tokenise(joined)
    text = np.searchsorted(np.cumsum([len(d) + 1 for d in data]), starts, side="right")
    n = len(starts)
    if not n:
        return starts, ends, text, np.zeros((0, 5), dtype=np.int64)
    cue = cue_distance(joined.lower(), starts, text)
    near = np.where(cue == 1, CUE_NEAR, near)
    before, after = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    same = text[1:] == text[:-1]
    before[1:], after[:-1] = np.where(same, near[:-1], 0), np.where(same, near[1:], 0)
    sizes, marked = np.bincount(text, minlength=len(data)), np.bincount(text[shape >= 12 * 64], minlength=len(data))
    marks = np.minimum(marked * 8 // np.maximum(sizes, 1), FILES - 1)
    offsets = np.cumsum([0, SHAPES, NEAR, NEAR, CUE_STEPS])
    return starts, ends, text, np.stack([shape, before, after, cue, marks[text]], axis=1) + offsets


FEATURES = SHAPES + 2 * NEAR + CUE_STEPS + FILES

# --- the field -------------------------------------------------------------------------------------------------------

OUT, BEGIN, INSIDE = range(3)
#: A token cannot be inside just after one outside; a finite score keeps every step exact.
FORBIDDEN = -30.0


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def fit_field(rows: list[np.ndarray], tags: list[np.ndarray], steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features x tags) and transitions by AdaGrad on the mean log-likelihood of padded sequences."""
    n, longest = len(rows), max(map(len, rows))
    x = np.full((n, longest, 5), FEATURES, dtype=np.int64)
    y = np.zeros((n, longest), dtype=np.int64)
    live = np.zeros((n, longest), dtype=bool)
    for i, (r, t) in enumerate(zip(rows, tags)):
        x[i, : len(r)], y[i, : len(r)], live[i, : len(r)] = r, t, True
    w, trans = np.zeros((FEATURES + 1, 3)), np.zeros((3, 3))
    trans[OUT, INSIDE] = FORBIDDEN
    seen_w, seen_t = np.full_like(w, 1e-6), np.full_like(trans, 1e-6)
    gold = np.eye(3)[y] * live[..., None]
    gold_t = np.zeros((3, 3))
    np.add.at(gold_t, (y[:, :-1][live[:, 1:]], y[:, 1:][live[:, 1:]]), 1)
    for _ in range(steps):
        score = w[x].sum(axis=2)
        score[:, 0, INSIDE] += FORBIDDEN
        alpha, beta = np.zeros((n, longest, 3)), np.zeros((n, longest, 3))
        alpha[:, 0] = score[:, 0]
        for t in range(1, longest):
            step = _logsum(alpha[:, t - 1, :, None] + trans, axis=1) + score[:, t]
            alpha[:, t] = np.where(live[:, t, None], step, alpha[:, t - 1])
        for t in range(longest - 2, -1, -1):
            step = _logsum(trans + (score[:, t + 1] + beta[:, t + 1])[:, None, :], axis=2)
            beta[:, t] = np.where(live[:, t + 1, None], step, 0.0)
        z = _logsum(alpha[:, -1], axis=1)
        p = np.exp(np.minimum(alpha + beta - z[:, None, None], 0)) * live[..., None]
        pair = np.exp(np.minimum(alpha[:, :-1, :, None] + trans + (score[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None], 0)) * live[:, 1:, None, None]
        grad = np.zeros_like(w)
        for k in range(5):
            np.add.at(grad, x[..., k].ravel(), (gold - p).reshape(-1, 3))
        grad = grad / n - 1e-4 * w
        grad_t = (gold_t - pair.sum(axis=(0, 1))) / n
        grad[-1] = 0
        grad_t[OUT, INSIDE] = 0
        seen_w += grad**2
        seen_t += grad_t**2
        w += 0.5 * grad / np.sqrt(seen_w)
        trans += 0.5 * grad_t / np.sqrt(seen_t)
    return w[:-1], trans


def viterbi(score: np.ndarray, trans: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Best tags of score's rows starts[i]:stops[i], each standing between tokens outside; all other rows are outside.

    The stretches advance together, one token a step; those that have ended drop out.
    """
    out = np.zeros(len(score), dtype=np.int64)
    order = np.argsort(starts - stops, kind="stable")
    starts, lengths = starts[order], (stops - starts)[order]
    if not len(starts):
        return out
    at = score[starts] + trans[OUT]
    back = []
    for t in range(1, int(lengths[0])):
        live = int(np.searchsorted(-lengths, -t, side="left"))
        step = at[:live, :, None] + trans
        back.append(step.argmax(axis=1))
        at[:live] = step.max(axis=1) + score[starts[:live] + t]
    tag = (at + trans[:, OUT]).argmax(axis=1)
    for t in range(int(lengths[0]) - 1, -1, -1):
        live = int(np.searchsorted(-lengths, -t, side="left"))
        out[starts[:live] + t] = tag[:live]
        if t:
            tag[:live] = back[t - 1][np.arange(live), tag[:live]]
    return out


def margin(trans: np.ndarray) -> float:
    """The most that two transitions can lose when the tag between them turns to outside."""
    kept = trans[:, :, None] + trans[None]
    through = trans[:, OUT][:, None] + trans[OUT][None]
    # Where INSIDE follows, that token turns to BEGIN in exchange; decode() adds what this costs in its own scores.
    onward = max(0.0, float((trans[INSIDE] - trans[BEGIN]).max()))
    return float(max((kept - through[:, None, :])[:, :, :INSIDE].max(), (kept[:, :, INSIDE] - through[:, None, BEGIN]).max() + onward))


def decode(score: np.ndarray, trans: np.ndarray, text: np.ndarray | None = None) -> np.ndarray:
    """Viterbi tags of whole texts (*text* numbers them); only the stretches in which a tag but outside is possible are walked."""
    lead = score[:, OUT] - np.maximum(score[:, BEGIN], score[:, INSIDE])
    swap = np.maximum(score[:, INSIDE] - score[:, BEGIN], 0)
    need = np.full(len(score), margin(trans))
    need[:-1] += swap[1:]
    open_ = lead <= need
    fresh = np.ones(len(score) + 1, dtype=bool)  # where another stretch or text begins
    fresh[1:-1] = open_[1:] != open_[:-1]
    if text is not None:
        fresh[1:-1] |= text[1:] != text[:-1]
    edges = np.flatnonzero(fresh)
    walked = open_[edges[:-1]]
    return viterbi(score, trans, edges[:-1][walked], edges[1:][walked])


# --- training --------------------------------------------------------------------------------------------------------


def _example(r: np.random.Generator) -> tuple[str, tuple[int, int] | None]:
    """A line and the span of its secret; None if it has none."""
    low, high, dig = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    draw = lambda chars, n: "".join(r.choice(list(chars), n))
    pick = lambda *xs: xs[r.integers(len(xs))]
    word = lambda: pick(draw(low, r.integers(1, 14)), draw(low, r.integers(2, 8)).capitalize(), draw(low + "éüñç", r.integers(3, 9)), draw(high, r.integers(2, 9)))
    prose = lambda n: " ".join(word() + pick("", "", "", ",", ".", "!!", "$$$", " |") for _ in range(n))
    kind = r.integers(10)
    name = pick("password", "secret", "token", "api_key", "apikey", "Authorization: Bearer", "credential", "pwd", "private_key", "auth")
    if kind < 5:
        s = pick(draw(low + high + dig, r.integers(16, 44)), draw(low + high + dig + "+/", r.integers(24, 60)), draw("0123456789abcdef", r.integers(18, 64)), "sk_live_" + draw(low + high + dig, 24), "ghp_" + draw(low + high + dig, 36), "xoxb-" + draw(dig, 11) + "-" + draw(low + high + dig, 24), "AKIA" + draw(high + dig, 16), "eyJ" + draw(low + high + dig, 20) + "." + draw(low + high + dig, 30) + "." + draw(low + high + dig + "_-", 24))
        lead = pick(name + pick("=", ": ", ' = "', ":", " "), name + " is ", "", "", "key ")
        before = pick("", prose(r.integers(1, 8)) + " ") + lead
        return before + s + pick("", '"' if lead.endswith('"') else " ", " " + prose(r.integers(1, 6)), "\n"), (len(before), len(before) + len(s))
    harmless = pick(
        draw(dig, r.integers(3, 17)), f"{draw(dig, 4)}-{draw(dig, 2)}-{draw(dig, 2)}", f"+1 ({draw(dig, 3)}) 555-{draw(dig, 4)}", f"{draw(low, 6)}.{draw(dig, 2)}@mail{draw(dig, 1)}.example.com",
        ".".join(draw(dig, 2) for _ in range(4)), "https://" + draw(low, 8) + ".com/" + draw(low, 9), draw(low, r.integers(15, 40)), draw(high, r.integers(12, 30)), f"version {draw(dig, 1)}.{draw(dig, 1)}", name + pick(" ", ": ", " = ") + draw(low, r.integers(2, 8)), draw(low, 9) + "_" + draw(low, 8), "AKIA " + draw(high, 5),
    )
    return prose(r.integers(1, 9)) + " " + harmless + pick(" ", ", ", "!!") + prose(r.integers(1, 7)), None


def tags_for(starts: np.ndarray, ends: np.ndarray, span: tuple[int, int] | None) -> np.ndarray:
    tags = np.zeros(len(starts), dtype=np.int64)
    if span:
        inside = (starts >= span[0]) & (ends <= span[1])
        tags[inside] = INSIDE
        if inside.any():
            tags[inside.argmax()] = BEGIN
    return tags


@functools.lru_cache(1)
def model() -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(4)
    rows, tags = [], []
    for _ in range(EXAMPLES):
        text, span = _example(r)
        starts, ends, _, x = codes([text.encode()])
        if span:
            span = tuple(len(text[:k].encode()) for k in span)
        rows.append(x[:60])
        tags.append(tags_for(starts, ends, span)[:60])
    return fit_field(rows, tags)


def tagged_spans(texts: list[str], fitted: tuple[np.ndarray, np.ndarray]) -> list[list[tuple[int, int]]]:
    """Of each text the spans, in code points, that the field tags as secrets, long enough and with lead enough."""
    w, trans = fitted
    data = [t.encode("utf-8", "surrogatepass") for t in texts]
    starts, ends, text, x = codes(data)
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    if not len(starts):
        return out
    score = w[x[:, 0]]
    for k in range(1, 5):
        score = score + w[x[:, k]]
    tags = decode(score, trans, text)
    first = np.cumsum([0, *(len(d) + 1 for d in data)])
    for b in np.flatnonzero(tags == BEGIN).tolist():
        e = b + 1
        while e < len(tags) and tags[e] == INSIDE and starts[e] == ends[e - 1]:
            e += 1
        own = score[b:e]
        if ends[e - 1] - starts[b] >= SHORTEST and (own[np.arange(e - b), tags[b:e]] - own[:, OUT]).mean() >= LEAD:
            k = int(text[b])
            out[k].append((int(starts[b] - first[k]), int(ends[e - 1] - first[k])))
    for k, spans in enumerate(out):
        if spans and len(data[k]) != len(texts[k]):
            wide = np.cumsum((np.frombuffer(data[k], dtype=np.uint8) & 0xC0) == 0x80)
            out[k] = [(a - int(wide[a - 1] if a else 0), b - int(wide[b - 1])) for a, b in spans]
    return out


def find_spans(texts: list[str | None], fitted: tuple[np.ndarray, np.ndarray]) -> list[tuple[list, list]]:
    """Base spans and added spans of each text, in code points. Added ones meet no base span."""
    texts = [t or "" for t in texts]
    group = np.cumsum([len(t) for t in texts]) // AT_ONCE
    bounds = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(texts)]
    out = []
    for a, b in zip(bounds, bounds[1:]):
        for text, tagged in zip(texts[a:b], tagged_spans(texts[a:b], fitted)):
            base = base_spans(text)
            taken = union_of((s, e) for _, s, e in base)
            out.append((base, [("crf", s, e) for s, e in tagged if is_free(taken, s, e)]))
    return out


def listed(spans: list[tuple[str, int, int]]) -> str:
    """kind:start:end by start, then kind as listed, comma-joined."""
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2])))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts and digest of the base spans, and all spans."""
    fitted = model()

    def found(texts: list[str | None]) -> list:
        both = find_spans(texts, fitted)
        counts = [[sum(s[0] == k for s in base) for base, _ in both] for k in KINDS[:3]]
        return [*counts, [hashlib.sha256(listed(b).encode()).hexdigest() for b, _ in both], [listed(b + a) for b, a in both]]

    fields = [(f"n_{k}", "long") for k in KINDS[:3]] + [("base_sha256", "string"), ("spans", "string")]
    return map_texts(docs, [id_col], text_col, found, fields)


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every secret, overlapping ones as one, replaced by a mark."""
    out, end = [], 0
    for _, a, b in sorted(spans, key=lambda s: s[1]):
        if a >= end:
            out += [text[end:a], "[SECRET]"]
        end = max(end, b)
    return "".join(out) + text[end:]


def redact_secrets(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The documents, all of them, with their secrets masked; *length_col* follows where the text changed."""
    fitted = model()

    def mask(texts: list[str | None]) -> tuple[list[bool], list[str | None]]:
        out = []
        for t, (base, added) in zip(texts, find_spans(texts, fitted)):
            out.append(redacted(t, base + added) if base or added else t)
        return [True] * len(out), out

    return rewrite_texts(docs, text_col, mask, length_col)
