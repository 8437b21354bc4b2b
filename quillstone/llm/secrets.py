"""Secret scans: exact patterns, and a linear-chain conditional random field that tags tokens as begin, inside or outside of a secret.

The field learns from what the patterns find, with their keywords hidden and their values spelt anew in other alphabets in part of the training windows, so that
shape and neighbours decide and it finds secrets no pattern names. Tags are decoded by Viterbi; where a token is so surely outside that
no transition could change it, the chain falls apart exactly there, so only the stretches between are searched.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import _powers, append_columns, packed_row, spread

# The base patterns, kind by kind in the order of ties, with the group that must be long and its least length.
PATTERNS = {
    "assign": (r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]{16,}", 0, 16),  # a match of [0-9a-f]+ is a whole run, so runs too short are passed over at once
}
#: Spans of the field follow the base kinds.
MODEL = "model"
KINDS = [*PATTERNS, MODEL]
_BASE = {k: (re.compile(p, re.ASCII | (re.IGNORECASE if k == "assign" else 0)), g, n) for k, (p, g, n) in PATTERNS.items()}

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) in code points of all base matches, by start, then kind; end exclusive."""
    out = [(kind, *m.span()) for kind, (p, group, least) in _BASE.items() for m in p.finditer(text) if len(m[group]) >= least]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


# --- tokens and features -------------------------------------------------------------------------------------------------------

#: Byte classes: 0 white space, 1 punctuation, 2 lower, 3 upper, 4 digit, 5 signs that may stand in a value, 6 beyond ASCII.
_CLASS = np.ones(256, np.int8)
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 2, 3, 4, 6
_CLASS[list(b"+/_-.")] = 5
_GROUP = np.minimum(_CLASS, 2)
_PRESENT = np.where(_CLASS > 1, 1 << np.maximum(_CLASS - 2, 0), 0).astype(np.uint8)
_DIGIT, _BEYOND = (_CLASS == 4).astype(np.uint8), np.isin(np.arange(256), list(b"ghijklmnopqrstuvwxyzGHIJKLMNOPQRSTUVWXYZ")).astype(np.uint8)
_LETTER = np.random.default_rng(20260102).integers(1, 1 << 63, 256, dtype=np.uint64)
_LETTER[65:91] = _LETTER[97:123]
_SIZE = np.minimum(np.log2(np.maximum(np.arange(256), 1)) * 2, 15).astype(np.int32)
WORD_BITS, SHORT = 13, 10
_SHAPES, _WORDS = 4096, 1 << WORD_BITS
#: Blocks of the weight table: shape with length, shape without, file, shape of both neighbours, and the words before, two before, after, and the token if short.
_BLOCKS = np.cumsum([0, _SHAPES, _SHAPES, 64, 64, 64, _WORDS, _WORDS, _WORDS, _WORDS])
FEATURES = int(_BLOCKS[-1])
_N = len(_BLOCKS) - 1


def tokens(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte ranges of tokens: runs of letters, digits and + / _ - . or of other signs, never with white space."""
    group = _GROUP[np.frombuffer(text, np.uint8)]
    edge = np.flatnonzero(np.diff(group, prepend=-1))
    ends = np.append(edge[1:], len(group))
    word = group[edge] > 0
    return edge[word], ends[word]


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the weight table (tokens, blocks) of whole texts, each token with one active feature a block; the tokens' byte
    ranges within the texts joined by line feeds, and where each text's tokens begin (one more entry than texts). What stands in other texts
    makes no difference to a token."""
    joined = b"\n".join(texts) + b"\n"
    raw = np.frombuffer(joined, np.uint8)
    starts, ends = tokens(joined)
    edge = np.cumsum([0] + [len(t) + 1 for t in texts])
    at = np.searchsorted(starts, edge)
    n = ends - starts
    if not len(n):
        return np.zeros((0, _N), np.int32), starts, ends, at
    kind = _CLASS[raw]
    # reduceat runs to the next start; what lies between tokens is white space, which counts for nothing here
    present = np.bitwise_or.reduceat(_PRESENT[raw], starts).astype(np.int32)
    change = np.zeros(len(raw), np.int32)
    change[1:] = (kind[1:] != kind[:-1]) & (kind[1:] > 1)
    turns = np.add.reduceat(change, starts) - change[starts]
    digit = np.add.reduceat(_DIGIT[raw], starts, dtype=np.int32)
    beyond = np.add.reduceat(_BEYOND[raw], starts, dtype=np.int32)  # letters no hexadecimal number has
    size = _SIZE[np.minimum(n, len(_SIZE) - 1)]
    small = size // 2 * 8 + (digit > 0) + 2 * (present >> 1 & 1) + 4 * (kind[starts] == 1)
    shape = (size * 32 + present) * 8 + np.minimum(turns * 8 // n, 7)
    other = (present * 8 + np.minimum(digit * 8 // n, 7)) * 8 + np.minimum(beyond * 8 // n, 7)
    total, many = np.maximum(np.diff(edge), 1), np.diff(at)
    per_text = lambda mask: np.add.reduceat(mask, edge[:-1], dtype=np.int64)
    page = [per_text(kind == 4) > 0.03 * total, per_text(kind == 1) > 0.06 * total, per_text(raw == 61) > 0, (per_text(raw == 10) - 1) * 60 > total]
    page = sum(f.astype(np.int32) << k for k, f in enumerate(page)) * 4 + (many > 20) + (many > 200) + (many > 2000)
    p, q = _powers(len(raw))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_LETTER[raw] * p, dtype=np.uint64)])
    h = (sums[ends] - sums[starts]) * q[starts]
    word = ((h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - WORD_BITS)).astype(np.int32)
    word = np.where(n > SHORT, 0, np.maximum(word, 1))  # long words and values are no context words
    doc = np.repeat(np.arange(len(texts)), many)

    def beside(x, k):  # the same of the token k places on; 0 beyond the text's own tokens
        out = np.zeros(len(x), np.int32)
        here, there = (slice(0, len(x) - k), slice(k, None)) if k > 0 else (slice(-k, None), slice(0, len(x) + k))
        out[here] = np.where(doc[here] == doc[there], x[there], 0)
        return out

    cols = [shape, other, page[doc], beside(small, -1), beside(small, 1), beside(word, -1), beside(word, -2), beside(word, 1), word]
    return np.stack([c + b for c, b in zip(cols, _BLOCKS)], axis=1).astype(np.int32), starts, ends, at


# --- the field -----------------------------------------------------------------------------------------------------------------

OUTSIDE, BEGIN, INSIDE = 0, 1, 2


@dataclass
class Field:
    """Weights of features (FEATURES, 3), of transitions (3, 3) and of the first tag (3)."""

    weights: np.ndarray
    moves: np.ndarray
    first: np.ndarray

    def scores(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros((len(rows), 3))
        for k in range(_N):  # column by column: a token's score must not depend on the tokens beside it
            out += self.weights[rows[:, k]]
        return out

    def decode(self, rows: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
        """The best tags by Viterbi, of texts whose tokens begin at at (default: one text).

        A token whose outside score leads by more than twice the spread of the transitions and starts is outside on the best path, whatever stands
        around it; the search runs over the stretches between such tokens, with their known neighbours as ends.
        """
        e = self.scores(rows)
        tags = np.zeros(len(e), np.int8)
        both = np.concatenate([self.moves.ravel(), self.first])
        open_ = np.flatnonzero(e[:, 0] - e[:, 1:].max(axis=1, initial=-np.inf) <= 2 * (both.max() - both.min()) + 1e-9)
        if not len(open_):
            return tags
        first = np.zeros(len(e) + 1, bool)
        first[[0, len(e)] if at is None else at] = True
        for part in np.split(open_, np.flatnonzero((np.diff(open_) > 1) | first[open_[1:]]) + 1):
            a, b = part[0], part[-1] + 1
            tags[a:b] = self._best(e[a:b], first[a], first[b])
        return tags

    def _best(self, e: np.ndarray, begins: bool, ends: bool) -> np.ndarray:
        moves = self.moves.tolist()
        v = [x + y for x, y in zip(e[0].tolist(), self.first.tolist() if begins else moves[OUTSIDE])]
        back = []
        for row in e[1:].tolist():
            came = [max(range(3), key=lambda p, t=t: v[p] + moves[p][t]) for t in range(3)]
            v = [v[p] + moves[p][t] + row[t] for t, p in enumerate(came)]
            back.append(came)
        if not ends:
            v = [x + moves[t][OUTSIDE] for t, x in enumerate(v)]
        tag = max(range(3), key=v.__getitem__)
        out = [tag]
        for came in reversed(back):
            out.append(came[out[-1]])
        return np.array(out[::-1], np.int8)

    def spans(self, texts: list[bytes]) -> dict[int, list[tuple[int, int]]]:
        """Byte ranges of secrets by text, for those with any: a begin, or an inside tag after an outside one, opens a secret."""
        rows, starts, ends, at = features(texts)
        tags = self.decode(rows, at)
        out: dict[int, list[tuple[int, int]]] = {}
        edge = np.cumsum([0] + [len(t) + 1 for t in texts])
        for i in np.flatnonzero(tags):
            d = int(np.searchsorted(at, i, "right")) - 1
            own = out.setdefault(d, [])
            if tags[i] == INSIDE and i > at[d] and tags[i - 1] and own:
                own[-1] = (own[-1][0], int(ends[i] - edge[d]))
            else:
                own.append((int(starts[i] - edge[d]), int(ends[i] - edge[d])))
        return out


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


def gradient(field: Field, rows: np.ndarray, tags: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Log likelihood of windows (windows, length, blocks) with tags (windows, length), and its gradient, by forward and backward sums."""
    n, size, _ = rows.shape
    e = field.scores(rows.reshape(n * size, -1)).reshape(n, size, 3)
    f, b = np.empty_like(e), np.zeros_like(e)
    f[:, 0] = e[:, 0] + field.first
    for t in range(1, size):
        f[:, t] = e[:, t] + _lse(f[:, t - 1, :, None] + field.moves, 1)
    for t in range(size - 2, -1, -1):
        b[:, t] = _lse(field.moves + (e[:, t + 1] + b[:, t + 1])[:, None, :], 2)
    z = _lse(f[:, -1], 1)
    one = np.eye(3)[tags]
    p = one - np.exp(f + b - z[:, None, None])
    pair = np.exp(f[:, :-1, :, None] + field.moves + (e[:, 1:] + b[:, 1:])[:, :, None, :] - z[:, None, None, None])
    moves = np.einsum("ntp,ntq->pq", one[:, :-1], one[:, 1:]) - pair.sum(axis=(0, 1))
    weights = np.zeros_like(field.weights)
    flat = rows.reshape(-1, rows.shape[-1])
    for t in range(3):
        weights[:, t] = np.bincount(flat.ravel(), np.repeat(p[..., t].ravel(), flat.shape[1]), len(weights))
    score = (e * one).sum() + (one[:, 0] * field.first).sum() + np.einsum("ntp,ntq,pq->", one[:, :-1], one[:, 1:], field.moves)
    return float(score - z.sum()), weights, moves, p[:, 0].sum(axis=0)


# --- training ------------------------------------------------------------------------------------------------------------------

#: Tokens on either side of a secret or of a token drawn elsewhere that make a training window.
AROUND = 6
_ALPHABETS = ["0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"]


def _respelt(value: str, salt: int) -> str:
    """A value in another alphabet, the same for the same value and salt: of like length, shorter or longer, or in three parts between points."""
    seed = zlib.crc32(f"{salt}:{value}".encode())
    letters = _ALPHABETS[seed % len(_ALPHABETS)]
    n = len(value) if salt == 1 else max(16, len(value) * (2 + seed // 7 % 7) // 4)
    stream = hashlib.shake_256(f"{salt}:{value}".encode()).digest(n)
    new = "".join(letters[x % len(letters)] for x in stream)
    return ".".join([new[: n // 3], new[n // 3 : 2 * n // 3], new[2 * n // 3 :]]) if salt == 3 else new


def _tagged(text: bytes, secrets: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows and tags of a text with the byte ranges of its secrets' values."""
    rows, starts, ends, _ = features([text])
    tags = np.zeros(len(starts), np.int64)
    for a, b in secrets:
        i, j = np.searchsorted(ends, a, "right"), np.searchsorted(starts, b)
        tags[i:j] = INSIDE
        tags[i : i + 1] = BEGIN
    return rows, tags


def values_of(text: str) -> list[tuple[int, int]]:
    """Disjoint ranges of the values the base patterns find, longest first where they overlap; a number of digits alone is no secret by itself."""
    found = []
    for kind, (p, group, least) in _BASE.items():
        found += [m.span(group) for m in p.finditer(text) if len(m[group]) >= least and not (kind == "hex" and m[group].isdigit())]
    out: list[tuple[int, int]] = []
    for a, b in sorted(found, key=lambda s: (s[0] - s[1], s)):
        if all(b <= c or d <= a for c, d in out):
            out.append((a, b))
    return sorted(out)


def windows(text: str, drawn: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Training windows of a text: around each secret as it stands and with its value spelt anew and its keyword hidden, and drawn ones elsewhere."""
    length = 2 * AROUND + 1
    rows, tags = [], []

    def take(x, y, i):
        a = max(0, min(i - AROUND, len(y) - length))
        if len(y) >= length:
            rows.append(x[a : a + length])
            tags.append(y[a : a + length])

    values = values_of(text)
    for salt in range(4 if values else 1):
        spelt, at, spots = [], 0, []
        for a, b in values:
            before = text[at:a]
            if salt:  # hide the word a pattern names
                before = re.sub("(?i)(password|passwd|secret|token|api_?key)", ("value", "key", "auth", "bearer")[(a + salt) % 4], before)
            spelt.append(before)
            new = _respelt(text[a:b], salt) if salt else text[a:b]
            begin = sum(len(s.encode("utf-8", "replace")) for s in spelt)
            spelt.append(new)
            spots.append((begin, begin + len(new.encode("utf-8", "replace"))))
            at = b
        whole = ("".join(spelt) + text[at:]).encode("utf-8", "replace")
        x, y = _tagged(whole, spots)
        for i in np.flatnonzero(y == BEGIN):
            take(x, y, int(i))
        if not salt and len(y):
            seed = zlib.crc32(whole)
            long_ = np.flatnonzero((y == 0) & ((x[:, 0] // 256) >= 6))  # longer tokens are what must be told apart
            for k in range(drawn):
                pool = long_ if k % 2 and len(long_) else np.arange(len(y))
                take(x, y, int(pool[(seed + k * 2654435761) % len(pool)]))
    if not rows:
        return np.zeros((0, length, _N), np.int32), np.zeros((0, length), np.int64)
    return np.stack(rows), np.stack(tags)


def fit(docs: DataFrame, id_col: str = "doc_id", training_rows: int = 1500, steps: int = 40, l2: float = 1e-5) -> Field | None:
    """The field from a bounded sample of documents with and without base secrets; None where no secret is found in it.

    training_rows bounds the documents of the sample, about half of them with secrets; each brings at most 64 windows of 13 tokens, so the driver holds at most
    about 50 MB. Windows of one text are made in the task that holds the text; deterministic.

    Two rounds: the first learns from texts with base secrets alone. In other texts no pattern says that a token is no secret, so windows where
    the first field finds one are left out of the second round, which learns from all the rest.
    """
    rows = spread(docs.select(F.col(id_col).alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")))
    sign = "(?i:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]|AKIA[A-Z0-9]{14}|[0-9a-f]{16}"  # a cheap sign of base secrets
    has = F.col("text").rlike(sign)
    n = {r.has: r.n for r in rows.groupBy(has.alias("has")).agg(F.count(F.lit(1)).alias("n")).collect()}
    share = {h: min(1_000_000, training_rows * 500_000 // max(1, n.get(h, 0))) for h in (True, False)}
    lot = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit(11)), F.lit(1_000_000))
    picked = rows.filter(lot < max(share.values())).filter(lot < F.when(has, share[True]).otherwise(share[False]))

    def run(batches):
        for b in batches:
            for t in b.column(1).to_pylist():
                x, y = windows(t)
                if len(y):
                    yield pa.RecordBatch.from_arrays([pa.array([x[:64].astype(np.int32).tobytes()], pa.binary()), pa.array([y[:64].astype(np.int8).tobytes()], pa.binary())], ["x", "y"])

    held = sorted(tuple(r) for r in picked.mapInArrow(run, "x binary, y binary").collect())
    if not held:
        return None
    length = 2 * AROUND + 1
    x = np.concatenate([np.frombuffer(r[0], np.int32) for r in held]).reshape(-1, length, _N)
    y = np.concatenate([np.frombuffer(r[1], np.int8) for r in held]).reshape(-1, length).astype(np.int64)
    named = np.concatenate([np.full(len(r[1]) // length, 1 in r[1]) for r in held])  # windows of texts with base secrets
    if not named.any():
        return None
    field = _climbed(x[named], y[named], steps, l2)
    plain = np.array([not field.decode(w).any() for w in x[~named]], bool)
    if not plain.any():
        return field
    keep = named.copy()
    keep[np.flatnonzero(~named)[plain]] = True
    return _climbed(x[keep], y[keep], steps, l2)


def _climbed(x: np.ndarray, y: np.ndarray, steps: int, l2: float) -> Field:
    """The field of most likelihood, near enough: Adam steps over all windows, from zero."""
    used, at = np.unique(x, return_inverse=True)  # only features that occur have weights to move
    at = at.reshape(x.shape)
    small = Field(np.zeros((len(used), 3)), np.zeros((3, 3)), np.zeros(3))
    parts = [small.weights, small.moves, small.first]
    m, v = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    for t in range(1, steps + 1):
        _, *g = gradient(small, at, y)
        for k, p in enumerate(parts):
            d = g[k] / len(y) - l2 * p
            m[k], v[k] = 0.9 * m[k] + 0.1 * d, 0.99 * v[k] + 0.01 * d * d
            p += 0.3 * (1 - t / (steps + 1)) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)
    weights = np.zeros((FEATURES, 3))
    weights[used] = small.weights
    return Field(weights, small.moves, small.first)


# --- the operator --------------------------------------------------------------------------------------------------------------


def all_spans(texts: list[bytes], field: Field | None) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of texts in code points; spans of the field that touch a base span add nothing and are left out."""
    found = field.spans(texts) if field else {}
    out = []
    for k, text in enumerate(texts):
        whole = text.decode("utf-8", "surrogatepass")
        base, own = base_spans(whole), found.get(k, [])
        if own and len(whole) != len(text):  # bytes to code points
            point = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
            own = [(int(point[a]), int(point[b])) for a, b in own]
        added = [(MODEL, a, b) for a, b in own if all(b <= c or d <= a for _, c, d in base)]
        out.append((base, sorted(base + added, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))))
    return out


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """docs with n_assign, n_access, n_hex, base_sha256, spans and n_model.

    spans: all spans as kind:start:end by start, then kind (assign, access, hex, model), comma-joined, in code points, end exclusive; base_sha256: the digest of
    the same for base kinds only; counts by kind. Spans of the field never remove or change a base span, and those that touch one are left out.

    Whole texts are scanned. Null and empty texts hold nothing. Rows repeating an id are scanned each. The field is fitted on a bounded sample of the texts
    themselves (see fit), without labels; where that holds no base secret there are base spans only. Columns of docs with the new names are
    replaced. An empty table gives an empty result.
    """
    field = fit(docs, id_col, **options)
    names = ["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_model"]

    def make():
        def fn(texts, table):
            base, spans = zip(*all_spans(texts, field))
            count = lambda kind, of: pa.array([sum(s[0] == kind for s in d) for d in of], pa.int64())
            digest = [hashlib.sha256(joined(b).encode()).hexdigest() for b in base]
            return [*(count(k, base) for k in PATTERNS), pa.array(digest), pa.array([joined(s) for s in spans]), count(MODEL, spans)]

        return fn

    rows = spread(docs.select(packed_row(docs), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")))
    out = append_columns(rows, "text", "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_model long", make)
    return out.select(*[F.col(f"row.`{c}`") for c in docs.columns if c.lower() not in names], *names)
