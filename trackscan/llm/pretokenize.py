"""Boundaries of byte-level BPE pre-tokens by an associative scan of transition functions.

Each code point gets a symbol from its class and up to two code points ahead. A symbol acts on the
eight states below, so it is a function state -> state; functions compose associatively, so the
state before every code point of a batch comes from one blocked prefix scan over table look-ups.
No regular expression runs over the text. The boundaries are those of the public pattern

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np

from trackscan.llm.textvec import LETTER, LIMIT, NUMBER, OTHER, SPACE

# States: in a run of letters, numbers, others; after white space; after the one space that may lead
# a run; two or one more letters of a contraction due; after a contraction or at the start.
L, N, O, W, P, C2, C1, E = range(8)
# Symbols: the four classes (white space that more of it or the end follows), the last white space
# before something else, the last plain space before something else, and apostrophes before one or
# two letters that make a contraction.
LAST, LEAD, Q1, Q2 = 4, 5, 6, 7
BLOCK = 64


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """(next state, whether a pre-token begins here)."""
    if symbol == LETTER:
        if state in (C1, C2):
            return (E if state == C1 else C1), False
        return L, state not in (L, P)
    if symbol == NUMBER:
        return N, state not in (N, P)
    if symbol == SPACE:
        return W, state not in (W, P)
    if symbol in (LAST, LEAD):
        return (W if symbol == LAST else P), True
    if state in (O, P):
        return O, False
    return {OTHER: O, Q1: C1, Q2: C2}[symbol], True


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(compose[f, g] = g after f, apply[f, state], begins[symbol, state], first[symbol])."""
    base = [tuple(_step(s, x)[0] for s in range(8)) for x in range(8)]
    base += [(f[E],) * 8 for f in base]  # at the start of a text: whatever came before is forgotten
    known = {f: i for i, f in enumerate(dict.fromkeys(base))}
    grew = True
    while grew:
        grew = False
        for f in list(known):
            for g in base:
                h = tuple(g[x] for x in f)
                if h not in known:
                    known[h] = len(known)
                    grew = True
    kind = np.uint8 if len(known) <= 256 else np.uint16
    compose = np.zeros((len(known), len(known)), kind)
    for f, i in known.items():
        for g, j in known.items():
            compose[i, j] = known[tuple(g[x] for x in f)]
    apply = np.array(list(known), np.uint8)
    begins = np.array([[_step(s, x)[1] for s in range(8)] for x in range(8)])
    return compose, apply, begins, np.array([known[f] for f in base], kind)


@lru_cache(1)
def classes() -> np.ndarray:
    """Class of each code point as the tokenizer libraries see it.

    Two Unicode tables of different age are compared; where they differ, the tokenizer library
    itself is asked whether the code point joins a run of letters, of numbers or of others.
    """
    import regex
    from tokenizers import pre_tokenizers

    every = "".join(chr(c) for c in range(LIMIT) if not 0xD800 <= c < 0xE000)
    at = np.frombuffer(every.encode("utf-32-le"), np.uint32)
    newer = np.full(LIMIT, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            newer[at[m.start() : m.end()]] = kind
    older = np.fromiter(({"L": LETTER, "N": NUMBER}.get(unicodedata.category(c)[0], OTHER) for c in every), np.uint8, len(every))
    unsure = at[(older != newer[at]) & (newer[at] != SPACE)]
    split = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
    for c in unsure.tolist():
        newer[c] = next((kind for kind, mate in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")) if len(split(mate + chr(c))) == 1), SPACE)
    return newer


def _scan(f: np.ndarray, compose: np.ndarray) -> np.ndarray:
    """Inclusive prefix compositions of the functions f, block by block, then over blocks."""
    n = len(f)
    if n <= BLOCK:
        out = f.copy()
        for i in range(1, n):
            out[i] = compose[out[i - 1], f[i]]
        return out
    rows = n // BLOCK
    body = np.ascontiguousarray(f[: rows * BLOCK].reshape(rows, BLOCK).T)
    for i in range(1, BLOCK):
        body[i] = compose[body[i - 1], body[i]]
    before = _scan(body[-1].copy(), compose)
    body[:, 1:] = compose[before[:-1], body[:, 1:]]
    rest = f[rows * BLOCK :].copy()
    last = body[-1, -1]
    for i in range(len(rest)):
        last = rest[i] = compose[last, rest[i]]
    return np.concatenate([body.T.reshape(-1), rest])


def boundaries(points: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin, ascending, over all texts of a batch."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    compose, apply, begins, base = _tables()
    symbol = classes()[points]
    heads = bounds[:-1][bounds[:-1] < bounds[1:]]
    tails = bounds[1:][bounds[:-1] < bounds[1:]] - 1
    white = symbol == SPACE
    lead = np.zeros(n, bool)
    lead[:-1] = white[:-1] & ~white[1:]
    lead[tails] = False
    quotes = np.flatnonzero(points == 0x27)
    if len(quotes):
        end = bounds[np.searchsorted(bounds, quotes, "right")]
        one, two = (np.where(quotes + k < end, points[np.minimum(quotes + k, n - 1)], 0) for k in (1, 2))
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = np.zeros(len(quotes), bool)
        for a, b in ("re", "ve", "ll"):
            long |= (one == ord(a)) & (two == ord(b))
        symbol[quotes[short]] = Q1
        symbol[quotes[long]] = Q2
    plain = points == 0x20
    symbol[lead & ~plain] = LAST
    symbol[lead & plain] = LEAD
    f = base[symbol]
    f[heads] = base[symbol[heads] + 8]
    state = np.empty(n, np.uint8)
    state[0] = E
    state[1:] = apply[_scan(f, compose)[:-1], E]
    state[heads] = E
    return np.flatnonzero(begins[symbol, state] | _at(heads, n))


def _at(where: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, bool)
    out[where] = True
    return out
