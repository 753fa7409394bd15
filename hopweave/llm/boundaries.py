"""Pre-token boundaries by an associative scan, without a regular expression.

The pattern that rank files are used with,

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

is a finite automaton once each code point carries what lies just ahead of it
(is the next one white space, is this apostrophe the head of a contraction).
Every symbol is then a function from states to states.  Functions compose
associatively, and all compositions of the sixteen symbol functions form a
small monoid, so composing is one table look-up and a blocked prefix scan gives
the state at every code point of a whole batch in a few numpy passes.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import tiktoken

# The pattern above, for the probe of code point classes alone.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

LETTER, NUMBER, OTHER, SPACE = range(4)

# The code points with Unicode's White_Space property.
WHITE_SPACE = (
    0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, 0x2000, 0x2001, 0x2002, 0x2003, 0x2004, 0x2005,
    0x2006, 0x2007, 0x2008, 0x2009, 0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)

# States: what the token that reaches up to here is made of.  TWO and ONE have
# as many letters of a contraction still to come.
FRESH, LETTERS, NUMBERS, OTHERS, ATTACHED, BLANK, TWO, ONE = range(8)
# Symbols.  A blank that a token follows is JOINS (U+0020) or ALONE (others);
# SHORT and LONG are apostrophes ahead of 's 't 'm 'd and of 're 've 'll.
S_LETTER, S_NUMBER, S_OTHER, S_JOINS, S_ALONE, S_BLANK, S_SHORT, S_LONG = range(8)
FIRST = 8  # added to the symbol of a text's first code point


def _joined_to(probe: str) -> np.ndarray:
    """The code points that tiktoken keeps in one pre-token with a following
    ``probe``.  The vocabulary has all bytes and, as its only merges, every byte
    with the probe, so a merge shows that both stood in the same pre-token."""
    last = probe.encode()
    ranks = {bytes([b]): b for b in range(256)} | {bytes([b]) + last: 256 + b for b in range(256)}
    every = np.array([c for c in range(0x110000) if c not in WHITE_SPACE and not 0xD800 <= c < 0xE000])
    text = "".join(f"{chr(c)}{probe}\n" for c in every)
    ids = tiktoken.Encoding("probe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_to_numpy(text)
    return every[ids[np.flatnonzero(ids == 0x0A) - 1] >= 256]


@lru_cache(None)
def code_point_classes() -> np.ndarray:
    """Class of every code point, by the Unicode version that tiktoken has: the
    interpreter's own tables differ in some thousand younger letters."""
    table = np.full(0x110000, OTHER, np.uint8)
    table[_joined_to("a")] = LETTER
    table[_joined_to("1")] = NUMBER
    table[list(WHITE_SPACE)] = SPACE
    return table


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """State after the symbol, and whether a token begins at it."""
    if symbol >= FIRST:
        return _step(FRESH, symbol - FIRST)
    if state in (TWO, ONE):  # the look-ahead promised letters
        return (ONE if state == TWO else FRESH), False
    run = {S_LETTER: LETTERS, S_NUMBER: NUMBERS, S_OTHER: OTHERS, S_SHORT: OTHERS, S_LONG: OTHERS}
    if symbol == S_JOINS:
        return ATTACHED, True
    if symbol == S_ALONE:
        return FRESH, True
    if symbol == S_BLANK:
        return BLANK, state != BLANK
    if state == ATTACHED or run[symbol] == state:
        return run[symbol], False
    if symbol in (S_SHORT, S_LONG):
        return (ONE if symbol == S_SHORT else TWO), True
    return run[symbol], True


@lru_cache(None)
def _monoid():
    """Composition table, element of each symbol, each element's effect on
    FRESH, and begins[state, symbol]."""
    symbols = [tuple(_step(q, s)[0] for q in range(8)) for s in range(16)]
    elements = list(dict.fromkeys(symbols))
    known = {e: i for i, e in enumerate(elements)}
    for e in elements:  # grows while it runs: closure under composition
        for g in symbols:
            made = tuple(g[q] for q in e)
            if made not in known:
                known[made] = len(elements)
                elements.append(made)
    n = len(elements)
    table = np.array([[known[tuple(b[q] for q in a)] for b in elements] for a in elements], np.uint16)
    begins = np.array([[_step(q, s)[1] for s in range(16)] for q in range(8)])
    return table.ravel(), n, np.array([known[s] for s in symbols], np.uint16), np.array([e[FRESH] for e in elements], np.uint8), begins.ravel()


def _scan(items: np.ndarray, table: np.ndarray, n: int, width: int = 256) -> np.ndarray:
    """Inclusive prefix compositions of ``items``."""
    if len(items) <= width:
        out, acc = np.empty_like(items), None
        for i, x in enumerate(items.tolist()):
            acc = x if acc is None else int(table[acc * n + x])
            out[i] = acc
        return out
    rows = -(-len(items) // width)
    block = np.zeros(rows * width, np.uint16)
    block[: len(items)] = items
    block = np.ascontiguousarray(block.reshape(rows, width).T)  # one row of all blocks per step
    for j in range(1, width):
        block[j] = table[block[j - 1].astype(np.uint32) * n + block[j]]
    carry = _scan(block[-1], table, n)[:-1]
    block[:, 1:] = table[carry.astype(np.uint32)[None, :] * n + block[:, 1:]]
    return np.ascontiguousarray(block.T).ravel()[: len(items)]


def token_starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Boolean per code point: a token begins here.  ``first`` marks the first
    code point of each text of the concatenation."""
    n = len(points)
    if not n:
        return np.zeros(0, bool)
    table, size, of_symbol, on_fresh, begins = _monoid()
    kind = code_point_classes()[points]
    # What lies ahead, within the same text; 4 stands for a text's end.
    ahead = np.full(n, 4, np.uint8)
    ahead[:-1] = np.where(first[1:], 4, kind[1:])
    symbol = kind.copy()  # LETTER, NUMBER and OTHER are their own symbols
    blank = kind == SPACE
    symbol[blank] = np.where(ahead[blank] < SPACE, np.where(points[blank] == 0x20, S_JOINS, S_ALONE), S_BLANK)
    at = np.flatnonzero((points == 0x27) & (ahead == LETTER))
    if len(at):
        follow, after = points[at + 1], np.minimum(at + 2, n - 1)
        two = np.where((at + 2 < n) & ~first[after], points[after], 0)
        symbol[at[np.isin(follow, [ord(c) for c in "stmd"])]] = S_SHORT
        re_ve = np.isin(follow, [ord("r"), ord("v")]) & (two == ord("e"))
        symbol[at[re_ve | ((follow == ord("l")) & (two == ord("l")))]] = S_LONG
    symbol = symbol + FIRST * first.astype(np.uint8)
    state = on_fresh[_scan(of_symbol[symbol], table, size)]
    before = np.empty(n, np.uint8)
    before[0], before[1:] = FRESH, state[:-1]
    return begins[before * np.uint8(16) + symbol]


def pieces(column) -> tuple[bytes, np.ndarray, np.ndarray]:
    """For an Arrow string column: its concatenated UTF-8 bytes, the byte offset
    of every pre-token (and the end), and each text's first pre-token (and the
    number of pre-tokens)."""
    whole = [x or "" for x in column.to_pylist()]
    joined = "".join(whole)
    data = joined.encode()
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    lengths = np.fromiter(map(len, whole), np.int64, len(whole))
    begin = np.cumsum(lengths) - lengths
    first = np.zeros(len(points), bool)
    first[begin[lengths > 0]] = True
    starts = np.flatnonzero(token_starts(points, first))
    if len(data) == len(points):
        at = starts
    else:
        width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        at = (np.cumsum(width) - width)[starts]
    return data, np.append(at, len(data)), np.append(np.searchsorted(starts, begin), len(starts))
