"""Word boundaries of the byte-level BPE pattern without a regular expression.

A batch of texts becomes one array of code points. Every code point gets a symbol (its class, refined by what follows
it), every symbol is a transition function on eight states, and an associative scan composes the functions: blocks of
the array are reduced to functions of their entry state side by side, the block functions are chained, and every block
is run once more from its known entry state. The output table of (state, symbol) says where a token begins.

The pattern: 's|'t|'re|'ve|'m|'ll|'d, an optional blank with a run of letters, numbers or other marks, white space up to
the last one before something visible, remaining white space.
"""

from __future__ import annotations

import sys
import unicodedata

import numpy as np

L, N, O, A, SP, WS, END = range(7)  # letter, number, other, apostrophe, blank, other white space, end of a text
SPACES = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
SENTINEL = 0x110000

# states: nothing open, run of letters, numbers, others, white space, a blank waiting for a run, one or two letters of a contraction to come
S0, SL, SN, SO, SW, SB, C1, C2 = range(8)
# symbols: the five visible or plain classes, then what look-ahead makes of apostrophes and white space
Y_L, Y_N, Y_O, Y_A1, Y_A2, Y_LAST_BLANK, Y_LAST_SPACE, Y_SPACE, Y_END = range(9)


def class_table() -> np.ndarray:
    """The class of every code point, and of the sentinel that ends a text."""
    kinds = {"L": L, "N": N}
    t = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], O) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    t[SPACES] = WS
    t[0x20] = SP
    t[0x27] = A
    return np.append(t, np.uint8(END))


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """(next state, does a token begin here) by symbol and state."""
    step, begin = np.zeros((9, 8), np.int8), np.ones((9, 8), bool)
    for y, run in ((Y_L, SL), (Y_N, SN), (Y_O, SO)):
        step[y] = run
        begin[y, [run, SB]] = False
    for y, after in ((Y_A1, C1), (Y_A2, C2)):  # inside a run of marks, or behind its blank, an apostrophe is a mark
        step[y] = after
        step[y, [SO, SB]] = SO
        begin[y, [SO, SB]] = False
    step[Y_L, C2], step[Y_L, C1] = C1, S0
    begin[Y_L, [C1, C2]] = False
    step[Y_LAST_BLANK] = SB
    step[Y_LAST_SPACE] = S0
    step[Y_SPACE] = SW
    begin[Y_SPACE, SW] = False
    step[Y_END] = S0
    return step, begin


STEP, BEGIN = _tables()
_PACKED = np.array([sum(int(s) << (4 * i) for i, s in enumerate(row)) for row in STEP], np.uint32)


def symbols(cps: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """The symbol of every code point of a batch whose texts each end with the sentinel."""
    k = classes[cps]
    nxt = np.empty_like(k)
    nxt[:-1], nxt[-1:] = k[1:], END
    y = np.array([Y_L, Y_N, Y_O, Y_O, Y_SPACE, Y_SPACE, Y_END], np.uint8)[k]
    visible = nxt <= A
    y[(k == SP) & visible] = Y_LAST_BLANK
    y[(k == WS) & visible] = Y_LAST_SPACE
    at = np.flatnonzero(k == A)
    at = at[at + 1 < len(cps)]
    one = cps[at + 1]
    two = cps[np.minimum(at + 2, len(cps) - 1)]
    single = np.isin(one, [ord(c) for c in "stmd"])
    double = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    y[at[single]] = Y_A1
    y[at[double]] = Y_A2
    return y


def states(y: np.ndarray, block: int = 1024) -> np.ndarray:
    """The state before every symbol, by a blocked scan over composed transition functions."""
    n = len(y)
    rows = -(-n // block)
    padded = np.full(rows * block, Y_END, np.uint8)
    padded[:n] = y
    cols = np.ascontiguousarray(padded.reshape(rows, block).T)
    # a block's function: packed as eight nibbles, composed symbol by symbol for all blocks at once
    shift = (4 * np.arange(8, dtype=np.uint32))[:, None]
    at = np.repeat(np.arange(8, dtype=np.uint32)[:, None], rows, axis=1)
    # a symbol whose function is constant forgets the entry state, so only what follows a block's last one counts
    constant = np.array([len(set(r)) == 1 for r in STEP.tolist()])
    last = block - 1 - np.argmax(constant[cols[::-1]], axis=0)
    first = int(last.min()) if constant[cols].any(axis=0).all() else 0
    for col in cols[first:]:
        f = _PACKED[col]
        at = (f[None, :] >> (at * 4)) & 15
    del shift
    entry, s = np.empty(rows, np.int64), S0
    for i, f in enumerate(at.T.tolist()):
        entry[i], s = s, f[s]
    out, now = np.empty((block, rows), np.uint8), entry.astype(np.uint32)
    for i, col in enumerate(cols):
        out[i] = now
        now = (_PACKED[col] >> (now * 4)) & 15
    return out.T.reshape(-1)[:n]


def boundaries(cps: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Positions where a token begins; the sentinel that ends each text counts as one."""
    y = symbols(cps, classes)
    return np.flatnonzero(BEGIN[y, states(y)])
