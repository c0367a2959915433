"""Pre-token boundaries of many texts at once, without regular expressions.

The splitting rule of byte-level BPE vocabularies (contractions, letters, numbers, other signs,
white space) is a finite automaton with twelve states.  Each sign stands for a function from state
to state; such functions compose associatively, and only a few hundred different ones arise.  They
get numbers, and their composition is a table.  So a scan over signs is a scan over numbers: texts
are laid out in columns, each column is composed by table look-ups over all columns at once, then
the columns' totals are composed, and the state before every sign follows.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np

# Kinds of signs.
SPACE, WHITE, DIGIT, OTHER, QUOTE, LETTER, ONE, TWO, E, L, END = range(11)
# States: what the token holds after a sign.
(BEGIN, LETTERS, DIGITS, OTHERS, QUOTED, SHORT, HALF_E, HALF_L,
 ONE_SPACE, MANY_SPACE, ONE_WHITE, MANY_WHITE) = range(12)
N_STATES, N_KINDS = 12, 11

# White space outside the separator categories, and the contractions' letters.
CONTROLS = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x85)
ALONE, BEFORE_E, BEFORE_L = "stmd", "rv", "l"

_ENTERED = {
    SPACE: ONE_SPACE, WHITE: ONE_WHITE, DIGIT: DIGITS, OTHER: OTHERS, QUOTE: QUOTED,
    LETTER: LETTERS, ONE: LETTERS, TWO: LETTERS, E: LETTERS, L: LETTERS, END: BEGIN,
}
_LETTERS = (LETTER, ONE, TWO, E, L)


def step(state: int, kind: int) -> tuple[int, bool, bool]:
    """The next state; whether a token begins at this sign; whether one began at the sign before."""
    new, white = _ENTERED[kind], kind in (SPACE, WHITE)
    if kind == END:
        return BEGIN, True, state in (HALF_E, HALF_L)
    many = MANY_SPACE if kind == SPACE else MANY_WHITE
    if state == LETTERS and kind in _LETTERS or state == DIGITS and kind == DIGIT:
        return state, False, False
    if state == OTHERS and kind in (OTHER, QUOTE):
        return OTHERS, False, False
    if state == QUOTED:
        after = {ONE: SHORT, TWO: HALF_E, L: HALF_L, OTHER: OTHERS, QUOTE: OTHERS}.get(kind)
        return (new, True, False) if after is None else (after, False, False)
    if (state, kind) in ((HALF_E, E), (HALF_L, L)):
        return SHORT, False, False
    if state in (HALF_E, HALF_L):
        return new, kind not in _LETTERS, True
    if state in (ONE_SPACE, MANY_SPACE, ONE_WHITE, MANY_WHITE):
        if white:
            return many, False, False
        if state in (ONE_SPACE, MANY_SPACE):
            return OTHERS if kind == QUOTE else new, False, state == MANY_SPACE
        return new, True, state == MANY_WHITE
    return new, True, False


@cache
def automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number of each kind's function, their compositions, their values, what a step begins."""
    table = [[step(s, k) for s in range(N_STATES)] for k in range(N_KINDS)]
    functions = [tuple(range(N_STATES))]
    numbers = {functions[0]: 0}

    def number(f: tuple[int, ...]) -> int:
        if f not in numbers:
            numbers[f] = len(functions)
            functions.append(f)
        return numbers[f]

    kinds = np.array([number(tuple(x[0] for x in row)) for row in table], np.uint16)
    known, products = 0, {}
    while known < len(functions):  # all products of what is known, until none is new
        known = len(functions)
        for a in range(known):
            for b in range(known):
                if (a, b) not in products:
                    products[a, b] = number(tuple(functions[b][s] for s in functions[a]))
    size = len(functions)
    compose = np.zeros((size, size), np.uint16)
    for (a, b), c in products.items():
        compose[a, b] = c
    begins = np.array([[x[1] + 2 * x[2] for x in row] for row in table], np.uint8)
    return kinds, compose, np.array(functions, np.uint8), begins


@cache
def kind_table() -> np.ndarray:
    """Kind of each code point."""
    table = np.full(0x110000, OTHER, np.uint8)
    for code in range(0x110000):
        group = unicodedata.category(chr(code))
        if group[0] == "L":
            table[code] = LETTER
        elif group[0] == "N":
            table[code] = DIGIT
        elif group[0] == "Z":
            table[code] = WHITE
    table[list(CONTROLS)] = WHITE
    table[0x20], table[0x27] = SPACE, QUOTE
    for signs, kind in ((ALONE, ONE), (BEFORE_E, TWO), (BEFORE_L, L), ("e", E)):
        table[[ord(x) for x in signs]] = kind
    return table


def _states_before(kinds: np.ndarray, rows: int = 512) -> np.ndarray:
    """State before each sign, by the scan over function numbers."""
    numbers, compose, values, _ = automaton()
    n = len(kinds)
    size = compose.shape[0]
    flat = compose.reshape(-1)
    rows = max(1, min(rows, n))
    columns = -(-n // rows)
    padded = np.zeros(rows * columns, np.uint16)
    padded[:n] = numbers[kinds]
    grid = np.ascontiguousarray(padded.reshape(columns, rows).T)  # a text runs down a column
    before = np.empty((rows, columns), np.uint16)
    total = np.zeros(columns, np.uint16)
    for row in range(rows):
        before[row] = total
        total = flat[total.astype(np.int32) * size + grid[row]]
    state, at_top = BEGIN, np.empty(columns, np.uint8)
    for column, number in enumerate(total.tolist()):
        at_top[column] = state
        state = values[number, state]
    reached = values.reshape(-1)[before.astype(np.int32) * N_STATES + at_top]
    return np.ascontiguousarray(reached.T).reshape(-1)[:n]


def token_starts(body: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte positions where the pre-tokens of UTF-8 texts begin; none spans two texts."""
    if not len(body):
        return np.zeros(0, np.int64)
    lead = (body & 0xC0) != 0x80
    place = np.flatnonzero(lead)
    if len(place) == len(body):
        codes = body.astype(np.uint32)
    else:
        codes = np.frombuffer(body.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    kinds = kind_table()[codes]
    filled = offsets[1:][offsets[1:] > offsets[:-1]]
    ends = np.searchsorted(place, filled)  # in signs; an END follows each text
    signs = np.insert(kinds, ends, END)
    states = _states_before(signs)
    begins = automaton()[3].reshape(-1)[signs.astype(np.int32) * N_STATES + states]
    starts = (begins & 1).astype(bool)
    starts[:-1] |= begins[1:] > 1
    return place[starts[signs != END]]
