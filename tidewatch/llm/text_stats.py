"""Counts over one whole text, taken from its UTF-8 bytes."""

from __future__ import annotations

import numpy as np

SPACES = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
#: Second and later bytes of a code point.
LATER = bytes(range(0x80, 0xC0))
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGITS = bytes(range(48, 58))
_STOPS = b".,;:!?"
#: A letter or a byte of a non-ASCII code point becomes "a", white space a blank; the rest is deleted.
_LETTERLIKE = _UPPER + _LOWER + bytes(range(0x80, 0x100))
_TO_A = bytes(97 if b in _LETTERLIKE else 32 for b in range(256))
_NOT_A_WORD = bytes(b for b in range(256) if b not in _LETTERLIKE and b not in SPACES)

NAMES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters",
    "n_alpha_words", "n_digits", "n_stops", "n_distinct_words", "n_top_word", "n_bytes", "n_exclaim",
)


def _count(text: bytes, of: bytes) -> int:
    return len(text) - len(text.translate(None, of))


def repeat_words(ids: np.ndarray) -> int:
    """Words in 3-word windows that are found twice or more, the first included."""
    n = len(ids)
    if n < 4:
        return 0
    top = int(ids.max()) + 1
    pair = ids[:-2] * top + ids[1:-1]
    if top >= 1 << 20:
        pair = np.unique(pair, return_inverse=True)[1]
    _, place, counts = np.unique(pair * top + ids[2:], return_inverse=True, return_counts=True)
    again = counts[place] > 1
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= again
    return int(covered.sum())


def measure(text: bytes | None) -> tuple[int, ...]:
    """The counts in the order of NAMES; a null text counts as empty.

    Words are maximal runs without ASCII white space; lines are cut at newlines and count if they
    hold a word; letters and upper case are of ASCII; a word is alphabetic if it has an ASCII
    letter or any non-ASCII code point.
    """
    text = text or b""
    found = text.split()
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in found], np.int64)
    lines = [x for x in text.split(b"\n") if x.strip()]
    upper = _count(text, _UPPER)
    return (
        len(found),
        len(text.translate(None, SPACES + LATER)),
        _count(text, SYMBOLS),
        len(lines) - len(set(lines)),
        repeat_words(ids),
        len(lines),
        upper,
        upper + _count(text, _LOWER),
        len(text.translate(_TO_A, _NOT_A_WORD).split()),
        _count(text, _DIGITS),
        _count(text, _STOPS),
        len(number),
        int(np.bincount(ids).max()) if found else 0,
        len(text),
        text.count(b"!"),
    )
