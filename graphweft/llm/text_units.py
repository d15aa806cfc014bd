"""Character classes and word bounds over whole batches of texts, in numpy."""

from __future__ import annotations

import functools

import numpy as np
import regex

LETTER, NUMBER, SPACE, OTHER, END = range(5)
#: Ranges that every Unicode version in use classes alike (ideographs, Hangul); the rest is asked of the tokenizer library.
_SETTLED = ((0x3400, 0x4DB6), (0x4E00, 0x9FA6), (0xAC00, 0xD7A4), (0x20000, 0x2A6D7))


@functools.cache
def classes(library: bool = True) -> np.ndarray:
    """Class of every code point. ``library``: letters and numbers as the tokenizer library's Unicode version has them."""
    table = np.full(0x110000, OTHER, np.uint8)
    points = np.concatenate((np.arange(0xD800), np.arange(0xE000, 0x110000)))
    text = points.astype(np.uint32).tobytes().decode("utf-32-le")
    for code, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, text):
            table[points[m.start() : m.end()]] = code
    if library:
        try:
            from tokenizers.pre_tokenizers import ByteLevel
        except ImportError:
            return table
        split = ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
        for code, mate in ((LETTER, "a"), (NUMBER, "1")):
            ask = [c for c in np.flatnonzero(table == code).tolist() if not any(a <= c < b for a, b in _SETTLED)]
            cut = {a for _, (a, _) in split("".join(f"{mate}{chr(c)}\n" for c in ask))}
            table[[c for i, c in enumerate(ask) if 3 * i + 1 in cut]] = OTHER
    return table


def join(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """The texts in one string, each followed by one character; its code points; where those characters are."""
    joined = "\0".join(texts) + "\0"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
    return joined, codes, ends


def slices(sizes: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Runs of rows of at most ``most`` characters together; a longer text is a run of its own."""
    out, begin, total = [], 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > begin and total + n > most:
            out.append((begin, i))
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        out.append((begin, len(sizes)))
    return out
