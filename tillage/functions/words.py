"""Words of folded texts as places in the bytes of an Arrow column, for many texts at once."""

from __future__ import annotations

import numpy as np

#: What words consist of; every byte of a character outside ASCII lies between words.
IN_WORD = np.zeros(256, bool)
IN_WORD[list(b"abcdefghijklmnopqrstuvwxyz0123456789_")] = True


def raw(texts) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets): the UTF-8 of all texts, one after the other, and where each begins and the last ends. Nulls are empty."""
    import pyarrow as pa

    texts = texts.fill_null("").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    if not len(texts) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def begins(data: np.ndarray, offsets: np.ndarray, since: int, to: int) -> np.ndarray:
    """Places in bytes [since, to) where a word of a text begins."""
    inside = IN_WORD[data[since:to]]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    if since and len(first):
        first[0] &= ~IN_WORD[data[since - 1]]
    own = offsets[np.searchsorted(offsets, since) : np.searchsorted(offsets, to)] - since  # a text's first byte follows no word
    first[own] = inside[own]
    return np.flatnonzero(first) + since


def occurrences(texts, terms: list[str], block: int = 1 << 20):
    """Yields (rows, numbers of terms, starts in characters) of every whole-word occurrence of a term in folded texts.

    A term is words with single blanks between them; nothing else can occur as whole words. Bytes are looked through in blocks,
    so what is held beside the texts is bounded, however long one is.
    """
    data, offsets = raw(texts)
    sought: dict[int, list[tuple[int, np.ndarray]]] = {}
    for number, term in enumerate(terms):
        code = np.frombuffer(term.encode(), np.uint8)
        if len(code) and all(w and IN_WORD[list(w.encode())].all() for w in term.split(" ")):
            sought.setdefault(int(code[0]), []).append((number, code))
    if not sought or not len(data):
        return
    known = np.zeros(256, bool)
    known[list(sought)] = True
    before, passed = np.zeros(len(offsets), np.int64), 0  # characters before each text; before this block
    for since in range(0, len(data), block):
        to = min(since + block, len(data))
        counted = np.cumsum((data[since:to] & 0xC0) != 0x80) + passed
        own = slice(np.searchsorted(offsets, since), np.searchsorted(offsets, to))
        before[own] = counted[offsets[own] - since] - 1
        passed = int(counted[-1])
        at = begins(data, offsets, since, to)
        at = at[known[data[at]]]
        letter = data[at]
        order = np.argsort(letter, kind="stable")
        at, letter = at[order], letter[order]
        row = np.searchsorted(offsets, at, "right") - 1
        end = offsets[row + 1]
        rows, numbers, starts = [], [], []
        for first, ones in sought.items():
            lo, hi = np.searchsorted(letter, [first, first + 1])
            for number, code in ones:
                i = lo + np.flatnonzero(end[lo:hi] - at[lo:hi] >= len(code))
                for j in range(1, len(code)):
                    i = i[data[at[i] + j] == code[j]]
                after = at[i] + len(code)
                i = i[(after == end[i]) | ~IN_WORD[data[np.minimum(after, len(data) - 1)]]]
                rows.append(row[i])
                numbers.append(np.full(len(i), number, np.int32))
                starts.append(counted[at[i] - since] - 1 - before[row[i]])
        yield np.concatenate(rows), np.concatenate(numbers), np.concatenate(starts)


def split(texts, block: int = 1 << 20):
    """(words, counts): the words of all folded texts, one after the other, as an Arrow column, and how many each text has."""
    import pyarrow as pa

    data, offsets = raw(texts)
    starts, places, letters, passed = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [], 0
    for since in range(0, len(data), block):
        part = data[since : since + block]
        inside = IN_WORD[part]
        at = begins(data, offsets, since, since + len(part))
        places.append(np.cumsum(inside)[at - since] - 1 + passed)
        starts.append(at)
        letters.append(part[inside])
        passed += len(letters[-1])
    starts = np.concatenate(starts)
    bounds = np.append(np.concatenate(places), passed)
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(np.concatenate(letters) if letters else data))
    return words, np.diff(np.searchsorted(starts, offsets))
