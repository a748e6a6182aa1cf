"""k-mer codes in numpy, for work inside tasks: a k-mer is a list of longs of up to 31 bases, as in sequences.code_of()."""

from __future__ import annotations

import numpy as np

from hetspark.functions.sequences import LONGEST, word_bounds

#: The value of each letter, 4 for those that end a run.
VALUES = np.full(256, 4, np.uint8)
for _i, _pair in enumerate(("aA", "cC", "gG", "tT")):
    for _c in _pair:
        VALUES[ord(_c)] = _i

Words = list[np.ndarray]
FULL = np.int64((1 << 2 * LONGEST) - 1)


def values(text: bytes) -> np.ndarray:
    return VALUES[np.frombuffer(text, np.uint8)]


def _doubled(v: np.ndarray, n: int, reverse: bool) -> np.ndarray:
    """Codes of all windows of n letters, or of their reverse complements, put together from windows of 1, 2, 4 ... letters."""
    m, part, width, out, have = len(v) - n + 1, (3 - v if reverse else v).astype(np.int64) & 3, 1, np.int64(0), 0
    while True:
        if n & width:
            piece = part[have : have + m]
            out = (piece << 2 * have) | out if reverse else (out << 2 * width) | piece
            have += width
        if have == n:
            return out
        part = (part[width:] << 2 * width) | part[:-width] if reverse else (part[:-width] << 2 * width) | part[width:]
        width *= 2


def windows(v: np.ndarray, k: int) -> Words:
    """The codes of all k-mers of letters v, those with values over 3 included."""
    m = len(v) - k + 1
    return [_doubled(v[at : at + m + n - 1], n, False) for at, n in word_bounds(k)]


def broken(v: np.ndarray, k: int) -> np.ndarray:
    """Whether a letter ends a run within each k-mer of v."""
    ends = np.concatenate([[0], np.cumsum(v > 3)])
    return ends[k:] > ends[:-k]


def _reversed(word: np.ndarray, n: int) -> np.ndarray:
    x = (~word.astype(np.uint64)).byteswap()
    for by, mask in ((4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333)):
        x = ((x >> np.uint64(by)) & np.uint64(mask)) | ((x & np.uint64(mask)) << np.uint64(by))
    return (x >> np.uint64(64 - 2 * n)).astype(np.int64)


def reverse_complement(words: Words, k: int) -> Words:
    """Each word is turned around; what follows the last one's bases moves up."""
    turned = [_reversed(w, n) for w, (_, n) in zip(words, word_bounds(k), strict=True)][::-1]
    if len(turned) == 1:
        return turned
    last = word_bounds(k)[-1][1]
    low = np.int64((1 << 2 * last) - 1)
    return [*(((x & low) << 2 * (LONGEST - last)) | (y >> 2 * last) for x, y in zip(turned, turned[1:], strict=False)), turned[-1] & low]


def less(a: Words, b: Words) -> np.ndarray:
    out = a[-1] < b[-1]
    for x, y in zip(a[-2::-1], b[-2::-1], strict=True):
        out = (x < y) | ((x == y) & out)
    return out


def chosen(first: np.ndarray, a: Words, b: Words) -> Words:
    return [np.where(first, x, y) for x, y in zip(a, b, strict=True)]


def canonical(words: Words, k: int) -> Words:
    other = reverse_complement(words, k)
    return [np.minimum(words[0], other[0])] if len(words) == 1 else chosen(less(words, other), words, other)


def same(words: Words, by: int = 1) -> np.ndarray:
    """Whether each row equals the one `by` rows later."""
    out = words[0][by:] == words[0][:-by]
    for w in words[1:]:
        out &= w[by:] == w[:-by]
    return out


def order(words: Words) -> np.ndarray:
    return np.argsort(words[0]) if len(words) == 1 else np.lexsort(words[::-1])


def place(k: int, pos: int) -> tuple[int, int]:
    """(word, bits below) of a base."""
    at, n = word_bounds(k)[pos // LONGEST]
    return pos // LONGEST, 2 * (at + n - 1 - pos)


def summed(words: Words, counts: np.ndarray) -> tuple[Words, np.ndarray]:
    """Different rows, in order, with their counts added up."""
    if not len(counts):
        return words, counts
    if len(words) == 1 and counts.max() == 1:
        words = [np.sort(words[0])]
        first = np.flatnonzero(np.concatenate([[True], ~same(words)]))
        return [words[0][first]], np.diff(np.append(first, len(counts)))
    at = order(words)
    words = [w[at] for w in words]
    first = np.flatnonzero(np.concatenate([[True], ~same(words)]))
    return [w[first] for w in words], np.add.reduceat(counts[at], first)


# --- runs of k-mers ---------------------------------------------------------------------------------------------------

#: Letters of the short words by which runs are dealt out, and letters that are cut into runs at a time.
SEED, SLICE = 9, 1 << 21


def run_words(k: int) -> tuple[int, int]:
    """(longs that hold a run, k-mers in it at most)."""
    n = -(-k // LONGEST)
    n += LONGEST * n - k < 7
    return n, min(LONGEST, LONGEST * n - k + 1)


def runs(v: np.ndarray, k: int, places: bool = False) -> tuple:
    """(bucket, n, words), and the place of each run's first letter where asked for: k-mers of v that follow each other and have their least seed in common, as one run of letters.

    The seeds of a k-mer are those of its reverse complement, least by a hash; so all places of a k-mer, on both
    strands, are in runs of one bucket.
    """
    longs, most = run_words(k)
    m, s = len(v) - k + 1, min(SEED, k)
    if m <= 0:
        return np.zeros(0, np.int32), np.zeros(0, np.int32), [np.zeros(0, np.int64)] * longs, *[np.zeros(0, np.int64)] * places
    least = _hashed(np.minimum(_doubled(v, s, False), _doubled(v, s, True)))
    wide, have = k - s + 1, 1
    while 2 * have <= wide:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < wide:
        least = np.minimum(least[: have - wide], least[wide - have :])
    bad = broken(v, k)
    new = np.ones(m, bool)
    new[1:] = (least[1:] != least[:-1]) | bad[:-1]
    at = np.arange(m)
    begins = np.maximum.accumulate(np.where(new, at, 0))
    starts = ~bad & ((at - begins) % most == 0)
    ends = np.append(np.flatnonzero(starts | bad), m)
    first = np.flatnonzero(starts)
    n = ends[np.searchsorted(ends, first) + 1] - first
    padded = np.concatenate([v, np.zeros(LONGEST * (longs + 1), np.uint8)])
    word = _doubled(padded, LONGEST, False)
    words = []
    for q in range(longs):
        used = np.clip(n + k - 1 - LONGEST * q, 0, LONGEST)
        words.append(word[first + LONGEST * q] & (np.int64(-1) << 2 * (LONGEST - used)))
    return least[first], n.astype(np.int32), words, *[first] * places


def _hashed(seed: np.ndarray) -> np.ndarray:
    return ((seed.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int32)


def bucket_of(words: Words, k: int) -> np.ndarray:
    """The bucket that runs() puts k-mers into."""
    s, best = min(SEED, k), None
    low = np.int64((1 << 2 * s) - 1)
    for i in range(k - s + 1):
        j, by = place(k, i + s - 1)
        seed = words[j] >> by
        missing = s - (i + s - 1 - word_bounds(k)[j][0] + 1)  # bases that stand in the long before
        if missing > 0:
            seed = (words[j - 1] << 2 * (s - missing)) | seed
        seed &= low
        here = _hashed(np.minimum(seed, _reversed(seed, s)))
        best = here if best is None else np.minimum(best, here)
    return best


def looked_up(table: Words, counts: np.ndarray, asked: Words) -> np.ndarray:
    """The count of each k-mer of a table, 0 of others."""
    out = np.zeros(len(asked[0]), np.int64)
    if not len(counts) or not len(out):
        return out
    if len(table) > 1:  # one number for each k-mer of either
        both = np.stack([np.concatenate(x) for x in zip(table, asked, strict=True)], axis=1)
        _, number = np.unique(both, axis=0, return_inverse=True)
        number = number.reshape(-1)
        return looked_up([number[: len(counts)]], counts, [number[len(counts) :]])
    at = np.argsort(table[0])
    there = table[0][at]
    found = np.minimum(np.searchsorted(there, asked[0]), len(there) - 1)
    met = there[found] == asked[0]
    out[met] = counts[at[found[met]]]
    return out


def opened(n: np.ndarray, words: Words, k: int) -> tuple[np.ndarray, Words]:
    """(row, words): the k-mers of runs, and the run that each one is from."""
    row = np.repeat(np.arange(len(n)), n)
    by = 2 * (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n))
    out = []
    for j, (_, bases) in enumerate(word_bounds(k)):
        full = (words[j][row] << by) & FULL
        if j + 1 < len(words):
            full |= words[j + 1][row] >> (2 * LONGEST - by)
        out.append(full >> 2 * (LONGEST - bases))
    return row, out
