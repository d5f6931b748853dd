"""Phrases found in batches of texts: numpy over the bytes of many texts at once.

`filters` says what a phrase is. Each stretch of as many words as some phrase has is met by its hash, and only those that
a table of bits lets through are looked at themselves.
"""

import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from moodquarry.operators.word_rules import hashes, slices

BITS = (12, 24)  # the least and most bits of a hash that the table knows
MIX = np.uint64(0x9E3779B97F4A7C15)


def word_characters() -> np.ndarray:
    """A bit for each code point: whether it is a letter, a number or an underscore."""
    return np.packbits(np.fromiter((c == "_" or unicodedata.category(c)[0] in "LN" for c in map(chr, range(0x110000))), bool, 0x110000))


@dataclass
class Phrases:
    """Phrases by the part from their first to their last word, of as many words as `sizes` says, by its hash.

    `ends` has what stands before and after those of which no phrase is that part alone.
    """

    cores: pa.Array
    ends: dict[int, list[tuple[bytes, bytes]]]
    sizes: list[int]
    hashes: np.ndarray
    base: int
    bits: int
    letters: np.ndarray

    @staticmethod
    def of(parted: list[dict], letters: np.ndarray) -> "Phrases":
        by_core: dict[bytes, list[tuple[bytes, bytes]]] = {}
        for p in parted:
            by_core.setdefault(p["core"].encode(), []).append((p["lead"].encode(), p["tail"].encode()))
        cores, base = pa.array(by_core, pa.binary()), 0x9E3779B97F4A7C15
        found = hashes(cores, base)
        while len(np.unique(found)) < len(found):  # another base parts those that this one does not
            base = (base * 5 + 2) % (1 << 64) | 1
            found = hashes(cores, base)
        order, (least, most) = np.argsort(found), BITS
        cores, every = cores.take(pa.array(order)), list(by_core.values())
        ends = {i: every[at] for i, at in enumerate(order.tolist()) if (b"", b"") not in every[at]}
        bits = min(most, max(least, (16 * len(cores)).bit_length()))
        return Phrases(cores, ends, sorted({(p["n"] + 1) // 2 for p in parted}), found[order], base, bits, letters)

    def finder(self) -> "Finder":
        return Finder(self)


class Finder:
    """What a task needs to find phrases."""

    def __init__(self, phrases: Phrases):
        self.phrases, self.letters = phrases, np.unpackbits(phrases.letters).astype(bool)
        self.ascii = np.concatenate([self.letters[:128], np.zeros(128, bool)])
        self.table = np.zeros(1 << phrases.bits, bool)
        self.table[self._place(phrases.hashes)] = True
        self.powers = self.back = np.zeros(0, np.uint64)

    def _place(self, found: np.ndarray) -> np.ndarray:
        return (found * MIX) >> np.uint64(64 - self.phrases.bits)

    def _powers(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The powers of the base from the first one on, and those of its inverse from none on."""
        if len(self.powers) < size:
            base = self.phrases.base
            self.powers = np.cumprod(np.full(size, base, np.uint64))
            self.back = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, pow(base, -1, 1 << 64), np.uint64))])
        return self.powers[:size], self.back

    def _in_words(self, data: np.ndarray) -> np.ndarray:
        """Whether each byte of UTF-8 text belongs to a word."""
        word, first = self.ascii[data], np.flatnonzero(data >= 0xC0)
        if len(first):
            padded = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int64)
            lead, b, c, d = (padded[first + i] & m for i, m in enumerate((0xFF, 0x3F, 0x3F, 0x3F)))
            point = np.where(
                lead < 0xE0, (lead & 0x1F) << 6 | b, np.where(lead < 0xF0, (lead & 0x0F) << 12 | b << 6 | c, (lead & 0x07) << 18 | b << 12 | c << 6 | d)
            )
            known = self.letters[np.minimum(point, 0x10FFFF)]
            longer = np.zeros(len(padded), bool)
            longer[: len(word)] = word
            for i, at_least in enumerate((0xC0, 0xC0, 0xE0, 0xF0)):
                some = lead >= at_least
                longer[first[some] + i] = known[some]
            word = longer[: len(word)]
        return word

    def has_any(self, texts: pa.Array) -> pa.Array:
        """Whether each text, in lower case, has a phrase as a whole."""
        out = [self._some(texts.slice(b, e - b)) for b, e in slices(texts)]
        return pa.array(np.concatenate(out) if out else np.zeros(0, bool))

    def _some(self, texts: pa.Array) -> np.ndarray:
        texts = pc.cast(pc.fill_null(texts, ""), pa.large_binary())
        found, (_, ends, held) = np.zeros(len(texts), bool), texts.buffers()
        ends = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        if ends[0] == ends[-1]:
            return found
        data = np.frombuffer(held, np.uint8)[ends[0] : ends[-1]]
        ends, size = ends - ends[0], len(data)
        word = self._in_words(data)
        cuts = ends[(ends > 0) & (ends < size)]
        before, after = np.concatenate([[False], word[:-1]]), np.concatenate([word[1:], [False]])
        before[cuts] = after[cuts - 1] = False
        starts, stops = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
        of = np.searchsorted(ends, starts, "right") - 1
        powers, back = self._powers(size)
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers, out=sums[1:])
        whole, p = None, self.phrases
        for k in p.sizes:
            n = len(starts) - k + 1
            if n < 1:
                continue
            s, e = starts[:n], stops[k - 1 :]
            number = (sums[e] - sums[s]) * back[s]
            maybe = np.flatnonzero(self.table[self._place(number)] & (of[:n] == of[k - 1 :]))
            at = np.minimum(np.searchsorted(p.hashes, number[maybe]), len(p.hashes) - 1)
            same = p.hashes[at] == number[maybe]
            maybe, at = maybe[same], at[same]
            whole = data.tobytes() if whole is None else whole
            for i, j, c, r in zip(s[maybe].tolist(), e[maybe].tolist(), at.tolist(), of[maybe].tolist()):
                if not found[r] and whole[i:j] == p.cores[c].as_py():
                    found[r] = c not in p.ends or any(self._stands(whole, word, i, j, ends[r], ends[r + 1], *x) for x in p.ends[c])
        return found

    @staticmethod
    def _stands(whole: bytes, word: np.ndarray, i: int, j: int, begin: int, end: int, lead: bytes, tail: bytes) -> bool:
        """Whether what is around the part from i to j is the phrase's, and nothing of a word touches it."""
        a, b = i - len(lead), j + len(tail)
        if a < begin or b > end or whole[a:i] != lead or whole[j:b] != tail:
            return False
        return not (lead and a > begin and word[a - 1]) and not (tail and b < end and word[b])
