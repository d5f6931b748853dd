"""The score rules for batches of texts: Arrow arrays of words, numpy arrays of what they add.

`scoring` says which columns and terms come here. A batch is taken in slices, so that its words need little memory, and what
depends on a word alone is found once for each different word of a slice.
"""

import ctypes
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

APOSTROPHES = "\u2018\u2019\u02bc\uff07"  # all read as '
SLICE = 1 << 20  # bytes of text that are looked at together, or one longer text

KEPT = pa.struct([("pos", pa.float64()), ("neg", pa.float64()), ("npos", pa.int32()), ("nneg", pa.int32()), ("n", pa.int32())])


FEW = 5_000  # words that are searched without an order


BLOCK = 1 << 18  # bytes that are hashed together, or one longer word


def hashes(words: pa.Array, base: int) -> np.ndarray:
    """A number for each binary value: its bytes as digits to an odd base, in 64 bits."""
    out, size = np.zeros(len(words), np.uint64), len(words)
    if not size or words.buffers()[2] is None:
        return out
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + size + 1]
    data = np.frombuffer(words.buffers()[2], np.uint8)
    powers = np.cumprod(np.full(int(np.diff(ends).max()) + 1, base, np.uint64))
    i = 0
    while i < size:
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + BLOCK, "right")) - 1)
        lengths, starts = np.diff(ends[i : j + 1]), ends[i:j] - ends[i]
        part = data[ends[i] : ends[j]]
        digits = (part.astype(np.uint64) + np.uint64(1)) * powers[np.arange(len(part), dtype=np.int32) - np.repeat(starts, lengths)]
        some = np.flatnonzero(lengths)
        if len(some):
            out[i + some] = np.add.reduceat(digits, starts[some])
        i = j
    return out


@dataclass
class Known:
    """Different words. Many are ordered by their hashes, so that no batch has to look at all of them."""

    words: pa.Array
    hashes: np.ndarray | None = None
    base: int = 0

    @staticmethod
    def of(words: pa.Array) -> tuple["Known", np.ndarray]:
        """The words, and which of the given ones each is."""
        if len(words) > FEW:
            for base in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9):
                found = hashes(words, base)
                order = np.argsort(found, kind="stable")
                found = found[order]
                if (found[1:] != found[:-1]).all():
                    return Known(words.take(pa.array(order)), found, base), order
        return Known(words), np.arange(len(words))

    def at(self, words: pa.Array) -> np.ndarray:
        """Where each word stands, -1 if it does not."""
        if self.hashes is None:
            return places(words, self.words)
        own = hashes(words, self.base)
        order = np.argsort(own)
        at = np.empty(len(words), np.int64)
        at[order] = np.minimum(np.searchsorted(self.hashes, own[order]), len(self.hashes) - 1)
        same = self.hashes[at] == own
        maybe = np.flatnonzero(same)
        same[maybe] = pc.equal(words.take(pa.array(maybe)), self.words.take(pa.array(at[maybe]))).to_numpy(zero_copy_only=False)
        at[~same] = -1
        return at


@dataclass
class Terms:
    """Terms with a row of numbers each; `most` is how many words the longest one has. The rows of `own` come after those of `known`."""

    known: Known
    values: np.ndarray
    most: int
    own: pa.Array | None = None

    @staticmethod
    def of(table: pa.Table, width: int, most: int) -> "Terms":
        """Of a table of terms and their numbers."""
        words, numbers = (c.combine_chunks() for c in table.columns)
        known, order = Known.of(pc.cast(words, pa.binary()))
        return Terms(known, numbers.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)[order], most)

    def with_own(self, known: pa.Array | None, name: str) -> "Terms":
        """With those that the texts of a slice brought along."""
        if known is None:
            return self
        brought = known.flatten()
        brought = brought.filter(pc.is_valid(brought.field(name)))
        if not len(brought):
            return self
        width = self.values.shape[1]
        values = brought.field(name).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)
        return Terms(self.known, np.concatenate([self.values, values]), self.most, pc.cast(brought.field("_low"), pa.binary()))

    def at(self, words: pa.Array) -> np.ndarray:
        """Each word's row, -1 if it is no term."""
        at = self.known.at(words)
        if self.own is not None:
            left = np.flatnonzero(at < 0)
            more = places(words.take(pa.array(left)), self.own)
            at[left] = np.where(more < 0, -1, more + len(self.known.words))
        return at


def as_bytes(words: Iterable[str]) -> pa.Array:
    return pa.array([w.encode() for w in words], pa.binary())


def places(words: pa.Array, among: pa.Array) -> np.ndarray:
    """Where each word stands among others, -1 if it does not."""
    return pc.fill_null(pc.index_in(words, value_set=among), -1).to_numpy(zero_copy_only=False).astype(np.int64)


def _coded(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Each word's place among the different ones, and these as bytes."""
    both = words.dictionary_encode()
    return both.indices.to_numpy(zero_copy_only=False), pc.cast(both.dictionary, pa.binary())


def give_back() -> None:
    """Return the memory that Arrow and the C library keep for later."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def slices(texts: pa.Array, most: int = SLICE) -> Iterator[tuple[int, int]]:
    ends, begin = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64), 0
    while begin < len(texts):
        before = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, before + most, "right")))
        yield begin, end
        begin = end


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of batches of texts the different pieces between blanks and line feeds, and how often each one stands in some rows."""
    for batch in batches:
        give_back()
        texts = batch.column(0)
        for begin, end in slices(texts, 16 * SLICE):
            some = pc.replace_substring(pc.fill_null(texts.slice(begin, end - begin), ""), "\n", " ")
            found = pc.split_pattern(some, " ").flatten().value_counts()
            yield pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], ["piece", "n"])


def flat_words(texts: pa.Array, edge: str) -> tuple[pa.Array, np.ndarray]:
    """All words, with plain apostrophes and without punctuation at their edges unless they are nothing else, and the row of each."""
    for mark in APOSTROPHES:
        texts = pc.replace_substring(texts, mark, "'")
    parts = pc.split_pattern(texts, " ")
    words, rows = parts.flatten(), pc.list_parent_indices(parts)
    some = pc.not_equal(words, "")
    words, rows = words.filter(some), rows.filter(some).to_numpy(zero_copy_only=False)
    bare = pc.ascii_trim(words, characters=edge)
    return pc.if_else(pc.equal(bare, ""), words, bare), rows


def _stretch(words: pa.Array, k: int) -> pa.Array:
    if k == 1:
        return words
    n = len(words) - k + 1
    if n < 1:
        return words.slice(0, 0)
    return pc.binary_join_element_wise(*(words.slice(i, n) for i in range(k)), " ")


def stretches(texts: pa.Array, edge: str, sizes: range, known: Known | None) -> pa.Array:
    """For each text its stretches of as many words, joined by blanks: all of them, or the different ones that are not `known`."""
    out = []
    give_back()
    for begin, end in slices(texts):
        words, rows = flat_words(texts.slice(begin, end - begin), edge)
        found, of = [], []
        for k in sizes:
            whole = rows[: max(0, len(rows) - k + 1)] == rows[k - 1 :]
            grams, at = _stretch(words, k).filter(pa.array(whole)), rows[: len(whole)][whole]
            if known is not None:
                codes, different = _coded(grams)
                new = known.at(different) < 0
                pairs = np.unique((at.astype(np.int64) * len(different) + codes)[new[codes]])
                at, grams = pairs // max(1, len(different)), different.take(pa.array(pairs % max(1, len(different)))).cast(texts.type, safe=False)
            found.append(grams)
            of.append(at)
        every, at = pa.concat_arrays(found), np.concatenate(of)
        if len(sizes) > 1:
            order = np.argsort(at, kind="stable")
            every, at = every.take(pa.array(order)), at[order]
        offsets = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=end - begin))])
        out.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), every))
    return pa.concat_arrays(out) if out else pa.array([], pa.list_(texts.type))


BUCKETS = 1024  # into which counted stretches fall by their hash; one of them is added up at a time


def _packed(columns: list[pa.Array]) -> bytes:
    out, rows = pa.BufferOutputStream(), pa.RecordBatch.from_arrays(columns, ["term", "n"])
    with pa.ipc.new_stream(out, rows.schema) as writer:
        writer.write_batch(rows)
    return out.getvalue().to_pybytes()


def counted(batches: Iterator[pa.RecordBatch], edge: str, k: int) -> Iterator[pa.RecordBatch]:
    """Of batches of texts the different stretches of k words, joined by blanks, and how often each one stands in some rows: packed, by bucket."""
    for batch in batches:
        give_back()
        texts = batch.column(0)
        for begin, end in slices(texts, 4 * SLICE):
            words, rows = flat_words(texts.slice(begin, end - begin), edge)
            found = _stretch(words, k).filter(pa.array(rows[: max(0, len(rows) - k + 1)] == rows[k - 1 :])).value_counts()
            terms = pc.cast(found.field("values"), pa.binary())
            place = (hashes(terms, 0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % BUCKETS
            order = np.argsort(place.astype(np.int16), kind="stable")
            terms, n, ends = terms.take(pa.array(order)), found.field("counts").take(pa.array(order)), np.cumsum(np.bincount(place, minlength=BUCKETS))
            some = [(p, i, j) for p, (i, j) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist())) if i < j]
            parts = [_packed([terms.slice(i, j - i), n.slice(i, j - i)]) for _, i, j in some]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _, _ in some], pa.int32()), pa.array(parts, pa.binary())], ["bucket", "part"])
            words = rows = found = terms = place = order = n = parts = None
    give_back()


def added_up(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Of the parts that `counted` made, bucket after bucket, the stretches that stand `least` times in all."""

    def done(parts: list[pa.Table]) -> pa.RecordBatch:
        sums = pa.concat_tables(parts).group_by("term").aggregate([("n", "sum")])
        terms = sums.column("term").filter(pc.greater_equal(sums.column("n_sum"), least)).combine_chunks()
        return pa.RecordBatch.from_arrays([pc.cast(terms, pa.string())], ["term"])

    now, held = None, []
    for batch in batches:
        for bucket, part in zip(batch.column(0).to_pylist(), batch.column(1)):
            if bucket != now and held:
                yield done(held)
                held = []
            now = bucket
            held.append(pa.ipc.open_stream(part.as_buffer()).read_all())
    if held:
        yield done(held)
    held = []
    give_back()


def merged(words: pa.Array, rows: np.ndarray, terms: Terms) -> tuple[pa.Array, np.ndarray]:
    """The words with the longest term at each place, from left to right, as one word, and where each one begins; no word is in two terms."""
    sizes = np.ones(len(words), np.int64)
    for k in range(2, terms.most + 1):
        whole = rows[: max(0, len(rows) - k + 1)] == rows[k - 1 :]
        codes, different = _coded(_stretch(words, k))
        sizes[: len(whole)][whole & (terms.at(different) >= 0)[codes]] = k
    starts = np.flatnonzero(sizes > 1)
    begins, after, inner = np.ones(len(words), bool), 0, []
    kept = []
    for at, k in zip(starts.tolist(), sizes[starts].tolist()):
        if at >= after:  # a place within the term before it goes
            after = at + k
            kept.append(at)
            inner.extend(range(at + 1, after))
    begins[inner] = False
    one = np.ones(len(words), np.int64)
    one[kept] = sizes[kept]
    for k in range(2, terms.most + 1):
        at = one == k
        if at.any():
            words = pc.replace_with_mask(words, pa.array(at), _stretch(words, k).filter(pa.array(at[: len(words) - k + 1])))
    return words, np.flatnonzero(begins)


def mood_sums(texts: pa.Array, lows: pa.Array, ups: pa.Array, known: pa.Array | None, edge: str, terms: Terms, rules: "Rules") -> pa.Array:
    """For each text, in the three cases, the sums and numbers of its positive and negative words and the number of all."""
    give_back()
    parts = [
        _mood(*(c.slice(b, e - b) for c in (texts, lows, ups)), terms.with_own(None if known is None else known.slice(b, e - b), "valence"), edge, rules)
        for b, e in slices(texts)
    ]
    return pa.concat_arrays(parts) if parts else pa.array([], KEPT)


@dataclass
class Rules:
    """Degree and turn factor of each modifier, and the fixed values of the method."""

    modifiers: dict[str, tuple[float, float]]
    contraction: str | None
    negation: float
    degree: float
    damping: tuple[float, ...]
    caps: float
    praise: tuple[str, ...]
    praise_factor: float
    soft: tuple[str, ...]
    before_but: float
    after_but: float


def _mood(texts: pa.Array, lows: pa.Array, ups: pa.Array, terms: Terms, edge: str, rules: Rules) -> pa.Array:
    size = len(texts)
    (words, rows), (low, _), (up, _) = (flat_words(c, edge) for c in (texts, lows, ups))
    flat = lambda c: c.to_numpy(zero_copy_only=False)
    same, cased = flat(pc.equal(words, up)), flat(pc.not_equal(words, low))
    if terms.most > 1 and len(low):
        low, begins = merged(low, rows, terms)
        low, rows = low.take(pa.array(begins)), rows[begins]
        same, cased = np.logical_and.reduceat(same, begins), np.logical_or.reduceat(cased, begins)
    upper = same & cased
    n, count = len(low), np.bincount(rows, minlength=size)
    first = np.concatenate([[0], np.cumsum(count)[:-1]]) if size else np.zeros(0, np.int64)
    within = np.arange(n) - first[rows]
    loud_words = np.bincount(rows, upper, size)
    mixed = ((loud_words > 0) & (loud_words < count))[rows]

    codes, different = _coded(low)
    named = [*rules.modifiers, *rules.soft, *rules.praise, "of", "least", "never", "without", "doubt", "at", "very", "but"]
    code_of = dict(zip(named, places(as_bytes(named), different).tolist()))

    def one_of(*some: str) -> np.ndarray:
        flags = np.zeros(len(different) + 1, bool)
        flags[[code_of[w] for w in some]] = True
        return flags[:-1][codes]

    at = terms.at(different)
    has = (at >= 0)[codes]
    value = (np.where(at >= 0, terms.values[at, 0], 0.0) if len(terms.values) else np.zeros(len(different)))[codes]
    degree_of, turn_of = np.zeros(len(different)), np.ones(len(different))
    known = np.zeros(len(different), bool)
    if rules.contraction:
        known[:] = pc.ends_with(different, rules.contraction.encode()).to_numpy(zero_copy_only=False)
        turn_of[known] = rules.negation
    for word, (degree, turn) in rules.modifiers.items():
        i = code_of[word]
        if i >= 0:
            degree_of[i], turn_of[i], known[i] = degree, turn, True
    degree, turn, modifier = degree_of[codes], turn_of[codes], known[codes]

    def back(values: np.ndarray, d: int, none) -> np.ndarray:
        """What the word `d` places before has."""
        out = np.full_like(values, none)
        out[d:] = values[: max(0, n - d)]
        out[within < d] = none
        return out

    start = value + np.where(mixed & upper, np.sign(value) * rules.caps, 0.0)
    # Words that may change one after them; where there are none, nothing is to be done.
    soft, of, least = one_of(*rules.soft), one_of("of"), one_of("least")
    turns = (modifier & ~has) | soft | least
    near = back(turns, 1, False) | back(turns, 2, False) | back(turns, 3, False)
    shout = mixed & upper
    never, praise, without, doubt = one_of("never"), one_of(*rules.praise), one_of("without"), one_of("doubt")
    strength, praised, doubted = start, np.zeros(n, bool), np.zeros(n, bool)
    for d, damping in enumerate(rules.damping, 1):
        free = ~back(has, d, False)
        step = np.where(free, back(degree, d, 0.0), 0.0)
        step = (step + np.where((step != 0) & back(shout, d, False), rules.caps, 0.0)) * damping
        factor = np.where(free, back(turn, d, 1.0), 1.0)
        if d > 1:
            praised, doubted = praised | back(praise, d - 1, False), doubted | back(doubt, d - 1, False)
            factor = np.where(free & back(without, d, False) & doubted, 1.0, factor)
            factor = np.where(free & back(never, d, False) & praised, rules.praise_factor, factor)
        strength = (strength + step * np.sign(strength)) * factor
    for d in (2, 3):
        step = np.where(back(soft, d, False) & back(of, d - 1, False), -rules.degree, 0.0)
        strength = strength + step * np.sign(strength)
    but_not = back(one_of("at", "very"), 2, False)
    strength = strength * np.where(back(least & ~has, 1, False) & ~but_not, rules.negation, 1.0)
    strength = np.where(near, strength, start)

    # Words before the first "but" count less, words after it more.
    buts = np.flatnonzero(one_of("but"))
    but = np.full(size, -1)
    but[rows[buts[::-1]]] = within[buts[::-1]]
    but = but[rows]
    strength = strength * np.where((but < 0) | (within == but), 1.0, np.where(within < but, rules.before_but, rules.after_but))

    hit = has & (degree == 0)
    strength, of_row = strength[hit], rows[hit]
    sums = lambda x: np.bincount(of_row, x, size).astype(float)
    columns = (
        sums(np.maximum(strength, 0.0)), sums(np.fmin(strength, 0.0)), sums(~(strength <= 0)).astype(np.int32), sums(strength < 0).astype(np.int32), count.astype(np.int32),
    )
    return pa.StructArray.from_arrays([pa.array(c) for c in columns], fields=list(KEPT))


def value_sums(lows: pa.Array, known: pa.Array | None, edge: str, terms: Terms, name: str) -> pa.Array:
    """For each text the sums of its terms' numbers; null where a term has none."""
    out, width = [], terms.values.shape[1]
    give_back()
    for b, e in slices(lows):
        some, size = terms.with_own(None if known is None else known.slice(b, e - b), name), e - b
        words, rows = flat_words(lows.slice(b, size), edge)
        if some.most > 1 and len(words):
            words, begins = merged(words, rows, some)
            words, rows = words.take(pa.array(begins)), rows[begins]
        codes, different = _coded(words)
        at = some.at(different)[codes]
        at, rows = at[at >= 0], rows[at >= 0]
        sums = np.stack([np.bincount(rows, some.values[at, i], size) for i in range(width)], axis=1).reshape(-1).astype(float)
        out.append(pa.ListArray.from_arrays(pa.array(np.arange(size + 1) * width, pa.int32()), pa.array(sums, mask=np.isnan(sums))))
    return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.float64()))
