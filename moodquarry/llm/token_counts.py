"""Token counts of whole texts by a SentencePiece model; huge texts in overlapping chunks that are spliced."""

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodquarry.llm.tables import map_text

CHUNK = 1 << 15
OVERLAP = 1 << 9
LIMIT = 4096
_SPACE = "▁"  # how the models write a space


class Counter:
    """Counts the ids of texts; a text longer than `chunk` characters is encoded in chunks that overlap.

    Two neighbours are spliced at a place in their overlap where both have a token boundary and which is proven stable: no piece of the
    vocabulary holds the two characters beside it next to each other, so no merge across it is possible and what is on one
    side never changes the ids on the other. That is known of a space after another character, unless a piece has one inside, and of
    pairs of ASCII characters that no piece holds. Where the overlap has no such boundary it is doubled, back to the last
    splice; where there is none either, the chunk grows to the next stable place, or to the text's end. So a count is always that of the
    whole text, and no stretch is encoded more than a few times, whatever it holds.
    """

    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        from sentencepiece import SentencePieceProcessor

        self.model, self.chunk, self.overlap = SentencePieceProcessor(model_file=path), chunk, overlap
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        plain = [chr(c) for c in range(0x21, 0x7F) if chr(c) in set(pieces) and self.model.normalize("a" + chr(c)).endswith("a" + chr(c))]
        self.stable = np.zeros((130, 130), bool)  # by the characters before and after; 128 is any other, 129 one that the model makes a space or drops
        self.blank: dict[int, bool] = {}
        self.stable[np.ix_([ord(c) for c in plain], [ord(c) for c in plain])] = True
        for a, b in {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}:
            if max(a, b) < "\x80":
                self.stable[ord(a), ord(b)] = False
        self.proven = not any(_SPACE in p.lstrip(_SPACE) for p in pieces) and self.model.normalize("x  y") == f"{_SPACE}x{_SPACE * 2}y"
        if self.proven:
            self.stable[[c for c in range(129) if c == 128 or not self._is_blank(c)], ord(" ")] = True

    def _is_blank(self, code: int) -> bool:
        """Whether the model makes the character a space, or drops it."""
        if code not in self.blank:
            shown = self.model.normalize(f"a{chr(code)}a")
            self.blank[code] = code == 0x20 or shown.count(_SPACE) > 1 or shown == f"{_SPACE}aa"
        return self.blank[code]

    def _starts(self, text: str) -> np.ndarray:
        """Where in `text` the tokens begin."""
        return np.array([begin for begin, _ in self.model.encode(text, return_type="offset_mapping")["offsets"]], np.int64)

    def _stable_places(self, text: str) -> np.ndarray:
        """All places of `text` that are proven stable.

        A character after a pair of ASCII characters must be ASCII, too, lest it combines with the second one.
        """
        found, step = [np.empty(0, np.int64)], 1 << 20
        for at in range(0, len(text), step):
            raw = np.frombuffer((text[max(0, at - 1) : at + step + 1] + "a").encode("utf-32-le", "surrogatepass"), np.uint32)
            blank = [c for c in np.unique(raw[raw > 127]).tolist() if self._is_blank(c)]
            codes = np.where(np.isin(raw, blank), 129, np.minimum(raw, 128)) if blank else np.minimum(raw, 128)
            before, after, third = codes[:-2], codes[1:-1], codes[2:]
            n = min(len(before), step if at else step - 1)
            stable = self.stable[before, after] & ((after == 0x20) | (third < 128))
            found.append(np.flatnonzero(stable[:n]) + max(1, at))
        return np.concatenate(found)

    def _long(self, text: str) -> int:
        places = self._stable_places(text) if self.proven else ()
        if not len(places):
            return len(self.model.encode(text))
        at, end, total = 0, self.chunk, 0  # tokens before place `at` are counted in `total`
        starts, base = self._starts(text[:end]), 0
        while end < len(text):
            overlap = self.overlap
            while True:
                low = max(at, end - overlap)
                some = places[np.searchsorted(places, low, side="right") : np.searchsorted(places, end)]
                ahead = np.empty(0, np.int64)
                if len(some):
                    after = text[low : low + overlap + self.chunk]
                    ahead = self._starts(after) + low
                common = np.intersect1d(np.intersect1d(starts + base, ahead), some)
                if len(common):
                    break
                if low <= at:  # nothing to splice at in the whole chunk: it grows to the next place, or twofold
                    k = np.searchsorted(places, end)
                    grown = max(2 * end - at, int(places[k]) + self.overlap if k < len(places) else len(text))
                    end = min(len(text), grown)
                    starts = self._starts(text[base:end])
                    if end == len(text):
                        break
                overlap *= 2
            if not len(common):
                break
            cut = int(common[0])
            total += int(((starts + base >= at) & (starts + base < cut)).sum())
            at, end, starts, base = cut, min(len(text), low + len(after)), ahead - low, low
        return total + int((starts + base >= at).sum())

    def counts(self, texts: list[str]) -> list[int]:
        short = [i for i, t in enumerate(texts) if len(t) <= self.chunk]
        out = [0] * len(texts)
        for i, ids in zip(short, self.model.encode([texts[i] for i in short], return_type="numpy", num_threads=1)):
            out[i] = len(ids)
        for i, t in enumerate(texts):
            if len(t) > self.chunk:
                out[i] = self._long(t)
        return out


@functools.lru_cache(maxsize=2)
def counter(path: str, chunk: int, overlap: int) -> Counter:
    return Counter(path, chunk, overlap)


def count_tokens(
    df: DataFrame, id_col: str, text: str, path: str, limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP
) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for each row: what the model file at `path` gives for the whole text.

    No begin, end or other special token is added, and nothing is cut. Null and empty texts have no byte and no token. Each row is
    counted by itself, so equal rows and null ids are as any other; no row gives no row. Columns beside the id and the text
    are not read.
    """
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    rows = rows.withColumn("n_bytes", F.octet_length("text").cast("bigint"))

    def count(texts: list[str]) -> dict:
        return {"n_tokens": pa.array(counter(path, chunk, overlap).counts(texts), pa.int64())}

    counted = map_text(rows, "text", count, "n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit).withColumnRenamed("id", id_col)
