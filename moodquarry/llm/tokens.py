"""Token ids of whole texts, by the installed tokenizer libraries, within tasks."""

import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CACHE = 150_000  # words of each of two generations whose ids a worker keeps, about 60 MB
CHUNK_CACHE = 50_000  # chunks between spaces, in texts with other characters
LONG = 64  # longer ones are not kept
SLICE = 1 << 18  # characters of a text whose words are listed at once

# Letters that only lower-casing changes, single digits, and signs that stay together; white space parts them.
_PLAIN = re.compile(r"[A-Za-z0-9À-ÖØ-öø-ÿ!-&(-/:-@\[-`{-~]+")
_PLAIN_TEXT = re.compile(r"[A-Za-z0-9À-ÖØ-öø-ÿ!-&(-/:-@\[-`{-~ \n]*")
_PARTS = r"([0-9]|[!-&(-/:-@\[-`{-~]+)"  # what else parts letters: every digit, and signs that stay together


class WordTokenizer:
    """A byte-level BPE file of `tokenizers` that lower-cases, drops white space and never joins across it.

    Spaces and line feeds then part a text into chunks with ids of their own, and the ids of a text are those of its chunks in
    order; within plain letters, digits and signs, so are the words. Each word is encoded once while a worker remembers it.
    Chunks with anything else, or with a special token's string, go to the library as they are.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        strings = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, strings)) or "(?!)")
        self.special_begins = {t[0] for t in strings}
        self.words, self.chunks = _Words(self.tokenizer), _Chunks(self)

    def forget(self) -> None:
        self.words.clear()
        self.words.older.clear()
        self.chunks.clear()

    def plain(self, pattern: re.Pattern, text: str) -> bool:
        return bool(pattern.fullmatch(text)) and not (any(c in text for c in self.special_begins) and self.special.search(text))

    def _of_plain(self, texts: list[str]) -> list[bytes]:
        """Ids of plain texts: their words, numbered by Arrow, are looked up once each, and numpy puts the ids in order."""
        parted = pc.replace_substring_regex(pc.utf8_lower(pa.array(texts, pa.large_string())), _PARTS, r" \1 ")
        lists = pc.ascii_split_whitespace(parted)
        words = lists.values.dictionary_encode()
        found = list(map(self.words.__getitem__, words.dictionary.to_numpy(zero_copy_only=False)))
        flat, sizes = np.frombuffer(b"".join(found), "<u4"), np.array([len(x) // 4 for x in found], np.int64)
        code = words.indices.to_numpy()
        size = sizes[code]
        end = np.cumsum(size)
        ids = flat[np.repeat((np.cumsum(sizes) - sizes)[code] - (end - size), size) + np.arange(end[-1] if len(end) else 0)]
        edges = np.concatenate([[0], end])[lists.offsets.to_numpy()].tolist()
        return [ids[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:])]

    def chunk(self, chunk: str) -> bytes:
        if self.plain(_PLAIN, chunk):
            return self._of_plain([chunk])[0]
        return array("I", self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        parts, of = [], []
        for i, text in enumerate(texts):
            some = [text] if len(text) <= SLICE else list(slices(text))
            parts += some
            of += [i] * len(some)
        plain = [k for k, t in enumerate(parts) if self.plain(_PLAIN_TEXT, t)]
        found = dict(zip(plain, self._of_plain([parts[k] for k in plain])))
        out = [[] for _ in texts]
        for k, (i, part) in enumerate(zip(of, parts)):
            out[i].append(found[k] if k in found else b"".join(map(self.chunks.__getitem__, part.replace("\n", " ").split(" "))))
        return [x[0] if len(x) == 1 else b"".join(x) for x in out]


def slices(text: str, size: int = SLICE) -> Iterator[str]:
    """`text` in parts of at least `size` characters but the last, cut before spaces."""
    at = 0
    while at < len(text):
        end = text.find(" ", at + size)
        end = len(text) if end < 0 else end
        yield text[at:end]
        at = end


class _Words(dict):
    """Ids of lower-case words, single digits and signs, each encoded when it is first met, kept up to a bound."""

    def __init__(self, tokenizer):
        self.model = tokenizer.model
        # How the library writes the bytes of a letter; plain ASCII stands for itself.
        self.older: dict[str, bytes] = {}
        letters = [chr(c) for c in range(0xDF, 0x100) if c != 0xF7]
        self.bytes = str.maketrans({c: tokenizer.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in letters})

    def __missing__(self, word: str) -> bytes:
        ids = self.older.pop(word, None) or self._encoded(word)
        if len(word) <= LONG:
            if len(self) >= CACHE:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids

    def _encoded(self, word: str) -> bytes:
        mapped = word if word.isascii() else word.translate(self.bytes)
        return array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()


class _Chunks(dict):
    """Ids of chunks, each encoded when it is first met, kept up to a bound."""

    def __init__(self, tokenizer: WordTokenizer):
        self.tokenizer = tokenizer

    def __missing__(self, chunk: str) -> bytes:
        ids = self.tokenizer.chunk(chunk)
        if len(chunk) <= LONG:
            if len(self) >= CHUNK_CACHE:
                self.clear()
            self[chunk] = ids
        return ids


_TOKENIZERS: dict[str, WordTokenizer] = {}


def word_tokenizer(path: str) -> WordTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS.clear()
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def forget_words() -> None:
    """Let go of the words that this worker's tokenizers remember."""
    for one in _TOKENIZERS.values():
        one.forget()
