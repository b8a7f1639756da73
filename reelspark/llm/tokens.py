"""Whole texts to token ids with a tokenizer file of the tokenizers library.

The word tokenizer treats white space only as a border, so the ids of a text are those of
its white-space chunks one after the other. Each task keeps the ids of the chunks it has
met (a bounded table) and gives only new ones to the library. A run of Latin letters and a
run of ASCII marks after it are units of the tokenizer's splitter; such runs of letters go
through its model in bulk. All other new chunks go through the whole library pipeline, and
texts that hold the start of a special token are encoded whole. The ids are the same either way
(tests compare them with encoding each text at once).

ASCII letters are lower-cased before the lookup, as the tokenizer does itself.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa

from .words import slices, layout

#: Chunks a task keeps unless told otherwise; beyond, it starts anew. About 300 bytes each.
MAX_CHUNKS = 600_000
ID_BYTES = 4
#: Characters that are encoded at a time; longer texts are cut before white space.
MAX_CHARS = 1 << 18

#: ASCII marks: a run of them at the end of a chunk is a unit of the splitter.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Letters below stand alone (no combining marks) and have one lower-case letter each; the
#: dotted capital I, which has two, is lower-cased to a combining mark beyond the end.
LATIN_END = "\u0250"
#: White space that all of Python, the library and Unicode take for it.
BORDER = re.compile(r"[ \t\n\r]")
#: Bytes that are white space in ASCII.
WHITE = np.isin(np.arange(256), [*range(0x09, 0x0E), 0x20])
#: The byte-level alphabet: printable bytes stand for themselves, the others are numbered
#: from 256 on; the space stays, to separate chunks.
_printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_LETTERS = np.arange(256, dtype="<u2")
_others = [b for b in range(256) if b not in _printable]
BYTE_LETTERS[_others] = 256 + np.arange(len(_others))
BYTE_LETTERS[0x20] = 0x20


def default_path() -> str:
    """The vocabulary file that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    def __init__(self, path: str | None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer, pre_tokenizers

        path = path or default_path()
        self.full = Tokenizer.from_file(path)
        #: ids are below this number
        self.n_ids = max(self.full.get_vocab(with_added_tokens=True).values(), default=0) + 1
        self.lowered = None
        self.bulk = Tokenizer(self.full.model)
        self.bulk.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = self.full.get_vocab(with_added_tokens=False)
        self.last = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.known: dict[bytes, bytes] = {}
        self.max_chunks = MAX_CHUNKS

    def _learn(self, chunks: set[bytes]) -> None:
        """Puts the ids of new chunks into the table."""
        known = self.known
        old = list(chunks)
        words = b" ".join(old).decode().lower().split(" ")
        bases = [w.rstrip(PUNCTUATION) for w in words]
        plain = [base.isalpha() and (base.isascii() or max(base) < LATIN_END) for base in bases]
        keys = " ".join(bases).encode().split(b" ")
        ends = " ".join([w[len(base):] for w, base in zip(words, bases)]).encode().split(b" ")
        others = {c: None for c, p in zip(old, plain) if not p}
        others.update({end: None for end in {e for e, p in zip(ends, plain) if p} if end and end not in known})
        letters = [key for key in dict.fromkeys(k for k, p in zip(keys, plain) if p) if key not in known]
        if letters:
            text = BYTE_LETTERS[np.frombuffer(b" ".join(letters), dtype=np.uint8)].tobytes().decode("utf-16-le")
            ids = np.array(self.bulk.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
            stops = (ID_BYTES * (np.flatnonzero(self.last[ids]) + 1)).tolist()
            if len(stops) != len(letters):
                raise RuntimeError("this tokenizer's words don't end where its chunks end")
            flat, at = ids.tobytes(), 0
            for key, stop in zip(letters, stops):
                known[key] = flat[at:stop]
                at = stop
        if others:
            encoding = self.full.encode([c.decode() for c in others], is_pretokenized=True, add_special_tokens=False)
            ids = np.array(encoding.ids, dtype="<u4").tobytes()
            counts = np.bincount(np.array(encoding.word_ids, dtype=np.int64), minlength=len(others))
            at = 0
            for c, n in zip(others, (ID_BYTES * counts).tolist()):
                known[c] = ids[at:at + n]
                at += n
        for c, key, end, p in zip(old, keys, ends, plain):
            if p and c != key:
                known[c] = known[key] + known[end] if end else known[key]

    def chunk_ids(self, chunks: list[list[bytes]]) -> list[list[bytes]]:
        """The ids (little-endian 32 bits) of every chunk of every text."""
        if len(self.known) > self.max_chunks:
            self.known.clear()
        out = [list(map(self.known.get, words)) for words in chunks]
        gaps = [[i for i, ids in enumerate(found) if ids is None] if None in found else () for found in out]
        new = {words[i] for words, gap in zip(chunks, gaps) for i in gap}
        if new:
            self._learn(new)
            for words, found, gap in zip(chunks, out, gaps):
                for i in gap:
                    found[i] = self.known[words[i]]
        return out

    def spans(self, text: str) -> np.ndarray:
        """The character span of each token of one encoding of the whole text, a row (start, end) each,
        by start.

        Texts of the letters up to ``LATIN_END`` are composed already and lower-cased letter by letter
        here, and their tokens cover all bytes but white space, so the spans follow from the tokens'
        lengths. The others take the library's normalizer and offsets. White space is only a border,
        so long texts are encoded piece by piece, each piece once."""
        if "<|" in text:
            return self._offsets(text)
        found, at = [], 0
        while at < len(text):
            end = at + MAX_CHARS
            if end < len(text):
                border = BORDER.search(text, end)
                end = border.start() if border else len(text)
            piece = text[at:end]
            spans = None
            if piece.isascii() or max(piece) < LATIN_END and "\x85" not in piece and "\xa0" not in piece:
                spans = self._measured(piece)
            found.append((self._offsets(piece) if spans is None else spans) + at)
            at = end
        return np.concatenate(found) if found else np.empty((0, 2), dtype=np.int64)

    def _offsets(self, text: str) -> np.ndarray:
        encoding = self.full.encode(text, add_special_tokens=False)
        flat = np.fromiter(chain.from_iterable(encoding.offsets), dtype=np.int64, count=2 * len(encoding))
        spans = flat.reshape(-1, 2)
        return spans[np.argsort(spans[:, 0], kind="stable")]

    def _measured(self, text: str) -> np.ndarray | None:
        """Spans from the lengths of the tokens; None where these don't cover the text."""
        if self.lowered is None:
            from tokenizers import Tokenizer

            self.lowered = Tokenizer(self.full.model)
            self.lowered.pre_tokenizer = self.full.pre_tokenizer
            self.n_bytes = np.zeros(self.n_ids, dtype=np.int64)
            for token, i in self.full.get_vocab(with_added_tokens=False).items():
                self.n_bytes[i] = len(token.removesuffix("</w>"))
        lowered = text.lower()
        data = np.frombuffer(lowered.encode(), dtype=np.uint8)
        ids = self.lowered.encode_batch_fast([lowered], add_special_tokens=False)[0].ids
        place = np.flatnonzero(~WHITE[data])
        size = self.n_bytes[np.fromiter(ids, dtype=np.int64, count=len(ids))]
        stops = np.cumsum(size)
        if len(lowered) != len(text) or size.sum() != len(place) or not size.all():
            return None
        first, last = place[stops - size], place[stops - 1]
        if len(data) != len(text):
            letter = np.cumsum((data & 0xC0) != 0x80) - 1
            first, last = letter[first], letter[last]
        return np.stack([first, last + 1], axis=1)

    def forget(self) -> None:
        """Frees the table; called at a task's end, since workers outlive their tasks."""
        self.known = {}
        self.max_chunks = MAX_CHUNKS

    def whole(self, text: str) -> bytes:
        return np.array(self.full.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit numbers."""
        chunks = [[] if b"<|" in t else t.lower().split() for t in texts]
        return [self.whole(t.decode()) if b"<|" in t else b"".join(ids)
                for t, ids in zip(texts, self.chunk_ids(chunks))]


@lru_cache(maxsize=2)
def encoder(path: str | None) -> Encoder:
    """One encoder per worker process and vocabulary file."""
    return Encoder(path)


def texts_of(column: pa.Array, limit: int = 1 << 19) -> Iterable[tuple[int, int, list[bytes]]]:
    """(first row, end row, UTF-8 texts) in batches of bounded bytes; nulls are empty."""
    data, offsets = layout(column)
    for a, b in slices(offsets, limit):
        raw = data[offsets[a]:offsets[b]].tobytes()
        at = (offsets[a:b + 1] - offsets[a]).tolist()
        yield a, b, [raw[x:y] for x, y in zip(at, at[1:])]
