"""Words of whole texts as numpy arrays, for the operators that work on word sequences.

A batch of texts is one byte array with document offsets (Arrow's own layout). Words are
maximal runs of "word" bytes; a run never crosses a document border. Every word gets a 64-bit
hash (a random value for each byte at each place, added up; blake2b for long words), every
sequence of words a rolling one; all steps are vectorised over the batch.
Texts are cut into batches of bounded bytes (a text longer than that is a batch of its
own), so memory follows the longest single text and not the number of rows. A null text
has no words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

BATCH_BYTES = 1 << 18

U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser: every input bit reaches every output bit."""
    x = x.copy()
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _ascii_ranges(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.ones(256, dtype=bool)
    for lo, hi in ranges:
        table[lo:hi + 1] = False
    return table


#: Word bytes of `[^\x20\x09-\x0D]+`.
SPACED = _ascii_ranges((0x20, 0x20), (0x09, 0x0D))
#: Word bytes of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after A-Z became a-z.
ALNUM = _ascii_ranges((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))


#: Words up to so many bytes are hashed by table, longer ones by blake2b.
TABLE_BYTES = 64


@lru_cache(maxsize=8)
def _byte_values(kind: str, lower: bool) -> np.ndarray:
    """A random 64-bit value for each place in a word and word byte, 0 for other bytes."""
    values = mix(np.arange(1, TABLE_BYTES * 256 + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)).reshape(TABLE_BYTES, 256)
    if lower:
        values[:, ord("A"):ord("Z") + 1] = values[:, ord("a"):ord("z") + 1]
    values[:, ~_table(kind)] = 0
    return values.ravel()


def _table(kind: str) -> np.ndarray:
    return {"spaced": SPACED, "alnum": ALNUM}[kind]


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64, kept for the next call."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 12 if have is None else 2 * len(have))
        steps = np.full(size, base, dtype=U64)
        steps[0] = 1
        have = _POWERS[base] = np.multiply.accumulate(steps)
    return have[:n]


LENGTH_BASE = 0x9E3779B97F4A7C15
WORD_BASE = 0xD1342543DE82EF95
WORD_BASE_INVERSE = pow(WORD_BASE, -1, 1 << 64)

#: Two primes and bases for sequences of any length: polynomials modulo 2 ** 64 have regular
#: collisions there (Thue-Morse sequences), those modulo a prime have none of that kind.
MODULI = ((2147483647, 1277803351), (2147483629, 1622650073))
_MODULAR: dict[tuple[int, int], np.ndarray] = {}


def modular_powers(base: int, prime: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo the prime, kept for the next call."""
    have = _MODULAR.get((base, prime))
    if have is None:
        have = np.ones(1, dtype=np.int64)
    while len(have) < n:
        have = np.concatenate((have, have * pow(base, len(have), prime) % prime))
    _MODULAR[base, prime] = have
    return have[:n]


def _span_hashes(hashes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the sequences hashes[start:end], equal sequences at any place alike."""
    found = (end - start).astype(U64) * U64(LENGTH_BASE)
    for prime, base in MODULI:
        total = np.zeros(len(hashes) + 1, dtype=np.int64)
        values = (hashes % U64(prime)).view(np.int64)
        np.cumsum(values * modular_powers(base, prime, len(hashes)) % prime, out=total[1:])
        inverse = modular_powers(pow(base, -1, prime), prime, len(hashes) + 1)
        part = (total[end] - total[start]) % prime * inverse[start] % prime
        found = mix(found) + part.view(U64)
    return mix(found)


class Words:
    """The words of some documents: byte spans and hashes, document by document."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kind: str, lower: bool):
        self.data, self.n_docs, self.doc_offsets = data, len(offsets) - 1, offsets
        n = len(data)
        inside = _table(kind)[data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        borders = offsets[:-1][offsets[:-1] < n]
        first[borders] = inside[borders]
        before = borders[borders > 0] - 1
        last[before] = inside[before]
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        #: words bounds[d]:bounds[d + 1] are those of document d
        self.bounds = np.searchsorted(self.starts, offsets)
        if len(self.starts):
            lengths = np.diff(np.append(self.starts, n))
            at = np.arange(self.starts[0], n) - np.repeat(self.starts, lengths)
            np.minimum(at, TABLE_BYTES - 1, out=at)
            at <<= 8
            at |= data[self.starts[0]:]
            value = _byte_values(kind, lower).take(at)
            size = self.ends - self.starts
            self.hashes = mix(np.add.reduceat(value, self.starts - self.starts[0]) + size.astype(U64))
            for w in np.flatnonzero(size > TABLE_BYTES).tolist():
                word = self.text(w)
                digest = hashlib.blake2b(word.lower() if lower else word, digest_size=8).digest()
                self.hashes[w] = int.from_bytes(digest, "little")
        else:
            self.hashes = np.empty(0, dtype=U64)

    def __len__(self) -> int:
        return len(self.starts)

    def docs_of_words(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_docs), np.diff(self.bounds))

    def sequences(self, k: int) -> np.ndarray:
        """Rabin-Karp hash of the k words that start at each word (also across document
        borders: see ``complete``); one entry per start that has k words after it."""
        m = len(self) - k + 1
        if m <= 0:
            return np.empty(0, dtype=U64)
        if k <= 8:
            out = self.hashes[:m].copy()
            for j in range(1, k):
                out += self.hashes[j:m + j] * powers(WORD_BASE, k)[j]
            return mix(out)
        total = np.zeros(len(self) + 1, dtype=U64)
        np.cumsum(self.hashes * powers(WORD_BASE, len(self)), out=total[1:])
        return mix((total[k:] - total[:-k]) * powers(WORD_BASE_INVERSE, m))

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the word sequences [start, end), which may be of any length."""
        return _span_hashes(self.hashes, start, end)

    def complete(self, k: int) -> np.ndarray:
        """Whether the k words from each word on lie in one document."""
        m = max(len(self) - k + 1, 0)
        ends = np.repeat(self.bounds[1:], np.diff(self.bounds))[:m]
        return np.arange(k, k + m) <= ends

    def whole(self, d: int) -> int:
        """Hash of all words of document d as one sequence."""
        own = self.hashes[self.bounds[d]:self.bounds[d + 1]]
        return int(_span_hashes(own, np.array([0]), np.array([len(own)]))[0])

    def text(self, w: int) -> bytes:
        return self.data[self.starts[w]:self.ends[w]].tobytes()


def layout(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and document offsets of an Arrow string column; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1] \
        if offsets is not None and len(texts) else np.zeros(len(texts) + 1, dtype=np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of documents of at most ``limit`` bytes (or one longer document)."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


def batches(texts: pa.Array, kind: str = "spaced", lower: bool = False,
            limit: int = BATCH_BYTES) -> Iterator[tuple[int, int, Words]]:
    """(first row, end row, words) over the rows of an Arrow string column."""
    data, offsets = layout(texts)
    for a, b in slices(offsets, limit):
        yield a, b, Words(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], kind, lower)
