"""Exact byte-pair encoding in linear time, over a whole corpus.

A piece of text is encoded by walking over it with the longest vocabulary match
at each position, which an Aho-Corasick automaton finds in one pass over the
piece's bytes (as Latin-1 characters). A token is accepted when it is compatible
with the one before, that is, when merging the two tokens' bytes would give just
these two; a sequence whose neighbours are all compatible is the merges' own
result. A token that isn't compatible is tried in shorter forms, and when none
fits, the position is marked as a dead end and the token before is shortened.
Each position is given up at most once, and compatibility is remembered per pair
of tokens, so the work is linear in the text.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallylog.session import ship

#: Where the vocabularies lie; a parameter of everything that reads them.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: Fixed value: the pattern that splits text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Encoded pieces remembered by a worker, and the longest piece remembered.
CACHE_PIECES, CACHE_CHARS = 200_000, 64
#: Longer texts are split piece by piece, not into one list.
LONG_TEXT = 1_000_000


def read_ranks(data: bytes) -> list[bytes]:
    """The tokens' bytes by id, of a file of 'base64 id' lines."""
    pairs = (line.split() for line in data.splitlines() if line)
    ranks = {int(i): base64.b64decode(t) for t, i in pairs}
    return [ranks[i] for i in range(len(ranks))]


class _Pieces(dict):
    """Ids by piece of text; short pieces are remembered, up to CACHE_PIECES of them."""

    def __init__(self, encode: Callable[[bytes], tuple[int, ...]]):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> tuple[int, ...]:
        found = self.encode(piece.encode("utf-8"))
        if len(piece) <= CACHE_CHARS:
            if len(self) >= CACHE_PIECES:
                self.clear()
            self[piece] = found
        return found


class Encoder:
    """Encodes bytes with one vocabulary, whose ids are the order of its merges."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.ids = {t: i for i, t in enumerate(tokens)}
        self.length = [len(t) for t in tokens]
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, t in enumerate(tokens):
            self.automaton.add_word(t.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.shorter = [self._prefix(t) for t in tokens]
        self.pairs: dict[tuple[int, int], bool] = {}
        self.pieces = _Pieces(self.piece)

    def _prefix(self, token: bytes) -> int:
        """The longest token that is a proper prefix, or -1."""
        for n in range(len(token) - 1, 0, -1):
            if (found := self.ids.get(token[:n])) is not None:
                return found
        return -1

    def merged(self, data: bytes) -> list[int]:
        """The merges applied one by one, lowest id first: the definition, for the short spans of two tokens."""
        parts = [bytes([b]) for b in data]
        while len(parts) > 1:
            options = [(self.ids[pair], i) for i in range(len(parts) - 1) if (pair := parts[i] + parts[i + 1]) in self.ids]
            if not options:
                break
            _, i = min(options)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ids[p] for p in parts]

    def compatible(self, left: int, right: int) -> bool:
        """Whether the merges of both tokens' bytes give just these two."""
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) > 4_000_000:
                self.pairs.clear()
            known = self.merged(self.tokens[left] + self.tokens[right]) == [left, right]
            self.pairs[left, right] = known
        return known

    def piece(self, data: bytes) -> tuple[int, ...]:
        """The ids of one piece of split text."""
        whole = self.ids.get(data)
        if whole is not None and self.merged_whole(data, whole):
            return (whole,)
        return tuple(self._walk(data))

    def merged_whole(self, data: bytes, whole: int) -> bool:
        """Whether a piece that spells a token is merged into it (it is, unless the merges can't reach it)."""
        known = self.pairs.get((whole, -1))
        if known is None:
            known = self.pairs[whole, -1] = self.merged(data) == [whole]
        return known

    def _walk(self, data: bytes) -> list[int]:
        size = len(data)
        longest = [-1] * size
        length = self.length
        for end, token in self.automaton.iter(data.decode("latin-1")):
            start = end + 1 - length[token]
            if longest[start] < 0 or length[token] > length[longest[start]]:
                longest[start] = token
        dead = bytearray(size + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < size:
            before = out[-1] if out else -1
            while token >= 0:
                end = at + length[token]
                if not dead[end] and (before < 0 or self.compatible(before, token)):
                    break
                token = self.shorter[token]
            if token >= 0:
                out.append(token)
                at = end
                token = longest[at] if at < size else -1
            else:
                dead[at] = 1
                token = out.pop()  # tried again from its start: its own end is a dead end now
                at -= length[token]
        return out

    def encode(self, text: str) -> list[int]:
        """The ids of a text; nothing in it is special."""
        if len(text) <= LONG_TEXT:
            return list(chain.from_iterable(map(self.pieces.__getitem__, _split.findall(text))))
        return list(chain.from_iterable(self.pieces[m.group()] for m in _split.finditer(text)))


_split = regex.compile(PATTERN)
_encoders: dict[bytes, Encoder] = {}


def encoder(data: bytes) -> Encoder:
    """The encoder of a vocabulary file's contents; each process makes it once."""
    key = hashlib.blake2b(data).digest()
    if key not in _encoders:
        _encoders[key] = Encoder(read_ranks(data))
    return _encoders[key]


def _encode_batch(batch: pa.RecordBatch, enc: Encoder) -> pa.RecordBatch:
    offsets, ids = [0], []
    for text in batch.column(1).to_pylist():
        if text:
            ids.extend(enc.encode(text))
        offsets.append(len(ids))
    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.array(ids, dtype=np.int32)))
    return pa.RecordBatch.from_arrays([batch.column(0), lists], names=[batch.schema.names[0], "ids"])


def encode_corpus(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, ids): each row's whole text as token ids, without special tokens.

    Null and empty texts give an empty list; text that spells a special token is
    plain text. Rows are independent: repeated rows come out repeatedly, a null
    key stays null, other columns are dropped. No shuffle. The vocabulary (under
    1 MB, read once by the driver) is broadcast.
    """
    spark = docs.sparkSession
    ship(spark)
    with open(vocabulary, "rb") as f:
        data = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tallylog.llm.bpe import _encode_batch, encoder

        enc = encoder(data.value)
        for batch in batches:
            # several smaller batches, so long texts' ids aren't all held at once
            for start in range(0, batch.num_rows, 1000):
                yield _encode_batch(batch.slice(start, 1000), enc)

    kind = dict(docs.dtypes)[key]
    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, ids array<int>")
