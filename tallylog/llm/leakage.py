"""Evaluation passages that stand, wholly or partly, in a training corpus.

A leak is a stretch of `window` consecutive words of a passage that the text has
too, with at most `max_edits` words inserted, deleted or replaced. Each passage is
cut into pieces so short that any such stretch contains error-budget-plus-one
whole pieces; fewer errors than pieces leave one piece untouched. Exact piece hits
are found by one automaton over all pieces, and every stretch around a hit is
verified with Myers' bit-parallel edit distance, over words.

The automaton is sent to the workers, so its passages' bytes are checked first. More
of them are joined: each text's pieces, as hashes, with those of the items, in one
pass whatever the number of items; the pairs that collide are verified alike.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallylog.session import materialized, ship

#: Consecutive words of a passage that make a leak.
WINDOW = 12
#: Bytes of passages that are sent to the workers as one automaton; a checked bound. More are joined.
SENT_BYTES = 32 << 20

#: The longest runs of Unicode letters and digits; marks and underscores aren't among them.
_words = re.compile(r"[^\W_]+").findall


def words(text: str | None) -> list[str]:
    """A text's words in small letters."""
    return [w.lower() for w in _words(text)] if text else []


def piece_words(window: int, max_edits: int) -> int:
    """The longest piece such that any window of a passage contains max_edits + 1 whole pieces."""
    size = (window + 1) // (max_edits + 2)
    if size < 1:
        raise ValueError("too many edits for the window")
    return size


def least_distance(pattern: list[str], text: list[str]) -> int:
    """The least edit distance, in words, between pattern and any stretch of text (Myers' bit vectors)."""
    size = len(pattern)
    full, top = (1 << size) - 1, 1 << (size - 1)
    where: dict[str, int] = {}
    for i, w in enumerate(pattern):
        where[w] = where.get(w, 0) | 1 << i
    plus, minus, score = full, 0, size
    best = score
    for w in text:
        match = where.get(w, 0)
        diagonal = (((match & plus) + plus) ^ plus) | match | minus
        up = minus | ~(diagonal | plus) & full
        down = plus & diagonal
        if up & top:
            score += 1
        if down & top:
            score -= 1
        up = up << 1 & full
        down = down << 1 & full
        plus = down | ~(diagonal | up) & full
        minus = up & diagonal
        if score < best:
            best = score
    return best


class Matcher:
    """Finds the passages of one block of test items in texts."""

    def __init__(self, items: list[tuple[int, str]], window: int, max_edits: int):
        self.window, self.edits = window, max_edits
        self.items = [(item, ws) for item, passage in items if len(ws := words(passage)) >= window]
        self.size = piece_words(window, max_edits)
        pieces: dict[str, list[tuple[int, int]]] = {}
        for k, (_, ws) in enumerate(self.items):
            for at in range(0, len(ws) - self.size + 1, self.size):
                pieces.setdefault(f" {' '.join(ws[at : at + self.size])} ", []).append((k, at))
        self.automaton = ahocorasick.Automaton()
        for text, places in pieces.items():
            self.automaton.add_word(text, (len(text), places))
        if pieces:
            self.automaton.make_automaton()
        self.any = bool(pieces)

    def leaks(self, text: str | None) -> dict[int, int]:
        """The least number of edits by item that leaks into text."""
        if not text or not self.any:
            return {}
        line = f" {' '.join(_words(text)).lower()} "
        hits = list(self.automaton.iter(line))
        if not hits:
            return {}
        ws = line[1:-1].split(" ")
        found: dict[int, int] = {}
        tried: set = set()
        done = at = 0  # words before a place in line, counted once
        for end, (length, places) in sorted(hits, key=lambda h: h[0] - h[1][0]):
            start = end + 1 - length
            at += line.count(" ", done, start)
            done = start
            for k, offset in places:
                item, passage = self.items[k]
                if found.get(item) == 0:
                    continue
                for first in range(max(0, offset + self.size - self.window), min(offset, len(passage) - self.window) + 1):
                    low = at - (offset - first) - self.edits
                    near = ws[max(0, low) : low + self.window + 2 * self.edits]
                    if len(near) < self.window - self.edits or (key := (k, first, *near)) in tried:
                        continue
                    tried.add(key)
                    n = least_distance(passage[first : first + self.window], near)
                    if n <= self.edits and n < found.get(item, n + 1):
                        found[item] = n
        return found


_matchers: dict[tuple, Matcher] = {}


def matcher(items: list[tuple[int, str]], window: int, max_edits: int) -> Matcher:
    key = (hash(tuple(items)), len(items), window, max_edits)
    if key not in _matchers:
        _matchers.clear()
        _matchers[key] = Matcher(items, window, max_edits)
    return _matchers[key]


def _scan(batch: pa.RecordBatch, found_by: Matcher) -> pa.RecordBatch:
    rows = [
        (doc, item, edits)
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
        for item, edits in found_by.leaks(text).items()
    ]
    docs, items, edits = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(docs, batch.schema.types[0]), pa.array(items, pa.int64()), pa.array(edits, pa.int32())], names=["doc_id", "item_id", "edits"])


def _hashes(batches: Iterator[pa.RecordBatch], size: int, step: int, least: int) -> Iterator[pa.RecordBatch]:
    """(id, piece): a hash of every piece of `size` words that begins at a multiple of `step`, once a text; texts below `least` words have none."""
    for batch in batches:
        ids, found = [], []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ws = words(text)
            if len(ws) >= least:
                own = {xxhash.xxh3_64_intdigest(" ".join(ws[at : at + size]).encode("utf-8", "surrogatepass")) for at in range(0, len(ws) - size + 1, step)}
                ids += [key] * len(own)
                found += [h - (1 << 63) for h in own]
        yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.types[0]), pa.array(found, pa.int64())], names=["id", "piece"])


@lru_cache(maxsize=1000)
def _single(item: int, passage: str, window: int, max_edits: int) -> Matcher:
    return Matcher([(item, passage)], window, max_edits)


def _verify(batches: Iterator[pa.RecordBatch], window: int, max_edits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: tuple[list, list, list] = ([], [], [])
        for doc, text, item, passage in zip(*(batch.column(i).to_pylist() for i in range(4))):
            for _, edits in _single(item, passage, window, max_edits).leaks(text).items():
                for column, x in zip(out, (doc, item, edits)):
                    column.append(x)
        kinds = (batch.schema.types[0], pa.int64(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=["doc_id", "item_id", "edits"])


def _by_automaton(texts: DataFrame, kept: DataFrame, window: int, max_edits: int) -> DataFrame:
    sent = texts.sparkSession.sparkContext.broadcast([tuple(r) for r in kept.sort("item_id", "passage").collect()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tallylog.llm.leakage import _scan, matcher

        found_by = matcher(sent.value, window, max_edits)
        for batch in batches:
            yield _scan(batch, found_by)

    return texts.mapInArrow(run, f"doc_id {dict(texts.dtypes)['doc_id']}, item_id long, edits int")


def _by_join(texts: DataFrame, kept: DataFrame, window: int, max_edits: int) -> DataFrame:
    """The same by joins: texts whose pieces are no item's are left where they are, the others meet the passages that they share a piece with."""
    size, kind = piece_words(window, max_edits), dict(texts.dtypes)["doc_id"]

    def of_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tallylog.llm.leakage import _hashes

        yield from _hashes(batches, size, 1, window - max_edits)

    def of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tallylog.llm.leakage import _hashes

        yield from _hashes(batches, size, size, window)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tallylog.llm.leakage import _verify

        yield from _verify(batches, window, max_edits)

    wanted = materialized(kept.select("item_id", "passage").mapInArrow(of_items, "item_id long, piece long").distinct(), "item-pieces")
    pieces = texts.mapInArrow(of_texts, f"doc_id {kind}, piece long")
    # first only the pieces that some item has at all, then their items: a piece of many texts meets a piece of many items in parts
    hits = materialized(pieces.join(wanted.select("piece").distinct(), "piece", "left_semi"), "piece-hits")
    pairs = hits.join(wanted, "piece").select("doc_id", "item_id").distinct()
    rows = texts.join(pairs, "doc_id").join(kept, "item_id").select("doc_id", "text", "item_id", "passage")
    return rows.mapInArrow(check, f"doc_id {kind}, item_id long, edits int")


def find_leaks(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_edits: int = 0, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """(doc_id, item_id, edits): the documents that hold a window of a test item's passage, with the fewest edits found.

    Whole texts are searched in one pass over the corpus. Passages of up to sent_bytes
    are sent to the workers; the corpus stays where it is and isn't shuffled. Of more,
    pieces are joined, and only texts that hold one are shuffled. The result is the
    same. Null, empty and short texts and passages have no leaks; items without an id
    and texts without one are left out. Repeated documents or items give one row.
    Other columns are ignored. No items or no documents: no rows.
    """
    ship(docs.sparkSession)
    kept = items.where(F.col("item_id").isNotNull() & F.col("passage").isNotNull()).select(F.col("item_id").cast("long"), "passage").distinct()
    size = kept.agg(F.sum(F.octet_length("passage").cast("long"))).first()[0] or 0
    texts = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text")
    found = (_by_automaton if size <= sent_bytes else _by_join)(texts, kept, window, max_edits)
    return found.groupBy("doc_id", "item_id").agg(F.min("edits").alias("edits"))
