"""Long stretches of text that stand verbatim in more than one record.

A paragraph here is any stretch of `span` characters, at every position, since the
result asks for exact stretches that keep no paragraph borders. Its MinHash is the
least hash of its `gram`-character shingles; with one band of one row, equal
paragraphs always collide, so the recall is 1. Consecutive paragraphs of a text
have their MinHash at the same shingle and are handled as one run, about one per
fifty characters.

Runs that collide are compared exactly: runs of equal content in two documents
are shared as a whole; only the others of a contested MinHash, those at the ends
of shared stretches, are compared paragraph by paragraph. All comparisons are
counts per hash (least and largest document), combined before the shuffle, so a
group of m copies costs m rows and never pairs.

For what to remove together, documents that share a stretch are clustered by
components: each is linked with the least document that has the stretch, which
connects the same documents as all their pairs would. Links also need the paragraphs
of a contested MinHash whose runs are all shared as a whole, as groups of copies
that differ may have one in common.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallylog.operators.joins import join_counted
from tallylog.session import materialized, ship

#: Characters of a stretch, and of a shingle. The shingle's length is tuned and changes only costs: shorter ones
#: collide by chance, longer ones make more runs (100,000 speeches shuffle 292 MB at 64, 121 at 100, 154 at 140).
SPAN, GRAM = 200, 100

_U = np.uint64
#: An odd multiplier and its inverse modulo 2^64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)

_tables: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The multiplier's first n powers and their inverses."""
    if len(_tables.get("power", ())) < n:
        size = max(4096, 1 << n.bit_length())
        for name, x in (("power", _BASE), ("inverse", _INVERSE)):
            steps = np.full(size, x, dtype=_U)
            steps[0] = 1
            _tables[name] = np.multiply.accumulate(steps)
    return _tables["power"][:n], _tables["inverse"][:n]


def _mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit over all others."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Hashes:
    """Hashes of any stretch of several texts laid end to end, from one pass over them."""

    def __init__(self, texts: list[str]):
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(_U)
        self.size = len(points)
        power, self.inverse = _powers(self.size + 1)
        self.sums = np.zeros(self.size + 1, dtype=_U)
        np.cumsum(_mix(points + _U(0x51ED270B)) * power[:-1], dtype=_U, out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.inverse[start])

    def every(self, length: int) -> np.ndarray:
        """Of the stretches of one length, by start."""
        n = self.size - length + 1
        return _mix((self.sums[length:] - self.sums[:n]) * self.inverse[:n])


def least_positions(h: np.ndarray, width: int) -> np.ndarray:
    """For every window of width values the position of the least, the first of equals."""
    at, value, reach = np.arange(len(h), dtype=np.int32), h, 1
    n = len(h) - width + 1
    while reach < width:
        step = min(reach, width - reach)
        later = value[step:] < value[:-step]
        at = np.where(later, at[step:], at[:-step])
        value = np.where(later, value[step:], value[:-step])
        reach += step
    return at[:n]


def runs(texts: list[str], span: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, anchor, run, first, last) of the runs of paragraphs of several texts.

    text is the text's place in the list, anchor the MinHash, run the hash of the
    run's content, first and last the run's first and last start in the text.
    """
    sizes = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
    ends = np.cumsum(sizes)
    if not len(texts) or ends[-1] < span:
        return (np.empty(0, np.int64),) * 5
    hashes = Hashes(texts)
    grams = hashes.every(gram)
    at = least_positions(grams, span - gram + 1)
    owner = np.repeat(np.arange(len(texts)), sizes)[: len(at)]
    inside = np.arange(len(at)) + span <= ends[owner]  # stretches over the border of two texts don't count
    goes_on = inside[1:] & inside[:-1] & (at[1:] == at[:-1])
    first = np.flatnonzero(inside & ~np.concatenate(([False], goes_on)))
    last = np.flatnonzero(inside & ~np.concatenate((goes_on, [False])))
    where, text = at[first], owner[first]
    shape = ((last - first).astype(_U) << _U(32)) + (where - first).astype(_U)
    content = _mix(hashes.of(first, last + span) + _mix(shape))
    begin = (ends - sizes)[text]
    return text, grams[where].view(np.int64), content.view(np.int64), first - begin, last - begin


#: Characters hashed at a time; a longer text is hashed alone.
CHUNK = 300_000


def _chunks(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """(from, to) of neighbours that together have about CHUNK characters."""
    low = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > CHUNK:
            yield low, i
            low, total = i, 0
        total += n
    if low < len(sizes):
        yield low, len(sizes)


def _all_runs(batches: Iterator[pa.RecordBatch], span: int, gram: int) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "anchor", "run", "first", "last"]
    for batch in batches:
        texts = batch.column(1).to_pylist()
        for low, high in _chunks([len(t) for t in texts]):
            text, *found = runs(texts[low:high], span, gram)
            docs = batch.column(0).slice(low, high - low).take(pa.array(text))
            yield pa.RecordBatch.from_arrays([docs, pa.array(found[0]), pa.array(found[1]), *(pa.array(c.astype(np.int32)) for c in found[2:])], names=names)


def _paragraphs(batches: Iterator[pa.RecordBatch], span: int, gram: int) -> Iterator[pa.RecordBatch]:
    names = ["anchor", "run", "paragraph", "low", "high", "place", "times"]
    for batch in batches:
        texts = batch.column(1).to_pylist()
        for low, high in _chunks([len(t) for t in texts]):
            part = batch.slice(low, high - low)
            hashes = Hashes(texts[low:high])
            ends = np.cumsum([len(t) for t in texts[low:high]])
            wanted = part.column(2)
            per = wanted.value_lengths().to_numpy(zero_copy_only=False)
            flat = wanted.flatten()
            get = lambda name: flat.field(name).to_numpy(zero_copy_only=False)  # noqa: B023, E731
            owner = np.repeat(np.arange(high - low), per)
            start = np.concatenate(([0], ends[:-1]))[owner] + get("first")
            count = get("last") - get("first") + 1
            fits = start + count - 1 + span <= ends[owner]  # else another text under the same id
            run = np.repeat(np.flatnonzero(fits), count[fits])
            place = np.arange(len(run)) - np.repeat(np.cumsum(count[fits]) - count[fits], count[fits])
            at = start[run] + place
            doc = part.column(0).to_numpy(zero_copy_only=False)[owner[run]]
            columns = [get("anchor")[run], get("run")[run], hashes.of(at, at + span).view(np.int64), doc, get("high")[run], place.astype(np.int32), get("n")[run]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)


def covered(stretches: DataFrame) -> DataFrame:
    """(doc_id, shared_chars): characters within at least one stretch (doc_id, start, end), each counted once."""
    along = Window.partitionBy("doc_id").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.coalesce(F.max("end").over(along), F.lit(0))
    new = stretches.withColumn("new", F.greatest(F.lit(0), F.col("end") - F.greatest("start", reached)))
    return new.groupBy("doc_id").agg(F.sum("new").cast("long").alias("shared_chars")).where(F.col("shared_chars") > 0)


def _shared(docs: DataFrame, span: int, gram: int, linked: bool = True) -> tuple[DataFrame, DataFrame | None]:
    """Stretches (doc_id, start, end) that other documents have too, and links (a, b), b < a, between documents that share one.

    Without `linked` there are no links, and no work for them alone.
    """
    spark = docs.sparkSession
    ship(spark)
    texts = docs.where(F.col("doc_id").isNotNull() & (F.length("text") >= span)).select(F.col("doc_id").cast("long"), "text")

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tallylog.llm.spans import _all_runs

        yield from _all_runs(batches, span, gram)

    def second_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tallylog.llm.spans import _paragraphs

        yield from _paragraphs(batches, span, gram)

    found = materialized(texts.mapInArrow(first_pass, "doc_id long, anchor long, run long, first int, last int"), "runs")
    # most MinHashes occur in one document only; what follows is about the others
    anchors = found.groupBy("anchor").agg(F.min("doc_id").alias("l"), F.max("doc_id").alias("h"), F.count("*").alias("n")).where(F.col("l") < F.col("h")).select("anchor", "n")
    found = materialized(join_counted(found, anchors, ["anchor"], "n", found.count()), "colliding-runs")
    total = found.count()
    same = materialized(
        found.groupBy("anchor", "run").agg(F.min(F.struct("doc_id", "first", "last")).alias("at"), F.max("doc_id").alias("high"), F.count("*").alias("n")),
        "same-runs",
    )
    shared_runs = same.where(F.col("at.doc_id") < F.col("high")).select("anchor", "run", "n", F.col("at.doc_id").alias("least"))
    places = join_counted(found, shared_runs, ["anchor", "run"], "n", total)
    whole = places.select("doc_id", F.col("first").alias("start"), (F.col("last") + span).alias("end"))
    # anchors of several documents whose runs differ: their runs are compared paragraph by paragraph,
    # each content once; the stretches need the result only for contents that one document has, the links for all
    contested = (
        same.groupBy("anchor")
        .agg(F.min("at.doc_id").alias("low"), F.max("high").alias("top"), F.count("*").alias("kinds"), F.bool_or(F.col("at.doc_id") == F.col("high")).alias("open"))
        .where((F.col("low") < F.col("top")) & (F.col("kinds") > 1) & (F.lit(linked) | F.col("open")))
        .select("anchor", "kinds")
    )
    wanted = (
        join_counted(same, contested, ["anchor"], "kinds", total)
        .groupBy(F.col("at.doc_id").alias("doc_id"))
        .agg(F.collect_list(F.struct("anchor", "run", "high", "n", F.col("at.first").alias("first"), F.col("at.last").alias("last"))).alias("wanted"))
    )
    paragraphs = materialized(
        texts.join(wanted, "doc_id").select("doc_id", "text", "wanted").mapInArrow(
            second_pass, "anchor long, run long, paragraph long, low long, high long, place int, times long"
        ),
        "paragraphs",
    )
    shared_paragraphs = (
        paragraphs.groupBy("anchor", "paragraph")
        .agg(F.min("low").alias("l"), F.max("high").alias("h"), F.count("*").alias("n"))
        .where(F.col("l") < F.col("h"))
        .select("anchor", "paragraph", "n", F.col("l").alias("least"))
    )
    common = join_counted(paragraphs, shared_paragraphs, ["anchor", "paragraph"], "n", paragraphs.count())
    # back to every place of these runs: a document may hold a run several times
    hits = (
        common.where(F.col("low") == F.col("high"))
        .groupBy("anchor", "run")
        .agg(F.collect_set("place").alias("places"), F.max("times").alias("times"))
    )
    # places mostly follow one another and are one stretch then
    low, high = F.array_min("places"), F.array_max("places")
    whole_one = F.array(F.struct(low.alias("a"), high.alias("b")))
    one_by_one = F.transform("places", lambda x: F.struct(x.alias("a"), x.alias("b")))
    stretches = hits.select("anchor", "run", "times", F.when(high - low + 1 == F.size("places"), whole_one).otherwise(one_by_one).alias("stretches"))
    parts = (
        join_counted(found, stretches, ["anchor", "run"], "times", total)
        .select("doc_id", "first", F.inline("stretches"))
        .select("doc_id", (F.col("first") + F.col("a")).alias("start"), (F.col("first") + F.col("b") + span).alias("end"))
    )
    all_stretches = whole.unionByName(parts)
    if not linked:
        return all_stretches, None
    links = places.select(F.col("doc_id").alias("a"), F.col("least").alias("b")).unionByName(common.select(F.col("low").alias("a"), F.col("least").alias("b")))
    return all_stretches, links.where(F.col("b") < F.col("a")).distinct()


def shared_spans(docs: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """(doc_id, shared_chars): per document the characters in stretches of at least `span` that other documents have verbatim.

    Characters are code points of the whole text. Null, empty and shorter texts
    share nothing; neither does a text with itself, nor rows with the same doc_id
    with one another. Rows without a doc_id are left out, other columns ignored.
    Any share of the documents may be copies of one text. doc_id is an integer.
    """
    return covered(_shared(docs, span, gram, linked=False)[0])


def components(links: DataFrame) -> DataFrame:
    """(node, least): every node of undirected links (a, b) with the least node that it is connected with.

    Alternating stars: a node's larger neighbours are linked with the least of its
    neighbours, then its smaller ones; after a logarithm of rounds all are linked with
    their component's least node. A node may have any number of links (see
    join_counted); each round is written. Links with a null end or of a node with
    itself say nothing.
    """
    edges = links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = materialized(edges, "links")

    def star(rows: DataFrame) -> DataFrame:
        """(a, b): the far ends `v` of rows (u, v) with the least of u and its neighbours; u too."""
        rows = materialized(rows, "stars")
        least = rows.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n"))
        far = join_counted(rows, least, ["u"], "n", rows.count()).select(F.col("v").alias("a"), F.col("m").alias("b"))
        return far.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))

    ordered = lambda df: df.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        rows = materialized(both, "stars")
        least = rows.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n"))
        large = join_counted(rows, least, ["u"], "n", rows.count()).where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
        wide = ordered(large)
        new = materialized(ordered(star(wide.select(F.col("a").alias("u"), F.col("b").alias("v")))), "links")
        if new.count() == edges.count() and new.join(edges, ["a", "b"], "left_anti").isEmpty():
            break
        edges = new
    return edges.select(F.col("a").alias("node"), F.col("b").alias("least")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("least")).distinct())


def shared_groups(docs: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """(doc_id, group_id): the documents that share a stretch, directly or through others; group_id is the least doc_id of the group.

    Documents that share nothing aren't in the result. See shared_spans for what is shared.
    """
    return components(_shared(docs, span, gram)[1]).select(F.col("node").alias("doc_id"), F.col("least").alias("group_id"))
