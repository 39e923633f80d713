"""Fields that come, go, change name or type from file to file of a producer.

The rows' payloads are read once into a catalogue of what each file holds: path,
type and number of values, the part of a footer for files that have none. Per
producer, field and type, lag over the file numbers cuts the catalogue into
islands, the field's lifespans; their starts and endings are the changes. A start
and an ending at the same file are one renamed field when enough messages, written
again in the later file, carry the same value under both names. Renames and
retypings form an alias table from which one consistent table is cast.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallylog.functions.ids import canonical_id
from tallylog.functions.payloads import clean, fields, fingerprint, kind_of, plain, read_object
from tallylog.operators.joins import join_counted
from tallylog.session import materialized, ship

#: A file has a field when at least 1 / SHARE of its readable rows hold it.
SHARE = 10
#: Messages that must carry the same value under both names.
WITNESSES = 3

_CATALOGUE = pa.schema([("producer", pa.string()), ("file_no", pa.int32()), ("field", pa.string()), ("kind", pa.string()), ("n", pa.int64())])


def _count_fields(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: Counter = Counter()
        for producer, number, payload in zip(*(batch.column(i).to_pylist() for i in range(3))):
            record = read_object(payload)
            counts[producer, number, None, "rows"] += 1
            counts[producer, number, None, "readable"] += record is not None
            if record:
                for key in {(clean(path), kind_of(value)) for path, value in fields(record)}:
                    counts[producer, number, *key] += 1
        keys = list(zip(*counts)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(k, t) for k, t in zip([*keys, list(counts.values())], _CATALOGUE.types)], schema=_CATALOGUE)


def catalogue(files: DataFrame) -> DataFrame:
    """(producer, file_no, field, kind, n): how many readable rows of a file hold a field with a value of a kind.

    Rows with a null field give the file's 'rows' and 'readable' rows, 0 included.
    Counts are combined in each Arrow batch and before the shuffle. Rows without producer or
    file_no belong to no file and are left out.
    """
    ship(files.sparkSession)
    rows = files.where(F.col("producer").isNotNull() & F.col("file_no").isNotNull()).select("producer", F.col("file_no").cast("int"), "payload")
    found = rows.mapInArrow(_count_fields, "producer string, file_no int, field string, kind string, n long")
    return found.groupBy("producer", "file_no", "field", "kind").agg(F.sum("n").alias("n"))


def file_order(seen: DataFrame) -> DataFrame:
    """(producer, file_no, rows, readable, seq, files): files numbered from 1 within their producer."""
    per = Window.partitionBy("producer")
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("n"))).alias(kind)
    return (
        seen.where(F.col("field").isNull())
        .groupBy("producer", "file_no")
        .agg(of("rows"), of("readable"))
        .withColumn("seq", F.row_number().over(per.orderBy("file_no")))
        .withColumn("files", F.count("*").over(per))
    )


def lifespans(seen: DataFrame, order: DataFrame, share: int = SHARE) -> DataFrame:
    """(producer, field, kind, first_seq, last_seq, files): the runs of files that have a field with one type.

    A field's type in a file is that of most of its values; of equally frequent
    types the alphabetically last.
    """
    has = (
        seen.where(F.col("field").isNotNull())
        .groupBy("producer", "file_no", "field")
        .agg(F.sum("n").alias("total"), F.max(F.struct("n", "kind"))["kind"].alias("kind"))
        .join(order, ["producer", "file_no"])
        .where(F.col("total") * share >= F.col("readable"))
    )
    along = Window.partitionBy("producer", "field", "kind").orderBy("seq")
    return (
        has.withColumn("opens", (F.coalesce(F.lag("seq").over(along), F.lit(-1)) != F.col("seq") - 1).cast("int"))
        .withColumn("island", F.sum("opens").over(along))
        .groupBy("producer", "field", "kind", "island", "files")
        .agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))
        .drop("island")
    )


def boundaries(spans: DataFrame) -> DataFrame:
    """(producer, seq, field, was, now): fields whose presence or type differs between file seq - 1 and file seq."""
    starts = spans.where(F.col("first_seq") > 1).select("producer", F.col("first_seq").alias("seq"), "field", F.lit(None).cast("string").alias("was"), F.col("kind").alias("now"))
    ends = spans.where(F.col("last_seq") < F.col("files")).select("producer", (F.col("last_seq") + 1).alias("seq"), "field", F.col("kind").alias("was"), F.lit(None).cast("string").alias("now"))
    return starts.unionByName(ends).groupBy("producer", "seq", "field").agg(F.max("was").alias("was"), F.max("now").alias("now"))


_VALUES = pa.schema([("producer", pa.string()), ("seq", pa.int32()), ("id", pa.string()), ("side", pa.int8()), ("field", pa.string()), ("kind", pa.string()), ("value", pa.binary())])


def _pick_values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[] for _ in _VALUES]
        for producer, key, payload, wanted in zip(*(batch.column(i).to_pylist() for i in range(4))):
            record = read_object(payload)
            if not record:
                continue
            values = {clean(path): value for path, value in fields(record)}
            for w in wanted:
                if w["field"] in values:
                    for column, x in zip(out, (producer, w["seq"], key, w["side"], w["field"], w["kind"], fingerprint(values[w["field"]]))):
                        column.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, _VALUES.types)], schema=_VALUES)


def renames(files: DataFrame, bounds: DataFrame, order: DataFrame, witnesses: int = WITNESSES) -> DataFrame:
    """(producer, seq, old, new): fields that ended and started at the same file, of one type, that the same messages carry with equal values.

    Only the fields at issue are read from only the files at issue; a file of any
    size is read where its rows lie (see join_counted). A message's values combine to
    two per field before they are shuffled, however many rows it has, so what is
    paired per message is bounded by the width of its schema; evidence is combined
    per pair of fields before its shuffle.
    """
    ship(files.sparkSession)
    gone = bounds.where(F.col("now").isNull()).select("producer", "seq", "field", F.col("was").alias("kind"))
    come = bounds.where(F.col("was").isNull()).select("producer", "seq", "field", F.col("now").alias("kind"))
    match = ["producer", "seq", "kind"]
    sides = (
        gone.join(come.select(*match), match, "left_semi").select("producer", "seq", "field", "kind", F.lit(0).cast("tinyint").alias("side"), (F.col("seq") - 1).alias("at"))
        .unionByName(come.join(gone.select(*match), match, "left_semi").select("producer", "seq", "field", "kind", F.lit(1).cast("tinyint").alias("side"), F.col("seq").alias("at")))
    )
    wanted = materialized(
        sides.join(order.select("producer", "file_no", "rows", F.col("seq").alias("at")), ["producer", "at"])
        .groupBy("producer", "file_no", "rows")
        .agg(F.collect_list(F.struct("seq", "side", "field", "kind")).alias("wanted")),
        "wanted",
    )
    rows = files.select("producer", F.col("file_no").cast("int").alias("file_no"), canonical_id("id").alias("id"), "payload").where(F.col("id").isNotNull())
    values = (
        join_counted(rows, wanted, ["producer", "file_no"], "rows", files.count())
        .select("producer", "id", "payload", "wanted")
        .mapInArrow(_pick_values, "producer string, seq int, id string, side tinyint, field string, kind string, value binary")
    )
    # what a message holds of a field, in any number of rows, as its least and greatest value
    held = values.groupBy("producer", "seq", "id", "side", "field", "kind").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    field = F.struct("field", "kind", "low", "high")
    per_message = held.groupBy("producer", "seq", "id").agg(
        F.collect_list(F.when(F.col("side") == 0, field)).alias("olds"), F.collect_list(F.when(F.col("side") == 1, field)).alias("news")
    )
    pairs = (
        per_message.select("producer", "seq", F.explode("olds").alias("o"), "news")
        .select("producer", "seq", "o", F.explode("news").alias("n"))
        .where(F.col("o.kind") == F.col("n.kind"))
    )
    equal = (F.col("o.low") == F.col("o.high")) & (F.col("n.low") == F.col("n.high")) & (F.col("o.low") == F.col("n.low"))
    return (
        pairs.groupBy("producer", "seq", F.col("o.field").alias("old"), F.col("n.field").alias("new"))
        .agg(F.count("*").alias("both"), F.bool_and(equal).alias("equal"))
        .where((F.col("both") >= witnesses) & F.col("equal"))
        .select("producer", "seq", "old", "new")
    )


def _changes(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    seen = materialized(catalogue(files), "catalogue")
    # small tables that several branches read: written once, so no branch plans or runs their making again
    order = materialized(file_order(seen), "files")
    spans = materialized(lifespans(seen, order), "lifespans")
    bounds = materialized(boundaries(spans), "boundaries")
    renamed = materialized(renames(files, bounds, order), "renames")
    return seen, order, spans, bounds, renamed


def schema_changes(files: DataFrame) -> DataFrame:
    """(producer, file_no, change, field, to_value): each change between a producer's file and the one before it.

    change is 'renamed' (to_value: the new path), 'retyped' (to_value: the new
    type), 'added' or 'removed' (to_value: ''). A file without readable rows has
    no fields. Repeated rows count as rows. An empty table has no changes; the
    first file of a producer has none. Columns besides producer, file_no, id and
    payload are ignored.
    """
    _, order, _, bounds, renamed = _changes(files)
    one_sided = bounds.where(F.col("was").isNull() | F.col("now").isNull())
    paired = renamed.select("producer", "seq", F.explode(F.array("old", "new")).alias("field")).distinct()
    rest = one_sided.join(paired, ["producer", "seq", "field"], "left_anti").select(
        "producer", "seq", F.when(F.col("was").isNull(), "added").otherwise("removed").alias("change"), "field", F.lit("").alias("to_value")
    )
    retyped = bounds.where(F.col("was").isNotNull() & F.col("now").isNotNull()).select("producer", "seq", F.lit("retyped").alias("change"), "field", F.col("now").alias("to_value"))
    moved = renamed.select("producer", "seq", F.lit("renamed").alias("change"), F.col("old").alias("field"), F.col("new").alias("to_value"))
    return (
        rest.unionByName(retyped).unionByName(moved)
        .join(order.select("producer", "seq", "file_no"), ["producer", "seq"])
        .select("producer", "file_no", "change", "field", "to_value")
    )


def alias_table(spans: DataFrame, renamed: DataFrame) -> DataFrame:
    """(producer, field, first_seq, last_seq, column, kind): what each lifespan of a field is called and typed in the end.

    A lifespan that a rename ends goes on as the new name's that starts at the same
    file; any other as the field's own next one in the producer, whether a retyping
    or an absence of any length lies between. The last of such a chain gives name
    and type, so a column has one type. Chains are followed by doubling, so their
    length costs only its logarithm in joins. A field renamed to several goes on as
    the alphabetically first. Where a field comes back by a rename from another,
    both had values before, and these share the column.
    """
    later = F.lead("first_seq").over(Window.partitionBy("producer", "field").orderBy("first_seq")).alias("later")
    node = spans.select("producer", "field", "kind", "first_seq", "last_seq", later)
    step = renamed.groupBy("producer", "seq", "old").agg(F.min("new").alias("new"))
    starts = node.select("producer", F.col("field").alias("next_field"), F.col("kind").alias("next_kind"), F.col("first_seq").alias("next_seq"))
    linked = node.join(step.select("producer", F.col("seq").alias("s"), F.col("old").alias("o"), "new"), (node["producer"] == step["producer"]) & (F.col("o") == F.col("field")) & (F.col("s") == F.col("last_seq") + 1), "left").drop(step["producer"])
    at = F.coalesce("new", "field")
    links = linked.withColumn("to", at).withColumn("to_seq", F.when(F.col("new").isNotNull(), F.col("last_seq") + 1).otherwise(F.col("later")))
    found = links.join(starts.withColumnRenamed("producer", "p"), (F.col("p") == F.col("producer")) & (F.col("next_field") == F.col("to")) & (F.col("next_seq") == F.col("to_seq")), "left").drop("p")
    chain = materialized(found.select("producer", "field", "kind", "first_seq", "last_seq", "next_field", "next_kind", "next_seq"), "aliases")
    while chain.where(F.col("next_seq").isNotNull()).limit(1).count():
        hop = chain.select(F.col("producer").alias("p"), F.col("field").alias("f"), F.col("kind").alias("k"), F.col("first_seq").alias("s"), F.col("next_field").alias("nf"), F.col("next_kind").alias("nk"), F.col("next_seq").alias("ns"))
        hopped = chain.join(hop, (F.col("p") == F.col("producer")) & (F.col("f") == F.col("next_field")) & (F.col("k") == F.col("next_kind")) & (F.col("s") == F.col("next_seq")), "left")
        moved = F.col("ns").isNotNull()
        new = materialized(
            hopped.select(
                "producer", "field", "kind", "first_seq", "last_seq",
                F.when(moved, F.col("nf")).otherwise(F.col("next_field")).alias("next_field"),
                F.when(moved, F.col("nk")).otherwise(F.col("next_kind")).alias("next_kind"),
                F.when(moved, F.col("ns")).otherwise(F.col("next_seq")).alias("next_seq"),
                moved.alias("moved"),
            ),
            "aliases",
        )
        done = not new.where("moved").limit(1).count()
        chain = new.drop("moved")
        if done:
            break
    return chain.select("producer", "field", "first_seq", "last_seq", F.coalesce("next_field", "field").alias("column"), F.coalesce("next_kind", "kind").alias("kind"))


def field_plan(seen: DataFrame, order: DataFrame, names: DataFrame) -> DataFrame:
    """(producer, seq, field, column, kind, note): what each field that a file holds is called and typed in the end.

    A file that holds a field outside its lifespans does so below the required share;
    the field's last lifespan before the file decides then, or else its first one.
    Fields without any lifespan in the producer aren't in the result.
    """
    held = seen.where(F.col("field").isNotNull()).select("producer", "file_no", "field").distinct().join(order.select("producer", "file_no", "seq"), ["producer", "file_no"])
    span = F.struct("first_seq", "last_seq", "column", "kind").alias("span")
    points = names.select("producer", "field", F.col("first_seq").alias("seq"), span)
    own = Window.partitionBy("producer", "field")
    placed = (
        held.select("producer", "field", "seq", F.lit(None).cast(points.schema["span"].dataType).alias("span"))
        .unionByName(points)
        .withColumn("before", F.max("span").over(own.orderBy("seq").rangeBetween(Window.unboundedPreceding, 0)))
        .withColumn("at", F.coalesce("before", F.min("span").over(own)))
        .where(F.col("span").isNull() & F.col("at").isNotNull())
    )
    inside = F.col("seq").between(F.col("at.first_seq"), F.col("at.last_seq"))
    return placed.select("producer", "seq", "field", "at.column", "at.kind", F.when(~inside, "below_share").alias("note"))


_CELLS = pa.schema(
    [("rec_id", pa.int64()), ("producer", pa.string()), ("file_no", pa.int32())]
    + [(c, pa.string()) for c in ("column", "kind", "value", "field", "original", "note")]
)


def _cast(value: object, kind: str) -> str | None:
    """value as text of a kind, or None where it can't be one."""
    text = plain(value)
    if kind == "array":
        return text if isinstance(value, list) else plain([value])
    if isinstance(value, list) and kind != "string":
        return None
    if kind == "boolean":
        return {"true": "true", "false": "false", "yes": "true", "no": "false", "1": "true", "0": "false"}.get(text.strip().lower())
    if kind in ("integer", "decimal"):
        try:
            number = float(text) if not isinstance(value, bool) else float(value)
        except ValueError:
            return None
        if number != number or number in (float("inf"), float("-inf")):
            return None
        if kind == "integer" and not number.is_integer():
            return None
        return plain(number) if abs(number) < 1 << 53 else text.strip()
    return text


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[] for _ in _CELLS]
        plans: dict[tuple, dict] = {}
        for i, (rec, producer, number, payload) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(4)))):
            file = (producer, number)
            if file not in plans:
                # the rows of a file have one plan
                plans[file] = {w["field"]: (w["column"], w["kind"], w["note"]) for w in batch.column(4)[i].as_py()}
            plan, stray = plans[file], "no_file" if None in file else "below_share"
            record = read_object(payload)
            cells = []
            for path, value in fields(record or {}):
                field = clean(path)
                column, kind, note = plan.get(field) or (field, kind_of(value), stray)
                cell, original = _cast(value, kind), None
                if cell is None:
                    original, note = clean(plain(value)), note or "uncast"
                cells.append((column, kind, None if cell is None else clean(cell), field, original, note))
            for cell in cells or [(None, None, None, None, payload, "unreadable" if record is None else "no_values")]:
                for column, x in zip(out, (rec, producer, number, *cell)):
                    column.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, _CELLS.types)], schema=_CELLS)


def whole_table(files: DataFrame) -> DataFrame:
    """(rec_id, producer, file_no, column, kind, value, field, original, note): every file's values under their last names, cast to their last types.

    One row per value other than null, since producers' schemas differ; value is
    text in the column's type, field the path in the file. Nothing is left out:

    - A value that the type can't hold has a null value and its text as
      `original`, and the note 'uncast' if it has no other.
    - A field that a file holds in fewer than the required rows has the note
      'below_share'; one that no file of the producer holds in more has its own name
      and each value's own type.
    - Rows without producer or file_no belong to no file; their values have the
      note 'no_file', their own names and types.
    - A row without any value comes out once, with null column and its payload as
      `original`; its note is 'unreadable' or, for an object without values,
      'no_values'.

    All other rows have a null note. Of a name that stands twice in one JSON object
    the last value counts.
    """
    seen, order, spans, _, renamed = _changes(files)
    planned = field_plan(seen, order, alias_table(spans, renamed))
    wanted = materialized(
        order.select("producer", "seq", "file_no", "rows").join(planned, ["producer", "seq"], "left")
        .groupBy("producer", "file_no", "rows")
        .agg(F.collect_list(F.when(F.col("field").isNotNull(), F.struct("field", "column", "kind", "note"))).alias("wanted")),
        "wanted",
    )
    rows = files.select("rec_id", "producer", F.col("file_no").cast("int").alias("file_no"), "payload")
    none = F.array().cast(wanted.schema["wanted"].dataType).alias("wanted")
    return (
        join_counted(rows, wanted, ["producer", "file_no"], "rows", files.count())
        .select("rec_id", "producer", "file_no", "payload", "wanted")
        .unionByName(rows.where(F.col("producer").isNull() | F.col("file_no").isNull()).select("*", none))
        .mapInArrow(_cells, "rec_id long, producer string, file_no int, column string, kind string, value string, field string, original string, note string")
    )


def consistent_table(files: DataFrame) -> DataFrame:
    """(rec_id, producer, file_no, column, kind, value): the rows of whole_table without where they come from."""
    return whole_table(files).select("rec_id", "producer", "file_no", "column", "kind", "value")
