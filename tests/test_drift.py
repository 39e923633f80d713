"""Schemas that drift between files (problem 4)."""

import base64
import json
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tallylog.functions.payloads import fingerprint, kind_of, read_object
from tallylog.operators.drift import catalogue, consistent_table, schema_changes, whole_table
from tests.conftest import rows

SHAPE = "rec_id long, producer string, file_no int, id string, payload string"


class Fraction(float):
    pass


def load(payload):
    for turn in (lambda x: x, lambda x: base64.b64decode(x, validate=True).decode()):
        try:
            found = json.loads(turn(payload), parse_float=Fraction)
            if isinstance(found, dict):
                return found
        except Exception:
            pass
    return None


def walk(node, at=""):
    for name, value in node.items():
        if isinstance(value, dict):
            yield from walk(value, f"{at}{name}.")
        elif value is not None:
            yield at + name, value


def brute(data):
    files = defaultdict(list)
    for _, producer, number, key, payload in data:
        if producer is not None and number is not None:
            record = load(payload) if payload else None
            files[producer, number].append(((key or "").strip(" ").lower(), dict(walk(record)) if record is not None else None))
    has = {}
    for at, content in files.items():
        n, kinds = sum(r is not None for _, r in content), defaultdict(Counter)
        for _, r in content:
            for field, value in (r or {}).items():
                kind = "boolean" if isinstance(value, bool) else "string" if isinstance(value, str) else "array" if isinstance(value, list) else "decimal" if isinstance(value, Fraction) else "integer"
                kinds[field][kind] += 1
        has[at] = {f: max(c.items(), key=lambda x: (x[1], x[0]))[0] for f, c in kinds.items() if sum(c.values()) * 10 >= n}
    out = set()
    for producer in {p for p, _ in files}:
        numbers = sorted(n for p, n in files if p == producer)
        for a, b in zip(numbers, numbers[1:]):
            old, new = has[producer, a], has[producer, b]
            gone, come, paired = [f for f in old if f not in new], [f for f in new if f not in old], set()
            for o in gone:
                for n in come:
                    both = [
                        (i, x[o], y[n])
                        for i, x in files[producer, a] if i and x and o in x
                        for j, y in files[producer, b] if i == j and y and n in y
                    ]
                    if old[o] == new[n] and len({i for i, _, _ in both}) >= 3 and all(x == y and isinstance(x, bool) == isinstance(y, bool) for _, x, y in both):
                        out.add((producer, b, "renamed", o, n))
                        paired |= {("o", o), ("n", n)}
            out |= {(producer, b, "removed", o, "") for o in gone if ("o", o) not in paired} | {(producer, b, "added", n, "") for n in come if ("n", n) not in paired}
            out |= {(producer, b, "retyped", f, new[f]) for f in old if f in new and old[f] != new[f]}
    return sorted(out, key=repr)


def make(seed):
    rng = random.Random(seed)
    data, rec = [], 0
    for producer in ("p1", "p2"):
        names, carried = ["a", "b", "c", "d"], {}
        for number in (2, 3, 7, 8, 11):
            if rng.random() < 0.7:
                names[rng.randrange(4)] = rng.choice(["A", "x.y", "x.z", "e", "é"]) + str(number)
            if rng.random() < 0.4:
                names = names[:-1] + rng.choice([[], ["n1"]])
            kinds = {n: rng.choice(["i", "s", "d", "b", "l"]) for n in names}
            fresh = {}
            for k in range(rng.randrange(8, 20)):
                key, values = rng.choice(list(carried.items())) if carried and rng.random() < 0.5 else (f"ID{producer}{number}{k}", [rng.randrange(9) for _ in range(6)])
                fresh[key] = values
                record: dict = {}
                for n, v in zip(names, values):
                    value = {"i": v, "s": f"v{v}", "d": v + 0.5, "b": v % 2 == 0, "l": [v]}[kinds[n]]
                    at, *rest = n.split(".")
                    if rest:
                        record.setdefault(at, {})[rest[0]] = value
                    else:
                        record[at] = rng.choice([value] * 9 + [None])
                text = json.dumps(record, ensure_ascii=False)
                text = rng.choice([text] * 8 + [base64.b64encode(text.encode()).decode(), text[:-2], None, "", "null", "[1]"])
                data.append((rec, producer, number, rng.choice([key, key.lower(), f" {key}", None]), text))
                rec += 1
                if rng.random() < 0.1:
                    data.append(data[-1])
            carried = fresh
    rng.shuffle(data)
    return [*data, (rec, None, 1, "x", "{}"), (rec + 1, "p1", None, "x", "{}")]


@pytest.mark.parametrize("seed", range(5))
def test_like_brute_force(spark, seed):
    data = make(seed)
    assert rows(schema_changes(spark.createDataFrame(data, SHAPE).repartition(3))) == brute(data)


def test_files_without_readable_rows_and_wide_gaps(spark):
    data = [(i, "p", n, f"m{i}", t) for n, t in ((1, '{"a": 1}'), (5, "broken"), (9, '{"a": 1.5}')) for i in range(3)]
    assert rows(schema_changes(spark.createDataFrame(data, SHAPE))) == [("p", 5, "removed", "a", ""), ("p", 9, "added", "a", "")]


def test_empty_and_clashing_names(spark):
    empty = spark.createDataFrame([], SHAPE)
    assert rows(schema_changes(empty)) == [] and rows(consistent_table(empty)) == [] and rows(catalogue(empty)) == []
    data = [(i, "p", n, f"m{i}", json.dumps({"old" if n == 1 else "new": i})) for n in (1, 2) for i in range(3)]
    df = spark.createDataFrame(data, SHAPE).select("*", *[F.lit("x").alias(c) for c in ("field", "kind", "seq", "n", "wanted", "side", "value", "readable")])
    assert rows(schema_changes(df)) == [("p", 2, "renamed", "old", "new")]


def test_consistent_table_has_last_names_and_types(spark):
    data = [(10 * n + i, "p", n, f"m{i}", json.dumps(r)) for n in (1, 2, 3) for i in range(3) for r in [{"a": str(i)} if n == 1 else {"b": str(i)} if n == 2 else {"b": i}]]
    got = rows(consistent_table(spark.createDataFrame(data, SHAPE)))
    assert got == sorted(((10 * n + i, "p", n, "b", "integer", str(i)) for n in (1, 2, 3) for i in range(3)), key=repr)


@pytest.mark.parametrize("seed", range(2))
def test_table_holds_every_value(spark, seed):
    data = make(seed)
    got = whole_table(spark.createDataFrame(data, SHAPE).repartition(3)).collect()
    want = Counter()
    for rec, _, _, _, payload in data:
        want.update([(rec, field) for field, _ in walk(load(payload or "") or {})] or [(rec, None)])
    assert Counter((r["rec_id"], r["field"]) for r in got) == want
    assert all(r["value"] is not None or r["original"] is not None for r in got if r["field"])


def test_table_keeps_strays_uncastable_values_and_bare_rows(spark):
    data = [(i, "p", 1, f"m{i}", json.dumps({"a": "x" if i == 3 else i, "o": {}} | ({"trace": [1]} if i == 5 else {}))) for i in range(20)]
    data += [(20 + i, "p", 2, f"m{i}", t) for i, t in enumerate(("broken", None, "{}"))] + [(30, None, 1, "m", '{"a": "y"}'), (31, "q", 1, "m", '{"a": {"b": 1}, "a.b": 2}')]
    got = [tuple(r)[:1] + tuple(r)[3:] for r in whole_table(spark.createDataFrame(data, SHAPE)).collect()]
    want = [(i, "a", "integer", str(i), "a", None, None) for i in range(20) if i != 3]
    want += [(3, "a", "integer", None, "a", "x", "uncast"), (5, "trace", "array", "[1]", "trace", None, "below_share")]
    want += [(20, None, None, None, None, "broken", "unreadable"), (21, None, None, None, None, None, "unreadable"), (22, None, None, None, None, "{}", "no_values")]
    want += [(30, "a", "string", "y", "a", None, "no_file"), *((31, "a.b", "integer", v, "a.b", None, None) for v in "12")]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_table_goes_on_after_a_gap(spark):
    """'a' is absent from files 2 and 3 but for one stray value, comes back as text and becomes 'b', which is away from file 6."""
    shapes = {1: "a", 2: "o", 3: "o", 4: "a", 5: "b", 6: "o", 7: "b"}
    data = [(100 * n + i, "p", n, f"m{i}", json.dumps({f: {"a": i if n == 1 else str(i), "b": str(i) if n == 5 else i + 0.5, "o": 1000 + i}[f]})) for n, f in shapes.items() for i in range(20)]
    data += [(299, "p", 2, "s", '{"a": "x", "o": 1}')]
    got = [(r["file_no"], r["field"], r["column"], r["kind"], r["value"], r["note"]) for r in whole_table(spark.createDataFrame(data, SHAPE)).collect() if r["field"] != "o"]
    want = [(n, f, "b", "decimal", str(i + 0.5) if n == 7 else str(i), None) for n, f in shapes.items() if f != "o" for i in range(20)]
    assert sorted(got, key=repr) == sorted([*want, (2, "a", "b", "decimal", None, "below_share")], key=repr)


@pytest.mark.parametrize("seed", range(2))
def test_table_has_one_type_per_column(spark, seed):
    kinds = defaultdict(set)
    for r in whole_table(spark.createDataFrame(make(seed), SHAPE)).where("note is null or note = 'uncast'").collect():
        kinds[r["producer"], r["column"]].add(r["kind"])
    assert max(map(len, kinds.values())) == 1


def test_payload_rules():
    assert read_object('{"a": 1') is None and read_object("") is None and read_object(None) is None and read_object("NaN") is None and read_object('{"a": NaN}') is None
    assert read_object(base64.b64encode(b'{"a": 1}').decode()) == {"a": 1}
    assert read_object("[" * 100_000) is None
    kinds = {k: kind_of(v) for k, v in read_object('{"i": 1, "d": 1.0, "e": 1e3, "s": "1", "b": true, "l": [1]}').items()}
    assert kinds == {"i": "integer", "d": "decimal", "e": "integer", "s": "string", "b": "boolean", "l": "array"}
    assert fingerprint(1) == fingerprint(1.0) != fingerprint(True) != fingerprint("1")


def test_one_message_with_most_rows(spark):
    """A field's values combine per message, so thousands of rows under one id cost what they are."""
    data = [(i, "p", 1 + i % 2, "hot", json.dumps({"old" if i % 2 == 0 else "new": i})) for i in range(4000)]
    data += [(5000 + 2 * i + n, "p", 1 + n, f"m{i}", json.dumps({"a" if n == 0 else "b": f"v{i}"})) for i in range(600) for n in (0, 1)]
    assert rows(schema_changes(spark.createDataFrame(data, SHAPE))) == [("p", 2, "added", "new", ""), ("p", 2, "removed", "old", ""), ("p", 2, "renamed", "a", "b")]
