"""Operators on text corpora (problems 6 to 8)."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import tests.conftest as common
from tallylog.llm import bpe, leakage, spans
from tests.conftest import rows

DOCS, ITEMS = "doc_id long, text string", "item_id long, passage string"


@pytest.fixture(scope="module")
def tokenizer():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(bpe.VOCABULARY.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    return t


@pytest.fixture(scope="module")
def encoder():
    with open(bpe.VOCABULARY, "rb") as f:
        return bpe.encoder(f.read())


HARD = [
    "", " ", "<|endoftext|> x", " " * 3000, "a" * 5000, "\n\n\t x\r\n", "ABAB" * 2000, "the" * 3000, "12345678901234567890" * 50, "'s'S'll don't",
    "\U0001f469‍⚖️ ½ ² ﬁ ﬀ é", "進長、事行議", "�\x00\x7f", "İstanbul ΑΣ",
]


def test_encoding_like_the_library(tokenizer, encoder):
    rng = random.Random(5)
    texts = HARD + ["".join(rng.choice("ehtainos rdl'") for _ in range(3000)) for _ in range(5)] + ["".join(chr(rng.choice([65, 97, 0x301, 0x1F469, 0x200D, 32, 10, 0x4E8B])) for _ in range(500)) for _ in range(5)]
    assert [encoder.encode(t) for t in texts] == [x.ids for x in tokenizer.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_encoding_any_text(tokenizer, encoder, text):
    assert encoder.encode(text) == tokenizer.encode(text, add_special_tokens=False).ids


def test_encode_corpus(spark, tokenizer):
    data = [(i, t) for i, t in enumerate(HARD)] + [(100, None), (100, None), (None, "x")]
    df = spark.createDataFrame(data, DOCS).select("*", F.lit(1).alias("ids"))
    got = {(r["doc_id"], tuple(r["ids"])) for r in bpe.encode_corpus(df).collect()}
    assert got == {(i, tuple(tokenizer.encode(t or "", add_special_tokens=False).ids)) for i, t in data}
    assert bpe.encode_corpus(spark.createDataFrame([], DOCS)).collect() == []


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abc"), min_size=1, max_size=7), st.lists(st.sampled_from("abc"), max_size=9))
def test_bit_parallel_distance(pattern, text):
    want = min(edit_distance(pattern, text[i:j]) for i in range(len(text) + 1) for j in range(i, len(text) + 1))
    assert leakage.least_distance(pattern, text) == want


def brute_leaks(docs, items, window, edits):
    split = lambda t: [w.lower() for w in re.findall(r"[^\W_]+", t or "")]
    out = set()
    for d, text in docs:
        for i, passage in items:
            ws, ps = split(text), split(passage)
            if i is not None and any(
                edit_distance(ps[k : k + window], ws[a:b]) <= edits
                for k in range(len(ps) - window + 1) for a in range(len(ws)) for b in range(a + window - edits, min(len(ws), a + window + edits) + 1)
            ):
                out.add((d, i))
    return sorted(out, key=repr)


@pytest.mark.parametrize("sent", [1 << 20, 0], ids=["sent", "joined"])
@pytest.mark.parametrize("edits", [0, 1, 2])
def test_leaks_like_brute_force(spark, edits, sent):
    rng = random.Random(edits)
    vocabulary = ["Ähre", "word", "x1", "The", "naïve", "it's", "éa", "a_b", "ΑΣ"]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", "-"]) for _ in range(n))
    items = [(i, text(rng.randrange(4, 12))) for i in range(12)] + [(90, None), (91, ""), (None, text(9)), (3, text(8))]
    docs = [(i, text(rng.randrange(0, 12)) + (rng.choice(items)[1] or "")[rng.randrange(0, 20) :].upper() + text(3)) for i in range(25)] + [(50, None), (51, ""), (52, " \n")]
    got = leakage.find_leaks(spark.createDataFrame(docs + docs[:2], DOCS), spark.createDataFrame(items + items[:2], ITEMS), window=6, max_edits=edits, sent_bytes=sent)
    assert rows(got.select("doc_id", "item_id")) == brute_leaks(docs, items, 6, edits)


def test_leaks_empty_clashing_and_long(spark):
    none_docs, none_items = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    item = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven twelve")], ITEMS)
    assert leakage.find_leaks(none_docs, item).count() == 0
    long = "pad " * 200_000 + "ONE two, three four_five six seven eight nine ten eleven twelve"
    docs = spark.createDataFrame([(1, long), (2, "one two three")], DOCS).select("*", *[F.lit(0).alias(c) for c in ("item_id", "edits", "passage")])
    assert leakage.find_leaks(docs, none_items).count() == 0
    assert rows(leakage.find_leaks(docs, item)) == [(1, 1, 0)]


def brute_spans(docs, span):
    texts = {d: t for d, t in docs if d is not None and t}
    where: dict = {}
    for d, t in texts.items():
        for s in range(len(t) - span + 1):
            where.setdefault(t[s : s + span], set()).add(d)
    out = []
    for d, t in texts.items():
        hit = {p for s in range(len(t) - span + 1) if len(where[t[s : s + span]]) > 1 for p in range(s, s + span)}
        if hit:
            out.append((d, len(hit)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", range(4))
def test_shared_spans_like_brute_force(spark, seed):
    rng = random.Random(seed)
    letters = "ab\U0001f469é " if seed % 2 else "a "  # few letters: many chance matches and runs of equal hashes
    block = ["".join(rng.choice(letters) for _ in range(rng.randrange(10, 90))) for _ in range(8)]
    docs = [(i, "".join(rng.choice(block) for _ in range(rng.randrange(0, 6)))) for i in range(40)]
    docs += [(100 + i, "same text " * 6) for i in range(10)] + [(200, None), (201, ""), (202, "z" * 300), (None, "same text " * 6)]
    got = spans.shared_spans(spark.createDataFrame(docs + docs[:3], DOCS).repartition(4), span=20, gram=10)
    assert rows(got) == brute_spans(docs, 20)


def test_shared_spans_production_lengths(spark):
    rng = random.Random(1)
    make = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    core, formula = make(260), make(199)
    docs = [(1, make(500) + core + make(80)), (2, core[5:] + make(300)), (3, core[:200] + make(9)), (4, formula + "x"), (5, "y" + formula), (6, make(100_000) + core[30:240])]
    got = rows(spans.shared_spans(spark.createDataFrame(docs, DOCS).select("*", *[F.lit(0).alias(c) for c in ("anchor", "run", "first", "wanted", "n", "start")])))
    assert got == brute_spans(docs, 200)
    assert spans.shared_spans(spark.createDataFrame([], DOCS)).count() == 0


def test_a_run_that_one_document_holds_twice(spark):
    """Only part of a repeated run is shared: both its places count."""
    rng = random.Random(11)
    make = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    for trial in range(6):
        core, own = make(230), make(120)
        twice = own + core + own[::-1]
        docs = [(1, make(50) + twice + make(400) + twice + make(60)), (2, make(300) + core + make(300)), (3, make(90) + core[10:220] + make(40))]
        got = rows(spans.shared_spans(spark.createDataFrame(docs, DOCS), gram=(100, 60, 130)[trial % 3]))
        assert got == brute_spans(docs, 200)


def test_hashing_in_chunks_changes_nothing(monkeypatch):
    rng = random.Random(12)
    texts = ["".join(rng.choice("ab\U0001f469 ") for _ in range(rng.choice([0, 5, 20, 21, 90, 300]))) for _ in range(60)]
    whole = [x.tolist() for x in spans.runs(texts, 20, 10)]
    alone = [[i, *r] for i, t in enumerate(texts) for r in zip(*(x.tolist() for x in spans.runs([t], 20, 10)[1:]))]
    assert [list(r) for r in zip(*whole)] == alone
    monkeypatch.setattr(spans, "CHUNK", 100)
    assert [b for a, b in spans._chunks([len(t) for t in texts])][-1] == 60


def test_rest_of_the_library_does_without():
    root = common.Path(__file__).resolve().parents[2] / "tallylog"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "tallylog.llm" not in p.read_text()


def test_vocabularies_of_equal_length_and_ends_are_told_apart():
    import base64

    line = lambda i, token: f"{base64.b64encode(token).decode()} {i}"
    single = [line(b, bytes([b])) for b in range(256)]
    last = [line(257 + i, bytes([122, 65 + i])) for i in range(20)]
    first, second = ("\n".join([*single, line(256, t), *last]).encode() for t in (b"ab", b"cd"))
    assert len(first) == len(second) and first[:64] == second[:64] and first[-64:] == second[-64:]
    assert bpe.encoder(first).encode("ab") == [256] and bpe.encoder(second).encode("cd") == [256] and bpe.encoder(second).encode("ab") == [97, 98]


def test_planted_edits_are_all_found(spark):
    """One word of a passage's window replaced, left out or put in: each such document is found (recall 1)."""
    rng = random.Random(4)
    items = [(r["item_id"], r["passage"]) for r in spark.read.parquet(str(common.DATA / "sf0.001" / "eval_items.parquet")).collect()]
    docs, want = [], set()
    for i, (item, passage) in enumerate(items):
        ws = leakage.words(passage)
        if len(ws) >= 12:
            at = rng.randrange(len(ws) - 11)
            part, k = ws[at : at + 12], rng.randrange(12)
            part[k : k + rng.choice([0, 1])] = rng.choice([[], ["unseenword"]])
            docs.append((i, " ".join(["before", *part, "after"])))
            want.add((i, item))
    found = {(r["doc_id"], r["item_id"]) for r in leakage.find_leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), max_edits=1).collect()}
    assert len(want) > 100 and want <= found


def test_components_like_brute_force(spark):
    rng = random.Random(11)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(70)] + [(5000, 2000 + i) for i in range(200)] + [(7, 7), (None, 3)]
    least = {}
    for a, b in links:
        if a is not None and a != b:
            least.setdefault(a, a), least.setdefault(b, b)
    for _ in range(400):
        for a, b in links:
            if a in least and a != b:
                least[a] = least[b] = min(least[a], least[b])
    assert rows(spans.components(spark.createDataFrame(links, "a long, b long"))) == sorted(least.items(), key=repr)
    assert rows(spans.components(spark.createDataFrame([], "a long, b long"))) == []


def test_groups_of_documents_that_share(spark):
    rng = random.Random(3)
    part = ["".join(rng.choice("abcdef ") for _ in range(250)) for _ in range(3)]
    data = [(9, part[0] + "x" * 50), (4, part[1] + part[0]), (2, "y" + part[1][:220]), (7, part[2]), (8, None), (5, part[2][:150])]
    assert rows(spans.shared_groups(spark.createDataFrame(data, DOCS))) == [(2, 2), (4, 2), (9, 2)]


def test_groups_of_copies_that_share_only_a_part(spark):
    """Every stretch's run has several documents as a whole; what links the groups is a part of two runs that differ."""
    rng = random.Random(5)
    make = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    core, other = make(203), make(199)
    texts = [(make(120) + core + make(150)), (make(90) + core + make(130)), core, (make(100) + other + make(100)), (make(100) + other + make(100))]
    data = [(10 * i + k, t) for i, t in enumerate(texts) for k in (1, 2)]
    df = spark.createDataFrame(data, DOCS)
    assert rows(spans.shared_groups(df)) == sorted([(d, 1 if d < 30 else d // 10 * 10 + 1) for d, _ in data], key=repr)
    assert rows(spans.shared_spans(df)) == brute_spans(data, 200)


def test_groups_like_brute_force(spark):
    rng = random.Random(0)
    make = lambda n: "".join(rng.choice("abcdefg ") for _ in range(n))
    core = [make(rng.randrange(20, 32)) for _ in range(12)]
    texts = [make(rng.randrange(30)) + "".join(rng.choice(core)[rng.randrange(3) :] + make(rng.randrange(20)) for _ in range(rng.randrange(3))) for _ in range(40)]
    data = [(3 * i + k, t) for i, t in enumerate(texts) for k in range(rng.choice([1, 2, 3]))]
    where: dict = {}
    for d, t in data:
        for s in range(len(t) - 19):
            where.setdefault(t[s : s + 20], set()).add(d)
    least = {d: d for ds in where.values() if len(ds) > 1 for d in ds}
    for _ in range(len(least)):
        for ds in where.values():
            if len(ds) > 1:
                low = min(least[d] for d in ds)
                least.update(dict.fromkeys(ds, low))
    assert rows(spans.shared_groups(spark.createDataFrame(data, DOCS), span=20, gram=10)) == sorted(least.items(), key=repr)
