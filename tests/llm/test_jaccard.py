"""Jaccard join against brute force over plain Python sets."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracklake.llm import jaccard
from tracklake.session import ship_package

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship_package(spark)


def plain_set(text):
    words = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + 3]) for i in range(max(len(words) - 2, 1)))


def brute(rows, least=90):
    """(doc_id, n_shingles, component_id) of (doc_id, text) rows."""
    sets = [plain_set(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= least * len(a | b):
                up[top(i)] = top(j)
    first = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            first[top(i)] = min(d, first.get(top(i), d))
    return sorted(((d, len(s), first.get(top(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def got(spark, rows, least=90):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(map(tuple, jaccard.components(df, least).collect()), key=str)


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return words


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="aBÉ \t\n\x1c\x85日", max_size=40), max_size=12))
def test_shingle_sets(texts):
    values = [*texts, None, "one", "One  two", "x" * 200]
    sets = list(jaccard.shingle_sets(pa.array(values, pa.string())))
    assert [len(s) for s in sets] == [len(plain_set(t)) for t in values]
    for t, s in zip(values, sets):
        for u, r in zip(values, sets):
            assert (plain_set(t) == plain_set(u)) == np.array_equal(s, r)


def test_pieces_of_very_long_texts(monkeypatch):
    text = " ".join(f"w{i % 5000}" for i in range(20_000)) + " " + "y" * 5000 + " end"
    texts = pa.array(["a b c d", text, None, "a b c d"])
    whole = list(jaccard.shingle_sets(texts))
    monkeypatch.setattr(jaccard, "PIECE", 700)
    cut = list(jaccard.shingle_sets(texts))
    assert all(map(np.array_equal, whole, cut)) and len(whole[1]) == len(plain_set(text))
    one, other = jaccard.shingle_sets(pa.array(["z" * 70_000 + "ab" + "z" * 70_000, "z" * 70_000 + "ba" + "z" * 70_000]))
    assert one[0] != other[0]


@pytest.mark.parametrize("least", [90, 80, 60, 30])
def test_region_links_connect_what_is_linked(least):
    rng = random.Random(least)
    for _ in range(60):
        base = [[f"{k}.{i}" for i in range(rng.choice([4, 30, 60]))] for k in range(3)]
        texts = [" ".join(edited(rng, rng.choice(base), rng.choice([0, 1, 2, 4, 9]))) for _ in range(rng.choice([2, 7, 40]))]
        sets = list({s.tobytes(): s for s in jaccard.shingle_sets(pa.array(texts))}.values())
        links = jaccard.region_links(sets, least)

        def linked(i, j):
            both = len(np.intersect1d(sets[i], sets[j]))
            return 100 * both >= least * (len(sets[i]) + len(sets[j]) - both)
        assert all(linked(i, j) for i, j in links) and len(links) < len(sets)
        label = list(range(len(sets)))
        for i, j in links:
            old = label[i]
            label = [label[j] if x == old else x for x in label]
        assert all(label[i] == label[j] for i in range(len(sets)) for j in range(i) if linked(i, j))


def _corpus(seed, groups, size):
    rng = random.Random(seed)
    rows, line = [], [f"common{i}" for i in range(12)]
    for k in range(groups):
        base = [f"g{k}w{i}" for i in range(rng.choice([8, 60, 120, 240]))] + (line if k % 2 else [])
        for _ in range(rng.randrange(1, size)):
            rows.append((len(rows) * 3 % 1009, " ".join(edited(rng, base, rng.choice([0, 0, 1, 2, 3, 5, 8])))))
    rows += [(2000 + i, " ".join(line + [f"own{i}"])) for i in range(20)] + [(3000 + i, " ".join(line)) for i in range(30)]
    return rows + [(None, rows[0][1]), (None, "null id"), (7, None), (8, ""), (9, " \n"), (9, " \n"), (10, "Two words"), (11, "two WORDS")]


def test_components_equal_brute_force(spark):
    rows = _corpus(1, 12, 25)
    assert got(spark, rows) == brute(rows)


@pytest.mark.parametrize("least", [90, 70])
def test_large_regions_equal_brute_force(spark, monkeypatch, least):
    for name, value in {"REGION": 6, "PIVOTS": 2, "BLOCK": 4}.items():
        monkeypatch.setattr(jaccard, name, value)
    rows = _corpus(2, 5, 70)
    assert got(spark, rows, least) == brute(rows, least)


def test_odd_documents_and_empty_table(spark, odd_docs):
    docs = odd_docs
    for c in ("cls", "node", "same", "n", "pivot", "leads", "text2"):
        docs = docs.withColumn(c, F.lit("clash"))
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, jaccard.components(docs).collect()), key=str) == brute(rows)
    assert jaccard.components(docs.limit(0)).collect() == []
    assert got(spark, [(5, None), (None, None), (6, "")]) == brute([(5, None), (None, None), (6, "")])


def test_only_shared_shingles_are_dealt_to_regions_and_sets_go_there_directly(spark, monkeypatch):
    rng, kept, store = random.Random(5), {}, jaccard.stage
    monkeypatch.setattr(jaccard, "stage", lambda df, name, **k: kept.setdefault(name, store(df, name, **k)))
    monkeypatch.setattr(jaccard, "passing", lambda s: __import__("contextlib").nullcontext())
    rows = []
    for k in range(30):
        words = [f"w{rng.randrange(10 ** 9)}" for _ in range(120)]
        rows += [(3 * k, " ".join(words)), (3 * k + 1, " ".join(edited(rng, words, 2))), (3 * k + 2, " ".join(f"u{rng.randrange(10 ** 9)}" for _ in words))]
    assert got(spark, rows) == brute(rows)
    assert not {"heads", "sets"} & kept.keys()  # neither all rare shingles nor whole sets are stored
    held = [r.shingles for r in kept["shared"].collect()]
    times = __import__("collections").Counter(s for x in held for s in x)
    assert len(held) == 60 and min(times.values()) > 1
