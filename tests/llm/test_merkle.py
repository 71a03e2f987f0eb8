"""Merkle manifest against a tree built row by row."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tracklake.llm import merkle
from tracklake.session import ship_package

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship_package(spark)


def _h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _leaf(*values):
    return _h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def _tree(digests):
    """Root of the digests and, of each, its (left, right) siblings upwards."""
    paths, held, nodes = [[] for _ in digests], [[i] for i in range(len(digests))], list(digests)
    while len(nodes) > 1:
        above, held_above = [], []
        for k in range(0, len(nodes), 16):
            run = nodes[k:k + 16]
            for j in range(len(run)):
                for i in held[k + j]:
                    paths[i].append(("".join(run[:j]), "".join(run[j + 1:])))
            above.append(_h("".join(run)))
            held_above.append(sum(held[k:k + 16], []))
        nodes, held = above, held_above
    return nodes[0], paths


def _lower(text):
    return text and "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def brute(rows):
    groups = defaultdict(list)
    for d, text, lang, source, n in rows:
        hit = d is not None and zlib.crc32(str(d).encode()) % 5 == 0
        groups[source].append((d is not None, d or 0, _leaf(d, source, lang, n, text),
                               _leaf(d, source, lang, n, _lower(text) if hit else text), d))
    if not rows:
        return
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in names:
        groups[s].sort(key=lambda x: x[:3])
        trees.append(_tree([x[2] for x in groups[s]]))
    root, tops = _tree([t[0] for t in trees])
    for s, (subroot, paths), top in zip(names, trees, tops):
        for x, path in zip(groups[s], paths):
            acc = x[3]
            for left, right in path + top:
                acc = _h(left + acc + right)
            yield x[4], x[2], subroot, root, _h("".join(a + b for a, b in path + top)), acc, acc == root


def _same(df, rows):
    key = lambda r: tuple(map(str, r))
    return sorted(map(key, map(tuple, df.collect()))) == sorted(map(key, brute(rows)))


def test_proofs_equal_brute_force(spark):
    rows = [(i if i % 7 else None, f"t{i}Az" if i % 3 else "low É", None if i % 5 == 0 else "en",
             None if i % 4 == 0 else f"s{i % 2}", i) for i in range(600)]
    rows += [(5, "dup", "en", "z", 1)] * 40 + [(1, None, None, "lone", None), (9, "", "", "", 0)]
    assert _same(merkle.document_proofs(spark.createDataFrame(rows, COLUMNS)), rows)


@pytest.mark.parametrize("n", [0, 1, 2, 16, 17, 256, 257])
def test_sizes_around_full_levels(spark, n):
    rows = [(i, f"Text {i}", "en", "one", i) for i in range(n)]
    assert _same(merkle.document_proofs(spark.createDataFrame(rows, COLUMNS)), rows)


def test_odd_documents(odd_docs):
    docs = odd_docs.withColumn("n_chars", F.length("text").cast("long"))
    for c in ("digest", "at", "grp", "path", "place", "salt"):
        docs = docs.withColumn(c, F.lit("clash"))
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    assert _same(merkle.document_proofs(docs), rows)


def test_some_requests_and_the_store(spark):
    rows = spark.range(1000).select((F.col("id") % 3).cast("string").alias("grp_name"), F.col("id").alias("key"),
                                    F.sha2(F.encode((F.col("id") % 50).cast("string"), "UTF-8"), 256).alias("digest"))
    manifest = merkle.build(rows)
    asked = manifest.leaves.filter("at in (0, 7, 300)").select("grp", "at", F.lit("me").alias("asked"))
    got = merkle.prove(manifest, asked).select("asked", merkle.folded(F.col("digest")).alias("root")).collect()
    assert [tuple(r) for r in got] == [("me", manifest.root)] * 9
    store = {r.digest: r.children for r in manifest.store().collect()}
    assert all(_h("".join(c)) == d for d, c in store.items())

    def leaves(d):
        return sum(map(leaves, store[d]), []) if d in store else [d]
    assert sorted(leaves(manifest.root)) == sorted(r.digest for r in manifest.leaves.collect())
