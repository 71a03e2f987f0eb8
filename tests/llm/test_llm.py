"""Operators of the corpus package against libraries and brute force, and on odd inputs."""

import collections
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tracklake.llm import (ann, bytebpe, common, dac, hostrules, jaccard, langid, neardup, packing, queries, sharding, spans, toxicity, words)
from tracklake.session import ship_package

SMALL = "/root/testdata/sf0.001"
WORD = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
TEXTS = st.lists(st.sampled_from([*"ab 1'sé\n\t  .,É_²İß日", "<|endoftext|>", "\x1c", "\x85", "'re"]), max_size=30).map("".join)


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship_package(spark)


@pytest.fixture(scope="session")
def texts():
    return [r[0] for r in duckdb.sql(f"select text from '{SMALL}/documents.parquet' order by doc_id").fetchall()]


# ------------------------------------------------------------------ tokens
@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_word_bpe_equals_library(text):
    lib = _lib()
    assert words.word_bpe(WORD).encode(text) == words.packed(lib.encode(text, add_special_tokens=False).ids)


_LIB = []


def _lib():
    if not _LIB:
        _LIB.append(Tokenizer.from_file(WORD))
    return _LIB[0]


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_byte_bpe_equals_tiktoken_and_decodes(text):
    bpe = words.byte_bpe(RANKS, public_tokenizers.PATTERN)
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    ids = enc.encode_ordinary(text)
    assert bpe.encode(text) == words.packed(ids)
    assert bpe.decode(ids) == text.encode()
    starts, ends = bpe.offsets(text, ids)
    for i, s, e in zip(ids, starts, ends):
        assert bpe.token_bytes[i] in text[s:e].encode()


def test_byte_bpe_odd_documents(odd_docs):
    enc = bytebpe.encode_documents(odd_docs, RANKS, public_tokenizers.PATTERN, offsets=True)
    rows = bytebpe.decode_documents(enc, RANKS, public_tokenizers.PATTERN).collect()
    assert len(rows) == 9 and all(bytes(r.decoded) == (r.text or "").encode() for r in rows)


def test_directly_addressable_codes():
    ids = np.array([random.Random(1).choice([3, 300, 70_000, 2**31]) for _ in range(5000)], dtype=np.uint32)
    levels = dac.Levels(*dac.encode_levels(ids))
    assert all(levels.token(i) == ids[i] for i in range(0, 5000, 7))
    for a, b in ((0, 5000), (511, 513), (1024, 1024), (17, 2049)):
        assert (levels.slice(a, b) == ids[a:b]).all()


def test_token_files(spark, odd_docs, tmp_path):
    dac.write_tokens(odd_docs, str(tmp_path / "t"), WORD, end_id=2)
    rows = dac.read_tokens(spark, str(tmp_path / "t")).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, 1, 2, 3, 4, 5, 6, 6, 7]
    source = {r.doc_id: r.text for r in odd_docs.collect()}
    at = 0
    for r in rows:
        ids = _lib().encode(source[r.doc_id] or "", add_special_tokens=False).ids + [2]
        assert r.start == at and bytes(r.ids) == words.packed(ids)
        at += len(ids)


def test_token_ranges_of_a_stored_table(spark, odd_docs, tmp_path):
    """Single tokens and ranges, beyond the end, empty, null, repeated, many of one document; unknown ids have none."""
    path = str(tmp_path / "t")
    dac.write_tokens(odd_docs, path, WORD, end_id=2)
    whole = {r.doc_id: np.frombuffer(r.ids, "<u4") for r in dac.read_tokens(spark, path).collect()}
    n = len(whole[5])
    asked = [(5, i, i + 1, "x") for i in range(0, n + 3, 997)] + [(5, n - 3, n + 50, None), (5, 7, 7, None), (5, 9, 3, None), (5, -4, 2, None)]
    asked += [(None, 1, 3, None), (None, 1, 3, None), (1, 0, 5, None), (6, 10, 600, None), (99, 0, 5, None), (4, None, 2, None), (4, 0, None, None)]
    wanted = spark.createDataFrame(asked, "doc_id long, first long, last long, ids string")
    got = dac.read_ranges(spark, path, wanted)
    assert got.columns == ["doc_id", "first", "last", "ids"]
    want = [(d, a, b, whole[d][max(a or 0, 0): max(b or 0, 0)].tobytes()) for d, a, b, _ in asked if d in whole]
    want += [w for w in want if w[0] == 6]  # two documents of that id
    assert sorted(((r.doc_id, r.first, r.last, bytes(r.ids)) for r in got.collect()), key=repr) == sorted(want, key=repr)
    assert dac.read_ranges(spark, path, wanted.where("doc_id = 99")).count() == 0


def test_packing(spark, odd_docs):
    pieces = packing.token_pieces(odd_docs, WORD, 0, 2048)
    packed = packing.pack(pieces, 2048).collect()
    assert len(packed) == pieces.count()
    bins = collections.defaultdict(list)
    for r in packed:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 2048
    assert len(bins) <= -(-sum(r.length for r in packed) // 2048) + 1
    assert packing.sequences(packing.pack(pieces, 2048)).count() == len(bins)


def test_evolved_bins_are_not_worse_than_best_fit():
    rng = random.Random(3)
    lengths = [rng.randint(300, 1100) for _ in range(400)]
    order = sorted(range(400), key=lambda i: -lengths[i])
    bins = packing.evolve(lengths, 2048, 1, [])
    assert sorted(i for b in bins for i in b) == list(range(400))
    assert all(sum(lengths[i] for i in b) <= 2048 for b in bins)
    assert len(bins) <= len(packing._fit(lengths, order, 2048))


# ------------------------------------------------------------------ rules, shards
def test_host_rules(spark, odd_docs):
    measured = hostrules.document_rules(odd_docs)
    rows = hostrules.apply_verdicts(measured, hostrules.host_verdicts(measured)).collect()
    assert len(rows) == 9
    for r in rows:
        w = [x for x in (r.text or "").translate({c: " " for c in range(9, 14)}).split(" ") if x]
        grams = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
        n = collections.Counter(grams)
        assert r.n_words == len(w)
        assert r.n_repeat_words == len({i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(5)})
        assert r.base_failed == (len(w) < 10 or 100 * r.n_repeat_words > 20 * len(w))


def test_bad_host_is_rejected(spark):
    good = " ".join(f"w{i}" for i in range(30))
    rows = [(i, good if i % 10 else "bad", "x") for i in range(50)] + [(100 + i, "bad" if i else good, "y") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    m = hostrules.document_rules(docs)
    kept = {r.doc_id for r in hostrules.apply_verdicts(m, hostrules.host_verdicts(m)).filter("kept").collect()}
    assert 100 not in kept and kept == {i for i in range(50) if i % 10}


def test_shards(spark, odd_docs):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    hot = spark.range(60).select((F.col("id") + 10_000).alias("doc_id"), F.lit("the same text").alias("text"))
    rows = sharding.shard_documents(docs.unionByName(hot), 4).collect()
    sizes = collections.Counter(r.shard for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and len(rows) == docs.count() + 60
    for t, n in sizes.items():
        assert sorted(r.slot for r in rows if r.shard == t) == list(range(n))
    assert len({r.shard for r in rows if r.doc_id >= 10_000}) == 1
    assert sharding.shard_documents(odd_docs, 4).count() == 9


# ------------------------------------------------------------------ duplicates
def test_spans(spark, odd_docs):
    passage = "Alpha beta gamma delta epsilon zeta eta theta iota kappa. Lambda mu nu xi omicron pi rho sigma tau upsilon. Phi chi psi omega once more and then again here."
    rows = [(1, f"First own sentence. {passage} End of one."), (2, f"Second text\n{passage} Tail."), (3, "Nothing shared here. At all."),
            (4, f"{passage} Between. {passage}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in spans.dedup_spans(docs).collect()}
    assert got[1].text == rows[0][1] and got[3].text == rows[2][1]
    assert got[2].text == "Second text\nTail." and got[4].text == "Between. "
    for r in got.values():
        cut = dict(rows)[r.doc_id]
        for s in reversed(r.removed_spans):
            cut = cut[:s.start] + cut[s.end:]
        assert cut == r.text
    assert spans.dedup_spans(odd_docs).count() == 9


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="aB .!?\n\x85É日", max_size=200), max_size=4))
def test_sentences_lose_nothing(texts):
    h, of, start, end, stop = spans.words_of(texts)
    first, owner = spans.sentences_of(h, of, stop)
    for i, t in enumerate(texts):
        at = np.flatnonzero(owner == i)
        bounds = [(start[first[k]], end[first[k + 1] - 1]) for k in at]
        assert all(x[1] == y[0] for x, y in zip(bounds, bounds[1:]))
        assert not bounds or (t[:bounds[0][0]].strip() == "" and bounds[-1][1] == len(t))
        assert bounds or not t.strip()


def _sentences_by_hand(text):
    """Lists of words: cut after marks and line ends, and after words picked by hash with no mark within NEAR words."""
    words = re.findall(r"\S+\s*", text)
    h = spans.words_of([text])[0]
    stop = [w.rstrip()[-1] in ".!?" or "\n" in w for w in words]
    out, held = [], []
    for i, w in enumerate(words):
        held.append(w)
        around = stop[max(i - spans.NEAR, 0):i + spans.NEAR + 1]
        if stop[i] or i == len(words) - 1 or (not any(around) and int(h[i]) % spans.CUT_ONE_IN == 0):
            out.append(held)
            held = []
    return out


def _left_by_hand(rows):
    """Texts without the sentences of any run that occurred before, from all runs of all lengths."""
    seen, cut = collections.defaultdict(list), {d: _sentences_by_hand(t) for d, t in rows}
    for d, sentences in sorted(cut.items()):
        plain = [[w.strip().lower() for w in s] for s in sentences]
        for a in range(len(plain)):
            for z in range(a + 2, len(plain) + 1):
                words = sum(plain[a:z], [])
                if len(words) >= spans.MIN_WORDS:
                    seen[tuple(words)].append((d, a, z))
    gone = {(d, i) for places in seen.values() for d, a, z in sorted(places)[1:] for i in range(a, z)}
    return {d: "".join("".join(s) for i, s in enumerate(sentences) if (d, i) not in gone) for d, sentences in cut.items()}


def test_spans_equal_all_runs_by_brute_force(spark):
    rng = random.Random(8)
    bank = [" ".join(rng.choice("ab cd ef gh ij kl mn op".split()) + str(rng.randrange(30)) for _ in range(rng.randrange(1, 14)))
            + rng.choice([". ", "! ", "\n", " ", " "]) for _ in range(40)]
    passages = [[rng.choice(bank) for _ in range(rng.randrange(2, 9))] for _ in range(12)]
    rows = []
    for d in range(80):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            own = [f"own{rng.randrange(10 ** 6)}" + rng.choice([" ", " ", ". "]) for _ in range(rng.randrange(0, 25))]
            passage = rng.choice(passages)
            parts += own + passage[rng.randrange(2):]
        rows.append((d, "".join(parts).rstrip()))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = {r.doc_id: r.text for r in spans.dedup_spans(docs).collect()}
    assert left == _left_by_hand(rows) and sum(left[d] != t for d, t in rows) > 20


def test_passages_that_start_inside_a_sentence(spark):
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(10 ** 9)}"
    rows, own, kept = [], {}, 0
    for i in range(120):
        passage = [word() + ("." if rng.random() < i % 3 * 0.08 else "") for _ in range(60)]
        for doc in (2 * i, 2 * i + 1):
            before, after = [word() for _ in range(rng.randrange(1, 90))], [word() for _ in range(rng.randrange(1, 90))]
            rows.append((doc, " ".join(before + passage + after)))
            own[doc] = (before + after, set(passage))
    shared = [word() for _ in range(19)]  # under the limit
    rows += [(doc, " ".join([word(), *shared, word()])) for doc in (500, 501)]
    left = {r.doc_id: r.text for r in spans.dedup_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for doc, text in rows:
        if doc % 2 == 0 or doc >= 500:
            assert left[doc] == text
        else:  # what is the document's own stays; some words may stay at the ends of the passage
            words = left[doc].split()
            assert [w for w in words if w not in own[doc][1]] == own[doc][0]
            assert len(words) < len(text.split()) - 20
            kept += len(words) - len(own[doc][0])
    assert kept < 0.2 * 120 * 60


def test_spans_clashing_names_and_empty_table(spark, odd_docs):
    docs = odd_docs
    for c in ("_row", "held", "marks", "own_id", "own_row", "h1", "n_removed", "_marks"):
        docs = docs.withColumn(c, F.lit("clash"))
    out = spans.dedup_spans(docs)
    assert out.columns == [c for c in docs.columns if c != "n_removed"] + ["n_sentences", "n_removed", "removed_spans"]
    rows = out.collect()
    assert len(rows) == 9 and all(r.held == r.marks == r._row == "clash" for r in rows)
    assert sorted(r.doc_id for r in rows if r.text is None) == [1] and spans.dedup_spans(docs.limit(0)).collect() == []


def _classes(pairs, ids):
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in pairs:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_near_duplicates_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("length(text) < 4000")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    idf = neardup.inverse_frequencies(docs)
    sets = {}
    for i, t in rows:
        s, n = neardup.shingles(t or "")
        sets[i] = (s, neardup.weights(s, n, idf))
    holders = collections.defaultdict(list)
    for i, (s, _) in sets.items():
        for x in s:
            holders[x].append(i)
    pairs = {p for h in holders.values() if 1 < len(h) < 200 for p in itertools.combinations(sorted(h), 2)}
    want = _classes([(a, b) for a, b in pairs if neardup.similarity(sets[a], sets[b]) >= 0.8], sets)
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(docs).collect()}
    assert sum(got[i] != want[i] for i in got) <= 0.002 * len(got)


def test_near_duplicates_odd_documents(spark, odd_docs):
    got = [(r.doc_id, r.class_id) for r in neardup.near_duplicates(odd_docs).collect()]
    assert len(got) == 9 and {c for d, c in got if d in (5, 6)} == {5} and (1, 1) in got and (2, 2) in got
    kept = neardup.first_of_class(odd_docs)
    assert kept.columns == odd_docs.columns and {r.doc_id for r in kept.collect()} == {None, 1, 2, 3, 4, 5, 7}


# ------------------------------------------------------------------ vectors
def test_search(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 16)) * rng.uniform(0.5, 2, size=(400, 1))
    x[300:] = x[300]
    rows = [(i, v.tolist(), "own") for i, v in enumerate(x)] + [(1000, None, ""), (1001, [0.0] * 16, ""), (1002, [1.0], ""),
                                                           (1003, [float("nan")] * 16, ""), (1004, [None] * 16, "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    got = collections.defaultdict(list)
    for r in ann.search(df, F.col("vec_id") % 20 == 0, k=10, tables=10, probes=12).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    hits = 0
    for q in range(0, 400, 20):
        s = x @ x[q]
        want = sorted((i for i in range(400) if i != q), key=lambda i: (-round(s[i], 9), i))[:10]
        hits += len({i for i, _ in got[q]} & set(want))
        assert all(abs(v - s[i]) < 1e-9 for i, v in got[q]) and q not in dict(got[q])
    assert hits / 200 >= 0.9
    assert [i for i, _ in got[320]] == list(range(300, 310)) and 1000 not in got


def test_recall_of_the_query(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").toPandas()
    x, ids = np.stack(df["embedding"]).astype(float), df["vec_id"].to_numpy()
    got = collections.defaultdict(set)
    for r in queries.QUERIES["op2_cross_polytope"](spark, "/root/testdata/sf0.01").collect():
        got[r.query_id].add(r.vec_id)
    at = np.flatnonzero(ids % 20 == 0)
    s = x[at] @ x.T
    s[np.arange(len(at)), at] = -np.inf
    best = np.argsort(-s, axis=1)[:, :20]
    assert np.mean([len(got[ids[q]] & set(ids[b])) / 20 for q, b in zip(at, best)]) >= 0.9


def test_tables_alone_find_the_near_ones(spark, monkeypatch):
    monkeypatch.setattr(ann, "ANGLE", 1e-9)  # no query visits a whole range
    x = ann.unit(np.random.default_rng(9).normal(size=(2000, 64)))
    got = _searched(spark, x, F.col("vec_id") % 20 == 0)
    s = x[::20] @ x.T
    s[np.arange(100), np.arange(0, 2000, 20)] = -np.inf
    best = np.argsort(-s, axis=1)[:, :20]
    assert 0.9 <= np.mean([len(set(got[20 * q]) & set(b)) / 20 for q, b in enumerate(best)]) < 1


def test_visits_follow_from_scores(spark):
    """A range is met as a whole only where its longest vector could win at a wide angle."""
    kinds = spark.createDataFrame([(b"a", b"v", True, 0.0, 0), (b"b", b"v", True, 0.0, 0), (b"c", b"v", False, 0.0, 5),
                                   (b"d", b"v", False, 0.0, 50)], "c binary, vec binary, asked boolean, length double, range int")
    found = spark.createDataFrame([(b"a", [(-0.9, 1), (-0.8, 2)])], "q binary, all array<struct<s:double,i:long>>")
    got = sorted((bytes(r.c), r.axis) for r in ann._visits(kinds, found, 1, 2, 64).collect())
    # a: 0.8 at length 1 needs cosines of 0.2 up to lengths of 4, which range 50 exceeds; b found nothing
    assert got == [(b"a", 50), (b"b", 0), (b"b", 5), (b"b", 50)]


def _searched(spark, x, asked, k=20):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in ann.search(df, asked, k=k).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    return got


def test_search_of_few_rows_finds_all(spark):
    x = np.random.default_rng(6).normal(size=(15, 64))
    got = _searched(spark, x, F.col("vec_id") >= 0)
    assert all(got[q] == sorted(set(range(15)) - {q}, key=lambda i: -x[i] @ x[q]) for q in range(15))


@pytest.mark.parametrize("block", [4096, 500])
def test_search_with_one_long_vector(spark, monkeypatch, block):
    monkeypatch.setattr(ann, "BLOCK", block)
    x = ann.unit(np.random.default_rng(7).normal(size=(2000, 64)))
    x[1] *= 100
    got = _searched(spark, x, F.col("vec_id") % 20 == 0)
    s = x[::20] @ x.T
    s[np.arange(100), np.arange(0, 2000, 20)] = -np.inf
    best = np.argsort(-s, axis=1)[:, :20]
    assert all(len(got[20 * q]) == 20 and ((1 in got[20 * q]) == (1 in b)) for q, b in enumerate(best))
    assert np.mean([len(set(got[20 * q]) & set(b)) / 20 for q, b in enumerate(best)]) >= 0.95


def test_search_completes_queries_that_find_too_few(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 50)
    rng = np.random.default_rng(8)
    x = ann.unit(np.eye(64)[0] + 0.01 * rng.normal(size=(300, 64)))
    x[0] *= -1
    got = _searched(spark, x, F.col("vec_id") == 0)
    assert got[0] == np.argsort(-(x[1:] @ x[0]))[:20].__add__(1).tolist()


# ------------------------------------------------------------------ models
def test_language(spark, odd_docs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    rows = queries.QUERIES["op1_byte_gru"](spark, "/root/testdata/sf0.01").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    assert np.mean([truth[r.doc_id] == r.lang_pred for r in held]) > 0.95
    got = {r.doc_id: r.lang_pred for r in langid.label_documents(odd_docs, None).collect()}
    assert set(got.values()) == {"und"}


def test_language_learns_from_whole_texts(spark):
    """What tells the languages apart comes late in the texts; copies of an id and empty texts do no harm."""
    rows = [(i, "0 " * 2000 + ("ab " if i % 2 else "xy ") * 1500, "ab" if i % 2 else "xy") for i in range(40)]
    rows += [(1, None, "ab"), (2, "", "xy"), (None, "xy " * 50, "xy"), (3, "ab", None)] + rows[:5]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = langid.train(docs, docs=10)
    asked = spark.createDataFrame([("ab " * 40,), ("xy " * 40,), (None,), ("12",)], "text string")
    got = {r.text: r.lang_pred for r in langid.label_documents(asked, net).collect()}
    assert got == {"ab " * 40: "ab", "xy " * 40: "xy", None: "und", "12": "und"}
    assert langid.train(docs.limit(0)) is None


def test_gradients_of_the_network():
    rng = np.random.default_rng(0)
    d = langid.Direction(rng, 3)
    x = rng.integers(1, 9, size=(5, 4))
    weight = rng.normal(size=(5, 4, 3))
    _, tape = d.forward(x, keep=True)
    g = d.backward(x, tape, weight)
    for k, at in (("u", (1, 2)), ("c", (0, 2)), ("e", (int(x[2, 1]), 4))):
        old = d.p[k][at]
        value = []
        for step in (1e-5, -1e-5):
            d.p[k][at] = old + step
            value.append((d.forward(x)[0] * weight).sum())
        d.p[k][at] = old
        assert abs((value[0] - value[1]) / 2e-5 - g[k][at]) < 1e-6
    assert np.abs(d.read(x) - d.forward(x)[0]).max() < 1e-5


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(4)
    e, trans = rng.normal(size=(1, 6)), rng.normal(size=(2, 2))
    total, want = 0.0, np.zeros(6)
    for y in itertools.product((0, 1), repeat=6):
        score = sum(e[0, k] * y[k] for k in range(6)) + trans[0, y[0]] + sum(trans[a, b] for a, b in zip(y, y[1:]))
        total += np.exp(score)
        want += np.exp(score) * np.array(y)
    assert np.allclose(toxicity.marginals(e, trans)[0], want / total)


def test_toxicity(spark, odd_docs):
    rows = queries.QUERIES["op10_crf_toxicity"](spark, "/root/testdata/sf0.1").collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    held = [r for r in rows if r.held_out and labels.get(r.doc_id) is not None]
    assert np.mean([r.predicted == labels[r.doc_id] for r in held]) > 0.95
    assert all(r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)
    assert {r.score for r in toxicity.score_documents(odd_docs, None).collect()} == {0.0}


def test_toxic_words_late_in_training_texts(spark):
    rng = random.Random(9)
    word = lambda: f"clean{rng.randrange(3000)}"
    rows = []
    for i in range(400):  # toxic words only after 4000 characters, in one document of four
        tokens = [word() for _ in range(1000)]
        if i % 4 == 0:
            for _ in range(12):
                tokens[rng.randrange(700, 1000)] = f"vileword{rng.randrange(5)}"
        rows.append((i, " ".join(tokens), int(i % 4 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    tagger = toxicity.train(docs.filter("doc_id < 300"))
    got = toxicity.score_documents(docs.filter("doc_id >= 300"), tagger).collect()
    assert all(r.predicted == r.toxic and bool(r.toxic_spans) == bool(r.toxic) for r in got)
    assert all("vile" in r.text[s.start:s.end] for r in got for s in r.toxic_spans)


def test_pipeline(spark):
    import corpus_pipeline
    out = corpus_pipeline.run(spark, SMALL).collect()
    assert out and len({(r.doc_id, r.piece) for r in out}) == len(out)


def test_hosts_of_few_documents_are_pulled_to_the_mean(spark):
    good, bad = "ten good words that are all different from each other here", "short"
    rows = [(f"h{i}", good if j % 10 else bad) for i in range(60) for j in range(40)]  # alike: a tenth of each host fails
    rows += [("one", bad), ("three", bad), ("three", bad), ("three", good)]
    rows += [("junk", bad)] * 40 + [("most", bad)] * 35 + [("most", good)] * 5
    docs = spark.createDataFrame([(i, t, s) for i, (s, t) in enumerate(rows)], "doc_id long, text string, source string")
    found = {r.host: r for r in hostrules.host_verdicts(hostrules.document_rules(docs)).collect()}
    mean = sum(t == bad for _, t in rows) / len(rows)
    assert mean < found["one"].short_rate < 0.35 and found["three"].short_rate < 0.4
    assert found["junk"].host_rejected and found["most"].host_rejected and not any(found[f"h{i}"].host_rejected for i in range(60))
    same = hostrules.host_verdicts(hostrules.document_rules(docs.filter("source in ('h1', 'h2', 'one')"))).collect()
    assert max(r.short_rate for r in same) - min(r.short_rate for r in same) < 0.35 and not any(r.host_rejected for r in same)
    singles = hostrules.host_verdicts(hostrules.document_rules(docs.withColumn("source", F.col("doc_id").cast("string")))).collect()
    assert max(abs(r.short_rate - mean) for r in singles) < 1e-3


def test_near_copies_meet_once_in_buckets_of_the_same_texts(spark):
    rows = [(bytes([n]), band, key) for band, key, nodes in
            ((0, 7, (1, 2)), (1, 8, (1, 2)), (2, 9, (1, 2, 3)), (3, 5, (3, 4)), (4, 6, (4,))) for n in nodes]
    every = spark.createDataFrame(rows, "node binary, band int, key long")
    got = sorted((r.band, r.key, r.n) for r in neardup._distinct_buckets(every).collect())
    assert got == [(0, 7, 2), (2, 9, 3), (3, 5, 2)]


def test_plain_shingles_draw_what_the_whole_formula_draws():
    rng = np.random.default_rng(4)
    s = np.unique(rng.integers(0, 1 << 63, 700).astype(np.uint64))
    w = np.where(rng.random(len(s)) < 0.8, 1.0, rng.uniform(0.5, 3, len(s)))
    r, b, ln_c = (x[neardup.feature(s)] for x in neardup._draws(neardup.FEATURES, neardup.HASHES)[:3])
    t = np.floor(np.log(w).astype(np.float32)[:, None] * np.reciprocal(r) + b)
    ln_a = ln_c - (t - b + np.float32(1)) * r
    k = ln_a.argmin(axis=0)
    want = neardup.feature(s)[k] * 4096 + t[k, np.arange(neardup.HASHES)].astype(np.int64) % 4096
    assert (neardup.samples(s, w) == want).all()
    assert len(neardup._draws(neardup.FEATURES, neardup.HASHES)) == 4  # the last one is what weight 1 draws


def _staged(spark):
    import os
    from tracklake.session import checkpoint_dir
    return {p for p in os.listdir(checkpoint_dir(spark).replace("file:", "")) if p.startswith("tracklake-")}


def test_tables_of_a_step_are_given_up_but_for_the_last_ones(spark):
    texts = [" ".join(f"w{i}x{k}" for k in range(60)) for i in range(30)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, t + " tail") for i, t in enumerate(texts[:10])] + [(3, texts[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    before = _staged(spark)
    kept = neardup.first_of_class(docs)
    assert len(_staged(spark) - before) == 1
    assert sorted(r.doc_id for r in kept.collect()) == list(range(30))
    before = _staged(spark)
    left = spans.dedup_spans(docs)
    assert len(_staged(spark) - before) == 1 and left.count() == 41
    before = _staged(spark)
    found = jaccard.components(docs)
    assert len(_staged(spark) - before) == 2 and found.filter("component_id < 30").count() == 41


def test_rows_without_a_partner_are_not_dealt(spark):
    rows = spark.range(5000).withColumn("word", F.lit("own"))
    wanted = spark.range(0, 5000, 50).select(F.col("id").alias("like"))
    may, rest = common.parted(rows, "id", wanted, "like")
    assert may.columns == rest.columns == ["id", "word"]
    assert may.count() + rest.count() == 5000 and may.count() < 110
    assert rest.join(wanted, F.col("id") == F.col("like")).isEmpty()


def test_near_duplicates_store_no_texts(spark, monkeypatch):
    words = [f"w{i}" for i in range(60)]
    near = " ".join([*words[:-1], "other"])
    rows = [(1, " ".join(words)), (2, near), (2, near), (3, " ".join(words)), (None, near), (4, None), (None, None),
            *((10 + i, f"text number {i} has nothing in common with any of the rest {i * 7}") for i in range(30))]
    stored, stage = [], neardup.stage
    monkeypatch.setattr(neardup, "stage", lambda df, name, **k: (stored.append(df.columns), stage(df, name, **k))[1])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.class_id) for r in neardup.near_duplicates(docs).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1] or 0))
    assert got[:4] == [(1, 1), (2, 1), (2, 1), (3, 1)] and (None, 1) in got and (None, None) in got and (4, 4) in got
    assert all((i, i) in got for i in range(10, 40)) and len(got) == len(rows)
    assert stored and not any("text" in columns for columns in stored)
