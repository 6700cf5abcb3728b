"""Rows that share an id, have none, or collide: each is judged by its own text."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline as pipeline
from tidemark.llm import bpe, embedding_dedup, exact_dedup, licenses, minmax_dedup, mixing, suffix_dedup
from tidemark.llm import common
from tidemark.llm.queries import vocabulary

WHITE = " \t\n\x0b\x0c\r"


def plain_groups(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault("".join(c for c in t or "" if c not in WHITE), []).append((i, len(t or "")))
    out = []
    for t, own in groups.items():
        best = max(own, key=lambda x: (x[0] is not None, x[1], -(x[0] or 0)))[0]
        out += [(i, best, len(own), i == best, hashlib.sha256(t.encode()).hexdigest(), len(t.encode())) for i, _ in own]
    return Counter(out)


@pytest.mark.parametrize("how", [{}, {"huge": 1000}, {"primes": (7, 11)}, {"huge": 3, "primes": (3, 5)}])
def test_exact_groups_of_any_rows(spark, how):
    r = random.Random(1)
    rows = [(i, "".join(r.choice("ab c") for _ in range(r.randint(0, 4)))) for i in range(150)] + [(1, "ab c"), (2, "abc"), (None, "a  b  c"), (None, None), (None, "zz"), (5, "ab"), (5, "cc cc")]
    rows += [(1000, "xyz " * 300_000), (1001, "xyz " * 300_000), (1002, "xyz" * 300_000 + "a")]
    got = exact_dedup.exact_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), **how).collect()
    assert Counter(map(tuple, got)) == plain_groups(rows)


def test_the_bitmap_only_spares_reading(spark, monkeypatch):
    rows = [(i, f"text {i // 2}") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(exact_dedup, "_bitmap", lambda groups: np.full(exact_dedup.BITS // 8, 255, np.uint8))
    assert Counter(map(tuple, exact_dedup.exact_groups(df).collect())) == plain_groups(rows)


def test_the_bitmap_has_the_bits_of_all_groups(spark):
    r = random.Random(4)
    marks = [0, 1, exact_dedup.BITS - 1, exact_dedup.BITS, 32_767, 32_768, (1 << 63) - 1] + [r.randrange(1 << 63) for _ in range(500)]
    bits = exact_dedup._bitmap(spark.createDataFrame([(m,) for m in marks], "mark long"))
    assert np.flatnonzero(np.unpackbits(bits, bitorder="little")).tolist() == sorted({m % exact_dedup.BITS for m in marks})


def test_texts_of_groups_are_compared(spark):
    """The chunks of every text that has a partner are sent, those of others hardly ever."""
    rows = [(i, f"text {i // 2 if i < 20 else i}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    marks = [exact_dedup._mark(__import__("xxhash").xxh3_64_intdigest(exact_dedup.normalise(t))) for _, t in rows[:20]]
    bits = spark.sparkContext.broadcast(exact_dedup._bitmap(spark.createDataFrame([(m,) for m in marks], "mark long")))
    sent = df.select("text").mapInArrow(exact_dedup._chunks(bits, exact_dedup.PRIMES), exact_dedup._CHUNKS_DDL).collect()
    assert Counter(bytes(x["data"]) for x in sent) == Counter(exact_dedup.normalise(t) for _, t in rows[:20])


def plain_repeats(rows, size=50):
    first, last = {}, 1 << 62
    for i, t in rows:
        raw = (t or "").encode()
        for k in range(len(raw) - size + 1):
            w = raw[k : k + size]
            first[w] = min(first.get(w, last), last if i is None else i)
    out = []
    for i, t in rows:
        raw, cut = (t or "").encode(), [False] * len((t or "").encode())
        for k in range(len(raw) - size + 1):
            if first[raw[k : k + size]] < (last if i is None else i):
                cut[k : k + size] = [True] * size
        kept = bytes(c for c, g in zip(raw, cut) if not g)
        out.append((i, len(raw), sum(cut), sum(g and not (k and cut[k - 1]) for k, g in enumerate(cut)), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("seed", range(2))
def test_repeats_of_rows_that_share_ids(spark, seed):
    r = np.random.default_rng(seed)
    pool = ["".join(r.choice(list("abé"), 70)) for _ in range(6)]
    text = lambda: "".join(pool[k][r.integers(0, 20) : r.integers(40, 70)] for k in r.integers(0, 6, r.integers(1, 6)))
    rows = [(int(i), text()) for i in r.integers(0, 25, 50)] + [(None, text()) for _ in range(8)] + [(None, None), (None, "x"), (3, None), (3, "")]
    rows += [rows[0], rows[1], rows[51]]
    p = "".join(chr(97 + i % 26) for i in range(76))
    rows += [(1001, p), (1002, p + "tail"), (1002, "".join(chr(65 + i * 7 % 26) for i in range(84)))]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert Counter(map(tuple, got)) == plain_repeats(rows)


def test_windows_with_one_hash_in_common_are_told_apart():
    """Records whose first hash is equal and whose second differs are different windows."""
    import pyarrow as pa

    one = [np.array([5, 5, 5], np.uint64), np.array([1, 2, 1], np.uint32)]
    doc, twin, s = np.array([1, 2, 3]), np.zeros(3, np.int64), np.zeros(3, np.int64)
    batches = [b for k in range(3) for b in suffix_dedup._deal([x[k : k + 1] for x in one], [], doc[k : k + 1], twin[k : k + 1], s[k : k + 1], s[k : k + 1], 1)]
    out = pa.Table.from_batches(list(suffix_dedup._sort_windows(iter(batches)))).to_pylist()
    assert [r["doc_id"] for r in out if r["doc_id"] is not None] == [3]


def test_near_dedup_of_small_sets_and_large_buckets(spark, monkeypatch):
    r = random.Random(3)
    texts = []
    for _ in range(150):
        w = [f"w{r.randint(0, 9999)}" for _ in range(r.randint(4, 28))]
        texts += [" ".join(w), " ".join(w[: len(w) - r.randint(0, 3)]), " ".join(w + [f"z{r.randint(0, 99)}" for _ in range(r.randint(0, 3))])]
    base = [f"b{k}" for k in range(60)]
    for k in range(90):
        texts.append(" ".join([*base[: k % 60], f"q{k}", *base[k % 60 + 1 :]]))
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in enumerate(texts) for w in [t.split()]}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in range(a):
            if (k := len(sets[a] & sets[b])) and 100 * k >= 75 * (len(sets[a]) + len(sets[b]) - k):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for block in (1024, 16):
        monkeypatch.setattr(minmax_dedup, "BLOCK", block)
        assert {x["doc_id"]: x["component_id"] for x in minmax_dedup.near_groups(df).collect()} == {i: find(i) for i in sets}


def test_exact_keys_meet_whenever_sets_are_alike():
    r = np.random.default_rng(0)
    for _ in range(2000):
        n = int(r.integers(1, 19))
        a = np.unique(r.integers(0, 1 << 62, n).astype(np.uint64))
        b = np.unique(np.concatenate([r.permutation(a)[: int(r.integers(max(1, 3 * len(a) // 4), len(a) + 1))], r.integers(0, 1 << 62, int(r.integers(0, 4))).astype(np.uint64)]))
        shared = len(np.intersect1d(a, b))
        if 100 * shared >= 75 * (len(a) + len(b) - shared):
            assert set(minmax_dedup.exact_keys(a).tolist()) & set(minmax_dedup.exact_keys(b).tolist())


def test_vectors_that_repeat_or_have_no_id(spark):
    r = np.random.default_rng(3)
    base = r.standard_normal((30, 16))
    rows = [(i, v.tolist(), 1, "x", 5, 7) for i, v in enumerate(base)] + [(3, base[3].tolist(), 1, "x", 5, 7), (None, base[4].tolist(), 1, "x", 5, 7), (None, (-base[5]).tolist(), 1, "x", 5, 7), (40, (base[3] * 2).tolist(), 1, "x", 5, 7)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, g string, rep int, size int")  # clashing names
    x = np.array([v / np.linalg.norm(v) for _, v, *_ in rows])
    near = x @ x.T >= 0.93
    np.fill_diagonal(near, False)
    want = Counter((i, int(near[k].sum()), min([j for j, m in zip([q[0] for q in rows], near[k] | (np.arange(len(rows)) == k)) if m and j is not None], default=None)) for k, (i, *_) in enumerate(rows))
    got = embedding_dedup.near_vectors(df).collect()
    assert Counter((q["vec_id"], q["n_links"], q["component_id"]) for q in got) == want
    assert all(q["kept"] == (q["vec_id"] is not None and q["vec_id"] == q["component_id"] or q["vec_id"] is None and q["component_id"] is None) for q in got)


def test_the_index_follows_the_number_of_vectors(spark, monkeypatch):
    sizes = [embedding_dedup.tables_for(n) for n in (1, 1024, 8192, 262_144, 10**8)]
    assert [s.bits for s in sizes] == [12, 12, 15, 20, 29] and all(s.tables <= 64 // s.bits * s.codes for s in sizes)
    assert sizes[-1].tables < 12 * sizes[1].tables  # for 100,000 times the vectors
    r = np.random.default_rng(8)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    a = unit(r.standard_normal((1500, 64)))
    side = r.standard_normal(a.shape)
    side = unit(side - (side * a).sum(1, keepdims=True) * a)
    both = np.vstack([a, 0.932 * a + np.sqrt(1 - 0.932**2) * side])
    want = (both @ both.T >= 0.93).sum() - len(both)
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(both)], "vec_id long, embedding array<double>, label int")
    plain = embedding_dedup.tables_for
    for n in (3000, 200_000):  # the index of this size, and that of a larger one
        monkeypatch.setattr(embedding_dedup, "tables_for", lambda _, n=n: plain(n))
        assert sum(q["n_links"] for q in embedding_dedup.near_vectors(df).collect()) >= 0.98 * want


def test_pieces_of_unassigned_characters_are_cut_too():
    from tokenizers import Tokenizer

    c, t, r = bpe.codec(vocabulary()), Tokenizer.from_file(vocabulary()), random.Random(1)
    assert c._unassigned("a͸b") and not c._unassigned("aé漢")
    for _ in range(300):
        text = "".join(chr(r.choice([r.randint(32, 126), 0x378, 0x1F9FF, r.randint(0x30000, 0x3FFFF), 0x20, 0x0A, 0xE9])) for _ in range(r.randint(0, 40)))
        assert c.encode(text) == t.encode(text, add_special_tokens=False).ids
    seen = []
    c.pieces.clear()
    real, c.encode_piece = c.encode_piece, lambda p: seen.append(p) or real(p)
    c.digest("zq͸xj zqxj")
    del c.encode_piece
    assert "".join(seen) == "zq͸xj zqxj"


def test_topics_and_notices(spark):
    df = spark.createDataFrame([(1, "the court and the judge of a bank"), (2, "Bank LOAN tax court"), (3, "| a | b"), (4, None), (5, "plain")], "doc_id long, text string").selectExpr("*", "'s' as source", "'en' as lang")
    assert {r["doc_id"]: r["topic"] for r in mixing.mix(df).collect()} == {1: "law", 2: "finance", 3: "table", 4: "prose", 5: "prose"}
    notes = spark.createDataFrame([(1, "# SPDX-License-Identifier: MIT"), (2, licenses.TEMPLATES["zlib"].replace(" ", "\n ")), (3, "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version")], "doc_id long, text string")
    assert {r["doc_id"]: r["license"] for r in licenses.licenses(notes).collect()} == {1: "spdx-mit", 2: "zlib", 3: "agpl-notice"}


def test_tables_of_a_long_driver_can_be_released(spark):
    import os

    one = common.written(spark.range(5))
    path = one.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert os.path.isdir(path)
    common.release()
    assert not os.path.exists(path) and not common._written


# --- stages of the pipeline ------------------------------------------------------------------------------------------

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd(spark):
    near = [f"w{k}" for k in range(40)]
    other = [*near[:20], "changed", *near[21:]]
    rows = [
        (1, " ".join(near)), (2, " ".join(other)), (2, " ".join(other)), (3, "copy of it"), (4, "copy  of\nit "), (None, "copy of it"), (None, None), (5, None), (6, ""), (7, "you are an idiot, you scum. I will kill you!"), (None, "you are an idiot, you scum. I will kill you!"), (8, "ab " * 100_000), (9, "fine words"), (9, "other words"),
    ]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, "k", 0.5, True) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, n long, own string, score double, kept boolean")
    return rows, df


def ids(df):
    return Counter((r["doc_id"], r["text"]) for r in df.collect())


def test_every_stage_on_odd_rows(spark, odd):
    rows, df = odd
    tox, exact, near, mix, tokens = (f for _, f in pipeline.STAGES)
    assert ids(tox(spark, df, SF)) == Counter(r for r in rows if "idiot" not in (r[1] or ""))
    # Ids of copies go, longer originals stay; rows without an id, and those that share the id of one that stays, stay.
    assert ids(exact(spark, df, SF)) == Counter(r for r in rows if r[0] not in (3, 6))
    assert ids(near(spark, df, SF)) == Counter(r for r in rows if r[0] not in (2, 4))
    kept = ids(mix(spark, df, SF))
    assert kept <= Counter(rows) and kept[2, rows[1][1]] in (0, 2)
    for f in (tox, exact, near, mix):
        assert f(spark, df, SF).columns == df.columns
    c = bpe.codec(vocabulary())
    assert Counter(map(tuple, tokens(spark, df, SF).collect())) == Counter((i, *c.digest(t)) for i, t in rows)


def test_every_stage_on_an_empty_table(spark, odd):
    none = odd[1].limit(0)
    for _, f in pipeline.STAGES:
        assert f(spark, none, SF).count() == 0
