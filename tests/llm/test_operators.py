"""Each operator on rows with nulls, empty and very long texts, ties, repeated rows, clashing names, and on empty tables."""

import hashlib
import math

import numpy as np
import pytest

from tidemark.llm import bpe, embedding_dedup, exact_dedup, langid, licenses, minmax_dedup, mixing, quality, suffix_dedup, toxicity
from tidemark.llm.common import components, held_out
from tidemark.llm.queries import vocabulary

WHITE = " \t\n\x0b\x0c\r"


def union_find(links, ids):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def by_id(df):
    return {r["doc_id"]: r for r in df.collect() if r["doc_id"] is not None}


def test_components_of_a_long_path(spark):
    got = {r[0]: r[1] for r in components(spark.range(200).selectExpr("id as a", "id + 1 as b").union(spark.range(300, 310).selectExpr("id as a", "309 as b"))).collect()}
    assert all(got[i] == 0 for i in range(201)) and all(got[i] == 300 for i in range(300, 310))


def test_fingerprints_compose():
    data = bytes(range(256)) * 700
    whole = exact_dedup.fingerprint(data, 1 << 30)
    assert whole == exact_dedup.fingerprint(data, 1000) == exact_dedup.fingerprint(data, 7)
    a, b, c = data[:10], data[10:999], data[999:]
    h = exact_dedup.chunk_hash
    assert exact_dedup.combine(exact_dedup.combine(h(a), h(b)), h(c)) == exact_dedup.combine(h(a), exact_dedup.combine(h(b), h(c))) == whole


def test_exact_dedup(docs, texts):
    rows = exact_dedup.exact_groups(docs).collect()
    assert len(rows) == docs.count()
    norm = {i: "".join(c for c in t or "" if c not in WHITE) for i, t in texts.items()}
    for i, r in by_id(exact_dedup.exact_groups(docs)).items():
        same = [j for j in norm if norm[j] == norm[i]]
        keep = min(same, key=lambda j: (-len(texts[j] or ""), j))
        extra = (norm[i] == norm[6]) + (norm[i] == "")  # the repeated row, and the null one without an id
        assert (r["keep_id"], r["group_size"], r["kept"]) == (keep, len(same) + extra, i == keep), i
        assert r["text_sha256"] == hashlib.sha256(norm[i].encode()).hexdigest()


def test_near_dedup(docs, texts):
    got = by_id(minmax_dedup.near_groups(docs))
    sets = {}
    for i, t in texts.items():
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    links = [(a, b) for a in sets for b in sets if a < b and (k := len(sets[a] & sets[b])) and 100 * k >= 75 * (len(sets[a]) + len(sets[b]) - k)]
    root = union_find(links, sets)
    assert {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in got.items()} == {i: (len(sets[i]), root[i], root[i] == i) for i in sets}
    assert root[8] == root[6] and root[4] != root[6]
    assert minmax_dedup.near_groups(docs).count() == docs.count()


def test_min_max_estimates_similarity():
    a, b = np.arange(1000, dtype=np.uint64), np.arange(150, 1150, dtype=np.uint64)
    x, y = (minmax_dedup._mix(s + np.uint64(1)) for s in (a, b))
    same = (minmax_dedup.signature(x) == minmax_dedup.signature(y)).mean()
    assert abs(same - 850 / 1150) < 0.15


def brute_repeats(texts, size=50):
    raw = {i: (t or "").encode() for i, t in texts.items()}
    first = {}
    for i in sorted(raw):
        for k in range(len(raw[i]) - size + 1):
            first.setdefault(raw[i][k : k + size], i)
    out = {}
    for i, b in raw.items():
        gone = np.zeros(len(b) + 1, np.int64)
        for k in range(len(b) - size + 1):
            if first[b[k : k + size]] < i:
                gone[k] += 1
                gone[k + size] -= 1
        cut = np.cumsum(gone)[:-1] > 0
        kept = bytes(c for c, g in zip(b, cut) if not g)
        out[i] = (len(b), int(cut.sum()), int((cut & ~np.append(False, cut[:-1])).sum()) if len(b) else 0, hashlib.sha256(kept).hexdigest())
    return out


def test_repeat_removal(docs, texts):
    got = by_id(suffix_dedup.remove_repeats(docs))
    assert {i: tuple(r)[1:] for i, r in got.items()} == brute_repeats(texts)
    assert suffix_dedup.remove_repeats(docs).count() == docs.count()


def test_merged_spans_keep_documents_apart():
    doc, twin, s, e = suffix_dedup.merged(np.array([1, 1, 1, 2, 2, 2]), np.array([0, 0, 0, 0, 0, 7]), np.array([0, 10, 40, 5, 90, 6]), np.array([10, 20, 50, 60, 95, 61]))
    assert list(zip(doc.tolist(), twin.tolist(), s.tolist(), e.tolist())) == [(1, 0, 0, 20), (1, 0, 40, 50), (2, 0, 5, 60), (2, 0, 90, 95), (2, 7, 6, 61)]


def test_bpe(docs, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary())
    got = by_id(bpe.encode_digests(docs, vocabulary()))
    for i, text in texts.items():
        want = t.encode(text or "", add_special_tokens=False).ids
        assert got[i]["n_tokens"] == len(want), i
        assert got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(t.decode(want, skip_special_tokens=False).encode()).hexdigest()
    back = {r["doc_id"]: r["text"] for r in bpe.decode_ids(bpe.encode_ids(docs, vocabulary()), vocabulary()).collect()}
    assert all(back[i] == (text or "") for i, text in texts.items())


def test_bpe_fragments_are_cut_at_impossible_pairs_only():
    c = bpe.codec(vocabulary())
    raw = "zqxj漢字~~Hello_world".encode()
    parts = c.fragments(raw)
    assert b"".join(parts) == raw and len(parts) > 1
    assert all(not c.joins[a[-1] << 8 | b[0]] for a, b in zip(parts, parts[1:]))


def test_embeddings(spark):
    r = np.random.default_rng(3)
    base = r.standard_normal((60, 64))
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(base)]
    rows += [(100 + i, (base[i] + 0.02 * r.standard_normal(64)).tolist(), i % 3) for i in range(20)] + [(200 + i, base[0].tolist(), 0) for i in range(5)]
    rows += [(300, None, 1), (301, [0.0] * 64, 1), (302, [float("nan")] * 64, 1), (303, [None] + [1.0] * 63, 1), (304, base[1].tolist(), None), (305, [1.0, 2.0], 1), (306, [2.0, 4.0], 1), (307, [], 1), (308, [float("inf")] * 64, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    x = {i: np.asarray(v, np.float32).astype(float) for i, v, g in rows if g is not None and v and None not in v and np.isfinite(v).all() and np.any(v)}
    lab = {i: g for i, _, g in rows}
    links = [(a, b) for a in x for b in x if a < b and lab[a] == lab[b] and len(x[a]) == len(x[b]) and x[a] @ x[b] / math.sqrt((x[a] @ x[a]) * (x[b] @ x[b])) >= 0.93]
    root = union_find(links, lab)
    n = {i: sum(i in k for k in links) for i in lab}
    got = {r["vec_id"]: tuple(r)[1:] for r in embedding_dedup.near_vectors(df.withColumnRenamed("label", "label")).collect()}
    assert got == {i: (n[i], root[i], root[i] == i) for i in lab}


def test_quality_and_toxicity(docs, labels):
    for run in (quality.quality, toxicity.toxicity):
        rows = run(docs, labels).collect()
        assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in rows)
        out = {r["doc_id"] for r in rows if r["held_out"]}
        import zlib

        assert out == {i for i in out | {r["doc_id"] for r in rows} if i is not None and zlib.crc32(str(i).encode()) % 5 == 0}


def test_grammar():
    m = toxicity.Model()
    plain, hit, negated, said = (m.score(t) for t in ("what a fine day", "you are an idiot", "you are not an idiot", "he was reported as saying idiot"))
    assert hit > 0.5 > m.score("the word idiot") > negated and said < 0.5 and plain < 0.5
    assert m.score("I will kill you") > 0.5 > m.score("I will kill the process") and m.score(None) == m.score("") == plain
    assert toxicity.events("you idiot. you idiot", m.lexicon)[1] == 2


def test_bradley_terry_ranks_and_cuts_at_the_quantile():
    r = np.random.default_rng(0)
    y = np.repeat([1, 0], [80, 20])
    x = np.abs(r.standard_normal((100, len(quality.FEATURES)))) * 0.1
    x[:, 1] += (y == 0) * 0.9
    m = quality.rank(x, y, {0: 20.0, 1: 80.0})
    s = m.score(x)
    assert (s[y == 1] >= 0.3).all() and (s[y == 0] < 0.3).all()


def test_language(spark, docs):
    rows = langid.identify(docs).collect()
    assert len(rows) == docs.count()
    got = {r["doc_id"]: r["lang_pred"] for r in rows if r["doc_id"] is not None}
    assert got[1] == got[2] == got[3] == "und" and got[20] in ("en", "de")
    one = {"en": "the house and the garden of the king", "de": "das haus und der garten des königs", "fr": "la maison et le jardin du roi", "es": "la casa y el jardín del rey"}
    train = [(i, t + " " + str(i), g, None) for i, (g, t) in enumerate(list(one.items()) * 30)]
    df = spark.createDataFrame(train, "doc_id long, text string, lang string, source string")
    assert all(r["lang_pred"] == g for r in langid.identify(df).collect() for g in [train[r["doc_id"]][2]])


def test_mixing_meets_its_marginals(spark):
    rows = [(i, "x" * 4 * (1 + i % 7), f"s{min(i % 10, 6)}", ["en", "de", "fr"][i % 3]) for i in range(20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    targets = {"lang": {"en": 0.2, "de": 0.5, "fr": 0.3}}
    got = mixing.mix(df, targets, rate=0.3).where("sampled").collect()
    total = sum(r["n_tokens"] for r in got)
    assert abs(total / sum(1 + i % 7 for i in range(20_000)) - 0.3) < 0.02
    for g, want in targets["lang"].items():
        assert abs(sum(r["n_tokens"] for r in got if r["lang"] == g) / total - want) < 0.02


def test_mixing_and_licences_on_odd_rows(docs):
    assert mixing.mix(docs).count() == docs.count()
    kept = mixing.mixed_rows(docs)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    got = by_id(licenses.licenses(docs))
    assert got[16]["license"] == "mit" and got[16]["dice"] == 1.0 and all(r["license"] is None for i, r in got.items() if i != 16)
    assert licenses.licenses(docs, {}).where("license is not null").count() == 0


def test_empty_tables(spark, docs, labels):
    none, no = docs.limit(0), labels.limit(0)
    for df in (exact_dedup.exact_groups(none), minmax_dedup.near_groups(none), suffix_dedup.remove_repeats(none), quality.quality(none, no), toxicity.toxicity(none, no), langid.identify(none), mixing.mix(none), licenses.licenses(none), bpe.encode_digests(none, vocabulary())):
        assert df.count() == 0
    assert embedding_dedup.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    assert {round(r["score"], 6) for r in quality.quality(docs, no).collect()} == {0.5}
    assert toxicity.toxicity(docs, no).where("doc_id = 16").first()["predicted"] == 1


def test_held_out(spark):
    import zlib

    got = {r[0]: r[1] for r in spark.range(100).select("id", held_out("id")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in range(100)}


@pytest.mark.parametrize("seed", range(3))
def test_repeats_against_brute_force_on_random_alphabets(spark, seed):
    r = np.random.default_rng(seed)
    pool = ["".join(r.choice(list("abé"), 70)) for _ in range(6)]
    texts = {i: "".join(pool[k][r.integers(0, 20) : r.integers(40, 70)] for k in r.integers(0, 6, r.integers(1, 6))) for i in range(40)}
    got = by_id(suffix_dedup.remove_repeats(spark.createDataFrame(list(texts.items()), "doc_id long, text string")))
    assert {i: tuple(x)[1:] for i, x in got.items()} == brute_repeats(texts)
