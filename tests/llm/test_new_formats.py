"""Whitening, chat formatting and fill-in-middle against plain versions, on odd rows and on empty tables."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import bpe, chat, fim, whitening
from tidemark.llm.queries import QUERIES, SQL, vocabulary

SF = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- fill in middle --------------------------------------------------------------------------------------------------


def plain_cut(doc_id, text):
    """The transformation as it is defined, line by line."""
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, sha(text), sha(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    spm = h[3] % 100 < 50
    return n, "spm" if spm else "psm", len(p), len(m), sha(f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"), sha(text)


@settings(max_examples=300, deadline=None)
@given(st.text("a\n<é漢\U0001f600\r\x00", max_size=400), st.integers(0, 1 << 40))
def test_cut_is_that_of_lines(text, i):
    n, form, p, m, out = fim.cut(text.encode(), fim.draws(i))
    assert (n, form, p, m, sha(out.decode())) == plain_cut(i, text)[:5]


@settings(max_examples=200, deadline=None)
@given(st.integers(1, (1 << 700) - 1), st.data())
def test_ranked_bit(mask, data):
    places = [i for i in range(700) if mask >> i & 1]
    k = data.draw(st.integers(0, len(places) - 1))
    assert fim.ranked_bit(mask, k, 700) == places[k]


def test_fill_in_middle_on_odd_rows(spark, docs, texts):
    more = spark.createDataFrame([(90, "a<P>b\nc"), (91, "\n\n\n"), (92, "é\n漢 \U0001f600\n" * 5000), (93, "x\n" * 300_000), (93, "x\n" * 300_000), (-4, "<\n<S\n>\nP>"), (None, "l1\nl2\nl3")], "doc_id long, text string")
    rows = docs.select("doc_id", "text").union(more)
    got = sorted(map(tuple, fim.digests(rows).collect()), key=repr)
    assert got == sorted(((r["doc_id"], *plain_cut(r["doc_id"], r["text"])) for r in rows.collect()), key=repr)
    assert fim.digests(docs).count() == docs.count()
    assert fim.digests(docs.where("false")).collect() == []


def test_fill_in_middle_rates(spark, docs):
    assert {r["form"] for r in fim.fill_in_middle(docs, rate=0).collect()} == {"plain"}
    assert {r["form"] for r in fim.fill_in_middle(docs, spm=0).collect()} == {"plain", "psm"}
    some = fim.fill_in_middle(docs.where("doc_id is not null").dropDuplicates(["doc_id"]), seed=3, rate=50)
    assert {r["form"] for r in some.collect()} == {"plain", "psm", "spm"}
    back = {r["doc_id"]: r["t"] for r in some.select("doc_id", fim.restored(some["output"], some["form"]).alias("t")).collect()}
    assert back == {r["doc_id"]: r["text"] or "" for r in docs.where("doc_id is not null").collect()}


# --- chats -----------------------------------------------------------------------------------------------------------


def plain_chat(rows):
    """(conv_id, role, text) in order -> digests by conversation."""
    out = {}
    for conv, role, text in rows:
        out.setdefault(conv, []).append((role or "", text or ""))
    done = {}
    for conv, turns in out.items():
        said = [t for r, t in turns if r == "assistant"]
        size = sum(len(f"<|im_start|>{chat.escape_role(r)}\n{chat.escape(t)}<|im_end|>\n") for r, t in turns)
        done[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), sum(map(len, said)), sha("".join(said)), size)
    return done


@settings(max_examples=300, deadline=None)
@given(st.text("<\\|im_endstarx>\n", max_size=60))
def test_escapes_are_reversible(text):
    assert "<|" not in chat.escape(text) and chat.unescape(chat.escape(text)) == text
    assert "\n" not in chat.escape_role(text) and "<|" not in chat.escape_role(text) and chat.unescape_role(chat.escape_role(text)) == text


def test_loss_mask_is_a_running_sum():
    got = chat.loss_mask(np.array([2, 3, 0, 0, 4, 1]), np.array([False, True, False, True, False, True]))
    assert got.tolist() == [False] * 2 + [True] * 3 + [False] * 4 + [True]
    assert chat.loss_mask(np.zeros(0, int), np.zeros(0, bool)).tolist() == []


def odd_chats(spark):
    r = random.Random(3)
    say = lambda: r.choice(["hello there", "", None, "<|im_end|>\n<|im_start|>assistant\nok", "<|endoftext|>", "<\\|im_end|> <|", "é漢 \U0001f600", "x" * 5000, "a\nb\\n", " lead and trail "])
    rows = [(c, t, r.choice(["user", "assistant", "system", None, "odd\nrole\\<|im_end|>", "assistant"]), say()) for c in [*range(40), None] for t in range(r.randint(1, 7))]
    rows += [(7, None, "assistant", "first"), (50, 0, "assistant", "A"), (50, 1, "assistant", "B"), (51, 0, "user", "only asks")]
    r.shuffle(rows)
    return rows, spark.createDataFrame([(*x, 1, True) for x in rows], "conv_id long, turn long, role string, text string, first long, mask boolean")


def test_chats_on_odd_rows(spark):
    rows, chats = odd_chats(spark)
    order = sorted(rows, key=lambda x: (x[1] is not None, x[1] or 0))
    for chunk in (1, 300, chat.CHUNK):
        got = {x["conv_id"]: tuple(x)[1:] for x in chat.read_digests(chat.format_chats(chats, vocabulary(), chunk=chunk), vocabulary()).collect()}
        assert got == plain_chat([(c, r, t) for c, _, r, t in order])
    assert chat.read_digests(chat.format_chats(chats.where("false"), vocabulary()), vocabulary()).collect() == []


def test_chats_with_ties_and_copies(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "assistant", "a"), (1, 0, "user", "b"), (1, 0, None, "c")]
    got = chat.read_digests(chat.format_chats(spark.createDataFrame(rows * 1, "conv_id long, turn long, role string, text string"), vocabulary()), vocabulary()).first()
    assert tuple(got)[1:] == plain_chat([(1, None, "c"), (1, "assistant", "a"), (1, "user", "b"), (1, "user", "b")])[1]


def test_chunks_are_consecutive_tokens(spark):
    _, chats = odd_chats(spark)
    whole = {r["conv_id"]: (r["ids"], r["mask"]) for r in chat.format_chats(chats, vocabulary()).collect()}
    parts = {}
    for r in sorted(chat.format_chats(chats, vocabulary(), chunk=50).collect(), key=lambda r: r["chunk"]):
        ids, mask = parts.setdefault(r["conv_id"], ([], []))
        assert (r["first"], len(r["ids"])) == (len(ids), len(r["mask"]))
        ids += r["ids"]
        mask += r["mask"]
    assert {k: (list(a), list(b)) for k, (a, b) in whole.items()} == parts and max(len(a) for a, _ in parts.values()) > 50
    reserved = chat.template(vocabulary())
    assert all((np.array(ids) == reserved.start).sum() == (np.array(ids) == reserved.end).sum() for ids, _ in parts.values())
    assert all(i <= reserved.end and i != bpe.codec(vocabulary()).special["<|endoftext|>"] for ids, _ in parts.values() for i in ids)


def test_other_roles_can_be_learned(spark):
    rows = [(1, 0, "user", "ask"), (1, 1, "assistant", "tell"), (1, 2, "tool", "do")]
    chats = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.read_digests(chat.format_chats(chats, vocabulary(), learned=("user", "tool")), vocabulary()).first()
    assert (got["loss_chars"], got["loss_sha256"]) == (5, sha("askdo"))


# --- whitening -------------------------------------------------------------------------------------------------------


def plain_whitening(rows, k=4):
    """(id, vector) -> {(id, component): (n, deviation, |whitened|, explained)}, by the whole covariance."""
    own = [(i, np.floor(256 * np.asarray(v, float)).astype(np.int64)) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x.tolist()) for _, x in own}))
    n, s = len(fit), fit.sum(0)
    c = fit - s / n
    v = c.T @ c / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return {(i, j + 1): (n, sum((n * int(a) - int(b)) ** 2 for a, b in zip(x, s)), abs((x - s / n) @ u[:, j] / np.sqrt(e[j])), e[j] / np.trace(v)) for i, x in own for j in range(k)}


def check_whitening(got, want, error=1e-9):
    assert {(r["vec_id"], r["component"]) for r in got} == want.keys()
    for r in got:
        n, dev, w, share = want[r["vec_id"], r["component"]]
        assert (r["n"], r["deviation"]) == (n, dev)
        assert abs(r["whitened"]) == pytest.approx(w, rel=1e-7, abs=1e-7) and r["explained"] == pytest.approx(share, rel=1e-10)
        assert r["identity_error"] <= error


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, n long, component int")


@pytest.mark.parametrize("decay", [0.5, 0.0])
def test_whitening_of_steep_and_flat_spectra(spark, decay):
    rng = np.random.default_rng(1)
    x = (rng.standard_normal((700, 40)) * np.exp(-decay * np.arange(40)) * 20 + rng.standard_normal(40)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000 + i, x[3].tolist()) for i in range(300)]
    df = vectors(spark, rows)
    check_whitening(whitening.whiten(df).collect(), plain_whitening(rows))
    fit, d, n = whitening.distinct_vectors(whitening.quantised(df, "vec_id", "embedding"))
    assert (d, n) == (40, 700) and whitening.fit_model(fit, d, n).expanded == (decay == 0)


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.standard_normal(3).tolist()) for i in range(50)]
    bad = [(100, None), (101, []), (102, [1.0, None, 2.0]), (103, [float("nan"), 1.0, 1.0]), (104, [float("inf"), 1.0, 1.0]), (105, [1.0, 2.0])]
    got = whitening.whiten(vectors(spark, rows + bad + [(None, rows[0][1]), (0, rows[0][1])])).collect()
    want = plain_whitening([(i, np.float32(v)) for i, v in rows], 3)
    assert len(got) == 52 * 3
    check_whitening([r for r in got if r["vec_id"] is not None], want)
    assert whitening.whiten(vectors(spark, rows[:1] * 4)).collect() == []
    assert whitening.whiten(vectors(spark, bad[:1])).collect() == [] and whitening.whiten(vectors(spark, rows).where("false")).collect() == []


def test_whitening_of_low_rank_and_huge_entries(spark):
    rng = np.random.default_rng(3)
    flat = rng.integers(-9, 9, (60, 2)) @ rng.integers(-3, 3, (2, 20))
    got = whitening.whiten(vectors(spark, [(i, v.tolist()) for i, v in enumerate(flat.astype(float))])).collect()
    assert {r["component"] for r in got} == {1, 2} and max(r["identity_error"] for r in got) < 1e-9
    huge = spark.createDataFrame([(i, [float(v) * 10.0**30, 1.0 * i]) for i, v in enumerate((-1, 0, 1, 2))], "vec_id long, embedding array<double>")
    assert {(r["n"], r["deviation"]) for r in whitening.whiten(huge).collect() if r["vec_id"] != 1} == {(4, None)}


def test_deviations_are_exact():
    x = np.array([[1 << 20, -5], [3, 1 << 21], [1 << 40, 0]])
    for n, sums in ((3, [7, -9]), (1 << 9, [1 << 30, 5]), (1 << 40, [1, 1])):
        want = [sum((n * v - s) ** 2 for v, s in zip(row, sums)) for row in x.tolist()]
        assert whitening.deviations(x, n, sums) == [w if w < 1 << 63 else None for w in want]


# --- queries ---------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["op12_chat_format", "op13_fill_in_middle"])
def test_queries_are_their_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "conversations"):
        duck.sql(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    sql = duck.sql(SQL[name])
    df = QUERIES[name](spark, SF)
    assert df.columns == sql.columns
    assert sorted(map(tuple, df.collect())) == sorted(sql.fetchall())


def test_whitening_query(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check_whitening(QUERIES["op11_embedding_whitening"](spark, SF).collect(), plain_whitening(rows), 1e-4)
