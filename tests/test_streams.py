"""Stream semantics against plain loops: the two-level windows, scoring, schedules, stores and streaming processors."""

import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from pyspark import cloudpickle

from tidemark.config import Range, Rule, parse
from tidemark.functions import draws, imaging, keys
from tidemark.models.head import Head
from tidemark.operators import neighbours, ordered, replay, schedule, scoring
from tidemark.sources import store
from tidemark.streaming import processors


@pytest.fixture(scope="module")
def stream(spark):
    r = random.Random(1)
    own = [(i, r.choice("aabbbcd") + str(r.randint(0, i // 40))) for i in range(400)]
    return own, spark.createDataFrame(own, "idx long, label string")


def loop(own):
    seen, counts, last, out = [], Counter(), None, []
    for i, y in own:
        pred = counts.most_common(1)[0][0] if counts else None
        new = y not in counts
        counts[y] += 1
        out.append((i, y, pred, last, new, len(counts)))
        last = y
    return out


TREES = [ordered.Tree(7, 2, 6), ordered.Tree(16, 4, 3), ordered.Tree(16, 16, 2), ordered.Tree(64, 7, 1), ordered.Tree()]


@pytest.mark.parametrize("tree", TREES)
def test_prefix_quantities_do_not_depend_on_the_tree(stream, tree):
    own, df = stream
    want = loop(own)
    assert sorted(tuple(r) for r in ordered.novelty(df, tree).collect()) == [(i, y, n, k) for i, y, _, _, n, k in want]
    assert sorted(tuple(r) for r in ordered.majority(df, tree).collect()) == [(i, y, p) for i, y, p, *_ in want]
    assert sorted(tuple(r) for r in ordered.latest(df, "label", "pred", tree=tree).select("idx", "label", "pred").collect()) == [(i, y, p) for i, y, _, p, *_ in want]


@pytest.mark.parametrize("tree", TREES)
def test_any_associative_fold_is_carried(spark, tree):
    r = random.Random(4)
    own = [(3 * i, r.choice("ab"), r.randint(-50, 50)) for i in range(110)]
    df = spark.createDataFrame(own, "idx long, k string, v long")
    smaller = lambda a, b: ordered.F.least(a, b)
    got = ordered.carried(df, df.v, ordered.F.min, smaller, "low", keys=("k",), tree=tree)
    got = {x["idx"]: x["low"] for x in ordered.carried(got, got.v, ordered.F.min, smaller, "all", exclusive=True, tree=tree).collect()}
    assert got == {i: min(v for j, q, v in own if q == k and j <= i) for i, k, _ in own}


def test_keys_that_a_tree_cannot_hold_are_errors(spark):
    for i in (-1, 32):
        with pytest.raises(Exception, match="rank the rows first"):
            ordered.novelty(spark.createDataFrame([(i, "a")], "idx long, label string"), ordered.Tree(4, 8, 1)).collect()


def test_no_window_runs_over_a_whole_stream(spark):
    from tidemark.plans.catalog import PLANS

    for name in ("stream_index", "novelty_flags", "pred_majority", "pred_last_seen", "rolling_accuracy", "running_scaler", "running_scale", "replay_held", "replay_members"):
        plan = PLANS[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        for line in plan.splitlines():
            if "Window [" in line:
                assert not line.rstrip().endswith("[]") and "], [], [" not in line and "windowspecdefinition(specifiedwindowframe" not in line, (name, line)
                inner = line.rsplit("], [", 2)
                assert len(inner) == 3 and inner[1].strip(), (name, line)


def test_rolling_mean_crosses_blocks(spark):
    df = spark.range(100).selectExpr("id as idx", "cast(id * id % 7 as double) as v")
    got = {r["idx"]: r["m"] for r in ordered.rolling_mean(df, df.v, 5, "m", size=8).collect()}
    v = [i * i % 7 for i in range(100)]
    assert all(abs(got[i] - np.mean(v[max(0, i - 4) : i + 1])) < 1e-12 for i in range(100)) and len(got) == 100


def test_ranks_have_no_gaps(spark):
    df = spark.createDataFrame([(k,) for k in random.Random(2).sample(range(100_000), 300)], "event_id long")
    got = sorted((r["event_id"], r["idx"]) for r in ordered.ranked(df, "event_id").collect())
    assert [i for _, i in got] == list(range(300))
    assert ordered.ranked(df.where("false"), "event_id").collect() == []


def skewed():
    """Half of the keys lie in a millionth of the range; one is null."""
    r = random.Random(3)
    return r.sample(range(10**15, 10**15 + 10**6), 3000) + r.sample(range(10**15, 10**15 + 10**12), 3000)


@pytest.mark.parametrize("deep", [False, True])
def test_blocks_are_of_equal_depth_on_clustered_keys(spark, monkeypatch, deep):
    if deep:
        monkeypatch.setattr(ordered, "PARTS", 8)  # two sketches: 8 blocks of 8
    keys = skewed()
    df = spark.createDataFrame([(t,) for t in keys], "t long")
    sizes = [r["n"] for r in ordered.dealt(df, "t", 100, deep=deep).groupBy("__b").agg(ordered.F.count("t").alias("n")).collect()]
    blocks = 64 if deep else 60
    assert sum(sizes) == 6000 and max(sizes) <= 2 * 6000 / blocks and len(sizes) >= blocks / 2
    far = ordered.ranked(df, "t", size=100, deep=deep)
    assert [(r["t"], r["idx"]) for r in far.orderBy("t").collect()] == list(zip(sorted(keys), range(6000)))


def test_abstentions_are_columns_only(spark):
    preds = spark.createDataFrame([(0, "a", None), (1, "a", "a"), (2, "b", "zz"), (3, "b", "b")], "idx long, label string, pred string")
    m = scoring.confusion(preds)
    classes = {r["label"]: r for r in scoring.by_class(m).collect()}
    assert set(classes) == {"a", "b"} and classes["a"]["recall"] == 0.5 and classes["b"]["precision"] == 1.0
    one = scoring.overall(m).first()
    assert (one["n"], one["accuracy"], one["chance"]) == (4, 0.5, 0.5)


@pytest.fixture(scope="module")
def faces(spark):
    return spark.createDataFrame([(f"fam{i % 3}:style{i}",) for i in range(6)], "face_id string")


def test_rule_precedence(faces):
    rules = {"fam0:*": Rule(weight=3.0), "fam0:style0*": Rule(weight=5.0), "fam0:style0": Rule(weight=7.0), "*:style1": Rule(weight=2.0), "none": Rule()}
    got = {r["face_id"]: (r["weight"], r["pattern"]) for r in schedule.resolve(faces, rules).collect()}
    assert got["fam0:style0"] == (7.0, "fam0:style0") and got["fam0:style3"] == (3.0, "fam0:*") and got["fam1:style1"] == (2.0, "*:style1") and got["fam2:style2"] == (1.0, None)
    assert [r[0] for r in schedule.unmatched(faces, rules).collect()] == ["none"]


def test_index_of_globs_finds_what_trying_all_finds(spark, monkeypatch):
    """Many rules, with wildcards anywhere, brackets, quotes and backslashes, and faces that are spelt like a glob."""
    r = random.Random(11)
    letters = "ab:-"
    word = lambda n: "".join(r.choice(letters) for _ in range(n))
    globs = {word(r.randint(0, 3)) + r.choice(["*", "?", "[ab]", "[!a]", "*" + word(2) + "?", ""]) + word(r.randint(0, 3)): Rule(weight=float(i), start=i % 3) for i in range(120)}
    globs |= {"abcdefghij*klmnopqrstu": Rule(weight=1.5), "it's\\odd*": Rule(weight=2.5), "a[b": Rule(weight=3.5), "[ab]": Rule(weight=4.5), "no*such*thing": Rule()}
    faces = spark.createDataFrame([(f,) for f in {word(r.randint(0, 7)) for _ in range(400)} | {"abcdefghijXklmnopqrstu", "abcdefghiXklmnopqrstu", "it's\\odd one", "a[b", "[ab]", "a"}], "face_id string")
    asked = lambda: ({tuple(x) for x in schedule.resolve(faces, globs).collect()}, {x[0] for x in schedule.unmatched(faces, globs).collect()})
    indexed = asked()
    monkeypatch.setattr(schedule, "INLINE", 1000)
    assert indexed == asked() and "no*such*thing" in indexed[1]
    got = {f: p for f, *_, p in indexed[0]}
    for f in got:
        hit = [p for p in globs if p == f or re.fullmatch(keys.glob_regex(p), f, re.S)]
        assert got[f] == (max(hit, key=lambda p: (p == f, len(p), -list(globs).index(p))) if hit else None), f


def test_draws_follow_the_schedule(faces):
    own = schedule.resolve(faces, {"fam0:style0": Rule(weight=6.0), "fam1:*": Rule(start=1000), "fam2:style2": Rule(weight=0.0), "fam2:style5": Rule(stop=800)})
    got = schedule.draw(own, 4000, seed=3).collect()
    assert sorted(r["idx"] for r in got) == list(range(4000))
    assert all(r["idx"] >= 1000 for r in got if r["label"].startswith("fam1")) and all(r["idx"] < 800 for r in got if r["label"] == "fam2:style5")
    late = Counter(r["label"] for r in got if r["idx"] >= 1000)
    assert "fam2:style2" not in late and abs(late["fam0:style0"] / 3000 - 6 / 9) < 0.05
    assert got == schedule.draw(own, 4000, seed=3).collect()
    with pytest.raises(schedule.ScheduleError):
        schedule.check(schedule.resolve(faces, {"*": Rule(start=10, stop=20)}), 30)


def test_globs_cover_slashes_and_sets():
    import re

    for glob, yes, no in (("a*:b?", "a/x:bc", "a:b"), ("x[!0-4]", "x7", "x3"), ("x[ab]", "xa", "xc"), ("a.b", "a.b", "axb")):
        assert re.search(keys.glob_regex(glob), yes) and not re.search(keys.glob_regex(glob), no)


def test_keys(spark):
    df = spark.createDataFrame([("Acme Grötesk",), ("--",), (None,)], "t string")
    assert [r[0] for r in df.select(keys.slug("t")).collect()] == ["acme-grotesk", "unknown", "unknown"]
    assert keys.charset("a b a\tc") == "abc"


def test_configuration_is_closed():
    assert parse({"seed": 3, "arrival": {"fonts": {"a": {"weight": 2}}}}).arrival.fonts["a"].weight == 2
    for bad in ({"sead": 1}, {"arrival": {"fonts": {"a": {"start": 5, "stop": 5}}}}, {"fonts": {"dir": "x"}}):
        with pytest.raises(ValueError):
            parse(bad)
    assert Range.of("1:3") == Range.of([1, 3]) and Range.of(2) == Range(2, 2)
    with pytest.raises(ValueError):
        draws.weighted(None, {"a": 0.0})


def test_neighbours_against_a_loop(spark):
    r = np.random.default_rng(0)
    x = r.standard_normal((60, 4)).astype(np.float32)
    df = spark.createDataFrame([(i, "l", v.tolist()) for i, v in enumerate(x)], "idx long, label string, features array<float>")
    got = sorted((q["idx"], q["other"]) for q in neighbours.neighbours(df, 3, 10).collect())
    want = []
    for i in range(1, 60):
        z = []
        for j in range(i + 1):
            sd = x[:j].astype(float).std(0) if j else np.zeros(4)
            z.append(np.divide(x[j] - (x[:j].astype(float).mean(0) if j else 0), sd, out=np.zeros(4), where=sd > 0))
        d = [(round(float(np.linalg.norm(z[j] - z[i])), 6), -j) for j in range(max(0, i - 10), i)]
        want += [(i, -j) for _, j in sorted(d)[:3]]
    assert got == sorted(want)


def test_head_learns_a_separable_stream():
    r = np.random.default_rng(1)
    head, centres, hits = Head(8), r.standard_normal((3, 8)) * 2, []
    for i in range(400):
        c = int(r.integers(3))
        x = centres[c] + 0.3 * r.standard_normal(8)
        hits.append(head.predict(x) == str(c))
        head.learn(x, str(c))
    assert np.mean(hits[200:]) > 0.9


class PlainHead:
    """The replay head step by step, as formulas have it: lists of rows, a new array for every term."""

    def __init__(self, dims):
        self.rng = np.random.default_rng(0)
        self.w = [self.rng.uniform(-(dims**-0.5), dims**-0.5, (dims, 512)), self.rng.uniform(-(dims**-0.5), dims**-0.5, 512), np.zeros((512, 0)), np.zeros(0)]
        self.n, self.mean, self.squares, self.labels, self.kept = 0, np.zeros(dims), np.zeros(dims), [], {}

    def scaled(self, x):
        return (x - self.mean) / (max(1e-6, float(np.sqrt(self.squares / (self.n - 1)).mean())) if self.n > 1 else 1.0)

    def predict(self, x):
        return self.labels[int((np.maximum(self.scaled(x) @ self.w[0] + self.w[1], 0) @ self.w[2] + self.w[3]).argmax())] if self.labels else None

    def learn(self, x, label):
        if label not in self.kept:
            self.labels.append(label)
            self.w[2], self.w[3] = np.hstack([self.w[2], np.zeros((512, 1))]), np.append(self.w[3], 0.0)
            self.m, self.v, self.t = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], 0
        self.kept[label] = [*self.kept.get(label, []), x][-400:]
        self.n, gap = self.n + 1, x - self.mean
        self.mean = self.mean + gap / self.n
        self.squares = self.squares + gap * (x - self.mean)
        picks = self.rng.integers(0, len(self.labels), 32)
        others = [self.kept[self.labels[c]] for c in picks[1:]]
        xs = self.scaled(np.array([x] + [rows[self.rng.integers(len(rows))] for rows in others]))
        h = np.maximum(xs @ self.w[0] + self.w[1], 0)
        z = h @ self.w[2] + self.w[3]
        p = np.exp(z - z.max(1, keepdims=True)) / np.exp(z - z.max(1, keepdims=True)).sum(1, keepdims=True)
        p[np.arange(32), [self.labels.index(label), *picks[1:]]] -= 1
        back = (p / 32 @ self.w[2].T) * (h > 0)
        self.t += 1
        for w, m, v, g in zip(self.w, self.m, self.v, (xs.T @ back, back.sum(0), h.T @ (p / 32), (p / 32).sum(0))):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w -= 0.001 * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)


def test_head_equals_the_plain_form_bit_by_bit():
    r = np.random.default_rng(2)
    head, plain, rows, want = Head(12), PlainHead(12), [], []
    for i in range(1100):  # one label comes late, one is rare, one has more rows than are remembered
        label = None if i == 700 else str(int(r.choice(3, p=(0.6, 0.39, 0.01)))) if i < 900 else str(int(r.integers(5)))
        x = r.standard_normal(12) + len(label or "") * i % 3
        answer = plain.predict(x)
        assert head.predict(x) == answer
        head.learn(x, label)
        plain.learn(x, label)
        if i in (50, 800):
            head = cloudpickle.loads(cloudpickle.dumps(head))
        rows.append((x, label))
        want.append(answer)
    blocks, cuts = Head(12), [0, 1, 2, 37, 399, 400, 777, 1100]
    got = [y for a, b in zip(cuts, cuts[1:]) for y in blocks.run(np.array([x for x, _ in rows[a:b]]), [y for _, y in rows[a:b]])]
    assert got == want and all(np.array_equal(a, b) for a, b in zip(blocks.parts(blocks.flat), plain.w))
    assert len(plain.kept["0"]) == 400 and all(np.array_equal(a, b) for a, b in zip(head.parts(head.flat), plain.w))
    with pytest.raises(ValueError):
        head.learn(x[:1], "0")


def test_head_over_full_memories_equals_the_plain_form():
    r = np.random.default_rng(4)
    head, plain, xs = Head(6), PlainHead(6), r.standard_normal((1600, 6))
    labels = [str(i % 3 if i % 7 else 0) for i in range(1600)]
    calls, draw = [], head._draws
    head._draws = lambda seen: calls.append(len(seen)) or draw(seen)
    want = []
    for x, y in zip(xs, labels):
        want.append(plain.predict(x))
        plain.learn(x, y)
    assert head.run(xs, labels) == want and all(np.array_equal(a, b) for a, b in zip(head.parts(head.flat), plain.w))
    assert all(len(k) == 400 for k in plain.kept.values()) and head.used == 32 + 3 * 400
    assert max(calls) == 32 and len(calls) < 60  # batches are made for many rows at once


def test_a_step_of_the_head_makes_no_copies_of_its_weights():
    r, head = np.random.default_rng(3), Head(64)
    for i in range(40):
        head.learn(r.standard_normal(64), str(i % 4))
    x = r.standard_normal(64)
    tracemalloc.start()
    head.learn(x, "0")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < head.flat.nbytes  # several times that before


def test_store_is_readable_only_when_finished(spark, tmp_path):
    items = spark.range(25).selectExpr("id as idx", "cast(id % 4 as string) as label", "if(id = 7, 'no ink', null) as error")
    path = f"file://{tmp_path}/s"
    with pytest.raises(store.StreamNotFound):
        store.read_stream(spark, path)
    assert store.write_stream(items, path, shard=10)["n_items"] == 24
    assert [r["idx"] for r in store.read_stream(spark, path, 8).collect()] == [0, 1, 2, 3, 4, 5, 6, 8]
    store.write_annotations(items, f"{path}/notes")
    assert {r["image"] for r in store.read_annotations(spark, f"{path}/notes").collect()} >= {"crops/00000/00000003.png"}


def test_streaming_equals_batch(spark, tmp_path):
    own = [(i, random.Random(i).choice("abc")) for i in range(60)]
    for part in range(3):
        spark.createDataFrame([("s", *r) for r in own[part * 20 : part * 20 + 20]], "stream_id string, idx long, label string").coalesce(1).write.parquet(f"{tmp_path}/in/{part}")
    live_by = lambda n: spark.readStream.schema("stream_id string, idx long, label string").option("recursiveFileLookup", True).option("maxFilesPerTrigger", n).parquet(f"file://{tmp_path}/in")
    batch = spark.createDataFrame(own, "idx long, label string")
    live = live_by(1)
    common = processors.run_steps(spark, live, processors.majority, f"file://{tmp_path}/m")
    assert sorted(map(tuple, common.collect())) == sorted(map(tuple, ordered.majority(batch).collect()))
    seen = processors.run_steps(spark, live, processors.last_seen, f"file://{tmp_path}/a")
    assert sorted(map(tuple, seen.collect())) == sorted(map(tuple, ordered.latest(batch, "label", "pred").select("idx", "label", "pred").collect()))
    new = processors.run_steps(spark, live, processors.novelty, f"file://{tmp_path}/b")
    assert sorted(map(tuple, new.collect())) == sorted((r["idx"], r["label"], r["n_seen"]) for r in ordered.novelty(batch).where("first_seen").collect())


def test_rolling_accuracy_goes_on_after_a_restart(spark, tmp_path):
    """Three runs over one checkpoint, each with the files that came since; ids have gaps, batches are smaller and larger than the window."""
    r = random.Random(5)
    ids = sorted(r.sample(range(10_000), 150))
    own = [("s", i, r.choice("ab"), r.choice(["a", "b", None])) for i in ids]
    schema = "stream_id string, idx long, label string, pred string"
    for part, (lo, hi) in enumerate(((0, 8), (8, 120), (120, 150))):
        spark.createDataFrame(own[lo:hi], schema).repartition(2).write.parquet(f"{tmp_path}/in/{part}")
        live = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"file://{tmp_path}/in")
        got = processors.run_steps(spark, live, lambda b, k: processors.rolling_accuracy(b, k, 20), f"file://{tmp_path}/out")
    hits = [float(a == b) for _, _, a, b in own]
    want = {i: np.mean(hits[max(0, k - 19) : k + 1]) for k, i in enumerate(ids)}
    rows = got.collect()
    assert len(rows) == 150 and {x["idx"]: x["accuracy"] for x in rows} == pytest.approx(want)


@pytest.mark.parametrize("cap", [1, 5, 400])
def test_replay_membership_at_every_item(spark, cap):
    """One label has most rows, one has a single row, some rows have none."""
    r = random.Random(9)
    own = [(2 * i, "rare" if i == 40 else r.choice(["a", "a", "a", "b", None])) for i in range(150)]
    df = spark.createDataFrame(own, "idx long, label string")
    buffers, want, seen = {}, {}, set()
    for i, y in own:
        if y:
            mine = buffers.get(y, [])
            want[i] = (y, len(mine), mine[0] if mine else None, sum(map(len, buffers.values())))
        seen |= {(i, k, j) for k, v in buffers.items() for j in v}
        if y:
            buffers[y] = [*buffers.get(y, []), i][-cap:]
    tree = ordered.Tree(16, 8, 2)
    assert {x["idx"]: tuple(x)[1:] for x in replay.held(df, cap, tree).collect()} == want
    got = [tuple(x) for x in replay.members_at(df, replay.memberships(df, cap, tree), bucket=16).collect()]
    assert len(got) == len(seen) and set(got) == seen
    few = df.where("idx % 20 = 0")
    assert {tuple(x) for x in replay.members_at(few, replay.memberships(df, cap, tree)).collect()} == {x for x in seen if x[0] % 20 == 0}
    assert replay.held(df.where("false"), cap).collect() == replay.members_at(few.where("false"), replay.memberships(df, cap, tree)).collect() == []
