import corpus_pipeline as pipeline
from tidemark.llm import bpe, exact_dedup, minmax_dedup, mixing, toxicity
from tidemark.llm.queries import QUERIES, SQL, vocabulary

SF = "/root/testdata/sf0.001"


def test_queries_are_registered():
    import __spark_entry__ as entry

    assert QUERIES.keys() | {"pipeline"} <= entry.queries().keys() and SQL.keys() <= entry.oracle_sql().keys()
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14))


def test_stages_against_their_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}

    model = toxicity.fit(docs.select("doc_id", "text"), labels)
    alive = {i for i, r in rows.items() if model.score(r["text"]) < 0.5}
    first = pipeline.STAGES[0][1](spark, docs, SF)
    assert {r["doc_id"] for r in first.collect()} == alive and first.columns == docs.columns

    groups = {}
    for i in sorted(alive, key=lambda i: (-len(rows[i]["text"] or ""), i)):
        groups.setdefault(exact_dedup.normalise(rows[i]["text"]), i)
    second = pipeline.STAGES[1][1](spark, first, SF)
    assert {r["doc_id"] for r in second.collect()} == set(groups.values()) and second.columns == docs.columns

    sets = {i: set(minmax_dedup.shingles(rows[i]["text"]).tolist()) for i in groups.values()}
    root = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and (k := len(sets[a] & sets[b])) and 100 * k >= 75 * (len(sets[a]) + len(sets[b]) - k):
                x, y = root[a], root[b]
                root = {i: min(x, y) if c in (x, y) else c for i, c in root.items()}
    third = pipeline.STAGES[2][1](spark, second, SF)
    assert {r["doc_id"] for r in third.collect()} == {i for i, c in root.items() if i == c}

    kept = {r["doc_id"] for r in mixing.mix(third).where("sampled").collect()}
    fourth = pipeline.STAGES[3][1](spark, third, SF)
    assert {r["doc_id"] for r in fourth.collect()} == kept and fourth.columns == docs.columns

    c = bpe.codec(vocabulary())
    want = {(i, *c.digest(rows[i]["text"])) for i in kept}
    assert {tuple(r) for r in pipeline.STAGES[4][1](spark, fourth, SF).collect()} == want
    assert {tuple(r) for r in pipeline.run(spark, SF).collect()} == want
