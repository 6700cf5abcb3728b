import random

import pytest

#: Further columns, with names that operators use inside.
EXTRA = "n long, kept boolean, score double, g long, h1 long, own string, draw double, label int"


@pytest.fixture(scope="session")
def texts():
    """doc_id -> text: empty, null, very long, copies, near copies, shared passages, ties."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrst") for _ in range(r.randint(2, 8)))
    base = " ".join(word() for _ in range(120))
    passage = "This passage of more than fifty bytes is found in several documents, word for word."
    near = base.split()
    near[60] = "changed"
    out = {
        1: None, 2: "", 3: " \t\n ", 4: "one two", 5: "One  TWO", 6: base, 7: base.replace(" ", "\n"), 8: " ".join(near), 9: base + " ", 10: base,
        11: passage + " " + " ".join(word() for _ in range(30)), 12: " ".join(word() for _ in range(30)) + passage, 13: "éß漢 " + passage, 14: "x" * 300_000, 15: "ab " * 40_000,
        16: "Released under the MIT License.\nyou are an idiot!", 17: "She is not an idiot. He said \"idiot\".", 18: "a,b<|endoftext|>c͸  d\r\n", 19: "x" * 300_000,
    }
    return out | {i: " ".join(word() for _ in range(r.randint(1, 60))) for i in range(20, 60)}


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, "en" if i and i % 2 else None, None if i == 7 else "src") for i, t in texts.items()] + [(6, texts[6], "en", "src"), (None, "no id", "de", "s2"), (None, None, None, None)]
    return spark.createDataFrame([(*x, 0, True, 0.5, 1, 2, "o", 0.1, 1) for x in rows], "doc_id long, text string, lang string, source string, " + EXTRA)


@pytest.fixture(scope="session")
def labels(spark, texts):
    return spark.createDataFrame([(i, int(i != 14), int(i in (16, 17))) for i in texts] + [(None, 1, 0), (20, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module", autouse=True)
def compiled(spark):
    """Whole texts are long: plans are compiled, as they are outside of tests."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.codegen.wholeStage", "spark.sql.codegen.factoryMode")}
    spark.conf.set("spark.sql.codegen.wholeStage", "true")
    spark.conf.set("spark.sql.codegen.factoryMode", "FALLBACK")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)
