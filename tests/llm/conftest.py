import random

import pytest

WORDS = "the of and river stone light harbor winter copper engine garden letter mirror number orange pepper quartz ribbon silver timber".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("aeioubcdlmnrst") for _ in range(rng.randint(2, 9))) if rng.random() < 0.7 else rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text, lang, source) rows with copies, near copies, shared passages, ties, repeated rows and nulls."""
    rows = [(i, prose(i, 40 + 13 * i), "en", f"s{i % 3}") for i in range(30)]
    passage = prose(1000, 90)
    rows += [(100 + i, f"{prose(200 + i, 30)} {passage} {prose(300 + i, 20)}", "fr", "s1") for i in range(12)]
    rows += [(200 + i, rows[5 + i][1], "en", "s2") for i in range(6)]
    words = rows[20][1].split()
    for i in range(6):
        changed = list(words)
        changed[10 + 40 * i] = "changed"
        rows.append((300 + i, " ".join(changed), "en", "s0"))
    rows += [(400, None, "en", None), (401, "", None, "s1"), (402, " \n\t ", "de", "s1"), (403, "a", "de", "s1"), (404, "two words", "de", "s2"), (405, "***, 12", None, None)]
    rows += [(None, rows[3][1], "en", "s0"), (None, "no id and nothing in common with others here", None, None)]
    rows += [rows[7], rows[7], (8, rows[9][1], "en", "s1")]
    rows += [(500, "ab " * 3000, "en", "s0"), (501, "é" * 400 + " naïve café " * 30 + "\x00\x01 end", "fr", "s1"), (502, prose(77, 30_000), "en", "s1")]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, "doc_id long, text string, lang string, source string").repartition(3)


@pytest.fixture(scope="session")
def clashing(docs):
    """The same rows with extra columns that are named like outputs and inner columns."""
    from pyspark.sql import functions as F

    return docs.withColumns({n: F.lit("x") for n in ("h", "k", "kind", "span", "spans", "score", "n_bytes", "b", "part", "fp", "component_id", "item_id", "n", "base", "ids", "u", "v", "s")})


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
