import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
COMMON = "the of and to in a is that it for was on".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(COMMON) if rng.random() < 0.35 else "".join(rng.choice(["ba", "ke", "ro", "ti", "su", "lan", "mor"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def texts() -> list[tuple]:
    """Rows with null and empty texts, null columns, a very long text, ties, copies and near copies."""
    rng = random.Random(4)
    rows = [(i, prose(rng, rng.randint(8, 160)), "en", f"src{i % 3}", 1) for i in range(60)]
    base = prose(rng, 200).split()
    for i in range(60, 90):
        own = list(base)
        for _ in range(rng.randint(0, 6)):
            own[rng.randrange(len(own))] = "edit%d" % rng.randrange(99)
        rows.append((i, " ".join(own), "en", "src0", 1))
    rows += [(i, rows[5][1], "en", "src1", 1) for i in range(90, 96)]
    rows += [(96, None, None, None, None), (97, "", "en", "src0", 0), (98, " \n\t ", None, "src2", 3), (99, prose(rng, 12_000), "en", None, 1), (100, "<|endoftext|> a  b\n\n\nc d", "fr", "src0", 1), (101, "Один два три", "ru", "src9", 1)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, texts):
    return spark.createDataFrame(texts, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def clashing(docs):
    """The same rows with more columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    names = ["size", "key", "bucket", "target", "taken", "row", "id", "h", "n", "part", "slot", "shard", "found", "salt", "rep", "component", "rank", "start", "length", "label", "key2", "held_out"]
    return docs.select("*", *[F.lit("x").alias(n) for n in names])


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
