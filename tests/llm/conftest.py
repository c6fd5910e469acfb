import random

import pytest
from llm_samples import mutate, prose
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def rng():
    return random.Random(7)


@pytest.fixture(scope="session")
def corpus_rows():
    """Documents with exact and near copies, shared passages, nulls, empty and very long texts, ties."""
    rng = random.Random(11)
    base = [prose(rng, rng.randrange(3, 220)) for _ in range(60)]
    passage = prose(rng, 70)
    texts = list(base)
    texts += [base[i] for i in (0, 1, 1, 2, 2, 2)]
    texts += [mutate(rng, base[i % 20], 0.02) for i in range(40)] + [mutate(rng, base[5], 0.03) for _ in range(25)]
    texts += [f"{prose(rng, 30)} {passage} {prose(rng, 20)}" for _ in range(15)]
    texts += [None, None, "", "   \n\t", "one", "one", "ONE", "two words", "a b c d e", "A b c d e", prose(rng, 6000), ("same line again\n" * 400)]
    texts += ["é ü 字 " * 30, "\x1f\u00a0\u2003 odd  spaces\x0b\x0chere"]
    rng.shuffle(texts)
    return [(i, t) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def docs(spark, corpus_rows):
    """With extra columns whose names clash with those that operators use."""
    rows = spark.createDataFrame([(i, t, f"s{i % 4}" if i % 9 else None, "en", len(t or "")) for i, t in corpus_rows], "doc_id long, text string, source string, lang string, n_chars long")
    return rows.withColumn("n", F.lit(1)).withColumn("set", F.lit("x")).withColumn("class", F.lit(0)).withColumn("size", F.lit(5)).repartition(3)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
