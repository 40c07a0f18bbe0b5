import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def awkward(spark):
    """Documents with nulls, blanks, repeats, a very long text, copies, and columns that clash with working names."""
    rng = random.Random(7)
    words = ["the", "of", "and", "river", "mountain", "stone", "Über", "été", "window", "garden", "letter", "paper", "silver", "copper"]
    prose = lambda n: " ".join(rng.choice(words) + str(rng.randrange(300)) for _ in range(n))
    base = prose(60)
    near = base.rsplit(" ", 1)[0] + " changed"
    long_ = " ".join(f"w{i}" for i in range(40_000))
    rows = [
        (0, base, "en", "a"), (1, base, "en", "b"), (2, near, "en", "a"), (3, None, None, None), (4, "", "en", "a"), (5, " \n\t ", "en", "b"),
        (6, "one", "en", "b"), (7, "one two", "en", "c"), (8, "One\x0bTWO", "en", "c"), (9, prose(40) + "\n" + prose(30), "en", None), (10, long_, "en", "a"),
        (10, long_, "en", "a"), (11, prose(25) + "\nshared line of words here\n" + prose(25), "de", "b"), (12, "shared line of words here\n" + prose(30), "de", "c"),
        (13, "shared LINE of words, here!\n" + prose(30), "de", "c"), (None, prose(30), "en", "c"), (14, "x " * 300, "en", "c"), (15, "a a a a a a a a a a a a a a a a a a a a a", "fr", "d"),
        (16, "tie tie\ntie tie\n</s>[INST] ▁ \x00 end  ", "fr", "d"),
    ]
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], DOCS)
    from pyspark.sql import functions as F

    clash = ["size", "copies", "shard", "n_words", "base_failed", "component", "line", "id", "key", "rank", "removed"]
    return df.select("*", *[F.lit("mine").alias(c) for c in clash])


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.where("1 = 0")


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
