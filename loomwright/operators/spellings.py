"""Which words of a vocabulary a text spells anywhere, also inside other words.

Two ways, for two questions. `spelt` scans every text once against automata of bounded vocabulary shards and
names all words found, or the first. `spelt_somewhere` asks only whether any text holds a name, and
meets names and texts by a rare trigram, in plain joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of an automaton and texts of a task.
SHARD_WORDS, BLOCK_TEXTS = 50_000, 20_000


def _tiles(df: DataFrame, sizes: DataFrame, own: str, most: int, other: str, ident: str) -> DataFrame:
    """Rows with `own` (their part of the key's rows, by hash) and `other` (every part of the other side)."""
    placed = df.join(sizes, "key").withColumn(own, F.pmod(F.xxhash64(ident), F.ceil(F.col(f"n_{own}") / most)).cast("int"))
    return placed.withColumn(other, F.explode(F.sequence(F.lit(0), (F.col(f"parts_{other}") - 1).cast("int")))).drop(*[c for c in sizes.columns if c != "key"])


def spelt(texts: DataFrame, words: DataFrame, *, first: bool = False, shard_words: int = SHARD_WORDS, block_texts: int = BLOCK_TEXTS) -> DataFrame:
    """(key, text_id, word_id): words(key, word_id, word) that texts(key, text_id, hay) of the same key spell.

    A tile is a shard of a key's words and a block of its texts: the automaton (Aho-Corasick) is built from
    at most about shard_words words, and a text is read once for each shard, whatever the number of words. With
    first, only the smallest word_id of each text. An empty word is in every text; null keys, words and texts
    meet nothing. Repeated texts and words count once. Ids are longs.
    """
    texts = texts.where("key IS NOT NULL AND hay IS NOT NULL").select("key", F.col("text_id").cast("long").alias("text_id"), "hay")
    words = words.where("key IS NOT NULL AND word IS NOT NULL").select("key", F.col("word_id").cast("long").alias("word_id"), "word")
    count = lambda df, n: df.groupBy("key").agg(F.count(F.lit(1)).alias(n))
    sizes = count(texts, "n_block").join(count(words, "n_shard"), "key")
    sizes = sizes.withColumn("parts_block", F.ceil(F.col("n_block") / block_texts)).withColumn("parts_shard", F.ceil(F.col("n_shard") / shard_words))
    left = _tiles(texts, sizes, "block", block_texts, "shard", "text_id").select("key", "shard", "block", F.lit(0).alias("side"), F.col("text_id").alias("number"), F.col("hay").alias("body"))
    right = _tiles(words, sizes, "shard", shard_words, "block", "word_id").select("key", "shard", "block", F.lit(1).alias("side"), F.col("word_id").alias("number"), F.col("word").alias("body"))
    kind = texts.schema["key"].dataType.simpleString()

    def run(key, both):
        import ahocorasick
        import pandas as pd

        vocabulary, some = both[both["side"] == 1], both[both["side"] == 0]
        ids: dict[str, set[int]] = {}
        for number, word in zip(vocabulary["number"], vocabulary["body"], strict=True):
            ids.setdefault(word, set()).add(number)
        everywhere, automaton = ids.pop("", set()), ahocorasick.Automaton()
        for word, numbers in ids.items():
            automaton.add_word(word, frozenset(numbers))
        if ids:
            automaton.make_automaton()
        rows = []
        for number, text in zip(some["number"], some["body"], strict=True):
            found = set(everywhere).union(*(n for _, n in automaton.iter(text))) if ids else everywhere
            rows += [(key[0], number, w) for w in ([min(found)] if first and found else found)]
        return pd.DataFrame(rows, columns=["key", "text_id", "word_id"])

    found = left.unionByName(right).repartition("key", "shard", "block").groupBy("key", "shard", "block").applyInPandas(run, f"key {kind}, text_id long, word_id long")
    if first:
        return found.groupBy("key", "text_id").agg(F.min("word_id").alias("word_id"))
    return found.distinct()


def _grams(text: Column, n: int) -> Column:
    """All runs of n characters of a text, each once."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("(?s)(?=(" + "." * n + "))"), F.lit(1)))


def spelt_somewhere(names: DataFrame, texts: DataFrame) -> DataFrame:
    """(name): those of names(name) that some text of texts(hay) holds; an underscore stands for any character.

    Each name is looked up by one run of three characters (fewer, if no piece between underscores is so
    long): of the runs of its longest piece, the one in fewest texts. Only texts that hold it are
    compared. Names without any other character than underscores need a text that is long enough.
    """
    asked = names.where("name IS NOT NULL").select("name").distinct()
    piece = F.array_max(F.transform(F.split("name", "[_%]+"), lambda p: F.struct(F.length(p).alias("n"), p.alias("p"))))
    asked = asked.withColumn("piece", piece["p"])
    body = texts.where("hay IS NOT NULL").select("hay").withColumn("text", F.xxhash64("hay", F.length("hay")))
    own = None
    for n in (1, 2, 3):
        of_size = asked.where(F.length("piece") >= 3 if n == 3 else F.length("piece") == n)
        part = of_size.select("name", F.explode(_grams(F.col("piece"), n)).alias("gram"))
        own = part if own is None else own.unionByName(part)
    runs = body.select("text", F.explode(F.array_distinct(F.concat(*[_grams(F.col("hay"), n) for n in (1, 2, 3)]))).alias("gram"))
    held = runs.join(own.select("gram").distinct(), "gram", "left_semi")
    common = held.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rare = own.join(common, "gram").groupBy("name").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"))
    pattern = F.concat(F.lit("%"), F.replace("name", F.lit("\\"), F.lit("\\\\")), F.lit("%")).alias("pattern")
    met = rare.join(held, "gram").select("name", pattern, "text").join(body, "text").where(F.expr("hay LIKE pattern"))
    longest = body.agg(F.max(F.length("hay")).alias("longest"))
    bare = asked.where(F.length("piece") == 0).join(longest, F.length(F.regexp_replace("name", "%", "")) <= F.col("longest"))
    return met.select("name").unionByName(bare.select("name")).distinct()
