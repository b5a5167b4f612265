"""Small tables with the awkward cases that every operator of the subpackage must take."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

_SYLLABLES = "an er on the ing ed st re nt ha ti of ly in es".split()


def prose(rng: random.Random, words: int) -> str:
    return " ".join("".join(rng.choices(_SYLLABLES, k=rng.randint(1, 4))) for _ in range(words))


def texts(seed: int = 3) -> list:
    rng = random.Random(seed)
    base = [prose(rng, rng.choice([1, 3, 4, 5, 40, 200])) for _ in range(60)]
    near = [b + " " + prose(rng, 1) for b in base if len(b.split()) > 30]
    spaced = [b.replace(" ", "\n\t ") for b in base[:6]]
    odd = [None, "", " ", "\n", "é ñ ß 漢字 😀", "x" * 3000, "don't  'tis we're\r\n\r\n 12 ab12 !?!   end  ", prose(rng, 20_000), "<|endoftext|> tail<|endoftext|>"]
    return base + near + spaced + odd + base[:5] + [None, ""]


def documents(spark, rows=None):
    rows = list(enumerate(texts())) if rows is None else rows
    return spark.createDataFrame([(i, t, ["en", None, "de"][(i or 0) % 3], None if i == 4 else f"s{(i or 0) % 3}", None) for i, t in rows], SCHEMA)


def awkward(df, spark):
    """The same rows with repeated ones, and with columns whose names operators might use themselves."""
    return awkward_names(df.unionByName(df.where("doc_id % 9 = 0")))


def awkward_names(again):
    from pyspark.sql import functions as F

    for name in ("id", "n", "size", "rank", "key", "rep", "cls", "t", "kept", "score", "label", "shard"):
        if name in again.columns:
            continue
        again = again.withColumn(name, F.lit("clash"))
    return again


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)
