"""Small documents with every awkward case, and words to write more from."""

import random

WORDS = "amber bridge candle dusk ember field grove harbor island jungle kettle lantern meadow night ocean pebble".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ed", str(rng.randrange(900))]) for _ in range(n))


def texts() -> list[str | None]:
    a, b = prose(1, 120), prose(2, 90)
    near = a.split(" ")
    near[60] = "changed"
    return [
        None, "", "   ", "\n\n", a, a, " ".join(near), b + "\n" + a[:300], b.upper(), "x" * 5000, "tok " * 400,
        a + "\n" + a + "\r\n\t" + b, "é ü ß 日本語 😀 don't I'LL <|endoftext|> é", "a\x00b\x01 c\x1c d e", prose(3, 6000),
        "short", b, "  " + b + "  ", prose(4, 45) + "\n" + prose(5, 45), prose(4, 45) + "\n" + prose(6, 45),
    ]


def documents(spark):
    rows = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts())]
    return spark.createDataFrame(rows, SCHEMA)


def with_odd_columns(docs):
    """The documents with columns whose names operators use themselves."""
    from pyspark.sql import functions as F

    names = ("id", "line", "label", "key", "component", "component_id", "n_words", "score", "spans", "value", "start", "fps", "length")
    return docs.select("*", *[F.lit(1).alias(n) for n in names])
