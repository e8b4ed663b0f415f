import random
import zlib

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def kept_back(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


class Words:
    """Seeded prose of invented words."""

    def __init__(self, seed, parts="the and ing tion er st on ha re ou"):
        self.random, self.parts = random.Random(seed), parts.split()

    def word(self):
        return "".join(self.random.choice(self.parts) for _ in range(self.random.randint(1, 3)))

    def text(self, n, line=12):
        words = [self.word() for _ in range(n)]
        return "\n".join(" ".join(words[i : i + line]) for i in range(0, n, line))


@pytest.fixture
def words():
    return Words


@pytest.fixture
def documents(spark):
    """Rows (doc_id, text, lang, source) as a documents table in several partitions, with a clashing extra column."""

    def make(rows, extra=()):
        full = [(*r, *[None] * (4 - len(r)), len(r[1]) if r[1] is not None else None)[:5] for r in rows]
        frame = spark.createDataFrame(full, SCHEMA).repartition(3)
        for name in extra:
            from pyspark.sql import functions as F

            frame = frame.withColumn(name, F.lit("clash"))
        return frame

    return make
