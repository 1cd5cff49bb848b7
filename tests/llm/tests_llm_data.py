"""Rows with the cases that every operator must bear."""

import random

from pyspark.sql import functions as F

TABLES = "/root/testdata/sf0.001"


def awkward_texts():
    pick = random.Random(3)
    letters = "abcde éèñß▁ \t\n日本語🙂́  "
    return [
        "", " ", "   ", "\n\n", "a", "▁", "▁▁a  b", "word", "Hello, world!  two  spaces ", "日本語のテキスト", "🙂🙂 \u0007\u0001",
        "<s></s><0x41><unk>", "x" * 3000, "ab " * 20_000, "İIıi ΣσςΑΣ", "don't we'll I'M", "<|endoftext|> a<|startoftext|>b",
        "﻿​", "é ́ 가", *("".join(pick.choices(letters, k=pick.randrange(60))) for _ in range(300)),
    ]


def documents(spark):
    """The smallest given table plus awkward, null, repeated and very long texts, and columns with clashing names."""
    given = spark.read.parquet(f"{TABLES}/documents.parquet")
    more = [(10**6 + i, t, None, None, None) for i, t in enumerate([None, *awkward_texts()])]
    more += [(2 * 10**6 + i, "the same few words in every copy of this text", "en", "src0", 1) for i in range(30)]
    added = spark.createDataFrame(more, given.schema)
    clash = {c: F.lit(7) for c in ("hash", "n", "keep_id", "normal", "group_size", "ids", "tokens", "score", "words")}
    return given.union(added).withColumns(clash)
