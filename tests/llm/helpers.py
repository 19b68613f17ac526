"""Inputs with everything odd in them, shared by the tests of this folder."""

from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that the operators use themselves
    *(T.StructField(c, T.StringType()) for c in ("id", "data", "raw", "row", "fp", "kept", "score", "label", "part", "block")),
])

LONG = "Ein sehr langer Text über alles mögliche " * 4000
PASSAGE = "this passage of rather more than fifty bytes stands in several of the documents here"
TEXTS = [
    (3, "the quick brown fox jumps over the lazy dog and runs away into the dark green forest"),
    (1, "the quick  brown\tfox jumps over the lazy dog and runs away into the dark green forest"),
    (2, None), (4, ""), (5, " \t\n"), (6, LONG), (7, LONG + "!"), (8, PASSAGE), (9, "before it. " + PASSAGE + " and after"),
    (10, "日本語のテキスト、" + PASSAGE + "。終わり"), (11, "a"), (12, "é\u00a0b \u2003 c\u3000d  e\x1cf\x85g"), (12, "other text of id 12"),
    (13, "repeated row"), (13, "repeated row"), (None, "no id at all"), (None, PASSAGE), (14, "<|endoftext|> you IDIOT!!! <s> ▁x ▁ y  "),
    (15, "Licensed under the Apache License, Version 2.0. CC BY-NC 4.0. All rights reserved."), (16, "x" * 300), (17, "x" * 260),
    (-5, "😀 e\u0301 ẹ́ \x00 null byte"),
]


def docs(spark, rows=TEXTS):
    return spark.createDataFrame([(i, t, None, "src0", None, *"abcdefghij") for i, t in rows], DOCS)


def table_rows(spark, sf="sf0.001", name="documents"):
    df = spark.read.parquet(f"/root/testdata/{sf}/{name}.parquet")
    return df, [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()] if name == "documents" else df.collect()


def components(nodes, linked):
    """Brute force: the smallest reachable node of each."""
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    order = sorted(nodes)
    for k, a in enumerate(order):
        for b in order[k + 1:]:
            if linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}
