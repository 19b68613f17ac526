import pytest
from helpers import TEXTS, docs, table_rows

from lectern.llm import suffixes
from lectern.llm.common import pairs

LAST = 1 << 62


def brute(rows):
    data = [(LAST if i is None else i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, t in data:
        for k in range(len(t) - 49):
            first[t[k:k + 50]] = min(i, first.get(t[k:k + 50], i))
    out = []
    for (i, t), (id_, _) in zip(data, rows):
        gone = bytearray(len(t))
        for k in range(len(t) - 49):
            if first[t[k:k + 50]] < i:
                gone[k:k + 50] = b"\1" * 50
        edges = [k for k in range(len(t) + 1) if (gone[k - 1] if k else 0) != (gone[k] if k < len(t) else 0)]
        out.append((id_, len(t), edges[::2], edges[1::2], bytes(c for c, g in zip(t, gone) if not g)))
    return sorted(out, key=str)


def got(df, **options):
    found = suffixes.repeated_spans(pairs(df, "doc_id", "text"), **options).collect()
    return sorted(((r["id"], r["n_bytes"], r["begins"], r["ends"], bytes(r["kept"])) for r in found), key=str)


@pytest.mark.parametrize("sizes", [{}, {"block_bytes": 2000, "bucket_bytes": 30_000}])
def test_odd_rows(spark, sizes):
    rows = [(i, t[:20_000] if t else t) for i, t in TEXTS]
    assert got(docs(spark, rows), **sizes) == brute(rows)


def test_empty_table(spark):
    assert got(docs(spark, [])) == []


def test_whole_table_in_many_blocks(spark):
    df, rows = table_rows(spark)
    assert got(df, block_bytes=20_000, bucket_bytes=40_000) == brute(rows)


def test_all_remainders_and_lengths(spark):
    """Repeats of 49 to 200 bytes at every remainder of the sample's modulus."""
    import random

    rng = random.Random(5)
    letters = [chr(rng.randint(97, 122)) for _ in range(60_000)]
    base = "".join(letters)
    rows, at = [(0, base)], 1
    for shift in range(31):
        for length in (49, 50, 51, 79, 80, 110, 200):
            k = rng.randrange(len(base) - 300)
            rows.append((at, "." * shift + f"{at:05d}" + base[k:k + length] + f"#{at:05d}"))
            at += 1
    assert got(docs(spark, rows), block_bytes=5000, bucket_bytes=20_000) == brute(rows)


def test_the_cover_reaches_every_difference():
    for d in range(suffixes.MODULUS):
        assert any((a + d) % suffixes.MODULUS in suffixes.COVER for a in suffixes.COVER)


def test_whole_characters_and_other_columns(spark):
    text = "ü" * 60 + "é"
    df = docs(spark, [(1, text), (2, "x" + text + "!"), (3, None)])
    rows = df.selectExpr("doc_id as id", "cast(coalesce(text, '') as binary) as data", "struct(doc_id, lang, `row`) as keep")
    found = {r["id"]: r for r in suffixes.repeated_spans(rows, whole_characters=True).collect()}
    assert bytes(found[2]["kept"]) == b"x!" and found[3]["kept"] == b"" and found[2]["keep"]["doc_id"] == 2
