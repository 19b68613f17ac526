import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern.llm import chat, queries

SCHEMA = "conv_id long, turn long, role string, text string, id string, head string, body string, part string, piece string, seq string"
MARKS = "\\### Assistant: </turn> ok"
ODD = [(1, 0, "user", MARKS), (1, 1, "assistant", MARKS), (1, None, "system", '<turn role="user">\n'), (2, 1, "assistant", "b"), (2, 0, "user", "a"),
       (3, 0, None, None), (4, 0, "assistant", None), (4, 1, "assistant", "\n</turn>\n"), (4, 2, "assistant", "\\"), (4, 3, "assistant", "\\\\<turn\\"),
       (5, 0, 'ro"le\\n\n">\n', "x"), (5, 0, 'ro"le\\n\n">\n', "x"), (6, 0, "assistant", "日本 😀 e\u0301 \x00 \x02 \r\n"), (None, 0, "user", "no id"),
       (None, 1, "assistant", "still none"), (-7, 0, "assistant", ""), (8, 0, "assistant", "long \\ <turn " * 20000), (9, 1, "Assistant", "not that role")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, *"abcdef") for r in rows], SCHEMA)


def brute(rows):
    convs = {}
    for c, turn, role, text in rows:
        convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = []
    for c, turns in convs.items():
        turns = [t[2:] for t in sorted(turns)]
        loss = "".join(x for r, x in turns if r == "assistant")
        out.append((c, len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest(), len(loss),
                    hashlib.sha256(loss.encode()).hexdigest(), len(formatted(turns))))
    return sorted(out, key=str)


def formatted(turns):
    def text(x):
        return x.replace("\\", "\\\\").replace("<turn", "\\<turn").replace("</turn", "\\</turn")

    def role(r):
        return r.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n")

    return "".join(f'<turn role="{role(r)}">\n{text(x)}\n</turn>\n' for r, x in turns)


def digests(df):
    return sorted((tuple(r) for r in chat.read_back(df).collect()), key=str)


@pytest.mark.parametrize("rows", [ODD, [], [(None, None, None, None)]])
@pytest.mark.parametrize("piece_bytes", [1, 200, chat.PIECE_BYTES])
def test_odd_rows(spark, rows, piece_bytes):
    assert digests(chat.format_conversations(frame(spark, rows), piece_bytes=piece_bytes)) == brute(rows)


def test_texts_and_spans_are_the_template(spark):
    rows = [r for r in ODD if r[0] in (1, 2, 4, 6)]
    got = chat.format_conversations(frame(spark, rows).coalesce(1)).orderBy("id", "piece").collect()
    by_id = {}
    for r in got:
        data = r["text"].encode()
        lost = "".join(chat.unescape_text(data[a:b]).decode() for a, b in zip(r["loss_begins"], r["loss_ends"]))
        text, loss = by_id.get(r["id"], ("", ""))
        by_id[r["id"]] = text + r["text"], loss + lost
    for c, (text, loss) in by_id.items():
        turns = [x[2:] for x in sorted((t is not None, t or 0, r or "", x or "") for i, t, r, x in rows if i == c)]
        assert text == formatted(turns) and loss == "".join(x for r, x in turns if r == "assistant")
        assert [(r.decode(), x.decode()) for r, x in chat.parse(text.encode())] == turns


def test_a_piece_is_a_conversation_where_nothing_cuts_it(spark):
    rows = [(c, t, "user", f"{c} {t}") for c in range(500) for t in range(5)]
    got = chat.format_conversations(frame(spark, rows), piece_bytes=300).collect()
    whole = [r for r in got if r["whole"]]
    parts = spark.sparkContext.defaultParallelism
    assert all(r["n_turns"] == 5 for r in whole) and len(got) - len(whole) <= 2 * max(parts, 4)


def test_one_conversation_holds_most_rows(spark):
    rng = random.Random(3)
    rows = [(1, t, rng.choice(["user", "assistant"]), "x" * rng.randint(0, 60) + "\\") for t in range(6000)]
    rows += [(c, t, "assistant", f"{c}") for c in range(2, 300) for t in range(3)]
    df = chat.format_conversations(frame(spark, rows).repartition(7), piece_bytes=20_000)
    assert df.where("id = 1").count() > 10
    assert df.select(F.max(F.octet_length("text"))).head()[0] < 45_000
    assert digests(df) == brute(rows)


def test_repeats_of_one_turn(spark):
    rows = [(1, 0, "assistant", "same")] * 2000 + [(1, 0, "assistant", "other")]
    assert digests(chat.format_conversations(frame(spark, rows))) == brute(rows)


def test_assemble_copies_long_and_short_segments():
    body = ["a" * 70_000, "", "é", "b" * 65_537]
    text, lo, hi = chat.assemble(pa.array([b"<", b"<<", b"", b"<"], pa.binary()), pa.array([b.encode() for b in body], pa.binary()), np.array([0, 2]))
    end = chat.END
    assert text.to_pylist() == ["<" + body[0] + end + "<<" + end, "é" + end + "<" + body[3] + end]
    data = "".join(text.to_pylist()).encode()
    assert [data[a:b].decode() for a, b in zip(lo, hi)] == body


def test_query_is_whole(spark):
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").collect()]
    got = queries.op13_chat(spark, "/root/testdata/sf0.001")
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows + [(-7, 0, "user", MARKS), (-7, 1, "assistant", MARKS)])
