"""M9 character vocabulary, U2 union of per-split character sets, A1/J3
label encoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tokenize import chars

# Fixed special tokens (defaults of the speech fine-tuning script).
WORD_DELIMITER = "|"
UNK_TOKEN = "[UNK]"
PAD_TOKEN = "[PAD]"


def char_set(df: DataFrame, col: str) -> DataFrame:
    """Distinct code points of a text column: distinct per row before the
    expansion, per task before the shuffle."""
    return df.select(F.explode(F.array_distinct(chars(F.col(col)))).alias("token")).distinct()


def char_vocab(df: DataFrame, col: str, delimiter: str | None = WORD_DELIMITER,
               unk: str | None = UNK_TOKEN, pad: str | None = PAD_TOKEN,
               splits: list[DataFrame] | None = None) -> DataFrame:
    """M9: ``(token, id)``: distinct characters over all splits sorted by code
    point, id = rank from 0; ``' '`` becomes ``delimiter`` keeping its id;
    then ``unk`` and ``pad`` take the next ids.

    The distinct characters are gathered into one array, partial sets per task
    first: its size is bounded by the code points there are, not by the data.  A
    delimiter already present in the data loses its own entry (as in the
    reference); special ids start after the highest remaining id, so they never
    collide (quirk Q3).  Without characters the special tokens remain.
    """
    cs = char_set(df, col)
    for extra in splits or []:
        cs = cs.union(char_set(extra, col))  # U2
    found = cs.agg(F.array_sort(F.collect_set("token")).alias("chars"))
    ranked = found.select("chars", F.transform("chars", lambda t, i: F.struct(t.alias("token"), i.alias("id"))).alias("entries"))
    if delimiter is not None:
        ranked = ranked.withColumn("entries", F.when(F.array_contains("chars", " "), F.transform(
            F.filter("entries", lambda e: e["token"] != delimiter),
            lambda e: F.struct(F.when(e["token"] == " ", F.lit(delimiter)).otherwise(e["token"]).alias("token"),
                               e["id"].alias("id")))).otherwise(F.col("entries")))
    specials = [t for t in (unk, pad) if t is not None]
    first = F.coalesce(F.get(F.col("entries.id"), F.size("entries") - 1) + 1, F.lit(0))
    extra = [F.struct(F.lit(t).alias("token"), (first + i).alias("id")) for i, t in enumerate(specials)]
    return ranked.select(F.inline(F.concat("entries", F.array(*extra)) if extra else F.col("entries")))


def _constant(values: list[str]) -> Column:
    """An array constant: Spark folds the split of a literal once per query."""
    return F.split(F.lit(",".join(values)), ",")


def id_table(vocab: DataFrame, unk: str = UNK_TOKEN) -> tuple[Column, Column]:
    """Ids by code point (-1: none) and the id of ``unk`` (null without one).

    The entries come to the driver: their number is bounded by the code points
    there are (1,114,112), not by the data.  The table ends at the largest code
    point of the vocabulary and is looked up by position, so that the cost of a
    character does not depend on the size.
    """
    ids = {r["token"]: r["id"] for r in vocab.select("token", "id").collect()}
    points = {ord(t): i for t, i in ids.items() if len(t) == 1}
    table = [str(points.get(p, -1)) for p in range(max(points, default=0) + 1)]
    return _constant(table).cast("array<int>"), F.lit(ids.get(unk)).cast("int")


def token_table(vocab: DataFrame) -> Column:
    """UTF-8 tokens by id, as an array of hexadecimal strings ('': none)."""
    tokens = {r["id"]: r["token"] for r in vocab.select("token", "id").collect()}
    return _constant([tokens.get(i, "").encode().hex() for i in range(max(tokens, default=0) + 1)])


def token_of(table: Column, i: Column) -> Column:
    """The token with id ``i`` of a :func:`token_table`; null for an unknown id."""
    h = F.get(table, i)
    return F.when(h != "", F.decode(F.unhex(h), "UTF-8"))


def encode_labels(df: DataFrame, col: str, vocab: DataFrame, out: str = "labels",
                  delimiter: str = WORD_DELIMITER, unk: str = UNK_TOKEN) -> DataFrame:
    """A1: characters -> ids; ``' '`` -> delimiter; unknown -> ``unk``'s id; a null
    text has null labels, an empty one none.  A narrow projection whatever the
    size of the vocabulary (see :func:`id_table`)."""
    table, unk_id = id_table(vocab, unk)

    def label(c: Column) -> Column:
        known = F.get(table, F.ascii(F.when(c == " ", F.lit(delimiter)).otherwise(c)))
        return F.when(known >= 0, known).otherwise(unk_id)

    return df.withColumn(out, F.transform(chars(F.col(col)), label))
