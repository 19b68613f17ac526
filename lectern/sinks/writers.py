"""K1-K5 sinks.  Everything is written by the executors; only the tiny
scorecard / vocabulary objects are shaped into a single JSON line."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.audio import open_path

REPORT_SEPARATOR = "-" * 54  # fixed: the pair report's dash line


def write_translations(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """K1: the wide result table (no index column).  CSV keeps a header."""
    w = df.write.mode("overwrite")
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.parquet(path)


def json_object(df: DataFrame, key: str, value: str) -> DataFrame:
    """One row holding ``{key: value, ...}`` as JSON text (K2/K4 shape).

    The input is a scorecard or vocabulary: one entry per group x metric or per
    character, never per data row.
    """
    return df.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(
        F.col(key).cast("string"), F.col(value))))).alias("value"))


def write_scorecard(scorecard: DataFrame, path: str) -> None:
    """K2: ``{"{group}_{metric}": score}`` as one JSON document."""
    json_object(scorecard, "key", "score").coalesce(1).write.mode("overwrite").text(path)


def write_vocab(vocab: DataFrame, path: str) -> None:
    """K4: ``{token: id}`` as one JSON document."""
    json_object(vocab, "token", "id").coalesce(1).write.mode("overwrite").text(path)


def report_lines(report: DataFrame, pairs: DataFrame, order: list[str],
                 ref: str = "ref", hyp: str = "hyp") -> DataFrame:
    """K3 as rows ``(k0, k1.., line)``: a header of four metric lines (from a
    one-row :func:`asr_report`), then ``REF:``/``HYP:``/dashes per pair.

    Sorting by the returned order columns gives the file order; the sort is a
    range-partitioned distributed sort, so the report can be any size.
    """
    head = [F.lit("")]
    head += [F.concat(F.lit(f"{name}: "), F.col(c).cast("string")) for name, c in (("WER", "wer"), ("CER", "cer"))]
    head.append(F.lit(""))
    head += [F.concat(F.lit(f"NORMALIZED {name}: "), F.col(c).cast("string")) for name, c in (("WER", "norm_wer"), ("CER", "norm_cer"))]
    head += [F.lit(""), F.lit("")]
    lines = pairs.select(*[F.col(c) for c in order], F.posexplode(F.array(
        F.concat(F.lit("REF: "), F.col(ref)), F.concat(F.lit("HYP: "), F.col(hyp)),
        F.lit(REPORT_SEPARATOR))).alias("_j", "line"))
    lines = lines.select(F.lit(1).alias("_part"), *order, "_j", "line")
    key_types = {f.name: f.dataType for f in pairs.schema.fields}
    header = report.select(F.posexplode(F.array(*head)).alias("_j", "line")).select(
        F.lit(0).alias("_part"), *[F.lit(None).cast(key_types[c]).alias(c) for c in order], "_j", "line")
    return header.unionByName(lines)


def write_pair_report(report: DataFrame, pairs: DataFrame, path: str, order: list[str],
                      ref: str = "ref", hyp: str = "hyp") -> None:
    lines = report_lines(report, pairs, order, ref, hyp)
    (lines.orderBy("_part", *order, "_j").select("line")
     .write.mode("overwrite").text(path))


def write_split_metrics(metrics: DataFrame, path: str) -> None:
    """K5: one JSON record per split."""
    metrics.coalesce(1).write.mode("overwrite").json(path)


def write_files(df: DataFrame, root: str, name: str = "name", content: str = "content") -> None:
    """Each row's bytes as a file of its own below ``root`` (W2's new dataset as an
    audio folder).  Names are relative and may hold folders; a null writes no
    file.  A file is written under another name first and moved, so a task that
    is run again leaves whole files."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        system, base = open_path(root)
        made = set()
        for batch in batches:
            for file, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                if file is None or not data.is_valid:
                    continue
                path = f"{base.rstrip('/')}/{file}"
                folder, _, last = path.rpartition("/")
                if folder not in made:
                    system.create_dir(folder, recursive=True)
                    made.add(folder)
                part = f"{folder}/.{last}.{uuid.uuid4().hex}"
                with system.open_output_stream(part) as out:
                    out.write(data.as_buffer())
                system.move(part, path)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    df.select(name, content).mapInArrow(run, "n long").write.format("noop").mode("overwrite").save()
