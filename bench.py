"""Benchmark: run the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]
and print one JSON line.  Each query is fully executed through the ``noop``
sink (no collect), once to warm the session and once timed.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lectern.plans import catalog  # noqa: E402
from lectern.session import get_session  # noqa: E402

HEADLINE = [
    "asr_report",
    "sentence_bleu_chrf",
    "corpus_bleu_chrf_by_turn",
    "normalize_pages",
    "fold_punct",
    "char_vocab",
    "doc_char_vocab",
    "encode_labels",
    "pad_labels",
    "ctc_decode",
    "infer_translate",
    "union_bitext",
    "cap_per_lang",
    "doc_fold_scores_by_lang",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = get_session()
    times = {}
    for name in HEADLINE:
        fn = catalog.QUERIES[name]
        fn(spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
        t0 = time.perf_counter()
        fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else sf_dir,
    }))


if __name__ == "__main__":
    main()
