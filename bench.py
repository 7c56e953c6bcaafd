"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the table folder, ``BENCH_CPUS`` the local cores. Every result is
computed in full and thrown away.
"""

from __future__ import annotations

import json
import os
import time

from corpusloom.plans import registry
from corpusloom.session import local_session

HEADLINE = (
    "interleave_all",
    "tokenize_codepoint",
    "pretokenize",
    "pack_batch",
    "pack_global",
    "shard_write",
    "collate_pad",
    "char_coverage",
    "bpe_pair_counts",
    "train_bpe",
    "encode_bpe",
    "decode_bpe",
    "stream_tokenize",
    "stream_pack_batch",
)


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = local_session(str(cpus), shuffle_partitions=cpus)
    run(registry.QUERIES["pack_batch"](spark, sf_dir))  # warms the JVM up, not timed
    times = {}
    for name in names:
        began = time.perf_counter()
        run(registry.QUERIES[name](spark, sf_dir))
        times[name] = round(time.perf_counter() - began, 3)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": sf_dir.rsplit("sf", 1)[-1],
                "cpus": cpus,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
