"""Benchmark: headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line.

Every query starts cold: staged intermediates of earlier queries are dropped, so a pixels-to-tokens time covers
padding, color, adaptive quantization, transforms, shape choice, quantization and tokens.
"""

import json
import os
import time

from blockfield.catalog import base, frame_queries, trace_queries, value_queries  # noqa: F401
from blockfield.session import local_session

HEADLINE = [
    "join01_pad", "prj06_xyb", "job05_contrast_map", "job09_raw_quant", "job03_block_transform", "job10_cfl_maps",
    "job13_quantize_blocks", "win02_dc_tokens", "win06_ac_tokens", "agg18_context_histogram",
    "job18_all_tokens_estimated", "job18_all_tokens_shaped", "job19_decode_trace", "job20_extract_tokens",
    "job21_compare_runs", "job23_audit_bundles",
]


def main():
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8)
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds, rows = {}, {}
    for name in HEADLINE:
        base.forget()
        start = time.time()
        df = base.QUERIES[name](spark, sf)
        df.write.format("noop").mode("overwrite").save()  # count() would let the optimizer drop the measured columns
        seconds[name] = round(time.time() - start, 3)
        rows[name] = df.count()
    blocks = frame_queries.G.with_geometry(frame_queries.I.frames(spark, sf)).agg({"block_count": "sum"}).first()[0]
    rate = lambda n, q: round(n / seconds[q], 1)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf,
        "cpus": cpus, "spark": spark.version, "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions"),
        "blocks": blocks, "blocks_per_sec_8x8": rate(blocks, "job18_all_tokens_estimated"),
        "blocks_per_sec_shaped": rate(blocks, "job18_all_tokens_shaped"),
        "prepared_tokens_per_sec": rate(rows["win06_ac_tokens"], "win06_ac_tokens"), "rows": rows,
    }))


if __name__ == "__main__":
    main()
