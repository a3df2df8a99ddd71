"""Rows of one item stay together behind a join that adaptive execution turns into a broadcast."""

import hashlib
from collections import defaultdict

from sparkclean.sources import scans


def test_chunks_behind_a_join_on_their_item(spark, tmp_path):
    chunks = [(f"i{k % 500}", k // 500, hashlib.sha256(b"%d" % k).digest()) for k in range(6000)]
    spark.createDataFrame(chunks, "asset_id string, pos long, chunk binary").repartition(6).write.parquet(str(tmp_path / "chunks"))
    spark.createDataFrame([(f"i{k}", k) for k in range(500)], "asset_id string, n long").write.parquet(str(tmp_path / "wanted"))
    texts = defaultdict(bytes)
    for item, _, chunk in chunks:
        texts[item] += chunk
    names = {"spark.sql.autoBroadcastJoinThreshold": "60k", "spark.sql.sources.fileCompressionFactor": "32", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        own, wanted = (spark.read.parquet(str(tmp_path / name)) for name in ("chunks", "wanted"))
        got = scans.chunk_hashes(own.join(wanted, "asset_id").drop("n")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(tuple(r) for r in got) == sorted((item, hashlib.sha256(t).hexdigest(), len(t)) for item, t in texts.items())
