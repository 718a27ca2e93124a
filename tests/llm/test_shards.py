import numpy as np

from docloom.llm import shards
from docloom.llm.queries import op10_external_shuffle


def laid_out(rows):
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    return {k: sorted(v) for k, v in by.items()}


def test_rows_law_and_content(spark, table, tmp_path):
    docs = table([(i, "same" if i % 3 == 0 else f"text {i}") for i in range(1003)], "doc_id long, text string", parts=5)
    rows = shards.external_shuffle(docs, 16, bucket_bytes=500).collect()
    assert sorted((r.doc_id, r.text) for r in rows) == sorted((r.doc_id, r.text) for r in docs.collect())
    slots = laid_out(rows)
    assert sorted(slots) == list(range(16)) and all(v == list(range(len(v))) for v in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    order = [r.doc_id for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
    follows = sum(b - a == 1 for a, b in zip(order, order[1:], strict=False))
    assert follows < 20
    again = shards.external_shuffle(docs, 16, bucket_bytes=500).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in again} == {(r.doc_id, r.shard, r.slot) for r in rows}
    assert {(r.doc_id, r.shard) for r in shards.external_shuffle(docs, 16, seed=2, bucket_bytes=500).collect()} != {(r.doc_id, r.shard) for r in rows}
    assert op10_external_shuffle(spark, str(tmp_path)).count() == 1003


def test_permutation_matches_plain_python(table):
    docs = table([(i, f"text {i}") for i in range(701)], "doc_id long, text string", parts=4)
    by = {}
    dealt = shards.scatter(docs, 9, 17).collect()
    for r in sorted(dealt, key=lambda r: r[shards.PLACE]):
        by.setdefault(r[shards.BUCKET], []).append(r.doc_id)
    whole = []
    for bucket, ids in sorted(by.items()):
        np.random.default_rng([17, bucket]).shuffle(ids := np.array(ids))
        whole += ids.tolist()
    want, n = {}, len(whole)
    for place, i in enumerate(whole):
        shard = place * 16 // n
        want[i] = (shard, sum(p * 16 // n == shard for p in range(place)))
    size = sum(len(f"text {i}") + 1 for i in range(701))
    got = shards.external_shuffle(docs, 16, bucket_bytes=-(-size // 9)).collect()
    assert {r.doc_id: (r.shard, r.slot) for r in got} == want and len(by) == 9
    assert max(map(len, by.values())) < 2 * 701 / 9


def test_records_are_dealt_as_before_however_files_are_split(spark, table):
    docs = table([(i, "t" * (i % 50)) for i in range(2000)], "doc_id long, text string", parts=3)
    laid = lambda: {(r.doc_id, r.shard, r.slot) for r in shards.external_shuffle(docs, 16, bucket_bytes=4000).collect()}
    want = laid()
    for name, value in (("spark.sql.files.maxPartitionBytes", "2000"), ("spark.sql.files.openCostInBytes", "100"), ("spark.sql.shuffle.partitions", "9")):
        spark.conf.set(name, value)
    try:
        assert laid() == want
    finally:
        for name in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
            spark.conf.unset(name)
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_edges(edges, no_docs):
    rows = shards.external_shuffle(edges, 4)
    assert set(rows.columns) == set(edges.columns) and laid_out(rows.collect()) == {0: [0, 1, 2, 3], 1: [0, 1, 2], 2: [0, 1, 2, 3], 3: [0, 1, 2]}
    assert shards.external_shuffle(no_docs).count() == 0
