"""The pipeline against the same stages worked out plainly on the small tables."""

from collections import Counter

import corpus_pipeline as P
from trialspark.llm.common import table
from tests.conftest import SF_SMALL
from tests.llm.test_decontaminate import brute
from tests.llm.test_ring_shards import check
from tests.llm.test_simhash import slow_components, slow_fingerprint


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_stages_one_by_one(spark):
    docs = table(spark, SF_SMALL, "documents")
    bench = [(r.item_id, r.text) for r in table(spark, SF_SMALL, "benchmark").collect()]
    assert [f.__name__ for _, f in P.STAGES] == ["identify_language", "drop_near_duplicates", "drop_benchmark_leaks",
                                                "mix_domains", "shard"]
    now = docs
    for i, (_, stage) in enumerate(P.STAGES):
        before = rows_of(now)
        out = stage(spark, now, SF_SMALL)
        after = rows_of(out)
        if i == 0:
            assert set(after) <= set(before) and len(after) >= 0.97 * len(before)
        elif i == 1:
            fps = [(d, t, slow_fingerprint(t)) for d, t in sorted(before)]
            comp = slow_components([f for *_, f in fps], 2)
            assert sorted(after) == sorted((d, t) for k, (d, t, _) in enumerate(fps) if comp[k] == k)
        elif i == 2:
            gone = {d for d, _ in brute(before, bench)}
            assert gone and sorted(after) == sorted((d, t) for d, t in before if d not in gone)
        elif i == 3:
            assert set(after) <= set(before) and len(set(after)) > 0.5 * len(before)
        else:
            assert Counter(after) == Counter(before)
            check(out.collect(), 24)
        if i < 4:
            assert out.columns == docs.columns
        now = spark.createDataFrame(out.collect(), out.schema)


def test_run_is_the_stages_in_order(spark):
    out = P.run(spark, SF_SMALL)
    assert out.columns == [*table(spark, SF_SMALL, "documents").columns, "shard", "slot", "hops"]
    check(out.collect(), 24)
