"""The latent space decides the cosine that is reported."""

from almanac.llm import leaks as module
from almanac.llm.base import Scratch
from tests.llm.test_leaks import corpus


def test_the_directions_beside_the_benchmark_change_the_cosine(spark, monkeypatch):
    docs, items, truth = corpus()
    frame = spark.createDataFrame(docs, "doc_id long, text string, cosine long").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string, doc_id string")
    found = []
    for more in (module.OVERSAMPLE, 0):
        monkeypatch.setattr(module, "OVERSAMPLE", more)
        found.append({(r.doc, r.item): r.cosine for r in module.leaks(frame, bench, Scratch(spark, "t")).collect()})
    whole, bare = found
    assert set(whole) == set(bare) == truth
    assert all(whole[p] <= bare[p] + 1e-5 for p in truth)
    assert sum(whole[p] < bare[p] - 1e-3 for p in truth) > len(truth) // 4
