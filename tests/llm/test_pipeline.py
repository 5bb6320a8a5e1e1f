"""The pipeline: each stage on what its predecessor kept."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from panelwright.llm import common, mixing, neardup
from panelwright.llm.common import read, store

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = read(spark, SF, "documents")
    columns = docs.columns
    extra = spark.createDataFrame([(-1, None, None, None, None), (-2, "123 456", "en", "src0", 7), (-3, "", "en", None, 0)], docs.schema)
    docs = docs.union(extra)
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, store(stage(spark, docs, SF))
        seen[name] = before, docs
        if name != "packing":
            assert docs.columns == columns
            assert docs.select("doc_id").exceptAll(before.select("doc_id").distinct()).count() == 0 or name.startswith("mixing")
    kept = {r["doc_id"] for r in seen["language ID"][1].select("doc_id").collect()}
    assert not kept & {-1, -2, -3}
    deduped = seen["MinHash near-dedup"][1]
    assert neardup.near_duplicates(deduped, 5).filter("component_id <> doc_id").count() == 0
    before, mixed = seen["mixing sources to target weights"]
    want = mixing.with_repeats(before).select("doc_id", F.col("repeats").alias("n")).filter("n > 0")
    assert want.exceptAll(mixed.groupBy("doc_id").agg(F.count("*").alias("n"))).count() == 0
    packed = seen["packing"][1]
    per_copy = packed.groupBy("doc_id").agg((F.sum("length") / F.max("doc_tokens")).alias("copies"))
    assert per_copy.join(mixed.groupBy("doc_id").agg(F.count("*").alias("n")), "doc_id").filter("copies <> n").count() == 0
    assert per_copy.count() == mixed.select("doc_id").distinct().count()


def test_a_worker_holds_the_tables_of_one_operator():
    """Tables of language, packing and earlier samples stayed in a worker beside those of the stage it worked for."""
    import public_tokenizers
    import pyarrow as pa

    from panelwright.llm import common, language, packing

    text = pa.array(["the cat sat", "el gato duerme"])
    for samples in ({"en": b" the cat sat on the mat", "es": b" el gato duerme en la casa"}, {"en": b" a dog", "es": b" un perro"}):
        language._answers(samples)(text)
        assert len(common._HELD) == 1
    encoder = packing._encoder(public_tokenizers.path("byte_bpe_50k.json"), None)
    assert list(common._HELD.values()) == [encoder]
    assert packing._encoder(public_tokenizers.path("byte_bpe_50k.json"), None) is encoder
    common.let_go()
    assert not common._HELD


def test_texts_of_documents_that_stay_are_not_shuffled(spark, monkeypatch):
    """All texts were shuffled to drop a few documents, once their ids were too many to be broadcast."""
    ids = [5, 7, 7, 1999, None, 2**60 + 1, -3]
    # an id that falls on the same bit as 5
    slots = common.mix(np.arange(1 << 25, dtype=np.uint64)) % np.uint64(neardup.FILTER_BITS)
    twin = next(int(k) for k in np.flatnonzero(slots == slots[5]) if k > 2000)
    rows = [(k, f"text {k}") for k in range(2000)] + [(None, "no id"), (7, "again"), (5, None), (twin, "stays"), (2**60 + 1, "goes"), (2**60, "stays"), (-3, "goes")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    gone = spark.createDataFrame([(k,) for k in ids], "doc_id long")
    joined = []
    join = type(docs).join

    def seen(self, other, *args):
        if "text" in self.columns:
            joined.append(self.count())
        return join(self, other, *args)

    monkeypatch.setattr(type(docs), "join", seen)
    got = corpus_pipeline._without(docs, gone)
    want = [r for r in rows if r[0] is None or r[0] not in ids]
    order = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    assert got.columns == ["doc_id", "text"]
    assert sorted((tuple(r) for r in got.collect()), key=order) == sorted(want, key=order)
    assert sum(joined) < 20
    none = corpus_pipeline._without(docs, gone.limit(0))
    assert none.count() == len(rows)
