"""A task gives back what it held: its worker goes on to the tasks of other stages."""

import gc

import pyarrow as pa
from pyspark.sql import types as T

from lodestone.llm import bpe, common


class Source:
    """Takes the function of a task instead of running it."""

    schema = T.StructType([T.StructField("doc_id", T.LongType())])
    value = bpe.vocabulary_file()

    def __getattr__(self, name):
        return lambda *a: self

    def mapInArrow(self, run, schema):
        self.run = run


def test_a_task_leaves_no_vocabulary(monkeypatch):
    source = Source()
    source.sparkSession = source.sparkContext = source
    monkeypatch.setattr(bpe, "ship", lambda spark: None)
    monkeypatch.setattr(bpe, "texts", lambda docs: docs)
    bpe.encode(source, source.value)
    gc.collect()
    gc.disable()
    try:
        assert sum(b.num_rows for b in source.run(iter([pa.RecordBatch.from_pydict({"doc_id": [1], "text": ["a text"]})]))) == 1
        assert not any(isinstance(x, bpe.Tokenizer) for x in gc.get_objects())
    finally:
        gc.enable()


def test_batches_are_small_inside_only(spark):
    docs = spark.range(0, 5_000, 1, 1)
    sizes = lambda: [r.n for r in docs.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"]) for b in batches), "n long").collect()]
    with common.small_batches(spark):
        assert max(sizes()) <= common.BATCH_ROWS
    assert sizes() == [5_000]
