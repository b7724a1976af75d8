"""Windows over a stream."""

import datetime as dt

from lodestone.streaming.frequencies import windowed_document_frequency, write_increments


def test_windowed_document_frequency(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [("a", f"d{k % 3}", start + dt.timedelta(minutes=10 * k)) for k in range(12)] + [("b", "d0", start), ("z", "d9", start + dt.timedelta(days=1))]
    schema = "token string, document string, ts timestamp"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/in")
    counts = windowed_document_frequency(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), "token", "document", "ts")
    query = write_increments(counts, f"{tmp_path}/out", f"{tmp_path}/state")
    assert query.awaitTermination(120) and query.exception() is None
    got = {(r.start.hour, r.token): r.freq for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {(0, "a"): 3, (1, "a"): 3, (0, "b"): 1}  # the last window is not closed yet
