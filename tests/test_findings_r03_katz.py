"""op6_katz: what a task holds and what goes between tasks."""

import numpy as np
import pyarrow as pa

from cuespark.llm import katz, katz_trigrams


def test_packed_rows_are_compressed_and_come_back():
    for kind in (np.uint16, np.int32, np.uint64, float):
        values = (np.arange(5000) % 7).astype(kind)
        rows = katz._packed_rows(np.array([0, 0, 3, 3, 5000]), values)
        assert rows.nbytes < values.nbytes / 3
        assert (katz._unpacked(rows, kind) == values).all() and (katz._unpacked(rows.slice(2, 2), kind) == values[3:]).all()
        assert [len(katz._unpacked(rows.slice(i, 1), kind)) for i in range(4)] == [0, 3, 0, 4997]
    assert len(katz._unpacked(pa.array([], pa.binary()), float)) == 0


def test_sums_hold_the_documents_of_a_bucket_only():
    """A chunk's documents, times the buckets, would grow with the square of the input."""
    one = np.ones(3)
    s = {n: katz._unpacked(pa.array([x], pa.binary()), katz.SUMS[n]).tolist() for n, x in katz._sums(np.array([900, 3, 3]), 1000, one, one, 2 * one).items()}
    assert s == {"at": [3, 900], "tokens": [2, 1], "known": [2, 1], "base": [2.0, 1.0], "score": [4.0, 2.0]}


def test_trigrams_have_buckets_of_half_the_size(spark):
    """Both orders of a bucket's tokens are in a task at once."""
    rows = spark.range(400).selectExpr("cast(concat_ws(' ', transform(sequence(0, 99), i -> concat('w', (id * 100 + i) % 3001))) as binary) as text")
    before, katz.BUCKET = katz.BUCKET, 2000
    try:
        assert 2 * katz._deal(rows).buckets - 1 <= katz_trigrams._plan(rows).deal.buckets
    finally:
        katz.BUCKET = before
