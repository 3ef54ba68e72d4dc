import threading

import pytest

from matgraph.llm._base import BATCHES, block_spans, options, word_blocks

KEY = "spark.sql.parquet.columnarReaderBatchSize"


def test_overlapping_users_leave_the_session_as_it_was(spark):
    before = {k: spark.conf.get(k) for k in BATCHES}
    a, b = options(spark, BATCHES), options(spark, BATCHES | {"spark.sql.unknown.option": "x"})
    a.__enter__()
    b.__enter__()
    a.__exit__(None, None, None)
    assert spark.conf.get(KEY) == BATCHES[KEY]
    b.__exit__(None, None, None)
    assert {k: spark.conf.get(k) for k in BATCHES} == before and spark.conf.get("spark.sql.unknown.option", None) is None


def test_users_of_many_threads(spark):
    before = {k: spark.conf.get(k) for k in BATCHES}
    seen: list = []
    turn = threading.Barrier(8)

    def use():
        turn.wait()
        for _ in range(20):
            with options(spark, BATCHES):
                seen.append(spark.conf.get(KEY))

    threads = [threading.Thread(target=use) for _ in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert set(seen) == {BATCHES[KEY]} and {k: spark.conf.get(k) for k in BATCHES} == before


def test_options_are_restored_after_an_error(spark):
    before = spark.conf.get(KEY)
    with pytest.raises(ValueError), options(spark, BATCHES):
        raise ValueError
    assert spark.conf.get(KEY) == before


@pytest.mark.parametrize("size", [1, 3, 7, 100])
def test_blocks_end_between_words(size):
    for data in (b"", b" ", b"abc", b"ab cd  e\x0bf\x85g\n", b"  a"):
        assert b"".join(data[a:b] for a, b in block_spans(data, size)) == data
        assert [w for words in word_blocks(data, size) for w in words] == data.split()
