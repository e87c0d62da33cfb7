"""What Python workers hold, and hand over at a time."""

import ctypes
import random
import tracemalloc
from pathlib import Path

import pyarrow as pa
import pytest

from evalpanel.llm import passages, similar
from evalpanel.llm.common import worker_of


class Given:
    def mapInArrow(self, run, schema):
        return run


def test_seeds_of_a_task_leave_in_small_batches_and_are_matched_in_small_memory(monkeypatch):
    """A million seeds as one batch took the pipeline's executors over their memory."""
    rng = random.Random(5)
    common = " ".join(f"c{i}" for i in range(60))
    texts = [" ".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=9_000)) for _ in range(100)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7, 107), pa.int64()), pa.array([f"{common} {t}" for t in texts])], ["doc", "text"])
    alone = sum(len(passages.seeds_of(*passages.word_hashes([t]), passages.K, passages.WINDOW)[0]) for t in batch.column(1).to_pylist())
    monkeypatch.setattr(passages, "GATHERED", 400_000)
    tracemalloc.start()
    rows, largest, early = 0, 0, []
    for b in passages.seeds(Given())(iter([batch])):
        rows, largest = rows + b.num_rows, max(largest, b.num_rows)
        early += [r for r in b.to_pylist() if r["y"] >= 0][: 10_000 - len(early)]
        del b
    tracemalloc.stop()
    assert rows == alone > 3 * 65_536
    assert largest <= 65_536
    assert len(early) % 99 == 0 and early and {r["ref"] for r in early} == {7} and all(r["place"] == r["y"] < 60 for r in early)
    assert {r["doc"] for r in early} == set(range(8, 107))


def test_seeds_of_a_task_need_little_more_than_their_rows(monkeypatch):
    rng = random.Random(6)
    texts = [" ".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=9_000)) for _ in range(100)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(100), pa.int64()), pa.array(texts)], ["doc", "text"])
    small = [batch.slice(i, 1) for i in range(100)]
    monkeypatch.setattr(passages, "GATHERED", 10_000_000)
    tracemalloc.start()
    rows = sum(b.num_rows for b in passages.seeds(Given())(iter(small)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 75 * rows


def resident():
    return int(Path("/proc/self/statm").read_text().split()[1]) * 4096


@pytest.mark.skipif(not hasattr(ctypes.CDLL(None), "malloc_trim"), reason="only glibc keeps freed memory this way")
def test_a_worker_gives_back_what_another_operator_took():
    worker_of("one")
    held = [bytes(64 << 10) + bytes([i % 251]) for i in range(3000)]
    pins = held[::250]
    del held
    before = resident()
    worker_of("two")
    assert before - resident() > 100 << 20 and len(pins) == 12


@pytest.mark.parametrize("operator", [passages.without_repeats, similar.one_of_each])
def test_texts_go_to_the_late_stages_in_small_batches(spark, operator):
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(limit)
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    operator(docs)
    assert int(spark.conf.get(limit)) <= 4 << 20
