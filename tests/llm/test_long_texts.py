"""Long texts are cut into chunks in linear time."""

import time

import pyarrow as pa

from lectern.llm import pieces


def spent(megabytes):
    text = "some words of a text " * (megabytes * (1 << 20) // 21)
    table = pa.RecordBatch.from_pydict({"k": [1], "f": [2], "text": [text]})
    times = []
    for _ in range(3):
        began = time.process_time()
        got = list(pieces.cut_texts(iter([table]), 1 << 12, 16))
        times.append(time.process_time() - began)
    rows = [r for b in got for r in b.to_pylist()]
    assert "".join(r["t"][r["left"] : r["left"] + (1 << 12)] for r in rows) == pieces.MARK + text.replace(" ", pieces.MARK)
    assert [r["c"] for r in rows] == list(range(rows[0]["n"]))
    return min(times)


def test_linear_time():
    small = spent(16)
    assert spent(64) <= 8 * small  # 16 times as long if it were quadratic; wide, as clocks are noisy
