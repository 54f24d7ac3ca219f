"""A full chunk cache keeps the chunks that it met in several blocks; the ids stay right."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from sieveline.llm import common, spans


def test_frequent_chunks_outlive_a_full_cache(monkeypatch):
    calls: list[bytes] = []
    own = spans.Chunks(lambda cs: calls.extend(cs) or [[len(c), c[-1]] for c in cs])
    monkeypatch.setattr(spans, "CACHE_BYTES", 60 * (spans.ENTRY + 20))
    for k in range(20):
        texts = [f"often here w{k}x{i} z" + "long" * 20 * (i == 3) for i in range(10)]
        flat, n = own.ids(*common.buffers(pa.array(texts)))
        want = [[c for c in (b"often", b" here", b" " + t.split(" ")[2].encode(), b" " + t.split(" ")[3].encode())] for t in texts]
        assert flat.tolist() == [x for cs in want for c in cs for x in (len(c), c[-1])]
        assert n.tolist() == [8] * 10
        assert own.size <= 60 * (spans.ENTRY + 20) + 12 * (spans.ENTRY + 40)
        assert len(own.rank) == len(own.lens) and len(own.flat) == own.lens.sum()
    assert calls.count(b"often") == calls.count(b" here") == 1
    assert np.unique([c for c in calls if len(c) > spans.LONG]).size == 1
