"""How many rows the strings of crowded anchors make."""

import numpy as np
import pyarrow as pa
import pytest

from strideframe.llm.repeats import _strings


@pytest.mark.parametrize("n_parts", [1, 3])
def test_copies_of_a_segment_give_spans_not_strings(n_parts):
    """900 near copies of a segment of 164 bytes: every third has one of four other bytes at its end."""
    r = np.random.default_rng(5)
    base = r.integers(97, 123, 164).astype(np.uint8).tobytes()
    parts = [base if i % 3 else base[:-1] + bytes([65 + i % 4]) for i in range(900)]
    cols = {"anchor": np.full(900, 7), "doc_id": np.arange(900), "start": np.full(900, 11), "bytes": parts, "parts": np.full(900, n_parts)}
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in cols.values()], names=list(cols))
    rows = [x for b in _strings(100, 1000)(iter([batch.slice(0, 500), batch.slice(500)])) for x in b.to_pylist()]
    strings, spans = [x for x in rows if x["string"] is not None], [x for x in rows if x["string"] is None]
    seen, late, first = set(), {}, []
    for d, p in enumerate(parts):
        for s in range(65):
            if p[s : s + 100] in seen:
                late.setdefault(d, set()).update(range(11 + s, 11 + s + 100))
            else:
                first.append((p[s : s + 100], d, 11 + s, 111 + s))
                seen.add(p[s : s + 100])
    assert {x["doc_id"]: set(range(x["start"], x["stop"])) for x in spans} == late
    assert len(spans) == len(late)
    assert sorted(map(tuple, (x.values() for x in strings))) == (sorted(first) if n_parts > 1 else [])
