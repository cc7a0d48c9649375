"""The processors by themselves: what one call takes and gives."""

import pandas as pd

from riskloom import model as m
from riskloom.streaming.processors import CARRIED, FirstOccurrence, _frame


class Seen(dict):
    """A map state in memory."""

    containsKey, updateValue = dict.__contains__, dict.__setitem__


class Handle:
    def __init__(self):
        self.seen = Seen()

    def getMapState(self, name, key, value, ttlDurationMs=None):
        return self.seen


def frame(*rows):
    names = ["transaction_id", "amount", *m.COORDINATES]
    return pd.DataFrame([dict(dict.fromkeys(CARRIED), **dict(zip(names, r, strict=True)), bucket=7) for r in rows])


def test_a_call_takes_a_bucket_of_ids_over_several_frames():
    processor, handle = FirstOccurrence(1_000), Handle()
    processor.init(handle)

    def call(*frames):
        return [list(zip(out["transaction_id"], out["amount"])) for out in processor.handleInputRows((7,), iter(frames), None)]

    first = frame(("a", 1, "t", 0, 9), ("b", 2, "t", 0, 4), (None, 3, "t", 0, 5))
    again = frame(("a", 4, "t", 0, 2), (None, 5, "t", 1, 0), ("c", 6, "t", 1, 1))
    assert call(first, again) == [[("a", 4), ("b", 2), (None, 3), ("c", 6)]]
    assert call(frame(("a", 7, "t", 0, 0), ("d", 8, "t", 2, 0))) == [[("d", 8)]]
    assert call(frame(("d", 9, "t", 2, 1))) == []
    assert set(handle.seen) == {("a",), ("b",), (None,), ("c",), ("d",)}


def test_evaluated_rows_go_out_in_one_column():
    row = tuple(range(len(CARRIED) + len(m.CONTEXT_COLUMNS))) + ("LATE",)
    out = _frame([row, row])
    assert list(out.columns) == ["rows"] and [list(r.values()) for r in out["rows"][0]] == [list(row)] * 2
