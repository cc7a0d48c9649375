"""What the processors send to the state: few waits, replies in order, errors not lost; chunks of waiting rows."""

import io
import json
import struct
from decimal import Decimal

import pytest
from pyspark.sql.streaming.proto.StateMessage_pb2 import StateResponse
from pyspark.sql.types import Row

from riskloom import model as m
from riskloom.streaming.messages import Messages
from riskloom.streaming.processors import CARRIED, InEventOrder, _carried, _Waiting


class Wire:
    """The socket file of a client; each request is one byte, and ``answers`` has the replies to them."""

    def __init__(self, answers):
        self.answers, self.sent, self.waits, self._waiting, self._replies = answers, b"", 0, b"", io.BytesIO()

    def write(self, content):
        self._waiting += content

    def flush(self):
        if self._waiting:
            self.waits += 1
            replies = b""
            for request in self._waiting:
                status, error = self.answers.get(request, (0, ""))
                body = StateResponse(statusCode=status, errorMessage=error).SerializeToString()
                replies += struct.pack("!i", len(body)) + body
            self.sent, self._waiting, self._replies = self.sent + self._waiting, b"", io.BytesIO(self._replies.read() + replies)

    def read(self, size):
        return self._replies.read(size)


class Client:
    def __init__(self, answers):
        self.sockfile = self.wire = Wire(answers)

    def call(self, request):
        self.sockfile.write(bytes([request]))
        self.sockfile.flush()
        body = self.sockfile.read(struct.unpack("!i", self.sockfile.read(4))[0])
        reply = StateResponse()
        reply.ParseFromString(body)
        return reply.statusCode

    set_implicit_key = register_timer = delete_timer = call


class Handle:
    def __init__(self, answers=()):
        self._statefulProcessorApiClient = self.client = Client(dict(answers))
        self.messages = Messages(self)


def test_replies_to_writes_come_with_the_next_read():
    handle = Handle({7: (2, "")})
    handle.client.set_implicit_key(1)
    handle.messages.each(handle.client.call, [(2,), (3,)])
    assert handle.client.wire.waits == 0
    assert handle.messages.together(lambda: handle.client.call(7), lambda: handle.client.call(4)) == [2, 0]
    assert (handle.client.wire.waits, handle.client.wire.sent) == (1, bytes([1, 2, 3, 7, 4]))
    assert handle.messages.which(handle.client.call, [(7,), (4,), (7,)]) == [False, True, False]
    assert handle.client.wire.waits == 2
    assert handle.client.call(7) == 2  # a call by itself waits as before


def test_many_writes_do_not_wait_for_the_end():
    handle = Handle()
    handle.messages.each(handle.client.call, [(i % 200,) for i in range(2_000)])
    assert 0 < handle.client.wire.waits < 10
    assert handle.client.call(5) == 0 and len(handle.client.wire.sent) == 2_001


def test_a_failed_write_raises_with_the_next_read():
    handle = Handle({9: (1, "no room")})
    handle.messages.each(handle.client.call, [(9,)])
    with pytest.raises(RuntimeError, match="no room"):
        handle.client.call(1)
    handle = Handle({9: (1, "no room")})
    with pytest.raises(RuntimeError, match="no room"):
        handle.messages.which(handle.client.call, [(9,)])


class Variable(dict):
    """A map state, or by the key () a value state, in memory."""

    getValue, updateValue, removeKey = dict.get, dict.__setitem__, dict.__delitem__

    def get(self, key=()):
        return super().get(key)

    getValue = get

    def update(self, value):
        self[()] = value

    def clear(self):
        self.pop((), None)


class Memory:
    def __init__(self):
        self.kept, self.timers = {}, []

    def getValueState(self, name, schema):
        return self.kept.setdefault(name, Variable())

    def getMapState(self, name, key, value):
        return self.kept.setdefault(name, Variable())

    def registerTimer(self, at):
        self.timers.append(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


class Times:
    def __init__(self, watermark):
        self.getCurrentWatermarkInMs = lambda: watermark


def text(ts, id, **values):
    row = dict.fromkeys(CARRIED) | {"ts_ms": ts, "transaction_id": id, "topic": "t", "partition": 0, "offset": ts, "amount": 2.5} | values
    return json.dumps({k: v for k, v in row.items() if v is not None})


def test_a_customer_is_called_once_a_batch():
    memory, order = Memory(), InEventOrder(0, m.HISTORY_RETENTION_MS, 100)
    order.init(memory)

    def call(watermark, *texts):
        out = order.handleInputRows(("c",), iter([Row(row=t) for t in texts]), Times(watermark))
        return [json.loads(r["evaluated"], parse_float=Decimal) for r in out]

    assert call(0, text(2_000, "b"), text(1_000, "a", payment_status="DECLINED"), text(2_000, "a2")) == []
    assert memory.timers == [1_000]
    done = call(1_500, text(9_000, "z"), text(1_500, "late"))
    assert [(d["row"]["transaction_id"], d["lateness"]) for d in done] == [("a", "ON_TIME"), ("late", "LATE")]
    assert memory.timers == [2_000]  # moved: the timer at 1,000 would have nothing left to do
    done = call(2_000)
    assert [(d["row"]["transaction_id"], d["context"]["recent_transaction_count"]) for d in done] == [("a2", 0), ("b", 1)]
    assert [d["context"]["amount_last_ten_minutes"] for d in done] == ["2.5", "5.0"]
    assert memory.timers == [9_000] and len(json.loads(memory.kept["history"][()][0])) == 3


def test_chunks_hold_all_rows_in_order_whatever_their_number():
    state = Variable()
    firsts, chunks, expected = [], [], []
    for start in (5_000, 0, 5_000, 2_500):  # in, before, between and again; many rows of one instant
        texts = [text(start + i // 3 * 7, f"{start}-{i}") for i in range(700)] + [text(2_600, f"same-{start}-{i}") for i in range(300)]
        waiting = _Waiting(state, firsts, chunks, state.get((0,)))
        waiting.add([_carried(t) for t in texts])
        waiting.store()
        firsts, chunks, expected = waiting.firsts, waiting.chunks, expected + texts
        assert firsts == sorted(firsts) and set(state) == {(c,) for c in chunks}
    assert len(chunks) > 10
    taken = []
    for until in (1_000, 2_600, 10**6):
        waiting = _Waiting(state, firsts, chunks, state.get((0,)))
        while waiting.firsts and waiting.firsts[0] <= until:
            taken += sorted(waiting.take(until), key=lambda r: (r.ts, r.id))
        waiting.store()
        firsts, chunks = waiting.firsts, waiting.chunks
    assert [r.text for r in taken] == sorted(expected, key=lambda t: (json.loads(t)["ts_ms"], json.loads(t)["transaction_id"]))
    assert not state
