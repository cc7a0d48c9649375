"""Fewer waits between a stateful processor in Python and the state in the JVM.

Each call of a state variable is a message over a socket, and PySpark waits for each reply; the two waits cost several times
what the call does. Here replies to writes are read before the next read of the state, and reads that are known together go
out together. Replies keep their order, so none is mistaken for another; a write that failed raises when its reply is read.

This wraps the socket of PySpark's client, which is not a public interface. A handle without one is used as it is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.serializers import read_int

_MOST_UNREAD = 256  # replies of a few bytes each, far less than a socket holds
_YES, _NO = 0, 2


class _Socket:
    """The client's socket file. ``mode`` is None, "write", "ask" or "answer"."""

    def __init__(self, file) -> None:
        self._file, self.mode, self._unread = file, None, 0

    def write(self, content: bytes) -> None:
        if self.mode != "answer":
            self._file.write(content)

    def flush(self) -> None:
        if self.mode is None:
            self._file.flush()

    def read(self, size: int) -> bytes:
        if self.mode in ("write", "ask"):  # an empty message, which says that all went well
            if size and self.mode == "write":
                self._unread += 1
            return bytes(size)
        self.settle()
        return self._file.read(size)

    def reply(self) -> tuple[int, str]:
        """Status and error of the next reply."""
        from pyspark.sql.streaming.proto.StateMessage_pb2 import StateResponse

        message = StateResponse()
        message.ParseFromString(self._file.read(read_int(self._file)))
        return message.statusCode, message.errorMessage

    def settle(self, most: int = 0) -> None:
        """Reads the replies to writes, if there are more than ``most``."""
        if self._unread <= most:
            return
        self._file.flush()
        while self._unread:
            self._unread -= 1
            status, error = self.reply()
            if status != 0:
                raise RuntimeError(f"a write to the state failed: {error}")

    def sent(self) -> None:
        self._file.flush()


class Messages:
    """The messages of one processor; for ``init``, after the state variables are made."""

    def __init__(self, handle) -> None:
        client = getattr(handle, "_statefulProcessorApiClient", None)
        self._socket = None
        if hasattr(client, "sockfile"):
            self._socket = client.sockfile = _Socket(client.sockfile)
            for name in ("set_implicit_key", "register_timer", "delete_timer"):  # replies without content
                setattr(client, name, self._later(getattr(client, name)))

    def _later(self, call: Callable) -> Callable:
        def called(*args):
            with self.writes():
                return call(*args)

        return called

    @contextmanager
    def _in(self, mode: str) -> Iterator[None]:
        before, self._socket.mode = self._socket.mode, mode
        try:
            yield
        finally:
            self._socket.mode = before

    @contextmanager
    def writes(self) -> Iterator[None]:
        """Calls inside must have replies without content."""
        if self._socket is None:
            yield
            return
        with self._in("write"):
            yield
        self._socket.settle(_MOST_UNREAD)

    def each(self, write: Callable, arguments: list[tuple]) -> None:
        for start in range(0, len(arguments), _MOST_UNREAD):
            with self.writes():
                for a in arguments[start : start + _MOST_UNREAD]:
                    write(*a)

    def which(self, asks: Callable, arguments: list[tuple]) -> list[bool]:
        """Answers of a question that is answered with yes or no."""
        if self._socket is None:
            return [asks(*a) for a in arguments]
        answers = []
        for start in range(0, len(arguments), _MOST_UNREAD):
            some = arguments[start : start + _MOST_UNREAD]
            with self._in("ask"):
                for a in some:
                    asks(*a)
            self._socket.sent()
            self._socket.settle()
            for _ in some:
                status, error = self._socket.reply()
                if status not in (_YES, _NO):
                    raise RuntimeError(f"a question to the state failed: {error}")
                answers.append(status == _YES)
        return answers

    def together(self, *reads: Callable) -> list:
        """Results of reads that each send one message, whatever its answer."""
        if self._socket is None:
            return [read() for read in reads]
        with self._in("ask"):
            for read in reads:
                read()
        self._socket.sent()
        with self._in("answer"):
            return [read() for read in reads]
