"""A batch that a store refuses because of single records: halving finds them, everything else is stored.

A refused write is split in two and each half is written on its own, down to the single records, which are skipped. A
culprit among n records costs about 2 log2(n) writes, where writing the records one by one costs n. An error that does not
lie in a record, such as a lost connection, ends the write at once: nothing is ever skipped because of it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

# The SQLSTATE classes that say a record is refused (data exceptions, violated constraints).
RECORD_CLASSES = ("22", "23")


def _states(error: BaseException | None) -> Iterator[str]:
    """The SQLSTATEs of an error, its causes, and the Java errors behind them with those that follow."""
    seen: set[int] = set()
    while error is not None and id(error) not in seen:
        seen.add(id(error))
        state = getattr(error, "sqlstate", None) or getattr(error, "pgcode", None)
        if isinstance(state, str):
            yield state
        java, depth = getattr(error, "java_exception", None), 0
        while java is not None and depth < 32:
            following = java
            while following is not None and hasattr(following, "getSQLState"):
                try:
                    yield following.getSQLState() or ""
                    following = following.getNextException()
                except Exception:  # not an SQL error: it has no such method
                    break
            java, depth = java.getCause(), depth + 1
        error = error.__cause__ or error.__context__


def refuses_record(error: BaseException) -> bool:
    return any(state[:2] in RECORD_CLASSES for state in _states(error))


@dataclass
class Outcome:
    """Ranges that hold one record each, which the store refuses, with the reason; and the writes it took."""

    refused: list[tuple[int, int, str]] = field(default_factory=list)
    attempts: int = 0


def write_isolating(
    write: Callable[[int, int], None],
    lo: int,
    hi: int,
    size: Callable[[int, int], int],
    *,
    refuses: Callable[[BaseException], bool] = refuses_record,
) -> Outcome:
    """Stores the records numbered from ``lo`` up to ``hi``.

    ``write(lo, hi)`` stores a range completely or raises; ``size`` counts its records, for numbers with gaps. A range that
    cannot be halved further is refused as a whole, which needs equal numbers.
    """
    outcome, todo = Outcome(), [(lo, hi)]
    while todo:
        lo, hi = todo.pop()
        outcome.attempts += 1
        try:
            write(lo, hi)
        except Exception as error:
            if not refuses(error):
                raise
            if hi - lo <= 1 or size(lo, hi) <= 1:
                outcome.refused.append((lo, hi, str(error)))
                continue
            middle = (lo + hi) // 2
            todo += [part for part in ((middle, hi), (lo, middle)) if size(*part)]
    return outcome
