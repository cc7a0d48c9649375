"""Retries with exponential backoff and a total time budget, for writes to systems that may be down."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import accumulate, chain, repeat, takewhile
from operator import mul
from typing import TypeVar

_LOG = logging.getLogger(__name__)
_T = TypeVar("_T")


@dataclass(frozen=True)
class RetryPolicy:
    max_elapsed_s: float = 60.0
    initial_s: float = 0.2
    max_s: float = 5.0
    multiplier: float = 2.0

    def pauses(self) -> Iterator[float]:
        """Seconds to wait after each failure: growing, then constant."""
        growing = accumulate(repeat(self.multiplier), mul, initial=self.initial_s)
        growing = takewhile(lambda pause: pause < self.max_s, growing)
        return chain(growing, repeat(self.max_s))


class GivingUp(RuntimeError):
    """The time budget is spent.  Nothing was dropped: the batch fails and runs again from its checkpoint."""


def with_retries(
    write: Callable[[], _T],
    policy: RetryPolicy = RetryPolicy(),
    *,
    retryable: Callable[[Exception], bool] = lambda error: True,
    on_retry: Callable[[int], None] = lambda attempt: None,
    sleep: Callable[[float], None] = time.sleep,
    clock: Callable[[], float] = time.monotonic,
) -> _T:
    """Runs ``write`` until it succeeds or the deadline has passed.  Errors that are not ``retryable`` are raised at once."""
    deadline = clock() + policy.max_elapsed_s
    for number, pause in enumerate(policy.pauses(), start=1):
        try:
            return write()
        except Exception as error:
            if not retryable(error):
                raise
            if clock() >= deadline:
                raise GivingUp(f"no success within {policy.max_elapsed_s:g} s, last error: {error}") from error
            _LOG.warning("failure %d, next try in %g s: %s", number, pause, error)
        on_retry(number)
        sleep(pause)
    raise AssertionError("the pauses never end")
