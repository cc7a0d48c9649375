"""Isolation of refused records, with stores that refuse."""

import math
import random

import pytest

from riskloom.sinks.isolation import refuses_record, write_isolating


class Refused(Exception):
    def __init__(self, sqlstate):
        super().__init__(f"refused with {sqlstate}")
        self.sqlstate = sqlstate


class Store:
    """Refuses a range that holds a bad number; a stored range is stored whole."""

    def __init__(self, numbers, bad, state="23514"):
        self.numbers, self.bad, self.state = numbers, bad, state
        self.stored, self.calls = [], 0

    def inside(self, lo, hi):
        return [n for n in self.numbers if lo <= n < hi]

    def write(self, lo, hi):
        self.calls += 1
        mine = self.inside(lo, hi)
        if set(mine) & self.bad:
            raise Refused(self.state)
        self.stored += mine

    def size(self, lo, hi):
        return len(self.inside(lo, hi))


@pytest.mark.parametrize("seed", range(5))
def test_everything_but_the_culprits_is_stored_once(seed):
    rng = random.Random(seed)
    numbers = sorted(rng.sample(range(2**40), 1000))
    bad = set(rng.sample(numbers, seed))
    store = Store(numbers, bad)
    outcome = write_isolating(store.write, 0, 2**40, store.size)
    assert sorted(store.stored) == [n for n in numbers if n not in bad]
    assert [n for lo, hi, _ in outcome.refused for n in store.inside(lo, hi)] == sorted(bad)
    assert outcome.attempts == store.calls <= 1 + len(bad) * 2 * (math.ceil(math.log2(1000)) + 12)
    assert all("23514" in reason for *_, reason in outcome.refused)


def test_a_dense_batch_costs_a_logarithm_for_each_culprit():
    store = Store(range(512), {77})
    outcome = write_isolating(store.write, 0, 512, store.size)
    assert outcome.attempts == 1 + 2 * 9 and outcome.refused[0][:2] == (77, 78)


def test_all_records_refused_and_an_empty_range():
    store = Store(range(8), set(range(8)))
    assert len(write_isolating(store.write, 0, 8, store.size).refused) == 8 and store.stored == []
    assert write_isolating(store.write, 8, 9, store.size).refused == []


def test_an_error_that_lies_in_no_record_skips_nothing():
    store = Store(range(64), {5}, state="08006")
    with pytest.raises(Refused):
        write_isolating(store.write, 0, 64, store.size)
    assert store.calls == 1 and store.stored == []


def test_records_with_equal_numbers_are_refused_together():
    store = Store([3, 3, 4], {3})
    outcome = write_isolating(store.write, 0, 8, store.size)
    assert store.stored == [4] and [r[:2] for r in outcome.refused] == [(3, 4)]


class Java:
    """What py4j shows of a Java error."""

    def __init__(self, state=None, cause=None, following=None):
        self.state, self.cause, self.following = state, cause, following
        if state is not None:
            self.getSQLState, self.getNextException = lambda: state, lambda: following

    def getCause(self):
        return self.cause


def wrapped(java=None, cause=None):
    error = RuntimeError("wrapped")
    error.java_exception = java
    error.__cause__ = cause
    return error


@pytest.mark.parametrize(
    "error, expected",
    [
        (Refused("22003"), True),
        (Refused("23505"), True),
        (Refused("40001"), False),
        (RuntimeError("plain"), False),
        (wrapped(cause=Refused("22001")), True),
        (wrapped(Java(cause=Java("23502"))), True),
        (wrapped(Java("00000", following=Java("22P02"))), True),
        (wrapped(Java("57014", cause=Java("08003"))), False),
    ],
)
def test_which_errors_lie_in_a_record(error, expected):
    assert refuses_record(error) is expected
