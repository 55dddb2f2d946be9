"""Recursion without Python's stack: texts may nest as deeply as they like."""

from __future__ import annotations

from collections.abc import Generator


def flat(step: Generator):
    """Run a generator that yields further generators where it wants their results; returns its result."""
    open_, value = [step], None
    while open_:
        try:
            deeper = open_[-1].send(value)
        except StopIteration as e:
            open_.pop()
            value = e.value
        except BaseException:
            for g in reversed(open_[:-1]):
                g.close()
            raise
        else:
            open_.append(deeper)
            value = None
    return value
