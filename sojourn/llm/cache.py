"""A dictionary of computed values with a bounded size, one per Python worker."""

from __future__ import annotations

from collections.abc import Callable


class Recent(dict):
    """Values of the keys used last: between ``most`` and twice as many."""

    def __init__(self, compute: Callable, most: int) -> None:
        super().__init__()
        self.compute, self.most, self.older = compute, most, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.compute(key)
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value
