"""A bounded memory of computed values, for workers that meet words again and again."""

from __future__ import annotations

from collections.abc import Callable
from itertools import compress


class Memory(dict):
    """``memory[key]`` is ``make(key)``, remembered in two generations.

    When the young generation holds ``size`` keys it becomes the old one, and
    what is used again moves back; so frequent keys stay and at most twice
    ``size`` are held, and what one call of ``many`` was asked for. Keys longer
    than ``longest`` are computed each time. No value is None.
    """

    def __init__(self, make: Callable, size: int, longest: int = 200) -> None:
        super().__init__()
        self.make, self.size, self.longest, self.old = make, size, longest, {}

    def __missing__(self, key):
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.size:
                self.old = dict(self)
                self.clear()
            self[key] = found
        return found

    def many(self, keys: list, make: Callable[[list], list]) -> list:
        """The values of different keys at once; ``make`` makes those not yet known."""
        out = list(map(self.get, keys))
        lost = [i for i, x in enumerate(out) if x is None]
        if not lost:
            return out
        again = [keys[i] for i in lost]
        found = list(map(self.old.get, again))
        new = [x is None for x in found]
        made = iter(make(list(compress(again, new))))
        found = [next(made) if x is None else x for x in found]
        if len(self) + len(found) > self.size:
            self.old = dict(self)
            self.clear()
        longest = self.longest
        for i, key, value in zip(lost, again, found, strict=True):
            out[i] = value
            if len(key) <= longest:
                self[key] = value
        return out
