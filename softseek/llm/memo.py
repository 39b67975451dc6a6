"""A bounded memory of what short strings encode to."""

from __future__ import annotations

from collections.abc import Callable

#: Longer strings are encoded every time, so that the memory's size is bounded.
LONGEST = 64


class Memo:
    """Values of strings, two generations of at most ``size`` each; the older is dropped as a whole.

    ``encode`` gets a list of distinct strings of at most ``batch_bytes`` characters together (or
    one longer string) and returns their values.
    """

    def __init__(self, encode: Callable[[list[str]], list], size: int = 250_000, batch_chars: int = 1 << 16):
        self.encode, self.size, self.batch_chars = encode, size, batch_chars
        self.young: dict[str, object] = {}
        self.old: dict[str, object] = {}

    def _learn(self, missing: list[str]) -> dict[str, object]:
        found: dict[str, object] = {}
        batch, chars = [], 0
        for s in missing:
            if batch and chars + len(s) > self.batch_chars:
                found.update(zip(batch, self.encode(batch), strict=True))
                batch, chars = [], 0
            batch.append(s)
            chars += len(s) + 1
        if batch:
            found.update(zip(batch, self.encode(batch), strict=True))
        return found

    def get_all(self, strings: list[str]) -> list:
        """The values in order."""
        out = list(map(self.young.get, strings))
        missing = [i for i, value in enumerate(out) if value is None]
        if not missing:
            return out
        unknown = {strings[i] for i in missing}
        known = {s: self.old[s] for s in unknown if s in self.old}
        learnt = self._learn(list(unknown.difference(known)))
        self.young.update(known)
        self.young.update(learnt)
        for i in missing:
            out[i] = self.young[strings[i]]
        for s in learnt:
            if len(s) > LONGEST:
                del self.young[s]
        if len(self.young) > self.size:
            self.old, self.young = self.young, {}
        return out

    def get_lists(self, lists: list[list[str]]) -> list[list]:
        """The values of several lists, looked up together."""
        values, at, out = self.get_all([s for strings in lists for s in strings]), 0, []
        for strings in lists:
            out.append(values[at : at + len(strings)])
            at += len(strings)
        return out
