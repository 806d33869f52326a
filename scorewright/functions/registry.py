"""Named functions; a name given twice raises."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Generic, TypeVar

T = TypeVar("T")


class Registry(Generic[T]):
    def __init__(self, kind: str):
        self.kind, self.known = kind, {}

    def add(self, name: str) -> Callable[[T], T]:
        def put(f: T) -> T:
            if name in self.known:
                raise ValueError(f"{self.kind} {name!r} exists already")
            self.known[name] = f
            return f

        return put

    def __getitem__(self, name: str) -> T:
        if name not in self.known:
            raise KeyError(f"no {self.kind} {name!r}")
        return self.known[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self.known)

    def __len__(self) -> int:
        return len(self.known)
