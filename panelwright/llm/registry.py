"""Where the modules of this subpackage register their queries and SQL."""

from __future__ import annotations

Q, O = {}, {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        Q[name] = fn
        if oracle is not None:
            O[name] = oracle
        return fn

    return register
