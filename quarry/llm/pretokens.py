"""Documents as sequences of pre-tokens, with the work on each distinct pre-token done once.

A worker keeps what it knows of the pre-tokens it has met in a table of bounded size, so its memory
depends neither on the vocabulary of the corpus nor on the length of a text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import regex

#: Entries at which a worker's table of pre-tokens is emptied.
CACHE_ENTRIES = 150_000
#: Characters whose pre-tokens are looked up together.
BLOCK_CHARS = 1 << 20


class Pretokens:
    """``known[pre-token]`` is what ``learn`` returned for it."""

    def __init__(self, pattern: str, learn: Callable[[list[str]], list]):
        self.find = regex.compile(pattern).findall
        self.learn = learn
        self.known: dict[str, object] = {}

    def documents(self, texts) -> Iterator[list]:
        """For each text, in order: what is known of each of its pre-tokens. A null text has none."""
        held: list[list[str]] = []
        chars = 0
        for text in texts:
            tokens = self.find(text) if text else []
            held.append(tokens)
            chars += len(text or "")
            if chars >= BLOCK_CHARS:
                yield from self._known(held)
                held, chars = [], 0
        yield from self._known(held)

    def _known(self, held: list[list[str]]) -> Iterator[list]:
        if len(self.known) > CACHE_ENTRIES:
            self.known.clear()
        new = list(set().union(*held).difference(self.known))
        self.known.update(zip(new, self.learn(new), strict=True))
        known = self.known
        for tokens in held:
            yield [known[t] for t in tokens]
