"""Cutting texts where a byte-level pre-tokenizer always cuts, so that the parts can be looked up."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

#: Entries kept before the older half is given up; longer parts are not kept.
MAX_ENTRIES, MAX_CHARS = 250_000, 48
#: A blank between two characters that are no white space ends a pre-token, and the next one begins with it.
CUT = re.compile(r"(?<=\S) (?=\S)")


def _odd(part: str) -> bool:
    body = part[1:] if part[:1] == "\n" else part
    return not body or body[0].isspace() or body[-1].isspace()


class ChunkTable:
    """Values of text parts, computed once for all texts of a batch and kept for later batches.

    Texts are cut before single blanks and line feeds that stand between other characters. resolve gets distinct parts, with
    that character, and returns their values. Texts with longer runs of white space are cut only at their single blanks.
    """

    def __init__(self, resolve: Callable[[list[str]], Iterable]):
        self.resolve, self.known, self.old = resolve, {}, {}

    def values(self, texts: list[str | None]) -> Iterable[tuple]:
        """For each text the value of its head, before the first cut, and an iterator over the others'."""
        if len(self.known) > MAX_ENTRIES:
            self.known, self.old = {}, self.known
        known, old = self.known, self.old
        heads, tails, new, whole = [], [], set(), set()
        for text in texts:
            parts = (text or "").replace("\n", " \n").split(" ")
            head = parts.pop(0)
            fresh = set(parts).difference(known)
            if fresh and any(map(_odd, fresh)) or parts and (not head or head[-1].isspace()):
                parts = CUT.split(text)
                head = parts.pop(0)
                fresh = set(parts).difference(known)
            heads.append(head)
            tails.append(parts)
            new |= fresh
            whole.add(head)
        back = new.intersection(old)
        known.update((x, old[x]) for x in back)
        new, whole = list(new - back), list(whole)
        got = list(self.resolve([x if x[:1] == "\n" else f" {x}" for x in new] + whole))
        known.update(zip(new, got, strict=False))
        first = dict(zip(whole, got[len(new) :], strict=True))
        yield from ((first[h], map(known.__getitem__, t)) for h, t in zip(heads, tails, strict=True))
        for x in new:
            if len(x) > MAX_CHARS or _odd(x):
                del known[x]
