"""Splitting of text ahead of byte-level BPE: white-space chunks first, then the pattern of the vocabulary inside a chunk."""

from __future__ import annotations

import re

#: White space as the Unicode property has it (fixed values).
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

#: A chunk is a run without white space, with one space before it if there is one, or white space. Since the last space before
#: a run goes with the run and no pattern match crosses from a run to white space, splitting a chunk by itself gives
#: the same pieces as splitting the text.
CHUNK = re.compile(rf" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")


def piece_pattern(pattern: str) -> str:
    """The vocabulary's pattern with white space written out, so that it does not depend on a library's idea of it."""
    return pattern.replace(r"(?!\S)", f"(?![^{WHITE}])").replace(r"[^\s", f"[^{WHITE}").replace(r"\s", f"[{WHITE}]")


class Memo(dict):
    """A dictionary of bounded size: when half is full, what was not looked for since the last turn is forgotten."""

    def __init__(self, most: int):
        super().__init__()
        self.half = most // 2
        self.older: dict = {}

    def room(self) -> None:
        if len(self) > self.half:
            self.older = dict(self)
            self.clear()

    def missing(self, keys) -> list:
        """Those keys that are not held; held ones count as looked for."""
        out = []
        for k in keys:
            if k not in self:
                v = self.older.get(k)
                if v is None:
                    out.append(k)
                else:
                    self[k] = v
        return out


def chunks_of(texts: list[str], memo: Memo) -> tuple[list[list[str]], list[str]]:
    """Chunks of each text, and the distinct ones that ``memo`` lacks."""
    split = [CHUNK.findall(t) for t in texts]
    seen = set()
    for s in split:
        seen.update(s)
    return split, memo.missing(seen)
