"""Ids and counts of public tokenizers, a unit at a time.

Both tokenizers cut a text at white space before they merge anything, so the ids of a text are those
of its white-space-delimited units in turn.  Each unit is encoded once and kept; texts in which the cut
could differ from a plain split (special strings, runs of white space, separators that only one side
counts as white space) are encoded whole.
"""

from __future__ import annotations

import base64
import re
from array import array
from pathlib import Path

_ODD = re.compile("[\x1c-\x1f]")
#: White space other than a space or a line feed.
_OTHER_SPACE = re.compile(r"[^\S \n]")


def load(name: str):
    """A tokenizer of the ``tokenizers`` library, from one of the public vocabulary files."""
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


class _Units(dict):
    """Encoded units.  Past ``most`` of them a new generation begins, into which the old one's come as they
    are met again, so that common units stay and memory is bounded."""

    def __init__(self, encode, most: int):
        super().__init__()
        self.encode, self.most, self.old = encode, most, {}

    def __missing__(self, unit: str) -> bytes:
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        found = self.old.get(unit)
        if found is None:
            found = self.encode(unit)
        self[unit] = found
        return found


class ByteLevelIds:
    """Ids of a byte-level tokenizer in which a space belongs to the word after it.

    Units are encoded by ``tiktoken`` from the same vocabulary's ranks, which gives the same ids several
    times as fast; texts that are encoded whole go through ``tokenizers``.
    """

    def __init__(self, name: str, most: int = 250_000):
        import public_tokenizers
        import tiktoken

        self.tokenizer = load(name)
        lines = Path(public_tokenizers.path(name.replace(".json", ".tiktoken"))).read_bytes().splitlines()
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
        core = tiktoken.Encoding("units", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary
        self.first = _Units(lambda unit: array("I", core(unit)).tobytes(), most // 4)
        self.later = _Units(lambda unit: array("I", core(" " + unit)).tobytes(), most)
        self.newline = self._whole("\n")

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> bytes:
        """The ids as unsigned 32-bit integers."""
        if not text or "<|" in text or "  " in text or " \n" in text or "\n " in text or "\n\n" in text or text[0] in " \n" or text[-1] in " \n" or _OTHER_SPACE.search(text):
            return self._whole(text) if text else b""
        later, first = self.later.__getitem__, self.first.__getitem__
        out = []
        for line in text.split("\n"):
            head, *rest = line.split(" ")
            if out:
                out.append(self.newline)
            out.append(first(head))
            out += map(later, rest)
        return b"".join(out)


class UnitCounts:
    """Numbers of ids of a tokenizer that drops white space."""

    def __init__(self, name: str):
        self.tokenizer = load(name)

    @staticmethod
    def units(text: str) -> list[str] | None:
        """The units of a text, or None if it must be encoded whole."""
        if "<|" in text or _ODD.search(text):
            return None
        return text.split()

    def whole(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def counts(self, units: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch(units, add_special_tokens=False)]
