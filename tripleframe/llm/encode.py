"""Token ids of whole texts by the ``tokenizers`` library, with a bounded cache of words.

The byte-level pattern never joins a blank that follows a visible character to what stands before it, so
a text may be cut before every such blank and its parts encoded on their own: the ids of the whole are
those of the parts in a row.  Likewise a run of punctuation after a letter or digit is a part of its own.
Parts come back often, so each worker process keeps the ids of up to ``CACHE_WORDS`` of them, and the
library encodes only parts that are new.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache
from itertools import islice

from tripleframe.llm.caches import claim, register

CACHE_WORDS = 200_000
END_ID = 0

_CUT = re.compile(r"(?<=\S)(?= )")
_MARKS = ".,!?;:#$%&*|)"


def _byte_signs() -> dict[int, str]:
    """The printable sign that byte-level vocabularies write for every byte."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return {b: chr(b) if b in printable else chr(next(others)) for b in range(256)}


class _Parts(dict):
    """Ids of parts as little-endian unsigned 32-bit bytes; ``None`` marks a part after which no cut is allowed.

    When full, it starts anew and asks its predecessor first, so that frequent parts stay.
    """

    def __init__(self, tokenizer, before: str, plain: _Parts | None = None) -> None:
        super().__init__()
        self.tokenizer, self.word, self.before = tokenizer, tokenizer.model.tokenize, before
        self.signs, self.older, self.plain = _byte_signs(), {}, self if plain is None else plain
        self.line_end = self.encoded("\n")

    def __missing__(self, part: str) -> bytes | None:
        ids = self.older[part] if part in self.older else self.ids(part)
        if len(self) >= CACHE_WORDS:
            self.older = dict(self)
            self.clear()
        self[part] = ids
        return ids

    def ids(self, part: str) -> bytes | None:
        if part.isalpha():  # one word to the pattern, so the model can take it directly
            tokens = self.word((self.before + part).encode().decode("latin-1").translate(self.signs))
            return array("I", [t.id for t in tokens]).tobytes()
        stem = part.rstrip(_MARKS)
        if stem != part and stem and stem[-1].isalnum():
            return self[stem] + self.plain[part[len(stem):]]
        lines = part.split("\n")
        if len(lines) > 1 and all(x and not x[0].isspace() and not x[-1].isspace() for x in lines):
            return self.line_end.join([self[lines[0]], *map(self.plain.__getitem__, lines[1:])])
        if self.before and (not part or part[-1].isspace()):
            return None
        return self.encoded(self.before + part)

    def encoded(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()


class Encoder:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.whole = _Parts(self.tokenizer, "")
        self.after_blank = _Parts(self.tokenizer, " ", self.whole)

    def encode(self, text: str | None) -> bytes:
        """The ids of a text (NULL counts as empty), without an end id."""
        if not text:
            return b""
        parts = text.split(" ")
        first = parts[0]
        if len(parts) > 1 and (not first or first[-1].isspace()):
            return self._cut(text)
        try:
            return self.whole[first] + b"".join(map(self.after_blank.__getitem__, islice(parts, 1, None)))
        except TypeError:
            return self._cut(text)

    def _cut(self, text: str) -> bytes:
        """The same for texts with runs of white space: cut only before blanks that follow a visible character."""
        return b"".join(map(self.whole.__getitem__, _CUT.split(text)))


    def forget(self) -> None:
        for parts in (self.whole, self.after_blank):
            parts.older = {}
            parts.clear()


@lru_cache(maxsize=4)
def _encoder(path: str) -> Encoder:
    made = Encoder(path)
    register("encode", made.forget)
    return made


def encoder(path: str) -> Encoder:
    """The encoder of this process; other operators' caches give way."""
    claim("encode")
    return _encoder(path)


def with_end(ids: bytes) -> bytes:
    return ids + END_ID.to_bytes(4, "little")
