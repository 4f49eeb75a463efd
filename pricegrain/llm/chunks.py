"""Texts as sequences of chunks that the tokenizers' split pattern never looks across, so that a chunk's ids can be kept and reused."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import regex

_SAFE_CUT = regex.compile(r"(?<=\S)(?= \S)")
#: Chunks kept per worker; beyond it the store starts anew, so that memory stays bounded whatever the corpus holds.
KEPT_CHUNKS = 250_000
KEPT_CHARS = 64


def split(text: str) -> list[str]:
    """Chunks whose concatenation is text. Before a single space that follows and precedes a non-space, and around a
    single line end between non-spaces, every match of the pattern ends; other texts are cut by regular expression at
    the former places alone."""
    if not text:
        return []
    usual = (
        "  " not in text and "\n\n" not in text and " \n" not in text and "\n " not in text
        and text[0] not in " \n" and text[-1] not in " \n"
        and text.replace("\n", "").isprintable()  # no other white space, no U+0000
    )
    return text.replace(" ", "\x00 ").replace("\n", "\x00\n\x00").split("\x00") if usual else _SAFE_CUT.split(text)


class ChunkStore(dict):
    """Chunk to its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, encode_all: Callable[[list[str]], Iterable[bytes]]):
        super().__init__()
        self.encode_all = encode_all

    def encode(self, texts: list[str]) -> list[bytes]:
        split_texts = [split(t) for t in texts]
        missing = list(set().union(*split_texts).difference(self)) if split_texts else []
        extra = {}
        if missing:
            if len(self) + len(missing) > KEPT_CHUNKS:
                self.clear()
                missing = list(set().union(*split_texts))
            self.update(zip(missing, self.encode_all(missing), strict=True))
            extra = [k for k in missing if len(k) > KEPT_CHARS]
        get = self.__getitem__
        found = [b"".join(map(get, chunks)) for chunks in split_texts]
        for k in extra:  # long ones do not come again
            del self[k]
        return found


def in_batches(texts: Iterable[str], chars: int = 3_000_000) -> Iterable[tuple[int, list[str]]]:
    """(index of the first, texts) of at most so many characters together, one text at least."""
    own, start, total = [], 0, 0
    for i, t in enumerate(texts):
        if own and total + len(t) > chars:
            yield start, own
            own, start, total = [], i, 0
        own.append(t)
        total += len(t)
    if own:
        yield start, own
