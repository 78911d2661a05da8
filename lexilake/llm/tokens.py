"""Token ids of whole texts by a public vocabulary, with each distinct word encoded once per worker.

Both vocabularies split a text into pieces before they merge symbols, and no piece crosses the cuts
made here, so the ids of a text are those of its pieces in order.  A bounded table remembers pieces.
``encode_pieces`` may be the tokenizers library or another encoder with the same results.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import numpy as np

#: A worker forgets its pieces when it has met this many: a bound on memory, on which results do not depend.
REMEMBERED = 400_000

# Letters and symbols whose runs every vocabulary splits alike; other characters go the plain way.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_SYMBOLS = r"!-&(-/:-@\[-^`{-~"
_PARTS = re.compile(f"[{_LETTERS}]+|[{_SYMBOLS}]+")
_SIMPLE = re.compile(f"[{_LETTERS}{_SYMBOLS}]+").fullmatch
_ODD_SPACE = re.compile("[\x85\xa0  -     　]").search
_GAPS = ("  ", "\n\n", " \n", "\n ", "\t", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x1f", "\0")


def plain_parts(chunk: str) -> list[str] | None:
    """Runs of letters and of symbols, or None for a chunk with other characters."""
    if chunk.isascii() and chunk.isalpha():
        return [chunk]
    return None if "<|" in chunk or not _SIMPLE(chunk) else _PARTS.findall(chunk)


def lower_case(text: str) -> str:
    """Lower case where it cannot change what is a control string or a composed letter; else the text as it is."""
    if "<|" in text:
        return text
    if not text.isascii():
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text
    return text.lower()


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes.

    Null and empty texts have no ids.  Subclasses cut a text into chunks that are independent of
    their neighbours and encode chunks not met before.
    """

    #: How many times ``REMEMBERED`` this kind keeps.
    share = 1

    def __init__(self) -> None:
        self._chunks: dict[str, bytes] = {"": b""}
        self._parts: dict[str, bytes] = {}

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        known, split, out = self._chunks, self.split, []
        for text in texts:
            if not text:
                out.append(b"")
                continue
            chunks = split(text)
            if chunks is None:
                out.append(self.whole(text))
                continue
            found = list(map(known.get, chunks))
            if None in found:
                if len(known) > REMEMBERED * self.share:
                    known.clear()
                    self._parts.clear()
                    known[""] = b""
                    found = [None] * len(chunks)
                self._learn({c for c, ids in zip(chunks, found) if ids is None and c})
                found = [known[c] if ids is None else ids for c, ids in zip(chunks, found)]
            out.append(b"".join(found))
        return out

    def _learn(self, chunks: set[str]) -> None:
        known, parts_of, new = self._parts, [], set()
        for chunk in chunks:
            parts = self.parts(chunk)
            if parts is None:
                self._chunks[chunk] = self.whole(chunk)
            else:
                parts_of.append((chunk, parts))
                for part in parts:
                    if part not in known:
                        new.add(part)
        if new:
            ordered = list(new)
            known.update(zip(ordered, self.encode_parts(ordered), strict=True))
        for chunk, parts in parts_of:
            self._chunks[chunk] = known[parts[0]] if len(parts) == 1 else b"".join([known[p] for p in parts])

    def split(self, text: str) -> list[str] | None:
        raise NotImplementedError

    def parts(self, chunk: str) -> list[str] | None:
        raise NotImplementedError

    def encode_parts(self, parts: list[str]) -> list[bytes]:
        raise NotImplementedError

    def whole(self, text: str) -> bytes:
        raise NotImplementedError


def as_bytes(ids) -> bytes:
    return np.asarray(ids, dtype="<u4").tobytes()


def cut(ids: np.ndarray, starts: np.ndarray) -> list[bytes]:
    """The pieces of ``ids`` that begin at ``starts``."""
    data, at = ids.astype("<u4").tobytes(), [*(starts * 4).tolist(), len(ids) * 4]
    return [data[a:b] for a, b in zip(at, at[1:])]


class WordEncoder(Encoder):
    """A lower-case vocabulary whose pieces end in a word-end mark and which drops white space."""

    def __init__(self, path: str, end: str = "</w>") -> None:
        from tokenizers import Tokenizer

        super().__init__()
        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        size = self.library.get_vocab_size()
        self._ends = np.array([(self.library.id_to_token(i) or "").endswith(end) for i in range(size)])

    def split(self, text: str) -> list[str]:
        return lower_case(text).replace("\n", " ").split(" ")

    def parts(self, chunk: str) -> list[str] | None:
        return plain_parts(chunk)

    def encode_parts(self, parts: list[str]) -> list[bytes]:
        ids = np.array(self.library.encode(" ".join(parts), add_special_tokens=False).ids, dtype=np.int64)
        last = np.flatnonzero(self._ends[ids])
        if len(last) != len(parts):
            return [self.whole(p) for p in parts]
        return cut(ids, np.concatenate([[0], last[:-1] + 1]))

    def whole(self, text: str) -> bytes:
        return as_bytes(self.library.encode(text, add_special_tokens=False).ids)


class ByteEncoder(Encoder):
    """A byte-level vocabulary that keeps white space; a space belongs to the word after it."""

    # Case and spaces make more pieces differ.
    share = 3

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        size = self.library.get_vocab_size()
        self._spaced = np.array([(self.library.id_to_token(i) or "").startswith("Ġ") for i in range(size)])
        self._line = self.library.encode("a\nb", add_special_tokens=False).ids[1]

    def split(self, text: str) -> list[str] | None:
        for gap in _GAPS:
            if gap in text:
                return None
        if not text.isascii() and _ODD_SPACE(text):
            return None
        return text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0")

    def parts(self, chunk: str) -> list[str] | None:
        if chunk[0] != " ":
            return plain_parts(chunk)
        parts = plain_parts(chunk[1:])
        return [" " + parts[0], *parts[1:]] if parts else None

    def encode_parts(self, parts: list[str]) -> list[bytes]:
        spaced, bare = [p for p in parts if p[0] == " "], [p for p in parts if p[0] != " "]
        found = dict(zip(spaced, self._cut_at(spaced, "", lambda ids: np.flatnonzero(self._spaced[ids])), strict=True))
        if bare:
            ids = np.array(self.library.encode("\n".join(bare), add_special_tokens=False).ids, dtype=np.int64)
            lines = np.flatnonzero(ids == self._line)
            if len(lines) == len(bare) - 1:
                at = [0, *(lines + 1).tolist()]
                to = [*lines.tolist(), len(ids)]
                found.update((p, as_bytes(ids[a:b])) for p, a, b in zip(bare, at, to))
            else:
                found.update((p, self.whole(p)) for p in bare)
        return [found[p] for p in parts]

    def _cut_at(self, parts: list[str], glue: str, starts: Callable[[np.ndarray], np.ndarray]) -> list[bytes]:
        if not parts:
            return []
        ids = np.array(self.library.encode(glue.join(parts), add_special_tokens=False).ids, dtype=np.int64)
        at = starts(ids)
        return cut(ids, at) if len(at) == len(parts) else [self.whole(p) for p in parts]

    def whole(self, text: str) -> bytes:
        return as_bytes(self.library.encode(text, add_special_tokens=False).ids)


_MADE: dict[tuple, Encoder] = {}


def encoder(kind: type[Encoder], path: str) -> Encoder:
    """The worker's encoder, made once and kept between tasks."""
    key = (kind, path)
    if key not in _MADE:
        _MADE.clear()
        _MADE[key] = kind(path)
    return _MADE[key]
