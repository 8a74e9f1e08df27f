"""Token ids of whole texts by the ``tokenizers`` library, memoised by word.

Both public vocabularies split their input before white space that follows other
characters, so the ids of a text are the ids of its chunks in turn, a chunk being some white
space with the run of other characters after it. Each distinct chunk goes through the
library (normaliser, pre-tokeniser, model) once; a dictionary of bounded size keeps its ids
as little-endian unsigned 32-bit bytes, which are joined for each text.

A text is first cut at the vocabulary's added tokens (``<|endoftext|>`` and the like), as the
library does: their ids stand for them wherever they are written in a text. Where documents
must not be able to write control tokens, ``special_as_text`` makes special ones plain text.
"""

from __future__ import annotations

import re
import weakref
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa

#: Unicode's White_Space characters.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0                　"
_CHUNKS = re.compile(f"[{WHITE_SPACE}]*[^{WHITE_SPACE}]+|[{WHITE_SPACE}]+")
_OTHER_SPACE = [c for c in WHITE_SPACE if c not in " \n"]
#: Latin letters, alone or with closing marks: such a chunk is one or two pre-tokens.
_WORD = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?#$%&*|]*)")
#: Chunks remembered by one Python worker, about 200 bytes each.
CACHE_CHUNKS = 1_400_000


def vocabulary_path(name: str) -> str:
    """Place of a public vocabulary file by its name."""
    import public_tokenizers

    return public_tokenizers.path(name)


class ChunkCodec:
    """Ids of texts for one vocabulary file."""

    def __init__(self, path: str, cache_chunks: int = CACHE_CHUNKS, special_as_text: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        added = {i: t for i, t in self.tokenizer.get_added_tokens_decoder().items() if not (special_as_text and t.special)}
        # Only tokens that are found as they stand can be cut at here.
        self.plain = not any(t.normalized or t.lstrip or t.rstrip or t.single_word for t in added.values())
        self.added = {t.content: i.to_bytes(4, "little") for i, t in added.items()}
        self.cut = re.compile("(" + "|".join(sorted(map(re.escape, self.added), key=len, reverse=True)) + ")") if added else None
        self.model = self.tokenizer.model
        self.split = self.tokenizer.pre_tokenizer.pre_tokenize_str
        normalizer = self.tokenizer.normalizer
        self.normalize = normalizer.normalize_str if normalizer else lambda s: s
        self.lower = self.normalize("X") == "x"
        self.space = self._spelled(" x")[:-1]
        # The vocabulary's character for each byte, read from the library.
        self.bytes = {b: self._spelled(bytes([b]).decode("latin-1"))[-1] for b in range(128) if chr(b).isalpha()}
        for c in range(0xC0, 0x100):
            low, high = chr(c).encode()[::-1]
            if len(s := self._spelled(chr(c), raw=True)) == 2:
                self.bytes |= {high: s[0], low: s[1]}
        self.after_space = Memo(self._after_space, cache_chunks)
        self.bare = Memo(lambda c: self._chunk(c, c, ""), cache_chunks // 8)

    def _spelled(self, text: str, raw: bool = False) -> str:
        return "".join(p for p, _ in self.split(text if raw else self.normalize(text)))

    def _model(self, pre_tokens: list[str]) -> bytes:
        return array("I", [t.id for p in pre_tokens for t in self.model.tokenize(p)]).tobytes()

    def _library(self, chunk: str) -> bytes:
        return self._model([p for p, _ in self.split(self.normalize(chunk))])

    def _after_space(self, piece: str) -> bytes:
        """Ids of what follows a space; a line feed in front stands in the space's place."""
        if piece.isascii() and piece.isalpha():
            return self._model([self.space + (piece.lower() if self.lower else piece)])
        if piece[:1] == "\n":
            return self.bare["\n"] + self.bare[piece[1:]] if _WORD.fullmatch(piece, 1) else self._library(piece)
        return self._chunk(piece, " " + piece, self.space)

    def _chunk(self, piece: str, chunk: str, before: str) -> bytes:
        if not (m := _WORD.fullmatch(piece)):
            return self._library(chunk)
        if m[2]:
            return (self.after_space if chunk is not piece else self.bare)[m[1]] + self.bare[m[2]]
        word = piece.lower() if self.lower else piece
        return self._model([before + (word if word.isascii() else word.encode().decode("latin-1").translate(self.bytes))])

    def encode(self, text: str | None) -> bytes:
        """All ids of one text as little-endian unsigned 32-bit integers; of null, none."""
        if not text:
            return b""
        if not self.plain:
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        if any(token in text for token in self.added):
            return b"".join(self.added[x] if k % 2 else self._plain(x) for k, x in enumerate(self.cut.split(text)))
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        if not text:
            return b""
        self.after_space.age()
        self.bare.age()
        if "  " in text or "\n\n" in text or " \n" in text or "\n " in text or any(c in text for c in _OTHER_SPACE):
            return b"".join(map(self.bare.__getitem__, _CHUNKS.findall(text)))
        first, *rest = text.replace("\n", " \n").split(" ")
        return (self.bare[first] if first else b"") + b"".join(map(self.after_space.__getitem__, rest))


class Memo(dict):
    """Remembers what ``make`` gives, in two generations of bounded size: what is asked for
    again while it is in the older one is kept, the rest is forgotten with it."""

    def __init__(self, make, size: int):
        self.make, self.size, self.older = make, size, {}
        _memos.append(weakref.ref(self))

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value

    def age(self) -> None:
        if len(self) > self.size // 2:
            self.older = dict(self)
            self.clear()


_memos: list[weakref.ref] = []
_owner = ""


def claim(owner: str) -> None:
    """What a reused Python worker remembers for other operators is forgotten, so that their
    bounds do not add up."""
    global _owner
    if owner == _owner:
        return
    _owner = owner
    _codec.cache_clear()
    for ref in list(_memos):
        if (memo := ref()) is None:
            _memos.remove(ref)
        else:
            memo.older = {}
            memo.clear()


def slices(batches: Iterable[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in smaller ones, so that what is made of one and not yet sent stays small;
    at the end Arrow gives back what it holds in reserve."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
    pa.default_memory_pool().release_unused()


@lru_cache(maxsize=1)
def _codec(path: str, cache_chunks: int, special_as_text: bool) -> ChunkCodec:
    return ChunkCodec(path, cache_chunks, special_as_text)


def codec(path: str, cache_chunks: int = CACHE_CHUNKS, special_as_text: bool = False) -> ChunkCodec:
    """One codec for a vocabulary and Python worker; it outlives a task."""
    claim(f"tokens of {path} {special_as_text}")
    return _codec(path, cache_chunks, special_as_text)
