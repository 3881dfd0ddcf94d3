"""Token ids of whole texts with a public tokenizer file, for the operators that write or pack them."""

from __future__ import annotations

import os
import re
from functools import lru_cache

from costproof.llm.texts import chunks

ID_BYTES = 4
# Distinct words and pieces a worker remembers; beyond them the library is asked again.
WORDS_KEPT = 400_000
PIECES_KEPT = 200_000
# Fixed value: how the tokenizer file splits lower-case ASCII before merging.
_ASCII_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")
_ASCII_WORD = re.compile(rb"[\x21-\x7E]+")
# Latin letters that are their own composed form and have a plain lower case.
_LATIN_WORD = re.compile(r"[\x21-\x7E\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+")


class WordIds(dict):
    """Ids of each word as little-endian unsigned 32-bit integers, as the library gives them.

    Words are what stands between ASCII white space. The tokenizer splits there before it merges, so a text's
    ids are its words' ids one after the other, and each distinct word is encoded once per worker.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self._whole = Tokenizer.from_file(path)
        self._model, self._splitter = self._whole.model, self._whole.pre_tokenizer
        self._pieces: dict[str, bytes] = {}

    def __missing__(self, word: bytes) -> bytes:
        if b"<|" in word:
            found = self._encode(word.decode("utf-8", "replace"))
        elif _ASCII_WORD.fullmatch(word):
            found = b"".join(map(self._piece, _ASCII_PIECES.findall(word.decode("ascii").lower())))
        else:
            text = word.decode("utf-8", "replace")
            if _LATIN_WORD.fullmatch(text):
                split = self._splitter.pre_tokenize_str(text.lower())
                found = b"".join([self._piece(piece) for piece, _ in split])
            else:
                found = self._encode(text)
        if len(self) < WORDS_KEPT:
            self[word] = found
        return found

    def _encode(self, text: str) -> bytes:
        return _packed(self._whole.encode(text, add_special_tokens=False).ids)

    def _piece(self, piece: str) -> bytes:
        found = self._pieces.get(piece)
        if found is None:
            found = _packed([t.id for t in self._model.tokenize(piece)])
            if len(self._pieces) < PIECES_KEPT:
                self._pieces[piece] = found
        return found

    def encode(self, text: bytes | None, end: int) -> bytes:
        """The ids of a whole text followed by ``end``; null is an empty text."""
        parts = [b"".join(map(self.__getitem__, part.split())) for part in chunks(text or b"")]
        return b"".join([*parts, _packed([end])])


def _packed(ids: list[int]) -> bytes:
    return b"".join(i.to_bytes(ID_BYTES, "little") for i in ids)


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """The tokenizer of a file, one per worker process."""
    return WordIds(path)


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Where a public tokenizer's file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)
