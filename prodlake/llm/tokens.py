"""Tokenizer files behind a bounded cache of pieces.

The word vocabulary splits a text before it merges, and no piece reaches over white space.  So
a text's ids are the ids of its pieces in a row, and a piece that was seen before need not be
encoded again.  The library encodes every new piece; tests compare whole texts with it.
"""

from __future__ import annotations

import sys
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECES = 600_000  # cached pre-tokens; a cache is emptied when it is full
CACHE = 48 << 20  # bytes of cached words and their ids, as Python holds them
BATCH = 4 << 20  # bytes of text that are cut into words at a time


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_alphabet() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: printable bytes for
    themselves, the others for 256 and up."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def ragged(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs ``flat[start : start + length]`` one after the other."""
    ends = np.cumsum(lengths)
    if not len(ends):
        return flat[:0]
    kind = np.int32 if max(len(flat), ends[-1]) < 1 << 31 else np.int64
    places = np.repeat((starts - ends + lengths).astype(kind), lengths)
    places += np.arange(ends[-1], dtype=kind)
    return flat[places]


class WordEncoder:
    """Ids of texts under a lower-casing word vocabulary that drops white space.

    A batch of texts is cut into chunks between ASCII white space and each distinct chunk is
    looked up once.  Sentence marks at the end of a chunk are pieces of their own (the
    pre-tokenizer cuts between letters and marks), so most new chunks are known words.  That
    goes for the normalized text: a letter that becomes a letter and a combining mark does not
    end before the sentence mark behind it.
    """

    _MARKS = ".,;:!?"

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._pieces: dict[str, bytes] = {}
        self._held = 0
        self._letters = byte_alphabet()

    def _encode(self, piece: str) -> bytes:
        found = self._pieces.get(piece)
        if found is None:
            if piece.isalpha() and max(piece) < "\u0250" and "\u0130" not in piece:
                # Latin letters are composed already, have plain lower-case forms and are one piece
                spelled = "".join([self._letters[b] for b in piece.lower().encode()])
                ids = [token.id for token in self._tokenizer.model.tokenize(spelled)]
            else:
                ids = self._tokenizer.encode(piece, add_special_tokens=False).ids
            found = array("I", ids).tobytes()
            if self._held >= CACHE:
                self._pieces.clear()
                self._held = 0
            self._pieces[piece] = found
            self._held += sys.getsizeof(piece) + sys.getsizeof(found) + 100  # and its place in the table
        return found

    def _chunk(self, chunk: str) -> bytes:
        found = self._pieces.get(chunk)
        if found is not None:
            return found
        stem = chunk.rstrip(self._MARKS)
        if len(stem) < len(chunk) and stem and self._ends_with_letter(stem):
            return self._encode(stem) + self._encode(chunk[len(stem) :])
        return self._encode(chunk)

    def _ends_with_letter(self, stem: str) -> bool:
        """Whether the normal form of ``stem`` does; ASCII letters stay letters."""
        if stem[-1] < "\x80":
            return stem[-1].isalpha()
        return self._tokenizer.normalizer.normalize_str(stem)[-1:].isalpha()

    @staticmethod
    def _lower(text: str) -> bytes:
        """ASCII letters may be lower-cased first where no special token is spelled and no
        combining mark (lead bytes cc and cd) could join one of them."""
        data = text.encode()
        return data if b"<|" in data or b"\xcc" in data or b"\xcd" in data else data.lower()

    def _together(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        chunks = pc.ascii_split_whitespace(pa.array(texts, pa.large_binary()).cast(pa.large_string()))
        bounds = chunks.offsets.to_numpy()
        coded = chunks.values.dictionary_encode()
        known = [self._chunk(c) for c in coded.dictionary.to_numpy(zero_copy_only=False)]
        lengths = np.fromiter(map(len, known), np.int64, len(known)) // 4
        starts = np.cumsum(lengths) - lengths
        place = coded.indices.to_numpy()
        sizes = lengths[place]
        ids = ragged(np.frombuffer(b"".join(known), np.uint32), starts[place], sizes)
        return ids, np.concatenate([[0], np.cumsum(sizes)])[bounds]

    def encode(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text; null counts as empty.  Texts are taken in as they are needed."""
        held, size = [], 0
        for text in texts:
            held.append(self._lower(text or ""))
            size += len(held[-1])
            if size >= BATCH:
                yield from self._split(held)
                held, size = [], 0
        if held:
            yield from self._split(held)

    def _split(self, texts: list[bytes]) -> list[np.ndarray]:
        ids, bounds = self._together(texts)
        return np.split(ids, bounds[1:-1])
