"""Token ids of whole texts by the tokenizers library, with repeated words encoded once."""

from __future__ import annotations

import json
import os
import re
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The printable bytes that byte-level vocabularies write as themselves. The
#: other bytes are written, in order, as the characters from U+0100 on.
_PRINTABLE = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}

_LETTERS = "[A-Za-zÀ-ÖØ-öø-ÿ]+"
_MARKS = "[.,;:!?#*$%&|<>()]+"
_PLAIN = re.compile(f"(?:{_LETTERS}|{_MARKS}|\n(?=[^\n]))+")
_PIECE = re.compile(f"{_LETTERS}|{_MARKS}|\n")
_RUN = re.compile(r"(?:^|\s) ")
_CUT = re.compile(r"(?<=\S)(?= )")
#: Characters of texts whose parts are looked up together.
_BLOCK = 1 << 21
#: In plain text, looked up much faster than by the expression above.
_RUNS = [chr(c) + " " for c in range(128) if chr(c).isspace()]


def _byte_names() -> dict[int, str]:
    names, other = {}, 0
    for byte in range(256):
        if byte not in _PRINTABLE:
            names[byte] = chr(0x100 + other)
            other += 1
    return names


def _has_run(text: str) -> bool:
    """Whether a space begins the text or follows a blank."""
    if text.isascii():
        return text.startswith(" ") or any(run in text for run in _RUNS)
    return _RUN.search(text) is not None


class Encoder:
    """
    Ids as `Tokenizer.encode(text, add_special_tokens=False)` gives them, as little-endian
    unsigned integers of `width` bytes.

    A byte-level vocabulary splits a text into words with their leading space before it
    merges anything, so a text may be cut in front of every space that follows a
    non-blank. The parts repeat a lot: each is encoded once and kept in a table of at
    most `keep` parts; later ones are encoded anew each time. The parts that a block of texts has and the
    table lacks go through the library together, as one text: each gives the ids from one whose
    name begins with a space up to the next such. Other kinds of vocabulary are encoded text by text.
    """

    def __init__(self, path: str, keep: int = 500_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = spec.get("pre_tokenizer") or {}
        model = spec.get("model") or {}
        self.by_part = (
            split.get("type") == "ByteLevel" and split.get("use_regex", True)
            and not split.get("add_prefix_space", True) and not spec.get("normalizer")
            and model.get("type") == "BPE" and not model.get("dropout")
        )
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.width = 2 if self.size <= 1 << 16 else 4
        self.kind = f"<u{self.width}"
        self.keep = keep
        self.parts: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.names = _byte_names()
        self.spaced = np.zeros(self.size, bool)
        for name, number in self.tokenizer.get_vocab().items() if self.by_part else ():
            self.spaced[number] = name.startswith(self.names[0x20])

    def _packed(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{'H' if self.width == 2 else 'I'}", *ids)

    def _whole(self, text: str) -> bytes:
        return self._packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _piece(self, piece: str) -> bytes:
        found = self.pieces.get(piece)
        if found is None:
            if piece.isascii():  # letters and marks name themselves
                named = piece.replace(" ", self.names[0x20]).replace("\n", self.names[0x0A])
            else:
                named = piece.encode().decode("latin-1").translate(self.names)
            found = self._packed([t.id for t in self.tokenizer.model.tokenize(named)])
            if len(self.pieces) < self.keep:
                self.pieces[piece] = found
        return found

    def _part(self, part: str, spaced: bool) -> bytes:
        if part.isascii() and part.isalpha():
            return self._piece(" " + part if spaced else part)
        if part and part[0] != "\n" and _PLAIN.fullmatch(part):
            pieces = _PIECE.findall(part)
            if spaced:
                pieces[0] = " " + pieces[0]
            return b"".join(map(self._piece, pieces))
        return self._whole(" " + part if spaced else part)

    def _together(self, parts: list[str]) -> Iterable[bytes]:
        """The ids of parts that follow a space; only the last may end with a blank."""
        text = " " + " ".join(parts)
        if not any(s in text for s in self.special):
            made = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)
            ids = np.array(made[0].ids, self.kind)
            starts = np.flatnonzero(self.spaced[ids])
            if len(starts) == len(parts) and starts[0] == 0:
                edges, data = (starts * self.width).tolist(), ids.tobytes()
                return [data[a:b] for a, b in zip(edges, [*edges[1:], len(data)], strict=True)]
        return [self._part(p, True) for p in parts]

    def _by_hand(self, text: str) -> bytes:
        """The same for a text in which a space begins the text or follows a blank."""
        return b"".join(
            self._part(p[1:], True) if p[0] == " " and p[1:2] not in ("", " ") else self._whole(p)
            for p in _CUT.split(text)
        )

    def _by_parts(self, texts: list[str]) -> Iterator[bytes]:
        """The same for texts that may be cut, each distinct part of them looked up once."""
        split = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        edges = split.offsets.to_numpy()
        named = split.flatten().dictionary_encode()
        parts, at = named.dictionary.to_pylist(), named.indices.to_numpy().copy()
        found = list(map(self.parts.get, parts))
        gaps = [i for i, ids in enumerate(found) if ids is None]
        blank = np.zeros(len(parts), bool)  # ends with a blank: the end of a text, or there is a run of blanks
        blank[[i for i in gaps if not parts[i] or parts[i][-1].isspace()]] = True
        made = [parts[i] for i in gaps if not blank[i]]
        new = dict(zip(made, self._together(made), strict=True)) if made else {}
        for i in gaps:
            found[i] = self._part(parts[i], True) if blank[i] else new[parts[i]]
        self.parts.update(islice(new.items(), max(0, self.keep - len(self.parts))))
        first = edges[:-1]
        odd = np.logical_or.reduceat(blank[at], first)
        found += [self._part(parts[i], False) for i in at[first].tolist()]
        at[first] = len(parts) + np.arange(len(texts))
        ids = pa.array(found, pa.large_binary()).take(pa.array(at))
        data, stops = memoryview(ids.buffers()[2] or b""), np.frombuffer(ids.buffers()[1], "i8")[edges].tolist()
        for text, may, low, high in zip(texts, odd.tolist(), stops, stops[1:], strict=False):
            yield self._by_hand(text) if may and _has_run(text) else bytes(data[low:high])

    def _block(self, texts: list[str]) -> Iterator[bytes]:
        plain = [self.by_part and t != "" and not any(s in t for s in self.special) for t in texts]
        cut = [t for t, p in zip(texts, plain, strict=True) if p]
        made = self._by_parts(cut) if cut else iter(())
        for text, p in zip(texts, plain, strict=True):
            yield next(made) if p else self._whole(text) if text else b""

    def encode_all(self, texts: Iterable[str]) -> Iterator[bytes]:
        """The ids of each text."""
        block, size = [], 0
        for text in texts:
            block.append(text)
            size += len(text)
            if size >= _BLOCK:
                yield from self._block(block)
                block, size = [], 0
        yield from self._block(block)

    def encode(self, text: str) -> bytes:
        return next(self._block([text]))

    def ids(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encode(text), self.kind)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each worker process and vocabulary file."""
    return Encoder(path)
