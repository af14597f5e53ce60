"""Token ids of whole texts by a `tokenizers` file, with the model run once per distinct piece.

A byte-pair tokenizer cuts a text into pieces before it merges, and no merge crosses a piece. So a
text is parted at white space into chunks, each distinct chunk is cut into pieces by the file's own pattern, and
the library's model encodes each distinct piece once per worker. Texts in which this parting is not
certain to be the library's (rare spaces, letters beyond Latin, special strings) are given to the library whole.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import regex

MOST_CHUNKS = 500_000  # remembered per worker and generation; two generations are kept

#: Texts with any of these go to the library whole: control spaces, and characters from U+0250 on.
_RARE = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f\x85\xa0\xadİıŉſɐ-\U0010ffff]")
_SPECIAL = "<|"


def printable_bytes() -> dict[int, str]:
    """The letter that stands for each byte: visible Latin-1 characters for themselves, others from U+0100 on in order."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(visible)]
    return {**{b: chr(b) for b in visible}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


_LETTERS = "".join(c for _, c in sorted(printable_bytes().items()))

#: The cutting pattern of byte-level BPE files that use the default one.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class PieceEncoder:
    """Encoder of one tokenizer file; kinds of files other than the two known ones are encoded by the library whole."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        pre, normal = made.get("pre_tokenizer") or {}, made.get("normalizer")
        self.lower = False
        self.chunk = None
        plain = not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in made["added_tokens"]) and all(_SPECIAL in t["content"] for t in made["added_tokens"])
        if plain and made["model"]["type"] == "BPE" and not made["model"].get("dropout"):
            if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and normal is None:
                self.chunk, self.pattern = re.compile(r"[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+"), regex.compile(BYTE_PATTERN)
            elif pre.get("type") == "Sequence" and [x["type"] for x in pre["pretokenizers"]] == ["Split", "ByteLevel"] and normal and [x["type"] for x in normal["normalizers"]] == ["NFC", "Replace", "Lowercase"]:
                split = pre["pretokenizers"][0]
                if split["behavior"] == "Removed" and split["invert"] and not pre["pretokenizers"][1]["use_regex"]:
                    self.chunk, self.pattern, self.lower = re.compile(r"[^ \t\n\r]+"), regex.compile(split["pattern"]["Regex"]), True
        self.chunks: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        mapped = piece if piece.isascii() and piece.isalnum() else "".join([_LETTERS[b] for b in piece.encode()])
        return array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()

    def _mark(self, mark: str) -> bytes:
        if mark not in self.marks:
            self.marks[mark] = self._piece(mark)
        return self.marks[mark]

    def _new(self, chunk: str) -> bytes:
        """Ids of a chunk that is not in the younger memory; letters alone, or with one stop behind, need no pattern."""
        ids = self.older.get(chunk)
        if ids is None:
            word = chunk[1:] if chunk[0] == " " else chunk
            if word.isalpha():
                ids = self._piece(chunk)
            elif word[:-1].isalpha() and word[-1] in ".,":
                ids = (self.chunks.get(chunk[:-1]) or self._new(chunk[:-1])) + self._mark(word[-1])
            else:
                ids = b"".join([self._piece(p) for p in self.pattern.findall(chunk)])
        if len(self.chunks) >= MOST_CHUNKS:  # the younger memory becomes the older one, whose frequent chunks come back as they are met
            self.older, self.chunks = self.chunks, {}
        self.chunks[chunk] = ids
        return ids

    def ids_of_chunk(self, chunk: str) -> bytes:
        """Ids of one chunk of a text that is parted."""
        return self.chunks.get(chunk) or self._new(chunk)

    def ids(self, text: str) -> bytes:
        """Ids of a whole text as native unsigned 32-bit integers; no special tokens added."""
        if self.chunk is None or _SPECIAL in text or _RARE.search(text):
            return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()
        known, new = self.chunks.get, self._new
        if self.lower:
            return b"".join([known(c) or new(c) for c in text.lower().split()])
        return b"".join([known(c) or new(c) for c in self.chunk.findall(text)])

    def count(self, text: str) -> int:
        return len(self.ids(text)) // 4


_made: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """The worker's encoder of a file; its memory outlives a task."""
    if path not in _made:
        _made[path] = PieceEncoder(path)
    return _made[path]
