"""Public vocabularies: ids of texts, and the bytes that ids stand for.

The files are installed on every worker; their paths are parameters.
"""

from __future__ import annotations

import base64
import json
import re
from functools import lru_cache

import numpy as np

# Fixed value: how the byte-level vocabularies split text before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# The splitter recurses over white space, so runs of this length are cut out before it.
LONG_RUN = 4096
_BLANK = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"  # white space of the splitter
_RUN = re.compile(f"[{_BLANK}]{{{LONG_RUN},}}")


def _byte_letters() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others as letters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteVocabulary:
    """A byte-level BPE vocabulary whose merges are ranked by their ids."""

    def __init__(self, merges: dict[bytes, int]):
        import tiktoken

        self.bytes = dict((i, b) for b, i in merges.items())
        self._split = tiktoken.Encoding("split", pat_str=SPLIT, mergeable_ranks=merges, special_tokens={})
        self._whole = tiktoken.Encoding("whole", pat_str=r"[\s\S]+", mergeable_ranks=merges, special_tokens={})

    def encode(self, text: str) -> list[int]:
        """Ids of a text; strings of special tokens are ordinary text.

        The splitter makes one piece of a run of white space, but leaves its last character to what
        follows, if anything does. Long runs are cut there and merged on their own.
        """
        run = _RUN.search(text)
        if run is None:
            return self._split.encode_ordinary(text)
        out: list[int] = []
        start = 0
        while run is not None:
            out += self._split.encode_ordinary(text[start : run.start()])
            start = run.end() - (run.end() < len(text))
            out += self._whole.encode_ordinary(text[run.start() : start])
            run = _RUN.search(text, start + 1)
        return out + self._split.encode_ordinary(text[start:])


@lru_cache(maxsize=4)
def byte_vocabulary(path: str) -> ByteVocabulary:
    """From a file of ranks (base64 of the bytes, id) or a tokenizer's JSON."""
    with open(path, "rb") as f:
        if path.endswith(".json"):
            model = json.load(f)
            letters, special = _byte_letters(), {t["id"] for t in model["added_tokens"]}
            return ByteVocabulary({bytes(letters[c] for c in t): i for t, i in model["model"]["vocab"].items() if i not in special})
        return ByteVocabulary({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})


class PieceVocabulary:
    """A sentence-piece vocabulary, which puts a space before each text."""

    def __init__(self, path: str):
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = {}
        for i in range(self._model.get_piece_size()):
            piece = self._model.id_to_piece(i)
            byte = re.fullmatch("<0x([0-9A-F]{2})>", piece)
            self.bytes[i] = bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode()

    def encode(self, text: str) -> list[int]:
        return self._model.encode(text, num_threads=1)


@lru_cache(maxsize=4)
def piece_vocabulary(path: str) -> PieceVocabulary:
    return PieceVocabulary(path)


class Spelled:
    """Byte strings by id, laid end to end, to spell many ids at once."""

    def __init__(self, strings: dict[int, bytes]):
        size = max(strings, default=-1) + 1
        parts = [strings.get(i, b"") for i in range(size)]
        self.lengths = np.array([len(p) for p in parts], np.int64)
        self._starts = np.cumsum(self.lengths) - self.lengths
        self._letters = np.frombuffer(b"".join(parts) + b"\0", np.uint8)

    def join(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(letters of all ids, end of each id)."""
        n = self.lengths[ids]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        return self._letters[np.repeat(self._starts[ids] - (ends - n), n) + np.arange(total)], ends
