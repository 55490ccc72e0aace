"""Token ids of texts by a tokenizers vocabulary file, white space free pieces cached."""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np

from .word_cache import Cache, quiet_collector

_PLAIN = re.compile(r"([a-zß-öø-ÿ]*)([!-&(-/:-@\[-`{-~]*)").fullmatch
# Latin-1 letters, digits, blanks, full stops and commas: text of these alone lower-cases letter by letter.
_SIMPLE = bytes(b for b in range(256) if chr(b).isalnum() or chr(b) in " \n\t\r.,")
_RUNS = ("..", ".,", ",.", ",,")


_MADE: dict[str, WordTokens] = {}


def shared_coder(path: str) -> WordTokens:
    """The coder of this Python worker, which keeps its caches from task to task."""
    if path not in _MADE:
        _MADE[path] = WordTokens(path)
    return _MADE[path]


class WordTokens:
    """encode(text) is what Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids gives, as bytes.

    The vocabulary must be one that drops white space and splits at it, so that pieces between blanks can be coded
    alone; others are refused. A piece of Latin-1 letters followed by ASCII marks is looked up in the model by its
    two parts, any other piece goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as file:
            config = json.load(file)
        first = (config.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
        steps = [n["type"] for n in (config.get("normalizer") or {}).get("normalizers", [])]
        if first.get("behavior") != "Removed" or not first.get("invert") or steps != ["NFC", "Replace", "Lowercase"]:
            raise ValueError(f"{path} does not drop white space between words")
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.code = "H" if self.kind == "<u2" else "I"
        self.special = [t["content"] for t in config.get("added_tokens", [])]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.byte_chars = {**{b: chr(b) for b in shown}, **{b: chr(256 + i) for i, b in enumerate(hidden)}}
        self.parts = Cache(self._part)
        self.pieces = Cache(self._piece)
        quiet_collector()

    def _pack(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def _part(self, part: str) -> bytes:
        if not part.isascii():
            part = part.encode().decode("latin-1").translate(self.byte_chars)
        return self._pack([t.id for t in self.model.tokenize(part)])

    def _piece(self, piece: str) -> bytes:
        plain = _PLAIN(piece.lower())
        if plain is None or any(s in piece for s in self.special):
            return self._pack(self.tokenizer.encode(piece, add_special_tokens=False).ids)
        return b"".join(self.parts[p] for p in plain.groups() if p)

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text.

        Latin-1 texts are lowered ahead unless that could make a special token, whose case matters. Where stops and
        commas are the only marks and stand alone, those ahead of a blank are made pieces of their own.
        """
        try:
            other = text.encode("latin-1").translate(None, _SIMPLE)
        except UnicodeEncodeError:
            other = None
        if other is not None:
            low = text.lower()
            if not other:
                text = low
                if not any(r in low for r in _RUNS):
                    text = (text.replace(". ", " . ").replace(", ", " , ").replace(".\n", " .\n")
                            .replace(",\n", " ,\n"))
            elif not any(s in low for s in self.special):
                text = low
        pieces = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        self.pieces.trim()
        self.parts.trim()
        coded = self.pieces
        coded[""] = b""
        return np.frombuffer(b"".join(map(coded.__getitem__, pieces)), self.kind)
