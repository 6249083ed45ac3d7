"""Exact ids of a `tokenizers` file, with the work of repeated words done once.

Where every rule of the file works between white space (a split pattern that matches none, normalisers of single characters or
of marks that follow one), the ids of a text are those of its chunks between ASCII white space. A chunk of ASCII alone or of Latin letters, where letters, digits
and cases leave no room for doubt, is split into pieces here; each different piece goes to the library's model, of whose rules only the merges are
left to apply, each different other chunk is encoded by the library with all its rules, and its ids are kept. A byte-level file that splits by the library's own pattern, whose pieces hold
white space, and whose merges stand in the order of their ids, is the same thing as a table of ranks; tiktoken's core then
merges by it, and the first texts of each worker are held against the library, which does all of the work if they
differ. There, texts with characters beyond U+07FF, with rare white space, or holding the string of an added token go through the library whole, as do all texts of
other files.
"""

from __future__ import annotations

import json
import re
import struct
import zlib

import numpy as np
import regex
import tiktoken
from tokenizers import Tokenizer

#: The split pattern of byte-level tokenizers that bring none, a fixed value of the library.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Beyond U+07FF, and white space of which the two libraries could differ.
_RARE = re.compile("[^\x00-߿]|[\x1c-\x1f\x85\xa0]")
#: A pattern that takes a word of letters whole, and what stands after it; and such words of letters that normalisers only lower-case.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_WORD = re.compile("([A-Za-zÀ-ÖØ-öø-įı-ſ]+)([.,;:!?]*)")
#: Texts of each encoder that both libraries encode.
HELD_AGAINST = 20


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: printable Latin-1 for itself, the others counted up from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class _Kept(dict):
    """Text to what `make` gives for it; beyond `most` entries, those not used since as many were new are forgotten."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, text: str) -> bytes:
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        made = self[text] = self.old.get(text) or self.make(text)
        return made


class TextEncoder:
    """encode(text) gives the ids of `Tokenizer.encode(text, add_special_tokens=False)`, as an array of `dtype`."""

    def __init__(self, path: str, most: int = 600_000):
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        self.path, self._whole, self._model = path, None, None
        self.size = max(max(rules["model"]["vocab"].values()), *(t["id"] for t in rules["added_tokens"]), 0) + 1
        self.dtype, self.code = ("<u2", "H") if self.size <= 1 << 16 else ("<u4", "I")
        added = [t["content"] for t in rules["added_tokens"]]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.in_chunks = self._in_chunks(rules)
        self.core, self.left = (self._ranks(rules["model"], set(added)) if self._own_pattern(rules) else None), HELD_AGAINST
        self.pieces, self.chunks = _Kept(self._piece, most // 2), _Kept(self._chunk, most)
        self.lower = "Lowercase" in str(rules["normalizer"])
        self.pattern = regex.compile(rules["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]) if self.in_chunks else None
        self.words, self.letters = self.in_chunks and self.pattern.pattern == WORD_PATTERN, byte_letters()

    @property
    def whole(self) -> Tokenizer:
        """The library's tokenizer, loaded when it is needed."""
        if self._whole is None:
            self._whole = Tokenizer.from_file(self.path)
        return self._whole

    @staticmethod
    def _in_chunks(rules: dict) -> bool:
        """Does no rule of the file look across white space, and does none of it reach the ids?"""
        parts = (rules["pre_tokenizer"] or {}).get("pretokenizers", [])
        if [p["type"] for p in parts] != ["Split", "ByteLevel"] or parts[1]["add_prefix_space"] or parts[1]["use_regex"]:
            return False
        pattern = parts[0]["pattern"].get("Regex")
        if pattern is None or parts[0]["behavior"] != "Removed" or not parts[0]["invert"] or "(?" in pattern or re.search(r"\\[^spLN{}]|[.$ ]", pattern):
            return False
        if re.search(r"\\s", pattern.replace(r"[^\s", "")):
            return False
        normal = rules["normalizer"] or {"normalizers": []}
        known = all(r["type"] in ("NFC", "Lowercase") or r["type"] == "Replace" and r["pattern"] == {"Regex": r"\s+"} and r["content"] == " " for r in normal.get("normalizers", [normal]))
        return known and rules["model"]["type"] == "BPE"

    @staticmethod
    def _own_pattern(rules: dict) -> bool:
        """Is the file split by the library's own pattern, without a normaliser?"""
        rule = rules["pre_tokenizer"]
        return bool(rule) and rule["type"] == "ByteLevel" and rule["use_regex"] and not rule["add_prefix_space"] and rules["normalizer"] is None and rules["model"]["type"] == "BPE"

    def _ranks(self, model: dict, added: set[str]) -> tiktoken.Encoding | None:
        """The vocabulary as ranks, if merges come in the order of the ids they make."""
        vocab = model["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        made = [vocab["".join(m)] for m in merges]
        if made != sorted(made) or model["end_of_word_suffix"] or model["continuing_subword_prefix"]:
            return None
        back = {letter: byte for byte, letter in byte_letters().items()}
        ranks = {bytes(map(back.__getitem__, token)): k for token, k in vocab.items() if token not in added}
        return tiktoken.Encoding("own", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _by_library(self, text: str) -> bytes:
        ids = self.whole.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}{self.code}", *ids)

    def _piece(self, piece: str) -> bytes:
        """Of printable ASCII or of letters that _WORD takes, lower-cased: only merges are left to apply."""
        if not piece.isprintable():
            return self._by_library(piece)
        if self._model is None:
            self._model = self.whole.model
        ids = [t.id for t in self._model.tokenize(piece if piece.isascii() else "".join(map(self.letters.__getitem__, piece.encode())))]
        return struct.pack(f"<{len(ids)}{self.code}", *ids)

    def _chunk(self, chunk: bytes) -> bytes:
        text = chunk.decode()
        if self.words and (m := _WORD.fullmatch(text)):
            word, after = m.groups()
            ids = self.pieces[word.lower() if self.lower else word]
            return ids + self.pieces[after] if after else ids
        if not chunk.isascii():
            return self._by_library(text)
        parts = self.pattern.findall(text.lower() if self.lower else text)
        return self.pieces[parts[0]] if len(parts) == 1 else b"".join(map(self.pieces.__getitem__, parts))

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, self.dtype)
        special = self.added is not None and self.added.search(text)
        if self.in_chunks and not special:  # bytes are split at ASCII white space
            return np.frombuffer(b"".join(map(self.chunks.__getitem__, text.encode().split())), self.dtype)
        if self.core is None or special or _RARE.search(text):
            return np.frombuffer(self._by_library(text), self.dtype)
        ids = self.core.encode_to_numpy(text, disallowed_special=()).astype(self.dtype)
        if self.left:
            self.left -= 1
            own = np.frombuffer(self._by_library(text), self.dtype)
            if not np.array_equal(ids, own):
                self.core = None
                return own
            if not self.left:
                self._whole = None  # rarely needed from here on
        return ids


def vocabulary_size(path: str) -> int:
    """How many ids the file has, added tokens included."""
    with open(path, encoding="utf-8") as f:
        rules = json.load(f)
    return max(max(rules["model"]["vocab"].values()), *(t["id"] for t in rules["added_tokens"]), 0) + 1


_encoders: dict[str, TextEncoder] = {}


def encoder(path: str) -> TextEncoder:
    """One for each Python worker, made anew when the file changes."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = TextEncoder(path)
    return _encoders[path]


def crc32_of(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())
