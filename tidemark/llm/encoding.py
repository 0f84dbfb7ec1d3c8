"""Fast exact encoding with the tokenizers library.

Most pre-tokenizers never join characters across certain white space, so a text's ids are the ids of its pieces one
after the other.  ``PieceEncoder`` splits a text at those places, encodes each distinct piece once through the
library and keeps the ids of a bounded number of pieces.  Two kinds of tokenizer file are recognised from their
configuration; any other is applied to whole texts.  The strings of special tokens in a text become their ids, as the
library does by default, or stay ordinary text with ``special_as_text``.

* byte level with the usual pattern and no normaliser: a piece is a run of other characters with at most one space
  before it, or white space that the pattern keeps apart;
* a ``Split`` that removes white space, with a normaliser that works inside words: a piece lies between blanks.
"""

from __future__ import annotations

import json
import os
import re
import sys
import zlib
from array import array

import numpy as np

#: Unicode's White_Space property, as the library's patterns read it.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_BYTE_PIECES = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
_WORD_PIECES = re.compile("[^ \t\n\r]+")
_CACHED_BYTES, _CACHED_PIECE = 80 << 20, 2048
_ENTRY = 100  # bytes of a dictionary entry and a bytes object, about
_loaded: dict[tuple[str, bool], PieceEncoder] = {}


def _pieces_of(config: dict):
    """The pattern whose matches encode independently, or None."""
    if any(not x.get("special", False) for x in config.get("added_tokens") or ()):
        return None
    pre, norm = config.get("pre_tokenizer") or {}, config.get("normalizer")
    if config.get("model", {}).get("type") != "BPE" or config.get("truncation") or config.get("padding"):
        return None
    if norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True):
        return _BYTE_PIECES
    steps = pre.get("pretokenizers") or [pre]
    kinds = {x.get("type") for x in (norm or {}).get("normalizers", [norm or {}])}
    split = steps[0]
    if split.get("type") == "Split" and split.get("behavior") == "Removed" and split.get("invert") and kinds <= {"NFC", "Replace", "Lowercase"}:
        pattern = split.get("pattern", {}).get("Regex", "")
        if r"[^\s" in pattern and all(x.get("type") == "ByteLevel" and not x.get("use_regex", True) and not x.get("add_prefix_space", True) for x in steps[1:]):
            return _WORD_PIECES
    return None


#: Letters and signs whose pre-tokens are plain to see: they are left as they are by normalisation to composed form.
_L, _S = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff", r"!-&(-/:-@\[-`{-~"
_PLAIN = re.compile(f" ?[{_L}0-9{_S}]+")
_PLAIN_TEXT = re.compile(f"[{_L}0-9{_S} \t\n\r]+")
_PRE_TOKENS = {
    _BYTE_PIECES: re.compile(f" ?[{_L}]+| ?[0-9]+| ?[{_S}]+|[ \t\n\r]+(?![^ \t\n\r])|[ \t\n\r]+"),
    _WORD_PIECES: re.compile(f"[{_L}]+|[0-9]|[{_S}]+"),
}


def _byte_letters() -> str:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else the next from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return "".join(chr(b if b in shown else next(rest)) for b in range(256))


class _Known(dict):
    """Ids of pieces; a piece that is not there is encoded.

    Holds about ``limit`` bytes of what was used last: a full table becomes the old one, from which pieces that are
    used again are taken over.  Long pieces are encoded each time.
    """

    def __init__(self, encode, limit: int = _CACHED_BYTES):
        self.encode, self.old, self.limit, self.held = encode, {}, limit, 0

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = self.encode(piece)
        size = sys.getsizeof(piece) + len(ids) + _ENTRY
        if size > _CACHED_PIECE:
            return ids
        self.held += size
        if self.held > self.limit // 2:
            self.old, self.held = dict(self), size
            self.clear()
        self[piece] = ids
        return ids


class PieceEncoder:
    """Encodes texts to little-endian id bytes, 2 bytes an id if the vocabulary allows it, else 4."""

    def __init__(self, path: str, pieces: bool = True, special_as_text: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 65536 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        marks = [] if special_as_text else config.get("added_tokens") or []
        plain = not any(x.get(k) for x in marks for k in ("lstrip", "rstrip", "single_word", "normalized"))
        self.pattern = _pieces_of(config) if pieces and plain else None
        self.special = {x["content"]: np.array([x["id"]], self.dtype).tobytes() for x in marks if x["content"]}
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.known, self.model, self.letters = _Known(self._piece, _CACHED_BYTES // 2), self.tokenizer.model, _byte_letters()
        self.lower = any(x.get("type") == "Lowercase" for x in (config.get("normalizer") or {}).get("normalizers", []))
        self.pre_tokens = _PRE_TOKENS.get(self.pattern)
        self.single = _Known(self._pre_token)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _pre_token(self, text: str) -> bytes:
        if text.isascii() and text.isprintable() and " " not in text[1:]:  # such letters stand for themselves
            shown = self.letters[32] + text[1:] if text[0] == " " else text
        else:
            shown = text.encode().decode("latin-1").translate(self.letters)
        ids = array(self.code, [t.id for t in self.model.tokenize(shown)])
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def _piece(self, piece: str) -> bytes:
        """Ids of a piece: by the library's model alone where its pre-tokens are plain, else by the whole tokenizer."""
        if not _PLAIN.fullmatch(piece):
            return self._whole(piece)
        parts = self.pre_tokens.findall(piece.lower() if self.lower else piece)
        return self._pre_token(parts[0]) if len(parts) == 1 else b"".join([self.single[p] for p in parts])

    def encode(self, text: str | None) -> bytes:
        """Ids of the whole text; null is empty."""
        if not text:
            return b""
        if self.pattern is None:
            return self._whole(text)
        if self.marks and self.marks.search(text):  # the library, too, encodes what lies between special tokens by itself
            return b"".join([self.special.get(x) or self._between(x) for x in self.marks.split(text)])
        return self._between(text)

    def _between(self, text: str) -> bytes:
        if len(text) <= 1 << 23:
            if _PLAIN_TEXT.fullmatch(text):
                return b"".join(map(self.single.__getitem__, self.pre_tokens.findall(text.lower() if self.lower else text)))
            return b"".join(map(self.known.__getitem__, self.pattern.findall(text)))
        parts, held = [], []  # a bounded number of pieces at a time
        for match in self.pattern.finditer(text):
            held.append(match[0])
            if len(held) >= 1 << 18:
                parts.append(b"".join(map(self.known.__getitem__, held)))
                held = []
        return b"".join([*parts, *map(self.known.__getitem__, held)])


def encoder(path: str, special_as_text: bool = False) -> PieceEncoder:
    """The process's encoder for a tokenizer file."""
    key = path, special_as_text
    if key not in _loaded:
        _loaded[key] = PieceEncoder(path, special_as_text=special_as_text)
    return _loaded[key]


def crc32_of_ids(ids: np.ndarray) -> int:
    """Unsigned CRC-32 of the ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())
