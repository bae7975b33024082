"""Token ids of whole texts by a public tokenizer file, with a memo of chunks.

A byte-level BPE splits a text before each run of white space that follows
other characters, and merges never cross such a split.  So a text's ids are
the ids of its chunks (a run of white space with what follows it) in order.
Each new chunk is encoded once by the tokenizers library; its ids are kept.
Ids are those of encoding the whole text.  A tokenizer file of any other kind
(another split, a normaliser, dropout, ...) is told by its settings, and then
the library encodes each whole text.
"""

from __future__ import annotations

import functools
import json
import os
import re
from array import array

import numpy as np
import regex

from graphspark.llm import common

#: Chunks kept by one worker process before the memo starts anew.
MEMO = 350_000
#: Characters on which definitions of white space differ: such texts go to the library whole.
_ODD = re.compile("[\x0b\x0c\x1c-\x1f\x85᠎​]")
_CHUNK = re.compile(r"\s*\S+|\s+")
_kept: dict = {}
# Fixed value: the pattern by which byte-level tokenizers of this family split a text.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: itself if it prints, else the next from U+0100 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(prints)]
    return {b: chr(b) for b in prints} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


_BYTES = _byte_letters()


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def splits_by_chunks(settings: dict) -> bool:
    """Whether a tokenizer of these settings gives a text the ids of its chunks in order."""
    split, model = settings["pre_tokenizer"] or {}, settings["model"]
    plain = settings["normalizer"] is None and settings["post_processor"] is None
    plain &= split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
    plain &= model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    return bool(plain) and not any(t[k] for t in settings["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))


class _Again(Exception):
    """The text has white space that single spaces do not split."""


class _Memo(dict):
    """Values by key, made by ``make`` on first use; starts anew beyond ``most`` keys."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        value = self.make(key)
        if len(self) >= self.most:
            self.clear()
        self[key] = value
        return value


class Encoder:
    """Ids and character offsets of whole texts (null: empty)."""

    def __init__(self, path: str | None = None, added: tuple[str, ...] = ()):
        """``added``: strings that are tokens of their own beside those of the file."""
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import AddedToken, Tokenizer

        self.lib = Tokenizer.from_file(path or default_path())
        self.lib.no_truncation()
        self.lib.no_padding()
        settings = json.loads(self.lib.to_str())
        self.chunked = splits_by_chunks(settings)
        if added:
            self.lib.add_special_tokens([AddedToken(c, special=True, normalized=False) for c in added])
        self.specials = {t.content: array("I", [i]).tobytes() for i, t in self.lib.get_added_tokens_decoder().items()}
        self.special = re.compile("|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) or "(?!)").finditer
        self.model, self.split = self.lib.model, regex.compile(_PATTERN).findall
        self.words = _Memo(self._word, MEMO)  # of pretokens
        self.after = _Memo(self._after, MEMO)  # of a chunk that follows one space, without it
        self.first = _Memo(self._chunk, MEMO // 4)  # of any other chunk, as it is

    @classmethod
    def of(cls, path: str | None = None, added: tuple[str, ...] = ()) -> "Encoder":
        """One encoder for each worker process."""
        common.claim("tokens", _kept.clear)
        if (path, added) not in _kept:
            _kept[path, added] = cls(path, added)
        return _kept[path, added]

    @functools.cached_property
    def n_bytes(self) -> np.ndarray:
        """Bytes of text that each id stands for."""
        out = np.zeros(self.lib.get_vocab_size(), dtype=np.int64)
        for value, i in self.lib.get_vocab(with_added_tokens=False).items():
            out[i] = len(value)
        for i, t in self.lib.get_added_tokens_decoder().items():
            out[i] = len(t.content.encode())
        return out

    def _word(self, p: str) -> bytes:
        bare = p[1:] if p[0] == " " else p
        if bare.isascii() and bare.isalpha():
            mapped = p if bare is p else "Ġ" + bare
        else:
            mapped = p.encode().decode("latin-1").translate(_BYTES)
        return array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        return b"".join([self.words[p] for p in self.split(chunk)])

    def _after(self, piece: str):
        if not piece or piece[0].isspace() or piece[-1].isspace():
            raise _Again
        return self._word(" " + piece) if piece.isalpha() else self._chunk(" " + piece)

    def _parts(self, text: str) -> list[bytes] | None:
        """Ids of the chunks of a text; None where the library has to see the whole."""
        if not self.chunked or _ODD.search(text):
            return None
        if any(s in text for s in self.specials):  # they split a text before all else
            out, at = [], 0
            for m in self.special(text):
                out += [*(self._plain(text[at : m.start()]) if m.start() > at else ()), self.specials[m[0]]]
                at = m.end()
            return out + (self._plain(text[at:]) if at < len(text) else [])
        return self._plain(text)

    def _plain(self, text: str) -> list[bytes]:
        pieces = text.split(" ")
        head = pieces[0]
        if head and not head[-1].isspace():
            try:
                return [self.first[head], *map(self.after.__getitem__, pieces[1:])]
            except _Again:
                pass
        return [self.first[c] for c in _CHUNK.findall(text)]

    def ids(self, text: str | None) -> np.ndarray:
        """Ids of one text, as '<u4'."""
        if not text:
            return np.empty(0, dtype="<u4")
        if (found := self._parts(text)) is None:
            return np.asarray(self.lib.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return np.frombuffer(b"".join(found), dtype="<u4")

    def spans(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, starts, ends) of one text, in characters, end exclusive.

        The ids' bytes tile the text.  Tokens that share a character both span it.
        """
        if not self.chunked and text:
            got = self.lib.encode(text, add_special_tokens=False)
            at = np.array(got.offsets, dtype=np.int64).reshape(-1, 2)
            return np.asarray(got.ids, dtype="<u4"), at[:, 0], at[:, 1]
        ids = self.ids(text)
        if not len(ids):
            return ids, np.empty(0, np.int64), np.empty(0, np.int64)
        ends = np.cumsum(self.n_bytes[ids])
        starts = np.concatenate([[0], ends[:-1]])
        if len(text) != ends[-1]:
            begun = np.cumsum((np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80)
            starts, ends = begun[starts] - 1, begun[ends - 1]
        return ids, starts, ends
