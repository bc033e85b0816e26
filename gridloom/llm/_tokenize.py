"""Exact and fast ids of public BPE tokenizer files, word by word.

The files are read by the tokenizers library. Where a file's vocabulary numbers its merges in order, a word's merges are
carried out by tiktoken's engine, which gives the same ids several times faster; texts and words outside the plain case
(added tokens, unusual characters) go to the library itself. A cache of a bounded size is kept during a task.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterable

import regex

#: Words kept during a task: two generations of this size.
CACHE = 250_000

_loaded: dict[str, Encoder] = {}


def _byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable bytes are themselves, the others
    follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Ids of whole texts by words.

    The file has a byte-level BPE model. With an end-of-word suffix, words are the runs between spaces and line feeds;
    without one, they are the matches of the pattern `words`.
    """

    #: How byte-level tokenizers without word ends split a text (a fixed value of that format).
    words = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
    #: The same for tokenizers with word ends (a fixed value of that format).
    ended = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
    #: Characters whose case, normal form and class no version of Unicode disputes.
    plain = regex.compile(r"[\x21-\x7e¡-¬®-įı-ňŊ-ž]*")
    plain_byte = regex.compile(r"[\x20-\x7e\t\n\r¡-¬®-ſ]*")

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, self.added = spec["model"], [t["content"] for t in spec.get("added_tokens", [])]
        self.apart = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")")
        self.suffix = model.get("end_of_word_suffix") or ""
        vocab, letters = model["vocab"], _byte_letters()
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        first = 512 if self.suffix else 256
        ordered = all(vocab.get(a + b) == first + i for i, (a, b) in enumerate(merges))
        self.core = None
        if ordered and not model.get("dropout") and not model.get("ignore_merges"):
            # A byte that no UTF-8 text has marks the end of a word.
            ranks = {}
            for piece, i in vocab.items():
                if piece not in self.added:
                    end = bool(self.suffix) and piece.endswith(self.suffix)
                    ranks[bytes(letters[c] for c in (piece[: -len(self.suffix)] if end else piece)) + b"\xff" * end] = i
            ranks.setdefault(b"\xff", max(vocab.values()) + 1)
            self.core = tiktoken.Encoding("words", pat_str=r".+", mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.pieces = self._pieces(vocab, letters)
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _pieces(self, vocab: dict[str, int], letters: dict[str, int]) -> list[tuple[int, bytes]]:
        """Bytes of every id, added tokens included."""
        pieces = {i: bytes(letters[c] for c in p) if all(c in letters for c in p) else p.encode() for p, i in vocab.items()}
        for token in self.added:
            pieces[self.library.token_to_id(token)] = token.encode()
        return sorted(pieces.items())

    def _ids(self, word: str) -> bytes:
        """Ids of one word as little-endian 32-bit integers."""
        if self.core is not None:
            if self.suffix and self.plain.fullmatch(word):
                ids = [i for w in self.ended.findall(word.lower()) for i in self.core.encode_single_piece(w.encode() + b"\xff")]
                return b"".join([i.to_bytes(4, "little") for i in ids])
            if not self.suffix:
                return b"".join([i.to_bytes(4, "little") for i in self.core.encode_single_piece(word.encode())])
        return b"".join([i.to_bytes(4, "little") for i in self.library.encode(word, add_special_tokens=False).ids])

    def _word(self, word: str) -> bytes:
        ids = self.new.get(word)
        if ids is None:
            ids = self.old.get(word)
            if ids is None:
                ids = self._ids(word)
            if len(self.new) >= CACHE:
                self.new, self.old = {}, self.new
            if len(word) < 64:
                self.new[word] = ids
        return ids

    def forget(self) -> None:
        """Drop the words kept so far; workers live on after a task."""
        self.new, self.old = {}, {}

    def whole(self, text: str) -> bytes:
        """Ids of a text by the library alone."""
        return b"".join([i.to_bytes(4, "little") for i in self.library.encode(text, add_special_tokens=False).ids])

    def words_of(self, text: str) -> Iterable[str | bytes]:
        """The words of a text in order, for tokenizers without word ends; added tokens come as bytes.

        Usual texts are split by `words`, others by the library's own pre-tokenizer, whose idea of letters and digits
        may be of another version of Unicode.
        """
        if self.special(text):
            for at, part in enumerate(self.apart.split(text)):
                if at % 2:
                    yield part.encode()
                else:
                    yield from self.words_of(part)
        elif self.plain_byte.fullmatch(text):
            yield from self.words.findall(text) if len(text) < 1 << 20 else (m[0] for m in self.words.finditer(text))
        else:
            yield from (text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text))

    def ids_of(self, word: str | bytes) -> list[int]:
        """Ids of a word of `words_of`."""
        if isinstance(word, bytes):
            return [self.library.token_to_id(word.decode())]
        return self.core.encode_single_piece(word.encode()) if self.core is not None else self.library.encode(word, add_special_tokens=False).ids

    def special(self, text: str) -> bool:
        return any(t in text for t in self.added)

    def split(self, text: str) -> list[str] | None:
        """The text's words, or None if the library must have the text whole."""
        if self.special(text) or self.core is None:
            return None
        if self.suffix:
            return text.replace("\n", " ").replace("\t", " ").split(" ")
        return self.words.findall(text) if self.plain_byte.fullmatch(text) else None

    def encode(self, text: str) -> bytes:
        words = self.split(text)
        if words is None:
            return self.whole(text)
        get = self.new.get
        out = [get(w) for w in words]
        if None in out:
            out = [self._word(w) if x is None else x for w, x in zip(words, out, strict=True)]
        return b"".join(out)


def encoder(path: str) -> Encoder:
    """This process's encoder of a file."""
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]
