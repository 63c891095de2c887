"""Exact public-tokenizer ids at word speed.

Both vocabularies used here never merge across a word boundary, so a text's ids
are those of its words in a row. Words are looked up in a bounded cache; a
batch's new words go through a byte-pair encoder in one call. Texts with
characters outside a plain range take the reference library's own path, whole.
Ids equal the library's in every case (tests compare them).
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np
import tiktoken

#: Characters for which lower-casing and normal forms are one to one: ASCII, and Latin-1 letters and signs.
_PLAIN = re.compile("[\t\n\r -~¡-¬®-ÿ]*")
_SEPARATOR = "\x02"
#: Ids are kept in 16 bits, with one value for the mark between words.
_MOST_IDS = 0xFFFF
#: The encoder searches for its special tokens at every position if it has none.
_NEVER = "\x03"


class WordCache(dict):
    """word -> bytes of its uint16 ids, cleared beyond ``limit`` words."""

    def __init__(self, limit: int = 250_000):
        super().__init__()
        self.limit = limit

    def joined(self, words: list[str], encode_new) -> bytes:
        try:
            return b"".join(map(self.__getitem__, words))
        except KeyError:
            pass
        if len(self) > self.limit:
            self.clear()
        new = [w for w in set(words) if w not in self]
        for word, ids in zip(new, encode_new(new)):
            self[word] = ids
        return b"".join(map(self.__getitem__, words))


def _split(ids: np.ndarray, mark: int) -> list[bytes]:
    """The runs of ``ids`` before each ``mark``."""
    ends = np.flatnonzero(ids == mark)
    raw, starts = ids.astype("<u2").tobytes(), np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    return [raw[2 * a : 2 * b] for a, b in zip(starts.tolist(), ends.tolist())]


def _byte_of_char() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies, by their usual rule."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(kept)]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordBpe:
    """The lower-casing word-end BPE file: ``encode`` gives little-endian uint16 ids."""

    _END = "</w>"
    _PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")
    _SLOW = re.compile("[ªºµ²³¹¼-¾]|<\\|(?:start|end)oftext\\|>")

    def __init__(self, file: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(file)
        with open(file) as f:
            model = json.load(f)["model"]
        if max(model["vocab"].values(), default=0) >= _MOST_IDS:
            raise ValueError(f"{file} has ids beyond 16 bits")
        vocab, chars = model["vocab"], _byte_of_char()

        def raw(token: str) -> bytes:
            end = token.endswith(self._END) and len(token) > len(self._END)
            return bytes(chars[c] for c in (token[: -len(self._END)] if end else token)) + b"\x01" * end

        # a word's end is the byte 1: first every byte, then byte + end, then the merges in order
        ranks, ids = {bytes([b]): b for b in range(256)}, [0] * 256

        def add(token: bytes, i: int) -> None:
            if token not in ranks:
                ranks[token] = len(ids)
                ids.append(i)

        one = {raw(t): i for t, i in vocab.items() if len(raw(t)) - raw(t).endswith(b"\x01") == 1}
        for token, i in one.items():
            if len(token) == 1:
                ids[ranks[token]] = i
            else:
                add(token, i)
        for pair in model["merges"]:
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            add(raw(a) + raw(b), vocab[a + b])
        self.mark = _MOST_IDS
        ids[ord(_SEPARATOR)] = self.mark
        self.ids = np.array(ids, np.uint32)
        self.encoder = tiktoken.Encoding("word-bpe", pat_str="[^\x01\x02]+\x01|\x02", mergeable_ranks=ranks, special_tokens={_NEVER: len(ids)})._core_bpe
        self.cache = WordCache()

    def _new(self, words: list[str]) -> list[bytes]:
        find = self._PIECES.findall
        text = "".join("\x01".join(find(w)) + "\x01" + _SEPARATOR for w in words)
        return _split(self.ids[np.frombuffer(self.encoder.encode_to_tiktoken_buffer(text, set()), np.uint32)], self.mark)

    def encode(self, text: str) -> bytes:
        if not _PLAIN.fullmatch(text) or self._SLOW.search(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u2").tobytes()
        return self.cache.joined(text.lower().split(), self._new)


class PieceBpe:
    """The sentencepiece BPE file: ``encode`` gives little-endian uint16 ids, ``decode`` the text back.

    A space starts a word; every other character is part of one.
    """

    def __init__(self, file: str):
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=file)
        size = lib.vocab_size()
        if size > _MOST_IDS:
            raise ValueError(f"{file} has ids beyond 16 bits")
        pieces = [lib.id_to_piece(i) for i in range(size)]
        self.byte_id = {int(p[3:5], 16): i for i, p in enumerate(pieces) if lib.is_byte(i)}
        normal = [i for i in range(size) if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i))]
        self.id_of = {pieces[i]: i for i in normal}
        self.score = {i: lib.get_score(i) for i in normal}
        self.raw = [b"" if lib.is_control(i) else " ⁇ ".encode() if lib.is_unknown(i) else bytes([int(pieces[i][3:5], 16)]) if lib.is_byte(i) else pieces[i].replace("▁", " ").encode() for i in range(size)]
        self.longest = max(len(pieces[i]) for i in normal)
        ranks, ids = {bytes([b]): b for b in range(256)}, [self.byte_id[b] for b in range(256)]
        singles = [i for i in normal if len(pieces[i]) == 1]
        for i in singles:
            if len(self.raw[i]) == 1:
                ids[self.raw[i][0]] = i
        rest = [i for i in singles if len(self.raw[i]) == 2] + sorted((i for i in normal if len(pieces[i]) > 1), key=lambda i: -self.score[i])
        for i in rest:
            if self.raw[i] not in ranks:
                ranks[self.raw[i]] = len(ids)
                ids.append(i)
        self.mark = _MOST_IDS
        ids[ord(_SEPARATOR)] = self.mark
        self.ids = np.array(ids, np.uint32)
        self.encoder = tiktoken.Encoding("piece-bpe", pat_str="[^\x02]+|\x02", mergeable_ranks=ranks, special_tokens={_NEVER: len(ids)})._core_bpe
        self.cache = WordCache(200_000)  # its words run on over line ends: they are longer

    def _new(self, words: list[str]) -> list[bytes]:
        text = "".join(" " + w + _SEPARATOR for w in words)
        return _split(self.ids[np.frombuffer(self.encoder.encode_to_tiktoken_buffer(text, set()), np.uint32)], self.mark)

    def plain(self, text: str) -> bool:
        """Every space starts a word, and all characters take part in the byte merges alike."""
        return bool(text) and "  " not in text and text[0] != " " and text[-1] != " " and _PLAIN.fullmatch(text) is not None

    def encode(self, text: str) -> bytes:
        if not self.plain(text):
            return np.array(self.library.encode(text), "<u2").tobytes()
        return self.cache.joined(text.split(" "), self._new)

    def decode(self, ids: bytes) -> str:
        """As the library decodes: byte pieces joined, the leading space dropped."""
        whole = b"".join(map(self.raw.__getitem__, np.frombuffer(ids, "<u2").tolist()))
        return (whole[1:] if whole.startswith(b" ") else whole).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def word_bpe(file: str) -> WordBpe:
    return WordBpe(file)


@lru_cache(maxsize=4)
def piece_bpe(file: str) -> PieceBpe:
    return PieceBpe(file)


def tokenizer_file(name: str) -> str:
    """The place of a public vocabulary file: ``QUARRYMAP_TOKENIZERS`` or the installed package."""
    folder = os.environ.get("QUARRYMAP_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
