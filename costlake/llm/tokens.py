"""Exact ids of the public tokenizers for many texts, each word encoded once per worker.

Words between blanks repeat far more than texts do, so a worker keeps the ids of the words it has met
(a bounded table) and asks the tokenizer for the others only.  This needs a place where a text can be
cut without changing its ids; both supported kinds have one, see ``Encoder``.
"""

from __future__ import annotations

import base64
import os
import re
from array import array

import numpy as np

_LOADED: dict = {}
# ASCII but the sign that begins special tokens, line ends, and the letters of Latin-1
_PLAIN = re.compile(rb"(?:[\n!-;=-~]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
_LONGEST = 64  # bytes of a word worth keeping
_ODD_ENDS = "\u180e\u200b\u2060\ufeff"  # white space to some engines


class Encoder:
    """Ids of texts by one tokenizer file, special tokens as the library treats them, none added.

    ``blanks="dropped"``: the tokenizer drops white space and its word pattern never spans ASCII white
    space, so a text falls apart at \\x20 and \\x09-\\x0D.  ``blanks="leading"``: a word pattern takes one
    blank in front, so a text falls apart before a single blank between two visible characters; what
    stands by other white space is encoded together with its neighbours.
    """

    def __init__(self, path: str, blanks: str, ranks: str | None = None, most: int = 400_000):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.leading = blanks == "leading"
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if self.size <= 0x10000 else "<u4")
        self.code = "H" if self.size <= 0x10000 else "I"
        self.most = most
        self.known: dict[bytes, bytes] = {}
        self.quick = _quick(ranks) if ranks else None

    def _ask(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array(self.code, e.ids).tobytes() for e in found]

    def _learn(self, words: list[bytes]) -> None:
        """Keep the ids of new words; the quick encoder takes those of letters and marks both engines agree on."""
        blank = " " if self.leading else ""
        if self.quick:
            plain = [w for w in words if _PLAIN.fullmatch(w)]
            words = list(set(words).difference(plain))
            code, quick = self.code, self.quick
            self.known.update((w, array(code, quick(blank + w.decode())).tobytes()) for w in plain)
        for at in range(0, len(words), 20_000):
            some = words[at:at + 20_000]
            self.known.update(zip(some, self._ask([blank + w.decode() for w in some])))

    def _cut(self, raw: bytes) -> list[bytes]:
        return raw.split(b" ") if self.leading else raw.split()

    def _odd(self, word: bytes) -> bool:
        if not word or len(word) > _LONGEST:
            return True
        if not self.leading or (32 < word[0] < 127 and 32 < word[-1] < 127):
            return False
        text = word.decode("utf-8", "replace")
        return any(c.isspace() or c in _ODD_ENDS for c in (text[0], text[-1]))

    @staticmethod
    def _ends_visible(word: bytes) -> bool:
        last = word[-1:] if word[-1:] < b"\x80" else word[-4:]
        text = last.decode("utf-8", "ignore")
        return bool(text) and not (text[-1].isspace() or text[-1] in _ODD_ENDS)

    def _groups(self, words: list[bytes]) -> list[str]:
        """The stretches between safe cuts of one text, in order; every stretch after the first has its blank."""
        if not self.leading:
            return [w.decode() for w in words]

        def visible(c: str) -> bool:
            return not (c.isspace() or c in _ODD_ENDS)

        texts = [w.decode() for w in words]
        groups: list[list[str]] = []
        for i, text in enumerate(texts):
            before = texts[i - 1] if i else ""
            if i == 0 or (before and text and visible(before[-1]) and visible(text[0])):
                groups.append([text])
            else:
                groups[-1].append(text)
        return [(" " if i else "") + " ".join(g) for i, g in enumerate(groups)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian numbers of ``dtype``."""
        cut = [self._cut(t.encode("utf-8", "replace")) for t in texts]
        heads = [words.pop(0) for words in cut] if self.leading else [b""] * len(cut)
        if len(self.known) > self.most:
            self.known.clear()
        known, fresh = self.known, set()
        for words in cut:
            fresh.update(words)
        self._learn([w for w in fresh.difference(known) if not self._odd(w)])
        first = list(set(heads).difference((b"",)))
        opening = dict(zip(first, self._ask([w.decode() for w in first])))
        opening[b""] = b""
        out: list[bytes] = []
        for head, words in zip(heads, cut):
            try:
                if self.leading and words and not self._ends_visible(head):
                    raise KeyError
                out.append(opening[head] + b"".join([known[w] for w in words]))
            except KeyError:  # an odd word: by the stretches around it
                groups = self._groups([head, *words] if self.leading else words)
                out.append(b"".join(self._ask(groups)) if groups else b"")
        return out


def _quick(ranks: str):
    """The same vocabulary as ranks, in an engine that is quicker on single words."""
    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    found = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    return found.encode_ordinary


def encoder(path: str, blanks: str, ranks: str | None = None) -> Encoder:
    """The worker's encoder of a file."""
    key = (path, blanks, ranks)
    if key not in _LOADED:
        _LOADED[key] = Encoder(path, blanks, ranks)
    return _LOADED[key]


def token_texts(path: str, blanks: str) -> list[bytes]:
    """The text of every id as the vocabulary writes it, in UTF-8."""
    key = (path, blanks, "texts")
    if key not in _LOADED:
        tokenizer = encoder(path, blanks).tokenizer
        size = encoder(path, blanks).size
        _LOADED[key] = [(tokenizer.id_to_token(i) or "").encode() for i in range(size)]
    return _LOADED[key]


def byte_lengths(path: str) -> np.ndarray:
    """Bytes of text behind every id of a byte-level vocabulary (one character stands for one byte;
    added tokens stand for their own text)."""
    key = (path, "lengths")
    if key not in _LOADED:
        own = encoder(path, "leading")
        sizes = np.array([len(own.tokenizer.id_to_token(i) or "") for i in range(own.size)], np.int64)
        for i, added in own.tokenizer.get_added_tokens_decoder().items():
            sizes[i] = len(added.content.encode())
        _LOADED[key] = sizes
    return _LOADED[key]
