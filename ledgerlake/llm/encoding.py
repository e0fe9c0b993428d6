"""Token ids of whole texts with the tokenizers library, as little-endian 32-bit bytes."""

from __future__ import annotations

import os
import re
from array import array
from contextlib import suppress
from functools import cache

import numpy as np
import public_tokenizers

from .common import keeps

DEFAULT_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
END = (0).to_bytes(4, "little")


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use, each with its byte: printable Latin-1 characters stand
    for themselves, the other bytes follow from code point 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Encoder:
    """Encodes texts as the library does by itself; ids of space-separated pieces are kept, as most words come again.

    A byte-level pre-tokenizer never joins characters across a space that touches no other white space, so such a text's
    ids are those of its pieces, each with its space in front, one after the other. Other texts, and those that hold a
    marker (an added token's string), are encoded whole. markers_as_text reads markers as ordinary text; the library's
    default gives them their own ids. The kept pieces are bounded in number and length.
    """

    KEPT, LONGEST = 800_000, 64
    _touching = re.compile(r" \s|\s ")

    def __init__(self, vocabulary: str = DEFAULT_VOCABULARY, markers_as_text: bool = False) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.encode_special_tokens = markers_as_text
        self.markers = sorted(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        #: the same model, fed words in its own alphabet
        self.letters = Tokenizer(self.tokenizer.model)
        self.letters.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.alphabet = {b: c for c, b in byte_alphabet().items()}
        self.gap, self.line = self.alphabet[32], self.alphabet[10]
        self.line_break = self.tokenizer.encode("\n", add_special_tokens=False).ids[-1]
        self.marks = dict(zip(".,", self._fresh([".", ","]), strict=True))
        self.kept: dict[str, bytes] = {}

    def _fresh(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", x.ids).tobytes() for x in found]

    def _fresh_words(self, words: list[str]) -> list[bytes]:
        """The ids of each word with a space in front.

        A word of letters alone is one piece for the pre-tokenizer, so many of them go to the library's model at once,
        spelt in the byte alphabet, with line breaks between them at whose id the result is cut.
        """
        plain = [w for w in words if w.isalpha()]
        out: dict[str, bytes] = {}
        for k in range(0, len(plain), 256):
            some = plain[k : k + 256]
            spelt = f" {self.line} {self.gap}".join(w if w.isascii() else w.encode().decode("latin-1").translate(self.alphabet) for w in some)
            ids = np.array(self.letters.encode_batch_fast([f"{self.gap}{spelt} {self.line}"], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(ids == self.line_break)
            if len(ends) == len(some):
                raw, begin = ids.tobytes(), 0
                for w, end in zip(some, (4 * ends).tolist(), strict=True):
                    out[w] = raw[begin:end]
                    begin = end + 4
        rest = [w for w in words if w not in out]
        out.update(zip(rest, self._fresh([f" {w}" for w in rest]), strict=True))
        return [out[w] for w in words]

    def _fresh_pieces(self, pieces: set[str]) -> dict[str, bytes]:
        """A mark after a letter is a piece of its own for the pre-tokenizer, so ``word,`` is ``word`` and then ``,``."""
        kept, marked = self.kept, {}
        for x in pieces:
            if x[-1:] in self.marks and x[-2:-1].isalpha():
                marked[x] = x[:-1]
        bare = {y for y in marked.values() if y not in kept}
        bare |= pieces.difference(marked)
        fresh = dict(zip(bare, self._fresh_words(list(bare)), strict=True))
        fresh.update((x, (kept.get(y) or fresh[y]) + self.marks[x[-1]]) for x, y in marked.items())
        return fresh

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text; null counts as empty."""
        out: list[list] = []
        whole: list[str] = []  # the texts, or their first pieces, that the library sees as they are
        holes: list[tuple[list, list[int], list[str]]] = []
        new: set[str] = set()
        kept = self.kept
        for text in texts:
            pieces = (text or "").split(" ")
            head, pieces[0] = pieces[0], ""
            found, places, at = list(map(kept.get, pieces)), [], 0
            found[0] = b""
            with suppress(ValueError):  # no hole is left
                while True:
                    at = found.index(None, at + 1)
                    places.append(at)
            words = [pieces[k] for k in places]
            # spaces touch no other white space where no piece is empty or has any at an end; none such is ever kept
            if (self._touching.search(f"{head} {' '.join(words)} .") and (words or head != head.rstrip())) or any(m in text for m in self.markers if text):
                found, head = [b""], text or ""
            elif words:
                holes.append((found, places, words))
                new.update(words)
            whole.append(head)
            out.append(found)
        fresh = self._fresh_pieces(new)
        for found, places, words in holes:
            for k, x in zip(places, words, strict=True):
                found[k] = fresh[x]
        for found, ids in zip(out, self._fresh(whole), strict=True):
            found[0] = ids
        if len(kept) < self.KEPT:  # the frequent words come early; the later, rare ones are not worth their room
            kept.update((x, ids) for x, ids in fresh.items() if len(x) <= self.LONGEST)
        return [b"".join(x) for x in out]


keeps("encoder", lambda: encoder.cache_clear())


@cache
def encoder(vocabulary: str = DEFAULT_VOCABULARY, markers_as_text: bool = False) -> Encoder:
    """One encoder for each worker process."""
    return Encoder(vocabulary, markers_as_text)
