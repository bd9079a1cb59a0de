"""Token ids by the tokenizers library, with the ids of separable pieces remembered in each worker."""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain, pairwise

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

import numpy as np
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import WhitespaceSplit

from tidelens.llm._shared import remembers

#: Pieces remembered in each of two generations, the longest piece worth remembering, characters of text and words encoded at a time.
REMEMBERED, LONGEST, TEXT, WORDS = 700_000, 64, 2_000_000, 200
#: Characters whose class and lower case no library disagrees about.
PLAIN = bytes([10, *range(32, 127), *(c for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7))])


#: The byte-level alphabet: printable Latin-1 bytes are themselves, the others the code points from 256 on in ascending order.
_SELF = {*range(33, 127), *range(161, 173), *range(174, 256)}
ALPHABET = {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in _SELF)}
#: Letters and digits of Latin-1 to "a", the rest as it is.
ALNUM = bytes(97 if chr(c).isalnum() else c for c in range(256))


def _letters(word: str) -> str:
    """A word's UTF-8 bytes in the byte-level alphabet."""
    return word.encode().decode("latin-1").translate(ALPHABET)


class Encoder:
    """``encode(texts)`` gives what ``Tokenizer.encode(text, add_special_tokens=False).ids`` gives for each, as bytes
    (little-endian unsigned 32-bit).

    Two kinds of tokenizer cut a plain text at white space before they merge anything: byte-level BPE with its
    own pattern ("spaced": a single space starts a piece and belongs to it) and lower-case BPE with word ends
    that drops white space ("words"). For these the library encodes each new piece, many in one call, and the ids
    are remembered; any other text or tokenizer goes to the library as a whole, and so does a text that holds an added
    token's content in any case. With ``plain`` special tokens in a text are text (the library's ``encode_special_tokens``).
    """

    def __init__(self, path: str, plain: bool = True):
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        added = [x for x in parts.get("added_tokens") or [] if not (plain and x.get("special"))]
        self.added = [x["content"].lower() for x in added]
        self.pieces, self.old, self.kind = {}, {}, "other"
        vocabulary = parts["model"].get("vocab")
        before, norm, end = parts.get("pre_tokenizer") or {}, parts.get("normalizer") or {}, parts["model"].get("end_of_word_suffix")
        if before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and not norm:
            self.kind, mark = "spaced", lambda t: t.startswith(("\u0120", "\u010a"))  # a space or a line feed
        elif end and [x["type"] for x in norm.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in before.get("pretokenizers", [])] == ["Split", "ByteLevel"] and before["pretokenizers"][0]["behavior"] == "Removed":
            self.kind, mark = "words", lambda t: t.endswith(end)
        if self.kind != "other":
            self.marks = np.zeros(max(vocabulary.values()) + 1, bool)
            self.marks[[i for t, i in vocabulary.items() if mark(t)]] = True
            # The same model behind nothing but a split at spaces, for words already in its alphabet.
            self.bare = Tokenizer.from_file(path)
            self.bare.normalizer, self.bare.pre_tokenizer = None, WhitespaceSplit()

    def library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _atoms(self, piece: str) -> list[str]:
        """What a piece's ids are put together from. In a "spaced" text a piece follows a space, except one that begins
        with NUL (start of a text, or a mark after a letter) or a line feed."""
        lines = piece.split("\n")
        if self.kind == "spaced" and len(lines) > 1 and all(lines[1:]):
            atoms = [*lines[:1], *["\n" + x for x in lines[1:]]] if lines[0] else ["\n" + x for x in lines[1:]]
        else:
            atoms = [piece]
        mark = "\0" if self.kind == "spaced" else ""
        return [y for x in atoms for y in ((x[:-1], mark + x[-1]) if len(x) > 1 and x[-1] in ",." and x[-2].isalpha() else (x,))]

    def _joint(self, words: list[str], before: str) -> None:
        """Ids of words of letters only, each after ``before``: cut where the vocabulary marks a word's start or end."""
        own = ("\u010a " if before == "\n" else "\u0120") if self.kind == "spaced" else ""
        parts = [words[i : i + WORDS] for i in range(0, len(words), WORDS)]
        lead, pieces = "" if before == " " else before, self.pieces
        for some, encoding in zip(parts, self.bare.encode_batch_fast([own + (" " + own).join([w if w.isascii() else _letters(w) for w in p]) for p in parts], add_special_tokens=False), strict=True):
            ids = np.array(encoding.ids, "<u4")
            cuts = 4 * np.flatnonzero(self.marks[ids])
            raw = ids.tobytes()
            edges = [0, *(cuts + 4).tolist()] if self.kind == "words" else [*cuts.tolist(), len(raw)]
            if len(edges) != len(some) + 1:
                raise ValueError("words and marks of the vocabulary do not match")
            pieces.update(zip([lead + w for w in some] if lead else some, [raw[a:b] for a, b in pairwise(edges)], strict=True))

    def _learn(self, missing: set[str]) -> None:
        old, pieces = self.old, self.pieces
        known = old.keys() & missing
        pieces.update(zip(known, map(old.__getitem__, known), strict=True))
        self._joint([p for p in missing if p not in known and p.isalpha()], " ")
        parts = {p: self._atoms(p) for p in missing if p not in pieces}
        new = list(dict.fromkeys(a for v in parts.values() for a in v if a not in pieces))
        self._joint([a for a in new if a.isalpha()], " ")
        if self.kind == "spaced":
            # A text's first word has the ids that it has after a line feed, without the line feed's.
            first = [a[1:] for a in new if a[0] == "\0" and a[1:].isalpha()]
            self._joint(list(dict.fromkeys([*[a[1:] for a in new if a[0] == "\n" and a[1:].isalpha()], *[w for w in first if "\n" + w not in pieces]])), "\n")
            pieces.update(("\0" + w, pieces["\n" + w][4:]) for w in first)
        for a in new:
            if a not in pieces:
                plain = self.kind == "words" or a[0] == "\n"
                pieces[a] = self.library(a if plain else a[1:] if a[0] == "\0" else " " + a)
        for p, v in parts.items():
            if p not in pieces:
                pieces[p] = b"".join([pieces[a] for a in v])

    def _cut(self, text: str) -> list[str] | None:
        """A plain text's pieces; none for a text that the library must see as a whole."""
        try:
            if self.kind == "other" or (raw := text.encode("latin-1")).translate(None, PLAIN):
                return None
        except UnicodeEncodeError:
            return None
        lower = text.lower() if self.added or self.kind == "words" else text
        if any(x in lower for x in self.added):
            return None
        # A comma or point behind a letter or digit starts a piece of its own.
        shape = raw.translate(ALNUM)
        marks = all(shape.count(x) == shape.count(b"a" + x) for x in (b",", b"."))
        if self.kind == "words":
            return (lower.replace(",", " ,").replace(".", " .") if marks else lower).split()
        if "  " in text or " \n" in text or "\n " in text or "\n\n" in text or text[0] in " \n" or text[-1] in " \n":
            return None
        return ("\0" + (text.replace(",", " \0,").replace(".", " \0.").replace("\n", " \n") if marks else text)).split(" ")

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        some, size = [], 0
        for t in texts:
            some.append(t)
            size += len(t)
            if size > TEXT:
                yield from self._encoded(some)
                some, size = [], 0
        yield from self._encoded(some)

    def _encoded(self, texts: list[str]) -> Iterator[bytes]:
        if len(self.pieces) > REMEMBERED:
            self.old, self.pieces = self.pieces, {}
        cut = [self._cut(t) if t else [] for t in texts]
        missing = set(chain.from_iterable(c for c in cut if c)).difference(self.pieces)
        self._learn(missing)
        for t, c in zip(texts, cut, strict=True):
            yield self.library(t) if c is None else b"".join(map(self.pieces.__getitem__, c))
        for p in missing:
            if len(p) > LONGEST:
                self.pieces.pop(p, None)


@cache
def encoder(path: str) -> Encoder:
    """One encoder a worker process and file, with the library's default for special tokens; its pieces stay between tasks."""
    return Encoder(path, plain=False)


remembers("tokens", encoder.cache_clear)
