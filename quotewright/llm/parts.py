"""Encode whole texts part by part, with a bounded memory of parts seen before.

A text is cut in front of each space that follows a character which is not white space. White space only ever
starts or fills a match of the tokenizers' split patterns and is not composed with its neighbours by their
normalisation, so the ids of the parts, put together, are the ids of the text. Words recur all the time: a
worker looks most of them up, and a text of any length is never handed to a tokenizer as one string.

A word not seen before is cut once more, between its letters and the punctuation behind them and around a single
line break, which are boundaries for the same reason; its letters are often known from another sentence.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterable

#: Words, and pieces of words, a worker remembers at most beyond one batch, and the longest (characters).
MOST, CHARS = 900_000, 40

_PLAIN = re.compile("[\x00-\u012f\u0131-\u024f]*")
_RUN = re.compile(r"\s ")
_CUT = re.compile(r"(?<=\S)(?= )")
# no apostrophe: it may belong to the letters behind it
_MARKS = ".,;:!?*%#$&|()"
_FINE = re.compile(r"(?<=[^\W\d_])(?=[.,;:!?*%#$&|()])|(?<=\S)(?=\n)|(?<=\S\n)(?=\S)")


def plain(word: str) -> bool:
    """Only characters of the Latin blocks, which no normalisation takes apart.

    The dotted capital I is left out: in lower case it ends in a mark, which joins the punctuation behind it.
    """
    return word.isascii() or _PLAIN.fullmatch(word) is not None


def as_bytes(ids: Iterable[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    packed = array("I", ids)
    if packed.itemsize != 4:
        packed = array("L", packed)
    return packed.tobytes()


def cut(text: str) -> tuple[str, list[str]]:
    """The first part, and each later one without the space it starts with."""
    if _RUN.search(text) or text.startswith(" "):
        head, *rest = _CUT.split(text)
        return head, [part[1:] for part in rest]
    head, *words = text.split(" ")
    return head, words


class PartEncoder:
    """``encode_many`` turns parts into ids packed by ``as_bytes``; it gets no part twice while that is remembered."""

    def __init__(
        self, encode_many: Callable[[list[str]], list[bytes]], cut: Callable[[str], tuple[str, list[str]]] = cut,
    ) -> None:
        self.encode_many, self.cut = encode_many, cut
        self.words: dict[str, bytes] = {}  # by the word without the space before it
        self.pieces: dict[str, bytes] = {}  # by the piece as it stands

    def _learn(self, new: list[str]) -> list[str]:
        """Remember the ids of words, each given without the space before it; also returns the letters learned."""
        words, pieces = self.words, self.pieces
        marked, others, letters = [], [], set()
        for word in new:
            core = word.rstrip(_MARKS)
            if not plain(word):
                others.append((word, [" " + word]))
            elif core.isalpha():
                letters.add(core)
                if len(core) < len(word):
                    marked.append((word, core, word[len(core):]))
            else:
                others.append((word, _FINE.split(" " + word)))
        cores = list(letters.difference(words))
        unknown = {mark for _, _, mark in marked}.union(*[pieced for _, pieced in others]).difference(pieces)
        ids = self.encode_many([" " + core for core in cores] + list(unknown))
        words.update(zip(cores, ids))
        learned = dict(zip(unknown, ids[len(cores):]))
        pieces.update(learned)
        for word, core, mark in marked:
            words[word] = words[core] + pieces[mark]
        for word, pieced in others:
            words[word] = b"".join([pieces[piece] for piece in pieced])
        _shrink(pieces, learned)
        return cores

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Packed ids of each text; a null text counts as empty."""
        words = self.words
        cuts = [self.cut(text or "") for text in texts]
        new = set().union(*[later for _, later in cuts]).difference(words)
        new.update(self._learn(list(new)))
        heads = self.encode_many([head for head, _ in cuts]) if any(head for head, _ in cuts) else [b""] * len(cuts)
        found = words.__getitem__
        out = [head + b"".join(map(found, later)) for head, (_, later) in zip(heads, cuts)]
        _shrink(words, new)
        return out


def _shrink(memo: dict[str, bytes], new: Iterable[str]) -> None:
    """Forget the long ones among the new parts, and all of them once the memory is full: the frequent come first."""
    full = len(memo) > MOST
    for part in new:
        if full or len(part) > CHARS:
            del memo[part]
