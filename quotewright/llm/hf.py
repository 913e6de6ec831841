"""Token ids by the tokenizers library from a local tokenizer file."""

from __future__ import annotations

import hashlib
import json
import os
import re

from pyspark import Broadcast
from pyspark.sql import SparkSession

from .parts import PartEncoder, as_bytes, cut, plain

# the characters that byte-level vocabularies write for bytes without a printable one of their own
_HIDDEN = [*range(0x21), *range(0x7F, 0xA1), 0xAD]
_VISIBLE = {byte: 0x100 + place for place, byte in enumerate(_HIDDEN)}

_CONTROL = re.compile("[\x1c-\x1f]")  # white space to Python alone

_loaded: dict[bytes, FileTokenizer] = {}


class FileTokenizer:
    """Ids as the library gives them with ``add_special_tokens=False``.

    The strings of added tokens in a text are those tokens, which is the library's default.
    """

    def __init__(self, content: bytes) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs the tasks side by side
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(content.decode())
        self.names, self.added, self.apart = _added_tokens(json.loads(content))
        self.model = self.tokenizer.model
        self.space, self.lower = _letters_only(json.loads(content))
        self.parts = PartEncoder(self._ids, _cut_lower if self.lower else cut)

    @classmethod
    def of(cls, content: bytes) -> FileTokenizer:
        """The tokenizer of this file, loaded once by each Python worker."""
        key = hashlib.sha256(content).digest()
        if key not in _loaded:
            _loaded[key] = cls(content)
        return _loaded[key]

    def _ids(self, parts: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(parts)
        others = []
        for place, part in enumerate(parts):
            # a space and letters are one match of the split pattern: straight to the merges
            if self.space is not None and part[:1] == " " and part[1:].isalpha() and plain(part):
                word = part[1:].lower() if self.lower else part[1:]
                if not word.isascii():
                    word = word.encode().decode("latin-1").translate(_VISIBLE)
                out[place] = as_bytes([token.id for token in self.model.tokenize(self.space + word)])
            else:
                others.append(place)
        found = self.tokenizer.encode_batch_fast([parts[place] for place in others], add_special_tokens=False)
        for place, encoding in zip(others, found):
            out[place] = as_bytes(encoding.ids)
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; a null text counts as empty."""
        if not any(text and name in text for text in texts for name in self.names):
            return self.parts.encode(texts)
        # the library takes added tokens out first, and what stands between them goes through the other steps alone
        stretches: list[str | None] = []
        owners: list[tuple[int, bytes | None]] = []  # the text, and the ids of an added token
        for at, text in enumerate(texts):
            if text and any(name in text for name in self.names):
                if not self.apart:
                    owners.append((at, as_bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)))
                    continue
                for place, stretch in enumerate(self.added.split(text)):
                    if place % 2:
                        owners.append((at, as_bytes([self.tokenizer.token_to_id(stretch)])))
                    else:
                        owners.append((at, None))
                        stretches.append(stretch)
            else:
                owners.append((at, None))
                stretches.append(text)
        encoded = iter(self.parts.encode(stretches))
        out: list[list[bytes]] = [[] for _ in texts]
        for at, ids in owners:
            out[at].append(next(encoded) if ids is None else ids)
        return [b"".join(ids) for ids in out]


def _cut_lower(text: str) -> tuple[str, list[str]]:
    """Where letters are lower-cased and white space is dropped, a text of Latin-1 is cut at all white space.

    None of its characters is composed with another or grows in lower case, and what splits it here is white space there.
    """
    if text.isascii() or _latin(text):
        if not _CONTROL.search(text):
            return "", text.lower().split()
    return cut(text)


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def _added_tokens(spec: dict) -> tuple[list[str], re.Pattern, bool]:
    """The added tokens' strings, longest first, a pattern of them, and whether all are found in the text as it stands,
    wherever they stand and without the white space around them."""
    added = spec.get("added_tokens") or []
    names = sorted((token["content"] for token in added), key=len, reverse=True)
    apart = not any(token[flag] for token in added for flag in ("single_word", "lstrip", "rstrip", "normalized"))
    return names, re.compile("(" + "|".join(map(re.escape, names)) + ")"), apart


def _letters_only(spec: dict) -> tuple[str | None, bool]:
    """What the merges see in place of the space before a word, and whether letters are lower-cased first.

    (None, False) where the file's steps are none of the two known ones.
    """
    steps = json.dumps([spec.get("normalizer"), spec.get("pre_tokenizer")])
    if spec.get("normalizer") is None and spec["pre_tokenizer"]["type"] == "ByteLevel" and spec["pre_tokenizer"]["use_regex"]:
        return "Ġ", False  # the visible stand-in of the space byte
    if '"Lowercase"' in steps and '"Removed"' in steps and '"ByteLevel"' in steps:
        return "", True
    return None, False


def send(spark: SparkSession, path: str) -> Broadcast[bytes]:
    """The tokenizer file, read where the driver runs; below 2 MB, as it is a vocabulary and not data."""
    with open(path, "rb") as file:
        return spark.sparkContext.broadcast(file.read())
