"""Public tokenizers inside tasks: whole texts, and whitespace-separated chunks through caches."""

from __future__ import annotations

import json
import os
import re
import struct

from .common import kept

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Printable ASCII and the letters of Latin-1: composed, so NFC leaves them, and lower-casing goes letter by letter.
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
#: The pre-tokenizer's pattern over such text in lower case.
_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")
#: Entries of a worker's cache, after which it starts anew.
CACHE = 600_000


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level BPE has for each byte: printable ones stand for themselves, the others follow from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(0x100 + i) for i, b in enumerate(others)}


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Chunks:
    """ids of chunks of text without ASCII white space, for tokenizers that treat white space only as a border."""

    def __init__(self, source: bytes):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(source.decode())
        spec = json.loads(source)
        added = [re.escape(t["content"]) for t in spec.get("added_tokens", [])]
        self.added = re.compile("|".join(added) or "(?!)")
        self.letters = _byte_letters()
        self.plain = self._matches_plain(spec)
        self.parts: dict[str, bytes] = {}
        self.memo: dict[bytes, bytes] = {}

    def encode(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def independent(self) -> bool:
        """White space is a border and leaves no trace."""
        return all(self.encode(x) == self.encode("a") + self.encode("b") for x in ("a b", "a  b\n", "\ta\r\nb")) and not self.encode(" \n\t\x0b\x0c\r")

    def _matches_plain(self, spec: dict) -> bool:
        """Whether the short way over _SPLIT is this tokenizer's."""
        pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        kinds = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        return spec["model"]["type"] == "BPE" and pre[0].get("pattern", {}).get("Regex") == pattern and kinds == ["NFC", "Replace", "Lowercase"]

    def ids(self, chunk: bytes) -> bytes:
        """Packed uint32 ids of a chunk."""
        found = self.memo.get(chunk)
        if found is None:
            if len(self.memo) > CACHE:
                self.memo.clear()
            found = self.memo[chunk] = self._ids(chunk.decode())
        return found

    def _ids(self, text: str) -> bytes:
        if not self.plain or not _PLAIN.fullmatch(text) or self.added.search(text):
            return _packed(self.encode(text))
        parts, out = self.parts, []
        for part in _SPLIT.findall(text.lower()):
            found = parts.get(part)
            if found is None:
                if len(parts) > CACHE:
                    parts.clear()
                mapped = "".join(map(self.letters.__getitem__, part.encode()))
                found = parts[part] = _packed([t.id for t in self.library.model.tokenize(mapped)])
            out.append(found)
        return b"".join(out)

    def text_ids(self, text: bytes) -> bytes:
        """Packed ids of a whole text."""
        memo, ids = self.memo, self.ids
        return b"".join([memo.get(w) or ids(w) for w in text.split()])


class Whole:
    """ids of whole texts by the library, for all other tokenizers."""

    def __init__(self, source: bytes, name: str):
        if name.endswith(".model"):
            import sentencepiece

            self._run = sentencepiece.SentencePieceProcessor(model_proto=source).encode
        else:
            self._run = Chunks(source).encode

    def text_ids(self, text: bytes) -> bytes:
        return _packed(self._run(text.decode()))


def encoder(source: bytes, name: str) -> Chunks | Whole:
    """The encoder of a vocabulary file's content, kept by the worker with its caches."""

    def make() -> Chunks | Whole:
        if name.endswith(".json") and (made := Chunks(source)).independent():
            return made
        return Whole(source, name)

    return kept(("tokenizer", hash((source, name))), make)


def load(path: str) -> tuple[bytes, str]:
    """A vocabulary file's content (a few MB) and name, for a broadcast."""
    with open(path, "rb") as f:
        return f.read(), os.path.basename(path)
