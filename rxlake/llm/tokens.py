"""Token ids of texts by the ``tokenizers`` library, with reused pieces.

A text's ids are the ids of its pieces in order when the text is cut only
where the tokenizer cuts anyway.  Both byte-level vocabularies in use start a
new pre-token at a single blank between two visible Latin characters, so texts
are cut there, each distinct piece is encoded by the library once, and its bytes
are reused: the first pieces for good, up to a limit of memory, later ones for a
while, long ones not.  Other blanks, line ends and scripts stay inside their
piece.  A tokenizer of any other kind encodes whole texts.
"""

from __future__ import annotations

import json
import os
import re
import sys
from array import array
from collections.abc import Callable

import numpy as np

#: a blank between two visible characters of U+0021-U+007E, U+00A1-U+024F
_CUT = re.compile("(?<=[!-~¡-ɏ]) (?=[!-~¡-ɏ])")
#: texts within that range, line ends and blanks
_PLAIN = re.compile("[\n -~¡-ɏ]*")
#: pieces, and pre-tokens, remembered per worker process at most, and bytes of either
REMEMBERED = 1_000_000
REMEMBERED_BYTES = 56 << 20
#: further ones held until they are dropped together
RECENT = 1 << 16
#: longer ones are not held
LONGEST = 64
#: pre-tokens of a piece of Latin-1 letters, marks but the apostrophe, and single line ends inside
_MARKS = "[!-&(-/:-@\\[-`{-~]+"
_PARTS = re.compile(f"[A-Za-zÀ-ÖØ-öø-ÿ]+|{_MARKS}|\n")
#: letters beyond ASCII as the byte-level alphabet writes their two UTF-8 bytes
#: (bytes 0xA1-0xAC and 0xAE-0xFF stand for themselves, 0x80-0xA0 and 0xAD for U+0122-U+0143)
_BYTES = {c: "".join(chr(b if b >= 0xA1 and b != 0xAD else 0x143 if b == 0xAD else 0x122 + b - 0x80) for b in chr(c).encode())
          for c in range(0xC0, 0x100)}

_loaded: dict[str, "Encoder"] = {}


def encoder(path: str) -> "Encoder":
    """The worker's encoder for a tokenizer file (loaded once per process)."""
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


class Remembered(dict):
    """Ids of strings, made at the first lookup; ``settle`` drops those there is no room for."""

    def __init__(self, ids_of: Callable[[str], bytes]):
        super().__init__()
        self.ids_of, self.new, self.kept, self.size = ids_of, [], 0, 0

    def __missing__(self, key: str) -> bytes:
        ids = self.ids_of(key)
        if len(key) <= LONGEST:
            self[key] = ids
            self.new.append(key)
        return ids

    def settle(self) -> None:
        if len(self.new) < RECENT:
            return
        for key in self.new:
            if self.size < REMEMBERED_BYTES and self.kept < REMEMBERED:
                self.size += sys.getsizeof(key) + sys.getsizeof(self[key]) + 64      # and the entry
                self.kept += 1
            else:
                del self[key]
        self.new.clear()


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True      # their strings in a text are ordinary text
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        shape = json.loads(self.tokenizer.to_str())
        self.lead = self._lead(shape.get("normalizer"), shape.get("pre_tokenizer") or {})
        self.known = Remembered(self._piece)     # ids of pieces after a blank
        self.parts = Remembered(self._part)      # ids of pre-tokens, with the blank before them

    @staticmethod
    def _lead(normalizer: dict | None, pre: dict) -> str | None:
        """What a piece after a cut begins with; None: texts can't be cut."""
        if normalizer is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") \
                and not pre.get("add_prefix_space"):
            return " "
        steps = pre.get("pretokenizers", [])
        kinds = [s["type"] for s in (normalizer or {}).get("normalizers", [])]
        if [s["type"] for s in steps] == ["Split", "ByteLevel"] and steps[0]["behavior"] == "Removed" \
                and steps[0]["invert"] and not steps[1]["add_prefix_space"] and set(kinds) <= {"NFC", "Replace", "Lowercase"}:
            return ""
        return None

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _part(self, key: str) -> bytes:
        """Ids of one pre-token by the library's model alone."""
        part = key.lstrip(" ")
        word = part if part.isascii() else part.translate(_BYTES)
        word = "Ċ" if part == "\n" else "Ġ" + word if part != key else word
        return array("I", [t.id for t in self.tokenizer.model.tokenize(word)]).tobytes()

    def _piece(self, p: str) -> bytes:
        """Ids of a piece that stands after a blank.

        Most consist of letters, marks and single line ends, whose pre-tokens
        are plain to see; they go to the model without the normalizer and the
        splitter.  The rest goes the whole way.
        """
        if p.isascii() and p.isalpha():
            return self.parts[" " + p if self.lead else p.lower()]
        parts = _PARTS.findall(p)
        if sum(map(len, parts)) < len(p) or "\n" in p and ("\n\n" in p or p[0] == "\n" or p[-1] == "\n"):
            return self._encode([self.lead + p])[0]
        if self.lead:
            parts[0] = " " + parts[0]
        else:
            parts = [x.lower() for x in parts if x != "\n"]        # the other kind lower-cases and drops line ends
        return b"".join(map(self.parts.__getitem__, parts))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers; null texts are empty."""
        if self.lead is None:
            return self._encode([t or "" for t in texts])
        out: list = [None] * len(texts)
        ids = self.known.__getitem__
        first: dict[str, list[int]] = {}
        for i, t in enumerate(texts):
            if not t:
                out[i] = b""
                continue
            even = not ("  " in t or " \n" in t or "\n " in t or t[0] == " " or t[-1] == " ")
            pieces = t.split(" ") if even and _PLAIN.fullmatch(t) else _CUT.split(t)
            if self.lead:                        # the first piece has no blank before it
                first.setdefault(pieces[0], []).append(i)
                pieces = pieces[1:]
            out[i] = b"".join(map(ids, pieces))
        self.known.settle()
        self.parts.settle()
        if first:
            for (_, where), head in zip(first.items(), self._encode(list(first))):
                for i in where:
                    out[i] = head + out[i]
        return out


def ends_sentence(path: str) -> np.ndarray:
    """For each id of the vocabulary, whether its token ends with a sentence mark."""
    vocab = encoder(path).tokenizer.get_vocab(with_added_tokens=True)
    out = np.zeros(max(vocab.values()) + 1, bool)
    for token, i in vocab.items():
        out[i] = token.removesuffix("</w>").endswith((".", "!", "?"))
    return out
