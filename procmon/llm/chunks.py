"""Exact, cached encoding of whole texts with a `tokenizers` file.

A text is cut at places where the tokenizer's pre-tokenizer always cuts, equal
chunks of a batch are encoded once, and the ids are put together again with
array operations.  The result is the one of encoding each whole text.

Safe places:

* ``byte`` files (byte-level BPE, the pattern of ``public_tokenizers``): before a
  single space or newline that stands before a letter, digit or ASCII
  punctuation mark (the whitespace rules never pull such a character into the
  run before it), and between a letter and one of ``. , ; : ! ? | ) ] } "``.
* ``word`` files (white space dropped, lower case, NFC): at spaces and
  newlines, and between a Latin-1 letter and one of the same marks; lower case and
  NFC leave such a letter a single letter, which many others do not stay.

Texts that hold ``<|``, with which special tokens begin, or (``word``) a combining mark after a space
are encoded whole, so special tokens are those of the library's plain call.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

SEP = "\x00"
MAX_CHUNKS = 700_000  # cached chunks per worker process; the cache starts anew beyond it
_LATIN = {"byte": re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+"), "word": re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")}
_ENCODERS: dict[tuple[str, str], ChunkEncoder] = {}


def _byte_alphabet() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, extra = {}, 0
    for b in range(256):
        if b in shown:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + extra)
            extra += 1
    return out


def encoder(path: str, kind: str) -> ChunkEncoder:
    """The worker's encoder for a file (kept between the tasks of a worker)."""
    if (path, kind) not in _ENCODERS:
        _ENCODERS[path, kind] = ChunkEncoder(path, kind)
    return _ENCODERS[path, kind]


class ChunkEncoder:
    def __init__(self, path: str, kind: str):
        from tokenizers import Tokenizer

        self.kind = kind
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.alphabet = _byte_alphabet()
        self._reset()

    def _reset(self) -> None:
        self.slot: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.used = 0
        self.start = np.zeros(1 << 14, np.int64)
        self.length = np.zeros(1 << 14, np.int64)

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _split(self, arr: pa.StringArray) -> pa.ListArray:
        if self.kind == "byte":
            arr = pc.replace_substring_regex(arr, r"([ \n])([\p{L}\p{N}[:punct:]])", SEP + r"\1\2")
        else:
            arr = pc.replace_substring_regex(arr, r"[ \n]+", SEP)
        letter = r"\p{L}" if self.kind == "byte" else "[A-Za-zÀ-ÖØ-öø-ÿ]"
        arr = pc.replace_substring_regex(arr, rf'({letter})([.,;:!?|)\]}}"])', r"\1" + SEP + r"\2")
        return pc.split_pattern(arr, SEP)

    def _add(self, chunks: list[str]) -> None:
        """Encode chunks that are not cached yet and append their ids to the pool."""
        latin, tokenize = _LATIN[self.kind], self.model.tokenize
        plain, rest = [], []
        for c in chunks:
            (plain if latin.fullmatch(c) else rest).append(c)
        found: list[list[int]] = []
        for c in plain:  # one pre-token of letters: the model alone decides
            c = c.lower() if self.kind == "word" else c
            found.append([t.id for t in tokenize(c.encode().decode("latin-1").translate(self.alphabet))])
        found += [e.ids for e in self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)]
        lens = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((i for ids in found for i in ids), np.uint32, int(lens.sum()))
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        n = len(self.slot)
        while n + len(found) > len(self.start):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
            self.length = np.concatenate([self.length, np.zeros_like(self.length)])
        self.ids[self.used : self.used + len(flat)] = flat
        self.start[n : n + len(found)] = self.used + np.cumsum(lens) - lens
        self.length[n : n + len(found)] = lens
        self.used += len(flat)
        for i, c in enumerate([*plain, *rest]):
            self.slot[c] = n + i

    def encode(self, arr: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after the other, and the n+1 offsets of the texts among them."""
        if len(self.slot) > MAX_CHUNKS:
            self._reset()
        odd = pc.or_(pc.match_substring(arr, SEP), pc.match_substring(arr, "<|"))
        if self.kind == "word":
            odd = pc.or_(odd, pc.match_substring_regex(arr, r"[ \n]\p{M}"))
        if pc.any(odd).as_py():
            return self._encode_odd(arr, odd.to_numpy(zero_copy_only=False))
        lists = self._split(arr)
        per_text = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        unique = coded.dictionary.to_pylist()
        self._add([u for u in unique if u not in self.slot])
        slot = np.fromiter((self.slot[u] for u in unique), np.int64, len(unique))
        slot = slot[coded.indices.to_numpy(zero_copy_only=False)]
        lens = self.length[slot]
        ends = np.cumsum(lens)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.ids[np.repeat(self.start[slot] - (ends - lens), lens) + np.arange(total)]
        marks = np.concatenate([[0], ends])
        return ids, marks[np.concatenate([[0], np.cumsum(per_text)])]

    def _encode_odd(self, arr: pa.StringArray, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Texts that hold the separator or have no safe cuts are encoded whole."""
        plain = pc.if_else(pa.array(odd), "", arr)
        ids, off = self.encode(plain)
        parts = [np.array(self.whole(arr[i].as_py()), np.uint32) if o else ids[off[i] : off[i + 1]] for i, o in enumerate(odd)]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
