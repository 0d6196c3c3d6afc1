"""Word-level BPE with end-of-word symbols, read from a tokenizers JSON file.

White space separates words whatever the rest of the file says, so a text is
encoded word by word and each distinct word once for every cache. Words whose
characters all lie below U+0250 take the vectorised path; other words, and files
of another make, go to the tokenizers library itself.
"""

from __future__ import annotations

import json
import os
import unicodedata
from functools import lru_cache

import numpy as np
import regex

from factloom.llm import bpe
from factloom.llm import text_kernels as tk

_PLAIN = 0x250


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte: a
    printable byte stands for itself, the others follow from U+0100 in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = (chr(0x100 + k) for k in range(256))
    return [chr(b) if b in plain else next(rest) for b in range(256)]


class WordEncoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        steps = [s.get("type") for s in (spec.get("normalizer") or {}).get("normalizers", [])]
        before = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        model = spec["model"]
        suffix = model.get("end_of_word_suffix") or ""
        self.fast = (
            steps == ["NFC", "Replace", "Lowercase"] and [s.get("type") for s in before] == ["Split", "ByteLevel"]
            and before[0]["behavior"] == "Removed" and before[0]["invert"] and not before[1]["add_prefix_space"] and not before[1]["use_regex"]
            and model["type"] == "BPE" and model.get("dropout") is None and not model.get("ignore_merges") and bool(suffix)
        )
        if self.fast:
            self.pattern = regex.compile(before[0]["pattern"]["Regex"])
            vocab = model["vocab"]
            symbols = byte_symbols()
            self.inner = np.array([vocab[s] for s in symbols], np.int32)
            self.last = np.array([vocab[s + suffix] for s in symbols], np.int32)
            merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
            self.pairs = bpe.PairTable([vocab[a] for a, _ in merges], [vocab[b] for _, b in merges], range(len(merges)), [vocab[a + b] for a, b in merges])
        self.segments = bpe.SegmentEncoder(self._encode_new)

    def _encode_new(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        words = [t.decode("utf-8") for t in texts]
        own, parts = np.zeros(len(words) + 1, np.int64), []
        odd: dict[int, list[int]] = {}
        for k, word in enumerate(words):
            if self.fast and (word.isascii() or ord(max(word)) < _PLAIN):
                plain = word if word.isascii() else unicodedata.normalize("NFC", word)
                parts.extend(x.encode("utf-8") for x in self.pattern.findall(plain.lower()))
            else:
                odd[k] = self.whole.encode(word, add_special_tokens=False).ids
            own[k + 1] = len(parts)
        lengths = np.array([len(p) for p in parts], np.int64)
        offsets = np.zeros(len(parts) + 1, np.int64)
        np.cumsum(lengths, out=offsets[1:])
        if parts:
            raw = np.frombuffer(b"".join(parts), np.uint8)
            symbols = self.inner[raw]
            symbols[offsets[1:] - 1] = self.last[raw[offsets[1:] - 1]]
            ids, ends = bpe.merge_segments(symbols, offsets, self.pairs)
        else:
            ids, ends = np.zeros(0, np.int32), np.zeros(1, np.int64)
        ends = ends[own]
        if not odd:
            return ids, ends
        pieces = [odd[k] if k in odd else ids[ends[k] : ends[k + 1]] for k in range(len(words))]
        out = np.zeros(len(words) + 1, np.int64)
        np.cumsum([len(p) for p in pieces], out=out[1:])
        return np.concatenate([np.asarray(p, np.int32) for p in pieces]), out

    def encode_chunk(self, chunk: tk.TextChunk) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a chunk, and the offsets of each text's ids."""
        starts, ends, per_text = tk.words(chunk)
        ids, counts = self.segments.encode(chunk.data, starts, ends)
        total = np.zeros(len(counts) + 1, np.int64)
        np.cumsum(counts, out=total[1:])
        return ids, total[per_text]


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)
