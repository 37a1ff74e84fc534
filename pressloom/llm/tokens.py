"""Encoding with a public byte-level BPE tokenizer, whose file is given by a path."""

from __future__ import annotations

import json
import re

import numpy as np

#: White space in a row on which tiktoken's split rule may run out of stack (it does at a million).
LONG_SPACE = re.compile(r"(?<!\s)\s{100000}")


class Encoder:
    """Text to little-endian 32-bit ids, as tokenizers.Tokenizer.encode(text, add_special_tokens=False) has them.

    The file's merges are run by tiktoken, four times as fast, if the file is a plain byte-level BPE whose ids
    follow its merges; any other file, and any text with a very long run of white space, by tokenizers itself.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path, self._tokenizer = path, None
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        ranks = self._ranks(spec)
        if ranks is None:
            self._part = self._whole
            self.special = {}
        else:
            import tiktoken

            # The split rule of byte-level BPE (a fixed value of the published tokenizer).
            rule = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
            self._part = tiktoken.Encoding("own", pat_str=rule, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def _ranks(self, spec: dict) -> dict[bytes, int] | None:
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and spec.get("normalizer") is None
        if not plain or model.get("type") != "BPE" or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or model.get("ignore_merges"):
            return None
        vocab = model["vocab"]
        joined = ["".join(x if isinstance(x, list) else x.split(" ")) for x in model["merges"]]
        order = [vocab[x] for x in joined]
        if order != sorted(order) or any(x.get("lstrip") or x.get("rstrip") or x.get("single_word") for x in spec.get("added_tokens", [])):
            return None
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # bytes that stand for themselves; the rest from 256 on
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in set(shown))}
        return {bytes(byte[c] for c in word): i for word, i in vocab.items() if word not in self.special}

    def _whole(self, text: str) -> list[int]:
        if self._tokenizer is None:
            from tokenizers import Tokenizer

            self._tokenizer = Tokenizer.from_file(self.path)
        return self._tokenizer.encode(text, add_special_tokens=False).ids

    def ids(self, text: str) -> list[int]:
        if len(text) >= 100_000 and LONG_SPACE.search(text):
            return self._whole(text)
        for mark, code in self.special.items():
            if mark in text:
                parts = text.split(mark)
                out = self.ids(parts[0])
                for part in parts[1:]:
                    out = [*out, code, *self.ids(part)]
                return out
        return self._part(text)

    def __call__(self, text: str) -> bytes:
        return np.array(self.ids(text), "<u4").tobytes()
