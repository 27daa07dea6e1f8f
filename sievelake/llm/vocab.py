"""Public tokenizers as bytes: ids of texts, and the bytes of each id.

A byte-level BPE file of the tokenizers library whose split is the usual one
and whose texts aren't normalised is encoded by tiktoken from the file's own
vocabulary, which gives the same ids several times as fast; any other file, and
any text with a very long run of white space (which tiktoken's split can't
take), goes to the tokenizers library itself. Texts of more than a megabyte are
encoded in parts, cut at single spaces between other characters, where no
pre-token crosses; so what a task holds at once stays bounded.
"""

from __future__ import annotations

import json
import re

import numpy as np

#: The split of byte-level BPE files that name no pattern of their own.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PART = 1 << 20
SAFE = re.compile(r"(?<=\S) (?=\S)")
LONG_GAP = re.compile(r"\s{2000}")


def byte_of_letter() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones for themselves, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _parts(text: str):
    """The text in parts of about PART characters that no pre-token crosses."""
    at = 0
    while len(text) - at > PART:
        cut = SAFE.search(text, at + PART)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


class ByteLevel:
    """A byte-level BPE file of the tokenizers library. ``special``: the strings of special tokens in texts are these tokens; else plain text."""

    def __init__(self, path: str, special: bool) -> None:
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.slow.encode_special_tokens = not special
        with open(path, encoding="utf-8") as f:
            says = json.load(f)
        letters = byte_of_letter()
        added = {x["content"]: x["id"] for x in says["added_tokens"]}
        vocab = {w: i for w, i in self.slow.get_vocab(with_added_tokens=False).items() if w not in added}
        ranks = {bytes(letters[c] for c in w): i for w, i in vocab.items()}
        self.token = [b""] * (max([*ranks.values(), *added.values()], default=-1) + 1)
        for b, i in ranks.items():
            self.token[i] = b
        for w, i in added.items():
            self.token[i] = w.encode()
        self.fast = None
        split, model = says["pre_tokenizer"] or {}, says["model"]
        plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not says["normalizer"]
        plain = plain and model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix"))
        plain = plain and all(not (x["single_word"] or x["lstrip"] or x["rstrip"] or x["normalized"]) and x["special"] for x in says["added_tokens"])
        if plain and len(model["merges"]) + 256 == len(ranks):
            import tiktoken

            fast = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=added if special else {})
            self.fast = (lambda t: fast.encode(t, allowed_special="all")) if special else fast.encode_ordinary

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text, without tokens that aren't in it."""
        found = []
        for part in _parts(text):
            quick = self.fast and not (len(part) > 2000 and LONG_GAP.search(part))
            found.append(np.array(self.fast(part) if quick else self.slow.encode(part, add_special_tokens=False).ids, np.int32))
        return found[0] if len(found) == 1 else np.concatenate(found)


class Pieces:
    """A sentencepiece model; a piece's bytes have spaces for U+2581, and byte pieces stand for their byte."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.token = []
        for i in range(self.model.get_piece_size()):
            w = self.model.id_to_piece(i)
            self.token.append(bytes([int(w[3:5], 16)]) if self.model.is_byte(i) else w.replace("▁", " ").encode())

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.model.encode(text), np.int32)
