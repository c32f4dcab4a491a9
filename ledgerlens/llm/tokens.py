"""Ids and bytes of the public byte-level and piece vocabularies, as operators need them inside Arrow batches."""

from __future__ import annotations

import functools
import json
import os

import numpy as np

from .bpe import byte_symbols

#: Fixed by the vocabulary: how text is split before the merges.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class ByteLevel:
    """A byte-level BPE file.  Ids follow the merges' order, so they are ranks, and a rank encoder gives the file's ids."""

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = {symbol: b for b, symbol in enumerate(byte_symbols())}
        ids = {token: i for token, i in spec["model"]["vocab"].items()}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: bytes(byte_of[c] for c in token) for token, i in ids.items() if token not in special}
        made = [ids["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
        if made != sorted(made):
            raise ValueError(f"the ids of {path} don't follow its merges")
        self.path, self.size = path, 1 + max([*self.tokens, *special.values()])
        self.fast = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks={t: i for i, t in self.tokens.items()}, special_tokens=special)

    @functools.cached_property
    def library(self):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tokenizers

        return tokenizers.Tokenizer.from_file(self.path)

    def encode(self, text: str, special: bool) -> np.ndarray:
        """Ids of a text; special strings in it are their tokens, or plain text."""
        try:
            return self.fast.encode_to_numpy(text, allowed_special="all" if special else set(), disallowed_special=())
        except ValueError:
            # The rank encoder gives up on runs of millions of white spaces; the file's own library doesn't.
            self.library.encode_special_tokens = not special
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)


class Pieces:
    """A sentence-piece model with byte fallback."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.model.get_piece_size()
        shown = lambda i: bytes([int(self.model.id_to_piece(i)[3:5], 16)]) if self.model.is_byte(i) else self.model.id_to_piece(i).replace("▁", " ").encode()
        self.tokens = {i: shown(i) for i in range(self.size)}

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.model.encode(text, num_threads=1), np.uint32)


@functools.lru_cache(maxsize=2)
def byte_level(path: str | None = None) -> ByteLevel:
    return ByteLevel(path or public_path("byte_bpe_50k.json"))


@functools.lru_cache(maxsize=2)
def pieces(path: str | None = None) -> Pieces:
    return Pieces(path or public_path("piece_bpe_32k.model"))
