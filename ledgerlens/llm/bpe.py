"""BPE encoding and decoding as a bounded-lookahead streaming transducer.

The merge list bounds how far to the right a merge can depend on what follows: a merge of u and v fails only if the end
of v, or a part that v ends in, goes first into a merge of a lower rank, which itself may fail the same way.  Ranks
fall along such a chain, so one pass over the merges in rank order gives the longest chain in symbols.  Tokens that end
that far before the end of what has been read can't change any more; they are emitted and forgotten, so the memory for
a word is constant however long it is.  Decoding reads token surfaces as bytes through an incremental UTF-8 machine.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import itertools
import json
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import byte_slices

END = "</w>"
DEFAULT_VOCABULARY = "word_bpe_49k.json"
#: Bounds of the caches of a Python worker: entries, and code points of a cached piece.
CACHED, CACHED_LENGTH = 900_000, 48

#: Fixed by the vocabulary file: how text is split into words after normalisation.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where Latin-1 prints it, else the next from U+0100."""
    shown = {b for lo, hi in ((33, 126), (161, 172), (174, 255)) for b in range(lo, hi + 1)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class Vocabulary:
    """A word-end BPE vocabulary: ids, ranks of merges, and what a merge list implies about both."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.ids: dict[str, int] = dict(spec["model"]["vocab"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.splitter = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.surfaces = {i: s for s, i in self.ids.items()} | {i: s for s, i in self.special.items()}
        self.ranks: dict[tuple[str, str], int] = {}
        #: token -> (rank, left, right) of the merge that makes it
        self.made: dict[str, tuple[int, str, str]] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.ranks.setdefault((left, right), rank)
            self.made.setdefault(left + right, (rank, left, right))
        self.longest = max(self.symbols(t) for t in self.ids)
        self.symbol_of = byte_symbols()
        self.latin = {b: s for b, s in enumerate(self.symbol_of)}

    @staticmethod
    def symbols(token: str) -> int:
        return len(token) - len(END) if token.endswith(END) and token != END else len(token)

    @staticmethod
    def normal(piece: str) -> str:
        """Composed, lower case; lower case goes by single characters, so there is no final sigma."""
        return piece.lower() if piece.isascii() else unicodedata.normalize("NFC", piece).replace("Σ", "σ").lower()

    def words(self, piece: str) -> list[str]:
        """Words, in byte symbols, of a piece of text without special tokens.  White space only parts words."""
        piece = self.normal(piece)
        if piece.isascii() and piece.isalpha():
            return [piece]
        words = WORDS.findall(piece)
        return words if piece.isascii() and piece.isprintable() else [self.shown(w) for w in words]

    def shown(self, word: str) -> str:
        return word.encode("utf-8").decode("latin-1").translate(self.latin)

    @functools.cached_property
    def lookahead(self) -> int:
        """Symbols to the right that are enough to fix a token."""
        best: dict[str, int] = {}
        most = 0
        for (left, right), _ in sorted(self.ranks.items(), key=lambda x: x[1]):
            reach, end = 0, right
            while True:
                reach = max(reach, best.get(end, 0))
                if end not in self.made:
                    break
                end = self.made[end][2]
            reach += self.symbols(right)
            best[left] = max(best.get(left, 0), reach)
            most = max(most, reach)
        return most + self.longest

    def merge(self, parts: list[str]) -> list[str]:
        """The parts after all merges, lowest rank first, leftmost first; only ranks beside a merge are looked up anew."""
        rank, none = self.ranks.get, 1 << 60
        ranks = [rank(p, none) for p in zip(parts, parts[1:])]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank((parts[i - 1], parts[i]), none)
            if i < len(ranks):
                ranks[i] = rank((parts[i], parts[i + 1]), none)
        return parts

    def stream(self, symbols: Iterable[str]) -> Iterator[str]:
        """Tokens of one word, given as an iterator of symbols; holds no more than twice the lookahead.

        Symbols are read until the window is full or the word ends.  What a full window fixes is emitted and forgotten;
        the end of the word fixes the rest.
        """
        source, window = iter(symbols), 2 * self.lookahead
        held = list(itertools.islice(source, window))
        while len(held) == window:
            # One symbol more tells whether the word ends here, as only its last symbol carries the end.
            more = list(itertools.islice(source, 1))
            if not more:
                break
            done = 0
            for token in self.merge(held[:]):
                if done + len(token) > window - self.lookahead:
                    break
                done += len(token)
                yield token
            held = held[done:] + more + list(itertools.islice(source, done - 1))
        if held:
            held[-1] += END
            yield from self.merge(held)


@functools.lru_cache(maxsize=2)
def vocabulary(path: str | None = None) -> Vocabulary:
    """Read once a worker.  Without a path the file comes from the installed package of public vocabularies."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(DEFAULT_VOCABULARY)
    return Vocabulary(path)


class Encoder:
    """Encodes texts through bounded caches: pieces between spaces stand alone, as no word crosses a space.

    Ids are held as text, joined by spaces, with the tokens' surfaces as bytes beside them.
    """

    def __init__(self, vocab: Vocabulary) -> None:
        self.vocab, self.pieces, self.of_word = vocab, {"": ("", b"")}, {}
        self.surface = {str(i): s.encode("utf-8") for i, s in vocab.surfaces.items()}

    def _word(self, word: str) -> str:
        got = self.of_word.get(word)
        if got is None:
            ids = self.vocab.ids
            got = " ".join([str(ids[t]) for t in self.vocab.stream(word)])
            if len(word) <= CACHED_LENGTH:
                if len(self.of_word) >= CACHED:
                    self.of_word.clear()
                self.of_word[word] = got
        return got

    def _piece(self, piece: str) -> tuple[str, bytes]:
        vocab, ids = self.vocab, []
        for i, part in enumerate(vocab.splitter.split(piece) if vocab.splitter and "<" in piece else [piece]):
            if i % 2:
                ids.append(str(vocab.special[part]))
            else:
                ids += [self._word(word) for word in vocab.words(part)]
        joined = " ".join(ids)
        return joined, b" ".join([self.surface[i] for i in joined.split()])

    def pieces_of(self, text: str) -> list[tuple[str, bytes]]:
        pieces = text.replace("\n", " ").split(" ")
        known = self.pieces
        missing = set(pieces).difference(known)
        if not missing:
            return [known[p] for p in pieces]
        if len(known) + len(missing) > CACHED:
            known = self.pieces = {"": ("", b"")}
            missing = set(pieces) - {""}
        once = {}
        for p in missing:
            (known if len(p) <= CACHED_LENGTH else once)[p] = self._piece(p)
        return [known[p] if p in known else once[p] for p in pieces]

    def encode(self, text: str) -> list[int]:
        return [int(i) for ids, _ in self.pieces_of(text) for i in ids.split()]


class Decoder:
    """An incremental machine from token bytes to text: its state, a begun UTF-8 sequence, crosses tokens and blocks."""

    BLOCK = 4096

    def __init__(self) -> None:
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def decode(self, runs: list[bytes]) -> Iterator[str]:
        """The text of runs of tokens, one space between tokens, in blocks of runs."""
        self.machine.reset()
        for at in range(0, len(runs), self.BLOCK):
            yield self.machine.decode((b" " if at else b"") + b" ".join(runs[at : at + self.BLOCK]))
        yield self.machine.decode(b"", final=True)


def encode_decode(docs: DataFrame, path: str | None = None, keep: list[str] | None = None, with_ids: bool = False, with_decoded: bool = False) -> DataFrame:
    """(doc_id, text) to (doc_id, n_tokens, ids_sha256, decoded_sha256), whole texts, special tokens only as the text has them.

    Null texts count as empty: no tokens, and digests of the empty string.  Null and repeated doc_ids pass through, a
    text or a word of any length takes constant memory beyond itself, an empty table gives an empty result.  `keep`
    names columns that stay; with_ids and with_decoded add the ids and the decoded text.
    """
    keep = keep or ["doc_id"]
    state: list = []

    def run(batches):
        if not state:
            state.extend([Encoder(vocabulary(path)), Decoder()])
        encoder, decoder = state
        last, once = None, None  # rows that repeat the row before, as copies do, are coded once
        for batch in batches:
            for part in byte_slices(batch):
                counts, id_hashes, text_hashes, all_ids, texts = [], [], [], [], []
                for text in part.column("text").to_pylist():
                    if once is None or text != last:
                        pieces = [p for p in encoder.pieces_of(text or "") if p[0]]
                        joined = " ".join([p[0] for p in pieces])
                        digest, back = hashlib.sha256(), []
                        for block in decoder.decode([p[1] for p in pieces]):
                            digest.update(block.encode("utf-8"))
                            if with_decoded:
                                back.append(block)
                        ids = np.array(joined.split(), dtype=np.int32) if with_ids else None
                        last, once = text, (joined.count(" ") + 1 if joined else 0, hashlib.sha256(joined.encode()).hexdigest(), digest.hexdigest(), ids, "".join(back))
                    for held, value in zip((counts, id_hashes, text_hashes, all_ids, texts), once):
                        held.append(value)
                arrays = [part.column(k) for k in keep] + [pa.array(counts, pa.int64()), pa.array(id_hashes, pa.string()), pa.array(text_hashes, pa.string())]
                names = [*keep, "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    arrays, names = [*arrays, pa.array(all_ids, pa.list_(pa.int32()))], [*names, "ids"]
                if with_decoded:
                    arrays, names = [*arrays, pa.array(texts, pa.string())], [*names, "decoded"]
                yield pa.RecordBatch.from_arrays(arrays, names)

    kinds = [f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep]
    schema = ", ".join([*kinds, "n_tokens long, ids_sha256 string, decoded_sha256 string"] + ["ids array<int>"] * with_ids + ["decoded string"] * with_decoded)
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)
