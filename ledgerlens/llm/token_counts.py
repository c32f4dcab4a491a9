"""Token counts by prefix dynamic programming.

BPE is local: a row of tokens is the encoding of its text exactly if each token encodes to itself and each two
neighbours stay apart.  So the encoding of a prefix is that of a shorter prefix and one more token, the only one that
fits its neighbour.  Going through a word once thus gives the exact count of every prefix, open or closed by the word's
end, and truncation and budget questions are looked up rather than encoded again.
"""

from __future__ import annotations

import bisect
import functools
import itertools
import unicodedata
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import CACHED_LENGTH, END, WORDS, Vocabulary, vocabulary
from .common import byte_slices

CACHED = 700_000
#: A word's count, and for each of its prefixes, as text that goes on, the count and the start of the last token.
Row = tuple[int, bytes | array, bytes | array]


class PrefixCounter:
    def __init__(self, vocab: Vocabulary) -> None:
        self.vocab = vocab
        self.fitting: dict[tuple[str, str], bool] = {}
        made = vocab.made
        self.tokens: set[str] = set(vocab.ids) - set(made)
        for token, (rank, left, right) in sorted(made.items(), key=lambda x: x[1][0]):
            if left in self.tokens and right in self.tokens and self._apart(left, right, rank):
                self.tokens.add(token)
        self.of_word: dict[str, Row] = {}
        self.of_piece: dict[str, int] = {"": 0}
        self.last_spans: tuple = (None, None)
        self.long_word: tuple = (None, None)
        self.last_symbols: tuple = (None, "", [])

    def _apart(self, left: str, right: str, before: float = float("inf")) -> bool:
        """Whether no merge across the border comes before the merges that made both sides.

        The side made later is undone first, as the border's parts met before it was made; of equal ranks the left
        one was made first.
        """
        ranks, made = self.vocab.ranks, self.vocab.made
        while True:
            rank = ranks.get((left, right))
            if rank is not None and rank < before:
                return False
            of_left, of_right = made.get(left), made.get(right)
            if of_left is None and of_right is None:
                return True
            if of_right is None or of_left is not None and of_left[0] > of_right[0]:
                before, left = of_left[0], of_left[2]
            else:
                before, right = of_right[0] + 1, of_right[1]

    def _fits(self, left: str, right: str) -> bool:
        key = (left, right)
        got = self.fitting.get(key)
        if got is None:
            if len(self.fitting) >= CACHED // 2:
                self.fitting.clear()
            got = self.fitting[key] = self._apart(left, right)
        return got

    def _step(self, word: str, i: int, last: list[str], end: str) -> tuple[int, str]:
        """Where the last token of word[:i] starts, and that token."""
        tokens = self.tokens
        for j in range(max(0, i - self.vocab.longest), i):
            token = word[j:i] + end
            if token in tokens and (j == 0 or self._fits(last[j], token)):
                return j, token
        raise AssertionError(f"no token ends at {i}")

    def prefix_counts(self, word: str, closed: bool = True) -> list[int]:
        """The count of every prefix of a word in byte symbols: as text that ends there, or as one that goes on."""
        last, open_counts, counts = [""], [0], [0]
        for i in range(1, len(word) + 1):
            j, token = self._step(word, i, last, "")
            last.append(token)
            open_counts.append(open_counts[j] + 1)
            if closed:
                counts.append(open_counts[self._step(word, i, last, END)[0]] + 1)
        return counts if closed else open_counts

    def _word(self, word: str) -> Row:
        """The word's row, walked once; of long words the last one's row stays, for all cuts of it."""
        got = self.of_word.get(word)
        if got is None:
            if self.long_word[0] == word:
                return self.long_word[1]
            got = self._walk(word)
            if len(word) <= CACHED_LENGTH:
                if len(self.of_word) >= CACHED:
                    self.of_word.clear()
                self.of_word[word] = got
            else:
                self.long_word = (word, got)
        return got

    def _symbols(self, word: str) -> tuple[str, list[int]]:
        """A word in byte symbols, and how many of them each of its prefixes has; the last word's stay."""
        if self.last_symbols[0] != word:
            self.last_symbols = (word, self.vocab.shown(word), list(itertools.accumulate([len(c.encode("utf-8")) for c in word], initial=0)))
        return self.last_symbols[1:]

    def _walk(self, word: str) -> Row:
        """The word's row of the table: its own count, and for each of its prefixes the open count and the last token's start.

        Only one token fits, so the order of trying is free: mostly the token before has grown, or a new one starts.
        """
        tokens, known, longest, n = self.tokens, self.fitting.get, self.vocab.longest, len(word)
        last, counts, starts, j = [""], [0], [0], 0
        for i in range(1, n + 1):
            end = END if i == n else ""
            token = word[j:i] + end
            if token not in tokens or i - j > longest or j and not (known((last[j], token)) or self._fits(last[j], token)):
                grown, j = j, i - 1
                token = word[j:i] + end
                if grown == j or not (known((last[j], token)) or self._fits(last[j], token)):
                    for j in range(i - longest if i > longest else 0, i - 1):
                        token = word[j:i] + end
                        if j != grown and token in tokens and (not j or known((last[j], token)) or self._fits(last[j], token)):
                            break
                    else:
                        raise AssertionError(f"no token ends at {i}")
            last.append(token)
            counts.append(counts[j] + 1)
            starts.append(j)
        return (counts[n], bytes(counts), bytes(starts)) if n < 256 else (counts[n], array("I", counts), array("I", starts))

    def word_prefix(self, word: str, i: int, row: Row | None = None) -> int:
        """The count of word[:i] as a text that ends there: one step on from the stored counts of what goes on."""
        count, counts, starts = row or self._word(word)
        if i == 0 or i == len(word):
            return count if i else 0
        for j in range(max(0, i - self.vocab.longest), i):
            token = word[j:i] + END
            if token in self.tokens and (j == 0 or self._fits(word[starts[j] : j], token)):
                return counts[j] + 1
        raise AssertionError(f"no token ends at {i}")

    def _piece(self, piece: str) -> int:
        vocab = self.vocab
        parts = vocab.splitter.split(piece) if vocab.splitter and "<" in piece else [piece]
        return sum(1 if i % 2 else sum([self._word(w)[0] for w in vocab.words(part)]) for i, part in enumerate(parts))

    def _spans(self, piece: str) -> tuple[list[int], list[str], list[int], dict[int, int]] | None:
        """Starts and texts of a piece's words, special tokens among them, the counts before them, and for special ones the word that their plain text joins.

        None where code points don't stay in place, as decomposed letters.
        """
        if self.last_spans[0] != piece:
            vocab = self.vocab
            parts = vocab.splitter.split(piece) if vocab.splitter and "<" in piece else [piece]
            starts, words, counts, special, at, spans = [], [], [0], {}, 0, None
            for k, part in enumerate(parts):
                if k % 2:
                    special[len(words)] = first
                    starts.append(at)
                    words.append(part)
                    counts.append(counts[-1] + 1)
                else:
                    first, normal = len(words), vocab.normal(part)
                    if not (part.isascii() or unicodedata.is_normalized("NFC", part) and len(normal) == len(part)):
                        break
                    for m in WORDS.finditer(normal):
                        starts.append(at + m.start())
                        words.append(m[0])
                        counts.append(counts[-1] + self._word(vocab.shown(m[0]))[0])
                at += len(part)
            else:
                spans = starts, words, counts, special
            self.last_spans = (piece, spans)
        return self.last_spans[1]

    def piece_prefix(self, piece: str, i: int) -> int:
        """The count of piece[:i]: its whole words' counts, and what the word that the cut falls into has stored."""
        spans = self._spans(piece)
        if spans is None:
            return self._piece(piece[:i])
        starts, words, counts, special = spans
        k = bisect.bisect_left(starts, i) - 1
        if k < 0:
            return 0
        word, inside = words[k], min(i - starts[k], len(words[k]))
        if k in special and inside < len(word):  # a cut special token is plain text, as what stands before it
            first = special[k]
            return counts[first] + self._piece(piece[starts[first] : i])
        if inside == len(word) or k in special:
            return counts[k + 1]
        if word[0] == "'" and inside > 1:  # a cut contraction is two words
            return counts[k] + self._piece(word[:inside])
        shown, at = self._symbols(word)
        return counts[k] + self.word_prefix(shown, at[inside])

    def longest_cut(self, piece: str, budget: int) -> int:
        """Code points of the longest part of a piece, short of all of it, that takes at most `budget` tokens."""
        spans = self._spans(piece)
        if spans is None:
            return next((i for i in range(len(piece) - 1, 0, -1) if self._piece(piece[:i]) <= budget), 0)
        starts, words, counts, special = spans
        k = bisect.bisect_right(counts, budget) - 1  # the word that passes the budget
        if k >= len(words):
            return len(piece) - 1
        word = words[k]
        if k in special:
            return next((starts[k] + i for i in range(len(word) - 1, 0, -1) if self.piece_prefix(piece, starts[k] + i) <= budget), starts[k])
        left = budget - counts[k]
        shown, at = self._symbols(word)
        row = self._word(shown)
        for i in range(len(word) - 1, 0, -1):
            if word[0] == "'" and i > 1:
                n = self._piece(word[:i])
            elif min(row[1][max(0, at[i] - self.vocab.longest) : at[i]]) < left:  # its last token starts after one of these
                n = self.word_prefix(shown, at[i], row)
            else:
                continue
            if n <= left:
                return starts[k] + i
        return starts[k]

    def piece_counts(self, pieces: list[str]) -> list[int]:
        """Counts of pieces without spaces."""
        known = self.of_piece
        missing = set(pieces).difference(known)
        if missing and len(known) + len(missing) > CACHED:
            known = self.of_piece = {"": 0}
            missing = set(pieces) - {""}
        once = {}
        for p in missing:
            (known if len(p) <= CACHED_LENGTH else once)[p] = self._piece(p)
        if once:
            return [known[p] if p in known else once[p] for p in pieces]
        return list(map(known.__getitem__, pieces))

    def table(self, text: str) -> PrefixTable:
        return PrefixTable(self, text)


class PrefixTable:
    """The exact token count of every prefix of one text.

    `ends` and `counts` hold the prefixes that end with a piece; a prefix that ends inside a piece adds what the piece's
    words have stored for theirs.  Nothing is encoded again.
    """

    def __init__(self, counter: PrefixCounter, text: str) -> None:
        self.counter, self.pieces = counter, text.replace("\n", " ").split(" ")
        self.counts = list(itertools.accumulate(counter.piece_counts(self.pieces)))

    @functools.cached_property
    def ends(self) -> list[int]:
        """Code points up to each piece's end."""
        return list(itertools.accumulate(map(len, self.pieces), lambda at, n: at + 1 + n))

    @property
    def total(self) -> int:
        return self.counts[-1]

    def count(self, cut: int) -> int:
        """Tokens of the first `cut` code points."""
        k = bisect.bisect_left(self.ends, cut)
        if k == len(self.ends):
            return self.total
        start = self.ends[k] - len(self.pieces[k])
        before = self.counts[k - 1] if k else 0
        return before if cut <= start else before + self.counter.piece_prefix(self.pieces[k], cut - start)

    def every(self) -> list[int]:
        """The counts of all prefixes, of 0, 1, ... code points."""
        return [self.count(i) for i in range(self.ends[-1] + 1)]

    def longest_prefix(self, budget: int) -> int:
        """Code points of the longest prefix that takes at most `budget` tokens; it may end inside a word."""
        if budget < 0:
            return 0
        k = bisect.bisect_right(self.counts, budget)  # the first piece that takes too many
        if k == len(self.counts):
            return self.ends[-1]
        before, start = self.counts[k - 1] if k else 0, self.ends[k] - len(self.pieces[k])
        return start + self.counter.longest_cut(self.pieces[k], budget - before)


def count_tokens(docs: DataFrame, limit: int = 2048, path: str | None = None, budget: int | None = None, with_prefixes: bool = False) -> DataFrame:
    """(doc_id, text) to (doc_id, n_bytes, n_tokens, over_limit), whole texts; null texts count as empty.

    All counts are read from a text's table of prefixes.  With a budget, prefix_chars is the length in code points of
    the longest prefix that fits it, which may end inside a word; with_prefixes adds prefix_counts, the count of every
    prefix.  Null and repeated doc_ids pass through; a text of any length keeps one number a piece in memory; an empty
    table gives an empty result.
    """
    state: list[PrefixCounter] = []

    def run(batches):
        if not state:
            state.append(PrefixCounter(vocabulary(path)))
        counter = state[0]
        for batch in batches:
            for part in byte_slices(batch):
                texts = [t or "" for t in part.column("text").to_pylist()]
                tables = [counter.table(t) for t in texts]
                n = [t.total for t in tables]
                arrays = [part.column("doc_id"), pa.array([len(t.encode("utf-8")) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())]
                names = ["doc_id", "n_bytes", "n_tokens", "over_limit"]
                if budget is not None:
                    arrays, names = [*arrays, pa.array([t.longest_prefix(budget) for t in tables], pa.int64())], [*names, "prefix_chars"]
                if with_prefixes:
                    arrays, names = [*arrays, pa.array([t.every() for t in tables], pa.list_(pa.int64()))], [*names, "prefix_counts"]
                yield pa.RecordBatch.from_arrays(arrays, names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    extra = ", prefix_chars long" * (budget is not None) + ", prefix_counts array<long>" * with_prefixes
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean" + extra)
