"""Edit-aware token counts: a segment tree over a document's pre-tokens.

A leaf holds the pre-tokens of one stretch of text, an inner node the sums of characters and tokens below it. An edit finds its leaves
by character, tokenises again from a little before the edit until a new pre-token boundary meets an old one, and updates
the sums on the paths above; nothing else is encoded again. The pre-token pattern looks ahead but never back, so equal
text from a common boundary on gives equal pre-tokens.
"""

from __future__ import annotations

import base64
import bisect
import os

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession

#: Folder and vocabulary file of a public byte-level BPE tokenizer, as ranks.
VOCABULARY = os.environ.get("GRIDLOOM_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: The pre-token pattern published with that vocabulary (a fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters that a match may look beyond its end.
LOOK_AHEAD = 3
#: Distinct pre-tokens whose counts a worker remembers, and the longest of them.
REMEMBERED, REMEMBERED_CHARS = 400_000, 64
#: Personal data that the query's edits replace: mail addresses and telephone numbers.
MAIL = r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+"
PHONE = r"\+?\d[\d ().-]{7,}\d"
REDACTED = "[redacted]"


class Counter:
    def __init__(self, vocabulary: bytes):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pattern, self.known = regex.compile(PATTERN), {}

    def pieces(self, text: str, start: int = 0):
        return (m.span() for m in self.pattern.finditer(text, start))

    def tokens(self, piece: str) -> int:
        n = self.known.get(piece)
        if n is None:
            n = len(self.encoding.encode_ordinary(piece))
            if len(piece) <= REMEMBERED_CHARS:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[piece] = n
        return n


def load(path: str = VOCABULARY) -> bytes:
    with open(path, "rb") as f:
        return f.read()


class Tree:
    """A document's text with its pre-token counts; edit() keeps them right."""

    def __init__(self, counter: Counter, text: str):
        self.counter, self.text, self.encoded = counter, text, 0
        words = counter.pattern.findall(text)
        self.leaves = [[(len(w), counter.tokens(w))] for w in words] or [[]]
        n = 1 << (len(self.leaves) - 1).bit_length()
        self.n, self.sums = n, np.zeros((2 * n, 2), np.int64)
        if words:
            self.sums[n : n + len(words)] = [x[0] for x in self.leaves]
        level = n
        while level > 1:
            self.sums[level // 2 : level] = self.sums[level : 2 * level : 2] + self.sums[level + 1 : 2 * level : 2]
            level //= 2

    @property
    def total(self) -> int:
        return int(self.sums[1, 1])

    def _find(self, at: int) -> tuple[int, int]:
        """The leaf that holds character at (or the last with text), and where it starts."""
        at, i, start = min(at, int(self.sums[1, 0]) - 1), 1, 0
        while i < self.n:
            i *= 2
            if at - start >= self.sums[i, 0]:
                start += int(self.sums[i, 0])
                i += 1
        return min(i - self.n, len(self.leaves) - 1), start

    def _set(self, leaf: int, pieces: list[tuple[int, int]]) -> None:
        self.leaves[leaf] = pieces
        i = leaf + self.n
        delta = np.array([sum(p[0] for p in pieces), sum(p[1] for p in pieces)]) - self.sums[i]
        while i:
            self.sums[i] += delta
            i //= 2

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace the characters start to end by new."""
        old = self.text
        start, end = max(0, min(start, len(old))), max(0, min(max(start, end), len(old)))
        self.text = old[:start] + new + old[end:]
        if not old:
            self.__init__(self.counter, self.text)
            self.encoded = len(self.leaves) if self.text else 0
            return
        # pre-tokens that end LOOK_AHEAD characters before the edit can't have seen it
        leaf, at = self._find(max(0, start - LOOK_AHEAD))
        first, begin = leaf, at
        if begin >= start - LOOK_AHEAD and first > 0:
            first, begin = self._find(begin - 1)
        shift = len(self.text) - len(old)
        ends, last, reach = set(), first, begin  # boundaries of the leaves that are replaced, in old characters
        made, done = [], begin
        for a, b in self.counter.pieces(self.text, begin):
            made.append((b - a, self.counter.tokens(self.text[a:b])))
            done = b
            if b - shift < end:
                continue
            while reach < b - shift and last < len(self.leaves):
                for size, _ in self.leaves[last]:
                    reach += size
                    ends.add(reach)
                last += 1
            if reach == b - shift:  # a leaf ends here in the old text as well
                break
        else:
            done, last = len(self.text), len(self.leaves)
        self.encoded += len(made)
        last = max(last, first + 1)
        self._set(first, made)
        for i in range(first + 1, last):
            if self.leaves[i]:
                self._set(i, [])


def redactions(text: str) -> list[tuple[int, int, str]]:
    """Edits that replace personal data, the last first, so that earlier offsets stay right."""
    found = [m.span() for m in _MAIL.finditer(text)] if "@" in text else []
    starts, ends = [a for a, _ in found], [b for _, b in found]
    # mail addresses are in order and apart, so those that a number meets are the ones that end after its start and start before its end
    found += [m.span() for m in _PHONE.finditer(text) if bisect.bisect_right(ends, m.start()) == bisect.bisect_left(starts, m.end())]
    return [(a, b, REDACTED) for a, b in sorted(found, reverse=True)]


_MAIL, _PHONE = regex.compile(MAIL), regex.compile(PHONE)


def row(counter: Counter, doc: int | None, text: str, changes: list[tuple[int, int, str]]) -> tuple:
    """A row of count(), from the text's tree."""
    tree = Tree(counter, text)
    before, n = tree.total, sum(map(len, tree.leaves))
    for change in changes:
        tree.edit(*change)
    return doc, before, n, len(changes), tree.total, tree.encoded


def count(docs: DataFrame, edits=redactions, path: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, n_pretokens, n_edits, n_tokens_edited and n_reencoded (pre-tokens tokenised again) of every row.

    edits: a function from a text to (start, end, new text) in the order in which they apply. A null text is empty and has no tokens.
    The driver reads the vocabulary (a file of fixed size) and executors get it with the code.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load(path))

    def run(batches):
        counter = Counter(shared.value)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                rows.append(row(counter, doc, text, edits(text)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(6)], ["doc_id", "n_tokens", "n_pretokens", "n_edits", "n_tokens_edited", "n_reencoded"])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, n_tokens long, n_pretokens long, n_edits long, n_tokens_edited long, n_reencoded long")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: tokens before and after personal data is replaced, and how much of it was tokenised again."""
    return count(spark.read.parquet(f"{sf_dir}/documents.parquet"))
