"""Byte-level BPE encoding and decoding.

A piece of text is encoded from its longest vocabulary matches: the automaton over the tokens, read as
Latin-1 strings, gives the longest token at a place; tokens are taken left to right,
and where a token and its predecessor cannot be neighbours in a merge result, a shorter token is tried or
the predecessor is taken back. Places that were given up are marked, so each is tried once and the work
is linear. Whether two tokens can be neighbours is decided by undoing their merges and is memoised. The
result is that of applying the merges by rank.

The vocabulary is a rank file (base64 token, rank) whose place is a parameter. The driver reads it and
sends its bytes, under 1 MB, along; nothing is opened on the executors.

Null texts count as empty and give no tokens. Long texts are encoded in stretches, long pieces in linear
time. Equal rows give equal results, an empty table an empty one. Other columns may have any names.
Token ids are kept as a binary of little-endian unsigned 32-bit integers.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsentry.llm.common import short_batches, worker_cache

# Bounds on what a worker remembers.
WORDS = 200_000
PAIRS = 1_000_000
# Characters of text whose pieces are held at once.
STRETCH = 500_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


UINT32 = "I"
RUN = re.compile(r"\s\s")


class _Memo(dict):
    """Values by word, made when first asked for.

    A full memo becomes the older one, of which words that are asked for again are taken over. Long words
    are not kept.
    """

    def __init__(self, make):
        super().__init__()
        self.make = make
        self.older: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        value = self.older.get(word)
        if value is None:
            value = self.make(word)
        if len(word) <= 64:
            if len(self) >= WORDS:
                self.older = dict(self)
                self.clear()
            self[word] = value
        return value


class Vocabulary:
    """The tables of one rank file. Tokens are strings here, a Latin-1 character for each byte."""

    def __init__(self, ranks: bytes, pattern: str):
        import base64

        import ahocorasick
        import regex

        self.pattern = regex.compile(pattern)
        entries = [line.split() for line in ranks.splitlines() if line]
        self.id_of = {base64.b64decode(token).decode("latin-1"): int(rank) for token, rank in entries}
        self.size = max(self.id_of.values()) + 1
        self.token_of = [""] * self.size
        for token, rank in self.id_of.items():
            self.token_of[rank] = token
        self.length_of = [len(token) for token in self.token_of]
        self.spelled = [token.encode("latin-1") for token in self.token_of]
        self.most = max(self.length_of)
        self.trie = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for token in self.id_of:
            self.trie.add_word(token)
        self.prefix_of = self._prefixes()
        # By rank: the parts of the last merge; by pair of ranks: the merge; whether a pair can be neighbours.
        self.left_of, self.right_of = list(range(self.size)), list(range(self.size))
        self.merged: dict[int, int] = {}
        self.pairs: dict[int, bool] = {}
        self.words = _Memo(self._encode_word)
        self.spaced = _Memo(lambda word: self._encode_word(word, " "))
        self._undo_merges()

    def _prefixes(self) -> list[int]:
        """The longest shorter token that each token starts with; -1 if there is none."""
        found = [-1] * self.size
        for token, rank in self.id_of.items():
            for end in range(len(token) - 1, 0, -1):
                if (shorter := self.id_of.get(token[:end])) is not None:
                    found[rank] = shorter
                    break
        return found

    def _undo_merges(self) -> None:
        """The last merge of each token, in order of rank; single bytes are their own parts."""
        for rank, token in enumerate(self.token_of):
            left = self.prefix_of[rank]
            while left >= 0:
                right = self.id_of.get(token[self.length_of[left] :])
                if right is not None and left < rank and right < rank and self._meet(left, right):
                    self.left_of[rank], self.right_of[rank] = left, right
                    self.merged[left * self.size + right] = rank
                    break
                left = self.prefix_of[left]

    def _meet(self, left: int, right: int) -> bool:
        """Whether no merge across the border of the two tokens would have come before their own.

        The later of the two merges is undone on the side of the border, over and over; any merge over
        the border that ranks below what has been undone would have happened first.
        """
        size, merged, left_of, right_of = self.size, self.merged, self.left_of, self.right_of
        limit = size
        while True:
            if merged.get(left * size + right, limit) < limit:
                return False
            inner, outer = right_of[left], left_of[right]
            if left > right:
                if inner != left:
                    limit, left = left, inner
                elif outer != right:
                    limit, right = right + 1, outer
                else:
                    return True
            elif outer != right:
                limit, right = right + 1, outer
            elif inner != left:
                limit, left = left, inner
            else:
                return True

    def _longest(self, piece: str, place: int) -> int:
        """The longest token at a place; the trie bounds its length, as its paths go on to longer tokens."""
        ahead = piece[place : place + self.most]
        length = self.trie.longest_prefix(ahead)
        while (rank := self.id_of.get(ahead[:length])) is None:
            length -= 1
        return rank

    def encode_piece(self, text: str) -> list[int]:
        piece = text if text.isascii() else text.encode().decode("latin-1")
        whole = self.id_of.get(piece)
        if whole is not None:
            return [whole]
        size, ranks = len(piece), self.size
        longest, length_of, prefix_of, pairs = self._longest, self.length_of, self.prefix_of, self.pairs
        given_up = None  # places that turned out to be dead ends
        tokens: list[int] = []
        place, last, token = 0, -1, longest(piece, 0)
        while True:
            while True:
                end = place + length_of[token]
                if given_up is None or end not in given_up:
                    if last < 0:
                        break
                    key = last * ranks + token
                    fits = pairs.get(key)
                    if fits is None:
                        if len(pairs) >= PAIRS:
                            pairs.clear()
                        fits = pairs[key] = self._meet(last, token)
                    if fits:
                        break
                token = prefix_of[token]
                if token < 0:
                    break
            if token < 0:
                # Nothing fits here: give up this place and shorten the token before it.
                if given_up is None:
                    given_up = set()
                given_up.add(place)
                token = tokens.pop()
                place -= length_of[token]
                last = tokens[-1] if tokens else -1
                continue
            tokens.append(token)
            if end == size:
                return tokens
            place, last, token = end, token, longest(piece, end)

    def _encode_word(self, word: str, before: str = "") -> bytes:
        if word.isalpha():  # a run of letters, with the space before it, is one piece
            return array(UINT32, self.encode_piece(before + word)).tobytes()
        ids = [rank for piece in self.pattern.findall(before + word) for rank in self.encode_piece(piece)]
        return array(UINT32, ids).tobytes()

    def encode(self, text: str) -> bytes:
        """The ids, packed.

        The pattern always starts a piece at a space between two other characters, so the text is cut
        there and each distinct word is encoded once. Where white space comes in runs, the pattern itself
        has to cut.
        """
        if RUN.search(text) is None:
            first, *rest = text.split(" ")
            return self.words[first] + b"".join(map(self.spaced.__getitem__, rest))
        if len(text) <= STRETCH:
            return b"".join(map(self.words.__getitem__, self.pattern.findall(text)))
        out = bytearray()
        for match in self.pattern.finditer(text):
            out += self.words[match.group()]
        return bytes(out)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.spelled.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _vocabulary(ranks: bytes, pattern: str) -> Vocabulary:
    import hashlib

    cache = worker_cache()
    key = "bpe" + hashlib.sha256(ranks).hexdigest() + pattern
    if key not in cache:
        cache[key] = Vocabulary(ranks, pattern)
    return cache[key]


def _apply(df: DataFrame, path: str, pattern: str, columns: list[tuple[str, str]], source: str, step) -> DataFrame:
    """Append binary columns made from column ``source`` in Python workers."""
    import pyarrow as pa
    from pyspark.sql.types import BinaryType, StructField, StructType

    short_batches(df.sparkSession)
    with open(path, "rb") as file:
        ranks = df.sparkSession.sparkContext.broadcast(file.read())
    place = df.columns.index(source)
    names = [name for name, _ in columns]
    schema = StructType([*df.schema.fields, *[StructField(name, BinaryType()) for name in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(ranks.value, pattern)
        for batch in batches:
            made = [step(vocabulary, value.as_py()) for value in batch.column(place)]
            added = [pa.array([row[i] for row in made], pa.binary()) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, *names])

    return df.mapInArrow(run, schema)


def encode(df: DataFrame, text: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``df`` with ``token_ids``."""

    def step(vocabulary, value):
        return (vocabulary.encode(value or ""),)

    return _apply(df, path or default_vocabulary(), pattern or default_pattern(), [("token_ids", "")], text, step)


def decode(df: DataFrame, ids: str = "token_ids", path: str | None = None) -> DataFrame:
    """``df`` with ``decoded``, the bytes that the ids stand for."""

    def step(vocabulary, value):
        return (vocabulary.decode(value or b""),)

    return _apply(df, path or default_vocabulary(), default_pattern(), [("decoded", "")], ids, step)


def round_trip(df: DataFrame, text: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``df`` with ``token_ids`` and ``decoded`` in one pass over the texts."""

    def step(vocabulary, value):
        ids = vocabulary.encode(value or "")
        return ids, vocabulary.decode(ids)

    columns = [("token_ids", ""), ("decoded", "")]
    return _apply(df, path or default_vocabulary(), pattern or default_pattern(), columns, text, step)


def n_tokens(ids: str = "token_ids"):
    return (F.octet_length(ids) / 4).cast("long")
