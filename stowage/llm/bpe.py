"""Byte-level BPE by prefix dynamic programming.

Of every prefix of a piece's bytes, the BPE encoding has one last token. A
token that ends the prefix is that last token exactly if it and the last token
of what precedes it are a *compatible* pair, that is, if no merge across their
border would have happened first. So one table, ``last``, holds the encodings of
all prefixes: more bytes only extend it, and an edit recomputes it from the
edited byte until it agrees with the old table again.

Compatibility needs no encoding: while BPE merges in order of rank, the token
on the left of the border runs through the right edge of the left token's merge
tree, and the one on the right through the left edge of the right token's. The
pair is compatible unless some merge of two such edge tokens has a rank below
that of the merge which takes one of them away.

* Null texts count as empty: no ids, and decoded to no bytes.
* Surrogates, control characters and the strings of special tokens are
  ordinary text. Every text decodes to its own bytes.
* Repeated rows get equal answers, an empty table none; columns other than
  doc_id and text are never read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from dataclasses import dataclass, field
from itertools import chain

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.llm.batches import Remembered, map_batches

#: White space as the patterns mean it (the Unicode property); some engines' own class has more characters.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Chunks and pieces whose ids a worker remembers.
REMEMBERED = 400_000
_NEVER = 1 << 62
_odd_space = re.compile(r"\s ")
_next_space = re.compile(r" \s")
_lone_space = re.compile(r"(?<=\S) (?=\S)")


@dataclass
class Vocabulary:
    """Tokens by rank and the pattern that splits texts; small, so it travels with the tasks."""

    tokens: list[bytes]
    pattern: str
    key: str = field(default="")

    def __post_init__(self) -> None:
        self.key = self.key or hashlib.sha256(b"\0".join(self.tokens) + self.pattern.encode()).hexdigest()

    @classmethod
    def load(cls, path: str, pattern: str) -> Vocabulary:
        """Of a rank file: on each line a token in base64 and its rank."""
        with open(path, "rb") as lines:
            ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, filter(bytes.strip, lines))}
        if sorted(ranks) != list(range(len(ranks))):
            raise ValueError("ranks must run from 0 without gaps")
        return cls([ranks[k] for k in range(len(ranks))], pattern)


class Encoder:
    """Encodes and decodes with one vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        self.tokens = vocabulary.tokens
        self.ranks = {token: rank for rank, token in enumerate(self.tokens)}
        self.lengths = list(map(len, self.tokens))
        self.longest = max(self.lengths)
        # Finds all tokens that end at a byte; a text's bytes stand for characters.
        self.automaton = ahocorasick.Automaton()
        for rank, token in enumerate(self.tokens):
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.split = regex.compile(vocabulary.pattern.replace("[^\\s", f"[^{WHITE}").replace("\\S", f"[^{WHITE}]").replace("\\s", f"[{WHITE}]")).findall
        self.ids = list(range(len(self.tokens)))  # one object for each id, however often it is used
        self.merged: dict[tuple[int, int], int] = {}
        self.left, self.right = list(self.ids), list(self.ids)
        self._find_merges()
        self._compatible: dict[tuple[int, int], bool] = {}
        self.pieces = Remembered(self._piece, REMEMBERED // 4, __name__)
        self.chunks = Remembered(self._chunk, REMEMBERED, __name__)
        self.decimal = [str(k) for k in self.ids]

    def _find_merges(self) -> None:
        """The two tokens that each token is merged from: those left of its bytes after all merges of lower rank."""
        for rank, token in enumerate(self.tokens):
            if len(token) == 1:
                continue
            parts = [self.ranks[token[k : k + 1]] for k in range(len(token))]
            while len(parts) > 2:
                best = min((self.merged.get(pair, _NEVER), k) for k, pair in enumerate(zip(parts, parts[1:], strict=False)))
                if best[0] == _NEVER:
                    break
                parts[best[1] : best[1] + 2] = [best[0]]
            if len(parts) == 2:
                self.merged[parts[0], parts[1]] = rank
                self.left[rank], self.right[rank] = parts

    def compatible(self, a: int, b: int) -> bool:
        """Whether a text of these two tokens' bytes is encoded as these two tokens."""
        known = self._compatible.get((a, b))
        if known is None:
            if len(self._compatible) >= 4 * REMEMBERED:
                self._compatible.clear()
            known = self._compatible[a, b] = self._check(a, b)
        return known

    def _check(self, a: int, b: int) -> bool:
        x, x_gone = a, _NEVER
        while True:
            y, y_gone = b, _NEVER
            while True:
                made = self.merged.get((x, y), _NEVER)
                # Of two merges of one rank the one on the left comes first.
                if made < x_gone and made <= y_gone and made != _NEVER:
                    return False
                if self.left[y] == y:
                    break
                y, y_gone = self.left[y], y
            if self.right[x] == x:
                return True
            x, x_gone = self.right[x], x

    def extend(self, data: bytes, last: list[int]) -> None:
        """Fills ``last``, the last token of each prefix, for the prefixes of more than ``len(last)`` bytes."""
        known, lengths, done = self._compatible, self.lengths, len(last)
        start = max(0, done - self.longest)
        for at, token in self.automaton.iter(data.decode("latin-1"), start):
            if at != len(last):  # its last token is known already
                continue
            begin = at + 1 - lengths[token]
            if begin:
                before = last[begin - 1]
                fits = known.get((before, token))
                if not (self.compatible(before, token) if fits is None else fits):
                    continue
            last.append(token)
        if len(last) < len(data):
            raise ValueError("the vocabulary lacks a byte")

    def trace(self, last: list[int]) -> tuple[int, ...]:
        """The encoding of the whole from the last tokens of its prefixes."""
        out, at = [], len(last)
        while at:
            token = last[at - 1]
            out.append(self.ids[token])
            at -= len(self.tokens[token])
        return tuple(out[::-1])

    def _piece(self, text: str) -> tuple[int, ...]:
        data = text.encode("utf-8", "surrogatepass")
        whole = self.ranks.get(data)
        if whole is not None:
            return (self.ids[whole],)
        last: list[int] = []
        self.extend(data, last)
        return self.trace(last)

    def _chunk(self, chunk: str) -> tuple[int, ...]:
        """Ids of what follows a lone space, up to the next one."""
        return tuple(chain.from_iterable(map(self.pieces.__getitem__, self.split(" " + chunk))))

    def encode(self, text: str | None) -> list[int]:
        """Ids of a whole text.

        A single space between two characters that are no space begins a
        piece, whatever stands around it, so texts are cut there first and
        what lies between is remembered as a whole.
        """
        if not text:
            return []
        if text[0] == " " or text[-1] == " " or _odd_space.search(text) or _next_space.search(text):
            parts = _lone_space.split(text)
        else:
            parts = text.split(" ")
        first = chain.from_iterable(map(self.pieces.__getitem__, self.split(parts[0])))
        return [*first, *chain.from_iterable(map(self.chunks.__getitem__, parts[1:]))]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def listed(self, ids: list[int]) -> str:
        return ",".join(map(self.decimal.__getitem__, ids))


class PrefixTable:
    """A piece of bytes that can grow and be edited, with its encoding at hand after each change.

    ``work`` counts the prefixes computed so far.
    """

    def __init__(self, encoder: Encoder, data: bytes = b""):
        self.encoder, self.data, self.last, self.work = encoder, b"", [], 0
        self.append(data)

    def append(self, data: bytes) -> None:
        self.data += data
        self.work += len(data)
        self.encoder.extend(self.data, self.last)

    def replace(self, begin: int, end: int, by: bytes) -> None:
        """Puts ``by`` in place of the bytes from ``begin`` to ``end``.

        Prefixes that end before the edit keep their tokens. Behind it, once as
        many prefixes in a row as a token has bytes at most have their old
        tokens again, all that follow have them too.
        """
        if not 0 <= begin <= end <= len(self.data):
            raise IndexError("an edit must lie within the data")
        old, old_data = self.last, self.data
        self.data = old_data[:begin] + by + old_data[end:]
        self.last, moved, same = old[:begin], len(by) - (end - begin), 0
        window = self.encoder.longest
        for at in range(begin, len(self.data)):
            self.encoder.extend(self.data[: at + 1], self.last)
            self.work += 1
            same = same + 1 if at >= begin + len(by) and self.last[at] == old[at - moved] else 0
            if same >= window:
                self.last += old[at + 1 - moved :]
                break

    @property
    def ids(self) -> tuple[int, ...]:
        return self.encoder.trace(self.last)


_encoders: dict[str, Encoder] = {}


def encoder(vocabulary: Vocabulary) -> Encoder:
    """The worker's own encoder of a vocabulary, made at its first use."""
    if vocabulary.key not in _encoders:
        _encoders.clear()
        _encoders[vocabulary.key] = Encoder(vocabulary)
    return _encoders[vocabulary.key]


def encode_documents(docs: DataFrame, vocabulary: Vocabulary, also: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``also`` of every row with ``ids`` (array<int>)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        use = encoder(vocabulary)
        ids = [use.encode(x) for x in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in also), pa.array(ids, pa.list_(pa.int32()))], [*also, "ids"])

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    return map_batches(docs.select(*dict.fromkeys([*also, "text"])), run, ", ".join(f"`{c}` {kinds[c]}" for c in also) + ", ids array<int>")


def round_trip(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: digests of the ids, and of the bytes decoded from them."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        use = encoder(vocabulary)
        n, ids_digest, bytes_digest = [], [], []
        for text in batch.column("text").to_pylist():
            ids = use.encode(text)
            n.append(len(ids))
            ids_digest.append(hashlib.sha256(use.listed(ids).encode()).hexdigest())
            bytes_digest.append(hashlib.sha256(use.decode(ids)).hexdigest())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_digest, pa.string()), pa.array(bytes_digest, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
