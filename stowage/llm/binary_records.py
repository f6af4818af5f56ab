"""Token ids in length-delimited binary records.

A file is a row of records, each framed as

    length of the payload (8 bytes) | masked CRC of these 8 bytes (4) | payload | masked CRC of the payload (4)

all little-endian. A payload holds the document's id (8 bytes, signed), a byte
that tells whether it has one, the bytes of an id (2 or 4), and the ids. CRCs
are CRC-32, rotated right by 15 bits plus a constant, as a CRC over data that
holds CRCs is weak. A second file, ``.idx``, has for each record where it
begins and how many ids are before it in the file (8 bytes each), for reads in
any order. Reading back goes by that index and checks it.

Documents are sorted over all files by doc_id. A file is written by one task
under a name of its own attempt, and only files that a finished attempt
reported are read, so lost and repeated tasks leave nothing wrong behind.

* A null text is empty; each document, even an empty one, ends with the end id.
* Null doc_ids come first. Rows with equal doc_ids are ordered by a hash of the
  text; wholly equal rows stay apart, each with ids of its own, and can lie in
  several files, so that none of them makes a file too large.
* An empty table gives no files and no rows; extra columns are ignored.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.llm.batches import ROWS, forget_at_exit, shared_dir
from stowage.shipping import ship

MASK = 0xA282EAD8
_HEAD, _CRC, _PAYLOAD, _ENTRY = struct.Struct("<Q"), struct.Struct("<I"), struct.Struct("<qBB"), struct.Struct("<QQ")
#: Words whose ids a worker remembers, and words in one call of the tokenizer.
REMEMBERED = 800_000
#: Characters of longer words are not remembered, so what a worker remembers is bounded.
LONGEST = 64
#: Bytes of text in a file; and in one where there would else be fewer files than cores.
FILE, LEAST_FILE = 512 << 20, 8 << 20
#: Texts by which a tokenizer is tested before it is used.
PROBES = ["Plain words, then a stop. And one more!", "don't it's l'été Ärger STRASSE Straße ǅ ı İ ſ K", " two  blanks\tand\nlines\r\n\x0b\u00a0\u2003 ", "3.14 2,000 a1b2 C3PO x_y snake_case a.b.c, ., ,. .", "日本語 한국어 ไทย عربى हिन्दी 😀 👩\u200d💻 e\u0301", "<|endoftext|> </s> [CLS] a\x1eb \x1e\x1e \x1f\x1c", "", "ÀÉÎ, õ. word.word,word .dot ,comma 'quoted' \"x\"", "supercalifragilisticexpialidocious " * 3]
#: Stands between words that are tokenized in one call; has one id of its own.
BREAK = "\x1e"
_UNSAFE = re.compile("[^\0-ĩı-ɏ]")


# Framing


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK) & 0xFFFFFFFF


def framed(payload: bytes) -> bytes:
    head = _HEAD.pack(len(payload))
    return b"".join((head, _CRC.pack(masked(head)), payload, _CRC.pack(masked(payload))))


def payload_of(doc_id: int | None, ids: np.ndarray) -> bytes:
    return _PAYLOAD.pack(doc_id or 0, doc_id is not None, ids.dtype.itemsize) + ids.tobytes()


def parsed(payload: bytes) -> tuple[int | None, np.ndarray]:
    doc_id, there, width = _PAYLOAD.unpack_from(payload)
    return doc_id if there else None, np.frombuffer(payload, f"<u{width}", offset=_PAYLOAD.size).astype("<u4")


def index_entry(at: int, ids_before: int) -> bytes:
    return _ENTRY.pack(at, ids_before)


class Damaged(ValueError):
    """A record whose checksum or length is wrong."""


def read_record(file) -> bytes | None:
    """The next record's payload; None at the end."""
    head = file.read(12)
    if not head:
        return None
    if len(head) < 12 or _CRC.unpack(head[8:])[0] != masked(head[:8]):
        raise Damaged("a record's length")
    body = file.read(_HEAD.unpack(head[:8])[0] + 4)
    if len(body) != _HEAD.unpack(head[:8])[0] + 4 or _CRC.unpack(body[-4:])[0] != masked(body[:-4]):
        raise Damaged("a record's payload")
    return body[:-4]


def filesystem(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a folder and its path there; Hadoop's short form of local URIs is understood."""
    if uri.startswith("file:") or "://" not in uri:
        return pyarrow.fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(uri)


class Records:
    """A file's records in any order, by its index."""

    def __init__(self, uri: str):
        self.fs, self.path = filesystem(uri)
        with self.fs.open_input_stream(self.path + ".idx") as file:
            self.entries = np.frombuffer(file.read(), "<u8").reshape(-1, 2)
        self.file = self.fs.open_input_file(self.path)

    def __len__(self) -> int:
        return len(self.entries)

    def __getitem__(self, k: int) -> tuple[int | None, np.ndarray]:
        self.file.seek(int(self.entries[k, 0]))
        payload = read_record(self.file)
        if payload is None:
            raise Damaged("the index")
        return parsed(payload)


# Tokenizing


class WordTokenizer:
    """A tokenizer of the tokenizers library that drops white space, asked once for each word.

    Spaces end whatever the tokenizer's own pattern matches, so texts are cut
    there. Letters and the stop or comma behind them are two pieces, and case
    is dropped, so such words are looked up by their letters in lower case;
    this is done only where lower case does not depend on what stands around.
    """

    def __init__(self, definition: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.encode_special_tokens = True
        # For words of plain lower-case letters, which normalisation leaves as they are and the pattern in one
        # piece: the same model without those two steps, which take most of the time.
        self.of_letters = Tokenizer.from_str(definition)
        self.of_letters.encode_special_tokens = True
        self.of_letters.normalizer = None
        self.of_letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.known: dict[str, bytes] = {}
        self.signs = {c: self._ids(c) for c in ".,"}
        self.stop = self.tokenizer.encode(BREAK, add_special_tokens=False).ids
        if len(self.stop) != 1:
            raise ValueError("the sign between words must have one id")
        # What is taken for granted here holds for lower-casing tokenizers that drop white space; others are refused.
        for text, ids in zip(PROBES, self.encode(PROBES), strict=True):
            if ids.tolist() != self.tokenizer.encode(text, add_special_tokens=False).ids:
                raise ValueError(f"this tokenizer does not cut texts into words: {text!r}")

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def _learn(self, new: set[str]) -> None:
        known, signs = self.known, self.signs
        letters, other, tailed = set(), [], []
        for word in new:
            core = word[:-1] if word[-1:] in signs else word
            if core.isalpha() and core.islower() and (core.isascii() or not _UNSAFE.search(core)):
                if core is not word:
                    tailed.append(word)
                if core not in known:
                    letters.add(core)
            elif BREAK in word:
                known[word] = self._ids(word)
            else:
                other.append(word)
        self._ask(self.of_letters, list(letters))
        self._ask(self.tokenizer, other)
        for word in tailed:
            known[word] = known[word[:-1]] + signs[word[-1]]

    def _ask(self, tokenizer, words: list[str]) -> None:
        """Ids of words, many in one call: of each call's ids the break's own id shows where words end."""
        calls = [words[k : k + 64] for k in range(0, len(words), 64)]
        for some, found in zip(calls, tokenizer.encode_batch_fast([f" {BREAK} ".join(x) for x in calls], add_special_tokens=False), strict=True):
            ids = np.array(found.ids, self.kind)
            ends = np.flatnonzero(ids == self.stop[0])
            if len(ends) != len(some) - 1:
                raise ValueError("words were not told apart")
            data, size, a = ids.tobytes(), self.kind.itemsize, 0
            for word, b in zip(some, [*ends.tolist(), len(ids)], strict=True):
                self.known[word] = data[a * size : b * size]
                a = b + 1

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of whole texts."""
        split, found, new = [], [], set()
        get = self.known.get
        for text in texts:
            text = (text or "").replace("\n", " ")
            words = (text.lower() if text.isascii() or not _UNSAFE.search(text) else text).split(" ")
            ids = list(map(get, words))
            at = [k for k, x in enumerate(ids) if x is None]
            new.update(map(words.__getitem__, at))
            split.append(words)
            found.append((ids, at))
        if new:
            if len(self.known) + len(new) > REMEMBERED:
                used = set().union(*split) - new
                self.known = {w: self.known[w] for w in used}
            self._learn(new)
            known = self.known
            for words, (ids, at) in zip(split, found, strict=True):
                for k in at:
                    ids[k] = known[words[k]]
            for word in new:
                if len(word) > LONGEST:
                    known.pop(word, None)
                    known.pop(word[:-1], None)
        return [np.frombuffer(b"".join(ids), self.kind) for ids, _ in found]


_tokenizers: dict[int, WordTokenizer] = {}


def tokenizer(definition: str) -> WordTokenizer:
    """The worker's own tokenizer of a definition, made at its first use."""
    key = hash(definition)
    if key not in _tokenizers:
        _tokenizers.clear()
        _tokenizers[key] = WordTokenizer(definition)
    return _tokenizers[key]


# Writing and reading


def write(docs: DataFrame, definition: str, folder: str, end_id: int, files: int) -> DataFrame:
    """Writes ids of all documents to ``folder``, sorted by doc_id over ``files`` files.

    Runs when the result is: part, file, n_records, n_ids of each file written.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use, part = tokenizer(definition), TaskContext.get().partitionId()
        uri = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}"
        file = index = None
        end, at, records, count = np.array([end_id], use.kind), 0, 0, 0
        try:
            for whole in batches:
                for k in range(0, whole.num_rows, ROWS):
                    batch = whole.slice(k, ROWS)
                    if file is None and batch.num_rows:
                        fs, path = filesystem(uri)
                        fs.create_dir(path.rpartition("/")[0], recursive=True)
                        file, index = fs.open_output_stream(path), fs.open_output_stream(path + ".idx")
                    for doc_id, ids in zip(batch.column("doc_id").to_pylist(), use.encode(batch.column("text").to_pylist()), strict=True):
                        data = framed(payload_of(doc_id, np.concatenate((ids, end))))
                        file.write(data)
                        index.write(index_entry(at, count))
                        at, records, count = at + len(data), records + 1, count + len(ids) + 1
        finally:
            for x in (file, index):
                if x is not None:
                    x.close()
        if file is not None:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([uri]), pa.array([records], pa.int64()), pa.array([count], pa.int64())], ["part", "file", "n_records", "n_ids"])

    tied = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("row"))
    placed = tied.repartitionByRange(files, F.col("doc_id").asc_nulls_first(), "tie", "row").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie").select("doc_id", "text")
    return placed.mapInArrow(run, "part int, file string, n_records long, n_ids long")


def read_back(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every record of the files (file, start), checked on the way."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
                fs, path = filesystem(uri)
                rows: list[tuple] = []
                at = before = 0
                with fs.open_input_stream(path, buffer_size=1 << 20) as file, fs.open_input_stream(path + ".idx", buffer_size=1 << 16) as index:
                    while True:
                        entry, payload = index.read(16), read_record(file)
                        if entry != (b"" if payload is None else index_entry(at, before)):
                            raise Damaged("the index")
                        if payload is not None:
                            doc_id, ids = parsed(payload)
                            rows.append((doc_id, start + before, len(ids), zlib.crc32(ids.tobytes())))
                            at, before = at + len(payload) + 16, before + len(ids)
                        if rows and (payload is None or len(rows) == 5000):
                            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])
                            rows = []
                        if payload is None:
                            break

    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def binary_output(docs: DataFrame, definition: str, end_id: int = 1, files: int | None = None) -> DataFrame:
    """Writes the ids of ``docs`` and reads them back: doc_id, start, n_tokens, ids_crc32 from the files.

    Unless the number of files is given, it follows from the bytes of the texts. One row for each file comes to the driver.
    """
    spark = docs.sparkSession
    ship(spark)
    if not files:
        size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
        files = max(1, -(-size // FILE), min(spark.sparkContext.defaultParallelism * 4, -(-size // LEAST_FILE)))
    folder = shared_dir(spark, "records")
    forget_at_exit(spark, folder)
    written = sorted(map(tuple, write(docs, definition, folder, end_id, files).collect()))
    starts, at = [], 0
    for _, file, _, n in written:
        starts.append((file, at))
        at += n
    listed = spark.createDataFrame(starts, "file string, start long")
    return read_back(listed.repartition(max(1, len(starts))))
