"""Token ids in bit-packed files: every id takes the least number of bits that the vocabulary needs.

A file is a run of blocks, each holding up to ``BLOCK`` ids packed little end first, then the tables: the byte offset of every
block, the id and the first token of every document, and a fixed tail that says how long these are. Block k holds the ids from
k * BLOCK, so any stretch of ids is read with a seek to one offset and unpacked by numpy without a loop.

Documents are range-sorted by id, so files follow each other in document order. Each task writes its files itself, through the
file system of the shared folder, a block at a time. Names are unique per attempt, and a file counts only if the manifest names
it; the manifest is an ordinary table that Spark commits, so lost or repeated tasks leave strays but never wrong data.

Defined results: null texts are empty and get the end id alone; rows whose id is null come first; rows with equal ids follow each
other in the order of their texts' hash; an empty table gives no file. Only the id and text columns are read.
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
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ovenplan.llm.common import importable, settled, shuffle_width
from ovenplan.session import shared_folder

MAGIC = b"IDBITS01"
BLOCK = 8192
#: A task begins a new file after this many ids.
FILE_IDS = 1 << 26
#: Distinct words whose ids a worker remembers; the generation before is kept until as many new ones have come.
MEMORY = 600_000
TAIL = struct.Struct("<8sIIQQQQ")  # magic, bits, block, ids, documents, blocks, offset of the tables
#: Widths that are whole machine numbers.
WHOLE = {8: "<u1", 16: "<u2", 32: "<u4"}
#: Letters that are one token of the splitter, then ASCII signs that are the next: letters of the Latin blocks without the dotted
#: capital I, whose lower case is a letter and a combining mark that the splitter takes from it.
STEM_AND_SIGNS = re.compile(r"([A-Za-zÀ-ÖØ-öø-įıĲ-ɏ]+)([!-/:-@\[-`{-~]+)")
NO_ID = -(1 << 63)  # stands for a null document id in the files


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids as ``bits`` bits each, lowest bit first; the last byte is filled with zeros.

    64 ids fill ``bits`` words of 64 bits, so the k-th ids of all groups of 64 go to the same place of the same word and are
    shifted there together.
    """
    if bits in WHOLE:
        return ids.astype(WHOLE[bits]).tobytes()
    groups = -(-len(ids) // 64)
    table = np.zeros((groups, 64), np.uint64)
    table.ravel()[: len(ids)] = ids
    words = np.zeros((groups, bits), "<u8")
    for k in range(64):
        word, shift = divmod(k * bits, 64)
        words[:, word] |= table[:, k] << np.uint64(shift)
        if shift + bits > 64:
            words[:, word + 1] |= table[:, k] >> np.uint64(64 - shift)
    return words.tobytes()[: (len(ids) * bits + 7) // 8]


def unpack(data: bytes, count: int, bits: int) -> np.ndarray:
    if bits in WHOLE:
        return np.frombuffer(data, WHOLE[bits], count).astype("<u4")
    groups = -(-count // 64)
    words = np.frombuffer(data.ljust(groups * bits * 8, b"\0"), "<u8").reshape(groups, bits)
    table = np.empty((groups, 64), np.uint64)
    for k in range(64):
        word, shift = divmod(k * bits, 64)
        table[:, k] = words[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            table[:, k] |= words[:, word + 1] << np.uint64(64 - shift)
    ids = (table & np.uint64((1 << bits) - 1)).ravel()[:count]
    return ids.astype("<u4") if bits <= 32 else ids


def _opened(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class BitWriter:
    """Writes one file; holds a block of ids and the tables, never the file."""

    def __init__(self, path: str, bits: int):
        system, inner = _opened(path)
        self.path, self.bits = path, bits
        self.out = system.open_output_stream(inner)
        self.waiting: list[np.ndarray] = []
        self.held = self.ids = self.bytes = 0
        self.offsets: list[int] = []
        self.docs: list[int] = []
        self.starts: list[int] = []

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        if ids.size and int(ids.max()) >> self.bits:
            raise ValueError("an id needs more bits than the vocabulary has")
        self.docs.append(NO_ID if doc is None else doc)
        self.starts.append(self.ids)
        self.waiting.append(ids)
        self.ids += len(ids)
        self.held += len(ids)
        if self.held >= BLOCK:
            self._flush(self.held // BLOCK * BLOCK)

    def _flush(self, count: int) -> None:
        ids = np.concatenate(self.waiting)
        for begin in range(0, count, BLOCK):
            data = pack(ids[begin : min(begin + BLOCK, count)], self.bits)
            self.offsets.append(self.bytes)
            self.out.write(data)
            self.bytes += len(data)
        self.waiting = [ids[count:]]
        self.held -= count

    def close(self) -> None:
        if self.held:
            self._flush(self.held)
        for column in (np.array(self.offsets, "<u8"), np.array(self.docs, "<i8"), np.array(self.starts, "<u8")):
            self.out.write(column.tobytes())
        self.out.write(TAIL.pack(MAGIC, self.bits, BLOCK, self.ids, len(self.docs), len(self.offsets), self.bytes))
        self.out.close()


class BitReader:
    """Random access to one file."""

    def __init__(self, path: str):
        system, inner = _opened(path)
        self.file = system.open_input_file(inner)
        size = self.file.size()
        magic, self.bits, self.block, self.ids, docs, blocks, tables = TAIL.unpack(self.file.read_at(TAIL.size, size - TAIL.size))
        if magic != MAGIC:
            raise ValueError(f"{path} is no file of packed ids")
        data = self.file.read_at(8 * (blocks + 2 * docs), tables)
        self.offsets = np.append(np.frombuffer(data, "<u8", blocks), np.uint64(tables))
        self.docs = np.frombuffer(data, "<i8", docs, 8 * blocks)
        self.starts = np.append(np.frombuffer(data, "<u8", docs, 8 * (blocks + docs)), np.uint64(self.ids))

    def read(self, begin: int, end: int) -> np.ndarray:
        """Ids from ``begin`` to before ``end``; reads the blocks that hold them and no others."""
        if begin >= end:
            return np.empty(0, np.uint32)
        first, last = begin // self.block, (end - 1) // self.block
        data = self.file.read_at(int(self.offsets[last + 1] - self.offsets[first]), int(self.offsets[first]))
        ids = unpack(data, min((last + 1) * self.block, self.ids) - first * self.block, self.bits)
        return ids[begin - first * self.block : end - first * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.read(int(self.starts[k]), int(self.starts[k + 1]))

    def documents(self, blocks_at_once: int = 64) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(document id, first token, ids) of all documents in order, reading many blocks at a time."""
        k, span = 0, blocks_at_once * self.block
        while k < len(self.docs):
            begin = int(self.starts[k])
            stop = max(k + 1, int(np.searchsorted(self.starts, begin + span, "right")) - 1)
            ids = self.read(begin, int(self.starts[stop]))
            for j in range(k, stop):
                doc, at = int(self.docs[j]), int(self.starts[j])
                yield None if doc == NO_ID else doc, at, ids[at - begin : int(self.starts[j + 1]) - begin]
            k = stop


class WordIds:
    """Ids of texts from a tokenizers file. The words between blanks are encoded by the library, each once while remembered.

    Normalisation and splitting of such a vocabulary never reach over a blank, or between letters and ASCII signs after them, so the
    ids of a text are those of its words. Words are never changed: the library's added tokens are matched in the text as it is. No
    added token holds a blank or is a run of letters, or of letters and signs. A probe tests this; if it fails, whole texts are encoded.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark gives out the cores
        self.library = Tokenizer.from_file(path)
        self.size = self.library.get_vocab_size(with_added_tokens=True)
        self.closes = np.zeros(self.size, bool)
        self.closes[[i for token, i in self.library.get_vocab().items() if token.endswith("</w>")]] = True
        added = [x.content for x in self.library.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        probe = "Ab, c1\n\td  é.!"
        parts = [i for part in ("ab", ",", "c1", "d", "é", ".!") for i in self._whole(part)]
        apart = not any(t.isalpha() or STEM_AND_SIGNS.fullmatch(t) or t[:1].isalpha() or any(x.isspace() for x in t) for t in added)
        self.by_word = self._whole(probe) == parts and apart

    def _whole(self, text: str) -> list[int]:
        return self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _learn(self, words: set[str]) -> None:
        """Ids of words as bytes. A stem that many words have before their signs goes to the library once."""
        if len(self.known) > MEMORY:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        if older:
            again = [w for w in words if w in older]  # not a set operation, which would go through all of the dictionary
            known.update(zip(again, map(older.__getitem__, again), strict=True))
            words = words.difference(again)
        letters = [w for w in words if w.isalpha()]
        cut, odd = [], []
        for word in words.difference(letters):
            parts = STEM_AND_SIGNS.fullmatch(word)
            if parts is None:
                odd.append(word)
            else:
                cut.append((word, *parts.groups()))
        # Each difference has one operand: with a dictionary as one of several, Python would go through all of it.
        letters += {stem for _, stem, _ in cut}.difference(known).difference(letters)
        odd += {signs for _, _, signs in cut}.difference(known).difference(odd)
        # Words of letters alone end in one marked id each, so many can be encoded as one text and cut at the marks.
        ids = np.array(self._whole(" ".join(letters)), np.uint32)
        ends = np.flatnonzero(self.closes[ids]) + 1
        if len(ends) == len(letters):
            data, ends = ids.tobytes(), (4 * ends).tolist()
            known.update(zip(letters, [data[a:b] for a, b in zip([0, *ends], ends, strict=False)], strict=True))
        else:
            odd += letters
        for word, x in zip(odd, self.library.encode_batch_fast(odd, add_special_tokens=False), strict=True):
            known[word] = np.array(x.ids, np.uint32).tobytes()
        for word, stem, signs in cut:
            known[word] = known[stem] + known[signs]

    def encode_batch(self, texts: list[str | None], end: int | None = None) -> list[np.ndarray]:
        """Ids of each text, with the id ``end`` after them if there is one."""
        last = b"" if end is None else np.uint32(end).tobytes()
        if not self.by_word:
            found = self.library.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)
            return [np.frombuffer(np.array(x.ids, np.uint32).tobytes() + last, np.uint32) for x in found]
        # Blank, tab, line feed and carriage return only: what else counts as white space stays inside a word for the library.
        split = [t.replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if t else [] for t in texts]
        used = set().union(*split)
        missing = used.difference(self.known)
        if missing:
            # The words at hand must outlive a change of generations.
            self._learn(used if len(self.known) > MEMORY else missing)
        known = self.known.__getitem__
        return [np.frombuffer(b"".join(map(known, words)) + last, np.uint32) for words in split]


_WORDS: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One per worker process and file."""
    if path not in _WORDS:
        _WORDS[path] = WordIds(path)
    return _WORDS[path]


def write_packed(docs: DataFrame, vocabulary: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise, sort by id and write files; returns the manifest: part, seq, path, n_docs, n_ids, first (id before the file)."""
    spark = docs.sparkSession
    importable(spark)
    folder = shared_folder(spark, "packed-ids")
    if ":/" not in folder:
        folder = f"file://{folder}"
    make_folder(folder)
    ordered = (
        docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("tie"))
        .repartitionByRange(shuffle_width(spark), "doc", "tie")
        .sortWithinPartitions("doc", "tie")
        .select("doc", "text")
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        code = word_ids(vocabulary)
        bits = bits_for(max(code.size, end_id + 1))
        part, done, writer = TaskContext.get().partitionId(), [], None

        def finish() -> None:
            writer.close()
            done.append((part, len(done), writer.path, len(writer.docs), writer.ids))

        for batch in batches:
            for begin in range(0, batch.num_rows, 64):
                rows = batch.slice(begin, 64)
                for doc, ids in zip(rows.column("doc").to_pylist(), code.encode_batch(rows.column("text").to_pylist(), end_id), strict=True):
                    if writer is None:
                        writer = BitWriter(f"{folder}/ids-{part:06d}-{len(done):05d}-{uuid.uuid4().hex}.bits", bits)
                    writer.add(doc, ids)
                    if writer.ids >= FILE_IDS:
                        finish()
                        writer = None
        if writer is not None:
            finish()
        columns = list(zip(*done, strict=True)) or [[]] * 5
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["part", "seq", "path", "n_docs", "n_ids"])

    files = settled(ordered.mapInArrow(work, "part int, seq int, path string, n_docs long, n_ids long"), "packed-manifest")
    earlier = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    return files.withColumn("first", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)))


def make_folder(path: str) -> None:
    system, inner = _opened(path)
    system.create_dir(inner, recursive=True)


def read_packed(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read back from the files of a manifest. One task takes whole files."""
    spark: SparkSession = manifest.sparkSession
    spread = manifest.select("path", "first").repartition(shuffle_width(spark), "path")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "n_tokens", "ids_crc32"]
        rows: list[tuple] = []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)

        for batch in batches:
            for path, first in zip(batch.column("path").to_pylist(), batch.column("first").to_pylist(), strict=True):
                for doc, at, ids in BitReader(path).documents():
                    rows.append((doc, first + at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    if len(rows) == 10_000:
                        yield out()
                        rows = []
        if rows:
            yield out()

    return spread.mapInArrow(work, "doc_id long, start long, n_tokens long, ids_crc32 long")
