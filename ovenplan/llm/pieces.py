"""SentencePiece encoding and decoding with merge-type (BPE) vocabularies.

A text's symbols are merged by an agenda of adjacent pairs: the pair whose joint piece scores best goes first, the leftmost among
equals; each merge puts the pairs with its neighbours on the agenda, and entries whose symbols have changed meanwhile are skipped.
Pieces outside the vocabulary become their UTF-8 bytes. No piece holds a word start after another character, or a line feed
beside another (checked when a vocabulary is loaded), so the stretches of a text between those places are merged one by one, and a
worker remembers the ids of stretches that it met lately.

All stretches that are new in an Arrow batch are checked against the sentencepiece library in one call. Where the two differ, the
library's ids are returned and ``agrees`` is false for the texts that hold the stretch. Decoding is the library's.

Defined results: a null or empty text has no ids and decodes to an empty text; each row is encoded by itself, so repeated rows
get the same answer; an empty table gives an empty result. Other columns of the input are kept; those named like a result are
replaced.
"""

from __future__ import annotations

import heapq
import re
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from ovenplan.llm.common import importable

SPACE = "▁"
LETTER = r"[^\W\d_]"
PLACE_BITS = 40
PLACES = (1 << PLACE_BITS) - 1
#: Stretches remembered per worker; the generation before is kept until as many new ones have come.
MEMORY = 600_000
#: Rows encoded at a time, so that a batch of very long texts is not split all at once.
ROWS_AT_ONCE = 64


class PieceCoder:
    """Encoder and decoder for one vocabulary file."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        lib = self.library
        self.ids: dict[str, int] = {}
        self.bytes: dict[int, int] = {}
        self.pieces: list[str] = [lib.id_to_piece(i) for i in range(lib.get_piece_size())]
        self.unknown = lib.unk_id()
        self.silent = set()
        for i, piece in enumerate(self.pieces):
            if lib.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
            elif lib.is_control(i) or lib.is_unknown(i):
                self.silent.add(i)
            elif lib.is_unused(i):
                raise ValueError("vocabularies with unused pieces are not supported")
            else:
                self.ids[piece] = i
        # Equal scores share a rank, so that the leftmost pair goes first among them.
        levels = sorted({-lib.get_score(i) for i in self.ids.values()})
        place = {level: rank for rank, level in enumerate(levels)}
        self.joins: dict[str, dict[str, tuple[int, str]]] = {}
        for piece, i in self.ids.items():
            entry = (place[-lib.get_score(i)] << PLACE_BITS, piece)
            for cut in range(1, len(piece)):
                left, right = piece[:cut], piece[cut:]
                if all(len(half) == 1 or half in self.ids for half in (left, right)):
                    self.joins.setdefault(sys.intern(left), {})[sys.intern(right)] = entry
        if any(re.search(f"[^{SPACE}]{SPACE}", p) or len(p) > 1 and "\n" in p for p in self.ids):
            raise ValueError("a piece crosses a word start or a line feed")
        if any(re.search(rf"{LETTER}[.,]|[.,]{LETTER}", p) for p in self.ids):
            self.stretches = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")
        else:
            # A full stop or comma shares no piece with a letter beside it, so a word is met again whatever follows it.
            self.stretches = re.compile(
                f"{SPACE}*{LETTER}++(?=[.,{SPACE}\n]|$)|[.,]++(?={LETTER}|[{SPACE}\n]|$)|\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+"
            )
        self.decimals = [str(i) for i in range(len(self.pieces))]
        self.known: dict[str, bytes] = {}  # ids as 32-bit numbers
        self.older: dict[str, bytes] = {}
        self.disputed: set[str] = set()

    def merge(self, text: str) -> list[str]:
        """Pieces of ``text`` by the agenda of adjacent pairs. An entry is a pair's rank and the place of its left symbol."""
        joins = self.joins.get
        symbols = list(text)
        agenda = []
        left = symbols[0]
        for i, right in enumerate(symbols[1:]):
            found = joins(left)
            if found is not None and right in found:
                agenda.append(found[right][0] | i)
            left = right
        if not agenda:
            return symbols
        heapq.heapify(agenda)
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while agenda:
            entry = heapq.heappop(agenda)
            i = entry & PLACES
            j = after[i]
            if j == n:
                continue
            # The pair may have changed since it was put down; then its rank is another, or it is no pair any more.
            found = joins(symbols[i])
            pair = found.get(symbols[j]) if found is not None else None
            if pair is None or pair[0] != entry - i:
                continue
            piece = symbols[i] = pair[1]
            symbols[j] = ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                found = joins(piece)
                if found is not None and symbols[k] in found:
                    heapq.heappush(agenda, found[symbols[k]][0] | i)
            h = before[i]
            if h >= 0:
                found = joins(symbols[h])
                if found is not None and piece in found:
                    heapq.heappush(agenda, found[piece][0] | h)
        return [s for s in symbols if s]

    def _ids(self, stretch: str) -> bytes:
        out = array("i")
        for piece in self.merge(stretch):
            known = self.ids.get(piece)
            if known is not None:
                out.append(known)
            elif self.bytes:
                out.extend(self.bytes[b] for b in piece.encode())
            else:
                out.append(self.unknown)
        return out.tobytes()

    def split(self, text: str | None) -> list[str]:
        return self.stretches.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def learn(self, stretches: set[str]) -> None:
        """Merge stretches not met lately, and check them all against the library in one call."""
        fresh = []
        for stretch in stretches:
            ids = self.older.get(stretch)
            if ids is None:
                fresh.append(stretch)
                ids = self._ids(stretch)
            self.known[stretch] = ids
        # The library puts a word start before a text; a line feed keeps it away from stretches that begin without one.
        marked = [s for s in fresh if s[0] == SPACE]
        plain = [s for s in fresh if s[0] != SPACE]
        lead = len(self._ids(SPACE) + self._ids("\n"))
        for stretch, ids in zip(marked, self.library.encode([s[1:] if len(s) > 1 else " " for s in marked], num_threads=1), strict=True):
            if stretch == SPACE:
                continue  # the library gives no ids for an empty text; this one is the start itself
            self._compare(stretch, array("i", ids).tobytes())
        for stretch, ids in zip(plain, self.library.encode(["\n" + s for s in plain], num_threads=1), strict=True):
            self._compare(stretch, array("i", ids).tobytes()[lead:])

    def _compare(self, stretch: str, ids: bytes) -> None:
        if ids != self.known[stretch]:
            self.known[stretch] = ids
            self.disputed.add(stretch)

    def encode_batch(self, texts: list[str | None]) -> tuple[list[list[int]], list[bool]]:
        """Ids of texts, and whether agenda and library agree on all their stretches."""
        if len(self.known) > MEMORY:
            self.known, self.older = {}, self.known
        split = [self.split(text) for text in texts]
        self.learn({s for stretches in split for s in stretches if s not in self.known})
        known = self.known.__getitem__
        ids = [np.frombuffer(b"".join(map(known, stretches)), np.int32).tolist() for stretches in split]
        return ids, [self.disputed.isdisjoint(s) if self.disputed else True for s in split]

    def encode(self, text: str | None) -> list[int]:
        return self.encode_batch([text])[0][0]

    def decode(self, ids: list[int]) -> str:
        """Text of ids: byte pieces are gathered to UTF-8, control pieces are silent, the first word start goes."""
        of_byte = {i: b for b, i in self.bytes.items()}
        out = bytearray()
        for i in ids:
            if i in of_byte:
                out.append(of_byte[i])
            elif i not in self.silent:
                out += self.pieces[i].replace(SPACE, " ").encode()
        text = out.decode("utf-8", errors="replace")
        return text[1:] if text.startswith(" ") else text


_CODERS: dict[str, PieceCoder] = {}


def coder(path: str) -> PieceCoder:
    """One coder per worker process and file; workers serve many tasks."""
    if path not in _CODERS:
        _CODERS[path] = PieceCoder(path)
    return _CODERS[path]


def encode_rows(docs: DataFrame, model: str, text_col: str = "text", digest: bool = False) -> DataFrame:
    """``docs`` with ``ids``, ``decoded`` (the library's text of the ids) and ``agrees``.

    With ``digest``, text, ids and decoded text stay in the task and ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` replace
    them. ``model`` is the path of the vocabulary file on every machine.
    """
    importable(docs.sparkSession)
    made = ["ids", "decoded", "agrees", "n_tokens", "ids_sha256", "decoded_sha256"]
    kept = [c for c in docs.columns if c not in made and not (digest and c == text_col)]
    if digest:
        new = [StructField("n_tokens", IntegerType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())]
    else:
        new = [StructField("ids", ArrayType(IntegerType(), False)), StructField("decoded", StringType())]
    schema = StructType([docs.schema[c] for c in kept] + new + [StructField("agrees", BooleanType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        code = coder(model)
        for batch in batches:
            for begin in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(begin, ROWS_AT_ONCE)
                ids, agrees = code.encode_batch(part.column(text_col).to_pylist())
                decoded = code.library.decode(ids) if ids else []
                columns = [part.column(c) for c in kept]
                if digest:
                    columns += [
                        pa.array([len(x) for x in ids], pa.int32()),
                        pa.array([sha256(",".join([code.decimals[i] for i in x]).encode()).hexdigest() for x in ids], pa.string()),
                        pa.array([sha256(x.encode()).hexdigest() for x in decoded], pa.string()),
                    ]
                else:
                    columns += [pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())]
                columns.append(pa.array(agrees, pa.bool_()))
                yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

    read = docs.select(*kept, text_col) if text_col not in kept else docs.select(*kept)
    return read.mapInArrow(work, schema)


def encode_texts(docs: DataFrame, model: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``ids``, ``decoded`` and ``agrees``."""
    return encode_rows(docs, model, text_col)


def encode_digests(docs: DataFrame, model: str, text_col: str = "text") -> DataFrame:
    """``docs`` without the text, with ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and ``agrees``."""
    return encode_rows(docs, model, text_col, digest=True).withColumn("n_tokens", F.col("n_tokens").cast("long"))
