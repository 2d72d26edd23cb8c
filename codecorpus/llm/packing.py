"""Packing documents into fixed-length token sequences, bounded-space online.

Every partition keeps a fixed number of open windows.  Whole windows of a long
document are emitted as they are; the rest of a document goes to the open
window that it fits best.  If none fits, a new window opens, and beyond the
fixed number the fullest is topped up with the head of the piece and emitted.
At the end of a partition its open windows are handed, with their ids, to a
merge task for ``MERGE_PARTITIONS`` partitions, which lays them end to end and
cuts full sequences; only the last sequence of a merge task needs padding.

Sequence ids follow the partitions: ``partition << 33`` and a number in order of
emission; a merged sequence stands behind those of the first partition that it
has pieces of.  So documents whose partitions are ranges of an order
(``in_file_order``) are in that order up to the windows open in a partition.

A task holds the open windows and one Arrow batch; the hand-over is at most
``OPEN_WINDOWS`` windows a partition.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codecorpus.llm.common import cut, hold

SEQUENCE = 4096
OPEN_WINDOWS = 8
MERGE_PARTITIONS = 32
#: Added to the numbers of merged sequences, so that they follow the emitted ones of their partition.
MERGED = 1 << 32
#: Ends every document.
END_ID = 2
#: Bytes of the words whose ids a Python worker keeps, with what an entry adds.
CACHE_BYTES, ENTRY_BYTES = 112 << 20, 160
#: Texts whose new words are learned together.
TOGETHER = 1024
#: Words that the tokenizer gets at a time: what it returns takes many times their bytes.
ENCODED = 4096
_MARKS = b".,;:!?|#$%&*-"

#: Letters, then perhaps marks: the tokenizer sees one or two pieces, each ending in a word-end id.
_PLAIN = regex.compile(r"[\p{Ll}A-Z]+([.,;:!?|#$%&*-]+)?")


class Words:
    """Token ids of texts by way of a bounded cache from words to ids.

    The tokenizer splits at white space and gives every other run of
    characters ids of its own, so a text's ids are those of its words in turn.
    Texts and cached words are UTF-8, which ``bytes.split`` cuts at the same
    (ASCII) white space.
    New words are encoded together; words of letters are told apart in the
    result by their word-end ids, all others are encoded alone.

    The cache has two halves: when the newer one is full it takes the place of
    the older one, and words of the older one that are met again move over, so
    that frequent words are never forgotten.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        self.cache: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.size = 0

    def learn(self, words: list[bytes]) -> None:
        plain, counts, odd = [], [], []
        for word in words:
            if word.isalpha():  # ASCII letters
                count = 1
            elif word.rstrip(_MARKS).isalpha():
                count = 2
            else:
                m = None if word.isascii() else _PLAIN.fullmatch(word.decode())
                count = 1 + (m.start(1) >= 0) if m else 0
            if count:
                plain.append(word)
                counts.append(count)
            else:
                odd.append(word)
        if plain:
            ids = np.array(self._encode([b" ".join(plain)])[0].ids, dtype="<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == sum(counts):
                raw, at = ids.tobytes(), 0
                for word, end in zip(plain, ends[np.cumsum(counts) - 1].tolist()):
                    self.cache[word] = raw[4 * at:4 * end]
                    at = end
            else:
                odd += plain
        if odd:
            for word, e in zip(odd, self._encode(odd)):
                self.cache[word] = np.array(e.ids, dtype="<u4").tobytes()
    def _encode(self, words: list[bytes]):
        return self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)

    def forget(self) -> None:
        self.cache, self.older, self.size = {}, {}, 0
        _words.cache_clear()  # the tokenizer goes too and is read anew when it is next asked for

    def ids(self, texts: list[bytes | None]) -> Iterator[bytes]:
        """Little-endian 32-bit ids of each text (null: none)."""
        for at in range(0, len(texts), TOGETHER):
            hold(self)
            split = [t.split() if t else [] for t in texts[at:at + TOGETHER]]
            if 2 * self.size > CACHE_BYTES:
                self.cache, self.older, self.size = {}, self.cache, 0
            new = set().union(*split).difference(self.cache)
            self.size += sum(map(len, new)) + ENTRY_BYTES * len(new)
            met = self.older.keys() & new
            self.cache.update((w, self.older[w]) for w in met)
            new -= met
            learned = list(new)
            for i in range(0, len(learned), ENCODED):
                self.learn(learned[i:i + ENCODED])
            for words in split:
                yield b"".join(map(self.cache.__getitem__, words))


@lru_cache(maxsize=2)
def _words(path: str | None) -> Words:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return Words(path)


class Packer:
    """Open windows of one partition; ``done`` collects the emitted windows."""

    def __init__(self, sequence: int, open_windows: int):
        self.sequence, self.limit = sequence, open_windows
        self.open: list[list] = []  # [used, [(document, start, ids), ...]]
        self.done: list[list] = []

    def add(self, document, ids: bytes) -> None:
        size, start, n = self.sequence, 0, len(ids) // 4
        while n - start >= size:
            self.done.append([size, [(document, start, ids[4 * start:4 * (start + size)])]])
            start += size
        while start < n:
            need = n - start
            fits = [w for w in self.open if size - w[0] >= need]
            if fits:
                window = max(fits, key=lambda w: w[0])
            elif len(self.open) < self.limit:
                window = [0, []]
                self.open.append(window)
            else:
                window = max(self.open, key=lambda w: w[0])
            take = min(need, size - window[0])
            window[1].append((document, start, ids[4 * start:4 * (start + take)]))
            window[0] += take
            start += take
            if window[0] == size:
                self.open.remove(window)
                self.done.append(window)


PIECE = [("doc_id", "long"), ("text_hash", "long"), ("start", "long"), ("length", "long"), ("ids_crc32", "long"),
         ("doc_tokens", "long"), ("sequence_id", "long"), ("offset", "long"), ("part", "int"), ("ids", "binary")]
DDL = ", ".join(f"`{n}` {t}" for n, t in PIECE)
SCHEMA = pa.schema([(n, {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[t]) for n, t in PIECE])


def _rows(windows: list, first_id: int, part: int | None) -> list[dict]:
    """Piece rows of ``windows``; with the ids if they go to a merge task (``part``)."""
    out = []
    for number, (_, pieces) in enumerate(windows):
        offset = 0
        for (doc_id, text_hash, tokens), start, ids in pieces:
            n = len(ids) // 4
            out.append({"doc_id": doc_id, "text_hash": text_hash, "start": start, "length": n, "ids_crc32": zlib.crc32(ids),
                        "doc_tokens": tokens, "sequence_id": first_id + number, "offset": offset, "part": part,
                        "ids": None if part is None else ids})
            offset += n
    return out


def _packed(path: str | None, sequence: int, open_windows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        words, packer, emitted = _words(path), Packer(sequence, open_windows), part << 33
        end = struct.pack("<I", END_ID)
        for batch in batches:
            ids, hashes = (batch.column(i).to_pylist() for i in range(2))
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            for doc_id, text_hash, raw in zip(ids, hashes, words.ids(texts)):
                raw += end
                packer.add((doc_id, text_hash, len(raw) // 4), raw)
            if packer.done:
                yield pa.RecordBatch.from_pylist(_rows(packer.done, emitted, None), SCHEMA)
                emitted += len(packer.done)
                packer.done.clear()
        if packer.open:
            yield pa.RecordBatch.from_pylist(_rows(packer.open, emitted, part), SCHEMA)
    return run


def _merged(sequence: int):
    def run(table: pa.Table) -> pa.Table:
        rows = table.sort_by([("sequence_id", "ascending"), ("offset", "ascending")]).to_pylist()
        packer = Packer(sequence, 1)
        for r in rows:
            # One open window takes the pieces in turn, so sequences fill without gaps.
            packer.add((r["doc_id"], r["text_hash"], r["doc_tokens"], r["start"], r["sequence_id"] >> 33), r["ids"])
        out = []
        for number, (_, pieces) in enumerate(packer.done + packer.open):
            offset = 0
            first = pieces[0][0][-1]
            for (doc_id, text_hash, tokens, base, _), start, ids in pieces:
                n = len(ids) // 4
                out.append({"doc_id": doc_id, "text_hash": text_hash, "start": base + start, "length": n,
                            "ids_crc32": zlib.crc32(ids), "doc_tokens": tokens,
                            "sequence_id": (first << 33) + MERGED + number, "offset": offset,
                            "part": None, "ids": None})
                offset += n
        return pa.Table.from_pylist(out, SCHEMA)
    return run


def in_file_order(docs: DataFrame) -> DataFrame:
    """``docs``, read from Parquet that Spark wrote in order, in that order again:
    range-sorted by part number and row position (a scan bins files by size).
    Rows that come from no file keep the order they have."""
    try:
        placed = docs.select(F.struct(*docs.columns).alias("_doc"), F.col("_metadata.file_path").alias("_file"),
                             F.col("_metadata.row_index").alias("_at"))
    except AnalysisException as e:
        if (e.getCondition() or "").startswith("UNRESOLVED_COLUMN"):
            return docs  # rows that come from no file have no such columns
        raise
    number = F.regexp_extract("_file", r"part-(\d+)[^/]*$", 1).try_cast("long")
    return placed.orderBy(number, "_file", "_at").select("_doc.*")


def pack(docs: DataFrame, sequence: int = SEQUENCE, open_windows: int = OPEN_WINDOWS,
         merge_partitions: int = MERGE_PARTITIONS, tokenizer_path: str | None = None) -> DataFrame:
    """One row per piece: ``doc_id, text_hash, start, length, ids_crc32,
    doc_tokens, sequence_id, offset``.

    A document's ids are its text's (null: none) and the end id; every id lies
    in exactly one piece.  Pieces of a sequence are gapless from offset 0.
    Sequences by id are in the order of the partitions of ``docs``.  Rows with
    equal ids are separate documents.  An empty table gives no pieces.  ``tokenizer_path``: a tokenizer file whose tokens end words in
    ``</w>``; unset, the public word-level BPE.
    """
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    packed = cut(rows.mapInArrow(_packed(tokenizer_path, sequence, open_windows), DDL))
    left = packed.where("part IS NOT NULL")
    merged = left.groupBy(F.expr(f"part div {merge_partitions}").alias("merge")).applyInArrow(_merged(sequence), DDL)
    return packed.where("part IS NULL").unionByName(merged).drop("part", "ids")
