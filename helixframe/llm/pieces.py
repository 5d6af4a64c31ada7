"""Encoding and decoding with sentencepiece through a table of distinct chunks.

In a vocabulary whose pieces hold the white-space mark U+2581 only in front (or
throughout), no piece reaches over a place with another character on its left
and the mark on its right, and none reaches over a line feed, which is in no
longer piece.  A text is thus a row of marked words, each encoded independently of
its neighbours; ``Chunks`` checks this of the model it loads, and where it does
not hold the whole text is one chunk.

Texts are gathered in blocks.  A block asks for its distinct chunks, which are
dealt over buckets by their hash; a bucket segments every distinct chunk it is
asked for once and answers each block; the answers meet the block's texts, and
ids are joined back by position.  So a word's occurrences are never shuffled, only
the distinct words of a block, and a hot word is asked for once a block.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import size_in_partitions, whole_text
from .token_counts import MARK, model_file

#: Characters of the texts of a block, and of one row that carries texts of a block.
BLOCK_CHARS, CARRIED_CHARS = 32_000_000, 1_000_000
#: Distinct chunks that a bucket remembers; it starts anew beyond them, and segments again what comes again.
MOST_CHUNKS = 2_000_000
GUARD = "\n"
ZSTD_LEVEL = 6
_LOADED: dict[str, Chunks] = {}


class Chunks:
    """A sentencepiece model, and its texts cut where no piece reaches over."""

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        plain = self.sp.normalize("ﬁ a  b\t") == f"{MARK}ﬁ{MARK}a{MARK}{MARK}b\t"
        self.cuts = plain and all(set(p) == {MARK} for p in pieces if MARK in p[1:]) and not any(GUARD in p for p in pieces if len(p) > 1)
        self.lead = len(self.sp.encode(GUARD))
        self.find = re.compile(f"(?:{MARK}+|{GUARD})[^{MARK}{GUARD}]*").findall
        self.end = self.sp.eos_id()

    def split(self, text: str) -> list[str]:
        """The chunks of a text; together they are the text as the model sees it, with the mark in front."""
        if not text:
            return []
        return self.find(MARK + text.replace(" ", MARK)) if self.cuts else [text]

    def segment(self, chunks: list[str]) -> tuple[list[list[int]], list[str | None]]:
        """The ids of every chunk, and its decoded text where that is not the chunk with spaces for marks."""
        if not self.cuts:
            ids = self.sp.encode(chunks, num_threads=1)
            return ids, [None if (x := self.sp.decode(i)) == c else x for c, i in zip(chunks, ids)]
        guard = self.sp.encode(GUARD)
        ids = [x[self.lead :] for x in self.sp.encode([GUARD + c.replace(MARK, " ") for c in chunks], num_threads=1)]
        texts = [x[len(GUARD) :] for x in self.sp.decode([guard + i for i in ids], num_threads=1)]
        return ids, [None if x == c.replace(MARK, " ") else x for c, x in zip(chunks, texts)]

    def joined(self, chunks: list[str], texts: dict[str, str | None]) -> str:
        """The decoded text of a row of chunks; ``texts`` holds those that are not the chunk itself."""
        whole = "".join([texts.get(c, c) for c in chunks]) if texts else "".join(chunks)
        return whole.replace(MARK, " ")[1:] if self.cuts else whole


def chunks_of(model: str) -> Chunks:
    if model not in _LOADED:
        _LOADED[model] = Chunks(model_file(model))
    return _LOADED[model]


def _packed(**columns: pa.Array) -> bytes:
    batch, sink = pa.RecordBatch.from_pydict(columns), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", ZSTD_LEVEL))) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(data).read_next_batch()


def _blocks(batches: Iterator[pa.RecordBatch], chars: int) -> Iterator[tuple[int, pa.Table]]:
    """(number, rows) of blocks; the numbers are those of the partition and of the block in it."""
    first, k, held, size = TaskContext.get().partitionId() << 32, 0, [], 0
    for batch in batches:
        start = 0
        for row, n in enumerate(pc.utf8_length(batch.column("text")).to_pylist()):
            size += n
            if size >= chars:
                yield first + k, pa.Table.from_batches([*held, batch.slice(start, row + 1 - start)])
                start, k, held, size = row + 1, k + 1, [], 0
        if start < batch.num_rows:
            held.append(batch.slice(start))
    if held:
        yield first + k, pa.Table.from_batches(held)


_ROW = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("part", pa.int32()), ("data", pa.binary())])
_SQL_ROW = "block long, bucket int, part int, data binary"


def _row(block: int, bucket: int, part: int, data: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{"block": block, "bucket": bucket, "part": part, "data": data}], _ROW)


def encoded(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = "piece_bpe_32k.model", with_ids: bool = False, block_chars: int = BLOCK_CHARS, most_chunks: int = MOST_CHUNKS
) -> DataFrame:
    """One row per input row: doc_id, n_tokens, n_chunks, n_late, ids_sha256, decoded_sha256 (and ids, decoded).

    The ids are those of the library for the whole text, with an end id only; the
    decoded text is what the library's decode gives for them.  A null text is the
    empty one: an end id, decoded to the empty text.  Rows with equal or null
    identifiers each give a row, other columns are not read, an empty table gives an
    empty result.  A very long text is a block by itself; a text without a place to
    cut is one chunk.  Should a block be cut in another way when its texts are
    read for the second time, the chunks without an answer are segmented there and
    counted in ``n_late``.
    """
    kind = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))
    n_buckets = size_in_partitions(docs)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = chunks_of(model).split
        for block, table in _blocks(batches, block_chars):
            want: list[list[str]] = [[] for _ in range(n_buckets)]
            for chunk in sorted({c for text in table.column("text").to_pylist() for c in split(text)}):
                want[zlib.crc32(chunk.encode()) % n_buckets].append(chunk)
            for bucket, some in enumerate(want):
                if some:
                    yield _row(block, bucket, 0, _packed(chunk=pa.array(some, pa.string())))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, of, known = chunks_of(model), None, {}
        for batch in batches:
            for block, bucket, data in zip(*(batch.column(c).to_pylist() for c in ("block", "bucket", "data"))):
                chunks = _unpacked(data).column("chunk").to_pylist()
                if bucket != of or len(known) > most_chunks:
                    of, known = bucket, {}
                new = [c for c in chunks if c not in known]
                known.update(zip(new, zip(*tool.segment(new))))
                got = [known[c] for c in chunks]
                yield _row(block, bucket, -1, _packed(chunk=pa.array(chunks, pa.string()), ids=pa.array([x[0] for x in got], pa.list_(pa.int32())), text=pa.array([x[1] for x in got], pa.string())))

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = 0
        for block, table in _blocks(batches, block_chars):
            held, size = 0, 0
            for row, n in enumerate(pc.utf8_length(table.column("text")).to_pylist()):
                size += n
                if size >= CARRIED_CHARS or row + 1 == table.num_rows:
                    some = table.slice(held, row + 1 - held)
                    yield _row(block, -1, part, _packed(doc_id=some.column("doc_id").combine_chunks(), text=some.column("text").combine_chunks()))
                    held, size, part = row + 1, 0, part + 1

    columns = {"doc_id": None, "n_tokens": pa.int64(), "n_chunks": pa.int64(), "n_late": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
    schema = f"doc_id {kind.simpleString()}, n_tokens long, n_chunks long, n_late long, ids_sha256 string, decoded_sha256 string"
    if with_ids:
        columns, schema = {**columns, "ids": pa.list_(pa.int32()), "decoded": pa.string()}, schema + ", ids array<int>, decoded string"

    def join(answers: pa.Table, texts_of: pa.Table) -> pa.Table:
        tool, names, other, lists = chunks_of(model), {}, {}, {}

        def learn(chunks: list[str], ids: pa.ListArray, decoded: list[str | None]) -> None:
            said = pc.binary_join(pa.ListArray.from_arrays(ids.offsets, ids.values.cast(pa.string())), " ")
            names.update(zip(chunks, said.to_pylist()))
            other.update((c, t) for c, t in zip(chunks, decoded) if t is not None)
            if with_ids:
                lists.update(zip(chunks, ids.to_pylist()))

        for data in answers.column("data").to_pylist():
            found = _unpacked(data)
            learn(found.column("chunk").to_pylist(), found.column("ids"), found.column("text").to_pylist())
        done = []
        for data in texts_of.column("data").to_pylist():
            rows, out = _unpacked(data), []
            for text in rows.column("text").to_pylist():
                chunks, late = tool.split(text), []
                try:
                    said = " ".join([names[c] for c in chunks])
                except KeyError:
                    late = sorted({c for c in chunks if c not in names})
                    ids, decoded = tool.segment(late)
                    learn(late, pa.array(ids, pa.list_(pa.int32())), decoded)
                    said = " ".join([names[c] for c in chunks])
                said = f"{said} {tool.end}" if chunks else str(tool.end)  # a chunk has an id at least
                decoded = tool.joined(chunks, other)
                values = (said.count(" ") + 1, len(chunks), len(late), hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
                out.append((*values, [i for c in chunks for i in lists[c]] + [tool.end], decoded) if with_ids else values)
            made = [pa.array(x, t) for x, t in zip(zip(*out), list(columns.values())[1:])]
            done.append(pa.Table.from_arrays([rows.column("doc_id"), *made], list(columns)))
        return pa.concat_tables(done)

    # asking and carrying are stages of their own over the same partitions, so that both number blocks alike
    asked = rows.mapInArrow(ask, _SQL_ROW)
    answered = asked.repartition(n_buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(answer, _SQL_ROW)
    return answered.groupBy("block").cogroup(rows.mapInArrow(carry, _SQL_ROW).groupBy("block")).applyInArrow(join, schema)
