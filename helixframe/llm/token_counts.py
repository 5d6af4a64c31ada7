"""Token counts by overlap resynchronisation.

A document longer than ``chunk_chars`` is encoded in overlapping chunks with
offsets.  Two neighbouring encodings are spliced at a token boundary that both
have and that is proven stable; where the overlap holds none, it is widened
(up to the whole left chunk), and failing that the chunk grows, so that the
result always equals the encoding of the whole text.

The proof of stability comes from the vocabulary: white space is the mark
U+2581 inside the model, and every piece holds that mark only in front or
throughout.  No piece then spans a position with another character on its left
and the mark on its right, no merge crosses it, and both sides are encoded
independently of each other.  ``Splicer`` checks this of the vocabulary it
loads and encodes documents whole if it does not hold.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_text

MARK = "▁"
#: Characters of a chunk, and of the first overlap tried.
CHUNK_CHARS, OVERLAP_CHARS = 32_768, 256
_LOADED: dict[str, Splicer] = {}


def model_file(name: str) -> str:
    """A path as it is, or the place of one of the public vocabulary files."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class Splicer:
    """A sentencepiece model, with an encoding of huge texts by chunks."""

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        identity = self.sp.normalize("ﬁ a  b\t") in (f"{MARK}ﬁ{MARK}a{MARK}{MARK}b\t", f"ﬁ{MARK}a{MARK}{MARK}b\t")
        self.stable = identity and all(set(p) == {MARK} for p in pieces if MARK in p[1:])

    def counts(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.sp.encode(texts, num_threads=1)]

    def offsets(self, text: str) -> tuple[list[int], list[int]]:
        """Token ids, and the character each token starts at."""
        found = self.sp.encode(text, return_type="offset_mapping")
        return found["ids"], [x[0] for x in found["offsets"]]

    def ids(self, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> tuple[list[int], int, int]:
        """The ids of a whole text, the number of chunks and how many overlaps were widened."""
        if len(text) <= chunk or not self.stable:
            return self.sp.encode(text), 1, 0
        out: list[int] = []
        chunks, widened = 1, 0
        at, end, since = 0, chunk, 0  # this chunk is text[at:end]; tokens from ``since`` on are still to be taken
        ids, starts = self.offsets(text[at:end])
        starts = [at + x for x in starts]
        while end < len(text):
            wide = min(overlap, end - at)
            while True:
                nxt, stop = end - wide, min(len(text), end - wide + max(chunk, 2 * wide))
                new_ids, new_starts = self.offsets(text[nxt:stop])
                new_starts = [nxt + x for x in new_starts]
                chunks += 1
                common = set(new_starts)
                cut = next((p for p in reversed(starts) if p in common and p > max(nxt, since) and self.is_stable(text, p)), None)
                if cut is not None or wide >= end - at:
                    break
                wide, widened = min(2 * wide, end - at), widened + 1
            if cut is None:  # no stable boundary in the whole chunk: let the chunk grow
                end, widened = min(len(text), at + 2 * (end - at)), widened + 1
                ids, starts = self.offsets(text[at:end])
                starts = [at + x for x in starts]
                chunks += 1
                continue
            out += [i for i, p in zip(ids, starts) if since <= p < cut]
            at, end, since, ids, starts = nxt, stop, cut, new_ids, new_starts
        out += [i for i, p in zip(ids, starts) if p >= since]
        return out, chunks, widened

    @staticmethod
    def is_stable(text: str, p: int) -> bool:
        return text[p] in (" ", MARK) and text[p - 1] not in (" ", MARK)


def splicer(model: str) -> Splicer:
    if model not in _LOADED:
        _LOADED[model] = Splicer(model_file(model))
    return _LOADED[model]


def token_counts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = "piece_bpe_32k.model",
    limit: int = 4096, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS, with_ids: bool = False,
) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_tokens, over_limit, n_chunks, n_widened (and ids).

    A null or empty text has no bytes and no tokens.  Rows with equal or null
    identifiers each give a row; other columns are not read; an empty table gives
    an empty result.  A very long text is encoded in chunks of ``chunk_chars`` characters;
    one that holds no stable boundary is encoded whole.
    """
    kind = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))
    schema = f"doc_id {kind.simpleString()}, n_bytes long, n_tokens long, n_chunks int, n_widened int" + ", ids array<int>" * with_ids

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = splicer(model)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            n: list[int] = [0] * len(texts)
            chunks, widened, ids = [1] * len(texts), [0] * len(texts), [[]] * len(texts)
            small = [k for k, x in enumerate(texts) if len(x) <= chunk_chars]
            for some in (small[i : i + 256] for i in range(0, len(small), 256)):
                for k, found in zip(some, tool.sp.encode([texts[k] for k in some], num_threads=1)):
                    n[k], ids[k] = len(found), found if with_ids else []
            for k, x in enumerate(texts):
                if len(x) > chunk_chars:
                    found, chunks[k], widened[k] = tool.ids(x, chunk_chars, overlap_chars)
                    n[k], ids[k] = len(found), found if with_ids else []
            out = [batch.column("doc_id"), pa.array([len(x.encode()) for x in texts], pa.int64()), pa.array(n, pa.int64()), pa.array(chunks, pa.int32()), pa.array(widened, pa.int32())]
            names = ["doc_id", "n_bytes", "n_tokens", "n_chunks", "n_widened"]
            if with_ids:
                out, names = [*out, pa.array(ids, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(out, names)

    found = rows.mapInArrow(encode, schema)
    return found.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
