"""SentencePiece encoding and decoding through a table of distinct marked words.

Where no vocabulary piece has a white-space marker after another character, no piece can cross the
start of a marked word (markers, then the characters up to the next marker). So each Python worker keeps a
table of the distinct marked words it has met, segments each of them once with the library, and
joins the ids back by position. The table is emptied when it holds ``table_rows`` words: a bound on
memory that changes no result. Vocabularies whose pieces do cross markers are refused.

Defined results: null and empty texts give the begin and end ids alone and decode to an empty
string; repeated rows are encoded each; an empty table gives no rows; any other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.shared import texts_of, tokenizer_path

MARK = "▁"


class ChunkTable:
    """Distinct marked words -> (ids as little-endian bytes, decoded UTF-8)."""

    def __init__(self, model: str, table_rows: int):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces):
            raise ValueError("pieces of this vocabulary cross white-space markers")
        self.rows, self.ids, self.texts = table_rows, {}, {}
        self.marker = np.array([self.sp.piece_to_id(MARK)], "<u4").tobytes()
        self.begin = np.array([self.sp.bos_id()], "<u4").tobytes()
        self.end = np.array([self.sp.eos_id()], "<u4").tobytes()

    def _learn(self, chunks: set[str]) -> None:
        """chunks: marked words without their first marker, further markers as spaces."""
        new = list(chunks)
        encoded = self.sp.encode(new, num_threads=1)
        for chunk, ids, text in zip(new, encoded, self.sp.decode(encoded, num_threads=1), strict=True):
            self.ids[chunk] = array("I", ids).tobytes()
            self.texts[chunk] = text.encode()
        if "" in chunks:  # a lone marker: the library adds none to an empty text
            self.ids[""], self.texts[""] = self.marker, b""

    def chunks(self, text: str) -> list[str]:
        text = text.replace(MARK, " ")
        parts = text.split(" ")
        if "" not in parts:
            return parts
        out, run = [], ""  # a run of markers belongs to the word after it
        for p in parts[:-1]:
            if p:
                out.append(run + p)
                run = ""
            else:
                run += " "
        out.append(run + parts[-1])
        return out

    def encode(self, text: str) -> tuple[bytes, bytes]:
        """The ids with begin and end, and the decoded text."""
        if not text:
            return self.begin + self.end, b""
        chunks = self.chunks(text)
        new = set(chunks).difference(self.ids)
        if new:
            if len(self.ids) > self.rows:
                self.ids, self.texts = {}, {}
                new = set(chunks)
            self._learn(new)
        ids = b"".join([self.begin, *map(self.ids.__getitem__, chunks), self.end])
        return ids, b" ".join(map(self.texts.__getitem__, chunks))


@lru_cache(1)
def chunk_table(model: str, table_rows: int) -> ChunkTable:
    """One table for all tasks of a Python worker."""
    return ChunkTable(model, table_rows)


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, table_rows: int = 600_000, keep_ids: bool = True) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit, if ``keep_ids``), n_tokens, ids_sha256, decoded_sha256."""
    model = model or tokenizer_path("piece_bpe_32k.model")
    schema = "doc_id long, " + "ids binary, " * keep_ids + "n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = chunk_table(model, table_rows)
        for batch in batches:
            out = {"doc_id": batch.column(0), "ids": [], "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            for text in texts_of(batch.column(1)):
                ids, decoded = table.encode(text)
                if keep_ids:
                    out["ids"].append(ids)
                out["n_tokens"].append(len(ids) // 4)
                out["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(decoded).hexdigest())
            if not keep_ids:
                del out["ids"]
            yield pa.RecordBatch.from_pydict(out)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
