"""SentencePiece encoding and decoding by a table of distinct chunks, of which each worker keeps its own.

The model escapes spaces as a marker and no piece has a marker after another character, so merges
never cross from a character to a following marker: a text is cut there into marked words, each
distinct one is segmented once, and ids are joined back by position.  The same table holds each
chunk's decoded text, for decoding is by piece.  A worker keeps its table from task to task; it is
bounded, and when full its older half goes.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loom.llm.common import released, small_batches, table

MARK = "▁"
CHUNK = re.compile(f"{MARK}+[^{MARK}]*")
#: Chunks in a worker's table; longer chunks than LONG are not kept in it.
ENTRIES, LONG = 200_000, 64
#: Characters handled at a time.
PART = 1_000_000


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class ChunkTable:
    """Encodes and decodes texts exactly as the library does for a model of this kind; checks the kind."""

    def __init__(self, model: str) -> None:
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        probe = " a  b℃ \n"
        if any(MARK in p.lstrip(MARK) for p in pieces) or self.sp.decode(self.sp.encode(probe)) != probe:
            raise ValueError("pieces of this model cross markers, or it changes white space")
        self.alone = self.sp.piece_to_id(MARK)
        self.end = self.sp.eos_id()
        self.ids: dict[str, bytes] = {}  # 32-bit ids, so that a text's are one join
        self.decimal: dict[str, str] = {}
        self.decoded: dict[str, str] = {}

    def chunks(self, text: str | None) -> list[str]:
        return CHUNK.findall(MARK + text.replace(" ", MARK)) if text else []

    def learn(self, texts: Sequence[list[str]], want: Sequence[str]) -> None:
        """Segments the chunks that the table lacks, each once."""
        needed = {c for chunks in texts for c in chunks}
        if len(self.ids) > ENTRIES:
            for c in list(islice(self.ids, len(self.ids) // 2)):
                for x in (self.ids, self.decimal, self.decoded):
                    x.pop(c, None)
        new = [c for c in needed if c not in self.ids or ("ids_text" in want and c not in self.decimal) or ("decoded" in want and c not in self.decoded)]
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            found = self.sp.encode([c[1:].replace(MARK, " ") for c in part])  # the library puts the first marker back
            found = [[self.alone] if c == MARK else ids for c, ids in zip(part, found, strict=True)]
            self.ids.update((c, array("i", ids).tobytes()) for c, ids in zip(part, found, strict=True))
            if "ids_text" in want:
                self.decimal.update((c, " ".join(map(str, ids))) for c, ids in zip(part, found, strict=True))
            if "decoded" in want:
                self.decoded.update((c, " " + d) for c, d in zip(part, self.sp.decode(found), strict=True))

    def forget(self, texts: Sequence[list[str]]) -> None:
        for c in {c for chunks in texts for c in chunks if len(c) > LONG}:
            for x in (self.ids, self.decimal, self.decoded):
                x.pop(c, None)

    def of(self, texts: Sequence[str | None], want: Sequence[str]) -> list[list]:
        """Per text, for each wanted column: ids (as 32-bit bytes), ids_text, n_tokens, decoded."""
        out: list[list] = [[] for _ in want]
        end = array("i", [self.end]).tobytes()
        i = 0
        while i < len(texts):
            j, held = i, 0
            while j < len(texts) and (j == i or held + len(texts[j] or "") <= PART):
                held += len(texts[j] or "")
                j += 1
            cut = [self.chunks(t) for t in texts[i:j]]
            self.learn(cut, want)
            for k, name in enumerate(want):
                if name == "ids":
                    out[k] += [b"".join(map(self.ids.__getitem__, chunks)) + end for chunks in cut]
                elif name == "n_tokens":
                    out[k] += [sum(map(len, map(self.ids.__getitem__, chunks))) // 4 + 1 for chunks in cut]
                elif name == "ids_text":
                    out[k] += [" ".join([*map(self.decimal.__getitem__, chunks), str(self.end)]) for chunks in cut]
                else:
                    out[k] += ["".join(map(self.decoded.__getitem__, chunks))[1:] for chunks in cut]
            self.forget(cut)
            i = j
        return out


@lru_cache(maxsize=1)
def _kept(model: str) -> ChunkTable:
    """The worker's table."""
    return ChunkTable(model)


def _lists(ids: list[bytes]) -> pa.ListArray:
    ends = pa.array(np.cumsum([0, *(len(x) // 4 for x in ids)]), pa.int32())
    return pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(ids), np.int32)))


_KINDS = {"ids": ("array<int>", None), "ids_text": ("string", pa.string()), "n_tokens": ("long", pa.int64()), "decoded": ("string", pa.string())}


def _run(model: str | None, want: Sequence[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunked = _kept(model or default_model())
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = chunked.of(part.column(part.num_columns - 1).to_pylist(), want)
                arrays = [_lists(x) if w == "ids" else pa.array(x, _KINDS[w][1]) for w, x in zip(want, found, strict=True)]
                names = [f"c{i}" for i in range(part.num_columns - 1)] + list(want)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *arrays], names)

    return released(run)


def encoded(docs: DataFrame, want: Sequence[str] = ("ids",), model: str | None = None, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """docs' ``keep`` columns with, per row, the wanted of ids, ids_text, n_tokens and decoded.

    Ids end with the model's end id; null and empty texts have that one id and decode to an empty
    text.  decoded is what the library's decode(ids) returns.  Row by row: repeats, nulls in other
    columns, other columns and no rows are fine.  model None stands for the 32k model at the place
    where each worker has it.
    """
    fields = [f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)] + [f"{w} {_KINDS[w][0]}" for w in want]
    out = small_batches(docs).select(*keep, "text").mapInArrow(_run(model, tuple(want)), ", ".join(fields))
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], *want)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every document."""
    found = encoded(table(spark, sf_dir, "documents"), ("n_tokens", "ids_text", "decoded"))
    return found.select("doc_id", "n_tokens", F.sha2("ids_text", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
