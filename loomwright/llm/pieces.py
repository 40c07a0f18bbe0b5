"""SentencePiece encoding and decoding through a table of distinct chunks.

In a vocabulary where no piece holds a whitespace marker after another character, no merge crosses
the start of a run of markers, so a text falls into chunks (markers, then the word) that are
segmented one by one. Line breaks end chunks too where no piece holds one. Each task keeps a table
of the chunks it has met: a chunk is segmented and decoded by the library once, and ids are put back
by position. Nothing is shuffled: a corpus-wide table would send every position of every text over
the network twice, while the table of a task costs a dictionary lookup a position.

Chunks over LONG characters skip the table, and a table that has grown to half its bound starts
afresh beside the one before it, from which chunks in use move over; so memory is bounded whatever
the texts hold. A vocabulary that breaks the condition is encoded text by text.

Defined cases: a null text counts as empty and encodes to the end id alone. Repeated rows are
encoded one by one. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame

from .common import read_table

MARK = "▁"
#: Entries of a task's table, and characters of a chunk that it may hold.
TABLE_ENTRIES, LONG = 200_000, 48
#: Texts are handled in runs of about so many characters.
RUN_CHARS = 1_000_000


class Segmenter:
    """Chunk table over one model. `encode` and `decode` equal the library's on whole texts."""

    def __init__(self, model: str) -> None:
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        probe, mark = sp.encode("\n"), sp.piece_to_id(MARK)
        self.end, self.mark = sp.eos_id(), [mark]
        self.by_chunk = not any(MARK in p.lstrip(MARK) for p in pieces) and sp.decode(sp.encode("  a \n b ")) == "  a \n b "
        lines = not any("\n" in p for p in pieces) and len(probe) == 2 and probe[0] == mark
        stop = MARK + "\n" if lines else MARK
        self.split = re.compile(f"{MARK}+[^{stop}]*" + (f"|\n[^{stop}]*" if lines else "") + f"|[^{stop}]+").findall
        self.table: dict[str, tuple[str, int, str]] = {}
        self.older: dict[str, tuple[str, int, str]] = {}

    def _segment(self, chunks: list[str]) -> list[list[int]]:
        """Ids of chunks; the library adds one marker in front, which stands for a chunk's first."""
        ids = self.sp.encode([c[1:] if c[0] == MARK else c for c in chunks], num_threads=1)
        return [(i or self.mark) if c[0] == MARK else i[1:] for c, i in zip(chunks, ids, strict=True)]

    def _decoded(self, chunks: list[str], ids: list[list[int]]) -> list[str]:
        """The library drops a leading marker's space of what it decodes; it is put back."""
        return [" " + t if c[0] == MARK else t for c, t in zip(chunks, self.sp.decode(ids), strict=True)]

    def _entries(self, chunks: list[str]) -> list[tuple[str, int, str]]:
        ids = self._segment(chunks)
        return [(" ".join(map(str, i)), len(i), t) for i, t in zip(ids, self._decoded(chunks, ids), strict=True)]

    def look_up(self, texts: list[str]) -> Iterator[list[tuple[str, int, str]]]:
        """For each text its chunks' (ids joined by a space, number of ids, decoded text)."""
        split = [self.split(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        here = set().union(*split)
        if len(self.table) > TABLE_ENTRIES // 2:
            self.table, self.older = {}, self.table
        table, older = self.table, self.older
        new = here.difference(table)
        table.update({c: older[c] for c in new & older.keys()})
        new = [c for c in new.difference(table) if len(c) <= LONG]
        if new:
            table.update(zip(new, self._entries(new), strict=True))
        for chunks in split:
            try:
                yield [table[c] for c in chunks]
            except KeyError:
                yield [table[c] if len(c) <= LONG else self._entries([c])[0] for c in chunks]

    def encode_decode(self, texts: list[str]) -> Iterator[tuple[str, int, str]]:
        """(ids joined by a space with the end id, their number, decoded text) of each text."""
        if not self.by_chunk:
            for t in texts:
                ids = [*self.sp.encode(t), self.end]
                yield " ".join(map(str, ids)), len(ids), self.sp.decode(ids)
            return
        end = str(self.end)
        for found in self.look_up(texts):
            if found:
                ids, counts, decoded = zip(*found, strict=True)
                yield " ".join(ids) + " " + end, sum(counts) + 1, "".join(decoded)[1:]
            else:
                yield end, 1, ""


@lru_cache(maxsize=1)
def segmenter(model: str) -> Segmenter:
    return Segmenter(model)


def _runs(texts) -> Iterator[list[str]]:
    run, held = [], 0
    for t in texts:
        t = t.as_py() or ""
        run.append(t)
        held += len(t)
        if held >= RUN_CHARS:
            yield run
            run, held = [], 0
    if run:
        yield run


def encode(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, ids array<int> (end id last), n_tokens for docs(doc_id, text)."""
    return digests(docs, model, with_ids=True).select("doc_id", "ids", "n_tokens")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id, text for encoded(doc_id, ids), by the library's decode."""
    schema = f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string"

    def run(batches):
        import pyarrow as pa

        s = segmenter(model)
        for b in batches:
            texts = [s.sp.decode(x.as_py() or []) for x in b.column("ids")]
            yield pa.record_batch([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, schema)


def digests(docs: DataFrame, model: str, *, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encoding and decoding in one pass.

    Without with_ids, ids and decoded texts stay in the task and a document costs a narrow row.
    """
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def run(batches):
        import numpy as np
        import pyarrow as pa

        s, sha = segmenter(model), lambda x: hashlib.sha256(x.encode()).hexdigest()
        for b in batches:
            at = 0
            for part in _runs(b.column("text")):
                n, ids, texts, flat = [], [], [], []
                for i, k, t in s.encode_decode(part):
                    n.append(k)
                    ids.append(sha(i))
                    texts.append(sha(t))
                    if with_ids:
                        flat.append(np.array(i.split(" "), dtype=np.int32))
                columns = {"doc_id": b.column("doc_id").slice(at, len(part)), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids, pa.string()), "decoded_sha256": pa.array(texts, pa.string())}
                at += len(part)
                if with_ids:
                    offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                    columns["ids"] = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(flat)))
                yield pa.record_batch(list(columns.values()), list(columns))

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op4_sentencepiece(spark, sf_dir: str, model: str | None = None) -> DataFrame:
    return digests(read_table(spark, sf_dir, "documents"), model or default_model())
