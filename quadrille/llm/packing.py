"""Packing by concatenate and cut: two passes of prefix sums, then fixed windows with boundary records.

Pass one tokenizes each partition in order and writes every document's ids with its offset inside the partition.
The partitions' token totals, one number each, give the partitions' global offsets. Pass two adds them and cuts
the global stream every ``length`` tokens; a document that crosses a boundary gives one piece a window. No text
or ids are shuffled, and every window but the last is full, so padding is under ``length`` tokens in all.

Ids come from the tokenizer on each distinct word, with a bounded cache of words. Its pre-tokenizer works on one
word at a time, so this gives the ids of the whole text.

Defined results: null text counts as empty, whose only id is the closing one; repeated rows are packed each; an
empty table gives no pieces; extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..stored import written
from ._shared import Ragged, Words, documents, small_batches

#: Chunks and words whose ids a Python worker keeps; a full cache is emptied.
CACHE = 500_000
#: Texts of these characters alone are lower-cased and cut into words here: none of them composes with another,
#: lower-cases by context or into several, or is of another class to one library than to the other.
PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-\u012f\u0131-\u017f]*")
#: The words of a lower-cased text, as the tokenizer's pre-tokenizer finds them, and line feeds.
WORD = re.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")


class WordTokenizer:
    """Ids of whole texts from the ids of their chunks, which blanks delimit, and of the chunks' words.

    Each distinct chunk of a batch is looked up once and each distinct word is tokenized once. Chunks with
    characters outside ``PLAIN`` go to the tokenizer as they are.
    """

    def __init__(self, path: str, cache: int = CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), cache
        # the same model for words that are cut and lower-cased already
        plan = json.loads(self.tokenizer.to_str())
        plan |= {"normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, plan["pre_tokenizer"]["pretokenizers"][-1]]}}
        self.model = Tokenizer.from_str(json.dumps(plan))
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for word, i in vocabulary.items() if word.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.words, self.chunks = Ragged(), Ragged()
        self.words.add(["\n"], np.zeros(0, np.uint32), np.zeros(1, np.int64))

    def _learn(self, new: list[bytes]) -> None:
        """Adds the ids of chunks: of plain ones by their words, a word at a time; of others as they are."""
        text = b"\n".join(new).decode("utf-8", "surrogatepass")
        if PLAIN.fullmatch(text) is None or "<|" in text:
            texts = [(c, c.decode("utf-8", "surrogatepass")) for c in new]
            odd = [(c, t) for c, t in texts if PLAIN.fullmatch(t) is None or "<|" in t]
            each = [x.ids for x in self.tokenizer.encode_batch_fast([t for _, t in odd], add_special_tokens=False)]
            self.chunks.add([c for c, _ in odd], np.array([i for x in each for i in x], dtype=np.uint32), np.array([len(x) for x in each], np.int64))
            new = [c for c in new if c not in self.chunks.code]
            text = b"\n".join(new).decode()
        if not new:
            return
        words = WORD.findall(text.lower())  # chunks hold no line feed, so one stands between two chunks
        if learn := list(set(words) - self.words.code.keys()):
            # words are tokenized in one go, as each ends with an id that closes a word
            ids = np.array(self.model.encode_batch_fast([" ".join(learn)], add_special_tokens=False)[0].ids, dtype=np.uint32)
            sizes = np.diff(np.flatnonzero(self.closes[ids]) + 1, prepend=0)
            if len(sizes) != len(learn):
                raise ValueError("this tokenizer's words do not end with closing ids")
            self.words.add(learn, ids, sizes)
        codes = self.words.codes(words)
        chunk = np.cumsum(codes == 0)
        self.chunks.add(new, self.words.take(codes), np.bincount(chunk, weights=self.words.size[codes], minlength=len(new)).astype(np.int64))

    def encode(self, texts: pa.Array, last: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids as one array, each text's followed by ``last``; and the number of ids of each text."""
        if len(self.chunks.size) + len(self.words.size) > self.most:
            self.clear()
        found = Words(texts)
        distinct = found.listed()
        if new := [c for c in distinct if c not in self.chunks.code]:
            self._learn(new)
        codes = self.chunks.codes(distinct)[found.codes]
        count = np.bincount(found.doc, weights=self.chunks.size[codes], minlength=len(texts)).astype(np.int64) + 1
        out = np.full(int(count.sum()), last, dtype=np.uint32)
        keep = np.ones(len(out), dtype=bool)
        keep[np.cumsum(count) - 1] = False
        out[keep] = self.chunks.take(codes)
        return out, count


@lru_cache(maxsize=1)
def worker_tokenizer(path: str) -> WordTokenizer:
    """One tokenizer a Python worker, whose cache stays warm from task to task."""
    return WordTokenizer(path)


def tokenized(docs: DataFrame, path: str, last: int) -> DataFrame:
    """part, local (offset inside the partition), doc_id, tokens, ids (little-endian uint16 or uint32)."""
    schema = "part int, local long, doc_id long, tokens long, wide boolean, ids binary"

    def run(batches):
        tokenizer, part, local = worker_tokenizer(path), TaskContext.get().partitionId(), 0
        for batch in small_batches(batches, limit=4 << 20):
            ids, count = tokenizer.encode(batch.column("text"), last)
            ends = np.cumsum(count)
            wide = bool(ids.max() >= 1 << 16)
            data = ids.astype("<u4" if wide else "<u2").tobytes()
            width = 4 if wide else 2
            offsets = np.concatenate([[0], ends * width]).astype(np.int64)
            blobs = pa.Array.from_buffers(pa.large_binary(), len(count), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
            n = len(count)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, part, np.int32)), pa.array(local + ends - count), batch.column("doc_id"), pa.array(count), pa.array(np.full(n, wide)), blobs.cast(pa.binary())],
                names=["part", "local", "doc_id", "tokens", "wide", "ids"],
            )
            local += int(ends[-1])

    return documents(docs).select("doc_id", "text").mapInArrow(run, schema)


def pack(docs: DataFrame, path: str, length: int = 4096, last: int = 2, with_ids: bool = True) -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, ``with_ids``, ids (uint32)."""
    table = written(tokenized(docs, path, last), "tokens")
    totals = table.groupBy("part").agg(F.max(F.col("local") + F.col("tokens")).alias("total"))
    # one row a partition of the input: its size is bounded by their number, not by the rows
    bases = totals.select(F.col("part").alias("p"), (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("base"))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    schema += ", ids binary" * with_ids

    def run(batches):
        for batch in small_batches(batches, "ids"):
            out: list[list] = [[] for _ in range(7 + with_ids)]
            for doc, first, tokens, wide, data in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "first", "tokens", "wide", "ids")), strict=True):
                ids = np.frombuffer(data, dtype="<u4" if wide else "<u2").astype("<u4")
                start = 0
                while start < tokens:
                    sequence, offset = divmod(first + start, length)
                    piece = ids[start : start + length - offset]
                    raw = piece.tobytes()
                    for column, value in zip(out, (doc, start, len(piece), zlib.crc32(raw), tokens, sequence, offset, raw), strict=False):
                        column.append(value)
                    start += len(piece)
            kinds = [pa.int64()] * 7 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(out, kinds, strict=False)], names=[x.split()[0] for x in schema.split(", ")])

    placed = table.join(F.broadcast(bases), table.part == bases.p).select("doc_id", (F.col("base") + F.col("local")).alias("first"), "tokens", "wide", "ids")
    return placed.mapInArrow(run, schema)


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op1_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer(), with_ids=False)
