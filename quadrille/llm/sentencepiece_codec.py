"""SentencePiece encoding and decoding by suffix-array matching.

A batch's distinct segments (blanks and the letters behind them, or other characters) that no cache has are
concatenated and indexed by a suffix array. Every piece of the vocabulary is searched in it by halving, all pieces at once, which
gives its range of occurrences; each occurrence is an edge (from, to, id). Edges sorted by position are the only
spans that a segment can be cut into, and relaxing them gives its ids:

* unigram models: the best-scoring path over the edges;
* BPE models (scores are whole numbers): the edge of the best score that joins two neighbouring spans is taken
  first, the leftmost of equals, until no edge joins neighbours.

Characters that no piece covers become byte pieces, or <unk> where the model has none. Decoding joins pieces,
turns byte runs into characters and takes off the dummy prefix. Models with identity normalisation, a dummy
prefix and pieces that hold blanks only in front are supported; others are refused with ValueError.

Defined results: null text counts as empty, which has no ids; repeated rows get a row each; an empty table gives
no rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import re
import zlib
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Ragged, Words, documents, small_batches

BLANK = "▁"
#: Segments and chunks whose ids a worker keeps; a full cache is emptied.
CACHE = 900_000
#: Segments up to this long are relaxed side by side; a batch of them has this many characters at most.
SHORT, TOGETHER = 40, 400_000
SPACE = np.arange(256) == 32
LETTER = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]"


def suffix_array(points: np.ndarray, depth: int) -> np.ndarray:
    """Start positions in the order of their suffixes' first ``depth`` values, by prefix doubling."""
    order = np.argsort(points)
    rank = np.zeros(len(points), np.int64)
    rank[order] = np.cumsum(np.concatenate([[0], points[order][1:] != points[order][:-1]]))
    k = 1
    while k < depth and len(points) > 1:
        second = np.zeros(len(points), np.int64)
        second[:-k] = rank[k:] + 1
        key = rank * (len(points) + 1) + second
        order = np.argsort(key)
        rank[order] = np.cumsum(np.concatenate([[0], key[order][1:] != key[order][:-1]]))
        k *= 2
        if rank[order[-1]] == len(points) - 1:
            break
    return order


class Vocabulary:
    """A model's pieces as code points, padded to the longest one."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.byte = {int(self.pieces[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        self.value = {i: b for b, i in self.byte.items()}
        self.control = {i for i in range(n) if model.is_control(i)}
        self.unknown = model.unk_id()
        self.score = np.array([model.get_score(i) for i in range(n)])
        self.ids = np.array(plain, np.int64)
        self.length = np.array([len(self.pieces[i]) for i in plain])
        self.longest = int(self.length.max())
        self.points = np.zeros((len(plain), self.longest), np.int64)
        for row, i in enumerate(plain):
            self.points[row, : self.length[row]] = [ord(c) for c in self.pieces[i]]
        if any(BLANK in self.pieces[i].lstrip(BLANK) for i in plain):
            raise ValueError("a piece has a blank inside")
        if any(model.decode(model.encode(x)) != x for x in (" x  ", "ﬁ ①\t\n", "E\u0301")):
            raise ValueError("the model's normalisation isn't the identity with a dummy prefix")
        # what each id decodes to, and whether it starts with the blank that is taken off a text's front
        self.raw = Ragged(np.uint8)
        texts = [b"" if i in self.control else bytes([self.value[i]]) if i in self.value else " ⁇ ".encode() if i == self.unknown else self.pieces[i].replace(BLANK, " ").encode() for i in range(n)]
        self.raw.add(list(range(n)), np.frombuffer(b"".join(texts), np.uint8), np.array([len(x) for x in texts], np.int64))
        self.dummy = np.array([x[:1] == BLANK for x in self.pieces])
        self.bpe = bool((self.score[self.ids] == np.rint(self.score[self.ids])).all())  # ranks; unigram scores are log likelihoods
        feed = "" if any("\n" in self.pieces[i] for i in plain) else "\n"  # a cut at a line feed splits no piece
        parts = f"[^{BLANK}{feed}]+"
        if not any(re.search(f"{LETTER}[^{BLANK}{LETTER[1:]}|[^{BLANK}{LETTER[1:-1]}]{LETTER}", self.pieces[i]) for i in plain):
            parts = f"(?:{LETTER}+|[^{BLANK}{feed}{LETTER[1:]}+)"  # nor does one between a letter and another character
        self.segments = re.compile(f"{BLANK}*{parts}|{BLANK}+" + "|\n" * bool(feed))

    def edges(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(from, to, id) of every occurrence of every piece in ``points``, by position."""
        order = suffix_array(points, self.longest)
        padded = np.concatenate([points, np.full(self.longest, -1, np.int64)])
        bounds = []
        for upper in (False, True):
            low, high = np.zeros(len(self.ids), np.int64), np.full(len(self.ids), len(points))
            while (low < high).any():
                mid = (low + high) // 2
                live = low < high
                at = order[np.minimum(mid, len(points) - 1)]
                go, same = np.zeros(len(self.ids), bool), np.ones(len(self.ids), bool)
                for j in range(self.longest):  # compares the suffix with the piece, value by value
                    own = same & (j < self.length)
                    if not own.any():
                        break
                    have, want = padded[at + j], self.points[:, j]
                    go |= own & (have < want)
                    same &= (have == want) | (j >= self.length)
                go |= same & upper
                low, high = np.where(live & go, mid + 1, low), np.where(live & ~go, mid, high)
            bounds.append(low)
        count = bounds[1] - bounds[0]
        which = np.repeat(np.arange(len(self.ids)), count)
        at = order[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(bounds[0], count)]
        by = np.argsort(at)
        return at[by], at[by] + self.length[which[by]], self.ids[which[by]]


class Codec:
    """Encodes and decodes with a cache of segments."""

    def __init__(self, path: str, cache: int = CACHE):
        self.v, self.most = Vocabulary(path), cache
        self.clear()

    def clear(self) -> None:
        self.segments, self.chunks = Ragged(np.int32), Ragged(np.int32)

    def _unmatched(self, char: str) -> list[int]:
        return [self.v.byte[b] for b in char.encode("utf-8", "surrogatepass")] if self.v.byte else [self.v.unknown]

    def _relax_bpe(self, segment: str, edges: dict[tuple[int, int], int]) -> list[int]:
        score, n = self.v.score, len(segment)
        right = list(range(1, n + 1))  # end of the span that starts here
        left = list(range(-1, n - 1))  # start of the span before the one that starts here
        alive = [True] * n
        queue: list[tuple[float, int, int, int]] = []

        def offer(a: int) -> None:
            b = right[a]
            if b < n and (i := edges.get((a, right[b]))) is not None:
                heapq.heappush(queue, (-score[i], a, b, right[b]))

        for a in range(n - 1):
            offer(a)
        while queue:
            _, a, b, end = heapq.heappop(queue)
            if not alive[a] or right[a] != b or right[b] != end:
                continue
            alive[b], right[a] = False, end
            if end < n:
                left[end] = a
            offer(a)
            if left[a] >= 0:
                offer(left[a])
        out: list[int] = []
        a = 0
        while a < n:
            i = edges.get((a, right[a]))
            out.extend([i] if i is not None else self._unmatched(segment[a]))
            a = right[a]
        return out

    def _relax_unigram(self, segment: str, edges: dict[tuple[int, int], int]) -> list[int]:
        n, floor = len(segment), float(self.v.score[self.v.ids].min()) - 10
        best, back = [0.0] + [-np.inf] * n, [(0, -1)] * (n + 1)
        by_start: dict[int, list] = {}
        for (a, b), i in edges.items():
            by_start.setdefault(a, []).append((b, i))
        for a in range(n):
            own = by_start.get(a, [])
            if not any(b == a + 1 for b, _ in own):
                own = [*own, (a + 1, -1)]
            for b, i in sorted(own):
                s = best[a] + (self.v.score[i] if i >= 0 else floor)
                if s > best[b]:
                    best[b], back[b] = s, (a, i)
        path, b = [], n
        while b:
            a, i = back[b]
            path.append([i] if i >= 0 else self._unmatched(segment[a]))
            b = a
        return [i for part in reversed(path) for i in part]

    def _relax_bpe_together(self, points: np.ndarray, start: np.ndarray, end: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """BPE of all segments of ``points`` (0 between them) at once; a round takes each segment's best edge.

        Returns the spans' starts and ids, -1 where no piece covers a character.
        """
        span = np.full((len(points), self.v.longest + 1), -1, np.int32)  # id by start and length
        span[start, end - start] = ids
        inside = points != 0
        segment = np.cumsum(~inside)
        at = np.flatnonzero(inside)  # starts of the spans of segments that still change
        done_at, done_to = [], []
        stop = np.append(np.flatnonzero(~inside), len(points))  # end of each segment
        score = np.append(self.v.score, -np.inf)
        while len(at):
            own = segment[at]
            last = np.append(own[1:] != own[:-1], True)
            to = np.where(last, stop[own], np.append(at[1:], 0))
            pair_to = np.append(to[1:], 0)
            length = pair_to - at
            fits = ~last & (length <= self.v.longest)
            value = np.where(fits, score[span[at, np.where(fits, length, 0)]], -np.inf)
            first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            best = np.maximum.reduceat(value, first)
            counts = np.diff(np.append(first, len(at)))
            best_here = np.repeat(best, counts)
            over = best_here == -np.inf
            done_at.append(at[over])
            done_to.append(to[over])
            hit = np.flatnonzero(~over & (value == best_here))
            hit = hit[np.append(True, own[hit][1:] != own[hit][:-1])] if len(hit) else hit  # the leftmost of equals
            stay = ~over
            stay[hit + 1] = False
            at = at[stay]
        at, to = np.concatenate(done_at), np.concatenate(done_to)
        by = np.argsort(at, kind="stable")
        at, to = at[by], to[by]
        length = to - at
        return at, np.where(length <= self.v.longest, span[at, np.minimum(length, self.v.longest)], -1)

    def _learn(self, segments: list[str]) -> None:
        """Indexes segments that the cache doesn't have and keeps their ids."""
        points = np.frombuffer(("\0".join(segments) + "\0").encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
        start, end, ids = self.v.edges(points)
        if self.v.bpe and max(map(len, segments)) <= SHORT and not any("\0" in x for x in segments):
            at, found = self._relax_bpe_together(points, start, end, ids)
            begins = np.cumsum([0] + [len(x) + 1 for x in segments[:-1]])
            whose = np.searchsorted(begins, at, side="right") - 1
            odd = found < 0
            if odd.any():
                parts = [self._unmatched(chr(c)) for c in points[at[odd]].tolist()]
                sizes = np.ones(len(at), np.int64)
                sizes[odd] = [len(x) for x in parts]
                out = np.repeat(found, sizes)
                out[out < 0] = np.concatenate(parts)
                whose, found = np.repeat(whose, sizes), out
            self._keep(segments, found, np.bincount(whose, minlength=len(segments)))
            return
        start, end, ids = start.tolist(), end.tolist(), ids.tolist()
        relax = self._relax_bpe if self.v.bpe else self._relax_unigram
        at, e, each = 0, 0, []
        for segment in segments:
            stop = at + len(segment)
            own = {}
            while e < len(start) and start[e] < stop:
                if end[e] <= stop:
                    own[start[e] - at, end[e] - at] = ids[e]
                e += 1
            each.append(relax(segment, own))
            at = stop + 1
        self._keep(segments, np.array([i for x in each for i in x], np.int32), np.array([len(x) for x in each], np.int64))

    def _keep(self, segments: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        self.segments.add(segments, ids, sizes)

    def _learn_chunks(self, new: list[bytes], cut: list[list[str]]) -> None:
        """Adds the ids of chunks that are cut into segments."""
        fresh = set(chain.from_iterable(cut)) - self.segments.code.keys()
        short = [x for x in fresh if len(x) <= SHORT and "\0" not in x]
        step = max(1, TOGETHER * len(short) // max(1, sum(map(len, short)) + len(short)))
        for i in range(0, len(short), step):
            self._learn(short[i : i + step])
        if rest := [x for x in fresh if len(x) > SHORT or "\0" in x]:
            self._learn(rest)
        codes = self.segments.codes(list(chain.from_iterable(cut)))
        chunk = np.repeat(np.arange(len(new)), [len(x) for x in cut])
        self.chunks.add(new, self.segments.take(codes), np.bincount(chunk, weights=self.segments.size[codes], minlength=len(new)).astype(np.int64))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids as one array, and each text's number of ids.

        Texts are cut into chunks that start with a blank or follow a line feed; where two blanks meet, which belong
        to one segment, the text is a chunk of its own.
        """
        if len(self.segments.size) + len(self.chunks.size) > self.most:
            self.clear()
        odd = [i for i, t in enumerate(texts) if "  " in t or t[:1] == " " or BLANK in t]
        known = np.ones(len(texts), bool)
        known[odd] = False
        plain = [f"{BLANK}{t.replace(' ', f' {BLANK}')}".replace("\n", " \n ") if t and k else "" for t, k in zip(texts, known, strict=True)]
        found = Words(pa.array(plain, pa.large_string()), SPACE)
        distinct = found.listed()
        if new := [c for c in distinct if c not in self.chunks.code]:
            self._learn_chunks(new, [self.v.segments.findall(c.decode("utf-8", "surrogatepass")) for c in new])
        codes = self.chunks.codes(distinct)[found.codes]
        count = np.bincount(found.doc, weights=self.chunks.size[codes], minlength=len(texts)).astype(np.int64)
        ids = self.chunks.take(codes)
        if not odd:
            return ids, count
        cut = [self.v.segments.findall(BLANK + texts[i].replace(" ", BLANK)) for i in odd]
        own = Ragged(np.int32)
        whole, self.chunks = self.chunks, own
        self._learn_chunks([str(i) for i in range(len(odd))], cut)
        self.chunks = whole
        parts = np.split(ids, np.cumsum(count)[:-1])
        for k, i in enumerate(odd):
            parts[i] = own.take(np.array([k]))
            count[i] = len(parts[i])
        return np.concatenate(parts), count

    def decode(self, ids: np.ndarray, count: np.ndarray) -> list[str]:
        """The texts of sequences of ids that stand end to end."""
        raw = self.v.raw.take(ids)
        ends = np.concatenate([[0], np.cumsum(self.v.raw.size[ids])])[np.concatenate([[0], np.cumsum(count)])]
        first = np.zeros(len(count), bool)
        first[count > 0] = self.v.dummy[ids[(np.cumsum(count) - count)[count > 0]]]
        whole = raw.tobytes()
        return [whole[a + f : b].decode("utf-8", "replace") for a, b, f in zip(ends[:-1].tolist(), ends[1:].tolist(), first.tolist(), strict=True)]


@lru_cache(maxsize=1)
def worker_codec(path: str) -> Codec:
    """One codec a Python worker, whose cache stays warm from task to task."""
    return Codec(path)


def codec(docs: DataFrame, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (of little-endian unsigned 32-bit ids), round_trip and, ``with_ids``, ids.

    round_trip: decoding the ids gave the text again. Texts that hold U+2581 themselves can't, as the model
    doesn't tell it from a blank.
    """
    schema = "doc_id long, n_tokens long, ids_crc32 long, round_trip boolean" + ", ids array<int>" * with_ids

    def run(batches):
        own = worker_codec(path)
        for batch in small_batches(batches, limit=4 << 20):
            texts = batch.column("text").to_pylist()
            ids, count = own.encode(texts)
            raw, ends = memoryview(ids.astype("<u4").tobytes()), np.concatenate([[0], np.cumsum(count)])
            out = [
                batch.column("doc_id"),
                pa.array(count),
                pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.int64()),
                pa.array([a == b for a, b in zip(own.decode(ids, count), texts, strict=True)], pa.bool_()),
            ]
            if with_ids:
                out.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids)))
            yield pa.RecordBatch.from_arrays(out, names=[x.split()[0] for x in schema.split(", ")])

    return documents(docs).select("doc_id", "text").mapInArrow(run, schema)


def default_model() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def op9_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again."""
    return codec(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_model(), with_ids=False).select(
        "doc_id", "n_tokens", "ids_crc32", F.col("round_trip")
    )
