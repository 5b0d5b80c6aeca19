"""Substring deduplication by recompression: Spark rounds on names that are the same wherever the words are.

A window is ``window`` consecutive words of one document. Words covered by a window whose word sequence starts
anywhere else too are removed; windows are judged on the input.

Names. Level 0 names every maximal run of one word, later levels every pair of neighbours whose names fall in opposite
halves (by a hash bit of name and level). A name is a function of the names it joins (two hashes of 64 bits, seeded by
the level), so all tasks agree on it, and a symbol depends only on the words in its interval [lo, hi), which is
tracked. Hence equal windows have the same symbols inside, wherever they stand.

Rounds. (1) A window's anchor is the least name among the symbols whose interval it holds, if ``KEY`` words from their
lo on are inside, too; its phrase is the anchor with the symbols after it that these words decide. The windows of an
anchor follow each other; all their words are its context. Contexts and windows are named by what makes them up: the
words before their first symbol, their symbols, the words after their last one. Batches of documents send the names of
their distinct phrases and contexts, and Spark tells what other places have. A phrase with one place is dead: no window
with it is repeated. One whose places all have one context is uniform: all its windows are repeated. (2) The other
living phrases' windows, and windows without an anchor (in long runs of one word), are sent by name, and Spark tells
which names occur anywhere else. As symbols stand for their words, two windows have one name just where their words are
equal (but for one chance in 2**96 a pair). (3) Words under windows of uniform phrases and repeated names go.

Messages are flat rows, a name each, sorted by name in the JVM: linear in the words at every size, in no task more
than one row a batch for the most frequent name. A batch sends a name once, however often it occurs there, so a
passage that a third of all documents hold costs one row a batch. Rows are dealt to batches by their place, repeated
rows too, and written so once: all rounds see the same batches. Only a document longer than a batch makes one larger.

Defined results: null text counts as empty and has no words; documents shorter than ``window`` stay as they are,
words joined by one blank; repeated rows are documents each, so their windows occur twice; an empty table gives no
rows; extra columns are ignored unless carried.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..stored import written
from ._shared import BASES, Words, documents, mix, text_bytes

#: Levels of pairs; words that decide a phrase by words of a window; bytes of a batch.
LEVELS, KEY, BATCH = 5, 4 / 7, 4 << 20


class Symbols:
    """The symbols of words with hashes ``names`` (two arrays): names, start (first word), lo and hi, none of which
    ever decreases.

    An interval that reaches over a text's edge (to a neighbour that isn't there) ends outside the text.
    """

    def __init__(self, names: tuple[np.ndarray, np.ndarray], doc: np.ndarray, levels: int):
        n = len(doc)
        begins = np.append(True, (names[0][1:] != names[0][:-1]) | (doc[1:] != doc[:-1])) if n else np.zeros(0, bool)
        at = np.flatnonzero(begins)
        length = np.diff(np.append(at, n)) if n else at
        with np.errstate(over="ignore"):
            named = [np.where(length > 1, mix(x[at] * BASES[0] + length.astype(np.uint64)), x[at]) for x in names]
            start, lo, hi, doc = at, at - 1, at + length + 1, doc[at]  # a run ends where its neighbours differ
            for r in range(levels if n else 0):
                left = (named[0] * (BASES[1] + np.uint64(2 * r))) >> np.uint64(63) == 0
                beside = doc[1:] == doc[:-1]  # a neighbour follows in the same text
                looked, other = np.flatnonzero(left[:-1] & beside), np.flatnonzero(~left[1:] & beside) + 1
                new_hi, new_lo = hi.copy(), lo.copy()
                new_hi[looked] = hi[looked + 1]  # joined or not, a left one has looked at what follows
                new_lo[other] = lo[other - 1]
                joins = looked[~left[looked + 1]]
                for x in named:
                    x[joins] = mix(x[joins] * BASES[0] + x[joins + 1] * BASES[1] + np.uint64(r))
                stays = np.ones(len(left), bool)
                stays[joins + 1] = False
                named = [x[stays] for x in named]
                start, doc, lo, hi = start[stays], doc[stays], new_lo[stays], new_hi[stays]
        self.names, self.start, self.lo, self.hi = named, start, lo, hi


class Ranges:
    """A hash of any range of a sequence of names: prefix sums of names times powers of an odd base, modulo 2**64."""

    def __init__(self, names: np.ndarray, base: np.uint64):
        with np.errstate(over="ignore"):
            powers = np.cumprod(np.append(np.uint64(1), np.full(len(names), base, np.uint64)))
            self.back = np.cumprod(np.append(np.uint64(1), np.full(len(names), pow(int(base), -1, 1 << 64), np.uint64)))
            self.sums = np.append(np.uint64(0), np.cumsum(names * powers[:-1]))

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The hashes of the ranges [begin, end), which tell their lengths apart."""
        with np.errstate(over="ignore"):
            return mix((self.sums[end] - self.sums[begin]) * self.back[begin] + (end - begin).astype(np.uint64) * BASES[1])


class Batch:
    """A batch's words, windows and phrases. Windows are named by their first word's number."""

    def __init__(self, texts: pa.Array, window: int, levels: int):
        self.words = w = Words(texts)
        self.window = window
        self.hashes = w.hashes()
        many = np.maximum(w.count - window + 1, 0)
        starts = np.repeat(w.first, many)
        self.starts = starts + np.arange(len(starts)) - np.repeat(np.cumsum(many) - many, many)
        self.symbols = s = Symbols(self.hashes, w.doc, levels)
        self.width = max(1, int(window * KEY))
        end = self.starts + window
        # symbols inside a window: from first up to, without, last
        n = len(w.doc)
        below = np.append(0, np.cumsum(np.bincount(s.lo + 1, minlength=n + 2)))  # symbols whose lo is less than k - 1, at k
        until = np.cumsum(np.bincount(s.hi, minlength=n + 2))  # symbols whose hi is at most k, at k
        self.first, self.last = below[self.starts + 1], until[end]
        # the anchor: the least name among those of them with a phrase inside
        stop = np.minimum(self.last, below[end - self.width + 2])
        self.anchored = stop > self.first
        self.anchor = np.where(self.anchored, self.first, 0)
        for step in range(1, int((stop - self.first).max(initial=0))):
            other = np.minimum(self.first + step, max(len(s.lo) - 1, 0))
            less = (self.first + step < stop) & (s.names[0][other] < s.names[0][self.anchor])
            self.anchor[less] = other[less]

    def phrases(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The anchor's number of each anchored window, and for each anchor in use, in order, the names of its phrase and
        of its context: all words of the windows that it anchors, which follow each other."""
        s, own = self.symbols, np.flatnonzero(self.anchored)
        anchor = self.anchor[own]
        new = np.append(True, anchor[1:] != anchor[:-1])[: len(own)]
        at = np.flatnonzero(new)
        used = anchor[at]
        stop = np.maximum(np.searchsorted(s.hi, s.lo[used] + self.width, side="right"), used + 1)
        low, high = own[at], own[np.append(at[1:], len(own)) - 1] if len(own) else own
        context = self._name(0, self.starts[low], self.starts[high] + self.window, self.first[low], self.last[high])
        return np.cumsum(new) - 1, Ranges(s.names[0], BASES[1]).of(used, stop), context

    def _name(self, part: int, begin: np.ndarray, end: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Names of the words [begin, end) with the symbols [first, last) inside: of the words before the symbols, the
        symbols, and the words after."""
        s, none = self.symbols, last <= first
        low = np.where(none, end, np.append(s.start, 0)[first])
        high = np.where(none, end, np.append(s.start, len(self.words.doc))[last])  # a symbol ends where the next one starts
        first, last = np.where(none, 0, first), np.where(none, 0, last)
        words, inside = Ranges(self.hashes[part], BASES[part]), Ranges(s.names[part], BASES[part])
        with np.errstate(over="ignore"):
            return mix(mix(words.of(begin, low) * BASES[0] + inside.of(first, last)) * BASES[1] + words.of(high, end))

    def names(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Names (64 and 32 bits) of windows."""
        begin = self.starts[windows]
        one, two = (self._name(k, begin, begin + self.window, self.first[windows], self.last[windows]) for k in range(2))
        return one, (two >> np.uint64(32)).astype(np.uint32)

    def judged(self, answers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows whose phrase is uniform, and windows to ask for: without an anchor, or with a phrase that lives but is
        not uniform. ``answers``: UNIQUE, LIVING or UNIFORM, a distinct phrase by name."""
        anchor, names, _ = self.phrases()
        kind = np.full(len(self.starts), LIVING, np.int8)
        kind[self.anchored] = answers[ranked(names)[2]][anchor]
        return np.flatnonzero(kind == UNIFORM), np.flatnonzero(kind == LIVING)


#: What is known of a phrase: one place has it; several have it; several have it, in one context.
UNIQUE, LIVING, UNIFORM = 0, 1, 2


def ranked(first: np.ndarray, second: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One place of each distinct name (of one or two parts) in their order, how often each occurs, and the number of
    each place's name."""
    order = np.argsort(first)
    new = np.append(True, first[order][1:] != first[order][:-1])[: len(order)]
    if second is not None:
        if ((second[order][1:] != second[order][:-1]) & ~new[1:]).any():  # hardly ever: other names with the same first part
            order = np.lexsort([second, first])
        new = np.append(True, (first[order][1:] != first[order][:-1]) | (second[order][1:] != second[order][:-1]))[: len(order)]
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    at = np.flatnonzero(new)
    return order[at], np.diff(np.append(at, len(order))), number


#: What a batch sends of a distinct phrase: its name and context; its rank among the batch's phrases, and in the lowest
#: bits whether it occurs more than once in the batch and whether its contexts differ there.
PHRASES = "b long, name long, context long, rest int"
#: What a batch sends of a distinct window: 64 bits of its name; 32 more, its rank among the batch's windows in 31, and
#: whether it occurs more than once in the batch. As few columns as there can be, since rows are many.
WINDOWS = "b long, name long, rest long"


def _phrases(b: int, names: np.ndarray, contexts: np.ndarray) -> pa.Table:
    at, many, number = ranked(names)
    differ = np.zeros(len(at), bool)
    differ[number[contexts != contexts[at][number]]] = True
    rest = (np.arange(len(at)) << 2 | differ << 1 | (many > 1)).astype(np.int32)
    return pa.table({"b": np.full(len(at), b, np.int64), "name": names[at].view(np.int64), "context": contexts[at].view(np.int64), "rest": rest})


def _windows(b: int, first: np.ndarray, second: np.ndarray) -> pa.Table:
    at, many, _ = ranked(first, second)
    rest = second[at].astype(np.uint64) << np.uint64(32) | np.arange(len(at), dtype=np.uint64) << np.uint64(1) | (many > 1).astype(np.uint64)
    return pa.table({"b": np.full(len(at), b, np.int64), "name": first[at].view(np.int64), "rest": rest.view(np.int64)})


def living_phrases(sent: DataFrame) -> DataFrame:
    """b, rank and kind (LIVING or UNIFORM) of the phrases that more than one place has.

    If all places have one context, each window of the phrase occurs in all of them. A name has one row a batch at
    most, so no key grows with its occurrences.
    """
    w = Window.partitionBy("name")
    rows = sent.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_one", (F.min("context").over(w) == F.max("context").over(w)) & (F.max(F.col("rest").bitwiseAND(2)).over(w) == 0))
    rows = rows.where("_n > 1 or rest % 2 <> 0")
    return rows.select("b", F.shiftright("rest", 2).alias("rank"), F.when(F.col("_one"), UNIFORM).otherwise(LIVING).alias("kind"))


def repeated_windows(sent: DataFrame) -> DataFrame:
    """b and rank of the windows that another batch has sent too, or which occur twice in their own; kind is null."""
    w = Window.partitionBy("name", F.shiftright("rest", 32))
    hits = sent.withColumn("_n", F.count(F.lit(1)).over(w)).where("_n > 1 or rest % 2 <> 0")
    return hits.select("b", F.shiftright("rest", 1).bitwiseAND((1 << 31) - 1).cast("int").alias("rank"), F.lit(None).cast("int").alias("kind"))


def without_repeats(docs: DataFrame, window: int = 35, carry: tuple[str, ...] = (), batch_bytes: int = BATCH) -> DataFrame:
    """doc_id, ``carry``, n_words, n_removed, kept (the words that stay, joined by one blank)."""
    spark = docs.sparkSession
    df = documents(docs, *carry)
    batches = max(-(-text_bytes(df) // batch_bytes), int(spark.conf.get("spark.sql.shuffle.partitions")))
    place = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(batches))
    df = written(df.drop("rid").withColumn("b", place), "batches")
    kept = [f for f in df.schema.fields if f.name not in ("text", "b")]
    levels = LEVELS if window >= 24 else 0

    def load(table: pa.Table) -> Batch:
        return Batch(table.column("text").combine_chunks(), window, levels)

    def phrases(table: pa.Table) -> pa.Table:
        return _phrases(table.column("b")[0].as_py(), *load(table).phrases()[1:])

    def judged(batch: Batch, living: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        answers = np.zeros(len(batch.symbols.start), np.int8)
        answers[living.column("rank").to_numpy()] = living.column("kind").to_numpy()
        return batch.judged(answers)

    def windows(table: pa.Table, living: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _windows(0, np.zeros(0, np.uint64), np.zeros(0, np.uint32))
        batch = load(table)
        return _windows(table.column("b")[0].as_py(), *batch.names(judged(batch, living)[1]))

    def result(table: pa.Table, found: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.Table.from_batches([], schema=pa.schema([]))
        batch, of_phrase = load(table), pc.is_valid(found.column("kind"))
        w = batch.words
        uniform, ask = judged(batch, found.filter(of_phrase))
        at, _, number = ranked(*batch.names(ask))
        again = np.zeros(len(at), bool)
        again[found.filter(pc.invert(of_phrase)).column("rank").to_numpy()] = True
        hit = batch.starts[np.concatenate([uniform, ask[again[number]]])]
        edge = np.zeros(len(w.doc) + 1, np.int64)
        np.add.at(edge, hit, 1)
        np.add.at(edge, hit + window, -1)
        stays = np.cumsum(edge)[:-1] == 0
        removed = w.count - np.bincount(w.doc[stays], minlength=len(w.count))
        columns = [table.column(f.name) for f in kept] + [pa.array(w.count), pa.array(removed), joined(w, stays)]
        return pa.Table.from_arrays(columns, names=[f.name for f in kept] + ["n_words", "n_removed", "kept"])

    by_batch = df.groupBy("b")
    living = living_phrases(by_batch.applyInArrow(phrases, PHRASES))
    answers = living.unionByName(repeated_windows(by_batch.cogroup(living.groupBy("b")).applyInArrow(windows, WINDOWS)))
    schema = T.StructType([*kept, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])
    return by_batch.cogroup(answers.groupBy("b")).applyInArrow(result, schema)


def joined(words: Words, stays: np.ndarray) -> pa.Array:
    """Each text's words that stay, joined by one blank."""
    length = np.diff(np.frombuffer(words.arrow.buffers()[1], np.int64)[: len(stays) + 1]) if len(stays) else np.zeros(0, np.int64)
    data = np.frombuffer(words.arrow.buffers()[2], np.uint8) if len(stays) else np.zeros(0, np.uint8)
    own = length[stays] + 1
    out = np.full(int(own.sum()), 32, np.uint8)
    ends = np.cumsum(own)
    letters = np.ones(len(out), bool)
    letters[ends - 1] = False
    out[letters] = data[np.repeat(stays, length)]
    per = np.bincount(words.doc[stays], weights=own, minlength=len(words.count)).astype(np.int64)
    whole, at, texts = out.tobytes(), 0, []
    for n in per.tolist():
        texts.append(whole[at : at + max(n - 1, 0)])
        at += n
    return pa.array(texts, pa.binary()).cast(pa.string())


def op5_substring_dedup(spark, sf_dir: str) -> DataFrame:
    found = without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), window=35)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH w AS (
  SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS word,
         generate_subscripts(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'), 1) AS pos FROM documents),
g AS (SELECT doc_id, pos, list(word) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING) AS run FROM w),
k AS (SELECT doc_id, pos, hash(run) AS h1, md5(array_to_string(run, ' ')) AS h2 FROM g WHERE len(run) = 35),
r AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, count(*) OVER (PARTITION BY h1, h2) AS n FROM k) WHERE n > 1),
m AS (SELECT w.doc_id, w.pos, w.word, max(r.pos) OVER (PARTITION BY w.doc_id ORDER BY w.pos ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS near
      FROM w LEFT JOIN r ON r.doc_id = w.doc_id AND r.pos = w.pos),
o AS (SELECT doc_id, count(*) AS n_words, count(near) AS n_removed,
             string_agg(CASE WHEN near IS NULL THEN word END, ' ' ORDER BY pos) AS kept FROM m GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN o USING (doc_id)
"""
