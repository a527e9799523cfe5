"""LM scoring with a probabilistic suffix tree over words.

Training texts are those whose crc32(doc_id as text) mod FOLDS is not HELD_OUT. The root of the tree is the add-half unigram
model of the base score: words in lower case (A-Z) and one end sign a text. A deeper state stands for the last 1 to DEPTH
words (the start of the text counts as one, contexts don't reach beyond it). A branch (context, next word) enters the tree if
it occurs MIN_COUNT times or more and diverges from what the shorter context says of the next word: its count times the log
ratio of both probabilities is over DIVERGENCE. A context is retained if it has such a branch. Both bounds are absolute, so
the tree grows with the corpus; it stays in Spark tables, and no part of it but the USUAL most frequent words and branches is
collected or sent to tasks. Distributions are smoothed by their suffix's: with N occurrences of a context whose m branches
have n_x each, p(x) = (n_x - DISCOUNT + w * p_suffix(x)) / (N + KAPPA), where w = N - sum of n_x + DISCOUNT * m + KAPPA and the
first two terms are left out for words without a branch; so each distribution sums to 1 as the root's does. A text's
score is the sum of log10 of the probability in the state of the longest retained suffix.

The score of a position is a sum of independent lookups: the root's value of the word, the back-off weight of each context
that is retained, and for each branch what it adds to the probability backed off to. So a scan of the texts looks up usual
keys in the task and sends the others, those that a Bloom filter of bounded size lets through, to where the tables are.
Branches are counted level by level: deeper ones only where both of their parts one word shorter are branches, by the Bloom
filter of these. Each level has its own filter, and a scan tries a deeper run only where both of its parts have passed theirs, as only
such runs are in the tree. Where a filter is full, more keys are counted and looked up, with the same results.

Keys are hashes, and what is counted or looked up is dealt out by ranges of them, PART_BYTES of text to a range, so that a
range is of bounded size whatever the corpus. Tasks send a range's keys as packed numbers in one row, Spark shuffles the rows
by range, and each range is counted or looked up as numpy arrays. A key that is in a third of all texts is summed in each
task before it is sent.

Nulls: a null text is empty (only the end), a null doc_id counts as the empty text in crc32; doc_id can be of any type.
Very long texts are scanned as others, alone in their chunk. Repeated rows get equal results, once each. An empty table gives
an empty result. Other columns are not looked at, whatever their names. Words are told apart by a 64-bit hash, runs by 48 bits
of one, rows by their place in a block of rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barlight.llm.exact_dedup import BUCKET, bitmaps
from barlight.llm.tables import deleted, read, released, saved, small_batches
from barlight.llm.textscan import Scan, chunks, mix

FOLDS, HELD_OUT = 5, 1
DEPTH, MIN_COUNT, DIVERGENCE, DISCOUNT, KAPPA = 2, 2, 12.0, 0.5, 1.0
#: So many words and branches, the most frequent ones, are looked up in the task; a level's filter has at most so many bits.
USUAL, FILTER_BITS = 1 << 18, 1 << 28
U = np.uint64
BEGIN, END = U(0x1B873593CC9E2D51), U(0x85EBCA6BC2B2AE35)
#: Runs, and the symbols that they are made of, are counted by the upper 48 bits of their hashes.
SHORT = U(0xFFFFFFFFFFFF0000)
#: Keys that a task holds before it sends them, and text to a range of keys.
HELD, PART_BYTES = 1 << 19, 8 << 20
#: Rows of a block at most, so that 16 bits tell them apart.
BLOCK_ROWS = 1 << 16


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % FOLDS == HELD_OUT


class Words:
    """Of a chunk of texts: symbols (a start, the words and an end for each text), the text and place of each symbol, and
    runs(d): a hash of each symbol with the d before it, of 48 bits (the upper ones) from d = 1 on."""

    def __init__(self, s: Scan):
        n = np.diff(s.tok_off)
        size = n + 2
        last = np.cumsum(size) - 1
        self.doc = np.repeat(np.arange(s.docs), size)
        self.place = np.arange(int(size.sum())) - np.repeat(last - n - 1, size)
        x = np.full(len(self.doc), BEGIN, dtype=U)
        x[last] = END
        x[(self.place > 0) & (self.place <= n[self.doc])] = s.word_hashes()
        self._runs = [x]

    def runs(self, d: int) -> np.ndarray:
        while len(self._runs) <= d:
            k, x, before = len(self._runs), self.short(0), self.short(len(self._runs) - 1)
            out = x.copy()
            out[1:] = run_of(before[:-1], x[1:], k)
            self._runs.append(out)
        return self._runs[d]

    def short(self, d: int) -> np.ndarray:
        return self.runs(d) & SHORT

    def before(self, d: int) -> np.ndarray:
        """runs(d) of the symbol before, of 48 bits."""
        return np.append(U(0), self.short(d)[:-1])

    def predicted(self, d: int) -> np.ndarray:
        """Whether a symbol has a context of d symbols in its text."""
        return self.place >= max(d, 1)


class Filter:
    """A Bloom filter with two positions a key, which is a hash already; only its upper 48 bits count."""

    def __init__(self, keys: DataFrame, column: str, most: int = FILTER_BITS):
        n = max(1, keys.count())
        self.bits = min(most, BUCKET << max(0, (-(-16 * n // BUCKET) - 1).bit_length()))
        low = F.lit(self.bits - 1).cast("long")
        at = F.explode(F.array(F.shiftrightunsigned(column, 16).bitwiseAND(low) + 1, F.shiftrightunsigned(column, 36).bitwiseAND(low) + 1))
        self.map = np.zeros(self.bits // 8, dtype=np.uint8)
        for r in bitmaps(keys.select(at.alias("at"))).collect():
            self.map[(r.bucket - 1) * BUCKET // 8 : r.bucket * BUCKET // 8] = np.frombuffer(r.bits, dtype=np.uint8)

    def __call__(self, key: np.ndarray) -> np.ndarray:
        low = U(self.bits - 1)
        out = np.ones(len(key), dtype=bool)
        for at in ((key >> U(16)) & low, (key >> U(36)) & low):
            out &= (self.map[(at >> U(3)).astype(np.int64)] >> (at & U(7)).astype(np.uint8)) & 1 > 0
        return out


def part_of(key: np.ndarray, parts: int) -> np.ndarray:
    return ((key >> U(32)) * U(parts)) >> U(32)


def stretches(key: np.ndarray, parts: int) -> np.ndarray:
    """Of sorted keys: where each of all ranges starts, and where the last one ends."""
    return np.searchsorted(part_of(key, parts), np.arange(parts + 1, dtype=U)).astype(np.int64)


def cut(x: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary for each stretch of an array whose bytes lie one after the other. ends: as of stretches()."""
    x = np.ascontiguousarray(x)
    size = x.dtype.itemsize * (x.shape[1] if x.ndim > 1 else 1)
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * size).astype(np.int32)), pa.py_buffer(x)])


def joined(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of binaries one after the other, and how many each has: the reverse of cut()."""
    data, size = [np.zeros(0, dtype=np.uint8)], [np.zeros(0, dtype=np.int64)]
    for x in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        if len(x):
            _, off, values = x.buffers()
            off = np.frombuffer(off, dtype=np.int64 if x.type == pa.large_binary() else np.int32)[x.offset : x.offset + len(x) + 1].astype(np.int64)
            size.append(np.diff(off))
            if off[-1] > off[0]:
                data.append(np.frombuffer(values, dtype=np.uint8)[off[0] : off[-1]])
    return np.concatenate(data), np.concatenate(size)


def six(x: np.ndarray) -> np.ndarray:
    """The upper 48 bits of each key, as 6 bytes."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8)[:, 2:]


def eight(x: np.ndarray) -> np.ndarray:
    """Keys of 6 bytes each as numbers again."""
    out = np.zeros((len(x) // 6, 8), dtype=np.uint8)
    out[:, 2:] = x.reshape(-1, 6)
    return out.reshape(-1).view(U)


class Branches:
    """Counts of branches (context, word), merged in the order of their run when there are many."""

    def __init__(self, d: int) -> None:
        self.d, self.held = d, []

    def run(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        return run_of(context, word, self.d) if self.d else word

    def add(self, context: np.ndarray, word: np.ndarray, run: np.ndarray) -> None:
        _, first, n = np.unique(run, return_index=True, return_counts=True)
        self.put([context[first], word[first], n.astype(np.uint32)])

    def put(self, columns: list[np.ndarray]) -> None:
        self.held.append(columns)

    def full(self) -> bool:
        return sum(len(x[2]) for x in self.held) > HELD

    def merged(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """run, context, word and n in the order of run; nothing is held any more."""
        if not self.held:
            return np.zeros(0, dtype=U), np.zeros(0, dtype=U), np.zeros(0, dtype=U), np.zeros(0, dtype=np.int64)
        context, word, n = (np.concatenate(x) for x in zip(*self.held, strict=True))
        self.held = []
        run = self.run(context, word)
        order = np.argsort(run)
        run = run[order]
        first = np.flatnonzero(np.append(True, run[1:] != run[:-1])) if len(run) else order
        n = np.add.reduceat(n[order], first, dtype=np.int64) if len(run) else n.astype(np.int64)
        order = order[first]
        return run[first], context[order], word[order], n


def run_of(context: np.ndarray, word: np.ndarray, d: int) -> np.ndarray:
    """The hash of a run from that of the d symbols before its last and the last one's."""
    return mix(word + mix(context) * U(2 * d + 1)) & SHORT


def packed(run: np.ndarray, context: np.ndarray, word: np.ndarray, n: np.ndarray, d: int, parts: int) -> tuple[np.ndarray, list[pa.Array]]:
    """Ranges, and contexts, words and counts of each. Of branches 6 bytes of context and word and one byte of the count (larger
    ones are several branches); of words all."""
    if d and (n > 255).any():
        times = -(-n // 255)
        run, context, word = (np.repeat(x, times) for x in (run, context, word))
        last = np.cumsum(times) - 1
        rest = n - (times - 1) * 255
        n = np.full(len(word), 255)
        n[last] = rest
    ends = stretches(run, parts)
    columns = [cut(six(context), ends), cut(six(word), ends), cut(n.astype(np.uint8), ends)] if d else [cut(context[:0], ends * 0), cut(word, ends), cut(n.astype(np.uint32), ends)]
    some = np.flatnonzero(np.diff(ends))
    return some, [c.take(pa.array(some)) for c in columns]


def unpacked(context: np.ndarray, word: np.ndarray, n: np.ndarray, d: int) -> list[np.ndarray]:
    if not d:
        word = word.view(U)
        return [np.zeros(len(word), dtype=U), word, n.view(np.uint32)]
    return [eight(context), eight(word), n.astype(np.uint32)]


def counted(training: DataFrame, d: int, parts: int, branch: Filter | None = None) -> DataFrame:
    """run, its context (a run of d symbols), word and n, summed over all training texts, of branches with MIN_COUNT; at level 1 also all
    symbols, with context 0. Deeper branches are counted where both runs of d symbols in them pass the filter. training: one
    column of texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, runs = Branches(0), Branches(d)

        def sent(held: Branches) -> Iterator[pa.RecordBatch]:
            some, columns = packed(*held.merged(), held.d, parts)
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(np.full(len(some), held.d), pa.int32()), *columns], ["part", "level", *PACKED])

        for batch in batches:
            for _, _, s in chunks(batch.column(0), lower=True):
                w = Words(s)
                there = w.predicted(d)
                if branch:
                    known = branch(w.runs(d - 1))
                    there &= known & np.append(False, known[:-1])
                else:
                    x = w.runs(0)
                    words.add(np.zeros(len(x), dtype=U), x, x)
                runs.add(w.before(d - 1)[there], w.short(0)[there], w.runs(d)[there])
                if words.full():
                    yield from sent(words)
                if runs.full():
                    yield from sent(runs)
        yield from sent(words)
        yield from sent(runs)

    def total(table: pa.Table) -> pa.Table:
        held = Branches(table["level"][0].as_py())
        held.put(unpacked(*(joined(table[c])[0] for c in PACKED), held.d))
        run, context, word, n = held.merged()
        some = n >= (MIN_COUNT if held.d else 1)
        return pa.table({"run": run[some].view(np.int64), "context": context[some].view(np.int64), "word": word[some].view(np.int64), "n": n[some]})

    sent = training.mapInArrow(count, "part int, level int, " + ", ".join(f"{c} binary" for c in PACKED))
    return sent.groupBy("part", "level").applyInArrow(total, "run long, context long, word long, n long")


PACKED = ["contexts", "words", "ns"]


class Tree:
    """The suffix tree as saved tables: words (at, c), and of each level d the branches (run, n, adds) and the contexts
    (context, n, weight), adds and weight as log10."""

    def __init__(self, training: DataFrame, parts: int, depth: int = DEPTH):
        begin = int(BEGIN.view(np.int64))
        rows = saved(counted(training, 1, parts), "counts")
        released(training.sparkSession)
        symbols = saved(rows.where("context = 0").select(F.col("word").alias("at"), F.col("n").alias("c")), "words")
        self.words = symbols.where(F.col("at") != begin)
        n, v = self.words.agg(F.sum("c"), F.count(F.lit(1))).first()
        self.total, self.distinct = n or 0, v
        self.log_all = float(np.log10(self.total + 0.5 * (self.distinct + 1)))
        self.branches: list[DataFrame] = []
        self.contexts: list[DataFrame] = []
        self.filters: list[Filter] = []
        often = rows.where("context != 0")
        short = F.col("at").bitwiseAND(int(SHORT.view(np.int64)))
        root = self.words.groupBy(short.alias("word")).agg((F.log10(F.max("c") + 0.5) - self.log_all).alias("backed"))
        sizes = symbols.groupBy(short.alias("context")).agg(F.max("c").alias("of"), F.max_by("at", "c").alias("symbol"))
        found = often.join(sizes, "context").join(root, "word").withColumn("suffix", F.col("word"))
        for d in range(1, depth + 1):
            if d > 1:
                deleted(rows)
                rows = saved(counted(training, d, parts, self.filters[-1]), "counts")
                released(training.sparkSession)
                # The context without its first symbol, and what it says of the word.
                of = below.select(F.col("run").alias("context"), F.col("n").alias("of"), F.col("suffix").alias("shorter"))
                backed = below.select(F.col("context").alias("shorter"), "word", F.col("lp").alias("backed"), F.col("run").alias("suffix"))
                found = rows.join(of, "context").join(backed, ["shorter", "word"]).withColumn("symbol", F.col("context"))
            below = self._level(found, d < depth)
        deleted(rows)

    def _level(self, found: DataFrame, deeper: bool) -> DataFrame:
        """Keeps the branches that diverge, of all found: run, context, word, suffix (the run without its first symbol), n, of
        (count of the context), symbol (by which the context is looked up) and backed (log10 of what the shorter context says).
        Returns run, n and adds of those kept, and context, word, suffix and lp if there is a deeper level; as both parts of a deeper branch
        are branches, no others count."""
        gain = F.col("n") * (F.log(F.col("n") / F.col("of")) - F.col("backed") * float(np.log(10)))
        found = saved(found.where(gain > DIVERGENCE).select("run", "context", "word", "suffix", "symbol", "n", "of", "backed"), "found")
        left = F.first("of") - F.sum("n") + DISCOUNT * F.count(F.lit(1)) + KAPPA
        contexts = found.groupBy("context").agg(F.first("symbol").alias("at"), F.first("of").alias("n"), left.alias("left"))
        contexts = saved(contexts.withColumn("weight", F.log10(F.col("left") / (F.col("n") + KAPPA))), "contexts")
        rows = found.join(contexts.select("context", "left", "weight"), "context")
        lp = F.log10((F.col("n") - DISCOUNT + F.col("left") * F.pow(F.lit(10.0), "backed")) / (F.col("of") + KAPPA))
        rows = saved(rows.select("run", "n", (lp - F.col("backed") - F.col("weight")).alias("adds"), *["context", "word", "suffix", lp.alias("lp")] * deeper), "level")
        deleted(found)
        released(rows.sparkSession)
        self.branches.append(rows.select("run", "n", "adds"))
        self.contexts.append(contexts)
        self.filters.append(Filter(self.branches[-1], "run"))
        return rows

    def lookups(self) -> DataFrame:
        """at, c (of words, else null), n (how often it occurs) and value, which the score takes besides the root's. A symbol or run has a
        row as word or branch and another one if it is a context, both of the same n; their values add up."""
        none = F.lit(None).cast("long").alias("c")
        out = self.words.select("at", "c", F.col("c").alias("n"), F.lit(0.0).alias("value"))
        for branches, contexts in zip(self.branches, self.contexts, strict=True):
            out = out.unionByName(contexts.select("at", none, "n", F.col("weight").alias("value")))
            out = out.unionByName(branches.select(F.col("run").alias("at"), none, "n", F.col("adds").alias("value")))
        return out

    def frequent(self, most: int) -> int:
        """From which n on there are at most so many words and branches: a power of 2 ** (1 / 8), rounded up."""
        n = self.words.select(F.col("c").alias("n"))
        for branches in self.branches:
            n = n.unionByName(branches.select("n"))
        step = F.floor(F.log2("n") * 8).alias("step")
        least, total = None, 0
        for r in sorted(n.groupBy(step).count().collect(), key=lambda r: -r.step):  # a few hundred rows
            total += r["count"]
            if total > most:
                break
            least = r.step
        return max(2, 1 << 62 if least is None else math.ceil(2 ** (least / 8)))


def summed_by_key(at: np.ndarray, c: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys in order, each once, with their counts as words (0: none) and the sums of their values."""
    order = np.argsort(at, kind="stable")
    at, c, value = at[order], c[order], value[order]
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else order
    return (at[first], np.maximum.reduceat(c, first), np.add.reduceat(value, first)) if len(at) else (at, c, value)


class Usual:
    """Keys in order with their counts as words (0: none) and values; of() gives the place of each key asked for, and whether it
    is there. Keys are hashes: where those with the same first bits start is looked up, then a few steps are taken."""

    BITS = 19

    def __init__(self, rows):
        self.at, self.c, self.value = summed_by_key(rows["at"].to_numpy(np.int64).view(U), rows["c"].fillna(0).to_numpy(np.int64), rows["value"].to_numpy(np.float64))
        # Past the last key stands one that ends all steps.
        self.at, self.c, self.value = np.append(self.at, ~U(0)), np.append(self.c, 0), np.append(self.value, 0.0)
        self.start = None

    def of(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = U(64 - self.BITS)
        if self.start is None:  # in the task, so that it isn't sent
            self.start = np.searchsorted(self.at[:-1], np.arange(1 << self.BITS, dtype=U) << first)
        i = self.start[(key >> first).astype(np.int64)]
        left = np.flatnonzero(self.at[i] < key)
        while len(left):
            i[left] += 1
            left = left[self.at[i[left]] < key[left]]
        return i, (self.at[i] == key) & (i < len(self.at) - 1)


class Asked:
    """A block of rows: what is known of each, and the keys that still have to be looked up for them, words and runs apart."""

    def __init__(self) -> None:
        self.rows: list[list] = []
        self.keys: list[tuple[np.ndarray, np.ndarray, bool]] = []
        self.n = self.size = 0

    def full(self, docs: int) -> bool:
        """Whether so many more rows don't go into the block."""
        return self.size > HELD or self.n + docs > BLOCK_ROWS

    def add(self, columns: list, keys: list[tuple[np.ndarray, np.ndarray, bool]]) -> None:
        """keys: key, row and whether they are words."""
        self.rows.append(columns)
        self.keys += [(key, row + self.n, is_word) for key, row, is_word in keys]
        self.n += len(columns[1])
        self.size += sum(len(key) for key, _, _ in keys)

    def batches(self, block: int, parts: int) -> Iterator[pa.RecordBatch]:
        """A row with the known columns as lists, under a number below 0, and a row for each range with the keys in it."""
        known = [pa.concat_arrays(list(c)) for c in zip(*self.rows, strict=True)]
        whole = [pa.ListArray.from_arrays(pa.array([0, self.n], pa.int32()), x) for x in known]
        yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([-1 - block % parts], pa.int32()), *whole, *[pa.nulls(1, pa.binary())] * 4], BLOCK)
        columns, some = [], np.zeros(parts, dtype=bool)
        for is_word in (True, False):
            own = [x[:2] for x in self.keys if x[2] is is_word]
            key, row = (np.concatenate(x) for x in zip(*own, strict=True)) if own else (np.zeros(0, dtype=U), np.zeros(0, dtype=np.int64))
            order = np.argsort(key, kind="stable")
            key, row = key[order], row[order].astype(np.uint16)
            ends = stretches(key, parts)
            some |= np.diff(ends) > 0
            columns += [cut(key if is_word else six(key), ends), cut(row, ends)]
        at = pa.array(np.flatnonzero(some))
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), block)), at.cast(pa.int32()), *[pa.nulls(len(at), x.type) for x in whole], *[c.take(at) for c in columns]], BLOCK)
        self.__init__()


KNOWN = ["doc_id", "n_tokens", "known", "base", "value"]
KEYS = ["words", "word_rows", "runs", "run_rows"]
BLOCK = ["block", "part", *KNOWN, *KEYS]
FOUND = ["rows", "knowns", "bases", "values"]


def scored(df: DataFrame, doc_id: str = "doc_id", text: str = "text", depth: int = DEPTH) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of df."""
    small_batches(df.sparkSession)
    rows = df.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = 1 + size // PART_BYTES
    tree = Tree(rows.where(~held_out(F.col("doc_id"))).select("text"), parts, depth)
    table = tree.lookups()
    is_usual = (F.col("n") >= tree.frequent(USUAL)) | (F.col("at") == int(BEGIN.view(np.int64))) | (F.col("at") == int(END.view(np.int64)))
    usual = Usual(table.where(is_usual).select("at", "c", "value").toPandas())
    others = table.where(~is_usual).select("at", "c", "value")
    filters = tree.filters
    unknown = float(np.log10(0.5))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, block = Asked(), TaskContext.get().partitionId() << 32
        log_c = np.log10(usual.c + 0.5)
        for batch in batches:
            for a, b, s in chunks(batch.column(1), lower=True):
                w, docs = Words(s), b - a
                if asked.n and asked.full(docs):
                    yield from asked.batches(block, parts)
                    block += 1
                # The start stands only before others: it is looked up as a context, not as a word.
                key, word = w.runs(0), w.place > 0
                i, hit = usual.of(key)
                value = np.bincount(w.doc[hit], usual.value[i[hit]], minlength=docs)
                there, other = hit & word, ~hit & word
                base = np.bincount(w.doc[there], log_c[i[there]], minlength=docs)
                known = np.bincount(w.doc[there], usual.c[i[there]] > 0, minlength=docs).astype(np.int64)
                keys = [(key[other], w.doc[other], True)]
                passed = np.ones(len(key), dtype=bool)
                for d in range(1, depth + 1):
                    at = np.flatnonzero(w.predicted(d) & passed & np.append(False, passed[:-1]) if d > 1 else w.predicted(d))
                    at = at[filters[d - 1](w.runs(d)[at])]
                    passed = np.zeros(len(key), dtype=bool)
                    passed[at] = True
                    run, doc = w.runs(d)[at], w.doc[at]
                    i, hit = usual.of(run)
                    value += np.bincount(doc[hit], usual.value[i[hit]], minlength=docs)
                    keys.append((run[~hit], doc[~hit], False))
                asked.add([batch.column(0)[a:b], *map(pa.array, (np.diff(s.tok_off) + 1, known, base, value))], keys)
        if asked.n:
            yield from asked.batches(block, parts)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The table's rows by range: keys, counts (0: no word) and values as packed numbers."""
        held: list[list[np.ndarray]] = []

        def sent() -> Iterator[pa.RecordBatch]:
            at, c, v = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.argsort(at)
            at, c, v = at[order], c[order], v[order]
            ends = stretches(at, parts)
            some = pa.array(np.flatnonzero(np.diff(ends)))
            yield pa.RecordBatch.from_arrays([some.cast(pa.int32()), *[cut(x, ends).take(some) for x in (at, c, v)]], ["part", "ats", "cs", "vs"])

        size = 0
        for batch in batches:
            if len(batch):
                at, c, v = (batch.column(i).fill_null(0).to_numpy() for i in range(3))
                held.append([at.view(U), c, v])
                size += len(at)
            if size > HELD:
                yield from sent()
                size = 0
        if held:
            yield from sent()

    def looked_up(wanted: pa.Table, found: pa.Table) -> pa.Table:
        """Of each block what its keys of a range say, summed by row; known columns pass through."""
        none = pa.nulls(len(wanted), pa.binary())
        if not len(wanted) or wanted["part"][0].as_py() < 0:
            return pa.table({"block": wanted["block"], **{c: wanted[c] for c in KNOWN}, **{c: none for c in FOUND}})
        at, c, v = summed_by_key(*(joined(found[n])[0].view(k) for n, k in (("ats", U), ("cs", np.int64), ("vs", np.float64))))
        is_known, log_c = np.append(c > 0, False), np.append(np.log10(c + 0.5), 0.0)
        at, v = np.append(at, U(0)), np.append(v, 0.0)
        (words, n_words), (runs, n_runs) = joined(wanted["words"]), joined(wanted["runs"])
        key = np.concatenate([words.view(U), eight(runs)])
        row = np.concatenate([joined(wanted[x])[0].view(np.uint16) for x in ("word_rows", "run_rows")]).astype(np.int64)
        which = np.concatenate([np.repeat(np.arange(len(wanted)), n // k) for n, k in ((n_words, 8), (n_runs, 6))])
        n = int(n_words.sum()) // 8
        # Past the table's last key stands none.
        i = np.searchsorted(at[:-1], key)
        hit = at[i] == key
        hit &= i < len(at) - 1
        word = np.arange(len(key)) < n
        to, of = np.unique(which * BLOCK_ROWS + row, return_inverse=True)
        known = np.bincount(of, hit & word & is_known[i], minlength=len(to)).astype(np.int32)
        base = np.bincount(of[:n], np.where(hit[:n], log_c[i[:n]], unknown), minlength=len(to))
        value = np.bincount(of[hit], v[i[hit]], minlength=len(to))
        ends = np.searchsorted(to, np.arange(len(wanted) + 1) * BLOCK_ROWS)
        sums = [cut(x, ends) for x in ((to % BLOCK_ROWS).astype(np.uint16), known, base, value)]
        return pa.table({"block": wanted["block"], **{c: wanted[c] for c in KNOWN}, **dict(zip(FOUND, sums, strict=True))})

    def summed(block: pa.Table) -> pa.Table:
        is_known = pc.is_valid(block["n_tokens"])
        doc_ids, n_tokens, *known = (block[c].filter(is_known).combine_chunks().flatten() for c in KNOWN)
        at, *found = (joined(block[c].filter(pc.invert(is_known)))[0].view(k) for c, k in zip(FOUND, (np.uint16, np.int32, np.float64, np.float64), strict=True))
        sums = [x.to_numpy() + np.bincount(at, y, minlength=len(x)) for x, y in zip(known, found, strict=True)]
        return pa.table({"doc_id": doc_ids, "n_tokens": n_tokens, "n_known": sums[0].astype(np.int64), "base": sums[1], "value": sums[2]})

    kind = rows.schema["doc_id"].dataType
    kinds = (kind, T.LongType(), T.LongType(), T.DoubleType(), T.DoubleType())
    lists = [T.StructField(n, T.ArrayType(k)) for n, k in zip(KNOWN, kinds, strict=True)]
    block, binary = T.StructField("block", T.LongType()), lambda names: [T.StructField(n, T.BinaryType()) for n in names]
    wanted = rows.select("doc_id", "text").mapInArrow(score, T.StructType([block, T.StructField("part", T.IntegerType()), *lists, *binary(KEYS)]))
    table = others.mapInArrow(pack, "part int, ats binary, cs binary, vs binary")
    found = wanted.groupBy("part").cogroup(table.groupBy("part")).applyInArrow(looked_up, T.StructType([block, *lists, *binary(FOUND)]))
    out = T.StructType([T.StructField(n, k) for n, k in zip(("doc_id", "n_tokens", "n_known", "base", "value"), kinds, strict=True)])
    sums = found.groupBy("block").applyInArrow(summed, out)
    base = F.col("base") - F.col("n_tokens") * tree.log_all
    return sums.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(tree.total).cast("long").alias("train_tokens"), base.alias("base_score"), (base + F.col("value")).alias("score"))


def op10_lm_scoring(spark, sf_dir):
    return scored(read(spark, sf_dir, "documents"))
