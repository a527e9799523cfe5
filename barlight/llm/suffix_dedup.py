"""Suffix-array dedup with sparse suffix arrays: passages of MIN_WORDS words or more that repeat across texts.

Of each text only the suffixes at minimisers are retained: word positions whose KEY-word hash is the least of WINDOW
neighbouring ones, so that the choice depends on the content alone and any passage of WINDOW + KEY - 1 words has one at the
same place in every copy. Suffixes whose first KEY words stand nowhere else are dropped (by a Bloom filter of bounded size
over the keys that repeat). The others are sorted twice, over range partitions: by KEY words, then by hashes of longer
and longer runs to the right (RIGHT words), then to the left (LEFT words); and the other way round. So the neighbours of a
suffix are those that agree with it longest to the right in one array, and longest to the left in the other, also where
thousands of texts share its first KEY words and only few the words around them. Ties go by text and position, so a passage
in a third of all texts is dealt over many tasks. Each suffix is compared with its neighbours of other texts; the rows at the
partitions' ends are compared in a second, small step. A passage is missed only where some texts agree longer to the right and
others longer to the left with each of its minimisers, but none of them for MIN_WORDS words in all (recall is tested on
crowds of texts around a passage, and against brute force on random edits).

Neighbours that agree on KEY words are then extended left and right, word by word, by up to REACH words. A match that neither
ends there nor goes on inside another match of the text is extended again, with twice the reach, until none is left. A text is
joined once as itself and once as neighbour in each round. What a text asks of others is bounded by its own length: each of
its suffixes asks at most four neighbours. What is asked of a text of few words that thousands of others repeat is not, so
the asked positions of a text are dealt over several rows, ASKED at most in each.

Texts that are equal as wholes are one text to the sort, and repeat each other from end to end. Texts are told apart by two
64-bit hashes, and numbered by the first wherever it is unique. Nulls: a null text is empty; rows without doc_id take part.
Repeated rows count as copies of each other. An empty table gives an empty result. Repeats within one text alone do not count.
Words are compared as they are, by 64-bit hashes in the arrays and by 32 bits of them in extensions. Very long texts are scanned whole. Other columns pass through, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlight.llm.exact_dedup import all_positions, bitmaps, filter_bits, flagged
from barlight.llm.tables import deleted, read, released, saved, small_batches
from barlight.llm.textscan import Scan, chunks, mix, powers

MIN_WORDS, KEY, WINDOW = 50, 24, 25
#: Words to the right from a suffix on, and words to its left, by which suffixes of equal keys are sorted: 16 bits of a hash each.
RIGHT, LEFT = (28, 34, 42, 50), (6, 12, 20, 26)
REACH, ASKED = 50, 2000
U = np.uint64


def run_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """At each word: a hash of the k words from there on, of the chunk as a whole (runs that cross a text's end are not used)."""
    n = len(h)
    p, inverse = powers(n + 1)
    sums = np.zeros(n + 1, dtype=U)
    np.cumsum(h * p[:n], out=sums[1:])
    return mix((sums[np.minimum(np.arange(n) + k, n)] - sums[:n]) * inverse[:n])


def minimisers(s: Scan, key: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Word positions that hold the least key of some WINDOW neighbouring ones of their text; in short texts the least of all."""
    n = len(key)
    if not n:
        return np.zeros(0, dtype=np.int64)
    top = U(2**64 - 1)
    value = np.where(whole, mix(key), top)
    least, width = value.copy(), 1
    while width < WINDOW:
        step = min(width, WINDOW - width)
        least[: n - step] = np.minimum(least[: n - step], least[step:])
        width += step
    # A window counts if all its positions are of one text and have a key; a text with fewer positions has one window.
    doc = s.doc_of_words()
    last = s.tok_off[1:][doc] - KEY
    index = np.arange(n)
    full = index + WINDOW - 1 <= last
    chosen = np.zeros(n, dtype=bool)
    best = np.zeros(n, dtype=np.int64)
    for j in range(WINDOW):
        reach = n - j
        hit = full[:reach] & (value[j:] == least[:reach])
        best[:reach][hit] = index[:reach][hit] + j
    chosen[best[full]] = True
    words = np.diff(s.tok_off)
    for i in np.flatnonzero((words >= KEY) & (words < KEY + WINDOW - 1)):
        a, b = s.tok_off[i], s.tok_off[i + 1] - KEY + 1
        chosen[a + int(np.argmin(value[a:b]))] = True
    return np.flatnonzero(chosen & whole)


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, _, s in chunks(batch.column(1)):
            h = s.word_hashes()
            doc = s.doc_of_words()
            left = s.tok_off[1:][doc] - np.arange(len(h))
            key = run_hashes(h, KEY)
            at = minimisers(s, key, left >= KEY)
            ids = np.asarray(batch.column(0))[a:][doc[at]] if len(at) else np.zeros(0, dtype=np.int64)
            pos = at - s.tok_off[:-1][doc[at]]
            right, before = np.zeros(len(at), dtype=U), np.zeros(len(at), dtype=U)
            for k in RIGHT:
                part = np.where(left[at] >= k, run_hashes(h, k)[at] >> U(48), U(0))
                right = (right << U(16)) | part
            for k in LEFT:
                part = np.where(pos >= k, run_hashes(h, k)[np.maximum(at - k, 0)] >> U(48), U(0))
                before = (before << U(16)) | part
            yield pa.RecordBatch.from_arrays([pa.array(key[at].view(np.int64)), pa.array(ids), pa.array(pos.astype(np.int32)), pa.array(right.view(np.int64)), pa.array(before.view(np.int64))], ["key", "id", "pos", "right", "before"])


PAIR = "id long, pos int, other long, other_pos int"


def neighbours_of(key: np.ndarray, ids: np.ndarray, pos: np.ndarray) -> list[np.ndarray]:
    """Of sorted suffixes: those with a neighbour of another text and the same key, on either side, as columns of PAIR."""
    n = len(key)
    index = np.arange(n)
    new = np.ones(n, dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (ids[1:] != ids[:-1])
    start = np.maximum.accumulate(np.where(new, index, 0))
    ends = np.append(np.flatnonzero(new)[1:], n)
    end = ends[np.cumsum(new) - 1]
    out = []
    for at, other in ((index[start > 0], start[start > 0] - 1), (index[end < n], end[end < n])):
        same = key[at] == key[other]
        out.append((at[same], other[same]))
    at, other = (np.concatenate(x) for x in zip(*out, strict=True))
    return [ids[at], pos[at], ids[other], pos[other]]


def matches(suffixes: DataFrame, order: list[str]) -> DataFrame:
    """PAIR rows: suffixes with their neighbours in the array sorted by key and then by order."""
    ordered = suffixes.orderBy("key", *order, "id", "pos").select("key", "id", "pos")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, edge, held = TaskContext.get().partitionId(), True, None
        for batch in batches:
            rows = [np.asarray(batch.column(i)) for i in (0, 1, 2)]
            if not len(rows[0]):
                continue
            if held is not None:
                rows = [np.concatenate([x, y]) for x, y in zip(held, rows, strict=True)]
            if edge:
                yield as_rows([rows[1][:1], rows[2][:1]], rows[0][:1], 2 * part)
                edge = False
            # The last run of one text and the one before it stay for the next batch; pairs made twice are merged later.
            new = np.flatnonzero((rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])) + 1
            yield as_rows(neighbours_of(*rows))
            keep = new[-2] if len(new) > 1 else 0
            held = [x[keep:] for x in rows]
        if held is not None:
            yield as_rows([held[1][-1:], held[2][-1:]], held[0][-1:], 2 * part + 1)

    def as_rows(columns: list[np.ndarray], key: np.ndarray | None = None, edge: int | None = None) -> pa.RecordBatch:
        n = len(columns[0])
        none = lambda kind: pa.nulls(n, kind)
        other = [pa.array(columns[2]), pa.array(columns[3])] if key is None else [none(pa.int64()), none(pa.int32())]
        ends = [none(pa.int64()), none(pa.int64())] if key is None else [pa.array(key), pa.array(np.full(n, edge))]
        return pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1]), *other, *ends], ["id", "pos", "other", "other_pos", "key", "edge"])

    found = saved(ordered.mapInArrow(compare, PAIR + ", key long, edge long"), "neighbours")
    ends = found.where("edge IS NOT NULL")
    # Two rows for each partition of the sort: the last of one and the first of the next that has rows.
    w = Window.partitionBy("key").orderBy("edge")
    ends = ends.select("key", "edge", "id", "pos", F.lead("id").over(w).alias("other"), F.lead("pos").over(w).alias("other_pos")).where("other IS NOT NULL AND other != id")
    both = ends.select("id", "pos", "other", "other_pos").unionByName(ends.select(F.col("other").alias("id"), F.col("other_pos").alias("pos"), F.col("id").alias("other"), F.col("pos").alias("other_pos")))
    return found.where("edge IS NULL").select("id", "pos", "other", "other_pos").unionByName(both)


def short(s: Scan) -> np.ndarray:
    """32 bits of each word's hash: enough to extend matches that already agree on KEY words."""
    return (s.word_hashes() >> U(32)).astype(np.uint32).view(np.int32)


def _contexts(reach: int):
    """For texts with requests: what the asking text needs of them, the word hashes around the position."""

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, s in chunks(batch.column(1)):
                h = short(s)
                for i in range(a, b):
                    words = h[s.tok_off[i - a] : s.tok_off[i - a + 1]]
                    flat = batch.column(2)[i].values
                    at = flat.field("other_pos").to_numpy()
                    left, right = np.minimum(at, reach), np.minimum(len(words) - at, KEY + reach)
                    lists = [words[p - x : p + y] for p, x, y in zip(at, left, right, strict=True)]
                    off = np.append(0, np.cumsum(left + right)).astype(np.int32)
                    n = len(at)
                    yield pa.RecordBatch.from_arrays([flat.field("id"), flat.field("pos"), pa.array(np.full(n, batch.column(0)[i].as_py())), pa.array(at), pa.array(left.astype(np.int32)), pa.array(at > reach), pa.array(len(words) - at > KEY + reach), pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(lists)))], WANT)

    return contexts


WANT = ["id", "pos", "other", "other_pos", "left", "more_left", "more_right", "words"]
WANT_TYPES = "id long, pos int, other long, other_pos int, left int, more_left boolean, more_right boolean, words array<int>"


def joined_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def covered(words: np.ndarray, wants: dict[str, np.ndarray], near: list[np.ndarray]) -> tuple[list[tuple[int, int]], list[tuple[int, int, int]]]:
    """Of a text: the union of its matches of MIN_WORDS words or more, as word ranges; and those that have to be extended
    further: own position, other text, its position. wants: columns of WANT, near: the neighbour's words of each."""
    spans, ends = [], []
    for i, x in enumerate(near):
        p, left = int(wants["pos"][i]), int(wants["left"][i])
        right = x[left:]
        n = min(len(right), len(words) - p)
        off = np.flatnonzero(right[:n] != words[p : p + n])
        to = p + (int(off[0]) if len(off) else n)
        more_right = not len(off) and bool(wants["more_right"][i]) and p + n < len(words)
        m = min(left, p)
        off = np.flatnonzero(x[left - m : left][::-1] != words[p - m : p][::-1])
        of = p - (int(off[0]) if len(off) else m)
        more_left = not len(off) and bool(wants["more_left"][i]) and p > m
        if to - of >= MIN_WORDS:
            spans.append((of, to))
            shift = int(wants["other_pos"][i]) - p
            ends += [(to, to - KEY, int(wants["other"][i]), to - KEY + shift)] * more_right + [(of, of, int(wants["other"][i]), of + shift)] * more_left
    out = joined_spans(spans)
    edges = {x for span in out for x in span}
    return out, sorted({x[1:] for x in ends if x[0] in edges})


def contexts_of(column: pa.ListArray, i: int) -> tuple[dict[str, np.ndarray], list[np.ndarray]]:
    """The wants of row i, their words as views of the column's buffer."""
    flat, off = column.values, column.offsets
    part = slice(off[i].as_py(), off[i + 1].as_py())
    words = flat.field("words")
    at, value = words.offsets.to_numpy(), words.values.to_numpy()
    wants = {c: flat.field(c).slice(part.start, part.stop - part.start).to_numpy(zero_copy_only=False) for c in WANT[1:-1]}
    return wants, [value[at[j] : at[j + 1]] for j in range(part.start, part.stop)]


def _extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans, and rows without first_word that ask for more."""
    for batch in batches:
        for a, b, s in chunks(batch.column(1)):
            h = short(s)
            points = s.code_points()
            rows = []
            for i in range(a, b):
                id_, t, first = batch.column(0)[i].as_py(), s.tok_off[i - a], points[s.off[i - a]]
                spans, further = covered(h[t : s.tok_off[i - a + 1]], *contexts_of(batch.column(2), i))
                rows += [(id_, x, y, int(points[s.start[t + x]] - first), int(points[s.end[t + y - 1]] - first), None, None, None) for x, y in spans]
                rows += [(id_, None, None, None, None, *x) for x in further]
            columns = list(zip(*rows, strict=True)) or [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], SPAN)


SPAN = ["id", "first_word", "end_word", "start", "end", "pos", "other", "other_pos"]


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, s in chunks(batch.column(1)):
            n = np.diff(s.tok_off)
            points = s.code_points()
            some = n > 0
            first, last = s.tok_off[:-1], np.maximum(s.tok_off[1:] - 1, 0)
            start, end = np.zeros(b - a, dtype=np.int64), np.zeros(b - a, dtype=np.int64)
            if some.any():
                start[some] = points[s.start[first[some]]] - points[s.off[:-1][some]]
                end[some] = points[s.end[last[some]]] - points[s.off[:-1][some]]
            yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(n), pa.array(start), pa.array(end)], ["id", "n_words", "start", "end"])


def shared_suffixes(texts: DataFrame) -> DataFrame:
    """The suffixes of texts, but for most of those whose key stands only once: a Bloom filter lets few of them through."""
    suffixes = saved(texts.select("id", "text").mapInArrow(_suffixes, "key long, id long, pos int, right long, before long"), "suffixes")
    keys = saved(suffixes.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("key").alias("digest")), "keys")
    bits = filter_bits(keys.count())
    likely = flagged(suffixes.withColumn("digest", F.col("key")), bitmaps(all_positions(keys, bits)), bits).where("candidate")
    out = saved(likely.select(*suffixes.columns), "shared-suffixes")
    deleted(suffixes, keys)
    return out


def extended(texts: DataFrame, pairs: DataFrame, reach: int) -> DataFrame:
    """pairs: id, pos, other, other_pos. SPAN rows: the spans of texts that they extend to, and what has to be extended further."""
    part = F.pmod(F.xxhash64("id", "pos"), F.col("parts"))
    sizes = pairs.groupBy("other").agg(F.ceil(F.count(F.lit(1)) / ASKED).alias("parts"))
    asked = pairs.join(sizes, "other").groupBy(F.col("other").alias("of"), part.alias("part")).agg(F.collect_list(F.struct("id", "pos", "other_pos")).alias("wants"))
    near = texts.join(asked, texts["id"] == asked["of"]).select("id", "text", "wants").mapInArrow(_contexts(reach), WANT_TYPES)
    own = near.groupBy(F.col("id").alias("of")).agg(F.collect_list(F.struct(*WANT[1:])).alias("wants"))
    return saved(texts.join(own, texts["id"] == own["of"]).select("id", "text", "wants").mapInArrow(_extended, ", ".join(f"{c} long" for c in SPAN)), "extended")


def repeated_spans(texts: DataFrame) -> DataFrame:
    """texts: id (of distinct texts), text. Spans (id, first_word, end_word, start, end) that repeat in other texts; spans of
    different rounds may overlap."""
    suffixes = shared_suffixes(texts)
    both = [matches(suffixes, ["right", "before"]), matches(suffixes, ["before", "right"])]
    pairs = saved(both[0].unionByName(both[1]).distinct(), "matches")
    deleted(suffixes, *both)
    released(texts.sparkSession)
    reach, out = REACH, None
    while True:
        found = extended(texts, pairs, reach)
        released(texts.sparkSession)
        spans = found.where("first_word IS NOT NULL").select(*SPAN[:5])
        out = spans if out is None else out.unionByName(spans)
        pairs = found.where("first_word IS NULL").select("id", F.col("pos").cast("int").alias("pos"), "other", F.col("other_pos").cast("int").alias("other_pos"))
        if pairs.isEmpty():
            return out
        reach *= 2


def distinct_texts(df: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """df as row and the two hashes of its text; and a saved table of the hashes with id and n, how many rows have the text."""
    rows = df.select(F.struct("*").alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(1), "text")})
    sizes = rows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("h1").orderBy("h2"))
    return rows, saved(sizes.select("h1", "h2", "n", F.when(place == 1, F.col("h1")).otherwise(F.col("h2")).alias("id")), "distinct")


def merged_spans(spans):
    """Spans in order with those that overlap or touch as one."""

    def put(out, s):
        last = F.try_element_at(out, F.lit(-1))
        wider = F.struct(last["first_word"].alias("first_word"), F.greatest(last["end_word"], s["end_word"]).alias("end_word"), last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        return F.when(last["end_word"] >= s["first_word"], F.array_append(F.slice(out, F.lit(1), F.size(out) - 1), wider)).otherwise(F.array_append(out, s))

    return F.aggregate(F.sort_array(spans), F.array().cast(SPANS), put)


SPANS = "array<struct<first_word:long,end_word:long,start:long,end:long>>"


def repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """row (all columns of df), n_words, and spans: array of first_word, end_word, start, end (code points of the text)."""
    small_batches(df.sparkSession, 500)
    rows, sizes = distinct_texts(df, text)
    texts = rows.groupBy("h1", "h2").agg(F.first("text").alias("text"))
    texts = saved(texts.join(sizes, ["h1", "h2"]).select("id", "text"), "texts")
    found = repeated_spans(texts).groupBy("id").agg(F.collect_list(F.struct("first_word", "end_word", "start", "end")).alias("spans"))
    whole = texts.mapInArrow(_whole, "id long, n_words long, start long, end long")
    copies = F.array(F.struct(F.lit(0).cast("long").alias("first_word"), F.col("n_words").alias("end_word"), "start", "end"))
    info = whole.join(sizes, "id").join(found, "id", "left").select("h1", "h2", "n_words", F.when((F.col("n") > 1) & (F.col("n_words") >= MIN_WORDS), copies).otherwise(merged_spans(F.coalesce("spans", F.array().cast(SPANS)))).alias("spans"))
    info = saved(info.withColumnsRenamed({"h1": "of1", "h2": "of2"}), "spans")
    return rows.select("row", "h1", "h2").join(info, (F.col("h1") == F.col("of1")) & (F.col("h2") == F.col("of2"))).select("row", "n_words", "spans")


def op4_suffix_dedup(spark, sf_dir):
    out = repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    dup = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end_word"] - s["first_word"])
    return out.select(F.col("row.doc_id").alias("doc_id"), "n_words", F.size("spans").cast("long").alias("n_spans"), dup.alias("dup_words"), F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",").alias("spans"))
