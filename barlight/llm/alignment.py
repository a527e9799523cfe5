"""Aligning the tokens of two tokenizers by their bytes, with a dangling-suffix transducer.

Both tokenizers spell the same bytes. The transducer reads tokens in turn: its state is which side leads and the bytes by which
it does, the residual, always an end of the leading side's last token. It takes the next token of the other side; that token
overlaps the leading one, which is a link, and leaves a residual of either side or none, which closes a group. Steps depend on
residual and token only, so they are kept by (state, token). Texts are cut where both tokenizers always end a token, between a
graphic sign and a space, and between a letter and a stop (see stretches_of); from there on the transducer starts anew, so
what it makes of such a stretch is kept too, up to KEPT of them in a task.

Texts are encoded once: per text the saved table has the counts, the groups' digest and the text's id pairs with their numbers,
packed. Pairs are counted over the corpus from there: summed up in each task, then by a shuffle. To look the counts up again, the most
frequent pairs, USUAL at most, go to every task (24 bytes each); all others are joined by a shuffle of the texts' rarer
pairs. So nothing that grows with the corpus is broadcast and no pair is left out.

Nulls: a null or empty text has no tokens, nor has a text whose tokens do not spell a space and the text (as with U+2581, which one
side reads as a space); their numbers are 0 and the digest is ''. Special tokens' strings inside texts are plain text. Texts are
never cut short; one without breaks is a single stretch, and is not kept. Rows without doc_id and repeated rows are rows of
their own. An empty table gives an empty result. Further columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barlight.llm import pieces
from barlight.llm.process import kept
from barlight.llm.tables import deleted, read, saved

BYTE_MODEL = "/opt/tokenizers/byte_bpe_50k.json"
#: Stretches whose alignment a task keeps, the longest that are kept, and steps of the transducer that are kept.
KEPT, KEPT_CHARS, STEPS = 350_000, 100, 200_000
#: New stretches that are encoded at once; the libraries' results take many times their text.
AT_ONCE = 2_000
#: Pairs that every task gets.
USUAL = 500_000
#: Bytes of text that are worked on at once.
CHUNK = 4 << 20
#: A space after a graphic sign: no token of either tokenizer goes across.
GRAPHIC = "[!-~À-ᙿ]"
#: A stop after a letter: a place to cut if neither vocabulary has an entry with both, which is checked.
LETTER, STOP = "[A-Za-zÀ-ÖØ-öø-ɏ]", "[.,;:!?]"


def kinds_of_signs(stops: bool) -> np.ndarray:
    """By code point, up to the first beyond all of the above: 1 graphic, 2 space, 4 letter and 8 stop (if they count), added up."""
    signs = list(map(chr, range(0x1681)))
    kinds = ((GRAPHIC, 1), (" ", 2), *(((LETTER, 4), (STOP, 8)) if stops else ()))
    return np.array([sum(n for pattern, n in kinds if re.match(pattern, c)) for c in signs], np.uint8)


def stretches_of(text: str, kinds: np.ndarray) -> list[str]:
    """A text, cut before spaces that follow a graphic sign and before stops that follow a letter."""
    kind = kinds[np.minimum(np.frombuffer(text.encode("utf-32-le"), np.uint32), len(kinds) - 1)]
    left, right = kind[:-1], kind[1:] >> 1
    at = (np.flatnonzero(left & right & 5) + 1).tolist()
    return [text[i:j] for i, j in zip([0, *at], [*at, len(text)], strict=True)]


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable bytes for themselves, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Transducer:
    """Reads the tokens of both sides; spelled has the bytes of each token, by side."""

    def __init__(self, spelled: tuple[list[bytes], list[bytes]]):
        self.spelled = spelled
        self.wide = max(map(len, spelled))
        self.clear()

    def clear(self) -> None:
        self.states: list[tuple[int, bytes]] = [(0, b"")]
        self.known: dict[tuple[int, bytes], int] = {(0, b""): 0}
        #: The side that each state reads next, and the state after a token, by state times wide plus token.
        self.reads: list[int] = [0]
        self.steps: dict[int, int] = {}

    def _state(self, side: int, residual: bytes) -> int:
        state = (side, residual) if residual else (0, b"")
        if state not in self.known:
            self.known[state] = len(self.states)
            self.states.append(state)
            self.reads.append(1 - side)
        return self.known[state]

    def step(self, state: int, token: int) -> int:
        """The state after the next token: of the first side without a residual, else of the side that lags."""
        side, residual = self.states[state]
        if not residual:
            to = self._state(0, self.spelled[0][token])
        else:
            found = self.spelled[1 - side][token]
            short = min(len(found), len(residual))
            if found[:short] != residual[:short]:
                raise ValueError(f"tokens differ at {residual!r} and {found!r}")
            to = self._state(side, residual[short:]) if short < len(residual) else self._state(1 - side, found[short:])
        self.steps[state * self.wide + token] = to
        return to

    def run(self, a: list[int], b: list[int]) -> tuple[list[tuple[int, int]], str, int]:
        """Of tokens that spell the same bytes: the links as pairs of ids, the groups as text, and their number."""
        if len(self.steps) > STEPS:
            self.clear()
        steps, reads, wide = self.steps, self.reads, self.wide
        links, groups, state, i, j, first_a, first_b, n_a, n_b = [], [], 0, 0, 0, 0, 0, len(a), len(b)
        while i < n_a or j < n_b:
            if state == 0:
                token = a[i]
                i += 1
            elif reads[state]:
                token = b[j]
                j += 1
                links.append((a[i - 1], token))
            else:
                token = a[i]
                i += 1
                links.append((token, b[j - 1]))
            to = steps.get(state * wide + token)
            state = self.step(state, token) if to is None else to
            if state == 0:
                groups.append(f"{','.join(map(str, a[first_a:i]))}|{','.join(map(str, b[first_b:j]))}")
                first_a, first_b = i, j
        return links, ";".join(groups), len(groups)


class Aligner:
    """Encodes and aligns texts; a and b are the bytes of the two tokenizers' files."""

    def __init__(self, a: bytes, b: bytes):
        from tokenizers import Tokenizer, normalizers

        self.a = Tokenizer.from_str(a.decode())
        self.a.encode_special_tokens = True
        self.b = pieces.backend(b)
        model, letters = pieces.parsed(b), byte_letters()
        if model.charsmap or model.squeeze or not model.dummy_prefix or not self.b.pre_tokenizer:
            raise ValueError("the second tokenizer must keep texts as they are, put a space before them and encode words one by one")
        # Stretches have their leading space already.
        self.b.normalizer = normalizers.Sequence([normalizers.Replace(" ", pieces.MARKER)])
        words = self.a.get_vocab(with_added_tokens=True)
        spelled = [b""] * (max(words.values()) + 1)
        for word, i in words.items():
            spelled[i] = bytes(letters[c] for c in word) if all(c in letters for c in word) else word.encode()
        of_b = [bytes([int(p[3:5], 16)]) if t == pieces.BYTE else p.replace(pieces.MARKER, " ").encode() for p, t in zip(model.pieces, model.types, strict=True)]
        self.spelled, self.wide = (spelled, of_b), len(of_b)
        self.transducer = Transducer(self.spelled)
        self.kinds = kinds_of_signs(not any(re.search(LETTER + STOP, x.decode(errors="replace")) for x in chain(*self.spelled)))
        self.clear()

    def clear(self) -> None:
        """Forgets all stretches. What is known of stretch k: its row of numbers, its part of pairs, its groups."""
        self.known: dict[str, int] = {}
        self.numbers = np.zeros((0, 5), np.int64)
        self.pairs: list[bytes] = []
        self.groups: list[str] = []
        self.hits = np.zeros(0, np.int64)

    def forget(self) -> None:
        """Keeps the half of the stretches that came up most often."""
        usual = np.sort(np.argsort(-self.hits, kind="stable")[: KEPT // 2])
        places = np.full(len(self.numbers), -1, np.int64)
        places[usual] = np.arange(len(usual))
        self.known = {s: int(places[k]) for s, k in self.known.items() if places[k] >= 0}
        self.pairs, self.groups = [self.pairs[k] for k in usual], [self.groups[k] for k in usual]
        self.numbers, self.hits = self.numbers[usual], self.hits[usual] // 2

    def learn(self, stretches: list[str]) -> None:
        """Encodes and aligns stretches that are not known yet."""
        of_a = self.a.encode_batch_fast(stretches, add_special_tokens=False)
        of_b = self.b.encode_batch_fast(stretches, add_special_tokens=False)
        numbers, wide, spelled = [], self.wide, self.spelled[1].__getitem__
        for stretch, x, y in zip(stretches, of_a, of_b, strict=True):
            a, b, links, groups, n = x.ids, y.ids, [], "", 0
            # The transducer compares the first side's bytes with the second's as it goes.
            good = b"".join(map(spelled, b)) == stretch.encode()
            try:
                links, groups, n = self.transducer.run(a, b) if good else (links, groups, n)
            except (ValueError, IndexError):
                good = False
            self.known[stretch] = len(self.numbers) + len(numbers)
            numbers.append((len(a), len(b), n, len(links), good))
            self.pairs.append(array("q", [i * wide + j for i, j in links]).tobytes())
            self.groups.append(groups)
        self.numbers = np.concatenate([self.numbers, np.array(numbers, np.int64).reshape(-1, 5)])
        self.hits = np.concatenate([self.hits, np.zeros(len(numbers), np.int64)])

    def align(self, texts: list[str]) -> list[tuple[int, int, int, int, str, bytes, bytes]]:
        """Of each text: tokens of both sides, groups, links, the groups' digest, its id pairs in order and their numbers, packed."""
        if len(self.numbers) > KEPT:
            self.forget()
        cut = [stretches_of(" " + x, self.kinds) if x else [] for x in texts]
        new = list(set(chain.from_iterable(cut)) - self.known.keys())
        for k in range(0, len(new), AT_ONCE):
            self.learn(new[k : k + AT_ONCE])
        out = []
        for x in cut:
            places = list(map(self.known.__getitem__, x))
            at = np.array(places, np.int64)
            sums = self.numbers[at].sum(axis=0)
            np.add.at(self.hits, at, 1)
            if not len(at) or sums[4] < len(at):
                out.append((0, 0, 0, 0, "", b"", b""))
                continue
            digest = hashlib.sha256(";".join(map(self.groups.__getitem__, places)).encode()).hexdigest()
            pair, n = np.unique(np.frombuffer(b"".join(map(self.pairs.__getitem__, places)), np.int64), return_counts=True)
            out.append((*map(int, sums[:4]), digest, pair.astype(np.uint32 if self.narrow else np.int64).tobytes(), n.astype(np.int32).tobytes()))
        for s in new:
            if len(s) > KEPT_CHARS:
                k = self.known.pop(s)
                self.pairs[k], self.groups[k], self.hits[k] = b"", "", 0
        return out

    @property
    def narrow(self) -> bool:
        """Whether pairs fit into 32 bits."""
        return len(self.spelled[0]) * self.wide < 1 << 32


def batches_of(texts: pa.Array) -> Iterator[list[str]]:
    """Texts (null: empty) in lists of about CHUNK bytes."""
    part, size = [], 0
    for x in texts:
        part.append(x.as_py() or "")
        size += len(part[-1])
        if size > CHUNK:
            yield part
            part, size = [], 0
    if part:
        yield part


NUMBERS = ["n_a", "n_b", "n_groups", "n_links"]
ALIGNED = ", ".join(["row long", "doc_id {}", *[f"{c} long" for c in NUMBERS], "groups_sha256 string", "pairs binary", "numbers binary"])


def aligned(df: DataFrame, a: bytes, b: bytes, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """row (a number), doc_id, n_a, n_b, n_groups, n_links, groups_sha256, and pairs (sorted, id of a times the size of b plus id of b)
    and numbers, packed; a saved table."""
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = T.StructType.fromDDL(ALIGNED.format(rows.schema["doc_id"].dataType.simpleString()))
    types = [pa.int64()] * 4 + [pa.string(), pa.binary(), pa.binary()]

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = kept(("aligner", a, b), lambda: Aligner(a, b))
        for batch in batches:
            at = 0
            for part in batches_of(batch.column(2)):
                found = list(zip(*aligner.align(part), strict=True))
                head = batch.slice(at, len(part))
                yield pa.RecordBatch.from_arrays([head.column(0), head.column(1), *[pa.array(x, t) for x, t in zip(found, types, strict=True)]], schema.names)
                at += len(part)

    return saved(rows.mapInArrow(align, schema), "aligned")


def _unpacked(pairs: pa.Array, numbers: pa.Array, narrow: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs and numbers of a batch laid end to end, and how many each row has."""
    p, n = ([x.as_py() or b"" for x in c] for c in (pairs, numbers))
    each = np.array([len(x) // 4 for x in n], np.int64)
    return np.frombuffer(b"".join(p), np.uint32 if narrow else np.int64).astype(np.int64), np.frombuffer(b"".join(n), np.int32).astype(np.int64), each


def pair_counts(table: DataFrame, wide: int, narrow: bool) -> DataFrame:
    """pair, n and best (whether no pair with its id of b has more) of all pairs, as a saved table. Tasks sum up what they can hold."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0

        def summed() -> tuple[np.ndarray, np.ndarray]:
            found, at = np.unique(np.concatenate([x for x, _ in waiting]), return_inverse=True)
            return found, np.bincount(at, np.concatenate([n for _, n in waiting]), len(found)).astype(np.int64)

        for batch in batches:
            pair, n, _ = _unpacked(batch.column(0), batch.column(1), narrow)
            waiting.append((pair, n))
            held += len(pair)
            if held > 2 * USUAL:
                waiting = [summed()]
                held = len(waiting[0][0])
                if held > USUAL:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in waiting[0]], ["pair", "n"])
                    waiting, held = [], 0
        if waiting:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in summed()], ["pair", "n"])

    counted = saved(table.select("pairs", "numbers").mapInArrow(partial, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "pair-counts")
    other = (F.col("pair") % wide).alias("b")
    # A row for each id of b at most.
    most = counted.groupBy(other).agg(F.max("n").alias("most"))
    out = saved(counted.withColumn("b", F.col("pair") % wide).join(F.broadcast(most), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pairs")
    deleted(counted)
    return out


def usual(pairs: DataFrame, most: int = USUAL) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Pair, n and best of all pairs with at least some number of links, `most` pairs at most, by pair; and that number."""
    bits = sorted(((r.k, r.c) for r in pairs.groupBy(F.length(F.bin("n")).alias("k")).agg(F.count(F.lit(1)).alias("c")).collect()), reverse=True)
    least, total = 1 << 62, 0
    for k, c in bits:
        if total + c > most:
            break
        least, total = 1 << (k - 1), total + c
    else:
        least = 0
    found = pairs.where(F.col("n") >= least).toArrow()
    pair, n, best = (found.column(c).to_numpy() for c in ("pair", "n", "best"))
    order = np.argsort(pair)
    return pair[order], n[order], best[order].astype(bool), least


def scored(table: DataFrame, pairs: DataFrame, narrow: bool, most: int = USUAL) -> DataFrame:
    """The rows of table with n_best and count_sum."""
    pair, n, best, least = usual(pairs, most)
    sent = table.sparkSession.sparkContext.broadcast((pair, n, best))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, count, top = sent.value
        for batch in batches:
            p, m, each = _unpacked(batch.column(1), batch.column(2), narrow)
            doc = np.repeat(np.arange(len(each)), each)
            at = np.minimum(np.searchsorted(known, p), max(0, len(known) - 1))
            hit = known[at] == p if len(known) else np.zeros(len(p), bool)
            good, where = m[hit], at[hit]
            sums, bests = np.zeros(len(each), np.int64), np.zeros(len(each), np.int64)
            np.add.at(sums, doc[hit], good * count[where])
            np.add.at(bests, doc[hit], good * top[where])
            off = np.append(0, np.cumsum(np.bincount(doc[~hit], minlength=len(each)))).astype(np.int32)
            rest = [pa.ListArray.from_arrays(pa.array(off), pa.array(x[~hit])) for x in (p, m)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bests), pa.array(sums), *rest], ["row", "n_best", "count_sum", "pair", "m"])

    part = table.select("row", "pairs", "numbers").mapInArrow(look_up, "row long, n_best long, count_sum long, pair array<long>, m array<long>")
    part = saved(part, "looked-up")
    rest = part.select("row", F.inline(F.arrays_zip("pair", "m"))).join(pairs.where(F.col("n") < least), "pair")
    rest = rest.select("row", F.when(F.col("best"), F.col("m")).otherwise(0).alias("n_best"), (F.col("m") * F.col("n")).alias("count_sum"))
    both = part.select("row", "n_best", "count_sum").unionByName(rest).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return table.drop("pairs", "numbers").join(both, "row")


def file_bytes(path: str) -> bytes:
    try:
        with open(path, "rb") as f:
            return f.read()
    except OSError as e:
        raise FileNotFoundError(f"no tokenizer at {path}; name one that the driver can read") from e


def cross_aligned(df: DataFrame, a: bytes, b: bytes, doc_id: str = "doc_id", text: str = "text", most: int = USUAL) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each row of df."""
    aligner = Aligner(a, b)
    table = aligned(df, a, b, doc_id, text)
    pairs = pair_counts(table, aligner.wide, aligner.narrow)
    return scored(table, pairs, aligner.narrow, most).select("doc_id", *NUMBERS, "n_best", "count_sum", "groups_sha256")


def op11_cross_alignment(spark, sf_dir, a: str = BYTE_MODEL, b: str = pieces.MODEL):
    return cross_aligned(read(spark, sf_dir, "documents"), file_bytes(a), file_bytes(b))
