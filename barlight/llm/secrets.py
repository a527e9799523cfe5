"""Secret scans: fixed patterns, and strings that a pair of character Markov models finds random.

Two second-order Markov models over characters, one of random strings and one of ordinary identifiers, are trained from
labelled samples: random strings drawn by a seeded rule over usual alphabets, identifiers built by rule from common
programming words, platform names, versions and dates, and as further ordinary samples the words that two or more documents
labelled as good hold, also in capitals (at most SAMPLE_DOCS documents, in the order of a hash of doc_id). Every candidate (CANDIDATE) of a text is scored: it becomes
a span of kind model if its log-likelihood ratio a character is over a threshold, and where that of the whole is not, so does
each of its parts between - _ and / that has MIN_SIGNS or more (a token with a readable prefix). The threshold leaves MAX_FALSE of the
held-out ordinary candidates above it, whole or in part, and is at least 0. Of a candidate that touches a span of the fixed patterns the rest is scored,
where MIN_SIGNS or more are left. Strings of the form of a UUID are identifiers, not secrets.

Spans are code points of the whole text, end exclusive. Nulls: a null text is empty; labels without doc_id are ignored, of
several labels of a document the worst counts. Very long texts are scanned whole. Repeated rows get equal results; an empty
table gives an empty one. Other columns pass through, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barlight.llm.tables import read, small_batches

KINDS = ["assign", "access", "hex", "model"]
ASSIGN = re.compile(r"""(?ia:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
#: Equal to AKIA[A-Z0-9]+ and [0-9a-f]+ with matches below 18 and 16 characters dropped, as runs are matched whole.
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
MIN_SIGNS = 12
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{MIN_SIGNS},}}")
PART = re.compile(rf"[A-Za-z0-9+=]{{{MIN_SIGNS},}}")
UUID = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")

SAMPLE_DOCS, SAMPLE_STRINGS = 2000, 8000
MAX_FALSE = 0.0005
SIGNS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
N = len(SIGNS) + 1

#: Common programming words that ordinary identifiers are built from.
WORDS = "get set add remove update delete create find list map filter reduce index count size length name value key type node edge tree graph table column row field record user account order item price total number string array object class method function file path read write open close stream buffer queue stack cache store load save parse format render request response server client session token config option default error message event handler callback thread process task worker job batch window state context model view controller test case data time date start end first last next previous min max sum mean version release build deploy docker python java script module package import export main utils helper manager factory service provider adapter wrapper base abstract interface sha md5 utf8 base64 http2 ipv4 x86 win32 log4j oauth2 s3 ec2 v1 v2 2019 2020 2021 2022 2023 2024".split()
#: Ordinary words of other languages, so that long compounds don't look random.
OTHERS = "zeit arbeit leben mensch kinder stadt strasse wasser schule sprache wissenschaft gesellschaft verbindung entwicklung regierung geschichte zusammenarbeit freundschaft krankenhaus versicherung rechnung bestellung fahrzeug flugzeug bahnhof wirtschaft umgebung schwierigkeit temps travail enfant ville monde gouvernement histoire environnement développement entreprise connaissance aujourd toujours beaucoup quelques heureusement trabajo tiempo mundo ciudad gobierno historia desarrollo conocimiento empresa siempre muchos pequeño ejemplo importante international communication organization understanding responsibility environment government knowledge establishment characteristic neighbourhood straightforward".split()
#: Parts of platform names.
MACHINES, SYSTEMS = "x86_64 i686 aarch64 arm64 armv7l riscv64 ppc64le s390x wasm32".split(), "unknown-linux-gnu unknown-linux-musl pc-windows-msvc apple-darwin manylinux2014 manylinux_2_17 musllinux_1_1 macosx_11_0 win_amd64 linux-android unknown-freebsd none-eabi".split()


def random_strings(n: int, seed: int) -> list[str]:
    rng = np.random.default_rng(seed)
    alphabets = ["0123456789abcdef", "0123456789ABCDEF", SIGNS[:62], SIGNS[:62] + "+/", SIGNS[:62] + "_-", SIGNS[26:62], "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"]
    return ["".join(rng.choice(list(alphabets[i % len(alphabets)]), rng.integers(MIN_SIGNS, 65))) for i in range(n)]


def identifiers(n: int, seed: int) -> list[str]:
    rng = np.random.default_rng(seed)
    pick = lambda words: str(rng.choice(words))
    number = lambda digits=4: str(rng.integers(0, 10 ** int(rng.integers(1, digits + 1))))
    joins = [lambda w: "_".join(w), lambda w: "-".join(w), lambda w: "/".join(w), lambda w: w[0] + "".join(x.title() for x in w[1:]), lambda w: "".join(x.title() for x in w), lambda w: "_".join(w).upper(), lambda w: "".join(w)]
    kinds = [
        lambda w: w,
        lambda w: [*w, number()],
        lambda w: [pick(MACHINES), pick(SYSTEMS)],
        lambda w: [w[0], *(number(2) for _ in range(3)), f"cp3{rng.integers(8, 14)}", pick(SYSTEMS), pick(MACHINES)],
        lambda w: [*w[:2], *(number(2) for _ in range(3))],
        lambda w: [f"{rng.integers(1990, 2040)}", f"{rng.integers(1, 13):02d}", f"{rng.integers(1, 29):02d}", *w[:1]],
        lambda w: [f"{rng.integers(10**11, 10**14)}"],
        lambda w: [str(rng.choice(list("=-_+/"))) * int(rng.integers(MIN_SIGNS, 80))],
        lambda w: ["".join(str(x) for x in rng.choice(OTHERS, rng.integers(1, 4)))],
        lambda w: ["".join(str(x) for x in rng.choice(OTHERS, rng.integers(1, 4))).title()],
    ]
    out = []
    for i in range(n):
        w = [str(x) for x in rng.choice(WORDS, rng.integers(3, 7))]
        of = kinds[(i // 3) % len(kinds)] if i % 3 == 0 else kinds[i % 3 - 1]
        out.append((joins[i % len(joins)] if of in kinds[:2] else joins[i % 2])(of(w)))
    return out


def labelled_samples(spark: SparkSession, docs: DataFrame | None = None, labels: DataFrame | None = None) -> DataFrame:
    """text, random, held_out: bounded labelled samples."""
    made = [(x, True, i % 4 == 0) for i, x in enumerate(random_strings(SAMPLE_STRINGS, 3))] + [(x, False, i % 4 == 0) for i, x in enumerate(identifiers(SAMPLE_STRINGS, 5))]
    out = spark.createDataFrame(made, "text string, random boolean, held_out boolean")
    if docs is not None and labels is not None:
        good = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("of")).agg(F.min("quality").alias("q")).where("q = 1").orderBy(F.xxhash64("of"), "of").limit(SAMPLE_DOCS)
        words = docs.join(F.broadcast(good), docs["doc_id"] == good["of"]).select("of", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z_-]{5,}"), F.lit(0)))).alias("text"))
        # A word of one document alone may be a piece of a secret.
        words = words.groupBy("text").agg(F.count_distinct("of").alias("n")).where("n > 1")
        # Shouted words are as ordinary as others.
        words = words.select(F.explode(F.array("text", F.upper("text"))).alias("text"))
        out = out.unionByName(words.select("text", F.lit(False).alias("random"), (F.pmod(F.xxhash64("text"), F.lit(4)) == 0).alias("held_out")))
    return out


#: By code point of the SIGNS' range: the code of a sign, 0 for others.
TABLE = np.zeros(128, dtype=np.int64)
TABLE[[ord(c) for c in SIGNS]] = range(1, N)


def _codes(x: str) -> np.ndarray:
    """The codes of a string with two ends before and one after; signs other than SIGNS count as ends."""
    out = np.zeros(len(x) + 3, dtype=np.int64)
    signs = np.frombuffer(x.encode("ascii", "replace"), dtype=np.uint8)
    out[2:-1] = TABLE[signs & 127]
    return out


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for kind, part in pdf.groupby("random"):
            c = np.zeros(0, dtype=np.int64)
            runs = [_codes(x) for x in part["text"]]
            if runs:
                c = np.concatenate([(a[:-2] * N + a[1:-1]) * N + a[2:] for a in runs])
            at, n = np.unique(c, return_counts=True)
            yield pd.DataFrame({"random": kind, "at": at, "n": n})


def fitted(samples: DataFrame) -> tuple[np.ndarray, float]:
    """The log-likelihood ratio of each run of three signs (N ** 3 of them, which bounds what is collected), and the threshold."""
    small_batches(samples.sparkSession, 10_000)
    rows = samples.where("not held_out").select("text", "random").mapInPandas(_counted, "random boolean, at long, n long").groupBy("random", "at").agg(F.sum("n").alias("n")).collect()
    count = np.zeros((2, N * N, N))
    for r in rows:
        count[int(r.random), r.at // N, r.at % N] += r.n
    logs = []
    for c in count:
        one = c.reshape(N, N, N).sum(axis=0)
        p0 = (one.sum(axis=0) + 0.5) / (one.sum() + 0.5 * N)
        p1 = (one + 4 * p0) / (one.sum(axis=1, keepdims=True) + 4)
        p2 = (c + 4 * np.tile(p1, (N, 1))) / (c.sum(axis=1, keepdims=True) + 4)
        logs.append(np.log(p2))
    ratio = (logs[1] - logs[0]).reshape(-1).astype(np.float64)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"score": [max(ratio_of(ratio, x[a:b]) for a, b in parts_of(x)) for x in pdf["text"]]})

    held = samples.where(F.col("held_out") & ~F.col("random") & (F.length("text") >= MIN_SIGNS)).select("text").mapInPandas(score, "score double")
    top = held.agg(F.percentile_approx("score", 1 - MAX_FALSE, 100_000)).first()[0]
    return ratio, max(0.0, top if top is not None else 0.0)


def ratio_of(ratio: np.ndarray, x: str) -> float:
    """Log-likelihood ratio a character, the end included."""
    a = _codes(x)
    return float(ratio[(a[:-2] * N + a[1:-1]) * N + a[2:]].mean())


def parts_of(x: str) -> list[tuple[int, int]]:
    """A string as a whole, and its parts between separators that are long enough."""
    found = [m.span() for m in PART.finditer(x)]
    return [(0, len(x)), *(p for p in found if p != (0, len(x)))]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """start, kind, end of the fixed patterns' matches, in order."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def outside(start: int, end: int, spans: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """The parts of start..end that no span touches."""
    for a, _, b in spans:
        if a < end and start < b:
            if start < a:
                yield start, a
            start = max(start, b)
    if start < end:
        yield start, end


def model_spans(text: str, base: list[tuple[int, int, int]], ratio: np.ndarray, threshold: float) -> list[tuple[int, int, int]]:
    whole = [(a, b) for m in CANDIDATE.finditer(text) if not UUID.fullmatch(m[0]) for a, b in outside(m.start(), m.end(), base) if b - a >= MIN_SIGNS]
    if not whole:
        return []
    # Each candidate, then its parts; all strings of a text at once: runs of three signs, summed by string.
    found = [(a, b, k) for k, (start, end) in enumerate(whole) for a, b in ((start + p, start + q) for p, q in parts_of(text[start:end]))]
    codes = np.concatenate([_codes(text[a:b]) for a, b, _ in found])
    size = np.array([b - a + 3 for a, b, _ in found])
    end = np.cumsum(size)
    value = np.append(ratio[(codes[:-2] * N + codes[1:-1]) * N + codes[2:]], [0.0, 0.0])
    value[np.concatenate([end - 2, end - 1])] = 0
    mean = np.add.reduceat(value, end - size) / (size - 2)
    over = {(a, b, k) for (a, b, k), x in zip(found, mean, strict=True) if x > threshold}
    taken = {k for a, b, k in over if (a, b) == whole[k]}
    return sorted((a, 3, b) for a, b, k in over if (a, b) == whole[k] or k not in taken)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scanned(df: DataFrame, ratio: np.ndarray, threshold: float, text: str = "text") -> DataFrame:
    """row (all columns of df), base and all_spans: arrays of kind, start, end. Only the text goes to Python."""
    small_batches(df.sparkSession)
    span = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    rows = df.select(F.struct("*").alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    @F.pandas_udf(T.StructType([T.StructField("base", span), T.StructField("spans", span)]))
    def scan(texts: pd.Series) -> pd.DataFrame:
        base, every = [], []
        named = lambda spans: [{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans]
        for x in texts:
            found = base_spans(x)
            base.append(named(found))
            every.append(named(sorted(found + model_spans(x, found, ratio, threshold))))
        return pd.DataFrame({"base": base, "spans": every})

    return rows.select("row", scan("text").alias("found")).select("row", "found.base", "found.spans")


def _joined(spans: str):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op2_secret_scans(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    ratio, threshold = fitted(labelled_samples(spark, docs, read(spark, sf_dir, "labels")))
    out = scanned(docs, ratio, threshold)
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select(F.col("row.doc_id").alias("doc_id"), n("assign"), n("access"), n("hex"), F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"))
