"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch keeps every shingle hash below a fixed fraction of the hash range, so
its size follows the document's, sketches of parts merge by union, and the
share of one sketch found in another estimates containment even between very
unequal documents.  A short text (at most SHORT shingles) is sketched with fraction 1,
that is in full; two sketches are compared, and merged, at the smaller of their
thresholds, so a hash that the other sketch would have dropped is never held
against it.  A short text without a hash below a longer one's threshold has no containment
estimate (NaN, null in tables).  A sketch in full is known by a hash at or above the threshold.  The
string form is the sorted hashes as 16 hexadecimal digits each.

Defined results: a null or empty text has the empty sketch, which is like
another empty one (1) and unlike any other (0); texts of fewer words than a
shingle hash their whole word sequence; rows of equal id follow one another in
text order; null ids come last; a table of one row has itself as next."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FRACTION = 1 / 8
SHINGLE = 5
SHORT = 64  # shingles of a text that is sketched in full
SEED = 42
RANGE_BYTES = 32 << 20  # text bytes of an id range
MAX_RANGES = 8192  # ranges are streamed, so larger ones only mean longer tasks

_MULT = np.uint64(0x9E3779B97F4A7C15)  # fixed value: 2^64 / golden ratio


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)  # fixed values: finaliser of splitmix64
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Hash of each word shingle, repeats included: word hashes combined in order."""
    x = xxhash.xxh64_intdigest
    w = np.array([x(b, SEED) for b in (text or "").encode("utf-8", "surrogatepass").split()], dtype=np.uint64)
    if not len(w):
        return w
    k = min(shingle, len(w))
    n = len(w) - k + 1
    h = np.full(n, k, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            h = _mix(h * _MULT + w[j : j + n])
    return h


def _threshold(fraction: float) -> np.uint64:
    return np.uint64(min(int(fraction * 2.0**64), 2**64 - 1))


def sketch(text: str | None, fraction: float = FRACTION, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingle hashes below the threshold; all of them if the text has at most
    SHORT shingles, or none below the threshold."""
    h = shingle_hashes(text, shingle)
    low = h[h < _threshold(fraction)] if len(h) > SHORT else h
    return np.unique(low if len(low) else h)


def whole(s: np.ndarray, fraction: float = FRACTION) -> bool:
    """Whether a sketch holds all hashes of its text: it has one that a threshold would have dropped."""
    return len(s) > 0 and s[-1] >= _threshold(fraction)


def _common(a: np.ndarray, b: np.ndarray, fraction: float) -> tuple[np.ndarray, np.ndarray]:
    """Both sketches at the smaller of their thresholds."""
    if whole(a, fraction) and whole(b, fraction):
        return a, b
    return a[a < _threshold(fraction)], b[b < _threshold(fraction)]


def merge(a: np.ndarray, b: np.ndarray, fraction: float = FRACTION) -> np.ndarray:
    """Sketch of the union of two documents' shingles."""
    if not len(a) or not len(b):
        return a if len(a) else b
    u = np.union1d(*_common(a, b, fraction))
    return u if len(u) else np.union1d(a, b)


def text_form(s: np.ndarray) -> str:
    return s.astype(">u8").tobytes().hex()


def parse(s: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(s), dtype=">u8").astype(np.uint64)


def likeness(a: np.ndarray, b: np.ndarray, fraction: float = FRACTION) -> float:
    """Estimated share of common shingles among those of either (Jaccard); exact for two short texts."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    a, b = _common(a, b, fraction)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def containment(a: np.ndarray, b: np.ndarray, fraction: float = FRACTION) -> float:
    """Estimated share of a's shingles that b has; NaN if a short text has none below the
    threshold of a longer one."""
    if not len(a):
        return 1.0
    a, b = _common(a, b, fraction) if len(b) else (a, b)
    return len(np.intersect1d(a, b, assume_unique=True)) / len(a) if len(a) else math.nan


def fingerprint_column(text, fraction: float = FRACTION, shingle: int = SHINGLE):
    """String fingerprint of a text column."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([text_form(sketch(t, fraction, shingle)) for t in s], dtype=object)

    return run(text)


def _ranges(ids: DataFrame, n: int) -> list:
    """At most n - 1 increasing bounds that cut the ids into ranges of nearly equal counts."""
    if n <= 1:
        return []
    q = ids.agg(F.percentile_approx("id", [i / n for i in range(1, n)], 20 * n).alias("q")).first()["q"]
    return sorted(set(q or []))


def with_next(docs: DataFrame, id_col: str = "doc_id", text: str = "text", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Rows (part, border, id, text) dealt into ranges of ascending id, one task
    each, sorted: every range is followed by a copy of the rows that begin the
    next one (border = true), the last range by those of the first.  Texts cross
    the network once."""
    slim = docs.select(docs[id_col].cast("long").alias("id"), docs[text].alias("text"))
    total = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bounds = np.array(_ranges(slim.select("id"), min(MAX_RANGES, max(1, math.ceil(total / range_bytes)))), dtype=np.int64)
    last = len(bounds)

    @F.pandas_udf("int")
    def part_of(s: pd.Series) -> pd.Series:  # nulls last
        v = pd.array(s, dtype="Int64")
        p = np.searchsorted(bounds, v.fillna(0).to_numpy(np.int64), side="right")
        return pd.Series(np.where(v.isna(), last, p), dtype="int32")

    heads = sorted(
        (r["part"], r["id"]) for r in slim.select("id", part_of("id").alias("part")).groupBy("part").agg(F.min("id").alias("id")).collect()
    )  # at most one row for each range
    before = {heads[i][1]: heads[i - 1][0] for i in range(len(heads))}  # the range that a head also closes

    @F.pandas_udf("array<int>")
    def parts_of(s: pd.Series) -> pd.Series:
        v = [None if pd.isna(x) else int(x) for x in s]
        own = [last if x is None else int(np.searchsorted(bounds, x, side="right")) for x in v]
        return pd.Series([[p, before[x]] if x in before and (x is not None or None in before) else [p] for x, p in zip(v, own)])

    dealt = slim.select("id", "text", F.posexplode(parts_of("id")).alias("copy", "part"))
    dealt = dealt.select("part", (F.col("copy") > 0).alias("border"), "id", "text")
    return dealt.repartitionById(last + 1, F.col("part")).sortWithinPartitions("part", "border", F.col("id").asc_nulls_last(), F.col("text").asc_nulls_first())


def edit_probe(docs: DataFrame, id_col: str = "doc_id", text: str = "text", fraction: float = FRACTION, shingle: int = SHINGLE) -> DataFrame:
    """Each document's sketch against that of its edited text (its last half
    replaced by as much of the beginning of the next document) and the next
    document's."""
    dealt = with_next(docs, id_col, text)

    def contained(a: np.ndarray, b: np.ndarray) -> float | None:
        c = containment(a, b, fraction)
        return None if math.isnan(c) else c

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ("id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "contained_edited", "contained_next")
        held, closed = None, False
        for b in batches:
            out = []
            for border, key, t in zip(b["border"], b["id"], b["text"]):
                if closed:
                    break
                t = t or ""
                s = sketch(t, fraction, shingle)
                if held is not None:
                    k0, t0, s0 = held
                    half = len(t0) // 2
                    edited = t0[: len(t0) - half] + t[:half]
                    e = sketch(edited, fraction, shingle)
                    digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
                    out.append((k0, len(t0), digest, text_form(s0), text_form(e), likeness(s0, e, fraction), likeness(s0, s, fraction), contained(s0, e), contained(s0, s)))
                held, closed = (None if pd.isna(key) else int(key), t, s), bool(border)
            if out:
                f = pd.DataFrame(out, columns=names)
                yield f.assign(id=pd.array(f["id"], dtype="Int64"))

    schema = ("id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, "
              "near_next double, contained_edited double, contained_next double")
    return dealt.select("border", "id", "text").mapInPandas(run, schema)
