"""Best-two-fit packing of tokenised documents into fixed-length sequences.

A document is its token ids and a final id 0; longer ones are cut into pieces of
the sequence length.  Packing depends on the pieces' lengths only, so the plan
is made from the number of pieces of each length: at most ``capacity`` numbers,
whatever the size of the corpus.  A bin is filled greedily with the longest
pieces that fit; then its smallest piece is replaced by the two unpacked pieces
that fit its expanded gap most tightly, where two do so better.  The pattern is
repeated as often as its lengths last, then the next is made.  The pieces of
a length are numbered across the cluster (a count for each length and input
partition, then places within it) and the plan says which numbers go where.

Defined results: a null or empty text is one piece, the id 0; repeated rows are
packed each; a null id is kept; an empty table gives no rows."""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pricelens.llm.common import materialize, running_offsets

TOKENIZER = "word_bpe_49k.json"
CAPACITY = 2048
CACHE_WORDS = 400_000  # words whose ids a task remembers at a time


class WordIds:
    """Ids of a text as packed little-endian 32-bit integers.

    The tokenizer drops white space and never joins characters across it, so a
    text's ids are those of its space-separated words, each encoded once and
    remembered.  Words of plain Latin letters go straight to the vocabulary's
    merges, all others through the whole tokenizer."""

    def __init__(self, path: str | None = None):
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(TOKENIZER)
        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {"": b""}
        # byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(printable)]
        self.alphabet = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}

    def _whole(self, word: str) -> bytes:
        ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        return np.array(ids, dtype="<u4").tobytes()

    def word(self, word: str) -> bytes:
        got = self.known.get(word)
        if got is not None:
            return got
        if len(self.known) >= CACHE_WORDS:
            self.known = {"": b""}
        if len(word) > 1 and word[-1] in ".," and word[-2].isalnum() and word[-2] != "İ":  # which leaves a mark behind
            got = self.word(word[:-1]) + self.word(word[-1])
        elif word.isalpha() and max(word) < "ɐ" and "İ" not in word:
            low = word.lower()
            if low != word:
                got = self.word(low)
            else:
                mapped = "".join(map(self.alphabet.__getitem__, low.encode()))
                got = np.array([t.id for t in self.tokenizer.model.tokenize(mapped)], dtype="<u4").tobytes()
        else:
            got = self._whole(word)
        self.known[word] = got
        return got

    def text(self, text: str | None) -> bytes:
        words = (text or "").replace("\n", " ").split(" ")
        known = self.known
        try:
            return b"".join([known[w] for w in words])
        except KeyError:
            return b"".join([self.word(w) for w in words])


def pieces(docs: DataFrame, id_col: str = "doc_id", text: str = "text", capacity: int = CAPACITY, path: str | None = None,
           with_ids: bool = False) -> DataFrame:
    """One row for each piece: uid (of the row), id, piece, start, length,
    ids_crc32, and with ``with_ids`` also ids, packed."""
    slim = docs.select(F.monotonically_increasing_id().alias("uid"), docs[id_col].alias("id"), docs[text].alias("text"))
    id_type = dict(slim.dtypes)["id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = WordIds(path)
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("uid", "id", "piece", "start", "length", "ids_crc32", "ids")}
            for uid, key, t in zip(b["uid"], b["id"], b["text"]):
                ids = coder.text(t) + b"\0\0\0\0"
                for p, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    row = (uid, None if pd.isna(key) else key, p, at // 4, len(part) // 4, zlib.crc32(part), part if with_ids else None)
                    for k, v in zip(out, row):
                        out[k].append(v)
            if not with_ids:
                out.pop("ids")
            yield pd.DataFrame(out).astype({"id": b["id"].dtype if b["id"].notna().all() else "object"})

    schema = f"uid long, id {id_type}, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")
    return slim.mapInPandas(run, schema)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Number of pieces by length -> (pieces of each length in a bin, number of
    such bins), by best-two-fit."""
    left = {n: c for n, c in counts.items() if c > 0}
    lengths = sorted(left)
    out = []
    while lengths:
        gap, use = capacity, {}
        at = len(lengths)
        while gap > 0 and (at := bisect_right(lengths, gap, 0, at)) > 0:  # the longest that fit, again and again
            n = lengths[at - 1]
            k = min(gap // n, left[n])
            use[n] = k
            gap -= k * n
            at -= 1
        if gap > 0 and sum(use.values()) > 1:
            small = min(use)
            use[small] -= 1
            two = _best_two(lengths, left, use, gap + small, small)
            if two:
                for n in two:
                    use[n] = use.get(n, 0) + 1
            else:
                use[small] += 1
            use = {n: k for n, k in use.items() if k}
        times = min(left[n] // k for n, k in use.items())
        out.append((use, times))
        for n, k in use.items():
            left[n] -= k * times
            if not left[n]:
                del left[n]
                lengths.remove(n)
    return out


def _best_two(lengths: list[int], left: dict[int, int], use: dict[int, int], free: int, small: int) -> tuple[int, int] | None:
    """The two unpacked pieces with the largest sum within ``free``, over ``small``."""
    spare = [n for n in lengths if n <= free and left[n] > use.get(n, 0)]
    best, pair, i, j = small, None, 0, len(spare) - 1
    while i <= j:
        a, b = spare[i], spare[j]
        s = a + b
        if s > free or (i == j and left[a] - use.get(a, 0) < 2):
            j -= 1
            continue
        if s > best:
            best, pair = s, (a, b)
            if s == free:
                break
        i += 1
    return pair


def _segments(patterns: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """Rows (length, first number, first sequence, pieces in a bin, first offset),
    sorted by length and number."""
    used: dict[int, int] = {}
    rows, base = [], 0
    for use, times in patterns:
        offset = 0
        for n in sorted(use, reverse=True):
            rows.append((n, used.get(n, 0), base, use[n], offset))
            used[n] = used.get(n, 0) + use[n] * times
            offset += n * use[n]
        base += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def _placed(length: Column, number: Column, segments: np.ndarray) -> Column:
    keys = segments[:, 0] * (1 << 48) + segments[:, 1]

    @F.pandas_udf("sequence_id long, offset long")
    def run(n: pd.Series, r: pd.Series) -> pd.DataFrame:
        n, r = n.to_numpy(np.int64), r.to_numpy(np.int64)
        s = segments[np.searchsorted(keys, n * (1 << 48) + r, side="right") - 1]
        k = r - s[:, 1]
        return pd.DataFrame({"sequence_id": s[:, 2] + k // s[:, 3], "offset": s[:, 4] + (k % s[:, 3]) * n})

    return run(length, number)


def pack(docs: DataFrame, id_col: str = "doc_id", text: str = "text", capacity: int = CAPACITY, path: str | None = None,
         with_ids: bool = False) -> DataFrame:
    """The rows of ``pieces`` with sequence_id and offset."""
    rows = pieces(docs, id_col, text, capacity, path, with_ids).withColumn("pid", F.spark_partition_id())
    rows = materialize(rows, "pieces")
    by = rows.groupBy("length", "pid").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["length"]: r["n"] for r in by.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    starts = running_offsets(by, ["length"], "pid", "n", "before").drop("n")
    w = Window.partitionBy("length", "pid").orderBy("uid", "piece")
    j = rows.join(starts, ["length", "pid"]).withColumn("number", F.col("before") + F.row_number().over(w) - 1)
    segments = _segments(plan(counts, capacity))
    j = j.withColumn("at", _placed(F.col("length"), F.col("number"), segments))
    cols = [c for c in rows.columns if c != "pid"]
    return j.select(*cols, "at.sequence_id", "at.offset")


def sequences(docs: DataFrame, **kw) -> DataFrame:
    """The packed sequences themselves: sequence_id and ids (packed little-endian
    32-bit integers), at most ``capacity`` ids each."""
    p = pack(docs, with_ids=True, **kw)
    held = p.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("x"))
    return held.select("sequence_id", F.aggregate("x", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
