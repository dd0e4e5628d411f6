"""Language identification by rank-order profiles (operator 13).

A profile lists the ``size`` most frequent letter n-grams (1 to 3 characters of
lower-cased words, ``_`` at the word's ends), most frequent first, ties by code
point.  Training counts the n-grams of every labelled document: each task counts
distinct words first and sends (language, n-gram, count) sums, Spark adds them and
keeps the head of each language, so a language with most of the rows is no hot
group.  A document is compared by the out-of-place distance: for each n-gram of its
own profile the difference of both ranks, ``size`` if the language's profile
lacks it.  The least distance wins, ties go to the first language by code point;
``score`` is 1 less the distance over its greatest possible value.

An n-gram is one exact 63-bit number (21 bits a character), so nothing is hashed.

Defined results: null texts and texts without a letter are ``und`` with score 0, as is
every text if no language was learned.  A null id counts as the empty text and is
held out.  Whole texts are read, long ones in blocks.  Repeated rows count as often as they occur.  Further
columns are neither read nor changed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pricelens.llm.common import packed

#: n-grams in a profile.
SIZE = 300
#: Characters whose n-grams are counted at a time.
BLOCK = 1 << 20
#: Characters of a language's texts that training reads at a time.
TOGETHER = 1 << 16
#: Counts of a language that a task holds before it merges them.
HELD = 500_000
#: Code point that stands for a word's end.
EDGE = ord("_")
UNMET = 0xFFFFFFFF
MASK = (1 << 21) - 1
#: Profile rows (languages x SIZE) that are sent to every task; more are refused.
MAX_PROFILE_ROWS = 3_000_000
UNKNOWN = "und"


def held_out(id_: Column, folds: int = 5) -> Column:
    """Whether the unsigned CRC-32 of the id as text is a multiple of ``folds``."""
    return F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")) % folds == 0


def added(codes: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes, ascending, with the sums of their ``times``."""
    if not len(codes):
        return codes, times
    order = np.argsort(codes)
    codes = codes[order]
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    return codes[first], np.add.reduceat(times[order], first)


class Reader:
    """Counts the n-grams of texts; remembers which code points are letters."""

    def __init__(self):
        self.map = np.full(0x110000, UNMET, np.uint32)  # a letter is itself, all else EDGE

    def letters(self, text: str) -> np.ndarray:
        """Code points of the lower-cased words, one EDGE before, between and after them."""
        c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
        s = np.full(len(c) + 2, EDGE, np.uint32)
        np.take(self.map, c, out=s[1:-1])
        if s.max() == UNMET:
            for x in np.unique(c[s[1:-1] == UNMET]):
                self.map[x] = x if chr(x).isalpha() else EDGE
            np.take(self.map, c, out=s[1:-1])
        word = s != EDGE
        word[1:] |= word[:-1]  # the place after a word stays, further ones go
        word[0] = True
        return s[word].astype(np.int64)

    def count(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the text's n-grams, ascending, and how often each occurs.  Only those of
        three characters are counted, in blocks; every letter is the middle of one, every pair before
        a further character the head of one, and every word's last pair the tail of one."""
        s = self.letters(text)
        codes, times = [], []
        for at in range(0, len(s) - 2, BLOCK):
            n = min(BLOCK, len(s) - 2 - at)
            a, b, c = s[at : at + n], s[at + 1 : at + n + 1], s[at + 2 : at + n + 2]
            three = np.sort(((a << 42) | (b << 21) | c)[b != EDGE])
            first = np.flatnonzero(np.concatenate([[True], three[1:] != three[:-1]]))
            codes.append(three[first])
            times.append(np.diff(first, append=len(three)))
        if not codes:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        three, n = added(np.concatenate(codes), np.concatenate(times)) if len(codes) > 1 else (codes[0], times[0])
        middle, last = (three >> 21) & MASK, (three & MASK) == EDGE
        smaller = np.concatenate([middle << 42, three & ~MASK, (middle[last] << 42) | (EDGE << 21)])
        smaller, m = added(smaller, np.concatenate([n, n, n[last]]))
        return added(np.concatenate([three, smaller]), np.concatenate([n, m]))


def gram_text(code: int) -> str:
    return "".join(chr(x) for x in (code >> 42, (code >> 21) & 0x1FFFFF, code & 0x1FFFFF) if x)


def train(docs: DataFrame, text: str = "text", lang: str = "lang", size: int = SIZE) -> DataFrame:
    """Profiles (lang, code long, gram string, n long, rank int from 0) from every row
    with a text and a language."""
    rows = docs.select(F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("text")).where("lang is not null and text is not null")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, sums, held, waiting = Reader(), {}, {}, {}

        def read(name):
            texts, _ = waiting.pop(name)
            sums.setdefault(name, []).append(reader.count("\n".join(texts)))
            held[name] = held.get(name, 0) + len(sums[name][-1][0])
            if len(sums[name]) > 1 and held[name] > HELD:
                merge(name)

        def merge(name):
            parts = sums[name]
            sums[name] = [added(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))]
            held[name] = len(sums[name][0][0])

        for b in batches:
            for name, t in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                texts, chars = waiting.get(name, ([], 0))
                texts.append(t)
                waiting[name] = texts, chars + len(t)
                if chars + len(t) > TOGETHER:
                    read(name)
            for name in list(waiting):
                read(name)
            while sum(held.values()) > 4 * HELD:  # many languages, or many n-grams: Spark adds up the rest
                name = max(held, key=held.get)
                yield from send(name, sums.pop(name))
                del held[name]
        for name in list(sums):
            merge(name)
            yield from send(name, sums.pop(name))

    def send(name, parts):
        for codes, n in parts:
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(codes), pa.string()), pa.array(codes), pa.array(n)], ["lang", "code", "n"])

    counts = rows.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), F.asc("code")))
    # a limit on the row number is applied before the exchange too: each task sends the head of a language
    head = counts.withColumn("rank", place).where(F.col("rank") <= size)
    chars = [F.shiftright("code", 42), F.shiftright("code", 21).bitwiseAND(F.lit(0x1FFFFF)), F.col("code").bitwiseAND(F.lit(0x1FFFFF))]
    return head.select("lang", "code", F.concat(*[_char(c) for c in chars]).alias("gram"), "n", (F.col("rank") - 1).alias("rank"))


def _char(code: Column) -> Column:
    """One code point as text, none for 0."""
    raw = F.unhex(F.lpad(F.hex(code.cast("long")), 8, "0"))
    return F.when(code == 0, F.lit("")).otherwise(F.decode(raw, "UTF-32"))


class Profiles:
    """Profiles of all languages as one table: ascending codes x languages -> rank."""

    def __init__(self, rows: list[tuple[str, int, int]], size: int):
        self.size = size
        self.langs = sorted({r[0] for r in rows})  # by code point
        self.codes = np.unique(np.array([r[1] for r in rows], np.int64))
        self.rank = np.full((len(self.codes) + 1, len(self.langs)), -1, np.int32)
        at = {name: j for j, name in enumerate(self.langs)}
        for name, code, rank in rows:
            self.rank[np.searchsorted(self.codes, code), at[name]] = rank

    @classmethod
    def collect(cls, profiles: DataFrame, size: int = SIZE) -> Profiles:
        """The profile table on the driver, at most MAX_PROFILE_ROWS rows."""
        rows = [(r["lang"], r["code"], r["rank"]) for r in profiles.select("lang", "code", "rank").limit(MAX_PROFILE_ROWS + 1).collect()]
        if len(rows) > MAX_PROFILE_ROWS:
            raise ValueError(f"more than {MAX_PROFILE_ROWS} profile rows: merge languages or lower the profile size")
        return cls(rows, size)

    def predict(self, text: str, reader: Reader) -> tuple[str, float]:
        """Language and score of one text."""
        codes, n = reader.count(text)
        if not len(codes) or not self.langs:
            return UNKNOWN, 0.0
        if len(codes) > self.size:  # those as frequent as the last of the profile, then in order
            least = np.partition(n, len(n) - self.size)[len(n) - self.size]
            codes, n = codes[n >= least], n[n >= least]
        codes = codes[np.argsort(-n, kind="stable")[: self.size]]  # codes ascend, so ties keep their order
        row = np.searchsorted(self.codes, codes)
        row = np.where(self.codes[np.minimum(row, len(self.codes) - 1)] == codes, row, len(self.codes))
        rank = self.rank[row]
        off = np.where(rank < 0, self.size, np.abs(rank - np.arange(len(codes), dtype=np.int32)[:, None])).sum(axis=0)
        best = int(off.argmin())
        return self.langs[best], 1.0 - float(off[best]) / (len(codes) * self.size)


def identify(docs: DataFrame, profiles: Profiles, text: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """All columns of ``docs`` with ``lang`` and ``score`` added (or replaced)."""

    @F.pandas_udf("struct<lang: string, score: double>")
    def guess(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        reader = Reader()
        for s in parts:
            rows = [(UNKNOWN, 0.0) if t is None else profiles.predict(t, reader) for t in s]
            yield pd.DataFrame(rows, columns=["lang", "score"])

    both = docs.select(packed(docs), guess(F.col(f"`{text}`")).alias("found"))
    rest = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in (lang, score)]
    return both.select(*rest, F.col("found.lang").alias(lang), F.col("found.score").alias(score))


SQL = """
WITH RECURSIVE ids AS (SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS s FROM (SELECT DISTINCT doc_id FROM documents)),
fold AS MATERIALIZED (
    SELECT doc_id, xor(list_reduce(list_concat([4294967295::BIGINT],
        flatten(list_transform(range(1, len(s) + 1), lambda p: list_transform(range(0, 8), lambda b: (ascii(substr(s, p, 1))::BIGINT >> b) & 1)))),
        lambda c, b: xor(c >> 1, CASE WHEN xor(c, b) & 1 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END)), 4294967295::BIGINT) % 5 = 0 AS held_out
    FROM ids),
d AS MATERIALIZED (
    SELECT row_number() OVER () AS uid, d.doc_id, d.lang, f.held_out, regexp_extract_all(lower(d.text), '\\p{L}+') AS words
    FROM documents d JOIN fold f ON f.doc_id IS NOT DISTINCT FROM d.doc_id),
w AS MATERIALIZED (SELECT uid, word, count(*) AS n FROM (SELECT uid, unnest(words) AS word FROM d) GROUP BY uid, word),
g AS (
    SELECT word, substr('_' || word || '_', p, k) AS gram
    FROM (SELECT word, k, unnest(range(1, len(word) + 4 - k)) AS p FROM (SELECT DISTINCT word FROM w), (VALUES (1), (2), (3)) AS t(k))),
per_word AS MATERIALIZED (SELECT word, gram, count(*) AS n FROM g WHERE gram <> '_' GROUP BY word, gram),
per_doc AS MATERIALIZED (SELECT uid, gram, sum(w.n * p.n) AS n FROM w JOIN per_word p USING (word) GROUP BY uid, gram),
profile AS MATERIALIZED (
    SELECT lang, gram, row_number() OVER (PARTITION BY lang ORDER BY n DESC, gram) - 1 AS rank
    FROM (SELECT lang, gram, sum(n) AS n FROM per_doc JOIN d USING (uid) WHERE lang IS NOT NULL AND NOT held_out GROUP BY lang, gram) QUALIFY rank < 300),
own AS MATERIALIZED (SELECT uid, gram, row_number() OVER (PARTITION BY uid ORDER BY n DESC, gram) - 1 AS rank FROM per_doc QUALIFY rank < 300),
far AS (
    SELECT o.uid, l.lang, sum(coalesce(abs(o.rank - p.rank), 300)) AS off, count(*) AS m
    FROM own o CROSS JOIN (SELECT DISTINCT lang FROM profile) l LEFT JOIN profile p ON p.lang = l.lang AND p.gram = o.gram GROUP BY o.uid, l.lang),
best AS (SELECT uid, lang, 1.0::DOUBLE - off::DOUBLE / (m * 300)::DOUBLE AS score FROM far QUALIFY row_number() OVER (PARTITION BY uid ORDER BY off, lang) = 1)
SELECT d.doc_id, d.held_out, coalesce(b.lang, 'und') AS lang_pred, coalesce(b.score, 0.0::DOUBLE) AS score FROM d LEFT JOIN best b USING (uid)
"""
