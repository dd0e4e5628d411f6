"""Quality rules: a threshold table compiled into one projection.

Every signal is a built-in expression over the whole text, so a filter over a
table is one narrow projection: no shuffle and no user function.  A rule is a
row ``(name, signal, comparison, numerator factor, other signal, factor)`` of
the threshold table; ``compile_rules`` turns the table into one boolean
column.

Defined results: a null text has no words and no lines (all signals 0, hence
rejected by the shortest-text rule); an empty text likewise.  Repeated rows are
judged alike.  Columns of the caller named like a signal are not touched,
because signals live in one struct."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelens.llm.common import NOT_SPACE, let, symbol_count, words

WINDOW = 5  # words of a window of the repetition rule

# Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    # English
    "the", "of", "and", "to", "in", "is", "that", "it", "for", "on", "with", "as", "at", "by", "be", "this", "are", "from", "an", "was",
    # German
    "der", "die", "das", "und", "ist", "zu", "den", "von", "mit", "sich", "auf", "für", "nicht", "ein", "eine", "im",
    # French
    "le", "la", "les", "de", "des", "et", "est", "un", "une", "que", "qui", "dans", "pour", "pas", "par", "du", "sur",
    # Spanish
    "el", "los", "las", "y", "en", "es", "se", "con", "no", "su", "al", "lo", "como", "para",
)

# The threshold table.  A text fails a rule when
# factor * signal  (comparison)  limit * against   holds.
RULES = (
    # name, signal, factor, comparison, limit, against (None: the constant 1)
    ("too_short", "n_words", 1, "<", 10, None),
    ("repeated_windows", "n_repeat_words", 100, ">", 20, "n_words"),
    ("symbols_per_word", "n_symbols", 100, ">", 25, "n_words"),
    ("stop_words", "n_stop_words", 100, "<", 4, "n_words"),
    ("repeated_lines", "n_dup_lines", 100, ">", 40, "n_lines"),
    ("long_words", "word_chars", 1, ">", 25, "n_words"),
)
BASE = ("too_short", "repeated_windows")


def _window_hashes(w: Column) -> Column:
    n = F.size(w)
    idx = F.when(n >= WINDOW, F.sequence(F.lit(0), n - WINDOW)).otherwise(F.array().cast("array<int>"))
    return F.transform(idx, lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(WINDOW)]))


def _covered(h: Column) -> Column:
    """Words inside a window that occurs twice or more: windows are sorted by
    hash with their place, those equal to a neighbour are kept, and the places
    they cover are summed in order."""

    def repeated(s: Column) -> Column:
        same = lambda i, j: F.coalesce(F.get(s, i)["x"] == F.get(s, j)["x"], F.lit(False))
        at = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: same(i, F.when(i > 0, i - 1)) | same(i, i + 1))
        return F.sort_array(F.transform(at, lambda i: F.get(s, i)["i"]))

    starts = let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i")))), repeated)
    zero = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-WINDOW).alias("last"))
    total = F.aggregate(
        starts, zero,
        lambda a, i: F.struct((a["sum"] + F.least(F.lit(WINDOW), i - a["last"])).alias("sum"), i.alias("last")),
        lambda a: a["sum"],
    )
    return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(total)


def signals(text: Column, stop_words: tuple[str, ...] = STOP_WORDS) -> Column:
    """Struct of the signals of one text.  Windows of the repetition signal are
    compared by their 64-bit hashes."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(NOT_SPACE))
    of_words = let(
        words(t),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.size(F.filter(w, lambda x: x.isin(*stop_words))).cast("long").alias("n_stop_words"),
            let(_window_hashes(w), _covered).alias("n_repeat_words"),
        ),
    )
    of_lines = let(
        lines,
        lambda x: F.struct(
            F.size(x).cast("long").alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        ),
    )
    return let(
        F.struct(of_words.alias("w"), of_lines.alias("l"), symbol_count(t).alias("s")),
        lambda a: F.struct(
            a["w"]["n_words"].alias("n_words"), a["w"]["word_chars"].alias("word_chars"), a["s"].alias("n_symbols"),
            a["l"]["n_dup_lines"].alias("n_dup_lines"), a["w"]["n_repeat_words"].alias("n_repeat_words"),
            a["w"]["n_stop_words"].alias("n_stop_words"), a["l"]["n_lines"].alias("n_lines"),
        ),
    )


def compile_rules(sig: Column, rules=RULES) -> Column:
    """True where any rule of the table fails."""
    bad = F.lit(False)
    for _, name, factor, cmp, limit, against in rules:
        left = sig[name] * F.lit(factor)
        right = F.lit(limit) * (sig[against] if against else F.lit(1))
        bad = bad | (left < right if cmp == "<" else left > right)
    return bad


def judge(docs: DataFrame, text: str = "text", rules=RULES, out: str = "quality") -> DataFrame:
    """``docs`` with a struct column ``out``: the signals, ``base_failed`` and
    ``kept``.  One projection."""
    s = docs.withColumn(out, signals(docs[text]))
    sig = F.col(out)
    base = compile_rules(sig, [r for r in rules if r[0] in BASE])
    return s.withColumn(out, F.struct(f"{out}.*", base.alias("base_failed"), (~compile_rules(sig, rules)).alias("kept")))


def filter_quality(docs: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """The rows of ``docs`` that pass every rule, with unchanged columns."""
    return docs.where(~let(signals(docs[text]), lambda s: compile_rules(s, rules)))


def _sql() -> str:
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    cols = {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_lines"}
    test = {r[0]: f"({r[2]} * {r[1]} {r[3]} {r[4]}" + (f" * {r[5]})" if r[5] else ")") for r in RULES if r[1] in cols}
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM t),
win AS (SELECT doc_id, i, array_to_string(ws[i:i+4], ' ') AS win
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM win) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM dup) GROUP BY doc_id),
s AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
        CAST(length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
        CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
        CAST(len(list_filter(ws, lambda x: x IN ({stop}))) AS BIGINT) AS n_stop_words, CAST(len(ls) AS BIGINT) AS n_lines
      FROM w LEFT JOIN cov ON w.doc_id = cov.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  ({' OR '.join(test[b] for b in BASE)}) AS base_failed, NOT ({' OR '.join(test.values())}) AS kept FROM s
"""


SQL = _sql()
