"""SimHash near-duplicates with pigeonring candidate filtering.

A fingerprint has 64 bits; bit b is set when over half of the shingles' XXH64
values have it.  Two fingerprints link when at most ``max_bits`` bits differ.
To find the links, the 64 bits are cut into m = max_bits + 1 segments laid on a
ring.  If the whole ring differs in at most ``max_bits`` places, some segment
starts a chain in which every prefix of l segments differs in at most
floor(l * max_bits / m) places (the pigeonring principle).  The first two steps
of that chain are the equi-join key: the first segment unchanged, and the second
with its budget of flipped bits enumerated on the probing side, so a key
carries about 2/m of the bits and no bucket holds all fingerprints of one
segment.  The other prefixes prune the joined rows, and the full Hamming
distance decides.  Only distinct fingerprints take part, so copies never pair.

Defined results: a null or empty text has fingerprint zero, which links like any
other; texts of fewer words than a shingle hash their whole word sequence; repeated
rows share fingerprint and component; a null id never becomes a component id
unless every id of the component is null; an empty table gives an empty result."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelens.llm.common import materialize, packed
from pricelens.llm.graph import connected_components

SEED = 42
BLOCK = 1 << 15  # hashes whose bits are unpacked at once


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Fingerprint of one text as a signed 64-bit integer."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII case and ASCII white space only
    if not w:
        return 0
    h = xxhash.xxh64_intdigest
    if len(w) < shingle:
        hashes = [h(b" ".join(w), SEED)]
    else:
        hashes = [h(x, SEED) for x in map(b" ".join, zip(*[w[i:] for i in range(shingle)]))]
    total = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), BLOCK):
        a = np.array(hashes[i : i + BLOCK], dtype="<u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(a, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    bits = np.packbits(2 * total > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprint_column(text: Column, shingle: int = 3) -> Column:
    @F.pandas_udf("long")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, shingle) for t in s], dtype="int64")

    return run(text)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def ring(max_bits: int) -> list[list[int]]:
    """The bit positions of each of the max_bits + 1 segments."""
    m = max_bits + 1
    return [list(range(64 * i // m, 64 * (i + 1) // m)) for i in range(m)]


def hamming_links(fps: DataFrame, max_bits: int = 2) -> DataFrame:
    """Distinct fingerprints (column fp) -> links (a, b), a < b, of all pairs that
    differ in 1 to ``max_bits`` bits."""
    segs, m = ring(max_bits), max_bits + 1
    masks = [sum(1 << b for b in s) for s in segs]
    budget = [(k + 1) * max_bits // m for k in range(m)]  # of a prefix of k + 1 segments
    probes, homes = [], []
    for i in range(m):
        second = segs[(i + 1) % m] if m > 1 else []
        key = masks[i] | (masks[(i + 1) % m] if m > 1 else 0)
        flips = [0] + [sum(1 << b for b in c) for k in range(1, budget[min(1, m - 1)] + 1) for c in combinations(second, k)]
        homes.append(F.struct(F.lit(i).alias("seg"), F.col("fp").bitwiseAND(F.lit(_signed(key))).alias("key")))
        probes += [
            F.struct(F.lit(i).alias("seg"), F.col("fp").bitwiseXOR(F.lit(_signed(f))).bitwiseAND(F.lit(_signed(key))).alias("key"))
            for f in flips
        ]
    home = fps.select(F.col("fp").alias("b"), F.explode(F.array(*homes)).alias("k")).select("b", "k.seg", "k.key")
    probe = fps.select(F.col("fp").alias("a"), F.explode(F.array(*probes)).alias("k")).select("a", F.col("k.seg").alias("s"), F.col("k.key").alias("q"))
    diff = F.col("a").bitwiseXOR(F.col("b"))
    viable = F.lit(False)
    for i in range(m):
        ok, mask = F.col("seg") == i, 0
        for k in range(m):
            mask |= masks[(i + k) % m]
            ok = ok & (F.bit_count(diff.bitwiseAND(F.lit(_signed(mask)))) <= budget[k])
        viable = viable | ok
    near = F.bit_count(diff) <= max_bits
    on = (F.col("s") == F.col("seg")) & (F.col("q") == F.col("key")) & (F.col("a") < F.col("b")) & viable & near
    return probe.join(home, on).select("a", "b").distinct()


def components(rows: DataFrame, max_bits: int = 2) -> DataFrame:
    """``rows`` with columns id and fp -> (fp, root) with one row for each distinct
    fingerprint; equal roots are one near-duplicate component."""
    fps = rows.select("fp").distinct()
    cc = connected_components(hamming_links(fps, max_bits))
    return fps.join(cc, fps["fp"] == cc["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """One row for each row of ``docs``: id, fp (signed 64 bits) and component_id,
    the smallest id that is reachable over links."""
    rows = materialize(docs.select(docs[id_col].alias("id"), fingerprint_column(docs[text], shingle).alias("fp")), "simhash")
    low = rows.groupBy("fp").agg(F.min("id").alias("low"))
    by_fp = components(rows, max_bits).join(low, "fp")
    least = by_fp.groupBy("root").agg(F.min("low").alias("component_id"))
    named = by_fp.select("fp", "root").join(least, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("id", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """The rows of ``docs`` left when one of each component stays: the one of the
    smallest id (nulls last), and of repeated rows any one."""
    marked = materialize(
        docs.select(
            F.monotonically_increasing_id().alias("uid"), docs[id_col].alias("id"),
            fingerprint_column(docs[text], shingle).alias("fp"), packed(docs),
        ),
        "simhash-rows",
    )
    slim = marked.select("uid", "id", "fp")
    order = F.struct(F.col("id").isNull().alias("n"), "id", "uid")
    firsts = slim.groupBy("fp").agg(F.min(order).alias("first"))
    kept = components(slim, max_bits).join(firsts, "fp").groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.uid").alias("uid"))
    return marked.join(kept, "uid", "left_semi").select("row.*")
