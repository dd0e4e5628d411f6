"""Merkle manifest, bit-plane clustering and language profiles against plain
Python, their SQL, and nulls, ties, repeated rows, empty tables and clashing names."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import __spark_entry__ as entry
from pricelens.llm import bitplane, language, merkle
from tests.compare import assert_same
from tests.conftest import SF_SMALL


@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op12_centroid_clustering", "op13_language_id"])
def test_matches_sql(spark, duck, name):
    assert_same(entry.queries()[name](spark, SF_SMALL).toPandas(), duck.sql(entry.oracle_sql()[name]).df())


# --- Merkle manifest -----------------------------------------------------------------------

def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(*values):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(leaves, fanout):
    """Root and, for each leaf, its [(left, right)] steps."""
    paths, level, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        runs = [level[i : i + fanout] for i in range(0, len(level), fanout)]
        for leaf, i in enumerate(at):
            run, own = runs[i // fanout], i % fanout
            paths[leaf].append(("".join(run[:own]), "".join(run[own + 1 :])))
        level, at = [H(*r) for r in runs], [i // fanout for i in at]
    return level[0], paths


def plain_audit(rows, fanout):
    def order(v):
        return (v is not None, v if v is not None else 0)

    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    langs = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees, out = [], []
    for g in langs:
        ordered = sorted(groups[g], key=lambda r: (order(r[0]), plain_leaf(*r)))
        trees.append((ordered, *plain_tree([plain_leaf(*r) for r in ordered], fanout)))
    root, tops = plain_tree([t[1] for t in trees], fanout)
    for (ordered, sub, paths), top in zip(trees, tops):
        for r, path in zip(ordered, paths):
            steps, leaf = path + top, plain_leaf(*r)
            text = r[4]
            if zlib.crc32(("-" if r[0] is None else str(r[0])).encode()) % 3 == 0 and text is not None:
                text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
            acc = plain_leaf(*r[:4], text)
            for left, right in steps:
                acc = H(left, acc, right)
            out.append((r[0], leaf, sub, root, H(*(x for s in steps for x in s)), acc, acc == root))
    return out


DOCS = "doc_id long, source string, lang string, n_chars long, text string, digest string, tree string, key string, i int"


def rows_of(df):
    cols = ("id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


@pytest.mark.parametrize("fanout", [8, 2])
def test_manifest_is_the_plain_tree(spark, fanout):
    rows = [(i, f"s{i % 3}", "en", i, f"Text {i} ÄB") for i in range(75)]
    rows += [(i, "s", "de", None, None if i % 2 else "ABC") for i in range(200, 209)]
    rows += [(300, "s", None, 1, "Alone"), (None, "s", "fr", 2, "X"), (None, "s", "fr", 2, "Y"), (None, None, None, None, None)]
    rows += [(5, "s2", "en", 5, "Text 5 ÄB")] * 20 + [(400 + i, None, f"l{i}", 0, "") for i in range(10)]
    docs = spark.createDataFrame([(*r, "d", "t", "k", 7) for r in rows], DOCS).repartition(5)
    assert rows_of(merkle.audit(docs, fanout=fanout)) == sorted(plain_audit(rows, fanout), key=repr)


def test_manifest_of_one_row_and_of_none(spark):
    docs = spark.createDataFrame([(6, "s", "en", 3, "aBc", "", "", "", 0)], DOCS)
    (r,) = merkle.audit(docs).collect()
    assert r["leaf"] == r["subroot"] == r["root"] == plain_leaf(6, "s", "en", 3, "aBc") and r["proof_sha256"] == H()
    assert merkle.audit(docs.limit(0)).count() == 0


def test_intervals_nest_and_cover(spark):
    docs = spark.createDataFrame([(i, "s", f"l{i % 2}", 1, "x", "", "", "", 0) for i in range(150)], DOCS)
    m = merkle.build(docs, merkle.leaf_digest([docs.doc_id]), merkle.leaf_digest([docs.doc_id]))
    for level in m.levels:
        spans = sorted((r["lo"], r["hi"]) for r in level.collect())
        assert spans[0][0] == 0 and spans[-1][1] == 150 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))


# --- bit planes ----------------------------------------------------------------------------

@pytest.mark.parametrize("d", [1, 64, 100])
def test_planes_give_exact_products(d):
    rng = np.random.default_rng(d)
    x, c = rng.integers(-300, 300, (500, d)), rng.integers(-300, 300, (7, d))
    px, pc = bitplane.pack(x, 10), bitplane.pack(c, 10)
    assert (bitplane.unpack(px, d) == x).all() and (bitplane.dots(px, pc) == x @ c.T).all()
    assert (bitplane.squares(px) == (x * x).sum(axis=1)).all()
    dist = ((x[:, None] - c[None]) ** 2).sum(axis=2)
    found, least = bitplane.nearest(px, pc)
    assert (found == dist.argmin(axis=1)).all() and (least == dist.min(axis=1)).all()


def plain_clusters(rows, k, rounds):
    v = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in vec]) for i, vec in rows]
    first = sorted(v, key=lambda r: (hashlib.sha256(f"2:{'-' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    cents = [list(r[1]) for r in first]
    x = np.array([r[1] for r in v], dtype=object)

    def near():
        return [min((sum((a - b) ** 2 for a, b in zip(row, c)), j) for j, c in enumerate(cents)) for row in x]

    for _ in range(rounds):
        at = [j for _, j in near()]
        for j in range(len(cents)):
            own = [row for row, a in zip(x, at) if a == j]
            if own:
                cents[j] = [sum(col) // len(own) for col in zip(*own)]
    found = near()
    total = sum(d for d, _ in found)
    return sorted(((i, j, d, sum(e for e, m in found if m == j), total, hashlib.sha256(",".join(map(str, cents[j])).encode()).hexdigest())
                   for (i, _), (d, j) in zip(v, found)), key=repr)


VECTORS = "vec_id long, embedding array<float>, cluster string, planes string, id string"


def clustered(df, **kw):
    cols = ("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    return sorted((tuple(r[c] for c in cols) for r in bitplane.cluster(df, **kw).assigned.collect()), key=repr)


def test_clusters_are_those_of_plain_lloyd(spark):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(6, 64)) * 0.3
    rows = [(i, (centers[i % 6] + rng.normal(size=64) * 0.05).tolist()) for i in range(300)]
    rows += [(i, rows[7][1]) for i in range(500, 600)] + [(7, rows[7][1])] * 3 + [(None, rows[8][1])]
    bad = [(900, None), (901, [0.1] * 63), (902, [None] + [0.1] * 63), (903, [float("nan")] * 64), (904, [float("inf")] + [0.0] * 63), (905, [])]
    df = spark.createDataFrame([(*r, "c", "p", "i") for r in rows + bad], VECTORS).repartition(4)
    assert clustered(df, k=12, rounds=3) == plain_clusters(rows, 12, 3)


def test_few_vectors_no_vectors_and_too_large_ones(spark):
    one = spark.createDataFrame([(1, [0.5] * 64, "", "", "")], VECTORS)
    assert [r[:4] for r in clustered(one)] == [(1, 0, 0, 0)]
    assert clustered(one.limit(0)) == []
    with pytest.raises(ValueError, match="64 bits"):
        bitplane.cluster(spark.createDataFrame([(1, [3e9] * 64, "", "", "")], VECTORS))


# --- language profiles ---------------------------------------------------------------------

def plain_profile(texts, size=300):
    c = Counter()
    for t in texts:
        for w in "".join(x if x.isalpha() else " " for x in t.lower()).split():
            p = f"_{w}_"
            c.update(w)
            c.update(p[i : i + n] for n in (2, 3) for i in range(len(p) - n + 1))
    return [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:size]]


def plain_guess(text, profiles):
    own = plain_profile([text or ""])
    if not own or not profiles:
        return "und", 0.0
    best = min((sum(abs(i - p.index(g)) if g in p else 300 for i, g in enumerate(own)), name) for name, p in profiles.items())
    return best[1], 1.0 - best[0] / (300 * len(own))


LANG_DOCS = "doc_id long, text string, lang string, row string, found string, score string"
LANG_ROWS = [
    (1, "The quick brown fox jumps over the lazy dog, and the cat sleeps. This is the way of the world", "en"),
    (2, "Der schnelle braune Fuchs springt über den faulen Hund und die Katze schläft. Das ist der Lauf der Welt", "de"),
    (3, "Der schnelle braune Fuchs springt über den faulen Hund und die Katze schläft. Das ist der Lauf der Welt", "de"),
    (4, "the end of the story", None), (5, None, "en"), (6, "", "fr"), (7, "12 34 _ ²", None), (None, "das Ende der Geschichte", "de"),
    (8, "x" * 5000 + " İstanbul 漢字かな 𝔘𝔫𝔦", "tr"), (9, "the", None), (9, "the", None),
]


def test_language_is_that_of_plain_profiles(spark):
    df = spark.createDataFrame([(*r, "r", "f", "s") for r in LANG_ROWS], LANG_DOCS).repartition(3)
    table = language.train(df)
    profiles = {g: plain_profile([t for _, t, lang in LANG_ROWS if lang == g and t]) for g in ("en", "de", "tr")}
    rows = table.collect()
    assert {g: [r["gram"] for r in sorted((r for r in rows if r["lang"] == g), key=lambda r: r["rank"])] for g in profiles} == profiles
    got = language.identify(df, language.Profiles.collect(table))
    assert got.columns == ["doc_id", "text", "lang", "row", "found", "lang_pred", "score"]
    want = sorted(((i, t, *plain_guess(t, profiles)) for i, t, _ in LANG_ROWS), key=repr)
    seen = sorted(((r["doc_id"], r["text"], r["lang_pred"], r["score"]) for r in got.collect()), key=repr)
    assert [r[:3] for r in seen] == [r[:3] for r in want] and [r[3] for r in seen] == pytest.approx([r[3] for r in want])


def test_language_with_nothing_learned_and_no_rows(spark):
    df = spark.createDataFrame([(1, "some words", None, "", "", "")], LANG_DOCS)
    empty = language.Profiles.collect(language.train(df))
    assert [(r["lang_pred"], r["score"]) for r in language.identify(df, empty).collect()] == [("und", 0.0)]
    assert language.identify(df.limit(0), empty).count() == 0


def test_language_of_held_out_documents(spark):
    q = entry.queries()["op13_language_id"](spark, "/root/testdata/sf0.01").where("held_out")
    rows = q.join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) > 100 and sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.98 * len(rows)
