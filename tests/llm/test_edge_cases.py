"""Nulls, empty and very long texts, ties, repeated rows, empty tables and
columns whose names clash with the operators' own."""

import pytest

from pricelens.llm import fingerprints, html_text, mixing, packing, pii, quality, secret_scan, sharding, simhash, substring

CLASH = ("uid", "id", "fp", "bucket", "pos", "row", "size", "shard", "slot", "key", "copies", "quality", "target", "draw", "hash", "at", "held", "k", "x")
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
TEXTS = [
    (1, "the quick brown fox jumps over the lazy dog and runs to the river in the morning", "a"),
    (1, "the quick brown fox jumps over the lazy dog and runs to the river in the morning", "a"),
    (2, None, "a"), (3, "", None), (4, " \n\t ", None), (None, "a row without an id but with a text of some words", "b"),
    (None, None, None), (5, LONG, "b"), (6, "one", "b"), (7, "ünï çødé \U0001f600 words | and marks", "c"), (8, LONG, "c"),
]
SCHEMA = "doc_id long, text string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASH)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, s, None if t is None else len(t), *["clash"] * len(CLASH)) for i, t, s in TEXTS]
    return spark.createDataFrame(rows, SCHEMA).coalesce(2)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def ids(df, col="doc_id"):
    return sorted((r[col] for r in df.select(col).collect()), key=lambda x: (x is None, x))


ALL = sorted((i for i, _, _ in TEXTS), key=lambda x: (x is None, x))


def test_quality(docs, empty):
    rows = {(r["doc_id"], r["text"]): r["verdict"] for r in quality.judge(docs, out="verdict").collect()}
    assert rows[2, None]["n_words"] == 0 and not rows[2, None]["kept"] and rows[3, ""]["base_failed"]
    assert rows[1, TEXTS[0][1]]["kept"] and rows[5, LONG]["n_words"] == 60_000
    kept = quality.filter_quality(docs)
    assert kept.columns == docs.columns and ids(kept).count(1) == 2
    assert quality.filter_quality(empty).count() == 0


def test_simhash(docs, empty):
    rows = simhash.near_duplicates(docs).collect()
    assert sorted((r["id"] for r in rows), key=lambda x: (x is None, x)) == ALL
    zero = {r["component_id"] for r in rows if r["fp"] == 0}
    assert zero == {2}  # null, empty and blank texts, also one without an id
    assert {r["component_id"] for r in rows if r["id"] in (5, 8)} == {5}
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and ids(kept).count(1) == 1 and 8 not in ids(kept) and 3 not in ids(kept)
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0


def test_sharding(docs, empty):
    rows = sharding.shard(docs, 4, bucket_bytes=200_000).collect()
    assert sorted((r["row"]["doc_id"] for r in rows), key=lambda x: (x is None, x)) == ALL
    for s in range(4):
        slots = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert slots == list(range(len(slots))) and len(slots) in (len(ALL) // 4, len(ALL) // 4 + 1)
    assert sharding.shard(empty, 4).count() == 0


def test_mixing(docs, empty):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(ALL) and all(r["taken"] <= 2 * r["size"] for r in rows)
    assert sum(r["taken"] for r in rows) == pytest.approx(1.5 * sum(r["size"] for r in rows), abs=4)
    mixed = mixing.mixture(docs)
    assert mixed.columns == docs.columns and {r["doc_id"] for r in mixed.collect()} <= set(ALL)  # whole epochs hold every row
    assert mixing.mix(empty).count() == 0 and mixing.mixture(empty).count() == 0
    blank = docs.where("text is null or text = ''")
    assert all(r["taken"] == 0 and r["target"] == 0 for r in mixing.mix(blank).collect())


def test_packing(docs, empty):
    rows = packing.pack(docs).collect()
    assert sorted((r["id"] for r in rows if r["piece"] == 0), key=lambda x: (x is None, x)) == ALL
    assert {r["length"] for r in rows if r["id"] in (2, 3, 4)} == {1}
    assert packing.pack(empty).count() == 0


def test_fingerprints(docs, empty):
    rows = fingerprints.edit_probe(docs).collect()
    assert sorted((r["id"] for r in rows), key=lambda x: (x is None, x)) == ALL
    assert len({r["fingerprint"] for r in rows if r["id"] in (5, 8)}) == 1
    assert {r["fingerprint"] for r in rows if r["id"] in (2, 3, 4)} == {""}
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)
    assert fingerprints.edit_probe(empty).count() == 0
    one = fingerprints.edit_probe(docs.where("doc_id = 6")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0


def test_substring(docs, empty):
    rows = substring.shared_passages(docs).collect()
    assert {(r["doc_id"], r["other_id"]) for r in rows} == {(5, 8)}
    assert max(r["n_words"] for r in rows) == 60_000 and substring.shared_passages(empty).count() == 0


def test_pii(docs, empty):
    model = pii.Tagger().fit(*_lessons(60), steps=3)
    rows = pii.scan(docs, model).collect()
    assert sorted((r["id"] for r in rows), key=lambda x: (x is None, x)) == ALL
    assert pii.scan(empty, model).count() == 0
    assert pii.train(empty, sample=5, snippets=8) is not None


def _lessons(n):
    import numpy as np

    data = pii.labelled_snippets(n)
    return np.stack([pii.encode(t, pii.LESSON) for t, _ in data]), np.stack([pii.tags_of(s, pii.LESSON) for _, s in data])


def test_secrets(spark, docs, empty):
    forest = secret_scan.train()
    assert secret_scan.scan(empty, forest).count() == 0 and secret_scan.redact(empty, forest).count() == 0
    with_one = docs.selectExpr(*[f"if(doc_id = 6, 'token = \"9f86d081884c7d659a2feaa0c55ad015a3bf4f1b\" end', text) as text" if c == "text" else f"`{c}`" for c in docs.columns])
    out = secret_scan.redact(with_one, forest)
    assert out.columns == docs.columns and ids(out) == ALL
    six = [r for r in out.collect() if r["doc_id"] == 6][0]
    assert six["text"] == 'token = "[secret]" end' and six["n_chars"] == len(six["text"])
    assert [r["text"] for r in out.collect() if r["doc_id"] == 2] == [None]


def test_html(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "<p>" * 3000 + "deep text here" + "</p>" * 3000, "x"), (4, "<div>" * 5000 + "words, and words, and more words", "x")]
    out = html_text.extract(spark.createDataFrame(rows, "page_id long, html string, text string"))
    got = {r["page_id"]: r["text"] for r in out.collect()}
    assert got == {1: "", 2: "", 3: "deep text here", 4: "words, and words, and more words"}
    assert html_text.extract(spark.createDataFrame([], "page_id long, html string, text string")).count() == 0
