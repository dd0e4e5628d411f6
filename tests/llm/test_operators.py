"""The operators against brute-force versions, exact round trips and held-out data."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from pricelens.llm import fingerprints, html_text, mixing, packing, pii, quality, secret_scan, sharding, simhash, substring
from pricelens.llm.graph import connected_components
from pricelens.llm.queries import QUERIES, SQL
from tests.compare import assert_same
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF_SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def texts(documents):
    return {r["doc_id"]: r["text"] for r in documents.select("doc_id", "text").collect()}


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t)


# 1 -------------------------------------------------------------------------

PAGES = [
    ("<html><body><nav><a href=x>Home</a></nav><article><h1>A title</h1><p>First, a long enough paragraph, with commas.<p>Second &amp; last &lt;one&gt;."
     "</article><footer>&copy; all</footer></body></html>", "A title First, a long enough paragraph, with commas. Second & last <one>."),
    ('<body><div class="cookie-notice">We use cookies, yes, we do, and more.</div><div id="content"><p>Body text that is long, and goes on, and on.</p>'
     '<p>More body<br>text with a <b>bold</b>er word, too, in it.</p><div class="ad">Buy, buy, buy now, cheap things here</div></div>'
     '<div class="sidebar"><p>Related stories, many of them, to read now.</p></div><section id="comments"><p>Nice post, really, I like it a lot.</p></section></body>',
     "Body text that is long, and goes on, and on. More body text with a bolder word, too, in it."),
    ('<main><script>var t = "</p><p>no";</script><style>p{}</style><p title="a>b">Only this  text\n counts, I think, or so.</p><form><input>Search here, please</form></main>',
     "Only this text counts, I think, or so."),
    ("plain words without any markup at all", "plain words without any markup at all"),
    ("<!-- a comment --><p>one</p><!-- unclosed <p>two</p>", "one"),
]


@pytest.mark.parametrize("page, want", PAGES)
def test_main_text(page, want):
    assert html_text.main_text(page) == want


def test_pages_give_their_articles(spark):
    for r in QUERIES["op1_html_extraction"](spark, SF_SMALL).join(spark.read.parquet(f"{SF_SMALL}/pages.parquet").select("page_id", "html"), "page_id").collect():
        body = re.search(r"<article>(.*?)(?:</article>|<footer>|\Z)", r["html"], re.S)[1]
        body = re.sub(r"<[^>]*>", "", re.sub(r"</?(?:p|h1|br)>", " ", body))
        import html

        assert r["text"] == " ".join(html.unescape(body).split()) and r["n_chars"] == len(r["text"])


# 2 -------------------------------------------------------------------------


def test_ids_equal_the_whole_tokenizer():
    coder = packing.WordIds()
    odd = ["", "It's, we'll.", "Çédille ÀÉÎ straße ŒUVRE", "a.,b ..., x.", "naïve nbsp　wide\r\nline\x0bv\x1cs", "İstanbul ΣΑΣ ﬁ é 中文 \U0001f600!", "<|endoftext|> a<|startoftext|>b", "x" * 500, "1234 5,678.90 3rd"]
    for t in odd:
        assert coder.text(t) == np.array(coder.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t


def test_packing_is_whole_and_tight(spark, texts):
    rows = QUERIES["op2_packing"](spark, SF_SMALL).collect()
    coder = packing.WordIds()
    by_doc, by_bin = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_bin[r["sequence_id"]].append(r)
    assert set(by_doc) == set(texts)
    for d, rs in by_doc.items():
        ids = coder.text(texts[d]) + b"\0\0\0\0"
        rs.sort(key=lambda r: r["piece"])
        assert [r["start"] for r in rs] == [2048 * i for i in range(len(rs))] and sum(r["length"] for r in rs) == len(ids) // 4
        assert all(zlib.crc32(ids[4 * r["start"] : 4 * (r["start"] + r["length"])]) == r["ids_crc32"] for r in rs)
    for rs in by_bin.values():
        at = 0
        for r in sorted(rs, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    least = -(-sum(r["length"] for r in rows) // 2048)
    assert len(by_bin) <= least * 1.02 + 1


def test_sequences_hold_the_ids(spark, documents):
    some = documents.where("doc_id < 30")
    coder = packing.WordIds()
    want = Counter()
    for r in some.collect():
        ids = coder.text(r["text"]) + b"\0\0\0\0"
        want.update(Counter(np.frombuffer(ids, "<u4").tolist()))
    got = Counter()
    for r in packing.sequences(some).collect():
        got.update(Counter(np.frombuffer(bytes(r["ids"]), "<u4").tolist()))
    assert got == want


def test_two_fit_replaces_the_smallest():
    # greedy puts 6 and then 3; the two 2s fill the gap of 10 - 6 exactly
    assert packing.plan({6: 1, 3: 1, 2: 2}, 10)[0] == ({6: 1, 2: 2}, 1)
    counts = {n: random.Random(1).randrange(1, 50) for n in range(1, 2049, 13)}
    placed = Counter()
    for use, times in packing.plan(counts):
        assert sum(n * k for n, k in use.items()) <= 2048
        placed.update({n: k * times for n, k in use.items()})
    assert placed == Counter(counts)


# 3 -------------------------------------------------------------------------


def brute_spans(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(digits(m[0])) <= 15]


def test_base_spans_equal_plain_patterns(texts):
    r = random.Random(3)
    odd = ["".join(r.choice("a.@1 -+()9_%b") for _ in range(60)) for _ in range(3000)]
    for t in [*texts.values(), *odd, "a@b@c.de x@y..z 1.2.3.4.5.6.7.8 256.1.1.1 4111 1111 1111 1111 +1 (555) 555-1234"]:
        assert [(pii.KINDS[k], a, b) for k, a, b in pii.base_spans(t)] == brute_spans(t), t


def test_gradients_are_right():
    model = pii.Tagger(hidden=4, size=3, seed=1)
    data = pii.labelled_snippets(4)
    x, y = np.stack([pii.encode(t, 18) for t, _ in data]), np.zeros((4, 18), dtype=int)
    y[0, 3:6], y[1, 7:9] = [1, 2, 2], [5, 6]
    _, g = model.loss(x, y)
    r = np.random.default_rng(0)
    for k, v in model.p.items():
        for _ in range(4):
            i = tuple(r.integers(0, n) for n in v.shape)
            if k == "T" and model.wrong[i] or k == "s" and model.wrong_start[i]:
                continue
            old = v[i]
            v[i] = old + 1e-5
            up = model.loss(x, y)[0]
            v[i] = old - 1e-5
            down = model.loss(x, y)[0]
            v[i] = old
            assert (up - down) / 2e-5 == pytest.approx(g[k][i], abs=1e-5)


def test_held_out_spans_are_found():
    model = pii.train()
    found = missed = wrong = 0
    held = pii.labelled_snippets(300, seed=99)
    for (base, added), (t, spans) in zip(pii.find_spans([t for t, _ in held], model), held):
        got, want = set(base + added), {s for s in spans if s[2] < len(t)}
        found, missed, wrong = found + len(got & want), missed + len(want - got), wrong + len({s for s in got - want if s[2] < len(t)})
    assert found >= 0.75 * (found + missed) and wrong <= 0.1 * found
    card = "Words and then 9436346619525194 more words, of the kind that say nothing at all"
    assert (2, 15, 31) in pii.find_spans([card], model)[0][1]
    clean = "Words of a text without any number, and then some more of them."
    assert pii.find_spans([clean, 'token = "4d44c79e8bf7c55759c4958dd60ed83d2ef8cd4e" as.'], model) == [([], []), ([], [])]


def test_reconcile_takes_the_heaviest_set():
    assert pii.reconcile([(0.9, 0, 0, 10), (0.95, 1, 8, 30), (0.9, 2, 30, 40), (0.8, 1, 8, 30)]) == [(1, 8, 30), (2, 30, 40)]


# 4 -------------------------------------------------------------------------


def test_quality_matches_sql(spark, duck):
    assert_same(QUERIES["op4_quality_rules"](spark, SF_SMALL).toPandas(), duck.sql(SQL["op4_quality_rules"]).df())


def test_quality_keeps_good_documents(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    j = QUERIES["op4_quality_rules"](spark, "/root/testdata/sf0.01").join(labels, "doc_id").toPandas()
    good = j[(j.quality == 1) & ~j.base_failed]
    assert good.kept.all() and j[j.quality == 0].kept.mean() < 0.1


# 5 -------------------------------------------------------------------------


def test_forest_on_held_out_findings(spark, texts):
    forest = secret_scan.train()
    held = secret_scan.labelled_findings(600, seed=5)
    p = forest.predict(np.array([secret_scan.features(*f[:4]) for f in held])) >= secret_scan.LEAST
    assert (p == np.array([f[4] for f in held])).mean() > 0.97
    for t, found in zip(texts.values(), secret_scan.find(list(texts.values()), [None] * len(texts), forest)):
        for a, b, q in found:
            assert (q >= secret_scan.LEAST) == ("token = " in t[max(0, a - 12) : a].lower())


# 6 -------------------------------------------------------------------------


def test_planted_passages_are_found(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(6))
    passages = [[word() for _ in range(60 + 10 * i)] for i in range(4)]
    rows, holds = [], defaultdict(set)
    for d in range(80):
        body = [word() for _ in range(r.randrange(20, 300))]
        if d % 2 == 0:
            p = d // 2 % 4
            text = list(passages[p])
            if d % 3 == 0:  # an edited copy: a word changed, one dropped, one added
                text[20] = word()
                del text[35]
                text.insert(45, word())
            at = r.randrange(len(body))
            body[at:at] = text
            holds[p].add(d)
        rows.append((d, " ".join(body)))
    found = substring.shared_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    parent = {d: d for d in range(80)}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for f in found:
        assert f["n_words"] >= 50 and f["identity"] >= 0.8
        parent[root(f["doc_id"])] = root(f["other_id"])
    groups = defaultdict(set)
    for d in range(80):
        groups[root(d)].add(d)
    assert sorted(map(sorted, (g for g in groups.values() if len(g) > 1))) == sorted(map(sorted, holds.values()))


def test_chain_equals_quadratic_dynamic_program():
    r = np.random.default_rng(2)
    for _ in range(30):
        n = int(r.integers(2, 25))
        a0, b0, length = r.integers(0, 200, n), r.integers(0, 200, n), r.integers(0, 20, n)
        x = np.column_stack([a0, b0, a0 + length, b0 + length, length + substring.K])
        order = sorted(range(n), key=lambda i: (x[i, 0], x[i, 1]))
        score = {}
        for i in order:
            gains = [score[f] + substring.GAP_COST * (x[f, 2] + x[f, 3]) - substring.GAP_COST * (x[i, 0] + x[i, 1] - 2 * substring.K)
                     for f in score if x[f, 2] < x[i, 0] and x[f, 3] < x[i, 1]]
            caps = [min(g, score[f]) for g, f in zip(gains, [f for f in score if x[f, 2] < x[i, 0] and x[f, 3] < x[i, 1]])]
            score[i] = x[i, 4] + max([0.0, *caps])
        got = substring.chain(x)
        assert sorted(i for c in got for i in c) == list(range(n))
        for c in got:
            assert all(x[p, 2] < x[q, 0] and x[p, 3] < x[q, 1] for p, q in zip(c, c[1:]))


def test_longest_common_subsequence():
    r = random.Random(1)
    for _ in range(200):
        x, y = [r.randrange(4) for _ in range(r.randrange(12))], [r.randrange(4) for _ in range(r.randrange(12))]
        t = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, u in enumerate(x):
            for j, v in enumerate(y):
                t[i + 1][j + 1] = t[i][j] + 1 if u == v else max(t[i][j + 1], t[i + 1][j])
        assert substring._lcs(x, y) == t[-1][-1]


# 7 -------------------------------------------------------------------------


def brute_fingerprint(t):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in t))
    if not w:
        return 0
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    bits = [0] * 64
    for x in s:
        h = xxhash.xxh64_intdigest(x.encode(), 42)
        for b in range(64):
            bits[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * bits[b] > len(s))


def test_simhash_equals_brute_force(spark, texts):
    rows = {r["doc_id"]: r for r in QUERIES["op7_simhash"](spark, SF_SMALL).collect()}
    fps = {d: brute_fingerprint(t) for d, t in texts.items()}
    assert {d: int(r["fingerprint"], 16) for d, r in rows.items()} == fps
    parent = {d: d for d in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    order = sorted(fps)
    for i, a in enumerate(order):
        for b in order[i + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    assert {d: r["component_id"] for d, r in rows.items()} == {d: root(d) for d in fps}


@pytest.mark.parametrize("bits", [0, 1, 2, 3, 5])
def test_links_lose_nothing(spark, bits):
    r = random.Random(bits)
    base = [r.getrandbits(64) for _ in range(40)]
    fps = set(base)
    for x in base:
        for _ in range(6):
            y = x
            for b in r.sample(range(64), r.randrange(0, bits + 3)):
                y ^= 1 << b
            fps.add(y)
    signed = [simhash._signed(x) for x in fps]
    got = {(x["a"], x["b"]) for x in simhash.hamming_links(spark.createDataFrame([(x,) for x in signed], "fp long"), bits).collect()}
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= bits}
    assert got == want


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (4, 6), (7, 7), (9, 8), (3, 10), (2, 1)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {1: 1, 2: 1, 3: 1, 10: 1, 4: 4, 5: 4, 6: 4, 8: 8, 9: 8} | {100 + i: 100 for i in range(41)}
    assert {k: got.get(k, k) for k in want} == want


# 8 -------------------------------------------------------------------------


def test_shards_are_whole_and_even(spark, texts):
    rows = QUERIES["op8_sharding"](spark, SF_SMALL).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        t = texts[r["doc_id"]].encode()
        assert r["size"] == len(t) + 1 and r["text_crc32"] == zlib.crc32(t) and r["grown_shard"] is None and r["law"] == "rows"
    counts = Counter(r["shard"] for r in rows)
    assert set(counts) == set(range(16)) and max(counts.values()) - min(counts.values()) <= 1
    assert all(sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(n)) for s, n in counts.items())


def test_the_order_is_shuffled_and_repeats(spark, tmp_path):
    df = spark.range(3000).selectExpr("id as doc_id", "repeat('x', 50) as text").repartition(3)
    order = lambda: [r["row"]["doc_id"] for r in sharding.shard(df, 1, bucket_bytes=20_000).sort("slot").collect()]
    a = order()
    assert a == order() and sorted(a) == list(range(3000))
    assert abs(np.corrcoef(a, range(3000))[0, 1]) < 0.1
    sharding.write_shards(df, str(tmp_path / "out"), 4)
    assert sorted(f for f in os.listdir(tmp_path / "out") if f.startswith("shard=")) == [f"shard={i}" for i in range(4)]


# 9 -------------------------------------------------------------------------


def brute_targets(sizes, share=1.5, cycle=(5, 2, 1), cap=2):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: cycle[i % len(cycle)] for i, s in enumerate(names)}
    t, fixed, left = {}, set(), share * sum(sizes.values())
    while True:
        free = [s for s in names if s not in fixed]
        t |= {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if t[s] > cap * sizes[s]]
        if not over:
            return t
        for s in over:
            t[s] = cap * sizes[s]
            left -= t[s]
            fixed.add(s)


def test_mixture_meets_its_targets(spark, texts):
    rows = QUERIES["op9_mixing"](spark, SF_SMALL).collect()
    source = {r["doc_id"]: r["source"] for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "source").collect()}
    sizes, taken = Counter(), Counter()
    for r in rows:
        assert r["size"] == len(words(texts[r["doc_id"]])) and 0 <= r["taken"] <= 2 * r["size"]
        sizes[source[r["doc_id"]]] += r["size"]
        taken[source[r["doc_id"]]] += r["taken"]
    want = brute_targets(sizes)
    for r in rows:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s]) and abs(taken[s] - want[s]) <= 1
    again = {r["doc_id"]: r["taken"] for r in QUERIES["op9_mixing"](spark, SF_SMALL).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in rows}


def test_better_documents_are_drawn_more_often(spark):
    from pyspark.sql import functions as F

    df = spark.range(4000).selectExpr("id as doc_id", "'a b c' as text", "'s' as source")
    rows = mixing.mix(df, quality=F.when(F.col("doc_id") % 2 == 0, 0.9).otherwise(0.1), share=0.3, cycle=(1.0,)).collect()
    good = sum(r["taken"] for r in rows if r["id"] % 2 == 0)
    bad = sum(r["taken"] for r in rows if r["id"] % 2)
    assert abs(good + bad - 0.3 * 12000) <= 1 and good > 4 * bad
    mixed = mixing.mixture(df, quality=F.when(F.col("doc_id") % 2 == 0, 0.9).otherwise(0.1), share=0.3, cycle=(1.0,)).count()
    assert abs(mixed - 1200) <= 1


# 10 ------------------------------------------------------------------------


def test_fingerprints_equal_brute_force(spark, texts):
    rows = {r["doc_id"]: r for r in QUERIES["op10_fingerprints"](spark, SF_SMALL).collect()}
    order = sorted(texts)
    errors = []
    for i, d in enumerate(order):
        t, after = texts[d], texts[order[(i + 1) % len(order)]]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        r = rows[d]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        s, e, n = (fingerprints.sketch(x) for x in (t, edited, after))
        assert r["fingerprint"] == fingerprints.text_form(s) and r["edited_fingerprint"] == fingerprints.text_form(e)
        assert r["near_edited"] == fingerprints.likeness(s, e) and r["near_next"] == fingerprints.likeness(s, n)
        sets = [{tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} for w in (t.split(), edited.split())]
        if len(sets[0]) > 100:
            errors.append(abs(r["near_edited"] - len(sets[0] & sets[1]) / len(sets[0] | sets[1])))
    assert np.mean(errors) < 0.08


def test_sketches_merge_and_contain():
    r = random.Random(6)
    w = [f"w{r.randrange(10**6)}" for _ in range(8000)]
    whole, part = fingerprints.sketch(" ".join(w)), fingerprints.sketch(" ".join(w[1000:1400]))
    assert fingerprints.containment(part, whole) == 1.0 and fingerprints.containment(whole, part) < 0.1
    a, b = fingerprints.sketch(" ".join(w[:3000])), fingerprints.sketch(" ".join(w[2996:]))
    assert np.array_equal(fingerprints.merge(a, b), whole) and np.array_equal(fingerprints.parse(fingerprints.text_form(whole)), whole)


def test_sketches_of_short_texts():
    r = random.Random(8)
    w = [f"w{r.randrange(10**6)}" for _ in range(5000)]
    long = fingerprints.sketch(" ".join(w))
    known = 0
    for _ in range(400):
        n, at = r.randrange(8, 40), r.randrange(4900)
        part = fingerprints.sketch(" ".join(w[at : at + n]))
        c = fingerprints.containment(part, long)
        assert c == 1.0 or c != c  # never a wrong 0
        known += c == 1.0
        other = w[at : at + n // 2] + [f"x{r.randrange(10**6)}" for _ in range(n - n // 2)]
        sets = [{tuple(x[j : j + 5]) for j in range(len(x) - 4)} for x in (w[at : at + n], other)]
        assert fingerprints.likeness(part, fingerprints.sketch(" ".join(other))) == pytest.approx(len(sets[0] & sets[1]) / len(sets[0] | sets[1]))
    assert known > 340
    joined = fingerprints.merge(fingerprints.sketch(" ".join(w[:20])), fingerprints.sketch(" ".join(w[16:3000])))
    assert np.array_equal(joined, fingerprints.sketch(" ".join(w[:3000])))


def test_token_ids_after_a_letter_that_decomposes():
    coder = packing.WordIds()
    plain = coder.tokenizer
    for text in ("\u0130. a", "x\u0130, b", "DI\u0130.", "I. a", "\u0130"):
        want = np.array([i for w in text.split(" ") for i in plain.encode(w, add_special_tokens=False).ids], "<u4").tobytes()
        assert coder.text(text) == want == np.array(plain.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


# pipeline -------------------------------------------------------------------


def test_pipeline_equals_its_stages_by_hand(spark, texts):
    import corpus_pipeline

    source = {r["doc_id"]: r["source"] for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "source").collect()}
    kept = {r["doc_id"] for r in QUERIES["op4_quality_rules"](spark, SF_SMALL).collect() if r["kept"]}
    fps, firsts = {d: brute_fingerprint(texts[d]) for d in kept}, []
    parent = {d: d for d in kept}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sorted(kept):
        for b in sorted(kept):
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 2:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    firsts = [d for d in sorted(kept) if root(d) == d]
    forest = secret_scan.train()
    left = {}
    for d, found in zip(firsts, secret_scan.find([texts[d] for d in firsts], [source[d] for d in firsts], forest)):
        t = texts[d]
        for a, b, q in reversed(found):
            t = t[:a] + secret_scan.MARK + t[b:] if q >= secret_scan.LEAST else t
        left[d] = t
    rows = corpus_pipeline.run(spark, SF_SMALL).collect()
    coder = packing.WordIds()
    copies = Counter(r["doc_id"] for r in rows if r["piece"] == 0)
    assert set(copies) <= set(left) and max(copies.values()) <= 2
    sizes, got = Counter(), Counter()
    for d, t in left.items():
        sizes[source[d]] += len(words(t))
        got[source[d]] += copies[d] * len(words(t))
    want = brute_targets(sizes)
    longest = {s: max(len(words(left[d])) for d in left if source[d] == s) for s in sizes}
    assert all(abs(got[s] - want[s]) <= longest[s] for s in sizes)
    for r in rows:
        ids = coder.text(left[r["doc_id"]]) + b"\0\0\0\0"
        assert zlib.crc32(ids[4 * r["start"] : 4 * (r["start"] + r["length"])]) == r["ids_crc32"]


def test_every_operator_is_registered():
    assert [sum(k.startswith(f"op{n}_") for k in QUERIES) for n in range(1, 11)] == [1] * 10 and "pipeline" in QUERIES
