"""Candidates cut out of whole texts."""

from pricelens.llm import secret_scan


def test_names_are_not_part_of_the_value():
    key = "a8Fk29dLq0ZxM3vB7nTt"
    for t in (f"API_KEY={key}\nDEBUG=1", f"https://x.org/p?api_key={key}&v=2", f"export client_secret_2={key}=="):
        at = [(a, b) for a, b in secret_scan.candidates(t) if t[a:b].startswith(key)]
        assert len(at) == 1 and t[at[0][0] : at[0][1]].rstrip("=") == key
        a, b = at[0]
        f = dict(zip(secret_scan.NAMES, secret_scan.features(t[max(0, a - 48) : a], t[a:b], t[b : b + 48], None)))
        assert f["key_word"] == f["assigned"] == 1.0
    assert [t[a:b] for t in ["QUJDREVGR0hJSktMTU5PUA=="] for a, b in secret_scan.candidates(t)] == ["QUJDREVGR0hJSktMTU5PUA=="]


def test_redacted_value_keeps_its_name():
    t = "token=ghp_abcdefghijABCDEFGHIJ0123456789abcdef"
    (found,) = secret_scan.find([t], [None], secret_scan.train())
    assert [(t[a:b], q >= secret_scan.LEAST) for a, b, q in found] == [(t[6:], True)]


SECRETS = [
    ('password = "hunter2!secret#9"', "hunter2!secret#9"), ("DB_PASSWORD=correcthorsebattery", "correcthorsebattery"),
    ('api_key: "ABCDEFGHIJKLMNOPQRSTUVWX"', "ABCDEFGHIJKLMNOPQRSTUVWX"), ("secret: 7aB9xQ2", "7aB9xQ2"),
    ("see postgres://admin:s3cr3tPw9@db.host/x", "s3cr3tPw9"), ('{"client_secret": "Zq8!vv2k"}', "Zq8!vv2k"),
    ("Authorization: Bearer abc123DEF456ghi", "abc123DEF456ghi"),
]
HARMLESS = ["token = None", 'password = os.environ["X"]', "access: free for all", "the key: a word about it", "password: ${DB_PASSWORD}", "monkey: banana7",
            "https://user:password@host/", "the pass: 12 of 14", "secret: your-secret", "", "key =", "password: İİ", "=" * 5000, "key=" * 3000]


def test_values_of_telling_names_of_any_length_and_class():
    forest = secret_scan.train()
    for t, value in SECRETS:
        for before in ("", "İ ä "):
            t2 = before + t
            (found,) = secret_scan.find([t2], [None], forest)
            assert [t2[a:b] for a, b, q in found if q >= secret_scan.LEAST] == [value]
    for t, found in zip(HARMLESS, secret_scan.find(HARMLESS, [None] * len(HARMLESS), forest)):
        assert not [t[a:b] for a, b, q in found if q >= secret_scan.LEAST]
        assert all(a[1] <= b[0] for a, b in zip(found, found[1:]))


def test_held_out_findings_cut_by_the_scanner():
    forest = secret_scan.train()
    snippets = secret_scan._snippets(1500, seed=41)
    texts = [before + c + after for before, c, after, _, _ in snippets]
    found = secret_scan.find(texts, [x[3] for x in snippets], forest)
    hit = [any(a < len(x[0]) + len(x[1]) and b > len(x[0]) and q >= secret_scan.LEAST for a, b, q in f) for x, f in zip(snippets, found)]
    truth = [x[4] for x in snippets]
    caught = sum(h and y for h, y in zip(hit, truth))
    assert caught / sum(truth) > 0.95 and caught / sum(hit) > 0.97


def test_scan_and_redact_agree_with_find(spark):
    texts = [t for t, _ in SECRETS] + HARMLESS + [None, "plain words only"]
    docs = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "doc_id long, text string, source string").repartition(3)
    forest = secret_scan.train()
    want = {(i, a, b, q >= secret_scan.LEAST) for i, f in enumerate(secret_scan.find([t or "" for t in texts], [None] * len(texts), forest)) for a, b, q in f}
    assert {(r["id"], r["start"], r["end"], r["is_secret"]) for r in secret_scan.scan(docs, forest).collect()} == want
    clean = {r["doc_id"]: r["text"] for r in secret_scan.redact(docs, forest).collect()}
    assert all(clean[i] == t.replace(v, secret_scan.MARK) for i, (t, v) in enumerate(SECRETS))
    assert all(clean[i] == texts[i] for i in range(len(SECRETS), len(texts)))
