"""Secret scanning with a random forest that removes false positives.

Candidates are values given to a name with a telling word in it (``db_password:``,
``"apiKey" =``, ``<token>``; quoted or bare, of any length and any characters),
passwords inside links (``scheme://user:password@host``), and elsewhere long runs
of token characters that hold a digit or a change from lower to upper case.  Where
they overlap, the named value is the candidate.  Each gets features of its length, its character classes and
transitions, the share of it that dictionary words cover, its path and the words
next to it; a random forest, grown in numpy from labelled findings, tells secrets
from checksums, identifiers, numbers, names and placeholders.  The labelled
findings are generated from a fixed seed, and cut out by the scanner's own
rules, unless the caller brings some; scanning
is one pass over whole texts, without a shuffle.

Defined results: null and empty texts and a null path have no candidates and no
path features; repeated rows agree; an empty table gives no rows.  ``redact``
replaces each secret by a mark and keeps every row and every other column, but
for a whole-number column ``n_chars``, which follows the new text."""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARK = "[secret]"
LEAST = 0.5  # share of the trees
CANDIDATE = re.compile(r"(?<![A-Za-z0-9_+/=.~-])[A-Za-z0-9_+/=.~-]{12,}")
PART = re.compile(r"[^=]+=*")
WORTH = re.compile(r"[0-9]|[a-z][A-Z]")
# The sign after a name, the name before it, and the value: quoted or bare. A bare
# value ends at white space, a quote, a closing tag or the next URL parameter.
SIGN = re.compile(r"=>|:=|[=:>]")
NAME_BEFORE = re.compile(r"""([A-Za-z0-9_-]+)[\"'\]]{0,2}[ \t]{0,8}\Z""")
VALUE = re.compile(
    r"""[ \t]*+(?:(?i:bearer|basic|token)[ \t]++)?(?:(["'`])((?:(?!\1)[^\n])++)\1|((?:(?!</|&[\w.-]{1,64}=)[^\s"'`])++))"""
)
IN_LINK = re.compile(r"""://[^\s/:@"'`]*+:([^\s/"'`]+)@""")
LINK_BEFORE = re.compile(r"""://[^\s/:@"'`]*:\Z""")
REFERENCE = re.compile(r"""\A(?:[$%{<&*(]|[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)+\Z|[A-Za-z_][\w.]*[(\[])""")
CONTEXT = 48  # characters before and after a candidate that its neighbours are read from

# Words that make a neighbour, a path or a candidate telling.
KEY_WORDS = frozenset("token secret key apikey password passwd pwd pass auth bearer authorization credential credentials private access signature passphrase".split())
# Fixed value: ends of a glued name that make it telling (dbpassword, userToken).
KEY_ENDS = ("token", "secret", "password", "passwd", "passphrase", "pwd", "apikey", "credentials")
BENIGN_WORDS = frozenset(
    "commit sha sha1 sha256 md5 hash checksum digest integrity version uuid guid etag isbn doi revision build id order invoice account phone call "
    "card page chapter article example sample placeholder build ref tag".split()
)
TEST_PATHS = frozenset("test tests testing example examples sample samples doc docs fixture fixtures mock spec readme lock".split())
CONFIG_PATHS = frozenset("env config conf settings secrets credentials yml yaml ini properties tfvars json toml".split())
DICTIONARY = frozenset(
    "the and for that with this from have not are was but all can out one has new more will home page about search free other information time "
    "they site what which their news there only when here who also now help get view first been would how were service product date name user "
    "file data value string number code type list table test example sample change your you insert enter replace dummy fake foo bar baz hello world "
    "color width height style image index main module import export function class object array return public static final default system "
    "config server client request response session cookie domain local host mail http https www com org net html path folder version build release "
    "password token secret key here none null true false undefined todo placeholder demo admin root login access".split()
)
NAMES = ("length", "digits", "upper", "lower", "marks", "class_changes", "transitions", "entropy", "hexadecimal", "dictionary", "vowels", "key_word",
         "assigned", "quoted", "benign_word", "test_path", "config_path", "dots", "only_digits", "mail_or_link", "placeholder", "in_link", "blanks", "reference", "password_name")


def _log_transitions() -> dict[str, float]:
    """Log frequencies of letter pairs in the dictionary, against uniform ones."""
    pairs = Counter(a + b for w in DICTIONARY for a, b in zip(w, w[1:]))
    total = sum(pairs.values()) + 0.5 * 676
    return {a + b: math.log((pairs[a + b] + 0.5) / total * 676) for a in map(chr, range(97, 123)) for b in map(chr, range(97, 123))}


TRANSITIONS = _log_transitions()


def _covered(s: str) -> int:
    """Characters inside dictionary words, longest first from the left."""
    n = i = 0
    while i < len(s) - 2:
        for k in range(min(12, len(s) - i), 2, -1):
            if s[i : i + k] in DICTIONARY:
                n += k
                i += k - 1
                break
        i += 1
    return n


def _words(s: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", s).lower())


def features(before: str, candidate: str, after: str, path: str | None) -> list[float]:
    c, n = candidate, len(candidate)
    low = c.lower()
    kind = ["d" if x.isdigit() else "u" if x.isupper() else "l" if x.islower() else "o" for x in c]
    count = Counter(kind)
    letters = [x for x in low if x.isalpha()]
    pairs = [TRANSITIONS[low[i : i + 2]] for i in range(n - 1) if low[i : i + 2] in TRANSITIONS]
    near, behind = _words(before)[-4:], _words(after)[:2]
    where = set(_words(path or ""))
    freq = Counter(c).values()
    lead = before.rstrip(" \"'`")
    return [
        math.log2(n), count["d"] / n, count["u"] / n, count["l"] / n, count["o"] / n, sum(a != b for a, b in zip(kind, kind[1:])) / n,
        sum(pairs) / len(pairs) if pairs else 0.0, -sum(f / n * math.log2(f / n) for f in freq),
        sum(x in "0123456789abcdef" for x in low) / n, _covered(low) / n, sum(x in "aeiou" for x in letters) / max(1, len(letters)),
        float(any(w in KEY_WORDS for w in near)), float(lead[-1:] in ("=", ":", ">")), float(before[-1:] in "\"'`" and after[:1] in "\"'`" and before[-1:] != ""),
        float(any(w in BENIGN_WORDS for w in near + behind)), float(bool(where & TEST_PATHS)), float(bool(where & CONFIG_PATHS)), float(c.count(".")),
        float(count["d"] == n), float(before[-1:] == "@" or after[:1] == "@" or "://" in before[-10:] or "www." in low or "://" in low),
        float(any(w in low for w in ("example", "your", "xxxx", "changeme", "placeholder", "dummy", "here"))),
        float(after[:1] == "@" and LINK_BEFORE.search(before) is not None), sum(x.isspace() for x in c) / n, float(REFERENCE.match(c) is not None),
        float(any(w.startswith("pass") or w.endswith(("password", "passwd", "pwd", "passphrase")) for w in near[-2:])),
    ]


def labelled_findings(n: int = 4000, seed: int = 17) -> list[tuple[str, str, str, str, int]]:
    """(before, candidate, after, path, is secret), about half of them secrets, as
    ``candidates`` cuts them out of the generated snippets."""
    out = []
    for before, c, after, path, secret in _snippets(n, seed):
        t = before + c + after
        for a, b in candidates(t):
            if a < len(before) + len(c) and b > len(before):
                out.append((t[max(0, a - CONTEXT) : a], t[a:b], t[b : b + CONTEXT], path, secret))
    return out


def _snippets(n: int, seed: int) -> list[tuple[str, str, str, str, int]]:
    """(before, value, after, path, is secret) of generated lines."""
    r = np.random.default_rng(seed)
    pick = lambda s: s[r.integers(len(s))]
    of = lambda chars, k: "".join(chars[i] for i in r.integers(0, len(chars), k))
    hexa, digit, b64 = "0123456789abcdef", "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    words, keys, benign = sorted(DICTIONARY), sorted(KEY_WORDS), sorted(BENIGN_WORDS)
    text = lambda: " ".join(pick(words) for _ in range(4)) + " "
    low = "abcdefghijklmnopqrstuvwxyz"
    case = lambda s: s.upper() if r.random() < 0.15 else s
    sign = lambda: pick([" = ", "=", ": ", " => ", ":", " := "])
    word = lambda: of(low, int(r.integers(4, 9))) if r.random() < 0.3 else pick(words)
    password = lambda: pick([
        lambda: of(b64, int(r.integers(6, 13))), lambda: of(b64 + "!@#$%^*_-+?", int(r.integers(7, 15))), lambda: word() + of(digit, pick([1, 2, 4])) + pick("!#$?*@"),
        lambda: word() + of(digit, 1) + pick("!#_-.@") + word() + pick(["", "!", "#"]) + of(digit, 1), lambda: of(b64[:26], int(r.integers(12, 28))),
        lambda: word().title() + pick("@!#$") + of(digit, 4)])()
    paths, other_paths = ["src/app.py", "config/settings.yml", ".env", "lib/client.js", "deploy.tf", "src3", "", "notes"], ["src/app.py", "tests/test_client.py", "docs/readme.md", "src3", ""]
    named = lambda: pick(["", "", "api_", "db_", "my-", "client_", "x-"]) + pick(keys)
    pass_names = ["password", "passwd", "db_password", "DB_PASSWORD", "pwd", "pass", "passphrase", "user_pass"]
    out = []
    for i in range(n):
        if i % 8 == 1:  # short or symbol-bearing values, and words run together
            q, name = pick(['"', "'", ""]), pick([pick(pass_names), pick(["secret", "client_secret", "auth_token", "api_key", "credentials"])])
            c = password()
            if r.random() < 0.35:
                name, c = pick(pass_names), "".join(word() for _ in range(int(r.integers(3, 5))))
            if r.random() < 0.08:
                name, q, c = pick(["passphrase", "db_passphrase"]), '"', " ".join(word() for _ in range(4))
            if r.random() < 0.08:
                out.append((text() + f"<{name}>", c, f"</{name}>", pick(paths), 1))
                continue
            out.append((text() + case(name) + sign() + q, c, q + pick(["\n", " ", "\nhost = "]), pick(paths), 1))
            continue
        if i % 8 == 3 and r.random() < 0.5:  # the password of a link
            before = text() + pick(["postgres", "mysql", "https", "amqp", "redis", "ftp"]) + "://" + pick([word(), "admin", "root", ""]) + ":"
            out.append((before, password(), "@" + word() + pick([".com/", ":5432/db", "/"]), pick(paths), 1))
            continue
        if i % 8 in (0, 2):  # values of telling names that are no secrets
            q, k = pick(['"', "'", "", ""]), int(r.integers(0, 8))
            name = pick([named(), named(), pick(pass_names)])
            if k == 0:
                c = pick([word(), word().title(), word().upper()])
            elif k == 1:
                c, q = pick(["None", "null", "true", "false", "True", "undefined", "optional", "required", "string", "str", of(digit, 1), of(digit, 2), of(digit, 3)]), ""
            elif k == 2:
                c, q = pick(["$" + name.upper(), "${" + name.upper() + "}", "{{" + word() + "}}", "%s", "<" + word() + ">", "$(cat", "&str", "*" * 8, "********", "{}", "[]"]), pick(["", '"'])
            elif k == 3:
                c, q = ".".join(pick(["self", "args", "config", "os", "process", "request", "settings"]) if j == 0 else word() for j in range(int(r.integers(2, 4)))), ""
            elif k == 4:
                c, q = pick(["get", "os.get", "read_", "load_", "get" + word() + ".", "hash_"]) + word() + pick(["()", "(" + word() + ")", "[" + word() + "]"]), ""
            elif k == 5:
                c, q = word() + pick(["_", "-"]) + pick(keys), pick(["", '"'])
            elif k == 6:
                c, q = " ".join(word() for _ in range(int(r.integers(2, 7)))), '"'
                name = pick(["key", "access", "signature", "token", "auth", "pass"])
            else:
                c = pick(["your" + word(), "your-" + name, "changeme", "example" + of(digit, 1), "placeholder", "xxxx", "xxxxxxxx", "your_" + word(), "dummy"])
            before, after = text() + name + sign() + q, q + pick([" ", "\n", ", ", " and "]) + text()
            if r.random() < 0.1:
                before, c, after = text() + pick(["postgres", "https"]) + "://" + pick(["user", "username", "admin"]) + ":", pick(["password", "pass", "${PASSWORD}", "$PW", "<password>"]), "@host/"
            out.append((before, c, after, pick(other_paths), 0))
            continue
        if i % 2:
            c = pick([lambda: of(hexa, pick([32, 40, 40, 64])), lambda: of(b64, int(r.integers(20, 48))), lambda: "AKIA" + of(b64[:26] + digit, 16),
                      lambda: "ghp_" + of(b64, 36), lambda: of(b64 + "+/", 40), lambda: "sk_live_" + of(b64, 24), lambda: of(b64, 16)])()
            q = pick(['"', '"', "'", "", "`"])
            before, after = text() + named() + sign() + q, q + pick([" ", "\n", ";", ", ", " and "]) + text()
            if r.random() < 0.15:
                before, after = text() + "Authorization: Bearer ", "\n" + text()
            if r.random() < 0.1:  # without a telling neighbour
                before, after = text(), " " + text()
                c = pick(["AKIA" + of(b64[:26] + digit, 16), "ghp_" + of(b64, 36), of(b64 + "+/", 40)])
            out.append((case(before), case(c), after, pick(paths), 1))
            continue
        form = int(r.integers(0, 11))
        q = pick(['"', "'", ""])
        before, after = text() + pick(["", "", pick(benign) + " ", pick(benign) + ": ", pick(words) + " = " + q]), pick([" ", ".", ", ", q + "\n"]) + text()
        if form == 0:
            c, before = of(hexa, pick([7, 40, 40, 64]) + 5), text() + pick(["commit ", "sha256: ", "sha256-", "checksum ", "md5 = ", "revision ", "hash: "])
        elif form == 1:
            c = "-".join(of(hexa, k) for k in (8, 4, 4, 4, 12))
            before = text() + pick(["id ", "uuid: ", "request ", "order ", ""])
        elif form == 2:
            c = of(digit, int(r.integers(12, 20)))
        elif form == 3:
            c = pick(["_", "-", "."]).join(pick(words) for _ in range(4)) + of(digit, int(r.integers(1, 4)))
        elif form == 4:
            c = "".join(pick(words).title() for _ in range(3)) + pick(words)
            c = c[0].lower() + c[1:] + "aB"
        elif form == 5:
            c = pick(["your_token_here_1", "YOUR-API-KEY-0000", "xxxxxxxxxxxxxxxx1", "example_secret_123", "changeme-changeme1", "placeholder_key_00"])
            before = text() + pick(keys) + " = " + q
        elif form == 6:
            c, before, after = f"mail{of(digit, 1)}.{pick(words)}.com", text() + of(low, 6) + "@", " " + text()
        elif form == 7:
            c, before = f"{pick(words)}.com/{pick(words)}/{of(digit, 5)}", text() + pick(["http://", "https://", "www."])
        elif form == 8:
            c = f"{of(digit, 4)}-{of(digit, 2)}-{of(digit, 2)}T{of(digit, 2)}"
        elif form == 9:
            c = "/".join(pick(words) for _ in range(3)) + f"/{pick(words)}{of(digit, 2)}.py"
        else:
            c = of(low, int(r.integers(10, 16))) + of(digit, 2)
            c = "".join(pick(words) for _ in range(3)) + of(digit, 2)
        path = pick(["src/app.py", "tests/test_client.py", "docs/readme.md", "package.lock", "src3", "", "examples/demo.py"])
        out.append((before, c, after, path, 0))
    return out


class Forest:
    """Random forest of binary trees, as flat arrays: feature (-1 for a leaf),
    threshold, left and right child, share of secrets."""

    def __init__(self, trees: int = 40, depth: int = 9, leaf: int = 3, seed: int = 23):
        self.size, self.depth, self.leaf, self.seed = trees, depth, leaf, seed
        self.trees: list[tuple[np.ndarray, ...]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Forest":
        r = np.random.default_rng(self.seed)
        tried = max(1, int(math.sqrt(x.shape[1]) + 1))
        for _ in range(self.size):
            at = r.integers(0, len(x), len(x))
            nodes: list[list[float]] = []
            todo = [(at, 0, -1, 0)]
            while todo:
                rows, depth, parent, side = todo.pop()
                me, p = len(nodes), float(y[rows].mean())
                nodes.append([-1, 0.0, -1, -1, p])
                if parent >= 0:
                    nodes[parent][2 + side] = me
                cut = self._cut(x, y, rows, r.permutation(x.shape[1])[:tried]) if depth < self.depth and 0 < p < 1 else None
                if cut:
                    nodes[me][0], nodes[me][1] = cut
                    left = x[rows, cut[0]] <= cut[1]
                    todo += [(rows[left], depth + 1, me, 0), (rows[~left], depth + 1, me, 1)]
            t = np.array(nodes)
            self.trees.append((t[:, 0].astype(int), t[:, 1], t[:, 2].astype(int), t[:, 3].astype(int), t[:, 4]))
        return self

    def _cut(self, x, y, rows, tried):
        """Feature and threshold of the least Gini impurity."""
        best, found, n = np.inf, None, len(rows)
        for f in tried:
            v = x[rows, f]
            order = np.argsort(v, kind="stable")
            v, pos = v[order], np.cumsum(y[rows][order])
            k = np.arange(1, n)
            ok = (v[1:] > v[:-1]) & (k >= self.leaf) & (n - k >= self.leaf)
            if not ok.any():
                continue
            a, b = pos[:-1], pos[-1] - pos[:-1]
            g = np.where(ok, a * (k - a) / k + b * (n - k - b) / (n - k), np.inf)
            i = int(g.argmin())
            if g[i] < best:
                best, found = g[i], (int(f), float((v[i] + v[i + 1]) / 2))
        return found

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Mean share of secrets over the trees."""
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for feature, threshold, left, right, share in self.trees:
            at = np.zeros(len(x), dtype=int)
            for _ in range(self.depth + 1):
                f = feature[at]
                go = x[rows, np.maximum(f, 0)] <= threshold[at]
                at = np.where(f < 0, at, np.where(go, left[at], right[at]))
            total += share[at]
        return total / max(1, len(self.trees))


def train(findings: list[tuple[str, str, str, str, int]] | None = None) -> Forest:
    """Forest fitted on labelled findings (generated ones if none are given)."""
    f = labelled_findings() if findings is None else findings
    return Forest().fit(np.array([features(*x[:4]) for x in f]), np.array([x[4] for x in f], dtype=float))


def _telling(name: str) -> bool:
    return any(w in KEY_WORDS or w.endswith(KEY_ENDS) for w in _words(name)[-4:])


def _named_values(text: str) -> Iterator[tuple[int, int]]:
    """Bounds of the values of telling names and of passwords in links."""
    at = 0
    for sign in SIGN.finditer(text):
        if sign.start() < at:
            continue
        name = NAME_BEFORE.search(text[max(0, sign.start() - 2 * CONTEXT) : sign.start()])
        m = VALUE.match(text, sign.end()) if name and _telling(name[1]) else None
        if m:
            k = 2 if m[2] is not None else 3
            a, b = m.span(k)
            if k == 3:
                b = a + len(m[3].rstrip(".,;:)]}>"))
            if b > a:
                yield a, b
                at = b
    for m in IN_LINK.finditer(text):
        yield m.span(1)


def candidates(text: str) -> list[tuple[int, int]]:
    """Bounds of the candidates of one text, in order and without overlaps;
    ``name=value`` has one of its own for each side of the sign."""
    out = []
    for a, b in sorted(_named_values(text)):
        if not out or a >= out[-1][1]:
            out.append((a, b))
    taken = [a for a, _ in out]
    ends = [b for _, b in out]
    for m in CANDIDATE.finditer(text):
        for part in PART.finditer(m[0]):
            padded = part[0].endswith("==") and part.end() == len(m[0])
            s = part[0] if padded else part[0].rstrip(".=-~/")
            a = m.start() + part.start()
            if len(s) >= 12 and WORTH.search(s) and bisect_right(ends, a) == bisect_left(taken, a + len(s)):
                out.append((a, a + len(s)))
    return sorted(out)


def find(texts: list[str], paths: list[str | None], forest: Forest) -> list[list[tuple[int, int, float]]]:
    """For each text the bounds and probabilities of its candidates."""
    at = [(i, a, b) for i, t in enumerate(texts) for a, b in candidates(t)]
    out: list[list] = [[] for _ in texts]
    if at:
        x = np.array([features(texts[i][max(0, a - CONTEXT) : a], texts[i][a:b], texts[i][b : b + CONTEXT], paths[i]) for i, a, b in at])
        for (i, a, b), p in zip(at, forest.predict(x)):
            out[i].append((a, b, float(p)))
    return out


def _shown(text: Column) -> Column:
    """Texts that can hold a candidate; the others need not leave the JVM."""
    return F.when(text.rlike(WORTH.pattern + "|[=:>]"), text)


def scan(docs: DataFrame, forest: Forest, id_col: str = "doc_id", text: str = "text", path: str | None = "source") -> DataFrame:
    """One row for each candidate: id, start, end (code points, exclusive),
    probability and is_secret."""
    where = docs[path].cast("string") if path else F.lit(None).cast("string")

    @F.pandas_udf("array<struct<start:long,end:long,probability:double>>")
    def run(t: pd.Series, p: pd.Series) -> pd.Series:
        found = find([x or "" for x in t], list(p), forest)
        return pd.Series([[{"start": a, "end": b, "probability": q} for a, b, q in f] for f in found])

    rows = docs.select(docs[id_col].alias("id"), F.explode(run(_shown(docs[text]), where)).alias("f"))
    return rows.select("id", "f.*", (F.col("f.probability") >= LEAST).alias("is_secret"))


def redact(docs: DataFrame, forest: Forest, text: str = "text", path: str | None = "source", mark: str = MARK) -> DataFrame:
    """``docs`` with every secret of ``text`` replaced by ``mark``."""
    where = docs[path].cast("string") if path and path in docs.columns else F.lit(None).cast("string")

    @F.pandas_udf("string")
    def run(t: pd.Series, p: pd.Series) -> pd.Series:
        texts = [x or "" for x in t]
        out = []
        for x, f in zip(texts, find(texts, list(p), forest)):
            parts, at = [], 0
            for a, b, q in f:
                if q >= LEAST:
                    parts += [x[at:a], mark]
                    at = b
            out.append("".join(parts) + x[at:] if at else None)  # null: nothing to replace
        return pd.Series(out, dtype=object)

    new = docs.withColumn(text, F.coalesce(run(_shown(docs[text]), where), docs[text]))
    if dict(docs.dtypes).get("n_chars") in ("bigint", "int"):
        new = new.withColumn("n_chars", F.coalesce(F.length(text), F.col("n_chars")).cast(dict(docs.dtypes)["n_chars"]))
    return new.select(*[F.col(f"`{c}`") for c in docs.columns])
