"""Secrets in texts, with false positives removed by a random forest (operator 8).

Patterns propose candidates: issued key formats, values assigned to words such as password or token,
private-key blocks, web tokens, and long strings of mixed characters.  Each candidate becomes
features: its length, how often its characters change class, how likely its letter pairs are in
words, how much of it dictionary words cover, its character mix and entropy, what its pattern is,
whether it lies in a path or an address, and which words stand beside it.  A forest of numpy decision
trees keeps or drops it.

Dictionary and letter pairs come from the corpus itself: words are counted over all documents, the
``most_words`` most frequent ones are the dictionary (together with some words of code and placeholders),
and pairs of letters are counted in all words.

The forest learns from a table of labelled findings: rows of before, candidate, after and label.  A user's
own can be given, of which about ``most`` are drawn by hash; without them :func:`findings` makes 4,000 from a
seed and the corpus's words, real formats against placeholders, digests, identifiers, paths and plain words.

Null and empty texts have no candidates; texts of any length are searched whole; repeated rows give repeated
results; a null id stays null; an empty table gives an empty result; other columns are not read, and kept by
:func:`redacted`.  Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lsnframe.llm.batches import mapped, pieces, small_batches
from lsnframe.llm.components import cut

# Prefixes and lengths that issuers publish (fixed values).
_ISSUED = re.compile(
    r"(?<![A-Za-z0-9])(?:A(?:KIA|SIA|GPA|IDA|ROA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,}|glpat-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|rk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35}|npm_[A-Za-z0-9]{36}|SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,})(?![A-Za-z0-9])"
)
_MARK = re.compile(r"-----(BEGIN|END) [A-Z ]{0,30}PRIVATE KEY-----")
#: What a key block without an END line holds: header lines, then all up to a hyphen.
_OPEN = re.compile(r"\s*+(?:[A-Z][A-Za-z-]{0,40}+: [^\n]*+\n)*+[^-]*+")
_JWT = re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]++\.eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]*+")
_SIGN = re.compile("[=:]")
_NAME = re.compile(
    r"(?:^|[^A-Za-z0-9])([A-Za-z0-9_.-]{0,20}(?:password|passwd|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key|auth[_-]?key|private[_-]?key|credential|apikey)s?)[\"']?[ \t]{0,3}$",
    re.I,
)
_VALUE = re.compile(r"[ \t]{0,3}(?:\"([^\"\n]{6,})\"|'([^'\n]{6,})'|([^\s\"'<>,;]{6,}))")
_LONG = re.compile(r"[A-Za-z0-9+/_-]{20,}+={0,2}")
_DIGIT, _UPPER, _LOWER = (re.compile(x) for x in ("[0-9]", "[A-Z]", "[a-z]"))
KINDS = ("issued", "block", "jwt", "assigned", "long")
_GOOD = re.compile(r"password|passwd|passphrase|pwd|secret|token|api[_-]?key|access|private|credential|auth|bearer|login", re.I)
_BAD = re.compile(
    r"example|sample|dummy|placeholder|changeme|your|test|fake|xxxx|commit|sha-?(?:1|256)|md5|digest|checksum|hash|uuid|guid|revision|version|etag|integrity|license|null|none|undefined",
    re.I,
)
_PATH = re.compile(r"[/\\][\w.-]+[/\\]|https?:|www\.|\.(?:py|js|java|md|txt|json|html?|png|jpg|so|dll)$")
#: Words of code and placeholders that a corpus of prose may lack (fixed values).
_WORDS = """
password secret token key value change changeme example sample test user admin name default config setting server client data file path class
function return string number public private import export module version build release update delete create insert select table index
column database connection request response header content message error warning debug info level service account access login here your
placeholder dummy replace undefined null none true false
""".split()  # noqa: SIM905


class Lexicon:
    """Dictionary words, and how likely letter pairs are in words."""

    def __init__(self, words: list[str], pairs: dict[str, int]) -> None:
        self.words = sorted({*words, *_WORDS})
        self.long = frozenset(w for w in self.words if len(w) > 3)
        self.longest = max(map(len, self.long))
        for w in _WORDS:
            for i in range(len(w) - 1):
                pairs[w[i : i + 2]] = pairs.get(w[i : i + 2], 0) + 1
        total = sum(pairs.values())
        #: logarithms by the two codes below 128
        self.likely = np.full(128 * 128, -9.0)
        for p, n in pairs.items():
            if p.isascii():
                self.likely[ord(p[0]) * 128 + ord(p[1])] = max(-9.0, math.log((n + 0.1) / (total + 67.6)))

    def covered(self, low: str) -> int:
        """Characters that dictionary words of four letters and more cover, overlapping ones once."""
        edge = np.zeros(len(low) + 1, np.int64)
        for m in _LETTERS.finditer(low):
            run = m[0]
            for i in range(len(run) - 3):
                for n in range(min(self.longest, len(run) - i), 3, -1):
                    if run[i : i + n] in self.long:
                        edge[m.start() + i] += 1
                        edge[m.start() + i + n] -= 1
                        break
        return int(np.count_nonzero(np.cumsum(edge)))


_LETTERS = re.compile(r"[^\W\d_]{4,}")


def lexicon(docs: DataFrame, text_col: str = "text", most_words: int = 20_000) -> Lexicon:
    """The lexicon of all words of all texts.  A word has 2 to 24 letters, and no digit stands beside it.

    Words are put into classes by how often they occur; the dictionary has the classes of the most frequent
    ones that have ``most_words`` words at most together, so no more are sent to the driver."""
    each = docs.select(F.explode(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"[^\p{L}\p{N}]+")).alias("word"))
    counted = each.where(F.length("word").between(2, 24) & ~F.col("word").rlike(r"\p{N}")).groupBy("word").agg(F.count("*").alias("n"))
    counted = cut(counted.withColumn("class", F.floor(F.log2("n") * 8).cast("int")))
    least, held = None, 0
    for r in sorted(counted.groupBy("class").agg(F.count("*").alias("words")).collect(), key=lambda r: -r["class"]):  # 504 classes at most
        held += r.words
        if held > most_words:
            break
        least = r["class"]
    top = [] if least is None else [r.word for r in counted.where(F.col("class") >= least).select("word").collect()]
    letters = F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring("word", i, F.lit(2)))
    pairs = counted.select(F.explode(letters).alias("pair"), "n").where("pair RLIKE '^[a-z][a-z]$'").groupBy("pair").agg(F.sum("n").alias("n"))
    return Lexicon(top, {r.pair: r["n"] for r in pairs.collect()})  # 676 pairs at most


def _blocks(text: str) -> list[tuple[str, int, int]]:
    """Private-key blocks from BEGIN to END; one that another BEGIN or the text's end cuts off has no END."""
    out: list[tuple[str, int, int]] = []
    begun: re.Match | None = None

    def cut_off(until: int) -> None:
        if begun:
            out.append(("block", begun.start(), _OPEN.match(text, begun.end(), until).end()))

    for m in _MARK.finditer(text):
        if m[1] == "BEGIN":
            cut_off(m.start())
            begun = m
        elif begun:
            out.append(("block", begun.start(), m.end()))
            begun = None
    cut_off(len(text))
    return out


def _rests(text: str, start: int, end: int, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """What taken spans leave of a long run, without joining characters at the ends: at least 6
    characters, like an assigned value, with digits and letters, like a run."""
    out = []
    for a, b in zip([start, *[c[2] for c in taken]], [*[c[1] for c in taken], end], strict=True):
        while a < b and text[a] in "/+_-=":
            a += 1
        while a < b and text[b - 1] in "/_-":
            b -= 1
        s = text[a : max(a, b)]
        if len(s) >= 6 and _DIGIT.search(s) and (_UPPER.search(s) or _LOWER.search(s)):
            out.append(("long", a, b))
    return out


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Kind, start and end of what the patterns propose, in order and without overlaps."""
    out: list[tuple[str, int, int]] = []
    if "-----BEGIN" in text:
        out += _blocks(text)
    if "eyJ" in text:
        out += [("jwt", *m.span()) for m in _JWT.finditer(text)]
    out += [("issued", *m.span()) for m in _ISSUED.finditer(text)]
    end = 1
    for m in _SIGN.finditer(text):
        # a sign inside a value is the value's; one after punctuation has no name before it
        if m.start() < end or not (text[m.start() - 1].isalnum() or text[m.start() - 1] in "\"' \t"):
            continue
        if _NAME.search(text, max(0, m.start() - 32), m.start()) and (v := _VALUE.match(text, m.end())):
            g = next(i for i in (1, 2, 3) if v[i] is not None)
            out.append(("assigned", *v.span(g)))
            end = v.end()
    rank = {"block": 0, "issued": 1, "jwt": 2, "assigned": 3}
    taken: list[tuple[str, int, int]] = []
    for c in sorted(out, key=lambda c: (c[1], rank[c[0]])):
        if taken and c[1] < taken[-1][2]:
            last = taken[-1]
            if c[2] > last[2]:
                taken[-1] = (min(last[0], c[0], key=rank.get), last[1], c[2])
            continue
        taken.append(c)
    long: list[tuple[str, int, int]] = []
    k = 0
    for m in _LONG.finditer(text):
        if not (_DIGIT.search(m[0]) and (_UPPER.search(m[0]) or _LOWER.search(m[0]))):
            continue
        a, b = m.span()
        while k < len(taken) and taken[k][2] <= a:
            k += 1
        n = k
        while n < len(taken) and taken[n][1] < b:
            n += 1
        # the more telling patterns know where their secrets begin and end; the rest of the run may be one too
        long += _rests(text, a, b, taken[k:n]) if n > k else [("long", a, b)]
    return sorted(taken + long, key=lambda c: c[1])


def _class_table() -> np.ndarray:
    return np.array([0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 for c in map(chr, range(0x110000))], np.int8)


_class_of: list[np.ndarray] = []


def _codes(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)


def features(kind: str, before: str, s: str, after: str, lex: Lexicon) -> list[float]:
    """All of them over the whole candidate."""
    if not _class_of:
        _class_of.append(_class_table())
    m = len(s)
    code = _codes(s)
    c = _class_of[0][code]
    low = s.lower()
    if len(low) != m:
        low = "".join(x if len(x := ch.lower()) == 1 else ch for ch in s)  # positions stay the candidate's own
    small = _codes(low)
    both = (c[:-1] < 2) & (c[1:] < 2)
    p, q = small[:-1][both], small[1:][both]
    known = (p < 128) & (q < 128)
    letters = len(p)
    likely = float((lex.likely[p[known] * 128 + q[known]].sum() - 9.0 * (letters - int(known.sum()))) / letters) if letters else -9.0
    n = np.bincount(c, minlength=4).tolist()
    seen = np.unique(code, return_counts=True)[1]
    share = seen / max(1, m)
    entropy = float(-(share * np.log2(share)).sum()) if m else 0.0
    hexed = not low.strip("0123456789abcdef")
    return [
        math.log1p(m), int(np.count_nonzero(c[1:] != c[:-1])) / max(1, m - 1), likely, lex.covered(low) / max(1, m), n[2] / max(1, m), n[1] / max(1, m), n[3] / max(1, m), entropy,
        float(hexed), len(seen) / max(1, m), float(KINDS.index(kind)), float(bool(_PATH.search(before[-12:] + s))), float(bool(_GOOD.search(before[-32:]))), float(bool(_BAD.search(before[-32:] + " " + s + " " + after[:16]))),
    ]


class Tree:
    """A binary tree in arrays: feature (-1 in leaves), threshold, children, share of secrets."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int, r: np.random.Generator) -> None:
        self.feature, self.cut, self.left, self.right, self.share = [], [], [], [], []
        self._grow(x, y, depth, r)
        self.feature, self.cut, self.left, self.right, self.share = map(np.array, (self.feature, self.cut, self.left, self.right, self.share))

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int, r: np.random.Generator) -> int:
        me = len(self.feature)
        for a, v in ((self.feature, -1), (self.cut, 0.0), (self.left, 0), (self.right, 0), (self.share, float(y.mean()))):
            a.append(v)
        if depth and len(y) >= 8 and 0 < y.mean() < 1:
            best = (y.mean() * (1 - y.mean()) - 1e-9, -1, 0.0)
            for f in r.permutation(x.shape[1])[:5]:
                order = np.argsort(x[:, f], kind="stable")
                v, ones = x[order, f], np.cumsum(y[order])
                k = np.flatnonzero(v[1:] > v[:-1]) + 1
                k = k[(k >= 2) & (k <= len(y) - 2)]
                if len(k):
                    p, q = ones[k - 1] / k, (ones[-1] - ones[k - 1]) / (len(y) - k)
                    g = (k * p * (1 - p) + (len(y) - k) * q * (1 - q)) / len(y)
                    i = int(np.argmin(g))
                    if g[i] < best[0]:
                        best = (float(g[i]), int(f), float((v[k[i]] + v[k[i] - 1]) / 2))
            if best[1] >= 0:
                go = x[:, best[1]] <= best[2]
                self.feature[me], self.cut[me] = best[1], best[2]
                self.left[me] = self._grow(x[go], y[go], depth - 1, r)
                self.right[me] = self._grow(x[~go], y[~go], depth - 1, r)
        return me

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        while True:
            f = self.feature[at]
            inner = np.flatnonzero(f >= 0)
            if not len(inner):
                return self.share[at]
            i = at[inner]
            at[inner] = np.where(x[inner, f[inner]] <= self.cut[i], self.left[i], self.right[i])


class Forest:
    def __init__(self, x: np.ndarray, y: np.ndarray, lex: Lexicon, trees: int = 30, depth: int = 9, seed: int = 3) -> None:
        r = np.random.default_rng(seed)
        self.lex, self.trees = lex, []
        for _ in range(trees):
            rows = r.integers(0, len(y), len(y))
            self.trees.append(Tree(x[rows], y[rows].astype(float), depth, r))

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.mean([t.predict(x) for t in self.trees], axis=0)


def generated(lex: Lexicon, n: int = 4000, seed: int = 17) -> list[tuple[str, str, str, int]]:
    """Labelled findings (before, candidate, after, 1 for a secret) made from a seed and the words of a lexicon."""
    r = random.Random(seed)
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    many = lambda a, k: "".join(r.choice(a) for _ in range(k))
    words = [w for w in lex.words if w.isascii()]
    word = lambda: r.choice(words)
    prose = lambda: " ".join(word() for _ in range(r.randint(0, 4))) + " "
    given = lambda: r.choice(
        ["password=", "token = \"", "secret: ", "api_key=", "PASSWORD=", "access_key = '", "auth_token: ", "pwd=", "client_secret=", "db_password: "]
    )
    out = []
    for i in range(n):
        kind = i % 18
        end = r.choice([" ", "\n", ". ", "\" ", ""]) + prose()
        if kind == 0:
            row = (prose(), r.choice(["AKIA", "ASIA"]) + many(upper + digits, 16), end, 1)
        elif kind in (1, 2):
            row = (prose() + given(), many("0123456789abcdef", r.choice([18, 20, 24, 32, 40, 64])), end, 1)
        elif kind == 3:
            row = (prose() + given(), many(lower + upper + digits, r.randint(12, 48)), end, 1)
        elif kind == 4:
            row = (prose(), r.choice(["ghp_", "gho_", "npm_"]) + many(lower + upper + digits, 36), end, 1)
        elif kind == 5:
            row = (prose() + given(), many(lower + upper + digits + "!@#$%^&*", r.randint(8, 20)), end, 1)
        elif kind == 6:
            row = (
                prose(),
                "eyJ" + many(lower + upper + digits, 30) + ".eyJ" + many(lower + upper + digits, 60) + "." + many(lower + upper + digits + "-_", 43),
                end,
                1,
            )
        elif kind == 7:
            issued = r.choice(["AKIA", "ASIA"]) + many(upper + digits, 16) + r.choice("/:+_-")
            row = (
                prose() + r.choice(["bearer ", "credential ", "secret key ", issued]), many(lower + upper + digits + "+/", r.randint(32, 88)), end, 1
            )
        elif kind == 8:
            row = (
                prose() + given(),
                r.choice(
                    [
                        "changeme",
                        "your_password_here",
                        "your-token-here",
                        "xxxxxxxx",
                        "********",
                        "placeholder",
                        "example",
                        "undefined",
                        "${SECRET}",
                        "<password>",
                        "os.environ",
                        "None1234",
                        "testtest",
                        "password",
                    ]
                ),
                end,
                0,
            )
        elif kind == 9:
            row = (
                prose() + r.choice(["commit ", "sha1 ", "sha256: ", "md5=", "revision ", "digest ", "checksum: ", "etag: "]),
                many("0123456789abcdef", r.choice([32, 40, 64])),
                end,
                0,
            )
        elif kind == 10:
            row = (prose(), "-".join(many("0123456789abcdef", k) for k in (8, 4, 4, 4, 12)), end, 0)
        elif kind == 11:
            row = (
                prose() + r.choice(["/usr/", "https://host/", "src/", "C:/"]),
                "/".join(word() for _ in range(r.randint(3, 6))) + r.choice([".py", ".html", ".txt", "2"]),
                end,
                0,
            )
        elif kind == 12:
            row = (prose() + given(), "_".join(word() for _ in range(r.randint(2, 4))), end, 0)
        elif kind == 13:
            row = (prose(), "".join(word().capitalize() for _ in range(r.randint(4, 7))) + r.choice(["", many(digits, 2)]), end, 0)
        elif kind == 14:
            row = (prose(), r.choice(["-", "_"]).join(word() for _ in range(r.randint(3, 6))) + "-" + many(digits, r.randint(1, 4)), end, 0)
        elif kind in (16, 17):
            name = r.choice(["", "RSA ", "EC ", "DSA ", "OPENSSH ", "ENCRYPTED "])
            head, line = r.choice(
                ["", "", "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC," + many("0123456789ABCDEF", 32) + "\n\n"]
            ), r.choice(["\n", "\n", "\\n", " "])
            if kind == 16:
                body = line.join(many(lower + upper + digits + "+/", 64) for _ in range(r.randint(1, 60)))
            else:
                body = r.choice(
                    [
                        "",
                        "...",
                        "<key>",
                        "YOUR KEY HERE",
                        "your-private-key",
                        "xxxxxxxx",
                        "[REDACTED]",
                        " ".join(word() for _ in range(r.randint(1, 40))),
                    ]
                )
            row = (
                prose(),
                f"-----BEGIN {name}PRIVATE KEY-----{line}{head}{body}" + r.choice(["", *[f"{line}-----END {name}PRIVATE KEY-----"] * 4]),
                end,
                int(kind == 16),
            )
        else:
            row = (prose(), r.choice(["=", "-", "_"]) * r.randint(20, 60) + many(digits, r.randint(0, 2)), end, 0) if r.random() < 0.5 else (
                prose() + r.choice(["", "id ", "no. "]), many(digits, r.randint(16, 24)) + r.choice(["", "a"]), end, 0
            )
        out.append(row)
    return out


def _kind_of(before: str, s: str) -> str:
    if _ISSUED.fullmatch(s):
        return "issued"
    if s.startswith("-----BEGIN"):
        return "block"
    if _JWT.fullmatch(s):
        return "jwt"
    return "assigned" if (m := re.search("[=:][ \t\"']{0,4}$", before)) and _NAME.search(before, max(0, m.start() - 32), m.start()) else "long"


def train(rows: list[tuple[str, str, str, int]], lex: Lexicon) -> Forest:
    x = np.array([features(_kind_of(b, s), b, s, a, lex) for b, s, a, _ in rows])
    return Forest(x, np.array([int(y) for *_, y in rows]), lex)


def findings(spark: SparkSession, lex: Lexicon, n: int = 4000, seed: int = 17) -> DataFrame:
    """A table of made-up labelled findings."""
    return spark.createDataFrame(generated(lex, n, seed), "before string, candidate string, after string, label int")


def learn(labelled: DataFrame, lex: Lexicon, most: int = 20_000) -> Forest:
    """A forest from the columns before, candidate, after and label (0 or 1) of labelled findings; from
    made-up ones if there are none."""
    rows = labelled.where("candidate IS NOT NULL AND label IN (0, 1)").select(
        F.coalesce("before", F.lit("")).alias("b"), "candidate", F.coalesce("after", F.lit("")).alias("a"), "label"
    )
    n = rows.count()
    drawn = rows.where(F.pmod(F.xxhash64("b", "candidate", "a"), F.lit(1_000_000)) < 1_000_000 * min(1.0, most / max(1, n))).orderBy(
        "candidate", "b", "a", "label"
    ).collect()
    return train([tuple(r) for r in drawn] or generated(lex), lex)


def fitted(docs: DataFrame, labelled: DataFrame | None = None, text_col: str = "text") -> Forest:
    """The forest for a corpus: its lexicon, and labelled findings or made-up ones."""
    lex = lexicon(docs, text_col)
    return learn(findings(docs.sparkSession, lex) if labelled is None else labelled, lex)


def find(texts: list[str | None], forest: Forest, threshold: float = 0.5) -> list[tuple[int, list[tuple[str, int, int]]]]:
    """For each text the number of candidates and those that the forest keeps."""
    found = [candidates(t) if t else [] for t in texts]
    x = [features(k, t[max(0, a - 40) : a], t[a:b], t[b : b + 20], forest.lex) for t, c in zip(texts, found, strict=True) for k, a, b in c]
    keep = iter((forest.predict(np.array(x)) >= threshold).tolist() if x else [])
    return [(len(c), [y for y in c if next(keep)]) for c in found]


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    out, at = [], 0
    for kind, a, b in spans:
        out += [text[at:a], f"<{kind.upper()}_SECRET>"]
        at = b
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, forest: Forest | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_candidates, n_secrets, secrets (kind:start:end) and the redacted text's SHA-256."""
    forest = forest or fitted(docs, text_col=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in pieces(batch.column(1)):
                got = find(texts, forest)
                sha = [sha256(redact(t or "", s).encode()).hexdigest() for t, (_, s) in zip(texts, got, strict=True)]
                said = [",".join(f"{k}:{i}:{j}" for k, i, j in s) for _, s in got]
                columns = [
                    pa.array([n for n, _ in got], pa.int64()),
                    pa.array([len(s) for _, s in got], pa.int64()),
                    pa.array(said, pa.string()),
                    pa.array(sha, pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), *columns], ["doc_id", "n_candidates", "n_secrets", "secrets", "redacted_sha256"]
                )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return mapped(rows, run, f"doc_id {kind}, n_candidates long, n_secrets long, secrets string, redacted_sha256 string")


def redacted(docs: DataFrame, forest: Forest | None = None, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """All rows and columns with the secrets in the texts replaced, and the length column brought up to date."""
    forest = forest or fitted(docs, text_col=text_col)

    small_batches(docs.sparkSession)

    @F.arrow_udf("string")
    def clean(column: pa.Array) -> pa.Array:
        out = []
        for _, _, texts in pieces(column):
            out += [t and redact(t, s) for t, (_, s) in zip(texts, find(texts, forest), strict=True)]
        return pa.array(out, pa.string())

    out = docs.withColumn(text_col, clean(F.col(text_col)))
    return out.withColumn(length_col, F.length(text_col).cast(docs.schema[length_col].dataType)) if length_col in docs.columns else out
