"""Personal data by weak supervision (operator 3).

Four base kinds are fixed patterns whose matches always stand: email, ip, card, phone.  Further
candidates (national phone numbers, social-security numbers, IBANs, 13 to 15 digit cards, IPv6 and
MAC addresses, disguised emails) are put to labelers that vote yes, no or nothing: a strict pattern,
a checksum, a gazetteer of published prefixes and lengths, words before the span, words that speak against
it, and its borders.  The votes of all candidates of all documents, base matches included, are counted by
signature; expectation-maximisation over these counts estimates each labeler's reliability, its
posteriors train a logistic span classifier, and it alone decides which candidates are added.

The signatures are at most a few ten thousand whatever the corpus, so their counts go to the driver.

Null and empty texts have no spans, an empty table gives an empty result.  Repeated rows give repeated
results; a null id stays null; other columns are not read.  Texts of any length are searched whole.  Offsets are code points, ends exclusive.  Every pattern takes time in
proportion to the text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from hashlib import sha256
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lsnframe.llm.batches import mapped, pieces

BASE = ("email", "ip", "card", "phone")
MORE = ("phone_national", "ssn", "iban", "card_short", "ipv6", "mac", "email_disguised")
KINDS = BASE + MORE
LABELERS = 6

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a match never starts inside a run of digits: its start would have matched or failed alike
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_MORE = {
    "phone_national": re.compile(r"(?<![0-9])\(?[2-9][0-9]{2}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"),
    "ssn": re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "card_short": re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,14}(?![ -]?[0-9])"),
    "ipv6": re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"),
    "mac": re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}(?![0-9A-Fa-f:])"),
    "email_disguised": re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?[\[(]at[\])] ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|[\[(]dot[\])]) ?[A-Za-z0-9-]{2,63}){1,4}"),
}
_FOR = re.compile(
    r"(?:e-?mails?|mail|contact|write|reach|phones?|tel(?:efon|ephone|éfono)?|call|mobile|fax|cards?|visa|amex|iban|konto|account|compte|cuenta|ssn|social|security|ip|host|server|mac|address|adresse)\W{0,4}$",
    re.I,
)
_AGAINST = re.compile(r"(?:isbn|issn|doi|version|ver|v|order|invoice|page|line|section|rfc|build|sku|part|no|nr|id|figure|table)\W{0,4}$", re.I)
_DIGITS = re.compile("[0-9]")
# Published prefixes and lengths (fixed values).
_DOMAINS = frozenset("com org net edu gov mil int info biz name pro museum coop aero jobs mobi travel tel cat asia post app dev io ai".split())  # besides two letters: countries
_CALLING = frozenset(
    "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
)
#: First digits of the zones whose country codes have three.
_CALLING_3 = frozenset("21 22 23 24 25 26 29 35 37 38 42 50 59 67 68 69 80 85 87 88 96 97 99".split())
#: First and last prefix of card issuers.
_CARDS = [
    (4, 4),
    (51, 55),
    (2221, 2720),
    (34, 34),
    (37, 37),
    (36, 36),
    (38, 39),
    (300, 305),
    (3528, 3589),
    (6011, 6011),
    (644, 649),
    (65, 65),
    (62, 62),
    (50, 50),
    (56, 58),
    (60, 60),
    (63, 63),
    (67, 69),
]
#: Lengths of account numbers by country.
_IBAN = dict(
    x.split(":") for x in "AD:24 AE:23 AL:28 AT:20 AZ:28 BA:20 BE:16 BG:22 BH:22 BR:29 CH:21 CR:22 CY:28 CZ:24 DE:22 DK:18 DO:28 EE:20 EG:29 ES:24 FI:18 FO:18 FR:27 GB:22 GE:22 GI:23 GL:18 GR:27 GT:28 HR:21 HU:28 IE:22 IL:23 IS:26 IT:27 JO:30 KW:30 KZ:20 LB:28 LI:21 LT:20 LU:20 LV:21 MC:27 MD:24 ME:22 MK:19 MR:27 MT:31 MU:30 NL:18 NO:15 PK:24 PL:28 PS:29 PT:25 QA:29 RO:24 RS:22 SA:24 SE:24 SI:19 SK:24 SM:27 TN:24 TR:26 UA:29 VG:24 XK:20".split()
)


def _listed(kind: str, span: str, digits: str) -> int:
    """The gazetteer's vote: 1 for a prefix that is given out, -1 for one that isn't, 0 where prefixes say nothing."""
    if kind in ("email", "email_disguised"):
        top = re.split(r"[^A-Za-z0-9-]+", span.rstrip("])"))[-1].lower()
        return 1 if top in _DOMAINS or (len(top) == 2 and top.isalpha()) else -1
    if kind == "phone":
        return 1 if digits[:1] in ("1", "7") or digits[:2] in _CALLING or digits[:2] in _CALLING_3 else -1
    if kind in ("card", "card_short"):
        return 1 if any(lo <= int(digits[: len(str(lo))] or 0) <= hi for lo, hi in _CARDS) else -1
    if kind == "iban":
        return 1 if _IBAN.get(span[:2]) == str(len(span.replace(" ", ""))) else -1
    if kind == "ip":
        return -1 if digits and int(span.split(".")[0]) in (0, *range(224, 256)) else 1
    if kind == "ssn":
        return -1 if digits[:3] in ("000", "666") or digits[0] == "9" else 0
    if kind == "mac":
        return -1 if int(span[1], 16) & 1 else 0  # a group address belongs to nobody
    return 0


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            end = m.end()
        # characters before a failed sign can't belong to a later match: the sign parts them
        at = text.find("@", max(end, at + 1))


def base_spans(text: str) -> tuple[dict[str, list[tuple[int, int]]], list[tuple[str, int, int]]]:
    """The base spans of each kind, and the matches that failed their test."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in BASE}
    failed = []
    found["email"] = list(_emails(text))
    if _DIGITS.search(text):
        for m in _IP.finditer(text):
            ok = all(len(p.lstrip("0")) < 3 or (len(p.lstrip("0")) == 3 and int(p) <= 255) for p in m[0].split("."))
            found["ip"].append(m.span()) if ok else failed.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13:
                d = m[0].replace(" ", "").replace("-", "")
                ok = 16 <= len(d) <= 19 and luhn(d)
                found["card"].append(m.span()) if ok else failed.append(("card", *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                ok = 8 <= sum(c.isdigit() for c in m[0]) <= 15
                found["phone"].append(m.span()) if ok else failed.append(("phone", *m.span()))
    return found, failed


def more_candidates(text: str, base: dict[str, list[tuple[int, int]]]) -> list[tuple[str, int, int]]:
    """Candidates that overlap no base span and no earlier candidate."""
    taken = sorted(s for spans in base.values() for s in spans)
    reach = list(accumulate((e for _, e in taken), max))
    out = []
    digits = _DIGITS.search(text) is not None
    for kind, pattern in _MORE.items():
        if (kind == "email_disguised" and ("(at" in text or "[at" in text)) or (kind in ("ipv6", "mac") and ":" in text) or (
            kind not in ("email_disguised", "ipv6", "mac") and digits
        ):
            out += [(kind, *m.span()) for m in pattern.finditer(text)]
    free, last, i = [], 0, 0
    for kind, a, b in sorted(out, key=lambda x: (x[1], -x[2], KINDS.index(x[0]))):
        while i < len(taken) and reach[i] <= a:
            i += 1
        if a >= last and (i == len(taken) or taken[i][0] >= b):
            last = b
            free.append((kind, a, b))
    return free


def _votes(kind: str, text: str, a: int, b: int, passed: bool | None) -> tuple[int, ...]:
    """One vote of each labeler: 1 yes, -1 no, 0 nothing."""
    span = text[a:b]
    digits = "".join(c for c in span if "0" <= c <= "9")
    before, after = text[max(0, a - 24) : a], text[b : b + 1]
    strict = {
        "phone_national": lambda: digits[3:4] not in ("0", "1") and digits[3:6] != "911", "ssn": lambda: digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000",
        "iban": lambda: 15 <= len(span.replace(" ", "")) <= 34, "card_short": lambda: len(digits) == 15 or digits[0] == "4", "ipv6": lambda: True, "mac": lambda: True, "email_disguised": lambda: True,
    }.get(kind, lambda: passed)()
    check = 0
    if kind in ("card", "card_short"):
        check = 1 if luhn(digits) else -1
    elif kind == "iban":
        s = span.replace(" ", "")
        check = 1 if int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1 else -1
    elif digits and len(set(digits)) == 1:
        check = -1
    listed = _listed(kind, span, digits)
    border = -1 if (before[-1:].isalnum() or before[-1:] in "-/_" and before or after.isalnum() or after in ("-", "/", "_")) else 1
    return (1 if strict else -1, check, listed, 1 if _FOR.search(before) else 0, -1 if _AGAINST.search(before) else 0, border)


def signature(kind: str, text: str, a: int, b: int, passed: bool | None = None) -> int:
    """Kind, votes, and buckets of length and digit share in one number."""
    n = b - a
    digits = sum("0" <= c <= "9" for c in text[a:b])
    s = KINDS.index(kind)
    for v in _votes(kind, text, a, b, passed):
        s = s * 3 + v + 1
    return (s * 4 + min(3, n // 8)) * 3 + (0 if digits * 3 < n else 1 if digits * 3 < 2 * n else 2)


def _unpack(sig: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kinds, votes and one-hot features of signatures."""
    share, length, s = sig % 3, sig // 3 % 4, sig // 12
    votes = np.empty((len(sig), LABELERS), np.int64)
    for i in reversed(range(LABELERS)):
        votes[:, i] = s % 3 - 1
        s = s // 3
    x = np.concatenate([np.eye(len(KINDS))[s], *(np.eye(3)[votes[:, i] + 1] for i in range(LABELERS)), np.eye(4)[length], np.eye(3)[share]], axis=1)
    return s, votes, x


class SpanModel:
    """Labeler reliabilities and the classifier trained on their posteriors."""

    def __init__(self, counts: dict[int, int]) -> None:
        self.accepted: dict[int, bool] = {}
        self.weights: np.ndarray | None = None
        self.reliability: np.ndarray | None = None
        if not counts:
            return
        sig = np.array(sorted(counts), np.int64)
        n = np.array([counts[s] for s in sig.tolist()], float)
        kinds, votes, x = _unpack(sig)
        # start: the sum of votes; then reliabilities P(vote | class) and a prior for each kind
        q = 1 / (1 + np.exp(-1.5 * votes.sum(1)))
        for _ in range(50):
            prior = np.array([((n * q)[kinds == k].sum() + 1) / (n[kinds == k].sum() + 2) for k in range(len(KINDS))])
            p = np.empty((LABELERS, 3, 2))
            for i in range(LABELERS):
                for v in range(3):
                    m = votes[:, i] == v - 1
                    p[i, v] = (n * q)[m].sum() + 1, (n * (1 - q))[m].sum() + 1
                if i != 1:
                    p[i, 2, 0] += 2  # a yes is likelier for personal data, a no for others
                    p[i, 0, 1] += 2
            p /= p.sum(1, keepdims=True)
            logit = np.log(prior[kinds]) - np.log(1 - prior[kinds])
            for i in range(LABELERS):
                logit += np.log(p[i, votes[:, i] + 1, 0]) - np.log(p[i, votes[:, i] + 1, 1])
            q = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        self.reliability = p
        w = np.zeros(x.shape[1])
        weight = np.sqrt(n) / np.sqrt(n).sum()
        for _ in range(2000):
            z = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            w -= 4.0 * (x.T @ (weight * (z - q)) + 1e-4 * w)
        self.weights = w

    def accepts(self, sig: int) -> bool:
        if sig not in self.accepted:
            ok = False
            if self.weights is not None:
                ok = bool(_unpack(np.array([sig], np.int64))[2][0] @ self.weights > 0)
            self.accepted[sig] = ok
        return self.accepted[sig]


def signatures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """signature and n: how often each one occurs among the candidates of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter[int] = Counter()
            for t in (t for _, _, texts in pieces(batch.column(0)) for t in texts):
                if t:
                    base, failed = base_spans(t)
                    seen.update(signature(k, t, *s, True) for k, spans in base.items() for s in spans)
                    seen.update(signature(k, t, a, e, False) for k, a, e in failed)
                    seen.update(signature(k, t, a, e) for k, a, e in more_candidates(t, base))
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], ["signature", "n"])

    return mapped(docs.select(F.col(text_col).alias("text")), run, "signature long, n long").groupBy("signature").agg(F.sum("n").alias("n"))


def find(text: str | None, model: SpanModel) -> tuple[dict[str, list[tuple[int, int]]], list[tuple[str, int, int]]]:
    """Base spans by kind and the accepted further spans."""
    if not text:
        return {k: [] for k in BASE}, []
    base, _ = base_spans(text)
    return base, [(k, a, b) for k, a, b in more_candidates(text, base) if model.accepts(signature(k, text, a, b))]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256, spans, n_added and n_spans (all of them) of every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    model = SpanModel({r.signature: r.n for r in signatures(rows).collect()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts: dict[str, list[int]] = {k: [] for k in BASE}
            shas, spans, added, total = [], [], [], []
            for t in (t for _, _, texts in pieces(b.column(1)) for t in texts):
                base, more = find(t, model)
                for k in BASE:
                    counts[k].append(len(base[k]))
                said = [f"{k}:{a}:{e}" for k in BASE for a, e in base[k]]
                shas.append(sha256(",".join(said).encode()).hexdigest())
                more = [f"{k}:{a}:{e}" for k, a, e in sorted(more, key=lambda x: (KINDS.index(x[0]), x[1]))]
                spans.append(",".join(said + more))
                added.append(len(more))
                total.append(len(said) + len(more))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    *(pa.array(counts[k], pa.int64()) for k in BASE),
                    pa.array(shas, pa.string()),
                    pa.array(spans, pa.string()),
                    pa.array(added, pa.int64()),
                    pa.array(total, pa.int64()),
                ],
                ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added", "n_spans"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return mapped(rows, run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long")
