"""Personal data and secrets: candidate spans scored by gradient boosting.

High-recall generators (lax patterns) propose overlapping spans; a boosted
ensemble of shallow trees scores each from its format (check digits, octets,
entropy, separators, ...) and its context (neighbouring characters and words);
probabilities are calibrated on held-out candidates, and a threshold per kind
selects the spans to redact.  Among overlapping spans the likeliest, then the
longest, then the first wins.  The trees are trained here on generated
candidates: formats of many countries and vendors, and look-alikes such as
dates, prices, versions, order numbers and hashes in prose.

Defined results: a null text stays null with no spans, an empty one stays empty.
Every row is treated alone, so repeated rows give repeated results; other columns pass
through unchanged whatever their names, but ``n_chars`` follows a changed text
(it is left as it was, null included, where the text didn't change).
Positions count characters of the original text.  A text of any length is searched whole;
no part of a pattern is bounded but digits and signs of the formats themselves.  Ties go to
the span that begins first.  An empty table gives no rows.

A row is left out of a generator's search only if a condition that the pattern implies fails
(``possible``): too few digits or signs, no name of a secret, no long enough run.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as X
from .workspace import documents

KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "secret")
_KEY = r"(?ai:(?:api|access|auth|secret|private|client|session)[ _-]?(?:key|token|secret|id)|token|secret|passw(?:or)?d|passwd|pwd|bearer|authorization|credential)"
_HEAD = r"(?ai:key|token|secret|pass|pwd|pat|sig|auth|cred|bearer)"
_ASSIGN = r"[\"']?[ \t]*+(?:=>|:=|[:=])[ \t]*+"
_GIVEN = rf"{_KEY}[\"']?\s*(?:=>|[:=]|is)\s*|{_HEAD}[\w.\-]*{_ASSIGN}"
_NAMED = re.compile(rf"(?<![\w.\-])([\w.\-]++){_ASSIGN}")
_VALUE = re.compile(r"[\"']?([^\s\"']{6,})")
_HEAD_IN = re.compile(_HEAD)


def _given(text: str) -> Iterator[tuple[int, int]]:
    """Values given to an identifier that holds a secret's name; other identifiers' values are looked into."""
    at = 0
    while (m := _NAMED.search(text, at)) is not None:
        v = _VALUE.match(text, m.end()) if _HEAD_IN.search(m[1]) else None
        if v is not None:
            yield v.span(1)
        at = m.end() if v is None else v.end()


def _matches(pattern: str, group: int = 0) -> Callable[[str], Iterator[tuple[int, int]]]:
    find = re.compile(pattern).finditer
    return lambda text: (m.span(group) for m in find(text))


@dataclass(frozen=True)
class Generator:
    """A kind's lax pattern, and what a text must have for it to match: digits, of any script, and signs at least, or a test."""

    kind: str
    spans: Callable[[str], Iterator[tuple[int, int]]]
    digits: int = 0
    signs: tuple[tuple[str, int], ...] = ()
    needs: str = ""


GENERATORS = (
    # a local part is tried from its start only, and what follows may overlap the next one
    Generator("email", _matches(r"(?<![\w.%+\-'])(?=([\w.%+\-']++@[\w\-]++(?:\.[\w\-]++)*+))", 1), signs=(("@", 1),)),
    Generator("ip", _matches(r"(?<![\d.])\d{1,4}(?:\.\d{1,4}){3}(?![\d])"), 4, ((".", 3),)),
    Generator("ip", _matches(r"(?<![\w:])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{1,4}(?![\w:])"), 0, ((":", 2),)),
    Generator("card", _matches(r"(?<!\d)\d(?:[ \-]?\d){11,18}(?!\d)"), 12),
    Generator("card", _matches(r"(?<!\d)(?:\d{13,19}|\d{4}([ \-])\d{4}\1\d{4}\1\d{4}|\d{4}[ \-]\d{6}[ \-]\d{5})(?!\d)"), 13),
    Generator("phone", _matches(r"(?<![\w.])(?:\+\d{1,3}[ .\-]?)?(?:\(\d{2,4}\)[ .\-]?|\d{2,4}[ .\-])\d{3,4}[ .\-]\d{4}(?!\d)"), 9),
    Generator("phone", _matches(r"(?<![\w.])(?:\+|00)?\(?\d(?:[ .()/\-]{0,2}\d){6,14}(?!\d)"), 7),
    Generator("iban", _matches(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{1,4}){3,8}(?!\w)"), 2),
    Generator("ssn", _matches(r"(?<![\d\-])\d{3}[ \-]\d{2}[ \-]\d{4}(?![\d\-])"), 9),
    Generator("secret", _matches(rf"(?<![A-Za-z]){_KEY}(?:[\"']?\s*(?:=>|[:=]|is)\s*|\s+)([\"']?)([^\s\"']{{6,}})(\1)", 2), needs="key"),
    Generator("secret", _given, needs="name"),
    Generator("secret", _matches(r"(?<![\w+/\-])[A-Za-z0-9_+/\-]{16,}={0,2}(?![\w+/=])"), needs="run"),
)
_WORDS = {
    "phone": "phone tel telephone call mobile cell fax whatsapp sms contact dial".split(),
    "card": "card visa mastercard amex credit debit payment pay cc billing".split(),
    "ip": "ip host address server client from ping login".split(),
    "ssn": "ssn social security".split(),
    "iban": "iban account bank transfer".split(),
    "secret": "token secret key password passwd pwd api auth bearer credential".split(),
    "number": "order invoice version isbn item part serial ticket id no page figure section release build sku ean population total ref".split(),
    "date": "date year on since until born january february march april may june july august september october november december".split(),
}
_CONTEXT = {w: i for i, ws in enumerate(_WORDS.values()) for w in ws}
_TRIM = ".,;:'-"


@dataclass(frozen=True)
class Params:
    rows: int = 12000
    rounds: int = 120
    depth: int = 4
    rate: float = 0.2
    bins: int = 32
    recall: float = 0.995
    seed: int = 11


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def mod97(s: str) -> bool:
    s = s.replace(" ", "")
    try:
        return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1
    except ValueError:
        return False


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of every generator's spans; they may overlap."""
    return _spans(text, GENERATORS)


def _spans(text: str, generators: Iterable[Generator]) -> list[tuple[int, int, int]]:
    out = set()
    for g in generators:
        kind, k = g.kind, KINDS.index(g.kind)
        for a, b in g.spans(text):
            while a < b and kind in ("email", "phone", "iban") and text[b - 1] in _TRIM + " (":
                b -= 1
            while a < b and kind == "email" and text[a] in _TRIM:
                a += 1
            if b - a >= 6:
                out.add((a, b, k))
    return sorted(out)


_GIVEN_BEFORE = re.compile(rf"(?:{_GIVEN})[\"']?$")


def describe(text: str, a: int, b: int, kind: int) -> list[float]:
    """Format and context features of a span."""
    s = text[a:b]
    digits = "".join(c for c in s if "0" <= c <= "9")
    letters = sum(c.isalpha() for c in s)
    n = len(s)
    freq = {c: s.count(c) for c in set(s)}
    entropy = -sum(v / n * math.log2(v / n) for v in freq.values())
    groups = re.findall(r"\d+", s)
    octets = [int(g) for g in s.split(".") if g.isdigit() and len(g) < 6] if kind == 1 and "." in s else []
    left, right = text[max(0, a - 40) : a], text[b : b + 24]
    lc, rc = left[-1:], right[:1]
    seen = [0.0] * len(_WORDS)
    for w in re.findall(r"[a-z]+", (left + " " + right).lower()):
        i = _CONTEXT.get(w)
        if i is not None:
            seen[i] += 1
    domain = s.rpartition("@")[2] if "@" in s else ""
    tld = domain.rpartition(".")[2]
    runs = sum(x.isdigit() != y.isdigit() for x, y in zip(s, s[1:], strict=False))
    return [
        float(kind), n, len(digits), letters, n - len(digits) - letters, entropy, len(groups), max((len(g) for g in groups), default=0), min((len(g) for g in groups), default=0),
        len(digits) >= 12 and luhn(digits), bool(octets) and len(octets) == 4 and max(octets) < 256, s.count("."), s.count("-"), s.count(" "), s.count(":"), s.count("(") + s.count("/"),
        s[0] == "+" or lc == "+", kind == 4 and mod97(s), "." in domain, len(tld) if tld.isalpha() else 0, digits[:1] in "3456" and len(digits) in (15, 16),
        sum(c in "0123456789abcdefABCDEF" for c in s) / n, sum(c.isupper() for c in s) / max(letters, 1), runs / n,
        bool(re.match(r"(?:sk|pk|rk)[-_]|AKIA|ASIA|gh[pousr]_|xox[abprs]-|AIza|eyJ|glpat-|SG\.|npm_|hf_", s)), bool(re.fullmatch(r"(?:19|20)\d\d[ ./-]?[01]\d[ ./-]?[0-3]\d(?:[ T]?\d*)|[0-3]?\d[./-][0-3]?\d[./-](?:19|20)?\d\d.*", s)),
        lc.isalnum() or lc == "_", rc.isalnum() or rc == "_", lc in "\"'=:", lc in "$€£#" and lc != "", rc in "%€$£" and rc != "", bool(_GIVEN_BEFORE.search(left)),
        lc == "." or rc == "." and right[1:2].isdigit(), int(digits[:2] or 0),
        *seen,
    ]


# -- generated candidates

_SYLLABLES = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve ción que der sch ung ment eau é ü".split()


class _Maker:
    """Draws spans of each kind, look-alikes, and prose to set them in."""

    def __init__(self, seed: int):
        self.r = np.random.default_rng(seed)

    def n(self, a: int, b: int) -> int:
        return int(self.r.integers(a, b + 1))

    def of(self, xs):
        return xs[self.n(0, len(xs) - 1)]

    def digits(self, k: int) -> str:
        return "".join(str(d) for d in self.r.integers(0, 10, k))

    def chars(self, alphabet: str, k: int) -> str:
        return "".join(self.of(alphabet) for _ in range(k))

    def word(self) -> str:
        return "".join(self.of(_SYLLABLES) for _ in range(self.n(1, 4)))

    def email(self) -> str:
        user = self.of([self.word, lambda: self.word() + "." + self.word(), lambda: self.word() + "." + self.digits(2), lambda: self.word() + "_" + self.digits(3), lambda: self.word()[:1] + "+" + self.word()])()
        host = self.of([self.word, lambda: "mail" + self.digits(1), lambda: self.word() + "-" + self.word(), lambda: "mail" + self.digits(1) + "." + self.word()])()
        return f"{user}@{host}.{self.of(['com', 'org', 'net', 'io', 'de', 'fr', 'es', 'co.uk', 'example.com', 'example.org', 'edu', 'info'])}"

    def ip(self) -> str:
        if self.r.random() < 0.15:
            return ":".join(self.chars("0123456789abcdef", self.n(1, 4)) for _ in range(8))
        return ".".join(str(self.n(0, 255)) for _ in range(4))

    def card(self) -> str:
        d = self.of(["4", "5", "37", "6011", "34", "2", "35"])
        d += self.digits((15 if d[0] == "3" and d != "35" else 16) - len(d) - 1)
        if self.r.random() < 0.6:
            d += next(c for c in "0123456789" if luhn(d + c))
        else:
            d += self.digits(1)
        sep = self.of(["", "", "", " ", "-"])
        return sep.join(d[i : i + 4] for i in range(0, len(d), 4))

    def phone(self) -> str:
        d = self.digits
        return self.of([
            lambda: f"+1 ({d(3)}) 555-{d(4)}", lambda: f"+1 ({d(3)}) {d(3)}-{d(4)}", lambda: f"({d(3)}) {d(3)}-{d(4)}", lambda: f"{self.n(2, 9)}{d(2)}-{d(3)}-{d(4)}", lambda: f"+{self.n(20, 99)} {d(3)} {d(3)} {d(4)}",
            lambda: f"+{self.n(20, 99)}{d(10)}", lambda: f"+1-{d(3)}-{d(3)}-{d(4)}", lambda: f"{self.n(2, 9)}{d(2)}.{d(3)}.{d(4)}", lambda: f"0{d(3)} {d(self.n(6, 8))}", lambda: f"00{self.n(20, 99)} {d(3)} {d(7)}", lambda: f"+{self.n(20, 99)} (0){d(2)} {d(8)}", lambda: f"+33 {self.n(1, 9)} {d(2)} {d(2)} {d(2)} {d(2)}", lambda: f"555-{d(4)}",
        ])()

    def iban(self) -> str:
        s = self.of(["DE", "FR", "GB", "ES", "NL", "IT"])
        body = (self.chars("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 4) if s in ("GB", "NL") else "") + self.digits(self.n(14, 20))
        check = 98 - int("".join(str(int(c, 36)) for c in body + s + "00")) % 97
        t = f"{s}{check:02d}{body}"
        return t if self.r.random() < 0.5 else " ".join(t[i : i + 4] for i in range(0, len(t), 4))

    def ssn(self) -> str:
        return f"{self.n(1, 899):03d}-{self.n(1, 99):02d}-{self.n(1, 9999):04d}"

    def secret(self) -> str:
        alnum = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
        return self.of([
            lambda: self.chars("0123456789abcdef", self.of([32, 40, 64])), lambda: "sk-" + self.chars(alnum, 32), lambda: "AKIA" + self.chars("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16), lambda: "ghp_" + self.chars(alnum, 36),
            lambda: self.chars(alnum, self.n(20, 44)), lambda: self.chars(alnum + "+/", 40) + "=", lambda: "xoxb-" + self.digits(11) + "-" + self.chars(alnum, 24), lambda: "AIza" + self.chars(alnum, 35),
            lambda: self.of(["sk", "pk", "rk"]) + self.of(["_live_", "_test_"]) + self.chars(alnum, self.n(16, 32)), lambda: self.chars(alnum[:52], self.n(16, 32)),
        ])()

    def password(self) -> str:
        if self.r.random() < 0.3:
            return (self.word() + self.word())[: self.n(4, 9)] + self.digits(self.n(3, 5))
        return self.chars("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789!#%*", self.n(8, 14))

    def name(self) -> str:
        """An identifier that holds a secret."""
        head = self.of(["", "", "db", "app", "aws_", "github_", "stripe_", "my-", "prod_", self.word() + "_"])
        s = head + self.of(["key", "token", "secret", "password", "pass", "pat", "sig", "signature", "access_key", "access_key_id", "api_key", "auth_token", "pwd"])
        return s.upper() if self.r.random() < 0.4 else s

    def lookalike(self) -> str:
        d, n = self.digits, self.n
        return self.of([
            lambda: self.of(["sort_key", "primary_key", "keyboard", "key", "pattern", "path", "signal", "passage", "author", "monkey"]) + self.of(["=", ": ", " = "]) + self.of(["", "_"]).join(self.word() for _ in range(n(1, 3))),
            lambda: f"{n(1900, 2030)}-{n(1, 12):02d}-{n(1, 28):02d}", lambda: f"{n(1, 28):02d}.{n(1, 12):02d}.{n(1900, 2030)}", lambda: f"{n(1, 12)}/{n(1, 28)}/{n(1900, 2030)}", lambda: f"{n(1900, 2030)}-{n(1, 12):02d}-{n(1, 28):02d} {n(0, 23):02d}:{n(0, 59):02d}:{n(0, 59):02d}",
            lambda: f"version {n(0, 40)}.{n(0, 90)}.{n(0, 900)}.{n(256, 9999)}", lambda: f"${n(1, 999)},{d(3)},{d(3)}.{d(2)}", lambda: f"order {d(8)}", lambda: f"invoice no {d(9)}", lambda: f"{n(1900, 2030)} - {n(1900, 2030)}", lambda: f"{n(1, 99)}.{d(8)}", lambda: f"ISBN 978{d(10)}", lambda: f"ISBN 978-{d(1)}-{d(4)}-{d(4)}-{d(1)}",
            lambda: f"part {d(4)}-{d(4)}-{d(3)}", lambda: f"{n(1, 999)} {d(3)} {d(3)}", lambda: f"{d(4)} {d(4)}", lambda: f"page {n(1, 999)}-{n(1, 999)}", lambda: self.word() + "@" + self.word(), lambda: "@" + self.word(), lambda: f"{n(0, 23)}:{n(0, 59):02d}:{n(0, 59):02d}", lambda: "".join(self.word() for _ in range(5)), lambda: "_".join(self.word() for _ in range(4)),
            lambda: "-".join(self.word() for _ in range(4)), lambda: "token " + self.word() + self.word(), lambda: "the secret is " + self.word() + self.word(), lambda: "password " + self.word() + self.word() + self.word(), lambda: "/".join(self.word() for _ in range(5)), lambda: f"section {n(1, 20)}.{n(1, 20)}.{n(1, 20)}.{n(1, 20)}", lambda: f"{d(13)}", lambda: f"{d(12)}", lambda: f"id {d(11)}",
            lambda: self.word().upper() + "".join(self.word().upper() for _ in range(5)), lambda: f"{n(1, 99)}-{n(1, 99)}-{n(1, 99)}-{n(1, 99)}", lambda: f"{n(1, 9)} {n(1, 9)} {n(1, 9)} {n(1, 9)} {n(1, 9)} {n(1, 9)} {n(1, 9)} {n(1, 9)}", lambda: f"{d(3)}.{d(3)}.{d(3)},{d(2)}", lambda: "secretarial" + self.word(), lambda: f"{n(1, 99)} {n(1, 99)} {n(1000, 9999)}",
        ])()

    def prose(self, k: int) -> str:
        style = self.r.random()
        out = []
        for _ in range(k):
            w = self.word()
            w = w.upper() + "!!" if style < 0.1 else w + self.of(["***", "$$$", "%%%", "&&&", "###"]) if style < 0.25 else w + self.of(["", "", "", "", ",", "."])
            out.append(w)
        return " ".join(out)

    def sample(self) -> tuple[str, list[tuple[int, int, str]]]:
        """A text, and the places and kinds of the true spans in it."""
        before, after = self.prose(self.n(0, 6)), self.prose(self.n(0, 6))
        u = self.r.random()
        if u < 0.42:
            kind, span, lead, tail = "", self.lookalike(), "", ""
        else:
            kind = self.of(["email", "ip", "card", "phone", "iban", "ssn", "secret", "secret"])
            lead = self.of(["", "", "", self.of(_WORDS[kind]) + ": "]) if kind in _WORDS and kind != "secret" else ""
            tail = ""
            span = getattr(self, kind)()
            if kind == "secret":
                key = self.of(["token", "api_key", "secret", "password", "access_key", "Authorization", "client_secret", "auth_token", "bearer token", "Bearer"])
                if self.r.random() < 0.25:
                    span = self.password()
                elif self.r.random() < 0.2:
                    key = ""
                elif self.r.random() < 0.45:
                    key = self.of(["", "", "export ", "https://" + self.word() + ".com/" + self.word() + "?"]) + self.name()
                q = self.of(['"', "'", "", '"', ""])
                lead, tail = (f"{key}{self.of([' = ', '=', ': ', ':', ' = ', ' ', ' is '])}{q}", q) if key else ("", "")
        glue = self.of([" ", " ", " ", "\n", " ("]) if before else ""
        end = self.of(["", "", "", ".", ",", "###", "***", "!!", ")"])
        text = before + glue + lead
        a = len(text)
        true = [(a, a + len(span), kind)] if kind else []
        text += span + tail
        if kind and self.r.random() < 0.25:  # two in a row, the same again or another
            again = span if self.r.random() < 0.4 else getattr(self, other := self.of(["email", "ip", "card", "phone"]))()
            text += " "
            true.append((len(text), len(text) + len(again), kind if again is span else other))
            text += again
        return text + end + (" " + after if after else ""), true


def generated(p: Params) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, kinds and truth of candidates: true when it covers the planted span with its kind."""
    m = _Maker(p.seed)
    x, kinds, y = [], [], []
    while len(x) < p.rows:
        text, true = m.sample()
        for s, e, k in candidates(text):
            x.append(describe(text, s, e, k))
            kinds.append(k)
            y.append(any(KINDS[k] == kind and s <= a + 1 and e >= b - 1 and e - s <= b - a + 3 for a, b, kind in true))
    return np.array(x, float), np.array(kinds), np.array(y, float)


# -- boosted trees


@dataclass
class Trees:
    """Complete binary trees: feature and cut per inner node, value per leaf."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    offset: float
    slope: float = 1.0
    bias: float = 0.0
    thresholds: tuple[float, ...] = ()

    def raw(self, x: np.ndarray) -> np.ndarray:
        s = np.full(len(x), self.offset)
        inner = self.feature.shape[1]
        row = np.arange(len(x))
        for f, c, v in zip(self.feature, self.cut, self.value, strict=True):
            node = np.zeros(len(x), int)
            while len(node) and node[0] < inner:
                node = 2 * node + 1 + (x[row, f[node]] > c[node])
            s += v[node - inner]
        return s

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.raw(x) + self.bias, -40, 40)))


def boost(x: np.ndarray, y: np.ndarray, p: Params) -> Trees:
    n, d = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, p.bins + 1)[1:-1])) for j in range(d)]
    bins = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(d)], 1)
    mean = y.mean()
    s = np.full(n, math.log(mean / (1 - mean)))
    inner = 2**p.depth - 1
    fs, cs, vs = [], [], []
    cell = (np.arange(d) * p.bins + bins).ravel()  # a row's place in every feature's histogram
    closed = np.arange(p.bins - 1) >= np.array([len(e) for e in edges])[:, None]  # no cut there
    for _ in range(p.rounds):
        q = 1 / (1 + np.exp(-s))
        g, h = y - q, q * (1 - q)
        gd, hd = np.repeat(g, d), np.repeat(h, d)
        f, c = np.zeros(inner, int), np.full(inner, np.inf)
        node = np.zeros(n, int)
        for level in range(p.depth):
            base, width = 2**level - 1, 2**level
            flat = np.repeat((node - base) * (d * p.bins), d) + cell
            cg, ch = (np.bincount(flat, w, width * d * p.bins).reshape(width, d, p.bins).cumsum(2) for w in (gd, hd))
            tg, th = cg[:, :, -1:], ch[:, :, -1:]
            gain = cg[:, :, :-1] ** 2 / (ch[:, :, :-1] + 1) + (tg - cg[:, :, :-1]) ** 2 / (th - ch[:, :, :-1] + 1) - tg**2 / (th + 1)
            gain[:, closed] = -np.inf
            at = gain.reshape(width, -1).argmax(1)
            top = gain.reshape(width, -1)[np.arange(width), at]
            for w in np.flatnonzero(top > 1e-6):
                j, k = divmod(int(at[w]), p.bins - 1)
                f[base + w], c[base + w] = j, edges[j][k]
            node = 2 * node + 1 + (x[np.arange(n), f[node]] > c[node])
        leaf = node - inner
        v = p.rate * np.bincount(leaf, g, 2**p.depth) / (np.bincount(leaf, h, 2**p.depth) + 1)
        s += v[leaf]
        fs.append(f), cs.append(c), vs.append(v)
    return Trees(np.array(fs), np.array(cs), np.array(vs), math.log(mean / (1 - mean)))


@lru_cache(maxsize=2)
def trained(p: Params = Params()) -> Trees:
    """Boosted on most generated candidates; slope, bias and thresholds set on the rest."""
    x, kinds, y = generated(p)
    held = np.random.default_rng(p.seed).random(len(x)) < 0.3
    model = boost(x[~held], y[~held], p)
    s, t = model.raw(x[held]), y[held]
    a, b = 1.0, 0.0
    for _ in range(50):  # Platt scaling by Newton steps
        q = 1 / (1 + np.exp(-np.clip(a * s + b, -40, 40)))
        w = q * (1 - q) + 1e-9
        g = np.array([((t - q) * s).sum(), (t - q).sum()])
        hess = np.array([[(w * s * s).sum() + 1e-3, (w * s).sum()], [(w * s).sum(), w.sum() + 1e-3]])
        a, b = np.array([a, b]) + np.linalg.solve(hess, g)
    model.slope, model.bias = float(a), float(b)
    prob = model.probability(x[held])
    cuts = []
    for k in range(len(KINDS)):
        q = np.sort(prob[(kinds[held] == k) & (t == 1)])
        cuts.append(float(min(0.5, max(0.15, q[int((1 - p.recall) * len(q))]))) if len(q) else 0.5)
    model.thresholds = tuple(cuts)
    return model


def select(text: str, spans: list[tuple[int, int, int]], prob: np.ndarray, cuts: tuple[float, ...]) -> list[tuple[int, int, int, float]]:
    """Spans above their kind's threshold, the likeliest, longest, first of overlapping ones."""
    good = sorted((-round(float(q), 6), a - b, a, b, k) for (a, b, k), q in zip(spans, prob, strict=True) if q >= cuts[k])
    out: list[tuple[int, int, int, float]] = []
    for q, _, a, b, k in good:
        if all(b <= s or a >= e for s, e, _, _ in out):
            out.append((a, b, k, -q))
    return sorted(out)


def _table(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


# digits of other scripts begin at U+0660, whose first byte is 0xD9
_DIGIT = _table(b"0123456789" + bytes(range(0xD9, 0x100)))
_RUN = _table(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_+/-")
_PLAIN = {"key": _KEY.removeprefix("(?ai:")[:-1], "name": _HEAD.removeprefix("(?ai:")[:-1]}


def possible(column: pa.Array) -> list[np.ndarray]:
    """For each generator the rows in which it can match: a necessary condition, found for all rows at once."""
    data, offsets, valid = X.utf8(column)
    n = len(valid)
    count = lambda m: X.per_doc_sum(m, offsets)
    digits = count(_DIGIT[data])
    signs = {c: count(data == ord(c)) for g in GENERATORS for c, _ in g.signs}
    edge = np.concatenate([[-1], np.flatnonzero(~_RUN[data]), [len(data)]])
    edge = np.union1d(edge, offsets - 0.5)  # a run ends with its text
    long = edge[:-1][np.ceil(edge[1:]) - np.floor(edge[:-1] + 1) >= 16]
    has = {"run": np.zeros(n, bool)}
    has["run"][np.searchsorted(offsets, np.floor(long + 1), side="right") - 1] = True
    for need, pattern in _PLAIN.items():
        has[need] = pc.match_substring_regex(column, pattern, ignore_case=True).fill_null(False).to_numpy(zero_copy_only=False)
    out = []
    for g in GENERATORS:
        ok = valid & (digits >= g.digits)
        for c, k in g.signs:
            ok &= signs[c] >= k
        out.append(ok & has[g.needs] if g.needs else ok)
    return out


def redact(column: pa.Array, model: Trees) -> tuple[list[str | None], list[list[dict] | None]]:
    """New text and spans per row; both None where nothing is found."""
    n = len(column)
    todo: list[tuple[int, str, list[tuple[int, int, int]]]] = []
    can = np.stack(possible(column))
    for i in np.flatnonzero(can.any(0)):
        t = column[int(i)].as_py()
        c = _spans(t, (g for g, ok in zip(GENERATORS, can[:, i], strict=True) if ok))
        if c:
            todo.append((int(i), t, c))
    texts: list[str | None] = [None] * n
    spans: list[list[dict] | None] = [None] * n
    if todo:
        prob = model.probability(np.array([describe(t, *s) for _, t, c in todo for s in c], float))
        at = 0
        for i, t, c in todo:
            chosen = select(t, c, prob[at : at + len(c)], model.thresholds)
            at += len(c)
            if chosen:
                out, last = [], 0
                for a, b, k, _ in chosen:
                    out += [t[last:a], f"[{KINDS[k].upper()}]"]
                    last = b
                texts[i] = "".join(out) + t[last:]
                spans[i] = [{"start": a, "end": b, "kind": KINDS[k], "score": q} for a, b, k, q in chosen]
    return texts, spans


_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("score", pa.float64())])
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("score", T.DoubleType())]))
RESULT = T.StructType([T.StructField("text", T.StringType()), T.StructField("spans", SPANS)])


def redactor(spark: SparkSession, p: Params = Params()):
    """An Arrow UDF of a text column; unchanged texts come back as nulls, so little is sent back."""
    held = spark.sparkContext.broadcast(trained(p))

    def run(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.struct([("text", pa.string()), ("spans", pa.list_(_SPAN))])
        for column in it:
            parts = []
            for b in X.slices([pa.RecordBatch.from_arrays([column], ["t"])], "t"):
                texts, spans = redact(b.column(0), held.value)
                parts.append(pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(spans, pa.list_(_SPAN))], fields=list(kind)))
            yield pa.concat_arrays(parts) if parts else pa.array([], kind)

    run.__annotations__ = {"it": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, RESULT).asNondeterministic()


def redacted(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """``doc_id, text, n_spans, spans`` for every row."""
    both = docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("_r", redactor(docs.sparkSession, p)(F.col("text")))
    none = F.array().cast(SPANS)
    return both.select("doc_id", F.coalesce("_r.text", "text").alias("text"), F.coalesce(F.size("_r.spans"), F.lit(0)).alias("n_spans"), F.coalesce("_r.spans", none).alias("spans"))


def cleaned(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """``docs`` with redacted texts and, if there is such a column, ``n_chars`` of changed ones."""
    tmp = X.free_name(docs, "_redacted")
    both = docs.withColumn(tmp, redactor(docs.sparkSession, p)(F.col("text")))
    new = F.col(f"{tmp}.text")
    cols = []
    for c in docs.columns:
        if c == "text":
            cols.append(F.coalesce(new, F.col("text")).alias("text"))
        elif c == "n_chars":
            cols.append(F.when(new.isNotNull(), F.char_length(new).cast(docs.schema[c].dataType)).otherwise(F.col(c)).alias(c))
        else:
            cols.append(F.col(f"`{c}`"))
    return both.select(*cols)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redacted(documents(spark, sf_dir, "doc_id", "text"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return cleaned(docs)
