"""Secrets: fixed patterns, and a character convolutional network over every candidate.

A candidate is any quoted or assigned value of six characters or more, whatever its shape, and any run
of token characters that are varied enough by their entropy; the network reads its characters and those
around it, in windows over the whole of a long one, of which the highest score counts.  Candidates within a pattern's span are scored like all others, so that the network's
recall can be told from documents.  It is trained in numpy on labelled findings: by default on generated
ones (keys, tokens and passwords of many shapes in code, configuration and prose; identifiers,
hashes of versions, numbers, links and words that are none), or on a bounded sample of yours.  The
scores are calibrated by Platt's method on held-out findings, and the threshold is the highest that
keeps a given recall there.  ``python -m loom.llm.secret_scan`` trains the default network and writes
its few thousand numbers beside this module, with a digest of what they depend on; where that differs,
``trained`` trains anew.
"""

from __future__ import annotations

import hashlib
import io
import math
import pkgutil
import random
import re
import string
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from loom.llm.common import released, small_batches, table

# --- fixed values of the contract: the patterns of the base spans, in order
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
# ---
KINDS_ALL = (*KINDS, "network")
KEYWORD = re.compile("passw|secret|token|api_?key", re.I | re.A)
#: Shorter runs are words as often as not, unless letters and digits are mixed.
SHORT, MIXED = 12, 8
#: Bits a character, at least.
ENTROPY = 2.5
#: Words and numbers, also joined; and what names a key or quotes or assigns it.
PLAIN = re.compile(r"[-_/=+]*(?:(?:[A-Z]{0,2}[a-z]+|[A-Z]+|[0-9]+)(?:[-_/=+]+|$))+")
NAMED = re.compile(r"""(?:["'`]|[=:]\s*|\b(?:bearer|basic|\w*key|\w*auth|credentials?|pwd|pin|code)\W{1,3}(?:is\W{1,2})?)$""", re.I)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % MIXED)

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """By start, then kind."""
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6] if KEYWORD.search(text) else []
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def entropy(t: str) -> float:
    """Bits a character."""
    counts = [t.count(c) for c in set(t)]
    return math.log2(len(t)) - sum(n * math.log2(n) for n in counts) / len(t)


#: What follows an opening quote or an assignment sign; what a value does not end with.
QUOTED = re.compile(r"""(?<!\w)(["'`])([^"'`\n]{6,400})\1(?!\w)""")
ASSIGNED = re.compile(r"""(?<=[\w"'`\])])[\x20\t]?(?::=|=>|[=:])[\x20\t]*([^\s"'`]{6,})""")
TAIL = ".,;:!?)]}>"
#: Runs joined by dots, as in signed tokens.
DOTTED = re.compile(r"[A-Za-z0-9+/_=-]{%d,}(?:\.[A-Za-z0-9+/_=-]{%d,})+" % (MIXED, MIXED))


def runs(text: str) -> list[tuple[int, int]]:
    """Runs of 16 or more token characters with two digits and three letters, and others of enough entropy.

    The others have SHORT or more characters, or MIXED with a digit and letters of both cases.  If they
    look like words or numbers, only what stands before them tells a key, and it must be there.
    """
    out = []
    for m in CANDIDATE.finditer(text):
        t = m[0]
        if len(t) >= 16 and sum(map(t.count, string.digits)) >= 2 and sum(c.isalpha() for c in t) >= 3:
            out.append(m.span())
            continue
        if len(t) < SHORT and not (any(map(str.isdigit, t)) and any(map(str.islower, t)) and any(map(str.isupper, t))):
            continue
        if entropy(t) >= ENTROPY and not (PLAIN.fullmatch(t) and not NAMED.search(text[max(0, m.start() - BEFORE) : m.start()])):
            out.append(m.span())
    return out


def candidates(text: str) -> list[tuple[int, int]]:
    """Values in quotes and after an assignment, and runs of token characters; of those within each other, the longest.

    A quoted value with blanks counts only where it holds no run: that is found by itself in a sentence.
    """
    found = runs(text)
    if found and "." in text:
        found += [m.span() for m in DOTTED.finditer(text) if sum(m.start() <= a and b <= m.end() for a, b in found) > 1]
    inner = list(found)
    if any(q in text for q in "\"'`"):
        for m in QUOTED.finditer(text):
            a, b = m.span(2)
            if " " not in m[2] or not any(a <= x and y <= b for x, y in inner):
                found.append((a, b))
    for m in ASSIGNED.finditer(text):
        value = m[1].rstrip(TAIL)
        if len(value) >= 6 and not value.startswith("//"):
            found.append((m.start(1), m.start(1) + len(value)))
    out: list[tuple[int, int]] = []
    for a, b in sorted(set(found), key=lambda s: (s[0], -s[1])):
        if not out or b > out[-1][1]:
            out.append((a, b))
    return out


#: Characters before a candidate, of it, and after it that the network reads at once.
BEFORE, OF, AFTER = 24, 48, 8
WIDTH, CHANNELS, LENGTH = 5, 32, BEFORE + OF + AFTER
#: Character classes of a candidate: vowels, lower, upper, digits, single signs, white space, other, nothing.
SIGNS = "\"'`=:+/_-.,;()[]{}<>@#$%&*!?|\\"
CLASS = np.zeros(128, np.int64)
for _i in range(128):
    _c = chr(_i)
    CLASS[_i] = 1 if _c in "aeiou" else 2 if _c in "abcdef" else 3 if _c.islower() else 4 if _c in "ABCDEF" else 5 if _c.isupper() else 6 if _c.isdigit() else 7 if _c.isspace() else 8 + SIGNS.index(_c) if _c in SIGNS else 8 + len(SIGNS)
OTHER, CLASSES = 9 + len(SIGNS), 10 + len(SIGNS)
#: Around a candidate letters count as themselves, for names of keys are words: nothing, a letter (of either case), digits, white space, single signs, other.
NEAR = np.zeros(128, np.int64)
for _i in range(128):
    _c = chr(_i).lower()
    NEAR[_i] = 1 + ord(_c) - ord("a") if "a" <= _c <= "z" else 27 if _c.isdigit() else 28 if _c.isspace() else 29 + SIGNS.index(_c) if _c in SIGNS else 29 + len(SIGNS)
NEAR_OTHER, NEAR_CLASSES = 29 + len(SIGNS), 30 + len(SIGNS)


SEPARATOR = re.compile("[/=]")


def pieces(text: str, a: int, b: int) -> list[tuple[int, int]]:
    """The candidate in windows of OF characters that overlap by half, and those after each separator, so that all of it is read."""
    if b - a <= OF:
        return [(a, b)]
    starts = {*range(a, b - OF // 2, OF // 2), b - OF, *(m.end() for m in SEPARATOR.finditer(text, a, b) if b - m.end() >= SHORT)}
    return [(s, min(b, s + OF)) for s in sorted(starts)]


def windows(text: str, spans: Sequence[tuple[int, int]]) -> np.ndarray:
    """Class numbers of the characters around each candidate; those of the candidate follow those around it."""
    out = np.zeros((len(spans), LENGTH), np.int64)
    for k, (a, b) in enumerate(spans):
        for part, at in ((text[max(0, a - BEFORE) : a], None), (text[a : min(b, a + OF)], BEFORE), (text[b : b + AFTER], BEFORE + OF)):
            code = np.frombuffer(part.encode("utf-32-le"), np.uint32)
            if at == BEFORE:
                row = np.where(code < 128, CLASS[np.minimum(code, 127)], OTHER) + NEAR_CLASSES
            else:
                row = np.where(code < 128, NEAR[np.minimum(code, 127)], NEAR_OTHER)
            start = BEFORE - len(row) if at is None else at
            out[k, start : start + len(row)] = row
    return out


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -80, 80)))


class Network:
    """Embedding of classes, one convolution with a rectifier, maximum and mean over places, a hidden layer, a logistic unit.

    The hidden layer lets a key's name before a value and the value's shape count together.
    """

    DEPTH, HIDDEN = 12, 16

    def __init__(self, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        norm = lambda *s: rng.normal(0, 1, s)
        self.p = {"embed": norm(NEAR_CLASSES + CLASSES, self.DEPTH) * 0.5, "filter": norm(WIDTH * self.DEPTH, CHANNELS) / np.sqrt(WIDTH * self.DEPTH), "bias": np.zeros(CHANNELS), "hidden": norm(2 * CHANNELS, self.HIDDEN) / np.sqrt(2 * CHANNELS), "shift": np.zeros(self.HIDDEN), "out": norm(self.HIDDEN) * 0.3, "base": np.zeros(1)}
        self.p = {k: a.astype(np.float32) for k, a in self.p.items()}
        self.slope, self.shift, self.threshold = 1.0, 0.0, 0.5

    def forward(self, x: np.ndarray):
        """Logits.  A class has one product with each of the filter's places: the convolution is a sum of five look-ups."""
        places = LENGTH - WIDTH + 1
        look = self.p["embed"] @ self.p["filter"].reshape(WIDTH, self.DEPTH, CHANNELS)  # place, class, channel
        h = look[0][x[:, :places]] + self.p["bias"]
        for k in range(1, WIDTH):
            h += look[k][x[:, k : k + places]]
        np.maximum(h, 0, out=h)
        pooled = np.concatenate((h.max(axis=1), h.mean(axis=1)), axis=1)
        unit = np.maximum(pooled @ self.p["hidden"] + self.p["shift"], 0)
        return unit @ self.p["out"] + self.p["base"], (h, pooled, unit)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        z, (h, pooled, unit) = self.forward(x)
        n, places, _ = h.shape
        d = ((_logistic(z) - y) / n).astype(np.float32)
        g = {"out": unit.T @ d, "base": d.sum(keepdims=True)}
        du = d[:, None] * self.p["out"] * (unit > 0)
        g["hidden"], g["shift"] = pooled.T @ du, du.sum(axis=0)
        dp = du @ self.p["hidden"].T
        dh = np.repeat(dp[:, None, CHANNELS:] / places, places, axis=1)
        top = h.argmax(axis=1)
        dh[np.arange(n)[:, None], top, np.arange(CHANNELS)] += dp[:, :CHANNELS]
        dh = (dh * (h > 0)).reshape(-1, CHANNELS)
        g["bias"] = dh.sum(axis=0)
        look = np.zeros((WIDTH, NEAR_CLASSES + CLASSES, CHANNELS), np.float32)
        for k in range(WIDTH):  # sums of the places' gradients by class
            at = x[:, k : k + places].astype(np.uint8).ravel()
            order = np.argsort(at, kind="stable")
            starts = np.flatnonzero(np.diff(at[order].astype(np.int64), prepend=-1))
            look[k, at[order[starts]]] = np.add.reduceat(dh[order], starts, axis=0)
        filters = self.p["filter"].reshape(WIDTH, self.DEPTH, CHANNELS)
        g["filter"] = (self.p["embed"].T @ look).reshape(WIDTH * self.DEPTH, CHANNELS)
        g["embed"] = (look @ filters.transpose(0, 2, 1)).sum(axis=0)
        return g

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 8, batch: int = 64, rate: float = 0.01, seed: int = 6) -> None:
        """Adam over seeded batches."""
        rng, step = np.random.default_rng(seed), 0
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), batch):
                step += 1
                for k, g in self.gradients(x[order[i : i + batch]], y[order[i : i + batch]]).items():
                    m[k] += np.float32(0.1) * (g - m[k])
                    v[k] += np.float32(0.001) * (g * g - v[k])
                    self.p[k] -= np.float32(rate / (1 - 0.9**step)) * m[k] / (np.sqrt(v[k] / np.float32(1 - 0.999**step)) + np.float32(1e-8))

    def calibrate(self, x: np.ndarray, y: np.ndarray, recall: float, starts: np.ndarray) -> None:
        """Platt scaling, then a threshold.  x has the windows of findings one after another, from starts on.

        Of the thresholds with that recall, those with the fewest false findings; of these the middle
        one, so that it is not tied to one held-out finding.
        """
        z = np.maximum.reduceat(self.logits(x), starts)
        scale = float(z.std()) or 1.0
        target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
        design, w = np.stack((z / scale, np.ones_like(z)), axis=1), np.zeros(2)
        loss = lambda w: float(np.mean(np.logaddexp(0, design @ w) - target * (design @ w)))
        for _ in range(50):
            p = _logistic(design @ w)
            hess = (design * (p * (1 - p))[:, None]).T @ design / len(z) + 1e-4 * np.eye(2)
            step, size = np.linalg.solve(hess, design.T @ (p - target) / len(z)), 1.0
            while size > 1e-3 and loss(w - size * step) > loss(w):
                size /= 2
            w = w - size * step
        self.slope, self.shift = float(w[0] / scale), float(w[1])
        p = np.maximum.reduceat(self.probability(x), starts)
        high = float(np.sort(p[y == 1])[int((1 - recall) * y.sum())])
        below = p[(y == 0) & (p < high)]
        self.threshold = (high + (float(below.max()) if len(below) else 0.0)) / 2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return _logistic(self.slope * self.logits(x) + self.shift)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(0), *(self.forward(x[i : i + 512])[0] for i in range(0, len(x), 512))])


def generated_findings(n: int, seed: int) -> list[tuple[str, int, int, int]]:
    """(text, start, end, label): half secrets, half candidates that are none."""
    r = random.Random(seed)
    pick = lambda chars, a, b: "".join(r.choices(chars, k=r.randint(a, b)))
    word = lambda: "".join(r.choice("bcdfghlmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 4)))
    alnum, b64 = string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/"
    secret = (
        lambda: pick(alnum, 20, 64), lambda: pick(b64, 24, 64) + "=" * r.randint(0, 2), lambda: "ghp_" + pick(alnum, 36, 36), lambda: r.choice(("sk-", "pk_live_", "sk_test_", "xoxb-")) + pick(alnum, 24, 48),
        lambda: "AIza" + pick(alnum + "-_", 35, 35), lambda: "eyJ" + pick(alnum, 20, 40), lambda: pick(string.ascii_uppercase + string.digits, 20, 40), lambda: pick("0123456789ABCDEF", 32, 64), lambda: pick("0123456789abcdef", 16, 64), lambda: pick(alnum + "-_", 22, 43),
    )
    plain = (
        lambda: "_".join(word() for _ in range(r.randint(2, 5))) + str(r.randint(10, 9999)), lambda: "-".join(word() for _ in range(r.randint(2, 6))) + f"-{r.randint(1990, 2030)}-{r.randint(10, 99)}",
        lambda: "/".join(word() for _ in range(r.randint(2, 5))) + f"/{r.randint(10, 99999)}", lambda: "".join(word().title() for _ in range(r.randint(3, 6))) + str(r.randint(10, 99)), lambda: f"{r.randint(1990, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}T{r.randint(10, 23)}Z{word()}",
        lambda: word() + "=" * r.randint(10, 30) + word() + str(r.randint(10, 99)), lambda: "v" + "-".join(str(r.randint(0, 99)) for _ in range(5)) + "-" + word() + word(), lambda: word() + str(r.randint(10, 99)) + "_" * r.randint(8, 20) + word(), lambda: (word() + str(r.randint(0, 9))) * r.randint(3, 6),
    )
    prose = lambda: " ".join(word() for _ in range(r.randint(1, 6)))
    out = []
    while len(out) < n:
        label = len(out) % 2
        made = r.choice(secret if label else plain)()
        if not candidates(made) or candidates(made)[0] != (0, len(made)):
            continue
        keyed = (lambda: f'{word()}_key = "', lambda: "Authorization: Bearer ", lambda: f"export {word().upper()}_AUTH=", lambda: f'"{word()}Credential": "', lambda: f"{prose()}: ", lambda: f"{prose()} key ")
        loose = (lambda: f"{prose()} ", lambda: f"{prose()}, ", lambda: f'{word()} = "', lambda: f"{prose()} (", lambda: f"https://{word()}.com/", lambda: f"{prose()}: ")
        left = r.choice((*keyed, *loose) if label else (*loose, *loose, *keyed))()
        right = r.choice(('"', '",', " ", "\n", ". ", ")", ";")) + prose()
        out.append((left + made + right, len(left), len(left) + len(made), label))
    return out


def wide_findings(n: int, seed: int) -> list[tuple[str, int, int, int, int]]:
    """(text, start, end, label, start of what is labelled): keys of letters or digits only, short ones and ends of long runs, and what looks like them."""
    r = random.Random(seed)
    pick = lambda chars, a, b: "".join(r.choices(chars, k=r.randint(a, b)))
    vowels, heads, tails = "a e i o u ou ie ea eau ai ei y".split(), "b c d f g h j k l m n p qu r s t v w z ch sh th st tr pr pl gr br sch str".split(), ["", "", "", *"n r s t l ng st nt x ck m ch cht pf schst nd chpf lich heit keit".split()]
    word = lambda least=1, most=3: "".join(r.choice(heads) + r.choice(vowels) + r.choice(tails) for _ in range(r.randint(least, most)))
    alnum = string.ascii_letters + string.digits
    path = lambda a, b: "/".join(r.choice((word, word, lambda: f"{word()}-{word()}", lambda: f"{word()}_{r.randint(1, 999)}", lambda: f"v{r.randint(1, 9)}"))() for _ in range(r.randint(a, b)))
    token = (lambda: pick(alnum, 20, 48), lambda: r.choice(("sk_live_", "pk_test_", "ghp_", "xoxb-")) + pick(alnum, 20, 40), lambda: pick(alnum + "-_", 22, 43), lambda: pick(string.ascii_letters, 20, 40), lambda: pick(string.ascii_uppercase + string.digits, 20, 40))
    # (text, whether only a name before it tells what it is)
    secret = (
        lambda: ("", pick(string.ascii_letters, 16, 40), False), lambda: ("", pick(string.ascii_lowercase, 20, 40), True), lambda: ("", pick(string.ascii_uppercase, 16, 40), True), lambda: ("", pick(string.digits, 16, 40), True), lambda: ("", pick(alnum, 10, 16), True),
        lambda: ("/" + path(4, 12) + r.choice(("/", "/keys/", "/token=", "=")), r.choice(token)(), False), lambda: (path(6, 12) + "/", r.choice(token)(), False),
    )
    plain = (
        lambda: word(3, 6), lambda: word(3, 6).title(), lambda: path(2, 4), lambda: "/" + path(6, 20), lambda: "-".join(word() for _ in range(r.randint(2, 16))), lambda: "_".join(word() for _ in range(r.randint(2, 12))),
        lambda: "".join(word().title() for _ in range(r.randint(3, 12))), lambda: pick(string.digits, 12, 20), lambda: word().title() + str(r.randint(1, 9999)) + word().title(), lambda: word(3, 6).upper(), lambda: word(3, 6), lambda: pick(string.digits, 13, 19), lambda: word() + "=" * r.randint(5, 40) + word(2, 4),
    )
    prose = lambda: " ".join(word() for _ in range(r.randint(1, 6)))
    keyed = (lambda: f'{word()}_key = "', lambda: "Authorization: Bearer ", lambda: f"export {word().upper()}_KEY=", lambda: f'"{word()}Credential": "', lambda: f"{prose()} key ")
    loose = (lambda: f"{prose()} ", lambda: f"{prose()}, ", lambda: f"{prose()} (", lambda: f"{prose()}: ", lambda: f"https://{word()}.com")
    assigned = (*loose, lambda: f'{word()} = "', lambda: f"{prose()}: ", lambda: f'"{word()}": "', lambda: f"{word()}=")
    out = []
    while len(out) < n:
        label = len(out) % 2
        lead, made, named = r.choice(secret)() if label else ("", r.choice(plain)(), False)
        left = r.choice(keyed if named else loose + keyed if label else assigned)()
        text = left + lead + made + r.choice((" ", "\n", ". ", ")", '",', ";")) + prose()
        hit = next(((a, b) for a, b in candidates(text) if a <= len(left) + len(lead) and len(left + lead + made) <= b), None)
        if hit:
            out.append((text, *hit, label, len(left) + len(lead)))
    return out


def valued_findings(n: int, seed: int) -> list[tuple[str, int, int, int]]:
    """(text, start, end, label): passwords and pass phrases of every shape in quotes or assigned, and values of settings and prose that are none."""
    r = random.Random(seed)
    vowels, heads, tails = "a e i o u ou ie ea ai oo ee y io".split(), "b c d f g h j k l m n p r s t v w z ch sh th st tr pl gr br gl cl fl sp bb pp dd ll tt ss rr qu sc".split(), ["", "", *"n r s t l nd st ck m rn nt rb lt th x lm p d c w ng".split()]
    word = lambda least=1, most=3: "".join(r.choice(heads) + r.choice(vowels) + r.choice(tails) for _ in range(r.randint(least, most)))
    number = lambda most=4: str(r.randint(0, 10 ** r.randint(1, most)))
    sign = lambda: r.choice("!@#$%^&*?+~_-.")
    leet = lambda w: "".join({"a": "@4", "e": "3", "i": "1!", "o": "0", "s": "$5"}.get(c, c + c)[r.randint(0, 1) if c in "ais" else 0] if r.random() < 0.6 else c for c in w)
    cased = lambda w: "".join(c.upper() if r.random() < 0.3 else c for c in w)
    strong = (lambda: "".join(r.choices("0123456789abcdef", k=r.choice([24, 32, 40, 64]))), lambda: "".join(r.choices(string.ascii_letters + string.digits + "+/", k=r.randint(20, 44))), lambda: cased(leet(word(2, 3))) + sign() + number() + sign() + r.choice("xyzQ7"), lambda: "".join(r.choices(string.ascii_letters + string.digits + "!@#$%^&*?+~", k=r.randint(9, 24))), lambda: leet(word(2, 2)).title() + sign() + leet(word(2, 2)).title() + number() + sign(), lambda: sign().join(cased(leet(word(1, 2))) for _ in range(3)) + number())
    phrase = lambda sign: lambda: sign.join(word(2, 3) for _ in range(r.randint(3, 6)))
    weak = (lambda: word(2, 2) + number(2) + word(2, 2), lambda: word(2, 3) + number(2) + word(2, 3), phrase("-"), phrase("-"), phrase(" "), phrase(" "), phrase(" "), lambda: leet(word(3, 4)), lambda: word(2, 3).title() + number(4) + sign(), lambda: "".join(r.choices("0123456789", k=r.randint(6, 10))), lambda: word(2, 3) + sign() + word(2, 3))
    lead = lambda: r.choice(["", "", word() + "_", word() + ".", word() + " ", word().upper() + "_"])
    secret_name = lambda: lead() + r.choice(["token", "password", "secret", "api_key", "pwd", "pass", "passphrase", "auth_key", "key", "credential", "passcode", "pin", "psk", "db_pass", "login_key", "private_key", "auth", "passwort", "kennwort", "contraseña", "clave", "mot de passe", "PWD", "AUTH_KEY", "Pass", "master key", "wifi key", "access code"])
    other_name = lambda: lead() + r.choice(["name", "title", "host", "color", "path", "url", "version", "date", "author", "lang", "size", "city", "note", "type", "mode", "class", "style", "href", "source", "format", "level", "label", "user", "region", "file", "unit", word(), word()])
    plain = (
        lambda: word(2, 4) + str(r.randint(1990, 2040)), lambda: word(1, 2) + word(1, 2) + number(), lambda: f"v{number(2)}-{number(1)}-{word()}-{word()}", lambda: "_".join(word() for _ in range(3)) + "_" + number(), lambda: " ".join(word() for _ in range(r.randint(3, 6))), lambda: "-".join(word(2, 3) for _ in range(r.randint(3, 6))), lambda: word(2, 2) + number(2) + word(2, 2),
        lambda: word(2, 4), lambda: word(2, 4).title(), lambda: " ".join(word() for _ in range(r.randint(2, 9))), lambda: "_".join(word() for _ in range(r.randint(2, 3))), lambda: "-".join(word() for _ in range(2)), lambda: f"{r.randint(1990, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}", lambda: "/" + "/".join(word() for _ in range(r.randint(2, 4))),
        lambda: word(2, 3) + r.choice([".txt", ".html", ".json", ".com", ".org"]), lambda: f"{word()}@{word()}.{r.choice(['com', 'org', 'de'])}", lambda: f"{r.randint(1, 20)}.{r.randint(0, 20)}.{r.randint(0, 99)}", lambda: "https://" + word() + ".org/" + word(), lambda: "#" + "".join(r.choices("0123456789abcdef", k=6)), lambda: f"{r.randint(1, 99)},{r.randint(100, 999)}.{r.randint(10, 99)}", lambda: word(2, 3) + "," + word(2, 3), lambda: word().upper() + "_" + word(2, 3).upper(), lambda: "é".join((word(), word())), lambda: f"{word(2, 3)}({word()})", lambda: f"<{word()}>{word()}</{word()}>", lambda: word(3, 4) + r.choice("!?."),
    )
    prose = lambda: " ".join(word() for _ in range(r.randint(1, 6)))
    frames = (("export {}=", "\n"), ("{} = ", "\n"), ('{} = "', '"'), ('{} = "', '"'), ("{}: ", "\n"), ("{}=", "\n"), ("{}='", "'"), ('"{}": "', '",'), ("{} := `", "`"), ("{} is '", "'"), ("{} => \"", '"'), ('{} "', '"'), ("{}: ", " "))
    out = []
    while len(out) < n:
        label = len(out) % 2
        named = r.random() < 0.85 if label else False
        made = r.choice((*strong, *weak) if named else strong)() if label else r.choice(plain)()
        head, tail = r.choice(frames)
        name = secret_name() if named else other_name()
        if not label and r.random() < 0.35:
            head, tail, name = r.choice([("{} “", "”"), ("{}: ", ". "), ('{} said "', '" '), ("{} (", ") "), ("{}, '", "' ")]) + (prose(),)
        left = r.choice(["", prose() + "\n", prose() + " ", "  "]) + head.format(name if r.random() < 0.8 else name.upper().replace(" ", "_"))
        text = left + made + tail + prose()
        hit = next(((a, b) for a, b in candidates(text) if a < len(left) + len(made) and b > len(left)), None)
        if hit and (not label or hit == (len(left), len(left) + len(made))):
            out.append((text, *hit, label))
    return out


def _windowed(made: Sequence[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows of findings, where they start, the windows' labels (-1: neither), and the findings'."""
    x, starts, y = [], [], []
    for text, a, b, label, *begin in made:
        starts.append(len(y))
        parts = pieces(text, a, b)
        x.append(windows(text, parts))
        for _, e in parts:
            seen = e - max(a, *begin) if begin else e - a
            y.append(label if not label or seen >= 16 or len(parts) == 1 else 0 if seen <= 0 else -1)
    return np.concatenate(x), np.array(starts), np.array(y, float), np.array([m[3] for m in made], float)


#: Where the default network's numbers lie, and how it is trained.
FILE, DEFAULT = "secret_network.npz", (12000, 0.996, 11)


def _digest() -> str:
    """Of this module's text: generators, network and training."""
    source = pkgutil.get_data("loom.llm", "secret_scan.py") or b""
    return hashlib.sha256(source).hexdigest()


def fitted(findings: int, recall: float, seed: int) -> Network:
    """Trained on generated findings of all kinds, calibrated on a quarter as many others; deterministic."""

    def data(n: int, s: int):
        return _windowed([*generated_findings(n, s), *wide_findings(2 * n, s), *valued_findings(3 * n, s)])

    net = Network()
    x, _, y, _ = data(findings, seed)
    net.train(x[y >= 0], y[y >= 0])
    x, starts, _, y = data(findings // 4, seed + 1)
    net.calibrate(x, y, recall, starts)
    return net


@lru_cache(maxsize=4)
def trained(findings: int = DEFAULT[0], recall: float = DEFAULT[1], seed: int = DEFAULT[2]) -> Network:
    """``fitted``, or for the default arguments what is kept beside this module."""
    if (findings, recall, seed) == DEFAULT:
        try:
            kept = np.load(io.BytesIO(pkgutil.get_data("loom.llm", FILE) or b""))
        except (OSError, ValueError, EOFError):
            kept = None
        if kept is not None and str(kept["digest"]) == _digest():
            net = Network()
            net.p = {k: kept[k] for k in net.p}
            net.slope, net.shift, net.threshold = map(float, kept["scale"])
            return net
    return fitted(findings, recall, seed)


def keep(path: str) -> None:
    """Trains the default network and writes its numbers."""
    net = fitted(*DEFAULT)
    np.savez_compressed(path, digest=_digest(), scale=np.array([net.slope, net.shift, net.threshold]), **net.p)


def trained_on(labelled: DataFrame, most: int = 20_000, recall: float = 0.95) -> Network:
    """Trained on rows of (text, start, end, label), the ``most`` of them with the smallest hashes; a fifth calibrates."""
    from pyspark.sql import functions as F

    rows = labelled.select("text", "start", "end", "label").dropna().orderBy(F.xxhash64("text", "start")).limit(most).collect()
    cut, net = len(rows) * 4 // 5, Network()
    x, _, y, _ = _windowed(rows[:cut])
    net.train(x, y)
    x, starts, _, y = _windowed(rows[cut:])
    net.calibrate(x, y, recall, starts)
    return net


def found(texts: Sequence[str], net: Network) -> list[tuple[list[Span], list[Span]]]:
    """(base, all) spans per text: all holds the base ones, and the candidates that the network takes."""
    base = [base_spans(t) for t in texts]
    at = [(i, span, p) for i, t in enumerate(texts) for span in candidates(t) for p in pieces(t, *span)]
    every = [list(s) for s in base]
    best: dict[tuple[int, tuple[int, int]], float] = {}
    for k in range(0, len(at), 4096):
        part = at[k : k + 4096]
        scores = net.probability(np.concatenate([windows(texts[i], [p]) for i, _, p in part]))
        for (i, span, _), p in zip(part, scores, strict=True):
            best[i, span] = max(p, best.get((i, span), 0.0))
    for (i, (a, b)), p in best.items():
        if p >= net.threshold:
            every[i].append(("network", a, b))
    return [(s, sorted(e, key=lambda x: (x[1], KINDS_ALL.index(x[0])))) for s, e in zip(base, every, strict=True)]


def joined(spans: Sequence[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def secrets(docs: DataFrame, net: Network | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans for each row.

    Null and empty texts have no spans.  Row by row: repeats, nulls in other columns, other columns
    and no rows are fine.  The network (a few thousand numbers) travels with the function.
    """
    net = net or trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                spans = found([t or "" for t in part.column(1).to_pylist()], net)
                kinds = [[s[0] for s in b] for b, _ in spans]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array([k.count(x) for k in kinds], pa.int64()) for x in KINDS), pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b, _ in spans], pa.string()), pa.array([joined(a) for _, a in spans], pa.string())],
                    ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
                )

    return small_batches(docs).select("doc_id", "text").mapInArrow(released(run), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for every document; texts are read whole."""
    return secrets(table(spark, sf_dir, "documents"))


if __name__ == "__main__":
    from pathlib import Path

    keep(str(Path(__file__).with_name(FILE)))
