"""Personal data, also where it is disguised, with spans in the source text.

Identifiers are found in the text as it stands, and again in a normalised text that transducers
write: homoglyphs and forms of letters and digits become ASCII, format signs go, spelled digits become
digits, and at/dot disguises in four languages become signs.  Each transducer keeps, for every character it writes, the source characters
it stands for, so that spans of the normalised text map back to the source.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from loom.llm.common import released, small_batches, table

KINDS = ("email", "ip", "card", "phone")

# --- fixed values of the contract: the patterns of the base spans
LOCAL = "[A-Za-z0-9._%+-]+"
AT_DOMAIN = r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9]){12,}")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# ---

#: An email is tried where a run of local characters begins; within a run nothing else can be leftmost.
EMAIL_FROM_RUN = re.compile(f"(?<![A-Za-z0-9._%+-]){LOCAL}{AT_DOMAIN}")
EMAIL_HERE = re.compile(LOCAL + AT_DOMAIN)

Span = tuple[str, int, int]


def _emails(text: str) -> Iterator[tuple[int, int]]:
    if "@" not in text:
        return
    at = 0
    while True:
        # a match may end inside a run of local characters: its rest can begin another
        found = (EMAIL_HERE.match(text, at) if at else None) or EMAIL_FROM_RUN.search(text, at)
        if not found:
            return
        yield found.span()
        at = found.end()


def luhn(digits: str) -> bool:
    """Whether the sum of digits passes, every second from the right doubled."""
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Spans of undisguised identifiers, by kind, then start."""
    out = [("email", a, b) for a, b in _emails(text)]
    if not text.isascii() or any(d in text for d in "0123456789"):
        out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m[0])) <= 15]
    return out


class Traced:
    """A text with, for each character, the range of source characters it stands for."""

    def __init__(self, text: str) -> None:
        self.text, self.source = text, None

    def replace(self, pattern: re.Pattern, write: Callable[[re.Match], str]) -> Traced:
        """Writes each match anew. All written characters stand for the whole match."""
        return self.edited([(m.start(), m.end(), write(m)) for m in pattern.finditer(self.text)])

    def edited(self, edits: list[tuple[int, int, str]]) -> Traced:
        """Writes ranges anew, which are in order and apart. All written characters stand for their range."""
        if not edits:
            return self
        old = self.source or [(i, i + 1) for i in range(len(self.text))]
        parts, source, at = [], [], 0
        for a, b, written in edits:
            parts += [self.text[at:a], written]
            source += old[at:a]
            source += [(old[a][0], old[b - 1][1])] * len(written)
            at = b
        out = Traced("".join(parts) + self.text[at:])
        out.source = source + old[at:]
        return out

    def back(self, start: int, end: int) -> tuple[int, int]:
        return (self.source[start][0], self.source[end - 1][1]) if self.source else (start, end)


# --- fixed values: characters that pass for ASCII ones, and digits' names
LOOKALIKES = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v",
    "․": ".", "。": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", " ": " ", " ": " ", " ": " ",
}
DIGIT_NAMES = (
    ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine"),
    ("null", "eins", "zwei", "drei", "vier", "fünf", "sechs", "sieben", "acht", "neun"),
    ("zéro", "un", "deux", "trois", "quatre", "cinq", "six", "sept", "huit", "neuf"),
    ("cero", "uno", "dos", "tres", "cuatro", "cinco", "seis", "siete", "ocho", "nueve"),
)
# ---


@lru_cache(maxsize=100_000)
def folded(c: str) -> str | None:
    """What a character is written as: its lookalike, its digit, the ASCII letters that it is a form of, nothing for a format sign; null if it stays."""
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    if unicodedata.category(c) == "Cf":
        return ""
    if (digit := unicodedata.decimal(c, None)) is not None:
        return str(digit)
    plain = unicodedata.normalize("NFKC", c)
    return plain if plain.isascii() and (len(plain) == 1 or c.isalnum()) else None


def _unfolded(text: str) -> Traced:
    """The text with its characters folded."""
    swaps = {c: w for c in set(text) if not c.isascii() and (w := folded(c)) is not None}
    if all(len(w) == 1 for w in swaps.values()):
        return Traced(text.translate({ord(c): w for c, w in swaps.items()})) if swaps else Traced(text)
    return Traced(text).replace(re.compile("[" + re.escape("".join(sorted(swaps))) + "]"), lambda m: swaps[m[0]])


#: From the bracket on: the blanks before it are taken by a look back, so that long runs of blanks are read once.
BRACKETED_AT = re.compile(r"[\[({<][\x20\t]*(?:ät|at|@|arobase|arobas|arroba|klammeraffe)[\x20\t]*[\])}>][\x20\t]*", re.I)
BRACKETED_DOT = re.compile(r"[\[({<][\x20\t]*(?:dot|\.|punkt|point|punto)[\x20\t]*[\])}>][\x20\t]*", re.I)
#: Both signs spoken: name, at, and labels with dots between them.
AT, OTHER_AT, OTHER_DOT = "(?:ät|at|arobase|arobas|arroba|klammeraffe)", "(?:ät|arobase|arobas|arroba|klammeraffe)", "(?:punkt|point|punto)"
SPOKEN = re.compile(rf"(?<![A-Za-z0-9._%+-])([A-Za-z0-9._%+-]{{1,64}})\x20+{AT}\x20+([A-Za-z0-9-]{{1,63}}(?:\x20+(?:dot|{OTHER_DOT})\x20+[A-Za-z0-9-]{{1,63}}){{1,8}})(?![A-Za-z0-9-])", re.I)
DOT = re.compile(rf"\x20+(?:dot|{OTHER_DOT})\x20+", re.I)
#: Either sign spoken by itself: a dot between labels, an at before a domain whose last label has a letter.
#: The other languages' names of a dot are words of prose: they count from an at sign's first label on.
SPOKEN_DOT = re.compile(r"(?<=[A-Za-z0-9_-])\x20+dot\x20+(?=[A-Za-z0-9_-])", re.I)
SPOKEN_DOTS = re.compile(rf"(@[A-Za-z0-9-]{{1,63}})((?:\x20+{OTHER_DOT}\x20+[A-Za-z0-9-]{{1,63}}){{1,8}})(?![A-Za-z0-9-])", re.I)
SPOKEN_AT = re.compile(rf"(?<=[A-Za-z0-9._%+-])\x20+{AT}\x20+(?=[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[0-9-]*[A-Za-z])", re.I)
AT_WORDS, DOT_WORDS = ("at", "ät", "arobas", "arroba", "klammeraffe"), ("dot", "punkt", "point", "punto")
#: Letters that ignoring case takes for ASCII ones.
CASED = {0x130: "i", 0x131: "i", 0x17F: "s", 0x212A: "k"}


def _spelled(names: tuple[str, ...]) -> tuple[re.Pattern, dict[str, str]]:
    """Whole runs of two or more names and written numbers, each read once; those without a name are no digits' names."""
    item = "(?:" + "|".join(sorted(names, key=len, reverse=True)) + r"|[0-9]++)(?!\w)"
    joint = r"(?:[\x20,-]{1,3}|\.|\x20(?:dot|punkt|point|punto)\x20)"
    return re.compile(rf"(?<!\w)(?:plus\x20)?{item}(?:{joint}{item})+", re.I), {n: str(i) for i, n in enumerate(names)}


SPELLINGS = [(names, *_spelled(names)) for names in DIGIT_NAMES]
PIECES = re.compile(r"\w+|\W+")
SIGNS = {"plus": "+", "dot": ".", "punkt": ".", "point": ".", "punto": "."}


def _lower(text: str) -> str:
    return (text if text.isascii() else text.translate(CASED)).lower()


def _digits(text: str, run: re.Pattern, value: dict[str, str]) -> Iterator[tuple[int, int, str]]:
    """Edits: names to digits, signs' names to signs; what joins two names goes, and beside a written number one sign of it stays."""
    for m in run.finditer(text):
        pieces = [(p.start(), p.end(), _lower(p[0])) for p in PIECES.finditer(text, *m.span())]
        if not any(p in value for _, _, p in pieces):
            continue
        for k, (a, b, p) in enumerate(pieces):
            if p in value or p in SIGNS:
                yield a, b, value.get(p) or SIGNS[p]
            elif k % 2 and "." not in p:  # the run begins with a word, so joints have odd places
                beside = pieces[k - 1][2], pieces[k + 1][2]
                if any(w in SIGNS for w in beside) or not any(w.isdigit() for w in beside):
                    yield a, b, ""
                elif not all(w.isdigit() for w in beside):
                    yield a, b, "-" if "-" in p else " "


def _with_blanks(text: str, pattern: re.Pattern, sign: str) -> Iterator[tuple[int, int, str]]:
    """Edits: matches and the blanks before them to a sign."""
    end = 0
    for m in pattern.finditer(text):
        yield end + len(text[end : m.start()].rstrip(" \t")), m.end(), sign
        end = m.end()


def normalised(text: str) -> Traced:
    out = Traced(text) if text.isascii() else _unfolded(text)
    low = _lower(out.text)
    for names, pattern, value in SPELLINGS:
        if any(n in low for n in names):
            out = out.edited(list(_digits(out.text, pattern, value)))
    for signs, pattern, sign in (((*AT_WORDS, "@"), BRACKETED_AT, "@"), ((*DOT_WORDS, "."), BRACKETED_DOT, ".")):
        if any(b in low for b in "[({<") and any(s in low for s in signs):
            out = out.edited(list(_with_blanks(out.text, pattern, sign)))
    at = any(f" {w}" in low for w in AT_WORDS)
    if at and any(f" {w} " in low for w in DOT_WORDS):
        out = out.replace(SPOKEN, lambda m: f"{m[1]}@{DOT.sub('.', m[2])}")
    if " dot " in low:
        out = out.replace(SPOKEN_DOT, lambda m: ".")
    if "@" in out.text and any(f" {w} " in low for w in DOT_WORDS):
        out = out.replace(SPOKEN_DOTS, lambda m: m[1] + DOT.sub(".", m[2]))
    if at:
        out = out.replace(SPOKEN_AT, lambda m: "@")
    return out


def all_spans(text: str) -> tuple[list[Span], list[Span]]:
    """(base, all): all holds base and what only the normalised text shows, by kind, then start.

    A span from the normalised text is left out only if it lies within a base span of its kind.
    """
    base = base_spans(text)
    traced = normalised(text)
    if traced.text == text:
        return base, base
    seen, more = set(base), []
    for kind, a, b in base_spans(traced.text):
        a, b = traced.back(a, b)
        if (kind, a, b) not in seen and not any(k == kind and x <= a and b <= y for k, x, y in base):
            seen.add((kind, a, b))
            more.append((kind, a, b))
    return base, sorted([*base, *more], key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [all_spans(t or "") for t in batch.column(1).to_pylist()]
        base = [[s[0] for s in b] for b, _ in found]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array([b.count(k) for b in base], pa.int64()) for k in KINDS), pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b, _ in found], pa.string()), pa.array([joined(a) for _, a in found], pa.string())],
            ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
        )


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans for each row.

    Null and empty texts have no spans.  Row by row: repeats, nulls in other columns, other columns
    and no rows are fine.
    """
    return small_batches(docs).select("doc_id", "text").mapInArrow(released(_run), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for every document; texts are read whole."""
    return personal_data(table(spark, sf_dir, "documents"))
