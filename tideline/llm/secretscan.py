"""Secret scans: fixed patterns and assignment-aware lexing.

Three kinds of pattern are searched in whole texts: ``assign``, ``access`` and
``hex``. Besides, source and configuration syntax is lexed at every ``=``,
``:``, ``:=`` and ``=>`` into a name and a right side (quoted literals, bare
values, names, and their sums with ``+``). Names that a text binds to quoted
literals are constants and are propagated into later or earlier uses. The
resulting literal is scored by how sensitive its target name is and how much
it looks like a credential; those that pass are spans of the kind ``named``,
which lie where the literal is written. A named span inside an ``assign``
match is not added again.

Nothing bounds the length of a name, of the space before a separator, or of a
chain of constants; a name that is bound several times passes its weight to
each literal, and a sum with unknown parts is scored by the parts it shows.

Null text counts as empty, and an empty text has no span. Offsets are code
points, the end exclusive. Memory and time are linear in one text, hostile ones
included. Repeated rows are scanned alike, and ids may be null or repeated. An
empty table gives no rows. Extra columns are ignored by :func:`find_secrets`
and kept by :func:`redacted`, whatever their names.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import math
import re
from collections import Counter, defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, arrow_rows, few_rows

KINDS = ("assign", "access", "hex", "named")
REPLACEMENT = "[REDACTED]"

# The patterns and least lengths of the base kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST = {"assign": 12, "access": 18, "hex": 16}
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Words of a target name and how sensitive they make it.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "passwort": 1.0, "pwd": 0.9, "secret": 1.0, "secrets": 0.9, "token": 0.9, "apikey": 1.0, "credential": 0.9, "credentials": 0.9,
    "auth": 0.6, "authorization": 0.7, "bearer": 0.8, "pass": 0.7, "privatekey": 1.0, "accesskey": 1.0, "secretkey": 1.0, "signature": 0.5, "salt": 0.5, "jwt": 0.8, "dsn": 0.5,
}
JOINED = {("api", "key"): 1.0, ("private", "key"): 1.0, ("access", "key"): 1.0, ("client", "key"): 0.8, ("encryption", "key"): 1.0, ("signing", "key"): 1.0, ("account", "key"): 0.8, ("master", "key"): 0.9, ("ssh", "key"): 0.9}
# What stands in for a secret in examples and templates.
PLACEHOLDERS = frozenset("changeme change_me change-me example sample none null nil true false todo test placeholder redacted".split())
_STAND_IN = re.compile(r"(?i)(?:your[_-]|my[_-]?(?:password|token|secret)\Z|\$\{|<.*>\Z|%.*%\Z|x+\Z|\*+\Z|\.+\Z)", re.S)

_TARGET = re.compile(r"""(?<![\w.-])([\w.-]++)["'\])]{0,2}+[ \t]*+(?::=|=>|[=:])""")
_FIRST_LETTER = re.compile(r"[A-Za-z_]")
_TERM = re.compile(r"""[ \t]*+(?:"((?:[^"\\\n]|\\.)*+)"|'((?:[^'\\\n]|\\.)*+)'|`([^`\n]*+)`|([A-Za-z_][\w.]*+)(?=[\s"'`,;<>(){}\[\]|&]|\Z)|(?=([^\s"'`,;<>(){}\[\]|&])))""")
_BARE_END = re.compile(r"""[\s"'`,;<>(){}\[\]|&]""")
_PLUS = re.compile(r"[ \t]*+\+")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
LEAST_WEIGHT = 0.5  # names below this are not sensitive


@functools.lru_cache(maxsize=20_000)
def sensitivity(name: str) -> float:
    """0 to 1, by the words of a name in snake, kebab, dotted or camel case; the last dotted part counts."""
    words = [w.lower() for w in _PARTS.findall(name.rsplit(".", 1)[-1])]
    single = max((SENSITIVE.get(w, 0.0) for w in [*words, "".join(words)]), default=0.0)
    return max([single, *(JOINED.get(p, 0.0) for p in zip(words, words[1:]))])


def _kind(c: str) -> int:
    return 1 if "a" <= c <= "z" else 2 if "A" <= c <= "Z" else 4 if "0" <= c <= "9" else 16 if c.isspace() else 8


class Value:
    """What the strength of a literal, or of a sum of literals, depends on: its characters' counts."""

    __slots__ = ("n", "counts", "kinds")

    def __init__(self, text: str = ""):
        self.n, self.counts, self.kinds = len(text), Counter(text), 0
        for c in self.counts:
            self.kinds |= _kind(c)

    def add(self, other: Value) -> None:
        self.n += other.n
        self.counts.update(other.counts)
        self.kinds |= other.kinds

    def strength(self) -> float:
        level = sum(c * math.log2(c) for c in self.counts.values()) / self.n if self.n else 0.0
        return _strength(self.n, math.log2(self.n) - level if self.n else 0.0, self.kinds)


def _strength(n: int, entropy: float, kinds: int) -> float:
    """0 to 1: how much n characters of this entropy (bits each) look like a credential; none with white space do."""
    if n < 8 or kinds & 16:
        return 0.0
    several = (kinds & 15).bit_count()
    return min(1.0, min(1.0, entropy / 4) * (0.4 + 0.2 * several if several > 1 else 0.4))


def stands_in(text: str) -> bool:
    return text.lower() in PLACEHOLDERS or bool(_STAND_IN.match(text))


def strength(literal: str) -> float:
    """0 to 1: how much a literal looks like a credential."""
    return 0.0 if stands_in(literal) else Value(literal).strength()


class Assignment:
    """A name and the terms of its right side: (kind, start, end), kind ``literal``, ``name`` or ``bare``."""

    __slots__ = ("name", "terms")

    def __init__(self, name: str, terms: list[tuple[str, int, int]]):
        self.name, self.terms = name, terms


def assignments(text: str) -> list[Assignment]:
    """All assignments in order. Time is linear in the text: a bare run that holds many separators is measured once."""
    found, run_end = [], 0
    for m in _TARGET.finditer(text):
        first = _FIRST_LETTER.search(text, m.start(1), m.end(1))
        if not first:
            continue
        terms, at = [], m.end()
        while t := _TERM.match(text, at):
            g = t.lastindex
            if g == 5:
                if t.end() >= run_end:
                    stop = _BARE_END.search(text, t.end())
                    run_end = stop.start() if stop else len(text)
                terms.append(("bare", t.end(), run_end))
                break  # a bare value reaches to the next delimiter, so no plus follows it
            terms.append(("literal" if g <= 3 else "name", t.start(g), t.end(g)))
            plus = _PLUS.match(text, t.end())
            if not plus:
                break
            at = plus.end()
        if terms:
            found.append(Assignment(text[first.start() : m.end(1)], terms))
    return found


def _bare_strengths(text: str, found: list[Assignment]) -> dict[tuple[int, int], float]:
    """Strength of the bare values of sensitive names; those that end together are suffixes of one run and take one pass."""
    runs: dict[int, list[int]] = defaultdict(list)
    for a in found:
        if a.terms[-1][0] == "bare" and sensitivity(a.name) >= LEAST_WEIGHT:
            runs[a.terms[-1][2]].append(a.terms[-1][1])
    out = {}
    for end, starts in runs.items():
        counts: Counter = Counter()
        total, kinds, at = 0.0, 0, end
        for start in sorted(set(starts), reverse=True):
            for c in reversed(text[start:at]):
                k = counts[c] = counts[c] + 1
                total += k * math.log2(k) - ((k - 1) * math.log2(k - 1) if k > 1 else 0.0)
                kinds |= _kind(c)
            at, n = start, end - start
            short = n <= 64 and stands_in(text[start:end]) or text[start : start + 5].lower() in ("your_", "your-") or text.startswith("${", start)
            out[start, end] = 0.0 if short else _strength(n, math.log2(n) - total / n, kinds)
    return out


def named_literals(text: str, least: float = 0.45) -> list[tuple[int, int, float]]:
    """(start, end, score) of literals that sensitive names are bound to, constants followed.

    A name's weight passes to all bindings of the names on its right side, and
    on from these; each binding is visited once, however they refer to each
    other. A sum is scored by the literals that it comes to: of a name in it
    the binding nearest before counts (else the first after); a name that no
    literal is bound to adds nothing.
    """
    found = assignments(text)
    if not any(sensitivity(a.name) >= LEAST_WEIGHT for a in found):
        return []
    constants: dict[str, list[int]] = defaultdict(list)
    for k, a in enumerate(found):
        if all(t[0] != "bare" for t in a.terms):
            constants[a.name].append(k)
    uses = [[text[x:y] for kind, x, y in a.terms if kind == "name"] for a in found]

    weight, passed = [0.0] * len(found), set()
    for k in sorted(range(len(found)), key=lambda j: -sensitivity(found[j].name)):
        level, stack = sensitivity(found[k].name), [k]
        if level < LEAST_WEIGHT:
            break
        while stack:  # the greatest weights come first, so what has one keeps it
            j = stack.pop()
            if weight[j]:
                continue
            weight[j] = level
            for name in uses[j]:
                if name not in passed:
                    passed.add(name)
                    stack += constants.get(name, ())

    def nearest(name: str, k: int) -> int | None:
        held = constants.get(name)
        if not held:
            return None
        at = bisect.bisect_left(held, k)
        if at:
            return held[at - 1]
        return next((b for b in held[:2] if b != k), None)

    values: dict[int, Value | None] = {}  # None while under way: a name that comes back to itself adds nothing

    def worth(top: int) -> Value:
        stack = [top]
        while stack:
            k = stack[-1]
            if values.get(k) is not None:
                stack.pop()
                continue
            below = [b for name in uses[k] if (b := nearest(name, k)) is not None]
            if k not in values:
                values[k] = None
                stack += [b for b in below if b not in values]
                continue
            made = Value()
            for kind, x, y in found[k].terms:
                if kind == "literal" and not stands_in(text[x:y]):
                    made.add(Value(text[x:y]))
            for b in below:
                if (part := values.get(b)) is not None:
                    made.add(part)
            values[k] = made
            stack.pop()
        return values[top]

    bare = _bare_strengths(text, found)
    spans: dict[tuple[int, int], float] = {}
    scored: dict[int, float] = {}

    def keep(x: int, y: int, score: float) -> None:
        if y > x:
            spans[x, y] = max(score, spans.get((x, y), 0.0))

    for k in sorted(range(len(found)), key=lambda j: -weight[j]):
        if weight[k] < LEAST_WEIGHT:
            break
        kind, x, y = found[k].terms[-1]
        if kind == "bare":
            score = sensitivity(found[k].name) * bare.get((x, y), 0.0)
            if score >= least:
                keep(x, y, score)
        if len(found[k].terms) == 1 and kind == "name" and text[x:y] not in constants:
            # A bare word with digits that names no constant is itself the value.
            score = weight[k] * strength(text[x:y]) if any(c.isdigit() for c in text[x:y]) else 0.0
            if score >= least:
                keep(x, y, score)
            continue
        score = weight[k] * worth(k).strength()
        if score < least:
            continue
        stack = [k]
        while stack:
            j = stack.pop()
            if j in scored and (j != k or scored[j] >= score):
                continue
            scored[j] = score
            for kind, x, y in found[j].terms:
                if kind == "literal" and not stands_in(text[x:y]):
                    keep(x, y, score)
            stack += [b for name in uses[j] if (b := nearest(name, j)) is not None and b not in scored]
    return sorted((a, b, s) for (a, b), s in spans.items())


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the three base kinds, in order."""
    spans = [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    low = text.lower()
    if any(w in low for w in WORDS):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    return sorted(spans)


def scan(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans: (start, kind number, end) in order."""
    text = text or ""
    base = base_spans(text)
    covers = [(a, b) for a, k, b in base if k == 0]  # in order and apart
    inside = lambda a, b: (at := bisect.bisect_right(covers, (a, math.inf))) > 0 and b <= covers[at - 1][1]
    more = []
    if "=" in text or ":" in text:
        more = [(a, 3, b) for a, b, _ in named_literals(text) if not inside(a, b)]
    return base, sorted(base + more)


def rendered(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """``text`` with each run of overlapping spans replaced."""
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], REPLACEMENT]
        at = max(at, end)
    return "".join([*out, text[at:]])


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_named, base_sha256 and spans of every row; nothing is shuffled."""

    def run(batch):
        found = [scan(t) for t in batch.column("text").to_pylist()]
        counts = [[sum(k == kind for _, k, _ in every) for _, every in found] for kind in range(4)]
        return {
            "doc_id": batch.column("doc_id"), "n_assign": counts[0], "n_access": counts[1], "n_hex": counts[2], "n_named": counts[3],
            "base_sha256": [hashlib.sha256(rendered(base).encode()).hexdigest() for base, _ in found], "spans": [rendered(every) for _, every in found],
        }

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, n_assign long, n_access long, n_hex long, n_named long, base_sha256 string, spans string")


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced in ``text`` and ``n_chars`` counted anew in the rows that changed."""

    def run(batches):
        import pyarrow as pa

        for batch in few_rows(batches):
            names = batch.schema.names
            texts = batch.column("text").to_pylist()
            new = [redact(t, spans) if t and (spans := scan(t)[1]) else t for t in texts]
            columns = list(batch.columns)
            columns[names.index("text")] = pa.array(new, batch.schema.field("text").type)
            if "n_chars" in names:
                kept = batch.column("n_chars").to_pylist()
                columns[names.index("n_chars")] = pa.array([k if a is b or a == b else len(b) for k, a, b in zip(kept, texts, new)], batch.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return arrow_rows(docs, run, docs.schema)
