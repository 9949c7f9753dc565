"""Secret scans: base patterns, and assignment-aware lexing of source and configuration text.

Base spans are leftmost non-overlapping matches per kind over the whole text:

* ``assign``  a secret-like name, ``:`` or ``=``, and a value of 6 characters or more;
* ``access``  an access key id of 20 characters or more;
* ``hex``     a run of 24 or more lower-case hex digits.

The method adds ``literal`` spans. A lexer reads a whole text into tokens, and a parser finds
name-literal pairs among them: assignments in source code (``x = "…"``, ``x := '…'``,
``"x" => "…"``, triple quotes, typed declarations ``x: str = "…"``, subscripts
``c["x"] = "…"``, several targets ``a, x = …, "…"``), JSON and YAML (``"x": "…"``, ``x: …``,
values and blocks on the next lines), INI and environment files (``X=…``), keyword arguments,
arguments of a call that gives the value (``x = f("…")``), a call's first argument as a name for
its second (``set("x", "…")``, ``environ.get("X", "…")``), command flags (``--x=…``,
``--x …``), XML elements (``<x>…</x>``), name-value attributes (``name="x" value="…"``), objects
with a value (``"x": {"value": "…"}``) and definitions (``#define X "…"``). A value may be a prefixed
literal (``b"…"``), stand in parentheses or brackets, be a choice (``y or "…"``, ``y || "…"``,
``y ? z : "…"``, ``"…" if y else "…"``) or go on in the next literal, across a continued line as well.

Names that stand for other names are resolved: ``a = "…"`` followed by ``client_secret = a``
scores the literal at ``a`` by the name ``client_secret``; joined literals (``"ab" + "cd"``)
count as one value. Weights flow from the most sensitive name down, so each name is followed
once, however long its chain. A literal is scored by the most sensitive name that reaches it
(its parts, split at case and punctuation) and by its own shape (length, character classes,
entropy; known non-secrets score nothing). Spans that lie in a base span aren't repeated.

Positions are code points, ends are exclusive. Lexing, parsing and following names take time in
proportion to the text, whatever its length. Defined results: null and empty texts have no
spans; every row is scanned on its own, so repeated rows give equal results; two spans with one
start are ordered by kind, then end; ids of any type, null or not, and extra columns of any name
pass through ``scan_secrets`` unless they are named like its outputs; an empty table gives an
empty result.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.runtime import in_batches

KINDS = ("assign", "access", "hex", "literal")
_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_LONG_HEX = re.compile(r"[0-9a-f]{24}")

#: Name parts by how surely their value is a secret.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "secret": 1.0, "apikey": 1.0, "privatekey": 1.0,
    "accesskey": 0.9, "token": 0.9, "credential": 0.9, "credentials": 0.9, "bearer": 0.9, "authorization": 0.8,
    "auth": 0.6, "signature": 0.5, "salt": 0.5, "cookie": 0.5, "session": 0.4, "key": 0.4, "pass": 0.8, "pin": 0.4, "dsn": 0.5,
}
#: Name parts that make a name harmless.
HARMLESS = {"public", "length", "len", "size", "count", "name", "type", "file", "path", "url", "prefix", "suffix", "field", "label", "column", "index", "id", "hint", "policy"}
#: Literals that stand for a secret but aren't one.
PLACEHOLDERS = {"changeme", "example", "placeholder", "password", "secret", "token", "none", "null", "true", "false", "undefined", "xxxxxx", "redacted", "your_password", "your_token"}

_TOKEN = re.compile(
    r"""
      (?P<long>\"{3}(?:[^"\\]|\\.|"(?!""))*"{3}|'{3}(?:[^'\\]|\\.|'(?!''))*'{3})
    | (?P<str>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`[^`\n]*`)
    | (?P<name>[A-Za-z_$][\w$-]*(?:\.[A-Za-z_$][\w$-]*)*)
    | (?P<op>\|\|=|\?\?=|<-(?=\s)|:=|=>|==+|!=|<=|>=|[=:+])
    | (?P<raw>[^\s"'`=:+,;(){}\[\]<>&|]+)
    | (?P<end>[\n,;(){}\[\]<>&|])
    """,
    re.VERBOSE | re.ASCII | re.DOTALL,
)
_ELEMENT = re.compile(r"<([A-Za-z_][\w.:-]*)>([^<>\n]{6,})</\1\s*>")
_IDENTIFIER = re.compile(r"[A-Za-z_][\w.-]*", re.ASCII)
_CONSTANT = re.compile(r"[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
#: What a text must hold for any name in it to be sensitive, in lower case.
_STEMS = sorted({next((t for t in SENSITIVE if t != s and t in s), s) for s in SENSITIVE})
#: Signs between a name and its value; letters before a literal; words and signs between alternatives; words that define a name.
_SIGNS, _PREFIXES, _OR, _DEFINES = ("=", ":", ":=", "=>", "||=", "??=", "<-"), {"b", "r", "u", "f", "br", "rb", "fr", "rf"}, {"or", "??", "?:"}, {"#define", "setenv"}
#: Attributes that hold a name, and those that hold its value; words before a value.
_NAMING, _VALUING, _BEFORE = {"name", "key", "id"}, {"value", "content", "default", "text"}, {"await", "new"}


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Matches of the three base patterns that are long enough."""
    spans = []
    if ":" in text or "=" in text:
        spans += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    at = 0
    while (hit := _LONG_HEX.search(text, at)) is not None:  # runs of hex are maximal, and each long one holds 24 digits
        run = _HEX.match(text, hit.start())
        spans.append((run.start(), run.end(), "hex"))
        at = run.end()
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


def name_weight(name: str) -> float:
    """How sensitive a name is, by its parts; harmless parts lower it."""
    parts = [p.lower() for p in _PARTS.findall(name)]
    if not parts:
        return 0.0
    joined = [a + b for a, b in zip(parts, parts[1:], strict=False)]
    weight = max((SENSITIVE.get(p, 0.0) for p in [*parts, *joined]), default=0.0)
    return weight * 0.3 if parts[-1] in HARMLESS or parts[0] == "public" else weight


def literal_weight(value: str) -> float:
    """0 for what can't be a secret, up to 1 for long mixed strings of high entropy."""
    n = len(value)
    if n < 6 or value.lower() in PLACEHOLDERS or len(set(value)) < 4 or value.isspace() or value.startswith(("${", "{{", "<", "%(")):
        return 0.0
    if value.count(" ") > 3 or value.count(" ") == 1 and all(w.isalpha() and w.islower() for w in value.split()):
        return 0.1
    classes = sum(any(f(c) for c in value) for f in (str.islower, str.isupper, str.isdigit)) + any(not c.isalnum() for c in value)
    entropy = -sum(k / n * math.log2(k / n) for k in Counter(value).values())
    return min(1.0, 0.2 * classes + 0.12 * entropy + 0.01 * min(n, 40))


_CLOSE = {"(": (")",), "[": ("]",)}


class _Parser:
    """Name-literal pairs of a text: (name, operands), an operand being (kind, value, start, end)."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.tokens = [("str" if m.lastgroup == "long" else m.lastgroup, m.group(), m.start(), m.end()) for m in _TOKEN.finditer(text)]
        self.pairs: list[tuple[str, list[tuple[str, str, int, int]]]] = []
        self.closing = self._closings()
        self._read()
        for m in _ELEMENT.finditer(text):
            self.pairs.append((m.group(1), [("raw", m.group(2), m.start(2), m.end(2))]))

    def _closings(self) -> dict[int, int]:
        """The token that closes each opening parenthesis."""
        out, waiting = {}, []
        for k, (kind, t, _, _) in enumerate(self.tokens):
            if kind == "end":
                if t == "(":
                    waiting.append(k)
                elif t == ")" and waiting:
                    out[waiting.pop()] = k
        return out

    def _prefix(self, k: int) -> bool:
        """Whether token ``k`` is the prefix of a literal that touches it."""
        kind, t, _, end = self.tokens[k]
        return kind == "name" and t.lower() in _PREFIXES and k + 1 < len(self.tokens) and self.tokens[k + 1][0] == "str" and self.tokens[k + 1][2] == end

    def _else(self, k: int) -> int | None:
        """The token after the ``else`` of a condition that begins at ``k``, if it stands before any separator."""
        while k < len(self.tokens) and self.tokens[k][0] not in ("end", "op"):
            if self.tokens[k][1] == "else":
                return k + 1
            k += 1
        return None

    def _is(self, k: int, *lexemes: str) -> bool:
        return 0 <= k < len(self.tokens) and self.tokens[k][1] in lexemes and self.tokens[k][0] in ("end", "op")

    def _literal(self, k: int) -> tuple[str, str, int, int]:
        _, t, start, end = self.tokens[k]
        edge = 3 if t[:3] in ('"""', "'''") and len(t) >= 6 else 1
        return "str", t[edge:-edge], start + edge, end - edge

    def _typed(self, k: int) -> int:
        """Where the ``=`` of a typed declaration stands whose ``:`` is at ``k``; ``k`` for other pairs."""
        tokens, depth, j, named = self.tokens, 0, k + 1, False
        while j < len(tokens):
            kind, t, _, _ = tokens[j]
            if t in ("[", "<", "("):
                depth += 1
            elif t in ("]", ">", ")"):
                depth -= 1
            elif kind == "op" and t == "=" and not depth and named:
                # YAML's x: a=b is one unquoted value
                return j if tokens[j - 1][3] < tokens[j][2] or j + 1 < len(tokens) and tokens[j + 1][0] == "str" else k
            elif kind == "name" or t in ("|", "&", "?") or depth and t == ",":
                named = True
            elif not (depth and kind == "str"):
                return k
            j += 1
        return k

    def _named(self, k: int) -> str | None:
        """The name of a pair whose sign follows token ``k``: a name, a string, a flag, or the last subscript."""
        tokens, (kind, lexeme, _, _) = self.tokens, self.tokens[k]
        if kind in ("name", "str"):
            return lexeme.strip("\"'`")
        if kind == "raw" and lexeme.startswith("-"):
            return lexeme.lstrip("-") or None
        if lexeme == "]" and k >= 3 and tokens[k - 2][1] == "[" and tokens[k - 1][0] in ("name", "str") and (tokens[k - 3][0] == "name" or tokens[k - 3][1] in ("]", ")")):
            return tokens[k - 1][1].strip("\"'`")
        return None

    def _arguments(self, k: int) -> list[tuple[str, str, int, int]]:
        """What a call whose ``(`` is at ``k`` is given: literals and names that are whole arguments, but not names of settings."""
        tokens, stop, out, j, first = self.tokens, self.closing.get(k), [], k + 1, True
        while stop is not None and j < stop:
            j += self._prefix(j)
            kind, t, start, end = tokens[j]
            whole = self._is(j + 1, ",", "\n") or j + 1 == stop
            if kind == "str" and whole:
                literal = self._literal(j)
                key = _CONSTANT.fullmatch(literal[1]) or first and self._is(j + 1, ",") and _IDENTIFIER.fullmatch(literal[1])
                if not key:
                    out.append(literal)
            elif kind == "name" and whole:
                out.append(("name", t, start, end))
            while j < stop and not self._is(j, ","):  # on to the next argument, over calls inside this one
                j = self.closing.get(j, j) + 1 if self._is(j, "(") else j + 1
            j, first = j + 1, False
        return out

    def _value(self, j: int) -> tuple[list[tuple[str, str, int, int]], int]:
        """Operands of the value at token ``j``, and where to read on."""
        tokens, n, operands, want, resume = self.tokens, len(self.tokens), [], True, None
        groups: list[str] = []  # open parentheses and brackets of the value
        choice = False
        while j < n:
            kind, t, start, end = tokens[j]
            if want and self._is(j, "(", "[") and not self._is(j + 1, ")", "]"):
                groups.append(t)
                j += 1
                continue
            if groups and (self._is(j, "\n") or want and self._is(j, *_CLOSE[groups[-1]])):
                j += 1 if self._is(j, "\n") else 0
                if self._is(j, *_CLOSE[groups[-1]]):
                    groups.pop()
                    j, want = j + 1, False
                continue
            if not want and groups and self._is(j, *_CLOSE[groups[-1]]):
                groups.pop()
                j += 1
                continue
            if not want and groups and groups[-1] == "[" and self._is(j, ","):
                j, want = j + 1, True
                continue
            if not want:
                after = None  # where a further operand of the same value begins
                if t in _OR and kind in ("name", "raw"):
                    after = j + 1
                elif self._is(j, "|") and self._is(j + 1, "|"):
                    after = j + 2
                elif kind == "raw" and t == "?" or choice and self._is(j, ":"):
                    after, choice = j + 1, kind == "raw"
                elif kind == "name" and t == "if":
                    after = self._else(j + 1)
                elif kind == "str" or self._prefix(j):
                    after = j if operands[-1][0] == "str" else None
                elif kind == "raw" and t == "\\" and self._is(j + 1, "\n") and j + 2 < n and (tokens[j + 2][0] == "str" or self._prefix(j + 2)):
                    after = j + 2
                if after is not None:
                    j, want = after, True
                    continue
            if want and self._prefix(j):
                j += 1
                continue
            if want and kind == "str":
                operands.append(self._literal(j))
            elif want and kind == "name" and self._is(j + 1, *_SIGNS) and not (choice and self._is(j + 1, ":")):
                break  # the next pair begins
            elif want and kind == "name" and t in _BEFORE and j + 1 < n and tokens[j + 1][0] == "name":
                j += 1
                continue
            elif want and kind == "name" and self._is(j + 1, "(") and tokens[j + 1][2] == end and j + 1 in self.closing:
                operands += self._arguments(j + 1)
                resume = j if resume is None else resume  # the call may hold pairs of its own
                j = self.closing[j + 1]
            elif want and kind in ("name", "raw"):
                stop = j  # unquoted values run on while tokens touch
                while stop + 1 < n and tokens[stop + 1][2] == tokens[stop][3] and tokens[stop + 1][0] in ("name", "raw", "op"):
                    stop += 1
                whole = self.text[start : tokens[stop][3]]
                operands.append(("name" if stop == j and kind == "name" else "raw", whole, start, tokens[stop][3]))
                j = stop
            elif not want and kind == "op" and t == "+":
                want = True
                j += 1
                continue
            else:
                break
            want = False
            j += 1
        return operands, j if resume is None else resume

    def _below(self, name: int, j: int) -> list[tuple[str, str, int, int]]:
        """A YAML value on the lines below its key, which is token ``name``; ``j`` is the token after its sign."""
        tokens = self.tokens
        if not (name == 0 or self._is(name - 1, "\n")):
            return []
        own = tokens[name][2] - (tokens[name - 1][3] if name else 0)
        while self._is(j, "|", ">") or j < len(tokens) and tokens[j][0] == "raw" and tokens[j][1] in ("-", "|-", ">-"):
            j += 1
        if not self._is(j, "\n"):
            return []
        at, lines = tokens[j][3], []
        while at < len(self.text):
            end = self.text.find("\n", at)
            end = len(self.text) if end < 0 else end
            line = self.text[at:end]
            if not line.strip() or len(line) - len(line.lstrip()) <= own or ": " in line or line.rstrip().endswith(":") or line.lstrip().startswith(("- ", "#")):
                break
            lines.append((at + len(line) - len(line.lstrip()), line.strip()))
            at = end + 1
        if not lines:
            return []
        value, start = "".join(t for _, t in lines), lines[0][0]
        end = lines[-1][0] + len(lines[-1][1])
        if len(lines) == 1 and len(value) > 1 and value[0] == value[-1] and value[0] in "\"'":
            return [("str", value[1:-1], start + 1, end - 1)]
        return [("raw", value, start, end)]

    def _targets(self, k: int) -> list[str]:
        """Names of an assignment to several targets whose last one is token ``k``."""
        i, names = k, [self.tokens[k][1]]
        while i >= 2 and self._is(i - 1, ",") and self.tokens[i - 2][0] == "name":
            i -= 2
            names.append(self.tokens[i][1])
        return names[::-1] if len(names) > 1 and (i == 0 or self._is(i - 1, "\n")) else []

    def _read(self) -> None:
        tokens, k, n, held = self.tokens, 0, len(self.tokens), None
        owners: list[str | None] = []  # names whose value is the object around token k
        owner: dict[int, str] = {}
        while k + 1 < n:
            kind, t, _, end = tokens[k]
            follows = tokens[k + 1]
            if self._is(k, "{"):
                owners.append(owner.get(k))
            elif self._is(k, "}") and owners:
                owners.pop()
            name = self._named(k) if follows[0] == "op" and follows[1] in _SIGNS else None
            if name is not None:
                targets = self._targets(k) if kind == "name" and follows[1] == "=" else []
                if targets:
                    values, j = [], k + 2
                    while True:
                        operands, j = self._value(j)
                        values.append(operands)
                        if not operands or not self._is(j, ",") or len(values) == len(targets):
                            break
                        j += 1
                    self.pairs += [(x, v) for x, v in zip(targets, values, strict=False) if v and len(values) == len(targets)]
                    k = max(j, k + 2)
                    continue
                at = self._typed(k + 1) if follows[1] == ":" and kind == "name" else k + 1
                operands, j = self._value(at + 1)
                if not operands and follows[1] == ":":
                    operands = self._below(k, k + 2)
                if self._is(at + 1, "{"):
                    owner[at + 1] = name
                if operands:
                    self.pairs.append((name, operands))
                    if owners and owners[-1] is not None and name.lower() in _VALUING:
                        self.pairs.append((owners[-1], operands))
                    if held is not None and k - held[1] <= 3 and name.lower() in _VALUING:
                        self.pairs.append((held[0], operands))
                    single = name.lower() in _NAMING and len(operands) == 1 and operands[0][0] in ("str", "name") and _IDENTIFIER.fullmatch(operands[0][1])
                    held = (operands[0][1], j) if single else None
                # what stands between the two signs of a declaration may be a name of the value, too
                k = max(j, k + 2) if at == k + 1 else k + 2
                continue
            if t in _DEFINES and kind in ("raw", "name") and follows[0] == "name" and k + 2 < n and tokens[k + 2][0] in ("str", "name", "raw"):
                operands, _ = self._value(k + 2)
                self.pairs.append((follows[1], operands))
            elif kind == "raw" and t.startswith("-") and len(t) > 2 and follows[0] in ("str", "name", "raw") and not follows[1].startswith("-") and follows[2] > end and not self._is(k + 2, "=", ":"):
                operands, _ = self._value(k + 1)
                self.pairs.append((t.lstrip("-"), operands))
            elif kind == "name" and self._is(k + 1, "(") and follows[2] == end and k + 3 < n and tokens[k + 2][0] == "str" and self._is(k + 3, ",") and _IDENTIFIER.fullmatch(tokens[k + 2][1][1:-1]):
                operands, _ = self._value(k + 4)
                self.pairs.append((tokens[k + 2][1][1:-1], operands))
            k += 1


def literal_spans(text: str, threshold: float = 0.45) -> list[tuple[int, int, str]]:
    """Spans of literals whose best name and own shape score ``threshold`` or more."""
    low = text.lower()
    if not any(s in low for s in _STEMS) or not any(c in text for c in "=:(<-#") and "setenv" not in low:
        return []
    # constants: each name holds literals or other names; sensitivity flows from a name to what it holds
    holds: dict[str, list[tuple[str, str, int, int]]] = {}
    for name, operands in _Parser(text).pairs:
        holds.setdefault(name, []).extend(operands)
    best: dict[tuple[int, int], tuple[float, str]] = {}
    # the most sensitive names come first, so what they reach needn't be followed again
    weights = sorted(((name_weight(name), name) for name in holds), key=lambda x: -x[0])
    seen: set[str] = set()
    for weight, name in weights:
        if weight <= 0:
            break
        todo = [] if name in seen else [name]
        seen.add(name)
        while todo:
            for kind, value, start, end in holds[todo.pop()]:
                if kind == "name" and value in holds:
                    if value not in seen:
                        seen.add(value)
                        todo.append(value)
                elif weight > best.get((start, end), (0.0, ""))[0]:
                    best[(start, end)] = (weight, value)
    out = []
    for (start, end), (weight, value) in best.items():
        if end > start and weight * literal_weight(value) >= threshold:
            out.append((start, end, "literal"))
    return sorted(out)


def all_spans(text: str | None) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans, and base plus added spans, each by start, then kind."""
    if not text:
        return [], []
    base = base_spans(text)
    # a span lies in a base span if one that starts no later ends no earlier
    starts, reach = [s for s, _, _ in base], list(accumulate((e for _, e, _ in base), max))
    added = []
    for start, end, kind in literal_spans(text):
        at = bisect_right(starts, start)
        if not at or reach[at - 1] < end:
            added.append((start, end, kind))
    return base, sorted(base + added, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def written(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def scan_secrets(docs: DataFrame, *, text_col: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """Columns ``keep`` (all by default) with ``secrets``: an array of (kind, start, end, value), base spans and added ones; ``secret_base``: base spans as text."""

    def compute(texts: list) -> list[list]:
        found, base_text = [], []
        for text in texts:
            base, spans = all_spans(text)
            found.append([{"kind": kind, "start": start, "end": end, "value": text[start:end]} for start, end, kind in spans])
            base_text.append(written(base))
        return [base_text, found]

    names = [c for c in (docs.columns if keep is None else keep) if c not in ("secrets", "secret_base")]
    return in_batches(docs, [text_col], [(c, c) for c in names], "secret_base string, secrets array<struct<kind: string, start: long, end: long, value: string>>", compute)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=("doc_id",))
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    text = F.transform("secrets", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2("secret_base", 256).alias("base_sha256"),
        F.array_join(text, ",").alias("spans"),
        count("literal").alias("n_literal"),
    )
