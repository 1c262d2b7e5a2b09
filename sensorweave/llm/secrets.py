"""Assignment-aware secret scan.

Three base patterns are matched as they stand.  Beside them every assignment,
wherever in a line it stands, is lexed into a name-literal pair, as source code
and configuration files write them: ``name = "x"``, ``name: x``, ``name := x``,
``"name" => 'x'``, ``NAME=x``, ``const name = a + "x"``, ``<name>x</name>``,
``<add key="name" value="x"/>``, YAML blocks.  A right-hand side ends with its
line unless it goes on: in triple quotes or backquotes, in parentheses, behind a
``+`` or a backslash at the line's end.  Constants are propagated: a name on the right stands for the literals it was last given, so
``a = "..."`` followed by ``password = a`` reports the first literal.  A pair
scores by how sensitive its target's name is and how much its value looks like
a secret; from ``least`` on its literals are reported as kind ``name``.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import modest_batches
from .token_files import text_batches

#: The base patterns, their least lengths, and the order of kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_VALUE = 6
KINDS = ("assign", "access", "hex", "name")

#: Words, and pairs of words, that make a name sensitive, with their weight.
SENSITIVE = {
    "password": 0.6,
    "passwd": 0.6,
    "pwd": 0.6,
    "passphrase": 0.6,
    "secret": 0.6,
    "token": 0.6,
    "apikey": 0.6,
    "credential": 0.5,
    "credentials": 0.5,
    "privatekey": 0.6,
    "accesskey": 0.6,
    "secretkey": 0.6,
    "signingkey": 0.6,
    "encryptionkey": 0.6,
    "authkey": 0.6,
    "auth": 0.4,
    "bearer": 0.5,
}
#: Literals that stand for a secret to be filled in.
PLACEHOLDER = re.compile(r"(?i)^(?:<.*>|\$\{.*\}|\{\{.*\}\}|%\w+%|x{3,}|\*{3,}|\.{3,}|change_?me|example.*|your[_-].*|todo|none|null|nil|true|false|undefined|placeholder)$")

_PAIR = re.compile(
    r"""(?<![\w.$@])(?<![\w.$@]-)(?P<quote>["']?)(?P<name>[A-Za-z_$@][\w.$@-]*+(?:\[["']?\w+["']?\])?)(?P=quote)[^\S\n]*"""
    r"""(?::[^\S\n]*(?P<kind>[A-Za-z_]\w*)[^\S\n]*(?==[^=>]))?(?P<op>:=|=>|=(?!=)|:(?!:))[^\S\n]*(?=\S)"""
)
_TERM = re.compile(r"""\s*(?:(?P<string>[rbfuRBFU]?(?P<mark>\"{3}|'{3}|["'`])(?P<inside>(?:\\.|(?!(?P=mark))[^\\])*)(?P=mark))|(?P<word>[^\s"'`+,;#()\[\]{}]+))\s*""")
_STRING = re.compile(r"""[rbfuRBFU]?["'`]""")
_LONG_STRING = re.compile(r"""\s*[rbfuRBFU]?(\"{3}|'{3}|`)""")
_LINE_END = re.compile(r"[^\S\n]*\\?[^\S\n]*\n[^\S\n]*")
_BLOCK = re.compile(r"[|>][-+]?[^\S\n]*\n[^\S\n]+(?P<inside>[^\s].*)")
_ELEMENT = re.compile(r"""<(?P<name>[A-Za-z_][\w.:-]*)(?:\s[^<>]*)?>\s*(?P<inside>[^<>\s][^<>\n]*?)\s*</(?P=name)\s*>""")
_ATTRIBUTES = re.compile(r"""\b(?:key|name|id)\s*=\s*(["'])(?P<name>[^"'<>\n]+)\1\s+(?:[\w:]+\s*=\s*(?:"[^"<>\n]*"|'[^'<>\n]*')\s+)?value\s*=\s*(["'])(?P<inside>(?:(?!\3)[^<>\n])+)\3""")
_DOT = re.compile(r"""\.\s*(["'`$]|[A-Za-z_][\w.]*)""")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_REFERENCE = re.compile(r"^\$?\{?([A-Za-z_][\w.]*)\}?$")
#: A literal as (start, end, value) and whether it was quoted.
Literal = tuple[int, int, str, bool]


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, by start, then kind as listed."""
    found = [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE] if "=" in text or ":" in text else []
    found += [(*m.span(), "access") for m in ACCESS.finditer(text)] if "AKIA" in text else []
    found += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return ordered(found)


def ordered(spans: Iterable[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def name_weight(name: str) -> float:
    parts = [p.lower() for p in _PARTS.findall(name)]
    pairs = [a + b for a, b in zip(parts, parts[1:], strict=False)]
    return max((SENSITIVE.get(p, 0.0) for p in [*parts, *pairs]), default=0.0)


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def value_weight(value: str, quoted: bool) -> float:
    """-1 for what cannot be a secret, else up to 0.4."""
    if len(value) < LEAST_VALUE or PLACEHOLDER.match(value) or re.search(r"\s", value):
        return -1.0
    classes = sum(bool(re.search(c, value)) for c in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return 0.1 * quoted + 0.1 * (classes >= 2) + 0.1 * (classes >= 3 or len(value) >= 16) + 0.1 * (entropy(value) >= 2.8)


def _literals(text: str, pos: int, end: int, constants: dict[str, list]) -> list:
    """The literals of a right-hand side of terms joined by ``+`` or ``.``, and of strings side by side; a constant is held as its own list.

    ``end`` is that of the line; the lines that the right-hand side goes on to follow.
    """
    out: list = []
    if block := _BLOCK.match(text, pos):
        return [(*block.span("inside"), block["inside"], False)]
    if text.startswith("(", pos):  # lines of a parenthesis are joined
        pos, end = pos + 1, len(text)
    while m := _TERM.match(text, pos, len(text) if _LONG_STRING.match(text, pos, end) else end):
        pos, joined = m.end(), False
        if pos > end:
            end = _line_end(text, pos)
        if (rest := _LINE_END.match(text, pos)) and "\\" in rest[0]:
            pos, end = rest.end(), _line_end(text, rest.end())
        if m["string"] is not None:
            out.append((m.start("inside"), m.end("inside"), m["inside"], True))
            joined = _STRING.match(text, pos, end) is not None
        else:
            word = m["word"]
            if word.endswith(".") and _STRING.match(text, m.end("word"), end):  # a."b"
                word, joined = word[:-1], True
            ref = _REFERENCE.match(word)
            if ref and ref[1] in constants:
                out.append(constants[ref[1]])
            else:
                out.append((m.start("word"), m.start("word") + len(word), word, False))
        if joined:
            continue
        if text.startswith("+", pos, end):
            pos += 1
            if rest := _LINE_END.match(text, pos):
                pos, end = rest.end(), max(end, _line_end(text, rest.end()))
        elif (dot := _DOT.match(text, pos, end)) and (dot[1] in "\"'`$" or (ref := _REFERENCE.match(dot[1])) and ref[1] in constants):
            pos += 1
        else:
            break
    return out


def _line_end(text: str, pos: int) -> int:
    end = text.find("\n", pos)
    return end if end >= 0 else len(text)


def _flat(terms: list) -> list[Literal]:
    """The literals of terms and of the constants among them, in order, each constant once."""
    out: list[Literal] = []
    seen = {id(terms)}
    stack = [iter(terms)]
    while stack:
        for term in stack[-1]:
            if isinstance(term, tuple):
                out.append(term)
            elif id(term) not in seen:
                seen.add(id(term))
                stack.append(iter(term))
                break
        else:
            stack.pop()
    return out


def assigned_spans(text: str, least: float = 0.8) -> list[tuple[int, int, str]]:
    """Literals whose assignment, direct or through constants, scores ``least`` or more."""
    if "=" not in text and ":" not in text and "</" not in text:
        return []
    constants: dict[str, list] = {}  # of literals and of earlier constants' lists, so that growing ones stay small
    found: set[tuple[int, int, str]] = set()
    for m in _PAIR.finditer(text):
        terms = _literals(text, m.end(), _line_end(text, m.end()), constants)
        names = [n.lstrip("$@") for n in (m["name"], m["kind"]) if n]  # in "x: y = ..." either may be the target
        if terms:
            constants.update((n, terms) for n in names)
        if weight := max(map(name_weight, names)):
            literals = _flat(terms)
            value = "".join(v for _, _, v, _ in literals)
            if weight + value_weight(value, any(q for *_, q in literals)) >= least - 1e-9:
                found.update((s, e, "name") for s, e, _, _ in literals if e > s)
    for pattern, mark in ((_ELEMENT, "</"), (_ATTRIBUTES, "value")):
        if mark in text:
            for m in pattern.finditer(text):
                if (weight := name_weight(m["name"])) and weight + value_weight(m["inside"], True) >= least - 1e-9:
                    found.add((*m.span("inside"), "name"))
    return ordered(found)


def all_spans(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans, and all spans: assigned literals inside a base span add nothing."""
    base = base_spans(text)
    more = [s for s in assigned_spans(text) if not any(a <= s[0] and s[1] <= b for a, b, _ in base)]
    return base, ordered([*base, *more])


def redacted(text: str, spans: list[tuple[int, int, str]], mark: str = "[secret]") -> str:
    """``text`` with every span (overlapping ones as one) replaced by ``mark``."""
    out, at = [], 0
    for start, end, _ in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def _written(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def secret_report(docs: DataFrame) -> DataFrame:
    """Span counts, digest and spans of every row; a null text is an empty one."""
    modest_batches(docs.sparkSession)

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in text_batches(batches):
            rows = []
            for text in texts:
                base, spans = all_spans(text)
                kinds = Counter(k for _, _, k in base)
                rows.append((kinds["assign"], kinds["access"], kinds["hex"], hashlib.sha256(_written(base).encode()).hexdigest(), _written(spans)))
            a, b, c, digest, spans = zip(*rows, strict=True)
            counts = [pa.array(x, pa.int64()) for x in (keys, a, b, c)]
            yield pa.RecordBatch.from_arrays([*counts, pa.array(digest), pa.array(spans, pa.string())], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select("doc_id", "text").mapInArrow(scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact_documents(docs: DataFrame) -> DataFrame:
    """``docs``, all rows and columns, with secrets replaced in ``text``; ``n_chars`` follows changed texts."""
    modest_batches(docs.sparkSession)
    names = docs.columns
    at, n_at = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def redact(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            new = [t if not t or not (spans := all_spans(t)[1]) else redacted(t, spans) for t in texts]
            columns = list(batch.columns)
            columns[at] = pa.array(new, columns[at].type)
            if n_at is not None:
                counts = [n if a == b else len(b) for n, a, b in zip(columns[n_at].to_pylist(), texts, new, strict=True)]
                columns[n_at] = pa.array(counts, columns[n_at].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(redact, docs.schema)
