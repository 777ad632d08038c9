"""Secret scans by assignment-aware lexing.

Source and configuration text is lexed into assignments of a name (also with a
type annotation, an index or in brackets) to an expression: quoted literals,
with a prefix, in triple quotes or back quotes too, bare values, references to
names assigned anywhere in the text (also ``${name}`` and ``$name``), chains of
these by ``+`` or side by side, over line ends where the syntax allows it, in
parentheses, and as arguments of calls and ``or`` alternatives, each of which is
scored by itself; keys of look-ups such as ``getenv`` are no literals. Constants
propagate through references, so a literal is scored by the most sensitive name
it reaches. Pattern spans (assign, access, hex) are found beside and always kept.
Each text is handled whole, in the task that scans it.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

KINDS = ("assign", "access", "hex", "literal")

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                     re.IGNORECASE | re.ASCII)
# fixed values: the words one of which every assign match starts with
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")

# fixed values: parts of names and how sensitive a name that has them is
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0,
    "credential": 0.9, "credentials": 0.9, "bearer": 0.8, "auth": 0.7, "authorization": 0.8, "privatekey": 1.0,
    "accesskey": 1.0, "secretkey": 1.0, "signingkey": 0.9, "encryptionkey": 0.9, "clientsecret": 1.0, "jwt": 0.7,
}
_ARMOUR = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY")
# fixed values: words of prompts and sentences, which no pass phrase is made of
_SENTENCE = {"the", "and", "for", "not", "your", "you", "please", "enter", "must", "with", "this", "that", "from", "here",
             "are", "was", "has", "have", "should", "will", "can", "cannot", "invalid", "required", "missing", "new", "old",
             "password", "passwd", "secret", "token", "key", "error", "failed", "wrong", "valid", "value", "string", "user"}
# fixed values: literals that stand for a secret without being one
PLACEHOLDERS = {"changeme", "example", "placeholder", "password", "secret", "none", "null", "true", "false",
                "undefined", "your_password", "your_token", "your_api_key", "xxxxxxxx", "todo", "test"}

_NAME = r"[A-Za-z_$][A-Za-z0-9_$.-]*+"
# a type's arguments, brackets nested to any use's depth
_ARGS = r"[^\[\]<>()=\n]*+"
for _ in range(6):
    _ARGS = rf"(?:[^\[\]<>()=\n]|[\[<(]{_ARGS}[\]>)])*+"
_TYPE1 = rf"[&*]?(?:'[a-z]\w*+\x20+)?(?:(?:mut|const|readonly)\x20+)?[A-Za-z_][\w.]*+(?:::\w++)*+(?:[\[<]{_ARGS}[\]>])*+[?!]?"
_TYPE = rf"{_TYPE1}(?:\x20*+\|\x20*+{_TYPE1})*+"
# names of any length: looked for only where a run of their characters begins;
# name = value, name: value, name: type = value, name[3] = value, x["name"] = value, var name string = value
_TARGET = re.compile(rf"""(?:(?P<go>\b(?:var|const)\x20+(?P<gname>{_NAME})\x20+(?:\[\])?(?:string|byte|rune)[\x20\t]*=)
    |(?P<q>["']?)(?<![A-Za-z0-9_$.-])[0-9.-]*+(?P<name>{_NAME})(?P=q)(?:\]|\[\w*+\])?\??[\x20\t]*+
    (?::[\x20\t]*+{_TYPE}(?:[\x20\t]++=(?![=>])|=(?=[\x20\t]*+[rbfuRBFUL]{{0,2}}["'`(]))|:=|=>|=(?!=)|:(?![:/=])))[\x20\t]*+""", re.VERBOSE)
_QUOTED = re.compile(r"""(?:[rbfuRBFUL]{1,2}|u8|[@$])?(?:(?P<q3>\"""|\'\'\')(?P<lit3>(?:\\.|(?!(?P=q3))[^\\])*+)(?P=q3)
    |`(?P<lit1>(?:\\.|[^\\`])*+)`
    |(?P<quote>["'])(?P<lit>(?:\\.|(?!(?P=quote))[^\\\n])*+)(?P=quote))""", re.VERBOSE | re.DOTALL)
_BRACED = re.compile(rf"\$\{{(?P<braced>{_NAME})(?::[-=]?(?P<default>[^}}\n]*+))?\}}")
_BARE = re.compile(r"[A-Za-z0-9+/_$.=@!%^*~-]+")
_CALLEE = re.compile(r"(?:new\x20+)?[A-Za-z_$][\w$.]*+(?=\()")
_KEYED = re.compile(r"""[A-Za-z_$][\w$.]*+(?:\[(?:"[^"\n]*+"|'[^'\n]*+'|\d++)\])++""")
_ARGUMENT = re.compile(r"(?P<key>[A-Za-z_]\w*+)[\x20\t]*=(?!=)[\x20\t]*")
# fixed values: named arguments that hold the value of a look-up that finds none
_DEFAULTS = {"default", "default_value", "defaultValue", "fallback", "failobj"}
# calls whose first argument names what they look up
_LOOKUP = re.compile(r"(?:get|env|fetch|lookup|pop|setdefault|property|config|setting|param)[A-Za-z]*$", re.IGNORECASE)
_REFERENCE = re.compile(rf"\$\{{({_NAME[:-2]}*+)\}}|\$([A-Za-z_]\w*+)")
_PAREN = re.compile(r"""[()"'`]""")
_SPACE = re.compile(r"[\x20\t]*+(?:\\\r?\n[\x20\t]*+)*+")
_BLANK = re.compile(r"(?:[\x20\t\r\n]|\\\r?\n)*+")
# white space and comments to the end of a line
_LINES = re.compile(r"(?:[\x20\t\r\n]|\\\r?\n|//[^\n]*+|\#[^\n]*+)*+")
_BLOCK = re.compile(r"[|>][-+0-9]*+[\x20\t]*+\r?\n[\x20\t]*+")
_JOIN = re.compile(r"\+(?![+=])|\.\.?(?=[\x20\t\r\n]*[\"'$])")
_OR = re.compile(r"\|\||\?\?|\?:|or\b")
_SPLIT = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z0-9])(?=[A-Z])")


def sensitivity(name: str) -> float:
    """How sensitive a target name is: its parts, and neighbouring parts joined."""
    parts = [p.lower() for p in _SPLIT.split(name) if p]
    joined = parts + [a + b for a, b in zip(parts, parts[1:])]
    return max((SENSITIVE.get(p, 0.0) for p in joined), default=0.0)


def strength(literal: str) -> float:
    """How much a literal looks like a secret, 0 to 1: length and character
    entropy; placeholders and plain lower-case words are 0, private keys in armour
    and pass phrases 1."""
    if len(literal) < 8 or literal.lower() in PLACEHOLDERS:
        return 0.0
    if " " in literal and (_ARMOUR.search(literal) or _is_phrase(literal)):
        return 1.0
    if literal.isalpha() and (literal.islower() or literal.istitle()):
        return 0.0
    return _spread(Counter(literal))


def _is_phrase(literal: str) -> bool:
    """Four to twelve plain words that make no sentence: none of its function words."""
    words = literal.split(" ")
    return 4 <= len(words) <= 12 and all(w.isalpha() and w.islower() and len(w) > 2 and w not in _SENTENCE for w in words)


def _by_counts(counts: Counter[str]) -> float | None:
    """Strength of a literal of over 16 characters by their counts; None if the
    literal itself must be seen."""
    if " " in counts:
        return None
    if all(map(str.islower, counts)) and all(map(str.isalpha, counts)):
        return 0.0
    if not all(map(str.isalpha, counts)) or (
            all(c.islower() or c.isupper() for c in counts) and sum(n for c, n in counts.items() if c.isupper()) > 1):
        return _spread(counts)           # no word
    return None


def _spread(counts: Counter[str]) -> float:
    """Strength by length and entropy alone, from the counts of the characters."""
    if len(counts) < 4 or " " in counts:
        return 0.0
    n = counts.total()
    bits = -sum(c / n * math.log2(c / n) for c in counts.values())
    return min(1.0, bits / 3.5) * min(1.0, n / 12)


_NEW, _READ = -2, -1             # ends of values not known yet


class _Value:
    """What a name holds: spans of literals and the values of other names, in
    order. Values are shared, not copied, so all of a text's take about its size."""
    __slots__ = ("items", "end", "counts", "told", "apart")

    def __init__(self, items: list, apart: bool = False):
        self.items = items
        self.apart = apart               # alternatives, not parts of one literal
        self.end = _NEW                  # where the last span ends
        self.counts: Counter[str] | None = None
        self.told = False                # whether all its spans are among the found ones

    def settle(self, last: int) -> None:
        """Set the end; ``last`` if a later name's value is among the items."""
        ends = (x[1] if not isinstance(x, _Value) else x.end if x.end >= 0 else last for x in self.items)
        self.end = max(ends, default=0)

    def spans(self) -> list[tuple[int, int]]:
        """Every span once, by first place."""
        out, seen, stack = {}, set(), [self]
        while stack:
            x = stack.pop()
            if not isinstance(x, _Value):
                out[x] = None
            elif id(x) not in seen:
                seen.add(id(x))
                stack += reversed(x.items)
        return list(out)

    def strength(self, text: str) -> float:
        """Strength of the spans put together."""
        old = [x for x in self.items if isinstance(x, _Value)]
        new = {x for x in self.items if not isinstance(x, _Value)}
        if len(old) == 1 and old[0].counts is not None and all(a >= old[0].end for a, _ in new):
            counts = Counter(old[0].counts)      # a chain that grows by new literals is not read again
        else:
            counts, new = Counter(), self.spans()
        for a, b in new:
            counts.update(text[a:b])
        self.counts = counts
        if counts.total() > 16 and (known := _by_counts(counts)) is not None:    # longer than any placeholder
            return known
        return strength("".join(text[a:b] for a, b in self.spans()))

    def tell(self, found: set[tuple[int, int]]) -> None:
        """Add all spans to ``found``, each value once."""
        stack = [self]
        while stack:
            x = stack.pop()
            if not isinstance(x, _Value):
                found.add(x)
            elif not x.told:
                x.told = True
                stack += x.items


class _Frame:
    """An expression, or one in parentheses: alternatives, each a list of items."""
    __slots__ = ("callee", "done", "items", "first", "opened")

    def __init__(self, callee: tuple[int, int] | None = None, lookup: bool = False):
        self.callee, self.first = callee, lookup
        self.opened = callee[1] if callee else -1
        self.done: list[list] = []
        self.items: list = []

    def cut(self) -> None:
        """End an alternative or argument; the key of a lookup is no literal."""
        if self.items and not self.first:
            self.done.append(self.items)
        self.items, self.first = [], False

    def result(self) -> list:
        last = [self.items] if self.items and not self.first else []
        alts = self.done + last
        return alts[0] if len(alts) == 1 else [_Value([_Value(x) for x in alts], True)] if alts else []


class _Bare:
    """Where bare words end. A run of their characters is measured once, also where
    many targets lie in it."""

    def __init__(self, text: str):
        self.text = text
        self.start = self.end = self.solid = 0

    def at(self, pos: int) -> int:
        """The end of the bare word at ``pos``, ``pos`` if there is none."""
        if not self.start <= pos < self.end:
            m = _BARE.match(self.text, pos)
            if not m:
                return pos
            self.start, self.end = m.span()
            self.solid = self.end
            while self.solid > pos and self.text[self.solid - 1] == "=":
                self.solid -= 1
        return self.end

    def assigns(self, pos: int) -> bool:
        """Whether the word at ``pos`` has an equals sign before its padding: no name
        or sum of names, and no part of a chain."""
        return 0 <= self.text.find("=", pos, self.end) < self.solid


def _suffix_strengths(text: str, spans: set[tuple[int, int]]) -> dict[tuple[int, int], float]:
    """Strengths of long spans that share their end with others, each character read once."""
    by_end: dict[int, list[int]] = {}
    for a, b in spans:
        if b - a > 16:
            by_end.setdefault(b, []).append(a)
    out = {}
    for b, starts in by_end.items():
        if len(starts) > 1:
            counts, last = Counter(), b
            for a in sorted(starts, reverse=True):
                counts.update(text[a:last])
                last = a
                known = _by_counts(counts)
                out[a, b] = strength(text[a:b]) if known is None else known
    return out


def _closings(text: str) -> dict[int, int]:
    """Where each parenthesis outside of literals is closed."""
    out, opened = {}, []
    pos = 0
    while m := _PAREN.search(text, pos):
        pos = m.end()
        if m[0] == "(":
            opened.append(m.start())
        elif m[0] == ")":
            if opened:
                out[opened.pop()] = m.start()
        elif q := _QUOTED.match(text, m.start()):
            pos = q.end()
    return out


def _expression(text: str, pos: int, closing: Callable[[], dict[int, int]], bare: _Bare) -> tuple[list, int, bool]:
    """The items of the value at ``pos``: spans, references (name, span) and
    values; where it ends; whether it is plain (no parentheses, calls or
    literals that may hold lines of their own)."""
    frames, plain = [_Frame()], True
    start = pos
    end = pos
    if m := _BLOCK.match(text, pos):
        pos = m.end()
    else:
        nxt = _BLANK.match(text, pos).end()
        if "\n" in text[pos:nxt]:        # on the next line only what cannot be a pair of its own
            if not (_QUOTED.match(text, nxt) or text[nxt:nxt + 1] == "(") or _TARGET.match(text, nxt):
                return [], start, True
            pos = nxt
    while True:
        top = frames[-1]
        quoted = jumped = False
        # an operand
        if len(frames) > 1 and (m := _ARGUMENT.match(text, pos)) and top.callee:
            if m["key"] not in _DEFAULTS:        # the argument is a target of its own
                close = closing()
                top.cut()
                top.callee = None
                if top.opened not in close:
                    break
                frames.pop()
                frames[-1].items += top.result()
                pos = end = close[top.opened] + 1
                quoted = jumped = True
            else:
                pos, top.first = m.end(), False
            top = frames[-1]
        if jumped:
            pass
        elif m := _QUOTED.match(text, pos):
            group = "lit" if m["quote"] else "lit3" if m["q3"] else "lit1"
            a, b = m.span(group)
            if group != "lit":
                plain = False
                a, b = a + len(m[group]) - len(m[group].lstrip()), b - len(m[group]) + len(m[group].rstrip())
                b = max(a, b)
            top.items.append((text[a:b], (a, b), True) if "$" in m[group] else (a, b))
            pos, quoted = m.end(), True
        elif text[pos:pos + 1] == "(":
            frames.append(_Frame())
            pos, plain = _LINES.match(text, pos + 1).end(), False
            continue
        elif m := _BRACED.match(text, pos):
            default = [m.span("default")] if m["default"] else []
            top.items.append((m["braced"], default[0] if default else None, False))
            if default:
                top.items[-1] = _Value([_Value([top.items[-1]]), _Value(default)], True)
            pos = m.end()
        elif m := _CALLEE.match(text, pos):
            frames.append(_Frame(m.span(), bool(_LOOKUP.search(m[0]))))
            pos, plain = _LINES.match(text, m.end() + 1).end(), False
            continue
        elif m := _KEYED.match(text, pos):
            pos, plain = m.end(), False
        elif (b := bare.at(pos)) > pos:
            a = pos
            if len(frames) == 1 and bare.assigns(pos):
                top.items.append((a, b))
                end = b
                break
            if text[b - 1] == "+" and b - a > 1 and _QUOTED.match(text, _LINES.match(text, b).end()):
                b -= 1                   # name+"literal"
            top.items.append((text[a:b], (a, b), False))
            pos = b
        elif not (text[pos:pos + 1] == ")" and len(frames) > 1):
            break
        end = pos
        # what follows it
        while True:
            top = frames[-1]
            inside = len(frames) > 1
            near = (_LINES if inside else _SPACE).match(text, pos).end()
            if inside and text[near:near + 1] == ")":
                frames.pop()
                frames[-1].items += top.result()
                pos = end = near + 1
                quoted = True
                continue
            break
        if inside and text[near:near + 1] == ",":
            top.cut()
            pos = _LINES.match(text, near + 1).end()
            continue
        if m := _OR.match(text, near):
            pos, plain = _LINES.match(text, m.end()).end(), False
            if _QUOTED.match(text, pos):         # a word before it is a name, known or not
                top.items = [(x[0], None, False) if isinstance(x, tuple) and len(x) == 3 and not x[2] else x
                             for x in top.items]
            top.cut()
            continue
        if quoted and _QUOTED.match(text, near):
            pos = near                   # literals side by side
            continue
        far = (_LINES if inside else _BLANK).match(text, pos).end()
        m = _JOIN.match(text, far)
        if not m:
            break
        pos = _LINES.match(text, m.end()).end()
        if not inside and "\n" in text[near:far] and (
                not quoted and not _QUOTED.match(text, pos) or _TARGET.match(text, pos)):
            break                        # a line of its own that begins with +
    while len(frames) > 1:               # parentheses left open
        top = frames.pop()
        frames[-1].items += [top.callee] * (top.callee is not None) + top.result()
    return frames[0].result(), end, plain


def _named_values(name: str, names: dict[str, _Value]) -> list | None:
    """The values that a bare word refers to; a+b may be two."""
    if (got := names.get(name) or names.get(name.removeprefix("$"))) is not None:
        return [got]
    if "+" in name:
        pieces = name.split("+")
        if any(p in names for p in pieces) and all(pieces):
            return [names.get(p, p) for p in pieces]
    return None


def _referred(item: tuple, names: dict[str, _Value], own: _Value | None = None) -> list | None:
    """What a reference (name, span, quoted) stands for, None if nothing known."""
    word, span, quoted = item
    if not quoted:
        got = _named_values(word, names)
        if got is None or own is not None and any(x is own for x in got):
            return None
        at, out = span[0] if span else 0, []
        for piece, x in zip(word.split("+") if len(got) > 1 else [word], got):
            out.append(x if isinstance(x, _Value) else (at, at + len(piece)))
            at += len(piece) + 1
        return out
    refs = [names.get(a or b) for a, b in _REFERENCE.findall(word)]
    refs = [x for x in refs if x is not None and x is not own]
    if not refs:
        return None
    return refs if not _REFERENCE.sub("", word) else [span, *refs]


def literal_spans(text: str, least: float = 0.5) -> list[tuple[int, int]]:
    """(start, end) of literals that a sensitive name receives, directly or
    through constants; of any number of parts. A name refers to its latest
    assignment before, or else to its first one after."""
    known: dict[str, _Value] = {}
    firsts: dict[str, _Value] = {}
    sensitive: list[tuple[float, _Value]] = []
    pending: list[_Value] = []
    order: list[_Value] = []
    closing = cache(lambda: _closings(text))
    bare = _Bare(text)
    at = 0
    while m := _TARGET.search(text, at):
        name = m["name"] or m["gname"]
        items, end, plain = _expression(text, m.end(), closing, bare)
        whole = _QUOTED.match(text, m.end()) or _BRACED.match(text, m.end())
        at = max(m.end(), end) if plain and whole else m.end() + (3 if text[m.end():m.end() + 3] in ('"""', "'''") else 0)
        if not items:
            continue
        value = _Value(items)
        value.end = _READ
        todo, early = [value], []        # resolve by what is known so far
        while todo:
            v = todo.pop()
            out = []
            for x in v.items:
                if isinstance(x, _Value):
                    if x.end == _NEW:
                        x.end = _READ
                        todo.append(x)
                    out.append(x)
                elif len(x) == 2:
                    out += [x] * (x[1] > x[0])
                elif (got := _referred(x, known)) is not None:
                    out += got
                else:
                    out.append(x)
            v.items = out
            early.append(v)
            if any(isinstance(x, tuple) and len(x) == 3 for x in out):
                pending.append(v)
        order += reversed(early)
        if len(value.items) == 1 and isinstance(value.items[0], _Value):
            value = value.items[0]
        known[name] = value
        firsts.setdefault(name, value)
        weight = sensitivity(name)
        if weight:
            sensitive.append((weight, value))
    for v in pending:
        out = []
        for x in v.items:
            if isinstance(x, tuple) and len(x) == 3:
                got = _referred(x, firsts, v)
                out += got if got is not None else [x[1]] * (x[1] is not None and x[1][1] > x[1][0])
            else:
                out.append(x)
        v.items = out
    for v in order:
        v.settle(len(text) + 1)
    found: set[tuple[int, int]] = set()
    shared = _suffix_strengths(text, {v.items[0] for _, v in sensitive if len(v.items) == 1 and isinstance(v.items[0], tuple)})
    for weight, value in sensitive:
        stack, seen = [value], set()
        while stack:
            v = stack.pop()
            if v.told or id(v) in seen:
                continue
            seen.add(id(v))
            if v.apart:                  # each alternative by itself
                stack += v.items
            elif len(v.items) == 1 and isinstance(v.items[0], _Value):
                stack.append(v.items[0])
            elif weight * (shared[v.items[0]] if len(v.items) == 1 and v.items[0] in shared else v.strength(text)) >= least:
                v.tell(found)
    return sorted(found)


def spans_of(text: str | None) -> list[tuple[int, int, str]]:
    """All spans of a text as (start, end, kind), by start, then kind as in KINDS."""
    if not text:
        return []
    out = []
    if ":" in text or "=" in text:
        low = text.lower()
        if any(w in low for w in _ASSIGN_WORDS):
            out += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
        out += [(s, e, "literal") for s, e in literal_spans(text)]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text)]
    out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def _named(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_assign, n_access, n_hex, base_sha256, spans.

    Spans are kind:start:end in code points, end exclusive; ``spans`` has the
    pattern spans and the lexed literals, base_sha256 is the digest of the
    pattern spans alone. Null text counts as empty: no spans, the digest of the
    empty string. Repeated rows come out as often as they go in; other columns
    are not read; no rows give no rows.
    """
    bounded_batches(docs.sparkSession)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text in b.column(1):
                spans = spans_of(text.as_py())
                base = [s for s in spans if s[2] != "literal"]
                n = Counter(s[2] for s in base)
                rows.append((n["assign"], n["access"], n["hex"],
                             hashlib.sha256(_named(base).encode()).hexdigest(), _named(spans)))
            cols = list(zip(*rows)) if rows else [()] * 5
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds)]],
                                             names=["_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    kind = dict(docs.dtypes)[id_col]
    return (docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
            .mapInArrow(of, f"_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
            .withColumnRenamed("_id", id_col))


def redact(text: str, mask: str = "[SECRET]") -> str:
    """``text`` with every span (overlapping ones as one) replaced by ``mask``."""
    out, at, reach = [], 0, -1
    for s, e, _ in spans_of(text):
        if s >= reach:
            out += [text[at:s], mask]
        reach = max(reach, e)
        at = reach
    return "".join(out) + text[at:] if out else text


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the secrets of the text column masked, same columns and rows;
    null stays null. Other columns, also ones named like this module's, pass
    through as they are."""
    bounded_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pa.array([None if t is None else redact(t) for t in b.column(at).to_pylist()], b.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([*b.columns[:at], texts, *b.columns[at + 1:]], schema=b.schema)

    return docs.mapInArrow(of, docs.schema)
