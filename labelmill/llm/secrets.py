"""Secret scans: base patterns, and an assignment-aware lexer.

The lexer reads source and configuration syntax from left to right into pairs of a name and a value:
``name = v``, ``name: v``, ``name := v``, ``"name" => v``, ``table["name"] = v``, ``name: type = v``,
``type name = v``, ``a, b = v, w``, ``("name", v)``, ``key="name" value="v"`` and ``<name>v</name>``.
A value is a chain of literals and names, joined by ``+``, ``.``, ``&`` or by standing side by side, in
parentheses over any number of lines; a literal is quoted (with escapes), triple-quoted, a YAML block
(``|`` or ``>``), or a bare run of signs. Literals of a list, of a call that only wraps or decodes, of both arms of
``c ? v : w``, on the line after the operator, and after a scheme (``Bearer v``) count alike. Names, blanks and literals
may be of any length.

A name bound to a value stands for it later in the same text. Bindings form a graph: of each the lexer
keeps a profile (length, kinds and distribution of characters) and what it is made of, never the joined
value, so that ``a = a + a`` costs the same at every line. A binding is secret if its target's name is
sensitive and its profile looks drawn at random: long enough, of several kinds of characters, of high
entropy. All literals that a secret binding is made of are spans.

A null text counts as empty and has no spans. Offsets are code points, ends exclusive. Input columns whose
names equal an added one in any case are replaced; all others are passed on.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import beside
from .textbuf import batch_pieces

KINDS = ("assign", "access", "hex", "lexed")
ASSIGN = re.compile(r"""(?a:(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
SENSITIVE = re.compile(r"(?i)passw|passwd|pwd|secret|token|api[_-]?key|credential|private[_-]?key|auth|access[_-]?key")

#: A name with the operator after it. Each run is entered once, at its start, and taken whole: cost is linear in the text.
_HEAD = re.compile(
    r"""(?:(?<!\\)"(?P<double>(?:[^"\\\n]|\\.)*+)"\]?|(?<!\\)'(?P<single>(?:[^'\\\n]|\\.)*+)'\]?|(?<![\w$.-])(?P<plain>[\w$.-]++)["']?+)"""
    r"""(?P<type>[ \t]++(?:string|String|str|char|text)\b)?+[ \t]*+(?P<op>:=|=>|\?\?=|\|\|=|[+?]?=(?![=>~])|:(?![:=])|,)"""
)
_TAG = re.compile(r"<(?P<name>[A-Za-z_][\w:.-]*+)[^<>\n]*+>(?P<value>[^<>]*+)</(?P=name)>")
_NAME = re.compile(r"[A-Za-z_$][\w$.-]*+")
_TRIPLE = re.compile(r'(?s)[A-Za-z]{0,2}(?:"""(.*?)"""|\'\'\'(.*?)\'\'\')')
_QUOTED = re.compile(r"""[A-Za-z@$]{0,2}(?:"((?:[^"\\]|\\.)*+)"|'((?:[^'\\]|\\.)*+)'|`((?:[^`\\]|\\.)*+)`)""")
_LINE_QUOTED = re.compile(r"""[A-Za-z@$]{0,2}(?:"((?:[^"\\\n]|\\.)*+)"|'((?:[^'\\\n]|\\.)*+)'|`((?:[^`\\\n]|\\.)*+)`)""")
_KNOWN = re.compile(r"([A-Za-z_$][\w$.-]*+)(?=[\s;,+&)\]}#]|$)")
_BARE = re.compile(r"""[^\s,;"'(){}\[\]<>]++""")
_BLANK, _BLANKS = re.compile(r"(?:[ \t]|\\\r?\n)*+"), re.compile(r"\s*+")
_JOIN = re.compile(r"[ \t]*+[+&.](?![+&.=\w])\s*+|[ \t]*+\+\s*+(?=[\"'`A-Za-z_$(])")
_BLOCK = re.compile(r"[ \t]*+[|>][-+0-9]*+[ \t]*+(?:#[^\n]*+)?\r?\n")
_BLOCK_LINE = re.compile(r"([ \t]*+)([^\n]*+)\n?")
_ANNOTATED = re.compile(r"[ \t]*+[A-Za-z_][\w.]*+(?:\[[\w., |\[\]]*\])?+[ \t]*+=(?![=>~])")
#: Calls that give back what they are given, in another form; the scheme before a credential; a condition before ``?``.
_CALL = re.compile(r"(?:new[ \t]++)?+[A-Za-z_$][\w$.:]*+[ \t]*+\(")
_WRAPS = re.compile(r"(?i)(?:64|decode|encode|bytes?|str|string|from|text|quote|literal|secure_?string)[ \t]*\($")
_SCHEME = re.compile(r"(?i)(?:bearer|basic|digest|token)[ \t]++(?=\S)")
_CONDITION = re.compile(r"""(?:[^\n"'`?;,{}=:]|[=!<>]=)*+\?[ \t]*+(?=["'`])""")
_NEXT_LINE = re.compile(r"""[ \t]*+\r?\n[ \t]*+(?=["'`])""")
#: Literals that only name where a value comes from.
_PLACEHOLDER = re.compile(r"\$\{[^{}]*\}|\$[A-Za-z_]\w*|\{\{.*\}\}|%\(.*\)s|<[^<>]*>|%[A-Za-z_]\w*%")

SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value_start", pa.int64()), ("value_end", pa.int64()), ("base", pa.bool_()), ("target", pa.string()), ("score", pa.float64())])
SPAN_DDL = "array<struct<kind:string,start:bigint,end:bigint,value_start:bigint,value_end:bigint,base:boolean,target:string,score:double>>"


@dataclass
class Profile:
    """What scoring needs of a value: its length, kinds of characters, blanks, and shares of characters (code modulo 128)."""

    length: float = 0.0
    kinds: int = 0
    blank: bool = False
    shares: list[float] = field(default_factory=lambda: [0.0] * 128)

    @classmethod
    def of(cls, literal: str) -> Profile:
        out = cls(float(len(literal)))
        seen: dict[str, int] = {}
        for c in literal:
            seen[c] = seen.get(c, 0) + 1
        for c, n in seen.items():
            out.shares[ord(c) & 127] += n / len(literal)
            out.blank |= c.isspace()
            out.kinds |= 1 if "a" <= c <= "z" else 2 if "A" <= c <= "Z" else 4 if "0" <= c <= "9" else 8
        return out

    def joined(self, other: Profile) -> Profile:
        """The profile of both values end to end; lengths stop counting at 1e12."""
        n = self.length + other.length
        if not other.length or not n:
            return self
        a, b = self.length / n, other.length / n
        return Profile(min(n, 1e12), self.kinds | other.kinds, self.blank | other.blank, [a * x + b * y for x, y in zip(self.shares, other.shares, strict=True)])

    def randomness(self) -> float:
        """0 to 1: how much the value looks drawn at random rather than written."""
        if self.length < 8:
            return 0.0
        entropy = -sum(p * math.log2(p) for p in self.shares if p > 0)
        return min(1.0, entropy / 4) * (0.4 + 0.2 * min(self.kinds.bit_count(), 3)) * (0.4 if self.blank else 1.0)


def randomness(literal: str) -> float:
    return 0.0 if len(literal) < 8 or _PLACEHOLDER.fullmatch(literal) else Profile.of(literal).randomness()


@dataclass
class Binding:
    """A name's value: literals as places of the text, and earlier bindings that it refers to."""

    name: str
    places: list[tuple[int, int]] = field(default_factory=list)
    refers: list[int] = field(default_factory=list)
    profile: Profile = field(default_factory=Profile)

    def add_literal(self, text: str, start: int, end: int, literal: str | None = None) -> None:
        if literal is None:
            start = m.end() if (m := _SCHEME.match(text, start, end)) else start
            literal = text[start:end]
        if end > start and not _PLACEHOLDER.fullmatch(literal):
            self.places.append((start, end))
            self.profile = self.profile.joined(Profile.of(literal)) if self.profile.length else Profile.of(literal)


class Lexer:
    """Reads one text's bindings in order."""

    def __init__(self, text: str):
        self.text = text
        self.bindings: list[Binding] = []
        self.known: dict[str, int] = {}

    def bind(self, found: Binding) -> None:
        if found.places or found.refers:
            self.known[found.name] = len(self.bindings)
            self.bindings.append(found)

    def refer(self, found: Binding, name: str) -> None:
        k = self.known[name]
        found.refers.append(k)
        found.profile = found.profile.joined(self.bindings[k].profile)

    def term(self, found: Binding, at: int, depth: int, bare: bool) -> int:
        """Reads one literal or known name into found; where it ends, or -1."""
        text = self.text
        quoted = _TRIPLE.match(text, at) or (_QUOTED if depth else _LINE_QUOTED).match(text, at)
        if quoted:
            s, e = quoted.span(quoted.lastindex)
            found.add_literal(text, s, e)
            return quoted.end()
        m = _KNOWN.match(text, at)
        if m and m[1] in self.known:
            self.refer(found, m[1])
            return m.end()
        if bare and not depth and (m := _BARE.match(text, at)):
            if text[m.end() : m.end() + 1] not in ("(", "["):  # names of calls and tables are no literals
                found.add_literal(text, *m.span())
                return m.end()
        return -1

    def value(self, found: Binding, at: int) -> int:
        """Reads a chain of terms; where it ends (at, if there is none)."""
        text, depth, end, first = self.text, 0, at, True
        arms = _CONDITION.match(text, at)
        at = arms.end() if arms else at
        if m := _SCHEME.match(text, _BLANK.match(text, at).end()):
            at = m.end()
        while True:
            at = (_BLANKS if depth else _BLANK).match(text, at).end()
            sign = text[at : at + 1]
            if first or depth:
                call = _CALL.match(text, at)
                if sign in ("(", "[") or call and _WRAPS.search(call[0]):
                    depth, at = depth + 1, call.end() if call else at + 1
                    continue
            if depth and sign == ",":
                at += 1
                continue
            if depth and sign in (")", "]") and end < at:
                depth, at = depth - 1, at + 1
                if not first:
                    end = at
                if depth:
                    continue
                return end
            after = self.term(found, at, depth, bare=first)
            if after < 0:
                return end
            quoted = text[after - 1] in "\"'`"
            end, first = after, False
            if join := _JOIN.match(text, end):
                at = join.end()
                continue
            at = (_BLANKS if depth else _BLANK).match(text, end).end()
            if arms and text[at : at + 1] == ":":
                arms, at = None, at + 1
                continue
            if not depth and not (quoted and text[at : at + 1] in ('"', "'")):
                return end

    def block(self, found: Binding, at: int, head: int) -> int:
        """Reads the lines of a YAML block that are indented deeper than the line of its name."""
        text = self.text
        line = text.rfind("\n", 0, head) + 1
        indent = len(re.match(r"[ \t-]*", text[line:head])[0])
        start, end, parts = -1, at, []
        while at < len(text):
            m = _BLOCK_LINE.match(text, at)
            if m[2].strip():
                if len(m[1]) <= indent:
                    break
                start = m.start(2) if start < 0 else start
                end = m.start(2) + len(m[2].rstrip())
                parts.append(m[2].strip())
            at = m.end()
        if start >= 0:
            found.add_literal(text, start, end, "".join(parts))
        return end

    def names(self, first: str, start: int, floor: int) -> list[str]:
        """The targets of ``a, b = ...``: the name at start and those before it, back to floor."""
        text, out, at = self.text, [first], start
        while True:
            k = at
            while k > floor and text[k - 1] in " \t":
                k -= 1
            if k <= floor or text[k - 1] != ",":
                return out[::-1]
            k -= 1
            while k > floor and text[k - 1] in " \t":
                k -= 1
            e = k
            while k > floor and (text[k - 1].isalnum() or text[k - 1] in "_$.-"):
                k -= 1
            if k == e:
                return out[::-1]
            out.append(text[k:e])
            at = k

    def read(self) -> list[Binding]:
        text, at, floor, before = self.text, 0, 0, ("", (0, 0), 0)
        while m := _HEAD.search(text, at):
            at = m.end()
            kind = next(k for k in ("double", "single", "plain") if m[k] is not None)
            name, op = m[kind], m["op"]
            if op == ",":  # ("name", value)
                if kind == "plain" or not SENSITIVE.search(name) or " " in name:
                    at = m.start() + 1 if kind != "plain" else at
                    continue
                value = _LINE_QUOTED.match(text, _BLANKS.match(text, at).end())
                if value:
                    found = Binding(name)
                    found.add_literal(text, *value.span(value.lastindex))
                    self.bind(found)
                    at = floor = value.end()
                continue
            if kind == "plain":
                part = _NAME.search(name)
                if not part:
                    continue
                name = part[0]
            start = m.start(kind)
            if op == ":":
                if b := _BLOCK.match(text, at):
                    found = Binding(name)
                    at = floor = self.block(found, b.end(), m.start())
                    self.bind(found)
                    continue
                if t := _ANNOTATED.match(text, at):
                    at = t.end()
            if (n := _NEXT_LINE.match(text, at)) and not _HEAD.match(text, n.end()):
                at = n.end()
            targets = self.names(name, start, floor) if kind == "plain" and op in ("=", ":=") else [name]
            values, stop = [], at
            while len(values) < len(targets):
                found = Binding(targets[len(values)])
                end = self.value(found, stop)
                if end == stop:
                    break
                values.append(found)
                stop = end
                gap = _BLANK.match(text, stop).end()
                if len(values) < len(targets) and text[gap : gap + 1] == ",":
                    stop = gap + 1
                else:
                    break
            if not values:
                continue
            if len(values) < len(targets):
                values[0].name = name
                values = values[:1]
            if name.lower() == "value" and before[0].lower() in ("key", "name") and text[before[2] : start].strip() in ("", '"', "'"):
                values[0].name = text[slice(*before[1])]  # key="name" value="literal"
            for found in values:
                self.bind(found)
            last = values[-1].places[-1] if values[-1].places else (0, 0)
            before = (name, last, stop)
            at = floor = stop
        if "</" in text:
            for m in _TAG.finditer(text):
                if SENSITIVE.search(m["name"]):
                    found = Binding(m["name"])
                    s = m.start("value") + len(m["value"]) - len(m["value"].lstrip())
                    found.add_literal(text, s, m.start("value") + len(m["value"].rstrip()))
                    self.bind(found)
        return self.bindings


def lexed_spans(text: str, threshold: float = 0.55) -> list[dict]:
    """Literals of all bindings that are secret, or that a secret binding refers to."""
    bindings = Lexer(text).read()
    marked: list[tuple[str, float] | None] = [None] * len(bindings)
    out: dict[tuple[int, int], dict] = {}
    for k in range(len(bindings) - 1, -1, -1):  # bindings refer to earlier ones only
        b = bindings[k]
        if SENSITIVE.search(b.name) and (score := b.profile.randomness()) >= threshold:
            marked[k] = b.name, score
        if marked[k]:
            for r in b.refers:
                marked[r] = marked[r] or marked[k]
            for s, e in b.places:
                out[s, e] = {"kind": "lexed", "start": s, "end": e, "value_start": s, "value_end": e, "base": False, "target": marked[k][0], "score": round(marked[k][1], 6)}
    return [out[place] for place in sorted(out)]


def base_spans(text: str) -> list[dict]:
    out = []

    def add(kind, m, group=0):
        (s, e), (vs, ve) = m.span(), m.span(group)
        out.append({"kind": kind, "start": s, "end": e, "value_start": vs, "value_end": ve, "base": True, "target": None, "score": 1.0})

    for m in ASSIGN.finditer(text):
        if m.end(1) - m.start(1) >= 12:
            add("assign", m, 1)
    for m in ACCESS.finditer(text):
        if m.end() - m.start() >= 18:
            add("access", m)
    for m in HEX.finditer(text):
        add("hex", m)
    return out


def outside(found: list[dict], base: list[dict]) -> list[dict]:
    """The spans of found that no span of base contains: one look at the furthest end of those that start before."""
    starts, ends = [], []
    for x in sorted(base, key=lambda x: x["start"]):
        starts.append(x["start"])
        ends.append(max(x["end"], ends[-1] if ends else 0))
    return [x for x in found if not (k := bisect_right(starts, x["start"])) or ends[k - 1] < x["end"]]


def spans(text: str) -> list[dict]:
    """All spans by start, then kind as listed, then end. Lexed spans inside a base span are left out."""
    found = base_spans(text)
    if SENSITIVE.search(text):
        found += outside(lexed_spans(text), found)
    return sorted(found, key=lambda x: (x["start"], KINDS.index(x["kind"]), x["end"]))


def redacted(text: str, found: list[dict]) -> str:
    """The text with each secret's value replaced by ``[REDACTED:kind]``; overlapping values count as one."""
    out, at = [], 0
    for x in sorted(found, key=lambda x: (x["value_start"], -x["value_end"])):
        if x["value_end"] <= at:
            continue
        if x["value_start"] >= at:
            out += [text[at : x["value_start"]], f"[REDACTED:{x['kind']}]"]
        at = x["value_end"]
    return "".join(out) + text[at:]


def scan(df: DataFrame, text_col: str = "text", spans_col: str = "secret_spans", redacted_col: str | None = None) -> DataFrame:
    """df with all secret spans of each text and, if asked for, the text without them (null stays null)."""
    added = [T.StructField(spans_col, T._parse_datatype_string(SPAN_DDL))] + ([T.StructField(redacted_col, T.StringType())] if redacted_col else [])
    schema = beside(df.schema, *added)
    names = schema.names[: -len(added)]

    def run(batches):
        for batch in batches:
            for b in batch_pieces(batch, text_col):
                texts = b.column(text_col).to_pylist()
                found = [spans(t) if t else [] for t in texts]
                columns = [*(b.column(c) for c in names), pa.array(found, pa.list_(SPAN))]
                if redacted_col:
                    columns.append(pa.array([redacted(t, f) if f else t for t, f in zip(texts, found, strict=True)], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return df.mapInArrow(run, schema)


def _listed(spans_col: Column) -> Column:
    return F.array_join(F.transform(spans_col, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan(docs).drop("text")
    count = lambda kind: F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *(count(k) for k in KINDS[:3]),
        F.sha2(_listed(F.filter("secret_spans", lambda s: s["base"])), 256).alias("base_sha256"),
        _listed(F.col("secret_spans")).alias("spans"),
    )
