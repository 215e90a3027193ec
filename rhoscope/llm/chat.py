"""Chat formatting: a compiler from a small template language to Python closures.

Language: ``{{ expression }}``, ``{% for x in expression %}``, ``{% if %} {% elif %} {% else %}``,
``{% set x = expression %}`` and ``{% generation %} ... {% endgeneration %}`` for the text a model is trained
on. Expressions have literals, names, ``.key`` and ``['key']`` on mappings, ``| filter``, ``== != < <= > >=``,
``and or not in``, ``+`` and ``~``. It is a sandbox: no calls, no Python attributes, only listed filters.

Source is parsed to a syntax tree, constants are folded (operators and filters of literals, conditions that
are constant, texts that stand side by side), and every node becomes a closure that yields (text, marked)
pieces. ``for`` pulls its items one by one, so a conversation of any length renders in constant memory.

Conversations are dealt by conv_id and sorted by (turn, role, text), nulls first; a task reads its rows as a
stream, so no conversation is ever collected. Cases: a null role or text is empty; a null conv_id is a
conversation of its own; repeated rows are repeated turns; an empty table gives no rows; further columns are
ignored. format_conversations returns one string per conversation, which must fit a cell; digests don't
need that.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]")
TEMPLATE = (
    "<s>{% for m in messages %}[INST]{{ m.role | escape }}[/INST]"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}"
    "</s>{% endfor %}"
)


class TemplateError(ValueError):
    """The template isn't in the language."""


class Escaper:
    """Reversible: a backslash is doubled, and one is put after the first character of every control string."""

    def __init__(self, controls: Iterable[str]):
        controls = sorted(controls, key=len, reverse=True)
        if any(len(c) < 2 or "\\" in c for c in controls):
            raise TemplateError("a control string has two characters at least and no backslash")
        self.found = re.compile(f"(?=(?:{'|'.join(map(re.escape, controls))}))(.)", re.S)

    def escape(self, text: str) -> str:
        if "\\" in text:
            text = text.replace("\\", "\\\\")
        return self.found.sub(r"\1\\", text)

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(\\?)", r"\1", text) if "\\" in text else text


TOKEN = re.compile(r"\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[<>+~|.\[\]()=]))")
COMPARE: dict[str, Callable] = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "in": lambda a, b: a in b}
CONSTANTS = {"true": True, "false": False, "none": None}
#: What may be fed through a filter; escape is added for a template's control strings.
FILTERS: dict[str, Callable] = {"trim": lambda v: str(v).strip(), "upper": lambda v: str(v).upper(), "lower": lambda v: str(v).lower(), "string": lambda v: text_of(v)}


def text_of(value) -> str:
    return "" if value is None else value if isinstance(value, str) else "true" if value is True else "false" if value is False else str(value)


class Parser:
    """Source to syntax tree; nodes are tuples whose first member names their kind."""

    def __init__(self, source: str):
        self.parts = [p for p in re.split(r"(\{\{.*?\}\}|\{%.*?%\})", source, flags=re.S) if p]
        self.at = 0

    def parse(self) -> tuple:
        body, end = self.block(())
        return body

    def block(self, ends: tuple[str, ...]) -> tuple[tuple, str]:
        nodes = []
        while self.at < len(self.parts):
            part = self.parts[self.at]
            self.at += 1
            if part.startswith("{{"):
                nodes.append(("out", Expression(part[2:-2]).whole()))
            elif not part.startswith("{%"):
                nodes.append(("text", part))
            else:
                inner = part[2:-2].strip()
                word, _, rest = inner.partition(" ")
                if word in ends:
                    return ("block", tuple(nodes)), inner
                nodes.append(self.statement(word, rest))
        if ends:
            raise TemplateError(f"{' or '.join(ends)} is missing")
        return ("block", tuple(nodes)), ""

    def statement(self, word: str, rest: str) -> tuple:
        if word == "for":
            if not (m := re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+(.*)", rest, re.S)):
                raise TemplateError(f"for {rest}")
            body, _ = self.block(("endfor",))
            return ("for", m[1], Expression(m[2]).whole(), body)
        if word == "if":
            arms, test = [], rest
            while True:
                body, end = self.block(("elif", "else", "endif"))
                arms.append((Expression(test).whole(), body))
                if end.startswith("elif"):
                    test = end[4:]
                    continue
                other = self.block(("endif",))[0] if end == "else" else ("block", ())
                return ("if", tuple(arms), other)
        if word == "set":
            name, eq, value = rest.partition("=")
            if not eq or not name.strip().isidentifier():
                raise TemplateError(f"set {rest}")
            return ("set", name.strip(), Expression(value).whole())
        if word == "generation":
            return ("generation", self.block(("endgeneration",))[0])
        raise TemplateError(f"unknown statement {word}")


class Expression:
    """Recursive descent: or, and, not, comparison, sum, filters, access, atom."""

    def __init__(self, source: str):
        self.source, self.tokens, at, end = source, [], 0, len(source.rstrip())
        while at < end:
            if not (m := TOKEN.match(source, at)):
                raise TemplateError(f"can't read {source[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self, *values: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] != "str" and self.tokens[self.at][1] in values

    def take(self) -> tuple[str, str]:
        if self.at >= len(self.tokens):
            raise TemplateError(f"{self.source!r} ends too early")
        self.at += 1
        return self.tokens[self.at - 1]

    def expect(self, value: str) -> None:
        if not self.peek(value):
            raise TemplateError(f"{value} expected in {self.source!r}")
        self.at += 1

    def whole(self) -> tuple:
        tree = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"can't read all of {self.source!r}")
        return tree

    def either(self) -> tuple:
        tree = self.both()
        while self.peek("or"):
            self.take()
            tree = ("or", tree, self.both())
        return tree

    def both(self) -> tuple:
        tree = self.inverse()
        while self.peek("and"):
            self.take()
            tree = ("and", tree, self.inverse())
        return tree

    def inverse(self) -> tuple:
        if self.peek("not"):
            self.take()
            return ("not", self.inverse())
        tree = self.sum()
        if self.peek(*COMPARE):
            return ("compare", self.take()[1], tree, self.sum())
        return tree

    def sum(self) -> tuple:
        tree = self.filtered()
        while self.peek("+", "~"):
            tree = ("join" if self.take()[1] == "~" else "add", tree, self.filtered())
        return tree

    def filtered(self) -> tuple:
        tree = self.access()
        while self.peek("|"):
            self.take()
            tree = ("filter", self.take()[1], tree)
        return tree

    def access(self) -> tuple:
        kind, value = self.take()
        if kind == "str":
            tree: tuple = ("const", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), value[1:-1]))
        elif kind == "int":
            tree = ("const", int(value))
        elif kind == "name":
            tree = ("const", CONSTANTS[value]) if value in CONSTANTS else ("name", value)
        elif value == "(":
            tree = self.either()
            self.expect(")")
        else:
            raise TemplateError(f"{value} isn't expected in {self.source!r}")
        while self.peek(".", "["):
            if self.take()[1] == ".":
                kind, key = self.take()
                if kind != "name":
                    raise TemplateError(f"a key is missing in {self.source!r}")
                tree = ("key", tree, ("const", key))
            else:
                tree = ("key", tree, self.either())
                self.expect("]")
        return tree


class Template:
    """A compiled template; render gives (text, marked) pieces."""

    def __init__(self, source: str, controls: Iterable[str] = CONTROLS):
        self.escaper = Escaper(controls)
        self.filters = FILTERS | {"escape": lambda v: self.escaper.escape(text_of(v))}
        self.tree = self.folded(Parser(source).parse())
        self.run = self.statement(self.tree)

    def render(self, values: dict) -> Iterator[tuple[str, bool]]:
        return self.run(dict(values), False)

    # constants
    def folded(self, node: tuple) -> tuple:
        kind = node[0]
        if kind == "block":
            out: list[tuple] = []
            for child in map(self.folded, node[1]):
                for x in child[1] if child[0] == "block" else (child,):
                    if x[0] == "out" and x[1][0] == "const":
                        x = ("text", text_of(x[1][1]))
                    if x[0] == "text" and out and out[-1][0] == "text":
                        out[-1] = ("text", out[-1][1] + x[1])
                    elif x != ("text", ""):
                        out.append(x)
            return ("block", tuple(out))
        if kind == "if":
            arms = []
            for test, body in node[1]:
                test, body = self.folded(test), self.folded(body)
                if test[0] != "const":
                    arms.append((test, body))
                elif test[1]:
                    return ("if", tuple(arms), body) if arms else body
            return ("if", tuple(arms), self.folded(node[2])) if arms else self.folded(node[2])
        node = tuple(self.folded(x) if isinstance(x, tuple) and kind != "const" else x for x in node)
        if kind in ("or", "and", "not", "compare", "add", "join", "filter") and all(x[0] == "const" for x in node if isinstance(x, tuple)):
            return ("const", self.expression(node)({}))
        return node

    # closures
    def expression(self, node: tuple) -> Callable[[dict], object]:
        kind = node[0]
        if kind == "const":
            return lambda env, v=node[1]: v
        if kind == "name":
            return lambda env, n=node[1]: env.get(n)
        if kind == "filter":
            if node[1] not in self.filters:
                raise TemplateError(f"unknown filter {node[1]}")
            return lambda env, f=self.filters[node[1]], x=self.expression(node[2]): f(x(env))
        if kind == "not":
            return lambda env, x=self.expression(node[1]): not x(env)
        if kind == "compare":
            return lambda env, f=COMPARE[node[1]], a=self.expression(node[2]), b=self.expression(node[3]): f(a(env), b(env))
        a, b = self.expression(node[1]), self.expression(node[2])
        if kind == "key":
            return lambda env: v.get(b(env)) if isinstance(v := a(env), dict) else None
        if kind == "or":
            return lambda env: a(env) or b(env)
        if kind == "and":
            return lambda env: a(env) and b(env)
        if kind == "join":
            return lambda env: text_of(a(env)) + text_of(b(env))
        return lambda env: a(env) + b(env)

    def statement(self, node: tuple) -> Callable[[dict, bool], Iterator[tuple[str, bool]]]:
        kind = node[0]
        if kind == "text":
            return lambda env, marked, t=node[1]: iter(((t, marked),))
        if kind == "out":
            return lambda env, marked, x=self.expression(node[1]): iter(((text_of(x(env)), marked),))
        if kind == "generation":
            return lambda env, marked, body=self.statement(node[1]): body(env, True)
        if kind == "set":

            def assign(env, marked, name=node[1], x=self.expression(node[2])):
                env[name] = x(env)
                return iter(())

            return assign
        if kind == "if":
            arms = [(self.expression(t), self.statement(b)) for t, b in node[1]]
            return lambda env, marked, other=self.statement(node[2]): next((b for t, b in arms if t(env)), other)(env, marked)
        if kind == "for":

            def loop(env, marked, name=node[1], items=self.expression(node[2]), body=self.statement(node[3])):
                for i, item in enumerate(items(env) or ()):
                    yield from body(env | {name: item, "loop": {"index0": i, "index": i + 1, "first": i == 0}}, marked)

            return loop
        parts = [self.statement(x) for x in node[1]]

        def block(env, marked):
            for part in parts:
                yield from part(env, marked)

        return block


def turns_of(pieces: Iterable[tuple[str, bool]], begin: str = "<s>", opened: str = "[INST]", closed: str = "[/INST]", end: str = "</s>") -> Iterator[tuple[int, str, str, list[str]]]:
    """Read formatted output back, turn by turn: characters read, role, text, and the texts under the mask."""
    unescape, read, buffer, marks = Escaper.unescape, 0, "", []
    started = False
    for text, marked in pieces:
        if marked:
            marks.append((len(buffer), len(buffer) + len(text)))
        buffer += text
        while (at := buffer.find(end)) >= 0:
            turn, used = buffer[:at], at + len(end)
            if not started:
                if not turn.startswith(begin):
                    raise ValueError("the output doesn't start with its first control string")
                turn, started, skip = turn[len(begin) :], True, len(begin)
            else:
                skip = 0
            role, _, said = turn.removeprefix(opened).partition(closed)
            loss = [unescape(turn[a - skip : b - skip]) for a, b in marks if b <= at]
            marks = [(a - used, b - used) for a, b in marks if b > at]
            buffer, read = buffer[used:], read + used
            yield used, unescape(role), unescape(said), loss
    if buffer and not (not started and buffer == begin):
        raise ValueError("the output ends within a turn")


def _conversations(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[object, Iterator[dict]]]:
    def rows():
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True)

    for conv, group in groupby(rows(), key=lambda r: r[0]):
        yield conv, ({"role": r or "", "text": t or ""} for _, r, t in group)


def _streams(df: DataFrame) -> DataFrame:
    """Rows of a conversation side by side, in order."""
    return df.select("conv_id", F.col("turn").alias("turn"), "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def format_conversations(df: DataFrame, template: str = TEMPLATE, controls: tuple[str, ...] = CONTROLS) -> DataFrame:
    """(conv_id, formatted, loss_spans): spans are code points [start, end) of what ``generation`` marks."""

    def work(batches):
        compiled = Template(template, controls)
        for conv, messages in _conversations(batches):
            parts, spans, at = [], [], 0
            for text, marked in compiled.render({"messages": messages}):
                parts.append(text)
                if marked:
                    spans.append({"start": at, "end": at + len(text)})
                at += len(text)
            yield pa.RecordBatch.from_arrays([pa.array([conv], kind), pa.array(["".join(parts)]), pa.array([spans], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], names=["conv_id", "formatted", "loss_spans"])

    kind = _arrow_type(df)
    return _streams(df).mapInArrow(work, f"conv_id {df.schema['conv_id'].dataType.simpleString()}, formatted string, loss_spans array<struct<start:long,end:long>>")


def _arrow_type(df: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema["conv_id"].dataType)


def conversation_digests(df: DataFrame, template: str = TEMPLATE, controls: tuple[str, ...] = CONTROLS) -> DataFrame:
    """What is read back from each conversation's output, as digests; memory holds one turn at a time."""
    kind = _arrow_type(df)
    fields = [("conv_id", kind), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]

    def work(batches):
        compiled = Template(template, controls)
        out: list[tuple] = []
        for conv, messages in _conversations(batches):
            turns, loss, n, lost, chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
            for used, role, text, marked in turns_of(compiled.render({"messages": messages})):
                turns.update(f"{role}\n{text}\n".encode())
                for t in marked:
                    loss.update(t.encode())
                    lost += len(t)
                n, chars = n + 1, chars + used
            out.append((conv, n, turns.hexdigest(), lost, loss.hexdigest(), chars))
            if len(out) >= 1000:
                yield table(out)
                out = []
        if out:
            yield table(out)

    def table(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], names=[n for n, _ in fields])

    return _streams(df).mapInArrow(work, f"conv_id {df.schema['conv_id'].dataType.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: The digests in DuckDB; conversation -7 is the one that op10 adds.
CHAT_SQL = r"""
WITH rows_ AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (SELECT *, role || chr(1) || text AS both_ FROM rows_),
escaped AS (SELECT *, length(role) + length(text) + 17 + length(both_) - length(replace(both_, chr(92), ''))
  + (length(both_) - length(replace(both_, '<s>', ''))) // 3 + (length(both_) - length(replace(both_, '</s>', ''))) // 4
  + (length(both_) - length(replace(both_, '[INST]', ''))) // 6 + (length(both_) - length(replace(both_, '[/INST]', ''))) // 7 AS chars FROM sized)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(3 + sum(chars) AS BIGINT) AS formatted_chars FROM escaped GROUP BY conv_id
"""
