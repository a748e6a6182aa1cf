"""Chat formatting: a compiler for a sandboxed template language, and its use on conversations.

Templates know text, {{ expression }}, {% for x in list %}, {% if %} / {% elif %} / {% else %}, and
{% generation %} ... {% endgeneration %}, which marks what the model is trained on. Expressions know strings, whole
numbers, true, false, none, names, fields (x.role, x['role']), ==, !=, not, and, or, + and filters (x | escape).
Fields are keys of the given data alone: no attribute, method or item of a Python object can be reached.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHAT = (
    "{% for m in messages %}<|im_start|>{{ m.role | line | escape }}\n"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% else %}{{ m.text | escape }}{% endif %}<|im_end|>\n{% endfor %}"
)


def escape(text: str) -> str:
    """Puts a backslash between < and |, behind those that stand there: no control string is left, none is lost."""
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def one_line(text: str) -> str:
    return text.replace("\\", "\\\\").replace("\n", "\\n")


def from_line(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text)


FILTERS: dict[str, Callable[[str], str]] = {"escape": escape, "line": one_line, "trim": str.strip, "upper": str.upper, "lower": str.lower}

Node = tuple  # (kind, ...)


class TemplateError(ValueError):
    pass


_TOKEN = re.compile(r"\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|[+|.()\[\]]))")
_CONSTANTS = {"true": True, "false": False, "none": None}
_PLAIN = {"n": "\n", "t": "\t"}


class _Expression:
    """Recursive descent: or, and, not, comparison, sum, filters, fields."""

    def __init__(self, source: str):
        self.tokens, at = [], 0
        source = source.strip()
        while at < len(source):
            if not (m := _TOKEN.match(source, at)):
                raise TemplateError(f"can't read {source[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self, *ops: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] != "str" and self.tokens[self.at][1] in ops

    def take(self, kind: str | None = None) -> str:
        if self.at == len(self.tokens) or kind and self.tokens[self.at][0] != kind:
            raise TemplateError(f"{kind or 'more'} expected after {[t for _, t in self.tokens[: self.at]]}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def whole(self) -> Node:
        node = self.any()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return node

    def any(self) -> Node:
        node = self.all()
        while self.peek("or"):
            self.take()
            node = ("or", node, self.all())
        return node

    def all(self) -> Node:
        node = self.negated()
        while self.peek("and"):
            self.take()
            node = ("and", node, self.negated())
        return node

    def negated(self) -> Node:
        if self.peek("not"):
            self.take()
            return ("not", self.negated())
        node = self.sum()
        if self.peek("==", "!="):
            node = (self.take(), node, self.sum())
        return node

    def sum(self) -> Node:
        node = self.filtered()
        while self.peek("+"):
            self.take()
            node = ("+", node, self.filtered())
        return node

    def filtered(self) -> Node:
        node = self.fields()
        while self.peek("|"):
            self.take()
            if (name := self.take("name")) not in FILTERS:
                raise TemplateError(f"no filter {name}")
            node = ("filter", name, node)
        return node

    def fields(self) -> Node:
        kind, node = self.tokens[self.at][0] if self.at < len(self.tokens) else None, None
        if kind == "str":
            node = ("const", re.sub(r"\\(.)", lambda m: _PLAIN.get(m[1], m[1]), self.take()[1:-1]))
        elif kind == "int":
            node = ("const", int(self.take()))
        elif kind == "name":
            name = self.take()
            node = ("const", _CONSTANTS[name]) if name in _CONSTANTS else ("name", name)
        elif self.peek("("):
            self.take()
            node = self.any()
            if self.take() != ")":
                raise TemplateError(") expected")
        else:
            raise TemplateError("a value expected")
        while self.peek(".", "["):
            if self.take() == ".":
                node = ("field", node, ("const", self.take("name")))
            else:
                node = ("field", node, self.any())
                if self.take() != "]":
                    raise TemplateError("] expected")
        return node


def parse(source: str) -> Node:
    """The template's syntax tree: ("block", nodes) of text, put, for, if and generation nodes."""
    parts = re.split(r"(\{\{.*?\}\}|\{%.*?%\})", source, flags=re.S)
    stack: list[tuple[str, list, list]] = [("", [], [])]  # what is open: tag, its details, nodes so far
    for part in parts:
        nodes = stack[-1][2]
        if part.startswith("{{"):
            nodes.append(("put", _Expression(part[2:-2]).whole()))
            continue
        if not part.startswith("{%"):
            if part:
                nodes.append(("text", part))
            continue
        word, _, rest = part[2:-2].strip().partition(" ")
        tag, details, _ = stack[-1]
        if word == "for":
            if not (m := re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.+)", rest.strip(), re.S)):
                raise TemplateError(f"can't read for {rest}")
            stack.append(("for", [m[1], _Expression(m[2]).whole()], []))
        elif word == "if":
            stack.append(("if", [_Expression(rest).whole()], []))
        elif word in ("elif", "else") and tag == "if" and details[-1] != ("const", True):
            details += [("block", nodes[:]), _Expression(rest).whole() if word == "elif" else ("const", True)]
            nodes.clear()
        elif word == "generation":
            stack.append(("generation", [], []))
        elif word == f"end{tag}" and tag:
            stack.pop()
            stack[-1][2].append((tag, *details, ("block", nodes)))
        else:
            raise TemplateError(f"unexpected {word}")
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0]} has no end")
    return ("block", stack[0][2])


def fold(node: Node) -> Node:
    """The same tree with what is constant computed: sums, comparisons, filters, branches, neighbouring texts."""
    kind = node[0]
    if kind in ("text", "const", "name"):
        return node
    if kind == "block":
        out: list[Node] = []
        for n in map(fold, node[1]):
            for m in n[1] if n[0] == "block" else [n]:
                if m[0] == "text" and out and out[-1][0] == "text":
                    out[-1] = ("text", out[-1][1] + m[1])
                elif m != ("text", ""):
                    out.append(m)
        return ("block", out)
    if kind == "if":
        cases = []
        for test, body in zip(node[1::2], node[2::2], strict=True):
            test = fold(test)
            if test[0] == "const" and not test[1]:
                continue
            cases += [test, fold(body)]
            if test[0] == "const":
                break
        return ("block", []) if not cases else cases[1] if cases[0][0] == "const" else ("if", *cases)
    node = (kind, *(fold(x) if isinstance(x, tuple) else x for x in node[1:]))
    if kind == "put" and node[1][0] == "const":
        return ("text", _shown(node[1][1]))
    inner = [x for x in node[1:] if isinstance(x, tuple)]
    if kind in ("+", "==", "!=", "not", "and", "or", "filter") and all(x[0] == "const" for x in inner):
        return ("const", _value(node)({}))
    return node


def _shown(value: object) -> str:
    if value is None:
        return ""
    if not isinstance(value, str | int):
        raise TemplateError("only strings and numbers can be shown")
    return str(value)


def _added(a: object, b: object) -> object:
    return a + b if type(a) is type(b) is int else _shown(a) + _shown(b)


def _field(of: object, key: object) -> object:
    return of.get(key) if type(of) is dict else None


def _value(node: Node) -> Callable[[dict], object]:
    """A closure that computes an expression from the names that are bound."""
    kind = node[0]
    if kind == "const":
        return lambda env, x=node[1]: x
    if kind == "name":
        return lambda env, name=node[1]: env.get(name)
    if kind == "filter":
        f, of = FILTERS[node[1]], _value(node[2])
        return lambda env: f(_shown(of(env)))
    if kind == "not":
        of = _value(node[1])
        return lambda env: not of(env)
    a, b = map(_value, node[1:])
    return {
        "field": lambda env: _field(a(env), b(env)), "+": lambda env: _added(a(env), b(env)), "==": lambda env: a(env) == b(env),
        "!=": lambda env: a(env) != b(env), "and": lambda env: a(env) and b(env), "or": lambda env: a(env) or b(env),
    }[kind]


@dataclass
class Rendering:
    """Text so far; spans of it, in code points, that stand under the generation mark."""

    parts: list[str] = field(default_factory=list)
    length: int = 0
    spans: list[tuple[int, int]] = field(default_factory=list)

    def put(self, text: str) -> None:
        self.parts.append(text)
        self.length += len(text)


def _step(node: Node) -> Callable[[dict, Rendering], None]:
    """A closure that renders a node."""
    kind = node[0]
    if kind == "text":
        return lambda env, out, text=node[1]: out.put(text)
    if kind == "put":
        value = _value(node[1])
        return lambda env, out: out.put(_shown(value(env)))
    if kind == "block":
        steps = [_step(n) for n in node[1]]

        def block(env: dict, out: Rendering) -> None:
            for s in steps:
                s(env, out)

        return block
    if kind == "if":
        cases = [(_value(t), _step(b)) for t, b in zip(node[1::2], node[2::2], strict=True)]

        def branch(env: dict, out: Rendering) -> None:
            for test, body in cases:
                if test(env):
                    body(env, out)
                    break

        return branch
    if kind == "for":
        name, values, body = node[1], _value(node[2]), _step(node[3])

        def loop(env: dict, out: Rendering) -> None:
            items = values(env)
            items = items if type(items) is list else []
            inner = dict(env)
            for i, item in enumerate(items):
                inner[name], inner["loop"] = item, {"index": i + 1, "first": i == 0, "last": i == len(items) - 1}
                body(inner, out)

        return loop
    body = _step(node[1])

    def generation(env: dict, out: Rendering) -> None:
        start = out.length
        body(env, out)
        out.spans.append((start, out.length))

    return generation


@lru_cache(maxsize=64)
def compiled(source: str) -> Callable[[list[dict]], tuple[str, list[tuple[int, int]]]]:
    """Renders a list of messages to (text, spans under the generation mark)."""
    run = _step(fold(parse(source)))

    def render(messages: list[dict]) -> tuple[str, list[tuple[int, int]]]:
        out = Rendering()
        run({"messages": messages}, out)
        return "".join(out.parts), out.spans

    return render


def format_conversations(turns: DataFrame, template: str = CHAT, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: its id, formatted (the text), starts and ends (code points under the loss mask).

    Turns are dealt by conversation and sorted, then read as a stream: a task holds one conversation at a time, which
    is what its one result row has to hold anyway.

    Defined cases: null texts and roles are empty. Turns of a null conversation form one with a null id. Null turn
    numbers come first; rows of one turn number are ordered by role and text, and repeated rows stay. Conversation ids
    are whole numbers; others end the job with an error. Very long texts stay whole. Other columns are ignored, whatever
    their names. An empty table gives an empty result.
    """
    compiled(template)  # a template that can't be read fails here, on the driver

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        render, at, messages = compiled(template), None, []

        def row() -> tuple:
            text, spans = render(messages)
            return at[0], text, [a for a, _ in spans], [b for _, b in spans]

        for b in batches:
            out, held = [], 0
            for c, null, role, text in zip(b["c"].tolist(), b["no_c"].tolist(), b["role"], b["text"], strict=True):
                here = (None,) if null else (c,)
                if here != at:
                    if at is not None:
                        out.append(row())
                        held += len(out[-1][1])
                        if held > 4_000_000:
                            yield pd.DataFrame(out, columns=["c", "formatted", "starts", "ends"]).astype({"c": "Int64"})
                            out, held = [], 0
                    at, messages = here, []
                messages.append({"role": role, "text": text})
            yield pd.DataFrame(out, columns=["c", "formatted", "starts", "ends"]).astype({"c": "Int64"})
        if at is not None:
            yield pd.DataFrame([row()], columns=["c", "formatted", "starts", "ends"]).astype({"c": "Int64"})

    rows = turns.select(
        F.coalesce(F.col(conv_col), F.lit(0)).cast("bigint").alias("c"), F.col(conv_col).isNull().alias("no_c"), F.col(turn_col).alias("t"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    sorted_rows = rows.repartition("no_c", "c").sortWithinPartitions("no_c", "c", "t", "role", "text").drop("t")
    return sorted_rows.mapInPandas(run, "c bigint, formatted string, starts array<bigint>, ends array<bigint>").withColumnRenamed("c", conv_col)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a text that CHAT made."""
    return [(from_line(unescape(head)), unescape(body)) for head, body in re.findall(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", formatted, re.S)]


def digests(formatted: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """What format_conversations(), with CHAT, made, read back: id, n_turns, digests of turns and of masked text, sizes.

    Defined cases: a row for each row of formatted, repeated ones too, whose texts and spans are not null; very long
    texts are read back whole; an empty table gives an empty result.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for text, starts, ends in zip(b["formatted"], b["starts"], b["ends"], strict=True):
                turns = read_back(text)
                loss = [unescape(text[s:e]) for s, e in zip(starts, ends, strict=True)]
                whole = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
                out.append((len(turns), whole, sum(map(len, loss)), hashlib.sha256("".join(loss).encode()).hexdigest(), len(text)))
            made = pd.DataFrame(out, columns=["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
            yield pd.concat([b[["c"]].reset_index(drop=True), made], axis=1)

    columns = "c bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    return formatted.withColumnRenamed(conv_col, "c").mapInPandas(run, columns).withColumnRenamed("c", conv_col)
