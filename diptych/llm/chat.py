"""Chat formatting: a small template language compiled to Python closures that render conversations turn by turn.

The language has text, ``{{ expression }}``, ``{% for x in turns %}``, ``{% if %}/{% elif %}/{% else %}`` and
``{% generation %}``, which marks the output that a model is trained on.  An expression is a literal, a name, an
attribute (``turn.role``), a comparison, ``and``/``or``/``not``, ``~`` or ``+`` (concatenation), or a filter from
``FILTERS``.  There are no calls, no subscripts, no imports and no access to Python objects: names are looked up in the
conversation's values alone, so a template cannot reach anything else.

A template is parsed to a tree, constants are folded (adjacent text is joined, constant tests choose their branch), and
the tree becomes closures that yield pieces.  The loop takes turns from an iterator, so a conversation is never held
whole: memory is bounded by its longest turn.

Control strings inside texts are escaped reversibly: ``<|`` becomes ``<\\|``, and so that this can be undone, whatever
backslashes (and an ``n``) stand between ``<`` and ``|`` get one more before them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The production template: each turn between markers, the assistant's texts under the loss mask.
CHATML = (
    "{% for turn in turns %}{{ '<|im_start|>' ~ turn.role|escape_line ~ '\\n' }}"
    "{% if turn.role == 'assistant' %}{% generation %}{{ turn.text|escape }}{% endgeneration %}{% else %}{{ turn.text|escape }}{% endif %}"
    "{{ '<|im_end|>' ~ '\\n' }}{% endfor %}"
)

_RUN = re.compile(r"<(\\*n?)\|")
_ESCAPED = re.compile(r"<(?:n|\\(\\*n?))\|")


def escape(text: str) -> str:
    return _RUN.sub(r"<\\\1|", text)


def escape_line(text: str) -> str:
    """As escape, and on one line: a line end becomes ``<n|``, which escape leaves nowhere."""
    return escape(text).replace("\n", "<n|")


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] is None else f"<{m[1]}|", text)


FILTERS: dict[str, Callable[[str], str]] = {"escape": escape, "escape_line": escape_line, "trim": str.strip, "lower": str.lower, "upper": str.upper}


class TemplateError(ValueError):
    """The template is not of the language."""


# Trees: expressions and statements.
@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    path: tuple[str, ...]


@dataclass(frozen=True)
class Op:
    kind: str
    args: tuple


@dataclass(frozen=True)
class Out:
    value: object


@dataclass(frozen=True)
class If:
    test: object
    then: tuple
    other: tuple


@dataclass(frozen=True)
class For:
    name: str
    over: str
    body: tuple


@dataclass(frozen=True)
class Gen:
    body: tuple


_TOKEN = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(\d+)|([A-Za-z_]\w*)|(==|!=|[.|~+()]))", re.S)
_SIMPLE = {"\\n": "\n", "\\t": "\t", "\\\\": "\\", "\\'": "'", '\\"': '"'}


class _Expression:
    """Recursive descent: or, and, not, comparison, concatenation, filters, atoms."""

    def __init__(self, text: str):
        self.tokens, at, text = [], 0, text.rstrip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise TemplateError(f"cannot read {text[at:]!r}")
            at = m.end()
            self.tokens.append(next((kind, x) for kind, x in zip(("text", "int", "name", "sign"), m.groups(), strict=True) if x is not None))
        self.at = 0

    def peek(self, *values: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] in ("name", "sign") and self.tokens[self.at][1] in values

    def take(self, kind: str | None = None) -> str:
        if self.at >= len(self.tokens) or kind and self.tokens[self.at][0] != kind:
            raise TemplateError("the expression ends too early or has a wrong part")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def whole(self):
        out = self.any_of()
        if self.at < len(self.tokens):
            raise TemplateError(f"cannot read {self.tokens[self.at][1]!r}")
        return out

    def chain(self, inner: Callable, kind: str, *signs: str):
        parts = [inner()]
        while self.peek(*signs):
            self.at += 1
            parts.append(inner())
        return parts[0] if len(parts) == 1 else Op(kind, tuple(parts))

    def any_of(self):
        return self.chain(self.all_of, "or", "or")

    def all_of(self):
        return self.chain(self.negated, "and", "and")

    def negated(self):
        if self.peek("not"):
            self.at += 1
            return Op("not", (self.negated(),))
        left = self.joined()
        if self.peek("==", "!="):
            kind = self.take()
            return Op(kind, (left, self.joined()))
        return left

    def joined(self):
        return self.chain(self.filtered, "join", "~", "+")

    def filtered(self):
        out = self.atom()
        while self.peek("|"):
            self.at += 1
            name = self.take("name")
            if name not in FILTERS:
                raise TemplateError(f"no filter {name}")
            out = Op(f"filter {name}", (out,))
        return out

    def atom(self):
        if self.peek("("):
            self.at += 1
            out = self.any_of()
            if not self.peek(")"):
                raise TemplateError("a bracket is open")
            self.at += 1
            return out
        kind, value = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
        self.take()
        if kind == "text":
            return Const(re.sub(r"\\.", lambda m: _SIMPLE.get(m[0], m[0]), value[1:-1]))
        if kind == "int":
            return Const(int(value))
        if kind != "name":
            raise TemplateError(f"cannot read {value!r}")
        if value in ("true", "false"):
            return Const(value == "true")
        path = [value]
        while self.peek("."):
            self.at += 1
            path.append(self.take("name"))
        if any(x.startswith("_") for x in path):
            raise TemplateError("names that begin with _ are closed")
        return Name(tuple(path))


_TAG = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.S)


def parse(template: str) -> tuple:
    """The template's tree."""
    pieces, at = [], 0
    for m in _TAG.finditer(template):
        pieces += [("text", template[at : m.start()])] * (m.start() > at)
        pieces.append(("out", m[1]) if m[1] is not None else ("tag", m[2].strip()))
        at = m.end()
    pieces += [("text", template[at:])] * (at < len(template))
    place = 0

    def block(*ends: str) -> tuple[list, str]:
        nonlocal place
        out: list = []
        while place < len(pieces):
            kind, value = pieces[place]
            place += 1
            if kind == "text":
                out.append(Out(Const(value)))
            elif kind == "out":
                out.append(Out(_Expression(value).whole()))
            else:
                word, _, rest = value.partition(" ")
                if word in ends:
                    return out, value
                if word == "for":
                    m = re.fullmatch(r"\s*([A-Za-z]\w*)\s+in\s+([A-Za-z]\w*)\s*", rest)
                    if not m:
                        raise TemplateError(f"cannot read for {rest!r}")
                    out.append(For(m[1], m[2], tuple(block("endfor")[0])))
                elif word == "generation":
                    out.append(Gen(tuple(block("endgeneration")[0])))
                elif word == "if":
                    out.append(branch(rest))
                else:
                    raise TemplateError(f"no tag {word!r}")
        if ends:
            raise TemplateError(f"{ends[0]} is missing")
        return out, ""

    def branch(test: str) -> If:
        then, end = block("elif", "else", "endif")
        if end.startswith("elif"):
            return If(_Expression(test).whole(), tuple(then), (branch(end[4:]),))
        return If(_Expression(test).whole(), tuple(then), tuple(block("endif")[0]) if end == "else" else ())

    return tuple(block()[0])


def _text(value: object) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value).lower() if isinstance(value, bool) else str(value)


def _apply(kind: str, values: list) -> object:
    if kind == "join":
        return "".join(map(_text, values))
    if kind in ("==", "!="):
        return (values[0] == values[1]) == (kind == "==")
    if kind == "not":
        return not values[0]
    if kind.startswith("filter "):
        return FILTERS[kind[7:]](_text(values[0]))
    return next((x for x in values if bool(x) == (kind == "or")), values[-1])


def _fold_value(x):
    if not isinstance(x, Op):
        return x
    args = [_fold_value(a) for a in x.args]
    if x.kind == "join":
        flat: list = []
        for a in (b for c in args for b in (c.args if isinstance(c, Op) and c.kind == "join" else (c,))):
            if isinstance(a, Const) and flat and isinstance(flat[-1], Const):
                flat[-1] = Const(_text(flat[-1].value) + _text(a.value))
            else:
                flat.append(a)
        return flat[0] if len(flat) == 1 and isinstance(flat[0], Const) else Op("join", tuple(flat))
    if all(isinstance(a, Const) for a in args):
        return Const(_apply(x.kind, [a.value for a in args]))
    return Op(x.kind, tuple(args))


def fold(body: tuple) -> tuple:
    """The same tree with constant expressions computed, constant tests decided, and adjacent text joined."""
    out: list = []
    for x in body:
        if isinstance(x, Out):
            value = _fold_value(x.value)
            parts = [Out(a) for a in value.args] if isinstance(value, Op) and value.kind == "join" else [Out(value)]
        elif isinstance(x, If):
            test = _fold_value(x.test)
            parts = list(fold(x.then if test.value else x.other)) if isinstance(test, Const) else [If(test, fold(x.then), fold(x.other))]
        elif isinstance(x, For):
            parts = [For(x.name, x.over, fold(x.body))]
        else:
            parts = [Gen(fold(x.body))]
        for p in parts:
            if isinstance(p, Out) and isinstance(p.value, Const) and out and isinstance(out[-1], Out) and isinstance(out[-1].value, Const):
                out[-1] = Out(Const(_text(out[-1].value.value) + _text(p.value.value)))
            else:
                out.append(p)
    return tuple(out)


def _value(x) -> Callable[[dict], object]:
    if isinstance(x, Const):
        return lambda names, v=x.value: v
    if isinstance(x, Name):
        first, rest = x.path[0], x.path[1:]

        def look(names: dict) -> object:
            out = names.get(first)
            for part in rest:
                out = out.get(part) if isinstance(out, dict) else None
            return out

        return look
    args = [_value(a) for a in x.args]
    return lambda names, kind=x.kind: _apply(kind, [a(names) for a in args])


def _render(body: tuple, marked: bool = False) -> Callable[[dict], Iterator[tuple[str, bool]]]:
    steps: list[Callable[[dict], Iterator[tuple[str, bool]]]] = []
    for x in body:
        if isinstance(x, Out):
            value = _value(x.value)

            def put(names, value=value):
                yield _text(value(names)), marked

            steps.append(put)
        elif isinstance(x, Gen):
            steps.append(_render(x.body, True))
        elif isinstance(x, If):

            def choose(names, test=_value(x.test), then=_render(x.then, marked), other=_render(x.other, marked)):
                yield from (then if test(names) else other)(names)

            steps.append(choose)
        else:

            def loop(names, name=x.name, over=x.over, inner=_render(x.body, marked)):
                for item in names.get(over) or ():
                    yield from inner({**names, name: item})

            steps.append(loop)

    def run(names: dict) -> Iterator[tuple[str, bool]]:
        for step in steps:
            yield from step(names)

    return run


def compile_template(template: str) -> Callable[[dict], Iterator[tuple[str, bool]]]:
    """A function from the values that a template sees to pieces of output, each with whether it is under the loss mask."""
    return _render(fold(parse(template)))


class Reader:
    """Reads turns back from output of CHATML, piece by piece, holding one turn at most."""

    _TURN = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.S)

    def __init__(self):
        self.rest, self.n_turns, self.turns, self.chars = "", 0, hashlib.sha256(), 0

    def add(self, piece: str) -> None:
        self.chars += len(piece)
        self.rest += piece
        if not piece.endswith("<|im_end|>\n"):
            return
        at = 0
        for m in self._TURN.finditer(self.rest):
            self.n_turns += 1
            self.turns.update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode())
            at = m.end()
        self.rest = self.rest[at:]


_DIGEST = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()), T.StructField("loss_chars", T.LongType()),
    T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType()),
])
_PIECES = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("piece", T.LongType()), T.StructField("text", T.StringType()), T.StructField("loss", T.BooleanType())])


def _ordered(conversations: DataFrame) -> DataFrame:
    """Turns by conversation; ties of a turn number are ordered by role and text, so that reruns agree."""
    turns = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, Iterator[dict]]]:
    """Conversations of sorted turns, each as an iterator that must be used up before the next."""
    from itertools import groupby

    def rows():
        for batch in batches:
            ids, roles, texts = batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for i, role, text in zip(ids, roles, texts, strict=True):
                yield i, {"role": role, "text": text}

    for key, group in groupby(rows(), key=lambda r: r[0]):
        yield key, (turn for _, turn in group)


def format_conversations(conversations: DataFrame, template: str = CHATML) -> DataFrame:
    """conv_id, piece (its place), text and loss: the output of the template, cut where the loss mask changes or a turn's part ends.

    Null roles and texts are empty; rows with a null conv_id are one conversation of that id; an empty table gives none.
    """

    def make(batches):
        render = compile_template(template)
        out: list[tuple] = []
        for key, turns in _conversations(batches):
            for k, (text, loss) in enumerate(p for p in render({"turns": turns}) if p[0]):
                out.append((key, k, text, loss))
                if len(out) >= 2000:
                    yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.bool_()))], names=_PIECES.names)
                    out = []
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.bool_()))], names=_PIECES.names)

    return _ordered(conversations).mapInArrow(make, _PIECES)


def digest(conversations: DataFrame, template: str = CHATML) -> DataFrame:
    """What is read back from each conversation's output: its turns and the text under the loss mask, unescaped, as digests."""

    def make(batches):
        render = compile_template(template)
        out: list[tuple] = []
        for key, turns in _conversations(batches):
            reader, loss, n = Reader(), hashlib.sha256(), 0
            for text, marked in render({"turns": turns}):
                reader.add(text)
                if marked:
                    plain = unescape(text)
                    loss.update(plain.encode())
                    n += len(plain)
            out.append((key, reader.n_turns, reader.turns.hexdigest(), n, loss.hexdigest(), reader.chars))
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()))], names=_DIGEST.names)

    return _ordered(conversations).mapInArrow(make, _DIGEST)
