"""Chat formatting with compiled templates.

A template is parsed into a syntax tree, constant parts are folded, and the
tree becomes Python closures that yield pieces of text, each with a mark that
tells whether a model is to learn from it (inside ``generation``). The
language is a sandbox: texts, ``{{ expression }}``, ``{% for x in xs %}``,
``{% if %}``/``elif``/``else``, ``{% generation %}``, ``{% set x = ... %}``.
Expressions: strings, integers, names, keys of records (``message.role``),
``loop.first``, ``loop.index``, ``==``, ``!=``, ``+``, ``and``, ``or``,
``not``, filters. No calls, no attributes of objects, no other statements.

A conversation is rendered while it is read: rows are dealt by conversation,
sorted by turn outside memory, and a ``for`` over the messages holds one of
them. A conversation of any length takes constant memory; its order makes it
the work of one task.

``escape`` keeps control strings out of texts and can be undone: a backslash
is doubled and "<|" becomes "<\\|" (in a role, a line end gets a backslash
too), so no escaped text contains "<|".

Null texts and null roles are empty. Turns go by (turn, role, text), null
first; repeated rows are turns of their own; a null conv_id is one
conversation. An empty table gives an empty result. Only the four named
columns are read.
"""

from __future__ import annotations

import hashlib
import itertools
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwright.llm.common import quoted

START, END = "<|im_start|>", "<|im_end|>"
CHATML = (
    "{% for message in messages %}{{ '<|im_start|>' + (message.role | escape_line) + '\\n' }}"
    "{% if message.role == 'assistant' %}{% generation %}{{ message.text | escape }}{% endgeneration %}"
    "{% else %}{{ message.text | escape }}{% endif %}{{ '<|im_end|>' + '\\n' }}{% endfor %}"
)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def escape_line(text: str) -> str:
    return escape(text).replace("\n", "\\\n")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


FILTERS = {"escape": escape, "escape_line": escape_line, "trim": str.strip, "upper": str.upper, "lower": str.lower}
CUT = re.compile(r"(\{\{.*?\}\}|\{%.*?%\})", re.S)
TOKEN = re.compile(r"""\s*(?:(?P<string>'(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*")|(?P<number>\d+)|(?P<name>[A-Za-z]\w*)|(?P<op>==|!=|[.|+()=]))""", re.S)
ESCAPES = {"n": "\n", "t": "\t"}


class TemplateError(ValueError):
    """The template is not of the language."""


class Expression:
    """Parses one expression; constant parts come out as ("const", value)."""

    def __init__(self, source: str):
        self.tokens, at, source = [], 0, source.rstrip()
        while at < len(source):
            m = TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"cannot read {source[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()

    def take(self, *wanted):
        if self.tokens and self.tokens[0] in [("op", w) if not w.isalpha() else ("name", w) for w in wanted]:
            return self.tokens.pop(0)[1]
        return None

    def next(self, kind):
        if not self.tokens or self.tokens[0][0] != kind:
            raise TemplateError(f"{kind} expected")
        return self.tokens.pop(0)[1]

    def whole(self):
        node = self.either()
        if self.tokens:
            raise TemplateError(f"not understood: {self.tokens[0][1]!r}")
        return node

    def either(self):
        node = self.both()
        while self.take("or"):
            node = _fold("or", node, self.both())
        return node

    def both(self):
        node = self.negated()
        while self.take("and"):
            node = _fold("and", node, self.negated())
        return node

    def negated(self):
        return _fold("not", self.negated()) if self.take("not") else self.compared()

    def compared(self):
        node = self.added()
        while op := self.take("==", "!="):
            node = _fold(op, node, self.added())
        return node

    def added(self):
        node = self.filtered()
        while self.take("+"):
            node = _fold("+", node, self.filtered())
        return node

    def filtered(self):
        node = self.value()
        while self.take("|"):
            name = self.next("name")
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            node = _fold(name, node)
        return node

    def value(self):
        if self.take("("):
            node = self.either()
            if not self.take(")"):
                raise TemplateError("')' expected")
            return node
        if not self.tokens:
            raise TemplateError("a value is missing")
        kind, text = self.tokens.pop(0)
        if kind == "string":
            return "const", re.sub(r"\\(.)", lambda m: ESCAPES.get(m[1], m[1]), text[1:-1], flags=re.S)
        if kind == "number":
            return "const", int(text)
        if kind != "name":
            raise TemplateError(f"not understood: {text!r}")
        if text in ("true", "false"):
            return "const", text == "true"
        node = ("name", text)
        while self.take("."):
            node = ("key", node, self.next("name"))
        return node


OPERATIONS = {
    "or": lambda a, b: a or b,
    "and": lambda a, b: a and b,
    "not": lambda a: not a,
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "+": lambda a, b: a + b,
    **FILTERS,
}


def _fold(op, *nodes):
    if all(n[0] == "const" for n in nodes):
        return "const", OPERATIONS[op](*[n[1] for n in nodes])
    return "apply", op, nodes


def parse(template: str) -> list:
    """The syntax tree: a list of statements."""
    parts = [p for p in CUT.split(template) if p]

    def block(*ends):
        out = []
        while parts:
            part = parts.pop(0)
            if part.startswith("{{"):
                out.append(("emit", Expression(part[2:-2]).whole()))
            elif part.startswith("{%"):
                words = part[2:-2].split(None, 1)
                word, rest = words[0] if words else "", words[1] if len(words) > 1 else ""
                if word in ends:
                    return _tidy(out), word, rest
                out.append(statement(word, rest))
            else:
                out.append(("emit", ("const", part)))
        if ends:
            raise TemplateError(f"{' or '.join(ends)} is missing")
        return _tidy(out), "", ""

    def statement(word, rest):
        if word == "for":
            m = re.fullmatch(r"([A-Za-z]\w*)\s+in\s+(.+)", rest.strip(), re.S)
            if not m:
                raise TemplateError(f"for {rest!r}")
            return "for", m[1], Expression(m[2]).whole(), block("endfor")[0]
        if word == "generation":
            return "generation", block("endgeneration")[0]
        if word == "set":
            m = re.fullmatch(r"([A-Za-z]\w*)\s*=(?!=)(.+)", rest.strip(), re.S)
            if not m:
                raise TemplateError(f"set {rest!r}")
            return "set", m[1], Expression(m[2]).whole()
        if word == "if":
            arms, test = [], Expression(rest).whole()
            while True:
                body, end, rest = block("elif", "else", "endif")
                arms.append((test, body))
                if end == "endif":
                    return "if", arms
                test = Expression(rest).whole() if end == "elif" else ("const", True)
        raise TemplateError(f"no statement {word!r}")

    return block()[0]


def _tidy(statements: list) -> list:
    """Fold what is constant: neighbouring texts become one, arms that cannot be taken go."""
    out = []
    for s in statements:
        if s[0] == "if":
            arms = []
            for test, body in s[1]:
                if test[0] != "const" or test[1]:
                    arms.append((test, body))
                if test[0] == "const" and test[1]:
                    break
            if not arms:
                continue
            if arms[0][0][0] == "const":
                out.extend(arms[0][1])
                continue
            s = ("if", arms)
        out.append(s)
    merged = []
    for s in out:
        constant = s[0] == "emit" and s[1][0] == "const"
        if constant and merged and merged[-1][0] == "emit" and merged[-1][1][0] == "const":
            merged[-1] = ("emit", ("const", str(merged[-1][1][1]) + str(s[1][1])))
        elif not (constant and s[1][1] == ""):
            merged.append(s)
    return merged


def _value(node):
    """A closure from the scope to the value."""
    if node[0] == "const":
        return lambda scope, v=node[1]: v
    if node[0] == "name":
        return lambda scope, n=node[1]: scope.get(n)
    if node[0] == "key":
        inner, key = _value(node[1]), node[2]

        def get(scope):
            record = inner(scope)
            return record.get(key) if type(record) is dict else None

        return get
    do, parts = OPERATIONS[node[1]], [_value(n) for n in node[2]]
    if node[1] in FILTERS:
        return lambda scope, p=parts[0]: do("" if (v := p(scope)) is None else str(v))
    if len(parts) == 1:
        return lambda scope, p=parts[0]: do(p(scope))
    if node[1] == "and":
        return lambda scope, p=parts[0], q=parts[1]: p(scope) and q(scope)
    if node[1] == "or":
        return lambda scope, p=parts[0], q=parts[1]: p(scope) or q(scope)
    if node[1] == "+":
        return lambda scope, p=parts[0], q=parts[1]: do(*("" if v is None else v for v in (p(scope), q(scope))))
    return lambda scope, p=parts[0], q=parts[1]: do(p(scope), q(scope))


def _with_next(items):
    """(index from 0, item, whether it is the last) while reading one item ahead."""
    items, n = iter(items or ()), 0
    for item in items:
        before, n = item, 0
        for item in items:
            yield n, before, False
            before, n = item, n + 1
        yield n, before, True


def _statements(tree: list):
    """A closure (scope, marked) -> pieces (text, marked)."""
    runs = [_statement(s) for s in tree]

    def run(scope, marked):
        for r in runs:
            yield from r(scope, marked)

    return run


def _statement(s):
    if s[0] == "emit":
        value = _value(s[1])

        def emit(scope, marked):
            got = value(scope)
            if got is not None and got != "":
                yield str(got), marked

        return emit
    if s[0] == "set":
        value = _value(s[2])

        def put(scope, marked):
            scope[s[1]] = value(scope)
            return iter(())

        return put
    if s[0] == "generation":
        body = _statements(s[1])
        return lambda scope, marked: body(scope, True)
    if s[0] == "if":
        arms = [(_value(test), _statements(body)) for test, body in s[1]]

        def branch(scope, marked):
            for test, body in arms:
                if test(scope):
                    yield from body(scope, marked)
                    return

        return branch
    name, items, body = s[1], _value(s[2]), _statements(s[3])

    def loop(scope, marked):
        for n, item, last in _with_next(items(scope)):
            yield from body({**scope, name: item, "loop": {"index": n + 1, "first": n == 0, "last": last}}, marked)

    return loop


def compile_template(template: str):
    """A function of the scope (a dict) that yields (text, whether it is to be learned)."""
    run = _statements(parse(template))
    return lambda **scope: run(dict(scope), False)


def format_conversations(conversations: DataFrame, template: str = CHATML) -> DataFrame:
    """The formatted conversations as pieces in order: conv_id, segment, text, loss.

    A partition holds whole conversations, one after the other; the text of
    one is that of its pieces end to end.
    """
    parse(template)  # a wrong template fails here and not in a task

    def run(batches):
        render = compile_template(template)
        rows = (r for batch in batches for r in zip(*(batch.column(i).to_pylist() for i in range(3))))
        out, size = [], 0
        for conv, turns in itertools.groupby(rows, lambda r: r[0]):
            messages = ({"role": role, "text": text} for _, role, text in turns)
            for n, (text, loss) in enumerate(render(messages=messages)):
                out.append((conv, n, text, loss))
                size += len(text)
                if size > 1 << 22 or len(out) > 4096:
                    yield _batch(out, kind)
                    out, size = [], 0
        if out:
            yield _batch(out, kind)

    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    read = conversations.select(F.col("conv_id"), F.col("turn"), empty("role").alias("role"), empty("text").alias("text"))
    dealt = read.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    schema = T.StructType([dealt.schema["conv_id"], T.StructField("segment", T.LongType()), T.StructField("text", T.StringType()), T.StructField("loss", T.BooleanType())])
    kind = _arrow(schema)
    return dealt.mapInArrow(run, schema)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _batch(rows: list[tuple], kind: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kind)], schema=kind)


def _turns(pieces):
    """(role, text) of each turn, read from pieces of formatted text; holds one turn at a time."""
    held = ""
    for piece in pieces:
        held += piece
        while (end := held.find(END + "\n")) >= 0:
            turn, held = held[len(START) : end], held[end + len(END) + 1 :]
            role = re.match(r"(?:\\.|[^\\\n])*", turn, re.S)[0]
            yield unescape(role), unescape(turn[len(role) + 1 :])


def read_back(formatted: DataFrame) -> DataFrame:
    """One row per conversation, from the pieces as ``format_conversations`` leaves them, of the default template."""

    def run(batches):
        rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns)))
        for conv, pieces in itertools.groupby(rows, lambda r: r[0]):
            turns, loss, seen = hashlib.sha256(), hashlib.sha256(), {"chars": 0, "loss": 0}

            def watched():
                for _, _, text, learned in pieces:
                    seen["chars"] += len(text)
                    if learned:
                        plain = unescape(text)
                        loss.update(plain.encode())
                        seen["loss"] += len(plain)
                    yield text

            n = 0
            for role, text in _turns(watched()):
                turns.update(f"{role}\n{text}\n".encode())
                n += 1
            yield _batch([(conv, n, turns.hexdigest(), seen["loss"], loss.hexdigest(), seen["chars"])], kind)

    schema = T.StructType([
        formatted.schema["conv_id"],
        T.StructField("n_turns", T.LongType()),
        T.StructField("turns_sha256", T.StringType()),
        T.StructField("loss_chars", T.LongType()),
        T.StructField("loss_sha256", T.StringType()),
        T.StructField("formatted_chars", T.LongType()),
    ])
    kind = _arrow(schema)
    return formatted.mapInArrow(run, schema)
