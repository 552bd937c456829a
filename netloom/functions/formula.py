"""A small formula language compiled to a Column.

Statements are lines scoped by indentation (spaces only): an expression, `name = expression`, `return expression`, `if`, `elif`, `else`. The value of the
last statement is the result. Operators from loosest to tightest: `=`, `and`, `or`, `not`, comparisons and `is`, `+ -`, `* / %`, `^`, calls. So `or`
binds tighter than `and`. Whole numbers divide to whole numbers. Names: value("column"), setvalue("column", x), mark(), setmark(x), e, pi, true, false,
none, variables; connections(), the list of a row's neighbours in a graph (of a segment's "forward" or "back" side, or of a cell's bin, by that
argument), which have value("column") as it was before the program ran; functions sqrt, log (base 10), ln, random, sin, cos, tan, asin, acos, atan, len, range, abs; lists in brackets with [] access, append, extend, pop. Results that aren't
finite are -1 when written to a column. Programs with for or while run row by row in a pandas UDF instead (see loops()).
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOOP_LIMIT = 1 << 26

_TOKEN = re.compile(r"""\s*(?:(?P<float>\d+\.\d*(?:[eE][+-]?\d+)?|\.\d+|\d+[eE][+-]?\d+)|(?P<int>\d+)|(?P<text>"[^"]*"|'[^']*')|(?P<name>[A-Za-z_]\w*)|(?P<op>&&|\|\||>=|<=|==|!=|[-+*/%^()<>=!,.\[\]]))""")


class FormulaError(ValueError):
    pass


@dataclass(frozen=True)
class Node:
    kind: str
    value: object = None
    parts: tuple = ()


def tokens(line: str) -> list[tuple[str, str]]:
    out, at = [], 0
    line = line.rstrip()
    while at < len(line):
        m = _TOKEN.match(line, at)
        if not m:
            raise FormulaError(f"can't read {line[at:]!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return out


#: How tightly each infix operator binds.
BINDS = {"=": 1, "and": 2, "&&": 2, "or": 3, "||": 3, "is": 5, ">": 5, "<": 5, ">=": 5, "<=": 5, "==": 5, "!=": 5, "+": 6, "-": 6, "*": 7, "/": 7, "%": 7, "^": 8}
_NOT, _SIGN = 4, 7


class Parser:
    def __init__(self, items: list[tuple[str, str]]):
        self.items, self.at = items, 0

    def peek(self) -> str | None:
        return self.items[self.at][1] if self.at < len(self.items) and self.items[self.at][0] in ("op", "name") else None

    def take(self, want: str | None = None) -> tuple[str, str]:
        if self.at >= len(self.items):
            raise FormulaError("the line ends too early")
        got = self.items[self.at]
        if want and got[1] != want:
            raise FormulaError(f"{want!r} is missing before {got[1]!r}")
        self.at += 1
        return got

    def expression(self, least: int = 0) -> Node:
        left = self.prefix()
        while (op := self.peek()) in BINDS and BINDS[op] > least:
            self.take()
            power = BINDS[op]
            right = self.expression(power - (op in ("^", "=")))
            if op == "=" and left.kind != "name":
                raise FormulaError("only a name can be given a value")
            left = Node("set", left.value, (right,)) if op == "=" else Node("infix", {"&&": "and", "||": "or"}.get(op, op), (left, right))
        return left

    def prefix(self) -> Node:
        kind, text = self.take()
        if text in ("-", "+"):
            inner = self.expression(_SIGN)
            return Node("negate", None, (inner,)) if text == "-" else inner
        if text in ("not", "!"):
            return Node("not", None, (self.expression(_NOT),))
        if text == "(":
            node = self.expression()
            self.take(")")
        elif text == "[":
            node = Node("list", None, tuple(self.arguments("]")))
        elif kind == "int":
            node = Node("const", int(text))
        elif kind == "float":
            node = Node("const", float(text))
        elif kind == "text":
            node = Node("const", text[1:-1])
        elif kind == "name":
            node = Node("call", text, tuple(self.arguments(")"))) if self.peek() == "(" and self.take() else Node("name", text)
        else:
            raise FormulaError(f"{text!r} is out of place")
        while self.peek() in ("[", "."):
            if self.take()[1] == "[":
                node = Node("item", None, (node, self.expression()))
                self.take("]")
            else:
                _, name = self.take()
                self.take("(")
                node = Node("method", name, (node, *self.arguments(")")))
        return node

    def arguments(self, end: str) -> list[Node]:
        out: list[Node] = []
        while self.peek() != end:
            out.append(self.expression())
            if self.peek() == ",":
                self.take()
        self.take(end)
        return out


def parse_expression(text: str) -> Node:
    p = Parser(tokens(text))
    node = p.expression()
    if p.at != len(p.items):
        raise FormulaError(f"{p.items[p.at][1]!r} is out of place")
    return node


def parse(text: str) -> list[tuple]:
    """Statements: (kind, node, block)."""
    if "\t" in text:
        raise FormulaError("tabs aren't allowed")
    lines = [(len(x) - len(x.lstrip(" ")), x.strip(), i + 1) for i, x in enumerate(text.split("\n")) if x.split("#")[0].strip()]

    def block(at: int, indent: int) -> tuple[list[tuple], int]:
        out: list[tuple] = []
        while at < len(lines) and lines[at][0] >= indent:
            depth, line, number = lines[at]
            line = line.split("#")[0].rstrip()
            try:
                if depth > indent:
                    raise FormulaError("unexpected indentation")
                head = re.match(r"(if|elif|else|for|while|return)\b", line)
                word = head[1] if head else "expr"
                rest = line[len(word) :].strip().removesuffix(":") if head else line
                if word in ("if", "elif", "else", "for", "while"):
                    inner = lines[at + 1][0] if at + 1 < len(lines) else indent
                    if inner <= indent:
                        raise FormulaError("a block is missing")
                    body, nxt = block(at + 1, inner)
                    if word == "for":
                        m = re.match(r"(\w+)\s+in\s+(.*)$", rest)
                        if not m:
                            raise FormulaError("for needs a name and a list")
                        node = Node("for", m[1], (parse_expression(m[2]),))
                    else:
                        node = parse_expression(rest) if rest else None
                    out.append((word, node, body))
                    at = nxt
                else:
                    out.append((word, parse_expression(rest), None))
                    at += 1
            except FormulaError as e:
                raise e if str(e).startswith("line ") else FormulaError(f"line {number}: {e}") from None
        return out, at

    return block(0, lines[0][0] if lines else 0)[0]


@dataclass(frozen=True)
class Typed:
    """A Column with what is known of its type: int, float, bool, text, list, none."""

    col: Column
    kind: str


#: How a Compiler's names hold columns written by setvalue(), and the mark; no variable can be called so.
_SET, _MARK = "setvalue ", "mark "

_KINDS = {"tinyint": "int", "smallint": "int", "int": "int", "bigint": "int", "double": "float", "float": "float", "boolean": "bool", "string": "text"}


class Compiler:
    def __init__(self, kinds: dict[str, str], this: dict[str, Typed] | None = None):
        self.kinds, self.names = kinds, dict(this or {})

    def column(self, name: object) -> Typed:
        column = "ref" if name == "Ref Number" else name
        if column not in self.kinds:
            raise FormulaError(f"no column {column!r}")
        return self.names.get(f"{_SET}{column}") or Typed(F.col(f"`{column}`"), _KINDS.get(self.kinds[column], "float"))

    def neighbours(self, n: Node) -> Typed:
        held = _held(n)
        if held not in self.kinds:
            raise FormulaError("connections() needs the graph's edges")
        return Typed(F.col(f"`{held}`"), "nodes")

    def written(self) -> dict[str, Column]:
        """What setvalue() gives to columns."""
        return {k.removeprefix(_SET): v.col for k, v in self.names.items() if k.startswith(_SET)}

    def unset(self, name: str) -> Typed:
        """What a branch holds that doesn't set a name."""
        return self.column(name.removeprefix(_SET)) if name.startswith(_SET) else Typed(F.lit(None), "none")

    def number(self, x: Typed) -> Column:
        return x.col.cast("int") if x.kind == "bool" else x.col

    def truth(self, x: Typed) -> Column:
        return x.col if x.kind == "bool" else F.coalesce(x.col != 0, F.lit(False)) if x.kind in ("int", "float") else F.lit(x.kind != "none")

    def value(self, node: Node) -> Typed:
        return getattr(self, f"on_{node.kind}")(node)

    def on_const(self, n: Node) -> Typed:
        return Typed(F.lit(n.value), "int" if isinstance(n.value, int) else "float" if isinstance(n.value, float) else "text")

    def on_name(self, n: Node) -> Typed:
        fixed = {"e": Typed(F.lit(math.e), "float"), "pi": Typed(F.lit(math.pi), "float"), "true": Typed(F.lit(True), "bool"), "false": Typed(F.lit(False), "bool"), "none": Typed(F.lit(None), "none")}
        if n.value in self.names:
            return self.names[n.value]
        if n.value in fixed:
            return fixed[n.value]
        raise FormulaError(f"{n.value} has no value")

    def on_set(self, n: Node) -> Typed:
        self.names[n.value] = self.value(n.parts[0])
        return self.names[n.value]

    def on_negate(self, n: Node) -> Typed:
        x = self.value(n.parts[0])
        return Typed(-self.number(x), "float" if x.kind == "float" else "int")

    def on_not(self, n: Node) -> Typed:
        return Typed(~self.truth(self.value(n.parts[0])), "bool")

    def on_infix(self, n: Node) -> Typed:
        a, b = map(self.value, n.parts)
        op = n.value
        if op in ("and", "or"):
            x, y = self.truth(a), self.truth(b)
            return Typed(x & y if op == "and" else x | y, "bool")
        if op == "is":
            alike = a.kind == b.kind or {a.kind, b.kind} <= {"int", "float"}
            return Typed(a.col.eqNullSafe(b.col) if alike or "none" in (a.kind, b.kind) else F.lit(False), "bool")
        if op in (">", "<", ">=", "<=", "==", "!="):
            if a.kind != b.kind and not {a.kind, b.kind} <= {"int", "float", "bool"}:
                raise FormulaError(f"can't compare {a.kind} with {b.kind}")
            x, y = (a.col, b.col) if a.kind == b.kind else (self.number(a), self.number(b))
            return Typed({">": x > y, "<": x < y, ">=": x >= y, "<=": x <= y, "==": x == y, "!=": x != y}[op], "bool")
        if op == "+" and a.kind == b.kind == "text":
            return Typed(F.concat(a.col, b.col), "text")
        if not {a.kind, b.kind} <= {"int", "float", "bool"}:
            raise FormulaError(f"{op} isn't defined for {a.kind} and {b.kind}")
        x, y = self.number(a), self.number(b)
        whole = "float" not in (a.kind, b.kind)
        if op == "^":
            p = F.pow(x.cast("double"), y.cast("double"))
            return Typed(p.cast("long") if whole else p, "int" if whole else "float")
        if op == "/":
            if whole:
                return Typed(F.call_function("div", x.cast("long"), F.when(y == 0, F.raise_error(F.lit("division by zero")).cast("long")).otherwise(y.cast("long"))), "int")
            # as floating point does: 1 / 0 is infinite, and becomes -1 when it is written
            zero = F.when(x == 0, F.lit(float("nan"))).otherwise(F.signum(x.cast("double")) * float("inf"))
            return Typed(F.coalesce(F.try_divide(x.cast("double"), y.cast("double")), F.when(x.isNotNull() & y.isNotNull(), zero)), "float")
        if op == "%":
            return Typed(F.try_mod(x, y), "int" if whole else "float")
        return Typed({"+": x + y, "-": x - y, "*": x * y}[op], "int" if whole else "float")

    def on_list(self, n: Node) -> Typed:
        return Typed(F.array(*[self.value(p).col for p in n.parts]), "list")

    def on_item(self, n: Node) -> Typed:
        x, i = map(self.value, n.parts)
        if x.kind == "nodes":
            return Typed(F.try_element_at(x.col, F.when(i.col >= 0, i.col + 1).otherwise(i.col).cast("int")), "node")
        if x.kind != "list":
            raise FormulaError("only lists have items")
        return Typed(F.element_at(x.col, F.when(i.col >= 0, i.col + 1).otherwise(i.col).cast("int")), "float")

    def on_method(self, n: Node) -> Typed:
        x, args = self.value(n.parts[0]), [self.value(p) for p in n.parts[1:]]
        if n.value == "value" and x.kind == "node":
            column = _read(n)
            return Typed(x.col[column], _KINDS.get(self.kinds[column], "float"))
        if x.kind != "list":
            raise FormulaError(f"{n.value} isn't defined for {x.kind}")
        if n.value == "append":
            out = Typed(F.array_append(x.col, args[0].col), "list")
        elif n.value == "extend":
            out = Typed(F.concat(x.col, args[0].col), "list")
        elif n.value == "clear":
            out = Typed(F.slice(x.col, 1, 0), "list")
        elif n.value == "pop":
            got = Typed(F.element_at(x.col, -1), "float")
            if n.parts[0].kind == "name":
                self.names[n.parts[0].value] = Typed(F.slice(x.col, F.lit(1), F.greatest(F.size(x.col) - 1, F.lit(0))), "list")
            return got
        else:
            raise FormulaError(f"{n.value} isn't known")
        if n.parts[0].kind == "name":
            self.names[n.parts[0].value] = out
        return out

    def on_call(self, n: Node) -> Typed:
        name = n.value
        if name == "value":
            if len(n.parts) != 1 or n.parts[0].kind != "const":
                raise FormulaError("value() takes a column's name")
            return self.column(n.parts[0].value)
        if name == "setvalue":
            target = _target(n)
            self.column(target)
            got = self.value(n.parts[1])
            if got.kind not in ("int", "float", "bool"):
                raise FormulaError(f"setvalue() takes a number, not {got.kind}")
            self.names[f"{_SET}{target}"] = Typed(self.number(got).cast("double"), "float")
            return Typed(F.lit(None), "none")
        if name == "connections":
            return self.neighbours(n)
        if name in ("mark", "setmark"):
            if len(n.parts) != (name == "setmark"):
                raise FormulaError(f"{name}() takes {'a value' if name == 'setmark' else 'nothing'}")
            if name == "mark":
                return self.names.get(_MARK) or self.unset(_MARK)
            self.names[_MARK] = self.value(n.parts[0])
            return Typed(F.lit(None), "none")
        args = [self.value(p) for p in n.parts]
        real = {"sqrt": F.sqrt, "log": F.log10, "ln": F.ln, "sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": F.asin, "acos": F.acos, "atan": F.atan}
        if name in real:
            return Typed(real[name](self.number(args[0]).cast("double")), "float")
        if name == "abs":
            return Typed(F.abs(self.number(args[0])), args[0].kind)
        if name == "random":
            return Typed(F.rand(*[p.value for p in n.parts[:1] if p.kind == "const"]) * (args[0].col if args else F.lit(1.0)), "float")
        if name == "len":
            return Typed(F.length(args[0].col) if args[0].kind == "text" else F.size(args[0].col), "int")
        if name == "range":
            a, b = (Typed(F.lit(0), "int"), args[0]) if len(args) == 1 else args[:2]
            step = args[2].col if len(args) > 2 else F.lit(1)
            if len(n.parts) > 2 and n.parts[2].kind == "const" and n.parts[2].value == 0:
                raise FormulaError("range() by 0")
            last = b.col - F.signum(step.cast("double")).cast("int")
            empty = F.when(step > 0, b.col <= a.col).otherwise(b.col >= a.col)
            return Typed(F.when(empty, F.array().cast("array<int>")).otherwise(F.sequence(a.col, last, step)), "list")
        raise FormulaError(f"{name}() isn't known")

    def run(self, statements: list[tuple]) -> Typed | None:
        """The value that statements give; branches become `when`, and what variables hold after them depends on the condition, too."""
        result = None
        at = 0
        while at < len(statements):
            kind, node, body = statements[at]
            if kind == "return":
                return self.value(node)
            if kind == "expr":
                result = self.value(node)
                at += 1
                continue
            if kind != "if":
                raise FormulaError(f"{kind} can't be compiled" if kind in ("for", "while") else f"{kind} without if")
            arms = [(self.truth(self.value(node)), body)]
            at += 1
            other = None
            while at < len(statements) and statements[at][0] in ("elif", "else"):
                if statements[at][0] == "else":
                    other = statements[at][2]
                    at += 1
                    break
                arms.append((self.truth(self.value(statements[at][1])), statements[at][2]))
                at += 1
            before, after = dict(self.names), []
            leaves = any(_returns(b) for _, b in arms) or (other is not None and _returns(other))
            rest = statements[at:]
            for condition, b in [*arms, (None, other or [])]:
                self.names = dict(before)
                got = self.run([*b, *rest]) if leaves and not (b and b[-1][0] == "return") else self.run(b)
                after.append((condition, got if got is not None else result, self.names))
            self.names = before
            for name in {k for _, _, n in after for k in n}:
                held = [(c, n.get(name)) for c, _, n in after]
                self.names[name] = _choose([(c, v or self.unset(name)) for c, v in held])
            result = _choose([(c, v or Typed(F.lit(None), "none")) for c, v, _ in after])
            if leaves:
                return result
        return result


def _returns(block: list[tuple]) -> bool:
    return any(k == "return" or (b and _returns(b)) for k, _, b in block)


def _choose(arms: list[tuple[Column | None, Typed]]) -> Typed:
    out = None
    for condition, v in arms[:-1]:
        out = F.when(condition, v.col) if out is None else out.when(condition, v.col)
    kinds = {v.kind for _, v in arms} - {"none"}
    return Typed(out.otherwise(arms[-1][1].col), "float" if "float" in kinds else next(iter(kinds), "none"))


def _loops(block: list[tuple]) -> bool:
    return any(k in ("for", "while") or (b and _loops(b)) for k, _, b in block)


def _calls(x, name: str, kind: str = "call") -> list[Node]:
    """The calls of a function (or a method) in a program, in order."""
    if isinstance(x, Node):
        return ([x] if x.kind == kind and x.value == name else []) + _calls(x.parts, name, kind)
    return [c for p in x for c in _calls(p, name, kind)] if isinstance(x, (list, tuple)) else []


def _part(call: Node) -> object:
    """What a connections() asks for: None (all), a side or a bin."""
    if len(call.parts) > 1 or (call.parts and call.parts[0].kind != "const"):
        raise FormulaError("connections() takes nothing, a side or a bin")
    part = call.parts[0].value if call.parts else None
    if part not in (None, "all", "forward", "back") and not (isinstance(part, int) and 0 <= part < 32):
        raise FormulaError('connections() takes nothing, "all", "forward", "back" or a bin from 0 to 31')
    return None if part == "all" else part


def _held(call: Node) -> str:
    """The column that holds the rows of a connections() while a program runs."""
    part = _part(call)
    return f"connections() {'all' if part is None else part}"


def _read(method: Node) -> str:
    """The column that a neighbour's value() reads."""
    if len(method.parts) != 2 or method.parts[1].kind != "const" or not isinstance(method.parts[1].value, str):
        raise FormulaError("value() takes a column's name")
    return "ref" if method.parts[1].value == "Ref Number" else method.parts[1].value


def connect(df: DataFrame, edges: DataFrame, text: str) -> tuple[DataFrame, list[str]]:
    """df (ref, ...) with a list column for each kind of connections() that a program calls, and those columns' names. Lists hold what the program reads of a
    row's neighbours, in order of their refs; edges: src, dst, and `side` (fwd, back, as segments' edges have) or `bin` if the program asks for these."""
    statements = parse(text)
    columns = sorted({_read(m) for m in _calls(statements, "value", "method")} - {"ref"})
    for c in columns:
        if c not in df.columns:
            raise FormulaError(f"no column {c!r}")
    asked = {_held(c): _part(c) for c in _calls(statements, "connections")}
    neighbour = df.select(F.col("ref").alias("_dst"), F.struct("ref", *[F.col(f"`{c}`") for c in columns]).alias("_n"))
    out = df
    for held, part in asked.items():
        if held in df.columns:
            raise FormulaError(f"a column is called {held!r}")
        e = edges if part is None else edges.filter(F.col("bin" if isinstance(part, int) else "side") == {"forward": "fwd"}.get(part, part))
        lists = e.select(F.col("src").alias("_src"), F.col("dst").alias("_dst")).join(neighbour, "_dst").groupBy("_src").agg(F.sort_array(F.collect_list("_n")).alias(held))
        out = out.join(lists, out["ref"] == lists["_src"], "left").drop("_src")
        out = out.withColumn(held, F.coalesce(F.col(f"`{held}`"), F.array().cast(lists.schema[held].dataType)))
    return out, list(asked)


def _target(call: Node) -> str:
    """The column that a setvalue() writes."""
    if len(call.parts) != 2 or call.parts[0].kind != "const" or not isinstance(call.parts[0].value, str):
        raise FormulaError("setvalue() takes a column's name and a value")
    if call.parts[0].value in ("Ref Number", "ref"):
        raise FormulaError("the reference number can't be changed")
    return call.parts[0].value


def compile_formula(df: DataFrame, text: str) -> Column:
    """The formula's value for each row of df."""
    statements = parse(text)
    if _loops(statements):
        got = loops(df, statements)
        return got["value"] if _calls(statements, "setvalue") else got
    got = Compiler(dict(df.dtypes)).run(statements)
    if got is None:
        raise FormulaError("the formula has no value")
    return got.col.cast("double") if got.kind in ("bool", "int") else got.col


def execute(df: DataFrame, text: str, selected: Column | None = None, edges: DataFrame | None = None) -> DataFrame:
    """df with what the program's setvalue() calls write to the columns of a row, of selected rows only if a selection is given. edges: see connect().

    The program sees what it has written before; its value is lost. A mark (setmark, mark) holds a value within one row's run and is none at its start.
    """
    statements = parse(text)
    targets = sorted({_target(c) for c in _calls(statements, "setvalue")})
    if not targets:
        return df
    if edges is not None:
        wide, lists = connect(df, edges, text)
        return execute(wide, text, selected).drop(*lists)
    work, held = df, None
    if _loops(statements):
        held = next(k for k in (f"_program{i}" for i in range(len(df.columns) + 1)) if k not in df.columns)
        work = df.withColumn(held, loops(df, statements))
        new = {c: F.col(held)[f"w{k}"] for k, c in enumerate(targets)}
    else:
        compiler = Compiler(dict(df.dtypes))
        compiler.run(statements)
        new = compiler.written()
    if selected is not None:
        new = {c: F.when(selected, v).otherwise(F.col(f"`{c}`")) for c, v in new.items()}
    work = work.withColumns(new)
    return work.drop(held) if held else work


def update(df: DataFrame, column: str, text: str, selected: Column | None = None, edges: DataFrame | None = None) -> DataFrame:
    """column by formula, of selected rows only if a selection is given; what isn't finite becomes -1. Columns that setvalue() writes change, too (see execute).
    edges: the graph whose neighbours connections() lists (see connect)."""
    if edges is not None:
        wide, lists = connect(df, edges, text)
        return update(wide, column, text, selected).drop(*lists)
    if _calls(parse(text), "setvalue"):
        taken = {*df.columns, column}
        result, chosen = (next(k for k in (f"_{w}{i}" for i in range(len(taken) + 1)) if k not in taken) for w in ("result", "chosen"))
        kept = df.withColumns({result: compile_formula(df, text).cast("double"), chosen: F.lit(True) if selected is None else selected})
        done = execute(kept, text, F.col(chosen))
        return update(done, column, f'value("{result}")', F.col(chosen)).drop(result, chosen)
    got = compile_formula(df, text).cast("double")
    got = F.when(F.isnan(got) | got.isNull() | (F.abs(got) == float("inf")), -1.0).otherwise(got)
    if selected is not None:
        old = F.col(f"`{column}`") if column in df.columns else F.lit(-1.0)
        got = F.when(selected, got).otherwise(old)
    return df.withColumn(column, got)


def select(df: DataFrame, text: str, edges: DataFrame | None = None) -> DataFrame:
    """The rows whose formula is true. edges: see connect()."""
    if edges is not None:
        wide, lists = connect(df, edges, text)
        return select(wide, text).drop(*lists)
    got = Compiler(dict(df.dtypes))
    value = got.run(parse(text))
    if value is None:
        raise FormulaError("the formula has no value")
    return df.filter(got.truth(value))


def neighbour_lists(df: DataFrame, edges: DataFrame, columns: list[str], side: str | None = None) -> DataFrame:
    """df with a list column connections_<name> of each column's values over a row's neighbours, in order of their refs. side: only edges with that value in `side`."""
    e = edges if side is None else edges.filter(F.col("side") == side)
    values = df.select(F.col("ref").alias("dst"), *columns)
    got = e.select("src", "dst").join(values, "dst").groupBy(F.col("src").alias("ref")).agg(F.sort_array(F.collect_list(F.struct("dst", *columns))).alias("_n"))
    out = df.join(got, "ref", "left")
    for c in columns:
        out = out.withColumn(f"connections_{c}", F.coalesce(F.col(f"_n.{c}"), F.array().cast(f"array<{dict(df.dtypes)[c]}>")))
    return out.drop("_n")


class _Return(Exception):
    def __init__(self, value):
        self.value = value


class Interpreter:
    """Runs a program for one row, for what a Column can't express: loops and lists that change."""

    def __init__(self, row: dict):
        self.row, self.names = row, {"e": math.e, "pi": math.pi, "true": True, "false": False, "none": None}
        self.turns, self.mark = 0, None

    def block(self, statements: list[tuple]):
        result, taken = None, False
        for kind, node, body in statements:
            if kind == "expr":
                result = self.value(node)
            elif kind == "return":
                raise _Return(self.value(node))
            elif kind == "for":
                for self.names[node.value] in list(self.value(node.parts[0])):
                    result = self.block(body)
            elif kind == "while":
                while self.value(node):
                    self.turns += 1
                    if self.turns > LOOP_LIMIT:
                        raise FormulaError("a loop runs too long")
                    result = self.block(body)
            elif kind == "if":
                taken = bool(self.value(node))
                result = self.block(body) if taken else result
            elif not taken and (kind == "else" or self.value(node)):
                taken = True
                result = self.block(body)
        return result

    def value(self, n: Node):
        if n.kind == "const":
            return n.value
        if n.kind == "name":
            if n.value not in self.names:
                raise FormulaError(f"{n.value} has no value")
            return self.names[n.value]
        if n.kind == "set":
            self.names[n.value] = self.value(n.parts[0])
            return self.names[n.value]
        if n.kind == "infix" and n.value in ("and", "or"):
            a = self.value(n.parts[0])
            return (a and self.value(n.parts[1])) if n.value == "and" else (a or self.value(n.parts[1]))
        if n.kind == "list":
            return [self.value(p) for p in n.parts]
        p = [self.value(x) for x in n.parts]
        if n.kind == "negate":
            return -p[0]
        if n.kind == "not":
            return not p[0]
        if n.kind == "item":
            return p[0][p[1]]
        if n.kind == "method":
            return {"append": lambda x, v: x.append(v) or x, "extend": lambda x, v: x.extend(v) or x, "pop": lambda x, i=-1: x.pop(i), "clear": lambda x: x.clear() or x, "value": lambda x, _: x[_read(n)]}[n.value](*p)
        if n.kind == "infix":
            return self.infix(n.value, *p)
        calls: dict[str, Callable] = {"sqrt": math.sqrt, "log": math.log10, "ln": math.log, "sin": math.sin, "cos": math.cos, "tan": math.tan, "asin": math.asin, "acos": math.acos, "atan": math.atan, "abs": abs, "len": len, "range": lambda *a: list(range(*a)), "value": lambda c: self.row["ref" if c == "Ref Number" else c], "connections": lambda *_: list(self.row[_held(n)]), "setvalue": self.set_value, "mark": lambda: self.mark, "setmark": self.set_mark}
        if n.value not in calls:
            raise FormulaError(f"{n.value}() isn't known")
        try:
            return calls[n.value](*p)
        except ValueError:
            return float("nan")

    def set_value(self, column: str, value) -> None:
        if not isinstance(value, (int, float)):
            raise FormulaError("setvalue() takes a number")
        self.row[column] = float(value)

    def set_mark(self, value) -> None:
        self.mark = value

    @staticmethod
    def infix(op: str, a, b):
        whole = isinstance(a, int) and isinstance(b, int)
        if op == "/":
            return int(a / b) if whole else a / b if b else math.copysign(math.inf, a) if a else math.nan
        if op == "%":
            return int(math.fmod(a, b)) if whole else math.fmod(a, b)
        return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "^": lambda: a**b, ">": lambda: a > b, "<": lambda: a < b, ">=": lambda: a >= b, "<=": lambda: a <= b, "==": lambda: a == b, "!=": lambda: a != b, "is": lambda: a is b or a == b}[op]()


def loops(df: DataFrame, statements: list[tuple]) -> Column:
    """A program with loops, as a pandas UDF over the columns it reads: its value; a struct of value and w0, w1 ... if setvalue() writes columns (in order of their names)."""
    targets = sorted({_target(c) for c in _calls(statements, "setvalue")})
    names = {"ref" if c.parts[0].value == "Ref Number" else c.parts[0].value for c in _calls(statements, "value")}
    lists = sorted({_held(c) for c in _calls(statements, "connections")})
    if not set(lists) <= set(df.columns):
        raise FormulaError("connections() needs the graph's edges")
    used = [*sorted(names.union(targets)), *lists] or ["ref"]
    for c in used:
        if c not in df.columns:
            raise FormulaError(f"no column {c!r}")

    def results(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in frame.to_dict("records"):
            run = Interpreter(row)
            try:
                got = run.block(statements)
            except _Return as r:
                got = r.value
            out.append([float(got) if isinstance(got, (int, float)) else float("nan"), *(run.row[c] for c in targets)])
        return pd.DataFrame(out, columns=["value", *(f"w{k}" for k in range(len(targets)))], dtype=float)

    if targets:

        @F.pandas_udf(", ".join(["value double", *(f"w{k} double" for k in range(len(targets)))]))
        def run(frame: pd.DataFrame) -> pd.DataFrame:
            return results(frame)

    else:

        @F.pandas_udf("double")
        def run(frame: pd.DataFrame) -> pd.Series:
            return results(frame)["value"]

    return run(F.struct(*[F.col(f"`{c}`").alias(c) for c in used]))
