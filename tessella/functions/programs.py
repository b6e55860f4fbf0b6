"""Stack programs as Columns: what checks and triggers are made of.

A program is a list of instructions, each a name or a pair of a name and an operand. Conditions are two-valued. Division by zero raises.
Reads see the original row, also after a write.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .digests import hmac256, sha256
from .predicates import like_plain, pad_trim, truthy, two_valued


class Compiled:
    """A program's result: the column on top of the stack, the fields it sets, and when it rejects a row."""

    def __init__(self, top: Column | None, sets: dict[str, Column], rejects: Column | None):
        self.top, self.sets, self.rejects = top, sets, rejects


def compile_program(program: list, df: DataFrame) -> Compiled:
    """Compile a program against the fields of df."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    stack: list[tuple[Column, str]] = []
    sets: dict[str, Column] = {}
    rejects: Column | None = None

    def two() -> tuple[tuple[Column, str], tuple[Column, str]]:
        right = stack.pop()
        return stack.pop(), right

    for step in program:
        name, operand = step if isinstance(step, tuple) else (step, None)
        if name == "push":
            kind = {bool: "boolean", int: "bigint", bytes: "binary"}.get(type(operand), "string")
            stack.append((F.lit(operand), kind))
        elif name == "load":
            stack.append((F.col(f"`{operand}`"), kinds[operand]))
        elif name == "is_null":
            stack.append((stack.pop()[0].isNull(), "boolean"))
        elif name in ("eq", "ne", "lt", "le", "gt", "ge"):
            (a, ka), (b, kb) = two()
            if "string" in (ka, kb):
                a, b = pad_trim(a), pad_trim(b)
            leaf = {"eq": a == b, "ne": a != b, "lt": a < b, "le": a <= b, "gt": a > b, "ge": a >= b}[name]
            stack.append((two_valued(leaf), "boolean"))
        elif name in ("add", "sub", "mul", "div", "mod"):
            (a, _), (b, _) = two()
            out = {"add": lambda: a + b, "sub": lambda: a - b, "mul": lambda: a * b, "div": lambda: int_div(a, b), "mod": lambda: a % b}[name]()
            stack.append((out, "bigint"))
        elif name in ("and", "or"):
            (a, _), (b, _) = two()
            stack.append(((truthy(a) & truthy(b)) if name == "and" else (truthy(a) | truthy(b)), "boolean"))
        elif name == "not":
            stack.append((~truthy(stack.pop()[0]), "boolean"))
        elif name == "like":
            stack.append((two_valued(like_plain(pad_trim(stack.pop()[0]), operand)), "boolean"))
        elif name == "sha256":
            x, kind = stack.pop()
            stack.append((sha256(x, kind), "binary"))
        elif name == "hmac256":
            (m, km), (k, kk) = two()  # the key is on top
            stack.append((hmac256(k, m, kk, km), "binary"))
        elif name == "set":
            sets[operand] = stack.pop()[0].cast(kinds[operand])
        elif name == "reject":
            when = truthy(stack.pop()[0])
            rejects = when if rejects is None else rejects | when
        else:
            raise ValueError(f"no instruction {name!r}")
    return Compiled(stack[-1][0] if stack else None, sets, rejects)


def int_div(a: Column, b: Column) -> Column:
    """Integer division towards zero; by zero it raises."""
    return F.call_function("div", a, b)


def run_trigger(df: DataFrame, program: list) -> DataFrame:
    """Rows after a before-write program: rejected rows go, set fields change."""
    done = compile_program(program, df)
    if done.rejects is not None:
        df = df.where(~done.rejects)
    return df.select(*[done.sets.get(c, F.col(f"`{c}`")).alias(c) for c in df.columns])
