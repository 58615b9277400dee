"""Factor formulas: cleaning, checking, and turning them into Spark columns.

Formula text is untrusted, so it never reaches ``expr``. Python's own expression grammar reads it
and only a short list of node types is accepted.
"""

from __future__ import annotations

import ast
import math
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Call patterns that are refused, and operator look-alikes.
FORBIDDEN_CALLS = (".shift(", ".rolling(", ".mean(", ".std(", ".sum(", ".max(", ".min(")
LOOKALIKES = {"×": "*", "÷": "/", "−": "-", "≥": ">=", "≤": "<="}

POLARITY_SUFFIX = "_polarity"
#: Levels of nesting a formula may have; a chain of terms nests once a term.
MAX_DEPTH = 200


class FormulaError(ValueError):
    """The formula is not one this language accepts."""


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_formula(text: Column | str) -> Column:
    """Drop a leading ``Name =``, surrounding quotes and separators; map operator look-alikes."""
    out = F.regexp_replace(_col(text), r"^\s*\w+\s*=(?!=)", "")
    out = F.btrim(F.btrim(out), F.lit('",;'))
    for seen, meant in LOOKALIKES.items():
        out = F.replace(out, F.lit(seen), F.lit(meant))
    return F.btrim(out)


def forbidden_call(text: Column | str) -> Column:
    """The first refused call in the text, else NULL."""
    text = _col(text)
    return F.coalesce(*[F.when(F.contains(text, F.lit(call)), F.lit(call)) for call in FORBIDDEN_CALLS])


def formula_problem(text: Column | str, columns: Iterable[str], partners: Column | None = None) -> Column:
    """Why a cleaned formula is refused, else NULL.

    ``columns`` are the feature names. ``partners`` is an array column with the codes whose
    ``<code>_polarity`` the row may use; without it every polarity name is accepted. Polarity names
    are read in any case.
    """
    text = _col(text)
    reading = _reading(text)
    unknown = F.array_except(reading["names"], F.array(*[F.lit(c) for c in columns]).cast("array<string>"))
    if partners is None:
        unknown = F.filter(unknown, lambda n: ~F.lower(n).endswith(POLARITY_SUFFIX))
    else:
        allowed = F.transform(partners, lambda c: F.concat(F.lower(c), F.lit(POLARITY_SUFFIX)))
        unknown = F.filter(unknown, lambda n: ~F.array_contains(allowed, F.lower(n)))
    opened = F.length(text) - F.length(F.replace(text, F.lit("("), F.lit("")))
    closed = F.length(text) - F.length(F.replace(text, F.lit(")"), F.lit("")))
    return (
        F.when(text.isNull() | (text == ""), "empty")
        .when(forbidden_call(text).isNotNull(), F.concat(F.lit("forbidden call "), forbidden_call(text)))
        .when(F.size(unknown) > 0, F.concat(F.lit("unknown name "), F.array_join(F.array_sort(unknown), ", ")))
        .when(opened != closed, "unbalanced brackets")
        .otherwise(reading["problem"])
    )


@F.pandas_udf(T.StructType([T.StructField("names", T.ArrayType(T.StringType())), T.StructField("problem", T.StringType())]))
def _reading(texts: pd.Series) -> pd.DataFrame:
    """Names and grammar problem of each of the few distinct formulas of a catalogue."""
    return pd.DataFrame([(_names(text or ""), _problem(text or "")) for text in texts], columns=["names", "problem"])


def _names(text: str) -> list[str]:
    """Names that a readable formula looks up: all but those of its calls."""
    try:
        nodes = list(ast.walk(_tree(text)))
    except FormulaError:
        return []
    called = {id(n.func) for n in nodes if isinstance(n, ast.Call)}
    return sorted({n.id for n in nodes if isinstance(n, ast.Name) and id(n) not in called})


def _problem(text: str) -> str | None:
    try:
        parse(text)
    except FormulaError as error:
        return str(error)
    return None


def _tree(text: str) -> ast.expr:
    try:
        return ast.parse(text.strip(), mode="eval").body
    except (SyntaxError, ValueError, RecursionError, MemoryError) as error:
        raise FormulaError("syntax error") from error


def _too_deep(tree: ast.expr) -> bool:
    level = [tree]
    for _ in range(MAX_DEPTH):
        level = [child for node in level for child in ast.iter_child_nodes(node) if isinstance(child, ast.expr)]
        if not level:
            return False
    return True


def _is_finite(value: float) -> bool:
    try:
        return math.isfinite(float(value))
    except OverflowError:
        return False


def parse(text: str) -> ast.expr:
    """The expression tree, with only numbers, names, + - * /, comparisons and four functions."""
    tree = _tree(text)
    if _too_deep(tree):
        raise FormulaError("nested too deeply")
    for node in ast.walk(tree):
        if isinstance(node, ast.Constant) and type(node.value) not in (int, float):
            raise FormulaError("only numbers are allowed")
        if isinstance(node, ast.Constant) and not _is_finite(node.value):
            raise FormulaError("number too large")
        if isinstance(node, ast.Call) and not (
            isinstance(node.func, ast.Name) and node.func.id in _CALLS and len(node.args) == 1 and not node.keywords
        ):
            raise FormulaError("call not allowed")
        if isinstance(node, ast.Compare) and len(node.ops) != 1:
            raise FormulaError("chained comparison")
        if not isinstance(node, _ALLOWED):
            raise FormulaError(f"{type(node).__name__} not allowed")
    return tree


_ALLOWED = (
    ast.BinOp, ast.UnaryOp, ast.Compare, ast.Call, ast.Name, ast.Load, ast.Constant,
    ast.Add, ast.Sub, ast.Mult, ast.Div, ast.UAdd, ast.USub, ast.Gt, ast.GtE, ast.Lt, ast.LtE,
)
_CALLS = {
    "abs": F.abs,
    "log": lambda c: F.when(c > 0, F.log(c)),
    "sqrt": lambda c: F.when(c >= 0, F.sqrt(c)),
    "exp": F.exp,
}


def formula_column(text: str, lookup: Callable[[str], Column] | None = None) -> Column:
    """The formula as a double column. Division by zero and other undefined values give NULL."""
    find = lookup or (lambda n: F.col(n).cast("double"))

    def walk(n: ast.expr) -> Column:
        if isinstance(n, ast.Name):
            return find(n.id)
        if isinstance(n, ast.Constant):
            return F.lit(float(n.value))
        if isinstance(n, ast.UnaryOp):
            value = walk(n.operand)
            return -value if isinstance(n.op, ast.USub) else value
        if isinstance(n, ast.Call):
            return _CALLS[n.func.id](walk(n.args[0]))
        if isinstance(n, ast.Compare):
            left, right, op = walk(n.left), walk(n.comparators[0]), n.ops[0]
            if isinstance(op, ast.Gt):
                holds = left > right
            elif isinstance(op, ast.GtE):
                holds = left >= right
            else:
                holds = left < right if isinstance(op, ast.Lt) else left <= right
            return holds.cast("int").cast("double")
        left, right = walk(n.left), walk(n.right)
        if isinstance(n.op, ast.Add):
            return left + right
        if isinstance(n.op, ast.Sub):
            return left - right
        return left * right if isinstance(n.op, ast.Mult) else F.try_divide(left, right)

    return walk(parse(text)).cast("double")
