"""Row conditions in Python's expression syntax, as data frames evaluate them, compiled to columns.

Python itself reads the text; ``&`` and ``|`` bind as loosely as ``and`` and ``or``. A comparison with a missing value
is false, but ``!=`` is true. A text never equals a number. Division by zero is infinite, and ``//`` and ``%`` round
towards minus infinity. What has no column form is named in an error while the plan is made.
"""

import ast
import io
import re
import tokenize
from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.errors import ColumnNotFoundError
from tallyframe.functions.columns import INTEGRAL, MOMENTS, is_numeric, value_of

# Functions an expression may call, by their names there.
CALLS = {
    "sin": F.sin, "cos": F.cos, "tan": F.tan, "arcsin": F.asin, "arccos": F.acos, "arctan": F.atan, "sinh": F.sinh,
    "cosh": F.cosh, "tanh": F.tanh, "arcsinh": F.asinh, "arccosh": F.acosh, "arctanh": F.atanh, "exp": F.exp,
    "expm1": F.expm1, "log": F.log, "log10": F.log10, "log1p": F.log1p, "sqrt": F.sqrt, "abs": F.abs, "floor": F.floor,
    "ceil": F.ceil,
}
ORDER = {ast.Lt: "__lt__", ast.LtE: "__le__", ast.Gt: "__gt__", ast.GtE: "__ge__"}


def _read(text):
    """The syntax tree, and column names by the placeholders their quoted forms got."""
    quoted = {}

    def placeholder(match):
        quoted[f"quoted_name_{len(quoted)}_"] = match[1]
        return list(quoted)[-1]

    plain = re.sub(r"`([^`]+)`", placeholder, text).strip()
    words = {"&": "and", "|": "or"}
    try:
        tokens = [
            (token.type, f" {words[token.string]} " if token.type == tokenize.OP and token.string in words else token.string)
            for token in tokenize.generate_tokens(io.StringIO(plain).readline)
        ]
        return ast.parse(tokenize.untokenize(tokens).strip(), mode="eval").body, quoted
    except (SyntaxError, tokenize.TokenError, IndentationError) as error:
        raise ValueError(f"The expression {text!r} cannot be read: {error}") from error


class _Compiler:
    def __init__(self, df, text):
        self.df, self.text = df, text
        self.tree, self.quoted = _read(text)

    def fail(self, node, why):
        shown = ast.unparse(node)
        for placeholder, name in self.quoted.items():
            shown = shown.replace(placeholder, f"`{name}`")
        raise ValueError(f"{shown!r} in the expression {self.text!r} {why}")

    def kind(self, column):
        """``text``, ``number``, ``truth``, ``moment`` or ``other``."""
        dtype = self.df.select(column.alias("c")).schema["c"].dataType
        if isinstance(dtype, T.BooleanType):
            return "truth"
        if isinstance(dtype, MOMENTS):
            return "moment"
        return "number" if is_numeric(dtype) else "text" if isinstance(dtype, T.StringType) else "other"

    def whole(self, *columns):
        types = [self.df.select(c.alias("c")).schema["c"].dataType for c in columns]
        return all(isinstance(t, INTEGRAL) for t in types)

    def compile(self, node):
        visit = getattr(self, f"on_{type(node).__name__.lower()}", None)
        if visit is None:
            self.fail(node, "has no column form")
        return visit(node)

    def truth(self, node):
        column = self.compile(node)
        if self.kind(column) != "truth":
            self.fail(node, "is no condition")
        return F.coalesce(column, F.lit(False))

    def on_name(self, node):
        name = self.quoted.get(node.id, node.id)
        if name not in self.df.columns:
            raise ColumnNotFoundError(f"Column {name!r} of the expression {self.text!r} not found; available: {self.df.columns}")
        return value_of(self.df, name)

    def on_constant(self, node):
        if node.value is not None and not isinstance(node.value, (bool, int, float, str)):
            self.fail(node, "has no column form")
        return F.lit(node.value)

    def on_boolop(self, node):
        parts = [self.truth(value) for value in node.values]
        return reduce(lambda a, b: a & b if isinstance(node.op, ast.And) else a | b, parts)

    def on_unaryop(self, node):
        if isinstance(node.op, (ast.Not, ast.Invert)):
            return ~self.truth(node.operand)
        value = self.number(node.operand)
        return -value if isinstance(node.op, ast.USub) else value

    def number(self, node):
        column = self.compile(node)
        if self.kind(column) not in ("number", "truth"):
            self.fail(node, "is no number")
        return column.cast("long") if self.kind(column) == "truth" else column

    def on_binop(self, node):
        if isinstance(node.op, ast.Add):
            sides = [self.compile(n) for n in (node.left, node.right)]
            if all(self.kind(s) == "text" for s in sides):
                return F.concat(*sides)
        a, b = self.number(node.left), self.number(node.right)
        plain = {ast.Add: F.try_add, ast.Sub: F.try_subtract, ast.Mult: F.try_multiply}
        if type(node.op) in plain:
            return plain[type(node.op)](a, b)
        if isinstance(node.op, ast.Pow):
            return F.pow(a, b)
        if not isinstance(node.op, (ast.Div, ast.FloorDiv, ast.Mod)):
            self.fail(node, "has no column form")
        exact = self.whole(a, b) and not isinstance(node.op, ast.Div)
        if exact:
            # Whole numbers stay whole; what they leave by zero is missing.
            rest = self.rest(a, b)
            if isinstance(node.op, ast.Mod):
                return rest
            return F.try_divide(F.try_subtract(a, rest).cast("decimal(19,0)"), b.cast("decimal(19,0)")).cast("long")
        a, b = a.cast("double"), b.cast("double")
        endless = F.when(a > 0, float("inf")).when(a < 0, float("-inf"))
        ratio = F.when(b == 0, endless).otherwise(F.try_divide(a, b))
        if isinstance(node.op, ast.Div):
            return ratio
        if isinstance(node.op, ast.FloorDiv):
            return F.when(b == 0, endless).otherwise(F.rint(F.try_divide(a - self.rest(a, b), b)))
        return self.rest(a, b)

    def rest(self, a, b):
        """The remainder with the sign of the divisor."""
        rest = F.try_mod(a, b)
        return F.when((rest != 0) & ((rest < 0) != (b < 0)), rest + b).otherwise(rest)

    def on_call(self, node):
        name = node.func.id if isinstance(node.func, ast.Name) else None
        if name not in CALLS or len(node.args) != 1 or node.keywords:
            self.fail(node, "calls what has no column form")
        value = self.number(node.args[0])
        return CALLS[name](value if name == "abs" else value.cast("double"))

    def on_compare(self, node):
        sides = [node.left, *node.comparators]
        return reduce(lambda a, b: a & b, (self.pair(node, op, *pair) for op, *pair in zip(node.ops, sides, sides[1:])))

    def pair(self, node, op, left, right):
        listed = [isinstance(side, (ast.List, ast.Tuple)) for side in (left, right)]
        if isinstance(op, (ast.In, ast.NotIn)) or listed[1]:
            if listed[0] or not listed[1] or not isinstance(op, (ast.In, ast.NotIn, ast.Eq, ast.NotEq)):
                self.fail(node, "has no column form")
            # A missing value is in a list that names None.
            found = [self.equal(left, item) for item in right.elts]
            found += [self.compile(left).isNull()] if any(isinstance(i, ast.Constant) and i.value is None for i in right.elts) else []
            among = reduce(lambda a, b: a | b, found, F.lit(False))
            return ~among if isinstance(op, (ast.NotIn, ast.NotEq)) else among
        if isinstance(op, (ast.Eq, ast.NotEq)):
            same = self.equal(left, right)
            return ~same if isinstance(op, ast.NotEq) else same
        if type(op) not in ORDER:
            self.fail(node, "has no column form")
        a, b = self.compile(left), self.compile(right)
        a, b = self.meet(a, b, self.kind(a), self.kind(b)) or self.fail(node, "compares what has no common order")
        return F.coalesce(getattr(a, ORDER[type(op)])(b), F.lit(False))

    def meet(self, a, b, first, second):
        """Both sides in comparable types, or None."""
        if {first, second} <= {"number", "truth"}:
            return tuple(c.cast("long") if k == "truth" else c for c, k in ((a, first), (b, second)))
        if first == second and first != "other":
            return a, b
        if {first, second} == {"moment", "text"}:
            stamps = [c.try_cast("timestamp_ntz") if k == "text" else c.cast("timestamp_ntz") for c, k in ((a, first), (b, second))]
            return tuple(stamps)
        return None

    def equal(self, left, right):
        a, b = self.compile(left), self.compile(right)
        sides = self.meet(a, b, self.kind(a), self.kind(b))
        return F.coalesce(sides[0] == sides[1], F.lit(False)) if sides else F.lit(False)


def condition(df, text):
    """The condition ``text`` on the rows of ``df`` as a boolean column that is never null."""
    compiler = _Compiler(df, text)
    return compiler.truth(compiler.tree)
