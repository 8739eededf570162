"""Boolean clauses over integer state variables: normal form, canonical key, and Spark columns.

A clause is C-like text such as ``0 <= x && x < \\at(n, Pre)``. A small rewrite gives Python syntax,
whose own parser does the rest; there is no grammar here. ``predicate`` turns a clause into a Column, so
that clauses run inside code generation; ``holds`` evaluates one with unbounded integers for the few that don't fit.

Results are three-valued: true, false, or null where any variable of the clause has no value, a divisor is zero, or the clause uses what
the language doesn't have. ``&&`` and ``||`` look at their right side only if the left one doesn't decide, and a null left side makes the whole null.
"""

from __future__ import annotations

import ast
import re
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words of the clause language that are not variables.
WORDS = frozenset({
    "at", "Pre", "Post", "LoopEntry", "LoopCurrent", "old", "result",
    "true", "false",
    "True", "False", "None", "and", "or", "not", "bool", "abs",
    "integer", "int", "long", "short", "unsigned", "signed", "real",
})
WIDE = T.DecimalType(38, 0)


# --- text columns -------------------------------------------------------------------------


def normalize(clause: Column) -> Column:
    """Without the keyword before it, one semicolon after it, and runs of white space."""
    bare = F.regexp_replace(F.trim(F.regexp_replace(clause, r"\s+", " ")), r"^loop invariant ", "")
    return F.trim(F.regexp_replace(bare, r";$", ""))


def extract(text: Column, most: int | None = None) -> Column:
    """The clauses of an annotated text, in order; ``most`` keeps the first ones."""
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"loop\s+invariant\s+([^;]+);"), 1), lambda c: F.trim(F.regexp_replace(c, r"\s+", " ")))
    return found if most is None else F.slice(found, 1, most)


def names(clause: Column) -> Column:
    """Distinct identifiers of a clause that are neither words of the language nor bound by a quantifier."""
    identifiers = lambda text: F.regexp_extract_all(text, F.lit(r"([A-Za-z_]\w*)"), 1)
    binders = F.regexp_extract_all(clause, F.lit(r"\\(?:forall|exists)\s+(?:integer|int|long|short|real)\s+([^;]+);"), 1)
    bound = F.flatten(F.transform(binders, identifiers))
    plain = F.regexp_replace(clause, r"\\[A-Za-z_]+", " ")
    return F.array_except(F.array_except(F.array_distinct(identifiers(plain)), F.array(*[F.lit(w) for w in sorted(WORDS)])), bound)


# --- syntax -----------------------------------------------------------------------------


def _cut(text: str, mark: str) -> list[str]:
    """Parts of the text around a mark outside of parentheses."""
    parts, depth, at = [], 0, 0
    for m in re.finditer(rf"[()]|{re.escape(mark)}", text):
        depth += {"(": 1, ")": -1}.get(m[0], 0)
        if m[0] == mark and not depth:
            if mark == "==>" and text[m.start() - 1 : m.start()] == "<":
                continue
            parts.append(text[at : m.start()])
            at = m.end()
    return [*parts, text[at:]]


def _pythonic(text: str) -> str:
    for mark in ("<==>", "==>"):
        parts = [_pythonic(p) for p in _cut(text, mark)] if mark in text else [text]
        if len(parts) > 1:
            out = parts[-1]
            for p in reversed(parts[:-1]):
                out = f"(({p}) == ({out}))" if mark == "<==>" else f"((not ({p})) or ({out}))"
            return out
    text = re.sub(r"\(([^()]*==>[^()]*)\)", lambda m: f"({_pythonic(m[1])})", text) if "==>" in text else text
    text = re.sub(r"!(?!=)", " not ", text.replace("&&", " and ").replace("||", " or "))
    return re.sub(r"(?<![<>=!])=(?!=)", "==", text).replace("/", "//").replace("////", "//")


@lru_cache(maxsize=100_000)
def syntax(clause: str) -> ast.expr | None:
    """Syntax tree of a clause, or None if it isn't one."""
    text = re.sub(r"\\at\(\s*(\w+)\s*,\s*(Pre|LoopEntry)\s*\)", r"\1__\2", clause)
    text = re.sub(r"(\w+)@pre\b", r"\1__Pre", text)
    if "\\" in text or "//" in text:
        return None
    try:
        return ast.parse(_pythonic(text).strip(), mode="eval").body
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def named(tree: ast.expr) -> set[str]:
    """The variables of a syntax tree."""
    called = {id(n.func) for n in ast.walk(tree) if isinstance(n, ast.Call)}
    return {n.id for n in ast.walk(tree) if isinstance(n, ast.Name) and id(n) not in called}


# --- canonical key ----------------------------------------------------------------------------
# Rules: a denied comparison is its opposite, two denials cancel; > and >= are read from the right; the sides of == and !=, and of + and *, stand in text order; adding
# or subtracting 0, multiplying by 1 and a plus sign go; a chain is a conjunction; conjunctions and disjunctions have each part once, in order.

_SIGNS = {ast.Lt: "<", ast.LtE: "<=", ast.Gt: ">", ast.GtE: ">=", ast.Eq: "==", ast.NotEq: "!="}
_OPPOSITE = {"<": ">=", ">=": "<", ">": "<=", "<=": ">", "==": "!=", "!=": "=="}
_TURNED = {">": "<", ">=": "<="}
#: What an operator leaves out on its left and on its right, and those whose sides may stand in any order.
_NEUTRAL = {"Add": ("0", "0"), "Sub": (None, "0"), "Mult": ("1", "1")}
_LOGIC = (ast.BoolOp, ast.Compare)


def _term(node: ast.expr) -> str:
    """Text of a number or, where one stands among numbers, of a statement."""
    if isinstance(node, _LOGIC) or isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.Not):
        return f"({_said(node, True)})"
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Constant) and isinstance(node.value, int):
        return str(int(node.value))
    if isinstance(node, ast.UnaryOp):
        return {ast.UAdd: "{}", ast.USub: "-({})"}[type(node.op)].format(_term(node.operand))
    if not isinstance(node, ast.BinOp):
        raise LookupError("no canonical form")
    kind, sides = type(node.op).__name__, [_term(node.left), _term(node.right)]
    before, after = _NEUTRAL.get(kind, (None, None))
    if sides[1] == after:
        return sides[0]
    if sides[0] == before:
        return sides[1]
    return f"{kind}({', '.join(sorted(sides) if kind in ('Add', 'Mult') else sides)})"


def _links(node: ast.Compare) -> list[tuple[str, str, str]]:
    """(left, sign, right) of each comparison of a chain."""
    sides = [_term(x) for x in (node.left, *node.comparators)]
    return list(zip(sides, [_SIGNS[type(op)] for op in node.ops], sides[1:]))


def _compared(left: str, sign: str, right: str) -> str:
    turn = sign in _TURNED or sign in ("==", "!=") and right < left
    return " ".join((right, _TURNED.get(sign, sign), left) if turn else (left, sign, right))


def _parts(node: ast.expr, kind: type) -> list[tuple[ast.expr | None, str]]:
    """The statements that a conjunction or disjunction joins, with the node of those that are whole nodes."""
    if isinstance(node, ast.BoolOp) and isinstance(node.op, kind):
        return [p for v in node.values for p in _parts(v, kind)]
    if kind is ast.And and isinstance(node, ast.Compare) and len(node.ops) > 1:
        return [(None, _compared(*x)) for x in _links(node)]
    return [(node, _said(node, True))]


def _said(node: ast.expr, holds: bool) -> str:
    """Text of a statement, or of its denial."""
    while isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.Not):
        node, holds = node.operand, not holds
    if isinstance(node, ast.Compare) and len(node.ops) == 1:
        ((left, sign, right),) = _links(node)
        return _compared(left, sign if holds else _OPPOSITE[sign], right)
    if isinstance(node, _LOGIC):
        kind = type(node.op) if isinstance(node, ast.BoolOp) else ast.And
        once: dict[str, ast.expr | None] = {}
        for part, text in _parts(node, kind):
            once.setdefault(text, part)
        if len(once) == 1 and (only := next(iter(once.values()))) is not None:
            return _said(only, holds)
        body = f"{kind.__name__}[{'; '.join(once)}]"
    else:
        body = _term(node)
    return body if holds else f"not ({body})"


@lru_cache(maxsize=100_000)
def canonical_key(clause: str) -> str:
    """Equal for clauses that differ in side, operand order of ==, !=, + and *, neutral terms, or negated comparisons.

    A clause without a canonical form is its own key.
    """
    tree = syntax(clause)
    try:
        return _said(tree, True) if tree is not None else clause
    except LookupError:
        return clause


@F.pandas_udf(T.StringType())
def clause_key(clauses):
    """``canonical_key`` of a column of normalised clauses."""
    return clauses.map(canonical_key, na_action="ignore")


# --- evaluation ----------------------------------------------------------------------------


def _lazy(first: Column, rest: Column, decided: bool) -> Column:
    """``first`` if it is null or equals ``decided``, else ``rest``."""
    return F.when(first.isNull(), F.lit(None).cast("boolean")).when(first == F.lit(decided), F.lit(decided)).otherwise(rest)


def predicate(clause: str, variables: dict[str, Column]) -> Column:
    """Boolean column of a clause; null where it can't be evaluated. ``variables`` has plain, x__Pre and x__LoopEntry names.

    Integers have 38 digits; a result beyond is null.
    """
    unknown = F.lit(None).cast("boolean")
    tree = syntax(clause)

    def truth(node: ast.expr) -> Column:
        match node:
            case ast.BoolOp(op=op, values=values):
                out = truth(values[-1])
                for v in reversed(values[:-1]):
                    out = _lazy(truth(v), out, isinstance(op, ast.Or))
                return out
            case ast.UnaryOp(op=ast.Not(), operand=x):
                return ~truth(x)
            case ast.Compare(left=left, ops=ops, comparators=right):
                if len(ops) == 1 and isinstance(ops[0], ast.Eq | ast.NotEq) and isinstance(left, ast.BoolOp | ast.Compare):
                    return truth(left) == truth(right[0]) if isinstance(ops[0], ast.Eq) else truth(left) != truth(right[0])
                sides = [left, *right]
                parts = [compared(type(op), number(a), number(b)) for op, a, b in zip(ops, sides, sides[1:])]
                out = parts[-1]
                for p in reversed(parts[:-1]):
                    out = _lazy(p, out, False)
                return out
        return number(node) != 0

    def compared(op: type, a: Column, b: Column) -> Column:
        return {ast.Lt: a < b, ast.LtE: a <= b, ast.Gt: a > b, ast.GtE: a >= b, ast.Eq: a == b, ast.NotEq: a != b}[op]

    def number(node: ast.expr) -> Column:
        match node:
            case ast.Constant(value=bool() | int() as v):
                return F.lit(int(v)).cast(WIDE)
            case ast.Name(id=name):
                return variables[name].cast(WIDE) if name in variables else F.lit(None).cast(WIDE)
            case ast.UnaryOp(op=ast.USub(), operand=x):
                return F.negate(number(x))
            case ast.UnaryOp(op=ast.UAdd(), operand=x):
                return number(x)
            case ast.Call(func=ast.Name(id="abs"), args=[x], keywords=[]):
                return F.abs(number(x))
            case ast.BinOp(left=left, op=op, right=right):
                a, b = number(left), number(right)
                match op:
                    case ast.Add():
                        return F.try_add(a, b).cast(WIDE)
                    case ast.Sub():
                        return F.try_subtract(a, b).cast(WIDE)
                    case ast.Mult():
                        return F.try_multiply(a, b).cast(WIDE)
                    case ast.FloorDiv():
                        return F.when(b != 0, F.call_function("div", a, b)).cast(WIDE)
                    case ast.Mod():
                        return F.when(b != 0, a % b).cast(WIDE)
            case ast.Compare() | ast.BoolOp() | ast.UnaryOp(op=ast.Not()):
                return truth(node).cast("int").cast(WIDE)
        raise LookupError("no column for this")

    if tree is None or not named(tree) <= variables.keys():
        return unknown
    try:
        value = truth(tree)
    except LookupError:
        return unknown
    for name in sorted(named(tree)):
        value = F.when(variables[name].isNotNull(), value)
    return value


def _divided(a: int, b: int) -> int:
    return abs(a) // abs(b) * (1 if (a < 0) == (b < 0) else -1)


class _Quotients(ast.NodeTransformer):
    """C's division and remainder, which go towards zero."""

    def visit_BinOp(self, node: ast.BinOp) -> ast.expr:
        self.generic_visit(node)
        if isinstance(node.op, ast.FloorDiv | ast.Mod):
            call = ast.Call(ast.Name("_divided", ast.Load()), [node.left, node.right], [])
            if isinstance(node.op, ast.Mod):
                return ast.BinOp(node.left, ast.Sub(), ast.BinOp(call, ast.Mult(), node.right))
            return call
        return node


_ALLOWED = (ast.BoolOp, ast.UnaryOp, ast.BinOp, ast.Compare, ast.Name, ast.Constant, ast.boolop, ast.unaryop, ast.cmpop, ast.expr_context, ast.Add, ast.Sub, ast.Mult, ast.FloorDiv, ast.Mod)
_SIGNED = (*_SIGNS,)


def _is_abs(node: ast.AST) -> bool:
    return isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id == "abs" and len(node.args) == 1 and not node.keywords


def _usable(node: ast.AST) -> bool:
    if isinstance(node, ast.Constant):
        return isinstance(node.value, int)
    if isinstance(node, ast.cmpop):
        return isinstance(node, _SIGNED)
    return _is_abs(node) or isinstance(node, _ALLOWED) and not isinstance(node, ast.Invert)


@lru_cache(maxsize=100_000)
def _code(clause: str):
    tree = syntax(clause)
    if tree is None or not all(map(_usable, ast.walk(tree))):
        return None
    body = _Quotients().visit(ast.parse(ast.unparse(tree), mode="eval"))
    return compile(ast.fix_missing_locations(body), "clause", "eval"), frozenset(named(tree))


def holds(clause: str, state: dict[str, int]) -> bool | None:
    """Truth of a clause in a state with unbounded integers."""
    code = _code(clause)
    if code is None or not code[1] <= state.keys():
        return None
    try:
        return bool(eval(code[0], {"__builtins__": {}, "_divided": _divided, "abs": abs}, state))  # noqa: S307  only arithmetic nodes get here
    except (NameError, ZeroDivisionError, TypeError, OverflowError):
        return None


@F.pandas_udf(T.BooleanType())
def clause_holds(clauses, states):
    """``holds`` for columns: a clause and a map of variable values, for clauses that are rows rather than constants."""
    import pandas as pd

    return pd.Series([None if c is None or s is None else holds(c, {k: int(v) for k, v in (s.items() if isinstance(s, dict) else s) if v is not None}) for c, s in zip(clauses, states)], dtype=object)
