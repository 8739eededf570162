"""Clauses as array programs: one clause over the states of a block at once.

For clauses that are rows. A clause's syntax tree is walked once for each block, and each node works on whole arrays.
Integers are exact: 64-bit arrays where the operands are too small to overflow, Python's integers beyond. Results are those of
``clauses.holds``: unknown in states without a value for a variable of the clause or with a divisor of zero in what decides it.
"""

from __future__ import annotations

import ast
from functools import lru_cache

import numpy as np
import pyarrow as pa

from .clauses import named, syntax

#: Values, and where they are known.
Values = tuple[np.ndarray, np.ndarray]
WIDEST = 1 << 62


def _most(a: np.ndarray) -> int:
    return max(abs(int(a.max())), abs(int(a.min()))) if len(a) else 0


def _exact(a: np.ndarray, b: np.ndarray, product: bool) -> tuple[np.ndarray, np.ndarray]:
    """The operands as 64-bit integers if no result can leave these, else as Python's integers."""
    x, y = _most(a), _most(b)
    if (x * y if product else x + y) < WIDEST and max(x, y) < WIDEST:
        return a.astype(np.int64), b.astype(np.int64)
    return a.astype(object), b.astype(object)


def _divided(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Quotients towards zero; divisors aren't zero."""
    size = np.abs(a) // np.abs(b)
    return np.where((a < 0) == (b < 0), size, -size)


def variables(maps: pa.Array) -> dict[str, Values]:
    """The columns of a map array of names to whole numbers."""
    if isinstance(maps, pa.ChunkedArray):
        maps = maps.combine_chunks()
    n = len(maps)
    offsets = maps.offsets.to_numpy()
    lengths = np.diff(offsets)
    if maps.null_count:
        lengths = np.where(maps.is_valid().to_numpy(zero_copy_only=False), lengths, 0)
    row = np.repeat(np.arange(n), lengths)
    inside = np.repeat(offsets[:-1] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(len(row))
    keys, items = maps.keys.take(pa.array(inside)), maps.items.take(pa.array(inside))
    names = keys.dictionary_encode()
    codes, known = names.indices.to_numpy(), items.is_valid().to_numpy(zero_copy_only=False)
    numbers = np.array([int(x) if x is not None else 0 for x in items.to_pylist()], object) if pa.types.is_decimal(items.type) else items.fill_null(0).to_numpy()
    if numbers.dtype == object and _most(numbers) < WIDEST:
        numbers = numbers.astype(np.int64)
    out = {}
    for k, name in enumerate(names.dictionary.to_pylist()):
        some = (codes == k) & known
        values, has = np.zeros(n, numbers.dtype), np.zeros(n, bool)
        values[row[some]], has[row[some]] = numbers[some], True
        out[name] = (values, has)
    return out


@lru_cache(maxsize=10_000)
def _parsed(clause: str) -> tuple[ast.expr | None, frozenset[str]]:
    """A clause's syntax tree and its variables."""
    tree = syntax(clause)
    return tree, frozenset() if tree is None else frozenset(named(tree))


class Block:
    """States whose variables are arrays."""

    def __init__(self, columns: dict[str, Values], n: int):
        self.columns, self.n, self.every = columns, n, np.ones(n, bool)

    def truth(self, clause: str) -> Values:
        """Where a clause holds, and where that is known."""
        none = (np.zeros(self.n, bool), np.zeros(self.n, bool))
        tree, names = _parsed(clause)
        if tree is None or any(name not in self.columns for name in names):
            return none
        try:
            value, known = self._truth(tree)
        except LookupError:
            return none
        for name in names:
            known = known & self.columns[name][1]
        return value & known, known

    def _truth(self, node: ast.expr) -> Values:
        match node:
            case ast.BoolOp(op=op, values=[first, *rest]):
                value, known = self._truth(first)
                for x in rest:
                    # What follows counts where all before is known and doesn't decide.
                    goes_on = known & (value != isinstance(op, ast.Or))
                    v, k = self._truth(x)
                    value, known = np.where(goes_on, v, value), np.where(goes_on, k, known)
                return value, known
            case ast.UnaryOp(op=ast.Not(), operand=x):
                value, known = self._truth(x)
                return ~value, known
            case ast.Compare(left=left, ops=ops, comparators=right):
                sides = [self._number(x) for x in (left, *right)]
                value, known = self.every, self.every
                for op, (a, x), (b, y) in zip(ops, sides, sides[1:]):
                    goes_on = known & value
                    value, known = np.where(goes_on, _compared(type(op), a, b), value), np.where(goes_on, x & y, known)
                return value.astype(bool), known
        value, known = self._number(node)
        return (value != 0).astype(bool), known

    def _number(self, node: ast.expr) -> Values:
        match node:
            case ast.Constant(value=bool() | int() as v):
                v = int(v)
                return np.full(self.n, v, np.int64 if abs(v) < WIDEST else object), self.every
            case ast.Name(id=name):
                return self.columns[name]
            case ast.UnaryOp(op=ast.USub(), operand=x):
                value, known = self._number(x)
                return -value, known
            case ast.UnaryOp(op=ast.UAdd(), operand=x):
                return self._number(x)
            case ast.Call(func=ast.Name(id="abs"), args=[x], keywords=[]):
                value, known = self._number(x)
                return np.abs(value), known
            case ast.BinOp(left=left, op=op, right=right):
                (a, x), (b, y) = self._number(left), self._number(right)
                known = x & y
                a, b = _exact(a, b, isinstance(op, ast.Mult))
                match op:
                    case ast.Add():
                        return a + b, known
                    case ast.Sub():
                        return a - b, known
                    case ast.Mult():
                        return a * b, known
                    case ast.FloorDiv() | ast.Mod():
                        divides = b != 0
                        b = np.where(divides, b, 1)
                        quotient = _divided(a, b)
                        return (quotient if isinstance(op, ast.FloorDiv) else a - quotient * b), known & divides.astype(bool)
            case ast.Compare() | ast.BoolOp() | ast.UnaryOp(op=ast.Not()):
                value, known = self._truth(node)
                return value.astype(np.int64), known
        raise LookupError("not in the clause language")


def _compared(op: type, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if op not in _COMPARE:
        raise LookupError("not a comparison of numbers")
    return _COMPARE[op](a, b).astype(bool)


_COMPARE = {ast.Lt: np.less, ast.LtE: np.less_equal, ast.Gt: np.greater, ast.GtE: np.greater_equal, ast.Eq: np.equal, ast.NotEq: np.not_equal}
