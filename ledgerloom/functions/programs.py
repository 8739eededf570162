"""Program text: comments, target masking, the loop, its variables and annotations.

Column functions where a regular expression can say it; the rest are small per-row helpers in Arrow batches, since blanking
must keep offsets and braces must balance. There is no C parser: a program outside of the simple shape (one function with one
braced while) gets an error text instead of a loop.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_COMMENT = re.compile(r"/\*.*?\*/|//[^\n]*", re.S)
_TARGET = re.compile(r"\b(assert|ensures)\b[^;]*;")
_CALL = re.compile(r"\b(assert|__VERIFIER_assert|sassert|static_assert)\s*\(")


def _blank(text: str) -> str:
    return re.sub(r"[^\n]", " ", text)


def _closing(text: str, at: int, pair: str = "()") -> int:
    """Place of the bracket that closes the one at ``at``, or -1."""
    depth = 0
    for k in range(at, len(text)):
        depth += (text[k] == pair[0]) - (text[k] == pair[1])
        if not depth:
            return k
    return -1


def blank_comments(text: str, contracts: bool = False) -> str:
    """Comments as spaces, offsets and lines kept; ``contracts`` keeps those that begin with @."""
    return _COMMENT.sub(lambda m: m[0] if contracts and m[0][2:3] == "@" else _blank(m[0]), text)


def mask_target(text: str) -> str:
    """What is to be proved is hidden: assert and ensures clauses, executable assertions and the error label; comments go, lines stay."""
    out = blank_comments(text, contracts=True)
    out = _COMMENT.sub(lambda m: _TARGET.sub(lambda t: _blank(t[0]), m[0]), out)
    at = 0
    while m := _CALL.search(out, at):
        end = _closing(out, m.end() - 1)
        stop = out.find(";", end) if end >= 0 else -1
        if stop < 0:
            break
        gap = out[m.start() : stop + 1]
        lines = gap.count("\n")
        out = out[: m.start()] + "((void)0);" + "\n" * lines + " " * max(0, len(gap) - 10 - lines) + out[stop + 1 :]
        at = m.start() + 10
    return re.sub(r"\bERROR\b", "LABEL", out)


def loop_of(text: str) -> dict:
    """guard, body, start (of the keyword) and error of the only braced while of the program."""
    plain = blank_comments(text)
    none = {"guard": None, "body": None, "start": None}
    whiles = list(re.finditer(r"\bwhile\s*\(", plain))
    if re.search(r"\bfor\s*\(", plain):
        return none | {"error": "for loop"}
    if len(whiles) != 1:
        return none | {"error": "no loop" if not whiles else "several loops"}
    m = whiles[0]
    end = _closing(plain, m.end() - 1)
    brace = re.match(r"\s*\{", plain[end + 1 :]) if end >= 0 else None
    if not brace:
        return none | {"error": "loop without braces"}
    begin = end + brace.end()
    close = _closing(plain, begin, "{}")
    if close < 0:
        return none | {"error": "loop not closed"}
    return {"guard": " ".join(plain[m.end() : end].split()), "body": plain[begin + 1 : close], "start": m.start(), "error": None}


LOOP = T.StructType([T.StructField("guard", T.StringType()), T.StructField("body", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("error", T.StringType())])


@F.pandas_udf(T.StringType())
def masked(source):
    return source.map(mask_target, na_action="ignore")


@F.pandas_udf(T.StringType())
def without_plain_comments(source):
    return source.map(lambda t: blank_comments(t, contracts=True), na_action="ignore")


@F.pandas_udf(LOOP)
def loop(source):
    return pd.DataFrame([loop_of(t or "") for t in source], columns=LOOP.names)


def requirement(source: Column) -> Column:
    """The conditions of all requires clauses, joined by &&; null without one."""
    found = F.filter(F.transform(F.regexp_extract_all(source, F.lit(r"\brequires\s+([^;]+);"), 1), lambda c: F.trim(c)), lambda c: c != "")
    return F.when(F.size(found) > 0, F.array_join(found, " && "))


def target(source: Column) -> Column:
    """What is to be proved: the last assert, or else the ensures conditions."""
    asserts = F.regexp_extract_all(source, F.lit(r"\bassert\s+([^;(][^;]*);|\b(?:__VERIFIER_)?assert\s*\(([^;]*)\)\s*;"), 0)
    ensures = F.regexp_extract_all(source, F.lit(r"\bensures\s+([^;]+);"), 1)
    inner = F.regexp_replace(F.regexp_replace(F.try_element_at(asserts, F.lit(-1)), r"^(?:__VERIFIER_)?assert\s*\(?", ""), r"\)?\s*;$", "")
    return F.coalesce(F.trim(inner), F.when(F.size(ensures) > 0, F.array_join(ensures, " && ")))


def parameters(source: Column) -> Column:
    """Names of the first function's parameters."""
    head = F.regexp_extract(source, r"\b\w+\s+\w+\s*\(([^)]*)\)\s*\{", 1)
    return F.filter(F.transform(F.split(head, ","), lambda p: F.regexp_extract(p, r"(\w+)\s*$", 1)), lambda n: ~n.isin("", "void"))


def modified(body: Column) -> Column:
    """Variables that a body assigns, steps up or steps down, but for those it declares."""
    assigned = F.regexp_extract_all(body, F.lit(r"\b([A-Za-z_]\w*)\s*(?:[-+*/%]?=(?!=)|\+\+|--)"), 1)
    stepped = F.regexp_extract_all(body, F.lit(r"(?:\+\+|--)\s*([A-Za-z_]\w*)"), 1)
    declared = F.regexp_extract_all(body, F.lit(r"\b(?:int|long|short|char|unsigned|_Bool)\s+([A-Za-z_]\w*)"), 1)
    return F.array_sort(F.array_except(F.array_distinct(F.concat(assigned, stepped)), declared))


def annotated(source: Column, start: Column, clauses: Column) -> Column:
    """The source with an annotation block of the clauses before the loop keyword."""
    block = F.concat(F.lit("/*@\n"), F.array_join(F.transform(clauses, lambda c: F.concat(F.lit("  loop invariant "), c, F.lit(";\n"))), ""), F.lit("*/\n"))
    return F.concat(F.substring(source, F.lit(1), start), block, F.substring(source, start + 1, F.length(source)))


def hidden_failure(source: Column, hidden: Column) -> Column:
    """Why a masked source doesn't hide its target, or null."""
    return (
        F.when(hidden.isNull(), F.lit("missing"))
        .when((hidden == source) & target(source).isNotNull(), F.lit("unchanged"))
        .when(hidden.rlike(r"\bensures\b"), F.lit("ensures left"))
        .when(hidden.rlike(r"\b(__VERIFIER_)?assert\b"), F.lit("assert left"))
        .when(F.size(F.split(hidden, "\n")) != F.size(F.split(source, "\n")), F.lit("lines moved"))
    )


def _expanded(clause: str, most: int) -> str:
    """power(base, n) with a whole n up to ``most`` as a product, the innermost first."""
    call = re.compile(r"\bpower\(\s*([^(),]+|\([^()]*\))\s*,\s*(\d+)\s*\)")
    while m := call.search(clause):
        n = int(m[2])
        if n > most:
            return clause
        base = m[1].strip()
        base = base if re.fullmatch(r"\w+|\(.*\)", base) else f"({base})"
        clause = clause[: m.start()] + (f"({' * '.join([base] * n)})" if n else "1") + clause[m.end() :]
    return clause


@F.pandas_udf(T.StringType())
def fixed_powers(clauses):
    """Powers by constants up to 20 written as products."""
    return clauses.map(lambda c: _expanded(c, 20), na_action="ignore")
