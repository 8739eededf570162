"""Contracts of program text: clauses around binders, bounds, constants, annotations of a loop, counters, and oracle calls.

Each helper reads one text by the offsets of its marks; columns of texts run them in Arrow batches.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .clauses import _cut
from .programs import _blank, blank_comments, loop_of

_QUOTED = re.compile(r"/\*.*?\*/|//[^\n]*|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'", re.S)
_BLOCK = re.compile(r"/\*@.*?\*/", re.S)
_MARK = re.compile(r"\\(?:forall|exists|lambda|let)\b|;")
_NUMBER = r"[+-]?(?:0[xX][0-9A-Fa-f]+|\d+)"
#: Words that make a block a helper, and those that make it a contract.
HELPER = re.compile(r"\b(?:predicate|logic|axiom|lemma)\b")
CONTRACT = re.compile(r"\b(?:requires|ensures|assigns|loop\s+invariant|loop\s+assigns)\b")


# --- clauses ----------------------------------------------------------------------------------


def clause_spans(text: str, keyword: str) -> list[tuple[int, int, str]]:
    """(start, stop, clause) after each ``keyword``: a binder takes one semicolon with it, so the first one too many ends the clause."""
    out = []
    for m in re.finditer(rf"\b{re.escape(keyword)}\b", text):
        open_, end = 0, len(text)
        for mark in _MARK.finditer(text, m.end()):
            open_ += -1 if mark[0] == ";" else 1
            if open_ < 0:
                end = mark.start()
                break
        out.append((m.start(), min(end + 1, len(text)), text[m.end() : end].strip()))
    return out


SPANS = T.ArrayType(T.StructType().add("start", "integer").add("stop", "integer").add("clause", "string"))


def clauses(keyword: str):
    """A column function: the (start, stop, clause) of a text's clauses with this keyword."""

    @F.pandas_udf(SPANS)
    def found(texts):
        return texts.map(lambda t: [dict(zip(("start", "stop", "clause"), s)) for s in clause_spans(t or "", keyword)])

    return found


def requirement_of(text: str) -> str:
    """All requires clauses as one condition; an empty text without any."""
    found = [c for _, _, c in clause_spans(text, "requires")]
    return " && ".join(f"({c})" for c in found) if len(found) > 1 else " ".join(found[0].split()) if found else ""


@F.pandas_udf(T.StringType())
def requirement(texts):
    return texts.map(lambda t: requirement_of(t or ""))


# --- bounds and constants ---------------------------------------------------------------------

_NAME_FIRST = re.compile(r"([A-Za-z_]\w*)\s*(==|>=|>|<=|<)\s*(-?\d+)")
_NUMBER_FIRST = re.compile(r"(-?\d+)\s*(==|>=|>|<=|<)\s*([A-Za-z_]\w*)")
_TURNED = {"<": ">", "<=": ">=", ">": "<", ">=": "<=", "==": "=="}


def _bare(text: str) -> str:
    """Without the brackets around the whole."""
    text = text.strip()
    while text[:1] == "(" and text[-1:] == ")" and _wraps(text):
        text = text[1:-1].strip()
    return text


def _wraps(text: str) -> bool:
    depth = 0
    for k, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if not depth:
            return k == len(text) - 1
    return False


def conjuncts(text: str) -> list[str]:
    """The parts of a condition that must all hold; what is inside a negation or another operator stays whole."""
    todo, out = [text], []
    while todo:
        part = _bare(todo.pop())
        parts = _cut(part, "&&")
        if len(parts) > 1:
            todo += reversed(parts)
        else:
            out.append(part)
    return out


def bounds_of(condition: str, names: list[str]) -> list[tuple[int | None, int | None]]:
    """Least and greatest value of each name by the comparisons with whole numbers that must hold; None where there is none."""
    least: dict[str, int] = {}
    most: dict[str, int] = {}
    for part in conjuncts(condition or ""):
        if m := _NAME_FIRST.fullmatch(part):
            name, sign, value = m[1], m[2], int(m[3])
        elif m := _NUMBER_FIRST.fullmatch(part):
            name, sign, value = m[3], _TURNED[m[2]], int(m[1])
        else:
            continue
        if sign in ("==", ">=", ">"):
            low = value + (sign == ">")
            least[name] = max(low, least.get(name, low))
        if sign in ("==", "<=", "<"):
            high = value - (sign == "<")
            most[name] = min(high, most.get(name, high))
    return [(least.get(n), most.get(n)) for n in names]


BOUNDS = T.ArrayType(T.StructType().add("least", "long").add("greatest", "long"))


@F.pandas_udf(BOUNDS)
def bounds(conditions, names):
    """The interval of each name in a condition, in the order of the names."""
    return pd.Series([[{"least": a, "greatest": b} for a, b in bounds_of(c, list(n))] for c, n in zip(conditions, names)])


def constants_of(source: str, follow: bool = False) -> dict[str, int]:
    """Names that stand for a whole number in the whole source: object-like macros and initialised globals.

    With ``follow`` also those defined by another such name, over any number of steps.
    """
    plain = blank_comments(source)
    depth, top = 0, []
    for c in plain:
        depth = max(0, depth - (c == "}"))
        top.append(c if c == "\n" or not depth and c not in "{}" else " ")
        depth += c == "{"
    value = rf"{_NUMBER}[uUlL]*" + (r"|[A-Za-z_]\w*" if follow else "")
    macro = re.finditer(rf"(?m)^\s*#\s*define\s+([A-Za-z_]\w*)\s+\(?\s*({value})\s*\)?\s*$", source)
    initialised = re.finditer(rf"(?m)^\s*(?:(?:static|extern|const|volatile|unsigned|signed)\s+)*(?:int|long|short)\s+([A-Za-z_]\w*)\s*=\s*({value})\s*;", "".join(top))
    given = {m[1]: m[2] for found in (macro, initialised) for m in found}
    out: dict[str, int] = {}
    while True:
        new = {}
        for name, text in given.items():
            if name not in out and re.fullmatch(rf"{_NUMBER}[uUlL]*", text):
                new[name] = int(text.rstrip("uUlL"), 0)
            elif name not in out and text in out:
                new[name] = out[text]
        if not new:
            return out
        out |= new


def bound_by(condition: str, constants: dict[str, int]) -> str:
    """A condition with its constants as numbers."""
    if not constants:
        return condition
    return re.sub(r"\b(?:" + "|".join(sorted(map(re.escape, constants), key=len, reverse=True)) + r")\b", lambda m: str(constants[m[0]]), condition)


@F.pandas_udf(T.MapType(T.StringType(), T.LongType()))
def constants(sources):
    return sources.map(lambda s: constants_of(s or ""))


@F.pandas_udf(T.StringType())
def bound_requirement(sources):
    """The requirement of a source with its constants as numbers."""
    return sources.map(lambda s: bound_by(requirement_of(s or ""), constants_of(s or "")))


# --- annotations ------------------------------------------------------------------------------


def loop_annotation(text: str) -> tuple[str | None, str | None]:
    """The last clause-bearing block before the first loop, with nothing but comments between; else why there is none."""
    plain = blank_comments(text)
    loop = re.search(r"\b(?:while|for)\s*\(", plain)
    if loop is None:
        return None, "no loop"
    before = [m for m in _BLOCK.finditer(text, 0, loop.start()) if re.search(r"\bloop\s+invariant\b", m[0])]
    if not before:
        return None, "no annotation before the loop"
    if plain[before[-1].end() : loop.start()].strip():
        return None, "code between annotation and loop"
    return before[-1][0], None


def helpers(text: str, function: str) -> list[str]:
    """Blocks of definitions before a function, without those that state a contract."""
    head = re.search(rf"\b{re.escape(function)}\s*\(", text)
    return [m[0] for m in _BLOCK.finditer(text, 0, head.start()) if HELPER.search(m[0]) and not CONTRACT.search(m[0])] if head else []


ANNOTATION = T.StructType().add("block", "string").add("clauses", T.ArrayType(T.StringType())).add("helpers", T.ArrayType(T.StringType())).add("error", "string")


@F.pandas_udf(ANNOTATION)
def annotation(texts, functions):
    """A text's annotation of its first loop, the clauses in it, and the helper blocks before the function."""
    rows = []
    for t, f in zip(texts, functions):
        block, error = loop_annotation(t or "")
        found = [c for _, _, c in clause_spans(block or "", "loop invariant")]
        rows.append((block, found, helpers(t or "", f or ""), error if error or found else "no whole clause"))
    return pd.DataFrame(rows, columns=ANNOTATION.names)


# --- counters ---------------------------------------------------------------------------------


def counter_values(name: str, start: str | None, guard: str, body: str, most: int = 9) -> list[int] | None:
    """The values that a counter takes before and after each turn of its loop: a progression of step 1 from a literal to a literal.

    None without such a start, step and guard, or with more than ``most`` values.
    """
    if not re.fullmatch(r"[+-]?\d+", (start or "").strip()):
        return None
    v = re.escape(name)
    for sign, step, signs in (("+", 1, "<|<="), ("-", -1, ">|>=")):
        s = re.escape(sign)
        steps = rf"\b{v}\s*{s}{s}|{s}{s}\s*{v}\b|\b{v}\s*{s}=\s*1\b|\b{v}\s*=\s*{v}\s*{s}\s*1\b"
        limit = re.fullmatch(rf"{v}\s*({signs})\s*([+-]?\d+)", _bare(guard))
        if limit and re.search(steps, body):
            last = int(limit[2]) + step * (len(limit[1]) == 2)
            values = range(int(start), last + step, step)
            return list(values) if 0 < len(values) <= most else None
    return None


@F.pandas_udf(T.ArrayType(T.LongType()))
def counter_domain(names, starts, guards, bodies):
    return pd.Series([counter_values(n, s, g or "", b or "") for n, s, g, b in zip(names, starts, guards, bodies)])


# --- oracles ----------------------------------------------------------------------------------

_DECLARED = re.compile(r"(?:(?:extern|static|inline|const|volatile|signed|unsigned|long|short)\s+)*(?:void|int|char|_Bool|float|double)(?:\s+long)?")
_HEAD = re.compile(r"\b(?!if\b|while\b|for\b|switch\b)[A-Za-z_]\w*\s*\(([^()]*)\)\s*\{")


def determinised(source: str) -> tuple[str | None, str | None]:
    """The source with each oracle call as a new parameter of the function with the loop, or why that can't be.

    Comments, strings, directives and declarations of oracles stay as they are. All edits are made in one pass by offset.
    """
    code = _QUOTED.sub(lambda m: _blank(m[0]), source)
    taken = set(re.findall(r"\b[A-Za-z_]\w*\b", code))
    edits, number = [], 0
    for m in re.finditer(r"\bunknown\w*\s*\(\s*\)", code):
        line = re.split(r"[;{}\n]", code[: m.start()])[-1].strip()
        if line.startswith("#") or _DECLARED.fullmatch(line) and code[m.end() :].lstrip()[:1] in (";", "{"):
            continue
        while f"_nd{number}" in taken:
            number += 1
        taken.add(f"_nd{number}")
        edits.append((m.start(), m.end(), f"_nd{number}"))
    if not edits:
        return source, None
    loop = loop_of(source)
    if loop["start"] is None:
        return None, loop["error"]
    depth, heads = 0, []
    marks = sorted([(m.start(), m) for m in _HEAD.finditer(code, 0, loop["start"])] + [(m.start(), None) for m in re.finditer(r"[{}]", code[: loop["start"]])], key=lambda x: x[0])
    for at, head in marks:
        if head is not None:
            heads += [head] if not depth else []
        else:
            depth += 1 if code[at] == "{" else -1
    if not heads:
        return None, "no function around the loop"
    inside, end = heads[-1][1].strip(), heads[-1].end(1)
    added = ", ".join(f"int {e[2]}" for e in edits)
    edits.append((heads[-1].start(1), end, added) if inside in ("", "void") else (end, end, ", " + added))
    out, at = [], 0
    for start, stop, text in sorted(edits):
        out += [source[at:start], text]
        at = stop
    return "".join([*out, source[at:]]), None


DETERMINISED = T.StructType().add("source", "string").add("error", "string")


@F.pandas_udf(DETERMINISED)
def without_oracles(sources):
    return pd.DataFrame([determinised(s or "") for s in sources], columns=DETERMINISED.names)
