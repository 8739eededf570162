"""Text columns: token signatures, redaction, prompts, chat content and log fields; built-in functions but for one renaming."""

from __future__ import annotations

import re
from itertools import groupby

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Names of the input oracle, words that are never renamed in a signature, tokens, and what a skeleton keeps.
ORACLE_NAMES = r"^(?:(?:unknown|nondet)\d*|__VERIFIER_nondet_\w*)$"
KEYWORDS = [
    "_Bool", "auto", "break", "case", "char", "const", "continue",
    "default", "do", "double", "else", "enum", "extern", "float",
    "for", "goto", "if", "inline", "int", "long", "register",
    "requires", "restrict", "return", "short", "signed", "sizeof",
    "static", "struct", "switch", "typedef", "union", "unsigned",
    "void", "volatile", "while",
]
TOKEN = r"(==>|<==>|==|!=|<=|>=|&&|\|\||<<|>>|\+\+|--|->|[A-Za-z_]\w*|0[xX][0-9A-Fa-f]+|\d+|[^\s])"
CONDITION_OPS = ["<", ">", "<=", ">=", "==", "!=", "&&", "||", "!"]
WITH_CONDITION = ["if", "while", "for", "switch"]
ALONE = ["else", "break", "continue", "return", "goto", "{", "}"]


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body's own lambdas use it."""
    return F.transform(F.array(value), body)[0]


def spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def without_comments(text: Column) -> Column:
    """Comments become a space, but the requirements of contract comments stay."""
    block = r"(?s)/\*.*?\*/"
    kept = lambda c: F.array_join(F.transform(F.regexp_extract_all(c, F.lit(r"(?s)\brequires\b\s*(.*?);"), 1), lambda v: F.concat(F.lit("requires "), v, F.lit(";"))), " ")
    shown = F.transform(F.regexp_extract_all(text, F.lit(block), 0), lambda c: F.when(c.startswith("/*@") & c.rlike(r"\brequires\b"), kept(c)).otherwise(F.lit(" ")))
    between = F.split(text, block, -1)
    whole = F.array_join(F.zip_with(between, shown, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return F.regexp_replace(whole, r"//[^\n]*", " ")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(without_comments(text), F.lit(TOKEN), 1)


def renamed_function(found: Column) -> Column:
    """The first name that an opening parenthesis follows becomes FUNC."""
    plain = lambda t: t.rlike(r"^[A-Za-z_]") & ~t.isin(*KEYWORDS) & ~t.rlike(ORACLE_NAMES)
    called = lambda ts: F.zip_with(ts, F.concat(F.slice(ts, 2, F.greatest(F.size(ts) - 1, F.lit(0))), F.array(F.lit(""))), lambda t, after: plain(t) & (after == "("))
    return let(found, lambda ts: let(F.array_position(called(ts), True), lambda at: F.transform(ts, lambda t, i: F.when(i + 1 == at, F.lit("FUNC")).otherwise(t))))


_TOKENS, _ORACLE, _NAME, _KEPT = re.compile(TOKEN, re.ASCII), re.compile(ORACLE_NAMES), re.compile(r"[A-Za-z_]"), frozenset(KEYWORDS)
_NUMBER, _SMALL = re.compile(r"\d+|0[xX][0-9A-Fa-f]+", re.ASCII), re.compile(r"(?:0[xX])?0*[01]")


def _renamed(tokens: list[str]) -> list[str]:
    seen: dict[str, str] = {}
    return ["NONDET" if _ORACLE.match(t) else t if t in _KEPT or not _NAME.match(t) else seen.setdefault(t, f"v{len(seen)}") for t in tokens]


@F.pandas_udf(T.ArrayType(T.StringType()))
def alpha(found):
    """Names become v0, v1, ... by first use; the input oracle becomes NONDET; keywords stay.

    A running numbering over a text of any length needs a table of names, which array functions search anew for every token.
    """
    return found.map(lambda tokens: None if tokens is None else _renamed(tokens))


def renamed_text(text: Column, numbers: bool = False) -> Column:
    """The tokens of ``alpha``, and with ``numbers`` of ``abstract_numbers``, with single spaces; the text is cut into tokens in the batch, and none of them crosses as a value of its own."""

    def one(t: str | None) -> str | None:
        if t is None:
            return None
        out = _renamed(_TOKENS.findall(t))
        return " ".join(["NUM" if _NUMBER.fullmatch(x) and not _SMALL.fullmatch(x) else x for x in out] if numbers else out)

    return F.pandas_udf(lambda texts: texts.map(one), "string")(without_comments(text))


def abstract_numbers(found: Column) -> Column:
    """Whole numbers, also in base 16, other than 0 and 1 become NUM."""
    return F.transform(found, lambda t: F.when(t.rlike(r"^(\d+|0[xX][0-9A-Fa-f]+)$") & ~t.rlike(r"^(0[xX])?0*[01]$"), F.lit("NUM")).otherwise(t))


def _closing(found: list[str], at: int) -> int:
    """Place of the token that closes the bracket at ``at``; the last place if none does."""
    opens, closes, depth = found[at], {"(": ")", "{": "}"}[found[at]], 0
    for k in range(at, len(found)):
        depth += (found[k] == opens) - (found[k] == closes)
        if not depth:
            return k
    return len(found) - 1


def _first_loop(found: list[str]) -> tuple[list[str], list[str]]:
    """Tokens of the first while loop's guard and body; without a loop no guard and all tokens."""
    start = next((k for k in range(len(found) - 1) if found[k] == "while" and found[k + 1] == "("), None)
    if start is None:
        return [], found
    end = _closing(found, start + 1)
    body = next((k for k in range(end, len(found)) if found[k] == "{"), None)
    return found[start + 2 : end], found[end + 1 :] if body is None else found[body + 1 : _closing(found, body)]


def _profile(found: list[str], most: int = 3) -> str:
    guard, body = _first_loop(found)
    tests = [guard] + [body[k + 2 : _closing(body, k + 1)] for k in range(len(body) - 1) if body[k] == "if" and body[k + 1] == "("]
    counts = [body.count("if"), body.count("else"), sum("&&" in t or "||" in t for t in tests)]
    flags = [*[w in body for w in ("break", "continue", "return", "goto")], "while" in body or "for" in body]
    return ",".join(["constant" if guard in (["0"], ["1"]) else "expression", *[str(min(c, most)) for c in counts], *[str(int(f)) for f in flags]])


def _conditions(body: list[str]) -> dict[int, range]:
    """The places inside each condition by that of its word; what is in a condition has none of its own."""
    opened, closed = [], {}
    for k, t in enumerate(body):
        if t == "(":
            opened.append(k)
        elif t == ")" and opened:
            closed[opened.pop()] = k
    out: dict[int, range] = {}
    for k in range(len(body) - 1):
        free = not out or k > next(reversed(out.values())).stop
        if free and body[k] in WITH_CONDITION and body[k + 1] == "(":
            out[k] = range(k + 2, closed.get(k + 1, len(body)))
    return out


def _skeleton(found: list[str], operators: bool) -> str:
    """Each token outside conditions says its word, STMT for a semicolon, or nothing; runs of STMT are one."""
    _, body = _first_loop(found)
    conditions = _conditions(body)
    hidden = {k for inside in conditions.values() for k in range(inside.start - 1, inside.stop + 1)}
    said: list[list[str]] = []
    for k, word in enumerate(body):
        if k in conditions:
            used = [body[j] for j in conditions[k] if body[j] in CONDITION_OPS]
            said.append([word, *(used or ["NO_CONDITION_OP"] if operators else [])])
        elif k not in hidden and (word in ALONE or word == ";"):
            said.append(["STMT" if word == ";" else word])
    runs = groupby(said, lambda x: x == ["STMT"])
    return " ".join(w for plain, run in runs for part in (list(run)[:1] if plain else run) for w in part)


def _of_tokens(text: Column, one) -> Column:
    """A text's value by a function of its tokens, which are cut in the batch."""
    return F.pandas_udf(lambda texts: texts.map(lambda t: one(_TOKENS.findall(t)), na_action="ignore"), "string")(without_comments(text))


def control_profile(text: Column) -> Column:
    """The first loop: kind of guard, capped counts of if, else and compound tests, and whether break, continue, return, goto and an inner loop occur."""
    return _of_tokens(text, _profile)


def control_skeleton(text: Column, operators: bool = False) -> Column:
    """Control words and braces of the first loop's body in order; what stands between is STMT once. Conditions are left out, or leave their operators."""
    return _of_tokens(text, lambda found: _skeleton(found, operators))


def signature(found: Column) -> Column:
    return F.sha2(F.array_join(found, " "), 256)


def without_thoughts(text: Column) -> Column:
    """Without think and reasoning blocks, and without the tags around code."""
    bare = text
    for tag in ("think", "reasoning"):
        bare = F.regexp_replace(bare, rf"(?is)<\s*{tag}\s*>.*?<\s*/\s*{tag}\s*>", "")
    bare = F.regexp_replace(F.regexp_replace(bare, r"(?i)<\s*code\s*>\s*", ""), r"(?i)\s*<\s*/\s*code\s*>", "")
    return F.regexp_replace(bare, r"^\s+|\s+$", "")


def redacted(text: Column, secret: str | None = None) -> Column:
    out = F.replace(text, F.lit(secret), F.lit("[redacted]")) if secret else text
    return F.regexp_replace(out, r"sk-[A-Za-z0-9_-]{12,}", "[redacted]")


def prompt_of(program: Column, lead: str, marker: str = "Program:\n") -> Column:
    return F.concat(F.lit(lead), F.lit("\n" + marker), program)


def program_of(prompt: Column, marker: str = "Program:\n") -> Column:
    """What follows the marker; null without one."""
    return F.when(F.contains(prompt, F.lit(marker)), F.substring_index(prompt, marker, -1))


def content_text(content: Column) -> Column:
    """Text of a list of typed parts, joined by line ends; null is empty."""
    return F.coalesce(F.array_join(F.filter(F.transform(content, lambda p: F.when(p["type"] == "text", p["text"])), lambda t: t.isNotNull()), "\n"), F.lit(""))


def rendered(state: Column, label: str | None = None) -> Column:
    """a == 1 && b == 2, in name order."""
    body = F.array_join(F.transform(F.array_sort(F.map_entries(state)), lambda e: F.concat(e["key"], F.lit(" == "), e["value"].cast("string"))), " && ")
    return body if label is None else F.when(F.size(state) > 0, F.concat(F.lit(f"; {label}: "), body)).otherwise(F.lit(""))


def clock_seconds(text: Column) -> Column:
    """Seconds of an H:MM:SS.s text."""
    part = lambda k: F.regexp_extract(text, r"^(\d+):(\d{2}):(\d{2}(?:\.\d+)?)$", k)
    return F.when(part(1) != "", part(1).cast("double") * 3600 + part(2).cast("double") * 60 + part(3).cast("double"))


def amount(text: Column) -> Column:
    """A whole number with thousands separators."""
    return F.regexp_replace(text, ",", "").cast("long")


def numeric_first(name: str) -> list[Column]:
    """Sort keys: names of digits first, by value, then the others by text."""
    col = F.col(name)
    return [(~col.rlike(r"^\d+$")).asc(), F.when(col.rlike(r"^\d+$"), col.cast("decimal(38,0)")).asc(), col.asc()]


def fixed_order(col: Column, values: list[str]) -> Column:
    return F.array_position(F.array(*[F.lit(v) for v in values]), col)


def percent(value: Column, digits: int = 2) -> Column:
    return F.coalesce(F.concat(F.format_number(value * 100, digits), F.lit("%")), F.lit("—"))
