"""Translate warehouse-dialect SQL to Spark SQL text.

The text is cut into tokens and bracket groups, then rewritten in one walk: types, typed literals, function names
(``basalt.functions.templates``), array and struct syntax, UNNEST, QUALIFY, aggregate modifiers and NULL order.  All
else is left as it is; Spark parses, checks and optimises the result, and nothing here evaluates anything.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from basalt.functions.templates import TEMPLATES, fill

_TOKEN = re.compile(
    r"""(?P<ws>\s+|--[^\n]*|\#[^\n]*|/\*.*?\*/)
    |(?P<str>(?:[rR][bB]?|[bB][rR]?)?(?:'''(?:\\.|.)*?'''|\"\"\"(?:\\.|.)*?\"\"\"|'(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*"))
    |(?P<tick>`[^`]*`)
    |(?P<num>0[xX][0-9a-fA-F]+|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)
    |(?P<word>@@?[A-Za-z_][A-Za-z0-9_.]*|[A-Za-z_][A-Za-z0-9_]*)
    |(?P<op><=>|=>|->|<<|>>|<=|>=|<>|!=|\|\||.)""",
    re.X | re.S,
)

#: The dialect's types and Spark's.
TYPES = {"INT64": "BIGINT", "INTEGER": "BIGINT", "FLOAT64": "DOUBLE", "BOOL": "BOOLEAN", "BYTES": "BINARY", "NUMERIC": "DECIMAL(38,9)", "BIGNUMERIC": "DECIMAL(38,18)", "DATETIME": "TIMESTAMP_NTZ", "JSON": "STRING", "GEOGRAPHY": "STRING"}
_ENDS = {"ORDER", "LIMIT", "OFFSET", "UNION", "INTERSECT", "EXCEPT", "WINDOW", "HAVING", "QUALIFY", "WHERE", "GROUP", "ON"}
_JOINS = {"FROM", "JOIN", ","}
COMPARISONS = {"=", "<>", "!=", "<", "<=", ">", ">="}
#: Functions whose Spark form has a twin that gives NULL instead of an error.
SAFE_FORMS = {"PARSE_DATE": ("to_date", "try_to_date"), "PARSE_TIMESTAMP": ("to_timestamp", "try_to_timestamp"), "CONVERT_BYTES_TO_STRING": ("validate_utf8", "try_validate_utf8")}
#: Words before which an operand of a comparison ends.
_BEFORE = {"SELECT", "DISTINCT", "WHERE", "AND", "OR", "NOT", "ON", "THEN", "ELSE", "WHEN", "CASE", "HAVING", "QUALIFY", "BY", "RETURN", "SET", "IF", "LIMIT", ","}
_NOT_OPERANDS = {"SELECT", "FROM", "WHERE", "AND", "OR", "NOT", "IN", "ON", "BY", "THEN", "ELSE", "WHEN", "CASE", "AS", "RETURN", "LIKE", "BETWEEN", "DISTINCT", "ALL", "HAVING", "QUALIFY", "SET", "DEFAULT", "VALUES", "IS", "UNION", "LIMIT"}


@dataclass
class Tok:
    kind: str
    text: str
    at: int = -1  # where it begins and ends in the source
    end: int = -1

    @property
    def up(self) -> str:
        return self.text.upper() if self.kind == "word" else self.text


@dataclass
class Group:
    open: str
    items: list
    at: int = -1
    end: int = -1

    kind = "group"

    @property
    def up(self) -> str:
        return self.open


class DialectError(ValueError):
    """SQL that the dialect rejects or this translation does not cover."""


def tokens(sql: str) -> list:
    """Tokens with bracketed parts as groups."""
    stack: list[list] = [[]]
    opens: list[tuple[str, int]] = []
    for m in _TOKEN.finditer(sql):
        kind, text = m.lastgroup, m[0]
        if kind == "ws":
            continue
        if kind == "op" and text in "([":
            stack.append([])
            opens.append((text, m.start()))
        elif kind == "op" and text in ")]":
            if not opens or {"(": ")", "[": "]"}[opens[-1][0]] != text:
                raise DialectError(f"unbalanced {text!r}")
            items = stack.pop()
            stack[-1].append(Group(opens[-1][0], items, opens.pop()[1], m.end()))
        else:
            stack[-1].append(Tok(kind, text, m.start(), m.end()))
    if opens:
        raise DialectError(f"unclosed {opens[-1][0]!r}")
    return stack[0]


def split(items: list, at: str = ",") -> list[list]:
    """Items cut at a separator; no items, no parts."""
    out: list[list] = [[]]
    for x in items:
        if x.up == at:
            out.append([])
        else:
            out[-1].append(x)
    return out if out != [[]] else []


def _string(text: str) -> str:
    """A string literal of the dialect as one of Spark; byte strings as hexadecimal."""
    prefix = re.match(r"[rRbB]*", text)[0].lower()
    body = text[len(prefix) :]
    triple = body[:3] in ("'''", '"""')
    inner = body[3:-3] if triple else body[1:-1]
    if "b" in prefix:
        data = inner.encode() if "r" in prefix else inner.encode("latin1", "backslashreplace").decode("unicode_escape").encode("latin1")
        return f"X'{data.hex()}'"
    if "r" in prefix:
        return "r'" + inner + "'" if "'" not in inner else "'" + inner.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return "'" + re.sub(r"(?<!\\)'", r"\\'", inner).replace("\n", "\\n") + "'"


def _index(items: list, words: set[str], start: int = 0) -> int:
    return next((i for i in range(start, len(items)) if items[i].kind == "word" and items[i].up in words), len(items))


def type_text(items: list) -> str:
    """A type of the dialect in Spark's words."""
    out = []
    for i, x in enumerate(items):
        if x.kind == "word":
            following = items[i + 1] if i + 1 < len(items) else None
            if x.up in ("NUMERIC", "BIGNUMERIC") and isinstance(following, Group):
                out.append("DECIMAL")
            elif following is not None and following.kind == "word":
                out.append(x.text + ":")  # a field name before its type
            else:
                out.append(TYPES.get(x.up, x.text))
        elif isinstance(x, Group):
            if out[-1].upper() not in ("STRING", "BINARY"):
                out.append("(" + type_text(x.items) + ")")
        else:
            out.append(x.text)
    return " ".join(out)


def system_variable(name: str) -> str:
    """The session variable that stands for ``@@name``."""
    return "_" + name[2:].replace(".", "_").lower()


def _type_end(items: list, i: int) -> int:
    """Index after the ``<...>`` that begins at ``i``."""
    depth = 0
    while i < len(items):
        depth += {"<": 1, ">": -1, ">>": -2}.get(items[i].up, 0)
        i += 1
        if depth <= 0:
            return i
    raise DialectError("unclosed '<'")


class Translator:
    """One translation; ``walk`` turns items into text."""

    def __init__(self):
        self.names = 0

    def fresh(self, stem: str) -> str:
        self.names += 1
        return f"_{stem}{self.names}"

    def walk(self, items: list, in_window: bool = False) -> str:
        items = self._qualify(items)
        out: list[str] = []
        i = 0
        while i < len(items):
            i = self._one(items, i, out, in_window)
        return " ".join(out).replace(" . ", ".").replace(" .", ".")

    def _args(self, group: Group) -> list[str]:
        return [self.walk(a) for a in split(group.items)]

    def _qualify(self, items: list) -> list:
        at = _index(items, {"QUALIFY"})
        if at == len(items):
            return items
        start = max(i for i in range(at) if items[i].up == "SELECT")
        end = _index(items, {"WINDOW", "ORDER", "LIMIT", "UNION", "INTERSECT", "EXCEPT"}, at + 1)
        tail = end
        if end < len(items) and items[end].up == "WINDOW":
            tail = _index(items, {"ORDER", "LIMIT", "UNION", "INTERSECT", "EXCEPT"}, end)
        flag = self.fresh("qualify")
        body = start + 1
        from_at = _index(items, {"FROM"}, body)
        w = lambda t: Tok("word", t)
        inner = [w("SELECT"), *items[body:from_at], Tok("op", ","), Group("(", items[at + 1 : end]), w("AS"), w(flag), *items[from_at:at], *items[end:tail]]
        outer = [w("SELECT"), Tok("op", "*"), w("EXCEPT"), Group("(", [w(flag)]), w("FROM"), Group("(", inner), w("WHERE"), w(flag)]
        return items[:start] + outer + items[tail:]

    def _one(self, items: list, i: int, out: list[str], in_window: bool) -> int:
        x = items[i]
        nxt = items[i + 1] if i + 1 < len(items) else None
        if isinstance(x, Group):
            if x.open == "[":
                return self._bracket(x, i, out, items)
            window = i > 0 and (items[i - 1].up == "OVER" or (items[i - 1].up == "AS" and any(t.up == "WINDOW" for t in items[:i])))
            out.append("(" + self.walk(x.items, window) + ")")
            return i + 1
        if x.kind == "str":
            out.append(_string(x.text))
            return i + 1
        if x.kind == "tick":
            out.append(".".join(f"`{p}`" for p in x.text[1:-1].split(".")))
            return i + 1
        if x.kind != "word":
            out.append({"!=": "<>"}.get(x.text, x.text))
            return i + 1
        up = x.up
        if up.startswith("@@"):  # a system variable
            out.append(system_variable(x.text))
            return i + 1
        if up == "TABLESAMPLE" and nxt is not None and nxt.up in ("SYSTEM", "BERNOULLI", "RESERVOIR"):
            out.append("TABLESAMPLE")
            return i + 2
        if nxt is not None and nxt.kind == "str" and up in ("DATE", "TIMESTAMP", "TIME", "DATETIME", "NUMERIC", "BIGNUMERIC", "JSON"):
            lit = _string(nxt.text)
            out.append({"DATETIME": f"TIMESTAMP_NTZ{lit}", "NUMERIC": f"CAST({lit} AS DECIMAL(38,9))", "BIGNUMERIC": f"CAST({lit} AS DECIMAL(38,18))", "JSON": lit}.get(up, f"{up}{lit}"))
            return i + 2
        if up in ("ARRAY", "STRUCT", "RANGE") and nxt is not None and nxt.up == "<":
            return self._typed(items, i, out)
        if up == "ARRAY" and isinstance(nxt, Group):
            if nxt.open == "[":
                out.append(f"array({', '.join(self._args(nxt))})")
            else:
                col = self.fresh("c")
                out.append(f"(SELECT collect_list({col}) FROM ({self.walk(nxt.items)}) AS {self.fresh('t')}({col}))")
            return i + 2
        if up == "STRUCT" and isinstance(nxt, Group):
            out.append(self._struct(nxt))
            return i + 2
        if up in ("CAST", "SAFE_CAST") and isinstance(nxt, Group):
            at = max((j for j, t in enumerate(nxt.items) if t.up == "AS"), default=None)
            if at is None:
                raise DialectError("CAST needs AS")
            out.append(f"{'try_cast' if up == 'SAFE_CAST' else 'CAST'}({self.walk(nxt.items[:at])} AS {type_text(nxt.items[at + 1 :])})")
            return i + 2
        if up == "EXTRACT" and isinstance(nxt, Group):
            out.append(self._extract(nxt))
            return i + 2
        if up == "IN" and nxt is not None and nxt.up == "UNNEST":
            left = out.pop()
            negated = left == "NOT"
            if negated:
                left = out.pop()
            while out and out[-1].endswith(".") or left.startswith("."):
                left = out.pop() + left
            out.append(f"{'NOT ' if negated else ''}array_contains({self.walk(items[i + 2].items)}, {left})")
            return i + 3
        if up == "UNNEST" and isinstance(nxt, Group):
            return self._unnest(items, i, out)
        if up in ("ANY", "SOME", "ALL") and isinstance(nxt, Group) and i > 0 and items[i - 1].up in COMPARISONS:
            return self._quantified(up, nxt, i, out)
        if up == "AT" and [t.up for t in items[i + 1 : i + 3]] == ["TIME", "ZONE"] and i + 3 < len(items):
            moment = self._operand(out, _BEFORE | COMPARISONS | {"+", "-", "||", "AS", "IN", "BETWEEN"})
            out.append(f"CAST(from_utc_timestamp({moment}, {self.walk([items[i + 3]])}) AS TIMESTAMP_NTZ)")
            return i + 4
        if up == "ORDER" and nxt is not None and nxt.up == "BY" and not in_window:
            end = _index(items, {"LIMIT", "OFFSET", "UNION", "INTERSECT", "EXCEPT", "ROWS", "RANGE"}, i + 2)
            out.append("ORDER BY " + ", ".join(self._order(p) for p in split(items[i + 2 : end])))
            return end
        if up == "REPLACE" and isinstance(nxt, Group) and out and out[-1].endswith("*"):
            named = [(p[-1].text, self.walk(p[: _index(p, {"AS"})])) for p in split(nxt.items)]
            out.append(f"EXCEPT ({', '.join(n for n, _ in named)}), " + ", ".join(f"{v} AS {n}" for n, v in named))
            return i + 2
        if isinstance(nxt, Group) and nxt.open == "(" and up not in _NOT_OPERANDS and up not in ("OVER", "USING", "EXISTS", "ROLLUP", "CUBE", "SETS", "EXCEPT", "ANY", "SOME", "WITHIN", "FILTER", "TABLE", "INTO", "LATERAL", "INTERVAL", "UNION", "INTERSECT"):
            return self._call(up, x.text, nxt, items, i, out)
        if nxt is not None and nxt.up == "." and i + 3 < len(items) and isinstance(items[i + 3], Group) and items[i + 3].open == "(" and up in ("NET", "AEAD", "HLL_COUNT", "SAFE", "KEYS"):
            name = items[i + 2].up
            if up == "SAFE":
                return self._safe(name, items[i + 3], i + 2, out)
            return self._call(f"{up}.{name}", name, items[i + 3], items, i + 2, out)
        if up in TYPES and not (nxt is not None and nxt.up == ".") and not (i > 0 and items[i - 1].up == "."):
            out.append(TYPES[up])
            return i + 1
        out.append(x.text)
        return i + 1

    def _operand(self, out: list[str], before: set[str]) -> str:
        """The operand that ``out`` ends with, taken off."""
        at = len(out)
        while at and out[at - 1].upper() not in before:
            at -= 1
        text = " ".join(out[at:])
        del out[at:]
        return text

    def _quantified(self, up: str, group: Group, i: int, out: list[str]) -> int:
        """``x op ANY (..)`` and ``x op ALL (..)`` over a list, an array or, as IN and NOT IN, a subquery."""
        op = out.pop()
        left = self._operand(out, _BEFORE)
        form = {("=", True): "IN", ("<>", False): "NOT IN"}.get((op, up != "ALL"))
        array = len(group.items) == 2 and group.items[0].up == "UNNEST"
        if form and not array:  # a list that scans can be asked for, or a subquery
            out.append(f"{left} {form} ({self.walk(group.items)})")
            return i + 2
        if group.items and group.items[0].up in ("SELECT", "WITH"):
            raise DialectError(f"{op} {up} of a subquery is not supported")
        among = self.walk(group.items[1].items) if array else f"array({', '.join(self._args(group))})"
        e = self.fresh("e")
        out.append(f"{'forall' if up == 'ALL' else 'exists'}({among}, {e} -> {left} {op} {e})")
        return i + 2

    def _order(self, items: list) -> str:
        words = [t.up for t in items if t.kind == "word"]
        text = self.walk(items, True)
        if "NULLS" in words:
            return text
        return text + (" NULLS FIRST" if words and words[-1] == "DESC" else " NULLS LAST")

    def _bracket(self, x: Group, i: int, out: list[str], items: list) -> int:
        before = items[i - 1] if i else None
        operand = before is not None and (before.kind in ("tick", "group", "str") or (before.kind == "word" and before.up not in _NOT_OPERANDS))
        if not operand:
            out.append(f"array({', '.join(self._args(x))})")
            return i + 1
        name = x.items[0].up if x.items else ""
        if len(x.items) == 2 and isinstance(x.items[1], Group) and name in ("OFFSET", "ORDINAL", "SAFE_OFFSET", "SAFE_ORDINAL"):
            at = self.walk(x.items[1].items)
            base = out.pop()
            while out and (base.startswith(".") or out[-1] == "." or out[-1].endswith(".")):
                base = out.pop() + base
            out.append({"OFFSET": f"element_at({base}, CAST(({at}) + 1 AS INT))", "ORDINAL": f"element_at({base}, CAST({at} AS INT))", "SAFE_OFFSET": f"get({base}, CAST({at} AS INT))", "SAFE_ORDINAL": f"get({base}, CAST(({at}) - 1 AS INT))"}[name])
        else:
            out.append(f"[{self.walk(x.items)}]")
        return i + 1

    def _typed(self, items: list, i: int, out: list[str]) -> int:
        end = _type_end(items, i + 1)
        kind, inner = items[i].up, items[i + 2 : end - 1]
        value = items[end] if end < len(items) else None
        if kind == "RANGE" and value is not None and value.kind == "str":
            low, high = [p.strip() for p in _string(value.text)[2:-2].split(",")]
            t = type_text(inner)
            bound = lambda p: f"CAST(NULL AS {t})" if p.upper() in ("UNBOUNDED", "NULL") else f"CAST('{p}' AS {t})"
            out.append(f"named_struct('start', {bound(low)}, 'end', {bound(high)})")
            return end + 1
        if kind == "RANGE":
            out.append(f"STRUCT<start: {type_text(inner)}, end: {type_text(inner)}>")
            return end
        t = f"{kind}<{type_text(inner)}>"
        if isinstance(value, Group):
            made = f"array({', '.join(self._args(value))})" if kind == "ARRAY" else self._struct(value)
            out.append(f"CAST({made} AS {t})")
            return end + 1
        out.append(t)
        return end

    def _struct(self, group: Group) -> str:
        parts = []
        for n, p in enumerate(split(group.items)):
            at = _index(p, {"AS"})
            name = p[at + 1].text.strip("`") if at < len(p) else p[-1].text if p[-1].kind == "word" and (len(p) == 1 or p[-2].up == ".") else f"_field_{n + 1}"
            parts.append(f"'{name}', {self.walk(p[:at])}")
        return f"named_struct({', '.join(parts)})"

    def _extract(self, group: Group) -> str:
        at = _index(group.items, {"FROM"})
        part = "".join(t.up if not isinstance(t, Group) else "(" + t.items[0].up + ")" for t in group.items[:at])
        v = self.walk(group.items[at + 1 :])
        week = lambda first: f"CAST((dayofyear({v}) + 6 - ((dayofweek({v}) + 6 - {first}) % 7)) div 7 AS BIGINT)"
        days = ("SUNDAY", "MONDAY", "TUESDAY", "WEDNESDAY", "THURSDAY", "FRIDAY", "SATURDAY")
        if part == "WEEK":
            return week(0)
        if part.startswith("WEEK("):
            return week(days.index(part[5:-1]))
        fraction = {"MILLISECOND": 1000, "MICROSECOND": 1}
        if part == "NANOSECOND":  # Spark keeps microseconds
            return f"CAST(extract(SECOND FROM {v}) % 1 * 1000000000 AS BIGINT)"
        if part in fraction:
            return f"CAST((unix_micros(CAST({v} AS TIMESTAMP)) % 1000000) div {fraction[part]} AS BIGINT)"
        if part == "DATE":
            return f"CAST({v} AS DATE)"
        if part in ("TIME", "DATETIME"):
            return f"CAST({v} AS {'TIME' if part == 'TIME' else 'TIMESTAMP_NTZ'})"
        if part.startswith("TIMEZONE"):
            raise DialectError(f"cannot extract {part}")
        name = {"DAYOFWEEK": "dayofweek", "DAYOFYEAR": "dayofyear", "ISOWEEK": "weekofyear"}.get(part)
        if name:
            return f"CAST({name}({v}) AS BIGINT)"
        return f"CAST(extract({'YEAROFWEEK' if part == 'ISOYEAR' else part} FROM {v}) AS BIGINT)"

    def _safe(self, name: str, group: Group, i: int, out: list[str]) -> int:
        """``SAFE.f(...)``: NULL where ``f`` would fail; only for functions that have such a form."""
        if name not in SAFE_FORMS:
            raise DialectError(f"SAFE.{name} is not supported")
        plain, form = SAFE_FORMS[name]
        text = fill(TEMPLATES[name], self._args(group))
        if not text.startswith(plain + "("):
            raise DialectError(f"SAFE.{name} is not supported")
        out.append(form + text[len(plain) :])
        return i + 2

    def _call(self, up: str, name: str, group: Group, items: list, i: int, out: list[str]) -> int:
        if up in ("ARRAY_AGG", "STRING_AGG", "LISTAGG", "ARRAY_CONCAT_AGG"):
            out.append(self._aggregate(up, group))
            return i + 2
        if up in ("SUBSTR", "SUBSTRING") and _index(group.items, {"FROM"}) < len(group.items):
            group = Group("(", [Tok("op", ",") if t.kind == "word" and t.up in ("FROM", "FOR") else t for t in group.items])
        if up in ("IF", "IFNULL") or up not in TEMPLATES:
            out.append(f"{name}({self.walk(group.items)})")
        elif up in ("ANY_VALUE",) and group.items and group.items[0].up == "DISTINCT":
            out.append(f"first({self.walk(group.items[1:])}, true)")
        else:
            try:
                out.append(fill(TEMPLATES[up], self._args(group)))
            except ValueError as e:
                raise DialectError(f"{up}: {e}") from e
        return i + 2

    def _aggregate(self, up: str, group: Group) -> str:
        items = list(group.items)
        end = _index(items, {"IGNORE", "RESPECT", "ORDER", "LIMIT"})
        head, rest = items[:end], items[end:]
        limit = None
        at = _index(rest, {"LIMIT"})
        if at < len(rest):
            limit, rest = self.walk(rest[at + 1 :]), rest[:at]
        at = _index(rest, {"ORDER"})
        order = split(rest[at + 2 :]) if at < len(rest) else []
        ignore = any(t.up == "IGNORE" for t in rest[:at])
        distinct = bool(head) and head[0].up == "DISTINCT"
        args = [self.walk(a) for a in split(head[1:] if distinct else head)]
        if up in ("STRING_AGG", "LISTAGG"):
            sep = args[1] if len(args) > 1 else "','"
            value = args[0] if distinct else f"CAST({args[0]} AS STRING)"  # Spark orders a DISTINCT list by its own value
            by = f" WITHIN GROUP (ORDER BY {', '.join(self._order(o) for o in order)})" if order else ""
            return f"listagg({'DISTINCT ' if distinct else ''}{value}, {sep}){by}"
        value = args[0]
        if up == "ARRAY_CONCAT_AGG":
            made = f"flatten(collect_list({value}))"
        elif order:
            keys = [(self.walk([t for t in o if t.up not in ("ASC", "DESC")], True), o[-1].up == "DESC") for o in order]
            fields = ", ".join(f"{k} AS k{n}" for n, (k, _) in enumerate(keys))
            tests = " ".join(
                f"WHEN a.k{n} IS NULL AND b.k{n} IS NOT NULL THEN {-1 if down else 1} WHEN a.k{n} IS NOT NULL AND b.k{n} IS NULL THEN {1 if down else -1} WHEN a.k{n} < b.k{n} THEN {1 if down else -1} WHEN a.k{n} > b.k{n} THEN {-1 if down else 1}"
                for n, (_, down) in enumerate(keys)
            )
            made = f"transform(array_sort(collect_{'set' if distinct else 'list'}(struct({fields}, {value} AS v)), (a, b) -> CASE {tests} ELSE 0 END), e -> e.v)"
            if ignore:
                made = f"array_compact({made})"
        else:
            made = f"collect_{'set' if distinct else 'list'}({value})" if ignore or distinct else f"transform(collect_list(struct({value} AS v)), e -> e.v)"
        return f"slice({made}, 1, {limit})" if limit else made

    def _unnest(self, items: list, i: int, out: list[str]) -> int:
        parts = split(items[i + 1].items)
        j = i + 2
        alias = None
        if j < len(items) and items[j].up == "AS":
            j += 1
            alias = items[j].text
            j += 1
        elif j < len(items) and items[j].kind in ("word", "tick") and items[j].up not in _ENDS | {"WITH", "LEFT", "JOIN", "CROSS", "INNER", "RIGHT", "FULL"}:
            alias = items[j].text
            j += 1
        offset = None
        if j + 1 < len(items) and items[j].up == "WITH" and items[j + 1].up == "OFFSET":
            j += 2
            offset = "offset"
            if j < len(items) and items[j].up == "AS":
                j += 1
            if j < len(items) and items[j].kind == "word" and items[j].up not in _ENDS | {"LEFT", "JOIN", "CROSS"}:
                offset = items[j].text
                j += 1
        alias = alias or self.fresh("u")
        first = not out or out[-1].upper() == "FROM"
        outer = len(out) > 1 and out[-1].upper() == "JOIN" and any(w.upper() == "LEFT" for w in out[-3:])
        if len(parts) > 1:
            raise DialectError("UNNEST takes one array")
        f = ("posexplode" if offset else "explode") + ("_outer" if outer else "")
        lateral = "" if first else "LATERAL "
        out.append(f"{lateral}{f}({self.walk(parts[0])}) AS {self.fresh('x')}({offset + ', ' if offset else ''}{alias})")
        if outer and j < len(items) and items[j].up == "ON" and j + 1 < len(items) and items[j + 1].up == "TRUE":
            out.append("ON TRUE")
            j += 2
        return j


def translate(sql: str) -> str:
    """Spark SQL for one statement (or script) of the dialect."""
    return Translator().walk(tokens(sql.strip().rstrip(";")))
