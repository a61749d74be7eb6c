"""The engine: dialect statements against a Spark session and a store of mutable tables."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt import session as _session
from basalt.dialect import DialectError, Group, Tok, Translator, _index, split, tokens, type_text
from basalt.functions.udfs import register
from basalt.operators.gap_fill import gap_fill
from basalt.operators.relations import recursive_union
from basalt.operators.vectors import carries, measured_pairs, suits
from basalt.scripting import Block, Script, parse
from basalt.session import shared_folder
from basalt.sources import files
from basalt.sources.tables import MergeClause, TableStore


#: Words that may stand after a table without being its alias.
_CLAUSES = {"WHERE", "GROUP", "ORDER", "JOIN", "INNER", "LEFT", "RIGHT", "FULL", "CROSS", "NATURAL", "ON", "USING", "UNION", "INTERSECT", "EXCEPT", "LIMIT", "OFFSET", "HAVING", "QUALIFY", "WINDOW", "TABLESAMPLE", "PIVOT", "UNPIVOT"}


def _renamed(items: list, names: dict[str, str]) -> list:
    """Items with tables of these names replaced, in FROM clauses only; a table without an alias keeps its name as one."""
    out: list = []
    listed = False  # in a FROM clause, where a comma separates tables
    for i, x in enumerate(items):
        listed = x.up in ("FROM", "JOIN") or listed and x.up not in _CLAUSES - {"JOIN"} | {"SELECT"}
        if isinstance(x, Group):
            out.append(Group(x.open, _renamed(x.items, names), x.at, x.end))
        elif listed and x.kind in ("word", "tick") and x.text.strip("`").lower() in names and items[i - 1].up in ("FROM", "JOIN", ","):
            following = items[i + 1] if i + 1 < len(items) else None
            aliased = following is not None and following.kind in ("word", "tick") and following.up not in _CLAUSES
            new = Tok("tick", f"`{names[x.text.strip('`').lower()]}`")
            out += [new] if aliased else [new, Tok("word", "AS"), x]
        else:
            out.append(x)
    return out


class Engine:
    """Runs statements of the dialect.  Queries give lazy DataFrames; other statements act at once."""

    def __init__(self, spark: SparkSession | None = None, folder: str | None = None):
        self.spark = spark or _session()
        self.spark.conf.set("spark.sql.timeType.enabled", "true")
        register(self.spark)
        self.store = TableStore(self.spark, folder or f"{shared_folder(self.spark)}/tables-{uuid.uuid4().hex}")
        self.views: set[str] = set()
        self.schemas: set[str] = set()
        self.dropped: dict[str, dict] = {}
        self.default_texts: dict[str, dict[str, str]] = {}
        self.aggregates: dict[str, tuple[list[str], list]] = {}
        self.procedures: dict[str, tuple[list[tuple[str, str, str]], Block]] = {}
        self.scripts = Script(self)

    def sql(self, text: str, **args) -> DataFrame:
        """A query of the dialect as a DataFrame; ``args`` are named parameters (``@name``) or tables (``{name}``)."""
        tables = {k: v for k, v in args.items() if isinstance(v, DataFrame)}
        values = {k: v for k, v in args.items() if k not in tables}
        for name in tables:
            text = text.replace("{" + name + "}", f"`_arg_{name}`")
        plain = lambda items: self._run(items, values, tables)
        run = lambda items: self._vector_pairs(items, plain) or plain(items)
        return self._recursion(self._prepare(tokens(text.strip().rstrip(";"))), run)

    def _run(self, items: list, values: dict, tables: dict) -> DataFrame:
        out = self.walk(items)
        if values:
            out = re.sub(r"@(\w+)", r":\1", out)
        if tables:
            out = out.replace("{", "{{").replace("}", "}}")
        for name in tables:
            out = out.replace(f"`_arg_{name}`", "{" + name + "}")
        return self.spark.sql(out, args=values or None, **tables) if tables or values else self.spark.sql(out)

    def _recursion(self, items: list, run) -> DataFrame:
        """``run`` of a query; parts of WITH RECURSIVE that end in UNION [DISTINCT] with a step of their own are computed first.

        The rows of such a part stand in for its name; it may use the parts before it.  UNION ALL is left to Spark.
        """
        if [x.up for x in items[:2]] != ["WITH", "RECURSIVE"]:
            return run(items)
        kept, i, views = [], 2, {}
        while True:
            name, columns = items[i], items[i + 1] if isinstance(items[i + 1], Group) else None
            i += 2 + (columns is not None)
            body = _renamed(items[i].items, views)
            at = next((j for j, x in enumerate(body) if x.up == "UNION" and j + 1 < len(body) and body[j + 1].up != "ALL"), None)
            start = at is not None and at + 1 + (body[at + 1].up == "DISTINCT")
            key = name.text.strip("`").lower()
            if at is None or _renamed(body[start:], {key: ""}) == body[start:]:
                kept.append([name, *([columns] if columns else []), Tok("word", "AS"), Group("(", body)])
            else:
                before = [*items[:2], *(x for k in kept for x in [Tok("op", ","), *k])]
                before = [*before[:2], *before[3:]] if kept else []
                seed = run([*before, *body[:at]])
                names = [c[0].text.strip("`") for c in split(columns.items)] if columns else seed.columns
                view = f"_recursive_{uuid.uuid4().hex}"

                def step(newest: DataFrame, view=view, key=key, rest=body[start:], before=before, names=names) -> DataFrame:
                    newest.createOrReplaceTempView(view)
                    return run([*before, *_renamed(rest, {key: view})]).toDF(*names)

                recursive_union(seed.toDF(*names), step).createOrReplaceTempView(view)
                views[key] = view
            i += 1
            if i >= len(items) or items[i].up != ",":
                break
            i += 1
        parts = [x for k in kept for x in [Tok("op", ","), *k]][1:]
        out = run([*(items[:2] + parts if kept else []), *_renamed(items[i:], views)])
        for view in views.values():
            self.spark.catalog.dropTempView(view)
        return out

    def _vector_pairs(self, items: list, run) -> DataFrame | None:
        """A query for the rounded distances of all pairs of two tables' vectors by blocks; nothing if ``items`` is another query.

        It is ``SELECT a.c [AS name], ROUND(COSINE_DISTANCE(a.x, b.y), 5) [AS name], .. FROM t AS a CROSS JOIN u AS b``, in
        which t and u are names or subqueries.
        """
        shape = lambda part: [x.up if x.kind in ("word", "op") else x.kind for x in part]
        at = _index(items, {"FROM"})
        if not items or items[0].up != "SELECT" or shape(items[at:]) not in [["FROM", s, "AS", items[at + 3].up, "CROSS", "JOIN", t, "AS", items[-1].up] for s in ("tick", "group") for t in ("tick", "group") if len(items) == at + 9]:
            return None
        names = [items[at + 3].up, items[-1].up]
        side = lambda part: "ab"[names.index(part[0].up)] if len(part) == 3 and part[0].up in names and part[1].up == "." and part[2].kind == "word" else None
        columns, measures, vectors, out = [], [], set(), []
        for k, part in enumerate(split(items[1:at])):
            part, name = (part[:-2], part[-1].text) if len(part) > 2 and part[-2].up == "AS" and part[-1].kind == "word" else (part, None)
            if side(part):
                columns.append((side(part), part[2].text, f"k{k}"))
                out.append((f"k{k}", name or part[2].text))
                continue
            parts = split(part[1].items) if shape(part) == ["ROUND", "group"] else []
            if not name or [shape(p) for p in parts] not in [[[f, "group"], ["num"]] for f in ("COSINE_DISTANCE", "EUCLIDEAN_DISTANCE")] or parts[1][0].text not in "0123456":
                return None
            pair = split(parts[0][1].items)
            if [side(p) for p in pair] != ["a", "b"]:
                return None
            vectors.add(tuple(p[2].text for p in pair))
            out.append((f"_{len(measures)}", name))
            measures.append((parts[0][0].up, int(parts[1][0].text)))
        if names[0] == names[1] or len(vectors) != 1:
            return None
        frames = [run(x.items) if isinstance(x, Group) else run([Tok("word", "SELECT"), Tok("op", "*"), Tok("word", "FROM"), x]) for x in (items[at + 1], items[at + 6])]
        ((x, y),) = vectors
        fields = [{f.name.lower(): f.dataType for f in df.schema} for df in frames]
        kinds = [fields["ab".index(s)].get(c.lower()) for s, c, _ in columns]
        if any(len(set(map(str.lower, df.columns))) < len(df.columns) for df in frames) or not all(map(carries, kinds)) or not (suits(fields[0].get(x.lower())) and suits(fields[1].get(y.lower()))):
            return None
        pairs = measured_pairs(*frames, (x, y), columns, measures)
        return pairs.select(*[F.col(c).alias(name) for c, name in out])

    def walk(self, items: list) -> str:
        """Spark SQL for prepared items."""
        return Translator().walk(items)

    def execute(self, text: str) -> DataFrame | int | None:
        """One statement: a query's DataFrame, a DML statement's row count, or nothing."""
        text = text.strip().rstrip(";")
        items = self._prepare(tokens(text))
        if not items:
            raise DialectError("empty statement")
        words = [t.up for t in items[:5]]
        for names, run in self._statements():
            if tuple(words[: len(names)]) == names:
                return run(items, text)
        plain = lambda q: self.spark.sql(self.walk(q))
        return self._recursion(items, lambda q: self._vector_pairs(q, plain) or plain(q))

    def script(self, text: str) -> list:
        """Several statements with variables, blocks, loops and handlers; what the queries and DML among them gave.

        Each statement goes through :meth:`execute`, so DML in a script is DML on the store.
        """
        return self.scripts.run(parse(text))

    # Names

    def _prepare(self, items: list) -> list:
        """Qualified names as single ones, aggregate functions of SQL as their bodies, GAP_FILL in FROM as a view."""
        out: list = []
        i = 0
        while i < len(items):
            x = items[i]
            if isinstance(x, Group):
                out.append(Group(x.open, self._prepare(x.items), x.at, x.end))
                i += 1
                continue
            nxt = items[i + 1] if i + 1 < len(items) else None
            before = out[-1].up if out else ""
            if x.kind == "word" and isinstance(nxt, Group) and x.text.lower() in self.aggregates and before not in ("FUNCTION", "EXISTS"):
                names, body = self.aggregates[x.text.lower()]
                given = dict(zip(names, split(self._prepare(nxt.items))))
                out.append(Group("(", _substitute(body, given)))
                i += 2
                continue
            if x.up == "GAP_FILL" and isinstance(nxt, Group) and before in ("FROM", "JOIN", ","):
                out.append(Tok("word", self._gap_fill(self._prepare(nxt.items)), x.at, nxt.end))
                i += 2
                continue
            parts, j = [x.text.strip("`")], i + 1
            if x.kind in ("word", "tick") and not x.text.startswith("@"):
                while j + 1 < len(items) and items[j].up == "." and items[j + 1].kind in ("word", "tick"):
                    parts.append(items[j + 1].text.strip("`"))
                    j += 2
                parts = [p for whole in parts for p in whole.split(".")]
            made = _view_name(parts)
            naming = before in ("TABLE", "VIEW", "EXISTS", "CLONE", "TO") or (before == "INTO" and len(parts) > 1)
            if len(parts) > 1 and (made.lower() in self.store.tables or made.lower() in self.views or naming):
                out.append(Tok("word", made, x.at, items[j - 1].end))
                follows = items[j] if j < len(items) else None
                plain = follows is None or isinstance(follows, Group) or follows.up in _AFTER_TABLE or follows.kind == "op"
                if before in ("FROM", "JOIN", ",") and plain and out[0].up not in ("DELETE",):
                    out += [Tok("word", "AS"), Tok("word", parts[-1])]
                i = j
                continue
            out.append(x)
            i += 1
        return out

    def _gap_fill(self, items: list) -> str:
        """A view of ``GAP_FILL(TABLE t | (query), ts_column => .., bucket_width => .., ...)``."""
        parts = split(items)
        first = parts[0][1:] if parts[0][0].up == "TABLE" else parts[0]
        df = self.spark.sql("SELECT * FROM " + self.walk(first))
        named = {p[0].text.lower(): p[2:] for p in parts[1:]}
        unit = {"DAY": 86_400_000_000, "HOUR": 3_600_000_000, "MINUTE": 60_000_000, "SECOND": 1_000_000, "MILLISECOND": 1000, "MICROSECOND": 1}
        width = named["bucket_width"]
        text = lambda t: t.text.strip("'\"")
        pairs = [split(g.items) for g in next((t for t in named.get("value_columns", []) if isinstance(t, Group)), Group("[", [])).items if isinstance(g, Group)]
        values = {text(v[0][0]): text(v[1][0]) for v in pairs}
        keys = [text(t) for g in named.get("partitioning_columns", []) if isinstance(g, Group) for t in g.items if t.kind == "str"]
        origin = {"origin": text(named["origin"][-1])} if "origin" in named else {}
        view = "_gap_" + uuid.uuid4().hex[:12]
        gap_fill(df, text(named["ts_column"][0]), int(text(width[1])) * unit[width[2].up], values, keys, **origin).createOrReplaceTempView(view)
        return view

    def _statements(self):
        # The longest names come first, so that CREATE TABLE FUNCTION is not taken for CREATE TABLE.
        return sorted(self._handlers(), key=lambda h: -len(h[0]))

    def _handlers(self):
        return [
            (("CREATE", "SNAPSHOT", "TABLE"), self._snapshot), (("DROP", "SNAPSHOT", "TABLE"), self._drop), (("CREATE", "TABLE"), self._create), (("CREATE", "OR", "REPLACE", "TABLE"), self._create), (("CREATE", "TEMP", "TABLE"), self._create),
            (("DROP", "TABLE"), self._drop), (("TRUNCATE", "TABLE"), lambda i, t: self.store.truncate(i[2].text.strip("`"))), (("INSERT",), self._insert), (("UPDATE",), self._update), (("DELETE",), self._delete), (("MERGE",), self._merge),
            (("ALTER", "TABLE"), self._alter), (("BEGIN", "TRANSACTION"), lambda i, t: self.store.begin()), (("COMMIT",), lambda i, t: self.store.commit()), (("ROLLBACK",), lambda i, t: self.store.rollback()),
            (("GRANT",), lambda i, t: None), (("REVOKE",), lambda i, t: None), (("ASSERT",), self._assert), (("EXPORT", "DATA"), self._export), (("LOAD", "DATA"), self._load),
            (("CREATE", "SCHEMA"), self._schema), (("DROP", "SCHEMA"), self._drop_schema), (("UNDROP", "SCHEMA"), self._undrop_schema), (("DROP", "VIEW"), self._drop_view),
            (("CREATE", "TABLE", "FUNCTION"), self._table_function), (("CREATE", "OR", "REPLACE", "TABLE", "FUNCTION"), self._table_function), (("CREATE", "AGGREGATE", "FUNCTION"), self._aggregate), (("CREATE", "TEMP", "AGGREGATE", "FUNCTION"), self._aggregate), (("CREATE", "OR", "REPLACE", "AGGREGATE", "FUNCTION"), self._aggregate),
            (("CREATE", "FUNCTION"), self._function), (("CREATE", "TEMP", "FUNCTION"), self._function), (("CREATE", "OR", "REPLACE", "FUNCTION"), self._function), (("CREATE", "VIEW"), self._view), (("CREATE", "OR", "REPLACE", "VIEW"), self._view),
            (("CREATE", "PROCEDURE"), self._procedure), (("CREATE", "OR", "REPLACE", "PROCEDURE"), self._procedure), (("CALL",), self._call), (("EXPLAIN",), lambda i, t: self.spark.sql("EXPLAIN FORMATTED " + self.walk(i[1 + (i[1].up == "ANALYZE") :]))),
        ]

    # Tables

    def _create(self, items, text):
        at = _index(items, {"TABLE"}) + 1
        words = {t.up for t in items[:at]}
        exists = items[at].up == "IF"
        at += 3 * exists
        name, rest = items[at].text.strip("`"), items[at + 1 :]
        replace = "REPLACE" in words
        as_at = _index(rest, {"AS"})
        if as_at < len(rest):
            if exists and name.lower() in self.store.tables:
                return None
            return self.store.create_as(name, self.spark.sql(Translator().walk(rest[as_at + 1 :])), replace)
        columns, required, defaults, texts = [], set(), {}, {}
        for c in split(rest[0].items):
            if c[0].up in ("PRIMARY", "FOREIGN", "CONSTRAINT", "CHECK", "UNIQUE"):
                continue
            end = _index(c, {"NOT", "DEFAULT", "PRIMARY", "UNIQUE", "OPTIONS", "REFERENCES", "COLLATE"}, 1)
            columns.append(f"{c[0].text} {type_text(c[1:end])}")
            if _index(c, {"NOT"}, 1) < len(c):
                required.add(c[0].text)
            d = _index(c, {"DEFAULT"}, 1)
            if d < len(c):
                stop = _index(c, {"NOT", "PRIMARY", "UNIQUE", "OPTIONS"}, d)
                texts[c[0].text.lower()] = Translator().walk(c[d + 1 : stop])
                defaults[c[0].text] = F.expr(texts[c[0].text.lower()])
        if replace or name.lower() not in self.store.tables:
            self.default_texts[name.lower()] = texts
        self.store.create(name, ", ".join(columns), replace, exists, required, defaults)

    def _drop(self, items, text):
        at = _index(items, {"TABLE"}) + 1
        exists = items[at].up == "IF"
        for part in split(items[at + 2 * exists :]):
            self.store.drop(part[0].text, exists)

    def _snapshot(self, items, text):
        at = _index(items, {"TABLE"}) + 1
        exists = items[at].up == "IF"
        self.store.snapshot(items[at + 3 * exists].text, items[_index(items, {"CLONE"}) + 1].text, exists)

    def _insert(self, items, text):
        at = 1 + (items[1].up == "INTO")
        name, at = items[at].text, at + 1
        columns = None
        if isinstance(items[at], Group):
            columns = [c[0].text for c in split(items[at].items)]
            at += 1
        if items[at].up == "VALUES":
            body = self._values(name, columns, split(items[at + 1 :]))
        else:
            body = Translator().walk(items[at:])
        return self.store.insert(name, self.spark.sql(body), columns)

    def _values(self, name: str, columns: list[str] | None, rows: list) -> str:
        """Rows of VALUES as a query, with each DEFAULT written out."""
        names = [c.lower() for c in columns or self.store.read(name).columns]
        texts, made = self.default_texts.get(name.lower(), {}), []
        for row in rows:
            parts = split(row[0].items)
            if len(parts) != len(names):
                raise ValueError(f"{len(parts)} values for {len(names)} columns")
            made.append([f"({texts.get(n, 'NULL')})" if [t.up for t in v] == ["DEFAULT"] else self.walk(v) for n, v in zip(names, parts)])
        return " UNION ALL ".join("SELECT " + ", ".join(f"{v} AS c{i}" for i, v in enumerate(r)) for r in made)

    def _assignments(self, items, table: str | None = None, aliases: tuple[str, ...] = ()) -> dict:
        """Expressions by target column; a field of a struct by its dotted name, a leading alias taken off."""
        out = {}
        for a in split(items):
            eq = next(i for i, t in enumerate(a) if t.up == "=")
            path = [t.text.strip("`") for t in a[:eq] if t.up != "."]
            if len(path) > 1 and path[0].lower() in aliases:
                path = path[1:]
            default = [t.up for t in a[eq + 1 :]] == ["DEFAULT"]
            out[".".join(path)] = F.expr(self.default_texts.get((table or "").lower(), {}).get(path[0].lower(), "NULL") if default else Translator().walk(a[eq + 1 :]))
        return out

    def _update(self, items, text):
        name, s = items[1].text, _index(items, {"SET"})
        f, w = _index(items, {"FROM"}, s), _index(items, {"WHERE"}, s)
        own = {name.lower(), items[s - 1].text.lower()}
        drop = lambda ts: [Group(t.open, drop(t.items)) if isinstance(t, Group) else t for i, t in enumerate(ts) if not (_leads(ts, i, own) or (i and t.up == "." and _leads(ts, i - 1, own)))]
        where = items[w + 1 :]
        if f < len(items):  # an update from another table is a merge
            source = self.spark.sql("SELECT * FROM " + Translator().walk(items[f + 1 : w]))
            side = items[w - 1].text
            own = items[s - 1].text
            named = lambda ts: [Tok("word", {own: "t", side: "s", name: "t"}.get(t.text, t.text)) if t.kind == "word" and ts[i + 1 : i + 2] and ts[i + 1].up == "." else t for i, t in enumerate(ts)]
            sets = self._assignments(named(items[s + 1 : f]), name, ("t",))
            return self.store.merge(name, source, F.expr(Translator().walk(named(where))), [MergeClause("matched", "update", sets)])
        # Without a second table the alias says nothing.
        values = self._assignments(drop(items[s + 1 : w]), name)
        return self.store.update(name, values, F.expr(Translator().walk(drop(where))) if where else None)

    def _delete(self, items, text):
        at = 1 + (items[1].up == "FROM")
        w = _index(items, {"WHERE"})
        return self.store.delete(items[at].text, F.expr(Translator().walk(items[w + 1 :])))

    def _merge(self, items, text):
        at = 1 + (items[1].up == "INTO")
        using, on = _index(items, {"USING"}), _index(items, {"ON"})
        name = items[at].text
        alias = items[using - 1].text
        src = items[using + 1 : on]
        s_alias = src[-1].text if not isinstance(src[-1], Group) else "s"
        body = src[:-1] if len(src) > 1 else src
        body = body[:-1] if body[-1].up == "AS" else body
        source = self.spark.sql("SELECT * FROM " + Translator().walk(body))

        def named(ts):
            out = []
            for i, t in enumerate(ts):
                if isinstance(t, Group):
                    out.append(Group(t.open, named(t.items)))
                elif t.kind == "word" and i + 1 < len(ts) and ts[i + 1].up == ".":
                    out.append(Tok("word", {alias.lower(): "t", name.lower(): "t", s_alias.lower(): "s"}.get(t.text.lower(), t.text)))
                else:
                    out.append(t)
            return out

        whens = [i for i, t in enumerate(items) if t.up == "WHEN"]
        clauses = []
        for a, b in zip(whens, [*whens[1:], len(items)]):
            part = items[a:b]
            then = _index(part, {"THEN"})
            head = [t.up for t in part[:then]]
            kind = "matched" if "NOT" not in head[:2] else "not_matched_by_source" if "SOURCE" in head else "not_matched"
            cond = _index(part, {"AND"})
            condition = F.expr(Translator().walk(named(part[cond + 1 : then]))) if cond < then else None
            act = part[then + 1 :]
            if act[0].up == "DELETE":
                clauses.append(MergeClause(kind, "delete", {}, condition))
            elif act[0].up == "UPDATE":
                sets = self._assignments(named(act[2:]), name, ("t",))
                clauses.append(MergeClause(kind, "update", sets, condition))
            elif len(act) > 1 and act[1].up == "ROW":
                clauses.append(MergeClause(kind, "insert", {c: F.col(f"s.{c}") for c in source.columns}, condition))
            else:
                names = [c[0].text for c in split(act[1].items)] if isinstance(act[1], Group) else self.store.read(name).columns
                groups = [t for t in act if isinstance(t, Group)]
                exprs = [F.expr(Translator().walk(named(v) if len(v) > 1 else [Tok("word", "s"), Tok("op", "."), v[0]] if v[0].kind == "word" and v[0].up not in ("NULL", "TRUE", "FALSE") else v)) for v in split(groups[-1].items)]
                clauses.append(MergeClause(kind, "insert", dict(zip(names, exprs)), condition))
        self.store.merge(name, source, F.expr(Translator().walk(named(items[on + 1 : whens[0]]))), clauses)

    def _alter(self, items, text):
        name, rest = items[2].text, items[3:]
        for a in split(rest):
            w = [t.up for t in a]
            if w[:2] == ["ADD", "COLUMN"]:
                exists = w[2] == "IF"
                a = a[:2] + a[5:] if exists else a
                d = _index(a, {"DEFAULT", "NOT", "OPTIONS"}, 3)
                self.store.add_column(name, a[2].text, type_text(a[3:d]), F.expr(Translator().walk(a[d + 1 :])) if d < len(a) and a[d].up == "DEFAULT" else None, exists)
            elif w[:2] == ["DROP", "COLUMN"]:
                self.store.drop_column(name, a[-1].text)
            elif w[:2] == ["RENAME", "COLUMN"]:
                self.store.rename_column(name, a[2].text, a[4].text)
            elif w[:2] == ["RENAME", "TO"]:
                self.store.rename(name, a[2].text)
            elif w[:2] == ["ALTER", "COLUMN"] and "TYPE" in w:
                self.store.alter_type(name, a[2].text, type_text(a[w.index("TYPE") + 1 :]))
            elif w[:2] == ["ALTER", "COLUMN"] and w[3:] in (["SET", "NOT", "NULL"], ["DROP", "NOT", "NULL"]):
                self.store.require(name, a[2].text, w[3] == "SET")
            elif w[:2] == ["ALTER", "COLUMN"] and w[3:5] == ["SET", "DEFAULT"]:
                made = self.walk(a[5:])
                self.store.set_default(name, a[2].text, F.expr(made))
                self.default_texts.setdefault(name.lower(), {})[a[2].text.lower()] = made
            elif w[:2] == ["ALTER", "COLUMN"] and w[3:5] == ["DROP", "DEFAULT"]:
                self.store.set_default(name, a[2].text, None)
                self.default_texts.get(name.lower(), {}).pop(a[2].text.lower(), None)
            elif w[:2] not in (["SET", "OPTIONS"], ["ADD", "CONSTRAINT"], ["ADD", "PRIMARY"], ["ADD", "FOREIGN"], ["DROP", "CONSTRAINT"], ["DROP", "PRIMARY"]) and w[3:5] != ["SET", "OPTIONS"]:
                raise DialectError(f"ALTER TABLE {' '.join(w)} is not supported")

    # Everything else

    def _assert(self, items, text):
        end = _index(items, {"AS"})
        ok = self.spark.sql(f"SELECT {Translator().walk(items[1:end])} AS ok").first().ok
        if ok is not True:
            raise AssertionError(Translator().walk(items[end + 1 :]) if end < len(items) else "assertion failed")

    def _options(self, group: Group) -> dict[str, object]:
        out = {}
        for p in split(group.items):
            v = p[2]
            out[p[0].text.lower()] = [t.text[1:-1] for t in v.items if t.kind == "str"] if isinstance(v, Group) else v.text[1:-1] if v.kind == "str" else v.up == "TRUE" if v.up in ("TRUE", "FALSE") else int(v.text)
        return out

    def _export(self, items, text):
        o = self._options(next(t for t in items if isinstance(t, Group)))
        df = self.spark.sql(Translator().walk(items[_index(items, {"AS"}) + 1 :]))
        files.export(df, o["uri"], o.get("format", "PARQUET"), bool(o.get("overwrite")), bool(o.get("header", True)), o.get("field_delimiter", ","))

    def _load(self, items, text):
        name = items[3].text
        o = self._options(next(t for t in items[_index(items, {"FILES"}) :] if isinstance(t, Group)))
        schema = self.store.read(name).schema
        rows = files.load(self.spark, o["uris"], o.get("format", "PARQUET"), schema, o.get("field_delimiter", ","), o.get("skip_leading_rows", 0), o.get("null_marker", ""))
        if items[2].up == "OVERWRITE":
            self.store.truncate(name)
        return self.store.insert(name, rows)

    # Schemas and views

    def _schema(self, items, text):
        at = 2 + 3 * (items[2].up == "IF")
        name = items[at].text.strip("`").split(".")[-1].lower()
        if name in self.schemas and at == 2:
            raise ValueError(f"schema {name} exists")
        self.schemas.add(name)

    def _drop_schema(self, items, text):
        exists = items[2].up == "IF"
        name = items[2 + 2 * exists].text.strip("`").split(".")[-1].lower()
        if name not in self.schemas:
            if exists:
                return
            raise KeyError(f"schema {name} does not exist")
        inside = {t: v for t, v in self.store.tables.items() if t.startswith(name + "__")}
        if inside and items[-1].up != "CASCADE":
            raise ValueError(f"schema {name} is not empty")
        for t in inside:
            self.store.drop(t)
        self.dropped[name] = inside
        self.schemas.discard(name)

    def _undrop_schema(self, items, text):
        name = items[-1].text.strip("`").split(".")[-1].lower()
        if name in self.schemas:
            if items[2].up == "IF":
                return
            raise ValueError(f"schema {name} exists")
        for t, v in self.dropped.pop(name).items():
            self.store._point(t, v)
        self.schemas.add(name)

    def _view(self, items, text):
        at = _index(items, {"VIEW"}) + 1
        exists = items[at].up == "IF"
        at += 3 * exists
        name = items[at].text.strip("`")
        if name.lower() in self.views and items[1].up != "OR":
            if exists:
                return
            raise ValueError(f"view {name} exists")
        df = self.spark.sql(self.walk(items[_index(items, {"AS"}) + 1 :]))
        if isinstance(items[at + 1], Group):
            df = df.toDF(*[c[0].text for c in split(items[at + 1].items)])
        df.createOrReplaceTempView(name)
        self.views.add(name.lower())

    def _drop_view(self, items, text):
        exists = items[2].up == "IF"
        name = items[2 + 2 * exists].text.strip("`")
        if name.lower() not in self.views and not exists:
            raise KeyError(f"view {name} does not exist")
        self.views.discard(name.lower())
        self.spark.catalog.dropTempView(name)

    # Functions and procedures

    def _known(self, items, at: int) -> tuple[int, bool]:
        """Where a function's name stands, and whether IF NOT EXISTS says to leave the one there is."""
        exists = items[at].up == "IF"
        at += 3 * exists
        return at, exists and self.spark.catalog.functionExists(items[at].text)

    def _table_function(self, items, text):
        at, done = self._known(items, _index(items, {"FUNCTION"}) + 1)
        if done:
            return
        body = items[_index(items, {"AS"}) + 1 :]
        body = body[0].items if len(body) == 1 and isinstance(body[0], Group) else body
        args = ", ".join(f"{p[0].text} {type_text(p[1:])}" for p in split(items[at + 1].items))
        self.spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {items[at].text}({args}) RETURNS TABLE RETURN {self.walk(body)}")

    def _aggregate(self, items, text):
        at = _index(items, {"FUNCTION"}) + 1
        exists = items[at].up == "IF"
        at += 3 * exists
        name = items[at].text.lower()
        if exists and name in self.aggregates:
            return
        body = items[max(i for i, t in enumerate(items) if t.up == "AS") + 1 :]
        self.aggregates[name] = ([p[0].text for p in split(items[at + 1].items)], body)

    def _function(self, items, text):
        at, done = self._known(items, _index(items, {"FUNCTION"}) + 1)
        if done:
            return
        name, params = items[at].text, items[at + 1]
        lang = _index(items, {"LANGUAGE"})
        if lang < len(items):
            if items[lang + 1].up != "PYTHON":
                raise DialectError(f"functions in {items[lang + 1].up} are not supported")
            returns = type_text(items[_index(items, {"RETURNS"}) + 1 : lang])
            code: dict = {}
            exec(re.sub(r"^r?['\"]{1,3}|['\"]{1,3}$", "", items[-1].text), code)  # noqa: S102 - the statement's own code
            handler = next((o for o in re.findall(r"entry_point\s*=\s*['\"](\w+)", text)), name)
            self.spark.udf.register(name, F.udf(code[handler], returns, useArrow=True))
            return
        args = ", ".join(f"{p[0].text} {type_text(p[1:])}" for p in split(params.items))
        as_at = max(i for i, t in enumerate(items) if t.up == "AS")
        r = _index(items, {"RETURNS"})
        returns = f" RETURNS {type_text(items[r + 1 : as_at])}" if r < as_at else ""
        self.spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}){returns} RETURN {Translator().walk(items[as_at + 1 :])}")

    def _procedure(self, items, text):
        at = _index(items, {"PROCEDURE"}) + 1
        if items[at].up == "IF":
            at += 3
            if items[at].text.lower() in self.procedures:
                return
        params = []
        for p in split(items[at + 1].items):
            mode = p[0].up if p[0].up in ("IN", "OUT", "INOUT") else "IN"
            p = p[1:] if p[0].up == mode else p
            params.append((mode, p[0].text, type_text(p[1:])))
        self.procedures[items[at].text.lower()] = (params, parse(text[re.search(r"\bBEGIN\b", text, re.I).start() :]))

    def _call(self, items, text):
        params, body = self.procedures[items[1].text.lower()]
        given = split(items[2].items)
        if len(given) != len(params):
            raise ValueError(f"{len(given)} arguments for {len(params)} parameters")
        found = self.scripts.call(params, given, body)
        return found[-1] if found else None

    def gap_fill(self, *args, **kwargs) -> DataFrame:
        return gap_fill(*args, **kwargs)


_AFTER_TABLE = {"WHERE", "GROUP", "ORDER", "LIMIT", "JOIN", "LEFT", "RIGHT", "INNER", "FULL", "CROSS", "ON", "USING", "UNION", "EXCEPT", "INTERSECT", "HAVING", "QUALIFY", "WINDOW", "TABLESAMPLE", "WHEN", "PIVOT", "UNPIVOT"}


def _view_name(parts: list[str]) -> str:
    """A table's name in Spark; of a qualified one the schema and the table, for there is one project."""
    return parts[0] if len(parts) == 1 else "__".join(re.sub(r"\W", "_", p) for p in parts[-2:])


def _leads(items: list, i: int, names: set[str]) -> bool:
    """Whether item ``i`` is one of ``names`` before a dot."""
    return items[i].kind in ("word", "tick") and items[i].text.strip("`").lower() in names and i + 1 < len(items) and items[i + 1].up == "."


def _substitute(items: list, given: dict[str, list]) -> list:
    """Items with words replaced by bracketed items; literals and names after a dot stay."""
    low, out = {k.lower(): v for k, v in given.items()}, []
    for i, t in enumerate(items):
        if isinstance(t, Group):
            out.append(Group(t.open, _substitute(t.items, given)))
        elif t.kind == "word" and t.text.lower() in low and not (i and items[i - 1].up == "."):
            out.append(Group("(", low[t.text.lower()]))
        else:
            out.append(t)
    return out


def main(argv: list[str]) -> int:
    """``python -m basalt.engine query "SELECT ..."`` prints a table."""
    if len(argv) != 2 or argv[0] != "query":
        print('usage: python -m basalt.engine query "SELECT ..."')
        return 2
    Engine(_session("local[*]")).sql(argv[1]).show(1000, False)
    return 0


if __name__ == "__main__":
    import sys

    raise SystemExit(main(sys.argv[1:]))
