"""Scripts of the dialect: variables, branches, loops, handlers and procedure calls.

A script is parsed to a tree and its control flow runs on the driver, as it must; the statements in it go through the
engine one by one, so queries stay Spark plans and DML changes the store's tables.  Variables are Spark session
variables: a column of the same name hides one, as the dialect has it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from basalt.dialect import DialectError, Group, Tok, _index, split, tokens, type_text


class Leave(Exception):
    """BREAK or LEAVE."""


class Again(Exception):
    """CONTINUE or ITERATE."""


class Return(Exception):
    """RETURN."""


class RaisedError(RuntimeError):
    """RAISE in a script."""


@dataclass
class Node:
    kind: str
    items: list = field(default_factory=list)
    text: str = ""
    bodies: list = field(default_factory=list)


@dataclass
class Block:
    nodes: list[Node]
    handler: list[Node] | None = None


def parse(text: str) -> Block:
    """The statements of a script."""
    items = tokens(text)
    nodes, at = _Parser(text).many(items, 0, set())
    if at < len(items):
        raise DialectError(f"unexpected {items[at].up}")
    return Block(nodes)


class _Parser:
    def __init__(self, text: str):
        self.text = text

    def many(self, items: list, i: int, stops: set[str]) -> tuple[list[Node], int]:
        out = []
        while i < len(items):
            if items[i].up == ";":
                i += 1
            elif items[i].kind == "word" and items[i].up in stops:
                return out, i
            else:
                node, i = self.one(items, i)
                out.append(node)
        if stops:
            raise DialectError(f"{' or '.join(sorted(stops))} is missing")
        return out, i

    def until(self, items: list, i: int, word: str) -> int:
        """Where ``word`` stands outside of CASE expressions."""
        depth = 0
        while i < len(items):
            up = items[i].up if items[i].kind == "word" else ""
            if up == word and not depth:
                return i
            depth += (up == "CASE") - (up == "END" and depth > 0)
            i += 1
        raise DialectError(f"{word} is missing")

    def one(self, items: list, i: int) -> tuple[Node, int]:
        up, nxt = items[i].up, items[i + 1].up if i + 1 < len(items) else ";"
        if items[i].kind == "word" and nxt == ":" and i + 2 < len(items):  # a label
            return self.one(items, i + 2)
        if up == "BEGIN" and nxt not in ("TRANSACTION", ";"):
            body, j = self.many(items, i + 1, {"END", "EXCEPTION"})
            handler = None
            if items[j].up == "EXCEPTION":
                handler, j = self.many(items, self.until(items, j, "THEN") + 1, {"END"})
            return Node("block", bodies=[Block(body, handler)]), j + 1
        if up == "IF":
            node, j, word = Node("if"), i, "IF"
            while word in ("IF", "ELSEIF"):
                then = self.until(items, j + 1, "THEN")
                body, k = self.many(items, then + 1, {"ELSEIF", "ELSE", "END"})
                node.bodies.append((items[j + 1 : then], body))
                j, word = k, items[k].up
            if word == "ELSE":
                body, j = self.many(items, j + 1, {"END"})
                node.bodies.append((None, body))
            return node, j + 2
        if up == "CASE":
            node, j = Node("if"), _index(items, {"WHEN"}, i)
            value = items[i + 1 : j]
            while items[j].up == "WHEN":
                then = self.until(items, j + 1, "THEN")
                cond = items[j + 1 : then]
                cond = [Group("(", value), Tok("op", "="), Group("(", cond)] if value else cond
                body, k = self.many(items, then + 1, {"WHEN", "ELSE", "END"})
                node.bodies.append((cond, body))
                j = k
            if items[j].up == "ELSE":
                body, j = self.many(items, j + 1, {"END"})
                node.bodies.append((None, body))
            return node, j + 2
        if up in ("WHILE", "FOR"):
            do = self.until(items, i, "DO")
            body, j = self.many(items, do + 1, {"END"})
            return Node(up.lower(), items[i + 1 : do], bodies=[body]), j + 2
        if up == "LOOP":
            body, j = self.many(items, i + 1, {"END"})
            return Node("loop", bodies=[body]), j + 2
        if up == "REPEAT":
            body, j = self.many(items, i + 1, {"UNTIL"})
            end = self.until(items, j + 1, "END")
            return Node("repeat", items[j + 1 : end], bodies=[body]), end + 2
        end = next((j for j in range(i, len(items)) if items[j].up == ";"), len(items))
        if up == "CREATE" and _index(items[i:end], {"PROCEDURE"}) < end - i:
            begin = _index(items, {"BEGIN"}, i)
            if begin < len(items):
                _, end = self.one(items, begin)
        kind = {"DECLARE": "declare_node", "SET": "set_node", "BREAK": "leave", "LEAVE": "leave", "CONTINUE": "again", "ITERATE": "again", "RETURN": "return", "RAISE": "raise"}.get(up, "run")
        return Node(kind, items[i:end], self.text[items[i].at : items[end - 1].end]), end


class Script:
    """Runs parsed scripts against an engine."""

    def __init__(self, engine):
        self.engine, self.spark = engine, engine.spark
        self.scopes: list[dict[str, object]] = []
        self.depth = 0
        self.error: BaseException | None = None

    def run(self, block: Block) -> list:
        """What the statements gave, in order; those that give nothing are left out."""
        out: list = []
        try:
            self._scope(block, out)
        except Return:
            pass
        return out

    def call(self, params: list[tuple[str, str, str]], given: list[list], body: Block) -> list:
        """A procedure's results; OUT parameters are copied to the variables given for them."""
        self.depth += 1
        held = [f"_arg{self.depth}_{n}" for n in range(len(params))]
        try:
            for (mode, _, kind), name, value in zip(params, held, given):
                self._declare(name, kind)
                if mode != "OUT":
                    self._set(name, self._text(value))
            self.scopes.append({})
            try:
                for (_, name, kind), value in zip(params, held):
                    self._hide(name)
                    self._declare(name, kind)
                    self._set(name, value)
                out = self.run(body)
                for (mode, name, _), value in zip(params, held):
                    if mode != "IN":
                        self._set(value, name)
            finally:
                self._end()
            for (mode, _, _), value, target in zip(params, held, given):
                if mode != "IN":
                    self._set(target[0].text, value)
            return out
        finally:
            for name in held:
                self.spark.sql(f"DROP TEMPORARY VARIABLE IF EXISTS {name}")
            self.depth -= 1

    # Variables

    def _text(self, items: list) -> str:
        return self.engine.walk(self.engine._prepare(items))

    def _declare(self, name: str, kind: str, value: str = "") -> None:
        self.spark.sql(f"DECLARE OR REPLACE VARIABLE {name} {kind} {value}")

    def _set(self, name: str, value: str) -> None:
        self.spark.sql(f"SET VAR {name} = (SELECT {value})")

    def _hide(self, name: str) -> None:
        """Note a name of the innermost scope, with the outer variable it hides."""
        own = self.scopes[-1]
        if name.lower() not in own:
            outer = any(name.lower() in s for s in self.scopes[:-1])
            own[name.lower()] = self._keep(name) if outer else None

    def _keep(self, name: str) -> tuple[str, str]:
        df = self.spark.sql(f"SELECT {name} AS v")
        view = f"_kept_{len(self.scopes)}_{name}"
        self.spark.createDataFrame(df.collect(), df.schema).createOrReplaceTempView(view)
        return df.schema["v"].dataType.simpleString(), view

    def _end(self) -> None:
        for name, outer in self.scopes.pop().items():
            if outer is None:
                self.spark.sql(f"DROP TEMPORARY VARIABLE IF EXISTS {name}")
            else:
                kind, view = outer
                self._declare(name, kind)
                self.spark.sql(f"SET VAR {name} = (SELECT v FROM {view})")
                self.spark.catalog.dropTempView(view)

    # Statements

    def _scope(self, block: Block, out: list) -> None:
        self.scopes.append({})
        try:
            self._many(block.nodes, out)
        except (Leave, Again, Return):
            raise
        except Exception as e:
            if block.handler is None:
                raise
            before, self.error = self.error, e
            message = str(e) if isinstance(e, RaisedError) else str(e).split("\n")[0]
            self._declare("_error_message", "STRING", "DEFAULT '" + message.replace("\\", "\\\\").replace("'", "\\'") + "'")
            try:
                self._many(block.handler, out)
            finally:
                self.error = before
        finally:
            self._end()

    def _many(self, nodes: list[Node], out: list) -> None:
        for n in nodes:
            getattr(self, "_" + n.kind)(n, out)

    def _block(self, n: Node, out: list) -> None:
        self._scope(n.bodies[0], out)

    def _true(self, items: list) -> bool:
        return self.spark.sql(f"SELECT ({self._text(items)}) AS ok").first().ok is True

    def _run(self, n: Node, out: list) -> None:
        found = self.engine.execute(n.text)
        if found is not None:
            out.append(found)

    def _if(self, n: Node, out: list) -> None:
        for cond, body in n.bodies:
            if cond is None or self._true(cond):
                return self._many(body, out)
        return None

    def _turn(self, body: list[Node], out: list) -> bool:
        """One turn of a loop; whether to go on."""
        try:
            self._many(body, out)
        except Leave:
            return False
        except Again:
            pass
        return True

    def _while(self, n: Node, out: list) -> None:
        while self._true(n.items) and self._turn(n.bodies[0], out):
            pass

    def _loop(self, n: Node, out: list) -> None:
        while self._turn(n.bodies[0], out):
            pass

    def _repeat(self, n: Node, out: list) -> None:
        while self._turn(n.bodies[0], out) and not self._true(n.items):
            pass

    def _for(self, n: Node, out: list) -> None:
        name, query = n.items[0].text, n.items[2]
        df = self.spark.sql(self._text(query.items if isinstance(query, Group) else n.items[2:]))
        self.scopes.append({})
        try:
            self._hide(name)
            self._declare(name, df.schema.simpleString())
            for row in df.toLocalIterator():
                self.spark.createDataFrame([row], df.schema).createOrReplaceTempView("_for_row")
                self.spark.sql(f"SET VAR {name} = (SELECT struct(*) FROM _for_row)")
                if not self._turn(n.bodies[0], out):
                    break
        finally:
            self._end()

    def _leave(self, n: Node, out: list) -> None:
        raise Leave

    def _again(self, n: Node, out: list) -> None:
        raise Again

    def _return(self, n: Node, out: list) -> None:
        raise Return

    def _raise(self, n: Node, out: list) -> None:
        eq = next((i for i, t in enumerate(n.items) if t.up == "="), None)
        if eq is None:
            raise self.error or RaisedError("RAISE outside of a handler")
        raise RaisedError(str(self.spark.sql(f"SELECT {self._text(n.items[eq + 1 :])} AS m").first().m))

    def _declare_node(self, n: Node, out: list) -> None:
        items = n.items[1:]
        d = _index(items, {"DEFAULT"})
        names = [items[0].text]
        at = 1
        while at + 1 < d and items[at].up == ",":
            names.append(items[at + 1].text)
            at += 2
        value = self._text(items[d + 1 :]) if d < len(items) else None
        for name in names:
            if at == d:  # the type is the value's
                kind = self.spark.sql(f"SELECT {value} AS v").schema["v"].dataType.simpleString()
            else:
                kind = type_text(items[at:d])
            self._hide(name)
            self._declare(name, kind)
            if value is not None:
                self._set(name, value)

    def _set_node(self, n: Node, out: list) -> None:
        items = n.items[1:]
        if not isinstance(items[0], Group):
            return self._set(items[0].text, self._text(items[2:]))
        names = [p[0].text for p in split(items[0].items)]
        value = items[2:]
        if len(value) == 1 and isinstance(value[0], Group):
            inner = value[0].items
        else:  # STRUCT(...)
            inner = value[-1].items
        made = self._text(inner)
        query = made if inner and inner[0].up in ("SELECT", "WITH") else f"SELECT {made}"
        self.spark.sql(f"SET VAR ({', '.join(names)}) = ({query})")
        return None
