"""MySQL SELECT text to Spark SQL text: a tokenizer and a precedence parser, so that Catalyst plans the whole statement.

An expression is (SQL, is it a condition): a condition shows as 1, 0 or NULL where a value is wanted, and a value is a
condition if it isn't 0. Strings compare without regard to case and accents, unless BINARY or a collation says otherwise.
"""

from __future__ import annotations

import re
from collections.abc import Callable

_TOKEN = re.compile(
    r"""\s+|--[ \t][^\n]*|\#[^\n]*|/\*.*?\*/|(?P<str>(?:[nN]|_utf8mb4)?(?:'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.|"")*"))|(?P<hex>0x[0-9a-fA-F]+|[xX]'[0-9a-fA-F]*')|(?P<num>(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)
    |(?P<var>@@?(?:session\.|global\.)?[\w$.]+)|(?P<quoted>`(?:[^`]|``)+`)|(?P<word>[A-Za-z_\u0080-\uffff$][\w$\u0080-\uffff]*)|(?P<op><=>|->>|->|<<|>>|<=|>=|<>|!=|:=|\|\||&&|[-+*/%^~!=<>(),.;?|&])""",
    re.X | re.S,
)


class Unsupported(ValueError):
    """A statement that this front end doesn't take."""


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if m is None:
            raise Unsupported(f"1064: syntax error near {text[at : at + 20]!r}")
        if m.lastgroup:
            out.append((m.lastgroup, m.group()))
        at = m.end()
    return out


_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", "b": "\b", "Z": "\x1a"}


def string_value(raw: str) -> str:
    """The value of a quoted string token."""
    raw = raw[re.match(r"[^'\"]*", raw).end() :]
    q, body = raw[0], raw[1:-1]
    body = body.replace(q * 2, q)
    return re.sub(r"\\(.)", lambda m: "\\" + m[1] if m[1] in "%_" else _ESCAPES.get(m[1], m[1]), body, flags=re.S)


def literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(int(v))
    if isinstance(v, (int, float)):
        return repr(v)
    out = str(v).replace("\\", "\\\\").replace("'", "\\'")
    return "'" + out.replace("\n", "\\n").replace("\0", "\\0") + "'"


def _call(template: str) -> Callable:
    return lambda *a: template.format(*a)


def _ci(x: str) -> str:
    return f"collate(CAST({x} AS STRING), 'UNICODE_CI_AI')"


def _strict(name: str) -> Callable:
    return lambda *a: "CASE WHEN " + " AND ".join(f"{x} IS NOT NULL" for x in a) + f" THEN {name}({', '.join(a)}) END"


def _chain(a: tuple, test: Callable, other: str) -> str:
    return "CASE " + " ".join(f"WHEN {test(x)} THEN {i}" for i, x in enumerate(a, 1)) + f" ELSE {other} END"


#: Functions that Spark has under another name, or that need a guard; others go through as they are.
FUNCTIONS: dict[str, Callable] = {
    "ifnull": lambda *a: f"coalesce({', '.join(a)})", "isnull": _call("CAST(({0}) IS NULL AS INT)"), "length": _call("octet_length({0})"), "char_length": _call("char_length(CAST({0} AS STRING))"), "character_length": _call("char_length(CAST({0} AS STRING))"),
    "lcase": _call("lower({0})"), "ucase": _call("upper({0})"), "mid": lambda *a: FUNCTIONS["substring"](*a), "substr": lambda *a: FUNCTIONS["substring"](*a),
    "substring": lambda s, p, n=None: f"CASE WHEN ({p}) = 0 OR ({p}) < -char_length({s}) THEN left({s}, 0) ELSE substring({s}, {p}{'' if n is None else f', greatest({n}, 0)'}) END",
    "space": _call("repeat(' ', {0})"), "now": _call("current_timestamp()"), "localtime": _call("current_timestamp()"), "curdate": _call("current_date()"), "current_date": _call("current_date()"), "database": _call("current_database()"), "schema": _call("current_database()"),
    "std": _call("stddev_pop({0})"), "stddev": _call("stddev_pop({0})"), "variance": _call("var_pop({0})"), "greatest": _strict("greatest"), "least": _strict("least"), "mod": _call("try_mod({0}, {1})"), "pow": _call("power({0}, {1})"),
    "rand": _call("rand()"), "truncate": lambda x, d: f"(sign({x}) * floor(abs({x}) * power(10, {d})) / power(10, {d}))", "log": lambda *a: f"CASE WHEN {a[-1]} > 0 THEN ln({a[-1]}){f' / ln({a[0]})' if len(a) > 1 else ''} END", "ln": _call("CASE WHEN {0} > 0 THEN ln({0}) END"),
    "sqrt": _call("CASE WHEN {0} >= 0 THEN sqrt({0}) END"), "crc32": _call("crc32(CAST({0} AS BINARY))"), "sha": _call("sha1({0})"), "oct": _call("conv({0}, 10, 8)"), "dayname": _call("date_format({0}, 'EEEE')"), "monthname": _call("date_format({0}, 'MMMM')"),
    "dayofmonth": _call("day({0})"), "date": _call("to_date({0})"), "to_days": _call("(datediff({0}, DATE'1970-01-01') + 719528)"), "from_days": _call("date_add(DATE'1970-01-01', CAST({0} - 719528 AS INT))"), "makedate": _call("CASE WHEN {1} > 0 THEN date_add(make_date({0}, 1, 1), CAST({1} - 1 AS INT)) END"),
    "unix_timestamp": lambda *a: f"unix_timestamp({', '.join(a)})", "field": lambda s, *v: _chain(v, lambda x: f"{_ci(s)} = {_ci(x)}", "0"), "elt": lambda n, *v: "CASE " + " ".join(f"WHEN ({n}) = {i} THEN {x}" for i, x in enumerate(v, 1)) + " END",
    "strcmp": lambda a, b: f"CASE WHEN {_ci(a)} = {_ci(b)} THEN 0 WHEN {_ci(a)} < {_ci(b)} THEN -1 WHEN {_ci(a)} > {_ci(b)} THEN 1 END", "find_in_set": lambda s, v: f"find_in_set({_ci(s)}, {_ci(v)})", "instr": lambda s, x: f"instr(lower({s}), lower({x}))", "locate": lambda x, s, *p: f"locate(lower({x}), lower({s}){''.join(', ' + i for i in p)})",
    "interval": lambda n, *v: f"CASE WHEN ({n}) IS NULL THEN -1 " + " ".join(f"WHEN ({n}) < {x} THEN {i}" for i, x in enumerate(v)) + f" ELSE {len(v)} END", "json_value": _call("get_json_object({0}, {1})"), "json_valid": _call("CASE WHEN {0} IS NOT NULL THEN CAST(try_parse_json({0}) IS NOT NULL AS INT) END"), "json_quote": _call("substring(to_json(array({0})), 2, length(to_json(array({0}))) - 2)"), "any_value": _call("min({0})"),
    "bit_length": _call("bit_length({0})"), "format": lambda x, d: f"format_number({x}, greatest({d}, 0))", "inet_ntoa": _call("concat_ws('.', {0} >> 24 & 255, {0} >> 16 & 255, {0} >> 8 & 255, {0} & 255)"), "version": _call("'8.4.0'"), "connection_id": _call("1"), "last_day": _call("last_day({0})"), "name_const": _call("{1}"),
    "icu_version": _call("'74.2'"), "sleep": _call("0"), "uuid_short": _call("unix_micros(current_timestamp())"), "random_bytes": _call("unhex(left(sha2(CAST(rand() AS STRING), 512), 2 * least({0}, 64)))"), "is_uuid": _call("CAST({0} RLIKE '(?i)^([0-9a-f]{{8}}(-[0-9a-f]{{4}}){{3}}-[0-9a-f]{{12}}|[0-9a-f]{{32}})$' AS INT)"),
    "utc_timestamp": _call("to_utc_timestamp(current_timestamp(), current_timezone())"), "utc_date": _call("to_date(to_utc_timestamp(current_timestamp(), current_timezone()))"), "utc_time": _call("date_format(to_utc_timestamp(current_timestamp(), current_timezone()), 'HH:mm:ss')"), "curtime": _call("date_format(current_timestamp(), 'HH:mm:ss')"), "current_time": _call("date_format(current_timestamp(), 'HH:mm:ss')"), "sysdate": _call("current_timestamp()"),
    "extractvalue": _call("coalesce(xpath_string({0}, {1}), '')"), "validate_password_strength": lambda s: f"CASE WHEN {s} IS NULL THEN NULL WHEN length({s}) < 4 THEN 0 WHEN length({s}) < 8 THEN 25 WHEN {s} RLIKE '[0-9]' AND {s} RLIKE '[a-z]' AND {s} RLIKE '[A-Z]' AND {s} RLIKE '[^0-9A-Za-z]' THEN 100 ELSE 50 END",
    "inet_aton": _call("(CAST(split_part({0}, '.', 1) AS BIGINT) * 16777216 + CAST(split_part({0}, '.', 2) AS BIGINT) * 65536 + CAST(split_part({0}, '.', 3) AS BIGINT) * 256 + CAST(split_part({0}, '.', 4) AS BIGINT))"), "period_add": _call("((({0}) div 100 * 12 + ({0}) % 100 - 1 + ({1})) div 12 * 100 + (({0}) div 100 * 12 + ({0}) % 100 - 1 + ({1})) % 12 + 1)"), "period_diff": _call("((({0}) div 100 * 12 + ({0}) % 100) - (({1}) div 100 * 12 + ({1}) % 100))"),
    "benchmark": _call("0"), "current_role": _call("'NONE'"), "load_file": _call("CAST(NULL AS STRING)"), "microsecond": _call("CAST(pmod(unix_micros(CAST({0} AS TIMESTAMP)), 1000000) AS INT)"),
}

_COLLATIONS = {"_bin": "UTF8_BINARY", "_as_cs": "UNICODE", "_as_ci": "UNICODE_CI", "_ci": "UNICODE_CI_AI"}
_END = {"from", "where", "group", "having", "order", "limit", "union", "intersect", "except", "window", "for", "into", "on", "using", "join", "inner", "left", "right", "cross", "natural", "straight_join", "full", "as", "asc", "desc", "then", "when", "else", "end", "separator", "with", "rows", "range", "partition", "and", "or", "xor", "between", "offset", "set", "values", "lateral"}
_CASTS = {"signed": "BIGINT", "unsigned": "DECIMAL(20,0)", "char": "STRING", "nchar": "STRING", "date": "DATE", "datetime": "TIMESTAMP_NTZ", "double": "DOUBLE", "real": "DOUBLE", "float": "FLOAT", "binary": "BINARY", "json": "STRING", "year": "INT"}
_UNITS = {"microsecond", "second", "minute", "hour", "day", "week", "month", "quarter", "year"}


def _order(keys: list[tuple[str, str]]) -> str:
    return " ORDER BY " + ", ".join(k + way for k, way in keys) if keys else ""


class Translator:
    def __init__(self, text: str, variables: dict | None = None, parameters=(), system: dict | None = None):
        self.t, self.at = tokens(text), 0
        self.variables, self.parameters, self.system = variables or {}, list(parameters), system or {}
        self.found_rows = False
        self.cells: list[str] | None = None  # of the select that was read last; None where it is DISTINCT
        self.head = 0  # and how many characters there are up to their end

    # tokens
    def peek(self, k: int = 0) -> str:
        return self.t[self.at + k][1].lower() if self.at + k < len(self.t) and self.t[self.at + k][0] not in ("str", "quoted") else "" if self.at + k < len(self.t) else "<end>"

    def kind(self) -> str:
        return self.t[self.at][0] if self.at < len(self.t) else "end"

    def take(self, *words: str) -> str:
        for w in words:
            if self.peek() != w:
                raise Unsupported(f"1064: syntax error near {' '.join(x for _, x in self.t[self.at : self.at + 4])!r}, {w.upper()} expected")
            self.at += 1
        return words[-1] if words else ""

    def next(self) -> str:
        if self.at >= len(self.t):
            raise Unsupported("1064: syntax error near the end")
        self.at += 1
        return self.t[self.at - 1][1]

    def skip(self, *words: str) -> bool:
        if all(self.peek(k) == w for k, w in enumerate(words)):
            self.at += len(words)
            return True
        return False

    def name(self) -> str:
        if self.kind() not in ("word", "quoted"):
            raise Unsupported(f"1064: a name is expected near {self.peek()!r}")
        quoted, raw = self.kind() == "quoted", self.next()
        return "`" + (raw[1:-1].replace("``", "`") if quoted else raw).replace("`", "``") + "`"

    # statements
    def statement(self) -> str:
        out = self.query()
        self.skip(";")
        if self.at < len(self.t):
            raise Unsupported(f"1064: syntax error near {self.t[self.at][1]!r}")
        return out

    def query(self, nested: bool = False) -> str:
        """A query. Of a nested one with a limit, keys of the order are output too and taken off again: where it is correlated, Spark numbers the rows by them only then."""
        out = ""
        if self.skip("with"):
            out = "WITH " + ("RECURSIVE " if self.skip("recursive") else "")
            parts = []
            while True:
                name = self.name()
                columns = "(" + ", ".join(self.names()) + ")" if self.peek() == "(" else ""
                self.take("as", "(")
                parts.append(f"{name}{columns} AS ({self.query()})")
                self.take(")")
                if not self.skip(","):
                    break
            out += ", ".join(parts) + " "
        single = nested and self.peek() == "select"
        first = self.operand()
        cells, head = self.cells, self.head
        out += first
        while self.peek() in ("union", "intersect", "except"):
            single = False
            word = self.next().upper()
            every = "ALL " if self.skip("all") else "" if not self.skip("distinct") else ""
            out += f" {word} {every}{self.operand()}"
        keys, limit = self.order_limit()
        if single and cells is not None and keys and limit:
            shown = {c[c.rindex("`", 0, -1) :] for c in cells if c.endswith("`")}
            hidden = {k: f"`__order{i}`" for i, (k, _) in enumerate(keys) if k not in shown and not k.isdigit()}
            if hidden:
                keys = [(hidden.get(k, k), way) for k, way in keys]
                more = ", ".join(f"{k} AS {name}" for k, name in hidden.items())
                inner = f"{out[: len(out) - len(first)]}{first[:head]}, {more}{first[head:]}"
                return f"SELECT * EXCEPT ({', '.join(hidden.values())}) FROM ({inner}{_order(keys)}{limit})"
        return out + _order(keys) + limit

    def names(self) -> list[str]:
        self.take("(")
        out = [self.name()]
        while self.skip(","):
            out.append(self.name())
        self.take(")")
        return out

    def operand(self) -> str:
        if self.skip("("):
            out = f"({self.query()})"
            self.take(")")
            return out
        if self.skip("table"):
            return f"SELECT * FROM {self.name()}"
        if self.skip("values"):
            rows = []
            while True:
                self.take("row", "(")
                rows.append(self.items())
                self.take(")")
                if not self.skip(","):
                    break
            names = ", ".join(f"column_{i}" for i in range(len(rows[0])))
            return f"SELECT * FROM VALUES {', '.join('(' + ', '.join(r) + ')' for r in rows)} AS t({names})"
        return self.select()

    def items(self) -> list[str]:
        out = [self.value()]
        while self.skip(","):
            out.append(self.value())
        return out

    def select(self) -> str:
        self.take("select")
        out, distinct = "SELECT ", False
        while self.peek() in ("all", "distinct", "distinctrow", "sql_calc_found_rows", "straight_join", "high_priority", "sql_no_cache", "sql_small_result", "sql_big_result", "sql_buffer_result"):
            word = self.next().lower()
            distinct |= word.startswith("distinct")
            out += "DISTINCT " if word.startswith("distinct") else ""
            self.found_rows |= word == "sql_calc_found_rows"
        cells = [self.cell()]
        while self.skip(","):
            cells.append(self.cell())
        out += ", ".join(cells)
        head = len(out)
        if self.skip("from") and not self.skip("dual"):
            out += " FROM " + self.sources()
        if self.skip("where"):
            out += " WHERE " + self.condition()
        if self.skip("group", "by"):
            keys = self.items()
            out += " GROUP BY " + (f"ROLLUP ({', '.join(keys)})" if self.skip("with", "rollup") else ", ".join(keys))
        if self.skip("having"):
            out += " HAVING " + self.condition()
        if self.skip("window"):
            parts = []
            while True:
                name = self.name()
                self.take("as")
                parts.append(f"{name} AS {self.window()}")
                if not self.skip(","):
                    break
            out += " WINDOW " + ", ".join(parts)
        self.cells, self.head = None if distinct else cells, head
        return out

    def cell(self) -> str:
        if self.skip("*"):
            return "*"
        if self.kind() in ("word", "quoted") and self.peek(1) == "." and self.peek(2) == "*":
            name = self.name()
            self.take(".", "*")
            return f"{name}.*"
        start = self.at
        out = self.value()
        label = "".join(x for _, x in self.t[start : self.at]) if self.at - start > 1 or self.t[start][0] not in ("word", "quoted") else None
        if self.skip("as"):
            label = string_value(self.next()) if self.kind() == "str" else self.name().strip("`")
        elif self.kind() in ("str", "quoted") or self.kind() == "word" and self.peek() not in _END:
            label = string_value(self.next()) if self.kind() == "str" else self.name().strip("`")
        elif re.fullmatch(r"(`[^`]+`\.)?`[^`]+`", out):
            label = None
        return f"{out} AS `{label}`" if label else out

    def order_limit(self) -> tuple[list[tuple[str, str]], str]:
        """The keys of the order, and the limit."""
        keys = self.order_keys() if self.skip("order", "by") else []
        out = ""
        if self.skip("limit"):
            a = self.number()
            if self.skip(","):
                out += f" LIMIT {self.number()} OFFSET {a}"
            else:
                out += f" LIMIT {a}" + (f" OFFSET {self.number()}" if self.skip("offset") else "")
        if self.skip("for"):
            while self.kind() == "word":
                self.next()
        return keys, out

    def number(self) -> str:
        return literal(self.parameters.pop(0)) if self.skip("?") else self.next()

    def order_keys(self) -> list[tuple[str, str]]:
        out = []
        while True:
            out.append((self.value(), " DESC" if self.skip("desc") else "" if not self.skip("asc") else ""))
            if not self.skip(","):
                return out

    def order(self) -> str:
        return ", ".join(k + way for k, way in self.order_keys())

    def sources(self) -> str:
        out = self.source()
        while True:
            if self.skip(","):
                out += (", LATERAL " if self.skip("lateral") else " CROSS JOIN ") + self.source()
                continue
            natural = self.skip("natural")
            side = self.next().upper() if self.peek() in ("inner", "cross", "left", "right", "full") else ""
            self.skip("outer")
            if self.skip("straight_join") or self.skip("join"):
                out += f" {'NATURAL ' if natural else ''}{side} JOIN " + ("LATERAL " if self.skip("lateral") else "") + self.source()
                if self.skip("on"):
                    out = (out.replace(" CROSS JOIN ", " INNER JOIN ") if side == "CROSS" else out) + " ON " + self.condition()
                elif self.skip("using"):
                    out += " USING (" + ", ".join(self.names()) + ")"
            else:
                return out

    def source(self) -> str:
        if self.skip("("):
            if self.peek() in ("select", "with", "values", "table", "("):
                out = f"({self.query(nested=True)})"
            else:
                out = f"({self.sources()})"
            self.take(")")
        else:
            out = self.name()
            while self.skip("."):
                out += "." + self.name()
        if self.skip("partition"):
            self.names()
        if self.skip("as") or self.kind() == "quoted" or self.kind() == "word" and self.peek() not in _END | {"use", "force", "ignore"}:
            out += " AS " + self.name()
            if self.peek() == "(":
                out += "(" + ", ".join(self.names()) + ")"
        while self.peek() in ("use", "force", "ignore"):
            self.next()
            self.next()
            if self.skip("for"):
                self.next()
                self.skip("by")
            self.take("(")
            while not self.skip(")"):
                self.next()
        return out

    # expressions
    def value(self) -> str:
        sql, test = self.expression(0)
        return f"CAST(({sql}) AS INT)" if test else sql

    def condition(self) -> str:
        return self.as_test(self.expression(0))

    @staticmethod
    def as_test(e: tuple[str, bool]) -> str:
        return e[0] if e[1] else f"(({e[0]}) <> 0)"

    @staticmethod
    def as_value(e: tuple[str, bool]) -> str:
        return f"CAST(({e[0]}) AS INT)" if e[1] else e[0]

    def compare(self, a: str, op: str, b: str) -> str:
        text = lambda x: x.startswith("'") and not re.fullmatch(r"'\s*[-+]?[\d.:/ -]+'", x)
        if (text(a) or text(b)) and "collate(" not in a + b:
            a, b = _ci(a), _ci(b)
        return f"({a} {op} {b})"

    def expression(self, level: int) -> tuple[str, bool]:
        """Levels: 0 OR, 1 XOR, 2 AND, 3 NOT, 4 comparisons, 5 |, 6 &, 7 shifts, 8 sums, 9 products, 10 ^, 11 unary."""
        if level == 0:
            left = self.expression(1)
            while self.peek() in ("or", "||"):
                self.next()
                left = (f"({self.as_test(left)} OR {self.as_test(self.expression(1))})", True)
            return left
        if level == 1:
            left = self.expression(2)
            while self.skip("xor"):
                left = (f"({self.as_test(left)} <> {self.as_test(self.expression(2))})", True)
            return left
        if level == 2:
            left = self.expression(3)
            while self.peek() in ("and", "&&"):
                self.next()
                left = (f"({self.as_test(left)} AND {self.as_test(self.expression(3))})", True)
            return left
        if level == 3:
            if self.peek() == "not":
                self.next()
                return f"(NOT {self.as_test(self.expression(3))})", True
            return self.comparison()
        ops = {5: ("|",), 6: ("&",), 7: ("<<", ">>"), 8: ("+", "-"), 9: ("*", "/", "div", "%", "mod"), 10: ("^",)}
        if level == 11:
            return self.unary()
        left = self.expression(level + 1)
        while self.peek() in ops[level]:
            op = self.next().lower()
            a = self.as_value(left)
            if op in "+-" and self.peek() == "interval":
                left = (f"({a} {op} {self.interval()})", False)
                continue
            b = self.as_value(self.expression(level + 1))
            left = ({
                "/": f"try_divide({a}, {b})", "div": f"(({a}) div nullif({b}, 0))", "%": f"try_mod({a}, {b})", "mod": f"try_mod({a}, {b})", "<<": f"CASE WHEN ({b}) BETWEEN 0 AND 63 THEN shiftleft(CAST({a} AS BIGINT), {b}) ELSE 0 END",
                ">>": f"CASE WHEN ({b}) BETWEEN 0 AND 63 THEN shiftrightunsigned(CAST({a} AS BIGINT), {b}) ELSE 0 END",
            }.get(op, f"({a} {op} {b})"), False)
        return left

    def interval(self) -> str:
        self.take("interval")
        n = self.value()
        unit = self.next().lower()
        if unit not in _UNITS:
            raise Unsupported(f"1235: INTERVAL with {unit.upper()}")
        of = {"quarter": f"make_ym_interval(0, 3 * ({n}))", "month": f"make_ym_interval(0, {n})", "year": f"make_ym_interval({n})", "microsecond": f"make_dt_interval(0, 0, 0, ({n}) / 1000000)", "second": f"make_dt_interval(0, 0, 0, {n})", "minute": f"make_dt_interval(0, 0, {n})", "hour": f"make_dt_interval(0, {n})", "day": f"make_dt_interval({n})", "week": f"make_dt_interval(7 * ({n}))"}
        return of[unit]

    def comparison(self) -> tuple[str, bool]:
        left = self.expression(5)
        while True:
            op = self.peek()
            if op in ("=", "<>", "!=", "<", "<=", ">", ">=", "<=>"):
                self.next()
                a = self.as_value(left)
                if self.peek() in ("any", "some", "all") and self.peek(1) == "(":
                    left = (self.quantified(a, op, self.next().lower() == "all"), True)
                    continue
                left = (self.compare(a, "<>" if op == "!=" else op, self.as_value(self.expression(5))), True)
                continue
            if op == "is":
                self.next()
                no = self.skip("not")
                word = self.next().lower()
                if word in ("null", "unknown"):
                    sql = f"(({left[0]}) IS NULL)"
                elif word in ("true", "false"):
                    sql = f"({self.as_test(left)} IS {word.upper()})"
                else:
                    raise Unsupported(f"1064: syntax error near IS {word}")
                left = (f"(NOT {sql})" if no else sql, True)
                continue
            no = op == "not" and self.peek(1) in ("in", "like", "between", "regexp", "rlike")
            if no:
                self.next()
                op = self.peek()
            a = self.as_value(left)
            if op == "in":
                self.take("in", "(")
                if self.peek() in ("select", "with", "table", "values"):
                    sql = f"({a} IN ({self.query()}))"
                else:
                    some = self.items()
                    sql = f"({_ci(a)} IN ({', '.join(map(_ci, some))}))" if all(x.startswith("'") for x in some) else f"({a} IN ({', '.join(some)}))"
                self.take(")")
            elif op == "between":
                self.next()
                lo = self.as_value(self.expression(5))
                self.take("and")
                hi = self.as_value(self.expression(5))
                sql = f"({self.compare(a, '>=', lo)} AND {self.compare(a, '<=', hi)})"
            elif op == "like":
                self.next()
                exact = self.skip("binary")
                b = self.as_value(self.expression(5))
                escape = f" ESCAPE {literal(string_value(self.next()))}" if self.skip("escape") else ""
                sql = f"({a} LIKE {b}{escape})" if exact else f"(collate(CAST({a} AS STRING), 'UTF8_LCASE') LIKE {b}{escape})"
            elif op in ("regexp", "rlike"):
                self.next()
                sql = f"(CAST({a} AS STRING) RLIKE concat('(?i)', {self.as_value(self.expression(5))}))"
            else:
                return left
            left = (f"(NOT {sql})" if no else sql, True)

    def quantified(self, a: str, op: str, every: bool) -> str:
        """op ANY and ALL by the least and largest value, and by how many there are and how many aren't NULL."""
        self.take("(")
        inner = self.query()
        self.take(")")
        op = {"!=": "<>"}.get(op, op)
        if op == "=" and not every or op == "<>" and every:
            return f"({a} {'NOT ' if every else ''}IN ({inner}))"
        of = lambda what: f"(SELECT {what} FROM ({inner}) AS __q(__v))"
        lo, hi = of("min(__v)"), of("max(__v)")
        if op in ("=", "<>"):
            test, other = f"({a} <> {lo} OR {a} <> {hi})", not every
        else:
            edge = (lo if op[0] == "<" else hi) if every else (hi if op[0] == "<" else lo)
            test, other = (f"NOT ({a} {op} {edge})", False) if every else (f"({a} {op} {edge})", True)
        open_ = f"({a} IS NULL OR {of('count(*) > count(__v)')})"
        return f"(CASE WHEN {of('count(*)')} = 0 THEN {str(every).upper()} WHEN {test} THEN {str(other).upper()} WHEN {open_} THEN NULL ELSE {str(not other).upper()} END)"

    def unary(self) -> tuple[str, bool]:
        if self.skip("-"):
            return f"(-{self.as_value(self.unary())})", False
        if self.skip("+"):
            return self.unary()
        if self.skip("~"):
            x = self.as_value(self.unary())
            return f"(CAST(~CAST({x} AS BIGINT) AS DECIMAL(20,0)) + CASE WHEN ~CAST({x} AS BIGINT) < 0 THEN 18446744073709551616BD ELSE 0BD END)", False
        if self.skip("!"):
            return f"(NOT {self.as_test(self.unary())})", True
        if self.peek() == "binary" and self.peek(1) not in ("(", ",", ")"):
            self.next()
            return f"collate(CAST({self.as_value(self.unary())} AS STRING), 'UTF8_BINARY')", False
        out = self.primary()
        while True:
            if self.skip("collate"):
                name = self.next().lower()
                to = next((v for k, v in _COLLATIONS.items() if name.endswith(k)), "UTF8_BINARY")
                out = (f"collate({self.as_value(out)}, '{to}')", False)
            elif self.peek() in ("->", "->>"):
                plain = self.next() == "->>"
                sql = f"json_extract({self.as_value(out)}, {literal(string_value(self.next()))})"
                out = (f"json_unquote({sql})" if plain else sql, False)
            else:
                return out

    def primary(self) -> tuple[str, bool]:
        kind, word = self.kind(), self.peek()
        if kind == "str":
            text = string_value(self.next())
            while self.kind() == "str":
                text += string_value(self.next())
            return literal(text), False
        if kind == "num":
            return self.next(), False
        if kind == "hex":
            raw = self.next()
            return f"X'{re.sub(r'[^0-9a-fA-F]', '', raw[2:] if raw.lower().startswith('0x') else raw[1:])}'", False
        if kind == "var":
            name = self.next().lower()
            if name.startswith("@@"):
                key = re.sub(r"^@@(session\.|global\.)?", "", name)
                if key not in self.system:
                    raise Unsupported(f"1193: Unknown system variable '{key}'")
                return literal(self.system[key]), False
            return literal(self.variables.get(name[1:])), False
        if self.skip("?"):
            if not self.parameters:
                raise Unsupported("1210: Incorrect arguments to EXECUTE")
            return literal(self.parameters.pop(0)), False
        if self.skip("("):
            if self.peek() in ("select", "with", "table", "values"):
                out = f"({self.query(nested=True)})", False
            else:
                first = self.expression(0)
                if self.peek() == ",":
                    some = [self.as_value(first)]
                    while self.skip(","):
                        some.append(self.value())
                    out = f"({', '.join(some)})", False
                else:
                    out = f"({first[0]})", first[1]
            self.take(")")
            return out
        if word in ("true", "false"):
            self.next()
            return ("TRUE" if word == "true" else "FALSE"), True
        if word == "null":
            self.next()
            return "NULL", False
        if word == "exists":
            self.take("exists", "(")
            out = f"EXISTS ({self.query()})"
            self.take(")")
            return out, True
        if word == "row" and self.peek(1) == "(":
            self.next()
            return self.primary()
        if word == "case":
            return self.case(), False
        if word in ("date", "time", "timestamp") and self.at + 1 < len(self.t) and self.t[self.at + 1][0] == "str":
            self.next()
            return f"CAST({literal(string_value(self.next()))} AS {'DATE' if word == 'date' else 'TIMESTAMP_NTZ'})", False
        if word in ("current_date", "current_timestamp", "localtime", "localtimestamp", "current_user") and self.peek(1) != "(":
            self.next()
            return {"current_date": "current_date()", "current_user": "'root@%'"}.get(word, "current_timestamp()"), False
        if self.peek(1) == "(" and kind == "word":
            return self.function()
        out = self.name()
        while self.skip("."):
            out += "." + self.name()
        return out, False

    def case(self) -> str:
        self.take("case")
        out = "CASE"
        of = None if self.peek() == "when" else self.value()
        while self.skip("when"):
            test = self.compare(of, "=", self.value()) if of is not None else self.condition()
            self.take("then")
            out += f" WHEN {test} THEN {self.value()}"
        if self.skip("else"):
            out += f" ELSE {self.value()}"
        self.take("end")
        return out + " END"

    def window(self) -> str:
        if self.peek() != "(":
            return self.name()
        self.take("(")
        out = []
        if self.kind() in ("word", "quoted") and self.peek() not in ("partition", "order", "rows", "range"):
            out.append(self.name())
        if self.skip("partition", "by"):
            out.append("PARTITION BY " + ", ".join(self.items()))
        if self.skip("order", "by"):
            out.append("ORDER BY " + self.order())
        if self.peek() in ("rows", "range"):
            frame = []
            while self.peek() != ")":
                frame.append(self.next().upper())
            out.append(" ".join(frame))
        self.take(")")
        return "(" + " ".join(out) + ")"

    def function(self) -> tuple[str, bool]:
        name = self.next().lower()
        self.take("(")
        out, test = self.arguments(name)
        if self.skip("over"):
            window = self.window()
            if name in ("row_number", "rank", "dense_rank", "percent_rank", "cume_dist", "ntile", "lag", "lead"):
                window = re.sub(r" (ROWS|RANGE) [A-Z0-9 ]+\)$", ")", window)  # these have no frame
            out = f"{out} OVER {window}"
        return out, test

    def arguments(self, name: str) -> tuple[str, bool]:
        if name in ("cast", "convert"):
            x = self.value()
            if name == "convert" and self.skip("using"):
                self.next()
                self.take(")")
                return f"CAST({x} AS STRING)", False
            self.take("as" if name == "cast" else ",")
            return self.cast(x), False
        if name == "group_concat":
            distinct = "DISTINCT " if self.skip("distinct") else ""
            some = self.items()
            x = f"concat({', '.join(some)})" if len(some) > 1 else f"CAST({some[0]} AS STRING)"
            order = self.order() if self.skip("order", "by") else x
            if distinct and order.split(" ")[0] == some[0]:  # the order must be by the text itself
                order = x + order[len(some[0]) :]
            sep = literal(string_value(self.next())) if self.skip("separator") else "','"
            self.take(")")
            return f"listagg({distinct}{x}, {sep}) WITHIN GROUP (ORDER BY {order})", False
        if name == "extract":
            unit = self.next().lower()
            self.take("from")
            x = self.value()
            self.take(")")
            if unit == "year_month":
                return f"(year({x}) * 100 + month({x}))", False
            if unit not in _UNITS - {"microsecond", "week"}:
                raise Unsupported(f"1235: EXTRACT of {unit.upper()}")
            return f"CAST(extract({unit.upper()} FROM {x}) AS BIGINT)", False
        if name == "position":
            x = self.as_value(self.expression(5))
            self.take("in")
            s = self.value()
            self.take(")")
            return f"locate(lower({x}), lower({s}))", False
        if name == "trim":
            side = self.next().lower() if self.peek() in ("both", "leading", "trailing") else "both"
            what = None if self.peek() == "from" else self.value()
            if self.skip("from"):
                s = self.value()
            else:
                s, what = what, None
            self.take(")")
            what = "' '" if what is None else what
            quoted = f"concat('(?:', '\\\\Q', {what}, '\\\\E', ')+')"
            out = s
            if side in ("both", "leading"):
                out = f"regexp_replace({out}, concat('^', {quoted}), '')"
            return (f"regexp_replace({out}, concat({quoted}, '$'), '')" if side in ("both", "trailing") else out), False
        if name in ("substring", "substr", "mid"):
            a = [self.value()]
            while self.skip(",") or self.skip("from") or self.skip("for"):
                a.append(self.value())
            self.take(")")
            return FUNCTIONS["substring"](*a), False
        if name in ("date_add", "date_sub", "adddate", "subdate"):
            x = self.value()
            self.take(",")
            by = self.interval() if self.peek() == "interval" else f"make_dt_interval({self.value()})"
            self.take(")")
            return f"({x} {'+' if name.endswith('add') or name == 'adddate' else '-'} {by})", False
        if name in ("timestampdiff", "timestampadd"):
            unit = self.next().upper()
            self.take(",")
            a = self.items()
            self.take(")")
            return f"{name}({unit}, {', '.join(a)})", False
        if name == "if":
            test = self.condition()
            self.take(",")
            a = self.items()
            self.take(")")
            return f"IF({test}, {a[0]}, {a[1]})", False
        if name == "count" and self.skip("*"):
            self.take(")")
            return "count(*)", False
        distinct = "DISTINCT " if self.skip("distinct") else ""
        a = [] if self.peek() == ")" else self.items()
        self.take(")")
        if name in FUNCTIONS and not distinct:
            return FUNCTIONS[name](*a), False
        if name in ("user", "current_user", "session_user", "system_user"):
            return "'root@%'", False
        return f"{name}({distinct}{', '.join(a)})", False

    def cast(self, x: str) -> str:
        kind = self.next().lower()
        size = ""
        if self.skip("("):
            size = self.next()
            if self.skip(","):
                size += "," + self.next()
            self.take(")")
        if kind in ("signed", "unsigned"):
            self.skip("integer")
        if kind in ("char", "nchar") and self.skip("character", "set"):
            self.next()
        self.take(")")
        if kind == "decimal":
            return f"try_cast({x} AS DECIMAL({size or '10,0'}))"
        if kind not in _CASTS:
            raise Unsupported(f"1235: CAST to {kind.upper()}")
        if kind in ("char", "nchar") and size:
            return f"left(CAST({x} AS STRING), {size})"
        if kind in ("signed", "unsigned"):
            return f"CAST(coalesce(try_cast({x} AS DECIMAL(38,0)), try_cast(regexp_extract(CAST({x} AS STRING), '^\\\\s*([+-]?\\\\d+)', 1) AS DECIMAL(38,0)), CASE WHEN {x} IS NOT NULL THEN 0 END) AS {_CASTS[kind]})"
        return f"try_cast({x} AS {_CASTS[kind]})"


def translate(text: str, variables: dict | None = None, parameters=(), system: dict | None = None) -> str:
    """One MySQL query (SELECT, TABLE, VALUES, WITH, set operations) as Spark SQL."""
    return Translator(text, variables, parameters, system).statement()
