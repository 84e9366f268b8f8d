"""A session that runs MySQL statements: queries by translation to Spark SQL, writes as snapshots of its tables, variables and prepared statements.

Tables are temporary views; a write replaces a view by the table's next snapshot. Nothing is collected but
what a statement stores in variables, and counts.
"""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.json import register
from ..operators import dml
from .translate import Translator, Unsupported, literal, string_value, tokens, translate

#: System variables that can be read and set, with their values at the start (fixed values).
SYSTEM = {"autocommit": 1, "sql_mode": "ONLY_FULL_GROUP_BY,STRICT_TRANS_TABLES", "version": "8.4.0", "sql_select_limit": 18446744073709551615, "group_concat_max_len": 1024, "time_zone": "SYSTEM", "character_set_client": "utf8mb4", "collation_connection": "utf8mb4_0900_ai_ci", "max_allowed_packet": 67108864, "lower_case_table_names": 0, "default_storage_engine": "InnoDB", "foreign_key_checks": 1, "unique_checks": 1}
_TYPES = {"int": "int", "integer": "int", "bigint": "bigint", "smallint": "smallint", "tinyint": "tinyint", "mediumint": "int", "double": "double", "float": "float", "real": "double", "decimal": "decimal", "numeric": "decimal", "varchar": "string", "char": "string", "text": "string", "longtext": "string", "json": "string", "date": "date", "datetime": "timestamp_ntz", "timestamp": "timestamp_ntz", "blob": "binary", "varbinary": "binary", "boolean": "tinyint"}


class Locks:
    """Named locks of this process: recursive, owned by sessions."""

    def __init__(self):
        self.held: dict[str, list] = {}
        self.guard = threading.Lock()

    def get(self, name: str, owner: int) -> int:
        with self.guard:
            now = self.held.get(name.lower())
            if now and now[0] != owner:
                return 0
            self.held[name.lower()] = [owner, (now[1] if now else 0) + 1]
            return 1

    def release(self, name: str, owner: int) -> int | None:
        with self.guard:
            now = self.held.get(name.lower())
            if now is None:
                return None
            if now[0] != owner:
                return 0
            now[1] -= 1
            if not now[1]:
                del self.held[name.lower()]
            return 1

    def release_all(self, owner: int) -> int:
        with self.guard:
            own = [k for k, v in self.held.items() if v[0] == owner]
            return sum(self.held.pop(k)[1] for k in own)

    def owner(self, name: str) -> int | None:
        now = self.held.get(name.lower())
        return now[0] if now else None


LOCKS = Locks()


class Table:
    def __init__(self, df: DataFrame, keys: list[str], auto: str | None = None, defaults: dict | None = None):
        self.df, self.keys, self.auto, self.defaults = df, keys, auto, defaults or {}


class Session:
    count = 0

    def __init__(self, spark: SparkSession):
        Session.count += 1
        self.spark, self.id = spark, Session.count
        self.variables: dict = {}
        self.system = dict(SYSTEM)
        self.prepared: dict[str, str] = {}
        self.tables: dict[str, Table] = {}
        self.found_rows = self.row_count = self.last_insert_id = 0
        register(spark)

    def register(self, name: str, df: DataFrame, keys: list[str] = (), auto: str | None = None, defaults: dict | None = None) -> None:
        """Makes a DataFrame a table of the session; keys are its primary key."""
        self.tables[name.lower()] = Table(df, list(keys), auto, defaults)
        df.createOrReplaceTempView(name)

    # statements
    def execute(self, text: str, parameters=()) -> DataFrame | None:
        """The rows of a query, or None for other statements."""
        t = tokens(text)
        words = [x.lower() for k, x in t[:3] if k == "word"] + ["", "", ""]
        first = words[0] if t and t[0][0] == "word" else t[0][1] if t else ""
        run = {
            "set": self._set, "prepare": self._prepare, "execute": self._execute, "deallocate": self._deallocate, "drop": self._drop, "insert": self._insert, "replace": self._insert, "update": self._update,
            "delete": self._delete, "truncate": self._truncate, "create": self._create, "show": self._show, "describe": self._describe, "desc": self._describe, "do": self._do, "use": self._nothing, "begin": self._nothing, "commit": self._nothing, "start": self._nothing,
        }
        if first in run:
            return run[first](text, list(parameters))
        return self._query(text, list(parameters))

    def _query(self, text: str, parameters: list) -> DataFrame | None:
        t = Translator(self._with_state(text), self.variables, parameters, self.system)
        into: list[str] = []
        low = [x.lower() if k == "word" else "" for k, x in t.t]
        if "into" in low and low[0] in ("select", "table", "values", "with"):
            at = low.index("into")
            end = at + 1
            while end < len(t.t) and (t.t[end][0] == "var" or t.t[end][1] == ","):
                if t.t[end][0] == "var":
                    into.append(t.t[end][1].lower()[1:])
                end += 1
            t.t = t.t[:at] + t.t[end:]
        sql = t.statement()
        df = self.spark.sql(sql)
        most = self.system["sql_select_limit"]
        if most < SYSTEM["sql_select_limit"] and " LIMIT " not in sql:
            df = df.limit(most)
        if t.found_rows:
            bare = sql.rsplit(" LIMIT ", 1)[0]
            self.found_rows = self.spark.sql(bare).count()
        if into:
            rows = df.take(2)
            if len(rows) > 1:
                raise ValueError("1172: Result consisted of more than one row")
            if rows:
                self.variables.update(zip(into, rows[0]))
            self.row_count = len(rows)
            return None
        return df

    def _with_state(self, text: str) -> str:
        """FOUND_ROWS() and its like, and locks, as the values they have now."""
        t, out, at = tokens(text), [], 0
        while at < len(t):
            kind, word = t[at]
            low = word.lower() if kind == "word" else ""
            follows = at + 1 < len(t) and t[at + 1][1] == "("
            if follows and low in ("found_rows", "row_count", "last_insert_id", "connection_id") and t[at + 2][1] == ")":
                value = {"found_rows": self.found_rows, "row_count": self.row_count, "last_insert_id": self.last_insert_id, "connection_id": self.id}[low]
                out.append(str(value))
                at += 3
            elif follows and low in ("get_lock", "release_lock", "is_free_lock", "is_used_lock", "release_all_locks"):
                end = next(i for i in range(at, len(t)) if t[i][1] == ")")
                name = string_value(t[at + 2][1]) if t[at + 2][0] == "str" else ""
                value = {"get_lock": lambda: LOCKS.get(name, self.id), "release_lock": lambda: LOCKS.release(name, self.id), "is_free_lock": lambda: int(LOCKS.owner(name) is None), "is_used_lock": lambda: LOCKS.owner(name), "release_all_locks": lambda: LOCKS.release_all(self.id)}[low]()  # noqa: B023
                out.append(literal(value))
                at = end + 1
            else:
                out.append(word)
                at += 1
        return " ".join(out) if out != [x for _, x in t] else text

    def _value(self, sql: str):
        return self.spark.sql(f"SELECT {sql} AS v").first()["v"]

    def _set(self, text: str, parameters: list) -> None:
        t = Translator(self._with_state(text), self.variables, parameters, self.system)
        t.take("set")
        while True:
            while t.skip("session") or t.skip("global"):
                pass
            if t.skip("names"):
                self.system["character_set_client"] = t.next()
            else:
                name = t.next().lower()
                if not t.skip("=") and not t.skip(":="):
                    raise Unsupported("1064: syntax error in SET")
                word = t.kind() == "word" and t.peek(1) in (",", "", "<end>") and t.peek() not in ("null", "true", "false")
                value = t.next() if word else self._value(t.value())
                if name.startswith("@") and not name.startswith("@@"):
                    self.variables[name[1:]] = value
                else:
                    key = name.lstrip("@").removeprefix("session.").removeprefix("global.")
                    if key not in self.system:
                        raise Unsupported(f"1193: Unknown system variable '{key}'")
                    value = SYSTEM[key] if str(value).lower() == "default" else {"on": 1, "off": 0}.get(str(value).lower(), value)
                    self.system[key] = value
            if not t.skip(","):
                return

    def _prepare(self, text: str, parameters: list) -> None:
        t = Translator(text, self.variables)
        t.take("prepare")
        name = t.next().lower()
        t.take("from")
        self.prepared[name] = str(self.variables.get(t.next()[1:].lower())) if t.kind() == "var" else string_value(t.next())

    def _execute(self, text: str, parameters: list) -> DataFrame | None:
        t = Translator(text, self.variables)
        t.take("execute")
        name = t.next().lower()
        if name not in self.prepared:
            raise Unsupported(f"1243: Unknown prepared statement handler ({name}) given to EXECUTE")
        given = []
        if t.skip("using"):
            given.append(self.variables.get(t.next()[1:].lower()))
            while t.skip(","):
                given.append(self.variables.get(t.next()[1:].lower()))
        return self.execute(self.prepared[name], given)

    def _deallocate(self, text: str, parameters: list) -> None:
        self.prepared.pop(tokens(text)[-1][1].lower(), None)

    def _drop(self, text: str, parameters: list) -> None:
        t = Translator(text)
        t.take("drop")
        if t.skip("prepare"):
            self.prepared.pop(t.next().lower(), None)
            return
        t.skip("temporary")
        t.take("view") if t.peek() == "view" else t.take("table")
        maybe = t.skip("if", "exists")
        while True:
            name = t.name().strip("`")
            if not self.spark.catalog.dropTempView(name) and not maybe:
                raise ValueError(f"1051: Unknown table '{name}'")
            self.tables.pop(name.lower(), None)
            if not t.skip(","):
                return

    def _nothing(self, text: str, parameters: list) -> None:
        """Statements without an effect on snapshots."""

    def _do(self, text: str, parameters: list) -> None:
        self._query("SELECT " + text.strip()[2:], parameters).collect()

    def _table(self, name: str) -> Table:
        if name.lower() not in self.tables:
            self.tables[name.lower()] = Table(self.spark.table(name), [])
        return self.tables[name.lower()]

    def _store(self, name: str, df: DataFrame) -> None:
        self.tables[name.lower()].df = df
        df.createOrReplaceTempView(name)

    def _insert(self, text: str, parameters: list) -> None:
        t = Translator(self._with_state(text), self.variables, parameters, self.system)
        replace = t.next().lower() == "replace"
        ignore = t.skip("ignore")
        t.skip("into")
        name = t.name().strip("`")
        table = self._table(name)
        columns = [c.strip("`") for c in t.names()] if t.peek() == "(" and t.peek(1) not in ("select", "with") else list(table.df.columns)
        if t.skip("set"):
            columns, values = [], []
            while True:
                columns.append(t.name().strip("`"))
                t.take("=")
                values.append(t.value())
                if not t.skip(","):
                    break
            source = f"SELECT {', '.join(values)}"
        elif t.peek() in ("values", "value"):
            t.next()
            rows = []
            while True:
                t.take("(")
                row = []
                while True:
                    c = columns[len(row)]
                    row.append(literal(table.defaults.get(c)) if t.skip("default") else t.value())
                    if not t.skip(","):
                        break
                t.take(")")
                if len(row) != len(columns):
                    raise ValueError("1136: Column count doesn't match value count")
                rows.append("(" + ", ".join(row) + f", {len(rows)})")
                if not t.skip(","):
                    break
            source = f"SELECT * FROM VALUES {', '.join(rows)}"
        else:
            source = t.query()
        new = self.spark.sql(source)
        ordered = len(new.columns) == len(columns) + 1
        new = new.toDF(*columns, *(["__n"] if ordered else []))
        if not ordered:
            new = new.withColumn("__n", F.monotonically_increasing_id())
        for c in table.df.columns:
            kind = table.df.schema[c].dataType
            new = new.withColumn(c, (F.col(c) if c in columns else F.lit(table.defaults.get(c))).cast(kind))
        if table.auto:
            old = self._value(f"(SELECT max({table.auto}) FROM {name})") or 0
            new = dml.with_auto_increment(table.df, new, table.auto, ["__n"])
            self.last_insert_id = old + 1
        updates = {}
        if t.skip("on", "duplicate", "key", "update"):
            while True:
                c = t.name().strip("`")
                t.take("=")
                start = t.at
                sql = t.value()
                updates[c] = self._update_value(t.t[start : t.at], sql, table)
                if not t.skip(","):
                    break
        self.row_count = new.count()
        if updates:
            out = dml.on_duplicate_key_update(table.df, new, table.keys, updates, ["__n"])
        elif replace and table.keys:
            out = dml.replace(table.df, new, table.keys, ["__n"])
        elif ignore and table.keys:
            out = dml.insert_ignore(table.df, new, table.keys, ["__n"])
        else:
            if table.keys:
                both = new.select(table.keys).groupBy(table.keys).count().where("count > 1").select(table.keys).union(new.join(table.df, table.keys, "left_semi").select(table.keys))
                if not both.isEmpty():
                    raise ValueError("1062: Duplicate entry for key 'PRIMARY'")
            out = dml.insert(table.df, new)
        self._store(name, out.select(table.df.columns))

    @staticmethod
    def _update_value(part: list, sql: str, table: Table):
        """An ON DUPLICATE KEY UPDATE value: a column is the old one, VALUES(column) the new."""
        import re

        out = re.sub(r"values\(`(\w+)`\)", r"n.`\1`", sql, flags=re.I)
        for c in table.df.columns:
            out = re.sub(rf"(?<![.\w`])`{c}`", f"t.`{c}`", out)
        return F.expr(out)

    def _where(self, t: Translator):
        return F.expr(t.condition()) if t.skip("where") else F.lit(True)

    def _order(self, t: Translator):
        order = []
        if t.skip("order", "by"):
            while True:
                c = F.expr(t.value())
                order.append(c.desc() if t.skip("desc") else c.asc() if not t.skip("asc") else c.asc())
                if not t.skip(","):
                    break
        return order, int(t.number()) if t.skip("limit") else None

    def _update(self, text: str, parameters: list) -> None:
        t = Translator(self._with_state(text), self.variables, parameters, self.system)
        t.take("update")
        t.skip("ignore")
        name = t.name().strip("`")
        t.take("set")
        table, values = self._table(name), {}
        while True:
            c = t.name().strip("`")
            t.take("=")
            values[c] = F.expr(t.value()).cast(table.df.schema[c].dataType)
            if not t.skip(","):
                break
        where = self._where(t)
        order, most = self._order(t)
        if most is not None:
            self.row_count = min(most, table.df.where(where).count())
            out = dml.update_first(table.df, where, order or [F.lit(1)], most, values)
        else:
            self.row_count = table.df.where(where).count()
            out = dml.update(table.df, F.coalesce(where, F.lit(False)), values)
        self._store(name, out)

    def _delete(self, text: str, parameters: list) -> None:
        t = Translator(self._with_state(text), self.variables, parameters, self.system)
        t.take("delete", "from")
        name = t.name().strip("`")
        table = self._table(name)
        where = self._where(t)
        order, most = self._order(t)
        self.row_count = table.df.where(where).count()
        out = dml.delete(table.df, where) if most is None else dml.delete_first(table.df, where, order or [F.lit(1)], most)
        self._store(name, out)

    def _truncate(self, text: str, parameters: list) -> None:
        name = tokens(text)[-1][1].strip("`") if tokens(text)[-1][1] != ";" else tokens(text)[-2][1].strip("`")
        self._store(name, dml.truncate(self._table(name).df))

    def _create(self, text: str, parameters: list) -> None:
        t = Translator(self._with_state(text), self.variables, parameters, self.system)
        t.take("create")
        if t.skip("or", "replace"):
            pass
        if t.skip("view"):
            name = t.name().strip("`")
            t.take("as")
            self.spark.sql(t.query()).createOrReplaceTempView(name)
            return
        t.skip("temporary")
        t.take("table")
        maybe = t.skip("if", "not", "exists")
        name = t.name().strip("`")
        if name.lower() in self.tables:
            if maybe:
                return
            raise ValueError(f"1050: Table '{name}' already exists")
        if t.skip("like"):
            old = self._table(t.name().strip("`"))
            self.register(name, old.df.limit(0), old.keys, old.auto, old.defaults)
            return
        if t.skip("as") or t.peek() == "select":
            self.register(name, self.spark.sql(t.query()))
            return
        t.take("(")
        fields, keys, auto, defaults = [], [], None, {}
        while True:
            if t.skip("primary", "key"):
                keys = [c.strip("`") for c in t.names()]
            elif t.peek() in ("key", "index", "unique", "constraint", "foreign", "check", "fulltext"):
                self._rest_of_item(t)
            else:
                c = t.name().strip("`")
                kind = t.next().lower()
                if kind not in _TYPES:
                    raise Unsupported(f"1235: column type {kind.upper()}")
                size = ""
                if t.skip("("):
                    size = t.next()
                    while not t.skip(")"):
                        size += t.next()
                kind = _TYPES[kind]
                fields.append(f"`{c}` {kind}({size or '10,0'})" if kind == "decimal" else f"`{c}` {kind}")
                while t.peek() not in (",", ")"):
                    if t.skip("primary", "key"):
                        keys = [c]
                    elif t.skip("auto_increment"):
                        auto = c
                    elif t.skip("default"):
                        defaults[c] = self._value(t.value())
                    else:
                        t.next()
            if not t.skip(","):
                break
        t.take(")")
        self.register(name, self.spark.createDataFrame([], ", ".join(fields)), keys, auto, defaults)

    @staticmethod
    def _rest_of_item(t: Translator) -> None:
        depth = 0
        while depth or t.peek() not in (",", ")"):
            depth += {"(": 1, ")": -1}.get(t.next(), 0)

    def _show(self, text: str, parameters: list) -> DataFrame:
        t = Translator(text)
        t.take("show")
        t.skip("full")
        if t.skip("tables"):
            out = self.spark.sql("SHOW TABLES").select(F.col("tableName").alias("Tables_in_session"))
            return out.where(F.col("Tables_in_session").like(string_value(t.next()))) if t.skip("like") else out
        if t.skip("columns") or t.skip("fields"):
            t.next()
            return self._columns(t.name().strip("`"))
        if t.skip("variables"):
            rows = [(k, str(v)) for k, v in sorted(self.system.items())]
            out = self.spark.createDataFrame(rows, "Variable_name string, Value string")
            return out.where(F.col("Variable_name").like(string_value(t.next()))) if t.skip("like") else out
        if t.skip("databases") or t.skip("schemas"):
            return self.spark.sql("SHOW DATABASES").toDF("Database")
        raise Unsupported(f"1235: SHOW {t.peek().upper()}")

    def _columns(self, name: str) -> DataFrame:
        table = self._table(name)
        rows = [(f.name, f.dataType.simpleString(), "YES" if f.nullable and f.name not in table.keys else "NO", "PRI" if f.name in table.keys else "", table.defaults.get(f.name) and str(table.defaults[f.name]), "auto_increment" if f.name == table.auto else "") for f in table.df.schema.fields]
        return self.spark.createDataFrame(rows, "Field string, Type string, `Null` string, `Key` string, `Default` string, Extra string")

    def _describe(self, text: str, parameters: list) -> DataFrame:
        return self._columns(tokens(text)[1][1].strip("`"))


__all__ = ["Session", "translate", "Unsupported"]
