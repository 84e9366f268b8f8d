"""Registered queries in MySQL text, run through the front end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..frontend.session import Session
from ..sources.tables import table, views

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _mysql(name: str, text: str, duck: str, *before: str, parameters=()) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        views(spark, sf_dir, " ".join((text, *before)))
        session = Session(spark)
        for s in before:
            session.execute(s)
        return session.execute(text, parameters)

    QUERIES[name] = run
    ORACLE_SQL[name] = duck


_mysql("mysql_select", "SELECT c.`c_custkey` AS k, c_name nm, c_acctbal > 0 AS pos, NOT c_nationkey AS n0 FROM customer c WHERE c_mktsegment = 'building' && c_acctbal BETWEEN -500 AND 5000 OR c_custkey < 3",
       "SELECT c_custkey AS k, c_name AS nm, CAST(c_acctbal > 0 AS INT) AS pos, CAST(c_nationkey = 0 AS INT) AS n0 FROM customer WHERE (lower(c_mktsegment) = 'building' AND c_acctbal BETWEEN -500 AND 5000) OR c_custkey < 3")
_mysql("mysql_operators", "SELECT c_custkey, c_custkey DIV 7 AS d, c_custkey % 7 AS m, c_custkey MOD 0 AS z, c_custkey / 0 AS q, (c_custkey & 6) | 1 AS b, c_custkey << 2 AS l, c_custkey XOR 1 AS x, c_nationkey <=> NULL AS n, !c_nationkey AS t, -c_custkey + 2 * 3 AS s FROM customer",
       "SELECT c_custkey, c_custkey // 7 AS d, c_custkey % 7 AS m, NULL::BIGINT AS z, NULL::DOUBLE AS q, (c_custkey & 6) | 1 AS b, c_custkey * 4 AS l, CAST(c_custkey = 0 AS INT) AS x, CAST(c_nationkey IS NULL AS INT) AS n, CAST(c_nationkey = 0 AS INT) AS t, 6 - c_custkey AS s FROM customer")
_mysql("mysql_limit_pair", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5, 10", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5")
_mysql("mysql_rollup", "SELECT c_nationkey, COUNT(*) AS n, GROUPING(c_nationkey) AS g FROM customer GROUP BY c_nationkey WITH ROLLUP", "SELECT c_nationkey, count(*) AS n, CAST(grouping(c_nationkey) AS TINYINT) AS g FROM customer GROUP BY ROLLUP (c_nationkey)")
_mysql("mysql_joins", "SELECT STRAIGHT_JOIN o.o_orderkey, n_name FROM orders o USE INDEX (x) INNER JOIN customer c ON o.o_custkey = c.c_custkey LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey AND n_regionkey <> 2 WHERE o_orderstatus LIKE 'f'",
       "SELECT o_orderkey, n_name FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey AND n_regionkey <> 2 WHERE o_orderstatus = 'F'")
_mysql("mysql_subqueries", "SELECT c_custkey, (SELECT MAX(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS m FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000) AND c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)",
       "SELECT c_custkey, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS m FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000) AND c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
_mysql("mysql_quantified", "SELECT c_custkey, c_nationkey > ALL (SELECT n_nationkey FROM nation WHERE n_regionkey = 0) AS a, c_nationkey = ANY (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) AS s FROM customer",
       "SELECT c_custkey, CAST(c_nationkey > (SELECT max(n_nationkey) FROM nation WHERE n_regionkey = 0) AS INT) AS a, CAST(c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) AS INT) AS s FROM customer")
_mysql("mysql_functions", "SELECT c_custkey, IF(c_acctbal > 0, 'plus', 'minus') AS i, IFNULL(NULLIF(c_nationkey, 1), -1) AS f, CONCAT_WS('-', c_name, NULL, LEFT(c_mktsegment, 2)) AS c, MID(c_name, -3) AS r, LOCATE('OMER', c_name) AS l, FIELD(c_mktsegment, 'machinery', 'building') AS d, ELT(c_custkey % 3, 'a', 'b') AS e, TRIM(LEADING 'Cu' FROM c_name) AS t, CAST('12abc' AS SIGNED) + c_custkey AS g, c_name REGEXP '^cust' AS x, GREATEST(c_custkey, NULL) AS z FROM customer",
       "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 'plus' ELSE 'minus' END AS i, coalesce(nullif(c_nationkey, 1), -1) AS f, c_name || '-' || left(c_mktsegment, 2) AS c, right(c_name, 3) AS r, CAST(4 + strpos(substr(c_name, 5), 'zz') + 1 AS INT) AS l, CAST(CASE c_mktsegment WHEN 'MACHINERY' THEN 1 WHEN 'BUILDING' THEN 2 ELSE 0 END AS INT) AS d, CASE c_custkey % 3 WHEN 1 THEN 'a' WHEN 2 THEN 'b' END AS e, substr(c_name, 3) AS t, 12 + c_custkey AS g, 1 AS x, NULL::BIGINT AS z FROM customer")
_mysql("mysql_dates", "SELECT o_orderkey, DATE_ADD(o_orderdate, INTERVAL 1 MONTH) AS a, o_orderdate - INTERVAL 36 HOUR AS b, EXTRACT(YEAR_MONTH FROM o_orderdate) AS c, TIMESTAMPDIFF(DAY, '1995-01-01', o_orderdate) AS d, DAYNAME(o_orderdate) AS e FROM orders",
       "SELECT o_orderkey, o_orderdate + INTERVAL 1 MONTH AS a, o_orderdate - INTERVAL 36 HOUR AS b, CAST(year(o_orderdate) * 100 + month(o_orderdate) AS INT) AS c, date_diff('day', DATE '1995-01-01', o_orderdate) AS d, dayname(o_orderdate) AS e FROM orders")
_mysql("mysql_group_concat", "SELECT n_regionkey, GROUP_CONCAT(DISTINCT n_name ORDER BY n_name SEPARATOR '; ') AS g, STD(n_nationkey) > 1 AS s FROM nation GROUP BY n_regionkey HAVING COUNT(*) > 1",
       "SELECT n_regionkey, string_agg(DISTINCT n_name, '; ' ORDER BY n_name) AS g, CAST(stddev_pop(n_nationkey) > 1 AS INT) AS s FROM nation GROUP BY n_regionkey HAVING count(*) > 1")
_mysql("mysql_windows", "SELECT o_orderkey, RANK() OVER w AS r, SUM(o_custkey) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS s, LAG(o_orderkey, 1) OVER (ORDER BY o_orderkey ROWS 2 PRECEDING) AS l FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC)",
       "SELECT o_orderkey, CAST(rank() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC) AS INT) AS r, CAST(sum(o_custkey) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS BIGINT) AS s, lag(o_orderkey, 1) OVER (ORDER BY o_orderkey) AS l FROM orders")
_mysql("mysql_cte_union", "WITH a AS (SELECT c_nationkey AS k FROM customer), b (k) AS (SELECT s_nationkey FROM supplier) SELECT k FROM a UNION SELECT k FROM b UNION ALL (SELECT -1)",
       "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier UNION ALL SELECT -1")
_mysql("mysql_values", "VALUES ROW(1, 'a'), ROW(2, NULL)", "SELECT * FROM (VALUES (1, 'a'), (2, NULL)) t(column_0, column_1)")
_mysql("mysql_table", "TABLE nation ORDER BY n_nationkey LIMIT 3", "SELECT * FROM nation ORDER BY n_nationkey LIMIT 3")
_mysql("mysql_collate", "SELECT c_custkey, c_mktsegment COLLATE utf8mb4_bin = 'building' AS b, BINARY c_mktsegment = 'BUILDING' AS c, c_mktsegment IN ('building', 'machinery') AS i, c_name LIKE BINARY 'cust%' AS l FROM customer",
       "SELECT c_custkey, 0 AS b, CAST(c_mktsegment = 'BUILDING' AS INT) AS c, CAST(c_mktsegment IN ('BUILDING', 'MACHINERY') AS INT) AS i, 0 AS l FROM customer")
_mysql("mysql_json_arrows", "SELECT event_id, props->'$.k' + 1 AS a, props->>'$.k' AS b FROM events", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) + 1 AS a, json_extract_string(props, '$.k') AS b FROM events")
_mysql("mysql_variables", "SELECT o_orderkey, @n AS n, @@autocommit AS a FROM orders WHERE o_custkey = @low + 1", "SELECT o_orderkey, (SELECT count(*) FROM nation) AS n, 1 AS a FROM orders WHERE o_custkey = 4", "SET @low = 1 + 2, @s = 'text'", "SELECT COUNT(*) FROM nation INTO @n")
_mysql("mysql_prepared", "EXECUTE q USING @a, @b", "SELECT o_orderkey FROM orders WHERE o_custkey BETWEEN 3 AND 9", "SET @a = 3, @b = 9", "PREPARE q FROM 'SELECT o_orderkey FROM orders WHERE o_custkey BETWEEN ? AND ?'")
_mysql("mysql_found_rows", "SELECT FOUND_ROWS() AS n, CONNECTION_ID() > 0 AS c, DATABASE() AS d, VERSION() LIKE '8.4%' AS v, CURRENT_USER() AS u", "SELECT (SELECT count(*) FROM orders WHERE o_custkey < 20) AS n, 1 AS c, 'default' AS d, 1 AS v, 'root@%' AS u", "SELECT SQL_CALC_FOUND_ROWS o_orderkey FROM orders WHERE o_custkey < 20 LIMIT 2")
_mysql("mysql_locks", "SELECT GET_LOCK('one', 0) AS g, IS_FREE_LOCK('two') AS f, IS_USED_LOCK('one') = CONNECTION_ID() AS u, RELEASE_ALL_LOCKS() AS r, RELEASE_LOCK('one') AS n", "SELECT 1 AS g, 1 AS f, 1 AS u, 1 AS r, NULL::INT AS n")
_mysql("mysql_writes", "SELECT id, name, n FROM t_w", "SELECT * FROM (VALUES (1, 'a', 11), (2, 'changed', 7), (4, 'x', 5)) t(id, name, n)",
       "CREATE TABLE t_w (id INT NOT NULL AUTO_INCREMENT PRIMARY KEY, name VARCHAR(20) DEFAULT 'x', n INT DEFAULT 5)", "INSERT INTO t_w (name, n) VALUES ('a', 1), ('b', 2), ('c', 3)", "INSERT INTO t_w (id, name, n) VALUES (1, 'new', 10) ON DUPLICATE KEY UPDATE n = n + VALUES(n)",
       "INSERT IGNORE INTO t_w (id, name) VALUES (2, 'no'), (4, DEFAULT)", "REPLACE INTO t_w (id, name, n) VALUES (2, 'r', 7)", "UPDATE t_w SET name = 'changed' WHERE id = 2", "DELETE FROM t_w WHERE n = 3", "DROP TABLE IF EXISTS none_w")
_mysql("mysql_create_like", "SELECT k, n FROM c_l", "SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1", "DROP TABLE IF EXISTS c_a, c_l", "CREATE TABLE c_a AS SELECT c_nationkey AS k, COUNT(*) AS n FROM customer GROUP BY c_nationkey", "CREATE TABLE c_l LIKE c_a", "INSERT INTO c_l SELECT k, n FROM c_a")
_mysql("mysql_show_columns", "SHOW COLUMNS FROM region", "SELECT * FROM (VALUES ('r_regionkey', 'int', 'YES', '', NULL::VARCHAR, ''), ('r_name', 'string', 'YES', '', NULL, '')) t(\"Field\", \"Type\", \"Null\", \"Key\", \"Default\", \"Extra\")", "SELECT COUNT(*) FROM region INTO @x")
_mysql("mysql_parameters", "SELECT o_orderkey FROM orders WHERE o_orderstatus = ? AND o_custkey < ? ORDER BY o_orderkey LIMIT ?", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey < 50 ORDER BY o_orderkey LIMIT 12", parameters=("f", 50, 12))
_mysql("mysql_view", "SELECT k, n FROM v_n WHERE n > 2", "SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1 HAVING count(*) > 2", "CREATE OR REPLACE VIEW v_n AS SELECT c_nationkey AS k, COUNT(*) AS n FROM customer GROUP BY c_nationkey")
_mysql("mysql_system", "SELECT BENCHMARK(10, 1 + 1) AS b, CURRENT_ROLE() AS r, SCHEMA() = DATABASE() AS s, SESSION_USER() AS su, SYSTEM_USER() AS sy, USER() AS u, NAME_CONST('x', 14) AS n, LOAD_FILE('/none') IS NULL AS l, ICU_VERSION() > '7' AS i, SLEEP(0) AS z, IS_UUID(UUID()) AS d, LENGTH(RANDOM_BYTES(5)) AS y, RAND() BETWEEN 0 AND 1 AS a, UUID_SHORT() > 0 AS h, VALIDATE_PASSWORD_STRENGTH('abcdEF1!') AS p, ROW_COUNT() AS c, LAST_INSERT_ID() AS t",
       "SELECT 0 AS b, 'NONE' AS r, 1 AS s, 'root@%' AS su, 'root@%' AS sy, 'root@%' AS u, 14 AS n, 1 AS l, 1 AS i, 0 AS z, 1 AS d, 5 AS y, 1 AS a, 1 AS h, 100 AS p, 0 AS c, 0 AS t")
_mysql("mysql_now", "SELECT NOW() = CURRENT_TIMESTAMP AS a, CURDATE() = CURRENT_DATE() AS b, SYSDATE() >= NOW() AS c, UTC_TIMESTAMP() IS NOT NULL AS d, LENGTH(CURTIME()) AS e, UTC_DATE() IS NULL AS f, LOCALTIME() = NOW() AS g, LENGTH(UTC_TIME()) AS h", "SELECT 1 AS a, 1 AS b, 1 AS c, 1 AS d, 8 AS e, 0 AS f, 1 AS g, 8 AS h")
_mysql("mysql_xml", "SELECT c_custkey, EXTRACTVALUE(CONCAT('<a><b>', c_name, '</b></a>'), '/a/b') AS v, EXTRACTVALUE('<a/>', '/a/c') AS e FROM customer", "SELECT c_custkey, c_name AS v, '' AS e FROM customer")
_mysql("mysql_periods", "SELECT o_orderkey, PERIOD_ADD(199800 + MONTH(o_orderdate), 11) AS a, PERIOD_DIFF(199901, 199800 + MONTH(o_orderdate)) AS d, MAKEDATE(1998, o_orderkey % 300) AS m, TO_DAYS(o_orderdate) AS t, INET_ATON('10.0.0.9') AS i FROM orders",
       "SELECT o_orderkey, CAST((1998 * 12 + month(o_orderdate) - 1 + 11) // 12 * 100 + (1998 * 12 + month(o_orderdate) - 1 + 11) % 12 + 1 AS BIGINT) AS a, CAST(13 - month(o_orderdate) AS BIGINT) AS d, CASE WHEN o_orderkey % 300 > 0 THEN CAST(DATE '1998-01-01' + CAST(o_orderkey % 300 - 1 AS INT) AS DATE) END AS m, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) + 719528 AS INT) AS t, CAST(167772169 AS BIGINT) AS i FROM orders")
_mysql("mysql_json", "SELECT event_id, JSON_SET(props, '$.a', event_type, '$.k', 1) AS s, JSON_REMOVE(props, '$.k') AS r, JSON_CONTAINS(props, '7', '$.k') AS c, JSON_KEYS(props) AS k, JSON_LENGTH(props) AS l, JSON_TYPE(JSON_EXTRACT(props, '$.k')) AS t, JSON_MERGE_PATCH(props, '{\"z\": null}') AS m, props->>'$.k' AS u, JSON_VALID(props) AS v FROM events",
       "SELECT event_id, '{\"a\": \"' || event_type || '\", \"k\": 1}' AS s, '{}' AS r, CAST(json_extract_string(props, '$.k') = '7' AS INT) AS c, '[\"k\"]' AS k, 1 AS l, 'INTEGER' AS t, props AS m, json_extract_string(props, '$.k') AS u, 1 AS v FROM events")
