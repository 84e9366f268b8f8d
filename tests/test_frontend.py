"""The front end: what it refuses, and state between statements."""

import pytest

from quern.frontend.session import Session
from quern.frontend.translate import Unsupported, tokens, translate


def test_tokens_and_errors():
    assert [x for _, x in tokens("SELECT `a b`, 'it''s' -- end\n/* x */ <=> @v")] == ["SELECT", "`a b`", ",", "'it''s'", "<=>", "@v"]
    for bad in ("SELECT FROM t WHERE", "SELECT 1 +", "SELECT a FROM t GROUP", "SELECT CAST(1 AS THING)", "SELECT @@nothing", "SELECT 1 2 3"):
        with pytest.raises(Unsupported):
            translate(bad)


def test_precedence(spark):
    one = lambda text: spark.sql(translate(text)).first()[0]
    assert one("SELECT 1 OR 0 AND 0") == 1
    assert one("SELECT NOT 1 = 2") == 1
    assert one("SELECT 2 + 3 * 4 DIV 5") == 4
    assert one("SELECT 1 | 6 & 3") == 3
    assert one("SELECT NULL <=> NULL") == 1
    assert one("SELECT NULL IS NOT TRUE XOR 0") == 1
    assert one("SELECT 'É' = 'e' AND 'a ' <> 'b'") == 1
    assert one("SELECT ~0") == 18446744073709551615
    assert one("SELECT CONCAT('a', NULL)") is None
    assert one("SELECT 'a\\'b' 'c'") == "a'bc"


def test_state(spark):
    s = Session(spark)
    s.execute("CREATE TABLE t_state (id BIGINT AUTO_INCREMENT PRIMARY KEY, v VARCHAR(9))")
    s.execute("INSERT INTO t_state (v) VALUES ('a'), (?)", ["b"])
    assert s.row_count == 2 and s.execute("SELECT LAST_INSERT_ID()").first()[0] == 1
    with pytest.raises(ValueError, match="1062"):
        s.execute("INSERT INTO t_state VALUES (1, 'again')")
    s.execute("UPDATE t_state SET v = 'z' ORDER BY id DESC LIMIT 1")
    assert [tuple(r) for r in s.execute("SELECT * FROM t_state ORDER BY id").collect()] == [(1, "a"), (2, "z")]
    s.execute("DELETE FROM t_state WHERE v = 'Z'")
    assert s.execute("SELECT COUNT(*) FROM t_state").first()[0] == 1
    s.execute("SET sql_select_limit = 0")
    assert s.execute("SELECT * FROM t_state").count() == 0
    s.execute("SET sql_select_limit = DEFAULT")
    s.execute("TRUNCATE TABLE t_state")
    s.execute("PREPARE p FROM 'SELECT COUNT(*) FROM t_state'")
    assert s.execute("EXECUTE p").first()[0] == 0
    s.execute("DEALLOCATE PREPARE p")
    with pytest.raises(Unsupported, match="1243"):
        s.execute("EXECUTE p")
    with pytest.raises(ValueError, match="1172"):
        s.execute("SELECT 1 UNION ALL SELECT 2 INTO @x")
    assert "lower_case_table_names" in [r[0] for r in s.execute("SHOW VARIABLES LIKE 'lower%'").collect()]
    s.execute("DROP TABLE t_state")
    with pytest.raises(ValueError, match="1051"):
        s.execute("DROP TABLE t_state")
