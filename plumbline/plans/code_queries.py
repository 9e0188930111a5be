"""Queries of code facts: every event stands for a small file of C or Python."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import code
from plumbline.sources.tables import table

C = '/* copy_{i}() { */\n#include <x.h>\n#define CHECK(x) check_{k}((x))\n\nstatic int helper_{k}(int a)\n{\n    return a + 1; // parse_{i}()\n}\n\nint copy_{i}(char *p, int n) {\n    if (n > 3) {\n        puts("brace { in ( text");\n        helper_{k}(n);\n    }\n    return CHECK(n);\n}\n'
PYTHON = "import os\n\ndef helper_{k}(a):\n    return a + 1  # parse()\n\nclass A:\n    def copy_{i}(self, n):\n        if n:\n            helper_{k}(n)\n        return os.getcwd()\n\nprint(A)\n"


def files(spark, sf_dir) -> DataFrame:
    i = F.col("event_id")
    text = F.when(i % 3 == 2, F.lit(PYTHON)).otherwise(F.lit(C))
    for name, value in {"{i}": i, "{k}": F.col("user_id")}.items():
        text = F.replace(text, F.lit(name), value.cast("string"))
    text = F.when(i % 30 == 0, F.concat(text, F.lit("}\n"))).otherwise(text)
    return table(spark, sf_dir, "events").select(i.alias("blob"), F.when(i % 3 == 2, "python").otherwise("c").alias("lang"), text.alias("text"))


def lines(spark, sf_dir) -> DataFrame:
    return code.code_lines(files(spark, sf_dir))


def code_definitions(spark, sf_dir):
    return code.definitions(lines(spark, sf_dir))


def code_calls(spark, sf_dir):
    rows = lines(spark, sf_dir)
    return code.calls(rows, code.definitions(rows))


def code_macros(spark, sf_dir):
    return code.macros(lines(spark, sf_dir)).select("blob", "name", F.array_join("calls", ",").alias("calls"))


def code_facts(spark, sf_dir):
    return code.facts(lines(spark, sf_dir)).select("blob", "lang", "n_lines", "parsed")


def definition_digests(spark, sf_dir):
    """Equal helpers of one user have one digest."""
    rows = lines(spark, sf_dir).where("lang = 'c'")
    found = code.definition_text(rows, code.definitions(rows)).where("name LIKE 'helper%'")
    return found.groupBy("name").agg(F.count_distinct("digest").alias("versions"), F.count("*").alias("files"))


def grep_word(spark, sf_dir):
    return code.grep(lines(spark, sf_dir), "helper_1", word=True).select("blob", "line_no")


def pickaxe_history(spark, sf_dir):
    """Orders are commits, their items lines added and removed."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("commit"), F.lit("a.c").alias("path"), F.when(F.col("l_linenumber") % 2 == 0, "+").otherwise("-").alias("op"), F.concat(F.lit("x("), F.col("l_partkey") % 10, F.lit(")")).alias("text"))
    return code.pickaxe(rows, "x(3)")


QUERIES = {f.__name__: f for f in (code_definitions, code_calls, code_macros, code_facts, definition_digests, grep_word, pickaxe_history)}

_C, _P = "event_id % 3 <> 2", "event_id % 3 = 2"

ORACLE_SQL = {
    "code_definitions": f"""SELECT event_id AS blob, 'helper_' || user_id AS name, 5 AS start, 8 AS "end" FROM events WHERE {_C} UNION ALL SELECT event_id, 'copy_' || event_id, 10, 16 FROM events WHERE {_C}
 UNION ALL SELECT event_id, 'helper_' || user_id, 3, 5 FROM events WHERE {_P} UNION ALL SELECT event_id, 'copy_' || event_id, 7, 11 FROM events WHERE {_P}""",
    "code_calls": f"""SELECT event_id AS blob, 'copy_' || event_id AS caller, unnest(['puts', 'helper_' || user_id, 'CHECK']) AS callee, unnest([12, 13, 15]) AS line_no FROM events WHERE {_C}
 UNION ALL SELECT event_id, 'copy_' || event_id, unnest(['helper_' || user_id, 'getcwd']), unnest([9, 10]) FROM events WHERE {_P}""",
    "code_macros": f"SELECT event_id AS blob, 'CHECK' AS name, 'check_' || user_id AS calls FROM events WHERE {_C}",
    "code_facts": "SELECT event_id AS blob, CASE WHEN event_id % 3 = 2 THEN 'python' ELSE 'c' END AS lang, (CASE WHEN event_id % 3 = 2 THEN 13 ELSE 17 END + CASE WHEN event_id % 30 = 0 THEN 1 ELSE 0 END)::INTEGER AS n_lines, event_id % 30 <> 0 AS parsed FROM events",
    "definition_digests": f"SELECT 'helper_' || user_id AS name, 1 AS versions, count(*) AS files FROM events WHERE {_C} GROUP BY user_id",
    "grep_word": f"SELECT event_id AS blob, unnest([5, 13]) AS line_no FROM events WHERE {_C} AND user_id = 1 UNION ALL SELECT event_id, unnest([3, 9]) FROM events WHERE {_P} AND user_id = 1",
    "pickaxe_history": "SELECT l_orderkey AS \"commit\", sum(CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE -1 END)::BIGINT AS delta FROM lineitem WHERE l_partkey % 10 = 3 GROUP BY l_orderkey HAVING sum(CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE -1 END) <> 0",
}
