"""Queries of qualified names: every part stands for a small file of one of eight languages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import scopes
from plumbline.sources.tables import spread, table

#: Of each language a file, and what it defines: line, name, qualified name, kind. {k} is the part's number.
FILES = (
    ("c", "static int API_CALL(1) add_{k}(int a,\n    int b)\n{\n    if (a) { run(a); }\n    return a;\n}\n\nEXPORTED int sub_{k}(int a) {\n    return a;\n}\n", ((1, "add_{k}", "add_{k}", "function"), (8, "sub_{k}", "sub_{k}", "function"))),
    (
        "cpp",
        "namespace net {\nclass Box{k} : public Base {\n  int size() const { return n; }\n  void grow(int by) {\n    while (by) { by--; }\n  }\n};\nint Box{k}::area(int x)\n{\n  return x;\n}\n}\nint main() {\n}\n",
        ((1, "net", "net", "module"), (2, "Box{k}", "net::Box{k}", "class"), (3, "size", "net::Box{k}::size", "method"), (4, "grow", "net::Box{k}::grow", "method"), (8, "area", "net::Box{k}::area", "function"), (13, "main", "main", "function")),
    ),
    ("java", "public class A{k} {\n    private int get(int i) {\n        return call(i);\n    }\n    static class In {\n        void put() {\n        }\n    }\n}\n", ((1, "A{k}", "A{k}", "class"), (2, "get", "A{k}.get", "method"), (5, "In", "A{k}.In", "class"), (6, "put", "A{k}.In.put", "method"))),
    ("javascript", "export class B{k} {\n  async load(x) {\n    function inner(y) {\n      return y;\n    }\n  }\n}\nfunction top{k}(a) {\n}\n", ((1, "B{k}", "B{k}", "class"), (2, "load", "B{k}.load", "method"), (3, "inner", "B{k}.load.inner", "function"), (8, "top{k}", "top{k}", "function"))),
    ("go", "package p\n\nfunc (b *Box{k}) Size(x int) int {\n\treturn x\n}\n\nfunc New{k}() {\n}\n", ((3, "Size", "Box{k}.Size", "method"), (7, "New{k}", "New{k}", "function"))),
    ("rust", "mod m{k} {\n    impl Show for Box {\n        pub fn show(&self) -> i32 {\n            1\n        }\n    }\n    fn free() {\n    }\n}\n", ((1, "m{k}", "m{k}", "module"), (3, "show", "m{k}::Box::show", "method"), (7, "free", "m{k}::free", "function"))),
    ("python", "class C{k}:\n    def get(self):\n        def local(x):\n            return x\n        return local\n\nasync def run{k}(a,\n        b):\n    pass\n", ((1, "C{k}", "C{k}", "class"), (2, "get", "C{k}.get", "method"), (3, "local", "C{k}.get.local", "function"), (7, "run{k}", "run{k}", "function"))),
    ("ruby", "module Net{k}\n  class Box\n    def size?(x)\n      x\n    end\n  end\nend\ndef top{k}\nend\n", ((1, "Net{k}", "Net{k}", "module"), (2, "Box", "Net{k}::Box", "class"), (3, "size?", "Net{k}::Box::size?", "method"), (8, "top{k}", "top{k}", "function"))),
)


def files(spark, sf_dir) -> DataFrame:
    k = F.col("p_partkey")
    pick = lambda i: F.get(F.array(*[F.lit(f[i]) for f in FILES]), (k % len(FILES)).cast("int"))
    return spread(table(spark, sf_dir, "part")).select(k.alias("blob"), pick(0).alias("lang"), F.replace(pick(1), F.lit("{k}"), k.cast("string")).alias("text"))


def qualified_names(spark, sf_dir):
    return scopes.symbols(files(spark, sf_dir)).select("blob", "line_no", "name", "qname", "kind")


#: Heads of one function, written in two ways, and one that differs.
HEADS = ("static int f(int a, char *b)\n{\n}\n", "static  int f( int a,\n             char * b ) {\n}\n", "int f(int a, char *b)\n{\n}\n")


def signature_digests(spark, sf_dir):
    """Heads that differ in white space alone have one signature."""
    k = F.col("p_partkey")
    rows = spread(table(spark, sf_dir, "part")).select(k.alias("blob"), F.lit("c").alias("lang"), F.get(F.array(*[F.lit(h) for h in HEADS]), (k % 3).cast("int")).alias("text"))
    found = scopes.symbols(rows).select("signature", F.array_join("flags", ",").alias("flags"))
    return found.groupBy("flags").agg(F.count_distinct("signature").alias("signatures"), F.count("*").alias("n"))


def macros_blanked(spark, sf_dir):
    """Attribute macros gone, every other character where it was."""
    text = F.concat(F.lit("EXPORT_"), F.col("p_size") % 10, F.lit(" int f(int a);\nint CALL_(x, (y)) g(void) {\n  MACRO(a);\n}\nTYPE name;\n#define MAX_"), F.col("p_size"), F.lit(" int h(\n"))
    return spread(table(spark, sf_dir, "part")).select("p_partkey", scopes.without_macros(text).alias("text"), F.length(text).alias("n"))


def snippet_names(spark, sf_dir):
    return files(spark, sf_dir).select("blob", F.array_join(scopes.defined_names(F.col("text")), ",").alias("names"))


QUERIES = {f.__name__: f for f in (qualified_names, signature_digests, macros_blanked, snippet_names)}


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''").replace("{k}", "' || p_partkey || '") + "'"


NAMES = ("add_{k},sub_{k}", "size,grow,area,main", "get,put", "load,inner,top{k}", "Size,New{k}", "show,free", "get,local,run{k}", "size?,top{k}")
ORACLE_SQL = {
    "qualified_names": " UNION ALL ".join(f"SELECT p_partkey AS blob, {at} AS line_no, {_sql(n)} AS name, {_sql(q)} AS qname, '{kind}' AS kind FROM part WHERE p_partkey % {len(FILES)} = {i}" for i, (_, _, found) in enumerate(FILES) for at, n, q, kind in found),
    "signature_digests": "SELECT CASE WHEN p_partkey % 3 = 2 THEN '' ELSE 'static' END AS flags, 1::BIGINT AS signatures, count(*) AS n FROM part GROUP BY 1",
    "macros_blanked": "SELECT *, length(text) AS n FROM (SELECT p_partkey, repeat(' ', 8) || ' int f(int a);' || chr(10) || 'int ' || repeat(' ', 13) || ' g(void) {' || chr(10) || '  MACRO(a);' || chr(10) || '}' || chr(10) || 'TYPE name;' || chr(10) || '#define MAX_' || p_size || ' int h(' || chr(10) AS text FROM part)",
    "snippet_names": "SELECT p_partkey AS blob, CASE p_partkey % 8 " + " ".join(f"WHEN {i} THEN {_sql(n)}" for i, n in enumerate(NAMES)) + " END AS names FROM part",
}
