"""Queries of structured extraction: events as reports of several shapes, with the rows that each shape must give."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import extraction
from plumbline.sources.tables import spread, table
from plumbline.staging import staged

#: Reports by shape; {k} is the event's user, {n} a number from 1 to 300.
VERSIONS = "It shows from 1.{k}.0 to 1.{k}.9 and was fixed in 2.0.{k}. Tested on 1.{k}.3 as of 2026-05-02.\n\nExample 1.2.{k} and earlier are open, all versions before 3.{k}.1 too, since 0.{k}.5 or so.\nConstraint >= 1.0.1, < 1.{k}.7rc1. Seen on master, at commit abcdef{n}f and in tag curl-8_{k}_0; not at 0x1234abcd1234.\n```\nversion 9.9.9 in a log\n```\nversion 7.{k} here"
BLOCKS = "Vulnerable code in src/m{k}/hdr.c near copy_{k}():\n```c\nint copy_{k}(char *p, int n)\n{\n  return n;\n}\n#define LIMIT_{k} 4\n```\nIt goes on.\n\n\n\n~~~~\nplain text with a ``` fence\n~~~\nstill inside\n~~~~\n\nRun it:\n```sh\n# a comment\nCC=gcc ./build --opt-{k}\nsudo -n hdrcat --fold-{k} x{n}\n```\nand\n```\n$ gcc --std-{k} a.c\n```\nwith\n```diff\n--- a/src/x{k}.c\n+++ b/src/x{k}.c\n@@ -{n},3 +{n},3 @@ int f(void)\n a\n-b\n+c\n d\n```\n```patch\n--- a/gone.c\n+++ /dev/null\n@@ -1,2 +0,0 @@\n-x\n--- y\n```"
LINES = "See src/m{k}/util.c:{n}:7 and line {n} of `lib/hdr.h`, or lib/big.c, lines 10-{n}0; also config.h.in and /usr/include/x.h, ~/w/y.py, /tmp/poc.c, Node.js and 1.2.3.\nhttps://github.com/o{k}/r/blob/v1.{k}/src/p.c#L{n}-L400 and https://example.org/src/q.c:5 too."
SYMBOLS = "The function `parse_{k}` calls `memcpy` and helper_{k}() has no bounds check in `read_{k}`. The macro LIMIT_{k} and `ns::Cls{k}::m(int)` matter; a `size` and fooBar{k} handler too. use-after-free in free_{k}; `drop_{k}` does not check the length. curl{k}.mode=1 and --verbose-{k}, `gcc --Wall-{k}` or `hdrcat --fold-{k}`; CURLOPT_X{k} set.\n\ndiff --git a/p{k}.c b/p{k}.c\n--- a/p{k}.c\n+++ b/p{k}.c\n@@ -{n} +{n},2 @@\n-old\n+new\n+more\nend"
SHAPES = (VERSIONS, BLOCKS, LINES, SYMBOLS)
PROGRAMS, PREFIXES, PRODUCTS = ["hdrcat"], ["CURLOPT_"], {"Example": "example", "curl": "curl"}


def reports(spark, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    body = F.get(F.array(*[F.lit(s) for s in SHAPES]), (i % len(SHAPES)).cast("int"))
    for name, value in {"{k}": F.col("user_id").cast("string"), "{n}": (i % 300 + 1).cast("string")}.items():
        body = F.replace(body, F.lit(name), value)
    return spread(table(spark, sf_dir, "events")).select(i.alias("report_id"), F.lit("A report").alias("title"), body.alias("body"))


def version_claims(spark, sf_dir):
    return extraction.version_claims(reports(spark, sf_dir), PRODUCTS).select("report_id", "raw", "relation", "parsed", "lower", "upper", "upper_inclusive", "special_ref", F.col("as_of").cast("string").alias("as_of"), "commit", "product")


def version_places(spark, sf_dir):
    rows = reports(spark, sf_dir)
    found = extraction.version_claims(rows, PRODUCTS).join(rows.select("report_id", "body"), "report_id")
    return found.groupBy("report_id").agg(F.count("*").alias("claims"), F.count_if(F.lower(F.substr("body", F.col("start") + 1, F.col("end") - F.col("start"))) == F.lower("raw")).alias("exact"))


def location_claims(spark, sf_dir):
    return extraction.location_claims(reports(spark, sf_dir)).select("report_id", "kind", "path", "line", "end_line", "col", "provenance", F.concat_ws("/", "permalink.host", "permalink.owner", "permalink.repo", "permalink.ref").alias("permalink"))


def symbol_claims(spark, sf_dir):
    return extraction.symbol_claims(reports(spark, sf_dir)).select("report_id", "name", "kind")


def fenced_code(spark, sf_dir):
    return extraction.block_rows(reports(spark, sf_dir)).select("report_id", "block", "info", "role", F.md5(F.col("content").cast("binary")).alias("digest"))


def block_commands(spark, sf_dir):
    return extraction.commands(extraction.block_rows(reports(spark, sf_dir))).select("report_id", "block", "line_no", "command", "program")


def poc_claims(spark, sf_dir):
    return extraction.poc_claims(extraction.block_rows(reports(spark, sf_dir)))


def snippet_claims(spark, sf_dir):
    return extraction.snippet_claims(reports(spark, sf_dir)).select("report_id", "block", "n_lines", "path", "function", F.array_join("defines", ",").alias("defines"), "provenance")


def patch_hunks(spark, sf_dir):
    found = extraction.patch_hunks(extraction.diff_texts(reports(spark, sf_dir)))
    return found.select("report_id", "patch", F.col("hunk").cast("int").alias("hunk"), "path", "source_start", "source_length", "target_start", "target_length", "section", F.array_join(F.transform("lines", lambda x: F.concat(x["op"], x["text"])), "|").alias("lines"), "sound")


def patch_claims(spark, sf_dir):
    diffs = staged(extraction.diff_texts(reports(spark, sf_dir)))
    return extraction.patch_claims(diffs, extraction.patch_hunks(diffs)).select("report_id", "patch", F.array_join("files", ",").alias("files"), F.col("n_hunks").cast("int").alias("n_hunks"), "confidence")


def option_claims(spark, sf_dir):
    return extraction.option_claims(reports(spark, sf_dir), PROGRAMS, PREFIXES).withColumn("mentions", F.col("mentions").cast("int"))


def behavior_claims(spark, sf_dir):
    return extraction.behavior_claims(reports(spark, sf_dir)).drop("start")


QUERIES = {f.__name__: f for f in (version_claims, version_places, location_claims, symbol_claims, fenced_code, block_commands, poc_claims, snippet_claims, patch_hunks, patch_claims, option_claims, behavior_claims)}


def _value(x) -> str:
    """A literal with {k} and {n} as expressions; (text,) is one to be cast to a number."""
    if isinstance(x, tuple):
        return f"({_value(x[0])})::INTEGER"
    if x is None or isinstance(x, (bool, int, float)):
        return "NULL" if x is None else str(x).lower() if isinstance(x, bool) else str(x) + ("::DOUBLE" if isinstance(x, float) else "")
    return "'" + x.replace("'", "''").replace("{k}", "' || user_id || '").replace("{n}", "' || (event_id % 300 + 1) || '") + "'"


def _rows(columns: str, *rows: tuple) -> str:
    """SQL of rows (shape, values...) for every report of the shape."""
    return " UNION ALL ".join(f"SELECT event_id AS report_id, {', '.join(f'{_value(v)} AS {c}' for c, v in zip(columns.split(), values, strict=True))} FROM events WHERE event_id % {len(SHAPES)} = {shape}" for shape, *values in rows)


def _range(shape: int, raw: str, lower: str | None, upper: str | None, inclusive: bool | None, product: str | None = None) -> tuple:
    return shape, raw, "affected_range", None, lower, upper, inclusive, None, None, None, product


def _at(shape: int, raw: str, relation: str, parsed: str | None, special: str | None = None, as_of: str | None = None, commit: str | None = None) -> tuple:
    return shape, raw, relation, parsed, None, None, None, special, as_of, commit, None


ORACLE_SQL = {
    "version_claims": _rows(
        "raw relation parsed lower upper upper_inclusive special_ref as_of commit product",
        _range(0, "from 1.{k}.0 to 1.{k}.9", "1.{k}.0", "1.{k}.9", True),
        _at(0, "2.0.{k}", "fixed_in", "2.0.{k}"),
        _at(0, "1.{k}.3", "tested_on", "1.{k}.3"),
        _at(0, "as of 2026-05-02", "unspecified", None, as_of="2026-05-02"),
        _range(0, "Example 1.2.{k} and earlier", None, "1.2.{k}", True, "example"),
        _range(0, "all versions before 3.{k}.1", None, "3.{k}.1", False),
        _range(0, "0.{k}.5", "0.{k}.5", None, None),
        _range(0, ">= 1.0.1, < 1.{k}.7rc1", "1.0.1", "1.{k}.7rc1", False),
        _at(0, "on master", "latest", None, special="master"),
        _at(0, "abcdef{n}f", "tested_on", None, commit="abcdef{n}f"),
        _at(0, "curl-8_{k}_0", "tested_on", "8.{k}.0"),
        _at(0, "version 7.{k}", "tested_on", "7.{k}"),
        _at(2, "v1.{k}", "tested_on", "1.{k}"),
    ),
    "version_places": "SELECT event_id AS report_id, CASE event_id % 4 WHEN 0 THEN 12 ELSE 1 END::BIGINT AS claims, CASE event_id % 4 WHEN 0 THEN 12 ELSE 1 END::BIGINT AS exact FROM events WHERE event_id % 4 IN (0, 2)",
    "location_claims": _rows(
        "kind path line end_line col provenance permalink",
        (1, "file", "src/m{k}/hdr.c", None, None, None, "project_attributed", ""),
        (2, "line", "src/m{k}/util.c", ("{n}",), None, 7, "project_attributed", ""),
        (2, "line", "lib/hdr.h", ("{n}",), None, None, "project_attributed", ""),
        (2, "file", "config.h.in", None, None, None, "project_attributed", ""),
        (2, "file", "/usr/include/x.h", None, None, None, "third_party", ""),
        (2, "file", "~/w/y.py", None, None, None, "unscoped", ""),
        (2, "file", "/tmp/poc.c", None, None, None, "reporter_artifact", ""),
        (2, "line", "src/p.c", ("{n}",), 400, None, "project_attributed", "github.com/o{k}/r/v1.{k}"),
    )
    + " UNION ALL SELECT event_id, 'line', 'lib/big.c', 10, CASE WHEN event_id % 300 > 0 THEN (event_id % 300 + 1) * 10 END, NULL, 'project_attributed', '' FROM events WHERE event_id % 4 = 2",
    "symbol_claims": _rows("name kind", (1, "copy_{k}", "function"), (3, "parse_{k}", "function"), (3, "memcpy", "unknown"), (3, "helper_{k}", "function"), (3, "read_{k}", "unknown"), (3, "LIMIT_{k}", "macro"), (3, "fooBar{k}", "function"), (3, "drop_{k}", "unknown")),
    "block_commands": _rows("block line_no command program", (1, 2, 1, "CC=gcc ./build --opt-{k}", "build"), (1, 2, 2, "sudo -n hdrcat --fold-{k} x{n}", "hdrcat"), (1, 3, 0, "gcc --std-{k} a.c", "gcc")),
    "poc_claims": _rows("block poc_kind entry", (1, 2, "shell", "CC=gcc ./build --opt-{k}"), (1, 3, "cli", "gcc --std-{k} a.c")),
    "snippet_claims": _rows("block n_lines path function defines provenance", (0, 0, 1, None, None, "", "unscoped"), (1, 0, 5, "src/m{k}/hdr.c", "copy_{k}", "LIMIT_{k},copy_{k}", "project_attributed"), (1, 1, 3, None, None, "", "unscoped")),
    "patch_hunks": _rows(
        "patch hunk path source_start source_length target_start target_length section lines sound",
        (1, 0, 1, "src/x{k}.c", ("{n}",), 3, ("{n}",), 3, "int f(void)", " a|-b|+c| d", True),
        (1, 1, 1, "gone.c", 1, 2, 0, 0, None, "-x|--- y", True),
        (3, 0, 1, "p{k}.c", ("{n}",), 1, ("{n}",), 2, None, "-old|+new|+more", True),
    ),
    "patch_claims": _rows("patch files n_hunks confidence", (1, 0, "src/x{k}.c", 1, 0.95), (1, 1, "gone.c", 1, 0.95), (3, 0, "p{k}.c", 1, 0.95)),
    "option_claims": _rows(
        "token option_kind provenance mentions",
        *((1, f"--{name}-{{k}}", "flag", owner, 1) for name, owner in (("opt", "reporter_artifact"), ("fold", "project_attributed"), ("std", "third_party"))),
        *((3, f"--{name}", "flag", owner, 1) for name, owner in (("Wall-{k}", "third_party"), ("fold-{k}", "project_attributed"), ("verbose-{k}", "project_attributed"), ("git", "project_attributed"))),
        (3, "CURLOPT_X{k}", "constant", "project_attributed", 1),
        (3, "curl{k}.mode", "config_key", "project_attributed", 1),
    ),
    "behavior_claims": _rows("subject predicate object", (3, "parse_{k}", "calls_api", "memcpy"), (3, "read_{k}", "missing_bounds_check", None), (3, "drop_{k}", "missing_bounds_check", None), (3, "free_{k}", "uses_freed", None)),
    "fenced_code": " UNION ALL ".join(
        f"SELECT event_id AS report_id, {block} AS block, '{info}' AS info, '{role}' AS role, md5(replace({_value(content)}, '\\n', chr(10))) AS digest FROM events WHERE event_id % 4 = {shape}"
        for shape, block, info, role, content in (
            (0, 0, "", "snippet", "version 9.9.9 in a log"),
            (1, 0, "c", "snippet", "int copy_{k}(char *p, int n)\n{\n  return n;\n}\n#define LIMIT_{k} 4"),
            (1, 1, "", "snippet", "plain text with a ``` fence\n~~~\nstill inside"),
            (1, 2, "sh", "poc", "# a comment\nCC=gcc ./build --opt-{k}\nsudo -n hdrcat --fold-{k} x{n}"),
            (1, 3, "", "poc", "$ gcc --std-{k} a.c"),
            (1, 4, "diff", "patch", "--- a/src/x{k}.c\n+++ b/src/x{k}.c\n@@ -{n},3 +{n},3 @@ int f(void)\n a\n-b\n+c\n d"),
            (1, 5, "patch", "patch", "--- a/gone.c\n+++ /dev/null\n@@ -1,2 +0,0 @@\n-x\n--- y"),
        )
    ),
}
