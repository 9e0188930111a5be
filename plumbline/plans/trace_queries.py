"""Queries of traces: events as reports whose text shows a trace of each format, with the frames it must give as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import traces
from plumbline.sources.tables import spread, table

#: A trace of each format: lines with {i} (the event's id), {n} (a line number), {k} (its user) put in. The second and third frames show a path.
TEXTS = {
    "asan": "=================================================================\n=={k}==ERROR: AddressSanitizer: heap-buffer-overflow on address 0x60200000{h} at pc 0x1 bp 0x2 sp 0x3\nWRITE of size {n} at 0x60200000{h} thread T0\n    #0 0x4a4 in __asan_memcpy (/w/bin+0x4a4)\n    #1 0x4ed in copy_{k} /w/src/util.c:{n}:5\n    #2 0x4ee in parse_{k} src/hdr.c:10\n\n0x60200000{h} is located 0 bytes after 16-byte region [0x60200000{g},0x60200000{h})\nallocated by thread T0 here:\n    #0 0x4a6 in malloc (/w/bin+0x4a6)\n    #1 0x4ed in copy_{k} /w/src/util.c:7:17\n\nSUMMARY: AddressSanitizer: heap-buffer-overflow /w/src/util.c:{n}:5 in copy_{k}",
    "valgrind": "=={k}== Invalid write of size 4\n=={k}==    at 0x4C: copy_{k} (util.c:{n})\n=={k}==    by 0x4D: main (hdr.c:10)\n=={k}==  Address 0x5 is 0 bytes after a block of size 16 alloc'd\n=={k}==    at 0x4E: malloc (in /usr/lib/vg.so)\n=={k}==    by 0x4F: copy_{k} (util.c:7)",
    "gdb": "Program received signal SIGFPE, Arithmetic exception.\n#0  0x4a in copy_{k} (a=1, b=0x2) at util.c:{n}\n#1  main (argc=1) at hdr.c:10\n#2  0x7f in __libc_start_main () from /lib/libc.so.6",
    "python": "Traceback (most recent call last):\n  File \"/w/hdr.py\", line 10, in main\n    run()\n  File \"/w/util.py\", line {n}, in copy_{k}\n    1 / 0\nZeroDivisionError: division by zero",
    "java": "Exception in thread \"main\" java.lang.NullPointerException: x is null\n\tat org.w.Util.copy_{k}(Util.java:{n})\n\tat org.w.Hdr.main(Hdr.java:10)\n\tat java.base/java.lang.Thread.run(Native Method)",
    "go": "panic: runtime error: index out of range\n\ngoroutine 1 [running]:\nmain.copy_{k}(0x1)\n\t/w/util.go:{n} +0x1d\nmain.main()\n\t/w/hdr.go:10 +0x2",
    "rust": "thread 'main' panicked at src/util.rs:{n}:5:\nindex out of bounds\nstack backtrace:\n   0: rust_begin_unwind\n             at /rustc/1/library/std/src/panicking.rs:5:5\n   1: w::copy_{k}\n             at ./src/util.rs:{n}:5\n   2: w::main\n             at ./src/hdr.rs:10:3",
    "node": "TypeError: x is not a function\n    at copy_{k} (/w/util.js:{n}:5)\n    at Object.<anonymous> (/w/hdr.js:10:3)\n    at node:internal/main:1:2",
}
FORMATS = list(TEXTS)
#: Of each format the frames of the faulting stack as (function, path, line, runtime); {k} and {n} as above.
EXPECTED = {
    "asan": (("__asan_memcpy", None, None, True), ("copy_{k}", "/w/src/util.c", "{n}", False), ("parse_{k}", "src/hdr.c", "10", False)),
    "valgrind": (("copy_{k}", "util.c", "{n}", False), ("main", "hdr.c", "10", False)),
    "gdb": (("copy_{k}", "util.c", "{n}", False), ("main", "hdr.c", "10", False), ("__libc_start_main", None, None, True)),
    "python": (("copy_{k}", "/w/util.py", "{n}", False), ("main", "/w/hdr.py", "10", False)),
    "java": (("org.w.Util.copy_{k}", "Util.java", "{n}", False), ("org.w.Hdr.main", "Hdr.java", "10", False), ("java.lang.Thread.run", None, None, True)),
    "go": (("main.copy_{k}", "/w/util.go", "{n}", False), ("main.main", "/w/hdr.go", "10", False)),
    "rust": (("rust_begin_unwind", "/rustc/1/library/std/src/panicking.rs", "5", True), ("w::copy_{k}", "./src/util.rs", "{n}", False), ("w::main", "./src/hdr.rs", "10", False)),
    "node": (("copy_{k}", "/w/util.js", "{n}", False), ("Object.<anonymous>", "/w/hdr.js", "10", False), (None, "node:internal/main", "1", True)),
}


def reports(spark, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    pick = F.get(F.array(*[F.lit(TEXTS[f]) for f in FORMATS]), (i % len(FORMATS)).cast("int"))
    values = {"{i}": i.cast("string"), "{n}": (i % 400 + 1).cast("string"), "{k}": F.col("user_id").cast("string"), "{h}": F.lower(F.lpad(F.hex(i % 256 + 16), 4, "0")), "{g}": F.lower(F.lpad(F.hex(i % 256 + F.when(i % 24 == 0, 1).otherwise(0)), 4, "0"))}
    for name, value in values.items():
        pick = F.replace(pick, F.lit(name), value)
    return spread(table(spark, sf_dir, "events")).select(i.alias("report_id"), F.concat(F.lit("It breaks:\n\n"), pick).alias("body"))


def trace_frames(spark, sf_dir):
    found = traces.frames(traces.trace_lines(reports(spark, sf_dir))).where("stack_no = 0")
    return found.select("report_id", "format", "index", "function", "path", "line", "is_runtime")


def trace_stacks(spark, sf_dir):
    return traces.frames(traces.trace_lines(reports(spark, sf_dir))).groupBy("format", "stack").agg(F.count("*").alias("frames"), F.count_distinct("report_id").alias("reports"))


def trace_sanity(spark, sf_dir):
    lines = traces.trace_lines(reports(spark, sf_dir))
    return traces.sanity(traces.summaries(lines), traces.frames(lines))


def asan_region_arithmetic(spark, sf_dir):
    found = traces.summaries(traces.trace_lines(reports(spark, sf_dir))).where("format = 'asan'")
    return found.select("report_id", F.col("region_start").cast("long").alias("region_start"), F.col("region_end").cast("long").alias("region_end"), "relation", "distance", "access_size")


def planted_mistakes(spark, sf_dir):
    from plumbline.operators import mutations

    return mutations.mutated(reports(spark, sf_dir)).groupBy("kind", "expected").agg(F.count("*").alias("cases"), F.count_if("applied").alias("applied"))


QUERIES = {f.__name__: f for f in (trace_frames, trace_stacks, trace_sanity, asan_region_arithmetic, planted_mistakes)}


def _value(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("{k}", "' || user_id || '") + "'"


_ROWS = " UNION ALL ".join(
    f"SELECT event_id AS report_id, '{name}' AS format, {index} AS index, {_value(function)} AS function, {_value(path)} AS path, {'NULL' if line is None else '(event_id % 400 + 1)::INTEGER' if line == '{n}' else line} AS line, {str(runtime).lower()} AS is_runtime FROM events WHERE event_id % {len(FORMATS)} = {k}"
    for k, name in enumerate(FORMATS)
    for index, (function, path, line, runtime) in enumerate(EXPECTED[name])
)

#: Kinds that find a place in the text of each format; M2 in all with a path and line, M4 in those that number frames, M5 in patches alone.
_PLACES = {"M1": [], "M2": ["asan", "valgrind", "gdb", "java", "go", "rust", "node"], "M3": [], "M4": ["asan", "gdb"], "M5": [], "M6": [], "M7": ["asan"]}


def _of(*formats: str) -> str:
    return f"event_id % {len(FORMATS)} IN ({', '.join(str(FORMATS.index(f)) for f in formats)})"


ORACLE_SQL = {
    "planted_mistakes": " UNION ALL ".join(f"SELECT '{k}' AS kind, '{'MIXED' if k == 'M3' else 'UNGROUNDED'}' AS expected, 3 * count(*) AS cases, 3 * count(*) FILTER (event_id % 8 IN ({', '.join(str(FORMATS.index(f)) for f in v) or '-1'})) AS applied FROM events" for k, v in _PLACES.items()),
    "trace_frames": _ROWS,
    "trace_stacks": f"SELECT format, 'main' AS stack, count(*) AS frames, count(DISTINCT report_id) AS reports FROM ({_ROWS}) GROUP BY format UNION ALL SELECT ['asan', 'valgrind'][event_id % 8 + 1], 'alloc', 2 * count(*), count(*) FROM events WHERE event_id % 8 IN (0, 1) GROUP BY 1",
    "trace_sanity": f"""SELECT event_id AS report_id, 1::BIGINT AS trace_no, CASE WHEN {_of('asan', 'valgrind')} THEN true END AS one_pid, CASE WHEN {_of('asan', 'gdb', 'rust')} THEN true END AS frames_numbered,
 CASE WHEN {_of('asan')} THEN true END AS addresses_agree, CASE WHEN {_of('asan')} THEN event_id % 24 <> 0 END AS region_fits, CASE WHEN {_of('asan')} THEN true END AS summary_agrees, CASE WHEN {_of('asan')} THEN true END AS stacks_present,
 CASE WHEN {_of('asan')} THEN true END AS size_possible FROM events""",
    "asan_region_arithmetic": "SELECT event_id AS report_id, ('0x60200000' || printf('%04x', (event_id % 256 + CASE WHEN event_id % 24 = 0 THEN 1 ELSE 0 END)::INTEGER))::BIGINT AS region_start, ('0x60200000' || printf('%04x', (event_id % 256 + 16)::INTEGER))::BIGINT AS region_end, 'after' AS relation, 0::BIGINT AS distance, event_id % 400 + 1 AS access_size FROM events WHERE event_id % 8 = 0",
}
