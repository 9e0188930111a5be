"""Crash traces as line tables: twelve formats, their stacks and frames, and the rules a sound trace obeys.

Texts are cut into lines; each line is a header, a stack's label, a frame or something else; running counts over a report's lines number
traces and stacks. Frames of formats that put the place on the next line take it from there. Everything is a projection or a
window over (report_id, line_no)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.text import lines_of
from plumbline.operators import spans
from plumbline.staging import dealt

#: How a trace of each format begins; group 1 is what went wrong, group 2 the message.
HEADERS = (
    ("asan", r"^==[0-9]+==\s*ERROR: AddressSanitizer: ([\w-]+)(.*)$"),
    ("lsan", r"^==[0-9]+==\s*ERROR: LeakSanitizer: (.*)()$"),
    ("msan", r"^==[0-9]+==\s*WARNING: MemorySanitizer: ([\w-]+)(.*)$"),
    ("tsan", r"^WARNING: ThreadSanitizer: ([^(]*?)\s*(\(pid=[0-9]+\))?$"),
    ("ubsan", r"^[^:\s]+:[0-9]+:[0-9]+: runtime error: (.*)()$"),
    ("valgrind", r"^==[0-9]+== (Invalid (?:read|write)|Conditional jump|Use of uninitialised|Invalid free|Mismatched free)(.*)$"),
    ("gdb", r"^Program received signal (\w+), (.*)$"),
    ("python", r"^(Traceback) \((most recent call last)\):$"),
    ("java", r"^Exception in thread \"[^\"]*\" ([\w.$]+)(?:: (.*))?$"),
    ("go", r"^(?:panic|fatal error): (.*)()$"),
    ("rust", r"^thread '[^']*' (?:\([0-9]+\) )?panicked at (.*)()$"),
    ("node", r"^(?:Uncaught )?(\w*Error)(?: \[[^\]]*\])?: (.*)$"),
)
_NATIVE = r"^\s*#([0-9]+)\s+(?:0x[0-9a-f]+\s+)?(?:in\s+)?(\S.*?)\s+([^\s():]+):([0-9]+)(?::([0-9]+))?(?:\s+\(.*\))?$"
_MODULE = r"^\s*#([0-9]+)\s+0x[0-9a-f]+\s+(?:in\s+)?(\S.*?)?\s*\(([^()\s]+)\+0x[0-9a-f]+\)"
_NOWHERE = r"^\s*#([0-9]+)\s+(?:0x[0-9a-f]+\s+)?(?:in\s+)?(\S.*?)\s+<null>(?:\s+\(.*\))?$"
#: Frames of each format: patterns with the groups of index, function, path, line and column (0: has none).
FRAMES = {
    "native": ((_NATIVE, (1, 2, 3, 4, 5)), (_NOWHERE, (1, 2, 0, 0, 0)), (_MODULE, (1, 2, 0, 0, 0))),
    "valgrind": ((r"^==[0-9]+==\s+(?:at|by) 0x[0-9A-F]+: (\S.*?) \(([^():]+):([0-9]+)\)$", (0, 1, 2, 3, 0)), (r"^==[0-9]+==\s+(?:at|by) 0x[0-9A-F]+: (\S.*?) \((?:in|within) ([^)]*)\)$", (0, 1, 0, 0, 0))),
    "gdb": ((r"^#([0-9]+)\s+(?:0x[0-9a-f]+ in )?([^\s(]+) \(.*\) at ([^\s:]+):([0-9]+)$", (1, 2, 3, 4, 0)), (r"^#([0-9]+)\s+(?:0x[0-9a-f]+ in )?([^\s(]+) \(.*\)(?: from \S+)?$", (1, 2, 0, 0, 0))),
    "python": ((r"^\s+File \"([^\"]+)\", line ([0-9]+), in (\S+)$", (0, 3, 1, 2, 0)),),
    "java": ((r"^\s+at (?:[\w.@]+/)?([\w.$<>]+)\(([\w$]+\.\w+):([0-9]+)\)$", (0, 1, 2, 3, 0)), (r"^\s+at (?:[\w.@]+/)?([\w.$<>]+)\((?:Native Method|Unknown Source)\)$", (0, 1, 0, 0, 0))),
    "go": ((r"^((?:created by )?[\w./*()-]+?)(?:\([^)]*\)| in goroutine [0-9]+)?$", (0, 1, 0, 0, 0)),),
    "rust": ((r"^\s+([0-9]+): (?:0x[0-9a-f]+ - )?(\S.*)$", (1, 2, 0, 0, 0)),),
    "node": ((r"^\s+at (?:async )?(?:new )?([\w.$<>]+)(?: \[as \w+\])? \((?:file://)?([^()]+?):([0-9]+):([0-9]+)\)$", (0, 1, 2, 3, 4)), (r"^\s+at (?:file://)?(\S+?):([0-9]+):([0-9]+)$", (0, 0, 1, 2, 3))),
}
NATIVE_FORMATS = ("asan", "lsan", "msan", "tsan", "ubsan")
#: Where formats that put the place on the next line put it.
NEXT_LINE = {"go": r"^\s+(\S+):([0-9]+)(?: \+0x[0-9a-f]+)?$", "rust": r"^\s+at (\S+?):([0-9]+)(?::([0-9]+))?$"}
#: Labels of further stacks of a trace and what they hold.
LABELS = (("alloc", r"allocated by|was created by|Uninitialized value was created|alloc'd$|Direct leak of"), ("free", r"^(?:==[0-9]+==)?\s*freed by|free'd$"), ("other", r"^\s*(?:Previous (?:read|write)|Thread [0-9]|Caused by:|Suppressed:|goroutine [0-9]+|During handling of|The above exception)"))
#: Functions and paths of runtimes rather than of the program.
RUNTIME = r"^(?:__asan_|__interceptor_|__sanitizer|__libc_|_start$|abort$|raise$|java\.|jdk\.|sun\.|runtime\.|std::|core::|node:|rust_begin_unwind|panic\()"


#: Reports in one part.
REPORTS_EACH = 25_000


def _follows(name: str) -> Column:
    """An error's name and message begin a trace of one format only before a frame: they also end tracebacks of another one."""
    return F.coalesce(F.col("next").rlike(r"^\s+at "), F.lit(False)) if name == "node" else F.lit(True)


def trace_lines(reports: DataFrame, text: str = "body") -> DataFrame:
    """report_id, line_no, line, header (format, if the line begins a trace), format and trace_no (of the trace the line belongs to), label,
    stack_no (0 is the faulting stack), next."""
    line = F.col("line")
    header = F.lit(None).cast("string")
    for name, pattern in reversed(HEADERS):
        header = F.when(line.rlike(pattern) & _follows(name), F.lit(name)).otherwise(header)
    label = F.lit(None).cast("string")
    for name, pattern in reversed(LABELS):
        label = F.when(line.rlike(pattern), F.lit(name)).otherwise(label)
    by = Window.partitionBy("report_id").orderBy("line_no")
    so_far = by.rowsBetween(Window.unboundedPreceding, 0)
    rows = dealt(reports.select("report_id", text), "report_id", REPORTS_EACH).select("report_id", F.posexplode(lines_of(F.col(text))).alias("line_no", "line")).withColumn("next", F.lead("line").over(by)).withColumn("header", header).withColumn("label", F.when(F.col("header").isNull(), label))
    rows = rows.withColumn("trace_no", F.count("header").over(so_far)).withColumn("format", F.last("header", ignorenulls=True).over(so_far))
    within = Window.partitionBy("report_id", "trace_no").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    # the first goroutine is the one that broke
    new = F.when((F.col("format") == "go") & F.col("line").rlike("^goroutine "), F.lit(None)).otherwise(F.col("label"))
    return rows.where("trace_no > 0").withColumn("label", new).withColumn("stack_no", F.count("label").over(within)).withColumn("stack", F.coalesce(F.last("label", ignorenulls=True).over(within), F.lit("main")))


def _frame(format_: str, patterns) -> Column:
    """Struct of a frame's parts from the first pattern that matches; null if none does."""
    line = F.col("line")
    out = F.lit(None)
    for pattern, groups in reversed(patterns):
        part = lambda k, p=pattern: F.nullif(F.regexp_extract(line, p, k), F.lit("")) if k else F.lit(None).cast("string")
        index, function, path, number, col = (part(k) for k in groups)
        if format_ in NEXT_LINE:
            after = lambda k: F.nullif(F.regexp_extract(F.coalesce("next", F.lit("")), NEXT_LINE[format_], k), F.lit(""))
            path, number, col = after(1), after(2), after(3) if format_ == "rust" else F.lit(None).cast("string")
        found = F.struct(index.try_cast("int").alias("index"), function.alias("function"), path.alias("path"), number.try_cast("int").alias("line"), col.try_cast("int").alias("col"))
        ok = line.rlike(pattern)
        if format_ == "go":
            ok = ok & F.coalesce(F.col("next").rlike(NEXT_LINE["go"]), F.lit(False))
        out = F.when(ok, found).otherwise(out)
    return out


def frames(lines: DataFrame) -> DataFrame:
    """report_id, trace_no, format, stack_no, stack, index (from 0, the faulting frame first), function, path, line, col, is_runtime, line_no."""
    cases = F.lit(None)
    for name, patterns in FRAMES.items():
        mine = F.col("format").isin(*NATIVE_FORMATS) if name == "native" else F.col("format") == name
        cases = F.when(mine, _frame(name, patterns)).otherwise(cases)
    found = lines.where("header IS NULL").withColumn("f", cases).where("f IS NOT NULL")
    by = Window.partitionBy("report_id", "trace_no", "stack_no")
    place = F.row_number().over(by.orderBy("line_no")) - 1
    # this format names the last call last
    turned = F.when(F.col("format") == "python", F.count("*").over(by) - 1 - place).otherwise(place)
    runtime = F.coalesce(F.col("f.function").rlike(RUNTIME), F.lit(False)) | F.coalesce(F.col("f.path").rlike(r"^(?:node:|/rustc/|/usr/lib/|/usr/src/debug/glibc)"), F.lit(False))
    return found.select("report_id", "trace_no", "format", "stack_no", "stack", turned.cast("int").alias("index"), F.col("f.index").alias("shown_index"), "f.function", "f.path", "f.line", "f.col", runtime.alias("is_runtime"), "line_no")


def extents(lines: DataFrame) -> DataFrame:
    """report_id, format, start, end (line numbers, end exclusive) of what each format reads on its own: from a header of it to the last of its frames
    before its next header. Formats see the same lines, so that their extents may overlap."""
    line = F.col("line")

    def mark(name: str, header: str) -> Column:
        frames = F.greatest(*[line.rlike(p) for p, _ in FRAMES.get(name, FRAMES["native"])], F.lit(False))
        return F.struct(F.lit(name).alias("format"), (line.rlike(header) & _follows(name)).alias("head"), F.coalesce(frames, F.lit(False)).alias("frame"))

    marks = F.array(*[mark(name, header) for name, header in HEADERS])
    rows = lines.select("report_id", "line_no", F.explode(F.filter(marks, lambda m: m["head"] | m["frame"])).alias("m")).select("report_id", "line_no", "m.*")
    by = Window.partitionBy("report_id", "format").orderBy("line_no")
    number = F.sum(F.col("head").cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("n", number).where("n > 0").groupBy("report_id", "format", "n").agg(F.min("line_no").cast("long").alias("start"), (F.max("line_no") + 1).cast("long").alias("end")).drop("n")


def resolved(found: DataFrame) -> DataFrame:
    """Extents without those that overlap a longer one; of equally long ones the earlier, then the first format by name."""
    return spans.longest_first(found, ["report_id"], F.col("format"))


def summaries(lines: DataFrame) -> DataFrame:
    """Per trace: format, bug type, message, process ids, access, addresses, region and the summary's claims."""
    pick = lambda pattern, k: F.max(F.when(F.col("line").rlike(pattern), F.regexp_extract("line", pattern, k)))
    head = lambda k: F.coalesce(*[F.when(F.col("header") == name, F.regexp_extract("line", pattern, k)) for name, pattern in HEADERS])
    address = lambda x: F.conv(x, 16, 10).cast("decimal(20,0)")
    access = r"^(READ|WRITE) of size ([0-9]{1,18}) at 0x([0-9a-f]{1,16})"
    header = r"^==[0-9]+==.* on (?:unknown )?address 0x([0-9a-f]{1,16})"
    region = r"^0x([0-9a-f]{1,16}) is located ([0-9]{1,18}) bytes (inside of|after|before|to the right of|to the left of) ([0-9]{1,18})-byte region \[0x([0-9a-f]{1,16}),0x([0-9a-f]{1,16})\)"
    summary = r"^SUMMARY: \w+Sanitizer: ([\w-]+) (\S+?):([0-9]+)(?::[0-9]+)? in (.+)$"
    rows = lines.groupBy("report_id", "trace_no").agg(
        F.max(F.col("format")).alias("format"),
        F.trim(F.max(head(1))).alias("bug_type"),
        F.trim(F.max(head(2))).alias("message"),
        F.count_distinct(F.nullif(F.regexp_extract("line", r"^==([0-9]{1,18})==", 1), F.lit(""))).alias("pids"),
        pick(access, 1).alias("access_kind"),
        pick(access, 2).try_cast("bigint").alias("access_size"),
        address(pick(access, 3)).alias("access_address"),
        address(pick(header, 1)).alias("address"),
        address(pick(region, 1)).alias("region_address"),
        pick(region, 2).try_cast("bigint").alias("distance"),
        pick(region, 3).alias("relation"),
        pick(region, 4).try_cast("bigint").alias("region_size"),
        address(pick(region, 5)).alias("region_start"),
        address(pick(region, 6)).alias("region_end"),
        pick(summary, 1).alias("summary_type"),
        pick(summary, 2).alias("summary_path"),
        pick(summary, 3).try_cast("int").alias("summary_line"),
        pick(summary, 4).alias("summary_function"),
    )
    relation = F.when(F.col("relation").isin("after", "to the right of"), "after").when(F.col("relation").isin("before", "to the left of"), "before").when(F.col("relation") == "inside of", "inside")
    return rows.withColumn("relation", relation)


def sanity(found: DataFrame, stacks: DataFrame) -> DataFrame:
    """Per trace each rule's outcome: true (holds), false (violated) or null (doesn't apply). found: summaries; stacks: frames.

    Rules: one process id; frames numbered from 0 without gaps; addresses of header, access and region equal, but for an address clamped to the region's
    end; the region's size and distance fit its bounds; the summary names a top frame; bugs of freed or allocated memory show the
    stacks they need; the access has a possible size."""
    before = Window.partitionBy("report_id", "trace_no", "stack_no").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    step = F.col("shown_index") - F.coalesce(F.last("shown_index", ignorenulls=True).over(before), F.lit(-1))
    app = F.min(F.when((F.col("stack_no") == 0) & ~F.col("is_runtime"), F.struct("index", "function", "line")))
    key = ["report_id", "trace_no"]
    shown = stacks.withColumn("step", step).groupBy(*key).agg(
        F.bool_and(F.when(F.col("shown_index").isNotNull(), F.col("step") == 1)).alias("frames_numbered"),
        app["function"].alias("app_function"),
        app["line"].alias("app_line"),
        F.max(F.when((F.col("stack_no") == 0) & (F.col("index") == 0), F.col("function"))).alias("top_function"),
        F.bool_or(F.col("stack") == "alloc").alias("has_alloc"),
        F.bool_or(F.col("stack") == "free").alias("has_free"),
    )
    rows = found.join(shown, key, "left")
    asan = F.col("format") == "asan"
    size = F.col("region_end") - F.col("region_start")
    distance = F.when(F.col("relation") == "after", F.col("region_address") - F.col("region_end")).when(F.col("relation") == "before", F.col("region_start") - F.col("region_address")).when(F.col("relation") == "inside", F.col("region_address") - F.col("region_start"))
    needs_free = F.col("bug_type").isin("heap-use-after-free", "double-free", "alloc-dealloc-mismatch", "new-delete-type-mismatch")
    needs_alloc = F.col("bug_type").startswith("heap-") | needs_free
    same = (F.col("address") == F.col("access_address")) & (F.col("region_address").isNull() | (F.col("region_address") == F.col("address")) | (F.col("region_address") == F.col("region_end")))
    return rows.select(
        *key,
        F.when(F.col("pids") > 0, F.col("pids") == 1).alias("one_pid"),
        "frames_numbered",
        F.when(asan & F.col("address").isNotNull() & F.col("access_address").isNotNull(), same).alias("addresses_agree"),
        F.when(asan & F.col("region_size").isNotNull(), (size == F.col("region_size")) & (distance == F.col("distance")) & ((F.col("relation") != "inside") | (F.col("distance") < F.col("region_size")))).alias("region_fits"),
        F.when(F.col("summary_function").isNotNull(), (F.col("summary_function") == F.col("top_function")) | ((F.col("summary_function") == F.col("app_function")) & (F.col("summary_line") == F.col("app_line")))).alias("summary_agrees"),
        F.when(asan & F.col("region_size").isNotNull() & F.col("summary_type").isNotNull() & needs_alloc, F.coalesce("has_alloc", F.lit(False)) & (~needs_free | F.coalesce("has_free", F.lit(False)))).alias("stacks_present"),
        F.when(F.col("access_size").isNotNull(), F.col("access_size").between(1, 1 << 31)).alias("size_possible"),
    )
