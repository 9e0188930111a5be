"""Facts of source files as line tables: definitions, calls, macros, comment- and string-free code.

Files are cut into lines; strings and comments are blanked within a file first, so that braces and names in them don't count. A
definition of the brace languages is a head outside all braces whose brace opens on its line or the next; its end is the line on which the depth
falls back. Python definitions end before the next line that is indented no deeper. What can't be read so is parsed = false."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.staging import dealt

#: Files and lines in one part.
FILES_EACH, LINES_EACH = 25_000, 400_000
#: Words that a parenthesis follows without a call.
KEYWORDS = "if for while switch return sizeof catch elif not and or in is lambda def class with assert except print defined do else case func fn let match new delete throw typeof".split()
HEAD = r"^(?:[A-Za-z_][\w:<>,*&\s]*?[\s*&])?([A-Za-z_][\w:]*)\s*\([^;{}]*\)?[^;{}]*(\{)?[^;]*$"
BRACES = ("c", "cpp", "java", "go", "rust", "javascript", "typescript", "php")


def blanked(text: Column) -> Column:
    """Code with comments gone (their line ends stay) and strings empty; # comments of Python too where the caller says so."""
    no_strings = F.regexp_replace(text, r'"(?:[^"\\\n]++|\\.)*+"', '""')
    no_chars = F.regexp_replace(no_strings, r"'(?:[^'\\\n]|\\.)'", "''")
    # a block comment becomes its line ends: each line of it is emptied
    one_line = F.regexp_replace(F.regexp_replace(no_chars, r"//[^\n]*", ""), r"/\*[^*\n]*\*+(?:[^/*\n][^*\n]*\*+)*+/", " ")
    return one_line


def code_lines(files: DataFrame) -> DataFrame:
    """blob, lang, line_no, line (blanked), depth (braces open before the line), after (open after it), in_comment lines left empty."""
    rows = dealt(files.select("blob", "lang", "text"), "blob", FILES_EACH).select("blob", "lang", F.posexplode(F.split(blanked(F.col("text")), "\n", -1)).alias("k", "line"))
    by = Window.partitionBy("blob").orderBy("k")
    so_far = by.rowsBetween(Window.unboundedPreceding, 0)
    begins, ends = F.col("line").contains("/*"), F.col("line").contains("*/")
    inside = F.coalesce(F.last(F.when(begins & ~ends, F.lit(True)).when(ends, F.lit(False)), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    line = F.when(inside & ends, F.regexp_replace("line", r"^.*?\*/", "")).when(inside, "").otherwise(F.regexp_replace("line", r"/\*.*$", ""))
    line = F.when(F.col("lang") == "python", F.regexp_replace(line, "#.*$", "")).otherwise(line)
    rows = rows.withColumn("line", line)
    net = F.length(F.regexp_replace("line", r"[^{]", "")) - F.length(F.regexp_replace("line", r"[^}]", ""))
    after = F.sum(net).over(so_far)
    return rows.select("blob", "lang", (F.col("k") + 1).alias("line_no"), "line", (after - net).alias("depth"), after.alias("after"))


def definitions(lines: DataFrame) -> DataFrame:
    """blob, name, start, end of functions."""
    by = Window.partitionBy("blob").orderBy("line_no")
    name = F.regexp_extract("line", HEAD, 1)
    opens = F.col("line").contains("{") | F.coalesce(F.lead("line").over(by).rlike(r"^\s*\{"), F.lit(False))
    heads = F.col("lang").isin(*BRACES) & (F.col("depth") == 0) & F.col("line").rlike(HEAD) & opens & (name != "") & ~name.isin(KEYWORDS) & ~F.col("line").rlike(r"^\s*#|^\s*(?:else|typedef|struct|union|enum)\b")
    marked = lines.withColumn("name", F.when(heads, name))
    # the first line from the head on after which nothing is open, if a brace was opened on the way
    closed = F.when((F.col("after") == 0) & F.col("line").contains("}"), F.col("line_no"))
    ahead = by.rowsBetween(0, Window.unboundedFollowing)
    braces = marked.withColumn("end", F.first(closed, ignorenulls=True).over(ahead)).where("name IS NOT NULL").select("blob", "name", F.col("line_no").alias("start"), "end")
    python = lines.where("lang = 'python'").withColumn("indent", F.length(F.regexp_extract("line", r"^(\s*)\S", 1))).where(F.trim("line") != "")
    found = F.regexp_extract("line", r"^\s*(?:async\s+)?def\s+(\w+)", 1)
    defs = python.where(found != "").select("blob", found.alias("name"), F.col("line_no").alias("start"), "indent")
    # within a file: the next line that is indented no deeper ends the definition
    ends = defs.join(python.select("blob", F.col("line_no").alias("at"), F.col("indent").alias("i")), "blob").where((F.col("at") > F.col("start")) & (F.col("i") <= F.col("indent"))).groupBy("blob", "name", "start").agg(F.min("at").alias("next"))
    last = python.groupBy("blob").agg(F.max("line_no").alias("last"))
    python_defs = defs.join(ends, ["blob", "name", "start"], "left").join(last, "blob").select("blob", "name", "start", F.coalesce(F.col("next") - 1, F.col("last")).alias("end"))
    return braces.unionByName(python_defs)


def calls(lines: DataFrame, functions: DataFrame) -> DataFrame:
    """blob, caller (the innermost function that holds the line; null outside all), callee, line_no."""
    names = F.array_except(F.regexp_extract_all("line", F.lit(r"([A-Za-z_]\w*)\s*\("), F.lit(1)), F.array(*[F.lit(k) for k in KEYWORDS]))
    rows = lines.where(~F.col("line").rlike(r"^\s*#\s*define")).select("blob", "line_no", F.explode(names).alias("callee"))
    held = rows.join(functions.select("blob", "name", "start", "end"), "blob", "left").where(F.col("start").isNull() | F.col("line_no").between(F.col("start"), F.col("end")))
    best = held.where("start IS NOT NULL").groupBy("blob", "line_no", "callee").agg(F.min_by(F.struct("name", "start"), F.struct(F.col("end") - F.col("start"), "start")).alias("f"))
    out = rows.join(best, ["blob", "line_no", "callee"], "left")
    # a definition's own head is no call
    return out.where(F.col("f").isNull() | (F.col("f.name") != F.col("callee")) | (F.col("f.start") != F.col("line_no"))).select("blob", F.col("f.name").alias("caller"), "callee", "line_no")


def macros(lines: DataFrame) -> DataFrame:
    """blob, name, line_no and the calls in the replacement of #define macros."""
    pattern = r"^\s*#\s*define\s+(\w+)(?:\(([^)]*)\))?(.*)$"
    rows = lines.where(F.col("line").rlike(pattern))
    called = F.array_distinct(F.array_except(F.regexp_extract_all(F.regexp_extract("line", pattern, 3), F.lit(r"([A-Za-z_]\w*)\s*\("), F.lit(1)), F.array(*[F.lit(k) for k in KEYWORDS])))
    return rows.select("blob", F.regexp_extract("line", pattern, 1).alias("name"), "line_no", called.alias("calls"))


def facts(lines: DataFrame) -> DataFrame:
    """Per file: lines, and whether its braces close, so that its definitions can be trusted."""
    return lines.groupBy("blob", "lang").agg(F.max("line_no").alias("n_lines"), ((F.max_by("after", "line_no") == 0) & (F.min("after") >= 0)).alias("parsed"))


def definition_text(lines: DataFrame, functions: DataFrame) -> DataFrame:
    """blob, name and a digest of each definition's blanked lines, for telling changed definitions from unchanged ones."""
    rows = functions.join(lines.select("blob", "line_no", "line"), "blob").where(F.col("line_no").between(F.col("start"), F.col("end")))
    whole = rows.groupBy("blob", "name", "start").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: F.trim(F.regexp_replace(x["line"], r"\s+", " "))), "\n").alias("text"))
    return whole.select("blob", "name", "start", F.md5(F.regexp_replace("text", "\n+", "\n").cast("binary")).alias("digest"))


def pickaxe(diff_lines: DataFrame, literal: str) -> DataFrame:
    """Commits that change how often a literal occurs. diff_lines: commit, path, op (+ or -), text."""
    count = (F.length("text") - F.length(F.replace(F.col("text"), F.lit(literal), F.lit("")))) / len(literal)
    rows = diff_lines.where(F.contains("text", F.lit(literal)))
    return rows.groupBy("commit").agg(F.sum(F.when(F.col("op") == "+", count).otherwise(-count)).cast("long").alias("delta")).where("delta <> 0")


def grep(lines: DataFrame, literal: str, word: bool = False) -> DataFrame:
    """Lines that hold a literal, as a whole word if asked; only literals of one line and at most 1000 characters are looked for."""
    if not literal or "\n" in literal or len(literal) > 1000:
        return lines.limit(0)
    found = lines.where(F.contains("line", F.lit(literal)))
    if not word:
        return found
    import re

    return found.where(F.col("line").rlike(r"(?<!\w)" + re.escape(literal) + r"(?!\w)"))


#: How a file that holds others marks them: its banners name the file that begins, ends, is included or goes on.
BANNER = r"^/\*{14} (Begin file|End of|Include|Continuing where we left off in) ([^\s*]+)"


def inlined(lines: DataFrame) -> DataFrame:
    """Of each line of a file made of others the source file and line it shows: blob, line_no, source, source_line; both null on banners and outside.

    lines: blob, line_no, line. Banners nest; the depth is a running count, a line belongs to the last file begun at its depth, and
    a file's lines are counted where nothing deeper is open. The banner of an inclusion stands for one line of the including file."""
    by = Window.partitionBy("blob").orderBy("line_no")
    so_far = by.rowsBetween(Window.unboundedPreceding, 0)
    kind = F.regexp_extract("line", BANNER, 1)
    rows = dealt(lines, "blob", LINES_EACH).withColumn("kind", kind).withColumn("named", F.regexp_extract("line", BANNER, 2))
    begun, ended = F.sum((F.col("kind") == "Begin file").cast("int")).over(so_far), F.sum((F.col("kind") == "End of").cast("int")).over(so_far)
    rows = rows.withColumn("begun", begun).withColumn("depth", begun - ended)
    level = Window.partitionBy("blob", "depth").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    first = F.col("kind") == "Begin file"
    rows = rows.withColumn("source", F.last(F.when(first, F.col("named")), ignorenulls=True).over(level)).withColumn("of", F.last(F.when(first, F.col("begun")), ignorenulls=True).over(level))
    counts = F.sum(F.col("kind").isin("", "Include").cast("int")).over(Window.partitionBy("blob", "of").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    shown = (F.col("kind") == "") & (F.col("depth") > 0)
    return rows.withColumn("count", counts).select("blob", "line_no", F.when(shown, F.col("source")).alias("source"), F.when(shown, F.col("count")).alias("source_line"))


TOKEN = r'[A-Za-z_]\w*|0[xX][0-9A-Fa-f]+\w*|[0-9][\w.]*|"(?:[^"\\\n]++|\\.)*+"|\'(?:[^\'\\\n]++|\\.)*+\'|->|\+\+|--|<<|>>|[<>=!+*/%&|^-]=|&&|\|\||::|\.\.\.|[^\s\w]'


def tokens(text: Column, hash_comments: bool = False) -> Column:
    """Tokens of code without comments; strings are STR, numbers NUM, so that edits of either don't count."""
    plain = F.regexp_replace(text, r"#[^\n]*" if hash_comments else r"(?s)/\*.*?\*/|//[^\n]*", " ")
    named = lambda t: F.when(t.rlike("^[\"'].*[\"']$"), "STR").when(t.rlike("^[0-9]"), "NUM").otherwise(t)
    return F.transform(F.regexp_extract_all(plain, F.lit(TOKEN), F.lit(0)), named)


def distinctive_lines(lines: DataFrame, least: int = 8, most: int = 1000) -> DataFrame:
    """Per blob the line of code with most tokens, then the longest, then the first: blob, line_no, text. Comments are gone from lines and don't count."""
    rows = lines.select("blob", "line_no", F.trim("line").alias("text"), F.size(F.regexp_extract_all("line", F.lit(TOKEN), F.lit(0))).alias("n")).where(F.length("text").between(least, most) & (F.col("n") > 0))
    return rows.groupBy("blob").agg(F.max_by(F.struct("line_no", "text"), F.struct("n", F.length("text"), -F.col("line_no"))).alias("best")).select("blob", "best.*")


def rarest_names(names: DataFrame, uses: DataFrame) -> DataFrame:
    """Per blob its name with fewest uses, then the longest, then the first. names: blob, name; uses: name, one row a use."""
    counts = uses.groupBy("name").agg(F.count("*").alias("n"))
    rows = names.distinct().join(counts, "name", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return rows.groupBy("blob").agg(F.min_by(F.struct("name", "n"), F.struct("n", -F.length("name"), "name")).alias("best")).select("blob", "best.*")
