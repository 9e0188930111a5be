"""Text and identifier functions: Columns in, Columns out, all within code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The longest body of a report, and the longest title.
BODY_CHARS, TITLE_CHARS = 2_000_000, 200


def bound(value: Column, use) -> Column:
    """use(value), with the value worked out once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def in_parts(whole: Column) -> Column:
    """An array cut into parts of about the square root of its length."""
    step = F.greatest(F.ceil(F.sqrt(F.size(whole))).cast("int"), F.lit(1))
    return F.transform(F.sequence(F.lit(0), F.greatest(F.size(whole) - 1, F.lit(0)), step), lambda at: F.slice(whole, at + 1, step))


def running(values: Column, join=lambda a, b: a + b) -> Column:
    """For each element of an array of integers what those before it come to (0 before the first), by parts: no array is copied for each element."""
    total = lambda part: F.aggregate(part, F.lit(0), join)

    def of(parts: Column) -> Column:
        before = lambda sums: F.transform(sums, lambda _, k: total(F.slice(sums, F.lit(1), k)))
        within = lambda bases: F.flatten(F.transform(parts, lambda p, k: F.transform(p, lambda _, i: join(F.get(bases, k), total(F.slice(p, F.lit(1), i))))))
        return bound(F.transform(parts, total), lambda sums: bound(before(sums), within))

    return bound(values, lambda whole: bound(in_parts(whole), of))


def normalized(text: Column) -> Column:
    """Line ends as \\n; no control characters but tab and line end, no byte-order mark, no DEL."""
    return F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), "[\\x{0}-\\x{8}\\x{B}-\\x{1F}\\x{7F}\\x{FEFF}]", "")


def truncated(text: Column, most: int = BODY_CHARS) -> Column:
    """Struct of the text's first `most` characters and whether it was cut."""
    return F.struct(F.substring(text, 1, most).alias("body"), (F.length(text) > most).alias("cut"))


def collapsed(text: Column) -> Column:
    """White space as single spaces, trimmed."""
    return F.trim(F.regexp_replace(text, "\\s+", " "))


def lines_of(text: Column) -> Column:
    """Lines between \\n; a last empty one is no line."""
    parts = F.split(text, "\n", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def line_count(text: Column) -> Column:
    return F.size(lines_of(text))


def title_of(text: Column, most: int = TITLE_CHARS) -> Column:
    """The first line that isn't blank, trimmed, in at most `most` characters; null if there is none."""
    full = F.filter(F.split(text, "\n", -1), lambda line: F.trim(line) != "")
    return F.substring(F.trim(F.get(full, F.lit(0))), 1, most)


def stable_id(kind: str, payload: Column) -> Column:
    """The first 12 hex digits of a content hash over kind and payload."""
    return F.substring(F.sha2(F.concat(F.lit(kind), F.lit("\0"), payload).cast("binary"), 256), 1, 12)


def slug(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-")


def name_parts(name: Column) -> Column:
    """Distinct lower-case parts of a camel-case, snake-case or mixed name, sorted."""
    parts = F.regexp_extract_all(name, F.lit("[A-Z]+|[A-Z]?[a-z]+|[0-9]+"), F.lit(0))
    return F.array_sort(F.array_distinct(F.transform(parts, F.lower)))


def jaccard(left: Column, right: Column) -> Column:
    """Of two arrays as sets; 0 if both are empty."""
    union = F.size(F.array_union(left, right))
    return F.when(union > 0, F.size(F.array_intersect(left, right)) / union).otherwise(F.lit(0.0))


def bare_function(name: Column) -> Column:
    """ns::C::m(int) const -> m: no arguments, template arguments or qualifiers."""
    plain = F.regexp_replace(F.regexp_replace(name, "\\(.*$", ""), "<[^<>]*>", "")
    return F.trim(F.regexp_replace(plain, "^.*(::|\\.)", ""))


def path_parts(path: Column) -> Column:
    """Components of a path: / and \\ alike, without drive, empty and . parts; .. takes back one part."""
    parts = F.filter(F.split(F.regexp_replace(F.regexp_replace(path, "\\\\", "/"), "^[A-Za-z]:", ""), "/", -1), lambda p: ~p.isin("", "."))
    empty = F.array().cast("array<string>")
    return F.aggregate(parts, empty, lambda acc, p: F.when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p))))


def located(text: Column) -> Column:
    """Struct (path, line, col) of path:line[:col]; all null if the text is no location."""
    part = lambda k: F.regexp_extract(text, "^(.+?):([0-9]{1,9})(?::([0-9]{1,9}))?$", k)
    number = lambda k: F.when(part(k) != "", part(k).try_cast("int"))
    return F.struct(F.when(part(1) != "", part(1)).alias("path"), number(2).alias("line"), number(3).alias("col"))


def canonical_url(url: Column) -> Column:
    """Scheme and host lower-cased, no user, query, fragment, .git or closing slash."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "[?#].*$", ""), "^([A-Za-z][A-Za-z0-9+.-]*://)[^/@]*@", "$1")
    head = F.lower(F.regexp_extract(bare, "^([A-Za-z][A-Za-z0-9+.-]*://[^/]*)", 1))
    rest = F.regexp_replace(F.regexp_replace(bare, "^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", ""), "(\\.git)?/*$", "")
    return F.concat(head, rest)


def repository(url: Column) -> Column:
    """host/owner/name of a link to a repository or into one, in lower case; empty for others, local paths too."""
    part = lambda k: F.lower(F.regexp_extract(F.trim(url), r"^(?i:https?)://(?:[^/@?#]*@)?(?i:www\.)?([^/?#]+)/+([^/?#]+)/+([^/?#]+?)(?:\.git)?(?:[/?#].*)?$", k))
    return F.when(part(1) != "", F.concat_ws("/", part(1), part(2), part(3))).otherwise("")


def url_kind(url: Column) -> Column:
    """What a link refers to: commit, pull, issue, advisory, cve, cwe, file, release, compare or url."""
    path = F.lower(F.regexp_replace(url, "^[A-Za-z]+://[^/]*", ""))
    out = F.lit("url")
    for kind, pattern in reversed(
        (
            ("commit", "/commits?/[0-9a-f]{7,40}"),
            ("pull", "/(pull|merge_requests)/[0-9]+"),
            ("issue", "/issues/[0-9]+"),
            ("advisory", "/(security/)?advisories/"),
            ("cve", "cve-[0-9]{4}-[0-9]{4,}"),
            ("cwe", "/definitions/[0-9]+"),
            ("file", "/blob/[^/]+/"),
            ("release", "/releases?/"),
            ("compare", "/compare/"),
        )
    ):
        out = F.when(path.rlike(pattern), F.lit(kind)).otherwise(out)
    return out


def escaped_markdown(text: Column) -> Column:
    return F.regexp_replace(text, "([\\\\`*_{}\\[\\]()#+!|<>-])", "\\\\$1")


def escaped_html(text: Column) -> Column:
    out = text
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def end_of_day(day: Column) -> Column:
    """Epoch seconds of the last second of a day, UTC."""
    return F.unix_date(day.cast("date")).cast("long") * 86400 + 86399


#: What a file's name ends in if a mention of it counts as a path.
PATH_EXTENSIONS = "c cc cpp cxx h hh hpp hxx inc go java js jsx ts tsx mjs php py pyx rb rs swift kt m mm cs scala sh pl lua s asm y l in am ac cmake mk toml yaml yml json xml html md txt cfg conf ini".split()


def is_path_candidate(text: Column) -> Column:
    """Looks like a file path: a name and a known extension (before .in too), no blank, not a product name such as Node.js or a version."""
    base = F.regexp_replace(text, "^.*/", "")
    ending = F.lower(F.regexp_extract(base, "\\.([A-Za-z0-9]{1,5})(?:\\.in)?$", 1))
    return ending.isin(PATH_EXTENSIONS) & ~text.rlike("\\s") & base.rlike("^(?![0-9]+\\.)[^.]") & ~text.rlike("^[A-Z][A-Za-z]{1,30}\\.js$")


def path_owner(path: Column) -> Column:
    """third_party, reporter_artifact, unscoped (home folders: a build tree may still be the project) or project_attributed, by where a path lies."""
    return (
        F.when(path.rlike("^(?:/usr/|/lib|/opt/|/System/|/Library/|/nix/store/|[A-Za-z]:/Windows/|/Applications/)"), "third_party")
        .when(path.rlike("^(?:/tmp/|/var/tmp/|/private/tmp/|/var/folders/|/dev/shm/)"), "reporter_artifact")
        .when(path.rlike("^(?:~/|/home/|/Users/|/root/)"), "unscoped")
        .otherwise("project_attributed")
    )


def is_negated(before: Column, after: Column) -> Column:
    """A mention with a denial close before it or after it."""
    return F.lower(before).rlike("\\b(no|not|never|without|isn't|doesn't|don't|cannot|can't|neither|nor)\\b[^.;]{0,40}$") | F.lower(after).rlike("^[^.;]{0,16}\\b(is|are|was|were|does|do) (not|never)\\b")


def block_role(info: Column, content: Column) -> Column:
    """trace, patch, poc, log or snippet: by the fence's word, then by what the block holds."""
    return (
        F.when(F.lower(info).isin("diff", "patch"), "patch")
        .when(F.lower(info).isin("sh", "bash", "shell", "console", "zsh"), "poc")
        .when(content.rlike("(?m)^(==[0-9]+==|\\s*#[0-9]+\\s|Traceback \\(most recent call last\\)|\\s+at [\\w.$<>]+\\(|panic: |goroutine [0-9]+ )"), "trace")
        .when(content.rlike("(?m)^(diff --git |--- [^\\n]+\\n\\+\\+\\+ |@@ -[0-9]+)"), "patch")
        .when(content.rlike("(?m)^(\\$ |# |curl |python3? |gcc |clang |make |\\./)"), "poc")
        .when(content.rlike("(?m)^\\[?[0-9]{4}-[0-9]{2}-[0-9]{2}[ T]"), "log")
        .otherwise("snippet")
    )


def language_of(path: Column) -> Column:
    """The language of a source file by its extension; null if unknown."""
    by = {"c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "hpp": "cpp", "go": "go", "java": "java", "js": "javascript", "mjs": "javascript", "php": "php", "py": "python", "rb": "ruby", "rs": "rust", "ts": "typescript", "tsx": "tsx"}
    table = F.create_map(*[F.lit(x) for pair in by.items() for x in pair])
    return F.element_at(table, F.lower(F.regexp_extract(path, "\\.([A-Za-z0-9]+)$", 1)))


def permalink(repo: Column, commit: Column, path: Column, first: Column, last: Column) -> Column:
    """A link to lines of a file at a commit, for hosts whose form of links is known; null for others."""
    base = F.regexp_replace(repo, "\\.git$", "")
    dash = F.when(base.startswith("https://github.com/"), "-L").when(base.startswith("https://gitlab.com/"), "-")
    until = F.when(last > first, F.concat(dash, last.cast("string"))).otherwise("")
    return F.when(dash.isNotNull(), F.concat(base, F.lit("/blob/"), commit, F.lit("/"), path, F.lit("#L"), F.greatest(first, F.lit(1)).cast("string"), until))


def hex_number(text: Column) -> Column:
    """The number of up to 16 hexadecimal digits, with 0x or without; null for other texts."""
    digits = F.regexp_extract(text, "^(?:0[xX])?([0-9A-Fa-f]{1,16})$", 1)
    return F.when(digits != "", F.conv(digits, 16, 10).cast("decimal(20,0)"))


def short_number(text: Column) -> Column:
    """The number of up to 18 ASCII digits; null for other texts."""
    return F.when(text.rlike("^[0-9]{1,18}$"), text.try_cast("long"))
