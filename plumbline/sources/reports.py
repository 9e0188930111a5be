"""Report sources: text, Markdown and HTML files, e-mails, and JSON records of vulnerabilities, advisories and disclosed reports.

Files are read by Spark's own readers, one row a file; a report is report_id, kind, uri, title, body, blocks."""

from __future__ import annotations

import email
import email.policy
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import text as X
from plumbline.operators.extraction import code_blocks
from plumbline.operators.spans import matches

#: The largest file that is read, parts and depth of an e-mail.
MOST_BYTES, MOST_PARTS, MOST_DEPTH = 20 * 1024 * 1024, 500, 32


def files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """uri and text of the files under a path; UTF-8 with a mark or without, what can't be decoded replaced; larger ones are left out."""
    reader = spark.read.format("binaryFile")
    reader = reader.option("pathGlobFilter", glob) if glob else reader
    rows = reader.load(path).where(F.col("length") <= MOST_BYTES)
    return rows.select(F.col("path").alias("uri"), F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), "^\\x{FEFF}", "").alias("text"))


def format_of(uri: Column, text: Column) -> Column:
    """markdown, html, email or text: by extension, else by the first 4096 characters."""
    name, head = F.lower(uri), F.substring(text, 1, 4096)
    return (
        F.when(name.rlike("\\.(md|markdown)$"), "markdown")
        .when(name.rlike("\\.html?$"), "html")
        .when(name.rlike("\\.eml$"), "email")
        .when(name.rlike("\\.(txt|text|log)$"), "text")
        .when(head.rlike("(?i)^\\s*(<!doctype html|<html)"), "html")
        .when(head.rlike("(?m)^(#{1,6} |```|~~~)"), "markdown")
        .otherwise("text")
    )


def as_reports(rows: DataFrame) -> DataFrame:
    """Reports from uri and text: normalized, cut to the longest body, with a title."""
    body = X.normalized(F.col("text"))
    part = X.truncated(F.col("body"))
    return rows.select("uri", format_of(F.col("uri"), F.col("text")).alias("kind"), body.alias("body")).select(X.stable_id("report", F.col("body")).alias("report_id"), "kind", "uri", X.title_of(F.col("body")).alias("title"), part["body"].alias("body"), part["cut"].alias("cut"))


def fenced_blocks(reports: DataFrame) -> DataFrame:
    """Fenced code blocks of Markdown bodies: report_id, block, info, first_line, content, role. A fence is closed by one of its own kind; one that is never closed reaches to the end."""
    blocks = reports.select("report_id", "body", F.posexplode(code_blocks(F.col("body"))).alias("block", "b"))
    before = F.substr("body", F.lit(1), F.col("b.start"))
    first = F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit("")))
    # the text's last line end belongs to no line of a block that is never closed
    open_ = (F.col("b.end") == F.length("body")) & ~F.col("body").rlike(r"\n {0,3}(?:`{3,}|~{3,})[ \t]*\z")
    content = F.when(open_, F.regexp_replace("b.content", r"\n\z", "")).otherwise(F.col("b.content"))
    return blocks.select("report_id", "block", "b.info", first.alias("first_line"), content.alias("content")).withColumn("role", X.block_role(F.col("info"), F.col("content")))


#: References of HTML by name, those of markup last, so that what they spell isn't read again.
REFERENCES = (
    ("nbsp", " "), ("copy", "\u00a9"), ("reg", "\u00ae"), ("deg", "\u00b0"), ("middot", "\u00b7"), ("laquo", "\u00ab"), ("raquo", "\u00bb"), ("times", "\u00d7"), ("sect", "\u00a7"), ("para", "\u00b6"), ("euro", "\u20ac"), ("trade", "\u2122"),
    ("ndash", "\u2013"), ("mdash", "\u2014"), ("lsquo", "\u2018"), ("rsquo", "\u2019"), ("ldquo", "\u201c"), ("rdquo", "\u201d"), ("bull", "\u2022"), ("hellip", "\u2026"), ("larr", "\u2190"), ("rarr", "\u2192"), ("le", "\u2264"), ("ge", "\u2265"), ("ne", "\u2260"),
    ("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("amp", "&"),
)


def unreferenced(text: Column) -> Column:
    """Text whose references are characters: by number, decimal or hexadecimal, and those of REFERENCES by name. Numbers of no character stay as they are."""

    def spelled(found: Column) -> Column:
        def one(m: Column) -> Column:
            hexadecimal = F.regexp_extract(m["text"], "(?i)^&#x([0-9a-f]+);$", 1)
            code = F.when(hexadecimal != "", F.conv(hexadecimal, 16, 10).try_cast("long")).otherwise(F.regexp_extract(m["text"], "^&#([0-9]+);$", 1).try_cast("long"))
            valid = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
            # what a number spells begins no other reference
            return F.when(code == 38, "&amp;").when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(m["text"])

        begin = lambda i: F.coalesce(F.get(found, i - 1)["end"], F.lit(0))
        parts = F.transform(found, lambda m, i: F.concat(F.substr(text, begin(i) + 1, m["start"] - begin(i)), one(m)))
        return F.concat(F.array_join(parts, ""), F.substr(text, begin(F.size(found)) + 1, F.length(text)))

    out = F.when(F.contains(text, F.lit("&#")), X.bound(matches(text, "(?i)&#(?:[0-9]{1,7}|x[0-9a-f]{1,6});"), spelled)).otherwise(text)
    for name, char in REFERENCES:
        out = F.replace(out, F.lit(f"&{name};"), F.lit(char))
    return out


def html_text(html: Column) -> Column:
    """The text of an HTML report: heads, scripts, styles and templates left out, block tags as line ends, <pre> as a fenced block, <code> in backticks."""
    out = F.regexp_replace(html, "(?is)<(script|style|template|noscript|head)\\b.*?</\\1\\s*>", "")
    out = F.regexp_replace(out, "(?s)<!--.*?-->", "")
    out = F.regexp_replace(out, "(?i)<pre[^>]*>", "\n```\n")
    out = F.regexp_replace(out, "(?i)</pre\\s*>", "\n```\n")
    out = F.regexp_replace(out, "(?i)</?code[^>]*>", "`")
    out = F.regexp_replace(out, "(?i)<(/?(p|div|li|ul|ol|h[1-6]|tr|table|blockquote|section|article)|br)\\b[^>]*>", "\n")
    out = F.regexp_replace(out, "<[^>]*>", "")
    return F.trim(F.regexp_replace(unreferenced(out), "\\n{3,}", "\n\n"))


def _leaves(message, depth: int = 0) -> Iterator:
    if depth <= MOST_DEPTH:
        if message.is_multipart():
            for part in message.iter_parts():
                yield from _leaves(part, depth + 1)
        else:
            yield message


def _mail(data: bytes) -> tuple[str | None, str, str]:
    """Subject, text of the plain parts, and of the HTML parts; the sender is never read."""
    message = email.message_from_bytes(data, policy=email.policy.default)
    plain, rich = [], []
    for number, part in enumerate(_leaves(message)):
        if number >= MOST_PARTS:
            break
        if part.get_content_disposition() == "attachment":
            continue
        kind = part.get_content_type()
        if kind in ("text/plain", "text/html"):
            try:
                body = part.get_content()
            except (LookupError, ValueError):
                body = part.get_payload(decode=True).decode("utf-8", "replace")
            (plain if kind == "text/plain" else rich).append(str(body))
    return message.get("subject"), "\n\n".join(plain), "\n\n".join(rich)


def mails(rows: DataFrame, column: str = "content") -> DataFrame:
    """uri and content (bytes) of e-mails as uri, title and text; HTML counts where there is no plain text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_mail(x) if x is not None else (None, "", "") for x in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("uri"), *(pa.array([f[k] for f in found], pa.string()) for k in range(3))], names=["uri", "title", "plain", "rich"])

    parts = rows.select("uri", column).mapInArrow(run, "uri string, title string, plain string, rich string")
    return parts.select("uri", "title", F.when(F.trim("plain") != "", F.col("plain")).otherwise(html_text(F.col("rich"))).alias("text"))


def is_format_patch(title: Column, text: Column) -> Column:
    return title.rlike("^\\[PATCH") & text.rlike("(?m)^diff --git ")


CVE = "struct<cveMetadata:struct<cveId:string,state:string,datePublished:string>,containers:struct<cna:struct<title:string,descriptions:array<struct<lang:string,value:string>>,affected:array<struct<vendor:string,product:string,defaultStatus:string,versions:array<struct<version:string,status:string,versionType:string,lessThan:string,lessThanOrEqual:string,changes:array<struct<at:string,status:string>>>>>>,problemTypes:array<struct<descriptions:array<struct<cweId:string,description:string>>>>,metrics:array<struct<cvssV3_1:struct<vectorString:string,baseScore:double>>>,references:array<struct<url:string>>>>>"


def cve_records(rows: DataFrame, column: str = "json") -> DataFrame:
    """Typed records of CVE JSON: what has a wrong type is null; what is no record at all gives no row."""
    r = F.from_json(F.col(column), CVE, {"mode": "PERMISSIVE"})
    cna = F.col("r.containers.cna")
    out = rows.withColumn("r", r).where("r.cveMetadata.cveId IS NOT NULL")
    text = F.filter(cna["descriptions"], lambda d: F.coalesce(d["lang"], F.lit("")).startswith("en"))
    return out.select(
        F.col("r.cveMetadata.cveId").alias("cve_id"),
        F.col("r.cveMetadata.state").alias("state"),
        F.to_date(F.substring("r.cveMetadata.datePublished", 1, 10)).alias("published"),
        cna["title"].alias("title"),
        F.get(text, F.lit(0))["value"].alias("description"),
        F.get(F.flatten(F.transform(cna["problemTypes"], lambda p: p["descriptions"])), F.lit(0))["cweId"].alias("cwe"),
        F.get(cna["metrics"], F.lit(0))["cvssV3_1"]["vectorString"].alias("vector"),
        cna["affected"].alias("affected"),
        F.transform(cna["references"], lambda x: x["url"]).alias("urls"),
    )


def cve_ranges(records: DataFrame) -> DataFrame:
    """Affected versions as plain ranges: cve_id, product, lower, upper, inclusive. A version with changes is cut at each of them; only
    affected stretches stay, empty ones go."""
    rows = records.select("cve_id", F.explode("affected").alias("a")).select("cve_id", F.col("a.product").alias("product"), F.posexplode("a.versions").alias("pos", "v"))
    steps = F.concat(F.array(F.struct(F.col("v.version").alias("at"), F.col("v.status").alias("status"))), F.coalesce(F.col("v.changes"), F.array().cast("array<struct<at:string,status:string>>")))
    cut = rows.select("cve_id", "product", "pos", F.col("v.lessThan").alias("below"), F.col("v.lessThanOrEqual").alias("up_to"), steps.alias("steps"))
    spread = cut.select("cve_id", "product", "pos", "below", "up_to", "steps", F.posexplode("steps").alias("k", "s"))
    following = F.get("steps", F.col("k") + 1)["at"]
    single = F.col("below").isNull() & F.col("up_to").isNull() & (F.size("steps") == 1)
    upper = F.coalesce(following, F.col("below"), F.col("up_to"), F.when(single, F.col("s.at")))
    inclusive = following.isNull() & F.col("below").isNull() & (F.col("up_to").isNotNull() | single)
    return spread.where("s.status = 'affected'").select("cve_id", "product", F.col("s.at").alias("lower"), upper.alias("upper"), inclusive.alias("inclusive")).where("lower <> upper OR upper IS NULL OR inclusive")


def cve_reports(records: DataFrame) -> DataFrame:
    """Records as reports: a Markdown body with structured parts first and free text last; the id itself stays out of the body."""
    lines = lambda items: F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n")
    part = lambda head, text: F.when(F.coalesce(text, F.lit("")) != "", F.concat(F.lit(f"## {head}\n\n"), text, F.lit("\n")))
    products = F.array_distinct(F.filter(F.transform("affected", lambda a: a["product"]), lambda x: x.isNotNull()))
    impact = F.filter(F.array(F.col("vector"), F.col("cwe")), lambda x: x.isNotNull())
    state = F.concat_ws(" · ", F.concat(F.lit("State: "), "state"), F.concat(F.lit("Published: "), F.col("published").cast("string")))
    body = F.concat_ws("\n", F.concat(F.lit("# "), F.coalesce("title", F.lit("CVE record")), F.lit("\n")), F.when(state != "", F.concat(state, F.lit("\n"))), part("Affected", lines(products)), part("Impact", lines(impact)), part("References", lines(F.col("urls"))), part("Description", F.col("description")))
    return records.select("cve_id", body.alias("body")).select(X.stable_id("cve_json", F.col("body")).alias("report_id"), F.lit("cve_json").alias("kind"), "cve_id", "body")


#: The longest name of a stored file and of its extension.
MOST_NAME, MOST_EXTENSION = 100, 10


def safe_names(names: Column) -> Column:
    """Names of a report's attachments (an array, of at most MOST_PARTS) as base names of safe characters, each used once: a-1.txt after a.txt."""
    bare = lambda n: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.replace(n, F.lit("\\"), F.lit("/")), "^.*/", ""), "[^A-Za-z0-9._-]", "_"), "^\\.+", "")
    full = lambda n: F.when(n.rlike("[^_.]"), n).otherwise("attachment")
    stem = lambda n: F.regexp_extract(n, "^(.+)\\.[^.]*$", 1)
    extension = lambda n: F.regexp_extract(n, "^.+(\\.[^.]*)$", 1)

    def cut(n: Column, more: Column) -> Column:
        kept = (stem(n) != "") & (F.length(extension(n)) <= MOST_EXTENSION + 1)
        left = F.lit(MOST_NAME) - F.length(more)
        return F.when(kept, F.concat(F.substr(stem(n), F.lit(1), left - F.length(extension(n))), more, extension(n))).otherwise(F.concat(F.substr(n, F.lit(1), left), more))

    def step(taken: Column, n: Column) -> Column:
        numbered = F.transform(F.sequence(F.lit(0), F.size(taken)), lambda k: cut(n, F.when(k > 0, F.concat(F.lit("-"), k.cast("string"))).otherwise("")))
        return F.concat(taken, F.array(F.get(F.array_except(numbered, taken), F.lit(0))))

    return F.aggregate(F.transform(F.slice(names, 1, MOST_PARTS), lambda n: full(bare(n))), F.array().cast("array<string>"), step)


ADVISORY = "struct<ghsa_id:string,cve_id:string,summary:string,description:string,severity:string,cwe_ids:array<string>,vulnerabilities:array<struct<package:struct<ecosystem:string,name:string>,vulnerable_version_range:string,first_patched_version:string>>>"


def advisories(rows: DataFrame, column: str = "json") -> DataFrame:
    """Rows of an advisory list: one for each vulnerable package."""
    out = rows.withColumn("r", F.explode(F.from_json(F.col(column), f"array<{ADVISORY}>")))
    return out.select("r.ghsa_id", "r.cve_id", "r.summary", "r.severity", F.explode_outer("r.vulnerabilities").alias("v")).select("ghsa_id", "cve_id", "summary", "severity", F.col("v.package.name").alias("package"), F.col("v.vulnerable_version_range").alias("range"), F.col("v.first_patched_version").alias("patched"))


DISCLOSED = "struct<id:bigint,title:string,state:string,substate:string,disclosed_at:string,vulnerability_information:string>"


def disclosed_reports(rows: DataFrame, column: str = "json") -> DataFrame:
    """Reports of a disclosure platform; nothing of the reporter is kept."""
    return rows.select(F.from_json(F.col(column), DISCLOSED).alias("r")).where("r.id IS NOT NULL").select(F.col("r.id").alias("id"), "r.title", F.coalesce("r.substate", "r.state").alias("state"), F.to_date(F.substring("r.disclosed_at", 1, 10)).alias("day"), F.col("r.vulnerability_information").alias("body"))


def write_results(rows: DataFrame, path: str, key: str) -> None:
    """JSON lines in the order of a key, nulls written, fields by name: equal rows give equal files. Parts follow the order of the key."""
    ordered = rows.select(*sorted(rows.columns)).orderBy(key)
    ordered.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


SCHEMA = T.StructType([T.StructField("report_id", T.StringType()), T.StructField("title", T.StringType()), T.StructField("body", T.StringType())])
