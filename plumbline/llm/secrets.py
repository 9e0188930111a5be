"""Secret scans over a trigram inverted index, with DataFrame functions only.

From each rule's regular expression a Boolean trigram query is derived: alternatives, each a set of trigrams that all
occur in any match (case is folded, which only adds candidates). The index holds, for every trigram that some query
names, the documents that contain it. A rule's candidates are the documents in the intersection of the postings of all
trigrams of one of its alternatives; only these are verified with the regular expression. A rule with an alternative
that has no trigram (here the hexadecimal rule) scans every text.

Spans are code points, end exclusive; leftmost, non-overlapping per rule; spans of different rules may overlap. A null
text is empty and has none. Rows of docs keep their count and all their columns; doc_id may repeat or be null (a row
with a null doc_id is verified for all rules). Added columns replace ones of the same name.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from re import _constants as sre
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import bound, in_parts, running
from plumbline.llm.common import fresh, staged

#: Alternatives of a query beyond which an element ends the literal run; members of a class that are tried one by one.
MOST_ALTERNATIVES, SMALL_CLASS = 64, 6
#: Candidate ids (8 bytes each) up to which they are broadcast; beyond, texts and candidates are joined by shuffling.
BROADCAST_IDS = 500_000


@dataclass(frozen=True)
class Rule:
    """group: whose length counts, least: so many characters at least; shorter matches are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The base rules, then further well-known key formats.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
)
RULES = BASE + MORE


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Alternatives of trigrams that all occur, lower-cased, in any match; None if some alternative has none."""
    CUT = "\0"  # ends a literal run; no rule matches this character

    def joined(left: list[str], right: list[str]) -> list[str]:
        return [a + b for a in left for b in right] if len(left) * len(right) <= MOST_ALTERNATIVES else [a + CUT for a in left]

    def walk(tree) -> list[str]:
        out = [""]
        for op, arg in tree:
            if op is sre.LITERAL:
                part = [chr(arg).lower()]
            elif op is sre.IN and all(k is sre.LITERAL for k, _ in arg) and len(arg) <= SMALL_CLASS:
                part = sorted({chr(v).lower() for _, v in arg})
            elif op is sre.SUBPATTERN:
                part = walk(arg[3])
            elif op is sre.BRANCH:
                part = [x for branch in arg[1] for x in walk(branch)]
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
                least, most, inner = arg
                once = walk(inner)
                part = ["", *once] if (least, most) == (0, 1) else [CUT] if least == 0 else [CUT + x + CUT if (least, most) != (1, 1) else x for x in once]
            else:
                part = [CUT]
            out = joined(out, part)
        return out

    found = set()
    for text in walk(_parser.parse(pattern)):
        grams = frozenset(run[i : i + 3] for run in text.split(CUT) for i in range(len(run) - 2))
        if not grams:
            return None
        found.add(grams)
    return sorted((g for g in found if not any(other < g for other in found)), key=sorted)  # a superset asks for no more


def gates(alternatives: list[frozenset[str]]) -> dict[str, list[frozenset[str]]]:
    """Each alternative under one of its trigrams, as few different ones as covering most alternatives at a time gives."""
    out: dict[str, list[frozenset[str]]] = {}
    left = list(alternatives)
    while left:
        counts = Counter(g for grams in left for g in grams)
        gate = min(counts, key=lambda g: (-counts[g], g))
        out[gate] = [grams for grams in left if gate in grams]
        left = [grams for grams in left if gate not in grams]
    return out


def trigram_index(docs: DataFrame, alternatives: list[frozenset[str]]) -> DataFrame:
    """The postings (trigram, doc_id) that the alternatives' intersections can need: those of one trigram of each alternative, and those of its
    other trigrams among the documents that hold it. A text is lower-cased once."""

    def held(t: Column) -> Column:
        found = lambda g: F.when(F.contains(t, F.lit(g)), F.lit(g))
        of = lambda gate, under: F.when(F.contains(t, F.lit(gate)), F.array(F.lit(gate), *[found(g) for g in sorted(frozenset().union(*under) - {gate})]))
        whole = F.flatten(F.filter(F.array(*[of(gate, under) for gate, under in sorted(gates(alternatives).items())]), lambda x: x.isNotNull()))
        return F.array_distinct(F.filter(whole, lambda x: x.isNotNull()))

    return docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.explode(bound(F.lower("text"), held)).alias("trigram"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and the kinds of the rules with a query that may match there."""
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern)) is not None}
    if not queries:
        return docs.select("doc_id", F.array().cast("array<string>").alias("kinds")).limit(0)
    clauses = [(kind, number, gram, len(grams)) for kind, query in queries.items() for number, grams in enumerate(query) for gram in sorted(grams)]
    # the few clauses of a rule set are a literal, matched to each posting
    by_gram: dict[str, list[Column]] = {}
    for kind, number, gram, size in clauses:
        by_gram.setdefault(gram, []).append(F.struct(F.lit(kind).alias("kind"), F.lit(number).alias("number"), F.lit(size).alias("size")))
    named = F.create_map(*[x for gram, parts in by_gram.items() for x in (F.lit(gram), F.array(*parts))])
    postings = trigram_index(docs, [grams for query in queries.values() for grams in query]).distinct()
    matched = postings.select("doc_id", F.explode(F.element_at(named, F.col("trigram"))).alias("clause"))
    whole = matched.groupBy("doc_id", "clause.kind", "clause.number", "clause.size").count().where(F.col("count") == F.col("size"))
    return whole.groupBy("doc_id").agg(F.collect_set("kind").alias("kinds"))


def _spans(text: Column, rule: Rule, place: int) -> Column:
    """The rule's spans: matches lie between the pieces that splitting leaves, so lengths add up to places."""
    pattern = F.lit(rule.pattern)
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    counted = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else matches
    pieces = F.split(text, rule.pattern, -1)
    rows = F.filter(F.arrays_zip(F.transform(matches, F.length).alias("n"), F.transform(counted, F.length).alias("m"), F.transform(pieces, F.length).alias("before")), lambda x: x["n"].isNotNull())

    def placed(found: Column) -> Column:
        def at(sums: Column):
            def one(x: Column, i: Column) -> Column:
                start = F.get(sums, i) + x["before"]
                return F.struct(start.alias("start"), F.lit(place).alias("place"), F.lit(rule.kind).alias("kind"), (start + x["n"]).alias("end"), x["m"].alias("m"))

            return one

        spans = bound(running(F.transform(found, lambda x: x["before"] + x["n"])), lambda sums: F.transform(found, at(sums)))
        kept = F.filter(spans, lambda x: x["m"] >= rule.least)
        return F.transform(kept, lambda x: F.struct(x["start"].alias("start"), x["place"].alias("place"), x["kind"].alias("kind"), x["end"].alias("end")))

    return bound(rows, placed)


SPANS = "array<struct<start:int,place:int,kind:string,end:int>>"


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, broadcast_ids: int = BROADCAST_IDS, column: str = "spans") -> DataFrame:
    """docs with a column of spans: array of (start, place of the rule, kind, end), by start and then by rule."""
    found = staged(candidates(docs.select("doc_id", "text"), rules))
    few = found.count() <= broadcast_ids
    id_, kinds = fresh(docs, "id", column), fresh(docs, "kinds", column)
    found = found.select(F.col("doc_id").alias(id_), F.col("kinds").alias(kinds))
    kept = [c for c in docs.columns if c.lower() != column.lower()]
    rows = docs.select(*(f"`{c}`" for c in kept)).join(F.broadcast(found) if few else found, F.col("doc_id") == F.col(id_), "left")
    text = F.coalesce(F.col("text"), F.lit(""))
    parts = []
    for place, rule in enumerate(rules):
        if trigram_query(rule.pattern) is None:
            check = F.col("text").rlike(rule.pattern)
        else:
            check = F.array_contains(kinds, rule.kind) | F.col("doc_id").isNull()
        parts.append(F.when(check, _spans(text, rule, place)).otherwise(F.array().cast(SPANS)))
    return rows.select(*(f"`{c}`" for c in kept), F.array_sort(F.concat(*parts)).alias(column))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mask: str = "[SECRET]", **options) -> DataFrame:
    """docs with every span (overlapping ones as one) replaced by the mask, in texts only; all columns stay."""
    spans = fresh(docs, "spans")
    found = scan(docs, rules, column=spans, **options)

    text = F.col("text")

    def masked(all_: Column) -> Column:
        reach = running(F.transform(all_, lambda x: x["end"]), lambda a, b: F.greatest(a, b))

        def gaps(reached: Column) -> Column:
            # what lies between the farthest end so far and a span; a span that begins before it is covered by the mask that is there
            between = F.transform(all_, lambda x, i: F.struct(F.get(reached, i).alias("from"), x["start"].alias("to")))
            last = F.struct(F.array_max(F.transform(all_, lambda x: x["end"])).alias("from"), F.length(text).alias("to"))
            return F.concat(F.filter(between, lambda g: g["from"] <= g["to"]), F.array(last))

        def texts(part: Column) -> Column:
            base = F.get(part, F.lit(0))["from"]
            cut = F.substr(text, base + 1, F.element_at(part, -1)["to"] - base)
            return bound(cut, lambda t: F.transform(part, lambda g: F.substr(t, g["from"] - base + 1, g["to"] - g["from"])))

        return F.array_join(bound(reach, lambda reached: F.flatten(F.transform(in_parts(gaps(reached)), texts))), mask)

    whole = F.when(F.size(spans) > 0, bound(F.col(spans), masked)).otherwise(text)
    return found.select(*(whole.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns))


def op6_secrets(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    base = F.filter("spans", lambda x: x["place"] < len(BASE))
    shown = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda k: F.size(F.filter("spans", lambda x: x["place"] == k)).cast("long")
    return scan(docs).select(
        "doc_id",
        *[count(k).alias(f"n_{r.kind}") for k, r in enumerate(BASE)],
        F.sha2(shown(base).cast("binary"), 256).alias("base_sha256"),
        shown(F.col("spans")).alias("spans"),
    )
