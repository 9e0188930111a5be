"""Repair of conversations by a fold over their turns with Spark's higher-order functions.

Faults come from windows and string functions. Turns that are alike in every column are counted before anything is sorted, so a turn repeated a
million times is one row. The turns (without their texts) are range-sorted by conversation and turn and numbered; each conversation so falls into segments
of at most `SEGMENT` turns. aggregate() folds the sorted turn structs of a segment and carries, for each of the four places in the pattern
`(s?(ua)+)?` (nothing yet, after the system turn, after a user turn, after an assistant turn), the least (cost, audit) struct by native least expressions.
A conversation's first segment is folded from "nothing yet", every other from all four places; segments are joined by the same fold over
their results, so that no conversation has to fit into one task. Two audits of one place and one cost are never each other's beginning (an audit fixes its cost), so the
least of each step leads to the least of all.

Texts are shuffled once, beside the audits, and streamed: a digest of a whole repaired conversation has to be taken in order.

Null conv_id, turn, role and text: null ids are one conversation of their own (one space in the key of the damage), null turns come first, a null role or
text is one space. Turns of one number are ordered by role, then by the SHA-256 of their text; repeated rows are turns of their own, one after
the other. A role with another initial than s, u, a is never kept. Texts of any length are taken whole. An empty table gives no rows. Extra columns, of any name, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import staged

SEGMENT_BITS, FAN_BITS = 10, 6
SEGMENT, FAN = 1 << SEGMENT_BITS, 1 << FAN_BITS
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
SPACES, ENDS = "\x20\x09\x0a\x0b\x0c\x0d", ".!?"
#: Places in the pattern: nothing yet, after s, after u, after a.
PLACES = ("e", "s", "u", "a")

_STATE = "struct<cost:bigint,audit:string>"


def turns(conversations: DataFrame) -> DataFrame:
    """conv (a key without nulls), conv_id, turn, role, text and copies, nulls replaced; each row once."""
    of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return conversations.select(of("conv_id").alias("conv"), "conv_id", F.col("turn").cast("long").alias("turn"), of("role").alias("role"), of("text").alias("text"), F.lit(1).cast("long").alias("copies"))


def damage(rows: DataFrame) -> DataFrame:
    """A fifth of the turns damaged by the crc32 of conversation and turn; a dropped one has no copies."""
    kind = F.crc32(F.concat_ws(":", "conv", F.coalesce(F.col("turn").cast("string"), F.lit(" "))).cast("binary")) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1)
    return rows.withColumn("kind", kind).select("conv", "conv_id", "turn", role.alias("role"), text.alias("text"), copies.cast("long").alias("copies"))


def _digest() -> Column:
    return F.unhex(F.sha2("text", 256))


def flagged(rows: DataFrame) -> DataFrame:
    """Distinct turns without their texts, with their faults, in order: no, blank, seen (an earlier one is alike), cut (truncated), initial."""
    trimmed = F.rtrim(F.col("text"), F.lit(SPACES))
    ends = F.length(trimmed) > 0
    cut = ends & ~F.substring(trimmed, -1, 1).isin(*ENDS)
    narrow = rows.select("conv", "conv_id", "turn", "role", _digest().alias("digest"), (~ends).alias("blank"), cut.alias("cut"), "copies")
    whole = narrow.groupBy("conv", "conv_id", "turn", "role", "digest", "blank", "cut").agg(F.sum("copies").alias("copies"))
    alike = Window.partitionBy("conv", "role", "digest").orderBy(F.col("copies") == 0, "turn")
    known = whole.withColumn("seen", F.row_number().over(alike) > 1)
    order = ("conv", "turn", "role", "digest")
    numbered = known.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("no", F.monotonically_increasing_id())
    return staged(numbered.select("conv", "conv_id", "turn", "no", "blank", "seen", "cut", F.substring("role", 1, 1).alias("initial"), "copies"))


def _with(state: Column, letter: str | Column, cost: int | Column) -> Column:
    """A state after one more edit; null if there is none."""
    letter = F.lit(letter) if isinstance(letter, str) else letter
    return F.when(state.isNotNull(), F.struct((state["cost"] + cost).cast("long").alias("cost"), F.concat(state["audit"], letter).alias("audit")))


def _least(*states: Column) -> Column:
    return F.least(*states)  # passes over nulls


def _states(**of: Column) -> Column:
    return F.struct(*[of[p].cast(_STATE).alias(p) for p in PLACES])


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), the value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _inserted(at: Column, use: Callable[[Column, Column], Column]) -> Column:
    """use(the states after u and a), insertions before the next turn included."""
    after_u = _least(at["u"], *(_with(at[p], "I", INSERT) for p in ("e", "s", "a")))
    return _let(after_u, lambda u: _let(_least(at["a"], _with(u, "I", INSERT)), lambda a: use(u, a)))


def _step(at: Column, turn: Column) -> Column:
    extra = F.when(turn["cut"], TRUNCATED).otherwise(0)

    def kept(u: Column, a: Column) -> Column:
        """The turn kept, reroled or deleted."""
        before = {"e": (), "s": (at["e"],), "u": (at["e"], at["s"], a), "a": (u,)}
        new = {}
        for p in PLACES:
            states = [_with(at[p], "D", DELETE)]
            states += [F.when(turn["initial"] == p, _with(x, "K", extra)) for x in before[p]]
            states += [_with(x, "R", extra + REROLE) for x in before[p] if p in ("u", "a")]
            new[p] = _least(*states) if len(states) > 1 else states[0]
        return _states(**new)

    dropped = _states(**{p: _with(at[p], "D", DELETE) for p in PLACES})
    after = F.when(turn["blank"] | turn["seen"], dropped).otherwise(_inserted(at, kept))
    more = turn["copies"] - 1
    again = F.repeat(F.lit("D"), more.cast("int"))
    return _let(after, lambda x: F.when(more == 0, x).otherwise(_states(**{p: _with(x[p], again, more * DELETE) for p in PLACES})))


def _from(place: str, over: str) -> Column:
    """The states before the first element of an array column; nullable, as those after it are."""
    start = F.when(F.size(over) >= 0, F.struct(F.lit(0).cast("long").alias("cost"), F.lit("").alias("audit")))
    return _states(**{p: start if p == place else F.lit(None) for p in PLACES})


def _after(at: Column, paths: Column) -> Column:
    """States followed by the paths of a segment (for each place at which it may begin, the states at its end)."""

    def joined(x: Column, y: Column) -> Column:
        return F.when(x.isNotNull() & y.isNotNull(), F.struct((x["cost"] + y["cost"]).alias("cost"), F.concat(x["audit"], y["audit"]).alias("audit")))

    return _states(**{p: _least(*(joined(at[q], paths[q][p]) for q in PLACES)) for p in PLACES})


def _paths(of: Callable[[str], Column]) -> Column:
    return F.struct(*[of(p).alias(p) for p in PLACES])


def _illegal(pair: Column) -> Column:
    return F.when(pair.isin("su", "ua", "au"), 0).otherwise(1).cast("long")


def segments(marked: DataFrame, heads: DataFrame) -> DataFrame:
    """Of every segment its paths, illegal pairs and the initials at its ends."""
    turn = F.struct("no", "blank", "seen", "cut", "initial", "copies")
    grouped = marked.where("copies > 0").groupBy("conv", F.shiftright("no", SEGMENT_BITS).alias("segment")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    first = heads.select("conv", F.shiftright("head", SEGMENT_BITS).alias("segment"), F.lit(True).alias("first")).where("segment is not null")
    known = grouped.join(first, ["conv", "segment"], "left")
    initials, none = F.transform("turns", lambda t: t["initial"]), F.lit(None)
    fold = lambda p: F.aggregate("turns", _from(p, "turns"), _step)
    pairs = F.zip_with(F.slice(initials, 1, F.size("turns") - 1), F.slice(initials, 2, F.size("turns")), lambda x, y: F.concat(x, y))
    illegal = F.aggregate(pairs, F.lit(0).cast("long"), lambda n, x: n + _illegal(x)) + F.aggregate("turns", F.lit(0).cast("long"), lambda n, t: n + t["copies"] - 1)
    # only the first segment is known to begin with nothing before it
    paths = _paths(lambda p: fold(p) if p == "e" else F.when(F.col("first").isNull(), fold(p)).otherwise(none))
    return known.select("conv", "segment", paths.alias("paths"), illegal.alias("illegal"), F.element_at(initials, 1).alias("opens"), F.element_at(initials, -1).alias("closes"))


def _joined(parts: DataFrame, bits: int) -> DataFrame:
    """Neighbouring segments made one, whose number lacks so many bits."""
    part = F.struct("segment", "paths", "illegal", "opens", "closes")
    grouped = parts.groupBy("conv", F.shiftright("segment", bits).alias("wider")).agg(F.array_sort(F.collect_list(part), lambda x, y: F.when(x["segment"] < y["segment"], -1).otherwise(1)).alias("parts"))
    paths = _paths(lambda p: F.aggregate("parts", _from(p, "parts"), lambda at, x: _after(at, x["paths"])))
    between = F.zip_with(F.slice("parts", 1, F.size("parts") - 1), F.slice("parts", 2, F.size("parts")), lambda x, y: F.concat(x["closes"], y["opens"]))
    illegal = F.aggregate("parts", F.lit(0).cast("long"), lambda n, x: n + x["illegal"]) + F.aggregate(between, F.lit(0).cast("long"), lambda n, x: n + _illegal(x))
    return grouped.select("conv", F.col("wider").alias("segment"), paths.alias("paths"), illegal.alias("illegal"), F.element_at("parts", 1)["opens"].alias("opens"), F.element_at("parts", -1)["closes"].alias("closes"))


def audits(marked: DataFrame) -> DataFrame:
    """Of every conversation: its faults, illegal pairs, and the least cost and audit that repair it."""
    live = F.col("copies") > 0
    count = lambda x: F.coalesce(F.sum(F.when(live, x)), F.lit(0)).cast("long")
    turn, copies = F.when(live, F.col("turn")), F.col("copies")
    heads = marked.groupBy("conv").agg(
        F.first("conv_id").alias("conv_id"),
        F.min(F.when(live, F.col("no"))).alias("head"),
        F.coalesce(F.max(turn) - F.min(turn) + 1 - F.count_distinct(turn), F.lit(0)).cast("long").alias("gaps"),
        count(F.when(F.col("blank"), copies).otherwise(0)).alias("blank"),
        count(F.when(F.col("blank"), 0).otherwise(copies - 1 + F.col("seen").cast("long"))).alias("duplicate"),
        count((F.col("cut") & ~F.col("seen")).cast("long")).alias("truncated"),
    )
    parts = segments(marked, heads)
    spread = marked.where("copies > 0").groupBy("conv").agg(F.count_distinct(F.shiftright("no", SEGMENT_BITS)).alias("n"))
    most = spread.agg(F.max("n")).first()[0] or 0
    while most > FAN:
        parts = staged(_joined(parts, FAN_BITS))
        most = parts.groupBy("conv").count().agg(F.max("count")).first()[0]
    states = F.col("paths")["e"]
    best = _inserted(states, lambda u, a: _least(states["e"], a))
    whole = _joined(parts, 63).select("conv", "illegal", best.alias("best"))
    found = heads.join(whole, "conv", "left")
    return found.select("conv", "conv_id", "gaps", "blank", "duplicate", "truncated", F.coalesce("illegal", F.lit(0)).alias("illegal"), F.coalesce(F.col("best.cost"), F.lit(0)).alias("cost"), F.coalesce("best.audit", F.lit("")).alias("audit"))


def replay(audit: str, rows: Iterator[tuple[str, str, int]]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of the turns that an audit leaves of the rows (role, text, copies)."""
    at, user = 0, True  # user: whether a user's turn is next
    for role, text, copies in rows:
        for _ in range(copies):
            while audit[at] == "I":
                yield "I", "user" if user else "assistant", ""
                at, user = at + 1, not user
            edit, at = audit[at], at + 1
            if edit == "R":
                yield edit, "user" if user else "assistant", text
                user = not user
            elif edit == "K":
                yield edit, role, text
                user = role[:1] != "u"
    for edit in audit[at:]:
        yield edit, "user" if user else "assistant", ""
        user = not user


def _streamed(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Each conversation's audit (kind 0), then its turns in order, in one partition."""
    empty = {c: F.lit(None).cast(t) for c, t in found.dtypes + rows.dtypes}
    columns = list(dict.fromkeys(found.columns + rows.columns))
    heads = found.select(F.lit(0).alias("kind"), *[F.col(c) if c in found.columns else empty[c].alias(c) for c in columns], F.lit(None).cast("binary").alias("digest"))
    live = rows.where("copies > 0").select(F.lit(1).alias("kind"), *[F.col(c) if c in rows.columns else empty[c].alias(c) for c in columns], _digest().alias("digest"))
    return heads.unionByName(live).repartition("conv").sortWithinPartitions("conv", "kind", "turn", "role", "digest").drop("digest")


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Iterator[tuple[str, str, int]]]]:
    """(audit row, its turns) of sorted rows; turns must be read before the next."""
    rows = (r for batch in batches for at in range(0, batch.num_rows, 256) for r in batch.slice(at, 256).to_pylist())
    held = next(rows, None)

    def own() -> Iterator[tuple[str, str, int]]:
        nonlocal held
        while (held := next(rows, None)) is not None and held["kind"]:
            yield held["role"], held["text"], held["copies"]

    while held is not None:
        yield held, own()


DIGESTED = "conv_id {0}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def repaired(conversations: DataFrame) -> DataFrame:
    """The repaired turns: conv_id, place (from 0), role, text and the edit that gave each."""
    rows = turns(conversations)
    found = audits(flagged(rows)).select("conv", "conv_id", "audit")
    schema = pa.schema([("place", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string()), ("conv", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for head, own in _conversations(batches):
            out = []
            for place, (edit, role, text) in enumerate(replay(head["audit"], own)):
                out.append({"place": place, "role": role, "text": text, "edit": edit, "conv": head["conv"]})
                if len(out) == 1024:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out = []
            yield pa.RecordBatch.from_pylist(out, schema)

    kind = dict(conversations.dtypes)["conv_id"]
    turned = _streamed(rows, found).mapInArrow(run, "place long, role string, text string, edit string, conv string")
    return turned.select(F.when(F.col("conv") != " ", F.col("conv")).cast(kind).alias("conv_id"), "place", "role", "text", "edit")


def digests(rows: DataFrame) -> DataFrame:
    """Of every conversation its counts, cost, audit and the SHA-256 of its repaired turns."""
    found = audits(flagged(rows))
    kind = dict(rows.dtypes)["conv_id"]
    names = [x.split()[0] for x in DIGESTED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None

        def tapped() -> Iterator[pa.RecordBatch]:
            nonlocal schema
            for batch in batches:
                schema = schema or pa.schema([batch.schema.field(c) if c in batch.schema.names else pa.field(c, pa.string()) for c in names])
                yield batch

        out = []
        for head, own in _conversations(tapped()):
            whole = hashlib.sha256()
            for place, (_, role, text) in enumerate(replay(head["audit"], own)):
                whole.update(f"{chr(10) if place else ''}{role}:{text}".encode())
            out.append({c: head.get(c) for c in names} | {"repaired_sha256": whole.hexdigest()})
            if len(out) == 1024:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return _streamed(rows, found).mapInArrow(run, DIGESTED.format(kind))


def op11_conversations(spark, sf_dir: str) -> DataFrame:
    return digests(damage(turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))
