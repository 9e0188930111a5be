"""Bug classes: what went wrong, by free text, weakness number or the trace of a crash."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.text import bare_function

#: The words of each class of bugs, in lower case, - and _ as blanks.
CLASS_WORDS = {
    "use-after-free": ["use after free"],
    "use-after-return": ["use after return"],
    "use-after-scope": ["use after scope"],
    "double-free": ["double free"],
    "invalid-free": ["invalid free"],
    "heap-overflow": ["heap buffer overflow", "heap based buffer overflow", "heap overflow", "heap buffer overread", "heap overread"],
    "stack-overflow": ["stack buffer overflow", "stack buffer underflow", "stack based buffer overflow"],
    "global-overflow": ["global buffer overflow"],
    "stack-exhaustion": ["stack overflow", "stack exhaustion", "uncontrolled recursion"],
    "null-deref": ["null pointer", "null dereference", "null deref", "nullpointerexception", "nil pointer"],
    "divide-by-zero": ["divide by zero", "division by zero", "zerodivisionerror", "sigfpe"],
    "integer-overflow": ["integer overflow", "signed integer overflow", "unsigned integer overflow"],
    "invalid-shift": ["shift exponent", "shift base"],
    "memory-leak": ["memory leak", "detected memory leaks"],
    "data-race": ["data race"],
    "uninitialized-read": ["uninitialized", "use of uninitialised"],
    "out-of-bounds": ["out of bounds", "buffer overflow", "buffer overread", "invalid write", "invalid read", "arrayindexoutofbounds", "index out of range"],
}
#: Classes of weakness numbers that name one.
CLASS_OF_CWE = {
    "CWE-119": "out-of-bounds",
    "CWE-120": "out-of-bounds",
    "CWE-121": "stack-overflow",
    "CWE-122": "heap-overflow",
    "CWE-125": "out-of-bounds",
    "CWE-190": "integer-overflow",
    "CWE-369": "divide-by-zero",
    "CWE-401": "memory-leak",
    "CWE-415": "double-free",
    "CWE-416": "use-after-free",
    "CWE-457": "uninitialized-read",
    "CWE-476": "null-deref",
    "CWE-674": "stack-exhaustion",
    "CWE-787": "out-of-bounds",
    "CWE-908": "uninitialized-read",
}
#: Words that deny the class right after them; the class of an unclear word; kinds of out-of-bounds accesses; the first page.
DENIALS = ("not", "no", "never", "nor", "neither", "isn't", "wasn't", "aren't", "rather than", "instead of", "ruled out")
EITHER_STACK, OVERFLOWS, NULL_PAGE = "stack-overflow-or-exhaustion", ("heap-overflow", "stack-overflow", "global-overflow"), 4096
#: What compilers append to names of copied functions.
CLONES = "isra|part|constprop|cold|lto_priv|localalias|clone"

_WORDS = "|".join(re.escape(w) for w in sorted((w for ws in CLASS_WORDS.values() for w in ws), key=lambda w: (-len(w), w)))
_DENIED = "(?<!\\b(?:" + "|".join(re.escape(w) for w in DENIALS) + ")(?: (?:a|an|the|any))? )"
#: The first word that isn't denied; a missing check ("no null pointer check") denies nothing.
_FIRST = f"{_DENIED}(?:{_WORDS})|(?:{_WORDS})(?= check)"


def _folded(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[-_\\s]+", " "))


def class_of_text(text: Column, prose: bool = False) -> Column:
    """The class that a text's first 512 characters name first, the longest word of equals; null if none. In prose a bare "stack overflow" is unclear."""
    found = F.regexp_extract(_folded(F.substring(text, 1, 512)), _FIRST, 0)
    table = F.create_map(*[F.lit(x) for c, ws in CLASS_WORDS.items() for w in ws for x in (w, c)])
    out = F.try_element_at(table, found)
    return F.when(found == "stack overflow", EITHER_STACK).otherwise(out) if prose else out


def class_of_cwe(cwe: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in CLASS_OF_CWE.items() for x in pair]), F.upper(F.trim(cwe)))


def class_of_crash(format_: Column, bug_type: Column, message: Column, address: Column, has_region: Column) -> Column:
    """The class of a trace: a bad access near address 0 is a null dereference; one that valgrind places by a heap block is a heap overflow."""
    named = class_of_text(bug_type)
    return (
        F.when(F.lower(bug_type).contains("segv"), F.when(address.between(0, NULL_PAGE - 1), "null-deref").otherwise("segv"))
        .when((named == "out-of-bounds") & (format_ == "valgrind") & has_region, "heap-overflow")
        .otherwise(F.coalesce(named, class_of_text(message), F.nullif(F.replace(_folded(F.substring(bug_type, 1, 80)), F.lit(" "), F.lit("-")), F.lit(""))))
    )


def same_class(left: Column, right: Column) -> Column:
    """Whether two classes can be one bug: equal, out-of-bounds with any overflow, or the unclear one with either; never if one is unknown."""
    pair = lambda a, b: ((left == a) & right.isin(b)) | ((right == a) & left.isin(b))
    return F.coalesce((left == right) | pair("out-of-bounds", list(OVERFLOWS)) | pair(EITHER_STACK, ["stack-overflow", "stack-exhaustion"]), F.lit(False))


def plain_function(name: Column) -> Column:
    """A function's bare name without what compilers append: foo.isra.0 -> foo."""
    return bare_function(F.regexp_replace(F.trim(name), f"(?<=.)\\.(?:{CLONES}|[0-9]+)(?:\\..*)?$", ""))


#: Phrases of runtime errors and their kinds, more specific ones first.
RUNTIME_ERRORS = (
    ("unsigned integer overflow", "unsigned-integer-overflow"),
    ("signed integer overflow", "signed-integer-overflow"),
    ("negation of", "signed-integer-overflow"),
    ("shift exponent", "shift-exponent"),
    ("left shift of", "shift-base"),
    ("division by zero", "integer-divide-by-zero"),
    ("division of", "signed-integer-overflow"),
    ("null pointer passed as argument", "nonnull-attribute"),
    ("null pointer returned from function", "returns-nonnull-attribute"),
    ("applying non-zero offset", "pointer-overflow"),
    ("pointer index expression", "pointer-overflow"),
    ("null pointer", "null-pointer-dereference"),
    ("misaligned address", "misaligned-address"),
    ("out of bounds for type", "array-bounds"),
    ("is not a valid value for type", "invalid-value-load"),
    ("is outside the range of representable values", "float-cast-overflow"),
    ("implicit conversion", "implicit-conversion"),
    ("unreachable program point", "unreachable"),
    ("end of a value-returning function", "missing-return"),
    ("through pointer to incorrect function type", "function-type-mismatch"),
    ("variable length array bound", "vla-bound"),
    ("insufficient space for an object", "object-size"),
    ("which does not point to an object of type", "vptr"),
)


def runtime_error(message: Column) -> Column:
    """The kind of a runtime error by its message; unknown if no phrase is in it."""
    out = F.lit("unknown")
    for phrase, kind in reversed(RUNTIME_ERRORS):
        out = F.when(F.contains(F.lower(message), F.lit(phrase)), F.lit(kind)).otherwise(out)
    return out
