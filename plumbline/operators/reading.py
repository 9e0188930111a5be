"""Whole reports read at once: mentions, structured claims and traces of a report, merged into its claims, on Arrow batches.

Expressions over arrays are interpreted for each element, and claims of one report that come from many steps have to be shuffled together again. Here a report's text is read in one pass, and nothing is shuffled.
The patterns are those of claims, extraction, traces and scopes; what they mean for a text that is not plain ASCII is kept by a second form of each (`_dialect`)."""

from __future__ import annotations

import bisect
import datetime
import functools
import hashlib
import itertools
import json
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa

from plumbline.functions import text as T
from plumbline.functions.external import STANDARD
from plumbline.operators import code, scopes, traces
from plumbline.operators import extraction as X

#: Line ends of the patterns' dialect, beside \n.
_ENDS = "\n\r\u0085\u2028\u2029"


def _dialect(pattern: str, exact: bool) -> str:
    """A pattern of the columns' dialect for `re`. exact: line ends, edges of lines and words as they are there for any text; else for ASCII without carriage returns, where both agree."""
    out, i, depth = [], 0, 0
    flags = re.match(r"\(\?([a-z]+)\)", pattern)
    single = [bool(flags and "s" in flags[1])]
    many = bool(flags and "m" in flags[1])
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            two = pattern[i : i + 2]
            if two == "\\Q":
                end = pattern.index("\\E", i)
                out.append(re.escape(pattern[i + 2 : end]))
                i = end + 2
                continue
            out.append("\\Z" if two == "\\z" else "(?u:\\b)" if exact and two == "\\b" and not depth else two)
            i += 2
            continue
        if depth:
            depth -= c == "]"
            out.append("\\[" if c == "[" else c)
        elif c == "[":
            depth = 1
            out.append(c)
            if pattern[i + 1 : i + 2] == "^":
                out.append("^")
                i += 1
            if pattern[i + 1 : i + 2] == "]":
                out.append("\\]")
                i += 1
        elif c == "(":
            found = re.compile(r"\(\?([a-z]+):").match(pattern, i)
            single.append(single[-1] or bool(found and "s" in found[1]))
            out.append(c)
        elif c == ")":
            if len(single) > 1:
                single.pop()
            out.append(c)
        elif exact and c == "." and not single[-1]:
            out.append(f"[^{_ENDS}]")
        elif exact and c == "^" and many:
            out.append(rf"(?:(?<![^{_ENDS}])(?!(?<=\r)\n)(?!\Z))")
        elif exact and c == "$":
            out.append(rf"(?:(?=[{_ENDS}]|\Z)(?<!\r(?=\n)))" if many else rf"(?=(?:\r\n|[{_ENDS}])?\Z)")
        else:
            out.append(c)
        i += 1
    return "".join(out)


@functools.cache
def _compiled(pattern: str, exact: bool) -> re.Pattern:
    return re.compile(_dialect(pattern, exact), re.ASCII)


class Patterns:
    """The patterns as attributes, in the form that a text needs: compiled once in a process."""

    def __init__(self, exact: bool, names: tuple[str, ...], prefixes: tuple[str, ...]):
        from plumbline.operators import claims as C

        of = lambda p: _compiled(p, exact)
        self.line_ends = _ENDS if exact else "\n"
        self.block, self.diff, self.hunked = of(X._BLOCK), of(X._DIFF), of(r"(?m)^@@")
        self.head, self.close, self.info = of(r"^[^\n]*(?:\n|\z)"), of(r"\n? {0,3}(?:`{3,}|~{3,})[ \t]*\z"), of(r"^ {0,3}(?:`+|~+)\s*([\w+#.-]*)")
        self.lead = of(r"\A(?:\s*<!--(?s:.*?)-->)*\s*(?:#[^\n]*\n?\s*)?")
        self.facts = of("|".join([r"(?<!\w)cvss(?!\w)", *[rf"(?<!\w){w}s? {{0,2}}:" for w in C.LABELS]]))
        # as X.ENDS, but that a match is of one character, so that all are found: what a blank line holds more is group 1
        self.ends = of(r"[.!?](?=\s)|\n(?:(?=([ \t]*\n))|(?=[ \t]*(?:[-*+]|[0-9]{1,3}[.)]|#{1,6})\s))")
        self.no, self.not_ = of(_words("not no never nor neither without isn't doesn't don't cannot can't".split(), exact)), of(r"^[^.;]{0,16}\b(is|are|was|were|does|do) (not|never)\b")
        # over lower case in ASCII
        self.bugs = of(C.BUG_WORDS) if exact else of("(?:" + "|".join(f"{w[0]}(?<!\\w{w[0]}){w[1:]}" for w in C.BUG_WORDS.removeprefix(r"(?i)\b(?:").removesuffix(r")\b").split("|")) + r")\b")
        self.locations, self.symbols, self.references, self.flags, self.impacts, self.behaviors = of(X.LOCATIONS), of(X.SYMBOLS), of(C.REFERENCES), of(C.FLAGS), of(C.IMPACTS), of(C.BEHAVIORS)
        # the same with the letters first by which `re` finds its places
        self.flags = of(C.FLAGS.replace(r"(?<![\w-])--", r"--(?<![\w-]--)", 1))
        self.references = self.references if exact else of(functools.reduce(lambda s, w: s.replace(rf"|\b{w}", rf"|{w[0]}(?<!\w{w[0]}){w[1:]}"), ("CVE", "CWE", "GHSA", "commit"), C.REFERENCES))
        self.url = of(r"https?://[^\s<>\"'`\])}]{1,2000}")
        # versions
        self.cut = of(f"({X._lexed(names)})")
        self.readings, self.v = of(X.READINGS), of(f"(?i){X.V}")
        self.numbered, self.n, self.vn, self.day, self.commit, self.named_tag, self.letters = of("[0-9/]"), of(rf"^{X.V}$"), of(rf"^v{X.V}$"), of(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), of(r"^(?=[0-9]*[a-f])[0-9a-f]{7,40}$"), of(r"^[A-Za-z][A-Za-z0-9]*[-_][0-9]+(?:_[0-9]+)+[a-z]?$"), of(r"^[a-f]{7,40}$")
        self.sha = of(r"(?i)(?:commit/|(?:commit|rev|revision|sha|hash|at)\b\s{0,3}[:#]?\s{0,3}`?)([0-9a-f]{7,40})`?$")
        self.sha_said = of(r"(?i)(?:commit/|(?:commit|rev(?:ision)?|sha|hash|at)\s{0,3}[:#]?\s{0,3}`?)([0-9a-f]{7,40})`?$")
        self.tag, self.ranged = of(r"^[A-Za-z][A-Za-z0-9]{1,30}[-_]([0-9]++(?:_[0-9]++){1,3}[a-z]?)$"), of(r"(?i)^all\s+version|and\s+(all\s+)?(earlier|prior|older|below|previous)$")
        self.hex = of("[a-f]")
        self.cue, self.blanks, self.cues = of(r"^([a-z]+(?:\s+(?:to|in|on|with|against)\b)?|<=|>=|<|>)(?=[\s`0-9v])"), of(r"\s+"), of(X._CUES)
        self.last_day, self.branch = of(r"([0-9]{4}-[0-9]{2}-[0-9]{2})$"), of(r"\b(master|main|HEAD|trunk|latest)\b")
        self.span, self.all, self.earlier, self.open_end, self.through = of(r"^(from\s|>=.*<)"), of(r"^all\s+version"), of(r"and\s+(all\s+)?(earlier|prior|older|below|previous)$"), of(r"^>=.*<[^=]"), of(r"up\s+to|through")
        self.word = of("^(" + "|".join(f"\\Q{n}\\E" for n in sorted(names, key=lambda n: (-len(n), n))) + r")\s") if names else None
        self.product = of(r"(?<!\w)(?:" + "|".join(f"\\Q{n}\\E" for n in sorted(names, key=lambda n: (-len(n), n))) + r")(?!\w)") if names else None
        # places and symbols
        self.blob = of(r"^https?://([^/]+)/([^/]+)/([^/]+)/(?:-/)?blob/([^/]+)/([^#]+?)[.,;:]*(?:#L([0-9]+)(?:-L?([0-9]+))?)?$")
        self.http, self.path, self.free_path = of("^https?://"), of(X.PATH), of(rf"(?<![\w/.@:~-])({X.PATH})(?![\w/-])")
        self.suffix, self.worded = of(rf"{X.PATH}:([0-9]{{1,7}})(?::([0-9]{{1,5}}))?$"), of(r"(?i)lines?\s{1,3}([0-9]{1,7})(?:\s{0,2}[-\u2013]\s{0,2}([0-9]{1,7}))?")
        self.beside_before, self.beside_after, self.letters_of = of(r"(\w+)[ \t]+$"), of(r"[ \t]+(\w+)"), of(r"\w+")
        self.whole_name = of(rf"^({X._NAME})(?:\s{{0,2}}\([^()]{{0,200}}\)?)?$")
        self.severity, self.last_word, self.last_name = of("(?i)severity"), of(r"([\w.]+)$"), of(r"([A-Za-z0-9_]+)`?$")
        # blocks
        self.roles = (
            ("trace", of("(?m)^(==[0-9]+==|\\s*#[0-9]+\\s|Traceback \\(most recent call last\\)|\\s+at [\\w.$<>]+\\(|panic: |goroutine [0-9]+ )")),
            ("patch", of("(?m)^(diff --git |--- [^\\n]+\\n\\+\\+\\+ |@@ -[0-9]+)")),
            ("poc", of("(?m)^(\\$ |# |curl |python3? |gcc |clang |make |\\./)")),
            ("log", of("(?m)^\\[?[0-9]{4}-[0-9]{2}-[0-9]{2}[ T]")),
        )
        self.near_call, self.prompt, self.main, self.python = of(r"`?([A-Za-z_][A-Za-z0-9_]{2,100})\(\)`?"), of(r"^PS[^>\n]*>[ \t]+(\S.*)$"), of(r"\bint\s+main\s*\("), of(r"^#![^\n]*python")
        self.two_words = of(r"[ \t]+")
        # code of snippets
        self.strings, self.chars, self.line_comment, self.comment = of(r'"(?:[^"\\\n]++|\\.)*+"'), of(r"'(?:[^'\\\n]|\\.)'"), of(r"//[^\n]*"), of(r"/\*[^*\n]*\*+(?:[^/*\n][^*\n]*\*+)*+/")
        # each with the word that its heads have
        worded = [(w, p) for name, w in (("ruby", "def"), ("python", "def"), ("go", "func"), ("rust", "fn"), ("php", "function")) for p in scopes.LANGUAGES[name].functions] + [("function", p) for p in scopes.LANGUAGES["javascript"].functions[:1]]
        self.define, self.heads, self.others = of(r"^\s*#\s*define\s+(\w+)"), [(w, of(p)) for w, p in worded], [("(", of(p)) for p in (*scopes.LANGUAGES["cpp"].functions, *scopes.LANGUAGES["java"].functions, *scopes.LANGUAGES["javascript"].functions[1:])]
        self.macro, self.macro_first, self.macro_typed = of(scopes._MACRO), of(r"[ \t]+[A-Za-z_]\w*[\w \t]*[ \t*]+[A-Za-z_]\w*[ \t]*\("), of(r"[ \t]+[A-Za-z_]\w*[ \t]*\(")
        self.capitals, self.typed = of("[A-Z][A-Z0-9_]{2}"), of(r"[a-z_][\w *]{0,60}[ *]\Z")
        # patches
        self.old, self.new, self.old_line, self.new_line = of(r"^--- (\S{1,1000})"), of(r"^\+\+\+ (\S{1,1000})"), of(r"^--- \S"), of(r"^\+\+\+ \S")
        self.hunk, self.other_line, self.ab = of(X._HUNK), of(r"^(diff --git |index [0-9a-f]|new file|deleted file|similarity |rename |old mode|new mode)"), of("^[ab]/")
        # options and behaviours
        self.flag, self.key = of(r"(?<![\w-])(--[A-Za-z0-9][A-Za-z0-9-]{0,60}+)(?![\w-])"), of(r"(?<![\w.-])([A-Za-z][\w-]{1,40}\.[A-Za-z][\w.-]{1,60}+)(?==)")
        self.ticked = of(r"`([^`\n]{1,300})`")
        self.constant = of("(?<!\\w)((?:" + "|".join(f"\\Q{p}\\E" for p in sorted(prefixes)) + ")[A-Z0-9_]{2,60}+)(?!\\w)") if prefixes else None
        self.code, self.code_name, self.joined = of(X._CODE), of(rf"^`?({X._NAME})(?:\([^()]*\))?`?$"), of(r"[ \t]*\n[ \t]+|[ \t]{2,}|\t|\n(?!\n)")
        self.said = [(predicate, of(p), called) for predicate, p, called in X.SAID]
        # traces
        self.headers = [(name, of(p)) for name, p in traces.HEADERS]
        self.trace_labels = [(name, of(p)) for name, p in traces.LABELS]
        self.frames = {name: [(of(p), groups) for p, groups in patterns] for name, patterns in traces.FRAMES.items()}
        self.next_line = {name: of(p) for name, p in traces.NEXT_LINE.items()}
        self.at, self.runtime, self.runtime_path, self.shared = of(r"^\s+at "), of(traces.RUNTIME), of(r"^(?:node:|/rustc/|/usr/lib/|/usr/src/debug/glibc)"), of(r"\.(so|dylib|dll)\b")
        self.arguments, self.templates, self.qualifiers = of("\\(.*$"), of("<[^<>]*>"), of("^.*(::|\\.)")
        # paths
        self.folder, self.extension, self.space, self.no_name, self.dot_js = of("^.*/"), of("\\.([A-Za-z0-9]{1,5})(?:\\.in)?$"), of("\\s"), of("^(?![0-9]+\\.)[^.]"), of("^[A-Z][A-Za-z]{1,30}\\.js$")
        self.last_dotted, self.bare, self.bare_external = of(r"\.([^.]+)$"), of(r"^.*(::|\.|#)"), of(r"^.*(?:::|\.)")
        self.owners = (
            ("third_party", of("^(?:/usr/|/lib|/opt/|/System/|/Library/|/nix/store/|[A-Za-z]:/Windows/|/Applications/)")),
            ("reporter_artifact", of("^(?:/tmp/|/var/tmp/|/private/tmp/|/var/folders/|/dev/shm/)")),
            ("unscoped", of("^(?:~/|/home/|/Users/|/root/)")),
        )


def _words(words: list[str], exact: bool) -> str:
    """A pattern of whole words; in ASCII with their first letters first, by which `re` finds its places."""
    return "(?:" + "|".join(rf"\b{w}" if exact else rf"{w[0]}(?<!\w{w[0]}){w[1:]}" for w in words) + r")\b"


@functools.cache
def _patterns(exact: bool, names: tuple[str, ...], prefixes: tuple[str, ...]) -> Patterns:
    return Patterns(exact, names, prefixes)


def _extract(pattern: re.Pattern, text: str, group: int = 1) -> str:
    """What a group holds of the first match; empty if there is none."""
    m = pattern.search(text)
    return (m[group] or "") if m else ""


_PATH_EXTENSIONS, _STOPWORDS, _DATA_EXTENSIONS, _KEYWORDS = frozenset(T.PATH_EXTENSIONS), frozenset(X.STOPWORDS), frozenset(X.DATA_EXTENSIONS), frozenset(code.KEYWORDS)
_LETTERS = {word: letter for letter, words in X.WORD_CLASSES.items() for word in words}
_RANK = {"project_attributed": 0, "third_party": 1, "reporter_artifact": 2}
#: Words without which nothing is said of functions.
_SAID_SIGNS = ("call", "invokes", "uses", "passes", "check", "validate", "verify", "bound", "free", "integer")
#: Words without which no header of a trace begins.
_TRACE_SIGNS = ("Sanitizer", "runtime error", "==", "Program received", "Traceback", "Exception in", "panic", "fatal error", "Error")
#: Distinct words whose letter is kept.
_MOST_WORDS = 100_000


_JSON = json.JSONEncoder(separators=(",", ":"), ensure_ascii=False).encode


def _said(of: dict) -> str:
    """What a struct is as JSON: what is null is left out."""
    out = _JSON({k: v for k, v in of.items() if v is not None})
    return re.sub(r"(?<!\\)((?:\\\\)*)\\u00([0-9a-f]{2})", lambda m: f"{m[1]}\\u00{m[2].upper()}", out) if "\\u00" in out else out


_BLANKS = frozenset(" \t\n\r\u0085\u2028\u2029")


def _before(p: Patterns, text: str, end: int) -> re.Match | None:
    """The word before a name and its blanks, looked for from its end on, in ASCII without carriage returns."""
    back = text[max(0, end - X.BESIDE) : end].removesuffix("\n")
    word = back.rstrip(" \t")
    m = p.letters_of.match(word[::-1]) if len(word) < len(back) else None
    return p.beside_before.match(back, len(word) - m.end()) if m else None


def _first(text: str, low: str, words: tuple[str, ...], lower: tuple[str, ...], before: int) -> int | None:
    """Where a pattern can begin that has one of these words, with at most so many characters before it; null if there is none."""
    places = [at for of, found in ((text, words), (low, lower)) for w in found if (at := of.find(w)) >= 0]
    return None if not places else max(min(places) - before, 0) if text.isascii() else 0


class Reader:
    """Reads reports. names: products as they are written, to the product; programs, prefixes: the project's own; external: names of further libraries; structured: whether mentions that hold more
    than a value are read too (and versions, behaviours and flags only so); traced: whether traces scope claims and make them core."""

    def __init__(self, products: dict[str, str] | None = None, programs: Iterable[str] | None = None, prefixes: Iterable[str] | None = None, external: Iterable[str] = (), structured: bool = False, traced: bool = False):
        self.names = {k.lower(): v for k, v in (products or {}).items()}
        self.programs, self.known = frozenset(programs or ()), STANDARD | set(external)
        self.structured, self.traced, self.kept, self.held, self.named = structured, traced, {}, {}, {}
        self.prefixes = tuple(prefixes or ())

    # ---- a text and its parts ----------------------------------------------------------------------------------------

    def blocks(self, p: Patterns, body: str, found: list[re.Match]) -> list[tuple[int, int, str, int, str]]:
        out = []
        for m in found:
            text = m[0]
            if not text.startswith("<!--"):
                head = p.head.search(text)[0]
                out.append((m.start(), m.end(), _extract(p.info, head), m.start() + len(head), p.close.sub("", text[len(head) :])))
        return out

    @staticmethod
    def blanked(text: str, found: Iterable[re.Match]) -> str:
        parts, at = [], 0
        for m in found:
            parts += [text[at : m.start()], " " * (m.end() - m.start())]
            at = m.end()
        return "".join([*parts, text[at:]])

    def without_diffs(self, p: Patterns, text: str) -> str:
        return self.blanked(text, [m for m in p.diff.finditer(text) if p.hunked.search(m[0])]) if "\n@@" in text else text

    def lead_end(self, p: Patterns, text: str) -> int:
        head = p.lead.match(text).end()
        blank = text.find("\n\n", head)
        if blank < 0:
            return len(text)
        line = text[head:blank].strip(" ")
        if "\n" in line or not (line.startswith(("**", "|", ">")) or ":**" in line or ((":" in line or "cvss" in line.lower()) and p.facts.search(line.lower()))):
            return blank + 1
        after = text.find("\n\n", blank + 2)
        return after + 1 if after >= 0 else len(text)

    def role(self, p: Patterns, info: str, content: str) -> str:
        low = info.lower()
        if low in ("diff", "patch"):
            return "patch"
        if low in ("sh", "bash", "shell", "console", "zsh"):
            return "poc"
        return next((role for role, pattern in p.roles if pattern.search(content)), "snippet")

    # ---- names and paths ---------------------------------------------------------------------------------------------

    def is_path(self, p: Patterns, text: str) -> bool:
        found = self.held.get(text)
        if found is None:
            if len(self.held) >= _MOST_WORDS:
                self.held.clear()
            found = self.held[text] = self._is_path(p, text)
        return found

    def _is_path(self, p: Patterns, text: str) -> bool:
        base = p.folder.sub("", text)
        return _extract(p.extension, base).lower() in _PATH_EXTENSIONS and not p.space.search(text) and bool(p.no_name.search(base)) and not p.dot_js.search(text)

    def owner(self, p: Patterns, path: str) -> str:
        return next((owner for owner, pattern in p.owners if pattern.search(path)), "project_attributed")

    def acceptable(self, p: Patterns, name: str) -> bool:
        bare = p.bare.sub("", name)
        if len(bare) < 3 or bare in _STOPWORDS or name in _STOPWORDS:
            return False
        return "." not in name or not (_extract(p.last_dotted, name).lower() in _DATA_EXTENSIONS or self.is_path(p, name))

    def is_external(self, p: Patterns, name: str) -> bool:
        return name.startswith("std::") or name in self.known or p.bare_external.sub("", name) in self.known

    def name_of(self, p: Patterns, marked: str) -> tuple[str, bool]:
        """The name that a text between backticks, a call or a word is, empty if it is none, and whether a library has it."""
        found = self.named.get(marked)
        if found is None:
            if len(self.named) >= _MOST_WORDS:
                self.named.clear()
            name = _extract(p.whole_name, marked.replace("`", "").strip(" "))
            found = self.named[marked] = (name, self.is_external(p, name)) if name and self.acceptable(p, name) else ("", False)
        return found

    def bare_function(self, p: Patterns, name: str) -> str:
        if "(" in name or "<" in name:
            name = p.templates.sub("", p.arguments.sub("", name, 1))
        return p.qualifiers.sub("", name, 1).strip(" ")

    def paths_in(self, p: Patterns, text: str) -> list[str]:
        return [m[1] for m in p.free_path.finditer(text) if self.is_path(p, m[1])] if "." in text else []

    # ---- versions ----------------------------------------------------------------------------------------------------

    def letter(self, p: Patterns, word: str) -> str:
        low = word.lower()
        if low in self.names:
            return "P"
        commit = "K" if len(word) >= 12 else "H"
        if p.numbered.search(word):
            if p.n.search(word):
                return "N"
            if p.vn.search(word):
                return "v"
            if word.startswith("http") and "/commit/" in word:
                return "U"
            return "D" if p.day.search(word) else commit if p.commit.search(word) else "T" if p.named_tag.search(word) else "."
        if word in ("master", "main", "trunk"):
            return "M"
        if word == "HEAD":
            return "Z"
        return commit if len(word) >= 7 and p.letters.search(word) else _LETTERS.get(low, ".")

    def letters(self, p: Patterns, words: list[str]) -> str:
        kept = self.kept
        try:
            return "".join([kept[w] for w in words])
        except KeyError:
            if len(kept) >= _MOST_WORDS:
                kept.clear()
            for w in words:
                kept[w] = self.letter(p, w)
            return "".join([kept[w] for w in words])

    def phrases(self, p: Patterns, text: str) -> list[tuple[int, int, str]]:
        # between words, and words
        parts = p.cut.split(text)
        out, at, done = [], 0, 0
        for m in p.readings.finditer(self.letters(p, parts[1::2])):
            first, last = 2 * m.start() + 1, 2 * m.end() - 1
            start = at + sum(map(len, parts[done:first]))
            at, done = start + sum(map(len, parts[first : last + 1])), last + 1
            out.append((start, at, text[start:at]))
        return out

    def version(self, p: Patterns, t: str) -> str:
        numbers = [m[0] for m in p.v.finditer(t)]
        if len(numbers) > 1 or p.ranged.search(t):
            return t
        if numbers:
            return numbers[0]
        tag = _extract(p.tag, t).replace("_", ".")
        sha = "" if tag else _extract(p.sha, t).lower()
        return tag or ((sha if p.hex.search(sha) else "") if sha else t)

    def version_claims(self, p: Patterns, text: str) -> Iterator[tuple[str, int, dict]]:
        """raw, start and details of what a text says of versions."""
        for at, _, t in self.phrases(p, text):
            low = t.lower()
            numbers = [m[0] for m in p.v.finditer(t)]
            first = numbers[0] if numbers else None
            cue = p.blanks.sub(" ", _extract(p.cue, low))
            sha, tag, day, named = _extract(p.sha_said, t).lower(), _extract(p.tag, t).replace("_", "."), _extract(p.last_day, t), _extract(p.branch, t)
            cued = bool(p.cues.search(cue))
            if len(numbers) > 1 and p.span.search(low):
                kind = "span"
            elif p.all.search(low):
                kind = "all"
            elif p.earlier.search(low):
                kind = "earlier"
            elif cued and first is not None:
                starts = cue.startswith
                kind = "fixed" if starts("fixed") else "upto" if starts(("up", "through", "thru", "<=")) else "below" if starts(("before", "prior", "until")) or cue == "<" else "from" if starts(("since", ">=", ">", "introduced")) else "only" if starts("affect") else "tested"
            elif day:
                kind = "date"
            elif sha:
                kind = "commit" if p.hex.search(sha) else None
            elif tag:
                kind = "tag"
            elif first is not None:
                kind = "tested"
            elif named:
                kind = "branch"
            else:
                kind = None
            if kind is None or (kind == "date" and not _is_day(day)):
                continue
            relation = "affected_range" if kind in ("span", "all", "earlier", "upto", "below", "from", "only") else {"fixed": "fixed_in", "branch": "latest", "date": "unspecified"}.get(kind, "tested_on")
            lower = first if kind in ("span", "from", "only") else None
            upper = (numbers[1] if kind == "span" else first) if kind in ("span", "all", "earlier", "upto", "below", "only") else None
            inclusive = {"span": not p.open_end.search(low), "all": bool(p.through.search(low)), "earlier": True, "upto": True, "only": True, "below": False}.get(kind)
            raw = first if kind in ("fixed", "upto", "below", "from", "only") or (kind == "tested" and cued) else sha if kind == "commit" else t
            product = self.names.get(_extract(p.word, low)) if p.word else None
            yield raw, at + max(low.find(raw.lower()), 0), {
                "relation": relation, "parsed": tag if kind == "tag" else first if kind in ("tested", "fixed") else None, "lower": lower, "lower_inclusive": None if lower is None else cue != ">", "upper": upper,
                "upper_inclusive": inclusive, "special_ref": named if kind == "branch" else None, "commit": sha if kind == "commit" else None, "product": product,
            }

    # ---- plain mentions ----------------------------------------------------------------------------------------------

    def mentions(self, p: Patterns, plain: str, title: str) -> list[tuple]:
        """kind, extractor, value, start, end, confidence, provenance, negated, core, details."""
        out: list[tuple] = []
        add = out.append
        lead = self.lead_end(p, plain)
        low = plain.lower()
        starts, stops = [], []
        for m in p.ends.finditer(plain):
            starts.append(m.start())
            stops.append(m.end() if m[1] is None else m.end(1))
        stops.sort()
        # lower case may be longer than the text outside ASCII
        spoken = low if len(low) == len(plain) else plain
        denied = [(m.start(), m.end()) for m in p.no.finditer(spoken)] if any(x in low for x in ("no", "n't", "never", "without", "neither")) else []
        after = " not" in low or " never" in low
        faults, fault_ends = [], []
        for m in p.bugs.finditer(low if p.line_ends == "\n" else plain):
            faults.append(m.start())
            fault_ends.append(m.end())
        paths: dict[tuple[int, int], list[str]] = {}

        def sentence(start: int, end: int) -> tuple[int, int]:
            i, j = bisect.bisect_right(stops, start), bisect.bisect_left(starts, end)
            return max(start - X.REACH, stops[i - 1] if i else 0, 0), min(end + X.REACH, starts[j] if j < len(starts) else len(plain))

        def named(start: int, end: int) -> list[str]:
            """The paths of the clause."""
            a, b = sentence(start, end)
            a, to = max(a, plain.rfind(";", a, start) + 1), plain.find(";", end, b)
            of = (a, to if to >= 0 else b)
            if of not in paths:
                paths[of] = self.paths_in(p, plain[of[0] : of[1]])
            return paths[of]

        def negated(start: int, end: int) -> bool:
            for a, b in denied:
                if b > start:
                    break
                if a >= start - 48 and start - b <= 40 and "." not in plain[b:start] and ";" not in plain[b:start]:
                    return True
            return after and bool(p.not_.search(plain[end : end + 48].lower()))

        def core(start: int, end: int, value: str) -> bool:
            if start < lead or value in title:
                return True
            a, b = sentence(start, end)
            i = bisect.bisect_left(faults, a)
            return i < len(faults) and fault_ends[i] <= b

        def located(start: int, end: int, kind: str, extractor: str, value: str, confidence: float, provenance: str, at: int | None = None, to: int | None = None) -> None:
            outer = kind == "symbol" and provenance == "third_party"
            add((kind, extractor, value, start if at is None else at, end if to is None else to, confidence, provenance, negated(start, end), not outer and core(start, end, value), None))

        urls = [(m.start(), m.end()) for m in p.url.finditer(plain)] if "http" in plain else []
        if "." in plain or "/blob/" in plain:
            for m in p.locations.finditer(plain):
                t, start, end = m[0], m.start(), m.end()
                blob = p.blob.search(t) if t.startswith("http") else None
                if blob and blob[5]:
                    path, line, link = blob[5], blob[6], True
                else:
                    link, path = False, None if p.http.search(t) else _extract(p.path, t, 0) or None
                    line = None
                if not line and ":" in t:
                    line = _extract(p.suffix, t)
                line = line or _extract(p.worded, t)
                number = int(line) if line and int(line) < 1 << 31 else None
                if path is None and number is not None:
                    only = set(named(start, end))
                    path = only.pop() if len(only) == 1 else None
                if path is not None and (link or self.is_path(p, path)):
                    of_line = number is not None
                    located(start, end, "line" if of_line else "file", "paths.permalink" if link else "paths.line" if of_line else "paths.file", f"{path}:{number}" if of_line else path, 0.9 if of_line else 0.8, "project_attributed" if link else self.owner(p, path))
        for m in p.symbols.finditer(plain):
            t, start, end = m[0], m.start(), m.end()
            called, said = "(" in t, None
            if plain[start - 1 : start] in _BLANKS:
                word = p.beside_before.search(plain[max(0, start - X.BESIDE) : start]) if p.line_ends != "\n" else _before(p, plain, start)
                said = X.KIND_WORDS.get(word[1].lower()) if word else None
            if not said and (word := p.beside_after.match(plain, end, end + X.BESIDE)):
                said = X.KIND_WORDS.get(word[1].lower())
            if not (called or said or t[0] == "`"):
                continue
            name, external = self.name_of(p, t)
            if not name:
                continue
            place = start + max(t.find(name), 0)
            # what lies within a link is the link's
            if any(a < place + len(name) and place < b for a, b in urls):
                continue
            if external:
                provenance = "third_party"
            elif any(self.owner(p, x) == "project_attributed" for x in named(start, end)):
                provenance = "project_attributed"
            else:
                provenance = "project_attributed" if p.product and p.product.search(plain[slice(*sentence(start, end))].lower()) else "unscoped"
            located(start, end, "symbol", "symbols", name, 0.7 if (said or ("function" if called else "unknown")) == "unknown" else 0.85, provenance, place, place + len(name))
        if any(x in plain for x in ("http", "CVE-", "CWE-", "GHSA-", "commit ")):
            for m in p.references.finditer(plain):
                t = m[0]
                name = next((name for mark, name in (("http", "url"), ("CVE", "cve"), ("CWE", "cwe"), ("GHSA", "ghsa")) if t.startswith(mark)), "commit")
                add(("reference", f"references.{name}", t[7:] if t.startswith("commit ") else t, m.start(), m.end(), 0.95, "project_attributed" if name == "commit" else "unscoped", False, False, None))
        if (first := _first(plain, low, ("CVSS:",), ("severity", "score"), 6)) is not None:
            for m in p.impacts.finditer(plain, first):
                t = m[0]
                vector = t.startswith("CVSS:")
                value = t if vector else _extract(p.last_word, t)
                if value:
                    add(("impact", "impact.vector" if vector else "impact.severity" if p.severity.search(t) else "impact.score", value, m.start(), m.end(), 0.95 if vector else 0.7, "project_attributed", False, False, None))
        if self.structured:
            return out
        for start, end, t in self.phrases(p, plain):
            value = self.version(p, t)
            if value:
                add(("version", "versions", value, start + max(t.find(value), 0), end, 0.9, "project_attributed", False, False, None))
        if "--" in plain:
            for m in p.flags.finditer(plain):
                located(m.start(), m.end(), "option", "options.flag", m[0], 0.8, "project_attributed")
        if (first := _first(plain, low, (), ("call", "invokes", "frees", "checks", "validates"), 9)) is not None:
            for m in p.behaviors.finditer(plain, first):
                value = _extract(p.last_name, m[0])
                if value:
                    add(("behavior", "behavior", value, m.start() + max(m[0].find(value), 0), m.end(), 0.7, "project_attributed", False, False, None))
        return out

    # ---- structured mentions -----------------------------------------------------------------------------------------

    def program_of(self, command: str) -> str:
        run = False
        for word in re.split(r"\s+", command.strip(" "), flags=re.ASCII):
            runner = word in X.RUNNERS
            if not (runner or ("=" in word and not word.startswith("-")) or (run and (word.startswith("-") or re.search(r"^[0-9]+$", word, re.ASCII)))):
                return re.sub("^.*/", "", word)
            run = run or runner
        return ""

    def commands(self, p: Patterns, info: str, content: str) -> list[tuple[str, str]]:
        """Commands of a poc or log block with their programs."""
        out, shell = [], info.lower() in X.SHELLS
        for line in content.split("\n"):
            trimmed = line.strip(" ")
            words = p.two_words.split(trimmed, 1)
            shown = (words[1] if len(words) > 1 else "") if words[0] in X.PROMPTS else _extract(p.prompt, trimmed)
            command = shown or (trimmed if shell and not line.lstrip(" ").startswith("#") else "")
            if command:
                out.append((command, self.program_of(command)))
        return out

    def without_macros(self, p: Patterns, text: str) -> str:
        if not p.capitals.search(text):
            return text
        parts, at, i = [], 0, 0
        while m := p.capitals.search(text, i):
            i = m.start()
            before = text[max((text.rfind(e, 0, i) for e in p.line_ends)) + 1 : i]
            end = None
            for place, then in ((before in ("", "static ", "extern ", "inline ", "static inline "), p.macro_first), (bool(p.typed.match(before)), p.macro_typed)):
                end = end or (_macro_end(p, text, i, then) if place else None)
            if end:
                parts += [text[at:i], " " * (end - i)]
                at = i = end
            else:
                i += 1
        return "".join([*parts, text[at:]])

    def defined_names(self, p: Patterns, text: str) -> list[str]:
        plain = self.without_macros(p, text)
        for mark, pattern, to in (('"', p.strings, '""'), ("'", p.chars, "''"), ("//", p.line_comment, ""), ("/*", p.comment, " ")):
            plain = pattern.sub(to, plain) if mark in plain else plain
        lines, out = plain.split("\n"), {}
        named = lambda line, patterns: next((m[2] for m in (x.search(line) for w, x in patterns if w in line) if m and m[2]), None)
        opens: list[str] | None = None
        for i, line in enumerate(lines):
            name = (_extract(p.define, line) if "#" in line else "") or named(line, p.heads) if line else None
            if not name and line and (other := named(line, p.others)) and other not in _KEYWORDS:
                opens = opens or _openings(lines)
                name = re.sub(r"^.*::", "", other) if opens[i] == "{" else None
            if name is not None:
                out[name] = True
        return list(out)

    def snippet(self, p: Patterns, body: str, block: tuple) -> tuple[str | None, str | None, list[str]]:
        """Path and function that are named beside a block, and the names that it defines."""
        start, end, _, _, content = block
        before, after = body[:start].split("\n"), body[end:].split("\n")
        near = ["\n".join(before[max(len(before) - X.NEAR_LINES, 1) - 1 :][: X.NEAR_LINES + 1]), "\n".join(after[: X.NEAR_LINES + 1])]
        paths = [x for text in near for x in self.paths_in(p, text)]
        calls = [x for x in (_extract(p.near_call, text) for text in near) if x]
        return paths[0] if paths else None, calls[0] if calls else None, sorted((x for x in self.defined_names(p, content) if self.acceptable(p, x)), key=lambda x: x.encode())

    def patch(self, p: Patterns, diff: str) -> tuple[list[str], int, bool] | None:
        """Files in order, number of hunks and whether all are sound; null without hunks of files."""
        lines = diff.split("\n")
        old = new = wants = None
        hunk, open_, broken, seen, hunks = 0, False, False, [0, 0], []
        for i, line in enumerate(lines):
            head, mark = p.hunk.search(line), line[:1] or " "
            counted = hunk > 0 and not head and not broken and mark in " -+\\" and (seen[0] < wants[0] or seen[1] < wants[1])
            looks = (p.old_line.search(line) and i + 1 < len(lines) and p.new_line.search(lines[i + 1])) or (p.new_line.search(line) and i and p.old_line.search(lines[i - 1])) or p.other_line.search(line)
            if head:
                hunk, open_, broken, seen = hunk + 1, True, False, [0, 0]
                wants = tuple(1 if not head[k] else int(head[k]) for k in (2, 4))
                hunks.append([old if new == "/dev/null" and old is not None else new, wants, [0, 0]])
                continue
            if looks and not counted:
                open_ = False
                if not line.startswith("--- -") and (path := _extract(p.old, line)):
                    old = p.ab.sub("", path)
                if path := _extract(p.new, line):
                    new = p.ab.sub("", path)
            if open_ and hunk and mark in " -+":
                hunks[-1][2][0] += mark in " -"
                hunks[-1][2][1] += mark in " +"
            seen[0] += mark in " -"
            seen[1] += mark in " +"
            broken = broken or mark not in " -+\\"
        found = [h for h in hunks if h[0] is not None]
        return (list(dict.fromkeys(h[0] for h in found)), len(found), all(tuple(h[2]) == h[1] for h in found)) if found else None

    def behavior_claims(self, p: Patterns, plain: str) -> Iterator[tuple[str, str, str | None, int]]:
        low = plain.lower()
        found = list(p.code.finditer(plain)) if any(sign in low for sign in _SAID_SIGNS) else []
        if not found:
            return
        parts, at, names = [], 0, []
        for i, m in enumerate(found):
            parts += [plain[at : m.start()], f"<{i}>"]
            at = m.end()
            names.append((_extract(p.code_name, m[0]), m.start()))
        said = p.joined.sub(" ", "".join([*parts, plain[at:]]).lower())
        # numbers that stand in a text itself are none of a name's
        of = lambda number: names[int(number)] if len(number) < 10 and int(number) < len(names) else (None, None)
        for predicate, pattern, called in p.said:
            for m in pattern.finditer(said):
                # what is matched is read once more by itself
                again = pattern.search(m[0])
                subject, other = of(again[1]) if again else (None, None), of(again[2])[0] if again and called else None
                if subject[0] and other != "":
                    yield subject[0], predicate, other, subject[1]

    def options(self, p: Patterns, text: str, shown: list[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
        """token, kind and provenance of each option once."""
        best: dict[tuple[str, str], tuple[int, str]] = {}

        def take(token: str, kind: str, provenance: str) -> None:
            # the project's own use of a flag counts before others'
            rank = {"project_attributed": 0, "third_party": 1}.get(provenance, 2)
            best[token, kind] = min(best.get((token, kind), (rank, provenance)), (rank, provenance))

        inline = [(c, re.sub("^.*/", "", _extract(re.compile(r"^(\S+)", re.ASCII), c.strip(" ")))) for c in (m[1] for m in p.ticked.finditer(text)) if " -" in f" {c}"] if "`" in text else []
        for in_block, listed in ((False, inline), (True, shown)):
            for command, program in listed:
                owner = "project_attributed" if program in self.programs else "third_party" if program in X.TOOLS else "reporter_artifact" if in_block else "project_attributed"
                for m in p.flag.finditer(command):
                    take(m[1], "flag", owner)
        if "--" in text:
            for m in p.flag.finditer(p.ticked.sub(" ", text)):
                take(m[1], "flag", "project_attributed")
        if "=" in text:
            for m in p.key.finditer(text):
                take(m[1], "config_key", "project_attributed")
        if p.constant:
            for m in p.constant.finditer(text):
                take(m[1], "constant", "project_attributed")
        for (token, kind), (_, provenance) in best.items():
            yield token, kind, provenance

    def poc(self, p: Patterns, block: tuple) -> tuple[str, str | None]:
        _, _, info, _, content = block
        lang, found = info.lower(), self.commands(p, info, content)
        full = sum(x.strip(" ") != "" for x in content.split("\n"))
        if "LLVMFuzzerTestOneInput" in content:
            kind = "c_harness" if "int main" in content else "libfuzzer_input"
        elif lang in ("c", "cpp", "c++", "cc", "cxx", "objc") or ("#include" in content and p.main.search(content)):
            kind = "c_harness"
        elif lang in ("python", "py", "python3") or p.python.search(content):
            kind = "python"
        elif len(found) == 1 and full == 1:
            kind = "cli"
        else:
            kind = "shell" if lang in X.SHELLS or found or content.startswith("#!") else "file_input"
        return kind, found[0][0] if found else None

    def holding(self, p: Patterns, body: str, text: str, plain: str, blocks: list[tuple], found: list[dict]) -> list[tuple]:
        """Mentions that hold more than a value, as those of mentions, with details; text: the prose, plain: without its diffs."""
        out: list[tuple] = []
        add = lambda kind, extractor, value, details, confidence=0.9, provenance="project_attributed", start=None, end=None, core=False: out.append((kind, extractor, value, start, end, confidence, provenance, False, core, _said(details)))
        for raw, start, details in self.version_claims(p, text):
            add("version", "versions", raw, details, start=start, end=start + len(raw))
        roles = [self.role(p, b[2], b[4]) for b in blocks]
        shown = [c for b, role in zip(blocks, roles, strict=True) if role in ("poc", "log") for c in self.commands(p, b[2], b[4])]
        for token, kind, provenance in self.options(p, text, shown):
            add("option", "options", token, {"option_kind": kind}, 0.8, provenance)
        for subject, predicate, other, start in self.behavior_claims(p, plain):
            add("behavior", "behavior", " ".join(x for x in (subject, predicate, other) if x is not None), {"subject": subject, "predicate": predicate, "object": other}, 0.7, start=start, end=start + len(subject), core=True)
        diffs = [(b[3], b[4]) for b, role in zip(blocks, roles, strict=True) if role == "patch"]
        diffs += [(m.start(), m[0]) for m in p.diff.finditer(text) if p.hunked.search(m[0])] if "@@" in text else []
        for start, diff in diffs:
            diff = re.sub(r"\A\n+|\n+\Z", "", diff)
            if patch := self.patch(p, diff):
                add("patch", "patches", ",".join(patch[0]), {"files": patch[0], "n_hunks": patch[1]}, 0.95 if patch[2] else 0.7, start=start, end=start + len(diff))
        for number, (b, role) in enumerate(zip(blocks, roles, strict=True)):
            if role == "snippet":
                path, function, defines = self.snippet(p, body, b)
                owner = "unscoped" if path is None and function is None else "project_attributed"
                add("snippet", "snippets", hashlib.md5(b[4].encode()).hexdigest(), {"path": path, "function": function, "n_lines": b[4].count("\n") + 1, "defines": defines}, 0.85, owner, b[0], b[1])
                for name in defines:
                    add("symbol", "snippets.defines", name, {"block": number}, 0.85, owner, b[0], b[1])
            elif role == "poc":
                kind, entry = self.poc(p, b)
                add("poc", "pocs", kind if entry is None else entry, {"poc_kind": kind}, 0.85, "reporter_artifact", b[0], b[1])
        for number, trace in enumerate(found, 1):
            said = {"format": trace["format"], "bug_type": trace["bug_type"], "frames": len(trace["frames"]) or None}
            add("trace", "traces", f"{trace['format']}:{trace['bug_type']}:{number}", said, 0.95, "unscoped")
        return out

    # ---- traces ------------------------------------------------------------------------------------------------------

    def traces(self, p: Patterns, body: str) -> list[dict]:
        """format, bug_type and frames (stack_no, index, function, path, is_runtime) of each trace."""
        if not any(sign in body for sign in _TRACE_SIGNS):
            return []
        lines = body.split("\n")
        if lines[-1] == "":
            lines.pop()
        out: list[dict] = []
        starts = list(itertools.accumulate((len(x) + 1 for x in lines), initial=0))
        signed = {bisect.bisect_right(starts, at) - 1 for sign in _TRACE_SIGNS for at in _places(body, sign)}
        for i in range(min(signed), len(lines)):
            line, after = lines[i], lines[i + 1] if i + 1 < len(lines) else None
            begun = None
            if i in signed:
                begun = next(((name, m) for name, pattern in p.headers if (m := pattern.search(line)) and (name != "node" or (after is not None and p.at.search(after)))), None)
            if begun:
                out.append({"format": begun[0], "bug_type": (begun[1][1] or "").strip(" "), "frames": [], "stack": 0, "rows": {}})
                continue
            if not out:
                continue
            now = out[-1]
            format_ = now["format"]
            if not (format_ == "go" and line.startswith("goroutine ")) and any(pattern.search(line) for _, pattern in p.trace_labels):
                now["stack"] += 1
            frame = self.frame(p, format_, line, after)
            if frame is not None:
                rows = now["rows"].setdefault(now["stack"], [])
                rows.append(frame)
                now["frames"].append((now["stack"], len(rows) - 1, *frame))
        for now in out:
            if now["format"] == "python":
                # this format names the last call last
                now["frames"] = [(stack, len(now["rows"][stack]) - 1 - index, *rest) for stack, index, *rest in now["frames"]]
        return out

    def frame(self, p: Patterns, format_: str, line: str, after: str | None) -> tuple[str | None, str | None, bool] | None:
        for pattern, groups in p.frames["native" if format_ in traces.NATIVE_FORMATS else format_]:
            m = pattern.search(line)
            if not m or (format_ == "go" and not (after is not None and p.next_line["go"].search(after))):
                continue
            function, path = ((m[k] or None) if k else None for k in groups[1:3])
            if format_ in p.next_line:
                path = _extract(p.next_line[format_], after or "") or None
            runtime = bool(function and p.runtime.search(function)) or bool(path and p.runtime_path.search(path))
            return function, path, runtime
        return None

    def told(self, p: Patterns, found: list[dict]) -> tuple[set[str], set[str]]:
        """Names of the program's functions in traces, and functions and files of each trace's top frame of the program."""
        named, tops = set(), set()
        for trace in found:
            own = [(stack, index, function, path) for stack, index, function, path, runtime in trace["frames"] if not runtime and function is not None]
            named.update(self.bare_function(p, f) for _, _, f, _ in own)
            first = min(((index, function, path) for stack, index, function, path in own if stack == 0 and path is not None and self.owner(p, path) != "third_party" and not p.shared.search(path.lower())), default=None)
            if first:
                tops |= {self.bare_function(p, first[1]), p.folder.sub("", first[2])}
        return named, tops

    # ---- a report ----------------------------------------------------------------------------------------------------

    def claims(self, title: str | None, body: str | None) -> list[tuple]:
        """kind, value, extractor, confidence, spans, start, provenance, negated, role, details of a report's claims."""
        if body is None:
            return []
        p = _patterns(not body.isascii() or "\r" in body, tuple(self.names), self.prefixes)
        fenced = list(p.block.finditer(body)) if "```" in body or "~~~" in body or "<!--" in body else []
        text = self.blanked(body, fenced) if fenced else body
        plain = self.without_diffs(p, text)
        found = self.traces(p, body) if self.structured or self.traced else []
        rows = self.mentions(p, plain, title or "")
        if self.structured:
            rows += self.holding(p, body, text, plain, self.blocks(p, body, fenced), found)
        out = self.merged(rows)
        return self.scoped(p, out, *self.told(p, found)) if found and (self.structured or self.traced) else out

    @staticmethod
    def merged(rows: list[tuple]) -> list[tuple]:
        """One claim for each kind and value: its spans in order, the best confidence and its extractor, the project's if one mention is, negated if all are, and a role."""
        groups: dict[tuple[str, str], list[tuple]] = {}
        for row in rows:
            groups.setdefault((row[0], row[2]), []).append(row)
        out = []
        for (kind, value), of in groups.items():
            if len(of) == 1:
                _, extractor, _, start, end, confidence, provenance, negated, core, details = of[0]
                spans = [] if start is None else [(start, end)]
            else:
                # a place that is not known comes first
                first = lambda r: (r[3] is not None, r[3] or 0, r[1])
                confidence = max(r[5] for r in of)
                extractor = min(of, key=lambda r: (-r[5], *first(r)))[1]
                spans = sorted({(r[3], r[4]) for r in of if r[3] is not None})
                start = spans[0][0] if spans else None
                provenance = min((r[6] for r in of), key=lambda x: _RANK.get(x, 3))
                negated, core, details = all(r[7] for r in of), any(r[8] for r in of), min(of, key=first)[9]
            outer = kind in ("reference", "impact") or (kind == "symbol" and provenance == "third_party")
            out.append((kind, value, extractor, confidence, spans, start, provenance, negated, "peripheral" if outer else "core" if core and not negated else "supporting", details))
        return out

    def scoped(self, p: Patterns, rows: list[tuple], named: set[str], tops: set[str]) -> list[tuple]:
        """Claims with what traces say of them."""
        out = []
        for kind, value, extractor, confidence, spans, start, provenance, negated, role, details in rows:
            name = self.bare_function(p, value) if kind == "symbol" else p.folder.sub("", value) if kind == "file" else None
            if name is not None:
                provenance = "project_attributed" if kind == "symbol" and provenance == "unscoped" and name in named else provenance
                role = "core" if role == "supporting" and not negated and name in tops else role
            out.append((kind, value, extractor, confidence, spans, start, provenance, negated, role, details))
        return out


def _is_day(day: str) -> bool:
    try:
        datetime.date.fromisoformat(day)
    except ValueError:
        return False
    return True


def _macro_end(p: Patterns, text: str, at: int, then: re.Pattern) -> int | None:
    """Where a macro that begins here ends, if what must follow does: the longest reading first, as the pattern's own alternatives give way."""
    m = p.macro.match(text, at)
    while m:
        if then.match(text, m.end()):
            return m.end()
        m = p.macro.match(text, at, m.end() - 1) if m.end() - at > 3 else None
    return None


def _openings(lines: list[str]) -> list[str]:
    """For each line the first brace or semicolon from it on; empty if there is none."""
    out, found = [], ""
    for line in reversed(lines):
        m = re.search("[{;]", line)
        found = m[0] if m else found
        out.append(found)
    return out[::-1]


def _places(text: str, word: str) -> Iterator[int]:
    at = text.find(word)
    while at >= 0:
        yield at
        at = text.find(word, at + 1)


#: Reports whose claims are given on at once.
AT_ONCE = 2_000


def claims_of(reader: Reader):
    """For mapInArrow over report_id, title, body (and further columns, which stay): with an array of each report's claims."""
    place = pa.struct([("start", pa.int32()), ("end", pa.int32())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, AT_ONCE):
                batch = whole.slice(at, AT_ONCE)
                found = [reader.claims(t, b) for t, b in zip(batch["title"].to_pylist(), batch["body"].to_pylist(), strict=True)]
                columns = list(zip(*[row for rows in found for row in rows], strict=True)) or [()] * 10
                spans = [s for x in columns[4] for s in x]
                placed = pa.ListArray.from_arrays(pa.array(_offsets(columns[4]), pa.int32()), pa.StructArray.from_arrays([pa.array([s for s, _ in spans], pa.int32()), pa.array([e for _, e in spans], pa.int32())], fields=list(place)))
                types = (pa.string(), pa.string(), pa.string(), pa.float64(), None, pa.int32(), pa.string(), pa.bool_(), pa.string(), pa.string())
                arrays = [placed if t is None else pa.array(x, t) for x, t in zip(columns, types, strict=True)]
                struct = pa.StructArray.from_arrays(arrays, names=["kind", "value", "extractor", "confidence", "spans", "start", "provenance", "negated", "role", "details"])
                kept = [n for n in batch.schema.names if n not in ("title", "body")]
                yield pa.RecordBatch.from_arrays([*[batch[n] for n in kept], pa.ListArray.from_arrays(pa.array(_offsets(found), pa.int32()), struct)], names=[*kept, "claims"])

    return read


def _offsets(lists: Iterable) -> list[int]:
    out = [0]
    for x in lists:
        out.append(out[-1] + len(x))
    return out
