"""Secret scans by assignment-aware lexing.

Source and configuration lines are lexed into pairs of a target name and its literal: ``name = "x"``,
``name: x``, ``"name": "x"``, ``name := x``, ``name => x``, ``name: type = "x"``, with
``export``/``const``/``let`` in front and strings joined by ``+``; names, blanks and literals of any length. A
right side that is another name takes that name's literal from above (constant propagation), and the
literal's own place is reported. A literal scores by how sensitive its target name is and by how random
it looks; one with blanks by its longest part without any (whole, if the name speaks of a phrase);
placeholders score nothing. A bare value without a digit counts only after ``=``, ``:=`` or ``=>``, or
where it mixes kinds of letters: after a colon it is most often prose. Three plain kinds of pattern stand
beside the lexer and their spans always stay.

Spans are in code points, end exclusive. One narrow pass, no shuffle; whole texts.

Cases: null and empty texts have no spans; very long texts take time in proportion to their length
(each pattern is matched left to right once); repeated rows are scanned each; other columns pass
through, columns named like the added ones are replaced.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexagrove.llm.common import sets_aside, text_or_empty

KINDS = ("assign", "access", "hex", "lexed")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # the same as runs of any length with those under 16 dropped
NAME = r"[A-Za-z_][\w.\-]*+"
#: A target, an optional type, an operator. Possessive runs of any length: each is read once, so the
#: lexer stays linear.
TYPE = r"(?:[ \t]*+:[ \t]*+[A-Za-z_][\w.<>\[\]|?]*+(?=[ \t]*+=(?![=>])))?+"
PAIR = re.compile(rf"""(?<![\w.\-])["']?({NAME})["']?{TYPE}[ \t]*+(:=|=>|[:=])[ \t]*+""", re.A)
STRING = re.compile(r'"((?:[^"\\\n]++|\\.)*+)"|\'((?:[^\'\\\n]++|\\.)*+)\'|`((?:[^`\\\n]++|\\.)*+)`', re.A)
BARE = re.compile(r"[^\s\"'`,;(){}\[\]]++", re.A)
PLUS = re.compile(r"[ \t]*+\+[ \t]*+", re.A)
REFERENCE = re.compile(rf"\$?\{{?({NAME})\}}?", re.A)
#: Parts of target names and how sensitive they are (fixed values of this scanner).
SENSITIVE = {"password": 3, "passwd": 3, "pwd": 3, "passphrase": 3, "mnemonic": 3, "secret": 3, "apikey": 3, "token": 3, "privatekey": 3, "accesskey": 3, "credential": 2, "credentials": 2, "auth": 2, "bearer": 2, "pass": 2, "signature": 1, "salt": 1, "key": 1}
PHRASES = {"passphrase", "mnemonic"}
PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|none|null|nil|true|false|todo|tbd|changeme|(?:example|your|my|test|dummy|sample)(?:[^A-Za-z0-9][A-Za-z _.\-]*)?|<.*>|\$\{?.*|%.*%|\{\{.*)$", re.A)


def words_in(name: str) -> set[str]:
    """The words of a name, alone and in neighbouring pairs."""
    words = [w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+|\d+", name)]
    return {*words, *(a + b for a, b in zip(words, words[1:]))}


def sensitivity(name: str) -> int:
    """The most sensitive part of a name."""
    return max((SENSITIVE.get(w, 0) for w in words_in(name)), default=0)


def randomness(literal: str) -> float:
    """Bits a character, and one more for each further kind of character in use."""
    n = len(literal)
    bits = -sum(c / n * math.log2(c / n) for c in Counter(literal).values())
    kinds = sum(bool(re.search(p, literal)) for p in ("[a-z]", "[A-Z]", "[0-9]", r"[^A-Za-z0-9\s]"))
    return bits + kinds - 1


def scored(name: str, literal: str) -> float:
    parts = literal.split()
    if len(parts) > 1:
        literal = "".join(parts) if PHRASES & words_in(name) else max(parts, key=len)
    if len(literal) < 8 or PLACEHOLDER.match(literal):
        return 0.0
    return sensitivity(name) * randomness(literal) * min(1.0, len(literal) / 12)


class Run:
    """A run without quotes or white space: where it stops, ends without closing marks, and last has a digit, a
    lower-case and an upper-case letter."""

    def __init__(self, found: re.Match | None = None):
        self.stop = self.end = self.digit = self.lower = self.upper = -1
        if found:
            start, whole = found.start(), found[0]
            self.stop, self.end = found.end(), start + len(whole.rstrip(".:"))
            last = {kind: max((m.start() for m in re.finditer(kind, whole[: self.end - start])), default=-1 - start) for kind in (r"\d", "[a-z]", "[A-Z]")}
            self.digit, self.lower, self.upper = (start + at for at in last.values())


def lexed_pairs(text: str) -> Iterator[tuple[str, str, int, int]]:
    """(target name, literal, start, end), with names on the right side replaced by their literals."""
    known: dict[str, tuple[str, int, int]] = {}
    at, run = 0, Run()
    while found := PAIR.search(text, at):
        name, operator, at = found[1], found[2], found.end()
        if m := STRING.match(text, at):
            group = m.lastindex
            literal, start, end, at = m[group], m.start(group), m.end(group), m.end()
            parts = [literal]
            while (p := PLUS.match(text, at)) and (m := STRING.match(text, p.end())):
                parts.append(m[m.lastindex])
                end, at = m.end(m.lastindex), m.end()
            literal = "".join(parts)
        elif at < run.stop or (m := BARE.match(text, at)):
            # A run without quotes may hold many names: what is asked of its rest is kept for all of them.
            run = run if at < run.stop else Run(m)
            start, end = at, max(at, run.end)
            if (r := REFERENCE.fullmatch(text, start, end)) and r[1] in known:
                literal, start, end = known[r[1]]
            elif text[run.stop : run.stop + 1] == "(":
                continue  # a call
            elif run.digit < start and operator == ":" and not (run.lower >= start and run.upper > start):
                continue  # prose
            else:
                literal, at = text[start:end], run.stop
        else:
            continue
        known[name] = (literal, start, end)
        yield name, literal, start, end


def scan(text: str, least: float = 9.0) -> list[tuple[str, int, int]]:
    """All spans of a text, ordered by start and then kind."""
    if not text:
        return []
    spans = [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18] if "AKIA" in text else []
    spans += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    if "=" in text or ":" in text:
        spans += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
        spans += {("lexed", start, end) for name, literal, start, end in lexed_pairs(text) if scored(name, literal) >= least}
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


@sets_aside
def scan_secrets(docs: DataFrame, text: str = "text", least: float = 9.0) -> DataFrame:
    """``docs`` with the counts of the three plain kinds, the digest of their spans, and all spans."""

    @F.pandas_udf("n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
    def scanned(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts.tolist():
            spans = scan(t, least)
            base = [s for s in spans if s[0] != "lexed"]
            kinds = Counter(s[0] for s in base)
            rows.append((kinds["assign"], kinds["access"], kinds["hex"], hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
        return pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    added = ("n_assign", "n_access", "n_hex", "base_sha256", "spans")
    keep = [F.col(f"`{c}`") for c in docs.columns if c not in added]
    found = docs.select(*keep, scanned(text_or_empty(text)).alias("__found"))
    return found.select(*keep, *(F.col(f"__found.{c}").alias(c) for c in added))
