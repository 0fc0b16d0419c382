"""URL filters: glob rules packed into multiword Shift-And masks.

All rules run at once over each canonical URL. A rule's literal parts occupy neighbouring bits of
one row of 64-bit words; per character the whole state is shifted by one bit with a carry between
words and masked with the character's row of the table; `*` is a bit that, once reached, stays.
The state of a batch is a matrix of URLs by words, so each step is a few vectorised operations.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """`action` (allow or block) for what `glob` matches; `name` is reported; longer `name`s win.

    Globs see `.host#path`: neither part can hold a `#`, so it keeps them apart.
    """

    name: str
    glob: str
    action: str


def host_rule(name: str, action: str) -> Rule:
    """`example.net/en/`: the host and its subdomains, paths that start with `/en/`."""
    host, _, path = name.partition("/")
    return Rule(name, f"*.{host}#/{path}*", action)


#: The four host rules of the query, as the task states them.
HOST_RULES = (
    host_rule("net/", "block"),
    host_rule("example.net/en/", "allow"),
    host_rule("example.com/de/", "block"),
    host_rule("org/fr/", "allow"),
)
#: Production fallback, for URLs without a host rule: words of unwanted hosts, bounded by a dot, a hyphen or the path.
#: Callers give their own list, or a table of rules by rules_from().
HOST_WORDS = ("ads-track", "adult-x", "casino", "cheap-pills", "free-bets", "spam-farm")
WORD_RULES = tuple(Rule(f"word:{w}", f"*.{w}{tail}*#*", "block") for w in HOST_WORDS for tail in (".", "-"))


#: Rules that rules_from() takes at most, and 64-bit words of automaton state that a step works on.
MOST_RULES, STATE_WORDS = 100_000, 1 << 17


def rules_from(table: DataFrame) -> tuple[Rule, ...]:
    """Rules from a table (name, glob, action), in order of name and glob; more than MOST_RULES are refused, rows with a null are left out."""
    rows = table.select("name", "glob", "action").dropna().distinct().orderBy("name", "glob", "action").limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    return tuple(Rule(*r) for r in rows)


class ShiftAnd:
    """Glob rules (`*` any run, `?` one character, others literal), all simulated together.

    Each rule has a start bit that is always on, one bit for each literal, and a sticky bit where
    a `*` stands; a match is the last bit on after the last character.
    """

    def __init__(self, globs: list[str]):
        self.start, self.accept, self.sticky, self.need = [], [], [], []
        bit = 0
        for glob in globs:
            stars, literals = [glob.startswith("*")], []
            for c in glob:
                if c == "*":
                    stars[-1] = True
                else:
                    literals.append(c)
                    stars.append(False)
            self.start.append(bit)
            self.sticky += [bit + k for k, on in enumerate(stars) if on]
            self.need += [(bit + k + 1, c) for k, c in enumerate(literals)]
            self.accept.append(bit + len(literals))
            bit += len(literals) + 1
        self.words = max(1, -(-bit // 64))
        self.first, self.stay = self._mask(self.start), self._mask(self.sticky)
        chars = sorted({c for _, c in self.need if c != "?"})
        any_one = self._mask([b for b, c in self.need if c == "?"])
        self.row = {c: k + 1 for k, c in enumerate(chars)}
        self.table = np.zeros((len(chars) + 1, self.words), np.uint64) | any_one
        for b, c in self.need:
            if c != "?":
                self.table[self.row[c], b // 64] |= np.uint64(1 << (b % 64))

    def _mask(self, bits: list[int]) -> np.ndarray:
        out = np.zeros(self.words, np.uint64)
        for b in bits:
            out[b // 64] |= np.uint64(1 << (b % 64))
        return out

    def match(self, texts: list[str]) -> np.ndarray:
        """Booleans, texts by rules; so many texts at a time that their state stays small."""
        rows = max(1, STATE_WORDS // self.words)
        parts = [self._match(texts[k : k + rows]) for k in range(0, len(texts), rows)]
        return np.concatenate([np.zeros((0, len(self.accept)), bool), *parts])

    def _match(self, texts: list[str]) -> np.ndarray:
        lengths = np.array([len(t) for t in texts])
        order = np.argsort(-lengths, kind="stable")
        flat = np.array([self.row.get(c, 0) for k in order for c in texts[k]], np.int32)
        begin = np.concatenate(([0], np.cumsum(lengths[order])[:-1]))
        state = np.broadcast_to(self.first, (len(texts), self.words)).copy()
        one, top = np.uint64(1), np.uint64(63)
        for pos in range(int(lengths.max())):
            live = int(np.searchsorted(-lengths[order], -pos, side="left"))  # longest first: a prefix is still running
            now = state[:live]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> top
            state[:live] = (moved & self.table[flat[begin[:live] + pos]]) | (now & self.stay)
        out = np.empty((len(texts), len(self.accept)), bool)
        bits = np.array(self.accept, np.int64)
        out[order] = (state[:, bits // 64] >> (bits % 64).astype(np.uint64)) & one != 0
        return out


def canonical_parts(url: str):
    """SQL columns host and path of a URL column, as the docstring of judge_urls says."""
    rest = f"case when locate('://', {url}) > 0 then substring({url}, locate('://', {url}) + 3) else '' end"
    host = f"regexp_extract({rest}, '^([^/?#]*)', 1)"
    path = f"regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1)"
    return F.expr(f"translate({host}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"), F.expr(path)


def judge_urls(pages: DataFrame, rules=HOST_RULES, fallback=WORD_RULES, key: str = "page_id", url: str = "url") -> DataFrame:
    """One row per page: key, host, path, rule, verdict, word_rule.

    Host is what follows the first `://` up to `/`, `?`, `#` or the end, A-Z lowered; path runs on
    to `?`, `#` or the end; a null URL or one without `://` has both empty and is allowed. The
    longest matching rule decides; without one, a page is blocked if a fallback rule matches. Ties
    in length go to the rule listed first. Repeated rows give repeated rows; an empty table gives
    none; other columns are ignored.
    """
    rules, fallback = tuple(rules), tuple(fallback)
    order = sorted(range(len(rules)), key=lambda k: (-len(rules[k].name), k))
    ranked = [rules[k] for k in order]
    globs = [r.glob for r in ranked] + [r.glob for r in fallback]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ShiftAnd(globs)
        for batch in batches:
            host, path = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            hit = automaton.match([f".{h}#{p}" if h else "" for h, p in zip(host, path)])
            name, verdict, word = [], [], []
            own, rest = hit[:, : len(ranked)], hit[:, len(ranked) :]
            first = [(int(a.argmax()) if a.any() else None, int(b.argmax()) if b.any() else None) for a, b in zip(own, rest)]
            for k, w in first:
                w = None if w is None else fallback[w]
                name.append(None if k is None else ranked[k].name)
                word.append(w and w.name)
                verdict.append(ranked[k].action if k is not None else w.action if w else "allow")
            columns = [batch.column(0), batch.column(1), batch.column(2), pa.array(name, pa.string()), pa.array(verdict, pa.string()), pa.array(word, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "host", "path", "rule", "verdict", "word_rule"])

    host, path = canonical_parts(f"`{url}`")
    parts = pages.select(F.col(key), F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))
    kind = parts.schema[key].dataType.simpleString()
    return parts.mapInArrow(run, f"`{key}` {kind}, host string, path string, rule string, verdict string, word_rule string")
