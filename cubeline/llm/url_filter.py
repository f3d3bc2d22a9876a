"""URL rules in a trie over reversed host labels and path segments.

A rule names a host and the start of a path, such as ``example.com/en/``. It
fits the host and all its subdomains, for urls whose path starts with the rule's.
The trie is built once and broadcast with the function (its size is that of the
rules, which is checked); a url walks its host labels from the last and then its
path segments, and the deepest rule on the way wins, whatever it says. Within a
segment only the lengths at which a rule ends are looked up, so a url costs no more
than its own length and that of the rules on its way.

Defined cases: a null url, or one without ``://``, has an empty host and path and
gets the default verdict; so does a url that no rule fits. Of two equal rules
``block`` wins. Repeated rows stay; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import long_id

#: Rules are broadcast with the function; more text than this is refused.
MOST_RULE_CHARS = 64_000_000
_ASCII_LOWER = {k: k + 32 for k in range(65, 91)}


@dataclass
class _Node:
    labels: dict = field(default_factory=dict)
    segments: dict = field(default_factory=dict)
    parts: dict = field(default_factory=dict)  # starts of a segment that end a rule
    lengths: list = field(default_factory=list)  # of the parts, longest first


class RuleTrie:
    def __init__(self, rules: list[tuple[str, str]]):
        """rules: (verdict, host + path), the path starting with a slash."""
        if sum(len(r) for _, r in rules) > MOST_RULE_CHARS:
            raise ValueError("the rules are too large to broadcast")
        self.root = _Node()
        for verdict, rule in sorted(rules):
            if verdict not in ("allow", "block") or "/" not in rule:
                raise ValueError(f"not a rule: {verdict} {rule}")
            host, _, path = rule.partition("/")
            node = self.root
            for label in reversed(host.translate(_ASCII_LOWER).split(".")):
                node = node.labels.setdefault(label, _Node())
            *whole, part = path.split("/")
            for segment in whole:
                node = node.segments.setdefault(segment, _Node())
            node.parts[part] = (rule, verdict)
            if len(part) not in node.lengths:
                node.lengths = sorted([*node.lengths, len(part)], reverse=True)

    def _path(self, node: _Node, path: str):
        best = None
        if not path.startswith("/"):
            return best
        at = 1
        while True:
            stop = path.find("/", at)
            segment = path[at : stop if stop >= 0 else len(path)]
            best = next((node.parts[segment[:k]] for k in node.lengths if k <= len(segment) and segment[:k] in node.parts), best)
            if stop < 0 or segment not in node.segments:
                return best
            node, at = node.segments[segment], stop + 1

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest rule that fits: more host first, then more path."""
        node, best = self.root, None
        for label in reversed(host.split(".")):
            node = node.labels.get(label)
            if node is None:
                break
            best = self._path(node, path) or best
        return best


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path; both empty without a scheme mark."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    cut = min((k for k in map(rest.find, "?#") if k >= 0), default=len(rest))
    host, slash, path = rest[:cut].partition("/")
    return host.translate(_ASCII_LOWER), slash + path


def _judged(trie: RuleTrie, default: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            split = [split_url(u) for u in batch.column(1).to_pylist()]
            found = [trie.find(*s) or (None, default) for s in split]
            columns = [[s[0] for s in split], [s[1] for s in split], [f[0] for f in found], [f[1] for f in found]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.string()) for c in columns)], names=["page_id", "host", "path", "rule", "verdict"])

    return rows


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], page_id: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict), a row for each page."""
    rows = pages.select(long_id(page_id).alias("id"), F.col(f"`{url}`").alias("u"))
    return rows.mapInArrow(_judged(RuleTrie(rules), default), "page_id long, host string, path string, rule string, verdict string")
