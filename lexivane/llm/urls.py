"""URL filters: a trie over reversed host labels and path segments; the longest rule that fits decides."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, fresh

#: Most bytes of a trie that is broadcast, and about so many for each of its nodes, held once by each Python worker.
TRIE_BYTES, NODE_BYTES = 128 << 20, 700
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a URL; both empty without a `://`."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = min((k for k in map(rest.find, "/?#") if k >= 0), default=len(rest))
    path = rest[end:]
    stop = min((k for k in map(path.find, "?#") if k >= 0), default=len(path))
    return rest[:end].translate(_LOWER), path[:stop]


class Node:
    """A label or segment: its children, the path trie below a host, and the rules that end here by their last, open piece."""

    __slots__ = ("below", "ends", "paths")

    def __init__(self) -> None:
        self.below: dict[str, Node] = {}
        self.paths: Node | None = None
        self.ends: dict[str, tuple[str, str]] = {}


class UrlTrie:
    """Rules (action, host, path): a rule fits its host and all subdomains where the URL's path starts with its own."""

    def __init__(self, rules: Iterable[tuple[str, str, str]]) -> None:
        self.root, self.nodes, self.chars = Node(), 1, 0
        for action, host, path in rules:
            if action not in ("allow", "block"):
                raise ValueError(f"a rule allows or blocks: {action!r}")
            node = self.root
            for label in reversed(host.translate(_LOWER).split(".")):
                node = self._child(node, label)
            if node.paths is None:
                node.paths, self.nodes = Node(), self.nodes + 1
            *whole, tail = path.split("/")
            at = node.paths
            for segment in whole:
                at = self._child(at, segment)
            # Of equal rules with different actions, block holds whatever the order.
            if at.ends.get(tail, ("", ""))[1] != "block":
                at.ends[tail] = (host + path, action)
            self.chars += len(host) + len(path)

    def _child(self, node: Node, key: str) -> Node:
        if key not in node.below:
            node.below[key], self.nodes, self.chars = Node(), self.nodes + 1, self.chars + len(key)
        return node.below[key]

    @property
    def bytes(self) -> int:
        """About what the trie takes in memory."""
        return NODE_BYTES * self.nodes + 4 * self.chars

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, action) of the longest rule that fits; of equally long ones, the one with the longer host."""
        best: tuple[str, str] | None = None
        node = self.root
        pieces = path.split("/")
        for label in reversed(host.split(".")):
            node = node.below.get(label)
            if node is None:
                break
            at = node.paths
            for k, piece in enumerate(pieces):
                if at is None:
                    break
                if at.ends:
                    rest = "/".join(pieces[k:])
                    for tail, end in at.ends.items():
                        if rest.startswith(tail) and (best is None or len(end[0]) >= len(best[0])):
                            best = end
                at = at.below.get(piece) if k < len(pieces) - 1 else None
        return best


def filter_urls(df: DataFrame, rules: Iterable[tuple[str, str, str]] | DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """`df` with host, path, rule and verdict of each URL; `default` is the verdict where no rule fits.

    `rules` are tuples or rows (action, host, path). As a trie of TRIE_BYTES at most they are broadcast; more rules stay
    a table, and the steps down the trie become joins on host and whole path segments. A null URL, or one without
    `://`, has an empty host and path. Columns of `df` with these four names are replaced, others pass through whatever
    their names; repeated rows keep their rows; of equal rules, block holds; an empty table and no rules need no
    special case. A very long URL is one string in memory.
    """
    made = ("host", "path", "rule", "verdict")
    own = [c for c in df.columns if c.lower() not in made]
    if isinstance(rules, DataFrame):
        chars = rules.agg(F.count("*"), F.sum(F.length(rules.columns[1]) + F.length(rules.columns[2]))).first()
        few = NODE_BYTES * chars[0] + 4 * (chars[1] or 0) <= TRIE_BYTES  # a rule has a node at least
        trie = UrlTrie(tuple(r) for r in rules.collect()) if few else None
    else:
        rules = list(rules)
        trie = UrlTrie(rules) if NODE_BYTES * len(rules) <= TRIE_BYTES else None
    if trie is None or trie.bytes > TRIE_BYTES:
        table = rules if isinstance(rules, DataFrame) else df.sparkSession.createDataFrame(rules, "action string, host string, path string")
        return _joined(df, table.toDF("action", "host", "path"), url_col, default, own)
    shared = df.sparkSession.sparkContext.broadcast(trie)
    (found,) = fresh(df, "found")

    def judge(urls: pd.Series) -> pd.DataFrame:
        rows = []
        for url in urls:
            host, path = split_url(url)
            rows.append((host, path, *(shared.value.find(host, path) or (None, default))))
        return pd.DataFrame(rows, columns=list(made), dtype=object)

    judged = F.pandas_udf(judge, ", ".join(f"{c} string" for c in made))
    return df.select(*own, judged(F.col(url_col).cast("string")).alias(found)).select(*own, *(F.col(f"{found}.{c}") for c in made))


def _joined(df: DataFrame, rules: DataFrame, url_col: str, default: str, own: list[str]) -> DataFrame:
    """`filter_urls` for rules that no task can hold: a URL meets the rules of each of its host's suffixes and path's whole segments."""
    row, host, path = fresh(df, "row", "host", "path")
    rest = F.when(F.instr(url_col, "://") > 0, F.expr(f"substring(`{url_col}`, instr(`{url_col}`, '://') + 3)")).otherwise("")
    upper = "".join(chr(k) for k in _LOWER)
    d = df.withColumn(row, F.monotonically_increasing_id()).withColumn(host, F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), upper, upper.lower()))
    d = checkpoint(d.withColumn(path, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)))
    labels, pieces = F.split("host", r"\.", -1), F.split("path", "/", -1)
    urls = d.select(F.col(row).alias("row"), F.col(host).alias("host"), F.col(path).alias("path"))
    steps = urls.select("row", "path", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))).alias("on"))
    steps = steps.select("row", "on", F.explode(F.transform(F.sequence(F.lit(0), F.size(pieces) - 1), lambda k: F.struct(F.array_join(F.slice(pieces, 1, k), "/").alias("whole"), k.alias("k"), F.array_join(F.slice(pieces, k + 1, F.size(pieces)), "/").alias("rest")))).alias("x")).select("row", "on", "x.*")
    parts = F.split("path", "/", -1)
    ends = rules.select("action", F.translate("host", upper, upper.lower()).alias("on"), F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/").alias("whole"), (F.size(parts) - 1).alias("k"), F.element_at(parts, -1).alias("tail"), F.concat("host", "path").alias("rule"))
    fits = steps.join(ends, ["on", "whole", "k"]).where(F.startswith(F.col("rest"), F.col("tail")))
    order = F.struct(F.length("rule"), F.length("on"), F.col("action") == "block")
    best = fits.groupBy("row").agg(F.max_by(F.struct("rule", "action"), order).alias("best")).withColumnRenamed("row", "of")
    d = d.join(best, d[row] == best["of"], "left")
    return d.select(*own, F.col(host).alias("host"), F.col(path).alias("path"), F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"))


#: Rules of the registered query: fixed values of its contract.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

_FITS = " union all ".join(f"select '{h}{p}' as rule, '{a}' as verdict, '{h}' as rh, '{p}' as rp" for a, h, p in RULES)
#: SQL over `pages` with the same result as the query.
SQL = rf"""
with u as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
h as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u),
rules as ({_FITS}),
best as (select h.page_id, rule, verdict from h join rules on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp) qualify row_number() over (partition by h.page_id order by length(rule) desc) = 1)
select h.page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from h left join best using (page_id)
"""
