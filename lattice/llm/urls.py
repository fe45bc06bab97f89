"""URL filters: the longest rule that fits decides.

Rules (verdict, host, path prefix) make a trie over reversed host labels whose nodes hold tries over path segments. It is
broadcast when the rules are at most ``RULE_BYTES``; beyond that, each url's possible keys are joined with the rules instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattice.llm.words import map_docs

#: Most bytes of rules that a broadcast trie may be built from.
RULE_BYTES = 1 << 26

Rule = tuple[str, str, str]
# Fixed values: (verdict, host, path).
RULES: tuple[Rule, ...] = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or without ``://``."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    ends = [at for c in "?#" if (at := rest.find(c)) >= 0]
    host, slash, path = rest[: min(ends, default=len(rest))].partition("/")
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), slash + path


class Trie:
    """Rules by reversed host labels, then by whole path segments; the last segment of a rule is a prefix."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.root: dict = {}
        for verdict, host, path in rules:
            if not path.startswith("/"):
                raise ValueError(f"a rule's path starts with a slash: {path!r}")
            node = self.root
            for label in reversed(host.split(".")):
                node = node.setdefault("labels", {}).setdefault(label, {})
            node = node.setdefault("path", {})
            *whole, last = path[1:].split("/")
            for segment in whole:
                node = node.setdefault("segments", {}).setdefault(segment, {})
            node.setdefault("ends", []).append((last, (len(host) + len(path), verdict, host + path)))

    def find(self, host: str, path: str) -> tuple[int, str, str] | None:
        """The longest rule that fits; of equally long ones, block before allow, then the largest text."""
        best, node = None, self.root
        segments = path[1:].split("/") if path.startswith("/") else []
        for label in reversed(host.split(".")):
            node = node.get("labels", {}).get(label)
            if node is None:
                break
            at = node.get("path")
            for segment in segments:
                if at is None:
                    break
                for prefix, rule in at.get("ends", ()):
                    if segment.startswith(prefix) and (best is None or _rank(rule) > _rank(best)):
                        best = rule
                at = at.get("segments", {}).get(segment)
        return best


def _rank(rule: tuple[int, str, str]) -> tuple:
    return rule[0], rule[1] == "block", rule[2]


def filter_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, default: str = "allow", id_col: str = "page_id", url_col: str = "url", rule_bytes: int = RULE_BYTES) -> DataFrame:
    """(page_id, host, path, rule, verdict): a row for each row of ``pages``.

    A rule fits its host and all subdomains of it when the path starts with the rule's. Where none fits, rule is null and the
    verdict is ``default``. A null url, or one without ``://``, has an empty host and path. Very long urls are
    read whole. Repeated rows are rows of their own, ids may be null. Other columns are ignored; an empty table gives no rows.
    """
    if sum(len(h) + len(p) for _, h, p in rules) > rule_bytes:
        return _by_join(pages, rules, default, id_col, url_col)
    trie = pages.sparkSession.sparkContext.broadcast(Trie(rules))

    def each(page: int | None, url: str | None) -> tuple:
        host, path = split_url(url)
        rule = trie.value.find(host, path)
        return page, host, path, rule and rule[2], rule[1] if rule else default

    return map_docs(pages, [F.col(id_col).cast("long"), F.col(url_col).cast("string")], "page_id long, host string, path string, rule string, verdict string", each)


def _by_join(pages: DataFrame, rules: tuple[Rule, ...], default: str, id_col: str, url_col: str) -> DataFrame:
    """The same by a shuffled join of (host suffix, whole segments) keys, for rules too many to broadcast."""
    spark = pages.sparkSession
    rest = F.regexp_extract(F.coalesce(F.col(url_col).cast("string"), F.lit("")), r"(?s)^.*?://([^?#]*)", 1)
    host = F.translate(F.regexp_extract(rest, r"^([^/]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    parsed = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), F.regexp_extract(rest, r"(?s)^[^/]*(/.*)?$", 1).alias("path"))
    distinct = parsed.select("host", "path").distinct()
    labels, deep = max(h.count(".") + 1 for _, h, _ in rules), max(p.count("/") for _, _, p in rules)  # no rule is longer, so no key need be
    suffixes = F.expr(f"transform(sequence(1, least({labels}, size(split(host, '[.]')))), i -> substring_index(host, '.', -i))")
    heads = F.expr(f"transform(sequence(1, least({deep}, size(split(path, '/', {deep + 2})) - 1)), i -> concat(substring_index(path, '/', i), '/'))")
    keys = distinct.filter("path like '/%'").select("host", "path", F.explode(suffixes).alias("rule_host")).select("*", F.explode(heads).alias("head"))
    table = spark.createDataFrame([(v, h, p, p[: p.rindex("/") + 1], len(h) + len(p)) for v, h, p in rules], "rule_verdict string, rule_host string, rule_path string, head string, length int")
    best = keys.join(table, ["rule_host", "head"]).filter(F.col("path").startswith(F.col("rule_path")))
    order = F.struct("length", (F.col("rule_verdict") == "block").alias("blocks"), F.concat("rule_host", "rule_path").alias("rule"), "rule_verdict")
    best = best.groupBy("host", "path").agg(F.max(order).alias("best"))
    return parsed.join(best, ["host", "path"], "left").select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"))
