"""URL filters: allow and block entries in a trie over reversed host labels and path segments; the longest match decides."""

from __future__ import annotations

import logging
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ALLOW, BLOCK = "allow", "block"
RULES = "host string, path string, verdict string"
#: Entries, and characters in all of them, up to which the trie is broadcast; longer lists are joined by key.
BROADCAST_RULES, BROADCAST_CHARS = 200_000, 16_000_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_log = logging.getLogger(__name__)


def url_host(url: Column | str) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or no ``://``."""
    value = F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit(""))
    return F.translate(F.regexp_extract(value, "^(?s:.*?)://([^/?#]*)", 1), _UPPER, _LOWER)


def url_path(url: Column | str) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty for null or no ``://``."""
    value = F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit(""))
    return F.regexp_extract(value, "^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def rule_table(spark: SparkSession, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    """``host, path, verdict`` of entries that people write."""
    return spark.createDataFrame([tuple(r) for r in rules], RULES)


def _tidy(rules: DataFrame) -> DataFrame:
    """One row for each host and path; of an allow and a block entry the block one."""
    host = F.translate("host", _UPPER, _LOWER)
    found = rules.select(host.alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
    found = found.where(F.col("host").isNotNull() & (F.col("host") != "") & F.col("verdict").isin(ALLOW, BLOCK))
    return found.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # "block" is larger


def url_trie(rules: Iterable[tuple[str, str, str]]) -> dict:
    """Entries by host label from the right, then by path segment from the left.

    A node of the first kind holds the next labels and, under None, the root of the
    paths of entries that end at this host.  An entry's last segment need not be whole:
    it is kept, under None, as a start of a segment at the node of those before it; 0
    holds the length of the longest of these starts.
    """
    root: dict = {}
    for host, path, verdict in rules:
        node = root
        for label in reversed(host.split(".")):
            node = node.setdefault(label, {})
        node = node.setdefault(None, {})
        *whole, last = path.split("/")
        for segment in whole:
            node = node.setdefault(segment, {})
        starts = node.setdefault(None, {0: 0})
        starts[last], starts[0] = (host + path, verdict), max(starts[0], len(last))
    return root


def _longest_path(node: dict, segments: list[str]) -> tuple[str, str] | None:
    found = None
    for segment in segments:
        if starts := node.get(None):
            lengths = range(min(len(segment), starts[0]), -1, -1)
            found = next((starts[segment[:n]] for n in lengths if segment[:n] in starts), found)
        node = node.get(segment)
        if node is None:
            break
    return found


def longest_match(trie: dict, host: str, path: str) -> tuple[str, str] | None:
    """Entry and verdict of the longest host that has a fitting path, and of the longest such path."""
    segments, found = path.split("/"), None
    for label in reversed(host.split(".")):
        trie = trie.get(label)
        if trie is None:
            break
        if None in trie:
            found = _longest_path(trie[None], segments) or found
    return found


def _by_trie(urls: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    shared = urls.sparkSession.sparkContext.broadcast(url_trie(rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [longest_match(shared.value, *pair) for pair in zip(batch["_host"].to_pylist(), batch["_path"].to_pylist())]
            fields = [pa.array([f and f[i] for f in found], pa.string()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *fields], names=[*batch.schema.names, "_rule", "_verdict"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in urls.schema.fields)
    return urls.mapInArrow(run, f"{schema}, _rule string, _verdict string")


def _by_join(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The same by an equi-join of different (host, path) pairs, for lists of any length.

    A pair asks for each of its host's endings and each of its path's beginnings up to
    a ``/``, no deeper than the rules go; the rest of an entry's last segment is compared.
    """
    own = rules.select(
        "host", "path", "verdict", F.regexp_extract("path", "^((?s:.*)/)?", 1).alias("folder"), F.size(F.split("path", "/")).alias("depth"), F.size(F.split("host", "[.]")).alias("labels")
    )
    deepest = own.agg(F.max("depth"), F.max("labels")).first()
    segments, labels = F.slice(F.split("_path", "/"), 1, deepest[0] or 1), F.split("_host", "[.]")
    hosts = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(deepest[1] or 1))), lambda i: F.array_join(F.slice(labels, -i, i), "."))
    folders = F.transform(
        F.sequence(F.lit(0), F.size(segments) - 1), lambda i: F.when(i == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(segments, 1, i), "/"), F.lit("/")))
    )
    pairs = urls.select("_host", "_path").distinct()
    asked = pairs.select("_host", "_path", F.explode(hosts).alias("host"), folders.alias("folders")).select("_host", "_path", "host", F.explode("folders").alias("folder"))
    met = asked.join(own, ["host", "folder"]).where(F.startswith("_path", F.col("path")))
    longest = F.max_by(F.struct(F.concat("host", "path").alias("rule"), "verdict"), F.struct("labels", F.char_length("path")))
    best = met.groupBy("_host", "_path").agg(longest.alias("_best"))
    joined = urls.join(best, ["_host", "_path"], "left")
    return joined.select(*urls.columns, F.col("_best.rule").alias("_rule"), F.col("_best.verdict").alias("_verdict"))


def judge_urls(
    pages: DataFrame, rules: DataFrame, url_column: str = "url", default: str = ALLOW, broadcast_rules: int = BROADCAST_RULES
) -> DataFrame:
    """``pages`` with a struct ``filter``: ``host, path, rule, verdict``.

    ``rules (host, path, verdict)`` fit their host and all its subdomains, if the path
    starts with the rule's (character by character, so ``/de`` fits ``/den`` too).  The
    longest fit decides: first the most host labels, then the longest path; of an
    allow and a block entry of one host and path the block one.  No fit: null rule
    and the verdict ``default``.

    Up to ``broadcast_rules`` entries of at most ``BROADCAST_CHARS`` characters, which is
    counted before they are fetched, become one broadcast trie, and pages are passed
    through once without a shuffle.  Longer lists are joined with the different (host,
    path) pairs.

    Null urls, and urls without ``://``, have an empty host and path, which no rule fits.
    Rules with a null or empty host or another verdict are left out; a null path fits
    every path.  Repeated rows are judged each.  Other columns stay, whatever their
    name, but for ``filter``, which is replaced.  Empty tables: no rows, or no rules.
    """
    columns = [c for c in pages.columns if c != "filter"]
    plain = pages.select(*[F.col(f"`{c}`") for c in columns]).toDF(*[f"c{i}" for i in range(len(columns))])
    url = f"c{columns.index(url_column)}"
    urls = plain.withColumns({"_host": url_host(url), "_path": url_path(url)})
    tidy = _tidy(rules)
    count, chars = tidy.agg(F.count("*"), F.coalesce(F.sum(F.char_length("host") + F.char_length("path")), F.lit(0))).first()
    if count <= broadcast_rules and chars <= BROADCAST_CHARS:
        judged = _by_trie(urls, [tuple(r) for r in tidy.collect()])  # at most broadcast_rules rows
    else:
        _log.info("urls: %d rules are joined, not broadcast", count)
        judged = _by_join(urls, tidy)
    found = F.struct(F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule").alias("rule"), F.coalesce("_verdict", F.lit(default)).alias("verdict"))
    return judged.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)], found.alias("filter"))
