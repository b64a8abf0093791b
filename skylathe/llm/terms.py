"""Occurrences of every distinct term and value, by burst tries.

Every task keeps one burst trie per field and unit: inner nodes branch by character, leaves are small
containers of suffixes with two counters (occurrences, records) that burst into a node when they grow.
A full trie is written out as its containers: rows of a prefix and parallel arrays of suffixes and
counters. How many entries lie below each container's prefix over all tasks then decides the routes: the
shortest prefixes that at most ``route_entries`` entries share. Containers above all routes burst and are
looked at again; an item too frequent for any route is one by itself. Each route's matching subtrees are
merged in one trie of bounded size. A frequent item costs one entry per task, wherever its rows lie, so no
item is hot; the routes hold a bounded number of entries, so no prefix is. Counts, routes and containers are
tables throughout; what reaches the driver is one number a field.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

TERM = re.compile("[A-Za-z0-9]+")
#: A container of more suffixes bursts.
BURST = 256
#: A task writes its tries out when they hold so many entries (about 50 MB).
TRIE_ENTRIES = 250_000
#: A prefix with more entries over all tasks is no route; its longer ones may be. A route's trie takes some 10 MB.
ROUTE_ENTRIES = 50_000

RARE_BELOW = 3
COMMON_ONE_IN = 20

COLUMNS = ["field_name", "unit", "prefix", "closed", "suffixes", "totals", "records"]
SCHEMA = "field_name string, unit string, prefix string, closed boolean, suffixes array<string>, totals array<bigint>, records array<bigint>"


class BurstTrie:
    """Items with two counters each. Inner nodes map a character to a node or container; '' holds the item that ends."""

    __slots__ = ("root", "entries")

    def __init__(self) -> None:
        self.root: list = [False, {}]  # [is an inner node, its content]
        self.entries = 0

    def add(self, item: str, total: int, records: int, node: list | None = None, at: int = 0) -> None:
        """Counts an item, from a node that stands for its first ``at`` characters."""
        node = node or self.root
        while node[0]:
            if at == len(item):
                break
            nxt = node[1].get(item[at])
            if nxt is None:
                nxt = node[1][item[at]] = [False, {}]
            node, at = nxt, at + 1
        if node[0]:  # the item ends at an inner node
            held = node[1].setdefault("", [False, {}])[1]
        else:
            held = node[1]
        suffix = item[at:]
        have = held.get(suffix)
        if have is None:
            held[suffix] = [total, records]
            self.entries += 1
            if len(held) > BURST and not node[0]:
                self._burst(node)
        else:
            have[0] += total
            have[1] += records

    def merge(self, prefix: str, suffixes: list[str], totals: list[int], records: list[int]) -> None:
        """Adds a container: into the matching one, or below the node that has burst in its place."""
        node, at = self.root, 0
        while node[0] and at < len(prefix):
            node, at = node[1].setdefault(prefix[at], [False, {}]), at + 1
        rest = prefix[at:]
        for suffix, t, r in zip(suffixes, totals, records):
            have = None if node[0] else node[1].get(rest + suffix)
            if have is not None:
                have[0] += t
                have[1] += r
            else:
                self.add(prefix + suffix, t, r, node, at)

    @staticmethod
    def _burst(node: list) -> None:
        parts: dict[str, list] = {}
        for suffix, counts in node[1].items():
            parts.setdefault(suffix[:1], [False, {}])[1][suffix[1:]] = counts
        node[0], node[1] = True, parts

    def containers(self) -> Iterator[tuple[str, dict]]:
        stack = [("", self.root)]
        while stack:
            prefix, node = stack.pop()
            if node[0]:
                stack.extend((prefix + ch, sub) for ch, sub in node[1].items())
            elif node[1]:
                yield prefix, node[1]


def value_form(text: str) -> str:
    return " ".join(text.split()).upper()


def _count(fields: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tries = {(f, u): BurstTrie() for f in fields for u in ("term", "value")}

        def flush() -> pd.DataFrame:
            rows = []
            for (f, u), trie in tries.items():
                for prefix, held in trie.containers():
                    rows.append((f, u, prefix, False, list(held), [c[0] for c in held.values()], [c[1] for c in held.values()]))
                tries[f, u] = BurstTrie()
            return pd.DataFrame(rows, columns=COLUMNS)

        for batch in batches:
            for f in fields:
                terms, values = tries[f, "term"], tries[f, "value"]
                for text, n in Counter(batch[f].dropna()).items():
                    value = value_form(text)
                    if not value:
                        continue
                    values.add(value, n, n)
                    for term, k in Counter(t.upper() for t in TERM.findall(text)).items():
                        terms.add(term, n * k, n)
            if sum(t.entries for t in tries.values()) > TRIE_ENTRIES:
                yield flush()
        yield flush()

    return run


def _shared(words: list[str]) -> int:
    """Length of the prefix that all words share."""
    low, high, n = min(words), max(words), 0
    while n < len(low) and low[n] == high[n]:
        n += 1
    return n


def _burst_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each container as those of its next characters, their prefixes lengthened by what the suffixes share. An
    item that ends at the container's prefix is closed: it cannot be told apart any further."""
    for batch in batches:
        rows = []
        for f, u, prefix, suffixes, totals, records in zip(*[batch[c] for c in COLUMNS if c != "closed"]):
            parts: dict[str, list] = {}
            for entry in zip(suffixes, totals, records):
                parts.setdefault(entry[0][:1], []).append(entry)
            for first, entries in parts.items():
                s, t, r = zip(*entries)
                k = _shared(s)
                rows.append((f, u, prefix + s[0][:k], not first, [x[k:] for x in s], list(t), list(r)))
        yield pd.DataFrame(rows, columns=COLUMNS)


def _routed(tries: DataFrame, route_entries: int) -> DataFrame:
    """The containers with their ``route``: the shortest prefix that at most ``route_entries`` entries share, or a
    closed item itself.

    Bursting moves entries below longer prefixes and never takes any from a shorter one, so a prefix once too
    large stays so, and at the end all containers with an item agree on its route.
    """
    at = ["field_name", "unit", "prefix"]
    up = F.transform(F.sequence(F.lit(0), F.length("prefix")), lambda k: F.left("prefix", k))
    while True:
        sizes = tries.groupBy(*at).agg(F.sum(F.size("suffixes")).alias("n"))
        ups = cut(sizes.select(*at, "n", F.posexplode(up).alias("k", "up")))
        large = ups.groupBy("field_name", "unit", "up").agg(F.sum("n").alias("n")).filter(F.col("n") > route_entries)
        route = ups.join(large.drop("n"), ["field_name", "unit", "up"], "left_anti").groupBy(*at).agg(F.min("k").alias("k"))
        placed = cut(tries.join(route, at, "left").withColumn("route", F.when(F.col("closed"), F.col("prefix")).otherwise(F.left("prefix", "k"))).drop("k"))
        high = placed.filter("route is null").drop("route")
        if not high.limit(1).count():
            return placed
        tries = cut(placed.filter("route is not null").drop("route").unionByName(high.mapInPandas(_burst_rows, SCHEMA)))


def _merge(group: pd.DataFrame) -> pd.DataFrame:
    """One route's containers in one trie. They hold ``route_entries`` entries at most, or one item's, one a task."""
    trie = BurstTrie()
    for c in zip(group["prefix"], group["suffixes"], group["totals"], group["records"]):
        trie.merge(*c)
    held = [(prefix + s, *n) for prefix, c in trie.containers() for s, n in c.items()]
    out = pd.DataFrame(held, columns=["item", "n_total", "n_records"])
    return out.assign(field_name=group["field_name"].iloc[0], unit=group["unit"].iloc[0])


def count_terms(df: DataFrame, fields: list[str], route_entries: int = ROUTE_ENTRIES, rare_below: int = RARE_BELOW, common_one_in: int = COMMON_ONE_IN) -> DataFrame:
    """(field_name, unit, item, n_total, n_records, mark) of each distinct term and value of the string columns.

    A record is a row whose field is not blank (null, empty, white space only). A term is a longest run of
    ASCII letters and digits, in upper case; a value is the whole field in upper case with single blanks.
    ``mark`` is rare below ``rare_below`` records, common above one in ``common_one_in`` of the field's
    records, otherwise kept. Repeated rows each count; an empty table gives no rows; other columns are not
    read.
    """
    tries = cut(df.select(*fields).mapInPandas(_count(fields), SCHEMA))
    sizes = tries.filter("unit = 'value'").select("field_name", F.explode("records").alias("r")).groupBy("field_name").agg(F.sum("r").alias("n")).collect()
    records = F.lit(0).cast("bigint")
    for r in sizes:
        records = F.when(F.col("field_name") == r["field_name"], F.lit(r["n"])).otherwise(records)
    routes = _routed(tries, route_entries).groupBy("field_name", "unit", "route")
    merged = routes.applyInPandas(_merge, "field_name string, unit string, item string, n_total bigint, n_records bigint")
    mark = F.when(F.col("n_records") < rare_below, "rare").when(F.col("n_records") * common_one_in > records, "common").otherwise("kept")
    return merged.select("field_name", "unit", "item", "n_total", "n_records", mark.alias("mark"))
