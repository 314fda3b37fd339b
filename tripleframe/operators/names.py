"""Names in sorted order: exact names and names that start with a text, best entries first.

An index holds every name and alias of the knowledge base once, behind its kind, in binary order, cut into aligned parts of
at most ``PART_NAMES`` names.  A text asks for the interval of names from itself to itself and any more signs; it goes to the
parts that this interval touches, found by binary search among the parts' first names.  There, binary search finds the
interval, and a tree over aligned blocks of ``k`` names, each node with its ``k`` best entries, answers it: a text
of one letter reads at most ``2 k`` names and ``k`` entries of about ``2 log2`` of the part's size nodes.  No prefix of a name is ever
written, so what is shuffled is as long as the names are.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tripleframe.functions.shipping import ship_by_value
from tripleframe.functions.text import strip
from tripleframe.plans import meeting
from tripleframe.plans.meeting import met
from tripleframe.plans.ranking import top_k
from tripleframe.shared import stored

ship_by_value(__name__)
ship_by_value(meeting.__name__)

PART_NAMES = 1 << 16
TEXTS = 1 << 14  # texts a task looks up in one part
NONE = np.iinfo(np.int64).max
END = b"\xff"  # follows every sign of UTF-8


def normal_name(label: Column) -> Column:
    return F.lower(strip(label))


def _named(kind: Column, name: Column) -> Column:
    """The kind before the name; a kind holds no zero sign, so no name reaches into another kind."""
    return F.concat(kind, F.lit("\0"), name)


class NameIndex(NamedTuple):
    """Names ``(part, name, alias, id, popularity)`` in the shared folder and the first name of every part."""

    names: DataFrame
    firsts: list[bytes]
    parts: list[str]


def name_index(kb_label: DataFrame) -> NameIndex:
    """Sort all names and aliases once: entries ``(id, kind, label, popularity)`` with ``aliases`` where there are some."""
    aliases = F.col("aliases") if "aliases" in kb_label.columns else F.lit(None).cast("array<string>")
    own = F.array(F.struct(normal_name(F.col("label")).alias("name"), F.lit(False).alias("alias")))
    others = F.transform(F.coalesce(aliases, F.array().cast("array<string>")), lambda a: F.struct(normal_name(a).alias("name"), F.lit(True).alias("alias")))
    rows = kb_label.select("id", "kind", F.col("popularity").cast("long").alias("popularity"), F.explode(F.concat(own, others)).alias("n"))
    rows = rows.where(F.length("n.name") > 0).select(_named(F.col("kind"), F.col("n.name")).alias("name"), "n.alias", "id", "popularity")
    order = ["name", "alias", "id"]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    # row numbers of a partition count from its number times 2**33
    part = F.floor(F.monotonically_increasing_id() / PART_NAMES).cast("string")
    names = stored(placed.select("*", part.alias("part")), "names")
    # one row per part
    firsts = names.groupBy("part").agg(F.min("name").alias("first")).orderBy("first", F.col("part").cast("long")).collect()
    return NameIndex(names, [r["first"].encode() for r in firsts], [r["part"] for r in firsts])


def _parts_asked(texts: DataFrame, index: NameIndex) -> DataFrame:
    """``(kind, name, part)``: the parts that hold names from the text on."""
    firsts, parts = index.firsts, index.parts

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for kind, name in zip(batch["kind"], batch["name"]):
                text = f"{kind}\0{name}".encode()
                # a part may begin with the very text and the one before it end with it
                for i in range(max(bisect_left(firsts, text) - 1, 0), bisect_left(firsts, text + END)):
                    rows.append((kind, name, parts[i]))
            yield pd.DataFrame(rows, columns=["kind", "name", "part"])

    return texts.select("kind", "name").mapInPandas(ask, "kind string, name string, part string")


class BestInRange:
    """The ``k`` smallest distinct of any run of ranks, from aligned blocks of ``k`` and a tree above them."""

    def __init__(self, ranks: np.ndarray, k: int) -> None:
        self.ranks, self.k, self.read = ranks, k, 0
        blocks = -(-len(ranks) // k)
        level = np.full(blocks * k, NONE)
        level[: len(ranks)] = ranks
        self.levels = [self._distinct(level.reshape(blocks, k))]
        while len(self.levels[-1]) > 1:
            row = self.levels[-1]
            if len(row) % 2:
                row = np.vstack([row, np.full((1, k), NONE)])
            self.levels.append(self._distinct(row.reshape(-1, 2 * k))[:, :k])

    @staticmethod
    def _distinct(rows: np.ndarray) -> np.ndarray:
        rows = np.sort(rows, axis=1)
        rows[:, 1:][rows[:, 1:] == rows[:, :-1]] = NONE
        return np.sort(rows, axis=1)

    def best(self, start: int, stop: int) -> np.ndarray:
        k = self.k
        first, last = -(-start // k), stop // k  # whole blocks
        if first >= last:
            parts = [self.ranks[start:stop]]
        else:
            parts = [self.ranks[start : first * k], self.ranks[last * k : stop]]
            for level in self.levels:
                if first >= last:
                    break
                if first % 2:
                    parts.append(level[first])
                    first += 1
                if last % 2:
                    last -= 1
                    parts.append(level[last])
                first, last = first // 2, last // 2
        held = np.concatenate(parts)
        self.read += len(held)
        held = np.unique(held)[: k + 1]
        return held[held != NONE][:k]


def best_entries(texts: DataFrame, index: NameIndex, k: int) -> DataFrame:
    """Up to ``k`` best entries of every distinct text ``(kind, name)``: ``(kind, name, rank, id, match_class, popularity)``.

    The class is 1 for the name itself, 2 for an alias and 3 for a longer name or alias that starts with the text;
    entries are ordered by class, popularity (high first) and id.
    """
    schema = "kind string, name string, id string, match_class int, popularity long"

    def look_up(asked: pd.DataFrame, names: pd.DataFrame) -> pd.DataFrame:
        if names.empty:
            return pd.DataFrame({c: [] for c in ("kind", "name", "id", "match_class", "popularity")})
        names = names.assign(key=[n.encode() for n in names["name"]])
        names = names.sort_values(["key", "alias", "id"], ignore_index=True)
        unpopular = (-names["popularity"].astype(float)).fillna(np.inf)
        order = np.lexsort((names["id"], unpopular))
        # the rows of one entry share a rank
        entry = list(zip(unpopular.to_numpy()[order], names["id"].to_numpy()[order]))
        new = np.array([i == 0 or entry[i] != entry[i - 1] for i in range(len(entry))], bool)
        ranks, row_of = np.empty(len(names), np.int64), order[new]
        ranks[order] = np.cumsum(new) - 1
        keys, alias, tree, out = names["key"].tolist(), names["alias"].to_numpy(bool), BestInRange(ranks, k), []
        for kind, name in zip(asked["kind"], asked["name"]):
            text = f"{kind}\0{name}".encode()
            a, b, c = bisect_left(keys, text), bisect_left(keys, text + b"\0"), bisect_left(keys, text + END)
            middle = a + int(np.searchsorted(alias[a:b], True))
            for number, (start, stop) in enumerate(((a, middle), (middle, b), (b, c)), 1):
                if start < stop:
                    out.extend((kind, name, r, number) for r in row_of[tree.best(start, stop)])
        found = pd.DataFrame(out, columns=["kind", "name", "row", "match_class"])
        entries = names.iloc[found["row"].astype(int)]
        return found.assign(id=entries["id"].to_numpy(), popularity=entries["popularity"].to_numpy())[["kind", "name", "id", "match_class", "popularity"]]

    asked = _parts_asked(texts.where(F.length("name") > 0), index)
    found = met(asked, index.names, "part", ["kind", "name"], TEXTS, look_up, schema)
    # an entry may match by several names and in several parts
    once = found.groupBy("kind", "name", "id").agg(F.min("match_class").alias("match_class"), F.max("popularity").alias("popularity"))
    return top_k(once, ["kind", "name"], [F.asc("match_class"), F.desc("popularity"), F.asc("id")], k)
