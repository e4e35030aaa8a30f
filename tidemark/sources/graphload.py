"""Nodes and typed edges into the store.

A node that is known keeps what comes in as NULL; an edge is one for each pair of nodes,
and coming again it takes all the properties of its last row. Only edges between known
nodes of the right kinds are kept, the others are counted. Each table changes in one step.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import Refused
from ..operators.graph import upsert
from ..schemas import EDGES, NODE_KEYS
from .store import Store


class Ends(NamedTuple):
    #: the kinds a source may be of; the first where a row does not say
    src: tuple[str, ...]
    dst: str


#: What each kind of edge goes from and to, in the order they are loaded.
ENDS: dict[str, Ends] = {
    "subsector_of": Ends(("sector",), "sector"),
    "in_sector": Ends(("company",), "sector"),
    "holds_stake": Ends(("company", "person"), "company"),
    "controls": Ends(("company", "person"), "company"),
    "subsidiary_of": Ends(("company",), "company"),
    "board_member_of": Ends(("person",), "company"),
    "holds": Ends(("portfolio",), "security"),
    "issues": Ends(("company",), "security"),
}


def load_nodes(store: Store, table: str, rows: DataFrame) -> int:
    """How many nodes there are now; rows without a key are left out."""
    if table not in NODE_KEYS:
        raise Refused(f"no nodes are called {table!r}")
    store.replace(table, upsert(store.read(table), rows, NODE_KEYS[table][0]))
    return store.read(table).count()


def _ids(store: Store, kind: str) -> DataFrame:
    return store.read(kind).select(F.col(NODE_KEYS[kind][0]).cast("string").alias("id")).distinct()


def load_edges(store: Store, kind: str, rows: DataFrame, order: str | None = None) -> dict:
    """Counts of an edge table's load: pairs that came in, those whose ends are not known, and all that are stored now.

    ``rows`` has src, dst, the properties and, where sources may be of several kinds, label
    (company or person; NULL or no column is the first). Of several rows of a pair the last
    by ``order`` counts, without it the greatest.
    """
    if kind not in ENDS:
        raise Refused(f"no edges are called {kind!r}")
    ends = ENDS[kind]
    names = [c for c in store.read(kind).columns if c not in ("src", "dst")]
    label = F.coalesce(F.lower("label"), F.lit(ends.src[0])) if "label" in rows.columns else F.lit(ends.src[0])
    shaped = rows.where("src is not null and dst is not null").select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), label.alias("label"), (F.col(order) if order else F.lit(0)).alias("_o"), *((F.col(c) if c in rows.columns else F.lit(None).cast("string")).alias(c) for c in names))
    one = shaped.groupBy("src", "dst").agg(F.max(F.struct("_o", "label", *names)).alias("r")).select("src", "dst", "r.label", *(F.col(f"r.{c}").alias(c) for c in names))
    known = None
    for k in ends.src:
        part = one.where(F.col("label") == k).join(_ids(store, k).withColumnRenamed("id", "src"), "src", "left_semi")
        known = part if known is None else known.unionByName(part)
    known = known.join(_ids(store, ends.dst).withColumnRenamed("id", "dst"), "dst", "left_semi").drop("label")
    old = store.read(kind)
    rest = old.join(known.select("src", "dst"), ["src", "dst"], "left_anti")
    store.replace(kind, rest.unionByName(known.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in old.schema.fields))))
    n, linked = one.count(), known.count()
    return {"kind": kind, "n_pairs": n, "n_unknown": n - linked, "n_stored": store.read(kind).count()}


def load_sectors(store: Store, sectors: DataFrame) -> dict:
    """Sector nodes of (code, name, level, parent), and what belongs to what; a parent that is not there is refused."""
    lost = sectors.where("parent is not null").join(sectors.select(F.col("code").alias("parent")).distinct(), "parent", "left_anti")
    bad = [r["code"] for r in lost.select("code").limit(5).collect()]
    if bad:
        raise Refused(f"parents of {', '.join(bad)} are not there")
    load_nodes(store, "sector", sectors.select("code", "name", "parent", "level"))
    return load_edges(store, "subsector_of", sectors.where("parent is not null").select(F.col("code").alias("src"), F.col("parent").alias("dst")))


def load_all(store: Store, nodes: dict[str, DataFrame], edges: dict[str, DataFrame]) -> list[dict]:
    """Nodes first, then every kind of edge that is given, in one order; the counts of each."""
    unknown = set(nodes) - set(NODE_KEYS) | set(edges) - set(EDGES)
    if unknown:
        raise Refused(f"no tables are called {sorted(unknown)}")
    for table, rows in nodes.items():
        load_nodes(store, table, rows)
    return [load_edges(store, kind, edges[kind]) for kind in ENDS if kind in edges]
