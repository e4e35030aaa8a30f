"""Upserts and path queries over node and edge frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ControlCycle
from ..tables import cut, dealt
from .risk import reach


def _one_for_each(df: DataFrame, keys: list[str]) -> DataFrame:
    """The greatest row of each key, columns compared in their order."""
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    return df.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("_row")).select(*keys, "_row.*").select(*df.columns)


def upsert(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Rows merged by key: what comes in wins where it is not NULL; rows without a key are left out, of several with one key the greatest counts."""
    new = _one_for_each(incoming.where(F.col(key).isNotNull()), [key])
    old, new = existing.alias("o"), new.alias("n")
    cols = [F.coalesce(f"n.{c}", f"o.{c}").alias(c) if c in incoming.columns else F.col(f"o.{c}").alias(c) for c in existing.columns]
    return old.join(new, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer").select(*cols)


def link(rows: DataFrame, left: DataFrame, right: DataFrame, left_key: str = "uuid", right_key: str = "uuid", properties: tuple[str, ...] = ()) -> DataFrame:
    """Edges (src, dst, properties) whose ends both exist, one for each pair (the greatest properties)."""
    ok = rows.join(left.select(F.col(left_key).alias("src")).distinct(), "src", "left_semi").join(right.select(F.col(right_key).alias("dst")).distinct(), "dst", "left_semi")
    ok = dealt(ok, rows.count(), "src", "dst")
    return ok.groupBy("src", "dst").agg(*(F.max(p).alias(p) for p in properties)) if properties else ok.select("src", "dst").distinct()


def keep_existing(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """The incoming edges for pairs that have none yet; what is there stays untouched. Self links are left out."""
    return _one_for_each(incoming.where("src != dst"), ["src", "dst"]).join(existing.select("src", "dst"), ["src", "dst"], "left_anti")


def _peeled(links: DataFrame) -> DataFrame:
    """Without links from sources and into sinks, for as long as that takes away a tenth of them or more."""
    n = links.count()
    while n:
        links = cut(links.join(links.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(links.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
        before, n = n, links.count()
        if 10 * n > 9 * before:
            break
    return links


def _least(links: DataFrame) -> DataFrame:
    """(node, first, last): of the node and all that reach it, and of it and all it reaches, the one with the least hash. A label takes over its own label, so long ways take few rounds."""
    ways = links.select(F.lit("first").alias("way"), "src", "dst").union(links.select(F.lit("last"), "dst", "src"))
    nodes = ways.select("way", F.col("src").alias("node")).union(ways.select("way", "dst")).distinct()
    labels = cut(nodes.select("way", "node", F.struct(F.xxhash64("node").alias("hash"), F.col("node").alias("id")).alias("label")))
    while True:
        step = labels.withColumnRenamed("node", "src").join(ways, ["way", "src"]).select("way", F.col("dst").alias("node"), "label")
        own = labels.select("way", F.col("node").alias("id"), F.col("label").alias("next"))
        jump = labels.select("way", "node", F.col("label.id").alias("id")).join(own, ["way", "id"]).select("way", "node", "next")
        more = step.union(jump).withColumn("was", F.lit(None).cast(labels.schema["label"].dataType))
        labels = cut(labels.withColumn("was", F.col("label")).union(more).groupBy("way", "node").agg(F.min("label").alias("label"), F.min("was").alias("was")))
        if not labels.where("label != was").head(1):
            return labels.groupBy("node").agg(*(F.max(F.when(F.col("way") == w, F.col("label.id"))).alias(w) for w in ("first", "last")))
        labels = labels.drop("was")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the strongly connected components with more than one node, or a self link; exact for cycles of any length.

    Nodes of one component have the same label from both directions; where the two are
    one node, it reaches the others and is reached by them, which makes the component
    whole. Links between different labels are on no cycle. Each round completes the
    component of every group's node with the least hash.
    """
    found = edges.where("src = dst").select(F.col("src").alias("node"), F.col("src").alias("root")).distinct()
    links = cut(edges.where("src != dst").select("src", "dst").distinct())
    while (links := _peeled(links)).head(1):
        both = cut(_least(links))
        groups = both.groupBy("first", "last").agg(F.count("*").alias("n"))
        whole = both.where("first = last").join(groups.where("n > 1"), ["first", "last"], "left_semi").select("node", F.col("first").alias("root"))
        found = found.join(whole.select("node"), "node", "left_anti").union(whole)
        a, b = (both.where("first != last").select(F.col("node").alias(end), F.col("first").alias(f"{end}_first"), F.col("last").alias(f"{end}_last")) for end in ("src", "dst"))
        links = cut(links.join(a, "src").join(b, "dst").where("src_first = dst_first and src_last = dst_last").select("src", "dst"))
    names = found.groupBy("root").agg(F.min("node").alias("component"))
    return found.join(names, "root").select("node", "component")


def refuse_cycles(edges: DataFrame) -> None:
    found = components(edges).limit(5).collect()
    if found:
        raise ControlCycle(f"nodes on cycles of control: {[r['node'] for r in found]}")


def control_distance(controls: DataFrame, subsidiaries: DataFrame, root: DataFrame, max_hops: int = 4) -> DataFrame:
    """(origin, node, hops): fewest hops down controls, or up subsidiary links."""
    a = reach(controls, root, max_hops)
    b = reach(subsidiaries, root, max_hops, "up")
    return a.unionByName(b).groupBy("origin", "node").agg(F.min("hops").alias("hops"))


def group_exposure(holdings: DataFrame, distance: DataFrame, root) -> DataFrame:
    """(portfolio, company, weight, hops, in_group) of each holding; the root itself is in the group at 0 hops."""
    near = distance.select(F.col("node").alias("company"), "hops")
    df = holdings.groupBy("portfolio", "company").agg(F.sum("weight").alias("weight")).join(near, "company", "left")
    hops = F.when(F.col("company") == F.lit(root), F.lit(0)).otherwise(F.col("hops"))
    return df.select("portfolio", "company", "weight", hops.alias("hops")).withColumn("in_group", F.col("hops").isNotNull())


def group_weight(rows: DataFrame) -> DataFrame:
    return rows.groupBy("portfolio").agg(F.round(F.sum(F.when(F.col("in_group"), F.col("weight")).otherwise(0.0)), 4).alias("group_weight"))


def inherit(sectors: DataFrame, parents: DataFrame) -> DataFrame:
    """(node, sector, source, hops): nodes without a sector take the nearest ancestor's own one, however far up (of equally near ones the smallest id's); what is inherited is not passed on."""
    links = parents.select(F.col("child").alias("at"), "parent").where("at is not null and parent is not null").distinct()
    own = sectors.select(F.col("node").alias("source"), "sector")
    at = links.select(F.col("at").alias("node"), "at").distinct().join(sectors.select("node"), "node", "left_anti")
    seen, found, hop = at, [], 0
    while not found or at.head(1):
        hop += 1
        up = at.join(links, "at").select("node", F.col("parent").alias("at")).distinct().join(seen, ["node", "at"], "left_anti")
        step = cut(up.join(own.withColumnRenamed("source", "at").withColumn("has", F.lit(True)), "at", "left"))
        hit = step.where("has").groupBy("node").agg(F.min(F.struct("at", "sector")).alias("best"))
        found.append(hit.select("node", "best.sector", F.col("best.at").alias("source"), F.lit(hop).alias("hops")))
        at = step.join(hit.select("node"), "node", "left_anti").select("node", "at")
        seen = cut(seen.union(at))
    out = found[0]
    for one in found[1:]:
        out = out.union(one)
    return out


def sector_coverage(nodes: DataFrame, sectors: DataFrame, instruments: DataFrame) -> DataFrame:
    """(by_company, by_instrument), rounded to 4 digits."""
    have = sectors.select("node").distinct().withColumn("has", F.lit(1))
    a = nodes.select("node").distinct().join(have, "node", "left").agg(F.round(F.avg(F.coalesce("has", F.lit(0))), 4).alias("by_company"))
    b = instruments.select("node").join(have, "node", "left").agg(F.round(F.avg(F.coalesce("has", F.lit(0))), 4).alias("by_instrument"))
    return a.join(b)  # one row each


def _named(companies: DataFrame, end: str) -> DataFrame:
    return companies.select(F.col("uuid").alias(end), F.coalesce("ticker", "name").alias(f"{end}_name"), F.col("ticker").isNotNull().alias(f"{end}_listed"))


def control_links(companies: DataFrame, controls: DataFrame, listed_only: bool = False) -> DataFrame:
    """(src, dst): controls between companies by their ticker, else their name; ends without either are left out."""
    df = controls.select("src", "dst").join(_named(companies, "src"), "src").join(_named(companies, "dst"), "dst")
    df = df.where("src_listed and dst_listed") if listed_only else df
    return df.select(F.col("src_name").alias("src"), F.col("dst_name").alias("dst")).where("src != '' and dst != ''")


def ownership_links(companies: DataFrame, stakes: DataFrame, listed_only: bool = False) -> DataFrame:
    """(src, dst, fraction, confidence): stakes by ticker or name as fractions; one without a percentage is none, an unknown confidence is whole."""
    df = stakes.join(_named(companies, "src"), "src").join(_named(companies, "dst"), "dst")
    df = df.where("src_listed and dst_listed") if listed_only else df
    known = F.coalesce("confidence", F.lit(1.0)) if "confidence" in stakes.columns else F.lit(1.0)
    return df.where("src_name is not null and dst_name is not null and pct is not null").select(F.col("src_name").alias("src"), F.col("dst_name").alias("dst"), (F.col("pct") / 100).alias("fraction"), known.alias("confidence"))


def seed(members: DataFrame, listed_only: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(companies, securities, issues) of members (filing_id, ticker, name, is_listed): identifiers follow from the filing's, the first of several codes is the security's."""
    m = members.where("is_listed") if listed_only else members
    first = F.upper(F.trim(F.element_at(F.split("ticker", ","), 1)))
    m = m.where("filing_id is not null").select(F.concat(F.lit("co-"), F.lower("filing_id")).alias("uuid"), "filing_id", F.nullif(first, F.lit("")).alias("ticker"), "name", "is_listed")
    companies = m.select("uuid", "ticker", "name", "filing_id", F.lit("TR").alias("jurisdiction"), "is_listed")
    traded = m.where("is_listed and ticker is not null").select(F.concat(F.lit("se-"), F.lower("filing_id"), F.lit("-"), F.lower("ticker")).alias("security"), "uuid", "ticker")
    return companies, traded.select(F.col("security").alias("uuid"), "ticker", F.lit("EQUITY").alias("type"), F.lit("TRY").alias("currency")), traded.select(F.col("uuid").alias("src"), F.col("security").alias("dst"))


def disclosures(found: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, links) of disclosures (filing_id, index, subject, type, published): one node for each index, the last published, linked to every member it was found under."""
    known = found.join(members.select("filing_id").distinct(), "filing_id", "left_semi").where("index is not null")
    last = known.groupBy("index").agg(F.max(F.struct("published", "subject", "type")).alias("d"))
    nodes = last.select("index", F.col("d.subject").alias("subject"), F.col("d.type").alias("type"), F.to_date("d.published").alias("published"))
    return nodes, known.select(F.concat(F.lit("co-"), F.lower("filing_id")).alias("src"), F.col("index").alias("dst")).distinct()


def board_seats(rows: DataFrame, people: DataFrame, companies: DataFrame) -> DataFrame:
    """(src, dst, role, since): seats of known people on known companies' boards, one for each pair (the one held longest, then the greatest role)."""
    ok = rows.join(people.select(F.col("uuid").alias("src")).distinct(), "src", "left_semi").join(companies.select(F.col("uuid").alias("dst")).distinct(), "dst", "left_semi")
    first = F.min_by(F.struct("role", "since"), F.struct(F.coalesce("since", F.lit("9999-12-31").cast("date")), F.col("role").isNull(), F.col("role")))
    return ok.groupBy("src", "dst").agg(first.alias("r")).select("src", "dst", "r.role", "r.since")


def interlocks(seats: DataFrame, *, block: int = 200, busy: int = 200_000, names: bool = False) -> DataFrame:
    """(a, b, n_people), and with ``names`` people: pairs of companies that share board members, from (src person, dst company).

    A person's seats are dealt into blocks of about ``block``, and each seat meets one
    block at a time, so a person with very many seats is spread over tasks. What is met
    goes to its first company as a list and becomes pairs only where they are counted, in
    as many parts as there are pairs; a company with more than ``busy`` seats is dealt by
    its pairs. The pairs of such a person themselves grow with the square of the seats:
    they are the result.
    """
    seats = seats.where("src is not null and dst is not null").select("src", "dst")
    held = cut(dealt(seats, seats.count(), "src", "dst").distinct(), "seats")
    n = held.groupBy("src").agg(F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    rows, pairs = n.agg(F.coalesce(F.sum(F.col("n") * F.col("blocks")), F.lit(0)), F.coalesce(F.sum(F.col("n") * (F.col("n") - 1)), F.lit(0))).first()
    many = cut(n.where("blocks > 1").select("src", "blocks"))
    placed = held.join(many, "src", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    boards = dealt(placed.select("src", "dst", F.pmod(F.xxhash64("dst"), "blocks").cast("int").alias("block")), rows, "src", "block").groupBy("src", "block").agg(F.collect_list("dst").alias("board"))
    one = dealt(placed.select("src", F.col("dst").alias("a"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")), rows, "src", "block")
    met = one.join(boards, ["src", "block"]).select("a", F.col("src").alias("person"), F.filter("board", lambda b: b > F.col("a")).alias("others")).where(F.size("others") > 0)
    often = cut(held.groupBy(F.col("dst").alias("a")).agg(F.count("*").alias("n")).where(F.col("n") > busy).select("a", F.lit(True).alias("often")))
    lists = F.when(F.col("often"), F.transform("others", lambda b: F.array(b))).otherwise(F.array("others"))
    stripes = met.join(often, "a", "left").select("a", "person", "often", F.explode(lists).alias("others")).withColumn("part", F.when(F.col("often"), F.xxhash64(F.col("others")[0])).otherwise(F.lit(0)))
    each = dealt(stripes, pairs // 2, "a", "part", each=4_000_000).select("a", "part", "person", F.explode("others").alias("b"))
    people = [F.array_sort(F.collect_list("person")).alias("people")] if names else []
    return each.groupBy("a", "part", "b").agg(F.count("*").alias("n_people"), *people).drop("part")


def parents(controls: DataFrame, subsidiaries: DataFrame) -> DataFrame:
    """(child, parent), once each, from both sources of control: who controls (src) whom (dst), and who is a subsidiary (src) of whom (dst)."""
    up = controls.select(F.col("dst").alias("child"), F.col("src").alias("parent")).union(subsidiaries.select("src", "dst"))
    return up.where("child is not null and parent is not null").distinct()
