"""Supplier entity resolution: spelling variants of one company get one canonical id.

Names are normalised, then linked if they are one edit apart, and linked names are grouped.
No pairs are formed: every name is attached to the strings it becomes by deleting one character
(and to itself). Two names one edit apart always meet at such a string, and names that meet are at
most two edits apart. Groups are then connected components of that name-to-string graph.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import cut

# Legal forms that say nothing about identity.
LEGAL_FORMS = ["inc", "incorporated", "corp", "corporation", "co", "company", "ltd", "limited", "llc",
               "plc", "gmbh", "ag", "sa", "sas", "srl", "spa", "bv", "nv", "oy", "ab", "kk", "pty"]


def normal_name(name) -> Column:
    """Lower case, accents of Latin letters dropped, punctuation and legal forms removed; letters of any script stay."""
    plain = F.translate(F.lower(name), "áàâäãåéèêëíìîïóòôöõúùûüçñ", "aaaaaaeeeeiiiiooooouuuucn")
    words = F.split(F.trim(F.regexp_replace(plain, r"[^\p{L}\p{N}\p{M}]+", " ")), " ")
    kept = F.filter(words, lambda w: ~w.isin(LEGAL_FORMS) & (w != ""))
    return F.array_join(kept, " ")


def deletion_keys(text, digits_key, shortest: int = 4) -> Column:
    """The string itself and each form with one character deleted, within the same block.

    Strings of fewer than `shortest` characters keep their spelling: one edit of a short name is another name.
    """
    positions = F.sequence(F.lit(1), F.length(text))
    deleted = F.transform(positions, lambda i: F.concat(
        F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, F.length(text))))
    forms = F.when(F.length(text) >= shortest, F.array_union(F.array(text), deleted)).otherwise(F.array(text))
    return F.transform(forms, lambda f: F.concat_ws("|", digits_key, f))


def connected(links: DataFrame, node: str, hub: str) -> DataFrame:
    """Components of a node-to-hub graph: each node gets the smallest node it is connected to.

    Labels travel node -> hub -> node, and each round also jumps to the label's own label, so that
    long chains shrink geometrically. Lineage is cut through the shared folder every round.
    """
    edges = links.select(node, hub).distinct()
    labels = cut(edges.select(node).distinct().withColumn("label", F.col(node)))
    # A string only one name leads to connects nothing, and most are like that.
    shared = edges.groupBy(hub).agg(F.count("*").alias("_n")).where("_n > 1").select(hub)
    links = cut(edges.join(shared, hub, "left_semi"))
    while True:  # every round but the last lowers a label, so it ends
        at_hub = links.join(labels, node).groupBy(hub).agg(F.min("label").alias("_low"))
        near = links.join(at_hub, hub).groupBy(node).agg(F.min("_low").alias("_low"))
        # Everything carrying the old label can take the best label any of its carriers found.
        better = labels.join(near, node).groupBy("label").agg(F.min("_low").alias("_best"))
        moved = cut(labels.join(better, "label", "left").select(
            node, F.least("label", "_best").alias("label"),
            F.coalesce(F.col("_best") < F.col("label"), F.lit(False)).alias("_moved")))
        labels = moved.drop("_moved")
        if moved.where("_moved").isEmpty():
            return labels


def _tagged(suppliers: DataFrame, name: str, block: list[str]) -> DataFrame:
    """With _block (what must be equal) and _text (what may differ by an edit; empty or NULL without a name)."""
    plain = normal_name(F.col(name))
    text = F.when(plain == "", F.trim(F.lower(F.col(name)))).otherwise(plain)
    block_key = F.concat_ws("|", *[F.coalesce(F.col(b).cast("string"), F.lit("")) for b in block],
                            F.regexp_replace(text, r"[^\p{N}]", ""))
    return suppliers.withColumn("_block", block_key).withColumn("_text", F.trim(F.regexp_replace(text, r"\p{N}", "")))


def cluster_id(canonical) -> Column:
    return F.substring(F.sha2(canonical.cast("string"), 256), 1, 16)


def resolve_suppliers(suppliers: DataFrame, key: str = "supplier_id", name: str = "supplier_name",
                      block: list[str] = (), shortest: int = 4) -> DataFrame:
    """Suppliers with canonical_supplier_id and entity_resolution_cluster_id.

    Numbers inside a name identify it, so names with different digits never link; neither do
    suppliers that differ in a `block` column. Names of fewer than `shortest` letters link only if they are
    the same. A name without letters or digits is compared as it is written. A supplier without a name stands alone.
    """
    tagged = _tagged(suppliers, name, block)
    named = tagged.where(F.col(name).isNotNull() & (F.length("_text") > 0))
    # Identical spellings collapse first: the graph has one node per distinct name.
    spellings = named.groupBy("_block", "_text").agg(F.min(key).alias("_node"))
    links = spellings.select("_node", F.explode(deletion_keys(F.col("_text"), F.col("_block"), shortest)).alias("_hub"))
    labels = connected(links, "_node", "_hub")
    groups = spellings.join(labels, "_node").select("_block", "_text", F.col("label").alias("_canonical"))
    out = tagged.join(groups, ["_block", "_text"], "left")
    canonical = F.coalesce("_canonical", key)
    return out.withColumn("canonical_supplier_id", canonical) \
        .withColumn("entity_resolution_cluster_id", cluster_id(canonical)) \
        .drop("_block", "_text", "_canonical")


@dataclass(frozen=True)
class Entities:
    """What is known of supplier entities after some runs.

    An entity is named by the supplier key and the run it was first seen with; the older name survives a merge.
    spellings (_block, _text, entity), members (key, entity) and merges (run, entity, into), where entity and into are
    structs (since, id).
    """

    spellings: DataFrame
    members: DataFrame
    merges: DataFrame


def update_entities(suppliers: DataFrame, known: Entities | None, run: int, key: str = "supplier_id", name: str = "supplier_name",
                    block: list[str] = (), shortest: int = 4) -> Entities:
    """The entities after one more run over suppliers, by the links of `resolve_suppliers`.

    Only spellings that no earlier run has seen look for links, among themselves and among those stored; stored ones
    that were not linked cannot become so but through a new one. Entities that are linked become one, under the name
    of the oldest (then the smallest id), and the merge is logged. All spellings of one key are one entity, so a
    renamed supplier keeps its name. The entities are those of one run over all suppliers. Suppliers without a name or
    a key are not recorded. A repeated run changes nothing.
    """
    tagged = _tagged(suppliers, name, block)
    current = tagged.where(F.col(name).isNotNull() & F.col(key).isNotNull() & (F.length("_text") > 0)).select(
        F.col(key).alias("key"), "_block", "_text").distinct()
    place = ["_block", "_text"]
    entity = F.struct(F.lit(run).alias("since"), F.col("key").alias("id"))
    mine = current.groupBy(*place).agg(F.min(entity).alias("entity"))
    fresh = mine.join(known.spellings, place, "left_anti") if known else mine
    fresh = cut(fresh.withColumn("_fresh", F.lit(True)))
    every = known.spellings.withColumn("_fresh", F.lit(False)).unionByName(fresh) if known else fresh

    def hubs(spellings: DataFrame) -> DataFrame:
        return spellings.select(F.col("entity").alias("_node"), F.explode(deletion_keys(F.col("_text"), F.col("_block"), shortest)).alias("_hub"))

    # Spellings meet at the strings of their names, entities at the keys they share.
    by_key = current.join(every, place).select(F.col("entity").alias("_node"), "key")
    links = hubs(fresh)
    if known:
        links = links.unionByName(hubs(known.spellings).join(links.select("_hub").distinct(), "_hub", "left_semi").select("_node", "_hub"))
        by_key = by_key.unionByName(known.members.join(current.select("key").distinct(), "key").select(F.col("entity").alias("_node"), "key"))
    links = links.select("_node", F.concat(F.lit("name|"), "_hub").alias("_hub")).unionByName(
        by_key.select("_node", F.concat(F.lit("key|"), F.col("key").cast("string")).alias("_hub")))
    labels = connected(links, "_node", "_hub").where("label <> _node").select(F.col("_node").alias("entity"), F.col("label").alias("into"))
    labels = cut(labels)

    def renamed(rows: DataFrame) -> DataFrame:
        return rows.join(labels, "entity", "left").withColumn("entity", F.coalesce("into", "entity")).drop("into")

    spellings = renamed(every).select(*place, "entity")
    members = current.join(spellings, place).groupBy("key").agg(F.min("entity").alias("entity"))
    merges = labels.where(F.col("entity.since") < run).select(F.lit(run).alias("run"), "entity", "into")
    if known:
        members = members.unionByName(renamed(known.members).select("key", "entity").join(current.select("key").distinct(), "key", "left_anti"))
        merges = merges.unionByName(known.merges).distinct()
    return Entities(spellings, members, merges)


def with_entities(suppliers: DataFrame, entities: Entities, key: str = "supplier_id") -> DataFrame:
    """Suppliers with canonical_supplier_id and entity_resolution_cluster_id; one that is in no entity stands alone."""
    known = entities.members.select(F.col("key").alias(key), F.col("entity.id").alias("_canonical"))
    canonical = F.coalesce("_canonical", key)
    return suppliers.join(known, key, "left").withColumn("canonical_supplier_id", canonical) \
        .withColumn("entity_resolution_cluster_id", cluster_id(canonical)).drop("_canonical")
