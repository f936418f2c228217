"""Constraint derivation: edges that the recorded attributes of instances imply, and the relations that fill their blanks.

Instances: (machine, key, cls, role, kind, fastens, socket_host, cable, of, parent, attached, extra). Every rule is an
equi-join on (machine, reference); references are explicit keys or classes with one instance on the machine.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepfold.session import cut

# Prefixes, cable kinds and owners, latch and cover vocabularies, edge types in order.
CABLE, DRAFT = "cable:", "ls:"
CABLE_DEFAULT_STATE = "routed"
CABLE_OWNERS = {"cpu_fan": "cpu_cooler", "cooler_fan": "cpu_cooler", "hdd": "storage_drive", "ssd": "storage_drive", "drive": "storage_drive", "optical": "optical_drive"}
DETACHABLE = ["storage_drive", "optical_drive"]
POWER_LEADS = ["atx_24pin", "cpu_power", "sata_power", "molex"]
TWO_ENDED = ["sata_data"]
FAN_COOLERS = ["fan", "heatsink_fan"]
LATCHES = ["ram_latch", "drive_latch", "card_latch", "cooler_latch"]
LATCH_HOSTS = {"cpu_socket_lever": "cpu", "psu_latch": "psu"}
COVER_CLASSES = {"cpu_cooler": ["cpu_cooler"], "ram": ["ram_module"], "expansion_slot": ["expansion_card"], "drive": ["storage_drive", "optical_drive"]}
COVER_ROLES = {"motherboard_screws": ["motherboard"]}
SITS_ON = [("cpu", "cpu_cooler")]
EDGE_TYPES = ["fastened_by", "connected_to", "locked_by", "covered_by", "blocked_by"]


def is_draft(key: Column) -> Column:
    return key.startswith(DRAFT)


def settled(instances: DataFrame) -> DataFrame:
    """Instances that are parts of the machine; drafts of the label tool are not."""
    return instances.where(~is_draft(F.col("key")))


def lookup(column: Column, table: dict[str, str]) -> Column:
    """The value of a small vocabulary, null for what it lacks."""
    return F.coalesce(*[F.when(column == k, F.lit(v)) for k, v in table.items()])


def uniques(instances: DataFrame) -> DataFrame:
    """(machine, cls, key) of classes with exactly one settled instance on the machine."""
    g = settled(instances).groupBy("machine", "cls").agg(F.count("*").alias("n"), F.min("key").alias("key"))
    return g.where("n = 1").drop("n")


def references(instances: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """(machine, ref, target): what a reference names, a key before a class of one instance."""
    own = settled(instances).select("machine", F.col("key").alias("ref"), F.col("key").alias("target"))
    by_class = (uniques(instances) if only is None else only).select("machine", F.col("cls").alias("ref"), F.col("key").alias("target"))
    return own.union(by_class.join(own.select("machine", "ref"), ["machine", "ref"], "left_anti"))


def resolved(rows: DataFrame, refs: DataFrame, column: str, out: str) -> DataFrame:
    """`rows` with `out`: the instance that `column` names, null where it names none or several."""
    names = refs.select("machine", F.col("ref").alias(column), F.col("target").alias(out))
    return rows.join(names, ["machine", column], "left")


def _edges(rows: DataFrame, kind: str, target: str, blocker: str, reason: Column, place: int) -> DataFrame:
    return rows.where(F.col(target).isNotNull()).select("machine", F.lit(kind).alias("type"), F.col(target).alias("target"), F.col(blocker).alias("blocker"), reason.alias("reason"), F.lit(place).alias("place"))


class Names(NamedTuple):
    """What the parts of the machines are called, computed once for all rules."""

    refs: DataFrame
    only: DataFrame

    @classmethod
    def of(cls, instances: DataFrame) -> Names:
        """Both tables kept: classes with one instance, and all that a reference may name."""
        only = cut(uniques(instances))
        return cls(cut(references(instances, only)), only)


def fastened_by(instances: DataFrame, names: Names) -> DataFrame:
    """A screw holds what its `fastens` names."""
    rows = resolved(settled(instances).where("cls = 'screw'"), names.refs, "fastens", "held")
    return _edges(rows, "fastened_by", "held", "key", F.concat_ws(" fastens ", "key", "held"), 0)


def cable_owner_class(cable: Column) -> Column:
    """The class that a cable is captive to; null for drives, whose cables come off."""
    named = F.when(cable.startswith(CABLE), F.nullif(F.trim(F.substr(cable, F.lit(len(CABLE) + 1))), F.lit("")))
    owner = F.coalesce(lookup(named, CABLE_OWNERS), named)
    return F.when(~owner.isin(DETACHABLE), owner)


def connector_owners(instances: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """Settled connectors with `owner`: the power supply for power leads, none for two-ended leads, else the cable's owner;
    `fanless` marks those whose only owner is a cooler without a fan, which is no owner."""
    rows = settled(instances).where("cls = 'connector'")
    wanted = F.when(F.col("kind").isin(POWER_LEADS), F.lit("psu")).when(F.col("kind").isin(TWO_ENDED), F.lit(None)).otherwise(cable_owner_class(F.col("cable")))
    only = (uniques(instances) if only is None else only).select("machine", F.col("cls").alias("wanted"), F.col("key").alias("found"))
    kinds = settled(instances).select("machine", F.col("key").alias("found"), F.col("kind").alias("found_kind"))
    joined = rows.withColumn("wanted", wanted).join(only, ["machine", "wanted"], "left").join(kinds, ["machine", "found"], "left")
    fanless = (F.col("wanted") == "cpu_cooler") & F.col("found").isNotNull() & ~F.coalesce(F.col("found_kind").isin(FAN_COOLERS), F.lit(False)) & ~F.coalesce(F.col("kind").isin(POWER_LEADS), F.lit(False))
    return joined.withColumn("fanless", F.coalesce(fanless, F.lit(False))).withColumn("owner", F.when(~F.col("fanless"), F.col("found"))).drop("wanted", "found_kind")


def unresolved_fan_owners(instances: DataFrame) -> DataFrame:
    """(machine, key, cooler): fan leads whose only cooler has no fan."""
    return connector_owners(instances).where("fanless").select("machine", "key", F.col("found").alias("cooler"))


def connected_to(instances: DataFrame, names: Names) -> DataFrame:
    """A connector gates its socket's host and, unless it was added by hand without a cable, the owner of its cable."""
    rows = resolved(connector_owners(instances, names.only), names.refs, "socket_host", "host")
    hosts = _edges(rows, "connected_to", "host", "key", F.concat_ws(" plugs into ", "key", "host"), 1)
    owners = rows.where("(not extra or cable is not null) and (host is null or owner <> host)")
    return hosts.union(_edges(owners, "connected_to", "owner", "key", F.concat_ws(" is on the cable of ", "key", "owner"), 2))


def locked_by(instances: DataFrame, names: Names) -> DataFrame:
    """A latch locks what its `of` names; levers and supply latches lock the one part of their class."""
    rows = settled(instances)
    named = resolved(rows.where(F.col("cls").isin(LATCHES)), names.refs, "of", "held")
    fixed = rows.where(F.col("cls").isin(list(LATCH_HOSTS)) & ~F.col("extra")).withColumn("of", lookup(F.col("cls"), LATCH_HOSTS))
    both = named.unionByName(resolved(fixed, names.only.select("machine", F.col("cls").alias("ref"), F.col("key").alias("target")), "of", "held"))
    return _edges(both, "locked_by", "held", "key", F.concat_ws(" locks ", "key", "held"), 3)


def cover_targets(instances: DataFrame) -> DataFrame:
    """(machine, key, held) of covers: the instance named, else all of the classes or screw roles that `of` stands for.

    Rule tables are exploded into rows first, so both ways are equi-joins.
    """
    rows = settled(instances)
    covers = rows.where("cls = 'cover' and of is not null and of <> ''").select("machine", "key", "of")
    named = covers.join(rows.select("machine", F.col("key").alias("of"), F.col("key").alias("held")), ["machine", "of"])
    rest = covers.join(rows.select("machine", F.col("key").alias("of")), ["machine", "of"], "left_anti")
    words = lambda table: F.coalesce(*[F.when(F.col("of") == k, F.array(*[F.lit(x) for x in v])) for k, v in table.items()])
    plain = rows.where(~F.col("extra"))
    by_class = rest.withColumn("cls", F.explode(words(COVER_CLASSES))).join(plain.select("machine", "cls", F.col("key").alias("held")), ["machine", "cls"])
    by_role = rest.withColumn("role", F.explode(words(COVER_ROLES))).join(plain.where("cls = 'screw'").select("machine", "role", F.col("key").alias("held")), ["machine", "role"])
    return reduce(DataFrame.union, [df.select("machine", "key", "held") for df in (named, by_class, by_role)])


def covered_by(instances: DataFrame, names: Names) -> DataFrame:
    """A cover hides its targets, and the cooler sits on the processor where the machine has one of each."""
    covers = _edges(cover_targets(instances), "covered_by", "held", "key", F.concat_ws(" covers ", "key", "held"), 4)
    extra = settled(instances).where("extra").select("machine", "key")
    only = names.only.join(extra, ["machine", "key"], "left_anti")
    sits = [only.where(F.col("cls") == under).select("machine", F.col("key").alias("under")).join(only.where(F.col("cls") == over).select("machine", F.col("key").alias("over")), "machine") for under, over in SITS_ON]
    return reduce(DataFrame.union, [covers, *[_edges(s, "covered_by", "under", "over", F.concat_ws(" sits on ", "over", "under"), 5) for s in sits]])


#: The derivation rules: each takes instances and their names and gives edges.
RULES = (fastened_by, connected_to, locked_by, covered_by)


def propose_edges(instances: DataFrame, rules=RULES) -> DataFrame:
    """(machine, type, target, blocker, reason) of all rules; of equal edges the first rule's reason stays."""
    names = Names.of(instances)
    every = reduce(DataFrame.union, [rule(instances, names) for rule in rules])
    return every.groupBy("machine", "type", "target", "blocker").agg(F.min_by("reason", "place").alias("reason"))


def constraint_edges(edges: DataFrame) -> DataFrame:
    """Edges of the known types, none from a part to itself and none about a draft."""
    return edges.where(F.col("type").isin(EDGE_TYPES) & (F.col("target") != F.col("blocker")) & ~is_draft(F.col("target")) & ~is_draft(F.col("blocker")))


def edge_order() -> list[Column]:
    """Sort columns of edges: type in its fixed order, target, blocker."""
    return [F.array_position(F.array(*[F.lit(t) for t in EDGE_TYPES]), F.col("type")), F.col("target"), F.col("blocker")]


def virtual_targets(edges: DataFrame, instances: DataFrame) -> DataFrame:
    """Edges whose target is a cable or no instance of the machine."""
    known = instances.select("machine", F.col("key").alias("target"), F.lit(True).alias("_k"))
    return edges.join(known, ["machine", "target"], "left").where(F.col("target").startswith(CABLE) | F.col("_k").isNull()).drop("_k")


def blocker_states(edges: DataFrame, state: DataFrame) -> DataFrame:
    """(machine, blocker, state) of every blocker; a cable without a state is routed, any other has none."""
    known = state.select("machine", F.col("key").alias("blocker"), "state")
    default = F.when(F.col("blocker").startswith(CABLE), F.lit(CABLE_DEFAULT_STATE))
    return edges.select("machine", "blocker").distinct().join(known, ["machine", "blocker"], "left").withColumn("state", F.coalesce("state", default))


def cable_nodes(edges: DataFrame, state: DataFrame) -> DataFrame:
    """(machine, key, state) of all cables that edges block with or that have a state."""
    blockers = blocker_states(edges, state).withColumnRenamed("blocker", "key")
    own = state.select("machine", "key", "state")
    return blockers.union(own).where(F.col("key").startswith(CABLE)).distinct()


def infer_relations(instances: DataFrame, screw_hosts: dict[str, str], class_hosts: dict[str, str]) -> DataFrame:
    """`instances` with blank relations filled, never overwritten; drafts stay as they are.

    A screw fastens the one instance of its role's class; a captive one hangs on it. A class with a host hangs on the
    machine's one host. A socket host given as a class becomes its instance. Latches without a module are spread evenly
    over the memory modules by ordinal. Parts added by hand get their host only.
    """
    refs = references(instances)
    only = uniques(instances).select("machine", F.col("cls").alias("ref"), F.col("key").alias("target"))
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    usable = ~is_draft(F.col("key"))
    rows = instances.withColumn("_screw", F.when(usable & ~F.col("extra") & (F.col("cls") == "screw") & blank(F.col("fastens")), lookup(F.col("role"), screw_hosts)))
    rows = resolved(rows, only, "_screw", "_held").withColumn("fastens", F.coalesce("_held", "fastens")).drop("_screw", "_held")
    rows = resolved(rows, refs, "fastens", "_on")
    captive = usable & ~F.col("extra") & (F.col("cls") == "screw") & F.coalesce(F.col("captive"), F.lit(False)) & blank(F.col("parent")) & F.col("_on").isNotNull()
    rows = rows.withColumn("attached", F.col("attached") | captive).withColumn("parent", F.when(captive, F.col("_on")).otherwise(F.col("parent"))).drop("_on")
    rows = rows.withColumn("_host", F.when(usable & blank(F.col("parent")), lookup(F.col("cls"), class_hosts)))
    rows = resolved(rows, only, "_host", "_at").withColumn("attached", F.col("attached") | F.col("_at").isNotNull()).withColumn("parent", F.coalesce("_at", "parent")).drop("_host", "_at")
    rows = rows.withColumn("_socket", F.when(usable & (F.col("cls") == "connector"), F.col("socket_host")))
    rows = resolved(rows, refs, "_socket", "_plug").withColumn("socket_host", F.coalesce("_plug", "socket_host")).drop("_socket", "_plug")
    # the i-th of n latches locks the (i * m div n)-th of m modules
    plain = settled(instances).where(~F.col("extra"))
    order = Window.partitionBy("machine").orderBy("key")
    modules = plain.where("cls = 'ram_module'").select("machine", F.col("key").alias("_module"), (F.row_number().over(order) - 1).alias("_at"), F.count("*").over(Window.partitionBy("machine")).alias("_m"))
    latches = plain.where("cls = 'ram_latch'").select("machine", "key", (F.row_number().over(order) - 1).alias("_i"), F.count("*").over(Window.partitionBy("machine")).alias("_n"))
    size = modules.select("machine", "_m").distinct()
    pairs = latches.join(size, "machine").withColumn("_at", F.floor(F.col("_i") * F.col("_m") / F.col("_n")).cast("int")).join(modules.drop("_m"), ["machine", "_at"]).select("machine", "key", "_module")
    rows = rows.join(pairs, ["machine", "key"], "left").withColumn("of", F.when(blank(F.col("of")), F.coalesce("_module", "of")).otherwise(F.col("of"))).drop("_module")
    return rows.select(*instances.columns)


def unresolved_relations(instances: DataFrame, screw_hosts: dict[str, str]) -> DataFrame:
    """(machine, key, field, why): screws that fasten nothing known, and connectors whose host is no instance.

    why: `no candidate` where the machine has no instance of the wanted class, `ambiguous` where it has several.
    """
    rows = settled(instances)
    counts = rows.groupBy("machine", "cls").agg(F.count("*").alias("n"))
    screws = rows.where("cls = 'screw' and not extra and coalesce(fastens, '') = ''").select("machine", "key", F.lit("fastens").alias("field"), lookup(F.col("role"), screw_hosts).alias("cls"))
    plugs = rows.where("cls = 'connector' and socket_host is not null").join(rows.select("machine", F.col("key").alias("socket_host")), ["machine", "socket_host"], "left_anti")
    both = screws.union(plugs.select("machine", "key", F.lit("socket_host"), F.col("socket_host")))
    return both.join(counts, ["machine", "cls"], "left").where("n is null or n <> 1").select("machine", "key", "field", F.when(F.col("n").isNull(), "no candidate").otherwise("ambiguous").alias("why"))


EDGE_KEYS = ["machine", "type", "target", "blocker"]


def decide(edges: DataFrame, decisions: DataFrame) -> DataFrame:
    """Edges (keys, source, status) after one decision (keys, action) each.

    accept and reject turn a rule edge into an override, reset turns it back; add makes a manual edge where there is
    none, remove takes a manual one away and no other; adopt makes an orphaned decision a manual edge, drop removes it.
    Decisions that do not fit the edge change nothing.
    """
    both = edges.join(decisions, EDGE_KEYS, "full_outer")
    orphan, rule, act = F.col("status").isin("accepted_orphan", "rejected_orphan"), F.col("source").isin("rule", "override"), F.col("action")
    ruled = rule & ~orphan
    source = F.when(F.col("source").isNull() & (act == "add"), "manual").when(ruled & act.isin("accept", "reject"), "override").when(ruled & (act == "reset"), "rule").when(orphan & (act == "adopt"), "manual").otherwise(F.col("source"))
    status = F.when(F.col("source").isNull() & (act == "add"), "accepted").when(ruled & (act == "accept"), "accepted").when(ruled & (act == "reject"), "rejected").when(ruled & (act == "reset"), "proposed").when(orphan & (act == "adopt"), "accepted").otherwise(F.col("status"))
    gone = ((F.col("source") == "manual") & (act == "remove")) | (orphan & (act == "drop"))
    out = both.withColumn("_gone", F.coalesce(gone, F.lit(False))).withColumn("_source", source).withColumn("_status", status)
    return out.where("not _gone and _source is not null").select(*EDGE_KEYS, F.col("_source").alias("source"), F.col("_status").alias("status"))


def save_template(edges: DataFrame, instances: DataFrame) -> DataFrame:
    """(type, target, blocker, machines): edges by slot, a slot being a class with one instance; others are left out."""
    slots = uniques(instances)
    s = lambda end: slots.select("machine", F.col("key").alias(end), F.col("cls").alias(f"_{end}"))
    joined = edges.join(s("target"), ["machine", "target"]).join(s("blocker"), ["machine", "blocker"])
    return joined.groupBy("type", F.col("_target").alias("target"), F.col("_blocker").alias("blocker")).agg(F.countDistinct("machine").alias("machines"))


def apply_template(template: DataFrame, instances: DataFrame) -> DataFrame:
    """(machine, type, target, blocker): the template's edges on every machine that has exactly one of both slots."""
    slots = uniques(instances)
    s = lambda end: slots.select("machine", F.col("cls").alias(end), F.col("key").alias(f"_{end}"))
    return template.select("type", "target", "blocker").join(s("target"), "target").join(s("blocker"), ["machine", "blocker"]).select("machine", "type", F.col("_target").alias("target"), F.col("_blocker").alias("blocker"))


def initial_state(instances: DataFrame, defaults: dict[str, str], overrides: DataFrame, fallback: str = "installed") -> DataFrame:
    """(machine, key, cls, state, placement) before the first step: class defaults, and what step 0 says instead."""
    given = overrides.select("machine", "key", F.col("state").alias("_given"))
    default = F.coalesce(lookup(F.col("cls"), defaults), F.lit(fallback))
    return instances.select("machine", "key", "cls").join(given, ["machine", "key"], "left").select("machine", "key", "cls", F.coalesce("_given", default).alias("state"), F.lit("in_chassis").alias("placement"))


def needs_geometry(state: DataFrame, policy: DataFrame, on_bench: bool = True) -> DataFrame:
    """(machine, key, geometry) of what must be drawn: mask in the chassis where the policy (cls, state) says so, box on
    the bench (if the view sees one) but for the chassis itself. Drafts, cables, parts elsewhere and parts that left
    inside a removed parent (`left_with`) are not drawn."""
    parents = state.select("machine", F.col("key").alias("left_with"), F.col("state").alias("_ps"), F.col("placement").alias("_pp"))
    rows = state.where(~is_draft(F.col("key")) & ~F.col("key").startswith(CABLE)).join(parents, ["machine", "left_with"], "left")
    inside = F.col("left_with").isNotNull() & (F.col("_ps").isNull() | (F.col("_ps") == "removed") | (F.col("_pp") != "in_chassis"))
    rows = rows.where(~F.coalesce(inside, F.lit(False))).join(policy.select("cls", "state", F.lit(True).alias("_due")), ["cls", "state"], "left")
    kind = F.when((F.col("placement") == "in_chassis") & F.col("_due"), "mask").when(F.lit(on_bench) & (F.col("placement") == "on_bench") & (F.col("cls") != "chassis"), "box")
    return rows.select("machine", "key", kind.alias("geometry")).where("geometry is not null")
