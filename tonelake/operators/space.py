"""The space of searchable controls: exclusions, gates, activity, topologies and unit vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import values as V
from ..session import cut


def exclusions(specs: DataFrame, guesses: bool = False) -> DataFrame:
    """Specs with reason, why a control isn't searched (the first that applies); null for the searchable.

    members is the number of an enum's members, null or 0 where they aren't known.
    """
    reason = (
        F.when(~F.col("writable"), "read-only")
        .when(~F.col("searchable"), "not searchable")
        .when(F.col("kind").isin("string", "path", "internal"), "not a quantity")
        .when(F.col("needs_review") & F.lit(not guesses), "guessed kind")
        .when((F.col("kind") == "enum") & (F.coalesce("members", F.lit(0)) == 0), "members aren't known")
        .when(F.col("needs_confirmation"), "members aren't confirmed")
        .when((F.col("kind") == "metered") & (F.col("low").isNull() | F.col("high").isNull()), "no range")
    )
    return specs.withColumn("reason", reason)


# The steps of kinds and units that nobody hears or sees below.
STEPS = {"rotation": 0.5, "fraction": 0.005, "db": 0.25, "hz": 1.0, "ms": 1.0, "bpm": 0.5, "seconds": 0.05, "semitones": 1.0}
CONTINUOUS = ("rotation", "fraction", "metered")


def amp_prefix(selected: Column, by_member: Column, by_name: Column) -> Column:
    """The module prefix of an amp given as stored number, name or prefix; by_member and by_name are maps to prefixes."""
    token = selected.cast("string")
    return F.coalesce(F.try_element_at(by_member, token), F.try_element_at(by_name, token), F.when(F.array_contains(F.map_values(by_name), token), token))


def owners(parameters: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Parameters with owner, the prefix that begins their module, null for none; prefixes: (prefix), a pack's few amps.

    The longest prefix that fits wins.
    """
    of = F.aggregate("_prefixes", F.lit(None).cast("string"), lambda best, p: F.when(F.startswith("module", p) & (F.length(p) > F.coalesce(F.length(best), F.lit(-1))), p).otherwise(best))
    one = prefixes.agg(F.array_sort(F.collect_set("prefix")).alias("_prefixes"))
    return parameters.join(F.broadcast(one), F.lit(True)).withColumn("owner", of).drop("_prefixes")  # one row


def dimensions(specs: DataFrame, gate: DataFrame, owner: DataFrame, conditions: DataFrame, guesses: bool = False) -> DataFrame:
    """The searchable controls of a manifest (path, module, key, kind, unit, low, high, members and flags), ready for a search.

    Adds step, gate (a path), owner, selector and accepted (a selector's values that make the control heard). gate and
    owner: (path, gate), (path, owner); conditions: (path, selector, accepted).
    """
    kept = exclusions(specs, guesses).filter("reason is null").drop("reason")
    bounds = {"low": F.when(F.col("kind") == "rotation", 0.0).when(F.col("kind") == "fraction", 0.0).otherwise(F.col("low")), "high": F.when(F.col("kind") == "rotation", 100.0).when(F.col("kind") == "fraction", 1.0).otherwise(F.col("high"))}
    steps = F.create_map(*(F.lit(x) for kv in STEPS.items() for x in kv))
    step = F.try_element_at(steps, F.coalesce("unit", "kind"))
    out = kept.withColumns(bounds).withColumn("step", step)
    return out.join(gate, "path", "left").join(owner, "path", "left").join(conditions, "path", "left")


def conditions(rules: DataFrame, specs: DataFrame, members: DataFrame) -> DataFrame:
    """(path, selector, accepted, error) of rules (path, selector, member): controls that some members of a selector make heard.

    A member may be given by number or label and is accepted in both spellings. A rule of an unknown control, of what is no
    enum with members, or of an unknown member has an error.
    """
    named = members.select(F.col("path").alias("selector"), F.col("member").cast("string").alias("stored"), V.normal_name(F.col("label")).alias("label"))
    asked = rules.withColumn("token", V.selector_token(F.col("member"))).join(named, "selector", "left")
    hit = F.expr("token = stored or token = label")
    known = specs.select("path", F.lit(True).alias("_known"))
    enums = specs.filter("kind = 'enum'").select(F.col("path").alias("selector"), F.lit(True).alias("_enum"))
    one = asked.groupBy("path", "selector", "token").agg(F.max(F.when(hit, F.col("stored"))).alias("stored"), F.max(F.when(hit, F.col("label"))).alias("label"), F.count("stored").alias("n"))
    checked = one.join(known, "path", "left").join(enums, "selector", "left")
    error = F.when(F.col("_known").isNull(), "unknown control").when(F.col("_enum").isNull() | (F.col("n") == 0), "not a selector").when(F.col("stored").isNull(), "unknown member")
    both = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array_compact(F.array("stored", "token", "label"))))))
    return checked.withColumn("error", error).groupBy("path", "selector").agg(both.alias("accepted"), F.max("error").alias("error"))


def heard(dims: DataFrame, chain: DataFrame, settings: DataFrame, run: str, prefix: str) -> DataFrame:
    """(run, path) of the controls that each run's settings (run, path, value) let reach the sound.

    A control of another amp than the run's selected one (the column prefix), one whose selector has another member, and one
    behind a gate that is off are left out; what the settings don't mention gates nothing.
    """
    runs = settings.select(run, prefix).distinct()
    pairs = runs.join(F.broadcast(dims.select("path", "owner", "selector", "accepted")), F.expr(f"owner is null or owner <=> {prefix}"))  # a pack's few hundred controls
    off = settings.filter(~V.truthy(F.col("value"))).select(run, F.col("path").alias("ancestor"))
    gated = chain.join(off, "ancestor").select(run, F.col("node").alias("path")).distinct()
    chosen = settings.select(run, F.col("path").alias("selector"), V.selector_token(F.col("value")).alias("_chosen"))
    live = pairs.join(chosen, [run, "selector"], "left").filter("accepted is null or _chosen is null or array_contains(accepted, _chosen)")
    return live.join(gated, [run, "path"], "left_anti").select(run, "path")


def emitted(settings: DataFrame, dims: DataFrame, live: DataFrame, run: str, prefix: str) -> DataFrame:
    """(run, parameters, error): a spec for each run, the selected amp first and then its controls by place.

    Dormant controls are left out, but switches of the run's own chain are always written. Settings of an amp's controls
    without a known amp give an error. dims: (path, place, kind, owner).
    """
    known = settings.join(F.broadcast(dims.select("path", "place", "kind", "owner")), "path")
    orphan = known.filter(F.col("owner").isNotNull() & F.col(prefix).isNull()).select(run).distinct().withColumn("error", F.lit("an amp's controls without an amp"))
    own = known.filter(f"path != 'selectedAmp' and value is not null and (owner is null or owner <=> {prefix})")
    kept = own.join(live.withColumn("_live", F.lit(True)), [run, "path"], "left").filter("_live or kind = 'switch'")
    amp = settings.filter("path = 'selectedAmp' and value is not null").select(run, F.lit(-1).alias("place"), "path", "value")
    rows = kept.select(run, "place", "path", "value").unionByName(amp)
    specs = rows.groupBy(run).agg(F.array_sort(F.collect_list(F.struct("place", "path", "value"))).alias("parameters"))
    out = settings.select(run).distinct().join(specs, run, "left").join(orphan, run, "left")
    return out.select(run, F.when(F.col("error").isNull(), F.coalesce("parameters", F.array().cast("array<struct<place:int,path:string,value:string>>"))).alias("parameters"), "error")


def for_backend(settings: DataFrame, live: DataFrame, supported: DataFrame | None, run: str) -> DataFrame:
    """The settings (run, path, value) that reach a render: live controls that the backend models, all of them for None."""
    out = settings.filter("value is not null").join(live, [run, "path"], "left_semi")
    return out if supported is None else out.join(F.broadcast(supported.select(F.ltrim("path", F.lit("/")).alias("path")).distinct()), "path", "left_semi")


def idle_sections(parameters: DataFrame, gate: DataFrame) -> DataFrame:
    """Section switches that gate nothing."""
    used = gate.select("module", F.col("gate").alias("key")).distinct()
    return parameters.filter("kind = 'switch' and contains(key, 'ection')").join(used, ["module", "key"], "left_anti").select("module", "key")


def latin_hypercube(dims: DataFrame, samples: int, seed: int) -> DataFrame:
    """(sample, path, value): samples settings of the dimensions (path, low, high, step), one in each stratum of each.

    Strata are dealt to samples by a hash of seed, path and sample, and the place within a stratum by another, so that the
    same seed gives the same settings on any cluster.
    """
    if samples < 1:
        raise ValueError("at least one sample")
    rows = dims.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    key = lambda salt: F.xxhash64(F.lit(f"{seed}/{salt}"), "path", "sample")
    stratum = F.row_number().over(W.partitionBy("path").orderBy(key("stratum"), "sample")) - 1
    u = F.pmod(key("place"), F.lit(1 << 30)) / float(1 << 30)
    x = F.col("low") + (stratum + u) / samples * (F.col("high") - F.col("low"))
    return rows.withColumn("stratum", stratum).select("sample", "path", "stratum", V.quantised(x, F.col("step"), F.col("low"), F.col("high")).alias("value"))


def gates(parameters: DataFrame) -> DataFrame:
    """(module, key, gate) for parameters (module, key, kind): the most specific *Active switch of the module that covers the key.

    A switch covers keys that begin with its stem, and `section` covers the whole module but ranks last. Switches are only
    gated by section. Both sides join on the module; a module's switches are few.
    """
    switches = parameters.filter("kind = 'switch' and endswith(key, 'Active')").select("module", F.col("key").alias("gate"), F.expr("left(key, length(key) - 6)").alias("stem"))
    bypass = F.expr("kind = 'switch' and endswith(key, 'Active')")
    both = parameters.join(switches, "module").filter("gate != key").filter(F.expr("stem = 'section' or startswith(key, stem)") & (~bypass | (F.col("stem") == "section")))
    rank = F.when(F.col("stem") == "section", -1).otherwise(F.length("stem"))
    return both.groupBy("module", "key").agg(F.max_by("gate", F.struct(rank, F.col("gate"))).alias("gate"))


def ancestors(links: DataFrame, child: str, parent: str) -> DataFrame:
    """(node, ancestor, steps): all ancestors, however far; a chain ends where it would come back to a node it has passed.

    Chains of up to twice the steps are made in each round, of those with all steps so far and any that go on where they end, so
    that there are as many rounds as the longest chain has doublings.
    """
    chains = cut(links.select(F.col(child).alias("node"), F.col(parent).alias("ancestor"), F.lit(1).alias("steps"), F.array(child, parent).alias("seen")))
    out, length = [chains], 1
    while True:
        whole = out[-1].filter(F.col("steps") == length)
        if not whole.head(1):
            break
        on = chains.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("next"), F.col("steps").alias("more"), F.expr("slice(seen, 2, size(seen) - 1)").alias("ahead"))
        further = whole.join(on, "ancestor").filter(~F.arrays_overlap("seen", "ahead"))
        further = cut(further.select("node", F.col("next").alias("ancestor"), (F.col("steps") + F.col("more")).alias("steps"), F.concat("seen", "ahead").alias("seen")))
        out.append(further)
        chains = chains.unionByName(further)
        length *= 2
    return chains.select("node", "ancestor", "steps")


def active(dimensions: DataFrame, chain: DataFrame, settings: DataFrame) -> DataFrame:
    """Dimensions (path) without a gate among their ancestors (node, ancestor) that settings (path, value) turn off.

    A gate that the settings don't mention isn't off.
    """
    off = settings.filter(~V.truthy(F.col("value"))).select(F.col("path").alias("ancestor"))
    dormant = chain.join(off, "ancestor", "left_semi").select(F.col("node").alias("path")).distinct()
    return dimensions.join(dormant, "path", "left_anti")


def eq_state(gates: DataFrame, group: str, value: str) -> DataFrame:
    """Three-valued and over a group's gates: false if any is off, null if none is off and any unknown, else true."""
    off, unknown = F.bool_or(~F.col(value)), F.count("*") > F.count(value)
    return gates.groupBy(group).agg(F.when(off, False).when(unknown, None).otherwise(True).alias("active"))


def topologies(options: DataFrame, group: str, dimension: str, choice: str) -> DataFrame:
    """Every combination of one choice per dimension within a group, as a map; few dimensions with few choices each.

    One fold over the group's dimensions, so the product is made row by row rather than by a cross join.
    """
    sets = options.groupBy(group, dimension).agg(F.array_sort(F.collect_set(choice)).alias("choices"))
    rows = sets.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(dimension, "choices"))).alias("dims"))
    start = F.array(F.expr("cast(array() as array<string>)"))
    grow = lambda acc, d: F.flatten(F.transform(acc, lambda a: F.transform(d["choices"], lambda c: F.array_append(a, F.concat(d[dimension].cast("string"), F.lit("="), c.cast("string"))))))
    return rows.select(group, F.explode(F.aggregate("dims", start, grow)).alias("topology"))


def unit_vectors(entries: DataFrame, group: str, order: str, value: str, low: str, high: str) -> DataFrame:
    """Each group's values on the unit interval, as an array by the order of its dimensions."""
    u = V.to_unit(F.col(value), F.col(low), F.col(high))
    return entries.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), u.alias("u")))), lambda s: s["u"]).alias("vector"))


def stable_dedupe(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key, with its place among the kept ones within the order."""
    n = F.row_number().over(W.partitionBy(key).orderBy(*order))
    return rows.withColumn("_n", n).filter("_n = 1").drop("_n")


def choices(dims: DataFrame, supported: DataFrame | None = None) -> DataFrame:
    """(path, positions, kind): the discrete controls that can be enumerated, two positions for a switch and one for each member."""
    out = dims.filter("kind = 'switch' or (kind = 'enum' and members > 0)")
    out = out if supported is None else out.join(supported, "path", "left_semi")
    return out.select("path", F.when(F.col("kind") == "switch", 2).otherwise(F.col("members")).alias("positions"), F.when(F.col("kind") == "switch", "switch").otherwise("selector").alias("kind"))


def enumeration(asked: DataFrame, known: DataFrame, run: str, budget: str, least: int = 1) -> DataFrame:
    """(run, combinations, each, error) of the controls (run, path, budget) that runs ask to enumerate.

    each is the renders left for a combination. Repeated or unknown controls, and budgets that leave fewer than least, are errors.
    """
    a = asked.join(known, "path", "left").groupBy(run).agg(
        F.count("*").alias("n"), F.count_distinct("path").alias("paths"), F.count("positions").alias("found"), F.product(F.coalesce("positions", F.lit(1))).cast("long").alias("combinations"), F.max(budget).alias("b")
    )
    each = F.floor(F.col("b") / F.col("combinations")).cast("long")
    error = F.when(F.col("n") > F.col("paths"), "a control twice").when(F.col("found") < F.col("n"), "not a choice").when(each < least, "too small a budget")
    return a.select(run, "combinations", F.when(error.isNull(), each).alias("each"), error.alias("error"))
