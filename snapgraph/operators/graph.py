"""Graph relations from occurrences: edges, dominant kind, degrees, closures, roll-ups."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snapgraph import scratch
from snapgraph.schemas import CLASS, COMPONENT, INTERFACE, METHOD, PLATFORM_METHODS, SPECULATIVE, TRIGGER


def edges(occurrences: DataFrame) -> DataFrame:
    """One row a (source, target): dominant kind, counts, the same without tests, and the first occurrence's order.

    The kind is that of most occurrences, speculative ones counting only if there
    are no others; ties go to the kind seen first. ord is any orderable column.
    """
    return _dominant(by_kind(occurrences))


def by_kind(occurrences: DataFrame) -> DataFrame:
    """(source, target, kind, n, p, first, first_p): occurrences of each kind, and those outside tests, with the first of both."""
    real = ~F.col("is_test")
    return occurrences.groupBy("source", "target", "kind").agg(F.count("*").alias("n"), F.count_if(real).alias("p"), F.min("ord").alias("first"), F.min(F.when(real, F.col("ord"))).alias("first_p"))


def of_kinds(kinds: DataFrame) -> DataFrame:
    """Edges of what `by_kind` gives; several rows of one kind are added up."""
    own = kinds.groupBy("source", "target", "kind").agg(F.sum("n").alias("n"), F.sum("p").alias("p"), F.min("first").alias("first"), F.min("first_p").alias("first_p"))
    return _dominant(own)


def _dominant(kinds: DataFrame) -> DataFrame:
    doubtful = F.col("kind").isin(*SPECULATIVE).cast("int")
    return kinds.groupBy("source", "target").agg(
        F.min_by("kind", F.struct(doubtful, -F.col("n"), "first")).alias("kind"),
        F.sum("n").alias("n_occ"),
        F.sum("p").alias("n_prod"),
        F.min_by("kind", F.when(F.col("p") > 0, F.struct(doubtful, -F.col("p"), "first_p"))).alias("kind_prod"),
        F.min("first").alias("first_ord"),
    )


#: Occurrences kept beside an edge, of those with tests and of those without.
FIRSTS = 10


def numbered_edges(occurrences: DataFrame, ends: Sequence[str], kinds: Sequence[Column], told: Sequence[str] = ()) -> DataFrame:
    """What `edges` gives, for occurrences whose ends (the columns that tell an edge) and ord are numbers or short, and whose kind is a place in `kinds`.

    kinds: few names, which may depend on the ends. All kinds of an edge are
    counted side by side in one pass over a hash table, without a sort. told:
    columns that tell an occurrence; with them the same pass, then sorted, gives
    each edge its firsts (see `firsts`).
    """
    real = ~F.col("is_test")
    counted = []
    if told:
        occurrences = occurrences.withColumn("_nth", F.row_number().over(Window.partitionBy(*ends, "is_test").orderBy("ord")))
        counted.append(F.array_sort(F.collect_list(F.when(F.col("_nth") <= FIRSTS, F.struct("ord", *told)))).alias("firsts"))
    for k in range(len(kinds)):
        own = F.col("kind") == k
        counted += [F.count_if(own).alias(f"_n{k}"), F.count_if(own & real).alias(f"_p{k}"), F.min(F.when(own, F.col("ord"))).alias(f"_first{k}"), F.min(F.when(own & real, F.col("ord"))).alias(f"_first_p{k}")]
    by = occurrences.groupBy(*ends).agg(*counted)

    def most(n: str, first: str) -> Column:
        ranked = [F.when(F.col(f"{n}{k}") > 0, F.struct(name.isin(*SPECULATIVE).alias("doubtful"), (-F.col(f"{n}{k}")).alias("n"), F.col(f"{first}{k}").alias("first"), name.alias("kind"))) for k, name in enumerate(kinds)]
        return F.array_min(F.array(*ranked)).getField("kind")

    def total(n: str) -> Column:
        return reduce(Column.__add__, [F.col(f"{n}{k}") for k in range(len(kinds))])

    first = F.array_min(F.array(*[F.col(f"_first{k}") for k in range(len(kinds))]))
    return by.select(*ends, most("_n", "_first").alias("kind"), total("_n").alias("n_occ"), total("_p").alias("n_prod"), most("_p", "_first_p").alias("kind_prod"), first.alias("first_ord"), *(["firsts"] if told else []))


def production(all_edges: DataFrame) -> DataFrame:
    """The edges as seen without tests: emptied ones go, the kind is that of what is left."""
    return all_edges.where("n_prod > 0").withColumns({"kind": F.col("kind_prod"), "n_occ": F.col("n_prod")})


def degrees(nodes: DataFrame, all_edges: DataFrame) -> DataFrame:
    """nodes with in_degree, out_degree and both without tests; all incident edges count."""
    ends = all_edges.select(F.col("source").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i"), "n_prod").unionByName(
        all_edges.select(F.col("target").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i"), "n_prod")
    )
    live = F.col("n_prod") > 0
    by = ends.groupBy("id").agg(
        F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"), F.sum(F.when(live, F.col("i")).otherwise(0)).alias("prod_in_degree"), F.sum(F.when(live, F.col("o")).otherwise(0)).alias("prod_out_degree")
    )
    names = ("in_degree", "out_degree", "prod_in_degree", "prod_out_degree")
    return nodes.drop(*names).join(by, "id", "left").withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in names})


def summary(nodes: DataFrame, all_edges: DataFrame) -> DataFrame:
    """One row of counts; methods count apart, their edges with all others; test types are included."""
    kinds = {"apex_classes": CLASS, "apex_interfaces": INTERFACE, "apex_triggers": TRIGGER, "lwc_components": COMPONENT, "apex_methods": METHOD}
    plain = F.col("type") != METHOD
    counts = nodes.agg(
        F.count_if(plain).alias("total_nodes"), *[F.count_if(F.col("type") == t).alias(n) for n, t in kinds.items()], F.count_if(plain & F.col("is_test")).alias("test_classes")
    )
    return counts.crossJoin(all_edges.agg(F.count("*").alias("total_edges")))  # one row by one row


def _fields(occurrences: DataFrame) -> list[str]:
    return [c for c in ("file", "line", "snippet", "kind", "caller_method", "detail", "is_test") if c in occurrences.columns]


def firsts(occurrences: DataFrame, limit: int = FIRSTS) -> DataFrame:
    """(source, target, firsts): each edge's first `limit` occurrences in order, and its first `limit` ones outside tests.

    Tests and others are ranked apart, so both are among at most 2 * limit rows
    an edge, and of a hot edge each task passes on no more than those (a window's
    group limit before the shuffle).
    """
    nth = F.row_number().over(Window.partitionBy("source", "target", "is_test").orderBy("ord"))
    kept = occurrences.withColumn("nth", nth).where(F.col("nth") <= limit)
    return kept.groupBy("source", "target").agg(F.array_sort(F.collect_list(F.struct("ord", *_fields(occurrences)))).alias("firsts"))


def with_firsts(all_edges: DataFrame, occurrences: DataFrame, limit: int = FIRSTS) -> DataFrame:
    """Edges with their first occurrences, to be written once; `listed` takes lists for views from them."""
    return all_edges.join(firsts(occurrences, limit), ["source", "target"])


def listed(shown: DataFrame, limit: int, include_test: bool) -> DataFrame:
    """Edges with occurrences (the first `limit`), occurrence_count and truncated; without tests those outside tests only.

    shown: edges with firsts, as `production` leaves them where tests are hidden.
    """
    if not 0 <= limit <= FIRSTS:
        raise ValueError(f"beside an edge up to {FIRSTS} occurrences are kept; all of them are in the table of occurrences")
    own = F.col("firsts") if include_test else F.filter("firsts", lambda o: ~o["is_test"])
    lists = {"occurrences": F.slice(own, 1, limit), "occurrence_count": F.col("n_occ").cast("long"), "truncated": F.col("n_occ") > limit}
    return shown.withColumns(lists).drop("firsts")


def clustered(occurrences: DataFrame) -> DataFrame:
    """Occurrences in ranges of (source, target, ord), to be written: an edge's lie in few files, a hot edge's in several."""
    return occurrences.repartitionByRange("source", "target", "ord").sortWithinPartitions("source", "target", "ord")


def first_occurrences(occurrences: DataFrame, limit: int | None) -> DataFrame:
    """(source, target, occurrences, occurrence_count, truncated): the first `limit` of each edge in order; None for all of them."""
    if limit is None:
        every = occurrences.groupBy("source", "target").agg(F.array_sort(F.collect_list(F.struct("ord", *_fields(occurrences)))).alias("occurrences"))
        return every.select("source", "target", "occurrences", F.size("occurrences").cast("long").alias("occurrence_count"), F.lit(False).alias("truncated"))
    counts = occurrences.groupBy("source", "target").agg(F.count("*").alias("n_occ"))
    return listed(counts.join(firsts(occurrences, limit), ["source", "target"]), limit, True).drop("n_occ")


def resolve_calls(calls: DataFrame, methods: DataFrame) -> DataFrame:
    """calls (class_id, callee, arity, ...) with method_id: exact arity, else the only overload, else null."""
    known = methods.select(F.col("class_id"), F.lower("name").alias("callee_lc"), "arity", "method_id").dropDuplicates(["class_id", "callee_lc", "arity"])
    single = known.groupBy("class_id", "callee_lc").agg(F.count("*").alias("overloads"), F.first("method_id").alias("only_id"), F.first("arity").alias("only_arity")).where("overloads = 1")
    calls = calls.withColumn("callee_lc", F.lower("callee"))
    exact = calls.join(known.withColumnsRenamed({"method_id": "exact_id", "arity": "exact_arity"}), (calls.class_id == known.class_id) & (calls.callee_lc == known.callee_lc) & (calls.arity == F.col("exact_arity")), "left")
    exact = exact.select(*[calls[c] for c in calls.columns], "exact_id", "exact_arity")
    out = exact.join(single, ["class_id", "callee_lc"], "left")
    return out.select(*[c for c in calls.columns if c != "callee_lc"], F.coalesce("exact_id", "only_id").alias("method_id"), F.coalesce("exact_arity", "only_arity").alias("method_arity"))


def closure(pairs: DataFrame) -> DataFrame:
    """(base, derived) of all chains of (base, derived) steps, cycles allowed; each round adds one step to the newest chains."""
    steps = scratch.keep(pairs.select("base", "derived").distinct(), "steps")
    found = new = steps
    while not new.isEmpty():
        longer = new.join(steps.select(F.col("base").alias("derived"), F.col("derived").alias("below")), "derived").select("base", F.col("below").alias("derived")).distinct()
        new = scratch.keep(longer.join(found, ["base", "derived"], "left_anti"), "longer")
        found = scratch.keep(found.union(new), "closure")
    return found


def implementers(implements: DataFrame, subclasses: DataFrame) -> DataFrame:
    """(base, derived): direct implementers and their subclasses, from (base, derived) steps and the subclass closure."""
    direct = implements.select("base", "derived")
    below = direct.alias("i").join(subclasses.alias("s"), F.col("i.derived") == F.col("s.base")).select(F.col("i.base").alias("base"), F.col("s.derived").alias("derived"))
    return direct.union(below).distinct()


def interface_names(implements: DataFrame, extends: DataFrame) -> DataFrame:
    """(type_id, name_lc, name): every interface name of a type, by its own list and what those interfaces extend; unresolved names stay.

    implements: (type_id, name); extends: (name_lc, above), an interface's
    lower-case name and one name that it extends. Names keep their case.
    """

    def keyed(names: DataFrame) -> DataFrame:
        return names.groupBy("type_id", F.lower(F.trim("name")).alias("name_lc")).agg(F.min("name").alias("name"))

    seen = scratch.keep(keyed(implements.select("type_id", "name")), "interfaces")
    frontier = seen
    while not frontier.isEmpty():
        above = keyed(frontier.join(extends, "name_lc").select("type_id", F.col("above").alias("name")))
        frontier = scratch.keep(above.join(seen, ["type_id", "name_lc"], "left_anti"), "interfaces")
        seen = scratch.keep(seen.unionByName(frontier), "interfaces")
    return seen


def platform_entries(methods: DataFrame, interfaces: DataFrame) -> DataFrame:
    """(method_id, reason) of methods that the platform calls: by interface, name, arity and first parameter's type."""
    spark = methods.sparkSession
    fixed = spark.createDataFrame(list(PLATFORM_METHODS), "name string, method string, arity int, first_param string")
    typed = methods.join(interfaces.select(F.col("type_id").alias("class_id"), F.lower(F.trim("name")).alias("interface_lc"), F.col("name").alias("interface")), "class_id")
    on = (F.col("interface_lc") == fixed["name"]) & (F.lower(typed["name"]) == fixed["method"]) & (typed["arity"] == fixed["arity"]) & (F.lower(F.trim("first_param_type")) == fixed["first_param"])
    return typed.join(F.broadcast(fixed), on).groupBy("method_id").agg(F.min(F.concat("interface", F.lit("."), typed["name"])).alias("reason"))


def fan_out(calls: DataFrame, subtypes: DataFrame, methods: DataFrame) -> DataFrame:
    """Possible further targets of calls (target_class, callee, callee_arity, ...) whose runtime type may be a subtype.

    subtypes: (base, derived, via) with via 'extends' or 'implements'; a subclass
    counts if its method says override, an implementer if it has the method.
    """
    known = methods.select(F.col("class_id").alias("derived"), F.lower("name").alias("callee_lc"), F.col("arity").alias("callee_arity"), F.col("method_id").alias("target_method"), "is_override")
    below = calls.where(~F.coalesce("exact_type", F.lit(False))).join(subtypes, F.col("target_class") == F.col("base"))
    hit = below.withColumn("callee_lc", F.lower("callee")).join(known, ["derived", "callee_lc", "callee_arity"]).where((F.col("via") == "implements") | F.col("is_override"))
    return hit.withColumn("kind", F.when(F.col("via") == "implements", SPECULATIVE[1]).otherwise(SPECULATIVE[0]))


def unresolved(references: DataFrame, symbols: DataFrame) -> DataFrame:
    """Distinct names, case kept, that no symbol (name_lc) answers."""
    return references.withColumn("name_lc", F.lower("name")).join(symbols.select("name_lc").distinct(), "name_lc", "left_anti").select("name").distinct()


def method_roll_up(methods: DataFrame) -> DataFrame:
    """Per class: dead, test-only and entry-point methods, and whether nothing keeps the class alive."""
    counted = ~F.col("is_test")
    entry = F.col("entry_point_reason").isNotNull()
    by = methods.groupBy("parent_id").agg(
        F.count_if(counted & ~entry).alias("eligible"),
        F.count_if(counted & ~entry & F.col("is_dead")).alias("dead_method_count"),
        F.count_if(counted & ~entry & F.col("is_test_only")).alias("test_only_method_count"),
        F.count_if(counted & entry).alias("entry_point_method_count"),
    )
    fully = (F.col("eligible") > 0) & (F.col("dead_method_count") == F.col("eligible")) & (F.col("entry_point_method_count") == 0)
    return by.select("parent_id", "dead_method_count", "test_only_method_count", "entry_point_method_count", fully.alias("fully_dead"))
