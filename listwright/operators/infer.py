"""Forward inference and graph fixpoints.

Loops are semi-naive: only rows new in the last round are joined again. Each round is written
once (``cut``), so a lost executor repeats one round, not the whole history.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listwright.functions import cells, vocab
from listwright.operators.grouping import SHORT, by_size
from listwright.sources.storage import cut, dealt, free, fresh, grow, table_of

SPO = ("subject", "predicate", "object")


def _add(triples: DataFrame, only_new: bool, *made: DataFrame) -> DataFrame:
    """The given and the derived triples, each once; ``only_new`` gives the derived ones, unshuffled,
    for a caller that puts several steps together and removes copies once."""
    if only_new:
        return reduce(DataFrame.unionByName, made)
    return reduce(DataFrame.unionByName, made, triples.select(*SPO)).distinct()


def infer_part_of(
    triples: DataFrame, top_of: str = vocab.SKOS + "topConceptOf", part_of: str = vocab.DCT + "isPartOf",
    only_new: bool = False,
) -> DataFrame:
    """Top concepts of a scheme that is part of a set are part of that set too."""
    tops = triples.where(F.col("predicate") == top_of).select("subject", F.col("object").alias("scheme"))
    sets = triples.where(F.col("predicate") == part_of).select(F.col("subject").alias("scheme"), "object")
    made = tops.join(sets, "scheme").select("subject", F.lit(part_of).alias("predicate"), "object")
    return _add(triples, only_new, made)


def infer_inverse(
    triples: DataFrame, pairs: Sequence[tuple[str, str]] = vocab.INVERSE_PAIRS, only_new: bool = False
) -> DataFrame:
    both = [(a, b) for a, b in pairs] + [(b, a) for a, b in pairs]
    table = table_of(triples.sparkSession, both, "predicate string, inverse string")
    made = triples.join(table, "predicate").select(
        F.col("object").alias("subject"), F.col("inverse").alias("predicate"), F.col("subject").alias("object")
    )
    return _add(triples, only_new, made)


def infer_subproperty(
    triples: DataFrame, pairs: Sequence[tuple[str, str]] = vocab.SUBPROPERTY_PAIRS, only_new: bool = False
) -> DataFrame:
    table = table_of(triples.sparkSession, list(pairs), "predicate string, wider string")
    made = triples.join(table, "predicate").select("subject", F.col("wider").alias("predicate"), "object")
    return _add(triples, only_new, made)


def infer_scheme_membership(
    triples: DataFrame,
    top_of: str = vocab.SKOS + "topConceptOf",
    in_scheme: str = vocab.IN_SCHEME,
    concept: str = vocab.SKOS + "Concept",
    only_new: bool = False,
) -> DataFrame:
    """Top concepts are in their scheme, and are concepts."""
    tops = triples.where(F.col("predicate") == top_of)
    member = tops.select("subject", F.lit(in_scheme).alias("predicate"), "object")
    typed = tops.select("subject", F.lit(vocab.RDF_TYPE).alias("predicate"), F.lit(concept).alias("object"))
    return _add(triples, only_new, member, typed)


def transitive_closure(edges: DataFrame, max_iter: int | None = None) -> DataFrame:
    """All ``(src, dst)`` with a path from src to dst.

    New pairs are joined with all known ones, so path lengths double and a chain of length n
    takes about log2(n) rounds.
    """
    known = delta = cut(edges.select("src", "dst").distinct())
    rounds = 0
    while max_iter is None or rounds < max_iter:
        rest = known.select(F.col("src").alias("dst"), F.col("dst").alias("far"))
        longer = delta.join(rest, "dst").select("src", F.col("far").alias("dst")).distinct()
        delta = cut(longer.join(known, ["src", "dst"], "left_anti"))
        if delta.isEmpty():
            break
        rounds += 1
        known = grow(known, delta, rounds)
    return known


@dataclass(frozen=True)
class Rule:
    """``body`` patterns imply ``head`` patterns; terms starting with ``?`` are variables."""

    body: tuple[tuple[str, str, str], ...]
    head: tuple[tuple[str, str, str], ...]


def _bind(triples: DataFrame, pattern: tuple[str, str, str]) -> DataFrame:
    """Rows of ``triples`` that match a pattern, one column per variable."""
    seen: dict[str, str] = {}
    for name, term in zip(SPO, pattern):
        if not term.startswith("?"):
            triples = triples.where(F.col(name) == term)
        elif term in seen:
            triples = triples.where(F.col(name) == F.col(seen[term]))
        else:
            seen[term] = name
    return triples.select(*[F.col(c).alias(v) for v, c in seen.items()])


def _fire(rule: Rule, sources: Sequence[DataFrame]) -> DataFrame:
    bound = _bind(sources[0], rule.body[0])
    for pattern, source in zip(rule.body[1:], sources[1:]):
        right = _bind(source, pattern)
        shared = [c for c in bound.columns if c in right.columns]
        if not shared:
            raise ValueError(f"pattern {pattern} shares no variable with the patterns before it")
        bound = bound.join(right, shared)
    heads = [
        bound.select(*[(F.col(t) if t.startswith("?") else F.lit(t)).alias(n) for n, t in zip(SPO, h)])
        for h in rule.head
    ]
    return reduce(DataFrame.unionByName, heads)


def _chain(rule: Rule, rules: Sequence[Rule]) -> tuple[str, str] | None:
    """``(p, q)`` of a rule ``x p y, y q z -> x p z`` that is the only such one for p, where no rule derives q."""
    def ends(r: Rule) -> tuple[str, str] | None:
        if len(r.body) != 2 or len(r.head) != 1:
            return None
        (x, p, y), (y2, q, z) = r.body
        apart = len({x, y, z}) == 3 and all(v.startswith("?") for v in (x, y, z))
        fixed = not p.startswith("?") and not q.startswith("?") and p != q
        return (p, q) if apart and fixed and y == y2 and r.head[0] == (x, p, z) else None

    found = ends(rule)
    heads = {h[1] for r in rules for h in r.head}
    if found is None or found[1] in heads or any(h.startswith("?") for h in heads):
        return None
    return found if sum(1 for r in rules if (ends(r) or ("",))[0] == found[0]) == 1 else None


def _along(pairs: DataFrame, hops: DataFrame) -> DataFrame:
    """``pairs (subject, object)`` and all that their objects lead to by ``hops``, of which each node has at most one.

    Hops are put together in every round, so ways of n hops take about log2(n) rounds and no table of hops
    grows. A hop back to its own node leads to nothing that is not found.
    """
    found = cut(pairs.distinct())
    n = found.count()
    while n:
        hops = hops.where("subject <> object")
        if hops.isEmpty():
            break
        step = hops.select(F.col("subject").alias("object"), F.col("object").alias("_far")).hint("merge")
        further = found.join(step, "object").select("subject", F.col("_far").alias("object"))
        found = cut(found.unionByName(further).distinct())
        before, n = n, found.count()
        if n == before:
            break
        hops = cut(hops.join(step, "object").select("subject", F.col("_far").alias("object")))
    return found


def _followed(delta: DataFrame, known: DataFrame | None, chains: dict[str, DataFrame]) -> DataFrame:
    """``delta`` with all that its triples lead to along chains and that is not in ``known``."""
    for p, hops in chains.items():
        pairs = delta.where(F.col("predicate") == p).select("subject", "object")
        if pairs.isEmpty():
            continue
        reached = _along(pairs, hops)
        if known is not None:
            old = known.where(F.col("predicate") == p).select("subject", "object")
            reached = reached.join(old, ["subject", "object"], "left_anti")
        made = reached.select("subject", F.lit(p).alias("predicate"), "object")
        delta = delta.where(F.col("predicate").isNull() | (F.col("predicate") != p)).unionByName(made)
    return cut(delta) if chains else delta


def apply_rules(triples: DataFrame, rules: Sequence[Rule], max_iter: int | None = None) -> DataFrame:
    """All triples that follow from ``triples`` by the rules, the given ones included.

    A rule fires for a place in its body only when the last round gave triples with that place's
    predicate; places before it read what was known before that round, so nothing is derived twice.
    Only triples with a predicate that some rule derives are looked at to tell what is new.

    A rule that follows a given predicate step by step, as in ``x above y, y wider z -> x above z``, is followed to its
    end at once where each node has at most one ``wider``, unless rounds are counted (``max_iter``).
    """
    known = cut(triples.select(*SPO).distinct())
    asked = {p[1] for rule in rules for p in rule.body}
    given = {p[1] for rule in rules for p in rule.head}
    chains, plain = {}, []
    for rule in rules:
        found = _chain(rule, rules) if max_iter is None else None
        hops = None if found is None else known.where(F.col("predicate") == found[1]).select("subject", "object")
        if hops is None or not hops.groupBy("subject").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
            plain.append(rule)
        else:
            chains[found[0]] = hops
    known = delta = _followed(known, None, chains)
    before = None
    rounds = 0
    while max_iter is None or rounds < max_iter:
        fresh = _predicates(delta, asked)
        made = [
            _fire(rule, [delta if i == at else before if i < at else known for i in range(len(rule.body))])
            for rule in plain
            for at in range(len(rule.body))
            if (rule.body[at][1].startswith("?") or rule.body[at][1] in fresh) and (at == 0 or before is not None)
        ]
        if not made:
            break
        new = reduce(DataFrame.unionByName, made).distinct()
        old = known if any(p.startswith("?") for p in given) else known.where(F.col("predicate").isin(*given))
        delta = cut(new.join(old, list(SPO), "left_anti"))
        if delta.isEmpty():
            break
        delta = _followed(delta, known, chains)
        rounds += 1
        before, known = known, grow(known, delta, rounds)
    return known


def _predicates(triples: DataFrame, asked: set[str]) -> set[str]:
    """Which of the asked predicates occur; at most as many rows as the rules name."""
    named = [p for p in asked if not p.startswith("?")]
    found = triples.where(F.col("predicate").isin(*named)).select("predicate").distinct().collect() if named else []
    return {r["predicate"] for r in found}


def standard_rules() -> list[Rule]:
    """Part-of, inverse, sub-property and membership steps, and transitivity, as rules."""
    top_of, part_of = vocab.SKOS + "topConceptOf", vocab.DCT + "isPartOf"
    out = [
        Rule((("?c", top_of, "?s"), ("?s", part_of, "?set")), (("?c", part_of, "?set"),)),
        Rule((("?c", top_of, "?s"),), (("?c", vocab.IN_SCHEME, "?s"), ("?c", vocab.RDF_TYPE, vocab.SKOS + "Concept"))),
    ]
    both = [*vocab.INVERSE_PAIRS, *[(b, a) for a, b in vocab.INVERSE_PAIRS]]
    out += [Rule((("?x", a, "?y"),), (("?y", b, "?x"),)) for a, b in both]
    out += [Rule((("?x", a, "?y"),), (("?x", b, "?y"),)) for a, b in vocab.SUBPROPERTY_PAIRS]
    for p in (vocab.SKOS + "broaderTransitive", vocab.SKOS + "narrowerTransitive"):
        out.append(Rule((("?x", p, "?y"), ("?y", p, "?z")), (("?x", p, "?z"),)))
    return out


def related_components(edges: DataFrame, group_col: str, short: int = SHORT) -> DataFrame:
    """``(group, node, component)``: undirected components inside each sibling set.

    ``edges (group, a, b)``. The component is named by its least node. Sibling sets with few
    edges, the usual case, are merged inside one short array.
    """
    g = group_col
    few, many = by_size(edges.select(g, "a", "b"), [g], short)
    found = _short_components(few, g)
    return found if many is None else found.unionByName(_long_components(many, g))


def _short_components(edges: DataFrame, g: str) -> DataFrame:
    """Edge by edge, the sets that hold one of its ends become one set."""
    grouped = edges.groupBy(g).agg(F.collect_set(F.array("a", "b")).alias("_e"))

    def join_sets(sets, edge):
        def touched(s):
            return F.arrays_overlap(s, edge)

        merged = F.array_distinct(F.concat(edge, F.flatten(F.filter(sets, touched))))
        return F.concat(F.filter(sets, lambda s: ~touched(s)), F.array(merged))

    sets = F.aggregate("_e", F.slice("_e", 1, 0), join_sets)
    return grouped.select(g, F.explode(sets).alias("_s")).select(
        g, F.explode("_s").alias("node"), F.array_min("_s").alias("component")
    )


def _long_components(edges: DataFrame, g: str) -> DataFrame:
    """Randomised contraction: in each round every node follows the node of least hash that it can see, itself
    included, and the graph of the nodes that are followed goes on. About half of the nodes go in a round,
    whatever the shape, so all rounds together cost a few times the first. The ways are then followed back."""
    # An edge is kept once, from its lesser end, and packed: checkpoints hold rows as they are in memory.
    turned = F.col("a") > F.col("b")
    pairs = edges.select(g, F.when(turned, F.col("b")).otherwise(F.col("a")).alias("u"), F.when(turned, F.col("a")).otherwise(F.col("b")).alias("v"))
    # A number of partitions of its own: ends are packed well on disk and not in memory.
    state = fresh(dealt(pairs, g, "u", "v").distinct())
    everyone = _both_ways(state, g).select(g, "u").distinct()
    state = state.where("u <> v")
    ways = []
    while not state.isEmpty():
        number = F.lit(len(ways))
        seen = F.least(F.struct(F.xxhash64(number, "v"), "v"), F.struct(F.xxhash64(number, "u").alias("col1"), F.col("u").alias("v")))
        # Nodes that follow themselves stay and need no row.
        way = fresh(_both_ways(state, g).groupBy(g, "u").agg(F.min(seen)["v"].alias("to")).where("u <> to"))
        free(way.sparkSession)
        ways.append(way)
        moved = state.hint("merge")
        for end in ("u", "v"):
            moved = moved.join(way.select(g, F.col("u").alias(end), F.col("to").alias(f"_{end}")), [g, end], "left").hint("merge")
        moved = moved.select(g, F.coalesce("_u", "u").alias("u"), F.coalesce("_v", "v").alias("v")).where("u <> v")
        state = fresh(moved.select(g, F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
        del moved
        free(way.sparkSession)
    if not ways:
        return everyone.select(g, F.col("u").alias("node"), F.col("u").alias("component"))
    last = ways.pop()
    for way in reversed(ways):
        further = last.select(g, F.col("u").alias("to"), F.col("to").alias("_far"))
        moved = way.hint("merge").join(further, [g, "to"], "left").select(g, "u", F.coalesce("_far", "to").alias("to"))
        later = last.hint("merge").join(way.select(g, "u"), [g, "u"], "left_anti")
        last = fresh(moved.unionByName(later))
        del moved, later, further
        free(way.sparkSession)
    last = last.where("u <> to")
    # Only components whose node of all ways is not their least one are named anew.
    names = fresh(last.groupBy(g, "to").agg(F.min("u").alias("component")).where("component < to"))
    named = last.hint("merge").join(names, [g, "to"], "left").select(g, "u", F.coalesce("component", "to").alias("component"))
    named = fresh(named.unionByName(names.select(g, F.col("to").alias("u"), "component")))
    free(named.sparkSession)
    found = everyone.where(F.col(g).isNotNull() & F.col("u").isNotNull()).hint("merge").join(named, [g, "u"], "left")
    return found.select(g, F.col("u").alias("node"), F.coalesce("component", "u").alias("component"))


def _both_ways(edges: DataFrame, g: str) -> DataFrame:
    return edges.select(g, "u", "v").unionByName(edges.select(g, F.col("v").alias("u"), F.col("u").alias("v")))


def scheme_links(tops: DataFrame, members: DataFrame, see_also: DataFrame, schemes: DataFrame) -> DataFrame:
    """``(scheme, pos, target)``: schemes a scheme leads to, its top concepts' links first.

    ``tops (scheme, pos, concept)``, ``members (scheme, pos, concept)``, ``see_also (src, pos, ref)``.
    """
    holders = tops.select("scheme", "concept", F.array(F.lit(0).cast("long"), F.col("pos").cast("long")).alias("k"))
    holders = holders.unionByName(
        members.select("scheme", "concept", F.array(F.lit(1).cast("long"), F.col("pos").cast("long")).alias("k"))
    )
    hits = see_also.join(schemes.select(F.col("id").alias("ref")), "ref", "left_semi")
    return (
        holders.join(hits, F.col("concept") == F.col("src"))
        .select("scheme", F.concat("k", F.array(see_also["pos"].cast("long"))).alias("pos"), F.col("ref").alias("target"))
        .groupBy("scheme", "target")
        .agg(F.min("pos").alias("pos"))
    )


def scheme_reachability(themes: DataFrame, links: DataFrame) -> DataFrame:
    """``(theme, scheme, depth, path)`` of every scheme a theme reaches; all themes at once.

    ``themes (theme, scheme)`` gives the first scheme, ``links (scheme, pos, target)`` the next
    ones. Sorted by ``(depth, path)`` the rows are in discovery order; the last is the leaf.
    """
    start = themes.select(
        "theme", "scheme", F.lit(0).alias("depth"), F.array().cast("array<array<bigint>>").alias("path")
    )
    found = frontier = cut(start)
    # Merged in all rounds: by the bytes of the files that links and found schemes come from, Spark would take them for
    # few and send them through the driver to every task, round after round.
    step = links.select("scheme", F.col("pos").alias("_pos"), "target").hint("merge")
    depth = 0
    while True:
        depth += 1
        seen = (
            frontier.join(step, "scheme")
            .groupBy("theme", F.col("target").alias("scheme"))
            .agg(F.min(F.concat("path", F.array("_pos"))).alias("path"))
        )
        frontier = cut(
            seen.join(found.hint("merge"), ["theme", "scheme"], "left_anti").select(
                "theme", "scheme", F.lit(depth).alias("depth"), "path"
            )
        )
        if frontier.isEmpty():
            return found
        found = grow(found, frontier, depth)


def leaf_schemes(reached: DataFrame) -> DataFrame:
    """The scheme each theme discovered last."""
    return reached.groupBy("theme").agg(F.max_by("scheme", F.struct("depth", "path")).alias("leaf"))


def contained_pairs(needles: DataFrame, haystacks: DataFrame) -> DataFrame:
    """``(needle, haystack)`` where the needle occurs in the haystack.

    Every substring of a haystack that is as long as some needle is an equi-join key, so no
    pair is formed that does not match. ``needles (needle)`` and ``haystacks (haystack)`` are ids.
    """
    distinct = needles.where("needle <> ''").distinct()
    lengths = sorted(r["n"] for r in distinct.select(F.length("needle").alias("n")).distinct().collect())
    if not lengths:
        return distinct.withColumn("haystack", F.col("needle")).limit(0)
    size = F.length("haystack")
    cuts = F.flatten(
        F.transform(
            F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= size),
            lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.substring("haystack", i, n)),
        )
    )
    pieces = haystacks.distinct().select("haystack", F.explode(F.array_distinct(cuts)).alias("needle"))
    return pieces.join(distinct, "needle").select("needle", "haystack")


def bridge_schemes(reached: DataFrame, see_also: DataFrame, schemes: DataFrame) -> DataFrame:
    """Adds schemes that concepts with a similar id point at, until nothing is added.

    A concept is similar to a scheme when the scheme's id contains the concept's prefix, or the
    concept's id contains the scheme's local name, hyphens and underscores alike.
    """
    ids = schemes.select(F.col("id").alias("ref")).distinct()
    links = see_also.join(ids, "ref", "left_semi").select(
        F.translate("src", "-", "_").alias("concept"), F.col("ref").alias("target")
    ).distinct()
    known = ids.select(F.col("ref").alias("scheme"), F.translate("ref", "-", "_").alias("norm"))
    by_prefix = contained_pairs(
        links.select(F.substring_index("concept", ":", 1).alias("needle")), known.select(F.col("norm").alias("haystack"))
    ).select(F.col("needle").alias("prefix"), F.col("haystack").alias("norm"))
    by_local = contained_pairs(
        known.select(F.substring_index("norm", ":", -1).alias("needle")), links.select(F.col("concept").alias("haystack"))
    ).select(F.col("needle").alias("local"), F.col("haystack").alias("concept"))
    first = links.withColumn("prefix", F.substring_index("concept", ":", 1)).join(by_prefix, "prefix").join(known, "norm")
    second = links.join(by_local, "concept").join(
        known.withColumn("local", F.substring_index("norm", ":", -1)), "local"
    )
    step = first.select("scheme", "target").unionByName(second.select("scheme", "target")).distinct()
    step = cut(step.select("scheme", F.lit(None).cast("array<bigint>").alias("_pos"), "target"))
    found = frontier = reached.select("theme", "scheme", "depth", "path")
    last = reached.groupBy("theme").agg(F.max("depth").alias("_deep"))
    rounds = 0
    while True:
        rounds += 1
        seen = frontier.join(step, "scheme").select("theme", F.col("target").alias("scheme")).distinct()
        frontier = cut(
            seen.join(found, ["theme", "scheme"], "left_anti")
            .join(last, "theme")
            .select("theme", "scheme", (F.col("_deep") + rounds).alias("depth"),
                    F.array().cast("array<array<bigint>>").alias("path"))
        )
        if frontier.isEmpty():
            return found
        found = grow(found, frontier, rounds)


def resolve_all_themes(
    schemes: DataFrame, tops: DataFrame, see_also: DataFrame, concepts: DataFrame, pattern: str = vocab.THEME_PATTERN
) -> DataFrame:
    """``(label, theme, scheme)`` of every theme of the theme scheme.

    ``schemes (id, pos)``, ``tops (scheme, pos, concept)``, ``see_also (src, pos, ref)``,
    ``concepts (id, pref_label)``. Of several schemes named like the pattern, the first whose top
    concepts all link on is taken. Of themes with one label the last stands.
    """
    named = schemes.where(F.lower("id").contains(pattern))
    linked = see_also.select(F.col("src").alias("concept")).distinct().withColumn("linked", F.lit(True))
    per_scheme = (
        tops.join(named.select(F.col("id").alias("scheme")), "scheme", "left_semi")
        .join(linked, "concept", "left")
        .groupBy("scheme")
        .agg(F.bool_and(F.coalesce("linked", F.lit(False))).alias("complete"))
    )
    ranked = named.join(per_scheme, F.col("id") == F.col("scheme"), "left").select(
        "id", F.struct(~F.coalesce("complete", F.lit(False)), F.col("pos")).alias("rank")
    )
    chosen = ranked.agg(F.min_by("id", "rank").alias("scheme"))
    targets = schemes.select(F.col("id").alias("ref"))
    first = (
        see_also.join(targets, "ref", "left_semi").groupBy("src").agg(F.min_by("ref", "pos").alias("first_scheme"))
    )
    themes = (
        tops.join(F.broadcast(chosen), "scheme")
        .join(concepts.select(F.col("id").alias("concept"), "pref_label"), "concept")
        .join(first, F.col("concept") == F.col("src"))
        .withColumn("label", F.coalesce(F.nullif("pref_label", F.lit("")), cells.slug("concept")))
    )
    return themes.groupBy("label").agg(
        F.max_by("concept", "pos").alias("theme"), F.max_by("first_scheme", "pos").alias("scheme")
    )


def deepest_wins(fields: DataFrame, by: Sequence[str], flag: str, depth: str, order: Sequence[str]) -> DataFrame:
    """Of the flagged rows of a group only the deepest stays, the first of equals; others all stay."""
    flagged = F.coalesce(F.col(flag), F.lit(False))
    winners = (
        fields.where(flagged)
        .groupBy(*by)
        .agg(F.min_by(F.struct(*fields.columns), F.struct(-F.col(depth), *order)).alias("w"))
        .select("w.*")
    )
    return fields.where(~flagged).unionByName(winners)


def compose_theme_fields(chain: DataFrame, tops: DataFrame, fields: DataFrame) -> DataFrame:
    """Fields of every theme: the mapped top concepts of its schemes, in chain order.

    ``chain (theme, scheme, ord)``, ``tops (scheme, pos, concept)``, ``fields (concept, is_feature, …)``.
    Of several features of interest the one whose own scheme (``in_scheme``, where the fields have
    it) is deepest in the chain stays.
    """
    joined = chain.join(tops, "scheme").join(fields, "concept")
    if "in_scheme" not in fields.columns:
        return deepest_wins(joined, ["theme"], "is_feature", "ord", ["ord", "pos"])
    own = chain.select("theme", F.col("scheme").alias("in_scheme"), F.col("ord").alias("_deep"))
    placed = joined.join(own, ["theme", "in_scheme"], "left").withColumn("_deep", F.coalesce("_deep", F.lit(-1)))
    return deepest_wins(placed, ["theme"], "is_feature", "_deep", ["ord", "pos"]).drop("_deep")
