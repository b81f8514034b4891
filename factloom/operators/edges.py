"""Typed edges between entities: building, checking, looking up, and linking to facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators.profile import sliced_lists
from factloom.operators.ranges import in_range, running, splitters
from factloom.operators.resolution import numbered, resolve_exact
from factloom.session import ensure_checkpoint_dir, sent_if_small


def edges_observed(obs: DataFrame, index: DataFrame) -> DataFrame:
    """Columns from_id, to_id and src: one edge for each observation that resolves; blank kinds give none."""
    rows = resolve_exact(obs.where(F.trim("kind") != ""), "subject", index)
    return rows.where("entity_id is not null").select(F.col("entity_id").alias("from_id"), F.concat(F.lit("ch:"), F.col("position").cast("string")).alias("to_id"), F.col("kind").alias("src"))


def edges_relation(rows: DataFrame, vocabulary: DataFrame, index: DataFrame) -> DataFrame:
    """Columns from_id, to_id, relation, position, note and outcome of rows (a, b, relation, cite).

    Relations map by ``vocabulary`` (word, relation); unknown ones are skipped, as are those mapped to null, and rows
    of which an end has no entity are unresolved. A citation ``Chapter N`` becomes a position, another one a note.
    """
    ix = index.select("alias_key", "entity_id")
    both = rows.join(sent_if_small(vocabulary.withColumn("_known", F.lit(True)).withColumnRenamed("relation", "_relation")), F.lower("relation") == F.col("word"), "left")
    both = both.join(ix.select(F.col("alias_key").alias("_ka"), F.col("entity_id").alias("from_id")), F.lower(F.trim("a")) == F.col("_ka"), "left")
    both = both.join(ix.select(F.col("alias_key").alias("_kb"), F.col("entity_id").alias("to_id")), F.lower(F.trim("b")) == F.col("_kb"), "left")
    position = F.regexp_extract("cite", r"Chapter (\d+)", 1).try_cast("int")
    outcome = F.when(F.col("_known").isNull(), "unknown-relation").when(F.col("_relation").isNull(), "no-relation").when(F.col("from_id").isNull() | F.col("to_id").isNull(), "unresolved").otherwise("edge")
    return both.select("from_id", "to_id", F.col("_relation").alias("relation"), position.alias("position"), F.when(position.isNull(), F.col("cite")).alias("note"), outcome.alias("outcome"))


def edges_relation_facts(rows: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Columns subject, predicate, value and tier: canon with a chapter cited, likely with another source, else speculation."""
    mapped = rows.join(sent_if_small(vocabulary.withColumnRenamed("relation", "predicate")), F.lower("relation") == F.col("word")).where("predicate is not null")
    cite = F.trim(F.coalesce("cite", F.lit("")))
    tier = F.when(cite.rlike(r"Chapter \d+"), "canon").when((cite == "") | F.lower(cite).contains("alleged"), "speculation").otherwise("likely")
    return mapped.select(F.col("a").alias("subject"), "predicate", F.col("b").alias("value"), tier.alias("tier"))


def edges_member_of(members: DataFrame, index: DataFrame, left: tuple[str, ...] = ("former", "left", "expelled")) -> DataFrame:
    """Columns from_id, to_id, current and role of members (member, group_id, status)."""
    rows = resolve_exact(members, "member", index).where("entity_id is not null")
    role = F.when(~F.col("status").isin("current", *left), F.col("status"))
    return rows.select(F.col("entity_id").alias("from_id"), F.col("group_id").alias("to_id"), (~F.col("status").isin(*left)).alias("current"), role.alias("role"))


def edges_current_user(items: DataFrame) -> DataFrame:
    """Columns from_id, to_id, current, position and had_others of found items (item_id, user_id, position, previous) with a user."""
    used = items.where(F.col("found") & F.col("user_id").isNotNull())
    return used.select(F.col("user_id").alias("from_id"), F.col("item_id").alias("to_id"), F.lit(True).alias("current"), "position", (F.size(F.coalesce("previous", F.array())) > 0).alias("had_others"))


def edges_owns(chains: DataFrame, index: DataFrame, skip: tuple[str, ...] = ("unknown",)) -> DataFrame:
    """Columns item_id, from_id, from_owner and current of links (item_id, pos, owner, current).

    The owner before is the link before, if that one resolved. Names in ``skip`` are passed over without a trace.
    """
    rows = resolve_exact(chains.where(~F.lower("owner").isin(*skip)), "owner", index)
    before = F.lag("entity_id").over(Window.partitionBy("item_id").orderBy("pos"))
    return rows.withColumn("from_owner", before).where("entity_id is not null").select("item_id", F.col("entity_id").alias("from_id"), "from_owner", "current")


def new_credits(credits: DataFrame, known: DataFrame, start: int, prefix: str = "va") -> DataFrame:
    """Columns credit_key, credit_id and name of the credits (credit, and ordinal where there is a source order) that ``known``
    (credit_key) lacks: registry rows, whose ids ``resolution.raised_counters`` then takes.

    Spellings that differ in case are one credit. With an ordinal, ids are given in the order in which credits first come, and
    the first spelling is the name; without one, ids go by the folded name, and the least spelling is the name.
    """
    key = F.lower(F.trim("credit")).alias("credit_key")
    placed = "ordinal" in credits.columns
    order = F.struct("ordinal", F.trim("credit").alias("name")) if placed else F.struct(F.trim("credit").alias("name"))
    fresh = credits.where(F.trim("credit") != "").groupBy(key).agg(F.min(order).alias("_f")).join(known.select("credit_key"), "credit_key", "left_anti")
    if placed:
        numbers = numbered(fresh.select("credit_key", "_f.name", F.col("_f.ordinal").cast("long").alias("_o")), "_o", start, "_n")
    else:
        # ids are given in the order of names, which has no numbers of its own: ranges of it are counted
        ranged = fresh.select("credit_key", "_f.name").repartitionByRange("credit_key").withColumn("_part", F.spark_partition_id()).checkpoint()
        starts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows")).select("_part", F.coalesce(F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
        within = F.row_number().over(Window.partitionBy("_part").orderBy("credit_key"))
        numbers = ranged.withColumn("_n", within).join(F.broadcast(starts), "_part").withColumn("_n", F.col("_n") + F.col("_start") + start - 1)  # a row for each partition
    return numbers.select("credit_key", F.concat(F.lit(prefix + ":"), F.lpad(F.col("_n").cast("string"), 5, "0")).alias("credit_id"), "name")


def edges_credits(credits: DataFrame, known: DataFrame, start: int, prefix: str = "va") -> DataFrame:
    """Columns credit_id, subject and lang of credits (credit, subject, lang): one edge each, whatever the case.

    ``known`` has credit_key and credit_id; unseen credits get the ids of ``new_credits``.
    """
    ensure_checkpoint_dir(credits.sparkSession)
    once = credits.select(F.lower(F.trim("credit")).alias("credit_key"), "subject", "lang").where("credit_key <> ''").distinct()
    ids = new_credits(credits, known, start, prefix).select("credit_key", "credit_id").unionByName(known.select("credit_key", "credit_id"))
    return once.join(ids, "credit_key").select("credit_id", "subject", "lang")


def edges_set_in(arcs: DataFrame, places: DataFrame, overrides: DataFrame) -> DataFrame:
    """Columns arc, place_id and how: the place of an arc's slug, else of its override's."""
    p = places.select(F.col("slug").alias("_slug"), F.col("place_id"))
    own = arcs.join(p, arcs["slug"] == p["_slug"], "left").select("arc", "slug", F.col("place_id").alias("_own"))
    more = own.join(overrides.select(F.col("arc_slug"), F.col("place_slug")), F.col("slug") == F.col("arc_slug"), "left").join(p, F.col("place_slug") == p["_slug"], "left")
    found = F.coalesce("_own", "place_id")
    return more.select("arc", found.alias("place_id"), F.when(F.col("_own").isNotNull(), "slug").when(found.isNotNull(), "override").otherwise("none").alias("how"))


def _listed(rows: DataFrame, columns: list[str], sizes: DataFrame, per: int) -> DataFrame:
    """Columns grp, _block and _items: rows (grp, columns) in lists of ``per``, numbered within a group; ``sizes`` has each group's _rows.

    Rows are numbered within parts of a group of about 64 lists, by a hash, so that no task numbers a whole one. All lists of a part but its
    last one are full.
    """
    parts = F.greatest(F.ceil(F.col("_rows") / (64 * per)), F.lit(1))
    rows = rows.join(sizes.select("grp", "_rows"), "grp").select("grp", *columns, F.pmod(F.xxhash64(*columns), parts).alias("_part"))
    at = F.row_number().over(Window.partitionBy("grp", "_part").orderBy(*columns)) - 1
    lists = rows.withColumn("_list", F.floor(at / per)).groupBy("grp", "_part", "_list").agg(F.collect_list(F.struct(*columns)).alias("_items"))
    counts = rows.groupBy("grp", "_part").agg(F.ceil(F.count(F.lit(1)) / per).alias("_lists"))
    before = F.sum("_lists").over(Window.partitionBy("grp").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("grp", "_part", F.coalesce(before, F.lit(0)).alias("_start"))
    return lists.join(starts, ["grp", "_part"]).select("grp", (F.col("_start") + F.col("_list")).alias("_block"), "_items")


def edges_fan_out(assets: DataFrame, members: DataFrame, block: int = 1024) -> DataFrame:
    """Columns from_id, to_id, current and note of assets (grp, asset) and members (grp, member, current).

    Every member of a group has every asset of it; with a single asset the flag carries over, else a note says so. The rows are
    as many as that makes: lists of 256 members meet lists of ``block`` assets, and are laid out where they meet. A group's
    lists go to as many tasks as its share of the rows, side by side, and a list of assets is repeated for each member of a list: written
    so, rows pack into a small part of what they take in any order.
    """
    spark = members.sparkSession
    ensure_checkpoint_dir(spark)
    one = F.count(F.lit(1))
    sizes = assets.groupBy("grp").agg(one.alias("_n")).join(members.groupBy("grp").agg(one.alias("_m")), "grp")
    sizes = running(sizes.select("*", F.xxhash64("grp").alias("_h"), (F.col("_n") * F.col("_m")).alias("_w")), [], "_h", "_w", "_end").drop("_h").checkpoint()
    total = sizes.agg(F.max("_end")).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(100_000, total >> 26))
    lists = _listed(assets, ["asset"], sizes.withColumnRenamed("_n", "_rows"), block).withColumnRenamed("_items", "_assets").checkpoint()
    blocks = sizes.join(lists.groupBy("grp").agg(one.alias("_blocks")), "grp")
    note = F.when(F.col("_n") > 1, F.concat(F.lit("one of "), F.col("_n").cast("string"))).alias("note")
    held = _listed(members, ["member", "current"], sizes.withColumnRenamed("_m", "_rows"), 256).join(sent_if_small(blocks), "grp")
    spans = held.withColumn("_span", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_blocks") - 1) / 16))))
    place = F.col("_end") - F.col("_w").cast("double") * (F.pmod(F.xxhash64("_block", "_span"), F.lit(1 << 20)) + 1) / (1 << 20)
    task = F.least(F.floor(place / max(1, total) * tasks), F.lit(tasks - 1)).cast("int")
    dealt = spans.select("grp", "_items", note, (F.col("_n") == 1).alias("_only"), "_span", "_blocks", task.alias("_task"))
    asked = dealt.repartitionById(tasks, F.col("_task")).select("grp", "_items", "note", "_only", F.explode(F.sequence(F.col("_span") * 16, F.least(F.col("_span") * 16 + 15, F.col("_blocks") - 1))).alias("_block"))
    asked = asked.sortWithinPartitions("grp", "_block")
    each = asked.select("grp", "_block", "note", "_only", F.explode("_items").alias("_i")).select("grp", "_block", F.col("_i.member").alias("from_id"), F.when(F.col("_only"), F.col("_i.current")).alias("current"), "note")
    both = each.join(sent_if_small(lists), ["grp", "_block"])
    return both.select("from_id", "current", "note", F.explode("_assets").alias("_a")).select("from_id", F.col("_a.asset").alias("to_id"), "current", "note")


def edges_cites(posts: DataFrame, stance: DataFrame) -> DataFrame:
    """Columns post_id, to_id and stance: distinct positions cited in posts (post_id, positions, status)."""
    tokens = F.filter(F.split("positions", r"[\s,;]+"), lambda t: t.rlike(r"^\d{1,4}$"))
    rows = posts.select("post_id", "status", F.explode(tokens).alias("_t")).select("post_id", "status", F.col("_t").cast("int").alias("_n")).distinct()
    return rows.join(sent_if_small(stance), "status", "left").select("post_id", F.concat(F.lit("ch:"), F.col("_n").cast("string")).alias("to_id"), "stance")


def lookup(edges: DataFrame, side: str, other: str, per: int | None = 1000) -> DataFrame:
    """Columns side, others (sorted) and n: what each end of the edges is tied to.

    An end with more than ``per`` others has several rows, told by ``slice``. With None, an end's others are one row,
    which is for ends that are known to have few.
    """
    if per:
        return sliced_lists(edges, side, other, per).withColumnRenamed("items", "others")
    return edges.groupBy(side).agg(F.sort_array(F.collect_list(other)).alias("others"), F.count(F.lit(1)).alias("n"))


def both_directions(edges: DataFrame) -> DataFrame:
    """Columns id, other and relation: each edge from both of its ends."""
    return edges.select(F.col("from_id").alias("id"), F.col("to_id").alias("other"), "relation").unionAll(edges.select(F.col("to_id").alias("id"), F.col("from_id").alias("other"), "relation"))


def group_dossier(members: DataFrame, names: DataFrame) -> DataFrame:
    """Columns group_id, members (names, sorted, joined), current and former of members (group_id, member_id, current)."""
    named = members.join(names, "member_id", "left")
    return named.groupBy("group_id").agg(F.array_join(F.sort_array(F.collect_set(F.coalesce("name", F.col("member_id").cast("string")))), "|").alias("members"), F.count_if("current").alias("current"), F.count_if(~F.col("current")).alias("former"))


def item_dossier(owners: DataFrame, names: DataFrame) -> DataFrame:
    """Columns item_id, owner_id, owner, current and holder of links (item_id, owner_id, current, ordinal): a row for each owner.

    ``holder`` is the item's first current owner by ordinal, null where none is current. Owners without a name
    (owner_id, name) go by their id.
    """
    first = owners.where("current").groupBy("item_id").agg(F.min_by("owner_id", "ordinal").alias("holder"))
    named = owners.join(names.select("owner_id", "name"), "owner_id", "left").join(first, "item_id", "left")
    return named.select("item_id", "owner_id", F.coalesce("name", F.col("owner_id").cast("string")).alias("owner"), "current", "holder")


def entity_dossier(shards: dict[str, DataFrame], names: DataFrame, rows_only: bool = True, debuts: DataFrame | None = None) -> DataFrame:
    """What each entity in ``names`` (entity_id, name) is tied to: a row for each item (entity_id, name, shard, item).

    A shard has (entity_id, item), or (entity_id, other_id), whose item is the other end's name, or its id where it has
    none; ``both_directions`` makes a shard of edges that count from either end. ``debuts`` (entity_id, position, kind,
    ordinal) add the columns debut and debut_kind, of the first row at the least position.

    Without ``rows_only``, one row for each entity: for each shard its count and its sorted items, which have to be few enough
    for a row. All shards are stacked and grouped once by entity, so that another shard costs no other shuffle.
    """
    stacked = None
    for shard, df in shards.items():
        other = F.col("other_id").cast("string") if "other_id" in df.columns else F.lit(None).cast("string")
        item = F.lit(None).cast("string") if "other_id" in df.columns else F.col("item").cast("string")
        rows = df.select("entity_id", F.lit(shard).alias("_shard"), item.alias("_item"), other.alias("_other"))
        stacked = rows if stacked is None else stacked.unionByName(rows)
    if any("other_id" in df.columns for df in shards.values()):
        ends = names.where("name is not null").select(F.col("entity_id").cast("string").alias("_other"), F.col("name").alias("_name"))
        stacked = stacked.join(ends, "_other", "left").withColumn("_item", F.coalesce("_item", "_name", "_other"))
    more = []
    if debuts is not None:
        first = debuts.groupBy("entity_id").agg(F.min_by(F.struct("position", "kind"), F.struct("position", "ordinal")).alias("_d"))
        names = names.join(first, "entity_id", "left").withColumns({"debut": F.col("_d.position"), "debut_kind": F.col("_d.kind")}).drop("_d")
        more = ["debut", "debut_kind"]
    if rows_only:
        return names.join(stacked, "entity_id").select("entity_id", "name", *more, F.col("_shard").alias("shard"), F.col("_item").alias("item"))
    cells = [x for s in shards for x in (F.count_if(F.col("_shard") == s).alias(f"n_{s}"), F.array_join(F.sort_array(F.collect_list(F.when(F.col("_shard") == s, F.col("_item")))), ",").alias(s))]
    out = names.join(stacked.groupBy("entity_id").agg(*cells), "entity_id", "left")
    return out.select("entity_id", "name", *more, *[F.coalesce(f"n_{s}", F.lit(0)).alias(f"n_{s}") for s in shards], *[F.coalesce(s, F.lit("")).alias(s) for s in shards])


def place_dossier(set_in: DataFrame, born_in: DataFrame, names: DataFrame) -> DataFrame:
    """Columns place_id, name, arcs, first and born: two groupings (place_id, position) and (place_id, subject) side by side."""
    a = set_in.groupBy("place_id").agg(F.count(F.lit(1)).alias("arcs"), F.min("position").alias("first"))
    b = born_in.groupBy("place_id").agg(F.count_distinct("subject").alias("born"))
    both = a.join(b, "place_id", "full").join(names, "place_id", "left")
    return both.select("place_id", "name", F.coalesce("arcs", F.lit(0)).alias("arcs"), "first", F.coalesce("born", F.lit(0)).alias("born")).where("arcs + born > 0")


def current_holder(edges: DataFrame) -> DataFrame:
    """Columns item_id, holder and current: of edges (item_id, holder, current, ordinal) the first not flagged false, else the first."""
    usable = F.coalesce("current", F.lit(True))
    best = edges.groupBy("item_id").agg(F.min_by(F.struct("holder", usable.alias("current")), F.struct((~usable).alias("f"), "ordinal")).alias("_b"))
    return best.select("item_id", F.col("_b.holder").alias("holder"), F.col("_b.current").alias("current"))


def enrich_members(members: DataFrame, records: DataFrame, curated: DataFrame, rank: Column, status_priority: Column) -> DataFrame:
    """Columns group_id, member, debut, tier and rank: curated priority (first listing wins) before that of the status.

    ``rank`` is computed from the record's role; a curated priority of 0 forces rank 0.
    """
    first = curated.groupBy("member").agg(F.min_by("priority", "ordinal").alias("_priority"))
    both = members.join(records, "member", "left").join(first, "member", "left")
    return both.select("group_id", "member", "debut", F.coalesce("_priority", status_priority).alias("tier"), F.when(F.col("_priority") == 0, 0).otherwise(rank).alias("rank"))


def enrich_edges(edges: DataFrame, names: DataFrame, end: str) -> DataFrame:
    """The edges with the name and debut of one end; unknown ends keep null."""
    return edges.join(names.withColumnRenamed("entity_id", end), end, "left")


def link_positions(edges: DataFrame, facts: DataFrame, default: Column) -> DataFrame:
    """Columns edge_id, tier, match and fact_id of edges (edge_id, entity_id, position, kind) by facts (fact_id, entity_id, position, kind, ordinal).

    The best fact of the entity wins: same position and kind (canon, exact), same position (likely, type-mismatch),
    another position (the default tier, chapter-mismatch); without a fact the default tier stands alone. Facts are
    reduced to the best of each key before they meet an edge, by equality, so that no edge sees all facts of its entity.
    """
    best = lambda *keys: facts.where(F.col("entity_id").isNotNull()).groupBy(*keys).agg(F.min(F.struct("ordinal", "fact_id")).alias(f"_by{len(keys)}"))
    keys = ("entity_id", "position", "kind")
    both = edges.select("edge_id", *keys, default.alias("_default"))
    for n in (3, 2, 1):
        both = both.join(best(*keys[:n]), list(keys[:n]), "left")
    exact, place, other = (F.col(f"_by{n}") for n in (3, 2, 1))
    tier = F.when(exact.isNotNull(), "canon").when(place.isNotNull(), "likely").otherwise(F.col("_default"))
    match = F.when(exact.isNotNull(), "exact").when(place.isNotNull(), "type-mismatch").when(other.isNotNull(), "chapter-mismatch").otherwise("none")
    return both.select("edge_id", tier.alias("tier"), match.alias("match"), F.coalesce(exact, place, other)["fact_id"].alias("fact_id"))


def value_parts(value: Column) -> Column:
    """Array of the names in a composite value like ``One · (Two)``: split at dots between spaces, without enclosing brackets."""
    def bare(x: Column) -> Column:
        x = F.trim(x)
        return F.when(x.startswith("(") & x.endswith(")"), F.trim(F.substring(x, F.lit(2), F.length(x) - 2))).otherwise(x)

    return F.filter(F.transform(F.split(value, r"\s+·\s+"), bare), lambda x: x != "")


def link_values(edges: DataFrame, facts: DataFrame, partial: bool = False, default: Column | None = None, first_only: bool = False, composite: bool = True) -> DataFrame:
    """Columns edge_id, tier, outcome and evidence of edges (edge_id, entity_id, target) by facts (fact_id, entity_id, value, tier).

    A fact matches if one of its value's names (the whole value, unless ``composite``) is the target, in any case; the
    first that does, by ``ordinal`` or else by fact_id, gives the edge its own tier. Edges whose entity has facts that all
    name others are a conflict, or partial coverage where ``partial``; those and edges without a fact get the ``default``
    tier. Where edges and facts have a ``relation``, only facts of the edge's relation count. With ``first_only`` no fact
    but an entity's first is looked at.
    """
    low = lambda c: F.lower(F.trim(c))
    keys = ["entity_id", *[k for k in ("relation",) if k in edges.columns and k in facts.columns]]
    order = F.struct(*[F.col(c) for c in ("ordinal", "fact_id") if c in facts.columns])
    facts = facts.where(" and ".join(f"{k} is not null" for k in keys)).select(*keys, order.alias("_o"), F.struct("fact_id", "tier", "value").alias("_f"))
    if first_only:
        facts = facts.groupBy(*keys).agg(F.min_by("_f", "_o").alias("_f"), F.min("_o").alias("_o"))
    names = value_parts(F.col("_f.value")) if composite else F.array_compact(F.array("_f.value"))
    parts = facts.select(*keys, "_o", "_f", F.explode(names).alias("_value"))
    hits = parts.groupBy(*keys, low(F.col("_value")).alias("_key")).agg(F.min_by("_f", "_o").alias("_best"))
    known = facts.select(*keys).distinct().withColumn("_known", F.lit(True))
    both = edges.select("edge_id", *keys, (F.lit(None).cast("string") if default is None else default).alias("_default"), low(F.col("target")).alias("_key"))
    both = both.join(hits, [*keys, "_key"], "left").join(known, keys, "left")
    outcome = F.when(F.col("_best").isNotNull(), "match").when(F.col("_known").isNull(), "no-fact").otherwise("partial" if partial else "conflict")
    return both.select("edge_id", F.when(F.col("_best").isNotNull(), F.col("_best.tier")).otherwise(F.col("_default")).alias("tier"), outcome.alias("outcome"), F.col("_best.fact_id").alias("evidence"))


def facts_without_edge(facts: DataFrame, links: DataFrame) -> DataFrame:
    """Facts that no link (evidence) names."""
    return facts.join(links.where("evidence is not null").select(F.col("evidence").alias("fact_id")), "fact_id", "left_anti")


def check_edges(edges: DataFrame, ids: DataFrame, unique: tuple[str, ...]) -> DataFrame:
    """Columns ordinal and problem of edges (shard, from_id, to_id, src, ordinal): later ones of a pair, missing and unknown ends."""
    natural = r"^(ch:\d+|arc:[a-z0-9-]+|st:vol\d{3,}-q\d{4,})$"
    known = ids.select(F.col("id").alias("_id"), F.lit(True).alias("_known"))
    rows = edges
    for end in ("from", "to"):
        rows = rows.join(known.select(F.col("_id").alias(f"{end}_id"), F.col("_known").alias(f"_{end}")), f"{end}_id", "left")
    missing = F.col("from_id").isNull() | F.col("to_id").isNull() | F.col("src").isNull()
    unknown = ~missing & (F.col("_from").isNull() & ~F.col("from_id").rlike(natural) | F.col("_to").isNull() & ~F.col("to_id").rlike(natural))
    bad = rows.select("ordinal", F.when(missing, "missing-field").when(unknown, "unknown-id").alias("problem")).where("problem is not null")
    pairs = edges.where(F.col("shard").isin(*unique) & F.col("from_id").isNotNull() & F.col("to_id").isNotNull())
    pair = Window.partitionBy("shard", F.least("from_id", "to_id"), F.greatest("from_id", "to_id")).orderBy("ordinal")
    repeated = pairs.withColumn("_n", F.row_number().over(pair)).where("_n > 1").select("ordinal", F.lit("repeated-pair").alias("problem"))
    return bad.unionByName(repeated)


def _plain_number(c: Column) -> Column:
    """A value as text, numbers in one form: 2 and 2.0 are alike, as is no other text."""
    text = c.cast("string")
    number = F.when(text.rlike(r"^-?\d{1,18}(\.\d{1,18})?$"), text.try_cast("decimal(38,18)"))
    return F.coalesce(F.regexp_replace(F.regexp_replace(number.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", ""), text)


def _whole_number(token: Column) -> Column:
    """A number that JSON text has with a point or an exponent, in plain digits as far as a decimal has them exactly."""
    small, large, double = token.try_cast("decimal(38,18)"), token.try_cast("decimal(38,0)"), token.try_cast("double")
    plain = F.regexp_replace(F.regexp_replace(small.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.coalesce(F.when(small.cast("double") == double, F.regexp_replace(plain, "^-0$", "0")), F.when(large.cast("double") == double, large.cast("string")), token)


def canonical(c: Column) -> Column:
    """A value as text in one form: JSON objects and lists with their keys sorted and their numbers plain (1.0 and 1e0 as 1) at every
    depth, lists in their order; other numbers likewise; any other text, and JSON that can't be read, as it is."""
    text = c.cast("string")

    def plain(sorted_: Column) -> Column:
        tokens = F.regexp_extract_all(sorted_, F.lit(r'("(?:[^"\\]|\\.)*"|-?[0-9][0-9.]*(?:E-?[0-9]+)?|[^"0-9-]+|-)'), F.lit(1))
        told = F.array_join(F.transform(tokens, lambda t: F.when(t.rlike(r"^-?[0-9.]+(E.*|\.0)$"), _whole_number(t)).otherwise(t)), "")
        return F.when(sorted_.rlike(r"[0-9](E|\.0)"), told).otherwise(sorted_)

    # in a list of one, so that a text is parsed once
    nested = F.get(F.transform(F.array(F.to_json(F.try_parse_json(text))), plain), F.lit(0))
    return F.when(text.rlike(r"(?s)^\s*(\{.*\}|\[.*\])\s*$"), F.coalesce(nested, text)).otherwise(_plain_number(text))


def diff_tables(a: DataFrame, b: DataFrame, key: str | list[str], fields: list[str], order: str | None = None) -> DataFrame:
    """Columns key, change, field, old and new: lost and added rows, and each field that drifted.

    Of repeated keys the first by ``order`` counts; without one, the least by its fields. With the place in a list as key, lists are
    compared by position. Values are compared in their canonical form, so that the order of an object's keys and the
    way a number is written are no drift at any depth; structs, maps and arrays are compared as JSON. Rows are compared by
    a hash before their fields are. Null keys meet.
    """
    keys = [key] if isinstance(key, str) else list(key)

    def once(df: DataFrame, tag: str) -> DataFrame:
        kinds = dict(df.dtypes)
        values = F.struct(*[(F.to_json(f) if kinds[f].startswith(("struct", "map", "array")) else F.col(f).cast("string")).alias(f) for f in fields])
        first = F.min_by(values, F.struct(order, values)) if order else F.min(values)
        rows = df.groupBy(*[F.col(k).alias(f"{tag}_{k}") for k in keys]).agg(first.alias(tag))
        return rows.withColumn(f"{tag}_hash", F.xxhash64(*[F.coalesce(canonical(F.col(f"{tag}.{f}")), F.lit("\0")) for f in fields]))

    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"_a_{k}").eqNullSafe(F.col(f"_b_{k}"))
    both = once(a, "_a").join(once(b, "_b"), same, "full").where("not (_a_hash <=> _b_hash)")
    change = F.when(F.col("_b").isNull(), "lost").when(F.col("_a").isNull(), "added").otherwise("drift")
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"_a.{f}").alias("old"), F.col(f"_b.{f}").alias("new")) for f in fields])
    none = F.lit(None).cast("string")
    drifted = F.filter(cells, lambda c: ~canonical(c["old"]).eqNullSafe(canonical(c["new"])))
    rows = both.select(*[F.coalesce(f"_a_{k}", f"_b_{k}").alias(k) for k in keys], change.alias("change"), F.explode(F.when(change == "drift", drifted).otherwise(F.array(F.struct(none.alias("field"), none.alias("old"), none.alias("new"))))).alias("_c"))
    return rows.select(*keys, "change", "_c.field", "_c.old", "_c.new")


def ingest_entries(entries: DataFrame, registry: DataFrame, tiers: tuple[str, ...] = ("canon", "likely", "speculation", "rumour", "disproven")) -> DataFrame:
    """Columns id, subject, predicate, value, tier and error of entries (source_type, subject, predicate, value, tier, ref, ordinal).

    ``registry`` has source_type, default_tier, required (array of keys of ``ref``) and id_prefix. A declared tier
    stronger than the source's default is an error, as are unknown types and missing keys.
    """
    rank = lambda c: F.array_position(F.array(*[F.lit(t) for t in tiers]), c)
    both = entries.join(sent_if_small(registry), "source_type", "left")
    lacking = F.exists("required", lambda k: F.coalesce(F.trim(F.get(F.map_values(F.map_filter("ref", lambda a, _: a == k)), F.lit(0))), F.lit("")) == "")
    tier = F.coalesce("tier", "default_tier")
    error = F.when(F.col("default_tier").isNull(), "unknown-source").when(lacking, "missing-field").when(rank(tier) < rank(F.col("default_tier")), "tier-too-strong")
    return both.select(F.concat_ws(":", "id_prefix", F.col("ordinal").cast("string")).alias("id"), "subject", "predicate", "value", tier.alias("tier"), error.alias("error"))


def asof_position(events: DataFrame, mapping: DataFrame, group: tuple[str, ...] = (), ranges: int = 1024) -> DataFrame:
    """Columns group, key, position and how of events (key) by mapping (key, positions): exact, else the next later key, else the one before.

    Equal events are one row until the end. Both sides are stacked in ranges of keys that a quantile sketch cuts, so that a
    window sees one range, in one pass over its order each way; what a range lacks at its ends comes from the least and
    largest mapped keys of its neighbours, a table with a row for each range. Null keys give no row.
    """
    m = mapping.select(*group, F.col("key").cast("long").alias("key"), F.array_max("positions").alias("_p")).groupBy(*group, "key").agg(F.max("_p").alias("_p"))
    asked = events.select(*group, F.col("key").cast("long").alias("key")).distinct()
    rows = asked.withColumn("_e", F.lit(1)).unionByName(m.withColumn("_e", F.lit(0)), allowMissingColumns=True).where("key is not null")
    rows = rows.withColumn("_b", in_range(F.col("key"), splitters(rows, "key", ranges)))
    mark = F.when(F.col("_e") == 0, F.struct("key", "_p"))
    spans = rows.groupBy(*group, "_b").agg(F.min(mark).alias("_lo"), F.max(mark).alias("_hi"))
    before, after = Window.partitionBy(*group).orderBy("_b"), Window.partitionBy(*group).orderBy(F.desc("_b"))
    gone = (Window.unboundedPreceding, -1)
    near = spans.select(*group, "_b", F.last("_lo", True).over(after.rowsBetween(*gone)).alias("_next"), F.last("_hi", True).over(before.rowsBetween(*gone)).alias("_prev"))
    up, down = (Window.partitionBy(*group, "_b").orderBy(o).rangeBetween(Window.unboundedPreceding, 0) for o in (F.asc("key"), F.desc("key")))
    seen = rows.withColumn("_f", F.last(mark, True).over(up)).withColumn("_l", F.last(mark, True).over(down)).where("_e = 1").join(near, [*group, "_b"])
    found = F.coalesce("_l", "_next", "_f", "_prev")
    told = seen.select(*group, "key", found["_p"].alias("position"), F.when(found["key"] == F.col("key"), "exact").when(found.isNotNull(), "filler").alias("how"))
    return events.select(*group, F.col("key").cast("long").alias("key")).join(told, [*group, "key"])


def range_position(points: DataFrame, ranges: DataFrame, latest: int, open_end: int = 9999) -> DataFrame:
    """Columns position and name of the range that holds it; ends from ``open_end`` on mean the latest position.

    Ranges are of small integers, so they are laid out and joined by equality.
    """
    end = F.when(F.col("end") >= open_end, F.lit(latest)).otherwise(F.least(F.col("end"), F.lit(latest)))
    laid = ranges.where(F.col("start") <= end).select("name", F.explode(F.sequence(F.col("start"), end)).alias("position"))
    return points.join(laid, "position", "left")
