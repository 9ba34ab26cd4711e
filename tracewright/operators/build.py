"""Source tables + confirmed mapping -> objects, events, links and skipped rows.

One narrow pass per event group reads its source table; the shuffles are: one
combined aggregation on the object id (first row wins), one semi join of links
with objects, and a bridge join where a rule needs one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions import fixed
from tracewright.functions import scalars as S
from tracewright.plans.log import EventLog, Link, ObjectFrames, WideGroup
from tracewright.plans.mapping import ComputedColumn, EventRule, LinkRule, Mapping, ObjectRule
from tracewright.plans.skew import numbered_copies

Tables = dict[str, DataFrame]


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


# ---- computed columns ------------------------------------------------------
def with_computed(tables: Tables, computed: tuple[ComputedColumn, ...]) -> Tables:
    out = dict(tables)
    for c in computed:
        if c.table not in out or not c.is_valid():
            continue
        value = (S.change_value(c.old, c.new, c.field) if c.rule == "change"
                 else S.slice_value(c.column, c.start, c.length))
        out[c.table] = out[c.table].withColumn(c.name, value)
    return out


# ---- rows ------------------------------------------------------------------
def row_order(df: DataFrame, ordinal: int, columns: list[str] | None = None) -> Column:
    """Sortable text of a source row: a total order that depends only on the data."""
    types = {f.name: f.dataType for f in df.schema.fields}
    parts = ", ".join(S.sort_text_sql(c, types[c]) for c in (columns or df.columns))
    return F.expr(f"concat_ws('|', '{ordinal}', {parts})")


def few_splits(df: DataFrame) -> bool:
    """Whether a table has few input splits (one small file)."""
    return df.rdd.getNumPartitions() * 2 <= df.sparkSession.sparkContext.defaultParallelism


def spread_out(df: DataFrame) -> DataFrame:
    """Rows of a table with few input splits over all cores; bigger tables are left alone."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, *df.columns) if few_splits(df) else df


# ---- objects ---------------------------------------------------------------
def split_type(rule: ObjectRule) -> tuple[Column, Column]:
    """(object type or null when left out, outcome) of a row."""
    if not rule.split_column:
        return F.lit(rule.name), F.lit("ok")
    value = S.clean(rule.split_column)
    named = {str(k).strip(): v.strip() for k, v in (rule.split_values or {}).items() if v is not None}
    to = S.lookup(named, value)
    otype = F.when(to.isNull(), F.lit(rule.name)).when(to != "", to)
    outcome = F.when(to.isNull(), "unmapped").when(to == "", "excluded").otherwise("ok")
    return otype, outcome


def object_rows(rule: ObjectRule, table: DataFrame) -> DataFrame:
    """Every source row with a key: its object, the outcome of the split, and the row itself."""
    otype, outcome = split_type(rule)
    rows = table.select(
        F.lit(rule.name).alias("base_type"), S.object_key(rule.key_columns).alias("key"), otype.alias("object_type"),
        outcome.alias("outcome"),
        (S.clean(rule.split_column) if rule.split_column else F.lit(None).cast("string")).alias("split_value"),
        F.struct(*table.columns).alias("row"))
    return rows.where(F.col("key").isNotNull()).withColumn("object_id", F.concat_ws(":", "object_type", "key"))


def first_rows(rule: ObjectRule, table: DataFrame) -> DataFrame:
    """The first row of every object (smallest by all columns), with its attributes."""
    types = column_types(table)
    attrs = S.attribute_map(rule.attributes, types).alias("attrs")
    keys = rule.key_columns
    if not rule.split_column and (rule.unique_key or whole(types, keys)):
        rows = table.where(has_key(keys, types))
        if not rule.unique_key:
            # rows of an object agree in its key, so only the other columns decide; none behind the last attribute can matter
            last = max([table.columns.index(c) for c in rule.attributes], default=-1)
            rest = [c for c in table.columns[:last + 1] if c not in keys]
            rows = rows.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("row")).select(*keys, "row.*") if rest else rows.select(*keys).distinct()
        key = S.object_key(keys, types)
        return rows.select(F.concat(F.lit(f"{rule.name}:"), key).alias("object_id"), F.lit(rule.name).alias("object_type"), key.alias("key"), attrs)
    rows = object_rows(rule, table).where(F.col("object_type").isNotNull())
    if not rule.unique_key:
        rows = rows.groupBy("object_id", "object_type", "key").agg(F.min("row").alias("row"))
    return rows.select("object_id", "object_type", "key", "row.*").select("object_id", "object_type", "key", attrs)


def column_types(table: DataFrame) -> dict:
    return {f.name: f.dataType for f in table.schema.fields}


def whole(types: dict, columns: list[str]) -> bool:
    return all(isinstance(types.get(c), S.WHOLE) for c in columns)


def has_key(keys: list[str], types: dict) -> Column:
    """No part of the key is empty."""
    return reduce(Column.__and__, [(F.col(S.quoted(c)) if isinstance(types.get(c), S.PLAIN) else S.present(c)).isNotNull() for c in keys])


def build_objects(mapping: Mapping, tables: Tables) -> DataFrame:
    frames = [first_rows(r, tables[r.table]) for r in mapping.objects]
    made = [t for r in mapping.objects for t in r.output_types()]
    if len(made) == len(set(made)):
        return union_all(frames)
    # two rules make the same type: the first rule wins
    ranked = union_all([f.withColumn("rule", F.lit(i)) for i, f in enumerate(frames)])
    return ranked.groupBy("object_id", "object_type", "key").agg(F.min_by("attrs", "rule").alias("attrs"))


def existing_ids(rule: ObjectRule, table: DataFrame) -> DataFrame:
    """Ids a rule makes, repeats included: all a semi join needs."""
    return object_rows(rule, table).where(F.col("object_type").isNotNull()).select("object_id")


def split_ids(rule: ObjectRule, table: DataFrame) -> DataFrame:
    """Key of the mapped type -> the object it became (that of the first row)."""
    rows = object_rows(rule, table).where(F.col("object_type").isNotNull())
    found = rows.groupBy("key").agg(F.min(F.struct("row", "object_id", "object_type")).alias("o"))
    return found.select(F.col("key").alias("target_key"), "o.object_id", "o.object_type")


def main_key_column(rule: ObjectRule, table: DataFrame) -> str:
    """The key column with the most distinct values: the number, not the company or the year."""
    keys = rule.key_columns
    if len(keys) == 1:
        return keys[0]
    counts = table.agg(*[(F.countDistinct(c) + F.max(F.when(F.col(c).isNull(), 1).otherwise(0))).alias(c)
                         for c in keys]).first()
    return max(keys, key=lambda c: counts[c] or 0)


# ---- events ----------------------------------------------------------------
def event_activity(rule: EventRule) -> tuple[Column, Column]:
    """(activity or null, outcome ok | unmapped | excluded | missing) of a row."""
    if not rule.activity_column:
        return F.lit(rule.name), F.lit("ok")
    value = S.clean(rule.activity_column)
    if rule.activity_values is None:
        return (F.when(value != "", value), F.when(value == "", "missing").otherwise("ok"))
    to = S.lookup({str(k).strip(): (v or "").strip() for k, v in rule.activity_values.items()}, value)
    raw = F.concat(F.lit(f"{rule.name} [{rule.activity_column}="), value, F.lit("]"))
    activity = F.when(value == "", None).when(to.isNull(), raw).when(to != "", to)
    outcome = (F.when(value == "", "missing").when(to.isNull(), "unmapped").when(to == "", "excluded")
               .otherwise("ok"))
    return activity, outcome


def event_rows(mapping: Mapping, rule: EventRule, table: DataFrame, ordinal: int) -> DataFrame:
    """Source rows of a group with what the event needs; source columns stay available."""
    types = column_types(table)
    activity, outcome = event_activity(rule)
    ts = S.event_time(rule.timestamp, types.get(rule.timestamp), rule.time)
    if rule.row_key:
        # a declared row key gives the id and, through it, the place among ties
        rows = table.withColumns({"__event_id": row_order(table, ordinal, list(rule.row_key)), "__ord": F.lit(None).cast("string")})
    else:
        rows = numbered_copies(table, "__copy")
        rows = rows.withColumn("__ord", row_order(rows, ordinal, [*table.columns, "__copy"]))
        rows = rows.withColumn("__event_id", F.concat(F.lit(f"{ordinal}|"), F.md5(F.col("__ord")))).drop("__copy")
    home = mapping.home_of(rule)
    if home is None:
        home_type, home_key, home_outcome = F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit("ok")
    else:
        home_type, home_outcome = split_type(home)
        home_key = S.object_key(home.key_columns, types)
    return rows.withColumns({
        "__activity": activity, "__outcome": outcome, "__ts": ts, "__home_type": home_type, "__home_key": home_key,
        "__home_excluded": (home_outcome == "excluded") & home_key.isNotNull(),
        "__preview": F.map_from_arrays(F.array(*[F.lit(c) for c in table.columns[:4]]),
                                       F.array(*[F.col(c).cast("string") for c in table.columns[:4]]))})


def _kept(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("__activity").isNotNull() & F.col("__ts").isNotNull())


def _event() -> list[Column]:
    return [F.col("__event_id").alias("event_id"), F.col("__activity").alias("activity"), F.col("__ts").alias("ts"),
            F.col("__ord").alias("ord")]


_E2O = ["event_id", "object_id", "object_type", "qualifier", "activity", "ts", "ord"]


def home_links(rows: DataFrame) -> DataFrame:
    """The link with the object of the event's own row; that object exists by construction."""
    kept = _kept(rows).where(F.col("__home_type").isNotNull() & F.col("__home_key").isNotNull())
    return kept.select(*_event(), F.concat_ws(":", "__home_type", "__home_key").alias("object_id"),
                       F.col("__home_type").alias("object_type"), F.lit(fixed.HOME).alias("qualifier")).select(*_E2O)


def reference_columns(link: LinkRule, rule: EventRule, target: ObjectRule, columns: list[str], tables: Tables) -> list[str] | None:
    """Columns of the event's own row that hold the key of the target ([]: it cannot be read), or None when a bridge is needed."""
    keys = target.key_columns
    if link.table == rule.table and link.column in columns and link.column not in keys and keys:
        main = main_key_column(target, tables[target.table])
        if any(c not in columns for c in keys if c != main):
            return []
        return [link.column if c == main else c for c in keys]
    return keys if all(c in columns for c in keys) else None


def _reference_key(link: LinkRule, rule: EventRule, target: ObjectRule, columns: list[str],
                   tables: Tables) -> Column | None:
    """Key of the target read in the event's own row, or null when a bridge is needed."""
    found = reference_columns(link, rule, target, columns, tables)
    if found is None:
        return None
    return S.object_key(found) if found else F.lit(None).cast("string")


def rule_links(mapping: Mapping, rule: EventRule, rows: DataFrame, columns: list[str], tables: Tables) -> list[DataFrame]:
    """Links by the rules of a group, one table per rule, to existing objects only.

    Each rule is a narrow projection of the source rows and a semi join with the
    keys of its target table, which Spark broadcasts where they are few.
    """
    kept = _kept(rows)
    frames: list[DataFrame] = []
    for link in mapping.links_of(rule):
        target, only = mapping.target_of(link)
        if target is None:
            continue
        key = _reference_key(link, rule, target, columns, tables)
        qualifier = F.lit(link.label).alias("qualifier")
        if key is not None:
            found = kept.select(*_event(), key.alias("target_key"), qualifier)
        else:
            bridge = tables.get(link.table)
            if (bridge is None or link.column not in columns or link.column not in bridge.columns
                    or any(c not in bridge.columns for c in target.key_columns)):
                continue
            # several bridge rows may lead to the same object
            side = (bridge.select(S.present(link.column).alias("__via"), S.object_key(target.key_columns).alias("target_key"))
                    .where(F.col("__via").isNotNull() & F.col("target_key").isNotNull()).distinct())
            found = kept.select(*_event(), S.present(link.column).alias("__via"), qualifier).join(side, "__via").drop("__via")
        found = found.where(F.col("target_key").isNotNull())
        table = tables[target.table]
        if target.split_column:
            ids = split_ids(target, table)
            found = found.join(ids.where(F.col("object_type") == only) if only else ids, "target_key")
        else:
            found = found.withColumns({"object_id": F.concat(F.lit(f"{target.name}:"), F.col("target_key")),
                                       "object_type": F.lit(target.name)})
            found = found.join(existing_ids(target, table), "object_id", "left_semi")
        frames.append(found.select(*_E2O))
    return frames


def links_are_unique(mapping: Mapping) -> bool:
    """No event group reaches the same object type on two ways: then no event is linked twice to one object."""
    for rule in mapping.events:
        home = mapping.home_of(rule)
        targets = [home.name] if home else []
        targets += [t.name for t, _ in map(mapping.target_of, mapping.links_of(rule)) if t is not None]
        if len(targets) != len(set(targets)):
            return False
    return True


def reads_wide(mapping: Mapping, tables: Tables) -> bool:
    """Every event names its objects in its own row, one of a type: no split types, no bridges, no second way."""
    names = [o.name for o in mapping.objects]
    if any(o.split_column for o in mapping.objects) or len(names) != len(set(names)) or not links_are_unique(mapping):
        return False
    for rule in mapping.events:
        columns = tables[rule.table].columns
        for link in mapping.links_of(rule):
            target, _ = mapping.target_of(link)
            if target is None or not target.key_columns or reference_columns(link, rule, target, columns, tables) is None:
                return False
        if mapping.home_of(rule) is None and not mapping.links_of(rule):
            return False
    return True


def wide_links(mapping: Mapping, rule: EventRule, tables: Tables) -> list[Link]:
    """The objects a row names: its home object, and those of the link rules, as far as they exist."""
    table = tables[rule.table]
    types, links = column_types(table), []

    def link(target: ObjectRule, columns: list[str], qualifier: str, same: bool) -> Link:
        there = column_types(tables[target.table])
        keys = target.key_columns
        numbers = whole(types, columns) and whole(there, keys)
        long = lambda c: F.col(S.quoted(c)).cast("long")
        used = tuple(long(c) for c in columns) if numbers else (S.object_key(columns, types),)
        known = None
        if not same:
            known = tables[target.table].where(has_key(keys, there)).select(
                *[c.alias(f"__k{i}") for i, c in enumerate([long(k) for k in keys] if numbers else [S.object_key(keys, there)])])
        return Link(target.name, qualifier, F.concat(F.lit(f"{target.name}:"), S.object_key(columns, types)), has_key(columns, types),
                    used if numbers else (), used, known, single=same and target.unique_key)

    home = mapping.home_of(rule)
    if home is not None:
        links.append(link(home, home.key_columns, fixed.HOME, True))
    for x in mapping.links_of(rule):
        target, _ = mapping.target_of(x)
        columns = reference_columns(x, rule, target, table.columns, tables)
        if columns:
            # a row of the target's own table names an object that is made from it
            links.append(link(target, columns, x.label, target.table == rule.table and columns == target.key_columns))
    return links


def build_wide(mapping: Mapping, tables: Tables, plain: set[str]) -> EventLog:
    """The log of a mapping whose rows name all their objects: nothing is shuffled but what chooses first rows."""
    frames = {o.name: first_rows(o, tables[o.table]) for o in mapping.objects}
    objects = ObjectFrames(frames, {o.name for o in mapping.objects if o.unique_key and o.table in plain})
    groups, skips = [], []
    for i, rule in enumerate(mapping.events, 1):
        table = tables[rule.table]
        types = column_types(table)
        rows = event_rows(mapping, rule, table, i)
        skips.append(_skipped(rule, rows))
        base, event = _kept(rows), tuple(_event())
        if rule.row_key:
            # the columns as they are: ids are longer than what they are made from, and made where they are used
            activity, ts = event_activity(rule)[0], S.event_time(rule.timestamp, types.get(rule.timestamp), rule.time)
            base = table.where(activity.isNotNull() & ts.isNotNull())
            event = (row_order(table, i, list(rule.row_key)).alias("event_id"), activity.alias("activity"), ts.alias("ts"),
                     F.lit(None).cast("string").alias("ord"))
        groups.append(WideGroup(rule.name, base, event, S.attribute_map(rule.attributes, types),
                                tuple(wide_links(mapping, rule, tables)), bool(rule.row_key) and rule.table in plain))
    return EventLog(objects, skips=union_all(skips), unique_links=True, groups=tuple(groups))


def build(mapping: Mapping, source: Tables) -> EventLog:
    """The whole log for a confirmed mapping."""
    made = with_computed(source, mapping.computed)
    tables = {n: spread_out(t) for n, t in made.items()}
    if reads_wide(mapping, made):
        return build_wide(mapping, tables, {n for n, t in made.items() if not few_splits(t)})
    objects = build_objects(mapping, tables)
    unique = links_are_unique(mapping)
    events, links, skips = [], [], []
    for i, rule in enumerate(mapping.events, 1):
        table = tables[rule.table]
        rows = event_rows(mapping, rule, table, i)
        found = rule_links(mapping, rule, rows, table.columns, tables)
        group_links = union_all([home_links(rows), *found])
        if not unique:
            group_links = group_links.dropDuplicates(["event_id", "object_id", "qualifier"])
        kept = _kept(rows)
        skips.append(_skipped(rule, rows))
        home = mapping.home_of(rule)
        if home is not None and home.split_column:
            # an event of a left-out object stays only when it concerns another object
            alone = kept.where(F.col("__home_excluded"))
            for f in found:
                alone = alone.join(f.select(F.col("event_id").alias("__event_id")), "__event_id", "left_anti")
            skips.append(alone.select(*_skip_columns(rule, F.lit("excluded_object"), F.concat(
                F.lit("value '"), S.clean(home.split_column),
                F.lit(f"' of '{home.split_column}' is left out ({home.name})")))))
            kept = kept.join(alone.select("__event_id"), "__event_id", "left_anti")
        events.append(kept.select(*_event(), F.lit(rule.name).alias("event_group"),
                                  S.attribute_map(rule.attributes).alias("attrs")))
        links.append(group_links)
    return EventLog(objects, union_all(events).select("event_id", "activity", "ts", "event_group", "ord", "attrs"),
                    union_all(links), union_all(skips), unique_links=unique)


def _skip_columns(rule: EventRule, kind: Column, reason: Column) -> list[Column]:
    return [F.lit(rule.name).alias("event_group"), F.lit(rule.table).alias("source_table"), kind.alias("kind"),
            reason.alias("reason"), F.col("__preview").alias("preview")]


def _skipped(rule: EventRule, rows: DataFrame) -> DataFrame:
    """Rows without activity or without a readable time."""
    lost = rows.where(F.col("__activity").isNull() | F.col("__ts").isNull())
    column = rule.activity_column
    value = S.clean(column) if column else F.lit("")
    kind = F.when(F.col("__activity").isNotNull(), "timestamp").when(F.col("__outcome") == "excluded", "excluded") \
        .otherwise("activity")
    reason = (F.when(kind == "timestamp", F.lit(f"time missing or unreadable in '{rule.timestamp}'"))
              .when(kind == "excluded", F.concat(F.lit("value '"), value, F.lit(f"' of '{column}' is left out")))
              .otherwise(F.lit(f"activity column '{column}' is empty")))
    return lost.select(*_skip_columns(rule, kind, reason))


# ---- catalogue and statistics ----------------------------------------------
def object_type_catalogue(mapping: Mapping, log: EventLog) -> DataFrame:
    """Object types of the log: the mapped ones, and of a split only those that were produced."""
    spark = log.spark
    fixed_types = [(o.name,) for o in mapping.objects if not o.split_column]
    made = log.objects.select("object_type").distinct()
    named = spark.createDataFrame(fixed_types, "object_type string") if fixed_types else made.limit(0)
    return named.unionByName(made).distinct()


def event_type_catalogue(mapping: Mapping, log: EventLog) -> DataFrame:
    fixed_types = [(e.name,) for e in mapping.events if not e.activity_column]
    made = log.events.select(F.col("activity").alias("event_type")).distinct()
    if not fixed_types:
        return made
    return log.spark.createDataFrame(fixed_types, "event_type string").unionByName(made).distinct()


def activity_counts(log: EventLog) -> DataFrame:
    """Activities made by each event group, with their number of events."""
    return log.events.groupBy("event_group", "activity").agg(F.count(F.lit(1)).alias("events"))


def unmapped_activity_values(mapping: Mapping, log: EventLog) -> DataFrame:
    """Values of activity columns kept under their code because no name was given."""
    frames = []
    for e in mapping.events:
        if e.activity_column and e.activity_values is not None:
            head = f"{e.name} [{e.activity_column}="
            frames.append(log.events.where((F.col("event_group") == e.name) & F.col("activity").startswith(head))
                          .select("event_group", F.expr(f"substring(activity, {len(head) + 1})").alias("v"))
                          .select("event_group", F.expr("left(v, length(v) - 1)").alias("value")))
    if not frames:
        return log.spark.createDataFrame([], "event_group string, value string, events long")
    return union_all(frames).groupBy("event_group", "value").agg(F.count(F.lit(1)).alias("events"))


def split_outcomes(mapping: Mapping, source: Tables) -> DataFrame:
    """Rows per (mapped type, outcome, value) of the split columns."""
    tables = with_computed(source, mapping.computed)
    frames = [object_rows(o, tables[o.table]).drop("row") for o in mapping.objects if o.split_column]
    if not frames:
        return next(iter(source.values())).sparkSession.createDataFrame(
            [], "base_type string, outcome string, split_value string, rows long")
    return (union_all(frames).groupBy("base_type", "outcome", "split_value")
            .agg(F.count(F.lit(1)).alias("rows")))


def build_statistics(mapping: Mapping, log: EventLog) -> DataFrame:
    """Counts of a build as (measure, value)."""
    counts = [
        log.objects.agg(F.count(F.lit(1)).alias("value")).select(F.lit("objects").alias("measure"), "value"),
        log.events.agg(F.count(F.lit(1)).alias("value")).select(F.lit("events").alias("measure"), "value"),
        object_type_catalogue(mapping, log).agg(F.count(F.lit(1)).alias("value")).select(
            F.lit("object_types").alias("measure"), "value"),
        event_type_catalogue(mapping, log).agg(F.count(F.lit(1)).alias("value")).select(
            F.lit("event_types").alias("measure"), "value"),
        log.skips.agg(F.count_if(~F.col("kind").isin("excluded", "excluded_object")).alias("value")).select(
            F.lit("skipped").alias("measure"), "value"),
    ]
    return union_all(counts)


# ---- incremental merge -----------------------------------------------------
def event_content(log: EventLog) -> DataFrame:
    """Identity of an event that does not depend on its id: activity, time, links and attributes.

    Links are folded into an order-free sum of hashes per event, so an event
    with very many links is combined map-side instead of being gathered.
    """
    link_hash = log.e2o.groupBy("event_id").agg(
        F.count(F.lit(1)).alias("n_links"),
        F.sum(F.xxhash64("object_id", "qualifier").cast("decimal(20,0)")).alias("h1"),
        F.sum(F.xxhash64(F.lit(7), "qualifier", "object_id").cast("decimal(20,0)")).alias("h2"))
    attrs = F.to_json(F.array_sort(F.map_entries("attrs")))
    return (log.events.join(link_hash, "event_id", "left")
            .withColumn("content", F.sha2(F.concat_ws(
                "\x1f", "activity", F.col("ts").cast("string"), attrs, F.coalesce(F.col("n_links"), F.lit(0)).cast("string"),
                F.coalesce(F.col("h1").cast("string"), F.lit("")), F.coalesce(F.col("h2").cast("string"), F.lit(""))), 256))
            .drop("n_links", "h1", "h2"))


def merge_logs(previous: EventLog, new: EventLog) -> tuple[EventLog, DataFrame]:
    """Refresh: objects of the new log win by id, unseen events are appended. Returns (log, counts)."""
    p, n = previous.objects.alias("p"), new.objects.alias("n")
    pair = p.join(n, F.col("p.object_id") == F.col("n.object_id"), "full_outer")
    pick = lambda c: F.when(F.col("n.object_id").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"p.{c}")).alias(c)
    objects = pair.select(*[pick(c) for c in ("object_id", "object_type", "key", "attrs")])
    same = (F.to_json(F.array_sort(F.map_entries("p.attrs"))) == F.to_json(F.array_sort(F.map_entries("n.attrs"))))
    known = F.col("p.object_id").isNotNull()
    object_counts = pair.agg(F.count_if(~known).alias("added_objects"),
                             F.count_if(known & F.col("n.object_id").isNotNull() & ~same).alias("updated_objects"))

    seen = event_content(previous).select("content")
    # repeats inside the new batch collapse to the first; repeats of the previous log stay
    fresh = (event_content(new).join(seen, "content", "left_anti")
             .groupBy("content").agg(F.min(F.struct("ord", "event_id")).alias("first"))
             .select(F.col("first.event_id").alias("event_id"), "content"))
    placed = lambda df: df.withColumn("ord", F.coalesce("ord", "event_id"))
    fresh_events = placed(new.events.join(fresh, "event_id"))
    fresh_links = placed(new.e2o.join(fresh, "event_id"))
    new_id = F.concat(F.lit("m|"), F.col("content"))
    events = placed(previous.events).unionByName(fresh_events.withColumn("event_id", new_id).drop("content"))
    e2o = placed(previous.e2o).unionByName(fresh_links.withColumn("event_id", new_id).drop("content").select(*_E2O))
    counts = object_counts.unpivot([], ["added_objects", "updated_objects"], "measure", "value").unionByName(
        fresh.agg(F.count(F.lit(1)).alias("value")).select(F.lit("added_events").alias("measure"), "value"))
    return EventLog(objects, events, e2o, new.skips), counts


def renumbered(log: EventLog) -> DataFrame:
    """Running numbers e1, e2, ... in time order, by parts: counts per day, then a rank inside each day."""
    from pyspark.sql import Window
    day = log.events.select("event_id", "ts", "ord", F.to_date("ts").alias("day"))
    per_day = day.groupBy("day").agg(F.count(F.lit(1)).alias("n"))
    before = per_day.select("day", F.coalesce(F.sum("n").over(
        Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("day").orderBy("ts", "ord", "event_id"))
    return (day.withColumn("rank", rank).join(F.broadcast(before), "day")
            .select("event_id", F.concat(F.lit("e"), (F.col("rank") + F.col("before")).cast("string")).alias("number")))
