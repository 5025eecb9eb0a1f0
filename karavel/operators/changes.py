"""Change data: decode, cut, collapse and apply an ordered change log (batch functions).

A change row has ``pos`` (log position), ``op`` (``I``, ``U``, ``D``) and the columns of the target;
a delete needs only the key columns. Positions order the log, event time plays no part.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from karavel.functions.expr import all_equal, lsn_to_pos
from karavel.functions.ordered import ROWS_PER_RANGE, last_known, running_sum
from karavel.functions.sized import settle, settle_known

EMPTIES = ("T", "X")  # operations after which a table has no rows
COMMIT = "C"  # the record that ends a transaction
COPIES_PER_ROW = 100_000  # equal rows that one row may expand into at a time


# ---------------------------------------------------------------------------------------- decode


def decode_changes(
    records: DataFrame, row_schema: T.StructType, text: str = "value", key_type: T.DataType | None = None
) -> DataFrame:
    """JSON change records to typed rows ``(pos, xid, op, tbl, key, after, before, malformed, raw)``.

    A record has ``lsn, xid, action, table, key, after, before``; the record of a commit has position and xid only. The key is a bigint unless ``key_type`` says
    otherwise: a text, or a struct for a key of several columns. A record that does not parse, lacks
    a position or has an unknown action stays in the result with ``malformed`` set, for the error policy.
    """
    shape = T.StructType(
        [
            T.StructField("lsn", T.StringType()),
            T.StructField("xid", T.LongType()),
            T.StructField("action", T.StringType()),
            T.StructField("table", T.StringType()),
            T.StructField("key", key_type or T.LongType()),
            T.StructField("after", row_schema),
            T.StructField("before", row_schema),
            T.StructField("bad", T.StringType()),
        ]
    )
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad"}
    r = F.col("__r")
    good_lsn = F.when(r["lsn"].rlike("^[0-9A-Fa-f]{1,8}/[0-9A-Fa-f]{1,8}$"), r["lsn"])
    parsed = records.select(F.col(text).alias("raw"), F.from_json(F.col(text), shape, options).alias("__r"))
    out = parsed.select(
        lsn_to_pos(good_lsn).alias("pos"),
        r["xid"].alias("xid"),
        r["action"].alias("op"),
        r["table"].alias("tbl"),
        r["key"].alias("key"),
        r["after"].alias("after"),
        r["before"].alias("before"),
        r["bad"].alias("bad"),
        "raw",
    )
    known = F.col("op").isin("I", "U", "D", "T", "X", "A", COMMIT)
    malformed = F.col("bad").isNotNull() | F.col("pos").isNull() | ~F.coalesce(known, F.lit(False))
    return out.withColumn("malformed", malformed).drop("bad")


def row_changes(decoded: DataFrame, key: list[str]) -> DataFrame:
    """Sound decoded records as flat rows ``(pos, seq, op, tbl, columns of the table)``, ready to be applied.

    An update that changes the key, or any update of a table without one (``key`` empty), becomes a delete of the
    old image and an insert of the new one at the same position; ``seq`` keeps them in this order, so
    order by ``[pos, seq]``. Truncates and drops come through with empty columns.
    """
    cols = [f.name for f in decoded.schema["after"].dataType]
    same = F.lit(bool(key))
    for k in key:
        same = same & F.col("before")[k].eqNullSafe(F.col("after")[k])
    split = (F.col("op") == "U") & F.col("before").isNotNull() & ~same

    def step(seq: int, op: Column, image: Column) -> Column:
        return F.struct(F.lit(seq).alias("seq"), op.alias("op"), image.alias("row"))

    image = F.when(F.col("op") == "D", F.coalesce("before", "after")).otherwise(F.col("after"))
    both = F.array(step(0, F.lit("D"), F.col("before")), step(1, F.lit("I"), F.col("after")))
    steps = F.when(split, both).otherwise(F.array(step(0, F.col("op"), image)))
    if "key" in decoded.columns and len(key) == 1:  # a delete may bring its key only
        out = decoded.filter(~F.col("malformed")).select("pos", "tbl", "key", F.explode(steps).alias("__s"))
        columns = [F.coalesce(F.col(f"__s.row.{c}"), F.col("key")).alias(c) if c == key[0] else F.col(f"__s.row.{c}") for c in cols]
    else:
        out = decoded.filter(~F.col("malformed")).select("pos", "tbl", F.explode(steps).alias("__s"))
        columns = [F.col(f"__s.row.{c}") for c in cols]
    return out.select("pos", "__s.seq", "__s.op", "tbl", *columns)


# ------------------------------------------------------------------------------- cut by position


def bound_changes(changes: DataFrame, endpos: Column | int) -> DataFrame:
    """Changes up to and including the end position."""
    return changes.filter(F.col("pos") <= endpos)


def resume_changes(changes: DataFrame, replay_pos: Column | int) -> DataFrame:
    """Changes after the last applied position."""
    return changes.filter(F.col("pos") > replay_pos)


def end_reached(applied: DataFrame, endpos: int) -> DataFrame:
    """One row: highest applied position and whether it has reached the end position."""
    return applied.agg(F.max("pos").alias("applied_pos")).withColumn(
        "reached", F.coalesce(F.col("applied_pos") >= F.lit(endpos), F.lit(False))
    )


def whole_transactions(changes: DataFrame, endpos: int, xid: str = "xid") -> DataFrame:
    """Changes of the transactions that end at or before a position; later ones wait for the next batch.

    Only the transactions still open at the cut are collected (as a table) and taken out, so the rows
    of a large finished transaction are not moved.
    """
    cut, _ = settle(changes.filter(F.col("pos") > endpos).select(xid).distinct(), "open_transactions")
    return changes.filter(F.col("pos") <= endpos).join(cut, xid, "left_anti")


def route_changes(changes: DataFrame, published: DataFrame, table: str = "tbl") -> DataFrame:
    """Changes of the published tables only. The list is settled first, so that a short one is sent to the log's scan."""
    listed, _ = settle(published.select(table).distinct(), "published")
    return changes.join(listed, table, "left_semi")


# ---------------------------------------------------------------------------------- collapse, apply


def net_changes(changes: DataFrame, key: list[str], order: list[str] | None = None) -> DataFrame:
    """The last change per key. Each task collapses its own rows first, so a hot key moves as one row per task."""
    order = order or ["pos"]
    rest = [c for c in changes.columns if c not in key]
    last = F.max_by(F.struct(*rest), F.struct(*order) if len(order) > 1 else F.col(order[0]))
    return changes.groupBy(*key).agg(last.alias("__last")).select(*key, "__last.*").select(*changes.columns)


def apply_changes(target: DataFrame, changes: DataFrame, key: list[str], order: list[str] | None = None) -> DataFrame:
    """The target after the changes, with the upsert rule: insert and update both set the row.

    A truncate or drop (``T``, ``X``) empties the target, and only later changes count; other operations are no
    rows and are passed over. One pass over the log finds the last change of each key and the last truncate; the result is
    kept in the shared folder, so its size is known: few net changes are sent to the target's scan, which is then not
    shuffled, many are joined by shuffle.
    """
    place = F.struct(*(order or ["pos"]))
    rest = [c for c in changes.columns if c not in key]
    is_row, empties = F.col("op").isin("I", "U", "D"), F.col("op").isin(*EMPTIES)
    last = F.max_by(F.struct(*rest), F.when(is_row, place)).alias("__last")
    found = changes.filter(is_row | empties).groupBy(*key).agg(last, F.max(F.when(is_row, place)).alias("__at"), F.max(F.when(empties, place)).alias("__cut"))
    net, known = settle_known(found, "net_changes", cut=F.max("__cut"))
    net = net.filter("__last is not null")
    if known["cut"] is not None:
        cut = [F.lit(v).cast(f.dataType).alias(f.name) for f, v in zip(found.schema["__cut"].dataType, known["cut"])]
        net, target = net.filter(F.col("__at") > F.struct(*cut)), target.limit(0)
    kept = target.join(net.select(*key), key, "left_anti").select(*target.columns)
    return kept.unionByName(net.select(*key, "__last.*").filter(F.col("op") != "D").select(*target.columns))


def load_and_follow(
    snapshot: DataFrame, snapshot_pos: int, changes: DataFrame, key: list[str], order: list[str] | None = None
) -> DataFrame:
    """Snapshot plus the changes after its position; earlier ones are in the snapshot already."""
    return apply_changes(snapshot, resume_changes(changes, snapshot_pos), key, order)


def repeat_rows(df: DataFrame, times: str, copies_per_row: int = COPIES_PER_ROW) -> DataFrame:
    """Each row ``times`` times. Large counts are first cut into pieces and spread over the cluster."""
    cols = [c for c in df.columns if c != times]
    n = F.col(times)
    # stack of pieces: start offsets 0, p, 2p, ... below n
    pieces = df.filter(n > 0).withColumn("__from", F.explode(F.sequence(F.lit(0), n - 1, F.lit(copies_per_row))))
    pieces = pieces.withColumn("__n", F.least(n - F.col("__from"), F.lit(copies_per_row).cast("bigint")))
    spread = pieces.repartition(F.xxhash64(*cols, "__from"))
    return spread.select(*cols, F.explode(F.sequence(F.lit(1).cast("bigint"), "__n"))).select(*cols)


def apply_changes_keyless(
    target: DataFrame,
    changes: DataFrame,
    pos: str | list[str] | None = None,
    *,
    rows_per_range: int = ROWS_PER_RANGE,
    copies_per_row: int = COPIES_PER_ROW,
) -> DataFrame:
    """Apply full-image inserts and deletes to a table without a key; one delete takes one equal row away.

    Updates have to be split into both first, which ``row_changes`` does; order by ``["pos", "seq"]`` then.

    Without a position, deletes take rows of the target only and inserts are added afterwards. With a
    position the log order counts: a delete also takes a row inserted before it, and a delete that
    finds no row does nothing. For rows 0..n at the start that gives ``max(n + net, net - low)`` at the end, with
    ``net`` the sum of the steps and ``low`` their lowest running sum (at most 0).

    Rows whose image no delete names are passed through untouched; equal rows are counted, never
    numbered, so a row with very many copies costs one counter per task.
    """
    cols = target.columns
    is_delete = F.when(F.col("op") == "D", 1).otherwise(0)
    if pos is None:
        images = changes.groupBy(*cols).agg(
            F.sum(1 - is_delete).alias("__up"), F.sum(is_delete).alias("__down"), F.sum(is_delete).alias("__deletes")
        )
        final = F.greatest(F.col("__n") - F.col("__down"), F.lit(0)) + F.col("__up")
    else:
        step = (1 - 2 * is_delete).cast("bigint")
        summed = running_sum(changes, cols, [pos] if isinstance(pos, str) else pos, "__run", step, rows_per_range=rows_per_range)
        images = summed.groupBy(*cols).agg(
            F.sum(step).alias("__up"), F.least(F.min("__run"), F.lit(0)).alias("__down"), F.sum(is_delete).alias("__deletes")
        )
        final = F.greatest(F.col("__n"), -F.col("__down")) + F.col("__up")

    return meet_images(target, images, final, copies_per_row)


def meet_images(target: DataFrame, images: DataFrame, final: Column, copies_per_row: int = COPIES_PER_ROW) -> DataFrame:
    """A table without a key after counted steps per row image: ``__up``, ``__down`` and ``__deletes`` of each.

    ``final`` gives the copies of an image at the end, from these and ``__n``, how many the target has.
    """
    cols = target.columns
    images, _ = settle(images, "keyless_images")
    sought = images.filter(F.col("__deletes") > 0).select(*[F.col(c).alias(f"__i_{c}") for c in cols], F.lit(True).alias("__sought"))
    same = all_equal((target[c], sought[f"__i_{c}"]) for c in cols)
    marked = target.join(sought, same, "left").select(*[target[c] for c in cols], "__sought")  # at most one match
    untouched = marked.filter(F.col("__sought").isNull()).select(*cols)
    found = marked.filter(F.col("__sought")).select(*cols, F.lit(1).cast("bigint").alias("__n"))
    # equal rows of the target and the steps of their image meet in one count per image
    steps = images.select(*cols, "__up", "__down")
    counted = found.unionByName(steps, allowMissingColumns=True).groupBy(*cols)
    met = counted.agg(
        F.coalesce(F.sum("__n"), F.lit(0)).alias("__n"), F.max("__up").alias("__up"), F.max("__down").alias("__down")
    )
    again = met.select(*cols, final.cast("bigint").alias("__times"))
    return untouched.unionByName(repeat_rows(again, "__times", copies_per_row))


# ------------------------------------------------------------------------------------ error policy


@dataclass(frozen=True)
class ErrorPolicy:
    """What to do per error class: ``log`` (skip, write an exception), ``ignore`` (skip), ``suspend``
    (as ``log``, and skip all later changes of the table)."""

    insert_conflict: str = "log"
    update_missing: str = "log"
    delete_missing: str = "ignore"
    bad_data: str = "log"
    table_error: str = "suspend"
    bad_data_limit: int = 0  # so many bad rows of a table that were logged suspend it; 0: never

    def actions(self) -> dict[str, str]:
        return {
            "INSERT_CONFLICT": self.insert_conflict,
            "UPDATE_MISSING": self.update_missing,
            "DELETE_MISSING": self.delete_missing,
            "BAD_DATA": self.bad_data,
            "TABLE_ERROR": self.table_error,
        }


def classify_changes(
    target: DataFrame,
    changes: DataFrame,
    key: list[str],
    policy: ErrorPolicy = ErrorPolicy(),
    *,
    bad_data: Column | None = None,
    table_error: Column | None = None,
    table: str = "tbl",
    store: str | None = None,
    rows_per_range: int = ROWS_PER_RANGE,
    errors_before: DataFrame | None = None,
) -> DataFrame:
    """Add ``reason`` (NULL when the change applies), ``action`` and ``suspended`` to each change.

    Whether a key exists before a change follows from the last sound insert or delete before it, else
    from the target. Bad rows never change the state of a key. With ``store``, a fresh folder that all
    executors share, the judged changes are written there once and every later use reads them back.
    ``errors_before``: bad rows per table (``n``) that earlier batches have logged, for the policy's limit.
    """
    bad = F.coalesce(bad_data, F.lit(False)) if bad_data is not None else F.lit(False)
    broken = F.coalesce(table_error, F.lit(False)) if table_error is not None else F.lit(False)
    for k in key:
        bad = bad | F.col(k).isNull()
    bad = bad | ~F.coalesce(F.col("op").isin("I", "U", "D"), F.lit(False))
    marked = changes.withColumn("__bad", bad).withColumn("__broken", broken)
    sound = ~F.col("__bad") & ~F.col("__broken")
    sets = F.when(sound & (F.col("op") == "I"), F.lit(True)).when(sound & (F.col("op") == "D"), F.lit(False))
    stated = last_known(marked, [table, *key] if table in changes.columns else key, ["pos"], "__state", sets, rows_per_range=rows_per_range)

    # only the target keys that the batch names, so that a small batch does not shuffle the target
    named, _ = settle(changes.select(*key).distinct(), "named_keys")
    touched = target.select(*key).join(named, key, "left_semi")
    there = touched.select(*[F.col(k).alias(f"__t_{k}") for k in key], F.lit(True).alias("__there"))
    cond = F.lit(True)
    for k in key:
        cond = cond & (stated[k] == there[f"__t_{k}"])
    joined = stated.join(there, cond, "left").drop(*[f"__t_{k}" for k in key])
    exists = F.coalesce("__state", "__there", F.lit(False))
    reason = (
        F.when(F.col("__broken"), F.lit("TABLE_ERROR"))
        .when(F.col("__bad"), F.lit("BAD_DATA"))
        .when((F.col("op") == "I") & exists, F.lit("INSERT_CONFLICT"))
        .when((F.col("op") == "U") & ~exists, F.lit("UPDATE_MISSING"))
        .when((F.col("op") == "D") & ~exists, F.lit("DELETE_MISSING"))
    )
    action = F.lit(None).cast("string")
    for name, what in policy.actions().items():
        action = F.when(F.col("reason") == name, F.lit(what)).otherwise(action)
    out = joined.withColumn("reason", reason).drop("__bad", "__broken", "__state", "__there")
    out = out.withColumn("action", action)
    if policy.bad_data_limit and table in changes.columns:
        out = _escalated(out, table, policy.bad_data_limit, errors_before, rows_per_range)
    if store:
        out.write.parquet(store)
        out = changes.sparkSession.read.parquet(store)
    if table not in changes.columns or "suspend" not in policy.actions().values():
        return out.withColumn("suspended", F.lit(False))
    stops, _ = settle(out.filter(F.col("action") == "suspend").groupBy(table).agg(F.min("pos").alias("__stop")), "suspended")
    return (
        out.join(stops, table, "left")
        .withColumn("suspended", F.coalesce(F.col("pos") > F.col("__stop"), F.lit(False)))
        .drop("__stop")
        .select(*changes.columns, "reason", "action", "suspended")
    )


def _escalated(judged: DataFrame, table: str, limit: int, before: DataFrame | None, rows_per_range: int) -> DataFrame:
    """The bad row that brings a table to the limit suspends it. Counts start with those of earlier batches."""
    logged = F.when((F.col("reason") == "BAD_DATA") & (F.col("action") == "log"), 1).otherwise(0).cast("bigint")
    counted = running_sum(judged.withColumn("__is", logged), [table], ["pos"], "__nth", F.col("__is"), rows_per_range=rows_per_range)
    counted = counted.withColumn("__old", F.lit(0).cast("bigint"))
    if before is not None:
        old = before.select(F.col(table).alias("__t"), F.col("n").alias("__n"))  # one row per table
        counted = counted.join(old, counted[table] == old["__t"], "left").withColumn("__old", F.coalesce("__n", F.lit(0)))
    reached = (F.col("__is") == 1) & (F.col("__old") < limit) & (F.col("__old") + F.col("__nth") == limit)
    return counted.withColumn("action", F.when(reached, F.lit("suspend")).otherwise(F.col("action"))).select(*judged.columns)


def apply_with_policy(
    target: DataFrame, changes: DataFrame, key: list[str], policy: ErrorPolicy = ErrorPolicy(), **how
) -> tuple[DataFrame, DataFrame]:
    """The target after the sound changes, and the exceptions ``(exception_id, pos, key, op, reason)``.

    The exception id is the position: it is unique per change and needs no numbering over all rows.
    """
    table = how.get("table", "tbl")
    judged = classify_changes(target, changes, key, policy, **how)
    live = judged.filter(~F.col("suspended"))
    after = apply_changes(target, live.filter(F.col("reason").isNull()).select(*changes.columns), key)
    tables = [table] if table in changes.columns else []
    logged = live.filter(F.col("action").isin("log", "suspend"))
    return after, logged.select(F.col("pos").alias("exception_id"), "pos", *tables, *key, "op", "reason")


# --------------------------------------------------------------------------------------------- DDL


@dataclass(frozen=True)
class DdlPolicy:
    truncate: bool = True
    drop: bool = True
    alter: bool = True


def apply_ddl(rows: DataFrame, events: DataFrame, policy: DdlPolicy = DdlPolicy(), table: str = "tbl") -> DataFrame:
    """Rows ``(tbl, pos, ...)`` that outlive the truncates (``T``) and drops (``X``) of their table."""
    ops = [op for op, on in (("T", policy.truncate), ("X", policy.drop)) if on]
    if not ops:
        return rows
    cut, _ = settle(events.filter(F.col("op").isin(*ops)).groupBy(table).agg(F.max("pos").alias("__cut")), "ddl_cuts")
    kept = rows.join(cut, table, "left").filter(F.col("__cut").isNull() | (F.col("pos") > F.col("__cut")))
    return kept.select(*rows.columns)


def ddl_inventory(inventory: DataFrame, events: DataFrame, policy: DdlPolicy = DdlPolicy(), table: str = "tbl") -> DataFrame:
    """The inventory without the tables that a drop event names."""
    if not policy.drop:
        return inventory
    return inventory.join(events.filter(F.col("op") == "X").select(table).distinct(), table, "left_anti")


def add_columns(df: DataFrame, added: T.StructType, policy: DdlPolicy = DdlPolicy()) -> DataFrame:
    """The table with the columns that alter events add; old rows get NULL."""
    new = [f for f in added.fields if f.name not in df.columns]
    if not policy.alter or not new:
        return df
    empty = df.sparkSession.createDataFrame([], T.StructType(new))
    return df.unionByName(empty, allowMissingColumns=True)


# -------------------------------------------------------------------------------- key sync, marker


def sync_changed_keys(source: DataFrame, target: DataFrame, changed: DataFrame, key: list[str]) -> DataFrame:
    """The target with all rows of the changed keys replaced by the source rows of these keys."""
    keys, _ = settle(changed.select(*key).distinct(), "changed_keys")
    kept = target.join(keys, key, "left_anti").select(*target.columns)
    return kept.unionByName(source.join(keys, key, "left_semi").select(*target.columns))


def sync_counts(source: DataFrame, target: DataFrame, changed: DataFrame, key: list[str]) -> DataFrame:
    """One row: how many rows the sync deletes in the target and inserts from the source."""
    keys, _ = settle(changed.select(*key).distinct(), "changed_keys")
    gone = target.join(keys, key, "left_semi").select(F.lit(1).alias("d"), F.lit(0).alias("i"))
    come = source.join(keys, key, "left_semi").select(F.lit(0).alias("d"), F.lit(1).alias("i"))
    return gone.unionByName(come).agg(
        F.coalesce(F.sum("d"), F.lit(0)).alias("deleted"), F.coalesce(F.sum("i"), F.lit(0)).alias("inserted")
    )


def marker_status(source: DataFrame, target: DataFrame, as_of: Column | int, timeout: int = 60) -> DataFrame:
    """Per marker row ``(ts, status)``: has it arrived, after how many seconds, or has it timed out."""
    seen = target.groupBy("ts", "status").agg(F.min("arrived_at").alias("arrived_at"))
    arrived = F.col("arrived_at").isNotNull()
    waited = F.lit(as_of) - F.col("ts")
    return source.join(seen, ["ts", "status"], "left").select(
        "ts",
        "status",
        arrived.alias("arrived"),
        (F.col("arrived_at") - F.col("ts")).alias("delay"),
        (~arrived & (waited > timeout)).alias("timed_out"),
    )
