"""Source against target: objects, definitions, counts, spot checks, rows, and one verdict.

Every check returns rows; ``verdict`` adds them up. A check that could not run is a row with status
``ERROR``. It is never counted as a match.
"""

from __future__ import annotations

import logging
import math
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from threading import Timer

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F, types as T

from karavel.functions.expr import all_equal, alike, clamp, common_type, div, hash_halves, is_integral, row_hash
from karavel.functions.sized import settle

# Verdict per kind for objects that are missing in the target, extra in it, or changed.
OBJECT_VERDICTS = {
    "table": ("FAIL", "WARN"),
    "view": ("FAIL", None),
    "function": ("FAIL", None),
    "sequence": ("FAIL", None),
}
DEFINITION_VERDICTS = {
    "column": ("FAIL", "WARN"),
    "index": ("FAIL", "WARN"),
    "constraint": ("FAIL", None),
    "extension": ("WARN", None),
}
# Fixed value: key types for which a min/max check makes sense, matched at the start of the type name.
SPOT_TYPES = (
    "^(int2|int4|int8|float4|float8|numeric|money|bigserial|serial|smallserial|"
    "timestamp|timestamptz|date|time|timetz)"
)


def _by_kind(table: dict[str, tuple[str, str | None]], place: int) -> Column:
    out = F.lit(None).cast("string")
    for kind, verdicts in table.items():
        out = F.when(F.col("kind") == kind, F.lit(verdicts[place])).otherwise(out)
    return out


# ------------------------------------------------------------------------------ objects, definitions


def object_diff(src: DataFrame, tgt: DataFrame) -> DataFrame:
    """Objects on one side only, with verdict. One pass over both inventories, one aggregation."""
    cols = ["kind", "schema_name", "name"]
    both = src.select(*cols, F.lit(True).alias("s"), F.lit(False).alias("t")).unionByName(
        tgt.select(*cols, F.lit(False).alias("s"), F.lit(True).alias("t"))
    )
    one_side = both.groupBy(*cols).agg(F.max("s").alias("s"), F.max("t").alias("t")).filter(F.col("s") != F.col("t"))
    missing = F.col("s")
    verdict = F.when(missing, _by_kind(OBJECT_VERDICTS, 0)).otherwise(_by_kind(OBJECT_VERDICTS, 1))
    return one_side.select(
        *cols, F.when(missing, "missing").otherwise("extra").alias("side"), verdict.alias("verdict")
    ).filter(F.col("verdict").isNotNull())


def object_counts(src: DataFrame, tgt: DataFrame) -> DataFrame:
    """Objects per kind on both sides; unequal table counts are a failure by themselves."""
    both = src.select("kind", F.lit(1).alias("s"), F.lit(0).alias("t")).unionByName(
        tgt.select("kind", F.lit(0).alias("s"), F.lit(1).alias("t"))
    )
    sums = both.groupBy("kind").agg(F.sum("s").alias("src_count"), F.sum("t").alias("tgt_count"))
    equal = F.col("src_count") == F.col("tgt_count")
    verdict = F.when(equal, "PASS").when(F.col("kind") == "table", "FAIL").otherwise("INFO")
    return sums.withColumn("verdict", verdict)


def column_definitions(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """One row per column of the given tables, with the definition as one text."""
    rows = [
        ("column", table, f.name, f"type={f.dataType.simpleString()}  nullable={'YES' if f.nullable else 'NO'}  default=NULL")
        for table, df in tables.items()
        for f in df.schema.fields
    ]
    return spark.createDataFrame(rows, "kind string, object string, name string, definition string")


def definition_diff(src: DataFrame, tgt: DataFrame) -> DataFrame:
    """Definitions ``(kind, object, name, definition)`` that are missing, extra or changed, with verdict."""
    cols = ["kind", "object", "name"]
    none = F.lit(None).cast("string")
    both = src.select(*cols, F.col("definition").alias("d_s"), none.alias("d_t"), F.lit(1).alias("s"), F.lit(0).alias("t"))
    both = both.unionByName(
        tgt.select(*cols, none.alias("d_s"), F.col("definition").alias("d_t"), F.lit(0).alias("s"), F.lit(1).alias("t"))
    )
    pairs = both.groupBy(*cols).agg(
        F.max("d_s").alias("src_definition"), F.max("d_t").alias("tgt_definition"), F.sum("s").alias("s"), F.sum("t").alias("t")
    )
    state = (
        F.when(F.col("t") == 0, "missing")
        .when(F.col("s") == 0, "extra")
        .when(~F.col("src_definition").eqNullSafe(F.col("tgt_definition")), "changed")
    )
    verdict = F.when(F.col("state") == "extra", _by_kind(DEFINITION_VERDICTS, 1)).otherwise(_by_kind(DEFINITION_VERDICTS, 0))
    return (
        pairs.withColumn("state", state)
        .filter(F.col("state").isNotNull())
        .withColumn("verdict", verdict)
        .select(*cols, "state", "src_definition", "tgt_definition", "verdict")
    )


# --------------------------------------------------------------------------------- estimates, marks


def estimate_diff(src: DataFrame, tgt: DataFrame, tolerance: int = 5) -> DataFrame:
    """Row estimates ``(tbl, est_rows)`` that differ by more than ``tolerance`` whole percent. Warnings only."""
    s = src.select("tbl", clamp(F.col("est_rows")).alias("src_rows"))
    t = tgt.select("tbl", clamp(F.col("est_rows")).alias("tgt_rows"))
    pct = div(F.abs(F.col("src_rows") - F.col("tgt_rows")) * 100, F.col("src_rows"))
    off = F.when(F.col("src_rows") > 0, F.col("diff_pct") > tolerance).otherwise(F.col("tgt_rows") != 0)
    return s.join(t, "tbl").withColumn("diff_pct", pct).filter(off).withColumn("verdict", F.lit("WARN"))


def high_water_lag(src: DataFrame, tgt: DataFrame) -> DataFrame:
    """Marks ``(seq, last_value)`` that are lower in the target. A mark never used counts as 0."""
    s = src.select("seq", F.coalesce("last_value", F.lit(0)).alias("src_last"))
    t = tgt.select("seq", F.coalesce("last_value", F.lit(0)).alias("tgt_last"))
    behind = s.join(t, "seq").filter(F.col("tgt_last") < F.col("src_last"))
    return behind.withColumn("behind", F.col("src_last") - F.col("tgt_last")).withColumn("verdict", F.lit("WARN"))


# ------------------------------------------------------- checks that run one bounded job per table


def _run_each(
    spark: SparkSession, jobs: dict[str, Callable[[], Row]], timeout: float | None, threads: int
) -> dict[str, Row | str]:
    """Run one small job per name. The value is its row, ``TIMEOUT``, or ``ERROR: ...``."""

    def one(job: Callable[[], Row]) -> Row | str:
        group = f"karavel-{uuid.uuid4().hex}"
        spark.sparkContext.setJobGroup(group, "table check", interruptOnCancel=True)
        late = []

        def stop() -> None:
            late.append(True)
            spark.sparkContext.cancelJobGroup(group)

        timer = Timer(timeout, stop) if timeout else None
        if timer:
            timer.daemon = True
            timer.start()
        try:
            return job()
        except Exception as e:  # noqa: BLE001  any failure of one table becomes its state
            return "TIMEOUT" if late else f"ERROR: {str(e).splitlines()[0][:200]}"
        finally:
            if timer:
                timer.cancel()

    with ThreadPoolExecutor(max_workers=max(1, threads)) as pool:
        futures = {name: pool.submit(inheritable_thread_target(spark)(one), job) for name, job in jobs.items()}
        return {name: f.result() for name, f in futures.items()}


Source = DataFrame | Callable[[], DataFrame]


def _open(tables: dict[str, Source], name: str) -> DataFrame:
    source = tables[name]
    return source() if callable(source) else source


def sample_tables(stats: DataFrame, n: int, max_bytes: int, seed: str) -> DataFrame:
    """``n`` tables of 1 to ``max_bytes`` bytes in an order that depends only on name and seed."""
    fits = stats.filter(F.col("bytes").between(1, max_bytes))
    return fits.orderBy(F.md5(F.concat(F.col("tbl").cast("string"), F.lit(seed))), "tbl").limit(n)


def exact_counts(
    spark: SparkSession,
    src_tables: dict[str, Source],
    tgt_tables: dict[str, Source],
    stats: DataFrame,
    *,
    n: int = 10,
    max_bytes: int = 10 * 1024**3,
    seed: str = "0",
    timeout: float | None = 120,
    threads: int = 4,
) -> DataFrame:
    """Exact counts of sampled tables: ERROR, TIMEOUT, MATCH or MISSING with the difference and whole percent.

    Each count is a Spark job of its own, so one unreadable table becomes a state and not a failed run.
    """
    names = [r["tbl"] for r in sample_tables(stats, n, max_bytes, seed).select("tbl").collect()]
    jobs = {}
    for name in names:
        for side, tables in (("src", src_tables), ("tgt", tgt_tables)):
            jobs[f"{side} {name}"] = lambda tables=tables, name=name: _open(tables, name).agg(F.count("*")).first()
    results = _run_each(spark, jobs, timeout, threads)
    rows = []
    for name in names:
        pair = [results[f"src {name}"], results[f"tgt {name}"]]
        errors = [r for r in pair if isinstance(r, str) and r.startswith("ERROR")]
        counts = [None if isinstance(r, str) else r[0] for r in pair]
        if errors:
            state, detail = "ERROR", errors[0]
        elif "TIMEOUT" in pair:
            state, detail = "TIMEOUT", None
        else:
            state, detail = ("MATCH" if counts[0] == counts[1] else "MISSING"), None
        diff = counts[0] - counts[1] if state == "MISSING" else None
        pct = None
        if diff is not None:
            pct = math.trunc(diff * 100 / counts[0]) if counts[0] > 0 else 0
        verdict = {"MATCH": "PASS", "TIMEOUT": "WARN", "ERROR": "ERROR"}.get(state, "FAIL")
        rows.append((name, state, *counts, diff, pct, verdict, detail))
    schema = "tbl string, state string, src_count bigint, tgt_count bigint, diff bigint, diff_pct bigint, verdict string, detail string"
    return spark.createDataFrame(rows, schema)


def sampled_count(df: DataFrame, percent: float = 1.0, seed: int = 0) -> DataFrame:
    """Estimated row count from a repeatable sample."""
    sample = df.select().sample(fraction=percent / 100, seed=seed)
    return sample.agg((F.count("*") * F.lit(100) / F.lit(percent)).cast("bigint").alias("est_rows"))


def minmax_check(
    spark: SparkSession,
    src_tables: dict[str, Source],
    tgt_tables: dict[str, Source],
    keys: DataFrame,
    *,
    n: int = 20,
    threads: int = 4,
) -> DataFrame:
    """Min and max of single-column keys ``(tbl, column_name, type, est_rows)`` of the ``n`` biggest tables.

    The type test comes after the limit, so skipped tables use up the budget. Text comparison, NULL
    equal to NULL; a query that fails is an ERROR.
    """
    top = keys.orderBy(F.col("est_rows").desc(), "tbl").limit(n)
    chosen = top.select("tbl", "column_name", "type", F.col("type").rlike(SPOT_TYPES).alias("fits")).collect()
    jobs = {}
    for r in chosen:
        if r["fits"]:
            for side, tables in (("src", src_tables), ("tgt", tgt_tables)):
                jobs[f"{side} {r['tbl']}"] = lambda tables=tables, r=r: (
                    _open(tables, r["tbl"])
                    .agg(F.min(r["column_name"]).alias("lo"), F.max(r["column_name"]).alias("hi"))
                    .select(F.col("lo").cast("string"), F.col("hi").cast("string"))
                    .first()
                )
    results = _run_each(spark, jobs, None, threads)
    rows = []
    for r in chosen:
        if not r["fits"]:
            rows.append((r["tbl"], r["column_name"], r["type"], None, None, None, None, "SKIPPED"))
            continue
        pair = [results[f"src {r['tbl']}"], results[f"tgt {r['tbl']}"]]
        values = [(None, None) if isinstance(p, str) else (p["lo"], p["hi"]) for p in pair]
        if any(isinstance(p, str) for p in pair):
            verdict = "ERROR"
        else:
            verdict = "PASS" if values[0] == values[1] else "FAIL"
        rows.append((r["tbl"], r["column_name"], r["type"], *values[0], *values[1], verdict))
    schema = (
        "tbl string, column_name string, type string, src_min string, src_max string, "
        "tgt_min string, tgt_max string, verdict string"
    )
    return spark.createDataFrame(rows, schema)


# ------------------------------------------------------------------------------------ row comparison


def _bucket(df: DataFrame, key: list[str], partition_size: int, buckets: int) -> Column:
    if len(key) == 1 and is_integral(df, key[0]):
        return div(F.col(key[0]), partition_size)
    return F.pmod(row_hash(df, key), F.lit(buckets))


def _signed(src: DataFrame, tgt: DataFrame, cols: list[str]) -> DataFrame:
    """Rows of both sides with ``__sign``: source +1, target -1."""
    one = F.lit(1).cast("bigint")
    return src.select(*cols).withColumn("__sign", one).unionByName(tgt.select(*cols).withColumn("__sign", -one))


def type_diff(src: DataFrame, tgt: DataFrame) -> DataFrame:
    """Columns of both tables whose types differ: ``(column_name, src_type, tgt_type, comparable)``.

    Where the types have no common one, ``comparable`` is false, and values are compared as text.
    """
    both = [(f.name, f.dataType, tgt.schema[f.name].dataType) for f in src.schema if f.name in tgt.columns]
    rows = [(n, a.simpleString(), b.simpleString(), common_type(a, b) is not None) for n, a, b in both if a != b]
    return src.sparkSession.createDataFrame(rows, "column_name string, src_type string, tgt_type string, comparable boolean")


# How text is compared, by the name of the option.
COLLATIONS: dict[str, Callable[[Column], Column]] = {
    "binary": lambda c: c,
    "ignore_case": F.lower,
    "ignore_trailing_blanks": F.rtrim,
    "ignore_case_and_trailing_blanks": lambda c: F.lower(F.rtrim(c)),
}


def _collated(df: DataFrame, collation: str) -> DataFrame:
    rule = COLLATIONS[collation]
    return df.select(*[rule(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name) for f in df.schema])


def _in_unequal_buckets(both: DataFrame, bucket: Column, hash_col: Column) -> DataFrame:
    """Rows of the buckets whose signed row count or hash sums are not 0.

    The sums are computed at once and only they move; the unequal bucket numbers go to the shared
    folder, and rows of equal buckets are not shuffled at all.
    """
    high, low = hash_halves(F.col("__h"))
    prints = both.select(bucket.alias("__b"), "__sign", hash_col.alias("__h")).groupBy("__b").agg(
        F.sum("__sign").alias("n"), F.sum(F.col("__sign") * high).alias("high"), F.sum(F.col("__sign") * low).alias("low")
    )
    unequal = prints.filter((F.col("n") != 0) | (F.col("high") != 0) | (F.col("low") != 0)).select("__b")
    unequal, found = settle(unequal, "unequal_buckets")
    if not found:
        return both.limit(0)
    hit = both.withColumn("__bucket", bucket)
    return hit.join(unequal, F.col("__bucket").eqNullSafe(F.col("__b")), "left_semi").drop("__bucket")


def row_diff(
    src: DataFrame,
    tgt: DataFrame,
    key: list[str],
    *,
    skip_cols: list[str] | None = None,
    partition_size: int = 10_000,
    buckets: int = 65_536,
    collation: str = "binary",
    counts: bool = False,
) -> DataFrame:
    """Rows that differ: key, state (MISSING_TARGET, MISSING_SOURCE, DIFFERENT), differing columns.

    Values are compared in types that hold those of both sides, text as ``collation`` says (see ``COLLATIONS``; keys come
    back as compared). First pass: fingerprints per key bucket. Second pass: rows of unequal buckets are counted
    per full image and side, then put together per key, one row each. A key is missing only if the other side has
    no row of it; one that is not unique is DIFFERENT as soon as copies of any image differ, and ``counts`` adds
    ``src_rows`` and ``tgt_rows``, the rows of the key on either side.
    """
    cols = [c for c in src.columns if c not in (skip_cols or [])]
    rest = [c for c in cols if c not in key]
    src, tgt = (_collated(df, collation) for df in alike(src, tgt, cols))
    hit = _in_unequal_buckets(_signed(src, tgt, cols), _bucket(src, key, partition_size, buckets), row_hash(src, cols))
    images = hit.groupBy(*cols).agg(F.count_if(F.col("__sign") > 0).alias("__a"), F.count_if(F.col("__sign") < 0).alias("__b"))
    image = F.struct(*rest) if rest else F.struct(F.lit(1).alias("__one"))
    more, fewer = F.col("__a") > F.col("__b"), F.col("__a") < F.col("__b")
    sides = images.groupBy(*key).agg(
        F.max(F.when(more, image)).alias("__s"),
        F.max(F.when(fewer, image)).alias("__t"),
        F.sum("__a").alias("src_rows"),
        F.sum("__b").alias("tgt_rows"),
    ).filter(F.col("__s").isNotNull() | F.col("__t").isNotNull())
    state = F.when(F.col("tgt_rows") == 0, "MISSING_TARGET").when(F.col("src_rows") == 0, "MISSING_SOURCE").otherwise("DIFFERENT")
    changed = [
        F.when(F.col("__s").isNotNull() & F.col("__t").isNotNull() & ~F.col("__s")[c].eqNullSafe(F.col("__t")[c]), F.lit(c))
        for c in rest
    ]
    listed = F.concat_ws(",", *changed) if changed else F.lit("")
    return sides.select(*key, state.alias("state"), listed.alias("columns"), *(["src_rows", "tgt_rows"] if counts else []))


def row_diff_keyless(src: DataFrame, tgt: DataFrame, *, buckets: int = 65_536, collation: str = "binary") -> DataFrame:
    """Full row images whose number of copies differs, with both numbers. Buckets come from the image's hash."""
    cols = src.columns
    src, tgt = (_collated(df, collation) for df in alike(src, tgt, cols))
    image_hash = row_hash(src, cols)
    hit = _in_unequal_buckets(_signed(src, tgt, cols), F.pmod(image_hash, F.lit(buckets)), image_hash)
    counted = hit.groupBy(*cols).agg(
        F.count_if(F.col("__sign") > 0).alias("src_copies"), F.count_if(F.col("__sign") < 0).alias("tgt_copies")
    )
    return counted.filter(F.col("src_copies") != F.col("tgt_copies"))


PENDING = ("state", "columns", "first_at", "last_at")


def pending_rows(diffs: DataFrame, key: list[str], at: int) -> DataFrame:
    """Rows that differ at a moment (seconds), not failed yet: key, state, columns, first and last moment seen."""
    at_ = F.lit(at).cast("bigint")
    return diffs.select(*key, "state", "columns", at_.alias("first_at"), at_.alias("last_at"))


def recheck_rows(src: DataFrame, tgt: DataFrame, key: list[str], pending: DataFrame, at: int, touched: DataFrame | None = None, **how) -> DataFrame:
    """The pending set at a later moment, while changes still flow.

    Only rows of pending keys, and of keys that changes have ``touched`` since, are compared again. A key that is equal
    now goes, one that still differs keeps its first moment, a new one begins now. ``how`` is for ``row_diff``.
    """
    keys = pending.select(*key)
    if touched is not None:
        keys = keys.unionByName(touched.select(*key))
    keys, _ = settle(keys.distinct(), "recheck")
    now = row_diff(src.join(keys, key, "left_semi"), tgt.join(keys, key, "left_semi"), key, **how)
    before = pending.select(*[F.col(k).alias(f"__{k}") for k in key], F.col("first_at").alias("__first"))
    known = now.join(before, all_equal((now[k], before[f"__{k}"]) for k in key), "left")
    at_ = F.lit(at).cast("bigint")
    return known.select(*key, "state", "columns", F.coalesce("__first", at_).alias("first_at"), at_.alias("last_at"))


def outlasted(pending: DataFrame, delay: int) -> DataFrame:
    """Pending rows that have differed for longer than the delay (seconds): the failures. With a delay of 0, all that were seen twice."""
    return pending.filter(F.col("last_at") - F.col("first_at") > delay)


def validation_status(diffs: DataFrame, by: str = "tbl", table_max: int = 1000, overall_max: int = 10_000) -> DataFrame:
    """Failures per table with its state once the limits are applied; the difference rows stay whole."""
    per = diffs.groupBy(by).agg(
        F.count("*").alias("failures"),
        F.count_if(F.col("state") == "MISSING_TARGET").alias("missing_target"),
        F.count_if(F.col("state") == "MISSING_SOURCE").alias("missing_source"),
        F.count_if(F.col("state") == "DIFFERENT").alias("different"),
    )
    overall = diffs.agg(F.count("*").alias("__all"))  # one row, sent to all
    out = per.withColumn("suspended", F.col("failures") >= table_max).join(F.broadcast(overall))
    return out.withColumn("task_stopped", F.col("__all") >= overall_max).drop("__all")


# ------------------------------------------------------------------------------------------ verdict


def verdict(checks: DataFrame, gate: bool = False, by: list[str] | None = None) -> DataFrame:
    """Counts of pass, warn, fail and error, and the exit code.

    2 if any check failed, else 1 if any warned, else 0; 3 whenever a check could not run. As a
    readiness gate: 1 if any failed, else 0.
    """

    def count(status: str) -> Column:
        return F.count_if(F.col("status") == status)

    code = F.when(count("ERROR") > 0, 3)
    code = code.when(count("FAIL") > 0, 1 if gate else 2)
    code = code.otherwise(0) if gate else code.when(count("WARN") > 0, 1).otherwise(0)
    return checks.groupBy(*(by or [])).agg(
        count("PASS").alias("passed"),
        count("WARN").alias("warned"),
        count("FAIL").alias("failed"),
        count("ERROR").alias("errors"),
        code.alias("exit_code"),
    )


def run_check(spark: SparkSession, check: str, rows: Callable[[], DataFrame], status: str = "verdict") -> DataFrame:
    """``as_checks`` of a check that may not be able to run: then its one row is an ERROR, which gives exit code 3."""
    try:
        found = [tuple(r) for r in as_checks(check, rows(), status).collect()]  # one row
    except Exception as e:  # whatever keeps a check from running is its result
        found = [(check, "ERROR")]
        logging.getLogger(__name__).warning("check %s could not run: %s", check, str(e).split("\n")[0])
    return spark.createDataFrame(found, "check string, status string")


def as_checks(check: str, rows: DataFrame, status: str = "verdict") -> DataFrame:
    """Rows of a check as ``(check, status)``; a check without findings gives one PASS row."""
    found = rows.agg(
        *[F.count_if(F.col(status) == s).alias(s) for s in ("PASS", "WARN", "FAIL", "ERROR")]
    )
    worst = (
        F.when(F.col("ERROR") > 0, "ERROR").when(F.col("FAIL") > 0, "FAIL").when(F.col("WARN") > 0, "WARN").otherwise("PASS")
    )
    return found.select(F.lit(check).alias("check"), worst.alias("status"))


# -------------------------------------------------------------------------- settings, keys, readiness


def settings_diff(wanted: DataFrame, src: DataFrame, tgt: DataFrame) -> DataFrame:
    """Wanted settings ``(name, restart, category)`` with both values and SAME or DIFF; absent is ``N/A``."""

    def side(df: DataFrame, alias: str) -> DataFrame:
        return df.select("name", F.nullif(F.concat_ws(" ", "setting", "unit"), F.lit("")).alias(alias))

    joined = wanted.join(side(src, "src_value"), "name", "left").join(side(tgt, "tgt_value"), "name", "left")
    joined = joined.fillna("N/A", ["src_value", "tgt_value"])
    return joined.withColumn("status", F.when(F.col("src_value") == F.col("tgt_value"), "SAME").otherwise("DIFF"))


def settings_summary(diff: DataFrame) -> DataFrame:
    """Same and different settings per category and restart flag, per category, and in total."""
    return diff.rollup("category", "restart").agg(
        F.count_if(F.col("status") == "SAME").alias("same"), F.count_if(F.col("status") == "DIFF").alias("different")
    )


def key_check(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row: distinct keys, keys that occur more than once, rows with a NULL in the key, and if it is usable."""
    null_key = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in cols])
    per = df.groupBy(*cols).agg(F.count("*").alias("n"))
    return per.agg(
        F.count_if(~null_key).alias("keys"),
        F.count_if((F.col("n") > 1) & ~null_key).alias("duplicated"),
        F.coalesce(F.sum(F.when(null_key, F.col("n"))), F.lit(0)).alias("null_rows"),
    ).withColumn("usable", (F.col("duplicated") == 0) & (F.col("null_rows") == 0))


def keyless_tables(inventory: DataFrame, constraints: DataFrame) -> DataFrame:
    """Tables with default replica identity (``d``) and no primary or unique constraint."""
    keyed = constraints.filter(F.col("contype").isin("p", "u")).select("schema_name", "name").distinct()
    plain = inventory.filter((F.col("kind") == "table") & (F.col("replica_identity") == "d"))
    return plain.join(keyed, ["schema_name", "name"], "left_anti").select("schema_name", "name")


def read_coverage(relations: DataFrame, check_sequences: bool = True) -> DataFrame:
    """Per schema: relations and how many cannot be read, with a state by fixed priority."""
    stored = F.col("kind").isin("table", "matview")
    seq = (F.col("kind") == "sequence") & F.lit(check_sequences)
    unread = ~F.col("readable")
    counts = relations.groupBy("schema_name").agg(
        F.min("schema_usable").alias("usable"),
        F.count_if(stored).alias("tables"),
        F.count_if(stored & unread).alias("tables_unreadable"),
        F.count_if((F.col("kind") == "matview") & unread).alias("matviews_unreadable"),
        F.count_if(seq).alias("sequences"),
        F.count_if(seq & unread).alias("sequences_unreadable"),
    )
    t, q = F.col("tables_unreadable") > 0, F.col("sequences_unreadable") > 0
    state = (
        F.when(~F.col("usable"), "NO_USAGE")
        .when(t & q, "TABLES_AND_SEQUENCES")
        .when(t, "TABLES")
        .when(q, "SEQUENCES")
        .otherwise("PASS")
    )
    return counts.withColumn("state", state).drop("usable")


def availability(required: DataFrame, excluded: DataFrame, available: DataFrame) -> DataFrame:
    """One row: names checked, names missing, outcome (``missing``, ``all there``, ``nothing to check``)."""
    checked = required.select("name").distinct().join(excluded.select("name"), "name", "left_anti")
    there = available.select("name", F.lit(1).alias("there")).distinct()
    counts = checked.join(there, "name", "left").agg(
        F.count("*").alias("checked"), F.count_if(F.col("there").isNull()).alias("missing")
    )
    outcome = (
        F.when(F.col("missing") > 0, "missing").when(F.col("checked") > 0, "all there").otherwise("nothing to check")
    )
    return counts.withColumn("outcome", outcome)


def load_readiness(src_stats: DataFrame, tgt_inventory: DataFrame, leftover_names: DataFrame) -> DataFrame:
    """What stands against a load: leftovers in the target (WARN), and source tables whose estimate is
    above 0 while nothing can be read (FAIL, a row filter hides the rows)."""
    leftovers = tgt_inventory.join(leftover_names, "name", "left_semi").select(
        F.lit("leftover").alias("check"), "name", F.lit("WARN").alias("status")
    )
    hidden = src_stats.filter((F.col("est_rows") > 0) & (F.col("rows_read") == 0)).select(
        F.lit("hidden rows").alias("check"), F.col("tbl").cast("string").alias("name"), F.lit("FAIL").alias("status")
    )
    return leftovers.unionByName(hidden)
