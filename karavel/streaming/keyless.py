"""Following a change log into a table without a key: batches of counted steps per row image."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from karavel.functions.ordered import running_sum
from karavel.operators.changes import EMPTIES, meet_images
from karavel.streaming.follow import FollowedTable, staged

STEP = ("__net", "__low", "__deletes")


def after_positions(steps: DataFrame, cols: list[str], order: list[str]) -> DataFrame:
    """Steps of an image one after the other as one step: the sum, the lowest running sum (at most 0), the deletes.

    A step (net, low) takes n copies of an image to ``max(n + net, net - low)``: it adds ``net``, and deletes that find
    no row do nothing. Two steps in a row are a step again, so batches may be put together in any grouping.
    """
    run = running_sum(steps, cols, order, "__run", F.col("__net"))
    low = F.least(F.min(F.col("__run") - F.col("__net") + F.col("__low")), F.lit(0).cast("bigint"))
    return run.groupBy(*cols).agg(F.sum("__net").alias("__net"), low.alias("__low"), F.sum("__deletes").alias("__deletes"))


class CountedTable(FollowedTable):
    """A table without a key below ``path``: base versions, and steps per row image of each batch.

    A batch is kept twice: by image and position (``steps``), and by image alone (``changes``), which is what a read
    puts together as long as the positions of batches do not overlap. Batches that do overlap, as those of a
    log that is read again do, are read by position, and what several of them hold counts once. So all changes at
    one position have to come in one batch; a log file never cuts a record.
    Changes are full images (``row_changes`` with an empty key): inserts and deletes.
    """

    keyed = False

    def __init__(self, spark: SparkSession, path: str, order: list[str] | None = None, *, name: str | None = None, commits: str | None = None):
        super().__init__(spark, path, [], order or ["pos"], name=name, commits=commits)

    def _columns(self) -> list[str]:
        return self.spark.read.parquet(f"{self.path}/base/v={self._version()[0]}").columns

    def store(self, changes: DataFrame, name: str, endpos: int | None = None, policy=None, **how) -> dict:
        if policy is not None:
            raise ValueError("without a key no change conflicts with another one")
        changes, cols = staged(changes, "batch"), self._columns()
        fresh = self._own(changes, endpos)
        is_delete = F.when(F.col("op") == "D", 1).otherwise(0).cast("bigint")
        rows = fresh.filter(F.col("op").isin("I", "D")).withColumns({"__net": 1 - 2 * is_delete, "__low": -is_delete, "__deletes": is_delete})
        ties = self.order[1:]
        if ties:  # several steps at one position
            steps = after_positions(rows, [*cols, "pos"], ties)
        else:
            steps = rows.groupBy(*cols, "pos").agg(F.sum("__net").alias("__net"), F.min("__low").alias("__low"), F.sum("__deletes").alias("__deletes"))
        steps.write.mode("overwrite").parquet(f"{self.path}/steps/{name}")
        written = self.spark.read.schema(steps.schema).parquet(f"{self.path}/steps/{name}")
        after_positions(written, cols, ["pos"]).write.mode("overwrite").parquet(f"{self.path}/changes/{name}")
        cut = F.max(F.when(F.col("op").isin(*EMPTIES), F.col("pos")))
        first, last, cut_pos = fresh.agg(F.min("pos"), F.max("pos"), cut).first()
        seen = changes.agg(F.max("pos")).first()[0]
        return {"max_pos": last, "rows": written.count(), "seen_pos": seen, "first_pos": first, "cut_pos": cut_pos}

    def _images(self, low: int, high: int | None) -> tuple[DataFrame | None, bool]:
        """All steps at positions above ``low``, up to ``high``, as one per image, and whether the base is emptied first."""
        found = self.commits().filter("first_pos is not null").select("name", "first_pos", "max_pos", "cut_pos")
        batches = sorted((int(r["first_pos"]), int(r["max_pos"]), r["name"], r["cut_pos"]) for r in found.collect())  # one row per batch
        cuts = [int(b[3]) for b in batches if b[3] is not None and int(b[3]) > low and (high is None or int(b[3]) <= high)]
        emptied, low = bool(cuts), max([low, *cuts])
        batches = [b for b in batches if b[1] > low and (high is None or b[0] <= high)]
        alone, cols, reach = [], self._columns(), None
        for i, (first, last, name, cut_pos) in enumerate(batches):
            clear = (reach is None or first > reach) and (i + 1 == len(batches) or last < batches[i + 1][0])
            if clear and first > low and (high is None or last <= high) and cut_pos is None:
                alone.append((name, first))
            reach = last if reach is None else max(reach, last)
        mixed = [b[2] for b in batches if b[2] not in {n for n, _ in alone}]
        parts = []
        if alone:
            names = self.spark.createDataFrame([(n, str(p)) for n, p in alone], "batch string, at string")
            one = self.spark.read.parquet(*[f"{self.path}/changes/{n}" for n, _ in alone]).withColumn("batch", F.element_at(F.split(F.input_file_name(), "/"), -2))
            one = one.withColumn("batch", F.url_decode("batch")).join(F.broadcast(names), "batch")
            parts.append(one.select(*cols, F.col("at").cast("decimal(20,0)").alias("__at"), *STEP))
        if mixed:
            many = self.spark.read.parquet(*[f"{self.path}/steps/{n}" for n in mixed]).filter(F.col("pos") > low)
            many = many if high is None else many.filter(F.col("pos") <= high)
            many = many.dropDuplicates([*cols, "pos"])
            parts.append(many.select(*cols, F.col("pos").cast("decimal(20,0)").alias("__at"), *STEP))
        if not parts:
            return None, emptied
        steps = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        return after_positions(staged(steps, "steps"), cols, ["__at"]), emptied

    def _after(self, low: int, high: int | None) -> DataFrame:
        base = self.spark.read.parquet(f"{self.path}/base/v={self._version()[0]}")
        images, emptied = self._images(low, high)
        base = base.limit(0) if emptied else base
        if images is None:
            return base
        named = images.withColumnsRenamed({"__net": "__up", "__low": "__down", "__deletes": "__deletes"})
        return meet_images(base, named, F.greatest(F.col("__n"), -F.col("__down")) + F.col("__up"))

    def read(self) -> DataFrame:
        """The table after all committed batches."""
        return self._after(self._version()[1], None)

    def compact(self, upto: int | None = None) -> int:
        """Write the table after all changes up to a position as the next base version. All of them must have come: later ones below it are dropped."""
        version, known = self._version()
        if upto is None:
            raise ValueError("steps count, so a base needs the position up to which it holds them")
        upto = max(upto, known)
        self._after(known, upto).write.mode("overwrite").parquet(f"{self.path}/base/v={version + 1}")
        self._publish(version + 1, upto)
        return version + 1

    def prune(self, keep: int = 2) -> None:
        """Delete base versions older than the newest ``keep``, and batches that the oldest kept one holds."""
        super().prune(keep)
        for name in set(self._finished("steps")) - set(self._finished("changes")):
            self._forget("steps", name)
