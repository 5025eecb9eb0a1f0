"""Benchmark passages in documents: SimHash of item-sized windows, Hamming blocks, then shared shingles by weight.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from karavel.llm.common import same_document, sized, stage, text_key

BITS = 64
RADIUS = 23  # bits that fingerprints of a window and an item may differ in; at a similarity of 0.8 they differ in 10 on average
WORD = r"[\p{L}\p{N}]+"
SHINGLES_TO_SEND = 500_000  # benchmark shingles up to this number are sent to all executors


def word_hashes(text: Column) -> Column:
    """Hashes of the words (runs of letters and digits, in small letters) of a text; none for null."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit(WORD), F.lit(0))
    return F.transform(words, lambda w: F.xxhash64(w))


def shingles(words: Column, k: int) -> Column:
    """Hashes of all runs of k words, in order."""
    runs = F.transform(F.sequence(F.lit(0), F.size(words) - k), lambda i: F.xxhash64(*(F.get(words, i + j) for j in range(k))))
    return F.when(F.size(words) >= k, runs).otherwise(F.array().cast("array<long>"))


def fingerprint(rows: DataFrame, *key: str) -> DataFrame:
    """``key``, n and the SimHash f of the shingles h of each key. Two bits are counted in the halves of one sum."""
    half = BITS // 2
    sums = [F.sum(F.shiftright("h", b).bitwiseAND(F.lit((1 << half) + 1))).alias(f"c{b}") for b in range(half)]
    f = F.lit(0).cast("long")
    for b in range(half):
        low, high = F.col(f"c{b}").bitwiseAND(F.lit((1 << half) - 1)), F.shiftrightunsigned(f"c{b}", half)
        for place, count in ((b, low), (b + half, high)):
            f = f.bitwiseOR(F.when(2 * count > F.col("n"), F.lit(_signed(1 << place))).otherwise(F.lit(0).cast("long")))
    return rows.groupBy(*key).agg(F.count("*").alias("n"), *sums).select(*key, "n", f.alias("f"))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def hamming_blocks(f: str, radius: int) -> Column:
    """Values of radius + 1 blocks of bits: fingerprints within the radius agree in one of them."""
    ends = [BITS * i // (radius + 1) for i in range(radius + 2)]
    return F.array(*(F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(f, a).bitwiseAND(F.lit((1 << (b - a)) - 1)).alias("value")) for i, (a, b) in enumerate(zip(ends[:-1], ends[1:]))))


def find_leaks(docs: DataFrame, items: DataFrame, k: int = 5, percent: int = 80, radius: int = RADIUS) -> DataFrame:
    """doc_id, th, item_id, shared, similarity, start for each document and item that one of its windows repeats.

    A window has as many words as the item (all of a shorter document). It repeats the item if their k-word shingles,
    each weighted by how often it occurs, have shared weight >= percent % of the joint weight; items with fewer than k
    words are one shingle. Windows worth a fingerprint start at a shingle of an item of their size, or end with the
    document, and hold enough such shingles; no other window can reach the similarity sooner. The best window counts,
    the earliest of equal ones. Null, empty and short texts have no shingles and give no rows. Rows that agree in
    doc_id and text are one document. Items without words are passed over; equal items each get their rows.
    """
    least = percent / 100
    docs = docs.select("doc_id", text_key().alias("th"), "text")
    items = stage(items.select("item_id", word_hashes(F.col("text")).alias("w")).withColumn("size", F.size("w")).where("size > 0"), "leak_items")
    lengths = [r[0] for r in items.select(F.least("size", F.lit(k))).distinct().collect()]  # at most k numbers

    def of_length(frame: DataFrame, size: Column, *keep: str) -> DataFrame:
        """``keep``, q and h: position and hash of every shingle, of the length that items of ``size`` words take."""
        parts = [frame.where(size == kk if kk < k else size >= k).select(*keep, F.posexplode(shingles(F.col("w"), kk)).alias("q", "h")) for kk in lengths]
        out = parts[0] if parts else frame.select(*keep, F.posexplode(shingles(F.col("w"), k)).alias("q", "h"))
        for more in parts[1:]:
            out = out.unionByName(more)
        return out

    item_shingles = stage(of_length(items, F.col("size"), "item_id", "size"), "leak_item_shingles")
    known = sized(stage(item_shingles.select("size", "h").distinct(), "leak_known"), SHINGLES_TO_SEND)
    words = docs.select("doc_id", "th", word_hashes(F.col("text")).alias("w")).withColumn("words", F.size("w"))
    hits = None
    for kk in lengths or [k]:
        found = words.where(F.col("words") >= kk).select("doc_id", "th", "words", F.posexplode(shingles(F.col("w"), kk)).alias("pos", "h"))
        mine = known.where(F.least("size", F.lit(k)) == kk)
        found = found.join(mine, "h").select("doc_id", "th", "words", "size", "pos")
        hits = found if hits is None else hits.unionByName(found)
    length = F.least("size", F.lit(k))
    spans = hits.groupBy("doc_id", "th", "words", "size").agg(F.sort_array(F.collect_set("pos")).alias("at"))
    spans = spans.withColumn("runs", F.least("words", "size") - length + 1).withColumn("item_runs", F.col("size") - length + 1)
    spans = spans.withColumn("need", F.greatest(F.lit(1), F.ceil((F.col("runs") + F.col("item_runs")) * F.lit(percent) / F.lit(100 + percent)).cast("int")))
    last = F.greatest(F.col("words") - F.col("size"), F.lit(0))
    starts = F.transform(F.sequence(F.lit(0), F.size("at") - F.col("need")), lambda i: F.when(F.get("at", i + F.col("need") - 1) < F.least(F.get("at", i), last) + F.col("runs"), F.least(F.get("at", i), last)))
    windows = spans.where(F.size("at") >= F.col("need")).select("doc_id", "th", "size", "runs", F.explode(F.array_distinct(F.filter(starts, lambda s: s.isNotNull()))).alias("start"))
    windows = stage(windows, "leak_windows")

    # the words of the few documents that are left
    wanted = sized(stage(windows.select("doc_id", "th").distinct(), "leak_wanted"))
    texts = docs.join(wanted, same_document(docs, wanted)).select(docs["doc_id"], docs["th"], "text").dropDuplicates(["doc_id", "th"])
    texts = stage(texts.select("doc_id", "th", word_hashes(F.col("text")).alias("w")), "leak_words")
    cut = windows.join(texts, same_document(windows, texts)).select(windows["doc_id"], windows["th"], "size", "start", F.slice("w", F.col("start") + 1, F.col("runs") + length - 1).alias("w"))
    key = ["doc_id", "th", "size", "start"]
    inside = stage(of_length(cut, F.col("size"), *key).select(*key, "h"), "leak_window_shingles")

    item_prints = fingerprint(item_shingles, "item_id", "size").select("item_id", "size", F.col("f").alias("g"), F.col("n").alias("item_n"))
    item_blocks = item_prints.select("*", F.explode(hamming_blocks("g", radius)).alias("b")).select("item_id", "size", "g", "item_n", "b.block", "b.value")
    item_blocks = sized(stage(item_blocks, "leak_item_blocks"), SHINGLES_TO_SEND)
    blocks = fingerprint(inside, *key).select("*", F.explode(hamming_blocks("f", radius)).alias("b")).select(*key, "n", "f", "b.block", "b.value")
    pairs = blocks.join(item_blocks, ["size", "block", "value"]).where(F.bit_count(F.col("f").bitwiseXOR(F.col("g"))) <= radius)
    pairs = stage(pairs.select(*key, "n", "item_id", "item_n").distinct(), "leak_pairs")

    weights = inside.groupBy(*key, "h").agg(F.count("*").alias("c"))
    item_weights = sized(stage(item_shingles.groupBy("item_id", "h").agg(F.count("*").alias("item_c")), "leak_item_weights"), SHINGLES_TO_SEND)
    same = pairs["doc_id"].eqNullSafe(weights["doc_id"])
    for c in key[1:]:
        same = same & (pairs[c] == weights[c])
    both = pairs.join(weights, same).select(*(pairs[c] for c in key), "n", "item_id", "item_n", "h", "c").join(item_weights, ["item_id", "h"])
    shared = both.groupBy(*key, "item_id", "n", "item_n").agg(F.sum(F.least("c", "item_c")).alias("shared"))
    shared = shared.withColumn("similarity", F.col("shared") / (F.col("n") + F.col("item_n") - F.col("shared")))
    best = shared.where(F.col("shared") * 100 >= percent * (F.col("n") + F.col("item_n") - F.col("shared"))).groupBy("doc_id", "th", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("before"), "shared")).alias("b"))
    return best.select("doc_id", "th", "item_id", "b.shared", "b.similarity", (-F.col("b.before")).alias("start"))


def remove_leaks(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """Documents (all columns) that repeat no item; see ``find_leaks`` for what counts."""
    leaks = sized(stage(find_leaks(docs, items, **options).select("doc_id", "th").distinct(), "leaks"))
    leaks = leaks.select(F.struct("doc_id", "th").alias("leak"))
    return docs.join(leaks, F.struct(docs["doc_id"], F.xxhash64(docs["text"]).alias("th")).eqNullSafe(leaks["leak"]), "left_anti")
