"""Fuzzy line deduplication: MinHash of character shingles, banding, exact Jaccard, distributed union-find.

* Equal lines are one: lines are grouped by their text, with map-side combine, which keeps the first occurrence.
* Signatures: one permutation of the shingles into ``BINS`` bins, empty bins filled from the next full one;
  bands of ``ROWS`` bins are the keys under which lines meet.
* Only lines that meet another or occur again travel further: a filter of bitmaps picks them where they lie.
* Verification: in a band, each line is compared with the leader (the least number); then, where the lines of
  a band are still in several components, with every line of the other components, block by block. That loses no
  connection that all pairs would give, without forming the pairs inside a component. Sketches of the shingle
  sets tell most pairs apart that cannot be similar enough; for the others the sets are compared, exactly.
* Components are found by union-find in rounds; the occurrence that comes first, by document and line, stays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BITS, boxed, components, hit_filter, lookup, materialise, may_hit, partitions, unboxed
from .pieces import mix
from .units import MAIL, STEP, Places, columns_of, delivered, exchange, id_of, rolling, scatter, short, trim

SHINGLE = 10
THRESHOLD = 0.75
BINS = 64
ROWS = 4
BANDS = 16
#: Lines of fewer characters, blanks and tabs aside, are never removed: only blank lines. A line shorter than a shingle is similar to its exact copies only.
MIN_CHARS = 1


#: Cells of a sketch.
CELLS = 128
#: Band keys of one bucket, about.
BUCKET = 1 << 20
#: Lines of one band that meet in one task at most; larger bands are cut into blocks.
BLOCK = 512


#: Characters that are hashed at once: their arrays stay in a core's cache.
NEAR = 1 << 17
#: Bits of a filter for each row that it is made of, and bitmaps of one filter at most (of 4 KB).
BITS_PER_ROW = 8
FILTER = 8192


def stretches(lines: list[str], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of lines of about ``most`` characters."""
    lo = size = 0
    for k, line in enumerate(lines):
        if size and size + len(line) > most:
            yield lo, k
            lo, size = k, 0
        size += len(line)
    if lo < len(lines):
        yield lo, len(lines)


def shingle_hashes(lines: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the character shingles of all lines, and the line of each; a shorter line is one shingle."""
    padded = [x if len(x) >= k else x + "\0" * (k - len(x)) for x in lines]
    pad = np.array([*map(len, padded)], np.int64)
    row = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32)
    hashes = rolling(row, k)
    inside = np.ones(len(row), bool)  # places where a shingle lies in one line
    inside[(np.cumsum(pad)[:, None] - np.arange(1, k)).ravel()] = False
    return mix(hashes[inside[: len(hashes)]]), np.repeat(np.arange(len(lines)), pad - k + 1)


def band_keys(lines: list[str], k: int = SHINGLE, bins: int = BINS, rows: int = ROWS, bands: int = BANDS) -> np.ndarray:
    """``len(lines) x bands`` keys."""
    if bins & (bins - 1):
        raise ValueError("bins is a power of two")
    sig = np.full((len(lines), bins), np.iinfo(np.uint64).max, np.uint64)
    h, of = shingle_hashes(lines, k)
    np.minimum.at(sig.reshape(-1), of * bins + (h & np.uint64(bins - 1)).astype(np.int64), h >> np.uint64(bins.bit_length() - 1))
    del h, of
    some = np.flatnonzero((sig == np.iinfo(np.uint64).max).any(1))
    part = sig[some]
    full = np.where(part == np.iinfo(np.uint64).max, 2 * bins, np.arange(bins))
    upto = np.minimum.accumulate(np.concatenate([full, full + bins], 1)[:, ::-1], 1)[:, ::-1][:, :bins]  # the next full bin, round the end
    shift = upto - np.arange(bins)
    from_next = part[np.arange(len(some))[:, None], upto % bins]
    filled = sig
    filled[some] = np.where(shift > 0, mix(from_next + shift.astype(np.uint64)), part)
    out = np.empty((len(lines), bands), np.uint64)
    for b in range(bands):
        key = np.full(len(lines), b + 1, np.uint64)
        for r in range(rows):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + filled[:, b * rows + r])
        out[:, b] = key
    return out


def shingle_sets(lines: list[str], k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The sorted different shingle hashes of each line, one line after the other, and the line of each; about ``NEAR`` characters at a time."""
    for lo, hi in stretches(lines, NEAR):
        h, of = shingle_hashes(lines[lo:hi], k)
        of = of.astype(np.uint16 if hi - lo <= 1 << 16 else np.int32)  # 16 bits are sorted by radix
        order = np.argsort(h)
        order = order[np.argsort(of[order], kind="stable")]
        h, of = h[order], of[order]
        new = np.append(True, (h[1:] != h[:-1]) | (of[1:] != of[:-1]))
        yield h[new], of[new].astype(np.int64)


def sets_of(lines: list[str], k: int) -> Iterator[np.ndarray]:
    """The set of each line, as one sorted array."""
    for h, of in shingle_sets(lines, k):
        edges = [0, *np.cumsum(np.bincount(of)).tolist()]
        for a, b in zip(edges, edges[1:]):
            yield h[a:b]


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted sets."""
    both = np.concatenate((a, b))
    both.sort()
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return common / (len(a) + len(b) - common)


def eligible(line: str, least: int) -> bool:
    return len(line) >= least and len(line) - line.count(" ") - line.count("\t") - line.count("\r") >= least


def exploded(docs: DataFrame, id_col: str, text_col: str, least: int) -> DataFrame:
    """``(doc, line_no, line)`` for every line that may be removed."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = docs.select(id_of(id_col).alias("doc"), F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    return lines.where(F.ltrim("line", F.lit(" \t\r")) != "" if least <= 1 else F.length(F.translate("line", " \t\r", "")) >= least)


def key_of(line: Column) -> Column:
    """128 bits of SHA-256."""
    return F.substring(F.unhex(F.sha2(line, 256)), 1, 16)


def distinct_lines(docs: DataFrame, id_col: str, text_col: str, least: int) -> DataFrame:
    """``(lid, line, doc, line_no, n)``: each different line by its text, with a number of its own, its first occurrence and how many it has.

    The first occurrence travels as one number, which the hash aggregation can update in place: a long where ids
    have 32 bits beside their sign, else a decimal.
    """
    low, high = docs.agg(F.min(id_of(id_col)), F.max(id_of(id_col))).first()
    lines = exploded(docs, id_col, text_col, least)
    if low is None or -(1 << 32) <= low and high < 1 << 32:
        at = F.shiftleft("doc", 31).bitwiseOR(F.col("line_no").cast("long"))
        doc, line_no = F.shiftright("at", 31), F.col("at").bitwiseAND(F.lit((1 << 31) - 1))
    else:
        wide = "decimal(38,0)"
        unit = F.lit(1 << 31).cast(wide)
        at = (F.col("doc").cast(wide) * unit + F.col("line_no").cast(wide)).cast(wide)
        doc = F.floor(F.col("at") / unit).cast(wide)
        line_no = F.col("at") - doc * unit
    lines = lines.select("line", at.alias("at")).groupBy("line").agg(F.min("at").alias("at"), F.count("*").alias("n"))
    out = lines.select(F.monotonically_increasing_id().alias("lid"), "line", doc.cast("long").alias("doc"), line_no.cast("int").alias("line_no"), "n")
    return materialise(out, "distinct-lines", compression="snappy")


def filter_of(rows: DataFrame, key: str) -> tuple[DataFrame, str, int]:
    """What ``may_hit`` needs beside the rows; a filter that would be too large lets more pass."""
    buckets = max(1, min(FILTER, -(-rows.count() * BITS_PER_ROW // BITS)))
    return materialise(hit_filter(rows, key, buckets), "line-filter"), key, buckets


def bands_of(lines: DataFrame, places: Places, shingle: int) -> DataFrame:
    """Mail of band keys and line numbers, to the buckets of the band keys, about ``NEAR`` characters at a time.

    Within its bucket, 32 bits stand for a key: lines that they confuse meet in vain.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for batch in batches:
            every, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            keys = np.concatenate([band_keys(texts[lo:hi], shingle) for lo, hi in stretches(texts, NEAR)]).ravel()
            own = np.repeat(every, BANDS)
            mail = [*scatter((keys % np.uint64(places.n)).astype(np.int64), (short(keys), own), places, task)]
            dest, source, data = zip(*mail)
            yield pa.RecordBatch.from_arrays([pa.array(dest, pa.int32()), pa.array(source, pa.int32()), pa.array(data, pa.binary())], names=["dest", "source", "data"])
            del texts, keys, own, mail, data
            trim()

    return lines.select("lid", "line").mapInArrow(run, MAIL)


def meetings(places: Places) -> Callable[[int, pa.Table], Iterator[tuple]]:
    """``(band, leader, key)`` rows of the bands that several lines share; the leader is the least."""

    def run(bucket: int, table: pa.Table) -> Iterator[tuple]:
        band, key = columns_of(table)
        both = np.sort((band.astype(np.uint64) << np.uint64(32)) | np.arange(len(band), dtype=np.uint64))
        band, order = both >> np.uint64(32), (both & np.uint64(0xFFFFFFFF)).astype(np.int64)
        same = band[1:] == band[:-1]
        many = np.flatnonzero(np.append(False, same) | np.append(same, False))
        if len(many):
            band, key = band[many], key[order[many]]
            first = np.append(True, band[1:] != band[:-1])
            leader = np.minimum.reduceat(key, np.flatnonzero(first))[np.cumsum(first) - 1]
            yield from zip((band.astype(np.int64) * places.n + bucket).tolist(), leader.tolist(), key.tolist())

    return run


def candidates(lines: DataFrame, bands: DataFrame, shingle: int) -> DataFrame:
    """The lines that meet another or occur again: ``(lid, met, key, hash, first, n)`` and, for those that meet,
    ``(line, size, sketch)``: how many different shingles a line has, and how many of them in each of ``CELLS`` cells.

    A cell is one byte; the sketch of a line with more in a cell is null. The text of the other lines is not moved.
    """
    met = bands.select(F.col("key").alias("lid"))
    some = may_hit(lines, *filter_of(met.union(lines.where("n > 1").select("lid")), "lid"))
    some = some.join(met.distinct().withColumn("met", F.lit(True)), "lid", "left").where("met or n > 1").withColumn("met", F.col("met").isNotNull())
    some = some.select("lid", "met", key_of(F.col("line")).alias("key"), F.xxhash64("line").alias("hash"), "doc", "line_no", "n", F.when(F.col("met"), F.col("line")).alias("line"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            met = np.flatnonzero(batch.column(1).to_numpy(zero_copy_only=False))
            size, sketch = np.zeros(batch.num_rows, np.int32), np.full(batch.num_rows, None, object)
            done = 0
            for h, of in shingle_sets(batch.column(7).take(pa.array(met)).to_pylist(), shingle):
                n = int(of[-1]) + 1
                own = met[done : done + n]
                cells = np.bincount(of * CELLS + (h % np.uint64(CELLS)).astype(np.int64), minlength=n * CELLS).reshape(n, CELLS)
                size[own] = np.bincount(of)
                for k, row, most in zip(own.tolist(), cells.astype(np.uint8), cells.max(1).tolist()):
                    if most < 256:
                        sketch[k] = row.tobytes()
                done += n
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(size), pa.array(sketch, pa.binary())], names=[*batch.schema.names, "size", "sketch"])
            trim()

    schema = "lid long, met boolean, key binary, hash long, doc long, line_no int, n long, line string, size int, sketch binary"
    return materialise(some.mapInArrow(run, schema), "met-lines")


def plausible(pairs: DataFrame, lines: DataFrame, threshold: float) -> DataFrame:
    """The pairs ``(a, b)`` but for those that cannot reach the threshold: lines have no more in common than the lesser of their cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            most = np.minimum(batch.column(2).to_numpy(), batch.column(3).to_numpy()).astype(np.int64)
            known = np.flatnonzero(pc.and_(batch.column(4).is_valid(), batch.column(5).is_valid()).to_numpy(zero_copy_only=False))
            if len(known):
                x, y = (np.frombuffer(b"".join(batch.column(c).take(pa.array(known)).to_pylist()), np.uint8).reshape(-1, CELLS) for c in (4, 5))
                most[known] = np.minimum(x, y).sum(1)
            good = pa.array(most >= threshold * (n - most), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(good), batch.column(1).filter(good)], names=["a", "b"])

    of_a, of_b = (lines.select(F.col("lid").alias(x), F.col("size").alias(f"size_{x}"), F.col("sketch").alias(f"sketch_{x}")) for x in "ab")
    both = pairs.join(of_a, "a").join(of_b, "b").where(F.least("size_a", "size_b") >= F.greatest("size_a", "size_b") * threshold)
    return both.select("a", "b", "size_a", "size_b", "sketch_a", "sketch_b").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, lines: DataFrame, threshold: float, shingle: int) -> DataFrame:
    """The pairs ``(a, b)`` of lines whose shingle sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            good, lo = [], 0
            while lo < len(left):  # about STEP characters of different lines at a time
                names: dict[str, None] = {}
                size, hi = 0, lo
                while hi < len(left) and size < STEP:
                    for x in (left[hi], right[hi]):
                        if x not in names:
                            names[x] = None
                            size += len(x)
                    hi += 1
                sets = dict(zip(names, sets_of(list(names), shingle)))
                good += [jaccard(sets[x], sets[y]) >= threshold for x, y in zip(left[lo:hi], right[lo:hi])]
                lo = hi
            kept = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(kept), batch.column(1).filter(kept)], names=["a", "b"])
            del sets, names, left, right
            trim()

    left, right = (lines.select(F.col("lid").alias(x), F.col("line").alias(f"line_{x}")) for x in "ab")
    return plausible(pairs, lines, threshold).join(left, "a").join(right, "b").select("a", "b", "line_a", "line_b").mapInArrow(run, "a long, b long")


def met_bands(lines: DataFrame, n_lines: int, shingle: int) -> DataFrame:
    """``(band, leader, key)`` of the bands that several lines share.

    A line shorter than a shingle is similar to its copies only, and those are one line here.
    """
    places = Places.of(max(partitions(lines.sparkSession), -(-n_lines * BANDS // BUCKET)))
    mail = bands_of(lines.where(F.length("line") >= shingle), places, shingle)
    return materialise(exchange(delivered(mail, places), "dest", meetings(places), "band long, leader long, key long"), "bands")


def line_roots(lines: DataFrame, bands: DataFrame, threshold: float, shingle: int) -> DataFrame:
    """``(id, root)`` of the lines that are similar to another, directly or through others."""
    star = bands.where("leader < key").select(F.col("leader").alias("a"), F.col("key").alias("b")).distinct()
    edges = materialise(verified(star, lines, threshold, shingle), "star")
    roots = components(edges)
    # bands whose lines are in several components: compare across components
    rooted = bands.join(roots.withColumnRenamed("id", "key"), "key", "left").select("band", "leader", "key", F.coalesce("root", "key").alias("root"))
    mixed = rooted.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n")).where("lo <> hi and n > 2").select("band", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    rooted = rooted.where("key <> leader").join(mixed, "band").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    rooted = materialise(rooted.select("band", "key", "root", "blocks", "block"), "mixed-bands")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = rooted.select("band", F.col("key").alias("a"), F.col("root").alias("root_a"), F.col("block").alias("i"), other.alias("j"))
    right = rooted.select("band", F.col("key").alias("b"), F.col("root").alias("root_b"), F.col("block").alias("j"), other.alias("i"))
    across = left.join(right, ["band", "i", "j"]).where("a < b and root_a <> root_b").select("a", "b").distinct()
    more = materialise(verified(across, lines, threshold, shingle), "across")
    return roots if more.limit(1).isEmpty() else joined(roots, more)


def joined(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """``roots`` after further edges between lines: only components that these link are searched again."""
    for x in "ab":
        edges = edges.join(roots.select(F.col("id").alias(x), F.col("root").alias(f"root_{x}")), x, "left").withColumn(f"root_{x}", F.coalesce(f"root_{x}", x))
    edges = materialise(edges, "links")
    top = components(edges.select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))).select(F.col("id").alias("root"), F.col("root").alias("top"))
    ends = edges.select(F.col("a").alias("id"), F.col("root_a").alias("root")).union(edges.select("b", "root_b"))
    alone = ends.where("id = root").distinct().join(roots, "id", "left_anti")
    return materialise(roots.union(alone).join(top, "root", "left").select("id", F.coalesce("top", "root").alias("root")), "joined")


def removed_lines(docs: DataFrame, id_col: str, text_col: str, threshold: float, shingle: int, least: int) -> DataFrame:
    """``(doc, line_no)`` of the lines to remove."""
    lines = distinct_lines(docs, id_col, text_col, least)
    size = lines.agg(F.count("*"), F.sum("n")).first()
    bands = met_bands(lines, size[0], shingle)
    lines = candidates(lines, bands, shingle)
    roots = line_roots(lines.where("met"), bands, threshold, shingle)
    per_line = lines.select("lid", "key", "hash", F.struct("doc", "line_no").alias("first"), "n").join(roots.withColumnRenamed("id", "lid"), "lid", "left")
    per_line = per_line.where("n > 1 or root is not null")
    per_line = materialise(per_line.select("key", "hash", "first", "n", F.coalesce("root", "lid").alias("root")), "line-roots")
    keepers = per_line.groupBy("root").agg(F.min("first").alias("keeper"), F.sum("n").alias("all")).where("all > 1")
    decided = materialise(per_line.join(keepers, "root").where("n > 1 or first <> keeper").select("key", "hash", "n", "keeper"), "line-keepers")
    every = exploded(docs, id_col, text_col, least).withColumn("hash", F.xxhash64("line"))
    every = may_hit(every, *filter_of(decided.select("hash"), "hash")).select("doc", "line_no", key_of(F.col("line")).alias("key"))
    found = lookup(every, decided.drop("hash"), "key", "n", size[1] or 0)
    keeper = F.col("keeper")
    return found.where(keeper.isNotNull() & ((keeper["doc"] != F.col("doc")) | (keeper["line_no"] != F.col("line_no")))).select("doc", "line_no")


def with_lines_removed(docs: DataFrame, id_col: str, text_col: str, threshold: float, shingle: int, least: int) -> DataFrame:
    """``docs`` boxed, with ``_text`` and ``_gone``, the sorted numbers of the removed lines, null if none."""
    gone = removed_lines(docs, id_col, text_col, threshold, shingle, least).groupBy("doc").agg(F.array_sort(F.collect_set("line_no")).alias("_gone"))
    return boxed(docs, id_of(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).join(gone, F.col("_id") == F.col("doc"), "left")


def kept_lines() -> tuple[Column, Column]:
    """The text that is left, and how many lines there were."""
    lines = F.split("_text", "\n")
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("_gone", i)), "\n")
    return F.when(F.col("_gone").isNull(), F.col("_text")).otherwise(kept), F.size(lines)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, shingle: int = SHINGLE, least: int = MIN_CHARS) -> DataFrame:
    """One row per document: id, ``n_lines, n_removed, kept_sha256`` of the kept lines joined by newlines.

    Lines are what newlines separate. One line of each component of similar lines stays: the first by id and
    line number. Lines with fewer than ``least`` characters, blanks and tabs aside, always stay. Null counts as
    empty. Rows that repeat an id lose the same line numbers. ids are whole numbers; a null id is smaller than all
    others. No rows give no rows.
    """
    out = with_lines_removed(docs.select(F.col(id_col), F.col(text_col)), id_col, text_col, threshold, shingle, least)
    kept, n = kept_lines()
    return out.select(
        F.col("_row").getField(id_col).alias(id_col), n.cast("long").alias("n_lines"), F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_removed"), F.sha2(kept, 256).alias("kept_sha256")
    )


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_chars_col: str = "n_chars", threshold: float = THRESHOLD, shingle: int = SHINGLE, least: int = MIN_CHARS) -> DataFrame:
    """``docs`` with those lines cut out; documents of which nothing but white space is left are dropped. Same columns, of any names."""
    out = with_lines_removed(docs, id_col, text_col, threshold, shingle, least)
    kept, _ = kept_lines()
    changed = F.col("_gone").isNotNull()
    out = out.withColumn("_kept", kept).where(~changed | (F.trim(F.regexp_replace("_kept", r"\s+", "")) != ""))
    new = {text_col: F.when(changed, F.col("_kept")).otherwise(F.col("_row").getField(text_col))}
    if n_chars_col in docs.columns:
        new[n_chars_col] = F.when(changed, F.length("_kept").cast(docs.schema[n_chars_col].dataType)).otherwise(F.col("_row").getField(n_chars_col))
    return unboxed(out, docs.columns, new)
