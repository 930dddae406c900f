"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint of b bits is cut into segments so few that two fingerprints within the radius have a segment that differs
in one bit at most (radius // segments <= 1). Each segment is indexed once for each of its bits, with that bit wiped.
Two fingerprints within the radius share such a variant, so an equality join finds every pair, and the exact Hamming
distance in the join's condition keeps the true ones. A pair shares many variants; only one of them may report it.

Of m fingerprints that are all near one another about m links are rows: the fingerprints that share a whole segment first
meet the smallest of them, and what these stars join is one component. The join on variants then reports only links
between different components, so none that joins anything is missed.

Spark sizes a table by its files, also after an explode makes 64 rows of one, and would broadcast what does not fit the
driver. So joins over tables that grow with the documents are asked to sort and merge.

Null, empty and blank texts have no words and get fingerprint 0, linked like any other. Repeated rows fall in the same
class, and ties do not matter: a component's name is its smallest doc_id. Texts of any length are read whole, in blocks of
hashes. Extra columns of the input are ignored. Empty input gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metaloom.llm.shared import SLICE, components, cut, majority_bits, shingle_hashes, signed, words_of, workspace

WIDTH, RADIUS = 4, 4
#: (column, first bit, bits) of the segments: three, so that of four differing bits one segment has one at most.
SEGMENTS = (("fp", 0, 21), ("fp", 21, 21), ("fp", 42, 22))


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, fp): the 64-bit SimHash of each whole text over its word shingles, as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE):
                part = batch.slice(i, SLICE)
                fps = [signed(majority_bits(shingle_hashes(words_of(t), width))) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def variants(prints: DataFrame, segments: tuple[tuple[str, int, int], ...] = SEGMENTS) -> DataFrame:
    """prints with a row per wiped bit; key holds the bit's number over all segments and what is left of its segment (of
    32 bits at most)."""
    each, no = [], 0
    for column, first, bits in segments:
        for bit in range(bits):
            mask = signed((((1 << bits) - 1) << first) & ~(1 << (first + bit)))
            each.append(f"{no << 32}L | shiftrightunsigned({column} & {mask}L, {first})")
            no += 1
    return prints.withColumn("key", F.explode(F.expr(f"array({', '.join(each)})")))


def segment_keys(prints: DataFrame, segments: tuple[tuple[str, int, int], ...] = SEGMENTS) -> DataFrame:
    """prints with a row per segment; key holds its number and its bits."""
    each = [f"{no << 32}L | shiftrightunsigned({column} & {signed(((1 << bits) - 1) << first)}L, {first})" for no, (column, first, bits) in enumerate(segments)]
    return prints.withColumn("key", F.explode(F.expr(f"array({', '.join(each)})")))


def link_condition(a: Column, b: Column, key: Column, radius: int) -> Column:
    """True on one shared variant of each pair within the radius: in the first segment with one differing bit at most,
    at that bit, or at the segment's first bit if nothing differs there."""
    x = a.bitwiseXOR(b)
    no = F.shiftright(key, 32).cast("int")
    differ = [F.bit_count(x.bitwiseAND(F.lit(signed(((1 << n) - 1) << o)))) for _, o, n in SEGMENTS]
    here = F.lit(False)
    for s, (_, o, n) in enumerate(SEGMENTS):
        bit_set = F.getbit(x, no) == 1
        mine = (no >= o) & (no < o + n) & (((differ[s] == 1) & bit_set) | ((differ[s] == 0) & (no == o)))
        for earlier in differ[:s]:
            mine = mine & (earlier >= 2)
        here = here | mine
    return (F.bit_count(x) <= radius) & here


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(u, v): pairs of different fingerprints (fp) that differ in radius bits at most, enough of them to join all that
    such pairs join. Raises where the segments cannot guarantee the radius."""
    if radius // len(SEGMENTS) > 1:
        raise ValueError("the segments guarantee a radius of 5 at most")
    prints = prints.select("fp")
    near = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= radius
    whole = segment_keys(prints)
    heads = whole.groupBy("key").agg(F.min("fp").alias("head"))
    star = whole.join(heads.hint("merge"), (whole["key"] == heads["key"]) & (F.col("head") < F.col("fp")) & near("head", "fp"))
    star = cut(star.select(F.col("head").alias("u"), F.col("fp").alias("v")).distinct(), "star")
    comp = components(star).select(F.col("node").alias("fp"), F.col("component").alias("c"))
    rows = variants(cut(prints.join(comp.hint("merge"), "fp", "left").select("fp", "c"), "known"))
    a = rows.select(F.col("key").alias("ka"), F.col("fp").alias("u"), F.col("c").alias("ca"))
    b = rows.select(F.col("key").alias("kb"), F.col("fp").alias("v"), F.col("c").alias("cb"))
    apart = F.col("ca").isNull() | F.col("cb").isNull() | (F.col("ca") != F.col("cb"))
    across = a.join(b.hint("merge"), (F.col("ka") == F.col("kb")) & (F.col("u") < F.col("v")) & apart & link_condition(F.col("u"), F.col("v"), F.col("ka"), radius))
    return star.union(across.select("u", "v"))


def simhash_components(docs: DataFrame, width: int = WIDTH, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id): a row per document; component_id is the smallest doc_id that links reach.

    Equal fingerprints are one class before anything is paired; a class of any size costs one representative.
    """
    with workspace(docs.sparkSession):
        return cut(_fingerprint_components(docs, width, radius), "components", stays=True)


def _fingerprint_components(docs: DataFrame, width: int, radius: int) -> DataFrame:
    fps = cut(fingerprints(docs, width), "fps")
    classes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    comp = components(links(classes, radius))
    known = cut(classes.join(comp.hint("merge"), classes["fp"] == comp["node"], "left").select("fp", "rep", F.coalesce("component", "fp").alias("c")), "known")
    first = known.groupBy("c").agg(F.min("rep").alias("component_id"))
    home = known.join(first.hint("merge"), "c").select("fp", "component_id")
    return fps.join(home.hint("merge"), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
