"""Exact dedup by content-defined chunk recipes, in DataFrame operations only.

A text without its white space is cut where its bytes say so, not at fixed
places, so that texts that share passages share chunks.  A chunk's identifier is
its SHA-256, and a document's recipe the ordered list of its identifiers, computed
where the text is read.  Documents with a recipe of their own are told apart by
that.  Of those that share one, the chunks are deduplicated by content where they are
read, and an identifier is verified once the bytes of all chunks under it are seen to
be the same.  Whole texts are never moved: rows to verify are picked in the scan by a
filter of fixed size, and only their distinct chunks are shuffled.

Defined results: a null text is empty and all empty texts are one group; rows
that repeat a doc_id are rows of their own; of equal texts the row with the most
code points stays, then the smallest doc_id (null last), then the first row.  Two
chunks of different bytes with one SHA-256 end the job with an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linklens.llm import common as C

#: Bytes of a chunk: at least, at most; a cut comes after five bytes whose residues
#: modulo four are 0, 1, 2, 3, 0, which is about one place in a thousand.
LEAST, MOST, RESIDUES = 256, 8192, (0, 1, 2, 3, 0)
BLANKS = " \t\n\x0b\f\r"
#: Words of the filter of rows (2**18 of 64 bits, about 10 MB at most); parts in which a group's members are dealt.
FILTER_WORDS, PARTS = 1 << 18, 8


def cut_pattern(least: int = LEAST, most: int = MOST, residues: tuple[int, ...] = RESIDUES) -> str:
    sets = "".join("[" + "".join(f"\\x{b:02x}" for b in range(256) if b % 4 == r) + "]" for r in residues)
    n = len(residues)
    return f"(?s).{{{least - n},{most - n}}}?{sets}|.{{1,{most}}}"


def chunked(docs: DataFrame, rows: DataFrame | None = None, least: int = LEAST, most: int = MOST) -> DataFrame:
    """row, doc_id, n_points, norm, and the chunks of its bytes; an empty text is one empty chunk."""
    texts = C.placed_texts(docs)
    if rows is not None:
        word, bit = F.pmod(F.xxhash64("row"), F.lit(FILTER_WORDS)), F.pmod(F.xxhash64(F.lit(1), "row"), F.lit(64)).cast("int")
        bits = rows.select(word.alias("word"), F.call_function("shiftleft", F.expr("1L"), bit).alias("one")).groupBy("word").agg(F.bit_or("one").alias("bits"))
        # of fixed size; rows that pass in vain only add chunks that are verified as well
        texts = texts.withColumn("word", word).join(F.broadcast(bits), "word").where(F.getbit("bits", bit) == 1).select(*texts.columns)
    dense = F.col("text")
    for blank in BLANKS:
        dense = F.replace(dense, F.lit(blank), F.lit(""))
    norm = texts.select("row", "doc_id", F.char_length("text").cast("long").alias("n_points"), dense.alias("norm"))
    # one character for each byte: the pattern's sets are then byte sets
    by_byte = F.decode(F.encode("norm", "UTF-8"), "ISO-8859-1")
    found = F.regexp_extract_all(by_byte, F.lit(cut_pattern(least, most)), F.lit(0))
    return norm.withColumn("chunks", F.when(F.col("norm") == "", F.array(F.lit(""))).otherwise(found))


def recipes(docs: DataFrame, **cut) -> DataFrame:
    """row, doc_id, n_points, text_sha256, recipe: nothing is shuffled."""
    return chunked(docs, **cut).select("row", "doc_id", "n_points", F.sha2("norm", 256).alias("text_sha256"),
                                       F.transform("chunks", lambda c: F.unhex(F.sha2(c, 256))).alias("recipe"))


def chunk_contents(docs: DataFrame, rows: DataFrame, **cut) -> DataFrame:
    """id, contents: identifiers of the chunks of the given rows, with the number of different contents under each."""
    # an inner explode would have the chunks made a second time, to see whether there are any
    chosen = chunked(docs, rows, **cut).select(F.explode_outer("chunks").alias("chunk")).where("chunk is not null")
    return chosen.distinct().groupBy(F.unhex(F.sha2("chunk", 256)).alias("id")).agg(F.count("*").alias("contents"))


def verify(docs: DataFrame, shared: DataFrame, rows: DataFrame, **cut) -> None:
    """Raise an error unless the bytes under every identifier of the shared recipes are the same."""
    ids = shared.select(F.explode_outer("recipe").alias("id")).distinct()
    wrong = ids.join(chunk_contents(docs, rows, **cut), "id", "left").where("contents is null or contents > 1")
    if not wrong.isEmpty():
        raise RuntimeError("chunks of different bytes share a SHA-256")


def exact_groups(docs: DataFrame, **cut) -> DataFrame:
    """One row per input row: row, doc_id, keep_id, group_size, kept, text_sha256, n_points.

    Groups are summed before they are shuffled.  They are joined back by recipe and one
    of PARTS parts of the rows, each of which has the group's row, so that the members of
    a large group don't meet in one task.
    """
    docs = C.on_disk(docs)
    rows = C.stored(recipes(docs, **cut), "recipes")
    rank = F.struct((-F.col("n_points")).alias("n"), F.col("doc_id").isNull().alias("no"), "doc_id", "row")
    groups = rows.groupBy("recipe").agg(F.min(rank).alias("best"), F.count("*").alias("group_size"))
    shared = C.stored(groups.where("group_size > 1"), "shared")
    dealt = shared.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    joined = rows.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(PARTS)).cast("int")).join(dealt, ["recipe", "part"], "left")
    joined = C.stored(joined.drop("recipe", "part"), "members")
    alone = F.col("best").isNull()
    verify(docs, shared, joined.where(~alone).select("row"), **cut)
    return joined.select("row", "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
                         F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
                         (alone | (F.col("row") == F.col("best.row"))).alias("kept"), "text_sha256", "n_points")


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that stay, with all their columns."""
    docs = C.on_disk(docs)
    return C.keep_rows(docs, exact_groups(docs).where("kept"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(C.table(spark, sf_dir, "documents")).drop("row")


SQL = r"""
with n as (select doc_id, length(coalesce(text, '')) as n_points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as norm from documents)
select doc_id, first_value(doc_id) over w as keep_id, count(*) over (partition by norm) as group_size, doc_id = first_value(doc_id) over w as kept,
 sha256(norm) as text_sha256, n_points
from n window w as (partition by norm order by n_points desc, doc_id)
"""

QUERIES = {"op6_exact_dedup": op6_exact_dedup}
ORACLES = {"op6_exact_dedup": SQL}
