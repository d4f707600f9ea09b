"""Exact dedup over content-defined chunk recipes, in DataFrame operations only.

Each text is cut where its own content says so, so equal passages give equal chunks wherever
they stand. Every distinct chunk gets an identifier: its 64-bit hash, which is *verified*, that
is, compared byte for byte over all chunks with that hash; if different chunks share a hash
they get a running number as well. A text's recipe is the ordered list of identifiers, and two
texts are equal exactly if their recipes are. Chunk text moves once, after map-side dedup;
documents themselves never move, only recipes of 8 bytes a chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import free_name, materialised, small_side

#: Java pattern of a run of ASCII white space.
SPACE_RUN = r"[\x20\x09-\x0D]+"
#: Cut after two code points that both have residue 3 modulo 4, between 256 and 8192 code points.
LEAST, MOST = 256, 8192


def cut_class(residue: int = 3, modulus: int = 4) -> str:
    """A Java character class of the Latin-1 code points (space excluded) with that residue.

    Text without such code points is cut every MOST code points: recipes stay exact, only shared
    chunks are found less often.
    """
    return "[" + "".join(f"\\u{c:04x}" for c in range(0x21, 0x100) if c % modulus == residue) + "]"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_RUN, " ")


def chunks(text: Column, least: int = LEAST, most: int = MOST) -> Column:
    """The text in content-defined pieces; joined, they are the text again. An empty text has none."""
    c = cut_class()
    return F.regexp_extract_all(text, F.lit(f"(?s).{{{least},{most}}}?(?:(?<={c}{c})|\\z)|.{{1,{most}}}"), F.lit(0))


def chunk_hash(chunk: Column, bits: int = 64) -> Column:
    h = F.xxhash64(chunk)
    return h if bits == 64 else h.bitwiseAND(F.lit((1 << bits) - 1))


def recipes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", hash_bits: int = 64) -> DataFrame:
    """(doc_id, text_sha256, recipe) for every row; recipes are equal exactly if normalised texts are.

    ``hash_bits`` below 64 makes hashes collide, for tests of the verification.
    """
    pieces = docs.select(F.col(doc_id).alias("doc_id"), normalised(F.col(text)).alias("text")).select(
        "doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), chunks(F.col("text")).alias("pieces")
    )
    store = pieces.select(F.explode("pieces").alias("chunk")).select(chunk_hash(F.col("chunk"), hash_bits).alias("h"), "chunk").distinct()
    clashes = materialised(store.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "clashes")
    listed = pieces.select("doc_id", "text_sha256", F.transform("pieces", lambda c: chunk_hash(c, hash_bits)).alias("hashes"), "pieces")
    if clashes.isEmpty():
        return listed.select("doc_id", "text_sha256", F.transform("hashes", lambda h: F.struct(h.alias("h"), F.lit(0).alias("no"))).alias("recipe"))
    # different chunks share a hash: number those chunks alone, and put the numbers into the recipes that hold
    # them; only texts with such a chunk are cut again, and no text meets its chunks in a join
    numbered = store.join(clashes, "h", "left_semi").select("h", "chunk", F.row_number().over(Window.partitionBy("h").orderBy("chunk")).alias("no"))
    places = listed.select("text_sha256", F.explode("hashes").alias("h")).join(clashes, "h", "left_semi")
    touched = materialised(places.select("text_sha256").distinct(), "touched")
    again = pieces.select("text_sha256", "pieces").join(touched, "text_sha256", "left_semi").dropDuplicates(["text_sha256"])
    parts = again.select("text_sha256", F.posexplode("pieces").alias("pos", "chunk")).withColumn("h", chunk_hash(F.col("chunk"), hash_bits)).join(numbered, ["h", "chunk"])
    marks = materialised(parts.groupBy("text_sha256").agg(F.map_from_entries(F.collect_list(F.struct("pos", "no"))).alias("marks")), "marks")
    met = listed.select("doc_id", "text_sha256", "hashes").join(marks, "text_sha256", "left")
    part = lambda h, i: F.struct(h.alias("h"), F.coalesce(F.try_element_at("marks", i), F.lit(0)).alias("no"))
    return met.select("doc_id", "text_sha256", F.transform("hashes", part).alias("recipe"))


def exact_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", hash_bits: int = 64) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are identical after each run of ASCII white space is replaced by one
    space; a null text counts as empty. Of equal texts the row with the least id stays. Rows that
    repeat that id are numbered and only one of them is kept. Null ids are never kept over other
    ids; a group of null ids only keeps one row and has a null keep_id. Other columns are ignored.
    """
    same = decisions(docs, text, doc_id, hash_bits)
    each = same.select("*", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return each.select(F.col("doc_id").alias(doc_id), "keep_id", "group_size", (F.col("least") & (F.col("copy") == 1)).alias("kept"), "text_sha256")


def decisions(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", hash_bits: int = 64) -> DataFrame:
    """(doc_id, text_sha256, keep_id, group_size, least, copies), one row per id and text."""
    rows = materialised(recipes(docs, text, doc_id, hash_bits), "recipes")
    shared = rows.groupBy("recipe").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    # stored, so that both sides of the join are dealt for the join alone and a large group can be split
    groups = materialised(shared.withColumn("shared", F.lit(True)), "groups")
    keep = F.when(F.col("shared"), F.col("first")).otherwise(F.col("doc_id"))
    joined = rows.join(groups, "recipe", "left").select(
        "doc_id", keep.alias("keep_id"), F.coalesce("n", F.lit(1)).alias("group_size"), "text_sha256", F.col("doc_id").eqNullSafe(keep).alias("least")
    )
    return joined.groupBy("doc_id", "text_sha256", "keep_id", "group_size", "least").agg(F.count("*").alias("copies"))


def deduplicated(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    What goes is the smaller side of the join, an anti-join; texts don't move while it is small and move
    once beyond.
    """
    found = materialised(decisions(docs, text, doc_id), "decisions")
    sha, gone_id, gone_sha = (free_name(docs, n) for n in ("_sha", "_gone_id", "_gone_sha"))
    gone = small_side(found.where("NOT least").select(F.col("doc_id").alias(gone_id), F.col("text_sha256").alias(gone_sha)))
    marked = docs.withColumn(sha, F.sha2(normalised(F.col(text)).cast("binary"), 256))
    stay = marked.join(gone, F.col(doc_id).eqNullSafe(F.col(gone_id)) & (F.col(sha) == F.col(gone_sha)), "left_anti")
    if not found.where("least AND copies > 1").isEmpty():  # one id twice with one text
        stay = stay.dropDuplicates([doc_id, sha])
    return stay.drop(sha)
