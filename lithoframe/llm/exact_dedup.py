"""Exact dedup by content-defined chunk recipes, in DataFrame operations only.

A text is cut where its content says so: a chunk runs for at least
``min_chars``, ends with the next sentence or line end and has at most
``max_chars``. Each chunk's text is aggregated once, which shows that its key
(length and two 64-bit hashes) stands for one text only; a key that stands for
more gets one identifier for each text. A document is then the ordered list of
its chunks' identifiers, and equal lists are equal texts. Chunk texts cross the
network once and pre-aggregated; after that only the lists move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lithoframe.llm.common import keyed_text, salt_of

KEY = ["n", "a", "b"]


def chunks_of(text: Column, min_chars: int = 512, max_chars: int = 4096) -> Column:
    """The chunks of a text, in order; joined they give the text. An empty text has none."""
    pattern = rf"(?s).{{{min_chars},{max_chars - 1}}}?[.!?\n]|.{{1,{max_chars}}}"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def chunk_key(chunk: Column, hash_bits: int = 64) -> Column:
    """Length and two independent hashes. Fewer ``hash_bits`` make keys collide, which tests use."""
    cut = (lambda h: F.shiftrightunsigned(h, 64 - hash_bits)) if hash_bits < 64 else (lambda h: h)
    length = F.octet_length(chunk) if hash_bits == 64 else F.lit(0)
    return F.struct(length.alias("n"), cut(F.xxhash64(chunk)).alias("a"), cut(F.xxhash64(F.lit(1), chunk)).alias("b"))


def chunk_dictionary(docs: DataFrame, hash_bits: int = 64, **sizes: int) -> DataFrame:
    """Each distinct chunk text with its key and how often it occurs."""
    chunks = docs.select(F.explode(chunks_of(F.col("text"), **sizes)).alias("chunk"))
    return chunks.select(chunk_key(F.col("chunk"), hash_bits).alias("k"), "chunk").select("k.*", "chunk").groupBy(*KEY, "chunk").agg(F.count("*").alias("uses"))


def collided_keys(dictionary: DataFrame) -> DataFrame:
    """Keys that stand for more than one text."""
    return dictionary.groupBy(*KEY).agg(F.count("*").alias("texts")).filter("texts > 1").select(*KEY)


def recipes(docs: DataFrame, hash_bits: int = 64, **sizes: int) -> DataFrame:
    """``recipe`` (ordered list of verified chunk identifiers) and ``text_sha256`` of each row, with its columns but the text."""
    own = [c for c in docs.columns if c != "text"]
    dictionary = chunk_dictionary(docs, hash_bits, **sizes)
    collided = collided_keys(dictionary)
    digest = F.sha2(F.col("text"), 256).alias("text_sha256")
    chunks = chunks_of(F.col("text"), **sizes)
    if collided.isEmpty():
        return docs.select(*own, F.transform(chunks, lambda c: chunk_key(c, hash_bits)).alias("recipe"), digest)
    number = F.row_number().over(Window.partitionBy(*KEY).orderBy("chunk"))
    numbered = dictionary.join(collided, KEY, "left_semi").select(*KEY, "chunk", number.alias("number"))
    texts = docs.select(digest, "text").dropDuplicates(["text_sha256"])
    placed = texts.select("text_sha256", F.posexplode(chunks).alias("pos", "chunk")).select("text_sha256", "pos", "chunk", chunk_key(F.col("chunk"), hash_bits).alias("k")).select("text_sha256", "pos", "chunk", "k.*")
    lists = (
        placed.join(numbered, [*KEY, "chunk"], "left")
        .groupBy("text_sha256")
        .agg(F.sort_array(F.collect_list(F.struct("pos", *KEY, F.coalesce("number", F.lit(0)).alias("number")))).alias("list"))
        .select("text_sha256", F.transform("list", lambda x: x.dropFields("pos")).alias("recipe"))
    )
    return docs.select(*own, digest).join(lists, "text_sha256", "left")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 64, hash_bits: int = 64, row_col: str | None = None, **sizes: int) -> DataFrame:
    """One row per document: ``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when identical, with no normalisation; of equal texts the
    row with the largest id stays. A null text counts as empty, and all empty
    texts are one group. Ids are taken to be unique; rows that repeat an id
    each count and each are returned; a NULL id ranks below all others. Further columns of ``df`` play no part.
    An empty table gives an empty result. With ``row_col``, a number of its own
    for each row, the result has it as ``row``, and of rows that tie in text and
    id only that of the largest number is ``kept``.

    A group may hold any share of the rows: its members are counted with
    map-side aggregation and meet their group's row under a salted key.
    ``min_chars`` and ``max_chars`` bound a chunk.
    """
    made = recipes(keyed_text(df, id_col, text_col, row_col), hash_bits, **sizes)
    own = ["doc_id", *(["row"] if row_col else [])]
    made = made.withColumn("recipe", F.coalesce("recipe", F.expr("array()").cast(made.schema["recipe"].dataType)))
    groups = made.groupBy("recipe").agg(F.max(F.struct(*own)).alias("keep"), F.count("*").alias("group_size")).filter("group_size > 1")
    groups = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    # Merged, not broadcast: the estimate of the groups is that before their salts.
    joined = made.withColumn("salt", salt_of(own[-1], salts)).join(groups.hint("merge"), ["recipe", "salt"], "left")
    keep = F.coalesce("keep", F.struct(*own))
    kept = keep["doc_id"].eqNullSafe(F.col("doc_id")) & (keep["row"] == F.col("row") if row_col else F.lit(True))
    return joined.select("doc_id", keep["doc_id"].alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), kept.alias("kept"), "text_sha256", *own[1:])
