"""Fill-in-middle transformation: overlapping chunks, counted side by side.

A text is a row of tokens, each a run of ASCII letters or one other code point.
A token starts where an adjacent pair of characters says so: the second is no
letter, or the first is none.  So no state runs along the text, and

1. its bytes are cut into chunks of ``CHUNK``, each with the byte before it, and
   the starts in every chunk are counted on their own (continuation bytes of
   UTF-8 start nothing);
2. prefix sums of these counts tell in which chunk each of the two cut ranks lies;
3. only these chunks are scanned again, for the byte at which the token starts.

All of it is built-in functions over one row: nothing is shuffled or sent to
Python, slices of bytes cost their own length, and a text of any length takes
time in proportion to it.

Defined results: a null text is an empty one; a null key is drawn for like an
empty string; repeated rows come out as often as they come, all alike; an empty
table gives an empty result; other columns are unread, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of a chunk.
CHUNK = 2048
#: Fixed values of the contract: what stands before each part.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

#: Over bytes read as Latin-1: what continues a token (never the first byte, which belongs to the chunk before), and whole tokens.
_INSIDE = r"(?<=[A-Za-z])[A-Za-z]+|(?<!^)[\x80-\xBF]+"
_TOKEN = r"[A-Za-z]+|[\x80-\xBF]+|[^A-Za-z][\x80-\xBF]*"


def draws(key: Column) -> list[Column]:
    """The first four 8-digit groups of the hex SHA-256 of ``1:key``, as numbers."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def _chunk(padded: Column, i: Column) -> Column:
    """Chunk i and the byte before it, a character for each byte; ``padded`` is the text's bytes behind one byte that is no letter."""
    return F.decode(F.substring(padded, i * CHUNK + 1, F.lit(CHUNK + 1)), "ISO-8859-1")


def chunk_starts(padded: Column) -> Column:
    """For each chunk, how many tokens start in it."""
    chunks = F.ceil((F.length(padded) - 1) / CHUNK).cast("int")
    count = lambda i: (F.length(F.regexp_replace(_chunk(padded, i), _INSIDE, "")) - 1).cast("long")
    return F.when(chunks > 0, F.transform(F.sequence(F.lit(0), chunks - 1), count)).otherwise(F.array().cast("array<bigint>"))


def owners(starts: Column, ranks: dict[str, Column]) -> Column:
    """A struct with, for each rank, the chunk in which the token of that rank starts and the tokens that start before the chunk.

    Both are null for a rank at the end of the text.
    """
    at = lambda s, name: [s[f"{name}_chunk"], s[f"{name}_before"]]
    state = F.struct(
        F.lit(0).alias("i"), F.lit(0).cast("bigint").alias("sum"),
        *[F.lit(None).cast(kind).alias(f"{name}_{what}") for name in ranks for what, kind in (("chunk", "int"), ("before", "bigint"))],
    )

    def step(s: Column, n: Column) -> Column:
        fields = [(s["i"] + 1).alias("i"), (s["sum"] + n).alias("sum")]
        for name, rank in ranks.items():
            here = (rank >= s["sum"]) & (rank < s["sum"] + n)
            old = at(s, name)
            fields += [F.when(here, s["i"]).otherwise(old[0]).alias(f"{name}_chunk"), F.when(here, s["sum"]).otherwise(old[1]).alias(f"{name}_before")]
        return F.struct(*fields)

    return F.aggregate(starts, state, step)


def _byte(padded: Column, rank: Column, chunk: Column, before: Column) -> Column:
    """The bytes of the text before the token of this rank: its chunk's tokens up to it, and the byte in front, are read again."""
    tokens = F.regexp_extract_all(_chunk(padded, chunk), F.lit(_TOKEN), F.lit(0))
    inside = F.length(F.array_join(F.slice(tokens, F.lit(1), (rank - before + 1).cast("int")), "")) - 1
    return F.coalesce(chunk * CHUNK + inside, F.length(padded) - 1)


def cut_ranks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, text, tokens n, the two cut ranks a <= b, the draws h3 and h4, and the texts prefix, middle, suffix."""
    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    rows = rows.withColumn("bytes", F.concat(F.lit(b"\0"), F.col("t").cast("binary"))).withColumn("starts", chunk_starts(F.col("bytes")))
    rows = rows.withColumn("n", F.aggregate("starts", F.lit(0).cast("bigint"), lambda s, x: s + x)).withColumn("h", F.array(*draws(F.col("k"))))
    one, two = (F.get("h", F.lit(i)) % (F.col("n") + 1) for i in range(2))
    rows = rows.withColumn("a", F.least(one, two)).withColumn("b", F.greatest(one, two))
    rows = rows.withColumn("own", owners(F.col("starts"), {"a": F.col("a"), "b": F.col("b")}))
    place = {x: _byte(F.col("bytes"), F.col(x), F.col(f"own.{x}_chunk"), F.col(f"own.{x}_before")) for x in "ab"}
    rows = rows.withColumn("at", F.struct(place["a"].cast("int").alias("a"), place["b"].cast("int").alias("b")))
    part = lambda start, size: F.substring("bytes", start + 2, size).cast("string")
    return rows.select(
        F.col("k").alias(key), F.col("t").alias("text"), "n", F.col("a").alias("first_cut"), F.col("b").alias("second_cut"),
        F.get("h", F.lit(2)).alias("h3"), F.get("h", F.lit(3)).alias("h4"), part(F.lit(0), F.col("at.a")).alias("prefix"),
        part(F.col("at.a"), F.col("at.b") - F.col("at.a")).alias("middle"), part(F.col("at.b"), F.length("bytes")).alias("suffix"),
    )


def transform(docs: DataFrame, key: str = "doc_id", text: str = "text", rate: int = 90, spm: int = 20) -> DataFrame:
    """Per row: key, n, form (plain, psm or spm), prefix, middle, suffix (null if plain) and output.

    Of 100 texts ``rate`` are transformed, and of 100 of those ``spm`` with the suffix first.  A text that is empty or
    holds one of the marks stays plain, so that :func:`restore` is exact.
    """
    rows = cut_ranks(docs, key, text)
    marked = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    plain = (F.col("n") == 0) | marked | (F.col("h3") % 100 >= rate)
    rows = rows.withColumn("form", F.when(plain, "plain").when(F.col("h4") % 100 < spm, "spm").otherwise("psm"))
    one = {"prefix": (PREFIX, "prefix"), "suffix": (SUFFIX, "suffix")}
    joined = lambda *order: F.concat(*[x for name in order for x in (F.lit(one[name][0]), F.col(one[name][1]))], F.lit(MIDDLE), F.col("middle"))
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", joined("prefix", "suffix")).otherwise(joined("suffix", "prefix"))
    rest = [F.when(F.col("form") != "plain", F.col(x)).alias(x) for x in ("prefix", "middle", "suffix")]
    return rows.select(key, "n", "form", *rest, output.alias("output"))


def restore(form: Column, output: Column) -> Column:
    """The text behind an output.

    Each mark stands in it once: the parts hold none, and none arises where they meet, as a mark's first character is not inside it.
    """
    middle = F.substring_index(output, MIDDLE, -1)
    before = F.substring_index(output, MIDDLE, 1)
    between = lambda one, two: (F.substring_index(F.substring_index(before, two, 1), one, -1), F.substring_index(before, two, -1))
    prefix, suffix = between(PREFIX, SUFFIX)
    last, first = between(SUFFIX, PREFIX)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(first, middle, last)).otherwise(output)
