"""Document fingerprints by one-permutation MinHash, all in DataFrame functions."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS = 256  # a power of 2
SHINGLE = 5
BITS = 8
PROBES = 8
BUCKET_ROWS = 4096  # documents that are put in order together
MAX_BUCKETS = 1 << 16  # so the bounds, which every task holds, stay small; beyond, buckets grow and the sort spills


def _top(x: Column, bins: int) -> Column:
    """The bin of a hash: its highest bits."""
    return F.shiftrightunsigned(x, 64 - (bins.bit_length() - 1)).cast("int")


def add_print(df: DataFrame, text: str, name: str, bins: int = BINS, shingle: int = SHINGLE) -> DataFrame:
    """`df` with the array `name` of a low-order byte (less 128) for each bin of the whole text; empty for a text without a word.

    A shingle is `shingle` consecutive words between ASCII white space, or all words of a shorter text. Each is hashed once: the highest
    bits are its bin, the smallest hash of a bin represents it. An empty bin takes the value of the first filled bin in a
    random order of its own, which is the same in every document: optimal densification. The order is PROBES bins by hash
    and then all others by the hash of both bins, so a filled one is always found.
    """
    words = F.filter(F.split(F.col(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    out = df.withColumn("words_", F.transform(words, lambda w: F.xxhash64(w)))
    n = F.size("words_")
    each = F.transform(
        F.sequence(F.lit(0), n - shingle), lambda i: F.xxhash64(*(F.get("words_", i + j) for j in range(shingle)))
    )
    out = out.withColumn("hashes_", F.when(n >= shingle, each).when(n > 0, F.array(F.xxhash64("words_"))).otherwise(F.expr("cast(array() as array<bigint>)")))
    out = out.withColumn("hashes_", F.sort_array("hashes_"))
    least = F.filter("hashes_", lambda x, i: (i == 0) | (_top(x, bins) != _top(F.get("hashes_", i - 1), bins)))
    out = out.withColumn("least_", least).withColumn("bins_", F.transform("least_", lambda x: _top(x, bins)))
    every = F.sequence(F.lit(0), F.lit(bins - 1))
    by_bin = F.array(F.map_from_arrays("bins_", "least_"))  # made once: the optimizer would move a column into the inner function
    out = out.withColumn("filled_", F.get(F.transform(by_bin, lambda m: F.transform(every, lambda j: F.try_element_at(m, j))), 0))

    def dense(x: Column, j: Column) -> Column:
        tried = [F.get("filled_", F.pmod(F.xxhash64(j, F.lit(t)), F.lit(bins)).cast("int")) for t in range(PROBES)]
        rest = F.array_min(F.transform("least_", lambda y: F.struct(F.xxhash64(j, _top(y, bins)).alias("o"), y.alias("y"))))["y"]
        return F.coalesce(x, *tried, rest)

    low = F.transform("filled_", lambda x, j: (dense(x, j).bitwiseAND(F.lit((1 << BITS) - 1)) - 128).cast("tinyint"))
    none = F.expr("cast(array() as array<tinyint>)")
    return out.withColumn(name, F.when(F.size("least_") > 0, low).otherwise(none)).drop(
        "words_", "hashes_", "least_", "bins_", "filled_"
    )


def packed(print_: str | Column) -> Column:
    """The bytes of a fingerprint as lowercase hex digits; no digit for a text without a word."""
    return F.lower(F.array_join(F.transform(print_, lambda v: F.lpad(F.hex(v.cast("int") + 128), 2, "0")), ""))


def likeness(a: str, b: str) -> Column:
    """Estimated share of common shingles, 0 to 1, corrected for low-order bits that agree by chance; 1 or 0 if one is empty."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / F.size(a)
    chance = 1 / (1 << BITS)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), (F.size(a) == F.size(b)).cast("double")).otherwise(
        F.greatest(F.lit(0.0), (same - chance) / (1 - chance))
    )


def with_next(rows: DataFrame, columns: list[str], bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """`rows`, with an `id`, and the `columns` of the row with the next smaller id as next_*; the smallest id's next is the largest.

    Rows are shuffled once, to buckets between quantiles of the id, and ordered within each. A bucket's largest id is one of the
    quantiles, so its row knows by itself that it is the next of the bucket above, and goes there, too, as a guest at the end.
    Equal ids follow each other in the order of `columns`' hashes. A row without an id has no next and is nobody's.
    """
    n, most = rows.agg(F.count("id"), F.max("id")).first()
    if not n:
        return rows.select("*", *(F.lit(None).cast(rows.schema[c].dataType).alias(f"next_{c}") for c in columns))
    buckets = min(MAX_BUCKETS, -(-n // bucket_rows))
    shares = [i / buckets for i in range(1, buckets)]
    found = rows.agg(F.percentile_approx("id", F.array(*map(F.lit, shares)), F.lit(20 * buckets))).first()[0] if shares else []
    heads = sorted({*found, most})
    table = F.array(*map(F.lit, heads))
    steps = F.array(*(F.lit(1 << p) for p in reversed(range(len(heads).bit_length()))))
    below = F.aggregate(  # binary search: how many heads are smaller
        steps, F.lit(0), lambda at, step: F.when(
            (at + step <= len(heads)) & (F.get(table, at + step - 1) < F.col("id")), at + step
        ).otherwise(at)
    )
    salt = -1 - F.pmod(F.xxhash64(*columns), F.lit(1 << 16)).cast("int")
    own = rows.withColumn("bucket_", F.when(F.col("id").isNull(), salt).otherwise(below))
    guest = F.get(table, F.col("bucket_")) == F.col("id")
    both = own.withColumn("bucket_", F.explode(F.when(
        guest, F.array(F.struct(F.col("bucket_").alias("b"), F.lit(False).alias("g")), F.struct(((F.col("bucket_") + 1) % len(heads)).alias("b"), F.lit(True).alias("g")))
    ).otherwise(F.array(F.struct(F.col("bucket_").alias("b"), F.lit(False).alias("g"))))))
    order = Window.partitionBy("bucket_.b").orderBy("bucket_.g", F.desc("id"), F.xxhash64(*columns))
    return both.select(
        "*", *(F.when(F.col("id").isNotNull(), F.lead(c).over(order)).alias(f"next_{c}") for c in columns)
    ).filter(~F.col("bucket_.g")).drop("bucket_")


def fingerprint_edits(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for each row.

    The edited text has its last floor(n_chars / 2) characters replaced by the first as many, or all, of the next document by
    falling id. Null is the empty text, whose fingerprint is the empty string: it is like other empty ones only. A row
    with a null id has no next: its half is cut, and near_next is 0 or, for an empty text, 1. Equal ids follow one another, the
    only row is its own next, and an empty table gives no row. Other columns are not read.
    """
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    printed = with_next(add_print(rows, "text", "print"), ["text", "print"])
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 2) as int))"), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half))
    out = add_print(printed.withColumn("edited", edited), "edited", "edited_print")
    none = F.expr("cast(array() as array<tinyint>)")
    out = out.withColumn("next_print", F.coalesce("next_print", none))
    return out.select(
        F.col("id").alias(id_col), F.length("text").cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        packed("print").alias("fingerprint"), packed("edited_print").alias("edited_fingerprint"),
        likeness("print", "edited_print").alias("near_edited"), likeness("print", "next_print").alias("near_next"),
    )
