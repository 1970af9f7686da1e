"""Benchmark decontamination [native].

Finds short test items inside long documents: an item is contained in a document if
at least 80 % of its distinct five-word shingles occur there.

Items are partitioned by the size of their shingle set (doubling classes). Within a
partition every item has a bottom-k MinHash sketch, the k smallest of its shingle
hashes under one hash function, with ``k = misses + 1`` for the partition, where
``misses`` is the number of shingles that an item of the partition's largest size may
lack at the threshold. A document that contains the item holds at least one sketched
hash (it can lack at most ``misses``), so the candidate search loses nothing.
Candidates are verified by counting the exact shingles that document and item share.

Documents are never shuffled or gathered: their shingle hashes meet the sketches map-
side while the sketches are below a counted bound (a shuffled hash join beyond it),
and only (document, item) candidates move. Verification reads the shingles of
candidate documents only.

Defined results: null or wordless texts and items have no shingles and no links; a
text or item of one to four words has its whole sequence as its only shingle; where items
of so few words occur, every document also has its runs of as many words, so that such
items are found inside long documents; rows of one id are one document (its shingles are
the union over its rows); null ids get no link, but ``decontaminate`` keeps their rows if
they contain nothing; texts of any length are searched whole; empty tables give empty
results; equal items each get their links; other columns may have any names. Only A-Z is
lower-cased.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .support import fresh, materialise, small, table

THRESHOLD_PERCENT = 80
SHINGLE_WORDS = 5
#: Sketch rows up to which the candidate search may broadcast them.
SKETCH_ROWS = 500_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Lower-cased (A-Z) words; empty for null."""
    trimmed = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    return F.when(F.length(trimmed) == 0, F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def _shingles(words: Column, each) -> Column:
    last = F.greatest(F.size(words) - SHINGLE_WORDS + 1, F.least(F.size(words), F.lit(1)))
    return F.when(last > 0, F.transform(F.sequence(F.lit(1), last), each)).otherwise(F.array())


def shingle_texts(words: Column) -> Column:
    return _shingles(words, lambda i: F.array_join(F.slice(words, i, SHINGLE_WORDS), " "))


def document_shingles(words: Column, sizes: list[int]) -> Column:
    """A document's shingles, and its runs of as many words as ``sizes`` (below five) say."""

    def runs(k: int) -> Column:
        starts = F.sequence(F.lit(1), F.size(words) - (k - 1))
        return F.when(F.size(words) >= k, F.transform(starts, lambda i: F.array_join(F.slice(words, i, k), " "))).otherwise(F.array().cast("array<string>"))

    return F.concat(shingle_texts(words).cast("array<string>"), *[runs(k) for k in sizes])


def item_table(items: DataFrame, item_id: str, text_col: str, percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """One row per distinct (item, shingle): shingle, hash, set size, size class, position in the bottom-k order and k."""
    sets = items.select(F.col(item_id).alias("item_id"), F.explode(shingle_texts(words_of(F.col(text_col)))).alias("shingle")).where(F.col("item_id").isNotNull()).distinct()
    sets = sets.groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct(F.xxhash64("shingle").alias("hash"), "shingle"))).alias("set")).withColumn("n_shingles", F.size("set").cast("long"))
    #: Doubling size classes: 1, 2-3, 4-7, ...; k fits the largest size of the class.
    sets = sets.withColumn("size_class", F.floor(F.log2("n_shingles")).cast("int"))
    largest = F.pow(F.lit(2.0), F.col("size_class") + 1).cast("long") - 1
    sets = sets.withColumn("k", (largest - F.ceil(largest * percent / 100) + 1).cast("long"))
    return sets.select("item_id", "n_shingles", "size_class", "k", F.posexplode("set").alias("at", "s")).select("item_id", "n_shingles", "size_class", "k", "at", "s.hash", "s.shingle")


def contained_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """Links (``doc_id``, ``item_id``, ``n_common``, ``n_shingles``, ``containment``) at or above the threshold."""
    item_sets = materialise(item_table(items, item_id, item_text, percent), "decontamination-items")
    about = item_sets.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("at") < F.col("k")).alias("sketched"), F.coalesce(F.sum(F.octet_length("shingle")), F.lit(0)).alias("bytes"))
    about = about.collect()[0]
    n_words = F.size(words_of(F.col(item_text)))
    sizes = [r[0] for r in items.where(n_words.between(1, SHINGLE_WORDS - 1)).select(n_words.alias("n")).distinct().collect()]
    sketches = item_sets.where(F.col("at") < F.col("k")).select("hash", "item_id")
    texts = docs.select(F.col(id_col).alias("doc_id"), words_of(F.col(text_col)).alias("words")).where(F.col("doc_id").isNotNull())
    shingles = lambda rows: rows.select("doc_id", F.explode(document_shingles(F.col("words"), sorted(sizes))).alias("shingle"))
    hashed = shingles(texts).select("doc_id", F.xxhash64("shingle").alias("hash"))
    met = hashed.join(small(sketches, about["sketched"], SKETCH_ROWS), "hash").select("doc_id", "item_id").distinct()
    candidates = materialise(met, "decontamination-candidates")
    spelled = shingles(texts.join(small(candidates.select("doc_id").distinct(), candidates.count()), "doc_id", "left_semi"))
    wanted = item_sets.select("shingle", "item_id", "n_shingles")
    shared = spelled.join(small(wanted, about["n"] + about["bytes"] // 64, SKETCH_ROWS), "shingle").distinct()
    counts = shared.groupBy("doc_id", "item_id", "n_shingles").agg(F.count(F.lit(1)).alias("n_common"))
    links = counts.where(F.col("n_common") * 100 >= F.col("n_shingles") * percent).join(candidates, ["doc_id", "item_id"], "left_semi")
    return links.select("doc_id", "item_id", "n_common", "n_shingles", (F.col("n_common") / F.col("n_shingles")).alias("containment"))


def decontaminate(docs: DataFrame, items: DataFrame, **columns: str) -> DataFrame:
    """The rows of ``docs`` whose documents contain no item, with the columns of ``docs``.

    A row with a null id is looked up by the hash of its text.
    """
    id_col, text_col = columns.get("id_col", "doc_id"), columns.get("text_col", "text")
    name = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("text:"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)))
    (key,) = fresh(docs, "decontamination_name")
    keyed = docs.withColumn(key, name)
    links = contained_items(keyed, items, **(columns | {"id_col": key}))
    leaked = materialise(links.select(F.col("doc_id").alias(key)).distinct(), "decontamination-leaked")
    return keyed.join(small(leaked, leaked.count()), key, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op6_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contained_items(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


_SQL_WORDS = r"""
SELECT {id} AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM {table}
"""
_SQL_SHINGLES = r"""
SELECT DISTINCT id, array_to_string(list_slice(w, i, i + 4), ' ') AS shingle
FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS i FROM {words})
"""
OP6_SQL = f"""
WITH dw AS ({_SQL_WORDS.format(id="doc_id", table="documents")}), bw AS ({_SQL_WORDS.format(id="item_id", table="benchmark")}),
k AS (SELECT DISTINCT len(w) AS k FROM bw WHERE len(w) BETWEEN 1 AND 4),
d AS (SELECT id, shingle FROM ({_SQL_SHINGLES.format(words="dw")})
      UNION SELECT id, array_to_string(list_slice(w, i, i + k - 1), ' ') FROM (SELECT id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw JOIN k ON len(w) >= k)),
b AS ({_SQL_SHINGLES.format(words="bw")}),
n AS (SELECT id, count(*) AS n_shingles FROM b GROUP BY id)
SELECT d.id AS doc_id, b.id AS item_id, count(*) AS n_common, n.n_shingles, CAST(count(*) AS DOUBLE) / CAST(n.n_shingles AS DOUBLE) AS containment
FROM d JOIN b ON d.shingle = b.shingle JOIN n ON n.id = b.id
GROUP BY d.id, b.id, n.n_shingles HAVING count(*) * 100 >= n.n_shingles * 80
"""
