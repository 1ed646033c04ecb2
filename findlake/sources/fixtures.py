"""Test inputs built from the driver's tables.

``fixture_listing`` turns rows of ``part``, ``documents``, ``orders``,
``events`` and ``pages`` into a file listing (``ordinal, path, is_dir``), so
the catalog grows with the tables. The other helpers derive change sets and
query batches from a catalog. All of it is plain DataFrame code: every table is
read with column pruning and no row ever passes through the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from findlake.session import staged

# --- fixed values of the fixture (query batch of the bench) -----------------
QUERY_BATCH = [
    "blue", "blue_anvil.txt", "doc", "doc1.txt", "Anvil  BOLT", "order_1", "en_documents",
    ".txt", "825", "small_ring-", "json error", "zz", "ev-1", "old", "  Pictures ", "pdf",
    "samsung flow", "my-file", "a", "log",
]
DEFAULT_K = 50
# -----------------------------------------------------------------------------


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _columns(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The columns of a table, dealt over the shuffle partitions: a file of few row groups would stay in as few tasks."""
    return read_table(spark, sf_dir, name).select(*columns).repartition(*columns)


def _replace_spaces(c):
    return F.regexp_replace(c, " ", "_")


def fixture_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File listing ``ordinal BIGINT, path STRING, is_dir BOOLEAN`` from the driver tables."""
    part = _columns(spark, sf_dir, "part", "p_partkey", "p_name", "p_type", "p_size")
    folder = (F.when(F.col("p_size") % 5 == 0, "Downloads")
              .when(F.col("p_size") % 5 == 1, "Documents")
              .when(F.col("p_size") % 5 == 2, "Desktop")
              .when(F.col("p_size") % 5 == 3, "Pictures")
              .otherwise("Pictures/Samsung Flow"))
    base = _replace_spaces(F.col("p_name"))
    stem = (F.when(F.col("p_partkey") % 10 == 5, F.upper(base))
            .when(F.col("p_partkey") % 10 == 0, base)
            .otherwise(F.concat(base, F.lit("-"), F.col("p_partkey").cast("string"))))
    ext = (F.when(F.col("p_type") == "ECONOMY", ".TXT")
           .when(F.col("p_type") == "SMALL", ".txt")
           .when(F.col("p_type") == "MEDIUM", ".tar.gz")
           .when(F.col("p_type") == "LARGE", "")
           .when(F.col("p_type") == "PROMO", ".pdf")
           .otherwise(".jpg"))
    parts = part.select(
        F.col("p_partkey").cast("bigint").alias("key"),
        F.concat(F.lit("C:/Users/me/"), folder, F.lit("/"),
                 F.when(F.col("p_partkey") % 37 == 0, ".").otherwise(""), stem, ext).alias("path"))

    docs = _columns(spark, sf_dir, "documents", "doc_id", "lang", "source").select(
        (F.lit(1_000_000_000) + F.col("doc_id")).cast("bigint").alias("key"),
        F.concat(F.lit("D:/work/"), F.col("lang"), F.lit("_documents/"), F.col("source"),
                 F.lit("/doc"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"))

    orders = _columns(spark, sf_dir, "orders", "o_orderkey", "o_orderdate", "o_orderpriority").select(
        (F.lit(2_000_000_000) + F.col("o_orderkey")).cast("bigint").alias("key"),
        F.concat(F.lit("E:/Archive/"), F.year("o_orderdate").cast("string"), F.lit("/"),
                 _replace_spaces(F.col("o_orderpriority")), F.lit("/order_"),
                 F.col("o_orderkey").cast("string"), F.lit(".pdf")).alias("path"))

    events = _columns(spark, sf_dir, "events", "event_id", "event_type").select(
        (F.lit(3_000_000_000) + F.col("event_id")).cast("bigint").alias("key"),
        F.concat(F.lit("F:/logs/"), F.when(F.col("event_id") % 50 == 0, "AppData/").otherwise(""),
                 F.col("event_type"), F.lit("/ev-"), F.col("event_id").cast("string"),
                 F.lit(".json")).alias("path"))

    url = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col("url"), "^https?://", ""),
                                            "[?#].*$", ""), "/$", "")
    pages = _columns(spark, sf_dir, "pages", "page_id", "url").select(
        (F.lit(4_000_000_000) + F.col("page_id")).cast("bigint").alias("key"),
        F.concat(F.lit("W:/"), F.when(F.col("page_id") % 20 == 0, "node_modules/").otherwise(""),
                 url).alias("path"))

    files = parts.unionByName(docs).unionByName(orders).unionByName(events).unionByName(pages)
    # Stored once: filters on paths would be pushed into the few tasks that read the tables, once per use.
    return staged(files.select(
        F.col("key").alias("ordinal"),
        "path",
        F.lit(False).alias("is_dir")), "fixture-listing")


def query_batch(spark: SparkSession, raws: list[str] | None = None) -> DataFrame:
    """``query_id INT, raw STRING`` - the bench's 20 queries by default."""
    raws = QUERY_BATCH if raws is None else raws
    schema = T.StructType([T.StructField("query_id", T.IntegerType(), False),
                           T.StructField("raw", T.StringType(), True)])
    return spark.createDataFrame(list(enumerate(raws)), schema)


# --- configuration tables (user settings, a handful of rows) ----------------
USER_ROOTS = [
    "C:/Users/me/Downloads", "C:/Users/me/Documents", "C:/Users/me/Desktop", "C:/Users/me/Videos",
    "C:/Users/me/Pictures", "C:/Users/me/Pictures/Samsung Flow",
]
USER_LOCATIONS = [
    ("Desktop", "C:/Users/me/Desktop"), ("Documents", "C:/Users/me/Documents"),
    ("Downloads", "C:/Users/me/Downloads"),
]
# -----------------------------------------------------------------------------


def roots_table(spark: SparkSession, catalog: DataFrame) -> DataFrame:
    """``root, root_key``: the C: user folders plus the root of every other drive in the catalog."""
    user = spark.createDataFrame([(r,) for r in USER_ROOTS], "root string")
    drives = (catalog.where(F.col("drive").between("D", "Z")).select(F.col("drive").alias("letter")).distinct()
              .select(F.concat("letter", F.lit(":/")).alias("root")))
    return user.unionByName(drives).select("root", F.col("root").alias("root_key"))


def locations_table(spark: SparkSession, catalog: DataFrame) -> DataFrame:
    """``label, path``: named user folders plus one ``X:`` label per drive in the catalog."""
    user = spark.createDataFrame(USER_LOCATIONS, "label string, path string")
    drives = (catalog.where(F.col("drive").between("C", "Z")).select(F.col("drive").alias("letter")).distinct()
              .select(F.concat("letter", F.lit(":")).alias("label"),
                      F.concat("letter", F.lit(":/")).alias("path")))
    return user.unionByName(drives)


def location_requests(catalog: DataFrame) -> DataFrame:
    """``request_id, label, custom``: one request per folder, cycling over label kinds."""
    c = F.col("ordinal") % 5
    label = (F.when(c == 0, "Desktop").when(c == 1, "documents").when(c == 2, "Downloads")
             .when(c == 3, F.concat(F.substring("path", 1, 1), F.lit(":"))).otherwise("custom"))
    return catalog.where("is_dir").select(F.col("ordinal").alias("request_id"), label.alias("label"),
                                          F.col("path").alias("custom"))


def text_queries(catalog: DataFrame) -> DataFrame:
    """``query_id, raw``: a raw query per item - padded upper-case name, name + tab, or blank."""
    c = F.col("ordinal") % 3
    raw = (F.when(c == 0, F.concat(F.lit("  "), F.upper("name"), F.lit(" ")))
           .when(c == 1, F.concat("name", F.lit("\t")))
           .otherwise(F.lit("   ")))
    return catalog.select(F.col("ordinal").alias("query_id"), raw.alias("raw"))


def relisted(listing: DataFrame) -> DataFrame:
    """A second listing: every third file gets a '.bak' twin path (new), the rest repeat."""
    return listing.select(
        "ordinal",
        F.when(F.col("ordinal") % 3 == 0, F.concat("path", F.lit(".bak")))
        .otherwise(F.col("path")).alias("path"),
        "is_dir")


def rename_requests(catalog: DataFrame) -> DataFrame:
    """``change_id, path, new_name``: one request per catalog item, cycling over outcomes.

    0 same name (unchanged), 1 reserved character (invalid), 2 upper-cased
    name (exists: case-insensitive twin of itself), 3 absent source
    (missing), 4 a name shared by every such item of the folder (rivals), else
    a ``_v2`` suffix (ok unless taken).
    """
    c = F.col("ordinal") % 11
    path = F.when(c == 3, F.concat("path", F.lit("_gone"))).otherwise(F.col("path"))
    new_name = (F.when(c == 0, F.col("name"))
                .when(c == 1, F.concat("name", F.lit("?")))
                .when(c == 2, F.upper("name"))
                .when(c == 3, F.concat("name", F.lit("_x")))
                .when(c == 4, F.concat(F.lit("shared_"), F.col("parent_name")))
                .otherwise(F.concat("name", F.lit("_v2"))))
    return catalog.select(F.col("ordinal").alias("change_id"), path.alias("path"), new_name.alias("new_name"))


def creation_manifest(catalog: DataFrame) -> DataFrame:
    """``change_id, location, name, kind, content, make_parents``: one request per item.

    0 folder at an existing item (kept / conflict), 1 file at an existing item
    (overwritten / conflict), 2 new folder with a nested name, 3 new file with
    content, 4 file with a reserved character, 5 file in an absent folder
    without parents (missing), 6 folder below the item itself (conflict when a file).
    """
    c = F.col("ordinal") % 7
    location = (F.when(c.isin(0, 1), F.col("parent"))
                .when(c == 5, F.concat("path", F.lit("_nodir")))
                .when(c == 6, F.col("path"))
                .otherwise(F.col("parent")))
    name = (F.when(c.isin(0, 1), F.col("name"))
            .when(c == 2, F.concat(F.lit("new_"), F.col("name"), F.lit("/inner")))
            .when(c == 3, F.concat(F.col("name"), F.lit(".new")))
            .when(c == 4, F.concat(F.col("name"), F.lit("*")))
            .when(c == 5, F.lit("note.txt"))
            .otherwise(F.lit("sub")))
    kind = F.when(c.isin(0, 2, 6), F.lit("folder")).otherwise(F.lit("file"))
    content = F.when(c == 3, F.concat(F.lit("about "), F.col("name"))).otherwise(F.lit(""))
    return catalog.select(F.col("ordinal").alias("change_id"), location.alias("location"), name.alias("name"),
                          kind.alias("kind"), content.alias("content"), (c != 5).alias("make_parents"))


def nested_manifest(catalog: DataFrame) -> DataFrame:
    """One nested request per catalog folder: a ``bundle`` folder with files and a subfolder."""
    bad = F.col("ordinal") % 4 == 0
    files = F.array(F.struct(F.lit("readme.txt").alias("name"), F.col("name").alias("content")),
                    F.struct(F.when(bad, F.concat(F.col("name"), F.lit("?"))).otherwise(F.col("name"))
                             .alias("name"), F.lit("").alias("content")))
    subs = F.array(F.struct(F.lit("sub").alias("name"),
                            F.array(F.struct(F.lit("a.txt").alias("name"), F.lit("x").alias("content")))
                            .alias("files")))
    return catalog.where("is_dir").select(F.col("ordinal").alias("change_id"), F.col("path").alias("location"),
                                          F.lit("bundle").alias("folder"), files.alias("files"),
                                          subs.alias("subfolders"))


def picks_table(queries: DataFrame) -> DataFrame:
    """``query_id, n``: a pick per query, n cycling 1..25 (some out of range)."""
    return queries.select("query_id", ((F.col("query_id") % 25) + 1).alias("n"))
