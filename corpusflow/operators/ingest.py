"""Incremental ingest: manifests, replace-by-source, run summaries, images, file rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow import rules
from corpusflow.functions import text as tx
from corpusflow.functions.skew import running
from corpusflow.session import materialize, work_dir

MANIFEST_KEY = ["path", "size", "mtime_ns"]
GONE_BITS = 1 << 26  # of the bitmap of replaced sources


def changed_files(listing: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files that are new or differ in size or time from the manifest (null-safe)."""
    m = manifest.select(*[F.col(c).alias(f"_{c}") for c in MANIFEST_KEY])
    same = None
    for c in MANIFEST_KEY:
        e = F.col(c).eqNullSafe(F.col(f"_{c}"))
        same = e if same is None else same & e
    return listing.join(m, same, "left_anti")


def upsert_manifest(manifest: DataFrame, indexed: DataFrame) -> DataFrame:
    """Latest record per path wins."""
    cols = [*MANIFEST_KEY, "indexed_at"]
    both = manifest.select(*cols).unionByName(indexed.select(*cols))
    rest = F.struct("indexed_at", "size", "mtime_ns")
    return both.groupBy("path").agg(F.max(rest).alias("r")).select("path", "r.size", "r.mtime_ns", "r.indexed_at")


def remove_paths(table: DataFrame, paths: DataFrame, column: str = "path") -> DataFrame:
    return table.join(paths.select(column).distinct(), column, "left_anti")


def run_summary(outcomes: DataFrame) -> DataFrame:
    """Totals of an indexing run. ``outcomes``: path, status (success/fail/skipped), ms, error."""
    s = F.col("status")
    return outcomes.agg(
        F.count("*").alias("total_files"),
        F.count_if(s == "success").alias("success_count"),
        F.count_if(s == "fail").alias("fail_count"),
        F.count_if(s == "skipped").alias("skipped_count"),
        F.sum("ms").alias("duration_ms"),
    ).withColumn("success", F.col("fail_count") == 0)


def failed_files(outcomes: DataFrame) -> DataFrame:
    """The failure map as rows, so it can be as long as the run."""
    return outcomes.where("status = 'fail'").select("path", "error")


def replace_by_source(table: DataFrame, new: DataFrame, source: str = "_source") -> DataFrame:
    """Drop all rows of the sources in ``new`` and add the new rows."""
    return table.join(new.select(source).distinct(), source, "left_anti").unionByName(new, allowMissingColumns=True)


def _is_table(spark: SparkSession, path: str) -> bool:
    """Whether there is a table at ``path``; any error other than its absence is raised."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _bucket(source: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(source), F.lit(buckets)).cast("int")


def dealt(rows: DataFrame, source: str, buckets: int = 256) -> DataFrame:
    """The rows in the buckets of their sources, in the shared folder.

    A bucket's rows are read together, so what is made of them row by row goes to :func:`write_replacing` as ``placed``, without a shuffle of its own.
    """
    path = work_dir(rows.sparkSession, "dealt")
    out = rows.withColumn("_source_bucket", _bucket(source, buckets)).hint("rebalance", F.col("_source_bucket"))
    out.write.option("compression", "zstd").partitionBy("_source_bucket").parquet(path)
    return rows.sparkSession.read.parquet(path)


def without_sources(rows: DataFrame, gone: DataFrame, source: str) -> DataFrame:
    """The rows whose ``source`` isn't in ``gone`` (one column of that name), exact and without a shuffle of rows.

    A bitmap of fixed size (8 MB at most) goes to the scan. Rows that it doesn't hold stay; of the others only the distinct names are
    compared, and those that share no more than a place in the bitmap, about one of ``GONE_BITS`` over the number of gone names, are joined back.
    """
    def placed(t: DataFrame) -> DataFrame:
        at = F.pmod(F.xxhash64(source), F.lit(GONE_BITS)) + 1
        return t.withColumns({"_part": F.bitmap_bucket_number(at), "_bit": F.bitmap_bit_position(at)})

    bits = materialize(placed(gone).groupBy("_part").agg(F.bitmap_construct_agg("_bit").alias("_bits")), "gone")
    byte = F.conv(F.hex(F.substr("_bits", F.shiftright("_bit", 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    there = F.coalesce(F.getbit(byte, F.col("_bit").cast("int").bitwiseAND(7)) == 1, F.lit(False))
    seen = placed(rows).join(F.broadcast(bits), "_part", "left").withColumn("_there", there).select(*rows.columns, "_there")
    perhaps = seen.where("_there").drop("_there")
    same = lambda t: F.col(source).eqNullSafe(t["_name"])
    names = gone.select(F.col(source).alias("_name"))
    staying = perhaps.select(source).distinct().join(names, same(names), "left_anti")
    staying = materialize(staying.select(F.col(source).alias("_name")), "staying")
    return seen.where("not _there").drop("_there").unionByName(perhaps.join(staying, same(staying), "left_semi"))


def write_replacing(new: DataFrame, path: str, source: str = "_source", buckets: int = 256, placed: bool = False) -> None:
    """Replace by source (a file, a document) on disk: only the hash buckets of touched sources are rewritten.

    The touched buckets are written beside the table and swapped by dynamic partition overwrite, so they can be read while
    they are written: a batch is written once for itself and once in its buckets, the first batch of a table only there.
    Writers are dealt by size: a bucket with much data has several, small buckets share one. Rows made in place from those of :func:`dealt`
    with the same ``buckets`` are ``placed``: they and the stored rows are written by the tasks that read them, no row is shuffled.
    """
    spark = new.sparkSession
    add = new.withColumn("_source_bucket", _bucket(source, buckets))
    if _is_table(spark, path):
        add = materialize(add, "replace")
        old = spark.read.parquet(path)
        touched = add.select("_source_bucket").distinct()  # no more rows than there are buckets
        kept = old.join(F.broadcast(touched), "_source_bucket", "left_semi")
        kept = without_sources(kept, add.select(source).distinct(), source)
        add = kept.unionByName(add, allowMissingColumns=True)
    rows = add if placed else add.hint("rebalance", F.col("_source_bucket"))
    (rows.write.mode("overwrite").option("compression", "zstd").option("partitionOverwriteMode", "dynamic")
     .partitionBy("_source_bucket").parquet(path))


def parent_rows(chunks: DataFrame) -> DataFrame:
    return chunks.where("chunk_level < 3")


def upsert_parents(store: DataFrame, new: DataFrame) -> DataFrame:
    """Parents by id; rows of ``new`` win over stored ones."""
    return store.join(new.select("chunk_id").distinct(), "chunk_id", "left_anti").unionByName(parent_rows(new), allowMissingColumns=True)


# ---- extraction --------------------------------------------------------------


def html_text(c: Column) -> Column:
    """Visible text of a page, by built-ins: hidden blocks and comments go, block tags become line breaks, other tags
    blanks, then character references are resolved."""
    for p in rules.HTML_HIDDEN:
        c = F.regexp_replace(c, p, " ")
    c = F.regexp_replace(F.regexp_replace(c, rules.HTML_BREAK, "\n"), rules.HTML_TAG, " ")
    return tx.normalize_text(_resolved(c))


def _resolved(c: Column) -> Column:
    """Numbered references by their code point, named ones from the fixed list; the ampersand last."""
    found = F.regexp_extract_all(c, F.lit(rules.HTML_NUMBER), F.lit(1))

    def char(n):
        code = F.coalesce(F.when(n.rlike("^[xX]"), F.conv(F.substr(n, F.lit(2)), 16, 10)).otherwise(n).try_cast("long"), F.lit(0))
        ok = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        return F.when(ok, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(F.lit("\ufffd"))

    parts = F.transform(F.split(c, rules.HTML_NUMBER, -1), lambda p, i: F.concat(p, F.coalesce(F.transform(F.array(F.get(found, i)), lambda n: F.when(n.isNotNull(), char(n)))[0], F.lit(""))))
    out = F.when(F.contains(c, F.lit("&#")), F.array_join(parts, "")).otherwise(c)
    for name, value in rules.HTML_NAMED.items():
        out = F.replace(out, F.lit(f"&{name};"), F.lit(value))
    return F.replace(out, F.lit("&amp;"), F.lit("&"))


def extraction_rows(files: DataFrame, summary_length: int = 5000, known=(".txt", ".text", ".md", ".markdown", ".html", ".htm")) -> DataFrame:
    """Result row per file (path, raw text or null): ok or error code, text, summary, size."""
    name = F.element_at(F.split("path", "/"), -1)
    ext = F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1))
    error = tx.first_match(
        [
            (F.coalesce(F.col("path"), F.lit("")) == "", "INVALID_INPUT"),
            (F.col("raw").isNull(), "FILE_NOT_FOUND"),
            (~ext.isin(list(known)), "UNSUPPORTED_FILE_TYPE"),
        ],
        F.lit(None).cast("string"),
    )
    is_html = ext.isin(".html", ".htm")
    t = F.when(is_html, html_text(F.col("raw"))).otherwise(tx.normalize_text(F.col("raw")))
    out = files.select("path", name.alias("filename"), ext.alias("file_type"), error.alias("error"), t.alias("_t"))
    ok = F.col("error").isNull()
    return out.select(
        "path", "filename", "file_type", ok.alias("ok"), "error", F.when(ok, F.col("_t")).alias("text"),
        F.when(ok, tx.preview(F.col("_t"), summary_length)).alias("summary"),
        F.when(ok, F.length("_t").cast("long")).alias("char_count"))


# ---- images ------------------------------------------------------------------


def image_placeholders(c: Column) -> Column:
    """Distinct placeholders in the order they first appear."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(rules.IMAGE_PLACEHOLDER), F.lit(0)))


def strip_placeholders(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, rules.IMAGE_PLACEHOLDER, " "), r"\s+", " "))


def image_map(texts: DataFrame, images: DataFrame, id_col: str) -> DataFrame:
    """(id, placeholder, url) for the placeholders of each text that have an image."""
    ph = texts.select(id_col, F.explode(image_placeholders(F.col("text"))).alias("placeholder"))
    return ph.join(images.select("placeholder", "image_url"), "placeholder")


def update_captions(images: DataFrame, captions: DataFrame) -> DataFrame:
    """New captions replace old ones where given."""
    new = captions.select("placeholder", F.col("caption").alias("_new"))
    return images.join(new, "placeholder", "left").withColumn(
        "caption", F.coalesce(F.when(F.col("_new") != "", F.col("_new")), F.col("caption"))).drop("_new")


def caption_chunks(chunks: DataFrame, images: DataFrame) -> DataFrame:
    """One leaf chunk per distinct placeholder of a file that has a caption.

    The page is the image's own, else the last page of the file.
    """
    last = chunks.groupBy("filename").agg(F.max("page_number").alias("_last"))
    ph = chunks.select("filename", F.explode(image_placeholders(F.col("text"))).alias("placeholder")).distinct()
    j = ph.join(images.where("caption <> ''"), "placeholder").join(last, "filename")
    image_id = F.regexp_extract("placeholder", r"<<IMAGE:([0-9a-f]{8})>>", 1)
    cid = F.concat(F.col("filename"), F.lit("::image_caption::"), image_id)
    return j.select(
        "filename", cid.alias("chunk_id"), F.lit("").alias("parent_chunk_id"), cid.alias("root_chunk_id"),
        F.lit(3).alias("chunk_level"),
        F.coalesce(F.when(F.col("image_page") > 0, F.col("image_page")), F.col("_last")).alias("page_number"),
        F.concat(F.col("placeholder"), F.lit("\n图片说明："), F.col("caption")).alias("text"),
        F.lit("image").alias("chunk_type"))


def image_coverage(placeholders: DataFrame, captions: DataFrame, vectors: DataFrame, strict: bool = False) -> DataFrame:
    """How many placeholders have a caption, a vector, both or neither (an error when strict)."""
    p = placeholders.select("placeholder").distinct()
    j = p.join(captions.where("caption <> ''").select("placeholder", F.lit(1).alias("_c")).distinct(), "placeholder", "left").join(
        vectors.select("placeholder", F.lit(1).alias("_v")).distinct(), "placeholder", "left")
    c, v = F.col("_c").isNotNull(), F.col("_v").isNotNull()
    out = j.agg(F.count("*").alias("n"), F.count_if(c).alias("with_caption"), F.count_if(v).alias("with_vector"),
                F.count_if(c & v).alias("with_both"), F.count_if(~c & ~v).alias("with_neither"))
    if strict:
        out = out.withColumn("with_neither", F.when(F.col("with_neither") > 0, F.raise_error(F.lit("placeholder without caption and vector")).cast("long")).otherwise(F.col("with_neither")))
    return out


# ---- session files -------------------------------------------------------------


def quota_check(files: DataFrame, key: str, order: str, slice_: Column, max_files: int, max_file: int, max_total: int) -> DataFrame:
    """Error code per upload by running count and size in its session, else null.

    Counts and sizes run over all earlier uploads of the session, in slices of the order.
    """
    r = running(files, [key], slice_, [order], {"n_files": F.lit(1), "total_size": F.col("size")})
    code = tx.first_match(
        [(F.col("size") > max_file, "TEMP_FILE_TOO_LARGE"), (F.col("n_files") > max_files, "TEMP_FILE_LIMIT_EXCEEDED"),
         (F.col("total_size") > max_total, "TEMP_TOTAL_SIZE_EXCEEDED")], F.lit(None).cast("string"))
    return r.withColumn("error", code)


def expired(files: DataFrame, now: Column, ttl_seconds: int, mtime: str = "mtime") -> DataFrame:
    if ttl_seconds <= 0:
        return files.limit(0)
    return files.where(F.unix_timestamp(now) - F.unix_timestamp(mtime) > ttl_seconds)


def safe_file_name(c: Column) -> Column:
    base = tx.strip(F.element_at(F.split(c, "/"), -1))
    s = F.left(F.regexp_replace(base, r"[^A-Za-z0-9._\-一-鿿]", "_"), F.lit(180))
    return F.when(s == "", "upload.tmp").otherwise(s)


def safe_session_id(c: Column) -> Column:
    return F.left(F.regexp_replace(tx.strip(F.coalesce(c, F.lit(""))), r"[^A-Za-z0-9_.\-]", "_"), F.lit(120))


def material_type(name: Column, mime: Column) -> Column:
    ext = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    image = F.coalesce(F.startswith(mime, F.lit("image/")), F.lit(False)) | ext.isin(list(rules.IMAGE_EXTENSIONS))
    return F.when(image, "image").otherwise("document")
