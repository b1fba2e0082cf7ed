"""Records at rest: JSON and layered artefacts, resuming, splits, labels, exports and reports."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spandrel.functions.text import bound

#: Words in the names of settings that are never stored.
SECRET_KEYS = "key|token|secret|password"
ITEM = T.StructType([T.StructField("name", T.StringType()), T.StructField("amount", T.DoubleType())])
#: The receipt record, as JSON files hold it.
RECEIPT = T.StructType([*(T.StructField(f, T.StringType()) for f in ("doc_type", "seller_name", "date", "invoice_number", "seller_tax_id", "buyer_tax_id")), T.StructField("total_amount", T.DoubleType()), T.StructField("items", T.ArrayType(ITEM))])
#: The document model, as JSON texts hold it.
BOX = "struct<x0:double,y0:double,x1:double,y1:double,coordinate_space:string>"
ELEMENT = f"struct<element_id:string,page_number:int,element_type:string,text:string,markdown:string,bbox:{BOX},reading_order:int,parent_section_path:array<string>,confidence:double>"
DOCUMENT = f"struct<schema_version:string,document:struct<document_id:string,checksum_sha256:string>,parser:struct<name:string,version:string>,pages:array<struct<page_number:int,width:double,height:double,coordinate_space:string,elements:array<{ELEMENT}>>>>"


def read_records(spark: SparkSession, path: str, schema: T.StructType = RECEIPT) -> DataFrame:
    """A record a JSON file, with `name` from the file's own; a field that a file lacks is null."""
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.[^.]*)?$", 1)
    return spark.read.schema(schema).json(path, multiLine=True).select(stem.alias("name"), *schema.fieldNames())


def write_records(records: DataFrame, path: str) -> None:
    """Records as JSON lines in UTF-8, without escapes of other letters; nulls are written."""
    records.write.option("ignoreNullFields", "false").json(path)


def paired(images: DataFrame, labels: DataFrame, path: str = "path") -> DataFrame:
    """(stem, image, label): images and labels of equal stem; what has no partner is dropped."""
    stem = F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)
    return images.select(stem.alias("stem"), F.col(path).alias("image")).join(labels.select(stem.alias("stem"), F.col(path).alias("label")), "stem")


def parsed_documents(texts: DataFrame, text: str = "json") -> DataFrame:
    """The rows with their document model in `ir`; null where the text is none."""
    return texts.withColumn("ir", F.from_json(text, DOCUMENT))


def serialised(rows: DataFrame, ir: str = "ir") -> DataFrame:
    return rows.withColumn("json", F.to_json(ir, {"ignoreNullFields": "false"}))


def elements_of(documents: DataFrame) -> DataFrame:
    """(document_id, parser, page, reading_order, element_id, type, text): a document's elements one after another by page
    and reading order, equal ones as stored. Sorted within the row, so nothing is shuffled."""
    return documents.select(F.col("ir.document.document_id").alias("document_id"), F.col("ir.parser.name").alias("parser"), F.explode(canonical_elements(F.col("ir"))).alias("e")).select(
        "document_id", "parser", "e.page", "e.reading_order", "e.element_id", "e.type", "e.text"
    )


def canonical_elements(ir: Column) -> Column:
    """(page, at, reading_order, nth, element_id, type, text) of a document's elements in canonical order; at and nth:
    where its page and it are stored."""
    one = lambda p, e, i, j: F.struct(p["page_number"].alias("page"), i.alias("at"), e["reading_order"].alias("reading_order"), j.alias("nth"), e["element_id"].alias("element_id"), e["element_type"].alias("type"), e["text"].alias("text"))
    return F.array_sort(F.flatten(F.transform(ir["pages"], lambda p, i: F.transform(p["elements"], lambda e, j: one(p, e, i, j)))))


def plain_text(ir: Column) -> Column:
    """A document's texts that are not empty, a line each, by page and reading order."""
    return F.array_join(F.transform(F.filter(canonical_elements(ir), lambda e: F.coalesce(e["text"], F.lit("")) != ""), lambda e: e["text"]), "\n")


def artifact_name(x: Column) -> Column:
    """A name for files: letters, digits, dots, dashes and underscores; others are underscores."""
    return F.regexp_replace(x, r"[^\p{L}\p{N}._-]", "_")


def write_layer(rows: DataFrame, root: str, layer: str) -> None:
    """Rows (document_id, parser, ...) below root/layer, a folder a document and parser, so that readers prune."""
    named = rows.withColumns({c: artifact_name(F.col(c)) for c in ("document_id", "parser")})
    named.write.partitionBy("document_id", "parser").parquet(f"{root}/{layer}")


def required(manifest: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """The stored rows of every manifest entry; an entry without any is an error when the rows are read."""
    found = manifest.select(*keys).join(stored.withColumn("stored_", F.lit(True)), keys, "left")
    say = F.raise_error(F.concat(F.lit("not stored: "), F.concat_ws("/", *keys))).cast("boolean")
    return found.filter(F.coalesce("stored_", say)).drop("stored_")


def selected_pages(wanted: Column, count: Column) -> Column:
    """Sorted distinct pages; all if none are wanted; one outside 1..count is an error."""
    all_ = F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
    checked = F.when(F.exists(wanted, lambda p: (p < 1) | (p > count)), F.raise_error(F.lit("a page outside the document")).cast("array<int>")).otherwise(F.array_sort(F.array_distinct(wanted)))
    return F.when(F.coalesce(F.size(wanted), F.lit(0)) <= 0, all_).otherwise(checked)


def without_secrets(config: Column) -> Column:
    """A map of settings without those whose name speaks of a secret."""
    return F.map_filter(config, lambda k, _: ~F.lower(k).rlike(SECRET_KEYS))


def definition_sha256(definition: dict) -> str:
    """The digest of a definition, by its canonical JSON: sorted keys, no blanks, UTF-8."""
    from hashlib import sha256

    return sha256(json.dumps(definition, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def unfinished(targets: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """The targets that a former run has not finished."""
    return targets.join(done.select(key).distinct(), key, "left_anti")


def split(names: DataFrame, name: str, n_test: int, seed: int) -> DataFrame:
    """`names` with `part`, "test" for n_test of them in the order of a seeded hash, else "dev". The test names are a top
    list, so no full sort is made."""
    order = (F.xxhash64(F.lit(seed), F.col(name)), F.col(name))
    test = names.select(name).distinct().orderBy(*order).limit(n_test).withColumn("test_", F.lit("test"))
    return names.join(test, name, "left").withColumn("part", F.coalesce("test_", F.lit("dev"))).drop("test_")


def with_labels(images: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """`images` with `labeled`."""
    return images.join(labels.select(key).distinct().withColumn("labeled", F.lit(True)), key, "left").withColumn("labeled", F.coalesce("labeled", F.lit(False)))


def progress(images: DataFrame) -> DataFrame:
    return images.agg(F.count(F.lit(1)).alias("total"), F.count_if("labeled").alias("labeled"))


def generated_text(response: Column, thinking: Column) -> Column:
    """(text, channel): the response, or the thinking channel where that alone holds anything."""
    has = lambda x: F.coalesce(F.regexp_replace(x, r"(?U)\s+", "") != "", F.lit(False))
    return F.struct(F.when(has(response), response).when(has(thinking), thinking).otherwise("").alias("text"), F.when(has(response), "response").when(has(thinking), "thinking_fallback").otherwise("empty").alias("channel"))


def finite(x: Column, label: str, nullable: bool = False, rate: bool = False, least: float | None = None) -> Column:
    """The number, or an error if it is none that an export may hold."""
    bad = F.isnan(x) | (F.abs(x) == float("inf"))
    bad = bad | ~x.between(0, 1) if rate else bad if least is None else bad | (x < least)
    bad = F.coalesce(bad, F.lit(not nullable))
    return F.when(bad, F.raise_error(F.lit(f"{label} is out of range or missing")).cast("double")).otherwise(x)


def shown(x: Column, digits: int = 3) -> Column:
    """A number of a report: fixed digits, a dash for none."""
    return F.when(x.isNull(), "—").otherwise(F.format_string(f"%.{digits}f", x.cast("double")))


def exported(summary: DataFrame, config: str, rates: list[str], optional: list[str], allowed: list[str]) -> DataFrame:
    """A JSON text a configuration with its allowed columns only, in sorted order, and its digest. Columns beyond those
    allowed, or missing ones, are an error of the plan; numbers out of range are one of the rows."""
    unknown, missing = sorted(set(summary.columns) - set(allowed)), sorted(set(allowed) - set(summary.columns))
    if unknown or missing:
        raise ValueError(f"columns not allowed: {unknown}; missing: {missing}")
    clean = {c: F.round(finite(F.col(c).cast("double"), c, nullable=c in optional, rate=True), 6) if c in (*rates, *optional) else F.col(c) for c in allowed}
    text = F.to_json(F.struct(*(clean[c].alias(c) for c in sorted(clean))), {"ignoreNullFields": "false"})
    return summary.select(config, text.alias("json")).withColumn("sha256", F.sha2("json", 256))


def report_rows(summary: DataFrame, config: str, columns: list[str], digits: int = 3) -> DataFrame:
    """(config, row): each configuration as a row of a Markdown table."""
    cells = F.concat_ws(" | ", F.col(config).cast("string"), *(shown(F.col(c), digits) for c in columns))
    return summary.select(config, F.concat(F.lit("| "), cells, F.lit(" |")).alias("row"))


def report(summary: DataFrame, config: str, columns: list[str], digits: int = 3) -> str:
    """The table as one text; a row a configuration, of which there are few."""
    rows = [r["row"] for r in report_rows(summary, config, columns, digits).orderBy(config).collect()]
    return "\n".join([f"| {' | '.join([config, *columns])} |", "|" + "---|" * (len(columns) + 1), *rows])


def headline(summary: DataFrame, config: str, exact: list[str]) -> DataFrame:
    """(config, avg_exact): the mean of the configuration's exact rates."""
    return summary.select(config, bound(F.array(*(F.col(c) for c in exact)), lambda a: F.round(F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / len(exact), 6)).alias("avg_exact"))


def tag_counts(items: DataFrame, tags: str, minima: dict[str, int]) -> DataFrame:
    """(tag, n, enough): items that carry a tag, counted once each, against the least number required of some tags."""
    seen = items.select(F.explode(F.array_distinct(tags)).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    wanted = items.sparkSession.createDataFrame(list(minima.items()), "tag string, least long")
    both = seen.join(F.broadcast(wanted), "tag", "full")
    return both.select("tag", F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) >= F.coalesce("least", F.lit(0))).alias("enough"))
