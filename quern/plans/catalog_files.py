"""Queries that write tables as files and read them back through the sources, with the SQL over the tables themselves."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import audit, evaluate, governance
from quern.plans.catalog import query, sql_has
from quern.plans.shared import read_table, shared_dir
from quern.functions import numeric as N
from quern.functions import text as X
from quern.sources import files, sinks


def folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared storage, deleted when the application ends."""
    path = f"{shared_dir(spark)}/quern-files-{name}-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def value(name: str, kind: str = "string"):  # noqa: ANN201
    return F.try_variant_get("row", f"$.{name}", kind).alias(name)


def lines(spark: SparkSession, name: str, values: list[str]) -> str:
    """Crafted lines as one text file."""
    path = folder(spark, name)
    spark.createDataFrame(list(enumerate(values)), "k int, value string").coalesce(1).sortWithinPartitions("k").select("value").write.text(path)
    return f"{path}/part-*"


# --- scans --------------------------------------------------------------------------------------------------------------
@query("SELECT doc_id, text, lang, n_chars FROM documents")
def scan_jsonl(spark: SparkSession, d: str) -> DataFrame:
    path = folder(spark, "jsonl")
    sinks.write_jsonl(read_table(spark, d, "documents").select("doc_id", "text", "lang", "n_chars"), path)
    return files.read_rows(spark, files.expand(spark, [f"{path}/part-*"]), "jsonl").select(value("doc_id", "long"), value("text"), value("lang"), value("n_chars", "long"))


@query("SELECT * FROM (VALUES (2::BIGINT, '{broken'), (5::BIGINT, 'not json'), (7::BIGINT, '[1,')) t(line_no, value)")
def jsonl_problems(spark: SparkSession, d: str) -> DataFrame:
    path = lines(spark, "problems", ['{"a": 1}', "{broken", "", "17", "not json", '["x"]', "[1,", "null"])
    return files.jsonl_problems(spark, path).select("line_no", "value")


@query("SELECT line_no::BIGINT AS line_no, doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS line_no FROM documents)")
def numbered_lines(spark: SparkSession, d: str) -> DataFrame:
    path = folder(spark, "numbered")
    read_table(spark, d, "documents").select("doc_id").repartition(1).sortWithinPartitions("doc_id").select(F.col("doc_id").cast("string")).write.text(path)
    return files.numbered_lines(spark, path).select("line_no", F.col("value").cast("long").alias("doc_id"))


@query("SELECT item_id, passage, question, answer FROM eval_items")
def scan_json_envelope(spark: SparkSession, d: str) -> DataFrame:
    """One document with its records in nested envelopes."""
    path = folder(spark, "json")
    rows = read_table(spark, d, "eval_items").select((F.col("item_id") % 3).alias("part"), F.struct("item_id", "passage", "question", "answer", F.lit("x").alias("text")).alias("r"))
    parts = rows.groupBy("part").agg(F.collect_list("r").alias("items"))  # the evaluation items, a table of fixed size
    parts.select(F.struct("items").alias("p")).groupBy().agg(F.collect_list("p").alias("data")).select(F.to_json(F.struct("data"))).coalesce(1).write.text(path)
    return files.read_rows(spark, files.expand(spark, [f"{path}/part-*"]), "json").select(value("item_id", "long"), value("passage"), value("question"), value("answer"))


@query("SELECT item_id::VARCHAR AS id, suite AS title, passage AS input, question AS instruction, coalesce(answer, '') AS output FROM eval_items")
def scan_json_questions(spark: SparkSession, d: str) -> DataFrame:
    """Question lists by paragraph; the first answer counts."""
    path = folder(spark, "questions")
    e = read_table(spark, d, "eval_items").repartition(4)
    answers = F.array(F.struct(F.coalesce("answer", F.lit("")).alias("text")), F.struct(F.lit("other").alias("text")))
    qas = F.array(F.struct(F.col("item_id").cast("string").alias("id"), "question", answers.alias("answers")))
    e.select(F.to_json(F.struct(F.col("suite").alias("title"), F.array(F.struct(F.col("passage").alias("context"), qas.alias("qas"))).alias("paragraphs")))).write.option("maxRecordsPerFile", 1).text(path)
    rows = files.read_rows(spark, files.expand(spark, [f"{path}/part-*"]), "json")
    return rows.select(F.try_variant_get("row", "$.meta.id", "string").alias("id"), F.try_variant_get("row", "$.meta.title", "string").alias("title"), value("input"), value("instruction"), value("output"))


_SOURCE_FILE = "source_name || ' ' || coalesce(source_path, '')"


def source_files(spark: SparkSession, d: str, changed: bool = False) -> str:
    """One text file for each source, in folders by kind and name."""
    path = folder(spark, "sources")
    note = F.when(F.lit(changed) & (F.length("source_name") % 3 == 0), F.lit("!")).otherwise("")
    rows = read_table(spark, d, "sources").select(F.coalesce("schema_kind", F.lit("none")).alias("kind"), F.col("source_name").alias("name"), F.concat("source_name", F.lit(" "), F.coalesce("source_path", F.lit("")), note).alias("value"))
    rows.write.partitionBy("kind", "name").text(path)
    return path


def name_in_path(path: str = "path"):  # noqa: ANN201
    return F.regexp_extract(path, "name=([^/]*)", 1).alias("source_name")


@query(f"SELECT source_name, {_SOURCE_FILE} || chr(10) AS text FROM sources")
def scan_txt(spark: SparkSession, d: str) -> DataFrame:
    return files.read_txt(spark, files.expand(spark, [f"{source_files(spark, d)}/**/*.txt"])).select(name_in_path(), "text")


@query("SELECT source_name FROM sources")
def source_glob(spark: SparkSession, d: str) -> DataFrame:
    """Files found by a recursive glob, and again by one level a pattern: each once."""
    path = source_files(spark, d)
    return files.file_list(spark, [f"{path}/**/*.txt", f"{path}/*/*/part-*.txt"]).select(name_in_path())


@query("SELECT doc_id::VARCHAR AS doc_id, coalesce(title, '') AS title, coalesce(lang, '') AS lang, coalesce(text, '') AS text FROM documents")
def scan_csv(spark: SparkSession, d: str) -> DataFrame:
    """Quoted fields with quotes, separators and line ends of every kind."""
    path = folder(spark, "csv")
    rows = read_table(spark, d, "documents").select("doc_id", "title", "lang", "text")
    rows.write.csv(path, header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return files.read_delimited(spark, path)


@query("SELECT o_orderkey::VARCHAR AS o_orderkey, o_orderpriority FROM orders")
def scan_tsv(spark: SparkSession, d: str) -> DataFrame:
    path = folder(spark, "tsv")
    read_table(spark, d, "orders").select("o_orderkey", "o_orderpriority").write.csv(path, header=True, sep="\t")
    rows = files.read_rows(spark, files.expand(spark, [f"{path}/part-*"]), "tsv")
    return rows.select(value("o_orderkey"), value("o_orderpriority"))


@query("""SELECT 0 AS src_ord, 'corpus' AS source_name, count(*) AS n, sum(n_chars)::BIGINT AS size FROM documents
UNION ALL SELECT 1, 'items', count(*), sum(length(question))::BIGINT FROM eval_items UNION ALL SELECT 2, 'notes', count(*), sum(length(source_name || ' ' || coalesce(source_path, '')) + 1)::BIGINT FROM sources""")
def scan_sources(spark: SparkSession, d: str) -> DataFrame:
    """Sources of several formats as one scan, in the order stated."""
    a, b = folder(spark, "corpus"), folder(spark, "items")
    sinks.write_jsonl(read_table(spark, d, "documents").select("doc_id", F.col("n_chars").alias("size")), a)
    read_table(spark, d, "eval_items").select("item_id", F.length("question").alias("size")).coalesce(1).write.csv(b, header=True)
    scan = files.union_scan(
        spark,
        [{"name": "corpus", "path": f"{a}/part-*", "format": "jsonl"}, {"name": "items", "paths": [f"{b}/*.csv", f"{b}/part-*.csv"]}, {"name": "notes", "path": f"{source_files(spark, d)}/**/part-*"}],
    )
    size = F.coalesce(F.try_variant_get("row", "$.size", "long"), F.length(F.try_variant_get("row", "$.text", "string")))
    return scan.groupBy("src_ord", "source_name").agg(F.count("*").alias("n"), F.sum(size).cast("long").alias("size"))


@query("SELECT min(doc_id) AS doc_id FROM documents")
def first_row(spark: SparkSession, d: str) -> DataFrame:
    path = folder(spark, "first")
    read_table(spark, d, "documents").select("doc_id").repartition(1).sortWithinPartitions("doc_id").select(F.to_json(F.struct("doc_id"))).write.text(path)
    return files.first_row(spark, f"{path}/part-*", "jsonl").select(value("doc_id", "long"))


# --- checksums, locks, denylists ----------------------------------------------------------------------------------------
@query(f"SELECT source_name, sha256({_SOURCE_FILE} || chr(10)) AS sha256, (strlen({_SOURCE_FILE}) + 1)::BIGINT AS bytes, 1::BIGINT AS newlines FROM sources")
def file_checksums(spark: SparkSession, d: str) -> DataFrame:
    return files.checksums(files.file_list(spark, [f"{source_files(spark, d)}/**/*.txt"])).select(name_in_path(), "sha256", "bytes", "newlines")


@query("SELECT sha256(string_agg(l || chr(10), '' ORDER BY doc_id)) AS sha256, (sum(strlen(l) + 1))::BIGINT AS bytes, count(*) AS newlines FROM (SELECT doc_id, regexp_replace(regexp_replace(text, '[\\r\\n]+', ' ', 'g'), '^" + X.WHITE + "|" + X.WHITE + "$', '', 'g') AS l FROM documents) WHERE l <> ''")
def corpus_signature(spark: SparkSession, d: str) -> DataFrame:
    """Signature of the tokenizer corpus written as one file."""
    path = folder(spark, "corpus-file")
    sinks.write_tokenizer_corpus(read_table(spark, d, "documents").select("doc_id", "text").repartition(1).sortWithinPartitions("doc_id"), "text", path)
    return files.checksums(files.file_list(spark, [f"{path}/part-*"])).select("sha256", "bytes", "newlines")


@query(f"SELECT CASE WHEN length(source_name) % 2 = 0 THEN 'evaluation' ELSE 'training' END AS purpose, source_name, sha256({_SOURCE_FILE} || chr(10)) AS sha256 FROM sources")
def source_lock(spark: SparkSession, d: str) -> DataFrame:
    path = source_files(spark, d)
    names = [r.source_name for r in read_table(spark, d, "sources").select("source_name").toLocalIterator()]  # source policy, a table of fixed size
    lock = governance.source_lock(spark, [{"name": n, "purpose": "evaluation" if len(n) % 2 == 0 else "training", "path": f"{path}/*/name={n}/part-*"} for n in names])
    return lock.select("purpose", "source_name", "sha256")


@query("SELECT source_name, CASE WHEN length(source_name) % 3 = 0 THEN 'changed' ELSE 'removed' END AS change FROM sources WHERE length(source_name) % 3 = 0 OR length(source_name) % 5 = 0")
def source_lock_changes(spark: SparkSession, d: str) -> DataFrame:
    """What differs from a lock after some files changed and some went."""

    def lock(path: str) -> DataFrame:
        sums = governance.source_lock(spark, [{"name": "all", "path": f"{path}/**/part-*"}])
        return sums.select("source_name", name_in_path().alias("path"), "sha256")

    now = lock(source_files(spark, d, changed=True)).filter((F.length("path") % 5 != 0) | (F.length("path") % 3 == 0))
    return governance.lock_changes(lock(source_files(spark, d)), now).select(F.col("path").alias("source_name"), "change")


@query("SELECT DISTINCT sha256(text) AS hash FROM documents WHERE text IS NOT NULL")
def denylist_file(spark: SparkSession, d: str) -> DataFrame:
    """A list with comments, blank lines, repeats and capitals."""
    path = folder(spark, "deny")
    h = F.sha2("text", 256)
    texts = read_table(spark, d, "documents").filter("text IS NOT NULL")
    texts.select(F.explode(F.array(F.lit("# note"), F.lit("  "), F.upper(h), F.concat(F.lit(" "), h))).alias("value")).write.text(path)
    return files.read_denylist(spark, path)


@query("SELECT sha256('[' || string_agg('\"' || h || '\"', ',' ORDER BY h) || ']') AS digest FROM (SELECT DISTINCT sha256(text) AS h FROM documents WHERE text IS NOT NULL)")
def denylist_digest(spark: SparkSession, d: str) -> DataFrame:
    return governance.denylist_digest(read_table(spark, d, "documents").select(F.sha2("text", 256).alias("hash")))


@query("SELECT pair_id FROM preference_samples p WHERE prompt IN (SELECT prompt FROM preference_samples WHERE pair_id % 50 = 0) OR chosen IN (SELECT prompt FROM preference_samples WHERE pair_id % 50 = 0)")
def component_hits(spark: SparkSession, d: str) -> DataFrame:
    """Listed prompts inside nested rows, but for fields that begin with an underscore."""
    p = read_table(spark, d, "preference_samples")
    inner = F.struct(F.array(F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content")), F.struct(F.lit("bot").alias("role"), F.col("chosen").alias("content"))).alias("turns"), F.col("rejected").alias("_left"))
    deny = p.filter("pair_id % 50 = 0").select(governance.content_hash(F.col("prompt")).alias("hash"))
    return governance.component_hits(p.select("pair_id", F.to_json(F.struct(F.array(inner).alias("talk"), F.lit(1).alias("n"))).alias("j")), "pair_id", "j", deny)


@query("SELECT '/' || source_name || '/a.txt' AS path FROM sources WHERE length(source_name) % 2 = 0")
def path_overlap(spark: SparkSession, d: str) -> DataFrame:
    s = read_table(spark, d, "sources")
    train = s.select(F.concat(F.lit("file:///"), "source_name", F.lit("/./b/..//a.txt")).alias("path"))
    held = s.filter(F.length("source_name") % 2 == 0).select(F.concat(F.lit("/x/../"), "source_name", F.lit("/a.txt")).alias("path"))
    return governance.path_overlap(train, held)


@query("SELECT source AS source, 'scanned' AS column, count(*)::VARCHAR AS stored, (count(*) FILTER (doc_id % 7 <> 0))::VARCHAR AS now FROM documents GROUP BY source HAVING count(*) FILTER (doc_id % 7 = 0) > 0 AND count(*) FILTER (doc_id % 7 <> 0) > 0 UNION ALL SELECT source, 'scanned', count(*)::VARCHAR, NULL FROM documents GROUP BY source HAVING count(*) FILTER (doc_id % 7 <> 0) = 0")
def audit_changes(spark: SparkSession, d: str) -> DataFrame:
    """A stored audit against one of fewer rows."""
    path = folder(spark, "audit")
    docs = read_table(spark, d, "documents").filter("source IS NOT NULL")
    sinks.write_jsonl(docs.groupBy("source").agg(F.count("*").alias("scanned")), path)
    stored = files.read_jsonl(spark, path).select(value("source"), value("scanned", "long"))
    return governance.audit_changes(stored, docs.filter("doc_id % 7 <> 0").groupBy("source").agg(F.count("*").alias("scanned")), "source")


@query(f"SELECT source_name, 'name' AS problem FROM sources WHERE false UNION ALL SELECT source_name, 'email' FROM sources WHERE {sql_has('source_name || chr(32) || coalesce(source_path, chr(32))', 'email')} UNION ALL SELECT source_name, 'slash' FROM sources WHERE source_path LIKE '%/%'")
def publication_problems(spark: SparkSession, d: str) -> DataFrame:
    held = files.read_txt(spark, files.expand(spark, [f"{source_files(spark, d)}/**/*.txt"])).withColumnRenamed("text", "value")
    found = governance.publication_problems(held, ("pkl", "pt"), r"^\.env", {"email": audit.PATTERNS["email"], "slash": "/"})
    return found.select(name_in_path(), "problem")


# --- sinks --------------------------------------------------------------------------------------------------------------
@query("SELECT regexp_replace(regexp_replace(text, '[\\r\\n]+', ' ', 'g'), '^" + X.WHITE + "|" + X.WHITE + "$', '', 'g') AS value FROM documents WHERE regexp_replace(regexp_replace(text, '[\\r\\n]+', ' ', 'g'), '^" + X.WHITE + "|" + X.WHITE + "$', '', 'g') <> ''")
def tokenizer_corpus(spark: SparkSession, d: str) -> DataFrame:
    path = folder(spark, "lines")
    sinks.write_tokenizer_corpus(read_table(spark, d, "documents").select("text"), "text", path)
    return spark.read.text(path)


@query("SELECT seq_id, len(input_ids)::BIGINT AS n FROM token_rows WHERE seq_id IN (SELECT seq_id FROM token_rows WHERE seq_id % 50 = 0)")
def token_store_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Token rows written by split and looked up by id."""
    path = folder(spark, "store")
    rows = read_table(spark, d, "token_rows").withColumn("split_name", F.when(F.col("seq_id") % 10 == 0, "valid").otherwise("train"))
    sinks.write_token_store(rows, path)
    ids = [r.seq_id for r in rows.filter("seq_id % 50 = 0").select("seq_id").toLocalIterator()]  # the stated set
    return sinks.read_token_rows(spark, path, ids).select("seq_id", F.when(F.col("input_ids").isNotNull(), F.size("input_ids")).cast("long").alias("n"))


@query("SELECT * FROM (VALUES ('first', 1, 'none'), ('journal', 1, 'completed'), ('backup', 1, 'restored'), ('switch', 2, 'completed'), ('last', 3, 'none')) t(step, value, state)")
def publish_recovery(spark: SparkSession, d: str) -> DataFrame:
    """A switch that is stopped at each of its steps leaves the old or the new files, whole."""
    target = folder(spark, "published")
    seen = []

    def staged(v: int) -> str:
        path = folder(spark, "staged")
        spark.createDataFrame([(v,)], "value int").write.parquet(path)
        return path

    def look(step: str) -> None:
        state = sinks.recover(spark, target)
        seen.append((step, spark.read.parquet(target).first()["value"], state))

    sinks.publish(spark, staged(1), target)
    look("first")
    for step in ("journal", "backup", "switch"):
        try:
            sinks.publish(spark, staged(2), target, fail_after=step)
        except RuntimeError:
            look(step)
    sinks.publish(spark, staged(3), target)
    look("last")
    return spark.createDataFrame(seen, "step string, value int, state string")


@query("SELECT * FROM (VALUES ('a', 'f1', 0.5::DOUBLE), ('b', 'f1', 0.25::DOUBLE), ('a', 'f2', 0.75::DOUBLE)) t(checkpoint, evaluation_fingerprint, accuracy)")
def evaluation_log(spark: SparkSession, d: str) -> DataFrame:
    """A log with broken lines, strangers' keys and repeats: the last row of each checkpoint and fingerprint."""
    rows = [{"checkpoint": "a", "evaluation_fingerprint": "f1", "accuracy": 0.1}, {"checkpoint": "b", "evaluation_fingerprint": "f1", "accuracy": 0.25}, {"checkpoint": "a", "evaluation_fingerprint": "f1", "accuracy": 0.5}, {"checkpoint": "a", "evaluation_fingerprint": "f2", "accuracy": 0.75, "text": "private"}, {"accuracy": 1.0}]
    path = lines(spark, "log", [json.dumps(rows[0]), "{broken", *map(json.dumps, rows[1:4]), "[]", json.dumps(rows[4])])
    log = files.read_log(spark, path, ("checkpoint", "evaluation_fingerprint", "accuracy")).filter("checkpoint IS NOT NULL AND evaluation_fingerprint IS NOT NULL")
    keyed = log.withColumn("key", F.struct("checkpoint", "evaluation_fingerprint"))
    return evaluate.last_value(keyed, "key", "row_no", "accuracy").select("key.*", F.col("accuracy").cast("double"))


@query("SELECT * FROM (VALUES ('| label | n |'), ('| --- | --- |')) t(value) UNION ALL SELECT '| ' || label || ' | ' || count(*) || ' |' FROM embeddings GROUP BY label")
def evaluation_summary(spark: SparkSession, d: str) -> DataFrame:
    path = folder(spark, "summary")
    sinks.write_summary(read_table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n")), path)
    return spark.read.text(path)


@query(f"SELECT count(*) AS files, sum(n)::BIGINT AS bytes, ceil(sum(n) / 3.5)::BIGINT AS tokens, ceil(ceil(sum(n) / 3.5) * 8 * 1.25)::BIGINT AS cache_bytes, 1600::BIGINT AS training_bytes FROM (SELECT strlen({_SOURCE_FILE}) + 1 AS n FROM sources)")
def doctor_totals(spark: SparkSession, d: str) -> DataFrame:
    """Files, bytes and what they will need."""
    sums = files.checksums(files.file_list(spark, [f"{source_files(spark, d)}/**/*.txt"])).agg(F.count("*").alias("files"), F.sum("bytes").cast("long").alias("bytes"))
    return sums.select("files", "bytes", N.capacity(F.col("bytes"), 100).alias("c")).select("files", "bytes", "c.*")
