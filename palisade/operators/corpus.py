"""Loading, flattening and checking dialogue corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.operators.scan import top_per_key, turn_bucket, union_all
from palisade.sources.tables import stored

CASE_SCHEMA = (
    "id string, tags array<string>, messages array<struct<speaker:string,text:string,turn:bigint>>, "
    "expected struct<detected:boolean,intentType:string,action:string,minConfidence:double,maxConfidence:double>, "
    "notes string, assessment string, family string"
)
CORPUS_SCHEMA = f"schemaVersion int, cases array<struct<{CASE_SCHEMA}>>"
ACTIONS = ("ALLOW", "WARN", "LOCK_INPUT")
TURNS_PER_CASE = 64


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Case rows of corpus JSON files: schema_version and the case fields."""
    raw = spark.read.schema(CORPUS_SCHEMA).option("multiLine", True).json(path)
    return raw.select("schemaVersion", F.explode("cases").alias("c")).select("schemaVersion", "c.*")


CASES_PER_FILE = 200


def write_corpus(cases: DataFrame, path: str) -> None:
    """JSON files of the corpus at `path`, about CASES_PER_FILE cases (value, as JSON) in each."""
    files = max(1, -(-cases.count() // CASES_PER_FILE))
    listed = cases.groupBy(F.pmod(F.xxhash64("value"), F.lit(files)).alias("file")).agg(F.array_join(F.sort_array(F.collect_list("value")), ",").alias("cases"))
    listed.select(F.concat(F.lit('{"schemaVersion":1,"cases":['), "cases", F.lit("]}")).alias("value")).write.option("maxRecordsPerFile", 1).text(path)


def flatten_cases(cases: DataFrame) -> DataFrame:
    """One row per message of a case, with the case's expectation beside it; turn is the stated one, else the place in the list."""
    return cases.select("id", "expected", "assessment", F.posexplode("messages").alias("pos", "m")).select(
        F.col("id").alias("case_id"),
        F.coalesce("m.turn", F.col("pos").cast("bigint")).alias("turn"),
        F.when(F.col("m.speaker") == "interlocutor", "inbound")
        .when(F.col("m.speaker") == "user", "outbound")
        .alias("direction"),
        F.col("m.text").alias("text"),
        F.col("expected.detected").alias("expected_detected"),
        F.col("expected.intentType").alias("expected_type"),
        F.col("expected.action").alias("expected_action"),
        "assessment",
    )


def cases_as_json(messages: DataFrame) -> DataFrame:
    """Corpus documents as JSON text. A conversation is one case; a long one travels in pieces of at most 64 turns that share its
    id and expectation, so no row gathers a whole hot conversation."""
    piece = F.floor(F.col("turn") / TURNS_PER_CASE)
    whole = messages.groupBy("conv_id").agg(
        F.max(F.when(F.col("direction") == "inbound", F.col("truth_type"))).alias("t"), F.max("truth_assessment").alias("assessment")
    )
    grouped = messages.groupBy("conv_id", piece.alias("piece")).agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    "turn",
                    F.when(F.col("direction") == "inbound", "interlocutor").otherwise("user").alias("speaker"),
                    "text",
                )
            )
        ).alias("ms")
    ).join(whole, "conv_id")
    return grouped.select(
        F.to_json(
            F.struct(
                F.concat_ws("-", F.lit("case"), "conv_id").alias("id"),
                F.transform("ms", lambda m: F.struct(m["speaker"].alias("speaker"), m["text"].alias("text"), m["turn"].alias("turn"))).alias(
                    "messages"
                ),
                F.struct(
                    F.col("t").isNotNull().alias("detected"),
                    F.col("t").alias("intentType"),
                    F.when(F.col("t").isNull(), "ALLOW").otherwise("WARN").alias("action"),
                ).alias("expected"),
                "assessment",
            )
        ).alias("value")
    )


def parse_cases(json_rows: DataFrame) -> DataFrame:
    return json_rows.select(F.from_json("value", CASE_SCHEMA).alias("c")).select("c.*")


def validate_cases(cases: DataFrame) -> DataFrame:
    """Violations per corpus and rule; cases: corpus, case_id, schema_version, n_messages, blank_texts, action,
    detected, expected_type."""
    rules = {
        "schema_version": F.col("schema_version") != 1,
        "empty_id": F.length(F.trim("case_id")) == 0,
        "no_messages": F.col("n_messages") < 1,
        "empty_text": F.col("blank_texts") > 0,
        "unknown_action": ~F.col("action").isin(*ACTIONS),
        "detected_without_type": F.col("detected") != F.col("expected_type").isNotNull(),
    }
    counted = cases.groupBy("corpus").agg(*[F.count_if(c).alias(name) for name, c in rules.items()])
    per_rule = counted.unpivot(["corpus"], list(rules), "rule", "violations")
    repeated = (
        cases.groupBy("case_id")
        .agg(F.count("*").alias("n"), F.min("corpus").alias("corpus"))
        .groupBy("corpus")
        .agg(F.count_if(F.col("n") > 1).alias("violations"))
        .select("corpus", F.lit("repeated_id").alias("rule"), "violations")
    )
    return per_rule.unionByName(repeated)


def fingerprint(df: DataFrame, group: str, row_text: Column) -> DataFrame:
    """Order-independent digest per group: row hashes are added up, so no group is gathered in one place."""
    h = F.sha2(F.regexp_replace(row_text, "\r\n", "\n"), 256)
    part = lambda i: F.conv(F.substring(h, i, 12), 16, 10).cast("bigint")
    sums = df.groupBy(group).agg(
        F.count("*").alias("n_rows"), *[F.sum(part(1 + 12 * i).cast("decimal(38,0)")).alias(f"s{i}") for i in range(5)]
    )
    digest = F.sha2(F.concat_ws(":", "n_rows", *[F.col(f"s{i}").cast("string") for i in range(5)]), 256)
    return sums.select(group, "n_rows", digest.alias("fingerprint"))


WINDOW_MS = 900_000
PER_DIRECTION = 30


def dialogue_history(messages: DataFrame, draft: str | None = None) -> DataFrame:
    """Transcript of each conversation as its session memory holds it at the last message."""
    ends = messages.groupBy("conv_id").agg(F.max("ts_ms").alias("end_ms"))
    live = messages.join(ends, "conv_id").filter(F.col("end_ms") - F.col("ts_ms") < WINDOW_MS)
    kept = top_per_key(live, ["conv_id", "direction"], [F.desc("ts_ms"), F.desc("turn")], PER_DIRECTION, turn_bucket())
    speaker = F.when(F.col("direction") == "outbound", "[Ви]").otherwise("[Співрозмовник]")
    lines = kept.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", F.concat(speaker, F.lit(": "), "text").alias("line")))).alias("l")
    )
    text = F.array_join(F.transform("l", lambda x: x["line"]), "\n")
    if draft and draft.strip():
        text = F.concat(text, F.lit(f"\n[Ви (Чернетка)]: {draft.strip()}"))
    return lines.select("conv_id", F.size("l").cast("bigint").alias("n_lines"), text.alias("history"))


HISTORY_PARTS = 32


def upsert_runs(run: DataFrame, path: str, key: str = "commit_id", order: str = "run_ms") -> None:
    """Write runs into the history at `path`: a run replaces the stored one with the same key, the others stay.

    The history is a folder of HISTORY_PARTS partitions by a hash of the key. Only partitions that hold a key of `run` are read and overwritten, each as
    a whole when the job commits, so writing the same run again, or a job that is run anew, changes nothing. Of several rows of one key in `run`
    the latest counts.
    """
    spark = run.sparkSession
    rest = [c for c in run.columns if c not in (key, order)]
    latest = run.groupBy(key).agg(F.max(F.struct(order, *rest)).alias("_s")).select(key, f"_s.{order}", *[f"_s.{c}" for c in rest])
    new = latest.withColumn("part", F.pmod(F.crc32(F.col(key).cast("string")), F.lit(HISTORY_PARTS)).cast("int")).select(*run.columns, "part")
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        new = stored(new)
        touched = [r[0] for r in new.select("part").distinct().collect()]  # at most HISTORY_PARTS numbers
        old = spark.read.schema(new.schema).parquet(path).filter(F.col("part").isin(touched))
        new = stored(union_all([old.join(new.select(key), key, "left_anti").select(*new.columns), new]))
    new.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)
