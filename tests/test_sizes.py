import pytest
from codeweave.plans.materialise import BROADCAST_BYTES, cut, join_by_rows
from pyspark.sql import functions as F


@pytest.mark.parametrize("limit", ["10MB", "10485760b", "-1", "1k"])
def test_small_files_of_many_rows_are_not_broadcast(spark, limit):
    static, adaptive = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    before = spark.conf.get(static)
    try:
        spark.conf.set(static, limit)
        spark.conf.unset(adaptive)
        join_by_rows(spark)
        if limit in ("-1", "1k"):
            assert spark.conf.get(static) == limit
        else:
            assert spark.conf.get(static) == str(BROADCAST_BYTES) and spark.conf.get(adaptive) == limit
            # 2 MB of files, 60 MB of names
            names = cut(spark.range(600_000).select(F.col("id"), F.concat(F.lit("svc/a/long/folder/of/the/web/shop/Part"), "id", F.lit(".cs::Load")).alias("name")))
            plan = names.join(names.withColumnRenamed("name", "other"), "id")._jdf.queryExecution().executedPlan().toString()
            assert "Broadcast" not in plan
    finally:
        spark.conf.set(static, before)
        spark.conf.unset(adaptive)


def test_needles_of_numbers_meet_few_texts(spark):
    """By four digits each of these needles would meet many texts; longer grams leave about one."""
    from codeweave.plans.containment import containing

    needles = spark.range(3000).select(F.lit("w").alias("workspace_id"), F.concat(F.lit("list"), F.lit(1_000_000) + F.col("id") * 7, F.lit("x")).alias("needle"))
    texts = needles.select("workspace_id", F.concat(F.lit("web/"), "needle", F.lit(".ts")).alias("text"))
    found = containing(needles, texts)
    assert found.count() == 3000
    short = containing(needles.limit(1).select("workspace_id", F.explode(F.array(*[F.lit(x) for x in ("", "w", "eb", "b/l", "zz", "list")])).alias("needle")), texts)
    assert {r.needle: r["count"] for r in short.groupBy("needle").count().collect()} == {x: 3000 for x in ("w", "eb", "b/l", "list")}


def test_extraction_is_cut_by_the_size_of_the_text(spark, monkeypatch):
    """Like files compress to almost nothing, and would be put together in one task."""
    from codeweave.operators import extract

    monkeypatch.setattr(extract, "TASK_CHARACTERS", 1 << 12)
    text = "CREATE TABLE dbo.T (a int);\n" * 10
    files = spark.range(200).select(F.lit("w").alias("workspace_id"), F.concat(F.lit("sql/t"), "id", F.lit(".sql")).alias("relative_path"), F.lit(text).alias("content"))
    symbols, _ = extract.extract_evidence(files, {(".sql",): extract.extract_sql})
    assert symbols.count() == 2000
    assert symbols.select(F.spark_partition_id().alias("p")).distinct().count() > 8


def test_rules_of_numbers_meet_few_paths(spark):
    """By three characters each of these rules would be tried on many paths; longer grams leave about one."""
    from codeweave.sources import files as sources

    n = F.lit(1_000_000) + F.col("id") * 7
    rules = spark.range(3000).select(F.lit("w").alias("workspace_id"), F.concat(F.lit("lib"), n, F.lit("/v.*")).alias("pattern"), F.concat(F.lit("lib"), n, F.lit("/v")).alias("literal"), F.lit(12).alias("size"), F.lit(False).alias("dirs_only"), F.lit(False).alias("anchored"))
    texts = spark.range(3000).select(F.lit("w").alias("workspace_id"), F.concat(F.lit("lib"), n, F.lit("/v1")).alias("text"))
    assert sources.rules_met(rules, texts).count() == 3000
    held = spark.range(3000).select(F.lit("w").alias("workspace_id"), F.concat(F.lit("lib"), n, F.lit("/v?")).alias("rule"))
    paths = spark.range(3001).select(F.lit("w").alias("workspace_id"), F.concat(F.lit("lib"), n, F.lit("/v1/a.cs")).alias("relative_path"))
    assert [r.relative_path for r in sources.apply_ignore_rules(paths, held).collect()] == ["lib1021000/v1/a.cs"]


def test_statements_are_dealt_by_the_size_of_the_text(spark, monkeypatch):
    """Statements of like files compress to almost nothing too: behind the Python that folds them, Spark put them together."""
    from codeweave.operators import extract

    monkeypatch.setattr(extract, "TASK_CHARACTERS", 1 << 12)
    text = "public class T { public void M() { } }\n" * 10
    files = spark.range(200).select(F.lit("w").alias("workspace_id"), F.concat(F.lit("src/t"), "id", F.lit(".cs")).alias("relative_path"), F.lit(text).alias("content"))
    dealt = []
    monkeypatch.setattr(extract, "cut", lambda df: dealt.append(df) or df)
    extract.extract_evidence(files, {(".cs",): extract.extract_cs})
    assert dealt[0].where("type_name is not null or method_name is not null").count() == 4000
    assert dealt[0].select(F.spark_partition_id().alias("p")).distinct().count() > 8


def test_parts_are_dealt_before_they_become_files(spark, tmp_path):
    """A small table of keys is read in one task, but each key becomes files."""
    from codeweave.plans import corpus

    spark.range(200).select(F.col("id").alias("p_partkey"), F.lit("Brand#1").alias("p_brand"), F.lit(1).alias("p_size"), F.lit("x").alias("p_name")).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    for made in (corpus.part_corpus, corpus.wrapped_corpus, corpus.other_corpus):
        files = made(spark, str(tmp_path))
        assert files.select(F.spark_partition_id()).distinct().count() >= spark.sparkContext.defaultParallelism


def test_sql_behind_the_last_object_is_read_once(spark):
    """From each of 300 000 places the rest of the file was looked through."""
    import time

    from codeweave.operators import extract

    text = "CREATE TABLE dbo.A (x int)\nCREATE\n  VIEW dbo.B AS " + "SELECT x, y\n" * 25_000
    files = spark.createDataFrame([("w", "a.sql", text)], "workspace_id string, relative_path string, content string")
    begin = time.time()
    symbols, _ = extract.extract_sql(files)
    assert sorted((r.name, r.kind, r.line, r.col) for r in symbols.collect()) == [("A", "table", 1, 14), ("B", "view", 3, 8)]
    assert time.time() - begin < 60
