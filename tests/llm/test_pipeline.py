from pyspark.sql import functions as F

import corpus_pipeline as C
from silvaspan.llm import language_id
from tests.llm.test_decontamination import plain as plain_overlaps
from tests.llm.test_minhash_dedup import plain_least
from tests.llm.test_mixing import plain_targets

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra array<int>"


def raw_rows(spark):
    raw = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leak = "Some words before. " + items[0][1] + " and words behind"
    raw += [(9001, None, "en", "src1", 0), (9002, "12 34 %%", "en", None, 8), (9003, leak, "en", None, len(leak)), (9004, raw[3][1], "en", "src0", 1), (raw[5][0], *raw[5][1:])]
    # Ids that repeat with other texts, and rows without ids: each is judged for itself.
    raw += [(raw[20][0], "The " + raw[30][1] + " and nothing else", "en", "src1", 5), (None, raw[40][1] + " with an end of its own", "en", "src2", 5), (None, raw[41][1][::-1] + " the and that", "en", "src2", 5), (None, "Other words come first here. " + items[1][1] + " with an end of its own", "en", "src2", 5)]
    raw += [(9010, (raw[50][1] + " ") * 400, raw[50][2], "src3", 9)]
    return [(*r, [1]) for r in raw], items


def test_stages_equal_plain_versions(spark):
    raw, items = raw_rows(spark)
    docs = spark.createDataFrame(raw, SCHEMA)
    by_language = C.keep_known_languages(spark, docs, SF)
    assert by_language.columns == docs.columns
    rows = [tuple(r) for r in by_language.collect()]
    gone = [r for r in raw if r not in rows]
    assert {9001, 9002} <= {r[0] for r in gone} and len(gone) < 5
    model = language_id.learn(docs.select("doc_id", "text", "lang"))
    assert all(not r[1] or not language_id.has_letter(r[1].encode()) or language_id.claim(model, r[1].encode()) < model.least for r in gone)

    deduped = C.drop_near_duplicates(spark, by_language, SF)
    assert deduped.columns == docs.columns
    least = plain_least([(k, r[1]) for k, r in enumerate(rows)])
    groups = {}
    for r, c in zip(rows, least):
        groups.setdefault(c, []).append(r)
    got = [tuple(r) for r in deduped.collect()]
    assert len(got) == len(groups) and all(sum(r in own for r in got) == 1 for own in groups.values() if len({str(r) for r in own}) == len(own))
    for own in groups.values():
        ids = [r[0] for r in own if r[0] is not None]
        kept = [r for r in got if r in own]
        assert kept and all(r[0] == (min(ids) if ids else None) for r in kept)

    clean = C.drop_benchmark_leaks(spark, deduped, SF)
    leaks = {k for k, _ in plain_overlaps([(k, r[1]) for k, r in enumerate(got)], items)}
    assert clean.columns == docs.columns and any(r[0] is None for k, r in enumerate(got) if k in leaks)
    left = [r for k, r in enumerate(got) if k not in leaks]
    assert sorted(map(str, (tuple(r) for r in clean.collect()))) == sorted(map(str, left))

    mixed = [r.asDict() for r in C.mix_sources(spark, clean, SF).collect()]
    sizes, taken, most = {}, {}, {}
    for r in left:
        n = len(r[1].split())
        sizes[r[3]], most[r[3]] = sizes.get(r[3], 0) + n, max(n, most.get(r[3], 0))
    for r in mixed:
        assert 1 <= r["copies"] <= 3 and r["taken"] == r["copies"] * len(r["text"].split())
        assert tuple(r[c] for c in docs.columns) in left
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    assert len({str(r) for r in mixed}) == len(mixed)
    for s, target in plain_targets(sizes).items():
        assert abs(taken.get(s, 0) - target) <= most[s]


def test_rows_without_near_copies_stay_whatever_their_ids(spark):
    """Unrelated texts of one id, or of none, all stay; a near copy goes although its id repeats with another text."""
    words = [" ".join(f"w{k}x{j}" for j in range(60)) for k in range(8)]
    rows = [(5, words[0]), (5, words[1]), (None, words[2]), (None, words[3]), (1, words[4]), (7, words[4] + " more"), (7, words[5]), (8, words[6]), (8, words[6])]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, [2]) for i, t in rows], SCHEMA)
    got = sorted((str(r["doc_id"]), r["text"]) for r in C.drop_near_duplicates(spark, docs, SF).collect())
    assert got == sorted((str(i), t) for i, t in {*rows} - {(7, words[4] + " more")})


def test_clashing_names_and_reruns(spark):
    raw, _ = raw_rows(spark)
    docs = spark.createDataFrame(raw[:60] + raw[:3] * 2, SCHEMA).withColumn("again", F.lit("x")).withColumn("key", F.lit(1)).withColumn("row", F.lit(2)).withColumn("a.b", F.lit(3)).withColumn("m", F.create_map(F.lit("k"), F.lit(1)))
    for stage in (C.keep_known_languages, C.drop_near_duplicates, C.drop_benchmark_leaks):
        kept = stage(spark, docs, SF)
        assert kept.columns == docs.columns and 0 < kept.count() <= 66
    clash = docs.withColumn("copies", F.lit("x")).withColumn("taken", F.lit("x"))
    a, b = (C.mix_sources(spark, df, SF) for df in (clash.repartition(3), clash.repartition(7, "doc_id")))
    assert sorted(a.columns) == sorted(clash.columns) and sorted(map(str, a.select("doc_id", "copies", "taken").collect())) == sorted(map(str, b.select("doc_id", "copies", "taken").collect()))


def test_run_on_an_empty_table(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert C.run(spark, str(tmp_path)).count() == 0
