"""Jobs on written inputs, early failures, raw CSV text, streams above the broadcast limit, the model layer."""

import json
import os

import pytest

from conftest import SF001
from nichelab.operators import filters, raster, sampling
from nichelab.plans import environment, ml_ready, training
from nichelab.schemas import ML_READY_COLUMNS
from nichelab.sources import readers, sinks, tables
from nichelab.sources.tables import FIXTURE_RASTER as META


def _rows(df, cols):
    return sorted(map(repr, map(tuple, df.select(cols).collect())))


def test_unresolved_species_and_missing_layer_fail(spark):
    occ, taxa, cells, elev = tables.occurrences(spark, SF001), tables.taxon_matches(spark), tables.raster_cells(spark), tables.elevation_cells(spark)
    for taxon in (102, 999):
        with pytest.raises(filters.UnresolvedTaxonError):
            ml_ready.build_ml_ready(occ, taxa, cells, elev, META, taxon)
    short = cells.filter("var <> 12")
    with pytest.raises(FileNotFoundError, match="bio12"):
        ml_ready.build_ml_ready(occ, taxa, short, elev, META, 100)
    with pytest.raises(FileNotFoundError, match="bio12"):
        environment.extract_environment(tables.coordinate_requests(spark, SF001), short, elev, META)
    assert environment.extract_environment(tables.coordinate_requests(spark, SF001), short, elev, META, ["bio1"]).count() > 0


def test_taxon_lists_on_both_sides_of_the_limit(spark):
    occ = tables.occurrences(spark, SF001)
    twice = filters.resolve_taxon(tables.taxon_matches(spark).unionAll(tables.taxon_matches(spark)))
    a, b = filters.occurrences_of_taxa(occ, twice), filters.occurrences_of_taxa(occ, twice, max_broadcast=1)
    assert a.count() == a.select("key").distinct().count()
    assert _rows(a, ["key", "match_type"]) == _rows(b, ["key", "match_type"])
    assert _rows(filters.filter_taxa(occ, twice), ["key"]) == _rows(filters.filter_taxa(occ, twice, max_listed=1), ["key"])


def test_csv_text_has_empty_fields(spark, tmp_dir):
    row = {c: 1.5 for c in ML_READY_COLUMNS} | {"month": 3, "day_of_year": None, "elevation": None}
    schema = ", ".join(f"{c} {'int' if c in ('month', 'day_of_year') else 'double'}" for c in ML_READY_COLUMNS)
    sinks.write_ml_ready_csv(spark.createDataFrame([tuple(row[c] for c in ML_READY_COLUMNS)], schema), f"{tmp_dir}/csv")
    lines = {r["value"] for r in spark.read.text(f"{tmp_dir}/csv").collect()}
    header, line = sorted(lines, key=lambda x: not x.startswith("latitude"))
    fields = dict(zip(header.split(","), line.split(",")))
    assert "null" not in line and fields["elevation"] == "" and fields["day_of_year"] == "" and fields["bio1"] == "1.500000"


def test_ledger_prints_undefined_metrics_and_details(spark, tmp_dir):
    cols = ["accuracy", "auc", "f1_score", "sensitivity", "specificity", "average_precision"]
    m = spark.createDataFrame([(0.5, None, 0.0, 0.0, 1.0, None, 1, 2, 3, 4)], ", ".join(f"{c} double" for c in cols) + ", tn long, fp long, fn long, tp long")
    sinks.append_model_run(m, f"{tmp_dir}/led", "m", 0.5, "bio1=0.4", "depth 3")
    text = sinks.ledger_text(spark.read.parquet(f"{tmp_dir}/led")).first()["report"]
    assert "**ROC AUC**: n/a" in text and "**Top Features**: bio1=0.4" in text and "**Model Details**: depth 3" in text and "null" not in text


def test_stream_above_the_broadcast_limit(spark, tmp_dir):
    """The same rows as the batch job whatever the raster's size."""
    from nichelab.streaming import enrich

    src = f"{tmp_dir}/occ"
    tables.occurrences(spark, SF001).repartition(3).write.parquet(src)
    cells, elev = tables.raster_cells(spark), tables.elevation_cells(spark)
    stream = enrich.enrich(enrich.occurrence_stream(spark, src), cells, elev, META, broadcast_limit=0)
    enrich.start(stream, f"{tmp_dir}/out", f"{tmp_dir}/ck").awaitTermination()
    batch = enrich.enrich(readers.read_occurrences(spark, src), cells, elev, META)
    got = spark.read.parquet(f"{tmp_dir}/out")
    assert got.count() > 0 and _rows(got, batch.columns) == _rows(batch, batch.columns)


def test_pushdown_reaches_an_occurrence_folder(spark, tmp_dir):
    src = f"{tmp_dir}/occ"
    tables.occurrences(spark, SF001).write.parquet(src)
    recs = ml_ready.species_records(readers.read_occurrences(spark, src), tables.taxon_matches(spark), 100, country="ZA")
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    plan = recs.select("key")._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = plan.split("PushedFilters: [")[1].split("], ReadSchema")[0]
    for part in ("EqualTo(country,ZA)", "EqualTo(taxonKey,100)", "EqualTo(occurrenceStatus,PRESENT)", "coordinateUncertaintyInMeters"):
        assert part in pushed


def test_strict_requests_and_elevation_job(spark):
    req = spark.createDataFrame([(1, 10.0, 10.0), (2, 95.0, 10.0)], "pos long, latitude double, longitude double")
    with pytest.raises(ValueError):
        filters.validate_coordinates(req, strict=True)
    out = environment.extract_elevation(req, tables.elevation_cells(spark, None, tables.FINE_ELEVATION), tables.FINE_ELEVATION)
    assert {r["pos"]: r["status"] for r in out.collect()} == {1: "ok", 2: "Invalid coordinates"}


def test_layer_nodata(spark):
    meta = tables.RasterMeta.from_dict({"left": 0, "top": 1, "res": 1, "n_rows": 1, "n_cols": 1, "nodata": -1, "layer_nodata": {"12": -2}})
    cells = spark.createDataFrame([(1, 0, 0, -1.0), (12, 0, 0, -1.0), (13, 0, 0, -2.0), (14, 0, 0, -1.0)], "var int, row_id int, col_id int, value float")
    got = {r["var"]: r["value"] for r in raster.clean_cells(cells, meta).collect()}
    assert got == {1: None, 12: -1.0, 13: -2.0, 14: None}
    assert tables.RasterMeta.global_grid(10).n_cols == 2160


def test_jobs_on_written_files(spark, tmp_dir):
    """The command line on files of one's own, elevation at another resolution, raster long and stored wide."""
    from nichelab.__main__ import main

    p = lambda n: os.path.join(tmp_dir, n)
    tables.occurrences(spark, SF001).write.json(p("occ"))
    tables.taxon_matches(spark).write.json(p("taxa"))
    sinks.write_raster_cells(tables.raster_cells(spark), p("raster"))
    tables.elevation_cells(spark, None, tables.FINE_ELEVATION).write.parquet(p("elev"))
    for name, m in (("meta.json", META), ("elev.json", tables.FINE_ELEVATION)):
        with open(p(name), "w") as f:
            json.dump({k: getattr(m, k) for k in ("left", "top", "res", "n_rows", "n_cols", "nodata")}, f)
    files = ["--occurrences", p("occ"), "--format", "json", "--taxa", p("taxa"), "--raster-meta", p("meta.json"), "--elevation", p("elev"), "--elevation-meta", p("elev.json")]
    main(["ml-ready", "--out", p("a"), "--raster", p("raster"), *files])
    main(["store-raster", "--raster", p("raster"), "--raster-meta", p("meta.json"), "--out", p("wide")])
    main(["ml-ready", "--out", p("b"), "--wide-raster", p("wide"), *files])
    read = lambda x: spark.read.option("header", True).csv(p(f"{x}/global_training_ml_ready"))
    assert read("a").count() > 0 and _rows(read("a"), ML_READY_COLUMNS) == _rows(read("b"), ML_READY_COLUMNS)
    direct = ml_ready.build_ml_ready(
        tables.occurrences(spark, SF001), tables.taxon_matches(spark), tables.raster_cells(spark),
        tables.elevation_cells(spark, None, tables.FINE_ELEVATION), META, 100, elev_meta=tables.FINE_ELEVATION,
    )
    assert _rows(read("a"), ML_READY_COLUMNS) == _rows(sinks.ml_ready_text(direct), ML_READY_COLUMNS)
    with pytest.raises(SystemExit):
        main(["ml-ready", "--out", p("c")])


def _toy(spark, n=400):
    """Rows whose label follows bio1, with some noise."""
    row = lambda k: (k, float(k % 90), float(k % 180), 100.0, float(k % 40), int((k % 40) + (k * 7919 % 13) > 26))
    df = spark.createDataFrame([row(k) for k in range(n)], "key long, latitude double, longitude double, elevation double, bio1 double, presence int")
    return df


def test_training_learns_and_reports(spark):
    """A floor for the fit, absent feature columns, a caller's settings, and the fallback to the training rows."""
    toy = _toy(spark)
    settings = [{"maxDepth": 2, "stepSize": 0.2}, {"maxDepth": 3}]
    tuned = training.tune_gbt(toy, max_iter=5, settings=settings)
    assert tuned.settings == settings and len(tuned.avgMetrics) == 2 and max(tuned.avgMetrics) > 0.85
    res = training.train_and_evaluate(toy, None, tuned=tuned)
    row = res.summary.first()
    assert row["training_rows"] == row["validation_rows"] == 400 and row["auc"] > 0.9
    assert row["top_features"].startswith("bio1=") and row["top_features"].count("=") == 10
    assert training.score(tuned.bestModel, toy.drop("elevation")).count() == 400
    res.scored.unpersist()


def test_fits_side_by_side_share_the_cores(spark, monkeypatch):
    """Six fits at a time on four cores: each reads the rows in one partition, the last fit in four; no row is left out."""
    seen, fit = [], training.Pipeline.fit

    def recorded(self, df):
        seen.append((df.rdd.getNumPartitions(), df.count()))
        return fit(self, df)

    monkeypatch.setattr(training, "ROWS_PER_TASK", 50)
    monkeypatch.setattr(training.Pipeline, "fit", recorded)
    toy = _toy(spark)
    tuned = training.tune_gbt(toy, max_iter=2)
    n_train = toy.filter(sampling.split_label("key") == "train").count()
    assert len(seen) == 7 and [n for n, _ in seen] == [1] * 6 + [4]
    assert sum(n for _, n in seen[:6]) == 2 * 2 * n_train and seen[6][1] == 400
    assert min(tuned.avgMetrics) > 0.85


def test_partition_count_has_no_step():
    counts = [training.partition_count(n, 8) for n in (1, 20_000, 20_001, 90_000, 838_860, 838_861, 10**8)]
    assert counts == [1, 1, 2, 5, 8, 8, 120]
    assert len(training.wide_grid()) == 216


def test_fold_auc_per_model(spark):
    rows = [("a", k, (k % 10) / 10, int(k % 10 > 4)) for k in range(200)] + [("b", k, 0.5, k % 2) for k in range(200)]
    got = {r["model"]: r for r in training.fold_mean_auc(spark.createDataFrame(rows, "model string, key long, risk double, label int")).collect()}
    assert got["a"]["mean_auc"] == 1.0 and got["b"]["mean_auc"] == 0.5 and got["a"]["n_folds"] == 3


def test_short_elevation_reply(spark):
    req = spark.createDataFrame([(0, 10, 1.0, 2.0), (0, 11, 3.0, 4.0), (1, 12, 5.0, 6.0)], "batch long, pos long, latitude double, longitude double")
    text = json.dumps({"status": "OK", "results": [{"elevation": 7.0, "location": None}]})
    rep = spark.createDataFrame([(0, text), (1, json.dumps({"status": "INVALID", "results": []}))], "batch long, response string")
    got = {r["pos"]: (r["latitude"], r["elevation"], r["dataset"], r["status"]) for r in readers.elevation_results(rep, req).collect()}
    assert got == {10: (1.0, 7.0, "srtm30m", "ok"), 11: (3.0, None, None, "missing_result"), 12: (5.0, None, None, "missing_result")}


def test_file_stamps_follow_the_files(spark, tmp_dir):
    spark.range(5).write.parquet(f"{tmp_dir}/orders.parquet")
    a = tables.file_stamps(spark, tmp_dir, "orders")
    assert a == tables.file_stamps(spark, tmp_dir, "orders")
    spark.range(9).write.mode("overwrite").parquet(f"{tmp_dir}/orders.parquet")
    assert a != tables.file_stamps(spark, tmp_dir, "orders")
