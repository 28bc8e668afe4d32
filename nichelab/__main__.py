"""Command line: ``python -m nichelab {ml-ready,train,risk-map,store-raster} ... --out DIR``.

Inputs are either files of one's own (``--occurrences``, ``--taxa``, ``--raster``
or ``--wide-raster`` with ``--raster-meta``, ``--elevation`` with
``--elevation-meta``) or, with ``--input SF_DIR``, the driver's tables through the
views of ``sources.tables``.  Geometry files are JSON (see
``RasterMeta.from_dict``).  The master and partition count come from
``spark-submit`` / the environment (see ``session.build_session``).
"""

from __future__ import annotations

import argparse
import json
import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


def _session() -> SparkSession:
    from nichelab.session import build_session

    return build_session()


@dataclass
class Inputs:
    """The relations a job reads, from files or from the driver's tables."""

    occurrences: DataFrame | None
    taxa: DataFrame | None
    cells: DataFrame | None
    wide: DataFrame | None
    meta: object
    elevation: DataFrame
    elevation_meta: object


def _meta(spark: SparkSession, path: str):
    """Geometry read through Spark, so that it may lie in any store."""
    from nichelab.sources.tables import RasterMeta

    return RasterMeta.from_dict(json.loads("\n".join(r["value"] for r in spark.read.text(path).collect())))


def read_inputs(spark: SparkSession, args) -> Inputs:
    from nichelab.schemas import ELEV_CELL, TAXON
    from nichelab.sources import readers, tables

    own_raster = args.raster or args.wide_raster
    if not own_raster and args.input is None and args.cmd != "risk-map":
        raise SystemExit("give --input, or --occurrences, --taxa, --raster and --elevation")
    if own_raster and not (args.raster_meta and args.elevation):
        raise SystemExit("--raster needs --raster-meta and --elevation")
    occ = taxa = None
    if getattr(args, "occurrences", None):
        occ = readers.read_occurrences(spark, args.occurrences, args.format)
        taxa = spark.read.schema(TAXON).json(args.taxa) if args.taxa else None
        if taxa is None:
            raise SystemExit("--occurrences needs --taxa")
    elif args.input:
        occ, taxa = tables.occurrences(spark, args.input), tables.taxon_matches(spark)
    if not own_raster:
        m = tables.FIXTURE_RASTER
        return Inputs(occ, taxa, tables.raster_cells(spark), None, m, tables.elevation_cells(spark), m)
    meta = _meta(spark, args.raster_meta)
    return Inputs(
        occ,
        taxa,
        readers.read_raster_cells(spark, args.raster) if args.raster else None,
        readers.read_wide_cells(spark, args.wide_raster) if args.wide_raster else None,
        meta,
        spark.read.schema(ELEV_CELL).parquet(args.elevation),
        _meta(spark, args.elevation_meta) if args.elevation_meta else meta,
    )


def _ml_ready(inputs: Inputs, taxon: int, country: str | None = None, max_records: int | None = None, keep_key: bool = True) -> DataFrame:
    from nichelab.plans import ml_ready

    return ml_ready.build_ml_ready(
        inputs.occurrences, inputs.taxa, inputs.cells, inputs.elevation, inputs.meta, taxon,
        country=country, max_records=max_records, keep_key=keep_key, elev_meta=inputs.elevation_meta, wide=inputs.wide,
    )


def cmd_ml_ready(args) -> None:
    from nichelab.sources import sinks

    spark = _session()
    inputs = read_inputs(spark, args)
    for name, country, limit in (("global_training_ml_ready", None, args.max_global), ("local_validation_ml_ready", args.country, args.max_local)):
        df = _ml_ready(inputs, args.taxon, country, limit, keep_key=False)
        sinks.write_ml_ready_csv(df, os.path.join(args.out, name))
    print(json.dumps({"written": args.out}))


def cmd_train(args) -> None:
    from nichelab.plans import ml_ready, training
    from nichelab.sources import sinks

    spark = _session()
    inputs = read_inputs(spark, args)
    g, loc = _ml_ready(inputs, args.taxon), _ml_ready(inputs, args.taxon, args.country)
    train, val = training.prepare_training(ml_ready.rounded(g), ml_ready.rounded(loc))
    settings = training.wide_grid() if args.wide_grid else None
    tuned = training.tune_gbt(train, max_iter=args.max_iter, settings=settings) if settings else None
    res = training.train_and_evaluate(train, val, limit_rows=args.limit_rows, max_iter=args.max_iter, tuned=tuned)
    training.save_model(res.model, os.path.join(args.out, "model"))
    sinks.save_threshold(spark, res.threshold, os.path.join(args.out, "threshold"))
    best = max(zip(res.model.avgMetrics, map(json.dumps, res.model.settings)))[1]
    summary = res.summary.first().asDict()
    sinks.append_model_run(
        res.metrics.drop("threshold"), os.path.join(args.out, "model_runs"), "boosted_trees", res.threshold, summary["top_features"], best
    )
    res.scored.unpersist()
    print(json.dumps(summary, default=str))


def cmd_risk_map(args) -> None:
    from nichelab.operators import grid
    from nichelab.plans import risk_map, training
    from nichelab.sources import sinks

    spark = _session()
    bounds = grid.region_bounds(args.region, args.lat_min, args.lat_max, args.lon_min, args.lon_max)
    inputs = read_inputs(spark, args)
    model = training.load_model(args.model)
    rm = risk_map.model_risk_map(
        spark, model, inputs.cells, inputs.elevation, inputs.meta, n=args.grid_size, month=args.month, bounds=bounds,
        elev_meta=inputs.elevation_meta, wide=inputs.wide,
    )
    rm.scored.cache()
    out = risk_map.outputs(rm)
    sinks.write_geojson_lines(out["cells"], os.path.join(args.out, "cells_geojson"))
    sinks.write_feature_collections(out["cells"], os.path.join(args.out, "cells_documents"))
    summary = out["summary"].first().asDict()
    rm.scored.unpersist()
    print(json.dumps(summary, default=str))


def cmd_store_raster(args) -> None:
    """Pivot a long cell table, or a folder of raster files, once; the other commands then take it with --wide-raster.
    With --tile, packed tiles are stored instead (for ``extract_environment``)."""
    from nichelab.operators import raster, tiles
    from nichelab.schemas import CLIMATE_VARIABLES
    from nichelab.sources import rasterfile, readers, sinks

    spark = _session()
    if args.raster_files:
        cells, meta = rasterfile.read_raster_files(spark, args.raster_files), rasterfile.raster_files_meta(args.raster_files)
    else:
        cells, meta = readers.read_raster_cells(spark, args.raster), _meta(spark, args.raster_meta)
    raster.require_layers(cells, CLIMATE_VARIABLES)
    if args.tile:
        tiles.pack_layers(cells, tile=args.tile).write.mode("overwrite").parquet(args.out)
    else:
        sinks.write_wide_cells(raster.widen_cells(cells, meta), args.out)
    print(json.dumps({"written": args.out}))


def _add_inputs(p: argparse.ArgumentParser, occurrences: bool) -> None:
    p.add_argument("--input", help="folder of the driver's tables")
    p.add_argument("--raster", help="long climate cells (parquet, partitioned by var)")
    p.add_argument("--wide-raster", help="stored wide climate cells (see store-raster)")
    p.add_argument("--raster-meta", help="geometry of the climate raster (JSON)")
    p.add_argument("--elevation", help="elevation cells (parquet)")
    p.add_argument("--elevation-meta", help="geometry of the elevation raster (JSON; default: the climate raster's)")
    if occurrences:
        p.add_argument("--occurrences", help="folder of occurrence files")
        p.add_argument("--format", default="parquet", choices=["parquet", "json", "csv", "tsv"])
        p.add_argument("--taxa", help="name matches (JSON lines)")
        p.add_argument("--taxon", type=int, default=100)
        p.add_argument("--country", default="ZA", help="country code of the local table")


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="nichelab")
    sub = p.add_subparsers(dest="cmd", required=True)
    a = sub.add_parser("ml-ready", help="write the global and local model-ready CSV folders")
    a.add_argument("--out", required=True)
    _add_inputs(a, occurrences=True)
    a.add_argument("--max-global", type=int, default=None)
    a.add_argument("--max-local", type=int, default=None)
    a.set_defaults(fn=cmd_ml_ready)
    t = sub.add_parser("train", help="grid search, refit, evaluate; save model, threshold and a ledger row")
    t.add_argument("--out", required=True)
    _add_inputs(t, occurrences=True)
    t.add_argument("--wide-grid", action="store_true", help="search the 216 settings of the wider grid")
    t.add_argument("--limit-rows", type=int, default=0)
    t.add_argument("--max-iter", type=int, default=100)
    t.set_defaults(fn=cmd_train)
    r = sub.add_parser("risk-map", help="score a region grid with a saved model; write GeoJSON cells and a summary")
    r.add_argument("--model", required=True)
    r.add_argument("--out", required=True)
    _add_inputs(r, occurrences=False)
    r.add_argument("--region", default="western_cape")
    r.add_argument("--lat-min", type=float)
    r.add_argument("--lat-max", type=float)
    r.add_argument("--lon-min", type=float)
    r.add_argument("--lon-max", type=float)
    r.add_argument("--grid-size", type=int, default=50)
    r.add_argument("--month", type=int, default=1)
    r.set_defaults(fn=cmd_risk_map)
    w = sub.add_parser("store-raster", help="pivot a long cell table once into a stored wide table")
    kind = w.add_mutually_exclusive_group(required=True)
    kind.add_argument("--raster", help="long climate cells (parquet, partitioned by var); needs --raster-meta")
    kind.add_argument("--raster-files", help="folder of TIFF layers")
    w.add_argument("--raster-meta")
    w.add_argument("--tile", type=int, default=0, help="store packed tiles of so many rows and columns")
    w.add_argument("--out", required=True)
    w.set_defaults(fn=cmd_store_raster)
    args = p.parse_args(argv)
    args.fn(args)


if __name__ == "__main__":
    main()
