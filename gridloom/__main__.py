"""Command line: python -m gridloom SCHEMA TASK ... runs one task on the tables of a study area.

Tables are kept in the session's catalogue; between calls they stay only where that is a lasting one (a metastore).
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame

from .functions.translate import Translation
from .operators import calibrate, consolidate, disaggregate, features, grid, models, neighbourhood, transfer, validate, wrangle
from .plans.tasks import load_tasks, run_tasks
from .runtime import session
from .sources.layers import import_layer, property_columns, read_geojson
from .sources.osm import extract_layers, load_config
from .sources.osm import features as osm_features
from .sources.osm import read as read_osm
from .sources.raster import read_bands
from .sources.tables import read_table
from .workspace import NEIGHBOURHOOD, TARGET, Workspace

WIDE, CONDITION = "all_feats", "condition"
TASKS: dict[str, tuple[Callable, list[tuple[tuple, dict]]]] = {}


def arg(*names: str, **options) -> tuple[tuple, dict]:
    return names, options


def flag(*names: str) -> tuple[tuple, dict]:
    return arg(*names, action="store_true")


def task(name: str, *arguments: tuple[tuple, dict]):
    def register(f: Callable) -> Callable:
        TASKS[name] = f, list(arguments)
        return f

    return register


def _conditioned(space: Workspace) -> DataFrame | None:
    return space.read(CONDITION) if space.exists(CONDITION) else None


def _area(space: Workspace, wanted: bool) -> tuple[float, float, float, float] | None:
    row = space.read("extent").first() if wanted else None
    return tuple(row[c] for c in ("x0", "y0", "x1", "y1")) if row else None


@task("init")
def init(space, a):
    """Create the study area's database."""
    space.init()


@task("extent", arg("table"))
def extent(space, a):
    """The area covered by a layer's polygons."""
    space.write(grid.extent(space.read(a.table)), "extent", a.overwrite)


@task("grid", arg("-g", "--grid-name", default="grid"), arg("-s", "--cellsize", type=float, default=grid.CELL), arg("-x", "--xoffset", type=float, default=0.0), arg("-y", "--yoffset", type=float, default=0.0))
def make(space, a):
    """Square cells over the extent."""
    area = space.read("extent")
    space.write(grid.make_grid(_area(space, True), a.cellsize, a.xoffset, a.yoffset, spark=space.spark, inside=grid.inside_extent(area), srid=space.srid("extent") or 0), a.grid_name, a.overwrite, "geohash")


@task("condition", arg("table"), arg("expression", nargs="?"))
def condition(space, a):
    """Cells that a feature which satisfies the expression touches."""
    space.write(features.condition(space.read("grid"), space.read(a.table), a.expression), CONDITION, a.overwrite, "geohash")


@task("features", arg("table"), arg("method", nargs="+"), arg("-s", "--source-field", nargs="+"), arg("-c", "--case-field"))
def calculate(space, a):
    """Features of the cells from a layer."""
    return run_tasks(space, [{"table": a.table, "method": a.method, "source": a.source_field, "case": a.case_field}], a.overwrite)


@task("features-by-file", arg("file"))
def calculate_by_file(space, a):
    """Features for all tasks of a JSON file."""
    return run_tasks(space, load_tasks(a.file), a.overwrite)


@task("target", arg("table"), arg("source_field"), arg("-t", "--target-table"), flag("-r", "--relative"))
def target(space, a):
    """A layer's values by cell, to learn from."""
    space.write(features.target(space.read("grid"), space.read(a.table), a.source_field, a.relative), a.target_table or TARGET + a.table, a.overwrite, "geohash")


@task("neighbourhood", arg("multiplier", nargs="+", type=float))
def around(space, a):
    """Gaussian averages of all features, for each width in cells."""
    for name, df in space.features(neighbourhood=False).items():
        columns = [c for c in df.columns if c not in (consolidate.KEY, *consolidate.PLACE)]
        for column, made in neighbourhood.neighbourhood(df, columns, a.multiplier).items():
            space.write(made, f"{NEIGHBOURHOOD}{consolidate.column_name(name, column)}", a.overwrite, "geohash")


@task("list")
def listed(space, a):
    """All feature columns."""
    return consolidate.feature_list(space.features(), space.spark)


@task("clear")
def clear(space, a):
    """Drop all feature tables."""
    return space.clear_features()


@task("consolidate")
def consolidated(space, a):
    """All features in one wide table."""
    space.write(consolidate.consolidate(space.features(), _conditioned(space)), WIDE, a.overwrite, "geohash")


@task("recategorize", arg("table"), arg("source_field"), arg("target_field"), arg("translation"))
def recategorise(space, a):
    """Add a translated column to a layer."""
    space.update(a.table, wrangle.recategorise(space.read(a.table), a.source_field, a.target_field, Translation.load(a.translation)))


@task("shape", arg("table"))
def shape(space, a):
    """Add shape columns to a layer of polygons."""
    space.update(a.table, wrangle.shape_metrics(space.read(a.table)))


@task("fix", arg("table"))
def fix(space, a):
    """Make a layer's polygons valid."""
    space.update(a.table, wrangle.fix_geometries(space.read(a.table)))


@task("dissolve", arg("source_table"), arg("target_table"), arg("-k", "--key", default="id"))
def dissolve(space, a):
    """Connected parts of a layer of polygons."""
    space.write(wrangle.dissolve(space.read(a.source_table), a.key), a.target_table, a.overwrite)


_SPREAD = arg("disag_table"), arg("disag_field"), arg("weight_table"), arg("output_table"), flag("-r", "--relative")


@task("disaggregate", *_SPREAD, arg("-f", "--weight-field", default="weight"))
def spread(space, a):
    """Spread polygons' totals over the grid."""
    space.write(disaggregate.disaggregate(space.read("grid"), space.read(a.disag_table), a.disag_field, space.read(a.weight_table), a.weight_field, a.relative), a.output_table, a.overwrite, "geohash")


@task("disaggregate-batch", *_SPREAD)
def spread_batch(space, a):
    """Spread polygons' totals over the grid by every weight column."""
    space.write(disaggregate.disaggregate_batch(space.read("grid"), space.read(a.disag_table), a.disag_field, space.read(a.weight_table), relative=a.relative), a.output_table, a.overwrite, "geohash")


@task("disaggregate-raw", arg("disag_table"), arg("weight_table"), arg("output_table"), arg("-d", "--disag-field", nargs="+", required=True), arg("-f", "--weight-field", nargs="+", required=True), flag("-k", "--keep-unweighted"), flag("-r", "--relative"))
def spread_raw(space, a):
    """Spread polygons' totals over other polygons."""
    space.write(disaggregate.disaggregate_raw(space.read(a.disag_table), a.disag_field, space.read(a.weight_table), a.weight_field, a.keep_unweighted, a.relative), a.output_table, a.overwrite)


@task("transfer-table", arg("from_table"), arg("from_id"), arg("to_table"), arg("to_id"), arg("aux_table"), arg("output_table"), arg("-d", "--density-field", default="weight"), arg("-v", "--value-table"), arg("-k", "--geometry-id", default="geohash"), arg("-K", "--value-id", default="geohash"))
def transfer_table(space, a):
    """Shares of source polygons' mass that lie in target polygons."""
    values = space.read(a.value_table) if a.value_table else None
    space.write(transfer.transfer_weights(space.read(a.from_table), a.from_id, space.read(a.to_table), a.to_id, space.read(a.aux_table), a.density_field, values, a.geometry_id, a.value_id), a.output_table, a.overwrite)


@task("apply-transfer", arg("from_table"), arg("from_id"), arg("value_field"), arg("to_table"), arg("to_id"), arg("transfer_table"), arg("output_table"))
def apply_transfer(space, a):
    """Source polygons' values on target polygons, by a transfer table."""
    space.write(transfer.apply_transfer(space.read(a.from_table), a.from_id, a.value_field, space.read(a.to_table), a.to_id, space.read(a.transfer_table)), a.output_table, a.overwrite)


@task("merge", arg("schemas", nargs="+"), arg("-t", "--target-table", nargs="+", default=[]))
def merge(space, a):
    """Consolidated features, targets and grids of several study areas as one."""
    parts = [Workspace(space.spark, s) for s in a.schemas]
    for name in (WIDE, "grid", *a.target_table):
        space.write(consolidate.merge_schemas([p.read(name) for p in parts]), name, a.overwrite)


_LEARN = arg("-f", "--fraction", type=float, default=1.0), flag("-C", "--no-condition"), arg("-r", "--feat-regex"), flag("-R", "--invert-regex"), arg("-s", "--seed", type=int)


def _frame(space: Workspace, a) -> tuple[DataFrame, list[str]]:
    wide = space.read(WIDE)
    names = consolidate.select_features(wide, a.feat_regex, a.invert_regex)
    made = models.training_frame(wide, space.read(a.target_table), names, not a.no_condition)
    return (made if a.fraction >= 1 else consolidate.subsample(made, a.fraction, a.seed)), names


@task("train", arg("model_type", choices=models.TYPES), arg("target_table"), arg("file"), *_LEARN)
def train(space, a):
    """Train a model of the cells' weights."""
    models.Model.train(a.model_type, *_frame(space, a), a.seed).save(a.file)


@task("train-array", arg("target_table"), arg("folder"), *_LEARN)
def train_array(space, a):
    """Train a model of every type."""
    for kind, model in models.train_all(*_frame(space, a), seed=a.seed).items():
        model.save(f"{a.folder}/{kind}")


def _cells(space: Workspace, a) -> DataFrame:
    wide = space.read(WIDE)
    return wide if a.no_condition else consolidate.condition_only(wide, wide)


@task("apply", arg("file"), arg("weight_table"), flag("-C", "--no-condition"))
def apply(space, a):
    """Weights of the cells by a model."""
    space.write(models.Model.load(a.file).predict(_cells(space, a)), a.weight_table, a.overwrite, "geohash")


@task("apply-array", arg("folder"), arg("weight_table"), arg("-m", "--model-names", nargs="+", default=list(models.TYPES)), flag("-C", "--no-condition"))
def apply_array(space, a):
    """Weights of the cells by several models, a column for each."""
    loaded = {m: models.Model.load(f"{a.folder}/{m}") for m in a.model_names}
    space.write(models.predict_all(loaded, _cells(space, a)), a.weight_table, a.overwrite, "geohash")


@task("introspect", arg("file"), flag("-g", "--grouped"))
def introspect(space, a):
    """A model's importances or coefficients."""
    model = models.Model.load(a.file)
    values = space.spark.createDataFrame(model.importances(), "feature string, value double")
    return (models.introspect_grouped if a.grouped else models.introspect)(values, not model.is_tree)


@task("shap", arg("file"), arg("output_table"), arg("-n", "--subsample", type=int), arg("-s", "--seed", type=int), flag("-C", "--no-condition"))
def shap(space, a):
    """Shapley values of a tree model."""
    space.write(models.shap_values(models.Model.load(a.file), _cells(space, a), a.subsample, a.seed), a.output_table, a.overwrite)


@task("calibrate", arg("table"), arg("raw_field"), arg("calib_field"), arg("output_field"), arg("-t", "--type", default="sum", choices=["sum", "ols", "lad"]), flag("-n", "--no-intercept"))
def calibrated(space, a):
    """Add a column calibrated to known values."""
    space.update(a.table, calibrate.calibrate(space.read(a.table), a.raw_field, a.calib_field, a.output_field, a.type, not a.no_intercept))


_COMPARE = arg("true_table"), arg("model_table"), arg("-t", "--true-field", default="target")


@task("validate-raw", arg("table"), arg("-t", "--true-field", default="target"), arg("-m", "--model-field", default="value"), arg("--report"))
def validate_raw(space, a):
    """Metrics for two columns of a table."""
    if a.report:
        validate.report(space.read(a.table), a.report, a.true_field, a.model_field)
    return validate.validate_raw(space.read(a.table), a.true_field, a.model_field)


@task("validate", *_COMPARE, arg("-m", "--model-field", default="value"), arg("--report"))
def validate_model(space, a):
    """Metrics for a table of cells against true values."""
    if a.report:
        both = validate.aligned(space.read("grid").select("geohash"), space.read(a.true_table), space.read(a.model_table), a.true_field, [a.model_field])
        validate.report(both, a.report, "_true", a.model_field)
    return validate.validate_model(space.read("grid"), space.read(a.true_table), space.read(a.model_table), a.true_field, a.model_field)


@task("validate-array", *_COMPARE, arg("--report", help="folder for a page of each model"))
def validate_array(space, a):
    """Metrics for every model column."""
    if a.report:
        named = [c for c in space.columns(a.model_table) if c not in consolidate.PLACE and c != consolidate.KEY]
        both = validate.aligned(space.read("grid").select("geohash"), space.read(a.true_table), space.read(a.model_table), a.true_field, named)
        for name in named:
            validate.report(both, f"{a.report}/{name}.html", "_true", name)
    return validate.validate_array(space.read("grid"), space.read(a.true_table), space.read(a.model_table), a.true_field)


@task("validate-multiscale", *_COMPARE, arg("-m", "--model-field", default="value"), arg("-u", "--multiple", nargs="+", type=int, default=list(validate.MULTIPLES)), arg("--csv", help="folder for the levels as one CSV file"))
def validate_multiscale(space, a):
    """Metrics on coarser grids."""
    levels = validate.validate_multiscale(space.read("grid"), space.read(a.true_table), space.read(a.model_table), a.true_field, a.model_field, tuple(a.multiple))
    if a.csv:
        validate.write_levels(levels, a.csv)
    return levels


@task("import-layer", arg("path"), arg("table"), arg("-s", "--source-srid", type=int, default=4326), arg("-t", "--target-srid", type=int, default=4326), flag("-e", "--clip-extent"), arg("-g", "--geometry-type"))
def layer(space, a):
    """A layer from GeoJSON."""
    found = import_layer(read_geojson(space.spark, a.path, a.source_srid), a.source_srid, a.target_srid, _area(space, a.clip_extent), a.geometry_type)
    space.write(property_columns(found), a.table, a.overwrite)


@task("import-raster", arg("path"), arg("table"), arg("-n", "--name", default="value"), flag("-p", "--point"), flag("-e", "--clip-extent"), arg("-s", "--srid", type=int, default=0))
def raster(space, a):
    """A layer of raster cells, or their centres."""
    space.write(read_bands(space.spark, {a.name: a.path}, a.point, _area(space, a.clip_extent), a.srid), a.table, a.overwrite)


@task("import-osm", arg("path"), arg("config"), flag("-e", "--clip-extent"))
def osm(space, a):
    """Layers from OpenStreetMap XML, as a JSON file describes them."""
    for name, df in extract_layers(osm_features(read_osm(space.spark, a.path)), load_config(a.config), _area(space, a.clip_extent)).items():
        space.write(df, name, a.overwrite)


@task("import-table", arg("table"), arg("file"), arg("-c", "--encoding", default="utf-8"))
def delimited(space, a):
    """A table from a delimited file, its types guessed."""
    space.write(read_table(space.spark, a.file, a.encoding), a.table, a.overwrite)


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser("gridloom", description=__doc__)
    out.add_argument("schema", help="the study area's database")
    out.add_argument("--log-folder", help="where a rotating log file of each task goes")
    below = out.add_subparsers(dest="task", required=True)
    for name, (f, arguments) in TASKS.items():
        one = below.add_parser(name, help=f.__doc__, description=f.__doc__)
        for names, options in arguments:
            one.add_argument(*names, **options)
        one.add_argument("-o", "--overwrite", action="store_true", help="replace tables that are there")
    return out


def run(spark, words: list[str]):
    """Carry out one command in a session; returns what it has to show, a frame or a list, or nothing."""
    a = parser().parse_args(words)
    space = Workspace(spark, a.schema)
    if not a.log_folder:
        return TASKS[a.task][0](space, a)
    log = space.log_to(a.log_folder, a.task)
    log.info("begin: %s", " ".join(words))
    try:
        out = TASKS[a.task][0](space, a)
    except Exception:
        log.exception("failed")
        raise
    log.info("done")
    return out


def main(words: list[str] | None = None) -> int:
    parser().parse_args(words)  # wrong requests end before a session starts
    out = run(session(spark_sql_catalogImplementation="hive"), sys.argv[1:] if words is None else words)
    if isinstance(out, DataFrame):
        out.show(1000, truncate=False)
    elif out is not None:
        print("\n".join(out))
    return 0


if __name__ == "__main__":
    sys.exit(main())
