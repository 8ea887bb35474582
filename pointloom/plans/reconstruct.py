"""From point clouds to meshes: configuration, the stages in order, a staging folder to resume from, and the command line."""

from __future__ import annotations

import argparse
import json
import logging
import math
import time
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.functions.grid import Grid
from pointloom.functions.text import parse_capacity
from pointloom.operators import bucket, field, marching, mesh, splats
from pointloom.shared import folder
from pointloom.shipping import ship
from pointloom.sources import files, ply

log = logging.getLogger("pointloom")
SPLAT_BYTES = 32


@dataclass(frozen=True)
class Config:
    fit_smooth: float = 4.0
    max_radius: float = math.inf
    fit_grid: float = 0.01
    fit_prune: float = 0.02
    fit_boundary_limit: float = 1.0
    fit_shape: str = "sphere"
    split: bool = False
    split_size: int = 100 << 20
    leaf_cells: int = 63
    levels: int = 6
    subsampling: int = 3
    max_split: int = 1 << 30
    mem_bucket_splats: int = 64 << 20

    @property
    def block_cells(self) -> int:
        return (1 << (self.levels + self.subsampling - 1)) - 1

    @property
    def max_bucket_splats(self) -> int:
        return self.mem_bucket_splats // SPLAT_BYTES

    def validated(self) -> Config:
        rules = [
            (self.fit_smooth > 0, "fit-smooth must be positive"),
            (self.max_radius > 0, "max-radius must be positive"),
            (self.fit_grid > 0 and math.isfinite(self.fit_grid), "fit-grid must be positive"),
            (0 <= self.fit_prune <= 1, "fit-prune must be between 0 and 1"),
            (self.fit_boundary_limit >= 0, "fit-boundary-limit must not be negative"),
            (self.fit_shape in ("sphere", "plane"), "fit-shape must be sphere or plane"),
            (1 <= self.levels <= 10, "levels must be between 1 and 10"),
            (self.subsampling >= 0, "subsampling must not be negative"),
            (self.levels + self.subsampling - 1 <= 20, "levels and subsampling make a block too large"),
            (self.leaf_cells >= 1, "leaf-cells must be positive"),
            (self.max_split >= 8, "max-split must be at least 8"),
            (self.max_bucket_splats >= 1, "mem-bucket-splats is too small"),
            (self.split_size > 0, "split-size must be positive"),
        ]
        for good, text in rules:
            if not good:
                raise ValueError(text)
        return self


def check_grid(grid: Grid) -> Grid:
    for axis in range(3):
        if grid.num_vertices(axis) > marching.MAX_VERTICES:
            raise ValueError(f"The bounding box is too big: {grid.num_vertices(axis)} vertices on axis {axis}, {marching.MAX_VERTICES} at most")
    return grid


def prepare(points: DataFrame, config: Config) -> DataFrame:
    """Splats with radius and quality, finite ones only."""
    return splats.finite(splats.project(points, config.fit_smooth, config.max_radius))


def surface(points: DataFrame, config: Config) -> tuple[DataFrame, DataFrame, Grid]:
    """(vertices, triangles, grid) in grid units, neither pruned nor numbered; all but the bounding box is lazy."""
    cloud = prepare(points, config)
    grid = check_grid(splats.bounding_grid(cloud, config.fit_grid))
    values = field.mls_field(splats.to_grid(cloud, grid), config.fit_shape, config.fit_boundary_limit)
    return *marching.isosurface(values, (-1, -1, -1)), grid


def chunk_cells_of(config: Config) -> int:
    return bucket.chunk_cells_of(config.split_size) if config.split else 0


def stage(points: DataFrame, config: Config, at: str) -> None:
    """Write the unpruned mesh and what the writer needs to ``at``: vertices, triangles, components, manifest."""
    spark = points.sparkSession
    vertices, triangles, grid = surface(points, config)
    triangles.write.mode("overwrite").parquet(f"{at}/triangles")
    vertices.write.mode("overwrite").parquet(f"{at}/vertices")
    mesh.components(spark.read.parquet(f"{at}/triangles")).write.mode("overwrite").parquet(f"{at}/components")
    manifest = {"config": {k: (None if v == math.inf else v) for k, v in asdict(config).items()}, "reference": grid.reference, "spacing": grid.spacing, "extents": grid.extents}
    out = files.Writing(f"{at}/manifest.json")
    out.write(json.dumps(manifest).encode())
    out.commit()


def load_manifest(at: str) -> tuple[Config, Grid]:
    uri = f"{at}/manifest.json"
    got = json.loads(files.read_at(uri, 0, files.size(uri)))
    given = got["config"] | {"max_radius": math.inf if got["config"]["max_radius"] is None else got["config"]["max_radius"]}
    return Config(**given), Grid(tuple(got["reference"]), got["spacing"], tuple(map(tuple, got["extents"])))


def finish(spark: SparkSession, at: str, output: str, config: Config | None = None, comments: tuple[str, ...] = ()) -> dict:
    """Prune, number and write the staged mesh, with the pruning and splitting of ``config`` if one is given. The staging folder stays, so this can be repeated."""
    staged, grid = load_manifest(at)
    config = config or staged
    vertices, triangles, labels = (spark.read.parquet(f"{at}/{n}") for n in ("vertices", "triangles", "components"))
    sizes = mesh.totals(mesh.component_sizes(triangles, labels), config.fit_prune).first().asDict()
    vertices, triangles = mesh.prune(vertices, triangles, config.fit_prune, labels)
    vertices = mesh.to_world(vertices, grid)
    where, _, base = output.rpartition("/")
    by: list[str] = []
    cells = chunk_cells_of(config)
    if config.split:
        by = ["cx", "cy", "cz"]
        triangles = triangles.withColumns(dict(zip(by, mesh.chunk_of((F.col("x"), F.col("y"), F.col("z")), cells), strict=True)))
    numbered, indexed = mesh.index(vertices, triangles, by)
    if config.split:
        names = mesh.chunk_totals(numbered, indexed, by).withColumn("file", mesh.chunk_name(base.removesuffix(".ply"), *[F.col(c) for c in by]))
    else:
        names = numbered.agg(F.count("*").alias("vertices")).crossJoin(indexed.agg(F.count("*").alias("triangles"))).withColumn("file", F.lit(base))  # one row
    return sizes | {"files": ply.write_mesh(numbered, indexed, names, where or ".", by=by, comments=comments)}


def reconstruct(spark: SparkSession, inputs: list[str], output: str, config: Config = Config(), staging: str | None = None) -> dict:
    """The whole run. Returns totals, the files written and the times of the passes."""
    ship(spark)
    config = config.validated()
    at = staging or folder(spark, "mesh")
    began = time.time()
    stage(ply.read_splats(spark, *inputs), config, at)
    middle = time.time()
    comments = ("Made by pointloom", "Options: " + " ".join(f"{k}={v}" for k, v in asdict(config).items()))
    return finish(spark, at, output, config, comments) | {"pass1.time": middle - began, "finalize.time": time.time() - middle}


def concatenate(spark: SparkSession, inputs: list[str], output: str) -> int:
    """Point clouds as one, without points that are not finite."""
    ship(spark)
    points = ply.read_splats(spark, *inputs)
    from pointloom.functions.grid import defined

    return ply.write_points(points.where(defined(*[F.col(c) for c in ply.PROPERTIES])), output)


def parser() -> argparse.ArgumentParser:
    """Options as they are written; ``@file`` reads options from a file, and later ones win."""
    p = argparse.ArgumentParser("pointloom", usage="%(prog)s [options] -o output.ply input.ply [input.ply...]", fromfile_prefix_chars="@")
    p.convert_arg_line_to_args = str.split
    d = Config()
    p.add_argument("input", nargs="*")
    p.add_argument("-o", "--output-file", required=True)
    for name in ("fit-smooth", "max-radius", "fit-grid", "fit-prune", "fit-boundary-limit"):
        p.add_argument(f"--{name}", type=float, default=getattr(d, name.replace("-", "_")))
    p.add_argument("--fit-shape", choices=("sphere", "plane"), default=d.fit_shape)
    p.add_argument("--split", action="store_true")
    for name in ("split-size", "mem-bucket-splats"):
        p.add_argument(f"--{name}", type=parse_capacity, default=getattr(d, name.replace("-", "_")))
    for name in ("leaf-cells", "levels", "subsampling", "max-split"):
        p.add_argument(f"--{name}", type=int, default=getattr(d, name.replace("-", "_")))
    p.add_argument("--checkpoint", help="stage into this folder and stop")
    p.add_argument("--resume", help="write from this staging folder")
    p.add_argument("--tmp-dir", help="staging folder")
    p.add_argument("--statistics", action="store_true")
    p.add_argument("--statistics-file")
    p.add_argument("--quiet", action="store_true")
    p.add_argument("--debug", action="store_true")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> dict:
    args = parser().parse_args(argv)
    logging.basicConfig(level=logging.ERROR if args.quiet else logging.DEBUG if args.debug else logging.INFO)
    config = replace(Config(), **{k: v for k, v in vars(args).items() if k in Config.__dataclass_fields__}).validated()
    spark = spark or SparkSession.builder.appName("pointloom").getOrCreate()
    ship(spark)
    if args.resume:
        out = finish(spark, args.resume, args.output_file, config)
    elif not args.input:
        raise ValueError("At least one input point is required")
    elif args.checkpoint:
        stage(ply.read_splats(spark, *args.input), config, args.checkpoint)
        out = {"checkpoint": args.checkpoint}
    else:
        out = reconstruct(spark, args.input, args.output_file, config, args.tmp_dir)
    if args.statistics or args.statistics_file:
        text = "".join(f"{k}: {v}\n" for k, v in sorted(out.items()) if not isinstance(v, list))
        if args.statistics_file:
            w = files.Writing(args.statistics_file)
            w.write(text.encode())
            w.commit()
        log.info("%s", text)
    return out


if __name__ == "__main__":
    main()
